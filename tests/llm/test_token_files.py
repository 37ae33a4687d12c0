import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyweave.llm import token_files
from tallyweave.llm.units import ArrowWords, ByteLevel

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, part int"


def expected(rows, end=2):
    library = Tokenizer.from_file(PATH)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]
    starts = np.cumsum([0, *(len(x) for _, x in ids)])
    return [(i, int(s), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()), x) for (i, x), s in zip(ids, starts, strict=False)]


def texts():
    r = random.Random(8)
    some = [None, "", "Hello world", "<|endoftext|> a <|endoftext|>", " a  b\n", "日本語 🙂" * 200, "word " * 5_000]
    return some + [" ".join(r.choice(["the", "token", "file", "x1", "é", "\n"]) for _ in range(r.randrange(80))) for _ in range(200)]


@pytest.mark.parametrize(("file_ids", "block", "parts"), [(token_files.FILE_IDS, token_files.BLOCK, None), (300, 64, 5), (1, 7, 1)])
def test_files_hold_the_ids_in_order(spark, tmp_path, file_ids, block, parts):
    rows = [(3 * i - 50, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4, "text")
    manifest = token_files.write(docs, PATH, folder=f"file://{tmp_path}/out", file_ids=file_ids, block=block, parts=parts)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read(manifest).collect())
    assert got == expected(rows)
    listed = manifest.orderBy("part", "seq").collect()
    assert {r.file for r in listed} == {f"file://{tmp_path}/out/{f}" for f in os.listdir(tmp_path / "out")}
    in_files = []
    for r in listed:
        with open(r.file.removeprefix("file://"), "rb") as f:
            index, content = token_files.unpack(f.read())
        assert (r.n_docs, r.n_ids) == (index.num_rows, sum(index.column("n").to_pylist()))
        in_files += np.concatenate(list(content)).tolist()
    assert in_files == [i for e in expected(rows) for i in e[4]]


def test_rows_that_share_an_id_and_null_ids(spark):
    rows = [(7, "the same text")] * 40 + [(None, "no id"), (7, "another text"), (7, None), (-1, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(token_files.read(token_files.write(docs, PATH), arrays=False).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -1] + [7] * 42
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted((len(x), crc) for _, _, n, crc, x in expected(rows))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want


def cases():
    r = np.random.default_rng(1)
    yield from (np.zeros(0), np.array([3]), np.zeros(10_000), np.arange(5_000), np.tile([5, 50_256, 0, 2], 3_000), r.integers(0, 50_257, 9_000), r.integers(0, 2**32 - 1, 3_000), np.full(100, 2**32 - 1))
    yield r.zipf(1.3, 20_000) % 50_257


@pytest.mark.parametrize("lanes", [token_files.LANES, 3])
def test_the_coder_gives_back_any_ids(lanes):
    for ids in cases():
        ids = ids.astype("<u4")
        content = token_files.pack(ids, pa.table({"n": [len(ids)]}), block=256, lanes=lanes)
        index, parts = token_files.unpack(content, lanes=lanes)
        assert index.column("n").to_pylist() == [len(ids)]
        assert np.array_equal(np.concatenate([np.zeros(0, dtype="<u4"), *parts]), ids)
        assert len(content) < 4 * len(ids) + 14 * (len(ids) // 256 + 1) + 600


def test_it_compresses_and_blocks_stand_alone():
    ids = np.random.default_rng(2).zipf(1.5, 60_000).astype("<u4") % 5_000
    assert len(token_files.pack(ids, pa.table({"n": [len(ids)]}))) < 2 * len(ids)
    text = np.tile(np.random.default_rng(3).integers(0, 50_000, 400), 100).astype("<u4")
    assert len(token_files.pack(text, pa.table({"n": [len(text)]}))) < 0.6 * len(text)
    a, b = (token_files.pack(x, pa.table({"n": [2048]})) for x in (ids[:2048], ids[2048:4096]))
    both = token_files.pack(ids[:4096], pa.table({"n": [2048]}))
    assert both.endswith(a[-500:] + b[-500:]) or both[-500:] == b[-500:]


def test_damage_is_found():
    ids = np.random.default_rng(2).integers(0, 3_000, 5_000).astype("<u4")
    content = token_files.pack(ids, pa.table({"n": [len(ids)]}))
    for place in (3, 20, 60, len(content) // 2, len(content) - 900):
        wrong = bytearray(content)
        wrong[place] ^= 0x55
        with pytest.raises(ValueError, match="damaged|no file"):
            list(token_files.unpack(bytes(wrong))[1])
    with pytest.raises(ValueError, match="no file"):
        token_files.unpack(b"short")


def test_empty_table(spark):
    manifest = token_files.write(spark.createDataFrame([], SCHEMA), PATH)
    assert manifest.collect() == [] and token_files.read(manifest).collect() == []


@pytest.mark.parametrize("remembered", [700_000, 3])
def test_units_taken_apart_by_arrow_have_the_ids_of_whole_texts(remembered):
    library, words = Tokenizer.from_file(PATH), ArrowWords(ByteLevel(PATH, plain=False), remembered=remembered)
    spaces = ["\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​"]
    odd = ["don't", "I'll", "naïve.", "été,\nOn", "x1", "a_b", "ªb", "aªb.", "áb", "word<|endoftext|>more", "<|endoftext|>", "日本語。", "ʼn", "ſs's", "Ⅷ", "a²", "×÷", "a×b", "\x00", "a\x00b", "🙂!", "...", "x" * 500]
    r = random.Random(4)
    found = texts() + [f"a{s}b {s}c{s} d{s}" for s in spaces] + [f"{a} {b}" for a in odd for b in odd] + [f" {a}  {b}\n" for a in odd for b in odd[:4]]
    found += ["".join(r.choice([*odd, *spaces, " ", " ", "ab", "."]) for _ in range(r.randrange(30))) for _ in range(1_500)]
    for a in range(0, len(found), 300):
        got = words.encode(pa.array(found[a : a + 300], pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in found[a : a + 300]]
        assert [g.tolist() for g in got] == want
    assert words.encode(pa.array([], pa.string())) == [] and [len(x) for x in words.encode(pa.array([None, None], pa.string()))] == [0, 0]


def test_words_are_encoded_once_and_without_their_punctuation(monkeypatch):
    vocabulary = ByteLevel(PATH, plain=False)
    words, asked = ArrowWords(vocabulary), []
    encode = vocabulary.encode
    monkeypatch.setattr(vocabulary, "encode", lambda texts: asked.extend(texts) or encode(texts))
    words.encode(pa.array(["x anblewh, anblewh. anblewh", "x anblewh.\nOn anblewh"]))
    assert sum(t.count("anblewh") for t in asked) == 1


def test_the_model_takes_few_bits_and_blocks_are_coded_in_few_steps():
    r = np.random.default_rng(5)
    ids = np.concatenate([(r.zipf(1.4, 2_048) % 400) * 97 + 1_000 for _ in range(64)]).astype("<u4")
    content = token_files.pack(ids, pa.table({"n": [len(ids)]}))
    assert 8 * len(content) < 9 * len(ids)  # 16 as they are
    with pytest.raises(ValueError, match="a block has"):
        token_files.pack(ids, pa.table({"n": [len(ids)]}), block=0)


def test_long_words_are_forgotten():
    words = ArrowWords(ByteLevel(PATH, plain=False), remembered=2_000)
    for k in range(12):
        words.encode(pa.array([f"on {chr(97 + k) * 9_000} 7{k}{'0' * 9_000} word on.{k}{'-' * 9_000}"]))
    for memory in (words.heads, words.whole, words.rests):
        assert sum(map(len, memory.known)) < 16 * 2_000 + 10_000
    assert "word" in words.heads.known
