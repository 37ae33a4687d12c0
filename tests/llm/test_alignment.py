import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyweave.llm import alignment
from tallyweave.llm.units import ByteLevel, Pieces, Words, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "Hello world", "Hello  world\n and\tmore ", " leading", "trailing ", "\n \n", "naïve café — 日本語 🙂 x", "<|endoftext|> and <s> </s> <unk> <0x41>", "a b 　c", "x" * 3_000, "日本語" * 500,
    "▁odd ▁▁mark", "don't we'll it's 12,345.67", "ﬁ Ａ １ é é", "\0 \x01 \x1c y", "the same", "the same", "word " * 2_000, " ", "  two", "a   b", "tab\there .\n\nnew",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, a, b):
    """The definition, text by text, without units."""
    bytes_a, bytes_b = ByteLevel(A, plain=True).tokens, Pieces(B).tokens
    rows, linked = [], []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + t).encode() if t else b""
        if b"".join(bytes_a[i] for i in x) != raw or b"".join(bytes_b[i] for i in y) != raw:
            x, y = [], []
        spans = []
        for ids, table in ((x, bytes_a), (y, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        links = [(i, j) for p, q, i in spans[0] for r, s, j in spans[1] if p < s and r < q] if len(x) < 3_000 else walk(*spans)
        shared = sorted({q for _, q, _ in spans[0]} & {s for _, s, _ in spans[1]})
        text, begin = [], 0
        for end in shared:
            text.append("|".join(",".join(str(i) for p, q, i in side if begin <= p and q <= end) for side in spans) if len(x) < 3_000 else "")
            begin = end
        rows.append((len(x), len(y), len(shared), len(links), ";".join(text)))
        linked.append(Counter(links))
    n = Counter(pair for own in linked for pair in own)
    best = Counter()
    for (i, _), k in n.items():
        best[i] = max(best[i], k)
    sums = [(sum(k for p, k in own.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in own.items())) for own in linked]
    return [(*r[:4], *s, hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "", r[4]) for r, s in zip(rows, sums, strict=True)]


def walk(left, right):
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        out.append((left[i][2], right[j][2]))
        x, y = left[i][1], right[j][1]
        i, j = i + (x <= y), j + (y <= x)
    return out


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 40])
def test_equals_the_definition(spark, libraries, chunk):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(["ab", "the ", "  ", "\n", "é", "語", " x", "ing", "."]) for _ in range(r.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, block int").repartition(3)
    want = {i if i != 2 else None: w for i, w in enumerate(brute(texts, *libraries))}
    got = {g.doc_id: tuple(g)[1:] for g in alignment.align(docs, A, B, chunk=chunk).collect()}
    said = {g.doc_id: g.groups for g in alignment.groups(docs, A, B, chunk=chunk).collect()}
    assert len(got) == len(texts)
    for i, w in want.items():
        assert got[i][:6] == w[:6], texts[i or 2]
        if w[0] < 3_000:
            assert got[i][6] == w[6] and said[i] == w[7]


def test_units_do_not_change_the_ids(spark, sf_dir, libraries):
    a, b = libraries
    texts = [t for t in TEXTS if t] + [d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if d.text]
    own, pieces = ByteLevel(A, plain=True), Pieces(B)
    assert pieces.divisible
    for t in texts:
        cut = units(t)
        assert " ".join(cut) == t
        assert [i for u in own.encode([f" {u}" for u in cut]) for i in u] == a.encode(" " + t, add_special_tokens=False).ids
        assert [i for u in pieces.encode(cut) for i in u] == b.encode(t)
    whole = Tokenizer.from_file(A)
    for ids, t in zip(Words(ByteLevel(A, plain=False)).encode(texts), texts, strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).collect() == [] and alignment.groups(docs, A, B).collect() == []
