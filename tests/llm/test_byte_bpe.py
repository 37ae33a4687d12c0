import hashlib
import random
import resource
import time

import public_tokenizers
import tiktoken

from tallyweave.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "na" * 300 + " " + "x9'll  \n\t " * 40
TEXTS = [None, "", "Hello world", "naïve café — 日本語 🙂", "  spaces \n\n and\ttabs ", LONG, "Hello world", "aaaaaaaaaaaaa", "<|endoftext|>", "\0\x01"]


def test_equals_tiktoken_and_round_trips(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    rows = {r.doc_id: r for r in byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})
    assert len(rows) == len(TEXTS) + 1 and rows[None].n_tokens == 2
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded == (t or "").encode() and rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_of_ids(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    coded = byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: r.text for r in byte_bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def long_runs():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = "the of and tion ing re ent ation er in on at es ed".split()
    return [
        "".join(r.choice(letters) for _ in range(3_000)), "a" * 2_111, "ab" * 999, "na" * 1_001 + "b", "".join(r.choice(words) for _ in range(900)),
        "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(700)), "".join(r.choice("aé語") for _ in range(900)), " " * 700, "=" * 1_500, "!?" * 600, "e" * 129, "th" * 65,
    ]


def test_long_pieces_equal_tiktoken():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})
    coder = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    for text, (_, ids, decoded) in zip(long_runs(), coder.code(long_runs()), strict=True):
        assert ids.tolist() == own.encode_ordinary(text) and decoded == text.encode()


def test_one_run_of_100_000_letters_is_bounded():
    text = "".join(random.Random(6).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(100_000))
    coder = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    ((_, ids, decoded),) = coder.code([text])
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})
    assert ids.tolist() == own.encode_ordinary(text) and decoded == text.encode()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_runs_of_any_length_equal_tiktoken():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})
    coder = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    r = random.Random(9)
    texts = [c * n for c in (".", "0", "=", "-", " ", "語", "ab", "=-") for n in (129, 200, 255, 257, 1_537, 2_049, 4_097, 8_193)] + ["." * 100_000, "0" * 99_999, "語" * 30_001]
    texts += ["a" * 5_000 + "".join(r.choice("abcdefghij") for _ in range(3_000)) + "b" * 777, ("." * 777 + "x") * 9, "".join(r.choice(["..", ".-", "--", "."]) for _ in range(3_000))]
    for text in texts:
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
        ((_, ids, decoded),) = coder.code([text])
        assert time.time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
        assert ids.tolist() == own.encode_ordinary(text) and decoded == text.encode()


def test_a_rank_at_a_time_equals_a_pair_at_a_time():
    coder = byte_bpe.Coder(PATH, public_tokenizers.PATTERN)
    r = random.Random(10)
    pieces = ["".join(r.choice(some) for _ in range(r.randrange(2, 200))).encode() for some in ("ab", "thering", ["the", "re", "her", "e", "t"], ".-", "aaab", "0123456789", "語文é") for _ in range(30)]
    assert coder.contract(pieces, byte_bpe.CONTRACT_RUNS) == coder.contract(pieces)
