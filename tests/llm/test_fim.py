import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import fim

SCHEMA = "doc_id long, text string, n string, form int"


def expected(doc_id, text):
    """The definition, over code points."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h4 % 100 < 20:
        return n, "spm", x, y - x, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", x, y - x, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(3)
    some = [None, "", "a", "é", "語", "🙂", "<P>", "a<S>b", "x<M", "<<P>", "<P<S", "<P", ">", "<ÿ<M>", "long " * 2_000 + "<M>", "日本語🙂" * 3_000, "x" * 255 + "<P>", "x" * 254 + "<" * 5]
    some += ["".join(r.choice("ab<PSM>é語🙂") for _ in range(r.randrange(700))) for _ in range(150)]
    return some + ["the same row"] * 5


@pytest.mark.parametrize("chunk", [fim.CHUNK, 300])
def test_equals_the_definition_and_restores(spark, chunk):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "no id at all", "x", 1), (7, "an id that stands twice", "x", 1)]
    made = fim.transform(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    got = sorted(map(tuple, fim.restore(made, chunk=chunk).collect()), key=repr)
    assert got == sorted(((i, *expected(i, t), t or "") for i, t, _, _ in rows), key=repr)
    forms = {g[2] for g in got}
    assert forms == {"plain", "psm", "spm"}


def test_query_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in fim.query_digest(fim.transform(docs)).collect()}
    for d in docs.collect():
        n, form, x, m, out = expected(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, x, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_other_sentinels_and_outputs_that_do_not_fit(spark):
    marks = ("<|fim▁begin|>", "<|fim▁hole|>", "<|fim▁end|>")
    docs = spark.createDataFrame([(i, f"text number {i} with ▁ and <|fim") for i in range(50)], "doc_id long, text string")
    back = fim.restore(fim.transform(docs, sentinels=marks), sentinels=marks).collect()
    assert all(r.restored == f"text number {r.doc_id} with ▁ and <|fim" for r in back)
    wrong = spark.createDataFrame([("psm", "<P>a<S>b"), ("psm", "<S>a<P>b<M>c"), ("psm", "x<P>a<S>b<M>c"), ("spm", None), ("plain", None), (None, "a"), ("plain", "<P>")], "form string, output string")
    assert [r.restored for r in fim.restore(wrong).orderBy(F.col("form"), "output").collect() if r.restored] == ["<P>"]
    for bad in (("<P>", "P>x", "<M>"), ("", "b", "c"), ("ab", "abc", "d")):
        with pytest.raises(ValueError):
            fim.Automaton(bad)


def test_the_two_passes_find_each_code_point():
    text = "aé<語🙂" * 300
    raw = text.encode()
    import numpy as np

    data = np.frombuffer(raw * 2, dtype=np.uint8)
    scan = fim.Scan(fim.Automaton(fim.SENTINELS), data, np.array([0, len(raw), 2 * len(raw)]), lane=7)
    assert scan.totals(fim.UNIT).tolist() == [len(text)] * 2
    places = scan.locate(fim.UNIT, np.ones(len(text) + 1, dtype=int), np.arange(len(text) + 1)) - len(raw)
    assert places.tolist() == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_empty_table(spark):
    assert fim.query_digest(fim.transform(spark.createDataFrame([], SCHEMA))).collect() == []
