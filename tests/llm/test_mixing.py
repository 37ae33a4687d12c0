import os

import duckdb
import pytest

from tallyweave.llm import mixing

ROWS = [(i, f"word {i} " * (1 + i % 7) + ["plain", "a | b", "NOW!!", "$$$"][i % 4], ["en", "de", None][i % 3], "big" if i % 3 else f"s{i % 5}", i) for i in range(400)]
ROWS += [(1000, None, "en", "big", 1), (1001, "", "en", None, 2), (None, "no id", "de", "big", 3), (0, ROWS[0][1], "en", "s0", 4), (1002, "long " * 100_000, "fr", "rare", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, probability int"


def decided(spark, rows, **options):
    return mixing.decide(spark.createDataFrame(rows, SCHEMA), **options).selectExpr("doc_id", "source", "lang", "mix.*").toDF("doc_id", "s", "l", "source", "lang", "topic", "n_tokens", "probability", "kept", "gap").collect()


def test_equals_sql(spark, sf_dir):
    from tallyweave.llm import queries

    got = queries.op4_mixing(spark, sf_dir)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL["op4_mixing"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_edge_rows_and_fates(spark):
    rows = decided(spark, ROWS)
    assert len(rows) == len(ROWS) and all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) < (mixing.FRACTION + 1e-6) * total
    assert {r.topic for r in rows if r.doc_id == 1000} == {"none"} and {r.source for r in rows if r.doc_id == 1001} == {mixing.NULL}
    assert len({r.kept for r in rows if r.doc_id == 0}) == 1
    fate = {r.doc_id: r.kept for r in rows}
    assert fate == {r.doc_id: r.kept for r in decided(spark, list(reversed(ROWS)))}
    assert decided(spark, []) == []


def test_sample_meets_the_targets(spark):
    """By the definition: target shares are powers of token shares, and the tokens expected to be kept have those shares within 0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.decide(docs).selectExpr("source", "lang", "mix.topic", "mix.n_tokens", "mix.probability", "mix.kept").collect()
    kept = sum(r.n_tokens * r.probability for r in rows)
    assert kept > 0.3 * sum(r.n_tokens for r in rows)
    for d in mixing.DIMENSIONS:
        size = {}
        for r in rows:
            size[r[d]] = size.get(r[d], 0) + r.n_tokens
        whole = sum(n**mixing.TEMPERATURE for n in size.values())
        for v, n in size.items():
            own = sum(r.n_tokens * r.probability for r in rows if r[d] == v)
            assert own / kept == pytest.approx(n**mixing.TEMPERATURE / whole, abs=0.01)
            drawn = sum(r.n_tokens for r in rows if r[d] == v and r.kept) / sum(r.n_tokens for r in rows if r.kept)
            assert drawn == pytest.approx(n**mixing.TEMPERATURE / whole, abs=0.06)


def test_learned_terms_and_topics(spark):
    texts = ["a beta alpha beta beta z", "a alpha gamma", "a beta x", "a delta alpha x", "the the", "of", None, "", "alphabet", "xyz9"]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert mixing.learned_terms(docs, share=0.2) == ["beta", "alpha", "alphabet", "delta"]
    topics = {r.doc_id: r.topic for r in mixing.with_cells(docs, ["beta", "alpha"], "text", "source", "lang").selectExpr("doc_id", f"{mixing.CELL}.topic").collect()}
    assert topics == {0: "beta", 1: "alpha", 2: "beta", 3: "alpha", 4: "other", 5: "other", 6: "none", 7: "other", 8: "other", 9: "other"}


def test_given_targets_with_repeats_nulls_and_missing_values(spark):
    cells = spark.createDataFrame([(a, b, "t", 100 * (i + 1)) for i, (a, b) in enumerate((a, b) for a in "xyz" for b in ("p", mixing.NULL))], "source string, lang string, topic string, tokens long")
    shares = [("x", 0.25), ("x", 0.25), ("y", 0.5), ("absent", 9.0)]
    targets = {"source": spark.createDataFrame(shares, "source string, share double"), "lang": spark.createDataFrame([("p", 0.6), (None, 0.4)], "lang string, share double")}
    raked = mixing.rake(cells, targets=targets)
    got = {(r.dimension, r.value): r for r in mixing.margins(raked).collect()}
    for key, share in {("source", "x"): 0.5, ("source", "y"): 0.5, ("source", "z"): 0.0, ("lang", "p"): 0.6, ("lang", mixing.NULL): 0.4}.items():
        assert got[key].target == pytest.approx(share) and got[key].achieved == pytest.approx(share, abs=0.003)


def test_infeasible_targets_are_told(spark):
    # x has only p, y only q: the shares of sources and languages can't differ
    cells = spark.createDataFrame([("x", "p", "t", 100), ("y", "q", "t", 900)], "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("p", 0.2), ("q", 0.8)], "lang string, share double")}
    raked = mixing.rake(cells, targets=targets)
    worst = max(abs(r.target - r.achieved) for r in mixing.margins(raked).collect())
    assert worst > 0.1 and max(r.gap for r in raked.collect()) == pytest.approx(worst)


def test_native(spark, sf_dir):
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    plan = mixing.decide(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
