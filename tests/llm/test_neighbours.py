import numpy as np
import pytest

from tallyweave.llm import neighbours


def brute(rows, asked, k=10):
    """By the definition: an id is the set of its vectors, the distance of two ids that of their nearest vectors."""
    found = {}
    ids = sorted({i for i, _ in rows})
    for q in sorted({i for i, _ in asked}):
        own = [np.array(v) for i, v in asked if i == q]
        far = [(min(float(np.sqrt(np.square(np.array(v) - x).sum())) for i, v in rows if i == c for x in own), c) for c in ids if c != q]
        found[q] = sorted(far)[:k]
    return found


def by_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16))
    rows = [(i, v[i].tolist(), "x") for i in range(1500)]
    odd = [(2000, None, "x"), (2001, [0.0] * 16, "x"), (2002, [float("nan")] * 16, "x"), (2003, [None] * 16, "x"), (2004, [1.0] * 3, "x"), (None, v[0].tolist(), "x"), (2100, v[100].tolist(), "x"), (2101, [float("inf")] + [0.0] * 15, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    found = by_query(neighbours.nearest(table, table.where("vec_id % 100 = 0")).collect())
    assert set(found) == {*range(0, 1500, 100), 2100}
    everything = {**dict(enumerate(v)), 2100: v[100]}
    ids = np.array(sorted(everything))
    matrix = np.stack([everything[i] for i in ids])
    hits = 0
    for q, own in found.items():
        far = np.sqrt(np.square(matrix - everything[q]).sum(1))
        best = [i for i in ids[np.lexsort((ids, far))] if i != q][:10]
        hits += len({i for _, i in own} & set(best))
        assert len(own) == 10 and q not in [i for _, i in own]
        assert own == sorted(own)
        assert all(abs(s - np.sqrt(np.square(everything[i] - everything[q]).sum())) < 1e-12 for s, i in own)
    assert hits >= 0.95 * 10 * len(found)
    assert found[2100][0] == (0.0, 100)


@pytest.mark.parametrize("folder", ["sf0.1"])
def test_recall_over_all_queries_of_embeddings(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    found = by_query(neighbours.nearest(table, table.where("vec_id % 100 = 0")).collect())
    rows = table.orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    hits = 0
    for q, own in found.items():
        far = np.sqrt(np.square(v - v[ids == q]).sum(1))
        hits += len({i for _, i in own} & {i for i in ids[np.lexsort((ids, far))].tolist() if i != q and i in ids[np.lexsort((ids, far))][:11]})
    assert len(found) == len(rows) // 100 and hits >= 0.95 * 10 * len(found)


def test_repeated_ids_and_copies_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(0, 3, 3)]) for i in rng.integers(0, 60, 90)]
    rows = [r for r in rows if any(r[1])] + [(100, [1.0, 0.0, 0.0]), (100, [0.0, 2.0, 1.0]), (100, [1.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0])] + [(i, [5.0, 5.0, 5.0]) for i in range(300, 340)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] % 20 == 0]
    got = by_query(neighbours.nearest(table, table.where("vec_id % 20 = 0")).collect())
    assert got == brute(rows, asked)


def test_hot_lists_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (np.array([1.0, 0, 0, 0]) + rng.normal(size=4) * 1e-3).tolist()) for i in range(600)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "LIST", 50)
    got = by_query(neighbours.nearest(table, table.where("vec_id % 100 = 0")).collect())
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(table, table.where("vec_id = 100")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in rows] == [(1, 1), (2, 2)]
    assert neighbours.nearest(table.limit(0), table.limit(0)).collect() == []


def test_pivots_in_blocks_keep_the_order():
    r = np.random.default_rng(4)
    v, pivots = r.normal(size=(50, 8)), r.normal(size=(333, 8))
    whole = np.argsort(((v[:, None, :] - pivots[None, :, :]) ** 2).sum(2), axis=1, kind="stable")
    for at_once in (1, 7, 64, 332, 333, 4_096):
        assert np.array_equal(neighbours.orders(v, pivots, 64, at_once), whole[:, :64])
    assert neighbours.orders(v, pivots[:5], 64).shape == (50, 5)
