import numpy as np

from tallyweave.llm import quality
from tallyweave.llm.common import held_out

GOOD = "The quiet river ran past the old mill and the people of the town went home before the rain began to fall."
BAD = "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!! $$$ ### BUY!! NOW!! BUY!! NOW!!"


def fixture(spark, n=120):
    docs = [(i, (GOOD if i % 3 else BAD) + f" Word{i * 7919 % 101} ends here.") for i in range(n)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ranks_good_above_bad_on_held_out_rows(spark):
    docs, labels = fixture(spark)
    model = quality.train(docs, labels.where(~held_out("doc_id", 5, 0)))
    rows = quality.scores(docs, model).collect()
    assert len(rows) == 120
    good, bad = [r.score for r in rows if r.doc_id % 3], [r.score for r in rows if not r.doc_id % 3]
    assert min(good) > 0.5 > max(bad)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows_and_clashing_columns(spark):
    docs, labels = fixture(spark)
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "s", 2.0), (2, "", "s", 2.0), (None, GOOD, None, 2.0), (3, GOOD, "s", 2.0), (3, GOOD, "s", 2.0), (4, GOOD * 3000, "s", None)], "doc_id long, text string, label string, score double")
    rows = quality.scores(odd, model).collect()
    assert len(rows) == 6 and all(np.isfinite(r.score) for r in rows)
    assert rows[0].score == rows[1].score and rows[3].score == rows[4].score
    assert quality.scores(odd.limit(0), model).collect() == []


def test_one_label_or_none_gives_constant_scores(spark):
    docs, labels = fixture(spark, 12)
    for some in (labels.where("quality = 1"), labels.limit(0)):
        rows = quality.scores(docs, quality.train(docs, some)).collect()
        assert len({r.score for r in rows}) == 1


def test_quantile_threshold(spark):
    docs, labels = fixture(spark)
    scored = quality.scores(docs, quality.train(docs, labels))
    kept = {r.doc_id: r.rank_score for r in quality.above_quantile(scored, 1 / 3).collect()}
    left_out = [r.rank_score for r in scored.collect() if r.doc_id not in kept]
    assert len(kept) >= 80 and {i for i in range(120) if i % 3} <= kept.keys() and max(left_out) < min(kept.values())  # ties stay


def test_pairs_prefer_the_better(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(int)
    w = quality.fit(x, y).weights
    assert w[0] > 0 > w[1] and abs(w[2]) < abs(w[0])


def plain_features(text):
    """The shares by plain counting; the hashed slots are checked by their sum."""
    raw, words = (text or "").encode(), (text or "").split()
    n, w = max(len(raw), 1), max(len(words), 1)
    lines = [x for x in (text or "").split("\n") if x]
    symbols, puncts = b"#$%&*+<=>@[]^_`{|}~\\/", b"!.,;:?-\"'()"
    share = lambda ok: sum(map(ok, raw)) / n
    return [
        share(lambda b: 65 <= b < 91), share(lambda b: 48 <= b < 58), share(lambda b: b in symbols), share(lambda b: b in puncts), share(lambda b: b >= 128), share(lambda b: b == 10),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, (len(words) - len(set(words))) / w, (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(len(x.encode()) for x in words) / w / 10, sum(len(x.encode()) > 15 for x in words) / w, sum(x.encode()[-1] in symbols for x in words) / w, np.log1p(len(words)) / 10, float(not words), sum("A" <= x[0] <= "Z" for x in words) / w,
    ]


def test_features_pairs_and_loss_equal_the_definition():
    texts = [None, "", GOOD, BAD, "Tabs\tand lines\nand lines\nand lines\n\nend| a | b é日本 supercalifragilistic", "same same same other same"]
    x = quality.features(texts)
    n = len(quality.SHARES)
    assert np.allclose(x[:, :n], [plain_features(t) for t in texts], atol=1e-6)
    assert np.allclose(x[:, n:].sum(1), [0, 0, 1, 1, 1, 1]) and len(set(x[5, n:])) == 3
    # weights are where the pairwise logistic loss with its ridge has no slope
    rng = np.random.default_rng(3)
    z = rng.normal(size=(60, 4))
    y = (z[:, 0] + rng.normal(size=60) > 0).astype(int)
    model = quality.fit(z, y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rare, other = (good, bad) if len(good) < len(bad) else (bad, good)
    a, b = np.repeat(rare, quality.PAIRS_EACH), np.random.default_rng(7).choice(other, len(rare) * quality.PAIRS_EACH)
    better, worse = (a, b) if rare is good else (b, a)

    def loss(w):
        s = ((z - model.centre) / model.scale) @ w
        return sum(np.log1p(np.exp(-(s[i] - s[j]))) for i, j in zip(better, worse, strict=True)) + quality.RIDGE * len(better) / 2 * (w @ w)

    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert abs(loss(model.weights + step) - loss(model.weights - step)) / 2e-4 < 1e-3


def test_ranked_marks_the_quantile(spark):
    docs, labels = fixture(spark)
    model = quality.train(docs, labels)
    assert abs(model.rejected - 1 / 3) < 1e-9
    rows = quality.ranked(docs, model).collect()
    assert {r.doc_id for r in rows if r.above} >= {i for i in range(120) if i % 3} and sum(not r.above for r in rows) <= 40
