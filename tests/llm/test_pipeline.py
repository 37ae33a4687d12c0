import corpus_pipeline
from tallyweave.llm import mixing, ngram_join, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        assert after.columns == COLUMNS and 0 < after.count() <= before, name
        if name == "quality classifier":
            kept = {r.doc_id for r in after.select("doc_id").collect()}
            good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
            assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad) + 1
        if name == "n-gram Jaccard join":
            assert ngram_join.join(after).where("n_links > 0").count() == 0  # no two near duplicates are left
        if name == "suffix-array dedup":
            want = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs).collect()}
            got = {r.doc_id: r.text for r in after.collect()}
            assert all(got[i] == want[i].decode("utf-8", "ignore") for i in got)
            assert all(not w.strip() for i, w in want.items() if i not in got)
        if name.startswith("mixing"):
            fate = {r.doc_id for r in mixing.decide(docs).where("mix.kept").collect()}
            assert fate == {r.doc_id for r in after.collect()}
        docs, before = after, after.count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert final.count() == before and final.where("n_tokens <> size(ids)").count() == 0


def test_stages_take_odd_rows_and_columns(spark, sf_dir):
    good = "The quiet river ran past the old mill and the people of the town went home before the rain began to fall on the roofs and the gardens."
    rows = [(1, good, "en", "a", 5), (2, good + " Indeed.", None, None, None), (2, good + " Indeed.", "en", "a", 1), (None, good * 2, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (5, "Some other words stand here and nobody has said them before today. " * 800, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mix int, score int, kept int, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        assert set(ids) <= {1, 2, 3, 4, 5, None}, name
        if name == "n-gram Jaccard join":
            assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5] and None in ids
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, sf_dir).count() == len(rows) and last(spark, docs.limit(0), sf_dir).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf_dir):
    first = "The quiet river ran past the old mill and the people of the town went home before the rain began to fall on the roofs and the gardens."
    others = [" ".join(f"{w}{k}{n}" for n in range(30)) for k, w in enumerate(("stone", "lamp", "cloud"))]
    rows = [(1, first, "en", "a", 1), (2, others[0], "en", "a", 1), (2, first, "en", "a", 1), (3, others[1], "de", "b", 1), (3, others[2] + " " + first, "en", "a", 1), (3, others[1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for order in (rows, rows[::-1]):
        out = stages["n-gram Jaccard join"](spark, spark.createDataFrame(order, docs.schema), sf_dir)
        assert sorted((r.doc_id, r.text, r.lang) for r in out.collect()) == sorted([(1, first, "en"), (2, others[0], "en"), (3, others[1], "de"), (3, others[2] + " " + first, "en")])
    left = sorted((r.doc_id, r.text.strip()) for r in stages["suffix-array dedup"](spark, out, sf_dir).collect())
    assert left == sorted([(1, first), (2, others[0]), (3, others[1]), (3, others[2])])


def test_stages_take_a_very_long_text(spark, sf_dir):
    import random

    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    long = " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) for _ in range(150_000)) + "." * 5_001 + "0" * 3_003
    some = [" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(60)) for _ in range(20)]
    rows = [(1, long, "en", "a", len(long)), (2, long + " more", "en", "a", 1)] + [(10 + i, t, "en", "a", len(t)) for i, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in one.collect()) == [1, *range(10, 30)]
    cut = {r.doc_id: r.text for r in stages["suffix-array dedup"](spark, docs, sf_dir).collect()}
    assert cut[1] == long and cut.get(2, "").strip() in ("", "more", "re")
    assert stages["quality classifier"](spark, docs, sf_dir).count() <= len(rows) and stages["mixing sources to target weights"](spark, docs, sf_dir).count() <= len(rows)
    coded = {r.doc_id: r.n_tokens for r in stages["byte-level BPE"](spark, docs.where("doc_id = 1 OR doc_id > 20"), sf_dir).collect()}
    assert coded[1] > 150_000
