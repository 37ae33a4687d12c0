import itertools
import random
import re

from tallyweave.llm import ngram_join
from tallyweave.llm.common import hot_keys, salted_join


def fixture():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(60)] for _ in range(12)]
    rows, i = [], 0
    for b in base:
        for _ in range(r.randrange(1, 9)):
            t = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "one two"), (i + 3, "One, two!"), (i + 4, "!!!"), (None, rows[0][1]), (0, rows[0][1]), (0, "another text with the same id as the first one"), (i + 5, "long " * 50_000)]
    return rows


def shingle_set(text):
    """All runs of five words (all words, where there are fewer), by the definition."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([k for k in range(len(rows)) if rows[k][0] is not None and sets[k]], 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((-1, -1, 0) if i is None else (i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def result(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in rows)


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    assert result(ngram_join.join(docs).collect()) == brute(rows)
    # groups cut into many blocks, and groups verified band by band, give the same
    assert result(ngram_join.join(docs, block=2).collect()) == brute(rows)
    assert result(ngram_join.join(docs, block=2, large=3).collect()) == brute(rows)


def test_hot_keys_are_dealt_over_tasks(spark):
    rows = [(i, "x" * 40 + " one text that very many rows share without a change") for i in range(3_000)] + [(i, f"text {i} a b c d e f") for i in range(3_000, 3_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(ngram_join.join(docs).collect())
    assert got == [(i, 0, 2_999) for i in range(3_000)] + [(i, i, 0) for i in range(3_000, 3_300)]
    counts = docs.groupBy("text").count()
    hot = hot_keys(counts.withColumnRenamed("text", "key"), "key", "count")
    assert [r["__parts"] for r in hot.collect()] == [910]
    joined = salted_join(docs.withColumnRenamed("text", "key"), counts.withColumnRenamed("text", "key"), "key", hot)
    assert joined.count() == 3_300 and joined.agg({"count": "sum"}).first()[0] == 3_000**2 + 300


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9999 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
