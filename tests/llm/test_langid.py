import math
import re

import numpy as np

from tallyweave.llm import langid
from tallyweave.llm.common import held_out

WORDS = {"aa": "kala mina tolo rava suni", "bb": "schrumpf knacht pflicht dorf zwerg", "cc": "ñandu corazón señor año leña"}


def corpus(spark):
    rows = []
    for k, (lang, words) in enumerate(WORDS.items()):
        w = words.split()
        rows += [(k * 100 + i, " ".join(w[(i * j + j) % 5] for j in range(1, 30)), lang) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_and_mixtures(spark):
    docs = corpus(spark)
    model = langid.train(docs)
    assert model.names == ["aa", "bb", "cc"]
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred and r.languages == [r.lang] for r in rows)
    mixed = " ".join([WORDS["aa"]] * 6 + [WORDS["bb"]] * 4)
    (r,) = langid.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert r.lang_pred == "aa" and r.languages == ["aa", "bb"] and abs(r.score - 0.6) < 0.05
    assert abs(sum(r.proportions) - 1) < 1e-6


def test_edge_rows(spark):
    model = langid.train(corpus(spark))
    texts = [None, "", " \n", "123 !? 456", "kala", WORDS["bb"] * 5000, "kala", "\U0001f642"]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(None, "kala", 0.5, "x")], "doc_id long, text string, score double, lang_pred string")
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(8)] == ["und"] * 4 + ["aa", "bb", "aa", "und"]
    assert rows[0].score == 0 and rows[0].languages == [] and rows[None].lang_pred == "aa"
    assert langid.predict(docs.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "kala", None)], "doc_id long, text string, lang string")
    (r,) = langid.predict(docs, langid.train(docs)).collect()
    assert r.lang_pred == "und" and r.score == 0


def plain_mixture(text, model):
    """The definition by loops: words' likelihoods, expectation-maximisation of the chosen set, the set by penalised likelihood."""
    k = len(model.names)
    words = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())
    logs = []
    for w in words:
        padded = b" " + w + b" "
        slots = [langid.mix64(np.array([padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]], dtype=np.uint64))[0] >> np.uint64(46) for i in range(len(w))]
        logs.append([langid.TEMPER * sum(float(model.table[int(s), j]) for s in slots) for j in range(k)])
    like = [[math.exp(max(x - max(row), -50)) for x in row] for row in logs]

    def em(members):
        share = [1 / len(members) if j in members else 0.0 for j in range(k)]
        for _ in range(langid.STEPS):
            new = [0.0] * k
            for row in like:
                total = sum(p * x for p, x in zip(share, row, strict=True))
                for j in range(k):
                    new[j] += share[j] * row[j] / total / len(like)
            share = new
        return share, sum(math.log(sum(p * x for p, x in zip(share, row, strict=True))) for row in like)

    penalty = 0.5 * math.log(len(words) + 1) + 2
    full, _ = em(range(k))
    order = sorted(range(k), key=lambda j: -full[j])
    alone = [sum(max(row[j] - max(row), -50) for row in logs) for j in range(k)]
    best = max(range(k), key=lambda j: alone[j])
    chosen, value = [float(j == best) for j in range(k)], alone[best]
    for m in range(2, k + 1):
        share, total = em(order[:m])
        if total - (m - 1) * penalty > value:
            chosen, value = share, total - (m - 1) * penalty
    return chosen


def test_mixtures_equal_the_definition(spark):
    model = langid.train(corpus(spark))
    texts = [WORDS["aa"], " ".join([WORDS["aa"]] * 6 + [WORDS["bb"]] * 4), " ".join([WORDS["cc"]] * 3 + [WORDS["bb"]] * 3 + [WORDS["aa"]] * 3), "kala dorf", "unseen words only here"]
    got = langid.mixtures(texts, model)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain_mixture(t, model), atol=1e-4), t


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    rows = langid.predict(docs.where(held_out("doc_id", 4, 2)), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 0


def test_every_language_is_learned(spark):
    assert [langid.slot_bits(k) for k in (0, 1, 4, 64, 65, 128, 4_096, 10_000)] == [18, 18, 18, 18, 17, 17, 12, 12]
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:03d}" for i in range(230)]
    words = {n: [letters[i % 26] * 2 + letters[(i // 26) % 26] + letters[(i * 7 + j) % 26] + letters[(i * 3 + j * 5) % 26] for j in range(6)] for i, n in enumerate(names)}
    docs = spark.createDataFrame([(k, " ".join(words[n] * 3), n) for k, n in enumerate(names)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.names == names and model.table.shape == (1 << 16, 230)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 225
