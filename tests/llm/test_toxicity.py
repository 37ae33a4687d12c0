import itertools
import random
import re

import numpy as np

from tallyweave.llm import toxicity
from tallyweave.llm.common import held_out

PLAIN = "river stone meadow winter garden letter window candle harbour kitchen lantern village thunder silver morning you and go away that such again thing".split()
INSULTS = ["gromble", "snarfwit", "dulloaf"]


def fixture(spark, n=240):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choice(PLAIN) for _ in range(8)) + "." for _ in range(4)]
        if i % 4 == 0:
            sentences[r.randrange(4)] = f"you {r.choice(INSULTS)} and {r.choice(INSULTS)} go away."
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def slow_kernel(s, t):
    """The kernel by listing all subsequences."""
    value = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.ORDER):
        for b in itertools.combinations(range(len(t)), toxicity.ORDER):
            if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                value += toxicity.LAMBDA ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return value


def test_kernel_equals_its_definition():
    r = random.Random(1)
    words = [np.array([r.randrange(97, 101) for _ in range(r.randrange(3, 9))], dtype=np.uint16) for _ in range(30)]
    s, t = toxicity.padded(words[:15], 65535), toxicity.padded(words[15:], 0)
    assert np.allclose(toxicity.kernel(s, t), [slow_kernel(a, b) for a, b in zip(words[:15], words[15:], strict=True)], rtol=1e-4)


def slow_value(s, t):
    return slow_kernel(s, t) / (slow_kernel(s, s) * slow_kernel(t, t)) ** 0.5


def test_landmark_values_equal_the_definition_and_the_letter_bound_drops_none():
    r = random.Random(2)
    marks = ["gromble", "snarfwit", "idiot", "moron"]
    words = [m for m in marks] + ["".join(r.choice(list(m) + ["x", "e"]) for _ in range(r.randrange(2, 9))) for m in marks for _ in range(25)] + [m[:k] + c + m[k:] for m in marks for k in range(len(m)) for c in "z."]
    own, theirs = [toxicity.marked(m) for m in marks], [toxicity.marked(w) for w in words]
    want = np.array([[slow_value(w, m) for m in own] for w in theirs])
    got = toxicity.Landmarks(own).of(theirs)
    assert np.allclose(got, np.where(want >= toxicity.FLOOR, want, 0), atol=1e-4) or np.abs(want[np.abs(got - np.where(want >= toxicity.FLOOR, want, 0)) > 1e-4] - toxicity.FLOOR).max() < 1e-4
    assert np.allclose(toxicity.gram(own), [[slow_value(a, b) for b in own] for a in own], atol=1e-4)


def test_scores_equal_the_definition(spark):
    """Sentences and words by plain loops, margins and curve as the machine holds them."""
    docs, labels = fixture(spark, 80)
    machine = toxicity.train(docs, labels)
    texts = ["you gromble go away. the river stone.", "such grommble again!\nsnarfwit and snarfwit", "the river stone meadow", ""]
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine).collect()}

    def value(word):
        raw = np.array([slow_value(toxicity.marked(word), m) for m in machine.landmarks])
        return np.where(raw >= toxicity.FLOOR, raw, 0)

    def strongest(rows):
        margins = sorted((float(x @ machine.whiten @ machine.weights + machine.bias) for x in rows), reverse=True)
        return (margins + [machine.bias] * 3)[:3] + [np.log1p(sum(max(x - machine.bias, 0) for x in margins))]

    for i, text in enumerate(texts):
        seen, sums, words = set(), [], []
        for sentence in re.split(r"(?<=[.!?])\s|\n", text):
            total = np.zeros(len(machine.landmarks))
            for word in re.findall(r"\w+", sentence.lower()):
                if word not in seen and value(word).any():
                    total += value(word)
                    words.append(value(word))
                seen.add(word)
            sums.append(total)
        row = np.array(strongest(sums if text else []) + strongest(words))
        assert abs(got[i] - 1 / (1 + np.exp(-(row @ machine.curve + machine.offset)))) < 1e-3


def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels.where(~held_out("doc_id", 4, 2)))
    rows = toxicity.scores(docs.join(labels.where(held_out("doc_id", 4, 2)), "doc_id", "left_semi"), machine).join(labels, "doc_id").collect()
    toxic, clean = [r.score >= 0.3 for r in rows if r.toxic == 1], [r.score >= 0.3 for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.88 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_catches_plain_gapped_and_inserted(spark):
    docs, labels = fixture(spark)
    machine = toxicity.train(docs, labels)
    assert {w.tobytes().decode("utf-16-le")[1:-1] for w in machine.landmarks} >= set(INSULTS)
    scored = {r.doc_id: r.score for r in toxicity.scores(docs, machine).collect()}
    assert all((scored[i] >= 0.3) == (i % 4 == 0) for i in scored)
    odd = ["that g.r.o.m.b.l.e, grommble thing", "such a snarrfwit, snarf-wit", "that g r o m b l e again, snarfwit", "the river stone meadow", None, "", " \n ", "x" * 5000, "gromble " * 20_000]
    rows = {r.doc_id: r for r in toxicity.scores(spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)] + [(None, "gromble", 1)], "doc_id long, text string, score int"), machine).collect()}
    assert [rows[i].score >= 0.3 for i in range(9)] == [True, True, True, False, False, False, False, False, True]
    assert rows[None].score >= 0.3 and all(0 <= r.score <= 1 for r in rows.values())


def test_nothing_to_learn_from(spark):
    docs, labels = fixture(spark, 8)
    rows = toxicity.scores(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()
    assert len(rows) == 8 and len({r.score for r in rows}) == 1
    assert toxicity.scores(docs.limit(0), toxicity.train(docs, labels.limit(0))).collect() == []
