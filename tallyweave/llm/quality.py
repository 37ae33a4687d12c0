"""Quality scores by Bradley-Terry ranking: document scores learned from preference pairs.

A pair prefers a document labelled 1 over one labelled 0; the logistic loss of the difference of their features gives the
weights of a linear score (Newton's method with a ridge). A logistic curve fitted on the same labelled rows turns scores
into the likelihood of label 1. Documents are thresholded at a quantile of the score, or at a fixed likelihood.

Features come from whole texts: shares of character kinds, of repeated words and lines, word lengths, size, and the shares of words
that hash to each of SLOTS slots, whose weights are learned alone.
Null and empty texts have the features of a text without words and are scored like any other. Texts of any length count whole. Rows
with a null id are scored, never learned from; repeated rows score alike. Ties of score are on the same side of the quantile, at or above it. An empty table gives no rows, no
labels (or one kind of them) the same score for all; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import map_texts, materialize, per_doc, runs, span_hashes, utf8, words

#: Labelled rows that a model is fitted on at most (taken by a hash of the id), and pairs for each row of the rarer label.
MAX_LABELLED, PAIRS_EACH = 20_000, 8
#: Labelled rows up to which their ids are broadcast; more (only a larger `most` gives them) are joined by a shuffle.
MOST_BROADCAST = 100_000
RIDGE = 1e-2

#: Slots that words are hashed to; the share of a document's words in each slot is a feature whose weight is learned.
SLOTS = 64
SHARES = ["upper", "digit", "symbol", "punct", "non_ascii", "newline", "same_as_last", "repeated_words", "repeated_lines", "word_length", "long_words", "symbol_ends", "log_words", "no_words", "capital_words"]
FEATURES = [*SHARES, *(f"slot_{k}" for k in range(SLOTS))]
_KIND = np.zeros((256, 6), dtype=np.float32)
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\/"], 2] = 1
_KIND[[ord(c) for c in "!.,;:?-\"'()"], 3] = 1
_KIND[128:, 4] = 1
_KIND[10, 5] = 1


def repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """By document: how many of its keys are not the first of their kind there."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, owner))
    again = np.zeros(len(keys), dtype=bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return per_doc(again, owner[order], n)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, ends = utf8(texts)
    n, size = len(texts), np.maximum(np.diff(ends), 1)
    out = np.zeros((n, len(FEATURES)))
    if len(data):
        owner = np.repeat(np.arange(n), np.diff(ends))
        for k in range(6):
            out[:, k] = per_doc(_KIND[data, k], owner, n) / size
        begins, stops, doc = words(data, ends)
        hashes = span_hashes(data, begins, stops)
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        length = stops - begins
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        out[:, 6] = per_doc(same, doc, n) / count
        out[:, 7] = repeats(hashes, doc, n) / count
        at, to = runs(data != 10, ends[:-1])
        line_doc = np.searchsorted(ends, at, side="right") - 1
        out[:, 8] = repeats(span_hashes(data, at, to), line_doc, n) / np.maximum(np.bincount(line_doc, minlength=n), 1)
        out[:, 9] = per_doc(length, doc, n) / count / 10
        out[:, 10] = per_doc(length > 15, doc, n) / count
        out[:, 11] = per_doc(_KIND[data[stops - 1], 2] if len(stops) else np.zeros(0), doc, n) / count
        out[:, 12] = np.log1p(np.bincount(doc, minlength=n)) / 10
        out[:, 13] = np.bincount(doc, minlength=n) == 0
        out[:, 14] = per_doc(_KIND[data[begins], 0] if len(begins) else np.zeros(0), doc, n) / count
        slot = (hashes >> np.uint64(58)).astype(np.int64)
        out[:, len(SHARES) :] = np.bincount(doc * SLOTS + slot, minlength=n * SLOTS).reshape(n, SLOTS) / count[:, None]
    else:
        out[:, 13] = 1
    return out


@dataclass
class Ranking:
    """Weights of the features, and the curve from scores to likelihoods: 1 / (1 + exp(-(slope * score + offset)))."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float
    #: The share of the labelled documents that have label 0.
    rejected: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale * self.weights).sum(1)  # row by row, so that equal rows score alike

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.offset, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of the logistic loss of y (0 or 1) on x; the ridge keeps them finite where classes part cleanly."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, weight: np.ndarray | None = None) -> Ranking:
    """The ranking of labelled rows; `weight` tells how many rows each stands for. Without both labels nothing can be compared: all weights are 0, likelihoods the labels' mean."""
    centre, scale = (x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = (x - centre) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weight = np.ones(len(y)) if weight is None else weight
    prior = ((weight * y).sum() + 1) / (weight.sum() + 2)
    rejected = float(weight[y == 0].sum() / max(weight.sum(), 1e-9))
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1]), centre, scale, 0.0, float(np.log(prior / (1 - prior))), rejected)
    rng = np.random.default_rng(seed)
    rare, other = (good, bad) if len(good) < len(bad) else (bad, good)
    a, b = np.repeat(rare, PAIRS_EACH), rng.choice(other, len(rare) * PAIRS_EACH)
    better, worse = (a, b) if rare is good else (b, a)
    diff = z[better] - z[worse]
    w = newton(diff, np.ones(len(diff)), RIDGE * len(diff), np.ones(len(diff)))
    s = z @ w
    slope, offset = newton(np.stack([s, np.ones(len(s))], 1), y.astype(float), 1e-3, weight)
    return Ranking(w, centre, scale, float(slope), float(offset), rejected)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """((id, text, label) of at most about `most` labelled documents, half of each label 1 and not, chosen by a hash of the id alone; how many
    labelled documents each one taken stands for, by label). Null ids and labels are left out; of an id with several labels the largest counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) == 1).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {y: min(1.0, most / 2 / n) for y, n in sizes.items()}
    part = (F.xxhash64(F.col(id_col), F.lit("sample")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    taken = known.where(part < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    # About `most` rows: broadcast once they are counted, so that no text is shuffled, and the texts taken are written for all that is learned from them.
    taken = F.broadcast(taken) if taken.count() <= MOST_BROADCAST else taken
    sample = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(taken, id_col)
    return materialize(sample, "labelled"), {y: 1 / x for y, x in share.items()}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Ranking:
    """A Ranking fitted on labelled documents; only their features (a bounded number of rows) reach the driver."""
    sample, each = labelled_sample(docs, labels, label_col, id_col, text_col, most)

    def work():
        return lambda texts: {"x": features(texts).tolist()}

    rows = map_texts(sample.select(F.col("label").cast("int"), "text"), work, "x array<double>", "label", "text", 1_000_000).toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(rows["x"].to_list()), rows["label"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same model however Spark deals the rows
    return fit(x[order], y[order], weight=np.array([each[v] for v in y[order].tolist()]))


def scores(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank_score, score) of every row: the linear Bradley-Terry score, and the likelihood of label 1."""

    def work():
        def score(texts):
            x = features(texts)
            return {"rank_score": model.score(x), "score": model.likelihood(x)}

        return score

    return map_texts(docs, work, "rank_score double, score double", id_col, text_col, 1_000_000)


def quantile_cut(scored: DataFrame, quantile: float, by: str = "rank_score", accuracy: int = 10_000) -> float | None:
    """The given quantile of all scores (a mergeable summary; nothing is collected but one number); None of no rows."""
    return scored.select(F.percentile_approx(by, quantile, accuracy).alias("cut")).first()["cut"]


def above_quantile(scored: DataFrame, quantile: float, by: str = "rank_score", accuracy: int = 10_000) -> DataFrame:
    """The rows whose score reaches the given quantile of all scores."""
    cut = quantile_cut(scored, quantile, by, accuracy)
    return scored if cut is None else scored.where(F.col(by) >= cut)


def ranked(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text", quantile: float | None = None) -> DataFrame:
    """(id, rank_score, score, above) of every row; above: the score reaches the quantile, by default the share of label 0 among the labels fitted on."""
    scored = materialize(scores(docs, model, id_col, text_col), "scores")
    cut = quantile_cut(scored, model.rejected if quantile is None else quantile)
    return scored.withColumn("above", F.col("rank_score") >= F.lit(cut if cut is not None else 0.0))
