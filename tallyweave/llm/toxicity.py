"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over their common subsequences of ORDER characters, LAMBDA to the length that each spans;
gaps and inserted characters lower it a little and never break it. Landmarks are words that tell toxic training documents
from clean ones and are unlike each other. A sentence is represented by the sums of its words' kernel values with the
landmarks (each word once in a document), whitened by the landmarks' own kernel matrix (Nyström), and a linear squared-hinge machine is trained on
sentences: all those of clean documents against the most toxic sentence of each toxic one, chosen anew in each round. A
logistic curve turns the margins of a document's most toxic sentences, and of its most toxic words as sentences of their own, into the
likelihood of label 1; to miss a toxic document counts as MISSED false alarms.

Values of the kernel under FLOOR count as 0, which keeps the many words that are a little like a landmark from adding up. So the features are an
empirical kernel map; the landmarks' own matrix, which whitens them, is exact. Words that hold less than LETTERS of a landmark's characters are not
compared with it: their value is under FLOOR (tested).

Null, empty and blank texts have no sentence and score as the zero vector. Texts of any length count whole. Tokens longer than WINDOW are covered by
overlapping windows; runs of single characters ("i d i o t") are also read as one word. Rows with a null id are scored, never learned from;
repeated rows score alike. Ties (sentences or landmarks alike) go to the first in order. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import INVERSE, MULTIPLIER, map_texts, mix64, powers, runs
from tallyweave.llm.quality import labelled_sample, newton

ORDER, LAMBDA = 3, 0.6
LANDMARKS, CANDIDATES, UNLIKE = 48, 800, 0.7
#: Normalized kernel values under FLOOR count as 0; so do words that hold less than LETTERS of a landmark's characters.
FLOOR, LETTERS = 0.5, 0.6
#: Labelled documents a model is fitted on at most (half of each label), rounds of choosing sentences, false alarms that a miss is worth.
MAX_LABELLED, ROUNDS, MISSED = 4_000, 4, 3.0
#: Sentences of a labelled document that are learned from at most, those most like landmarks; so what reaches the driver is bounded by MAX_LABELLED of them.
SENTENCES = 1_000
WINDOW, STRIDE = 32, 16
_BEGIN, _END = 1, 2  # mark a word's ends; no text has them within words
_ALNUM = np.ones(65536, dtype=bool)
_ALNUM[:256] = [chr(c).isalnum() for c in range(256)]
_ALNUM[0x2000:0x2070] = _ALNUM[0x3000:0x3005] = False
_CODES = mix64(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The raw kernel of each word s[i] with the word t[i]; rows of UTF-16 units, padded with 65535 and 0."""
    width = t.shape[1]
    lag = np.arange(width)[None, :] - np.arange(width)[:, None]
    decay = np.where(lag >= 0, np.float32(LAMBDA) ** np.maximum(lag, 0), 0).astype(np.float32)
    prefix = [np.zeros(t.shape, dtype=np.float32) for _ in range(ORDER - 1)]  # weights of common subsequences of 1, 2 ... that end before here
    total = np.zeros(t.shape, dtype=np.float32)
    term = np.zeros(t.shape, dtype=np.float32)
    square = np.float32(LAMBDA * LAMBDA)
    for x in range(s.shape[1]):
        match = (t == s[:, x, None]) * square
        total[:, 1:] += match[:, 1:] * prefix[-1][:, :-1]
        for i in range(ORDER - 2, -1, -1):
            if i:
                np.multiply(match[:, 1:], prefix[i - 1][:, :-1], out=term[:, 1:])
            prefix[i] *= np.float32(LAMBDA)
            prefix[i] += (term if i else match) @ decay
    return total.sum(1)


def padded(words: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(words), max(map(len, words), default=1)), fill, dtype=np.uint16)
    for i, w in enumerate(words):
        out[i, : len(w)] = w
    return out


def letters(codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How often each row holds each class of characters (the low six bits of the code)."""
    return np.bincount(row * 64 + (codes & 63), minlength=n * 64).reshape(n, 64).astype(np.int16)


class Landmarks:
    """Landmarks, ready for kernel values of many words."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.t = padded(words, 0)
        self.own = np.sqrt(np.maximum(kernel(padded(words, 65535), self.t), 1e-12)) if words else np.zeros(0, dtype=np.float32)
        self.letters = letters(np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words]), len(words)) if words else np.zeros((0, 64), dtype=np.int16)

    def values(self, s: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Normalized kernel values of words (rows of `s`, `size` units each) with the landmarks; those under FLOOR are 0.

        A word that holds less than LETTERS of a landmark's characters, in any order, has the value 0 with it. Gaps and
        inserted characters take none away.
        """
        out = np.zeros((len(s), len(self.words)), dtype=np.float32)
        if not len(s) or not self.words:
            return out
        inside = np.arange(s.shape[1])[None, :] < size[:, None]
        held = letters(s[inside].astype(np.int64), np.repeat(np.arange(len(s)), size), len(s))
        word, mark = [], []
        for j, need in enumerate(self.letters):
            some = np.flatnonzero(need)
            enough = np.flatnonzero(np.minimum(held[:, some], need[some]).sum(1) >= LETTERS * need.sum())
            word.append(enough)
            mark.append(np.full(len(enough), j))
        word, mark = np.concatenate(word), np.concatenate(mark)
        if not len(word):
            return out
        wanted, at = np.unique(word, return_inverse=True)
        own = np.empty(len(wanted), dtype=np.float32)
        for rows in self._groups(size[wanted], 4096):
            most = size[wanted[rows]].max()
            t = s[wanted[rows], :most]
            own[rows] = np.sqrt(np.maximum(kernel(t, np.where(t == 65535, 0, t)), 1e-12))
        for rows in self._groups(size[word], 8192):
            most = size[word[rows]].max()
            value = kernel(s[word[rows], :most], self.t[mark[rows]]) / (own[at[rows]] * self.own[mark[rows]])
            out[word[rows], mark[rows]] = np.where(value >= FLOOR, value, 0)
        return out

    @staticmethod
    def _groups(size: np.ndarray, most: int):
        """Runs of rows of alike size."""
        order = np.argsort(size, kind="stable")
        return (order[i : i + most] for i in range(0, len(order), most))

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        return self.values(padded(words, 65535), np.array([len(w) for w in words], dtype=np.int64))


def marked(word: str) -> np.ndarray:
    return np.concatenate([[_BEGIN], np.frombuffer(word.lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16), [_END]]).astype(np.uint16)


def instances(texts: list[str | None]):
    """The batch's words as (units, spans, sentence of each word, document of each sentence).

    units: all texts' UTF-16 units without those that are no letter or digit (so "i.d.i.o.t" is one plain word); spans: rows (begin, end, starts a word, ends a word). Words of one character in a row
    become one more word, given apart as arrays with their sentences: the last value.
    """
    units = [np.frombuffer(t.lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16) if t else np.zeros(0, dtype=np.uint16) for t in texts]
    ends = np.zeros(len(units) + 1, dtype=np.int64)
    np.cumsum([len(u) for u in units], out=ends[1:])
    data = np.concatenate(units) if units else np.zeros(0, dtype=np.uint16)
    begins, stops = runs((data > 32) & (data != 160) & (data != 0x3000), ends[:-1])
    doc = np.searchsorted(ends, begins, side="right") - 1
    if not len(begins):
        return data, np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    last = data[stops - 1]
    newline = data[np.minimum(stops, len(data) - 1)] == 10
    closes = (last == ord(".")) | (last == ord("!")) | (last == ord("?")) | newline
    closes |= np.append(doc[1:] != doc[:-1], True)
    sentence = np.cumsum(closes) - closes
    doc_of = doc[closes]
    kept = _ALNUM[data]
    at = np.concatenate([[0], np.cumsum(kept)])
    data, begins, stops = data[kept], at[begins], at[stops]
    some = stops > begins
    begins, stops, sentence, doc = begins[some], stops[some], sentence[some], doc[some]
    if not len(begins):
        return data, np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64), doc_of, []
    single = stops - begins == 1
    spelled = []
    at, to = runs(single, np.flatnonzero(np.append(True, doc[1:] != doc[:-1])))
    for a, b in zip(at[to - at >= 4], to[to - at >= 4], strict=True):
        letters = data[begins[a:b]]
        for k in range(0, max(1, len(letters) - WINDOW + STRIDE), STRIDE):
            spelled.append((np.concatenate([[_BEGIN], letters[k : k + WINDOW], [_END]]).astype(np.uint16), sentence[a]))
    long = stops - begins > WINDOW
    spans = [np.stack([begins, stops, np.ones_like(begins), np.ones_like(begins)], 1)[~long]]
    owner = [sentence[~long]]
    for a, b, s in zip(begins[long], stops[long], sentence[long], strict=True):
        starts = np.arange(a, b - STRIDE, STRIDE)
        own = np.stack([starts, np.minimum(starts + WINDOW, b), starts == a, starts + WINDOW >= b], 1)
        spans.append(own)
        owner.append(np.full(len(own), s))
    return data, np.concatenate(spans).astype(np.int64), np.concatenate(owner), doc_of, spelled


@dataclass
class Machine:
    """Landmarks, their Nyström whitening, the hyperplane, and the curve from a document's margins to likelihoods."""

    landmarks: list[np.ndarray]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    offset: float

    def margins(self, sums: np.ndarray) -> np.ndarray:
        return (sums * (self.whiten @ self.weights)).sum(1) + self.bias  # row by row, so that equal rows score alike

    def rows(self, texts: list[str | None], marks: Landmarks) -> tuple[np.ndarray, np.ndarray]:
        """(what the curve reads of each document: margins of its sentences and of its words; the document of each sentence)."""
        sums, doc, words, word_doc = sentence_vectors(texts, marks)
        n = len(texts)
        return np.concatenate([by_document(self.margins(sums), doc, n, self.bias), by_document(self.margins(words), word_doc, n, self.bias)], 1), doc

    def likelihood(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((rows * self.curve).sum(1) + self.offset, -30, 30)))


def sentence_vectors(texts: list[str | None], marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(for each sentence, the sums of its words' kernel values with the landmarks; the sentence's document; the values of each word that is like a
    landmark, each once in a document; the word's document)."""
    data, spans, owner, doc_of, spelled = instances(texts)
    out = np.zeros((len(doc_of), len(marks.words)), dtype=np.float32)
    words, word_doc = [np.zeros((0, len(marks.words)), dtype=np.float32)], [np.zeros(0, dtype=np.int64)]
    if len(spans) and marks.words:
        size = spans[:, 1] - spans[:, 0] + spans[:, 2] + spans[:, 3]
        key = unit_hashes(data, spans)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        first_size = size[first]
        values = np.zeros((len(first), len(marks.words)), dtype=np.float32)
        order = np.argsort(first_size, kind="stable")
        for i in range(0, len(order), 50_000):
            rows = order[i : i + 50_000]
            some, own = spans[first[rows]], first_size[rows]
            place = np.arange(own.max())[None, :]
            at = some[:, :1] - some[:, 2:3] + place
            s = data[np.clip(at, 0, len(data) - 1)]
            s = np.where((place == 0) & (some[:, 2:3] == 1), _BEGIN, s)
            s = np.where((place == own[:, None] - 1) & (some[:, 3:4] == 1), _END, s)
            values[rows] = marks.values(np.where(place < own[:, None], s, 65535).astype(np.uint16), own)
        some = np.flatnonzero(values.any(1)[which])
        some = some[np.argsort(owner[some], kind="stable")]  # a word counts once in a document, in its first sentence
        some = some[np.unique(doc_of[owner[some]] * len(first) + which[some], return_index=True)[1]]
        np.add.at(out, owner[some], values[which[some]])
        words.append(values[which[some]])
        word_doc.append(doc_of[owner[some]])
    if spelled and marks.words:
        own, at = marks.of([w for w, _ in spelled]), np.array([s for _, s in spelled])
        np.add.at(out, at, own)
        words.append(own)
        word_doc.append(doc_of[at])
    return out, doc_of, np.concatenate(words), np.concatenate(word_doc)


def unit_hashes(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of UTF-16 units and of which ends of a word it holds."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[data] * powers("up", MULTIPLIER, max(len(data), 1)), out=sums[1:])
    length = (spans[:, 1] - spans[:, 0]) * 4 + spans[:, 2] * 2 + spans[:, 3]
    return mix64((sums[spans[:, 1]] - sums[spans[:, 0]]) * powers("down", INVERSE, len(data) + 1)[spans[:, 0]] + length.astype(np.uint64))


def by_document(margin: np.ndarray, doc: np.ndarray, n: int, empty: float) -> np.ndarray:
    """A row for each of n documents: its three highest sentence margins (`empty` where it has fewer) and a measure of their number."""
    out = np.full((n, 4), empty)
    order = np.lexsort((-margin, doc))
    doc, margin = doc[order], margin[order]
    nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
    for k in range(3):
        out[doc[nth == k], k] = margin[nth == k]
    out[:, 3] = np.log1p(np.bincount(doc, weights=np.maximum(margin - empty, 0), minlength=n))
    return out


def choose_landmarks(candidates: list[str], most: int = LANDMARKS) -> list[np.ndarray]:
    """Of the words, best first, those whose normalized kernel with all chosen before stays under UNLIKE, `most` at most."""
    words = [marked(c) for c in candidates]
    gram = Landmarks(words).of(words) if words else None
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < most and (not chosen or max(gram[i, chosen].max(), gram[chosen, i].max()) < UNLIKE):
            chosen.append(i)
    return [words[i] for i in chosen]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    """Weights (the last: the bias) of the linear machine with squared hinge loss; y is -1 or 1. Newton's method."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(steps):
        active = y * (z @ w) < 1
        za, ca = z[active], weight[active]
        new = np.linalg.solve((za * ca[:, None]).T @ za + np.diag(reg), za.T @ (ca * y[active]))
        done = np.abs(new - w).max() < 1e-6
        w = 0.5 * w + 0.5 * new if not done else new
        if done:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Machine:
    """A Machine fitted on labelled documents: of `most` at most, SENTENCES sentences of each reach the driver at most, as numbers (one for each landmark). Scoring reads all sentences."""
    sample, each = labelled_sample(docs, labels, label_col, id_col, text_col, most)
    words = sample.select("label", F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")))).alias("word")).where(F.length("word").between(3, 24))
    bags = sample.agg(F.sum(F.col("label").cast("long")).alias("bad"), F.count("*").alias("n")).first()
    bad, n = bags["bad"] or 0, bags["n"]
    if not bad or bad == n:
        return constant(float(np.log((bad + 1) / (n - bad + 1))))
    tally = words.groupBy("word").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n")).where(F.col("p") >= 3)
    # the excess of toxic documents over what chance would give, in standard deviations of that chance
    expected = F.col("n") * (bad / n)
    ranked = tally.withColumn("z", (F.col("p") - expected) / F.sqrt(expected + 1.0)).where("z > 3").orderBy(F.desc("z"), "word").limit(CANDIDATES).toPandas()
    landmarks = choose_landmarks(ranked["word"].to_list())
    m = len(landmarks)
    if not m:
        return constant(float(np.log(each[1] * bad / (each[0] * (n - bad)))))
    value, vector = np.linalg.eigh(gram(landmarks) + 0.1 * np.eye(m))
    whiten = vector @ np.diag(np.maximum(value, 0.05) ** -0.5) @ vector.T

    def work():
        marks = Landmarks(landmarks)

        def vectors(texts):
            sums, doc, _, _ = sentence_vectors(texts, marks)
            some = sums.any(1)
            plain = np.bincount(doc[~some], minlength=len(texts))
            return {"x": by_text(sums[some], doc[some], len(texts)), "plain": plain}

        return vectors

    def by_text(rows, doc, n):
        order = np.argsort(doc, kind="stable")
        own = np.split(rows[order], np.searchsorted(doc[order], np.arange(1, n)))
        return [(p if len(p) <= SENTENCES else p[np.sort(np.argsort(-p.sum(1), kind="stable")[:SENTENCES])]).tobytes() for p in own]

    # Sentences without any word like a landmark are all the same vector, zero: they are counted.
    bags = map_texts(sample.select("label", "text"), work, "x binary, plain long", "label", "text", 2_000_000).toPandas()
    matrix = lambda raw: np.frombuffer(raw, dtype=np.float32).reshape(-1, m).astype(np.float64)
    bags = [(int(y), matrix(x), int(z)) for y, x, z in zip(bags["label"], bags["x"], bags["plain"], strict=True)]
    bags.sort(key=lambda b: (b[0], len(b[1]), b[2], b[1].sum()))  # the same model however Spark deals the rows
    clean = np.concatenate([x for y, x, _ in bags if y != 1] + [np.zeros((1, m))])
    times = np.append(np.ones(len(clean) - 1), sum(z for y, _, z in bags if y != 1))
    toxic = [x if len(x) else np.zeros((1, m)) for y, x, _ in bags if y == 1]
    pick = [int(x.sum(1).argmax()) for x in toxic]
    w = np.zeros(m + 1)
    for _ in range(ROUNDS):
        positive = np.stack([x[i] for x, i in zip(toxic, pick, strict=True)])
        x = np.concatenate([positive, clean]) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(clean))])
        weight = np.concatenate([np.full(len(positive), 0.5 / len(positive)), 0.5 * times / max(times.sum(), 1)]) * (len(positive) + times.sum()) / 10
        w = squared_hinge(x, y, weight, 1.0)
        again = [int((b @ whiten @ w[:-1]).argmax()) for b in toxic]
        if again == pick:
            break
        pick = again
    machine = Machine(landmarks, whiten, w[:-1], float(w[-1]), np.zeros(8), 0.0)

    def look():
        marks = Landmarks(landmarks)
        return lambda texts: {"x": machine.rows(texts, marks)[0].tolist()}

    rows = map_texts(sample.select("label", "text"), look, "x array<double>", "label", "text", 2_000_000).toPandas()
    x, y = np.stack(rows["x"].to_list()), rows["label"].to_numpy()
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    curve = newton(np.concatenate([x, np.ones((len(x), 1))], 1), y.astype(float), 1e-2, np.where(y == 1, MISSED * each[1], each[0]))
    machine.curve, machine.offset = curve[:-1], float(curve[-1])
    return machine


def gram(words: list[np.ndarray]) -> np.ndarray:
    """The normalized kernel of each two words, exact."""
    t, n = padded(words, 0), len(words)
    i, j = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    raw = kernel(np.where(t == 0, 65535, t)[i], t[j]).reshape(n, n).astype(np.float64)
    own = np.sqrt(np.maximum(np.diag(raw), 1e-12))
    return (raw + raw.T) / 2 / own[:, None] / own[None, :]


def constant(offset: float) -> Machine:
    """Where there is nothing to tell the labels apart: the same likelihood for all."""
    return Machine([], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(8), offset)


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, margin, n_sentences) of every row: the likelihood of label 1, the most toxic sentence's margin, the number of sentences."""

    def work():
        marks = Landmarks(machine.landmarks)

        def score(texts):
            rows, doc = machine.rows(texts, marks)
            return {"score": machine.likelihood(rows), "margin": rows[:, 0], "n_sentences": np.bincount(doc, minlength=len(texts))}

        return score

    return map_texts(docs, work, "score double, margin double, n_sentences long", id_col, text_col, 2_000_000)
