"""Language identification of documents that mix languages.

Every language has a table of n-gram log-likelihoods (byte trigrams of lower-cased words, hashed). A word's likelihood
under a language is the product of its trigrams'. Expectation-maximisation estimates each document's language
proportions from its words; the set of languages is the one with the highest likelihood less a penalty for each
language after the first (half the logarithm of the number of words). The predicted language has the largest
proportion in that set.

Texts that are null or have no letter get `und`, score 0 and an empty mixture. Ties go to the language first in order. Texts of any length count whole.
Rows with a null id or language are not learned from, but predicted like any other; repeated rows count each time in learning and are predicted alike. An empty
table gives no rows, a table without languages `und` for all. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import in_chunks, map_texts, mix64, runs, utf8

#: Bits of a slot of the hashed trigram tables, and documents of a language that they are learned from at most (taken by a hash of the id).
SLOT_BITS, MAX_DOCS = 18, 4_000
#: All languages are learned. Their tables together have so many entries at most: beyond 64 languages there are fewer slots for each, down to LEAST_BITS.
TABLE_BITS, LEAST_BITS = 24, 12
#: Languages up to which the list of them is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Rounds of expectation-maximisation; neighbouring trigrams overlap, so their evidence counts for less.
STEPS, TEMPER = 12, 0.7

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_any_letter = regex.compile(r"\p{L}").search


def slot_bits(n_languages: int) -> int:
    """Bits of a slot, so that the tables of so many languages stay small enough for every task to hold."""
    return max(LEAST_BITS, min(SLOT_BITS, TABLE_BITS - (max(n_languages, 1) - 1).bit_length()))


def trigrams(texts: list[str | None], bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each letter byte's trigram, where each word's bytes begin among them, document of each word, words of each document)."""
    data, ends = utf8([t.lower() if t else t for t in texts])
    letter = _LETTER[data]
    begins, stops = runs(letter, ends[:-1])
    n = len(texts)
    if not len(begins):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(n, dtype=np.int64)
    kept = np.where(letter, data, 0).astype(np.uint32)
    before, after = np.roll(kept, 1), np.roll(kept, -1)
    before[begins] = 32
    after[stops - 1] = 32
    code = ((before << np.uint32(16)) | (kept << np.uint32(8)) | after)[letter]
    slot = (mix64(code.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    doc = np.searchsorted(ends, begins, side="right") - 1
    return slot, np.cumsum(stops - begins) - (stops - begins), doc, np.bincount(doc, minlength=n)


@dataclass
class Languages:
    """Names, and log-likelihoods of trigram slots: a row for each slot, a column for each language."""

    names: list[str]
    table: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DOCS) -> Languages:
    """The tables of all languages that `docs` names; rows without a language or id are left out.

    Of a language with more than `most` documents, about `most` are taken. Trigrams are counted on the executors; the
    driver gets a row for each language and one for each entry of the tables that is not empty (2 ** TABLE_BITS at most, up to 4,096 languages).
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()
    bits, names = slot_bits(len(sizes)), [r["lang"] for r in sizes]
    slots = 1 << bits
    if not sizes:
        return Languages([], np.zeros((slots, 0), dtype=np.float32))
    shares = docs.sparkSession.createDataFrame([(r["lang"], i, min(1.0, most / r["count"])) for i, r in enumerate(sizes)], "lang string, number int, share double")
    part = F.xxhash64(F.col("id"), F.lit("lang")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    named = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shares = F.broadcast(shares) if len(sizes) <= MOST_BROADCAST else shares
    sample = named.join(shares, "lang").where(part < F.col("share"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            numbers, texts = batch.column("number").to_numpy(), batch.column("text").to_pylist()
            for number in np.unique(numbers):
                own = [texts[i] for i in np.flatnonzero(numbers == number)]
                counts = np.zeros(slots, dtype=np.int64)
                for a, b in in_chunks(own, 2_000_000):
                    counts += np.bincount(trigrams(own[a:b], bits)[0], minlength=slots)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number), pa.int32()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["number", "slot", "n"])

    counts = sample.select("number", "text").mapInArrow(run, "number int, slot int, n long").groupBy("number", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((slots, len(names)), 0.05, dtype=np.float32)
    table[counts["slot"].to_numpy(), counts["number"].to_numpy()] += counts["n"].to_numpy()
    return Languages(names, np.log(table / np.maximum(table.sum(0, dtype=np.float64), 1)).astype(np.float32))


def em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by document and language, log-likelihood by document). like: by word, scaled so that its best language has 1."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    for _ in range(STEPS):
        mixed = like * share[doc]
        total = np.maximum(mixed.sum(1), 1e-30)
        share = np.add.reduceat(mixed / total[:, None], first, axis=0) / size[:, None]
    return share, np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(1), 1e-30)), first)


def mixtures(texts: list[str | None], model: Languages) -> np.ndarray:
    """A row of language proportions for each text; all zero where a text has no letter."""
    n, k = len(texts), len(model.names)
    out = np.zeros((n, k))
    slot, first_byte, doc, n_words = trigrams(texts, model.bits)
    if not len(slot) or not k:
        return out
    log = np.add.reduceat(model.table[slot], first_byte, axis=0).astype(np.float64) * TEMPER
    top = log.max(1)
    like = np.exp(np.maximum(log - top[:, None], -50))
    rows = np.flatnonzero(n_words)
    size = n_words[rows]
    first = np.cumsum(size) - size
    at = np.repeat(np.arange(len(rows)), size)
    single = np.add.reduceat(np.maximum(log - top[:, None], -50), first, axis=0)  # log-likelihoods of one language alone
    best = single.argmax(1)
    chosen = np.zeros((len(rows), k))
    chosen[np.arange(len(rows)), best] = 1
    value = single[np.arange(len(rows)), best]
    penalty = 0.5 * np.log(size + 1) + 2
    # No mixture has a likelihood above 1 for a word, that is, a logarithm above 0: where a second language can't pay its penalty, one stays.
    open_ = np.flatnonzero(value + penalty < 0)
    if len(open_) and k > 1:
        pick = np.isin(at, open_)
        own, own_size = like[pick], size[open_]
        own_first = np.cumsum(own_size) - own_size
        own_at = np.repeat(np.arange(len(open_)), own_size)
        full, _ = em(own, own_at, own_first, own_size, np.ones((len(open_), k)))
        order = np.argsort(-full, axis=1, kind="stable")
        for m in range(2, k + 1):
            # A set of m pays at most its likelihood of 0 less m - 1 penalties: documents that are better off already are done. The others' words meet their m languages only.
            left = np.flatnonzero(-(m - 1) * penalty[open_] > value[open_])
            if not len(left):
                break
            mine = np.isin(own_at, left)
            local = np.searchsorted(left, own_at[mine])
            own_left = own_size[left]
            like_m = np.take_along_axis(own[mine], order[left, :m][local], axis=1)
            share, total = em(like_m, local, np.cumsum(own_left) - own_left, own_left, np.ones((len(left), m)))
            now = open_[left]
            paid = total - (m - 1) * penalty[now]
            better = paid > value[now]
            value[now] = np.where(better, paid, value[now])
            spread = np.zeros((len(left), k))
            np.put_along_axis(spread, order[left, :m], share, axis=1)
            chosen[now] = np.where(better[:, None], spread, chosen[now])
    out[rows] = chosen
    return out


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages array<string>, proportions array<double>) of every row; the set is ordered by proportion."""

    def work():
        def columns(texts):
            share = mixtures(texts, model)
            order = np.argsort(-share, axis=1, kind="stable")
            some = [share[i].any() and bool(_any_letter(t)) for i, t in enumerate(texts)]
            sets = [[j for j in order[i] if share[i, j] > 0] if some[i] else [] for i in range(len(texts))]
            return {
                "lang_pred": [model.names[s[0]] if s else "und" for s in sets],
                "score": [float(min(1.0, share[i, s[0]])) if s else 0.0 for i, s in enumerate(sets)],
                "languages": [[model.names[j] for j in s] for s in sets],
                "proportions": [[float(share[i, j]) for j in s] for i, s in enumerate(sets)],
            }

        return columns

    return map_texts(docs, work, "lang_pred string, score double, languages array<string>, proportions array<double>", id_col, text_col, 2_000_000)
