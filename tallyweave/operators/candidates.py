"""Which sheets of a workbook a task text is about: an inverted index of sheets' words, met by the words of the texts, and the best five for each text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.sheets import split, tokens
from tallyweave.sources.tables import SMALL, same, written

#: Sheets that only list tasks are no candidates.
LISTS = ("tasks and questions", "tasks", "questions")
#: Blocks of another sheet, and of the text's own, whose headers count; candidates of a text; words and headers that a candidate shows.
BLOCKS, OWN_BLOCKS, MOST, MATCHED, HEADERS = 10, 20, 5, 10, 6
#: Places that each entry of an index too large to be broadcast goes to, so that a word of many texts is spread over as many tasks.
SALTS = 16
#: Postings of texts that are scored at a time.
TOGETHER = 1_000_000
_TYPES = {"rank": T.IntegerType(), "number": T.LongType(), "score": T.IntegerType(), "block": T.IntegerType(), "hit": T.ArrayType(T.LongType()), "in_block": T.ArrayType(T.LongType())}
CANDIDATES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _TYPES.items()]))


#: A posting is one number: the sheet's number from bit SHEET_BIT on, the word's from WORD_BIT on, and below the word's places in the sheet,
#: bit b for the headers of block b and bit OWN_BLOCKS for the sheet's keywords.
SHEET_BIT, WORD_BIT = 49, OWN_BLOCKS + 1


def postings(keywords: DataFrame, headers: DataFrame) -> DataFrame:
    """(workbook, word, other, posting): the words of each sheet of keywords (workbook, sheet, word) and headers (workbook, sheet, block, place, name).

    Words and sheets are numbered within their workbook in order of their names. Sheets that only list tasks have headers only."""
    listed = F.lower("sheet").isin(*LISTS)
    of_sheet = keywords.where(~listed).select("workbook", F.col("sheet").alias("other"), "word", F.lit(1 << OWN_BLOCKS).alias("bit"))
    of_blocks = headers.where(F.col("block") < OWN_BLOCKS).select("workbook", F.col("sheet").alias("other"), F.explode(F.array_distinct(tokens("name"))).alias("word"), F.expr("shiftleft(1, CAST(block AS INT))").alias("bit"))
    placed = of_sheet.unionByName(of_blocks).groupBy("workbook", "other", "word").agg(F.bit_or("bit").cast("long").alias("places"))
    number = lambda c: (F.dense_rank().over(Window.partitionBy("workbook").orderBy(c)) - 1).cast("long")
    return placed.select("workbook", "word", "other", (F.shiftleft(number("other"), SHEET_BIT) + F.shiftleft(number("word"), WORD_BIT) + F.col("places")).alias("posting"))


def _met(words: DataFrame, index: DataFrame, little: bool) -> DataFrame:
    """words JOIN index USING (workbook, form): the index is broadcast while it is small, and salted beyond."""
    if little:
        return words.join(F.broadcast(index), ["workbook", "form"])
    salted = index.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return words.withColumn("__salt", F.pmod(F.xxhash64(*words.columns), F.lit(SALTS)).cast("int")).join(salted, ["workbook", "form", "__salt"]).drop("__salt")


def _number(posting: str = "posting") -> Column:
    """The number of a posting's word."""
    return F.shiftright(posting, WORD_BIT).bitwiseAND(F.lit((1 << (SHEET_BIT - WORD_BIT)) - 1))


def _rows(values: np.ndarray, owner: np.ndarray, n: int, null: np.ndarray | None = None) -> pa.Array:
    """Values as lists by their owners, of which there are n; owners ascend, and those in null have no list."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values), mask=None if null is None else pa.array(null))


def _best(postings: np.ndarray, text: np.ndarray, own: np.ndarray) -> pa.Array:
    """The candidates of each text by its postings, which ascend text by text; own has the number of each text's own sheet."""
    fresh = np.ones(len(postings), dtype=bool)
    fresh[1:] = (postings[1:] != postings[:-1]) | (text[1:] != text[:-1])
    postings, text = postings[fresh], text[fresh]
    sheet = postings >> SHEET_BIT
    begin = np.flatnonzero(np.concatenate([[True], (sheet[1:] != sheet[:-1]) | (text[1:] != text[:-1])])[: len(sheet)])
    length = np.diff(begin, append=len(postings))
    of, sheet = text[begin], sheet[begin]
    mine = sheet == own[of]
    hits, block = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), -1)
    used = int(np.bitwise_or.reduce(postings, initial=0))
    for b in range(OWN_BLOCKS):
        if used >> b & 1:
            n = np.add.reduceat((postings >> b) & 1, begin)
            better = (n > hits) & (mine | (b < BLOCKS))
            hits[better], block[better] = n[better], b
    score = np.where(mine, hits, np.add.reduceat((postings >> OWN_BLOCKS) & 1, begin) if len(begin) else 0)

    order = np.lexsort((sheet, mine, -score, of))
    order = order[score[order] > 0]
    place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    order, place = order[place < MOST], place[place < MOST]
    of, mine, block, length = of[order], mine[order], block[order], length[order]
    owner = np.repeat(np.arange(len(order)), length)
    shown = postings[np.repeat(begin[order] - (np.cumsum(length) - length), length) + np.arange(len(owner))]
    word = (shown >> WORD_BIT) & ((1 << (SHEET_BIT - WORD_BIT)) - 1)
    hit = np.flatnonzero(((shown >> OWN_BLOCKS) & 1).astype(bool) & ~mine[owner])
    hit = hit[np.arange(len(hit)) - np.searchsorted(owner[hit], owner[hit]) < MATCHED]
    in_block = np.flatnonzero((shown >> np.maximum(block[owner], 0)) & 1 & (block[owner] >= 0))
    fields = {
        "rank": pa.array(place + 1, pa.int32()), "number": pa.array(sheet[order]), "score": pa.array(score[order], pa.int32()), "block": pa.array(block, pa.int32(), mask=block < 0),
        "hit": _rows(word[hit], owner[hit], len(order), mine), "in_block": _rows(word[in_block], owner[in_block], len(order), block < 0),
    }
    return _rows(pa.StructArray.from_arrays(list(fields.values()), list(fields)), of, len(own))


@F.arrow_udf(CANDIDATES)
def best_sheets(found: pa.Array, own: pa.Array) -> pa.Array:
    """The best sheets of texts by their postings (each text's in order) and their own sheets' numbers, with the numbers of the words that are shown: TOGETHER postings or one text at a time."""
    postings, ends, own, parts, row = found.flatten().to_numpy(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]), own.to_numpy(), [], 0
    while row < len(own) or not parts:
        until = max(min(row + 1, len(own)), int(np.searchsorted(ends, ends[row] + TOGETHER, side="right")) - 1)
        parts.append(_best(postings[ends[row] : ends[until]], np.repeat(np.arange(until - row), np.diff(ends[row : until + 1])), own[row:until]))
        row = until
    return pa.concat_arrays(parts)


def task_candidates(texts: DataFrame, keywords: DataFrame, headers: DataFrame, id_col: str = "task_id") -> DataFrame:
    """(workbook, sheet, id, rank, candidate, score, matched, block, header_matches) of the best five sheets for each text (workbook, sheet, id, text).

    Another sheet scores the words of the text among its keywords; the block with most words of the text among its headers (the first on ties) is shown with it.
    The text's own sheet scores the words among the headers of its best block. Best scores come first, then other sheets by name, the own sheet last. Texts without words,
    or whose workbook is NULL, have no candidates, and of texts that share workbook, sheet and id each has its own words only if the ids differ: they count as one text.
    """
    index = written(postings(keywords, headers), "words")
    little = index.limit(SMALL + 1).count() <= SMALL
    key = ["workbook", "sheet", id_col]
    # A word is met by itself and by its plural; so texts are split into words, and nothing is done to each of these.
    plural = F.when(F.length("word") > 2, F.concat("word", F.lit("s")))
    forms = index.select("workbook", F.explode(F.array("word", plural)).alias("form"), "posting").where(F.length("form") > 1)
    forms = forms.groupBy("workbook", "form").agg(F.collect_list("posting").alias("postings"))
    words = texts.select(*key, F.explode(F.array_distinct(split("text"))).alias("form"))
    # A text's words are of one row, so its postings are put together, a number each, before anything is shuffled.
    found = _met(words, forms, little).groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("postings"))).alias("found"))
    listed = F.sort_array(F.collect_list(F.when(F.getbit("posting", F.lit(OWN_BLOCKS)) == 1, F.struct(_number().alias("no"), "word"))))
    sheets = index.groupBy("workbook", "other").agg(F.shiftright(F.min("posting"), SHEET_BIT).alias("number"), listed.alias("listed"))
    sheets = written(sheets.select("workbook", "other", "number", F.col("listed.no").alias("nos"), F.col("listed.word").alias("words")), "sheets")
    own = sheets.select("workbook", F.col("other").alias("sheet"), F.col("number").alias("own"))
    own = F.broadcast(own) if little else own
    found = found.join(own, same(found, own, ["workbook", "sheet"]), "left").select(*(found[c] for c in found.columns), F.coalesce("own", F.lit(-1)).alias("own"))
    top = found.select(*key, F.explode(best_sheets("found", "own")).alias("x")).select(*key, "x.*")

    # Numbers become names again: of the sheets, of the words that are shown, and of the headers that hold one of them.
    told = top.join(F.broadcast(sheets) if little else sheets, ["workbook", "number"])
    header = ["workbook", "other", "block", "place", "name"]
    named = headers.where(F.col("block") < OWN_BLOCKS).groupBy("workbook", F.col("sheet").alias("other"), F.col("block").cast("int").alias("block"), "place", "name").agg(F.count("*").cast("int").alias("times"))
    word_of = index.groupBy("workbook", "word").agg(_number(F.min("posting")).alias("no"))
    named = named.select(*header, "times", F.explode(tokens("name")).alias("word")).join(word_of, ["workbook", "word"]).groupBy(*header, "times").agg(F.collect_set("no").alias("nos"))
    named = written(named.groupBy(*header[:3]).agg(F.count("*").alias("n"), F.sort_array(F.flatten(F.collect_list(F.array_repeat(F.struct("place", "name", "nos"), F.col("times"))))).alias("names")), "headers")
    few = (named.agg(F.sum("n")).first()[0] or 0) <= SMALL
    names = F.broadcast(named.drop("n")) if few else named.drop("n")
    told = told.join(names, same(told, names, header[:3]), "left").select(*(told[c] for c in told.columns), "names")
    matched = F.transform("hit", lambda no: F.get("words", (F.array_position("nos", no) - 1).cast("int")))
    matches = F.transform(F.filter("names", lambda x: F.arrays_overlap(x["nos"], F.col("in_block"))), lambda x: x["name"])
    return told.select(*key, "rank", F.col("other").alias("candidate"), "score", matched.alias("matched"), "block", F.slice(matches, 1, HEADERS).alias("header_matches"))
