"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. The probability of a cell's documents is min(1, s * l * t), one
factor for each of its three values; the factors are raked: scaled until the expected tokens of every source, language
and topic meet its target share. Because the cap at 1 is inside what is raked, the sample itself meets the targets: what
capped cells cannot give, others of the same value give. Targets are given, or each value's share of the tokens to the power
TEMPERATURE. The expected tokens are FRACTION of all, or less where a value has too few tokens for that: they start at what the
scarcest value allows, and shrink by SHRINK for each round of SWEEPS sweeps that leaves a share more than TOLERANCE off.
After ROUNDS rounds the rest is infeasible, and `margins` and the `gap` of each row state by how much. A document is
kept where a hash of its id falls under its probability, so the same id has the same fate in any run.

Topics are a column of the documents, or learned: the TERMS most frequent words (of TERM_LETTERS ASCII letters or more) among those
that are at most TERM_SHARE of all words, counted over all documents; a document is of the term that stands in it most often between two spaces, ties to the more frequent term.

Null sources and languages are a value of their own (NULL). Null texts have the topic `none`, texts without any of the terms
`other`; both null and empty texts have no tokens and the probability of their cell (1 in a cell without tokens). Null ids
hash as the text `null`; repeated rows share their fate. Texts of any length count whole. An empty table gives no rows.
Columns of the documents pass by, whatever their names. Repeated values in given targets add up; targets of values that the
documents lack can't be met: the others' shares are scaled to a sum of 1, and a value without a target is not sampled.
Cells, not documents, are windowed: a task holds those of one language or topic (60 bytes each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize

TEMPERATURE, FRACTION = 0.8, 0.8
TOLERANCE, SWEEPS, ROUNDS, SHRINK = 0.002, 6, 8, 0.87
DIMENSIONS = ["source", "lang", "topic"]
TERMS, TERM_SHARE, TERM_LETTERS = 4, 0.0005, 4
#: Cells that are broadcast to the documents, and raked in one task, at most; more are joined and raked by shuffles.
BROADCAST_CELLS = 100_000
#: Names of columns that stand beside the documents' own for a while.
CELL, HITS, MIX_KEY, CHANCE, MIX = "__mix_cell", "__mix_hits", "__mix_key", "__mix_probability", "__mix"
NULL = "\x01null"


def learned_terms(docs: DataFrame, text_col: str = "text", terms: int = TERMS, share: float = TERM_SHARE) -> list[str]:
    """The words that stand for topics, most frequent first. Words are what stands between spaces; counts are summed before they are shuffled."""
    held = docs.select(F.explode(F.split(F.col(text_col), " ", -1)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    held = materialize(held, "words")
    most = share * (held.agg(F.sum("n")).first()[0] or 0)
    fit = held.where((F.col("n") <= most) & F.col("term").rlike(f"^[A-Za-z]{{{TERM_LETTERS},}}$"))
    return [r["term"] for r in fit.orderBy(F.desc("n"), "term").limit(terms).collect()]


def with_cells(docs: DataFrame, terms: list[str], text_col: str, source_col: str, lang_col: str, topic_col: str | None = None) -> DataFrame:
    """`docs` with one more column: the struct CELL of source, lang, topic and n_tokens."""
    text = F.col(text_col)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    times = [((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(f" {t} "), F.lit("")))) / F.lit(len(t) + 2)).cast("int") for t in terms]
    if topic_col:
        topic = name(topic_col)
    elif not terms:
        topic = F.when(text.isNull(), "none").otherwise("other")
    else:
        docs = docs.withColumn(HITS, F.greatest(*(F.struct(n.alias("times"), F.lit(-i).alias("order"), F.lit(t).alias("term")) for i, (n, t) in enumerate(zip(times, terms, strict=True))), F.struct(F.lit(0).alias("times"), F.lit(1).alias("order"), F.lit("other").alias("term"))))
        topic = F.when(text.isNull(), "none").otherwise(F.col(f"{HITS}.term"))
    tokens = F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")
    return docs.withColumn(CELL, F.struct(name(source_col).alias("source"), name(lang_col).alias("lang"), topic.alias("topic"), tokens.alias("n_tokens"))).drop(HITS)


def by_value(cells: DataFrame, *measures: str) -> DataFrame:
    """(dimension, value, *measures): sums over the cells of every source, language and topic."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("v")
    return cells.select(*measures, each).groupBy("v.dimension", "v.value").agg(*(F.sum(m).alias(m) for m in measures))


def aimed(cells: DataFrame, temperature: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """(dimension, value, tokens, target): the share of the sample that each value is to have."""
    values, given = by_value(cells, "tokens"), None
    for d in DIMENSIONS:
        if targets and d in targets:
            one = targets[d].select(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(NULL)).alias("value"), F.col("share").cast("double").alias("share"))
            given = one if given is None else given.unionByName(one)
    wish = F.pow(F.col("tokens").cast("double"), F.lit(temperature))
    if given is not None:
        values = values.join(given.groupBy("dimension", "value").agg(F.sum("share").alias("share")), ["dimension", "value"], "left")
        wish = F.when(F.col("dimension").isin([d for d in DIMENSIONS if d in targets]), F.coalesce("share", F.lit(0.0))).otherwise(wish)
    wished = materialize(values.select("dimension", "value", "tokens", F.when(F.col("tokens") > 0, wish).otherwise(0.0).alias("wish")), "wishes")
    whole = wished.groupBy("dimension").agg(F.sum("wish").alias("whole"))
    return wished.join(whole, "dimension").select("dimension", "value", "tokens", F.when(F.col("whole") > 0, F.col("wish") / F.col("whole")).otherwise(0.0).alias("target"))


def rake(cells: DataFrame, temperature: float = TEMPERATURE, fraction: float = FRACTION, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, lang, topic, tokens, probability, target_source, target_lang, target_topic, gap) of the cells (source, lang, topic, tokens).

    targets: for any dimension a table (its name, share) that replaces the default. gap: how far the expected share of the
    cell's source, language or topic, whichever is worst, is off its target.
    """
    values = materialize(aimed(cells, temperature, targets), "targets")
    out = cells
    for d in DIMENSIONS:
        out = out.join(values.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("target").alias(f"target_{d}")), d)
    total = int(cells.agg(F.sum("tokens")).first()[0] or 0)
    scarcest = values.where("target > 0").agg(F.min(F.col("tokens") / F.col("target"))).first()[0]
    aim = min(fraction * total, scarcest if scarcest is not None else 0.0)
    out = materialize(out.withColumn("m", F.lit(aim / total if total else 0.0)), "cells")
    few = out.count() <= BROADCAST_CELLS
    measure = lambda df: off(df.coalesce(1) if few else df)
    expected = F.col("tokens") * F.least(F.lit(1.0), "m")
    for _ in range(ROUNDS if total else 0):
        out = out.coalesce(1) if few else out  # one partition needs no exchange for any of the windows
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                margin = F.sum(expected).over(Window.partitionBy(d))
                out = out.withColumn("m", F.when(margin > 0, F.col("m") * (F.col(f"target_{d}") * F.lit(aim)) / margin).otherwise(0.0))
        out = materialize(out, "raked")
        if (measure(out).agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
        aim *= SHRINK
    gaps = measure(out)
    for d in DIMENSIONS:
        out = out.join(gaps.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("gap").alias(f"gap_{d}")), d)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), "m")).otherwise(1.0)
    return out.select(*DIMENSIONS, "tokens", p.alias("probability"), *(f"target_{d}" for d in DIMENSIONS), F.greatest(*(f"gap_{d}" for d in DIMENSIONS)).alias("gap"))


def off(cells: DataFrame) -> DataFrame:
    """(dimension, value, gap): how far the expected share of each value is off its target."""
    kept = cells.withColumn("kept", F.col("tokens") * F.least(F.lit(1.0), "m"))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"target_{d}").alias("target")) for d in DIMENSIONS))).alias("v")
    sums = kept.select("kept", each).groupBy("v.dimension", "v.value").agg(F.sum("kept").alias("kept"), F.max("v.target").alias("target"))
    whole = F.sum("kept").over(Window.partitionBy("dimension"))
    return sums.select("dimension", "value", F.when(whole > 0, F.abs(F.col("kept") / whole - F.col("target"))).otherwise(0.0).alias("gap"))


def margins(raked: DataFrame) -> DataFrame:
    """(dimension, value, target, input, achieved, capped) of each source, language and topic of `rake`'s rows: the target, the share of the
    input's tokens, the share of the tokens that are expected to be kept, and the share of the value's tokens that are in cells of probability 1."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"target_{d}").alias("target")) for d in DIMENSIONS)))
    sums = raked.select("tokens", (F.col("tokens") * F.col("probability")).alias("kept"), F.when(F.col("probability") >= 1, F.col("tokens")).otherwise(0).alias("full"), each.alias("m"))
    sums = sums.groupBy("m.dimension", "m.value").agg(F.max("m.target").alias("target"), F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"), F.sum("full").alias("full"))
    whole = Window.partitionBy("dimension")
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(whole))
    return sums.select("dimension", "value", "target", share("tokens").alias("input"), share("kept").alias("achieved"), F.try_divide("full", "tokens").alias("capped"))


def chance(id_col: str):
    """A number from 0 to 1 that depends on the id alone."""
    text = F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None = None, **rates) -> DataFrame:
    """`docs` with one more column, the struct MIX of source, lang, topic, n_tokens, probability, kept and gap."""
    placed = with_cells(docs, [] if topic_col else learned_terms(docs, text_col), text_col, source_col, lang_col, topic_col)
    cells = placed.groupBy(*(F.col(f"{CELL}.{d}").alias(d) for d in DIMENSIONS)).agg(F.sum(f"{CELL}.n_tokens").alias("tokens"))
    raked = materialize(rake(materialize(cells, "cells"), **rates), "rates").select(F.struct(*DIMENSIONS).alias(MIX_KEY), F.struct("probability", "gap").alias(CHANCE))
    if raked.count() <= BROADCAST_CELLS:
        raked = F.broadcast(raked)
    joined = placed.withColumn(MIX_KEY, F.struct(*(F.col(f"{CELL}.{d}") for d in DIMENSIONS))).join(raked, MIX_KEY, "left")
    kept = chance(id_col) < F.col(f"{CHANCE}.probability")
    return joined.withColumn(MIX, F.struct(f"{CELL}.*", F.col(f"{CHANCE}.probability"), kept.alias("kept"), F.col(f"{CHANCE}.gap"))).drop(CELL, MIX_KEY, CHANCE)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, **rates) -> DataFrame:
    """`docs` with one more column, the struct `mix` of source, lang, topic, n_tokens, probability, kept and gap, in place of a column of that name."""
    out = decided(docs, id_col, text_col, source_col, lang_col, topic_col, **rates)
    return out.drop("mix").withColumnRenamed(MIX, "mix")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, **rates) -> DataFrame:
    """The rows of `docs` that are kept, with the columns of `docs`."""
    return decided(docs, id_col, text_col, source_col, lang_col, topic_col, **rates).where(F.col(f"{MIX}.kept")).select(*docs.columns)


def decide_sql(documents: str = "documents", temperature: float = TEMPERATURE, fraction: float = FRACTION) -> str:
    """DuckDB's SQL for (doc_id, topic, n_tokens, probability, kept, gap), probability and gap rounded to 6 digits."""
    sweep = "before"
    for d in DIMENSIONS:
        margin = f"sum(tokens * least(1.0, m)) OVER (PARTITION BY {d})"
        sweep = f"(SELECT * REPLACE (CASE WHEN {margin} > 0 THEN m * (target_{d} * aim) / {margin} ELSE 0.0 END AS m) FROM {sweep})"
    sums = ", ".join([*(f"sum(tokens * least(1.0, m)) OVER (PARTITION BY {d}) AS sum_{d}" for d in DIMENSIONS), "sum(tokens * least(1.0, m)) OVER () AS sum_all"])
    gap = "CASE WHEN sum_all > 0 THEN greatest(" + ", ".join(f"abs(sum_{d} / sum_all - target_{d})" for d in DIMENSIONS) + ") ELSE 0.0 END"
    wishes = ",\n    ".join(f"CASE WHEN sum(tokens) OVER (PARTITION BY {d}) > 0 THEN pow(CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE), {temperature}) ELSE 0.0 END AS wish_{d}, count(*) OVER (PARTITION BY {d}) AS count_{d}, sum(tokens) OVER (PARTITION BY {d}) AS tokens_{d}" for d in DIMENSIONS)
    targets = ", ".join(f"CASE WHEN sum(wish_{d}) OVER () > 0 THEN wish_{d} / sum(wish_{d} / count_{d}) OVER () ELSE 0.0 END AS target_{d}" for d in DIMENSIONS)
    scarcest = "least(" + ", ".join(f"min(CASE WHEN target_{d} > 0 THEN tokens_{d} / target_{d} END) OVER ()" for d in DIMENSIONS) + ")"
    columns = ", ".join([*DIMENSIONS, "tokens", *(f"target_{d}" for d in DIMENSIONS)])
    return f"""
WITH RECURSIVE words AS (
  SELECT unnest(string_split(text, ' ')) AS term FROM {documents}
), held AS (
  SELECT term, count(*) AS n FROM words GROUP BY term
), terms AS (
  SELECT term, row_number() OVER (ORDER BY n DESC, term) AS place FROM held
  WHERE n <= {TERM_SHARE} * (SELECT sum(n) FROM held) AND regexp_matches(term, '^[A-Za-z]{{{TERM_LETTERS},}}$') QUALIFY place <= {TERMS}
), learned AS (
  SELECT coalesce(list(term ORDER BY place), []) AS terms FROM terms
), counted AS (
  SELECT doc_id, coalesce(source, chr(1) || 'null') AS source, coalesce(lang, chr(1) || 'null') AS lang, text IS NULL AS missing, terms,
    coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS n_tokens,
    list_transform(terms, lambda t: (strlen(text) - strlen(replace(text, ' ' || t || ' ', ''))) // (strlen(t) + 2)) AS times
  FROM {documents}, learned
), placed AS (
  SELECT doc_id, source, lang, n_tokens,
    CASE WHEN missing THEN 'none' WHEN list_max(times) > 0 THEN terms[list_position(times, list_max(times))] ELSE 'other' END AS topic
  FROM counted
), cells AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM placed GROUP BY ALL
), wished AS (
  SELECT *, CAST(sum(tokens) OVER () AS DOUBLE) AS total,
    {wishes} FROM cells
), targeted AS (
  SELECT *, {targets} FROM wished
), aimed AS (
  SELECT *, least({fraction} * total, {scarcest}) AS aim FROM targeted
), sweeps AS (
  SELECT 0 AS k, {columns}, aim, CASE WHEN total > 0 THEN aim / total ELSE 0.0 END AS m, CAST(1.0 AS DOUBLE) AS gap FROM aimed
  UNION ALL
  SELECT k, {columns}, aim, m, CASE WHEN k % {SWEEPS} = 0 THEN max({gap}) OVER () ELSE 1.0 END AS gap FROM (
    SELECT *, {sums} FROM {sweep.replace("before", f"(SELECT k + 1 AS k, {columns}, CASE WHEN k > 0 AND k % {SWEEPS} = 0 THEN aim * {SHRINK} ELSE aim END AS aim, m FROM sweeps WHERE gap > {TOLERANCE} AND k < {SWEEPS * ROUNDS})")}
  )
), rated AS (
  SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, m) ELSE 1.0 END AS p, {gap} AS gap
  FROM (SELECT * EXCLUDE (gap), {sums} FROM sweeps WHERE k = (SELECT max(k) FROM sweeps))
)
SELECT doc_id, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(p, 6) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept, round(gap, 6) AS gap
FROM placed JOIN rated USING (source, lang, topic)
"""
