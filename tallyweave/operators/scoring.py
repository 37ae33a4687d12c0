"""Rubric scoring: judgements against weights, with warnings for what judges leave out or say twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.tables import one_row, small

#: Keys that a task scores: so many at most, and where there are fewer tasks than Spark shuffles by, so many at least.
MOST_KEYS, LEAST_KEYS = 200_000, 10_000
ITEM = "struct<name:string,check:string,decision:string,summary:string,mistakes:array<string>,total_mistakes:int>"


def check_score(mistakes: Column, max_mistakes: int = 5) -> Column:
    return F.greatest(F.lit(0), F.lit(max_mistakes) - mistakes) / F.lit(max_mistakes)


def judgement_items(judgements: DataFrame, key: str = "grading_id", judgement: str = "judgement") -> DataFrame:
    """(key, category, items array or NULL) of JSON judgements {category: [item]}: items is NULL where the category holds no list."""
    pairs = judgements.select(key, F.explode(F.from_json(judgement, "map<string,string>")).alias("category", "raw"))
    return pairs.select(key, "category", F.when(F.ltrim("raw").startswith("["), F.from_json("raw", f"array<{ITEM}>")).alias("items"))


def counted(items: DataFrame, key: str = "grading_id", max_mistakes: int = 5) -> DataFrame:
    """One row for each named item: its mistakes (a fail without any counts as the most), and what is odd about it."""
    item = items.select(key, "category", F.explode("items").alias("item")).select(key, "category", "item.*").where("name IS NOT NULL AND name <> ''")
    listed = F.coalesce(F.size("mistakes"), F.lit(0))
    listed = F.when(F.col("mistakes").isNull(), 0).otherwise(listed)
    bare = (F.lower(F.trim(F.coalesce("decision", F.lit("")))) == "fail") & (listed == 0)
    out = item.withColumn("n_mistakes", F.when(bare, max_mistakes).otherwise(listed)).withColumn("fail_without_mistakes", bare)
    return out.withColumn("count_mismatch", F.coalesce(F.col("total_mistakes") != F.col("n_mistakes"), F.lit(False))).select(key, "category", "name", "n_mistakes", "fail_without_mistakes", "count_mismatch")


def check_scores(items: DataFrame, counted_items: DataFrame, check_weights: DataFrame, keys: DataFrame, key: str = "grading_id", max_mistakes: int = 5) -> DataFrame:
    """A row for each key and weighted check: mistakes (the worst of duplicates, the most where the judge said nothing), score, unscored.

    keys holds every judgement's key, and is counted first. Categories present but without a list are skipped whole; absent ones score 0.
    check_weights: (category, name, weight), a rubric; it meets every judgement, so more rows than `tables.SMALL` are an error.
    """
    spark, said_type = keys.sparkSession, "array<struct<check:int,n:int>>"
    n_keys, parts = keys.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many parts as keep a task's keys few, however many there are.
    parts = max(1, -(-n_keys // MOST_KEYS), min(-(-n_keys // LEAST_KEYS), parts))
    rubric = one_row(check_weights.select("category", "name", "weight"), "rubric").select(F.sort_array("rubric").alias("rubric"))
    numbered = F.broadcast(rubric.select(F.posexplode("rubric").alias("check", "x")).select("check", "x.category", "x.name"))
    # A check of a category without a list is said with NULL mistakes. Only what is in the rubric is shuffled, by key alone: the grid of keys and checks is made behind the join.
    skipped = items.where("items IS NULL").select(key, "category").join(numbered, "category").select(key, "check", F.lit(None).cast("int").alias("n"))
    said = counted_items.join(numbered, ["category", "name"]).select(key, "check", F.col("n_mistakes").alias("n")).unionByName(skipped)
    said = said.repartition(parts, key).groupBy(key).agg(F.collect_list(F.struct("check", "n")).alias("said"))
    grid = keys.select(key).repartition(parts, key).distinct().join(said, key, "left").select(key, F.coalesce("said", F.array().cast(said_type)).alias("said"))
    rows = grid.join(rubric).select(key, "said", F.posexplode("rubric").alias("check", "x"))
    rows = rows.select(key, "x.*", F.transform(F.filter("said", lambda y: y["check"] == F.col("check")), lambda y: y["n"]).alias("own")).where(~F.exists("own", lambda n: n.isNull()))
    mistakes = F.coalesce(F.array_max("own"), F.lit(max_mistakes))
    return rows.select(key, "category", "name", "weight", mistakes.alias("mistakes"), check_score(mistakes, max_mistakes).alias("score"), (F.size("own") == 0).alias("unscored"), F.size("own").cast("long").alias("times"))


def category_scores(checks: DataFrame, key: str = "grading_id") -> DataFrame:
    """Weighted mean of each category's checks, in percent; 0 where weights add up to 0."""
    out = checks.groupBy(key, "category").agg(F.sum(F.col("score") * F.col("weight")).alias("weighted_sum"), F.sum("weight").alias("total_weight"), F.count_if("unscored").alias("n_unscored"))
    return out.withColumn("normalized", F.when(F.col("total_weight") > 0, F.col("weighted_sum") / F.col("total_weight") * 100).otherwise(0.0))


def total_scores(categories: DataFrame, category_weights: DataFrame, key: str = "grading_id") -> DataFrame:
    return categories.join(small(category_weights), "category").groupBy(key).agg(F.sum(F.col("normalized") * F.col("category_weight")).alias("total_score"), F.sum("n_unscored").alias("n_unscored"))


def warnings(items: DataFrame, counted_items: DataFrame, checks: DataFrame, key: str = "grading_id") -> DataFrame:
    """(key, kind, category, name) of everything a scoring had to repair; each table is read once."""
    kinds = lambda *named: F.explode(F.array_compact(F.array(*(F.when(F.col(flag) if isinstance(flag, str) else flag, kind) for flag, kind in named)))).alias("kind")
    of_checks = checks.select(key, kinds(("unscored", "unscored_check"), (F.col("times") > 1, "duplicate_judgement")), "category", "name")
    of_items = counted_items.select(key, kinds(("count_mismatch", "mistake_count_mismatch"), ("fail_without_mistakes", "fail_without_mistakes")), "category", "name")
    empty = items.where(F.size("items") == 0).select(key, F.lit("empty_category").alias("kind"), "category", F.lit(None).cast("string").alias("name"))
    return of_checks.unionByName(of_items).unionByName(empty)


def failure_reason(success: str = "success", parse_failures: str = "parse_failures", scores: str = "scores_missing", n_warnings: str = "n_warnings") -> Column:
    """Why a grading counts as failed, or NULL: the first of no success, unparsed answers, missing scores, warnings."""
    return F.when(~F.coalesce(F.col(success), F.lit(False)), "judge error").when(F.col(parse_failures) > 0, "parse failure").when(F.col(scores), "missing scores").when(F.col(n_warnings) > 0, "scoring warnings")


def rubric_problems(check_weights: DataFrame, rubric: DataFrame) -> DataFrame:
    """(problem, category, name): checks on one side only, and categories whose weights do not add up to 1 (within 0.01)."""
    sums = check_weights.groupBy("category").agg(F.sum("weight").alias("s")).where(~F.col("s").between(0.99, 1.01))
    a, b = check_weights.select("category", "name"), rubric.select("category", "name")
    return (
        a.join(b, ["category", "name"], "left_anti").select(F.lit("not in rubric").alias("problem"), "category", "name")
        .unionByName(b.join(a, ["category", "name"], "left_anti").select(F.lit("without weight").alias("problem"), "category", "name"))
        .unionByName(sums.select(F.lit("weights do not add up").alias("problem"), "category", F.lit(None).cast("string").alias("name")))
    )


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The first 702 letters, and for places from the sixth to the first: the least index that has it, and what a step of it counts.
_SHORT = ",".join([*_ALPHABET, *(a + b for a in _ALPHABET for b in _ALPHABET)])
_PLACES = [(sum(26**i for i in range(1, j + 1)), 26**j) for j in range(5, -1, -1)]


def check_letter(index: str | Column) -> Column:
    """A, B ... Z, AA, AB ... for 0, 1 ...: bijective base 26, up to six letters; the empty text for NULL and below 0. Two letters at most are looked up in a list."""
    n = F.col(index) if isinstance(index, str) else index
    places = F.array(*(F.struct(F.lit(least).cast("long").alias("least"), F.lit(step).cast("long").alias("step")) for least, step in _PLACES))
    digits = F.transform(F.filter(places, lambda p: n >= p["least"]), lambda p: F.chr((F.pmod(F.floor((n - p["least"]) / p["step"]), F.lit(26)) + 65).cast("int")))
    return F.when(n < 702, F.coalesce(F.get(F.split(F.lit(_SHORT), ","), F.greatest(n, F.lit(-1)).cast("int")), F.lit(""))).otherwise(F.array_join(digits, ""))


def lettered(rubric: DataFrame, category: str = "category", position: str = "position") -> DataFrame:
    """The rubric with each check's letter within its category."""
    from pyspark.sql import Window

    return rubric.withColumn("letter", check_letter(F.row_number().over(Window.partitionBy(category).orderBy(position)) - 1))


def violations(items: str = "items") -> Column:
    """What is wrong with a category's items: no list, or items without check, decision or summary."""
    each = F.flatten(F.transform(F.col(items), lambda x, i: F.filter(F.array(*(F.when(x[k].isNull(), F.concat(F.lit("item "), i.cast("string"), F.lit(f": no {k}"))) for k in ("check", "decision", "summary"))), lambda m: m.isNotNull())))
    return F.when(F.col(items).isNull(), F.array(F.lit("no list"))).otherwise(each)


def fold_records(events: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Scratchpad events (kind record_check or append_mistake, decision, mistake) by check: the last decision recorded, and the mistakes appended after the first record."""
    first = events.where("kind = 'record_check'").groupBy(*keys).agg(F.min(step).alias("first"), F.max_by("decision", step).alias("decision"))
    appended = events.where("kind = 'append_mistake'").join(first, keys).where(F.col(step) > F.col("first"))
    listed = appended.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(step, "mistake"))), lambda x: x["mistake"]).alias("mistakes"))
    return first.select(*keys, "decision").join(listed, keys, "left").withColumn("mistakes", F.coalesce("mistakes", F.array().cast("array<string>")))


def pending(rubric_letters: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Checks without a record."""
    return rubric_letters.join(records, keys, "left_anti")


def first_score(by_name: str | Column, *names: str) -> Column:
    """The score of the first of the names (say, of a category that was renamed) that a map holds; null where it holds none."""
    scores = F.col(by_name) if isinstance(by_name, str) else by_name
    return F.coalesce(*(F.try_element_at(scores, F.lit(n)) for n in names))


def named_items(items: DataFrame, letters: DataFrame) -> DataFrame:
    """Items (.., category, check) with the name of their letter by the rubric (category, letter, name); an unmatched letter has no name, and its check stays unscored."""
    names = letters.select("category", F.col("letter").alias("check"), "name")
    return items.join(names, ["category", "check"], "left")


def parse_outcomes(tries: DataFrame, keys: list[str], ok: str = "parsed") -> DataFrame:
    """(keys, count, success) where a try failed to parse: how many did, and whether one parsed in the end. A category without success has no items."""
    out = tries.groupBy(*keys).agg(F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("count"), F.coalesce(F.max(ok), F.lit(False)).alias("success"))
    return out.where(F.col("count") > 0)
