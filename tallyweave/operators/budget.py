"""Text budgets: routing by size, redaction, sheet budgets, token and cost estimates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.scan import prefix_sums
from tallyweave.sources.tables import small


def effective_limit(static: int, total: int, solution: Column) -> Column:
    """What an attempt may take: its own limit, or what the solution leaves of the total if that is more (no total: its own)."""
    return F.greatest(F.lit(static), F.lit(total) - solution) if total > 0 else F.lit(static)


def overflows(solution: Column, attempt: Column, solution_limit: int, attempt_limit: int, total: int = 0) -> Column:
    """Whether either side is over its limit; a limit of 0 binds nothing."""
    over_solution = solution > solution_limit if solution_limit else F.lit(False)
    over_attempt = attempt > effective_limit(attempt_limit, total, solution) if attempt_limit else F.lit(False)
    return over_solution | over_attempt


def judge_mode(over: Column, force: str | None = None) -> Column:
    """A forced mode, else agentic for what overflows, standard for what fits, unknown where a size is."""
    if force:
        return F.lit(force)
    return F.when(over.isNull(), "unknown").when(over, "agentic").otherwise("standard")


def boundary_band(rows: DataFrame, size: str, limit: int, margin: float = 0.1) -> DataFrame:
    """Rows within round(limit * margin) of the limit, nearest first."""
    delta = F.col(size) - F.lit(limit)
    return rows.withColumn("delta", delta).where(F.abs("delta") <= round(limit * margin)).orderBy(F.abs("delta"))


def summarised_sheets(sheets: DataFrame, by: list[str], full: str, summary: str, order: str, budget: int) -> DataFrame:
    """Which sheets are replaced by their summaries, largest first, until the whole fits: flag `summarised`.

    Sheet i is replaced while the total, less what the larger ones save, is over the budget: a running sum, no loop, over a group of any size. Ties go by `order`.
    """
    out = prefix_sums(sheets, by, [F.desc(full), order], {"__saved": F.col(full) - F.col(summary)}, {"__all": full}, inclusive=False)
    return out.withColumn("summarised", F.col("__all") - F.col("__saved") > budget).drop("__saved", "__all")


def redact_rows(text: str | Column, first: int = 60, last: int = 40, over: int = 100) -> Column:
    """Of a text of more than `over` lines (empty ones at the end not counted) the first and last, and a line that names the rows left out."""
    whole = F.col(text) if isinstance(text, str) else text
    lines = F.split(F.regexp_replace(whole, "\n+$", ""), "\n")
    n = F.size(lines)
    gone = F.format_string(f"[Rows {first + 1}-%d redacted (%d rows)]", n - last, n - last - first)
    return F.when(n > over, F.array_join(F.concat(F.slice(lines, 1, first), F.array(gone), F.slice(lines, -last, last)), "\n")).otherwise(whole)


def redact_columns(text: str | Column, first: int = 50, last: int = 25, over: int = 75) -> Column:
    """Of lines of more than `over` cells (split at every comma) the first and last, and a cell that names the columns left out, counted on the widest line."""
    whole = F.col(text) if isinstance(text, str) else text
    lines = F.split(whole, "\n")
    widest = F.array_max(F.transform(lines, lambda x: F.size(F.split(x, ","))))
    gone = F.format_string(f"[Columns {first + 1}-%d redacted]", widest - last)

    def line(x: Column) -> Column:
        cells = F.split(x, ",")
        cut = F.array_join(F.concat(F.slice(cells, 1, first), F.array(gone), F.slice(cells, -last, last)), ",")
        return F.when((F.size(cells) > over) & ~(x.startswith("[") & x.contains("redacted")), cut).otherwise(x)

    return F.array_join(F.transform(lines, line), "\n")


def clean_commas(text: str | Column) -> Column:
    """Runs of commas as one, none at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, ",{2,}", ","), "(?m),+$", "")


#: Fixed schedules of shortening steps, for solutions and for attempts.
SOLUTION_STEPS = ["rows", "columns", "rows", "columns", "rows", "columns", "rows", "rows", "rows", "rows"]
ATTEMPT_STEPS = ["rows", "columns", "rows", "columns", "rows", "columns"] + ["rows"] * 14


def shorten(files: DataFrame, by: str, target: int, steps: list[str] = SOLUTION_STEPS, name: str = "name", text: str = "text") -> DataFrame:
    """Files of each directory shortened step by step until the directory is under `target` characters.

    A step takes the largest file that its axis has not yet cut; one too small to be cut stays the next step's choice. The
    choice of a step depends on the one before, but steps come to untouched files from the largest on (ties by name), one
    at most each: only the len(steps) largest of a directory go to its group, the others count with their characters and
    pass by. Names are those of one file each in a directory.
    """
    files = files.select(by, name, text)
    schema = files.schema
    at = F.struct((-F.length(F.coalesce(F.col(text), F.lit("")))).alias("size"), F.col(name).alias("name"))
    placed = files.withColumn("__at", at)
    most = placed.withColumn("__rank", F.rank().over(Window.partitionBy(by).orderBy("__at"))).where(F.col("__rank") <= max(1, len(steps))).drop("__rank")
    bounds = most.groupBy(F.col(by).alias("__by")).agg(F.max("__at").alias("__last"))
    rest = placed.join(bounds, F.col(by).eqNullSafe(F.col("__by"))).where(F.col("__at") > F.col("__last"))
    sums = rest.groupBy("__by").agg(F.sum(-F.col("__at.size")).alias("__rest"))
    chosen = most.join(sums, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, name, text, F.coalesce("__rest", F.lit(0)).alias("__rest"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(name)
        texts, others = rows[text].fillna("").tolist(), int(rows["__rest"].iloc[0])
        cut: dict[str, set[int]] = {"rows": set(), "columns": set()}
        for step in steps:
            if sum(map(len, texts)) + others < target:
                break
            left = [k for k in range(len(texts)) if k not in cut[step] and texts[k]]
            if left:
                i = max(left, key=lambda k: len(texts[k]))
                shorter = (_rows if step == "rows" else _columns)(texts[i])
                if shorter != texts[i]:
                    cut[step].add(i)
                    texts[i] = shorter
        return rows[[by, name]].assign(**{text: texts})

    return chosen.groupBy(by).applyInPandas(run, schema).unionByName(rest.select(by, name, F.coalesce(F.col(text), F.lit("")).alias(text)))


def _rows(text: str, first: int = 60, last: int = 40, over: int = 100) -> str:
    lines = text.rstrip("\n").split("\n")
    if len(lines) <= over:
        return text
    return "\n".join([*lines[:first], f"[Rows {first + 1}-{len(lines) - last} redacted ({len(lines) - last - first} rows)]", *lines[-last:]])


def _columns(text: str, first: int = 50, last: int = 25, over: int = 75) -> str:
    lines = text.split("\n")
    gone = f"[Columns {first + 1}-{max(x.count(',') + 1 for x in lines) - last} redacted]"
    out = []
    for line in lines:
        cells = line.split(",")
        keep = len(cells) <= over or (line.startswith("[") and "redacted" in line)
        out.append(line if keep else ",".join([*cells[:first], gone, *cells[-last:]]))
    return "\n".join(out)


def budget_split(total: Column, pdf: float = 0.25, solution: float = 0.6, floor: int = 1000) -> Column:
    """A struct of pdf, solution and context characters: a quarter for PDFs, the rest 60 to 40, none below the floor."""
    rest = total - F.floor(total * pdf)
    return F.struct(F.greatest(F.floor(total * pdf), F.lit(floor)).alias("pdf"), F.greatest(F.floor(rest * solution), F.lit(floor)).alias("solution"), F.greatest(F.floor(rest * (1 - solution)), F.lit(floor)).alias("context"))


def estimated_tokens(name: Column, size: Column) -> Column:
    """From bytes: a quarter for PDFs, a sixth for workbooks, none for others."""
    lower = F.lower(name)
    return F.when(lower.endswith(".pdf"), F.floor(size / 4)).when(lower.endswith(".xlsx"), F.floor(size / 6)).otherwise(0)


def costs(usage: DataFrame, prices: DataFrame, default: tuple[float, float], model: str = "model") -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) with prompt_cost, completion_cost and total_cost by prices (model, input_price, output_price) for a million tokens; unknown models at the default."""
    joined = usage.join(small(prices), model, "left")
    p = F.col("prompt_tokens") / 1e6 * F.coalesce("input_price", F.lit(float(default[0])))
    c = F.col("completion_tokens") / 1e6 * F.coalesce("output_price", F.lit(float(default[1])))
    return joined.withColumns({"prompt_cost": p, "completion_cost": c, "total_cost": p + c}).drop("input_price", "output_price")


def message_size(content: str) -> Column:
    """A struct of text and total characters of messages array<struct<content, parts array<struct<text, image_url>>>>."""
    m = F.col(content)
    text = F.aggregate(m, F.lit(0), lambda n, x: n + F.coalesce(F.length(x["content"]), F.lit(0)) + F.aggregate(F.coalesce(x["parts"], F.array().cast("array<struct<text:string,image_url:string>>")), F.lit(0), lambda k, p: k + F.coalesce(F.length(p["text"]), F.lit(0))))
    image = F.aggregate(m, F.lit(0), lambda n, x: n + F.aggregate(F.coalesce(x["parts"], F.array().cast("array<struct<text:string,image_url:string>>")), F.lit(0), lambda k, p: k + F.when(p["text"].isNull(), F.coalesce(F.length(p["image_url"]), F.lit(0))).otherwise(0)))
    return F.struct(text.alias("text"), (text + image).alias("total"))


def pressure(used: Column, limit: Column) -> Column:
    """Tiers of context use: under a tenth, under a fifth, under four fifths, more."""
    share = used / limit
    return F.when(share < 0.1, "low").when(share < 0.2, "early").when(share < 0.8, "working").otherwise("critical")


def chars_per_token(chars: Column, tokens: Column, fallback: float = 2.5) -> Column:
    return F.when(tokens > 0, chars / tokens).otherwise(fallback)


def least_loaded(workers: list[tuple[str, int]], tasks: list[int]) -> Iterator[tuple[int, str]]:
    """Each task to the worker with the least load, the first listed on ties. A roster of workers is small and lives on the driver."""
    load = dict(workers)
    for t in tasks:
        w = min(load, key=load.__getitem__)
        load[w] += 1
        yield t, w


#: Tags of the messages that eviction drops.
EVICTED_TAGS = ("model_tool_call", "tool_result")


def evicted(messages: DataFrame, requests: DataFrame, by: list[str], tags: tuple[str, ...] = EVICTED_TAGS) -> DataFrame:
    """(by, request, first_round, last_round, n_rounds, n_messages, chars) that a request (by, request, before_round) drops: tool messages of rounds 1 to before_round - 1.

    Messages (by, round, tag, chars) are summed by round first, so that requests meet a row for each round."""
    rounds = messages.where(F.col("tag").isin(*tags) & (F.col("round") > 0)).groupBy(*by, "round").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    hit = requests.join(rounds, by).where(F.col("round") < F.col("before_round"))
    return hit.groupBy(*by, "request").agg(F.min("round").alias("first_round"), F.max("round").alias("last_round"), F.count("*").alias("n_rounds"), F.sum("n").alias("n_messages"), F.sum("chars").alias("chars"))


def model_slugs(model: str | Column, providers: list[tuple[str, str]]) -> Column:
    """The ids under which a price list may name a model, first choice first: as it is, with a version's dash as a dot, each also with its provider.

    providers: (beginning of a name, provider), first match first; names with a slash have theirs."""
    name = F.col(model) if isinstance(model, str) else model
    dotted = F.regexp_replace(name, r"-(\d+)-(\d+)$", r"-$1.$2")
    owned = lambda c: F.when(~c.contains("/"), F.coalesce(*(F.when(c.startswith(p), F.concat(F.lit(f"{who}/"), c)) for p, who in providers))) if providers else F.lit(None).cast("string")
    return F.array_distinct(F.array_compact(F.array(name, dotted, owned(name), F.when(dotted != name, owned(dotted)))))


def priced(models: DataFrame, prices: DataFrame, providers: list[tuple[str, str]]) -> DataFrame:
    """Models (model) with the slug and price of their first slug that the list (slug, price) names; null where none is."""
    tried = models.select("model", F.posexplode(model_slugs("model", providers)).alias("place", "slug"))
    best = tried.join(prices, "slug").groupBy("model").agg(F.min_by(F.struct("slug", "price"), "place").alias("best"))
    return models.join(best, "model", "left").select("model", "best.slug", "best.price")
