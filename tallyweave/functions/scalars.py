"""Scalar columns: names, paths, hashes, conversions; and small text repairs that no built-in can express, as pandas UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_file_name(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r'[\\/:*?"<>|]+', "_")


def s3_parts(uri: str | Column) -> Column:
    return F.struct(F.regexp_extract(_c(uri), "^s3://([^/]+)/", 1).alias("bucket"), F.regexp_extract(_c(uri), "^s3://[^/]+/(.*)$", 1).alias("key"))


def database_name(url: str | Column) -> Column:
    return F.regexp_extract(_c(url), r"^[a-z0-9+]+://[^/]*/([^?]*)", 1)


def blob_id(content: str | Column) -> Column:
    return F.substring(F.sha2(_c(content), 256), 1, 16)


def minutes(seconds: Column, digits: int = 2) -> Column:
    return F.round(seconds / 60, digits)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.1f%%", part / whole * 100)).otherwise("-")


def first_workbook(names: str | Column) -> Column:
    return F.try_element_at(F.filter(_c(names), lambda n: F.lower(n).endswith(".xlsx")), F.lit(1))


def has_secret(text: str | Column) -> Column:
    return _c(text).rlike("sk-ant-[A-Za-z0-9_-]{8,}|sk-proj-[A-Za-z0-9_-]{8,}")


def sse_events(stream: str | Column) -> Column:
    return F.regexp_extract_all(_c(stream), F.lit(r"(?m)^event: *(\S+)"), F.lit(1))


def most_output_tokens(stream: str | Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(_c(stream), F.lit(r'"output_tokens"\s*:\s*(\d+)'), F.lit(1)), lambda x: x.cast("bigint")))


def exit_status(code: str | Column, statuses: dict[int, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, _c(code)), F.concat(F.lit("exit "), _c(code).cast("string")))


def overflow_message(text: str | Column) -> Column:
    return F.lower(_c(text)).rlike("context length|context window|maximum context|too many tokens|prompt is too long")


def value_type(value: str | Column) -> Column:
    """Of a JSON value's text: null, bool before number, else string."""
    v = F.trim(_c(value))
    return F.when(v.isNull() | (v == "null"), "null").when(v.isin("true", "false"), "bool").when(F.expr("true") & v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").otherwise("string")


@F.pandas_udf(T.DoubleType())
def python_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Half to even on the binary number, as Python rounds; no built-in does."""
    return pd.Series([None if v is None or pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def extract_json(text: str | None) -> str | None:
    """The first JSON object or array of a model's answer: at its start, in a fenced block, or from its first brace."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    for candidate in (text.strip(), fenced[1].strip() if fenced else "", text[m.start() :] if (m := re.search(r"[{\[]", text)) else ""):
        try:
            value, _ = json.JSONDecoder().raw_decode(candidate)
        except ValueError:
            continue
        if isinstance(value, dict | list):
            return json.dumps(value)
    return None


def repair_json(text: str | None) -> str | None:
    """An object made parseable: fences and comments off, Python's words and quotes, bare keys and trailing commas mended. NULL if it stays broken."""
    if not text:
        return None
    body = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    if "{" in body and "}" in body:
        body = body[body.index("{") : body.rindex("}") + 1]
    for change in (
        lambda s: s,
        lambda s: re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?m)//.*$", "", s)),
        lambda s: re.sub(r"\bNone\b", "null", re.sub(r"\bFalse\b", "false", re.sub(r"\bTrue\b", "true", s))),
        lambda s: re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s),
        lambda s: re.sub(r"'([^'\"]*)'", r'"\1"', s),
    ):
        body = change(body)
        try:
            return json.dumps(json.loads(body))
        except ValueError:
            continue
    return None


def split_objects(text: str | None) -> list[str]:
    """The top-level JSON objects of a text, one after the other."""
    out, at, text = [], 0, text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = json.JSONDecoder().raw_decode(text, at)
            out.append(json.dumps(value))
        except ValueError:
            at += 1
    return out


@F.pandas_udf(T.StringType())
def json_of(text: pd.Series) -> pd.Series:
    return text.map(extract_json)


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    return text.map(repair_json)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(text: pd.Series) -> pd.Series:
    return text.map(split_objects)


def render_number(value: float | None, number_format: str | None) -> str | None:
    """A number as its format shows it: sections by sign, percent, thousands, literals. NULL where the format is not that plain."""
    if value is None or number_format is None or number_format in ("General", "@", "") or re.search(r"\[|[eE][+-]|[ymdhs]", re.sub(r'"[^"]*"', "", number_format)):
        return None
    sections = number_format.split(";")
    part, x = sections[0], value
    if value < 0 and len(sections) > 1:
        part, x = sections[1], -value
    elif value == 0 and len(sections) > 2:
        part = sections[2]
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.', "", part)
    core = re.search(r"[#0?][#0?,]*(?:\.[0#?]*)?", plain)
    literal = re.compile(r'"([^"]*)"|\\(.)|_.|\*.')
    if not core:
        return literal.sub(lambda m: m[1] or m[2] or "", part)
    x = x * 100 if "%" in plain else x
    digits = len(core[0].split(".")[1]) if "." in core[0] else 0
    shown = _half_away(abs(x), digits)
    whole, _, fraction = shown.partition(".")
    whole = whole.rjust(core[0].split(".")[0].replace(",", "").count("0"), "0")
    if "," in core[0].split(".")[0]:
        whole = re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", whole)
    least = core[0].split(".")[1].rstrip("#").count("0") if digits else 0
    fraction = fraction[:least] + fraction[least:].rstrip("0") if fraction else ""
    number = whole + ("." + fraction if fraction else "")
    at = part.index(core[0]) if core[0] in part else 0
    text = literal.sub(lambda m: m[1] or m[2] or "", part[:at]) + number + literal.sub(lambda m: m[1] or m[2] or "", part[at + len(core[0]) :])
    return ("-" if x < 0 and number.strip("0.,") else "") + text


def _half_away(x: float, digits: int) -> str:
    from decimal import ROUND_HALF_UP, Decimal

    return str(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


@F.pandas_udf(T.StringType())
def rendered_number(value: pd.Series, number_format: pd.Series) -> pd.Series:
    return pd.Series([render_number(None if v is None or pd.isna(v) else float(v), f) for v, f in zip(value, number_format, strict=True)], dtype="object")


def run_stamp(ts: str | Column) -> Column:
    """A time as a name of a folder, in UTC (the session's zone has to be UTC): 20250131T235959Z."""
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def elapsed_seconds(start: str | Column, end: str | Column) -> Column:
    """Seconds between two times, with two decimals."""
    return F.round((F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / 1e6, 2)


def duration_text(seconds: str | Column) -> Column:
    """59s, 1m05s or 2h03m of whole seconds, cut off."""
    s = _c(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).when(s.isNotNull(), F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def moved_bucket(uri: str | Column, old: str, new: str) -> Column:
    """A URI of the bucket `old` as one of `new`; others as they are."""
    return F.when(_c(uri).startswith(f"s3://{old}/"), F.concat(F.lit(f"s3://{new}/"), F.substring(_c(uri), len(old) + 7, 1 << 30))).otherwise(_c(uri))


def flattened(config: dict, prefix: str = "") -> dict:
    """A nested configuration as one level of PREFIX_KEY in upper case; None is left out."""
    out = {}
    for key, value in config.items():
        name = f"{prefix}_{key.upper()}" if prefix else key.upper()
        if isinstance(value, dict):
            out |= flattened(value, name)
        elif value is not None:
            out[name] = value
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flattened_json(text: pd.Series) -> pd.Series:
    """The same of JSON objects; values that are no text as JSON. NULL and what is no object give NULL."""

    def one(t):
        try:
            config = json.loads(t)
        except (TypeError, ValueError):
            return None
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in flattened(config).items()} if isinstance(config, dict) else None

    return text.map(one)
