"""How cells look, as text: colour names, format summaries, and values with their formats."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.scalars import render_number

#: The palette of indexed colours, with the two entries that differ from the usual one (13 green, 14 orange).
PALETTE = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF 00FF00 FF6600 00FFFF "
    "800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF "
    "000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 "
    "3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333"
).split()
#: Names by hue, each up to a bound in degrees; the first also from a bound on, where the second number says so. One list for each kind of colour.
DARK = ([(30, "dark_red"), (75, "brown"), (150, "dark_green"), (270, "dark_blue"), (360, "dark_purple")], 330)
MUTED = ([(60, "beige"), (150, "olive"), (210, "slate_blue"), (361, "muted_purple")], None)
BRIGHT = ([(15, "bright_red"), (45, "bright_orange"), (65, "bright_yellow"), (170, "bright_green"), (200, "bright_cyan"), (260, "bright_blue"), (310, "bright_purple"), (360, "bright_magenta")], 345)
PASTEL = ([(15, "pink"), (45, "peach"), (65, "pale_yellow"), (170, "pale_green"), (200, "pale_cyan"), (260, "pale_blue"), (310, "lavender"), (360, "pale_magenta")], 330)
PLAIN = ([(15, "red"), (45, "orange"), (65, "yellow"), (170, "green"), (200, "cyan"), (260, "blue"), (310, "purple"), (360, "magenta")], 345)


def _by_hue(hue: Column, names: tuple[list[tuple[int, str]], int | None]) -> Column:
    bounds, again = names
    out = F.when(hue >= again, bounds[0][1]) if again else F.when(F.lit(False), "")
    for bound, name in bounds:
        out = out.when(hue < bound, name)
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _name(c: Column) -> Column:
    """The name of a colour by hue (degrees), saturation and value."""
    hue, s, v = c["hue"], c["s"], c["v"]
    return (
        F.when(s < 0.1, F.when(v < 0.2, "black").when(v > 0.9, "white").otherwise("gray"))
        .when(v < 0.4, _by_hue(hue, DARK)).when(s < 0.4, _by_hue(hue, MUTED)).when((s > 0.7) & (v > 0.7), _by_hue(hue, BRIGHT))
        .when((s < 0.7) & (v > 0.7), _by_hue(hue, PASTEL)).otherwise(_by_hue(hue, PLAIN))
    )


def _hsv(c: Column) -> Column:
    """Hue, saturation and value of a struct of r, g, b, their greatest (top) and the difference to their least (NULL for none)."""
    red, green, blue = ((c["top"] - c[x]) / c["spread"] for x in "rgb")
    turn = F.when(c["r"] == c["top"], blue - green).when(c["g"] == c["top"], 2.0 + red - blue).otherwise(4.0 + green - red) / 6
    return F.struct((F.coalesce(F.pmod(turn, F.lit(1.0)), F.lit(0.0)) * 360).alias("hue"), F.coalesce(c["spread"] / c["top"], F.lit(0.0)).alias("s"), c["top"].alias("v"))


def colour_name(rgb: str | Column) -> Column:
    """`name (RRGGBB)` of a colour of six or, with its alpha first, eight hexadecimal digits; others as they are. NULL stays NULL."""
    text = F.col(rgb) if isinstance(rgb, str) else rgb
    part = lambda d, i: F.conv(F.substring(d, i, 2), 16, 10).cast("double") / 255
    parts = lambda d: F.struct(*(part(d, i).alias(x) for i, x in ((1, "r"), (3, "g"), (5, "b"))))
    wide = lambda c: F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.greatest(*(c[x] for x in "rgb")).alias("top"), F.nullif(F.greatest(*(c[x] for x in "rgb")) - F.least(*(c[x] for x in "rgb")), F.lit(0.0)).alias("spread"))
    named = lambda d: F.concat(_let(parts(d), lambda c: _let(wide(c), lambda w: _let(_hsv(w), _name))), F.lit(" ("), d, F.lit(")"))
    digits = lambda t: F.when(F.length(t) == 8, F.substring(t, 3, 6)).otherwise(t)
    return _let(text, lambda t: _let(digits(t), lambda d: F.when(d.rlike("^[0-9A-Fa-f]{6}$"), named(d)).otherwise(d)))


def palette_rgb(index: str | Column) -> Column:
    """RRGGBB of an index of the palette; black beyond it."""
    i = F.col(index) if isinstance(index, str) else index
    return F.when(i.isNotNull(), F.when((i >= 0) & (i < len(PALETTE)), F.get(F.array(*map(F.lit, PALETTE)), i.cast("int"))).otherwise("000000"))


def _colour(rgb: str, index: str) -> Column:
    """A colour's name by its own value, else by the palette; NULL without either. 00000000 is no colour."""
    own = F.when(F.col(rgb).isNotNull() & ~F.col(rgb).isin("", "00000000"), F.col(rgb))
    return colour_name(F.coalesce(own, palette_rgb(index)))


def format_summary() -> Column:
    """How a style (a row of `workbooks.styles`) looks: font, size, weight, colours, alignment and borders, parted by semicolons; '' for nothing."""
    flag = lambda c: F.when(F.col(c), c)
    said = lambda label, value: F.concat(F.lit(f"{label}:"), value)
    borders = F.concat_ws(",", *(said(side, F.col(side)) for side in ("top", "bottom", "left", "right")))
    return F.concat_ws(
        ";", said("font", F.nullif(F.col("font"), F.lit(""))), said("size", F.when(F.col("size") != 0, F.col("size").cast("string"))), flag("bold"), flag("italic"), flag("underline"),
        said("textcolor", _colour("font_rgb", "font_indexed")), said("bgcolor", _colour("fill_rgb", "fill_indexed")),
        said("halign", F.when(F.col("halign") != "general", F.col("halign"))), said("valign", F.when(F.col("valign") != "bottom", F.col("valign"))), said("border", F.nullif(borders, F.lit(""))),
    )


#: Digits that numbers are rounded to, and percentages.
DIGITS, PERCENT_DIGITS = 6, 8


def formatted(value: str | None, v_type: str | None, number_format: str | None, rounding: bool = True) -> str:
    """A cell's stored value as it is shown: as its format renders it, else `value [FORMAT:…]` with the section that holds for its sign, else the value. NULL is ''."""
    if value is None:
        return ""
    if v_type != "number":
        return value
    try:
        x = int(value) if value.lstrip("-").isdigit() else float(value)
    except ValueError:
        return value
    if number_format and (shown := render_number(x, number_format)) is not None:
        return shown
    rounded = lambda digits: round(x, digits) if rounding else x
    if number_format and number_format not in ("General", "@"):
        sections = number_format.split(";")
        label, section = "FORMAT", sections[0]
        if x < 0 and len(sections) > 1 and sections[1]:
            label, section = "NEG FORMAT", sections[1]
        elif x == 0 and len(sections) > 2 and sections[2]:
            label, section = "ZERO FORMAT", sections[2]
        if "%" in section:
            return f"{rounded(PERCENT_DIGITS)} [{label}:{section}]"
        if "$" in section or "#,##0" in section:
            return f"{rounded(DIGITS)} [{label}:{section}]"
    return str(rounded(DIGITS) if isinstance(x, float) else x)


@F.pandas_udf(T.StringType())
def formatted_value(value: pd.Series, v_type: pd.Series, number_format: pd.Series) -> pd.Series:
    return pd.Series([formatted(*x) for x in zip(value, v_type, number_format, strict=True)], dtype="object")
