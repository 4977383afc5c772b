"""Columns over the lines of a note: which lines are code, tables, formulas or front matter.

States that run down the lines live in ``aggregate``; it keeps ranges of positions, so a note is never shuffled
and long notes cost one step a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fence is three marks or more; a line is indented by a tab or four blanks; a cell of a table's rule is dashes, perhaps
#: between colons; code in a line stands between equal runs of backticks.
FENCE = r"^[ \t]*(```+|~~~+)"
INDENTED = r"^(?: {4}|\t)[ \t]*\S"
_RULE_CELL = r"[ \t]*:?-+:?[ \t]*"
TABLE_RULE = rf"^(?=[^-]*-)[ \t]*\|?(?:{_RULE_CELL}(?:\||$))+[ \t]*$"
INLINE_CODE = r"(`+)(?s:.*?)\1"
ITEM = r"^\s*(?:[*+-]|[0-9]{1,9}[.)])(?!\S)"
_RANGES = "array<struct<first:int,last:int>>"


def let(use: Callable[[Column], Column], **values: Column) -> Column:
    """``use`` of a struct of ``values``, each computed once a row. Inside a lambda a column that is not its
    variable would be computed for every element; this makes it one."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use)[0]


def bound(use: Callable[[Column], Column], **values: Column) -> Column:
    """As ``let``, without the copy that ``transform`` makes of every value it returns: the last step of an aggregate over nothing."""
    start = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.aggregate(F.array().cast("array<int>"), start, lambda s, _: s, use)


def first_of(*branches: tuple[Column, Column | str], otherwise: Column | str) -> Column:
    """The value of the first branch whose condition holds. Each branch is a CASE of its own: Spark finds the branches of one CASE by
    walking a list from its head for each, so that many cost by their square."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(branches):
        out = F.when(condition, value).otherwise(out)
    return out


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def only_if(test: Callable[[Column], Column], change: Callable[[Column], Column], text: Column) -> Column:
    """``change`` of texts that pass a cheap test; the others as they are."""
    return let(lambda v: F.when(test(v["t"]), change(v["t"])).otherwise(v["t"]), t=text)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))


def inside(ranges: Column, pos: Column) -> Column:
    return F.exists(ranges, lambda r: (r["first"] <= pos) & (pos <= r["last"]))


def _range(first: Column, last: Column) -> Column:
    return F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))


def is_blank(line: Column) -> Column:
    """Whether a line holds nothing but blanks, tabs and returns. Only its blanks are looked at."""
    return F.ltrim(line, F.lit(" \t\r")) == ""


def begins(line: Column, marks: str) -> Column:
    """Whether a line is empty or begins with one of ``marks``: a test without a pattern."""
    return F.lit(marks).contains(F.substring(line, 1, 1))


def _ranges_if(lines: Column, hint: Callable[[Column], Column], ranges: Column) -> Column:
    """``ranges`` where a line passes a cheap test that each of them asks for; the lines of most notes are looked at no further."""
    return F.when(F.exists(lines, hint), ranges).otherwise(no_ranges(lines))


def fence_ranges(lines: Column) -> Column:
    """Fenced code, fences included. A fence closes one of the same mark that is not longer; an open one runs to the end."""
    hint = lambda x: x.contains("```") | x.contains("~~~")
    marks = F.filter(F.transform(lines, lambda x, i: F.when(hint(x), F.struct(i.alias("pos"), F.regexp_extract(x, FENCE, 1).alias("mark")))), lambda x: x["mark"] != "")
    start = F.struct(F.lit(-1).alias("open"), F.lit("").alias("mark"), F.array().cast(_RANGES).alias("ranges"))

    def step(s: Column, x: Column) -> Column:
        closes = (F.substring(x["mark"], 1, 1) == F.substring(s["mark"], 1, 1)) & (F.length(x["mark"]) >= F.length(s["mark"]))
        opened = F.struct(x["pos"].alias("open"), x["mark"].alias("mark"), s["ranges"].alias("ranges"))
        closed = F.struct(F.lit(-1).alias("open"), F.lit("").alias("mark"), F.concat(s["ranges"], _range(s["open"], x["pos"])).alias("ranges"))
        return F.when(s["open"] < 0, opened).when(closes, closed).otherwise(s)

    return _ranges_if(lines, hint, F.aggregate(marks, start, step, lambda s: F.when(s["open"] >= 0, F.concat(s["ranges"], _range(s["open"], F.size(lines)))).otherwise(s["ranges"])))


def frontmatter_range(lines: Column) -> Column:
    """Front matter: from a first line of three dashes to the next such line, or three dots, or the end."""
    bare = lambda x: F.regexp_replace(x, r"\s+$", "")
    ends = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & bare(x).isin("---", "..."), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.get(ends, F.lit(0)), F.size(lines) - 1)
    return F.when(lines[0].startswith("---") & (bare(lines[0]) == "---"), _range(F.lit(0), last)).otherwise(no_ranges(lines))


def indented_ranges(lines: Column) -> Column:
    """Indented code: an indented line after a blank one (or first), unless the text before the blank is a list item."""
    items = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), is_blank(x).alias("blank"), x.rlike(INDENTED).alias("indented"), x.rlike(ITEM).alias("item")))
    # after: 0 text before, 1 blank after text, 2 blank after a list
    start = F.struct(F.lit(False).alias("code"), F.lit(1).alias("after"), F.lit(False).alias("listed"), F.array().cast(_RANGES).alias("ranges"))

    def step(s: Column, x: Column) -> Column:
        blank = x["blank"]
        code = x["indented"] & ~x["item"] & (s["code"] | ((s["after"] == 1) & ~s["listed"]))
        return F.when(blank, F.struct(s["code"].alias("code"), F.lit(1).alias("after"), s["listed"].alias("listed"), s["ranges"].alias("ranges"))).otherwise(
            F.struct(code.alias("code"), F.lit(0).alias("after"), (x["item"] | (s["listed"] & x["indented"])).alias("listed"), F.when(code, F.concat(s["ranges"], _range(x["pos"], x["pos"]))).otherwise(s["ranges"]).alias("ranges"))
        )

    return _ranges_if(lines, lambda x: x.startswith("\t") | x.startswith("    "), F.aggregate(items, start, step, lambda s: s["ranges"]))


def table_ranges(lines: Column) -> Column:
    """Table rows: a rule of dashes and bars, the row above it and the rows below it that begin with a bar."""
    rule = lambda x: x.contains("|") & x.rlike(TABLE_RULE)
    items = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), rule(x).alias("rule"), F.ltrim(x, F.lit(" \t")).startswith("|").alias("row")))
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("above"), F.array().cast(_RANGES).alias("ranges"))

    def step(s: Column, x: Column) -> Column:
        first = F.when(s["above"], x["pos"] - 1).otherwise(x["pos"])
        more = F.when(x["rule"], F.concat(s["ranges"], _range(first, x["pos"]))).when(s["open"] & x["row"], F.concat(s["ranges"], _range(x["pos"], x["pos"]))).otherwise(s["ranges"])
        return F.struct((x["rule"] | (s["open"] & x["row"])).alias("open"), x["row"].alias("above"), more.alias("ranges"))

    return _ranges_if(lines, rule, F.aggregate(items, start, step, lambda s: s["ranges"]))


def math_ranges(lines: Column, code: Column) -> Column:
    """Lines of a formula block that spans lines, its first and last included; code lines do not count."""
    items = let(lambda v: F.transform(v["lines"], lambda x, i: F.struct(i.alias("pos"), F.when(inside(v["code"], i), F.lit(0)).otherwise(F.regexp_count(x, F.lit(r"\$\$"))).alias("marks"))), lines=lines, code=code)
    odd = F.filter(items, lambda x: x["marks"] % 2 == 1)
    pairs = let(lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v["odd"]) / 2).cast("int")), lambda k: F.struct(F.get(v["odd"], 2 * k)["pos"].alias("first"), F.get(v["odd"], 2 * k + 1)["pos"].alias("last"))), odd=odd)
    return _ranges_if(lines, lambda x: x.contains("$$"), F.filter(pairs, lambda p: p["first"].isNotNull() & p["last"].isNotNull()).cast(_RANGES))


def code_ranges(lines: Column) -> Column:
    """Front matter and fenced code."""
    return F.concat(frontmatter_range(lines), fence_ranges(lines))


def protected_ranges(lines: Column) -> Column:
    """All that text jobs leave alone: front matter, fenced and indented code."""
    return F.concat(code_ranges(lines), indented_ranges(lines))


def no_ranges(lines: Column) -> Column:
    return F.array().cast(_RANGES)


def map_lines(text: Column, change: Callable[..., Column], protected: Callable[[Column], Column] = protected_ranges, **more: Callable[[Column], Column]) -> Column:
    """The text with ``change(line)`` for each line outside the protected ranges. With ``more``, columns made of all
    lines once, it is ``change(line, position, struct of them)``. Null stays null. The text occurs once in the
    expression, so steps can be stacked without growing it."""
    changed = lambda v: F.transform(v["lines"], lambda x, i: F.when(inside(v["kept"], i), x).otherwise(change(x, i, v) if more else change(x)))
    done = let(lambda t: let(changed, lines=t["lines"], kept=protected(t["lines"]), **{k: f(t["lines"]) for k, f in more.items()}), lines=F.split(text, "\n"))
    return F.array_join(done, "\n")
