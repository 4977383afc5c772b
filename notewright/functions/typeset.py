"""Text columns for the layout of lines: indents, markers, headings, ordered lists, blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.lines import begins, code_ranges, indented_ranges, inside, is_blank, let, lines_of, map_lines, no_ranges, only_if, protected_ranges, table_ranges

_ITEM = r"^[ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)"
_MARKER = r"^[ \t]*(?:[-*+](?:[ \t]|$)|\d{1,9}[.)](?:[ \t]|$)|>|#{1,6}(?:[ \t]|$)|\|)"
HEADING = r"^([ \t]*)(#{1,6})(?=[ \t]|$)"
ORDERED = r"^([ \t]*(?:>[ \t]?)*)([ \t]*)(\d{1,9})([.)])([ \t]+.*)$"
_POSITIONS = "array<int>"


def list_paragraphs(lines: Column) -> Column:
    """Positions of indented lines after a blank one inside a list item: their indent is syntax."""
    items = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), is_blank(x).alias("blank"), x.rlike(_ITEM).alias("item"), x.rlike(r"^[ \t]").alias("indented")))
    start = F.struct(F.lit(False).alias("listed"), F.array().cast(_POSITIONS).alias("found"))

    def step(s: Column, x: Column) -> Column:
        inside_item = s["listed"] & x["indented"] & ~x["blank"] & ~x["item"]
        return F.struct((x["item"] | (s["listed"] & (x["blank"] | x["indented"]))).alias("listed"), F.when(inside_item, F.concat(s["found"], F.array(x["pos"].cast("int")))).otherwise(s["found"]).alias("found"))

    # Without an indented line there is none.
    return F.when(F.exists(lines, lambda x: x.startswith(" ") | x.startswith("\t")), F.aggregate(items, start, step, lambda s: s["found"])).otherwise(F.array().cast(_POSITIONS))


def fix_indent(text: Column, mode: str = "smart") -> Column:
    """Leading blanks as tabs: four spaces are one tab, strays go. ``smart`` leaves indents that may be structure,
    ``strict`` folds all, ``off`` none. Front matter and fenced code stay."""
    if mode == "off":
        return text

    def line(x: Column, i: Column, v: Column) -> Column:
        lead = F.regexp_extract(x, r"^([ \t]*)", 1)
        rest = F.substring(x, F.length(lead) + 1, F.length(x))
        folded = F.concat(F.replace(F.replace(lead, F.lit("    "), F.lit("\t")), F.lit(" "), F.lit("")), rest)
        if mode == "strict":
            return F.when((lead == "") | (rest == ""), x).otherwise(folded)
        odd = ~lead.contains("\t") & (F.length(lead) % 4 != 0)
        stray = (F.length(lead) <= 3) & ~x.rlike(_MARKER) & ~F.array_contains(v["nested"], i)
        return F.when((lead == "") | (rest == ""), x).when(odd, F.when(stray, rest).otherwise(x)).otherwise(folded)

    return map_lines(text, lambda x, i, v: F.when(begins(x, " \t"), line(x, i, v)).otherwise(x), code_ranges, nested=list_paragraphs)


def fix_markers(text: Column) -> Column:
    """One space after quote, list and heading markers; nested quotes in one form. Indents after ``>``, and quotes
    that belong to a list item, stay."""

    def line(x: Column, i: Column, v: Column) -> Column:
        quoted = F.regexp_replace(x, r"^ {1,3}(?=>)", "")
        marks = F.regexp_extract(quoted, r"^((?:>[ \t]?)+)", 1)
        rest = F.substring(quoted, F.length(marks) + 1, F.length(quoted))
        canonical = F.concat(F.rtrim(F.repeat(F.lit("> "), F.length(F.regexp_replace(marks, "[^>]", "")))), F.when(rest == "", "").otherwise(F.concat(F.lit(" "), rest)))
        y = F.when((marks != "") & ~F.array_contains(v["nested"], i), canonical).otherwise(x)
        y = F.regexp_replace(y, r"^([ \t]*(?:> )*[ \t]*(?:[-*+]|\d{1,9}[.)]))[ \t]{2,}(?=\S)", "$1 ")
        return F.regexp_replace(y, r"^([ \t]*#{1,6})[ \t]{2,}(?=\S)", "$1 ")

    return map_lines(text, lambda x, i, v: F.when(begins(x, " \t>-*+#0123456789"), line(x, i, v)).otherwise(x), lambda lines: F.concat(protected_ranges(lines), table_ranges(lines)), nested=list_paragraphs)


def fix_blank_lines(text: Column) -> Column:
    """Lines of blanks, no-break spaces among them, become empty."""
    return map_lines(text, lambda x: F.when(begins(x, " \t\x0b\f\r ") & x.rlike(r"^[\s ]+$"), F.lit("")).otherwise(x), code_ranges)


def headings(lines: Column) -> Column:
    """Headings outside code: structs of pos and level, in order."""
    found = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("#"), F.struct(i.alias("pos"), F.length(F.regexp_extract(x, HEADING, 2)).alias("level")))), lambda h: h["level"] > 0)
    return let(lambda v: F.filter(v["found"], lambda h: ~inside(v["kept"], h["pos"])), found=found, kept=protected_ranges(lines))


def fix_headings(text: Column) -> Column:
    """Each heading one level below its parent, from the levels as they were, the first heading being the base."""
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("base"), F.array().cast("array<struct<pos:int,level:int>>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        parents = F.filter(s["stack"], lambda x: x < h["level"])
        base = F.when(s["base"] == 0, h["level"]).otherwise(s["base"])
        level = F.least(F.lit(6), base + F.size(parents))
        return F.struct(F.concat(parents, F.array(h["level"])).alias("stack"), base.alias("base"), F.concat(s["out"], F.array(F.struct(h["pos"].alias("pos"), level.alias("level")))).alias("out"))

    new = lambda lines: F.map_from_entries(F.aggregate(headings(lines), start, step, lambda s: s["out"]))
    line = lambda x, i, v: F.when(x.contains("#") & F.map_contains_key(v["new"], i), F.concat(F.regexp_extract(x, HEADING, 1), F.repeat(F.lit("#"), F.try_element_at(v["new"], i)), F.regexp_replace(x, HEADING, ""))).otherwise(x)
    return only_if(lambda t: t.contains("#"), lambda t: map_lines(t, line, no_ranges, new=new), text)


def heading_outline(notes: DataFrame) -> DataFrame:
    """(note_id, line, level, title) of every heading."""
    lines = lines_of(F.col("text"))
    # No filter stands on a text or on what is made of it: Spark would compute both once more for it. So with explode_outer.
    rows = notes.select("note_id", lines.alias("_lines")).withColumn("_h", headings(F.col("_lines"))).select("note_id", "_lines", F.explode_outer("_h").alias("h")).where("h is not null")
    return rows.select("note_id", F.col("h.pos").alias("line"), "h.level", F.trim(F.regexp_replace(F.get("_lines", F.col("h.pos")), HEADING, "")).alias("title"))


def _items(lines: Column) -> Column:
    """All lines that matter to ordered lists: pos, item (number or null), width of the indent, quote marks, kind."""

    def one(x: Column, i: Column, kept: Column) -> Column:
        lead = F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1)
        rest = F.substring(x, F.length(lead) + 1, F.length(x))
        rest = F.when(lead != "", F.regexp_replace(rest, "^ ", "")).otherwise(rest)
        indent = F.regexp_extract(rest, r"^([ \t]*)", 1)
        width = F.length(F.replace(indent, F.lit("\t"), F.lit("    ")))
        number = F.regexp_extract(rest, r"^[ \t]*(\d{1,9})[.)][ \t]+\S", 1)
        closed = inside(kept, i)
        parsed = lambda number, width, quote, blank: F.struct(i.alias("pos"), number.alias("number"), width.alias("width"), quote.alias("quote"), blank.alias("blank"), closed.alias("closed"))
        plain = parsed(F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit(False))
        full = parsed(F.when(~closed & (number != ""), number.cast("int")), width, F.length(F.regexp_replace(lead, "[^>]", "")), is_blank(rest))
        return F.when(begins(x, " \t\r>0123456789"), full).otherwise(plain)

    return let(lambda v: F.transform(v["lines"], lambda x, i: one(x, i, v["kept"])), lines=lines, kept=F.concat(protected_ranges(lines), table_ranges(lines)))


_OPEN = "array<struct<width:int,quote:int,renumber:boolean,count:int>>"


def ordered_items(lines: Column) -> Column:
    """Ordered-list items with their new numbers: structs of pos, number, new. A list whose first number is not 1 is
    counted from 1; others keep theirs. Code and tables close all lists; an item closes wider ones; other text closes
    wider ones, and those as wide after a blank line; blank lines close none."""
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.lit(False).alias("blank"), F.array().cast("array<struct<pos:int,number:int,new:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        wider = lambda o: (o["width"] > x["width"]) & (o["quote"] == x["quote"])
        at = lambda o: (o["width"] == x["width"]) & (o["quote"] == x["quote"])
        still = F.filter(s["open"], lambda o: ~wider(o) & (o["quote"] <= x["quote"]))
        own = F.get(F.filter(still, at), F.lit(0))
        count = F.coalesce(own["count"], F.lit(0)) + 1
        renumber = F.coalesce(own["renumber"], x["number"] != 1)
        renewed = F.struct(x["width"].alias("width"), x["quote"].alias("quote"), renumber.alias("renumber"), count.alias("count"))
        item = F.struct(F.concat(F.filter(still, lambda o: ~at(o)), F.array(renewed)).alias("open"), F.lit(False).alias("blank"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), x["number"].alias("number"), F.when(renumber, count).otherwise(x["number"]).alias("new")))).alias("out"))
        left = F.filter(still, lambda o: ~(s["blank"] & at(o)))
        text = F.struct(left.alias("open"), F.lit(False).alias("blank"), s["out"].alias("out"))
        closed = F.struct(F.array().cast(_OPEN).alias("open"), F.lit(False).alias("blank"), s["out"].alias("out"))
        empty = F.struct(s["open"].alias("open"), F.lit(True).alias("blank"), s["out"].alias("out"))
        # Before a list is open only an item matters.
        return F.when((F.size(s["open"]) == 0) & x["number"].isNull(), s).when(x["closed"], closed).when(x["blank"], empty).when(x["number"].isNotNull(), item).otherwise(text)

    items = F.aggregate(_items(lines), start, step, lambda s: s["out"])
    return F.when(F.exists(lines, lambda x: begins(x, " \t>0123456789") & x.rlike(r"^[ \t>]*\d{1,9}[.)][ \t]")), items).otherwise(F.array().cast("array<struct<pos:int,number:int,new:int>>"))


def fix_lists(text: Column) -> Column:
    """Ordered lists numbered from 1 where their first number is not 1."""
    new = lambda lines: F.map_from_entries(F.transform(F.filter(ordered_items(lines), lambda x: x["number"] != x["new"]), lambda x: F.struct(x["pos"], x["new"])))
    number = r"^((?:[ \t]*>)*[ \t]*)\d{1,9}(?=[.)])"
    line = lambda x, i, v: F.when(F.map_contains_key(v["new"], i), F.concat(F.regexp_extract(x, number, 1), F.try_element_at(v["new"], i).cast("string"), F.regexp_replace(x, number, ""))).otherwise(x)
    return only_if(lambda t: t.rlike(r"(?m)^[ \t>]*\d{1,9}[.)][ \t]"), lambda t: map_lines(t, line, no_ranges, new=new), text)


def list_items(notes: DataFrame) -> DataFrame:
    """(note_id, line, number, new_number, style, width, quote_prefix) of every ordered-list item."""
    rows = notes.select("note_id", lines_of(F.col("text")).alias("_lines")).withColumn("_i", ordered_items(F.col("_lines"))).select("note_id", "_lines", F.explode_outer("_i").alias("i")).where("i is not null")
    x = F.get("_lines", F.col("i.pos"))
    quote = F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1)
    indent = F.regexp_extract(x, r"^(?:[ \t]*>)*([ \t]*)\d", 1)
    return rows.select("note_id", F.col("i.pos").alias("line"), "i.number", F.col("i.new").alias("new_number"), F.regexp_extract(x, r"\d([.)])", 1).alias("style"), F.length(F.replace(indent, F.lit("\t"), F.lit("    "))).alias("width"), quote.alias("quote_prefix"))


def line_classes(notes: DataFrame) -> DataFrame:
    """(note_id, line, is_code, is_indented, is_table, in_math) of every line of a note."""
    from notewright.functions.lines import math_ranges

    lines = lines_of(F.col("text"))
    rows = notes.select("note_id", lines.alias("_lines")).withColumns({"_code": code_ranges(F.col("_lines")), "_ind": indented_ranges(F.col("_lines")), "_tab": table_ranges(F.col("_lines"))}).withColumn("_math", math_ranges(F.col("_lines"), F.col("_code")))
    out = rows.select("note_id", "_code", "_ind", "_tab", "_math", F.posexplode("_lines").alias("line", "_x"))
    return out.select("note_id", "line", *[inside(F.col(c), F.col("line")).alias(a) for c, a in (("_code", "is_code"), ("_ind", "is_indented"), ("_tab", "is_table"), ("_math", "in_math"))])
