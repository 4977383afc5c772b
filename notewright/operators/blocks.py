"""Blocks of a note, and their order inside a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.lines import bound, first_of, inside, lines_of, protected_ranges
from notewright.functions.tags import collation_key
from notewright.operators.chat import HEADER


def _kind(x: Column) -> Column:
    """The kind of a line. A pattern is tried only where the first character after the indent, or a colon, lets it match."""

    def by(first: Column) -> Column:
        may = lambda marks: F.lit(marks).contains(first)
        return first_of(
            (may("\x0b\f\r\u0085\u2028\u2029") & x.rlike(r"^\s*$"), "blank"),
            (may("#-*_|!<[") & x.rlike(r"^[ \t]*(?:#{1,6}(?:[ \t]|$)|(?:-{3,}|\*{3,}|_{3,})[ \t]*$|\||!\[|<|\[\^[^\]]+\]:)"), "barrier"),
            (x.contains(":") & x.rlike(rf"^[ \t]*{HEADER}"), "chat"),
            (first == ">", "quote"),
            (may("-*+0123456789") & x.rlike(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]"), "item"),
            otherwise="paragraph",
        )

    return bound(lambda v: by(v["first"]), first=F.substring(F.ltrim(x, F.lit(" \t")), 1, 1))


def sort_key(lines: Column) -> Column:
    """The first line without indent, quote and list marks, checkbox and leading symbols."""
    return F.regexp_replace(lines[0], r"^[ \t]*(?:>[ \t]?)*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+)?(?:\[[ xX]\][ \t]+)?[#>*_~`\s]*", "")


def _typed(lines: Column) -> Column:
    """The lines x with their kinds; protected lines are barriers."""
    one = lambda x, i, v: F.struct(x.alias("x"), F.when(inside(v["code"], i), "barrier").otherwise(_kind(x)).alias("kind"))
    return bound(lambda v: F.transform(v["lines"], lambda x, i: one(x, i, v)), lines=lines, code=protected_ranges(lines))


def _starts(typed: Column) -> Column:
    """Places of the lines that begin a block. A line joins the paragraph or quote before it; indented text and indented items
    join an item and what belongs to it."""

    def one(t: Column, i: Column) -> Column:
        before = F.get(typed, i - 1)["kind"]
        indented = t["x"].startswith(" ") | t["x"].startswith("\t")
        runs = (t["kind"] == before) & t["kind"].isin("paragraph", "quote")
        owned = ((before == "item") & (t["kind"] == "paragraph") & indented) | ((t["kind"] == "item") & before.isin("item", "paragraph") & indented)
        return F.when(F.coalesce(runs | owned, F.lit(False)), F.lit(None)).otherwise(i)

    return F.filter(F.transform(typed, one), lambda i: i.isNotNull())


def _parts(x: Column, starts: Column) -> Column:
    """An array cut at ``starts``."""
    return bound(lambda v: F.transform(v["s"], lambda b, k: F.slice(v["x"], b + 1, F.coalesce(F.get(v["s"], k + 1), F.size(v["x"])) - b)), x=x, s=starts)


def _blocks(text: Column) -> Column:
    """The blocks of a text in order: structs of kind and lines."""
    block = lambda b: F.struct(b[0]["kind"].alias("kind"), F.transform(b, lambda t: t["x"]).alias("lines"))
    return F.transform(bound(lambda v: bound(lambda w: _parts(w["t"], _starts(w["t"])), t=_typed(v["lines"])), lines=lines_of(text)), block)


def blocks(notes: DataFrame) -> DataFrame:
    """(note_id, seq, kind, key, lines): runs of lines that belong together; seq grows down a note. An item takes its indented lines with it;
    paragraphs and quotes run to a line of another kind; blank lines and barriers stand alone; protected lines are
    barriers. A note is read in its row, by steps that grow with its lines, and nothing is shuffled."""
    rows = notes.where(F.col("text").isNotNull()).select("note_id", F.posexplode_outer(_blocks(F.col("text"))).alias("seq", "b"))
    return rows.select("note_id", F.col("seq").cast("long").alias("seq"), "b.kind", sort_key(F.col("b.lines")).alias("key"), "b.lines")


_NUMBER = r"^[ \t]*(?:>[ \t]?)*(\d{1,9})[.)]"


def _sorted_segment(segment: Column) -> Column:
    """The lines of a run of sortable blocks of one kind, in their order. Items that were counted one by one are counted anew."""

    def keyed(b: Column, i: Column) -> Column:
        number = F.regexp_extract(b["lines"][0], _NUMBER, 1)
        by = bound(lambda v: collation_key(v["key"]), key=sort_key(b["lines"]))
        return F.struct(by.alias("by"), i.alias("i"), F.when(number != "", number.cast("int")).alias("number"), b["lines"].alias("lines"))

    def counted(v: Column) -> Column:
        numbers, low = v["numbers"], F.array_min(v["numbers"])
        run = (F.size(numbers) > 1) & (F.size(numbers) == F.size(v["b"])) & (F.array_max(numbers) - low + 1 == F.size(numbers)) & (F.size(F.array_distinct(numbers)) == F.size(numbers))
        return F.struct(v["b"].alias("b"), F.when(run, low).alias("low"))

    def lines(v: Column) -> Column:
        anew = lambda x, k: F.concat(F.regexp_extract(x, r"^([ \t]*(?:>[ \t]?)*)\d", 1), (v["low"] + k).cast("string"), F.regexp_replace(x, r"^[ \t]*(?:>[ \t]?)*\d{1,9}(?=[.)])", ""))
        return F.flatten(F.transform(v["b"], lambda b, k: F.transform(b["lines"], lambda x, i: F.when((i == 0) & v["low"].isNotNull(), anew(x, k)).otherwise(x))))

    ordered = bound(lambda v: F.struct(v["b"].alias("b"), F.filter(F.transform(v["b"], lambda b: b["number"]), lambda n: n.isNotNull()).alias("numbers")), b=F.sort_array(F.transform(segment, keyed)))
    return bound(lambda v: bound(lambda w: lines(w["c"]), c=counted(v["o"])), o=ordered)


def sorted_blocks(text: Column) -> Column:
    """The text with consecutive blocks of one kind in the collated order of their keys, between blank lines and barriers that
    stay. Items that were counted one by one are counted anew. Null stays null."""
    sortable = lambda b: b["kind"].isin("item", "paragraph", "quote")
    # Runs of one sortable kind. Only those of several blocks are put in order: neighbouring paragraphs and quotes are one block.
    starts = lambda b: F.filter(F.transform(b, lambda x, i: F.when((i > 0) & sortable(x) & (F.get(b, i - 1)["kind"] == x["kind"]), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
    laid = lambda s: F.when(F.size(s) > 1, _sorted_segment(s)).otherwise(s[0]["lines"])
    segments = bound(lambda v: _parts(v["b"], starts(v["b"])), b=_blocks(text))
    return F.when(text.isNotNull(), F.array_join(F.flatten(F.transform(segments, laid)), "\n"))


def sort_blocks(notes: DataFrame) -> DataFrame:
    """(note_id, new_text) of notes that hold a text: its ``sorted_blocks``. A projection, without a shuffle."""
    return notes.where(F.col("text").isNotNull()).select("note_id", sorted_blocks(F.col("text")).alias("new_text"))
