"""Spaces and the width of marks between Chinese, Latin, digits and formulas.

A line is cut into tokens once (``tokens``); one rule decides what stands between two neighbours. The rules are looked at in
the order of the branches of ``_between``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.lines import bound, first_of, free_names, inside, let, lines_of, math_ranges, protected_ranges, table_ranges
from notewright.functions.tokens import BLANK, HAN, HINT, LATIN, PROTECTED, SPECIAL, UNITS, is_kind, is_wordlike, token_steps

__all__ = ["HAN", "PROTECTED", "UNITS", "SpacingOptions", "chapter_space", "fix_spacing", "protected_spans"]


@dataclass(frozen=True)
class SpacingOptions:
    """space: one blank; none: no blank; keep: as it was. The others switch a rule."""

    cjk_latin: str = "space"
    cjk_digit: str = "none"
    latin_digit: str = "keep"
    math_text: str = "space"
    digit_unit: bool = False
    punctuation: bool = True
    symbols: bool = True
    brackets: bool = True
    context_width: bool = True
    chapters: bool = True


def _asked(rule: Column, other: Column) -> Column:
    """What a symbol's wish comes to against its neighbour: none, space, or nothing."""
    plain = (other["k"] == "S") & (other["l"] == "") & ~F.lit("/\\=+<>*~^_#@%$&|→×÷±≤≥≠").contains(F.substring(other["t"], 1, 1))
    content = F.when(rule == "latin", is_wordlike(other)).otherwise(is_kind(other, "LWDEMCP"))
    return first_of((F.lit("keep").contains(rule), ""), (rule == "none", "none"), (plain, ""), (content, "space"), otherwise="none")


def _between(a: Column, b: Column, gap: Column, o: SpacingOptions) -> Column:
    """What stands between two tokens that had ``gap`` between them."""
    blank = {"space": F.lit(" "), "none": F.lit(""), "keep": gap}
    pair = lambda x, y: (is_kind(a, x) & is_kind(b, y)) | (is_kind(a, y) & is_kind(b, x))
    first, last = F.substring(b["t"], 1, 1), F.substring(a["t"], -1, 1)
    a_mark, b_mark = is_kind(a, "FT"), is_kind(b, "FT")
    opening, closing = "（【「『〔〖｛［《〈“‘", "）】」』〕〗｝］》〉”’"
    quotes, angles = "“”‘’", "《〈"
    has = lambda marks, c: F.lit(marks).contains(c)
    english = (a["z"] == "en") | (b["z"] == "en")
    rules: list[tuple[Column, Column | str]] = []
    if o.symbols:
        # Full-width marks but brackets that open and quotes have rules of their own. Most tokens ask for nothing.
        own = (a_mark & ~has(opening + quotes, last)) | (b_mark & ~has(opening + quotes, first))
        asks = ~(has("keep", a["r"]) & has("keep", b["l"]))
        right, left = _asked(a["r"], b), _asked(b["l"], a)
        rules += [(asks & ~own & ((right == "none") | (left == "none")), ""), (asks & ~own & ((right == "space") | (left == "space")), " ")]
    if o.brackets:
        rules += [((a["k"] == "O") | (b["k"] == "P"), ""), (((b["k"] == "O") | (a["k"] == "P")) & ~english, "")]
    if o.punctuation:
        marked = first_of(
            (a_mark & has(closing, last) & is_kind(b, "LWEM"), " "),
            ((a_mark & has(opening, last)) | (b_mark & (has(closing, first) | ~has(quotes, first))), ""),
            (a_mark & ~has(quotes + angles, last), ""),
            otherwise=gap,
        )
        rules += [((a_mark | b_mark) & ~english, marked)]
    if o.digit_unit:
        rules += [(is_kind(a, "DE") & ((b["k"] == "U") | b["t"].isin(*UNITS)), F.lit(" "))]
    rules += [(pair("C", "LWE"), blank[o.cjk_latin]), (pair("C", "D"), blank[o.cjk_digit]), (pair("LW", "DE"), blank[o.latin_digit])]
    rules += [(((a["k"] == "M") & is_kind(b, "LWDEMC")) | ((b["k"] == "M") & is_kind(a, "LWDEMCP")), blank[o.math_text])]
    if o.punctuation:
        rules += [((a["k"] == "H") & is_kind(b, "LWDEMCP"), " "), ((b["k"] == "H") & is_kind(a, "LWDEMCP"), "")]
    return first_of(*rules, otherwise=gap)


#: Marks of emphasis in a row that are looked past.
_DEEP = 4


def _joined(x: Column, o: SpacingOptions) -> Column:
    """The tokens put together. Marks of emphasis belong to what they wrap, so spaces stand outside them: there is none after a mark
    that opens or before one that closes."""

    def near(i: Column, step: int, sign: int) -> Column:
        """The first token from ``i`` on that is no mark of emphasis of that sign."""
        out = F.get(x, i + step * _DEEP)
        for k in range(_DEEP - 1, -1, -1):
            out = F.when(F.get(x, i + step * k)["e"] == sign, out).otherwise(F.get(x, i + step * k))
        return out

    def one(t: Column, i: Column) -> Column:
        apart = (i > 0) & (t["e"] != -1) & (F.get(x, i - 1)["e"] != 1)
        between = lambda w: F.when(w["a"].isNull() | w["b"].isNull(), "").otherwise(_between(w["a"], w["b"], w["g"], o))
        b = F.when(t["e"] == 1, near(i, 1, 1)).otherwise(t)
        return F.concat(F.when(apart, bound(between, a=near(i - 1, -1, -1), b=b, g=t["g"])).otherwise(""), t["t"])

    return F.array_join(F.transform(x, one), "")


def chapter_space(line: Column) -> Column:
    """A blank after a chapter's number at the head of a line, unless a connector or a mark follows."""
    return F.regexp_replace(line, r"^([ \t]*(?:#{1,6}[ \t]+|(?:[-*+]|\d{1,9}[.)])[ \t]+)?(?:第[一二三四五六七八九十百零〇两\d]+[章节课讲篇]|附录[A-Z]))(?=[\p{IsHan}A-Za-z$])(?![的和与及至到或中里内])", "$1 ")


#: Lines of Latin words with marks in their places have nothing to change and are not cut. Each branch begins with a rare
#: character, so that most characters are passed by at once.
_MIXED = (
    r"[\u2010-\u206f→|^$&\"°\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\x{20000}-\x{3ffff}]"
    rf"|[,.!?:)](?:(?<={BLANK}.)|(?<=[{LATIN})\]*_=~`>].|[0-9][,!?])(?=[{LATIN}0-9($`\[*_=~]))"
    rf"|[(](?:(?={BLANK})|(?<={BLANK}.))|[.]{{2}}"
)
_LEAD = r"^([ \t]*(?:>[ \t]?)*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?|#{1,6}[ \t]+)?)"


def _on_cut_lines(tokens: str, step: Callable[[Column], Column]) -> Column:
    return F.transform(tokens, lambda x: F.when(x.isNotNull(), step(x)))


def fix_spacing(notes: DataFrame, o: SpacingOptions = SpacingOptions(), text_col: str = "text") -> DataFrame:
    """Notes with the spaces, marks and widths of every line put right but in code, tables and formula blocks. Null stays null.

    A chain of projections without a shuffle. Most lines of Latin words hold nothing to change and are not cut.
    """
    mixed = _MIXED + (r"|\d" if o.digit_unit or o.latin_digit != "keep" else "")

    def skip(lines: Column) -> Column:
        return let(lambda v: F.concat(v["kept"], table_ranges(v["lines"]), math_ranges(v["lines"], v["kept"])), lines=lines, kept=protected_ranges(lines))

    def cut(v: Column) -> Column:
        """Lines in their head (marks of quotes, items and headings), the part that is cut (null: none) and the blanks after it."""

        def parts(w: Column) -> Column:
            tail = F.substring(w["x"], F.length(w["bare"]) + 1, F.length(w["x"]))
            body = F.substring(w["bare"], F.length(w["head"]) + 1, F.length(w["bare"]))
            return F.when(w["head"] != w["x"], F.struct(w["head"].alias("head"), body.alias("body"), tail.alias("tail")))

        def one(x: Column, i: Column) -> Column:
            changed = bound(parts, x=x, head=F.regexp_extract(x, _LEAD, 1), bare=F.rtrim(x, F.lit(BLANK[1:-1].replace("\\t", "\t"))))
            return F.struct(x.alias("line"), F.when(x.rlike(mixed) & ~inside(v["kept"], i), changed).alias("cut"))

        return F.transform(v["lines"], one)

    lines, tokens = free_names(notes, "_lines", "_tokens")
    split = F.split(F.col(text_col), "\n")
    out = notes.withColumn(lines, F.when(F.col(text_col).rlike(mixed), let(lambda w: let(cut, lines=w["x"], kept=skip(w["x"])), x=split)))
    out = out.withColumn(tokens, F.transform(lines, lambda x: x["cut"]["body"]))
    *steps, last = token_steps(o.context_width, o.digit_unit)
    for step in [*steps, lambda x: bound(lambda v: _joined(v["x"], o), x=last(x))]:
        out = out.withColumn(tokens, _on_cut_lines(tokens, step))
    # Most lines name no chapter, and no pattern is tried on them.
    chapter = lambda x: F.when(x.contains("第") | x.contains("附录"), chapter_space(x)).otherwise(x) if o.chapters else x
    joined = F.zip_with(lines, tokens, lambda x, t: F.when(t.isNull(), x["line"]).otherwise(bound(lambda w: chapter(w["x"]), x=F.concat(x["cut"]["head"], t, x["cut"]["tail"]))))
    return out.withColumn(text_col, F.coalesce(F.array_join(joined, "\n"), text_col)).drop(lines, tokens)


def _span_kind(span: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PROTECTED.items()):
        out = F.when(span.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def protected_spans(notes: DataFrame) -> DataFrame:
    """(note_id, line, kind, ord, span, start, end): parts of lines that text jobs leave alone, from left to right and apart
    from one another: what begins inside a span is part of it. Places are characters from 0, the end excluded; code blocks
    are not searched."""
    lines = lines_of(F.col("text"))
    rows = notes.where(F.col("text").isNotNull()).withColumn("_code", protected_ranges(lines)).select("note_id", "_code", F.posexplode(lines).alias("line", "_x")).where(~inside(F.col("_code"), F.col("line")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<span:string,start:int,end:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["span"])
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(x["span"].alias("span"), begin.alias("start"), end.alias("end")))).alias("found"))

    def placed(v: Column) -> Column:
        # One match more than gaps: what follows the last span is left out.
        pairs = F.filter(F.arrays_zip(v["gap"], v["span"]), lambda x: x["span"].isNotNull())
        return F.aggregate(pairs, start, step, lambda s: s["found"])

    found = let(placed, gap=F.split(F.col("_x"), SPECIAL, -1), span=F.regexp_extract_all("_x", F.lit(f"({SPECIAL})"), F.lit(1)))
    spans = rows.where(F.col("_x").rlike(HINT)).select("note_id", "line", F.posexplode(found).alias("ord", "s"))
    return spans.select("note_id", "line", _span_kind(F.col("s.span")).alias("kind"), "ord", "s.span", "s.start", "s.end")
