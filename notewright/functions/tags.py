"""Tags of a note, their layout, and the collated order of Chinese and Latin text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.lines import INLINE_CODE, inside, let, lines_of, only_if, protected_ranges

TAG = r"(?:^|(?<=[ \t　]))#([\p{L}\p{N}_][\p{L}\p{N}_\-/]*)"
_HIDDEN = (INLINE_CODE, r"!?\[\[[^\]\n]*\]\]", r"!?\[[^\]\n]*\]\([^)\n]*\)", r"<!--[\s\S]*?-->", r"%%[\s\S]*?%%", r"\$[^$\n]+\$")


def blanked(text: Column) -> Column:
    """The text with code, links, comments and formulas as runs of a neutral mark, so that no tag is seen in them."""
    for pattern in _HIDDEN:
        text = F.regexp_replace(text, pattern, "\u0001")
    return text


def tag_list(line: Column) -> Column:
    """Tags of a line in order, as they are written: a letter is needed, and - or / at the end is cut."""
    found = F.regexp_extract_all(blanked(line), F.lit(TAG), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"[-/]+$", "")), lambda t: t.rlike(r"\p{L}"))


def note_tags(notes: DataFrame) -> DataFrame:
    """(note_id, line, ord, tag) of every tag outside code, links and comments."""
    lines = lines_of(F.col("text"))
    rows = notes.where(F.col("text").contains("#")).withColumn("_code", protected_ranges(lines)).select("note_id", "_code", F.posexplode(lines).alias("line", "_x"))
    rows = rows.where(F.col("_x").contains("#") & ~inside(F.col("_code"), F.col("line")))
    return rows.select("note_id", "line", F.posexplode(tag_list(F.col("_x"))).alias("ord", "tag"))


def collation_key(text: Column) -> Column:
    """Orders as a Chinese collator with numbers by value does: pinyin, case and accents apart. A number of any length is written
    as how many digits it has (six digits hold that) and the digits, without leading zeros."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def part(x: Column) -> Column:
        bare = F.ltrim(x, F.lit("0"))
        digits = F.when(bare == "", "0").otherwise(bare)
        return F.when(F.lit("0123456789").contains(F.substring(x, 1, 1)), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(x)

    return F.collate(F.when(text.rlike(r"\d"), F.array_join(F.transform(runs, part), "")).otherwise(text), "zh_CI_AI")


def sorted_tags(tags: Column) -> Column:
    """Distinct tags in collated order, ties in the order they came."""
    keyed = F.transform(F.array_distinct(tags), lambda t, i: F.struct(collation_key(t).alias("k"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def _without_tags(body: Column) -> Column:
    """The text of a line without its tags; marks close up to the word before. Hidden parts keep their places."""
    hidden = F.regexp_extract_all(body, F.lit("(" + "|".join(p.replace(r"\1", r"\2") for p in _HIDDEN) + ")"), F.lit(1))
    parts = F.split(body, "|".join(_HIDDEN))
    bare = lambda x: F.regexp_replace(x, r"(?:^|(?<=[ \t　]))#(?=[\p{L}\p{N}_\-/]*\p{L})[\p{L}\p{N}_](?:[\p{L}\p{N}_\-/]*[\p{L}\p{N}_])?", "\u0002")
    joined = F.array_join(F.zip_with(F.transform(parts, bare), F.concat(hidden, F.array(F.lit(""))), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    text = F.regexp_replace(joined, "[ \t　]*\u0002(?=[^\\p{L}\\p{N}\\s\u0002#])", "")
    return F.trim(F.regexp_replace(text, "[ \t　]*\u0002[ \t　]*", " "))


def _written(tags: Column, sort: bool) -> Column:
    tags = F.array_distinct(tags)
    return F.array_join(F.transform(sorted_tags(tags) if sort else tags, lambda t: F.concat(F.lit("#"), t)), " ")


def _cell(body: Column, sort: bool) -> Column:
    """One cell of a table, or a block of one line, with its tags at the end, one blank before them."""
    text, end = _without_tags(body), _written(tag_list(body), sort)
    return F.when(end == "", body).when(~text.rlike(r"\S"), end if sort else F.trim(body)).otherwise(F.concat(text, F.lit(" "), end))


def _block(lines: Column, sort: bool) -> Column:
    """The lines of a paragraph (structs of line, marker, body) with the tags of all of them at its end. A line of tags only leaves
    an empty line behind, unless it is the last one; in a block of tags only they stay in their lines."""
    parted = F.transform(lines, lambda x: F.struct(x["marker"].alias("marker"), x["body"].alias("body"), _without_tags(x["body"]).alias("text"), tag_list(x["body"]).alias("tags")))

    def laid(v: Column) -> Column:
        last = F.size(v["p"]) - 1
        body = lambda x, i: F.when(F.size(x["tags"]) > 0, x["text"]).when(i < last, x["body"]).otherwise(F.rtrim(x["body"]))
        end = lambda x, i: F.when(i < last, "").otherwise(F.concat(F.when(x["text"] == "", "").otherwise(" "), v["end"]))
        moved = F.transform(v["p"], lambda x, i: F.concat(x["marker"], body(x, i), end(x, i)))
        kept = F.transform(v["p"], lambda x: F.concat(x["marker"], _cell(x["body"], sort)))
        return F.when(v["end"] == "", F.transform(v["p"], lambda x: F.concat(x["marker"], x["body"]))).when(F.exists(v["p"], lambda x: x["text"] != ""), moved).otherwise(kept)

    return let(lambda v: let(laid, p=v["p"], end=_written(F.flatten(v["p"]["tags"]), sort)), p=parted)


def tag_layout(text: Column, sort: bool = True) -> Column:
    """Tags moved to the end of their block, distinct, and sorted if asked. A heading and an item are blocks, and so are
    plain lines that follow one another with the same marks of quotation before them; in a row that begins with a bar each cell
    is one; other lines with two bars or more stay. Blocks that hold nothing but tags keep them where they are."""

    def typed(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            quote = F.regexp_extract(x, r"^([ \t]*(?:>[ \t]*)*)", 1)
            marker = F.regexp_extract(x, r"^([ \t]*(?:>[ \t]*)*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?|#{1,6}[ \t]+)?)", 1)
            stays = inside(v["kept"], i) | (quote == x)
            kind = F.when(stays, "stays").when(marker != quote, "alone").when(F.substring(x, F.length(quote) + 1, 1) == "|", "row").when(F.size(F.split(x, r"\|")) > 2, "stays").otherwise("plain")
            return F.struct(x.alias("line"), kind.alias("kind"), marker.alias("marker"), F.substring(x, F.length(marker) + 1, F.length(x)).alias("body"))

        return F.transform(v["lines"], one)

    def blocks(v: Column) -> Column:
        before = lambda i: F.get(v["x"], i - 1)
        starts = F.filter(F.transform(v["x"], lambda x, i: F.when((i == 0) | (x["kind"] != "plain") | (before(i)["kind"] != "plain") | (before(i)["marker"] != x["marker"]), i)), lambda i: i.isNotNull())
        return let(lambda w: F.transform(w["s"], lambda b, k: F.slice(w["x"], b + 1, F.coalesce(F.get(w["s"], k + 1), F.size(w["x"])) - b)), x=v["x"], s=starts)

    def row(x: Column) -> Column:
        cells = F.split(x["body"], r"(?<!\\)\|")
        return F.array(F.concat(x["marker"], F.array_join(F.transform(cells, lambda c: F.when(c.contains("#") & (F.trim(c) != ""), F.concat(F.lit(" "), _cell(F.trim(c), sort), F.lit(" "))).otherwise(c)), "|")))

    def laid(b: Column) -> Column:
        kind = b[0]["kind"]
        return F.when((kind == "stays") | ~F.exists(b, lambda x: x["body"].contains("#")), F.transform(b, lambda x: x["line"])).when(kind == "row", row(b[0])).when(kind == "alone", F.array(F.concat(b[0]["marker"], _cell(b[0]["body"], sort)))).otherwise(_block(b, sort))

    def change(t: Column) -> Column:
        lines = let(lambda v: let(typed, lines=v["lines"], kept=protected_ranges(v["lines"])), lines=F.split(t, "\n"))
        return F.array_join(F.flatten(F.transform(let(blocks, x=lines), laid)), "\n")

    return only_if(lambda t: t.contains("#"), change, text)
