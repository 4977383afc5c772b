"""The whole layout of a corpus: all steps in their order, repeated on notes that still change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.formulas import declared, symbols_to_commands, wrap_variables
from notewright.functions.lines import let
from notewright.functions.spacing import SpacingOptions, fix_spacing
from notewright.functions.tags import tag_layout
from notewright.functions.typeset import fix_blank_lines, fix_headings, fix_indent, fix_lists, fix_markers
from notewright.operators.blocks import sorted_blocks
from notewright.operators.chat import ChatOptions, is_chat_log, render_chat
from notewright.operators.forum import FLOOR, ForumOptions, floors, is_forum_dump, render_threads
from notewright.session import table_scope, written

MOST_PASSES = 5


@dataclass(frozen=True)
class LayoutOptions:
    """What a layout run does; the defaults leave out what rearranges text."""

    indent: str = "smart"
    lists: bool = True
    headings: bool = True
    variables: bool = True
    spacing: SpacingOptions | None = field(default_factory=SpacingOptions)
    tags: bool = False
    sort_tags: bool = True
    sort_blocks: bool = False
    chat: ChatOptions | None = field(default_factory=ChatOptions)
    forum: ForumOptions | None = field(default_factory=ForumOptions)
    as_of: str = "2024-01-01"


def _letters(x: Column) -> Column:
    return F.when(x.contains("$"), declared(x)).otherwise(F.array().cast("array<string>"))


def _rest(notes: DataFrame, o: LayoutOptions) -> DataFrame:
    """The steps after chats and threads, all of them projections."""
    t = F.col("text")
    out = notes.withColumn("text", fix_lists(t)) if o.lists else notes
    out = out.withColumn("text", fix_headings(t)) if o.headings else out
    if o.variables:
        out = out.withColumn("text", symbols_to_commands(let(lambda v: wrap_variables(v["x"], _letters(v["x"])), x=t)))
    out = fix_spacing(out, o.spacing) if o.spacing else out
    out = out.withColumn("text", fix_blank_lines(t))
    out = out.withColumn("text", tag_layout(t, o.sort_tags)) if o.tags else out
    # Written, or Spark would make one expression of all steps, which it does not end to plan.
    return written(out, "pass").withColumn("text", sorted_blocks(t)) if o.sort_blocks else out


def _is_dump(text: Column) -> Column:
    # Most notes hold no header of a floor and are not looked at again.
    return F.coalesce(text.contains(" - ") & text.rlike(rf"(?m)^{FLOOR}$") & is_forum_dump(text), F.lit(False))


def _instead(notes: DataFrame, laid: DataFrame) -> DataFrame:
    """The notes with the texts ``laid`` (_n, _text) where they have one."""
    return notes.join(laid, F.col("note_id") == F.col("_n"), "left").withColumn("text", F.coalesce("_text", "text")).drop("_n", "_text")


def one_pass(notes: DataFrame, o: LayoutOptions) -> DataFrame:
    """Notes with text laid out once. Each step is a projection; chat logs and threads alone are shuffled, by note. Indented and
    marked texts are written with what kind they are, so that no step before is computed twice and other notes meet no join."""
    t = F.col("text")
    out = notes.withColumn("text", fix_indent(t, o.indent))
    out = out.withColumn("text", fix_markers(t)) if o.indent != "off" else out
    if not (o.chat or o.forum):
        return _rest(out, o)
    log = F.coalesce(is_chat_log(t), F.lit(False)) if o.chat else F.lit(False)
    dump = _is_dump(t) if o.forum else F.lit(False)
    typed = written(out.withColumn("_log", log).withColumn("_dump", ~F.col("_log") & dump), "pass")
    plain, dumps = typed.where(~F.col("_log") & ~F.col("_dump")).drop("_log", "_dump"), typed.where("_dump").drop("_log", "_dump")
    logs = typed.where("_log").drop("_log", "_dump")
    if o.chat and not logs.isEmpty():
        chats = render_chat(logs, o.as_of, o.chat).select(F.col("note_id").alias("_n"), F.col("new_text").alias("_text"))
        laid = written(_instead(logs, chats).withColumn("_dump", _is_dump(t) if o.forum else F.lit(False)), "pass")
        plain, dumps = plain.union(laid.where("not _dump").drop("_dump")), dumps.union(laid.where("_dump").drop("_dump"))
    if o.forum and not dumps.isEmpty():
        posts = dumps.select(F.col("note_id").alias("topic"), "text")
        before = posts.select("topic", F.regexp_replace(F.element_at(F.split("text", rf"(?m)(?=^{FLOOR}$)", 2), 1), r"\s+$", "").alias("_before"))
        threads = render_threads(floors(posts), o.forum).join(before, "topic").select(F.col("topic").alias("_n"), F.concat_ws("\n\n", F.when(~F.col("_before").rlike(rf"^(?:{FLOOR})?$"), F.col("_before")), "text").alias("_text"))
        plain = plain.union(written(_instead(dumps, threads), "pass"))
    return _rest(plain, o)


def typeset(notes: DataFrame, options: LayoutOptions = LayoutOptions()) -> DataFrame:
    """Notes with new_text: passes until no note changes, five at most; a pass takes only notes that the last one changed, and each
    text travels beside the one that it was."""
    work = notes.select("note_id", "text")
    done: list[DataFrame] = []
    for k in range(MOST_PASSES):
        with table_scope() as tables:
            after = written(one_pass(work.withColumn("_old", F.col("text")), options).select("note_id", "text", "_old"), "pass")
            tables.keep(after)
        changed = ~F.col("text").eqNullSafe(F.col("_old"))
        done.append(after.where(~changed if k < MOST_PASSES - 1 else F.lit(True)).select("note_id", "text"))
        work = after.where(changed).select("note_id", "text")
        if k == MOST_PASSES - 1 or work.isEmpty():
            break
    final = done[0]
    for d in done[1:]:
        final = final.union(d)
    return notes.join(final.select(F.col("note_id").alias("_n"), F.col("text").alias("new_text")), F.col("note_id") == F.col("_n"), "left").drop("_n")
