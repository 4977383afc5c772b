"""Chat logs: messages, their order, runs of one sender, and the tidy text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.operators.ranks import numbered_rows, ranged, running_total, with_previous
from notewright.session import written

_SENDER = r"(?!(?:\d{1,4}[-/])?\d{1,2}[-/]\d{1,2}:?\s)[^\n\[\]\s:|：]+"
_TIME = r"(?<!\d)(?:(?:\d{1,4}[-/])?\d{1,2}[-/]\d{1,2}:?\s+)?\d{1,2}:\d{2}:\d{2}"
HEADER = rf"{_SENDER}\s*[:：]?\s*{_TIME}"
_START = rf"(?<![^\n\[\]\s:|：])(?={HEADER})"
_IMAGE = r"(?i)!\[\[[^\]\n]*?\.(?:png|jpg|jpeg|gif|bmp|webp|heic)(?:\|[^\]\n]*)?\]\]|!\[[^\]\n]*\]\([^)\n]*\)"
MENTION = r"(?<![^\s])[@＠][^\s@＠]+[ \t]*"


@dataclass(frozen=True)
class ChatOptions:
    """How a log is written. The defaults are those of the whole-note job; ``pure`` keeps bodies only."""

    show_user: bool = True
    show_date: bool = True
    show_time: bool = True
    indent: str = "tab"
    image_order: str = "keep"
    blank_line: bool = False
    sort_by_time: bool = True
    strip_mentions: bool = False
    merge_same_user: bool = True

    def body_indent(self) -> str:
        return {"tab": "\t", "2": "  ", "4": "    ", "none": ""}.get(self.indent, "\t")


PURE = ChatOptions(show_user=False, show_date=False, show_time=False)


def _pieces(text: Column) -> Column:
    return F.split(text, _START)


def messages(notes: DataFrame, as_of: str) -> DataFrame:
    """One row a piece of a log: note_id, seq, user, date, time, has_date, key, body (lines), tail.

    A header is a word before a timestamp (Y-M-D, M-D or no date, then H:MM:SS). Its body runs to a blank line, the next
    header or the end; what follows is the tail. Text before the first header is a row without a user. Dates without a
    year take the year of ``as_of`` (YYYY-MM-DD), times alone its day, and then has_date is false.
    """
    rows = notes.where(F.col("text").rlike(r"\d:\d{2}:\d{2}")).where(F.col("text").rlike(HEADER)).select("note_id", F.posexplode(_pieces(F.col("text"))).alias("seq", "_p")).where("_p <> ''")
    stamp = F.regexp_extract("_p", rf"^{_SENDER}\s*[:：]?\s*({_TIME})", 1)
    is_message = F.col("_p").rlike(rf"^{HEADER}")
    day = F.regexp_extract("_stamp", r"^([\d/-]*?):?\s+", 1)
    parts = F.split("_day", "[-/]")
    n = F.when(F.col("_day") == "", 0).otherwise(F.size(parts))
    year = F.when(n == 3, F.when(F.length(parts[0]) <= 2, F.concat(F.lit("20"), F.lpad(parts[0], 2, "0"))).otherwise(F.lpad(parts[0], 4, "0"))).otherwise(as_of[:4])
    month, dom = F.when(n == 3, F.get(parts, F.lit(1))).otherwise(parts[0]), F.when(n == 3, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    date = F.when(n == 0, as_of.replace("-", "/")).otherwise(F.concat_ws("/", year, F.lpad(month, 2, "0"), F.lpad(dom, 2, "0")))
    hms = F.split(F.regexp_extract("_stamp", r"(\d{1,2}:\d{2}:\d{2})$", 1), ":")
    time = F.concat_ws(":", F.lpad(hms[0], 2, "0"), hms[1], hms[2])
    rest = F.expr("substring(_p, length(_head) + 1)")
    parsed = rows.withColumns({"_stamp": F.when(is_message, stamp), "_head": F.when(is_message, F.regexp_extract("_p", rf"^({HEADER})", 1)).otherwise("")})
    parsed = parsed.withColumns({"_day": day, "_rest": F.regexp_replace(rest, r"^\s*[:：](?!\d)", "")})
    # The body stops at the first blank line that follows some text.
    cut = F.regexp_extract("_rest", r"^(\s*(?:[^\n]*\S[^\n]*(?:\n|$))*)", 1)
    parsed = parsed.withColumns({"_cut": F.when(is_message, cut).otherwise("")})
    body = F.filter(F.transform(F.split("_cut", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    out = parsed.withColumns({"user": F.when(is_message, F.regexp_extract("_head", rf"^({_SENDER})\s*[:：]?\s*{_TIME}$", 1)), "date": F.when(is_message, date), "time": F.when(is_message, time), "has_date": F.when(is_message, n > 0), "body": body, "tail": F.expr("substring(_rest, length(_cut) + 1)")})
    digits = F.regexp_replace(F.concat(F.when(F.col("has_date"), F.col("date")).otherwise(""), F.col("time")), r"\D", "")
    return out.withColumn("key", digits.cast("long")).select("note_id", F.col("seq").cast("long").alias("seq"), "user", "date", "time", "has_date", "key", "body", F.when(F.col("user").isNull(), F.col("_p")).otherwise(F.col("tail")).alias("tail"))


def is_chat_log(text: Column) -> Column:
    """One dated header with text after it, or a time that ends its line with text below; else any two headers."""
    dated = rf"{_SENDER}\s*[:：]?\s*(?<!\d)(?:\d{{1,4}}[-/])?\d{{1,2}}[-/]\d{{1,2}}:?\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s*[:：]?[^\n]*\S|{_SENDER}\s*[:：]?\s*(?<!\d)(?:\d{{1,4}}[-/])?\d{{1,2}}[-/]\d{{1,2}}:?\s+\d{{1,2}}:\d{{2}}:\d{{2}}\s*\n\s*\S"
    alone = rf"{_SENDER}\s*[:：]?\s*(?<!\d)\d{{1,2}}:\d{{2}}:\d{{2}}[ \t]*\n[ \t]*\S"
    timed = text.rlike(r"\d:\d{2}:\d{2}")  # most texts hold no time, and need no other search
    return F.when(timed, text.rlike(dated) | text.rlike(alone) | (F.regexp_count(text, F.lit(HEADER)) >= 2)).otherwise(F.lit(False))


def time_ordered(msgs: DataFrame) -> DataFrame:
    """Adds place: the order of messages when each run with comparable times is sorted. A run ends where its
    tail, or that of the row before, holds text; it stays as it is if a time is missing or only some have dates.

    A log of any length is cut into ranges; its runs are numbered by a running total and sorted by one numbering of all rows.
    """
    cut = with_previous(ranged(msgs, ["note_id", "seq"]), ["note_id"], ["note_id", "seq"], ["tail", "user"], "_before")
    # A row that is no message, or that ends in text, parts what comes before and after it.
    breaks = (F.col("_before.tail").rlike(r"\S") | F.col("_before.user").isNull() | F.col("user").isNull()).cast("int")
    runs = written(running_total(cut, ["note_id", "seq"], F.coalesce(breaks, F.lit(1)), "_run").drop("_before", "_range"), "runs")
    comparable = (F.count(F.when(F.col("key").isNull(), 1)) == 0) & (F.min("has_date") == F.max("has_date"))
    stats = runs.groupBy(F.col("_run").alias("_stats_run")).agg(comparable.alias("_ok"), F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_size"), F.max_by("tail", "seq").alias("_tail"))
    sortable = runs.join(stats, F.col("_run") == F.col("_stats_run")).drop("_stats_run").withColumn("_by", F.when(F.col("_ok"), F.col("key")))
    numbered = numbered_rows(sortable, ["_run", "_by", "seq"], "_at")
    starts = numbered.groupBy(F.col("_run").alias("_s")).agg(F.min("_at").alias("_start"))
    ranked = numbered.join(starts, F.col("_run") == F.col("_s")).withColumn("_rank", F.col("_at") - F.col("_start") + 1)
    placed = ranked.withColumn("place", F.col("_last") - F.col("_size") + F.col("_rank"))
    # The run's text after it stays behind its new last message.
    tail = F.when(F.col("user").isNull(), F.col("tail")).when(F.col("_rank") == F.col("_size"), F.col("_tail")).otherwise("")
    return placed.withColumn("tail", tail).select(*msgs.columns, "place")


def merged_senders(msgs: DataFrame, place: str = "seq") -> DataFrame:
    """Consecutive messages of one sender as one row: first header, all bodies in order. Text between messages parts them."""
    order = ["note_id", place]
    cut = with_previous(ranged(msgs, order), ["note_id"], order, ["tail", "user"], "_before")
    changes = (~F.col("user").eqNullSafe(F.col("_before.user")) | F.col("user").isNull() | F.col("_before.tail").rlike(r"\S")).cast("int")
    islands = running_total(cut, order, F.coalesce(changes, F.lit(1)), "_island")
    first = lambda c: F.min_by(c, place).alias(c)
    grouped = islands.groupBy("note_id", "_island").agg(F.min(place).alias("place"), first("user"), first("date"), first("time"), first("has_date"), first("key"), F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), "body"))).alias("_b"), F.max_by("tail", place).alias("tail"), F.count(F.lit(1)).alias("n_messages"))
    return grouped.withColumn("body", F.flatten(F.col("_b.body"))).drop("_b", "_island")


def image_order(body: Column, order: str) -> Column:
    """Body lines with images above or below the text; lines that hold both are parted. ``keep``: as they came."""
    if order == "keep":
        return body
    images = F.flatten(F.transform(body, lambda x: F.regexp_extract_all(x, F.lit(f"({_IMAGE})"), F.lit(1))))
    texts = F.filter(F.transform(body, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _IMAGE, " "), r"[ \t]+", " "))), lambda x: x != "")
    both = (F.size(images) > 0) & (F.size(texts) > 0)
    return F.when(both, F.concat(images, texts) if order == "above" else F.concat(texts, images)).otherwise(body)


def without_mentions(body: Column) -> Column:
    """Body lines without @names; a line that held nothing else goes. An @ inside a word is no mention."""
    return F.filter(F.transform(body, lambda x: F.when(x.rlike(MENTION), F.rtrim(F.regexp_replace(x, MENTION, ""))).otherwise(x)), lambda x: x != "")


def render_chat(notes: DataFrame, as_of: str, options: ChatOptions = ChatOptions()) -> DataFrame:
    """(note_id, new_text) of notes that are chat logs: one header and an indented body for each message."""
    logs = notes.where(is_chat_log(F.col("text")))
    msgs = messages(logs, as_of)
    msgs = time_ordered(msgs) if options.sort_by_time else msgs.withColumn("place", F.col("seq"))
    if options.merge_same_user and options.show_user:
        msgs = merged_senders(msgs, "place")
    body = image_order(F.col("body"), options.image_order)
    body = without_mentions(body) if options.strip_mentions else body
    stamp = F.concat_ws(" ", *[F.col(c) for c, on in (("date", options.show_date), ("time", options.show_time)) if on])
    stamp = F.when(F.lit(options.show_date) & ~F.col("has_date") & F.lit(not options.show_time), F.col("date")).otherwise(stamp)
    head = F.concat(F.when(F.lit(options.show_user), F.concat("user", F.lit(":"))).otherwise(""), F.when(F.lit(options.show_user) & (stamp != ""), " ").otherwise(""), stamp)
    indented = F.transform(body, lambda x: F.concat(F.lit(options.body_indent()), x))
    lines = F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), indented)
    block = F.when(F.col("user").isNull(), F.regexp_replace("tail", r"\s+$", "")).otherwise(F.concat_ws("\n", F.array_join(lines, "\n"), F.when(F.col("tail").rlike(r"\S"), F.concat(F.lit("\n"), F.regexp_replace("tail", r"^\s+|\s+$", "")))))
    gap = "\n\n" if options.blank_line else "\n"
    rows = msgs.select("note_id", "place", block.alias("_block")).where("_block <> ''")
    return rows.groupBy("note_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_block"))), lambda x: x["_block"]), gap), F.lit("\n")).alias("new_text"))
