"""Forum threads: floors of pasted text, posts of saved pages, their order and text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.operators.ranks import numbered_rows
from notewright.session import small_batches

_NUMBER, _DAY, _CLOCK = r"#(\d+)(?:-(\d+))?", r"(\d{4})-(\d\d?)-(\d\d?)", r"(\d\d?):(\d\d)"
#: A header line: number, perhaps of a reply, then the day and the time.
FLOOR = rf"{_NUMBER} - {_DAY} {_CLOCK}[ \t]*"
_FLOOR_START = rf"(?m)(?=^{FLOOR}$)"
#: Controls that a copied page carries around a post.
_SKIPPED = r"^\s*(?:\.{2,}|…+|回复|删除了回复|)\s*$"
_CONTROL = r"^\s*(?:\d+\s*回复|收集|贴贴|顺序|举报|回复)\s*$"
_COUNT = r"^\s*\d{1,6}\s*$"
SMILIES = r"!\[[^\]]*\]\([^)]*/img/smiles/[^)]*\)|\(bgm\d+\)"
#: Hosts that name the same site.
TOPIC_HOSTS = ("bgm.tv", "www.bgm.tv", "m.bgm.tv", "bangumi.tv", "www.bangumi.tv", "m.bangumi.tv")
MOST_PAGES = 50


@dataclass(frozen=True)
class ForumOptions:
    show_floor: bool = False
    show_time: bool = False
    show_signature: bool = True
    strip_smilies: bool = False
    blank_between: bool = True
    blank_inside: bool = False
    link_users: bool = False


def _trimmed_end(lines: Column, bad: str) -> Column:
    """The lines without those at the end that match; blank lines at the end go too."""
    kept = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(bad) & x.rlike(r"\S"), i)), lambda i: i.isNotNull()))
    return F.slice(lines, 1, F.coalesce(kept, F.lit(-1)) + 1)


def floors(texts: DataFrame) -> DataFrame:
    """Posts of pasted threads (topic, text): topic, seq, floor, post_date, user, signature, body.

    Headers look like ``#3-1 - 2025-9-15 20:26``. Fold marks after the header are skipped, the next line is the user with
    a signature in brackets, and controls, up to eight bare counts, and controls again are cut from the end. Posts
    without a user are left out.
    """
    rows = texts.where(F.col("text").rlike(rf"(?m)^{FLOOR}$")).select("topic", F.posexplode(F.split("text", _FLOOR_START)).alias("seq", "_p")).where(F.col("_p").rlike(rf"^{FLOOR}"))
    g = lambda k: F.regexp_extract("_p", rf"^{FLOOR}", k)
    floor = F.concat_ws("-", g(1), F.when(g(2) != "", g(2)))
    date = F.concat(g(3), F.lit("-"), F.lpad(g(4), 2, "0"), F.lit("-"), F.lpad(g(5), 2, "0"), F.lit(" "), F.lpad(g(6), 2, "0"), F.lit(":"), g(7))
    lines = F.slice(F.split("_p", "\n"), 2, 1000000)
    first = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(_SKIPPED), i)), lambda i: i.isNotNull()))
    parsed = rows.withColumns({"floor": floor, "post_date": date, "_lines": lines}).withColumn("_first", first)
    name = F.trim(F.get("_lines", F.col("_first")))
    split = F.regexp_extract(name, r"^(.*?\S)\s*[（(]([^（）()]*)[)）]\s*$", 1)
    body = F.slice("_lines", F.coalesce(F.col("_first"), F.lit(0)) + 2, 1000000)
    cut = _trimmed_end(body, _CONTROL)
    counts = F.size(cut) - F.coalesce(F.array_max(F.filter(F.transform(cut, lambda x, i: F.when(~x.rlike(_COUNT), i)), lambda i: i.isNotNull())), F.lit(-1)) - 1
    cut = _trimmed_end(F.slice(cut, 1, F.greatest(F.size(cut) - F.least(counts, F.lit(8)), F.lit(0))), _CONTROL)
    out = parsed.withColumns({"user": F.when(split != "", split).otherwise(name), "signature": F.when(split != "", F.regexp_extract(name, r"[（(]([^（）()]*)[)）]\s*$", 1)).otherwise("")})
    return out.where("user is not null and user <> ''").select("topic", F.col("seq").cast("long").alias("seq"), "floor", "post_date", "user", F.trim("signature").alias("signature"), F.regexp_replace(F.array_join(F.transform(cut, lambda x: F.rtrim(x)), "\n"), r"^\s*\n", "").alias("body"))


def is_forum_dump(text: Column) -> Column:
    """Two floors, or one with a body and the page's control words."""
    n = F.regexp_count(text, F.lit(rf"(?m)^{FLOOR}$"))
    return F.coalesce((n >= 2) | ((n == 1) & text.rlike(rf"(?m){_CONTROL}") & text.rlike(rf"(?m)^{FLOOR}$[\s\S]*\S")), F.lit(False))


# --- saved pages ------------------------------------------------------------------------------------------



def balanced_div(page: str) -> str:
    """The inner HTML of the first div of ``page``, to the end tag that closes it; none: to the end."""
    depth, start = 0, 0
    for m in re.finditer(r"<(/?)div\b[^>]*>", page, re.IGNORECASE):
        if not m[1]:
            depth += 1
            start = start or m.end()
        elif depth:
            depth -= 1
            if depth == 0:
                return page[start : m.start()]
    return page[start:]


#: Bytes of text that a worker holds as Python strings at a time, if no text is longer.
PIECE = 4_000_000


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch cut so that a piece holds ``most_bytes`` of ``column``, or one row that is longer."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _arrow(df: DataFrame, column: str, out: str, change) -> DataFrame:  # noqa: ANN001
    """``df`` with ``out``, a text made of ``column`` by a function of one text; null stays null. Batches are small, and cut by
    bytes, so a worker's memory does not grow with the input."""
    small_batches(df.sparkSession)
    names = [*df.columns, out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, column):
                made = pa.array([None if v is None else change(v) for v in b.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, made], names)

    return df.mapInArrow(work, df.withColumn(out, F.lit(None).cast("string")).schema)


def decoded_entities(df: DataFrame, column: str) -> DataFrame:
    """Named and numeric character references decoded. Rows without ``&`` do not go through Python."""
    has = F.coalesce(F.col(column).contains("&"), F.lit(False))
    done = _arrow(df.where(has), column, "_decoded", html.unescape)
    cols = [F.col("_decoded").alias(c) if c == column else F.col(c) for c in df.columns]
    return df.where(~has).unionByName(done.select(*cols))


def markdown_of(fragment: Column) -> Column:
    """An HTML fragment as Markdown, character references apart: quotes, media, links, emphasis, code, breaks."""
    x = F.regexp_replace(fragment, r"(?is)<(script|style)\b.*?</\1>", "")
    x = F.regexp_replace(x, r"\s*\n\s*", " ")
    x = F.regexp_replace(x, r"""(?i)<img\b[^>]*?src=["']([^"']*)["'][^>]*>""", "![]($1)")
    x = F.regexp_replace(x, r"""(?i)<(?:video|audio|iframe)\b[^>]*?src=["']([^"']*)["'][^>]*>(?:.*?</(?:video|audio|iframe)>)?""", "[$1]($1)")
    x = F.regexp_replace(x, r"""(?is)<a\b[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)")
    for tag, mark in (("b|strong", "**"), ("i|em", "*"), ("s|del", "~~"), ("code", "`")):
        x = F.regexp_replace(x, rf"(?i)</?(?:{tag})(?:\s[^>]*)?>", mark)
    x = F.regexp_replace(x, r"(?is)<(?:blockquote|q)\b[^>]*>\s*", "\n> ")
    x = F.regexp_replace(x, r"(?i)</(?:blockquote|q|p|div|li|h[1-6])>", "\n")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    x = F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_markdown(df: DataFrame, column: str = "html", out: str = "markdown") -> DataFrame:
    """``df`` with ``out``, the Markdown of a column of fragments."""
    return decoded_entities(df.withColumn(out, markdown_of(F.col(column))), out)


def page_title(page: Column) -> Column:
    """The last part of the page's first heading, parts being parted by line breaks."""
    h1 = F.regexp_extract(page, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return F.trim(F.regexp_replace(F.element_at(F.split(h1, r"(?i)<br\s*/?>"), -1), r"<[^>]*>", ""))


def html_posts(pages: DataFrame) -> DataFrame:
    """Posts of saved pages (topic, page, html): topic, page, seq, kind (topic, reply, sub), floor, post_date, user, url,
    signature, body. Each ``<div id="post_N">`` is one; only the body's closing tag is sought in Python."""
    start = r"""(?i)(?=<div\b[^>]*\bid="post_\d+")"""
    rows = pages.where(F.col("html").contains("post_")).select("topic", "page", F.posexplode(F.split("html", start)).alias("seq", "_p")).where(F.col("_p").rlike(r"""(?i)^<div\b[^>]*\bid="post_\d+\""""))
    got = lambda r, k=1: F.regexp_extract("_p", r, k)
    cls = got(r"""(?i)^<div\b[^>]*?\bclass="([^"]*)\"""")
    kind = F.when(cls.contains("sub_reply"), "sub").when(cls.contains("postTopic"), "topic").otherwise("reply")
    stamp = r"#(\d+(?:-\d+)?)(?:</a>)?\s*-\s*(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{2})"
    date = F.concat(got(stamp, 2), F.lit("-"), F.lpad(got(stamp, 3), 2, "0"), F.lit("-"), F.lpad(got(stamp, 4), 2, "0"), F.lit(" "), F.lpad(got(stamp, 5), 2, "0"), F.lit(":"), got(stamp, 6))
    user = r"""(?is)<a\b[^>]*?href="([^"]*/user/[^"]*)"[^>]*?class="l"[^>]*>(.*?)</a>"""
    body_at = F.regexp_extract("_p", r"""(?is)(<div\b[^>]*class="(?:message|topic_content|cmt_sub_content|reply_content)\b[^"]*".*)$""", 1)
    parsed = rows.withColumns({"kind": kind, "floor": got(stamp, 1), "post_date": date, "url": got(user, 1), "user": F.trim(F.regexp_replace(got(user, 2), r"<[^>]*>", "")), "signature": F.trim(F.regexp_replace(got(r"""(?is)<span\b[^>]*class="[^"]*tip_j[^"]*"[^>]*>\s*\(?(.*?)\)?\s*</span>"""), r"<[^>]*>", "")), "_html": body_at}).drop("_p")
    inner = _arrow(parsed, "_html", "_inner", balanced_div).withColumn("body", markdown_of(F.col("_inner")))
    out = decoded_entities(inner, "body")
    return out.where("user <> ''").select("topic", "page", F.col("seq").cast("long").alias("seq"), "kind", "floor", "post_date", "user", "url", "signature", "body")


def page_links(pages: DataFrame) -> DataFrame:
    """Other pages of a topic that a page links to: page_id, page, link, by number, page 1 named once.

    Links of the same host and path (or relative ones) with ``page=`` or ``p=`` count.
    """
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(hrefs)).alias("_h"))
    path = lambda u: F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^https?://[^/]*", "")
    host = lambda u: F.regexp_extract(u, r"^https?://([^/?#]*)", 1)
    n = F.regexp_extract("_h", r"[?&](?:page|p)=(\d+)", 1)
    mine = ((host(F.col("_h")) == "") | (host(F.col("_h")) == host(F.col("url")))) & ((path(F.col("_h")) == "") | (path(F.col("_h")) == path(F.col("url"))))
    base = F.regexp_replace("url", r"[?#].*$", "")
    found = rows.where(mine & (n != "")).select("page_id", F.greatest(n.cast("int"), F.lit(1)).alias("page"), base.alias("_base"))
    return found.distinct().select("page_id", "page", F.when(F.col("page") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("?page="), F.col("page").cast("string"))).alias("link"))


def topic_url(url: Column, hosts: tuple[str, ...] = TOPIC_HOSTS) -> Column:
    """struct(kind, id, canonical) of a topic's address, or null. A scheme may be missing; nothing but a query may follow the id."""
    host = "|".join(re.escape(h) for h in hosts)
    pattern = rf"^(?i:https?://)?(?i:{host})(?::\d+)?/(group|subject)/topic/(\d+)/?(?:[?#].*)?$"
    at = F.trim(url)
    kind, topic = F.regexp_extract(at, pattern, 1), F.regexp_extract(at, pattern, 2)
    return F.when(topic != "", F.struct(kind.alias("kind"), topic.cast("long").alias("id"), F.concat(F.lit(f"https://{hosts[0]}/"), kind, F.lit("/topic/"), topic).alias("canonical")))


def in_page_order(posts: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """Adds place, the position of a post over the pages of its topic from 1; pages beyond the fiftieth are not taken.

    Pages are numbered over all topics, and so are the posts that are left; a topic's first number is taken off. So no task
    holds a whole topic.
    """

    def from_one(numbered: DataFrame, out: str) -> DataFrame:
        first = numbered.groupBy(F.col("topic").alias("_t")).agg(F.min("_at").alias("_first"))
        return numbered.join(first, F.col("topic").eqNullSafe(F.col("_t"))).withColumn(out, (F.col("_at") - F.col("_first") + 1).cast("long")).drop("_t", "_first", "_at")

    pages = from_one(numbered_rows(posts.select("topic", "page").distinct(), ["topic", "page"], "_at"), "_nth").where(F.col("_nth") <= most_pages)
    pages = pages.select(F.col("topic").alias("_topic"), F.col("page").alias("_page"))
    taken = posts.join(pages, F.col("topic").eqNullSafe(F.col("_topic")) & F.col("page").eqNullSafe(F.col("_page")), "left_semi")
    return from_one(numbered_rows(taken, ["topic", "page", "seq"], "_at"), "place")


def post_key() -> Column:
    return F.concat_ws("|", "floor", "user", F.substring("body", 1, 40))


def distinct_posts(posts: DataFrame) -> DataFrame:
    """Posts without repeats (same floor, user and first 40 characters): the first in page order stays. Tasks find their own
    first before the shuffle, so a post repeated without end is no hot key."""
    first = F.min_by(F.struct(*posts.columns), F.struct("page", "seq")).alias("_row")
    return posts.groupBy(F.col("topic").alias("_topic"), post_key().alias("_key")).agg(first).select("_row.*")


def without_smilies(body: Column) -> Column:
    return F.regexp_replace(body, SMILIES, "")


def render_threads(posts: DataFrame, options: ForumOptions = ForumOptions()) -> DataFrame:
    """(topic, text): posts in the order of seq as ``**user** (signature)`` and the body under it."""
    user = F.concat(F.lit("**"), F.col("user"), F.lit("**"))
    if options.link_users and "url" in posts.columns:
        user = F.when(F.col("url") != "", F.concat(F.lit("["), user, F.lit("]("), F.col("url"), F.lit(")"))).otherwise(user)
    sign = F.when(F.lit(options.show_signature) & (F.col("signature") != ""), F.concat(F.lit(" ("), F.col("signature"), F.lit(")"))).otherwise("")
    meta = F.concat_ws(" · ", *[c for c, on in ((F.concat(F.lit("#"), F.col("floor")), options.show_floor), (F.col("post_date"), options.show_time)) if on])
    head = F.concat(user, sign, F.when(meta != "", F.concat(F.lit(" "), meta)).otherwise(""))
    body = without_smilies(F.col("body")) if options.strip_smilies else F.col("body")
    body = F.regexp_replace(body, r"(?m)^(\S+) 说: ", "> “**$1** 说：” ")
    body = F.regexp_replace(body, r"\n{2,}", "\n\n" if options.blank_inside else "\n")
    block = F.concat_ws("\n", head, F.when(body != "", body))
    order = "place" if "place" in posts.columns else "seq"
    rows = posts.select("topic", F.struct(F.col(order).alias("o"), block.alias("b")).alias("_x"))
    gap = "\n\n" if options.blank_between else "\n"
    return rows.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["b"]), gap).alias("text"))
