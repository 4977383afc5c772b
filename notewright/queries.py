"""One query for each operator on notes, files, chats and threads, with the SQL that checks it."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions import formulas, links, spacing, tags, typeset
from notewright.functions.lines import lines_of
from notewright.operators import blocks, chat, forum, images, resolve
from notewright.operators.ranks import numbered_rows
from notewright.plans import images as image_plans
from notewright.plans import typeset as layout
from notewright.session import shared_folder
from notewright.sources import notes as sources
from notewright.sources.derived import derived, with_tables
from notewright.streaming import edits

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime.datetime(2026, 4, 20, 12, 30, 45)
DAY = "2026-04-20"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return sources.all_documents(derived(spark, sf, "notes"), derived(spark, sf, "canvases"))


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    return links.image_refs(derived(spark, sf, "notes")).where("kind = 'wiki'")


# --- pieces of SQL ----------------------------------------------------------------------------------------

_DOCS = with_tables("notes", "canvases", "files") + """,
docs AS (SELECT note_id, text FROM notes UNION ALL SELECT note_id, text FROM canvases),
found AS (
  SELECT note_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)) AS t FROM docs
  UNION ALL SELECT note_id, url_decode(unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1))) FROM docs
  UNION ALL SELECT note_id, unnest(regexp_extract_all(text, '"file"\\s*:\\s*"([^"]+)"', 1)) FROM docs),
names AS (SELECT note_id, lower(string_split(trim(string_split(t, '#')[1]), '/')[-1]) AS name FROM found
          WHERE regexp_matches(trim(string_split(t, '#')[1]), '(?i)\\.(png|jpg|jpeg|gif|bmp|webp|heic|avif|svg)$'))"""

#: What the asked targets resolve to.
_RESOLVED = """hits AS (SELECT target, path, 0 AS p FROM asked JOIN files ON contains(t, '/') AND path = t
         UNION ALL SELECT target, path, 1 FROM asked JOIN files ON contains(t, '/') AND ends_with(lower(path), '/' || lower(t))
         UNION ALL SELECT target, path, 1 FROM asked JOIN files ON NOT contains(t, '/') AND lower(name) = lower(t)),
resolved AS (SELECT target, CASE WHEN count(*) FILTER (WHERE p = 0) > 0 THEN min(path) FILTER (WHERE p = 0) WHEN count(*) = 1 THEN min(path) END AS resolved_path,
               CASE WHEN count(*) FILTER (WHERE p = 0) > 0 THEN 1 ELSE count(*) END AS n_candidates FROM hits GROUP BY target)"""

_REFS = with_tables("notes", "files") + """,
rows AS (SELECT note_id, folder, unnest(range(len(ls))) AS line, unnest(ls) AS x FROM (SELECT note_id, folder, string_split(text, chr(10)) AS ls FROM notes)),
marked AS (SELECT *, regexp_matches(x, '^[ \\t]*(```|~~~)') AS fence,
             sum(CASE WHEN regexp_matches(x, '^[ \\t]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY line) AS k FROM rows),
plain AS (SELECT note_id, folder, line, regexp_replace(x, '`[^`]*`', '`', 'g') AS x FROM marked WHERE NOT fence AND k % 2 = 0 AND contains(x, '!')),
wiki AS (SELECT note_id, folder, line, regexp_extract_all(x, '!\\[\\[([^|\\]]+?)(?:\\|[^\\]]+?)?\\]\\]', 1) AS w,
           list_transform(regexp_extract_all(x, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1), lambda t: regexp_replace(trim(t), '\\s+"[^"]*"\\s*$', '')) AS m FROM plain),
kept AS (SELECT note_id, folder, line, list_filter(w, lambda t: regexp_matches(string_split(t, '#')[1], '(?i)\\.(png|jpg|jpeg|gif|bmp|webp|heic|avif|svg)$')) AS w,
           list_filter(m, lambda t: regexp_matches(string_split(t, '#')[1], '(?i)\\.(png|jpg|jpeg|gif|bmp|webp|heic|avif|svg)$')) AS m FROM wiki),
refs AS (SELECT note_id, folder, line::INTEGER AS line, unnest(range(len(w)))::INTEGER AS ord, 'wiki' AS kind, unnest(w) AS target FROM kept
         UNION ALL SELECT note_id, folder, line::INTEGER, (len(w) + unnest(range(len(m))))::INTEGER, 'markdown', unnest(m) FROM kept),
asked AS (SELECT DISTINCT target, regexp_replace(trim(string_split(target, '#')[1]), '^\\./', '') AS t FROM refs),
""" + _RESOLVED

_ORGANISED = _DOCS + _REFS.removeprefix(with_tables("notes", "files")) + r""",
away AS (SELECT DISTINCT r.note_id, r.target, r.folder || '/attachments' AS want, s.resolved_path FROM refs r JOIN resolved s USING (target) WHERE kind = 'wiki' AND s.resolved_path IS NOT NULL),
used AS (SELECT name AS used_name, count(DISTINCT note_id) AS n FROM names GROUP BY 1),
organised AS (SELECT CASE WHEN coalesce(n, 0) <= 1 THEN 'move' ELSE 'copy' END AS action, resolved_path AS src, want || '/' || name AS dst, note_id, NULL::VARCHAR AS reason
              FROM away JOIN files ON path = resolved_path LEFT JOIN used ON used_name = lower(name) WHERE folder <> want
              UNION ALL SELECT 'skip', r.target, NULL, r.note_id, CASE WHEN coalesce(s.n_candidates, 0) > 1 THEN 'ambiguous' ELSE 'missing' END
              FROM refs r LEFT JOIN resolved s USING (target) WHERE kind = 'wiki' AND s.resolved_path IS NULL)"""

# --- sources, sets and reports ----------------------------------------------------------------------------


@query(with_tables("notes", "canvases") + " SELECT note_id, path, folder, text FROM notes UNION ALL SELECT note_id, path, folder, text FROM canvases")
def u1_all_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf)


@query(with_tables("files") + " SELECT path, size FROM files WHERE starts_with(path, 'en/')")
def s4_in_folder(spark: SparkSession, sf: str) -> DataFrame:
    return sources.in_folder(derived(spark, sf, "files"), "en").select("path", "size")


@query(with_tables("notes") + " SELECT note_id, replace(text, '.png', '.webp') AS text FROM notes WHERE contains(text, '.png')")
def s5_changed_only(spark: SparkSession, sf: str) -> DataFrame:
    notes = derived(spark, sf, "notes").select("note_id", "text")
    return sources.changed_only(notes, notes.withColumn("text", F.replace("text", F.lit(".png"), F.lit(".webp"))))


@query(with_tables("notes") + " SELECT count(*) AS processed, count(*) FILTER (WHERE contains(text, '.png')) AS changed, count(*) FILTER (WHERE text IS NULL) AS failed FROM notes")
def s6_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return sources.run_report(derived(spark, sf, "notes").withColumn("new_text", F.replace("text", F.lit(".png"), F.lit(".webp"))))


@query(_DOCS + " SELECT DISTINCT name FROM names")
def u2_distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    return links.referenced_names(_docs(spark, sf)).select("name").distinct()


@query(_DOCS + " SELECT lower(name) AS name, 'unused' AS side FROM files EXCEPT SELECT name, 'unused' FROM names UNION ALL (SELECT name, 'missing' FROM names EXCEPT SELECT lower(name), 'missing' FROM files)")
def u3_set_differences(spark: SparkSession, sf: str) -> DataFrame:
    disk = derived(spark, sf, "files").select(F.lower("name").alias("name"))
    used = links.referenced_names(_docs(spark, sf)).select("name")
    return disk.subtract(used).withColumn("side", F.lit("unused")).union(used.subtract(disk).withColumn("side", F.lit("missing")))


# --- extraction -------------------------------------------------------------------------------------------


@query(_REFS + " SELECT note_id, folder, line, ord, kind, target FROM refs")
def e1_image_embeds(spark: SparkSession, sf: str) -> DataFrame:
    return links.image_refs(derived(spark, sf, "notes"))


@query(_DOCS + " SELECT note_id, name FROM names WHERE name <> ''")
def e2_referenced_names(spark: SparkSession, sf: str) -> DataFrame:
    return links.referenced_names(_docs(spark, sf))


@query(with_tables("notes") + r""" SELECT note_id, 0 AS ord, 'p' AS alt, regexp_extract(text, '\((file:[^)]*)\)', 1) AS target, regexp_extract(text, '(pic_[0-9]+\.png)\)', 1) AS name FROM notes WHERE contains(text, '](file:/')""")
def e3_external_images(spark: SparkSession, sf: str) -> DataFrame:
    return links.external_images(derived(spark, sf, "notes"))


@query(with_tables("notes") + r""" SELECT DISTINCT note_id, unnest(regexp_extract_all(text, '!\[[^\]]*\]\((https?://[^)\s]+\.(?:png|jpe?g|webp|bmp|heic)(?:[?#][^)]*)?)\)', 1)) AS url FROM notes""")
def e4_remote_images(spark: SparkSession, sf: str) -> DataFrame:
    return links.remote_images(derived(spark, sf, "notes"))


@query(_REFS + " SELECT note_id, count(*) AS n_images FROM refs GROUP BY note_id")
def e5_image_counts(spark: SparkSession, sf: str) -> DataFrame:
    return links.image_counts(derived(spark, sf, "notes"))


@query()
def e6_line_classes(spark: SparkSession, sf: str) -> DataFrame:
    return typeset.line_classes(derived(spark, sf, "notes"))


@query()
def e7_protected_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spacing.protected_spans(derived(spark, sf, "notes"))


@query(_REFS + r""", hidden AS (SELECT note_id, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x2, '!?\[\[[^\]]*\]\]', chr(1), 'g'), '!?\[[^\]]*\]\([^)]*\)', chr(1), 'g'), '<!--.*?-->', chr(1), 'g'), '%%.*?%%', chr(1), 'g'), '\$[^$]+\$', chr(1), 'g') AS x
  FROM (SELECT note_id, line, regexp_replace(x, '`[^`]*`', chr(1), 'g') AS x2 FROM marked WHERE NOT fence AND k % 2 = 0 AND contains(x, '#'))),
t AS (SELECT note_id, line::INTEGER AS line, list_filter(list_transform(regexp_extract_all(x, '(?:^|[ \t　])#([\p{L}\p{N}_][\p{L}\p{N}_\-/]*)', 1), lambda g: regexp_replace(g, '[-/]+$', '')), lambda g: regexp_matches(g, '\p{L}')) AS g FROM hidden)
SELECT note_id, line, unnest(range(len(g)))::INTEGER AS ord, unnest(g) AS tag FROM t""")
def e8_note_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tags.note_tags(derived(spark, sf, "notes"))


_MESSAGES = r"""
WITH m AS (SELECT conv_id AS note_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 5 = 0 THEN -turn ELSE turn END) - 1 AS seq, role AS "user",
  CAST(1 + conv_id % 22 AS STRING) AS h, lpad(CAST(turn % 60 AS STRING), 2, '0') AS mi, trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM conversations)
"""


@query(_MESSAGES + """SELECT note_id, seq, "user", '2024/01/05' AS date, lpad(h, 2, '0') || ':' || mi || ':07' AS time, true AS has_date,
  CAST('20240105' || lpad(h, 2, '0') || mi || '07' AS BIGINT) AS key, body FROM m""")
def e9_chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    found = chat.messages(derived(spark, sf, "chats"), DAY)
    return found.select("note_id", "seq", "user", "date", "time", "has_date", "key", F.array_join("body", "\n").alias("body"))


@query("SELECT conv_id AS note_id, true AS is_chat FROM conversations GROUP BY conv_id UNION ALL SELECT -1 - doc_id, false FROM documents")
def e10_is_chat_log(spark: SparkSession, sf: str) -> DataFrame:
    """Chat logs, and the documents, which are none."""
    none = _table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("note_id"), "text")
    return derived(spark, sf, "chats").union(none).select("note_id", chat.is_chat_log(F.col("text")).alias("is_chat"))


def _pasted(spark: SparkSession, sf: str) -> DataFrame:
    """Threads as they are pasted: a header for each turn, the user's line, a body and the page's controls."""
    posts = derived(spark, sf, "posts")
    block = F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit(" - 2025-9-15 20:26\n...\n"), F.col("user_name"), F.lit(" (sig)\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n3\n收集\n"))
    return posts.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "").alias("text"))


@query(r"""SELECT conv_id AS topic, CAST(turn AS STRING) AS floor, '2025-09-15 20:26' AS post_date, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS "user", 'sig' AS signature,
  rtrim(replace(text, chr(10), ' '), ' ') AS body FROM conversations""")
def e11_forum_floors(spark: SparkSession, sf: str) -> DataFrame:
    return forum.floors(_pasted(spark, sf)).select("topic", "floor", "post_date", "user", "signature", "body")


@query("SELECT conv_id AS topic, true AS is_dump FROM conversations GROUP BY conv_id UNION ALL SELECT -1 - doc_id, false FROM documents")
def e12_is_forum_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Pasted threads, and the documents, which are none."""
    none = _table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("topic"), "text")
    return _pasted(spark, sf).union(none).select("topic", forum.is_forum_dump(F.col("text")).alias("is_dump"))


def _post_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Saved pages: a post for each turn, three pages a topic."""
    p = derived(spark, sf, "posts")
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit('<div id="post_'), F.col("turn").cast("string"), F.lit('" class="row_reply clearit"><div class="re_info"><a>#'), F.col("turn").cast("string"), F.lit('</a> - 2025-9-15 20:26</div><a href="/user/'), F.col("user_name"), F.lit('" class="l">'), F.col("user_name"), F.lit('</a><span class="sign tip_j">(sig)</span><div class="message clearit"><div>'), F.replace(esc, F.lit("\n"), F.lit("<br>")), F.lit("</div></div></div>"))
    return p.groupBy("topic", "page").agg(F.concat(F.lit("<h1>a<br>topic</h1>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", html.alias("b")))), lambda x: x["b"]), "")).alias("html"))


@query(r"""SELECT conv_id AS topic, (turn % 3) AS page, 'reply' AS kind, CAST(turn AS STRING) AS floor, '2025-09-15 20:26' AS post_date,
  CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS "user", '/user/' || CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS url, 'sig' AS signature,
  regexp_replace(regexp_replace(regexp_replace(text, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM conversations""")
def e13_html_posts(spark: SparkSession, sf: str) -> DataFrame:
    return forum.html_posts(_post_pages(spark, sf)).select("topic", "page", "kind", "floor", "post_date", "user", "url", "signature", "body")


@query()
def e14_html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return forum.html_to_markdown(_table(spark, sf, "pages").select("page_id", "html")).select("page_id", "markdown")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base FROM pages)
SELECT page_id, n::INTEGER AS page, CASE WHEN n = 1 THEN base ELSE base || '?page=' || CAST(n AS STRING) END AS link FROM (SELECT page_id, base, unnest([1, 2, 3 + page_id % 4]) AS n FROM p) GROUP BY ALL""")
def e15_page_links(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with a bar of page numbers: relative, absolute, twice, page 0, another topic's and another site's."""
    base = F.regexp_replace("url", r"[?#].*$", "")
    last = (3 + F.col("page_id") % 4).cast("string")
    a = lambda *href: F.concat(F.lit('<a href="'), *href, F.lit('">n</a>'))
    bar = F.concat(a(F.lit("?page=0")), a(F.lit("?page=2")), a(base, F.lit("?p=2")), a(base, F.lit("?x=1&page="), last), a(F.lit("/elsewhere/1?page=7")), a(F.lit("https://other.example/?page=8")), a(F.lit("?size=9")))
    return forum.page_links(_table(spark, sf, "pages").select("page_id", "url", F.concat("html", bar).alias("html")))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'group' ELSE 'subject' END END AS kind, CASE WHEN doc_id % 6 < 4 THEN doc_id END AS id,
  CASE WHEN doc_id % 6 < 4 THEN 'https://bgm.tv/' || CASE WHEN doc_id % 2 = 0 THEN 'group' ELSE 'subject' END || '/topic/' || CAST(doc_id AS STRING) END AS canonical FROM documents""")
def e16_topic_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of the site's names and of two others."""
    host = F.element_at(F.array(*[F.lit(h) for h in ("https://bgm.tv", "http://m.bgm.tv", "www.bangumi.tv", "https://m.bangumi.tv", "https://chii.in", "https://bgm.tv.example.org")]), (F.col("doc_id") % 6 + 1).cast("int"))
    url = F.concat(host, F.when(F.col("doc_id") % 2 == 0, "/group").otherwise("/subject"), F.lit("/topic/"), F.col("doc_id").cast("string"), F.lit("?page=2"))
    return _table(spark, sf, "documents").select("doc_id", forum.topic_url(url).alias("t")).select("doc_id", "t.kind", "t.id", "t.canonical")


def _math_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a formula that declares two letters, then prose that uses them."""
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.col("doc_id") % 26 + 1).cast("int"), 1)
    clean = F.regexp_replace("text", r"[$`]", "")
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.concat(clean, F.lit("\n设 $"), letter, F.lit(" = \\mathrm{Re} Z$ 已知\n讨论 "), letter, F.lit(" 的模长，λ 值")).alias("text"))


@query("SELECT doc_id AS note_id, substr('abcdefghijklmnopqrstuvwxyz', CAST(doc_id % 26 + 1 AS INT), 1) AS letter FROM documents UNION ALL SELECT doc_id, 'Z' FROM documents")
def e17_variable_table(spark: SparkSession, sf: str) -> DataFrame:
    return formulas.variable_table(_math_notes(spark, sf))


_HEADS = """
WITH h AS (SELECT doc_id, source, 1 + doc_id % 3 AS a, 2 + doc_id % 5 AS b, 1 + doc_id % 6 AS c FROM documents),
n AS (SELECT *, a AS na, CASE WHEN b > a THEN least(6, a + 1) ELSE a END AS nb,
        least(6, a + CASE WHEN b > a THEN (CASE WHEN a < c THEN 1 ELSE 0 END) + (CASE WHEN b < c THEN 1 ELSE 0 END) ELSE (CASE WHEN b < c THEN 1 ELSE 0 END) END) AS nc FROM h)
"""


@query(_HEADS + "SELECT doc_id AS note_id, a::INTEGER AS level, source AS title FROM n UNION ALL SELECT doc_id, b::INTEGER, 'part ' || CAST(doc_id AS STRING) FROM n UNION ALL SELECT doc_id, c::INTEGER, 'end' FROM n")
def e18_heading_outline(spark: SparkSession, sf: str) -> DataFrame:
    return typeset.heading_outline(derived(spark, sf, "outlines")).select("note_id", "level", "title")


_ITEMS = """
WITH i AS (SELECT doc_id AS note_id, unnest([1, 2, 3, 4, 5]) AS k, 1 + doc_id % 4 AS f, 5 + doc_id % 2 AS g FROM documents),
v AS (SELECT note_id, (CASE k WHEN 1 THEN f WHEN 2 THEN g WHEN 3 THEN 7 WHEN 4 THEN 4 ELSE 9 END)::INTEGER AS number, k, f FROM i)
"""


@query(_ITEMS + "SELECT note_id, number, (CASE WHEN f = 1 THEN number ELSE k END)::INTEGER AS new_number, CASE WHEN k = 4 THEN ')' ELSE '.' END AS style, 0 AS width, '' AS quote_prefix FROM v")
def e18_list_items(spark: SparkSession, sf: str) -> DataFrame:
    return typeset.list_items(derived(spark, sf, "outlines")).drop("line")


@query("SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS format FROM documents")
def e19_true_formats(spark: SparkSession, sf: str) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "00")]), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), images.true_format(content).alias("format"))


# --- names and predicates ---------------------------------------------------------------------------------


@query(with_tables("files") + r""" SELECT path FROM files WHERE regexp_matches(name, '[\\%{}()\[\]~`^]') OR regexp_matches(name, '^[0-9.\s_-]+\.(png|jpg|jpeg|gif|bmp|webp|heic)$')""")
def p1_garbled_names(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "files").where(images.is_garbled(F.col("name"))).select("path")


@query(with_tables("files") + r""" SELECT path FROM files WHERE regexp_matches(name, '(?i)^Pasted image [0-9]{14}\.[^.]+$')""")
def p2_matches_preset(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "files").where(images.matches_preset(F.col("name"))).select("path")


@query(with_tables("files") + " SELECT path FROM files WHERE ext IN ('png', 'jpg')")
def p3_needs_conversion(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "files").where(images.needs_conversion(F.col("ext"))).select("path")


@query(with_tables("files") + r""" SELECT path, regexp_replace(path, '\.[^./]+$', '.webp') AS new_path FROM files f WHERE ext IN ('png', 'jpg') AND lower(regexp_replace(path, '\.[^./]+$', '.webp')) NOT IN (SELECT lower(path) FROM files)""")
def p4_converted_names(spark: SparkSession, sf: str) -> DataFrame:
    return images.conversions(derived(spark, sf, "files"))


@query(with_tables("notes") + " SELECT note_id, folder || '/attachments' AS sub, folder AS here, 'Attachments' AS fixed, folder || '/img' AS relative FROM notes")
def p5_attachment_folder(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("folder")
    return derived(spark, sf, "notes").select("note_id", images.attachment_folder(f, "subfolder", custom="attachments").alias("sub"), images.attachment_folder(f, "current").alias("here"), images.attachment_folder(f, "custom", custom="Attachments").alias("fixed"), images.attachment_folder(f, "system", root="./img").alias("relative"))


@query("SELECT event_id, 'Pasted image ' || strftime(ts, '%Y%m%d%H%M%S') AS stem FROM events")
def p6_preset_names(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("event_id", images.preset_stem(F.col("ts")).alias("stem"))


@query(r"""
WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\\/:*?"<>|#^\[\]]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^[. ]+', ''), '[. ]+$', '') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(substr(x, 1, 80), '[. ]+$', '') AS x FROM b)
SELECT doc_id, CASE WHEN coalesce(x, '') = '' THEN 'untitled' ELSE x END AS file_name FROM c""")
def p7_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", images.safe_name(F.col("text")).alias("file_name"))


# --- joins ------------------------------------------------------------------------------------------------


@query(_REFS + " SELECT r.note_id, r.line, r.ord, r.target, s.resolved_path, coalesce(s.n_candidates, 0) AS n_candidates, coalesce(s.n_candidates, 0) > 1 AS ambiguous FROM refs r LEFT JOIN resolved s USING (target)")
def j1_resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Exact paths (J1), unique path ends (J2) and unique names (J3) in one resolution."""
    found = resolve.resolve_refs(links.image_refs(derived(spark, sf, "notes")), derived(spark, sf, "files"))
    return found.select("note_id", "line", "ord", "target", "resolved_path", "n_candidates", "ambiguous")


@query(_DOCS + " SELECT path, name, folder, size FROM files WHERE lower(name) NOT IN (SELECT name FROM names) AND (SELECT count(*) FROM docs WHERE text IS NULL) = 0")
def j4_unreferenced_images(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.unreferenced(sources.images_only(derived(spark, sf, "files")).select("path", "name", "folder", "size"), _docs(spark, sf))


@query(_REFS + " SELECT r.note_id, r.line, r.ord, r.target, CASE WHEN coalesce(s.n_candidates, 0) > 1 THEN 'ambiguous' ELSE 'missing' END AS reason FROM refs r LEFT JOIN resolved s USING (target) WHERE s.resolved_path IS NULL")
def j5_broken_links(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.broken_links(links.image_refs(derived(spark, sf, "notes")), derived(spark, sf, "files"))


@query(with_tables("notes") + r""" SELECT note_id, replace(notes.text, '![[' || lang || '/img_' || CAST(note_id AS STRING) || '.png', '![[new/' || CAST(note_id AS STRING) || '.png') AS new_text
FROM notes JOIN documents ON note_id = doc_id WHERE note_id % 10 IN (0, 5)""")
def j6_rewritten_links(spark: SparkSession, sf: str) -> DataFrame:
    refs = _wiki(spark, sf).where("target like '%/img%'")
    mapping = refs.select("note_id", "target", F.concat(F.lit("new/"), F.col("note_id").cast("string"), F.lit(".png")).alias("new_target"))
    return resolve.rewrite_links(derived(spark, sf, "notes"), mapping).select("note_id", "new_text")


@query(_REFS + " SELECT DISTINCT f.path, f.size FROM files f JOIN resolved s ON f.path = s.resolved_path JOIN refs r USING (target) WHERE r.folder = (SELECT min(folder) FROM notes)")
def j7_images_used(spark: SparkSession, sf: str) -> DataFrame:
    """Images that the notes of the first folder use."""
    notes = derived(spark, sf, "notes")
    folder = notes.agg(F.min("folder")).first()[0] or "/"
    return resolve.images_used_by(derived(spark, sf, "files"), links.image_refs(sources.in_folder(notes, folder))).select("path", "size")


@query(r"""WITH l AS (SELECT *, substr('abcdefghijklmnopqrstuvwxyz', CAST(doc_id % 26 + 1 AS INT), 1) AS x FROM documents)
SELECT doc_id AS note_id, regexp_replace(text, '[$`]', '', 'g') || chr(10) || '设 $' || x || ' = \mathrm{Re} Z$ 已知' || chr(10) || '讨论 $' || x || '$ 的模长，λ 值' AS new_text FROM l""")
def j8_wrapped_variables(spark: SparkSession, sf: str) -> DataFrame:
    return formulas.wrap_declared(_math_notes(spark, sf)).select("note_id", "new_text")


# --- aggregates -------------------------------------------------------------------------------------------


@query(_DOCS + " SELECT name, count(DISTINCT note_id) AS n_documents FROM names GROUP BY name")
def a1_users(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.users(_docs(spark, sf))


@query(_DOCS + " SELECT name, count(*) AS n_refs FROM names GROUP BY name")
def a2_reference_counts(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.reference_counts(_docs(spark, sf))


_GROUPS = _DOCS + """,
g AS (SELECT *, count(*) OVER (PARTITION BY folder, size, content) AS n_copies FROM files WHERE content IS NOT NULL),
counted AS (SELECT g.*, coalesce(r.n, 0) AS n_refs FROM g LEFT JOIN (SELECT name, count(*) AS n FROM names GROUP BY name) r ON lower(g.name) = r.name WHERE n_copies > 1),
kept AS (SELECT *, first_value(path) OVER (PARTITION BY folder, size, content ORDER BY n_refs DESC, name) AS keeper FROM counted)"""


@query(_GROUPS + " SELECT path, folder, size, sha256(content) AS digest, n_copies FROM g WHERE n_copies > 1")
def a3_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return images.duplicate_groups(derived(spark, sf, "files")).select("path", "folder", "size", "digest", "n_copies")


@query(_GROUPS + " SELECT path, n_refs, keeper, path = keeper AS is_keeper FROM kept")
def a4_keepers(spark: SparkSession, sf: str) -> DataFrame:
    return images.keepers(derived(spark, sf, "files"), _docs(spark, sf)).select("path", "n_refs", "keeper", "is_keeper")


@query(_GROUPS + " SELECT count(*) FILTER (WHERE path = keeper) AS n_groups, count(*) FILTER (WHERE path <> keeper) AS n_drops, coalesce(sum(size) FILTER (WHERE path <> keeper), 0)::BIGINT AS reclaimable FROM kept")
def a5_duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    return images.duplicate_report(images.keepers(derived(spark, sf, "files"), _docs(spark, sf)))


@query(with_tables("files") + " SELECT lower(name) AS name, count(*) AS n_files FROM files GROUP BY 1 HAVING count(*) > 1")
def a6_ambiguous_names(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.ambiguous_names(derived(spark, sf, "files"))


@query(with_tables("notes") + r""", p AS (SELECT note_id, CASE note_id % 10 WHEN 1 THEN 2 WHEN 4 THEN 2 WHEN 8 THEN 2 WHEN 2 THEN 0 WHEN 6 THEN 0 WHEN 9 THEN 0 ELSE 1 END AS changed,
  CASE note_id % 10 WHEN 2 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS skipped, regexp_extract_all(text, '!\[\[[^\]|]+(?:\|[^\]]*)?\]\]', 0) AS x FROM notes)
SELECT note_id, changed::BIGINT AS changed, skipped::BIGINT AS skipped,
  array_to_string(list_transform(x, lambda e: e || ' -> ' || regexp_replace(e, '(?:\|[^\]]*)?\]\]$', '|120]]')), chr(10)) AS samples FROM p WHERE changed + skipped > 0""")
def a7_size_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What a run to 120 would change and pass over in each note, in code too, and its first links before and after."""
    found = links.size_preview(derived(spark, sf, "notes"), "120")
    return found.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat(x["before"], F.lit(" -> "), x["after"])), "\n"))


@query(_REFS + r""" SELECT count(DISTINCT resolved_path) AS n_renames FROM resolved JOIN refs USING (target) WHERE kind = 'wiki' AND resolved_path IS NOT NULL AND NOT regexp_matches(string_split(resolved_path, '/')[-1], '(?i)^Pasted image [0-9]{14}\.[^.]+$')""")
def a8_rename_preview(spark: SparkSession, sf: str) -> DataFrame:
    return image_plans.rename_preview(derived(spark, sf, "notes"), derived(spark, sf, "files"))


@query(_ORGANISED + " SELECT action, count(*) AS n, coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason), '') AS reasons FROM organised GROUP BY action")
def a9_organise_report(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = image_plans.organise_plan(derived(spark, sf, "notes"), derived(spark, sf, "canvases"), derived(spark, sf, "files"))
    return sources.organise_report(plan)


# --- windows and order ------------------------------------------------------------------------------------


@query(_MESSAGES + """SELECT note_id, seq, row_number() OVER (PARTITION BY note_id ORDER BY h, mi, seq) - 1 AS place FROM m""")
def w1_time_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return chat.time_ordered(chat.messages(derived(spark, sf, "chats"), DAY)).select("note_id", "seq", F.col("place").cast("long").alias("place"))


@query(_MESSAGES + """, l AS (SELECT *, CASE WHEN lag("user") OVER (PARTITION BY note_id ORDER BY seq) = "user" THEN 0 ELSE 1 END AS c FROM m),
i AS (SELECT *, sum(c) OVER (PARTITION BY note_id ORDER BY seq) AS k FROM l)
SELECT note_id, min(seq) AS place, min("user") AS "user", count(*) AS n_messages, string_agg(body, chr(10) ORDER BY seq) FILTER (WHERE body <> '') AS body FROM i GROUP BY note_id, k""")
def w2_merged_senders(spark: SparkSession, sf: str) -> DataFrame:
    merged = chat.merged_senders(chat.messages(derived(spark, sf, "chats"), DAY))
    return merged.select("note_id", "place", "user", "n_messages", F.when(F.size("body") > 0, F.array_join("body", "\n")).alias("body"))


@query(_ITEMS + "SELECT note_id, string_agg(CAST(CASE WHEN f = 1 THEN number ELSE k END AS STRING), ',' ORDER BY k) AS numbers FROM v GROUP BY note_id")
def w3_fixed_lists(spark: SparkSession, sf: str) -> DataFrame:
    fixed = derived(spark, sf, "outlines").select("note_id", typeset.fix_lists(F.col("text")).alias("text"))
    return fixed.select("note_id", F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+)[.)] (?:one|two|three|four|nine)$"), F.lit(1)), ",").alias("numbers"))


@query(_HEADS + "SELECT doc_id AS note_id, na::INTEGER AS level, source AS title FROM n UNION ALL SELECT doc_id, nb::INTEGER, 'part ' || CAST(doc_id AS STRING) FROM n UNION ALL SELECT doc_id, nc::INTEGER, 'end' FROM n")
def w4_fixed_headings(spark: SparkSession, sf: str) -> DataFrame:
    fixed = derived(spark, sf, "outlines").select("note_id", typeset.fix_headings(F.col("text")).alias("text"))
    return typeset.heading_outline(fixed).select("note_id", "level", "title")


@query()
def w5_sorted_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.sort_blocks(derived(spark, sf, "outlines"))


@query(with_tables("files") + r""" SELECT path, 'Pasted image ' || strftime(TIMESTAMP '2026-04-20 12:30:45' + to_seconds(row_number() OVER (ORDER BY path) - 1), '%Y%m%d%H%M%S') || '.png' AS new_name FROM files WHERE ext = 'png'""")
def w6_allocated_names(spark: SparkSession, sf: str) -> DataFrame:
    files = derived(spark, sf, "files")
    return images.allocate_names(files.where("ext = 'png'").select("path", "ext"), files, AS_OF, ["path"]).select("path", "new_name")


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "posts").select("topic", "page", F.col("turn").alias("seq"), (F.col("turn") % 2).cast("string").alias("floor"), F.col("user_name").alias("user"), "text").withColumnRenamed("text", "body")


@query(r"""WITH asked AS (SELECT lang AS folder, doc_id AS src, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
taken AS (SELECT DISTINCT lang AS folder, 2 + doc_id // 3 AS k FROM documents WHERE doc_id % 2 = 0 UNION SELECT lang, 1 FROM documents WHERE doc_id % 7 = 0),
free AS (SELECT folder, k, row_number() OVER (PARTITION BY folder ORDER BY k) AS r
         FROM (SELECT folder, unnest(range(1, n + 2)) AS k FROM (SELECT folder, (SELECT count(*) FROM documents) * 2 AS n FROM asked GROUP BY folder)) ANTI JOIN taken USING (folder, k))
SELECT folder, src, CASE WHEN k = 1 THEN 'Photo.png' ELSE 'Photo ' || CAST(k AS STRING) || '.png' END AS free_name FROM asked JOIN free USING (folder, r)""")
def w6_free_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """One name asked for by every document, in the folders of their languages, beside numbered files."""
    docs = _table(spark, sf, "documents")
    numbered = docs.where("doc_id % 2 = 0").select(F.col("lang").alias("folder"), F.concat(F.lit("PHOTO "), F.expr("CAST(2 + doc_id DIV 3 AS STRING)"), F.lit(".png")).alias("name"))
    files = numbered.union(docs.where("doc_id % 7 = 0").select("lang", F.lit("photo.PNG")))
    return images.free_suffixes(docs.select(F.col("lang").alias("folder"), F.lit("Photo.png").alias("name"), F.col("doc_id").alias("src")), files).select("folder", "src", "free_name")


@query("""WITH p AS (SELECT conv_id AS topic, turn % 3 AS page, turn AS seq, CAST(turn % 2 AS STRING) || '|' || CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END || '|' || substr(text, 1, 40) AS k FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY topic, k ORDER BY page, seq) AS n FROM p) SELECT topic, page, seq FROM r WHERE n = 1""")
def w7_distinct_posts(spark: SparkSession, sf: str) -> DataFrame:
    return forum.distinct_posts(_posts(spark, sf)).select("topic", "page", "seq")


@query("""WITH p AS (SELECT conv_id AS topic, turn % 3 AS page, turn AS seq, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn % 3) AS d FROM conversations)
SELECT topic, page, seq, row_number() OVER (PARTITION BY topic ORDER BY page, seq) AS place FROM p WHERE d <= 50""")
def w8_in_page_order(spark: SparkSession, sf: str) -> DataFrame:
    return forum.in_page_order(_posts(spark, sf)).select("topic", "page", "seq", "place")


@query(with_tables("notes") + r""" SELECT note_id, '![[' || CAST(note_id AS STRING) || '.png]]|before|after' AS above, 'before|after|![[' || CAST(note_id AS STRING) || '.png]]' AS below FROM notes""")
def w9_image_order(spark: SparkSession, sf: str) -> DataFrame:
    body = F.array(F.lit("before"), F.concat(F.lit("![["), F.col("note_id").cast("string"), F.lit(".png]] after")))
    return derived(spark, sf, "notes").select("note_id", F.array_join(chat.image_order(body, "above"), "|").alias("above"), F.array_join(chat.image_order(body, "below"), "|").alias("below"))


@query()
def o1_collated_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's place among all, by its whole text collated with numbers by value."""
    docs = _table(spark, sf, "documents").select("doc_id", tags.collation_key(F.col("text")).alias("key"))
    return numbered_rows(docs, ["key", "doc_id"], "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query(_REFS + """, r AS (SELECT note_id, line, ord, target, row_number() OVER (PARTITION BY folder ORDER BY note_id, line, ord) AS n FROM refs) SELECT note_id, line, ord, target FROM r WHERE n <= 5""")
def o2_first_samples(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("folder").orderBy("note_id", "line", "ord"))
    return links.image_refs(derived(spark, sf, "notes")).withColumn("n", n).where("n <= 5").select("note_id", "line", "ord", "target")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def u4_distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return _table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("roles"))


# --- texts ------------------------------------------------------------------------------------------------


def _text_query(name: str, change: Callable, table: str = "notes", sql: str = "") -> None:  # noqa: ANN001
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return derived(spark, sf, table).select("note_id", change(F.col("text")).alias("new_text"))

    run.__name__ = name
    query(sql)(run)


_text_query("t1_fixed_indents", lambda t: typeset.fix_indent(F.concat(F.lit(" \tlead\n    four\n"), t)), "outlines", with_tables("outlines") + r" SELECT note_id, chr(9) || 'lead' || chr(10) || chr(9) || 'four' || chr(10) || text AS new_text FROM outlines")
_text_query("t2_fixed_markers", lambda t: typeset.fix_markers(F.concat(F.lit(">>quote\n-    item\n##   head\n\n"), t)), "outlines", with_tables("outlines") + r" SELECT note_id, '> > quote' || chr(10) || '- item' || chr(10) || '## head' || chr(10) || chr(10) || text AS new_text FROM outlines")
_text_query("t7_image_sizes", lambda t: links.sized_links(t, "120"), sql=with_tables("notes") + r""" SELECT note_id, regexp_replace(text, '!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', '![[\1|120]]', 'g') AS new_text FROM notes""")
_text_query("t14_blank_lines", lambda t: typeset.fix_blank_lines(F.concat(F.lit(" \t\n"), t)), "outlines", with_tables("outlines") + r""" SELECT note_id, array_to_string(list_transform(string_split(' ' || chr(9) || chr(10) || text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[\s\x{00a0}]+$') THEN '' ELSE x END), chr(10)) AS new_text FROM outlines""")
_text_query("t15_tag_layout", lambda t: tags.tag_layout(t), sql=with_tables("notes") + r""" SELECT note_id, regexp_replace(regexp_replace(text, '\n(!\[\[missing_[0-9]+\.png\]\]) #topic (!\[\[[0-9]+\.5\.png\]\])$', chr(10) || '\1 \2 #topic'), '\nplain #(tag-[0-9]) text$', chr(10) || 'plain text #\1') AS new_text FROM notes""")


#: An English word of each text, the first of three letters or more, or the note's number in letters where there is none.
_WORDS = r"""WITH w AS (SELECT doc_id AS note_id, coalesce(nullif(regexp_extract(text, '[A-Za-z]{3,}'), ''), 'none') AS w FROM documents)"""


def _lines(spark: SparkSession, sf: str, *lines: str) -> DataFrame:
    """Notes of some lines, each with the word of a document in place of W and its number in place of 7."""
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), _with_word(*lines).alias("text"))


def _with_word(*lines: str) -> Column:
    """Some lines with the word and number of a row of ``documents``."""
    w = F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit("")), F.lit("none"))
    return F.replace(F.replace(F.lit("\n".join(lines)), F.lit("7"), F.col("doc_id").cast("string")), F.lit("W"), w)


def _lines_sql(*lines: str) -> str:
    text = "\n".join(lines).replace("'", "''")
    return _WORDS + f""" SELECT note_id, replace(replace('{text}', '7', CAST(note_id AS VARCHAR)), 'W', w) AS new_text FROM w"""


_SPACES = {
    "用W卡片记": "用 W 卡片记", "第 7 章": "第7章", "用W7写": "用 W7 写", "设$x$为W": "设 $x$ 为 W", "**矩阵**$P$": "**矩阵** $P$", "中文**W**中文": "中文 **W** 中文", "见[[W]]和`W`吗": "见 [[W]] 和 `W` 吗", "- 做W 7": "- 做 W 7", "|W|7|": "|W|7|",
}
_SYMBOLS = {
    "中文 ，内容 。": "中文，内容。", "W,W": "W, W", "如, ：": "如,：", "甲 & 乙": "甲&乙", "甲 | 乙": "甲|乙", "甲 → 乙": "甲→乙", "W & W": "W & W", "$A$ & $B$": "$A$ & $B$", "（ + ）": "（+）", '" + "': '"+"', "《 W名 》": "《W名》", "x ^ 2": "x^2", "等等 ... 内容": "等等...内容", "( x )": "(x)", "中文 (说明)": "中文(说明)", "f (x)": "f(x)", "|x|": "|x|", "P(A|B)": "P(A|B)", "Q&A": "Q&A", "e.g. W": "e.g. W", "7. 并列：&": "7. 并列：&",
}
_WIDTHS = {
    "元素: $A$": "元素：$A$", "没有 $M_{ij}$, 且": "没有 $M_{ij}$，且", "中文;内容": "中文；内容", "真的吗?不是!": "真的吗？不是！", "Hello W，good day": "Hello W, good day", "中文。Hello W，good day": "中文。Hello W, good day", "参数 gain=7、shift=7": "参数 gain=7、shift=7", "`f(中,文)`": "`f(中,文)`", "[[笔记,W]]": "[[笔记,W]]", "![[图:一,二.png]]": "![[图:一,二.png]]", "[说明](a/中,W.md)": "[说明](a/中,W.md)", "$x中,文$": "$x中,文$", "《书,W》": "《书,W》", "张三: 2024/01/05 14:30:25": "张三: 2024/01/05 14:30:25", "1,000个": "1,000个", "时间12:30到": "时间12:30到", "(中, W)好": "(中, W)好", "中文/, 好": "中文/, 好",
}
_UNITS = {"长7kg": "长 7 kg", "7 kg": "7 kg", "7fps的": "7 fps 的", "7℃": "7 ℃", "1.5mm": "1.5 mm", "3D打印": "3D 打印"}


def _spacing_query(name: str, lines: dict[str, str], options: spacing.SpacingOptions = spacing.SpacingOptions()) -> None:
    @query(_lines_sql(*lines.values()))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spacing.fix_spacing(_lines(spark, sf, *lines), options).select("note_id", F.col("text").alias("new_text"))

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_spacing_query("t9_script_spacing", _SPACES)
_spacing_query("t10_symbol_spacing", _SYMBOLS)
_spacing_query("t11_widths", _WIDTHS)
_spacing_query("t12_units", _UNITS, spacing.SpacingOptions(digit_unit=True))


#: Lines in pieces, each with the kind of span that it is, or none.
_SPANS = [
    [("", "中 "), ("code", "`https://a.b/c`"), ("", " 文 "), ("url", "https://W.example/7"), ("", "，后")],
    [("comment", "%%W `x` %%"), ("", " and "), ("wikilink", "![[W|7]]"), ("", " see "), ("link", "[W](a/7.md)"), ("footnote", "[^7]")],
    [("", "mail "), ("email", "W7@W.org"), ("", " at "), ("host_port", "10.0.0.1:80")],
    [("", "x "), ("domain", "docs.example.org/W"), ("", " "), ("entity", "&amp;"), ("", " "), ("html", "<b>"), ("", "W"), ("html", "</b>"), ("", " "), ("tag", "#W-7")],
    [("code", "``a ` W``"), ("", " b")],
    [("", "```")],
    [("", "`none` W")],
    [("", "```")],
]


def _filled(text: str) -> str:
    """SQL for a text with the document's word in place of W and its number in place of 7."""
    return f"replace(replace('{text}', '7', CAST(note_id AS STRING)), 'W', w)"


def _spans_sql() -> str:
    rows = []
    for line, pieces in enumerate(_SPANS):
        before, ord_ = "", 0
        for kind, text in pieces:
            if kind:
                rows.append(f"SELECT note_id, {line}::INTEGER AS line, '{kind}' AS kind, {ord_}::INTEGER AS ord, {_filled(text)} AS span, length({_filled(before)})::INTEGER AS start, length({_filled(before + text)})::INTEGER AS \"end\" FROM w")
                ord_ += 1
            before += text
    return _WORDS + " " + " UNION ALL ".join(rows)


@query(_spans_sql())
def e7_placed_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of every kind with their places, some with what would be another inside; a code block is not searched."""
    return spacing.protected_spans(_lines(spark, sf, *["".join(text for _, text in line) for line in _SPANS]))


#: Lines with their classes: c code, i indented code, t table, m formula block.
_CLASSED = [
    ("---", "c"), ("title: W", "c"), ("---", "c"), ("text W", ""), ("", ""), ("    indented W", "i"), ("", ""), ("- item", ""), ("", ""), ("    of the item", ""), ("", ""), ("| a | W |", "t"), ("| --- | :-: |", "t"), ("| 7 | b |", "t"), ("$$", "m"), ("x = 7", "m"), ("$$", "m"), ("```py", "c"), ("$$ W", "c"), ("```", "c"), ("| no | rule |", ""), ("~~~~", "c"), ("~~~", "c"), ("open W", "c"),
]


@query(_WORDS + " SELECT note_id, line::INTEGER AS line, contains(k, 'c') AS is_code, contains(k, 'i') AS is_indented, contains(k, 't') AS is_table, contains(k, 'm') AS in_math FROM w, (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(_CLASSED)) + ") AS c(line, k)")
def e6_planted_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every class, with the word and number of each document."""
    return typeset.line_classes(_lines(spark, sf, *[x for x, _ in _CLASSED]))


_UNSORTED = ["# head W", "- pear W", "- apple 10 W", "  under", "- Apple 9 W", "", "3. cat W", "1. dog 7", "2. ant W", "", "4. b W", "9. a W", "| z |", "| a |", "> y W", "> x", "", "- [x] beta W", "- [ ] alpha"]
_SORTED = ["# head W", "- Apple 9 W", "- apple 10 W", "  under", "- pear W", "", "1. ant W", "2. cat W", "3. dog 7", "", "9. a W", "4. b W", "| z |", "| a |", "> y W", "> x", "", "- [ ] alpha", "- [x] beta W"]


@query(_lines_sql(*_SORTED))
def w5_planted_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Items with what belongs to them, runs of numbers and other numbers, tables and quotes that stay, with the word of each document."""
    return blocks.sort_blocks(_lines(spark, sf, *_UNSORTED))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id % 97, doc_id) - 1 AS place FROM documents")
def o1_numbers_by_value(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the order of a name with two numbers; case and accents do not count, nor do leading zeros."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("note ", "NOTE ", "nöte ", "Note 00")]), (F.col("doc_id") % 4 + 1).cast("int"))
    key = tags.collation_key(F.concat(name, (F.col("doc_id") % 97).cast("string"), F.lit("-"), F.col("doc_id").cast("string")))
    return numbered_rows(_table(spark, sf, "documents").select("doc_id", key.alias("key")), ["key"], "place").select("doc_id", F.col("place").cast("long").alias("place"))


_ROUGH = ["# 标题W", "", ">>引用W内容", "", "-    item W", "- 中文,内容", "", "5. one", "9. two", "", "`f(中,文)` ![[图:一,二.png]] $x中,文$", "", "```", "中文W,  -    x", "```", "", "真的吗?不是!"]
_LAID = ["# 标题 W", "", "> > 引用 W 内容", "", "- item W", "- 中文，内容", "", "1. one", "2. two", "", "`f(中,文)` ![[图:一,二.png]] $x中,文$", "", "```", "中文W,  -    x", "```", "", "真的吗？不是！"]


@query(_lines_sql(*_LAID))
def t17_planted_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The whole layout of notes with a line for each step and parts that must stay, with the word of each document."""
    return layout.typeset(_lines(spark, sf, *_ROUGH).withColumns({"path": F.lit("n.md"), "folder": F.lit("")})).select("note_id", "new_text")


_HTML = [
    "<blockquote>quoted W</blockquote>", '<p>See <a href="https://x.org/7">the W</a> and <img class="k" src="a/7.png"></p>', "<b>bold W</b> <I>it</I> <s>gone</s> <code>x7</code><br/>next",
    '<video src="v/7.mp4"></video><script>var W = 7;</script>', "<div>&lt;W&gt; &amp;amp; &#65;&#x4E2D;</div>", "<p></p><p></p>", "<!-- W -->", "<p></p>end W",
]
_HTML_READ = ["> quoted W", "See [the W](https://x.org/7) and ![](a/7.png)", "**bold W** *it* ~~gone~~ `x7`", "next [v/7.mp4](v/7.mp4) <W> &amp; A中", "", "end W"]


@query(_lines_sql(*_HTML_READ))
def e14_planted_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """A fragment with each element and references to characters, with the word and number of each document."""
    return forum.html_to_markdown(_lines(spark, sf, *_HTML), "text", "new_text").select("note_id", "new_text")


_TAG_LINES = ["# head #W one", "one #x7 W", "two W", "three #W.", "", "> quoted #b", "> text #a W", "other #c", "- item #z W", "- next", "", "#only", "#tags", "", "#lead W", "more", "| #k cell | W |", "a | #b | c"]
_TAGS_LAID = ["# head one #W", "one W", "two W", "three. #x7 #W", "", "> quoted", "> text W #b #a", "other #c", "- item W #z", "- next", "", "#only", "#tags", "", "W", "more #lead", "| cell #k | W |", "a | #b | c"]


@query(_lines_sql(*_TAGS_LAID))
def t15_tag_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of several lines, quotes, items, rows and headings, with the word of each document; its tags keep their order."""
    return _lines(spark, sf, *_TAG_LINES).select("note_id", tags.tag_layout(F.col("text"), sort=False).alias("new_text"))


@query()
def t9_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with a Chinese line before them."""
    notes = _table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.concat(F.lit("用anki卡片记笔记\n"), "text").alias("new_text"))
    return spacing.fix_spacing(notes, text_col="new_text")


@query(_MESSAGES + """, o AS (SELECT note_id, "user", h, mi, body, row_number() OVER (PARTITION BY note_id ORDER BY mi, seq) AS p FROM m)
SELECT note_id, string_agg("user" || ': 2024/01/05 ' || lpad(h, 2, '0') || ':' || mi || ':07' || CASE WHEN body <> '' THEN chr(10) || chr(9) || body ELSE '' END, chr(10) ORDER BY p) || chr(10) AS new_text FROM o GROUP BY note_id""")
def t3_rendered_chats(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render_chat(derived(spark, sf, "chats"), DAY, chat.ChatOptions(merge_same_user=False))


@query(r"""WITH p AS (SELECT conv_id, turn, '@name ' || trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(13)) || ' @other 大家好 a@b.example' AS x FROM conversations)
SELECT conv_id, turn, rtrim(regexp_replace(x, '(^|\s)[@＠][^\s@＠]+[ \t]*', '\1', 'g'), ' ') AS body FROM p""")
def t4_dropped_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn between two mentions and an address, which is none."""
    plain = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), r"^[ \t\r]+|[ \t\r]+$", "")
    body = chat.without_mentions(F.array(F.concat(F.lit("@name "), plain, F.lit(" @other 大家好 a@b.example"))))
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.get(body, F.lit(0)), F.lit("")).alias("body"))


@query(r"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS u, rtrim(replace(text, chr(10), ' '), ' ') AS body FROM conversations)
SELECT conv_id AS topic, string_agg('**' || u || '** (sig) #' || CAST(turn AS STRING) || ' · 2025-09-15 20:26' || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY conv_id""")
def t5_rendered_threads(spark: SparkSession, sf: str) -> DataFrame:
    return forum.render_threads(forum.floors(_pasted(spark, sf)), forum.ForumOptions(show_floor=True, show_time=True))


@query("SELECT doc_id, text FROM documents")
def t6_dropped_smilies(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("(bgm38)"), "text", F.lit("![](https://x.org/img/smiles/tv/12.gif)"))
    return _table(spark, sf, "documents").select("doc_id", forum.without_smilies(marked).alias("text"))


@query(_REFS + r""", shared AS (SELECT lower(name) AS l FROM files GROUP BY 1 HAVING count(*) > 1),
wanted AS (SELECT DISTINCT note_id, string_split(target, '#')[1] AS old, CASE WHEN lower(regexp_extract(resolved_path, '[^/]*$')) IN (SELECT l FROM shared) THEN resolved_path ELSE regexp_extract(resolved_path, '[^/]*$') END AS new
           FROM refs JOIN resolved USING (target) WHERE kind = 'wiki' AND resolved_path IS NOT NULL)
SELECT note_id, replace(text, '![[' || old, '![[' || new) AS new_text FROM wanted JOIN notes USING (note_id) WHERE old <> new""")
def t8_link_format(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.link_format(derived(spark, sf, "notes"), derived(spark, sf, "files"), full=False).select("note_id", "new_text")


@query(r"""SELECT doc_id, '第' || CAST(doc_id AS STRING) || '章 矩阵' AS spaced, '第' || CAST(doc_id AS STRING) || '章、矩阵' AS kept, '元素：$A$' AS wide FROM documents""")
def t13_chapters_and_widths(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    docs = _table(spark, sf, "documents").select("doc_id", F.concat(F.lit("第"), n, F.lit("章矩阵")).alias("spaced"), F.concat(F.lit("第"), n, F.lit("章、矩阵")).alias("kept"), F.concat(F.lit("元素: $A$"), F.when(F.col("doc_id") < 0, n).otherwise("")).alias("wide"))
    for column in ("spaced", "kept", "wide"):
        docs = spacing.fix_spacing(docs, text_col=column)
    return docs


@query(r"""SELECT doc_id AS note_id, replace(text, '`', '') || chr(10) || '设 $\alpha x$，值' AS new_text FROM documents""")
def t16_symbols_to_commands(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace(F.concat("text", F.lit("\n设 $αx$，值")), "`", "")
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), formulas.symbols_to_commands(text).alias("new_text"))


@query()
def t17_typeset(spark: SparkSession, sf: str) -> DataFrame:
    return layout.typeset(derived(spark, sf, "outlines")).select("note_id", "new_text")


# --- plans ------------------------------------------------------------------------------------------------


@query(_GROUPS + r""", drops AS (SELECT path AS dropped, keeper FROM kept WHERE path <> keeper),
asked AS (SELECT DISTINCT t AS target, regexp_replace(trim(string_split(t, '#')[1]), '^\./', '') AS t FROM found
          WHERE regexp_matches(trim(string_split(t, '#')[1]), '(?i)\.(png|jpg|jpeg|gif|bmp|webp|heic|avif|svg)$')),
""" + _RESOLVED + r""", spared AS (SELECT * FROM files WHERE path NOT IN (SELECT dropped FROM drops)),
linked AS (SELECT lower(regexp_extract(coalesce(keeper, t), '[^/]*$')) AS name FROM asked LEFT JOIN resolved USING (target) LEFT JOIN drops ON dropped = resolved_path)
SELECT 'trash' AS action, dropped AS src, keeper AS dst, NULL::BIGINT AS note_id, 'copy' AS reason FROM drops
UNION ALL SELECT 'convert', path, regexp_replace(path, '\.[^./]+$', '.webp'), NULL, NULL FROM spared
  WHERE ext IN ('png', 'jpg') AND lower(regexp_replace(path, '\.[^./]+$', '.webp')) NOT IN (SELECT lower(path) FROM spared)
UNION ALL SELECT 'trash', path, NULL, NULL, 'unused' FROM spared WHERE lower(name) NOT IN (SELECT name FROM linked)""")
def g1_tidy_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = image_plans.tidy_plan(derived(spark, sf, "notes"), derived(spark, sf, "canvases"), derived(spark, sf, "files"))
    return plan


@query(_ORGANISED + " SELECT action, src, dst, note_id, reason FROM organised")
def g2_organise_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = image_plans.organise_plan(derived(spark, sf, "notes"), derived(spark, sf, "canvases"), derived(spark, sf, "files"))
    return plan


_NAMED = _REFS + r""", f AS (SELECT s.resolved_path, min((r.note_id, r.line, r.ord, r.folder)) AS m FROM refs r JOIN resolved s USING (target) WHERE kind = 'wiki' AND s.resolved_path IS NOT NULL AND {which} GROUP BY 1),
chosen AS (SELECT f.resolved_path, m[1] AS note_id, m[4] AS folder, files.ext FROM f JOIN files ON path = resolved_path WHERE {files}),
dated AS (SELECT *, 'Pasted image ' || strftime(TIMESTAMP '2026-04-20 12:30:45' + to_seconds(row_number() OVER (ORDER BY note_id, resolved_path) - 1), '%Y%m%d%H%M%S') || '.' || lower(ext) AS new_name FROM chosen)
SELECT 'rename' AS action, resolved_path AS src, {want} || '/' || new_name AS dst, note_id, NULL::VARCHAR AS reason FROM dated"""
_GARBLED = _NAMED.replace("{which}", r"""(regexp_matches(regexp_extract(string_split(target, '#')[1], '[^/]*$'), '[\\%{}()\[\]~`^]') OR regexp_matches(regexp_extract(string_split(target, '#')[1], '[^/]*$'), '^[0-9.\s_-]+\.(png|jpg|jpeg|gif|bmp|webp|heic)$'))""").replace("{files}", "true").replace("{want}", "folder")
_PRESET = _NAMED.replace("{which}", "true").replace("{files}", r"""(NOT regexp_matches(name, '(?i)^Pasted image [0-9]{14}\.[^.]+$') OR lower(name) IN (SELECT lower(name) FROM files GROUP BY 1 HAVING count(*) > 1))""").replace("{want}", "regexp_replace(resolved_path, '/[^/]*$', '')")



@query(_GARBLED)
def g3_garbled_renames(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = image_plans.rename_plan(derived(spark, sf, "notes"), derived(spark, sf, "files"), AS_OF, canvases=derived(spark, sf, "canvases"))
    return plan


@query(_GARBLED)
def s7_change_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of the query before, written by action and read again."""
    at = f"{shared_folder(spark)}/notewright/plan-{uuid.uuid4().hex}"
    sources.write_plan(g3_garbled_renames(spark, sf), at)
    schema = "src string, dst string, note_id long, reason string, action string"
    return spark.read.schema(schema).parquet(at).select("action", "src", "dst", "note_id", "reason")


@query(_PRESET)
def g4_preset_renames(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = image_plans.rename_plan(derived(spark, sf, "notes"), derived(spark, sf, "files"), AS_OF, garbled_only=False, canvases=derived(spark, sf, "canvases"))
    return plan


@query(with_tables("notes") + r""", have AS (SELECT 'file:///C:/pics/pic_' || CAST(doc_id AS STRING) || '.png' AS path FROM documents WHERE lang = 'en'),
asked AS (SELECT note_id, folder, regexp_extract(text, '\((file:[^)]*)\)', 1) AS src FROM notes WHERE note_id % 10 = 9),
named AS (SELECT *, 'Pasted image ' || strftime(TIMESTAMP '2026-04-20 12:30:45' + to_seconds(row_number() OVER (ORDER BY note_id, src) - 1), '%Y%m%d%H%M%S') || '.webp' AS new_name FROM asked JOIN have ON src = path)
SELECT 'import' AS action, src, folder || '/' || new_name AS dst, note_id, NULL::VARCHAR AS reason FROM named
UNION ALL SELECT 'skip', src, NULL, note_id, 'unreadable' FROM asked WHERE src NOT IN (SELECT path FROM have)""")
def g5_external_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What can be read: the pictures of English documents."""
    notes = derived(spark, sf, "notes")
    have = _table(spark, sf, "documents").where("lang = 'en'").select(F.expr("'file:///C:/pics/pic_' || CAST(doc_id AS STRING) || '.png'").alias("path"), F.lit("png").alias("ext"))
    return image_plans.import_plan(notes, have, derived(spark, sf, "files"), AS_OF, target="webp")


@query(with_tables("notes") + r""", have AS (SELECT 'https://x.org/a/' || CAST(doc_id AS STRING) || '.jpg?s=1' AS path FROM documents WHERE lang = 'en'),
asked AS (SELECT note_id, folder, regexp_extract(text, '(https://x.org/a/[0-9]+\.jpg\?s=1)', 1) AS src FROM notes WHERE note_id % 10 = 9),
named AS (SELECT *, 'Pasted image ' || strftime(TIMESTAMP '2026-04-20 12:30:45' + to_seconds(row_number() OVER (ORDER BY note_id, src) - 1), '%Y%m%d%H%M%S') || '.jpg' AS new_name FROM asked JOIN have ON src = path)
SELECT 'import' AS action, src, folder || '/' || new_name AS dst, note_id, NULL::VARCHAR AS reason FROM named
UNION ALL SELECT 'skip', src, NULL, note_id, 'unreadable' FROM asked WHERE src NOT IN (SELECT path FROM have)""")
def g6_remote_imports(spark: SparkSession, sf: str) -> DataFrame:
    """What can be read: the pictures of English documents."""
    notes = derived(spark, sf, "notes")
    have = _table(spark, sf, "documents").where("lang = 'en'").select(F.expr("'https://x.org/a/' || CAST(doc_id AS STRING) || '.jpg?s=1'").alias("path"), F.lit("jpg").alias("ext"))
    return image_plans.import_plan(notes, have, derived(spark, sf, "files"), AS_OF, remote=True)


# --- streams ----------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS note_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 SECOND OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS c FROM events),
s AS (SELECT *, sum(c) OVER (PARTITION BY note_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
f AS (SELECT *, min(ts) OVER (PARTITION BY note_id, k) AS first_edit FROM s)
SELECT note_id, first_edit, max(ts) AS last_edit, count(*) AS n_edits FROM f WHERE ts <= first_edit + INTERVAL 20 SECOND GROUP BY note_id, k, first_edit""")
def x2_settled_edits(spark: SparkSession, sf: str) -> DataFrame:
    return edits.settled_edits(_table(spark, sf, "events").select(F.col("user_id").alias("note_id"), "ts"))


@query("SELECT conv_id AS topic, count(DISTINCT CAST(turn % 2 AS STRING) || '|' || role || '|' || substr(text, 1, 40)) AS n_posts FROM conversations GROUP BY conv_id")
def x3_distinct_post_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as a stream of files; what the stream keeps is appended to a table and counted."""
    at = f"{shared_folder(spark)}/notewright/stream-{uuid.uuid4().hex}"
    schema = _table(spark, sf, "conversations").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/conversations.parquet")
    posts = stream.select(F.col("conv_id").alias("topic"), (F.col("turn") % 2).cast("string").alias("floor"), F.col("role").alias("user"), F.col("text").alias("body"), F.lit("2025-09-15 20:26:00").cast("timestamp").alias("ts"))
    edits.distinct_post_stream(posts).select("topic").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("topic long").parquet(f"{at}/out").groupBy("topic").agg(F.count(F.lit(1)).alias("n_posts"))


_LOG = ["bob 2024/1/5 3:08:08", "later W", "", "ann 2024/1/5 3:02:02", "early W", "", "ann 3:02:04", "and 7", ""]
_LOG_LAID = ["ann: 2024/01/05 03:02:02", "\tearly W", "\tand 7", "bob: 2024/01/05 03:08:08", "\tlater W", ""]
_DUMP = ["Intro W", "", "#1 - 2025-9-15 20:26", "...", "alice (sig)", "first W", "收集", "#2 - 2025-9-15 20:30", "bob", "second 7", ""]
_DUMP_LAID = ["Intro W", "", "**alice** (sig)", "first W", "", "**bob**", "second 7"]


@query(f"""SELECT r.note_id, CASE r.note_id % 3 WHEN 0 THEN r.new_text WHEN 1 THEN l.new_text ELSE d.new_text END AS text
FROM ({_lines_sql(*_LAID)}) r JOIN ({_lines_sql(*_LOG_LAID)}) l ON r.note_id = l.note_id JOIN ({_lines_sql(*_DUMP_LAID)}) d ON r.note_id = d.note_id""")
def x1_planted_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Notes, chat logs and pasted threads that arrive as files, laid out by all steps."""
    text = F.when(F.col("doc_id") % 3 == 0, _with_word(*_ROUGH)).when(F.col("doc_id") % 3 == 1, _with_word(*_LOG)).otherwise(_with_word(*_DUMP))
    return _tidied(spark, sf, F.lit("n.md"), F.lit(""), text)


def _tidied(spark: SparkSession, sf: str, path: Column, folder: Column, text: Column) -> DataFrame:
    """Notes made of the documents, which arrive as a stream of files; what the stream lays out is read again."""
    at = f"{shared_folder(spark)}/notewright/stream-{uuid.uuid4().hex}"
    schema = _table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/documents.parquet")
    notes = stream.select(F.col("doc_id").alias("note_id"), path.alias("path"), folder.alias("folder"), text.alias("text"))
    edits.tidy_stream(notes, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return edits.tidied(spark, f"{at}/out", notes.schema).select("note_id", "text")


@query()
def x1_tidied_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as notes that arrive as files; what the stream lays out is appended to a table and read."""
    return _tidied(spark, sf, F.concat("source", F.lit("/n.md")), F.col("source"), F.concat("text", F.lit("\n##  head\n\n\n3. x\n4. y")))
