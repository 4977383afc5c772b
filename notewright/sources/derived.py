"""Tables of notes, files, chats and threads made from the given tables.

Each is one SELECT that Spark and DuckDB read alike, so a query and its check start from the same rows. They hold
what the jobs look for: links of every shape, copies, numbered lists, chat headers, posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "CAST(doc_id AS STRING)"

FILES = f"""
SELECT doc_id AS file_id, folder || '/' || name AS path, name, ext, folder, CAST(length(text) AS BIGINT) AS size, text AS content
FROM (SELECT doc_id, text,
        CASE WHEN doc_id % 25 = 3 THEN lang || '/f' || CAST(doc_id % 100 AS STRING) ELSE lang END AS folder,
        CASE WHEN doc_id % 25 = 3 THEN 'logo_' || CAST(doc_id - doc_id % 100 AS STRING) || '.PNG'
             WHEN doc_id % 25 = 4 THEN {_ID} || '.5.png'
             WHEN doc_id % 25 = 5 THEN 'Pasted image 20240102' || lpad(CAST(doc_id % 1000000 AS STRING), 6, '0') || '.png'
             WHEN doc_id % 50 = 1 THEN 'img_' || CAST(doc_id - 1 AS STRING) || '.webp'
             WHEN doc_id % 25 = 9 THEN 'shot%20' || {_ID} || '.jpg'
             ELSE 'img_' || {_ID} || '.png' END AS name,
        CASE WHEN doc_id % 50 = 1 AND doc_id % 25 <> 3 THEN 'webp' WHEN doc_id % 25 = 9 THEN 'jpg' ELSE 'png' END AS ext
      FROM documents)
"""

NOTES = f"""
SELECT doc_id AS note_id, source || '/note_' || {_ID} || '.md' AS path, source AS folder, text || chr(10) ||
  CASE doc_id % 10
    WHEN 0 THEN '![[' || lang || '/img_' || {_ID} || '.png]]'
    WHEN 1 THEN '![[img_' || CAST(doc_id - 1 AS STRING) || '.png|100]] and ![[img_' || CAST(doc_id - 1 AS STRING) || '.png]]'
    WHEN 2 THEN '![alt](img_' || CAST(doc_id - 2 AS STRING) || '.png "title")'
    WHEN 3 THEN '[[logo_' || CAST(doc_id - doc_id % 100 AS STRING) || '.png]] ![[logo_' || CAST(doc_id - doc_id % 100 AS STRING) || '.PNG]]'
    WHEN 4 THEN '![[missing_' || {_ID} || '.png]] #topic ' || '![[' || CAST(doc_id AS STRING) || '.5.png]]'
    WHEN 5 THEN '![[' || lang || '/img_' || {_ID} || '.png#top|300x200]]'
    WHEN 6 THEN 'plain #tag-' || CAST(doc_id % 7 AS STRING) || ' text'
    WHEN 7 THEN '```' || chr(10) || '![[img_' || {_ID} || '.png]]' || chr(10) || '```' || chr(10) || 'done #code'
    WHEN 8 THEN 'see `![[img_' || {_ID} || '.png]]` and ![[f' || CAST(doc_id % 100 AS STRING) || '/logo_' || CAST(doc_id - doc_id % 100 AS STRING) || '.png]]'
    ELSE '![p](file:///C:/pics/pic_' || {_ID} || '.png) ![r](https://x.org/a/' || {_ID} || '.jpg?s=1)' END AS text
FROM documents
"""

CANVASES = f"""
SELECT 1000000000000 + doc_id AS note_id, source || '/board_' || {_ID} || '.canvas' AS path, source AS folder,
  '{{"nodes":[{{"type":"file","file":"' || lang || '/img_' || CAST(doc_id + 2 AS STRING) || '.png"}}]}}' AS text
FROM documents WHERE doc_id % 40 = 6
"""

#: Headings of uneven levels and lists that start anywhere, among the lines of a text.
OUTLINES = f"""
SELECT doc_id AS note_id, repeat('#', CAST(1 + doc_id % 3 AS INT)) || ' ' || source || chr(10) || text || chr(10) ||
  repeat('#', CAST(2 + doc_id % 5 AS INT)) || ' part ' || {_ID} || chr(10) ||
  CAST(1 + doc_id % 4 AS STRING) || '. one' || chr(10) || CAST(5 + doc_id % 2 AS STRING) || '. two' || chr(10) || chr(10) ||
  CAST(7 AS STRING) || '. three' || chr(10) || 'text' || chr(10) || '4) four' || chr(10) ||
  repeat('#', CAST(1 + doc_id % 6 AS INT)) || ' end' || chr(10) || '9. nine' AS text
FROM documents
"""

#: One message a turn; every fifth conversation is written out of order. Times fall in one day.
CHATS = """
SELECT conv_id AS note_id,
  string_agg(role || ' 2024/1/5 ' || CAST(1 + conv_id % 22 AS STRING) || ':' || lpad(CAST(turn % 60 AS STRING), 2, '0') || ':07' ||
             chr(10) || replace(text, chr(10), ' ') || chr(10),
             chr(10) ORDER BY CASE WHEN conv_id % 5 = 0 THEN -turn ELSE turn END) AS text
FROM conversations GROUP BY conv_id
"""

#: Floors of a pasted thread, one a turn, and some twice.
POSTS = """
SELECT conv_id AS topic, turn % 3 AS page, turn, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS user_name, text FROM conversations
"""

_TABLES = {"files": FILES, "notes": NOTES, "canvases": CANVASES, "outlines": OUTLINES, "chats": CHATS, "posts": POSTS}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables above, over the tables in ``sf_dir``."""
    for table in ("documents", "conversations"):
        if table in _TABLES[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    sql = _TABLES[name]
    if name == "chats":  # Spark orders inside listagg by an expression over its input only
        sql = sql.replace("string_agg(", "listagg(").replace("chr(10) ORDER BY", "chr(10)) WITHIN GROUP (ORDER BY")
    return spark.sql(sql)


def with_tables(*names: str) -> str:
    """The start of a WITH clause that holds these tables, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n]})" for n in names)
