"""What jobs on notes compute once, and what they leave out of shuffles and workers."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from notewright.functions import formulas, spacing, tokens, typeset
from notewright.functions.lines import bound, first_of
from notewright.operators import blocks, forum
from notewright.plans import typeset as layout


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filters(df):
    """The filters of a plan, each with the lines of its condition."""
    return [part for part in re.split(r"\n(?=[\s:]*[+:]- )", plan(df)) if re.match(r"[\s:]*(?:[+:]- )?Filter", part)]


def test_headings_are_sought_once(spark):
    n = notes(spark, "plain", "## a\n```\n# no\n```\n#### b\n # c", None, "#none\n\n\t# code")
    fixed = n.select("note_id", typeset.fix_headings(F.col("text")).alias("text"))
    out = typeset.heading_outline(fixed).select("note_id", "line", "level", "title")
    assert sorted(out.collect()) == [(1, 0, 2, "a"), (1, 4, 3, "b"), (1, 5, 2, "c")]
    assert not any("transform(" in f for f in filters(out))
    assert plan(out).count("aggregate(") < 10


def test_list_items_are_sought_once(spark):
    n = notes(spark, "plain", "text\n\n3. a\n  \n4) b\nmore\n\n> 2. q\n\t5. in", None, "a 1. b", "```\n2. x\n```\n> 2. y\r\n> 3. z")
    out = typeset.list_items(n).select("note_id", "line", "number", "new_number", "style", "width", "quote_prefix")
    found = [(1, 2, 3, 1, ".", 0, ""), (1, 4, 4, 2, ")", 0, ""), (1, 7, 2, 1, ".", 1, ">"), (1, 8, 5, 1, ".", 4, ""), (4, 3, 2, 1, ".", 1, ">"), (4, 4, 3, 2, ".", 1, ">")]
    assert sorted(out.collect()) == found
    assert not any("transform(" in f for f in filters(out))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_blocks_are_sorted_in_their_note(spark):
    n = notes(spark, "- b\n  - in\n  more\n- a\n\ttext\ntext\n- c\n> q\n> p\n- z\n- y", None, "2. b\n1. a\n4. c", "3. b\n1. a\n2. c", "\n", "- b\n```\n- a\n```\n- 0\n- B\n- á", "")
    out = blocks.sort_blocks(n)
    new = ["- a\n\ttext\ntext\n- b\n  - in\n  more\n- c\n> q\n> p\n- y\n- z", "1. a\n2. b\n4. c", "1. a\n2. b\n3. c", "\n", "- b\n```\n- a\n```\n- 0\n- á\n- B", ""]
    assert dict(out.collect()) == dict(zip((0, 2, 3, 4, 5, 6), new, strict=True))
    assert exchanges(out) == 0


def test_one_note_of_many_items(spark):
    """A list of any length is sorted in time that grows with its lines, and numbered anew."""
    n = 20_000
    text = "\n".join(f"{i + 1}. name {(i * 7919) % n} x" for i in range(n))
    out = blocks.sort_blocks(notes(spark, "text\n" + text + "\n\n- b\n- a"))
    assert exchanges(out) == 0
    assert out.collect()[0]["new_text"] == "text\n" + "\n".join(f"{i + 1}. name {i} x" for i in range(n)) + "\n\n- a\n- b"


def test_block_lines_and_keys_cost_few_patterns(spark):
    """Kinds by first characters are what the patterns say, and the key of a block, with a pattern in it, is made once."""
    kinds = {"blank": ["", " \t", "\r", "\x0b\f", " \u2028"], "barrier": ["#", "\t###### a", "---", " *** ", "___", "|", "![a", "<b", "[^1]: a"], "chat": ["joe 2024/1/5 3:04:05", " 1 12:30:45"], "quote": [">", "\t> a"], "item": ["- ", " *\ta", "12) b", "+ 1:02"], "paragraph": ["####### a", "#a", "-a", "[x] a", "1.a", "1234567890. a", "!a", ": 1:2", "\u2028a", "\xa0- a", "５. a"]}
    rows = [(x, k) for k, xs in kinds.items() for x in xs]
    found = spark.createDataFrame(rows, "x string, k string").withColumn("found", blocks._kind(F.col("x")))
    assert found.where("NOT found <=> k").collect() == []
    out = blocks.sort_blocks(notes(spark, "- [ ] # b 010\n- **B 9**\n  in\n- 0\n- 00a\n- > a"))
    assert out.collect()[0]["new_text"] == "- 0\n- 00a\n- > a\n- **B 9**\n  in\n- [ ] # b 010"
    assert plan(out).count(r"(?:\[[ xX]\]") == 1
    assert "array_sort(" not in plan(out)


def test_pages_reach_workers_in_small_batches(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        pages = spark.range(2500).select("id", F.lit("<p>a &amp; b &eacute;</p>").alias("html"))
        assert {r["markdown"] for r in forum.html_to_markdown(pages).select("markdown").distinct().collect()} == {"a & b é"}
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (5, 5, 1, 30, 2)] + [None, ""]})
    assert [p.column("t").to_pylist() for p in forum.pieces(batch, "t", 10)] == [["aaaaa"] * 2, ["a"], ["a" * 30], ["aa", None, ""]]


def test_marks_are_told_by_ranges_first(spark):
    """Each mark is found, nothing between them is, and a text without them is passed by in ranges."""
    texts = spark.range(1, 0x3000).selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c").where("id not between 55296 and 57343")
    found = {r["c"] for r in texts.where(F.col("c").rlike(formulas._MARK)).collect()}
    assert found == set(formulas.SYMBOLS)


def test_a_pass_joins_logs_and_threads_only(spark):
    """Notes that are neither meet no exchange in a pass, and each text travels with the one before it."""
    n = notes(spark, "##  a\n3. x", None, "用anki")
    out = layout.one_pass(n.withColumn("_old", F.col("text")), layout.LayoutOptions())
    assert sorted(out.collect(), key=lambda r: r["note_id"]) == [(0, "## a\n1. x", "##  a\n3. x"), (1, None, None), (2, "用 anki", "用anki")]
    assert exchanges(out) == 0


def test_tokens_are_copied_by_few_steps(spark):
    """Each step that makes tokens anew copies them all: five at most, and the line's text."""
    n = notes(spark, "中文 ，内容 。W,W", None, "plain", "- **矩阵**$P$: e.g. W → 甲 。“ a ”1,000 个 ...")
    out = spacing.fix_spacing(n)
    assert out._jdf.queryExecution().analyzed().toString().count("AS _tokens#") <= 6
    found = {0: "中文，内容。W, W", 1: None, 2: "plain", 3: "- **矩阵** $P$：e.g. W→甲。“a”1,000个..."}
    assert dict(out.select("note_id", "text").collect()) == found


def test_kinds_are_told_without_patterns_first(spark):
    """A token's kind by its first character is what the patterns say, also at the edges of ranges."""
    kinds = {"C": "一 中文 鿯 㐀 々 あ カ 한 １ Ａ 𠀀", "L": "a zebra A Z é a's 7kg 3D", "W": "a.b x@y.org host:80 https://a 10.0.0.1:80 `c` [[a]] <b> #tag &amp;", "D": "0 9 1,000 12:30", "H": ", . ! ? :", "O": "(", "P": ")", "U": "℃ °C", "T": "《书》 “a”", "Q": '"a"', "M": "$x$", "F": "， 。 “", "S": "| ^ .. -- { [ ` @ \" $ ... 😀"}
    rows = [(t, k) for k, ts in kinds.items() for t in ts.split(" ")]
    out = spark.createDataFrame(rows, "t string, k string").withColumn("found", tokens.kind_of(F.col("t")))
    assert out.where("NOT found <=> k").collect() == []


def test_bound_values_and_first_branches(spark):
    row = spark.range(5).select(bound(lambda v: v["a"] * 2 + v["b"], a=F.col("id") + 1, b=F.lit(1)).alias("x"), first_of((F.col("id") < 2, "few"), (F.col("id") < 4, "some"), otherwise="many").alias("y"))
    assert [tuple(r) for r in row.collect()] == [(3, "few"), (5, "few"), (7, "some"), (9, "some"), (11, "many")]
