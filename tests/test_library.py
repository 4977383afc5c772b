"""Queries against their SQL, plans, streams, and tables with nulls or without rows."""

import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notewright import queries
from notewright.functions import links, tags
from notewright.operators import images, resolve
from notewright.plans import images as plans
from notewright.plans.typeset import LayoutOptions, typeset
from notewright.sources import notes as sources
from notewright.streaming import edits

SF = "/root/testdata/sf0.001"
CHEAP = ["j1_resolved_links", "j4_unreferenced_images", "a4_keepers", "e1_image_embeds", "w2_merged_senders", "w4_fixed_headings", "p4_converted_names", "u3_set_differences", "x2_settled_edits", "e8_note_tags", "e15_page_links", "e16_topic_urls", "w6_allocated_names", "a7_size_preview", "g4_preset_renames", "t15_tag_layout"]


def canonical(frame, columns):
    def cell(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, str | bool | pd.Timestamp) or float(v) != int(v) else int(v)

    return sorted((tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "events", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert canonical(got, columns) == canonical(want, columns)


NOTES = "note_id long, path string, folder string, text string"
FILES = "path string, name string, ext string, folder string, size long, content string"


def files(spark, *paths, content=None):
    content = content or {}
    rows = [(p, p.split("/")[-1], p.rsplit(".", 1)[-1].lower(), p.rpartition("/")[0], len(content.get(p, p)), content.get(p, p)) for p in paths]
    return spark.createDataFrame(rows, FILES)


def notes(spark, **texts):
    return spark.createDataFrame([(i, f"n/{k}.md", "n", t) for i, (k, t) in enumerate(texts.items())], NOTES)


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.md").write_text("one\n![[p.png]]", encoding="utf-8")
    (tmp_path / "a" / "b" / "y z.md").write_text("two", encoding="utf-8")
    (tmp_path / "a" / "c.canvas").write_text('{"nodes":[{"file":"a/p.png"}]}')
    (tmp_path / "a" / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    read = {r["path"]: r for r in sources.read_notes(spark, str(tmp_path)).collect()}
    assert set(read) == {"a/x.md", "a/b/y z.md"} and read["a/x.md"]["text"] == "one\n![[p.png]]" and read["a/b/y z.md"]["folder"] == "a/b"
    assert {r["ext"] for r in sources.read_documents(spark, str(tmp_path)).collect()} == {"md", "canvas"}
    listed = {r["path"]: r for r in sources.read_inventory(spark, str(tmp_path)).collect()}
    assert listed["a/p.png"]["size"] == 8 and listed["a/p.png"]["ext"] == "png"
    plan = sources.plan_rows(spark.createDataFrame([("s", "d")], "s string, d string"), "move", F.col("s"), F.col("d"))
    sources.write_plan(plan, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 1


def test_organise_decisions(spark):
    f = files(spark, "a/both.png", "a/one.png", "a/same.png", "n/attachments/same.png", "a/other.png", "n/attachments/other.png", "a/amb.png", "b/amb.png", "n/attachments/here.png", content={"a/same.png": "s", "n/attachments/same.png": "s", "a/other.png": "1", "n/attachments/other.png": "2"})
    n = notes(spark, x="![[a/both.png]] ![[a/one.png]] ![[a/same.png]] ![[a/other.png]] ![[amb.png]] ![[here.png]] ![[gone.png]]", y="[[both.png]]")
    plan, changed = plans.organise_plan(n, n.limit(0), f)
    got = {(r["action"], r["src"]): (r["dst"], r["reason"]) for r in plan.collect()}
    assert got == {("copy", "a/both.png"): ("n/attachments/both.png", None), ("move", "a/one.png"): ("n/attachments/one.png", None), ("relink", "a/same.png"): ("n/attachments/same.png", None), ("move", "a/other.png"): ("n/attachments/other 2.png", None), ("skip", "amb.png"): (None, "ambiguous"), ("skip", "gone.png"): (None, "missing")}
    assert "![[n/attachments/both.png]]" in changed.first()["new_text"]


def test_unreadable_document_copies_and_keeps(spark):
    f = files(spark, "a/one.png", "a/loose.png")
    n = notes(spark, x="![[a/one.png]]", bad=None)
    plan, _ = plans.organise_plan(n, n.limit(0), f)
    assert [r["action"] for r in plan.collect()] == ["copy"]
    assert resolve.unreferenced(f, n).count() == 0
    assert [r["path"] for r in resolve.unreferenced(f, n.where("text is not null")).collect()] == ["a/loose.png"]


def test_tidy_plan_keeps_the_keeper(spark):
    f = files(spark, "a/1.png", "a/2.png", "a/3.png", content={"a/1.png": "s", "a/2.png": "s", "a/3.png": "t"})
    n = notes(spark, x="![[a/2.png|9]] ![[a/1.png]] ![[2.png]]")
    plan, changed = plans.tidy_plan(n, n.limit(0), f)
    got = {(r["action"], r["src"], r["dst"]) for r in plan.collect()}
    assert got == {("trash", "a/1.png", "a/2.png"), ("convert", "a/2.png", "a/2.webp"), ("convert", "a/3.png", "a/3.webp"), ("trash", "a/3.png", None)}
    assert changed.first()["new_text"] == "![[a/2.png|9]] ![[a/2.png]] ![[2.png]]"


def test_tidy_plan_rewrites_links_of_every_kind(spark):
    f = files(spark, "a/1.png", "a/2 b.png", content={"a/1.png": "s", "a/2 b.png": "s"})
    n = notes(spark, x='![](a/2%20b.png) [[a/2 b.png#x|see]] ![t](<a/2 b.png> "title") ![[a/1.png]]', z="![[a/1.png]] ![[a/1.png]] ![[a/1.png]] ![[a/1.png]]")
    c = spark.createDataFrame([(9, "b.canvas", "", '{"nodes":[{"file":"a/2 b.png"}]}')], NOTES)
    plan, changed = plans.tidy_plan(n, c, f)
    assert [(r["src"], r["dst"]) for r in plan.where("action = 'trash'").collect()] == [("a/2 b.png", "a/1.png")]
    assert {r["note_id"]: r["new_text"] for r in changed.collect()} == {0: '![](a/1.png) [[a/1.png#x|see]] ![t](<a/1.png> "title") ![[a/1.png]]', 9: '{"nodes":[{"file":"a/1.png"}]}'}
    bad = n.union(spark.createDataFrame([(7, "n/bad.md", "n", None)], NOTES))
    assert plans.tidy_plan(bad, c, f)[0].where("action = 'trash'").count() == 0


def test_mappings_of_every_and_of_one_document(spark):
    n = spark.createDataFrame([(i, f"n/{i}.md", "n", "![[logo.png]] ![[own.png|5]]") for i in range(300)], NOTES)
    mapping = n.select("note_id", F.lit("own.png").alias("target"), F.concat(F.lit("x y "), F.col("note_id").cast("string"), F.lit(".png")).alias("new_target")).union(spark.createDataFrame([(None, "logo.png", "new.png")], "note_id long, target string, new_target string"))
    out = resolve.rewrite_links(n, mapping)
    assert {r["new_text"] for r in out.collect()} == {f"![[new.png]] ![[x y {i}.png|5]]" for i in range(300)}
    text = "\n".join(line for line in out._jdf.queryExecution().toString().split("\n") if "CartesianProduct" in line or "NestedLoop" in line)
    assert text == ""


def test_only_files_that_share_folder_and_size_are_hashed(spark):
    f = files(spark, "a/1.png", "a/2.png", content={"a/1.png": "s", "a/2.png": "s"})
    lines = images.duplicate_groups(f)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda what: min(len(x) - len(x.lstrip(" :+-")) for x in lines if what in x)
    assert depth("sha2(") < depth("Join LeftSemi")


def test_pasted_names(spark):
    cases = [("a/b.png", "image/png", "ab.png"), ("photo", "image/jpeg", "photo.jpg"), ("", "image/heif", "pasted-image.heic"), (None, None, "pasted-image.png"), ("data:image/png;base64,x", "image/gif", "pasted-image.gif"), ("x" * 81 + ".png", "", "pasted-image.png"), (".png", "image/bmp", ".png.bmp")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, n string, m string").select("i", images.pasted_name(F.col("n"), F.col("m")).alias("x"))
    assert dict(df.collect()) == {i: x for i, (_, _, x) in enumerate(cases)}


def test_size_preview(spark):
    n = notes(spark, x="![[a.png]] ![[b.png|300]] ![[c.png|100]] ![[d.png|a caption]] ![](e.jpg) ![f](g.png) ![[h.md]]", y="plain ![[h.md]]", z=None)
    assert [(r["changed"], r["skipped"], [tuple(s) for s in r["samples"]]) for r in links.size_preview(n, "100").collect()] == [(3, 2, [("![[a.png]]", "![[a.png|100]]"), ("![[b.png|300]]", "![[b.png|100]]"), ("![](e.jpg)", "![100](e.jpg)")])]
    assert links.size_preview(n, "100", overwrite=False).first()["skipped"] == 4


def test_allocated_names_skip_taken_seconds(spark):
    f = files(spark, "a/x.png", "a/Pasted image 20260420123046.png")
    asked = spark.createDataFrame([("p", "png"), ("q", "jpg"), ("r", "png")], "path string, ext string")
    named = images.allocate_names(asked, f, datetime.datetime(2026, 4, 20, 12, 30, 45), ["path"])
    assert sorted(r["new_name"][:-4] for r in named.collect()) == [f"Pasted image 202604201230{s}" for s in (45, 47, 48)]


def test_rename_and_import(spark):
    f = files(spark, "a/123.png", "a/fine.png")
    n = notes(spark, x="![[a/123.png|5]] ![p](C:\\pics\\z.png)", y="![[123.png]] ![[fine.png]]")
    at = datetime.datetime(2026, 4, 20, 12, 30, 45)
    plan, changed = plans.rename_plan(n, f, at)
    assert [(r["src"], r["dst"]) for r in plan.collect()] == [("a/123.png", "n/Pasted image 20260420123045.png")]
    assert {r["new_text"] for r in changed.collect()} == {"![[n/Pasted image 20260420123045.png|5]] ![p](C:\\pics\\z.png)", "![[n/Pasted image 20260420123045.png]] ![[fine.png]]"}
    have = spark.createDataFrame([("C:\\pics\\z.png", "png")], "path string, ext string")
    assert [(r["action"], r["dst"]) for r in plans.import_plan(n, have, f, at, target="webp").collect()] == [("import", "n/Pasted image 20260420123045.webp")]


def test_nulls_and_no_rows(spark):
    n, f = notes(spark, x=None, y=""), files(spark, "a/b.png")
    for df in (n, n.limit(0)):
        assert links.image_refs(df).count() == 0
        assert links.referenced_names(df).count() == 0
        assert resolve.broken_links(links.image_refs(df), f).count() == 0
    assert typeset(n, LayoutOptions(chat=None)).select("new_text").orderBy("note_id").collect() == [(None,), ("",)]
    assert images.duplicate_report(images.keepers(f, n)).first().asDict() == {"n_groups": 0, "n_drops": 0, "reclaimable": 0}


def test_typeset_settles(spark):
    n = notes(spark, x="##  a\n\n\n####  b\n3. x\n4. y\n用anki\n \t\n", y="# t\n用 anki")
    once = typeset(n, LayoutOptions(tags=True, sort_blocks=True)).select("note_id", "path", "folder", F.col("new_text").alias("text"))
    assert once.orderBy("note_id").first()["text"] == "## a\n\n\n### b\n1. x\n2. y\n用 anki\n\n"
    twice = typeset(once, LayoutOptions(tags=True, sort_blocks=True))
    assert twice.where("new_text <> text").count() == 0


def test_typeset_renders_threads(spark):
    text = "Intro\n\n#1 - 2025-9-15 20:26\n...\nalice (sig)\nfirst\n收集\n#2 - 2025-9-15 20:30\nbob\nsecond\n"
    out = typeset(notes(spark, x=text, y="plain #1 text"), LayoutOptions(chat=None)).orderBy("note_id").collect()
    assert [r["new_text"] for r in out] == ["Intro\n\n**alice** (sig)\nfirst\n\n**bob**\nsecond", "plain #1 text"]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:03"), (1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:00:01")]
    e = spark.createDataFrame(rows, "note_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["note_id"], r["n_edits"]) for r in edits.settled_edits(e).collect()) == [(1, 1), (1, 2), (2, 1)]
    e.write.parquet(str(tmp_path / "in"))
    stream = edits.settled_edits(spark.readStream.schema("note_id long, ts timestamp").parquet(str(tmp_path / "in")))
    assert stream.isStreaming
    n = notes(spark, x="##  a")
    n.write.parquet(str(tmp_path / "notes"))
    edits.tidy_stream(spark.readStream.schema(NOTES).parquet(str(tmp_path / "notes")), str(tmp_path / "out"), str(tmp_path / "cp"), LayoutOptions(chat=None)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == "## a"


def test_partition_counts_do_not_matter(spark):
    docs = queries._docs(spark, SF)
    f = queries.derived(spark, SF, "files")
    one, many = (sorted(map(tuple, resolve.unreferenced(f.select("path", "name").repartition(k), docs.repartition(k)).collect())) for k in (1, 7))
    assert one == many


def test_collated_order_is_that_of_one_sort(spark):
    got = queries.QUERIES["o1_collated_order"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r["doc_id"] for r in docs.orderBy(tags.collation_key(F.col("text")), "doc_id").select("doc_id").collect()]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(len(want)))


def test_entry_without_the_extra_operators(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
