"""Jobs side by side in one session, replayed batches, and groups that fill many ranges."""

import hashlib
import os
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.functions import links
from notewright.operators import blocks, chat, forum, images, ranks, resolve
from notewright.plans.images import organise_plan, tidy_plan
from notewright.plans.typeset import LayoutOptions, typeset
from notewright.session import drop, shared_folder, table_scope, written
from notewright.sources.notes import read_digests, read_inventory, read_notes
from notewright.streaming import edits

NOTES = "note_id long, path string, folder string, text string"


def tables(spark):
    at = Path(shared_folder(spark).removeprefix("file:")) / "notewright"
    return {p.name for p in at.iterdir()} if at.exists() else set()


def test_scopes_drop_their_own_tables(spark):
    before = tables(spark)
    outside = written(spark.range(5), "outside")
    with table_scope() as outer:
        with table_scope() as inner:
            left, kept = written(spark.range(3), "left"), written(spark.range(4), "kept")
            inner.keep(kept)
        assert kept.count() == 4 and len(tables(spark) - before) == 2
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            left.count()
        assert outer.tables == [kept]
    assert outside.count() == 5 and len(tables(spark) - before) == 1
    drop(outside)
    assert tables(spark) == before


def test_jobs_in_two_threads_keep_their_tables(spark):
    """A layout drops its passes while another job writes tables and reads them later."""
    n = spark.createDataFrame([(i, f"n/{i}.md", "n", "##  a\nb 2024/1/5 14:30:25你好\n") for i in range(20)], NOTES)
    before, wrong, done = tables(spark), [], threading.Event()

    def other():
        with table_scope():
            mine = []
            while not done.is_set() or len(mine) < 3:
                mine.append(written(spark.range(len(mine) + 1), "other"))
                for k, table in enumerate(mine):
                    try:
                        assert table.count() == k + 1
                    except Exception as e:  # noqa: BLE001
                        wrong.append(e)
                        return

    thread = threading.Thread(target=other)
    thread.start()
    with table_scope():
        out = typeset(n, LayoutOptions(spacing=None)).select("new_text").distinct().collect()
    done.set()
    thread.join()
    assert not wrong and [r[0] for r in out] == ["## a\nb: 2024/01/05 14:30:25\n\t你好\n"]
    assert tables(spark) == before


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    n = spark.createDataFrame([(i, f"n/{i}.md", "n", f"##  head {i}\n3. x\n4. y") for i in range(6)], NOTES)
    options, target = LayoutOptions(chat=None, forum=None, spacing=None), str(tmp_path / "out")
    edits.tidy_batch(n.where("note_id < 3"), 0, target, options)
    for _ in range(2):
        edits.tidy_batch(n.where("note_id >= 3"), 1, target, options)
    rows = edits.tidied(spark, target, n.schema).orderBy("note_id").collect()
    assert [(r["note_id"], r["text"], r["batch"]) for r in rows] == [(i, f"## head {i}\n1. x\n2. y", int(i >= 3)) for i in range(6)]


def test_the_stream_lays_out_what_the_table_job_does(spark, tmp_path):
    texts = ["##  a\n用abc记, 好", "b 2024/1/5 14:30:25你好\nb 2024/1/5 14:30:20早", None, "#1 - 2025-9-15 20:26\nalice (sig)\nfirst\n#2 - 2025-9-15 20:30\nbob\nsecond\n"]
    n = spark.createDataFrame([(i, f"n/{i}.md", "n", t) for i, t in enumerate(texts)], NOTES)
    n.coalesce(2).write.parquet(str(tmp_path / "notes"))
    stream = spark.readStream.schema(NOTES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "notes"))
    edits.tidy_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = edits.tidied(spark, str(tmp_path / "out"), n.schema).orderBy("note_id").select("text").collect()
    assert [r[0] for r in got] == [r[0] for r in typeset(n).orderBy("note_id").select("new_text").collect()]


def one_log(spark, n):
    """One note of ``n`` messages in pairs of one sender, the times of each thousand turned round."""
    seq = F.col("id")
    row = [F.lit(1).cast("long").alias("note_id"), seq.alias("seq"), F.concat(F.lit("u"), ((seq / 2).cast("long") % 3).cast("string")).alias("user"), F.lit("2024/01/05").alias("date"), F.lit("00:00:00").alias("time"), F.lit(True).alias("has_date"), (F.floor(seq / 1000) * 1000 + 999 - seq % 1000).cast("long").alias("key"), F.array(F.col("id").cast("string")).alias("body"), F.when(seq % 1000 == 999, "text").otherwise("").alias("tail")]
    return spark.range(n).select(*row)


def test_one_log_of_a_million_messages(spark):
    """Every thousand messages end in text and are a run: sorted by time they stand the other way round."""
    n = 1_000_000
    msgs = one_log(spark, n)
    out = chat.time_ordered(msgs)
    wrong = F.col("place") != F.floor(F.col("seq") / 1000) * 1000 + 999 - F.col("seq") % 1000
    ends = (F.col("tail") != "") != (F.col("place") % 1000 == 999)
    assert out.agg(F.count("*"), F.count(F.when(wrong | ends, 1))).first() == (n, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "note_id" not in "".join(line for line in plan.split("\n") if "Window [" in line)
    sizes = [r["count"] for r in ranks.ranged(msgs, ["note_id", "seq"]).groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * ranks.ROWS_A_RANGE
    merged = chat.merged_senders(msgs)
    # Pairs of one sender; text after each thousandth message parts none of them.
    assert merged.agg(F.count("*"), F.min("n_messages"), F.max("n_messages"), F.sum("n_messages")).first() == (n // 2, 2, 2, n)


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_ranges_do_not_matter(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "ROWS_A_RANGE", size)
    rows = [(g, i, (i * 7 + g) % 5 or None, i % 3) for g in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "g int, i int, v int, w int").repartition(5)
    cut = ranks.ranged(df, ["g", "i"])
    cut = ranks.with_previous(cut, ["g"], ["g", "i"], ["v", "w"], "before")
    cut = ranks.with_last(cut, ["g"], ["g", "i"], F.when(F.col("w") == 0, F.col("v")), "last")
    got = [tuple(r) for r in ranks.running_total(cut, ["g", "i"], F.col("w"), "total").orderBy("g", "i").select("g", "i", "before.v", "before.w", F.col("before").isNull(), "last", "total").collect()]
    want, total = [], 0
    for k, (g, i, v, w) in enumerate(rows):
        total += w
        known = [a for h, j, a, b in rows if h == g and j <= i and b == 0 and a is not None]
        _, _, pv, pw = rows[k - 1] if i else (None,) * 4
        want.append((g, i, pv, pw, i == 0, known[-1] if known else None, total))
    assert got == want
    n = spark.createDataFrame([(1, "\n".join(["- b", "  more", "- a", "", "z", "", "3. y", "2. x", "", "> q", "> p"] * 9)), (2, None), (3, ""), (4, "2. b\n1. a")], "note_id long, text string")
    block = "- a\n- b\n  more\n\nz\n\n2. x\n3. y\n\n> q\n> p"
    assert dict(blocks.sort_blocks(n).collect()) == {1: "\n".join([block] * 9).replace("2. x\n3. y", "2. x\n3. y"), 3: "", 4: "1. a\n2. b"}


@pytest.mark.parametrize("size", [13, 100_000])
def test_pages_of_a_hot_topic(spark, monkeypatch, size):
    """A topic of 60 pages beside small ones: fifty pages are taken, and no window is by topic."""
    monkeypatch.setattr(forum.numbered_rows, "__defaults__", (size,))
    rows = [(1, 2 * p, s, f"b{p}{s}") for p in range(60) for s in range(3)] + [(None, 1, 0, "n"), (2, 5, 1, "x"), (2, 5, 0, "y"), (2, None, 9, "z")]
    posts = spark.createDataFrame(rows, "topic long, page int, seq int, body string").repartition(4)
    out = forum.in_page_order(posts)
    assert "partitionBy topic" not in out._jdf.queryExecution().toString() and "Window [topic" not in out._jdf.queryExecution().toString()
    got = sorted(((r["topic"] or 0, r["place"], r["body"]) for r in out.collect()))
    assert got == [(0, 1, "n"), *[(1, 3 * p + s + 1, f"b{p}{s}") for p in range(50) for s in range(3)], (2, 1, "z"), (2, 2, "y"), (2, 3, "x")]


def test_first_of_repeated_posts(spark):
    rows = [(1, 2, 0, "1", "u", "same"), (1, 1, 5, "1", "u", "same"), (1, 1, 4, "1", "u", "x" * 40 + "a"), (1, 1, 6, "1", "u", "x" * 40 + "b"), (None, 1, 0, None, "u", None), (None, 1, 1, None, "u", None)]
    posts = spark.createDataFrame(rows, "topic long, page int, seq int, floor string, user string, body string")
    assert sorted((r["page"], r["seq"], r["topic"] or 0) for r in forum.distinct_posts(posts).collect()) == [(1, 0, 0), (1, 4, 1), (1, 5, 1)]


def test_ranks_in_groups_over_many_ranges(spark):
    rows = [(k, i * 7 % 101, i) for i in range(300) for k in ("hot", None, f"k{i}")[: 1 + (i % 5 == 0) * 2]]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    out = ranks.ranked(df, ["k"], ["v", "i"], "n", rows_a_range=40).collect()
    for key in {r["k"] for r in out}:
        mine = sorted((r["v"], r["i"], r["n"]) for r in out if r["k"] == key)
        assert [n for _, _, n in mine] == list(range(1, len(mine) + 1))
    assert len(out) == len(rows)


def _suffixes_one_by_one(requests, files):
    """The smallest free number for each request in turn."""
    numbered = lambda name, n: name if n < 2 else (name[: name.rindex(".")] if "." in name else name) + f" {n}" + (name[name.rindex(".") :] if "." in name else "")
    taken = {(f, n.lower()) for f, n in files}
    asked = {(f, n.lower()) for f, n, _ in requests}
    out = {}
    for folder, name, src in sorted(requests, key=lambda r: (r[0], r[1].lower(), r[2])):
        k = 1
        while (folder, numbered(name, k).lower()) in taken or (k > 1 and (folder, numbered(name, k).lower()) in asked):
            k += 1
        out[src] = numbered(name, k)
        taken.add((folder, out[src].lower()))
    return out


def test_suffixes_of_a_hot_name(spark):
    requests = [("a", ("p.png", "P.PNG")[i % 2], i) for i in range(200)] + [("a", "p 5.png", 1000), ("a", "p 5.png", 1001), ("b", "p.png", 1002), ("b", "noext", 1003), ("b", "noext", 1004), ("b", "x.y 3", 1005), ("b", "x.y 3", 1006)]
    files = [("a", f"P {i}.png") for i in range(3, 300, 3)] + [("a", f"p {'9' * 30}.png"), ("a", "p 07.png"), ("b", "p.png"), ("b", "p.PNG"), ("b", "p 2.png"), ("b", "noext 2"), ("b", "x 2.y 3")]
    asked = spark.createDataFrame(requests, "folder string, name string, src long").withColumn("number", F.lit("clash")).repartition(5)
    have = spark.createDataFrame(files, "folder string, name string")
    out = images.free_suffixes(asked, have, rows_a_range=30)
    assert set(out.columns) == {"folder", "name", "src", "number", "free_name"}
    got = {r["src"]: r["free_name"] for r in out.collect()}
    assert got == _suffixes_one_by_one(requests, files)
    assert len({(f, got[s].lower()) for f, _, s in requests}) == len(requests)
    assert images.free_suffixes(asked.limit(0), have).count() == 0
    assert images.free_suffixes(asked, have.limit(0)).count() == len(requests)
    odd = spark.createDataFrame([("a", None, 1), (None, "x.png", 2), (None, "x.png", 3)], "folder string, name string, src long")
    assert images.free_suffixes(odd, have).where("free_name is null").count() == 1


def test_link_table_says_what_its_parts_say(spark):
    texts = ["![[a.png]] ![x](b%20c.png \"t\") [[a.png|w]]\n```\n![[in code.png]]\n```\n`![[no.png]]` ![[d/a.png#f]]", "plain", None, "", '{"nodes":[{"file":"d/a.png"}]}', "![[a.png]]![[a.png]]\n~~~\n![[a.png]]", "![long\nalt](a.png) [[x|y]] ![](<b c.png>)"]
    docs = spark.createDataFrame([(i, f"n{i}.md", "f", t) for i, t in enumerate(texts)], NOTES)
    files = spark.createDataFrame([("a.png", "a.png", ""), ("d/a.png", "a.png", "d"), ("e/b c.png", "b c.png", "e")], "path string, name string, folder string")
    table = resolve.link_table(docs, files)
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(table.where("role in ('wiki', 'markdown')").select("note_id", "role", "target")) == rows(links.image_refs(docs).select("note_id", "kind", "target"))
    assert rows(table.where("role = 'link'").select("note_id", "target", "resolved_path")) == rows(resolve.resolve_refs(links.file_links(docs), files).select("note_id", "target", "resolved_path"))
    assert rows(resolve.names_in(table)) == rows(links.referenced_names(docs))
    assert table.where("resolved_path = 'd/a.png'").count() > 0 and resolve.link_table(docs.limit(0), files).count() == 0


def test_organising_one_image(spark):
    docs = spark.createDataFrame([(1, "n.md", "f", "![[a.png]]")], NOTES)
    files = spark.createDataFrame([("x/a.png", "a.png", "x", 3, "png", "abc")], "path string, name string, folder string, size long, ext string, content string")
    plan, changed = organise_plan(docs, docs.limit(0), files)
    assert [tuple(r)[:3] for r in plan.collect()] == [("move", "x/a.png", "f/attachments/a.png")]
    assert changed.count() == 0  # the bare name means the moved file too


def test_a_burst_without_end_is_not_gathered(spark):
    steps = spark.range(200_000).select(F.lit(1).cast("long").alias("note_id"), F.timestamp_millis(F.col("id")).alias("ts"))
    few = spark.createDataFrame([(2, 0), (2, 4_999), (2, 4_999), (2, 9_999), (2, 10_000), (None, 0), (None, 1), (3, None)], "note_id long, ms long").select("note_id", F.timestamp_millis("ms").alias("ts"))
    out = edits.settled_edits(steps.union(few).repartition(7))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["note_id"], r["a"], r["b"], r["n_edits"]) for r in out.select("note_id", F.unix_millis("first_edit").alias("a"), F.unix_millis("last_edit").alias("b"), "n_edits").collect()}
    assert got == {(1, 0, 20_000, 20_001), (2, 0, 4_999, 3), (2, 9_999, 10_000, 2), (None, 0, 1, 2)}


def test_bursts_on_a_stream_are_those_of_the_table(spark, tmp_path):
    """Edits of many notes come out of order by up to eight seconds, in nine files; one note never pauses."""
    rng = np.random.default_rng(5)
    ticks = np.cumsum(rng.choice([100_000, 1_500_000, 4_999_999, 5_000_000, 9_000_000], 900))
    rows = [(int(k) if k else None, int(t)) for t, k in zip(ticks, rng.integers(0, 4, 900), strict=True)]
    rows += [(9, int(t)) for t in range(0, int(ticks[-1]), 700_000)]
    rows += [(2**60 + 1, 3), (2**60 + 1, 3)]
    rows.sort(key=lambda r: (r[1] + int(rng.integers(0, 8_000_000)), r[1]))
    last = max(t for _, t in rows)
    parts = [[int(x[0]), int(x[-1]) + 1] for x in np.array_split(np.arange(len(rows)), 8)]
    files = [rows[a:b] for a, b in parts] + [[(1000, last + 60_000_000)], [(1001, last + 120_000_000)]]
    base = 1_700_000_000_000_000
    for i, part in enumerate(files):
        spark.createDataFrame([(k, t + base) for k, t in part], "note_id long, us long").select("note_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        for f in (tmp_path / "in" / f"{i}").glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema("note_id long, ts timestamp").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = edits.settled_edits(stream).writeStream.format("memory").queryName("settled").trigger(availableNow=True).start()
    run.awaitTermination()
    table = spark.createDataFrame([(k, t + base) for k, t in rows], "note_id long, us long").select("note_id", F.timestamp_micros("us").alias("ts"))
    key = lambda df: sorted(map(str, map(tuple, df.select("note_id", "first_edit", "last_edit", "n_edits").where("note_id is null or note_id not in (1000, 1001)").collect())))
    assert key(spark.table("settled")) == key(edits.settled_edits(table))
    assert len(run.recentProgress) >= 9


def test_a_long_burst_keeps_few_times(spark):
    times = np.arange(0, 1_000_000 * 1000, 1000)
    burst, ahead, ended = edits.settle(None, times, 0)
    assert burst == edits.Burst(0, 0, 1, 0) and len(ahead) < 22_000 and ended == []
    burst, ahead, ended = edits.settle(burst, ahead, int(times[-1]))
    assert burst == edits.Burst(0, 20_000_000, 20_001, int(times[-1])) and len(ahead) == 0
    assert edits.settle(burst, ahead, int(times[-1]) + 5_000_000)[2] == [burst]


def test_only_files_that_may_be_copies_are_read(spark, tmp_path):
    """Files on disk: the others' addresses lead nowhere, so opening one would fail the job."""
    names = {"a/x y.png": "same", "a/50%+é#?中.PNG": "same", "a/z.png": "diff", "a/lone.png": "longer", "b/x y.png": "same", "b/w.png": "same", "b/gone.png": "gone", "n.md": "![[w.png]] ![[x y.png]]"}
    for name, content in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    files = read_inventory(spark, str(tmp_path), uris=True)
    files = written(files.withColumn("uri", F.when(F.col("path").isin("a/lone.png", "n.md"), "nosuch://x/y").otherwise(F.col("uri"))), "inventory")
    (tmp_path / "b/gone.png").unlink()
    groups = images.duplicate_groups(files)
    held = files.where("path <> 'b/gone.png'").join(spark.createDataFrame(list(names.items()), "path string, content string"), "path").drop("uri")
    assert "uri" not in groups.columns
    rows = lambda df: sorted(map(tuple, df.select("path", "digest", "n_copies").collect()))
    assert rows(groups) == rows(images.duplicate_groups(held)) and {r["path"] for r in groups.collect()} == {"a/x y.png", "a/50%+é#?中.PNG", "b/x y.png", "b/w.png"}
    docs = read_notes(spark, str(tmp_path))
    plans = [sorted(map(str, organise_plan(docs, docs.limit(0), f)[0].collect())) for f in (files.where("path <> 'b/gone.png'"), held)]
    assert plans[0] == plans[1] and len(plans[0]) > 0
    plans = [sorted(map(str, tidy_plan(docs, docs.limit(0), f)[0].collect())) for f in (files.where("path <> 'b/gone.png'"), held)]
    assert plans[0] == plans[1] and len(plans[0]) > 0
    assert images.duplicate_groups(files.limit(0)).count() == 0


def test_digests_are_dealt_by_bytes_and_number(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.png").write_bytes(bytes([i % 3]) * 100)
    files = read_inventory(spark, str(tmp_path), uris=True)
    out = read_digests(files.withColumn("copy", F.col("size")), bytes_a_task=500)
    assert out.rdd.getNumPartitions() == 8 and read_digests(files, files_a_task=4).rdd.getNumPartitions() == 10
    assert {(int(r["name"].split(".")[0]), r["digest"]) for r in out.collect()} == {(i, hashlib.sha256(bytes([i % 3]) * 100).hexdigest()) for i in range(40)}
