"""Plans over all images of a corpus. Each gives plan rows and the notes whose links change."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.links import external_images, image_refs, referenced_names, remote_images
from notewright.operators.images import PRESET, allocate_names, attachment_folder, conversions, digests, free_suffixes, is_garbled, keepers, matches_preset
from notewright.operators.resolve import ambiguous_names, link_table, moved_links, names_in, resolve_refs, rewrite_links, unreferenced, users
from notewright.session import written
from notewright.sources.notes import all_documents, images_only, plan_rows


def tidy_plan(notes: DataFrame, canvases: DataFrame, files: DataFrame, target: str = "webp") -> tuple[DataFrame, DataFrame]:
    """Copies merged into their keepers, conversions of what stays, then images that the rewritten documents do not use.

    Links of every kind in notes and canvases that mean a copy are rewritten to its keeper. With an unreadable document no
    copy is dropped, as it may be linked there.
    """
    docs = all_documents(notes, canvases)
    table = link_table(docs, files.drop("content", "uri"))
    kept = keepers(files, None, names_in(table))
    unread = docs.agg(F.count_if(F.col("text").isNull()).alias("_unread"))  # one row
    drops = written(kept.where(~F.col("is_keeper")).join(F.broadcast(unread), F.col("_unread") == 0).drop("_unread"), "drops")
    mapping = moved_links(table, drops.select(F.col("path").alias("src"), F.col("keeper").alias("dst")))
    changed = written(rewrite_links(docs, mapping, table=table), "changed")
    # Names are read again in documents that change only.
    same = names_in(table).join(changed.select(F.col("note_id").alias("_n")), F.col("note_id") == F.col("_n"), "left_anti")
    names = same.union(referenced_names(changed.select("note_id", F.col("new_text").alias("text"))))
    left = images_only(files).join(drops.select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti")
    loose = unreferenced(left, docs, names)
    plan = plan_rows(drops, "trash", F.col("path"), F.col("keeper"), reason=F.lit("copy"))
    plan = plan.unionByName(plan_rows(conversions(left, target), "convert", F.col("path"), F.col("new_path")))
    return plan.unionByName(plan_rows(loose, "trash", F.col("path"), F.lit(None).cast("string"), reason=F.lit("unused"))), changed


def organise_plan(notes: DataFrame, canvases: DataFrame, files: DataFrame, mode: str = "subfolder", custom: str = "attachments") -> tuple[DataFrame, DataFrame]:
    """Images brought to their notes' attachment folders: moved, copied where other documents use them, or only relinked
    where the same bytes are there; links that mean nothing or several files are skipped with a reason.

    One snapshot decides: an image that two notes want is copied for both. With an unreadable document nothing is moved.
    """
    docs = all_documents(notes, canvases)
    bare = files.drop("content", "uri")
    table = link_table(docs, bare)
    found = table.where("role = 'wiki'").join(canvases.select(F.col("note_id").alias("_c")), F.col("note_id") == F.col("_c"), "left_anti").withColumn("want", attachment_folder(F.col("folder"), mode, custom=custom))
    skipped = plan_rows(found.where("resolved_path is null"), "skip", F.col("target"), F.lit(None).cast("string"), F.col("note_id"), F.when(F.col("n_candidates") > 1, "ambiguous").otherwise("missing"))
    meta = bare.select(F.col("path").alias("resolved_path"), "name", F.col("folder").alias("at"), "size")
    away = written(found.where("resolved_path is not null").select("note_id", "target", "want", "resolved_path").distinct().join(meta, "resolved_path").where("at <> want"), "away")
    # The same name and size in the wanted folder; only such pairs are hashed.
    there = files.select(F.col("folder").alias("want"), F.lower("name").alias("_l"), "size", F.col("path").alias("_there"))
    alike = written(away.select("resolved_path", "want", "size", F.lower("name").alias("_l")).distinct().join(there, ["want", "_l", "size"]).select("resolved_path", "want", "_there"), "alike")
    hashed = digests(files.select("path", *(["uri", "size"] if "uri" in files.columns else ["content"])), alike.select(F.col("resolved_path").alias("path")).union(alike.select("_there")).distinct()).where("digest is not null")
    of = lambda path, digest: hashed.select(F.col("path").alias(path), F.col("digest").alias(digest))
    same = alike.join(of("resolved_path", "_d1"), "resolved_path").join(of("_there", "_d2"), "_there").where("_d1 = _d2").groupBy("resolved_path", "want").agg(F.min("_there").alias("same"))
    met = away.join(same, ["resolved_path", "want"], "left")
    used = users(None, names_in(table)).select(F.col("name").alias("_l"), "n_documents")
    unread = docs.agg(F.count_if(F.col("text").isNull()).alias("unread"))
    met = met.join(used, F.lower("name") == F.col("_l"), "left").drop("_l").join(F.broadcast(unread))  # one row
    alone = (F.coalesce("n_documents", F.lit(0)) <= 1) & (F.col("unread") == 0)
    decided = met.withColumn("action", F.when(F.col("same").isNotNull(), "relink").when(alone, "move").otherwise("copy"))
    carried = decided.where("action <> 'relink'").select(F.col("want").alias("folder"), "name", F.col("resolved_path").alias("src")).distinct()
    placed = free_suffixes(carried, bare).select(F.col("folder").alias("_w"), F.col("src").alias("_src"), "free_name")
    full = decided.join(placed, (F.col("want") == F.col("_w")) & (F.col("resolved_path") == F.col("_src")), "left")
    full = full.withColumn("dst", F.when(F.col("action") == "relink", F.col("same")).otherwise(F.concat_ws("/", F.when(F.col("want") != "", F.col("want")), F.col("free_name"))))
    plan = plan_rows(full, F.col("action"), F.col("resolved_path"), F.col("dst"), F.col("note_id")).unionByName(skipped)
    # A name that another folder has too is written with its path; after a move the name is where it was once.
    shared = ambiguous_names(bare).select(F.col("name").alias("_shared"))
    name = F.element_at(F.split("dst", "/"), -1)
    mapping = full.join(shared, F.lower(name) == F.col("_shared"), "left").select("note_id", "target", F.when((F.col("action") == "move") & F.col("_shared").isNull(), name).otherwise(F.col("dst")).alias("new_target"))
    # What moves is written anew in links of the other kinds too.
    moved = moved_links(table, full.where("action = 'move'").select(F.col("resolved_path").alias("src"), "dst").distinct())
    other = moved.join(mapping.select("note_id", "target"), ["note_id", "target"], "left_anti")
    return plan, rewrite_links(docs, mapping.union(other), table=table)


def rename_plan(notes: DataFrame, files: DataFrame, as_of: datetime.datetime, garbled_only: bool = True, force: bool = False, mode: str = "current", preset: str = PRESET, canvases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Images renamed by the preset, each once: those with garbled names, which go to the attachment folder of the
    first note that holds them, or all that do not match the preset yet (with ``force``, all). Links of every kind
    that mean them, in ``canvases`` too where given, follow."""
    refs = image_refs(notes).where("kind = 'wiki'")
    if garbled_only:
        refs = refs.where(is_garbled(F.element_at(F.split(F.element_at(F.split("target", "#"), 1), "/"), -1)))
    found = resolve_refs(refs, files).where("resolved_path is not null")
    want = attachment_folder(F.col("folder"), mode) if garbled_only else F.regexp_replace("resolved_path", "/?[^/]*$", "")
    first = found.withColumn("want", want).groupBy("resolved_path").agg(F.min(F.struct("note_id", "line", "ord", "want")).alias("f")).select("resolved_path", "f.note_id", "f.want").join(files.select(F.col("path").alias("resolved_path"), "name", "ext"), "resolved_path")
    if not garbled_only and not force:
        shared = ambiguous_names(files).select(F.col("name").alias("_shared"))
        first = first.join(shared, F.lower("name") == F.col("_shared"), "left").where(~matches_preset(F.col("name"), preset) | F.col("_shared").isNotNull()).drop("_shared")
    named = allocate_names(first, files, as_of, ["note_id", "resolved_path"], preset).withColumn("dst", F.concat_ws("/", F.when(F.col("want") != "", F.col("want")), F.col("new_name")))
    plan = plan_rows(named, "rename", F.col("resolved_path"), F.col("dst"), F.col("note_id"))
    docs = all_documents(notes, canvases) if canvases is not None else notes
    table = link_table(docs, files)
    mapping = moved_links(table, named.select(F.col("resolved_path").alias("src"), "dst"))
    return plan, rewrite_links(docs, mapping, table=table)


def rename_preview(notes: DataFrame, files: DataFrame, preset: str = PRESET) -> DataFrame:
    """One row: images a rename run would touch, each once."""
    found = resolve_refs(image_refs(notes).where("kind = 'wiki'").select("target").distinct(), files).where("resolved_path is not null")
    return found.where(~matches_preset(F.element_at(F.split("resolved_path", "/"), -1), preset)).agg(F.countDistinct("resolved_path").alias("n_renames"))


def import_plan(notes: DataFrame, sources: DataFrame, files: DataFrame, as_of: datetime.datetime, remote: bool = False, mode: str = "current", target: str | None = None) -> DataFrame:
    """Copies of outside images into attachment folders under new names: plan rows with action ``import``.

    ``sources`` lists what can be read (path, ext): paths of a machine, or URLs already fetched. Others stay as they
    are and give a ``skip`` row. One row for each image of a note; ``target`` is the extension after conversion.
    """
    asked = remote_images(notes).select("note_id", F.col("url").alias("src")) if remote else external_images(notes).select("note_id", F.col("target").alias("src")).distinct()
    have = sources.select(F.col("path").alias("_p"), "ext")
    met = asked.join(have, F.col("src") == F.col("_p"), "left").join(notes.select(F.col("note_id").alias("_n"), attachment_folder(F.col("folder"), mode).alias("want")), F.col("note_id") == F.col("_n")).drop("_n")
    ready = met.where("_p is not null").withColumn("ext", F.lit(target) if target else F.col("ext"))
    named = allocate_names(ready, files, as_of, ["note_id", "src"])
    plan = plan_rows(named, "import", F.col("src"), F.concat_ws("/", F.when(F.col("want") != "", F.col("want")), F.col("new_name")), F.col("note_id"))
    return plan.unionByName(plan_rows(met.where("_p is null"), "skip", F.col("src"), F.lit(None).cast("string"), F.col("note_id"), F.lit("unreadable")))
