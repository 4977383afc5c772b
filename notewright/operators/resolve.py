"""Resolving links to files, counting users and references, and rewriting links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.links import FILE_LINK, all_links, file_links, image_refs, link_target, referenced_names, with_target
from notewright.session import drop, written


def ambiguous_names(files: DataFrame) -> DataFrame:
    """(name, n_files): lower-cased file names that several folders hold."""
    return files.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")


def link_keys(files: DataFrame) -> DataFrame:
    """(how, key, hit, n): what a link may say to mean a file. Exact path; the end of a path after a slash; the bare name.

    Counted before the join, so a name that thousands of files share is one row.
    """
    parts = F.split(F.lower("path"), "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda k: F.when(k < F.size(parts), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/")))
    keys = files.select("path", F.explode(F.concat(F.array(F.struct(F.lit("path").alias("how"), F.col("path").alias("key")), F.struct(F.lit("name").alias("how"), F.lower("name").alias("key"))), F.transform(F.filter(ends, lambda e: e.isNotNull()), lambda e: F.struct(F.lit("suffix").alias("how"), e.alias("key"))))).alias("k"))
    return keys.groupBy("k.how", "k.key").agg(F.min("path").alias("hit"), F.count(F.lit(1)).alias("n"))


def resolve_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Adds resolved_path (null if none or several) and n_candidates to distinct rows of (target).

    A target with a slash means an exact path, else the only path that ends in it; one without means the only
    file of that name. All three are equi-joins.
    """
    path = F.regexp_replace(F.trim(F.element_at(F.split("target", "#"), 1)), r"^\./", "")
    deep = F.instr("_t", "/") > 0
    asked = targets.select("target", path.alias("_t"))
    keys = link_keys(files)
    exact = keys.where("how = 'path'").select(F.col("key").alias("_k1"), F.col("hit").alias("_exact"))
    other = keys.where("how <> 'path'").select("how", F.col("key").alias("_k2"), F.col("hit").alias("_hit"), F.col("n").alias("_n"))
    met = asked.join(exact, deep & (F.col("_t") == F.col("_k1")), "left").withColumn("_how", F.when(deep, "suffix").otherwise("name")).withColumn("_low", F.lower("_t"))
    met = met.join(other, (F.col("_how") == F.col("how")) & (F.col("_low") == F.col("_k2")), "left")
    n = F.when(F.col("_exact").isNotNull(), F.lit(1)).otherwise(F.coalesce("_n", F.lit(0)))
    return met.select("target", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_hit"))).alias("resolved_path"), n.cast("long").alias("n_candidates"))


def resolve_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References with resolved_path, n_candidates and ambiguous. Distinct targets are resolved once and joined back."""
    found = resolve_targets(refs.select("target").where("target is not null").distinct(), files)
    out = refs.join(found.withColumnRenamed("target", "_t"), F.col("target") == F.col("_t"), "left").drop("_t")
    return out.withColumn("ambiguous", F.coalesce(F.col("n_candidates") > 1, F.lit(False)))


def link_table(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``all_links`` with resolved_path and n_candidates (null for names), as a written table.

    Plans that ask several things of the same links read this table, so texts are read once and each target is resolved once.
    """
    found = written(all_links(docs), "found-links")
    hits = resolve_targets(found.where("role <> 'name'").select("target").distinct(), files).withColumnRenamed("target", "_t")
    table = written(found.join(hits, (F.col("target") == F.col("_t")) & (F.col("role") != "name"), "left").drop("_t"), "links")
    drop(found)
    return table


def names_in(table: DataFrame) -> DataFrame:
    """The rows of ``referenced_names`` from a link table."""
    return table.where("role = 'name'").select("note_id", F.col("target").alias("name"))


def users(docs: DataFrame | None, names: DataFrame | None = None) -> DataFrame:
    """(name, n_documents): documents that refer to an image name; ten links in one count once."""
    names = referenced_names(docs) if names is None else names
    return names.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_documents"))


def reference_counts(docs: DataFrame | None, names: DataFrame | None = None) -> DataFrame:
    """(name, n_refs): references to an image name, each occurrence counted."""
    names = referenced_names(docs) if names is None else names
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n_refs"))


def unreferenced(files: DataFrame, docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Images whose name no document refers to; none at all when a document is unreadable (its text is null)."""
    names = (referenced_names(docs) if names is None else names).select("name").distinct()
    unread = docs.agg(F.count_if(F.col("text").isNull()).alias("_unread"))
    loose = files.join(names.withColumnRenamed("name", "_name"), F.lower(files["name"]) == F.col("_name"), "left_anti")
    return loose.join(F.broadcast(unread), F.col("_unread") == 0).drop("_unread")  # one row


def broken_links(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(note_id, line, ord, target, reason) of references that mean no file, or several."""
    found = resolve_refs(refs, files).where("resolved_path is null")
    return found.select("note_id", "line", "ord", "target", F.when(F.col("ambiguous"), "ambiguous").otherwise("missing").alias("reason"))


def images_used_by(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Files that the references of some notes mean."""
    hits = resolve_refs(refs, files).where("resolved_path is not null").select("resolved_path").distinct()
    return files.join(hits, files["path"] == F.col("resolved_path"), "left_semi")


def rewrite_links(notes: DataFrame, mapping: DataFrame, kinds: str = "all", table: DataFrame | None = None) -> DataFrame:
    """Documents with changed links: note_id, path, folder, text, new_text.

    ``mapping`` has note_id (null: every document), target and new_target. ``kinds``: links of every kind, wiki links,
    Markdown images and file entries of canvases, or ``embeds`` of wiki style only. Only documents that hold a mapped
    target are rebuilt: their mappings meet their links by (document, target), those of every document by target,
    and are gathered to one map a document; the text is cut at its links and joined again. ``table``: their link table, if
    there is one.
    """
    link = FILE_LINK if kinds == "all" else r"!\[\[[^\[\]\n]+\]\]"
    refs = file_links(notes) if table is None else table.where("role = 'link'").select("note_id", "target")
    own = mapping.where("note_id is not null").select(F.col("note_id").alias("_n"), F.col("target").alias("_t"), "new_target")
    everywhere = mapping.where("note_id is null").groupBy(F.col("target").alias("_t")).agg(F.min("new_target").alias("new_target"))
    met = refs.join(own, (F.col("note_id") == F.col("_n")) & (F.col("target") == F.col("_t"))).select("note_id", "target", "new_target")
    met = met.union(refs.join(everywhere, F.col("target") == F.col("_t")).select("note_id", "target", "new_target"))
    maps = met.groupBy(F.col("note_id").alias("_note"), "target").agg(F.min("new_target").alias("new")).groupBy("_note").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "new")))).alias("_map"))
    text = F.col("text")
    links = F.regexp_extract_all(text, F.lit(f"({link})"), F.lit(1))

    def changed(x: Column) -> Column:
        new = F.try_element_at(F.col("_map"), link_target(x))
        return F.when(new.isNotNull(), with_target(x, new)).otherwise(x)

    whole = F.zip_with(F.split(text, link), F.concat(F.transform(links, changed), F.array(F.lit(""))), lambda g, y: F.concat(g, F.coalesce(y, F.lit(""))))
    out = notes.join(maps, F.col("note_id") == F.col("_note")).withColumn("new_text", F.array_join(whole, ""))
    return out.where("new_text <> text").select("note_id", "path", "folder", "text", "new_text")


def moved_links(table: DataFrame, moved: DataFrame) -> DataFrame:
    """(note_id, target, new_target) of every link of a link table, of any kind, that means a file of ``moved`` (src, dst)."""
    found = table.where("role = 'link' and resolved_path is not null")
    return found.join(moved.select(F.col("src").alias("_src"), "dst"), F.col("resolved_path") == F.col("_src")).select("note_id", "target", F.col("dst").alias("new_target"))


def link_format(notes: DataFrame, files: DataFrame, full: bool = True) -> DataFrame:
    """Notes whose resolved embeds are written as the full path, or as the bare name where only one file has it."""
    refs = image_refs(notes).where("kind = 'wiki'")
    found = resolve_refs(refs.select("note_id", "target").distinct(), files).where("resolved_path is not null")
    name = F.element_at(F.split("resolved_path", "/"), -1)
    if full:
        wanted = found.withColumn("new", F.col("resolved_path"))
    else:
        shared = ambiguous_names(files).select(F.col("name").alias("_shared"))
        wanted = found.join(shared, F.lower(name) == F.col("_shared"), "left").withColumn("new", F.when(F.col("_shared").isNull(), name).otherwise(F.col("resolved_path"))).drop("_shared")
    mapping = wanted.select("note_id", "target", F.col("new").alias("new_target"))
    return rewrite_links(notes, mapping, kinds="embeds")
