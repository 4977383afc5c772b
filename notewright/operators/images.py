"""Image files: copies, keepers, orphans, names, conversions."""

from __future__ import annotations

import datetime
import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.operators.ranks import numbered_rows, ranked
from notewright.operators.resolve import reference_counts
from notewright.session import written
from notewright.sources.notes import IMPORT_EXTENSIONS, images_only, read_digests

PRESET = "Pasted image {YYYY}{MM}{DD}{HH}{mm}{ss}"
_PARTS = {"{YYYY}": ("yyyy", 4), "{MM}": ("MM", 2), "{DD}": ("dd", 2), "{HH}": ("HH", 2), "{mm}": ("mm", 2), "{ss}": ("ss", 2)}
_EXTENSION = rf"(?i)\.(?:{'|'.join(IMPORT_EXTENSIONS)})$"


# --- copies -----------------------------------------------------------------------------------------------


#: Most rows of keys to send to all tasks; more are joined by a shuffle.
MOST_SENT = 200_000


def digests(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``files`` that have the columns of ``wanted`` (distinct rows), with digest (SHA-256) instead of content or uri.

    Files that say where they are (uri, size) are joined with the keys on metadata alone, and only those that match are
    read, at any number of keys. For a table that holds contents the few keys, which are counted, go to the files, and only
    files that match are hashed, where they lie; with very many keys all files are hashed where they lie and then joined.
    Contents are never shuffled.
    """
    if "uri" in files.columns:
        return written(read_digests(files.join(wanted, wanted.columns, "left_semi").select(*files.columns)).drop("uri"), "digests")
    keys = written(wanted.select(*[F.col(c).alias(f"_{c}") for c in wanted.columns]), "keys")
    same = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in wanted.columns])
    digest = F.sha2(F.col("content").cast("binary"), 256)
    if keys.count() <= MOST_SENT:
        return files.join(F.broadcast(keys), same, "left_semi").withColumn("digest", digest).drop("content")
    return files.withColumn("digest", digest).drop("content").join(keys, same, "left_semi")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Files whose bytes another file in the same folder has: their columns without content or uri, and digest.

    Folder and size are counted on metadata alone; only files that share both are hashed, and, if the files say where they
    are (uri) instead of holding their contents, only these are read. The byte length is part of the key.
    """
    same = images_only(files).groupBy("folder", "size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = digests(images_only(files), same).where("digest is not null")
    sizes = met.groupBy(F.col("folder").alias("_f"), F.col("size").alias("_s"), F.col("digest").alias("_d")).agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return met.join(sizes, (F.col("folder") == F.col("_f")) & (F.col("size") == F.col("_s")) & (F.col("digest") == F.col("_d"))).drop("_f", "_s", "_d")


def keepers(files: DataFrame, docs: DataFrame | None, names: DataFrame | None = None) -> DataFrame:
    """(path, name, keeper, is_keeper, ...) of all copies: the copy with most references stays, then the smallest name.

    The best copy of a group is an aggregate with partial results, not a window over the group.
    """
    groups = duplicate_groups(files)
    counts = reference_counts(docs, names).select(F.col("name").alias("_name"), "n_refs")
    counted = groups.join(counts, F.lower("name") == F.col("_name"), "left").drop("_name").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    best = counted.groupBy(F.col("folder").alias("_f"), F.col("digest").alias("_d")).agg(F.min_by("path", F.struct(-F.col("n_refs"), F.col("name"))).alias("keeper"))
    return counted.join(best, (F.col("folder") == F.col("_f")) & (F.col("digest") == F.col("_d"))).drop("_f", "_d").withColumn("is_keeper", F.col("path") == F.col("keeper"))


def duplicate_report(kept: DataFrame) -> DataFrame:
    """One row: groups, copies to drop, and the bytes that frees."""
    return kept.agg(F.count_if("is_keeper").alias("n_groups"), F.count_if(~F.col("is_keeper")).alias("n_drops"), F.coalesce(F.sum(F.when(~F.col("is_keeper"), F.col("size"))), F.lit(0)).alias("reclaimable"))


# --- names ------------------------------------------------------------------------------------------------


def is_garbled(name: Column) -> Column:
    """A name with marks that file systems or links choke on, that is URL-encoded, or only digits and dots."""
    decoded = F.try_url_decode(F.regexp_replace(name, "\\+", "%2B"))
    stem = F.regexp_replace(name, _EXTENSION, "")
    return name.rlike(r"[\\%{}()\[\]~`^]") | F.coalesce(decoded != name, F.lit(False)) | ((stem != "") & ~stem.rlike(r"[^\d.\s\-_]"))


def preset_pattern(preset: str = PRESET) -> str:
    """The regular expression of names a preset gives, with any extension, any case, and a numbered suffix of none."""
    parts = re.split(r"(\{[A-Za-z]+\})", preset)
    body = "".join(rf"\d{{{_PARTS[p][1]}}}" if p in _PARTS else re.escape(p) for p in parts)
    return rf"(?i)^{body}\.[^.]+$"


def matches_preset(name: Column, preset: str = PRESET) -> Column:
    return name.rlike(preset_pattern(preset))


def preset_stem(ts: Column, preset: str = PRESET) -> Column:
    """The stem a preset gives for a timestamp, 100 characters at most, blanks at its end cut."""
    pieces = [F.date_format(ts, _PARTS[p][0]) if p in _PARTS else F.lit(p) for p in re.split(r"(\{[A-Za-z]+\})", preset) if p]
    stem = F.concat(*pieces) if pieces else F.lit("")
    return F.when(F.length(stem) > 100, F.rtrim(F.substring(stem, 1, 100))).otherwise(stem)


def safe_name(title: Column, fallback: str = "untitled", most: int = 80) -> Column:
    """A file name from a title: no control characters or marks of paths and links, single blanks, no dots at the ends."""
    x = F.regexp_replace(title, r"[\x00-\x1f\\/:*?\"<>|#^\[\]]", " ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    x = F.regexp_replace(F.regexp_replace(x, r"^[. ]+", ""), r"[. ]+$", "")
    x = F.regexp_replace(F.substring(x, 1, most), r"[. ]+$", "")
    return F.coalesce(F.when(x != "", x), F.lit(fallback))


#: Extensions of the image types that a clipboard names.
MIME_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/heic": "heic", "image/heif": "heic", "image/avif": "avif"}


def pasted_name(name: Column, mime: Column) -> Column:
    """A file name for a pasted image: its own without marks of paths, if it is one; the extension is that of its type, else png.
    Names of more than 80 characters and data URLs count as none."""
    own = F.coalesce(name, F.lit(""))
    kept = F.when((F.length(own) > 80) | own.startswith("data:"), "").otherwise(F.trim(F.regexp_replace(own, r"[\\/:*?\"<>|]", "")))
    types = F.create_map(*[F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair])
    ext = F.coalesce(F.try_element_at(types, F.lower(F.coalesce(mime, F.lit("")))), F.lit("png"))
    return F.when(kept.rlike(r"^.+\.[^.]+$"), kept).otherwise(F.concat_ws(".", F.when(kept == "", "pasted-image").otherwise(kept), ext))


def attachment_folder(folder: Column, mode: str, root: str = "", custom: str = "") -> Column:
    """Where a note's images belong: the vault's setting, its root, the note's folder, a folder below it, or a fixed one.
    ``./sub`` is relative to the note."""
    below = lambda sub: F.when(folder == "", F.lit(sub)).otherwise(F.concat(folder, F.lit(f"/{sub}"))) if sub else folder

    def fixed(path: str) -> Column:
        return below(path[2:].strip("/")) if path.startswith("./") else F.lit(path.strip("/"))

    return {"system": lambda: fixed(root), "root": lambda: F.lit(""), "current": lambda: folder, "subfolder": lambda: below(custom.removeprefix("./").strip("/")), "custom": lambda: fixed(custom)}[mode]()


# --- conversion -------------------------------------------------------------------------------------------


def needs_conversion(ext: Column, target: str = "webp") -> Column:
    """Known extensions but gif that are not the target yet; pngquant takes png only."""
    e = F.lower(ext)
    if target.lower() == "pngquant":
        return e == "png"
    same = ["jpg", "jpeg"] if target.lower() in ("jpg", "jpeg") else [target.lower()]
    return e.isin(*IMPORT_EXTENSIONS) & (e != "gif") & ~e.isin(*same)


def conversions(files: DataFrame, target: str = "webp") -> DataFrame:
    """(path, new_path): files to convert whose new path no other file has."""
    ext = "png" if target.lower() == "pngquant" else target.lower()
    planned = files.where(needs_conversion(F.col("ext"), target)).select("path", F.regexp_replace("path", r"\.[^./]+$", f".{ext}").alias("new_path"))
    if target.lower() == "pngquant":
        return planned
    taken = files.select(F.lower("path").alias("_taken"))
    return planned.join(taken, F.lower("new_path") == F.col("_taken"), "left_anti")


def true_format(content: Column) -> Column:
    """The format that the leading bytes say: webp, png or jpeg; null: none of them."""
    head = F.hex(F.substring(content.cast("binary"), 1, 12))
    return F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg")


# --- new names --------------------------------------------------------------------------------------------


def allocate_names(requests: DataFrame, files: DataFrame, as_of: datetime.datetime, order: list[str], preset: str = PRESET) -> DataFrame:
    """Adds new_name to each request (ext, and the ``order`` columns): the preset at ``as_of``, a second later for each
    name that is taken.

    Requests are numbered and free seconds are numbered, and the two numbers are joined: no probing. Enough seconds
    are laid out, as many as requests and files named by the preset together.
    """
    seconds = requests.count() + files.where(matches_preset(F.col("name"), preset)).count() + 1
    start = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    most = files.sparkSession.range(0, seconds, 1, max(1, -(-seconds // 100_000))).select(F.col("id").alias("_second"))
    stems = most.withColumn("_stem", preset_stem(F.timestamp_seconds(F.unix_timestamp(start) + F.col("_second")), preset))
    taken = files.select(F.lower(F.regexp_replace("name", r"\.[^.]+$", "")).alias("_taken")).distinct()
    left = stems.join(taken, F.lower("_stem") == F.col("_taken"), "left_anti")
    # Blocks of a thousand seconds: counts of free ones before a block, and ranks inside it, keep the order of time.
    block = F.floor(F.col("_second") / 1000)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = left.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    free = left.join(starts, block == F.col("_b")).withColumn("_free", F.row_number().over(Window.partitionBy("_b").orderBy("_second")) - 1 + F.col("_start")).drop("_b", "_start")
    asked = numbered_rows(requests, order, "_asked")
    return asked.join(free, F.col("_asked") == F.col("_free")).withColumn("new_name", F.concat("_stem", F.lit("."), F.lower("ext"))).drop("_asked", "_free", "_second", "_stem")


def numbered_name(name: Column, n: Column) -> Column:
    """``photo.png`` as ``photo 2.png``; a number below 2 leaves it."""
    return F.when(n < 2, name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(" "), n.cast("string"), F.regexp_extract(name, r"(\.[^.]+)$", 1)))


def _suffix(name: Column) -> Column:
    """What ``numbered_name`` made a name of, from 2 on: its base and number; null: no such name."""
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext))
    digits = F.regexp_extract(stem, r" ([1-9][0-9]{0,17})$", 1)
    base = F.concat(F.substring(stem, F.lit(1), F.char_length(stem) - F.char_length(digits) - 1), ext)
    return F.when((digits != "") & (digits != "1"), F.struct(base.alias("base"), digits.cast("long").alias("number")))


def free_suffixes(requests: DataFrame, files: DataFrame, rows_a_range: int | None = None) -> DataFrame:
    """Adds free_name to requests (folder, name, src): the name itself if the folder has none such, else with the
    smallest free number from 2. Requests for one name share out the free numbers in the order of src. A numbered name that
    is itself asked for in the folder counts as taken, so no two requests get one name; names are alike in any case.

    The i-th taken number t leaves t - i free ones below it. Sorted among the requests' ranks, after those not above it, that
    makes a row's position in its group the number it gets: no numbers are laid out, and a name may be asked for any number
    of times. Rows without a name get none; no folder counts as a folder of its own.
    """
    key = ["_folder", "_base"]
    asked = written(requests.withColumns({"_folder": F.col("folder"), "_base": F.lower("name")}), "asked")
    mine = ranked(asked, key, ["src"], "_value", rows_a_range).withColumns({"_taken": F.lit(0), "_number": F.lit(0).cast("long")})
    have = files.select("folder", F.lower("name").alias("name"))
    own = have.select(F.col("folder").alias("_folder"), F.col("name").alias("_base"), F.lit(1).cast("long").alias("_number"))
    some = have.union(asked.select("_folder", "_base")).select("folder", _suffix(F.col("name")).alias("s")).where("s is not null")
    taken = written(own.union(some.select("folder", "s.base", "s.number")).distinct().join(asked.select(*key).distinct(), key, "left_semi"), "taken")
    gaps = ranked(taken, key, ["_number"], "_i", rows_a_range).select(*key, "_number", (F.col("_number") - F.col("_i")).alias("_value"), F.lit(1).alias("_taken"))
    met = ranked(mine.unionByName(gaps, allowMissingColumns=True), key, ["_value", "_taken", "_number"], "_k", rows_a_range).where("_taken = 0")
    return met.withColumn("free_name", numbered_name(F.col("name"), F.col("_k"))).drop(*key, "_value", "_taken", "_number", "_k")
