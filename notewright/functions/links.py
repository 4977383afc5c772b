"""Columns over links and images in a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.lines import INLINE_CODE, fence_ranges, inside, let, lines_of, map_lines, no_ranges, table_ranges
from notewright.sources.notes import IMAGE_EXTENSIONS, IMPORT_EXTENSIONS

_ANY = "|".join(IMAGE_EXTENSIONS)
IMAGE = rf"(?i)\.(?:{_ANY})$"
#: Inside double brackets: a target up to a bar or the closing brackets, then perhaps an alias.
_TARGET, _ALIAS = r"((?:(?!\]\])[^|])+)", r"(?:\|(?:(?!\]\]).)+)?"
WIKI = rf"!\[\[{_TARGET}{_ALIAS}\]\]"
_ALT = r"!\[[^\]]*\]"
MARKDOWN = rf"{_ALT}\(([^)]*)\)"
#: A file entry of a canvas; its value may hold escaped quotes.
CANVAS_FILE = r'"file"\s*:\s*"((?:[^"\\]|\\.)+)"'
EXTERNAL = rf"(?i)!\[(.*?)\]\((<?(?:file:/+|[a-zA-Z]:[\\/]).*?\.(?:{'|'.join(IMPORT_EXTENSIONS)})>?)\)"
REMOTE = r"(?i)!\[[^\]]*\]\((<?https?://[^)\s]+>?)\)"


def without_fragment(target: Column) -> Column:
    return F.trim(F.element_at(F.split(target, "#"), 1))


def basename(target: Column) -> Column:
    return F.trim(F.element_at(F.split(without_fragment(target), "/"), -1))


def _bare(target: Column) -> Column:
    """A Markdown target without <...> or a title."""
    t = F.trim(target)
    return F.when(t.startswith("<") & t.contains(">"), F.regexp_extract(t, "^<([^>]*)>", 1)).otherwise(F.regexp_replace(t, r"""\s+(?:"[^"]*"|'[^']*')\s*$""", ""))


def _unescaped(target: Column) -> Column:
    """A target in a table row ends in the backslash of an escaped bar."""
    return F.regexp_replace(target, r"\\+$", "")


def _embeds(line: Column) -> Column:
    """The image embeds of a line, outside its code: kind and target, wiki embeds first."""
    plain = F.regexp_replace(line, INLINE_CODE, "`")
    wiki = F.transform(F.regexp_extract_all(plain, F.lit(WIKI), F.lit(1)), lambda t: F.struct(F.lit("wiki").alias("kind"), _unescaped(F.trim(t)).alias("target")))
    md = F.transform(F.regexp_extract_all(plain, F.lit(MARKDOWN), F.lit(1)), lambda t: F.struct(F.lit("markdown").alias("kind"), _unescaped(_bare(t)).alias("target")))
    return F.filter(F.concat(wiki, md), lambda x: F.element_at(F.split(x["target"], "#"), 1).rlike(IMAGE))


def image_refs(notes: DataFrame) -> DataFrame:
    """Image embeds outside code: note_id, folder, line, ord (from 0 in the line), kind, target. Notes without '!' are not split."""
    lines = lines_of(F.col("text"))
    some = notes.where(F.contains(F.col("text"), F.lit("!"))).withColumn("_code", fence_ranges(lines))
    rows = some.select("note_id", "folder", "_code", F.posexplode(lines).alias("line", "_line")).where(F.col("_line").contains("!") & ~inside(F.col("_code"), F.col("line")))
    return rows.select("note_id", "folder", "line", F.posexplode(_embeds(F.col("_line"))).alias("ord", "ref")).select("note_id", "folder", "line", "ord", "ref.kind", "ref.target")


#: Every kind of link that names a file: wiki links and embeds, Markdown images, file entries of canvases.
#: The look ahead passes by most characters at once.
FILE_LINK = r'(?=[!\["])(?:!?\[\[[^\[\]\n]+\]\]|!\[[^\]\n]*\]\([^)\n]*\)|"file"\s*:\s*"[^"\n]+")'


def _decoded(target: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)


def link_target(link: Column) -> Column:
    """What a link of any kind names: without alias, title, brackets and escapes; Markdown targets URL-decoded."""
    wiki = _unescaped(F.trim(F.regexp_extract(link, r"^!?\[\[([^|\]]+)", 1)))
    return F.when(link.startswith('"'), F.regexp_extract(link, r':\s*"([^"]+)"$', 1)).when(link.rlike(r"^!?\[\["), wiki).otherwise(_decoded(_bare(F.regexp_extract(link, r"\]\(([^)]*)\)$", 1))))


def with_target(link: Column, new: Column) -> Column:
    """The link with another file in it; fragment, alias, an escaped bar, alt text, brackets and title stay."""
    whole = F.regexp_extract(link, r"^!?\[\[([^|\]]+)", 1)
    wiki = F.concat(F.regexp_extract(link, r"^(!?\[\[)", 1), new, F.regexp_extract(whole, r"^[^#]*(#[^\\]*)?", 1), F.regexp_extract(link, r"^!?\[\[[^|\]]+?(\\?(?:\|[^\]]*)?\]\])$", 1))
    inside = F.regexp_extract(link, r"\]\(([^)]*)\)$", 1)
    angled = F.trim(inside).startswith("<")
    path = F.when(angled, F.concat(F.lit("<"), new, F.lit(">"))).otherwise(F.replace(F.replace(F.replace(F.replace(new, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")))
    title = F.regexp_extract(inside, r"""(\s+["'][^"']*["']\s*)$""", 1)
    markdown = F.concat(F.regexp_extract(link, r"^(!\[[^\]\n]*\]\()", 1), path, F.regexp_extract(_bare(inside), r"(#.*)?$", 1), title, F.lit(")"))
    canvas = F.concat(F.regexp_extract(link, r'^("file"\s*:\s*")', 1), new, F.lit('"'))
    return F.when(link.startswith('"'), canvas).when(link.rlike(r"^!?\[\["), wiki).otherwise(markdown)


def _linked(text: Column) -> Column:
    targets = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({FILE_LINK})"), F.lit(1)), link_target))
    return F.filter(targets, lambda t: without_fragment(t).rlike(IMAGE))


def file_links(docs: DataFrame) -> DataFrame:
    """(note_id, target): what images a document's links of any kind name, in code too; each once."""
    return docs.where(F.col("text").isNotNull()).select("note_id", F.explode(_linked(F.col("text"))).alias("target"))


def _named(text: Column) -> Column:
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[((?:(?!\]\])[^|#])+)"), F.lit(1))
    md = F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN), F.lit(1)), lambda t: F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(F.trim(t), "^<|>$", ""), "\\+", "%2B")), F.regexp_replace(F.trim(t), "^<|>$", "")))
    canvas = F.regexp_extract_all(text, F.lit(CANVAS_FILE), F.lit(1))
    targets = F.transform(F.concat(wiki, md, canvas), lambda t: without_fragment(_unescaped(t)))
    return F.filter(F.transform(F.filter(targets, lambda t: t.rlike(IMAGE)), lambda t: F.lower(F.element_at(F.split(t, "/"), -1))), lambda n: n != "")


def referenced_names(docs: DataFrame) -> DataFrame:
    """(note_id, name): lower-cased image names a document refers to, once for each reference.

    Wiki links and embeds, Markdown images (URL-decoded) and the file entries of canvases count, in code too.
    """
    return docs.where(F.col("text").isNotNull()).select("note_id", F.explode(_named(F.col("text"))).alias("name"))


def all_links(docs: DataFrame) -> DataFrame:
    """(note_id, folder, role, target) of all that a document says about images, from one reading of its text.

    Roles: ``wiki`` and ``markdown`` (the embeds of ``image_refs``), ``link`` (the targets of ``file_links``) and ``name``
    (those of ``referenced_names``), each as often as there. An unreadable document gives no row.
    """
    as_role = lambda role, targets: F.transform(targets, lambda t: F.struct(F.lit(role).alias("role"), t.alias("target")))
    in_line = lambda x: F.transform(_embeds(x), lambda e: F.struct(e["kind"].alias("role"), e["target"].alias("target")))
    open_lines = lambda v: F.filter(v["lines"], lambda x, i: x.contains("!") & ~inside(v["code"], i))
    lines, none = lines_of(F.col("text")), F.array().cast("array<struct<role:string,target:string>>")
    code = F.when(F.col("text").rlike("```|~~~"), fence_ranges(lines)).otherwise(no_ranges(lines))
    embeds = F.flatten(F.transform(let(open_lines, lines=lines, code=code), in_line))
    found = F.concat(F.when(F.col("text").contains("!["), embeds).otherwise(none), as_role("link", _linked(F.col("text"))), as_role("name", _named(F.col("text"))))
    # What has neither double brackets, nor an image's nor a canvas's mark, holds no link.
    some = docs.where(F.col("text").rlike(r'\[\[|!\[|"file"'))
    return some.select("note_id", "folder", F.explode(found).alias("x")).select("note_id", "folder", "x.role", "x.target")


def external_images(notes: DataFrame) -> DataFrame:
    """Images linked by an absolute path of a machine: note_id, ord, alt, target, name."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(EXTERNAL), F.lit(1)).alias("alt"), F.regexp_extract_all("text", F.lit(EXTERNAL), F.lit(2)).alias("target"))
    rows = notes.where(F.col("text").isNotNull()).select("note_id", F.posexplode(pairs).alias("ord", "x"))
    target = F.regexp_replace("x.target", "^<|>$", "")
    return rows.select("note_id", "ord", "x.alt", target.alias("target"), F.element_at(F.split(target, r"[\\/]"), -1).alias("name"))


def remote_images(notes: DataFrame) -> DataFrame:
    """Still images on the web, once for each note and URL: note_id, url."""
    urls = F.transform(F.regexp_extract_all("text", F.lit(REMOTE), F.lit(1)), lambda u: F.regexp_replace(u, "^<|>$", ""))
    still = F.filter(urls, lambda u: u.rlike(r"(?i)\.(?:png|jpe?g|webp|bmp|heic)(?:[?#].*)?$"))
    return notes.where(F.col("text").isNotNull()).select("note_id", F.explode(F.array_distinct(still)).alias("url"))


def image_counts(notes: DataFrame) -> DataFrame:
    """(note_id, n_images) of notes with images."""
    return image_refs(notes).groupBy("note_id").agg(F.count(F.lit(1)).alias("n_images"))


def size_argument(width: str, height: str = "") -> str:
    """The size to write after an image; empty: remove sizes. Digits only, above 0; a height needs a width."""
    if any(x and (not x.isdigit() or int(x) == 0) for x in (width, height)) or (height and not width):
        raise ValueError("width and height are positive whole numbers, and a height needs a width")
    return f"{width}x{height}" if height else width


_SIZED_LINK = r"!\[\[[^\]\n|]+(?:\|[^\]\n]*)?\]\]|!\[[^\]\n]*\]\([^)\n]*\)"
_SIZE = r"^\s*\d+(?:x\d+)?\s*$"


def sized_links(text: Column, size: str, overwrite: bool = True) -> Column:
    """The text with ``size`` on every image; captions stay, and a bar in a table row stays escaped. '' removes sizes.

    Each line is cut at its image links; pieces that are image links are written anew.
    """
    link = _SIZED_LINK

    def piece(x: Column, in_table: Column) -> Column:
        target = F.regexp_extract(x, r"^!\[\[([^\]|]+)", 1)
        clean = _unescaped(target)
        alias = F.when(F.regexp_like(x, F.lit(r"^!\[\[[^\]|]+\|")), F.regexp_extract(x, r"^!\[\[[^\]|]+\|([^\]]*)\]\]$", 1))
        bar = F.when(in_table | target.endswith("\\"), F.lit("\\|")).otherwise(F.lit("|"))
        new = F.concat(F.lit("![["), clean, F.lit("]]")) if size == "" else F.concat(F.lit("![["), clean, bar, F.lit(size), F.lit("]]"))
        sized = alias.rlike(_SIZE)
        wiki_image = clean.rlike(IMAGE) | F.element_at(F.split(clean, "#"), 1).rlike(IMAGE)
        none = alias.isNull() | (alias == "")
        wiki = F.when(none & F.lit(size != ""), new).when(sized & F.lit(overwrite), new).otherwise(x)
        alt, url = F.regexp_extract(x, r"^!\[([^\]]*)\]", 1), F.regexp_extract(x, r"\]\(([^)]*)\)$", 1)
        md_image = F.element_at(F.split(_bare(url), r"[?#]"), 1).rlike(IMAGE)
        md_new = F.concat(F.lit(f"![{size}]("), url, F.lit(")"))
        md = F.when((alt == "") & F.lit(size != ""), md_new).when(alt.rlike(_SIZE) & F.lit(overwrite), md_new).otherwise(x)
        return F.when(x.startswith("![[") & wiki_image, wiki).when(x.rlike(r"^!\[[^\[]?.*\]\(.*\)$") & md_image, md).otherwise(x)

    def line(x: Column, in_table: Column) -> Column:
        gaps = F.split(x, link)
        links = F.regexp_extract_all(x, F.lit(f"({link})"), F.lit(1))
        whole = F.zip_with(gaps, F.concat(F.transform(links, lambda y: piece(y, in_table)), F.array(F.lit(""))), lambda g, y: F.concat(g, F.coalesce(y, F.lit(""))))
        return F.when(x.contains("!["), F.array_join(whole, "")).otherwise(x)

    return map_lines(text, lambda x, i, v: line(x, inside(v["tables"], i)), no_ranges, tables=table_ranges)


def size_changes(notes: DataFrame, size: str, overwrite: bool = True) -> DataFrame:
    """(note_id, text, new_text) of notes that a size run would change."""
    return notes.withColumn("new_text", sized_links(F.col("text"), size, overwrite)).where("new_text <> text").select("note_id", "text", "new_text")


def size_preview(notes: DataFrame, size: str, overwrite: bool = True, samples: int = 5) -> DataFrame:
    """(note_id, changed, skipped, samples) of notes with images that a size run would write anew or pass over.

    Skipped are images with a caption, and with a size that is not to be overwritten; samples are the first before and
    after. A link that has the size already is neither. Notes without such an image give no row.
    """
    found = lambda t: F.regexp_extract_all(t, F.lit(f"({_SIZED_LINK})"), F.lit(1))
    pairs = F.arrays_zip(found(F.col("text")).alias("before"), found(sized_links(F.col("text"), size, overwrite)).alias("after"))
    both = notes.where(F.col("text").contains("![")).select("note_id", pairs.alias("_p"))
    name = lambda x: F.when(x.startswith("![["), F.coalesce(F.nullif(F.regexp_extract(x, r"^!\[\[[^\]|]+\|([^\]]*)\]\]$", 1), F.lit("")), F.lit(""))).otherwise(F.regexp_extract(x, r"^!\[([^\]]*)\]", 1))
    image = lambda x: F.element_at(F.split(link_target(x), "[?#]"), 1).rlike(IMAGE)
    changed = F.filter("_p", lambda p: p["before"] != p["after"])
    passed = F.filter("_p", lambda p: (p["before"] == p["after"]) & image(p["before"]) & (name(p["before"]) != "") & (~name(p["before"]).rlike(_SIZE) | F.lit(not overwrite)))
    out = both.select("note_id", F.size(changed).cast("long").alias("changed"), F.size(passed).cast("long").alias("skipped"), F.slice(changed, 1, samples).alias("samples"))
    return out.where("changed + skipped > 0")
