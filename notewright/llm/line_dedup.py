"""Line dedup with built-in functions only: lines that many documents share leave all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import free_names, written

_BLANKS = " \t\n\x0b\x0c\r"


def _folded(line: Column) -> Column:
    """Equal for two lines that differ only in the case of A-Z, and different for all others.

    The UTF-8 bytes are read as Latin-1 and lower-cased. Besides A-Z this only moves lead bytes C0-DE to E0-FE,
    where the number of bytes that follow still tells them from lead bytes that were there before.
    """
    return F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))


def line_keys(text: Column) -> Column:
    """A 64-bit hash of each line's key (blanks stripped, A-Z lower-cased), in order; null where the key is empty."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(_BLANKS))
        return F.when(k != "", F.xxhash64(_folded(k)))

    return F.transform(F.split(text, "\n"), key)


def drop_common_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` with three columns more: n_lines, n_dropped and kept_text, the lines left, joined by a newline.

    A line goes when its key has at least ``min_chars`` code points and ``min_documents`` rows hold it. Documents
    that lose nothing keep their text byte for byte. Null texts count as one empty line. Each row is a
    document, repeated rows and null ids included. Columns of ``docs`` that have the names of the three are replaced; all
    others pass through.

    Only hashes are exploded and counted (partial counts first, so a line in every document is no hot group);
    the few keys over the threshold meet the lines again in a join that AQE splits where a key is hot. Each text's
    dropped keys then meet the text by its hash; a hash shared by two texts does no harm, as only common keys
    are in the set. They are written first, and always meet by a sort-merge join: Spark splits a text with very many
    copies there, which it does not do in a join that groups in the same stage.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = line_keys(text)
    if min_chars > 1:
        long_enough = F.transform(F.split(text, "\n"), lambda x: F.char_length(F.btrim(x, F.lit(_BLANKS))) >= min_chars)
        keys = F.zip_with(keys, long_enough, lambda k, ok: F.when(ok, k))
    text_key = F.xxhash64(text)
    by, gone, left = free_names(docs, "_text_key", "_dropped", "_kept")
    lines = docs.select(text_key.alias(by), F.explode(F.array_distinct(keys)).alias("_key")).where("_key is not null")
    common = written(lines.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents).select("_key"), "common-lines")
    dropped = written(lines.join(common, "_key", "left_semi").groupBy(by).agg(F.collect_set("_key").alias(gone)), "dropped-lines")
    met = docs.withColumn(by, text_key).join(dropped.hint("merge"), by, "left")
    split = F.split(text, "\n")
    kept = F.transform(F.filter(F.arrays_zip(split.alias("line"), keys.alias("key")), lambda x: F.col(gone).isNull() | x["key"].isNull() | ~F.array_contains(gone, x["key"])), lambda x: x["line"])
    n_lines = F.size(split).cast("long")
    out = met.withColumn(left, F.when(F.col(gone).isNotNull(), kept))
    return out.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col(left).isNull(), F.lit(0)).otherwise(n_lines - F.size(left)).cast("long"), "kept_text": F.when(F.col(left).isNull(), text).otherwise(F.array_join(left, "\n"))}).drop(by, gone, left)
