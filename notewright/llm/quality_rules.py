"""Quality rules: counts of words, symbols and repeats, and compression bands.

zstandard ratios (bytes before / after) of the whole text and of fixed chunks must lie in bands that depend
on length: repetitive text compresses too well, keys and binary dumps hardly at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from notewright.llm.shared import mix, pieces, small_batches, span_hashes, utf8, words_of

#: (bytes up to which the band holds, lowest ratio, highest ratio); short texts hardly compress in any case.
WHOLE_BANDS = ((200, 0.0, 4.0), (500, 0.9, 3.6), (1000, 1.1, 4.0), (2000, 1.25, 4.5), (4000, 1.35, 5.0), (10000, 1.4, 5.5), (100000, 1.4, 6.5), (float("inf"), 1.4, 8.0))
CHUNK_BYTES = 4096
#: The same for a chunk; the last chunk of a text may be short. The floors lie between base64, wrapped or not (at most 1.26
#: up to 1000 bytes, 1.30 up to 2000, 1.32 beyond; base32 1.58 in a full chunk), and texts labelled good at sf0.1
#: (at least 1.40, 1.69, 1.91 and 2.07 in a full chunk).
CHUNK_BANDS = ((500, 0.0, 8.0), (1000, 1.3, 6.0), (2000, 1.4, 6.0), (float("inf"), 1.6, 7.0))
#: A text is rejected when this share of its chunks is outside their band.
CHUNK_SHARE = 0.25
BLOCK_BYTES = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _band(bands: tuple[tuple[float, float, float], ...], size: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if size <= most)


def compression_verdict(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """Whether a text is inside its bands, its ratio, and the share of its chunks outside theirs."""
    if not text:
        return True, 1.0, 0.0
    ratio = len(text) / len(compressor.compress(text))
    low, high = _band(WHOLE_BANDS, len(text))
    outside = n = 0
    for at in range(0, len(text), CHUNK_BYTES) if len(text) > CHUNK_BYTES else ():
        chunk = text[at : at + CHUNK_BYTES]
        a, b = _band(CHUNK_BANDS, len(chunk))
        outside += not a <= len(chunk) / len(compressor.compress(chunk)) <= b
        n += 1
    share = outside / n if n else 0.0
    return low <= ratio <= high and share < CHUNK_SHARE, ratio, share


def _repeated(keys: np.ndarray, later_only: bool) -> np.ndarray:
    """True where a key was met before (or, without ``later_only``, is met elsewhere)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    if not later_only:
        out[order[:-1]] |= same
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    owner = words.owner()
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    # Lines: each text ends one, as does each \n.
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], newline + 1)), kind="stable")
    ends = np.sort(np.concatenate((newline, offsets[1:])), kind="stable")
    filled = np.concatenate(([0], np.cumsum(~blank)))
    kept = filled[ends] > filled[starts]
    starts, ends = starts[kept], ends[kept]
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    line_keys = mix(span_hashes(data, starts, ends) ^ mix(line_owner.astype(np.uint64)))
    dup = np.bincount(line_owner[_repeated(line_keys, True)], minlength=n)
    # Windows of three words inside one text.
    covered = np.zeros(len(owner), bool)
    if len(owner) >= 3:
        h, at = words.hashes, np.flatnonzero(owner[2:] == owner[:-2])
        keys = mix(h[at] * np.uint64(0x9FB21C651E98DF25) + h[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + 2] * np.uint64(0x165667B19E3779F9) + mix(owner[at].astype(np.uint64)))
        again = at[_repeated(keys, False)]
        for k in range(3):
            covered[again + k] = True
    return {"n_words": np.diff(words.first), "word_chars": per(((data & 0xC0) != 0x80) & ~blank), "n_symbols": per(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": np.bincount(owner[covered], minlength=n)}


def rate_quality(docs: DataFrame, min_words: int = 50, most_repeat_percent: int = 50, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts for every whole text, one row a document, in one pass without a shuffle.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    zstd_ratio, chunks_outside. With ``keep`` the kept rows of ``docs`` come back instead, all columns as they
    were. Null and empty texts have no words, so they fail the base rule. Null ids and repeated rows are rated
    each by itself; no column besides the two is read.
    """
    small_batches(docs.sparkSession)

    def rated(column: pa.Array) -> dict[str, np.ndarray]:
        data, offsets = utf8(column)
        out = text_counts(data, offsets)
        out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > most_repeat_percent * out["n_words"])
        compressor = zstandard.ZstdCompressor(level=3)
        verdicts = [compression_verdict(data[s:e].tobytes(), compressor) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out["kept"] = ~out["base_failed"] & np.array([v[0] for v in verdicts], bool)
        out["zstd_ratio"], out["chunks_outside"] = np.array([v[1] for v in verdicts]), np.array([v[2] for v in verdicts])
        return out

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BLOCK_BYTES):
            yield batch.filter(pa.array(rated(batch.column(text_col))["kept"]))

    if keep:
        return docs.mapInArrow(kept_rows, docs.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BLOCK_BYTES):
            out = rated(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in out.values())], [id_col, *out])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunks_outside double")
