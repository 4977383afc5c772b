"""Fill-in-the-middle by rotating blocks in place.

A text is cut into prefix, middle and suffix at the ends of tokens. Sentinels are inserted before the three parts in a
bytearray, and the parts are exchanged by one rotation, which is three reversals. To restore, the sentinels are
scanned, the rotation is inverted and the sentinels are taken out; nothing but the output and its form is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewright.llm.shared import free_names, pieces, small_batches

#: Text of one batch, and bytes that one swap of a reversal copies.
BATCH_BYTES, SWAP_BYTES = 1 << 20, 1 << 16
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Sentinels(NamedTuple):
    """What stands before the parts of a text."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"


def token_ends(text: bytes) -> np.ndarray:
    """Where tokens end, in bytes of UTF-8: a token is a word with the blanks before it, or the blanks at the end."""
    word = ~_BLANK[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.append(ends, len(text)) if len(text) else ends


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverses buffer[start:end] in place, by swaps of bounded size."""
    while end - start > 1:
        n = min((end - start) // 2, SWAP_BYTES)
        head = buffer[start : start + n].copy()
        buffer[start : start + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = head[::-1]
        start, end = start + n, end - n


def rotate(data: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges data[start:cut] and data[cut:end] in place, whatever their lengths."""
    buffer = np.frombuffer(data, np.uint8)
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def arrange(text: bytes, first: int, second: int, form: str, marks: Sentinels = Sentinels()) -> bytearray:
    """The text cut at two places, in the order of ``form``: psm or spm."""
    data = bytearray(text)
    for at, mark in ((second, marks.suffix), (first, marks.middle), (0, marks.prefix)):
        data[at:at] = mark
    middle = len(marks.prefix) + first
    suffix = second + len(marks.prefix) + len(marks.middle)
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return data


def restore(output: bytes, form: str, marks: Sentinels = Sentinels()) -> bytearray:
    """The text that ``arrange`` was given; of form plain, the output itself. The sentinels must not occur in the text."""
    data = bytearray(output)
    if form == "plain":
        return data
    # The rotation moved the suffix forward: it now ends where the parts that stood before it begin.
    begin, end = (data.index(marks.suffix), data.index(marks.middle)) if form == "psm" else (0, data.index(marks.prefix))
    rotate(data, begin, end, len(data))
    middle = data.index(marks.middle)
    suffix = data.index(marks.suffix, middle)
    for at, mark in ((suffix, marks.suffix), (middle, marks.middle), (0, marks.prefix)):
        del data[at : at + len(mark)]
    return data


def draws(seed: int, key: str) -> list[int]:
    """Four 32-bit numbers: the first groups of eight digits of the SHA-256 of ``seed:key``."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digits[i : i + 4]) for i in range(0, 16, 4)]


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def cut(text: bytes, key: str, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Sentinels = Sentinels()) -> Cut:
    """One text transformed, or left plain."""
    ends = token_ends(text)
    h = draws(seed, key)
    if not text or any(m in text for m in marks) or h[2] % 100 >= percent:
        return Cut(len(ends), "plain", None, None, text)
    first, second = sorted(x % (len(ends) + 1) for x in h[:2])
    first, second = (int(ends[x - 1]) if x else 0 for x in (first, second))
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return Cut(len(ends), form, len(text[:first].decode()), len(text[first:second].decode()), bytes(arrange(text, first, second, form, marks)))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Sentinels = Sentinels(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null: plain) and output of every whole text.

    The draws follow from ``seed`` and the id, so reruns agree on any cluster; rows with one id are cut by one draw. About
    ``percent`` of the texts are transformed, of these ``spm_percent`` in the form spm. Empty and null texts, and
    texts that hold a sentinel, stay plain; a null text gives an empty output; a null id draws as the empty text. Very
    long texts are rotated in place, two copies at most; repeated rows each give a row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BATCH_BYTES):
            keys = ("" if i is None else str(i) for i in batch.column(0).to_pylist())
            rows = [cut((t.as_py() or "").encode(), k, seed, percent, spm_percent, marks) for k, t in zip(keys, batch.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(transformed: DataFrame, marks: Sentinels = Sentinels(), out: str = "restored") -> DataFrame:
    """Rows of ``fill_in_middle`` with the original text, rebuilt from output and form alone. All columns are kept; where one
    has the name of ``out``, underscores are added to the new one. A null output or form gives null."""
    small_batches(transformed.sparkSession)
    (name,) = free_names(transformed, out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "output", BATCH_BYTES):
            pairs = zip(batch.column("output"), batch.column("form").to_pylist(), strict=True)
            texts = [None if o.as_py() is None or f is None else bytes(restore(o.as_py().encode(), f, marks)) for o, f in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema.fields)
    return transformed.mapInArrow(work, f"{fields}, `{name}` string")
