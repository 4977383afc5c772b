"""Secret scans by a recursive decoding worklist.

A text is scanned as it stands; then its URL-encoded lines, lines with Unicode escapes, base64 runs (also
those wrapped over lines) and compressed base64 runs are unwrapped into layers, each scanned and unwrapped in
turn until nothing new appears. A base64 run is read from each of its first four characters, as what stands before
it may belong to the same alphabet, and compressed data are looked for inside it. Bytes that are no text are read
past, and ASCII in UTF-16 is read. A layer knows where its characters lie in the layer above, so a secret found any
number of layers down is reported by its span in the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewright.llm.shared import pieces, small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: One of these stands in the name of every assignment.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What may stand between the lines of wrapped base64: a line break, blanks before and after it, marks of a quotation; or
#: the break as JSON and code write it, a backslash and a letter. All repeats are possessive, so a run is read once.
BREAK = re.compile(r"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+(?:>[ \t]*+)*+")
#: Base64 over such breaks, as MIME, PEM and the base64 tool wrap it.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++(?:(?:{BREAK.pattern})?+={{1,2}}+)*+")
ODD = re.compile("[\udc80-\udcff]")
CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")
WIDE = re.compile(rb"(?:[\t\n\r -~]\x00){8,}[\t\n\r -~]?|(?:\x00[\t\n\r -~]){8,}")
RUN_BYTES = re.compile(rb"[A-Za-z0-9+/_-]{16,}+(?:" + BREAK.pattern.encode() + rb"[A-Za-z0-9+/_-]++)*+")
#: How the base64 of gzip, bzip2, xz and lzma data begins, wherever it stands; that of zlib data is looked for after a mark.
PACKED = re.compile(r"H4sI|Qlpo|/Td6WFo|_Td6WFo|XQAA|(?<=[/_+-])[eaCGK][0-9A-Za-z+/_-]{3}")
#: A layer that unpacks to more is read in pieces, each with the start of the next.
LAYER_BYTES, PIECE_BYTES, OVERLAP_BYTES, STEP_BYTES = 64 << 20, 8 << 20, 1 << 20, 1 << 20
#: Text of one batch.
BATCH_BYTES = 1 << 20


class Layer(NamedTuple):
    """A text, the layer it is wrapped in (None: it is the original), and the span there of its characters start:end."""

    text: str
    above: Layer | None = None
    up: Callable[[int, int], tuple[int, int]] | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span in the original."""
        layer = self
        while layer.above is not None:
            start, end = layer.up(start, end)
            layer = layer.above
        return start, end


def found(text: str) -> Iterator[tuple[str, int, int]]:
    """Secrets of one layer: leftmost, non-overlapping for each kind; matches that are too short are dropped."""
    low = text.lower()
    if any(name in low for name in NAMES):  # else no match begins, and the search for one is slow
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(text):
        if len(m[0]) >= 16:
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _codes(text: str) -> np.ndarray:
    """The code points of a text, lone surrogates included."""
    return np.array([text]).view(np.uint32) if text else np.empty(0, np.uint32)


def _mended(text: str) -> str:
    """The text with U+FFFD for each byte that was no UTF-8."""
    if not ODD.search(text):
        return text
    c = _codes(text)
    return np.where((c >= 0xDC80) & (c <= 0xDCFF), 0xFFFD, c).astype("<u4").tobytes().decode("utf-32-le")


def _widths(text: str) -> np.ndarray:
    """How many bytes of UTF-8 each character took; a lone surrogate stands for one byte that was no UTF-8."""
    c = _codes(text)
    return np.where((c < 0x80) | ((c >= 0xDC80) & (c <= 0xDCFF)), 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4))).astype(np.int32)


def _between(cuts: np.ndarray, at: int) -> Callable[[int, int], tuple[int, int]]:
    """Spans of characters that follow one another: character i comes from cuts[i]:cuts[i + 1], from ``at`` on."""
    return lambda start, end: (at + int(cuts[start]), at + int(cuts[end]))


_HEX = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"0123456789abcdef"):
    _HEX[[_c, ord(chr(_c).upper())]] = _i


def _percent(line: str) -> tuple[str, np.ndarray]:
    """The line with %XX decoded as UTF-8, and the place in it where each character begins, and its end. Bytes that are no UTF-8
    become U+FFFD."""
    raw = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
    value = _HEX[raw]
    at = np.flatnonzero((raw[:-2] == 0x25) & (value[1:-1] < 16) & (value[2:] < 16))
    out, kept = raw.copy(), np.ones(len(raw), bool)
    out[at] = value[at + 1] * 16 + value[at + 2]
    kept[at + 1] = kept[at + 2] = False
    text = out[kept].tobytes().decode("utf-8", "surrogateescape")
    begins = np.cumsum(_widths(text), dtype=np.int32)
    return _mended(text), np.concatenate(([0], np.append(place[kept], len(line))[begins]))


def _escapes(line: str) -> tuple[str, np.ndarray]:
    """The line with its escapes decoded, and the place where each character begins, and the line's end."""

    def decoded(m: re.Match[str]) -> str:
        code = int(next(g for g in m.groups() if g is not None), 16)
        return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "\ufffd"

    spans = np.array([m.span() for m in ESCAPE.finditer(line)], np.int64).reshape(-1, 2)
    inner = np.zeros(len(line) + 1, np.int32)
    inner[spans[:, 0] + 1] += 1
    inner[spans[:, 1]] -= 1
    return ESCAPE.sub(decoded, line), np.append(np.flatnonzero(np.cumsum(inner)[:-1] == 0), len(line))


def _decompressor(data: bytes):  # noqa: ANN202
    """A decompressor for gzip, zlib, bzip2, xz or lzma data; None where the bytes are none of these."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"\x5d\0\0" and len(data) > 12 and (data[5:13] == b"\xff" * 8 or data[11:13] == b"\0\0"):
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE, memlimit=1 << 30)
    if len(data) > 2 and data[0] & 15 == 8 and int.from_bytes(data[:2]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=1 << 30)
    return None


def _unpacking(source: Iterator[bytes]) -> Iterator[bytes]:
    """What compressed bytes unpack to, member after member, in small pieces.

    Bytes after the last member follow a line break as they are. Data that break off or are damaged give what comes before.
    """
    held, members = b"", 0
    while True:
        while len(held) < 13 and (more := next(source, None)) is not None:
            held = (held + more).lstrip(b"\0") if members else held + more
        opened = _decompressor(held)
        if opened is None:
            if members and held:
                yield b"\n" + held
                yield from source
            return
        members += 1
        while not opened.eof:
            try:
                out = opened.decompress(held, STEP_BYTES)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            if out:
                yield out
            held = getattr(opened, "unconsumed_tail", b"")
            if not opened.eof and not held and len(out) < STEP_BYTES and getattr(opened, "needs_input", True):
                if (more := next(source, None)) is None:
                    return
                held = more
        held = opened.unused_data.lstrip(b"\0")


def _marked(text: str) -> bool:
    """Whether a text holds a secret or something to unwrap."""
    return any(sought.search(text) for sought in (PERCENT, ESCAPE, BASE64)) or next(found(text), None) is not None


def _every_other_is_zero(data: bytes) -> bool:
    """Whether eight bytes, each two after the last, are zero anywhere, as in every match of WIDE."""
    if data.count(0) < 8:
        return False
    zero = np.frombuffer(data, np.uint8) == 0
    for step in (2, 4, 8):
        zero = zero[:-step] & zero[step:]
    return bool(zero.any())


def _readings(data: bytes, plain_counts: bool = True) -> Iterator[tuple[str, int, bool]]:
    """Texts in bytes, the byte at which each begins, and whether a character takes two bytes (ASCII in UTF-16).

    Bytes that are no UTF-8 come as lone surrogates. Bytes that are not plain text count only if what is read is marked.
    """
    text = data.decode("utf-8", "surrogateescape")
    plain = plain_counts and not CONTROL.search(text) and not ODD.search(text)
    if text and (plain or _marked(text)):
        yield text, 0, False
    if not plain and _every_other_is_zero(data):
        for m in WIDE.finditer(data):
            if _marked(text := m[0].replace(b"\0", b"").decode()):
                yield text, m.start(), True


def _data(run: str) -> bytes | None:
    """The bytes in a base64 run without breaks."""
    body = run.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _steps(data: memoryview) -> Iterator[bytes]:
    """Bytes in steps, short ones first: what only looks like compressed data is not read further than the decompressor does."""
    at, size = 0, 64
    while at < len(data):
        yield bytes(data[at : at + size])
        at, size = at + size, min(2 * size, STEP_BYTES)


def _opened(stream: Iterator[bytes]) -> Iterator[str]:
    """The texts in compressed bytes, however often they are compressed."""
    work, met = [stream], set()
    while work:
        inner, out = _unpacking(work.pop()), bytearray()
        for piece in inner:
            out += piece
            if len(out) > LAYER_BYTES:
                yield from _pieces(itertools.chain((bytes(out),), inner))
                break
        else:
            out = bytes(out)
            key = hashlib.blake2b(out, digest_size=16).digest()
            if not out or key in met:
                continue
            met.add(key)
            for text, _, _ in _readings(out):
                yield _mended(text)
            work.append(iter((out,)))


def _inflated(data: bytes) -> Iterator[str]:
    """The texts in deflated bytes without a header. As almost anything may look so, they must end well and hold a secret or
    something to unwrap."""
    if not data or data[0] & 6 == 6:  # no kind of block
        return
    opened, out = zlib.decompressobj(-15), bytearray()
    try:
        for step in _steps(memoryview(data)):
            out += opened.decompress(step, LAYER_BYTES + 1 - len(out))
            if opened.eof or len(out) > LAYER_BYTES:
                break
    except zlib.error:
        return
    if opened.eof and out:
        yield from _marked_texts(bytes(out))
    elif len(out) > LAYER_BYTES:
        yield from _pieces(_raw(data))


def _raw(data: bytes) -> Iterator[bytes]:
    opened, held = zlib.decompressobj(-15), data
    while held and not opened.eof:
        try:
            yield opened.decompress(held, STEP_BYTES)
        except zlib.error:
            return
        held = opened.unconsumed_tail


def _gzip_body(data: bytes, zeros: np.ndarray, at: int) -> int | None:
    """Where the deflated data of a gzip member begin whose header begins at ``at``; None where the header does not end."""
    if len(data) < at + 10 or data[at + 2] != 8 or data[at + 3] & 0xE0:
        return None
    flags, end = data[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for mark in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & mark:
            k = int(np.searchsorted(zeros, end))
            if k == len(zeros):
                return None
            end = int(zeros[k]) + 1
    return end + (2 if flags & 2 else 0)


def _pieces(stream: Iterator[bytes]) -> Iterator[str]:
    """Marked texts in a layer too large to hold, read in pieces that overlap, and in what it unpacks to in turn."""
    met, size = set(), PIECE_BYTES + OVERLAP_BYTES
    while True:
        held = bytearray()
        for step in stream:
            held += step
            if len(held) >= size:
                break
        key = hashlib.blake2b(held, digest_size=16).digest()
        if _decompressor(held[:6]) is None or key in met:
            break
        met.add(key)
        inner = _unpacking(itertools.chain((bytes(held),), stream))
        if (first := next(inner, None)) is None:
            break
        stream = itertools.chain((first,), inner)
    more = True
    while more:
        more = False
        for step in stream:
            held += step
            if len(held) >= size:
                more = True
                break
        while len(held) > size:
            yield from _marked_texts(bytes(held[:size]))
            del held[: _in_step(held, PIECE_BYTES)]
    yield from _marked_texts(bytes(held))


def _marked_texts(data: bytes) -> Iterator[str]:
    return (_mended(text) for text, _, _ in _readings(data) if _marked(text))


def _in_step(data: bytearray, cut: int) -> int:
    """The cut, moved back by up to three base64 characters so that a run cut there is decoded in step."""
    m = next((m for m in RUN_BYTES.finditer(data, max(0, cut - OVERLAP_BYTES)) if m.end() > cut), None)
    if m is None or m.start() >= cut:
        return cut
    odd = len(re.sub(rb"\s", b"", data[m.start() : cut])) % 4
    while odd:
        cut -= 1
        odd -= not data[cut : cut + 1].isspace()
    return cut


def _runs(text: str) -> Iterator[tuple[str, np.ndarray | int]]:
    """Base64 runs of a text, each line by itself and joined over breaks, and where the run or each of its characters stands.

    A line before the wrapped lines may be joined to them out of step, so lines of one width are taken as a run too.
    """
    for m in BASE64.finditer(text):
        yield m[0], m.start()
    for m in WRAPPED.finditer(text):
        breaks = [(m.start(), m.start()), *(x.span() for x in BREAK.finditer(text, m.start(), m.end())), (m.end(), m.end())]
        lines = [(a[1], b[0]) for a, b in itertools.pairwise(breaks) if b[0] > a[1]]
        cuts, first = {(0, len(lines))}, 0
        for i in range(1, len(lines) + 1):
            width = lines[first][1] - lines[first][0]
            if i == len(lines) or lines[i][1] - lines[i][0] != width:
                # The last line of wrapped base64 is shorter.
                last = i + (i < len(lines) and lines[i][1] - lines[i][0] < width)
                if last - first > 1:
                    cuts.add((first, last))
                first = i
        for i, j in sorted(cuts):
            yield "".join(text[s:e] for s, e in lines[i:j]), np.concatenate([np.arange(s, e, dtype=np.int32) for s, e in lines[i:j]])


def _decoded(run: str, skip: int, at: np.ndarray | int, inner: str, byte: int, wide: bool) -> Callable[[int, int], tuple[int, int]]:
    """Spans of a text read in a run's bytes from ``byte`` on, where decoding began ``skip`` characters into the run."""
    begins = None if inner.isascii() else np.concatenate(([0], np.cumsum(_widths(inner), dtype=np.int64)))

    def up(start: int, end: int) -> tuple[int, int]:
        first, last = (start, end) if begins is None else (int(begins[start]), int(begins[end]))
        first, last = (byte + 2 * first, byte + 2 * last) if wide else (byte + first, byte + last)
        first, last = skip + first * 4 // 3, min(skip - (-last * 4 // 3), len(run))
        return (at + first, at + last) if isinstance(at, int) else (int(at[first]), int(at[last - 1]) + 1)

    return up


def _in_run(layer: Layer, run: str, at: np.ndarray | int) -> Iterator[Layer]:
    """Layers in one base64 run: its bytes from each of four characters on, and what compressed data in it unpack to."""
    end = len(run)
    whole = (at, at + end) if isinstance(at, int) else (int(at[0]), int(at[-1]) + 1)
    for skip in range(min(4, end)):
        for inner, byte, wide in _readings(_data(run[skip:]) or b"", skip == 0):
            yield Layer(_mended(inner), layer, _decoded(run, skip, at, inner, byte, wide))
    read: dict[int, tuple[bytes, np.ndarray]] = {}
    bodies: set[tuple[int, int]] = set()
    for start in sorted({0, *(m.start() for m in PACKED.finditer(run))}):
        head = _data(run[start : start + 20]) or b""
        if _decompressor(head) is None or head[:3] == b"BZh" and head[4:10] not in (b"1AY&SY", b"\x17rE8P\x90"):
            continue
        step = start % 4  # places in one step share their bytes
        if step not in read:
            data = _data(run[step:]) or b""
            read[step] = data, np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
        data, zeros = read[step]
        byte = start // 4 * 3
        if head[:2] == b"\x1f\x8b":
            # Headers before the same data: the first stands for all.
            body = _gzip_body(data, zeros, byte)
            if body is None or (step, body) in bodies:
                continue
            bodies.add((step, body))
        own = (whole[0] + start if isinstance(at, int) else int(at[start]), whole[1])
        for inner in _opened(_steps(memoryview(data)[byte:])):
            yield Layer(inner, layer, lambda s, e, own=own: own)
    for inner in _inflated(_data(run) or b""):
        yield Layer(inner, layer, lambda s, e: whole)


def layers_in(layer: Layer) -> Iterator[Layer]:
    """The layers wrapped in a layer."""
    text = layer.text
    for mark, sought, decode in (("%", PERCENT, _percent), ("\\", ESCAPE, _escapes)):
        if mark in text and sought.search(text):
            at = 0
            for line in text.split("\n"):
                if mark in line and sought.search(line):
                    inner, cuts = decode(line)
                    yield Layer(inner, layer, _between(cuts, at))
                at += len(line) + 1
    for run, at in _runs(text):
        yield from _in_run(layer, run, at)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Base spans, all spans, and the number of layers below the text.

    The worklist ends because a layer with a text and place already met is not taken again.
    """
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(found(text), key=lambda x: (x[1], order[x[0]]))
    spans, seen, work = set(base), set(), [Layer(text)]
    while work:
        for inner in layers_in(work.pop()):
            if not inner.text:
                continue
            key = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *inner.span(0, len(inner.text)))
            if key in seen:
                continue
            seen.add(key)
            spans.update((kind, *inner.span(s, e)) for kind, s, e in found(inner.text))
            work.append(inner)
    return base, sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])), len(seen)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text, one row a document, in a single pass without a shuffle.

    Columns: the id, n_assign, n_access, n_hex and base_sha256 (of the text as it stands), spans (base and
    decoded ones, ``kind:start:end`` in code points of the original), n_layers.
    Null and empty texts give no span; null ids and repeated rows each give a row; empty tables give none; other columns are
    not read. Nothing bounds the number of layers or members, or what they unpack to; large ones are read in pieces. An xz
    stream that asks for more than 1 GiB of memory (its own presets ask for 65 MiB at most) is not opened.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BATCH_BYTES):
            rows = []
            for text in batch.column(1):
                base, spans, layers = scan(text.as_py() or "")
                rows.append([*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers])
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
