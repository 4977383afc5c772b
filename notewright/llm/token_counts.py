"""Token counts: whole texts through a public tokenizer in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewright.llm.shared import small_batches

#: Texts of more characters are split at safe boundaries.
SPLIT_CHARS = 16384
BATCH_BYTES = 1 << 20


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """The text cut before single spaces between ASCII letters or digits, after ``size`` characters or more.

    There the byte-level pattern always begins a new word with the space, so the counts of the pieces add up.
    A text without such a place stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while 0 <= at and not (at + 1 < len(text) and text[at - 1].isascii() and text[at - 1].isalnum() and text[at + 1].isascii() and text[at + 1].isalnum()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def balanced(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices in batches of about ``most`` bytes each, texts of like length together."""
    order = np.argsort(sizes, kind="stable")
    batch = np.cumsum(sizes[order]) // most
    yield from np.split(order, np.flatnonzero(np.diff(batch)) + 1) if len(order) else ()


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str | None, special: tuple[tuple[str, int], ...]) -> Callable[[list[str]], list[int]]:
    """Counts for a list of texts. Rank files go through tiktoken, .json files through tokenizers, .model files through sentencepiece."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
        names, allowed = [s for s, _ in special], {s for s, _ in special}
        return lambda texts: [len(encoding.encode(t, allowed_special=allowed) if any(s in t for s in names) else encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def count_tokens(docs: DataFrame, path: str, pattern: str | None = None, special: dict[str, int] | None = None, limit: int = 1024, split: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, one row a document: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    One pass without a shuffle; only lengths leave the Arrow function. ``special`` strings inside texts count as
    one token, as the tokenizer file has them. ``split`` is for byte-level vocabularies only: elsewhere a piece
    boundary may change counts. Null and empty texts have 0 tokens; null ids and repeated rows each give a row;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    key = (path, pattern, tuple(sorted((special or {}).items())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*key)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cut = [safe_pieces(t) if split else [t] for t in texts]
            owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            flat = [p for c in cut for p in c]
            n_bytes, tokens = np.array([len(p.encode()) for p in flat], np.int64), np.zeros(len(flat), np.int64)
            for chosen in balanced(n_bytes, BATCH_BYTES):
                tokens[chosen] = count([flat[i] for i in chosen])
            n = np.bincount(owner, tokens, len(texts)).astype(np.int64)
            size = np.bincount(owner, n_bytes, len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
