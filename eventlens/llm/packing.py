"""Packing by concatenation and cutting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.bpe import Merges, encoder, sliced, text_blocks
from eventlens.llm.common import id_and_text, in_batches
from eventlens.session import settle

# the split pattern of byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _coder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizer file in the faster of the public encoders."""
    merges = Merges.from_json(path)
    ranks = {value: token for token, value in merges.tokens.items()}
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=merges.added)


def _ids(text: str, path: str) -> np.ndarray:
    """Ids of a text, in which an added token of the file is one id wherever it stands.

    The library's patterns give up on very long white space, which the replay takes.
    """
    try:
        return _coder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        own = encoder(path)
        added = own.merges.added
        found = list(regex.finditer("|".join(map(regex.escape, added)), text)) if added else []
        cuts = [0, *(place for m in found for place in m.span()), len(text)]
        # every second part is an added token
        between = own.encode([text[a:b] for a, b in list(pairwise(cuts))[::2]])
        parts = [between[0]]
        for m, after in zip(found, between[1:], strict=True):
            parts += [np.array([added[m[0]]], np.uint32), after]
        return np.concatenate(parts)


def tokenized(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, doc_id, tokens, n_tokens, before``: ids with ``end_id`` at the end of each document.

    ``before`` counts the tokens before a row within its task, which ``part``
    names; ``tokens`` holds little-endian unsigned 16-bit ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        if _coder(path).n_vocab > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        for keys, texts in text_blocks(batches):
            rows = [np.append(_ids(t, path), end_id).astype("<u2") for t in texts]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part)), keys, pa.array([r.tobytes() for r in rows], pa.binary()),
                 pa.array(sizes), pa.array(starts)],
                ["part", "doc_id", "tokens", "n_tokens", "before"],
            )

    return in_batches(id_and_text(docs, id_col, text_col)).mapInArrow(
        run, "part long, doc_id long, tokens binary, n_tokens long, before long",
    )


def pack(
    docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of the documents in sequences of ``window`` tokens.

    All documents stand in one stream, which is cut every ``window`` tokens; only
    the last sequence can be shorter. Pass 1 encodes each row where it is read
    and stores its ids with the number of tokens before it in its task; the
    totals of the tasks, one row each, are summed up to the offset of each task.
    Pass 2 cuts each document at the window borders by its global offset. Rows
    are neither shuffled nor joined by id, so repeated and null ids are fine.

    Returns one row per piece: ``doc_id, start`` (ids of the document before
    it), ``length, ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. A null or empty text is the one id ``end_id``. No
    rows give no pieces. Other columns are ignored.
    """
    stored = settle(tokenized(docs, path, end_id, id_col, text_col), "tokens")
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per task of pass 1, so ordered in one task and sent to all
    running = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = settle(totals.select("part", F.coalesce(running, F.lit(0)).alias("base")), "offsets")
    placed = stored.join(F.broadcast(offsets), "part").select(
        "doc_id", "tokens", "n_tokens", (F.col("base") + F.col("before")).alias("place"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for _, rows in sliced(_pieces(*columns, batch.column(1), window), 2048):
                made = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays(made, names)

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def _pieces(keys: list, sizes: list, places: list, tokens: pa.Array, window: int) -> Iterator[tuple]:
    for key, size, place, raw in zip(keys, sizes, places, tokens, strict=True):
        ids = np.frombuffer(raw.as_py(), "<u2").astype("<u4")
        start = 0
        while start < size:
            length = min(size - start, window - (place + start) % window)
            at = place + start
            yield key, start, length, ids[start:start + length].tobytes(), size, at // window, at % window
            start += length
