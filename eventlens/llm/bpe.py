"""Byte-level BPE by corpus-level merge replay.

A block of texts is split into words. Every distinct word of the block that is
not known yet joins one array of symbols, and the merges are replayed over all
of them at once in rank order. An inverted index tells for each merge at which
positions its pair stands; applying a merge touches these positions and the two
neighbours of each, whose new pairs are entered in the index.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from eventlens.llm.common import id_and_text, in_batches

# Characters of text split at a time, and distinct words remembered between
# blocks: both bound a task's memory, neither changes a result.
BLOCK_CHARS = 2 << 20
WORDS_KEPT = 300_000

# Stands between the texts of a block; no text read from UTF-8 can hold it.
BETWEEN = "\ud800"
_OTHER, _LETTER, _NUMBER, _SPACE, _WHITE, _BETWEEN = range(6)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the properties the split pattern names."""
    table = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for name, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, text):
            table[run.start():run.end()] = name
    table[0x20] = _SPACE
    table[ord(BETWEEN)] = _BETWEEN
    return table


def word_starts(text: str) -> np.ndarray:
    """Where the words of ``text`` begin, as the split pattern of the rank files has them.

    A word is a run of letters, of numbers or of other characters, each with one
    space before it if there is one; a run of white space without that space;
    or one of the contractions 's 't 're 've 'm 'll 'd that is not preceded by a
    space or another mark. The character BETWEEN ends a text and is a word.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[code]
    white = (kind == _SPACE) | (kind == _WHITE)
    group = np.where(white, _SPACE, kind)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(group[1:], group[:-1], out=start[1:])
    start[1:] |= kind[1:] == _BETWEEN
    # the last white character before a word stands alone, or joins the word if it is a space
    last = white[:-1] & ~white[1:] & (kind[1:] != _BETWEEN)
    start[:-1] |= last
    start[1:] &= ~(last & (kind[:-1] == _SPACE))
    # contractions: an apostrophe that begins a word, and the letters after it
    marks = np.flatnonzero((code == 0x27) & start)
    for at in marks[marks + 1 < n].tolist():
        after = text[at + 1:at + 3]
        size = 2 if after[0] in "stmd" else 3 if after in ("re", "ve", "ll") else 0
        if size:
            start[at + 1:at + size] = False
            if at + size < n and kind[at + size] == _LETTER:
                start[at + size] = True
    return np.flatnonzero(start)


def split_words(text: str) -> list[str]:
    places = word_starts(text).tolist()
    places.append(len(text))
    return [text[a:b] for a, b in pairwise(places)]


class Merges:
    """Pairs of token ids, each with its rank and the id it becomes.

    With ``whole`` a word that is a token is that token, whatever merges would give.
    ``added`` holds texts that are one id wherever they stand; no merge gives these
    ids, so whoever encodes cuts the texts out first.
    """

    def __init__(
        self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool,
        added: dict[str, int] | None = None,
    ):
        self.tokens = tokens
        self.added = added or {}
        self.whole = {value: token for token, value in tokens.items()} if whole else {}
        self.size = max(tokens) + 1
        self.by_byte = np.zeros(256, np.int64)
        for token, value in tokens.items():
            if len(value) == 1:
                self.by_byte[value[0]] = token
        codes = np.array([a * self.size + b for a, b in pairs], np.int64)
        ranked = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], ranked[order, 0]
        # the merges of one rank all give the same id
        self.becomes = dict(ranked.tolist())
        # ranks after whose merge no pair of a rank as low can arise
        lowest = np.full(self.size, len(self.codes) + self.size, np.int64)
        for part in (self.codes // self.size, self.codes % self.size):
            np.minimum.at(lowest, part, self.ranks)
        self.settled = {rank for rank, token in self.becomes.items() if lowest[token] > rank}

    @classmethod
    @lru_cache(maxsize=4)
    def from_ranks(cls, path: str) -> Merges:
        """A tiktoken rank file: two tokens merge when their bytes together are a token."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pairs = {}
        for value, rank in ranks.items():
            for cut in range(1, len(value)):
                left, right = ranks.get(value[:cut]), ranks.get(value[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank, rank)
        return cls({rank: value for value, rank in ranks.items()}, pairs, whole=True)

    @classmethod
    @lru_cache(maxsize=4)
    def from_json(cls, path: str) -> Merges:
        """A tokenizer file with a byte-level vocabulary and an ordered list of merges."""
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model, letters = found["model"], _byte_letters()
        if any(x[k] for x in found["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with conditions on the text around them are not supported")
        # longest first, for patterns that take the first of several that fit
        added = {x["content"]: x["id"] for x in sorted(found["added_tokens"], key=lambda x: -len(x["content"]))}
        vocab = {k: v for k, v in model["vocab"].items() if k not in added}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        tokens = {i: bytes(letters[c] for c in text) for text, i in vocab.items()}
        return cls(tokens, pairs, whole=bool(model.get("ignore_merges")), added=added)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair does not merge."""
        wanted = left * self.size + right
        at = np.searchsorted(self.codes, wanted)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == wanted, self.ranks[at], -1)


def _byte_letters() -> dict[str, int]:
    """The printable character a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def encode_words(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``words`` in one array, and the number of ids of each word."""
    if not merges.whole:
        return replay(words, merges)
    whole = np.fromiter((merges.whole.get(w, -1) for w in words), np.int64, len(words))
    parts = whole < 0
    ids, sizes = replay([w for w, open_ in zip(words, parts.tolist(), strict=True) if open_], merges)
    counts = np.ones(len(words), np.int64)
    counts[parts] = sizes
    merged = np.empty(int(counts.sum()), np.int64)
    from_merges = np.repeat(parts, counts)
    merged[from_merges], merged[~from_merges] = ids, whole[~parts]
    return merged, counts


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``words`` in one array, and the number of ids of each word, by merges.

    In every step the lowest rank that stands anywhere is taken and applied at
    all its positions, from left to right where they overlap, so a word sees the
    same merges in the same order as if it were encoded alone. Where the merged
    token could begin or end a pair of a lower rank still, only the leftmost
    position of each word is taken and the others wait in the index.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    token = merges.by_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    right = np.arange(1, n + 1, dtype=np.int32)
    left = np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    right[ends] = -1
    left[ends[:-1] + 1] = -1  # the first symbol of all has -1 already
    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []
    rank_at = np.full(n, -1, np.int32)  # rank of the pair that begins at a position

    def enter(at: np.ndarray) -> None:
        """Index the pairs that begin at ``at``."""
        at = np.unique(at)
        rank = merges.ranks_of(token[at], token[right[at]])
        rank_at[at] = rank
        merging = rank >= 0
        at, rank = at[merging], rank[merging]
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
        begin = 0
        cuts = [*(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)] if len(at) else []
        for end in cuts:
            r = int(rank[begin])
            if r not in index:
                index[r] = []
                heapq.heappush(ranks, r)
            index[r].append(at[begin:end])
            begin = end

    enter(np.flatnonzero(right >= 0))
    alive = np.ones(n, bool)
    while ranks:
        rank = heapq.heappop(ranks)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[rank_at[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            if len(lists) > 1:
                at = np.unique(at)
            if rank in merges.settled:
                at = at[_apart(right[at[:-1]] == at[1:])]
            else:
                words_at = word[at]
                later = words_at[1:] == words_at[:-1]
                if later.any():
                    index[rank] = [at[1:][later]]
                    heapq.heappush(ranks, rank)
                    at = at[np.concatenate([[True], ~later])]
        gone = right[at]
        after = right[gone]
        token[at] = merges.becomes[rank]
        alive[gone] = False
        rank_at[at] = rank_at[gone] = -1
        right[at] = after
        linked = after >= 0
        left[after[linked]] = at[linked]
        before = left[at]
        enter(np.concatenate([before[before >= 0], at[linked]]))
    return token[alive], np.bincount(word[alive], minlength=len(words))


def _apart(touches: np.ndarray) -> np.ndarray:
    """Of positions in order, every second one of a run in which each touches the next."""
    if not touches.any():
        return np.ones(len(touches) + 1, bool)
    place = np.arange(len(touches) + 1)
    begins = np.concatenate([[True], ~touches])
    return (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0


class _Known(dict):
    """Numbers of words; a word that is asked for first gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes texts block by block, remembering the words it has replayed."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        self.known = _Known({BETWEEN: 0})
        self.ids = np.zeros(0, np.uint32)
        self.start, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if not texts:
            return []
        if len(self.known) > WORDS_KEPT:
            self._forget()
        words = split_words(BETWEEN.join(texts))
        row = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        del words
        if len(self.known) > len(self.count):
            new = list(islice(self.known, len(self.count), None))
            ids, counts = encode_words([w.encode("utf-8") for w in new], self.merges)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        counts = self.count[row]
        before = np.cumsum(counts) - counts
        ids = self.ids[np.arange(int(counts.sum())) + np.repeat(self.start[row] - before, counts)]
        return np.split(ids, before[row == 0])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept between the tasks of a worker."""
    return Encoder(Merges.from_json(path) if path.endswith(".json") else Merges.from_ranks(path))


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; empty for an unused one."""
    tokens = encoder(path).merges.tokens
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit), one row per input row.

    Whole texts; a null text is empty and has no ids. Repeated rows and null ids
    stay as they are, other columns are ignored. Rows are encoded where they are
    read: no shuffle, and a task holds one block of texts and its word memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for keys, texts in text_blocks(batches):
            ids = pa.array([x.tobytes() for x in own.encode(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, ids], ["doc_id", "ids"])

    return in_batches(id_and_text(docs, id_col, text_col)).mapInArrow(run, "doc_id long, ids binary")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text_bytes``: the bytes of the ids of each row of :func:`encode_column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(path)
        for batch in batches:
            found = (b"".join(map(of.__getitem__, np.frombuffer(x.as_py(), "<u4").tolist())) for x in batch.column(1))
            for start, values in sliced(found, 512):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(start, len(values)) for c in batch.columns), pa.array(values, pa.binary())],
                    ["doc_id", "ids", "text_bytes"],
                )

    return in_batches(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, ids binary, text_bytes binary")


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """First column and texts (second column) of the batches, a block at a time."""
    for batch in batches:
        lengths = pa.compute.utf8_length(batch.column(1)).to_numpy()
        block = np.cumsum(lengths, dtype=np.int64) // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if b > a:
                yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()


def sliced(values: Iterator, size: int) -> Iterator[tuple[int, list]]:
    """Lists of at most ``size`` values, each with the place of its first."""
    for start, chunk in enumerate(iter(lambda: list(islice(values, size)), [])):
        yield start * size, chunk
