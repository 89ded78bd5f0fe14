"""Chat formatting at the level of tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.bpe import encoder, token_bytes
from eventlens.llm.common import in_batches
from eventlens.session import settle

# The control strings of the template, in the order of their
# reserved ids, which begin at the size of the vocabulary.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"]
BOS, EOS, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(len(CONTROLS))

_ESCAPABLE = re.compile("|".join(rf"(?:{re.escape(c[0])})(?:\\*)(?:{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    r"""A backslash more after the first character of every control string.

    Strings that already carry backslashes there get one more too, so that
    :func:`unescape` is exact: ``[INST]`` becomes ``[\INST]``, which becomes ``[\\INST]``.
    """
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _turn(role: str | None, text: str, first: bool) -> list[int | str]:
    """A turn as reserved ids (by place in CONTROLS) and texts; the third kind of turn names its role."""
    head: list[int | str] = [BOS] if first else []
    body = escape(text)
    if role == "user":
        return [*head, USER, body, USER_END]
    if role == "system":
        return [*head, SYSTEM, body, SYSTEM_END]
    if role == "assistant":
        return [*head, body, EOS]
    return [*head, ROLE, escape(role or ""), ROLE_END, body, EOS]


def assemble(turns: list[tuple[str | None, str, bool]], path: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Ids, loss mask and formatted characters of each ``(role, text, first)`` turn.

    All segments of the turns are encoded on their own, so no token spans a
    border and no text can become a reserved id; reserved ids are then spliced
    in. The loss mask is the prefix sum of +1 where an answer begins and -1
    where it ends.
    """
    own = encoder(path)
    base = own.merges.size
    parts = [_turn(*t) for t in turns]
    texts = [p for turn in parts for p in turn if isinstance(p, str)]
    encoded = iter(own.encode(texts))
    made = []
    for (role, _, first), turn in zip(turns, parts, strict=True):
        pieces = [np.array([base + p], "<u4") if isinstance(p, int) else next(encoded) for p in turn]
        ends = np.cumsum([len(p) for p in pieces])
        edges = np.zeros(int(ends[-1]) + 1, np.int64)
        if role == "assistant":
            answer = int(first)  # its place among the pieces, after a possible BOS
            edges[ends[answer] - len(pieces[answer])] += 1
            edges[ends[answer]] -= 1
        mask = np.cumsum(edges)[:-1].astype(np.uint8)
        size = sum(len(CONTROLS[p]) if isinstance(p, int) else len(p) for p in turn)
        made.append((np.concatenate(pieces).astype("<u4"), mask, size))
    return made


# Turns that are put in order together: a long conversation is many such chunks.
CHUNK = 64


def _running(rows: DataFrame, chunk: Column, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the earlier rows of their conversation.

    Two passes of prefix sums: over the totals of the chunks of a conversation,
    then inside each chunk. Only chunk totals of one conversation meet in a task.
    """
    keyed = rows.withColumn("chunk", chunk)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        keyed.groupBy("conv_id", "chunk").agg(F.sum(amount).alias("total"))
        .select(F.col("conv_id").alias("b_conv"), F.col("chunk").alias("b_chunk"),
                F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("chunk") == F.col("b_chunk"))
    return within.join(bases, same).withColumn(name, F.col(name) + F.col("base")).drop("chunk", "b_conv", "b_chunk", "base")


def format_chats(conversations: DataFrame, path: str) -> DataFrame:
    """Token ids and loss mask of every turn, placed in its conversation.

    ``conversations`` has ``conv_id, turn, role, text``. Each turn becomes one
    row ``conv_id, turn, row, ids`` (binary, unsigned 32-bit), ``mask`` (binary,
    a byte per id), ``n_ids, formatted_chars, start`` (ids of the conversation
    before it). A conversation is never brought together: its turns are ordered
    in chunks of CHUNK turn numbers, and offsets are prefix sums in two passes.

    Order is by turn, then role and text; ``row`` numbers it from 0. A null text
    is empty, a null role is an unnamed one, a null turn comes first, and rows
    with a null ``conv_id`` are one conversation. Repeated rows are turns of
    their own. Further columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")]
    turn_chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))
    rows = _running(rows, turn_chunk, order, F.lit(1), "row").select("conv_id", "turn", "role", "text", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, places = (batch.column(i).to_pylist() for i in (2, 3, 4))
            made = assemble([(r, t, n == 0) for r, t, n in zip(roles, texts, places, strict=True)], path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4),
                 pa.array([ids.tobytes() for ids, _, _ in made], pa.binary()),
                 pa.array([mask.tobytes() for _, mask, _ in made], pa.binary()),
                 pa.array([len(ids) for ids, _, _ in made], pa.int64()),
                 pa.array([size for _, _, size in made], pa.int64())],
                ["conv_id", "turn", "row", "ids", "mask", "n_ids", "formatted_chars"],
            )

    made = settle(
        in_batches(rows).mapInArrow(run, "conv_id long, turn long, row long, ids binary, mask binary, n_ids long, formatted_chars long"),
        "turns",
    )
    return _running(made, F.floor(F.col("row") / CHUNK), [F.col("row")], F.col("n_ids"), "start")


class Reader:
    """Reads ids back one turn after the other, knowing nothing of the input."""

    def __init__(self, path: str):
        self.of = token_bytes(path)
        self.base = encoder(path).merges.size

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str]]:
        """``role, text, loss text`` of each complete turn in ``ids``."""
        role, text, loss = "assistant", bytearray(), bytearray()
        for token, under in zip(ids.tolist(), mask.tolist(), strict=True):
            if token < self.base:
                text += self.of[token]
                if under:
                    loss += self.of[token]
                continue
            control = token - self.base
            if control == USER:
                role = "user"
            elif control == SYSTEM:
                role = "system"
            elif control == ROLE_END:
                role, text = unescape(text.decode()), bytearray()
            elif control in (USER_END, SYSTEM_END, EOS):
                yield role, unescape(text.decode()), unescape(loss.decode())
                role, text, loss = "assistant", bytearray(), bytearray()


def read_chats(formatted: DataFrame, path: str) -> DataFrame:
    """``conv_id, row, role, text, loss_text, formatted_chars`` read back from ids and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(path)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [
                (conv, row, *turn, size)
                for conv, row, ids, mask, size in zip(*columns, strict=True)
                for turn in reader.turns(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8))
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["conv_id", "row", "role", "text", "loss_text", "formatted_chars"],
            )

    return in_batches(formatted.select("conv_id", "row", "ids", "mask", "formatted_chars")).mapInArrow(
        run, "conv_id long, row long, role string, text string, loss_text string, formatted_chars long",
    )


def digest_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, characters and SHA-256 of what :func:`read_chats` gave.

    A digest takes a conversation in order, so its rows are sorted into one
    partition and streamed through the hash; memory holds a batch and a state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            for conv, _, role, text, loss, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *_closed(state)))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
            if done:
                yield _rows(done)
                done = []
        if state is not None:
            yield _rows([(current, *_closed(state))])

    ordered = turns.select("conv_id", "row", "role", "text", "loss_text", "formatted_chars").repartition(
        "conv_id").sortWithinPartitions("conv_id", "row")
    return in_batches(ordered).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _closed(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names,
    )
