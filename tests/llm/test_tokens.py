"""Byte-level BPE, packing and chat formatting against public libraries and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventlens.llm import bpe, chat_format
from eventlens.llm.packing import _ids, pack
from eventlens.llm.queries import QUERIES
from tests.llm import plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(JSON)
    found.encode_special_tokens = True
    return found


ODD = st.text(st.sampled_from("ab zSéñ09²½.!?'-\"\n\t  　日本😀́streve"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD | st.text(max_size=20), max_size=5))
def test_encoder_equals_the_library(coder, texts):
    got = bpe.encoder(RANKS).encode(texts)
    assert [x.tolist() for x in got] == [coder.encode_ordinary(t) for t in texts]


def test_replay_of_long_and_repeated_words(coder):
    random.seed(2)
    texts = ["a" * 3000, "ab" * 999 + "aab" * 500, "".join(random.choice("aehinrst") for _ in range(5000)), "<|endoftext|>"]
    assert [x.tolist() for x in bpe.Encoder(bpe.Merges.from_ranks(RANKS)).encode(texts)] == [coder.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 1_000_000, "\n" * 500_000 + "end", "ab" * 100_000, (" " * 2000 + "a") * 300])
def test_very_long_runs_take_little_time(text):
    started = time.process_time()
    ids = bpe.encoder(JSON).encode([text])[0]
    assert b"".join(map(bpe.token_bytes(JSON).__getitem__, ids.tolist())).decode() == text
    assert _ids(text, JSON).tolist() == ids.tolist()
    assert time.process_time() - started < 20


def test_tokens_that_lower_ranks_follow():
    """Ranks in which a later merge is followed by an earlier one: words still go left to right."""
    random.seed(3)
    for _ in range(60):
        values = {bytes([b]) for b in range(256)}
        order = [bytes([b]) for b in range(256)]
        while len(order) < 290:
            new = b"".join(random.choice([v for v in order[97:100] + order[256:]]) for _ in range(random.choice([2, 2, 3])))
            if new not in values and len(new) < 9:
                values.add(new)
                order.append(new)
        random.shuffle(tail := order[256:])
        ranks = {v: i for i, v in enumerate(order[:256] + tail)}
        library = tiktoken.Encoding("made", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pairs = {
            (ranks[v[:cut]], ranks[v[cut:]]): (r, r) for v, r in ranks.items() for cut in range(1, len(v))
            if v[:cut] in ranks and v[cut:] in ranks
        }
        merges = bpe.Merges({r: v for v, r in ranks.items()}, pairs, whole=True)
        words = ["".join(random.choice("abc") for _ in range(random.randint(1, 30))) for _ in range(60)]
        ids, counts = bpe.encode_words([w.encode() for w in words], merges)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [library.encode_ordinary(w) for w in words]


def test_memory_of_words_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    own = bpe.Encoder(bpe.Merges.from_ranks(RANKS))
    for text in ("one two three four", "four five six one", "", "two"):
        assert own.encode([text])[0].tolist() == coder.encode_ordinary(text)


def test_json_and_ranks_agree(tokenizer, spark, sf):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encoder(JSON).encode(texts)] == want


def test_bpe_query(spark, sf, coder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = np.array(coder.encode_ordinary(texts[row["doc_id"]]), "<u4")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_bpe_on_odd_rows(spark, odd_docs, no_docs):
    found = bpe.decode_column(bpe.encode_column(odd_docs, RANKS), RANKS)
    want = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()), key=str)
    assert sorted(((r["doc_id"], bytes(r["text_bytes"])) for r in found.collect()), key=str) == want
    assert bpe.encode_column(no_docs, RANKS).collect() == []


def check_pieces(pieces, want, window):
    """Every document whole, every sequence gapless, all but the last one full."""
    by_place = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    place = 0
    for p in by_place:
        assert (p["sequence_id"], p["offset"]) == divmod(place, window)
        assert 0 < p["length"] <= window - p["offset"]
        place += p["length"]
    rest = list(want)
    current: list = []
    for p in by_place:
        if p["start"] == 0:
            current = [p["doc_id"], b"", p["doc_tokens"]]
        assert p["start"] * 4 == len(current[1]) and p["doc_tokens"] == current[2]
        current[1] += bytes(p["ids"])
        if len(current[1]) == 4 * current[2]:
            rest.remove((current[0], current[1]))
    assert rest == [] and place == sum(len(b) // 4 for _, b in want)


@pytest.mark.parametrize("window", [2048, 7])
def test_packing_on_odd_rows(spark, odd_docs, no_docs, tokenizer, window):
    want = [
        (r["doc_id"], np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
        for r in odd_docs.collect()
    ]
    check_pieces(pack(odd_docs.repartition(3), JSON, window).collect(), want, window)
    assert pack(no_docs, JSON).collect() == []


def test_packing_query(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    rows = QUERIES["op9_packing"](spark, sf).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert places[0][:2] == (0, 0)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:], strict=False):
        assert (s2, o2) == (s, o + n) if o + n < 2048 else (s + 1, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "[", "<", "INST]", "s>", "a", "\n"]), max_size=12))
def test_escape_is_reversible_and_leaves_no_control(parts):
    text = "".join(parts)
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROLS)


def plain_chats(rows):
    by_conv: dict = {}
    order = lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=order):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in by_conv.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op5_chat_format"](spark, sf)
    assert plain.rows_of(got, *COLUMNS) == plain_chats(rows)


def test_chats_with_odd_rows(spark):
    rows = [
        (1, 0, "system", "be [INST] kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "</s>é\n"),
        (2, 5, None, "no role"), (2, None, "tool\n[INST]", "x"), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"),
        (None, 1, "user", "hi"), (None, 2, "assistant", "<<ROLE>>yes"), (3, 0, "assistant", None),
    ] + [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS row")
    formatted = chat_format.format_chats(turns, RANKS)
    got = chat_format.digest_chats(chat_format.read_chats(formatted, RANKS))
    assert plain.rows_of(got, *COLUMNS) == plain_chats(rows)
    placed = sorted(formatted.filter("conv_id = 4").select("row", "start", "n_ids").collect())
    assert [r["row"] for r in placed] == list(range(300))
    assert all(a["start"] + a["n_ids"] == b["start"] for a, b in zip(placed, placed[1:], strict=False))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest_chats(chat_format.read_chats(chat_format.format_chats(empty, RANKS), RANKS)).collect() == []


def test_added_tokens_in_texts(spark):
    """The library as the contract calls it: an added token of the file is one id inside a text."""
    library, end = Tokenizer.from_file(JSON), "<|endoftext|>"
    texts = [
        f"a {end} b", end, end * 3, f"x  {end}  y\n{end}", f"{end[:-1]} {end[1:]}", f"<{end}>", "plain",
        f"{end} a{end}{end} b {end}",
    ]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [_ids(t, JSON).tolist() for t in texts] == want
    # white space that only the replay takes: the parts around it are encoded as before
    long = " " * 1_000_000
    space = _ids(long, JSON).tolist()
    assert _ids(f"{texts[0]}{end}{long}{end}{texts[-1]}", JSON).tolist() == [*want[0], 50256, *space, 50256, *want[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(pack(docs, JSON, 7).collect(), [(i, np.array([*ids, 1], "<u4").tobytes()) for i, ids in enumerate(want)], 7)
