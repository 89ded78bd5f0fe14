"""Secret scans with multipart credential linking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.llm.common import free_names, id_and_text
from eventlens.session import settle

# The base kinds, in the order they are listed, each with its
# pattern, the group whose length counts, and the characters it needs.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# Parts too weak to be reported alone. A short assigned value comes from the
# matches the base kind drops.
WEAK = {
    "weak_id": r"""(?i:\b(?:user_?name|user_?id|user|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""",
    "endpoint": r"""(?:(?i:\b(?:host|endpoint|server|database|db_?url|base_?url))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/@-]{4,}|\b[a-z][a-z0-9+]{2,12}://[^\s"'<>]+)""",
    "weak_secret": r"""(?i:(?:password|passwd|pass|pwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""",
}
KINDS = [*BASE, "weak_id", "weak_secret", "endpoint"]
# What stands between two lines; more than one character stands between two blocks of lines.
LINE_END = r"\n(?:[\x20\t\r]*\n)*"
# A document can hold linked parts only if it has one of these at all; a cheap
# test that lets most texts skip the patterns of weak parts.
_SIGN = r"(?i)(?:user|login|account|client|access|host|endpoint|server|database|url|://|AKIA|pass|pwd|secret|token|key)"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of ``(start, kind, end)`` of the matches whose group has ``least`` characters.

    Matches and the pieces between them come from two built-in functions that
    walk the text the same way; adding up their lengths gives the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    counted = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("size"),
        F.transform(counted, F.length).alias("counts"),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"),
    )

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + part["gap"]
        end = begin + part["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(part["counts"] >= least, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(zipped, start, step, lambda done: done["spans"])


def _if_found(text: Column, test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and then kind; quick tests spare most texts the long patterns."""
    assign = F.lower(text).rlike("pass|secret|token|api_?key")
    tests = {"assign": assign, "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike("[0-9a-f]{16}")}
    found = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "hex":
            # runs that are too short cannot change where longer ones begin
            pattern = f"[0-9a-f]{{{least},}}"
        found.append(_if_found(text, tests[kind], _spans(text, kind, pattern, group, least)))
    return F.array_sort(F.concat(*found))


def breaks(text: Column) -> Column:
    """Where lines end, as :func:`_spans`, in texts that can hold linked parts at all."""
    return _if_found(text, text.rlike(_SIGN), _spans(text, KINDS[0], LINE_END, 0, 0))


def weak_spans(text: Column) -> Column:
    found = [_spans(text, kind, pattern, 0, 0) for kind, pattern in WEAK.items()]
    return _if_found(text, text.rlike(_SIGN), F.array_sort(F.concat(*found)))


def linked_spans(parts: DataFrame, keys: list[str], reach: int = 200) -> DataFrame:
    """Weak parts whose complement stands within ``reach`` characters or on another line of the same block.

    ``parts`` has ``keys`` (which name the text), ``start, kind, end``, ``line`` and ``block``. A weak
    secret is reported near an identifier, a weak identifier near a secret, and
    an endpoint near both. An interval join does the pairing by distance: each part is
    entered in every cell of ``reach`` characters that it touches, each
    candidate looks in the cells that its span widened by ``reach`` touches, and
    equal cells are compared by position. Blocks, lines without a blank one between them, are scopes
    of any length, joined by their number; on one line only the distance counts. Semi-joins keep one row per candidate
    and cell; a cell holds no more parts than characters, so no text, however
    long, is a group. Returns distinct ``keys, start, kind, end``.
    """
    number = {name: i for i, name in enumerate(KINDS)}
    secrets = [number[k] for k in ("assign", "hex", "weak_secret")]
    ids = [number[k] for k in ("access", "weak_id")]

    def cells(frame: DataFrame, margin: int) -> DataFrame:
        low = F.greatest(F.floor((F.col("start") - margin) / reach), F.lit(0))
        return frame.withColumn("cell", F.explode(F.sequence(low, F.floor((F.col("end") + margin) / reach))))

    def near(weak: DataFrame, kinds: list[int]) -> DataFrame:
        named = parts.filter(F.col("kind").isin(kinds))
        places = [F.col("start").alias("o_start"), F.col("end").alias("o_end")]
        others = cells(named, 0).select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("cell").alias("o_cell"), *places)
        blocks = named.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("block").alias("o_block"), F.col("line").alias("o_line"))
        same = [F.col(k) == F.col(f"o_{k}") for k in keys]
        within = (F.col("o_start") <= F.col("end") + reach) & (F.col("o_end") >= F.col("start") - reach)
        # a span within another of the complementary kind is the same text
        apart = (F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end"))
        by_cell = reduce(Column.__and__, same) & (F.col("cell") == F.col("o_cell")) & within & apart
        by_block = reduce(Column.__and__, same) & (F.col("block") == F.col("o_block")) & (F.col("line") != F.col("o_line"))
        fields = (*keys, "start", "kind", "end", "line", "block")
        met = cells(weak, reach).join(others, by_cell, "left_semi").select(*fields)
        return met.union(weak.join(blocks, by_block, "left_semi").select(*fields)).distinct()

    def of(kind: str) -> DataFrame:
        return parts.filter(F.col("kind") == number[kind]).select(*keys, "start", "kind", "end", "line", "block")

    secret_found = near(of("weak_secret"), ids)
    id_found = near(of("weak_id"), secrets)
    endpoint_found = near(near(of("endpoint"), ids), secrets)
    return secret_found.union(id_found).union(endpoint_found).drop("line", "block")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Secrets of whole texts: ``doc_id, text_key, base, spans``.

    ``base`` holds the spans of the base kinds, ``spans`` these and those linked
    by distance or block (:func:`linked_spans`), both arrays of ``(start, kind, end)`` in code points with the end
    exclusive, sorted; ``kind`` is a place in KINDS. A linked span that a base
    span covers is left out. ``text_key`` is a hash of the text, for joining
    back to it.

    Null and empty texts have no spans. One row per input row: rows that repeat
    an id and a text share the same spans, rows of one id with different texts
    do not. A null id is kept. Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    found = settle(
        rows.select(
            "doc_id", F.xxhash64("text").alias("text_key"), base_spans(F.col("text")).alias("base"),
            weak_spans(F.col("text")).alias("weak"), breaks(F.col("text")).alias("breaks"),
        ),
        "spans",
    )
    scoped = found.withColumn("scope", F.coalesce("doc_id", F.lit(0)))
    joined = scoped.join(_extra_spans(scoped, reach), ["scope", "text_key"], "left")
    return joined.select("doc_id", "text_key", "base", _all_spans(F.col("base"), F.col("extra")).alias("spans"))


def _extra_spans(found: DataFrame, reach: int) -> DataFrame:
    """``scope, text_key, extra``: linked spans of the texts that have any, from ``scope, text_key, base, weak, breaks``."""
    kept = found.filter(F.size("weak") > 0)
    spans = kept.select("scope", "text_key", F.explode(F.concat("base", "weak")).alias("p")).select("scope", "text_key", "p.*").distinct()
    ends = kept.select("scope", "text_key", F.explode("breaks").alias("b")).select(
        "scope", "text_key", F.col("b.end").alias("start"), F.lit(None).cast("int").alias("kind"), (F.col("b.end") - F.col("b.start")).alias("end"),
    ).distinct()
    # a part's line and block are the numbers of line ends and of blank lines before it in its text
    order = Window.partitionBy("scope", "text_key").orderBy("start", F.col("kind").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    passed = {"line": F.col("kind").isNull(), "block": F.col("kind").isNull() & (F.col("end") > 1)}
    placed = spans.union(ends).withColumns({c: F.count(F.when(test, 1)).over(order) for c, test in passed.items()})
    parts = settle(placed.filter("kind IS NOT NULL"), "parts")
    return (
        linked_spans(parts, ["scope", "text_key"], reach)
        .groupBy("scope", "text_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("extra"))
    )


def _all_spans(base: Column, extra: Column) -> Column:
    """``base`` and those of ``extra``, which may be null, that no base span covers."""
    covered = lambda x: F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    return F.coalesce(F.array_sort(F.concat(base, F.filter(extra, lambda x: ~covered(x)))), base)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping ``spans`` replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, span: Column) -> Column:
        size = span["start"] - done["at"]
        piece = F.concat(F.substr(text, done["at"] + 1, F.greatest(size, F.lit(0))), F.lit(mark))
        return F.struct(
            F.greatest(done["at"], span["end"]).alias("at"),
            F.when((size >= 0) & (span["end"] > done["at"]), F.concat(done["parts"], F.array(piece)))
            .otherwise(done["parts"]).alias("parts"),
        )

    done = F.aggregate(spans, start, step, lambda d: F.concat(F.array_join(d["parts"], ""), F.substr(text, d["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``, any further columns) with every secret replaced in its text.

    Spans are those of :func:`scan_secrets`. Documents are stored beside their
    spans; only those with weak parts, which may be linked, are shuffled to learn
    which are. ``n_chars`` follows the new text where the column exists. A
    document without secrets is left as it is, nulls included. Null and
    repeated ids change nothing, as spans are linked within id and text. Further columns may have any
    name; an empty table stays empty.
    """
    id_, key, base, weak, lines, extra = free_names(
        docs, "scope_id", "scope_text", "base_spans", "weak_spans", "line_breaks", "extra_spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stored = settle(
        docs.select(
            "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(id_), F.xxhash64(text).alias(key),
            base_spans(text).alias(base), weak_spans(text).alias(weak), breaks(text).alias(lines),
        ),
        "scanned",
    )
    found = stored.select(*[F.col(c).alias(n) for c, n in (
        (id_, "scope"), (key, "text_key"), (base, "base"), (weak, "weak"), (lines, "breaks"))])
    linked = _extra_spans(found, reach).select(F.col("scope").alias(id_), F.col("text_key").alias(key), F.col("extra").alias(extra))
    none = F.lit(None).cast("array<struct<start:int,kind:int,end:int>>").alias(extra)
    alone = stored.filter(F.size(weak) == 0).select(*stored.columns, none)
    both = stored.filter(F.size(weak) > 0).join(linked, [id_, key], "left").select(*stored.columns, extra)
    spans = _all_spans(F.col(base), F.col(extra))
    changed = alone.unionByName(both).withColumn(base, spans)
    has = F.size(base) > 0
    changed = changed.withColumn("text", F.when(has, redacted(F.col("text"), F.col(base))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        changed = changed.withColumn("n_chars", F.when(has, size).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
