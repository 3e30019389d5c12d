"""Chat formatting: transcripts to canonical turns.

A transcript is a run of texts in order. Texts are split where a line opens with a speaker
marker; each piece has observed symbols: its marker, its length, its number of lines, and
for every line its length and whether it asks. A hidden Markov model with the roles as states is
learned from labelled transcripts by counting (first roles, role after role, symbols per role,
one added to each, lengths evened a little, and what markers mean partly given); Viterbi decoding gives the likeliest roles, and each piece is rendered
under its role, its marker taken off, adjacent pieces of one role as one turn.

Decoding is exact for transcripts of any length without gathering one in a task: texts are dealt
by transcript and ``CHUNK`` orders; each chunk gives the best score from any role before it to
any role at its end; these small matrices alone meet per transcript and fix the role at every
chunk's border, and each chunk is then decoded between its borders.

Defined results: null text is empty text (one piece); a null order comes first; pieces of one
order follow by a hash of their text, repeated rows included; ties between roles go to the one
first in ``ROLES``; without labelled rows all roles are equally likely; an empty table gives an
empty result; ids are whole numbers or text that is one (other ids are an error); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_arrow, saved, text_of

ROLES = ("system", "user", "assistant")
#: Words of speaker markers by role.
MARKERS = {"system": "system|instructions?|context", "user": "user|human|customer|question|q", "assistant": "assistant|ai|bot|agent|answer|a"}
_MARKER = r"[ \t]*(?:[#>*\[]{1,3}[ \t]*)?(?:%s)[ \t]*[\]*]{0,2}[ \t]*:[ \t]*"
_ANY = "(?i:" + _MARKER % "|".join(MARKERS.values()) + ")"
CHUNK = 256
#: The chunk of null orders, before all others.
_NULLS_FIRST = -(1 << 62)
_LENGTHS, _LINES, _MARKS = 12, 8, len(ROLES) + 1
#: Where the symbols of each observed factor start: line lengths, number of lines, whole length, marker.
_STARTS = (0, 2 * _LENGTHS, 2 * _LENGTHS + _LINES, 4 * _LENGTHS + _LINES, 4 * _LENGTHS + _LINES + _MARKS)
SYMBOLS = _STARTS[-1]
#: Share of a factor's likelihood that is even over its symbols, so that no unseen length decides alone.
EVEN = 0.1
#: How sure a role is of its own marker, and how many seen markers that belief weighs.
OWN, BELIEF = 0.999, 10.0


def _size_class(size: Column, most: int) -> Column:
    return F.least(F.floor(F.log2(size.cast("double") + 1)), F.lit(most - 1)).cast("int")


def pieces(texts: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str | None = None) -> DataFrame:
    """(id, order, tie, piece, mark, body, symbols[, role]) of every piece."""
    role = [F.col(role_col).alias("role")] if role_col else []
    split = texts.select(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("order"), F.xxhash64(text_col).alias("tie"), *role, F.posexplode(F.split(text_of(text_col), rf"\n(?={_ANY})", -1)).alias("piece", "raw"))
    mark = F.lit(0)
    for number, role_name in enumerate(ROLES, 1):
        mark = F.when(F.col("raw").rlike("^(?i:" + _MARKER % MARKERS[role_name] + ")"), number).otherwise(mark)
    marked = split.withColumn("mark", mark).withColumn("body", F.regexp_replace("raw", f"^{_ANY}", "")).withColumn("lines", F.split("body", "\n", -1))
    line = F.transform("lines", lambda x: _size_class(F.length(x), _LENGTHS) * 2 + F.endswith(F.rtrim(x), F.lit("?")).cast("int"))
    lines = F.lit(_STARTS[1]) + F.least(F.size("lines"), F.lit(_LINES)) - 1
    whole = F.lit(_STARTS[2]) + F.least(F.floor(2 * F.log2(F.length("body").cast("double") + 1)), F.lit(2 * _LENGTHS - 1)).cast("int")
    return marked.withColumn("symbols", F.concat(line, F.array(lines, whole, F.lit(_STARTS[3]) + F.col("mark")))).drop("raw", "lines")


@dataclass(frozen=True)
class Model:
    """Logs of probabilities: first role, role after role, symbol of each factor per role."""

    first: tuple[float, ...]
    after: tuple[tuple[float, ...], ...]
    symbol: tuple[tuple[float, ...], ...]


def _logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + 1.0
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def learn(texts: DataFrame, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """Count all labelled rows. A row's successor is the row of the next order."""
    labelled = texts.where(F.col(role_col).isin(*ROLES))
    n = len(ROLES)
    first, after, symbol = np.zeros(n), np.zeros((n, n)), np.zeros((n, SYMBOLS))
    roles = labelled.groupBy(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("order")).agg(F.min(role_col).alias("role"))
    following = roles.select("id", (F.col("order") - 1).alias("order"), F.col("role").alias("next"))
    for row in roles.join(following, ["id", "order"], "left").groupBy("role", "next").agg(F.count(F.lit(1)).alias("n")).collect():
        if row["next"]:
            after[ROLES.index(row["role"]), ROLES.index(row["next"])] += row["n"]
    preceded = roles.join(roles.select("id", (F.col("order") + 1).alias("order")), ["id", "order"], "left_anti")
    for row in preceded.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect():
        first[ROLES.index(row["role"])] += row["n"]
    seen = pieces(labelled, id_col, order_col, text_col, role_col).select("role", F.explode("symbols").alias("symbol"))
    for row in seen.groupBy("role", "symbol").agg(F.count(F.lit(1)).alias("n")).collect():
        symbol[ROLES.index(row["role"]), row["symbol"]] += row["n"]
    parts = []
    for a, b in zip(_STARTS[:3], _STARTS[1:4], strict=True):
        parts.append(np.log((1 - EVEN) * np.exp(_logs(symbol[:, a:b])) + EVEN / (b - a)))
    # Whether a piece is marked says nothing of its role, which marker it has does.
    given = np.full((n, n), (1 - OWN) / (n - 1))
    given[np.arange(n), np.arange(n)] = OWN
    marks = symbol[:, _STARTS[3] + 1 :] + BELIEF * given
    logs = np.hstack([*parts, np.zeros((n, 1)), np.log(marks / marks.sum(axis=1, keepdims=True))])
    return Model(tuple(_logs(first)), tuple(map(tuple, _logs(after))), tuple(map(tuple, logs)))


def _chunked(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of equal keys of sorted rows."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != at:
                yield at, held
                held = []
            at = key
            held.append(row)
    if held:
        yield at, held


def _emitted(rows: list[dict]) -> np.ndarray:
    return np.array([r["scores"] for r in rows])


def _spans(batches: Iterator[pa.RecordBatch], first: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per chunk the best score from role i before it to role j at its end, and with nothing before it."""
    out: dict[str, list] = {"id": [], "chunk": [], "span": [], "fresh": []}
    for (key, chunk), rows in _chunked(batches, ("id", "chunk")):
        span, fresh = np.where(np.eye(len(after), dtype=bool), 0.0, -np.inf), None
        for scores in _emitted(rows):
            span = (span[:, :, None] + after[None]).max(axis=1) + scores
            fresh = (first if fresh is None else (fresh[:, None] + after).max(axis=0)) + scores
        for name, value in zip(out, (key, chunk, span.ravel().tolist(), fresh.tolist()), strict=True):
            out[name].append(value)
    if out["id"]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the role before it (-1: none) and the role at its end, on the best path."""
    for (key,), rows in _chunked(batches, ("id",)):
        best, back = np.array(rows[0]["fresh"]), []
        for row in rows[1:]:
            total = best[:, None] + np.array(row["span"]).reshape(len(best), -1)
            back.append(total.argmax(axis=0))
            best = total.max(axis=0)
        ends = [int(best.argmax())]
        for step in reversed(back):
            ends.append(int(step[ends[-1]]))
        ends.reverse()
        yield pa.RecordBatch.from_arrays(
            [pa.array([key] * len(rows), pa.int64()), pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([-1, *ends[:-1]], pa.int64()), pa.array(ends, pa.int64())],
            names=["id", "chunk", "before", "end"],
        )


def _decoded(batches: Iterator[pa.RecordBatch], first: np.ndarray, after: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, rows in _chunked(batches, ("id", "chunk")):
        before, end = rows[0]["before"], rows[0]["end"]
        scores = _emitted(rows)
        best, back = (first if before < 0 else after[before]) + scores[0], []
        for k in range(1, len(rows)):
            total = best[:, None] + after
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + scores[k]
        roles = [end]
        for step in reversed(back):
            roles.append(int(step[roles[-1]]))
        roles.reverse()
        previous = [before, *roles[:-1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["id"] for r in rows], pa.int64()),
                pa.array([r["order"] for r in rows], pa.int64()),
                pa.array([r["tie"] for r in rows], pa.int64()),
                pa.array([r["piece"] for r in rows], pa.int32()),
                pa.array([ROLES[x] for x in roles]),
                pa.array([a != b for a, b in zip(previous, roles, strict=True)]),
                pa.array([r["body"] for r in rows], pa.string()),
            ],
            names=["id", "order", "tie", "piece", "role", "opens", "body"],
        )


def format_chats(texts: DataFrame, model: Model, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, order, tie, piece, role, opens, rendered): each piece under its recovered role.

    ``rendered`` opens a turn where ``opens``; joined in order they are the canonical transcript.
    """
    first, after = np.array(model.first), np.array(model.after)
    cut_up = pieces(texts.withColumn(id_col, F.col(id_col).cast("long")), id_col, order_col, text_col)
    score = F.array(*(F.aggregate("symbols", F.lit(0.0), lambda total, s: total + F.get(F.array(*map(F.lit, logs)), s)) for logs in model.symbol))
    scored = cut_up.select("id", "order", "tie", "piece", "body", F.coalesce(F.floor(F.col("order") / chunk).cast("long"), F.lit(_NULLS_FIRST)).alias("chunk"), score.alias("scores"))
    scored = saved(scored, "chat-pieces")
    order = ["id", "chunk", F.col("order").asc_nulls_first(), "tie", "piece"]
    dealt = scored.select("id", "chunk", "order", "tie", "piece", "scores").repartition("id", "chunk").sortWithinPartitions(*order)
    spans = in_arrow(dealt.select("id", "chunk", "scores"), lambda b: _spans(b, first, after), "id long, chunk long, span array<double>, fresh array<double>")
    borders = in_arrow(spans.repartition("id").sortWithinPartitions("id", "chunk"), _borders, "id long, chunk long, before long, end long")
    bordered = scored.join(borders.withColumnRenamed("id", "of").withColumnRenamed("chunk", "at"), F.col("id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
    ready = bordered.select("id", "chunk", "order", "tie", "piece", "body", "scores", "before", "end").repartition("id", "chunk").sortWithinPartitions(*order)
    found = in_arrow(ready, lambda b: _decoded(b, first, after), "id long, order long, tie long, piece int, role string, opens boolean, body string")
    turn = F.concat(F.when(F.col("opens"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(F.lit("")), F.trim("body"), F.lit("\n"))
    return found.select("id", "order", "tie", "piece", "role", "opens", turn.alias("rendered"))
