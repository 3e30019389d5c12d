"""Packing token sequences into windows by minimum bin slack.

A document's ids (its text's, then an end id) are cut into whole windows from its start; the
remainder goes to a pool. For each window a subset-sum programme over the multiset of remaining
lengths, kept as bits of one integer, finds the multiset that fills the window closest to its
capacity, seeded with the longest remainder; walking the programme's steps back gives how many
of each length, and a multiset that fills the window is used as often as the counts allow.
Multisets that leave slack go to a loose end, which is cut into whole windows and, at the
very end, into sequences of a power of two, so that no padding is left.

Each task packs the rows it reads: no shuffle, no more than ``POOL`` remainders in memory, and a
retried task gives the same sequences under the same ids (partition number, then a count).

Defined results: null text is empty text; an empty document is its end id alone; repeated rows
are packed as often as they occur; ids are whole numbers or text that is one (other ids are an
error); an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_arrow

#: Fixed values of the contract.
WINDOW = 2048
END = 1
#: Fixed value: the added token of the tokenizers file, whose string in a text is this one id.
ADDED = {"<|endoftext|>": 50256}
#: Remainders held by a task, and how many stay to choose from until its input ends.
POOL, STAY = 4096, 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str | None = None):
    """The byte-level BPE of ``byte_bpe_50k`` as a tiktoken encoding, which gives the same ids
    as the tokenizers file several times faster (a test compares them)."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _ENCODERS[path]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset within ``counts`` whose sum is closest to ``capacity`` from below.

    ``reach`` has bit s set if some multiset sums to s. Counts enter in powers of two; a step is
    kept with the bits before it, to walk back. Longer lengths first: sums near the capacity
    come early, and the walk stops once the capacity itself is reached.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps, goal = 1, [], 1 << capacity
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left and not reach & goal:
            size = min(size, left)
            steps.append((reach, length, size))
            reach |= (reach << (length * size)) & mask
            left, size = left - size, size * 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, size in reversed(steps):
        if not before >> at & 1:
            chosen[length] += size
            at -= length * size
    return dict(chosen)


class Packer:
    """Packs pieces as they come; ``rows`` collects (piece, sequence, offset)."""

    def __init__(self, window: int = WINDOW, pool: int = POOL, stay: int = STAY):
        self.window, self.most, self.stay = window, pool, stay
        self.by_length: dict[int, deque] = defaultdict(deque)
        self.held = self.sequences = 0
        self.loose: deque = deque()
        self.loose_ids = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.sequences, offset))
            offset += len(ids)
        self.sequences += 1

    def add(self, doc, ids: np.ndarray) -> None:
        tokens, whole = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self._emit([(doc, start, ids[start : start + self.window], tokens)])
        if whole < tokens:
            self.by_length[tokens - whole].append((doc, whole, ids[whole:].copy(), tokens))
            self.held += 1
            if self.held >= self.most:
                self._fill(self.stay)

    def _fill(self, stay: int) -> None:
        while self.held > stay:
            counts = {length: len(q) for length, q in self.by_length.items() if q}
            longest = max(counts)
            counts[longest] -= 1
            chosen = fullest(counts, self.window - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            exact = sum(length * n for length, n in chosen.items()) == self.window
            times = min(len(self.by_length[length]) // n for length, n in chosen.items()) if exact else 1
            for _ in range(times):
                pieces = [self.by_length[length].popleft() for length in sorted(chosen, reverse=True) for _ in range(chosen[length])]
                self.held -= len(pieces)
                if exact:
                    self._emit(pieces)
                else:
                    self.loose.extend(pieces)
                    self.loose_ids += sum(len(p[2]) for p in pieces)
                    while self.loose_ids >= self.window:
                        self._cut(self.window)
                if self.held <= stay:
                    break

    def _cut(self, size: int) -> None:
        pieces, lacks = [], size
        while lacks:
            doc, start, ids, tokens = self.loose.popleft()
            pieces.append((doc, start, ids[:lacks], tokens))
            if len(ids) > lacks:
                self.loose.appendleft((doc, start + lacks, ids[lacks:], tokens))
            lacks -= len(pieces[-1][2])
        self.loose_ids -= size
        self._emit(pieces)

    def end(self) -> None:
        self._fill(0)
        while self.loose_ids:
            self._cut(min(self.window, 1 << (self.loose_ids.bit_length() - 1)))


def _pack(batches: Iterator[pa.RecordBatch], window: int, ranks_path: str | None) -> Iterator[pa.RecordBatch]:
    encoding, packer = encoder(ranks_path), Packer(window)
    first = TaskContext.get().partitionId() << 40

    def done() -> pa.RecordBatch:
        columns = zip(*packer.rows, strict=True)
        arrays = [pa.array(c, pa.int64()) for c in columns] if packer.rows else [pa.array([], pa.int64())] * len(_ARROW)
        packer.rows = []
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    def given(rows: list[tuple]) -> list[tuple]:
        return [(*r[:5], first + r[5], r[6]) for r in rows]

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoding.encode_to_numpy(text.as_py() or "", allowed_special="all")
            packer.add(doc, np.append(ids, END).astype("<u4"))
        if packer.rows:
            packer.rows = given(packer.rows)
            yield done()
    packer.end()
    if packer.rows:
        packer.rows = given(packer.rows)
        yield done()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """One row per piece, see ``SCHEMA``."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(given, lambda batches: _pack(batches, window, ranks_path), SCHEMA)
