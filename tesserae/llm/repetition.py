"""Quality rules with suffix-array repetition.

Beside plain counts, each text's words get a suffix array with longest common prefixes. A
suffix's longer neighbouring prefix is the deepest LCP interval that holds it, so the spans
``[p, p + that length)`` over all suffixes are the union of all maximal repeated substrings.
A text fails if its repeats of ``LEAST`` words or more cover more than ``MOST_COVERED`` of it, or if
its longest repeat has more than ``MOST_LONGEST`` words, whatever the text's length. Words of such
repeats are in repeated 3-word windows too, so the share has to be well below the contract's.

Many texts share one run of the array steps: the document leads every sort key, so suffixes
are compared within their own text only. Ranks double the compared length each round and
only suffixes that still tie go on; common prefixes of neighbours follow from the ranks of
the rounds, longest stride first. A text is never cut: a run holds whole texts.

Defined results: null text is empty text; a text without words has zero counts and fails on
n_words; repeated rows and ids are judged one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_arrow

#: Fixed values of the contract: symbols counted, least words, most words in repeated 3-word windows (%).
SYMBOLS = b"#*$%&|<>"
BASE_WORDS, BASE_REPEAT = 50, 50
#: The method's limits: repeats of so many words count; most covered share; longest repeat in words.
LEAST, MOST_COVERED, MOST_LONGEST = 10, 0.20, 50
#: Words in one run of the array steps; one text may have more.
RUN = 400_000

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, how many words from there on occur again elsewhere in its document.

    ``words``: word numbers; ``doc``: document numbers, rising; all documents joined.
    """
    n = len(words)
    found = np.zeros(n, np.int64)
    if not n:
        return found
    last = np.searchsorted(doc, doc, side="right")  # the position after the document

    def ranked(at: np.ndarray, keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sort positions by key within the runs of equal base rank: new order, ranks, and which tie."""
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        tied = np.diff(np.append(starts, len(at))) > 1
        # A rank is where the group starts among all suffixes: the base rank plus smaller suffixes of the same base.
        base = base[order]
        run = np.empty(len(at), bool)
        run[0], run[1:] = True, base[1:] != base[:-1]
        run_start = np.flatnonzero(run)[np.cumsum(run) - 1]
        return at, base + starts[group] - run_start, tied[group]

    at = np.arange(n)
    at, rank_of, tie = ranked(at, doc.astype(np.int64) * (int(words.max()) + 1) + words, np.zeros(n, np.int64))
    ranks = np.empty(n + 1, np.int64)
    ranks[at] = rank_of
    ranks[n] = -1
    levels, stride = [ranks], 1
    active = at[tie]
    while len(active):
        ranks = levels[-1]
        ahead = active + stride
        second = np.where(ahead < last[active], ranks[np.minimum(ahead, n)], -1) + 1
        first = ranks[active]
        at, rank_of, tie = ranked(active, first * (n + 1) + second, first)
        ranks = ranks.copy()
        ranks[at] = rank_of
        levels.append(ranks)
        stride *= 2
        active = at[tie]
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1][:n]] = np.arange(n)
    # Common prefixes of neighbours that share their first word at all.
    left, right = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][left] == levels[0][right])
    i, j = left[pairs], right[pairs]
    common = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ranks, stride = levels[k], 1 << k
        inside = (i < last[left[pairs]]) & (j < last[left[pairs]])
        same = inside & (ranks[np.minimum(i, n)] == ranks[np.minimum(j, n)])
        common[same] += stride
        i, j = i + stride * same, j + stride * same
    np.maximum.at(found, left[pairs], common)
    np.maximum.at(found, right[pairs], common)
    return found


def covered(found: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Whether each position lies in a repeat of ``least`` words or more (``length``: in that many words of one)."""
    n = len(found)
    starts = np.flatnonzero(found >= least)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + (found[starts] if length is None else length), -1)
    return np.cumsum(edges[:n]) > 0


def _line_count(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _judged(ids: list, texts: list[bytes], limits: tuple) -> pa.RecordBatch:
    least, most_covered, most_longest = limits
    split = [x.split() for x in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    numbers = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = longest_repeats(numbers, doc)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flags], minlength=len(split)).astype(np.int64)

    repeated, spans = total(covered(found, 3, 3)), total(covered(found, least))
    longest = np.zeros(len(split), np.int64)
    np.maximum.at(longest, doc, found)
    chars = np.array([len(x.decode()) - sum(x.count(c) for c in b" \t\n\x0b\x0c\r") for x in texts], np.int64)
    symbols = np.array([sum(x.count(c) for c in SYMBOLS) for x in texts], np.int64)
    lines = np.array([_line_count(x) for x in texts], np.int64)
    failed = (sizes < BASE_WORDS) | (100 * repeated > BASE_REPEAT * sizes)
    bad = (spans > most_covered * sizes) | (longest > most_longest)
    columns = [pa.array(ids, pa.int64()), sizes, chars, symbols, lines, repeated, failed, ~failed & ~bad, spans, longest]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def _rules(batches: Iterator[pa.RecordBatch], limits: tuple) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1]) // 6  # about the words
            if size >= RUN:
                yield _judged(ids, texts, limits)
                ids, texts, size = [], [], 0
    if ids:
        yield _judged(ids, texts, limits)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    most_covered: float = MOST_COVERED,
    most_longest: int = MOST_LONGEST,
) -> DataFrame:
    """One row per row of ``docs``, see ``SCHEMA``."""
    limits = (least, most_covered, most_longest)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(given, lambda batches: _rules(batches, limits), SCHEMA)
