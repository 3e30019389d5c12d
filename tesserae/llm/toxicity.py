"""Toxicity by a weighted lexicon.

A text is folded: lower case, look-alike letters of other scripts to Latin, digits and signs
that stand for letters to those letters, everything else to a space. One Aho-Corasick
automaton matches whole words and word beginnings of the lexicon and the exception phrases;
a match that lies within an exception phrase doesn't count. The weights of what is left,
as they are and normalised by the text's length, give the score through a logistic curve.

All of it is learned from labelled rows: how many toxic and clean texts hold each word and
word beginning gives the lexicon, a second pass over the same rows its exceptions (phrases of
a matched word with a neighbour that are clean almost always). Both count over every labelled
row; counts are summed before they leave a task. The curve is fitted on at most ``FIT_ROWS``
rows, taken by hash. Only the odds against the whole corpus and their deviations decide what is
in the lexicon, only the share of toxic texts what is an exception; neither is cut to a count.

Defined results: null text is empty text; a text without a match gets the curve's value for
none; rows are scored one by one, repeated ids too; without labels of both kinds every score
is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tesserae.llm.common import boxed, for_python, in_arrow, saved, unboxed

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ſ": "s",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Characters without width, which split words invisibly.
INVISIBLE = "­​‌‍⁠﻿"

FIT_ROWS = 20_000
#: A term is in the lexicon if so many toxic texts hold it and its odds are this much (log) above the rest, less two deviations.
LEAST_TEXTS, LEAST_ODDS = 8, 1.5
#: A phrase is an exception if so many clean texts hold it and at most this share of its texts is toxic.
LEAST_CLEAN, MOST_TOXIC = 8, 0.1
BEGINNINGS = (4, 5, 6)
#: Labelled rows up to which their labels are sent to all executors instead of dealing the texts by id.
BROADCAST_ROWS = 1_000_000

#: Terms that a task counts at a time before it passes them on.
MOST_COUNTED = 100_000

_FOLD = {ord(k): v for k, v in (LOOK_ALIKES | SUBSTITUTES).items()} | {ord(c): None for c in INVISIBLE}
_FOLD |= {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}  # full-width forms
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Words of folded letters between single spaces, a space at either end."""
    return f" {_OTHER.sub(' ', text.lower().translate(_FOLD)).strip()} "


_AUTOMATA: dict = {}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]  # " word " or " begin" to its weight
    exceptions: frozenset[str]  # " two words "
    curve: tuple[float, ...]

    @cached_property
    def key(self) -> int:
        return hash((*self.lexicon.items(), *sorted(self.exceptions)))

    def automaton(self):
        """Built once in a process, for the last model used there."""
        if self.key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[self.key] = self._built()
        return _AUTOMATA[self.key]

    def _built(self):
        import ahocorasick

        if not self.lexicon:
            return ()

        found = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            if phrase not in self.lexicon:
                found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def matches(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms that count: one a word, the heaviest, none in an exception."""
    found, free = {}, []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            free.append((start, end))
        elif start not in found or found[start][1] < weight:
            found[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in free)]


def features(folded: str, automaton) -> tuple[float, ...]:
    """What the curve sees: the sum of weights, and that sum for the text's length (logs of both)."""
    weights = [w for _, _, w in matches(folded, automaton)] if len(automaton) else []
    total, words = sum(weights), max(1, folded.count(" ") - 1)
    return (float(np.log1p(total)), float(np.log1p(100 * total / words)))


def _value(curve: tuple[float, ...], seen: tuple[float, ...]) -> float:
    return float(1 / (1 + np.exp(-np.clip(curve[0] + sum(a * b for a, b in zip(curve[1:], seen, strict=True)), -30, 30))))


def _summed(counter: Counter) -> pa.RecordBatch:
    """Counter of (term, toxic) as rows."""
    terms = {}
    for (term, toxic), n in counter.items():
        terms.setdefault(term, [0, 0])[toxic] += n
    return pa.RecordBatch.from_arrays([pa.array(list(terms)), pa.array([v[1] for v in terms.values()], pa.int64()), pa.array([v[0] for v in terms.values()], pa.int64())], names=["term", "toxic", "clean"])


def _counted(batches: Iterator[pa.RecordBatch], terms_of) -> Iterator[pa.RecordBatch]:
    counter: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counter.update((t, toxic) for t in terms_of(text.as_py()))
            if len(counter) > MOST_COUNTED:
                yield _summed(counter)
                counter = Counter()
    if counter:
        yield _summed(counter)


def _words_and_beginnings(folded: str) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    for size in BEGINNINGS:
        found |= {f" {w[:size]}" for w in words if len(w) > size}
    return found


def _counts(train: DataFrame, terms_of) -> DataFrame:
    rows = in_arrow(train.select("folded", "toxic"), lambda batches: _counted(batches, terms_of), "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _folded(docs: DataFrame) -> DataFrame:
    """(text, toxic, pick) to (folded, toxic, pick)."""

    def run(batches):
        for batch in batches:
            folded = pa.array([fold(t.as_py() or "") for t in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([folded, batch.column(1), batch.column(2)], names=["folded", "toxic", "pick"])

    return in_arrow(docs, run, "folded string, toxic int, pick long")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 5, is 0; rows without an id have no label and are in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _fit(seen: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's steps with a small ridge."""
    x = np.column_stack([np.ones(len(seen)), seen])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta)), x.T @ (toxic - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learn lexicon, exceptions and curve from the labelled rows that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")
    )
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")
    train = saved(_folded(joined.select("text", "toxic", F.xxhash64("id").alias("pick"))), "toxicity")
    rows = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = rows.get(1, 0), rows.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, frozenset(), (-30.0, 0.0, 0.0))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n_toxic + 1.0)) - F.log(b / (n_clean + 1.0))
    sure = odds - 2 * F.sqrt(1 / a + 1 / b)
    found = (
        _counts(train, _words_and_beginnings)
        .where(F.col("toxic") >= LEAST_TEXTS)
        .select("term", odds.alias("odds"), sure.alias("sure"))
        .where(F.col("sure") >= LEAST_ODDS)
        .collect()
    )
    lexicon = {r["term"]: float(r["sure"]) for r in sorted(found, key=lambda r: (-r["sure"], r["term"]))}
    # A longer term says nothing new where a beginning of it is as sure.
    lexicon = {t: w for t, w in lexicon.items() if not any(lexicon.get(t[:k], 0) >= w for k in range(5, len(t)) if t[:k] != t)}
    bare, exceptions = Model(lexicon, frozenset(), ()), frozenset()
    if lexicon:

        def phrases(folded: str) -> set[str]:
            got = set()
            for s, e, _ in matches(folded, bare.automaton()):
                end = folded.find(" ", s + 1)
                before, after = folded.rfind(" ", 0, s), folded.find(" ", end + 1)
                if s > 0:
                    got.add(folded[before : end + 1])
                if after > 0:
                    got.add(folded[s : after + 1])
            return got

        exceptions = frozenset(
            r["term"]
            for r in _counts(train, phrases)
            .where((F.col("clean") >= LEAST_CLEAN) & (F.col("toxic") <= MOST_TOXIC * (F.col("toxic") + F.col("clean"))))
            .collect()
        )
    model = Model(lexicon, exceptions, ())

    def seen(batches):
        for batch in batches:
            rows = [features(t.as_py(), model.automaton()) for t in batch.column(0)]
            arrays = [pa.array([r[k] for r in rows], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(1)], names=["a", "b", "toxic"])

    part = min(1.0, fit_rows / (n_toxic + n_clean))
    sample = train.where(F.pmod("pick", F.lit(1 << 20)) < part * (1 << 20)).select("folded", "toxic")
    fitted = in_arrow(sample, seen, "a double, b double, toxic int").toPandas()
    return Model(lexicon, exceptions, _fit(fitted[["a", "b"]].to_numpy(float), fitted["toxic"].to_numpy(float)))


def scored(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1."""

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        automaton = model.automaton()
        return pa.array([_value(model.curve, features(fold(t.as_py() or ""), automaton)) for t in texts], pa.float64())

    return run(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score as ``name``, in the place of a column of that name."""
    for_python(docs.sparkSession)
    return docs.withColumn(name, scored(model, F.col(f"`{text_col}`")))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``; all their columns are as they were."""
    model = learn(docs, labels, text_col=text_col)
    for_python(docs.sparkSession)
    return unboxed(boxed(docs).where(scored(model, F.col(f"doc.`{text_col}`")) < least), docs.columns)
