"""Training of the attention model over bags of tile vectors, and what is judged of a trained one.

A bag is never gathered: a task sends the sums of its tiles (of exp(score) and of exp(score) times the
encoded vector), which are added up per bag. From these the driver gets each bag's loss and what it asks
of its pooled vector; a second pass turns that into sums of gradients of the model's size. A step's bags
(``per_step``, one as in plain stochastic descent, or more) are the only rows that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import metrics
from tesserae.operators.bags import xavier
from tesserae.operators.splits import balanced_weights
from tesserae.session import ship

Weights = dict[str, np.ndarray]
#: Epochs without a better validation loss, and the epoch before which training never stops.
PATIENCE, NOT_BEFORE = 20, 50
RATE, DECAY, EPOCHS = 2e-4, 1e-5, 200


def new_model(width: int, first: int, second: int, hidden: int, classes: int, seed: int = 0) -> Weights:
    """Normal weights by the size of each layer, biases of zero."""
    shapes = {"fc1": (first, width), "fc2": (second, first), "a": (hidden, second), "b": (hidden, second), "c": (1, hidden), "out": (classes, second + 1)}
    found = {name: xavier(*shape, seed + k) for k, (name, shape) in enumerate(shapes.items())}
    return found | {f"{name}_bias": np.zeros(shape[0]) for name, shape in shapes.items()}


@dataclass
class _Layers:
    """What the tiles of a batch give on the way up."""

    x: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    score: np.ndarray


def _up(w: Weights, x: np.ndarray) -> _Layers:
    h1 = np.maximum(x @ w["fc1"].T + w["fc1_bias"], 0)
    h2 = np.maximum(h1 @ w["fc2"].T + w["fc2_bias"], 0)
    tanh = np.tanh(h2 @ w["a"].T + w["a_bias"])
    gate = 1 / (1 + np.exp(-(h2 @ w["b"].T + w["b_bias"])))
    return _Layers(x, h1, h2, tanh, gate, (tanh * gate) @ w["c"][0] + w["c_bias"][0])


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _sums(w: Weights):
    """(bag, k, value): per bag the sum of exp(score) at 0 and of its products with the encoded vector after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            up = _up(w, _vectors(batch))
            bags, of = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            sums = np.zeros((len(bags), up.h2.shape[1] + 1))
            np.add.at(sums, of, np.exp(up.score)[:, None] * np.hstack([np.ones((len(of), 1)), up.h2]))
            at = np.tile(np.arange(sums.shape[1], dtype=np.int32), len(bags))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bags, sums.shape[1]), pa.int64()), pa.array(at), pa.array(sums.ravel())], names=["bag", "k", "value"])

    return run


def pooled(tiles: DataFrame, w: Weights) -> DataFrame:
    """(bag, total, pooled) of tiles (bag, vector)."""
    ship(tiles.sparkSession)
    sums = tiles.select(F.col("bag").cast("long"), "vector").mapInArrow(_sums(w), "bag long, k int, value double").groupBy("bag", "k").agg(F.sum("value").alias("value"))
    listed = sums.groupBy("bag").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("all"))
    total = F.get("all", F.lit(0))
    return listed.select("bag", total.alias("total"), F.transform(F.slice("all", 2, w["fc2"].shape[0]), lambda x: x / total).alias("pooled"))


def _classified(w: Weights, m: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the classifier's input."""
    z = np.hstack([m, extra[:, None]])
    logits = z @ w["out"].T + w["out_bias"]
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True), z


def predict(tiles: DataFrame, bags: DataFrame, w: Weights) -> DataFrame:
    """(bag, label, probs, predicted, loss) of bags (bag, label, extra): a single bag or any number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                probs, _ = _classified(w, np.array(batch.column(2).to_pylist(), float), batch.column(3).to_numpy(zero_copy_only=False).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(probs), pa.list_(pa.float64()))], names=["bag", "label", "probs"])

    known = bags.select(F.col("bag").cast("long"), F.col("label").cast("int"), F.coalesce(F.col("extra").cast("double"), F.lit(0.0)).alias("extra"))
    rows = known.join(pooled(tiles, w), "bag").select("bag", "label", "pooled", "extra").mapInArrow(run, "bag long, label int, probs array<double>")
    return rows.select("*", metrics.argmax(F.col("probs")).alias("predicted"), metrics.cross_entropy(F.col("probs"), F.col("label")).alias("loss"))


def validate(predictions: DataFrame) -> DataFrame:
    """One row: bags, mean loss, error, and the mean of the classes' AUC (-1 with one class alone)."""
    error = 1 - F.avg((F.col("predicted") == F.col("label")).cast("int"))
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), error.alias("error")).select("*", metrics.macro_auc(predictions, "probs", "label").scalar().alias("auc"))


def gradients(tiles: DataFrame, bags: DataFrame, w: Weights, class_weights: dict[int, float] | None = None) -> tuple[Weights, float]:
    """The mean gradient and loss over ``bags``, which the driver holds: a step's worth of them."""
    known = bags.select(F.col("bag").cast("long"), F.col("label").cast("int"), F.coalesce(F.col("extra").cast("double"), F.lit(0.0)).alias("extra"))
    rows = known.join(pooled(tiles, w), "bag").orderBy("bag").collect()
    if not rows:
        return {k: np.zeros_like(v) for k, v in w.items()}, 0.0
    m, labels = np.array([r["pooled"] for r in rows]), np.array([r["label"] for r in rows])
    probs, z = _classified(w, m, np.array([r["extra"] for r in rows]))
    share = np.array([(class_weights or {}).get(int(y), 1.0) for y in labels]) / len(rows)
    own = probs[np.arange(len(rows)), labels]
    delta = probs.copy()
    delta[np.arange(len(rows)), labels] -= 1
    delta *= share[:, None]
    found = {"out": delta.T @ z, "out_bias": delta.sum(axis=0)}
    asked = delta @ w["out"][:, : m.shape[1]]  # of each pooled vector
    at = {r["bag"]: k for k, r in enumerate(rows)}
    below = {k: v for k, v in w.items() if not k.startswith("out")}
    sizes = {k: v.size for k, v in below.items()}
    totals = np.array([r["total"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(sum(sizes.values()))
        for batch in batches:
            if batch.num_rows:
                sums += _down(below, batch, at, m, totals, asked)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["k", "value"])

    step = tiles.select(F.col("bag").cast("long"), "vector").where(F.col("bag").isin([r["bag"] for r in rows]))
    summed = step.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").toPandas()["value"].to_numpy()
    start = 0
    for name, size in sizes.items():
        found[name] = summed[start : start + size].reshape(w[name].shape)
        start += size
    return found, float(-(np.log(own) * share).sum())


def _down(w: Weights, batch: pa.RecordBatch, at: dict[int, int], m: np.ndarray, totals: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """A batch's share of the gradient of all layers below the pooled vector."""
    bag = np.array([at[b] for b in batch.column(0).to_pylist()])
    up = _up(w, _vectors(batch))
    alpha = (np.exp(up.score) / totals[bag])[:, None]
    want = asked[bag]
    by_score = alpha * (want * (up.h2 - m[bag])).sum(axis=1, keepdims=True)
    by_gated = by_score * w["c"]
    by_a = by_gated * up.gate * (1 - up.tanh**2)
    by_b = by_gated * up.tanh * up.gate * (1 - up.gate)
    by_h2 = (alpha * want + by_a @ w["a"] + by_b @ w["b"]) * (up.h2 > 0)
    by_h1 = (by_h2 @ w["fc2"]) * (up.h1 > 0)
    grads = {
        "fc1": by_h1.T @ up.x, "fc1_bias": by_h1.sum(axis=0), "fc2": by_h2.T @ up.h1, "fc2_bias": by_h2.sum(axis=0),
        "a": by_a.T @ up.h2, "a_bias": by_a.sum(axis=0), "b": by_b.T @ up.h2, "b_bias": by_b.sum(axis=0),
        "c": (by_score.T @ (up.tanh * up.gate)), "c_bias": by_score.sum(axis=0),
    }
    return np.concatenate([grads[k].ravel() for k in w])


@dataclass
class Optimiser:
    """Adam, or descent with momentum 0.9; weight decay is added to the gradient."""

    rate: float = RATE
    decay: float = DECAY
    adam: bool = True
    steps: int = 0
    m: Weights = field(default_factory=dict)
    v: Weights = field(default_factory=dict)

    def step(self, w: Weights, gradient: Weights) -> Weights:
        self.steps += 1
        out = {}
        for k, old in w.items():
            g = gradient[k] + self.decay * old
            m, v = self.m.get(k, 0.0), self.v.get(k, 0.0)
            if self.adam:
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                move = (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
            else:
                m = move = 0.9 * m + g
            self.m[k], self.v[k], out[k] = m, v, old - self.rate * move
        return out


@dataclass
class Stopper:
    """Keeps the weights of the lowest validation loss; says when to stop."""

    patience: int = PATIENCE
    not_before: int = NOT_BEFORE
    best: float = float("inf")
    waited: int = 0
    weights: Weights | None = None

    def stop(self, epoch: int, loss: float, w: Weights) -> bool:
        if loss < self.best:
            self.best, self.waited, self.weights = loss, 0, w
            return False
        self.waited += 1
        return self.waited >= self.patience and epoch > self.not_before


def train_epoch(tiles: DataFrame, bags: DataFrame, w: Weights, optimiser: Optimiser, epoch: int, per_step: int = 1, class_weights: dict[int, float] | None = None) -> tuple[Weights, float]:
    """One pass over the bags in an order of its own, ``per_step`` bags a step: weights and mean loss."""
    listed = [r["bag"] for r in bags.select("bag").orderBy(F.xxhash64("bag", F.lit(epoch)), "bag").toLocalIterator()]
    losses = []
    for k in range(0, len(listed), per_step):
        some = listed[k : k + per_step]
        gradient, loss = gradients(tiles.where(F.col("bag").isin(some)), bags.where(F.col("bag").isin(some)), w, class_weights)
        w = optimiser.step(w, gradient)
        losses.append(loss * len(some))
    return w, sum(losses) / max(1, len(listed))


@dataclass
class Trained:
    weights: Weights
    history: list[tuple[int, float, float, float]]  # epoch, loss in training, loss and error in validation


def train_fold(tiles: DataFrame, bags: DataFrame, w: Weights, epochs: int = EPOCHS, per_step: int = 1, optimiser: Optimiser | None = None, stopper: Stopper | None = None, weighted: bool = False) -> Trained:
    """Train on the bags of split ``train``, validate on ``val`` after every epoch, keep the best weights.

    ``tiles``: (bag, vector); ``bags``: (bag, label, extra, split). ``weighted``: losses by balanced class weights."""
    optimiser, stopper = optimiser or Optimiser(), stopper or Stopper()
    train, val = (bags.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    shares = {r["label"]: float(r["weight"]) for r in balanced_weights(train, "label").collect()} if weighted else None
    mine = tiles.join(F.broadcast(train.select("bag")) if train.limit(100_001).count() <= 100_000 else train.select("bag"), "bag", "left_semi")
    history = []
    for epoch in range(epochs):
        w, loss = train_epoch(mine, train, w, optimiser, epoch, per_step, shares)
        found = predict(tiles, val, w).agg(F.avg("loss").alias("loss"), (1 - F.avg((F.col("predicted") == F.col("label")).cast("int"))).alias("error")).first()
        history.append((epoch, loss, found["loss"], found["error"]))
        if stopper.stop(epoch, found["loss"] if found["loss"] is not None else loss, w):
            break
    return Trained(stopper.weights or w, history)


def summary(tiles: DataFrame, bags: DataFrame, w: Weights) -> tuple[DataFrame, DataFrame]:
    """Predictions of ``bags`` (with ``split``), and (split, n, loss, error) of each split."""
    found = predict(tiles, bags, w).join(bags.select(F.col("bag").cast("long"), "split"), "bag")
    return found, found.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), (1 - F.avg((F.col("predicted") == F.col("label")).cast("int"))).alias("error"))


def infer(tiles: DataFrame, extra: DataFrame, w: Weights, names: list[str]) -> DataFrame:
    """(bag, payload) for bags without a label: JSON with the class and all probabilities, the highest first."""
    rows = predict(tiles, extra.select("bag", F.lit(0).alias("label"), "extra"), w)
    listed = F.array(*(F.lit(n) for n in names))
    each = F.transform("probs", lambda p, k: F.struct((-p).alias("order"), k.alias("class"), F.get(listed, k).alias("name"), p.alias("probability")))
    ranked = F.transform(F.sort_array(each), lambda x: F.struct(x["class"].alias("class"), x["name"].alias("name"), x["probability"].alias("probability")))
    return rows.select("bag", F.to_json(F.struct(F.get(listed, F.col("predicted")).alias("predicted"), ranked.alias("ranked"))).alias("payload"))


def run_folds(tiles: DataFrame, slides: DataFrame, split: DataFrame, folds: int, sizes: tuple[int, int, int], classes: int, seed: int = 0, epochs: int = EPOCHS, per_step: int = 1) -> DataFrame:
    """Train and judge fold after fold: (fold, split, n, loss, error). ``slides``: (bag, label, extra);
    ``split``: (fold, bag, split) as drawn by patient."""
    width = tiles.select(F.size("vector").alias("n")).first()["n"]
    rows = []
    for fold in range(folds):
        bags = slides.join(split.where(F.col("fold") == fold).select("bag", "split"), "bag")
        trained = train_fold(tiles, bags, new_model(width, *sizes, classes, seed + fold), epochs, per_step)
        rows.append(summary(tiles, bags, trained.weights)[1].select(F.lit(fold).alias("fold"), "split", "n", "loss", "error"))
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    return found
