"""Training against numeric gradients and plain forward passes."""

import numpy as np
import pytest

from tesserae.operators import training


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    rows = [(b, rng.normal(b % 2, 1, 5).tolist()) for b in range(6) for _ in range(1 + b)]
    tiles = spark.createDataFrame(rows, "bag long, vector array<double>").repartition(3).cache()
    bags = spark.createDataFrame([(b, b % 2, float(b % 3), "val" if b > 3 else "train") for b in range(6)], "bag long, label int, extra double, split string")
    return rows, tiles, bags


def loss_of(w, rows, labels, extra):
    total = 0.0
    for bag, y in labels.items():
        up = training._up(w, np.array([v for b, v in rows if b == bag]))
        e = np.exp(up.score)
        probs, _ = training._classified(w, (e @ up.h2 / e.sum())[None, :], np.array([extra[bag]]))
        total -= np.log(probs[0, y])
    return total / len(labels)


def test_gradients_equal_numeric_ones(small):
    rows, tiles, bags = small
    w = {k: v + 0.05 for k, v in training.new_model(5, 4, 3, 2, 2, seed=1).items()}
    found, loss = training.gradients(tiles, bags, w)
    labels, extra = {b: b % 2 for b in range(6)}, {b: b % 3 for b in range(6)}
    assert loss == pytest.approx(loss_of(w, rows, labels, extra))
    for name, value in w.items():
        for at in list(np.ndindex(value.shape))[:4]:
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert found[name][at] == pytest.approx((loss_of(up, rows, labels, extra) - loss_of(down, rows, labels, extra)) / 2e-6, abs=1e-6), name


def test_training_learns_and_stops(small):
    _, tiles, bags = small
    w = training.new_model(5, 4, 3, 2, 2, seed=1)
    found = training.train_fold(tiles, bags, w, epochs=5, per_step=2, optimiser=training.Optimiser(rate=0.05), weighted=True)
    assert len(found.history) == 5 and found.history[-1][1] < found.history[0][1]
    predictions, judged = training.summary(tiles, bags, found.weights)
    assert predictions.count() == 6 and {r.split: r.n for r in judged.collect()} == {"train": 4, "val": 2}
    assert min(h[2] for h in found.history) == pytest.approx({r.split: r.loss for r in judged.collect()}["val"])


def test_stopper_waits_and_keeps_the_best():
    stopper = training.Stopper(patience=2, not_before=3)
    said = [stopper.stop(k, loss, {"at": k}) for k, loss in enumerate([3.0, 2.0, 2.5, 2.4, 2.6])]
    assert said == [False, False, False, False, True] and stopper.weights == {"at": 1} and stopper.best == 2.0


def test_momentum():
    plain, w = training.Optimiser(rate=0.1, decay=0.0, adam=False), {"x": np.zeros(1)}
    for want in (-0.1, -0.29, -0.561):
        w = plain.step(w, {"x": np.ones(1)})
        assert w["x"][0] == pytest.approx(want)
