"""The trainer against a plain numpy run, its schedule, its start from another model, and the prediction files."""

import hashlib

import numpy as np
import pytest

from loomgraph.operators import trainer as TR

ROWS = "k int, features array<int>, label int"


def some_rows(n, seed, features=40, classes=3):
    rng = np.random.default_rng(seed)
    truth = np.random.default_rng(99).normal(size=(features, classes)) * 2  # the same task whatever the seed
    rows = []
    for k in range(n):
        own = rng.choice(features, rng.integers(0, 8)).tolist()
        rows.append((k, own, int(truth[own].sum(0).argmax()) if own else 0))
    return rows


def plain_fit(rows, settings, start=None):
    """One row at a time, batches in the order of the digests."""
    rows = sorted((r for r in rows if r[2] is not None and 0 <= r[2] < settings.classes and r[1] is not None), key=lambda r: (hashlib.md5(f"{settings.seed}:{r[0]}".encode()).hexdigest(), r[0]))
    batches = [rows[i : i + settings.batch] for i in range(0, len(rows), settings.batch)]
    w = np.zeros((settings.features + 1, settings.classes)) if start is None else start.copy()
    m, v, step, steps, log = np.zeros_like(w), np.zeros_like(w), 0, settings.epochs * len(batches), []
    for epoch in range(settings.epochs):
        for batch in batches:
            g, loss = np.zeros_like(w), 0.0
            for _, own, y in batch:
                x = np.zeros(len(w))
                for f in [*own, settings.features]:
                    x[f] += 1
                s = x @ w
                p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
                loss -= np.log(p[y])
                g += np.outer(x, p - np.eye(settings.classes)[y]) / len(batch)
            share = step / settings.warmup if step < settings.warmup else (steps - step) / (steps - settings.warmup)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            for group in settings.groups:
                a, b = group.rows
                w[a:b] = (w[a:b] - group.rate * share * m[a:b] / (np.sqrt(v[a:b]) + 1e-6)) * (1 - group.rate * share * group.decay)
            log.append((epoch, step, loss / len(batch)))
            step += 1
    return w, log


SETTINGS = TR.Settings(features=40, classes=3, epochs=2, batch=64, warmup=3, seed=7, groups=[TR.Group((0, 30), 0.1, 0.01), TR.Group((30, 40), 0.02, 0.5), TR.Group((40, 41), 0.05)])


@pytest.mark.parametrize("parts", [1, 40])
def test_equals_a_plain_run(spark, parts, monkeypatch):
    monkeypatch.setattr(TR, "FAN_IN", 2)
    rows = [*some_rows(200, 1), (900, [1, 2], None), (901, None, 1), (902, [3], 7)]
    start = np.random.default_rng(3).normal(size=(41, 3))
    for first in (None, start):
        weights, log = TR.fit(spark.createDataFrame(rows, ROWS).repartition(parts), ["k"], SETTINGS, first)
        want, steps = plain_fit(rows, SETTINGS, first)
        assert np.allclose(weights, want, atol=1e-10) and [x[:2] for x in log] == [x[:2] for x in steps]
        assert np.allclose([x[2] for x in log], [x[2] for x in steps])
    again, _ = TR.fit(spark.createDataFrame(rows, ROWS).repartition(3), ["k"], SETTINGS, start)
    assert np.allclose(again, weights, atol=1e-12)


def test_sums_meet_in_a_tree(spark, monkeypatch):
    rows = spark.createDataFrame(some_rows(300, 2), ROWS).repartition(30)
    w = np.random.default_rng(0).normal(size=(41, 3))
    found = []
    for fan in (2, 100):
        monkeypatch.setattr(TR, "FAN_IN", fan)
        found.append(TR._total(rows, w))
    assert found[0][0] == found[1][0] == 300 and np.isclose(found[0][1], found[1][1]) and np.allclose(found[0][2], found[1][2])


def test_warm_up_and_decay():
    assert [TR.share_of_rate(k, 4, 10) for k in (0, 2, 4, 7, 10, 12)] == [0, 0.5, 1, 0.5, 0, 0]
    assert TR.share_of_rate(0, 0, 5) == 1


def test_a_start_from_another_model_is_ahead(spark, tmp_path):
    settings = TR.Settings(features=40, classes=3, epochs=1, batch=200, warmup=1, seed=1, groups=[TR.Group((0, 41), 0.2)])
    long = TR.Settings(features=40, classes=3, epochs=25, batch=400, warmup=2, seed=1, groups=[TR.Group((0, 41), 0.2)])
    source, _ = TR.fit(spark.createDataFrame(some_rows(800, 4), ROWS), ["k"], long)
    start = TR.load(spark, TR.save(spark, source, str(tmp_path / "weights")))
    assert np.array_equal(start, source)
    target, test = spark.createDataFrame(some_rows(400, 5), ROWS), spark.createDataFrame(some_rows(300, 6), ROWS)
    right = lambda w: TR.predict(test, w).where("label = y_pred").count() / 300
    cold, warm = (right(TR.fit(target, ["k"], settings, s)[0]) for s in (None, start))
    assert warm > cold and warm > 0.85


def test_empty_tables_and_null_features(spark):
    empty = spark.createDataFrame([], ROWS)
    weights, log = TR.fit(empty, ["k"], SETTINGS)
    assert not weights.any() and log == []
    rows = spark.createDataFrame([(1, None, 0), (2, [], 0), (3, [5, 5], 1)], ROWS)
    w = np.zeros((41, 3))
    w[5, 2], w[40, 1] = 1.0, 0.5
    assert [(r.k, r.y_pred) for r in TR.predict(rows, w).orderBy("k").collect()] == [(1, 1), (2, 1), (3, 2)]
    assert TR.predict(empty, w).count() == 0
    with pytest.raises(ValueError, match="starting matrix"):
        TR.fit(empty, ["k"], SETTINGS, np.zeros((2, 2)))
