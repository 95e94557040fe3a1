"""Similar names, skylines and the choice of a candidate against plain versions."""

import itertools
import random

import numpy as np
import pytest

from loomgraph.functions import similar as N
from loomgraph.operators import candidates as C


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_substring(a, b):
    return max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)


NAMES = ["", "a", "abc", "cab", "über", "Über", "𝔘ber", "阿尔巴·奥克曼", "奥克曼", "aaaa", "aaab", "baaa", "x" * 40, "zz top", "tip zoo"]


def test_distances_of_many_pairs():
    pairs = list(itertools.product(NAMES, NAMES))
    a, la = N.code_points([p[0] for p in pairs], -1)
    b, lb = N.code_points([p[1] for p in pairs], -2)
    distance, longest = N.distance_and_substring(a, la, b, lb)
    assert distance.tolist() == [plain_distance(*p) for p in pairs]
    assert longest.tolist() == [plain_substring(*p) for p in pairs]
    most = N.shared_at_most(N.class_counts(*N.code_points(NAMES, -1)), N.class_counts(*N.code_points(NAMES, -2))).ravel()
    assert (most >= longest).all() and (most >= np.maximum(la, lb) - distance).all()


@pytest.mark.parametrize("block", [20_000, 4])
@pytest.mark.parametrize(("least", "substring"), [(0.4, True), (0.1, True), (0.4, False)])
def test_no_similar_pair_is_lost(spark, block, least, substring, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(5)
    names = [*NAMES, *("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(60))]
    left = spark.createDataFrame([(n,) for n in [*names, names[3], None]], "name string")
    got = {(r.l, r.r): (r.distance, r.lcs, r.like) for r in C.similar_pairs(left, left, least, substring).collect()}
    want = {}
    for a, b in itertools.product(set(names), set(names)):
        d, lcs, m, n = plain_distance(a, b), plain_substring(a, b), max(len(a), len(b), 1), max(len(a) + len(b), 1)
        like = ((m - d) * n + lcs * m) / (m * n) if substring else 1 - d / m
        if like > least:
            want[a, b] = (d, lcs, like)
    assert got == want


@pytest.mark.parametrize("parts", [1, 7])
def test_skyline_equals_all_comparisons(spark, parts):
    rng = random.Random(2)
    rows = [(k, rng.choice(["g", "big", "big", "big", None]), rng.randrange(6), rng.choice([None, *range(6)]), float(rng.randrange(4))) for k in range(400)]
    rows += [(900, "alone", 1, None, None), (901, "tie", 1, 1, 1.0), (902, "tie", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, grp string, a int, b int, c double").repartition(parts)

    def beaten(x, y):
        p, q = x[2:], y[2:]
        return x[1] == y[1] and None not in p + q and all(v >= u for u, v in zip(p, q, strict=True)) and p != q

    want = {x[0] for x in rows if not any(beaten(x, y) for y in rows)}
    got = C.skyline(df, ["grp"], ["a", "b", "c"])
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(want)
    assert C.skyline(df.limit(0), ["grp"], ["a", "b", "c"]).count() == 0


def test_local_skylines_go_before_the_exchange(spark):
    plan = C.skyline(spark.range(100).selectExpr("id", "id % 3 g", "id % 7 a"), ["g"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")


def test_all_three_steps_of_the_choice(spark):
    rows = [
        ("clear", "x", 9, 9, 9), ("clear", "y", 8, 8, 8),  # x leads everywhere
        ("pair", "x", 9, 1, 8), ("pair", "y", 1, 9, 1), ("pair", "z", 8, 2, 9), ("pair", "w", 7, 8, 7),  # of all three none alone, by two none
        ("two", "x", 9, 1, 9), ("two", "y", 1, 9, 1), ("two", "z", 5, 5, 5), ("two", "w", 1, 8, 8),
        ("last", "x", 3, 1, 1), ("last", "y", 3, 1, 1), ("single", "x", 0, 0, 0),
    ]
    df = spark.createDataFrame(rows, "grp string, e string, a int, b int, c int")
    got = {r.grp: (r.e, r.step) for r in C.lower_bound(df, ["grp"], ["a", "b", "c"], ["a", "c"], "a", "e").collect()}

    def plain(members):
        rank = lambda m, k: 1 + sum(o[k] > m[k] for o in members)
        for step, columns in (("three", (2, 3, 4)), ("two", (2, 4))):
            for k in range(1, len(members) + 1):
                inside = [m for m in members if all(rank(m, c) <= k for c in columns)]
                if inside:
                    break
            if len(inside) == 1:
                return inside[0][1], step
        return min(members, key=lambda m: (-m[2], m[1]))[1], "one"

    assert got == {g: plain([r for r in rows if r[0] == g]) for g in {r[0] for r in rows}}
    assert {step for _, step in got.values()} == {"three", "two", "one"}
