"""Centres of groups: segments and hash aggregates give one result, checked against plain searches."""

import math

import numpy as np
import pytest

from pointmill.operators import fit, medians


def cloud(spark, seed=1, extra=()):
    rng = np.random.default_rng(seed)
    rows = [("a", *p) for p in rng.normal(size=(60, 3)).tolist()] + [("b", *p) for p in (rng.normal(size=(40, 3)) * [5, 0.1, 0.01]).tolist()]
    rows += [("c", 1.0, 2.0, 3.0)] * 7 + [("d", float(i), 0.0, 0.0) for i in range(5)] + [(None, *p) for p in rng.normal(size=(20, 3)).tolist()] + list(extra)
    return spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(3), rows


def by_key(found, *keys):
    return {tuple(r[k] for k in keys): np.array([r["x"], r["y"], r["z"]]) for r in found.collect()}


def members(rows, key):
    return np.array([r[1:] for r in rows if r[0] == key and all(v is not None and not math.isnan(v) for v in r[1:])])


def test_l1_median_in_segments_and_aggregates(spark):
    nan = float("nan")
    df, rows = cloud(spark, extra=[("a", nan, 0.0, 0.0), ("a", None, 0.0, 0.0), ("e", nan, nan, nan)])
    small, large, mixed = (by_key(fit.l1_median(df, "g", bounded=b), "g") for b in (4096, 0, 30))
    assert set(small) == set(large) == set(mixed) == {("a",), ("b",), ("c",), ("d",), (None,)}
    for key, at in small.items():
        p = members(rows, key[0])
        cost = lambda c: np.sqrt(((p - c) ** 2).sum(axis=1)).sum()  # noqa: B023, E731
        assert np.allclose(at, large[key], atol=1e-9) and np.allclose(at, mixed[key], atol=1e-9)
        assert all(cost(at) <= cost(at + d) + 1e-9 for d in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-4)


def test_unsettled_medians_raise(spark):
    df, _ = cloud(spark)
    for bounded in (4096, 0):
        with pytest.raises(Exception, match="did not settle"):
            fit.l1_median(df, "g", rounds=1, bounded=bounded).collect()


def test_many_groups_at_once(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g), *p) for g, p in zip(rng.integers(0, 6000, 20_000), rng.normal(size=(20_000, 3)).tolist(), strict=True)]
    found = by_key(fit.l1_median(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g"), "g")
    assert len(found) == len({r[0] for r in rows})
    for g in range(0, 6000, 500):
        p = np.array([r[1:] for r in rows if r[0] == g])
        if len(p) > 2:
            pull = p - found[(g,)]
            d = np.sqrt((pull**2).sum(axis=1))
            here = d < 1e-12
            assert np.linalg.norm((pull[~here] / d[~here, None]).sum(axis=0)) <= here.sum() + 1e-6


@pytest.mark.parametrize("name", ["lvp_median", "weighted_local_median"])
def test_descent_ends_where_no_step_is_better(spark, name):
    df, rows = cloud(spark)
    value = {
        "lvp_median": lambda d: d.sum() + 30 * ((d - d.mean()) ** 2).sum(),
        "weighted_local_median": lambda d: (d * np.exp(-100 * d * d)).sum(),
    }[name]
    small, large = by_key(getattr(fit, name)(df, "g"), "g"), by_key(getattr(fit, name)(df, "g", bounded=30), "g")
    for key, at in small.items():
        p = members(rows, key[0])
        cost = lambda c: value(np.maximum(np.sqrt(((p - c) ** 2).sum(axis=1)), 1e-12))  # noqa: B023, E731
        assert np.allclose(at, large[key], atol=1e-5)
        low, high = p.min(axis=0), p.max(axis=0)
        assert cost(at) <= cost(p.mean(axis=0)) + 1e-12
        # The five points of d are symmetric about their mean: no way down is preferred there.
        for step in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-3 if key != ("d",) else ():
            assert cost(at) <= cost(np.clip(at + step, low, high)) + 1e-7


def test_gradients_and_curvatures_are_those_of_the_cost():
    rng = np.random.default_rng(3)
    p, c = rng.normal(size=(30, 3)), np.array([0.2, -0.1, 0.3])
    for cost in (medians.variance_penalty(3.0), medians.local_weight(0.5)):
        def facts(at):
            off = at - p
            d = np.sqrt((off * off).sum(axis=1))
            return np.array(cost.facts([np.sum(t, axis=0) for t in cost.terms(d, [off[:, i] / d for i in range(3)], np.exp)]))  # noqa: B023

        h = 1e-5
        ways = np.eye(3) * h
        slope = [(facts(c + w)[0] - facts(c - w)[0]) / (2 * h) for w in ways]
        bend = [(facts(c + w)[1:4] - facts(c - w)[1:4]) / (2 * h) for w in ways]
        got = facts(c)
        assert np.allclose(got[1:4], slope, rtol=1e-5, atol=1e-6)
        assert np.allclose(got[4:], [bend[i][j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))], rtol=1e-4, atol=1e-5)


def test_joint_centres_and_places_in_order(spark):
    df, rows = cloud(spark)
    placed = medians.in_order(medians.valid(df), "g").collect()
    for key in ("a", "b", "d", None):
        own = sorted((r["place"], (r["x"], r["y"], r["z"]), r["n"]) for r in placed if r["g"] == key)
        want = sorted(tuple(r[1:]) for r in rows if r[0] == key)
        assert [p for p, _, _ in own] == list(range(len(want))) and [x for _, x, _ in own] == want and {n for *_, n in own} == {len(want)}
    small, large = by_key(fit.joint_centres(df, "g", 3), "g", "centre"), by_key(fit.joint_centres(df, "g", 3, bounded=30), "g", "centre")
    assert set(small) == set(large) == {(g, c) for g in ("a", "b", "c", "d", None) for c in range(3)}
    assert all(np.allclose(v, large[k], atol=1e-5) for k, v in small.items())
