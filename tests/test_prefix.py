"""Clipping by running sums against clipping value by value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import prefix, sigma
from chronofold.operators.stack import finished
from chronofold.spec import StackSpec


def brute(values, spec):
    """(n, s, q, passes) of one key's values."""
    kept, passes = list(values), []
    for _ in range(spec.max_iter):
        n, s, q = len(kept), sum(kept), sum(x * x for x in kept)
        lo = hi = 0
        if n > 1:
            var = (float(q) - float(s) * float(s) / n) / (n - 1)
            if var >= 0:
                mean, dev = float(np.rint(s / n)), math.sqrt(var)
                lo, hi = max(0, math.ceil(mean - dev * spec.rej_low)), max(0, math.floor(mean + dev * spec.rej_high))
        if spec.top is not None:
            lo, hi = min(lo, spec.top), min(hi, spec.top)
        kept = [x for x in values if lo <= x <= hi] or list(values)
        passes.append(len(kept))
    return len(kept), sum(kept), sum(x * x for x in kept), passes


def cases():
    r = np.random.default_rng(3)
    found = {("a", i): [int(x) for x in np.concatenate([r.normal(500, 40, r.integers(1, 60)), r.integers(0, 5000, r.integers(0, 6))]).clip(0)] for i in range(60)}
    found["flat", 0], found["one", 0], found["two", 0], found["zero", 0] = [7] * 50, [9], [1, 100000], [0] * 20
    found["low", 0], found[None, 0], found["a", None] = [-5, -6, -7, 3, 3], [1, 2, 3, 400], [5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 900]
    found["long", 0], found[None, 7] = ([int(x) for x in r.integers(0, 30000, 20000)] for _ in range(2))
    return found


@pytest.fixture(scope="module")
def px(spark):
    rows = [(k, j, v) for (k, j), values in cases().items() for v in values]
    return spark.createDataFrame([*rows, ("a", 1, None), ("none", 0, None)], "k string, j int, v long").repartition(5)


@pytest.mark.parametrize("spec", [StackSpec("sigmaclip-mean", ("k", "j")), StackSpec("sigmaclip-mean", ("k", "j"), rej_high=1.5, rej_low=2.5, max_iter=9), StackSpec("sigmaclip-mean", ("k", "j"), max_iter=1, in_bits=8)], ids=["three", "narrow", "top"])
@pytest.mark.parametrize(("held", "run", "piece"), [(1 << 20, 1 << 18, 4096), (1 << 20, 64, 4096), (40, 64, 7)], ids=["one stage", "small runs", "ranges"])
def test_same_as_value_by_value(px, monkeypatch, spec, held, run, piece):
    monkeypatch.setattr(prefix, "HELD_VALUES", held)
    monkeypatch.setattr(prefix, "RUN", run)
    monkeypatch.setattr(prefix, "RANGE", piece)
    found = sigma.clip(px, spec).collect()
    assert len(found) == len(cases())
    for r in found:
        values = cases()[r["k"], r["j"]]
        assert (r["n"], r["s"], r["q"], list(r["passes"])) == brute(values, spec)
        assert (r["fn"], r["fs"], r["fq"], r["most"]) == (len(values), sum(values), sum(x * x for x in values), max(values))


def test_wide_sums_give_the_same(px):
    plain, wide = (sigma.sigma_stack(px, StackSpec("sigmaclip-mean", ("k", "j"), wide=w)) for w in (False, True))
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, wide.collect()), key=repr)


def test_sums_beyond_64_bits_are_an_error_unless_wide(spark):
    big = spark.createDataFrame([("a", 4_000_000_000 + i) for i in range(5)], "k string, v long")
    with pytest.raises(Exception, match="64 bits"):
        sigma.clip(big, StackSpec("sigmaclip-mean")).collect()
    assert finished(sigma.clip(big, StackSpec("sigmaclip-mean", wide=True)).select("k", *"nsq"), ("k",)).first()["mu"] == 4_000_000_002


def test_no_rows_and_all_passes_in_one_stage(px):
    spec = StackSpec("sigmaclip-mean", ("k", "j"))
    assert sigma.clip(px.limit(0), spec).collect() == []
    plan = prefix.by_prefix(sigma.counted(px, spec), spec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInArrow") == 1  # counts by value, then keys; no join
    assert sigma.clip(px.where("false"), StackSpec("sigmaclip-mean", ())).collect() == []
    one = sigma.clip(px.where("k = 'long'").select("v"), StackSpec("sigmaclip-mean", ())).first()
    assert one["n"] == brute(cases()["long", 0], spec)[0]


def test_missing_numbers_as_keys_are_one_key(spark):
    px = spark.createDataFrame([(float("nan"), 1), (float("nan"), 5), (1.0, 2), (None, 3), (None, 4)], "k double, v long")
    assert sorted(r["fn"] for r in sigma.clip(px, StackSpec("sigmaclip-mean")).select("fn").collect()) == [1, 2, 2]
    assert px.groupBy("k").agg(F.count("v")).count() == 3
