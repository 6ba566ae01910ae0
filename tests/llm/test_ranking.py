import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.llm.fusion import first_by_fused, ideal_point_ranking
from siltstone.llm.ranking import rank_in_groups, top_n_per_group

T0 = datetime(2025, 1, 1)
DDL = "q string, m string, d long, c string, s double, at timestamp, rank string, cost string"


def hits(seed, n=600):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        q = rng.choice(["hot"] * 6 + ["a", "b", None])
        s = rng.choice([None, float("nan"), 1.0, 1.0, 2.0, -0.0, 0.0, math.inf, -3.5, rng.random()])
        out.append((q, rng.choice("xyz"), rng.randint(1, 30), rng.choice(["c1", "c2", None]), s, rng.choice([None, T0, T0 + timedelta(days=rng.randint(0, 3))]), "clash", "clash"))
    return out + out[:50]


def cost(m, s):
    return None if s is None or s != s else (s if m == "x" else -s) + 0.0


def none_first(v):
    return (v is not None, v if v is not None else "")


def ranked(rows):
    newest = {}
    for q, m, d, c, s, at, *_ in rows:
        newest.setdefault((q, m, d, c), []).append((at or datetime.min, cost(m, s)))
    groups = defaultdict(list)
    for (q, m, d, c), seen in newest.items():
        last = max(at for at, _ in seen)
        valid = [v for at, v in seen if at == last and v is not None]
        if valid:
            groups[q, m].append((min(valid), d, none_first(c), c))
    return {g: sorted(v) for g, v in groups.items()}


def cost_column():
    return F.when(F.col("m") == "x", F.col("s")).otherwise(-F.col("s"))


@pytest.mark.parametrize("hot", [100, 10**9])
def test_ranks_equal_brute_force(make, hot):
    rows = hits(1)
    found = rank_in_groups(make(rows, DDL), ["q", "m"], ["d", "c"], cost_column(), newest="at", partition_by=["q"], hot_rows=hot)
    assert (found.heavy is not None) == (hot == 100)
    got = {}
    for part in (found.light, found.heavy):
        for r in part.collect() if part is not None else []:
            got[r["q"], r["m"], r["d"], r["c"]] = r["rank"]
    want = {(q, m, d, c): i for (q, m), v in ranked(rows).items() for i, (_, d, _, c) in enumerate(v, 1)}
    assert got == want


@pytest.mark.parametrize("hot", [100, 10**9])
def test_top_n_with_limits(make, hot):
    rows = hits(2)
    limits = make([("hot", 4), ("a", 1), ("b", None)], "q string, n int")
    found = top_n_per_group(make(rows, DDL), ["q", "m"], ["d", "c"], cost_column(), 2, limits=limits, max_n=4, newest="at", partition_by=["q"], hot_rows=hot)
    got = {(r["q"], r["m"], r["d"], r["c"]) for r in found.collect()}
    want = {(q, m, d, c) for (q, m), v in ranked(rows).items() for _, d, _, c in v[: {"hot": 4, "a": 1}.get(q, 2)]}
    assert got == want
    assert top_n_per_group(make([], DDL), ["q", "m"], ["d", "c"], cost_column(), 2).count() == 0


@pytest.mark.parametrize("hot", [100, 10**9])
def test_fusion_equals_reciprocal_ranks(make, hot):
    rows = hits(3, 900)
    how = dict(top_k=4, rrf_k=10, newest="at", hot_rows=hot)
    found = ideal_point_ranking(make(rows, DDL), "q", "m", ["d", "c"], cost_column(), ["x", "y", "z"], reciprocal=True, power=1, **how)
    got = {(r["q"], r["d"], r["c"]) for r in first_by_fused(found, "q", ["d", "c"]).collect()}
    sums = defaultdict(float)
    for (q, _), v in ranked(rows).items():
        for i, (_, d, _, c) in enumerate(v, 1):
            sums[q, d, c] += 1 / (10 + i)
    by = defaultdict(list)
    for (q, d, c), s in sums.items():
        by[q].append((-round(s, 9), d, none_first(c), c))
    assert got == {(q, d, c) for q, v in by.items() for _, d, _, c in sorted(v)[:4]}


@pytest.mark.parametrize("rrf_k", [60, 50_000, 10**6])
def test_sums_that_tie_only_after_rounding(make, rrf_k):
    rows = [("q", "y", d, "c", float(d)) for d in range(1, 401)]
    found = ideal_point_ranking(make(rows, "q string, m string, d long, c string, s double"), "q", "m", ["d", "c"], -F.col("s"), ["y"], reciprocal=True, power=1, rrf_k=rrf_k)
    got = [r["d"] for r in first_by_fused(found, "q", ["d", "c"]).orderBy("rank").collect()]
    assert got == sorted(range(1, 401), key=lambda d: (-round(1 / (rrf_k + 401 - d), 9), d))[:5]


def test_many_heavy_keys(make):
    """Every key may be heavy; they are not collected."""
    rows = [(f"q{i % 40}", "x", i, "c", float(i % 7)) for i in range(400)]
    found = top_n_per_group(make(rows, "q string, m string, d long, c string, s double"), ["q"], ["d"], F.col("s"), 3, hot_rows=2)
    want = defaultdict(list)
    for q, _, d, _, s in rows:
        want[q].append((s, d))
    assert {(r["q"], r["d"]) for r in found.collect()} == {(q, d) for q, v in want.items() for _, d in sorted(v)[:3]}


def test_ideal_point_is_not_ruled_by_scale(make):
    """The same ranking whatever a channel's unit and origin."""
    rng = random.Random(4)
    base = [("q", m, d, "c", rng.random()) for m in "yz" for d in range(60)]
    orders = []
    for factor, shift in ((1, 0), (1e6, -5e7)):
        rows = [(q, m, d, c, s * factor + shift if m == "z" else s) for q, m, d, c, s in base]
        for hot in (50, 10**9):
            found = ideal_point_ranking(make(rows, "q string, m string, d long, c string, s double"), "q", "m", ["d", "c"], -F.col("s"), ["y", "z"], top_k=20, weights={}, hot_rows=hot)
            orders.append([r["d"] for r in found.filter("place <= 20").orderBy("place").collect()])
    assert orders[0] == orders[1] == orders[2] == orders[3]


def test_equal_scores_add_nothing(make):
    rows = [("q", "y", d, "c", 1.0) for d in (3, 1, 2)]
    found = ideal_point_ranking(make(rows, "q string, m string, d long, c string, s double"), "q", "m", ["d", "c"], -F.col("s"), ["y"], top_k=2, weights={})
    assert [(r["d"], r["closeness"]) for r in found.filter("place <= 2").orderBy("place").collect()] == [(1, 0), (2, 0)]
