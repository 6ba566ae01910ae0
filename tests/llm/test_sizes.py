import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import packing, similar_vectors
from siltstone.llm import mixing
from siltstone.llm.mixing import mix, mix_report

DOCS = "doc_id long, text string, source string, tokens string, container string"


def check_plan(counts, plan, capacity):
    used = Counter()
    for n, content in plan:
        assert n >= 1 and sum(s * e for s, e in content) <= capacity
        for s, e in content:
            used[s] += n * e
    assert used == Counter({s: n for s, n in counts.items() if n})
    return sum(n for n, _ in plan)


def fewest(items, capacity):
    """The optimum, by search."""
    best = len(items)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(items):
            best = len(free)
            return
        for f in sorted({f for f in free if f >= items[i]}):
            rest = list(free)
            rest.remove(f)
            place(i + 1, [*rest, f - items[i]])
        place(i + 1, [*free, capacity - items[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randint(8, 30)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = dict(Counter(items))
        fixed, rest = packing.reduce_instance(counts, capacity)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for n, _ in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
        assert check_plan(counts, packing.plan_containers(counts, capacity), capacity) <= fewest(items, capacity) + 1


def test_best_fit_on_counts():
    rng = random.Random(2)
    for _ in range(100):
        capacity = rng.randint(5, 60)
        counts = {s: rng.randint(1, 500) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(20, capacity)))}
        n = check_plan(counts, packing.best_fit(counts, capacity), capacity)
        assert n <= 1.25 * -(-sum(s * c for s, c in counts.items()) // capacity) + counts.get(capacity, 0) + sum(c for s, c in counts.items() if 2 * s > capacity)


def test_pack(make):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 10, 11, 20, 27]), rng.choice(["a", " A ", "b", "c", None]), "", "") for i in range(300)] + [(900, None, "a", "", "")]
    budgets = make([("a", 10), ("A", 7), ("b", 4), ("d", 9), (None, 5), ("c", 0)], "source string, capacity_tokens int")
    found = packing.pack(make(rows, DOCS), budgets).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s.strip().lower() for i, _, s, *_ in rows if s and s.strip().lower() in ("a", "b")}
    load, parts = defaultdict(int), defaultdict(list)
    for r in found:
        load[r["source"], r["container"]] += r["tokens"]
        parts[r["doc_id"]].append((r["part"], r["tokens"]))
    capacity = {"a": 10, "b": 4}
    assert set(parts) == set(source)
    assert all(n <= capacity[s] for (s, _), n in load.items())
    for i, p in parts.items():
        assert sum(n for _, n in p) == size[i]
        whole = size[i] <= capacity[source[i]]
        assert sorted(k for k, _ in p) == ([0] if whole else list(range(1, -(-size[i] // capacity[source[i]]) + 1)))
    for s in capacity:
        numbers = sorted(c for x, c in load if x == s)
        assert numbers == list(range(1, len(numbers) + 1))
    report = {r["source"]: r for r in packing.fill_report(packing.pack(make(rows, DOCS), budgets), budgets).collect()}
    assert report["a"]["containers"] == max(c for x, c in load if x == "a") and report["a"]["fill"] > 0.9
    assert packing.pack(make([], DOCS), budgets).count() == 0


# -- mixing


def test_mix(make):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 40]), rng.choice(["big"] * 8 + [" Mid", "small", None]), "", "") for i in range(2000)] + [(5000, None, "big", "", "")]
    targets = make([("m", "big", 0.5, 1), ("m", "mid", 0.3, 4), ("m", "small", 0.2, 2), ("n", "mid", 1.0, 1), ("o", "gone", 0.5, 3), ("o", "big", 0.5, 1), ("z", "big", None, 1), ("z", "mid", 1.0, None)], "mix_id string, source string, target_share double, max_repeats int")
    selection, plan = mix(make(rows, DOCS), targets)
    report = {(r["mix_id"], r["source"]): r for r in mix_report(selection, plan).collect()}
    total = defaultdict(int)
    for _, t, s, *_ in rows:
        if s and t:
            total[s.strip().lower()] += len(t.split())
    whole = sum(total.values())
    chosen = defaultdict(list)
    for r in selection.collect():
        chosen[r["mix_id"], r["source"]].append(r)
    for (m, s), share, repeats in ((("m", "big"), 0.5, 1), (("m", "mid"), 0.3, 4), (("m", "small"), 0.2, 2)):
        got = chosen[m, s]
        assert len({r["doc_id"] for r in got}) == len(got) and max(r["copies"] for r in got) <= repeats
        reached = sum(r["tokens"] * r["copies"] for r in got)
        assert reached == report[m, s]["reached_tokens"]
        target = share * whole
        assert report[m, s]["short"] == (target > repeats * total[s])
        assert reached == repeats * total[s] if report[m, s]["short"] else abs(reached - target) <= 40
    assert report["o", "gone"]["reached_tokens"] == 0 and report["o", "gone"]["short"]
    assert report["n", "mid"]["reached_share"] == 1.0 and len(chosen["z", "mid"]) == 0 and len(chosen["z", "big"]) == 0
    assert selection.count() == mix(make(rows, DOCS), targets)[0].count()
    assert mix(make([], DOCS), targets)[0].count() == 0


def test_larger_documents_are_drawn_more_often(make):
    rows = [(i, "w " * (1 if i % 2 else 9), "s", "", "") for i in range(2000)] + [(9000, "w " * 10000, "t", "", "")]
    targets = make([("m", "s", 0.2, 1), ("m", "t", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    got = Counter(r["tokens"] for r in mix(make(rows, DOCS), targets)[0].filter("source = 's'").collect())
    assert 6 * got[1] < got[9] and 1 * got[1] + 9 * got[9] == pytest.approx(4000, abs=5)


# -- vectors

VEC = "vec_id long, storage_id string, model string, dimensions int, vector array<float>, embedded_at timestamp, space string, rank string"


def vectors(seed, n=240):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, 16))).astype(np.float32) * rng.uniform(0.1, 9, (n, 1)).astype(np.float32)
    rows = [(i, f"s{i}", "m" if i % 3 else None, 16, [float(v) for v in x[i]], None, "", "") for i in range(n)]
    rows += [(1000 + i, f"copy{i}", "m", 16, rows[1][4], None, "", "") for i in range(9)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    return rows + [(2000 + i, f"bad{i}", "m", 16, v, None, "", "") for i, v in enumerate(bad)] + [(3000, "alone", "other", 16, [1.0] * 16, None, "", "")] + rows[:5]


def true_near(rows, k):
    good = {}
    for r in rows:
        v = r[4]
        if v is not None and len(v) == r[3] and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[r[0]] = (r[2], np.array(v, float) / np.linalg.norm(np.array(v, float)))
    out = {}
    for i, (m, v) in good.items():
        others = sorted((-round(float(v @ w), 6), j) for j, (o, w) in good.items() if j != i and o == m)
        if others:
            out[i] = [(j, -s) for s, j in others[:k]]
    return out


def test_nearest_with_all_probes_is_exact(make, monkeypatch):
    monkeypatch.setattr(similar_vectors, "PER_PARTITION", 40)
    monkeypatch.setattr(similar_vectors, "DATA_BLOCK", 16)
    monkeypatch.setattr(similar_vectors, "QUERY_BLOCK", 32)
    rows = vectors(1)
    found = defaultdict(dict)
    for r in similar_vectors.nearest(make(rows, VEC), 5, probes=99, keep=99).collect():
        found[r["vec_id"]][r["rank"]] = (r["near_id"], round(r["similarity"], 6))
    want = true_near(rows, 5)
    assert found.keys() == want.keys()
    for i, near in want.items():
        assert [round(s, 4) for _, s in near] == [round(found[i][k][1], 4) for k in sorted(found[i])]
        assert i not in [j for j, _ in found[i].values()]
    assert [found[1][k][0] for k in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    assert [found[1004][k][0] for k in range(1, 6)] == [1, 1000, 1001, 1002, 1003]


def test_search_recall(make):
    rows = vectors(2, 400)
    asked = make([(i,) for i in range(0, 400, 10)], "vec_id long")
    got = defaultdict(set)
    for r in similar_vectors.search(make(rows, VEC), asked, 5).collect():
        got[r["vec_id"]].add(r["near_id"])
    want = true_near(rows, 5)
    hit = [len(got[i] & {j for j, _ in want[i]}) / 5 for i in range(0, 400, 10)]
    assert np.mean(hit) >= 0.9


def test_newest_row_counts(make):
    from datetime import datetime

    rows = [(1, "s", "m", 2, [1.0, 0.0], datetime(2025, 1, 1), "", ""), (2, "s", "m", 2, None, datetime(2025, 1, 2), "", ""), (3, "t", "m", 2, [1.0, 0.1], None, "", "")]
    assert [r["vec_id"] for r in similar_vectors.comparable(make(rows, VEC)).collect()] == [3]
    assert similar_vectors.nearest(make([], VEC)).count() == 0 and similar_vectors.nearest(make(rows, VEC)).count() == 0


def test_anisotropic_codes_lower_their_loss():
    """Codes chosen by the anisotropic loss have less of it, and less parallel error, than the nearest words."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words = similar_vectors.fit_words(x)
    weight = 63 * similar_vectors.T**2 / (1 - similar_vectors.T**2)

    def errors(codes):
        e = x - np.stack([words[s][codes[:, s]] for s in range(32)], axis=1).reshape(len(x), -1)
        along = (e * x).sum(axis=1) ** 2
        return np.mean((e * e).sum(axis=1) + (weight - 1) * along), np.mean(along)

    plain = np.stack([((x.reshape(-1, 32, 2)[:, s, None] - words[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(32)], axis=1)
    ours, nearest = errors(similar_vectors.encode(x, words)), errors(plain)
    assert ours[0] < nearest[0] and ours[1] < nearest[1]

def test_dense_group_of_near_copies(make, monkeypatch):
    """Codes cannot tell near copies apart, nor does one partition hold them."""
    monkeypatch.setattr(similar_vectors, "PER_PARTITION", 100)
    monkeypatch.setattr(similar_vectors, "PROBES", 2)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x[:1200] = rng.normal(size=32) + 0.02 * rng.normal(size=(1200, 32))
    x[100:200] = x[100] * rng.uniform(0.1, 9, (100, 1))  # copies but for their norm
    x = x.astype(np.float32)
    rows = [(i, f"s{i}", "m", 32, v.tolist(), None, "", "") for i, v in enumerate(x)]
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    exact = units @ units.T
    np.fill_diagonal(exact, -9)
    fifth = np.sort(exact, axis=1)[:, -5]
    got = similar_vectors.nearest(make(rows, VEC), 5, probes=2, least=0.9).collect()
    assert all(abs(r["similarity"] - exact[r["vec_id"], r["near_id"]]) < 1e-8 for r in got)
    hits = Counter(r["vec_id"] for r in got if r["similarity"] >= fifth[r["vec_id"]] - 1e-8)
    assert all(hits[i] == 5 for i in range(1200))


def test_levels_of_partitions(make, monkeypatch):
    """Partitions beyond one level of centroids: about as many as wanted, and near vectors still meet."""
    monkeypatch.setattr(similar_vectors, "PER_PARTITION", 50)
    monkeypatch.setattr(similar_vectors, "LEVEL", 5)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(750, 16)), 4, axis=0) + 0.05 * rng.normal(size=(3000, 16))
    units = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    levels = similar_vectors.fit_levels(units, 60, 5)
    assert [len(c) for c in levels] == [5, 5, 3]
    home, sent = similar_vectors.partitions_of(units, levels, 4)
    assert home.max() < 75 and len(set(home.tolist())) > 30 and all(h in c for h, c in zip(home, sent, strict=True))
    rows = [(i, f"s{i}", "m", 16, v.tolist(), None, "", "") for i, v in enumerate(units)]
    exact = units.astype(float) @ units.T.astype(float)
    np.fill_diagonal(exact, -9)
    want = {(i, j) for i, j in zip(*np.nonzero(exact >= 0.9), strict=True)}
    got = {(r["vec_id"], r["near_id"]) for r in similar_vectors.nearest(make(rows, VEC), 5, least=0.9).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("wanted, level", [(7, 64), (60, 64), (60, 16), (60, 5)])
def test_partitions_are_chosen_alike_for_any_number_of_levels(monkeypatch, wanted, level):
    """The nearest partitions and all with a cosine of 0.9 or more, as by looking at every sum of centroids."""
    monkeypatch.setattr(similar_vectors, "CELLS", 5_000)
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=16) + 0.1 * rng.normal(size=(900, 16))])
    units = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    levels = similar_vectors.fit_levels(units, wanted, level)
    sums = np.zeros((1, 16))
    for c in levels:
        sums = (sums[:, None] + c).reshape(-1, 16)
    away = ((units[:, None] - sums) ** 2).sum(axis=2)
    dense = units @ sums.T >= 0.9 * np.linalg.norm(sums, axis=1)
    home, sent = similar_vectors.partitions_of(units, levels, 4)
    assert home.tolist() == away.argmin(axis=1).tolist()
    for i, got in enumerate(sent):
        assert set(got.tolist()) == set(np.argsort(away[i])[:4].tolist()) | set(np.flatnonzero(dense[i]).tolist())
    assert wanted < 60 or max(len(got) for got in sent) > 8


def test_dense_group_in_levels_of_partitions(make, monkeypatch):
    """Near copies in more partitions than are probed are found where there are several levels, too."""
    monkeypatch.setattr(similar_vectors, "PER_PARTITION", 50)
    monkeypatch.setattr(similar_vectors, "LEVEL", 16)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3000, 32))
    x[:1500] = rng.normal(size=32) + 0.15 * rng.normal(size=(1500, 32))
    x = x.astype(np.float32)
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    exact = units @ units.T
    np.fill_diagonal(exact, -9)
    fifth = np.sort(exact, axis=1)[:, -5]
    rows = [(i, f"s{i}", "m", 32, v.tolist(), None, "", "") for i, v in enumerate(x)]
    got = similar_vectors.nearest(make(rows, VEC), 5, least=0.9).collect()
    hits = Counter(r["vec_id"] for r in got if r["similarity"] >= fifth[r["vec_id"]] - 1e-8)
    assert all(hits[i] == 5 for i in range(1500))


def test_search_among_many_copies(make):
    """More copies of one vector than a block's list keeps hide neither the least ids nor nearer rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[200:500] = x[200]
    rows = [(i, f"s{i}", "m", 16, [float(c) for c in v], None, "", "") for i, v in enumerate(x)]
    asked = make([(i,) for i in (0, 1, 2, 200, 499)], "vec_id long")
    got = defaultdict(list)
    for r in similar_vectors.search(make(rows, VEC), asked, 5, keep=8).orderBy("vec_id", "rank").collect():
        got[r["vec_id"]].append(r["near_id"])
    want = true_near(rows, 5)
    assert got[499] == [200, 201, 202, 203, 204] and got[200] == [201, 202, 203, 204, 205]
    assert all(got[i] == [j for j, _ in want[i]] for i in (0, 1, 2))


def test_code_words_are_fitted_on_the_whole_sample(monkeypatch):
    """Vectors that drift with vec_id: the words serve the last ones too."""
    monkeypatch.setattr(similar_vectors, "WORDS_SAMPLE", 8_192)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(10_240, 8)).astype(np.float32)
    x[8_192:] += 8 * np.tile([1, -1], 4)
    fitted = similar_vectors._fit(64)(pd.DataFrame({"vec_id": range(len(x)), "space": "m/8", "vector": list(x), "wanted": 1}))
    words = np.frombuffer(fitted["words"][0], np.float32).reshape(-1, 16, 2)
    last = similar_vectors._units(x[8_192:])
    coded = words[np.arange(4), similar_vectors.encode(last, words)].reshape(len(last), -1)
    assert np.mean(((coded - last) ** 2).sum(axis=1)) < 0.03


def test_reduction_fixes_sets_of_three():
    assert packing.reduce_instance({50: 1, 30: 1, 20: 1}, 101) == ([(1, [(50, 1), (30, 1), (20, 1)])], {})
    assert packing.reduce_instance({52: 3, 30: 3, 19: 3}, 101) == ([(3, [(52, 1), (30, 1), (19, 1)])], {})


def test_a_common_size_is_numbered_in_parts(make, monkeypatch):
    """However few rows a window may number, every document has its place and containers hold no more than they may."""
    rng = random.Random(13)
    docs = make([(i, " ".join(["w"] * rng.choice([3, 3, 3, 4, 9, 25])), " Notes ", "", "") for i in range(300)] + [(999, None, None, "", "")], DOCS)
    budgets = make([("notes", 10)], "source string, capacity_tokens int")
    fewest = None
    for most in (1_000_000, 20):
        monkeypatch.setattr(packing, "WINDOW_ROWS", most)
        packed = packing.pack(docs, budgets).cache()
        row = packing.invariants(packed, docs, budgets).collect()
        assert [(r["source"], r["documents"], r["fits"], r["whole"]) for r in row] == [("notes", 300, True, True)]
        fewest = fewest or packed.select("container").distinct().count()
        assert packed.select("container").distinct().count() == fewest


def test_invariants_of_a_mix(make):
    rng = random.Random(14)
    docs = make([(i, " ".join(["w"] * rng.randint(1, 9)), rng.choice(["a", "b", "B "]), "", "") for i in range(200)], DOCS)
    targets = make([("m", "a", 0.9, 2), ("m", "b", 0.1, 1), ("m", "none", 0.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    rows = mixing.invariants(*mix(docs, targets)).collect()
    assert len(rows) == 3 and all(r["capped"] and r["near"] for r in rows)
