"""Retrieval operators against independent statements of what they compute."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.vectors import cosine
from siltstone.operators import context, evaluation, search

WORDS = "alpha beta gamma delta epsilon zeta eta theta ñandú über naïve foo_bar".split()


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, f"c{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))) for i in range(n)]


def test_bm25_equals_sqlite(spark):
    texts = corpus()
    queries = [("q1", "alpha beta beta"), ("q2", "foo_bar"), ("q3", "x"), ("q4", "theta nandu __ zz"), ("q5", "beta gamma_delta")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(text, id UNINDEXED)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO t (text, id) VALUES (?, ?)", [(t, i) for i, _, t in texts])
    wanted = {}
    for name, query in queries:
        import re

        tokens = [w for w in re.findall("[A-Za-z0-9_]+", query) if len(w) >= 2][:64]
        if tokens:
            match = " OR ".join(f'"{w}"' for w in tokens)
            for i, score in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (match,)):
                wanted[name, int(i)] = score
    chunks = spark.createDataFrame(texts, "doc_id long, chunk_id string, text string")
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25_scores(chunks, spark.createDataFrame(queries, "query_id string, query string")).collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-8 for k in wanted)


def test_dense_equals_expressions(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "BASE_ROWS", 13)
    monkeypatch.setattr(search, "QUERIES_SENT", 8)
    rng = np.random.default_rng(20260909)
    vectors = [(i, f"c{i}", rng.uniform(-1, 1, 16).round(3).tolist()) for i in range(50)] + [(90, "z", [0.0] * 16), (91, "short", [1.0] * 3), (92, "none", None)]
    vectors += [(93, "same", vectors[0][2])]
    base = spark.createDataFrame(vectors, "doc_id long, chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", rng.uniform(-1, 1, 16).tolist()) for i in range(15)] + [("zero", [0.0] * 16), ("none", None)], "query_id string, vector array<double>")
    found = sorted(tuple(r) for r in search.dense_top_k(base, asked, 4).select("query_id", "rank", "doc_id", "score").collect())
    flat = base.filter("size(vector) = 16").crossJoin(asked.filter("query_id NOT IN ('zero', 'none')").withColumnRenamed("vector", "q"))
    exact = search.top_k(flat.withColumn("score", F.round(cosine(F.col("q"), F.col("vector")), 9)), 4)
    assert found == sorted(tuple(r) for r in exact.select("query_id", "rank", "doc_id", "score").collect())


def test_nearest_rows_are_the_k_best_by_row(monkeypatch):
    """In tiles and with bounds: ties, repeated and missing vectors, fewer rows than k."""
    rng = np.random.default_rng(20261129)
    for tile in (40, 1 << 20):
        monkeypatch.setattr(search, "TILE", tile)
        for rows, k in ((3, 5), (200, 5), (200, 1)):
            q, b = (search._unit(rng.integers(-2, 3, (n, 3)).astype(float)) for n in (20, rows))
            exact = np.round(q @ b.T, 9) + 0.0
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            kth = np.take_along_axis(exact, order, 1)[:, -1]
            for least in (np.full(20, -np.inf), kth if rows > k else kth - 1):
                i, j, score = search.nearest_rows(q, b, k, least)
                assert i.tolist() == np.repeat(np.arange(20), order.shape[1]).tolist() and j.tolist() == order.ravel().tolist()
                assert score.tolist() == exact[i, j].tolist()


def test_a_task_gives_the_k_best_sums_of_its_items(monkeypatch):
    """And what ties with them, however many of its items are above what was known before."""
    import pyarrow as pa

    monkeypatch.setattr(search, "CELLS", 60)
    rng = np.random.default_rng(20261129)
    part = rng.integers(1, 40, (300, 4)) / 4
    weights = {"qid": np.repeat(np.arange(6), 2), "tid": np.array([0, 1, 1, 2, 2, 3, 0, 3, 0, 2, 1, 3]), "weight": np.ones(12), "least": np.full(12, np.nan)}
    ids, tids = np.divmod(np.arange(1200), 4)
    gids = ids // 130
    batches = [pa.RecordBatch.from_arrays([pa.array(c[x]) for c in (gids, ids, tids, part.ravel())], names=["gid", "id", "tid", "part"]) for x in np.array_split(np.arange(1200), 7)]
    found = {}
    for batch in search._above(weights, 5)(iter(batches)):
        for q, g, i, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault((q, g), set()).add((i, -score))
    assert len(found) == 18
    for q, g in found:
        own = ids[gids == g][::4]
        sums = part[:, weights["tid"][weights["qid"] == q]].sum(axis=1)
        assert found[q, g] == {(i, sums[i]) for i in own.tolist() if sums[i] >= np.sort(sums[own])[-5]}


def test_best_of_each_group_equals_all_scores(spark, monkeypatch):
    """Of a document in several groups, and without the scores of all others leaving their tasks."""
    texts = spark.createDataFrame(corpus(80, 7), "doc_id long, chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "alpha beta gamma"), ("q2", "zeta"), ("q3", "foo_bar eta theta"), ("q4", "nothing")], "query_id string, query string")
    rows = [(i, f"g{i % 3}") for i in range(75)] + [(i, "also") for i in range(0, 75, 4)]
    groups = spark.createDataFrame(rows, "doc_id long, collection string")
    scores = [tuple(r) for r in search.bm25_scores(texts, queries).select("query_id", "score", "doc_id", "chunk_id").collect()]
    wanted = set()
    for q in ("q1", "q2", "q3"):
        for group in ("g0", "g1", "g2", "also"):
            own = sorted(r[1:] for r in scores if r[0] == q and (r[2], group) in rows)
            wanted |= {(q, group, n + 1, *r) for n, r in enumerate(own[:3])}
    monkeypatch.setattr(search, "_sums", None, raising=False)
    for most in (200_000, 2):
        monkeypatch.setattr(search, "BROADCAST", most)
        found = search.bm25_top_k(texts, queries, 3, groups=groups).select("query_id", "collection", "rank", "score", "doc_id", "chunk_id")
        found = [tuple(r) for r in found.collect()]
        assert len(found) == len(wanted) and set(found) == wanted


def test_all_scores_are_not_shuffled(spark, monkeypatch):
    """They get their names in the task that makes them."""
    texts = spark.createDataFrame(corpus(80, 8), "doc_id long, chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "alpha beta gamma"), ("q2", "zeta"), ("q3", "foo_bar eta theta")], "query_id string, query string")
    scores = search.bm25_scores(texts, queries)
    above = scores._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(above) == 2 and "Exchange" not in above[0]
    one = sorted(map(tuple, scores.collect()))
    assert len(one) == len(set(one)) > 80
    for constant in ("CELLS", "SUMS_A_TASK", "SENT_ROWS", "BROADCAST"):
        monkeypatch.setattr(search, constant, 2)
    assert sorted(map(tuple, search.bm25_scores(texts.limit(20), queries).select("doc_id", "query_id").collect())) == sorted((r[1], r[0]) for r in one if r[1] < 20)


def test_rrf_ties_and_bounds(spark):
    ddl = "query_id string, doc_id long, chunk_id string, rank int"
    one = spark.createDataFrame([("q", 1, "a", 1), ("q", 2, "b", 2)], ddl)
    two = spark.createDataFrame([("q", 3, "c", 1), ("q", 2, "b", 2)], ddl)
    rows = search.rrf_fuse(one, two, k=3).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [2, 1, 3]
    with pytest.raises(ValueError):
        search.rrf_fuse(one, two, rrf_k=0)


def test_hybrid_without_lexical_hits_keeps_cosines(spark):
    chunks = spark.createDataFrame([(1, "a", "alpha", [1.0, 0.0]), (2, "b", "beta", [0.6, 0.8])], "doc_id long, chunk_id string, text string, vector array<double>")
    asked = spark.createDataFrame([("q", "nothing here", [1.0, 0.0])], "query_id string, query string, vector array<double>")
    rows = search.hybrid_top_k(chunks, asked, k=2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(1, 1.0), (2, 0.6)]


def pack(hits, most, parents=True):
    """The packing told as a loop."""
    seen, blocks, used, cut, n = set(), [], 0, False, 0
    for doc, chunk, parent, text, above, path in hits:
        if (doc, parent or chunk) in seen:
            continue
        seen.add((doc, parent or chunk))
        body = (above or "").strip() if parents and (above or "").strip() else text.strip()
        if not body:
            continue
        n += 1
        head = f"[{n}] ({path or doc})\n"
        room = most - used - len(head) - 2
        if room <= 0:
            cut = True
            break
        short = len(body) > room
        block = head + (body[: room - 1] + "…" if short else body) + "\n\n"
        blocks.append(block)
        used += len(block)
        if short:
            cut = True
            break
    text = "".join(blocks).rstrip()
    return (text, cut, len(text), len(blocks)) if blocks else None


def test_pack_equals_loop(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for q in range(60):
        hits = []
        for r in range(rng.randint(1, 7)):
            text = rng.choice(["", " ", "a" * rng.randint(1, 60), "b é\n c"])
            hits.append((rng.randint(1, 3), f"c{rng.randint(1, 4)}", rng.choice([None, "", "p1"]), text, rng.choice([None, "", "P" * rng.randint(1, 80)]), rng.choice([None, "", "x/y"])))
            rows.append((f"q{q}", r + 1, *hits[-1], 1.0))
        if (packed := pack(hits, 100)) is not None:
            wanted[f"q{q}"] = packed
    ddl = "query_id string, rank int, doc_id long, chunk_id string, parent_chunk_id string, text string, parent_text string, source_path string, score double"
    found = {r["query_id"]: (r["context"], r["truncated"], r["chars_used"], r["n_blocks"]) for r in context.pack_context(spark.createDataFrame(rows, ddl), 100).collect()}
    assert found == wanted


def test_quality(spark):
    ddl = "mode string, reranked boolean, top_score double, chars_used int"
    rows = [("vector", False, 0.25, 5), ("vector", False, 0.2, 5), ("bm25", False, -1.5, 5), ("bm25", True, -1.5, 5), ("hybrid", False, 0.03, 5), ("hybrid", False, 0.03, 0), ("hybrid", False, None, 5)]
    found = [r["label"] for r in context.quality_label(spark.createDataFrame(rows, ddl)).collect()]
    assert found == ["high", "low", "high", "low", "high", "empty", "empty"]


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 2, 1), ("a", 3, 3, 1), ("b", 1, 1, 1), ("c", 1, 1, 0)], "query_id string, rank int, doc_id long, relevant int")
    gold = spark.createDataFrame([("a", 2), ("b", 0), ("c", 0), ("d", 1)], "query_id string, gold_count int")
    found = {r["query_id"]: (r["hit"], r["recall"], r["reciprocal_rank"], round(r["ndcg"], 6)) for r in evaluation.query_metrics(ranked, gold, 3).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert found["a"] == (1, 1, 0.5, round((1 / math.log2(3) + 0.5) / ideal, 6))
    assert found["b"] == (0, 0, 0, 0) and found["c"] == (1, 1, 1, 1) and found["d"] == (0, 0, 0, 0)


def test_bootstrap(spark):
    rows = [("m", f"q{i:02d}", float(i % 2), 1.0, 0.5, i / 20) for i in range(20)] + [("one", "q", 0.3, 0.3, 0.3, 0.3)]
    found = evaluation.bootstrap_intervals(spark.createDataFrame(rows, "mode string, query_id string, hit double, recall double, reciprocal_rank double, ndcg double"))
    by = {(r["mode"], r["metric"]): (r["low"], r["high"]) for r in found.collect()}
    rng, values = random.Random(20260909), [float(i % 2) for i in range(20)]
    means = sorted(sum(values[rng.randrange(20)] for _ in range(20)) / 20 for _ in range(1000))
    assert by["m", "hit"] == pytest.approx((means[24], means[975]))
    assert by["m", "recall"] == (1, 1) and by["one", "hit"] == (0.3, 0.3)


def test_rules_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RULES_AT_ONCE", 1)
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, "BETA"), (3, None)], "doc_id long, text string")
    rules = spark.createDataFrame([("q1", "alpha"), ("q2", "Beta"), ("q3", ""), ("q4", None)], "query_id string, text_contains string")
    assert {tuple(r) for r in evaluation.rule_match(texts, rules).collect()} == {("q1", 1), ("q2", 1), ("q2", 2)}
    assert evaluation.rule_match(texts, rules.limit(0)).count() == 0


def test_rules_many_queries_share_are_paired_by_string(spark, monkeypatch):
    """What a task holds depends on strings and documents, not on how many queries have a string."""
    import pyarrow as pa

    monkeypatch.setattr(evaluation, "PAIRS_AT_ONCE", 10)
    texts = [(i, "Alpha beta" if i % 2 else "beta GAMMA") for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], names=["doc_id", "text"])
    parts = list(evaluation._find(["alpha", "beta", "gamma"])(iter([batch])))
    assert sum(len(p) for p in parts) == 80 and max(len(p) for p in parts) <= 12
    monkeypatch.setattr(evaluation, "ROWS_A_TASK", 100)
    rules = [(f"q{i}", "beta") for i in range(30)] + [("two", "Alpha"), ("two", "BETA"), ("two", "beta"), ("none", "delta")]
    found = evaluation.rule_match(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rules, "query_id string, text_contains string"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, d) for q, _ in rules[:-1] for d, _ in texts}
    plan = evaluation.rule_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([("beta",)], "t string"))
    assert plan.count() == 40


def test_metrics_do_without_all_relevant_rows(spark, monkeypatch):
    """Only ranked documents are judged; every query with every relevant document is not a table of theirs."""
    from conftest import DATA

    from siltstone.plans import retrieval

    texts = spark.createDataFrame([(1, "Alpha beta"), (2, "BETA"), (3, None), (4, "alpha")], "doc_id long, text string")
    rules = spark.createDataFrame([("q1", "alpha"), ("q1", "beta"), ("q2", "Beta"), ("q3", ""), ("q4", None)], "query_id string, text_contains string")
    hits = spark.createDataFrame([(q, r, d) for q in ("q1", "q2", "q3", "q4") for r, d in ((1, 4), (2, 1), (3, 4), (4, 2), (5, 3))], "query_id string, rank int, doc_id long")
    strings = evaluation.rule_strings(rules)
    found = evaluation.rule_hits(texts, strings)
    wanted = evaluation.collapse_documents(hits, evaluation.rule_match(texts, rules), 3).collect()
    got = evaluation.collapse_documents(hits, lambda pairs: evaluation.matched(pairs, strings, found), 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and sum(r["relevant"] for r in got) == 5
    monkeypatch.setattr(evaluation, "rule_match", None)
    assert retrieval.mode_comparison(spark, DATA).count() == 1


def test_percentiles_and_places(spark):
    from siltstone.operators.ordering import first_rows

    rng = random.Random(9)
    rows = [(k, float(rng.randint(0, 30))) for k in "aab" for _ in range(150)] + [("one", 2.0), ("none", None)]
    found = {r["k"]: (r["mean"], r["p50"], r["p95"], r["max"]) for r in evaluation.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for key in ("a", "b", "one"):
        v = sorted(x for k, x in rows if k == key)
        assert found[key] == (round(sum(v) / len(v), 6), v[round(0.5 * (len(v) - 1))], v[round(0.95 * (len(v) - 1))], v[-1])
    assert "none" not in found
    ids = list(range(500))
    rng.shuffle(ids)
    for n in (0, 1, 123, 500, 900):
        assert {r["i"] for r in first_rows(spark.createDataFrame([(i,) for i in ids], "i int"), ["i"], n).collect()} == set(range(min(n, 500)))


def test_random_indices_are_those_of_randrange():
    for n in (2, 3, 20, 2970, 2**20):
        rng = random.Random(20260909)
        assert evaluation.random_indices(n, 3000, 20260909).tolist() == [rng.randrange(n) for _ in range(3000)]


def test_bootstrap_draws_a_bounded_number_at_once():
    """The indices of all iterations are never there together, and are the same."""
    import tracemalloc

    n, rows = 20_011, 400
    wanted = random.Random(7)
    tracemalloc.start()
    for at, row in enumerate(evaluation.random_rows(n, rows, 7)):
        if at < 70:  # beyond what is drawn at once
            assert row.tolist() == [wanted.randrange(n) for _ in range(n)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == rows - 1 and most < n * rows * 8 / 1.5


def test_weights_in_several_runs(spark, monkeypatch):
    """However few rows are broadcast at once, and with or without a bound, the k best are the same."""
    texts = spark.createDataFrame(corpus(80, 5) + [(500 + i, f"d{i}", "alpha beta") for i in range(9)], "doc_id long, chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "alpha beta gamma"), ("q2", "zeta"), ("q3", "foo_bar eta theta"), ("q4", "nothing")], "query_id string, query string")
    columns = ["query_id", "rank", "doc_id", "chunk_id", "score"]
    one = sorted(tuple(r) for r in search.bm25_top_k(texts, queries, 4).select(*columns).collect())
    scores = search.bm25_scores(texts, queries)
    assert one == sorted(tuple(r) for r in search.top_k(scores, 4, best="low").select(*columns).collect())
    monkeypatch.setattr(search, "BROADCAST", 2)
    monkeypatch.setattr(search, "LOCAL", 1)
    assert one == sorted(tuple(r) for r in search.bm25_top_k(texts, queries, 4).select(*columns).collect())


def test_stored_index_gives_the_same_scores(spark, monkeypatch):
    from siltstone.operators import index
    from siltstone.session import scratch_path

    texts = spark.createDataFrame(corpus(80, 6), "doc_id long, chunk_id string, text string")
    queries = spark.createDataFrame([("q1", "alpha beta beta"), ("q2", "foo_bar"), ("q3", "naïve über")], "query_id string, query string")
    path = scratch_path(spark, "index")
    index.store(texts, search.ITEM, path)
    stored = index.TextIndex(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/postings"))
    want = sorted(tuple(r) for r in search.bm25_top_k(texts, queries, 5).collect())
    for most in (1_000, 1):
        monkeypatch.setattr(index, "NAMED_TERMS", most)
        assert sorted(tuple(r) for r in search.bm25_top_k(stored, queries, 5).collect()) == want
    monkeypatch.setattr(index, "NAMED_TERMS", 1_000)
    read = stored.of_terms(spark.createDataFrame([("alpha",)], "term string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "term" in plan.split("PushedFilters")[1].split("]")[0]
