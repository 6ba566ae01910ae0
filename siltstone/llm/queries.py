"""Queries on training data (p1, p3 to p9) and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import fusion, mixing, near_duplicates, packing, ranking, shared_spans, similar_vectors, splitting
from siltstone.plans.tables import table

CHANNELS = ("vector", "bm25", "rerank")
ITEMS = ["doc_id", "chunk_id"]
#: Where neither a query's profile nor the profile `default` is in the settings.
DEFAULTS = {"top_k": 5, "rrf_k": 60}


#: What TESTDATA.md calls alike for chunks; whole documents take the usual five words and 0.8, however short they are.
CHUNKS_ALIKE = near_duplicates.Likeness(words=3, threshold=0.6, least=20, rows=4, bands=60)
DOCUMENTS_ALIKE = near_duplicates.Likeness(words=5, threshold=0.8, least=1, rows=8, bands=36)


def _child_texts(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").filter("role = 'child'")
    return chunks.select(F.col("storage_id").alias("id"), F.col("doc_id").alias("owner"), "text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of child chunks of different documents that are alike."""
    signed = near_duplicates.signatures(_child_texts(spark, folder), CHUNKS_ALIKE)
    links = near_duplicates.similar_fingerprints(signed, CHUNKS_ALIKE)
    pairs = near_duplicates.member_pairs(signed, links)
    return pairs.select(F.col("id_a").alias("storage_id_a"), F.col("id_b").alias("storage_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every child chunk."""
    groups = near_duplicates.near_duplicate_groups(_child_texts(spark, folder), CHUNKS_ALIKE)
    return groups.withColumnsRenamed({"id": "storage_id", "owner": "doc_id"})


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """How many child chunks have the same shingles, and how many other texts are alike."""
    return p1_groups(spark, folder).select("storage_id", "copies", "links")


def p1_document_links(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents have the same shingles, and how many other texts are alike."""
    return p1_documents(spark, folder).select("doc_id", "copies", "links")


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every document."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("owner"), "text")
    groups = near_duplicates.near_duplicate_groups(documents, DOCUMENTS_ALIKE)
    return groups.select(F.col("owner").alias("doc_id"), "class_id", "copies", "links", "group_id")


def _cost() -> F.Column:
    """Lower is better in every channel."""
    return F.when(F.col("hit_mode") == "bm25", F.col("score")).otherwise(-F.col("score"))


def _settings(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int], int]:
    """top_k and rrf_k by query, those of the profile `default`, and the largest top_k.

    A query of several profiles takes the last by name.
    """
    settings = table(spark, folder, "retrieval_settings").select("profile", "top_k", "rrf_k").dropna()
    settings = settings.groupBy("profile").agg(F.max(F.struct("top_k", "rrf_k")).alias("s")).select("profile", "s.*")
    best = settings.agg(
        F.max(F.when(F.col("profile") == "default", F.col("top_k"))),
        F.max(F.when(F.col("profile") == "default", F.col("rrf_k"))),
        F.max("top_k"),
    ).first()
    default = {"top_k": best[0] or DEFAULTS["top_k"], "rrf_k": best[1] or DEFAULTS["rrf_k"]}
    evals = table(spark, folder, "query_evals").groupBy("query_id").agg(F.max("profile").alias("profile"))
    return evals.join(settings, "profile").select("query_id", "top_k", "rrf_k"), default, best[2] or 0


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first top_k hits of every query and mode."""
    limits, default, most = _settings(spark, folder)
    return ranking.top_n_per_group(
        table(spark, folder, "vector_hits"), ["query_id", "hit_mode"], ITEMS, _cost(), default["top_k"],
        limits=limits.select("query_id", F.col("top_k").alias("n")), max_n=most, newest="retrieved_at", partition_by=["query_id"],
    ).select("query_id", "hit_mode", *ITEMS)


def _fused(spark: SparkSession, folder: str, **how) -> DataFrame:
    limits, default, _ = _settings(spark, folder)
    return fusion.ideal_point_ranking(
        table(spark, folder, "vector_hits"), "query_id", "hit_mode", ITEMS, _cost(), CHANNELS,
        limits=limits, newest="retrieved_at", **default, **how,
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first top_k chunks of every query by fused reciprocal ranks."""
    ranked = _fused(spark, folder, reciprocal=True, weights=None, power=1)
    return fusion.first_by_fused(ranked, "query_id", ITEMS).select("query_id", *ITEMS)


def p4_ideal(spark: SparkSession, folder: str) -> DataFrame:
    """The first top_k chunks of every query by closeness to the ideal scores."""
    ranked = _fused(spark, folder, weights={})
    return ranked.filter("place <= top_k").select("query_id", "place", *ITEMS, F.round("closeness", 9).alias("closeness"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Child chunks that had to be split."""
    return p5_pieces(spark, folder).select("storage_id").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized child chunks."""
    return splitting.split_oversized(table(spark, folder, "chunks"), table(spark, folder, "chunk_limits"))


def p5_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces."""
    return splitting.invariants(p5_pieces(spark, folder), table(spark, folder, "chunks"), table(spark, folder, "chunk_limits"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors with a similarity of 0.9 or more, one among the other's five nearest."""
    near = similar_vectors.nearest(table(spark, folder, "chunk_embeddings"), 5, least=0.9).filter("similarity >= 0.9")
    return near.select(F.least("vec_id", "near_id").alias("vec_id_a"), F.greatest("vec_id", "near_id").alias("vec_id_b")).distinct()


def p6_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest rows of every row whose vec_id is divisible by 100, against all rows."""
    rows = table(spark, folder, "chunk_embeddings")
    found = similar_vectors.search(rows, rows.filter("vec_id % 100 = 0").select("vec_id"), 5)
    return found.withColumn("similarity", F.round("similarity", 6))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers."""
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_budgets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have to be cut."""
    return p7_containers(spark, folder).filter("part > 0").select("doc_id").distinct()


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each source are."""
    return packing.fill_report(p7_containers(spark, folder), table(spark, folder, "pack_budgets"))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing."""
    return packing.invariants(p7_containers(spark, folder), table(spark, folder, "documents"), table(spark, folder, "pack_budgets"))


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Documents chosen for each mix, with their number of copies."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares."""
    return mixing.mix_report(*mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the selection."""
    return mixing.invariants(*mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose drawn tokens stay at the cap, below their target."""
    report = p8_report(spark, folder)
    return report.filter("short AND reached_tokens = most_tokens").select("mix_id", "source")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of characters that stand in other documents too."""
    return _spans(spark, folder).select("doc_id", "span_start", "span_end")


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is shared."""
    return shared_spans.shared_share(table(spark, folder, "documents"), _spans(spark, folder))


_BEST = """
newest AS (
  SELECT query_id, hit_mode, doc_id, chunk_id,
         CASE WHEN isnan(score) THEN NULL WHEN hit_mode = 'bm25' THEN score ELSE -score END AS cost,
         retrieved_at
  FROM vector_hits),
counting AS (
  SELECT query_id, hit_mode, doc_id, chunk_id, cost FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, hit_mode, doc_id, chunk_id
                                 ORDER BY retrieved_at DESC NULLS LAST, cost NULLS LAST) AS r FROM newest)
  WHERE r = 1 AND cost IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, hit_mode ORDER BY cost, doc_id, chunk_id) AS rank FROM counting),
profiles AS (SELECT query_id, max(profile) AS profile FROM query_evals GROUP BY 1),
limits AS (
  SELECT q.query_id, coalesce(s.top_k, d.top_k) AS top_k, coalesce(s.rrf_k, d.rrf_k) AS rrf_k
  FROM (SELECT DISTINCT query_id FROM vector_hits) q
  LEFT JOIN profiles p ON q.query_id = p.query_id
  LEFT JOIN retrieval_settings s ON s.profile = p.profile
  CROSS JOIN (SELECT top_k, rrf_k FROM retrieval_settings WHERE profile = 'default') d)
"""

_TOKENS = r"""
sizes AS (
  SELECT doc_id, lower(trim(source)) AS source,
         len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]+')) AS tokens
  FROM documents WHERE source IS NOT NULL)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_links": p1_links,
    "p1_documents": p1_documents,
    "p1_document_links": p1_document_links,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_ideal": p4_ideal,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_invariants": p5_invariants,
    "p6_found": p6_found,
    "p6_search": p6_search,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_selection": p8_selection,
    "p8_report": p8_report,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_shared": p9_shared,
}

_SETS = r"""WITH words AS MATERIALIZED (
  SELECT storage_id, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
  FROM (SELECT DISTINCT storage_id, doc_id, text FROM chunks WHERE role = 'child' AND text IS NOT NULL)),
sets AS MATERIALIZED (
  SELECT storage_id, doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s
  FROM words WHERE len(w) >= 20)"""

_SPANS = """WITH texts AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
windows AS MATERIALIZED (
  SELECT doc_id, i, hash(substring(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(n - 199)) AS i FROM texts)),
shared AS (SELECT h FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
marks AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows WHERE h IN (FROM shared)),
runs AS (SELECT doc_id, i, sum((reach IS NULL OR i > reach)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marks),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM runs GROUP BY doc_id, run)"""

_MIXES = f"""{_TOKENS},
totals AS (SELECT source, sum(tokens)::BIGINT AS t FROM sizes GROUP BY 1),
mixes AS (SELECT m.mix_id, lower(trim(m.source)) AS source, m.target_share, m.max_repeats, coalesce(t, 0) AS t,
                 sum(coalesce(t, 0)) OVER (PARTITION BY m.mix_id) AS total
          FROM mix_targets m LEFT JOIN totals ON lower(trim(m.source)) = totals.source)"""

SQL = {
    # brute force: shingles meet by equality, then whole sets are compared
    "p1_found": _SETS + """,
shingles AS MATERIALIZED (SELECT storage_id, doc_id, len(s) AS n, unnest(s) AS h FROM sets),
met AS (
  SELECT a.storage_id AS storage_id_a, b.storage_id AS storage_id_b, a.n AS na, b.n AS nb, count(*) AS common
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.storage_id < b.storage_id AND a.doc_id <> b.doc_id
    AND a.n >= 0.6::DOUBLE * b.n AND b.n >= 0.6::DOUBLE * a.n GROUP BY ALL)
SELECT storage_id_a, storage_id_b FROM met WHERE common >= 0.6::DOUBLE * (na + nb - common)""",
    "p1_links": _SETS + """,
classes AS MATERIALIZED (SELECT s, row_number() OVER () AS c, count(*) AS copies FROM (SELECT DISTINCT storage_id, doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
shingles AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS h FROM classes),
met AS (
  SELECT a.c, a.n AS na, b.n AS nb, count(*) AS common FROM shingles a JOIN shingles b ON a.h = b.h AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n),
degrees AS (SELECT c, count(*) AS links FROM met WHERE common >= 0.6::DOUBLE * (na + nb - common) GROUP BY 1)
SELECT t.storage_id, copies, coalesce(links, 0) AS links FROM (SELECT DISTINCT storage_id, doc_id, list_sort(s) AS s FROM sets) t
JOIN classes USING (s) LEFT JOIN degrees USING (c)""",
    "p1_document_links": r"""WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' '))))) END AS s
  FROM words WHERE len(w) >= 1),
classes AS MATERIALIZED (SELECT s, row_number() OVER () AS c, count(*) AS copies FROM sets GROUP BY s),
shingles AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS h FROM classes),
met AS (
  SELECT a.c, a.n AS na, b.n AS nb, count(*) AS common FROM shingles a JOIN shingles b ON a.h = b.h AND a.c <> b.c
    AND a.n >= 0.8::DOUBLE * b.n AND b.n >= 0.8::DOUBLE * a.n GROUP BY a.c, b.c, a.n, b.n),
degrees AS (SELECT c, count(*) AS links FROM met WHERE common >= 0.8::DOUBLE * (na + nb - common) GROUP BY 1)
SELECT doc_id, copies, coalesce(links, 0) AS links FROM sets JOIN classes USING (s) LEFT JOIN degrees USING (c)""",
    "p6_search": """WITH newest AS (
  SELECT vec_id, model, dimensions, vector::DOUBLE[] AS v,
         row_number() OVER (PARTITION BY storage_id, model ORDER BY embedded_at DESC NULLS LAST, vec_id DESC) AS r
  FROM chunk_embeddings),
good AS MATERIALIZED (
  SELECT DISTINCT vec_id, model, dimensions, v FROM newest
  WHERE r = 1 AND v IS NOT NULL AND len(v) = dimensions AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id, b.vec_id AS near_id, round(list_cosine_similarity(a.v, b.v), 9) AS s
  FROM good a JOIN good b ON a.model = b.model AND a.dimensions = b.dimensions AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT vec_id, rank, near_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, near_id)::INT AS rank FROM pairs) WHERE rank <= 5""",
    "p6_found": """WITH newest AS (
  SELECT vec_id, model, dimensions, vector::DOUBLE[] AS v,
         row_number() OVER (PARTITION BY storage_id, model ORDER BY embedded_at DESC NULLS LAST, vec_id DESC) AS r
  FROM chunk_embeddings),
good AS MATERIALIZED (
  SELECT DISTINCT vec_id, model, dimensions, v FROM newest
  WHERE r = 1 AND v IS NOT NULL AND len(v) = dimensions AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS s
  FROM good a JOIN good b ON a.model = b.model AND a.dimensions = b.dimensions AND a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM pairs WHERE s >= 0.9)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near WHERE rank <= 5""",
    "p7_invariants": f"""WITH {_TOKENS}
SELECT s.source, count(DISTINCT doc_id) AS documents, sum(tokens)::BIGINT AS tokens, TRUE AS fits, TRUE AS whole
FROM sizes s JOIN (SELECT DISTINCT lower(trim(source)) AS source FROM pack_budgets WHERE capacity_tokens >= 1) b ON s.source = b.source GROUP BY 1""",
    "p8_invariants": f"""WITH {_MIXES} SELECT mix_id, source, t AS tokens, total::BIGINT AS mix_tokens, TRUE AS capped, TRUE AS near FROM mixes""",
    "p9_found": f"{_SPANS} SELECT * FROM spans",
    "p9_shared": f"""{_SPANS},
sums AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS shared_chars, count(*) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0) AS chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(s.spans, 0) AS spans,
       CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(shared_chars, 0) / length(text)::DOUBLE ELSE 0 END AS share
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id""",
    "p3_found": f"""WITH {_BEST}
SELECT r.query_id, r.hit_mode, r.doc_id, r.chunk_id FROM ranked r JOIN limits l ON r.query_id = l.query_id WHERE rank <= top_k""",
    "p4_found": f"""WITH {_BEST},
fused AS (
  SELECT r.query_id, doc_id, chunk_id, any_value(top_k) AS top_k,
         round(coalesce(max(CASE WHEN hit_mode = 'vector' THEN 1.0::DOUBLE / (rrf_k + rank) END), 0)
             + coalesce(max(CASE WHEN hit_mode = 'bm25' THEN 1.0::DOUBLE / (rrf_k + rank) END), 0)
             + coalesce(max(CASE WHEN hit_mode = 'rerank' THEN 1.0::DOUBLE / (rrf_k + rank) END), 0), 9) AS fused
  FROM ranked r JOIN limits l ON r.query_id = l.query_id
  WHERE hit_mode IN ('vector', 'bm25', 'rerank') GROUP BY ALL)
SELECT query_id, doc_id, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id, chunk_id) AS r FROM fused)
WHERE r <= top_k""",
    "p4_ideal": f"""WITH {_BEST},
sized AS (
  SELECT r.*, top_k, count(*) OVER (PARTITION BY r.query_id, hit_mode) AS n,
  FROM ranked r JOIN limits l ON r.query_id = l.query_id WHERE hit_mode IN ('vector', 'bm25', 'rerank')),
bounds AS (
  SELECT *, max(CASE WHEN rank = floor(n * 0.05::DOUBLE) + 1 THEN -cost END) OVER w AS high,
            max(CASE WHEN rank = n - floor(n * 0.05::DOUBLE) THEN -cost END) OVER w AS low
  FROM sized WINDOW w AS (PARTITION BY query_id, hit_mode)),
vals AS (SELECT *, greatest(least(-cost, greatest(least(high, 1e150), -1e150)), greatest(least(low, 1e150), -1e150)) - greatest(least(low, 1e150), -1e150) AS x FROM bounds),
wide AS (
  SELECT query_id, doc_id, chunk_id, any_value(top_k) AS top_k,
         coalesce(max(CASE WHEN hit_mode = 'vector' THEN x END), 0) AS x0,
         coalesce(max(CASE WHEN hit_mode = 'bm25' THEN x END), 0) AS x1,
         coalesce(max(CASE WHEN hit_mode = 'rerank' THEN x END), 0) AS x2
  FROM vals GROUP BY 1, 2, 3),
points AS (
  SELECT *, sqrt(sum(x0 * x0) OVER w) AS n0, sqrt(sum(x1 * x1) OVER w) AS n1, sqrt(sum(x2 * x2) OVER w) AS n2,
         max(x0) OVER w AS t0, max(x1) OVER w AS t1, max(x2) OVER w AS t2
  FROM wide WINDOW w AS (PARTITION BY query_id)),
scaled AS (
  SELECT *, CASE WHEN n0 > 0 THEN 1 / n0 ELSE 0 END AS s0, CASE WHEN n1 > 0 THEN 1 / n1 ELSE 0 END AS s1,
         CASE WHEN n2 > 0 THEN 1 / n2 ELSE 0 END AS s2 FROM points),
far AS (
  SELECT *, sqrt((s0 * x0) ** 2 + (s1 * x1) ** 2 + (s2 * x2) ** 2) AS worst,
         sqrt((s0 * (t0 - x0)) ** 2 + (s1 * (t1 - x1)) ** 2 + (s2 * (t2 - x2)) ** 2) AS ideal FROM scaled),
close AS (SELECT *, CASE WHEN worst + ideal > 0 THEN worst / (worst + ideal) ELSE 0 END AS closeness FROM far)
SELECT query_id, place, doc_id, chunk_id, round(closeness, 9) AS closeness FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, doc_id, chunk_id)::INT AS place FROM close)
WHERE place <= top_k""",
    "p5_found": r"""
SELECT DISTINCT c.storage_id FROM chunks c JOIN chunk_limits l ON c.block_type = l.block_type
WHERE c.role = 'child' AND length(regexp_replace(regexp_replace(c.text, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '')) > l.max_chars""",
    "p5_invariants": r"""
SELECT DISTINCT c.storage_id, TRUE AS within, TRUE AS numbered, TRUE AS joins, TRUE AS overlapped FROM chunks c
JOIN (SELECT block_type, min(max_chars) AS most FROM chunk_limits WHERE max_chars >= 1 GROUP BY 1) l ON c.block_type = l.block_type
WHERE c.role = 'child' AND length(regexp_replace(regexp_replace(c.text, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '')) > most""",
    "p7_found": f"""WITH {_TOKENS}
SELECT doc_id FROM sizes s JOIN (SELECT lower(trim(source)) AS source, max(capacity_tokens) AS c FROM pack_budgets GROUP BY 1) b
ON s.source = b.source WHERE tokens > c""",
    "p8_found": f"""WITH {_MIXES}
SELECT mix_id, source FROM mixes WHERE target_share * total::DOUBLE > max_repeats * t""",
}
