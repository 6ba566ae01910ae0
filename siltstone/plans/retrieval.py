"""Queries on the index, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import context, evaluation, index, search
from siltstone.plans.scalars import QUESTIONS
from siltstone.plans.tables import children, chunks, collections, embedded, questions, table
from siltstone.session import materialize

K, CANDIDATES, RRF_K, POOL = 5, 20, 60, 25
MODES = ("vector", "bm25", "hybrid")


def build_postings(spark: SparkSession, folder: str) -> DataFrame:
    tokens = index.tokenized(children(spark, folder), search.ITEM)
    return index.postings(tokens, search.ITEM).select("term", "doc_id", "chunk_id", "tf", "dl")


def doc_len(spark: SparkSession, folder: str) -> DataFrame:
    return index.lengths(index.tokenized(children(spark, folder), search.ITEM), search.ITEM)


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = index.corpus_stats(index.tokenized(children(spark, folder), search.ITEM))
    return stats.select("n", F.round("avgdl", 9).alias("avgdl"))


def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25_scores(children(spark, folder), questions(spark, folder))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25_top_k(children(spark, folder), questions(spark, folder), K)


def _dense(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return search.dense_top_k(embedded(children(spark, folder), "text"), embedded(questions(spark, folder), "query"), k)


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, K)


def _hybrid(spark: SparkSession, folder: str, k: int = K, candidates: int = CANDIDATES) -> DataFrame:
    return search.hybrid_top_k(
        embedded(children(spark, folder), "text"), embedded(questions(spark, folder), "query"), candidates=candidates, rrf_k=RRF_K, k=k
    )


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder)


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """The vector channel's hits fused with those of each other channel."""
    hits = table(spark, folder, "vector_hits").filter("score IS NOT NULL AND NOT isnan(score)")
    cost = F.when(F.col("hit_mode") == "bm25", F.col("score")).otherwise(-F.col("score"))
    hits = hits.groupBy("query_id", "hit_mode", *search.ITEM).agg((F.min(cost) + 0.0).alias("cost"))
    window = Window.partitionBy("query_id", "hit_mode").orderBy("cost", *search.ITEM)
    ranked = materialize(hits.withColumn("rank", F.row_number().over(window)), "ranked")
    out = None
    for other in ("bm25", "rerank"):
        part = search.rrf_fuse(ranked.filter("hit_mode = 'vector'"), ranked.filter(F.col("hit_mode") == other), rrf_k=RRF_K, k=K)
        part = part.select(F.lit(other).alias("other"), "query_id", "rank", *search.ITEM, "score")
        out = part if out is None else out.unionByName(part)
    return out


def collection_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The best hits within each collection; the statistics stay those of all."""
    groups = collections(spark, folder).select("doc_id", "collection")
    found = search.bm25_top_k(children(spark, folder), questions(spark, folder), 3, groups=groups)
    return found.select("collection", "query_id", "rank", *search.ITEM, "score")


def embedding_signatures(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunk_embeddings").select("doc_id", "provider", "model", "dimensions")
    return rows.join(collections(spark, folder), "doc_id").select("collection", "provider", "model", "dimensions").distinct()


def model_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Which models may be asked of which collections."""
    held = embedding_signatures(spark, folder)
    models = held.select("model").distinct()
    wanted = collections(spark, folder).select("collection").distinct().crossJoin(models)
    return search.check_models(held, wanted)


def attach_parents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").filter("role = 'child'").select("doc_id", "chunk_id").distinct()
    found = search.attach_parents(rows, table(spark, folder, "chunks"))
    return found.select("doc_id", "chunk_id", "parent_chunk_id", F.length("parent_text").alias("parent_chars"))


def document_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunks(spark, folder).filter("role = 'child' AND text IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("block_order", "split_index", "chunk_id", "text")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def indexed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).groupBy("doc_id").agg(F.count_if(F.col("role") == "child").alias("children"), F.count_if(F.col("role") == "parent").alias("parents"))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hits = materialize(_hybrid(spark, folder), "hits")
    full = search.attach_parents(hits, table(spark, folder, "chunks")).join(collections(spark, folder).select("doc_id", "source_path"), "doc_id", "left")
    return hits, context.pack_context(full, 2000)


def pack_context(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[1].drop("citations")


def quality_label(spark: SparkSession, folder: str) -> DataFrame:
    hits, packed = _packed(spark, folder)
    stats = questions(spark, folder).join(hits.filter("rank = 1").select("query_id", F.col("score").alias("top_score")), "query_id", "left")
    stats = stats.join(packed.select("query_id", "chars_used"), "query_id", "left").withColumns({"mode": F.lit("hybrid"), "reranked": F.lit(False)})
    return context.quality_label(stats).select("query_id", "mode", "top_score", "label")


def rerank(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.attach_parents(bm25_topk(spark, folder), table(spark, folder, "chunks"))
    return search.rerank(hits, questions(spark, folder), 3)


# -- evaluation: a document is relevant if it contains the query's longest token


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.array_sort(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    longest = F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return questions(spark, folder).select("query_id", longest["t"].alias("text_contains")).filter("text_contains IS NOT NULL")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that rules are looked for in; a repeated row says nothing new."""
    return table(spark, folder, "chunks").filter("role = 'child' AND text IS NOT NULL").select("doc_id", "text")


def rule_match(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.rule_match(_texts(spark, folder), _rules(spark, folder))


def _gold(spark: SparkSession, folder: str, relevant: DataFrame) -> DataFrame:
    """A query with rules has as many relevant documents as rules, one; without a match it expects none."""
    return questions(spark, folder).select("query_id").join(relevant.select("query_id").distinct().withColumn("gold_count", F.lit(1)), "query_id", "left").fillna(0, ["gold_count"])


def collapse_docs(spark: SparkSession, folder: str) -> DataFrame:
    hits = search.bm25_top_k(children(spark, folder), questions(spark, folder), POOL)
    return evaluation.collapse_documents(hits, rule_match(spark, folder), K)


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    """query_metrics of every mode, from pools of equal depth."""
    vector = materialize(_dense(spark, folder, POOL), "vector")
    lexical = materialize(search.bm25_top_k(children(spark, folder), questions(spark, folder), POOL), "lexical")
    fused = search.rrf_fuse(vector, lexical, rrf_k=RRF_K, k=POOL)
    answered = lexical.select("query_id").distinct()
    columns = ["query_id", "rank", "doc_id"]
    both = fused.join(answered, "query_id", "left_semi").select(*columns).unionByName(vector.join(answered, "query_id", "left_anti").select(*columns))
    rules = materialize(evaluation.rule_strings(_rules(spark, folder)), "rules")
    met = materialize(evaluation.rule_hits(_texts(spark, folder), rules), "met")
    pools = None
    for mode, hits in zip(MODES, (vector, lexical, both), strict=True):
        part = hits.select(*columns, F.lit(mode).alias("mode"))
        pools = part if pools is None else pools.unionByName(part)
    by = ["query_id", "mode"]
    gold = _gold(spark, folder, rules.join(met.select("t").distinct(), "t", "left_semi")).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    return materialize(evaluation.query_metrics(evaluation.collapse_documents(pools, lambda pairs: evaluation.matched(pairs, rules, met), K, by), gold, K, by), "metrics")


def query_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _metrics(spark, folder)
    return rows.select("mode", "query_id", *[F.round(c, 9).alias(c) for c in evaluation.METRICS])


def eval_modes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mode_summary(_metrics(spark, folder))


def mode_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mode_comparison(eval_modes(spark, folder))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.bootstrap_intervals(_metrics(spark, folder))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """One stored evaluation row per query and mode."""
    return table(spark, folder, "query_evals").select("query_id", "hit_mode", "first_relevant_rank", "relevant_in_top_k", "gold_count").distinct()


def _mean(spark: SparkSession, folder: str, value, name: str) -> DataFrame:
    return _stored(spark, folder).groupBy("hit_mode").agg(F.round(F.avg(value), 9).alias(name))


def hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _mean(spark, folder, F.when(F.col("first_relevant_rank") <= K, 1.0).otherwise(0.0), "hit_at_k")


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    found, gold = F.col("relevant_in_top_k"), F.col("gold_count")
    return _mean(spark, folder, F.when(gold <= 0, F.when(found == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), found / gold)), "recall_at_k")


def mrr(spark: SparkSession, folder: str) -> DataFrame:
    return _mean(spark, folder, F.when(F.col("first_relevant_rank") >= 1, 1.0 / F.col("first_relevant_rank")).otherwise(0.0), "mrr")


def ndcg_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """With the first relevant rank as the only gain known."""
    first, gold = F.col("first_relevant_rank"), F.col("gold_count")
    places = F.sequence(F.lit(1), F.greatest(F.least(gold, F.lit(K)), F.lit(1)))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    gain = F.when((first >= 1) & (first <= K), 1.0 / F.log2(first + 1.0)).otherwise(0.0)
    return _mean(spark, folder, F.when(gold <= 0, F.when(gain == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), gain / ideal)), "ndcg_at_k")


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_evals").select("query_id", "hit_mode", "latency_ms").distinct()
    return evaluation.percentiles(rows, "hit_mode", "latency_ms")


QUERIES = {
    "build_postings": build_postings, "doc_len": doc_len, "corpus_stats": corpus_stats, "bm25_scores": bm25_scores, "bm25_topk": bm25_topk,
    "vector_topk": vector_topk, "hybrid_topk": hybrid_topk, "rrf_fuse": rrf_fuse, "collection_filter": collection_filter,
    "embedding_signatures": embedding_signatures, "model_guard": model_guard, "attach_parents": attach_parents, "document_text": document_text,
    "indexed_counts": indexed_counts, "pack_context": pack_context, "quality_label": quality_label, "rerank": rerank, "rule_match": rule_match,
    "collapse_docs": collapse_docs, "query_metrics": query_metrics, "eval_modes": eval_modes, "mode_comparison": mode_comparison,
    "bootstrap_ci": bootstrap_ci, "hit_at_k": hit_at_k, "recall_at_k": recall_at_k, "mrr": mrr, "ndcg_at_k": ndcg_at_k,
    "latency_percentiles": latency_percentiles,
}

def _terms(column: str) -> str:
    folded = f"translate(lower({column}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{N}}]+')"


_KIDS = "kids AS (SELECT DISTINCT doc_id, chunk_id, text FROM chunks WHERE role = 'child' AND text IS NOT NULL)"
_TOKENS = f"{_KIDS}, tokens AS MATERIALIZED (SELECT doc_id, chunk_id, {_terms('text')} AS ts FROM kids)"
_COLLECTIONS = "collections AS (SELECT doc_id, coalesce(lower(trim(source)), 'default') AS collection, source_path FROM documents)"
# a phrase's occurrences are the places at which its terms stand one after another
_BM25 = f"""{_TOKENS},
{QUESTIONS},
asked AS MATERIALIZED (
  SELECT query_id, terms, count(*) AS qtf FROM (
    SELECT query_id, {_terms("w")} AS terms FROM (
      SELECT query_id, unnest(list_filter(regexp_extract_all(query, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2)[1:64]) AS w FROM questions))
  WHERE len(terms) > 0 GROUP BY 1, 2),
places AS (SELECT doc_id, chunk_id, ts, len(ts) AS dl, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS pos FROM tokens),
held AS MATERIALIZED (
  SELECT a.terms, p.doc_id, p.chunk_id, p.dl, count(*) AS tf
  FROM (SELECT DISTINCT terms FROM asked) a JOIN places p ON p.term = a.terms[1]
  WHERE len(a.terms) = 1 OR p.ts[p.pos : p.pos + len(a.terms) - 1] = a.terms GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(ts)::DOUBLE) AS avgdl FROM tokens),
weights AS (
  SELECT terms, n, avgdl, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf
  FROM (SELECT terms, count(*) AS df FROM held GROUP BY 1), stats),
bm25 AS MATERIALIZED (
  SELECT query_id, doc_id, chunk_id, round(-sum(idf * qtf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM held JOIN weights USING (terms) JOIN asked USING (terms) GROUP BY 1, 2, 3),
lexical AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id, chunk_id)::INT AS rank FROM bm25)"""


def _mock(column: str) -> str:
    return f"list_transform(range(8), lambda i: concat('0x', substr(sha256({column}), 1 + 8 * i, 8))::UBIGINT::DOUBLE / 4294967296 * 2 - 1)"


_DENSE = f"""points AS MATERIALIZED (SELECT doc_id, chunk_id, {_mock("text")} AS v FROM kids),
asks AS MATERIALIZED (SELECT query_id, {_mock("query")} AS q FROM questions),
dense AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id)::INT AS rank
    FROM (SELECT query_id, doc_id, chunk_id, round(list_cosine_similarity(q, v), 9) AS score FROM asks, points))
  WHERE rank <= {POOL})"""


def _fused(depth: int, k: int) -> str:
    return f"""answered AS (SELECT DISTINCT query_id FROM lexical),
sums AS (
  SELECT query_id, doc_id, chunk_id, min(r1) AS r1, min(r2) AS r2,
         round(coalesce(1 / (60::DOUBLE + min(r1)), 0) + coalesce(1 / (60::DOUBLE + min(r2)), 0), 9) AS score
  FROM (SELECT query_id, doc_id, chunk_id, rank AS r1, NULL::INT AS r2 FROM dense WHERE rank <= {depth}
        UNION ALL SELECT query_id, doc_id, chunk_id, NULL, rank FROM lexical WHERE rank <= {depth})
  WHERE query_id IN (FROM answered) GROUP BY 1, 2, 3),
hybrid AS MATERIALIZED (
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST)::INT AS rank, doc_id, chunk_id, score FROM sums)
  WHERE rank <= {k}
  UNION ALL SELECT query_id, rank, doc_id, chunk_id, score FROM dense WHERE rank <= {k} AND query_id NOT IN (FROM answered))"""


_HYBRID = f"WITH {_BM25}, {_DENSE}, {_fused(CANDIDATES, K)}"
_SPC = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_FAMILY = """child AS (SELECT DISTINCT doc_id, chunk_id, text, parent_chunk_id FROM chunks WHERE role = 'child'),
parent AS (SELECT DISTINCT doc_id, chunk_id AS parent_chunk_id, text AS parent_text FROM chunks WHERE role = 'parent')"""


def _strip(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '^{_SPC}', ''), '{_SPC}$', '')"


_PACK = rf"""{_HYBRID}, {_FAMILY}, {_COLLECTIONS},
full_hits AS (
  SELECT h.*, c.parent_chunk_id, source_path,
         coalesce(nullif({_strip("p.parent_text")}, ''), {_strip("c.text")}, '') AS body,
         row_number() OVER (PARTITION BY query_id, h.doc_id, coalesce(nullif(c.parent_chunk_id, ''), h.chunk_id) ORDER BY rank) AS first
  FROM hybrid h LEFT JOIN child c ON h.doc_id = c.doc_id AND h.chunk_id = c.chunk_id
  LEFT JOIN parent p ON c.doc_id = p.doc_id AND c.parent_chunk_id = p.parent_chunk_id LEFT JOIN collections o ON h.doc_id = o.doc_id),
bodies AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM full_hits WHERE first = 1 AND body <> ''),
heads AS (SELECT *, '[' || n || '] (' || coalesce(nullif(source_path, ''), doc_id::VARCHAR) || ')' || chr(10) AS header FROM bodies),
sized AS (SELECT *, length(header) + length(body) + 2 AS w FROM heads),
run AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
fit AS (SELECT *, 2000 - before - length(header) - 2 AS room, max((before + w > 2000)::INT) OVER (PARTITION BY query_id) = 1 AS truncated FROM run),
packed AS (
  SELECT query_id, count(*)::INT AS n_blocks, bool_or(truncated) AS truncated,
         regexp_replace(string_agg(header || CASE WHEN length(body) <= room THEN body ELSE left(body, (room - 1)::INT) || '…' END || chr(10) || chr(10), '' ORDER BY n), '{_SPC}$', '') AS context
  FROM fit WHERE room > 0 GROUP BY 1)"""

_RULES = r"""rules AS (
  SELECT query_id, list_max(list_transform(regexp_extract_all(lower(query), '[\p{L}\p{N}]+'), lambda t: struct_pack(n := length(t), t := t))).t AS rule
  FROM questions WHERE len(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) > 0),
relevant AS MATERIALIZED (SELECT DISTINCT r.query_id, k.doc_id FROM rules r JOIN kids k ON contains(lower(k.text), r.rule))"""
_GOLD = "gold AS (SELECT query_id, (query_id IN (SELECT query_id FROM relevant))::INT AS gold_count FROM questions)"
_METRICS = f"""WITH {_BM25}, {_DENSE}, {_fused(POOL, POOL)}, {_RULES}, {_GOLD},
pools AS (
  SELECT 'vector' AS mode, query_id, rank, doc_id FROM dense
  UNION ALL SELECT 'bm25', query_id, rank, doc_id FROM lexical WHERE rank <= {POOL}
  UNION ALL SELECT 'hybrid', query_id, rank, doc_id FROM hybrid),
docs AS (
  SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY min(rank), doc_id) AS rank FROM pools GROUP BY mode, query_id, doc_id),
judged AS (SELECT d.*, (r.doc_id IS NOT NULL)::INT AS rel FROM docs d LEFT JOIN relevant r ON d.query_id = r.query_id AND d.doc_id = r.doc_id WHERE d.rank <= {K}),
found AS (
  SELECT mode, query_id, sum(rel) AS found, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1.0::DOUBLE)) AS dcg FROM judged GROUP BY 1, 2),
scored AS (
  SELECT m.mode, g.query_id, gold_count, coalesce(found, 0) AS found, first, coalesce(dcg, 0) AS dcg
  FROM gold g CROSS JOIN (SELECT unnest(['vector', 'bm25', 'hybrid']) AS mode) m LEFT JOIN found s ON s.mode = m.mode AND s.query_id = g.query_id),
metrics AS MATERIALIZED (
  SELECT mode, query_id,
    CASE WHEN gold_count <= 0 THEN (found = 0)::INT::DOUBLE ELSE (first IS NOT NULL)::INT::DOUBLE END AS hit,
    CASE WHEN gold_count <= 0 THEN (found = 0)::INT::DOUBLE ELSE least(1.0::DOUBLE, found / gold_count) END AS recall,
    CASE WHEN gold_count <= 0 THEN (found = 0)::INT::DOUBLE ELSE coalesce(1.0::DOUBLE / first, 0) END AS reciprocal_rank,
    CASE WHEN gold_count <= 0 THEN (found = 0)::INT::DOUBLE ELSE least(1.0::DOUBLE, dcg) END AS ndcg
  FROM scored),
summary AS (
  SELECT mode, count(*) AS queries, round(avg(hit), 9) AS hit_at_k, round(avg(recall), 9) AS recall_at_k, round(avg(reciprocal_rank), 9) AS mrr, round(avg(ndcg), 9) AS ndcg_at_k
  FROM metrics GROUP BY 1)"""
_STORED = "WITH stored AS (SELECT DISTINCT query_id, hit_mode, first_relevant_rank AS f, relevant_in_top_k AS r, gold_count AS g FROM query_evals)"

SQL = {
    "build_postings": f"WITH {_TOKENS} SELECT term, doc_id, chunk_id, count(*)::INT AS tf, dl FROM (SELECT doc_id, chunk_id, len(ts)::INT AS dl, unnest(ts) AS term FROM tokens) GROUP BY ALL",
    "doc_len": f"WITH {_TOKENS} SELECT doc_id, chunk_id, len(ts)::INT AS dl FROM tokens",
    "corpus_stats": f"WITH {_TOKENS} SELECT count(*) AS n, round(avg(len(ts)::DOUBLE), 9) AS avgdl FROM tokens",
    "bm25_scores": f"WITH {_BM25} SELECT * FROM bm25",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM lexical WHERE rank <= {K}",
    "vector_topk": f"WITH {_KIDS}, {QUESTIONS}, {_DENSE} SELECT * FROM dense WHERE rank <= {K}",
    "hybrid_topk": f"{_HYBRID} SELECT * FROM hybrid",
    "rrf_fuse": """WITH best AS (
  SELECT query_id, hit_mode, doc_id, chunk_id, min(CASE WHEN hit_mode = 'bm25' THEN score ELSE -score END) AS cost
  FROM vector_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit_mode ORDER BY cost, doc_id, chunk_id) AS rank FROM best),
sums AS (
  SELECT other, query_id, doc_id, chunk_id, min(CASE WHEN hit_mode = 'vector' THEN rank END) AS r1, min(CASE WHEN hit_mode = other THEN rank END) AS r2
  FROM ranked, (SELECT unnest(['bm25', 'rerank']) AS other) WHERE hit_mode IN ('vector', other) GROUP BY ALL),
scored AS (SELECT *, round(coalesce(1 / (60::DOUBLE + r1), 0) + coalesce(1 / (60::DOUBLE + r2), 0), 9) AS score FROM sums)
SELECT other, query_id, rank, doc_id, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY other, query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST)::INT AS rank FROM scored) WHERE rank <= 5""",
    "collection_filter": f"""WITH {_BM25}, {_COLLECTIONS},
ranked AS (SELECT collection, query_id, b.doc_id, chunk_id, score, row_number() OVER (PARTITION BY collection, query_id ORDER BY score, b.doc_id, chunk_id)::INT AS rank FROM bm25 b JOIN collections c ON b.doc_id = c.doc_id)
SELECT * FROM ranked WHERE rank <= 3""",
    "embedding_signatures": f"WITH {_COLLECTIONS} SELECT DISTINCT collection, provider, model, dimensions FROM chunk_embeddings e JOIN collections c ON e.doc_id = c.doc_id",
    "model_guard": f"""WITH {_COLLECTIONS}, held AS (SELECT DISTINCT collection, model FROM chunk_embeddings e JOIN collections c ON e.doc_id = c.doc_id)
SELECT c.collection, m.model, NOT EXISTS (FROM held h WHERE h.collection = c.collection) OR EXISTS (FROM held h WHERE h.collection = c.collection AND h.model = m.model) AS allowed
FROM (SELECT DISTINCT collection FROM collections) c, (SELECT DISTINCT model FROM held) m""",
    "attach_parents": f"""WITH {_FAMILY} SELECT c.doc_id, c.chunk_id, c.parent_chunk_id, length(parent_text)::INT AS parent_chars
FROM child c LEFT JOIN parent p ON c.doc_id = p.doc_id AND c.parent_chunk_id = p.parent_chunk_id""",
    "document_text": "SELECT doc_id, string_agg(text, chr(10) ORDER BY block_order, split_index, chunk_id, text) AS text FROM (SELECT DISTINCT doc_id, chunk_id, block_order, split_index, text FROM chunks WHERE role = 'child' AND text IS NOT NULL) GROUP BY 1",
    "indexed_counts": "SELECT doc_id, count(*) FILTER (role = 'child') AS children, count(*) FILTER (role = 'parent') AS parents FROM (SELECT DISTINCT storage_id, doc_id, chunk_id, role, text, parent_chunk_id, split_index, block_type, block_order FROM chunks) GROUP BY 1",
    "pack_context": f"{_PACK} SELECT query_id, n_blocks, truncated, length(context)::INT AS chars_used, context FROM packed",
    "quality_label": f"""{_PACK}
SELECT q.query_id, 'hybrid' AS mode, h.score AS top_score,
       CASE WHEN h.score IS NULL OR coalesce(length(context), 0) = 0 THEN 'empty' WHEN h.score >= 0.025 THEN 'high' ELSE 'low' END AS label
FROM questions q LEFT JOIN (FROM hybrid WHERE rank = 1) h ON q.query_id = h.query_id LEFT JOIN packed p ON q.query_id = p.query_id""",
    "rerank": rf"""WITH {_BM25}, {_FAMILY},
texts AS (
  SELECT l.query_id, l.rank AS old, l.doc_id, l.chunk_id, list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS qs,
         list_distinct(regexp_extract_all(lower(coalesce(parent_text, c.text, '')), '[\p{{L}}\p{{N}}]+')) AS ps
  FROM lexical l JOIN questions q ON l.query_id = q.query_id LEFT JOIN child c ON l.doc_id = c.doc_id AND l.chunk_id = c.chunk_id
  LEFT JOIN parent p ON c.doc_id = p.doc_id AND c.parent_chunk_id = p.parent_chunk_id WHERE l.rank <= {K}),
scored AS (SELECT *, round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ps)) / len(qs) ELSE 0 END, 9) AS score FROM texts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old)::INT AS rank FROM scored)
SELECT query_id, rank, doc_id, chunk_id, score FROM ranked WHERE rank <= 3""",
    "rule_match": f"WITH {_KIDS}, {QUESTIONS}, {_RULES} SELECT * FROM relevant",
    "collapse_docs": f"""WITH {_BM25}, {_RULES},
docs AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id)::INT AS rank FROM lexical WHERE rank <= {POOL} GROUP BY query_id, doc_id)
SELECT d.query_id, d.rank, d.doc_id, (r.doc_id IS NOT NULL)::INT AS relevant FROM docs d LEFT JOIN relevant r ON d.query_id = r.query_id AND d.doc_id = r.doc_id WHERE d.rank <= {K}""",
    "query_metrics": f"{_METRICS} SELECT mode, query_id, round(hit, 9) AS hit, round(recall, 9) AS recall, round(reciprocal_rank, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg FROM metrics",
    "eval_modes": f"{_METRICS} SELECT * FROM summary",
    "mode_comparison": f"""{_METRICS},
wide AS (SELECT max(hit_at_k) FILTER (mode = 'hybrid') AS hh, max(hit_at_k) FILTER (mode = 'bm25') AS hb, max(hit_at_k) FILTER (mode = 'vector') AS hv,
         max(ndcg_at_k) FILTER (mode = 'hybrid') AS nh, max(ndcg_at_k) FILTER (mode = 'bm25') AS nb, max(ndcg_at_k) FILTER (mode = 'vector') AS nv FROM summary)
SELECT round(hh - hb, 9) AS hybrid_minus_bm25_hit, round(hh - hv, 9) AS hybrid_minus_vector_hit, round(nh - nb, 9) AS hybrid_minus_bm25_ndcg, round(nh - nv, 9) AS hybrid_minus_vector_ndcg FROM wide""",
    "hit_at_k": f"{_STORED} SELECT hit_mode, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_k FROM stored GROUP BY 1",
    "recall_at_k": f"{_STORED} SELECT hit_mode, round(avg(CASE WHEN g <= 0 THEN CASE WHEN r = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE least(1.0::DOUBLE, r / g) END), 9) AS recall_at_k FROM stored GROUP BY 1",
    "mrr": f"{_STORED} SELECT hit_mode, round(avg(CASE WHEN f >= 1 THEN 1.0::DOUBLE / f ELSE 0 END), 9) AS mrr FROM stored GROUP BY 1",
    "ndcg_at_k": f"""{_STORED},
gains AS (SELECT hit_mode, g, CASE WHEN f BETWEEN 1 AND 5 THEN 1.0::DOUBLE / log2(f + 1.0::DOUBLE) ELSE 0 END AS d,
          list_sum(list_transform(range(1, greatest(least(g, 5), 1) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) AS ideal FROM stored)
SELECT hit_mode, round(avg(CASE WHEN g <= 0 THEN CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE least(1.0::DOUBLE, d / ideal) END), 9) AS ndcg_at_k FROM gains GROUP BY 1""",
    "latency_percentiles": """WITH v AS (SELECT hit_mode, list(latency_ms ORDER BY latency_ms) AS l, avg(latency_ms) AS m FROM (SELECT DISTINCT query_id, hit_mode, latency_ms FROM query_evals) WHERE latency_ms IS NOT NULL GROUP BY 1)
SELECT hit_mode, round(m, 6) AS mean, l[round_even(0.5::DOUBLE * (len(l) - 1), 0)::INT + 1] AS p50, l[round_even(0.95::DOUBLE * (len(l) - 1), 0)::INT + 1] AS p95, l[len(l)] AS max FROM v""",
}
