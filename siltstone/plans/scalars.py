"""Queries on single rows: hashes, vectors, slices, parsing in expressions, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators.chunking import gaps, role
from siltstone.operators.search import dense_scores, dense_top_k, top_k
from siltstone.plans.tables import children, questions, table
from siltstone.sources.corpus import corpus_fingerprint
from siltstone.sources.files import extension, route


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", V.content_hash(F.col("text")).alias("content_hash"))


def mock_embed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", V.mock_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", *[F.round(F.col("v")[i], 12).alias(f"v{i}") for i in range(8)])


def pack_float32(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", V.to_float32(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.size("v").alias("dims"), F.col("v")[0].alias("first_f32"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return rows, rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"))


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    return dense_scores(rows, asked, V.cosine(F.col("q_vector"), F.col("vector"))).select("q_id", "vec_id", "score")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(cosine_pairs(spark, folder), 5, keys=["vec_id"], by="q_id")


def dense_topk_arrow(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    return dense_top_k(rows, asked.withColumnRenamed("q_vector", "vector"), 5, keys=["vec_id"], query_key="q_id")


def slugify(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


def hard_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(T.hard_slices(F.col("text"), 1000)).alias("part", "piece"))
    return rows.select("doc_id", "part", "piece")


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    unix = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(F.regexp_replace(unix, "\n$", ""), "\n")
    rows = table(spark, folder, "documents").filter("text <> ''").select("doc_id", lines.alias("lines")).withColumn("n", F.size("lines"))
    rows = rows.select("doc_id", "n", "lines", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(50))).alias("win_index", "at"))
    rows = rows.withColumn("text", T.strip(F.array_join(F.slice("lines", F.col("at") + 1, 50), "\n"))).filter("text <> ''")
    return rows.select("doc_id", "win_index", (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + 50, F.col("n")).alias("end_line"), F.length("text").alias("n_chars"))


def parse_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("ord", "text"))
    return rows.select("doc_id", F.concat(F.lit("p_"), F.col("ord").cast("string")).alias("block_id"), "ord", "text")


def render_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as `name=value` texts."""
    columns = ["p_partkey", "p_name", "p_brand"]
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns]
    return table(spark, folder, "part").select(F.col("p_partkey").alias("row_index"), F.concat_ws(", ", *cells).alias("text"))


def route_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", route(F.col("source_path"), F.col("mime_type")).alias("parser"))


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "documents").count()
    whole = [("whole", corpus_fingerprint("documents", None, None)), ("sized", corpus_fingerprint("documents", n, 300))]
    return spark.createDataFrame(whole, "name string, fingerprint string")


def doc_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("file://"), "source_path").alias("source_uri"),
        F.coalesce(F.nullif(F.substring(extension(F.col("source_path")), 2, 100), F.lit("")), F.lit("unknown")).alias("doc_type"),
        V.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size"),
    )


def json_external_id(spark: SparkSession, folder: str) -> DataFrame:
    found = F.expr("try_variant_get(try_parse_json(extra_json), '$.external_id', 'string')")
    return table(spark, folder, "documents").select("doc_id", found.alias("external_id"))


def lookup_source_path(spark: SparkSession, folder: str) -> DataFrame:
    """The stored hash and documents of every path that a scan names."""
    asked = table(spark, folder, "source_scans").select("source_path").distinct()
    return table(spark, folder, "documents").select("doc_id", "source_path").join(asked, "source_path", "left_semi").select("doc_id", "source_path")


def query_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("query_id", F.posexplode(T.query_tokens(F.col("query"))).alias("pos", "token"))


def hit_preview(spark: SparkSession, folder: str) -> DataFrame:
    return children(spark, folder).select("doc_id", "chunk_id", T.preview(F.col("text")).alias("preview"))


def chunk_roles(spark: SparkSession, folder: str) -> DataFrame:
    """What the type of each chunk's block would make it."""
    rows = table(spark, folder, "chunks").select("storage_id", "block_type").distinct()
    return rows.select("storage_id", "block_type", role(F.col("block_type")).alias("role"))


def interval_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """What the ship dates of an order's lines, each with as many days as its quantity, leave of the year after it."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    start = day("l_shipdate")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))
    begin = day("o_orderdate")
    ranges = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), begin.alias("range_start"), (begin + 365).alias("range_end"))
    return gaps(lines, ranges, ["key"])


QUERIES = {
    "content_hash": content_hash, "mock_embed": mock_embed, "pack_float32": pack_float32, "cosine_pairs": cosine_pairs, "dense_topk": dense_topk,
    "dense_topk_arrow": dense_topk_arrow, "slugify": slugify, "hard_split": hard_split, "line_windows": line_windows, "parse_text": parse_text,
    "render_rows": render_rows, "route_format": route_format, "corpus_fingerprint": fingerprint, "doc_metadata": doc_metadata,
    "json_external_id": json_external_id, "lookup_source_path": lookup_source_path, "query_tokens": query_tokens, "hit_preview": hit_preview,
    "chunk_roles": chunk_roles, "interval_gaps": interval_gaps,
}

_UNIX = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_WORD = "regexp_extract_all(query, '[A-Za-z0-9_]+')"
QUESTIONS = "questions AS (SELECT query_id, max(query_text) AS query FROM query_evals GROUP BY 1 HAVING max(query_text) IS NOT NULL)"
_EXT = r"lower(regexp_extract(source_path, '[^/](\.[^./]+)$', 1))"
_PAIRS = """pairs AS (
  SELECT q.vec_id AS q_id, e.vec_id,
         round(CASE WHEN list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) > 0 AND list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) > 0
               THEN list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) ELSE 0 END, 9) AS score
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"""
_TOP = f"""WITH {_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT q_id, vec_id, score, rank FROM ranked WHERE rank <= 5"""

SQL = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "mock_embed": """WITH raw AS (
  SELECT doc_id, list_transform(range(8), lambda i: concat('0x', substr(sha256(text), 1 + 8 * i, 8))::UBIGINT::DOUBLE / 4294967296 * 2 - 1) AS v
  FROM documents),
normed AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw)
SELECT doc_id, """ + ", ".join(f"round(v[{i + 1}] / n, 12) AS v{i}" for i in range(8)) + " FROM normed",
    "pack_float32": "SELECT vec_id, len(embedding)::INT AS dims, embedding[1]::FLOAT AS first_f32 FROM embeddings",
    "cosine_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "dense_topk": _TOP,
    "dense_topk_arrow": _TOP,
    "slugify": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'block') AS slug FROM part",
    "hard_split": """SELECT doc_id, i::INT AS part, substr(text, 1 + i * 1000, 1000) AS piece
FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)""",
    "line_windows": rf"""WITH lines AS (SELECT doc_id, string_split(regexp_replace({_UNIX}, '\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
wins AS (SELECT doc_id, l, len(l) AS n, unnest(range(CAST(ceil(len(l) / 50.0) AS BIGINT))) AS i FROM lines),
texts AS (SELECT doc_id, i, n, regexp_replace(regexp_replace(array_to_string(l[i * 50 + 1 : i * 50 + 50], chr(10)), '^{_SP}', ''), '{_SP}$', '') AS t FROM wins)
SELECT doc_id, i::INT AS win_index, (i * 50 + 1)::INT AS start_line, least(i * 50 + 50, n)::INT AS end_line, length(t)::INT AS n_chars FROM texts WHERE t <> ''""",
    "parse_text": rf"""WITH pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split({_UNIX}, chr(10) || chr(10)),
         lambda p: regexp_replace(regexp_replace(p, '^{_SP}', ''), '{_SP}$', '')), lambda p: p <> '') AS ps FROM documents),
rows AS (SELECT doc_id, unnest(range(len(ps))) AS i, ps FROM pieces)
SELECT doc_id, 'p_' || i AS block_id, i::INT AS ord, ps[i + 1] AS text FROM rows""",
    "render_rows": "SELECT p_partkey AS row_index, 'p_partkey=' || p_partkey || ', p_name=' || coalesce(p_name, 'None') || ', p_brand=' || coalesce(p_brand, 'None') AS text FROM part",
    "route_format": rf"""SELECT doc_id, CASE
  WHEN e = '.pdf' OR m = 'application/pdf' THEN 'pdf'
  WHEN e = '.pptx' OR m = 'application/vnd.openxmlformats-officedocument.presentationml.presentation' THEN 'pptx'
  WHEN e = '.docx' OR m = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' THEN 'docx'
  WHEN e IN ('.py', '.js', '.jsx', '.ts', '.tsx', '.go', '.rs', '.java', '.rb', '.cpp', '.c', '.h', '.cs')
    OR m IN ('text/x-python', 'application/javascript', 'text/javascript') THEN 'code'
  WHEN e IN ('.html', '.htm') OR m = 'text/html' THEN 'html'
  WHEN e IN ('.md', '.mdx', '.markdown') OR m = 'text/markdown' THEN 'markdown'
  WHEN e IN ('.json', '.yaml', '.yml', '.csv', '.tsv')
    OR m IN ('application/json', 'application/yaml', 'text/yaml', 'text/csv', 'text/tab-separated-values') THEN 'structured'
  WHEN e IN ('.txt', '.log', '.rst', '.text') OR m = 'text/plain' THEN 'text' END AS parser
FROM (SELECT doc_id, {_EXT} AS e, mime_type AS m FROM documents)""",
    "corpus_fingerprint": """SELECT 'whole' AS name, substr(sha256('{"dataset_id": "documents", "max_docs": null, "max_queries": null}'), 1, 16) AS fingerprint
UNION ALL SELECT 'sized', substr(sha256('{"dataset_id": "documents", "max_docs": ' || (SELECT count(*) FROM documents) || ', "max_queries": 300}'), 1, 16)""",
    "doc_metadata": rf"""SELECT doc_id, 'file://' || source_path AS source_uri, coalesce(nullif(substr({_EXT}, 2), ''), 'unknown') AS doc_type,
sha256(text) AS content_hash, strlen(text) AS file_size FROM documents""",
    "json_external_id": "SELECT doc_id, CASE WHEN json_valid(extra_json) THEN json_extract_string(extra_json, '$.external_id') END AS external_id FROM documents",
    "lookup_source_path": "SELECT doc_id, source_path FROM documents WHERE source_path IN (SELECT source_path FROM source_scans)",
    "query_tokens": f"""WITH {QUESTIONS},
lists AS (SELECT query_id, list_filter({_WORD}, lambda w: length(w) >= 2)[1:64] AS ws FROM questions),
rows AS (SELECT query_id, ws, unnest(range(len(ws))) AS i FROM lists)
SELECT query_id, i::INT AS pos, ws[i + 1] AS token FROM rows""",
    "hit_preview": "SELECT DISTINCT doc_id, chunk_id, replace(left(text, 80), chr(10), ' ') AS preview FROM chunks WHERE role = 'child' AND text IS NOT NULL",
    "chunk_roles": """SELECT DISTINCT storage_id, block_type, CASE
  WHEN block_type IN ('document', 'page', 'slide', 'section', 'module', 'code_container', 'table') THEN 'parent'
  WHEN block_type IN ('paragraph', 'code_block', 'code_symbol', 'table_row', 'list_item', 'shape', 'note', 'figure', 'record') THEN 'child' END AS role FROM chunks""",
    "interval_gaps": """WITH lines AS (SELECT l_orderkey AS key, datediff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, datediff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT AS e FROM lineitem),
ranges AS (SELECT o_orderkey AS key, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS rs FROM orders),
clipped AS (
  SELECT r.key, rs, greatest(s, rs) AS a, least(e, rs + 365) AS b FROM ranges r JOIN lines l ON r.key = l.key WHERE e > s AND e > rs AND s < rs + 365
  UNION ALL SELECT key, rs, rs + 365, rs + 365 FROM ranges),
before AS (SELECT *, coalesce(max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rs) AS g FROM clipped)
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY g) - 1)::INT AS gap_index, g::INT AS gap_start, a::INT AS gap_end FROM before WHERE a > g""",
}
