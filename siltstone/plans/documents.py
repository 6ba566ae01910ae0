"""Queries on parsing, chunking and incremental maintenance."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_hash, paragraphs
from siltstone.functions.vectors import mock_embedding
from siltstone.operators import chunking, incremental
from siltstone.plans.retrieval import _KIDS
from siltstone.plans.tables import children, chunks, table
from siltstone.session import materialize
from siltstone.sources import corpus, files
from siltstone.sources.parsers.office import map_elements

# -- parsing


def _as_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's path, and its extracted text as content."""
    rows = table(spark, folder, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.col("source_path").alias("path"), F.encode("text", "UTF-8").alias("content"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _as_files(spark, folder)
    parsed = materialize(files.parse(rows, extracted=True), "parsed").join(rows.select("doc_id", "path"), "path")
    return parsed.select("doc_id", "raw_text", "error", "blocks")


def parse_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of all documents, each parsed by the parser of its path, or where that cannot
    read the extracted text (PDF, Word and invalid JSON), cut into paragraphs."""
    return _blocks(spark, folder).select("doc_id", F.inline("blocks")).drop("location", "hierarchy_path")


def parse_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the parser of their path could not read; their blocks are paragraphs."""
    reason = F.regexp_extract("error", "^[^:;]+: [^:;]+", 0)
    return _blocks(spark, folder).filter("error IS NOT NULL").select("doc_id", reason.alias("error"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents parsed and cut into parent and child chunks."""
    parsed = materialize(_blocks(spark, folder), "blocks")
    blocks = parsed.select("doc_id", F.inline("blocks"))
    return chunking.chunk_documents(blocks, parsed.select("doc_id", "raw_text"))


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """The paths that a walk would take."""
    rows = table(spark, folder, "documents").select("doc_id", "source_path")
    return rows.filter(files.indexable(F.col("source_path"))).select("doc_id", "source_path", files.extension(F.col("source_path")).alias("ext"))


def parse_files(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of all text files, by the parser."""
    rows = _as_files(spark, folder).filter(files.extension(F.col("path")).isin(".txt", ".log", ".rst", ".text"))
    parsed = files.parse(rows).join(rows.select("doc_id", "path"), "path")
    return parsed.select("doc_id", F.inline("blocks")).select("doc_id", "block_id", "block_type", "ord", "text")


#: Per format, a file about a customer, as an expression of its columns.
FORMS = {
    "md": "concat('---\\nkey: ', c_custkey, '\\n---\\n# ', c_name, '\\n\\nSegment ', c_mktsegment, '\\n## Code\\n```\\nid = ', c_custkey, '\\n```\\n')",
    "html": "concat('<h1>', c_name, '</h1><p>Segment <b>', c_mktsegment, '</b><ul><li>Key ', c_custkey, '</ul><nav><p>gone</p></nav>')",
    "json": "concat('{\"key\": ', c_custkey, ', \"name\": \"', c_name, '\"}')",
    "yaml": "concat('key: ', c_custkey, '\\nname: ', c_name, '\\n')",
    "csv": "concat('key,name\\n', c_custkey, ',', c_name, '\\n', c_custkey, '\\n')",
    "py": "concat('class C', c_custkey, ':\\n    def key(self):\\n        return ', c_custkey, '\\n')",
    "js": "concat('function key', c_custkey, '(a) { return a; }\\n')",
}


def parse_formats(spark: SparkSession, folder: str) -> DataFrame:
    """A file of each format about every customer, parsed."""
    rows = table(spark, folder, "customer")
    kinds = F.explode(F.array(*[F.struct(F.lit(e).alias("ext"), F.expr(form).alias("body")) for e, form in FORMS.items()]))
    made = rows.select("c_custkey", kinds.alias("f")).select(
        F.concat(F.col("c_custkey").cast("string"), F.lit("."), "f.ext").alias("path"), F.encode("f.body", "UTF-8").alias("content")
    )
    blocks = files.parse(made).select("path", F.inline("blocks"))
    return blocks.select("path", "block_seq", "block_type", "text", "parent_block_id")


def pdf_map_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of page elements: the paragraphs of every document, every fourth a title, three on a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, b["block_type"]) for doc, text in zip(pdf["doc_id"], pdf["elements"], strict=True) for b in map_elements(json.loads(text)).blocks]
            yield pd.DataFrame(rows, columns=["doc_id", "block_type"])

    def element(text: Column, i: Column) -> Column:
        kind = F.when(i % 4 == 0, "Title").otherwise("NarrativeText")
        return F.struct(kind.alias("type"), text.alias("text"), F.struct((F.floor(i / 3) + 1).alias("page_number")).alias("metadata"))

    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", F.to_json(F.transform(paragraphs(F.col("text")), element)).alias("elements"))
    return rows.mapInPandas(run, "doc_id long, block_type string").groupBy("doc_id", "block_type").agg(F.count(F.lit(1)).alias("blocks"))


# -- chunking


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    """A tree of blocks: regions are sections, nations list items without text below them, customers
    paragraphs below those, orders notes below those."""
    def level(name: str, kind: str, key: str, above: str | None, up: str | None, text: str | None) -> DataFrame:
        block = lambda prefix, c: F.concat(F.lit(f"{prefix}_"), F.col(c).cast("string"))
        parent = block(above, up) if above else F.lit(None).cast("string")
        return table(spark, folder, name).select(
            F.lit(0).alias("doc_id"), block(name, key).alias("block_id"), F.lit(kind).alias("block_type"), parent.alias("parent_block_id"),
            (F.col(text) if text else F.lit("")).alias("text"),
        )

    return (
        level("region", "section", "r_regionkey", None, None, "r_name")
        .unionByName(level("nation", "list_item", "n_nationkey", "region", "n_regionkey", None))
        .unionByName(level("customer", "paragraph", "c_custkey", "nation", "c_nationkey", "c_name"))
        .unionByName(level("orders", "note", "o_orderkey", "customer", "o_custkey", "o_orderpriority"))
    )


def nearest_parent(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.owners(_tree(spark, folder)).select("block_id", "owner_id")


def descendant_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.descendant_leaves(_tree(spark, folder)).select("parent_id", "leaf_id")


def parent_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every parent chunk from its children's."""
    rows = chunks(spark, folder)
    leaves = rows.filter("role = 'child' AND parent_chunk_id IS NOT NULL AND text IS NOT NULL")
    keys = ["doc_id", "parent_chunk_id"]
    heads = leaves.select(*keys).distinct().withColumn("text", F.lit(""))
    parts = leaves.select(*keys, "block_order", "split_index", "chunk_id", "text")
    return chunking.assemble_parents(heads, parts, keys, ["block_order", "split_index", "chunk_id"])


def split_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", chunking.splitter()("text").alias("pieces"))
    return rows.select("doc_id", F.posexplode("pieces").alias("part", "piece"))


def child_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one block."""
    rows = table(spark, folder, "documents").filter("text IS NOT NULL")
    blocks = rows.select("doc_id", F.lit(0).alias("block_seq"), F.lit("p_0").alias("block_id"), F.lit("paragraph").alias("block_type"), "text")
    return chunking.child_chunks(blocks).select("doc_id", "chunk_id", "split_index", "char_count", "is_split")


def chunk_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every document's chunks: within (the limits), parents (each child has one that is
    there), ordered (numbered from 0 without gaps)."""
    rows = materialize(chunk_documents(spark, folder), "chunks")
    most = F.when(F.col("role") == "parent", chunking.PARENT_MAX).otherwise(chunking.CHILD_MAX)
    sums = rows.groupBy("doc_id").agg(
        F.every(F.length("text") <= most).alias("within"),
        ((F.min("ord") == 0) & (F.max("ord") + 1 == F.count(F.lit(1))) & (F.count_distinct("ord") == F.count(F.lit(1)))).alias("ordered"),
    )
    heads = rows.filter("role = 'parent'").select("doc_id", F.col("chunk_id").alias("parent_chunk_id"), F.lit(True).alias("there"))
    held = rows.filter("role = 'child'").join(heads, ["doc_id", "parent_chunk_id"], "left")
    held = held.groupBy("doc_id").agg(F.every(F.coalesce("there", F.lit(False)) | F.col("parent_chunk_id").isNull()).alias("parents"))
    return sums.join(held, "doc_id").select("doc_id", "within", "parents", "ordered")


def split_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces: within (the limit), whole (a text that fits is one piece), complete (no
    more than a last piece that is too short is lost), begins (the first piece is the text's beginning)."""
    pieces = split_text(spark, folder).groupBy("doc_id").agg(
        F.max(F.length("piece")).alias("longest"), F.sum(F.length("piece")).alias("chars"), F.count(F.lit(1)).alias("n"), F.min_by("piece", "part").alias("first")
    )
    rows = table(spark, folder, "documents").select("doc_id", "text").join(pieces, "doc_id")
    return rows.select(
        "doc_id", (F.col("longest") <= chunking.CHILD_MAX).alias("within"),
        ((F.length("text") > chunking.CHILD_MAX) | ((F.col("n") == 1) & (F.col("first") == F.col("text")))).alias("whole"),
        (F.col("chars") > F.length("text") - chunking.CHILD_MIN).alias("complete"), F.col("text").startswith(F.col("first")).alias("begins"),
    )


# -- maintenance


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    scans = table(spark, folder, "source_scans").select("source_path", "scanned_at", clean_hash(F.col("content_hash")).alias("content_hash")).dropna()
    best = scans.groupBy("source_path").agg(F.max(F.struct("scanned_at", "content_hash")).alias("s"))
    return best.select("source_path", "s.content_hash")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source_path", clean_hash(F.col("content_hash")).alias("content_hash"))


def incremental_skip(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.change_status(_newest(spark, folder), _stored(spark, folder)).select("source_path", "status")


def upsert_replace(spark: SparkSession, folder: str) -> DataFrame:
    old = _stored(spark, folder).select("source_path", "content_hash", F.lit(1).alias("version"))
    new = incremental.change_status(_newest(spark, folder), _stored(spark, folder)).filter("status <> 'skipped'")
    return incremental.upsert(old, new.select("source_path", "content_hash", F.lit(2).alias("version")))


def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.index_summary(incremental_skip(spark, folder))


def embed_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts, distinct texts and embeddings saved."""
    rows = incremental.embed_distinct(children(spark, folder), mock_embedding(F.col("text")), ["doc_id", "chunk_id"])
    sums = rows.agg(F.count("vector").alias("n_texts"), F.countDistinct("text_hash").alias("n_distinct"))
    return sums.select("n_texts", "n_distinct", (F.col("n_texts") - F.col("n_distinct")).alias("n_saved"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements from the stored hits: the documents of queries that found something relevant."""
    rows = table(spark, folder, "query_evals").select("query_id", (F.col("relevant_in_top_k") > 0).cast("int").alias("relevance"), F.explode("hit_ids").alias("hit"))
    return rows.select("query_id", F.expr("try_cast(hit AS bigint)").alias("doc_id"), "relevance").filter("doc_id IS NOT NULL").distinct()


def corpus_subset(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    half = documents.count() * 4 // 5
    return corpus.corpus_subset(documents, _judged(spark, folder), half)[0].select("kind", "doc_id")


QUERIES = {
    "parse_documents": parse_documents, "parse_errors": parse_errors, "chunk_documents": chunk_documents, "scan_files": scan_files, "parse_files": parse_files, "parse_formats": parse_formats,
    "pdf_map_elements": pdf_map_elements, "nearest_parent": nearest_parent, "descendant_leaves": descendant_leaves, "parent_assembly": parent_assembly,
    "split_text": split_text, "chunk_invariants": chunk_invariants, "split_invariants": split_invariants, "child_chunks": child_chunks, "incremental_skip": incremental_skip, "upsert_replace": upsert_replace,
    "index_summary": index_summary, "embed_dedup": embed_dedup, "corpus_subset": corpus_subset,
}

_TREE = """tree AS (
  SELECT 'region_' || r_regionkey AS b, 'section' AS kind, NULL AS up, r_name AS text FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'list_item', 'region_' || n_regionkey, '' FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'paragraph', 'nation_' || c_nationkey, c_name FROM customer
  UNION ALL SELECT 'orders_' || o_orderkey, 'note', 'customer_' || o_custkey, o_orderpriority FROM orders)"""
_HASH = "regexp_replace(lower(trim(content_hash)), '^sha256:', '')"
_NEWEST = f"""newest AS (
  SELECT source_path, h FROM (
    SELECT source_path, nullif({_HASH}, '') AS h, row_number() OVER (PARTITION BY source_path ORDER BY scanned_at DESC, {_HASH} DESC) AS r
    FROM source_scans WHERE nullif({_HASH}, '') IS NOT NULL AND source_path IS NOT NULL AND scanned_at IS NOT NULL) WHERE r = 1),
stored AS (SELECT source_path, nullif({_HASH}, '') AS h FROM documents),
status AS (
  SELECT n.source_path, n.h, CASE WHEN s.source_path IS NULL THEN 'new' WHEN n.h IS NOT DISTINCT FROM s.h THEN 'skipped' ELSE 'changed' END AS status
  FROM newest n LEFT JOIN stored s ON n.source_path = s.source_path)"""

_SPC = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_STRIPPED = f"regexp_replace(regexp_replace(text, '^{_SPC}', ''), '{_SPC}$', '')"
_PARAGRAPHS = f"""pieces AS (
  SELECT doc_id, source_path, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)),
         lambda p: regexp_replace(regexp_replace(p, '^{_SPC}', ''), '{_SPC}$', '')), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL)"""
_SUFFIX = r"lower(regexp_extract(source_path, '[^/](\.[^./]+)$', 1))"

SQL = {
    "scan_files": f"""SELECT doc_id, source_path, {_SUFFIX} AS ext FROM documents
WHERE NOT list_bool_or(list_transform(string_split(source_path, '/'), lambda p: starts_with(p, '.')))
  AND len(list_intersect(string_split(source_path, '/')[:-2], ['.git', '.hg', '.svn', '.venv', 'venv', 'node_modules', '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache', 'dist', 'build', '.tox'])) = 0
  AND {_SUFFIX} IN ('.pdf', '.pptx', '.docx', '.py', '.js', '.jsx', '.ts', '.tsx', '.go', '.rs', '.java', '.rb', '.cpp', '.c', '.h', '.cs', '.html', '.htm', '.md', '.mdx', '.markdown', '.json', '.yaml', '.yml', '.csv', '.tsv', '.txt', '.log', '.rst', '.text')""",
    "parse_files": f"""WITH {_PARAGRAPHS}, own AS (SELECT * FROM pieces WHERE {_SUFFIX} IN ('.txt', '.log', '.rst', '.text'))
SELECT doc_id, 'doc_root' AS block_id, 'document' AS block_type, 0 AS ord, '' AS text FROM own
UNION ALL SELECT doc_id, 'p_' || i, 'paragraph', i::INT, ps[i + 1] FROM (SELECT doc_id, ps, unnest(range(len(ps))) AS i FROM own)""",
    "parse_errors": f"""SELECT * FROM (SELECT doc_id, CASE
  WHEN {_SUFFIX} IN ('.docx', '.pptx') THEN 'ParseError: not a zip archive' WHEN {_SUFFIX} = '.pdf' THEN 'ValueError: PDF pages need an element source'
  WHEN {_SUFFIX} = '.json' AND NOT json_valid(text) THEN 'ParseError: invalid JSON' END AS error FROM documents WHERE text IS NOT NULL) WHERE error IS NOT NULL""",
    "parse_formats": """WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer)
SELECT k || '.' || ext AS path, seq::INT AS block_seq, kind AS block_type, text, parent AS parent_block_id FROM (
  SELECT k, unnest([
    {'ext': 'md', 'seq': 0, 'kind': 'section', 'text': n, 'parent': NULL},
    {'ext': 'md', 'seq': 1, 'kind': 'paragraph', 'text': 'Segment ' || m, 'parent': 'sec_1'},
    {'ext': 'md', 'seq': 2, 'kind': 'section', 'text': 'Code', 'parent': 'sec_1'},
    {'ext': 'md', 'seq': 3, 'kind': 'code_block', 'text': 'id = ' || k, 'parent': 'sec_2'},
    {'ext': 'html', 'seq': 0, 'kind': 'section', 'text': n, 'parent': NULL},
    {'ext': 'html', 'seq': 1, 'kind': 'paragraph', 'text': 'Segment ' || m, 'parent': 'sec_1'},
    {'ext': 'html', 'seq': 2, 'kind': 'list_item', 'text': 'Key ' || k, 'parent': 'sec_1'},
    {'ext': 'json', 'seq': 0, 'kind': 'document', 'text': '', 'parent': NULL},
    {'ext': 'json', 'seq': 1, 'kind': 'record', 'text': '{"key": ' || k || '}', 'parent': 'doc_root'},
    {'ext': 'json', 'seq': 2, 'kind': 'record', 'text': '{"name": "' || n || '"}', 'parent': 'doc_root'},
    {'ext': 'yaml', 'seq': 0, 'kind': 'document', 'text': '', 'parent': NULL},
    {'ext': 'yaml', 'seq': 1, 'kind': 'record', 'text': 'key: ' || k, 'parent': 'doc_root'},
    {'ext': 'yaml', 'seq': 2, 'kind': 'record', 'text': 'name: ' || n, 'parent': 'doc_root'},
    {'ext': 'csv', 'seq': 0, 'kind': 'document', 'text': '', 'parent': NULL},
    {'ext': 'csv', 'seq': 1, 'kind': 'table_row', 'text': 'key=' || k || ', name=' || n, 'parent': 'doc_root'},
    {'ext': 'csv', 'seq': 2, 'kind': 'table_row', 'text': 'key=' || k || ', name=None', 'parent': 'doc_root'},
    {'ext': 'py', 'seq': 0, 'kind': 'module', 'text': '', 'parent': NULL},
    {'ext': 'py', 'seq': 1, 'kind': 'code_container', 'text': 'class C' || k || ':', 'parent': 'module'},
    {'ext': 'py', 'seq': 2, 'kind': 'code_symbol', 'text': 'def key(self):' || chr(10) || '        return ' || k, 'parent': 'sym_0'},
    {'ext': 'js', 'seq': 0, 'kind': 'module', 'text': '', 'parent': NULL},
    {'ext': 'js', 'seq': 1, 'kind': 'code_symbol', 'text': 'function key' || k || '(a) { return a; }', 'parent': 'module'}], recursive := true) FROM c)""",
    "pdf_map_elements": f"""WITH {_PARAGRAPHS}, n AS (SELECT doc_id, len(ps) AS n FROM pieces WHERE len(ps) > 0),
kinds AS (SELECT doc_id, 'page' AS block_type, (n - 1) // 3 + 1 AS blocks FROM n UNION ALL SELECT doc_id, 'section', (n - 1) // 4 + 1 FROM n UNION ALL SELECT doc_id, 'paragraph', n - ((n - 1) // 4 + 1) FROM n)
SELECT * FROM kinds WHERE blocks > 0""",
    "chunk_invariants": f"SELECT doc_id, TRUE AS within, TRUE AS parents, TRUE AS ordered FROM documents WHERE {_STRIPPED} <> ''",
    "split_invariants": "SELECT doc_id, TRUE AS within, TRUE AS whole, TRUE AS complete, TRUE AS begins FROM documents WHERE text <> ''",
    "nearest_parent": f"""WITH RECURSIVE {_TREE},
up AS (
  SELECT b, up AS a FROM tree
  UNION ALL SELECT u.b, t.up FROM up u JOIN tree t ON u.a = t.b WHERE t.kind <> 'section')
SELECT t.b AS block_id, max(CASE WHEN p.kind = 'section' THEN u.a END) AS owner_id
FROM tree t LEFT JOIN up u ON t.b = u.b LEFT JOIN tree p ON u.a = p.b GROUP BY 1""",
    "descendant_leaves": f"""WITH RECURSIVE {_TREE},
up AS (
  SELECT b, up AS a FROM tree WHERE kind <> 'section' AND text <> ''
  UNION ALL SELECT u.b, t.up FROM up u JOIN tree t ON u.a = t.b)
SELECT u.a AS parent_id, u.b AS leaf_id FROM up u JOIN tree t ON u.a = t.b WHERE t.kind = 'section'""",
    "parent_assembly": r"""WITH leaves AS (
  SELECT DISTINCT doc_id, parent_chunk_id, block_order, split_index, chunk_id, text FROM chunks
  WHERE role = 'child' AND parent_chunk_id IS NOT NULL AND text IS NOT NULL),
joined AS (SELECT doc_id, parent_chunk_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_order, split_index, chunk_id) FILTER (text <> ''), '') AS t FROM leaves GROUP BY 1, 2),
cut AS (
  SELECT doc_id, parent_chunk_id, CASE WHEN length(t) <= 6000 THEN t
         ELSE regexp_replace(left(t, 5993), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '') || chr(10) || chr(10) || '[...]' END AS text FROM joined)
SELECT *, length(text)::INT AS char_count FROM cut""",
    "incremental_skip": f"WITH {_NEWEST} SELECT source_path, status FROM status",
    "upsert_replace": f"""WITH {_NEWEST}, incoming AS (SELECT source_path, h FROM status WHERE status <> 'skipped')
SELECT source_path, h AS content_hash, 1 AS version FROM stored WHERE source_path NOT IN (SELECT source_path FROM incoming)
UNION ALL SELECT source_path, h, 2 FROM incoming""",
    "index_summary": f"WITH {_NEWEST} SELECT status, count(*) AS n FROM status GROUP BY 1",
    "embed_dedup": f"WITH {_KIDS} SELECT count(*) AS n_texts, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_saved FROM kids",
    "corpus_subset": """WITH hits AS (SELECT DISTINCT query_id, (relevant_in_top_k > 0) AS rel, unnest(hit_ids) AS hit FROM query_evals),
needed AS (SELECT DISTINCT try_cast(hit AS BIGINT) AS doc_id FROM hits WHERE rel AND try_cast(hit AS BIGINT) IS NOT NULL),
room AS (SELECT greatest(0, (SELECT count(*) FROM documents) * 4 // 5 - (SELECT count(*) FROM needed)) AS r),
filler AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM needed)),
both_kinds AS (
  SELECT 'needed' AS kind, doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM needed)
  UNION ALL SELECT 'filler', doc_id, text FROM filler WHERE n <= (SELECT r FROM room))
SELECT kind, doc_id FROM both_kinds WHERE trim(coalesce(text, ''), ' ') <> ''""",
}
