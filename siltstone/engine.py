"""The engine: an index of files in Parquet tables, and retrieval, context and evaluation on it.

An index lives in one folder. Each write adds a segment, the tables and postings of the new and
changed documents alone, and notes the documents that go; then it puts a marker in place, which
lists the segments. Readers use the last version that has one, so that a run that fails half-way
is never seen. A run that finds nothing to do makes no version. Reading leaves out the rows of
documents that went after their segment; when an index has more than SEGMENTS segments, they are
merged into one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Settings, SettingsError
from siltstone.operators import chunking, context, evaluation, incremental, index, search
from siltstone.operators.changes import Folder
from siltstone.providers import PROVIDERS, CrossEncoder, Provider
from siltstone.report import report_markdown, run_environment
from siltstone.session import SMALL, materialize
from siltstone.sources import corpus, files

TABLES = {
    "documents": "doc_id string, source_path string, source_uri string, doc_type string, mime_type string, content_hash string, file_size long, modified_at timestamp, indexed_at timestamp, language string, encoding string, collection string, extra_json string",
    "chunks": "doc_id string, chunk_id string, role string, text string, source_block_id string, parent_chunk_id string, split_index int, block_type string, ord int, storage_id string",
    "embeddings": "storage_id string, doc_id string, chunk_id string, vector array<float>, dimensions int, model string, provider string, text_hash string, embedded_at timestamp",
}


ITEMS, POSTINGS = index.stored_schemas({"doc_id": "string", "chunk_id": "string"})
#: Segments that are read side by side at most, and the bits of an id within a segment.
SEGMENTS, ID_BITS = 16, 40


class ModelMismatch(ValueError):
    """The collection holds vectors of other models than the query's."""


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, settings: Settings | None = None, provider: Provider | None = None,
        registry: files.Registry | None = None, reranker: CrossEncoder | None = None,
    ):
        self.spark, self.settings = spark, settings or Settings()
        self.folder = Folder(spark, root)
        self.registry, self.reranker = registry or files.Registry(), reranker
        if provider is None:
            kind = PROVIDERS.get(self.settings.embedding_provider)
            if kind is None:
                raise SettingsError(f"unknown embedding provider {self.settings.embedding_provider!r}")
            provider = kind(self.settings.embedding_dimensions)
        self.provider = provider

    # -- tables

    def version(self) -> int:
        return max(self.folder.numbers("versions"), default=0)

    def segments(self) -> list[int]:
        """The segments of the last version, oldest first."""
        version = self.version()
        return json.loads(self.folder.body(f"versions/{version}")) if version else []

    def _part(self, name: str, schema: str) -> DataFrame:
        """The rows of a table in all segments, without those of documents that went later."""
        root, segments = self.folder.root, self.segments()
        if not segments:
            return self.spark.createDataFrame([], schema)
        rows = gone = None
        for segment in segments:
            part = self.spark.read.schema(schema).parquet(f"{root}/data/{segment}/{name}").withColumn("__segment", F.lit(segment))
            left = self.spark.read.schema("doc_id string").parquet(f"{root}/data/{segment}/gone").select(F.col("doc_id").alias("__gone"), F.lit(segment).alias("__at"))
            rows, gone = (part, left) if rows is None else (rows.unionByName(part), gone.unionByName(left))
        if len(segments) > 1:
            rows = rows.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.col("__segment") < F.col("__at")), "left_anti")
        return rows.drop("__segment")

    def table(self, name: str, collection: str | None = None) -> DataFrame:
        rows = self._part(name, TABLES[name])
        if collection is not None:
            own = self.table("documents").filter(F.col("collection") == collection)
            rows = rows.filter(F.col("collection") == collection) if name == "documents" else rows.join(own.select("doc_id"), "doc_id", "left_semi")
        return rows

    def text_index(self) -> index.TextIndex:
        """The stored postings; those of documents that went are met by no item."""
        root = self.folder.root
        paths = [f"{root}/data/{segment}/text/postings" for segment in self.segments()]
        items = self._part("text/items", ITEMS)
        if not paths:
            return index.TextIndex(items, self.spark.createDataFrame([], POSTINGS))
        rows = None
        for path in paths:
            part = self.spark.read.schema(POSTINGS).parquet(path)
            rows = part if rows is None else rows.unionByName(part)
        live = len(paths) == 1
        return index.TextIndex(items, rows if live else rows.join(items.select("id"), "id", "left_semi"))

    def _write(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, merge: bool = False) -> None:
        """Add a segment of the rows given, from which on the documents in `gone` (doc_id) are others;
        with `merge` it takes the place of all segments."""
        version = self.version() + 1
        base = f"{self.folder.root}/data/{version}"
        for name, ddl in TABLES.items():
            columns = [c.split(" ")[0] for c in ddl.split(", ")]
            rows = tables[name].select(*columns) if name in tables else self.spark.createDataFrame([], ddl)
            rows.write.mode("overwrite").parquet(f"{base}/{name}")
        gone = self.spark.createDataFrame([], "doc_id string") if gone is None else gone.select("doc_id")
        gone.write.mode("overwrite").parquet(f"{base}/gone")
        children = self.spark.read.schema(TABLES["chunks"]).parquet(f"{base}/chunks").filter("role = 'child' AND text IS NOT NULL")
        index.store(children.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"], f"{base}/text", version << ID_BITS)
        segments = [version] if merge else [*self.segments(), version]
        if not self.folder.write(f"versions/{version}", json.dumps(segments)):
            raise RuntimeError(f"version {version} was written by another run")

    def merge(self) -> None:
        """Merge all segments into one."""
        self._write({name: self.table(name) for name in TABLES}, merge=True)

    # -- lookups by key

    def get_document(self, source_path: str) -> dict[str, Any] | None:
        """The document of a path."""
        row = self.table("documents").filter(F.col("source_path") == source_path).first()
        return row.asDict() if row else None

    def get_chunk(self, doc_id: str, chunk_id: str) -> dict[str, Any] | None:
        row = self.table("chunks").filter((F.col("doc_id") == doc_id) & (F.col("chunk_id") == chunk_id)).first()
        return row.asDict() if row else None

    def get_parent(self, doc_id: str, chunk_id: str) -> dict[str, Any] | None:
        """The parent of a child chunk; None without one."""
        child = self.get_chunk(doc_id, chunk_id)
        return self.get_chunk(doc_id, child["parent_chunk_id"]) if child and child["parent_chunk_id"] else None

    def get_document_text(self, doc_id: str) -> str | None:
        """The texts of a document's child chunks in order; None if it has none."""
        row = self.document_text(doc_id).first()
        return row["text"] if row else None

    # -- indexing

    def index(self, path: str | Path, collection: str | None = None, extra: DataFrame | None = None, **walk: Any) -> tuple[dict[str, Any], DataFrame]:
        """Index a file or folder. Returns the summary and a row per file: path, status (new,
        changed, skipped, failed), doc_id, children, parents, error.

        Files whose content is stored already are left out before they are parsed. `extra`
        (path, external_id) is stored with its documents.
        """
        path = Path(path)
        found, cut = ([path.resolve()], False) if path.is_file() else files.walk(path, **{"max_files": self.settings.max_index_files} | walk)
        source = files.read_files(self.spark, found)
        stored = self.table("documents")
        status = materialize(incremental.change_status(files.metadata(source), stored.select("source_path", "content_hash")), "status")
        fresh = status.filter("status <> 'skipped'")
        parsed = materialize(files.parse(source.join(fresh.select(F.col("source_path").alias("path")), "path", "left_semi"), registry=self.registry), "parsed")
        good = parsed.filter("error IS NULL").select(F.col("path").alias("source_path"), F.col("doc_type").alias("kind"), "language", "encoding", "raw_text", "extra_json", "blocks")
        if extra is not None:
            added = extra.select(F.col("path").alias("source_path"), F.to_json(F.struct("external_id")).alias("added"))
            good = good.join(added, "source_path", "left").withColumn("extra_json", incremental.merged_json("extra_json", "added"))
        documents = fresh.join(good, "source_path").withColumns({
            "doc_type": F.coalesce("kind", "doc_type"), "collection": F.lit(collection or self.settings.collection), "indexed_at": F.current_timestamp(),
        })
        documents = materialize(documents, "documents")
        s = self.settings
        chunks = chunking.chunk_documents(
            documents.select("doc_id", F.inline("blocks")), documents.select("doc_id", "raw_text"),
            child_max=s.child_max_chars, overlap=s.child_overlap_chars, parent_max=s.parent_max_chars, least=s.min_child_chars,
        )
        chunks = materialize(chunks.withColumn("storage_id", F.concat_ws("::", "doc_id", "chunk_id")), "chunks")
        old = self.table("embeddings").filter(F.col("model") == self.provider.model).select("text_hash", "vector").dropDuplicates(["text_hash"])
        rows = incremental.embed_distinct(chunks.filter("role = 'child'"), self.provider.expression("text"), ["storage_id", "doc_id", "chunk_id"], old)
        embeddings = rows.withColumns({
            "vector": F.col("vector").cast("array<float>"), "dimensions": F.size("vector"), "model": F.lit(self.provider.model),
            "provider": F.lit(self.provider.name), "embedded_at": F.current_timestamp(),
        })
        if not documents.isEmpty():
            # documents of the same path are replaced; segments before are left as they are
            self._write({"documents": documents, "chunks": chunks, "embeddings": embeddings}, documents.select("doc_id"))
            if len(self.segments()) > SEGMENTS:
                self.merge()
        counts = self.table("chunks").groupBy("doc_id").agg(F.count_if(F.col("role") == "child").alias("children"), F.count_if(F.col("role") == "parent").alias("parents"))
        results = status.select(F.col("source_path").alias("path"), "doc_id", "status").join(parsed.select("path", "error"), "path", "left")
        results = results.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))).join(counts, "doc_id", "left")
        results = results.fillna(0, ["children", "parents"])
        summary: dict[str, Any] = {r["status"]: r["n"] for r in incremental.index_summary(results).collect()}
        return summary | {"files": len(found), "truncated": cut}, results

    def delete(self, doc_ids: Iterable[str]) -> None:
        self._write({}, self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string"))

    def signatures(self, collection: str | None = None) -> DataFrame:
        """Distinct provider, model, dimensions of a collection."""
        return self.table("embeddings", collection or self.settings.collection).select("provider", "model", "dimensions").distinct()

    def document_text(self, doc_id: str | None = None) -> DataFrame:
        rows = self.table("chunks").filter("role = 'child'")
        if doc_id is not None:
            rows = rows.filter(F.col("doc_id") == doc_id)
        return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), "\n").alias("text"))

    # -- retrieval

    def questions(self, queries: DataFrame | Iterable[str]) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries.select("query_id", "query")
        return self.spark.createDataFrame([(f"q{i:06d}", q) for i, q in enumerate(queries)], "query_id string, query string")

    def retrieve(self, queries: DataFrame | Iterable[str], *, mode: str | None = None, top_k: int | None = None, candidate_k: int | None = None, rrf_k: int | None = None, collection: str | None = None, rerank: bool | None = None, rerank_top_n: int | None = None) -> DataFrame:
        """Ranked hits of a batch of queries with their parents: query_id, rank, doc_id, chunk_id,
        score, text, parent_chunk_id, parent_text, source_path."""
        s = replace(self.settings, mode=mode or self.settings.mode)
        top_k, candidate_k, rrf_k = top_k or s.top_k, candidate_k or s.candidate_k, rrf_k or s.rrf_k
        collection = collection or s.collection
        rerank = s.rerank_enabled if rerank is None else rerank
        pool = max(rerank_top_n or s.rerank_top_n, top_k) if rerank else top_k
        asked = self.questions(queries)
        own = self.table("documents", collection).select("doc_id", "source_path")
        chunks = self.table("chunks")
        lexical = dense = None
        if s.mode != "vector":
            depth = pool if s.mode == "bm25" else max(candidate_k, pool if rerank else candidate_k)
            # lengths and frequencies are those of all collections; the hits are one collection's
            lexical = search.bm25_top_k(self.text_index(), asked, depth, own)
        if s.mode != "bm25":
            self.check_model(collection)
            depth = pool if s.mode == "vector" else max(candidate_k, pool if rerank else candidate_k)
            vectors = self.table("embeddings", collection).select("doc_id", "chunk_id", "vector")
            dense = search.dense_top_k(vectors, asked.withColumn("vector", self.provider.expression("query")), depth)
        if s.mode == "hybrid":
            dense, lexical = materialize(dense, "dense"), materialize(lexical, "lexical")
            answered = lexical.select("query_id").distinct()
            hits = search.rrf_fuse(dense, lexical, rrf_k=rrf_k, k=pool).join(answered, "query_id", "left_semi")
            alone = dense.join(answered, "query_id", "left_anti").filter(F.col("rank") <= pool)
            hits = hits.unionByName(alone.select(*hits.columns))
        else:
            hits = dense if s.mode == "vector" else lexical
        full = search.attach_parents(hits, chunks)
        if rerank:
            scorer = self.reranker.expression("query", "passage") if self.reranker else None
            full = search.attach_parents(search.rerank(full, asked, top_k, scorer), chunks)
        columns = ["query_id", "rank", "doc_id", "chunk_id", "score", "text", "parent_chunk_id", "parent_text", "source_path"]
        return full.join(own, "doc_id", "left").select(*columns)

    def check_model(self, collection: str) -> None:
        held = [r["model"] for r in self.signatures(collection).select("model").distinct().collect()]
        if held and self.provider.model not in held:
            raise ModelMismatch(f"collection {collection!r} holds {', '.join(sorted(held))}, the query is embedded with {self.provider.model!r}")

    def context(self, queries: DataFrame | Iterable[str], *, max_chars: int | None = None, include_parents: bool | None = None, **how: Any) -> DataFrame:
        """Packed context and quality of each query: query_id, query, context, citations, truncated,
        chars_used, hit_count, top_score, label."""
        s = self.settings
        asked = self.questions(queries)
        hits = materialize(self.retrieve(asked, **how), "hits")
        packed = context.pack_context(hits, max_chars or s.max_chars, s.include_parents if include_parents is None else include_parents)
        stats = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit_count"), F.min_by("score", "rank").alias("top_score"))
        rows = asked.join(stats, "query_id", "left").join(packed, "query_id", "left").fillna(0, ["hit_count", "chars_used"])
        rerank = how.get("rerank")
        rows = rows.withColumns({"mode": F.lit(how.get("mode") or s.mode), "reranked": F.lit(s.rerank_enabled if rerank is None else rerank)})
        return context.quality_label(rows, high=s.min_score_high, high_bm25=s.min_bm25_high, high_rrf=s.min_rrf_high)

    # -- evaluation

    def evaluate(self, qrels: DataFrame, *, modes: Iterable[str] = ("vector", "bm25", "hybrid"), top_k: int = 5, multiplier: int = 5, collection: str | None = None, rerank: bool = False) -> tuple[DataFrame, DataFrame]:
        """Score modes at document level on judged queries (id, query, expect_empty, relevant).

        Returns metrics per mode and query, and the means per mode. All modes are given
        `multiplier` chunks per document asked for.
        """
        asked = materialize(qrels.select(F.col("id").alias("query_id"), "query", "expect_empty", "relevant"), "asked")
        rules = asked.select("query_id", F.inline("relevant"))
        key = F.coalesce(F.get_json_object("extra_json", "$.external_id"), "doc_id")
        known = self.table("documents", collection or self.settings.collection).select("doc_id", "source_path", key.alias("key"))
        text_rules = rules.filter("external_id IS NULL AND text_contains <> ''").select("query_id", "text_contains").distinct()
        text_hits = evaluation.rule_match(self.document_text(), text_rules.withColumn("query_id", F.to_json(F.struct("query_id", "text_contains"))))
        text_hits = text_hits.select("doc_id", F.from_json("query_id", "query_id string, text_contains string").alias("r")).select("doc_id", "r.*")
        by_id = rules.filter("external_id IS NOT NULL").join(known, F.col("external_id") == F.col("key")).select("query_id", "doc_id")
        with_text = rules.filter("external_id IS NULL AND text_contains <> ''").join(text_hits, ["query_id", "text_contains"]).join(known, "doc_id")
        with_text = with_text.filter("coalesce(source_contains, '') = '' OR contains(lower(source_path), lower(source_contains))").select("query_id", "doc_id")
        # rules on the path alone: the judged queries are a small stated set
        paths = rules.filter("external_id IS NULL AND coalesce(text_contains, '') = ''")
        by_path = known.join(F.broadcast(paths) if paths.count() <= SMALL else paths, F.expr("contains(lower(source_path), lower(coalesce(source_contains, '')))")).select("query_id", "doc_id")
        relevant = materialize(by_id.unionByName(with_text).unionByName(by_path).join(known, "doc_id").select("query_id", F.col("key").alias("doc_id")).distinct(), "relevant")
        gold = asked.select("query_id", F.when(F.col("expect_empty"), 0).otherwise(F.greatest(F.lit(1), F.size("relevant"))).alias("gold_count"))
        pool = max(top_k * multiplier, top_k)
        ranked = self._channels(asked, list(modes), pool, collection, rerank)
        pools = None
        for mode, hits in ranked.items():
            part = hits.join(known.select("doc_id", "key"), "doc_id").select("query_id", "rank", F.col("key").alias("doc_id"), F.lit(mode).alias("mode"))
            pools = part if pools is None else pools.unionByName(part)
        by = ["query_id", "mode"]
        gold = gold.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ranked])))
        out = evaluation.query_metrics(evaluation.collapse_documents(pools, relevant, top_k, by), gold, top_k, by)
        metrics = materialize(out, "metrics")
        return metrics, evaluation.mode_summary(metrics)

    def _channels(self, asked: DataFrame, modes: list[str], pool: int, collection: str | None, rerank: bool) -> dict[str, DataFrame]:
        """The pool of every mode; without reranking the dense and lexical pools are made once and fused."""
        depth = max(self.settings.candidate_k, pool)
        how = {"candidate_k": depth, "collection": collection, "rerank": rerank, "rerank_top_n": pool}
        single = [m for m in modes if m != "hybrid"]
        if rerank or "hybrid" not in modes or len(single) < 2:
            return {mode: self.retrieve(asked, mode=mode, top_k=pool, **how) for mode in modes}
        columns = ["query_id", "rank", "doc_id", "chunk_id", "score"]
        hits = {m: materialize(self.retrieve(asked, mode=m, top_k=depth, **how).select(*columns), m) for m in ("vector", "bm25")}
        answered = hits["bm25"].select("query_id").distinct()
        fused = search.rrf_fuse(hits["vector"], hits["bm25"], rrf_k=self.settings.rrf_k, k=pool).join(answered, "query_id", "left_semi")
        hits["hybrid"] = fused.select(*columns).unionByName(hits["vector"].join(answered, "query_id", "left_anti").select(*columns))
        return {m: hits[m].filter(F.col("rank") <= pool) for m in modes}

    def report(self, metrics: DataFrame, path: str | Path, *, suite: str = "judged", top_k: int = 5, latency: DataFrame | None = None, run: dict[str, Any] | None = None, dataset: dict[str, Any] | None = None) -> dict[str, Any]:
        """Write means, intervals, latencies, comparison and the run's circumstances as JSON, and as a
        Markdown file beside it. `latency` has mode, mean, p50, p95 and max in milliseconds."""
        means = {r["mode"]: {k: r[k] for k in ("queries", "hit_at_k", "recall_at_k", "mrr", "ndcg_at_k")} for r in evaluation.mode_summary(metrics).collect()}
        named = dict(zip(evaluation.METRICS, ("hit_at_k", "recall_at_k", "mrr", "ndcg_at_k"), strict=True))
        for r in evaluation.bootstrap_intervals(metrics).collect():
            means[r["mode"]].setdefault("confidence_intervals", {})[named[r["metric"]]] = {"low": r["low"], "high": r["high"]}
        for r in latency.collect() if latency is not None else []:
            means[r["mode"]]["latency_ms"] = {f"{k}_ms": r[k] for k in ("mean", "p50", "p95", "max")}
        compared = evaluation.mode_comparison(evaluation.mode_summary(metrics)).first().asDict()
        s = self.settings
        retrieval = {"provider": self.provider.name, "embedding_model": self.provider.model, "candidate_k": s.candidate_k, "rrf_k": s.rrf_k}
        payload: dict[str, Any] = {
            "suite": suite, "provider": self.provider.name, "top_k": top_k, "doc_count": self.table("documents").count(),
            "query_count": metrics.select("query_id").distinct().count(), "rerank": s.rerank_enabled, "modes": means, "comparison": compared,
            "run": {"environment": run_environment(self.spark), "retrieval": retrieval} | (run or {}),
        }
        if dataset:
            payload["dataset"] = dataset
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(payload, indent=2), encoding="utf-8")
        path.with_suffix(".md").write_text(report_markdown(payload), encoding="utf-8")
        return payload

    def suite(self, folder: str | Path, qrels: DataFrame, report: str | Path, *, name: str = "judged", dataset: dict[str, Any] | None = None, extra: DataFrame | None = None, top_k: int = 5) -> dict[str, Any]:
        """Index a folder, score the modes on judged queries, measure each mode's time a query, and report.

        A batch is one plan, so that a query's latency is its share of the batch's time.
        """
        began, started = time.perf_counter(), datetime.now(UTC).isoformat(timespec="seconds")
        self.index(folder, extra=extra)
        indexed = time.perf_counter() - began
        metrics, _ = self.evaluate(qrels, top_k=top_k)
        asked = qrels.select(F.col("id").alias("query_id"), "query")
        number = max(1, asked.count())
        rows = []
        for mode in ("vector", "bm25", "hybrid"):
            at = time.perf_counter()
            self.retrieve(asked, mode=mode, top_k=top_k).write.format("noop").mode("overwrite").save()
            rows.append((mode, *[1000 * (time.perf_counter() - at) / number] * 4))
        latency = self.spark.createDataFrame(rows, "mode string, mean double, p50 double, p95 double, max double")
        run = {"index_seconds": round(indexed, 2), "total_seconds": round(time.perf_counter() - began, 2), "started_at": started}
        return self.report(metrics, report, suite=name, top_k=top_k, latency=latency, run=run, dataset=dataset)


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    return corpus.load_qrels(spark, path)
