"""Ranked retrieval for whole batches of queries.

Every operator takes queries as rows and ranks per query_id. Items are (doc_id, chunk_id).
Scores that are equal to 9 decimals are ties and are ordered by doc_id, then chunk_id, so
that no result depends on the order in which partial sums are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.operators.index import TextIndex, parsed_queries, tokenized
from siltstone.session import materialize

ITEM = ["doc_id", "chunk_id"]
#: Constants of the BM25 formula: k1 = 1.2 and b = 0.75, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def top_k(scores: DataFrame, k: int, *, best: str = "high", keys: list[str] | None = None, by: str = "query_id") -> DataFrame:
    """Keep each query's k best rows and number them from 1."""
    score = F.desc("score") if best == "high" else F.asc("score")
    window = Window.partitionBy(by).orderBy(score, *[F.asc(c) for c in keys or ITEM])
    return scores.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


# -- BM25
#
# Scores come from the postings of the queries' terms alone, be they stored or made of the texts
# on the way. Queries and terms are 64-bit hashes on the way. The weights of the queries' terms are
# broadcast in runs of a bounded size, so that postings of a frequent term never meet in one task:
# the postings stay partitioned by item, where the sums are made. A query's k-th best score is at
# least what the k-th best posting of one of its terms gives alone, which is known to a bin from
# counts; sums below that are dropped before anything is sorted.

#: Rows (terms of the queries, or their weights in a query) that are broadcast at once.
BROADCAST = 200_000
#: Rows of a batch (of a query and a term) that need not be written to be used several times.
LOCAL = 20_000
#: Bins that a posting's part of a score, from 0 to 1 + K1, is counted in.
BINS = 64


@dataclass(frozen=True)
class _Asked:
    """A batch of queries: rows (qid, query_id, tid, terms, qtf), and how many kinds of terms it has."""

    rows: DataFrame
    weights: int
    kinds: int
    phrases: bool
    terms: list[str] | None = None  # the distinct terms, if they are known here

    def singles(self) -> Iterator[DataFrame]:
        """(term, tid) of the terms asked for by themselves, in runs."""
        rows = self.rows.filter(F.size("terms") == 1).select(F.col("terms")[0].alias("term"), "tid").distinct()
        yield from _in_runs(rows, self.kinds, "tid")


def _in_runs(table: DataFrame, rows: int, key: str) -> Iterator[DataFrame]:
    """A table in runs of about BROADCAST rows, marked for broadcast."""
    runs = max(1, -(-rows // BROADCAST))
    for run in range(runs):
        yield F.broadcast(table if runs == 1 else table.filter(F.pmod(F.xxhash64(key), F.lit(runs)) == run))


def _terms(queries: DataFrame) -> _Asked:
    parsed = parsed_queries(queries).select(F.xxhash64("query_id").alias("qid"), "query_id", F.xxhash64("terms").alias("tid"), "terms", "qtf")
    few = parsed.limit(LOCAL + 1).toArrow()
    if len(few) <= LOCAL:
        rows = queries.sparkSession.createDataFrame(few, parsed.schema)
        terms = few["terms"].to_pylist()
        return _Asked(rows, len(few), len(set(few["tid"].to_pylist())), any(len(t) > 1 for t in terms), sorted({x for t in terms for x in t}))
    rows = materialize(parsed, "asked")
    about = rows.agg(F.count(F.lit(1)), F.count_distinct("tid"), F.max(F.size("terms"))).first()
    return _Asked(rows, about[0], about[1], (about[2] or 0) > 1)


def _from_texts(chunks: DataFrame, asked: _Asked) -> tuple[DataFrame, DataFrame]:
    """(id, items, dl) of the texts and (id, tid, dl, tf) of the terms."""
    numbered = chunks.select(F.monotonically_increasing_id().alias("id"), *ITEM, "text")
    tokens = materialize(tokenized(numbered, ["id", *ITEM]), "tokens")
    rows = tokens.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    # a task has all rows of an item, so that they are counted before they are shuffled
    held = _union(rows.join(run, "term") for run in asked.singles()).groupBy("id", "tid", "dl").agg(F.count(F.lit(1)).alias("tf"))
    if asked.phrases:
        held = held.unionByName(_phrase_postings(tokens.select("id", F.size("terms").alias("dl"), F.posexplode("terms").alias("pos", "term")), asked))
    return tokens.select("id", *ITEM, F.size("terms").alias("dl")), held


def _from_index(index: TextIndex, asked: _Asked) -> tuple[DataFrame, DataFrame]:
    """The same from a stored index, of which only the terms' postings are read."""
    rows = index.of_terms(asked.rows.select(F.explode("terms").alias("term")), asked.terms)
    held = _union(rows.join(run, "term") for run in asked.singles()).select("id", "tid", "dl", F.col("tf").cast("long").alias("tf"))
    if asked.phrases:
        held = held.unionByName(_phrase_postings(rows.select("id", "dl", "term", F.explode("positions").alias("pos")), asked))
    return index.items, held


def _weighted(source: DataFrame | TextIndex, asked: _Asked, k: int | None = None, own: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parts (id, tid, part: tf and length of a posting in the formula), weights (qid, tid, weight, and
    least: what the query's k-th best score is at least, null if not known), and items.

    `own` leaves of the items those that may be found; statistics are those of all.
    """
    items, held = _from_index(source, asked) if isinstance(source, TextIndex) else _from_texts(source, asked)
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl")).first()
    n, avgdl = F.lit(stats["n"]), F.lit(stats["avgdl"] or 1.0)
    length = K1 * ((1 - B) + B * F.col("dl") / avgdl)
    part = (F.col("tf") * (K1 + 1) / (F.col("tf") + length)).alias("part")
    if own is None:
        parts = bins_of = materialize(held.select("id", "tid", part), "parts")
    else:
        items = own(items)
        mine = items.select("id", F.lit(True).alias("mine")).distinct()
        parts = materialize(held.select("id", "tid", part).join(mine, "id", "left"), "parts")
        bins_of, parts = parts, parts.filter("mine").drop("mine")

    def binned(rows: DataFrame) -> DataFrame:
        return rows.groupBy("tid", F.floor(F.col("part") * (BINS / (1 + K1))).alias("bin")).agg(F.count(F.lit(1)).alias("df"))

    frequency, bins = binned(bins_of).groupBy("tid").agg(F.sum("df").alias("df")), binned(parts)
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = asked.rows.join(frequency, "tid").select("qid", "tid", (F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("qtf")).alias("weight"))
    if k is None:
        return parts, rows.withColumn("least", F.lit(None).cast("double")), items
    above = F.sum("df").over(Window.partitionBy("tid").orderBy(F.desc("bin")))
    kth = bins.withColumn("above", above).filter(F.col("above") >= k).groupBy("tid").agg((F.max("bin") * ((1 + K1) / BINS)).alias("kth"))
    rows = rows.join(kth, "tid", "left")
    least = F.max(F.col("weight") * F.col("kth")).over(Window.partitionBy("qid"))
    rows = rows.select("qid", "tid", "weight", least.alias("least"))
    # what is sent in one run is used once
    return parts, rows if asked.weights <= BROADCAST else materialize(rows, "weights"), items


#: Cells (of a query and an item) of a block that is summed as a whole matrix.
CELLS = 4_000_000
#: Rows that a task's Python hands on at once, and products that are summed by a task if all sums are asked for.
SENT_ROWS, SUMS_A_TASK = 100_000, 4_000_000


def sums_of_block(q: np.ndarray, item: np.ndarray, value: np.ndarray, queries: int, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of the values of each query and item that occur: as a matrix if many do, else by sorting."""
    cell = q * items + item
    if len(cell) * 16 >= queries * items:
        sums = np.bincount(cell, value, minlength=queries * items)
        cell = np.flatnonzero(sums)
        return cell // items, cell % items, sums[cell]
    cell, at = np.unique(cell, return_inverse=True)
    return cell // items, cell % items, np.bincount(at, value)


class Best:
    """Of scores (the highest is best) that come bit by bit, the k best of each query and what ties with
    the last. `edge` is what a score must have at least, as far as it is known; it only rises."""

    #: Rows that may wait until those below the edge go.
    WAITING = 500_000

    def __init__(self, k: int, edge: np.ndarray):
        self.k, self.edge, self.kept, self.waiting = k, edge.copy(), 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, row, score))
        self.waiting += len(query)
        if self.waiting > max(self.kept, min(self.WAITING, self.k * len(self.edge))):
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) in order of query, best first."""
        if self.waiting:
            query, row, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((-score, query))
            query, row, score = query[order], row[order], score[order]
            last = np.searchsorted(query, np.arange(len(self.edge))) + self.k - 1
            full = np.flatnonzero(last < len(query))
            full = full[query[last[full]] == full]
            self.edge[full] = np.maximum(self.edge[full], score[last[full]])
            kept = score >= self.edge[query]
            self.parts, self.kept, self.waiting = [(query[kept], row[kept], score[kept])], int(kept.sum()), 0
        return self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


class Weights:
    """The weights of a run of queries, by term."""

    def __init__(self, rows: dict[str, np.ndarray]):
        order = np.argsort(rows["tid"], kind="stable")
        tid, self.weight = rows["tid"][order], rows["weight"][order]
        self.qids, self.q = np.unique(rows["qid"][order], return_inverse=True)
        self.least = np.full(len(self.qids), -np.inf)
        np.maximum.at(self.least, self.q, np.where(np.isnan(rows["least"][order]), -np.inf, rows["least"][order]))
        self.terms, self.first = np.unique(tid, return_index=True)
        self.sizes = np.diff(np.concatenate([self.first, [len(tid)]]))
        #: Items that are summed at once.
        self.width = max(1, CELLS // max(1, len(self.qids)))

    def sums(self, item: np.ndarray, t: np.ndarray, part: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, sum) of the postings (item, term, part), queries and items by their place."""
        at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
        known = self.terms[at] == t
        at, item, part = at[known], item[known], part[known]
        n = self.sizes[at]
        # of each row its term's weights, one after the other
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[at], n)
        return sums_of_block(self.q[own], np.repeat(item, n), self.weight[own] * np.repeat(part, n), len(self.qids), items)


def _above(weights: dict[str, np.ndarray], k: int):
    """Rows (gid, id, tid, part) in order of gid and id -> (qid, gid, id, score) of sums that may be among the
    k best of their group: a task gives the k best of its own items, and what ties with them."""
    asked = Weights(weights)
    schema = pa.schema([("qid", pa.int64()), ("gid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def block(best: Best, ids: np.ndarray, t: np.ndarray, part: np.ndarray) -> None:
        names, item = np.unique(ids, return_inverse=True)
        i, j, sums = asked.sums(item, t, part, len(names))
        kept = sums >= best.edge[i] - 2e-9
        best.add(i[kept], names[j[kept]], np.rint(sums[kept] * 1e9) / 1e9)

    def found(best: Best | None, group: int) -> Iterator[pa.RecordBatch]:
        i, ids, score = best.rows() if best else ((),) * 3
        for at in range(0, len(i), SENT_ROWS):
            own = slice(at, at + SENT_ROWS)
            columns = [pa.array(asked.qids[i[own]]), pa.array(np.full(len(i[own]), group)), pa.array(ids[own]), pa.array(-score[own])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group = None, 0
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for c, h in enumerate(held)]
            new = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
            starts = np.concatenate([np.flatnonzero(np.concatenate([[True], new])), [len(held[0])]]) if len(held[0]) else np.zeros(1, np.int64)
            groups = held[0][starts[:-1]]
            at, items = 0, len(groups) - (batch is not None)  # the last item may go on in the next batch
            while at < items:
                to = min(at + asked.width, int(np.searchsorted(groups, groups[at], "right")))
                if to > items or (batch is not None and to == items and to - at < asked.width):
                    break
                if best is None or groups[at] != group:
                    yield from found(best, group)
                    best, group = Best(k, asked.least - 2e-9), int(groups[at])
                block(best, *[h[starts[at] : starts[to]] for h in held[1:]])
                at = to
            held = [h[starts[at] :] for h in held]
        yield from found(best, group)

    return run


def _rows_of(run: DataFrame) -> dict[str, np.ndarray]:
    """The weights of a run of queries, about BROADCAST rows."""
    table = run.toPandas()
    return {c: table[c].to_numpy(np.float64 if c in ("weight", "least") else np.int64) for c in ("qid", "tid", "weight", "least")}


def _best_sums(parts: DataFrame, weights: DataFrame, rows: int, k: int, groups: DataFrame | None = None) -> Iterator[DataFrame]:
    """(qid, gid, id, score) of the sums that may be among the k best, a run of queries at a time. With
    `groups` (gid, id) these are the k best of each group; a task has few groups, or a part of one."""
    if groups is None:
        parts = parts.repartition("id").select(F.lit(0).cast("long").alias("gid"), "id", "tid", "part")
    else:
        parts = parts.join(groups, "id").repartitionByRange("gid", "id").select("gid", "id", "tid", "part")
    parts = parts.sortWithinPartitions("gid", "id")
    for run in _in_runs(weights, rows, "qid"):
        own = _rows_of(run)
        if len(own["tid"]):
            yield parts.mapInArrow(_above(own, k), "qid long, gid long, id long, score double")
        else:
            yield parts.limit(0).select(F.col("tid").alias("qid"), "gid", "id", F.col("part").alias("score"))


def _every(weights: dict[str, np.ndarray], keys: pa.Schema):
    """Rows (terms: tid and part of an item's postings, and the item's names) -> (qid, names, score) of all sums."""
    asked = Weights(weights)
    schema = pa.schema([("qid", pa.int64()), *keys, ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), asked.width):
                rows = batch.slice(at, asked.width)
                lists = rows.column(0)
                t, part = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                item = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
                i, j, sums = asked.sums(item, t, part, len(rows))
                score = np.rint(-sums * 1e9) / 1e9
                for one in range(0, len(i), SENT_ROWS):
                    own = slice(one, one + SENT_ROWS)
                    names = [rows.column(c).take(pa.array(j[own])) for c in range(1, rows.num_columns)]
                    yield pa.RecordBatch.from_arrays([pa.array(asked.qids[i[own]]), *names, pa.array(score[own])], schema=schema)

    return run


def _all_sums(parts: DataFrame, weights: DataFrame, items: DataFrame, names: DataFrame, rows: int) -> Iterator[DataFrame]:
    """(query_id, doc_id, chunk_id, score) of all sums, a run of queries at a time. Postings meet the
    names of their item first, once; the sums are many more, and stay in the task that makes them."""
    asked = weights.groupBy("tid").agg(F.count(F.lit(1)).alias("queries"))
    held = parts.groupBy("tid").agg(F.count(F.lit(1)).alias("items"))
    most = asked.join(held, "tid").agg(F.sum(F.col("queries") * F.col("items"))).first()[0] or 1
    lists = parts.repartition(-(-most // SUMS_A_TASK), "id").groupBy("id").agg(F.collect_list(F.struct("tid", "part")).alias("terms"))
    lists = lists.join(items.select("id", *ITEM), "id").select("terms", *ITEM)
    kinds = dict(items.dtypes)
    keys = to_arrow_schema(lists.select(*ITEM).schema)
    ddl = ", ".join(["qid long", *[f"{c} {kinds[c]}" for c in ITEM], "score double"])
    for run, called in zip(_in_runs(weights, rows, "qid"), _in_runs(names, rows, "qid"), strict=True):
        own = _rows_of(run)
        found = lists.mapInArrow(_every(own, keys), ddl) if len(own["tid"]) else lists.limit(0).select(F.lit(0).cast("long").alias("qid"), *ITEM, F.lit(0.0).alias("score"))
        yield found.join(called, "qid").select("query_id", *ITEM, "score")


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores (negative, the lowest is best) of all chunks (doc_id, chunk_id, text) that have a
    token of a query (query_id, query): query_id, doc_id, chunk_id, score.

    Document frequencies and lengths are those of all chunks given, so collections are to be
    filtered afterwards. A token that consists of several terms is matched as a phrase.
    """
    asked = _terms(queries)
    parts, weights, items = _weighted(chunks, asked)
    names = asked.rows.select("qid", "query_id").distinct()
    return _union(_all_sums(parts, weights, items, names, asked.weights))


def bm25_top_k(source: DataFrame | TextIndex, queries: DataFrame, k: int, within: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The k best of each query: query_id, doc_id, chunk_id, score, rank. `source` is a stored index or
    the chunks (doc_id, chunk_id, text). Only the winners, and what ties with them, are joined to
    their names.

    `within` (doc_id) restricts the hits, not the statistics. With `groups` (doc_id and a
    column), the k best are those of each query within each group, which the result names.
    """
    asked = _terms(queries)
    names = asked.rows.select("qid", "query_id").distinct()
    by, group = ["qid"], None
    if groups is not None:
        group = next(c for c in groups.columns if c != "doc_id")

    def own(items: DataFrame) -> DataFrame:
        if within is not None:
            items = items.join(within.select("doc_id").distinct(), "doc_id", "left_semi")
        return items if groups is None else items.join(groups, "doc_id")

    parts, weights, items = _weighted(source, asked, k if groups is None else None, own if within is not None or groups is not None else None)
    if groups is not None:
        items = materialize(items.withColumn("gid", F.xxhash64(group)), "items")
        sums = _best_sums(parts, weights, asked.weights, k, items.select("id", "gid").distinct())
        by.append("gid")
    else:
        sums = _best_sums(parts, weights, asked.weights, k)

    def best(scores: DataFrame) -> DataFrame:
        place = F.rank().over(Window.partitionBy(*by).orderBy("score"))
        return scores.withColumn("place", place).filter(F.col("place") <= k).select(*by, "id", "score")

    named = _union(best(scores) for scores in sums).join(items, ["id", *by[1:]]).join(names, "qid")
    keys = ["query_id"] if group is None else ["query_id", group]
    place = Window.partitionBy(*keys).orderBy("score", *ITEM)
    return named.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(*keys, *ITEM, "score", "rank")


def _phrase_postings(places: DataFrame, asked: _Asked) -> DataFrame:
    """Adjacent occurrences (id, dl, pos, term) of the phrases' terms: id, tid, dl, tf."""
    phrases = asked.rows.filter(F.size("terms") > 1).select("tid", "terms").distinct()
    parts = phrases.select("tid", F.size("terms").alias("steps"), F.posexplode("terms").alias("step", "term"))
    met = places.join(parts, "term").groupBy("tid", "id", "dl", "steps", (F.col("pos") - F.col("step")).alias("start"))
    whole = met.agg(F.count(F.lit(1)).alias("found")).filter("found = steps")
    return whole.groupBy("id", "tid", "dl").agg(F.count(F.lit(1)).alias("tf"))


# -- dense

#: Rows of the query and of the vector matrix that are multiplied at once, and queries sent to the tasks at once.
QUERY_ROWS, BASE_ROWS, QUERIES_SENT = 1_024, 16_384, 8_192
#: Products of a tile, that stays in the processor's cache, and numbers of the vectors that first bounds come from.
TILE, BOUNDED_BY = 1 << 20, 1 << 20


def nearest_rows(q: np.ndarray, b: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine to 9 decimals) of the k best rows of unit vectors for each query, by row if they
    tie; none below what `least` says the query's k-th best is at least.

    Tiles are multiplied in single precision; what may reach the bound known so far, allowing for the
    error of that, is multiplied again in double precision.
    """
    best, slack = Best(k, least), (q.shape[1] + 4) * 1.2e-7 + 1e-9
    q32, b32 = q.astype(np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
    step = max(1, TILE // max(1, len(q)))
    for at in range(0, len(b), step):
        if (best.edge == -np.inf).any() and at == 0:
            scores = np.round(q @ b[:step].T, 9) + 0.0
            n = min(k, scores.shape[1])
            i, j = np.nonzero(scores >= np.fmax(-np.partition(-scores, n - 1, axis=1)[:, n - 1], best.edge)[:, None])
            best.add(i, j, scores[i, j])
            best.rows()
            continue
        part = b32[:, at : at + step]
        near = np.flatnonzero(q32 @ part >= (best.edge - slack).astype(np.float32)[:, None])
        i, j = np.divmod(near, part.shape[1])
        j += at
        best.add(i, j, np.round(np.einsum("rc,rc->r", q[i], b[j]), 9) + 0.0)
    i, j, score = best.rows()
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    kept = np.arange(len(i)) - np.searchsorted(i, np.arange(len(q)))[i] < k
    return i[kept], j[kept], score[kept]


def _unit(b: np.ndarray) -> np.ndarray:
    """Rows of length one; those without length stay."""
    norm = np.linalg.norm(b, axis=1)
    return b / np.where(norm > 0, norm, 1)[:, None]


def _nearest(asked: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]], k: int, keys: list[str], query_key: str):
    """Batches (keys, vector) -> (query_key, keys, score): of every block of rows the k best of each query.

    `asked` has the ids, unit vectors and bounds of the queries by their number of dimensions.
    """

    def best(q: np.ndarray, b: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        b = _unit(b)
        for at in range(0, len(q), QUERY_ROWS):
            i, j, score = nearest_rows(q[at : at + QUERY_ROWS], b, k, least[at : at + QUERY_ROWS])
            yield at + i, j, score

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by([(c, "ascending") for c in keys]).combine_chunks()
        vectors = rows["vector"].combine_chunks()
        widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for width, (ids, q, least) in asked.items():
            own = np.flatnonzero(widths == width)
            if not len(own):
                continue
            taken = rows.take(own)
            b = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            for i, j, score in best(q, b, least):
                named = taken.take(j)
                columns = [ids.take(pa.array(i)), *[named[c].combine_chunks() for c in keys], pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[query_key, *keys, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BASE_ROWS:
                yield from block(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from block(pa.Table.from_batches(held))

    return run


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By number of dimensions: places and rows of the vectors."""
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        yield width, own, vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _by_width(rows: pa.Table, query_key: str) -> dict[int, tuple[pa.Array, np.ndarray, np.ndarray]]:
    ids = rows[query_key].combine_chunks()
    out = {}
    for width, own, q in _matrices(rows["vector"].combine_chunks()):
        norm = np.linalg.norm(q, axis=1)
        if (norm > 0).any():
            least = rows["least"].to_numpy()[own] if "least" in rows.column_names else np.full(len(own), -np.inf)
            out[width] = (ids.take(pa.array(own[norm > 0])), q[norm > 0] / norm[norm > 0][:, None], least[norm > 0])
    return out


def _bounds(held: pa.Array, k: int, query_key: str):
    """Batches (query_key, vector) -> with `least`: the k-th best cosine among some vectors, which all of
    them cannot fall below."""
    some = {width: _unit(b) for width, _, b in _matrices(held)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(len(batch), -np.inf)
            for width, own, q in _matrices(batch.column(1)):
                if width in some and len(some[width]) >= k:
                    for at in range(0, len(q), QUERY_ROWS):
                        rows = own[at : at + QUERY_ROWS]
                        i, _, score = nearest_rows(_unit(q[at : at + QUERY_ROWS]), some[width], k, least[rows])
                        last = np.flatnonzero(np.bincount(i, minlength=len(rows)) == k)
                        least[rows[last]] = score[np.searchsorted(i, last) + k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[query_key, "vector", "least"])

    return run


def dense_top_k(base: DataFrame, queries: DataFrame, k: int, *, keys: list[str] | None = None, query_key: str = "query_id") -> DataFrame:
    """Exact cosine: the k best of `base` (keys, vector) for each query (query_id, vector).

    The vectors stay where they are; the queries are sent to them, QUERIES_SENT at a time, and
    multiplied with blocks of them as matrices. A block gives its k best. Of many queries the k best
    of some vectors are found first: all vectors are then looked through for better ones only.
    A query without length finds nothing; a vector without length scores 0; other numbers of
    dimensions do not match. Null vectors take no part.
    """
    keys = keys or ITEM
    queries = queries.filter("vector IS NOT NULL").select(query_key, F.col("vector").cast("array<double>").alias("vector"))
    base = base.filter("vector IS NOT NULL").select(*keys, "vector")
    types = {**{c: t for c, t in base.dtypes if c in keys}, query_key: dict(queries.dtypes)[query_key]}
    schema = ", ".join([f"{query_key} {types[query_key]}", *[f"{c} {types[c]}" for c in keys], "score double"])
    few = queries.limit(QUERIES_SENT + 1).toArrow()
    if len(few) <= QUERIES_SENT:
        found = base.mapInArrow(_nearest(_by_width(few, query_key), k, keys, query_key), schema)
    else:
        base = materialize(base, "base")
        widest = base.agg(F.max(F.size("vector"))).first()[0] or 1
        some = base.select("vector").limit(max(1, BOUNDED_BY // widest)).toArrow()["vector"].combine_chunks()
        queries = materialize(queries.mapInArrow(_bounds(some, k, query_key), f"{query_key} {types[query_key]}, vector array<double>, least double"), "asked")
        runs = -(-queries.count() // QUERIES_SENT)
        parts = (queries.filter(F.pmod(F.xxhash64(query_key), F.lit(runs)) == run).toArrow() for run in range(runs))
        found = _union(base.mapInArrow(_nearest(_by_width(part, query_key), k, keys, query_key), schema) for part in parts)
    return top_k(found, k, keys=keys, by=query_key)


def dense_scores(base: DataFrame, queries: DataFrame, score: Column) -> DataFrame:
    """The same product as expressions, every stated query against every row: both sides are
    cut into blocks, and each pair of blocks is joined by itself."""
    across = max(1, -(-queries.count() // QUERY_ROWS))
    down = max(1, -(-base.count() // BASE_ROWS))
    salt = lambda rows, n: F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)).cast("int")
    asked = queries.withColumn("__q", salt(queries, across)).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    held = base.withColumn("__b", salt(base, down)).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return held.join(asked, ["__q", "__b"]).drop("__q", "__b").withColumn("score", F.round(score, 9))


# -- fusion


def rrf_fuse(first: DataFrame, second: DataFrame, *, rrf_k: int = 60, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, chunk_id, rank).

    Equal sums keep the order of the first list, then that of the second.
    """
    if rrf_k < 1 or k < 1:
        raise ValueError("rrf_k and k must be at least 1")
    one = first.select("query_id", *ITEM, F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2"))
    two = second.select("query_id", *ITEM, F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2"))
    both = one.unionByName(two).groupBy("query_id", *ITEM).agg(F.min("r1").alias("r1"), F.min("r2").alias("r2"))
    part = lambda r: F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("r1") + part("r2"), 9))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"))
    return both.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", *ITEM, "score")


def hybrid_top_k(chunks: DataFrame, queries: DataFrame, *, candidates: int = 20, rrf_k: int = 60, k: int = 5) -> DataFrame:
    """Dense and BM25 candidates, fused. `chunks` has doc_id, chunk_id, text, vector; `queries`
    query_id, query, vector. A query without BM25 hits keeps its dense hits and their cosines."""
    dense = materialize(dense_top_k(chunks, queries, candidates), "dense")
    lexical = materialize(bm25_top_k(chunks, queries, candidates), "lexical")
    fused = rrf_fuse(dense, lexical, rrf_k=rrf_k, k=k)
    answered = lexical.select("query_id").distinct()
    # only queries with lexical hits are fused
    alone = dense.join(answered, "query_id", "left_anti").filter(F.col("rank") <= k).select("query_id", "rank", *ITEM, "score")
    return fused.join(answered, "query_id", "left_semi").unionByName(alone)


def attach_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add text and parent_chunk_id of each hit's chunk and the text of its parent, null if missing.

    Only the texts of the hits' chunks, and then of their parents, leave the scan.
    """
    hits = materialize(hits, "hits")
    asked = hits.select(*ITEM).distinct()
    child = chunks.filter("role = 'child'").select(*ITEM, "text", "parent_chunk_id").join(asked, ITEM, "left_semi").distinct()
    child = materialize(child, "children")
    above = child.select("doc_id", "parent_chunk_id").distinct()
    parent = chunks.filter("role = 'parent'").select("doc_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text"))
    parent = parent.join(above, ["doc_id", "parent_chunk_id"], "left_semi").distinct()
    return hits.join(child, ITEM, "left").join(parent, ["doc_id", "parent_chunk_id"], "left")


def rerank(hits: DataFrame, queries: DataFrame, k: int, scorer: Column | None = None) -> DataFrame:
    """Order hits (with text and parent_text) by a scorer of `query` and `passage`, cut to k.

    A cross-encoder is such a scorer, as a pandas UDF. The one used by default counts the share
    of the query's distinct words that the passage has. Equal scores keep their order.
    """
    rows = hits.join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("passage", F.coalesce("parent_text", "text", F.lit("")))
    if scorer is None:
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        asked = words(F.col("query"))
        scorer = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(F.col("passage")))) / F.size(asked)).otherwise(0.0)
    rows = rows.withColumn("score", F.round(scorer, 9))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    rows = rows.withColumn("new", F.row_number().over(window)).filter(F.col("new") <= max(1, k))
    return rows.select("query_id", F.col("new").alias("rank"), *ITEM, "score")


def check_models(signatures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(collection, model) asked for -> allowed: the collection holds that model, or nothing."""
    held = signatures.groupBy("collection").agg(F.collect_set("model").alias("models"))
    joined = wanted.join(held, "collection", "left")
    return joined.select("collection", "model", (F.col("models").isNull() | F.array_contains("models", F.col("model"))).alias("allowed"))


