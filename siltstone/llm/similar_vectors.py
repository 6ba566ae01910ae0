"""The most similar vectors of every vector, by score-aware quantisation.

The vectors of each space (a model and a number of dimensions) are compared by cosine.

1. Fit: on a sample of at most SAMPLE vectors of a space, k-means gives the centroids of the
   partitions, and product quantisation of two dimensions at a time gives 16 code words each,
   on at most WORDS_SAMPLE vectors drawn at random from all of that sample. Its loss is
   anisotropic: the error parallel to the vector, which is what changes a large inner product,
   weighs (d - 1) T^2 / (1 - T^2) times the error at right angles to it (T = 0.2). Codes are
   chosen and code words solved for by coordinate descent. The number of partitions grows with
   the space, at PER_PARTITION vectors each. Beyond LEVEL partitions a further level of centroids
   is fitted on what the levels before leave, so that the fitted model grows with the logarithm
   of the space. A partition's centroid is the sum of one centroid of each level.
2. Index: every vector gets four bits per pair of dimensions. As a query it stays in its own
   partition. Its codes, not the vector, are sent to the partitions where others may look for it:
   the `probes` nearest, and every other whose centroid has a cosine of DENSE or more with it,
   for a dense group of near copies lies in many partitions. One rule holds for any number of
   levels: both are found exactly, and sums that no further centroid can bring near enough are
   dropped level by level.
3. Scan: in each partition, a query's table of 16 products per pair of dimensions is summed
   over the codes; the sums of a block are one product with the code words written out, which
   is the same and much faster in numpy. With p the product of a unit vector and its code's
   vector and b the length of what that vector has at right angles to it, a cosine of t >= 0 or
   more means a sum of at least t p - b sqrt(1 - t^2) (p > 0), because a query is c times the
   vector plus sqrt(1 - c^2) times a unit vector at right angles to it. Rows below that for
   t = `least` are left out. Where `keep` rows or fewer are left, these go on; without `least`,
   the best `keep` by their sums do, if the last of them lies clearly below the k-th.
4. Exact reranking: the vectors of the rows left are fetched and their cosines computed. Where
   the codes do not tell rows apart (more rows than `keep` are left, or the best `keep` do not
   separate), the query is compared exactly with all rows of that partition instead, for which
   their vectors are sent there: a dense group costs more but loses nothing by its codes.

Equal vectors are indexed once; their copies are added to the neighbours afterwards. A
partition of more than DATA_BLOCK vectors, or met by more than QUERY_BLOCK queries, is cut
into blocks that are scanned in different tasks. Nothing is left out of the index.

Defined results: of a storage_id and model only the row with the latest embedded_at counts
(null is the earliest; then the largest vec_id), and only if its vector is not null, has
`dimensions` elements, none of them null, NaN or infinite, and is not all zero. Equal
similarities, to 9 decimals, are ordered by vec_id. A null storage_id or model is a value like any other.
A space with one vector gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize, small

#: Vectors of a space that the partitions and code words are fitted on, at most.
SAMPLE = 40_000
#: Vectors of those that the code words are fitted on, at most.
WORDS_SAMPLE = 8_192
#: Vectors aimed at in a partition.
PER_PARTITION = 2_048
#: Centroids of a level; a space of more than LEVEL x PER_PARTITION vectors has several levels.
LEVEL = 1_024
PROBES = 4
DENSE = 0.9
KEEP = 64
DATA_BLOCK = 16_384
QUERY_BLOCK = 8_192
T = 0.2
#: Sums of centroids held at a time.
CELLS = 2_000_000
#: Allowance for the sums in single precision.
SLACK = 1e-5
_KEY = ["space", "partition", "data_block", "query_block"]


def comparable(rows: DataFrame) -> DataFrame:
    """vec_id, space and vector of the rows that count."""
    newest = Window.partitionBy("storage_id", "model").orderBy(F.desc_nulls_last("embedded_at"), F.desc("vec_id"))
    rows = rows.select("vec_id", "storage_id", "model", "dimensions", "vector", "embedded_at")
    rows = rows.withColumn("__r", F.row_number().over(newest)).filter("__r = 1 AND vec_id IS NOT NULL")
    vector = F.col("vector")
    sane = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38))
    rows = rows.filter(vector.isNotNull() & (F.size(vector) == F.col("dimensions")) & sane & F.exists(vector, lambda x: x != 0))
    space = F.concat(F.coalesce(F.col("model"), F.lit("")), F.lit("/"), F.col("dimensions").cast("string"))
    return rows.select("vec_id", space.alias("space"), vector.cast("array<float>").alias("vector"))


# -- fitting


def _flat(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _exact_units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(vectors: np.ndarray) -> np.ndarray:
    return _exact_units(vectors).astype(np.float32)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5, unit: bool = True) -> np.ndarray:
    """Centroids of vectors, put to length one if `unit`; an empty partition moves to the worst served vector."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, own = np.empty(len(x), np.float32), np.empty(len(x), np.int64)
        half = 0.0 if unit else (centroids * centroids).sum(axis=1) / 2
        for a in range(0, len(x), 8192):
            s = x[a : a + 8192] @ centroids.T - half
            own[a : a + 8192] = s.argmax(axis=1)
            best[a : a + 8192] = s.max(axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        sums[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        empty = np.flatnonzero(n == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True) if unit else np.maximum(n, 1)[:, None]
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centroids).astype(np.float32)
    return centroids


def fit_levels(x: np.ndarray, wanted: int, level: int) -> list[np.ndarray]:
    """Centroids, level by level, of about `wanted` partitions; a partition is one of each level."""
    if wanted <= level:
        return [k_means(x, max(1, min(wanted, len(x))))]
    levels, left = [], x
    while wanted > 1:
        c = k_means(left, min(wanted, level, len(x)), unit=False)
        levels.append(c)
        left = left - c[(left @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)]
        wanted = -(-wanted // level)
    return levels


def partitions_of(x: np.ndarray, levels: list[np.ndarray], probes: int, dense: float = DENSE) -> tuple[np.ndarray, list[np.ndarray]]:
    """The partition of each unit vector and the partitions it is sent to.

    These are the `probes` whose centroids are nearest (the first of them is its own) and all whose
    centroids have a cosine of `dense` or more with it, exactly, for any number of levels.
    """
    dots, squares = [x @ c.T for c in levels], [(c * c).sum(axis=1) for c in levels]
    twice = [[2 * a @ c.T for a in levels[:i]] for i, c in enumerate(levels)]
    # the length that the levels after each can add
    reach = [sum(np.sqrt(s.max()) for s in squares[i + 1 :]) for i in range(len(levels))]
    sine = np.sqrt(1 - dense * dense)

    def sums(i: int, row: np.ndarray, along: np.ndarray, square: np.ndarray, path: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of sums of centroids and each centroid of level i more: product with x, squared length."""
        squared = square[:, None] + squares[i]
        for t, p in zip(twice[i], path, strict=True):
            squared += t[p]
        return along[:, None] + dots[i][row], np.maximum(squared, 0)

    homes, sent = [], []
    for a in range(0, len(x), step := max(1, CELLS // math.prod(len(c) for c in levels))):
        n = min(step, len(x) - a)
        start = np.arange(a, a + n), np.zeros(n, np.float32), np.zeros(n, np.float32), [], np.zeros(n, np.int64)
        # the nearest `probes` from level to level: some partitions as near as the last of these
        row, along, square, path, ids = start
        for i, c in enumerate(levels):
            products, squared = sums(i, row, along, square, path)
            score = (products - squared / 2).reshape(n, -1)
            width = min(probes, score.shape[1])
            first = np.argpartition(-score, width - 1, axis=1)[:, :width]
            f, last = np.divmod((first + np.arange(n)[:, None] * score.shape[1]).ravel(), len(c))
            row, along, square, path, ids = row[f], products[f, last], squared[f, last], [*[p[f] for p in path], last], ids[f] * len(c) + last
        bar = np.take_along_axis(score, first, axis=1).min(axis=1)
        far = np.sqrt(np.maximum(1 - 2 * bar, 0))
        # all partitions no farther than that, or in the cone of `dense`
        row, along, square, path, ids = start
        for i, c in enumerate(levels):
            products, squared = sums(i, row, along, square, path)
            score = products - squared / 2
            if i + 1 < len(levels):
                limit = reach[i] + 1e-4
                kept = 1 - 2 * score <= ((far + limit) ** 2)[row - a][:, None]
                kept |= dense * np.sqrt(np.maximum(squared - products * products, 0)) - sine * products <= limit
            else:
                close = products >= dense * np.sqrt(np.maximum(squared, 1e-30))
                kept = close | (score >= bar[row - a][:, None])
            f, last = np.nonzero(kept)
            row, along, square, path, ids = row[f], products[f, last], squared[f, last], [*[p[f] for p in path], last], ids[f] * len(c) + last
        row, close, score = row - a, close[f, last], score[f, last]
        order = np.lexsort((ids, -score, row))
        row, ids, close = row[order], ids[order], close[order]
        begin = np.searchsorted(row, np.arange(n))
        homes.append(ids[begin])
        chosen = close | (np.arange(len(row)) - begin[row] < probes)
        sent += np.split(ids[chosen], np.cumsum(np.bincount(row[chosen], minlength=n))[:-1])
    return np.concatenate(homes), sent


def _pairs_of(x: np.ndarray) -> np.ndarray:
    """(n, d) -> (n, pairs, 2), an odd last dimension being paired with 0."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1)
    return x.reshape(len(x), -1, 2)


def encode(x: np.ndarray, words: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n, pairs) that minimise the anisotropic error, one pair of dimensions at a time."""
    p = _pairs_of(x)
    n, pairs, _ = p.shape
    extra = max(0.0, (x.shape[1] - 1) * T * T / (1 - T * T) - 1)
    codes = np.empty((n, pairs), np.uint8)
    plain = np.empty((pairs, n, 16), np.float32)
    along = np.empty((pairs, n, 16), np.float32)  # part of the error along the vector
    for s in range(pairs):
        v = np.ascontiguousarray(p[:, s])
        own, dot = (v * v).sum(axis=1)[:, None], v @ words[s].T
        along[s] = own - dot
        plain[s] = along[s] - dot + (words[s] * words[s]).sum(axis=1)
        codes[:, s] = plain[s].argmin(axis=1)
    at = np.arange(n)
    total = sum(along[s][at, codes[:, s]] for s in range(pairs))
    for _ in range(sweeps):
        for s in range(pairs):
            rest = total - along[s][at, codes[:, s]]
            loss = plain[s] + extra * (rest[:, None] + along[s]) ** 2
            codes[:, s] = loss.argmin(axis=1)
            total = rest + along[s][at, codes[:, s]]
    return codes


def fit_words(x: np.ndarray, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Code words (pairs, 16, 2) for unit vectors, by the anisotropic loss."""
    rng = np.random.default_rng(seed)
    p = _pairs_of(x)
    pairs = p.shape[1]
    words = np.stack([p[rng.choice(len(p), 16, replace=len(p) < 16), s] for s in range(pairs)]).astype(np.float32)
    for _ in range(6):  # plain k-means to begin with
        for s in range(pairs):
            own = ((p[:, s, None, :] - words[s][None]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(own, minlength=16)
            for axis in (0, 1):
                sums = np.bincount(own, p[:, s, axis], minlength=16)
                words[s, :, axis] = np.where(n > 0, sums / np.maximum(n, 1), words[s, :, axis])
    extra = max(0.0, (x.shape[1] - 1) * T * T / (1 - T * T) - 1)
    for _ in range(rounds):
        codes = encode(x, words, 1)
        at = [words[s][codes[:, s]] for s in range(pairs)]
        errors = np.stack([((p[:, s] - at[s]) * p[:, s]).sum(axis=1) for s in range(pairs)])
        total = errors.sum(axis=0)
        for s in range(pairs):
            rest = total - errors[s]
            v = p[:, s].astype(np.float64)
            for k in range(16):
                m = codes[:, s] == k
                if not m.any():
                    continue
                vm = v[m]
                left = m.sum() * np.eye(2) + extra * vm.T @ vm
                right = vm.sum(axis=0) + extra * ((rest[m] + (vm * vm).sum(axis=1))[:, None] * vm).sum(axis=0)
                words[s, k] = np.linalg.solve(left, right)
    return words


def _fit(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(np.stack(pdf["vector"].iloc[pdf["vec_id"].argsort(kind="stable")].to_numpy()))
        few = x[np.sort(np.random.default_rng(3).permutation(len(x))[:WORDS_SAMPLE])]
        levels = [c.tobytes() for c in fit_levels(x, int(pdf["wanted"].iloc[0]), level)]
        return pd.DataFrame({"space": [pdf["space"].iloc[0]], "d": [x.shape[1]], "levels": [levels], "words": [fit_words(few).tobytes()]})

    return run


Model = dict[str, tuple[list[np.ndarray], np.ndarray]]


def fit(rows: DataFrame, sample: int = SAMPLE, per_partition: int | None = None, level: int | None = None) -> Model:
    """Centroids and code words of every space: per level at most LEVEL x d floats of each model."""
    per_partition, level = per_partition or PER_PARTITION, level or LEVEL
    sizes = rows.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(
        "space", F.least(F.lit(1.0), F.lit(0.95 * sample) / F.col("n")).alias("share"), F.ceil(F.col("n") / per_partition).alias("wanted")
    )
    chosen = rows.join(small(sizes, "spaces"), "space")
    # a small space is taken whole
    chosen = chosen.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_003)) / 1_000_003.0 < F.col("share"))
    chosen = chosen.select("vec_id", "space", "vector", "wanted")
    fitted = chosen.groupBy("space").applyInPandas(_fit(level), "space string, d int, levels array<binary>, words binary")
    return {
        r["space"]: ([np.frombuffer(c, np.float32).reshape(-1, r["d"]) for c in r["levels"]], np.frombuffer(r["words"], np.float32).reshape(-1, 16, 2))
        for r in fitted.collect()
    }


# -- the index


_INDEX = pa.schema([
    ("vec_id", pa.int64()), ("space", pa.string()), ("partition", pa.int64()), ("sent", pa.list_(pa.int64())), ("codes", pa.binary()),
    ("along", pa.float32()), ("across", pa.float32()), ("vector", pa.list_(pa.float32())),
])
_INDEX_DDL = "vec_id long, space string, partition long, sent array<long>, codes binary, along float, across float, vector array<float>"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _bytes(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix of bytes."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _index(model: Model, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            spaces = whole.column(1).dictionary_encode()
            for code, space in enumerate(spaces.dictionary.to_pylist()):
                levels, words = model[space]
                own = whole.take(pa.array(np.flatnonzero(spaces.indices.to_numpy() == code)))
                for a in range(0, len(own), 2048):
                    part = own.slice(a, 2048)
                    x = _units(_flat(part.column(2)))
                    home, sent = partitions_of(x, levels, probes)
                    codes = encode(x, words)
                    along, across = _errors(x, codes, words)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(1), pa.array(home.astype(np.int64)), _lists(sent, pa.int64()), _bytes(_pack(codes)),
                        pa.array(along.astype(np.float32)), pa.array(across.astype(np.float32)), part.column(2).cast(pa.list_(pa.float32())),
                    ], schema=_INDEX)

    return run


def _errors(x: np.ndarray, codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the codes' vectors, the part along the unit vectors x and the length of the rest."""
    coded = words[np.arange(len(words)), codes].reshape(len(x), -1)[:, : x.shape[1]].astype(np.float64)
    along = (coded * x).sum(axis=1)
    return along, np.linalg.norm(coded - along[:, None] * x, axis=1)


def _pack(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits to a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return np.ascontiguousarray(codes[:, 0::2] | (codes[:, 1::2] << 4))


def build_index(rows: DataFrame, model: Model, probes: int = PROBES) -> DataFrame:
    return materialize(rows.select("vec_id", "space", "vector").mapInArrow(_index(model, probes), _INDEX_DDL), "index")


# -- the scan


def decoded(packed: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The code words of packed codes written out: (vectors, d)."""
    codes = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
    return words[np.arange(len(words)), codes[:, : len(words)]].reshape(len(packed), -1)[:, :d]


def table_scores(queries: np.ndarray, packed: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of the queries' tables over the codes: (queries, vectors)."""
    return queries @ decoded(packed, words, queries.shape[1]).T


_CODED = "partition long, data_block int, query_block int, vec_id long, near array<long>, sums array<float>"
_FOUND = "vec_id long, found array<struct<away:double,near:long>>"


def _scan(words_of: dict[str, np.ndarray], k: int, keep: int, least: float):
    """The rows that codes leave of a block for each query; `near` is null where they are too many."""

    schema = pa.schema([
        ("partition", pa.int64()), ("data_block", pa.int32()), ("query_block", pa.int32()), ("vec_id", pa.int64()),
        ("near", pa.list_(pa.int64())), ("sums", pa.list_(pa.float32())),
    ])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        space, *place = (k.as_py() for k in key)
        x, own = _units(_flat(left["vector"])), left["vec_id"].to_numpy()
        ids = right["vec_id"].to_numpy()
        packed = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        along, across = right["along"].to_numpy(), right["across"].to_numpy()
        coded = decoded(packed, words_of[space], x.shape[1]).T
        t = np.float32(max(least, 0))
        low = np.where(along > 0, t * along - np.sqrt(1 - t * t) * across - SLACK, -9) if least > -1 else None
        parts = []  # per slice of the queries: query, whether its rows are too many, row, sum
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, own, sorter=order), len(ids) - 1)]
        itself = ids[at] == own
        for a in range(0, len(x), step := max(16, 4_000_000 // len(ids))):
            rough = x[a : a + step] @ coded
            same = np.flatnonzero(itself[a : a + step])
            rough[same, at[a : a + step][same]] = -9
            if low is not None:
                i, j = np.nonzero((rough >= low) & (rough > -9))
                full = np.bincount(i, minlength=len(rough)) > keep
            else:
                take = min(keep, rough.shape[1])
                j = np.argpartition(-rough, take - 1, axis=1)[:, :take]
                best = -np.sort(-np.take_along_axis(rough, j, axis=1), axis=1)
                # the spread of a sum about its cosine, for directions at random
                kth = best[:, min(k, take) - 1]
                wide = 3 * np.sqrt(2 * np.maximum(0, 1 - kth**2) / max(1, x.shape[1] - 1)) * across.mean()
                full = (best[:, -1] > kth - wide) & (rough.shape[1] > take)
                i, j = np.repeat(np.arange(len(rough)), take), j.ravel()
            kept = ~full[i] & (rough[i, j] > -9)
            i, j = i[kept], j[kept]
            parts.append((np.flatnonzero(full) + a, i + a, j, rough[i, j]))
        many, i, j, values = (np.concatenate(p) for p in zip(*parts, strict=True))
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else i
        asked = np.concatenate([own[i[first]], own[many]])
        offsets = np.concatenate([first, np.full(len(many) + 1, len(i))]).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(v), mask=pa.array(np.arange(len(asked)) >= len(first)))
            for v in (ids[j], values.astype(np.float32))
        ]
        return pa.Table.from_arrays([*[pa.array([p] * len(asked), f.type) for p, f in zip(place, schema, strict=False)], pa.array(asked), *lists], schema=schema)

    return run


def _compare(k: int, least: float):
    """The k nearest of a block for each query by the vectors themselves."""

    schema = pa.schema([("vec_id", pa.int64()), ("found", pa.list_(pa.struct([("away", pa.float64()), ("near", pa.int64())])))])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        x, own = _exact_units(_flat(left["vector"])), left["vec_id"].to_numpy()
        right = right.sort_by("vec_id")
        base, ids = _exact_units(_flat(right["vector"])), right["vec_id"].to_numpy()
        asked, found, take = [], [], min(k + 1, len(ids))
        for a in range(0, len(x), step := max(16, 2_000_000 // len(ids))):
            exact = (x[a : a + step] @ base.T).round(9)
            bar = np.maximum(-np.partition(-exact, take - 1, axis=1)[:, take - 1], least)
            for n, i in enumerate(range(a, min(a + step, len(x)))):
                j = np.flatnonzero((exact[n] >= bar[n]) & (ids != own[i]))
                j = j[np.argsort(-exact[n, j], kind="stable")[:k]]
                asked.append(own[i])
                found.append([{"away": -v, "near": w} for v, w in zip(exact[n, j].tolist(), ids[j].tolist(), strict=True)])
        return pa.table({"vec_id": asked, "found": found}, schema=schema)

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, near, and the vectors of both -> away, the cosine's opposite to 9 decimals."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = batch.column(2), batch.column(3)
        x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for v in (a, b))
        sizes = np.diff(a.offsets.to_numpy())
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for v in (x, y):
            v /= np.repeat(np.maximum.reduceat(np.abs(v), starts), sizes)
        dots, nx, ny = (np.add.reduceat(p, starts) for p in (x * y, x * x, y * y))
        away = -(dots / np.sqrt(nx * ny)).round(9)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away)], names=["vec_id", "near", "away"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of the lists of each vector."""
    return found.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def _scanned(queries: DataFrame, base: DataFrame, vectors: DataFrame, model: Model, k: int, keep: int, data_block: int, query_block: int, least: float = -2) -> DataFrame:
    """Scan (space, partition, vec_id, codes, along, across) for queries (space, partition, vec_id,
    vector), and rank what is left by `vectors` (vec_id, vector): vec_id and lists of the nearest.

    The table of block numbers has a row per partition.
    """
    by = ["space", "partition"]
    data = base.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / data_block).cast("int").alias("data_blocks"))
    asked = queries.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("query_blocks"))
    blocks = materialize(data.join(asked, by), "blocks")
    salt = F.xxhash64("vec_id")

    def cut(rows: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
        rows = rows.join(blocks, by).select(
            *by, "vec_id", *columns, F.pmod(salt, F.col(f"{own}s")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        )
        # both sides come from one table: new names tell their columns apart
        return rows.select(*[F.col(c).alias(f"__{c}") for c in rows.columns]).select(*[F.col(f"__{c}").alias(c) for c in rows.columns])

    words = {space: w for space, (_, w) in model.items()}
    left = cut(queries, "query_block", "data_block", ["vector"]).groupBy(*_KEY)
    right = cut(base, "data_block", "query_block", ["codes", "along", "across"]).groupBy(*_KEY)
    coded = materialize(left.cogroup(right).applyInArrow(_scan(words, k, keep, least), _CODED), "coded")
    pairs = coded.filter("near IS NOT NULL")
    if least > -1:
        pairs = pairs.select("vec_id", F.explode("near").alias("near"))
    else:  # of the lists of several blocks the best by their sums
        both = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.transform("sums", lambda s: -s).alias("away"), F.col("near").alias("near")))))
        pairs = pairs.groupBy("vec_id").agg(F.slice(both, 1, keep).alias("p")).select("vec_id", F.explode(F.transform("p", lambda p: p["near"])).alias("near"))
    pairs = materialize(pairs, "pairs")
    one, two = (vectors.select(F.col("vec_id").alias(i), F.col("vector").alias(v)) for i, v in (("vec_id", "v1"), ("near", "v2")))
    exact = pairs.join(one, "vec_id").join(two, "near").select("vec_id", "near", "v1", "v2").mapInArrow(_cosines, "vec_id long, near long, away double")
    found = exact.filter(F.col("away") <= -least).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("away", "near"))).alias("found"))
    close = coded.filter("near IS NULL").select("partition", "data_block", "query_block", "vec_id")
    if not close.isEmpty():
        # queries that codes do not settle meet all rows of those blocks with their vectors
        close = close.join(queries.select("vec_id", "space", "vector").dropDuplicates(["vec_id"]), "vec_id")
        met = close.select(*_KEY).distinct()
        rows = cut(base, "data_block", "query_block", []).join(met, _KEY, "left_semi").join(vectors.select("vec_id", "vector"), "vec_id")
        rows = rows.select(*[F.col(c).alias(f"__{c}") for c in rows.columns]).select(*[F.col(f"__{c}").alias(c) for c in rows.columns])
        found = found.unionByName(close.groupBy(*_KEY).cogroup(rows.groupBy(*_KEY)).applyInArrow(_compare(k, least), _FOUND))
    return found


def _distinct_vectors(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of equal vectors the one with the least vec_id stands for all.

    Returns the distinct rows (vec_id, space, vector), and of vectors that occur more than once
    their copies (rep, ids: the first k + 1) and members (vec_id, rep).
    """
    keyed = rows.select("vec_id", F.xxhash64("space", "vector").alias("h"), F.xxhash64(F.lit(11), "vector", "space").alias("g"))
    repeated = keyed.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep")).filter("n > 1").select("h", "g", "rep")
    members = materialize(keyed.join(repeated, ["h", "g"]).select("vec_id", "rep"), "members")
    number = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    first = members.withColumn("__r", number).filter(F.col("__r") <= k + 1)
    copies = first.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = rows.join(members.filter("vec_id <> rep").select("vec_id"), "vec_id", "left_anti")
    return distinct, materialize(copies, "copies"), members


def nearest(rows: DataFrame, k: int = 5, *, probes: int = PROBES, keep: int = KEEP, least: float = -2) -> DataFrame:
    """The k most similar other vectors of every counting row of `rows`, without those less similar than `least`.

    Columns: vec_id, rank, near_id, similarity (exact cosine; up to the probes, see above).
    """
    counting = materialize(comparable(rows), "vectors")
    distinct, copies, members = _distinct_vectors(counting, k)
    model = fit(distinct)
    index = build_index(distinct, model, probes)
    base = index.select("space", F.explode("sent").alias("partition"), "vec_id", "codes", "along", "across")
    found = _scanned(index.select("space", "partition", "vec_id", "vector"), base, index.select("vec_id", "vector"), model, k, keep, DATA_BLOCK, QUERY_BLOCK, least)
    return _with_copies(found, copies, members, k)


def _with_copies(found: DataFrame, copies: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k nearest of all, from what was found for one of each set of equal vectors."""
    reps = materialize(_merged(found, k), "found")
    # of each neighbour its first ids, and the other copies of the vector itself
    wide = reps.select("vec_id", F.explode("found").alias("f")).select("vec_id", "f.away", "f.near")
    wide = wide.join(copies.withColumnRenamed("rep", "near"), "near", "left").withColumn("ids", F.coalesce("ids", F.array("near")))
    wide = wide.select("vec_id", F.transform("ids", lambda i: F.struct(F.col("away").alias("away"), i.alias("near"))).alias("found"))
    same = copies.select(F.col("rep").alias("vec_id"), F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("away"), i.alias("near"))).alias("found"))
    lists = materialize(_merged(wide.unionByName(same), k + 1), "lists")
    others = members.filter("vec_id <> rep").join(lists.withColumnRenamed("vec_id", "rep"), "rep").select("vec_id", "found")
    own = lists.unionByName(others)
    own = own.withColumn("found", F.slice(F.filter("found", lambda f: f["near"] != F.col("vec_id")), 1, k))
    out = own.select("vec_id", F.posexplode("found").alias("rank", "f"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("f.near").alias("near_id"), (-F.col("f.away")).alias("similarity"))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, *, keep: int = KEEP, data_block: int = DATA_BLOCK, query_block: int = 2_048) -> DataFrame:
    """The k most similar other rows of the queries (a column vec_id), by scanning all codes.

    Columns: vec_id, rank, near_id, similarity (exact cosine). Copies of a vector are scanned
    once, for the queries among them as well as in the index.
    """
    counting = materialize(comparable(rows), "vectors")
    distinct, copies, members = _distinct_vectors(counting, k)
    model = fit(distinct)
    index = build_index(distinct, model, 1).withColumn("partition", F.lit(0).cast("long"))
    wanted = materialize(queries.select("vec_id").distinct().join(members, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id")), "wanted")
    asked = index.join(wanted.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi").select("space", "partition", "vec_id", "vector")
    base = index.select("space", "partition", "vec_id", "codes", "along", "across")
    found = _with_copies(_scanned(asked, base, index.select("vec_id", "vector"), model, k, keep, data_block, query_block), copies, members, k)
    return found.join(wanted.select("vec_id"), "vec_id", "left_semi")
