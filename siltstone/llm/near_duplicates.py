"""Groups of texts that are alike, by pivot distance tables.

A text's fingerprint is the set of its distinct shingles (runs of `words` consecutive words),
a long and sparse bit string; the Hamming distance of two fingerprints is the number of
shingles that only one has. Jaccard similarity t or more means a distance of at most
(1 - t) / (1 + t) times the sum of both sizes.

1. References are texts of the collection. References drawn at random tell nothing apart: sparse
   fingerprints are all about equally far from any of them. A text is therefore given the
   references in whose neighbourhood it lies: of the texts that agree with it in a band of
   min-hashes, the one with the least number is its reference for that band. With `bands` bands
   of `rows` min-hashes a pair at the threshold has no reference in common with a probability
   of (1 - t^rows)^bands at the most.
2. A reference's table holds its exact Hamming distance to each of its texts, a row per text,
   so that the tables grow with the texts and not with their pairs.
3. Candidates are made from the tables: two texts in the table of a reference whose distances to
   it differ by no more than they themselves may, which by the triangle inequality holds for all
   pairs alike. Of all the references that two texts share, the largest difference decides.
   Where one of the two is the reference, the table says their similarity.
4. The similarity of the other survivors is computed from the shingles.

Equal shingle sets are one fingerprint throughout, so that any number of copies of a text
costs what one does. A band that more than `bucket` fingerprints agree in gets REFERENCES
references; its rows are spread over cells by their size and their distances to two of them, and
only rows of neighbouring cells meet, block by block, all distances being part of the join's
condition. Rows of a band that is frequent within a batch are dealt to several tasks from
the start. No pair is left out.

Defined results: null texts and texts of fewer than `least` words, or of none, take no part; a
text of fewer words than a shingle is alike to those of the same words only; repeated rows
count once; an id that has several texts belongs to each of their classes; an empty table
gives an empty result. Shingles are compared by 32 bits of their hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

WORD = re.compile(r"[^\W_]+")
BUCKET = 64
#: References of a band that more than BUCKET fingerprints agree in.
REFERENCES = 8
#: Fingerprints in a block of a cell.
BLOCK = 512
#: The low bits of a band's key are its salt: rows of a band that is frequent in a batch, beyond
#: BUCKET of them, are dealt to so many tasks.
SALT_BITS = 10
#: Entries of a worker's table of word hashes, and of the fingerprints it has seen.
CACHE = 1 << 20


@dataclass(frozen=True)
class Likeness:
    """What counts as alike, and the bands of the candidate join."""

    words: int = 5
    threshold: float = 0.8
    least: int = 20
    rows: int = 8
    bands: int = 36


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray, odd: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str], words: int, least: int, hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts count, offsets, distinct shingle hashes of each, ascending)."""
    found = [WORD.findall(t.lower()) for t in texts]
    kept = np.array([i for i, w in enumerate(found) if len(w) >= max(least, 1)], np.int64)
    for i in kept:  # a text shorter than a shingle has one, of all its words
        found[i] += [""] * (words - len(found[i]))
    if not len(kept):
        return kept, np.zeros(1, np.int64), np.empty(0, np.uint64)
    sizes = np.array([len(found[i]) for i in kept], np.int64)
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(found[i] for i in kept)), np.uint64, int(sizes.sum()))
    h = np.zeros(len(flat) - words + 1, np.uint64)
    for k in range(words):
        h = (h + flat[k : len(flat) - words + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    owner = np.repeat(np.arange(len(kept)), sizes)
    inside = owner[: len(h)] == owner[words - 1 :]
    h, owner = h[inside], owner[: len(inside)][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    h, owner = h[new], owner[new]
    return kept, np.searchsorted(owner, np.arange(len(kept) + 1)), h


_SIGNATURES = pa.schema([("id", pa.string()), ("owner", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("shingles", pa.list_(pa.int32()))])
_SIGNATURE_DDL = "id string, owner long, sid long, n int, shingles array<int>"


def _sign(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            kept, offsets, h = shingle_sets(batch.column(2).to_pylist(), like.words, like.least, hashes)
            if not len(kept):
                continue
            sizes = np.diff(offsets)
            sids = np.add.reduceat(_mix(h, 0x165667B19E3779F9), offsets[:-1])
            sids = _mix(sids + sizes.astype(np.uint64), 0xD6E8FEB86659FD93).view(np.int64)
            first = np.zeros(len(kept), bool)  # the fingerprint itself is kept once per task
            for i, sid in enumerate(sids.tolist()):
                if sid not in seen:
                    first[i] = True
                    seen.add(sid)
            if len(seen) > CACHE:
                seen.clear()
            ends = np.concatenate([[0], np.cumsum(np.where(first, sizes, 0))]).astype(np.int32)
            values = (h[np.repeat(first, sizes)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~first))
            rows = pa.array(kept)
            columns = [batch.column(0).take(rows).cast(pa.string()), batch.column(1).take(rows), pa.array(sids), pa.array(sizes.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=_SIGNATURES)

    return run


def _bands(like: Likeness, bucket: int):
    """The key of each band of each fingerprint, with salt 0 but for rows of a key that is frequent in a batch."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 2**32, (like.bands, like.rows), np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, (like.bands, like.rows), np.uint32)
    salts = rng.integers(0, 2**63, like.bands, np.uint64)
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64())])
    low = np.uint64((1 << SALT_BITS) - 1)

    def salt(keys: np.ndarray) -> np.ndarray:
        keys &= ~low
        for key in keys:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            # the rows that have more than `bucket` of the same key before them
            later = np.flatnonzero(ordered[bucket + 1 :] == ordered[: -bucket - 1]) + bucket + 1
            key[order[later]] |= (1 + later % int(low)).astype(np.uint64)
        return keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 2000):
                batch = whole.slice(begin, 2000)
                sids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                starts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])[:-1]
                keys = np.empty((like.bands, len(sids)), np.uint64)
                for b in range(like.bands):
                    key = np.full(len(sids), salts[b], np.uint64)
                    for r in range(like.rows):
                        key = _mix(key + np.minimum.reduceat(h * factors[b, r] ^ shifts[b, r], starts), 0xE7037ED1A0B428DB)
                    keys[b] = key
                columns = [pa.array(salt(keys).ravel().view(np.int64)), pa.array(np.tile(sids, like.bands))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _references(bucket: int):
    """Rows (key, sid) in order of the key -> (key without salt, pivot, sid): the reference of each
    row, itself included, null for the rows of a key that more than `bucket` have. Keys of one
    fingerprint give no row."""
    schema = pa.schema([("key", pa.int64()), ("pivot", pa.int64()), ("sid", pa.int64())])
    low_bits = np.int64((1 << SALT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_sid = np.empty(0, np.int64), np.empty(0, np.int64)
        large = None  # a key of which rows were given out as too many

        def take(key: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups, or a part of one that is known to be large."""
            if not len(key):
                return
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            low, high = np.minimum.reduceat(sid, starts), np.maximum.reduceat(sid, starts)
            many = (key[starts] & low_bits) > 0
            for i in np.flatnonzero(sizes > bucket):
                many[i] |= len(np.unique(sid[starts[i] : starts[i] + sizes[i]])) > bucket
            if large is not None:
                many |= key[starts] == large
            rows = np.repeat((low != high) | many, sizes)
            pivot, mask = np.repeat(low, sizes)[rows], np.repeat(many, sizes)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(key[rows] & ~low_bits), pa.array(pivot, mask=mask), pa.array(sid[rows])], schema=schema)

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            sid = np.concatenate([held_sid, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            open_ = np.searchsorted(key, key[-1])  # the last group may go on in the next batch
            yield from take(key[:open_], sid[:open_])
            key, sid = key[open_:], sid[open_:]
            if len(sid) > 4 * bucket:
                sid = np.unique(sid)
                key = key[: len(sid)]
                if len(sid) > bucket:
                    large = key[0]
                    yield from take(key, sid)
                    key, sid = key[:0], sid[:0]
            held_key, held_sid = key, sid
        yield from take(held_key, held_sid)

    return run


def _most(a: str, b: str, threshold: float) -> Column:
    """The largest distance at which fingerprints of these sizes are alike."""
    return F.lit((1 - threshold) / (1 + threshold)) * (F.col(a) + F.col(b)) + 1e-9


def _distance(n: Column, shingles: Column, other_n: Column, other: Column) -> Column:
    return n + other_n - 2 * F.size(F.array_intersect(shingles, other))


def _as_pair(rows: DataFrame, on: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows twice, to be joined with themselves; `columns` begin with a_ and b_."""
    return tuple(rows.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "ab")


def signatures(texts: DataFrame, like: Likeness) -> DataFrame:
    """Fingerprints of the texts (id, owner, text), written once."""
    rows = texts.filter("text IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("owner").cast("long").alias("owner"), "text")
    return materialize(rows.mapInArrow(_sign(like), _SIGNATURE_DDL), "signatures")


def similar_fingerprints(signed: DataFrame, like: Likeness, bucket: int = BUCKET) -> DataFrame:
    """Pairs a < b of different fingerprints whose similarity is at least the threshold."""
    sets = signed.filter("shingles IS NOT NULL").select("sid", "n", "shingles")
    keys = sets.select("sid", "shingles").mapInArrow(_bands(like, bucket), "key long, sid long")
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_references(bucket), "key long, pivot long, sid long")
    met = materialize(met, "met")
    sets = materialize(sets.join(met.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    pairs = candidates(tables(met, sets), like.threshold)
    near = pairs.filter("far <= most").select("a", "b", "known")
    large = met.filter("pivot IS NULL").select("key", "sid").distinct()
    if not large.isEmpty():
        near = near.unionByName(_in_cells(large, sets, like.threshold).withColumn("known", F.lit(None).cast("double")))
        near = near.groupBy("a", "b").agg(F.max("known").alias("known"))
    near = materialize(near, "near")
    one, two = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"{s}_n"), F.col("shingles").alias(f"{s}_shingles")) for s in "ab")
    both = near.filter("known IS NULL").select("a", "b").join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    both = both.select("a", "b", (common / (F.col("a_n") + F.col("b_n") - common)).alias("similarity"))
    found = near.filter("known IS NOT NULL").select("a", "b", F.col("known").alias("similarity")).unionByName(both)
    return found.filter(F.col("similarity") >= like.threshold)


def tables(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The distance tables (pivot, sid, n, distance) of the references (pivot, sid)."""
    rows = met.filter("pivot IS NOT NULL").select("pivot", "sid").distinct().join(sets, "sid")
    pivots = sets.select(F.col("sid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles"))
    distance = _distance(F.col("n"), F.col("shingles"), F.col("pivot_n"), F.col("pivot_shingles"))
    return materialize(rows.join(pivots, "pivot").select("pivot", "sid", "n", distance.alias("distance")), "tables")


def candidates(tables: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b that share a reference and may be alike by their sizes.

    Columns: a, b, far (the largest difference of their distances to a reference), most (what it
    may be), known (their similarity, where one is a reference of the other).
    """
    left, right = _as_pair(tables, ["pivot"], ["sid", "n", "distance"])
    met = left.join(right, "pivot").filter("a_sid < b_sid").withColumn("most", _most("a_n", "b_n", threshold))
    met = met.filter(F.abs(F.col("a_n") - F.col("b_n")) <= F.col("most")).withColumn("far", F.abs(F.col("a_distance") - F.col("b_distance")))
    both = F.col("a_n") + F.col("b_n")
    known = F.when((F.col("a_sid") == F.col("pivot")) | (F.col("b_sid") == F.col("pivot")), (both - F.col("far")) / (both + F.col("far")))
    pairs = met.groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return pairs.agg(F.max("far").alias("far"), F.max("most").alias("most"), F.max(known).alias("known"))


def _in_cells(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b that share a frequent key and that its references do not discard.

    Sizes fall into classes whose ratio is 1 / threshold, so that a pair alike is of one class or
    of two next to each other; the lower one sets the width of the cells, the most by which the
    distances to a reference may differ.
    """
    named = [F.min_by("sid", F.xxhash64(F.lit(r), "sid")) for r in range(REFERENCES)]
    chosen = large.groupBy("key").agg(F.array(*named).alias("sids")).select("key", F.posexplode("sids").alias("r", "sid")).join(sets, "sid")
    chosen = chosen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "n", "shingles"))).alias("refs"))
    ref = lambda r: F.col("refs")[r]
    distances = [_distance(F.col("n"), F.col("shingles"), ref(r)["n"], ref(r)["shingles"]).alias(f"d{r}") for r in range(REFERENCES)]
    rows = materialize(large.join(sets, "sid").join(chosen, "key").select("key", "sid", "n", *distances), "distances")
    ratio = max(1 / threshold, 1.05)
    step = F.floor(F.log("n") / math.log(ratio) + 1e-9).cast("int")
    rows = rows.withColumn("step", step).withColumn("grid", F.explode(F.array("step", F.col("step") - 1)))
    width = F.greatest(F.lit(1.0), F.lit(2 * (1 - threshold) / (1 + threshold)) * F.pow(F.lit(ratio), F.col("grid") + 2))
    rows = rows.withColumns({f"x{r}": F.floor(F.col(f"d{r}") / width).cast("int") for r in (0, 1)})
    cell, columns = ["key", "grid", "x0", "x1"], ["sid", "n", "step", *[f"d{r}" for r in range(REFERENCES)]]
    left, right = _as_pair(rows, cell, columns)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for r in (0, 1):
        right = right.withColumn("o", F.explode(around)).withColumn(f"x{r}", F.col(f"x{r}") + F.col("o")).drop("o")
    count = lambda part, name: part.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = materialize(count(left, "lefts").join(count(right, "rights"), cell), "blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(blocks, cell).withColumns({"i": F.pmod(F.xxhash64("a_sid"), F.col("lefts")).cast("int"), "j": spread("rights")}).drop("lefts", "rights")
    right = right.join(blocks, cell).withColumns({"j": F.pmod(F.xxhash64("b_sid"), F.col("rights")).cast("int"), "i": spread("lefts")}).drop("lefts", "rights")
    far = F.greatest(*[F.abs(F.col(f"a_d{r}") - F.col(f"b_d{r}")) for r in range(REFERENCES)], F.abs(F.col("a_n") - F.col("b_n")))
    met = left.join(right, [*cell, "i", "j"]).filter((F.col("a_sid") < F.col("b_sid")) & (F.least("a_step", "b_step") == F.col("grid")))
    return met.filter(far <= _most("a_n", "b_n", threshold)).select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct()


def member_pairs(signed: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (id_a < id_b) of different owners with equal or linked fingerprints."""
    members = signed.select("sid", "id", "owner").distinct()
    repeated = members.groupBy("sid").agg(F.min("owner").alias("x"), F.max("owner").alias("y")).filter("x < y").select("sid")
    pairs = links.select("a", "b").unionByName(repeated.select(F.col("sid").alias("a"), F.col("sid").alias("b")))
    left = members.select(F.col("sid").alias("a"), F.col("id").alias("left_id"), F.col("owner").alias("left_owner"))
    right = members.select(F.col("sid").alias("b"), F.col("id").alias("right_id"), F.col("owner").alias("right_owner"))
    both = pairs.join(left, "a").join(right, "b").filter("left_owner <> right_owner AND (a <> b OR left_id < right_id)")
    return both.select(F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b")).filter("id_a <> id_b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(sid, group): the least fingerprint of each connected group of linked fingerprints.

    Every round takes the least label of the neighbours and then the label's own label, so that
    the rounds grow as the logarithm of a group's diameter; each is written, not collected.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")).select(F.col("a").alias("sid"), "group"), "labels")
    while True:
        around = edges.join(labels.withColumnsRenamed({"sid": "b", "group": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(around.withColumnRenamed("a", "sid"), "sid").select("sid", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        jump = step.select(F.col("sid").alias("group"), F.col("group").alias("next"))
        step = materialize(step.join(jump, "group", "left").select("sid", "old", F.least("group", F.coalesce("next", "group")).alias("group")), "labels")
        labels = step.select("sid", "group")
        if step.filter("old <> group").isEmpty():
            return labels


def near_duplicate_groups(texts: DataFrame, like: Likeness = Likeness(), bucket: int = BUCKET) -> DataFrame:
    """One row per text (id, owner, text) that takes part.

    Columns: id, owner, class_id (equal shingle sets), copies (ids in the class), links (other
    classes alike), group_id (the least class_id of all classes connected by links).
    """
    signed = signatures(texts, like)
    links = materialize(similar_fingerprints(signed, like, bucket).select("a", "b"), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    members = signed.select("sid", "id", "owner").distinct()
    classes = members.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"))
    classes = classes.join(degree, "sid", "left").join(components(links), "sid", "left")
    return members.join(classes, "sid").select(
        "id", "owner", F.col("sid").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "sid").alias("group_id")
    )
