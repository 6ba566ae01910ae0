"""Long exact spans shared between documents, by compact windows.

The tokens of a text are its overlapping grams of `gram` characters, so that spans may begin
and end anywhere, also in text without spaces. Under a hash of the grams, the position c is
the minimum of every window of `span` characters that starts in a run [i0, i1]: these windows
form one compact window (i0, c, i1), a node of the Cartesian tree over the hashes that is
wide enough. For windows of one width these nodes are the runs of the sliding minimum, so that
they are taken from it and the rest of the tree is not built. A text of n characters has about 2 n / span of them. Equal windows have their
minimum at the same place, so two texts share a span only if compact windows of both have the
same minimal hash; as the spans are exact, one hash function finds all of them.

1. Compact windows of all documents are written once; of each hash the number of rows and
   the least and largest doc_id are counted with partial aggregates. Hashes of one document
   are dropped.
2. The windows left are joined to the texts by doc_id, which gives each its context: the
   characters of all its windows.
3. Windows of equal hash are interval-joined: how far the contexts of two agree to the left
   and to the right of c decides exactly which windows they share. Equal contexts are
   compared once. A hash with more than `bucket` rows is not compared in pairs: there equal
   contexts of two documents are shared as a whole, and of the distinct contexts the windows'
   texts are hashed to 128 bits; those found under two doc_ids are shared.
4. Overlapping and touching windows of a document are merged.

Defined results: null texts, null doc_ids and texts shorter than `span` share nothing and are
never shared; a span that recurs only within its own document is not shared; rows that repeat
a doc_id are the same document; an empty table gives an empty result. Positions are in code
points of the unchanged text, white space included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

SPAN = 200
GRAM = 32
#: Rows of a hash that are compared in pairs at most.
BUCKET = 64
#: A key of more than one in so many rows is broadcast.
HOT = 10_000
#: Windows looked at together in a long text; their runs may be cut there without loss.
BLOCK = 1 << 20

_POSITION = np.uint64((1 << 21) - 1)
_MULTIPLIERS = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every `gram` consecutive code points; gram is a power of two."""
    h = codes.astype(np.uint64)
    h += np.uint64(0x632BE59BD9B4E019)
    h *= _MULTIPLIERS[0]
    h ^= h >> np.uint64(29)
    width, k = 1, 1
    while width < gram:
        left = h[:-width] * _MULTIPLIERS[k % len(_MULTIPLIERS)]
        left += h[width:]
        left ^= left >> np.uint64(31)
        h = left
        width, k = 2 * width, k + 1
    h = h * _MULTIPLIERS[-1]
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from running minima of blocks of w."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def compact_windows(text: str, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, c, i0 and i1 of the compact windows of a text."""
    n = len(text)
    if n < span:
        return (np.empty(0, np.int64),) * 4
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for begin in range(0, n - span + 1, BLOCK):
        h = gram_hashes(codes[begin : begin + BLOCK + span - 1], gram)
        # high bits: the hash; low bits: the place, so that of equal hashes the first wins
        low = _sliding_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), span - gram + 1)
        c = (low & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        last = np.concatenate([first[1:], [len(c)]]) - 1
        at = c[first]
        parts.append((h[at].view(np.int64), at + begin, first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _windows(span: int, gram: int):
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int32()), ("i0", pa.int32()), ("i1", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [compact_windows(text.as_py(), span, gram) for text in batch.column(1)]
            if not found:
                continue
            sizes = [len(x[0]) for x in found]
            h, c, i0, i1 = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.repeat(ids, sizes).astype(np.int64)), *[pa.array(x.astype(np.int32)) for x in (c, i0, i1)]], schema=schema
            )

    return run


def _contexts(span: int):
    schema = pa.schema([("hash", pa.int64()), ("many", pa.bool_()), ("doc_id", pa.int64()), ("c", pa.int32()), ("i0", pa.int32()), ("i1", pa.int32()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            if not len(ids):
                continue
            flat = marks.flatten()
            columns = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            sizes = np.diff(marks.offsets.to_numpy())
            texts = np.repeat(np.arange(len(ids)), sizes)
            strings = batch.column(1).to_pylist()
            contexts = [strings[t][a : b + span] for t, a, b in zip(texts.tolist(), columns["i0"].tolist(), columns["i1"].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns["hash"]), pa.array(columns["many"].astype(bool)), pa.array(np.repeat(ids.to_numpy(zero_copy_only=False), sizes)),
                 *[pa.array(columns[x].astype(np.int32)) for x in ("c", "i0", "i1")], pa.array(contexts, pa.string())], schema=schema,
            )

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def shared_in_bucket(rows: list[tuple[int, int, int, int, str]], span: int) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) of the stretches that rows (doc_id, c, i0, i1, context) of one hash
    share with rows of another doc_id."""
    classes: dict[tuple[str, int], list[tuple[int, int, int, int]]] = {}
    for doc, c, i0, i1, context in rows:
        classes.setdefault((context, c - i0), []).append((doc, c, i0, i1))
    sides = [(context[:o][::-1], context[o:], {m[0] for m in members}, members) for (context, o), members in classes.items()]
    out = []
    for left, right, docs, members in sides:
        if len(docs) > 1:
            out += [(doc, i0, i1 + span) for doc, _, i0, i1 in members]
            continue
        spans = set()
        for other_left, other_right, others, _ in sides:
            if others == docs:
                continue
            before, behind = _common(left, other_left), _common(right, other_right)
            if before + behind >= span:
                spans.add((before, behind))
        # a member's window starts at c - before at the least and c + behind - span at the most
        out += [(doc, max(i0, c - before), min(i1 + span, c + behind)) for doc, c, i0, i1 in members for before, behind in spans]
    return out


def _compare(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "start", "end"]
        key, held = None, []
        for pdf in batches:
            out = []
            for h, *row in zip(*[pdf[x].tolist() for x in ("hash", "doc_id", "c", "i0", "i1", "context")], strict=True):
                if h != key:
                    if len(held) > 1:
                        out += shared_in_bucket(held, span)
                    key, held = h, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if len(held) > 1:
            yield pd.DataFrame(shared_in_bucket(held, span), columns=columns)

    return run


def _window_keys(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), 2000):
                part = pdf.iloc[begin : begin + 2000]
                sizes = (part["i1"] - part["i0"] + 1).to_numpy()
                out = {name: np.repeat(part[name].to_numpy(), sizes) for name in ("a", "b")}
                out["start"] = np.concatenate([np.arange(i0, i1 + 1) for i0, i1 in zip(part["i0"], part["i1"], strict=True)]) if len(part) else []
                out["key"] = [
                    xxhash.xxh3_128_digest(context[k : k + span].encode("utf-8", "surrogatepass"))
                    for context, n in zip(part["context"], sizes.tolist(), strict=True) for k in range(n)
                ]
                yield pd.DataFrame(out)[["key", "a", "b", "start"]]

    return run


def _join(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with a written table of counts `n` by key over `total` rows. Its frequent keys, of
    which there are at most HOT, are broadcast; no other key has more than a HOT-th of the rows."""
    hot = table.filter(F.col("n") * HOT > total)
    if hot.isEmpty():
        return rows.join(table, keys)
    hot = F.broadcast(hot)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col("n") * HOT <= total), keys))


def _in_large_buckets(rows: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end) shared in buckets that are not compared in pairs.

    Rows of equal context form a class, whose least and largest doc_id are known from partial
    aggregates. A class of two documents is shared as a whole; the windows of one row of each
    class are enough to see what the classes of a single document share with others.
    """
    total = rows.count()
    rows = rows.select(
        "hash", (F.col("c") - F.col("i0")).alias("at"), F.xxhash64("context").alias("k1"), F.xxhash64(F.lit(7), "context").alias("k2"), "doc_id", "i0", "i1", "context"
    )
    key = ["hash", "at", "k1", "k2"]
    classes = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")), "classes")
    classed = _join(rows, classes, key, total)
    whole = classed.filter("a < b").select("doc_id", F.col("i0").alias("start"), (F.col("i1") + span).alias("end"))
    first = classed.filter("doc_id = a").select("a", "b", "i0", "i1", "context")
    # of a class of several documents one row is enough; of a single one's, all are to be marked
    first = first.filter("a = b").unionByName(first.filter("a < b").dropDuplicates(["a", "b", "context"]))
    keys = materialize(first.mapInPandas(_window_keys(span), "key binary, a long, b long, start int"), "keys")
    common = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("x"), F.max("b").alias("y")).filter("x < y").select("key", "n")
    single = _join(keys.filter("a = b"), materialize(common, "common"), ["key"], keys.count())
    single = single.select(F.col("a").alias("doc_id"), "start", (F.col("start") + span).alias("end"))
    return whole.unionByName(single)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Unite overlapping and touching spans (doc_id, start, end) of each document."""
    ahead = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = spans.withColumn("__reach", F.max("end").over(ahead))
    spans = spans.withColumn("__run", F.sum(F.when(F.col("start") <= F.col("__reach"), 0).otherwise(1)).over(order))
    return spans.groupBy("doc_id", "__run").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end")).drop("__run")


def shared_spans(documents: DataFrame, *, span: int = SPAN, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """Maximal runs of shared characters of the documents (doc_id, text).

    Columns: doc_id, span_start (0-based), span_end (exclusive). `gram` is a power of two, at
    most `span`.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.filter((F.length("text") >= span) & F.col("doc_id").isNotNull())
    windows = texts.mapInArrow(_windows(span, gram), "hash long, doc_id long, c int, i0 int, i1 int")
    windows = materialize(windows, "windows")
    counts = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    counts = materialize(counts.filter("a < b").select("hash", "n", (F.col("n") > bucket).alias("many")), "counts")
    marks = _join(windows, counts, ["hash"], windows.count()).groupBy("doc_id").agg(F.collect_list(F.struct("hash", "many", "c", "i0", "i1")).alias("marks"))
    contexts = texts.join(marks, "doc_id").mapInArrow(
        _contexts(span), "hash long, many boolean, doc_id long, c int, i0 int, i1 int, context string"
    )
    contexts = materialize(contexts, "contexts")
    few = contexts.filter("NOT many").drop("many").repartition("hash").sortWithinPartitions("hash")
    found = few.mapInPandas(_compare(span), "doc_id long, start int, end int")
    large = contexts.filter("many").drop("many")
    if not large.isEmpty():
        found = found.unionByName(_in_large_buckets(large, span))
    return merge_spans(found)


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: characters, how many of them are shared, and the share; 0 for empty texts."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("spans"))
    docs = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    docs = docs.join(sums, "doc_id", "left").fillna(0, ["shared_chars", "spans"])
    share = F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0)
    return docs.select("doc_id", "chars", "shared_chars", "spans", share.alias("share"))
