"""Splitting oversized texts at natural boundaries, by lexical cohesion.

Along the words of a text, the similarity of the blocks of words before and after each gap
is measured (cosine of word counts). A gap's depth is how far its similarity lies below the
nearest peaks on both sides: deep valleys mark topic boundaries. For each piece, the cut is in
the deepest valley within its size window at which a paragraph, line or sentence ends; of
valleys equally deep, at the strongest of these, then at the last. Only where none of them ends
in the window are the ends of clauses looked at in the same way, and then those of words; only
where the window has none at all is text cut at the limit. Each piece then repeats the last `overlap` characters of the one before it.

Sizes are in code points. Pieces are slices of the stripped text: without their overlaps
they join to it exactly, and none is longer than the limit.

Defined results: a text is oversized if it is longer than the limit without leading and
trailing white space. Null and blank texts, and texts within the limit, give no pieces, nor
do block types without a limit of at least 1 (of several rows of a type the one with
the smallest limit holds). An overlap of more than half the limit counts as half. A last piece shorter than
min_chars is avoided where another cut allows it. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip

#: Words in the block on each side of a gap.
BLOCK = 20
#: The least part of the room that a piece fills, where a boundary allows it.
FILL = 0.5

WORDS = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W぀-ヿ㐀-鿿가-힯]+")
#: Boundaries, strongest first; a cut is put behind the match. The first SENTENCES of them are equal but for valleys equally deep.
SENTENCES = 3
KINDS = (
    re.compile(r"\r?\n[^\S\n]*\r?\n\s*"),
    re.compile(r"\r\n|[\n\r\u2028\u2029]"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*\s*"),
    re.compile(r"[,;:]+\s+|[，、；：]\s*"),
    re.compile(r"\s+"),
)


def gap_depths(words: list[str], block: int = BLOCK) -> np.ndarray:
    """Depth of the gap before each word; 0 where nothing is on one side."""
    n = len(words)
    depth = np.zeros(n + 1)
    if n < 4:
        return depth
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w.lower(), len(known)) for w in words), np.int64, n)
    gaps = np.arange(1, n)
    left, right = np.maximum(gaps - block, 0), np.minimum(gaps + block, n)
    dot = np.zeros(n - 1)
    inner_l, inner_r = (gaps - left).astype(float), (right - gaps).astype(float)
    for d in range(1, min(2 * block, n)):  # pairs of equal words at a distance of d
        same = np.concatenate([[0], np.cumsum(ids[d:] == ids[:-d])])
        top = n - d

        def count(a: np.ndarray, b: np.ndarray, same: np.ndarray = same, top: int = top) -> np.ndarray:
            """Pairs whose first word is at a <= i < b."""
            a, b = np.minimum(a, top), np.minimum(np.maximum(a, b), top)
            return same[b] - same[a]

        dot += count(np.maximum(left, gaps - d), np.minimum(gaps, right - d))
        if d < block:
            inner_l += 2 * count(left, gaps - d)
            inner_r += 2 * count(gaps, right - d)
    sim = dot / np.sqrt(inner_l * inner_r)
    peak_l, peak_r = _climb(sim), _climb(sim[::-1])[::-1]
    depth[1:n] = (peak_l - sim) + (peak_r - sim)
    return depth


def _climb(sim: np.ndarray) -> np.ndarray:
    """The peak reached from each gap going left, uphill as long as it does not go down."""
    peak = sim.copy()
    for i in range(1, len(sim)):
        if sim[i - 1] >= sim[i]:
            peak[i] = peak[i - 1]
    return peak


def split_points(text: str, limit: int, overlap: int, least: int, fill: float = FILL) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a stripped text, without overlaps."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit // 2))
    words = list(WORDS.finditer(text))
    starts = np.fromiter((m.start() for m in words), np.int64, len(words))
    depth = gap_depths([m.group() for m in words])
    found = []
    for kind in KINDS:
        ends = np.fromiter((m.end() for m in kind.finditer(text)), np.int64)
        found.append(ends[(ends > 0) & (ends < n)])
    kinds = []  # ends ascending, strength of each, depth of the valley there
    for tier in (found[:SENTENCES], *([f] for f in found[SENTENCES:])):
        strongest: dict[int, int] = {}
        for strength, ends in enumerate(reversed(tier)):
            strongest |= dict.fromkeys(ends.tolist(), strength)
        ends = np.array(sorted(strongest), np.int64)
        kinds.append((ends, np.array([strongest[e] for e in ends.tolist()]), depth[np.searchsorted(starts, ends)] if len(ends) else np.empty(0)))
    out, at = [], 0
    while True:
        room = limit if at == 0 else limit - overlap
        if n - at <= room:
            out.append((at, n))
            return out
        high = at + room
        if n - high < least and n - least > at:
            high = max(at + 1, n - least)
        cut = None
        for low in (at + max(1, int(fill * room)), at + 1):
            for ends, strength, deep in kinds:
                a, b = np.searchsorted(ends, low), np.searchsorted(ends, high, side="right")
                if a < b:
                    valleys = a + np.flatnonzero(deep[a:b] >= deep[a:b].max() - 1e-12)
                    cut = int(ends[valleys[strength[valleys] == strength[valleys].max()][-1]])
                    break
            if cut is not None:
                break
        if cut is None:
            cut = high
        out.append((at, cut))
        at = cut


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for sid, doc, parent, kind, text, limit, overlap, least in pdf.itertuples(index=False, name=None):
            text = text.strip()
            limit, overlap, least = int(limit), int(overlap), int(least)
            if len(text) <= limit:
                continue
            overlap = max(0, min(overlap, limit // 2))
            for k, (start, end) in enumerate(split_points(text, limit, overlap, least), 1):
                begin = start if k == 1 else max(0, start - overlap)
                rows.append((sid, doc, parent, kind, k, begin, start, end, text[begin:end]))
        yield pd.DataFrame(rows, columns=["storage_id", "doc_id", "parent_chunk_id", "block_type", "split_index", "begin", "start", "end", "text"])


PIECES = (
    "storage_id string, doc_id long, parent_chunk_id string, block_type string, split_index int, "
    "begin int, start int, end int, text string"
)


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the child chunks that exceed their block type's max_chars.

    Columns: storage_id, doc_id, parent_chunk_id, block_type, split_index (1..n), begin, start, end
    (positions in the stripped text, `begin` with the overlap), text (from begin to end).
    """
    kept = F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"), F.coalesce("min_chars", F.lit(0)).alias("min_chars"))
    bounds = limits.filter("block_type IS NOT NULL AND max_chars >= 1").groupBy("block_type").agg(F.min(kept).alias("kept"))
    bounds = bounds.select("block_type", "kept.*")
    rows = chunks.filter("role = 'child' AND text IS NOT NULL").select("storage_id", "doc_id", "parent_chunk_id", "block_type", "text")
    # length with white space is an upper bound: few rows go on to Python
    long = rows.join(bounds, "block_type").filter(F.length("text") > F.col("max_chars"))
    columns = ["storage_id", "doc_id", "parent_chunk_id", "block_type", "text", "max_chars", "overlap_chars", "min_chars"]
    long = long.select(*columns).dropDuplicates()
    return long.mapInPandas(_pieces, PIECES)


def invariants(pieces: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """What must hold of the pieces of each text: within (none is longer than max_chars), numbered (1 to n),
    joins (without overlaps they make the stripped text), overlapped (each begins with the end of the one before)."""
    most = limits.filter("max_chars >= 1").groupBy("block_type").agg(F.min("max_chars").alias("most"))
    whole = chunks.filter("role = 'child' AND text IS NOT NULL").select("storage_id", strip(F.col("text")).alias("whole")).distinct()
    parts = pieces.withColumn("own", F.expr("substring(text, start - begin + 1)")).withColumn("head", F.expr("left(text, start - begin)"))
    rows = parts.join(most, "block_type").groupBy("storage_id").agg(
        F.every(F.length("text") <= F.col("most")).alias("within"), F.array_sort(F.collect_list(F.struct("split_index", "own", "head", "text"))).alias("p")
    )
    joined = F.aggregate("p", F.lit(""), lambda s, x: F.concat(s, x["own"]))
    after = F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: F.element_at("p", i - 1)["text"].endswith(F.element_at("p", i)["head"]))
    rows = rows.join(whole, "storage_id").select(
        "storage_id", "within",
        (F.transform("p", lambda x: x["split_index"]) == F.sequence(F.lit(1), F.size("p"))).alias("numbered"),
        (joined == F.col("whole")).alias("joins"), F.when(F.size("p") > 1, F.forall(after, lambda x: x)).otherwise(True).alias("overlapped"),
    )
    return rows
