"""From blocks to parent and child chunks.

Blocks are rows (doc_id, block_seq, block_id, block_type, text, parent_block_id, ord, ...).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

#: The block types that become parent chunks and those that become children.
PARENT_TYPES = ("document", "page", "slide", "section", "module", "code_container", "table")
CHILD_TYPES = ("paragraph", "code_block", "code_symbol", "table_row", "list_item", "shape", "note", "figure", "record")

CHILD_MAX, OVERLAP, PARENT_MAX, CHILD_MIN = 1000, 150, 6000, 20
MARKER = "\n\n[...]"
SEPARATORS = ("\n\n", "\n", ". ", "; ", " ")


def role(block_type: Column) -> Column:
    return F.when(block_type.isin(*PARENT_TYPES), "parent").when(block_type.isin(*CHILD_TYPES), "child")


# -- the tree


def owners(blocks: DataFrame, rounds: int = 64) -> DataFrame:
    """doc_id, block_id, owner_id: the nearest ancestor of a parent type, null if there is none.

    Pointers are doubled: each round a block that points to a child-type block takes over where
    that one points to, so the rounds grow with the logarithm of the depth.
    """
    nodes = blocks.select("doc_id", "block_id", "parent_block_id", (role(F.col("block_type")) == "parent").alias("ends"))
    up = nodes.select("doc_id", F.col("block_id").alias("at"), "ends", F.col("parent_block_id").alias("next"))
    state = nodes.select("doc_id", "block_id", F.col("parent_block_id").alias("at"))
    state = state.join(up, ["doc_id", "at"], "left").select("doc_id", "block_id", "at", F.coalesce("ends", F.lit(False)).alias("ends"), F.col("ends").isNotNull().alias("there"))
    for _ in range(rounds):
        state = materialize(state, "owners")
        if state.filter("there AND NOT ends").isEmpty():
            break
        step = state.select("doc_id", F.col("block_id").alias("at"), F.col("at").alias("to"), F.col("ends").alias("to_ends"), F.col("there").alias("to_there"))
        moved = state.filter("there AND NOT ends").join(step, ["doc_id", "at"], "left")
        moved = moved.select("doc_id", "block_id", F.col("to").alias("at"), F.coalesce("to_ends", F.lit(False)).alias("ends"), F.coalesce("to_there", F.lit(False)).alias("there"))
        state = state.filter("NOT there OR ends").unionByName(moved)
    return state.select("doc_id", "block_id", F.when(F.col("ends"), F.col("at")).alias("owner_id"))


def descendant_leaves(blocks: DataFrame) -> DataFrame:
    """(doc_id, parent_id, leaf_id): every non-empty child-type block under every parent-type block.

    The chains of parent-type blocks are closed by doubling: each round joins the ancestors up to
    a distance to those that lie that distance above, so the rounds grow with the logarithm of the
    depth and no limit of rows or levels applies. A chain longer than the blocks is a cycle.
    """
    known = F.when(role(F.col("block_type")) == "parent", F.col("block_type")).otherwise(CHILD_TYPES[0])
    owner = materialize(owners(blocks.withColumn("block_type", known)), "owner")
    heads = blocks.filter(F.col("block_type").isin(*PARENT_TYPES)).select("doc_id", "block_id")
    above = owner.filter("owner_id IS NOT NULL").join(heads, ["doc_id", "block_id"], "left_semi")
    jump = materialize(above.select("doc_id", "block_id", F.col("owner_id").alias("at")), "jump")
    reach = materialize(heads.select("doc_id", "block_id", F.col("block_id").alias("at")), "reach")
    most, length = jump.count(), 1
    while not jump.isEmpty():
        if length > most:
            raise ValueError("blocks lie below themselves")
        far = reach.select("doc_id", F.col("block_id").alias("mid"), "at")
        step = jump.select("doc_id", "block_id", F.col("at").alias("mid"))
        reach = materialize(reach.unionByName(step.join(far, ["doc_id", "mid"]).select("doc_id", "block_id", "at")), "reach")
        twice = jump.select("doc_id", F.col("block_id").alias("mid"), "at")
        jump = materialize(step.join(twice, ["doc_id", "mid"]).select("doc_id", "block_id", "at"), "jump")
        length *= 2
    leaves = blocks.filter(F.col("block_type").isin(*CHILD_TYPES) & (F.col("text") != "")).select("doc_id", F.col("block_id").alias("leaf_id"))
    leaves = leaves.join(owner.select("doc_id", F.col("block_id").alias("leaf_id"), F.col("owner_id").alias("block_id")), ["doc_id", "leaf_id"])
    return leaves.join(reach, ["doc_id", "block_id"]).select("doc_id", F.col("at").alias("parent_id"), "leaf_id")


def truncated(text: Column, most: int = PARENT_MAX) -> Column:
    """Text cut to `most` characters with a marker at its end."""
    if most <= len(MARKER):
        return F.substring(text, 1, max(0, most))
    cut = F.concat(F.regexp_replace(F.substring(text, 1, most - len(MARKER)), r"(?U)\s+$", ""), F.lit(MARKER))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def assemble_parents(parents: DataFrame, leaves: DataFrame, keys: list[str], order: list[str], most: int = PARENT_MAX) -> DataFrame:
    """keys, text, char_count: a parent's own text, then its leaves' in order, between blank lines."""
    parts = leaves.filter("text <> ''").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("parts"))
    rows = parents.select(*keys, F.col("text").alias("own")).join(parts, keys, "left")
    pieces = F.concat(F.filter(F.array("own"), lambda t: t != ""), F.coalesce(F.transform("parts", lambda p: p["text"]), F.array().cast("array<string>")))
    rows = rows.withColumn("text", truncated(F.array_join(pieces, "\n\n"), most))
    return rows.select(*keys, "text", F.length("text").alias("char_count"))


# -- splitting


def _fill(pieces: Iterator[str], most: int, wide) -> Iterator[str]:
    """Join pieces as long as they fit; one that is too long alone goes through `wide`."""
    held = ""
    for piece in pieces:
        if len(held) + len(piece) <= most:
            held += piece
            continue
        if held:
            yield held
        if len(piece) > most:
            yield from wide(piece)
            held = ""
        else:
            held = piece
    if held:
        yield held


def _slices(text: str, most: int) -> list[str]:
    return [text[i : i + most] for i in range(0, len(text), most)]


def _divide(text: str, most: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= most:
        return [text]
    found = next((s for s in separators if s in text), None)
    if found is None:
        return _slices(text, most)
    *heads, tail = text.split(found)
    # an oversize piece goes on with the separators after the first of those in use
    wide = (lambda p: _slices(p, most)) if found == " " else (lambda p: _divide(p, most, separators[1:]))
    return [c for c in _fill((*(h + found for h in heads), tail), most, wide) if c]


def split_text(text: str, most: int = CHILD_MAX, overlap: int = OVERLAP, least: int = CHILD_MIN) -> list[str]:
    """Pieces of at most `most` characters at the strongest separator present.

    Pieces shorter than `least` are joined to the next. A last piece that is too short is joined
    to the one before if it fits, and is otherwise lost. Each piece is preceded by the end of the
    one before, except where it would then be too long.
    """
    if not text:
        return []
    if len(text) <= most:
        return [text]
    parts = _divide(text, most, SEPARATORS)
    if least > 0:
        joined: list[str] = []
        open_ = False  # the last piece may still grow
        for part in parts:
            if open_ and len(joined[-1]) < least and len(joined[-1]) + len(part) <= most:
                joined[-1] += part
            else:
                joined.append(part)
                open_ = True
        if len(joined) > 1 and len(joined[-1]) < least:
            last = joined.pop()
            if len(joined[-1]) + len(last) <= most:
                joined[-1] += last
        parts = joined
    if overlap > 0:
        for i in range(1, len(parts)):
            longer = parts[i - 1][-overlap:] + parts[i]
            if len(longer) <= most:
                parts[i] = longer
    return parts


def splitter(most: int = CHILD_MAX, overlap: int = OVERLAP, least: int = CHILD_MIN):
    """split_text as an Arrow function of a column, giving array<string>."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, most, overlap, least))

    return split


def child_chunks(blocks: DataFrame, most: int = CHILD_MAX, overlap: int = OVERLAP, least: int = CHILD_MIN) -> DataFrame:
    """Child chunks of the non-empty child-type blocks (doc_id, block_seq, block_id, block_type, text).

    Only blocks that are too long go through Python. Columns: doc_id, block_seq, block_id,
    block_type, chunk_id, split_index, text, char_count, is_split.
    """
    leaves = blocks.filter((role(F.col("block_type")) == "child") & (F.col("text") != ""))
    keys = ["doc_id", "block_seq", "block_id", "block_type"]
    short = leaves.filter(F.length("text") <= most).select(*keys, F.lit(0).alias("part"), "text", F.lit(1).alias("parts"))
    long = leaves.filter(F.length("text") > most).withColumn("pieces", splitter(most, overlap, least)("text"))
    long = long.select(*keys, F.size("pieces").alias("parts"), F.posexplode("pieces").alias("part", "text"))
    both = short.unionByName(long)
    split = F.col("parts") > 1
    return both.select(
        *keys,
        F.concat(F.lit("child_"), "block_id", F.when(split, F.concat(F.lit("_part_"), (F.col("part") + 1).cast("string"))).otherwise("")).alias("chunk_id"),
        F.when(split, F.col("part") + 1).otherwise(0).cast("int").alias("split_index"),
        "text", F.length("text").alias("char_count"), split.alias("is_split"),
    )


def chunk_documents(blocks: DataFrame, raw: DataFrame | None = None, *, child_max: int = CHILD_MAX, overlap: int = OVERLAP, parent_max: int = PARENT_MAX, least: int = CHILD_MIN) -> DataFrame:
    """Parent and child chunks of parsed documents.

    `blocks` as above; `raw` has doc_id and raw_text for documents whose leaves no parent owns:
    they get one synthetic parent. Columns: doc_id, chunk_id, role, text, source_block_id,
    parent_chunk_id, split_index, block_type, ord (parents first, in block order).
    """
    owned = owners(blocks)
    leaves = blocks.filter((role(F.col("block_type")) == "child") & (F.col("text") != ""))
    held = materialize(leaves.join(owned, ["doc_id", "block_id"]), "leaves")
    used = held.filter("owner_id IS NOT NULL").select("doc_id", F.col("owner_id").alias("block_id")).distinct()
    heads = blocks.join(used, ["doc_id", "block_id"], "left_semi")
    parts = held.select("doc_id", F.col("owner_id").alias("block_id"), "ord", "block_seq", "text")
    texts = assemble_parents(heads, parts, ["doc_id", "block_id"], ["ord", "block_seq"], parent_max)
    parents = heads.select("doc_id", "block_seq", "block_id", "block_type").join(texts, ["doc_id", "block_id"]).select(
        "doc_id", F.concat(F.lit("parent_"), "block_id").alias("chunk_id"), F.lit("parent").alias("role"), "text", F.col("block_id").alias("source_block_id"),
        F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(0).alias("split_index"), "block_type", F.col("block_seq").alias("seq"),
    )
    orphans = held.join(used.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = orphans.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", "text"))), lambda p: p["text"]), "\n\n").alias("joined"))
    if raw is not None:
        whole = whole.join(raw.select("doc_id", "raw_text"), "doc_id", "left").withColumn("joined", F.coalesce(F.nullif("raw_text", F.lit("")), "joined"))
    kind = blocks.groupBy("doc_id").agg(
        F.min_by(F.when(role(F.col("block_type")) == "parent", F.col("block_type")), F.when(role(F.col("block_type")) == "parent", F.col("block_seq"))).alias("p"),
        F.min_by("block_type", "block_seq").alias("b"),
    )
    synthetic = whole.join(kind, "doc_id").select(
        "doc_id", F.lit("parent_doc_synthetic").alias("chunk_id"), F.lit("parent").alias("role"), truncated(F.col("joined"), parent_max).alias("text"),
        F.lit("__synthetic_document__").alias("source_block_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(0).alias("split_index"),
        F.coalesce("p", "b").alias("block_type"), F.lit(-1).alias("seq"),
    )
    children = child_chunks(blocks, child_max, overlap, least).join(owned, ["doc_id", "block_id"])
    children = children.join(synthetic.select("doc_id", F.col("chunk_id").alias("synthetic")), "doc_id", "left").select(
        "doc_id", "chunk_id", F.lit("child").alias("role"), "text", F.col("block_id").alias("source_block_id"),
        F.coalesce(F.concat(F.lit("parent_"), "owner_id"), "synthetic").alias("parent_chunk_id"), "split_index", "block_type", F.col("block_seq").alias("seq"),
    )
    both = parents.unionByName(synthetic).unionByName(children)
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("role") == "parent", 0).otherwise(1), "seq", "split_index")
    return both.withColumn("ord", F.row_number().over(order) - 1).drop("seq")


def gaps(intervals: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """What intervals (keys, start, end) leave uncovered of ranges (keys, range_start, range_end).

    Columns: keys, gap_index (from 0), gap_start, gap_end. Empty ranges have no gaps.
    """
    rows = ranges.join(intervals.filter("end > start"), keys).filter("end > range_start AND start < range_end")
    rows = rows.select(*keys, "range_start", "range_end", F.greatest("start", "range_start").alias("a"), F.least("end", "range_end").alias("b"))
    # a closing interval at the range's end makes the last gap like any other
    close = ranges.filter("range_end > range_start").select(*keys, "range_start", "range_end", F.col("range_end").alias("a"), F.col("range_end").alias("b"))
    rows = rows.unionByName(close)
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gap_start", F.coalesce(F.max("b").over(before), F.col("range_start"))).filter("a > gap_start")
    number = Window.partitionBy(*keys).orderBy("gap_start")
    return rows.select(*keys, (F.row_number().over(number) - 1).alias("gap_index"), "gap_start", F.col("a").alias("gap_end"))
