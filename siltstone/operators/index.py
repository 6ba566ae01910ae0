"""The inverted index: postings with positions, lengths and corpus statistics.

A stored index has the items (id, keys, dl) and the postings (term, id, dl, tf, positions) of some
texts. Postings are written in folders by a hash of the term and sorted by term within, so that a
batch of queries reads the folders and row groups of its terms only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import index_terms, query_tokens

#: Folders that postings are dealt to by a hash of the term.
BUCKETS = 64
#: Query terms that are named in the read of stored postings; more are joined.
NAMED_TERMS = 1_000


def tokenized(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, terms: null texts have no terms."""
    return texts.select(*keys, F.coalesce(index_terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))


def lengths(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dl: terms in each text."""
    return tokens.select(*keys, F.size("terms").alias("dl"))


def postings(tokens: DataFrame, keys: list[str], positions: bool = False) -> DataFrame:
    """term, keys, tf, dl and, if asked for, the ascending positions of the term."""
    rows = tokens.select(*keys, F.size("terms").alias("dl"), F.posexplode("terms").alias("pos", "term"))
    aggs = [F.count(F.lit(1)).cast("int").alias("tf")]
    if positions:
        aggs.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.groupBy("term", *keys, "dl").agg(*aggs)


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n (texts) and avgdl (mean length), over all collections."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("terms").cast("double")).alias("avgdl"))


def parsed_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) -> query_id, terms, qtf: each distinct token, which underscores and
    folding may turn into a phrase of several terms or into none, and how often it occurs."""
    tokens = queries.select("query_id", F.explode(query_tokens(F.col("query"))).alias("token"))
    terms = tokens.select("query_id", index_terms(F.col("token")).alias("terms")).filter(F.size("terms") > 0)
    return terms.groupBy("query_id", "terms").agg(F.count(F.lit(1)).alias("qtf"))


# -- stored


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """items (id, keys, dl) and postings (bucket, term, id, dl, tf, positions) of the same texts."""

    items: DataFrame
    postings: DataFrame

    def of_terms(self, terms: DataFrame, known: list[str] | None = None) -> DataFrame:
        """The postings of the terms (term), of which there is a bounded number; `known` lists them, if it can."""
        rows = self.postings
        if known is None:
            known = [r["term"] for r in terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        if len(known) <= NAMED_TERMS:
            # literals prune folders and row groups
            table = self.postings.sparkSession.createDataFrame([(t,) for t in known], "term string")
            places = [r[0] for r in table.select(bucket(F.col("term"))).distinct().collect()]
            return rows.filter(F.col("bucket").isin(places) & F.col("term").isin(known))
        # the folders are pruned by the join at run time
        wanted = terms.select("term").distinct()
        return rows.join(wanted.withColumn("bucket", bucket(F.col("term"))), ["bucket", "term"], "left_semi")


def store(texts: DataFrame, keys: list[str], path: str, first_id: int = 0) -> None:
    """Write the index of texts (keys, text) below `path`; ids begin at `first_id` and have 40 bits: 14 of
    the task, of which there are so many at most, and 26 of its row."""
    spark = texts.sparkSession
    row = F.monotonically_increasing_id()
    ids = (F.shiftrightunsigned(row, 33) * F.lit(1 << 26) + row.bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(first_id)).alias("id")
    tokenized(texts.coalesce(1 << 14), keys).select(ids, *keys, "terms").write.mode("overwrite").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    tokens.select("id", *keys, F.size("terms").alias("dl")).write.mode("overwrite").parquet(f"{path}/items")
    rows = postings(tokens, ["id"], positions=True).withColumn("bucket", bucket(F.col("term")))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "term", "id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def stored_schemas(keys: dict[str, str]) -> tuple[str, str]:
    """Of items and postings, for keys of the given types."""
    named = ", ".join(f"{k} {t}" for k, t in keys.items())
    return f"id long, {named}, dl int", "term string, id long, dl int, tf int, positions array<int>, bucket int"
