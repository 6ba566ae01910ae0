"""Processing only new or changed records, whatever earlier runs failed half-way.

A change log takes every observation once, as it is delivered. Each delivery is a folder of its
own. Each write task appends to its own log partition, so that appending needs no shuffle, and
numbers its rows from the end of that partition on: (partition, offset) names a log row for
good. When the rows are written, a marker with the partitions' ends puts the delivery in place;
rows without it are not seen.

A run
1. plans: the deliveries since the last plan, and with them the offsets from the last commit to
   the log's end, per partition, are written ahead as plan N. If plan N is there already, a run
   failed after planning: it is replayed as it stands, so that the same rows are processed
   again, no more and no fewer;
2. applies plan N: only the planned deliveries' folders are read, their rows reduced to the newest
   per key, pre-aggregated before the shuffle, and written to the sink as batch N, replacing
   what a failed run may have left of it;
3. commits N by putting its marker into place. Rows of batches without a commit are not seen.

Every `compact_every` runs the sink's batches are merged into a base, so that reading it costs its
keys and the batches since. What a run reads grows with what was delivered since the last.

Reading the sink deduplicates by key and offset: of each key the row with the newest version
holds, of equal versions the one with the larger value columns, then the larger offset.

Runners: markers and plans go into place whole, under a name of the runner's own first. Where the
file system renames atomically (HDFS, local), the second of two runners that race is refused.
Each also reads back whose file is there, so that on a store that lets the last one win the
others notice, too.

Defined results: rows with a null key, version or value are not changes and are skipped; rows
delivered late or repeatedly change nothing unless newer; an empty log gives an empty sink.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import SMALL

_MASK = (1 << 33) - 1


class Conflict(RuntimeError):
    """Another runner put a plan, delivery or commit into place first."""


class Folder:
    """Small files in a folder that all nodes share, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self._conf), path

    def names(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def numbers(self, name: str) -> list[int]:
        """The files whose name is a number, ascending."""
        return sorted(int(n) for n in self.names(name) if n.isdigit())

    def read(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def write(self, name: str, text: str) -> bool:
        """Put a file in place as a whole; False if another is there or came first."""
        fs, path = self._at(name)
        if fs.exists(path):
            return False
        text = f"{text}\n{uuid.uuid4().hex}"  # whose file it is
        own, temporary = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = own.create(temporary, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        none = self._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE  # an existing file is not replaced
        try:
            hadoop.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), self._conf).rename(temporary, path, none)
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            own.delete(temporary, False)
            return False
        return self.read(name) == text

    def body(self, name: str) -> str | None:
        """The text of a file that `write` put into place."""
        text = self.read(name)
        return None if text is None else text.rpartition("\n")[0]


class ChangeLog:
    """A log of observations, its runs and the sink of the newest row of every key."""

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, values: list[str], compact_every: int = 16):
        self.spark, self.key, self.version, self.values = spark, key, version, list(values)
        self.folder = Folder(spark, root)
        self.root, self.compact_every = self.folder.root, compact_every

    # -- the log

    def deliveries(self) -> int:
        """Number of the last delivery in place; 0 if none."""
        return max(self.folder.numbers("ends"), default=0)

    def ends(self, delivery: int | None = None) -> dict[int, int]:
        """Offset after the last row, by log partition (as many as tasks ever wrote at once)."""
        marker = self._delivery(self.deliveries() if delivery is None else delivery)
        return {int(k): v for k, v in marker["ends"].items()}

    def _delivery(self, number: int) -> dict:
        text = self.folder.body(f"ends/{number}") if number else None
        return json.loads(text) if text else {"folder": None, "ends": {}}

    def append(self, rows: DataFrame, key: Column, version: Column, values: dict[str, Column]) -> int:
        """Append observations; those without key, version or any value are none. The delivery's number.

        What is read of the log is the marker of the delivery before, and the rows just written.
        """
        chosen = rows.select(key.alias(self.key), version.alias(self.version), *[values[v].alias(v) for v in self.values])
        chosen = chosen.dropna(subset=[self.key, self.version, *self.values])
        last = self.deliveries()
        ends = self.ends(last)
        part = F.spark_partition_id().alias("log_partition")
        chosen = chosen.select("*", part, F.monotonically_increasing_id().bitwiseAND(F.lit(_MASK)).alias("log_offset"))
        if ends:
            # a row per log partition, of which there are as many as tasks that append at once
            base = self.spark.createDataFrame(list(ends.items()), "log_partition int, __base long")
            chosen = chosen.join(F.broadcast(base) if len(ends) <= SMALL else base, "log_partition", "left")
            chosen = chosen.withColumn("log_offset", F.col("log_offset") + F.coalesce("__base", F.lit(0))).drop("__base")
        columns = [self.key, self.version, *self.values, "log_partition", "log_offset"]
        name = f"log/{last + 1}-{uuid.uuid4().hex}"
        chosen.select(*columns).write.parquet(f"{self.root}/{name}")
        written = self.spark.read.parquet(f"{self.root}/{name}")
        ends |= {r[0]: r[1] + 1 for r in written.groupBy("log_partition").agg(F.max("log_offset")).collect()}
        if not self.folder.write(f"ends/{last + 1}", json.dumps({"folder": name, "ends": ends}, sort_keys=True)):
            raise Conflict(f"delivery {last + 1} was appended by another runner")
        return last + 1

    # -- runs

    def committed(self) -> int:
        """Number of the last committed run; 0 if none."""
        return max(self.folder.numbers("commits"), default=0)

    def _plan(self, run: int) -> dict:
        text = self.folder.body(f"plans/{run}") if run else None
        return json.loads(text) if text else {"deliveries": [0, 0], "offsets": {}}

    def plan(self) -> int:
        """Write the next run's plan ahead, unless a failed run left it; the run's number."""
        last = self.committed()
        if self.folder.read(f"plans/{last + 1}") is None:
            done, now = self._plan(last), self.deliveries()
            spans = {p: [done["offsets"].get(str(p), [0, 0])[1], end] for p, end in self.ends(now).items()}
            plan = {"deliveries": [done["deliveries"][1], now], "offsets": spans}
            if not self.folder.write(f"plans/{last + 1}", json.dumps(plan, sort_keys=True)):
                raise Conflict(f"run {last + 1} was planned by another runner")
        return last + 1

    def planned_rows(self, run: int) -> DataFrame:
        """The log rows of a run's plan; only its deliveries' folders are read."""
        plan = self._plan(run)
        first, last = plan["deliveries"]
        folders = [self._delivery(d)["folder"] for d in range(first + 1, last + 1)]
        if not folders:
            return self._nothing()
        spans = [(int(p), a, b) for p, (a, b) in plan["offsets"].items()]
        table = self.spark.createDataFrame(spans, "log_partition int, __from long, __to long")
        inside = (F.col("log_offset") >= F.col("__from")) & (F.col("log_offset") < F.col("__to"))
        log = self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])
        # a row per log partition, of which there are as many as tasks that append at once
        table = F.broadcast(table) if len(spans) <= SMALL else table
        return log.join(table, "log_partition").filter(inside).drop("__from", "__to")

    def _nothing(self) -> DataFrame:
        values = ", ".join(f"{v} string" for v in self.values)
        return self.spark.createDataFrame([], f"{self.key} string, {self.version} timestamp, {values}, log_partition int, log_offset long")

    def newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of every key; partial aggregates go through the shuffle."""
        order = F.struct(self.version, *self.values, "log_offset", "log_partition")
        best = rows.groupBy(self.key).agg(F.max(order).alias("__row"))
        return best.select(self.key, "__row.*")

    def apply(self, run: int) -> None:
        self.newest(self.planned_rows(run)).write.mode("overwrite").parquet(f"{self.root}/sink/{run}")

    def commit(self, run: int) -> None:
        if not self.folder.write(f"commits/{run}", ""):
            raise Conflict(f"run {run} was committed by another runner")

    def run(self) -> int:
        """Plan or replay, apply and commit one run; from time to time, compact the sink."""
        run = self.plan()
        self.apply(run)
        self.commit(run)
        if run % self.compact_every == 0:
            self.compact()
        return run

    # -- the sink

    def compact(self) -> None:
        """Merge the committed batches into a base. A base without its marker is not seen."""
        last = self.committed()
        if last and last not in self.folder.numbers("bases"):
            self.state(last).write.mode("overwrite").parquet(f"{self.root}/base/{last}")
            self.folder.write(f"bases/{last}", "")

    def state(self, upto: int | None = None) -> DataFrame:
        """The newest row of every key over the committed runs: the last base and the batches since."""
        upto = self.committed() if upto is None else upto
        base = max([b for b in self.folder.numbers("bases") if b <= upto], default=0)
        paths = [f"{self.root}/sink/{r}" for r in range(base + 1, upto + 1)]
        if base:
            paths.append(f"{self.root}/base/{base}")
        return self.newest(self.spark.read.parquet(*paths)) if paths else self._nothing()


def within_spans(rows: DataFrame, at: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose time lies in [start, end] of any span, by an equi-join on days.

    Spans that are open at either end, or null times, match nothing.
    """
    days = spans.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(
        F.col(start).alias("__start"), F.col(end).alias("__end"),
        F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("__day"),
    ).distinct()
    inside = (F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end"))
    rows = rows.withColumn("__on", F.to_date(at))
    return rows.join(days, (F.col("__on") == F.col("__day")) & inside, "left_semi").drop("__on")


def unprocessed(state: DataFrame, done: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose newest value is not among the values processed for them."""
    done = done.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    same = (F.col(key) == F.col("__key")) & (F.col(value) == F.col("__value"))
    return state.join(done, same, "left_anti")
