"""Stored databases: levels of sorted Parquet runs with Bloom filters on the key, named in a manifest that is written last.

A database is a folder below one that all executors reach. Puts and deletes gather in a memtable; `memtable` puts flush it, as
a run, and runs merge up levels as a binary counter carries: after n flushes a level holds one run if its bit of n is 1. The
cascade isn't replayed: the level of every run follows from its number and n, so a batch of any size writes each level that
changes once. The least level is the newest. Tombstones go where nothing older lies below.

Each change writes new runs and then a manifest version (a Parquet table of its own); readers take the greatest whole version,
so a write that failed half-way is never seen. Runs that are replaced stay until `vacuum`: a reader may still hold them. One
writer at a time. What the memtable holds is lost unless it is flushed or closed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import MEMTABLE, SIZE_RATIO, valid
from ..operators import merge, placement, state

LOG = "seq long, op string, key long, value long"
LOG_COLUMNS = ("seq", "op", "key", "value")
RUN = "key long, value long, is_tombstone boolean, seq long"
MANIFEST = "level int, first_run long, last_run long, path string, entries long, min_key long, max_key long, last_seq long"


@dataclass
class Config:
    root: str
    memtable: int = MEMTABLE
    bloom: bool = True


class Store:
    """put, delete, put_batch, flush, close, get, multi_get, scan, compact_level, compact, vacuum over a database folder."""

    def __init__(self, spark: SparkSession, config: Config):
        if config.memtable < 1:
            raise ValueError("a memtable holds at least one put")
        self.spark, self.config = spark, config
        self._fs = self._path(config.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.memtable: DataFrame | None = None
        self._puts, self._single, self._kept = 0, [], ""
        self._next = 1 + max([r.last_seq for r in self.levels() if r.last_seq is not None], default=-1)

    def _path(self, x: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(x)

    def versions(self) -> list[int]:
        p = self._path(f"{self.config.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.config.root}/manifest/{n}/_SUCCESS")))

    def manifest(self) -> DataFrame:
        """One row a level that holds a run; sst_num is the number in a run's name in the steady state."""
        found = self.versions()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.config.root}/manifest/v={found[-1]}") if found else self.spark.createDataFrame([], MANIFEST)
        return rows.withColumn("sst_num", (F.col("level") * SIZE_RATIO).cast("long"))

    def levels(self) -> list:
        """The manifest's rows, newest level first: as many as n has bits."""
        return sorted(self.manifest().collect(), key=lambda r: r.level)

    def _publish(self, rows: list[tuple]) -> None:
        version = (self.versions() or [-1])[-1] + 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.config.root}/manifest/v={version}")

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> tuple:
        path = f"{self.config.root}/run-{uuid.uuid4().hex}"
        out = rows.select("key", "value", "is_tombstone", "seq").repartitionByRange("key").sortWithinPartitions("key").write
        (out.option("parquet.bloom.filter.enabled#key", "true") if self.config.bloom else out).parquet(path)
        n = self.spark.read.schema(RUN).parquet(path).agg(F.count("*"), F.min("key"), F.max("key"), F.max("seq")).first()
        return level, first, last, path, *n

    def put(self, key: int, value: int) -> None:
        self._one("P", key, value)

    def delete(self, key: int) -> None:
        self._one("D", key, None)

    def _one(self, op: str, key: int, value: int | None) -> None:
        """Single ops gather on the driver, at most as many as the memtable's puts and deletes since the last flush."""
        self._single.append((self._next, op, key, value))
        self._next += 1
        self._puts += op == "P"
        if self._puts >= self.config.memtable:
            self._flush(self._puts // self.config.memtable)

    def put_batch(self, oplog: DataFrame) -> None:
        """Ops (seq, op, key, value) newer than all before; gets read them at once. Full memtables are flushed."""
        oplog = valid(oplog.select("seq", "op", "key", "value").where("op <> 'C' or op is null"))
        self._gather()
        self.memtable = oplog if self.memtable is None else self.memtable.unionByName(oplog)
        n = oplog.agg(F.count_if(F.col("op") == "P").alias("puts"), F.max("seq").alias("last")).first()
        self._puts += n.puts
        self._next = max(self._next, (-1 if n.last is None else n.last) + 1)
        if self._puts >= self.config.memtable:
            self._flush(self._puts // self.config.memtable)

    def _gather(self) -> None:
        if self._single:
            more = valid(self.spark.createDataFrame(self._single, LOG))
            self.memtable, self._single = more if self.memtable is None else self.memtable.unionByName(more), []

    def _flush(self, more: int) -> None:
        """Stores `more` runs of the memtable, the last of which may be short, and carries levels up."""
        self._gather()
        kept = self.levels()
        base = 1 + max([r.last_run for r in kept], default=-1)
        n = base + more
        place = lambda run: (run ^ n).bit_length() - 1
        # placed once, by level; what is left, less than a memtable, stays there: else each flush would lengthen its lineage
        path = f"{self.config.root}/placed-{uuid.uuid4().hex}"
        ops = placement.place(self.memtable, self.config.memtable).withColumn("run", F.col("run") + base)
        ops.withColumn("level", placement.level_of(F.col("run"), F.lit(n).cast("long"))).drop("n").write.partitionBy("level").parquet(path)
        ops = self.spark.read.schema(f"{LOG}, run long, level int").parquet(path)
        old = {}
        for r in kept:
            old.setdefault(place(r.first_run), []).append(r)
        fresh: dict[int, list[int]] = {}
        for level in {place(run) for run in self._ends(base, n)}:
            runs = [run for run in self._ends(base, n) if place(run) == level]
            fresh[level] = [min(runs), max(runs)]
        top = max([*old, *fresh])
        rows = []
        for level in sorted({*old, *fresh}):
            parts = old.get(level, [])
            if level not in fresh and len(parts) == 1:
                rows.append((level, *parts[0][1:8]))
                continue
            both = None
            for r in parts:
                one = self.spark.read.schema(RUN).parquet(r.path).withColumn("run", F.lit(r.last_run))
                both = one if both is None else both.unionByName(one)
            if level in fresh:
                new = ops.where(F.col("level") == level).select("key", F.when(F.col("op") == "P", F.col("value")).alias("value"), (F.col("op") == "D").alias("is_tombstone"), "seq", "run")
                both = new if both is None else both.unionByName(new)
            ends = [*[x for r in parts for x in (r.first_run, r.last_run)], *fresh.get(level, [])]
            rows.append(self._write(merge.newest_run(both, level == top and level >= 1), level, min(ends), max(ends)))
        self._publish(rows)
        self.memtable, self._puts = ops.where("level = -1").select(*LOG_COLUMNS), max(0, self._puts - more * self.config.memtable)
        self._kept = path

    @staticmethod
    def _ends(lo: int, hi: int) -> list[int]:
        """Of the runs lo..hi-1 the first and last of each level that they go to: blocks of a binary counter's bits."""
        out, at = [], lo
        while at < hi:
            size = 1 << max(0, (at ^ hi).bit_length() - 1)
            end = min(hi, (at // size + 1) * size)
            out += [at, end - 1]
            at = end
        return out

    def flush(self) -> None:
        """Stores all that the memtable holds, its last run being as short as it comes; nothing to write, nothing done."""
        self._gather()
        if self.memtable is None:
            return
        last = placement.place(self.memtable, self.config.memtable).agg(F.max("run")).first()[0]
        if last is None:
            self.memtable, self._puts = None, 0
        else:
            self._flush(last + 1)
            self.memtable, self._puts = None, 0

    close = flush

    def runs(self) -> DataFrame:
        """(level, key, value, is_tombstone, seq) of the stored levels."""
        out = self.spark.createDataFrame([], "level int, " + RUN)
        for r in self.levels():
            out = out.unionByName(self.spark.read.schema(RUN).parquet(r.path).select(F.lit(r.level).alias("level"), "key", "value", "is_tombstone", "seq"))
        return out

    def rows(self) -> DataFrame:
        """Versions of the levels and of the memtable (level -1) as an op-log with levels."""
        self._gather()
        stored = self.runs().select("seq", F.when(F.col("is_tombstone"), "D").otherwise("P").alias("op"), "key", "value", "level")
        return stored if self.memtable is None else stored.unionByName(self.memtable.withColumn("level", F.lit(-1)))

    def get(self, key: int) -> int | None:
        """The memtable first, then level by level, newest first; the first that has the key decides. Levels whose range of keys
        leaves it out aren't read; within a run Parquet's statistics and Bloom filters skip what can't have it."""
        self._gather()
        if self.memtable is not None and (found := state.versions(self.memtable.where(F.col("key") == key), "key").first()):
            return found.value if found.op == "P" else None
        for r in self.levels():
            if r.entries and r.min_key <= key <= r.max_key and (found := self.spark.read.schema(RUN).parquet(r.path).where(F.col("key") == key).first()):
                return None if found.is_tombstone else found.value
        return None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Each distinct key with its value, null if absent or deleted, in one job over all levels."""
        wanted = keys.select("key").distinct()
        return wanted.join(state.newest_of_levels(self.rows().join(wanted, "key", "left_semi")), "key", "left")

    def scan(self, start: int, end: int) -> DataFrame:
        """Latest values of keys in [start, end]; the bounds reach the Parquet scans."""
        return state.newest_of_levels(self.rows().where(F.col("key").between(start, end))).orderBy("key")

    def scan_versions(self, start: int, end: int) -> DataFrame:
        """Every version, one per level and key; a tombstone's value is the not-found sentinel."""
        return state.scan_versions(self.rows(), start, end)

    def compact_level(self, level: int) -> None:
        """Merges the run of a level into the next level that holds one; without one below, the level's tombstones go."""
        kept = self.levels()
        here = [r for r in kept if r.level == level]
        if not here:
            return
        parts = [*here, *[r for r in kept if r.level > level][:1]]
        both = None
        for r in parts:
            one = self.spark.read.schema(RUN).parquet(r.path).withColumn("run", F.lit(r.last_run))
            both = one if both is None else both.unionByName(one)
        last = parts[-1].level == kept[-1].level
        row = self._write(merge.newest_run(both, last), parts[-1].level, min(r.first_run for r in parts), max(r.last_run for r in parts))
        self._publish([tuple(r)[:8] for r in kept if r not in parts] + [row])

    def compact(self) -> None:
        """All levels into one, without tombstones, since nothing older remains; one aggregation, not a cascade."""
        self.flush()
        kept = self.levels()
        if kept:
            rows = state.newest_of_levels(self.rows(), "seq").withColumn("is_tombstone", F.lit(False))
            self._publish([self._write(rows, kept[-1].level, min(r.first_run for r in kept), max(r.last_run for r in kept))])

    def vacuum(self) -> None:
        """Removes runs and manifest versions that the latest manifest doesn't need."""
        kept = {self._path(r.path).getName() for r in self.levels()} | {"manifest", self._kept.rsplit("/", 1)[-1]}
        root = self._path(self.config.root)
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)
        for v in self.versions()[:-1]:
            self._fs.delete(self._path(f"{self.config.root}/manifest/v={v}"), True)


def drop_databases(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Removes the databases (folders) in folder whose names begin with prefix, and returns their names."""
    if not prefix:
        raise ValueError("a prefix is needed")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix)] if fs.exists(at) else []
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def write_results(results: DataFrame, path: str) -> None:
    """Benchmark results (op_type, data_size(MB), throughput(op/s)) as one CSV file with a header, as small as a results table is."""
    results.select("op_type", "`data_size(MB)`", "`throughput(op/s)`").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
