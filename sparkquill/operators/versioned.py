"""A keyed table kept as runs of changes: a batch writes what it changes, reads merge the runs, levels of runs are compacted.

A run is a folder run-LEVEL-FIRST-LAST of the changes of batches FIRST to LAST: for each key its latest row, by the
version that the source gives and then by batch, with deleted rows as tombstones, in buckets of keys. A run counts once
its _SUCCESS file is there, and no more once a run that spans it counts; so compaction needs no lock, a batch that is
run again writes the same run again, and what a lost writer has left is not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of a level that are made one of the next, and folders that a run's keys are dealt into.
FAN, BUCKETS = 4, 16
#: What each row has beside the table's columns.
ORDER = "version long, deleted boolean, batch long"


@dataclass(frozen=True, order=True)
class Run:
    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"

    def spans(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last and self.level > other.level


class VersionedTable:
    """Rows of a schema known by key under root; changes also have version (long) and deleted (boolean; null: not)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, fan: int = FAN, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.schema, self.key, self.fan, self.buckets = spark, root.rstrip("/"), schema, key, fan, buckets
        self.stored = StructType([*schema.fields, *StructType.fromDDL(ORDER).fields])

    # -- runs ---------------------------------------------------------------------------------------------------------

    def folder(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def written(self) -> list[Run]:
        """All runs that are whole."""
        fs, root = self.folder()
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        done = (n.split("-") for n in names if n.startswith("run-") and fs.exists(self.folder(f"{n}/_SUCCESS")[1]))
        return sorted(Run(int(first), int(last), int(level)) for _, level, first, last in done)

    def runs(self) -> list[Run]:
        """Runs that count, in the order of their batches."""
        found = self.written()
        return [r for r in found if not any(o.spans(r) for o in found)]

    def rows_of(self, runs: list[Run]) -> DataFrame:
        schema = StructType([*self.stored.fields, *StructType.fromDDL("bucket int").fields])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{r.name}") for r in runs]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def latest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of the highest version, and of the latest batch among those; of two such rows of a batch that differ one, always the same."""
        row = F.struct(*self.stored.names)
        return rows.groupBy("bucket", self.key).agg(F.max_by(row, F.struct("version", "batch", F.xxhash64(*self.schema.names, "deleted"))).alias("row")).select("row.*", "bucket")

    def write(self, rows: DataFrame, run: Run) -> None:
        rows.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(64))).sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{run.name}")

    # -- changes ------------------------------------------------------------------------------------------------------

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Writes the changes of a batch, numbered from 0 without gaps; a batch that a compacted run has already is left as it is. Keys that are null are left out."""
        if any(r.first <= batch <= r.last and r.level for r in self.runs()):
            return
        rows = changes.where(F.col(self.key).isNotNull()).select(*self.schema.names, F.coalesce("version", F.lit(-1 << 63)).alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.lit(batch).cast("long").alias("batch"), F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"))
        self.write(self.latest(rows), Run(batch, batch, 0))
        self.compact()

    def compact(self) -> None:
        """Makes one run of each fan neighbours of a level. Tombstones go where no older run is left that they could hide."""
        level = 0
        while of_level := [r for r in self.runs() if r.level == level]:
            for at in range(0, len(of_level) - self.fan + 1, self.fan):
                some = of_level[at : at + self.fan]
                rows = self.latest(self.rows_of(some))
                if some[0] == self.runs()[0]:
                    rows = rows.where("not deleted")
                self.write(rows, Run(some[0].first, some[-1].last, level + 1))
            level += 1
        self.clean()

    def clean(self) -> None:
        """Deletes runs that a whole run spans. A reader that has listed them before may have to start again."""
        found = self.written()
        for r in found:
            if any(o.spans(r) for o in found):
                fs, path = self.folder(r.name)
                fs.delete(path, True)

    def read(self) -> DataFrame:
        """The rows there are now."""
        return self.latest(self.rows_of(self.runs())).where("not deleted").select(*self.schema.names)
