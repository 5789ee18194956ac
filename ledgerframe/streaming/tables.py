"""Tables on disk that take each micro-batch once, several of them together.

A batch first writes what its tables' touched partitions become, and what its
logs get, to a staging folder, and marks the folder as ready. Only then are the
partitions overwritten, and emptied ones removed. A batch that comes again is
passed over if it is done; if it was ready, it is published once more from the
staging folder (the tables may be half new by then); else it starts over from
tables that it has not touched. Readers between two batches see all of a batch;
a reader during publication may see part of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """A table kept by key: its columns, and partition columns made from key columns."""

    schema: str
    keys: tuple[str, ...]
    parts: Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class Change:
    """Rows to put (whole rows) and keys to remove; removing comes first."""

    puts: DataFrame
    gone: DataFrame


def buckets(column: str, n: int = 16) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(n)).cast("int")


def after(base: DataFrame, change: Change, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """The table after a change: one anti join against all touched keys."""
    keys = list(keys)
    touched = change.gone.select(*keys).unionByName(change.puts.select(*keys)).distinct()
    return base.join(touched, keys, "left_anti").unionByName(change.puts.select(*base.columns))


def then(first: Change | None, second: Change, keys: tuple[str, ...] | list[str]) -> Change:
    """Two changes in a row as one."""
    if first is None:
        return second
    return Change(after(first.puts, second, keys), first.gone.unionByName(second.gone))


class Tables:
    """Tables and append-only logs under one folder."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root, tables

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _mark(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.create(where, True).close()

    def _drop(self, path: str) -> None:
        where, fs = self._fs(path)
        fs.delete(where, True)

    def read(self, name: str) -> DataFrame:
        """A table with its partition columns, which filters may prune by; an unwritten one is empty."""
        table = self.tables[name]
        if not self._exists(f"{self.root}/{name}"):
            empty = self.spark.createDataFrame([], table.schema)
            return empty.withColumns(table.parts())
        return self.spark.read.schema(f"{table.schema}, {', '.join(f'{p} {self._part_type(name, p)}' for p in table.parts())}").parquet(f"{self.root}/{name}")

    def _part_type(self, name: str, part: str) -> str:
        empty = self.spark.createDataFrame([], self.tables[name].schema).withColumns(self.tables[name].parts())
        return empty.schema[part].dataType.simpleString()

    def rows(self, name: str) -> DataFrame:
        """A table without its partition columns."""
        return self.read(name).drop(*self.tables[name].parts())

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def apply(self, batch: int | str, compute: Callable[[Tables], dict[str, Change | DataFrame]]) -> bool:
        """Applies what ``compute`` returns, a change for a table or rows for a log; false if the batch was done before."""
        staged, done = f"{self.root}/_staged/{batch}", f"{self.root}/_done/{batch}"
        if self._exists(done):
            return False
        if not self._exists(f"{staged}/_READY"):
            self._drop(staged)
            for name, change in compute(self).items():
                if isinstance(change, Change):
                    self._stage(name, change, staged)
                else:
                    change.write.mode("overwrite").parquet(f"{staged}/logs/{name}")
            self._mark(f"{staged}/_READY")
        self._publish(staged, batch)
        self._mark(done)
        self._drop(staged)
        return True

    def _stage(self, name: str, change: Change, staged: str) -> None:
        table = self.tables[name]
        parts = table.parts()
        keys = change.puts.select(*table.keys).unionByName(change.gone.select(*table.keys))
        slots = keys.select(*(c.alias(p) for p, c in parts.items())).distinct()
        slots.coalesce(1).write.mode("overwrite").parquet(f"{staged}/slots/{name}")
        touched = self._slots(staged, name)
        if touched:
            old = self.read(name).where(self._among(touched)).drop(*parts)
            new = after(old, change, table.keys).withColumns(parts)
            new.repartition(*parts).sortWithinPartitions(*table.keys).write.mode("overwrite").partitionBy(*parts).parquet(f"{staged}/tables/{name}")

    def _slots(self, staged: str, name: str) -> list[dict]:
        """The touched partitions: at most as many as the table has or gets."""
        return [r.asDict() for r in self.spark.read.parquet(f"{staged}/slots/{name}").collect()]

    @staticmethod
    def _among(slots: list[dict]) -> Column:
        """A test of partition columns that prunes: each column by its values, then the pairs."""
        names = list(slots[0])
        test = F.struct(*names).isin([F.struct(*(F.lit(s[n]).alias(n) for n in names)) for s in slots])
        for n in names:
            test = test & F.col(n).isin(sorted({s[n] for s in slots}))
        return test

    def _publish(self, staged: str, batch: int | str) -> None:
        for name, table in self.tables.items():
            if not self._exists(f"{staged}/slots/{name}") or not (slots := self._slots(staged, name)):
                continue
            rows = self.spark.read.schema(self.read(name).schema).parquet(f"{staged}/tables/{name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*table.parts()).parquet(f"{self.root}/{name}")
            for slot in slots:
                folder = "/".join(f"{k}={v}" for k, v in slot.items())
                if not self._exists(f"{staged}/tables/{name}/{folder}"):
                    self._drop(f"{self.root}/{name}/{folder}")
        if self._exists(f"{staged}/logs"):
            where, fs = self._fs(f"{staged}/logs")
            for status in fs.listStatus(where):
                name = status.getPath().getName()
                self.spark.read.parquet(f"{staged}/logs/{name}").write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
