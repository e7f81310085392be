"""A keyed table as a merge-on-read change log.

Changes are appended as they are: version ``v`` writes its own rows, dealt to hash buckets of the key, and nothing else. A read takes
the newest row of every key over the last base and the versions after it; a read of given keys opens only the buckets that
can hold them. Compaction writes the merged rows as a new base. A version counts once its row in ``commits`` is written, so a
writer that fails leaves nothing visible, and a version that is written again replaces itself. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import tables

BUCKET = "_bucket"
COMMIT = "version bigint, base boolean"


class ChangeLog:
    """``schema`` must hold ``keys`` and ``order``, the columns whose greatest value is the newest row of a key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), list(keys), list(order), buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _folder(self, version: int, base: bool) -> str:
        return f"{self.path}/{'base' if base else 'log'}-{version}"

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int, base: bool) -> None:
        # a bucket is written by one task, into one file, sorted by key
        dealt = self._bucket(rows.select(*self.columns)).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(self._folder(version, base))
        self._commit(version, base, [(version, base)])

    def _commit(self, version: int, base: bool, row: list[tuple[int, bool]]) -> None:
        at = f"{self.path}/commits/at={version}-{'base' if base else 'log'}"
        self.spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("overwrite").parquet(at)

    def _read(self, folders: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for part in parts[1:]:
            out = out.union(part)
        return out

    def commits(self) -> list[tuple[int, bool]]:
        """(version, base) of everything that is visible, oldest first; compaction keeps the list short."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []  # nothing has been committed
        base = max((r.version for r in rows if r.base), default=-1)
        return sorted((r.version, r.base) for r in rows if (r.base and r.version == base) or (not r.base and r.version > base))

    def append(self, rows: DataFrame, version: int) -> None:
        """Adds the rows as one version; a repeated version replaces what it wrote before."""
        self._write(rows, version, base=False)

    def changes(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """All visible rows, of versions below ``before``, of the given buckets; the bucket is the last column."""
        rows = self._read([self._folder(v, base) for v, base in self.commits() if before is None or v < before])
        return rows if buckets is None else rows.filter(F.col(BUCKET).isin(list(buckets)))

    def table(self) -> DataFrame:
        """The newest row of every key."""
        return tables.newest_by_key(self.changes().drop(BUCKET), self.keys, self.order)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that hold given keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self._bucket(keys.select(*self.keys)).select(BUCKET).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The newest rows of the given keys, read from their buckets alone."""
        wanted = keys.select(*self.keys).distinct()
        found = self.changes(buckets=self.touched(wanted)).drop(BUCKET).join(wanted, self.keys, "left_semi")
        return tables.newest_by_key(found, self.keys, self.order)

    def absent(self, rows: DataFrame, before: int) -> DataFrame:
        """Rows whose keys no version below ``before`` holds."""
        return rows.join(self.changes(before=before, buckets=self.touched(rows)).select(*self.keys), self.keys, "left_anti")

    def compact(self) -> None:
        """Writes the newest row of every key as the base that later reads start from; the versions in it are emptied."""
        seen = self.commits()
        if not seen:
            return
        self._write(self.table(), seen[-1][0], base=True)
        nothing = self.spark.createDataFrame([], self.schema)
        for version, base in seen:
            if not (base and version == seen[-1][0]):
                nothing.write.mode("overwrite").parquet(self._folder(version, base))
                self._commit(version, base, [])
