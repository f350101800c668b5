"""Reference counts as DataFrames (key, n), and counts that are kept up from version to version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pareframe.sources.tables import keep


def count(uses: DataFrame, *key: str) -> DataFrame:
    return uses.groupBy(*key).agg(F.count("*").alias("n"))


def decrease(counts: DataFrame, deleted: DataFrame, *key: str) -> DataFrame:
    """``counts`` less those of ``deleted`` uses; a key may reach 0, and stays."""
    less = count(deleted, *key).withColumnRenamed("n", "__less")
    return counts.join(less, list(key), "left").select(*key, (F.col("n") - F.coalesce("__less", F.lit(0))).alias("n"))


def unused(counts: DataFrame) -> DataFrame:
    return counts.where("n = 0")


def purge(counts: DataFrame) -> DataFrame:
    return counts.where("n <> 0")


#: Folders that counts are dealt over, by file.
BUCKETS = 64
_ROW = "file string, key string, n long, bucket int"


class Counts:
    """Counts of (file, key), kept up from version to version in a folder that Spark reads and writes.

    Rows lie in a folder for each bucket of files. A change reads and rewrites the buckets of the files that it
    touches, and no others; a file's counts go with the file. A bucket is replaced when all of its rows are written, by one
    task, so there should be as many buckets as keep one at some 100 MB.
    """

    def __init__(self, spark: SparkSession, place: str, buckets: int = BUCKETS):
        self.spark, self.place, self.buckets = spark, place, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(self.place)

    def read(self) -> DataFrame:
        """(file, key, n); what isn't used any more has no row."""
        return self._rows().where("n > 0").select("file", "key", "n")

    def create(self, uses: DataFrame) -> None:
        """Counts the rows of ``uses`` (file, key)."""
        rows = uses.groupBy("file", "key").agg(F.count("*").alias("n")).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(self.place)

    def change(self, deltas: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Adds ``deltas`` (file, key, change), then drops the files of ``gone`` (file); the buckets that were rewritten.

        A count never falls below none.
        """
        sums = keep(deltas.groupBy("file", "key").agg(F.sum("change").alias("n")).withColumn("bucket", self._bucket()))
        files = None if gone is None else keep(gone.select("file").distinct().withColumn("bucket", self._bucket()))
        touched = sums.select("bucket") if files is None else sums.select("bucket").union(files.select("bucket"))
        # at most one number for each folder
        buckets = sorted(r["bucket"] for r in touched.distinct().collect())
        if not buckets:
            return buckets
        rows = self._rows().where(F.col("bucket").isin(buckets)).unionByName(sums)
        rows = rows.groupBy("bucket", "file", "key").agg(F.sum("n").alias("n")).where("n > 0")
        if files is not None:
            rows = rows.join(files, ["bucket", "file"], "left_anti")
        # a row without a file has an emptied bucket replaced, too
        marks = self.spark.createDataFrame([(b, None, None, 0) for b in buckets], "bucket int, file string, key string, n long")
        new = keep(rows.select("bucket", "file", "key", "n").union(marks))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.place)
        return buckets
