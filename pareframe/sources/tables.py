"""Reading the given tables and keeping intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process, as in a local
    test, a temporary folder is used; on a cluster the setting is needed.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rows to a partition where a table's size is known before it is computed.
PART_ROWS = 100_000
#: Shuffle files of a query go when it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once and held in the shared checkpoint folder; its lineage ends there, and its shuffles go.

    ``rows``, where a bound is known, says in how few partitions a small table is read again; it is made in as many as its
    plan has.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        # planned anew, under this setting
        kept = df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    return kept if rows is None else kept.coalesce(rows // PART_ROWS + 1)


def fresh(df: DataFrame) -> DataFrame:
    """``keep`` for loops: the optimizer's guess of the size isn't carried on.

    A kept table has the guess of the plan that made it, and that of a join is the product of its sides'. In a loop over
    joins of a table with itself these numbers get twice as long each round, until planning takes all the time. Here they
    begin anew, as "unknown"; joins are then decided by what adaptive execution measures.
    """
    spark, kept = df.sparkSession, keep(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def write_text(spark: SparkSession, place: str, text: str) -> None:
    """Writes a small file, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def discard(spark: SparkSession, place: str) -> None:
    """Deletes a folder that Spark has written, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
