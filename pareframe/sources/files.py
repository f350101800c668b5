"""Files as tables: trees of files, log lines, manifests, line counts; and the writers of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "name string, path string, build_system string, modules string, reproduces boolean, extra struct<tags:array<string>,issue:string>"
COUNTS = "SUM struct<blank:int,comment:int,code:int,nFiles:int>"


def tree(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(path, length) of all files below ``root`` with the extension. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    return found.select("path", "length").distinct()


def lines(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """(path, number, line) of all files below ``root`` with the extension; numbers begin with 1."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(root, wholetext=True)
    cut = texts.select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n", -1)).alias("number", "line"))
    return cut.select("path", (F.col("number") + 1).alias("number"), "line")


def split_lines(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """As ``lines``, of files that are read in splits: (path, block, number, line).

    ``block`` is where the split begins. Lines of a split are counted where it is read, splits of a file are added up in
    order, so a file is never in one task. A line end at the end of a file begins no further line.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").option("lineSep", "\n").text(root)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    # a split is read by one task, line by line
    blocks = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(blocks, ["path", "block"]).select("path", "block", (F.col("at") - F.col("first") + F.col("before") + 1).alias("number"), "line")


def records(lines: DataFrame, begins: Column) -> DataFrame:
    """(path, number, record): the lines from one for which ``begins`` holds to the next such, wherever splits end.

    ``lines`` are those of ``split_lines``. Lines before the first such line are one record. Within a split the last
    beginning is looked for line by line; from split to split only the last of each goes on.
    """
    inside = Window.partitionBy("path", "block").orderBy("number")
    mine = lines.withColumn("begun", F.max(F.when(begins, F.col("number"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = mine.groupBy("path", "block").agg(F.max("begun").alias("last"))
    earlier = F.max("last").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("path", "block", earlier.alias("carried"))
    whole = mine.join(carried, ["path", "block"]).withColumn("begun", F.coalesce("begun", "carried", F.lit(1)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n")
    return whole.groupBy("path", F.col("begun").alias("number")).agg(text.alias("record"))


def log_entries(rows: DataFrame, line: str = "line") -> DataFrame:
    """``rows`` that are ``HH:mm:ss.SSS - message``, with seconds of the day and message."""
    part = lambda i: F.regexp_extract(line, r"^(\d{2}):(\d{2}):(\d{2}\.\d{3}) - (.*)$", i)
    found = rows.where(part(1) != "")
    return found.withColumns({"seconds": part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("decimal(6,3)"), "message": part(4)})


def number_after(message: Column, label: str) -> Column:
    """The whole number after ``label`` in a message; 0 if there is none or it isn't one."""
    return F.coalesce(F.trim(F.substring_index(message, label, -1)).try_cast("int"), F.lit(0))


def slice_log(entries: DataFrame, start: str, end: str) -> DataFrame:
    """Entries of each path between its first message with ``start`` and its first with ``end``, these included."""
    first = lambda text: F.min(F.when(F.contains("message", F.lit(text)), F.col("number")))
    bounds = entries.groupBy("path").agg(first(start).alias("__from"), first(end).alias("__to"))
    return entries.join(bounds, "path").where("number BETWEEN __from AND __to").drop("__from", "__to")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a YAML manifest, a small file that is read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        projects = yaml.safe_load(f)["projects"]
    names = [c.split()[0] for c in MANIFEST.replace("struct<tags:array<string>,issue:string>", "x").split(", ")]
    rows = [tuple(p.get(n) for n in names[:-1]) + ((lambda e: e and (e.get("tags"), e.get("issue")))(p.get("extra")),) for p in projects]
    return spark.createDataFrame(rows, MANIFEST)


def suitable(projects: DataFrame) -> DataFrame:
    """Projects that aren't tagged android, are built by gradle and have a single module; no tags at all pass."""
    tagged = F.coalesce(F.array_contains("extra.tags", "android"), F.lit(False))
    return projects.where(~tagged & (F.col("build_system") == "gradle") & (F.col("modules") == "single"))


def line_counts(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with blank, comment, code, files and total from the JSON of a line counter; 0 where it can't be read."""
    found = F.from_json(column, COUNTS)["SUM"]
    value = lambda name: F.coalesce(found[name], F.lit(0))
    return rows.withColumns({"blank": value("blank"), "comment": value("comment"), "code": value("code"), "files": value("nFiles"), "total": value("blank") + value("comment") + value("code")})


def write_report(report: DataFrame, path: str) -> None:
    """A CSV report with a header; Spark quotes what needs it."""
    report.write.mode("overwrite").option("header", True).csv(path)


def write_trace(spark: SparkSession, log: list[dict], path: str) -> None:
    """The log of a property (one entry for each set that was decided) as JSON lines."""
    rows = [(i, x["kind"], x["retained"], x["outcome"]) for i, x in enumerate(log)]
    spark.createDataFrame(rows, "test int, kind string, retained long, outcome boolean").write.mode("overwrite").json(path)
