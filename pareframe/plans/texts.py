"""Queries that edit texts, and one of counts that follow edits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareframe.operators import arguments, comments, edits, refcount
from pareframe.sources.tables import keep, shared_folder, table


def edited_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents without every third line, and with ``<>`` for the second to fourth character of all longer lines.

    In the lines that go, the second edit is inside the first. ``last`` is where the last character of the old text went.
    """
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.char_length(x).cast("long"))
    begun = F.aggregate(lines, F.array().cast("array<long>"), lambda out, n: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + n + 1)))
    rows = texts.select("id", F.posexplode(F.arrays_zip(lines.alias("n"), begun.alias("end"))).alias("i", "line"))
    rows = rows.select("id", "i", (F.col("line.end") - F.col("line.n") - 1).alias("start"), F.col("line.n").alias("n"), F.col("line.end").alias("end"))
    no = F.lit(False).alias("comma")
    gone = rows.where("i % 3 = 1").select("id", "start", "end", F.lit(None).cast("string").alias("replacement"), no)
    cut = rows.where("n >= 5").select("id", (F.col("start") + 1).alias("start"), (F.col("start") + 4).alias("end"), F.lit("<>").alias("replacement"), no)
    found = edits.applied(texts, gone.union(cut))
    last = edits.moved(F.col("pieces"), F.char_length("text").cast("long") - 1)
    return found.select(F.col("id").alias("doc_id"), F.md5("edited").alias("digest"), F.char_length("edited").alias("n_left"), last.cast("long").alias("last"))


def calls_without_parameter(spark: SparkSession, d: str) -> DataFrame:
    """Orders as calls: lines are parameters, positional in even orders, named and turned round in odd ones. Parameter p2 goes."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey").alias("line"))
    name = lambda i: F.concat(F.lit("p"), (i + 1).cast("string"))

    def value(x, i):
        part = x["l_partkey"].cast("string")
        return F.struct(name(i).alias("name"), F.when(i % 2 == 1, F.concat(F.lit("g("), part, F.lit(', "a,(b")'))).otherwise(part).alias("value"))

    calls = line.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("line")), value).alias("lines"))
    plain = F.array_join("lines.value", ", ")
    named = F.array_join(F.transform(F.reverse("lines"), lambda x: F.concat(x["name"], F.lit(" = "), x["value"])), ", ")
    body = F.when(F.col("id") % 2 == 0, plain).otherwise(named)
    calls = keep(arguments.matched(calls.select("id", F.concat(F.lit("f("), body, F.lit(")")).alias("call"), F.col("lines.name").alias("parameters"))))
    found = arguments.without_parameter(calls, calls.select("id", F.lit("p2").alias("parameter")))
    return found.select(F.col("id").alias("l_orderkey"), F.col("edited").alias("call"), F.array_join("arguments.parameter", ",").alias("parameters"))


def code_without_comments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as source texts, a statement for each line with nested, quoted and trailing comments; all comments go."""
    part = F.col("l_partkey").cast("string")
    kinds = [
        F.concat(F.lit("x = "), part, F.lit("; /* a /* b */ c */")), F.concat(F.lit('s = "/* '), part, F.lit(' \\" //";')),
        F.concat(F.lit("y = "), part, F.lit(" // it's \"odd /*")), F.concat(F.lit("/** doc "), part, F.lit(" */ z = '\"';")),
    ]
    by = F.pmod("l_linenumber", F.lit(4))
    text = F.when(by == 0, kinds[0]).when(by == 1, kinds[1]).when(by == 2, kinds[2]).otherwise(kinds[3])
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", text.alias("text")).alias("line"))
    source = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["text"]), "\n")
    found = comments.without(lines.groupBy("id").agg(source.alias("text")))
    return found.select(F.col("id").alias("l_orderkey"), F.md5("edited").alias("digest"), F.col("n_edits").alias("n_comments"))


def counts_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """Uses of parts by order, over three versions: all lines; without the returned ones; without the orders of status F.

    Only what changed is given to the second and third version.
    """
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_partkey").cast("string").alias("key"), "l_returnflag")
    counts = refcount.Counts(spark, f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}", 8)
    counts.create(line.select("file", "key"))
    counts.change(line.where("l_returnflag = 'R'").select("file", "key", F.lit(-1).alias("change")))
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("file"))
    counts.change(line.limit(0).select("file", "key", F.lit(0).alias("change")), gone)
    return counts.read()


QUERIES = {
    "edited_lines": (
        edited_lines,
        r"""WITH l AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL),
        e AS (SELECT *, CASE WHEN length(line) >= 5 THEN line[1] || '<>' || line[5:] ELSE line END || CASE WHEN i < k - 1 THEN chr(10) ELSE '' END AS new FROM l),
        t AS (SELECT doc_id, max(n) AS n, coalesce(string_agg(new, '' ORDER BY i) FILTER (WHERE i % 3 <> 1), '') AS edited,
            bool_or(i = k - 1 AND (i % 3 = 1 OR length(line) = 0)) AS off, max(CASE WHEN i = k - 1 THEN length(line) END) AS tail, max(CASE WHEN i = k - 1 THEN i END) AS i FROM e GROUP BY doc_id)
        SELECT doc_id, md5(edited) AS digest, length(edited) AS n_left,
            CAST(CASE WHEN n = 0 THEN 0 WHEN i % 3 = 1 OR (tail = 0 AND i % 3 = 2) THEN length(edited) ELSE length(edited) - 1 END AS BIGINT) AS last FROM t""",
    ),
    "calls_without_parameter": (
        calls_without_parameter,
        """WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
        l AS (SELECT l_orderkey, k, CASE WHEN k % 2 = 0 THEN 'g(' || l_partkey || ', "a,(b")' ELSE CAST(l_partkey AS VARCHAR) END AS v FROM n),
        p AS (SELECT l_orderkey, string_agg(v, ', ' ORDER BY k) FILTER (WHERE k <> 2) AS plain, string_agg('p' || k || ' = ' || v, ', ' ORDER BY k DESC) FILTER (WHERE k <> 2) AS named,
            string_agg('p' || k, ',' ORDER BY k) FILTER (WHERE k <> 2) AS up, string_agg('p' || k, ',' ORDER BY k DESC) FILTER (WHERE k <> 2) AS down FROM l GROUP BY l_orderkey)
        SELECT l_orderkey, 'f(' || coalesce(CASE WHEN l_orderkey % 2 = 0 THEN plain ELSE named END, '') || ')' AS call, coalesce(CASE WHEN l_orderkey % 2 = 0 THEN up ELSE down END, '') AS parameters FROM p""",
    ),
    "code_without_comments": (
        code_without_comments,
        """WITH l AS (SELECT l_orderkey, l_linenumber AS k, l_partkey AS p, CASE l_linenumber % 4 WHEN 0 THEN 'x = ' || l_partkey || '; ' WHEN 1 THEN 's = "/* ' || l_partkey || ' \\" //";'
            WHEN 2 THEN 'y = ' || l_partkey || ' ' ELSE ' z = ''"'';' END AS line FROM lineitem)
        SELECT l_orderkey, md5(string_agg(line, chr(10) ORDER BY k, p)) AS digest, count(*) FILTER (WHERE k % 4 <> 1) AS n_comments FROM l GROUP BY l_orderkey""".replace("\\\\", "\\"),
    ),
    "counts_kept_up": (
        counts_kept_up,
        """SELECT CAST(l_orderkey AS VARCHAR) AS file, CAST(l_partkey AS VARCHAR) AS key, count(*) AS n FROM lineitem
        WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey, l_partkey""",
    ),
}
