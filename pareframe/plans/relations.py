"""Relational queries: joins, groupings, reference counts, arrays, sets, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pareframe.operators import elements, imports, refcount
from pareframe.operators.snapshot import Aborted, Snapshot
from pareframe.sources import files
from pareframe.sources.tables import keep, table

EXPLICIT = ("Brand#1", "Brand#2", "Brand#3")


def hash_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose part is in a lookup of small parts; misses go."""
    small = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    found = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(small, "l_partkey")
    return found.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def zip_truncate(spark: SparkSession, d: str) -> DataFrame:
    """A conversation and the next, turn by turn, as far as the shorter goes."""
    rows = table(spark, d, "conversations")
    a = rows.select("conv_id", "turn", F.col("role").alias("role_a"))
    b = rows.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("role_b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "role_a", "role_b")


def prefix_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the one after it."""
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", after.alias("next_role")).where("next_role IS NOT NULL")


def _rare_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with and without an order of status P and low priority."""
    customers, rare = table(spark, d, "customer").select("c_custkey"), _rare_orders(spark, d).select(F.col("o_custkey").alias("c_custkey"))
    with_one = customers.join(rare, "c_custkey", "left_semi").withColumn("has", F.lit(True))
    return with_one.unionByName(customers.join(rare, "c_custkey", "left_anti").withColumn("has", F.lit(False)))


def _arguments(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each order as arguments, by line."""
    pairs = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(pairs.alias("p")).select("l_orderkey", F.col("p.l_partkey").alias("args"))


def ordered_args(spark: SparkSession, d: str) -> DataFrame:
    """Arguments in order, and the index of the smallest."""
    written = F.array_join(F.transform("args", lambda x: x.cast("string")), ",")
    return _arguments(spark, d).select("l_orderkey", written.alias("args"), (F.array_position("args", F.array_min("args")) - 1).alias("at"))


def argument_removal(spark: SparkSession, d: str) -> DataFrame:
    """Arguments without all that are equal to the smallest."""
    rest = F.filter("args", lambda x: x != F.array_min("args"))
    return _arguments(spark, d).select("l_orderkey", F.array_join(F.transform(rest, lambda x: x.cast("string")), ",").alias("args"))


def refcount_unused(spark: SparkSession, d: str) -> DataFrame:
    """Parts that nothing uses any more once all orders but the rare ones are deleted."""
    uses = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rare = _rare_orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"))
    left = refcount.decrease(refcount.count(uses, "l_partkey"), uses.join(rare, "l_orderkey", "left_anti"), "l_partkey")
    return refcount.unused(left).select("l_partkey")


def star_demand(spark: SparkSession, d: str) -> DataFrame:
    """Uses by type, of parts whose brand isn't named explicitly."""
    part = table(spark, d, "part")
    implicit = part.where(~F.col("p_brand").isin(*EXPLICIT))
    uses = refcount.count(table(spark, d, "lineitem"), "l_partkey")
    found = uses.join(implicit.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return found.groupBy("p_type").agg(F.sum("n").alias("n_uses"))


def group_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source: those under 1000 characters go whole, the rest in part."""
    whole = F.col("n_chars") < 1000
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(whole).alias("n_whole"), F.count_if(~whole).alias("n_partial"))


def top1_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each customer by key."""
    last = F.max(F.struct("o_orderkey", "o_orderstatus"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_orderstatus")


def quantified(spark: SparkSession, d: str) -> DataFrame:
    """Nations that have suppliers, all of them in credit."""
    good = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.bool_and(F.col("s_acctbal") > 0).alias("all_good"))
    return table(spark, d, "nation").join(good.where("all_good"), "n_nationkey").select("n_nationkey", "n_name")


def simple_equality(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are the same but for their place (order and line number)."""
    same = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return same.where("n > 1")


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Parts returned and parts accepted: in both, and returned only."""
    line = table(spark, d, "lineitem")
    returned, accepted = (line.where(F.col("l_returnflag") == x).select("l_partkey") for x in "RA")
    both = returned.intersect(accepted).withColumn("kind", F.lit("both"))
    return both.union(returned.distinct().join(accepted, "l_partkey", "left_anti").withColumn("kind", F.lit("returned")))


def manifest_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose flags don't have "de", from a source of one digit; null flags pass."""
    flags = F.when(F.col("lang") != "es", F.array("lang"))
    fits = ~F.coalesce(F.array_contains(flags, "de"), F.lit(False)) & F.col("source").rlike("^src[0-9]$")
    return table(spark, d, "documents").where(fits).select("doc_id")


def mask_body(spark: SparkSession, d: str) -> DataFrame:
    """Long texts replaced by a placeholder; rows stay."""
    text = F.when(F.col("n_chars") > 5000, F.lit("removed")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"))


def snapshot_commit(spark: SparkSession, d: str) -> DataFrame:
    """Orders after a deletion that is committed and one that is given up."""
    state = Snapshot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))

    def give_up(rows: DataFrame) -> DataFrame:
        if not rows.where("o_orderstatus = 'O'").isEmpty():
            raise Aborted
        return rows.limit(0)

    state.transaction(lambda rows: rows.where("o_orderstatus <> 'F'"))
    state.transaction(give_up)
    return state.data.select("o_orderkey", F.lit(state.version).alias("version"))


def file_counters(spark: SparkSession, d: str) -> DataFrame:
    """Uses by file and key for touched files only: parts by order, for the rare orders; zeros purged."""
    uses = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    touched = keep(_rare_orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey")))
    mine = uses.join(touched, "l_orderkey", "left_semi")
    gone = mine.where("l_returnflag = 'N'")
    return refcount.purge(refcount.decrease(refcount.count(mine, "l_orderkey", "l_partkey"), gone, "l_orderkey", "l_partkey"))


def argument_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Arguments without the first that is the part 7 of each ten, by its index; all of them, and -1, where there is none."""
    index = F.array_position(F.transform("args", lambda x: F.pmod(x, F.lit(10)) == 7), True)
    at = F.when(index > 0, index - 1)
    rest = F.filter("args", lambda x, i: at.isNull() | (i != at))
    return _arguments(spark, d).select("l_orderkey", F.coalesce(at, F.lit(-1)).alias("at"), F.array_join(F.transform(rest, lambda x: x.cast("string")), ",").alias("args"))


def import_usage(spark: SparkSession, d: str) -> DataFrame:
    """How often the imports of each file are used: orders as files, parts as declarations, brands as packages.

    Small parts are imported by name, brands of large ones with a star; some returned parts are unresolved names; a
    file's own package is the brand of its first part.
    """
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    lost = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("lost")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_partkey", lost).join(part, "l_partkey")
    # deals the lines out by file; names are made and lines taken apart behind it
    lines = lines.withColumn("package", F.min_by("p_brand", "l_partkey").over(Window.partitionBy("file")))
    name = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    path = F.concat("p_brand", F.lit("."), name)
    by_name = (F.col("p_size") <= 25) & F.col("p_brand").isNotNull()
    both = F.array(
        imports.mention(path, name, star=F.when(by_name, False), imported=by_name, used=F.lit(True), lost=F.col("lost")),
        F.when(F.col("p_size") > 40, imports.mention(F.col("p_brand"), star=F.lit(True), imported=F.lit(True))),
    )
    mentions = lines.select("file", "package", F.inline(F.array_compact(both)))
    return imports.counted(mentions).select("file", "path", "star", "n").distinct()


def call_traces(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the orders that use them, once each and in order; lines of the flag N count as imports."""
    usages = table(spark, d, "lineitem").select(F.col("l_partkey").alias("callable"), F.col("l_orderkey").alias("place"), (F.col("l_returnflag") == "N").alias("in_import"))
    found = elements.call_traces(table(spark, d, "part").select(F.col("p_partkey").alias("callable")), usages)
    return found.select("callable", F.size("traces").alias("n"), F.array_join(F.transform("traces", lambda x: x.cast("string")), ",").alias("traces"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Events as elements of files."""
    kinds = F.create_map(*(F.lit(x) for pair in (("click", "function"), ("error", "lambda"), ("purchase", "class"), ("signup", "parameter"), ("view", "initializer")) for x in pair))
    by = lambda n: F.pmod("event_id", F.lit(n)) == 0
    return table(spark, d, "events").select(
        F.when(~by(11), F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("file"),
        F.array("event_id").alias("path"),
        kinds[F.col("event_type")].alias("kind"),
        F.when(by(3), "java").otherwise("other").alias("lang"),
        F.when(~by(5), F.col("value") > 20).alias("has_body"),
        by(7).alias("is_constructor"),
        by(4).alias("is_operator"),
        by(9).alias("in_value_class"),
    )


def element_items(spark: SparkSession, d: str) -> DataFrame:
    """What can be replaced and what can be deleted, by kind."""
    found = _elements(spark, d)
    of = lambda lang: found.where(F.col("lang") == lang)
    body = elements.body_items([of("java"), of("other")]).withColumn("item", F.lit("body"))
    parameters = found.where("kind = 'parameter'")
    deletable = elements.deletable_items(found.where("kind <> 'parameter'"), parameters).withColumn("item", F.lit("deletable"))
    return body.unionByName(deletable).groupBy("item", "kind").agg(F.count("*").alias("n"))


def element_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Items resolved to the element at their place; those without one are left out. Items are every third event."""
    found = _elements(spark, d)
    items = found.where("path[0] % 3 = 0").select("file", F.transform("path", lambda x: x + F.when(F.pmod(x, F.lit(2)) == 0, 0).otherwise(10**9)).alias("path"))
    return elements.resolved(items, found.select("file", "path", "kind")).select("file", F.col("path")[0].alias("at"), "kind")


def parameter_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order and of the next by their place, as parameters of two declarations."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("name"))
    return elements.matching_parameters(rows, rows.withColumn("function", F.col("function") - 1))


def tasks_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tasks of their regions: one by its whole path, others by an end of it."""
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    tasks = table(spark, d, "nation").join(region, "n_regionkey").select(F.concat(F.lit(":"), "r_name", F.lit(":"), "n_name").alias("path"), "n_name")
    tasks = keep(tasks)
    first = tasks.orderBy("path").limit(1).select(F.col("path").alias("name"))
    names = first.union(tasks.orderBy(F.desc("path")).limit(2).select(F.col("n_name")))
    # three names
    return elements.tasks_named(tasks.select("path").crossJoin(F.broadcast(names)), F.col("name")).select("name", "path")


def zip_positions(spark: SparkSession, d: str) -> DataFrame:
    """The parts of an order and of the next, by their place in the list, as far as the shorter goes."""
    mine = _arguments(spark, d)
    after = mine.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("args").alias("after"))
    n = F.least(F.size("args"), F.size("after"))
    pairs = F.arrays_zip(F.slice("args", F.lit(1), n).alias("a"), F.slice("after", F.lit(1), n).alias("b"))
    return mine.join(after, "l_orderkey").select("l_orderkey", F.posexplode(pairs).alias("place", "x")).select("l_orderkey", "place", "x.a", "x.b")


def suitable_projects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as projects of a manifest: a language as tag, none for some; those that a benchmark takes."""
    tags = F.when(F.col("doc_id") % 3 != 0, F.array(F.when(F.col("lang") == "de", "android").otherwise(F.col("lang"))))
    extra = F.when(F.col("doc_id") % 5 != 0, F.struct(tags.alias("tags"), F.lit(None).cast("string").alias("issue")))
    rows = table(spark, d, "documents").select(
        "doc_id", extra.alias("extra"), F.when(F.col("doc_id") % 2 == 0, "gradle").otherwise("maven").alias("build_system"), F.when(F.col("n_chars") < 3000, "single").otherwise("multiple").alias("modules")
    )
    return files.suitable(rows).select("doc_id")


_RARE = "SELECT {} FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"
QUERIES = {
    "hash_lookup_join": (hash_lookup_join, "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY p_brand"),
    "zip_truncate": (zip_truncate, "SELECT a.conv_id, a.turn, a.role AS role_a, b.role AS role_b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn"),
    "prefix_pairs": (
        prefix_pairs,
        "SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL",
    ),
    "semi_anti": (semi_anti, f"SELECT c_custkey, c_custkey IN ({_RARE.format('o_custkey')}) AS has FROM customer"),
    "ordered_args": (
        ordered_args,
        """WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, array_to_string(p, ',') AS args, CAST(list_position(p, list_min(p)) - 1 AS BIGINT) AS at FROM a""",
    ),
    "argument_removal": (
        argument_removal,
        """WITH m AS (SELECT *, min(l_partkey) OVER (PARTITION BY l_orderkey) AS least FROM lineitem)
        SELECT l_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_partkey <> least), '') AS args FROM m GROUP BY l_orderkey""",
    ),
    "argument_dropped": (
        argument_dropped,
        """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
        m AS (SELECT *, min(CASE WHEN l_partkey % 10 = 7 THEN i END) OVER (PARTITION BY l_orderkey) AS k FROM a)
        SELECT l_orderkey, coalesce(any_value(k), -1) AS at, coalesce(string_agg(l_partkey, ',' ORDER BY i) FILTER (WHERE k IS NULL OR i <> k), '') AS args FROM m GROUP BY l_orderkey""",
    ),
    "import_usage": (
        import_usage,
        """WITH u AS (SELECT l_orderkey AS file, p_brand AS pkg, 'P' || p_partkey AS name, p_partkey, p_size, l_returnflag, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey),
        own AS (SELECT file, arg_min(pkg, p_partkey) AS package FROM u GROUP BY file),
        needed AS (SELECT u.file, pkg, name, count(*) AS n FROM u JOIN own ON own.file = u.file AND own.package <> u.pkg GROUP BY u.file, pkg, name),
        named AS (SELECT DISTINCT file, pkg, name FROM u WHERE p_size <= 25),
        stars AS (SELECT DISTINCT file, pkg FROM u WHERE p_size > 40),
        lost AS (SELECT file, name, count(*) AS n FROM u WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY file, name),
        demand AS (SELECT file, pkg, sum(n) AS n FROM needed WHERE (file, pkg, name) NOT IN (SELECT (file, pkg, name) FROM named) GROUP BY file, pkg)
        SELECT file, pkg || '.' || name AS path, false AS star, CAST(coalesce(needed.n, 0) + coalesce(lost.n, 0) AS BIGINT) AS n
        FROM named LEFT JOIN needed USING (file, pkg, name) LEFT JOIN lost USING (file, name) WHERE coalesce(needed.n, 0) + coalesce(lost.n, 0) > 0
        UNION ALL SELECT file, pkg, true, CAST(n AS BIGINT) FROM stars JOIN demand USING (file, pkg)""",
    ),
    "call_traces": (
        call_traces,
        """WITH u AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag <> 'N')
        SELECT p_partkey AS callable, CAST(count(l_orderkey) AS INT) AS n, coalesce(string_agg(l_orderkey, ',' ORDER BY l_orderkey), '') AS traces FROM part LEFT JOIN u ON l_partkey = p_partkey GROUP BY p_partkey""",
    ),
    "element_items": (
        element_items,
        """WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'function' WHEN 'error' THEN 'lambda' WHEN 'purchase' THEN 'class' WHEN 'signup' THEN 'parameter' WHEN 'view' THEN 'initializer' END AS kind FROM events)
        SELECT 'body' AS item, kind, count(*) AS n FROM e WHERE kind IN ('function', 'lambda', 'initializer') AND NOT (event_id % 3 = 0 AND event_id % 7 = 0) AND (event_id % 5 = 0 OR value > 20) AND event_id % 11 <> 0 GROUP BY kind
        UNION ALL SELECT 'deletable', kind, count(*) FROM e WHERE kind IN ('function', 'class') OR (kind = 'parameter' AND event_id % 4 <> 0 AND event_id % 9 <> 0) GROUP BY kind""",
    ),
    "element_lookup": (
        element_lookup,
        """SELECT 'f' || user_id AS file, event_id AS at, CASE event_type WHEN 'click' THEN 'function' WHEN 'error' THEN 'lambda' WHEN 'purchase' THEN 'class' WHEN 'signup' THEN 'parameter' WHEN 'view' THEN 'initializer' END AS kind
        FROM events WHERE event_id % 6 = 0 AND event_id % 11 <> 0""",
    ),
    "parameter_pairs": (
        parameter_pairs,
        """SELECT a.l_orderkey AS function, a.l_linenumber AS ordinal, a.l_partkey AS expected, b.l_partkey AS actual
        FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey + 1 AND b.l_linenumber = a.l_linenumber""",
    ),
    "tasks_by_name": (
        tasks_by_name,
        """WITH t AS (SELECT ':' || r_name || ':' || n_name AS path, n_name FROM nation JOIN region ON r_regionkey = n_regionkey)
        (SELECT path AS name, path FROM t ORDER BY path LIMIT 1) UNION ALL SELECT n_name, path FROM (SELECT * FROM t ORDER BY path DESC LIMIT 2)""",
    ),
    "zip_positions": (
        zip_positions,
        """WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem)
        SELECT x.l_orderkey, CAST(x.i AS INT) AS place, x.l_partkey AS a, y.l_partkey AS b FROM a x JOIN a y ON y.l_orderkey = x.l_orderkey + 1 AND y.i = x.i""",
    ),
    "suitable_projects": (
        suitable_projects,
        "SELECT doc_id FROM documents WHERE NOT (doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND lang = 'de') AND doc_id % 2 = 0 AND n_chars < 3000",
    ),
    "refcount_unused": (
        refcount_unused,
        f"SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN ({_RARE.format('o_orderkey')}))",
    ),
    "star_demand": (
        star_demand,
        f"SELECT p_type, count(*) AS n_uses FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand NOT IN {EXPLICIT} GROUP BY p_type",
    ),
    "group_files": (
        group_files,
        "SELECT source, count(*) FILTER (WHERE n_chars < 1000) AS n_whole, count(*) FILTER (WHERE n_chars >= 1000) AS n_partial FROM documents GROUP BY source",
    ),
    "top1_by_name": (top1_by_name, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"),
    "quantified": (
        quantified,
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING bool_and(s_acctbal > 0))",
    ),
    "simple_equality": (simple_equality, "SELECT l_partkey, l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "set_ops": (
        set_ops,
        """WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')
        SELECT l_partkey, CASE WHEN l_partkey IN (SELECT l_partkey FROM a) THEN 'both' ELSE 'returned' END AS kind FROM r""",
    ),
    "manifest_filter": (manifest_filter, "SELECT doc_id FROM documents WHERE lang <> 'de' AND regexp_matches(source, '^src[0-9]$')"),
    "mask_body": (mask_body, "SELECT doc_id, md5(CASE WHEN n_chars > 5000 THEN 'removed' ELSE text END) AS digest FROM documents"),
    "snapshot_commit": (snapshot_commit, "SELECT o_orderkey, 1 AS version FROM orders WHERE o_orderstatus <> 'F'"),
    "file_counters": (file_counters, f"SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey IN ({_RARE.format('o_orderkey')}) GROUP BY l_orderkey, l_partkey"),
}
