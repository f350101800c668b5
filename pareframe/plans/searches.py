"""Search queries. All of them run a search; the SQL knows the one right answer in another way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareframe.operators import paths, reduction, search, stages, trace
from pareframe.plans.trees import _TREE
from pareframe.sources.tables import keep, shared_folder, table

TOP = 3


def top_orders(spark: SparkSession, d: str, n: int = TOP) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(n)


def customers_with_targets(spark: SparkSession, d: str) -> DataFrame:
    """idx, item_id (customers with orders), wanted: their orders among the TOP dearest."""
    top = top_orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("wanted"))
    items = table(spark, d, "orders").select("o_custkey").distinct().join(top, "o_custkey", "left")
    items = items.select(F.col("o_custkey").alias("item_id"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    return keep(search.numbered(items, "item_id"))


def _answer(items: DataFrame, found: search.Ranges) -> DataFrame:
    return search.retained(items, found).select("item_id", "retained")


def ddmin_topk_orders(spark: SparkSession, d: str) -> DataFrame:
    items = customers_with_targets(spark, d)
    return _answer(items, search.ddmin(reduction.contains_all(items, "wanted")))


def ddmin_all_or_none(spark: SparkSession, d: str) -> DataFrame:
    """As above, but the first two customers can only go together."""
    items = customers_with_targets(spark, d)
    test = search.Property(items, {"wanted": F.col("wanted"), "bad": F.when(F.col("idx") < 2, 1).otherwise(0)}, lambda s: True)
    test.holds = lambda s: s["wanted"] == test.total["wanted"] and s["bad"] in (0, 2)
    return _answer(items, search.ddmin(test))


def pdd_topk_orders(spark: SparkSession, d: str) -> DataFrame:
    items = customers_with_targets(spark, d)
    return _answer(items, search.pdd(reduction.contains_all(items, "wanted")))


def pdd_hints(spark: SparkSession, d: str) -> DataFrame:
    """As above, told which customers are likely: those with one of the 10 dearest orders."""
    items = customers_with_targets(spark, d)
    likely = items.join(top_orders(spark, d, 10).select(F.col("o_custkey").alias("item_id")).distinct(), "item_id", "left_semi")
    hints = search.merged(sorted(r.idx for r in likely.select("idx").collect()))
    return _answer(items, search.pdd(reduction.contains_all(items, "wanted"), hints))


def zero_test(spark: SparkSession, d: str) -> DataFrame:
    """A property of any subset, the empty one too: everything goes."""
    items = customers_with_targets(spark, d)
    return _answer(items, search.ddmin(search.Property(items, {"n": F.lit(1)}, lambda s: s["n"] >= 0), zero=True))


def hdd_geo(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers: what holds the TOP customers by balance."""
    customer = table(spark, d, "customer")
    top = customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(TOP).select("c_custkey", F.lit(1).alias("w"))
    customers = customer.join(top, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"), F.coalesce("w", F.lit(0)).alias("wanted"))
    customers = keep(customers)
    below = customers.groupBy(F.col("parent").alias("n_nationkey")).agg(F.sum("wanted").alias("w"))
    nations = table(spark, d, "nation").join(below, "n_nationkey", "left")
    nations = nations.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("parent"), F.coalesce("w", F.lit(0)).alias("wanted"))
    above = nations.groupBy(F.col("parent").alias("r_regionkey")).agg(F.sum("wanted").alias("w"))
    regions = table(spark, d, "region").join(above, "r_regionkey", "left")
    regions = regions.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("int").alias("parent"), F.coalesce("w", F.lit(0)).alias("wanted"))
    return reduction.hierarchical([("region", regions), ("nation", nations), ("customer", customers)])


def fk_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of orders, customers, suppliers, nations and regions as vertices (id), foreign keys as edges (src, dst, kind)."""
    name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    tables = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    edges, vertices = None, table(spark, d, "region").select(name("r", "r_regionkey").alias("id"))
    for source, kind, key, to, reference in tables:
        rows = table(spark, d, source)
        one = rows.select(name(kind, key).alias("src"), name(to, reference).alias("dst"), F.lit(f"{kind}-{to}").alias("kind"))
        edges = one if edges is None else edges.unionByName(one)
        vertices = vertices.unionByName(rows.select(name(kind, key).alias("id")))
    return vertices.distinct(), edges


def graphdd_fk(spark: SparkSession, d: str) -> DataFrame:
    """The dearest orders, and the rows that they need."""
    vertices, edges = fk_graph(spark, d)
    targets = top_orders(spark, d).select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    return reduction.graph_reduction(keep(vertices), keep(edges), keep(targets)).where("retained").select("id")


def _ends(value: str, key: str) -> dict[str, search.Partial]:
    """The least and the greatest row by value: no sum says whether they are there."""
    at = F.struct(value, key)
    return {"least": search.least(at), "most": search.most(at)}


def ddmin_same_ends(spark: SparkSession, d: str) -> DataFrame:
    """The suppliers without which the least or the greatest balance would be another."""
    items = search.numbered(table(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), "s_acctbal"), "item_id")
    return _answer(items.select("idx", "item_id"), search.ddmin(search.same_state(items, _ends("s_acctbal", "item_id"))))


def hdd_pages(spark: SparkSession, d: str, events: trace.Trace | None = None) -> DataFrame:
    """Domains, hosts and so on down to the pages with the shortest and the longest text, from generated levels."""
    pages = table(spark, d, "pages").select("page_id", paths.url_parts(F.col("url")).alias("parts"), F.char_length("html").alias("size"))
    pages = keep(paths.prefixes(pages).select("page_id", "size", "prefix", "parent", "depth"))
    tree = keep(pages.select(F.col("prefix").alias("id"), "parent", "depth").distinct())
    depth = 0

    def following(kept: DataFrame | None):
        nonlocal depth
        depth += 1
        level = tree.where(F.col("depth") == depth)
        if kept is not None:
            level = level.join(kept.select(F.col("id").alias("parent")), "parent", "left_semi")
        return str(depth), level.select("id")

    def tester(name: str, items: DataFrame) -> search.Merged:
        ends = _ends("size", "page_id")
        own = pages.where(F.col("depth") == int(name)).groupBy(F.col("prefix").alias("id")).agg(*(p.aggregate(p.column).alias(k) for k, p in ends.items()))
        return search.same_state(items.join(own, "id", "left"), {"least": search.least(F.col("least")), "most": search.most(F.col("most"))})

    return reduction.hierarchical(following, tester=tester, trace=events).select(F.col("level").cast("int").alias("depth"), F.col("id").alias("prefix"))


def trace_pages(spark: SparkSession, d: str) -> DataFrame:
    """What happens inside the search of ``hdd_pages``: levels, runs and comparisons by their verdict, and items in them."""
    events = trace.Trace(spark, f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}")
    hdd_pages(spark, d, events)
    return trace.totals(trace.read(spark, events.place))


def graphdd_condensed(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, the nations that they need, and regions. A nation needs its region and a region its nations, so these are
    cycles. Kept are the suppliers with the least and the greatest balance, and the whole regions of these."""
    name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    s, n, r = name("s", "s_suppkey"), name("n", "n_nationkey"), name("r", "n_regionkey")
    vertices = supplier.select(s.alias("id")).union(nation.select(n)).union(table(spark, d, "region").select(name("r", "r_regionkey")))
    edges = supplier.select(s.alias("src"), name("n", "s_nationkey").alias("dst")).union(nation.select(n, r)).union(nation.select(r, n))
    balances = keep(supplier.select(s.alias("id"), "s_acctbal"))
    ends = _ends("s_acctbal", "id")
    whole = search.Merged(balances.withColumn("idx", F.lit(0).cast("long")), ends, lambda found: True).total
    same = reduction.States(balances, ends, lambda found: found == whole)
    return reduction.graph_reduction_condensed(keep(vertices), keep(edges), states=same).where("retained").select("id")


def benchmark_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions as projects of a manifest: of those without an A at the end, the nations that hold the largest balance of
    their customers; reduced one by one, and reported."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"))
    nations = keep(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "name"))
    best = keep(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_acctbal").alias("best")))
    data = keep(nations.join(best, "n_nationkey"))

    def largest(rows: DataFrame, settings: stages.Settings) -> DataFrame:
        items = search.numbered(rows, "n_nationkey")
        test = search.same_failure(items, lambda x: x.agg(F.max("best")).first()[0], settings.similar)
        return search.retained(items, settings.find(test)).where("retained").drop("idx", "retained")

    pipeline = stages.Pipeline({"largest": largest})
    return stages.benchmark(region, lambda p: p.where("name NOT LIKE '%A'"), lambda name: data.where(F.col("name") == name), pipeline, stages.Settings(stages=("largest",)))


_TARGETS = f"(SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOP})"
_ITEMS = f"SELECT DISTINCT o_custkey AS item_id, o_custkey IN {_TARGETS} AS retained FROM orders"
_GEO = f"SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT {TOP}"
QUERIES = {
    "ddmin_topk_orders": (ddmin_topk_orders, _ITEMS),
    "ddmin_all_or_none": (ddmin_all_or_none, _ITEMS),
    "pdd_topk_orders": (pdd_topk_orders, _ITEMS),
    "pdd_hints": (pdd_hints, _ITEMS),
    "zero_test": (zero_test, "SELECT DISTINCT o_custkey AS item_id, false AS retained FROM orders"),
    "ddmin_same_ends": (
        ddmin_same_ends,
        """SELECT s_suppkey AS item_id, s_suppkey IN ((SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1), (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 1)) AS retained
        FROM supplier""",
    ),
    "hdd_pages": (
        hdd_pages,
        f"""WITH {_TREE}, e AS ((SELECT page_id FROM pages ORDER BY length(html), page_id LIMIT 1) UNION (SELECT page_id FROM pages ORDER BY length(html) DESC, page_id DESC LIMIT 1))
        SELECT DISTINCT depth, prefix FROM pre WHERE page_id IN (SELECT page_id FROM e)""",
    ),
    # no SQL: what a search tries depends on its way of searching; a test compares it with the log
    "trace_pages": (trace_pages, None),
    "graphdd_condensed": (
        graphdd_condensed,
        """WITH e AS ((SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_acctbal, 's:' || s_suppkey LIMIT 1) UNION (SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_acctbal DESC, 's:' || s_suppkey DESC LIMIT 1)),
        r AS (SELECT DISTINCT n_regionkey FROM e JOIN nation ON n_nationkey = s_nationkey)
        SELECT 's:' || s_suppkey AS id FROM e UNION SELECT 'r:' || n_regionkey FROM r UNION SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM r)""",
    ),
    "benchmark_regions": (
        benchmark_regions,
        """SELECT r_name AS name, count(DISTINCT n_nationkey) AS before, CAST(1 AS BIGINT) AS after, 1.0 / count(DISTINCT n_nationkey) AS ratio
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name NOT LIKE '%A' GROUP BY r_name""",
    ),
    "hdd_geo": (
        hdd_geo,
        f"""WITH t AS ({_GEO})
        SELECT 'region' AS level, CAST(n_regionkey AS BIGINT) AS id FROM t UNION SELECT 'nation', CAST(c_nationkey AS BIGINT) FROM t
        UNION SELECT 'customer', c_custkey FROM t""",
    ),
    "graphdd_fk": (
        graphdd_fk,
        f"""WITH t AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOP}),
        j AS (SELECT * FROM t JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
        SELECT 'o:' || o_orderkey AS id FROM j UNION SELECT 'c:' || c_custkey FROM j UNION SELECT 'n:' || n_nationkey FROM j
        UNION SELECT 'r:' || n_regionkey FROM j""",
    ),
}
