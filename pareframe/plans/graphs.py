"""Graph queries: over foreign keys, and over transitions between event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pareframe.operators import components, graph, members
from pareframe.plans.searches import fk_graph
from pareframe.sources.tables import keep, table


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): event types that follow one another for a user at least as often as an average pair of 25."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, d, "events").select(F.col("event_type").alias("src"), after.alias("dst")).where("dst IS NOT NULL")
    counted = keep(pairs.groupBy("src", "dst").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n").alias("total"))
    # one row
    return counted.crossJoin(F.broadcast(total)).where("src <> dst AND n * 25 >= total").select("src", "dst")


def _types(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What goes with nation 3."""
    vertices, edges = fk_graph(spark, d)
    gone = vertices.where("id = 'n:3'")
    return graph.cascade(vertices, edges, gone).where("deleted").select("id")


def closure_cyclic(spark: SparkSession, d: str) -> DataFrame:
    edges = keep(transitions(spark, d))
    return graph.reach(_types(edges).select(F.col("id").alias("root"), "id"), edges)


def scc_condense(spark: SparkSession, d: str) -> DataFrame:
    edges = keep(transitions(spark, d))
    found = keep(graph.strong_components(_types(edges), edges))
    out = graph.condense(edges, found).groupBy(F.col("src").alias("component")).agg(F.count("*").alias("n_out"))
    return found.join(out, "component", "left").select("id", "component", F.coalesce("n_out", F.lit(0)).alias("n_out"))


def sinks_layers(spark: SparkSession, d: str) -> DataFrame:
    vertices, edges = fk_graph(spark, d)
    return graph.layer_numbers(vertices, edges)


def dag_depth(spark: SparkSession, d: str) -> DataFrame:
    vertices, edges = fk_graph(spark, d)
    return graph.depths(vertices, edges)


def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys among the customers in credit and the nations of the first three regions."""
    _, edges = fk_graph(spark, d)
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"))
    near = table(spark, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.induced(edges, good.union(near)).select("src", "dst")


def edge_assembly(spark: SparkSession, d: str) -> DataFrame:
    return fk_graph(spark, d)[1].groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_targets"))


def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    vertices, edges = fk_graph(spark, d)
    return graph.degrees(vertices, edges).groupBy("n_out", "n_in").agg(F.count("*").alias("n"))


def _trade(spark: SparkSession, d: str, which: str | None = None) -> DataFrame:
    """(src, dst): supplier, as a negative number, and customer of each line."""
    line = table(spark, d, "lineitem")
    line = (line.where(which) if which else line).select("l_orderkey", "l_suppkey")
    buyer = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("dst"))
    return line.join(buyer, "l_orderkey").select((-F.col("l_suppkey") - 1).alias("src"), "dst")


def linked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of suppliers and customers under the R-flagged lines of at least 50 pieces only, a
    small part of all lines. ``linked_traders`` takes every line."""
    return components.connected_components(_trade(spark, d, "l_returnflag = 'R' AND l_quantity >= 50"))


def linked_traders(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of suppliers and customers under every line: a supplier has the id -l_suppkey - 1."""
    return components.connected_components(_trade(spark, d))


def member_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customers as types below their nation, nations below their region. Some of each declare a member, regions abstract
    ones; each lies in a file of its region's folder, and customers are used by the suppliers of their number, twice."""
    name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    customer, nation, region = (table(spark, d, t) for t in ("customer", "nation", "region"))
    sub = customer.select(name("c", "c_custkey").alias("sub"), name("n", "c_nationkey").alias("super")).union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey")))

    def declared(rows: DataFrame, kind: str, key: str, every: int) -> DataFrame:
        own = rows.where(F.col(key) % every == 0)
        return own.select(name(f"{kind}m", key).alias("id"), name(kind, key).alias("owner"), F.lit("f").alias("name"), F.lit(kind == "r").alias("abstract"))

    found = declared(customer, "c", "c_custkey", 2).union(declared(nation, "n", "n_nationkey", 3)).union(declared(region, "r", "r_regionkey", 2))
    file = F.concat(F.lit("src/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".kt"))
    elements = nation.select(name("n", "n_nationkey").alias("id"), file.alias("path"), F.lit(None).cast("string").alias("parent"))
    uses = table(spark, d, "supplier").join(customer, F.col("s_suppkey") == F.col("c_custkey")).select(name("s", "s_suppkey").alias("src"), name("c", "c_custkey").alias("dst"))
    edges = members.multigraph(elements, keep(sub), keep(found), uses.union(uses))
    return edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


_FK = """e AS (
    SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'o-c' AS kind FROM orders
    UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'c-n' FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 's-n' FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'n-r' FROM nation),
    v AS (SELECT src AS id FROM e UNION SELECT 'r:' || r_regionkey FROM region)"""
_MOVES = """p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
    c AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY src, dst),
    e AS (SELECT src, dst FROM c WHERE src <> dst AND n * 25 >= (SELECT sum(n) FROM c)),
    v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    reach(root, id) AS (SELECT id, id FROM v UNION SELECT root, dst FROM reach JOIN e ON e.src = reach.id)"""
QUERIES = {
    "cascade_delete": (cascade_delete, f"WITH RECURSIVE {_FK}, gone(id) AS (SELECT 'n:3' UNION SELECT src FROM gone JOIN e ON e.dst = gone.id) SELECT id FROM gone"),
    "closure_cyclic": (closure_cyclic, f"WITH RECURSIVE {_MOVES} SELECT root, id FROM reach"),
    "scc_condense": (
        scc_condense,
        f"""WITH RECURSIVE {_MOVES}, s AS (SELECT a.root AS id, min(a.id) AS component FROM reach a JOIN reach b ON a.root = b.id AND a.id = b.root GROUP BY a.root),
        o AS (SELECT DISTINCT x.component AS src, y.component AS dst FROM e JOIN s x ON x.id = e.src JOIN s y ON y.id = e.dst WHERE x.component <> y.component)
        SELECT s.id, s.component, count(o.dst) AS n_out FROM s LEFT JOIN o ON o.src = s.component GROUP BY s.id, s.component""",
    ),
    "sinks_layers": (
        sinks_layers,
        f"""WITH RECURSIVE {_FK}, w(id, layer) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT src FROM e) UNION ALL SELECT src, layer + 1 FROM w JOIN e ON e.dst = w.id)
        SELECT id, max(layer) AS layer FROM w GROUP BY id""",
    ),
    "dag_depth": (
        dag_depth,
        f"""WITH RECURSIVE {_FK}, w(id, depth) AS (SELECT id, 0 FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT dst, depth + 1 FROM w JOIN e ON e.src = w.id)
        SELECT id, max(depth) AS depth FROM w GROUP BY id""",
    ),
    "induced_subgraph": (
        induced_subgraph,
        "SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND n_regionkey < 3",
    ),
    "edge_assembly": (edge_assembly, f"WITH {_FK} SELECT kind, count(*) AS n, count(DISTINCT dst) AS n_targets FROM e GROUP BY kind"),
    "degree_counts": (
        degree_counts,
        f"""WITH {_FK}, d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS n_out, (SELECT count(*) FROM e WHERE dst = id) AS n_in FROM v)
        SELECT n_out, n_in, count(*) AS n FROM d GROUP BY n_out, n_in""",
    ),
    "linked_parts": (
        linked_parts,
        """WITH RECURSIVE e AS (SELECT DISTINCT -l_suppkey - 1 AS src, o_custkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 50),
        b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        reach(id, root) AS (SELECT src, src FROM e UNION SELECT b.dst, reach.root FROM reach JOIN b ON b.src = reach.id)
        SELECT id, min(root) AS component FROM reach GROUP BY id""",
    ),
    "member_graph": (
        member_graph,
        """WITH t AS (SELECT 'c:' || c_custkey AS sub, 'n:' || c_nationkey AS super FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation),
        o AS (SELECT 'cm:' || c_custkey AS src, 'c:' || c_custkey AS owner, CASE WHEN n_nationkey % 3 = 0 THEN 'nm:' || n_nationkey WHEN n_regionkey % 2 = 0 THEN 'rm:' || n_regionkey END AS dst
                FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0
            UNION ALL SELECT 'nm:' || n_nationkey, 'n:' || n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN 'rm:' || n_regionkey END FROM nation WHERE n_nationkey % 3 = 0),
        f AS (SELECT 'src/' || n_regionkey || '/' || n_nationkey || '.kt' AS file, 'src/' || n_regionkey AS folder, n_nationkey FROM nation),
        u AS (SELECT 's:' || s_suppkey AS src, 'c:' || c_custkey AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey),
        e AS (SELECT sub AS src, super AS dst, 'overload' AS kind FROM t UNION ALL SELECT src, dst, 'overload' FROM o WHERE dst IS NOT NULL
            UNION ALL SELECT owner, src, 'obligatory' FROM o WHERE dst LIKE 'rm:%' UNION ALL SELECT src, dst, 'usage' FROM u UNION ALL SELECT src, dst, 'usage' FROM u
            UNION ALL SELECT 'n:' || n_nationkey, file, 'tree' FROM f UNION ALL SELECT file, folder, 'file' FROM f UNION ALL SELECT DISTINCT folder, 'src', 'file' FROM f UNION ALL SELECT 'src', '', 'file')
        SELECT src, dst, kind, count(*) AS n FROM e GROUP BY src, dst, kind""",
    ),
    # no SQL: recursion holds each pair of linked ids, the square of a component
    "linked_traders": (linked_traders, None),
}
