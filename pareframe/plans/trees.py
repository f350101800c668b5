"""Hierarchy queries over the addresses of ``pages``: domain, host, language, page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareframe.operators import elements, paths
from pareframe.sources.tables import keep, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", paths.url_parts(F.col("url")).alias("parts"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return keep(paths.nodes(_pages(spark, d)))


def subtree_size(spark: SparkSession, d: str) -> DataFrame:
    return paths.nodes(_pages(spark, d)).select("prefix", "depth", "n")


def file_tree_edges(spark: SparkSession, d: str) -> DataFrame:
    return paths.edges(_pages(spark, d))


def chain_collapse(spark: SparkSession, d: str) -> DataFrame:
    return paths.single_chains(_tree(spark, d))


def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """For each page the deepest prefix above it that has more than two pages."""
    tree = _tree(spark, d)
    pages = _pages(spark, d).select("page_id", paths.joined(F.col("parts")).alias("prefix"))
    return pages.join(paths.nearest(tree, tree.where("n > 2")), "prefix").select("page_id", "ancestor")


def topmost_marked(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes below the domains with 3 to 6 pages that have no such prefix above them."""
    return paths.topmost(_tree(spark, d).where("depth > 1 AND n BETWEEN 3 AND 6")).select("prefix", "n")


def root_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Below the hosts, the largest parts without a language folder of one page."""
    tree = _tree(spark, d)
    return paths.propagated_roots(tree, tree.where("depth = 2"), tree.where("depth = 3 AND n = 1"))


def outermost_only(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are in no language folder of more than two pages."""
    tree = _tree(spark, d)
    inside = paths.ancestors(tree).join(tree.where("depth = 3 AND n > 2").select(F.col("prefix").alias("ancestor")), "ancestor", "left_semi")
    pages = _pages(spark, d).select("page_id", paths.joined(F.col("parts")).alias("prefix"))
    return pages.join(inside.select("prefix").distinct(), "prefix", "left_anti").select("page_id")


def relativize(spark: SparkSession, d: str) -> DataFrame:
    """Addresses relative to their scheme and host."""
    rest = F.regexp_replace("url", "^[a-z]+://[^/]+/?", "")
    return table(spark, d, "pages").select("page_id", rest.alias("relative"))


def chain_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where a search that begins at each prefix really begins."""
    return paths.chain_ends(_tree(spark, d))


def possible_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots from the domains as content (none has a folder src) and the hosts and languages as sources; folders of one page are ignored."""
    tree = _tree(spark, d)
    return paths.possible_roots(tree.where("depth = 1"), tree.where("depth IN (2, 3)"), tree, tree.where("depth = 3 AND n = 1"), "")


def topmost_last_first(spark: SparkSession, d: str) -> DataFrame:
    """The topmost marked prefixes with their turn when the last is visited first."""
    from pyspark.sql import Window

    found = paths.topmost(_tree(spark, d).where("depth > 1 AND n BETWEEN 2 AND 9")).withColumn("root", F.substring_index("prefix", "/", 1))
    return found.select("prefix", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("prefix"))).alias("turn"))


def mixed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each page's path up to the first with a digit, and from there on."""
    parts = elements.mixed_path(F.col("parts"), F.transform("parts", lambda x: ~x.rlike("[0-9]")))
    return _pages(spark, d).select("page_id", parts.alias("m")).select("page_id", paths.joined(F.col("m.stubs")).alias("stubs"), paths.joined(F.col("m.children")).alias("children"))


def copied_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages but those below the first host."""
    first = _tree(spark, d).where("depth = 2").agg(F.min("prefix").alias("p")).first().p
    pages = _pages(spark, d).select("page_id", paths.joined(F.col("parts")).alias("path"))
    return elements.copied(pages, (first or "",)).select("page_id")


_TREE = r"""plain AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS p FROM pages),
    hosts AS (SELECT page_id, p, split_part(p, '/', 1) AS h FROM plain),
    parts AS (SELECT page_id, list_concat([split_part(h, '.', -2) || '.' || split_part(h, '.', -1)], string_split(p, '/')) AS parts FROM hosts),
    cut AS (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS depth FROM parts),
    pre AS (SELECT page_id, array_to_string(parts[1:depth], '/') AS prefix, CASE WHEN depth > 1 THEN array_to_string(parts[1:depth - 1], '/') END AS parent, CAST(depth AS INT) AS depth, depth = len(parts) AS last FROM cut),
    tree AS (SELECT prefix, parent, depth, count(*) AS n FROM pre GROUP BY prefix, parent, depth)"""
QUERIES = {
    "subtree_size": (subtree_size, f"WITH {_TREE} SELECT prefix, depth, n FROM tree"),
    "file_tree_edges": (file_tree_edges, f"WITH {_TREE} SELECT prefix AS src, parent AS dst FROM tree WHERE parent IS NOT NULL"),
    "chain_collapse": (
        chain_collapse,
        f"""WITH {_TREE}, c AS (SELECT parent, count(*) AS k, max(prefix) AS child FROM tree WHERE parent IS NOT NULL GROUP BY parent)
        SELECT parent AS prefix, child FROM c WHERE k = 1 AND child IN (SELECT parent FROM c)""",
    ),
    "chain_ends": (
        chain_ends,
        f"""WITH RECURSIVE {_TREE}, c AS (SELECT parent, count(*) AS k, max(prefix) AS child FROM tree WHERE parent IS NOT NULL GROUP BY parent),
        s AS (SELECT parent AS prefix, child FROM c WHERE k = 1 AND child IN (SELECT parent FROM c)),
        w(prefix, last) AS (SELECT prefix, prefix FROM tree UNION ALL SELECT w.prefix, s.child FROM w JOIN s ON s.prefix = w.last)
        SELECT prefix, arg_max(last, length(last)) AS last FROM w GROUP BY prefix""",
    ),
    "possible_roots": (
        possible_roots,
        f"""WITH {_TREE}, i AS (SELECT prefix FROM tree WHERE depth = 3 AND n = 1),
        f AS (SELECT * FROM tree t WHERE depth >= 2 AND NOT EXISTS (SELECT 1 FROM i WHERE i.prefix = t.prefix OR starts_with(i.prefix, t.prefix || '/') OR starts_with(t.prefix, i.prefix || '/'))),
        r AS (SELECT prefix FROM f WHERE depth = 2 OR EXISTS (SELECT 1 FROM i WHERE starts_with(i.prefix, f.parent || '/')))
        SELECT prefix FROM r UNION ALL SELECT '' WHERE NOT EXISTS (SELECT 1 FROM r)""",
    ),
    "topmost_last_first": (
        topmost_last_first,
        f"""WITH {_TREE}, m AS (SELECT * FROM tree WHERE depth > 1 AND n BETWEEN 2 AND 9)
        SELECT prefix, CAST(row_number() OVER (PARTITION BY split_part(prefix, '/', 1) ORDER BY prefix DESC) AS INT) AS turn FROM m WHERE NOT EXISTS (SELECT 1 FROM m a WHERE starts_with(m.prefix, a.prefix || '/'))""",
    ),
    "mixed_paths": (
        mixed_paths,
        f"""WITH {_TREE}, n AS (SELECT page_id, parts, coalesce(list_min(list_filter(range(1, len(parts) + 1), lambda i: regexp_matches(parts[i], '[0-9]'))) - 1, len(parts)) AS k FROM parts)
        SELECT page_id, array_to_string(parts[1:k], '/') AS stubs, array_to_string(parts[k + 1:], '/') AS children FROM n""",
    ),
    "copied_files": (
        copied_files,
        f"""WITH {_TREE}, h AS (SELECT min(prefix) AS p FROM tree WHERE depth = 2)
        SELECT page_id FROM pre, h WHERE last AND prefix <> p AND NOT starts_with(prefix, p || '/')""",
    ),
    "nearest_ancestor": (
        nearest_ancestor,
        f"""WITH {_TREE}, m AS (SELECT prefix FROM tree WHERE n > 2), l AS (SELECT page_id, prefix FROM pre WHERE last)
        SELECT l.page_id, arg_max(m.prefix, length(m.prefix)) AS ancestor FROM l JOIN m ON starts_with(l.prefix, m.prefix || '/') GROUP BY l.page_id""",
    ),
    "topmost_marked": (
        topmost_marked,
        f"""WITH {_TREE}, m AS (SELECT * FROM tree WHERE depth > 1 AND n BETWEEN 3 AND 6)
        SELECT prefix, n FROM m WHERE NOT EXISTS (SELECT 1 FROM m a WHERE starts_with(m.prefix, a.prefix || '/'))""",
    ),
    "root_propagation": (
        root_propagation,
        f"""WITH {_TREE}, i AS (SELECT prefix FROM tree WHERE depth = 3 AND n = 1),
        f AS (SELECT * FROM tree t WHERE depth >= 2 AND NOT EXISTS (SELECT 1 FROM i WHERE i.prefix = t.prefix OR starts_with(i.prefix, t.prefix || '/') OR starts_with(t.prefix, i.prefix || '/')))
        SELECT prefix FROM f WHERE depth = 2 OR EXISTS (SELECT 1 FROM i WHERE starts_with(i.prefix, f.parent || '/'))""",
    ),
    "outermost_only": (
        outermost_only,
        f"""WITH {_TREE}, m AS (SELECT prefix FROM tree WHERE depth = 3 AND n > 2)
        SELECT page_id FROM pre WHERE last AND NOT EXISTS (SELECT 1 FROM m WHERE starts_with(pre.prefix, m.prefix || '/'))""",
    ),
    "relativize": (relativize, "SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/?', '') AS relative FROM pages"),
}
