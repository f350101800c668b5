"""A Merkle manifest of a table, and the climb from every leaf to the root by a recursive query.

Each row is a leaf. The leaves of a source, in order of doc_id, are hashed in runs of 16 consecutive nodes until one is
left, the subroot; the subroots, in order of their sources, are hashed in the same way to the root. ``build`` stores the
levels as node rows that name their parent and hold the digests of the siblings before and after them. ``climb`` is a
recursive query over these rows: in each step every leaf's digest is folded with the siblings of the node it has
reached, the siblings are appended, and the row goes on to that node's parent.

The up to 16 leaves of a run have all siblings above the run in common. They ascend in one row, each folded by itself,
so the siblings of the upper levels are carried once a run. Digests are hashed as hex text, as the manifest is defined,
but kept and carried as bytes, half as long. A node that many runs pass is stored in as many copies as
it takes for PASSING runs each, so no join has a hot key. Leaves are ranked within their source by a sort over all
rows; no source is ever in one task.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pareframe.llm.exact import lower_ascii
from pareframe.operators.search import numbered
from pareframe.sources.tables import keep

#: Consecutive nodes whose digests make their parent's.
RUN = 16
#: Runs of leaves that share a copy of a node on their way up.
PASSING = 16
#: The tree of the subroots, and the end of a climb; trees of sources have numbers from 0.
TOP, DONE = -1, -2
LIMIT = "spark.sql.cteRecursionRowLimit"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
REPORT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: a row for each run of leaves, see ``_starts``; ``nodes``: what a climb joins, see ``build``."""

    leaves: DataFrame
    nodes: DataFrame
    root: str


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """The hex text of an array of digests."""
    return F.array_join(F.transform(digests, _hex), "")


def leaf_digest(*values: Column) -> Column:
    """H of the values: each ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    texts = (v.cast("string") for v in values)
    return _sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def tampered_leaves(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf, folded: ``folded`` is the leaf of the lower-cased text where 5 divides crc32(doc_id), else null."""
    values = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    folded = F.when(hit, leaf_digest(*values[:-1], lower_ascii(F.col("text"))))
    return documents.select("doc_id", "source", leaf_digest(*values).alias("leaf"), folded.alias("folded"))


def _ranked(leaves: DataFrame) -> DataFrame:
    """tree, pos, n, doc_id, leaf, folded: ``tree`` numbers sources in order, ``pos`` the ``n`` leaves of one.

    Rows are sorted by ranges; what is summed is a row for each source in each range. Equal rows are told apart by where
    they stand, so that copies of one row spread over ranges too.
    """
    found = keep(leaves.withColumn("rid", F.monotonically_increasing_id()))
    ordered = keep(found.orderBy("source", "doc_id", "leaf", "rid").drop("rid").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    spans = ordered.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("source")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = keep(
        spans.select(
            F.col("part").alias("p"), F.col("source").alias("s"), "first", F.min("first").over(whole).alias("tree"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"),
        )
    )
    same = (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))
    return ordered.join(spans, same).select("tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", "doc_id", "leaf", "folded")


def _levels(state: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, and the last node of each tree: (tree, digest).

    ``state`` has tree, pos, n (nodes of the tree on this level) and digest. A run has tree, level, run, n, and ``nodes``,
    its structs of pos and digest in order. Trees of one node don't rise.
    """
    levels, done = [], [state.where("n = 1").select("tree", "digest")]
    level = 0
    while most > 1:
        nodes = F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("nodes")
        runs = state.where("n > 1").groupBy("tree", F.floor(F.col("pos") / RUN).alias("run")).agg(F.first("n").alias("n"), nodes)
        runs = keep(runs.select("tree", F.lit(level).alias("level"), "run", "n", "nodes"))
        levels.append(runs)
        fewer = F.ceil(F.col("n") / RUN)
        state = runs.select("tree", F.col("run").alias("pos"), fewer.alias("n"), _sha(_joined(F.col("nodes.digest"))).alias("digest"))
        done.append(state.where("n = 1").select("tree", "digest"))
        most, level = -(-most // RUN), level + 1
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    return levels, keep(ends)


def _node_rows(runs: DataFrame, level: int) -> DataFrame:
    """The nodes of a level's runs, each with its siblings, the next node up, and the runs of leaves below."""
    each = F.posexplode("nodes").alias("i", "node")
    rows = runs.select("tree", "level", "run", "n", "nodes", each)
    digests = F.col("nodes.digest")
    return rows.select(
        "tree", "level", F.col("node.pos").alias("pos"), F.col("node.digest").alias("digest"), "run", "n",
        F.unhex(_joined(F.slice(digests, F.lit(1), F.col("i")))).alias("before"),
        F.unhex(_joined(F.slice(digests, F.col("i") + 2, F.lit(RUN)))).alias("after"),
        F.lit(max(1, RUN ** max(0, level - 1) // PASSING)).cast("long").alias("copies"),
    )


def build(leaves: DataFrame) -> Manifest | None:
    """The manifest of ``leaves`` (doc_id, source, leaf, folded: null where the leaf itself climbs); None for an empty table.

    Null sources are first, then sources bytewise. Null doc_ids are first in their source. Rows with the same doc_id
    are ordered by their digests. ``nodes`` has a row for each copy of a node above the leaves, keyed by (tree, level,
    pos, salt): before, after (digests of its siblings, joined), up_tree (DONE where that is the root), up_level, up_pos,
    up_copies, subroot (where the next node is one). Everything kept here is digests, some 100 bytes a row.
    """
    ranked = keep(_ranked(leaves))
    size = ranked.agg(F.max("n").alias("n")).first()["n"]
    if size is None:
        return None
    spark = leaves.sparkSession
    levels, ends = _levels(ranked.select("tree", "pos", "n", F.col("leaf").alias("digest")), size)
    tops = keep(numbered(ends, "tree"))
    sources = tops.count()
    above = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("idx").alias("pos"), F.lit(sources).cast("long").alias("n"), "digest")
    upper, last = _levels(above, sources)
    root = last.first()["digest"].hex()
    beyond = TOP if sources > 1 else DONE

    # A subroot stands for itself on the lowest level of the top tree, where all leaves of its source may pass.
    passing = ranked.where(F.col("pos") % RUN == 0).groupBy("tree").agg(F.max("n").alias("n"))
    runs_below = F.ceil(F.col("n") / RUN)
    subroots = keep(tops.join(passing, "tree").select(F.col("tree").alias("sub"), F.col("digest").alias("subroot"), "idx", F.greatest(F.lit(1), F.ceil(runs_below / PASSING)).alias("sub_copies")))
    link = "tree long, level int, pos long, digest binary, before binary, after binary, copies long, up_tree long, up_level int, up_pos long, subroot binary"
    nodes = spark.createDataFrame([], link)
    order = nodes.columns
    # the climb begins above the first runs, so the leaves need no rows of their own
    for level, runs in enumerate(levels[1:], 1):
        rows = _node_rows(runs, level).join(subroots, F.col("tree") == F.col("sub"))
        ends_here = F.col("n") <= RUN
        up = {
            "up_tree": F.when(ends_here, F.lit(beyond)).otherwise(F.col("tree")), "up_level": F.when(ends_here, 0).otherwise(F.col("level") + 1),
            "up_pos": F.when(ends_here, F.col("idx")).otherwise(F.col("run")), "subroot": F.when(ends_here, F.col("subroot")),
        }
        nodes = nodes.union(rows.withColumns(up).select(order))
    for level, runs in enumerate(upper):
        rows = _node_rows(runs, level).withColumn("subroot", F.lit(None).cast("binary"))
        if level == 0:
            rows = rows.drop("copies").join(subroots.select(F.col("idx").alias("i"), F.col("sub_copies").alias("copies")), F.col("pos") == F.col("i"))
        else:
            # the runs of leaves below are not known for each node here; all of them at most, dealt evenly
            below = subroots.groupBy(F.floor(F.col("idx") / RUN**level).alias("i")).agg(F.sum("sub_copies").alias("copies"))
            rows = rows.drop("copies").join(below, F.col("pos") == F.col("i"))
        stop = F.col("n") <= RUN
        up = {"up_tree": F.when(stop, F.lit(DONE)).otherwise(F.col("tree")), "up_level": F.col("level") + 1, "up_pos": F.col("run")}
        nodes = nodes.union(rows.withColumns(up).select(order))
    nodes = keep(nodes)
    over = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), F.col("copies").alias("up_copies"))
    linked = nodes.join(over, ["up_tree", "up_level", "up_pos"], "left").withColumn("up_copies", F.coalesce("up_copies", F.lit(1)))
    salted = linked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = subroots.select(F.col("sub"), F.col("idx"), F.col("sub_copies"), F.col("subroot"))
    return Manifest(_starts(ranked, start, beyond), keep(salted), root)


def _starts(ranked: DataFrame, start: DataFrame, beyond: int) -> DataFrame:
    """A row for each run of leaves, folded once: rid, tree, level, pos, salt, leaves, folded, siblings (none yet), subroot."""
    leaf = F.struct("pos", "doc_id", "leaf", "folded")
    runs = ranked.groupBy("tree", F.floor(F.col("pos") / RUN).alias("run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(leaf)).alias("leaves"))
    runs = keep(runs.withColumn("rid", F.monotonically_increasing_id()))
    digests = F.col("leaves.leaf")

    def fold(x: Column, i: Column) -> Column:
        before, after = F.slice(digests, F.lit(1), i), F.slice(digests, i + 2, F.lit(RUN))
        own = F.coalesce(x["folded"], x["leaf"])
        return F.when(F.col("n") == 1, own).otherwise(_sha(F.concat(_joined(before), _hex(own), _joined(after))))

    alone = F.col("n") <= RUN  # the run is all there is of its source: its parent, or the only leaf, is the subroot
    small = runs.where(alone).join(start, F.col("tree") == F.col("sub"))
    small = small.select(
        "rid", "n", "leaves", F.lit(beyond).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("idx").alias("pos"), (F.col("rid") % F.col("sub_copies")).alias("salt"), "subroot"
    )
    large = runs.where(~alone).select("rid", "n", "leaves", "tree", F.lit(1).alias("level"), F.col("run").alias("pos"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast("binary").alias("subroot"))
    # a node of level 1 is above one run, and so in one copy
    both = small.union(large)
    return both.select("rid", "tree", "level", "pos", "salt", F.transform("leaves", lambda x: x.dropFields("pos", "folded")).alias("leaves"), F.transform("leaves", fold).alias("folded"), F.unhex(F.lit("")).alias("siblings"), "subroot")


@contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    """Recursion over as many rows as there are; the limit is read when the query runs."""
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(LIMIT, before)


CLIMB = """
WITH RECURSIVE climb(rid, tree, level, pos, salt, folded, siblings, subroot) AS (
    SELECT rid, tree, level, pos, salt, folded, siblings, subroot FROM {starts}
    UNION ALL
    SELECT c.rid, n.up_tree, n.up_level, n.up_pos, c.rid % n.up_copies,
        transform(c.folded, x -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(x)), lower(hex(n.after))), 256))),
        concat(c.siblings, n.before, n.after), coalesce(c.subroot, n.subroot)
    FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos AND c.salt = n.salt
)
SELECT rid, folded, siblings, subroot FROM climb WHERE tree = {done}
"""


def climb(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each leaf of the manifest with its proof."""
    spark = manifest.nodes.sparkSession
    with _any_number_of_rows(spark):
        arrived = keep(spark.sql(CLIMB, starts=manifest.leaves, nodes=manifest.nodes.drop("digest", "copies"), done=DONE))
    rows = arrived.join(manifest.leaves.select("rid", "leaves"), "rid")
    rows = rows.select(_joined(F.col("leaves.leaf")).alias("run"), _hex(F.col("siblings")).alias("siblings"), _hex(F.col("subroot")).alias("subroot"), "folded", F.posexplode("leaves").alias("i", "own"))
    width = len(hashlib.sha256().hexdigest())
    others = F.concat(F.substring("run", F.lit(1), F.col("i") * width), F.expr(f"substring(run, (i + 1) * {width} + 1)"))
    root = F.lit(manifest.root)
    folded = _hex(F.get("folded", F.col("i")))
    return rows.select(
        F.col("own.doc_id").alias("doc_id"), _hex(F.col("own.leaf")).alias("leaf"), "subroot", root.alias("root"), F.sha2(F.concat(others, F.col("siblings")), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == root).alias("verified"),
    )


def manifest_report(documents: DataFrame) -> DataFrame:
    """One row per document: its leaf, its source's subroot, the root, its proof, and what tampering does to the root.

    Tampered are rows where 5 divides crc32(doc_id): their text is lower-cased, A-Z only. Rows with a null doc_id aren't
    tampered with, and null texts stay null. Any column may be null, a null source is a source of its own, repeated rows are
    leaves of their own, a source may have one leaf, and the table one source; an empty table gives no rows. Other columns
    are not used. A text is hashed whole by the task that reads it and goes no further.
    """
    found = build(tampered_leaves(documents.select(*FIELDS)))
    if found is None:
        kind = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL(REPORT)])
        return documents.sparkSession.createDataFrame([], kind)
    return climb(found)


def oracle() -> str:
    """The report in DuckDB's SQL: levels by a recursive query over runs, then a climb from each leaf by another."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, [*FIELDS[:-1], text])) + ")"
    return f"""WITH RECURSIVE
        crc(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
        steps AS (SELECT list(c ORDER BY b) AS s FROM crc WHERE k = 8),
        ids AS (SELECT DISTINCT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS digits FROM documents WHERE doc_id IS NOT NULL),
        hit AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, digits), lambda a, x: xor(a >> 8, s[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM ids, steps),
        d AS (SELECT doc_id, coalesce(source, '') AS source, source IS NOT NULL AS named, {leaf("text")} AS leaf, {leaf(f"translate(text, '{upper}', '{lower}')")} AS low FROM documents),
        l AS (SELECT d.*, dense_rank() OVER (ORDER BY named, source) AS tree, row_number() OVER (PARTITION BY named, source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY named, source) AS n, CASE WHEN hit THEN low ELSE leaf END AS start FROM d LEFT JOIN hit USING (doc_id)),
        low(tree, lvl, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM l
            UNION ALL SELECT tree, lvl + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, lvl, n, pos // {RUN}),
        sub AS (SELECT tree, h AS subroot, lvl AS last FROM low WHERE n = 1),
        top(lvl, pos, n, h) AS (SELECT 0, tree - 1, count(*) OVER (), subroot FROM sub
            UNION ALL SELECT lvl + 1, pos // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // {RUN}),
        nodes AS (SELECT tree, lvl, pos, n, h FROM low WHERE n > 1 UNION ALL SELECT 0, lvl, pos, n, h FROM top WHERE n > 1),
        sib AS (SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM nodes WINDOW w AS (PARTITION BY tree, lvl, pos // {RUN} ORDER BY pos)),
        up(doc_id, leaf, own, tree, lvl, pos, h, proof, done) AS (SELECT doc_id, leaf, tree, CASE WHEN n = 1 THEN 0 ELSE tree END, 0, CASE WHEN n = 1 THEN tree - 1 ELSE pos END, start, '', false FROM l
            UNION ALL SELECT u.doc_id, u.leaf, u.own, CASE WHEN s.n <= {RUN} THEN 0 ELSE u.tree END, CASE WHEN s.n <= {RUN} AND u.tree > 0 THEN 0 ELSE u.lvl + 1 END,
                CASE WHEN s.n <= {RUN} THEN u.own - 1 ELSE u.pos // {RUN} END, sha256(s.before || u.h || s.after), u.proof || s.before || s.after, s.n <= {RUN} AND u.tree = 0
                FROM up u JOIN sib s ON s.tree = u.tree AND s.lvl = u.lvl AND s.pos = u.pos WHERE NOT u.done),
        root AS (SELECT h AS root FROM top WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
        FROM up JOIN sub ON sub.tree = up.own, root WHERE done OR (up.tree = 0 AND (SELECT count(*) FROM sub) = 1)"""
