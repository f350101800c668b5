"""Directed graphs as vertices (id) and edges (src, dst): src needs dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pareframe.operators.pointers import jumped
from pareframe.sources.tables import fresh


class Rounds:
    """Rows found round by round. Each is rewritten as often as the logarithm of the rounds, not in every round."""

    def __init__(self, first: DataFrame):
        self.parts = [(0, first)]

    def add(self, found: DataFrame) -> None:
        level = 0
        while self.parts and self.parts[-1][0] == level:
            found, level = fresh(self.parts.pop()[1].union(found)), level + 1
        self.parts.append((level, found))

    def all(self) -> DataFrame:
        out = self.parts[0][1]
        for _, part in self.parts[1:]:
            out = out.union(part)
        return out


#: Rounds that go on by single edges; chains are contracted where these don't do.
PLAIN = 6
#: A graph, or what is left of one, with at most so many edges is finished on the driver; pairs that may come of it there.
SMALL, PAIRS = 10_000, 1_000_000


def _rows(like: DataFrame, rows: list[tuple], *columns: tuple[str, str, T.DataType | None]) -> DataFrame:
    """A table of rows; columns by name and either the column of ``like`` whose type they have, or a type."""
    kind = T.StructType([T.StructField(name, of or like.schema[same].dataType) for name, same, of in columns])
    return like.sparkSession.createDataFrame(rows, kind)


def _neighbours(pairs: list[tuple]) -> dict:
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def _links(edges: DataFrame) -> DataFrame:
    return fresh(edges.select("src", "dst").where("src <> dst").distinct())


def _ends(links: DataFrame, name: str = "id") -> DataFrame:
    return links.select(F.explode(F.array("src", "dst")).alias(name)).distinct()


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id): what each root of ``start`` (root, id) reaches along ``edges``, itself included.

    Each round follows the edges of what was found last and drops what is known, so cycles end. What isn't done in PLAIN
    rounds goes on over a contracted graph: an id with one way in is reached when that way's beginning is, so chains of
    such ids count as one step. Rounds grow with the branchings on a path, and with the logarithm of the rest.
    """
    links, front = _links(edges), fresh(start.select("root", "id").distinct())
    if (found := _reach_of_few(front, links)) is not None:
        return found
    seen = Rounds(front)
    front = _spread(seen, front, links, PLAIN)
    if front.isEmpty():
        return seen.all()
    chains, links = _contracted(links, front.select("id").distinct())
    _spread(seen, front, links, None)
    found = seen.all()
    for heads in reversed(chains):
        more = found.withColumnRenamed("id", "head").join(heads, "head").select("root", "id")
        found = fresh(found.union(more).distinct())
    return found


def _reach_of_few(start: DataFrame, links: DataFrame) -> DataFrame | None:
    """``reach`` in a small graph; None where it isn't small, or more than PAIRS come of it."""
    if links.count() > SMALL or start.count() > SMALL:
        return None
    onward, pairs = _neighbours([(r["src"], r["dst"]) for r in links.collect()]), []
    for root, ids in _neighbours([(r["root"], r["id"]) for r in start.collect()]).items():
        known = dict.fromkeys(ids)
        waiting = list(known)
        while waiting:
            for b in onward.get(waiting.pop(), ()):
                if b not in known:
                    known[b] = None
                    waiting.append(b)
        pairs += [(root, i) for i in known]
        if len(pairs) > PAIRS:
            return None
    return _rows(start, pairs, ("root", "root", None), ("id", "id", None))


def _spread(seen: Rounds, front: DataFrame, links: DataFrame, rounds: int | None) -> DataFrame:
    """Adds to ``seen`` what is reached from ``front``, in so many rounds at most; what the last of them has found."""
    while rounds is None or rounds:
        step = front.join(links, front["id"] == links["src"]).select("root", F.col("dst").alias("id")).distinct()
        front = fresh(step.join(seen.all(), ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen.add(front)
        rounds = rounds and rounds - 1
    return front


def _contracted(links: DataFrame, stops: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links between ids that have several ways in or are ``stops``, and (id, head) of the others, contraction by contraction.

    ``head`` is where the chain into an id begins. Contracted again as long as links become half as many: two ways in may
    have become one. Circles without another way in are reached from nowhere and go.
    """
    chains, size = [], links.count()
    while size:
        alone = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.first("src").alias("next")).where("n = 1")
        found = jumped(alone.join(stops, "id", "left_anti"))
        heads = fresh(found.where("NOT open").select("id", F.col("next").alias("head")))
        if heads.isEmpty():
            break
        rest = links.join(found.select(F.col("id").alias("dst")), "dst", "left_anti").join(found.where("open").select(F.col("id").alias("src")), "src", "left_anti")
        moved = rest.join(heads.withColumnRenamed("id", "src"), "src", "left").select(F.coalesce("head", "src").alias("src"), "dst")
        links, before = fresh(moved.where("src <> dst").distinct()), size
        chains.append(heads)
        size = links.count()
        if size * 2 > before:
            break
    return chains, links


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of all that ``start`` (id) reaches, itself included."""
    return reach(start.select(F.lit(0).alias("root"), "id"), edges).select("id")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def cascade(vertices: DataFrame, edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """``vertices`` with ``deleted``: given ones, and whatever needs a deleted one."""
    gone = closure(deleted, reverse(edges)).withColumn("deleted", F.lit(True))
    return vertices.join(gone, "id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that an id reaches and is reached by.

    What can't be on a cycle is trimmed off. Then every id learns its colour, the first id that reaches it in a random
    order, and each id that is its own colour is a pivot: what reaches a pivot within its colour is its component. All
    pivots are searched from at once. What is left goes another round: in a random order half of a sequence of components
    is expected to go each time.
    """
    ids, live, found = fresh(vertices.select("id").distinct()), _links(edges), None
    while True:
        if live.count() <= SMALL:
            one = _rows(ids, _components_of_few([(r["src"], r["dst"]) for r in live.collect()]), ("id", "id", None), ("component", "id", None))
            found = one if found is None else found.union(one)
            break
        live = _trimmed(live)
        if live.isEmpty():
            break
        colour = fresh(_first_that_reaches(_ends(live), live))
        by = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_c"))
        inside = fresh(live.join(by("src"), "src").join(by("dst"), "dst").where("src_c = dst_c").select("src", "dst"))
        pivots = colour.where("id = colour.id").select(F.col("id").alias("root"), "id")
        part = fresh(reach(pivots, reverse(inside)))
        # kept, so that the join with a large component can be split
        least = fresh(part.groupBy("root").agg(F.min("id").alias("component")))
        one = part.join(least, "root").select("id", "component")
        found = one if found is None else found.union(one)
        live = fresh(inside.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if found is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _components_of_few(pairs: list[tuple]) -> list[tuple]:
    """(id, smallest id of its component): ids by when a search leaves them, then searches against the edges, the last first."""
    onward, back = _neighbours(pairs), _neighbours([(b, a) for a, b in pairs])
    left, seen = [], set()
    for first in onward:
        path = [] if first in seen else [(first, iter(onward[first]))]
        seen.add(first)
        while path:
            at, rest = path[-1]
            for b in rest:
                if b not in seen:
                    seen.add(b)
                    path.append((b, iter(onward.get(b, ()))))
                    break
            else:
                left.append(at)
                path.pop()
    out, done = [], set()
    for first in reversed(left):
        if first not in done:
            members = [first]
            done.add(first)
            for a in members:
                for b in back.get(a, ()):
                    if b not in done:
                        done.add(b)
                        members.append(b)
            out += [(i, min(members)) for i in members]
    return out


def _trimmed(links: DataFrame) -> DataFrame:
    """Links without those that no cycle has: what leads to no cycle, or comes from none, is cut off."""
    size = links.count()
    for _ in range(2):
        if not size:
            return links
        onward = links.select(F.col("src").alias("dst")).distinct()
        backward = links.select(F.col("dst").alias("src")).distinct()
        links, before = fresh(links.join(onward, "dst", "left_semi").join(backward, "src", "left_semi").select("src", "dst")), size
        size = links.count()
        if size == before:
            return links
    for turn in (lambda x: x, reverse):
        off = layer_numbers(_ends(links), turn(links))
        links = fresh(links.join(off.select(F.col("id").alias("src")), "src", "left_anti").join(off.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return links


def _first_that_reaches(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, colour): of all ids from which an id is reached, itself included, the first by hash, as (hash, id).

    Colours go along links, round by round. What isn't done in PLAIN rounds goes on between ids with several ways in
    only; one with a single way in has the first colour on the chain up to such an id, or of the circle that it comes from.
    """
    now, settled = _coloured(fresh(ids.select("id", F.struct(F.xxhash64("id").alias("hash"), "id").alias("colour"))), links, PLAIN)
    if settled:
        return now
    alone = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.first("src").alias("next")).where("n = 1")
    chain = jumped(alone.join(now, "id"), {"colour": F.least("colour", "colour2")})
    rest = links.join(chain.select(F.col("id").alias("dst")), "dst", "left_anti")
    ways = fresh(rest.join(chain.select(F.col("id").alias("src"), "next", "open", "colour"), "src", "left"))
    own = ways.where("colour IS NOT NULL").select(F.col("dst").alias("id"), "colour")
    heads = now.join(chain, "id", "left_anti").union(own).groupBy("id").agg(F.min("colour").alias("colour"))
    between = ways.where("NOT coalesce(open, false)").select(F.coalesce("next", "src").alias("src"), "dst").where("src <> dst").distinct()
    heads, _ = _coloured(fresh(heads), fresh(between), None)
    closed = chain.where("NOT open").join(heads.select(F.col("id").alias("next"), F.col("colour").alias("above")), "next")
    return heads.union(closed.select("id", F.least("colour", "above").alias("colour"))).union(chain.where("open").select("id", "colour"))


def _coloured(now: DataFrame, links: DataFrame, rounds: int | None) -> tuple[DataFrame, bool]:
    """Colours after so many rounds, and whether no more can change."""
    while rounds is None or rounds:
        come = now.join(links, now["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
        then = fresh(now.join(come, "id", "left").select("id", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("moved")))
        now = then.select("id", "colour")
        if then.where("moved").isEmpty():
            return now, True
        rounds = rounds and rounds - 1
    return now, False


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges between components; those within one go."""
    by = lambda end: components.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
    both = edges.join(by("src"), "src").join(by("dst"), "dst")
    return both.where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()


def layer_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): 0 for what needs nothing, else one more than the highest layer that it needs. Cycles have none, nor has
    what needs them.

    Each round, what has nothing left that it needs is done. What needs one more id only is a link of a chain: its layer
    is max(floor, length + layer of that id), such steps compose, and a chain of them is one step after pointer jumping.
    What needs a link needs the chain's end instead, so the rounds count branchings, not layers. Chains get their layers
    at the end, the last found first.
    """
    waiting = fresh(vertices.select("id", F.lit(0).alias("floor")).distinct())
    live = fresh(edges.select("src", "dst", F.lit(1).alias("len")).where("src <> dst").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    waiting = fresh(waiting.join(loops, "id", "left_anti"))
    done, chains = None, []
    while True:
        if live.count() <= SMALL:
            few = _layers_of_few(waiting, live)
            done = few if done is None else done.union(few)
            break
        needs = live.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.max(F.struct("dst", "len")).alias("one"))
        state = fresh(waiting.join(needs, "id", "left").select("id", "floor", "n", F.col("one.dst").alias("next"), F.col("one.len").alias("len")))
        counts = state.agg(F.count_if(F.col("n").isNull()).alias("ready"), F.count_if(F.col("n") == 1).alias("single"), F.count("*").alias("all")).first()
        ready = state.where("n IS NULL").select("id", F.col("floor").alias("layer"))
        # links are worth following where they are many, or nothing else is left to do
        follow = counts["single"] and (counts["single"] * 4 >= counts["all"] or not counts["ready"])
        if not counts["ready"] and not follow:
            break
        known = ready
        if follow:
            compose = {"len": F.col("len") + F.col("len2"), "floor": F.greatest("floor", F.col("len") + F.col("floor2"))}
            chain = jumped(state.where("n = 1").select("id", "next", "len", "floor"), compose).where("NOT open")
            layer = F.when(F.col("below").isNotNull(), F.greatest("floor", F.col("len") + F.col("below")))
            chain = fresh(chain.join(ready.select(F.col("id").alias("next"), F.col("layer").alias("below")), "next", "left").withColumn("layer", layer))
            known = ready.union(chain.where("layer IS NOT NULL").select("id", "layer"))
            chains.append(chain.where("layer IS NULL").select("id", "next", "len", "floor"))
        done = known if done is None else done.union(known)
        if counts["ready"] + (counts["single"] if follow else 0) == counts["all"]:
            break
        rest = state.where("n > 1") if follow else state.where("n IS NOT NULL")
        nowhere = F.lit(None).cast(live.schema["dst"].dataType)
        ends = known.select(F.col("id").alias("dst"), nowhere.alias("end"), F.lit(0).alias("more"), F.col("layer").alias("least"))
        if follow:
            ends = ends.union(chains[-1].select(F.col("id").alias("dst"), F.col("next").alias("end"), F.col("len").alias("more"), F.col("floor").alias("least")))
        moved = fresh(live.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(ends, "dst", "left"))
        raised = moved.where("least IS NOT NULL").groupBy(F.col("src").alias("id")).agg(F.max(F.col("len") + F.col("least")).alias("raised"))
        waiting = fresh(rest.select("id", "floor").join(raised, "id", "left").select("id", F.greatest("floor", "raised").alias("floor")))
        left = moved.where("least IS NULL OR end IS NOT NULL").select("src", F.coalesce("end", "dst").alias("dst"), (F.col("len") + F.coalesce("more", F.lit(0))).alias("len"))
        live = fresh(left.groupBy("src", "dst").agg(F.max("len").alias("len")))
    found = vertices.select("id", F.lit(0).alias("layer")).limit(0) if done is None else done
    for chain in reversed(chains):
        if chain.isEmpty():
            continue
        more = chain.join(found.withColumnRenamed("id", "next"), "next").select("id", F.greatest("floor", F.col("len") + F.col("layer")).alias("layer"))
        found = fresh(found.union(more))
    return found


def _layers_of_few(waiting: DataFrame, live: DataFrame) -> DataFrame:
    """(id, layer) of what waits (id, floor), with few edges (src, dst, len) left."""
    ends = _ends(live)
    alone = waiting.join(ends, "id", "left_anti").select("id", F.col("floor").alias("layer"))
    layer = {r["id"]: r["floor"] for r in waiting.join(ends, "id", "left_semi").collect()}
    edges = [(r["src"], r["dst"], r["len"]) for r in live.collect()]
    left, back = dict.fromkeys(layer, 0), _neighbours([(b, (a, size)) for a, b, size in edges])
    for a, _, _ in edges:
        left[a] = left.get(a, 0) + 1
    ready = [i for i in layer if not left[i]]
    for i in ready:
        for a, size in back.get(i, ()):
            if a in layer:
                layer[a] = max(layer[a], layer[i] + size)
                left[a] -= 1
                if not left[a]:
                    ready.append(a)
    return alone.union(_rows(waiting, [(i, layer[i]) for i in ready], ("id", "id", None), ("layer", "", T.IntegerType())))


def depths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): edges on the longest path from a vertex that nothing needs, in a graph without cycles."""
    return layer_numbers(vertices, reverse(edges)).withColumnRenamed("layer", "depth")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in)."""
    count = lambda end, name: edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
    both = vertices.join(count("src", "n_out"), "id", "left").join(count("dst", "n_in"), "id", "left")
    return both.select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def to_dot(edges: DataFrame, limit: int = 2000) -> str:
    """Graphviz text of a graph of at most ``limit`` edges; ``kind``, where there is one, labels edges."""
    rows = edges.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} edges are no picture")
    quote = lambda x: '"' + str(x).replace('"', '\\"') + '"'
    lines = [f"  {quote(r.src)} -> {quote(r.dst)}" + (f" [label={quote(r.kind)}]" if "kind" in edges.columns else "") + ";" for r in rows]
    return "\n".join(["digraph {", *sorted(lines), "}"])
