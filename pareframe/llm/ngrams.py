"""N-gram Jaccard join of documents, as a grouped prefix join.

A document's set is that of its distinct 5-word shingles, as 64-bit numbers. Steps:

1. ``measure``: set size and a 128-bit key of the whole set, for each document; equal sets are one from here on.
2. ``ranked_sets``: how many sets have each shingle. Batches of documents send their shingles to buckets by value,
   packed; buckets count them exactly and send back those that are in two sets or more, nine in ten being in one
   only. Shingles in a thousandth of all documents are found beforehand, stay where they are, and count as most
   frequent. So each batch knows the order of its documents' shingles, rare ones first. Only sets that have a
   shared shingle in their prefix can have a match; the others end here.
3. ``link``: sets of the same size and prefix form a group. Groups that share a prefix token make candidate pairs,
   cut by size, by place of the token and by a sign of 256 bits that all shared shingles of a set set; members of the
   pairs left are verified. As components are what is asked for, sets go to a few hubs each first, in rounds: those
   with the fewest rare shingles before the token, as these can match most others. Then whatever is still in different
   components is compared pair by pair, so no link between components is missed while pairs inside a component are
   never listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pareframe.llm.rows import column, named, numbered
from pareframe.llm.setjoin import DEN, NUM, matching, may_match, pack, prefix_size, split_by, unpack
from pareframe.llm.wordhash import mix, word_groups
from pareframe.operators.components import connected_components
from pareframe.sources.tables import keep

WORDS = 5
#: A shingle in one of so many documents is looked for as a hot one. With an average of s shingles in a document
#: there can be HOT * s of them.
HOT, MOST_HOT = 1000, 1 << 20
#: Rounds in which sets are compared with hubs only: one in the first, up to TRIED each in the later ones.
ROUNDS, TRIED = 3, 8
#: Numbers that hold the sign of a set.
SIGNS = ("s0", "s1", "s2", "s3")
#: Buckets to a shuffle partition; documents that send their shingles together.
SPREAD, PIECE = 8, 2048
#: Shingles that a bucket counts, about, where there are so many that SPREAD doesn't do.
BUCKET_SHINGLES = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _rolled(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` words from each of the places ``at`` on."""
    value = np.full(len(at), size, dtype=np.uint64)
    for i in range(size):
        value = (value ^ words[at + i]) * MIX
        value ^= value >> np.uint64(29)
    return mix(value)


def _shingled(text: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a group of texts, sorted in each, and whose they are. ``text`` says so of the words."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = np.diff(np.append(first, len(text)))
    places = [np.flatnonzero(text[: 1 - WORDS] == text[WORDS - 1 :]) if len(text) >= WORDS else np.zeros(0, np.int64)]
    places += [first[count == size] for size in range(1, WORDS)]
    value = np.concatenate([_rolled(words, at, size) for at, size in zip(places, [WORDS, *range(1, WORDS)], strict=True)])
    owner = text[np.concatenate(places)] - text[0]
    # one number to sort by, of the text and as much of the value as has room
    room = np.uint64(64 - int(owner.max() + 1).bit_length())
    sort_key = (owner.astype(np.uint64) << room) | (value >> (np.uint64(64) - room))
    order = np.argsort(sort_key)
    sort_key, value, owner = sort_key[order], value[order], owner[order]
    if np.any((sort_key[1:] == sort_key[:-1]) & (value[1:] != value[:-1])):
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    return value[new], owner[new] + text[0]


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text: distinct shingles as sorted numbers; with fewer words, the whole sequence as one; else none."""
    none = np.zeros(0, dtype=np.uint64)
    out = [none] * len(texts)
    for text, _, words in word_groups(texts):
        if len(words):
            value, owner = _shingled(text, words)
            for i, s in split_by(owner):
                out[i] = value[s]
    return out


def key_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sign_of(values: np.ndarray) -> list[int]:
    """A bit for each number, of 64 * len(SIGNS)."""
    bits = np.zeros(len(SIGNS), dtype=np.uint64)
    np.bitwise_or.at(bits, (values & np.uint64(len(SIGNS) - 1)).astype(np.int64), np.uint64(1) << (values >> np.uint64(8) & np.uint64(63)))
    return bits.view(np.int64).tolist()


def measure(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, th, n, key) of all documents, and rows (hash, seen) of shingles that a batch has often."""

    def task(batches):
        for batch in (b.slice(start, 2 * PIECE) for b in batches for start in range(0, b.num_rows, 2 * PIECE)):
            sets = sets_of(batch.columns[-1])
            keys = [key_of(s) for s in sets]
            distinct = list(dict(zip(keys, sets, strict=True)).values())
            value, seen = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = seen >= max(2, len(distinct) * 2 // HOT)
            value, seen = value[often].view(np.int64), seen[often]
            docs, hot = len(sets), len(value)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.concat_arrays([c.cast(pa.int64()), pa.nulls(hot, pa.int64())]) for c in batch.columns[:2]),
                    pa.array([len(s) for s in sets] + [None] * hot, pa.int64()),
                    pa.array(keys + [None] * hot, pa.binary()),
                    pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(value, pa.int64())]),
                    pa.concat_arrays([pa.nulls(docs, pa.int64()), pa.array(seen, pa.int64())]),
                ],
                names=["doc_id", "th", "n", "key", "hash", "seen"],
            )

    given = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return given.mapInArrow(task, "doc_id long, th long, n long, key binary, hash long, seen long")


def _sent(documents: DataFrame, hot, buckets: int) -> DataFrame:
    """What batches send: shingles by bucket, and to themselves a table of their sets with the hot shingles."""

    def task(batches):
        known = hot.value
        part = TaskContext.get().partitionId()
        pieces = (batch.slice(start, PIECE) for batch in batches for start in range(0, batch.num_rows, PIECE))
        for at, batch in enumerate(pieces):
            # the same on a second run, as rows are sorted
            number = part << 32 | at
            found = {key_of(values): values for values in sets_of(batch.columns[-1]) if len(values)}
            sizes = np.array([len(v) for v in found.values()], dtype=np.int32)
            value = np.concatenate([*found.values(), np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            common = np.isin(value, known)
            rows = [(-1 - number, number, pack(value[common]), pack(owner[common]), b"".join(found), sizes.tobytes())]
            value, owner = value[~common], owner[~common]
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            # value * buckets / 2**64, near enough and the same everywhere
            bucket = ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            rows += [(b, number, pack(value[s]), pack(owner[s]), None, None) for b, s in split_by(bucket)]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "hashes", "owners", "keys", "sizes"])

    kind = "bucket long, batch long, hashes binary, owners binary, keys binary, sizes binary"
    return documents.select("doc_id", "text").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(task, kind)


def _counted(table: pa.Table) -> pa.Table:
    """One bucket: back to each batch go its shingles that are in several sets, with the number of sets."""
    rows = table.to_pylist()
    if rows[0]["bucket"] < 0:
        often = [np.full(len(unpack(r["owners"], np.uint32)), np.iinfo(np.int32).max, dtype=np.int32).tobytes() for r in rows]
        return table.drop_columns(["bucket"]).append_column("counts", pa.array(often, pa.binary()))
    parts = [(unpack(r["hashes"], np.uint64), unpack(r["owners"], np.uint32)) for r in rows]
    value = np.concatenate([v for v, _ in parts])
    _, place, seen = np.unique(value, return_inverse=True, return_counts=True)
    seen, at, out = seen[place].astype(np.int32), 0, []
    for r, (v, owner) in zip(rows, parts, strict=True):
        n = seen[at : at + len(v)]
        at += len(v)
        if (shared := n > 1).any():
            out.append((r["batch"], pack(v[shared]), pack(owner[shared]), None, None, n[shared].tobytes()))
    kinds = (pa.int64(), *[pa.binary()] * 5)
    columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
    return pa.Table.from_arrays(columns, names=["batch", "hashes", "owners", "keys", "sizes", "counts"])


def _ordered(table: pa.Table) -> pa.Table:
    """One batch: the sets that have a shared shingle in their prefix, with their shingles in order."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["keys"] is not None)
    sizes = np.frombuffer(head["sizes"], np.int32)
    value = np.concatenate([unpack(r["hashes"], np.uint64) for r in rows])
    owner = np.concatenate([unpack(r["owners"], np.uint32) for r in rows]).astype(np.int64)
    count = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows])
    order = np.lexsort((value, count, owner))
    value, owner = value[order], owner[order]
    out = []
    for i, s in split_by(owner):
        mine, n = value[s], int(sizes[i])
        alone = n - len(mine)
        if (shared := prefix_size(n) - alone) > 0:
            prefix = mine[:shared]
            group = hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little") + alone.to_bytes(8, "little"), digest_size=16).digest()
            out.append((head["keys"][16 * i : 16 * i + 16], n, alone, group, prefix.view(np.int64).tolist(), np.sort(mine).tobytes(), *sign_of(mine)))
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * len(SIGNS))
    columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
    return pa.Table.from_arrays(columns, names=["key", "n", "alone", "grp", "prefix", "tokens", *SIGNS])


def ranked_sets(documents: DataFrame, measured: DataFrame) -> DataFrame:
    """The distinct sets that may have a match: sid, key, n, alone, grp, prefix, tokens, and SIGNS of the tokens.

    ``alone`` shingles are in no other set and come first in the order; ``prefix`` has the others of the prefix, and
    ``tokens`` all others.
    """
    spark = documents.sparkSession
    total, shingles = measured.where("hash IS NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = measured.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("seen").alias("seen")).where(F.col("seen") * HOT >= total)
    # the most frequent MOST_HOT; those beyond, if any, are counted like all others
    hot = hot.orderBy(F.desc("seen"), "hash").limit(MOST_HOT)
    known = np.sort(np.array([r.hash for r in hot.select("hash").toLocalIterator()], dtype=np.int64).view(np.uint64))
    buckets = max(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // BUCKET_SHINGLES)
    sent = _sent(documents, spark.sparkContext.broadcast(known), buckets)
    counted = sent.groupBy("bucket").applyInArrow(_counted, "batch long, hashes binary, owners binary, keys binary, sizes binary, counts binary")
    ordered = counted.groupBy("batch").applyInArrow(_ordered, "key binary, n long, alone long, grp binary, prefix array<long>, tokens binary, " + ", ".join(f"{s} long" for s in SIGNS))
    # equal sets come from several batches, with the same columns
    return keep(ordered.dropDuplicates(["key"]).withColumn("sid", F.monotonically_increasing_id()))


def _components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, comp) of all ``ids``."""
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "sid")
    return keep(ids.join(found, "sid", "left").select("sid", F.coalesce("component", "sid").alias("comp")))


def _lacks(x: str, y: str):
    """At least so many shingles of x does y lack: the lone ones, and those whose bits it hasn't got.

    A side may be a group: ``s`` has the bits that all its sets have, ``any`` those that one of them has.
    """
    c = lambda t, k: F.col(f"{t}.{k}")
    return sum((F.bit_count(c(x, k).bitwiseAND(F.bitwise_not(c(y, f"any_{k}")))) for k in SIGNS), c(x, "alone"))


def _agree(x: str, y: str):
    """Whether the signs allow a match: each may lack as many shingles of the other as the sizes say."""
    c = lambda t, k: F.col(f"{t}.{k}")
    needed = F.ceil(NUM * (c(x, "n") + c(y, "n")) / (NUM + DEN))
    return (_lacks(x, y) <= c(x, "n") - needed) & (_lacks(y, x) <= c(y, "n") - needed)


def link(sets: DataFrame) -> DataFrame:
    """(sid, comp): the components of the sets under matching."""
    size = sets.count()
    # dealt by sid once, for all verifications
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = sets.select("sid", "n", "tokens").repartition(parts, "sid").persist()
    groups = sets.groupBy("grp").agg(F.min("sid").alias("gid"))
    members = keep(sets.select("sid", "grp", "n", "alone", *SIGNS).join(groups, "grp").drop("grp"), size)
    signed = members.groupBy("gid").agg(
        F.first("n").alias("n"), F.first("alone").alias("alone"), *(F.bit_and(s).alias(s) for s in SIGNS), *(F.bit_or(s).alias(f"any_{s}") for s in SIGNS)
    )
    signed = keep(signed, size)
    heads = sets.select(F.col("sid").alias("gid"), "n", "alone", "prefix").join(signed.select("gid"), "gid", "left_semi")
    all_tokens = heads.select("gid", "n", "alone", F.posexplode("prefix").alias("i", "token"))
    postings = all_tokens.select("gid", (F.col("alone") + F.col("i")).alias("at"), "token")
    several = postings.groupBy("token").count().where("count > 1").select("token")
    postings = keep(postings.join(several, "token"))
    inside = members.where("sid <> gid").select(F.col("sid").alias("a"), F.col("gid").alias("b"))
    links = keep(matching(inside, heavy), size)
    comps = _components(members.select("sid"), links)
    apart = lambda x, y: (F.col(f"{x}.lo") != F.col(f"{y}.lo")) | (F.col(f"{x}.hi") != F.col(f"{y}.hi")) | (F.col(f"{x}.lo") != F.col(f"{x}.hi"))
    fits = lambda x, y: may_match(F.col(f"{x}.n"), F.col(f"{x}.at"), F.col(f"{y}.n"), F.col(f"{y}.at")) & _agree(x, y)

    def spread_over(comps: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Components by group; postings with them; tokens that are in several components, with a hub."""
        spread = signed.join(members.join(comps, "sid").groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "gid")
        labelled = postings.join(spread, "gid")
        # the one with the fewest rare shingles before the token at first, then another for each token
        by = F.col("at") if turn == 0 else F.xxhash64("gid", "token", F.lit(turn))
        hub = F.min(F.struct(by.alias("by"), F.xxhash64("gid").alias("h"), *labelled.drop("token").columns)).alias("hub")
        mixed = labelled.groupBy("token").agg(hub, F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h")
        return spread, labelled, mixed

    for turn in range(ROUNDS):
        _, labelled, mixed = spread_over(comps, turn)
        near = labelled.alias("x").join(mixed.select("token", "hub"), "token").where((F.col("x.gid") != F.col("hub.gid")) & apart("x", "hub") & fits("x", "hub"))
        near = near.select(F.col("x.gid").alias("a"), F.col("hub.gid").alias("b"), (_lacks("x", "hub") + _lacks("hub", "x")).alias("lacks")).distinct()
        # as many entries as a group has tokens, at most
        best = near.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("lacks", "b"))), 1, TRIED if turn else 1).alias("v"))
        best = best.select("a", F.explode("v.b").alias("b"))
        found = keep(matching(best, heavy), TRIED * size)
        if not found.isEmpty():
            links = links.union(found)
            comps = _components(members.select("sid"), links)
    spread, labelled, mixed = spread_over(comps, ROUNDS)
    # a pair comes from the first token that its groups share, and only from that
    begins = heads.select("gid", "prefix")
    rest = labelled.join(mixed.select("token"), "token").join(begins, "gid")
    rest = rest.withColumn("before", F.slice("prefix", F.lit(1), (F.col("at") - F.col("alone")).cast("int"))).drop("prefix")
    first = ~F.arrays_overlap("x.before", "y.before")
    groups_near = rest.alias("x").join(rest.alias("y"), "token").where((F.col("x.gid") < F.col("y.gid")) & apart("x", "y") & fits("x", "y") & first)
    group_pairs = groups_near.select(F.col("x.gid").alias("g1"), F.col("y.gid").alias("g2"))
    split = spread.where("lo <> hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    labels = members.join(comps, "sid").select("*", *(F.col(s).alias(f"any_{s}") for s in SIGNS))
    one, two = labels.withColumnRenamed("gid", "g1").alias("x"), labels.withColumnRenamed("gid", "g2").alias("y")
    differ = (F.col("x.comp") != F.col("y.comp")) & ((F.col("g1") != F.col("g2")) | (F.col("x.sid") < F.col("y.sid"))) & _agree("x", "y")
    pairs = group_pairs.union(split).join(one, "g1").join(two, "g2").where(differ)
    more = keep(matching(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")), heavy))
    heavy.unpersist()
    return comps if more.isEmpty() else _components(members.select("sid"), links.union(more))


def _labelled(documents: DataFrame) -> DataFrame:
    """(doc_id, th, n, comp, component_id) of every row; comp tells components with words apart, null ids or not."""
    measured = keep(measure(documents))
    docs = measured.where("hash IS NULL").select("doc_id", "th", "n", "key")
    sets = ranked_sets(documents, measured)
    comps = link(sets).join(sets.select("sid", "key"), "sid").select("key", "comp")
    whole = comps.groupBy("comp").agg(F.min("key").alias("least"))
    # a set that can't have a match is a component of its own
    names = comps.join(whole, "comp").select("key", "least")
    full = docs.where("n > 0").join(names, "key", "left").withColumn("comp", F.coalesce("least", "key"))
    first = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(first, "comp").select("doc_id", "th", "n", "comp", "component_id")
    return linked.union(docs.where("n = 0").select("doc_id", "th", "n", F.lit(None).cast("binary"), "doc_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that is reachable by links, the document's own included. Equal sets are
    linked; documents without words (null and empty ones too) are linked with nothing. Repeated rows stay. A null
    doc_id is never the smallest; a component of such rows only has none. Columns but doc_id and text are not used.
    """
    return _labelled(documents).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Null ids come after all others. Of rows with the same doc_id, the one whose text has the smallest hash; of rows
    with the same text, too, any one. Documents without words are linked with nothing and all stay.
    """
    names = documents.columns
    missing, number = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    labelled = keep(_labelled(documents).where("comp IS NOT NULL").select(missing.alias("missing"), number.alias("number"), "th", "comp"))
    by = ["missing", "number", "th"]
    several = labelled.groupBy("comp").agg(F.min(F.struct(*by)).alias("stays"), F.count("*").alias("rows")).where("rows > 1")
    marked = labelled.join(several, "comp").select(*by, (F.struct(*by) == F.col("stays")).alias("stays"))
    # rows that are repeated as a whole: all have the same mark
    marked = marked.groupBy(*by).agg(F.first("stays").alias("stays"), F.count("*").alias("rows"))
    own = F.col(column(documents, "doc_id"))
    keyed = numbered(documents).withColumns({"missing": own.isNull(), "number": F.coalesce(own.cast("long"), F.lit(0)), "th": F.xxhash64(column(documents, "text"))})
    left = keyed.join(marked, by, "left").where("stays IS NULL OR stays")
    turn = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy(*by).orderBy("rows"))).otherwise(1)
    return named(left.withColumn("turn", turn).where("turn = 1"), names)
