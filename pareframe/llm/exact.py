"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of ``block`` characters. The distinct blocks are sorted within their partitions and
numbered, which gives each an integer name of its own. Then adjacent names are paired, the distinct pairs are
sorted and numbered in turn, and so on until one name is left of each text: texts have the same name on the same
level exactly when all their blocks are the same.

Block contents are shuffled once, distinct ones only. Occurrences find the name of their block by its SHA-256.
That is proven for the data at hand: should two different blocks share a digest, the names are looked up by the
blocks themselves instead.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pareframe.sources.tables import keep

BLOCK = 4096


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else. Where a text is all ASCII, the plain function does the same, faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _digest(block: Column) -> Column:
    return F.sha2(block, 256)


def _itself(block: Column) -> Column:
    return block


def _level_zero(texts: DataFrame, rows: DataFrame, key) -> DataFrame | None:
    """(rid, names) of all rows, or None when two blocks have the same key."""
    blocks = texts.select(F.explode("blocks").alias("block")).select(key(F.col("block")).alias("key"), "block")
    names = keep(blocks.distinct().sortWithinPartitions("block").select("key", F.monotonically_increasing_id().alias("name")))
    if key is not _itself and not names.groupBy("key").count().where("count > 1").isEmpty():
        return None
    return _arrays(rows.select("rid", F.posexplode("keys").alias("pos", "key")).join(names, "key"))


def _arrays(named: DataFrame) -> DataFrame:
    """(rid, pos, name) to (rid, names in order)."""
    return named.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("p")).select("rid", F.col("p.name").alias("names"))


def name_texts(documents: DataFrame, block: int = BLOCK, keys=(_digest, _itself)) -> DataFrame:
    """A row for each of ``documents``: rid, doc_id, text_sha256, level, name.

    ``level`` and ``name`` are the same for two rows exactly when their texts are, after lower-casing A-Z. ``rid``
    tells repeated rows apart. ``keys`` are the ways to look names up, tried in turn; the last must be exact.
    """
    whole = lower_ascii(F.coalesce("text", F.lit("")))
    texts = documents.select("doc_id", whole.alias("whole"))
    cut = F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    texts = texts.withColumn("blocks", F.when(F.char_length("whole") <= block, F.array("whole")).otherwise(cut))
    for key in keys:
        rows = keep(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("whole", 256).alias("text_sha256"), F.transform("blocks", key).alias("keys")))
        if (found := _level_zero(texts, rows, key)) is not None:
            break
    else:
        raise ValueError("no key tells all blocks apart")
    state, level, done = keep(found), 0, []
    while True:
        done.append(state.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = state.where(F.size("names") > 1)
        if rest.isEmpty():
            break
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("l"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("r"))
        halves = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), pair)
        pairs = rest.select("rid", F.posexplode(halves).alias("pos", "lr")).select("rid", "pos", "lr.l", "lr.r")
        # kept, so that a pair which many texts have can be split in the join
        names = keep(pairs.select("l", "r").distinct().sortWithinPartitions("l", "r").withColumn("name", F.monotonically_increasing_id()))
        state, level = keep(_arrays(pairs.join(names, ["l", "r"]))), level + 1
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return named.join(rows.drop("keys"), "rid")


def exact_duplicates(documents: DataFrame, block: int = BLOCK, keys=(_digest, _itself)) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of several with that doc_id, one (the SQL, for tables whose ids
    differ, calls all of them kept). Null texts count as
    empty, and all empty texts are equal. A null doc_id is smaller than any other; where a group has no other,
    keep_id is null. An empty table gives no rows. Other columns are not used.
    """
    named = keep(name_texts(documents, block, keys))
    # kept, so that the join reads it straight from a shuffle and a large group can be split there
    groups = keep(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256"
    )
