"""Line dedup across documents: an exact set-similarity join of lines, after which later matches are removed.

A line's set is that of its distinct words (A-Z lower-cased, split at white space). Two lines match when their
sets have a Jaccard similarity of at least 0.75. A line is removed when a line matches it that comes earlier, by
doc_id and then by place in the document; that the earlier one may itself be removed makes no difference. Lines
without words stay.

1. Words, as 64-bit numbers, are ordered by rarity. They are counted over all lines, in SLOTS counters by hash (a fixed
   size); words that share a counter look more frequent than they are, which costs time, not results: any one
   order that all lines share makes the filters exact.
2. Each line sends the words of its prefix to buckets by value, packed. A word that occurs FREQUENT times or more goes with
   each word after it, up to one beyond the prefix: lines that match share two words there, so a list is of lines that have
   both. In a bucket, lines with equal sets become one, and lines that share a word make candidate pairs, cut by
   size, by place of the word, and by a sign of 128 bits that all words of a line set and that must agree but for the
   words that may differ. Lists are sorted by size, so a line looks only at those of a size that can match, and in
   blocks of LISTED. Of its candidates in a block a line keeps the HUBS earliest; of a list stay the lines that have more,
   and what they have beyond those. Lists of several blocks stay whole.
3. The candidates of a line that share most words of its prefix are verified. Lines without a match are then verified
   with those that were left, and with what stays of their lists: there the sets themselves come together, a list in one
   place or in pairs of parts of TOGETHER words, and what comes out is the lines that have a match, not the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pareframe.llm.rows import column, named, numbered
from pareframe.llm.setjoin import DEN, NUM, common, expand, matching, pack, split_by, squeezed, unpack
from pareframe.llm.wordhash import mix, word_groups
from pareframe.sources.tables import keep

SLOTS, BLOCK = 1 << 21, 1 << 14
#: Parts in which the counts of a block are summed first.
PARTS = 64
LISTED, HUBS = 4096, 4
#: Words of the lines of a part of a list whose sets come together, about; and of pairs that are compared in one step.
TOGETHER, VERIFIED = 1 << 19, 1 << 19
#: Candidates of a line that are verified first.
TRIED = 2
#: Words of all lines to a bucket, about.
BUCKET_WORDS = 1 << 22
#: Occurrences of a word from which on it goes with a second one; lines of LONG words or more send it alone, too.
FREQUENT, LONG = 1 << 16, 1 << 10
#: Buckets to a shuffle partition, at least, so that partitions come out even.
SPREAD = 4
#: Pairs that are looked at in one step.
STEP = 1 << 18
#: Bits of the filter that tells which lines are needed for verification: so many to a line, within bounds; in blocks of
#: BLOCK_BITS. Where the upper bound is too small for the lines, more of them are sent than needed.
LINE_BITS, LEAST_BITS, MOST_BITS, BLOCK_BITS = 32, 1 << 20, 1 << 30, 1 << 16
#: Places in which a task remembers lines that it has sent, 16 bytes each.
SENT = 1 << 20
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)
ONE, HALF = np.uint64(1), np.uint64(32)


class Lines:
    """The lines with words of a group of texts. ``word`` has the words of all, from ``begin`` on of each line.

    ``sid`` is made from the words of a line, whatever their order, and so are ``sign`` and ``sign2``, which have a bit for
    each word, of 128. Lines of the same words have the same. Others differ in ``sid`` with odds of 2^64 to 1, and mostly in
    ``sign``, which has no more bits set than the line has words.
    """

    def __init__(self, text: np.ndarray, line: np.ndarray, word: np.ndarray):
        new = np.ones(len(word), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
        at = np.flatnonzero(new)
        self.word, self.begin = word, np.append(at, len(word))
        self.text, self.place = text[at], line[at].astype(np.int32)
        self.sid = mix(np.add.reduceat(mix(word), at) + np.diff(self.begin).astype(np.uint64)).view(np.int64)
        bit, half = ONE << (word >> np.uint64(58)), (word >> np.uint64(57) & ONE).astype(bool)
        self.sign = np.bitwise_or.reduceat(np.where(half, bit, 0), at)
        self.sign2 = np.bitwise_or.reduceat(np.where(half, 0, bit), at)

    def __len__(self) -> int:
        return len(self.sid)

    def order(self, rank: np.ndarray) -> None:
        """Finds the distinct words, by line, rank and then value: ``value`` with their ``line`` and ``rank``; and how many, ``n``."""
        value, rank = self.word, rank[_slot(self.word)]
        owner = np.repeat(np.arange(len(self)), np.diff(self.begin))
        # one number to sort by, of line, rank and as much of the value as has room
        room = 64 - len(self).bit_length()
        key = (owner.astype(np.uint64) << np.uint64(room)) | (rank.astype(np.uint64) << np.uint64(room - 8)) | (value >> np.uint64(72 - room))
        order = np.argsort(key)
        key, in_order = key[order], value[order]
        if np.any((key[1:] == key[:-1]) & (in_order[1:] != in_order[:-1])):
            order = np.lexsort((value, rank, owner))
            in_order = value[order]
        value, owner, rank = in_order, owner[order], rank[order]
        first = np.ones(len(value), dtype=bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.value, self.line, self.rank = value[first], owner[first], rank[first]
        self.n = np.bincount(self.line, minlength=len(self)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def firsts(self, doc: np.ndarray) -> np.ndarray:
        """The first of lines of the same words."""
        by = np.lexsort((self.place, doc, self.sign, self.sid))
        sid, sign = self.sid[by], self.sign[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = (sid[1:] != sid[:-1]) | (sign[1:] != sign[:-1])
        return np.sort(by[new])


def _groups(batch: pa.RecordBatch):
    """Lines of groups of a batch of (doc, th, text), with doc and th of each line."""
    doc, th = (batch.columns[i].to_numpy(zero_copy_only=False) for i in (0, 1))
    for text, line, value in word_groups(batch.columns[2]):
        if len(value):
            lines = Lines(text, line, value)
            yield lines, doc[lines.text], th[lines.text]


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")


def _arrow(columns: list, kinds: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def _slot(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(SLOTS - 1)).astype(np.int64)


def _rarity(source: DataFrame) -> tuple:
    """How frequent words are by slot, eighths of the logarithm of their number, sent to all executors; and words of all lines."""

    def count(batches):
        seen, waiting, n = np.zeros(SLOTS, dtype=np.uint32), [], 0
        for batch in batches:
            for _, _, value in word_groups(batch.columns[0]):
                waiting.append(_slot(value))
                n += len(value)
                if n >= SLOTS // 4:
                    seen += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.uint32)
                    waiting, n = [], 0
        if n:
            seen += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.uint32)
        blocks = [b for b in range(SLOTS // BLOCK) if seen[b * BLOCK : (b + 1) * BLOCK].any()]
        part = [TaskContext.get().partitionId() % PARTS] * len(blocks)
        yield _arrow([blocks, part, [pack(seen[b * BLOCK : (b + 1) * BLOCK].astype(np.uint64)) for b in blocks]], [pa.int64()] * 2 + [pa.binary()], "block part counts")

    def totals(batches) -> dict[int, np.ndarray]:
        # at most SLOTS counters, however many rows come
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[b] = total.get(b, 0) + unpack(c, np.uint64)
        return total

    def add(batches):
        total = totals(batches)
        yield _arrow([list(total), [pack(t) for t in total.values()]], [pa.int64(), pa.binary()], "block counts")

    def finish(batches):
        total = totals(batches)
        logs = [np.minimum(255, 8 * np.log2(t.astype(np.float64) + 1)).astype(np.uint8).tobytes() for t in total.values()]
        yield _arrow([list(total), logs, [int(t.sum()) for t in total.values()]], [pa.int64(), pa.binary(), pa.int64()], "block logs words")

    counted = source.select("text").mapInArrow(count, "block long, part long, counts binary")
    # in two steps, so that no task reads what all others have counted
    summed = counted.repartition("block", "part").mapInArrow(add, "block long, counts binary").repartition("block")
    rank, words = np.zeros(SLOTS, dtype=np.uint8), 0
    # SLOTS / BLOCK rows of BLOCK bytes at most
    for r in summed.mapInArrow(finish, "block long, logs binary, words long").collect():
        rank[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.logs, np.uint8)
        words += r.words
    return source.sparkSession.sparkContext.broadcast(rank), words


#: A word of a prefix within its bucket, and where a set is first. Fields with a type are packed as they are.
POSTING = (
    ("token", np.uint64), ("sid", np.int64), ("sign", np.uint64), ("sign2", np.uint64), ("doc", None), ("place", None), ("n", None), ("at", None),
)
PLACE = (("sid", np.int64), ("sign", np.uint64), ("doc", None), ("th", np.int64), ("place", None))
FIELDS = ("token", "sid", "sign", "sign2", "doc", "th", "place", "n", "at")


def _keys(lines: Lines, speaks: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, line, at): what the lines that speak have lists by, words or pairs of words, and the place from which on words can be shared.

    Lines that match have a word of their prefixes in common; the first such is at ``at``, or, of a pair, the second is after it.
    From LONG words on, lines send single words; smaller ones send pairs, and so do those that may match a smaller one.
    """
    at = np.arange(len(lines.value)) - lines.start[lines.line]
    n = lines.n[lines.line]
    last = n - -(-NUM * n // DEN)
    early = (at <= last) & speaks[lines.line]
    often = lines.rank >= 8 * np.log2(frequent)
    one = np.flatnonzero(early & (~often | (n >= LONG)))
    first = np.flatnonzero(early & often & (NUM * n < DEN * LONG))
    # a line of one word matches only its like
    many = (np.minimum(last + 1, n - 1) - at)[first]
    first, step = np.repeat(first, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    second = first + 1 + step
    token = np.concatenate([lines.value[one], mix(lines.value[first] ^ mix(lines.value[second]))])
    return token, lines.line[np.concatenate([one, first])], np.concatenate([at[one], at[second] - 1])


def _sent(source: DataFrame, rarity, buckets: int, frequent: int) -> DataFrame:
    """By bucket, packed: the prefix words of lines; and, in buckets under 0, where lines are."""

    def packed(bucket: np.ndarray, columns: dict, fields) -> list[dict]:
        if len(bucket) and np.any(bucket[1:] < bucket[:-1]):
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], {name: columns[name][order] for name, _ in fields}
        parts = {name: (b"", columns[name]) if kind else squeezed(columns[name]) for name, kind in fields}
        return [{"bucket": b} | {name: head + values[s].tobytes() for name, (head, values) in parts.items()} for b, s in split_by(bucket)]

    def task(batches):
        rank = rarity.value
        schema = pa.schema([("bucket", pa.int64()), *((name, pa.binary()) for name in FIELDS)])
        for batch in batches:
            for lines, doc, th in _groups(batch):
                lines.order(rank)
                use = lines.firsts(doc)
                where = -1 - (lines.sid[use].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                rows = packed(where, dict(sid=lines.sid[use], sign=lines.sign[use], doc=doc[use], th=th[use], place=lines.place[use]), PLACE)
                speaks = np.zeros(len(lines), dtype=bool)
                speaks[use] = True
                token, line, at = _keys(lines, speaks, frequent)
                order = np.argsort(token)
                token, line, at = token[order], line[order], at[order]
                bucket = ((token >> HALF) * np.uint64(buckets) >> HALF).astype(np.int64)
                columns = {name: getattr(lines, name)[line] for name in ("sid", "sign", "sign2", "place", "n")}
                columns |= dict(token=token, doc=doc[line], at=at)
                yield pa.RecordBatch.from_pylist(rows + packed(bucket, columns, POSTING), schema=schema)

    return source.mapInArrow(task, "bucket long, " + ", ".join(f"{name} binary" for name in FIELDS))


def _near(n1, at1, n2, at2, signs) -> np.ndarray:
    """As setjoin.may_match, for arrays; and the signs must agree but for words that one line may lack."""
    needed = -(-NUM * (n1 + n2) // (NUM + DEN))
    fits = (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & (np.minimum(n1 - at1, n2 - at2) >= needed)
    for s, other, lacks in ((0, 1, n1 - needed), (1, 0, n2 - needed)):
        fits &= sum(np.bitwise_count(x[s] & ~x[other]).astype(np.int64) for x in signs) <= lacks
    return fits


ID = ("sid", "sign")
OUT = ("a", "a2", "b", "b2", "token", "sid", "sign", "sign2", "doc", "th", "place", "n", "at", "open")
#: Entries of a row that _candidates gives.
ENTRIES = 4096


def _rows(n: int, columns: dict) -> pa.Table:
    """Entries as arrays, ENTRIES to a row; columns that these don't have are null."""
    cuts = np.append(np.arange(0, n, ENTRIES), n).astype(np.int32)
    make = lambda x: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)))
    return pa.table({name: make(columns[name]) if name in columns else pa.nulls(len(cuts) - 1, pa.list_(pa.int64())) for name in OUT})


def _entries(found: DataFrame, *names: str) -> DataFrame:
    """One row for each entry of the kind that has a column of the first name."""
    zipped = found.where(F.col(names[0]).isNotNull()).select(F.explode(F.arrays_zip(*names)).alias("x"))
    return zipped.select(*(F.col("x")[name].alias(name) for name in names))


def _first_places(columns: dict) -> pa.Table:
    """Where each set of a bucket is first."""
    order = np.lexsort((columns["th"], columns["place"], columns["doc"], columns["sign"], columns["sid"]))
    columns = {k: v[order] for k, v in columns.items()}
    first = np.ones(len(order), dtype=bool)
    first[1:] = (columns["sid"][1:] != columns["sid"][:-1]) | (columns["sign"][1:] != columns["sign"][:-1])
    return _rows(int(first.sum()), {k: v[first] for k, v in columns.items()})


def _lists(columns: dict) -> tuple[dict, np.ndarray]:
    """Entries by token and size, without later copies of a set in a list; and when each comes, as one number."""
    doc = np.unique(columns["doc"], return_inverse=True)[1].astype(np.int64)
    columns["when"] = (doc << 32) | columns["place"]
    order = np.lexsort((columns["when"], columns["sid"], columns["token"]))
    columns = {k: v[order] for k, v in columns.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([columns[k][1:] != columns[k][:-1] for k in ("token", "sid", "sign")], axis=0)
    columns = {k: v[new] for k, v in columns.items()}
    number = np.cumsum(np.concatenate([[False], columns["token"][1:] != columns["token"][:-1]])) if new.any() else np.zeros(0, np.int64)
    order = np.argsort((number << 32) | columns["n"], kind="stable")
    return {k: v[order] for k, v in columns.items()}, number[order]


def _pairs(block: np.ndarray, n: np.ndarray, at: np.ndarray, signs: list):
    """(x, y, z) for entries by block and size: x and y of a block that may match, x no larger; the x of later steps are z or more."""
    size = len(n)
    # in a block, after each entry come those of no smaller size; the last that can match
    by_size = (np.cumsum(np.concatenate([[False], block[1:] != block[:-1]])) << 32) | n
    last = np.searchsorted(by_size, (by_size >> 32 << 32) | np.minimum(DEN * n // NUM, (1 << 32) - 1), "right")
    # the smaller set needs most of its words from the shared one on
    can = n - at >= -(-2 * NUM * n // (NUM + DEN))
    ahead = np.where(can, last - np.arange(size) - 1, 0)
    work = np.cumsum(ahead)
    low = 0
    while low < size:
        # entries that have STEP pairs, or one
        upto = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + STEP, "right")))
        mine = ahead[low:upto]
        x = np.repeat(np.arange(low, upto), mine)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(mine) - mine, mine)
        ok = _near(n[x], at[x], n[y], at[y], [(s[x], s[y]) for s in signs])
        yield x[ok], y[ok], upto
        low = upto


def _candidates(table: pa.Table, listed: int, hubs: int) -> pa.Table:
    """One bucket: where sets are first; or pairs (a, b), b the earlier line, and what is to be looked at more in lists."""
    rows = table.to_pylist()
    fields = PLACE if rows[0]["bucket"] < 0 else POSTING
    columns = {name: np.concatenate([np.frombuffer(r[name], kind) if kind else expand(r[name]) for r in rows]) for name, kind in fields}
    if rows[0]["bucket"] < 0:
        return _first_places(columns)
    columns, number = _lists(columns)
    sid, sign, sign2, when = (columns[k] for k in ("sid", "sign", "sign2", "when"))
    n, at = columns["n"].astype(np.int64), columns["at"].astype(np.int64)
    size = len(n)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    length = np.diff(np.append(starts, size))
    inside = np.arange(size) - np.repeat(starts, length)
    block = (number << 32) | (inside // listed)
    # lists that are not looked at as a whole here
    more = np.repeat(length > listed, length)
    needed = more.copy()
    begin = np.append(np.maximum.accumulate(np.where(np.concatenate([[True], block[1:] != block[:-1]]), np.arange(size), 0)), size)
    pairs, a, b = [np.zeros((2, 0), dtype=np.int64)], *np.zeros((2, 0), dtype=np.int64)
    for x, y, upto in _pairs(block, n, at, [sign, sign2]):
        later = (when[x] > when[y]) | ((when[x] == when[y]) & (sid[x] > sid[y]))
        a, b = np.concatenate([a, np.where(later, x, y)]), np.concatenate([b, np.where(later, y, x)])
        order = np.lexsort((when[b], a))
        a, b = a[order], b[order]
        beyond = np.arange(len(a)) - np.searchsorted(a, a) >= hubs
        more[a[beyond]] = needed[a[beyond]] = needed[b[beyond]] = True
        a, b = a[~beyond], b[~beyond]
        # a block that goes on may have earlier ones
        ended = a < begin[upto]
        pairs.append(np.stack([a[ended], b[ended]]))
        a, b = a[~ended], b[~ended]
    a, b = np.concatenate(pairs, axis=1)
    left = {name: columns[name][needed] for name in ("token", "sid", "sign", "sign2", "doc", "place", "n", "at")} | {"open": more[needed]}
    return pa.concat_tables([_rows(len(a), {"a": sid[a], "a2": sign[a], "b": sid[b], "b2": sign[b]}), _rows(int(needed.sum()), left)])


def _matched(table: pa.Table) -> pa.Table:
    """Lines of a list, or of two parts of it, that an earlier one there matches, of those that are open."""
    table = table.combine_chunks().sort_by("n")
    sid, doc, place, n, at, part = (table[k].to_numpy() for k in ("sid", "doc", "place", "n", "at", "part"))
    signs = [table[k].to_numpy().view(np.uint64) for k in ("sign", "sign2")]
    tokens = table["tokens"].combine_chunks()
    when = np.empty(len(n), dtype=np.int64)
    when[np.lexsort((sid, place, doc))] = np.arange(len(n))
    is_open, apart = table["open"].to_numpy() == 1, table["p"][0].as_py() != table["q"][0].as_py()
    found = np.zeros(len(n), dtype=bool)
    for x, y, _ in _pairs(np.zeros(len(n), dtype=np.int64), n, at, signs):
        later = when[x] > when[y]
        a, b = np.where(later, x, y), np.where(later, y, x)
        use = is_open[a] & ~found[a]
        if apart:
            use &= part[a] != part[b]
        a, b = a[use], b[use]
        order = np.lexsort((when[b], a))
        a, b = a[order], b[order]
        # the earliest of each line, then twice as many, as long as there is no match
        turn, upto = np.arange(len(a)) - np.searchsorted(a, a), 1
        while len(a):
            now = np.flatnonzero(turn < upto)
            words, low = np.cumsum(n[a[now]] + n[b[now]]), 0
            while low < len(now):
                end = max(low + 1, int(np.searchsorted(words, (words[low - 1] if low else 0) + VERIFIED, "right")))
                i, j = a[now[low:end]], b[now[low:end]]
                low = end
                shared = common(tokens.take(pa.array(i)), tokens.take(pa.array(j)))
                found[i[DEN * shared >= NUM * (n[i] + n[j] - shared)]] = True
            rest = (turn >= upto) & ~found[a]
            a, b, turn, upto = a[rest], b[rest], turn[rest], 2 * upto
    return pa.table({"sid": pa.array(sid[found]), "sign": pa.array(signs[0][found].view(np.int64))})


def _filter_of(ids: DataFrame):
    """A bit for each of the lines ``ids`` (sid), by the low bits of its number, sent to all executors: MOST_BITS at most."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (LINE_BITS * ids.count()).bit_length()))
    bits = ids.select(F.col("sid").bitwiseAND(size - 1).alias("bit")).distinct()

    def block(table: pa.Table) -> pa.Table:
        bits = table["bit"].to_numpy()
        out = np.zeros(BLOCK_BITS, dtype=np.uint8)
        out[bits % BLOCK_BITS] = 1
        return pa.table({"block": pa.array([int(bits[0]) // BLOCK_BITS], pa.int64()), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    blocks = bits.groupBy(F.floor(F.col("bit") / BLOCK_BITS).alias("g")).applyInArrow(block, "block long, bits binary")
    table = np.zeros(size // 8, dtype=np.uint8)
    # size / BLOCK_BITS rows of BLOCK_BITS bits at most, one after another
    for r in blocks.toLocalIterator():
        table[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(table)


class Sent:
    """The line that was sent last from each of ``size`` places, a power of two; 16 bytes each, however many lines come.

    A line has its place by its number. One that has lost its own to another is taken for new again, never the other
    way round.
    """

    def __init__(self, size: int):
        # at first, lines that have another place
        self.sid, self.sign = np.arange(1, size + 1, dtype=np.int64), np.zeros(size, dtype=np.uint64)

    def new(self, sid: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Where lines are that haven't been sent, each once; they count as sent then."""
        by = np.lexsort((sign, sid))
        first = np.ones(len(by), dtype=bool)
        first[1:] = (sid[by][1:] != sid[by][:-1]) | (sign[by][1:] != sign[by][:-1])
        at = by[first]
        place = sid[at] & (len(self.sid) - 1)
        unsent = (self.sid[place] != sid[at]) | (self.sign[place] != sign[at])
        at = at[unsent]
        # of several lines with one place, the same one in both arrays
        place, one = np.unique(place[unsent], return_index=True)
        self.sid[place], self.sign[place] = sid[at[one]], sign[at[one]]
        return at


def _sets(source: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, sign, n, tokens) of the lines ``ids`` (sid), and of a few others."""
    wanted = _filter_of(ids)

    def task(batches):
        bits = wanted.value
        sent = Sent(SENT)
        for batch in batches:
            for lines, _, _ in _groups(batch):
                bit = lines.sid & (8 * len(bits) - 1)
                at = np.flatnonzero(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                at = at[sent.new(lines.sid[at], lines.sign[at])]
                tokens = [np.unique(lines.word[lines.begin[i] : lines.begin[i + 1]]) for i in at]
                columns = [lines.sid[at], lines.sign[at].view(np.int64), [len(t) for t in tokens], [t.tobytes() for t in tokens]]
                yield _arrow(columns, [pa.int64()] * 3 + [pa.binary()], "sid sign n tokens")

    found = source.mapInArrow(task, "sid long, sign long, n long, tokens binary")
    return found.join(ids, list(ID), "left_semi").dropDuplicates(list(ID))


def _found(source: DataFrame, rarity, words: int, listed: int, hubs: int, frequent: int) -> DataFrame:
    """Entries of three kinds: first places (th), candidate pairs (a), lists with more to look at (token)."""
    buckets = max(SPREAD * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // BUCKET_WORDS)
    sent = _sent(source, rarity, buckets, frequent)
    return keep(sent.groupBy("bucket").applyInArrow(lambda table: _candidates(table, listed, hubs), ", ".join(f"{name} array<long>" for name in OUT)))


PAIR = ("a", "a2", "b", "b2")


def _repeated(source: DataFrame, found: DataFrame, together: int) -> DataFrame:
    """(sid, sign) of the distinct lines that an earlier, different line matches."""
    voted = _entries(found, *PAIR).groupBy(*PAIR).count()
    best = Window.partitionBy("a", "a2").orderBy(F.desc("count"), "b", "b2")
    ranked = keep(voted.select(*PAIR, F.row_number().over(best).alias("turn")))
    gone = _verified(source, ranked.where(F.col("turn") <= TRIED).select(*PAIR))
    left = keep(ranked.where(F.col("turn") > TRIED).join(gone.toDF("a", "a2"), ["a", "a2"], "left_anti").select(*PAIR))
    # of lists, those with lines that are still open
    listed = keep(_entries(found, "token", *ID, "sign2", "doc", "place", "n", "at", "open"))
    ended = gone.withColumn("ended", F.lit(True))
    listed = listed.join(ended, list(ID), "left").withColumn("open", F.when(F.col("ended"), 0).otherwise(F.col("open"))).drop("ended")
    listed = keep(listed.join(listed.where("open = 1").select("token").distinct(), "token", "left_semi"))
    ends = [left.select(F.col(x).alias("sid"), F.col(f"{x}2").alias("sign")) for x in "ab"]
    ids = keep(ends[0].union(ends[1]).union(listed.select(*ID)).distinct())
    if ids.isEmpty():
        return gone
    sets = keep(_sets(source, ids))
    more = [matching(left, sets, ID).select(F.col("a").alias("sid"), F.col("a2").alias("sign")), _matched_in_lists(listed, sets, together)]
    return keep(gone.union(more[0]).union(more[1]).distinct())


def _matched_in_lists(listed: DataFrame, sets: DataFrame, together: int) -> DataFrame:
    """(sid, sign) of the open lines of ``listed`` that an earlier line of the same list matches.

    Lists whose lines have more than ``together`` words are dealt over parts, and each two parts meet once, so that what comes
    together is about twice as many at most.
    """
    parts = listed.groupBy("token").agg(F.ceil(F.sum("n") / together).alias("parts"))
    dealt = listed.join(parts, "token").withColumn("part", F.pmod("sid", "parts"))
    dealt = dealt.join(sets.select(*ID, "tokens"), list(ID)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    return dealt.groupBy("token", "p", "q").applyInArrow(_matched, "sid long, sign long")


def _verified(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, sign) of the lines a of ``pairs`` that match their b."""
    ends = [pairs.select(F.col(x).alias("sid"), F.col(f"{x}2").alias("sign")) for x in "ab"]
    sets = keep(_sets(source, keep(ends[0].union(ends[1]).distinct())))
    return keep(matching(pairs, sets, ID).select(F.col("a").alias("sid"), F.col("a2").alias("sign")).distinct())


def _changed(documents: DataFrame, listed: int, hubs: int, together: int, frequent: int) -> DataFrame:
    """The documents with numbered columns (rows.numbered), text and n_chars as they become, n_lines, n_removed, and n_stay,
    the lines with words that stay."""
    source = _source(documents)
    rarity, words = _rarity(source)
    found = _found(source, rarity, words, listed, hubs, frequent)
    stay = _entries(found, "th", "sid", "sign", "doc", "place").join(_repeated(source, found, together), list(ID), "left_anti")
    lists = stay.groupBy("doc", "th").agg(F.collect_list(F.col("place").cast("int")).alias("stay"))
    text, size = (documents.columns.index(c) if c in documents.columns else None for c in ("text", "n_chars"))
    keys = {"doc": F.coalesce(F.col(column(documents, "doc_id")).cast("long"), F.lit(NO_ID)), "th": F.xxhash64(f"c{text}")}
    joined = numbered(documents).withColumns(keys).join(lists, ["doc", "th"], "left").drop("doc", "th")
    joined = joined.withColumn("lines", F.split(f"c{text}", "\n", -1))
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~F.get("lines", i).rlike(r"[^\x09-\x0D\x20]"))
    joined = joined.withColumn("left", F.array_sort(F.concat(F.coalesce("stay", F.array().cast("array<int>")), blank)))
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    counts = {"n_lines": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")), "n_removed": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("left"))}
    counts["n_stay"] = F.coalesce(F.size("stay"), F.lit(0))
    changed = joined.withColumns({k: v.cast("long") for k, v in counts.items()}).withColumn(f"c{text}", kept)
    if size is not None:
        changed = changed.withColumn(f"c{size}", F.coalesce(F.char_length(f"c{text}"), F.lit(0)).cast(documents.schema[size].dataType))
    return changed.drop("stay", "lines", "left")


def dedup_lines(documents: DataFrame, listed: int = LISTED, hubs: int = HUBS, together: int = TOGETHER, frequent: int = FREQUENT) -> DataFrame:
    """``documents`` with ``text`` made of the lines that stay, and n_lines, n_removed (lines before, removed).

    Null texts stay null and have no lines; an empty text has one line, without words. Null ids come before all
    others. Rows with the same doc_id and text are one document: the same lines stay in each. Columns named n_lines
    or n_removed are replaced; a column n_chars, where there is one, gets the new length; all others stay, whatever
    their names. An empty table gives no rows. Lines are told apart by 128 bits made from their sets.
    """
    return named(_changed(documents, listed, hubs, together, frequent), documents.columns, ["n_lines", "n_removed"])


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with what lines stay, with their columns; those of which no line with words stays are left out.

    A document that had no line with words to begin with stays as it is. Otherwise as ``dedup_lines``, but that
    columns named n_lines or n_removed stay, too.
    """
    return named(_changed(documents, LISTED, HUBS, TOGETHER, FREQUENT).where("n_removed = 0 OR n_stay > 0"), documents.columns)
