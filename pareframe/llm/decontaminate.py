"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in document texts.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. All
windows of one length make one pattern set. Its block table gives, for each pair of adjacent words, how far the
search may move on without missing a pattern; where the distance is zero, the suffix bucket of that pair lists the
patterns that may end there, and a direct comparison of all words confirms them.

The benchmark is read in blocks of about ``BLOCK_ROWS`` items or ``BLOCK_BYTES`` of text, each of which is searched in
all documents. The patterns of all blocks are sent out before the searches run, so executors that run several blocks hold
several. Every document is compared with every block, whatever their
number; of several blocks only what is found is kept and put together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.llm.rows import add_columns, column, map_texts, named, numbered

WINDOW = 10
BLOCK_ROWS, BLOCK_BYTES = 5000, 8 << 20

#: Bytes of UTF-8 text that are no word characters become spaces; A-Z become a-z. Bytes over 0x7F stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WuManber:
    """Patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int], length: int):
        self.length, self.block = length, min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern, name in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end - 1)
                self.shift[key] = min(self.shift.get(key, self.furthest), length - end)
            self.bucket[self.key(pattern, length - 1)].append((pattern, name))

    def key(self, row, last: int):
        return (row[last - 1], row[last]) if self.block == 2 else row[last]

    def find(self, row: list[bytes]):
        """(start, name) of every occurrence."""
        at, n, shift, furthest = self.length - 1, len(row), self.shift, self.furthest
        two = self.block == 2
        while at < n:
            key = (row[at - 1], row[at]) if two else row[at]
            move = shift.get(key, furthest)
            if move:
                at += move
                continue
            start = at - self.length + 1
            for pattern, name in self.bucket.get(key, ()):
                if row[start] == pattern[0] and tuple(row[start : at + 1]) == pattern:
                    yield start, name
            at += 1


def matchers(items: list[tuple[object, str | None]], window: int) -> tuple[list[WuManber], list[list[str]]]:
    """Matchers by length, and the item ids that have each window. Items with a null id count, but aren't listed."""
    by_length: dict[int, dict[tuple[bytes, ...], int]] = defaultdict(dict)
    owners: list[set[str]] = []
    for item, text in items:
        row = words(text)
        size = min(window, len(row))
        for i in range(len(row) - size + 1 if size else 0):
            name = by_length[size].setdefault(tuple(row[i : i + size]), len(owners))
            if name == len(owners):
                owners.append(set())
            if item is not None:
                owners[name].add(str(item))
    return [WuManber(patterns, size) for size, patterns in sorted(by_length.items())], [sorted(x) for x in owners]


def search(row: list[bytes], found_by: list[WuManber], owners: list[list[str]]) -> tuple[list[int], set[str]]:
    """Covered word positions as merged [start, end) pairs, flattened; item ids."""
    spans, items = [], set()
    for matcher in found_by:
        for start, name in matcher.find(row):
            spans.append((start, start + matcher.length))
            items.update(owners[name])
    return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Spans in order, those that touch as one, flattened."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _blocks(benchmark: DataFrame, rows: int) -> list[DataFrame]:
    """The benchmark in blocks of about ``rows`` items, or BLOCK_BYTES of text."""
    n, size = (x or 0 for x in benchmark.agg(F.count("*"), F.sum(F.octet_length("text"))).first())
    many = max(-(-n // rows), -(-size // BLOCK_BYTES))
    if many <= 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == i) for i in range(many)]


FOUND = "n_words long, hits array<int>, items array<string>"


def _searched(documents: DataFrame, benchmark: DataFrame, window: int, block_rows: int) -> DataFrame:
    """The documents with numbered columns (rows.numbered), and FOUND."""
    blocks = _blocks(benchmark.select("item_id", "text"), block_rows)
    context, docs, text = documents.sparkSession.sparkContext, numbered(documents), column(documents, "text")
    searches = []
    for block in blocks:
        # bounded by BLOCK_ROWS and BLOCK_BYTES, about
        shared = context.broadcast([(r.item_id, r.text) for r in block.toLocalIterator()])

        def make(shared=shared):
            found_by, owners = matchers(shared.value, window)

            def run(batch) -> list:
                counts, spans, names = [], [], []
                for t in batch["text"].to_pylist():
                    row = words(t)
                    hits, items = search(row, found_by, owners)
                    counts.append(len(row))
                    spans.append(hits)
                    names.append(sorted(items))
                return [counts, spans, names]

            return run

        searches.append(make)
    if len(searches) == 1:
        return add_columns(docs, {"text": text}, searches[0], FOUND)
    # equal texts have equal hits
    texts = docs.select(F.xxhash64(text).alias("th"), F.sha2(text, 256).alias("sha"), F.col(text).alias("text")).where("text IS NOT NULL")
    parts = [add_columns(texts, {"text": "text"}, make, FOUND).where(F.size("hits") > 0).select("th", "sha", "hits", "items") for make in searches]
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    both = both.distinct().groupBy("th", "sha").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge():
        def run(rows: list[dict]) -> list[dict]:
            for r in rows:
                r["hits"] = merged(zip(r["hits"][::2], r["hits"][1::2], strict=True))
            return rows

        return run

    both = map_texts(both, merge, "th long, sha string, hits array<int>, items array<string>")

    def count():
        return lambda batch: [[len(words(t)) for t in batch["text"].to_pylist()]]

    docs = docs.withColumns({"th": F.xxhash64(text), "sha": F.sha2(text, 256)}).join(both, ["th", "sha"], "left").drop("th", "sha")
    none = {"hits": F.coalesce("hits", F.array().cast("array<int>")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return add_columns(docs.withColumns(none), {"text": text}, count, "n_words long")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``documents`` with (n_words, hits, items): word count, covered word positions, ids of items found.

    ``hits`` has merged [start, end) pairs of word positions. All columns of ``documents`` stay, whatever their names,
    but ones named as the three new ones are replaced. Null and empty texts have no words and no hits; so has
    everything when the benchmark is empty. Repeated rows are handled row by row; repeated item ids count once.
    """
    return named(_searched(documents, benchmark, window, block_rows), documents.columns, ["n_words", "hits", "items"])


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Null and empty texts have no words; repeated rows and null ids stay, row by row; other columns are not used, and
    an empty table gives no rows.
    """
    found = contamination(documents.select("doc_id", "text"), benchmark, window).drop("text")
    covered = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "items",
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, with their columns, whatever these are called.

    Documents without words, null or empty, stay; so do all where the benchmark is empty. Repeated rows stay or go
    together.
    """
    return named(_searched(documents, benchmark, window, BLOCK_ROWS).where(F.size("hits") == 0), documents.columns)
