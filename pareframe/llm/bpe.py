"""BPE encoding through a lexicon of frequent words, compiled to a minimal acyclic transducer.

The words of all documents are counted; the most frequent ones are encoded once and compiled to an acyclic automaton in
which words share their suffixes as well as their prefixes. Its arcs have whole-number outputs whose sum along a word is
the word's place in a table of ids. The compiled file goes to the shared folder and from there to every executor, where
the Python workers map it into memory. All distinct words of a batch walk the automaton together, a byte at a time. Words
that it doesn't have are merged by the ranks of the vocabulary, exactly; what the lexicon holds only decides how fast
a word is encoded.

Tokenizers of the ``tokenizers`` library are meant whose words never hold white space: a BPE model on bytes, normalised
character by character, with a pattern that drops what stands between words. So what stands between two ASCII white-space
characters is split into words by itself, and a batch does so once for each such string. The library normalises it and
proves, character by character, that the pattern means the same here; a string with a character for which that isn't so is
split by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pareframe.llm.rows import add_columns, column, named, numbered
from pareframe.sources.tables import keep, shared_folder

#: Words of the lexicon, and bytes of the longest: the file has some MB at most. Rarer words are merged.
LEXICON, LONGEST = 1 << 16, 64
#: Rows whose texts are split together; an Arrow batch has at most spark.sql.execution.arrow.maxBytesPerBatch (64 MB).
ROWS = 4096
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: Words of up to so many bytes are merged together, so many words at a time; longer ones one by one.
TOGETHER, MANY = (8, 16, 32), 16_384
#: No pair has this rank.
NEVER = 1 << 30


def byte_alphabet() -> list[str]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


# The lexicon


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0


def _minimal(words: list[bytes]) -> _State:
    """The minimal automaton of sorted, distinct words: a state is looked up by its arcs once nothing is added below it."""
    root, known, path, before = _State(), {}, [], b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, state = path.pop()
            key = (state.final, tuple((a, s.number) for a, s in state.arcs.items()))
            if key not in known:
                state.number = len(known) + 1
                state.words = state.final + sum(s.words for s in state.arcs.values())
                known[key] = state
            parent.arcs[label] = known[key]

    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        settle(same)
        state = path[-1][2] if path else root
        for label in word[same:]:
            below = state.arcs[label] = _State()
            path.append((state, label, below))
            state = below
        state.final, before = True, word
    settle(0)
    root.number = 0
    return root


def compile_lexicon(words: dict[bytes, Sequence[int]]) -> bytes:
    """The file of a lexicon: sizes, then the arrays that ``Lexicon`` maps."""
    order = sorted(words)
    root = _minimal(order)
    states, waiting = {0: root}, [root]
    while waiting:
        for below in waiting.pop().arcs.values():
            if below.number not in states:
                states[below.number] = below
                waiting.append(below)
    keys, targets, outputs = [], [], []
    for number in sorted(states):
        state = states[number]
        passed = int(state.final)
        for label, below in state.arcs.items():
            keys.append(number << 8 | label)
            targets.append(below.number)
            outputs.append(passed)
            passed += below.words
    finals = np.zeros(max(states) + 1, "<u8")
    for number, state in states.items():
        finals[number] = state.final
    ids = [words[w] for w in order]
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [np.array(a, "<u8") for a in (keys, targets, outputs, finals, starts, [x for i in ids for x in i])]
    return np.array([max(map(len, order), default=0), *map(len, arrays)], "<u8").tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, "<u8", mode="r")
        self.longest = int(data[0])
        ends = np.cumsum([7, *data[1:7].tolist()])
        self.keys, self.targets, self.outputs, self.finals, self.starts, self.ids = (data[a:b] for a, b in zip(ends, ends[1:], strict=False))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of ids; -1 for those that the lexicon doesn't have."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        state, place = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        known = (sizes <= self.longest) & bool(len(self.keys))
        walking = np.flatnonzero(known)
        for at in range(self.longest if len(walking) else 0):
            walking = walking[sizes[walking] > at]
            if not len(walking):
                break
            key = state[walking] << np.uint64(8) | text[starts[walking] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[arc] == key
            known[walking[~goes]] = False
            walking, arc = walking[goes], arc[goes]
            state[walking] = self.targets[arc]
            place[walking] += self.outputs[arc].astype(np.int64)
        known[known] = self.finals[state[known].astype(np.int64)] > 0
        return np.where(known, place, -1)


# The tokenizer


#: Characters before this one combine with no other in normal forms.
SIMPLE = "\u0300"


class Words:
    """A tokenizer's file, ready to split texts, to merge words and to decode."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        plain = {"dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        steps = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        if (
            model["type"] != "BPE" or any(model.get(k) for k in plain) or not steps <= {"NFC", "NFD", "Replace", "Lowercase"}
            or [s.get("type") for s in split] != ["Split", "ByteLevel"] or not split[0]["invert"] or split[0]["behavior"] != "Removed"
            or split[1]["add_prefix_space"] or split[1].get("use_regex", True) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        ):
            raise ValueError("only byte-level BPE over words without white space is supported")
        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # by the pair's ids; a pair that is listed twice has its last rank
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        alphabet = byte_alphabet()
        self.inside, self.last = np.array([vocab[c] for c in alphabet]), np.array([vocab[c + end] for c in alphabet])
        self.pairs = np.array(sorted(self.merges))
        self.ranks = np.array([self.merges[p][0] for p in self.pairs.tolist()])
        self.made = np.zeros(len(pairs), np.int64)
        for rank, new in self.merges.values():
            self.made[rank] = new
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *((c.decode(), i) for c, i in self.special.items())]:
            self.tokens[i] = token
        self.decoded_by_library = spec.get("decoder") is not None
        # whether letters alone are one word, and the normaliser lower-cases
        self.one_word, self.lowered = self.pattern.findall("aé" * 3) == ["aé" * 3], "Lowercase" in steps
        self.same: set[str] = set()
        self.other: set[str] = set()

    def _agrees(self, text: str) -> bool:
        """Whether the pattern takes the characters of ``text``, and below SIMPLE ``lower`` makes of them, what the library does;
        each is tried once a worker."""
        for c in set(text) - self.same - self.other:
            tries = (f"a{c}a", f"!{c}!", f"1{c}1")
            fits = all([len(w.encode()) for w in self.pattern.findall(t)] == [len(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(t)] for t in tries)
            fits = fits and (c >= SIMPLE or self.lowered and (c.isspace() or self.library.normalizer.normalize_str(c) == c.lower()))
            (self.same if fits else self.other).add(c)
        return self.other.isdisjoint(text)

    def _plain(self, piece: bytes) -> list[bytes]:
        text = piece.decode()
        if max(text) < SIMPLE and (self.same.issuperset(text) or self._agrees(text)):
            # no character here combines with another
            text = text.lower()
            if text.isalpha():
                return [text.encode()] if self.one_word else [w.encode() for w in self.pattern.findall(text)]
        else:
            text = self.library.normalizer.normalize_str(text)
        if self.same.issuperset(text) or self._agrees(text):
            return [w.encode() for w in self.pattern.findall(text)]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        return [bytes(back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, piece: bytes) -> list[bytes | int]:
        """Words of what stands between white space, normalised; special tokens as their ids."""
        if self.specials is None or not (found := self.specials.split(piece))[1:]:
            return self._plain(piece)
        return [x for i, part in enumerate(found) if part for x in ([self.special[part]] if i % 2 else self._plain(part))]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the adjacent pair of the lowest rank becomes one, the leftmost first, until none can."""
        ids = self.inside[list(word)].tolist()
        ids[-1] = int(self.last[word[-1]])
        size, merges = len(ids), self.merges
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        heap = [(rank[0], i, rank[1]) for i in range(size - 1) if (rank := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, at, new = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right < 0 or merges.get(ids[at] << 32 | ids[right], (0, -1))[1] != new:
                continue
            ids[at], ids[right] = new, -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for a in (before[at], at):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (rank := merges.get(ids[a] << 32 | ids[b])):
                    heapq.heappush(heap, (rank[0], a, rank[1]))
        return [i for i in ids if i >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where there is none."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((right >= 0) & (self.pairs[at] == pair), self.ranks[at], NEVER)

    def _merged(self, words: list[bytes], width: int) -> np.ndarray:
        """``merge`` of many words of at most ``width`` bytes: a row of ids each, -1 after the last."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        out = np.full((len(words), width), -1, np.int64)
        row = np.repeat(np.arange(len(words)), sizes)
        out[row, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = self.inside[text]
        out[np.arange(len(words)), sizes - 1] = self.last[text[np.cumsum(sizes) - 1]]
        of, ids, columns = np.arange(len(words)), out.copy(), np.arange(width - 1)
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            best = ranks[np.arange(len(ranks)), at]
            goes = best < NEVER
            if not goes.all():
                out[of[~goes]] = ids[~goes]
                of, ids, ranks, at, best = of[goes], ids[goes], ranks[goes], at[goes], best[goes]
            if not len(of):
                return out
            rows = np.arange(len(of))
            ids[rows, at] = self.made[best]
            after = columns > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            ranks[rows, at] = self._rank(ids[rows, at], ids[rows, at + 1])
            before = at > 0
            ranks[rows[before], at[before] - 1] = self._rank(ids[rows[before], at[before] - 1], ids[rows[before], at[before]])

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has; as ``merge``, which does the long ones."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, found, least = np.zeros(len(words), np.int64), [], 0
        for width in TOGETHER:
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            for i in range(0, len(some), MANY):
                part = some[i : i + MANY]
                ids = self._merged([words[k] for k in part], max(2, width))
                counts[part] = (ids >= 0).sum(axis=1)
                found.append((part, ids[ids >= 0]))
            least = width
        for k in np.flatnonzero(sizes > least):
            ids = np.array(self.merge(words[k]))
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        if not found:
            return np.zeros(0, np.int64), counts
        order = np.concatenate([part for part, _ in found])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gathered(np.concatenate([ids for _, ids in found]), starts, counts), counts

    def encode(self, texts: list[bytes], lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        pieces: defaultdict[bytes, int] = defaultdict()
        pieces.default_factory = pieces.__len__
        texts = [np.fromiter(map(pieces.__getitem__, parts), np.int64, len(parts)) for parts in (t.split() for t in texts)]
        words: defaultdict[bytes | int, int] = defaultdict()
        words.default_factory = words.__len__
        split = [list(map(words.__getitem__, self.split(p))) for p in pieces]

        found = list(words)
        places = np.full(len(found), -1) if lexicon is None else lexicon.places([b"" if isinstance(w, int) else w for w in found])
        known = np.zeros(0, np.uint32) if lexicon is None else lexicon.ids.astype(np.uint32)
        new = np.array([p < 0 and not isinstance(w, int) for p, w in zip(places.tolist(), found, strict=True)], dtype=bool)
        merged, lengths = self.merge_all([found[i] for i in np.flatnonzero(new)])
        special = [i for i, w in enumerate(found) if isinstance(w, int)]
        pool = np.concatenate([known, merged.astype(np.uint32), np.array([found[i] for i in special], np.uint32)])
        starts, sizes = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        sizes[new], starts[new] = lengths, len(known) + np.cumsum(lengths) - lengths
        sizes[special], starts[special] = 1, len(known) + len(merged) + np.arange(len(special))
        if lexicon is not None:
            old = places >= 0
            starts[old] = lexicon.starts[places[old]]
            sizes[old] = lexicon.starts[places[old] + 1].astype(np.int64) - starts[old]

        # words to pieces, pieces to texts
        of = np.fromiter((w for s in split for w in s), np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = gathered(pool, starts[of], sizes[of])
        ends = np.concatenate([[0], np.cumsum(sizes[of])])
        last = np.cumsum(counts)
        begin, end = ends[last - counts], ends[last]
        every = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        lengths = (end - begin)[every]
        per_text = np.add.reduceat(np.append(lengths, 0), np.cumsum([0, *map(len, texts)])[:-1]) if texts else np.zeros(0, np.int64)
        per_text[[not len(t) for t in texts]] = 0
        return gathered(flat, begin[every], lengths), per_text

    def decode(self, ids: list[int]) -> str:
        """As the library decodes, special tokens included."""
        if self.decoded_by_library:
            return self.library.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _words(data: bytes) -> Words:
    """A worker's tokenizer, for all of its tasks."""
    return Words(data)


@lru_cache(maxsize=2)
def _lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def count_words(documents: DataFrame, tokenizer: bytes) -> DataFrame:
    """(word, n): how often each word of at most LONGEST bytes is in all texts."""
    held = documents.sparkSession.sparkContext.broadcast(tokenizer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _words(held.value), Counter()

        def passed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                texts = batch.column("text").slice(start, ROWS).drop_null().cast(pa.binary()).to_pylist()
                for piece, n in Counter(p for t in texts for p in t.split()).items():
                    for word in words.split(piece):
                        if not isinstance(word, int):
                            counts[word] += n
                if len(counts) > COUNTED:
                    yield passed()
        yield passed()

    return documents.select("text").mapInArrow(task, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def make_lexicon(documents: DataFrame, tokenizer: bytes, size: int = LEXICON) -> bytes:
    """The compiled lexicon of the most frequent words, at most ``size``, each met twice at least.

    Words are sorted into classes by count, eight to a doubling; as many whole classes are taken as ``size`` allows. So
    the driver gets at most ``size`` * LONGEST bytes, and nothing is sorted.
    """
    words, frequent = Words(tokenizer), []
    if size:
        counted = keep(count_words(documents, tokenizer).where("n > 1").select("word", F.floor(F.log2("n") * 8).alias("class")))
        classes = counted.groupBy("class").count().orderBy(F.desc("class")).collect()
        fitting = [r["class"] for r, total in zip(classes, accumulate(r["count"] for r in classes), strict=True) if total <= size]
        frequent = [bytes(r["word"]) for r in counted.where(F.col("class") >= fitting[-1]).collect()] if fitting else []
    ids, counts = words.merge_all(frequent)
    return compile_lexicon(dict(zip(frequent, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if frequent else {})


def publish(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder and has every executor fetch it; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(place.toString())
    return name


def _measured(documents: DataFrame, path: str, added: dict[str, str], measure, size: int) -> DataFrame:
    """The documents with numbered columns (rows.numbered) and those ``added``."""
    with open(path, "rb") as f:
        tokenizer = f.read()
    spark = documents.sparkSession
    lexicon = publish(spark, make_lexicon(documents.select("text"), tokenizer, size))
    held = spark.sparkContext.broadcast(tokenizer)

    def make():
        words, known = _words(held.value), _lexicon(SparkFiles.get(lexicon))

        def run(batch: pa.RecordBatch) -> list:
            texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            ids, counts = words.encode(texts, known)
            rows = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            return list(zip(*(measure(words, r) for r in rows), strict=True)) or [[] for _ in added]

        return run

    return add_columns(numbered(documents), {"text": column(documents, "text")}, make, ", ".join(f"{k} {v}" for k, v in added.items()), ROWS)


def encode_documents(documents: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """``documents`` with ids (array<int>), which takes the place of a column so called.

    ``path`` names a tokenizer's file, read on the driver; ``size`` bounds the lexicon, whose words are the most frequent of
    all ``documents``. Special tokens are found in texts as the library finds them, none is added. Null counts as
    empty and has no ids. Repeated rows and null ids stay; other columns may have any names. An empty table gives no rows. A
    text is encoded whole by one task.
    """
    added = {"ids": "array<int>"}
    return named(_measured(documents, path, added, lambda _, ids: (ids.astype(np.int32),), size), documents.columns, list(added))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with ids) and decoded: the text that the library gives for them, special tokens included; null as none."""
    with open(path, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())

    def make():
        words = _words(held.value)
        return lambda batch: [[words.decode(ids or []) for ids in batch.column("ids").to_pylist()]]

    return named(add_columns(numbered(encoded), {"ids": column(encoded, "ids")}, make, "decoded string"), encoded.columns, ["decoded"])


def _digests(words: Words, ids: np.ndarray) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(words.decode(ids.tolist()).encode()).hexdigest()


def encoding_report(documents: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Odd rows as in ``encode_documents``."""
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    documents = documents.select("doc_id", "text")
    return named(_measured(documents, path, added, _digests, size), documents.columns, list(added)).drop("text")
