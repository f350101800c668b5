"""SentencePiece encoding with byte offsets, and decoding.

The text is normalised first: at each place the longest entry of the model's compiled character map that matches
is replaced, any other character is copied, spaces become the marker U+2581 and the dummy prefix is added. Every
normalised byte records the source byte it comes from. Ids are the library's; each piece has a known length in
normalised bytes, so running sums give its normalised span and the recorded alignment projects that to the
original bytes.

Where no piece of the vocabulary has the marker after another character, no merge crosses a word boundary; words
are then encoded once and looked up again. Otherwise whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
from pyspark.sql import DataFrame

from pareframe.llm.rows import add_columns, column, named, numbered

SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Bytes of words whose ids a task remembers, and of the longest such word.
CACHE, CACHED = 8 << 20, 64


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; nested ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled map: the size of a double-array trie, its units, then zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that ``data`` has at ``at``, and its replacement."""
        if not self.units:
            return None
        units, best, node = self.units, None, 0
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = i - at + 1, self.texts[value : self.texts.index(b"\0", value)]
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def normalise(text: str, charmap: CharacterMap, prefix: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes; the source byte of each of them, and the length of the source at the end."""
    data = text.encode("utf-8", "surrogatepass")
    if not charmap.units:
        marked, source = _marked(data)
    else:
        out, origin, at = [], [], 0
        while at < len(data):
            size, piece = charmap.longest(data, at) or (_width(data[at]), b"")
            piece = piece if charmap.longest(data, at) else data[at : at + size]
            piece, _ = _marked(piece)
            out.append(piece)
            origin += [at] * len(piece) if len(piece) != size else range(at, at + size)
            at += size
        marked, source = b"".join(out), np.array(origin, dtype=np.int64)
    if prefix and marked:
        mark = SPACE.encode()
        marked, source = mark + marked, np.concatenate([np.zeros(len(mark), dtype=np.int64), source])
    return marked, np.append(source, len(data))


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _marked(data: bytes) -> tuple[bytes, np.ndarray]:
    """Spaces as markers of three bytes, which all come from the space."""
    return data.replace(b" ", SPACE.encode()), np.repeat(np.arange(len(data)), np.where(np.frombuffer(data, np.uint8) == 32, 3, 1))


class Pieces:
    """A model, ready to encode and decode."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, spec = [], {}
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(3, 1)))
            elif number == 3:
                spec = dict(_fields(value))
        self.charmap = CharacterMap(spec.get(2, b""))
        self.prefix = bool(spec.get(3, 1))
        self.trimmed = bool(spec.get(4, 1))
        # kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte
        self.length = np.array([0 if k in (2, 3) else 1 if k == 6 else len(p.encode()) for p, k in pieces], dtype=np.int64)
        self.unknown = self.library.unk_id()
        plain = not self.trimmed and not any(k == 4 for _, k in pieces) and self.prefix and not self.charmap.units
        self.by_word = plain and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in pieces if k == 1)
        self.seen: dict[str, list[int]] = {}
        self.room = CACHE
        self.mark = self.library.piece_to_id(SPACE)

    def _encoded(self, chunks: list[str]) -> dict[str, list[int]]:
        """Ids of chunks, each of which begins with a marker. The first short ones that a task meets are remembered."""
        ids = self.library.encode([c[1:].replace(SPACE, " ") for c in chunks], num_threads=1)
        found = {c: x or [self.mark] for c, x in zip(chunks, ids, strict=True)}
        if self.room > 0:
            short = {c: x for c, x in found.items() if len(c) <= CACHED}
            self.room -= sum(map(len, short))
            self.seen |= short
        return found

    def encode(self, text: str) -> list[int]:
        """The library's ids, begin and end included."""
        if not self.by_word:
            return self.library.encode(text, add_bos=True, add_eos=True)
        chunks = CHUNKS.findall(SPACE + text.replace(" ", SPACE)) if text else []
        seen = self.seen
        new = {c for c in chunks if c not in seen}
        found = self._encoded(list(new)) if new else {}
        out = [self.library.bos_id()]
        for chunk in chunks:
            out += found[chunk] if chunk in new else seen[chunk]
        out.append(self.library.eos_id())
        return out

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte of each id in ``text``; control pieces are empty there.

        An unknown piece has no length of its own: texts with one get the spans that its neighbours leave free.
        """
        marked, source = normalise(text, self.charmap, self.prefix)
        sizes = self.length[np.array(ids, dtype=np.int64)]
        unknown = np.flatnonzero(np.array(ids) == self.unknown)
        missing = len(marked) - int(sizes.sum())
        if len(unknown) == 1:
            sizes[unknown[0]] = missing
        elif missing and not self.trimmed:
            sizes = self._aligned(marked, ids, sizes)
        ends = np.minimum(np.cumsum(sizes), len(marked))
        return source[np.concatenate([[0], ends[:-1]])], source[ends]

    def _aligned(self, marked: bytes, ids: list[int], sizes: np.ndarray) -> np.ndarray:
        """Lengths where several pieces are unknown: each ends where the next known piece is found."""
        at, pending = 0, None
        for i, x in enumerate(ids):
            if x == self.unknown:
                pending = i
            elif sizes[i]:
                piece = self.library.id_to_piece(x).encode()
                place = marked.find(piece, at) if sizes[i] == len(piece) else at
                if pending is not None and place >= 0:
                    sizes[pending], at, pending = place - at, place, None
                at += int(sizes[i])
        if pending is not None:
            sizes[pending] = len(marked) - at
        return sizes

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """``documents`` with ids, begins and ends (bytes of the text in UTF-8); columns of these names are replaced.

    The model at ``model_path`` is read on the driver and sent out; a model is a fixed file of about 1 MB. Null
    counts as empty: only the begin and end ids. Repeated rows and null ids just stay; other columns may have any
    names. An empty table gives no rows.
    """
    added = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>"}
    return named(_measured(documents, model_path, added, _spans), documents.columns, list(added))


def _spans(pieces: Pieces, text: str) -> tuple:
    ids = pieces.encode(text)
    begins, ends = pieces.offsets(text, ids)
    return ids, begins.tolist(), ends.tolist()


def _digests(pieces: Pieces, text: str) -> tuple:
    ids = pieces.encode(text)
    begins, ends = pieces.offsets(text, ids)
    return (
        len(ids),
        hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
        hashlib.sha256(pieces.decode(ids).encode("utf-8", "surrogatepass")).hexdigest(),
        hashlib.sha256(np.stack([begins, ends]).astype("<i8").tobytes()).hexdigest(),
    )


def encoding_report(documents: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (begins, then ends).

    Null texts count as empty; repeated rows and null ids stay, row by row; other columns are not used, and an empty
    table gives no rows.
    """
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}
    documents = documents.select("doc_id", "text")
    return named(_measured(documents, model_path, added, _digests), documents.columns, list(added)).drop("text")


def _measured(documents: DataFrame, model_path: str, added: dict[str, str], measure) -> DataFrame:
    """The documents with numbered columns (rows.numbered) and those ``added``."""
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def make():
        pieces = Pieces(model.value)

        def run(batch) -> list:
            found = [measure(pieces, t or "") for t in batch["text"].to_pylist()]
            return list(zip(*found, strict=True)) or [[] for _ in added]

        return run

    return add_columns(numbered(documents), {"text": column(documents, "text")}, make, ", ".join(f"{k} {v}" for k, v in added.items()))
