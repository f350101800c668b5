"""64-bit hashes of the words of a column of texts, computed over whole stretches of bytes at once.

Words are what white space (bytes 9 to 13 and 32) separates, A-Z lower-cased. A word is read eight bytes at a time,
and its hash depends on its bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text in a group, or one longer text.
GROUP = 3 << 19
#: Longer words are hashed one by one.
LONG = 128

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _bounds(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none goes on over one of the ``borders``."""
    word = np.zeros(len(data) + 2, dtype=bool)
    np.logical_and(data != 32, (data - np.uint8(9)) > 4, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    cut = np.unique(borders[word[borders] & word[borders + 1]])
    if len(cut):
        starts, ends = (np.insert(x, np.searchsorted(x, cut), cut) for x in (starts, ends))
    return starts, ends


def _hashed(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``raw`` has eight bytes more than the words."""
    eight = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,))
    value = mix((eight[starts] & _MASK[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * _ODD))
    more, done = np.flatnonzero(sizes > 8), 8
    for i in more[sizes[more] > LONG].tolist():
        value[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    more = more[sizes[more] <= LONG]
    while len(more):
        value[more] = mix((value[more] * _ODD) ^ (eight[starts[more] + done] & _MASK[np.minimum(sizes[more] - done, 8)]))
        done += 8
        more = more[sizes[more] > done]
    return value


def word_groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, line, hash) of each word, in order, for consecutive texts of about GROUP bytes.

    ``text`` is the place in the column, ``line`` the number of line feeds before the word in its text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, buffer = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = memoryview(buffer) if buffer is not None else memoryview(b"")
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[upto])
        raw = bytes(whole[low:high]).lower() + bytes(8)
        data = np.frombuffer(raw, np.uint8, high - low)
        begin = offsets[at : upto + 1] - low
        starts, ends = _bounds(data, begin[1:-1])
        # words before each text, and before each line feed
        of_text = np.searchsorted(starts, begin)
        feeds = np.flatnonzero(data == 10)
        before = np.searchsorted(starts, feeds)
        text = np.repeat(np.arange(at, upto), np.diff(of_text))
        line = np.repeat(np.arange(len(feeds) + 1), np.diff(np.concatenate([[0], before, [len(starts)]])))
        line -= np.repeat(np.searchsorted(feeds, begin[:-1]), np.diff(of_text))
        yield text, line, _hashed(raw, starts, ends - starts)
        at = upto
