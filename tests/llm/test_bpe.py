"""BPE through the lexicon against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, collect, make_documents
from pareframe.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "\n\t", "Hello, World's end isn't   I'LL they've", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>c", "<|EndOfText|> <|endoftext", "x" * 3000,
    "É é ́ ́a a ́", "１２ Ⅷ ½ ² 12345", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ß ẞ ﬁ", "a b c　d\u0085e​f g", "\x1c \x1d a\x1eb \x1f \x00x\x7f", "😀😀 👩‍👩‍👧 ❤️",
    "日本語 한국어 한", "!!!???...''' 's 't 're", "it''s 'S 'LL", "क्षि กำ אָ", "\U0001d7d8\U0001d7d9 \U00010400", "ab " * 4000, "� ﻿ a﻿b", "͸ \U000e0041 \U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def words():
    with open(PATH, "rb") as f:
        return bpe.Words(f.read())


def noise(n, seed=5):
    rnd = random.Random(seed)
    letters = "abcdeéÉß'’ \n\t.,!?12３日Σς̧́İ<|endoftext|>"
    wild = lambda: chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(0xF900, 0x11000), rnd.randrange(0x1D000, 0x1FAFF)]))
    return ["".join(rnd.choice(letters) if rnd.random() < 0.8 else wild() for _ in range(rnd.randrange(60))) for _ in range(n)]


def ids_of(words, texts, lexicon=None):
    ids, counts = words.encode([t.encode() for t in texts], lexicon)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def lexicon_of(words, tmp_path, texts):
    found = {w for t in texts for p in t.encode().split() for w in words.split(p) if isinstance(w, bytes)}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({w: words.merge(w) for w in found}))
    return bpe.Lexicon(str(path)), found


def test_ids_are_those_of_the_library(words, library, tmp_path):
    texts = [*TEXTS, *noise(4000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(words, texts) == expected
    some, _ = lexicon_of(words, tmp_path, [*texts[::3], "hello"])
    assert ids_of(words, texts, some) == expected
    for text, ids in zip(texts, expected, strict=True):
        assert words.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_characters_that_are_split_by_the_library(words, library, monkeypatch):
    texts = noise(300, seed=8)
    fresh = bpe.Words(library.to_str().encode())
    monkeypatch.setattr(fresh, "_agrees", lambda text: False)
    assert ids_of(fresh, texts) == ids_of(words, texts)


def test_long_words(words, library):
    rnd = random.Random(3)
    texts = ["the" * 40_000, "a" * 100_000, "".join(rnd.choice("etaoin") for _ in range(50_000)), "-" * 20_000, "é" * 20_000]
    assert ids_of(words, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_merged_together(words, monkeypatch):
    rnd = random.Random(6)
    some = ["".join(rnd.choice("etaoinshr'é") for _ in range(rnd.randint(1, 45))).encode() for _ in range(3000)]
    monkeypatch.setattr(bpe, "MANY", 700)
    ids, counts = words.merge_all(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [words.merge(w) for w in some]


def test_lexicon_is_minimal_and_finds_its_words(words, tmp_path):
    rnd = random.Random(1)
    table = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))).encode(): [i] for i in range(2000)}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(table))
    lexicon = bpe.Lexicon(str(path))
    asked = [*table, b"", b"abcabcabc", b"d", b"abcd", *("".join(rnd.choice("abcd") for _ in range(6)).encode() for _ in range(500))]
    places = lexicon.places(asked)
    assert [lexicon.ids[lexicon.starts[p]] if p >= 0 else None for p in places] == [table[w][0] if w in table else None for w in asked]
    assert sorted(p for p in set(places.tolist()) if p >= 0) == list(range(len(table)))
    # states of a minimal automaton differ in what can follow them
    endings = {}
    for w in table:
        for i in range(len(w) + 1):
            endings.setdefault(w[:i], set()).add(w[i:])
    assert len(np.unique(lexicon.targets)) + 1 == len(set(map(frozenset, endings.values())))


@pytest.mark.parametrize("size", [0, 20, bpe.LEXICON])
def test_report(spark, library, size, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 7)
    monkeypatch.setattr(bpe, "COUNTED", 5)
    rows = [*enumerate([*TEXTS, *noise(50)]), (200, None), (None, "No id"), (5, "Twice"), (5, "Twice")]
    found = collect(bpe.encoding_report(make_documents(spark, rows).repartition(3), PATH, size))
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((tuple(r.values()) for r in found), key=str) == sorted(expected, key=str)


def test_ids_and_texts_with_columns_of_any_name(spark, library):
    rows = [(1, "Some Text", "en", "s", 9, 4, "x"), (2, None, None, None, None, None, None)]
    documents = spark.createDataFrame(rows, f"{SCHEMA}, ids int, `a.b` string")
    found = bpe.decode_documents(bpe.encode_documents(documents, PATH, 10), PATH)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "ids", "decoded"]
    ids = library.encode("Some Text", add_special_tokens=False).ids
    assert [(r["ids"], r["decoded"]) for r in found.orderBy("doc_id").collect()] == [(ids, library.decode(ids)), ([], "")]


def test_empty_table(spark, empty):
    assert bpe.encoding_report(empty, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.encoding_report(empty, PATH).isEmpty()


def test_other_kinds_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.Words(f.read())
