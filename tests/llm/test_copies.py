"""Exact dedup, n-gram join and line dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import collect, make_documents, near_copies
from pareframe.llm import exact, linededup, ngrams
from pareframe.llm.setjoin import size_class
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}
key = lambda i: (i is not None, i or 0)


def test_exact_dedup(rows, documents):
    check_exact(rows, collect(exact.exact_duplicates(documents)))


def check_exact(rows, found):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(found) == len(rows)
    by_text = defaultdict(list)
    for r in found:
        by_text[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        mine = by_text[hashlib.sha256(text.encode()).hexdigest()]
        best = max(ids, key=key)
        assert Counter(r["doc_id"] for r in mine) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(ids))}
        kept = [r["doc_id"] for r in mine if r["kept"]]
        assert kept == [best]


def test_exact_dedup_many_blocks(rows, documents):
    check_exact(rows, collect(exact.exact_duplicates(documents, block=16)))


def test_exact_dedup_when_digests_clash(rows, documents):
    weak = lambda block: F.crc32(block) % 3
    check_exact(rows, collect(exact.exact_duplicates(documents, block=64, keys=(weak, exact._itself))))


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[i:] for i in range(5)), strict=False))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return Counter((d, len(s), d if not s else least.get(c)) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def test_ngram_join(rows, documents):
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(ngrams.near_duplicates(documents)))
    assert found == brute_components(rows)


def test_ngram_join_of_many_copies(spark):
    rows = near_copies(seed=5, bases=2, copies=40, words=48)
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(ngrams.near_duplicates(make_documents(spark, rows).repartition(4))))
    assert found == brute_components(rows)


def test_ngram_join_when_hubs_are_not_tried(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "ROUNDS", 0)
    rows = near_copies(seed=6, bases=3, copies=12)
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(ngrams.near_duplicates(make_documents(spark, rows))))
    assert found == brute_components(rows)


def test_one_of_each_component(documents, rows):
    """Exactly one row of each component with words, the one with the smallest id; all others stay."""
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    groups = defaultdict(list)
    for (d, t), c, x in zip(rows, comp, sets, strict=True):
        groups[c].append((d is None, d or 0, d, t)) if x else groups[object()].append((d is None, d or 0, d, t))
    kept = Counter((r["doc_id"], r["text"]) for r in collect(ngrams.one_of_each(documents)))
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        least = min(m[:2] for m in members)
        assert sum(kept[d, t] for d, t in {m[2:] for m in members if m[:2] == least}) >= 1
    assert set(kept) <= set(rows)


def test_one_of_each_of_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (9, text + " more"), (9, "something else that nothing is linked with at all"), (None, text), (None, "alone in the world with no id here"), (None, "alone in the world with no id here"), (2, ""), (2, None)]
    kept = Counter((r["doc_id"], r["text"]) for r in collect(ngrams.one_of_each(make_documents(spark, rows).withColumn("th", F.lit(1)))))
    assert kept == Counter([rows[0], rows[2], rows[4], rows[6], rows[7]])


def brute_lines(rows):
    """Texts with their lines, by (doc_id, text)."""
    order = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (key(x[0]), exact_hash(x[1])))
    lines = [(key(d), at, frozenset(x.encode().lower().split()), (d, t)) for d, t in order for at, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: (x[0], x[1]))
    gone = set()
    for i, (_, at, a, where) in enumerate(lines):
        for _, _, b, _ in lines[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                gone.add((where, at))
                break
    return {w: "\n".join(x for at, x in enumerate(w[1].split("\n")) if (w, at) not in gone) for w in order}


def exact_hash(text):
    return text


def unique_ids(rows):
    """Brute force has no rule for lines of two texts with the same doc_id and place."""
    seen = {}
    return [(d, t) for d, t in rows if d is not None and seen.setdefault(d, t) == t]


def test_line_dedup(spark, rows):
    rows = unique_ids(rows)
    expected = brute_lines(rows)
    found = collect(linededup.dedup_lines(make_documents(spark, rows).repartition(3)))
    assert len(found) == len(rows)
    for r in found:
        texts = [e for (d, t), e in expected.items() if d == r["doc_id"]]
        assert r["text"] == (texts[0] if texts else None)
        assert r["n_chars"] == len(r["text"] or "")


@pytest.mark.parametrize("listed", [3, 2048])
def test_line_dedup_with_long_lists(spark, listed):
    rows = unique_ids(near_copies(seed=8, bases=2, copies=25, words=40))
    expected = brute_lines(rows)
    for r in collect(linededup.dedup_lines(make_documents(spark, rows).repartition(3), listed=listed, hubs=1)):
        assert r["text"] == next((e for (d, t), e in expected.items() if d == r["doc_id"]), None)


def test_line_dedup_with_lines_of_many_sizes(spark):
    """Lists of one frequent word, of lines of 1 to 40 words, in blocks of 3: matches are found across classes of sizes."""
    texts = ["\n".join(" ".join(f"w{j}" for j in range(1 + (i * 7 + k * 11) % 40)) for k in range(3)) for i in range(20)]
    rows = list(enumerate(texts))
    expected = brute_lines(rows)
    found = collect(linededup.dedup_lines(make_documents(spark, rows).repartition(3), listed=3, hubs=1))
    assert {r["doc_id"]: r["text"] for r in found} == {d: expected[d, t] for d, t in rows}


@pytest.mark.parametrize("frequent, together", [(2, 40), (30, 1 << 19), (1 << 16, 200)])
def test_line_dedup_with_frequent_words_and_parts_of_lists(spark, frequent, together):
    """Lists by pairs of words, and lists whose parts meet two at a time."""
    rows = unique_ids(near_copies(seed=9, bases=2, copies=25, words=40))
    expected = brute_lines(rows)
    found = collect(linededup.dedup_lines(make_documents(spark, rows).repartition(3), listed=3, hubs=1, frequent=frequent, together=together))
    assert {r["doc_id"]: r["text"] for r in found} == {d: expected.get((d, t)) for d, t in rows}


def lines_of(sets):
    n = np.array([len(x) for x in sets])
    return linededup.Lines(np.zeros(n.sum(), dtype=np.int64), np.repeat(np.arange(len(n)), n), linededup.mix(np.concatenate([np.array(sorted(x), dtype=np.uint64) for x in sets])))


def test_matching_lines_have_a_list_in_common(monkeypatch):
    """Whether words are frequent or not, and lines short or long."""
    monkeypatch.setattr(linededup, "LONG", 12)
    rnd = np.random.default_rng(4)
    sets = [{int(x)} for x in rnd.integers(0, 5, 3)]
    for n in range(2, 25):
        base = [int(x) for x in rnd.permutation(60)[:n]]
        sets += [set(base[int(rnd.integers(0, n // 4 + 1)) :]) | {int(x) for x in rnd.integers(0, 60, rnd.integers(0, n // 5 + 2))} for _ in range(8)]
    lines = lines_of(sets)
    lines.order(rnd.integers(0, 24, linededup.SLOTS).astype(np.uint8))
    token, line, at = linededup._keys(lines, np.ones(len(lines), dtype=bool), 4)
    mine = [{t: int(a) for t, a in zip(token[line == i].tolist(), at[line == i], strict=True)} for i in range(len(lines))]
    matching = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x != y and 100 * len(x & y) >= 75 * len(x | y):
                matching += 1
                needed = -(-75 * (len(x) + len(y)) // 175)
                assert any(min(len(x) - mine[i][t], len(y) - mine[j][t]) >= needed for t in mine[i].keys() & mine[j].keys())
    assert matching > 100


def test_lists_leave_what_is_to_be_looked_at_only():
    """Of a list of many lines, eight of which may match, what those have beyond their first four candidates is left."""
    sets = [set(range(1000 + 20 * i, 1019 + 20 * i)) | {1} for i in range(100)] + [set(range(2, 20)) | {1, 100 + i} for i in range(8)]
    lines = lines_of(sets)
    zeros = np.zeros(len(sets), dtype=np.int64)
    given = {"token": zeros.view(np.uint64), "sid": lines.sid, "sign": lines.sign, "sign2": lines.sign2, "doc": np.arange(len(sets)), "n": np.diff(lines.begin)}
    row = {"bucket": 0}
    for name, kind in linededup.POSTING:
        head, values = (b"", given[name]) if kind else linededup.squeezed(given.get(name, zeros))
        row[name] = head + values.tobytes()
    found = linededup._candidates(pa.Table.from_pylist([row]), 512, 4)
    left = [d for docs in found["doc"].to_pylist() if docs for d in docs]
    assert sorted(left) == [104, 105, 106, 107]
    assert sum(len(a) for a in found["a"].to_pylist() if a) == 1 + 2 + 3 + 4 * 4


def test_size_classes_of_matching_sets_are_neighbours(spark):
    sizes = spark.range(1, 200_000).selectExpr("id AS n", "ceil(id * 75 / 100) AS least")
    sizes = sizes.select(size_class(F.col("n")).alias("of_n"), size_class(F.col("least")).alias("of_least"))
    assert sizes.where("of_n - of_least NOT IN (0, 1)").isEmpty()


def test_no_line_is_taken_for_sent_that_was_not():
    rnd = np.random.default_rng(3)
    # few places, numbers that share them, and signs that differ where numbers don't
    sent, gone = linededup.Sent(8), set()
    for _ in range(50):
        sid, sign = rnd.integers(0, 40, 30), rnd.integers(0, 2, 30).astype(np.uint64)
        fresh = [(int(sid[i]), int(sign[i])) for i in sent.new(sid, sign)]
        assert len(fresh) == len(set(fresh))
        assert {(int(a), int(b)) for a, b in zip(sid, sign, strict=True)} - gone <= set(fresh)
        gone |= set(fresh)
    assert list(sent.new(np.array([3, 3]), np.array([1, 1], dtype=np.uint64))) in ([0], [])
    assert len(sent.new(np.array([3]), np.array([1], dtype=np.uint64))) == 0
    assert len(sent.new(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))) == 0


def test_line_dedup_takes_odd_rows(documents, rows):
    assert len(collect(linededup.dedup_lines(documents.withColumn("n_lines", F.lit("mine"))))) == len(rows)
    kept = collect(linededup.deduplicated(documents))
    assert all(set(r) == set(documents.columns) for r in kept)
    assert any(r["text"] == "\n\n" for r in kept)


def test_empty_tables(empty):
    assert exact.exact_duplicates(empty).collect() == []
    assert ngrams.near_duplicates(empty).collect() == []
    assert ngrams.one_of_each(empty).collect() == []
    assert linededup.dedup_lines(empty).collect() == []
