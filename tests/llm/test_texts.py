"""Operators on single texts against brute force and round trips."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import collect, make_documents
from pareframe.llm import chat, decontaminate, licences, pieces, pii
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def noise(alphabet, n, size, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(size))) for _ in range(n)]


# pieces


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def test_ids_are_those_of_the_library(model):
    texts = ["", " ", "  ", "a ", " a", "▁", "▁▁a ▁", "\n", "é\0x", "<s> </s>", "①ﬁ", "x" * 5000, "a b " * 3000, *noise("ab ▁ é\n😀1①", 3000, 30)]
    for text in texts:
        ids = model.encode(text)
        assert ids == model.library.encode(text, add_bos=True, add_eos=True)
        begins, ends = model.offsets(text, ids)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data
        assert len(begins) == len(ids)


def test_words_beyond_the_cache(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    fresh = pieces.Pieces(model.library.serialized_model_proto())
    for text in noise("ab c", 50, 40):
        assert fresh.encode(text) == model.encode(text)


def compiled(entries):
    """A compiled character map with the given replacements: a double-array trie, then the replacements."""
    texts, values = b"", {}
    for k, v in entries.items():
        values[k.encode()] = len(texts)
        texts += v.encode() + b"\0"
    tree = {}
    for k in values:
        node = tree
        for b in k:
            node = node.setdefault(b, {})
        node["value"] = values[k]
    units, used = {0: 0}, {0}

    def place(node, at):
        labels = [b for b in node if b != "value"] + ([0] if "value" in node else [])
        base = next(o for o in range(1, 1 << 16) if not any((at ^ o ^ b) in used for b in labels))
        used.update(at ^ base ^ b for b in labels)
        units[at] = units.get(at, 0) | base << 10 | ("value" in node) << 8
        for b in labels:
            if b or "value" not in node:
                units[at ^ base ^ b] = b
                place(node[b], at ^ base ^ b)
            else:
                units[at ^ base] = 0x80000000 | node["value"]

    place(tree, 0)
    array = [units.get(i, 0xFF000000 >> 24 << 24 & 0x7FFFFFFF) for i in range(max(units) + 1)]
    return struct.pack("<I", 4 * len(array)) + struct.pack(f"<{len(array)}I", *array) + texts


def test_normalisation_by_longest_prefix():
    entries = {"ﬁ": "fi", "①": "1", "ab": "X", "abc": "YZ", "Å": "Å"}
    charmap = pieces.CharacterMap(compiled(entries))
    for text in ["", "abc", "ab", "abab c", "ﬁn ①", "aﬁ b", *noise("abcﬁ① é", 300, 12)]:
        marked, source = pieces.normalise(text, charmap, prefix=True)
        expected, at = "", 0
        spans = []
        while at < len(text):
            k = max((k for k in entries if text.startswith(k, at)), key=len, default=None)
            piece = entries[k] if k else text[at]
            spans.append((len(text[:at].encode()), len(piece.replace(" ", "▁").encode())))
            expected += piece
            at += len(k) if k else 1
        expected = "▁" * bool(expected) + expected.replace(" ", "▁")
        assert marked.decode() == expected
        assert len(source) == len(marked) + 1 and source[-1] == len(text.encode())
        place = 3
        for start, size in spans:
            assert source[place] == start
            place += size


def test_encoded_table(spark, documents, rows, empty):
    found = collect(pieces.encode_documents(documents.withColumn("ids", F.lit("mine")), MODEL))
    library = pieces.Pieces(open(MODEL, "rb").read()).library
    assert len(found) == len(rows)
    assert all(r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True) for r in found)
    report = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collect(pieces.encoding_report(documents, MODEL)))
    expected = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids))] += 1
    assert report == expected
    assert pieces.encoding_report(empty, MODEL).collect() == []


# personal data


def base_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


ODD = ["a@b.c@d.e", "x@y@z.w", "a@b..c", "1.2.3.4.5.6.7.8", "1..2.3.4.5", "999.1.1.1.1", "4111 1111-1111 1111", "4111111111111111 ", "+1 (555) 010-9999.", "+1+12345678901", "é4111111111111111é", "1" * 6000 + ".1.1.1"]


def test_base_spans():
    automaton = pii.anchors()
    texts = [*ODD, *(t for i, a in enumerate(("a@.b-1", "12.3 .", "0 -1a4", "+1 ().-23x", "+1.@a-9 é")) for t in noise(a, 4000, 40, i))]
    for text in texts:
        assert [s for s in pii.spans_of(text, automaton) if s[0] in pii.BASE] == base_spans(text), text


def test_added_spans():
    automaton = pii.anchors()
    added = lambda t: [(k, t[a:b]) for k, a, b in pii.spans_of(t, automaton) if k not in pii.BASE]
    assert added("IBAN: DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert added("iban DE88370400440532013000") == []
    assert added("SSN 123-45-6789, ssn: 000-45-6789") == [("account", "123-45-6789")]
    assert added("see https://me:secret@host.example/x and https://host.example/") == [("url", "https://me:secret@host.example")]
    assert added("account of a trip") == []
    assert pii.masked("x a@b.cd y", [("email", 2, 8)]) == "x [email] y"


def test_pii_table(spark, empty):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", ODD[0]])] + [(None, ODD[7]), (3, ODD[7])]
    documents = make_documents(spark, rows).withColumn("pii", F.lit("mine"))
    found = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in collect(pii.pii_report(documents)))
    expected = Counter()
    for d, t in rows:
        spans = base_spans(t or "")
        expected[d, *(sum(s[0] == k for s in spans) for k in pii.BASE), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))] += 1
    assert found == expected
    assert len(collect(pii.find_pii(documents))) == len(rows)
    assert pii.pii_report(empty).collect() == []


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(text, items, window=10):
    windows = defaultdict(set)
    for item, t in items:
        row = WORD.findall((t or "").translate(LOWER))
        size = min(window, len(row))
        for i in range(len(row) - size + 1 if size else 0):
            windows[tuple(row[i : i + size])].add(item)
    row = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for w, owners in windows.items():
        for i in range(len(row) - len(w) + 1):
            if tuple(row[i : i + len(w)]) == w:
                hit.update(range(i, i + len(w)))
                found |= owners
    names = sorted(str(x) for x in found if x is not None)
    return len(row), len(hit), len(names), sha(",".join(names)), bool(hit)


@pytest.mark.parametrize("block_rows", [5000, 3])
def test_decontamination(spark, block_rows):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice("abcé") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([12, 15, 10, 11, 30])] + [(5, "Q7 r"), (6, "zz"), (7, None), (8, "--"), (None, "k l m"), (2, text(12))]
    rows = [(i, text(rnd.randrange(60)) + rnd.choice(["", " q7-R!", " ZZ", f" {items[4][1]} {items[1][1]}", " k l m", " k l"])) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "zz"), (3, "zz"), (3, "zz")]
    documents = make_documents(spark, rows).repartition(2).withColumn("items", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(documents, benchmark, block_rows=block_rows)
    assert set(found.columns) == set(documents.columns) | {"n_words", "hits"}
    got = Counter((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["hits"][::2], r["hits"][1::2], strict=True)), len(r["items"]), sha(",".join(r["items"])), bool(r["hits"])) for r in collect(found))
    assert got == Counter((d, *brute_contamination(t, items)) for d, t in rows)
    if block_rows == 5000:
        report = collect(decontaminate.contamination_report(documents, benchmark))
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in report) == got
        clean = collect(decontaminate.decontaminated(documents.drop("items"), benchmark))
        assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter((d, t) for d, t in rows if not brute_contamination(t, items)[4])


def test_decontamination_of_empty_tables(spark, documents, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["hits"] == [] for r in collect(decontaminate.contamination(documents, none)))
    assert decontaminate.contamination_report(empty, none).collect() == []


# chat


def test_chat(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice(["<", "|", "im_end|>", "<|im_end|>\n", "<|im_sep|>", "\\", "\\|", "\\n", "\n", "a", "é", "<|im_start|>assistant\n"]) for _ in range(rnd.randrange(8)))
    roles = ["user", "assistant", "assistant", "system", "a\nb", "x\\n", None, ""]
    rows = [(c, rnd.randrange(9), rnd.choice(roles), rnd.choice([text(), None, ""])) for c in range(40) for _ in range(rnd.randint(1, 9))]
    rows += [rows[0], (None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (99, 0, "assistant", "long " * 20000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    groups = defaultdict(list)
    for r in sorted(rows, key=order):
        groups[r[0]].append((r[2] or "", r[3] or ""))
    found = collect(chat.format_chat(table).withColumn("read", chat.read_chat(F.col("formatted"))))
    assert len(found) == len(groups)
    for r in found:
        turns = groups[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["read"]] == turns
        assert "".join(s["piece"] for s in r["segments"]) == r["formatted"]
        changes = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert r["formatted"].count(chat.START) == changes == r["formatted"].count(chat.END)
    for r in collect(chat.chat_report(table)):
        turns = groups[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.chat_report(table.limit(0)).collect() == []


# licences


def test_known_licences_have_a_cue():
    assert all(any(cue in text.lower() for cue in licences.CUES) for _, _, text in licences.LICENCES)


def test_licences(spark, empty):
    mit = licences.LICENCES[0][2]
    noted = "Some text.\nreleased under the  MIT licence\nMore."
    rows = [(1, "Copyright (c) 2020 Somebody\n" + mit.upper()), (2, mit + " And more."), (3, noted), (4, noted + "\nReleased under the MIT License!"), (5, None), (6, ""), (7, "about a license"), (3, noted), (None, noted), (8, "w " * 50000 + "\n" + noted)]
    found = Counter((r["doc_id"], r["licence"], r["kind"], r["n"]) for r in collect(licences.scan_licences(make_documents(spark, rows).withColumn("licence", F.lit(0)))))
    assert found == Counter([(1, "MIT", "text", 1), (3, "MIT", "notice", 2), (4, "MIT", "notice", 2), (None, "MIT", "notice", 1), (8, "MIT", "notice", 1)])
    assert licences.scan_licences(empty).collect() == []
