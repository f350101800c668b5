"""Fitted operators: held-out accuracy, and odd tables."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, collect, make_documents
from pareframe.llm import language, toxicity
from pareframe.sources.tables import table
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def test_gradient_moves_towards_the_grades():
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        n = rnd.choice([0, 0, 0, 1, 2, 4])
        rows.append(({"bad": float(n)} if n else {}, min(3, n)))
    model = toxicity.fit(rows, ["bad"])
    assert model.thresholds == sorted(model.thresholds)
    score = lambda n: sum(1 / (1 + 2.718281828 ** (t - model.weights["bad"] * n)) for t in model.thresholds)
    assert score(0) < 0.5 < score(1) < score(2) < score(4)


def test_toxicity_held_out(spark):
    documents, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = toxicity.train(documents, labels.where("pmod(doc_id, 3) <> 0"))
    held = documents.join(labels.where("pmod(doc_id, 3) = 0").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    found = Counter((r.label, r.toxic) for r in toxicity.score(held, model).select("label", "toxic").collect())
    assert found[1, True] >= 0.88 * (found[1, True] + found[1, False])
    assert found[0, True] <= 0.01 * (found[0, True] + found[0, False])


def test_toxicity_of_odd_tables(spark, documents, rows, empty):
    labels = spark.createDataFrame([(d, 1, i % 2) for i, (d, _) in enumerate(rows)] + [(None, 1, 1), (7, None, None)], LABELS)
    scored = collect(toxicity.score(documents.withColumn("grade", F.lit("mine")), toxicity.train(documents, labels)))
    assert len(scored) == len(rows)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(documents, none)
        assert not any(r["toxic"] or r["severity"] for r in collect(toxicity.score(documents, model)))
    assert toxicity.without_toxic(empty, labels).collect() == []
    # no feature: the label's share alone makes nothing toxic
    assert toxicity.without_toxic(documents, labels.where("doc_id < 30")).count() == len(rows)
    assert toxicity.without_toxic(documents, labels).columns == documents.columns


def test_language_held_out(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train_text(documents.where("pmod(doc_id, 2) = 0"))
    held = documents.where("pmod(doc_id, 2) = 1")
    scored = language.fuse(language.text_evidence(language.document_rows(held), model, markup=False), model[0])
    found = scored.join(held.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")), "key").select("lang", "label").collect()
    assert sum(r.lang == r.label for r in found) >= 0.98 * len(found)


def test_evidence_of_hosts_and_markup(spark):
    word = {"aa": "zig zag zog", "bb": "mimo lalu"}
    texts = [(i, f"{word[x]} " * 5, x, "s", 1) for i, x in enumerate(["aa", "bb"] * 20)]
    documents = spark.createDataFrame(texts, SCHEMA)
    page = lambda i, host, lang, text: (i, f"https://{host}/x", f'<html lang="{lang}"><p>{text}</p></html>' if lang else f"<p>{text}</p>")
    pages = [page(i, "one.example.aa", "aa", word["aa"]) for i in range(20)] + [page(100 + i, "two.example.bb", "bb", word["bb"]) for i in range(20)]
    pages += [page(900, "one.example.aa", "", "..."), page(901, "new.elsewhere.bb", "", ""), page(902, "else.where.cc", "bb", ""), (903, None, None), (None, "https://two.example.bb", "")]
    found = collect(language.identify(documents, spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))))
    by = {r["page_id"]: r["lang"] for r in found if r["doc_id"] is None}
    assert (by[900], by[901], by[902]) == ("aa", "bb", "bb")
    assert len(found) == len(pages) + len(texts)
    assert all(0 < r["posterior"] <= 1 for r in found)


def test_language_of_odd_tables(spark, documents, rows, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(empty, pages).collect() == []
    found = collect(language.identify(documents, pages))
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows)
    assert len(collect(language.identify(documents.withColumn("lang", F.lit(None).cast("string")), pages))) == len(rows)


def test_severity_is_that_of_the_weights(spark):
    """Against the formula over all features of all texts, tokenised by another way."""
    rnd = random.Random(5)
    bad, good = ["vile", "wretched", "scumbag"], [f"word{i}" for i in range(60)]
    word = lambda toxic: rnd.choice(bad) if toxic and rnd.random() < 0.4 else rnd.choice(good)
    rows = [(i, " ".join(word(i % 2) + rnd.choice(["", ".", "!\n", ","]) for _ in range(40))) for i in range(120)]
    documents = make_documents(spark, [*rows, (500, None), (501, "VILE wretchedly é"), (502, "vile " * 30000)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], LABELS)
    model = toxicity.train(documents, labels)
    assert set(bad) <= set(model.weights) and model.thresholds == sorted(model.thresholds)
    texts = dict(rows) | {500: "", 501: "VILE wretchedly é", 502: "vile " * 30000}
    for r in collect(toxicity.score(documents, model)):
        tokens = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        score = sum(w * math.log1p(sum(t == k if not k.endswith("*") else len(t) >= len(k) - 1 and t.startswith(k[:-1]) for t in tokens)) for k, w in model.weights.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(above), abs=2e-6)
        assert (r["grade"], r["toxic"]) == (sum(p >= 0.5 for p in above), score > 0 and above[0] >= toxicity.REJECT)


@pytest.mark.parametrize("unit", ["<", "<script>", "<!--", "</script ", "<script></script ", "&a", "<html "])
def test_markup_in_linear_time(unit):
    began = time.perf_counter()
    language.visible(unit * (10_000_000 // len(unit)))
    assert time.perf_counter() - began < 8


def test_visible_text():
    html = "<HTML lang=en><!-- no > no --><p class='x'>One&nbsp;two</p><script>if (a<b) no</script ><style>no</STYLE>three<scripts>four <!-- five > six < seven"
    assert language.visible(html).split() == b"one two three four six  seven".split()


def test_pages_full_of_open_tags(spark):
    pages = [(1, "https://a.bb", "<html " * 300_000), (2, None, "<" * 3_000_000 + "zig zag zog zig zag")]
    documents = spark.createDataFrame([(i, "zig zag zog " * 5, "aa", "s", 1) for i in range(10)] + [(20 + i, "mimo lalu " * 5, "bb", "s", 1) for i in range(10)], SCHEMA)
    found = {r["page_id"]: r["lang"] for r in collect(language.identify(documents, spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert found[2] == "aa"


def test_many_languages(spark, monkeypatch):
    rnd = random.Random(7)
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for _ in range(70)]
    rows = [(i, " ".join(rnd.choice(words[i % 70]) for _ in range(20)), f"l{i % 70:02}", "s", 1) for i in range(280)]
    documents = spark.createDataFrame(rows, SCHEMA)
    found = collect(language.identify(documents, spark.createDataFrame([], "page_id long, url string, html string")))
    assert {r["doc_id"]: r["lang"] for r in found} == {r[0]: r[2] for r in rows}
    monkeypatch.setattr(language, "LANGUAGES", 69)
    with pytest.raises(ValueError, match="69"):
        language.train_text(documents)


def test_fusion_against_brute_force(spark):
    rnd = random.Random(9)
    n, smooth = 3, language.SMOOTH
    rows = []
    for i in range(60):
        domain, ll = rnd.choice(["a.x", "b.y", ""]), [round(-5 * rnd.random(), 3) for _ in range(n)]
        rows.append((i, f"h{rnd.randrange(3)}.{domain}", domain, rnd.choice(["x", "y", ""]), rnd.choice(["", "p", "q"]), ll, language._soft(ll)))
    names = "key host domain suffix declared ll soft".split()
    given = spark.createDataFrame(rows, "key long, host string, domain string, suffix string, declared string, ll array<double>, soft array<double>")
    found = {r["key"]: r for r in collect(language.fuse(given, ["aa", "bb", "cc"]))}
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    for r in rows:
        rest = [x for x in rows if x is not r]
        share = lambda some, prior: (sum((np.array(x["soft"]) for x in some), np.zeros(n)) + smooth * prior) / (len(some) + smooth)
        prior = share(rest, np.full(n, 1 / n))
        prior = share([x for x in rest if x["domain"] == r["domain"]], prior)
        prior = share([x for x in rest if (x["domain"], x["host"]) == (r["domain"], r["host"])], prior)
        total = np.array(r["ll"]) + np.log(prior)
        everything = sum(np.array(x["soft"]) for x in rest)
        for name in ("declared", "suffix"):
            if r[name]:
                same = sum((np.array(x["soft"]) for x in rest if x[name] == r[name]), np.zeros(n))
                total += np.log((same + 0.5) / (everything + 0.5 * smooth))
        share = np.exp(total - total.max())
        assert found[r["key"]]["lang"] == ["aa", "bb", "cc"][int(total.argmax())]
        assert found[r["key"]]["posterior"] == pytest.approx(float(share.max() / share.sum()), abs=2e-4)


def test_fit_holds_little_beside_its_features(monkeypatch):
    """A million features, in steps; the same weights as at once."""
    import tracemalloc

    rnd = np.random.default_rng(1)
    row = np.repeat(np.arange(1000, dtype=np.int32), 1000)
    column, value = rnd.integers(0, 50, len(row)).astype(np.int32), rnd.random(len(row))
    grade, names = rnd.integers(0, 4, 1000), [f"f{i}" for i in range(50)]
    tracemalloc.start()
    found = toxicity._descend(row, column, value, grade, names, 4, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    monkeypatch.setattr(toxicity, "STEP", len(row))
    whole = toxicity._descend(row, column, value, grade, names, 4, steps=3)
    assert np.allclose(list(found.weights.values()), list(whole.weights.values())) and np.allclose(found.thresholds, whole.thresholds)
