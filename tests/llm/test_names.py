"""Columns of the caller's that are called as those of an operator, or oddly."""

from collections import Counter

import pytest
from helpers import collect, make_documents
from pareframe.llm import decontaminate, linededup, ngrams, pieces, pii, toxicity
from pareframe.llm.queries import model_path
from pyspark.sql import functions as F

ODD = ["grade", "severity", "toxic", "items", "hits", "n_words", "n_lines", "n_removed", "__stay", "__doc", "th", "doc", "c0", "c7", "a.b", "a b", "x`y", "lines", "turn", "stays", "ids", "pii"]
ROWS = [(1, "one line here\nand one more line here"), (2, "one line here\nsomething else"), (3, None), (4, ""), (5, "alone " * 20)]


@pytest.fixture(scope="module")
def odd(spark):
    return make_documents(spark, ROWS).select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in ODD))


def check(found, odd, changed=(), text=True):
    """All own columns but the ``changed`` ones, as they were."""
    own = [c for c in odd.columns if c not in changed]
    assert [c for c in found.columns if c in own] == own
    before = {r["doc_id"]: r for r in collect(odd)}
    rows = collect(found)
    assert rows
    for r in rows:
        for c in own:
            assert r[c] == before[r["doc_id"]][c] or c in ("text", "n_chars") and not text, c
    return Counter(r["doc_id"] for r in rows)


def test_filters_give_the_documents_own_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "something else")], "item_id long, text string")
    check(toxicity.without_toxic(odd, labels), odd)
    assert check(decontaminate.decontaminated(odd, benchmark), odd) == Counter([1, 3, 4, 5])
    assert check(linededup.deduplicated(odd), odd, text=False) == Counter([1, 2, 3, 4, 5])
    assert check(ngrams.one_of_each(odd), odd) == Counter([1, 2, 3, 4, 5])


def test_added_columns_take_the_place_of_those_of_the_same_name(spark, odd):
    benchmark = spark.createDataFrame([(1, "something else")], "item_id long, text string")
    check(toxicity.score(odd, toxicity.Ordinal({}, [1.0, 2.0])), odd, ("severity", "grade", "toxic"))
    check(decontaminate.contamination(odd, benchmark), odd, ("n_words", "hits", "items"))
    check(linededup.dedup_lines(odd), odd, ("n_lines", "n_removed"), text=False)
    check(pieces.encode_documents(odd, model_path()), odd, ("ids",))
    check(pii.find_pii(odd), odd, ("pii",))
