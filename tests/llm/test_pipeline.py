"""The pipeline on small tables: every stage keeps the columns, and its decisions take effect."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from helpers import collect, make_documents, near_copies
from pareframe.llm import pieces, toxicity
from pareframe.llm.queries import model_path, oracle_sql, queries
from pareframe.sources.tables import table


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.count() <= before
        before = docs.count()
        assert (docs.columns == columns) == (name != "sentencepiece")
    assert 0 < before < table(spark, sf_dir, "documents").count()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark: near copies, repeated lines, toxic and leaked documents."""
    rnd = random.Random(11)
    good = [f"word{i}" for i in range(400)]
    rows = [(d, t) for d, t in near_copies(seed=3, bases=8, copies=3) if t is not None]
    passage = " ".join(rnd.sample(good, 14))
    for i in range(60):
        text = [rnd.choice(good) for _ in range(30)]
        if i % 3 == 0:
            text += ["vile", "wretched", "scumbag", "vile"]
        if i % 7 == 1:
            text.append(passage)
        rows.append((1000 + i, " ".join(text) + ("\na line that is the same in many of these documents" if i % 5 == 2 else "")))
    place = str(tmp_path_factory.mktemp("pipeline"))
    make_documents(spark, rows).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(d, 1, int("vile" in t)) for d, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    items = [(1, f"as was said {passage}"), (2, "nothing like it at all"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, rows, items


def test_run_against_brute_force(spark, small):
    """Every stage by plain Python, on what the one before has left."""
    from test_copies import brute_components, brute_lines
    from test_texts import brute_contamination

    place, rows, items = small
    model = toxicity.train(table(spark, place, "documents"), table(spark, place, "labels"))
    left = [(d, t) for d, t in rows if model.above(t)[0] < toxicity.REJECT]
    assert {d for d, t in rows if "vile" in t} == {d for d, _ in rows} - {d for d, _ in left}
    lines = {d: t for (d, _), t in brute_lines(left).items()}
    assert any(lines[d] != t for d, t in left)
    left = [(d, lines[d]) for d, t in left if lines[d].split() or not t.split()]
    first = {d: c for d, _, c in brute_components(left)}
    left = [(d, t) for d, t in left if first[d] == d]
    before = len(left)
    left = [(d, t) for d, t in left if not brute_contamination(t, items)[4]]
    assert before > len(left) > 20
    library = pieces.Pieces(open(model_path(), "rb").read()).library
    expected = Counter((d, len(t), tuple(library.encode(t, add_bos=True, add_eos=True))) for d, t in left)
    assert Counter((r["doc_id"], r["n_chars"], tuple(r["ids"])) for r in collect(corpus_pipeline.run(spark, place))) == expected


def test_stages_take_odd_rows(spark, documents, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, documents, sf_dir).count()
        assert stage(spark, empty, sf_dir).count() == 0
    assert make_documents(spark, []).count() == 0


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
