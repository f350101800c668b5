"""The corpus pipeline over ``documents``.

Toxic documents go; lines that repeat earlier ones go, and documents of which nothing is left; of near copies one
stays; documents with benchmark passages go; what is left is encoded. Each stage reads what the one before has
written. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pareframe.llm import decontaminate, linededup, ngrams, pieces, toxicity
from pareframe.llm.queries import model_path
from pareframe.sources.tables import discard, shared_folder, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model fitted on the labelled ones among ``docs``.

    Documents without words, null or empty, are not toxic. Repeated rows stay or go together. Without a toxic label all
    stay; an empty table gives no rows. Further columns stay, whatever their names.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match earlier ones; n_chars follows.

    Earlier is by doc_id, null first, then by place. Documents of which nothing is left go; those that had no words stay,
    null texts too. Rows with the same doc_id and text are one document. Further columns stay.
    """
    return linededup.deduplicated(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id; null ids come last.

    Of repeated rows one stays. Documents without words are linked with nothing and stay. Further columns stay.
    """
    return ngrams.one_of_each(docs)


def remove_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; those without words, and all of them without a benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their byte spans, beside all columns but the text; null counts as empty."""
    return pieces.encode_documents(docs, model_path()).drop("text")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", remove_near_copies),
    ("benchmark_decontamination", remove_leaked),
    ("sentencepiece", encode),
]

#: SQL can't express the classifier, the set joins over whole texts at this size, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    What a stage has read goes when the next one's input is written; the last one's input stays for the result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(place), place
    return STAGES[-1][1](spark, docs, sf_dir)
