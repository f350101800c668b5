"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity has the grades 0 to GRADES - 1, and P(grade <= k) = sigmoid(theta_k - w x): one weight vector serves all
thresholds, which stay in order. The expected severity is the sum over k of P(grade > k).

Features are words (A-Z lower-cased; letters, digits and anything beyond ASCII) and their beginnings of PREFIXES
characters. Labels say only whether a document is toxic. Grade 0 is "not toxic"; toxic documents are spread over the
higher grades, in equal parts, by the sum of their features that speak for toxicity clearly. Weights can't be negative:
words speak for toxicity or have none.

The model is fitted on at most FIT_ROWS labelled documents, those with the smallest hash of doc_id; features are
counted there by a Spark aggregation, and all those that speak for toxicity by LEAST_Z or more are sent to the driver
with the rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.llm.decontaminate import WORD_BYTES
from pareframe.llm.rows import add_columns, column, map_texts, named, numbered
from pareframe.sources.tables import keep

GRADES = 4
FIT_ROWS = 20_000
PREFIXES = (4, 5, 6)
#: Contexts, at least, that a feature must have, and the least signed root of its likelihood ratio.
LEAST_ROWS, LEAST_Z = 3, 3.5
#: Probability of any severity from which a document is toxic. Most clean ones are under 0.05.
REJECT = 0.3
#: Features that are looked at in one step.
STEP = 1 << 18


def split(text: str | None) -> list[str]:
    """Words; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).decode("utf-8", "surrogatepass").split() if text else []


def contexts(text: str | None) -> dict[str, int]:
    """For each feature the word before its first occurrence, as a number.

    Features are counted by contexts, not by documents, when the strongest are chosen: in copies of a toxic document
    every word has one context, however many copies there are.
    """
    out, last = {}, ""
    for word in split(text):
        if word not in out:
            at = zlib.crc32(last.encode("utf-8", "surrogatepass"))
            out[word] = at
            for size in PREFIXES:
                if len(word) >= size:
                    out.setdefault(word[:size] + "*", at)
        last = word
    return out


class Ordinal:
    """Weights by feature, and thresholds in order."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self.shortest = {k[: PREFIXES[0]] for k in weights if k.endswith("*")}

    def values(self, text: str | None) -> dict[str, float]:
        """The features of ``text`` that have a weight: log1p of their count."""
        found: dict[str, int] = {}
        for word, n in Counter(split(text)).items():
            if word in self.weights:
                found[word] = found.get(word, 0) + n
            if word[: PREFIXES[0]] in self.shortest:
                for size in PREFIXES:
                    if len(word) >= size and (key := word[:size] + "*") in self.weights:
                        found[key] = found.get(key, 0) + n
        return {k: math.log1p(n) for k, n in sorted(found.items())}

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each k."""
        return self.above_of(self.values(text))

    def above_of(self, values: dict[str, float]) -> list[float]:
        score = sum(self.weights[k] * v for k, v in values.items())
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def fit(rows: list[tuple[dict[str, float], int]], names: list[str], grades: int = GRADES) -> Ordinal:
    """A model from (features, grade) rows."""
    place = {n: i for i, n in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    column = np.array([place[k] for x, _ in rows for k in x], dtype=np.int64)
    value = np.array([v for x, _ in rows for v in x.values()], dtype=float)
    return _descend(row, column, value, np.array([g for _, g in rows], dtype=np.int64), names, grades)


def _descend(row, column, value, grade, names: list[str], grades: int, steps: int = 400, l2: float = 1e-4) -> Ordinal:
    """Gradient descent (Adam) on the negative log likelihood, from zero; (row, column, value) are the features.

    What is computed for each feature is so for STEP of them at a time, so the driver holds little beside them.
    """
    n, size = max(1, len(grade)), len(names)
    parts = [(row[i : i + STEP], column[i : i + STEP], value[i : i + STEP]) for i in range(0, len(row), STEP)]
    # thresholds: the first, then logarithms of the gaps
    p = np.concatenate([np.zeros(size), [2.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        w, gaps = p[:size], np.exp(p[size + 1 :])
        theta = p[size] + np.concatenate([[0], np.cumsum(gaps)])
        score = sum((np.bincount(r, w[c] * v, len(grade)) for r, c, v in parts), np.zeros(len(grade)))
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        lo, hi = sigmoid(ends[grade] - score), sigmoid(ends[grade + 1] - score)
        lo, hi = np.where(grade == 0, 0, lo), np.where(grade == grades - 1, 1, hi)
        mass = np.maximum(hi - lo, 1e-12)
        dlo, dhi = lo * (1 - lo) / mass, hi * (1 - hi) / mass
        slope = (dhi - dlo) / n  # of the negative log likelihood by the score
        dtheta = np.bincount(np.minimum(grade, grades - 2), np.where(grade < grades - 1, -dhi, 0) / n, grades - 1)
        dtheta += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, dlo, 0) / n, grades - 1)
        later = np.cumsum(dtheta[::-1])[::-1]
        slopes = sum((np.bincount(c, slope[r] * v, size) for r, c, v in parts), np.zeros(size))
        g = np.concatenate([slopes + l2 * w, [later[0]], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * min(1.0, 2 - 2 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p[:size] = np.maximum(p[:size], 0)  # every feature speaks for toxicity
    theta = p[size] + np.concatenate([[0], np.cumsum(np.exp(p[size + 1 :]))])
    return Ordinal({k: float(x) for k, x in zip(names, p, strict=False)}, [float(t) for t in theta])


def _sample(documents: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled documents; of repeated ids all rows, with the larger label.

    Labels whose document is absent, or has no text, don't count towards ``bound``.
    """
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.join(documents.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most ``bound`` pairs of numbers
    return documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def train(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, grades: int = GRADES) -> Ordinal:
    """A model of severity. Without any toxic label nothing is severe: no weights, and high thresholds."""
    sample = keep(_sample(documents, labels, bound))
    toxic, rows = (x or 0 for x in sample.agg(F.sum("toxic"), F.count("*")).first())
    if not toxic or toxic == rows:
        return Ordinal({}, [math.inf if not toxic else -math.inf] * (grades - 1))

    def make_contexts():
        def run(batch: list[dict]) -> list[dict]:
            return [{"toxic": r["toxic"], "names": list(c), "before": list(c.values())} for r in batch for c in [contexts(r["text"])]]

        return run

    pairs = map_texts(sample, make_contexts, "toxic int, names array<string>, before array<long>")
    seen = pairs.select("toxic", F.explode(F.arrays_zip("names", "before")).alias("x")).select("toxic", "x.*").distinct()
    by = seen.groupBy(F.col("names").alias("name")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    # signed root of the likelihood ratio between "depends on toxicity" and "does not"
    gain = F.lit(0.0)
    for mine, among in ((F.col("t"), toxic), (F.col("n") - F.col("t"), rows - toxic)):
        expected = F.col("n") * (among / rows)
        gain = gain + F.when(mine > 0, mine * F.log(mine / expected)).otherwise(0.0)
        gain = gain + F.when(mine < among, (among - mine) * F.log((among - mine) / (among - expected))).otherwise(0.0)
    z = F.sqrt(F.greatest(2 * gain, F.lit(0.0))) * F.when(F.col("t") * rows >= F.col("n") * toxic, 1).otherwise(-1)
    strong = by.where((F.col("n") >= LEAST_ROWS) & (F.col("n") < rows)).select("name", z.alias("z"), "t", "n").where(F.col("z") >= LEAST_Z)
    # bounded by the words of at most ``bound`` documents
    strong = strong.collect()
    names = sorted(r.name for r in strong)
    clear = {r.name for r in strong if r.t >= 0.9 * r.n}
    chosen = sample.sparkSession.sparkContext.broadcast(Ordinal(dict.fromkeys(names, 1.0), []))
    place = {n: i for i, n in enumerate(names)}

    def make_values():
        def run(batch: list[dict]) -> list[dict]:
            out = []
            for r in batch:
                found = chosen.value.values(r["text"])
                out.append({"toxic": r["toxic"], "at": [place[k] for k in found], "value": list(found.values())})
            return out

        return run

    # at most ``bound`` rows, with the features that they have of the strong ones
    data = map_texts(sample, make_values, "toxic int, at array<int>, value array<double>").toArrow()
    is_toxic = data["toxic"].to_numpy() > 0
    lists = data["at"].combine_chunks()
    row = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
    column, value = lists.flatten().to_numpy(), data["value"].combine_chunks().flatten().to_numpy()
    # what came has been copied into whole columns
    del data
    pa.default_memory_pool().release_unused()
    amount = np.bincount(row, value * np.array([n in clear for n in names], dtype=float)[column], len(is_toxic))
    cuts = np.quantile(amount[is_toxic], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(is_toxic, 1 + np.searchsorted(cuts, amount), 0)
    return _descend(row, column, value, grade, names, grades)


def _scored(documents: DataFrame, model: Ordinal) -> DataFrame:
    """The documents with numbered columns (rows.numbered), severity, grade and toxic."""
    # bounded: weights of the strong features of FIT_ROWS documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        ordinal = shared.value

        def run(batch) -> list:
            found = [ordinal.values(t) for t in batch["text"].to_pylist()]
            above = [ordinal.above_of(x) for x in found]
            toxic = [bool(x) and p[0] >= REJECT for x, p in zip(found, above, strict=True)]
            return [[round(sum(p), 6) for p in above], [sum(q >= 0.5 for q in p) for p in above], toxic]

        return run

    return add_columns(numbered(documents), {"text": column(documents, "text")}, make, "severity double, grade int, toxic boolean")


def score(documents: DataFrame, model: Ordinal) -> DataFrame:
    """``documents`` with severity (expected grade), grade (the median one) and toxic (a grade over 0 has a
    probability of REJECT or more, and the text has a feature that speaks for it).

    Whole texts are read; null and empty ones have no features. Columns of these names are replaced, others may have
    any names; repeated rows and null ids just stay.
    """
    return named(_scored(documents, model), documents.columns, ["severity", "grade", "toxic"])


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their columns, those named as columns of ``score`` included.

    Documents without a feature that speaks for toxicity stay, so those without words do, and all where no label is toxic. Repeated rows stay or go together.
    """
    return named(_scored(documents, train(documents, labels)).where(~F.col("toxic")), documents.columns)
