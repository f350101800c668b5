"""Language identification by fusing evidence, Bayes' rule over what is known of a page.

Evidence of a row: the likelihood of its text (hashed byte trigrams, naive Bayes), the language that its markup
declares, the suffix of its address, and the prior of its host. How reliable declarations and suffixes are, and
what hosts are like, is counted over all rows by grouped aggregations of the text posteriors: hosts shrink towards
their domain, domains towards the whole (``SMOOTH`` pseudo-rows on each level). Given the language, the kinds of
evidence count as independent.

The text model is fitted on at most FIT_ROWS labelled documents, those with the smallest hash of doc_id.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareframe.llm.rows import map_texts
from pareframe.sources.tables import keep

FIT_ROWS = 20_000
#: Languages that a model may have, BUCKETS counts each; with more, fitting ends with an error.
LANGUAGES = 256
BUCKETS = 1 << 16
SMOOTH = 4.0
#: Trigrams beyond this many don't add to the weight of a text, whose likelihood is the mean over all of them: trigrams
#: of one text depend on each other, and a long text would else outweigh all other evidence.
WEIGHT = 60

ENTITY = re.compile(rb"&[#a-z0-9]+;")
#: Letters lower-cased; bytes beyond ASCII stay; all else is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str | bytes | None) -> np.ndarray:
    """Bucket of each three bytes of the text's letters, spaces run together."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    data = b" ".join(data.translate(LETTERS).split())
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def visible(html: str) -> bytes:
    """The text of a page in lower case (A-Z only): no tags, comments, scripts, styles or entities.

    Each byte is looked at a few times at most, whatever is left open: a comment or script without an end counts as a
    tag, a tag without an end as text.
    """
    data, out, at, absent = html.encode("utf-8", "surrogatepass").lower(), [], 0, set()

    def after(mark: bytes, start: int) -> int:
        """The place after ``mark``, or 0; what isn't there from one place on isn't there from later ones."""
        if mark in absent or (found := data.find(mark, start)) < 0:
            absent.add(mark)
            return 0
        return found + len(mark)

    def closed(name: bytes, start: int) -> int:
        while start := after(b"</" + name, start):
            rest = start
            while data[rest : rest + 1].isspace():
                rest += 1
            if data[rest : rest + 1] == b">":
                return rest + 1
            start = rest
        return 0

    while (tag := data.find(b"<", at)) >= 0:
        out.append(data[at:tag])
        name = next((n for n in (b"script", b"style") if data.startswith(n, tag + 1)), None)
        whole = name is not None and not (data[tag + 1 + len(name) : tag + 2 + len(name)].isalnum() or data[tag + 1 + len(name) : tag + 2 + len(name)] == b"_")
        end = closed(name, tag + 1) if whole else after(b"-->", tag + 4) if data.startswith(b"<!--", tag) else 0
        end = end or after(b">", tag)
        if not end:
            at = tag + 1
            break
        at = end
    return ENTITY.sub(b" ", b" ".join([*out, data[at:]]))


def train_text(documents: DataFrame, bound: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log likelihoods by bucket and language, of documents with a ``lang``.

    Null texts, languages and ids don't count. More than LANGUAGES languages are an error.
    """
    given = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    chosen = given.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most ``bound`` numbers
    sample = given.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")

    def make():
        def run(rows: list[dict]) -> list[dict]:
            total: dict[str, np.ndarray] = {}
            for r in rows:
                total.setdefault(r["lang"], np.zeros(BUCKETS, dtype=np.int64))
                total[r["lang"]] += np.bincount(trigrams(r["text"]), minlength=BUCKETS)
            return [{"lang": k, "buckets": np.flatnonzero(v).tolist(), "n": v[v > 0].tolist()} for k, v in total.items()]

        return run

    counted = map_texts(sample, make, "lang string, buckets array<int>, n array<long>")
    pairs = counted.select("lang", F.explode(F.arrays_zip("buckets", "n")).alias("x")).groupBy("lang", "x.buckets").agg(F.sum("x.n").alias("n"))
    languages = sorted(r.lang for r in pairs.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in the labelled documents")
    # at most BUCKETS rows for each of LANGUAGES languages
    rows = pairs.toPandas()
    table = np.full((BUCKETS, max(1, len(languages))), 0.5)
    for i, x in enumerate(languages):
        part = rows[rows.lang == x]
        table[part.buckets.to_numpy(dtype=int), i] += part.n.to_numpy(dtype=float)
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def _soft(log: list[float]) -> list[float]:
    top = max(log)
    weights = [math.exp(x - top) for x in log]
    return [w / sum(weights) for w in weights]


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool) -> DataFrame:
    """``rows`` with log likelihoods (``ll``) and the posterior of the text alone (``soft``) in place of their text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in rows.schema if f.name != "text"]

    def make():
        languages, table = shared.value

        def run(batch: list[dict]) -> list[dict]:
            for r in batch:
                text = r.pop("text")
                seen = trigrams(visible(text) if markup and text else text)
                # a row of the table for each distinct trigram only: BUCKETS at most, however long the text
                distinct, times = np.unique(seen, return_counts=True)
                mean = times @ table[distinct] / max(1, len(seen))
                r["ll"] = [round(float(x), 6) for x in mean * min(len(seen), WEIGHT)]
                r["soft"] = _soft(r["ll"])
            return batch

        return run

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return map_texts(rows, make, f"{kind}, ll array<double>, soft array<double>")


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: key, host, domain, suffix, declared, text."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    rows = pages.select(F.col("page_id").alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(declared, F.lit("")).alias("declared"), F.col("html").alias("text"))
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    long = F.size(F.split("host", r"\.")) >= 2
    return rows.select("key", "host", F.when(long, domain).otherwise(F.col("host")).alias("domain"), F.regexp_extract("host", r"\.([a-z]+)$", 1).alias("suffix"), "declared", "text")


def document_rows(documents: DataFrame) -> DataFrame:
    """Documents as rows of evidence. They have no markup and no address; their source takes the host's place."""
    source = F.coalesce("source", F.lit(""))
    return documents.select(F.col("doc_id").alias("key"), source.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), F.lit("").alias("declared"), "text")


def _sums(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Soft counts of languages by the given columns: ``c`` in order, and their sum ``t``."""
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n)]
    return rows.groupBy(*by).agg(*sums, F.count("*").cast("double").alias("t")).select(*by, F.array(*(F.round(f"s{i}", 6) for i in range(n))).alias("c"), "t")


def _others(counts):
    """Counts without the row's own share in them."""
    return F.zip_with(counts, "soft", lambda c, s: F.greatest(c - s, F.lit(0.0)))


def _shrunk(counts, total, prior):
    """Shares of the languages among the other rows, drawn towards those of the level above."""
    return F.zip_with(_others(counts), prior, lambda c, p: (c + SMOOTH * p) / (total - 1 + SMOOTH))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` with lang and posterior, from their likelihoods and the counts over all other rows.

    A row is left out of its own priors, so its text is evidence once. Ties go to the language that is first.
    """
    n = len(languages)
    rows = keep(rows)
    # kept, so that joins read them straight from a shuffle and the rows of a large host can be split there
    whole = keep(_sums(rows, n).select(F.col("c").alias("all_c"), F.col("t").alias("all_t")))
    domains = _sums(rows, n, "domain").withColumnsRenamed({"c": "domain_c", "t": "domain_t"})
    hosts = keep(_sums(rows, n, "domain", "host").join(domains, "domain"))
    out = rows.join(hosts, ["domain", "host"]).crossJoin(F.broadcast(whole))
    prior = F.array(*[F.lit(1.0 / n)] * n)
    for level, (counts, total) in enumerate((("all_c", "all_t"), ("domain_c", "domain_t"), ("c", "t"))):
        out = out.withColumn(f"prior{level}", _shrunk(F.col(counts), F.col(total), prior))
        prior = F.col(f"prior{level}")
    total = F.zip_with("ll", prior, lambda a, p: a + F.log(p))
    none = F.array(*[F.lit(0.0)] * n)
    for name in ("declared", "suffix"):
        # P(value | language), smoothed with half a pseudo-row for each of SMOOTH values; an absent value says nothing
        counts = keep(_sums(rows.where(F.col(name) != ""), n, name).select(name, F.col("c").alias(f"{name}_c")))
        out = out.join(counts, name, "left")
        chance = F.zip_with(_others(f"{name}_c"), _others("all_c"), lambda c, m: F.log((c + 0.5) / (m + 0.5 * SMOOTH)))
        total = F.zip_with(total, F.coalesce(chance, none), lambda a, b: a + b)
    out = out.withColumn("total", total)
    top = F.array_max("total")
    best = F.array_position("total", top).cast("int")
    mass = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return out.select("key", F.element_at(F.array(*map(F.lit, languages)), best).alias("lang"), F.round(1 / mass, 4).alias("posterior"))


def identify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The language of every page and document: page_id, doc_id (one of them null), lang, posterior.

    Texts without letters have no likelihood of their own and get what their host, declaration and suffix say; so
    do nulls. Rows are kept one by one, repeated ones too. Without any labelled document there are no languages:
    lang and posterior are null. Ties go to the language that is first in order. Other columns are not used.
    """
    model = train_text(documents)
    if not model[0]:
        both = pages.select("page_id", F.lit(None).cast("long").alias("doc_id")).unionByName(documents.select(F.lit(None).cast("long").alias("page_id"), "doc_id"))
        return both.withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double")})
    of_pages = fuse(text_evidence(page_rows(pages), model, markup=True), model[0])
    of_documents = fuse(text_evidence(document_rows(documents), model, markup=False), model[0])
    null = F.lit(None).cast("long")
    return of_pages.select(F.col("key").alias("page_id"), null.alias("doc_id"), "lang", "posterior").unionByName(of_documents.select(null.alias("page_id"), F.col("key").alias("doc_id"), "lang", "posterior"))
