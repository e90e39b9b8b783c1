"""Language of web pages by fusion of evidence.

A character model gives text likelihoods.  From its verdicts over all pages, grouped
aggregation estimates how languages go with declared markup languages and with address
suffixes, and how they are spread over each host; a host's prior is smoothed towards its
domain's, and that towards the prior of all pages.  The posterior is the product.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fathomtext.functions.stats import top_rows
from fathomtext.llm.common import read_table, slices, written

FEATURES = 1 << 15
#: At most so many labelled texts of each language are fitted on.
SAMPLE_PER_LANGUAGE = 300
#: Weight of a trigram, whose neighbours are not independent of it.
TEXT_WEIGHT = 0.1
#: Pages that a parent's prior counts for, and rows that overall shares count for.
HOST_WEIGHT = 5.0
SHARE_WEIGHT = 20.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_NOT_LETTERS = re.compile(r"[^\w\s]|[\d_]")


def page_text(page: str | None) -> str:
    """What a reader sees of a page, roughly."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page))) if page else ""


def trigram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, count) arrays of hashed byte trigrams of each text, in lower case."""
    out = []
    for text in texts:
        clean = " " + " ".join(_NOT_LETTERS.sub(" ", text.lower()).split()) + " "
        b = np.frombuffer(clean.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(b) < 3:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
        feature = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
        counts = np.bincount(feature, minlength=FEATURES)
        some = np.flatnonzero(counts)
        out.append((some, counts[some]))
    return out


def fit_text_model(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities of the trigrams in each."""
    names = sorted(set(langs))
    totals = np.full((len(names), FEATURES), 0.5)
    for lang, (features, counts) in zip(langs, trigram_counts(texts)):
        totals[names.index(lang), features] += counts
    return names, np.log(totals / totals.sum(axis=1, keepdims=True)) if names else totals


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` texts of each language, the first by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")]
    ids = top_rows(known.select("doc_id", "lang"), ["lang"], order, per_language).select("doc_id")
    return known.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "text")


def evidence(pages: DataFrame, names: list[str], weights: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text) with the text's normalised likelihoods."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    count = len(names)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for a, b in slices(texts, 2_000_000):
                for features, counts in trigram_counts([page_text(t) for t in texts[a:b]]):
                    score = TEXT_WEIGHT * (shared.value[:, features] @ counts) if len(features) else np.zeros(count)
                    p = np.exp(score - score.max()) if count else score
                    rows.append(p / p.sum() if count else p)
            arrays = [c for i, c in enumerate(batch.columns) if i != 1]
            kept = [n for i, n in enumerate(batch.schema.names) if i != 1]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, pa.list_(pa.float64()))], [*kept, "text"])

    url, page = F.col("url").cast("string"), F.col("html").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    declared = F.lower(
        F.regexp_extract(F.coalesce(page, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,8})""", 1)
    )
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), page.alias("html"), host.alias("host"), declared.alias("declared"))
    schema = T.StructType(
        [f for f in source.schema.fields if f.name != "html"] + [T.StructField("text", T.ArrayType(T.DoubleType()))]
    )
    return source.mapInArrow(run, schema).select(
        "page_id",
        "host",
        F.substring_index("host", ".", -2).alias("domain"),
        F.substring_index("host", ".", -1).alias("suffix"),
        "declared",
        "text",
    )


def _vector(count: int, cell) -> Column:
    """An array with one cell for each language."""
    return F.array(*[cell(i) for i in range(count)]).cast("array<double>")


def _sums(df: DataFrame, key: str, count: int, out: str) -> DataFrame:
    """Soft counts of the languages by a key, added up before they are shuffled."""
    parts = df.groupBy(key).agg(*[F.sum(F.get("text", F.lit(i))).alias(f"_{i}") for i in range(count)])
    return parts.select(key, _vector(count, lambda i: F.col(f"_{i}")).alias(out))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) of every page.

    ``docs`` (doc_id, lang, text) are the labelled texts of the character model.

    Defined cases: a null page has no text and no declared language, a null or odd address no
    host, and their evidence is left out; a null page_id is kept; repeated rows are
    pages like others; ties go to the language first in order; without labelled texts
    the language is null; an empty table gives no rows; other columns are ignored.
    """
    sample = labelled_sample(docs).orderBy("doc_id").collect()
    names, weights = fit_text_model([r["text"] for r in sample], [r["lang"] for r in sample])
    n = len(names)
    base = written(evidence(pages, names, weights))
    if not n:
        none = F.lit(None).cast("string")
        return base.select("page_id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("confidence"))

    total = base.agg(*[F.sum(F.get("text", F.lit(i))).alias(f"t{i}") for i in range(n)]).first()
    mass = [float(x or 0.0) for x in total]
    prior = [(m + 1) / (sum(mass) + n) for m in mass]
    hosts, domains = written(_sums(base, "host", n, "of_host")), _sums(base, "domain", n, "of_domain")
    shares = {
        key: _sums(base.where(F.col(key) != ""), key, n, f"of_{key}").select(F.col(key).alias(f"_{key}"), f"of_{key}")
        for key in ("declared", "suffix")
    }
    met = base.join(hosts, "host").join(domains, "domain")
    for key, table in shares.items():
        met = met.join(table, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")

    cell = lambda c, i: F.get(c, F.lit(i))
    whole = lambda c: sum((cell(c, i) for i in range(n)), F.lit(0.0))
    # What the page itself added to its host and domain is taken out again.
    less = lambda c, i: F.greatest(cell(c, i) - cell("text", i), F.lit(0.0))
    rest = lambda c: F.greatest(whole(c) - 1, F.lit(0.0))
    of_domain = lambda i: (less("of_domain", i) + HOST_WEIGHT * prior[i]) / (rest("of_domain") + HOST_WEIGHT)
    of_host = lambda i: (less("of_host", i) + HOST_WEIGHT * of_domain(i)) / (rest("of_host") + HOST_WEIGHT)

    def share(key: str, i: int) -> Column:
        """P(value | language) over P(value), drawn to 1."""
        c = f"of_{key}"
        given = (cell(c, i) + SHARE_WEIGHT * whole(c) / sum(mass)) / (mass[i] + SHARE_WEIGHT)
        return F.when(F.col(c).isNull(), F.lit(1.0)).otherwise(given / (whole(c) / sum(mass)))

    posterior = met.withColumn(
        "p",
        _vector(
            n,
            lambda i: F.greatest(cell("text", i), F.lit(1e-300))
            * F.when(F.col("host") == "", F.lit(prior[i])).otherwise(of_host(i))
            * share("declared", i)
            * share("suffix", i),
        ),
    )
    langs = F.array(*map(F.lit, names))
    best = lambda c: F.element_at(langs, F.array_position(c, F.array_max(c)).cast("int"))
    return posterior.select(
        "page_id",
        "host",
        "declared",
        best(F.col("text")).alias("text_lang"),
        best(F.col("p")).alias("lang"),
        (F.array_max("p") / F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("confidence"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
