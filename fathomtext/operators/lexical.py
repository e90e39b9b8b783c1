"""Inverted indexes over terms and character trigrams, and BM25 on both.

An index is a set of plain tables.  A batch of queries is a table as well, so a
search is a chain of equi-joins that ends in a top-k per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from fathomtext.functions.exprs import bind, strip
from fathomtext.functions.skew import repeated_for_salts, salted_terms
from fathomtext.functions.stats import top_rows
from fathomtext.functions.text import (
    IDENTIFIER,
    TermTrie,
    identifiers,
    spaced_words,
    terms,
    with_normal_text,
    word_count,
    words,
)
from fathomtext.operators import scanning
from fathomtext.operators.fusion import rrf
from fathomtext.operators.pruning import Pruned, pruned_scores
from fathomtext.sources.staging import staged

# BM25 parameters and the floor of the inverse document frequency.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

# Fixed value: what counts as a listed term without Chinese characters.
ASCII_TERM = r"^[A-Za-z0-9µμ°²±×$%][-:/_.+×·A-Za-z0-9µμ°²±×$%]*$"

GRAM = 3
SALTS = 8


#: Positions in the body start here, so that no match runs from the heading into the body.
BODY = 1 << 30
#: Stands after the end of a text, so that its last characters start a trigram as well.
PAD = "\uffff"


@dataclass
class TermIndex:
    """``postings(term, chunk_id, positions, dl)``, ``lengths(chunk_id, dl)`` and ``stats(term, df, max_tf, min_dl)``.

    The frequency of a term is the number of its positions.  The statistics bound what a
    term can add to any score; without them they are counted from the postings.  Without ``postings`` the words of
    ``texts(chunk_id, heading, body)``, a blank around each, are read for each batch of queries.
    """

    postings: DataFrame | None
    lengths: DataFrame
    stats: DataFrame | None = None
    texts: DataFrame | None = None

    def with_postings(self) -> TermIndex:
        """The same with its postings, taken from the texts where there are none yet."""
        if self.postings is not None:
            return self
        listed = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
        tokens = F.concat(listed("heading"), F.array(F.lit(None).cast("string")), listed("body"))
        rows = self.texts.select("chunk_id", tokens.alias("tokens"))
        return TermIndex(staged(_term_postings(rows, []), "postings"), self.lengths)

    def term_stats(self) -> DataFrame:
        return term_stats(self.postings) if self.stats is None else self.stats


@dataclass
class GramIndex:
    """``grams(gram, chunk_id, positions)``, ``texts(chunk_id, heading, body)``, ``lengths``, ``stats(gram, n)``.

    Texts are in lower case.  Positions count characters from 0, those of the body from ``BODY``.  Without ``grams`` the
    texts are read for each batch of queries, see :mod:`fathomtext.operators.scanning`.
    """

    grams: DataFrame | None
    texts: DataFrame
    lengths: DataFrame
    stats: DataFrame | None = None

    def gram_stats(self) -> DataFrame:
        return gram_stats(self.grams) if self.stats is None else self.stats

    def with_grams(self) -> GramIndex:
        """The same with its trigrams, taken from the texts where there are none yet."""
        return self if self.grams is not None else GramIndex(staged(gram_postings(self.texts)), self.texts, self.lengths)


# --- building -----------------------------------------------------------------------


def term_index(
    chunks: DataFrame,
    id_col: str = "id",
    heading_col: str = "heading_path",
    text_col: str = "lexical_text",
    extra: list[str] | None = None,
    only_terms: DataFrame | None = None,
) -> TermIndex:
    """Terms index over heading and text; a gap keeps phrases inside a column.

    ``only_terms(term)`` limits the postings to the terms of a query batch, for
    a search without a stored index.
    """
    extra = extra or []
    tokens = bind(
        words(F.coalesce(F.col(heading_col), F.lit(""))),
        lambda h: F.concat(
            h, F.array(F.lit(None).cast("string")), words(F.col(text_col))
        ),
    )
    rows = chunks.select(F.col(id_col).alias("chunk_id"), *extra, tokens.alias("tokens"))
    postings = _term_postings(rows, extra)
    if only_terms is not None:
        postings = postings.join(only_terms, "term", "left_semi")
    dl = word_count(F.coalesce(F.col(heading_col), F.lit(""))) + word_count(F.col(text_col))
    lengths = chunks.select(F.col(id_col).alias("chunk_id"), *extra, dl.alias("dl"))
    return TermIndex(postings, lengths)


def term_texts(
    chunks: DataFrame,
    id_col: str = "id",
    heading_col: str = "heading_path",
    text_col: str = "lexical_text",
    extra: list[str] | None = None,
) -> TermIndex:
    """The words of heading and text for a search that reads them for each batch; no postings are kept.

    As in :func:`term_index`, a chunk without text is not found by its heading.
    """
    extra = extra or []
    heading = F.coalesce(F.col(heading_col), F.lit(""))
    texts = chunks.select(
        F.col(id_col).alias("chunk_id"), *extra,
        F.when(F.col(text_col).isNotNull(), spaced_words(heading)).alias("heading"), spaced_words(F.col(text_col)).alias("body"),
    )
    dl = word_count(heading) + word_count(F.col(text_col))
    lengths = chunks.select(F.col(id_col).alias("chunk_id"), *extra, dl.alias("dl"))
    return TermIndex(None, lengths, None, texts)


def _term_postings(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Positions of every term by chunk from ``rows(chunk_id, *extra, tokens)``, null tokens being gaps.

    A chunk lies in one row, so its postings are sorted where it lies and nothing is shuffled.
    """
    keys = ["chunk_id", *extra]
    schema = T.StructType(
        [T.StructField("term", T.StringType()), *(rows.schema[k] for k in keys), T.StructField("dl", T.IntegerType()),
         T.StructField("positions", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            found = lists.flatten().dictionary_encode()
            code = pc.fill_null(found.indices, -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            real = np.flatnonzero(code >= 0)
            if not len(real):
                continue
            dl = np.bincount(row[real], minlength=len(size))
            # Rows and places rise already, a stable sort keeps them so.
            order = real[np.argsort(code[real] * len(size) + row[real], kind="stable")]
            code, row, place = code[order], row[order], place[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place.astype(np.int32)))
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [found.dictionary.take(pa.array(code[first])), *(batch.column(c).take(at) for c in range(len(keys))),
                 pa.array(dl[row[first]].astype(np.int32)), held],
                names=schema.names,
            )

    return rows.select(*keys, "tokens").mapInArrow(run, schema)


def term_stats(postings: DataFrame, *by: str) -> DataFrame:
    """What bounds a term: chunks that hold it, its most occurrences in one, the shortest of them."""
    return postings.groupBy("term", *by).agg(
        F.count(F.lit(1)).alias("df"), F.max(F.size("positions")).alias("max_tf"), F.min("dl").alias("min_dl")
    )


def whole_stats(parts: DataFrame) -> DataFrame:
    """Statistics kept by part of the corpus, for all of it."""
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


def gram_stats(grams: DataFrame, *by: str) -> DataFrame:
    """Occurrences of each trigram."""
    return grams.groupBy("gram", *by).agg(F.sum(F.size("positions")).alias("n"))


def grams_of(text: Column) -> Column:
    """All overlapping trigrams of the lowered text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1)


def _positions(texts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram, row and position of every character of (heading, body) rows, sorted."""
    codes, rows, places = [], [], []
    for r, (heading, body) in enumerate(texts):
        for first, text in ((0, heading), (BODY, body)):
            if not text:
                continue
            c = np.frombuffer((text + PAD * (GRAM - 1)).encode("utf-32-le"), np.uint32).astype(np.uint64)
            codes.append(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
            rows.append(np.full(len(c) - 2, r, np.int32))
            places.append(np.arange(first, first + len(c) - 2, dtype=np.int32))
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    code, row, place = np.concatenate(codes), np.concatenate(rows), np.concatenate(places)
    # Rows and positions rise already, a stable sort keeps them so.
    order = np.argsort(code, kind="stable")
    return code[order], row[order], place[order]


def _gram_text(codes: np.ndarray) -> list[str]:
    mask = np.uint64((1 << 21) - 1)
    chars = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & mask, codes & mask], axis=1).astype(np.uint32)
    text = chars.tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)]


def gram_postings(texts: DataFrame, extra: list[str] | None = None, chars: int = 2_000_000) -> DataFrame:
    """Positions of every trigram of ``texts(chunk_id, *extra, heading, body)`` by chunk.

    Each task sorts the trigrams of some ``chars`` characters of its texts at a time.
    """
    keys = ["chunk_id", *(extra or [])]
    schema = T.StructType(
        [T.StructField("gram", T.StringType()), *(texts.schema[k] for k in keys), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()))
            start = 0
            while start < len(pairs):
                stop, total = start, 0
                while stop < len(pairs) and (stop == start or total < chars):
                    total += len(pairs[stop][0] or "") + len(pairs[stop][1] or "")
                    stop += 1
                code, row, place = _positions(pairs[start:stop])
                if len(code):
                    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
                    grams, at = np.unique(code[first], return_inverse=True)
                    names = pa.array(_gram_text(grams), pa.string()).take(pa.array(at))
                    held = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place))
                    mine = [batch.column(c).slice(start, stop - start).take(pa.array(row[first])) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([names, *mine, held], names=schema.names)
                start = stop

    return texts.select(*keys, "heading", "body").mapInArrow(run, schema)


def gram_index(
    chunks: DataFrame,
    id_col: str = "id",
    heading_col: str = "heading_path",
    text_col: str = "raw_markdown",
    extra: list[str] | None = None,
) -> GramIndex:
    extra = extra or []
    texts = chunks.select(
        F.col(id_col).alias("chunk_id"),
        *extra,
        F.lower(F.coalesce(F.col(heading_col), F.lit(""))).alias("heading"),
        F.lower(F.col(text_col)).alias("body"),
    )
    count = lambda c: F.greatest(F.length(c) - (GRAM - 1), F.lit(0))
    lengths = texts.select("chunk_id", *extra, (count("heading") + count("body")).alias("dl"))
    return GramIndex(gram_postings(texts, extra), texts, lengths)


def domain_terms(spark: SparkSession, path: str) -> DataFrame:
    """Term list of a domain: one term per line, ``#`` starts a comment."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("term"))
    return (
        lines.where((F.col("term") != "") & ~F.startswith("term", F.lit("#")))
        .select("term", F.col("term").rlike(ASCII_TERM).alias("is_ascii"))
        .distinct()
    )


def domain_trie(listed: DataFrame) -> TermTrie:
    """The non-ASCII terms of a list as a trie; a list beyond its limit is refused before it reaches the driver."""
    terms = listed.where(~F.col("is_ascii"))
    size = terms.agg(F.sum(F.length("term")).alias("n")).first()["n"] or 0
    if size > TermTrie.MAX_CHARS:
        raise ValueError(f"the domain terms have {size} characters, {TermTrie.MAX_CHARS} are the most")
    return TermTrie(r["term"] for r in terms.select("term").collect())


# --- queries ------------------------------------------------------------------------


def _query_parts(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_normal_text(
        queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query")), "query", "_q"
    )


def query_phrases(
    queries: DataFrame, id_col: str = "query_id", text_col: str = "query", known: Column | TermTrie | None = None
) -> DataFrame:
    """Phrases of each query: ``query_id, phrase, tokens, weight``.

    An identifier becomes the phrase of its parts; a repeated word weighs as
    often as it occurs.
    """
    q = F.col("_q")
    parts = F.concat(identifiers(q), terms(F.regexp_replace(q, IDENTIFIER, " "), known))
    exploded = _query_parts(queries, id_col, text_col).select(
        "query_id", F.explode(parts).alias("part")
    )
    tokens = exploded.select("query_id", words(F.col("part")).alias("tokens")).where(F.size("tokens") > 0)
    return tokens.groupBy("query_id", "tokens").agg(F.count(F.lit(1)).alias("weight")).select(
        "query_id", F.array_join("tokens", " ").alias("phrase"), "tokens", "weight"
    )


def query_substrings(
    queries: DataFrame, id_col: str = "query_id", text_col: str = "query", known: Column | TermTrie | None = None
) -> DataFrame:
    """Substrings of three characters or more each query asks for.

    A query without any is searched as a whole.
    """
    q = F.col("_q")
    parts = F.filter(
        F.concat(identifiers(q), terms(F.regexp_replace(q, IDENTIFIER, " "), known, fold=False)),
        lambda t: F.length(t) >= GRAM,
    )
    whole = strip(F.col("query"))
    chosen = bind(
        parts,
        lambda ps: F.when(F.size(ps) > 0, ps)
        .when(F.length(whole) >= GRAM, F.array(whole))
        .otherwise(F.array().cast("array<string>")),
    )
    return (
        _query_parts(queries, id_col, text_col)
        .select("query_id", F.explode(chosen).alias("t"))
        .groupBy("query_id", F.lower("t").alias("phrase"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


# --- matching -----------------------------------------------------------------------


def phrase_hits(phrases: DataFrame, index: TermIndex, salts: int = SALTS) -> DataFrame:
    """Occurrences of distinct phrases: ``phrase, chunk_id, dl, tf``.

    Single words read their frequency from the postings.  Longer phrases join
    each word's positions and keep the starts where all words line up.
    """
    distinct = phrases.select("phrase", "tokens").distinct()
    wanted = distinct.select(
        "phrase", F.size("tokens").alias("n"), F.posexplode("tokens").alias("off", "term")
    )
    matched = (
        salted_terms(index.postings, "chunk_id", salts)
        .join(repeated_for_salts(wanted, salts), ["term", "_salt"])
        .drop("_salt")
    )
    single = matched.where(F.col("n") == 1).select("phrase", "chunk_id", "dl", F.size("positions").cast("bigint").alias("tf"))
    starts = (
        matched.where(F.col("n") > 1)
        .select("phrase", "chunk_id", "dl", "n", F.explode("positions").alias("pos"), "off")
        .groupBy("phrase", "chunk_id", "dl", "n", (F.col("pos") - F.col("off")).alias("start"))
        .agg(F.count(F.lit(1)).alias("aligned"))
        .where(F.col("aligned") == F.col("n"))
    )
    longer = starts.groupBy("phrase", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return single.unionByName(longer)


def anchors_of(phrases: DataFrame, stats: DataFrame) -> DataFrame:
    """The two rarest trigrams of each distinct phrase: ``phrase, gram, off, anchors, covered``.

    ``covered`` says that the trigrams lie over the whole phrase, so that meeting at the right distance is a match.
    """
    grams = phrases.select("phrase").distinct().select("phrase", F.posexplode(grams_of(F.col("phrase"))).alias("off", "gram"))
    rarest = Window.partitionBy("phrase").orderBy("n", "off")
    every = Window.partitionBy("phrase")
    picked = (
        grams.join(stats, "gram", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("_at", F.row_number().over(rarest))
        .where("_at <= 2")
    )
    last = F.length("phrase") - GRAM
    return picked.select(
        "phrase", "gram", "off", F.count(F.lit(1)).over(every).cast("int").alias("anchors"),
        ((F.min("off").over(every) == 0) & (F.max("off").over(every) == last) & (last <= GRAM)).alias("covered"),
    )


def phrase_starts(phrases: DataFrame, index: GramIndex, salts: int = SALTS) -> DataFrame:
    """Where phrases may start: ``phrase, chunk_id, covered, starts``, all true matches among them.

    The positions of a phrase's two rarest trigrams meet at their distance; a row holds one chunk's.
    """
    anchors = anchors_of(phrases, index.gram_stats())
    return (
        salted_terms(index.grams.select("gram", "chunk_id", "positions"), "chunk_id", salts)
        .join(repeated_for_salts(anchors, salts), ["gram", "_salt"])
        .select("phrase", "chunk_id", "anchors", "covered", F.transform("positions", lambda p: p - F.col("off")).alias("starts"))
        .groupBy("phrase", "chunk_id", "anchors", "covered")
        # Two lists at most, one for each trigram.
        .agg(F.collect_list("starts").alias("lists"))
        .where(F.size("lists") == F.col("anchors"))
        .select(
            "phrase", "chunk_id", "covered",
            F.when(F.col("anchors") == 1, F.get("lists", F.lit(0)))
            .otherwise(F.array_intersect(F.get("lists", F.lit(0)), F.get("lists", F.lit(1)))).alias("starts"),
        )
        .where(F.size("starts") > 0)
    )


def substring_hits(phrases: DataFrame, index: GramIndex, salts: int = SALTS) -> DataFrame:
    """Exact substring matches of distinct phrases of three characters or more: ``phrase, chunk_id, tf``.

    Where the two trigrams leave characters of the phrase open, each place is compared with the text.
    """
    found = phrase_starts(phrases, index, salts)
    settled = found.where("covered").select("phrase", "chunk_id", F.size("starts").alias("tf"))
    place = F.col("start")
    there = F.when(place >= BODY, F.substring("body", place - BODY + 1, F.length("phrase"))).otherwise(
        F.substring("heading", place + 1, F.length("phrase"))
    )
    compared = (
        found.where("NOT covered").select("phrase", "chunk_id", F.explode("starts").alias("start"))
        .join(index.texts.select("chunk_id", "heading", "body"), "chunk_id")
        .where((place >= 0) & (there == F.col("phrase")))
        .groupBy("phrase", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )
    return settled.unionByName(compared)


def scanned_substring_hits(phrases: DataFrame, index: GramIndex) -> DataFrame:
    """The same matches by the same steps where only the texts are at hand: trigrams are taken from them now."""
    return substring_hits(phrases, GramIndex(None, index.texts, index.lengths).with_grams())


# --- scoring ------------------------------------------------------------------------


def bm25(weighted: DataFrame, hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Scores ``query_id, chunk_id, score``; larger is better.

    ``weighted(query_id, phrase, weight)`` meets ``hits(phrase, chunk_id, tf)``.
    Hits are laid out by chunk.  How the weights meet them follows from their sizes
    at run time: small ones are broadcast, and the sums then need no further
    shuffle; for large ones the adaptive join splits the phrases that are hot.
    """
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    n = totals.select("n").scalar()
    avgdl = totals.select("avgdl").scalar()
    # Counting over ``tf`` keeps its column, so this reuses the shuffle of the hits.
    frequency = hits.groupBy("phrase").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    inverse = frequency.select("phrase", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    saturated = (
        hits.select("phrase", "chunk_id", "tf").repartition("chunk_id")
        .join(lengths.select("chunk_id", "dl"), "chunk_id")
        .select("phrase", "chunk_id", part.alias("part"))
    )
    matched = saturated.join(weighted.join(inverse, "phrase"), "phrase")
    return matched.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("idf") * F.col("part")).alias("score")
    )


def ranked_by_score(scores: DataFrame, k: int, decimals: int = 9, tie: str = "chunk_id") -> DataFrame:
    """Top ``k`` per query; scores equal to ``decimals`` places tie on the id."""
    rounded = scores.withColumn("score", F.round("score", decimals))
    return top_rows(rounded, ["query_id"], [F.desc("score"), F.asc(tie)], k)


def _impact(tf: Column, dl: Column, avgdl: float) -> Column:
    """What an occurrence count adds for a weight of one: rises with ``tf``, falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _weights(phrases: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows of :func:`pruned_scores` from ``known(phrase, df, most)``, ``most`` bounding the impact of a phrase."""
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = F.col("weight") * F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))
    return phrases.select("query_id", "phrase", "weight").join(known, "phrase").select(
        "query_id", "phrase", "df", w.alias("w"), (w * F.col("most")).alias("bound")
    )


def _totals(lengths: DataFrame) -> tuple[int, float]:
    row = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    # Without any length all scores are over empty texts; one keeps the formula defined.
    return row["n"], row["avgdl"] or 1.0


def pruned_terms(phrases: DataFrame, index: TermIndex, k: int) -> Pruned:
    """BM25 over terms for the chunks that may be among the first ``k``.

    Single words take their bounds from the statistics and their hits from the postings as they lie; the longer phrases
    are matched once.
    """
    n, avgdl = _totals(index.lengths)
    single = phrases.where(F.size("tokens") == 1)
    longer = staged(phrase_hits(phrases.where(F.size("tokens") > 1), index), "phrases")
    impact = _impact(F.col("tf"), F.col("dl"), avgdl)
    words_known = index.term_stats().join(single.select(F.col("phrase").alias("term")).distinct(), "term", "left_semi").select(
        F.col("term").alias("phrase"), "df", _impact(F.col("max_tf"), F.col("min_dl"), avgdl).alias("most")
    )
    longer_known = longer.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"), F.max(impact).alias("most"))
    impacts = index.postings.select(
        F.col("term").alias("phrase"), "chunk_id", _impact(F.size("positions"), F.col("dl"), avgdl).alias("part")
    ).unionByName(longer.select("phrase", "chunk_id", impact.alias("part")))
    return pruned_scores(_weights(phrases, words_known.unionByName(longer_known), n), impacts, k)


def pruned_substrings(phrases: DataFrame, index: GramIndex, k: int) -> Pruned:
    """BM25 over substrings for the chunks that may be among the first ``k``; each phrase is matched once."""
    n, avgdl = _totals(index.lengths)
    hits = staged(substring_hits(phrases, index).join(index.lengths.select("chunk_id", "dl"), "chunk_id"), "phrases")
    impacts = hits.select("phrase", "chunk_id", _impact(F.col("tf"), F.col("dl"), avgdl).alias("part"))
    known = impacts.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    return pruned_scores(_weights(phrases, known, n), impacts, k)


def scanned_substrings(phrases: DataFrame, index: GramIndex, k: int) -> DataFrame:
    """BM25 over substrings from the texts alone, for the chunks that may be among the first ``k``: they are read once
    for the frequencies of the phrases and once for the scores."""
    n, avgdl = _totals(index.lengths)
    known = scanning.phrase_counts(phrases, index.texts).withColumn("most", F.lit(1.0))
    return scanning.best_scores(_weights(phrases, known, n), index.texts, k, avgdl, GRAM, K1, B)


def scanned_terms(phrases: DataFrame, index: TermIndex, k: int) -> DataFrame:
    """BM25 over terms from the words of the texts alone, like :func:`scanned_substrings`."""
    n, avgdl = _totals(index.lengths)
    known = scanning.phrase_counts(phrases, index.texts, scanning.Words).withColumn("most", F.lit(1.0))
    return scanning.best_scores(_weights(phrases, known, n), index.texts, k, avgdl, 1, K1, B, scanning.Words)


def search_terms(phrases: DataFrame, index: TermIndex, k: int = 50) -> DataFrame:
    if index.postings is None and scanning.small_batch(phrases):
        return staged(ranked_by_score(scanned_terms(phrases, index, k), k), "ranked")
    return staged(ranked_by_score(pruned_terms(phrases, index.with_postings(), k).scores, k), "ranked")


def search_substrings(phrases: DataFrame, index: GramIndex, k: int = 30) -> DataFrame:
    if index.grams is None and scanning.small_batch(phrases):
        return staged(ranked_by_score(scanned_substrings(phrases, index, k), k), "ranked")
    return staged(ranked_by_score(pruned_substrings(phrases, index.with_grams(), k).scores, k), "ranked")


def search_lexical(
    phrases: DataFrame,
    substrings: DataFrame,
    term_idx: TermIndex,
    gram_idx: GramIndex,
    terms_k: int = 50,
    grams_k: int = 30,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Both ranked lists fused by rank; raw scores are never mixed."""
    lists = (
        search_terms(phrases, term_idx, terms_k)
        .select("query_id", F.lit("terms").alias("source"), F.col("chunk_id").alias("item_id"), "rank")
        .unionByName(
            search_substrings(substrings, gram_idx, grams_k).select(
                "query_id", F.lit("trigram").alias("source"), F.col("chunk_id").alias("item_id"), "rank"
            )
        )
    )
    return rrf(lists, weights or {"terms": 0.9, "trigram": 0.7})


def substring_truth(
    queries: DataFrame, index: GramIndex, texts: DataFrame, id_col: str = "query_id", text_col: str = "query"
) -> DataFrame:
    """Every chunk whose text contains the query, case and all.

    ``texts(chunk_id, plain_text)`` holds the text as written.  A query of three characters or more is
    looked up by its two rarest trigrams; a shorter one is the beginning of trigrams, those over the end of a text
    included.  Candidates are rows of a query and a chunk, compared where the text lies.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("phrase"))
    if index.grams is None and scanning.small_batch(asked):
        return scanning.holders(asked, texts)
    index = index.with_grams()
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query"), F.lower(text_col).alias("phrase"))
    long, short = q.where(F.length("phrase") >= GRAM), q.where(F.length("phrase") < GRAM)
    near = phrase_starts(long, index).select("phrase", "chunk_id").join(long, "phrase").select("query_id", "query", "chunk_id")
    begins = F.explode(F.array(*[F.left("gram", F.lit(n)) for n in range(1, GRAM)]))
    pieces = index.grams.select("chunk_id", begins.alias("phrase")).join(short.select("phrase").distinct(), "phrase", "left_semi").distinct()
    few = pieces.join(short, "phrase").select("query_id", "query", "chunk_id")
    return (
        near.unionByName(few).join(texts.select("chunk_id", "plain_text"), "chunk_id")
        .where(F.contains("plain_text", "query"))
        .select("query_id", "chunk_id")
    )
