"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes for a document, against it, or abstains.  Expectation-maximisation over
the counts of vote patterns estimates how each rule votes on good and on bad documents, and the posterior probability of being good decides.  There are 3^8 vote
patterns at most, so the model is fitted on a table of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomtext.functions.exprs import bind
from fathomtext.llm.common import SPACE, WORD_SQL, read_table, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
STEPS = 40
# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for on with as by this are be was",
    "der die das und ist von den mit zu nicht für auf ein eine",
    "le la les de des et un une en est que qui pour dans sur par",
    "el los las y que del por con se su para al lo",
)
RULES = ("symbols", "repeats", "lines", "capitals", "word_length", "function_words", "sentences", "length")


def text_words(text: Column) -> Column:
    """Words of a text as an array, empty for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def repeated_words(ws: Column) -> Column:
    """Words covered by a window that occurs twice or more in the array.

    Windows are hashed first; only a text with two equal hashes sorts its windows, by
    their words, so the count never rests on a hash.
    """
    width = WINDOW
    window = lambda i: [F.get(ws, i + j) for j in range(width)]
    starts = F.sequence(F.lit(0), F.size(ws) - width)

    def covered(s: Column) -> Column:
        same = lambda k, other: F.get(s, other)["w"].eqNullSafe(F.get(s, k)["w"])
        dup = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        places = F.sort_array(F.transform(dup, lambda k: F.get(s, k)["i"]))
        return bind(
            places,
            lambda p: F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0).cast("long"),
                lambda total, k: total
                + F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(width))).cast("long"),
            ),
        )

    ordered = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i")))
    )
    joined = lambda a, b, apart: F.slice(
        F.zip_with(a, F.slice(b, apart + 1, F.greatest(F.size(b) - apart, F.lit(0))), lambda x, y: F.xxhash64(x, y)),
        1,
        F.greatest(F.size(b) - apart, F.lit(0)),
    )
    # Hashes of single words grow to windows of 2, 4 and 5 words by shifting the array.
    some_equal = bind(
        F.transform(ws, lambda w: F.xxhash64(w)),
        lambda one: bind(
            bind(joined(one, one, 1), lambda two: joined(two, two, 2)),
            lambda four: bind(joined(four, one, 4), lambda h: F.size(F.array_distinct(h)) < F.size(h)),
        ),
    )
    none = F.lit(0).cast("long")
    return F.when(F.size(ws) < width + 1, none).when(some_equal, bind(ordered, covered)).otherwise(none)


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, each computed inside its row without a shuffle."""
    function_words = sorted({f for line in FUNCTION_WORDS for w in line.split() for f in (w, w.capitalize())})
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_SQL))

    def counted(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(function_words))).cast("long").alias("n_function"),
        )

    of_lines = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return docs.select(
        "doc_id",
        bind(text_words(F.col("text")), counted).alias("w"),
        of_lines.alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[.?!](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_ends"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_ends")


def votes(m: DataFrame) -> DataFrame:
    """Adds ``votes``: 1 (good), -1 (bad) or 0 (abstains) for each rule."""

    def vote(bad: Column, good: Column | None = None) -> Column:
        against = F.when(bad, -1)
        return (against if good is None else against.when(good, 1)).otherwise(0)

    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    n = F.col("n_words")
    function, ends = per("n_function", "n_words"), per("n_ends", "n_words")
    length = per("word_chars", "n_words")
    rules = {
        "symbols": vote(per("n_symbols", "n_words") > 0.1),
        "repeats": vote(per("n_repeat_words", "n_words") > 0.15),
        "lines": vote(per("n_dup_lines", "n_lines") > 0.3),
        "capitals": vote(per("n_upper", "word_chars") > 0.3),
        "word_length": vote((length < 2.5) | (length > 12)),
        "function_words": vote((function < 0.05) & (n >= 20), function >= 0.15),
        "sentences": vote(((ends > 0.3) | (ends < 0.01)) & (n >= 20)),
        "length": vote(n < 10, n >= 30),
    }
    return m.withColumn("votes", F.array(*[rules[r] for r in RULES]))


def fit(patterns: DataFrame, steps: int = STEPS) -> DataFrame:
    """Posterior of each vote pattern (``votes``, ``n``) after expectation-maximisation.

    One row holds all patterns; the iterations are a fold over it, so no value
    leaves the query.  ``good`` and ``bad`` hold for each rule how often it votes -1, 0
    and 1 on documents of that class, from which its accuracy follows.  The start is
    a soft majority vote, which fixes the class that is called good.
    """
    m = len(RULES)
    each = F.sequence(F.lit(0), F.lit(m - 1))
    cells = F.sequence(F.lit(0), F.lit(3 * m - 1))

    def posterior(state: Column, v: Column) -> Column:
        odds = F.aggregate(
            each,
            F.log(state["pi"] / (1 - state["pi"])),
            lambda total, j: total
            + bind(j * 3 + F.get(v, j) + 1, lambda at: F.log(F.get(state["good"], at) / F.get(state["bad"], at))),
        )
        return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))

    def step(state: Column, patterns: Column) -> Column:
        weighed = F.transform(
            patterns,
            lambda q: bind(
                posterior(state, q["votes"]),
                lambda p: F.struct(
                    q["votes"].alias("votes"), (q["n"] * p).alias("good"), (q["n"] * (1 - p)).alias("bad")
                ),
            ),
        )

        def update(ws: Column) -> Column:
            total = lambda f: F.aggregate(ws, F.lit(0.0), lambda s, q: s + f(q))
            voted = lambda q, at: F.get(q["votes"], F.floor(at / 3).cast("int")) + 1 == at % 3
            share = lambda side, whole: F.transform(
                cells,
                lambda at: (total(lambda q: F.when(voted(q, at), q[side]).otherwise(F.lit(0.0))) + 1) / (whole + 3),
            )
            sums = F.struct(total(lambda q: q["good"]).alias("good"), total(lambda q: q["bad"]).alias("bad"))
            return bind(
                sums,
                lambda t: F.struct(
                    ((t["good"] + 1) / (t["good"] + t["bad"] + 2)).alias("pi"),
                    share("good", t["good"]).alias("good"),
                    share("bad", t["bad"]).alias("bad"),
                ),
            )

        return bind(weighed, update)

    likely = lambda against, silent, favour: F.flatten(
        F.array_repeat(F.array(F.lit(against), F.lit(silent), F.lit(favour)), m)
    )
    start = F.struct(
        F.lit(0.5).alias("pi"), likely(0.1, 0.5, 0.4).alias("good"), likely(0.4, 0.5, 0.1).alias("bad")
    )
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    fitted = one.select(
        "patterns",
        F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: step(s, F.col("patterns"))).alias("model"),
    )
    return fitted.select(F.explode("patterns").alias("q"), "model").select(
        "q.votes", posterior(F.col("model"), F.col("q.votes")).alias("p_good")
    )


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each document with its counts, ``votes`` and ``p_good``, kept if that reaches the threshold.

    Defined cases: a null text has no words and fails the base rule, as do texts of
    fewer than 10 words or with more than 20 % repeated words; null ids and repeated
    rows are judged row by row; an empty table gives no rows; other columns are ignored.
    """
    judged = written(votes(measures(docs)))
    patterns = judged.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        judged.join(F.broadcast(fit(patterns)), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
