"""MinHash near-duplicate detection.

Universal hash minima of word shingles, banding, verification of signatures, exact
verification on the full texts, and connected components by large-star and small-star.

Texts with equal shingle sets form a class at once.  In each band bucket the classes are
first compared with one pivot (a star), not with each other; linked classes become one
component.  Only classes that still lie in different components of a bucket are compared
further, block by block, so no link between different texts is lost and a large group
of copies that one pivot links costs about one comparison per band and member.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomtext.llm.common import WordHashes, lower_ascii, mix, read_table, shingle_hashes, slices, words, written
from fathomtext.llm.components import components

BANDS, ROWS = 28, 4
BLOCK = 256


def _hash_parameters(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hashes (a * x + b) >> 32 mod 2^64."""
    i = np.arange(1, count + 1, dtype=np.uint64)
    return mix(i * np.uint64(2 * seed + 1)) | np.uint64(1), mix(i + np.uint64(seed << 20))


A, B = _hash_parameters(BANDS * ROWS)


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signature (one row of 32-bit minima) of each run of shingle hashes."""
    out = np.empty((len(starts), len(A)), np.uint32)
    for j, (a, b) in enumerate(zip(A, B)):
        out[:, j] = np.minimum.reduceat(((shingles * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _signed(batches, k: int):
    """Signatures of the documents of Arrow batches (doc_id, text, own)."""
    hashed = WordHashes()
    for batch in batches:
        ids, texts, own = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        for start, stop in slices(texts, 1_000_000):
            sets = []
            for text in texts[start:stop]:
                if text:
                    sets.append(np.unique(shingle_hashes(hashed(words(lower_ascii(text))), k)))
                else:
                    sets.append(np.zeros(0, np.uint64))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            signature: list[bytes | None] = [None] * len(sets)
            one = np.zeros(len(sets), np.int64)
            two = np.zeros(len(sets), np.int64)
            full = np.flatnonzero(n)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum(n[full]) - n[full]
                for i, row in zip(full, minima(flat, starts)):
                    signature[i] = row.tobytes()
                # Two sums over the set identify it together with its size.
                one[full] = np.add.reduceat(mix(flat), starts).view(np.int64)
                two[full] = np.bitwise_xor.reduceat(mix(flat * np.uint64(0xA24BAED4963EE407)), starts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, stop - start).cast(pa.int64()),
                    own.slice(start, stop - start),
                    pa.array(n),
                    pa.array(one),
                    pa.array(two),
                    pa.array(signature, pa.binary()),
                ],
                ["doc_id", "own", "n_shingles", "set1", "set2", "signature"],
            )


def _banded(batches):
    """One row (bucket, id) for each band of each signature."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(ids), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        # The last five bits name the band.
        key = (key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["bucket", "id"]
        )


def _least_agreement(threshold: float) -> int:
    """Equal minima that a pair at the threshold has, but for five standard deviations."""
    n = len(A)
    return max(1, math.floor(n * threshold - 5 * math.sqrt(n * threshold * (1 - threshold))))


def _agreeing(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose signatures agree as a pair at the threshold would, with ``agree``."""
    least = _least_agreement(threshold)
    sig = signatures.select("id", "signature")
    both = pairs.join(sig.withColumnsRenamed({"id": "u", "signature": "su"}), "u").join(
        sig.withColumnsRenamed({"id": "v", "signature": "sv"}), "v"
    )

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                    for c in ("su", "sv")
                )
                agree = (x == y).sum(axis=1)
                keep = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u").filter(keep), batch.column("v").filter(keep), pa.array(agree[agree >= least])],
                    ["u", "v", "agree"],
                )

    return both.select("u", "v", "su", "sv").mapInArrow(compare, "u long, v long, agree long")


def _full_set(text: str | None, k: int, hashed: WordHashes) -> np.ndarray:
    """The whole shingle set of a text as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(hashed(words(lower_ascii(text))), k)) if text else np.zeros(0, np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity."""
    first = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u")
    both = first.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")

    def check(batches):
        hashed = WordHashes()
        last, x = None, None
        for batch in batches:
            keep = []
            for v, tu, tv in zip(batch.column("v").to_pylist(), batch.column("tu"), batch.column("tv")):
                if last != v:
                    last, x = v, _full_set(tv.as_py(), k, hashed)
                keep.append(_linked(x, _full_set(tu.as_py(), k, hashed), percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "tu", "tv").mapInArrow(check, "u long, v long")


def _labelled(df: DataFrame, comps: DataFrame, name: str = "id", out: str = "comp") -> DataFrame:
    """Adds the component so far; a class without a link is its own."""
    c = comps.select(F.col("node").alias(name), F.col("component").alias(out))
    return df.join(c, name, "left").withColumn(out, F.coalesce(out, F.col(name)))


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between their members."""
    ends = _labelled(_labelled(links, comps, "u", "cu"), comps, "v", "cv").select(
        F.col("cu").alias("u"), F.col("cv").alias("v")
    )
    onward = components(ends)
    known = _labelled(comps, onward, "component", "c2").select(
        "node", F.col("c2").alias("component")
    )
    return written(known.unionByName(onward.join(comps.select("node"), "node", "left_anti")))


def _rest(members: DataFrame, signatures: DataFrame, texts: DataFrame, comps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that share a bucket but lie in different components.

    Components that meet in a bucket form a family.  The largest one of a family need not
    be compared with itself: each class of the others meets every member, in blocks
    of both.  Inside a block a pair is counted in full if it shares a band, its
    signatures agree as a pair at the threshold would, and no link has joined its
    components yet, so only links leave it, not pairs.
    """
    least = _least_agreement(percent / 100)
    m = written(_labelled(members, comps))
    mixed = m.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    met = written(m.join(mixed.select("bucket", "low"), "bucket").select("id", "comp", "low").distinct())
    families = written(components(met.select(F.col("comp").alias("u"), F.col("low").alias("v"))))
    inside = written(met.select("id", "comp").distinct().join(families.withColumnsRenamed({"node": "comp", "component": "family"}), "comp"))
    sizes = inside.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    plan = (
        sizes.groupBy("family")
        .agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
        .select(
            "family",
            F.col("top.comp").alias("main"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("odd_blocks"),
            F.ceil(F.col("all") / BLOCK).cast("int").alias("all_blocks"),
        )
    )

    def full_sets(batches):
        hashed = WordHashes()
        for batch in batches:
            sets = [_full_set(t, k, hashed).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "full"])

    wanted = texts.join(inside.select(F.col("id").alias("doc_id")), "doc_id").select("doc_id", "text")
    here = written(
        inside.join(plan, "family")
        .join(signatures.select("id", "signature"), "id")
        .join(wanted.mapInArrow(full_sets, "id long, full binary"), "id")
    )
    again = here.select(*[F.col(c).alias(c) for c in here.columns])
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    odd = here.where(F.col("comp") != F.col("main")).withColumn("x", block("odd_blocks", 1)).withColumn("y", spread("all_blocks"))
    every = again.withColumn("y", block("all_blocks", 2)).withColumn("x", spread("odd_blocks"))
    cols = ["family", "x", "y", "id", "comp", "signature", "full"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = (np.frombuffer(b"".join(f["signature"]), np.uint32).reshape(len(f), -1) for f in (left, right))
            lc, rc = left["comp"].to_numpy(), right["comp"].to_numpy()
            sets = [[np.frombuffer(x, np.uint64) for x in f["full"]] for f in (left, right)]
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            for i in range(len(a)):
                same = b == a[i]
                agree = same.sum(axis=1)
                hit = np.flatnonzero((rc != lc[i]) & (agree >= least))
                hit = hit[same[hit].reshape(len(hit), BANDS, ROWS).all(axis=2).any(axis=1)]
                for j in hit[np.argsort(-agree[hit], kind="stable")]:
                    p, q = root(lc[i]), root(rc[j])
                    if p != q and _linked(sets[0][i], sets[1][j], percent):
                        parent[p] = q
                        out.append((left["id"].iat[i], right["id"].iat[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    keys = ["family", "x", "y"]
    return odd.select(cols).groupBy(keys).cogroup(every.select(cols).groupBy(keys)).applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    sets of k-word shingles, A-Z in lower case.

    Defined cases: a text with fewer than k words is one shingle; null texts and texts
    without words have an empty set, are linked with nothing and kept; a null doc_id
    takes no part in links and keeps its row with a null component; rows that repeat an
    id form one node, which is linked by any of their texts; a very long text is one set
    in the memory of its task; ties are impossible, as the smallest id names a component;
    an empty table gives no rows; other columns are ignored.
    """
    threshold = percent / 100
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text's own hash tells the rows of one id apart.
    source = source.withColumn("own", F.xxhash64("text"))
    schema = "doc_id long, own long, n_shingles long, set1 long, set2 long, signature binary"
    signed = written(source.select("doc_id", "text", "own").mapInArrow(lambda b: _signed(b, k), schema))
    filled = signed.where(F.col("signature").isNotNull() & F.col("doc_id").isNotNull())

    # Equal sets are one class, numbered once written; the row with the smallest id stands for it.
    same = ["n_shingles", "set1", "set2"]
    classes = filled.groupBy(*same).agg(F.min(F.struct("doc_id", "own")).alias("rep"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    signatures = classes.select("id", "signature")
    membership = filled.join(classes.select(*same, "id", F.col("rep.doc_id").alias("rep")), same).select("doc_id", "id", "rep")

    bands = signatures.mapInArrow(_banded, "bucket long, id long")
    pivots = bands.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = written(bands.join(pivots.select("bucket", "pivot"), "bucket"))
    stars = members.where(F.col("id") != F.col("pivot")).select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    candidates = written(_agreeing(stars, signatures, threshold))
    members = members.select("bucket", "id")

    # Texts of classes that share a bucket with another class, each the text of the class's own row.
    shared = classes.select("id", "rep.doc_id", "rep.own").join(members.select("id").distinct(), "id")
    texts = source.join(shared, ["doc_id", "own"]).groupBy("id").agg(F.min("text").alias("text"))
    texts = written(texts.withColumnRenamed("id", "doc_id"))

    # The likeliest pivot of each class first; the others only where components differ.
    best = candidates.groupBy("u").agg(F.max_by("v", F.struct("agree", -F.col("v"))).alias("v"))
    comps = written(components(_confirmed(best, texts, k, percent)))
    comps = _merge(comps, written(_rest(members, signatures, texts, comps, k, percent)))

    # Rows that repeat an id tie the classes of their texts together.
    several = membership.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v < last")
    twice = membership.join(several.select("doc_id", "v"), "doc_id")
    tied = written(twice.where(F.col("id") != F.col("v")).select(F.col("id").alias("u"), "v").distinct())
    if tied.limit(1).count():
        comps = _merge(comps, tied)

    # The smallest document of a component names it.
    ranked = comps.join(classes.select(F.col("id").alias("node"), F.col("rep.doc_id").alias("rep")), "node")
    names = ranked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = comps.join(names, "component").select(F.col("node").alias("id"), "component_id")
    found = (
        membership.join(named, "id", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    )
    return (
        signed.select("doc_id", "n_shingles")
        .join(found, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)
