"""What the operators of this subpackage share: reading, written tables, words."""

from __future__ import annotations

import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fathomtext.session import ensure_checkpoint_dir, tune

#: Words are runs of characters other than the six ASCII white space characters.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE_BYTES = SPACE.encode()

ODD = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder as it is."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, read back.

    A lost executor costs no recomputation of what stands above, and a table
    that is read twice is computed once.  ``tidy`` asks the driver's JVM to collect its
    garbage: shuffle files of what the table replaces are deleted only then.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if tidy:
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables from which everything needed has been written again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    """A written table with ``out``, the place of a row in its group from 0.

    Rows are dealt by ranges of groups and order, so no group lies in one task; a row's place is its
    place in its range plus the rows of the group in the ranges before.  Only counts of (range, group) are
    gathered.
    """
    placed = written(
        df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    ranges = placed.groupBy(*groups, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    upto = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*groups, "_part", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part).join(offsets, [*groups, "_part"])
        .withColumn(out, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_before")
    )


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all other characters as they are."""
    # Bytes know no other letters.
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    """Words of a text as it is."""
    return WORD.findall(text) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, each distinct word of a batch hashed once.

    The memo is emptied when it holds ``limit`` words, so it stays small
    whatever the vocabulary.
    """

    def __init__(self, limit: int = 300_000):
        self.memo: dict[str, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for token in set(tokens).difference(memo):
            memo[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` word hashes; the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * ODD + hashes[i : n - width + 1 + i])
    return out


def slices(texts: list[str | None], chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of rows of about ``chars`` characters, one row at least."""
    out, start, total = [], 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and total + n > chars:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
