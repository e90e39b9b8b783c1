"""Session settings shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings a job may apply to whatever session it is given.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The rule repeats the exploded expression in a filter below the explode; here
    # that expression is a whole tokenization or parse.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the session lacks; cluster-level settings stay untouched.

    Rules that the caller has excluded stay excluded.
    """
    for key, value in RUNTIME_CONF.items():
        now = spark.conf.get(key, None)
        if key.endswith("excludedRules"):
            rules = [r for r in (now or "").split(",") if r]
            if value not in rules:
                spark.conf.set(key, ",".join([*rules, value]))
        elif now != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "fathomtext", memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.maxPartitionBytes", "16m")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only when that
    is unset, and only on a local master, is a temporary folder chosen.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    chosen = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(chosen)
    return chosen
