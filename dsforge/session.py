"""Session defaults, table readers and the few helpers that touch the running cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster use the one that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dsforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A core is worth its own partition from so many bytes of input on.
BYTES_A_CORE = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spreads small input over all cores: a single small file is one partition, which would leave a Python stage on one core.

    Decided by the sizes of the plan's tables, which the driver knows without running anything; larger input, which has a partition for each core anyway, is not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * BYTES_A_CORE else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in ``spark.checkpoint.dir``; where none is set, local sessions (tests) get one of their own and clusters an error: executors don't share the driver's disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if at is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="dsforge-checkpoint-")
        sc.setCheckpointDir(at)


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder: computed once, compact, readable by column, and still there when an executor is lost."""
    import uuid

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
