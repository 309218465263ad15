"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own. A session that is handed in keeps its settings.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", app: str = "logothek", partitions: int = 8, memory: str = "4g", **conf: str) -> SparkSession:
    """A local session with the settings this library is tuned for."""
    b = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", memory)
    for k, v in {**CONF, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; a file or a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most splits of an input that ``spread`` moves: with the usual 128 MB a split no more than a GB.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores if the input is a small file or two of at most FEW_SPLITS splits on half the cores, else as it is.

    Rows are the same either way. Select the columns that are needed first: only they are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits <= FEW_SPLITS and 2 * splits <= cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that spark.checkpoint.dir names.

    Written blocks survive the loss of executors, and rows whose order or partition depends on sampling stay as they are.
    A folder of our own is set only where a local session names none, as in tests; a cluster must name a shared one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="logothek-"))
    return df.checkpoint(eager=True)
