"""Session settings for local runs; on a cluster the submitter's settings win."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus=8, app="tractwise", memory="20g", checkpoints=None):
    """A session of one machine; its checkpoint folder may be local because there is no other machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", checkpoints or tempfile.mkdtemp(prefix="spark-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df):
    """Checkpoint into the folder named by spark.checkpoint.dir, which driver and executors share."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
