"""Session settings and the shared checkpoint location.

Library code never builds its own session on a cluster; it uses the active
one. ``local_session`` exists for tests, the bench and the smoke entry.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON objects with a repeated key keep the last value, as json.loads does
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "feedlens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and
    is used as is. Only when it is unset (local tests) do we point the
    context at a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="feedlens-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the re-read.

    Later steps keep column pruning, filters and size estimates, and a lost
    executor costs only its running tasks.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: First parts of the names of all folders that this package makes in the shared folder.
FOLDERS = ("cut-", "llm-", "landing-", "report-", "store-", "stream-")


def drop_cuts(spark: SparkSession) -> None:
    """Delete every cut point and landed or staged table of this session; call when its results have been written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind in FOLDERS:
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"{kind}*")) or []:
            fs.delete(found.getPath(), True)
