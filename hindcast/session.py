"""Session settings used by the tests, the bench and local runs.

On a cluster the caller's session is used as it is; nothing here is forced on it.
"""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "hindcast", cores: str = "*", memory: str = "8g",
                  partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the session names in ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a
    folder of its own, and one on a cluster an error: executors can't see a folder of the driver's machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hindcast-ckpt-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the checkpoint folder and read back.

    For frames that several jobs read: the lineage ends here, a lost executor re-reads files, and each reader still
    scans only the columns and rows it needs. The folder's own retention removes the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
