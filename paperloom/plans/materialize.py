"""Cut lineage by writing a table to the shared checkpoint folder.

Iterative operators re-read what they wrote, so a lost executor costs one
round and not the whole history.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or the folder set on its context; a temporary one only on a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="paperloom-")
    return _LOCAL_DIRS[app]


def ensure_checkpointing(spark: SparkSession) -> None:
    """Let iterative library code (tree ensembles) cut its lineage too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stage: DataFrame) -> None:
    """Delete the files of a written stage that nothing reads any more."""
    spark = stage.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {file.rsplit("/", 1)[0] for file in stage.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
