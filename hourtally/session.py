"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Everything is stored and grouped in UTC; a JSON object may repeat a key, in
# which case the last one counts.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "hourtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; cluster settings stay untouched."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|\Z)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="hourtally-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(shared)
    return context.getCheckpointDir() or shared


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a table written once to shared storage, for steps that use it repeatedly.

    It is computed exactly once and outlives the loss of any executor. Without
    a ``folder`` the table stays in the checkpoint folder.
    """
    spark = df.sparkSession
    folder = folder or ensure_checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the checkpoint folder, removed at the end."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
