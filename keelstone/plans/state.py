"""Tables in the folder that the driver and all executors share, to cut lineage between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a local
    session (tests) gets a temporary folder; any other session is refused,
    because a machine-local folder would not be visible to its executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="keelstone-")
    return _OWN_FOLDERS[app]


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file to any store that Spark can open."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def materialise(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/keelstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
