"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one machine gets a temporary folder; a cluster, whose executors could not see that, gets an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="corpuslens-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def _path(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/corpuslens/{name}-{uuid.uuid4().hex}"
    hadoop_path, fs = _path(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, sorted; none if it isn't there."""
    hadoop_path, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def read_text(spark: SparkSession, path: str) -> str:
    hadoop_path, fs = _path(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, there as a whole or not at all; one that exists already is an error."""
    hadoop_path, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.part-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(hadoop_path) or not fs.rename(part, hadoop_path):
        fs.delete(part, False)
        raise FileExistsError(path)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() gave and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)
