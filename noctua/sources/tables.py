"""Tables of others: present or not, with a declared schema; bounded files; JSON that may not parse."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

MOST_FILE_BYTES = 512 * 1024


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system it belongs to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(hadoop)] if files.exists(hadoop) else []


def deleted(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a local session gets a
    temporary one; a cluster has no folder that all its machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noctua-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/noctua/{spark.sparkContext.applicationId}"


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once for the application, under a name that tells its input, and read from the shared folder."""
    path = f"{kept_dir(spark)}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A step's rows as a table of the application's folder: later steps that read it several times begin there."""
    path = f"{kept_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table with at least the declared columns, or an empty one if it is missing; missing columns are null."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([], schema).unionByName(found.select(*(c for c in found.columns if c in spark.createDataFrame([], schema).columns)), allowMissingColumns=True)


def availability(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(name, "available" if exists(spark, path) else "missing") for name, path in paths.items()], "name string, status string")


def bounded_files(spark: SparkSession, path: str, glob: str = "*", most: int = MOST_FILE_BYTES) -> DataFrame:
    """(path, content) of files of at most ``most`` bytes, as text; larger ones are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).select("path", F.col("content").cast("string").alias("content"), "modificationTime")


def json_files(files: DataFrame) -> DataFrame:
    """Files whose content is JSON, with it as a variant; others are left out."""
    return files.withColumn("json", F.try_parse_json("content")).where("json IS NOT NULL")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added to a table of an older or newer schema: columns that one lacks are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def noisy(path, noise: tuple[str, ...]):
    """Whether a path has a part that is named like a build or tool directory, or hidden."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.isin(*noise) | (F.startswith(p, F.lit(".")) & (F.length(p) > 1)))


def shallow(path, root_depth: int, most: int):
    """Whether a path lies at most ``most`` levels under a root of ``root_depth`` parts."""
    return F.size(F.filter(F.split(path, "/"), lambda p: p != "")) - root_depth <= most


def toml_string(content, key: str):
    """A quoted value of a line ``key = "value"``."""
    return F.nullif(F.regexp_extract(content, rf'(?m)^\s*{key}\s*=\s*"([^"\n]*)"', 1), F.lit(""))


def toml_array(content, key: str):
    """The quoted values of ``key = [...]``."""
    inside = F.regexp_extract(content, rf"(?ms)^\s*{key}\s*=\s*\[(.*?)\]", 1)
    return F.regexp_extract_all(inside, F.lit('"([^"]*)"'), F.lit(1))
