"""Pieces the operators of this folder share: tables, words, working folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six ASCII spaces.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_folder(spark: SparkSession) -> str:
    """This application's folder for working tables, deleted when the application ends.

    It lies in ``spark.checkpoint.dir``; the warehouse folder, which a cluster shares as well,
    stands in where that setting is missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts lineage, so that a lost executor costs no recomputation of what lies before, and keeps
    every reader on the very same rows.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that nothing reads any more."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(conf).delete(path, True)


_worker_tool: dict[Hashable, object] = {}


def worker_tool(key: Hashable, build: Callable[[], object]) -> object:
    """The one large helper that a Python worker keeps between tasks.

    Workers outlive the tasks of an operator; the first task of another one drops what it left.
    """
    if key not in _worker_tool:
        _worker_tool.clear()
        _worker_tool[key] = build()
    return _worker_tool[key]


def words(text: Column) -> Column:
    """The words of ``text``; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Working column names that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    made = {}
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        made[name] = new
    return made
