"""Helpers shared by the corpus operators: table access, shared scratch tables, word and line rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; the complement makes a word.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the session names none and runs on one machine (as in tests) a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barspan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back, which cuts its lineage; the second is its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def leading_rows(df: DataFrame, n: int, *order: Column) -> list[Row]:
    """The first n rows in an order without ties, at the driver.

    A sort with a limit has every task send n rows, which grows with the input. Here rows are dealt to ranges of the order,
    and ranges are read from the first on until there are enough.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).limit(n).collect()


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body names it within lambdas."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words of the text in order; null and empty texts have none."""
    # One kind of blank, as splitting at a single character needs no pattern.
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as df's own columns (in any case) make necessary."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
