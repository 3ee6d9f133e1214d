"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (``spark.checkpoint.dir``); see ``session.checkpoint_dir``."""
    return checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, so a lost executor
    costs a re-read, and a plan that uses the table twice computes it once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name``: the place of each row, from 0, in the order in which the
    files of the table hold them (by the number in a part file's name, then by row). A scan
    itself keeps no such order: it packs and splits files by size. A ``df`` that is no scan is
    written first."""
    try:
        meta = df.metadataColumn("_metadata")
        rows = df.select("*", meta["file_name"].alias("_file"), meta["row_index"].alias("_row"))
    except AnalysisException:
        return positioned(written(df, "positioned"), name)
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long")
    # one row per file, whatever it holds
    before = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_file").alias("_of"), F.coalesce(F.sum("_n").over(
            Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), F.col("_file") == F.col("_of")).select(
        *df.columns, (F.col("_before") + F.col("_row")).alias(name))


def whole_text(col: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """True for the rows kept away from training: crc32 of the id's decimal text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
