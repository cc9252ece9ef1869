"""Sources and sinks of the reference's file formats.

Positional files are the hard part: the reference zips files by row position, and Spark has no
row order. ``text_lines`` numbers physical lines exactly without a global sort, and every other
positional reader is built on it.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# ---------------------------------------------------------------- schemas (no inference)

# Column names of the files that are read and written.

DEFINITION = T.StructType([T.StructField(n, T.StringType()) for n in ("target", "gloss", "example")])
DICTIONARY = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "gloss", "example")])
SENSE_LINE = ("sense", "ignore1", "ignore2", "gloss", "ignore3", "ignore4")
EXAMPLE_LINE = ("sense", "context")
WIC_LINE = ("target", "pos", "indexes", "example1", "example2")
WIC_RESULT = T.StructType([T.StructField("sbert", T.StringType()), T.StructField("model", T.StringType()),
                           T.StructField("accuracy", T.DoubleType())])
WSI_RESULT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("suffix", "model_folder", "ft_model_name", "model")],
    T.StructField("filter_", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in ("APD", "APDP", "ARI", "RI", "PUR")],
    T.StructField("n_cluster", T.ArrayType(T.LongType())), T.StructField("n_true_cluster", T.ArrayType(T.LongType())),
])


def scratch_dir(spark: SparkSession, name: str = "io") -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexsense-{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- S7 text lines with exact line numbers


def part_number(col: str) -> Column:
    """Number of a Spark part file: names are padded to five digits, so they don't sort beyond 99,999."""
    return F.coalesce(F.regexp_extract(col, r"/part-(\d+)", 1).try_cast("long"), F.lit(-1))


def text_lines(spark: SparkSession, path: str, per_file: bool = True, **opts) -> DataFrame:
    """(file, line_no, value) with 0-based physical line numbers.

    ``monotonically_increasing_id`` is contiguous within a split, so per (file, split) we take the
    smallest id and the line count; a running sum of counts over the splits of a file (or of the
    whole folder when ``per_file`` is false, for ordered part files: by part number, then name) is the
    split's first line. That table has one row per split.
    """
    raw = spark.read.options(**opts).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_id"),
        "value")
    splits = raw.groupBy("file", "_blk").agg(F.min("_id").alias("_min"), F.count("*").alias("_n"))
    splits = splits.withColumn("_part", part_number("file"))
    part = [] if not per_file else ["file"]
    w = Window.partitionBy(*part).orderBy("file", "_blk") if part else Window.orderBy("_part", "file", "_blk")
    splits = splits.withColumn("_off", F.sum("_n").over(w) - F.col("_n"))
    out = raw.join(splits.select("file", "_blk", "_min", "_off"), ["file", "_blk"])
    return out.select("file", (F.col("_off") + F.col("_id") - F.col("_min")).alias("line_no"), "value")


def file_key(pattern: str, group: int = 1, col: str = "file") -> Column:
    """A key (target, dataset ...) taken from the file path."""
    return F.regexp_extract(F.col(col), pattern, group)


# ---------------------------------------------------------------- S1-S6 readers


def read_tsv_lines(spark: SparkSession, path: str, names, per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Headerless TSV, quoting off. Returns (rows, rejected): a line with more fields than
    names is rejected (pandas warns and skips it); a shorter line is null-filled and kept; a
    blank line is skipped. Line numbers are physical, counted before any line is dropped."""
    # pandas skips blank lines (skip_blank_lines); numbering stays physical
    lines = text_lines(spark, path, per_file=per_file).where(F.col("value") != "")
    parts = F.split("value", "\t")
    n = len(names)
    fields = [F.try_element_at(parts, F.lit(i + 1)).alias(nm) for i, nm in enumerate(names)]
    df = lines.select("file", "line_no", F.size(parts).alias("_k"), *fields)
    ok = df.where(F.col("_k") <= n).drop("_k")
    bad = df.where(F.col("_k") > n).select("file", "line_no", F.col("_k").alias("n_fields"))
    return ok, bad


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: header TSV with default quoting."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"').csv(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file holding one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, with_line: bool = False,
               per_file: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; with ``with_line`` also the physical line number."""
    if not with_line:
        return spark.read.schema(schema).json(path)
    lines = text_lines(spark, path, per_file=per_file)
    return lines.select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")


def scan_sets(spark: SparkSession, root: str, schema: T.StructType, split: str = "train",
              exclude=("slang", "wiki")) -> DataFrame:
    """Every dataset's ``split`` under a ``dataset=/split=`` tree except the excluded ones;
    the predicates are on partition columns, so whole folders are pruned before any file is read."""
    df = spark.read.schema(T.StructType(list(schema.fields) + [
        T.StructField("dataset", T.StringType()), T.StructField("split", T.StringType())])).json(root)
    return df.where((F.col("split") == split) & ~F.col("dataset").isin(*exclude))


# ---------------------------------------------------------------- S9-S12 sinks


def write_sets(df: DataFrame, path: str, keys=("dataset", "split"), mode: str = "overwrite") -> None:
    """One JSON-lines folder per key combination (``dataset=../split=..``)."""
    df.write.mode(mode).partitionBy(*keys).json(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated with a header."""
    df.write.mode(mode).options(sep="\t", header=True, quote='"', escape='"').csv(path)


def write_lines(df: DataFrame, path: str, order: str, col: str = "value", partitions: int | None = None) -> None:
    """One text line per row in ``order``: range-partitioned and sorted within partitions, so
    part files in name order hold the rows in order (read back with ``text_lines(per_file=False)``)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, order).sortWithinPartitions(order).select(F.col(col).alias("value")) \
        .write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append result records to one result table."""
    df.write.mode("append").json(path)


def zip_lines(left: DataFrame, right: DataFrame, on: str = "line_no") -> DataFrame:
    """Positional zip of two row-aligned inputs; the job fails when their lengths differ
    (as ``add_column`` does). The check rides along the join, no extra action."""
    j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full")
    check = F.when(F.col("_l").isNull() | F.col("_r").isNull(),
                   F.raise_error(F.lit("zip: inputs have different lengths"))).otherwise(F.lit(True))
    return j.where(check).drop("_l", "_r")
