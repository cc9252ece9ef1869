"""Multi-line records (S1 quoted CSV, S4 JSON arrays) read over the splits of a file.

A record may start and end anywhere, and whether a byte is inside quotes depends on all bytes before it. So the file
is read in pieces (lines of a CSV file; the text up to each ``}`` of a JSON file, which also cuts an array
written on one line), and every piece gets a state map: whether it ends inside quotes if it starts outside
(``e0``) and if it starts inside (``e1``). Maps compose, so the state before each piece is a prefix scan:
within a split over its pieces, then over the splits of a file (one row each). The same scan sums depths and
counts records. Then each record's pieces meet by (file, record) and are parsed; no file is one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .files import part_number

SPLIT = ("file", "blk")


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, blk, id, value): texts between ``end`` characters, ``id`` in order within a split."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("id"), "value")


def _before(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _entry(df: DataFrame, keys, order: str) -> DataFrame:
    """``df`` with s0 and s1: the state before each row when its group starts outside (0) or inside (1) quotes.

    A map (e0, e1) either fixes the state (e0 = e1), flips it or keeps it: the state is that of the last fixing
    row before, flipped as often as rows flip since."""
    w = _before(order, *keys)
    flips = F.coalesce(F.sum(F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0)).over(w), F.lit(0))
    df = df.withColumn("_f", flips)
    fixed = F.last(F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("s"), F.col("_f").alias("f"))), ignorenulls=True).over(w)
    df = df.withColumn("_c", fixed)
    state = lambda start: F.pmod(F.when(F.col("_c").isNotNull(), F.col("_c.s") + F.col("_f") - F.col("_c.f"))
                                 .otherwise(F.col("_f") + start), F.lit(2)).cast("int")
    return df.withColumn("s0", state(0)).withColumn("s1", state(1)).drop("_f", "_c")


def _states(pieces: DataFrame) -> DataFrame:
    """``pieces`` (with e0, e1) with ``inside``: 1 where a piece starts inside quotes."""
    local = _entry(pieces, SPLIT, "id")
    end = lambda s: F.max_by(F.when(F.col(s) == 0, F.col("e0")).otherwise(F.col("e1")), "id")
    splits = _entry(local.groupBy(*SPLIT).agg(end("s0").alias("e0"), end("s1").alias("e1")), ["file"], "blk")
    start = splits.select(*SPLIT, F.col("s0").alias("_s"))
    out = local.join(start, list(SPLIT))
    return out.withColumn("inside", F.when(F.col("_s") == 0, F.col("s0")).otherwise(F.col("s1"))).drop("e0", "e1", "s0", "s1", "_s")


def _sum_before(pieces: DataFrame, value: str, out: str) -> DataFrame:
    """``pieces`` with the sum of ``value`` over all pieces of the file before this one."""
    splits = pieces.groupBy(*SPLIT).agg(F.sum(value).alias("_t"))
    splits = splits.select(*SPLIT, F.coalesce(F.sum("_t").over(_before("blk", "file")), F.lit(0)).alias("_o"))
    local = F.coalesce(F.sum(value).over(_before("id", *SPLIT)), F.lit(0))
    return pieces.withColumn("_l", local).join(splits, list(SPLIT)).withColumn(out, F.col("_o") + F.col("_l")).drop("_o", "_l")


def _records(pieces: DataFrame, glue: str) -> DataFrame:
    """(file, rec, text): the pieces of each record (``rec``, from 0 in each file) put together in order."""
    parts = F.sort_array(F.collect_list(F.struct("blk", "id", "value")))
    return pieces.groupBy("file", "rec").agg(parts.alias("p")).select(
        "file", "rec", F.array_join(F.transform("p", lambda x: x["value"]), glue).alias("text"))


def _order() -> Column:
    """Order of records over all files: part number (names are padded to five digits only), name, record."""
    return F.struct(part_number("file").alias("part"), "file", "rec").alias("_order")


# ---------------------------------------------------------------- S1


def _csv_maps(line: str, sep: str) -> tuple[Column, Column]:
    """State map of a CSV line: a quote opens only at the start of a field, doubled quotes stay inside."""
    s = rf"\Q{sep}\E"
    quoted = r'"(?:[^"]|"")*+"'

    def open_at_end(text: Column) -> Column:  # closed fields become x; a quote left at the start of a field is open
        return F.regexp_replace(text, f"(?s)(^|{s}){quoted}", "$1x").rlike(f'(^|{s})"').cast("int")

    c = F.col(line)
    rest = F.regexp_replace(c, r'(?s)^(?:[^"]|"")*+"', "x")  # after the quote that closes the open field
    return open_at_end(c), F.when(c.rlike(r'(?s)^(?:[^"]|"")*+"'), open_at_end(rest)).otherwise(F.lit(1))


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """The rows of quoted CSV files (doubled-quote escapes, line breaks in quotes) with ``_order``, their order
    over all files. Blank lines between records are skipped; with ``header`` each file's first record is too. A
    quote that is never closed takes the rest of its file into one record, as with any reader."""
    e0, e1 = _csv_maps("value", sep)
    lines = _states(_pieces(spark, path, "\n").withColumn("e0", e0).withColumn("e1", e1))
    lines = lines.withColumn("_new", F.when(F.col("inside") == 0, 1).otherwise(0))
    lines = _sum_before(written(lines), "_new", "_r").withColumn("rec", F.col("_r") + F.col("_new") - 1)
    rows = _records(lines.select("file", "rec", "blk", "id", "value"), "\n")
    rows = rows.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where((F.col("text") != "") & (F.col("rec") >= int(header)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("text", fields, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(parsed.alias("r"), _order()).select("r.*", "_order")


# ---------------------------------------------------------------- S4


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of files that hold one JSON array each, with ``_order``, their order over all files. The
    array may be on one line or on many; elements that are not objects are left out."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # escapes are inside strings only
    flips = F.pmod(F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))), F.lit(2)).cast("int")
    pieces = _pieces(spark, path, "}").withColumn("e0", flips).withColumn("e1", 1 - flips)
    pieces = _states(pieces)
    outside = F.regexp_replace(F.when(F.col("inside") == 1, F.regexp_replace(bare, r'(?s)^[^"]*+(?:"|\z)', "")).otherwise(bare),
                               r'(?s)"[^"]*+(?:"|\z)', "")
    ends_inside = F.pmod(F.col("inside") + flips, F.lit(2)) == 1
    opens = F.length(F.regexp_replace(outside, r"[^\[{]", ""))
    closes = F.length(F.regexp_replace(outside, r"[^\]]", "")) + F.when(ends_inside, 0).otherwise(1)  # the piece's own }
    pieces = written(pieces.withColumn("_d", opens - closes).withColumn("_has", outside.contains("{")))
    pieces = _sum_before(pieces, "_d", "depth")
    first = (F.col("inside") == 0) & (F.col("depth") <= 1) & F.col("_has")
    pieces = written(pieces.withColumn("_new", F.when(first, 1).otherwise(0)))
    pieces = _sum_before(pieces, "_new", "_r").withColumn("rec", F.col("_r") + F.col("_new") - 1)
    # after its last object a file has only the array's end
    pieces = pieces.where((F.col("rec") >= 0) & ((F.col("_new") == 1) | (F.col("depth") > 1) | (F.col("inside") == 1)))
    rows = _records(pieces.select("file", "rec", "blk", "id", F.concat("value", F.lit("}")).alias("value")), "")
    start = F.regexp_replace("text", r"(?s)^[^{]*+", "")
    return rows.select(F.from_json(start, schema).alias("r"), _order()).select("r.*", "_order")


def write_json_arrays(df: DataFrame, path: str, order: str, partitions: int | None = None) -> None:
    """Part files that hold one JSON array each, in ``order`` over the files; the order column is left out."""
    import pyarrow as pa

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, order).sortWithinPartitions(order)
    rows = rows.select(F.to_json(F.struct(*[c for c in df.columns if c != order])).alias("value"))

    def run(batches):
        mark = "["
        for batch in batches:
            lines = []
            for x in batch.column(0).to_pylist():
                lines.append(mark + x)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)
