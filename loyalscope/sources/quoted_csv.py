"""Quoted CSV with line breaks inside fields, read by many tasks a file.

Spark's ``multiLine`` reader gives a whole file to one task, because a split cannot tell whether its first
line break stands inside quotes. That is the parity of the quotes before it, so it is counted:

1. every split counts its quotes (one row per split), and a running sum over a file's splits says which
   splits begin inside quotes;
2. every split joins its own lines to records, from the parity it begins with;
3. what belongs to a record that crosses a split's edge (at most two pieces a split) is put together by the
   order of the splits.

Only rows per split and those pieces are shuffled. The text is scanned three times: for the quotes, the
records and the pieces. A compressed file is one split, as for every reader.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"escape": '"'}
_PIECE = "_file string, _split long, _kind int, _record string"
#: What a row of ``_PIECE`` is: the end, the middle or the beginning of a record of several splits, or a whole one.
END, MIDDLE, BEGINNING, WHOLE = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their split and their order in it."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                    F.monotonically_increasing_id().alias("_at"), "value"))


def _open_splits(lines: DataFrame) -> DataFrame:
    """The splits that begin inside quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("_file", "_split").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    return (counted.withColumn("_open", F.sum("n").over(before) % 2 == 1).where("_open")
            .select("_file", "_split", "_open"))


def _join_lines(batches):
    """Records of each split, in the order of its lines; an open one is carried from batch to batch."""
    split, begun, kind, parts = None, False, WHOLE, []

    def piece(last):
        return (*split, last, "\n".join(parts))

    for batch in batches:
        out = []
        odd = (batch["value"].str.count('"') % 2 == 1).tolist()
        rows = zip(batch["_file"].tolist(), batch["_split"].tolist(), batch["_open"].tolist(), odd, batch["value"].tolist())
        for file, start, starts_open, flips, line in rows:
            if (file, start) != split:
                if parts:
                    out.append(piece(MIDDLE if kind == END else BEGINNING))
                split, begun, parts = (file, start), bool(starts_open), []
                kind = END if begun else WHOLE
            parts.append(line)
            begun ^= flips
            if not begun:
                out.append(piece(kind))
                kind, parts = WHOLE, []
        yield pd.DataFrame(out, columns=["_file", "_split", "_kind", "_record"])
    if parts:
        yield pd.DataFrame([piece(MIDDLE if kind == END else BEGINNING)], columns=["_file", "_split", "_kind", "_record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _split, _record``: the text of every record, the header lines too, in no order.

    A quote that is never closed makes the rest of its file one record, as any CSV reader would.
    """
    lines = _lines(spark, path)
    keyed = lines.join(_open_splits(lines), ["_file", "_split"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    pieces = keyed.sortWithinPartitions("_file", "_split", "_at").mapInPandas(_join_lines, _PIECE)
    whole = pieces.where(F.col("_kind") == WHOLE).select("_file", "_split", "_record")
    order = Window.partitionBy("_file").orderBy("_split", "_kind")
    crossing = pieces.where(F.col("_kind") != WHOLE).withColumn(
        "_nth", F.sum((F.col("_kind") == BEGINNING).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("_split", "_kind", "_record")))
    joined = crossing.groupBy("_file", "_nth").agg(F.min("_split").alias("_split"), F.array_join(parts["_record"], "\n").alias("_record"))
    return whole.unionByName(joined.select("_file", "_split", "_record"))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """The columns of the files' common header, as text; a file that starts with another header is read by position.

    A field may hold commas, doubled quotes and line breaks if it is quoted. Blank lines are no records.
    Rows equal to the header are the files' first lines and are left out. An empty value is NULL.
    """
    names = spark.read.options(header="true", multiLine="true", **OPTIONS).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    text = F.regexp_replace("_record", "\r$", "")
    rows = csv_records(spark, path).select(text.alias("_record")).where(F.trim("_record") != "")
    parsed = rows.select(F.from_csv("_record", schema, OPTIONS).alias("r"))
    header = F.lit(True)
    for n in names:
        header &= F.col("r")[n].eqNullSafe(F.lit(n))
    return parsed.where(~header).select("r.*")
