"""CSV files whose quoted fields hold line ends, read by many tasks.

Whether a line end closes a record depends on the quotes before it, from the start of the file. Each byte range
of a file is read once, as lines: it counts its quotes and notes how many lines with an odd number
of them came before each piece. The ranges' sums, added up over the file, say for every range whether it
begins inside a quoted field. Lines outside of quotes are records; the lines of a record that spans several are
brought together by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfeat.sources.staging import checked_broadcast, stage

PIECE_BYTES = 1_000_000
_SCHEMA = "file bigint, block bigint, seq bigint, before bigint, odd boolean, header boolean, crlf boolean, text binary"


def _pieces(batches: Iterator) -> Iterator:
    """Runs of lines with an even number of quotes, joined, and single lines with an odd number; per range of a file."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    # Position in the current range: its file and block, the next piece and the odd lines so far.
    here, seq, before = None, 0, 0
    for batch in batches:
        lines = batch.column("value").cast(pa.binary())
        odd = (pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False) & 1).astype(bool)
        sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        files, blocks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("file", "block"))
        lines, out = lines.to_pylist(), []
        ends = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        cuts = [0, *ends.tolist(), len(lines)] if lines else []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            key = (files[begin], blocks[begin])
            if key != here:
                here, seq, before = key, 0, 0
            at = begin
            if seq == 0 and key[1] == 0:  # the first line of the file, by itself
                out.append((*key, 0, 0, bool(odd[at]), True, lines[at].endswith(b"\r"), lines[at]))
                seq, before, at = 1, int(odd[at]), at + 1
            stops = np.flatnonzero(odd[at:end]) + at
            for stop in [*stops.tolist(), end]:
                while at < stop:
                    upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:stop] + 1), PIECE_BYTES, side="right")))
                    out.append((*key, seq, before, False, False, None, b"\n".join(lines[at:upto])))
                    seq, at = seq + 1, upto
                if stop < end:
                    out.append((*key, seq, before, True, False, None, lines[stop]))
                    seq, before, at = seq + 1, before + 1, stop + 1
        columns = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["file", "block", "seq", "before", "odd", "header", "crlf", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files with a header, one ``value`` each, without the headers and empty lines.

    Line ends are ``\\n``; in a file whose first line ends in ``\\r\\n``, those are read as ``\\n`` everywhere. Quotes in a field are
    doubled, so that they never change which line ends are inside. A quote that is not closed takes the rest of its file.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = stage(lines.mapInArrow(_pieces, _SCHEMA))
    # A row for each byte range: the odd lines before it in its file.
    ranges = pieces.groupBy("file", "block").agg(F.sum(F.col("odd").cast("long")).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = pieces.where("header").select("file", F.col("crlf").alias("has_cr"))
    starts = stage(ranges.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(files, "file", "left"))
    known = pieces.join(checked_broadcast(starts), ["file", "block"])
    text = F.col("text").cast("string")
    text = F.when(F.col("has_cr"), F.regexp_replace(text, "\r(?=\n|\\z)", "")).otherwise(text)
    known = known.select("file", "block", "seq", "odd", "header", text.alias("text"), (F.col("start") + F.col("before")).alias("passed"))
    outside = ~F.col("odd") & (F.col("passed") % 2 == 0)
    single = known.where(outside & ~F.col("header")).select(F.explode(F.split("text", "\n")).alias("value"))
    spanning = known.where(~outside).groupBy("file", F.floor(F.col("passed") / 2)).agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"), F.max("header").alias("header"))
    joined = spanning.where(~F.col("header")).select(F.array_join("parts.text", "\n").alias("value"))
    return single.unionByName(joined).where("value <> ''")
