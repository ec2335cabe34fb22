"""Version strings such as ``1.217.1144.0`` as numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.nulls import column
from sparkfeat.functions.text import literal_split


def segment_widths(df: DataFrame, cols: Sequence[str], delimiter: str = ".") -> dict[str, list[int]]:
    """Longest segment per column and position, all in one pass."""
    lengths = F.array(*[
        F.transform(F.coalesce(literal_split(column(c).cast("string"), delimiter), F.array().cast("array<string>")),
                    lambda s: F.length(s))
        for c in cols])
    longest = (df.select(F.posexplode(lengths).alias("series", "lengths"))
               .select("series", F.posexplode("lengths").alias("position", "length"))
               .groupBy("series", "position").agg(F.max("length").alias("width")))
    widths: dict[str, dict[int, int]] = {c: {} for c in cols}
    for row in longest.collect():
        widths[cols[row["series"]]][row["position"]] = row["width"]
    return {c: [found[i] for i in range(len(found))] for c, found in widths.items()}


def version_number(df: DataFrame, cols: Sequence[str], fixed_width: bool = False,
                   delimiter: str = ".", widths: dict[str, list[int]] | None = None) -> DataFrame:
    """Zero-pad each segment, join them and read the digits as a double.

    By default a segment is padded to (longest - own length) digits, which leaves longer
    segments untouched and does not keep version order; ``fixed_width`` pads to the longest
    length of the position and does. A missing segment counts as empty. Text that is no
    number gives NULL. ``widths`` takes the result of an earlier :func:`segment_widths`.
    """
    longest = widths or segment_widths(df, cols, delimiter)

    def number(name: str) -> Column:
        pieces = literal_split(column(name).cast("string"), delimiter)
        padded = []
        for i, width in enumerate(longest[name]):
            piece = F.coalesce(F.get(pieces, F.lit(i)), F.lit(""))
            size = F.length(piece)
            wanted = F.lit(width) if fixed_width else F.lit(width) - size
            padded.append(F.call_function("lpad", piece, F.greatest(size, wanted), F.lit("0")))
        joined = F.concat(*padded) if padded else F.lit(None).cast("string")
        return F.when(column(name).isNotNull(), joined.try_cast("double"))

    return df.withColumns({name: number(name) for name in cols})
