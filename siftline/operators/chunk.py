"""Overlapping line chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import DEFAULT, Settings
from siftline.functions.text import is_blank, lines


def bounds(line_array: Column, size: int = 80, overlap: int = 20, snap: bool = True, look_ahead: int = 10) -> Column:
    """An array of (start_line, end_line), 1-based; ends move past a blank line within ``look_ahead`` lines."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunks need a size over 0 and an overlap under it")
    n, stride = F.size(line_array), size - overlap

    def chunk(start: Column) -> Column:
        end = F.least(start + size, n)
        if snap:
            ahead = F.sequence(end, F.greatest(F.least(end + look_ahead, n) - 1, end))
            blank = F.get(F.filter(ahead, lambda i: is_blank(F.get(line_array, i))), 0)
            end = F.when(end < n, F.coalesce(blank + 1, end)).otherwise(end)
        return F.struct((start + 1).cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    needed = F.filter(starts, lambda s: (s == 0) | (chunk(s - stride)["end_line"] < n))  # the one before is cut again, so that work grows with the lines
    return F.transform(F.when(n > 0, needed).otherwise(F.slice(starts, 1, 0)), chunk)


def chunks(files: DataFrame, settings: Settings = DEFAULT, snap: bool = True) -> DataFrame:
    """(filepath, start_line, end_line, raw_snippet) of (filepath, text); files without lines have none."""
    cut = files.select("filepath", lines(F.col("text")).alias("ls"))

    def piece(c: Column) -> Column:
        snippet = F.array_join(F.slice("ls", c.start_line, c.end_line - c.start_line + 1), "\n")
        return F.struct(c.start_line.alias("start_line"), c.end_line.alias("end_line"), snippet.alias("raw_snippet"))

    # texts are cut before chunks become rows, else each would carry its whole file
    part = cut.select("filepath", F.explode(F.transform(bounds(F.col("ls"), settings.chunk_lines, settings.overlap, snap, settings.look_ahead), piece)).alias("c"))
    return part.select("filepath", "c.start_line", "c.end_line", "c.raw_snippet")
