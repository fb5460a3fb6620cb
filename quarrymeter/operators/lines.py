"""Line-by-line state machines as windows: islands of lines that a header opens.

A text becomes numbered lines. The header that a line stands below is the last
one before it (``last`` over the rows so far, nulls ignored), and whether its section is still
open is a running minimum or maximum inside that island. All of it is
built-in functions, sorted by file and line; no state is kept in Python.

Defined cases: a null text has no lines; an empty text has none either; a header
inside a section opens its own, and what comes after that section's end belongs to none, as
for a reader that keeps one state; repeated files are told apart by their keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line ends, and blanks, as Python's str.splitlines and str.strip know them.
ENDS = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
BLANK = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def numbered_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, nr, line) of every line."""
    whole = F.regexp_replace(text, f"(?:{ENDS})\\z", "")  # the last end begins no line
    return files.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(whole, ENDS)).alias("nr", "line"))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", "")


def islands(lines: DataFrame, keys: list[str], header: Column) -> DataFrame:
    """Adds ``head``, the number of the last line at or above each that is a header; null above the first."""
    so_far = Window.partitionBy(*keys).orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("head", F.last(F.when(header, F.col("nr")), ignorenulls=True).over(so_far))


def yaml_section_entries(files: DataFrame, keys: list[str], sections: Column, text: str = "text") -> DataFrame:
    """(keys, nr, entry): entries below the named sections of a simple YAML mapping, by indent alone.

    sections: an array of names for each file. A section ends at the first line that isn't
    indented more than its header; a version after a name is cut off.
    """
    cut = numbered_lines(files.select(*keys, sections.alias("_sections"), text), [*keys, "_sections"], text)
    told = cut.withColumn("_bare", bare(F.col("line"))).where((F.col("_bare") != "") & ~F.col("_bare").startswith("#"))
    told = told.withColumn("_indent", F.length(F.regexp_extract("line", f"^({BLANK}*)", 1)))
    opens = F.col("_bare").endswith(":") & F.array_contains("_sections", F.regexp_replace("_bare", ":+$", ""))
    placed = islands(told.withColumn("_opens", opens), keys, F.col("_opens")).where("head is not null")
    below = Window.partitionBy(*keys, "head").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.max(F.when(F.col("_opens"), F.col("_indent"))).over(below)
    least = F.min(F.when(~F.col("_opens"), F.col("_indent"))).over(below)
    inside = placed.withColumn("_in", ~F.col("_opens") & (least > depth)).where("_in")
    name = F.regexp_extract(F.regexp_replace("_bare", "^[- ]+", ""), f"^((?:(?!{BLANK})[^=<>!~:#])*)", 1)
    return inside.select(*keys, "nr", name.alias("entry"))


def setup_cfg_entries(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, nr, entry): requirement lines of install_requires and setup_requires, the header's own value first.

    A list ends at the first line that has text in its first column.
    """
    header = f"^{BLANK}*(?:install_requires|setup_requires){BLANK}*=(.*)"
    cut = numbered_lines(files, keys, text).withColumn("_opens", F.col("line").rlike(header))
    placed = islands(cut, keys, F.col("_opens")).where("head is not null")
    below = Window.partitionBy(*keys, "head").orderBy("nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ~F.col("_opens") & (bare(F.col("line")) != "") & ~F.col("line").rlike(f"^{BLANK}")
    inside = placed.withColumn("_ended", F.max(ends.cast("int")).over(below)).where("_ended = 0")
    return inside.select(*keys, "nr", F.when(F.col("_opens"), F.regexp_extract("line", header, 1)).otherwise(F.col("line")).alias("entry"))
