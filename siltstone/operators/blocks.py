"""Where blocks of braces end, as windows over lines: no loop over the lines of a file.

The balance of a line is what is open after it. A block that opens on a line ends on the first line
from there on whose balance is no more than what was open before. A line that closes more than it opens
takes the balance down through some levels, so it is the end of whatever began at one of these; the next
such line of a level is one window over starts and ends of that level, sorted by line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import text as T

#: Fixed value: what precedes the brace of a rule.
SELECTOR = r"^\s*((?:@[\w-]+[^{]+|[^{}]+))\s*\{"
STYLES = (".css", ".scss", ".sass", ".less")


def block_ends(code: DataFrame, keys: Sequence[str], *keep: str) -> DataFrame:
    """(keys, line, last) of lines that start a block, and their columns to ``keep``; ``last`` is null where nothing closes it.

    ``code`` has a row for each line: keys, line, opened, closed (braces on it), starts. Both windows
    are over rows dealt by the keys, so lines are read and shuffled once.
    """
    upto = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.col("opened") - F.col("closed")
    lines = code.select(*keys, "line", "starts", *keep, F.sum(change).over(upto).alias("after"), change.alias("change"))
    lines = lines.withColumn("before", F.col("after") - F.col("change"))
    event = lambda level, starts: F.struct(level.alias("level"), F.lit(starts).alias("starts"))
    none, closes = F.array().cast("array<struct<level:bigint,starts:boolean>>"), F.col("after") < F.col("before")
    # one that ends on its own line has no level
    start = F.when(F.col("starts"), F.array(event(F.when(F.col("after") > F.col("before"), F.col("before")), True))).otherwise(none)
    ends = F.when(closes, F.transform(F.sequence("after", F.col("before") - 1), lambda level: event(level, False))).otherwise(none)
    events = lines.select(*keys, "line", *keep, F.explode(F.concat(start, ends)).alias("e")).select(*keys, "line", *keep, "e.level", "e.starts")
    after = Window.partitionBy(*keys, "level").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("last", F.last(F.when(~F.col("starts"), F.col("line")), ignorenulls=True).over(after))
    return found.filter("starts").select(*keys, "line", *keep, F.when(F.col("level").isNull(), F.col("line")).otherwise(F.col("last")).alias("last"))


def is_style(path) -> object:
    return P.extension(path).isin(*STYLES)


def style_units(files: DataFrame) -> DataFrame:
    """Rules of style sheets from the line of their selector to the end of their block; a file without rules is one unit.

    Columns: workspace_root, file_path, symbol, kind, start_line, end_line, content. A block that nothing
    closes goes on to the last line.
    """
    keys = ["workspace_root", "file_path"]
    held = files.select(*keys, T.lines(F.coalesce("content", F.lit(""))).alias("lines"))
    each = held.select(*keys, F.posexplode_outer("lines").alias("line", "text"))  # a plain one would split again for a filter
    count = lambda c: F.regexp_count("text", F.lit(c))
    symbol = F.regexp_replace(F.regexp_extract("text", SELECTOR, 1), r"^\s+|\s+$", "")
    code = each.select(*keys, "line", count(r"\{").alias("opened"), count(r"\}").alias("closed"), F.rlike("text", F.lit(SELECTOR)).alias("starts"), symbol.alias("symbol"))
    rules = block_ends(code, keys, "symbol")
    listed = rules.groupBy(*keys).agg(F.collect_list(F.struct("line", "last", "symbol")).alias("rules"))
    name = F.struct(F.lit(0).alias("line"), (F.size("lines") - 1).alias("last"), P.file_name(F.col("file_path")).alias("symbol"))
    one = held.join(listed, keys, "left").withColumn("none", F.col("rules").isNull())
    exploded = one.select(*keys, "lines", "none", F.explode(F.coalesce("rules", F.array(name))).alias("r"))
    last = F.coalesce("r.last", F.size("lines") - 1)
    kind = F.when(F.col("none"), "File").when(F.startswith("r.symbol", F.lit("@")), "StyleAtRule").otherwise("StyleRule")
    return exploded.select(
        *keys,
        F.col("r.symbol").alias("symbol"),
        kind.alias("kind"),
        (F.col("r.line") + 1).cast("int").alias("start_line"),
        (last + 1).cast("int").alias("end_line"),
        F.array_join(F.slice("lines", F.col("r.line") + 1, last - F.col("r.line") + 1), "\n").alias("content"),
    )
