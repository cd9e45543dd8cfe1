"""Fill-in-middle: texts cut at two units and put in another order, by relations of units.

1. *Units.* A text is letter runs and single other characters, left to right. They are exploded with
   their places in blocks of ``BLOCK``, so that a text has a row for each block and not for each unit.
2. *Running sums.* A window over the blocks of a text adds up their characters.
3. *Requests.* A text asks for two ordinals of units, drawn from a digest of the seed and its id. A
   request joins the block that holds its ordinal, whose units are exploded in their turn; those before
   the ordinal are added to the running sum.
4. *Offsets* of both requests are one row a text, which goes back to the text by broadcast if the rows
   are few and else by a shuffle; ``substring`` does the rest.

Block rows carry no text but that of the two blocks asked for. Equal texts of one id count once, and a
very long text is many small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

UNIT = "[A-Za-z]+|[^A-Za-z]"
BLOCK = 64
#: Possessive, so that the blocks of a text are found in one pass without going back.
BLOCKS = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
CUT_PERCENT = 90
SPM_PERCENT = 20
SEED = "1"
#: Offsets of this many texts are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 500_000


def _draws(seed: str, doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the digest, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]


def _form(text: Column, h3: Column, h4: Column, cut_percent: int, spm_percent: int) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return (
        F.when((text == "") | marked | (h3 % 100 >= cut_percent), "plain")
        .when(h4 % 100 < spm_percent, "spm")
        .otherwise("psm")
    )


def arranged(form: Column, text: Column, low: Column, high: Column) -> Column:
    """The output of a text with cuts after ``low`` and ``high`` characters."""
    prefix, middle, suffix = F.substr(text, F.lit(1), low), F.substr(text, low + 1, high - low), F.substr(text, high + 1)
    return (
        F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts hold no marker, and none arises where a part meets a marker."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def cut_offsets(rows: DataFrame) -> DataFrame:
    """(key, n, low, high) of texts (key, text, h1, h2): units, and the characters before each cut.

    Rows with equal keys must be equal, and count once.
    """
    n = F.regexp_count("text", F.lit(UNIT)).cast("long")
    asked = rows.withColumn("n", n).withColumns({c: F.col(c) % (F.col("n") + 1) for c in ("h1", "h2")})
    asked = asked.select("key", "text", "n", F.least("h1", "h2").alias("u1"), F.greatest("h1", "h2").alias("u2"))
    # a cut after the last unit of a text whose blocks are all full lies in a block that does not exist
    holder = lambda u, n: F.least(F.expr(f"{u} div {BLOCK}"), F.expr(f"greatest({n} - 1, 0) div {BLOCK}"))
    exploded = asked.select(
        "key", "n", "u1", "u2", holder("u1", "n").alias("b1"), holder("u2", "n").alias("b2"),
        F.posexplode(F.regexp_extract_all("text", F.lit(BLOCKS), F.lit(0))).alias("block", "units"),
    )
    wanted = F.col("block").isin(F.col("b1"), F.col("b2"))
    blocks = exploded.groupBy("key", "block").agg(
        F.max(F.char_length("units")).cast("long").alias("chars"),
        F.max(F.when(wanted, F.struct("units", "n", "u1", "u2", "b1", "b2"))).alias("asked"),
    )
    running = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("before", F.coalesce(F.sum("chars").over(running), F.lit(0))).filter("asked IS NOT NULL")
    requests = summed.select(
        "key", "block", "before", F.col("asked.units").alias("units"), F.col("asked.n").alias("n"),
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("cut"), F.col(f"asked.b{k}").alias("at"), F.col(f"asked.u{k}").alias("unit")) for k in (1, 2)
        ])).alias("r"),
    ).filter("r.at = block")
    units = requests.select(
        "key", "n", "before", "r.cut", (F.col("r.unit") - F.lit(BLOCK) * F.col("block")).alias("within"),
        F.posexplode(F.regexp_extract_all("units", F.lit(UNIT), F.lit(0))).alias("place", "unit"),
    )
    inside = F.sum(F.when(F.col("place") < F.col("within"), F.char_length("unit")).otherwise(0))
    offsets = units.groupBy("key", "n", "cut", "before").agg((F.col("before") + inside).alias("offset"))
    pick = lambda k: F.max(F.when(F.col("cut") == k, F.col("offset")))
    return offsets.groupBy("key").agg(F.max("n").alias("n"), pick(1).alias("low"), pick(2).alias("high"))


def fill_in_middle(
    docs: DataFrame,
    seed: str = SEED,
    cut_percent: int = CUT_PERCENT,
    spm_percent: int = SPM_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output), a row for each row of ``docs``.

    ``n`` counts the units of the whole text. A text is plain, and its output itself, if it is null
    (then empty) or empty, holds a marker, or is drawn so; its counts of characters are null. An id
    that is null draws as an empty one; rows with equal ids draw alike, and each is cut by its own
    text. Other columns are left out; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "middle")
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = _draws(seed, doc_id)
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    rows = docs.select(
        doc_id.alias("doc_id"), text.alias("text"), F.unhex(F.md5(named)).alias("key"), h1.alias("h1"), h2.alias("h2"),
        _form(text, h3, h4, cut_percent, spm_percent).alias("form"),
    )
    cut = rows.filter("form <> 'plain'").select("key", "text", "h1", "h2")
    offsets = scratch.table(cut_offsets(cut), "offsets")
    if offsets.count() <= BROADCAST_TEXTS:
        offsets = F.broadcast(offsets)
    met = rows.select("doc_id", "text", "key", "form").join(offsets, "key", "left")
    return met.select(
        "doc_id",
        "text",
        F.coalesce("n", F.regexp_count("text", F.lit(UNIT)).cast("long")).alias("n"),
        "form",
        F.when(F.col("form") != "plain", F.col("low")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("high") - F.col("low")).alias("middle_chars"),
        arranged(F.col("form"), F.col("text"), F.col("low"), F.col("high")).alias("output"),
    )
