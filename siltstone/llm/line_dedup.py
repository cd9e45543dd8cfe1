"""Line dedup: winnowed fingerprints of line runs, extended both ways; later repeated runs go.

Units are the lines that hold a word, compared without white space at their ends. A *gram* at a
unit is the shortest run of units from there with at least ``min_words`` words, and its hash is
that of the run. The *window* at a unit spans the grams that start within the next
``guarantee_words - min_words`` words, and its fingerprint is its smallest gram hash (the last
one of equals). Which gram a window selects depends on the window's own lines only, so every run
of whole lines of ``guarantee_words`` words or more that two places share gives both the same
fingerprint; and as a gram holds ``min_words`` words, no shorter repeat is ever touched.

Each fingerprint is joined with its earliest place only: a star, not all pairs. Matches are then
followed along their diagonal in both directions, line by line, and every run of equal lines with
``min_words`` words or more is deleted at its later place. Places are ordered by document id, text
hash and line. Hashes have 64 bits.

The star misses a long repeat whose fingerprints all have their first place elsewhere. So texts
with a shared fingerprint are searched once more, exactly: the shortest run of ``guarantee_words``
words from each unit on, and up to each unit, is hashed, and goes wherever it is not the first of
its hash. A repeated run of whole lines is covered by such runs inside it, up to its last line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.lets import let
from siltstone.llm.scratch import Scratch

MIN_WORDS = 30
GUARANTEE_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
SPACE_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
#: Runs of up to this many bytes are broadcast to the texts; more meet them by a shuffle.
BROADCAST_BYTES = 32 << 20
NO_ID = -(2**63)  # stands for a null id: such rows count as the earliest


def _units(text: Column) -> Column:
    """Array of (no, h, w): line number, hash and words of each line with a word."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(
            i.alias("no"),
            F.xxhash64(F.regexp_replace(x, SPACE_ENDS, "")).alias("h"),
            F.regexp_count(x, F.lit(WORD)).alias("w"),
        ),
    )
    return F.filter(lines, lambda u: u["w"] > 0)


def _reach(units: Column, i: Column, words: int) -> Column:
    """How many units from ``i`` it takes to reach ``words`` words, and the words reached."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))

    def step(a: Column, u: Column) -> Column:
        more = F.struct((a["n"] + 1).alias("n"), (a["w"] + u["w"]).alias("w"))
        return F.when(a["w"] >= words, a).otherwise(more)

    # each unit has a word, so the slice needs no more units than words
    return F.aggregate(F.slice(units, i + 1, F.lit(words)), zero, step)


def _fingerprints(units: Column, min_words: int, span: int) -> Column:
    """Distinct (h, i) of the grams that some window selects."""

    def gram(u: Column, i: Column) -> Column:
        hashed = lambda n: F.xxhash64(F.transform(F.slice(units, i + 1, n), lambda x: x["h"]))
        entry = lambda h: F.struct(h.alias("h"), (-i).alias("neg"))
        long = let(_reach(units, i, min_words), lambda r: F.when(r["w"] >= min_words, entry(hashed(r["n"]))))
        return F.when(u["w"] >= min_words, entry(hashed(F.lit(1)))).otherwise(long)

    def selected(grams: Column) -> Column:
        def one(u: Column, i: Column) -> Column:
            many = F.array_min(F.slice(grams, i + 1, F.greatest(_reach(units, i, span)["n"], F.lit(1))))
            return F.when(u["w"] >= span, F.get(grams, i)).otherwise(many)

        return F.array_distinct(F.array_compact(F.transform(units, one)))

    picked = let(F.transform(units, gram), selected)
    return F.transform(picked, lambda x: F.struct(x["h"].alias("h"), (-x["neg"]).alias("i")))


def _long_grams(units: Column, words: int) -> Column:
    """(h, i, start, end) of the shortest runs of ``words`` words from each unit on and up to each unit."""

    def grams(u: Column, i: Column) -> Column:
        def entry(first: Column, n: Column) -> Column:
            return F.struct(
                F.xxhash64(F.transform(F.slice(units, first + 1, n), lambda x: x["h"])).alias("h"),
                first.alias("i"),
                F.get(units, first)["no"].alias("start"),
                F.get(units, first + n - 1)["no"].alias("end"),
            )

        ahead = let(_reach(units, i, words), lambda r: F.when(r["w"] >= words, entry(i, r["n"])))
        lo = F.greatest(i - (words - 1), F.lit(0))
        # where the run without its last unit is too short, it is the one from its first unit on
        behind = let(
            _reach(F.reverse(F.slice(units, lo + 1, i - lo + 1)), F.lit(0), words),
            lambda r: F.when(r["w"] - u["w"] >= words, entry(i - r["n"] + 1, r["n"])),
        )
        return F.array(ahead, behind)

    return F.array_compact(F.flatten(F.transform(units, grams)))


def _key(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"),
    ]


def line_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    guarantee_words: int = GUARANTEE_WORDS,
) -> DataFrame:
    """Runs to delete: (_doc, _th, runs), runs an array of (start, end) line numbers, both included."""
    scratch = Scratch(docs.sparkSession, "lines")
    # at least one word of window, so that a unit always has its own gram in it
    span = max(guarantee_words - min_words, 1)
    units = docs.select(*_key(id_col, text_col), _units(F.coalesce(F.col(text_col), F.lit(""))).alias("u")).filter(
        F.aggregate("u", F.lit(0), lambda a, u: a + u["w"]) >= min_words
    )
    t = scratch.table(
        units.select("_doc", "_th", "u", _fingerprints(F.col("u"), min_words, span).alias("fps")), "units"
    )
    places = t.select("_doc", "_th", F.explode("fps").alias("f")).select(
        F.col("f.h").alias("h"), F.struct("_doc", "_th", F.col("f.i").alias("i")).alias("at")
    )
    firsts = (
        places.groupBy("h")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .filter(F.col("first") != F.col("last"))
        .select("h", "first")
    )
    shared = places.join(firsts, "h")
    pairs = (
        shared.filter(F.col("at") != F.col("first"))
        .select(
            F.col("at._doc").alias("_doc"),
            F.col("at._th").alias("_th"),
            F.col("first._doc").alias("r_doc"),
            F.col("first._th").alias("r_th"),
            (F.col("at.i") - F.col("first.i")).alias("diag"),
        )
        .distinct()
    )
    once = t.select("_doc", "_th", "u").dropDuplicates(["_doc", "_th"])
    ref = once.select(
        F.col("_doc").alias("r_doc"), F.col("_th").alias("r_th"), F.transform("u", lambda x: x["h"]).alias("rh")
    )
    seeded = pairs.join(ref, ["r_doc", "r_th"]).select("_doc", "_th", "diag", "rh").join(once, ["_doc", "_th"])
    runs = seeded.select("_doc", "_th", F.explode(_runs(min_words)).alias("run"))
    found = runs.select("_doc", "_th", "run.start", "run.end")
    return _merged(found.unionByName(_long_runs(once, shared, max(guarantee_words, min_words))))


def _long_runs(once: DataFrame, shared: DataFrame, words: int) -> DataFrame:
    """(_doc, _th, start, end) of all runs of ``_long_grams`` that an earlier place holds as well."""
    some = shared.select(F.col("at._doc").alias("_doc"), F.col("at._th").alias("_th")).distinct()
    grams = (
        once.join(some, ["_doc", "_th"])
        .select("_doc", "_th", F.explode(_long_grams(F.col("u"), words)).alias("g"))
        .select(F.col("g.h").alias("h"), F.struct("_doc", "_th", F.col("g.i").alias("i")).alias("at"), "g.start", "g.end")
    )
    firsts = (
        grams.groupBy("h")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .filter(F.col("first") != F.col("last"))
        .select("h", "first")
    )
    later = grams.join(firsts, "h").filter(F.col("at") != F.col("first"))
    return later.select("at._doc", "at._th", "start", "end")


def _merged(runs: DataFrame) -> DataFrame:
    """(_doc, _th, runs) with overlapping runs as one."""
    before = Window.partitionBy("_doc", "_th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_doc", "_th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.coalesce(F.max("end").over(before), F.lit(-1))
    fresh = runs.withColumn("fresh", (F.col("start") > reached).cast("int"))
    islands = fresh.withColumn("island", F.sum("fresh").over(upto)).groupBy("_doc", "_th", "island")
    return (
        islands.agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("run"))
        .groupBy("_doc", "_th")
        .agg(F.collect_list("run").alias("runs"))
    )


def _runs(min_words: int) -> Column:
    """Runs of equal units on the diagonal, as line numbers: between neighbouring breaks."""
    u, rh, d = F.col("u"), F.col("rh"), F.col("diag")
    lo = F.greatest(d, F.lit(0))
    hi = F.least(F.size(u), F.size(rh) + d) - 1  # hi >= lo: the pair's fingerprint lies between
    differ = F.filter(F.sequence(lo, hi), lambda i: F.get(u, i)["h"] != F.get(rh, i - d))

    def between(breaks: Column) -> Column:
        spans = F.transform(
            F.slice(breaks, 1, F.size(breaks) - 1),
            lambda b, k: F.struct((b + 1).alias("s"), (F.get(breaks, k + 1) - 1).alias("e")),
        )
        return F.filter(
            spans,
            lambda r: (r["e"] >= r["s"])
            & (F.aggregate(F.slice(u, r["s"] + 1, r["e"] - r["s"] + 1), F.lit(0), lambda a, x: a + x["w"]) >= min_words),
        )

    found = let(F.concat(F.array(lo - 1), differ, F.array(hi + 1)), between)
    return F.transform(
        found, lambda r: F.struct(F.get(u, r["s"])["no"].alias("start"), F.get(u, r["e"])["no"].alias("end"))
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    guarantee_words: int = GUARANTEE_WORDS,
) -> DataFrame:
    """``docs`` with later repeats of line runs deleted from the text.

    New columns: ``removed`` (array of (start, end) line numbers of the old text, null where
    nothing went), ``n_removed_lines`` and ``n_removed_words``; columns of ``docs`` with these
    names are replaced, all others pass through. Blank lines inside a deleted run go with it. A
    null text stays null. Rows with equal id and text are one document and get the same result;
    rows with a null id count as the earliest. Lines of one text that repeat in it count as well.
    An empty table stays empty.
    """
    runs = Scratch(docs.sparkSession, "runs").table(line_runs(docs, id_col, text_col, min_words, guarantee_words), "runs")
    held = runs.agg(F.sum(48 + 24 * F.size("runs"))).first()[0] or 0
    near = F.broadcast if held <= BROADCAST_BYTES else (lambda df: df)
    # the rows travel as one column, so that none of theirs can clash with the join's
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(id_col, text_col))
    joined = keyed.join(near(runs), ["_doc", "_th"], "left")
    text = F.col("row")[text_col]
    gone = lambda i: F.exists("runs", lambda r: (i >= r["start"]) & (i <= r["end"]))
    split = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), gone(i).alias("gone")))

    def cut(lines: Column) -> Column:
        lost = F.filter(lines, lambda x: x["gone"])
        return F.struct(
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["gone"]), lambda x: x["x"]), "\n").alias("text"),
            F.size(lost).cast("long").alias("lines"),
            F.aggregate(lost, F.lit(0), lambda a, x: a + F.regexp_count(x["x"], F.lit(WORD))).cast("long").alias("words"),
        )

    hit = F.col("runs").isNotNull()
    none = F.lit(0).cast("long")
    made = {
        "removed": F.sort_array("runs"),
        "n_removed_lines": F.coalesce(F.col("cut.lines"), none),
        "n_removed_words": F.coalesce(F.col("cut.words"), none),
    }
    new_text = F.when(hit, F.col("cut.text")).otherwise(text)
    kept = [(new_text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c.lower() not in made]
    return joined.withColumn("cut", F.when(hit, let(split, cut))).select(*kept, *[c.alias(k) for k, c in made.items()])
