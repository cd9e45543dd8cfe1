"""Mixing sources to target weights: token budgets down a tree, then seeded prefixes of its leaves.

A node's budget goes to its children in proportion to their weights, and no child gets more than
its leaves can give (their tokens times ``max_epochs``). What a child cannot take goes to its
siblings by weight, again up to what they can give; since a node's own budget never exceeds what
its leaves can give together, ancestors and their other branches see a shortage only when the
siblings are used up. All amounts are whole tokens, rounded down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to this many rows are broadcast (names and a few numbers, so a few tens of MB).
BROADCAST_LEAVES = 200_000
#: Hex digits of the order key that the prefix's histogram uses: 16 ** 3 buckets a leaf.
KEY_DIGITS = 3
#: Names that the plan needs for itself.
RESERVED = frozenset("row n_tokens epoch tokens cap w have full budget whole rest t past e".split())


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int], default: int) -> Column:
    """Weight of the node that the columns ``levels`` name."""
    found = F.lit(None).cast("long")
    for path, w in weights.items():
        if len(path) == len(levels):
            same = F.lit(True)
            for c, v in zip(levels, path, strict=True):
                if v != "*":
                    same = same & (F.col(c) == v)
            found = F.coalesce(found, F.when(same, F.lit(int(w)).cast("long")))
    return F.coalesce(found, F.lit(default).cast("long"))


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[tuple[str, ...], int],
    total: int,
    max_epochs: int = 1,
    default_weight: int = 1,
) -> DataFrame:
    """``leaves`` (levels and ``tokens``) with their ``budget``, by filling level after level.

    ``weights`` maps paths of any depth, "*" matching any name, to whole numbers up to 10,000;
    the first match counts. Nodes of weight 0 get nothing.
    """
    if any(not 0 <= w <= 10_000 for w in [*weights.values(), default_weight]):
        raise ValueError("weights are whole numbers from 0 to 10,000")
    live = F.lit(True)
    for k in range(1, len(levels) + 1):
        live = live & (_weight(levels[:k], weights, default_weight) > 0)
    capped = leaves.withColumn("cap", F.when(live, F.col("tokens") * max_epochs).otherwise(F.lit(0).cast("long")))
    parent: DataFrame | None = None
    for k in range(1, len(levels) + 1):
        here = list(levels[:k])
        nodes = capped.groupBy(*here).agg(F.sum("cap").alias("cap")).filter("cap > 0")
        nodes = nodes.withColumn("w", _weight(here, weights, default_weight))
        if parent is None:
            nodes = nodes.withColumn("have", F.lit(int(total)).cast("long")).withColumn("_root", F.lit(0))
            by = ["_root"]
        else:
            nodes, by = nodes.join(parent, here[:-1]), here[:-1]
        # from the scarcest child on: it is full if its share of what is left covers its cap
        order = Window.partitionBy(*by).orderBy(F.col("cap").cast("double") / F.col("w"), here[-1])
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", (F.col("have") - before) * F.col("w") >= F.col("cap") * ahead)
        every = Window.partitionBy(*by)
        given = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))
        open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
        nodes = nodes.withColumn("_left", F.col("have") - given).withColumn("_open", open_w)
        share = F.expr("(w * _left) div _open")
        parent = nodes.select(*here, F.when(F.col("full"), F.col("cap")).otherwise(share).alias("have"))
    assert parent is not None
    return leaves.join(parent.withColumnRenamed("have", "budget"), list(levels), "left").fillna(0, ["budget"])


def mix_sources(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple[str, ...], int],
    percent: int = 100,
    max_epochs: int = 1,
    seed: int = 0,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    default_weight: int = 1,
) -> DataFrame:
    """Rows of ``docs`` that fill the budgets, with ``epoch`` and ``n_tokens``, and the levels' columns.

    ``levels`` names the tree's levels from the root on and gives each a column (null: an empty
    name). The total is ``percent`` of all tokens; ``tokens`` counts a row's (words of the text
    by default). In epoch ``e`` a leaf's rows are ordered by md5 of seed, epoch and id. A leaf's
    budget buys whole epochs, then the rows at the head of the next one whose running sum stays
    within the rest. Rows with equal ids stand at one place, so all or none of them are in.
    Rows without tokens cost nothing and are in up to the end of the prefix. An empty table
    gives none. Columns of ``docs`` named like the new ones are replaced, the others pass through.

    The prefix of a leaf comes from a histogram over the order key, so that no task sorts a leaf:
    only the rows of the one bucket where the prefix ends are put in order. All of this works on
    ids, levels and counts, written once; the rows themselves are read twice, first and last.
    """
    spark, names = docs.sparkSession, list(levels)
    if clash := RESERVED.intersection(names):
        raise ValueError(f"levels may not be named {', '.join(sorted(clash))}")
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) if tokens is None else tokens
    made = {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in levels.items()} | {"n_tokens": n.cast("long")}
    # the rows travel as one column, so that none of theirs can clash with the plan's
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in made.items()], F.col(id_col).alias("_id"))
    scratch = Scratch(spark, "mix")
    # everything but the last step needs no more of a row than this
    light = scratch.table(keyed.drop("row"), "counts")
    leaves = scratch.table(light.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, names, weights, total * percent // 100, max_epochs, default_weight)
    plan = plan.withColumn("whole", F.expr("CASE WHEN tokens = 0 THEN 0 ELSE budget div tokens END")).withColumn(
        "rest", F.col("budget") - F.col("whole") * F.col("tokens")
    )
    plan = scratch.table(plan.select(*names, "budget", "whole", "rest"), "plan")
    size = plan.count()
    near = F.broadcast if size <= BROADCAST_LEAVES else (lambda df: df)
    # null ids count as an empty id
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    bucket = F.substring("_key", 1, KEY_DIGITS)
    placed = light.join(near(plan.filter("rest > 0")), names).withColumn("_key", key).withColumn("_bucket", bucket)
    sums = placed.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    upto = Window.partitionBy(*names).orderBy("_bucket")
    edges = (
        sums.withColumn("past", F.sum("t").over(upto))
        .filter("past > rest")
        .groupBy(*names)
        .agg(F.min(F.struct("_bucket", (F.col("rest") - F.col("past") + F.col("t")).alias("room"))).alias("e"))
        .select(*names, F.col("e._bucket").alias("_edge"), F.col("e.room").alias("_room"))
    )
    edges = scratch.table(edges, "edges")
    # in the bucket where a leaf's prefix ends, its rows in order of their keys
    run = Window.partitionBy(*names).orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        placed.join(near(edges), names)
        .filter(F.col("_bucket") == F.col("_edge"))
        .withColumn("_run", F.sum("n_tokens").over(run))
        .filter(F.col("_run") <= F.col("_room"))
        .groupBy(*names)
        .agg(F.max("_key").alias("_last"))
    )
    # the prefix ends with a key; without an edge it takes all of the epoch
    ends = plan.join(edges, names, "left").join(last, names, "left")
    ends = scratch.table(ends.select(*names, "whole", "rest", F.coalesce("_last", "_edge").alias("_last")), "ends")
    edged = keyed.join(near(ends), names).withColumn("_key", key)
    more = (F.col("rest") > 0) & (F.col("_last").isNull() | (F.col("_key") <= F.col("_last")))
    count = F.col("whole") + more.cast("long")
    epochs = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
    inside = edged.withColumn("epoch", F.explode(epochs))
    new = [*names, "n_tokens", "epoch"]
    taken = {c.lower() for c in new}
    keep = [*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in taken), *new]
    return inside.select(*keep).withColumn("epoch", F.col("epoch").cast("int"))
