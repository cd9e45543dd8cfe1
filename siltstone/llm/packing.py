"""Best-fit packing: a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
configurations that hold every length as often as it occurs. It is solved by multiplicative weights:
each length has a price, at first its share of a sequence and, if over half of one, a sequence of its
own on top. A pass covers all pieces at these prices. A knapsack dynamic program a round finds the
configuration worth most, and for each length the best one that holds it; those worth at least
``NEAR`` of the best are taken, best first, each as many whole times as the pieces that are left
allow, so that amounts are rounded down as they arise. Then each length's price moves by the power
``RATE`` towards what its pieces have cost, a sequence being paid by its pieces in proportion to
their prices: lengths that were left over for poor sequences get dearer, are placed earlier in the
next pass and with whom they fit. Prices are carried over from pass to pass. Prices over the best
worth solve the dual program, so each pass also gives a lower bound. Passes end at the bound or after
``PASSES``, and the best one counts.

The least full of its sequences, with at most ``REST`` of all pieces, are packed again by best fit. All
of this sees only the histogram, at most ``capacity`` numbers, so the driver's work does not grow with
the corpus. Pieces then find their places by their rank among the pieces of their length: ranks inside
a partition, plus a prefix sum of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch
from siltstone.llm.tokens import WORD_LEVEL, encoded, end_token

if TYPE_CHECKING:
    import pyarrow as pa

CAPACITY = 2048
#: Prices move by this power towards what was paid.
RATE = 0.7
#: Configurations worth this share of the round's best one are taken as well.
NEAR = 0.9
PASSES = 10
#: Passes end if they need this share more than the lower bound.
GAP = 0.001
#: At most this share of the pieces goes by best fit.
REST = 0.05
#: Rank bases up to this many rows are broadcast (three numbers a row).
BROADCAST_BASES = 500_000


@dataclass(frozen=True)
class Pattern:
    """``count`` sequences, each with ``lengths`` (length -> how often)."""

    lengths: dict[int, int]
    count: int


@dataclass(frozen=True)
class Fractions:
    """Amounts of configurations, each as (index of a length, pieces) pairs, and a bound that no packing beats."""

    amounts: dict[tuple[tuple[int, int], ...], float]
    bound: float

    @property
    def value(self) -> float:
        return sum(self.amounts.values())


def near_best_configurations(lengths, prices, limits, capacity: int) -> tuple[list[dict[int, int]], float]:
    """Multisets of ``lengths``, by worth at ``prices``: the best of all, then the best with each length; the best worth.

    A knapsack dynamic program over bundles of 1, 2, 4, ... pieces of a length; of equal worth are
    those with long pieces. The first keeps to ``limits``; the others may hold their own length once
    more, and are worth ``NEAR`` of the first.
    """
    import numpy as np

    bundles: list[tuple[int, int]] = []  # (index of the length, pieces)
    for j in range(len(lengths) - 1, -1, -1):
        most, size = min(int(limits[j]), capacity // int(lengths[j])), 1
        while most > 0:
            bundles.append((j, min(size, most)))
            most, size = most - size, 2 * size
    worth = np.zeros(capacity + 1)
    better = np.zeros((len(bundles), capacity + 1), dtype=bool)
    for b, (j, n) in enumerate(bundles):
        wide = n * int(lengths[j])
        total = worth[:-wide] + n * prices[j]
        np.greater(total, worth[wide:], out=better[b, wide:])
        np.maximum(total, worth[wide:], out=total)
        worth[wide:] = total
    with_each = prices + worth[capacity - lengths]
    near = np.flatnonzero(with_each >= NEAR * worth[capacity])
    near = near[np.lexsort((-lengths[near], -np.round(with_each[near], 9)))]
    room = np.concatenate([[capacity], capacity - lengths[near]])
    chosen: list[dict[int, int]] = [{}, *({j: 1} for j in near.tolist())]
    for b in range(len(bundles) - 1, -1, -1):
        hit = np.flatnonzero(better[b, room])
        if len(hit):
            j, n = bundles[b]
            room[hit] -= n * int(lengths[j])
            for k in hit.tolist():
                chosen[k][j] = chosen[k].get(j, 0) + n
    return chosen, float(worth[capacity])


def one_pass(lengths, counts, prices, capacity: int):
    """Amounts that cover each length exactly at ``prices``, what a piece of each has cost, and a lower bound."""
    import numpy as np

    amounts: dict[tuple[tuple[int, int], ...], int] = {}
    left, cost = counts.tolist(), np.zeros(len(lengths))
    at = np.arange(len(lengths))
    bound = None
    while len(at):
        chosen, best = near_best_configurations(lengths[at], prices[at], [left[i] for i in at.tolist()], capacity)
        if bound is None:
            bound = float(counts @ prices) / best
        for one in chosen:
            key = tuple(sorted((int(at[j]), n) for j, n in one.items()))
            x = min(left[i] // n for i, n in key)
            if x:  # the first always fits, so each round leaves less
                amounts[key] = amounts.get(key, 0) + x
                worth = sum(prices[i] * n for i, n in key)
                for i, n in key:
                    left[i] -= n * x
                    cost[i] += prices[i] * n * x / worth
        at = np.flatnonzero(left)
    return amounts, cost / counts, bound


def near_optimal_fractions(lengths, counts, capacity: int) -> Fractions:
    """The best of up to ``PASSES`` passes; see the module's text."""
    import numpy as np

    prices = (lengths / capacity + (2 * lengths > capacity)) / 2
    # pieces over half a sequence share none with each other, and sequences have room for so much
    bound = max(int((counts[2 * lengths > capacity]).sum()), -(-int(lengths @ counts) // capacity))
    best = None
    for _ in range(PASSES):
        amounts, cost, dual = one_pass(lengths, counts, prices, capacity)
        bound = max(bound, int(np.ceil(dual * (1 - 1e-9))))
        if best is None or sum(amounts.values()) < sum(best.values()):
            best = amounts
        if sum(best.values()) <= (1 + GAP) * bound:
            break
        prices = prices ** (1 - RATE) * cost**RATE
    return Fractions(best or {}, bound)


def solve_configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold each length of ``histogram`` exactly as often as it occurs."""
    import numpy as np

    some = {int(n): int(c) for n, c in histogram.items() if c > 0}
    if not some:
        return []
    lengths = np.array(sorted(some), dtype=np.int64)
    counts = np.array([some[n] for n in lengths.tolist()], dtype=np.int64)
    fractions = near_optimal_fractions(lengths, counts, capacity)
    size = lengths.tolist()
    made = [Pattern({size[i]: n for i, n in key}, x) for key, x in fractions.amounts.items()]
    made.sort(key=lambda p: sum(n * a for n, a in p.lengths.items()))
    few, rest, kept = int(REST * counts.sum()), {}, []
    for p in made:  # the least full first
        each = sum(p.lengths.values())
        again = min(p.count, few // each)
        few -= again * each
        for n, a in p.lengths.items():
            if again:
                rest[n] = rest.get(n, 0) + a * again
        kept += [Pattern(p.lengths, p.count - again)] if p.count > again else []
    return kept + best_fit_decreasing(rest, capacity)


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences filled with the longest piece that is left and fits, over and over, in bulk."""
    from bisect import bisect_right

    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    patterns = []
    while lengths:
        used: dict[int, int] = {}
        room = capacity
        k = len(lengths)
        while k and room > 0:
            k = bisect_right(lengths, room, 0, k)
            if not k:
                break
            n = lengths[k - 1]
            take = min(left[n] - used.get(n, 0), room // n)
            used[n] = used.get(n, 0) + take
            room -= take * n
            k -= 1
        count = min(left[n] // a for n, a in used.items())
        patterns.append(Pattern(used, count))
        for n, a in used.items():
            left[n] -= a * count
            if not left[n]:
                lengths.remove(n)
    return patterns


def placements(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, pieces in a sequence, first sequence, offset), in order of rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for n in sorted(p.lengths, reverse=True):
            a = p.lengths[n]
            found.setdefault(n, []).append((ranks.get(n, 0), a, sequence, offset))
            ranks[n] = ranks.get(n, 0) + a * p.count
            offset += a * n
        sequence += p.count
    return found


PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def cut_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with their rank among those of equal length in their part."""
    end = end_token(end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        schema = pa.schema([(c.split()[0], t) for c, t in zip(PIECE.split(", "), types, strict=True)])
        seen: dict[int, int] = {}
        wide = 4 * capacity
        for docs_here, found in encoded(batches, vocabulary, WORD_LEVEL, end):
            columns: list[list] = [[] for _ in schema]
            for doc, ids in zip(docs_here, found, strict=True):
                for piece, at in enumerate(range(0, len(ids), wide)):
                    some = ids[at : at + wide]
                    n = len(some) // 4
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    for column, value in zip(columns, (doc, piece, at // 4, n, some, part, rank), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack ``docs`` into sequences: doc_id, piece, start, length, ids, sequence_id, offset.

    A document's ids end with ``end_id``; a null text has that one id. Only documents longer than
    ``capacity`` are cut. Rows with equal ids are separate documents; a null id stays null; an
    empty table gives no rows. ``ids`` are little-endian unsigned 32-bit bytes.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.table(cut_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    counts = scratch.table(pieces.groupBy("part", "length").count(), "counts")
    # at most `capacity` rows come to the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    patterns = solve_configurations(histogram, capacity)
    if full:
        patterns.append(Pattern({capacity: 1}, full))
    table = placements(patterns)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("base"))
    if counts.count() <= BROADCAST_BASES:
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("rank") + F.col("base")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        by_length = {n: np.array(v, dtype=np.int64).T for n, v in table.items()}
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                first, each, seq, off = by_length[int(length)]
                j = np.searchsorted(first, rank[at], side="right") - 1
                nth = rank[at] - first[j]
                sequence[at] = seq[j] + nth // each[j]
                offset[at] = off[j] + nth % each[j] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
