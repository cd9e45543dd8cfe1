"""Exact top-k search by a vector-approximation file.

1. *Classes.* Components become whole numbers, ``floor(scale * x)``. Rows with equal vectors are one
   class, which keeps its ``k + 1`` smallest ids: no answer needs more of them. A rank window finds
   these, and Spark cuts ranks before the shuffle, so a vector that a third of all rows share is a few
   rows a task.
2. *The file.* Classes are written by pages of at most ``PAGE`` vectors of one width: ids, exact
   numbers, and cells of ``BITS`` bits, which are equal intervals of each dimension between its
   smallest and its largest number in the page.
3. *Scan.* Distinct query vectors are broadcast ``QUERIES`` at a time. In a cell c of width w that
   starts at a, a component lies in [a + w c, a + w c + w - 1], so the upper bounds of a page's scores
   are one product of the matrices of queries and cells and a constant of the query. A task keeps for
   each query its best ``k + 1`` rows so far. Exact numbers of a page are read for those vectors only
   whose bound reaches the score of the last of these: first the ``2 (k + 1)`` with the best bounds,
   then, best bound first, those whose bound still reaches it, until none is left.
4. *Merge.* A task returns at most ``k + 1`` rows a query, and a rank window keeps the best. One page
   of ``FIRST`` is scanned before the rest, so that all others start with a score that ``k + 1`` rows
   are known to reach, and return little. The query's own row is taken out of its list.

Whatever the vectors, no row that could be among the best is left out; ties are kept, as a vector is
read if its bound equals the last score. Pages are large rows; Spark hands them to Python by bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch

if TYPE_CHECKING:
    import pyarrow as pa

K = 5
SCALE = 256
EVERY = 50
BITS = 6
PAGE = 1024
#: Distinct query vectors that a task has in hand at once, and those multiplied with a page at once.
QUERIES = 8192
TILE = 1024
FIRST = 64
#: Pairs of query and vector that are read at once.
PAIRS = 1 << 15
#: Numbers beyond this may have no exact sums in 64 bits; such scores are Python's whole numbers, and end at those of 64 bits.
LARGE = 1 << 24
LEAST, MOST = -(1 << 63), (1 << 63) - 1

WHOLE = "vec_id long, width int, v binary"
PAGES = "width int, ids binary, each binary, exact binary, low binary, step binary, cells binary"
FOUND = "query long, own long, vec_id long, score long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, width, v) of the usable rows; ``v`` holds 16-bit numbers if all fit, else 64-bit ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for vec_id, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not one.is_valid or one.values.null_count:
                    continue
                x = np.floor(scale * one.values.to_numpy().astype(np.float64))
                if not np.isfinite(x).all():
                    continue
                small = not len(x) or np.abs(x).max() < 1 << 15
                rows.append((vec_id, len(x), np.clip(x, -(2.0**62), 2.0**62).astype("<i2" if small else "<i8").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            types = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(WHOLE))

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(cut, WHOLE)


def _numbers(parts: list[bytes], width: int):
    """Vectors of ``width`` as rows of 64-bit numbers."""
    import numpy as np

    rows = [np.frombuffer(v, dtype="<i2" if len(v) == 2 * width else "<i8") for v in parts]
    return np.array(rows, dtype=np.int64).reshape(len(parts), width)


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (width, v, ids) as pages with their cells."""
    import numpy as np
    import pyarrow as pa

    open_: dict[int, list] = {}
    held = 0

    def page(width: int) -> pa.RecordBatch:
        rows = open_.pop(width)
        exact = _numbers([v for v, _ in rows], width)
        ids = np.array([i for _, some in rows for i in some], dtype="<i8")
        each = np.array([len(some) for _, some in rows], dtype="<i4")
        small = not exact.size or np.abs(exact).max() < 1 << 15
        kept = exact.astype("<i2") if small else exact
        low = exact.min(axis=0)
        step = -(-(exact.max(axis=0) - low + 1) // (1 << BITS))  # numbers end at 2 ** 62, so ranges fit 64 bits
        cells = ((exact - low) // step).astype(np.uint8)
        values = (width, *(x.tobytes() for x in (ids, each, kept, low, step, cells)))
        types = [pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names=_names(PAGES))

    for batch in batches:
        for width, v, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            open_.setdefault(width, []).append((v, ids))
            held += 1
            if len(open_[width]) == PAGE or held == 8 * PAGE:
                full = max(open_, key=lambda w: len(open_[w]))
                held -= len(open_[full])
                yield page(full)
    for width in list(open_):
        yield page(width)


class Queries:
    """Distinct query vectors of one width, and their numbers."""

    def __init__(self, numbers: list[int], vectors: list[bytes], width: int):
        import numpy as np

        self.numbers = np.array(numbers)
        self.exact = _numbers(vectors, width)
        self.real = self.exact.astype(np.float64)
        self.size = np.abs(self.real)


class Bounds:
    """Upper bounds of some queries' scores with vectors of a page: the product with the cells plus ``rest``."""

    def __init__(self, q, size, low, step):
        import numpy as np

        low, step = low.astype(np.float64), step.astype(np.float64)
        # sums of whole numbers are exact below 2 ** 24 in 32 bits
        exact = not q.size or ((size @ step).max() * (1 << BITS)) < 1 << 24
        self.matrix = np.ascontiguousarray((q * step).T.astype(np.float32 if exact else np.float64))
        rounding = (size @ (np.abs(low) + step * (1 << BITS))) * (len(low) + 8) * 2.0**-50
        self.rest = q @ low + np.maximum(q, 0) @ (step - 1) + rounding

    def least_products(self, scores):
        """Products below these have bounds under ``scores``; rounded down."""
        import numpy as np

        kind = self.matrix.dtype.type
        return np.nextafter((scores.astype(np.float64) - self.rest).astype(kind), kind(-np.inf))


class Best:
    """The best ``m`` (score, id) of each of ``n`` queries; of equal scores the smaller ids."""

    def __init__(self, n: int, m: int):
        import numpy as np

        self.m = m
        self.scores = np.full((n, m), LEAST, dtype=np.int64)
        self.ids = np.zeros((n, m), dtype=np.int64)
        self.had = np.zeros(n, dtype=np.int64)

    def add(self, query, score, vec_id) -> None:
        import numpy as np

        touched = np.unique(query)
        row, slot = np.nonzero(np.arange(self.m)[None, :] < self.had[touched][:, None])
        row = touched[row]
        q = np.concatenate([row, query])
        s = np.concatenate([self.scores[row, slot], score])
        v = np.concatenate([self.ids[row, slot], vec_id])
        order = np.lexsort((v, ~s, q))  # ~s falls as s grows, over all of 64 bits
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.m
        q, s, v, rank = q[keep], s[keep], v[keep], rank[keep]
        self.scores[q, rank], self.ids[q, rank] = s, v
        self.had[touched] = np.bincount(q, minlength=len(self.had))[touched]

    def reached(self, query):
        """The scores that ``m`` rows are known to reach."""
        return self.scores[query, self.m - 1]


def inner_products(q, v):
    """Products of rows; exact up to the ends of 64 bits."""
    import numpy as np

    largest = max((max(int(x.max()), -int(x.min())) for x in (q, v) if x.size), default=0)
    if largest <= LARGE and q.shape[1] < 1 << 14:
        return np.einsum("ij,ij->i", q, v)
    return np.array([min(max(int(x), LEAST), MOST) for x in (q.astype(object) * v.astype(object)).sum(axis=1)], dtype=np.int64)


class Page:
    def __init__(self, width: int, ids: bytes, each: bytes, exact: bytes, low: bytes, step: bytes, cells: bytes):
        import numpy as np

        self.width, self._exact = width, exact
        self.ids, self.each = np.frombuffer(ids, dtype="<i8"), np.frombuffer(each, dtype="<i4")
        self.starts = np.cumsum(self.each) - self.each
        self.low, self.step = np.frombuffer(low, dtype="<i8"), np.frombuffer(step, dtype="<i8")
        self.cells = np.frombuffer(cells, dtype=np.uint8).reshape(len(self.each), width)

    def exact(self, at):
        """Exact numbers of the vectors at these places."""
        import numpy as np

        kind = "<i2" if len(self._exact) == 2 * self.cells.size else "<i8"
        return np.frombuffer(self._exact, dtype=kind).reshape(self.cells.shape)[at].astype(np.int64)

    def read(self, best: Best, asked: Queries, at, query) -> None:
        """Score the vectors at these places for the queries at those, and give all their ids to ``best``."""
        import numpy as np

        score = inner_products(asked.exact[query], self.exact(at))
        each = self.each[at]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        best.add(np.repeat(asked.numbers[query], each), np.repeat(score, each), self.ids[np.repeat(self.starts[at], each) + nth])

    def search(self, best: Best, asked: Queries, known) -> int:
        """Bring ``best`` up to this page; how many exact vectors were read for it. ``known``: scores that are reached elsewhere."""
        return sum(self._tile(best, asked, known, a) for a in range(0, len(asked.numbers), TILE))

    def _tile(self, best: Best, asked: Queries, known, a: int) -> int:
        import numpy as np

        some = slice(a, a + TILE)
        here = asked.numbers[some]
        bounds = Bounds(asked.real[some], asked.size[some], self.low, self.step)
        least = lambda: bounds.least_products(np.maximum(best.reached(here), known[here]))
        product = self.cells.astype(bounds.matrix.dtype) @ bounds.matrix
        first, reads = 2 * best.m, 0
        many = np.flatnonzero((product >= least()).sum(axis=0) > first)
        if len(many):
            at = np.argpartition(-product[:, many], first - 1, axis=0)[:first].ravel()
            query = np.tile(many, first)
            for k in range(0, len(at), PAIRS):
                self.read(best, asked, at[k : k + PAIRS], a + query[k : k + PAIRS])
            reads += len(at)
            product[at, query] = -np.inf
        at, query = np.nonzero(product >= least())
        order = np.argsort(-(product[at, query] + bounds.rest[query]), kind="stable")
        at, query = at[order], query[order]
        while len(at):
            self.read(best, asked, at[:PAIRS], a + query[:PAIRS])
            reads += len(at[:PAIRS])
            at, query = at[PAIRS:], query[PAIRS:]
            still = product[at, query] >= least()[query]
            at, query = at[still], query[still]
        return reads


def _scan(asked: list[tuple[int, int, bytes]], m: int, known: dict[int, int]):
    """The best ``m`` rows of a task's pages for each query (query, width, v), with its score with itself; ``known``: by query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        best = Best(len(asked), m)
        floor = np.array([known.get(j, LEAST) for j, _, _ in asked], dtype=np.int64)
        of_width: dict[int, Queries] = {}
        for width in {w for _, w, _ in asked}:
            numbers = [j for j, (_, w, _) in enumerate(asked) if w == width]
            of_width[width] = Queries(numbers, [asked[j][2] for j in numbers], width)
        for batch in batches:
            for k in range(batch.num_rows):
                page = Page(*(c[k].as_py() for c in batch.columns))
                if page.width in of_width:
                    page.search(best, of_width[page.width], floor)
        own = np.zeros(len(asked), dtype=np.int64)
        for some in of_width.values():
            own[some.numbers] = inner_products(some.exact, some.exact)
        query, slot = np.nonzero(np.arange(m)[None, :] < best.had[:, None])
        enough = best.scores[query, slot] >= floor[query]
        query, slot = query[enough], slot[enough]
        names = np.array([j for j, _, _ in asked])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[query], own[query], best.ids[query, slot], best.scores[query, slot])], names=_names(FOUND))

    return scan


def _best_of(found: DataFrame, m: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= m)


def nearest(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest inner products for each row whose id is divisible by ``every``.

    Every other row is a candidate, and ties go to the smaller id; a query has fewer rows if there are
    fewer candidates. Rows with a null id, a null vector, or a null or non-finite component take no part,
    and vectors of another width are no candidates. Repeated rows are candidates each; so are rows of
    one id with other vectors, each of which is a query of its own under that id. Numbers end at 2 ** 62
    and scores at the ends of 64 bits. Other columns are left out; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "search")
    spark, m = vectors.sparkSession, k + 1
    rows = whole_numbers(vectors, scale, id_col, vector_col)
    least = Window.partitionBy("width", "v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= m)
    classes = few.groupBy("width", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    pages = scratch.table(classes.mapInArrow(_paged, PAGES), "pages")
    # what is scanned at first: every FIRST-th page by a hash, so that it is the same in each run
    lot = F.pmod(F.xxhash64("ids"), F.lit(FIRST))
    distinct = rows.filter(F.col("vec_id") % every == 0).select("width", "v").distinct()
    asked = scratch.table(distinct.withColumn("query", F.monotonically_increasing_id()), "asked")
    found = None
    blocks = batched(asked.select("query", "width", "v").toLocalIterator(), QUERIES)
    for b, block in enumerate(blocks):
        vectors_asked = [(r["query"], r["width"], bytes(r["v"])) for r in block]
        first = scratch.table(_best_of(pages.filter(lot == 0).mapInArrow(_scan(vectors_asked, m, {}), FOUND), m), f"first-{b}")
        # at most a score a query of the block
        known = {r["query"]: r["score"] for r in first.filter(F.col("rank") == m).select("query", "score").collect()}
        rest = pages.filter(lot != 0).mapInArrow(_scan(vectors_asked, m, known), FOUND)
        one = scratch.table(_best_of(rest.unionByName(first.drop("rank")), m), f"best-{b}")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    listed = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hits"), F.first("own").alias("own"))
    answers = listed.join(asked, "query").select("width", "v", "hits", "own")
    of_rows = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(answers, ["width", "v"])
    own = F.array_position(F.transform("hits", lambda h: (h["vec_id"] == F.col("query_id")) & (h["score"] == F.col("own"))), True)
    others = F.filter("hits", lambda h, i: i + 1 != F.col("self"))
    exploded = of_rows.withColumn("self", own).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("nth", "hit"))
    return exploded.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
