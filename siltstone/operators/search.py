"""Similarity search: filters, top-k, hybrid scores, re-ranking and packing of results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import batched
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import classify as C
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.functions.vectors import cosine_to

if TYPE_CHECKING:
    import pyarrow as pa

OVERFETCH = 5
MAX_CANDIDATES = 50
DIGITS = 6  # similarities are rounded so that ties are ties on every machine
MAX_QUERIES = 10_000
#: Rows and queries that are multiplied at once: a task's arrays have this many numbers squared, however many of either there are.
TILE = 1024


@dataclass(frozen=True)
class Search:
    """What a search asks for."""

    vector: tuple[float, ...]
    text: str = ""
    limit: int = 10
    hybrid: bool = False
    content_type: str | None = None
    profile: str | None = None
    mode: str | None = None
    index_profile: str | None = None

    def checked(self) -> Search:
        return replace(
            self,
            limit=S.clamp_limit(self.limit),
            content_type=S.normal_content_type(self.content_type),
            profile=S.normal_profile(self.profile),
            mode=S.normal_mode(self.mode),
            index_profile=None if S.normal_profile(self.index_profile) == "all" else S.normal_profile(self.index_profile),
        )

    @property
    def candidates(self) -> int:
        return min(MAX_CANDIDATES, max(1, self.limit) * OVERFETCH)


def filtered(vectors: DataFrame, s: Search, workspaces: Sequence[str] | None = None) -> DataFrame:
    """Vectors that the store's own filters leave; all of them reach the scan."""
    if workspaces is not None:
        vectors = vectors.filter(F.col("workspace_id").isin(*workspaces))
    if s.content_type:
        vectors = vectors.filter(F.lower("content_type") == s.content_type)
    if s.index_profile:
        vectors = vectors.filter(F.lower("index_profile") == s.index_profile)
    return vectors


def top(scored: DataFrame, k: int, by: Sequence[str] = (), score: str = "score", tie: str = "point_id") -> DataFrame:
    """The ``k`` best rows, by group if asked, with ``rank`` from 1; of equal scores the smaller ``tie``."""
    if not by:
        best = scored.orderBy(F.col(score).desc(), tie).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), tie)))
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def semantic(vectors: DataFrame, vector: Sequence[float]) -> DataFrame:
    return vectors.withColumn("score", F.round(cosine_to(F.col("embedding"), list(vector)), DIGITS))


def keyword_boosted(scored: DataFrame, text: str) -> DataFrame:
    return scored.withColumn("score", F.round(F.col("score") + T.keyword_score(F.col("content"), F.lit(text)), DIGITS))


def hybrid_exact(vectors: DataFrame, s: Search, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Every row's cosine plus keyword share, then the best."""
    return top(keyword_boosted(semantic(vectors, s.vector), s.text), k, by)


def hybrid_rerank(vectors: DataFrame, s: Search, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The best ``5 k`` by cosine, then the best ``k`` of these by cosine plus keyword share."""
    first = top(semantic(vectors, s.vector), k * OVERFETCH, by).drop("rank")
    return top(keyword_boosted(first, s.text), k, by)


def search(vectors: DataFrame, s: Search, workspaces: Sequence[str] | None = None) -> DataFrame:
    """The whole read path over any number of workspaces in one job: result rows with ``rank``."""
    s = s.checked()
    rows, by = filtered(vectors, s, workspaces), ["workspace_id"]
    if s.hybrid:
        found = hybrid_rerank(rows, s, s.candidates, by)
    else:
        found = top(semantic(rows, s.vector), s.candidates, by)
    kept = found.filter(
        C.in_search_profile(s.profile or "all", F.col("index_profile"), F.col("content_type"), F.col("language"), F.col("file_path"), F.col("symbol_name"))
    )
    boosted = kept.withColumn("score", F.round(F.col("score") * C.mode_boost(s.mode or "balanced", F.col("content_type")), DIGITS))
    return packed(boosted.withColumn("query_id", F.lit(0)), s.limit).drop("query_id")


_HIT = ("file_path", "symbol_name", "symbol_kind", "start_line", "end_line", "score", "preview", "content_type", "index_profile", "language")


def packed(results: DataFrame, limit: int, tie: str = "point_id") -> DataFrame:
    """Merge touching ranges of one symbol along the ranking: query_id, rank, and the columns of a hit.

    Hits are walked by score. A hit whose file, content type and symbol match an earlier one merges
    with the latest such hit if their lines overlap or touch; else it is emitted and becomes the one
    to merge with. The walk ends as soon as ``limit`` hits are out. A query has a few hundred
    candidates at most, so its walk is a fold over one array.
    """
    limit = max(1, limit)
    hit = F.struct(
        (-F.col("score")).alias("order"),
        F.col(tie).alias("tie"),
        F.concat_ws("\0", F.lower("file_path"), F.lower("content_type"), F.lower("symbol_name")).alias("key"),
        *[F.col(c) for c in _HIT],
        F.lit(True).alias("current"),
    )
    hits = results.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))

    def merged(e: Column, r: Column) -> Column:
        both = F.when(F.contains(e["preview"], r["preview"]), e["preview"]).otherwise(T.packed_preview(F.concat(e["preview"], F.lit("\n"), r["preview"])))
        return (
            e.withField("start_line", F.least(e["start_line"], r["start_line"]))
            .withField("end_line", F.greatest(e["end_line"], r["end_line"]))
            .withField("score", F.greatest(e["score"], r["score"]))
            .withField("preview", both)
        )

    def step(out: Column, r: Column) -> Column:
        meets = lambda e: e["current"] & (e["key"] == r["key"]) & (e["start_line"] <= r["end_line"] + 1) & (r["start_line"] <= e["end_line"] + 1)
        widened = F.transform(out, lambda e: F.when(meets(e), merged(e, r)).otherwise(e))
        passed = F.transform(out, lambda e: e.withField("current", e["current"] & (e["key"] != r["key"])))
        new = F.array(r.withField("preview", T.packed_preview(r["preview"])))
        return F.when(F.size(out) >= limit, out).when(F.exists(out, meets), widened).otherwise(F.concat(passed, new))

    folded = hits.withColumn("out", F.aggregate("hits", F.slice("hits", 1, 0), step))
    return folded.select("query_id", F.posexplode("out").alias("k", "h")).select("query_id", (F.col("k") + 1).alias("rank"), *[F.col(f"h.{c}").alias(c) for c in _HIT])


def batched_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "point_id") -> DataFrame:
    """(query_id, point_id, score, rank) for a table of queries (query_id, vector), in one scan of the vectors.

    Arrow batches are multiplied with the matrix of queries tile by tile, and a task keeps its best
    ``k`` a query so far, so what is shuffled is at most ``k`` rows a query and task, and no row is
    paired with all queries as a row. The queries go to every task, at most MAX_QUERIES at once: more
    are done in blocks, with a scan for each.
    """
    blocks = batched(queries.select("query_id", "vector").toLocalIterator(), MAX_QUERIES)
    found = [_best_of_block(vectors, list(block), k, id_col) for block in blocks]
    if not found:
        return top(vectors.sparkSession.createDataFrame([], f"query_id long, {id_col} long, score double"), k, ["query_id"], tie=id_col)
    return top(reduce(DataFrame.unionByName, found), k, ["query_id"], tie=id_col)


def _best_of_block(vectors: DataFrame, asked: list, k: int, id_col: str) -> DataFrame:
    """(query_id, point_id, score): the best ``k`` of each task's vectors for each query of a block."""
    import numpy as np

    ids = np.array([r.query_id for r in asked], dtype=np.int64)
    q = np.array([[float(x) for x in r.vector] for r in asked], dtype=np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        own = np.sqrt((q * q).sum(axis=1))
        held = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                some = batch.slice(at, TILE)
                names, v = some.column(0).to_numpy(zero_copy_only=False), _matrix(some.column(1), q.shape[1])
                norms = np.sqrt((v * v).sum(axis=1))
                for a in range(0, len(ids), TILE):
                    scale = own[a : a + TILE, None] * norms
                    usable = (scale > 0) & np.isfinite(scale)
                    scores = np.round(np.divide(q[a : a + TILE] @ v.T, scale, out=np.zeros_like(scale), where=usable), DIGITS) + 0.0
                    _keep_best(held[0][a : a + TILE], held[1][a : a + TILE], scores, names)
        for a in range(0, len(ids), TILE):
            found, at = np.nonzero(np.isfinite(held[0][a : a + TILE]))
            found += a
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(held[1][found, at]), pa.array(held[0][found, at])], names=["query_id", id_col, "score"])

    return vectors.select(F.col(id_col).cast("long"), F.col("embedding")).mapInArrow(best, f"query_id long, {id_col} long, score double")


def _matrix(column: pa.ListArray, width: int):
    """The vectors of a column as rows; zeros for those that are null or of another width."""
    import numpy as np

    v = np.zeros((len(column), width))
    usable = np.flatnonzero(np.array(column.value_lengths().fill_null(-1)) == width)
    if len(usable):
        v[usable] = column.take(usable).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return v


def _keep_best(best, names, scores, ids) -> None:
    """Put what of ``scores`` (queries x rows with ``ids``) is among the best into ``best`` and ``names`` (queries x k), in place; of equal scores the smaller id."""
    import numpy as np

    k = best.shape[1]
    better = (scores > best[:, -1:]) | ((scores == best[:, -1:]) & (ids < names[:, -1:]))
    if scores.shape[1] > k:
        better &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
    q, at = np.nonzero(better)
    met = np.unique(q)
    if not len(met):
        return
    of, score, name = np.concatenate([np.repeat(met, k), q]), np.concatenate([best[met].ravel(), scores[q, at]]), np.concatenate([names[met].ravel(), ids[at]])
    order = np.lexsort((name, -score, of))
    of, score, name = of[order], score[order], name[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    kept = place < k
    best[of[kept], place[kept]], names[of[kept], place[kept]] = score[kept], name[kept]
