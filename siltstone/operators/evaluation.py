"""Offline evaluation of retrieval: ranks of expected results, and the suite's metrics."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schemas as S


def load_suite(text: str) -> dict[str, Any]:
    """A suite from JSON that may hold comments and trailing commas, outside of its strings."""
    string = r'"(?:\\.|[^"\\])*"'
    bare = re.sub(rf"({string})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)
    bare = re.sub(rf"({string})|,(?=\s*[\]}}])", lambda m: m[1] or "", bare)
    suite = json.loads(bare)
    if not isinstance(suite.get("queries"), list):
        raise ValueError("a suite needs queries")
    return suite


def setting(name: str, query: dict, request: dict, suite: dict, default: Any = None) -> Any:
    """The query's own value, else the request's, the suite's, and the default."""
    for source in (query, request, suite):
        value = source.get(name)
        if value is not None and value != "":
            return value
    return default


def query_settings(suite: dict, request: dict | None = None) -> list[dict]:
    """By query, what it runs with."""
    out = []
    for q in suite["queries"]:
        get = lambda n, d=None, q=q: setting(n, q, request or {}, suite, d)
        named = {n: get(n) for n in ("workspaceRoot", "workspaceGroup", "scope", "searchProfile", "contentType", "retrievalMode")}
        out.append({"name": q.get("name") or q["query"], "query": q["query"], "limit": S.clamp_limit(get("limit", 10)), "hybrid": get("hybrid", True), **named})
    return out


def accepts(result: dict[str, Column], expected: dict[str, Column]) -> Column:
    """All of an expectation's non-blank conditions hold for a result, whatever the case."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    slash = lambda c: F.translate(low(c), "\\", "/")
    blank = lambda name: F.trim(low(expected[name])) == ""
    path, want = slash(result["file_path"]), slash(expected["file"])
    return (
        (blank("file") | F.contains(path, want))
        & (blank("fileContains") | F.contains(path, slash(expected["fileContains"])))
        & (blank("symbol") | (low(result["symbol_name"]) == low(expected["symbol"])))
        & (blank("symbolContains") | F.contains(low(result["symbol_name"]), low(expected["symbolContains"])))
        & (blank("contentContains") | F.contains(low(result["preview"]), low(expected["contentContains"])))
        & (blank("contentType") | (low(result["content_type"]) == low(expected["contentType"])))
        & (blank("indexProfile") | (low(result["index_profile"]) == low(expected["indexProfile"])))
    )


_FIELDS = ("file", "fileContains", "symbol", "symbolContains", "contentContains", "contentType", "indexProfile")


def best_ranks(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, best_rank): first rank that an expectation accepts, null without one.

    ``queries`` has query_id and ``expected``, an array of structs; ``results`` query_id, rank and the
    columns of a hit. A query without expectations passes with its first result. Expectations stay
    in the query's row, so a result meets only those of its own query.
    """
    joined = queries.select("query_id", "expected").join(results, "query_id", "left")
    columns = {c: F.col(c) for c in ("file_path", "symbol_name", "preview", "content_type", "index_profile")}
    hit = F.when(F.size("expected") == 0, F.lit(True)).otherwise(F.exists("expected", lambda e: accepts(columns, {f: e[f] for f in _FIELDS})))
    return joined.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("best_rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    """One row: queries, passed, pass rate, hit rates at 1 and 5, mean reciprocal rank, average best rank."""
    n, r = F.count(F.lit(1)), F.col("best_rank")
    share = lambda c: F.when(n == 0, 0.0).otherwise(F.coalesce(F.count_if(c), F.lit(0)) / n)
    return ranks.agg(
        n.alias("queries"),
        F.count("best_rank").alias("passed"),
        share(r.isNotNull()).alias("pass_rate"),
        share(r <= 1).alias("hit_rate_at_1"),
        share(r <= 5).alias("hit_rate_at_5"),
        F.coalesce(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("average_best_rank"),
    )


def ranked(results: DataFrame) -> DataFrame:
    """Results with their position by score in each query."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "point_id")))


def exit_code(passed: int, queries: int) -> int:
    return 0 if passed == queries else 2
