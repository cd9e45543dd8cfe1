"""The dealt operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.exact_search import nearest
from siltstone.llm.fill_middle import fill_in_middle, restored
from siltstone.llm.html_text import extract_pages
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.mixing import mix_sources
from siltstone.llm.media import media_features, store_media
from siltstone.llm.ngram_join import jaccard_components
from siltstone.llm.packing import pack
from siltstone.llm.prefix_trie import conversation_nodes
from siltstone.llm.quality import RULES, STOP_WORDS, quality_rules
from siltstone.llm.token_counts import token_counts
from siltstone.llm.token_files import token_files
from siltstone.llm.warc import archive
from siltstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def mix_levels() -> dict[str, Column]:
    """The tree over documents: one domain for the main source, one for the other even and one for the odd sources."""
    even = F.col("source").rlike("[02468]$")
    return {
        "domain": F.when(F.col("source") == "src0", "web").when(even, "books").otherwise("news"),
        "language": F.col("lang"),
        "origin": F.col("source"),
    }


WEIGHTS = {("web",): 3, ("books",): 4, ("news",): 3, ("*", "en"): 6, ("*", "de"): 2}
MIX = {"percent": 80, "max_epochs": 2, "seed": 17}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        "n_removed_lines",
        "n_removed_words",
        F.to_json("removed").alias("removed"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, read = token_files(docs, vocabulary("byte_bpe_50k.json"), end_id=2, vocabulary_size=50257)
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_features(store_media(docs)).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack(docs, vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_sources(docs, mix_levels(), WEIGHTS, **MIX).select(
        "doc_id", "domain", "language", "origin", "n_tokens", "epoch"
    )


def _mix_sql() -> str:
    def level(here: list[str], weight: str, parent: str | None, name: str) -> str:
        by, keys = ", ".join(here[:-1]) or "1", ", ".join(here)
        have = f"(SELECT sum(tokens) * {MIX['percent']} // 100 FROM leaves)" if parent is None else "p.have"
        join = "" if parent is None else f"JOIN {parent} p USING ({', '.join(here[:-1])})"
        order = f"PARTITION BY {by} ORDER BY CAST(cap AS DOUBLE) / w, {here[-1]}"
        return f"""{name}_n AS (
  SELECT {keys}, n.cap, {weight} AS w, CAST({have} AS BIGINT) AS have
  FROM (SELECT {keys}, sum(tokens * {MIX['max_epochs']}) AS cap FROM leaves GROUP BY {keys} HAVING cap > 0) n {join}),
{name}_f AS (SELECT *, (have - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    >= cap * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM {name}_n),
{name} AS (SELECT {keys}, CASE WHEN full_ THEN cap ELSE
    (w * (have - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (PARTITION BY {by}), 0)))
      // sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY {by}) END AS have FROM {name}_f)"""

    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '[02468]$') THEN 'books' ELSE 'news' END
      AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
{level(["domain"], "CASE domain WHEN 'web' THEN 3 WHEN 'books' THEN 4 WHEN 'news' THEN 3 ELSE 1 END", None, "l1")},
{level(["domain", "language"], "CASE language WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END", "l1", "l2")},
{level(["domain", "language", "origin"], "1", "l2", "l3")},
plan AS (SELECT domain, language, origin, CAST(have // tokens AS BIGINT) AS whole, have % tokens AS rest
  FROM leaves JOIN l3 USING (domain, language, origin)),
placed AS (SELECT *, md5(concat_ws(':', '{MIX['seed']}', whole, coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM d JOIN plan USING (domain, language, origin)),
head AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY key RANGE UNBOUNDED PRECEDING) AS run
  FROM placed WHERE rest > 0)
SELECT doc_id, domain, language, origin, n_tokens, CAST(epoch AS INTEGER) AS epoch
  FROM (SELECT *, unnest(range(0, whole)) AS epoch FROM placed)
UNION ALL
SELECT doc_id, domain, language, origin, n_tokens, CAST(whole AS INTEGER) AS epoch FROM head WHERE run <= rest
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, ngram=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary("piece_bpe_32k.model"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_stop_words",
        "n_lines",
        F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def _quality_sql() -> str:
    """The rule table as SQL over the same metrics."""
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"
    broken = []
    for r in RULES:
        sides = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        broken.append(f"CASE WHEN {' OR '.join(sides)} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) >= 2),
cover AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:') IN ({stops}))) AS BIGINT) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN cover USING (rid)),
r AS (
  SELECT *, {ratio("word_chars", "n_words")} AS mean_word_length, {ratio("n_symbols", "n_words")} AS symbol_ratio,
    {ratio("n_stop_words", "n_words")} AS stop_ratio, {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio,
    {ratio("n_bullet_lines", "n_lines")} AS bullet_line_ratio,
    {ratio("n_ellipsis_lines", "n_lines")} AS ellipsis_line_ratio FROM m),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    concat_ws(',', {", ".join(broken)}) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, n_stop_words, n_lines, failed_rules FROM f
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_nodes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: The cyclic redundancy check goes byte by byte, then bit by bit.
_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, text, label,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, label) AS pos
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text,
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''),
      lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, text, label, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS BIGINT) AS depth
  FROM (
    SELECT c.conv_id, 0 AS part, pos, text, label FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
    UNION ALL
    SELECT c.conv_id, 1 AS part, pos, text, label FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h)),
m AS (
  SELECT conv_id, depth, strlen(text) AS bytes, list(label) OVER (PARTITION BY conv_id ORDER BY depth) AS path,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r
  UNION ALL
  SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]), conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (
  SELECT path[1:d] AS path, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
    CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN n p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50, scale=256)


_SEARCH_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT vec_id, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
e AS (SELECT rid, vec_id, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS v FROM usable),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.rid <> c.rid)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
"""

_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS u1,
    greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS u2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:u1], '') AS p, array_to_string(us[u1 + 1:u2], '') AS m,
    array_to_string(us[u2 + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c
"""


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_token_counts": op3_token_counts,
        "op4_html_text": op4_html_text,
        "op5_quality_rules": op5_quality_rules,
        "op6_warc": op6_warc,
        "op7_token_files": op7_token_files,
        "op8_media": op8_media,
        "op9_pack": op9_pack,
        "op10_mix_sources": op10_mix_sources,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_fill_middle": op12_fill_middle,
        "op13_exact_search": op13_exact_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": _quality_sql(),
        "op10_mix_sources": _mix_sql(),
        "op11_prefix_trie": _TRIE_SQL,
        "op12_fill_middle": _MIDDLE_SQL,
        "op13_exact_search": _SEARCH_SQL,
    }
