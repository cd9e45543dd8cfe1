"""Chunkers: greedy line packing, document sections, and their chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import classify as C
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.functions.lets import let

MAX_CHARS, MAX_TOKENS = 1_500, 384
METADATA_CHARS = 700
CODE_CHARS = 750
_PART = "array<struct<first:int,last:int,text:string>>"


def split_text(content: Column, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> Column:
    """Array of (first, last, text): parts within both budgets, with line numbers from 0.

    A text within the budgets is one part. Else lines are packed in order, each costing its length
    and one; a line over a budget by itself ends the part before it and is cut into equal segments.
    A part's tokens are counted as the sum of its lines' estimates. The fold keeps line numbers
    only, and texts are put together from the lines at the end.
    """
    rows = F.transform(
        T.lines(content),
        lambda x: F.struct(x.alias("x"), F.length(x).alias("n"), T.token_estimate(x).alias("t")),
    )

    def packed(ls: Column) -> Column:
        none = F.lit(None).cast("string")
        part = lambda a, b, text: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), text.alias("text"))
        start = F.struct(
            F.array().cast(_PART).alias("parts"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("toks"), F.lit(0).alias("i")
        )
        state = lambda parts, first, n, chars, toks, i: F.struct(
            parts.alias("parts"), first.cast("int").alias("first"), n.cast("int").alias("n"), chars.cast("int").alias("chars"), toks.cast("int").alias("toks"), i.cast("int").alias("i")
        )

        def flushed(a: Column) -> Column:
            return F.when(a["n"] > 0, F.concat(a["parts"], F.array(part(a["first"], a["first"] + a["n"] - 1, none)))).otherwise(a["parts"])

        def segments(line: Column, i: Column) -> Column:
            count = F.greatest(F.ceil(line["n"] / max_chars), F.ceil(line["t"] / max_tokens))
            size = F.ceil(line["n"] / count).cast("int")
            return F.transform(F.sequence(F.lit(1), line["n"], size), lambda at: part(i, i, F.substr(line["x"], at, size)))

        def step(a: Column, line: Column) -> Column:
            cost, i = line["n"] + 1, a["i"]
            alone = (cost > max_chars) | (line["t"] > max_tokens)
            full = (a["n"] > 0) & ((a["chars"] + cost > max_chars) | (a["toks"] + line["t"] > max_tokens))
            return (
                F.when(alone, state(F.concat(flushed(a), segments(line, i)), i + 1, F.lit(0), F.lit(0), F.lit(0), i + 1))
                .when(full, state(flushed(a), i, F.lit(1), cost, line["t"], i + 1))
                .otherwise(state(a["parts"], a["first"], a["n"] + 1, a["chars"] + cost, a["toks"] + line["t"], i + 1))
            )

        text = lambda p: F.array_join(F.transform(F.slice(ls, p["first"] + 1, p["last"] - p["first"] + 1), lambda x: x["x"]), "\n")
        done = F.aggregate(ls, start, step, flushed)
        whole = F.array(part(F.lit(0), F.size(ls) - 1, content))
        over = (F.length(content) > max_chars) | (T.token_estimate(content) > max_tokens)
        parts = F.transform(done, lambda p: part(p["first"], p["last"], F.coalesce(p["text"], text(p))))
        return F.when(over, parts).otherwise(whole)

    return let(rows, packed)


def split_lines(content: Column, max_chars: int = CODE_CHARS) -> Column:
    """As ``split_text`` without token budget; a line over the budget becomes a part of its own, uncut."""
    rows = F.transform(T.lines(content), lambda x: F.length(x) + 1)

    def packed(costs: Column) -> Column:
        empty = F.array().cast("array<struct<first:int,last:int>>")
        start = F.struct(empty.alias("parts"), F.lit(0).alias("first"), F.lit(0).alias("chars"), F.lit(0).alias("i"))

        def closed(a: Column) -> Column:
            return F.concat(a["parts"], F.array(F.struct(a["first"].alias("first"), (a["i"] - 1).cast("int").alias("last"))))

        def step(a: Column, cost: Column) -> Column:
            full = (a["i"] > a["first"]) & (a["chars"] + cost > max_chars)
            nxt = (a["i"] + 1).cast("int").alias("i")
            return F.when(full, F.struct(closed(a).alias("parts"), a["i"].alias("first"), cost.cast("int").alias("chars"), nxt)).otherwise(
                F.struct(a["parts"].alias("parts"), a["first"].alias("first"), (a["chars"] + cost).cast("int").alias("chars"), nxt)
            )

        return F.aggregate(costs, start, step, closed)

    def texts(parts: Column) -> Column:
        ls = T.lines(content)
        return F.transform(parts, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.array_join(F.slice(ls, p["first"] + 1, p["last"] - p["first"] + 1), "\n").alias("text")))

    return let(let(rows, packed), texts)


def exploded(parts: str) -> Column:
    """(k, p) of a column of arrays that are never empty.

    Of a plain explode Spark infers a filter on size and null, and computes the arrays again for each.
    """
    return F.posexplode_outer(parts)


def text_chunks(files: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(file_path, part, parts, start_line, end_line, content): parts of each file, numbered from 1."""
    parts = files.select("file_path", split_text(F.col("content"), max_chars, max_tokens).alias("ps"))
    return parts.select("file_path", F.size("ps").alias("parts"), exploded("ps").alias("k", "p")).select(
        "file_path",
        (F.col("k") + 1).alias("part"),
        "parts",
        (F.col("p.first") + 1).alias("start_line"),
        (F.col("p.last") + 1).alias("end_line"),
        F.col("p.text").alias("content"),
    )


def sections(files: DataFrame, *keep: str) -> DataFrame:
    """(file_path, title, start_line, end_line, content, symbol_kind): sections of documentation files, and the columns to ``keep``.

    A heading's kind depends on the language; a section reaches to the line before the next one, what
    precedes the first is left out, and a file without headings is one ``Document``.
    """
    lang = C.language(F.col("file_path"), C.DOCUMENTATION_LANGUAGES)
    ls = files.select(*keep, "file_path", lang.alias("lang"), T.lines(F.col("content")).alias("ls"))

    def title(x: Column, i: Column) -> Column:
        rule, before = F.get("ls", i + 1), F.trim(x)
        rule = F.trim(rule)
        underlined = (before != "") & rule.rlike(r'^(=+|-+|~+|\^+|"+)$|^[=\-~^"]+$') & (F.length(rule) >= F.least(F.lit(3), F.length(before)))
        html = F.trim(T.strip_tags(F.regexp_extract(x, C.HTML_HEADING, 1)))
        return (
            F.when(F.col("lang").isin("markdown", "mdx") & x.rlike(C.MARKDOWN_HEADING), F.trim(F.regexp_extract(x, C.MARKDOWN_HEADING, 1)))
            .when((F.col("lang") == "html") & (html != ""), html)
            .when((F.col("lang") == "rst") & underlined, before)
            .when((F.col("lang") == "asciidoc") & x.rlike(C.ASCIIDOC_HEADING), F.trim(F.regexp_extract(x, C.ASCIIDOC_HEADING, 1)))
        )

    heads = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), title(x, i).alias("title"))), lambda h: h["title"].isNotNull())
    found = ls.withColumn("hs", heads)
    n = F.size("ls")
    spans = F.transform("hs", lambda h, k: F.struct(h["title"].alias("title"), h["i"].alias("a"), F.coalesce(F.get("hs", k + 1)["i"], n).alias("b"), F.lit("DocumentSection").alias("kind")))
    whole = F.array(F.struct(P.file_name(F.col("file_path")).alias("title"), F.lit(0).alias("a"), n.alias("b"), F.lit("Document").alias("kind")))
    return found.select(*keep, "file_path", "lang", "ls", F.explode(F.when(F.size("hs") > 0, spans).otherwise(whole)).alias("s")).select(
        *keep,
        "file_path",
        F.col("lang").alias("language"),
        F.col("s.title").alias("title"),
        (F.col("s.a") + 1).alias("start_line"),
        F.col("s.b").alias("end_line"),
        F.array_join(F.slice("ls", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")), "\n").alias("content"),
        F.col("s.kind").alias("symbol_kind"),
    )


def _as_chunks(units: DataFrame, max_chars: int, max_tokens: int) -> DataFrame:
    """Units (with title, kind, lines and content) cut to size, as rows of the chunk table."""
    cut = units.withColumn("ps", split_text(F.col("content"), max_chars, max_tokens)).withColumn("many", F.size("ps") > 1)
    rows = cut.select(*[c for c in cut.columns if c not in ("ps", "content", "end_line")], exploded("ps").alias("k", "p"), "end_line")
    part = F.when(F.col("many"), F.col("k") + 1).otherwise(0)
    first = F.when(F.col("many"), F.col("start_line") + F.col("p.first")).otherwise(F.col("start_line"))
    last = F.when(F.col("many"), F.col("start_line") + F.col("p.last")).otherwise(F.col("end_line"))
    name = F.when(F.col("many"), F.concat("title", F.lit(" part "), part.cast("string"))).otherwise(F.col("title"))
    kind = F.when(F.col("many"), F.concat("symbol_kind", F.lit("Part"))).otherwise(F.col("symbol_kind"))
    return rows.select(
        K.chunk_id(P.relative(F.col("file_path"), F.col("workspace_root")), first, last, F.col("title"), part).alias("id"),
        "workspace_root",
        "file_path",
        "language",
        name.alias("symbol_name"),
        kind.alias("symbol_kind"),
        first.cast("int").alias("start_line"),
        last.cast("int").alias("end_line"),
        F.col("p.text").alias("content"),
        "content_type",
        C.index_profile(F.col("file_path"), F.col("content_type")).alias("index_profile"),
    )


def documentation_chunks(files: DataFrame) -> DataFrame:
    """Chunks of documentation files (workspace_root, file_path, content)."""
    return _as_chunks(sections(files, "workspace_root").withColumn("content_type", F.lit("documentation")), MAX_CHARS, MAX_TOKENS)


def metadata_chunks(files: DataFrame) -> DataFrame:
    """Chunks of project files: the whole file under a header, cut to 700 characters."""
    role = C.metadata_role(F.col("file_path"))
    name = P.file_name(F.col("file_path"))
    units = files.select(
        "workspace_root",
        "file_path",
        role["language"].alias("language"),
        name.alias("title"),
        role["role"].alias("symbol_kind"),
        F.lit(1).alias("start_line"),
        F.size(T.lines(F.col("content"))).alias("end_line"),
        T.metadata_header(name, role["role"], F.col("content")).alias("content"),
        F.lit("project_metadata").alias("content_type"),
    )
    return _as_chunks(units, METADATA_CHARS, MAX_TOKENS)


def brace_ends(code: DataFrame) -> DataFrame:
    """(…, balance): running count of open braces by file and line, strings and comments left out.

    ``code`` has a row for each line: file_path, line, text.
    """
    bare = T.strip_code(F.col("text"))
    change = F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))
    upto = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return code.withColumn("balance", F.sum(change).over(upto))


def chunk_context(chunks: DataFrame, file_path: str, line: int, before: int = 20, after: int = 20) -> DataFrame:
    """(file_path, line, text) of the lines around ``line``, from stored chunks, with their numbers in front.

    Where chunks overlap, the one that starts (then ends) later gives the line. No row: not indexed.
    """
    mine = chunks.filter(P.path_key(F.col("file_path")) == file_path.lower()).filter(F.col("start_line") <= line + after)
    spread = mine.select("file_path", "start_line", "end_line", F.posexplode(T.lines(F.col("content"))).alias("k", "text"))
    placed = spread.withColumn("line", F.col("start_line") + F.col("k")).filter(F.col("line").between(line - before, line + after))
    last = placed.groupBy("file_path", "line").agg(F.max(F.struct("start_line", "end_line", "k", "text"))["text"].alias("text"))
    return last.select("file_path", "line", T.numbered_line(F.col("line"), F.col("text")).alias("text"))


def symbol_details(chunks: DataFrame, file_path: str, symbol: str) -> DataFrame:
    """The first chunk of a file with the symbol's name."""
    same = (P.path_key(F.col("file_path")) == file_path.lower()) & (F.lower("symbol_name") == symbol.lower())
    return chunks.filter(same).orderBy("start_line", "end_line", "symbol_kind").limit(1)
