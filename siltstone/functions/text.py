"""Scalar text functions: token estimates, previews, keyword scores, headers and line numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.lets import let

# fixed values: what counts as a token, and how much of a text is embedded
TOKEN = r"[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s\p{Z}]"
EMBED_CHARS = 8_000


def token_estimate(text: Column) -> Column:
    """Words and marks, or a quarter of the characters if that is more; 0 for an empty text."""
    found = F.regexp_count(text, F.lit(TOKEN))
    return F.when(text == "", 0).otherwise(F.greatest(found, F.floor((F.length(text) + 3) / 4).cast("int")))


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(newlines(text), "\n")


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def preview(text: Column) -> Column:
    return shortened(text, 400)


def packed_preview(text: Column) -> Column:
    return shortened(text, 600)


def keyword_tokens(query: Column) -> Column:
    """Parts between single spaces, trimmed, without empty ones; repeats stay."""
    return F.filter(F.transform(F.split(query, " "), F.trim), lambda t: t != "")


def keyword_score(content: Column, query: Column) -> Column:
    """Share of the query's tokens that the content holds, whatever their case; 0 without tokens."""
    low = F.lower(content)

    def share(tokens: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda t: F.contains(low, F.lower(t))))
        return F.when(F.size(tokens) == 0, 0.0).otherwise(hits / F.size(tokens))

    return let(keyword_tokens(query), share)


def numbered_line(number: Column, line: Column) -> Column:
    return F.format_string("%5d: %s", number, line)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_code(line: Column) -> Column:
    """A line of code without strings and line comment, for counting braces."""
    quoted = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)"""
    return F.regexp_replace(F.regexp_replace(line, quoted, '""'), r"(?<!:)//.*$", "")


def member_header(symbol: Column, namespace: Column, context: Column, bases: Column, content: Column) -> Column:
    """Content under lines that name its symbol and surroundings; blank ones are left out."""
    line = lambda label, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label), c))
    head = F.concat_ws("\n", line("Symbol: ", symbol), line("Namespace: ", namespace), line("Type context: ", context), line("Base types: ", bases))
    return F.when(head == "", content).otherwise(F.concat(head, F.lit("\n\n"), content))


def metadata_header(name: Column, role: Column, content: Column) -> Column:
    return F.concat(F.lit("Metadata file: "), name, F.lit("\nRole: "), role, F.lit("\n\n"), content)


def element_symbol(tag: Column, markup: Column) -> Column:
    """tag#name, else tag.class, else tag."""
    name = F.regexp_extract(markup, r"""\b(?:id|x:Name|Name|asp:ID)\s*=\s*["']([^"']+)["']""", 1)
    first = F.regexp_extract(markup, r"""\bclass\s*=\s*["']([^"'\s]+)""", 1)
    return F.when(name != "", F.concat(tag, F.lit("#"), name)).when(first != "", F.concat(tag, F.lit("."), first)).otherwise(tag)


def branch_of_ref(ref: Column) -> Column:
    return F.regexp_replace(ref, "^refs/heads/", "")
