"""Identifiers and fingerprints, as expressions over stable digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import paths as P

COLLECTION_CHARS = 64


def workspace_id(root: Column) -> Column:
    """32 hex digits of the root's digest; roots with a drive letter or share are the same in any case."""
    n = P.normalise(root)
    same = F.when(n.rlike(r"^([A-Za-z]:[\\/]|\\\\)"), F.upper(n)).otherwise(n)
    return F.substring(F.sha2(same, 256), 1, 32)


def guid(text: Column) -> Column:
    """A name-based UUID from the text's SHA-256: version 5 and variant bits set, first three groups byte-swapped."""
    h = F.sha2(text, 256)
    byte = lambda i: F.substring(h, 2 * i + 1, 2)
    # the nibble of a byte's high half keeps nothing (version) or its two low bits (variant)
    version = F.concat(F.lit("5"), F.substring(h, 14, 1))
    high = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8
    variant = F.concat(F.lower(F.hex(high)), F.substring(h, 18, 1))
    b = [byte(i) for i in range(16)]
    b[6], b[8] = version, variant
    groups = [(3, 2, 1, 0), (5, 4), (7, 6), (8, 9), (10, 11, 12, 13, 14, 15)]
    return F.concat_ws("-", *[F.concat(*[b[i] for i in g]) for g in groups])


def point_id(workspace: Column, chunk: Column) -> Column:
    return guid(F.concat_ws(":", workspace, chunk))


def state_key(workspace: Column, page: Column | None = None) -> Column:
    base = F.concat(F.lit("index-state:"), workspace)
    return guid(base if page is None else F.concat(base, F.lit(":page:"), page.cast("string")))


def registry_key(workspace: Column) -> Column:
    return guid(F.concat(F.lit("workspace-registry:"), workspace))


def group_key(name: Column) -> Column:
    return guid(F.concat(F.lit("workspace-group:"), F.lower(F.trim(name))))


def collection_prefix(prefix: Column, default: str = "siltstone") -> Column:
    """Lower-case with runs of other characters as one hyphen, no marks at the ends, up to 64 characters."""
    clean = F.regexp_replace(F.lower(F.trim(prefix)), r"[^a-zA-Z0-9_.-]+", "-")
    ends = F.regexp_replace(clean, r"^[-_.]+|[-_.]+$", "")
    return F.coalesce(F.nullif(F.substring(ends, 1, COLLECTION_CHARS), F.lit("")), F.lit(default))


def collection_name(prefix: Column, workspace: Column) -> Column:
    return F.concat_ws("-", collection_prefix(prefix), workspace)


def staging_name(name: Column, stamp: Column, unique: Column) -> Column:
    """Name of a collection being built; cut to 63 characters."""
    return F.substring(F.concat(name, F.lit("-stage-"), F.date_format(stamp, "yyyyMMddHHmmssSSS"), unique), 1, 63)


def content_fingerprint(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.upper(F.sha2(content, 256)))


def metadata_fingerprint(size: Column, written: Column) -> Column:
    """Size and time of the last write, in 100 ns ticks since the year 1."""
    ticks = (F.unix_micros(written) * 10 + F.lit(621_355_968_000_000_000)).cast("string")
    return F.concat(F.lit("metadata:"), size.cast("string"), F.lit(":"), ticks)


def embedding_key(content: Column, limit: int = 8_000) -> Column:
    return F.sha2(F.substring(content, 1, limit), 256)


def chunk_id(relative_path: Column, start: Column, end: Column, symbol: Column, part: Column | None = None) -> Column:
    """Path, lines and symbol; parts of a split chunk add their number."""
    clean = F.regexp_replace(symbol, r"[^\p{L}\p{Nd}]", "-")
    clean = F.coalesce(F.nullif(F.regexp_replace(clean, "^-+|-+$", ""), F.lit("")), F.lit("chunk"))
    whole = F.concat_ws(":", relative_path, start.cast("string"), end.cast("string"), clean)
    return whole if part is None else F.when(part > 0, F.concat(whole, F.lit(":part:"), part.cast("string"))).otherwise(whole)
