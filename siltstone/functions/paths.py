"""Path expressions: keys, parts, containment and globs. Comparison ignores case throughout."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class words of globs may not hold these.
_SPECIAL = re.compile(r"[.^$+{}\[\]()|\\]")


def path_key(path: Column) -> Column:
    """What paths are compared by."""
    return F.lower(path)


def normalise(path: Column) -> Column:
    """One kind of separator and none at the end; paths with a drive letter or share keep backslashes."""
    windows = path.rlike(r"^([A-Za-z]:[\\/]|\\\\)")
    turned = F.when(windows, F.translate(path, "/", "\\")).otherwise(F.translate(path, "\\", "/"))
    trimmed = F.regexp_replace(turned, r"(?<=.)[\\/]+$", "")
    return F.when(trimmed.rlike(r"^[A-Za-z]:$"), F.concat(trimmed, F.lit("\\"))).otherwise(trimmed)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(slashed(path), r"/?[^/]*$", "")


def is_under(path: Column, root: Column) -> Column:
    """The root itself or anything below it, with either separator."""
    p, r = F.lower(slashed(path)), F.rtrim(F.lower(slashed(root)), F.lit("/"))
    return (p == r) | F.startswith(p, F.concat(r, F.lit("/")))


def sort_key(path: Column) -> Column:
    """What rows are ordered by: paths below a directory stand together."""
    return F.lower(slashed(path))


def subtree(key: Column, root: str) -> Column:
    """Whether a ``sort_key`` is the root's or below it: two comparisons with fixed values, which a scan can use.

    All that starts with "root/" lies between "root/" and "root0", as 0 follows the slash.
    """
    r = root.replace("\\", "/").lower().rstrip("/")
    return (key == r) | ((key >= f"{r}/") & (key < f"{r}0"))


def relative(path: Column, root: Column) -> Column:
    """Path below the root with forward slashes; null outside of it."""
    p, r = slashed(path), F.rtrim(slashed(root), F.lit("/"))
    return F.when(is_under(path, root), F.substring(p, F.length(r) + 2, F.length(p)))


def segments(path: Column) -> Column:
    return F.split(F.lower(slashed(path)), "/")


def wildcard(pattern: str) -> str:
    """Regex of a file pattern: * is anything, separators too, and ? one character."""
    body = _SPECIAL.sub(lambda m: "\\" + m[0], pattern).replace("*", ".*").replace("?", ".")
    return f"(?is)^{body}$"


def glob(pattern: str) -> str:
    """Regex of a path glob: ** crosses separators, * and ? do not."""
    body = _SPECIAL.sub(lambda m: "\\" + m[0], pattern.replace("\\", "/"))
    body = body.replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*")
    return f"(?is)^{body}$"


def matches_any(path: Column, patterns: Sequence[str], to_regex) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(to_regex(p))
    return found


def matches_glob(path: Column, root: Column, patterns: Sequence[str]) -> Column:
    """Any glob on the path below the root or on the full path."""
    full = slashed(path)
    return matches_any(full, patterns, glob) | F.coalesce(matches_any(relative(path, root), patterns, glob), F.lit(False))


def excluded_file(path: Column, root: Column, patterns: Sequence[str]) -> Column:
    """Any wildcard on the name or on the path below the root."""
    below = F.coalesce(relative(path, root), file_name(path))
    return matches_any(file_name(path), patterns, wildcard) | matches_any(below, patterns, wildcard)


def excluded_directory(path: Column, root: Column, excludes: Sequence[str]) -> Column:
    """Some directory between the root and the file is excluded by its name or its path below the root."""
    names = [e.replace("\\", "/").strip("/").lower() for e in excludes if e.strip("/\\ ")]
    plain, paths = [e for e in names if "/" not in e], [e for e in names if "/" in e]
    below = F.lower(F.coalesce(relative(path, root), F.lit("")))
    dirs = F.split(F.regexp_replace(below, r"/?[^/]*$", ""), "/")
    hit = F.arrays_overlap(dirs, F.array(*map(F.lit, plain))) if plain else F.lit(False)
    for p in paths:
        hit = hit | F.startswith(below, F.lit(p + "/"))
    return hit


def _run_at(parts: Column, want: list[str]):
    return lambda i: F.slice(parts, i, F.lit(len(want))) == F.array(*map(F.lit, want))


def excluded_root(path: Column, root: Column, excludes: Sequence[str]) -> Column:
    """The shallowest directory that an exclude names, anywhere in the path below the root; null without one.

    An exclude of several parts matches them in a row, and at least the file name must follow.
    """
    parts = segments(F.coalesce(relative(path, root), F.lit("")))
    found = []
    for e in excludes:
        want = [x for x in e.replace("\\", "/").lower().split("/") if x]
        if not want:
            continue
        last = F.size(parts) - len(want)
        starts = F.when(last > 0, F.filter(F.sequence(F.lit(1), last), _run_at(parts, want)))
        found.append(F.when(F.size(starts) > 0, F.struct((starts[0] + len(want) - 1).alias("n"), F.lit(len(want)).alias("w"))))
    if not found:
        return F.lit(None).cast("string")
    least = F.array_min(F.array_compact(F.array(*found)))
    kept = F.array_join(F.slice(F.split(relative(path, root), "/"), F.lit(1), least["n"]), "/")
    return F.when(least.isNotNull(), F.concat(F.rtrim(slashed(root), F.lit("/")), F.lit("/"), kept))
