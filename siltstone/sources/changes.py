"""Change lists and identities from version control and webhooks."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "seq int, path string, op string"
HOOK = (
    "ref string, after string, repository struct<clone_url:string,html_url:string>, "
    "commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>, "
    "head_commit struct<added:array<string>,modified:array<string>,removed:array<string>>"
)


def parse_status(output: str) -> list[tuple[str, str]]:
    """(path, op) of ``git status --porcelain=v1 -z``; a rename or copy deletes its old name first."""
    parts, out, at = output.split("\0"), [], 0
    while at < len(parts):
        entry = parts[at]
        at += 1
        if len(entry) < 4:
            continue
        code, path = entry[:2], entry[3:]
        if code[0] in "RC" or code[1] in "RC":
            if at < len(parts) and parts[at]:
                out.append((parts[at], "delete"))
            at += 1
            out.append((path, "change"))
        else:
            out.append((path, "delete" if "D" in code else "change"))
    return out


def parse_name_status(output: str) -> list[tuple[str, str]]:
    """(path, op) of ``git diff --name-status -z``."""
    parts, out, at = [p for p in output.split("\0")], [], 0
    while at + 1 < len(parts):
        code = parts[at]
        if not code:
            at += 1
            continue
        if code[0] in "RC" and at + 2 < len(parts):
            out += [(parts[at + 1], "delete"), (parts[at + 2], "change")]
            at += 3
        else:
            out.append((parts[at + 1], "delete" if code[0] == "D" else "change"))
            at += 2
    return out


def parse_tfs_history(lines: Sequence[str]) -> list[tuple[str, str]]:
    """(server path, op) of the items in a detailed changeset history."""
    out = []
    for line in lines:
        if m := re.match(r"^\s+([A-Za-z, ]+?)\s+(\$/.+?)\s*$", line):
            out.append((m[2].split(";")[0], "delete" if "delete" in m[1].lower() else "change"))
    return out


def parse_tfs_status(lines: Sequence[str]) -> list[tuple[str, str]]:
    """(local path, op) of detailed pending changes: a ``Change :`` line, then a ``Local item :`` line."""
    out, op = [], "change"
    for line in lines:
        if m := re.match(r"^\s*Change\s*:\s*(.+)$", line):
            op = "delete" if "delete" in m[1].lower() else "change"
        elif m := re.match(r"^\s*Local item\s*:\s*(?:\[[^\]]*\]\s*)?(.+?)\s*$", line):
            out.append((m[1], op))
    return out


def parse_workfold(lines: Sequence[str]) -> list[tuple[str, str]]:
    """(server path, local path) of a workspace's mappings, deepest server path first."""
    found = [m.groups() for line in lines if (m := re.match(r"^\s*(\$/[^:]*):\s*((?:[A-Za-z]:|\\\\|/).+?)\s*$", line))]
    return sorted(((s.rstrip("/"), p) for s, p in found), key=lambda x: -len(x[0]))


def server_to_local(path: str, mappings: Sequence[tuple[str, str]]) -> str | None:
    for server, local in mappings:
        if path.lower() == server.lower() or path.lower().startswith(server.lower() + "/"):
            return local.rstrip("/\\") + path[len(server) :]
    return None


def changeset_number(text: str | None) -> int | None:
    """The number of ``123`` or ``Changeset: 123`` or ``tfvc:123``."""
    m = re.match(r"^\s*(?:tfvc:|Changeset:\s*)?(\d+)", text or "", re.I)
    return int(m[1]) if m else None


def _git(root: str, *args: str, timeout: float) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_identity(root: str, timeout: float = 5) -> dict:
    """Repository of a directory; not under git: a local identity. A detached head has no branch."""
    top = _git(root, "rev-parse", "--show-toplevel", timeout=timeout)
    if top is None:
        return {"workspace_root": root, "repository_root": root, "is_git_repository": False, "remote_url": None, "branch": None, "commit_sha": None}
    one = lambda *a: (_git(root, *a, timeout=timeout) or "").strip() or None
    branch = one("rev-parse", "--abbrev-ref", "HEAD")
    return {
        "workspace_root": root,
        "repository_root": top.strip(),
        "is_git_repository": True,
        "remote_url": one("config", "--get", "remote.origin.url"),
        "branch": None if branch == "HEAD" else branch,
        "commit_sha": one("rev-parse", "HEAD"),
    }


def git_changes(root: str, previous_commit: str | None, timeout: float = 10) -> tuple[list[tuple[str, str]], bool]:
    """Changes since a commit and in the working tree below ``root``, by paths from there, and whether the list is complete.

    Files of new directories are named one by one. What the rest of the repository does is left out; a
    file that is moved in or out is new or deleted. Without a previous commit only the working tree is
    known, so the list is not complete.
    """
    prefix = _git(root, "rev-parse", "--show-prefix", timeout=timeout)
    status = _git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--", ".", timeout=timeout)
    if status is None or prefix is None:
        return [], False
    changes, complete = [], bool(previous_commit)
    if previous_commit:
        diff = _git(root, "diff", "--name-status", "-z", previous_commit, "HEAD", "--", ".", timeout=timeout)
        complete = diff is not None
        changes = parse_name_status(diff or "")
    below = prefix.strip("\n")
    return [(p[len(below) :], op) for p, op in changes + parse_status(status) if p.startswith(below)], complete


def changes_frame(spark: SparkSession, changes: Sequence[tuple[str, str]], root: str = "") -> DataFrame:
    """Changes as rows with their order, under ``root``."""
    base = Path(root)
    return spark.createDataFrame([(k, str(base / p) if root else p, op) for k, (p, op) in enumerate(changes)], CHANGES)


def with_identity(files: DataFrame, identity: dict) -> DataFrame:
    """Files with the columns of their source, paths relative to the repository."""
    from siltstone.functions import paths as P

    out = files.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in identity.items() if k != "workspace_root"})
    return out.withColumn("relative_path", P.relative(F.col("file_path"), F.lit(identity["repository_root"])))


def webhook(payload: Column) -> Column:
    """What a push event asks for: repository, branch, commit, changed and deleted files."""
    p = F.from_json(payload, HOOK)
    every = F.concat(F.coalesce(p["commits"], F.array()), F.when(p["head_commit"].isNotNull(), F.array(p["head_commit"])).otherwise(F.slice(p["commits"], 1, 0)))
    lists = lambda *names: F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda c: F.concat(*[F.coalesce(c[n], F.array().cast("array<string>")) for n in names])))))
    return F.struct(
        F.coalesce(p["repository"]["clone_url"], p["repository"]["html_url"]).alias("repository_url"),
        F.regexp_replace(p["ref"], "^refs/heads/", "").alias("branch"),
        p["after"].alias("commit_sha"),
        lists("added", "modified").alias("changed_files"),
        lists("removed").alias("deleted_files"),
    )
