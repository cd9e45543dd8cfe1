"""Table shapes of the engine, and its closed sets of names."""

from __future__ import annotations

FILES = "workspace_root string, file_path string, content string, size long, last_write_time_utc timestamp"
FILE_STATE = "file_path string, fingerprint string, size long, last_write_time_utc timestamp, chunk_count int"
INDEX_STATE = (
    "workspace_root string, embedding_model string, schema_version string, saved_at_utc timestamp, "
    "state_exists boolean, is_complete boolean, indexing_collection_name string"
)
CHUNKS = (
    "id string, workspace_root string, file_path string, language string, symbol_name string, symbol_kind string, "
    "start_line int, end_line int, content string, content_type string, index_profile string"
)
REGISTRY = (
    "workspace_root string, workspace_id string, collection_name string, groups array<string>, "
    "indexed_targets array<string>, last_indexed_utc timestamp, files_scanned int, chunks_indexed int, "
    "full_reindex boolean, repository_root string, remote_url string, branch string, commit_sha string, "
    "display_name string, aliases array<string>, status string"
)
GROUPS = "name string, source string, roots array<string>, exclude_directories array<string>, is_read_only boolean"
_EXPECTED = (
    "struct<file:string, fileContains:string, symbol:string, symbolContains:string, contentContains:string, "
    "contentType:string, indexProfile:string>"
)
_SETTINGS = (
    "limit:int, hybrid:boolean, workspaceRoot:string, workspaceGroup:string, scope:string, searchProfile:string, "
    "contentType:string, retrievalMode:string"
)
EVAL_SUITE = (
    f"struct<{_SETTINGS}, queries:array<struct<name:string, query:string, {_SETTINGS}, expected:{_EXPECTED}, "
    f"expectedResults:array<{_EXPECTED}>>>>"
)
#: Payload columns of a stored vector, in order.
PAYLOAD = (
    "workspace_id", "workspace_root", "repository_root", "remote_url", "branch", "commit_sha", "schema_version",
    "relative_path", "source_workspace_id", "source_project_id", "is_git_repository", "file_path", "content_type",
    "index_profile", "language", "symbol_name", "symbol_kind", "start_line", "end_line", "preview", "content",
)

SCHEMA_VERSION = 2
CONTENT_TYPES = ("code", "documentation", "markup", "project_metadata")
PROFILES = ("all", "code", "docs", "metadata", "frontend", "tests")
PROFILE_ALIASES = {"documentation": "docs", "project_metadata": "metadata", "test": "tests", "ui": "frontend", "web": "frontend"}
RETRIEVAL_MODES = ("balanced", "docs_first", "code_first")
SCOPE_ALIASES = {
    "": "current", "current": "current", "current_workspace": "current",
    "root": "root", "workspace_root": "root", "explicit_workspace_root": "root",
    "group": "group", "workspace_group": "group", "named_workspace_group": "group",
    "all": "all", "all_indexed": "all", "all_indexed_workspaces": "all",
}


def normal_profile(name: str | None) -> str:
    """Canonical index profile; blank means all, an unknown name is an error."""
    key = (name or "").strip().lower() or "all"
    key = PROFILE_ALIASES.get(key, key)
    if key not in PROFILES:
        raise ValueError(f"unknown index profile {name!r}; known: {', '.join(PROFILES)}")
    return key


def normal_content_type(name: str | None) -> str | None:
    """Canonical content type; blank and "all" mean no filter, an unknown name is an error."""
    key = (name or "").strip().lower()
    if key in ("", "all"):
        return None
    if key not in CONTENT_TYPES:
        raise ValueError(f"unknown content type {name!r}; known: {', '.join(CONTENT_TYPES)}")
    return key


def normal_mode(name: str | None) -> str:
    """Canonical retrieval mode; blank means balanced."""
    key = (name or "").strip().lower() or "balanced"
    if key not in RETRIEVAL_MODES:
        raise ValueError(f"unknown retrieval mode {name!r}; known: {', '.join(RETRIEVAL_MODES)}")
    return key


def normal_scope(scope: str | None, workspace_root: str | None = None, workspace_group: str | None = None) -> str:
    """Kind of scope: a group argument counts before a root argument, and both before ``scope``."""
    if (workspace_group or "").strip():
        return "group"
    if (workspace_root or "").strip():
        return "root"
    key = (scope or "").strip().lower()
    if key not in SCOPE_ALIASES:
        raise ValueError(f"unknown scope {scope!r}")
    return SCOPE_ALIASES[key]


def clamp_limit(limit: int | None, default: int = 10) -> int:
    """Result limits go from 1 to 50."""
    return max(1, min(50, default if limit is None else limit))


def check_schema_version(stored: str | int | None) -> None:
    """A blank stored version is compatible; any other must be the current one."""
    text = "" if stored is None else str(stored).strip()
    if text and text != str(SCHEMA_VERSION):
        raise ValueError(f"index schema version {text} is not {SCHEMA_VERSION}")
