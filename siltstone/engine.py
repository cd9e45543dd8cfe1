"""The engine: index workspaces, search them, look chunks up, evaluate, and move them.

Tables live under one folder: vectors by collection in versions, each with the file state and a
head that belong to it, and the registry as a table that a run replaces. A run reads the active
state, chunks and embeds what changed in batches of files, each written as it is done, builds the
next version and switches to it by one pointer. A run that fails leaves everything as it was, and
the next one takes up the batches that were finished.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas as S
from siltstone.functions import classify as C
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.operators import ann, catalog, chunking, delta, embedding, evaluation, scan, scanners, search, solution, store, transfer
from siltstone.operators.embedding_store import EmbeddingStore
from siltstone.operators.lease import Lease
from siltstone.sources import json_files
from siltstone.sources.changes import git_changes, git_identity, with_identity


@dataclass(frozen=True)
class Settings:
    prefix: str = "siltstone"
    excluded_directories: tuple[str, ...] = C.DEFAULT_EXCLUDED_DIRECTORIES
    excluded_files: tuple[str, ...] = C.DEFAULT_EXCLUDED_FILES
    skip_generated: bool = True
    fingerprint_content: bool = True
    allowed_roots: tuple[str, ...] = ()
    groups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: A JSON file of groups of this machine's user.
    local_groups: str | None = None
    embed_batch: int = 16
    #: Files that are chunked, embedded and written together.
    checkpoint_files: int = 10_000
    use_change_lists: bool = True
    #: Vectors are kept by content, for all workspaces and later runs of the same model.
    keep_embeddings: bool = True
    fallback_model: str | None = None
    progress: Callable[[json_files.Progress], None] | None = None


@dataclass
class Result:
    workspace_root: str
    collection_name: str
    files_scanned: int
    files_changed: int
    files_deleted: int
    chunks_indexed: int
    full_reindex: bool
    warnings: list[str] = field(default_factory=list)


_STATE = S.FILE_STATE
#: Change lists of more files than this are no shorter way than comparing all.
MOST_CHANGES = 5_000
#: Kinds of errors that a run names; of more it gives the number.
MOST_WARNINGS = 20
#: What classification needs of a file.
PROBE_CHARACTERS = 12_000
_locks: dict[str, Lock] = {}


def _is_solution(target: str) -> bool:
    return target.lower().endswith((".sln", ".slnx"))


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        provider: embedding.Provider | None = None,
        settings: Settings | None = None,
        models: embedding.ModelCatalog | None = None,
    ):
        """``models`` are those installed; without them the provider's own name is taken as it is."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.provider = provider or embedding.HashingProvider()
        self.settings, self.models = settings or Settings(), models
        self.vectors = store.VectorStore(spark, f"{self.folder}/vectors")
        self.catalogs = store.VectorStore(spark, f"{self.folder}/catalogs")

    # --- tables

    def _table(self, where: store.VectorStore, name: str, schema: str) -> DataFrame:
        return where.read(name) if where.active(name) is not None else self.spark.createDataFrame([], schema)

    def _replace(self, where: store.VectorStore, name: str, rows: DataFrame) -> None:
        where.promote(name, where.build(name, rows))

    def registry(self) -> DataFrame:
        return self._table(self.catalogs, "registry", S.REGISTRY)

    def groups(self) -> DataFrame:
        """Groups from the settings, the local file and the shared table; of equal names the first of these counts."""
        shared = self._table(self.catalogs, "groups", S.GROUPS)
        own = [(n, "configured", list(r), [], True) for n, r in self.settings.groups]
        sources = [self.spark.createDataFrame(own, S.GROUPS), shared]
        if self.settings.local_groups:
            sources.insert(1, json_files.read_local_groups(self.spark, self.settings.local_groups))
        return catalog.overlaid_groups(*sources)

    def save_group(self, name: str, roots: Sequence[str], exclude_directories: Sequence[str] = (), local: bool = False) -> None:
        if local:
            if not self.settings.local_groups:
                raise ValueError("no file of local groups is set")
            if any(n.strip().lower() == name.strip().lower() for n, _ in self.settings.groups):
                raise ValueError(f"a configured group cannot change: {name}")
            return json_files.write_local_group(self.settings.local_groups, name, list(roots), list(exclude_directories))
        new = self.spark.createDataFrame([(name, "shared", list(roots), list(exclude_directories), False)], S.GROUPS)
        saved = catalog.saved_group(self.groups(), new).filter("source = 'shared'")
        self._replace(self.catalogs, "groups", saved)

    def add_to_group(self, name: str, roots: Sequence[str], exclude_directories: Sequence[str] = (), local: bool = False) -> None:
        """Add roots and excludes to a group, which may be new."""
        old = self.groups().filter(F.lower(F.trim("name")) == name.strip().lower()).first()
        had, excluded = (old.roots, old.exclude_directories or []) if old else ([], [])
        known = {r.lower() for r in had}
        self.save_group(old.name if old else name, [*had, *(r for r in roots if r.lower() not in known)], list(dict.fromkeys([*excluded, *exclude_directories])), local)

    def collection_of(self, root: str) -> str:
        """The collection of a workspace, indexed or not."""
        return self._names(root)[1]

    def delete_group(self, name: str) -> None:
        if self.settings.local_groups:
            json_files.delete_local_group(self.settings.local_groups, name)
        rows = self._table(self.catalogs, "groups", S.GROUPS).filter(F.lower(F.trim("name")) != name.strip().lower())
        self._replace(self.catalogs, "groups", rows)

    def _names(self, root: str) -> tuple[str, str]:
        """(workspace id, collection) of a root."""
        wid = K.workspace_id(F.lit(root))
        row = self.spark.range(1).select(wid.alias("id"), K.collection_name(F.lit(self.settings.prefix), wid).alias("c")).first()
        return row.id, row.c

    def state(self, collection: str) -> DataFrame:
        """The file state of a collection's active version."""
        if self.vectors.active(collection) is None:
            return self.spark.createDataFrame([], _STATE)
        return self.vectors.read(collection, "state")

    # --- indexing

    def workspace_of(self, start: str) -> str:
        """The workspace that a path belongs to: the nearest directory above with a repository or solution, else a project."""
        start = os.path.abspath(start)
        here, names = start if os.path.isdir(start) else os.path.dirname(start), []
        up = here
        while True:
            if os.path.isdir(up):
                names += [f"{up}/.git/HEAD" if n == ".git" else f"{up}/{n}" for n in os.listdir(up)]
            if up == os.path.dirname(up):
                break
            up = os.path.dirname(up)
        files = self.spark.createDataFrame([(n,) for n in names], "file_path string")
        return solution.detected_root(files, here).first().root

    def _model(self) -> tuple[str, list[str]]:
        """The model's name, and a warning if it is the fallback."""
        if self.models is None:
            return self.provider.name, []
        name, fallback = self.models.resolve(self.provider.name, self.settings.fallback_model, self.settings.fallback_model is not None)
        return name, [f"model {self.provider.name} is not installed; {name} is used"] if fallback else []

    def _tell(self, root: str, stage: str, current: int, total: int | None, message: str) -> None:
        if self.settings.progress:
            self.settings.progress(json_files.Progress(root, stage, current, total, message))

    def named_workspace(self, name: str) -> str:
        """The root of an indexed workspace by one of its names; a path is its own."""
        if os.path.isdir(name) or "://" in name:
            return name
        found = None if catalog.is_path_like(name) else catalog.aliased(self.registry(), name).first()
        if found is not None:
            return found.workspace_root
        raise FileNotFoundError(f"no directory and no indexed workspace {name}")

    def index_workspace(
        self, root: str, target: str | Sequence[str] | None = None, force: bool = False, profile: str = "all", excludes: Sequence[str] = (), dry_run: bool = False
    ) -> Result | DataFrame:
        """Bring a workspace's index up to date; it may be named by what an earlier run called it.

        ``target`` (paths and solutions, looked at together in one run) and ``profile`` limit what is
        looked at. With ``dry_run`` nothing is written, and the result is a row for each file that would change.
        An index of another model or schema is an error unless the run is forced, which replaces it.
        """
        root = self.named_workspace(root)
        targets = list(dict.fromkeys([target] if isinstance(target, str) else target or []))
        catalog.allowed([root, *targets], self.settings.allowed_roots)
        profile = S.normal_profile(profile)
        workspace, collection = self._names(root)
        lock = _locks.setdefault(f"{self.folder}|{workspace}", Lock())
        with lock, self.lease(root) as held:
            return self._index(root, workspace, collection, targets, force, profile, list(excludes), dry_run, held)

    def lease(self, root: str) -> Lease:
        """The right to write a workspace's index, which one driver has at a time."""
        return Lease(self.spark, f"{self.folder}/leases/{self._names(root)[0]}")

    def _changes(self, root: str, head: dict | None, rules: str) -> list[str] | None:
        """Paths that may differ from the active state by the repository's own account; None without a complete one.

        What was changed in the working tree when the state was made counts as well, as it may have been put back.
        """
        if not self.settings.use_change_lists or not head or not head.get("commit_sha") or head.get("rules") != rules:
            return None
        listed, complete = git_changes(root, head["commit_sha"])
        paths = {os.path.normpath(f"{root}/{p}") for p, _ in listed} | set(head.get("dirty") or [])
        return sorted(paths) if complete and len(paths) <= MOST_CHANGES else None

    def _rules(self, excludes: Sequence[str]) -> str:
        s = self.settings
        told = [sorted({*s.excluded_directories, *excludes}), sorted(s.excluded_files), s.skip_generated, s.fingerprint_content]
        return hashlib.md5(json.dumps(told).encode(), usedforsecurity=False).hexdigest()

    def _solution_scope(self, found: DataFrame, root: str, target: str) -> tuple[DataFrame, object]:
        """Files of a solution, and whether a path of the state is in its reach; a solution's projects are few."""
        inside = solution.solution_scope(found.select("file_path", "content"), target, root).cache()
        projects = inside.filter(P.extension(F.col("file_path")) == ".csproj")
        directories = [r.d for r in projects.select(P.directory(F.col("file_path")).alias("d")).distinct().collect()]
        here = P.path_key(F.col("file_path")) == target.lower()
        for d in directories:
            here = here | P.is_under(F.col("file_path"), F.lit(d))
        return inside, here

    def _targeted(self, found: DataFrame, files: DataFrame, root: str, targets: Sequence[str]) -> tuple[DataFrame, object]:
        """Files of any of the targets, and whether a path of the state is in their reach."""
        plain = [t for t in targets if not _is_solution(t)]
        here, parts = F.lit(False), [scan.targets(files, plain)] if plain else []
        for t in plain:
            here = here | P.is_under(F.col("file_path"), F.lit(t))
        for t in targets:
            if _is_solution(t):
                inside, reach = self._solution_scope(found, root, t)
                parts.append(files.join(inside, "file_path", "left_semi"))
                here = here | reach
        together = reduce(DataFrame.unionByName, parts)
        return (together if len(parts) == 1 else together.dropDuplicates(["file_path"])), here

    def _index(self, root, workspace, collection, targets, force, profile, excludes, dry_run, held):
        s = self.settings
        model, warnings = self._model()
        head, rules = self.vectors.head(collection), self._rules(excludes)
        if head and (head["embedding_model"] != model or str(head["schema_version"]) != str(S.SCHEMA_VERSION)):
            if not force and not dry_run:
                raise ValueError(
                    f"the index was made by model {head['embedding_model']!r} and schema {head['schema_version']}, not {model!r} and {S.SCHEMA_VERSION}; run with force to replace it"
                )
            if targets or profile != "all":
                raise ValueError("an index of another model is replaced as a whole")
        excluded = [*s.excluded_directories, *excludes]
        changes = None if force or targets or profile != "all" else self._changes(root, head, rules)
        if changes is None:
            # projects of a solution may be anywhere; other targets are the only way into the tree
            below = [] if any(map(_is_solution, targets)) else targets
            found = scan.tree(self.spark, root, excluded_directories=excluded, below=below, characters=None if s.fingerprint_content else PROBE_CHARACTERS)
        else:
            found = scan.read_files(self.spark, root, [p for p in changes if os.path.isfile(p)])
        files = scan.scanned(found, excluded, s.excluded_files, profile, s.skip_generated)
        previous = self.state(collection)
        here = P.is_under(F.col("file_path"), F.lit(root))
        if targets:
            files, here = self._targeted(found, files, root, targets)
        if changes is not None:
            here = P.path_key(F.col("file_path")).isin([p.lower() for p in changes])
        if profile != "all":
            here = here & (C.index_profile(F.col("file_path"), C.guessed_content_type(F.col("file_path"))) == profile)
        self._tell(root, "scan", 0, None, "all files" if changes is None else f"{len(changes)} files of the change list")
        in_scope = previous.filter(here)
        replaces = force and not (targets or profile != "all")
        work = self._scanned(collection, files, in_scope, force)
        current = work.drop("content", "workspace_root", "changed", "analyzer")
        changed = delta.keyed(work.filter("changed").drop("content", "analyzer"))
        gone = delta.deleted_files(current, in_scope)
        if dry_run:
            plan = delta.dry_run(current, in_scope, delta.chunks_per_file(scanners.chunk_files(self._of(work, changed))), force).cache()
            plan.count()
            self._drop_staging(collection, "scan")
            return plan
        had = self.vectors.active(collection) is not None
        made = self._embedded(root, collection, work, changed, f"{model}|{rules}").cache()
        points = store.payload(with_identity(embedding.ready(made), git_identity(root)))
        full = not had or replaces
        counted = delta.backfilled(current, delta.chunks_per_file(made), previous)
        merged = delta.merged_state(self.spark.createDataFrame([], _STATE) if full else previous, counted.drop("path_key"), here)
        state = delta.without_failed(merged, made).select(*[c.split()[0] for c in _STATE.split(", ")])
        # what the new state is takes many joins, and a change compares it with the old one twice
        state = self._written(collection, state.withColumn("chunk_count", F.col("chunk_count").cast("int")), "state")
        who = git_identity(root)
        dirty, _ = git_changes(root, None) if who["is_git_repository"] else ([], False)
        index = None if full or not head else head.get("index")
        head = {
            "index": index, "embedding_model": model, "schema_version": S.SCHEMA_VERSION, "saved_at_utc": datetime.now(UTC).isoformat(), "rules": rules,
            "commit_sha": who["commit_sha"], "dirty": [os.path.normpath(f"{root}/{p}") for p, _ in dirty],
        }
        if full:
            version = self.vectors.build(collection, points, self.provider.width, state, head)
        else:
            stale = self._written(collection, changed.select("file_path").unionByName(gone.select("file_path")), "stale")
            version = self.vectors.change(collection, points, [lambda rows: store.of_files(rows, workspace, stale)], self.provider.width, state, head)
        totals = {"scanned": current.count(), "changed": changed.count(), "deleted": gone.count(), "chunks": made.filter("embedding IS NOT NULL").count()}
        errors = made.filter("embedding IS NULL").select("embedding_error").distinct()
        told = [r.embedding_error for r in errors.orderBy("embedding_error").limit(MOST_WARNINGS + 1).collect()]
        if len(told) > MOST_WARNINGS:
            told[MOST_WARNINGS:] = [f"and {errors.count() - MOST_WARNINGS} more kinds of errors"]
        warnings += told
        self._tell(root, "write", totals["chunks"], totals["chunks"], f"version {version}")
        held.check()
        self.vectors.promote(collection, version)
        self._register(root, workspace, collection, targets, totals, had and full)
        self._drop_staging(collection)
        made.unpersist()
        self._tell(root, "done", totals["chunks"], totals["chunks"], f"{totals['changed']} files changed, {totals['deleted']} deleted")
        return Result(root, collection, totals["scanned"], totals["changed"], totals["deleted"], totals["chunks"], had and full, warnings)

    def _staging(self, collection: str) -> str:
        return f"{self.folder}/staging/{collection}"

    def _written(self, collection: str, rows: DataFrame, name: str) -> DataFrame:
        """Rows written to the staging folder and read again."""
        where = f"{self._staging(collection)}/{name}/{datetime.now(UTC):%Y%m%d%H%M%S%f}"
        rows.write.parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def _drop_staging(self, collection: str, part: str = "") -> None:
        fs, where = self.vectors._fs(f"{self._staging(collection)}/{part}".rstrip("/"))
        fs.delete(where, True)

    def _scanned(self, collection: str, files: DataFrame, in_scope: DataFrame, force: bool) -> DataFrame:
        """State rows of ``files`` with whether they changed, and where they did with content and analyzer: one pass over the tree, written."""
        now = scan.fingerprinted(files, self.settings.fingerprint_content, keep=("workspace_root", "content"))
        old = delta.keyed(in_scope).select("path_key", F.col("fingerprint").alias("_old"))
        joined = now.withColumn("path_key", P.path_key(F.col("file_path"))).join(old, "path_key", "left")
        differs = F.lit(force) | F.col("_old").isNull() | (F.col("_old") != F.col("fingerprint"))
        pick = C.select_analyzer(F.col("file_path"), F.col("workspace_root"), F.col("content"))["analyzer"]
        flagged = joined.withColumn("changed", differs)
        marked = flagged.withColumns({c: F.when(F.col("changed"), v) for c, v in (("analyzer", pick), ("content", F.col("content")))}).drop("_old", "path_key")
        if not self.settings.fingerprint_content:  # only the beginnings were read, to classify them
            marked = scan.whole_contents(marked)
        where = f"{self._staging(collection)}/scan/{datetime.now(UTC):%Y%m%d%H%M%S%f}"
        marked.write.parquet(where)
        return self.spark.read.schema(marked.schema).parquet(where)

    def _finished(self, collection: str, key: str) -> list[str]:
        """Batches of a run with this key that were written to their end."""
        fs, where = self.vectors._fs(f"{self._staging(collection)}/{key}")
        if not fs.exists(where):
            return []
        folders = [x.getPath() for x in fs.listStatus(where)]
        jvm = self.spark.sparkContext._jvm
        return sorted(str(f) for f in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def _embedded(self, root: str, collection: str, files: DataFrame, changed: DataFrame, run: str) -> DataFrame:
        """Chunks of the changed files with their vectors, from batches that are written one by one.

        Batches that a stopped run of the same model and rules has finished count, file by file, where
        the fingerprint is still the same and no chunk failed.
        """
        key = hashlib.md5(run.encode(), usedforsecurity=False).hexdigest()
        keyed = changed.select(F.col("path_key").alias("_key"), F.col("fingerprint").alias("_print"))
        shape = f"{S.CHUNKS}, embedding array<float>, embedding_error string, _key string, _print string"
        columns = [c.split()[0] for c in shape.split(", ")]
        read = lambda folders: self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)
        before = read(self._finished(collection, key))
        failed = before.filter("embedding IS NULL").select("_key", "_print").distinct()
        kept = before.join(failed, ["_key", "_print"], "left_anti").join(keyed, ["_key", "_print"], "left_semi").select(*columns)
        todo = delta.resumed(changed, kept.select(F.col("file_path"), F.col("_print").alias("fingerprint")).distinct()).cache()
        n_files = todo.count()
        n = -(-n_files // self.settings.checkpoint_files)
        written, done = [], 0
        known = EmbeddingStore(self.spark, f"{self.folder}/embeddings", self._model()[0], self.provider.width) if self.settings.keep_embeddings else None
        for k in range(n):
            part = todo.filter(F.pmod(F.xxhash64("path_key"), F.lit(n)) == k)
            # written, as embedding reads them several times
            chunks = self._written(collection, scanners.chunk_files(self._of(files, part)), "chunks")
            where = f"{self._staging(collection)}/{key}/{datetime.now(UTC):%Y%m%d%H%M%S%f}-{k}"
            made = embedding.embedded(chunks, self.provider, self.settings.embed_batch, store=known).withColumn("_key", P.path_key(F.col("file_path")))
            made.join(keyed, "_key").select(*columns).write.parquet(where)
            if known:
                known.add(read([where]).select(K.embedding_key(F.col("content"), T.EMBED_CHARS).alias("content_hash"), "embedding"))
            written.append(where)
            done += part.count()
            self._tell(root, "embed", done, n_files, f"batch {k + 1} of {n}")
        todo.unpersist()
        return kept.unionByName(read(written)).drop("_key", "_print")

    @staticmethod
    def _of(files: DataFrame, changed: DataFrame) -> DataFrame:
        keyed = files.select("workspace_root", "file_path", "content", "analyzer", P.path_key(F.col("file_path")).alias("path_key"))
        return keyed.join(changed.select("path_key"), "path_key", "left_semi").drop("path_key")

    def _register(self, root, workspace, collection, wanted, totals, full) -> None:
        who = git_identity(root)
        old = self.registry()
        name = root.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
        known = old.filter(F.col("workspace_id") == workspace).first()
        prior, targets = (known.aliases or [], known.indexed_targets or []) if known else ([], [])
        sln = next(filter(_is_solution, wanted), None)
        named = catalog.aliases(F.lit(root), F.lit(sln).cast("string"), F.lit([t for t in wanted if t != sln]).cast("array<string>"), F.lit(prior).cast("array<string>"))
        aliases = self.spark.range(1).select(named.alias("a")).first().a
        member = [r.name for r in self.groups().filter(F.exists("roots", lambda r: P.path_key(r) == root.lower())).select("name").collect()]
        row = (
            root, workspace, collection, sorted(member), list(dict.fromkeys([*targets, *(wanted or [root])])), datetime.now(UTC).replace(tzinfo=None), totals["scanned"], totals["chunks"], full,
            who["repository_root"], who["remote_url"], who["branch"], who["commit_sha"], name, aliases, "completed",
        )
        self._replace(self.catalogs, "registry", catalog.upserted_registry(old, self.spark.createDataFrame([row], S.REGISTRY)))

    def index_group(self, group: str, **options) -> list:
        """Index every root of a group, with the group's own excludes added."""
        rows = self.groups().filter(F.lower(F.trim("name")) == group.strip().lower()).collect()
        if not rows:
            raise LookupError(f"no group {group!r}")
        own = [*options.pop("excludes", ()), *rows[0].exclude_directories]
        return [self.index_workspace(r, excludes=own, **options) for r in rows[0].roots]

    def status(self, root: str) -> DataFrame:
        """One row: files and chunks of the state, last write."""
        return delta.index_summary(self.state(self._names(root)[1]))

    def delete_workspace(self, root: str) -> None:
        """Remove vectors, state and registry row; what is not there is no error."""
        for r in self.registry().filter(P.path_key(F.col("workspace_root")) == root.lower()).collect():
            self.vectors.drop(r.collection_name)
            self._drop_staging(r.collection_name)
            fs, where = self.vectors._fs(f"{self.folder}/indexes/{r.collection_name}")
            fs.delete(where, True)
        self._replace(self.catalogs, "registry", self.registry().filter(P.path_key(F.col("workspace_root")) != root.lower()))

    def trigger_indexing(self, request: dict) -> dict:
        """Run a request for a path or a group; a repository alone is queued, nothing at all rejected."""
        path, group = (request.get(k) or "" for k in ("workspace_path", "workspace_group"))
        if not path.strip() and not group.strip():
            return {"status": "Queued" if (request.get("repository_url") or "").strip() else "Rejected", "results": []}
        options = {"force": bool(request.get("force")), "profile": request.get("index_profile") or "all"}
        try:
            results = self.index_group(group, **options) if group.strip() else [self.index_workspace(path, **options)]
        except (OSError, LookupError, ValueError) as e:
            return {"status": "Failed", "results": [], "message": str(e)}
        lists = "changed_files and deleted_files are recorded, the workspace is compared as a whole"
        return {"status": "Completed", "results": results, "warnings": [lists] if request.get("changed_files") or request.get("deleted_files") else []}

    # --- reading

    def build_vector_index(self, root: str, lists: int | None = None, target: float = ann.TARGET, k: int = search.MAX_CANDIDATES) -> dict:
        """Make the approximate index of a workspace: what it covers, and the recall at ``k`` that was measured.

        Points that come later are searched exactly beside it, and points that go are not found, so it
        stays right without being made anew; a run that replaces the whole index drops it.
        """
        collection = self._names(root)[1]
        points = self.vectors.read(collection).select("point_id", "embedding")
        books = ann.fit(points, lists)
        if books is None:
            raise ValueError(f"{root} has no vectors")
        folder = f"{self.folder}/indexes/{collection}/{uuid.uuid4().hex}"
        ann.save(ann.indexed(points, books), books, folder)
        blocks, books = ann.load(self.spark, folder)
        probes, rescore, recall = ann.tuned(points, blocks, books, k, target)
        index = {"folder": folder, "segments": self.vectors.segments_of(collection), "lists": len(books.centroids), "probes": probes, "rescore": rescore, "recall": recall}
        self.vectors.promote(collection, self.vectors.change(collection, head=(self.vectors.head(collection) or {}) | {"index": index}))
        return index

    def _near(self, collection: str, vector: Sequence[float], n: int) -> DataFrame:
        """Points among which the ``n`` nearest to a vector are, by the index; all of them without one."""
        points, index = self.vectors.read(collection), (self.vectors.head(collection) or {}).get("index")
        if not index:
            return points
        blocks, books = ann.load(self.spark, index["folder"])
        asked = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vector array<float>")
        found = ann.approximate_topk(points, blocks, books, asked, n, index["probes"], max(index["rescore"], n)).select("point_id")
        fresh = self.vectors.read_since(collection, index["segments"]).select("point_id")
        return points.join(F.broadcast(found).unionByName(fresh).distinct(), "point_id", "left_semi")

    def points(self, scope: DataFrame, near: tuple[Sequence[float], int] | None = None) -> tuple[DataFrame, list[str]]:
        """Points of a scope's collections, or those near a vector; a scope is a handful of registry rows."""
        rows = [r for r in scope.collect() if self.vectors.active(r.collection_name) is not None]
        out: DataFrame | None = None
        for r in rows:
            held = self._near(r.collection_name, *near) if near else self.vectors.read(r.collection_name)
            one = held.filter(F.col("workspace_id") == r.workspace_id)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise LookupError("nothing is indexed in this scope")
        return store.with_defaults(out), [r.workspace_id for r in rows]

    def _search(self, text: str, hybrid: bool, limit: int | None, content_type, profile, mode, approximate: bool = False, **scope) -> DataFrame:
        """``approximate`` looks where the workspaces' indexes say first, and everywhere if filters leave too few of that."""
        vector = tuple(self.provider.embed([text])[0] or ())
        covered = catalog.resolve_scope(self.registry(), self.groups(), **scope)
        asked = search.Search(vector, text, S.clamp_limit(limit), hybrid, content_type, profile, mode)
        if approximate:
            points, workspaces = self.points(covered, (vector, search.OVERFETCH * asked.candidates))
            found = search.search(points, asked, workspaces)
            if found.count() >= asked.limit:
                return found
        points, workspaces = self.points(covered)
        return search.search(points, asked, workspaces)

    def search_code(
        self, text: str, limit: int | None = None, content_type: str | None = None, search_profile: str | None = None, retrieval_mode: str | None = None, approximate: bool = False, **scope
    ) -> DataFrame:
        return self._search(text, False, limit, content_type, search_profile, retrieval_mode, approximate, **scope)

    def hybrid_search(
        self, text: str, limit: int | None = None, content_type: str | None = None, search_profile: str | None = None, retrieval_mode: str | None = None, approximate: bool = False, **scope
    ) -> DataFrame:
        return self._search(text, True, limit, content_type, search_profile, retrieval_mode, approximate, **scope)

    def get_code_context(self, file_path: str, line: int, before: int = 20, after: int = 20) -> DataFrame:
        return chunking.chunk_context(self._containing(file_path), file_path, line, before, after)

    def get_symbol_details(self, file_path: str, symbol: str) -> DataFrame:
        return chunking.symbol_details(self._containing(file_path), file_path, symbol)

    def _containing(self, file_path: str) -> DataFrame:
        return self.points(catalog.resolve_scope(self.registry(), self.groups(), workspace_root=file_path))[0]

    def evaluate(self, suite: str, request: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(ranks, metrics) of a suite's JSON: each query runs with its own settings."""
        loaded = evaluation.load_suite(suite)
        results: DataFrame | None = None
        asked = []
        for k, (q, raw) in enumerate(zip(evaluation.query_settings(loaded, request), loaded["queries"], strict=True)):
            hits = self._search(
                q["query"], q["hybrid"], q["limit"], q["contentType"], q["searchProfile"], q["retrievalMode"],
                scope=q["scope"] or (None if q["workspaceRoot"] or q["workspaceGroup"] else "all"), workspace_root=q["workspaceRoot"], workspace_group=q["workspaceGroup"],
            ).withColumn("query_id", F.lit(k))
            results = hits if results is None else results.unionByName(hits)
            wanted = [*([raw["expected"]] if raw.get("expected") else []), *(raw.get("expectedResults") or [])]
            asked.append((k, [tuple(e.get(f) for f in evaluation._FIELDS) for e in wanted]))
        fields = ", ".join(f"{f}:string" for f in evaluation._FIELDS)
        table = self.spark.createDataFrame(asked, f"query_id int, expected array<struct<{fields}>>")
        if results is None:
            raise ValueError("the suite has no queries")
        ranks = evaluation.best_ranks(table, results)
        return ranks, evaluation.metrics(ranks)

    # --- moving

    def export_workspace(self, root: str, folder: str) -> None:
        self._export(self.registry().filter(P.path_key(F.col("workspace_root")) == root.lower()), folder, "workspace")

    def export_group(self, name: str, folder: str) -> None:
        """All indexed workspaces of a group, and the group itself."""
        group = self.groups().filter(F.lower(F.trim("name")) == name.strip().lower())
        members = catalog.group_members(group, self.registry())
        rows = self.registry().join(members.select("workspace_id"), "workspace_id", "left_semi")
        if rows.isEmpty():
            raise LookupError(f"no workspace of group {name!r} is indexed")
        self._export(rows, folder, "group", group)

    def _export(self, rows: DataFrame, folder: str, kind: str, groups: DataFrame | None = None) -> None:
        points, _ = self.points(rows.select("workspace_root", "workspace_id", "collection_name"))
        transfer.export(points, rows, folder, kind, self.settings.prefix, groups)
        for r in rows.collect():
            self.state(r.collection_name).write.mode("overwrite").parquet(f"{folder}/state/{r.workspace_id}")
            head = self.vectors.head(r.collection_name) or {}
            self.spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/head/{r.workspace_id}")

    def import_workspace(self, folder: str, mapping: dict[str, str]) -> list[str]:
        """Bring exported workspaces, and their group, in under new roots; the names of their collections."""
        manifest = transfer.read_manifest(self.spark, folder)
        like = self.spark.createDataFrame([], self._point_schema())
        points = transfer.remapped_points(transfer.read_points(self.spark, folder, like), mapping)
        listed = lambda some, shape: self.spark.createDataFrame([(json.dumps(x),) for x in some], "value string").select(F.from_json("value", shape).alias("r")).select("r.*")
        old = listed(manifest["workspaces"], S.REGISTRY)
        rows = transfer.remapped_registry(old.withColumn("_old", F.col("workspace_id")), mapping, self.settings.prefix)
        done = []
        for r in rows.collect():
            state = transfer.remapped_state(self.spark.read.parquet(f"{folder}/state/{r._old}"), mapping)
            head = json.loads(self.spark.read.text(f"{folder}/head/{r._old}").first().value)
            head |= {"commit_sha": None, "dirty": []}  # the new root's own history decides from the next run on
            version = self.vectors.build(r.collection_name, points.filter(F.col("workspace_id") == r.workspace_id), state=state, head=head)
            self.vectors.promote(r.collection_name, version)
            done.append(r.collection_name)
        self._replace(self.catalogs, "registry", catalog.upserted_registry(self.registry(), rows.drop("_old")))
        for g in transfer.remapped_groups(listed(manifest.get("groups") or [], S.GROUPS), mapping).collect():
            self.save_group(g.name, g.roots, g.exclude_directories or [])
        return done

    def migrate_workspace(self, old: str, new: str) -> str:
        """Move an indexed workspace to another root, without reading its files; the new collection's name."""
        row = self.registry().filter(P.path_key(F.col("workspace_root")) == old.lower()).first()
        if row is None:
            raise LookupError(f"{old} is not indexed")
        mapping = {old: new}
        moved = transfer.remapped_registry(self.registry().filter(F.col("workspace_id") == row.workspace_id), mapping, self.settings.prefix).cache()
        target = moved.first()
        points = transfer.remapped_points(self.vectors.read(row.collection_name), mapping)
        state = transfer.remapped_state(self.state(row.collection_name), mapping)
        head = (self.vectors.head(row.collection_name) or {}) | {"commit_sha": None, "dirty": []}
        version = self.vectors.build(target.collection_name, points, state=state, head=head)
        self.vectors.promote(target.collection_name, version)
        rest = self.registry().filter(F.col("workspace_id") != row.workspace_id)
        self._replace(self.catalogs, "registry", catalog.upserted_registry(rest, moved))
        self.vectors.drop(row.collection_name)
        return target.collection_name

    def adopt_workspace(self, root: str) -> dict[str, int]:
        """Make the file state anew from the stored points and the files that are there."""
        row = self.registry().filter(P.path_key(F.col("workspace_root")) == root.lower()).first()
        if row is None:
            raise LookupError(f"{root} is not indexed")
        points, files = self.vectors.read(row.collection_name), scan.tree(self.spark, root)
        state = transfer.recovered_state(points, files, self.settings.fingerprint_content).select(*[c.split()[0] for c in _STATE.split(", ")])
        head = {"embedding_model": self._model()[0], "schema_version": S.SCHEMA_VERSION, "saved_at_utc": datetime.now(UTC).isoformat(), "rules": self._rules(()), "commit_sha": None, "dirty": []}
        self.vectors.promote(row.collection_name, self.vectors.build(row.collection_name, points, state=state, head=head))
        return transfer.recovery_summary(points, files).first().asDict()

    @staticmethod
    def _point_schema() -> str:
        kinds = {"schema_version": "int", "start_line": "int", "end_line": "int", "is_git_repository": "boolean"}
        return "point_id string, embedding array<float>, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in S.PAYLOAD)
