"""Command line: index, search, eval, workspaces, groups and the store's status. Exit codes: 0 done, 1 error, 2 failed evaluation."""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence
from pathlib import Path


def delimited(values: Sequence[str]) -> list[str]:
    """Repeated options whose values may hold several, divided by ; or ,"""
    return [p.strip() for v in values for p in re.split("[;,]", v) if p.strip()]


def path_map(values: Sequence[str]) -> dict[str, str]:
    out = {}
    for v in values:
        old, sign, new = v.partition("=")
        if not sign or not old.strip() or not new.strip():
            raise argparse.ArgumentTypeError(f"--path-map takes old=new, not {v!r}")
        out[old.strip()] = new.strip()
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--store", required=True, help="folder of the engine's tables")
    p.add_argument("--local-groups", help="JSON file of this user's groups")
    p.add_argument("--progress", help="file that progress lines are added to")
    sub = p.add_subparsers(dest="noun", required=True)
    i = sub.add_parser("index")
    i.add_argument("root", nargs="?", help="by default the workspace around the target or the current directory")
    i.add_argument("-t", "--target", action="append", default=[], help="a path or a solution; may be given several times")
    i.add_argument("-f", "--force", action="store_true")
    i.add_argument("-p", "--profile", default="all")
    i.add_argument("-x", "--exclude", action="append", default=[])
    i.add_argument("-n", "--dry-run", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--hybrid", action="store_true")
    s.add_argument("-l", "--limit", type=int)
    s.add_argument("--content-type")
    s.add_argument("--search-profile")
    s.add_argument("--mode")
    s.add_argument("--scope", default="all")
    s.add_argument("--root")
    s.add_argument("--group")
    e = sub.add_parser("eval")
    e.add_argument("suite")
    w = sub.add_parser("workspace")
    w.add_argument("verb", choices=["list", "status", "delete", "export", "import", "migrate", "adopt", "collection", "index"])
    w.add_argument("root", nargs="?")
    w.add_argument("--to", help="new root of a workspace that is migrated")
    w.add_argument("--folder")
    w.add_argument("--path-map", action="append", default=[])
    g = sub.add_parser("group")
    g.add_argument("verb", choices=["list", "create", "add", "delete", "export", "import"])
    g.add_argument("name", nargs="?")
    g.add_argument("--local", action="store_true", help="in the file of --local-groups")
    g.add_argument("--folder")
    g.add_argument("--path-map", action="append", default=[])
    g.add_argument("--root", action="append", default=[])
    g.add_argument("-x", "--exclude", action="append", default=[])
    sub.add_parser("profile")
    sub.add_parser("status", help="what the store holds")
    return p


def show(rows) -> None:
    """All rows of a listing, one a line; they stream through the driver."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def main(argv: Sequence[str] | None = None) -> int:
    from siltstone import schemas
    from siltstone.engine import Engine, Settings
    from siltstone.operators.evaluation import exit_code
    from siltstone.session import local_session
    from siltstone.sources.json_files import progress_lines

    a = parser().parse_args(argv)
    if a.noun == "profile":
        print("\n".join(schemas.PROFILES))
        return 0
    progress = progress_lines(a.progress) if a.progress else None
    engine = Engine(local_session(), a.store, settings=Settings(local_groups=a.local_groups, progress=progress))
    try:
        if a.noun == "index":
            targets = delimited(a.target)
            root = a.root or engine.workspace_of(targets[0] if targets else ".")
            done = engine.index_workspace(root, targets, a.force, a.profile, delimited(a.exclude), a.dry_run)
            show(done.orderBy("file_path")) if a.dry_run else print(done)
        elif a.noun == "search":
            run = engine.hybrid_search if a.hybrid else engine.search_code
            scope = {"scope": a.scope, "workspace_root": a.root, "workspace_group": a.group}
            run(a.text, a.limit, a.content_type, a.search_profile, a.mode, **scope).orderBy("rank").show(50, 80)
        elif a.noun == "eval":
            _, metrics = engine.evaluate(Path(a.suite).read_text(encoding="utf-8"))
            row = metrics.first()
            print(row.asDict())
            return exit_code(row.passed, row.queries)
        elif a.noun == "workspace":
            if a.verb == "list":
                show(engine.registry().select("workspace_root", "status", "files_scanned", "chunks_indexed").orderBy("workspace_root"))
            elif a.verb == "status":
                show(engine.status(a.root))
            elif a.verb == "migrate":
                print(engine.migrate_workspace(a.root, a.to or ""))
            elif a.verb == "adopt":
                print(engine.adopt_workspace(a.root))
            elif a.verb == "collection":
                print(engine.collection_of(a.root))
            elif a.verb == "index":
                print(engine.build_vector_index(engine.named_workspace(a.root)))
            elif a.verb == "delete":
                engine.delete_workspace(a.root)
            elif a.verb == "export":
                engine.export_workspace(a.root, a.folder)
            else:
                print(engine.import_workspace(a.folder, path_map(a.path_map)))
        elif a.noun == "status":
            rows = engine.registry().select("workspace_root", "collection_name", "status").collect()
            counts = engine.vectors.counts([r.collection_name for r in rows])
            for r in rows:
                print(r.workspace_root, r.collection_name, r.status, counts.get(r.collection_name, "no vectors"), sep="\t")
        elif a.verb == "export":
            engine.export_group(a.name, a.folder)
        elif a.verb == "import":
            print(engine.import_workspace(a.folder, path_map(a.path_map)))
        elif a.verb == "list":
            show(engine.groups().orderBy("name"))
        elif a.verb == "add":
            engine.add_to_group(a.name, a.root, delimited(a.exclude), a.local)
        elif a.verb == "create":
            engine.save_group(a.name, a.root, delimited(a.exclude), a.local)
        else:
            engine.delete_group(a.name)
    except (OSError, LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
