"""Scanners of code, script, markup and style files, as batches of Python over Arrow.

Each scanner takes a file's path and content and gives units: a symbol, its kind, its lines and its
text. They read line by line or brace by brace and know no grammar: C# with preprocessor branches
that open different braces, and raw strings of several quotes, may come out cut differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import classify as C
from siltstone.functions import keys as K
from siltstone.functions import paths as P
from siltstone.functions import text as T
from siltstone.operators.chunking import CODE_CHARS, documentation_chunks, exploded, metadata_chunks, split_lines

if TYPE_CHECKING:
    import pyarrow as pa


@dataclass(frozen=True)
class Unit:
    symbol: str
    kind: str
    start: int
    end: int
    content: str
    fqn: str | None = None
    namespace: str | None = None
    context: str | None = None
    bases: str | None = None


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _whole(path: str, text: str) -> Unit:
    return Unit(path.replace("\\", "/").rsplit("/", 1)[-1], "File", 1, max(1, len(_lines(text))), text)


# --- C#

_CS_NOISE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|\$?@\$?"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|^[ \t]*#[^\n]*', re.S | re.M)
_CS_MARK = re.compile(r"[()\[\]{};]")
_CS_TYPE = re.compile(r"\b(class|struct|interface|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)")
_CS_NAMESPACE = re.compile(r"^\s*namespace\s+([\w.]+)\s*$")
_CS_METHOD = re.compile(r"([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\(")
_CS_ATTRIBUTE = re.compile(r"^\s*(?:\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\s*)+")
_CS_NO_MEMBER = frozenset("if for foreach while switch using lock catch fixed return new throw else do try finally get set init add remove when".split())
_CS_KINDS = {"class": "ClassDeclaration", "struct": "StructDeclaration", "interface": "InterfaceDeclaration", "enum": "EnumDeclaration", "record": "RecordDeclaration"}
_ACCESS = re.compile(r"\b(public|private|protected|internal)\b")


@dataclass
class _Scope:
    kind: str  # "namespace", a type's keyword, or "other"
    name: str
    at: int
    unit: dict | None = None


def _cs_member(head: str, owner: str, ended: str) -> tuple[str, str, str] | None:
    """(kind, name, summary) of a member's head in a type."""
    bare = _CS_ATTRIBUTE.sub("", head).strip()
    if not bare:
        return None
    access = " ".join(_ACCESS.findall(bare))
    # the first = outside of parentheses ends the name's part
    level, cut = 0, len(bare)
    for k, ch in enumerate(bare):
        level += (ch in "([") - (ch in ")]")
        if ch == "=" and level <= 0 and bare[k - 1 : k] not in ("=", "!", "<", ">") and bare[k + 1 : k + 2] != "=":
            cut = k
            break
    left = bare[:cut].strip()
    if re.search(r"\bdelegate\b", left):
        return None
    if (m := _CS_METHOD.search(re.sub(r"\b(?:where)\b.*$", "", left, flags=re.S))) and m[1] not in _CS_NO_MEMBER:
        parameters = left[m.end() - 1 :]
        depth = 0
        for k, c in enumerate(parameters):
            depth += (c == "(") - (c == ")")
            if not depth:
                parameters = parameters[: k + 1]
                break
        if m[1] == owner:
            return "ConstructorDeclaration", m[1], f"{access} constructor {m[1]}{parameters}".strip()
        if not re.search(r"\boperator\b|~", left):
            return "MethodDeclaration", m[1], f"{access} method {m[1]}{parameters}".strip()
        return None
    words = re.findall(r"[A-Za-z_][\w.]*(?:<[^()]*>)?(?:\[[\],]*\])?\??", left)
    plain = [w for w in words if w not in ("public", "private", "protected", "internal", "static", "readonly", "const", "virtual", "override", "abstract", "sealed", "async", "partial", "new", "volatile", "required", "unsafe", "extern")]
    if "event" in plain and ended == "{":
        return "EventDeclaration", plain[-1], f"{access} event {plain[-1]}".strip()
    if len(plain) < 2 or "this" in plain or "event" in plain:
        return None
    if ended == "{" or "=>" in bare:
        return "PropertyDeclaration", plain[-1], f"{access} property {plain[-2]} {plain[-1]}".strip()
    flat = re.sub(r"<[^;]*>", "", bare)
    names = [re.split(r"=", x)[0].split()[-1] for x in flat.split(",") if re.split(r"=", x)[0].split()] if "(" not in bare else [plain[-1]]
    kind = re.sub(r"\s+", " ", left).split()
    return "FieldDeclaration", ", ".join(n for n in names if n.isidentifier()), f"{access} field {kind[-2] if len(kind) > 1 else ''} {', '.join(names)}".strip()


def scan_csharp(path: str, text: str) -> list[Unit]:
    """Types as summaries of their members, and methods, constructors, properties, events and fields."""
    source = text.replace("\r\n", "\n").replace("\r", "\n")
    clean = _CS_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    line_at = [0]
    for m in re.finditer("\n", source):
        line_at.append(m.end())
    from bisect import bisect_right

    line = lambda at: bisect_right(line_at, at)
    found: list[dict] = []
    scopes: list[_Scope] = []
    file_namespace = ""
    start = depth = 0

    def emit(kind: str, name: str, a: int, summary: str, bases: str | None = None) -> dict:
        types = [s.name for s in scopes if s.kind not in ("namespace", "other")]
        spaces = [s.name for s in scopes if s.kind == "namespace"]
        namespace = ".".join([file_namespace, *spaces] if file_namespace else spaces)
        unit = {"kind": kind, "name": name, "a": a, "b": a, "types": types, "namespace": namespace, "bases": bases, "members": []}
        if scopes and scopes[-1].unit is not None:
            scopes[-1].unit["members"].append(summary)
        found.append(unit)
        return unit

    for mark in _CS_MARK.finditer(clean):
        at, c = mark.start(), mark[0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        if c not in "{};" or (depth and c != "}"):
            continue
        head = clean[start:at]
        first = start + len(head) - len(head.lstrip())
        inside = scopes[-1].kind if scopes else "namespace"
        if c == "{":
            scope = _Scope("other", "", at)
            shell = re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "()", _CS_ATTRIBUTE.sub("", head))  # defaults of parameters do not count
            if inside != "other" and not re.search(r"=>|(?<![=!<>])=(?!=)", shell):
                if m := _CS_NAMESPACE.match(head):
                    scope = _Scope("namespace", m[1], at)
                elif (m := _CS_TYPE.search(_CS_ATTRIBUTE.sub("", head))) and not re.search(r"\bwhere\b.*\bclass\b", head[: head.find(m[0])], re.S):
                    keyword = m[1].split()[0]
                    tail = re.split(r"\bwhere\b", _CS_ATTRIBUTE.sub("", head)[_CS_ATTRIBUTE.sub("", head).find(m[0]) :])[0]
                    tail = re.sub(r"\([^()]*\)", "", tail)
                    bases = tail.split(":", 1)[1].strip() if ":" in tail else None
                    access = " ".join(_ACCESS.findall(head))
                    unit = emit(_CS_KINDS[keyword] + "Summary", m[2], first, f"{access} {_CS_KINDS[keyword]} {m[2]}".strip(), bases)
                    unit["declaration"] = re.sub(r"\s+", " ", source[first:at]).strip()
                    scope = _Scope(keyword, m[2], at, unit)
                elif inside not in ("namespace", "enum") and (got := _cs_member(head, scopes[-1].name, "{")):
                    scope.unit = None
                    unit = emit(got[0], got[1], first, got[2])
                    scope = _Scope("other", got[1], at)
                    scope.unit = unit
                    unit["open"] = True
            scopes.append(scope)
        elif c == "}":
            if scopes:
                scope = scopes.pop()
                if scope.unit is not None:
                    scope.unit["b"] = at
                    if scope.kind == "enum":
                        scope.unit["members"] += [f"enum member {n}" for n in re.findall(r"(?:^|,)\s*(?:\[[^\]]*\]\s*)*([A-Za-z_]\w*)", clean[scope.at + 1 : at])]
        elif inside not in ("other", "enum"):
            if inside == "namespace":
                if m := _CS_NAMESPACE.match(head):
                    file_namespace = m[1]
                elif m := _CS_TYPE.search(head):
                    unit = emit(_CS_KINDS[m[1].split()[0]] + "Summary", m[2], first, m[2])
                    unit["b"], unit["declaration"] = at, re.sub(r"\s+", " ", source[first:at]).strip()
            elif got := _cs_member(head, scopes[-1].name, ";"):
                if got[1]:
                    emit(got[0], got[1], first, got[2])["b"] = at
        start = at + 1
    units = []
    for u in found:
        chain = [*u["types"], u["name"]]
        fqn = ".".join(([u["namespace"]] if u["namespace"] else []) + chain)
        if u["kind"].endswith("Summary"):
            content = u.get("declaration", u["name"])
            if u["members"]:
                content += "\n\nMembers:\n" + "\n".join(u["members"])
        else:
            content = source[u["a"] : u["b"] + 1]
        units.append(Unit(u["name"], u["kind"], line(u["a"]), line(u["b"]), content, fqn, u["namespace"] or None, ".".join(u["types"]) or None, u["bases"]))
    return units or [_whole(path, text)]


# --- scripts

# fixed values: what starts a declaration
_JS_DEPENDENCY = re.compile(r"^\s*import\s|^\s*export\s+(?:\{|\*|type\s|interface\s)|^\s*export\s+default\s+|\b(?:require\(|module\.exports|exports\.)")
_JS_DECLARATIONS = (
    (re.compile(r"^\s*(?:export\s+default\s+|export\s+)?class\s+([A-Za-z_$][\w$]*)"), "Class"),
    (re.compile(r"^\s*(?:export\s+default\s+|export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"), "Function"),
    (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"), "Assigned"),
    (re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:memo|forwardRef|lazy|observer)\s*\("), "Assigned"),
    (re.compile(r"^\s*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)\b"), "Export"),
)
_JS_ROUTE = re.compile(r"""<Route\b[^>]*\bpath\s*=\s*["']([^"']+)["']""")
_JS_STRING = re.compile(r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)""")


def _block_end(lines: list[str], start: int, bare: Callable[[str], str], stop_at_semicolon: bool) -> int:
    """Index of the line where the block that opens at or after ``start`` closes; without one, of the statement."""
    balance, opened = 0, False
    for k in range(start, len(lines)):
        text = bare(lines[k])
        opened = opened or "{" in text
        balance += text.count("{") - text.count("}")
        if opened and balance <= 0:
            return k
        if stop_at_semicolon and not opened and text.rstrip().endswith(";"):
            return k
    return len(lines) - 1


def scan_script(path: str, text: str) -> list[Unit]:
    """Dependency lines, declarations up to the end of their block, and routes."""
    lines, units = _lines(text), []
    bare = lambda x: re.sub(r"(?<!:)//.*$", "", _JS_STRING.sub('""', x))
    needs = [k for k, x in enumerate(lines) if _JS_DEPENDENCY.search(x)]
    if needs:
        units.append(Unit("module dependencies", "ImportsExports", needs[0] + 1, needs[-1] + 1, "\n".join(lines[k] for k in needs)))
    at = 0
    while at < len(lines):
        found = next(((m[1], kind) for rule, kind in _JS_DECLARATIONS if (m := rule.search(lines[at]))), None)
        if found is None:
            at += 1
            continue
        name, kind = found
        if kind == "Assigned":
            kind = "Component" if name[0].isupper() else "Function"
        first = at
        while first and lines[first - 1].lstrip().startswith(("@", "export ", "declare ")):
            first -= 1
        last = _block_end(lines, at, bare, True)
        units.append(Unit(name, kind, first + 1, last + 1, "\n".join(lines[first : last + 1])))
        at = last + 1
    units += [Unit(m[1], "Route", k + 1, k + 1, x.strip()) for k, x in enumerate(lines) if (m := _JS_ROUTE.search(x))]
    return units or [_whole(path, text)]


# --- markup and styles

# fixed values: patterns of directives, elements and selectors
_DIRECTIVE = re.compile(r"^\s*@(?:page|model|using|inject|inherits|layout|namespace|attribute)\b|(?i:^\s*<%@\s*(?:Page|Control|Master|Register|Import)\b)|\bx:Class\s*=")
_CODE_BLOCK = re.compile(r"^\s*@code\s*\{")
_ELEMENT = re.compile(r"<([A-Za-z_][\w:.-]*)(?:\s|>|/)")
_NAME = re.compile(r"""\b(?:id|x:Name|Name|asp:ID)\s*=\s*["']([^"']+)["']""")
_CLASS = re.compile(r"""\bclass\s*=\s*["']([^"'\s]+)""")
_BINDING = re.compile(C.BINDING)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LOW_VALUE = frozenset(("div", "span", "p", "li"))
_SELECTOR = re.compile(r"^\s*((?:@[\w-]+[^{]+|[^{}]+))\s*\{")


def scan_markup(path: str, text: str) -> list[Unit]:
    """Directive lines, code blocks, and the first element of each line up to its closing tag."""
    lines, units = _lines(text), []
    heads = [k for k, x in enumerate(lines) if _DIRECTIVE.search(x)]
    if heads:
        units.append(Unit("directives", "Directives", heads[0] + 1, heads[-1] + 1, "\n".join(lines[k] for k in heads)))
    at = 0
    while at < len(lines):
        x = lines[at]
        if _CODE_BLOCK.search(x):
            last = _block_end(lines, at, lambda s: s, False)
            units.append(Unit("@code", "CodeBlock", at + 1, last + 1, "\n".join(lines[at : last + 1])))
            at = last + 1
            continue
        if m := _ELEMENT.search(x):
            tag, bound = m[1], bool(_BINDING.search(x))
            if tag.lower() not in _LOW_VALUE or bound:
                last = at
                if tag.lower() not in _VOID and not re.search(r"/>\s*$", x):
                    close = f"</{tag}>".lower()
                    last = next((k for k in range(at, len(lines)) if close in lines[k].lower()), at)
                name, kind = _NAME.search(x), _CLASS.search(x)
                symbol = f"{tag}#{name[1]}" if name else f"{tag}.{kind[1]}" if kind else tag
                units.append(Unit(symbol, "BoundElement" if bound else "Element", at + 1, last + 1, "\n".join(lines[at : last + 1])))
        at += 1
    return units or [_whole(path, text)]


def scan_styles(path: str, text: str) -> list[Unit]:
    """Rules from the line of their selector to the end of their block."""
    lines, units = _lines(text), []
    for k, x in enumerate(lines):
        if m := _SELECTOR.search(x):
            last = _block_end(lines, k, lambda s: s, False)
            selector = m[1].strip()
            units.append(Unit(selector, "StyleAtRule" if selector.startswith("@") else "StyleRule", k + 1, last + 1, "\n".join(lines[k : last + 1])))
    return units or [_whole(path, text)]


def scan_web(path: str, text: str) -> list[Unit]:
    styles = path.lower().endswith((".css", ".scss", ".sass", ".less"))
    return scan_styles(path, text) if styles else scan_markup(path, text)


SCANNERS: dict[str, Callable[[str, str], list[Unit]]] = {"csharp": scan_csharp, "script": scan_script, "markup": scan_web}

_UNIT = (
    "workspace_root string, file_path string, symbol string, kind string, start_line int, end_line int, content string, "
    "fully_qualified_symbol_name string, namespace string, type_context string, base_types string"
)


def units(files: DataFrame, scanner: Callable[[str, str], list[Unit]]) -> DataFrame:
    """The units of each file (workspace_root, file_path, content)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        names = [x.split()[0] for x in _UNIT.split(", ")]
        types = [pa.int32() if x.endswith(" int") else pa.string() for x in _UNIT.split(", ")]
        for batch in batches:
            rows = []
            for root, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for u in scanner(path or "", text or ""):
                    rows.append((root, path, u.symbol, u.kind, u.start, u.end, u.content, u.fqn, u.namespace, u.context, u.bases))
            columns = list(zip(*rows, strict=True)) if rows else [() for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("workspace_root", "file_path", "content").mapInArrow(scan, _UNIT)


def code_chunks(files: DataFrame, analyzer: str) -> DataFrame:
    """Rows of the chunk table for files of one analyzer, cut to 750 characters by lines."""
    found = units(files, SCANNERS[analyzer])
    path = F.col("file_path")
    if analyzer == "csharp":
        lang, kind = F.lit("csharp"), F.lit("code")
        body = T.member_header(F.col("fully_qualified_symbol_name"), F.col("namespace"), F.col("type_context"), F.col("base_types"), F.col("content"))
        found = found.withColumn("content", body)
    elif analyzer == "script":
        lang, kind = C.language(path, C.SCRIPT_LANGUAGES, "javascript"), C.script_content_type(path)
    else:
        lang, kind = C.language(path, C.MARKUP_LANGUAGES, "html"), F.lit("markup")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("end_line") - F.col("start_line")).alias("last"), F.col("content").alias("text")))
    parts = F.when(F.length("content") > CODE_CHARS, split_lines(F.col("content"))).otherwise(whole)
    cut = found.withColumn("content_type", kind).withColumn("language", lang).withColumn("ps", parts).withColumn("many", F.size("ps") > 1)
    rows = cut.select(*[c for c in cut.columns if c not in ("ps", "content")], exploded("ps").alias("k", "p"))
    part = F.when(F.col("many"), F.col("k") + 1).otherwise(0)
    first = F.when(F.col("many"), F.col("start_line") + F.col("p.first")).otherwise(F.col("start_line"))
    last = F.when(F.col("many"), F.col("start_line") + F.col("p.last")).otherwise(F.col("end_line"))
    return rows.select(
        K.chunk_id(P.relative(path, F.col("workspace_root")), first, last, F.col("symbol"), part).alias("id"),
        "workspace_root",
        "file_path",
        "language",
        F.when(F.col("many"), F.concat("symbol", F.lit(" part "), part.cast("string"))).otherwise(F.col("symbol")).alias("symbol_name"),
        F.when(F.col("many"), F.concat("kind", F.lit("Part"))).otherwise(F.col("kind")).alias("symbol_kind"),
        first.cast("int").alias("start_line"),
        last.cast("int").alias("end_line"),
        F.col("p.text").alias("content"),
        "content_type",
        C.index_profile(path, F.col("content_type")).alias("index_profile"),
    )


def chunk_files(files: DataFrame) -> DataFrame:
    """The chunk table of all files that some analyzer takes; a column ``analyzer`` that is there already decides."""
    if "analyzer" in files.columns:
        of = lambda name: files.filter(F.col("analyzer") == name).drop("analyzer")
    else:
        of = lambda name: files.filter(C.is_for(name, F.col("file_path"), F.col("workspace_root"), F.col("content")))
    out = documentation_chunks(of("documentation")).unionByName(metadata_chunks(of("metadata")))
    for name in SCANNERS:
        out = out.unionByName(code_chunks(of(name), name))
    return out
