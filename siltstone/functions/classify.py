"""Classification of files and chunks by path and content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions.lets import let

# fixed values: names, extensions and default settings
DEFAULT_EXCLUDED_DIRECTORIES = (
    ".agents", ".codex", ".dotnet-home", ".git", ".siltstone", ".vs", ".vscode", "artifacts", "bin", "coverage",
    "dist", "obj", "node_modules", "packages", "TestResults",
)
DEFAULT_EXCLUDED_FILES = ("*.g.cs", "*.Designer.cs")
DOCUMENTATION_GLOBS = tuple(f"**/{d}/**" for d in ("doc", "docs", "documentation", "api-docs", "generated-docs"))
APPLICATION_GLOBS = tuple(
    f"**/{d}/**" for d in ("src", "app", "apps", "client", "frontend", "ui", "views", "pages", "components", "wwwroot")
)
DOCUMENTATION_LANGUAGES = {
    ".md": "markdown", ".mdx": "mdx", ".html": "html", ".htm": "html", ".txt": "text", ".rst": "rst",
    ".adoc": "asciidoc", ".asciidoc": "asciidoc",
}
SCRIPT_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
}
MARKUP_LANGUAGES = {
    ".razor": "razor", ".cshtml": "razor", ".vbhtml": "razor", ".aspx": "aspnet", ".ascx": "aspnet", ".master": "aspnet",
    ".xaml": "xaml", ".html": "html", ".htm": "html", ".mdx": "mdx", ".css": "css", ".scss": "css", ".sass": "css",
    ".less": "css",
}
AMBIGUOUS = (".html", ".htm", ".mdx")
FRONTEND_LANGUAGES = ("javascript", "typescript", "jsx", "tsx", "html", "css")
FRONTEND_EXTENSIONS = (".jsx", ".tsx", ".vue", ".svelte", ".css", ".scss")
FRONTEND_SEGMENTS = ("frontend", "client", "ui", "wwwroot")
METADATA_EXTENSIONS = (".sln", ".csproj", ".props", ".targets", ".yml", ".yaml")
METADATA_NAMES = (
    "directory.packages.props", "global.json", "appsettings.json", "launchsettings.json", "nuget.config", ".editorconfig",
    "dockerfile",
)
PROBE_CHARS = 12_000
GENERATED_PROBE_CHARS = 4_096

# fixed values: patterns of headings and of documentation and application markup
HTML_HEADING = r"(?i)<h[1-6][^>]*>(.*?)</h[1-6]>"
MARKDOWN_HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
ASCIIDOC_HEADING = r"^={1,6}\s+(.+?)\s*$"
DOC_STRUCTURE = r"(?i)<(?:article|main|section|nav|pre|code)\b|\b(?:table-of-contents|toc|breadcrumbs?)\b"
DOC_GENERATOR = r"(?i)\b(?:docfx|docusaurus|sphinx|mkdocs|swagger-ui|redoc|asciidoctor|typedoc|storybook-docs)\b"
DOC_PARAGRAPH = r"(?m)<(?:p|li)\b[^>]*>[^<]{40,}</(?:p|li)>|^[^\r\n<>{}]{80,}$"
_SIGNALS = (
    r"\*ng(?:If|For)\b|\[(?:[A-Za-z][\w.-]*)\]\s*=|\((?:[A-Za-z][\w.-]*)\)\s*=|\[\(ngModel\)\]|routerLink\b|repeat\.for\b|"
    r"if\.bind\b|value\.bind\b|click\.delegate\b|\bv-(?:if|for|model)\b|@[A-Za-z][\w.-]*\s*=|:[A-Za-z][\w.-]*\s*=|"
    r"@(?:page|model|code)\b|\{Binding\b|\bx:Class\s*="
)
APP_SIGNALS = f"(?i)(?:{_SIGNALS})"
FRAMEWORK_SIGNALS = rf"(?i)(?:{_SIGNALS}|asp-(?:for|action|controller)\s*=)"
BINDING = (
    r"(?i)(?:@bind|@on\w+|on\w+\s*=|\b(?:Click|Command|ItemsSource|DataContext|Text|Value|SelectedItem)\s*=|\{Binding\b|"
    r"asp-for\s*=|asp-action\s*=|asp-controller\s*=)"
)
COMPONENT = r"<([A-Z][A-Za-z0-9.]*|[a-z]+-[a-z0-9-]+)\b"
DOC_SIGNALS = r"(?i)<(?:article|main|nav|pre|code)\b|\b(?:docfx|docusaurus|sphinx|mkdocs|swagger-ui|redoc|table-of-contents|toc)\b"


def is_test_path(path: Column) -> Column:
    return P.slashed(path).rlike(r"(?i)/tests?/") | P.stem(path).rlike(r"(?i)tests?$")


def is_frontend_path(path: Column) -> Column:
    return P.extension(path).isin(*FRONTEND_EXTENSIONS) | F.arrays_overlap(P.segments(path), F.array(*map(F.lit, FRONTEND_SEGMENTS)))


def is_markup_path(path: Column) -> Column:
    return P.extension(path).isin(".html", ".htm", ".razor", ".cshtml")


def is_metadata_path(path: Column) -> Column:
    return P.extension(path).isin(*METADATA_EXTENSIONS) | F.lower(P.file_name(path)).isin(*METADATA_NAMES)


def guessed_content_type(path: Column) -> Column:
    """Content type by the path alone, as scans use it."""
    return (
        F.when(P.extension(path).isin(".md", ".mdx", ".txt"), "documentation")
        .when(is_metadata_path(path), "project_metadata")
        .when(is_markup_path(path), "markup")
        .otherwise("code")
    )


def index_profile(path: Column, content_type: Column) -> Column:
    return (
        F.when(F.lower(content_type) == "documentation", "docs")
        .when(F.lower(content_type) == "project_metadata", "metadata")
        .when(is_test_path(path), "tests")
        .when((F.lower(content_type) == "markup") | is_frontend_path(path), "frontend")
        .otherwise("code")
    )


def language(path: Column, languages: dict[str, str], default: str = "text") -> Column:
    table = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    return F.coalesce(F.element_at(table, P.extension(path)), F.lit(default))


def script_content_type(path: Column) -> Column:
    return F.when(P.extension(path).isin(".jsx", ".tsx"), "markup").otherwise("code")


def is_ci_workflow(path: Column) -> Column:
    """YAML in a workflow folder."""
    return P.extension(path).isin(".yml", ".yaml") & F.contains(F.lower(P.slashed(path)), F.lit("/.github/workflows/"))


def metadata_role(path: Column) -> Column:
    """(language, role) of a project file; the first rule that fits counts."""
    name, ext = F.lower(P.file_name(path)), P.extension(path)
    rules = [
        (ext.isin(".sln", ".slnx"), "solution", "DotNetSolution"),
        (ext == ".csproj", "xml", "DotNetProject"),
        (name == "directory.packages.props", "xml", "CentralPackageManagement"),
        (ext.isin(".props", ".targets", ".runsettings", ".pubxml"), "xml", "MSBuildMetadata"),
        (name == "nuget.config", "xml", "NuGetConfig"),
        (name == "global.json", "json", "DotNetSdkConfig"),
        (F.startswith(name, F.lit("appsettings")), "json", "ApplicationSettings"),
        (name == "launchsettings.json", "json", "LaunchSettings"),
        (name == ".editorconfig", "editorconfig", "EditorConfig"),
        (F.startswith(name, F.lit("dockerfile")), "dockerfile", "DockerMetadata"),
        (is_ci_workflow(path), "yaml", "CiWorkflow"),
        (ext.isin(".yml", ".yaml"), "yaml", "DeploymentMetadata"),
        (ext == ".json", "json", "ProjectMetadata"),
    ]
    out = F.struct(F.lit("text").alias("language"), F.lit("ProjectMetadata").alias("role"))
    for test, lang, role in reversed(rules):
        out = F.when(test, F.struct(F.lit(lang).alias("language"), F.lit(role).alias("role"))).otherwise(out)
    return out


def accepts(path: Column) -> dict[str, Column]:
    """By analyzer, in order of registration, whether it takes the file."""
    ext, name = P.extension(path), F.lower(P.file_name(path))
    deploy = (F.startswith(name, F.lit("deployment")) | F.startswith(name, F.lit("publish"))) & ext.isin(".yml", ".yaml", ".json", ".xml")
    project = (
        ext.isin(".sln", ".slnx", ".csproj", ".props", ".targets", ".runsettings", ".pubxml")
        | name.isin("nuget.config", "global.json", "launchsettings.json", ".editorconfig", "directory.packages.props")
        | (F.startswith(name, F.lit("appsettings")) & (ext == ".json"))
        | F.startswith(name, F.lit("dockerfile"))
        | is_ci_workflow(path)
        | deploy
    )
    return {
        "csharp": ext == ".cs",
        "documentation": ext.isin(*DOCUMENTATION_LANGUAGES),
        "metadata": project,
        "script": ext.isin(*SCRIPT_LANGUAGES),
        "markup": ext.isin(*MARKUP_LANGUAGES),
    }


def _clamped(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)


def _plus(test: Column, amount: float) -> Column:
    return F.when(test, F.lit(amount)).otherwise(F.lit(0.0))


def documentation_confidence(path: Column, root: Column, content: Column) -> Column:
    """How sure the documentation analyzer is of a file that it accepts."""
    probe = F.substring(content, 1, PROBE_CHARS)
    headings = probe.rlike(HTML_HEADING) | probe.rlike(MARKDOWN_HEADING)
    terms = [
        _plus(P.matches_glob(path, root, APPLICATION_GLOBS), -0.25),
        _plus(headings, 0.18),
        _plus(probe.rlike(DOC_STRUCTURE), 0.14),
        _plus(probe.rlike(DOC_GENERATOR), 0.20),
        _plus(F.regexp_count(probe, F.lit(DOC_PARAGRAPH)) >= 2, 0.08),
        _plus(probe.rlike(APP_SIGNALS), -0.28),
    ]
    unclear = _clamped(reduce(lambda a, b: a + b, terms, F.lit(0.55)))
    return (
        F.when(P.matches_glob(path, root, DOCUMENTATION_GLOBS), 0.95)
        .when(~P.extension(path).isin(*AMBIGUOUS), 0.8)
        .otherwise(unclear)
    )


def markup_confidence(path: Column, root: Column, content: Column) -> Column:
    """How sure the markup analyzer is of a file that it accepts."""
    probe = F.substring(content, 1, PROBE_CHARS)
    terms = [
        _plus(P.matches_glob(path, root, DOCUMENTATION_GLOBS), -0.25),
        _plus(probe.rlike(FRAMEWORK_SIGNALS), 0.35),
        _plus(probe.rlike(BINDING), 0.18),
        _plus(F.regexp_count(probe, F.lit(COMPONENT)) >= 2, 0.12),
        _plus(probe.rlike(DOC_SIGNALS), -0.22),
    ]
    unclear = _clamped(reduce(lambda a, b: a + b, terms, F.lit(0.5)))
    return (
        F.when(P.matches_glob(path, root, APPLICATION_GLOBS), 0.95)
        .when(~P.extension(path).isin(*AMBIGUOUS), 0.85)
        .otherwise(unclear)
    )


def select_analyzer(path: Column, root: Column, content: Column) -> Column:
    """(confidence, analyzer): the surest one that accepts; of equals the one registered first. Null if none does."""
    sure = {"documentation": documentation_confidence(path, root, content), "markup": markup_confidence(path, root, content)}
    options = [
        F.when(ok, F.struct(sure.get(name, F.lit(0.5)).alias("confidence"), F.lit(-k).alias("order"), F.lit(name).alias("analyzer")))
        for k, (name, ok) in enumerate(accepts(path).items())
    ]
    best = F.array_max(F.array_compact(F.array(*options)))
    return F.when(best.isNotNull() & (best["confidence"] > 0), F.struct(best["confidence"].alias("confidence"), best["analyzer"].alias("analyzer")))


def is_for(analyzer: str, path: Column, root: Column, content: Column) -> Column:
    """Whether ``select_analyzer`` gives this one. Confidences are computed only where another accepts the file too: alone it is always over 0.

    The path is bound once: a path that is put together from columns would be so at each of its hundred uses.
    """

    def chosen(p: Column) -> Column:
        ok = accepts(p)
        others = reduce(lambda a, b: a | b, (x for name, x in ok.items() if name != analyzer))
        return F.when(~ok[analyzer], False).when(~others, True).otherwise(select_analyzer(p, root, content)["analyzer"].eqNullSafe(analyzer))

    return let(path, chosen)


def is_auto_generated(path: Column, content: Column) -> Column:
    return (P.extension(path) == ".cs") & F.contains(F.lower(F.substring(content, 1, GENERATED_PROBE_CHARS)), F.lit("<auto-generated"))


def in_search_profile(profile: str, row_profile: Column, content_type: Column, lang: Column, path: Column, symbol: Column) -> Column:
    """Whether a result belongs to a search profile: stored under it, or by the profile's own marks."""
    if profile == "all":
        return F.lit(True)
    own = {
        "docs": F.lower(content_type) == "documentation",
        "metadata": F.lower(content_type) == "project_metadata",
        "frontend": (F.lower(content_type) == "markup") | F.lower(lang).isin(*FRONTEND_LANGUAGES),
        "tests": is_test_path(path) | F.contains(F.lower(symbol), F.lit("test")),
        "code": F.lower(content_type) == "code",
    }
    return (F.lower(row_profile) == profile) | own[profile]


def mode_boost(mode: str, content_type: Column) -> Column:
    """Factor of a retrieval mode."""
    kinds = {"docs_first": ("documentation", "project_metadata"), "code_first": ("code", "markup")}.get(mode)
    if kinds is None:
        return F.lit(1.0)
    first, second = kinds
    return F.when(F.lower(content_type) == first, 1.15).when(F.lower(content_type) == second, 1.05).otherwise(1.0)
