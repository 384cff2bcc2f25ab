"""Path functions and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Extensions and folders of each index.
EXACT_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".java", ".cs", ".rb", ".php", ".swift", ".kt", ".json", ".yaml", ".yml", ".toml", ".md", ".txt", ".html", ".css", ".scss", ".sql", ".sh", ".bat", ".ps1", ".cfg", ".ini", ".xml"]
SEMANTIC_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".java", ".cs", ".rb", ".php", ".swift", ".kt", ".sh", ".sql", ".md", ".txt"]
DEPENDENCY_EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".cs", ".rb"]
SKIPPED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "target", "bin", "obj", ".idea", ".vscode", ".mypy_cache"]
SYMBOL_SKIPPED_FOLDERS = [".git", ".venv", ".vs", "bin", "build", "dist", "node_modules", "obj", "target", "__pycache__"]
PLAN_SKIPPED_FOLDERS = [".agents", ".git", ".venv", ".vs", "__pycache__", "build", "dist", "node_modules", "target"]
SEARCH_CONFIG_NAMES = ["pyproject.toml", "setup.cfg", "tox.ini", "pytest.ini", "package.json", "tsconfig.json", "appsettings.json", "appsettings.development.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml"]
SEARCH_CONFIG_ENDS = [".config", ".cfg", ".ini", ".yaml", ".yml", ".toml"]
PLAN_CONFIG_NAMES = ["dockerfile", "makefile", "readme", "license", "pyproject.toml", "package.json", "appsettings.json", "appsettings.development.json"]
PLAN_CONFIG_ENDS = [".cfg", ".conf", ".config", ".ini", ".json", ".md", ".rst", ".toml", ".yaml", ".yml"]
TEST_NAME = r"(^|/)test_[^/]*$|_test\.py$|\.(test|spec)\.(js|ts|tsx)$|tests?\.cs$"


def slashed(path: str | Column) -> Column:
    return F.translate(col(path), "\\", "/")


def name(path: str | Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def folder(path: str | Column) -> Column:
    """The path before its last slash, empty without one."""
    return F.regexp_replace(slashed(path), r"/?[^/]*$", "")


def extension(path: str | Column) -> Column:
    """Lower case with its dot; .env and its variants are .env, names without a dot inside have none."""
    lower = F.lower(name(path))
    dotted = F.regexp_extract(lower, r"^.+(\.[^.]+)$", 1)
    return F.when(F.rlike(lower, F.lit(r"^\.env($|\.)")), F.lit(".env")).otherwise(dotted)


def normal(path: str | Column) -> Column:
    """Slashes, no leading ./, lower case: the form in which result paths are compared."""
    return F.lower(F.regexp_replace(slashed(path), r"^(\./)+", ""))


def collapsed(path: Column) -> Column:
    """Without . and empty steps, each .. taking back a step."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    back = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(back, "/"))


def is_skipped(path: str | Column, folders: list[str] = SKIPPED_FOLDERS) -> Column:
    return F.arrays_overlap(F.split(F.lower(slashed(path)), "/"), F.array(*map(F.lit, folders)))


def is_test(path: str | Column) -> Column:
    lower = F.lower(slashed(path))
    return F.rlike(lower, F.lit(r"(^|/)tests?(/|$)")) | F.rlike(lower, F.lit(TEST_NAME))


def _ends(path: Column, ends: list[str]) -> Column:
    return F.rlike(path, F.lit("(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$"))


def is_configuration(path: str | Column) -> Column:
    """As search groups related files."""
    lower = F.lower(slashed(path))
    return name(lower).isin(SEARCH_CONFIG_NAMES) | F.startswith(name(lower), F.lit(".env")) | _ends(lower, SEARCH_CONFIG_ENDS) | F.rlike(lower, F.lit("(^|/)config(uration)?(/|$)"))


def is_plan_configuration(path: str | Column) -> Column:
    """As plans collect configuration and documentation: another set."""
    lower = F.lower(slashed(path))
    return name(lower).isin(PLAN_CONFIG_NAMES) | _ends(lower, PLAN_CONFIG_ENDS)


def under_roots(path: str | Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one; without roots all are."""
    if not roots:
        return F.lit(True)
    path, found = slashed(path), F.lit(False)
    for root in roots:
        root = root.replace("\\", "/").rstrip("/")
        found = found | (path == root) | F.startswith(path, F.lit(root + "/"))
    return found


#: Languages of a file's extension; any other is "text".
LANGUAGES = {".cs": "csharp", ".py": "python", ".ts": "typescript", ".tsx": "typescriptreact", ".js": "javascript", ".jsx": "javascriptreact", ".json": "json", ".sql": "sql"}


def language(path: str | Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(path)], F.lit("text"))
