"""Fixed values of the symbol graph: kinds, weights, bonuses and word lists."""

from __future__ import annotations

NODE_KINDS = (
    "function", "method", "class", "interface", "variable", "constant", "import", "module", "file", "type_alias", "enum", "struct",
    "trait", "decorator", "parameter", "property", "unknown",
)
EDGE_KINDS = (
    "contains", "calls", "imports", "extends", "implements", "type_of", "returns", "references", "instantiates", "overrides", "exports",
    "decorates", "data_flow", "reads", "writes",
)
#: Traversal weight of an edge kind; others weigh OTHER_WEIGHT.
EDGE_WEIGHTS = {
    "contains": 1.0, "extends": 0.95, "calls": 0.9, "implements": 0.9, "overrides": 0.85, "instantiates": 0.8, "imports": 0.8,
    "type_of": 0.7, "returns": 0.7, "exports": 0.6, "decorates": 0.6, "references": 0.5,
}
OTHER_WEIGHT = 0.5
DEPENDENT_KINDS = ("calls", "imports", "extends", "references")
DEPENDENCY_KINDS = ("calls", "imports", "extends", "type_of")
#: Ranking bonus of a node kind; others get 0.
KIND_BONUS = {
    "function": 10, "method": 10, "interface": 9, "trait": 9, "class": 8, "type_alias": 6, "struct": 6, "enum": 5, "property": 3,
    "field": 3, "constant": 3, "variable": 2, "import": 1, "file": 0,
}
EXPORTED_BONUS, PRIVATE_BONUS = 5, -3
#: Kinds worth a snippet.
SNIPPET_KINDS = (
    "function", "method", "class", "interface", "type_alias", "struct", "trait", "component", "route", "variable", "constant", "enum",
    "module", "namespace",
)
#: Column weights of keyword search.
SEARCH_WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
#: Words that are no search terms.
STOP_WORDS = frozenset(
    """the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should
    may might can shall not no all each every how what where when who which why i me my we our you your he she they show give tell been
    done made used using work works found also into then than just more some such over only out its so up as if look need needs want
    happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug
    called""".split()
)
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rs": "rust", ".go": "go",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".rb": "ruby",
}
SKIP_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".ruff_cache", "dist", "build", "target",
    ".idea", ".vscode", "coverage", "htmlcov",
)
