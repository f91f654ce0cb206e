"""Labels of results and documents: kinds of content, complexity, relevance bands, section types, advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import contains_any, first_label

# Words of each kind of content and of each level, searched in the title and the start of the content.
CONTENT_KINDS = (
    ("API Reference", ("api", "reference", "method", "function", "class")),
    ("Tutorial/Guide", ("tutorial", "guide", "getting started", "quickstart", "intro")),
    ("Examples", ("example", "sample", "demo", "usage")),
    ("Setup/Config", ("install", "setup", "configuration", "config")),
    ("Troubleshooting", ("troubleshoot", "debug", "error", "problem", "issue")),
)
COMPLEXITY = (
    ("Beginner", ("beginner", "basic", "intro", "getting started", "quickstart")),
    ("Advanced", ("advanced", "expert", "complex", "in-depth")),
    ("Intermediate", ("intermediate", "moderate")),
)
# Words of each type of section, first match wins.
SECTION_TYPES = (
    ("overview", ("overview", "introduction", "getting started", "about")),
    ("installation", ("installation", "install", "setup", "requirements")),
    ("usage", ("usage", "examples", "quick start", "tutorial")),
    ("api", ("api", "reference", "methods", "functions", "classes")),
    ("configuration", ("configuration", "config", "settings", "options")),
    ("faq", ("faq", "frequently asked questions", "troubleshooting")),
    ("changelog", ("changelog", "release notes", "history", "versions")),
)
# Names of package managers.
PACKAGE_MANAGERS = {
    "pypi": "pypi", "pip": "pypi", "python": "pypi", "npm": "npm", "node": "npm", "nodejs": "npm", "gem": "gem", "ruby": "gem", "rubygems": "gem", "hex": "hex", "elixir": "hex", "erlang": "hex",
    "go": "go", "golang": "go", "cargo": "crates", "rust": "crates", "crates": "crates", "composer": "packagist", "php": "packagist", "packagist": "packagist",
}
# Keys of a package's links that name its documentation, in order.
DOCUMENTATION_KEYS = ("Documentation", "Docs", "documentation", "docs", "documentation_url", "doc_url", "Read the Docs", "ReadTheDocs", "Manual", "User Guide", "API Reference")


def _found(title: Column, content: Column, table, start: int) -> Column:
    text = F.lower(F.concat_ws("\n", title, F.substring(content, 1, start)))
    return F.array_compact(F.array(*[F.when(contains_any(text, words), name) for name, words in table]))


def content_kinds(title: Column, content: Column, start: int = 500) -> Column:
    return _found(title, content, CONTENT_KINDS, start)


def complexity_levels(title: Column, content: Column, start: int = 500) -> Column:
    return _found(title, content, COMPLEXITY, start)


# Signs of code that make a result without a level technical.
CODE_SIGNS = ("class ", "def ", "function", "import", "from")


def complexity(title: Column, content: Column, start: int = 500) -> Column:
    """The levels joined by commas, else ``Technical (contains code)`` where the start of the content has code, else null."""
    levels = complexity_levels(title, content, start)
    return F.when(F.size(levels) > 0, F.array_join(levels, ", ")).when(contains_any(F.substring(content, 1, start), CODE_SIGNS), "Technical (contains code)")


def reading_kinds(title: Column, content: Column) -> Column:
    """The first four kinds of content in a document's title or first thousand characters."""
    return _found(title, content, CONTENT_KINDS[:4], 1_000)


def reading_level(title: Column, content: Column) -> Column:
    """Beginner or Advanced by a document's title or first thousand characters, Technical by signs of code in them, else Intermediate."""
    levels = _found(title, content, COMPLEXITY[:2], 1_000)
    code = F.when(contains_any(F.lower(F.substring(content, 1, 1_000)), CODE_SIGNS), "Technical")
    return F.coalesce(F.try_element_at(levels, F.lit(1)), code, F.lit("Intermediate"))


def relevance_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("basic")


def section_type(title: Column) -> Column:
    return first_label(title, SECTION_TYPES, None)


def title_version(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"v?(\d+\.\d+(?:\.\d+)?)", 1), F.lit(""))


def documented_version(url: Column) -> Column:
    """Version in a documentation URL, else ``latest``."""
    forms = (r"v(\d+\.\d+\.\d+)", r"(\d+\.\d+\.\d+)", r"(\d+\.\d+)")
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in forms), F.lit("latest"))


def filled_url(pattern: Column, version: Column) -> Column:
    """A URL pattern with its version: ``latest`` as ``stable``, else whole or as major and minor."""
    shown = F.when(version.isin("latest", "stable"), "stable").otherwise(version)
    parts = F.split(version, r"\.")
    split = F.replace(F.replace(pattern, F.lit("{major}"), F.get(parts, F.lit(0))), F.lit("{minor}"), F.get(parts, F.lit(1)))
    return F.when(F.contains(pattern, F.lit("{major}")) & (F.size(parts) >= 2) & (shown == version), F.replace(split, F.lit("{version}"), version)).otherwise(F.replace(pattern, F.lit("{version}"), shown))


def documentation_url(links: Column, homepage: Column, package: Column) -> Column:
    """The first documentation link of a package (map of names to URLs), else a homepage that looks like one, else a usual address."""
    known = [F.nullif(F.trim(F.try_element_at(links, F.lit(k))), F.lit("")) for k in DOCUMENTATION_KEYS]
    likely = F.when(F.lower(homepage).rlike(r"docs?\.|/docs|readthedocs|\.github\.io|documentation"), homepage)
    return F.coalesce(*known, likely, F.concat(F.lit("https://"), package, F.lit(".readthedocs.io/")))


def package_manager(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PACKAGE_MANAGERS.items() for x in pair]), F.lower(name))


def library_spec(text: Column) -> Column:
    """struct(name, version) of ``name@version``; without a version it's ``latest``."""
    parts = F.split(text, "@", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), F.lit("latest")).alias("version"))


def update_advice(level: Column) -> Column:
    return F.when(level == "stale", "consider an update").when(level == "outdated", "update recommended")


def prompt(template: Column, document: Column, chunk: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{{WHOLE_DOCUMENT}}"), document), F.lit("{{CHUNK_CONTENT}}"), chunk)


def document_kind(title: Column, content: Column) -> Column:
    """api, tutorial or code of a document, else general."""
    text = F.lower(F.concat_ws("\n", title, F.substring(content, 1, 1_000)))
    return F.when(contains_any(text, ("api", "reference", "endpoint")), "api").when(contains_any(text, ("tutorial", "guide", "how to")), "tutorial").when(F.contains(content, F.lit("```")), "code").otherwise("general")
