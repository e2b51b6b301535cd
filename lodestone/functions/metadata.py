"""Expressions over file metadata: tiers, completeness, paths, clusters, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that scans skip, extensions they keep, and the languages of extensions.
EXCLUDED = ("node_modules", "dist", ".git", ".next", "__tests__", "tests", "test", ".turbo", ".cache", "coverage", "build", "out", ".vercel", ".svelte-kit", ".nuxt", ".output")
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".mjs": "javascript", ".cjs": "javascript", ".sql": "sql", ".py": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".swift": "swift", ".vue": "vue", ".svelte": "svelte", ".md": "markdown",
}
# Line counts up to which a file has a tier, and the fields that tiers require.
TIERS = ((50, "tiny"), (200, "small"), (600, "medium"), (1500, "large"))
REQUIRED = {
    "tiny": ("blurb", "tags"),
    "small": ("blurb", "purpose", "tags"),
    "medium": ("blurb", "purpose", "tags", "hazards"),
    "large": ("blurb", "purpose", "tags", "hazards", "patterns", "source_highlights"),
    "huge": ("blurb", "purpose", "tags", "hazards", "patterns", "source_highlights", "key_types"),
}
FIELDS = ("purpose", "blurb", "tags", "patterns", "hazards", "conventions", "key_types", "data_flows", "public_api", "source_highlights")
KINDS = ("function", "class", "type", "interface", "const", "enum", "namespace", "re-export", "value", "default")


def tier(lines: Column) -> Column:
    out = F.when(lines.isNull() | (lines <= 0), "small")
    for limit, name in TIERS:
        out = out.when(lines <= limit, name)
    return out.otherwise("huge")


def required(tier_col: Column) -> Column:
    out = None
    for name, fields in REQUIRED.items():
        value = F.array(*[F.lit(f) for f in fields])
        out = F.when(tier_col == name, value) if out is None else out.when(tier_col == name, value)
    return out


def filled(fields: dict[str, Column]) -> Column:
    """Names of the fields that hold something; ``fields``: name -> condition."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in fields.items()]))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def scanned(path: Column) -> Column:
    """Whether a scan keeps the path: a known extension and no excluded directory."""
    folders = F.split(path, "/")
    return ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED])) & extension(path).isin(*LANGUAGES)


def path_cluster(path: Column) -> Column:
    """A cluster's name from the path alone."""
    parts = F.split(path, "/")
    n = F.size(parts)
    part = lambda k: F.get(parts, F.lit(k))
    prefix = F.when(part(1) == "components", "ui").when(part(1) == "stores", "store").otherwise(part(1))
    return (
        F.when(path.endswith(".md"), "docs")
        .when(part(0) != "src", F.when(part(0) == "", "root").otherwise(F.concat(F.lit("misc-"), part(0))))
        .when(n <= 2, "core")
        .when((part(1) == "app") & (part(2) == "api") & (n > 3), F.concat(F.lit("api-"), part(3)))
        .when(part(1) == "app", F.concat(F.lit("page-"), part(2)))
        .otherwise(F.concat(prefix, F.lit("-"), part(2)))
    )


def canonical_path(path: Column) -> Column:
    """Relative path without . and empty segments; null where it would leave its root or is too long."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    ok = ~F.array_contains(walked, "..") & ~path.startswith("/") & (F.char_length(path) <= 4096) & (F.size(walked) > 0)
    return F.when(ok, F.array_join(walked, "/"))


def symbol_kind(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*KINDS), low).otherwise("unknown")


def blast_radius(consumers: Column) -> Column:
    return F.when(consumers <= 1, "low").when(consumers <= 5, "medium").when(consumers <= 15, "high").otherwise("critical")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)
