"""Text functions: search normalisation, tokens, set similarity, usage inference."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that queries drop, and the punctuation that they lose.
STOPWORDS = frozenset(
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can need it its this that these those i me my we our you your he she they them "
    "their who which what where when how why if then so no not all each every any some such only about up out just into "
    "also than very too".split()
)
PUNCTUATION = "?!@#$%^&*(){}[]<>:;\"'`,.|\\~/+="

#: Letters with marks and their plain forms, as the index folds them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize(text: Column) -> Column:
    """Split camelCase, turn _ and - into spaces, collapse white space."""
    out = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    out = F.regexp_replace(out, "[_-]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def query_terms(raw: str) -> list[str]:
    """The words of a query that are searched; any of them may match."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", raw)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text)
    text = re.sub(r"[_-]+", " ", text)
    text = text.translate(str.maketrans(dict.fromkeys(PUNCTUATION, " ")))
    return [t for t in text.lower().split() if len(t) > 1 and t not in STOPWORDS]


def prepared(raw: Column) -> Column:
    """``query_terms`` of a column of raw queries."""
    bare = F.regexp_replace(normalize(raw), "[" + re.escape(PUNCTUATION) + "]", " ")
    return F.filter(F.split(F.lower(bare), r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(*sorted(STOPWORDS)))


# Words that are no identifiers, and the verbs before one.
NO_IDENTIFIERS = frozenset(
    "a an and are as at by for from if in into is it its of on only or out the their then this to used uses using value values when with".split()
)
VERBS = "derive|derives|derived|load|loads|loaded|fetch|fetches|fetched"


def loaded_identifiers(flow: Column) -> Column:
    """The (symbol, strong) that a text about data flow names: identifiers after a verb of loading (strong), and
    those in back-ticks. One in back-ticks has two characters or more; a bare one four or more, a capital
    somewhere, and is no common word."""
    found = lambda pattern: F.regexp_extract_all(flow, F.lit(pattern), F.lit(1))
    quoted = lambda names: F.filter(names, lambda n: F.length(n) >= 2)
    bare = lambda n: (F.length(n) >= 4) & ~F.lower(n).isin(*sorted(NO_IDENTIFIERS)) & n.rlike(r"^([A-Z][A-Za-z0-9_$]*|[a-z]+[A-Z][A-Za-z0-9_$]*)$")
    strong = F.concat(quoted(found(rf"(?i)\b(?:{VERBS})\s+`([A-Za-z_$][\w$]*)`")), F.filter(found(rf"(?i)\b(?:{VERBS})\s+([A-Za-z_$][\w$]*)"), bare))
    named = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("symbol"), F.lit(kind).alias("strong")))
    weak = F.array_except(quoted(found(r"`([A-Za-z_$][\w$]*)`")), strong)
    return F.concat(named(F.array_distinct(strong), True), named(F.array_distinct(weak), False))


def tokens(text: Column) -> Column:
    """Index tokens: lower case, marks removed, split on anything but letters and digits."""
    folded = F.translate(F.lower(text), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_set(*columns: Column) -> Column:
    """Distinct tokens of several texts as set similarity uses them: [a-z0-9_], two characters or more."""
    joined = F.lower(F.concat_ws(" ", *columns))
    return F.array_distinct(F.filter(F.split(joined, "[^a-z0-9_]+"), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def usage_type(context: Column, symbol: str) -> Column:
    """How a symbol is used in a piece of code. The patterns and their order."""
    s = re.escape(symbol)
    return (
        F.when(context.rlike(r"""\bfrom\s+['"][^'"]*['"]""") & context.contains(symbol), "import")
        .when(context.rlike(rf"\bexport\s*\{{[^}}]*\b{s}\b[^}}]*\}}"), "re-export")
        .when(context.rlike(rf"\bnew\s+{s}\b|\b{s}\s*\("), "call")
        .when(context.rlike(rf"\btypeof\s+{s}\b|:\s*{s}\b"), "type-reference")
        .otherwise("reference")
    )


def clamp_text(text: Column, limit: int, suffix: str = "…") -> Column:
    """At most ``limit`` code points, the suffix included."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, max(0, limit - len(suffix))), F.lit(suffix[:limit])))
