"""Hazard hygiene and evidence: order-dependent deduplication, signatures, authority."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILAR = 0.85
_NEGATIONS = {"not", "never", "no", "without", "cannot", "none"}
_MODALS = {"must", "should", "may", "can", "will", "shall", "might", "could"}
_RELATIONS = {"before", "after", "until", "unless", "only", "except", "above", "below", "less", "more", "least", "most"}


def hazard_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", text.lower().replace("n't", " not"))


def hazard_signature(text: str) -> tuple:
    """What two hazards must agree in to mean the same: negation, numbers, modals and relations."""
    words = hazard_words(text)
    return (sum(w in _NEGATIONS for w in words) % 2, tuple(w for w in words if w.isdigit()), tuple(sorted(w for w in words if w in _MODALS)), tuple(w for w in words if w in _RELATIONS))


def dedupe_hazards(hazards: list[str]) -> list[str]:
    """First wins: a later hazard goes if it is equal, or similar with an equal signature."""
    kept: list[tuple[str, set[str], tuple]] = []
    for text in hazards:
        text = " ".join(text.split())
        if not text:
            continue
        words, sign = set(hazard_words(text)), hazard_signature(text)
        twin = any(t.lower() == text.lower() or s == sign and words | w and len(words & w) / len(words | w) >= SIMILAR for t, w, s in kept)
        if not twin:
            kept.append((text, words, sign))
    return [t for t, _, _ in kept]


def clean_pattern(text: Column) -> Column:
    """A pattern's name: one line without markup, at most 240 code points; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>|[`*#]+", " "), r"\s+", " "))
    return F.when((plain != "") & (F.char_length(plain) <= 240), plain)


def authority(source_hash: Column, indexed_hash: Column, changelog_newer: Column) -> Column:
    """Which evidence decides: the current source, the index that agrees with it, or the change log."""
    return (
        F.when(source_hash.isNull() & indexed_hash.isNull(), F.when(changelog_newer, "changelog").otherwise("none"))
        .when(source_hash.isNull(), F.when(changelog_newer, "changelog").otherwise("index"))
        .when(source_hash.eqNullSafe(indexed_hash), "index")
        .otherwise("source")
    )
