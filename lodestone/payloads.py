"""Loose commit payloads in their one proper form (driver side, or a row at a time in an Arrow kernel)."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

# Names that stand for another field, the first that is given counting; what lists may be; and
# the fields of the result in order.
ALIASES = {
    "file_path": ("filePath", "filepath", "path"), "changelog_entry": ("change_summary", "changeSummary", "rationale", "description"), "breaking_changes": ("breakingChanges",),
    "key_types": ("keyTypes",), "data_flows": ("dataFlows",), "public_api": ("publicApi",), "source_highlights": ("sourceHighlights",), "patterns_added": ("patternsAdded",),
    "patterns_removed": ("patternsRemoved",), "hazards_added": ("hazardsAdded",), "hazards_removed": ("hazardsRemoved",),
}
LISTS = ("patterns_added", "patterns_removed", "hazards_added", "hazards_removed", "conventions", "key_types", "data_flows", "hazards", "patterns", "tags")
FIELDS = (
    "file_path", "changelog_entry", "summary", "patterns_added", "patterns_removed", "hazards_added", "hazards_removed", "cluster", "breaking_changes", "commit_sha", "author_instance_id", "author_engine",
    "review_entry_id", "quiet", "purpose", "public_api", "conventions", "key_types", "data_flows", "hazards", "patterns", "tags", "dependencies", "blurb", "source_highlights",
)
TRUTH = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}


def text(value: object) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def unpacked(value: object) -> object:
    """What a string holds that looks like JSON, if it is."""
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def words(value: object) -> list[str] | None:
    """A list of texts from a list, JSON in a string, or lines and commas with or without bullets."""
    value = unpacked(value)
    if isinstance(value, str):
        value = [re.sub(r"^[-*]\s+", "", part) for part in re.split(r"\r?\n|,", value)]
    if not isinstance(value, list):
        return None
    return [t for v in value if (t := ("" if v is None else str(v)).strip())] or None


def first(entry: dict, *names: str) -> object:
    return next((entry[n] for n in names if entry.get(n) is not None), None)


def entries(value: object, read: Callable[[object, int], dict | None]) -> list[dict] | None:
    value = unpacked(value)
    items = value if isinstance(value, list) else [value] if isinstance(value, dict) else words(value) or []
    return [e for k, item in enumerate(items) if (e := read(item, k)) is not None] or None


def api_entry(item: object, _: int) -> dict | None:
    if isinstance(item, str):
        return {"name": item.strip(), "type": "value"} if item.strip() else None
    name = text(first(item, "name", "symbol", "id")) if isinstance(item, dict) else None
    if not name:
        return None
    more = {"signature": text(item.get("signature")), "description": text(first(item, "description", "summary"))}
    return {"name": name, "type": text(first(item, "type", "kind")) or "value"} | {k: v for k, v in more.items() if v}


def number(value: object) -> float | None:
    try:
        out = float(value)
    except (TypeError, ValueError):
        return None
    return out if math.isfinite(out) else None


def highlight(item: object, k: int) -> dict | None:
    if not isinstance(item, dict):
        return None
    body = text(first(item, "content", "text", "snippet"))
    begin, end = number(first(item, "startLine", "start_line", "start")), number(first(item, "endLine", "end_line", "end"))
    if not body or begin is None or end is None or begin < 1 or end < 1:
        return None
    ident = number(item.get("id"))
    out = {"id": int(ident) if ident is not None and ident >= 1 else k + 1, "content": body, "startLine": int(begin), "endLine": int(end)}
    return out | ({"label": label} if (label := text(first(item, "label", "title"))) else {})


def normalise_commit(payload: dict) -> dict:
    """Known fields only, under their proper names: texts trimmed, lists as lists, entries with a name or a
    range. What can't be read stays as it was given."""
    out = dict(payload)
    for name, others in ALIASES.items():
        if out.get(name) is None and (given := first(out, *others)) is not None:
            out[name] = given
    told = text(out.get("changelog_entry")) or text(out.get("summary"))
    if told:
        out["changelog_entry"], out["summary"] = told, out["summary"] if text(out.get("summary")) else told
    readers: list[tuple[tuple[str, ...], Callable[[object], object]]] = [
        (("file_path", "blurb", "purpose"), text), (LISTS, words), (("public_api",), lambda v: entries(v, api_entry)), (("source_highlights",), lambda v: entries(v, highlight)),
        (("breaking_changes",), lambda v: TRUTH.get(v.strip().lower()) if isinstance(v, str) else v),
    ]
    for names, read in readers:
        for name in names:
            if out.get(name) is not None and (value := read(out[name])) is not None:
                out[name] = value
    return {name: out[name] for name in FIELDS if out.get(name) is not None}
