"""Requests and results: closed-world validation, opaque cursors, paging, character budgets, envelopes.

Operators return DataFrames; this module is the thin layer that a caller with typed requests uses. It
runs on the driver and collects one page at most.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

VERSION = "1"
# Bounds of results.
DEFAULT_LIMIT, MOST_ITEMS, MOST_NODES, MOST_EDGES, MOST_LINES, MOST_CHARS = 20, 500, 2_000, 10_000, 5_000, 200_000


class RequestError(ValueError):
    """A request that can't be served, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Field:
    """What a request field may be."""

    kind: type | tuple[type, ...]
    least: float | None = None
    most: float | None = None
    choices: tuple = ()
    required: bool = False


COMMON = {"workspace": Field(str), "limit": Field(int, 1, MOST_ITEMS), "cursor": Field(str), "max_characters": Field(int, 2, MOST_CHARS)}
ACTIONS: dict[str, dict[str, Field]] = {
    "search": COMMON | {"query": Field(str, required=True), "cluster": Field(str), "path_prefix": Field(str), "include_test_files": Field(bool)},
    "similar": COMMON | {"file_path": Field(str, required=True), "min_score": Field((int, float), 0, 1)},
    "history": COMMON | {"mode": Field(str, choices=("entries", "count", "timeline", "group")), "bucket": Field(str, choices=("day", "week", "month")), "group_by": Field(str), "since": Field(str), "until": Field(str), "order": Field(str, choices=("newest", "oldest"))},
    "impact": COMMON | {"file_path": Field(str, required=True), "depth": Field(int, 0, 20), "max_nodes": Field(int, 1, MOST_NODES)},
    "trace": COMMON | {"source": Field(str, required=True), "target": Field(str, required=True), "max_hops": Field(int, 1, 50), "weighted": Field(bool)},
    "cycles": COMMON | {"min_size": Field(int, 1, MOST_NODES), "file_path": Field(str)},
    "gaps": COMMON | {"min_severity": Field(str, choices=("low", "medium", "high"))},
    "hotspots": COMMON | {"top": Field(int, 1, MOST_ITEMS)},
}


def validate(action: str, request: dict[str, Any]) -> dict[str, Any]:
    """The request, if every field is known and within bounds. Of unknown fields the first by name is
    reported, so that the error doesn't depend on the order of a mapping."""
    fields = ACTIONS.get(action)
    if fields is None:
        raise RequestError("UNKNOWN_ACTION", f"unknown action {action!r}")
    unknown = sorted(set(request) - set(fields))
    if unknown:
        raise RequestError("UNKNOWN_FIELD", f"{action} has no field {unknown[0]!r}")
    for name, rule in fields.items():
        value = request.get(name)
        if value is None:
            if rule.required:
                raise RequestError("MISSING_FIELD", f"{action} needs {name!r}")
            continue
        if not isinstance(value, rule.kind) or isinstance(value, bool) and rule.kind is not bool:
            raise RequestError("INVALID_FIELD", f"{name!r} has the wrong type")
        if rule.least is not None and value < rule.least or rule.most is not None and value > rule.most:
            raise RequestError("OUT_OF_RANGE", f"{name!r} must be from {rule.least:g} to {rule.most:g}")
        if rule.choices and value not in rule.choices:
            raise RequestError("INVALID_FIELD", f"{name!r} must be one of {', '.join(rule.choices)}")
    return dict(request)


def fnv1a(text: str) -> str:
    """FNV-1a of 64 bits over code points."""
    value = 0xCBF29CE484222325
    for ch in text:
        value = (value ^ ord(ch)) * 0x100000001B3 % (1 << 64)
    return f"{value:016x}"


def scope_of(action: str, request: dict[str, Any]) -> str:
    """What a cursor is bound to: the request without its cursor, in canonical form."""
    kept = {k: v for k, v in request.items() if k not in ("cursor", "format") and v is not None}
    return fnv1a(json.dumps({"action": action, **kept}, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def encode_cursor(scope: str, offset: int) -> str:
    return f"lodestone-v1.{scope}.{offset}"


def decode_cursor(cursor: str | None, scope: str) -> int:
    if cursor is None:
        return 0
    parts = cursor.split(".")
    if len(parts) != 3 or parts[0] != "lodestone-v1" or not parts[2].isdigit():
        raise RequestError("INVALID_CURSOR", "the cursor is malformed")
    if parts[1] != scope:
        raise RequestError("CURSOR_MISMATCH", "the cursor belongs to another request")
    return int(parts[2])


def split_limit(total: int, sources: int) -> list[int]:
    """A limit dealt over sources; the first ones take the remainder."""
    if sources < 1:
        return []
    base, rest = divmod(max(0, int(total)), sources)
    return [base + (k < rest) for k in range(sources)]


def within_budget(items: list[dict], budget: int | None) -> list[dict]:
    """The longest prefix whose JSON array has at most ``budget`` characters."""
    if budget is None:
        return items
    size, out = 2, []
    for item in items:
        size += len(json.dumps(item, ensure_ascii=False, separators=(",", ":"), default=str)) + (1 if out else 0)
        if size > budget:
            break
        out.append(item)
    if items and not out:
        raise RequestError("BUDGET_TOO_SMALL", "not even the first item fits the character budget")
    return out


@dataclass
class Result:
    """The envelope of one page."""

    data: list[dict]
    total: int
    next_cursor: str | None
    request_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    warnings: list[str] = field(default_factory=list)

    def envelope(self) -> dict:
        page = {"next_cursor": self.next_cursor, "returned": len(self.data), "total": self.total, "truncated": self.next_cursor is not None}
        return {"protocol_version": VERSION, "ok": True, "request_id": self.request_id, "data": self.data, "meta": {"warnings": self.warnings, "page": page}}


def failure(error: RequestError, request_id: str | None = None) -> dict:
    return {"protocol_version": VERSION, "ok": False, "request_id": request_id or uuid.uuid4().hex, "error": {"code": error.code, "message": str(error)}}


def page(action: str, request: dict[str, Any], rows: DataFrame, *order) -> Result:
    """One page of ``rows`` in a total order (end it with a unique column)."""
    request = validate(action, request)
    scope = scope_of(action, request)
    offset, limit = decode_cursor(request.get("cursor"), scope), request.get("limit") or DEFAULT_LIMIT
    total = rows.count()
    if offset > total:
        raise RequestError("CURSOR_OUT_OF_RANGE", "the cursor is past the end")
    items = [r.asDict(recursive=True) for r in rows.orderBy(*order).offset(offset).limit(limit).collect()]
    items = within_budget(items, request.get("max_characters"))
    end = offset + len(items)
    return Result(items, total, encode_cursor(scope, end) if end < total else None)
