"""Commits: versions, conflicts, identity, and writes that die between history and records."""

import hashlib
import json

import pytest

from lodestone.operators import commits as K
from lodestone.operators.store import Table
from lodestone.shared import new_folder

RECORD = "workspace string, file_path string, file_hash string, ranged_hazards array<string>, purpose string, blurb string, cluster string, tags array<string>, conventions array<string>, key_types array<string>, data_flows array<string>, public_api array<struct<name:string,type:string>>, source_highlights array<struct<startLine:int,endLine:int>>, patterns array<string>, hazards array<string>"
COMMIT = "number long, summary string, expected string, evidence array<string>, " + ", ".join(c for c in RECORD.split(", ") if not c.startswith(("file_hash", "ranged")))


def record(path, **given):
    base = {"workspace": "w", "file_path": path, "file_hash": "h", "ranged_hazards": [], "purpose": "p", "blurb": "b", "cluster": None, "tags": ["t"], "conventions": None, "key_types": [], "data_flows": [], "public_api": [("run", "function")], "source_highlights": [(1, 2)], "patterns": [], "hazards": ['say "é"\n']}
    return tuple((base | given).values())


def asked(number, path, expected=None, evidence=(), **given):
    base = dict.fromkeys(c.split()[0] for c in COMMIT.split(", "))
    return tuple((base | {"number": number, "summary": f"s{number}", "expected": expected, "evidence": list(evidence), "workspace": "w", "file_path": path} | given).values())


def told(path="a", **given):
    value = {"workspace": "w", "filePath": path, "fileHash": "h", "cluster": None, "blurb": "b", "purpose": "p", "publicApi": [{"name": "run", "type": "function"}], "patterns": [], "tags": ["t"], "dataFlows": [], "keyTypes": [], "hazards": ['say "é"\n'], "rangedHazards": [], "conventions": [], "sourceHighlights": [{"startLine": 1, "endLine": 2}]} | given
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace('"endLine":2,"startLine":1', '"startLine":1,"endLine":2').encode()).hexdigest()


def test_judged(spark):
    rows = spark.createDataFrame([record("a"), record("c", tags=[], source_highlights=None)], RECORD)
    assert [r[0] for r in rows.where("file_path = 'a'").select(K.version()).collect()] == [told()]
    new = {"purpose": "n", "blurb": "n", "tags": ["x"], "source_highlights": [(3, 4)]}
    came = [asked(1, "a", told(), purpose="  new ", blurb=" "), asked(2, "b"), asked(3, "b", K.NOTHING, **new), asked(4, "b", told()), asked(5, "c", purpose="q"), asked(6, "a", "sha256:x"), asked(7, "a", None, ["asserted", "verified-external"], hazards=[])]
    got = {r["number"]: r for r in K.judge(rows, spark.createDataFrame(came, COMMIT)).collect()}
    assert {n: r["status"] for n, r in got.items()} == {1: "committed", 2: "rejected", 3: "committed", 4: "conflict", 5: "rejected", 6: "conflict", 7: "committed"}
    assert got[1]["record"]["purpose"] == "new" and got[1]["record"]["blurb"] == "b" and got[1]["version"] == told(purpose="new")
    assert got[2]["missing"] == ["purpose", "blurb", "tags", "sourceHighlights"] and got[5]["missing"] == ["tags", "sourceHighlights"]
    assert got[6]["version"] == told() and got[4]["version"] == K.NOTHING
    assert got[7]["updated"] == ["changelog", "evidence", "hazards"] and got[7]["verification"] == "verified" and got[7]["version"] == told(hazards=[])


def test_dies_between_history_and_records(spark, monkeypatch):
    files, log = Table(spark, new_folder(spark, "files"), ["workspace", "file_path"]), Table(spark, new_folder(spark, "log"))
    files.write(spark.createDataFrame([record("a"), record("b")], RECORD))
    batch = spark.createDataFrame([asked(1, "a", told(), purpose="new"), asked(2, "a", purpose="second"), asked(3, "b", "sha256:x")], COMMIT)
    with monkeypatch.context() as m:
        m.setattr(files, "upsert", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            K.commit(files, log, batch, ("s", 1))
    for _ in range(2):
        K.commit(files, log, batch, ("s", 1))
    assert {r["file_path"]: r["purpose"] for r in files.read().collect()} == {"a": "new", "b": "p"}
    assert [(r["number"], r["version"], r["updated"]) for r in log.read().collect()] == [(1, told(purpose="new"), "changelog,purpose")]
    K.commit(files, log, spark.createDataFrame([asked(9, "a", told(purpose="new"), blurb="z")], COMMIT), ("s", 2))
    assert sorted(r["number"] for r in log.read().collect()) == [1, 9]
