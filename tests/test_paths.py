"""Aliases, redirects and chains against a walk path by path."""

import math
import random

from lodestone.operators import paths
from lodestone.shared import shared_table

MAP = "`from` string, to string, kind string"


def walk(path, aliases, redirects):
    """(path, state, aliased, redirected), one step after the other."""

    def best(maps, path):
        fits = [(len(f), f, t) for f, t, k in maps if path == f or (k == "directory" and path.startswith(f + "/"))]
        return max(fits, key=lambda x: x[0])[1:] if fits else None

    seen, aliased, redirected = {path}, False, False
    while True:
        changed = False
        if hit := best(aliases, path):
            path, aliased, changed = hit[1] + path[len(hit[0]) :], True, True
            if path in seen:
                return None, "cycle"
            seen.add(path)
        if hit := best(redirects, path):
            redirected = True
            if hit[1] is None:
                return path, "deleted", aliased, redirected
            path, changed = hit[1] + path[len(hit[0]) :], True
            if path in seen:
                return None, "cycle"
            seen.add(path)
        if not changed:
            return path, "current", aliased, redirected


def test_resolve_as_walk(spark):
    rng = random.Random(8)
    dirs = ["a", "b", "a/x", "b/x", "c", "d/y", "loop1", "loop2", "gone"]
    aliases = [("a", "c", "directory"), ("loop1", "loop2", "directory"), ("b/x", "d/y", "directory"), ("c/f3", "c/f4", "file")]
    redirects = [("loop2", "loop1", "directory"), ("d/y", "c", "directory"), ("gone", None, "directory")]
    every = [f"{d}/f{k}" for d in dirs for k in range(12)]
    for p in rng.sample([e for e in every if e[0] in "bcd"], 40):
        if p != "c/f3":
            redirects.append((p, rng.choice([*every, None]), "file"))
    redirects = [r for r in redirects if r[0] != r[1]]
    found = paths.resolve(spark.createDataFrame([(p,) for p in every], "input string"), spark.createDataFrame(aliases, MAP), spark.createDataFrame(redirects, MAP)).collect()
    assert len(found) == len(every)
    for r in found:
        want = walk(r["input"], aliases, redirects)
        assert (r["path"], r["state"]) == want[:2], r["input"]
        if r["state"] != "cycle":
            assert (r["aliased"], r["redirected"]) == want[2:]
    assert {r["state"] for r in found} == {"current", "deleted", "cycle"}


def test_chains_in_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(paths, "cut", lambda df, *done: (rounds.append(1), shared_table(df, "cut"))[1])
    links = [(f"n{k:04}", f"n{k + 1:04}") for k in range(1000)] + [("x", "y"), ("y", "z"), ("z", "y"), ("w", "x")]
    found = {r["source"]: (r["at"], r["hops"], r["cycle"]) for r in paths.chains(spark.createDataFrame(links, "source string, target string")).collect()}
    assert all(found[f"n{k:04}"] == ("n1000", 1000 - k, False) for k in range(1000))
    assert all(found[c] == (None, None, True) for c in "xyzw")
    assert len(rounds) <= 3 + math.ceil(math.log2(len(links)))
