"""Functions and operators on inputs made for them."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import requests as Q
from lodestone.functions import metadata as M
from lodestone.functions import quality, text
from lodestone.operators import diff, graph
from lodestone.operators import store as S
from lodestone.sources import extract
from lodestone.streaming import changes


def edges_frame(spark, edges):
    return spark.createDataFrame(edges or [("", "")], "source string, target string").where("source <> ''")


def walk(edges, roots, depth):
    """A queue-based traversal with sorted neighbours: depths and first-discovered paths."""
    near = {}
    for a, b in sorted(set(edges)):
        if a != b:
            near.setdefault(a, []).append(b)
    paths = {r: [r] for r in sorted(roots)}
    queue = list(paths)
    for node in queue:
        if len(paths[node]) <= depth:
            for other in near.get(node, []):
                if other not in paths:
                    paths[other] = [*paths[node], other]
                    queue.append(other)
    return paths


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(25)]
    roots = spark.createDataFrame([("n0",), ("n5",)], "node string")
    got = {r.node: r.path for r in graph.bfs(edges_frame(spark, edges), roots, 3, paths=True).collect()}
    assert got == walk(edges, ["n0", "n5"], 3)


@pytest.mark.parametrize(("seed", "local"), [(3, 0), (4, 0), (5, 1000)])
def test_strong_components_and_components(spark, monkeypatch, seed, local):
    """By rounds over all executors, and by the last task of one."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(15):02d}", f"n{rng.randrange(15):02d}") for _ in range(24)]
    reach = {a: set(walk(edges, [a], 99)) for a in {x for e in edges for x in e}}
    want = {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if any(b != a and a in reach.get(b, ()) for b in reach[a])}
    assert {r.node: r.scc for r in graph.strong_components(edges_frame(spark, edges)).collect()} == want
    both = edges + [(b, a) for a, b in edges]
    assert {r.node: r.component for r in graph.components(edges_frame(spark, edges)).collect()} == {a: min(walk(both, [a], 99)) for a in reach}
    assert graph.strong_components(edges_frame(spark, [])).count() == 0


def test_many_rounds(spark, monkeypatch):
    """A way of 40 steps takes 40 rounds, each no larger a plan than the one before; a chain's components few."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)]
    e = edges_frame(spark, chain)
    far = graph.bfs(e, spark.createDataFrame([("n000",)], "node string"), 50)
    assert {r.node: r.depth for r in far.collect()} == {f"n{k:03d}": k for k in range(41)}
    assert {r.component for r in graph.components(e).collect()} == {"n000"}
    ring = edges_frame(spark, [*chain[:12], ("n012", "n000"), ("z", "n003")])
    assert {r.node for r in graph.strong_components(ring).collect()} == {f"n{k:03d}" for k in range(13)}
    assert graph.trace(e, "n002", "n007", 8).first().path == [f"n{k:03d}" for k in range(2, 8)]
    assert graph.trace(e, "n007", "n002", 8).count() == 0 and graph.trace(e, "n000", "n009", 8).count() == 0


def test_cycles_with_loops_and_one_file(spark):
    e = edges_frame(spark, [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("b", "b")])
    assert sorted(map(tuple, graph.cycles(e).collect())) == [("a", "a", 2), ("b", "a", 2), ("d", "d", 3), ("e", "d", 3), ("f", "d", 3)]
    assert sorted(map(tuple, graph.cycles(e, least=1).where("size = 1").collect())) == [("c", "c", 1)]
    assert {r.node for r in graph.cycles(e, holding=spark.createDataFrame([("e",)], "node string")).collect()} == {"d", "e", "f"}


def test_cheapest_paths_as_enumeration(spark):
    """Eight hops at most, against all simple paths of a small graph."""
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(8)}", f"n{rng.randrange(8)}", rng.choice([0.75, 1.0, 1.25, 1.5])) for _ in range(20)]
    least = {}

    def go(node, cost, path):
        least[node] = min(least.get(node, 99), round(cost, 6))
        if len(path) <= 8:
            for a, b, w in edges:
                if a == node and b not in path:
                    go(b, cost + w, [*path, b])

    go("n0", 0, ["n0"])
    got = graph.cheapest_paths(spark.createDataFrame(edges, "source string, target string, cost double"), "n0", 8).collect()
    assert {r.node: round(r.cost, 6) for r in got} == least


def test_cheapest_paths(spark):
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.5), ("c", "a", 1.0), ("c", "d", 1.0), ("a", "d", 3.0)]
    got = {r.node: (r.cost, r.path) for r in graph.cheapest_paths(spark.createDataFrame(rows, "source string, target string, cost double"), "a", 3).collect()}
    assert got == {"a": (0.0, ["a"]), "b": (1.0, ["a", "b"]), "c": (2.0, ["a", "b", "c"]), "d": (3.0, ["a", "d"])}
    assert graph.cheapest_paths(spark.createDataFrame(rows, "source string, target string, cost double"), "a", 1).where("node = 'c'").first().cost == 2.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(0, 3))
def test_patches_apply(a, b, context):
    assert diff.apply(a, diff.unified(a, b, context)) == b
    assert (diff.unified(a, b, context) == []) == (a == b)


def test_requests():
    assert Q.validate("search", {"query": "x", "limit": 5}) == {"query": "x", "limit": 5}
    for action, request, code in (("nope", {}, "UNKNOWN_ACTION"), ("search", {"query": "x", "zz": 1, "aa": 2}, "UNKNOWN_FIELD"), ("search", {}, "MISSING_FIELD"), ("search", {"query": 1}, "INVALID_FIELD"), ("search", {"query": "x", "limit": 0}, "OUT_OF_RANGE"), ("search", {"query": "x", "limit": True}, "INVALID_FIELD"), ("history", {"mode": "x"}, "INVALID_FIELD")):
        with pytest.raises(Q.RequestError) as e:
            Q.validate(action, request)
        assert e.value.code == code
    assert Q.fnv1a("") == "cbf29ce484222325" and Q.fnv1a("a") == "af63dc4c8601ec8c"
    assert Q.split_limit(10, 3) == [4, 3, 3] and Q.split_limit(5, 0) == []
    scope = Q.scope_of("search", {"query": "x"})
    assert Q.decode_cursor(Q.encode_cursor(scope, 7), scope) == 7
    for bad in ("x", Q.encode_cursor("0" * 16, 1)):
        with pytest.raises(Q.RequestError):
            Q.decode_cursor(bad, scope)


def test_pages(spark):
    rows = spark.range(45).withColumnRenamed("id", "n")
    request, seen = {"query": "q"}, []
    while True:
        result = Q.page("search", request, rows, "n")
        seen += [r["n"] for r in result.data]
        if not result.next_cursor:
            break
        request = {"query": "q", "cursor": result.next_cursor}
    assert seen == list(range(45)) and result.envelope()["meta"]["page"]["total"] == 45
    assert len(Q.page("search", {"query": "q", "max_characters": 26}, rows, "n").data) == 3
    with pytest.raises(Q.RequestError):
        Q.page("search", {"query": "q", "max_characters": 3}, rows, "n")


def test_tables(spark, tmp_path):
    t = S.Table(spark, str(tmp_path / "t"), ["k"])
    assert t.current() is None
    rows = lambda x: spark.createDataFrame(x, "k long, v string")
    t.upsert(rows([(1, "a"), (2, "b")]))
    before = t.manifest()["parts"]
    t.upsert(rows([(2, "c"), (3, "d")]))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert any(p in t.manifest()["parts"].values() for p in before.values())  # the bucket of key 1 is as it was
    t.append(rows([(9, "z")]), batch=("s", 4))
    t.append(rows([(9, "z")]), batch=("s", 4))
    t.upsert(rows([(1, "q")]), batch=("s", 3))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d"), (9, "z")]
    t.write(rows([]))
    assert t.read().count() == 0


@pytest.mark.parametrize("where", ["_put", "_commit", "rename"])
def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch, where):
    rows = lambda x: spark.createDataFrame(x, "k long, v string")
    t = S.Table(spark, str(tmp_path / "t"), ["k"])
    t.upsert(rows([(1, "a"), (2, "b")]))

    class Dead(Exception):
        pass

    def die(*_, **__):
        raise Dead

    with monkeypatch.context() as m:
        if where == "rename":  # the manifest is written aside, not put in place

            class Broken:
                def __getattr__(self, name):
                    return die if name == "rename" else getattr(S.Table(spark, t.path)._fs, name)

            m.setattr(t, "_fs", Broken())
        else:
            m.setattr(t, where, die)
        with pytest.raises(Dead):
            t.upsert(rows([(2, "c"), (3, "d")]))
    assert sorted(map(tuple, S.Table(spark, t.path, ["k"]).read().collect())) == [(1, "a"), (2, "b")]
    t.upsert(rows([(2, "c"), (3, "d")]))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_commands_apply_once_across_a_crash(spark, tmp_path):
    """A run dies after the effects of a batch are written and before they are noted as done."""
    schema = "key long, payload_hash string, seq long"
    feed = [[(1, "a", 1), (2, "b", 2), (1, "x", 3)], [(2, "b", 4), (3, "c", 5)], [(3, "z", 6), (4, "d", 7)]]
    done, log = S.Table(spark, str(tmp_path / "done"), ["key"]), S.Table(spark, str(tmp_path / "log"), ["key"])
    for k, part in enumerate(feed):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        for crash in (True, False):
            table = S.Table(spark, done.path, ["key"])
            if crash:

                def die(*_, **__):
                    raise RuntimeError("dead")

                table.upsert = die
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
            q = changes.exactly_once(stream, table, log, lambda fresh: fresh.select("key", "seq"), "c", "seq").option("checkpointLocation", str(tmp_path / "state")).start()
            try:
                q.awaitTermination()
            except Exception:
                assert crash, k
    assert sorted(map(tuple, log.read().collect())) == [(1, 1), (2, 2), (3, 5), (4, 7)]


def test_commits(spark):
    stored = spark.createDataFrame([("a", "x", "p", "v1"), ("b", None, "p", "v1")], "key string, blurb string, purpose string, version string")
    asked = spark.createDataFrame([("a", None, "q", "v1"), ("b", None, None, None), ("a", "y", None, "v0"), ("c", "n", "m", None)], "key string, blurb string, purpose string, expected string")
    got = [(r.key, r.status, r.blurb, r.purpose) for r in S.apply_commits(stored, asked, "key", ["blurb", "purpose"], "version").collect()]
    assert sorted(got, key=str) == sorted([("a", "applied", "x", "q"), ("b", "rejected", None, "p"), ("a", "conflict", "y", "p"), ("c", "applied", "n", "m")], key=str)


def test_changes_in_a_batch(spark):
    batch = spark.createDataFrame([("a", None, "upsert", 1), ("b", "a", "rename", 2), ("c", None, "upsert", 3), ("c", None, "delete", 4)], "path string, old_path string, op string, seq long")
    last = changes.coalesce_changes(changes.renames(batch))
    assert sorted((r.path, r.op) for r in last.collect()) == [("a", "delete"), ("b", "upsert"), ("c", "delete")]


def test_text_functions(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    assert one(text.normalize(F.lit("HTTPServerUserName_x-y"))) == "HTTP Server User Name x y"
    assert text.query_terms("What is the userName, of foo.bar?") == ["user", "name", "foo", "bar"]
    assert one(text.tokens(F.lit("Élan vital's N°5"))) == ["elan", "vital", "s", "n", "5"]
    assert one(text.clamp_text(F.lit("a😀bcd"), 3)) == "a😀…"
    for code, kind in (("import { foo } from './x'", "import"), ("export { foo }", "re-export"), ("foo(1)", "call"), ("let a: foo", "type-reference"), ("a + foo", "reference")):
        assert one(text.usage_type(F.lit(code), "foo")) == kind


def test_paths_and_tiers(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    for raw, want in (("src/./a//b.ts", "src/a/b.ts"), ("a\\b", "a/b"), ("a/../b", "b"), ("../a", None), ("/a", None), ("", None), ("a/../..", None)):
        assert one(M.canonical_path(F.lit(raw))) == want, raw
    for raw, want in (("src/a.ts", "core"), ("src/app/api/jobs/r.ts", "api-jobs"), ("src/app/home/p.tsx", "page-home"), ("src/components/audio/x.tsx", "ui-audio"), ("lib/x.ts", "misc-lib"), ("a/readme.md", "docs"), ("src/hooks/useFoo.ts", "hooks-useFoo.ts")):
        assert one(M.path_cluster(F.lit(raw))) == want, raw
    for lines, want in ((24, "tiny"), (None, "small"), (0, "small"), (200, "small"), (600, "medium"), (900, "large"), (2000, "huge")):
        assert one(M.tier(F.lit(lines).cast("long"))) == want
    assert one(M.scanned(F.lit("src/node_modules/x.ts"))) is False and one(M.scanned(F.lit("src/x.py"))) is True


def test_hazards():
    rows = ["Must not run twice", "must not run twice", "must run twice", "limit is 5 rows", "limit is 6 rows", "  "]
    assert quality.dedupe_hazards(rows) == ["Must not run twice", "must run twice", "limit is 5 rows", "limit is 6 rows"]
    assert quality.dedupe_hazards(quality.dedupe_hazards(rows)) == quality.dedupe_hazards(rows)


def test_extraction(spark):
    source = "import {\n  a\n} from './x.js';\nimport d, { e } from '../y';\nimport './side';\nexport * from './z';\nconst p = require('pkg/sub');\nexport async function go() {}\nexport default go;\n"
    r = spark.range(1).select(extract.imports(F.lit(source)).alias("i"), extract.exports(F.lit(source)).alias("e"), extract.specifiers(F.lit(source)).alias("s")).first()
    assert r.i == ["./x.js", "../y", "./z"] and [tuple(x) for x in r.e] == [("go", "function"), ("default", "default")] and "pkg/sub" in r.s
    files = spark.createDataFrame([("src/a/m.ts",), ("src/a/x.ts",), ("src/y/index.ts",), ("src/a/x.js",)], "file_path string")
    uses = spark.createDataFrame([("src/a/m.ts", "./x.js"), ("src/a/m.ts", "../y"), ("src/a/m.ts", "./none")], "file_path string, specifier string")
    assert {(r.specifier, r.target) for r in extract.resolve(uses, files).collect()} == {("./x.js", "src/a/x.ts"), ("../y", "src/y/index.ts")}
    assert extract.parse("python", "def broken(:\n") == ([], [])
    symbols, edges = extract.parse("python", "class A(B):\n  def m(self):\n    def inner(): pass\n    return self.k()\n")
    assert [s[0] for s in symbols] == ["A", "A.m"] and ("A", "B", "EXTENDS") in edges and ("A.m", "k", "CALLS") in edges
    assert [s[:3] for s in extract.parse("typescript", 'export class K extends L implements M, N {\n  s = "}";\n}\n')[0]] == [("K", "class", True)]


def test_watch_in_any_order(spark, tmp_path):
    """Batches that arrive late or twice give the table that the sequence numbers tell."""
    rows = [("a", None, "upsert", 1), ("b", "a", "rename", 2), ("a", None, "upsert", 5), ("c", None, "upsert", 3), ("c", None, "delete", 4)]
    schema = "path string, old_path string, op string, seq long"
    for k, part in enumerate((rows[3:], rows[:3], rows[1:4])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        table = S.Table(spark, str(tmp_path / "table"), ["path"])
        changes.watch(stream, table).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert sorted(map(tuple, changes.present(table).collect())) == [("a", 5), ("b", 2)]


def test_completeness_goldens(spark):
    rows = [(24, ["blurb", "tags"], "tiny", 1.0, 0.2), (900, ["blurb", "purpose", "tags"], "large", 0.5, 0.3), (None, ["blurb"], "small", 1 / 3, 0.1)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in rows], "loc long, filled array<string>")
    tier = M.tier(F.col("loc"))
    need = M.required(tier)
    got = df.select(tier.alias("tier"), (F.size(F.array_intersect(need, "filled")) / F.size(need)).alias("r"), (F.size("filled") / len(M.FIELDS)).alias("o")).collect()
    assert [(g.tier, pytest.approx(g.r), pytest.approx(g.o)) for g in got] == [(t, r, o) for _, _, t, r, o in rows]


def test_incomplete_files_of_all_tiers(spark, tmp_path):
    """Large and huge files are reported, with what their tiers require."""
    from lodestone.plans.queries import QUERIES

    sizes = {1: 50, 2: 200, 4: 600, 5: 601, 6: 1500, 8: 1501}
    docs = spark.createDataFrame([(k, "\n".join(["x"] * n), "en", "src0", n) for k, n in sizes.items()], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.file_path.split("_")[-1].split(".")[0]: (r.tier, r.missing) for r in QUERIES["aud_incomplete_tiers"](spark, str(tmp_path)).collect()}
    # blurbs are empty where 5 divides the id, tags where 6 does; no file has highlights or key types
    assert found == {
        "1": ("tiny", ""), "2": ("small", ""), "4": ("medium", "hazards"), "5": ("large", "blurb,hazards,source_highlights"),
        "6": ("large", "tags,hazards,source_highlights"), "8": ("huge", "hazards,source_highlights,key_types"),
    }


def test_scripts():
    """Methods, generics, nested functions, strings and comments that look like code, and broken files."""
    from lodestone.sources.script import Script

    code = """import { x } from './y';
export class Svc extends ns.Base<T> implements One, Two<U> {
  private count = 0;
  constructor(private readonly a: string) { super(a); }
  async run<T>(a: string, { b }: Opts): Promise<T> {
    const v = await load(a);
    list.forEach((q) => { hidden(q); });
    if (v) { return this.done(v); }
    save(b)
    return v
  }
  private done(b) { return b; }
}
export type K = { a: string } | "}";
export const k1 = 5;
function* gen(n) {
  function inner() { nope(); }
  // comment call()
  const s = "str call() }";
  setTimeout(tick, 5);
  return (make(n));
}
"""
    s = Script(code)
    assert [x[:3] for x in s.symbols] == [("Svc", "class", True), ("Svc.constructor", "method", True), ("Svc.run", "method", True), ("Svc.done", "method", False), ("K", "type", True), ("k1", "const", True), ("gen", "function", False)]
    assert [x[3:] for x in s.symbols][:3] == [(2, 13), (4, 4), (5, 11)]
    assert {e for e in s.edges if e[2] == "CALLS"} == {("Svc.run", "load", "CALLS"), ("Svc.run", "list.forEach", "CALLS"), ("Svc.run", "done", "CALLS"), ("Svc.run", "save", "CALLS"), ("gen", "make", "CALLS")}
    assert ("Svc", "ns.Base", "EXTENDS") in s.edges and ("Svc", "Two", "IMPLEMENTS") in s.edges and ("Svc", "U", "IMPLEMENTS") not in s.edges
    assert set(s.flow) == {
        ("Svc.run", "load", "CONSUMES"), ("Svc.run", "Svc.run", "PRODUCES"), ("done", "Svc.run", "DATA_FLOWS_TO"), ("load", "done", "DATA_FLOWS_TO"), ("Svc.run", "save", "CONSUMES"), ("load", "Svc.run", "DATA_FLOWS_TO"),
        ("Svc.done", "Svc.done", "PRODUCES"), ("gen", "tick", "TRIGGERS"), ("gen", "gen", "PRODUCES"), ("make", "gen", "DATA_FLOWS_TO"), ("gen", "make", "CONSUMES"),
    }
    for k in range(len(code)):
        Script(code[:k])  # a file cut anywhere is read without an error


def test_work_plans():
    from lodestone.planning import work_plan

    p = work_plan("cycles")
    assert (p.max_work_units, p.deadline_ms, p.node_limit, p.edge_limit, p.planned_work_units) == (20000, 5000, 4000, 8000, 20000)
    p = work_plan("audit:smells", 100, 999)
    assert (p.deadline_ms, p.node_limit, p.edge_limit, p.planned_work_units) == (999, 9, 27, 99)
    p = work_plan("search", 0, 999_999)
    assert (p.max_work_units, p.deadline_ms, p.node_limit, p.planned_work_units) == (1, 30_000, 0, 0)
    assert work_plan("search", float("nan")).max_work_units == 20000


def test_commit_payloads():
    from lodestone.payloads import normalise_commit

    got = normalise_commit({"path": " a.ts ", "description": " why ", "tags": '["x", " ", 3]', "hazards": "- one\n* two, three", "breakingChanges": "YES", "publicApi": [{"symbol": "f", "kind": "function", "summary": "s"}, "g", {"kind": "x"}, 7],
                            "sourceHighlights": {"text": "code", "start": "2", "end_line": 4.9, "title": "T"}, "nonsense": 1})
    assert got == {
        "file_path": "a.ts", "changelog_entry": "why", "summary": "why", "hazards": ["one", "two", "three"], "tags": ["x", "3"], "breaking_changes": True,
        "public_api": [{"name": "f", "type": "function", "description": "s"}, {"name": "g", "type": "value"}], "source_highlights": [{"id": 1, "content": "code", "startLine": 2, "endLine": 4, "label": "T"}],
    }
    assert normalise_commit({"tags": ",", "summary": "s", "breaking_changes": "maybe", "public_api": "{broken"})["breaking_changes"] == "maybe"


def test_embedding_checks():
    from lodestone import embedding as M

    space, limits = M.Space("p", "m", 2), M.Limits(items=2, batch_bytes=6, item_bytes=5)
    assert list(M.batches(["ab", "cd", "ef", "ghijk", "l"], limits)) == [["ab", "cd"], ["ef"], ["ghijk", "l"]]
    with pytest.raises(M.EmbeddingError):
        list(M.batches(["abcdef"], limits))
    assert M.checked([[0.6, 0.8]], 1, space) == [[0.6, 0.8]]
    for bad in ([], [[1.0]], [[float("nan"), 1.0]], [[1.0, 1.0]]):
        with pytest.raises(M.EmbeddingError):
            M.checked(bad, 1, space)


def test_masks_spread_as_walks(spark):
    """Bits of several blocks along a random graph with cycles, against a walk for each bit."""
    rng = random.Random(12)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)]
    seeds = [(f"n{rng.randrange(25)}", rng.randrange(2), rng.randrange(graph.BITS)) for _ in range(30)]
    want = {}
    for node, block, bit in seeds:
        seen, todo = set(), [node]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [b for a, b in edges if a == at]
        for n in seen:
            want[n, block] = want.get((n, block), 0) | 1 << bit
    frame = spark.createDataFrame([(n, b, 1 << k) for n, b, k in seeds], "node string, block int, mask long")
    assert {(r.node, r.block): r.mask for r in graph.spread(edges_frame(spark, edges), frame).collect()} == want


def test_reachable_to_the_end(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(55)]
    assert graph.reachable(edges_frame(spark, chain), spark.createDataFrame([("n000",)], "node string")).count() == 56


def test_loaded_identifiers(spark):
    from lodestone.functions.text import loaded_identifiers

    rows = ["loads userRows and derive `total` from `x`", "fetch `y1`, LOAD the Value, derived VALUES", "loading Thing; reload Thing; load lower", None, "`a` `bb` load `bb`"]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, flow string").select("k", loaded_identifiers(F.col("flow")).alias("x")).collect()
    assert {r.k: [tuple(x) for x in r.x] if r.x is not None else None for r in got} == {0: [("total", True), ("userRows", True)], 1: [("y1", True)], 2: [], 3: None, 4: [("bb", True)]}
