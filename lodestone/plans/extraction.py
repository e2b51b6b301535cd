"""Registered queries: extraction from source text. The code is made of the part table, a file per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import usage_type
from ..sources import extract as X
from ..sources.adapters import table
from .registry import query

CODE = """code as (select p_partkey as id, 'src/' || (p_partkey % 40) || '/part_' || p_partkey || case when p_partkey % 3 = 0 then '.tsx' else '.ts' end as file_path,
'import { a' || (p_partkey % 5) || ', b as c } from ''../' || ((p_partkey + 1) % 40) || '/part_' || (p_partkey + 1) || '.js'';' || chr(10)
|| 'import * as ns from ''@scope/pkg' || (p_partkey % 4) || '/deep'';' || chr(10) || 'import ''./side' || (p_partkey % 3) || ''';' || chr(10)
|| 'export function fn' || p_partkey || '(x) {' || chr(10) || '  return helper' || (p_partkey % 7) || '(x);' || chr(10) || '}' || chr(10)
|| 'function helper' || (p_partkey % 7) || '(y) { return y; }' || chr(10)
|| case when p_size % 2 = 0 then 'export class C' || p_size || ' extends Base {}' || chr(10) else 'export const k' || p_size || ' = 1;' || chr(10) end
|| case when p_size % 5 = 0 then 'export default fn' || p_partkey || ';' || chr(10) else '' end || 'export { q as r' || (p_size % 3) || ' };' as text from part)"""


def code(spark, sf_dir):
    """Source files, by the same expression as the oracle's."""
    table(spark, sf_dir, "part").createOrReplaceTempView("lodestone_part")
    body = CODE.split(" as (", 1)[1].rsplit(")", 1)[0].replace("from part", "from lodestone_part")
    return spark.sql(body).withColumn("language", F.when(F.col("file_path").endswith("x"), "tsx").otherwise("typescript"))


def sql(key, statement):
    return query(key, f"with {CODE} {statement}")


@sql("ext_imports", r"""select id, unnest(regexp_extract_all(text, 'from\s+[\x22\x27](\.[^\x22\x27]+)', 1)) as specifier from code""")
def ext_imports(spark, sf_dir):
    return code(spark, sf_dir).select("id", F.explode(X.imports(F.col("text"))).alias("specifier"))


@sql("ext_exports", r"""select id, unnest(regexp_extract_all(text, 'export\s+(?:async\s+)?function\s+(\w+)', 1)) as name, 'function' as type from code union all select id, unnest(regexp_extract_all(text, 'export\s+class\s+(\w+)', 1)), 'class' from code union all
select id, unnest(regexp_extract_all(text, 'export\s+const\s+(\w+)', 1)), 'const' from code union all select id, 'default', 'default' from code where contains(text, 'export default')""")
def ext_exports(spark, sf_dir):
    return code(spark, sf_dir).select("id", F.inline(X.exports(F.col("text"))))


@sql("ext_exports_full", r"""select id, name from (select id, unnest(regexp_extract_all(text, 'export\s+(?:function|class|const)\s+(\w+)', 1)) as name from code union all select id, regexp_extract(text, 'export \{ q as (\w+) \}', 1) from code)""")
def ext_exports_full(spark, sf_dir):
    c = code(spark, sf_dir)
    names = F.array_distinct(F.concat(F.filter(F.transform(X.exports(F.col("text")), lambda e: e["name"]), lambda n: n != "default"), X.reexports(F.col("text"))))
    return c.select("id", F.explode(names).alias("name"))


@sql("ext_parse_imports", r"""select id, 'named' as form, 'a' || (id % 5) || ', b as c' as names, '../' || ((id + 1) % 40) || '/part_' || (id + 1) || '.js' as specifier from code union all select id, 'namespace', 'ns', '@scope/pkg' || (id % 4) || '/deep' from code union all select id, 'side-effect', '', './side' || (id % 3) from code""")
def ext_parse_imports(spark, sf_dir):
    return code(spark, sf_dir).select("id", F.inline(X.import_clauses(F.col("text"))))


# A file's last line calls what the named and the namespace import bind, in every third file.
CALLED = "|| case when id % 3 = 0 then chr(10) || 'a' || (id % 5) || '(ns, c);' else '' end"


@sql("aud_imported_not_used", f"""select file_path, form, specifier, case when form = 'side-effect' then 'side effect only' else 'not used' end as note from (select file_path, id, 'named' as form, '../' || ((id + 1) % 40) || '/part_' || (id + 1) || '.js' as specifier from code union all select file_path, id, 'namespace', '@scope/pkg' || (id % 4) || '/deep' from code union all select file_path, id, 'side-effect', './side' || (id % 3) from code) where form = 'side-effect' or id % 3 <> 0""")
def aud_imported_not_used(spark, sf_dir):
    """Imports none of whose bound names occurs in the body that is left without imports."""
    text = F.expr(f"concat(text, {CALLED.removeprefix('|| ').replace('chr(10) || ', 'chr(10) || ')})")
    return X.unused_imports(code(spark, sf_dir).withColumn("text", text))


MANIFEST = '{"name": "x", "dependencies": {"@scope/pkg0": "1", "@scope/pkg1": "^2", "@scope/pkg9": "1", "left": "0.1"}, "devDependencies": {"@scope/pkg3": "1", "checker": "9"}}'


@sql("aud_installed_not_imported", "select package from (values ('@scope/pkg0'), ('@scope/pkg1'), ('@scope/pkg9'), ('left')) t(package) where package not in (select '@scope/pkg' || (id % 4) from code)")
def aud_installed_not_imported(spark, sf_dir):
    """Dependencies of the manifest that no import of any file names."""
    manifest = spark.range(1).select(F.from_json(F.lit(MANIFEST), "dependencies map<string,string>").alias("m"))
    declared = manifest.select(F.explode(F.map_keys("m.dependencies")).alias("package"))
    used = code(spark, sf_dir).select(F.explode(X.specifiers(F.col("text"))).alias("s")).select(X.package(F.col("s")).alias("package")).where("package is not null").distinct()
    return declared.join(used, "package", "left_anti")


@sql("ext_packages", "select '@scope/pkg' || (id % 4) as package, count(*)::bigint as files from code group by 1")
def ext_packages(spark, sf_dir):
    s = code(spark, sf_dir).select("id", F.explode(X.specifiers(F.col("text"))).alias("s")).select("id", X.package(F.col("s")).alias("package")).where("package is not null")
    return s.groupBy("package").agg(F.count_distinct("id").alias("files"))


@sql("ext_resolve", "select a.file_path, '../' || ((a.id + 1) % 40) || '/part_' || (a.id + 1) || '.js' as specifier, b.file_path as target from code a join code b on b.id = a.id + 1")
def ext_resolve(spark, sf_dir):
    c = code(spark, sf_dir)
    return X.resolve(c.select("file_path", F.explode(X.imports(F.col("text"))).alias("specifier")), c)


@sql("ext_symbols_ts", """select file_path, 'fn' || id as name, 'function' as kind, true as exported, 4 as line_start, 6 as line_end from code union all select file_path, 'helper' || (id % 7), 'function', false, 7, 7 from code
union all select c.file_path, case when p_size % 2 = 0 then 'C' || p_size else 'k' || p_size end, case when p_size % 2 = 0 then 'class' else 'const' end, true, 8, 8 from code c join part on p_partkey = id""")
def ext_symbols_ts(spark, sf_dir):
    return X.parsed(code(spark, sf_dir))


@sql("ext_symbol_edges", "select file_path, 'fn' || id as source, 'helper' || (id % 7) as target, 'CALLS' as edge_type from code union all select c.file_path, 'C' || p_size, 'Base', 'EXTENDS' from code c join part on p_partkey = id where p_size % 2 = 0")
def ext_symbol_edges(spark, sf_dir):
    return X.parsed(code(spark, sf_dir), edges=True)


#: A file per part and language, made of the part's name and size: how many fields, whether it is exported; comments and
#: strings in it look like code.
LANGUAGE_TEXTS = {
    "python": """select 'f' || k as file_path, 'class ' || c || '(Base):' || nl || repeat('    a = 1' || nl, size) || '    def ' || case when odd then '_' else '' end || w || '(self):' || nl || '        "def fake(): pass"' || nl || '        return self.go()' || nl || '# def no(): pass' as text""",
    "go": """select 'f' || k as file_path, '/* func No() {' || nl || '*/' || nl || 'type ' || c || '[T any] struct {' || nl || repeat('  a int // }' || nl, size) || '}' || nl || 'func (x *' || c || '[T]) ' || case when odd then w else upper(w) end || '() string {' || nl || '  return `}' || nl || 'func Fake() {' || nl || '`' || nl || '}' as text""",
    "rust": """select 'f' || k as file_path, '/* a /* nested */ fn no() {} */' || nl || case when odd then '' else 'pub ' end || 'struct ' || c || '<T> {' || nl || repeat('    a: i32, // }' || nl, size) || '}' || nl || 'impl<T: Clone> ' || c || '<T> {' || nl || '    pub fn ' || w || '(&self) { let s = r#"fn fake() { "}" "#; }' || nl || '}' as text""",
    "java": """select 'f' || k as file_path, '// class No {' || nl || case when odd then '' else 'public ' end || 'class ' || c || '<T> extends Base<T> {' || nl || repeat('    int a; /* } */' || nl, size) || '    public <R> void ' || w || '(R r) {' || nl || '        s = "class Fake {";' || nl || '    }' || nl || '}' as text""",
}
TEXTS = " from (select p_partkey as k, 'C' || p_partkey as c, lower(replace(p_name, ' ', '')) as w, cast(p_size % 4 as int) as size, p_size % 2 = 1 as odd, chr(10) as nl from {part})"


def _language_query(name):
    def fn(spark, sf_dir):
        table(spark, sf_dir, "part").createOrReplaceTempView("lodestone_text_part")
        return X.parsed(spark.sql(LANGUAGE_TEXTS[name] + TEXTS.format(part="lodestone_text_part")).withColumn("language", F.lit(name)))

    return fn


def _lines_sql(name, *found):
    """SQL that looks through the lines of each text: (the first line, kind, name, exported, the last line)."""
    rows = " union all ".join(
        f"""select file_path, {named} as name, '{kind}' as kind, {exported} as exported, line::int as line_start,
  (select min(e.line) from lines e where e.file_path = l.file_path and e.line >= l.line and regexp_matches(e.body, '{last}'))::int as line_end from lines l where regexp_matches(body, '{first}')"""
        for first, kind, named, exported, last in found
    )
    return f"""with texts as ({LANGUAGE_TEXTS[name] + TEXTS.format(part="part")}),
lines as (select file_path, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line from texts) {rows}"""


OWNER = "'C' || substr(file_path, 2) || '.' || "
for _name, _found in {
    "python": (("^class ", "class", r"regexp_extract(body, '^class (\w+)', 1)", "true", "return"), ("^    def ", "function", OWNER + r"regexp_extract(body, 'def (\w+)', 1)", "not contains(body, 'def _')", "return")),
    "go": (("^type ", "struct", r"regexp_extract(body, '^type (\w+)', 1)", "true", "^}$"), ("^func .x", "method", OWNER + r"regexp_extract(body, '[)] (\w+)[(]', 1)", "regexp_matches(body, '[)] [A-Z]')", "^}$")),
    "rust": (("struct C", "struct", r"regexp_extract(body, 'struct (\w+)', 1)", "starts_with(body, 'pub ')", "^}$"), ("^    pub fn ", "method", OWNER + r"regexp_extract(body, 'fn (\w+)', 1)", "true", "^    pub fn ")),
    "java": (("^(public )?class C", "class", r"regexp_extract(body, 'class (\w+)', 1)", "starts_with(body, 'public ')", "^}$"), ("^    public <R>", "method", OWNER + r"regexp_extract(body, 'void (\w+)', 1)", "true", "^    }$")),
}.items():
    query(f"ext_symbols_{_name}", _lines_sql(_name, *_found))(_language_query(_name))


@sql("ext_symbol_range", """, l as (select id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line from code)
select id, min(line) filter (starts_with(body, 'export function '))::int as line_start, min(line) filter (body = '}')::int as line_end from l group by id""")
def ext_symbol_range(spark, sf_dir):
    """Where each file's exported function begins and ends."""
    return X.parsed(code(spark, sf_dir)).where("name like 'fn%'").select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("id"), "line_start", "line_end")


@sql("ext_export_sites", """, l as (select file_path, len(string_split(text, chr(10))) as total, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as line, unnest(string_split(text, chr(10))) as body from code),
n as (select *, lead(line) over (partition by file_path order by line) as next, row_number() over (partition by file_path order by line) as place from l where starts_with(body, 'export '))
select file_path, line as start_line, least(coalesce(next - 1, total), line + 59, total)::int as end_line from n where place <= 6""")
def ext_export_sites(spark, sf_dir):
    """Highlights around the first six exporting lines: each up to the next such line, and 60 lines at most."""
    return X.export_ranges(code(spark, sf_dir))


# Classes with methods, calls across files, callbacks and events; every other file differs in a method.
RICH_LINES = (
    "export class Svc{k} extends Base{m} implements One, Two {", "  async run(a: string, n: number): Promise<string> {", "    const v = await load{m}(a);", "    bus.emit('ready{e}', n);", "    items.map(handle{m});",
    "    return this.done(v);", "  }", "  {d}", "}", "export const arrow{k} = (p) => wrap{m}(p);", "function listen{k}() { bus.on('ready{e}', onReady{k}); }",
)


def rich(spark, sf_dir):
    """Source files with all of these. Keys are dealt before their texts are made: they are so narrow that few tasks
    would read them, and parse all that is made of them."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    text = F.lit("\n".join(RICH_LINES))
    for mark, value in (("{d}", F.when(k % 2 == 1, "done(b) { return save(b); }").otherwise("private done(b) { return b; }")), ("{k}", k), ("{m}", k % 5), ("{e}", F.floor(k / 4))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return parts.select(F.concat(F.lit("svc/"), k.cast("string"), F.lit(".ts")).alias("file_path"), F.lit("typescript").alias("language"), text.alias("text"))


RICH = "x as (select 'svc/' || p_partkey || '.ts' as file_path, p_partkey as k, p_partkey % 5 as m, p_partkey // 4 as e, p_partkey % 2 = 1 as odd, 'Svc' || p_partkey as c from part)"


def _rows(columns, *rows):
    return " union all ".join(f"select file_path, {', '.join(f'{value} as {name}' for name, value in zip(columns, row))} from x{' where ' + where if where else ''}" for *row, where in rows)


@query("ext_symbols_methods", f"with {RICH} " + _rows(("name", "kind", "exported", "line_start", "line_end"), ("c", "'class'", "true", 1, 9, ""), ("c || '.run'", "'method'", "true", 2, 7, ""), ("c || '.done'", "'method'", "odd", 8, 8, ""), ("'arrow' || k", "'function'", "true", 10, 10, ""), ("'listen' || k", "'function'", "false", 11, 11, "")))
def ext_symbols_methods(spark, sf_dir):
    """Classes with their methods, functions in constants."""
    return X.parsed(rich(spark, sf_dir))


@query("ext_symbol_edges_methods", f"with {RICH} " + _rows(("source", "target", "edge_type"), ("c", "'Base' || m", "'EXTENDS'", ""), ("c", "'One'", "'IMPLEMENTS'", ""), ("c", "'Two'", "'IMPLEMENTS'", ""), ("c", "c || '.run'", "'HAS_METHOD'", ""), ("c", "c || '.done'", "'HAS_METHOD'", ""), ("c || '.run'", "'load' || m", "'CALLS'", ""), ("c || '.run'", "'bus.emit'", "'CALLS'", ""), ("c || '.run'", "'items.map'", "'CALLS'", ""), ("c || '.run'", "'done'", "'CALLS'", ""), ("c || '.done'", "'save'", "'CALLS'", "odd"), ("'arrow' || k", "'wrap' || m", "'CALLS'", ""), ("'listen' || k", "'bus.on'", "'CALLS'", "")))
def ext_symbol_edges_methods(spark, sf_dir):
    """Heritage, methods, and calls of names that other files define."""
    return X.parsed(rich(spark, sf_dir), edges=True)


@query("ext_flow", f"with {RICH} " + _rows(("source", "target", "edge_type"), ("c || '.run'", "'load' || m", "'CONSUMES'", ""), ("c || '.run'", "'bus.emit'", "'CONSUMES'", ""), ("c || '.run'", "'handle' || m", "'TRIGGERS'", ""), ("c || '.run'", "c || '.run'", "'PRODUCES'", ""), ("'done'", "c || '.run'", "'DATA_FLOWS_TO'", ""), ("'load' || m", "'done'", "'DATA_FLOWS_TO'", ""), ("c || '.done'", "c || '.done'", "'PRODUCES'", ""), ("c || '.done'", "'save'", "'CONSUMES'", "odd"), ("'save'", "c || '.done'", "'DATA_FLOWS_TO'", "odd"), ("'arrow' || k", "'wrap' || m", "'CONSUMES'", "")) + " union all select a.file_path, a.c || '.run', 'onReady' || b.k, 'TRIGGERS' from x a join x b on a.e = b.e")
def ext_flow(spark, sf_dir):
    """Where data goes: what functions produce, take over from their parameters, hand on, and set off."""
    return X.flows(rich(spark, sf_dir))


@sql("ext_usage_type", "select id, 'call' as usage from code")
def ext_usage_type(spark, sf_dir):
    c = code(spark, sf_dir)
    line = F.element_at(F.split("text", "\n"), 5)
    return c.select("id", usage_type(F.regexp_replace(line, r"helper\d", "helper"), "helper").alias("usage"))


@sql("ext_grep", r""", w as (select id, unnest(regexp_extract_all(text, '[\w$]+')) as symbol from code) select symbol, count(distinct id)::bigint as files, count(*)::bigint as hits from w where regexp_matches(symbol, '^helper[0-6]$') group by symbol""")
def ext_grep(spark, sf_dir):
    """Word search of all symbols at once: words of all files joined with the symbols."""
    words = code(spark, sf_dir).select("id", F.explode(F.split("text", r"[^\w$]+")).alias("symbol"))
    symbols = spark.range(7).select(F.concat(F.lit("helper"), F.col("id").cast("string")).alias("symbol"))
    hits = words.join(symbols, "symbol").groupBy("symbol", "id").agg(F.count("*").alias("n"))
    return hits.groupBy("symbol").agg(F.count("*").alias("files"), F.sum("n").alias("hits"))


PAGES_SQL = r"""select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as href from pages"""


@query("ext_page_links", PAGES_SQL)
def ext_page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("href"))
