"""Decontamination, mixing, sharding, language, chat, WARC: brute force, round trips and edges."""

import base64
import hashlib
import io
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import uncontaminated
from lodestone.llm import chat, decontaminate, language, mixing, sharding, warc
from lodestone.llm.common import new_path

SF = "/root/testdata/sf0.01"


def oracle(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(map(tuple, con.execute(sql).fetchall()), key=str)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- decontamination


def distance(pattern, text):
    """Least edit distance of ``pattern`` to a substring of ``text``."""
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (p != t)))
        last = now
    return min(last)


def test_decontamination_as_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 25)))) for k in range(12)]
    docs = []
    for k in range(80):
        text = " ".join(word() for _ in range(30))
        if k % 2:
            body = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(body))
                body[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            text += "  " + "".join(body).upper() + ", " + " ".join(word() for _ in range(20))
        docs.append((k, text))
    want = set()
    for d, text in docs:
        for i, item in items:
            p, t = decontaminate.normalise(item), decontaminate.normalise(text)
            if (n := distance(f" {p} ", f" {t} ")) <= int(decontaminate.ERROR_RATE * len(p)):
                want.add((d, i, n))
    assert len(want) > 15
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(d, b).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {k for k, _ in docs} - {x[0] for x in want}


def test_decontamination_in_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "eins zwei drei vier fünf sechs sieben"), (2, None), (3, " ?! "), (4, "short one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha-beta, gamma delta EPSILON zeta y", 0), (None, "eins zwei drei vier fünf sechs sieben", 0), (2, None, 0), (3, "", 0), (4, "Short one!", 0), (5, "a short one here", 0)], "doc_id long, text string, end int")
    assert rows(decontaminate.matches(docs, items), "doc_id", "item_id", "distance") == sorted([(1, 1, 0), (None, 1, 0), (4, 4, 0), (5, 4, 0)], key=str)
    assert rows(decontaminate.clean(docs, items), "doc_id") == [(2,), (3,)]
    assert decontaminate.matches(docs, items.where("false")).count() == 0
    assert decontaminate.clean(docs.where("false"), items).count() == 0


def test_short_items_inside_documents(spark, tmp_path):
    """op3 and the pipeline find short items as whole words, edited ones within the budget too."""
    items = [(1, "short one"), (2, "art"), (3, "the capital of peru"), (4, "?"), (5, "Lima")]
    texts = ["a short one here", "party, arts; start", "State of the ART", "so the capitol of Peru is", "Lima", "limas", "is it Lima? yes", ""]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for d, text in enumerate(texts):
        for i, item in items:
            p, t = decontaminate.normalise(item), decontaminate.normalise(text)
            if p and (n := distance(f" {p} ", f" {t} ")) <= int(decontaminate.ERROR_RATE * len(p)):
                want.add((d, i, n))
    assert {(d, i) for d, i, _ in want} == {(0, 1), (2, 2), (3, 3), (4, 5), (6, 5)}
    found = decontaminate.op3_decontaminate(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want
    assert {(r.doc_id, r.end) for r in found} == {(0, 11), (2, 16), (3, 22), (4, 4), (6, 10)}
    assert {r.doc_id for r in uncontaminated(spark, docs, str(tmp_path)).collect()} == {1, 5, 7}


def test_recall_of_edited_passages():
    """Passages with up to a tenth of their characters edited are found, and as brute force measures them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 8)))
    items = tuple((k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(60))
    search = decontaminate.Items(tuple((str(k), t) for k, t in items), decontaminate.ERROR_RATE)
    for k, item in items:
        body = list(item)
        for at in rng.sample(range(len(body)), len(body) // 10):
            body[at] = rng.choice(["", "x", body[at] + "y"])
        text = f"{word()} {word()} {''.join(body)} {word()}"
        found = {int(i): n for i, n, _ in search.find(text)}
        assert k in found
        p, t = decontaminate.normalise(item), decontaminate.normalise(text)
        assert found[k] == distance(f" {p} ", f" {t} ")


def test_item_ids_of_any_type_and_long_documents(spark):
    filler = "lorem ipsum " * 100_000
    docs = spark.createDataFrame([("d", filler + "the capital of northern peru " + filler, 1, 2)], "doc_id string, text string, key int, distance int")
    items = spark.createDataFrame([("x", "The capital of northern Peru"), ("y", "The capital of northern Peru"), (None, "ipsum lorem")], "item_id string, text string")
    assert rows(decontaminate.matches(docs, items), "doc_id", "item_id", "distance") == sorted([("d", "x", 0), ("d", "y", 0), ("d", None, 0)], key=str)
    assert decontaminate.clean(docs, items).count() == 0


# --- mixing and sharding


def test_mixing_as_sql(spark):
    got = rows(mixing.op5_mixing(spark, SF), "doc_id", "size", "source_size", "target", "taken")
    assert got == oracle(mixing.OP5_SQL, "documents")
    by = {}
    for _, size, whole, target, taken in got:
        assert 0 <= taken <= 2 * size
        by.setdefault((whole, target), []).append(taken)
    assert all(sum(v) == int(target) for (_, target), v in by.items() if len(v) < 1000)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 9), (2, None, "x", 9), (None, "a b", None, 9), (None, "a b", None, 9), (3, "", "y", 9), (4, "a", "z", 9)], "doc_id long, text string, source string, size int")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 6 and {r.size for r in plan if r.row.doc_id in (2, 3)} == {0}
    assert sum(r.taken for r in plan) == sum({(r.row.source): int(r.target) for r in plan}.values())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.where("false")).count() == 0
    assert rows(mixing.mix(docs), "doc_id", "source") == rows(mixing.mix(docs.repartition(3)), "doc_id", "source")


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 40)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), (3, 2), 2).collect()}
    total, caps, weights = 1.5 * 1150, {"a": 20, "b": 200, "c": 2000, None: 80}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, free = {}, set(caps)
    while True:  # as told: share by weight, stop at the caps, share what is left again
        level = (total - sum(want.values())) / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > caps[s]}
        if not full:
            want |= {s: level * weights[s] for s in free}
            break
        want |= {s: float(caps[s]) for s in full}
        free -= full
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_lookup_table():
    names = tuple(f"s{k}" for k in range(7))
    table = sharding.lookup_table(names, 1009)
    counts = [table.count(k) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:6], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    # turn by turn, as told
    place = {}
    for name in names:
        d = hashlib.sha256(name.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % 1009, int.from_bytes(d[8:16], "big") % 1008 + 1
        place[name] = [(a + j * b) % 1009 for j in range(1009)]
    taken = {}
    while len(taken) < 1009:
        for k, name in enumerate(names):
            if len(taken) < 1009:
                taken[next(s for s in place[name] if s not in taken)] = k
    assert [taken[s] for s in range(1009)] == table
    for bad in (((), 7), (("a", "a"), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding(spark):
    docs = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (None, "c", None), (None, "d", None), (None, "c", None)], "doc_id long, text string, shard string")
    got = sharding.assign(docs).collect()
    table = sharding.lookup_table(sharding.SHARDS)
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "slot", "shard"}
    for r in got:
        if r.doc_id is not None:
            assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.shard == sharding.SHARDS[table[r.slot]]
    assert len({r.slot for r in got if r.doc_id is None}) == 2
    assert sharding.assign(docs.where("false")).count() == 0


# --- language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def parsed(text, sample):
    """Phrases of the longest-match parse, by plain search."""
    at = count = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


def test_suffix_automaton_and_phrases(monkeypatch):
    """Whole texts are parsed whatever the blocks: texts of the sample itself, foreign ones, empty ones."""
    monkeypatch.setattr(language, "BLOCK", 16)
    rng = random.Random(3)
    known = bytes(rng.choice(b"abcd") for _ in range(600))
    auto = language.Automaton(known)
    texts = [bytes(rng.choice(b"abcdx") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [known, known[100:400] * 2, b"", known[5:21], b"x" * 50, b"a" * 300]
    assert auto.phrases(*language.cut(texts)).tolist() == [parsed(x, known) for x in texts]


def test_language_as_brute_force(spark):
    """op6 on whole texts against plain search in the same samples."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.Model(dict(language.samples(docs)))
    samples = dict(zip(model.languages, model.known, strict=True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op6_language(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.orderBy("n_chars").limit(40).collect():
        data = language.plain(r.text or "")
        rates = {name: parsed(data, samples[name]) / norm for name, norm in zip(model.languages, model.norms, strict=True)}
        first, second = sorted(rates.values())[:2]
        if data.strip():
            assert got[r.doc_id] == (min(rates, key=lambda k: (rates[k], k)), pytest.approx(1 - first / max(second, 1e-9)))


def test_language_scripts_and_long_texts(spark):
    """Scripts side by side, thousands of different letters, very long texts, and columns of other names."""
    rng = random.Random(6)
    made = {
        "zh": lambda: "".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 3000) for _ in range(200)),
        "ru": lambda: " ".join("".join(rng.choice("оеаинтсрвлк") for _ in range(6)) for _ in range(40)),
        "el": lambda: " ".join("".join(rng.choice("αοιετσνηυρ") for _ in range(6)) for _ in range(40)),
        "en": lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(40)),
        "ja": lambda: "".join(chr(0x3041 + rng.randrange(80)) for _ in range(200)),
    }
    rows_in = [(k, made[name](), name) for k, name in enumerate(list(made) * 20)]
    rows_in.append((5000, " ".join(made["ru"]() for _ in range(1000)), "ru"))
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows_in], "doc_id long, text string, lang string, score double, lang_pred string")
    out = language.identify(docs.withColumn("held_out", language.held_out("doc_id")), language.samples(docs)).collect()
    assert [(r.doc_id, r.lang, r.lang_pred) for r in out if (r.held_out or r.doc_id == 5000) and r.lang_pred != r.lang] == []


def test_languages_in_passes(spark, monkeypatch):
    """Many languages take several passes, with the answers of one; too many different values are an error."""
    rng = random.Random(9)
    letters = {f"l{k}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for k in range(7)}
    rows_in = [(k, " ".join("".join(rng.choice(letters[name]) for _ in range(5)) for _ in range(30)), name) for k, name in enumerate(list(letters) * 8)]
    docs = spark.createDataFrame([*rows_in, (100, None, "l1"), (101, "12", None)], "doc_id long, text string, lang string")
    learned = language.samples(docs)
    one = sorted(map(tuple, language.identify(docs, learned).collect()), key=str)
    monkeypatch.setattr(language, "PASS_LANGUAGES", 3)
    assert sorted(map(tuple, language.identify(docs, learned).collect()), key=str) == one and len(learned) == 7
    monkeypatch.setattr(language, "MAX_LANGUAGES", 6)
    with pytest.raises(ValueError):
        language.samples(docs)


def test_language_samples_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text number {k}", "en") for k in range(500)] + [(3, "ein text", "de")], "doc_id long, text string, lang string")
    assert dict(language.samples(docs)) == {"en": "text number 0", "de": "ein text"}


def test_language_edges(spark):
    rows_in = [(k, "der hund und die katze laufen schnell " * 3, "de") for k in range(12)] + [(k, "the dog and the cat are running fast " * 3, "en") for k in range(12, 24)]
    docs = spark.createDataFrame([*rows_in, (90, None, "de"), (91, "", None), (92, "123 !?", "en"), (None, "the cat", None)], "doc_id long, text string, lang string")
    learned = language.samples(docs)
    assert [k for k, _ in learned] == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, learned).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0)
    assert got[3][0] == "de" and got[20][0] == "en" and got[None][0] == "en"
    assert {r.lang_pred for r in language.identify(docs, ()).collect()} == {"und"}
    assert language.samples(docs.where("false")) == () and language.identify(docs.where("false"), learned).count() == 0


# --- chat


def test_chat_as_sql(spark):
    columns = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(columns)} from ({chat.OP8_SQL})").fetchall()), key=str)
    assert rows(chat.op8_chat(spark, SF), *columns) == want


def test_chat_round_trip(spark):
    hard = ["<|turn|>user<|text|>x<|end|>\n", "\\", "\\\\<|", "<\\|end|>", "</s>[INST] <<SYS>> [/INST]", "", None, "$1 \\1", "<s><|", "a\nb"]
    rng = random.Random(4)
    hard += ["".join(rng.choice("<|>\\[]/INSTsé\n") for _ in range(30)) for _ in range(40)]
    turns = [(k // 7, k % 7, rng.choice(["user", "assistant", "system", "<|text|>", None]), t, 1) for k, t in enumerate(hard)] + [(None, None, "assistant", "lone", 1), (99, 1, "user", "q", 1), (99, 1, "user", "q", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n int")
    examples = chat.format_examples(df)
    told = {}
    for r in examples.where("final").select("conv_id", chat.read_turns(F.col("text")).alias("t")).collect():
        told[r.conv_id] = [(t.role, t.text) for t in r.t]
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        assert told[conv] == [(t[2] or "", t[3] or "") for t in mine]
    for r in examples.where("target is not null").collect():
        mine = told[r.conv_id][r.target - 1]
        assert mine[0] == "assistant"
        assert r.text[r.loss_end :] == chat.END
    assert examples.where("final").count() == len(told)
    assert chat.read_back(chat.format_examples(df.where("false"))).count() == 0


# --- WARC


def test_warc_as_sql(spark):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(columns)} from ({warc.OP2_SQL})").fetchall()), key=str)
    assert rows(warc.op2_warc(spark, SF), *columns) == want


def test_warc_edges(spark):
    pages = [(1, "u", None, 1), (2, "u", "", 1), (3, None, "abc", 1), (4, "x\r\nWARC-Type: y", "abc", 1), (4, "z", "abc", 1), (None, "q", "abc", 1), (7, "big", "é" * 3_000_000, 1), (8, "fake", "WARC/1.1\r\n\r\n\r\n", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    neat = warc.normalise_archives(warc.write_archives(df, new_path(spark, "raw")), new_path(spark, "neat"))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(neat).collect()}
    assert got == {(1, 0, "response", None), (2, 0, "revisit", 1), (3, 3, "response", None), (4, 3, "revisit", 3), (None, 3, "revisit", 3), (7, 6_000_000, "response", None), (8, 14, "response", None)}
    none = warc.normalise_archives(warc.write_archives(df.where("false"), new_path(spark, "raw")), new_path(spark, "neat"))
    assert warc.read_archives(none).count() == 0


def test_normaliser():
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    bodies = [b"a", b"", b"\r\n\r\n" * 9, bytes(range(256)) * 9000]
    whole = b"".join(warc.page_record(k, "u", x, digest(x), None) for k, x in enumerate(bodies))
    deflate = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    archive, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(deflate.compress(whole) + deflate.flush()), archive, index) == 4
    import json

    for k, line in enumerate(index.getvalue().splitlines()):
        entry = json.loads(line)
        member = archive.getvalue()[entry["offset"] : entry["offset"] + entry["length"]]
        (fields, block, raw), = warc.records(io.BytesIO(member))
        assert zlib.decompress(member, warc.GZIP) == raw
        assert warc.payload_of(fields, block) == (k, len(bodies[k]), digest(bodies[k]), "response", None)
    assert len(list(warc.records(io.BytesIO(archive.getvalue())))) == 4
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(archive.getvalue()[:-30])))
