"""Conversation repair against a search over all edits, its SQL, and edges."""

import hashlib
import heapq
import random
import zlib

import duckdb

from lodestone.llm.conversation_repair import OP13_SQL, damage, op13_conversation_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def faults(turns):
    """The turns in order with the first fault of each."""
    turns = sorted(((t is not None, t or 0, r or " ", x or (" " if x is None else "")) for t, r, x in turns))
    seen, out = set(), []
    for _, _, role, text in turns:
        shown = text.strip(WHITE)
        kind = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def search(turns):
    """(cost, audit, texts) of the cheapest edits, ASCII-least, by uniform-cost search over whole edit strings."""
    queue, done = [(0, "", 0, "", ())], set()
    best = None
    while queue:
        cost, audit, k, last, kept = heapq.heappop(queue)
        if best and cost > best[0]:
            break
        if (audit, k, last) in done:
            continue
        done.add((audit, k, last))
        if k == len(turns) and last in ("", "a"):
            best = min(best or (cost, audit, kept), (cost, audit, kept))
            continue
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if len(audit) < 3 * len(turns) + 4:
            for r in after.replace("s", ""):
                heapq.heappush(queue, (cost + 3, audit + "I", k, r, (*kept, ({"u": "user", "a": "assistant"}[r], ""))))
        if k < len(turns):
            role, text, kind = turns[k]
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, last, kept))
            if kind not in ("blank", "duplicate"):
                extra = 3 * (kind == "truncated")
                if role[:1] and role[:1] in after:
                    heapq.heappush(queue, (cost + extra, audit + "K", k + 1, role[:1], (*kept, (role, text))))
                for r in after.replace("s", ""):
                    heapq.heappush(queue, (cost + 3 + extra, audit + "R", k + 1, r, (*kept, ({"u": "user", "a": "assistant"}[r], text))))
    return best


def test_repair_as_search(spark):
    rng = random.Random(7)
    talks = {}
    for c in range(150):
        n = rng.randint(0, 5)
        talks[c] = [(rng.choice([None, *range(4)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "cut", " \t", "", None, "Ends? ", "a\nb"])) for _ in range(n)]
    rows = [(c, *t) for c, turns in talks.items() for t in turns]
    frame = spark.createDataFrame([(*r, False) for r in rows] + [(c, None, None, None, True) for c in talks], SCHEMA + ", gone boolean")
    found = {r["conv_id"]: r for r in repair(frame, absent_col="gone").collect()}
    assert set(found) == set(talks)
    for c, turns in talks.items():
        told = faults(turns)
        cost, audit, kept = search(told)
        row = found[c]
        assert (row["cost"], row["audit"], tuple(map(tuple, row["turns"]))) == (cost, audit, kept), (c, told)
        kinds = [k for _, _, k in told]
        assert [row[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        initials = [r[:1] for r, _, _ in told]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = {t for t, _, _ in turns if t is not None}
        assert row["gaps"] == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)


def test_query_as_sql_on_edges(spark, tmp_path):
    """Null ids, turns, roles and texts, repeated rows, ties, a long text, an extra column, conversations that lose all rows."""
    lost = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, 0, "user", "x" * 100_000), (1, 0, "user", "x" * 100_000), (1, 0, "assistant", "Tie."), (2, 5, "system", "S."), (2, 9, "user", "Q?"), (lost, 0, "user", "gone."), (3, 0, "assistant", None), (4, 0, "", "no role.")]
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", cost int").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = op13_conversation_repair(spark, str(tmp_path))
    cursor = con.execute(OP13_SQL)
    assert [d[0] for d in cursor.description] == found.columns
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(map(tuple, cursor.fetchall()), key=str) and len(got) == 6
    assert (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_damage_and_empty(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)]
    found = damage(spark.createDataFrame(rows, SCHEMA)).collect()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        mine = [tuple(r)[2:] for r in found if (r["conv_id"], r["turn"]) == (c, t)]
        want = ("user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text, kind == 0)
        assert mine == [want] * (2 if kind == 3 else 1)
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000) if t != 1501]
    row = repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row["cost"], row["gaps"], row["illegal"], len(row["turns"])) == (3, 1, 1, 3000)
    assert row["audit"] == "K" * 1501 + "I" + "K" * 1498
