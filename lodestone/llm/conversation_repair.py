"""Repair of the structure of conversations by a fold in Spark SQL.

Faults of turns are flagged by windows. The turns of a conversation are collected as sorted structs, and
``aggregate()`` carries the cheapest (cost, edits) of four states over them: nothing yet, after a system
turn, after a user turn, after an assistant turn. ``least`` over such structs picks the cheaper way and,
of equally cheap ones, the one whose edits come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as space: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Cost of an edit, and of keeping a turn that was cut off.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
STATE = "struct<cost:bigint,edits:string>"


def _plus(state: Column, cost: Column | int, edit: str) -> Column:
    """``state`` after one more edit; null (not reachable) stays null."""
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["edits"], F.lit(edit)).alias("edits")))


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _inserted(at: Column, body) -> Column:
    """``body`` of the states after the cheapest insertions, if any."""
    user = F.least(at["user"], _plus(F.least(at["none"], at["system"], at["assistant"]), INSERT, "Iu"))
    with_user = F.struct(at["none"].alias("none"), at["system"].alias("system"), user.alias("user"), at["assistant"].alias("assistant"))

    def then_assistant(x: Column) -> Column:
        assistant = F.least(x["assistant"], _plus(x["user"], INSERT, "Ia"))
        return _with(F.struct(x["none"].alias("none"), x["system"].alias("system"), x["user"].alias("user"), assistant.alias("assistant")), body)

    return _with(with_user, then_assistant)


def cheapest_edits(turns: Column) -> Column:
    """The (cost, edits) that give ``turns``, structs of (initial, gone, extra), the role initials
    ``(s?(ua)+)?`` at the least cost.

    A turn is kept (K), rerolled to user or assistant (R) or deleted (D); ``gone`` ones must be deleted,
    and ``extra`` is what it costs not to. Turns may be inserted (I). ``edits`` has two characters for an
    edit: its letter, and the initial of the role of the turn that it leaves (``-`` where none). Edits
    that begin with the same letters leave the same roles, so both orders, by letters and by pairs,
    agree; and since the edits tell the cost, no two equally cheap ways are prefixes of one another, so
    the least of each state is all that the least of the whole needs.
    """
    none = F.lit(None).cast(STATE)
    begin = F.struct(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("edits")).cast(STATE).alias("none"), none.alias("system"), none.alias("user"), none.alias("assistant"))

    def turn(at: Column, row: Column) -> Column:
        stays, role = ~row["gone"], row["initial"]

        def step(x: Column) -> Column:
            before_user = F.least(x["none"], x["system"], x["assistant"])
            kept = lambda state, cond, edit: F.when(stays & cond, _plus(state, row["extra"], edit))
            rerolled = lambda state, edit: F.when(stays, _plus(state, row["extra"] + REROLE, edit))
            return F.struct(
                _plus(x["none"], DELETE, "D-").alias("none"),
                F.least(_plus(x["system"], DELETE, "D-"), kept(x["none"], role == "s", "Ks")).alias("system"),
                F.least(_plus(x["user"], DELETE, "D-"), kept(before_user, role == "u", "Ku"), rerolled(before_user, "Ru")).alias("user"),
                F.least(_plus(x["assistant"], DELETE, "D-"), kept(x["user"], role == "a", "Ka"), rerolled(x["user"], "Ra")).alias("assistant"),
            )

        return _inserted(at, step)

    return F.aggregate(turns, begin, turn, lambda at: _inserted(at, lambda x: F.least(x["none"], x["assistant"])))


def repaired_turns(turns: Column, edits: Column) -> Column:
    """The (role, text) turns that ``edits`` leave of ``turns``, structs with role and text."""
    named = lambda letter: F.when(letter == "u", "user").otherwise("assistant")
    # the edits of each turn: insertions before it, and its own; then insertions at the end
    parts = F.regexp_extract_all(edits, F.lit("(?:I.)*[KRD].|(?:I.)+$"), F.lit(0))

    def left(part: Column, k: Column) -> Column:
        new = F.transform(F.regexp_extract_all(part, F.lit("I(.)"), F.lit(1)), lambda r: F.struct(named(r).alias("role"), F.lit("").alias("text")))
        own, row = F.substring(part, -2, 1), F.get(turns, k)
        role = F.when(own == "K", row["role"]).otherwise(named(F.right(part, F.lit(1))))
        return F.concat(new, F.when(own.isin("K", "R"), F.array(F.struct(role.alias("role"), row["text"].alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>")))

    return F.flatten(F.transform(parts, left))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """One row per conversation: id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    Turns are ordered by turn number (null first), then role and text; repeated rows are turns of their
    own, adjacent ones. Of each turn the first fault counts: blank (nothing but space), duplicate (role and
    text occurred before), truncated (doesn't end in ``.``, ``!`` or ``?``). ``illegal`` counts adjacent
    turns whose role initials are not su, ua or au; ``gaps`` the missing numbers between the least and the
    greatest. ``audit`` has the letters of the cheapest edits (``cheapest_edits``), ASCII-least of equal
    ones, ``turns`` what they leave as (role, text).

    Null roles and texts are one space: such a role is never legal, such a text blank. Rows with a null id
    are one conversation. Rows in which ``absent_col`` is true stand for no turn; a conversation of such
    rows only has zeros, an empty audit and no turns. Other columns are not read; an empty table gives
    an empty result. A conversation is one row while it is folded, as the method has it.
    """
    absent = F.coalesce(F.col(absent_col), F.lit(False)) if absent_col else F.lit(False)
    base = rows.select(F.col(id_col).alias("id"), absent.alias("absent"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    ordered = Window.partitionBy("id").orderBy("absent", "turn", "role", "text")
    same = Window.partitionBy("id", "role", "text").orderBy("absent", "turn")
    shown = F.rtrim("text", F.lit(WHITE))
    base = base.withColumn("initial", F.substring("role", 1, 1))
    base = base.withColumn("before", F.lag("initial").over(ordered)).withColumn("nth", F.row_number().over(same))
    fault = F.when(shown == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(shown, F.lit(1)).isin(*ENDS), "truncated").otherwise("")
    flagged = base.withColumn("fault", fault).withColumn("illegal", F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au"))
    one = F.when(~F.col("absent"), F.struct("turn", "role", "text", "nth", "fault", "illegal", "initial"))
    talks = flagged.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    count = lambda fault: F.size(F.filter("all", lambda x: x["fault"] == fault)).cast("long").alias(fault)
    numbers = F.filter("all.turn", lambda x: x.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    told = F.transform("all", lambda x: F.struct(x["initial"].alias("initial"), x["fault"].isin("blank", "duplicate").alias("gone"), F.when(x["fault"] == "truncated", CUT).otherwise(0).cast("long").alias("extra")))
    talks = talks.select(
        "id",
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *map(count, ("blank", "duplicate", "truncated")),
        F.size(F.filter("all", lambda x: x["illegal"])).cast("long").alias("illegal"),
        cheapest_edits(told).alias("way"),
        "all",
    )
    return talks.select(
        F.col("id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"),
        F.regexp_replace("way.edits", "(.).", "$1").alias("audit"), repaired_turns(F.col("all"), F.col("way.edits")).alias("turns"),
    )


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` (id, turn, role, text, absent) with faults planted by crc32 of ``id:turn``, modulo 20: 0 drops
    a row (it stays as an absent one, which names its conversation), 1 empties its text, 2 takes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told(id_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    base = rows.select(F.col(id_col), F.col(turn_col), told(role_col).alias(role_col), told(text_col).alias(text_col), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col(role_col))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    out = base.select(id_col, turn_col, role.alias(role_col), text.alias(text_col), (F.col("kind") == 0).alias("absent"), copies.alias("copies"))
    return out.select(id_col, turn_col, role_col, text_col, "absent", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    found = repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), absent_col="absent")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("turns")


OP13_SQL = r"""
with recursive bits(n, k, c) as (
  select range, 0, range from range(256)
  union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by n) as tab from bits where k = 8),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as codes
  from conversations),
drawn as (
  select conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 20 as kind
  from keyed cross join crc),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from drawn, lateral (select unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end))) where kind <> 0),
counted as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth from damaged),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as k,
         lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, nth) as before
  from counted),
flagged as (
  select *, left(role, 1) as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
         before is not null and before || left(role, 1) not in ('su', 'ua', 'au') as illegal
  from placed),
talks as (select conv_id, row_number() over () as talk from (select distinct conv_id from conversations)),
turns as (
  select t.talk, f.k, f.initial, f.fault in ('blank', 'duplicate') as gone, case when f.fault = 'truncated' then 3 else 0 end as extra, f.role, f.text
  from flagged f join talks t on f.conv_id is not distinct from t.conv_id),
-- states: nothing, system, user, assistant; u1 and a1 are those after insertions
fold(talk, k, n, s, u, a) as (
  select talk, 0::bigint, {'c': 0, 'e': ''}, null::struct(c int, e varchar), null::struct(c int, e varchar), null::struct(c int, e varchar) from talks
  union all
  select talk, k, case when n is null then null else {'c': n.c + 4, 'e': n.e || 'D-'} end,
         list_min([case when s is not null then {'c': s.c + 4, 'e': s.e || 'D-'} end,
                   case when n is not null and not gone and initial = 's' then {'c': n.c + extra, 'e': n.e || 'Ks'} end]),
         list_min([case when u1 is not null then {'c': u1.c + 4, 'e': u1.e || 'D-'} end,
                   case when b is not null and not gone and initial = 'u' then {'c': b.c + extra, 'e': b.e || 'Ku'} end,
                   case when b is not null and not gone then {'c': b.c + extra + 3, 'e': b.e || 'Ru'} end]),
         list_min([case when a1 is not null then {'c': a1.c + 4, 'e': a1.e || 'D-'} end,
                   case when u1 is not null and not gone and initial = 'a' then {'c': u1.c + extra, 'e': u1.e || 'Ka'} end,
                   case when u1 is not null and not gone then {'c': u1.c + extra + 3, 'e': u1.e || 'Ra'} end])
  from (select *, list_min([n, s, a1]) as b
        from (select *, list_min([a, case when u1 is not null then {'c': u1.c + 3, 'e': u1.e || 'Ia'} end]) as a1
              from (select talk, k, n, s, a, initial, gone, extra,
                           list_min([u, case when o is not null then {'c': o.c + 3, 'e': o.e || 'Iu'} end]) as u1
                    from (select f.talk, t.k, f.n, f.s, f.u, f.a, list_min([f.n, f.s, f.a]) as o, t.initial, t.gone, t.extra
                          from fold f join turns t on t.talk = f.talk and t.k = f.k + 1))))),
ends as (select f.* from fold f join (select talk, max(k) as k from fold group by talk) m using (talk, k)),
best as (
  select talk, list_min([n, a, case when u is not null then {'c': u.c + 3, 'e': u.e || 'Ia'} end,
                         case when s is not null then {'c': s.c + 6, 'e': s.e || 'IuIa'} end]) as way
  from ends),
parts as (
  select talk, unnest(regexp_extract_all(way.e, '(I.)*[KRD].|(I.)+$')) as part, generate_subscripts(regexp_extract_all(way.e, '(I.)*[KRD].|(I.)+$'), 1) as k from best),
lines as (
  select p.talk, p.k, replace(replace(regexp_replace(part, '[KRD].$', ''), 'Iu', 'user:' || chr(10)), 'Ia', 'assistant:' || chr(10)) ||
         case when part[-2] = 'K' then t.role || ':' || t.text || chr(10)
              when part[-2] = 'R' then case part[-1] when 'u' then 'user:' else 'assistant:' end || t.text || chr(10) else '' end as line
  from parts p left join turns t on t.talk = p.talk and t.k = p.k),
repaired as (select talk, string_agg(line, '' order by k) as told from lines group by talk),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal
  from flagged group by conv_id)
select t.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, way.c::bigint as cost,
       regexp_replace(way.e, '(.).', '\1', 'g') as audit,
       sha256(case when coalesce(told, '') = '' then '' else told[:-2] end) as repaired_sha256
from talks t join best using (talk) left join counts c on c.conv_id is not distinct from t.conv_id left join repaired using (talk)
"""
