"""Repair of conversation structure at least cost, by a fold in Spark SQL.

Rows ``conv_id, turn, role, text`` (other columns are ignored; nulls count as one space in ``role`` and ``text``).  Rows
are taken by turn, nulls first; rows of one turn by a digest of role and text, so that repeated rows are adjacent.
Role initials must come to read ``(s?(ua)+)?``.  Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (required of
blank rows and of those whose role and text were seen earlier), Insert of an empty user or assistant turn 2; a truncated
row that stays costs 1 more.

The structure is decided on light rows, without texts: equal rows are counted, dealt into ranges of (conversation, turn),
and flagged by windows.  Blocks of at most ``BLOCK`` rows are folded by ``aggregate()``, which carries for each state
(nothing yet, after s, after u, after a) the cheapest (cost, audit).  Two audits of equal cost over the same rows are
never prefixes of one another, since the letters determine the cost; so the least struct stays the least when both are
continued.  A block that does not begin its conversation is folded from each of the four states, and blocks are composed:
a conversation that holds a third of all rows is folded by many tasks.  Texts move once, to be written out in order.

Empty tables give no rows.  A conversation whose rows all go has an empty audit of D's and no repaired rows.  Very long
texts are digested where they are and stream through one row at a time.  Rows of a conversation pass one task as a stream
when they are written out, since its text is one sequence; the audit, a letter for each edit, is one value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ranges
from .common import cut, ship, slices

#: Rows of one fold.
BLOCK = 256
#: Costs of edits, states in the order of the fold.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
STATES = "esua"
UNREACHED = 10**15
BLANKS = " \t\n\x0b\x0c\r"
REPAIRED = "conv_id {conv}, pos long, role string, text string, edit string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(conv_id:turn) % 20, for tests of the repair.  Nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def prepared(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text and the digest ``key`` of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))


def light_rows(rows: DataFrame) -> DataFrame:
    """One row without its text for each different row, with its number ``n``: ``c`` is the role's initial."""
    body = F.rtrim("text", F.lit(BLANKS))
    mark = F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    light = rows.select("conv", "turn", "key", F.substring("role", 1, 1).alias("c"), mark.alias("mark"))
    return light.groupBy("conv", "turn", "key", "c", "mark").agg(F.count("*").alias("n"))


def flagged(light: DataFrame) -> DataFrame:
    """Light rows in blocks with their first fault; nothing is partitioned by a whole conversation.

    A row is the first of its kind if it is the first in its range and no earlier range has one: the second window sees
    one row for each range and kind, all others are dealt by salt.
    """
    dealt = ranges(light, "conv", F.col("turn").asc_nulls_first(), "key", part="part")
    # a conversation that goes on from the range before can only be the least of its range: one row a range, so bounded
    least = dealt.groupBy("part").agg(F.min(F.struct("conv")).alias("least"))
    order = [F.col("turn").asc_nulls_first(), "key"]
    run = Window.partitionBy("conv", "part").orderBy(*order)
    pair = F.concat(F.lag("c").over(run), "c")
    out = (
        dealt.join(F.broadcast(least), "part")
        .withColumn("at", F.row_number().over(run))
        .withColumn("illegal", (F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).cast("long") + F.col("n") - 1)
        .withColumn("new_turn", (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(run))).cast("long"))
        .withColumn("here", F.row_number().over(Window.partitionBy("conv", "part", "key").orderBy(F.col("turn").asc_nulls_first())))
        .withColumn("salt", F.when(F.col("here") == 1, -1).otherwise(F.pmod(F.xxhash64("turn", "part"), F.lit(4096))))
        .withColumn("there", F.row_number().over(Window.partitionBy("conv", "key", "salt").orderBy("part")))
    )
    first = (F.col("here") == 1) & (F.col("there") == 1)
    blank = F.col("mark") == "blank"
    starts = (F.col("at") <= BLOCK) & ~F.col("least.conv").eqNullSafe(F.col("conv"))
    return out.select(
        "conv", "part", F.floor((F.col("at") - 1) / BLOCK).alias("block"), "at", "turn", "c", "n", "illegal", "new_turn", starts.alias("starts"),
        (blank | ~first).alias("gone"), F.when(F.col("mark") == "truncated", TRUNCATED).otherwise(0).alias("extra"),
        F.when(blank, F.col("n")).otherwise(0).alias("blank"), F.when(blank, 0).when(first, F.col("n") - 1).otherwise(F.col("n")).alias("duplicate"),
        (first & (F.col("mark") == "truncated")).cast("long").alias("truncated"),
    )


def way(cost: Column | int, audit: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(cost).cast("long").alias("cost"), as_col(audit).alias("audit"))


def on(p: Column, cost: Column | int, letters: Column | str) -> Column:
    return way(p["cost"] + cost, F.concat(p["audit"], letters if isinstance(letters, Column) else F.lit(letters)))


def relaxed(x: Column) -> Column:
    """Inserts after an edit: of a user turn, an assistant turn, or both."""
    e, s, u, a = (x[k] for k in STATES)
    return F.struct(
        e.alias("e"), s.alias("s"), F.least(u, *(on(p, INSERT, "I") for p in (e, s, a))).alias("u"),
        F.least(a, on(u, INSERT, "I"), on(e, 2 * INSERT, "II"), on(s, 2 * INSERT, "II")).alias("a"),
    )


def bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.transform(F.array(x), f)[0]


def step(acc: Column, x: Column) -> Column:
    e, s, u, a = (acc[k] for k in STATES)
    c, stays, more = x["c"], ~x["gone"], x["n"] - 1
    copies = F.repeat(F.lit("D"), more.cast("int"))  # further copies of a row are always deleted
    drop = lambda p: on(p, DELETE * x["n"], F.concat(F.lit("D"), copies))
    keep = lambda p: on(p, KEEP + x["extra"] + DELETE * more, F.concat(F.lit("K"), copies))
    change = lambda p: on(p, REROLE + x["extra"] + DELETE * more, F.concat(F.lit("R"), copies))
    to_u = F.least(e, s, a)
    moved = F.struct(
        drop(e).alias("e"),
        F.least(drop(s), F.when(stays & (c == "s"), keep(e))).alias("s"),
        F.least(drop(u), F.when(stays & (c == "u"), keep(to_u)).when(stays, change(to_u))).alias("u"),
        F.least(drop(a), F.when(stays & (c == "a"), keep(u)).when(stays, change(u))).alias("a"),
    )
    return bound(moved, relaxed)


def start(state: str) -> Column:
    return relaxed(F.struct(*((way(0, "") if k == state else way(UNREACHED, "")).alias(k) for k in STATES)))


def blocks(rows: DataFrame) -> DataFrame:
    """Each block's cheapest (cost, audit) from each state it may begin in to each state it may end in."""
    grouped = rows.groupBy("conv", "part", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "c", "gone", "extra", "n"))).alias("turns"), F.min("starts").alias("starts"),
        F.min_by("c", "at").alias("first_c"), F.max_by("c", "at").alias("last_c"), F.min_by("turn", "at").alias("first_turn"), F.max_by("turn", "at").alias("last_turn"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("new_turn").alias("turns_seen"), F.sum("n").alias("n_rows"),
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")),
    )
    ways = F.when(F.col("starts"), F.array(start("e"))).otherwise(F.array(*(start(k) for k in STATES)))
    return grouped.withColumn("ways", F.transform(ways, lambda w: F.aggregate("turns", w, step))).drop("turns")


def composed(acc: Column, ways: Column) -> Column:
    def end(state: str) -> Column:
        found = []
        for i, k in enumerate(STATES):
            w = F.get(ways, F.lit(i))
            found.append(F.when(w.isNotNull(), on(acc[k], w[state]["cost"], w[state]["audit"])))
        return F.least(*found).alias(state)

    return F.struct(*(end(k) for k in STATES))


def structure(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``gaps`` counts numbers missing between the least and the largest turn (0 without turns), ``illegal`` the adjacent
    initials other than su, ua and au before the repair.
    """
    return decided(prepared(rows))


def decided(ready: DataFrame) -> DataFrame:
    found = blocks(flagged(light_rows(ready)))
    before = F.lag(F.struct("part", "last_c", "last_turn")).over(Window.partitionBy("conv").orderBy("part", "block"))
    across = F.col("before.part") != F.col("part")  # within a range the windows have seen it
    found = found.withColumn("before", before).select(
        "*", F.coalesce(across & ~F.concat("before.last_c", "first_c").isin("su", "ua", "au"), F.lit(False)).cast("long").alias("illegal_across"),
        F.coalesce(across & (F.col("before.last_turn") == F.col("first_turn")), F.lit(False)).cast("long").alias("seen_twice"),
    )
    per_conv = found.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("part", "block", "ways"))).alias("all"),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns_seen") + F.sum("seen_twice"), F.lit(0)).alias("gaps"),
        (F.sum("illegal") + F.sum("illegal_across")).alias("illegal"),
        *(F.sum(k).alias(k) for k in ("n_rows", "blank", "duplicate", "truncated")),
    )
    begin = F.struct(*((way(0, "") if k == "e" else way(UNREACHED, "")).alias(k) for k in STATES))
    best = F.aggregate("all", begin, lambda acc, b: composed(acc, b["ways"]), lambda acc: F.least(acc["e"], acc["a"]))
    return per_conv.withColumn("best", best).select(
        F.col("conv").alias("conv_id"), "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")
    )


def repair(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The repaired turns: conv_id, pos (from 0), role, text, edit (K, R or I), in order within each partition.

    ``plan`` is ``structure(rows)``, if it is there already.
    """
    ready = prepared(rows)
    plan = decided(ready) if plan is None else plan
    ship(rows.sparkSession)
    lines = plan.select(F.col("conv_id").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = lines.unionByName(ready.withColumn("audit", F.lit(None).cast("string")))
    dealt = lines.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "key")
    return dealt.select("conv", "audit", "role", "text").mapInArrow(written, REPAIRED.format(conv=rows.schema["conv_id"].dataType.simpleString()))


class Writer:
    """Follows one audit along the rows of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.pos = audit, 0, "e", 0

    def turn(self, letter: str, role: str, text: str) -> tuple[int, str, str, str]:
        if letter != "K":
            role = "assistant" if self.state == "u" else "user"
        self.state, self.pos = role[:1], self.pos + 1
        return self.pos - 1, role, text, letter

    def inserts(self) -> Iterator[tuple[int, str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.turn("I", "", "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self.turn(letter, role, text)


def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now, conv = ["conv_id", "pos", "role", "text", "edit"], None, None
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch(found: list) -> pa.RecordBatch:
        cols = list(zip(*found)) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names)

    for whole in batches:
        kinds[0] = whole.schema.field(0).type
        for part in slices(whole):
            found = []
            for of, audit, role, text in zip(*(part.column(i).to_pylist() for i in range(4))):
                if audit is not None:  # the next conversation
                    if now is not None:
                        found += [(conv, *t) for t in now.inserts()]
                    now, conv = Writer(audit), of
                else:
                    found += [(conv, *t) for t in now.row(role, text)]
            yield batch(found)
    if now is not None:
        yield batch([(conv, *t) for t in now.inserts()])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` lines; straight behind ``repair``, whose partitions are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, done, kind = None, None, [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=kind), pa.array([d[1] for d in done], type=pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for of, pos, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if pos == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = of, hashlib.sha256()
                sha.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
            if done:
                yield out()
                done = []
        if sha is not None:
            done.append((conv, sha.hexdigest()))
            yield out()

    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Every conversation with its faults after ``damage``, its cheapest repair and the digest of the repaired turns.

    Conversations of which no row is left have zeros, an empty audit and the digest of the empty string.
    """
    rows = damage(conversations)
    plan = cut(structure(rows))
    shas = digests(repair(rows, plan))
    convs = conversations.select("conv_id").distinct()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    named = plan.withColumnRenamed("conv_id", "p_id").join(shas.withColumnRenamed("conv_id", "s_id"), F.col("p_id").eqNullSafe(F.col("s_id")), "left")
    return convs.join(named, F.col("conv_id").eqNullSafe(F.col("p_id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )


#: The same result in SQL for DuckDB, over tables without different rows of one turn.
REPAIR_SQL = """
WITH RECURSIVE
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bits AS (SELECT i AS v, i, 0 AS n FROM range(256) AS r(i)
  UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i, n + 1 FROM bits WHERE n < 8),
bytes AS (SELECT i, v FROM bits WHERE n = 8),
crc AS (SELECT k, 0 AS p, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT k FROM base)
  UNION ALL SELECT k, p + 1, xor(c >> 8, v) FROM crc JOIN bytes ON i = xor(c & 255, ascii(k[p + 1])) WHERE p < length(k)),
kinds AS (SELECT k, xor(c, 4294967295) % 20 AS kind FROM crc WHERE p = length(k)),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM base JOIN kinds USING (k) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1] AS c FROM damaged),
faults AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open_end,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed),
turns AS (SELECT *, blank OR again AS gone, CASE WHEN open_end THEN 1 ELSE 0 END AS x FROM faults),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
  sum(CASE WHEN blank THEN 1 ELSE 0 END) AS blank, sum(CASE WHEN again AND NOT blank THEN 1 ELSE 0 END) AS duplicate,
  sum(CASE WHEN open_end AND NOT gone THEN 1 ELSE 0 END) AS truncated,
  sum(CASE WHEN pair NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM turns GROUP BY conv_id),
fold AS (
  SELECT conv_id, 0 AS i, {'cost': 0, 'audit': ''} AS e, {'cost': 1000000000, 'audit': ''} AS s, {'cost': 2, 'audit': 'I'} AS u, {'cost': 4, 'audit': 'II'} AS a FROM sums
  UNION ALL
  SELECT conv_id, i, e, s,
    least(u, {'cost': e.cost + 2, 'audit': e.audit || 'I'}, {'cost': s.cost + 2, 'audit': s.audit || 'I'}, {'cost': a.cost + 2, 'audit': a.audit || 'I'}),
    least(a, {'cost': u.cost + 2, 'audit': u.audit || 'I'}, {'cost': e.cost + 4, 'audit': e.audit || 'II'}, {'cost': s.cost + 4, 'audit': s.audit || 'II'})
  FROM (
    SELECT f.conv_id, t.i, {'cost': e.cost + 3, 'audit': e.audit || 'D'} AS e,
      least({'cost': s.cost + 3, 'audit': s.audit || 'D'}, CASE WHEN NOT gone AND c = 's' THEN {'cost': e.cost + x, 'audit': e.audit || 'K'} END) AS s,
      least({'cost': u.cost + 3, 'audit': u.audit || 'D'}, CASE WHEN NOT gone AND c = 'u' THEN {'cost': least(e, s, a).cost + x, 'audit': least(e, s, a).audit || 'K'}
        WHEN NOT gone THEN {'cost': least(e, s, a).cost + 2 + x, 'audit': least(e, s, a).audit || 'R'} END) AS u,
      least({'cost': a.cost + 3, 'audit': a.audit || 'D'}, CASE WHEN NOT gone AND c = 'a' THEN {'cost': u.cost + x, 'audit': u.audit || 'K'}
        WHEN NOT gone THEN {'cost': u.cost + 2 + x, 'audit': u.audit || 'R'} END) AS a
    FROM fold f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i + 1)),
best AS (SELECT f.conv_id, least(e, a).cost AS cost, least(e, a).audit AS audit, gaps, blank, duplicate, truncated, illegal
  FROM fold f JOIN sums s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.n),
letters AS (SELECT conv_id, p, audit[p] AS l, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS q
  FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS p)),
kept AS (SELECT l.conv_id, q, l, t.role, t.text, first_value(l.l = 'K' AND t.c = 's') OVER (PARTITION BY l.conv_id ORDER BY q) AS led
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND l.l <> 'I' WHERE l <> 'D'),
repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (q - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || coalesce(text, ''), chr(10) ORDER BY q)) AS sha FROM kept GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
