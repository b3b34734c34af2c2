"""Conversation structure repair: a generalised LR parse of each conversation's roles with edits.

The roles of a conversation shall be ``s? (ua)+`` or nothing (system, user, assistant).
The parser's states are the LR(0) states of that grammar, its stacks share their
lower parts, and every row advances all live stacks at once: it is kept, given
another role, or deleted, and turns may be inserted before it.  Stacks that
become equal are merged into the one with the least (cost, audit), where the audit
is the string of edit initials (Delete, Insert, Keep, Rerole).  Up to each row, audits
end with that row's letter, so none is the beginning of another and their order
settles ties for good: the live stacks are held in audit order, and no audit
string is built before the parse is done.

Scale: a conversation's rows lie in blocks of at most ``BLOCK`` rows, one byte a
row (role initial, faults).  Each block is parsed from every stack it could be entered
with; a fold over these small tables gives the stack between any two blocks,
and each block's edits follow on their own.  So a conversation that holds a third
of all rows is parsed by many tasks, and text is joined to the kept rows only at the end.

Input: ``conv_id`` (bigint), ``turn`` (bigint), ``role``, ``text``.  Rows are taken by
(turn, role, the text's SHA-256), nulls first.  Defined cases: a null role or
text is one space; a null conv_id is a conversation; a null turn comes first; a row that
repeats role and text of an earlier one is a duplicate; other columns are not
read; an empty table gives no rows; a conversation whose rows are all deleted has no turns.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.common import SPACE, stored
from quillrank.llm.ordering import PART_BITS, numbered

#: Rows of a block, at most; a task holds one block's edits.
BLOCK = 1 << 16
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: One stack can take up what another was to read for an Insert and a Delete, or for two Inserts.
SLACK = INSERT + DELETE
ROLES = {"s": "system", "u": "user", "a": "assistant"}
OTHER = "x"
CLASSES = "sua" + OTHER

#: The role grammar; C is its start symbol, lower-case symbols are role initials.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua"))


def _closure(items: set[tuple[int, int]]) -> frozenset:
    items = set(items)
    while True:
        heads = {GRAMMAR[p][1][dot] for p, dot in items if dot < len(GRAMMAR[p][1])}
        more = {(p, 0) for p, (head, _) in enumerate(GRAMMAR) if head in heads} - items
        if not more:
            return frozenset(items)
        items |= more


def _goto(state: frozenset, symbol: str) -> frozenset | None:
    moved = {(p, dot + 1) for p, dot in state if GRAMMAR[p][1][dot:dot + 1] == symbol}
    return _closure(moved) if moved else None


def _done(state: frozenset, start: bool):
    """The production that ends in this state: of the start symbol, or of another one."""
    return next((GRAMMAR[p] for p, dot in state if dot == len(GRAMMAR[p][1]) and (GRAMMAR[p][0] == "C") == start), None)


def _shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack after reading a role initial and reducing all that this completes."""
    state = _goto(stack[-1], symbol)
    if state is None:
        return None
    stack += (state,)
    while rule := _done(stack[-1], False):
        stack = stack[:len(stack) - len(rule[1])]
        stack += (_goto(stack[-1], rule[0]),)
    return stack


def _stacks() -> tuple[list[dict[str, int]], list[bool]]:
    """All stacks of the parser (few: the grammar is left-recursive): their moves, and whether a text may end there."""
    found = [(_closure({(p, 0) for p, (head, _) in enumerate(GRAMMAR) if head == "C"}),)]
    moves: list[dict[str, int]] = []
    for stack in found:
        moves.append({})
        for symbol in "sua":
            after = _shift(stack, symbol)
            if after is not None:
                if after not in found:
                    found.append(after)
                moves[-1][symbol] = found.index(after)
    return moves, [_done(stack[-1], True) is not None for stack in found]


MOVES, ENDS = _stacks()
#: A frontier is the tuple of live (stack, cost above the least) in the order of their audits.
START = ((0, 0),)


@lru_cache(maxsize=None)
def _inserts(stack: int) -> tuple[tuple[int, str], ...]:
    """(stack, roles inserted to get there); a stack is met once, as a longer way to it only costs more."""
    ways, at = [(stack, "")], 0
    while at < len(ways):
        here, roles = ways[at]
        at += 1
        for role in "ua":
            to = MOVES[here].get(role)
            if to is not None and all(to != w[0] for w in ways):
                ways.append((to, roles + role))
    return tuple(ways)


@lru_cache(maxsize=None)
def _edits(stack: int, code: int) -> tuple[tuple[int, int, str, str], ...]:
    """The ways over one row: (stack after, cost, letters, roles: inserted ones, then the row's own or a dash)."""
    initial, must_go, truncated = CLASSES[code >> 2], code >> 1 & 1, code & 1
    best: dict[int, tuple[int, str, str]] = {}
    for at, roles in _inserts(stack):
        cost, letters = INSERT * len(roles), "I" * len(roles)
        ways = [(at, cost + DELETE, letters + "D", roles + "-")]
        if not must_go:
            cost += TRUNCATED * truncated
            if initial in MOVES[at]:
                ways.append((MOVES[at][initial], cost, letters + "K", roles + initial))
            ways += [(MOVES[at][r], cost + REROLE, letters + "R", roles + r) for r in "ua" if r in MOVES[at]]
        for to, *way in ways:
            best[to] = min(best.get(to, tuple(way)), tuple(way))
    return tuple((to, *way) for to, way in best.items())


@lru_cache(maxsize=1 << 16)
def _advance(frontier: tuple, code: int) -> tuple[tuple, int, tuple]:
    """All live stacks over one row: the next frontier, what its least cost rose by, and (place before, letters, roles) of each."""
    best: dict[int, tuple] = {}
    for place, (stack, cost) in enumerate(frontier):
        for to, more, letters, roles in _edits(stack, code):
            way = (cost + more, place, letters, roles)
            best[to] = min(best.get(to, way), way)   # equal stacks are merged by least (cost, audit)
    least = min(way[0] for way in best.values())
    live = sorted((way[1], way[2], to, way[0] - least, way[3]) for to, way in best.items() if way[0] <= least + SLACK)
    return tuple((x[2], x[3]) for x in live), least, tuple((x[0], x[1], x[4]) for x in live)


def finish(frontier) -> tuple[int, str, int]:
    """The cheapest end of (stack, cost) in audit order: its place, the roles to insert at the end, its whole cost."""
    ways = [(cost + INSERT * len(roles), place, roles) for place, (stack, cost) in enumerate(frontier)
            for to, roles in _inserts(stack) if ENDS[to]]
    cost, place, roles = min(ways)
    return place, roles, cost


def cross(codes, entry: int) -> tuple[list[tuple[int, int]], list]:
    """A block from one stack: (stack, cost) at its end in audit order, and the way back of each row."""
    frontier, total, back = ((entry, 0),), 0, []
    for code in codes:
        frontier, more, ways = _advance(frontier, int(code))
        total += more
        back.append(ways)
    return [(stack, total + cost) for stack, cost in frontier], back


def edits_between(codes, entry: int, end: int) -> list[tuple[str, str]]:
    """(letters, roles) of each row of a block that is entered with one stack and left with another."""
    last, back = cross(codes, entry)
    place = next(i for i, (stack, _) in enumerate(last) if stack == end)
    found = []
    for ways in reversed(back):
        place, letters, roles = ways[place]
        found.append((letters, roles))
    return found[::-1]


def summary(codes) -> list[list[int]]:
    """[pairs of roles that may not follow each other, first class, last class], then for each entry stack: stack, cost, ..."""
    roles = [CLASSES[int(c) >> 2] for c in codes]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    rows = [[bad, CLASSES.index(roles[0]), CLASSES.index(roles[-1])]]
    return rows + [[x for pair in cross(codes, entry)[0] for x in pair] for entry in range(len(MOVES))]


def fold(summaries) -> tuple[int, int, str, list[tuple[int, int]]]:
    """A conversation's blocks in order: illegal pairs, cost, roles inserted at the end, (entry, end) stack of each block."""
    frontier, back, illegal, previous = [(0, 0)], [], 0, None
    for (bad, first, last), *tables in summaries:
        if previous is not None:
            illegal += CLASSES[previous] + CLASSES[first] not in ("su", "ua", "au")
        illegal, previous = illegal + int(bad), last
        best: dict[int, tuple[int, int, int]] = {}
        for place, (stack, cost) in enumerate(frontier):
            row = tables[stack]
            for rank in range(len(row) // 2):
                way = (cost + int(row[2 * rank + 1]), place, rank)
                to = int(row[2 * rank])
                best[to] = min(best.get(to, way), way)
        live = sorted((way[1], way[2], to, way[0]) for to, way in best.items())
        back.append([(place, to) for place, _, to, _ in live])
        frontier, before = [(to, cost) for _, _, to, cost in live], frontier
        back[-1] = [(place, before[place][0], to) for place, to in back[-1]]
    place, roles, cost = finish(frontier)
    path = []
    for ways in reversed(back):
        place, entry, end = ways[place]
        path.append((entry, end))
    return illegal, cost, roles, path[::-1]


def _faults(df: DataFrame) -> DataFrame:
    """Rows in order with their digest, role initial and faults; stored, without text."""
    bare = F.btrim(F.col("text"), F.lit(SPACE))
    rows = df.select("conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
                     (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    rows = numbered(rows, ["conv_id", "turn", "role", "digest"], "turns")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("first"))
    initial = F.left(F.col("role"), F.lit(1))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), initial), F.lit(len(CLASSES))) - 1
    rows = (rows.join(firsts, "_at", "left").withColumn("again", F.col("first").isNull() & ~F.col("blank"))
            .withColumn("truncated", F.col("cut") & F.col("first").isNotNull() & ~F.col("blank"))
            .withColumn("code", (place * 4 + F.when(F.col("blank") | F.col("again"), 2).otherwise(0)
                                 + F.when(F.col("truncated"), 1).otherwise(0)).cast("tinyint")))
    return stored(rows.drop("cut", "first"), "turn-faults")


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
_SUMMARY = T.ArrayType(T.ArrayType(_LONG))
_PATH = _record(illegal=_LONG, cost=_LONG, last=_STRING,
                blocks=T.ArrayType(_record(start=_LONG, rows=_LONG, entry=_INT, stop=_INT)))
_EDITS = _record(audit=_STRING, edits=T.ArrayType(_record(row=_INT, sub=_INT, action=_STRING, role=_STRING)))


@F.pandas_udf(_SUMMARY)
def _summary(codes: pd.Series) -> pd.Series:
    return codes.map(summary)


@F.pandas_udf(_PATH)
def _fold(blocks: pd.Series) -> pd.DataFrame:
    out = []
    for found in blocks:
        illegal, cost, last, path = fold(b["table"] for b in found)
        out.append((illegal, cost, last, [{"start": b["start"], "rows": b["rows"], "entry": e, "stop": s}
                                          for b, (e, s) in zip(found, path)]))
    return pd.DataFrame(out, columns=["illegal", "cost", "last", "blocks"])


@F.pandas_udf(_EDITS)
def _walk(codes: pd.Series, entry: pd.Series, stop: pd.Series) -> pd.DataFrame:
    out = []
    for block, first, last in zip(codes, entry, stop):
        found = edits_between(block, int(first), int(last))
        edits = [{"row": i, "sub": k, "action": a, "role": ROLES[r] if a in "IR" else None}
                 for i, (letters, roles) in enumerate(found) for k, (a, r) in enumerate(zip(letters, roles))]
        out.append(("".join(letters for letters, _ in found), edits))
    return pd.DataFrame(out, columns=["audit", "edits"])


def repair(df: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faults, audits, turns): each row's faults; a row per conversation with ``illegal``, ``cost`` and ``audit``;
    and the repaired turns (conv_id, _at, sub, action, role, text), to be read in the order of the first three.
    """
    df = df.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = _faults(df)
    place = F.col("_at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    blocks = (rows.groupBy("conv_id", F.shiftright("_at", PART_BITS).alias("part"), F.floor(place / block).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("_at", "code"))).alias("rows"))
              .select("conv_id", F.col("rows")[0]["_at"].alias("start"), F.col("rows")["code"].alias("codes")))
    blocks = stored(blocks.withColumn("table", _summary("codes")), "turn-blocks")
    paths = stored(blocks.groupBy("conv_id")
                   .agg(F.sort_array(F.collect_list(F.struct("start", F.size("codes").cast("bigint").alias("rows"), "table"))).alias("found"))
                   .select("conv_id", _fold("found").alias("path")).select("conv_id", "path.*"), "turn-paths")
    walked = (paths.select(F.explode("blocks").alias("b")).select("b.start", "b.entry", "b.stop")
              .join(blocks, "start").select("conv_id", "start", _walk("codes", "entry", "stop").alias("w")))
    walked = stored(walked.select("conv_id", "start", "w.*"), "turn-edits")
    texts = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "audit"))).alias("found"))
    joined = F.array_join(F.col("found")["audit"], "").alias("audit")
    audits = (texts.select("conv_id", joined).unionByName(paths.select("conv_id", "illegal", "cost", "last"), True)
              .groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"),
                                      F.concat(F.max("audit"), F.repeat(F.lit("I"), F.max(F.length("last")))).alias("audit")))
    edits = (walked.select("conv_id", "start", F.explode("edits").alias("e"))
             .select("conv_id", (F.col("start") + F.col("e.row")).alias("_at"), "e.sub", "e.action", F.col("e.role").alias("new_role")))
    ends = (paths.filter("last != ''").select("conv_id", "last", F.element_at("blocks", -1).alias("b"))
            .select("conv_id", (F.col("b.start") + F.col("b.rows")).alias("_at"), F.posexplode(F.split("last", "")).alias("sub", "r"))
            .select("conv_id", "_at", "sub", F.lit("I").alias("action"),
                    F.when(F.col("r") == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))
    added = (edits.filter("action = 'I'")
             .select("conv_id", "_at", "sub", "action", F.col("new_role").alias("role"), F.lit("").alias("text")))
    # rows that stay are the first of their (conv_id, role, text), so these three name them
    kept = (edits.filter("action IN ('K', 'R')").drop("conv_id").join(rows.select("_at", "conv_id", "role", "digest"), "_at"))
    held = (df.select("conv_id", "role", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
            .groupBy("conv_id", "role", "digest").agg(F.first("text").alias("text")))
    same = kept["conv_id"].eqNullSafe(held["conv_id"]) & (kept["role"] == held["role"]) & (kept["digest"] == held["digest"])
    stay = kept.join(held, same).select(kept["conv_id"], "_at", "sub", "action",
                                        F.coalesce(kept["new_role"], kept["role"]).alias("role"), held["text"])
    return rows, audits, stay.unionByName(added).unionByName(ends)


def digests(turns: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's ``role:text`` lines.

    One digest is one sequence of bytes, so one task streams a conversation's turns, sorted, and holds a batch of them.
    """
    def run(batches):
        at, sha = (), None
        for batch in batches:
            ids, done = batch.column("conv_id").to_pylist(), []
            for conv, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if (conv,) != at:
                    if at:
                        done.append((at[0], sha.hexdigest()))
                    at, sha = (conv,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield _hashes(done)
        if at:
            yield _hashes([(at[0], sha.hexdigest())])

    rows = turns.select("conv_id", "_at", "sub", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "_at", "sub")
    return rows.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _hashes(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())],
                                      names=["conv_id", "repaired_sha256"])


def damaged(df: DataFrame) -> DataFrame:
    """The conversations as the query's contract damages them, by the CRC-32 of ``conv_id:turn``."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def report(original: DataFrame, df: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per conversation of ``original`` on the repair of ``df``: gaps, faults, cost, audit and the result's digest."""
    rows, audits, turns = repair(df, block)
    counts = rows.groupBy("conv_id").agg(*(F.sum(F.col(c).cast("bigint")).alias(n) for c, n in
                                           (("blank", "blank"), ("again", "duplicate"), ("truncated", "truncated"))))
    wide = F.col("turn").cast("decimal(38,0)")
    gaps = (rows.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
            .groupBy("conv_id").agg((F.max(wide) - F.min(wide) + 1 - F.count("one")).try_cast("bigint").alias("gaps")))
    parts = [original.select("conv_id").distinct(), counts, gaps, audits, digests(turns)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    number = [F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.groupBy("conv_id").agg(
        *number, F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of the damaged conversations: one row per original conv_id."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(table, damaged(table))
