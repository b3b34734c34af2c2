"""Quotation linking: reply-ordered conversations from messages that quote each other.

A message's lines have a quote level (the number of leading ``>``).  A run of
lines of one level is a passage.  Passages are normalised (case, marks, white
space) and hashed; so are each message's own words, as a whole and line by line.
A quoted passage links to the earliest earlier message that holds it as its own,
in the same thread if there is one, else in a thread before.  A part of a message
is held, too, if its lines or its sentences (however they are wrapped) stand there in
succession; it counts where no message of the thread holds the passage whole.  Joins are on
hashes whose holders are reduced to the earliest first, so a passage that a third
of all messages hold costs one row.  A message answers the message of its first
linked passage of the lowest level.  Following the answers (pointer doubling)
gives each message its conversation and its depth; sorting by ``root_thread,
root_pos, depth, thread, pos`` reads the conversations in reply order, and
``own_text`` is without quotes and attribution lines.

Input: ``thread`` (bigint), ``pos`` (bigint), ``text``.  Order is (thread, pos),
nulls first, then ``msg``, a digest of the three.  Defined cases: null and empty
texts are the same and have no passages; rows that repeat all three are one
message; messages that share a (thread, pos), like regenerated answers, are each
kept, and none of them is earlier than another; an empty table gives no rows; a
passage without a letter or digit is not linked.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import map_slices, stored

_LEVEL = re.compile(r"[ \t]?((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"^.{0,300}\b(?:wrote|schrieb|a écrit|escribió) ?:\s*$", re.I)
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"(?<=[.!?…])\s+|\n\s*\n")
_KEY = ("thread", "pos", "msg")


def levels(text: str) -> list[tuple[int, str]]:
    """The passages of a text in order: level and lines; attribution lines before a deeper passage are left out."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _LEVEL.match(line)
        level, rest = (m.group(1).count(">"), line[m.end():]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    for (level, lines), (after, _) in zip(out, out[1:]):
        while after > level and lines and not lines[-1].strip():
            lines.pop()
        if after > level and lines and _ATTRIBUTION.match(lines[-1]):
            lines.pop()
    return [(level, "\n".join(lines)) for level, lines in out]


def normal(passage: str) -> str:
    return " ".join(_WORD.findall(passage.lower()))


def digest(passage: str) -> bytes | None:
    form = normal(passage)
    return hashlib.blake2b(form.encode(), digest_size=16).digest() if form else None


def units(text: str) -> tuple[list[str], list[str]]:
    """The normal forms of a text's lines and of its sentences that have a word."""
    return tuple([n for x in own if (n := normal(x))] for own in (text.split("\n"), _STOP.split(text)))


def parse(messages: DataFrame) -> DataFrame:
    """thread, pos, msg, own_text, own (hashes of the whole and of each line), quoted (place, level, hash, and in
    lines and in sentences the first one's hash and their number)."""
    starts = pa.list_(pa.struct([("by", pa.int32()), ("first", pa.binary()), ("n", pa.int32())]))
    entry = pa.list_(pa.struct([("place", pa.int32()), ("level", pa.int32()), ("hash", pa.binary()), ("starts", starts)]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, owns, quotes = [], [], []
        for text in batch.column("text").to_pylist():
            parts = levels(text or "")
            own = "\n".join(p for level, p in parts if level == 0).strip()
            texts.append(own)
            owns.append(sorted({h for x in [own, *own.split("\n"), *(p for level, p in parts if level == 0)] if (h := digest(x))}))
            quotes.append([{"place": k, "level": level, "hash": h, "starts": [{"by": by, "first": digest(own[0]), "n": len(own)} for by, own in enumerate(units(p))]} for k, (level, p) in enumerate(parts) if level and (h := digest(p))])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(texts, pa.string()),
                                           pa.array(owns, pa.list_(pa.binary())), pa.array(quotes, entry)],
                                          [*_KEY, "own_text", "own", "quoted"])

    return map_slices(messages.select(*_KEY, "text"), run,
                      "thread bigint, pos bigint, msg binary, own_text string, own array<binary>, "
                      "quoted array<struct<place:int,level:int,hash:binary,starts:array<struct<by:int,first:binary,n:int>>>>")


def _earlier(a, b):
    """Whether a place is before another, nulls first."""
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def _holders(quoted: DataFrame, held: DataFrame) -> DataFrame:
    """``quoted`` with the earliest earlier holder of each passage in its thread (``inside``) and in a thread before (``before``), or null."""
    here = held.groupBy("thread", "hash").agg(F.min(F.struct("pos", "msg")).alias("at"))
    first = here.groupBy(F.col("hash").alias("f_hash")).agg(F.min(F.struct("thread", "at")).alias("first"))
    here = here.select(F.col("thread").alias("h_thread"), F.col("hash").alias("h_hash"), "at")
    found = quoted.join(here, F.col("thread").eqNullSafe(F.col("h_thread")) & (F.col("hash") == F.col("h_hash")), "left").join(
        first, F.col("hash") == F.col("f_hash"), "left")
    inside = F.when(F.col("at").isNotNull() & _earlier(F.col("at.pos"), F.col("pos")), F.struct("thread", "at.pos", "at.msg"))
    before = F.when(F.col("first").isNotNull() & _earlier(F.col("first.thread"), F.col("thread")),
                    F.struct(F.col("first.thread").alias("thread"), F.col("first.at.pos").alias("pos"), F.col("first.at.msg").alias("msg")))
    return found.select(*quoted.columns, inside.alias("inside"), before.alias("before"))


def _parts(parsed: DataFrame, loose: DataFrame) -> DataFrame:
    """thread, pos, msg and hash of the runs of own lines or sentences that begin like one of the ``loose`` passages and are as long."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(m, by, at, digest(u)) for m, t in zip(batch.column("msg").to_pylist(), batch.column("text").to_pylist())
                for by, own in enumerate(units(t)) for at, u in enumerate(own)]
        types = {"msg": pa.binary(), "by": pa.int32(), "at": pa.int32(), "first": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], list(types))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            own = units(text)
            hashes.append(list({digest(" ".join(own[r["by"]][r["at"]:r["at"] + r["n"]])) for r in runs if r["at"] + r["n"] <= len(own[r["by"]])}))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(hashes, pa.list_(pa.binary()))], [*_KEY, "own"])

    texts = parsed.select(*_KEY, F.col("own_text").alias("text"))
    needs = loose.select(F.inline("starts")).distinct()
    begun = map_slices(texts.select("msg", "text"), run, "msg binary, by int, at int, first binary").join(needs, ["by", "first"])
    runs = begun.groupBy("msg").agg(F.collect_set(F.struct("by", "at", "n")).alias("runs"))
    own = map_slices(texts.join(runs, "msg"), cut, "thread bigint, pos bigint, msg binary, own array<binary>")
    return own.select(*_KEY, F.explode("own").alias("hash"))


def link(parsed: DataFrame) -> DataFrame:
    """msg, n_linked and the answered message (up_thread, up_pos, up_msg), for messages with a linked passage."""
    found = stored(_holders(parsed.select(*_KEY, F.inline("quoted")), parsed.select(*_KEY, F.explode("own").alias("hash"))), "passages")
    loose = found.where(F.col("inside").isNull())
    place = ["msg", "level", "place"]
    linked = found.select(*place, F.col("inside").alias("up"))
    if not loose.isEmpty():
        again = _holders(loose.drop("inside").withColumnRenamed("before", "whole"), _parts(parsed, loose))
        linked = linked.unionAll(again.select(*place, F.coalesce("inside", F.least("whole", "before"))))
    linked = linked.where(F.col("up").isNotNull())
    best = linked.groupBy("msg").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "place", "up")).alias("best"))
    return best.select("msg", "n_linked", *(F.col(f"best.up.{c}").alias(f"up_{c}") for c in _KEY))


def conversations(messages: DataFrame) -> DataFrame:
    """Every distinct message once, with what it answers, its conversation (root), its depth there and its own text."""
    one = messages.select("thread", "pos", F.coalesce("text", F.lit("")).alias("text")).distinct()
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("thread", "pos")), "text")
    parsed = stored(parse(one.withColumn("msg", F.unhex(F.substring(F.sha2(key, 256), 1, 32)))), "messages")
    links = stored(parsed.select(*_KEY, F.size("quoted").alias("n_quotes")).join(link(parsed), "msg", "left"), "replies")
    answers = links.select(*_KEY, "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
                           *(F.col(f"up_{c}").alias(f"reply_{c}") for c in _KEY))
    # Pointer doubling: each round follows an answer's own pointer, so a chain of n messages takes log2(n) rounds.
    up = F.struct(*(F.col(f"up_{c}").alias(c) for c in _KEY))
    ahead = links.where(F.col("up_msg").isNotNull()).select("msg", up.alias("up"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        onward = ahead.select(F.col("msg").alias("at"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        joined = ahead.join(onward, F.col("up.msg") == F.col("at"), "left")
        ahead = stored(joined.select("msg", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
                                     F.col("up2").isNotNull().alias("moved")), "reply-chains")
        moved = ahead.where("moved").isEmpty()
        ahead = ahead.drop("moved")
        if moved:
            break
    rooted = answers.join(ahead, "msg", "left").withColumn("root", F.coalesce("up", F.struct(*_KEY))).join(parsed.select("msg", "own_text"), "msg")
    return rooted.select("thread", "pos", "reply_thread", "reply_pos", F.col("root.thread").alias("root_thread"), F.col("root.pos").alias("root_pos"),
                         F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "n_quotes", "n_linked", "own_text",
                         *(F.lower(F.hex(c)).alias(n) for c, n in (("msg", "msg"), ("reply_msg", "reply_msg"), ("root.msg", "root_msg"))))


def as_mail(chat: DataFrame) -> DataFrame:
    """Chat turns as mail clients write them: each message quotes the one before, and that one's quote one level deeper.

    Of several messages at one turn the next one quotes that of the least text; each is a mail of its own."""
    turn = chat.select(F.col("conv_id").cast("bigint").alias("thread"), F.col("turn").cast("bigint").alias("pos"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The white-space-free start of a line that looks like a quote is escaped, as mail programs do.
    turn = turn.withColumn("text", F.regexp_replace("text", r"(?m)^[ \t]?>", "|>"))
    by_place = turn.groupBy("thread", "pos").agg(F.min(F.struct("text", "role")).alias("said")).select("thread", "pos", "said.*")

    def back(k):
        return by_place.select("thread", (F.col("pos") + k).alias("pos"), F.col("text").alias(f"text{k}"), F.col("role").alias(f"role{k}"))

    def quote(text, mark):
        return F.concat(F.lit(mark), F.regexp_replace(text, "\n", "\n" + mark))

    both = turn.join(back(1), ["thread", "pos"], "left").join(back(2), ["thread", "pos"], "left")
    older = F.when(F.col("text2").isNotNull(), F.concat(F.lit("> "), "role2", F.lit(" wrote:\n"), quote(F.col("text2"), "> > "), F.lit("\n"))).otherwise("")
    newer = F.when(F.col("text1").isNotNull(), F.concat("role1", F.lit(" wrote:\n"), older, quote(F.col("text1"), "> "), F.lit("\n\n"))).otherwise("")
    return both.select("thread", "pos", F.concat(newer, "text").alias("text"))


def op2(spark, sf_dir):
    return conversations(as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
