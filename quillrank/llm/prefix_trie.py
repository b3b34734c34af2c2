"""Conversation prefix trie: all prefixes of all conversations in one ROLLUP over positional turn-id columns.

A turn's id is a digest of its role and text with the text's length in bytes.  A
conversation's ids stand in blocks of ``COLUMNS`` positional columns; a block's
key is the digest of all turns before it, which names the prior block's last
node, so long conversations continue in further rows of the same table.
``GROUP BY block, ROLLUP (t0, ..)`` with ``grouping_id`` then gives every prefix
its members at once, summed before the shuffle, so a first turn that a third of
all conversations share is one row a task.

Sums over a subtree come from a second ROLLUP without walking the trie: the
smallest member of a node is that of all nodes below it on its own path, so each
node belongs to exactly one conversation.  What a conversation owns (bytes, a
leaf) summed over a node's members, less what its smallest member owns above
the node, is the sum over the node's subtree.

Input of ``trie``: ``conv`` (bigint, not null), ``pos`` (from 0, gapless in a conversation),
``role``, ``text``, and one row with a null ``pos`` for a conversation without turns.
Defined cases: null roles and texts are empty; equal conversations share all
nodes; a conversation without turns is a member of the root alone; no
conversations: no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.common import stored
from quillrank.llm.ordering import numbered, positions

#: Positional columns of a block.
COLUMNS = 16
#: Blocks of a conversation that are summed together before the sums themselves are.
STRIDE = 1024
_EMPTY = hashlib.sha256().hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """32 hexadecimal digits of a digest of both, and the text's bytes."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(both.cast("binary"), 256), 1, 32), F.lit(":"), F.octet_length(text).cast("string"))


def _bytes(turn: Column) -> Column:
    return F.substring(turn, 34, 20).cast("bigint")


def _mark(number: Column, ids: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits of a digest of a block's number and turn ids."""
    digest = F.sha2(F.concat_ws(",", number.cast("string"), ids).cast("binary"), 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16))


def _blocks(turns: DataFrame, columns: int) -> DataFrame:
    """Conversations in blocks: conv, number, ids, key (k1, k2) and bytes of all before, whole bytes and turns."""
    rows = turns.select("conv", F.floor(F.col("pos") / columns).alias("number"), (F.col("pos") % columns).alias("slot"), "id")
    blocks = (rows.groupBy("conv", "number").agg(F.sort_array(F.collect_list(F.struct("slot", "id"))).alias("found"))
              .select("conv", "number", F.col("found")["id"].alias("ids")))
    h1, h2 = _mark(F.col("number"), F.col("ids"))
    size = F.aggregate("ids", F.lit(0).cast("bigint"), lambda total, turn: total + _bytes(turn))
    blocks = blocks.select("*", h1.alias("h1"), h2.alias("h2"), size.alias("size"), F.floor(F.col("number") / STRIDE).alias("far"))
    sums = [F.bit_xor("h1"), F.bit_xor("h2"), F.sum("size")]
    earlier = Window.partitionBy("conv").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("conv", "far").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str, fn, window) -> Column:
        return F.coalesce(fn(name).over(window), F.lit(0).cast("bigint"))

    far = (blocks.groupBy("conv", "far").agg(*(c.alias(n) for c, n in zip(sums, ("h1", "h2", "size"))), F.sum(F.size("ids")).alias("n"))
           .select("conv", "far", before("h1", F.bit_xor, earlier).alias("f1"), before("h2", F.bit_xor, earlier).alias("f2"),
                   before("size", F.sum, earlier).alias("f3"), F.sum("size").over(Window.partitionBy("conv")).alias("total"),
                   F.sum("n").over(Window.partitionBy("conv")).alias("turns")))
    return (blocks.join(far, ["conv", "far"])
            .select("conv", "number", "ids", F.col("f1").bitwiseXOR(before("h1", F.bit_xor, near)).alias("k1"),
                    F.col("f2").bitwiseXOR(before("h2", F.bit_xor, near)).alias("k2"),
                    (F.col("f3") + before("size", F.sum, near)).alias("prior"), "total", "turns"))


def _rollup(blocks: DataFrame, columns: int, sums: str) -> DataFrame:
    """Every prefix once: its place (number, k1, k2, ids), depth, members, smallest member, members that end here."""
    names = [f"t{i}" for i in range(columns)]
    wide = blocks.select("*", *(F.get("ids", F.lit(i)).alias(n) for i, n in enumerate(names))).drop("ids")
    found = blocks.sparkSession.sql(
        f"""SELECT number, k1, k2, array_compact(array({', '.join(names)})) AS ids, {columns} - bit_count(grouping_id()) AS slots,
                   count(*) AS n, min(conv) AS conv, min(prior) AS prior, {sums}
            FROM {{wide}} GROUP BY number, k1, k2, ROLLUP ({', '.join(names)})""", wide=wide)
    # a group whose last column is null holds conversations that ended before it; the empty group is the prior block's last node
    found = found.filter((F.size("ids") == F.col("slots")) & ((F.col("slots") > 0) | (F.col("number") == 0)))
    return found.withColumn("depth", F.col("number") * columns + F.col("slots"))


def _key(ids: Column) -> tuple[Column, Column]:
    """The digest of a prefix: its block's key with its ids, or the key itself before any of them."""
    h1, h2 = _mark(F.col("number"), ids)
    return tuple(F.when(F.size(ids) > 0, F.col(k).bitwiseXOR(h)).otherwise(F.col(k)) for k, h in (("k1", h1), ("k2", h2)))


def trie(turns: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = turns.select("conv", "pos", turn_id(role, text).alias("id"))
    blocks = _blocks(named.filter("pos IS NOT NULL"), columns)
    bare = named.filter("pos IS NULL").select("conv", F.lit(0).cast("bigint").alias("number"), F.array().cast("array<string>").alias("ids"),
                                              *(F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2", "prior", "total", "turns")))
    blocks = stored(blocks.unionByName(bare), "trie-blocks")

    # what each conversation owns: the bytes of the nodes whose smallest member it is, and a leaf if no other goes on from its end
    deep = "max(turns) AS longest"
    owned = (_rollup(blocks, columns, deep)
             .groupBy("conv").agg(F.sum(F.when(F.col("slots") > 0, _bytes(F.element_at("ids", -1))).otherwise(0)).alias("own"),
                                  F.max((F.col("longest") == F.col("depth")).cast("bigint")).alias("leaf")))
    owned = stored(owned, "trie-owned")
    whole = blocks.join(owned, "conv", "left").fillna(0, ["own", "leaf"])
    found = _rollup(whole, columns, "sum(total) AS all_bytes, sum(own) AS own_bytes, sum(leaf) AS n_leaves")

    of_min = blocks.filter("number = 0").select("conv", "total").join(owned, "conv").select("conv", (F.col("total") - F.col("own")).alias("above"))
    last = F.when(F.col("slots") > 0, _bytes(F.element_at("ids", -1))).otherwise(0)
    inside = F.aggregate("ids", F.lit(0).cast("bigint"), lambda total, turn: total + _bytes(turn))
    upto = F.col("prior") + inside - last   # bytes of the turns before the node's own
    up = F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0)))
    k1, k2 = _key(F.col("ids"))
    p1, p2 = _key(up)
    saved = (F.col("all_bytes") - F.col("n") * upto) - (F.col("own_bytes") + F.col("above") - upto)
    nodes = (found.join(of_min, "conv")
             .select(F.col("conv").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "n_leaves", saved.alias("saved_tokens"),
                     k1.alias("key1"), k2.alias("key2"), p1.alias("up1"), p2.alias("up2")))
    nodes = stored(nodes, "trie-nodes")

    heads = nodes.select("depth", "key1", "key2", F.col("conv_id").alias("parent_conv_id"))
    born = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"), F.col("up2").alias("key2"))
            .agg(F.count(F.lit(1)).alias("n_children")))
    e1, e2 = _key(F.col("ids"))
    ends = (blocks.filter((F.col("number") * columns + F.size("ids")) == F.col("turns"))
            .select(F.col("turns").alias("depth"), e1.alias("key1"), e2.alias("key2"), "conv"))
    key = ["depth", "key1", "key2"]
    out = nodes.join(born, key, "left").join(_digests(ends), key, "left")
    above = heads.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), "parent_conv_id")
    out = out.join(above, ["depth", "up1", "up2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                      "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def _digests(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the conversations that end at a node, comma-joined in order.

    One digest is one sequence of bytes: a task streams a node's sorted numbers and holds a batch of them.
    """
    schema = "depth bigint, key1 bigint, key2 bigint, ends_sha256 string"

    def run(batches):
        at, sha = None, None
        for batch in batches:
            done = []
            for d, a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (d, a, b) != at:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (d, a, b), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(str(conv).encode())
            yield rows(done)
        if at:
            yield rows([(*at, sha.hexdigest())])

    def rows(done):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kinds[i]) for i in range(4)],
                                          names=["depth", "key1", "key2", "ends_sha256"])

    key = ["depth", "key1", "key2"]
    dealt = ends.select(*key, "conv").repartition(*key).sortWithinPartitions(*key, "conv")
    return dealt.mapInArrow(run, schema)


def rebuilt(table: DataFrame) -> DataFrame:
    """The conversations as the query's contract rebuilds them, as ``trie`` takes them.

    A conversation c begins with the first h turns of conversation c - c % 5 (h: the CRC-32 of c, modulo 9),
    then has its own after its first h.  Rows without a conv_id are no conversation's.  Turns are taken by
    (turn, role, the text's SHA-256), nulls first.
    """
    rows = table.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").alias("conv"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = positions(numbered(rows, ["conv", "turn", "role", "digest"], "trie-turns"), "conv").withColumnRenamed("_pos", "pos")
    convs = (rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
             .select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"),
                     (F.col("conv") - F.col("conv") % 5).alias("base")))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = (convs.join(bases, "base", "left")
             .select("conv", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint"))).alias("lead")))
    first = (rows.filter("pos < 8").select(F.col("conv").alias("base"), "pos", "role", "text")
             .join(convs.filter("lead > 0").select("conv", "base", "lead"), "base").filter("pos < lead").select("conv", "pos", "role", "text"))
    own = (rows.join(convs.select("conv", "h", "lead"), "conv").filter("pos >= h")
           .select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "role", "text"))
    none = (convs.filter((F.col("lead") == 0) & (F.col("n") <= F.col("h")))
            .select("conv", F.lit(None).cast("bigint").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text")))
    return first.unionByName(own).unionByName(none)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations: a row per node."""
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
