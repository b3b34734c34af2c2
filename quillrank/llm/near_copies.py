"""Near copies by HyperMinHash registers, bands and exact verification.

A document's set is its distinct word shingles (64-bit hashes).  Equal sets form
one class first, so a text that a third of all rows copy is compared once.  The
sketch of a set spreads the hashes over buckets (in as many rounds as it takes to
fill them) and keeps of each bucket's least value the number of leading zeros and
some mantissa bits.  Classes that agree in
all registers of a band meet in that band's group:

1. Each member is paired with the least member of its group (linear in the
   group), pairs are filtered by the collision-corrected Jaccard estimate and
   verified on the full sets; verified links give components.
2. Groups that still hold several components are compared in full, but only
   across components.  Large groups are dealt over blocks; only members outside
   the group's first component visit the other blocks, and many visitors are dealt
   over parts, so a task holds one block and one part.  It compares registers with numpy, verifies likely pairs on the full sets, and emits a link only where
   it joins two components.  A pair is looked at in its first common band alone.

No partner is capped and no group is collected.  With 32 bands of 4 registers a
link at similarity 0.8 shares no band with a chance below 1e-7.

Defined cases: texts without words are linked with nothing; with fewer words
than a shingle the whole sequence is the one shingle; where a ``doc_id`` repeats
with other texts, each row is linked by its own text, and its component's least
``doc_id`` decides whether it is kept; a null ``doc_id`` is linked with nothing
(component null, kept); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import documents, map_slices, stored, text_bytes

WIDTH = 4
PERCENT = 80
BANDS, ROWS = 32, 4
BUCKETS = BANDS * ROWS
#: A register has 16 bits: leading zeros (and one, 0 if empty) above the mantissa.
MANTISSA = 10
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0
#: A block of a group: members and shingles that one task holds as residents, about.
BLOCK = 1024
BLOCK_SHINGLES = 4 << 20
#: Chance of equal registers with unequal minima, times 2 to the mantissa bits (HyperMinHash, equal set sizes).
COLLISION = 0.169919487159739

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_PRIME, _GOLD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and each text's first word: two polynomials in the word's bytes, mixed."""
    cut = np.zeros(len(flat) + 1, bool)
    cut[ends] = True
    inside = ~_SPACE[flat]
    first = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]])))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    size = last - first + 1
    low = _mix((_LOWER[flat[inside]] + np.uint64(1)) * _GOLD)
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    h = np.add.reduceat(_mix(low + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), at[:-1])
    return _mix(h + size.astype(np.uint64) * _GOLD), np.searchsorted(first, ends)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    words, first = _word_hashes(*text_bytes(column))
    n = np.diff(first)
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full = _mix(full * _PRIME + words[k:k + len(full)] + _GOLD) if len(full) else full
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a:b - width + 1]))
        else:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = _mix(h * _PRIME + words[k] + _GOLD + np.uint64(b - a))
            out.append(h[:b > a])
    return out


def _least(own: np.ndarray) -> np.ndarray:
    """Per bucket (the top bits of a hash) the least remaining bits.

    Buckets that stay empty are filled by hashing the set anew, round after round.
    So a bucket's least is by (first round that hits the bucket, bits) over the whole
    set, one order for all sets, and two sets agree in a bucket as often as
    they are similar, however few shingles they have.
    """
    shift = 64 - (BUCKETS - 1).bit_length()
    top, rest = np.uint64(shift), np.uint64((1 << shift) - 1)
    bucket = own >> top
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least, empty = np.zeros(BUCKETS, np.uint64), np.ones(BUCKETS, bool)
    least[bucket[start]], empty[bucket[start]] = own[start] & rest, False
    done, many = 1, -(-8 * BUCKETS // len(own))
    # A word of the sort: bucket, round, and the topmost of the remaining bits.
    bits = np.uint64(shift - many.bit_length())
    drop = top - bits
    while empty.any():
        seeds = _mix(np.arange(done, done + many, dtype=np.uint64) * _GOLD)
        h = _mix(own[None, :] ^ seeds[:, None])
        place = (h >> top << np.uint64(many.bit_length())) | np.arange(many, dtype=np.uint64)[:, None]
        found = np.sort((place << bits | (h & rest) >> drop).ravel())
        bucket = found >> top
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        start = start[empty[bucket[start]]]
        least[bucket[start]] = (found[start] & ((np.uint64(1) << bits) - np.uint64(1))) << drop
        empty[bucket[start]] = False
        done += many
    return least


def registers(own: np.ndarray) -> np.ndarray:
    """Per bucket: leading zeros and mantissa of its least bits; 0 for an empty set."""
    if not len(own):
        return np.zeros(BUCKETS, np.uint16)
    shift = 64 - (BUCKETS - 1).bit_length()
    least = _least(own)
    _, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    exponent = exponent.astype(np.int64)  # least < 2 ** exponent, up to rounding
    zeros = np.clip(shift - exponent, 0, 36)
    down = np.maximum(0, exponent - 1 - MANTISSA)
    up = np.maximum(0, MANTISSA - exponent + 1)
    mantissa = ((least >> down.astype(np.uint64)) << up.astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros.astype(np.uint64) + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key per band (distinct over the bands); 0 for bands whose registers are all empty."""
    grid = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for r in range(ROWS):
        h = _mix(h * _PRIME + grid[:, r])
    return np.where(grid.any(1), h | np.uint64(1), np.uint64(0)).view(np.int64)


def _set_id(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_id (the text's SHA-256), n_shingles, set_id (null if empty), sketch."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            sets = shingle_sets(batch.column("text"), width)
            sketches = [registers(s).tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array(sketches, pa.binary())],
            ["doc_id", "text_id", "n_shingles", "set_id", "sketch"])

    return map_slices(docs.select("doc_id", "text", _text_id().alias("text_id")), run,
                      "doc_id bigint, text_id binary, n_shingles bigint, set_id binary, sketch binary")


def _text_id():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def banded(classes: DataFrame) -> DataFrame:
    """key, node, n: a row for each band of a class whose registers are not all empty."""
    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                keys = [band_keys(np.frombuffer(x, np.uint16)) for x in batch.column("sketch").to_pylist()]
            rows = np.concatenate([np.full(np.count_nonzero(k), i) for i, k in enumerate(keys)] or [np.zeros(0, int)])
            keys = np.concatenate([k[k != 0] for k in keys] or [np.zeros(0, np.int64)])
            taken = batch.take(pa.array(rows.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), taken.column("node"), taken.column("n")], ["key", "node", "n"])

    return classes.select("node", "n", "sketch").mapInArrow(run, "key bigint, node bigint, n bigint")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            sets = shingle_sets(batch.column("text"), width)
        return pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.binary()),
                                           pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "shingles"])

    return map_slices(docs.select("doc_id", "text"), run, "set_id binary, shingles array<bigint>")


def _likely(same: np.ndarray, filled: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate, corrected for chance collisions, reaches the threshold within the slack."""
    wanted = percent / 100
    filled = np.maximum(filled, 1)
    chance = COLLISION * 2.0 ** -MANTISSA
    estimate = (same / filled - chance) / (1 - chance)
    return estimate >= wanted - SLACK * np.sqrt(wanted * (1 - wanted) / filled)


def _estimate_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (columns ``sketch_a``, ``sketch_b``) whose estimate leaves a link possible, without the sketches."""
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
            keep = _likely(((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1), percent)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (the least node reachable), by alternating large and small stars; each round is a stored table."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), name)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _across(percent: int):
    """A cell's links that join its components: visitors (outside the group's first component) against residents."""
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        node, own, guest, free, n = (table.column(c).to_numpy() for c in ("node", "component", "guest", "free", "n"))
        own = np.unique(own, return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        with np.errstate(over="ignore"):
            bands = np.stack([band_keys(x) for x in sketch])
        sets = table.column("shingles")
        band = int(np.flatnonzero(bands[0] == key)[0])
        home = ~guest
        out = []
        for x in np.flatnonzero(guest).tolist():
            # Two members outside the first component meet twice: the lesser one's visit counts.
            ok = home & (own != own[x]) & (~free | (node > node[x])) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            at = np.flatnonzero(ok)
            at = at[((bands[at] == bands[x]) & (bands[x] != 0)).argmax(1) == band]
            a, b = sketch[at], sketch[x]
            at = at[_likely(((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1), percent)]
            mine = np.asarray(sets[x].values) if len(at) else None
            for y in at.tolist():
                if own[x] == own[y]:
                    continue
                both = len(np.intersect1d(mine, np.asarray(sets[y].values), assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    out.append((int(node[x]), int(node[y])))
                    own[own == own[x]] = own[y]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _blocks(size, shingles):
    """Blocks of a group that keep each within BLOCK members and BLOCK_SHINGLES shingles, about."""
    return F.ceil(F.greatest(size / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, text_id, kept for every row."""
    signed = stored(signatures(docs, width), "near-signatures")
    named = signed.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    # A set with fewer shingles than this differs from any other set by too much.
    rows = banded(classes.where(100 * F.col("n") >= percent * (F.col("n") + 1)))
    groups = rows.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center <> other").drop("other")
    hits = stored(rows.join(groups, "key"), "near-groups")

    sketches = classes.select("node", "n", "sketch")
    pairs = hits.where("center <> node").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("b", "nb", "sketch_b"), "b").join(sketches.toDF("a", "na", "sketch_a"), "a")
    pairs = stored(_estimate_filter(pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")), percent).distinct(), "near-pairs")

    wanted = stored(classes.join(hits.select("node").distinct(), "node").select("node", "set_id", "doc_id"), "near-wanted")
    sets = (full_sets(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), width)
            .join(wanted.select("node", "set_id"), "set_id").drop("set_id"))
    sets = stored(sets.dropDuplicates(["node"]), "near-sets")
    both = F.size(F.array_intersect("sa", "sb"))
    verified = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
                .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
                .where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b"))
    first_links = stored(verified, "near-links")
    first = components(first_links, "near-star")

    member = hits.join(first.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
    member = member.select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                      F.count("*").alias("size"), F.sum("n").alias("shingles")).where("low <> high")
    mixed = mixed.select("key", "low", _blocks(F.col("size"), F.col("shingles")).alias("blocks"))
    cells = member.join(mixed, "key").withColumn("free", F.col("component") != F.col("low"))
    guests = cells.where("free").groupBy("key").agg(_blocks(F.count("*"), F.sum("n")).alias("parts"))
    cells = cells.join(guests, "key").withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = F.pmod(F.xxhash64("node", F.lit("guest")), F.col("parts")).cast("int")
    fields = ["key", "node", "n", "component", "free"]
    visits = cells.where("free").select(*fields, F.lit(True).alias("guest"), own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    stay = cells.where("parts = 1").select(*fields, F.lit(False), F.lit(0), "home")
    met = cells.where("parts > 1").select(*fields, F.lit(False), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "home")
    cells = visits.unionAll(stay).unionAll(met)
    cells = cells.join(classes.select("node", "sketch"), "node").join(sets, "node")
    more = cells.groupBy("key", "block", "part").applyInArrow(_across(percent), "a bigint, b bigint")
    final = components(first_links.unionAll(more), "near-components")

    of_set = stored(classes.join(final, "node", "left").select("set_id", "doc_id", F.coalesce("component", "node").alias("component")), "near-of-set")
    least = of_set.groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = signed.join(of_set.drop("doc_id").join(least, "component"), "set_id", "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    by_row = joined.select("doc_id", "n_shingles", known.alias("component_id"), "text_id")
    return by_row.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return link(docs, width, percent).drop("text_id")


def near_copy_filter(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all columns of ``docs``; rows that share doc_id and text stay together."""
    lost = link(docs, width, percent).where(~F.col("kept")).select("doc_id", "text_id").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", _text_id().alias("text_id"))
    return rows.join(lost, ["doc_id", "text_id"], "left_anti").select("row.*")


def op4(spark, sf_dir):
    return near_copies(documents(spark, sf_dir))
