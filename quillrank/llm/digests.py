"""Similarity digests from statistically improbable byte windows.

Every 64-byte window of a text's UTF-8 bytes has an entropy; windows rank by how
rare their entropy is among all windows of the corpus (a histogram over all
documents, or a given one).  The lowest rank in each run of 64 windows scores a
point for its window; windows with enough points are the text's features.
Features go into a chain of Bloom filters of 2048 bits, a new one after 160
features.  Two digests compare filter by filter: the overlap of bits beyond that
expected by chance, over the largest possible, best match, mean over the shorter
chain.

Defined cases: a text of fewer than 64 bytes is padded to one window; null and
empty texts have the empty digest, which is like itself (1) and like no other
(0); equal texts have equal digests; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import documents, map_slices, slices, text_bytes

WINDOW = 64
RUN = 64
POINTS = 16
BITS = 2048
HASHES = 5
PER_FILTER = 160
CLASSES = 1000
#: Bytes of text in one numpy pass.
SLICE = 192 << 10
#: Bytes of text in one part of the neighbour job, about, and the most parts: beyond that, parts grow (a task streams its own).
PART_BYTES = 16 << 20
MAX_PARTS = 1 << 16

_COUNT = np.arange(WINDOW + 2)
_NLOGN = np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0)
_GAIN = np.round((_NLOGN[1:] - _NLOGN[:-1]) * (1 << 16)).astype(np.int64)  # fixed point: sums don't depend on their order
_MOST = int(_GAIN[:WINDOW].sum())


def _window_classes(flat: np.ndarray) -> np.ndarray:
    """For the window from each byte on, the class of its entropy: 0 (one byte value) to CLASSES."""
    n = len(flat) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.uint8)
    for s in range(1, WINDOW):  # equal bytes within the window before and after each byte
        equal = (flat[s:] == flat[:-s]).view(np.uint8)
        before[s:] += equal
        after[:-s] += equal
    enter = _GAIN[before]
    leave = _GAIN[after]
    # Sum of c log c over the window's byte counts: what entered up to its end, less what left before it.
    total = np.cumsum(enter)[WINDOW - 1:]
    total[1:] -= np.cumsum(leave[:n - 1])
    return np.clip((_MOST - total) * CLASSES // _MOST, 0, CLASSES)


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, short ones filled up to a window with zero bytes; empty ones stay empty."""
    flat, ends = text_bytes(column)
    sizes = np.diff(ends)
    short = (sizes > 0) & (sizes < WINDOW)
    if not short.any():
        return flat, ends
    after = np.concatenate([[0], np.cumsum(np.where(short, WINDOW, sizes))])
    out = np.zeros(after[-1], np.uint8)
    out[np.repeat(after[:-1] - ends[:-1], sizes) + np.arange(len(flat))] = flat
    return out, after


def _valid(ends: np.ndarray, n: int) -> np.ndarray:
    """Whether the window from each byte on lies within one text."""
    left = np.repeat(ends[1:], np.diff(ends))[:n] - np.arange(n)
    return left >= WINDOW


def histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each entropy class (CLASSES + 1 numbers come to the driver)."""
    def run(batches):
        total = np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                flat, ends = _padded(part.column("text"))
                own = _window_classes(flat)
                total += np.bincount(own[_valid(ends, len(own))], minlength=CLASSES + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["class", "n"])

    out = np.zeros(CLASSES + 1, np.int64)
    for row in docs.select("text").mapInArrow(run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[row["class"]] = row["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy class: the rarest first; equal counts by class."""
    out = np.empty(len(counts), np.int64)
    out[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return out


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(column: pa.Array, rank: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters: rows of BITS / 8 bytes."""
    flat, ends = _padded(column)
    empty = np.zeros((0, BITS // 8), np.uint8)
    own = _window_classes(flat)
    if not len(own):
        return [empty] * (len(ends) - 1)
    ok = _valid(ends, len(own))
    far = np.int64(1) << 62
    place = np.arange(len(own))
    key = np.full(len(own) + RUN, far)
    key[:len(own)][ok] = (rank[own] << 40 | place)[ok]
    least, span = key, 1
    while span < RUN:  # the least key of the run from each window on, cut at the text's end
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = least[:len(own)][ok]
    points = np.bincount(least & ((np.int64(1) << 40) - 1), minlength=len(own))
    text = np.searchsorted(ends, place, side="right") - 1
    # Where no window has enough points, those with the most are taken.
    need = np.zeros(len(ends) - 1, np.int64)
    np.maximum.at(need, text[points > 0], points[points > 0])
    need = np.minimum(POINTS, np.maximum(1, need))
    chosen = np.flatnonzero((points >= need[text]) & ok)
    with np.errstate(over="ignore"):
        h = np.zeros(len(chosen), np.uint64)
        grid = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[chosen].copy().view("<u8") if len(chosen) else np.zeros((0, 8), np.uint64)
        for k in range(WINDOW // 8):
            h = _mix((h ^ grid[:, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        more = _mix(h + np.uint64(0x632BE59BD9B4E019))
    owner = text[chosen]
    _, first = np.unique(np.stack([owner.astype(np.uint64), h], 1), axis=0, return_index=True) if len(h) else (None, np.zeros(0, int))
    first.sort()  # a feature counts once in a text, where it stands first
    owner, h, more = owner[first], h[first], more[first]
    begin = np.searchsorted(owner, np.arange(len(ends) - 1))
    nth = np.arange(len(owner)) - begin[owner]
    size = np.bincount(owner, minlength=len(ends) - 1)
    chains = -(-size // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chains)])
    bits = np.zeros((base[-1], BITS), bool)
    row = base[owner] + nth // PER_FILTER
    for k in range(HASHES):
        part = (h >> np.uint64(11 * k)) if k < 4 else more
        bits[row, (part & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    bits_a, bits_b = (np.unpackbits(x, axis=1).astype(np.float32) for x in (a, b))
    ones_a, ones_b = bits_a.sum(1)[:, None], bits_b.sum(1)[None, :]
    chance = ones_a * ones_b / BITS
    room = np.minimum(ones_a, ones_b) - chance
    score = np.clip((bits_a @ bits_b.T - chance) / np.maximum(room, 1e-9), 0, 1)
    sides = [score.max(1).mean(), score.max(0).mean()]
    if len(a) == len(b):
        return float(round(min(sides), 6))
    return float(round(sides[0] if len(a) < len(b) else sides[1], 6))


def fingerprint(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint (hex of the filter chain)."""
    rank = ranks(histogram(docs)) if rank is None else rank

    def run(batch):
        made = [x.tobytes().hex() for x in digests(batch.column("text"), rank)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprint string", limit=SLICE)


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many first code points of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(rows: list[tuple], rank: np.ndarray) -> pa.RecordBatch:
    """Rows of (doc_id, text, next text)."""
    texts, after = [t for _, t, _ in rows], [n for *_, n in rows]
    changed = [edited(t, n) for t, n in zip(texts, after)]
    # A row's next text is the following row's own, but for the last.
    own = digests(pa.array(texts + after[-1:], pa.string()), rank)
    new = digests(pa.array(changed, pa.string()), rank)
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, *_ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()), pa.array([x.tobytes().hex() for x in new], pa.string()),
        pa.array([likeness(x, y) for x, y in zip(own, new)], pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(own, own[1:])], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def neighbours(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document against its edited text and the next document, by ascending (doc_id, text digest), null ids first.

    Cut points on doc_id (quantiles, a number per ``part_bytes`` of text) deal the
    documents out once; the first document of each part goes to the part before
    as well, as the next of its last.  A task streams its sorted part.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    rank = ranks(histogram(docs))
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], _OUT)
    parts = int(min(MAX_PARTS, max(1, size["b"] // part_bytes)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    placed = docs.withColumns({"at": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("bigint")), "tie": F.xxhash64("text")})

    def heads(batches):
        for batch in batches:
            at, tie = (batch.column(c).to_numpy() for c in ("at", "tie"))
            order = np.lexsort((tie, at))
            part, first = np.unique(np.searchsorted(cuts, at[order], side="right"), return_index=True)
            first = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at[first]), pa.array(tie[first])], ["part", "d", "t"])

    # The first document of each part, without its text: (part, doc_id, tie).
    firsts = placed.select("at", "tie").mapInArrow(heads, "part int, d bigint, t bigint").groupBy("part").agg(F.min(F.struct("d", "t")).alias("k")).collect()
    firsts = sorted((r["part"], r["k"]["d"], r["k"]["t"]) for r in firsts)
    before = {(d, t): firsts[i - 1][0] for i, (_, d, t) in enumerate(firsts)}  # the first of all goes behind the last
    head = firsts[0][1:]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("at", "tie"))))
        again = [i for i, key in enumerate(rows) if key in before]
        index = pa.array(list(range(len(rows))) + again)
        part = np.searchsorted(cuts, batch.column("at").to_numpy(), side="right").tolist() + [before[rows[i]] for i in again]
        turn = [0] * len(rows) + [2 if rows[i] == head else 1 for i in again]
        taken = batch.take(index)
        return pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("text"), taken.column("at"), taken.column("tie"),
                                           pa.array(part, pa.int32()), pa.array(turn, pa.int32())], ["doc_id", "text", "at", "tie", "part", "turn"])

    dealt = map_slices(placed, deal,
                       "doc_id bigint, text string, at bigint, tie bigint, part int, turn int")

    def run(batches):
        held, size = [], 0  # rows whose next text is known, then the row that waits for it
        waiting, part, done = None, None, False
        for batch in batches:
            for doc, text, p, turn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "turn"))):
                if p != part:
                    part, done, waiting = p, False, None
                    if held:
                        yield _compare(held, rank)
                        held, size = [], 0
                if done:
                    continue  # repeated rows of the next part's first document
                if waiting is not None:
                    held.append((*waiting, text))
                    size += len(waiting[1])
                    if size >= SLICE and not turn:
                        yield _compare(held, rank)
                        held, size = [], 0
                waiting, done = (doc, text), bool(turn)
        if held:
            yield _compare(held, rank)

    # One part of the shuffle may get several parts of the table, so they are told apart by ``part``.
    sorted_parts = dealt.repartition(len(firsts), "part").sortWithinPartitions("part", "turn", "at", "tie")
    return sorted_parts.select("doc_id", "text", "part", "turn").mapInArrow(run, _OUT)


def op3(spark, sf_dir):
    return neighbours(documents(spark, sf_dir))
