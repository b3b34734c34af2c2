"""Best-fit-decreasing packing into fixed-length id matrices.

Documents are tokenised and closed with an end id; one longer than a row is
split into full rows and a rest, losslessly.  A task packs its pieces in blocks
of a bounded number of ids: longest piece first, each into the open row with the
least room that holds it.  A segment tree over the room values finds that row.

Output, one row per matrix row: ``input_ids`` (``max_len`` little-endian ids,
padded with ``pad_id``), ``position_ids`` (counting from 0 anew in each segment,
0 in the padding), ``cu_seqlens`` (0 and the end of each segment), ``doc_ids``
and ``starts`` (each segment's place in its document's ids).

Defined cases: null or empty text: the end id alone; repeated rows are packed
once each; a null ``doc_id`` stays null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import documents, slices
from quillrank.llm.tokens import WordTokenizer, default_path

MAX_LEN = 4096
END_ID = 49407
PAD_ID = 0
#: Ids that a task holds while it packs a block.
BLOCK_IDS = 4 << 20
_SCHEMA = ("n_tokens int, n_segments int, doc_ids array<bigint>, starts array<bigint>, "
           "cu_seqlens array<int>, input_ids binary, position_ids binary")


class RoomTree:
    """Counts of open rows by room, in a segment tree; ``fit`` finds the least room >= a need."""

    def __init__(self, most: int):
        self.width = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def fit(self, need: int) -> int | None:
        at = need + self.width
        if self.count[at]:
            return need
        while at > 1:  # up to the first ancestor whose right sibling has rows, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit(lengths: list[int], max_len: int) -> list[list[int]]:
    """Rows of piece numbers; pieces by falling length, ties in their own order."""
    tree, open_rows, rows = RoomTree(max_len), {}, []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[piece]
        room = tree.fit(need)
        if room is None:
            row, room = len(rows), max_len
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        if left := room - need:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def _matrix(pieces: list[tuple], max_len: int, pad_id: int, kind: str) -> pa.RecordBatch:
    rows = best_fit([len(p[2]) for p in pieces], max_len)
    ids = np.full((len(rows), max_len), pad_id, kind)
    at = np.zeros((len(rows), max_len), kind)
    lists: list[list] = [[], [], [], [], []]
    for r, members in enumerate(rows):
        ends = [0]
        for m in members:
            own = pieces[m][2]
            ids[r, ends[-1]:ends[-1] + len(own)] = own
            at[r, ends[-1]:ends[-1] + len(own)] = np.arange(len(own))
            ends.append(ends[-1] + len(own))
        for out, x in zip(lists, (ends[-1], len(members), [pieces[m][0] for m in members], [pieces[m][1] for m in members], ends)):
            out.append(x)
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    columns = [pa.array(x, k) for x, k in zip(lists, kinds)]
    columns += [pa.array([row.tobytes() for row in grid], pa.binary()) for grid in (ids, at)]
    return pa.RecordBatch.from_arrays(columns, ["n_tokens", "n_segments", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"])


def pack_best_fit(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID,
                  pad_id: int = PAD_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Ids are stored as uint16 where they fit (``end_id`` < 65536 and a vocabulary below that), else as uint32."""
    path = path or default_path()

    def run(batches):
        tokenizer = WordTokenizer.open(path)
        kind = "<u2" if max(tokenizer.whole.get_vocab_size(), end_id + 1, pad_id + 1, max_len) <= 1 << 16 else "<u4"
        pieces: list[tuple] = []
        held = 0
        for batch in batches:
            for part in slices(batch):
                flat, ends = tokenizer.encode(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype(kind)
                    for start in range(0, len(own), max_len):
                        pieces.append((doc, start, own[start:start + max_len]))
                    held += len(own)
                    if held >= block_ids:
                        yield _matrix(pieces, max_len, pad_id, kind)
                        pieces, held = [], 0
        if pieces:
            yield _matrix(pieces, max_len, pad_id, kind)

    packed = docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
    return packed.select(F.monotonically_increasing_id().alias("sequence_id"), "*")


def write_packed(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)


def op9(spark, sf_dir):
    return pack_best_fit(documents(spark, sf_dir))
