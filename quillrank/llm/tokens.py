"""Token ids of whole texts by a word BPE of the ``tokenizers`` library.

The tokenizer drops white space and ends its pieces at word ends, so the ids of
a text are those of its white-space-separated chunks, one after the other.  A
task encodes each distinct chunk once (the library's BPE model does it), keeps
the ids in a bounded table, and gathers a batch's ids from it with numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that one Python worker remembers at most; then it starts afresh.
CACHE_CHUNKS = 600_000

# Printable ASCII and Latin-1 letters: lower-casing is per character and NFC leaves them alone.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
# Chunks are cut all at once; a line feed ends each.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
_OPEN: dict[str, "WordTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE spells a byte as itself where it prints, else as a letter from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Table:
    """Keys with their ids, in flat arrays that grow; row 0 is the empty key, which has none."""

    def __init__(self):
        self.rows: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0

    def add(self, keys: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.rows)
        while first + len(keys) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts] * 2), np.concatenate([self.lengths] * 2)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.starts[first:first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[first:first + len(keys)] = sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.rows.update(zip(keys, range(first, first + len(keys))))

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows in one array, and where each row's ids end (from 0 on)."""
        sizes = self.lengths[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class WordTokenizer:
    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.limit = limit
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    @classmethod
    def open(cls, path: str) -> "WordTokenizer":
        """One per worker process and path."""
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def clear(self) -> None:
        self.chunks, self.parts = _Table(), _Table()

    def _plain(self, chunk: str) -> bool:
        return bool(_PLAIN.fullmatch(chunk)) and not ("<|" in chunk and any(s in chunk for s in self.specials))

    def _add_plain(self, chunks: list[str]) -> None:
        """New chunks of plain characters, cut into parts all at once."""
        parts = _PARTS.findall("\n".join([*chunks, ""]).lower())
        new = list({p for p in parts if p not in self.parts.rows and p != "\n"})
        ids = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))] for p in new]
        self.parts.add(new, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32))
        self.parts.rows.setdefault("\n", 0)
        rows = self.parts.numbers(parts)
        flat, ends = self.parts.gather(rows)
        stops = ends[1:][rows == 0]
        self.chunks.add(chunks, np.diff(stops, prepend=0), flat)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The table's row of each chunk; new chunks are encoded."""
        if len(self.chunks.rows) + len(chunks) > max(self.limit, 2 * len(chunks)):
            self.clear()
        known = self.chunks.rows
        new = [c for c in chunks if c not in known]
        plain = [c for c in new if self._plain(c)]
        if plain:
            self._add_plain(plain)
        if len(plain) < len(new):
            other = [c for c in new if c not in known]
            ids = [self.whole.encode(c, add_special_tokens=False).ids for c in other]
            self.chunks.add(other, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32))
        return self.chunks.numbers(chunks)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the n + 1 ends of the texts' ids (null: no ids)."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        ends = np.asarray(pieces.offsets, dtype=np.int64)
        ends = ends - ends[0]
        coded = pc.dictionary_encode(pieces.flatten())
        rows = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        flat, after = self.chunks.gather(rows)
        return flat, after[ends]
