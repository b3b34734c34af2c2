"""SentencePiece models on the ``tokenizers`` library.

The model file's protobuf is parsed here; from it come the normaliser, the
word-start marker, the pieces with their scores (a unigram model, or BPE merges
ranked by score) and byte fallback.  No piece of such a model has a marker
inside (runs of markers apart), so a text's ids are those of its marked words;
a task encodes each distinct word once, many at a time (the library encodes a
batch in threads), and keeps them in a bounded table.  A character map is applied to
the whole text first; the model's user symbols are set apart before it and are
pieces of their own.  Parity: each distinct word is
encoded by the sentencepiece library too, and ``same`` tells whether all words of a
text agree; a text with a character map, or with a word that the library cannot be given alone (after a user symbol,
or without the marker), is encoded whole by both instead.  ``same`` is null where parity was not asked for.  Decoding joins
the pieces, undoes the marker and reads byte pieces as UTF-8; it gives back the normalised text.

Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillrank.llm.common import documents, map_slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words that one Python worker remembers at most.
CACHE_WORDS = 800_000
_OPEN: dict[tuple, "PieceTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """number and value of each protobuf field: an int, 4 or 8 raw bytes, or a byte string."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


def read_model(path: str) -> dict:
    """The parts of a model file that encoding needs."""
    pieces, trainer, normaliser = [], {}, {}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
    return {"pieces": pieces, "kind": trainer.get(3, UNIGRAM), "bytes": bool(trainer.get(35, 0)), "charsmap": normaliser.get(2, b""),
            "prefix": bool(normaliser.get(3, 1)), "squeeze": bool(normaliser.get(4, 1)), "escape": bool(normaliser.get(5, 1))}


def build(model: dict):
    """A ``tokenizers`` tokenizer of marked words: no pre-tokenizer is needed, the words come apart."""
    from tokenizers import Tokenizer, models
    vocab = {p: i for i, (p, _, _) in enumerate(model["pieces"])}
    unknown = next((i for i, p in enumerate(model["pieces"]) if p[2] == UNKNOWN), None)
    if model["kind"] == UNIGRAM:
        return Tokenizer(models.Unigram([(p, s) for p, s, _ in model["pieces"]], unknown, model["bytes"]))
    # A merge for each way to cut a piece into two pieces; the whole's score ranks it, as in BPE by score.
    merges = []
    for i, (piece, score, kind) in enumerate(model["pieces"]):
        if kind in (NORMAL, USER) and len(piece) > 1:
            merges += [(-score, i, vocab[piece[:k]], vocab[piece[k:]], piece[:k], piece[k:])
                       for k in range(1, len(piece)) if piece[:k] in vocab and piece[k:] in vocab]
    merges.sort()
    return Tokenizer(models.BPE(vocab, [(a, b) for *_, a, b in merges], byte_fallback=model["bytes"], fuse_unk=True,
                                unk_token=None if unknown is None else model["pieces"][unknown][0]))


class PieceTokenizer:
    def __init__(self, path: str, parity: bool = True, limit: int = CACHE_WORDS):
        import sentencepiece
        from tokenizers import normalizers
        self.model = read_model(path)
        inner = [p for p, _, k in self.model["pieces"] if k in (NORMAL, USER) and MARK in p.lstrip(MARK)]
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        if inner or not self.model["escape"]:
            raise ValueError("pieces with inner markers and unescaped spaces are not supported")
        self.map = normalizers.Precompiled(self.model["charsmap"]) if self.model["charsmap"] else None
        # The longest symbol that fits comes first, as in the library.
        symbols = sorted((p for p, _, k in self.model["pieces"] if k == USER), key=len, reverse=True)
        self.symbols = re.compile("(" + "|".join(map(re.escape, symbols)) + ")") if symbols else None
        self.symbol_ids = {p: i for i, (p, _, k) in enumerate(self.model["pieces"]) if k == USER}
        self.tokenizer = build(self.model)
        self.parity, self.limit = parity, limit
        self.words: dict[str, tuple[np.ndarray, bool | None]] = {}  # its ids, and whether the library agrees (None: not compared)
        # A word as sentencepiece sees it alone: its own prefix is the marker, so a word without one needs the ids after it.
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.raw = [self._bytes(p, k) for p, _, k in self.model["pieces"]]

    @classmethod
    def open(cls, path: str, parity: bool) -> "PieceTokenizer":
        if (path, parity) not in _OPEN:
            _OPEN[path, parity] = cls(path, parity)
        return _OPEN[path, parity]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        """The text as the library normalises it: mapped outside user symbols, spaces squeezed, marked."""
        if self.map:
            parts = self.symbols.split(text) if self.symbols else [text]
            text = "".join(p if i % 2 else self.map.normalize_str(p) for i, p in enumerate(parts))
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model["prefix"] else "") + text.replace(" ", MARK)

    def _cut(self, text: str) -> list[str]:
        """The normalised text's words and user symbols."""
        parts = self.symbols.split(text) if self.symbols else [text]
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.cut.findall(p))]

    def _learn(self, new: list[str]) -> None:
        if len(self.words) + len(new) > max(self.limit, 2 * len(new)):
            self.words.clear()
        symbols = [w for w in new if w in self.symbol_ids]
        self.words.update((w, (np.array([self.symbol_ids[w]], np.uint32), None)) for w in symbols)
        new = [w for w in new if w not in self.symbol_ids] if symbols else new
        coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        if not self.parity or self.map:
            self.words.update((w, (ids, None)) for w, ids in zip(new, coded))
            return
        # The library adds the marker itself, so a word goes in without its first one.
        own = [i for i, w in enumerate(new) if w.startswith(MARK) and self.model["prefix"]]
        back = (lambda w: w) if self.model["squeeze"] else (lambda w: w.replace(MARK, " "))
        wanted = dict(zip(own, self.whole.encode([back(new[i][1:]) for i in own], num_threads=1)))
        for i, (w, ids) in enumerate(zip(new, coded)):
            self.words[w] = ids, (len(w) == 1 or ids.tolist() == wanted[i]) if i in wanted else None

    def _agree(self, text: str, ids: np.ndarray, own: list[str]) -> bool | None:
        """Whether the library gives the same ids; where a word was not compared, by the whole text."""
        if not self.parity:
            return None
        if all(self.words[w][1] for w in own):
            return True
        return ids.tolist() == self.whole.encode(text) if any(self.words[w][1] is None for w in own) else False

    def encode_batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool | None]]:
        cuts = [self._cut(self.normalise(t or "")) for t in texts]
        new = list({w for own in cuts for w in own} - self.words.keys())
        if new:
            known = self.words if len(self.words) + len(new) <= max(self.limit, 2 * len(new)) else {}
            if known is not self.words:  # the table starts afresh: all words of this batch are needed again
                new = list({w for own in cuts for w in own})
            self._learn(new)
        none = np.zeros(0, np.uint32)
        coded = [np.concatenate([none, *(self.words[w][0] for w in own)]) for own in cuts]
        return [(ids, self._agree(t or "", ids, own)) for t, ids, own in zip(texts, coded, cuts)]

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model["prefix"] and text.startswith(" ") else text


_OUT = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, same boolean, decoded boolean"


def encode(docs: DataFrame, path: str | None = None, parity: bool = True, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian uint32), same (parity), decoded (the ids give the text back), and the ids."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = PieceTokenizer.open(path, parity)
        texts = batch.column("text").to_pylist()
        coded = tokenizer.encode_batch(texts)
        columns = [batch.column("doc_id"), pa.array([len(x) for x, _ in coded], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x, _ in coded], pa.int64()),
                   pa.array([ok for _, ok in coded], pa.bool_()), pa.array([tokenizer.decode(x.tolist()) == (t or "") for (x, _), t in zip(coded, texts)], pa.bool_())]
        names = ["doc_id", "n_tokens", "ids_crc32", "same", "decoded"]
        if ids:
            columns.append(pa.array([x.astype(np.int32) for x, _ in coded], pa.list_(pa.int32())))
            names.append("input_ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return map_slices(docs.select("doc_id", "text"), run, _OUT + (", input_ids array<int>" if ids else ""))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, input_ids (null: empty)."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            tokenizer = PieceTokenizer.open(path, False)
            texts = [tokenizer.decode(x or []) for x in batch.column("input_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "input_ids").mapInArrow(run, "doc_id bigint, text string")


def op6(spark, sf_dir):
    return encode(documents(spark, sf_dir), ids=False)
