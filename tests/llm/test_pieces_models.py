"""op6 on models made here: a unigram model with a character map, user symbols, spaces kept or squeezed."""

import struct

import pytest

from quillrank.llm import pieces

TEXTS = ["", " ", "  hello   world ", "ＨＥＬＬＯ　①② ﬁne", "hello<sep>world <sep> x<sep><sep>", "tab\thello\nworld", "Å é", "▁hello",
         "unknown ☃ sign", "hello" * 50, "éhello", "world​  hello", "hello <se p>"]


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _normaliser(rule):
    """The character map of a public rule, from the installed library."""
    import sentencepiece
    data = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for n, v in pieces._fields(data) if n == 3)
    return dict(pieces._fields(spec)).get(2, b"")


def _model(path, kind, charsmap=b"", prefix=1, squeeze=1, symbols=("<sep>",)):
    words = ["▁", "▁hello", "hello", "▁world", "world", "he", "llo", "ld", "wor", "lo", "ll", "▁he", "▁hel", "or", "wo", "▁w", "▁wor"]
    rows = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL)] + [(s, 0.0, pieces.USER) for s in symbols]
    rows += [(w, -2.0 - i / 4, pieces.NORMAL) for i, w in enumerate(words)]
    rows += [(c, -12.0 - i / 8, pieces.NORMAL) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789HELO<>éÅ")]
    rows += [(f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in rows)
    data += _field(2, _field(3, kind) + _field(35, 1))
    data += _field(3, _field(2, charsmap) + _field(3, prefix) + _field(4, squeeze) + _field(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix, squeeze", [(1, 1), (1, 0), (0, 1)])
def test_ids_are_those_of_the_library(tmp_path, kind, rule, prefix, squeeze):
    t = pieces.PieceTokenizer(_model(tmp_path / "m.model", kind, _normaliser(rule), prefix, squeeze))
    for text, (ids, same) in zip(TEXTS, t.encode_batch(TEXTS)):
        assert (ids.tolist(), same) == (t.whole.encode(text), True), text


def test_a_difference_is_told(tmp_path):
    t = pieces.PieceTokenizer(_model(tmp_path / "m.model", pieces.BPE))
    t.tokenizer = pieces.build({**t.model, "pieces": [(p, s, pieces.UNUSED if len(p) > 3 else k) for p, s, k in t.model["pieces"]]})
    assert [same for _, same in t.encode_batch(["hello world", "x"])] == [False, True]
    quiet = pieces.PieceTokenizer(_model(tmp_path / "m.model", pieces.BPE), parity=False)
    assert [same for _, same in quiet.encode_batch(["hello", ""])] == [None, None]


def test_mapped_texts_as_a_job(spark, tmp_path):
    path = _model(tmp_path / "m.model", pieces.UNIGRAM, _normaliser("nmt_nfkc"))
    df = spark.createDataFrame([(1, "ＨＥＬＬＯ hello"), (2, None), (3, "hello world")], "doc_id long, text string")
    coded = pieces.encode(df, path)
    assert {r.doc_id: (r.same, r.decoded) for r in coded.collect()} == {1: (True, False), 2: (True, True), 3: (True, True)}
    assert {r.doc_id: r.text for r in pieces.decode(coded, path).collect()} == {1: "HELLO hello", 2: "", 3: "hello world"}
