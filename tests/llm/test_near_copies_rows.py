"""Near copies where a doc_id repeats with other texts, and on a given table against all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest

from quillrank.llm import near_copies

SMALL = "/root/testdata/sf0.001"
A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))


@pytest.mark.parametrize("extra", ["", " tail of other words here"])
def test_repeated_ids_with_other_texts(spark, extra):
    """Document 7 has the texts A and B (of equal or other size); 3 is a near copy of B, 9 of A."""
    rows = [(3, B.replace("b0 ", "c0 ")), (7, A + extra), (7, B), (9, A.replace("a0 ", "c0 ") + extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS text_id", "3 AS row", "4 AS node")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_copies.near_copies(df).collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False)]
    left = near_copies.near_copy_filter(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [rows[0], rows[1]]


def test_given_documents_equal_all_pairs(spark):
    """Every link of the given table is found (recall 1), and no other."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    links = 0
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert links
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_copies.op4(spark, SMALL).collect()}
    assert got == {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_short_sets_fill_their_registers_and_agree_by_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((1, 0), (4, 3), (9, 8), (30, 25), (200, 150), (3000, 2500)):
        agree, wanted, chance = [], shared / (2 * n - shared), []
        for _ in range(40):
            both = rng.integers(0, 2 ** 64, 2 * n - shared, dtype=np.uint64)
            with np.errstate(over="ignore"):
                a, b, c = (near_copies.registers(np.sort(x)) for x in (both[:n], both[n - shared:], rng.integers(0, 2 ** 64, n, dtype=np.uint64)))
            assert (a > 0).all() and (b > 0).all()
            agree.append((a == b).mean())
            chance.append((a == c).mean())
        assert abs(np.mean(agree) - wanted) < 0.05, (n, np.mean(agree), wanted)
        assert np.mean(chance) < 0.005
    assert not near_copies.registers(np.zeros(0, np.uint64)).any()


def test_unrelated_short_texts_share_no_band():
    rng = np.random.default_rng(4)
    with np.errstate(over="ignore"):
        keys = np.concatenate([near_copies.band_keys(near_copies.registers(np.sort(rng.integers(0, 2 ** 64, 12, dtype=np.uint64)))) for _ in range(3000)])
    assert len(np.unique(keys)) == len(keys)
