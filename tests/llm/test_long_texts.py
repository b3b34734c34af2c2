"""Texts of a megabyte that a pattern could meet again at each of their characters, and clashing column names."""

import time

import pytest

from quillrank.llm import common, licences, surrogates

MB = 1_000_000


@pytest.mark.parametrize("text", ["1 " + "a." * (MB // 2), "x@" + "a." * (MB // 2), "a@" * (MB // 2), "Mr. " * (MB // 4), "Mr. " + "A. " * (MB // 3),
                                  "1" * MB, "+1 " * (MB // 3), "a" * MB + " 1", "_." * (MB // 2) + "1", "Dr. A" + "-a" * (MB // 2)])
def test_entities_of_long_texts(text):
    start = time.process_time()
    surrogates.find(text)
    assert time.process_time() - start < 4


@pytest.mark.parametrize("text", ["license " + "." * MB + "x", "license " + ". " * (MB // 2), "license" + "\n" * MB, "license\n " + " " * MB + "x",
                                  "license " + ": " * (MB // 2), "SPDX-License-Identifier: " + "a." * (MB // 2), "permission is hereby\n" * (MB // 21)])
def test_licences_of_long_texts(text):
    start = time.process_time()
    licences.recognise(text)
    assert time.process_time() - start < 8


def test_mailboxes_in_and_after_other_entities():
    def mails(text):
        return [text[a:b] for a, b, k, _ in surrogates.find(text) if k == "email"]

    assert mails("__a.b+c@x.org, (d@y.com) +e@z.net") == ["a.b+c@x.org", "d@y.com", "e@z.net"]
    assert mails("Mr. Smith.foo@x.com and Mr. Dr@y.com") == ["foo@x.com", "Dr@y.com"]
    assert mails("192.168.0.1.foo@x.com") == ["192.168.0.1.foo@x.com"]


def test_surrogates_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", 5, 6, 7, 8, 9), (2, "none", 0, 0, 0, 0, 0)],
                               "doc_id long, text string, n_entities int, _found int, _key int, `a.b` int, row int")
    got = surrogates.pseudonymise(df)
    assert got.columns == df.columns
    rows = sorted(map(tuple, got.collect()))
    assert [r[2:] for r in rows] == [(5, 6, 7, 8, 9), (0, 0, 0, 0, 0)] and rows[0][1] != "mail a@b.org" and rows[1][1] == "none"


def test_scratch_deletes_what_it_made(spark):
    import os
    with common.scratch(spark):
        held = common.stored(spark.range(3), "scratch-test")
        path = held.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and held.count() == 3
    assert not os.path.exists(path)
