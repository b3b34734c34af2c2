"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean expression, with the columns that it needs prepared first.
On a written sample of the rows every rule is run by itself and timed, and one
aggregate counts which rules reject together; from these the rules are ordered
greedily by rejection per cost among the rows still undecided.  The cascade is
CASE WHEN in that order, so a text that an early rule rejects never reaches the
dearer ones.  Which rows are kept does not depend on the order, so neither on
the clock.

Defined cases: null, empty and blank texts have no words and fail the word
minimum; repeated rows are judged each by itself; extra columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.core import let
from quillrank.llm.common import SPACE, documents, scratch, stored, words

#: Rows that the sample for the rule order holds, about.
SAMPLE_ROWS = 2_000
#: Times that each rule is run on the sample; the least time counts.
TRIALS = 3
#: Seconds below which two costs are not told apart.
CLOCK = 0.002
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PCT = 50
SYMBOL_PCT = 10
DUP_LINE_PCT = 30
UPPER_PCT = 50
MAX_MEAN_WORD = 20
LETTER_PCT = 60
_OTHER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + SPACE
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_chars(text: Column) -> Column:
    """Code points of a text that belong to words."""
    return F.length(without(F.coalesce(text, F.lit("")), SPACE)).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(without(text, SYMBOLS))).cast("long")


def n_upper(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(without(text, _UPPER))).cast("long")


def n_letters(text: Column) -> Column:
    """Code points other than white space and ASCII digits, marks and symbols."""
    return F.length(without(F.coalesce(text, F.lit("")), _OTHER)).cast("long")


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def with_repeats(df: DataFrame, ws: str = "ws", needed: Column | None = None, out: str = "n_repeat_words") -> DataFrame:
    """Add the number of words inside a 3-word window that occurs twice or more in the list, the first time included.

    A window's hash and position go into one long (the position in the low bits);
    sorting brings equal windows together, and where the hashes of neighbours
    agree their words are compared.  The steps are columns of their own, so that
    sorting runs in generated code on primitive longs; the count comes out of a
    one-row generator, so that no filter on it is pushed below and inlined.  Where ``needed`` is
    false the count is 0 and its work is skipped.
    """
    w, high, low, s, at = (F.col(f"_{out}_{x}") if x else F.col(ws) for x in ("", "high", "low", "sorted", "at"))
    none = F.array().cast("array<bigint>")
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(w), F.lit(1)).cast("double")))).cast("long")
    go = F.size(w) >= 4 if needed is None else needed & (F.size(w) >= 4)

    def packed(x, i):
        key = F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
        return F.coalesce(key, F.lit(0).cast("long"))  # never null, and declared so: sorted as primitive longs

    def same(a, b):
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        equal = a.bitwiseAND(high) == b.bitwiseAND(high)
        for d in range(3):
            equal = equal & (F.get(w, i + d) == F.get(w, j + d))
        return equal

    repeats = F.filter(s, lambda v, j: same(v, F.get(s, j + 1)) | same(v, F.get(s, j - 1)))
    steps = F.transform(at, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, k + 1), x + 3) - x))
    own = [c for c in df.columns if c != out]
    return (df.withColumns({f"_{out}_high": -size, f"_{out}_low": size - 1})
            .withColumn(f"_{out}_sorted", F.when(go, F.sort_array(F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), packed))).otherwise(none))
            .withColumn(f"_{out}_at", F.sort_array(F.transform(repeats, lambda v: v.bitwiseAND(low))))
            .select(*own, F.explode(F.array(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))).alias(out)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an expression over a frame's columns and those that ``prepare`` adds to it."""
    name: str
    rejects: Column
    prepare: Callable[[DataFrame], DataFrame] | None = None


def measures(text: Column, ws: Column) -> dict[str, Column]:
    """The base counts of a text and its word list, but for the repeated words."""
    return {"n_words": F.size(ws).cast("long"), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text)}


def rules(text: Column, known: dict[str, Column] | None = None) -> list[Rule]:
    """The rules on a text alone.  ``known`` names columns that hold base counts already."""
    at = measures(text, words(text)) | (known or {})
    return [
        Rule("few_words", at["n_words"] < MIN_WORDS),
        Rule("symbols", 100 * at["n_symbols"] > SYMBOL_PCT * at["word_chars"]),
        Rule("upper_case", 100 * n_upper(text) > UPPER_PCT * at["word_chars"]),
        Rule("few_letters", 100 * n_letters(text) < LETTER_PCT * at["word_chars"]),
        Rule("long_words", at["word_chars"] > MAX_MEAN_WORD * at["n_words"]),
        Rule("dup_lines", let(_lines(text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > DUP_LINE_PCT * F.size(x))),
    ]


def repeat_rule(text: Column) -> Rule:
    """Texts most of whose words lie in repeated windows; ``prepare`` adds the word list and the count."""
    return Rule("repeats", 100 * F.col("n_repeat_words") > REPEAT_PCT * F.size("ws"), lambda df: with_repeats(df.withColumn("ws", words(text))))


def draw(docs: DataFrame, by: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """About ``sample_rows`` rows, written to one file; the same on every run, as a hash of ``by`` draws them.  None of an empty table."""
    total = docs.count()
    if not total:
        return None
    share = min(1.0, sample_rows / total)
    drawn = docs.where(F.pmod(F.xxhash64(by, F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return stored(drawn.repartition(1), "quality-sample")


def seconds(sample: DataFrame, found: list[Rule], by: Column, trials: int = TRIALS) -> list[float]:
    """Each rule's time on the sample beyond that of reading ``by``: the least of some runs, the rules taking turns."""
    jobs = [sample.agg(F.sum(F.length(by)))]
    jobs += [(r.prepare(sample) if r.prepare else sample).agg(F.count_if(r.rejects), F.sum(F.length(by))) for r in found]
    best = [float("inf")] * len(jobs)
    for _ in range(trials):
        for i, job in enumerate(jobs):
            again = job.select("*")   # a plan of its own: a plan that has run keeps its result
            began = time.perf_counter()
            again.collect()
            best[i] = min(best[i], time.perf_counter() - began)
    return [max(t - best[0], CLOCK) for t in best[1:]]


def greedy(costs: list[float], seen: list[tuple[int, int]]) -> list[int]:
    """Rules by rejections per cost, each among the rows that those before it let through.

    ``seen``: how many rows each set of rules (as bits) rejects together.  Ties go to the cheaper, then the earlier rule.
    """
    left, order, rest = seen, [], list(range(len(costs)))
    while rest:
        best = max(rest, key=lambda i: (sum(n for bits, n in left if bits >> i & 1) / costs[i], -costs[i], -i))
        order.append(best)
        rest.remove(best)
        left = [(bits, n) for bits, n in left if not bits >> best & 1]
    return order


def order_rules(docs: DataFrame, found: list[Rule], by: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of the cascade.

    The driver gets a row per set of rules that reject together (at most 2 to the
    number of rules, and no more than the sample has rows) and a time per rule.
    """
    by = F.col("text") if by is None else by
    with scratch(docs.sparkSession):
        sample = draw(docs, by, sample_rows)
        if sample is None:
            return found
        costs = seconds(sample, found, by)
        for r in found:
            sample = r.prepare(sample) if r.prepare else sample
        bits = sum((F.when(F.coalesce(r.rejects, F.lit(False)), 1 << i).otherwise(0) for i, r in enumerate(found)), F.lit(0))
        seen = [(r["bits"], r["n"]) for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()]
    return [found[i] for i in greedy(costs, seen)]


def verdict(ordered: list[Rule]) -> Column:
    """The first rule that rejects a text, null if none does; later rules are not evaluated."""
    out = F.when(ordered[0].rejects, F.lit(ordered[0].name))
    for r in ordered[1:]:
        out = out.when(r.rejects, F.lit(r.name))
    return out


def quality_filter(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    The repeated windows are counted where the cascade has them, for the rows that the rules before leave.
    """
    own = F.col("text")
    ordered = order_rules(docs.select("text"), [*rules(own), repeat_rule(own)], sample_rows=sample_rows)
    at = [r.name for r in ordered].index("repeats")
    left = docs.where(verdict(ordered[:at]).isNull()) if at else docs
    held = left.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row.text")
    counted = repeat_rule(text).prepare(held)
    # One condition, so that the rules after the count are not pushed below it.
    late = {r.name: r for r in [*rules(text), repeat_rule(text)]}
    return counted.where(verdict([late[r.name] for r in ordered[at:]]).isNull()).select("row.*")


def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    text = F.col("text")
    split = docs.select("doc_id", "text", words(text).alias("ws"))
    at = measures(text, F.col("ws"))
    based = split.select("doc_id", "text", "ws", *(c.alias(n) for n, c in at.items()))
    # The rules as they run below: on the counts that the contract wants of every text anyway.
    ordered = order_rules(based.select("text", *at), [r for r in rules(text, {n: F.col(n) for n in at}) if r.name != "few_words"])
    counted = with_repeats(based)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words"))
    return counted.select("doc_id", *at, "n_repeat_words", failed.alias("base_failed"),
                          F.when(failed, False).otherwise(verdict(ordered).isNull()).alias("kept"))
