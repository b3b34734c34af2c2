"""Column -> Column scalar functions.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.core import let
from quillrank.functions.html import decode_entities, html_to_text, html_code_blocks  # noqa: F401

# Java regex for "any Unicode whitespace run"; Python's str.split() splits on
# the same class (bar the four ASCII separator controls 0x1c-0x1f).
WS = r"(?U)\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    """``text.split()``: whitespace tokens, no empties (built-in array_remove
    rather than a lambda filter, so it stays in generated code)."""
    return F.array_remove(F.split(_c(col), WS), "")


def bm25_tokens(col) -> Column:
    """Lower-case, whitespace split; punctuation stays attached."""
    return tokens(F.lower(_c(col)))


def token_count(col) -> Column:
    """Number of whitespace tokens."""
    return F.size(tokens(col))


def truncate_tokens(col, n: int | None, always_rejoin: bool = False) -> Column:
    """Keep the first ``n`` tokens.

    Text with ``n`` tokens or fewer is returned unchanged (its spacing kept)
    unless ``always_rejoin`` is set, which is the prompt-context form.
    """
    c = _c(col)
    if n is None:
        return c
    if always_rejoin:
        return F.array_join(F.slice(tokens(c), 1, n), " ")
    return let(c, lambda s: let(tokens(s), lambda toks: F.when(
        F.size(toks) > n, F.array_join(F.slice(toks, 1, n), " ")).otherwise(s)))


def strip_unicode(col) -> Column:
    """Python ``str.strip()`` -- drops leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


# Numeric text as Python's float() reads it (no underscores, no type suffix).
_NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def safe_int(col) -> Column:
    """``int(float(str(v)))`` as a BIGINT with any failure -> 0 (truncates toward 0)."""
    s = F.trim(_c(col).cast("string"))
    parsed = F.when(s.rlike(_NUMERIC), s.try_cast("double"))
    as_int = F.when(parsed.isNotNull() & ~F.isnan(parsed)
                    & (F.abs(parsed) < F.lit(2.0 ** 63)), parsed.cast("bigint"))
    return F.coalesce(as_int, F.lit(0).cast("bigint"))


def md5_hex(col) -> Column:
    """Stable id = md5 hex of the (string) key."""
    return F.md5(_c(col).cast("string"))


def md5_to_uuid(col) -> Column:
    """32 hex digits -> canonical 8-4-4-4-12 UUID string."""
    return F.regexp_replace(_c(col), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def url_for(col, base: str = "https://stackoverflow.com/q/") -> Column:
    """P5."""
    return F.concat(F.lit(base), _c(col).cast("string"))


def date_prefix(col) -> Column:
    """``CreationDate[:10]``; missing -> ''."""
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, 10)


def tags_to_array(col) -> Column:
    """P10: ``'<python><async-io>'`` -> ['python', 'async-io']; blanks dropped."""
    return F.filter(F.split(F.coalesce(_c(col), F.lit("")), "[<>]"),
                    lambda x: strip_unicode(x) != F.lit(""))


def embedding_text(title, tags_list, prose, max_tokens: int | None = 512) -> Column:
    """``TITLE: t | TAGS: a b | ANSWER: prose`` cut to ``max_tokens``."""
    raw = F.concat(F.lit("TITLE: "), _c(title), F.lit(" | TAGS: "),
                   F.array_join(_c(tags_list), " "), F.lit(" | ANSWER: "), _c(prose))
    return truncate_tokens(raw, max_tokens)


def pair_text(title, prose) -> Column:
    """``trim(title + ' ' + prose)`` with missing -> ''."""
    return strip_unicode(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "),
                                  F.coalesce(_c(prose), F.lit(""))))


def strip_fences(col) -> Column:
    """``strip().removeprefix('```json').removeprefix('```').removesuffix('```').strip()``."""
    s = strip_unicode(_c(col))
    s = F.when(s.startswith("```json"), F.substring(s, 8, 1 << 30)).otherwise(s)
    s = F.when(s.startswith("```"), F.substring(s, 4, 1 << 30)).otherwise(s)
    s = F.when(s.endswith("```"), F.substring(s, F.lit(1), F.length(s) - F.lit(3))).otherwise(s)
    return strip_unicode(s)


def parse_rewrites(raw, question) -> Column:
    """Model output -> sub-queries.

    A non-empty JSON array gives its elements trimmed with blanks (and JSON
    nulls) dropped -- possibly an empty list; anything else falls back to
    ``[question]``.
    """
    arr = F.from_json(strip_fences(raw), "array<string>", {"mode": "PERMISSIVE"})
    cleaned = F.filter(F.transform(arr, lambda x: strip_unicode(x)),
                       lambda x: x.isNotNull() & (x != F.lit("")))
    return F.when(arr.isNotNull() & (F.size(arr) > 0), cleaned).otherwise(
        F.array(_c(question)))


def clamp_score(v: Column) -> Column:
    """``max(1, min(5, int(v)))``; null / NaN stay null (least/greatest skip
    nulls, so the guard matters).  Clamping before the truncation is the same
    for every input and cannot overflow the int cast."""
    return F.when(v.isNotNull() & ~F.isnan(v),
                  F.floor(F.greatest(F.lit(1.0), F.least(F.lit(5.0), v))).cast("int"))


def judge_struct(raw) -> Column:
    """Judge output -> struct(relevance, accuracy, completeness, reasoning).

    Not JSON, or JSON that is not an object -> null scores and 'judge error'.
    Numbers given as strings ("3") count, as Python's json would not give a
    number there -- they are coerced, then clamped.
    """
    v = F.try_parse_json(strip_fences(raw))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def num(k):
        return clamp_score(F.try_variant_get(v, f"$.{k}", "double"))

    ok = F.struct(num("relevance").alias("relevance"), num("accuracy").alias("accuracy"),
                  num("completeness").alias("completeness"),
                  F.try_variant_get(v, "$.reasoning", "string").alias("reasoning"))
    bad = F.struct(F.lit(None).cast("int").alias("relevance"),
                   F.lit(None).cast("int").alias("accuracy"),
                   F.lit(None).cast("int").alias("completeness"),
                   F.lit("judge error").alias("reasoning"))
    return F.when(is_obj, ok).otherwise(bad)


def clip_upper(col, bound) -> Column:
    """P25: ``clip(upper=bound)`` keeping nulls null."""
    c = _c(col)
    return F.when(c.isNotNull(), F.least(c, F.lit(bound)))


def try_double(col) -> Column:
    """P26."""
    return _c(col).try_cast("double")


def year_of(col) -> Column:
    """Year of a date string, unparseable -> null."""
    return F.year(F.try_to_timestamp(_c(col)))


def left(col, n: int) -> Column:
    """P22."""
    return F.substring(_c(col), 1, n)
