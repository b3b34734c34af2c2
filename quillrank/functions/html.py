"""HTML -> text as column expressions.

The job a tree parser does for this data is re-expressed as a fixed chain of
regular expressions that Spark runs in the JVM:

1. comments, ``<script>`` and ``<style>`` bodies go (their text is not text);
   an unclosed one ends with the text;
2. every remaining tag becomes one space (so ``a<b>b</b>`` reads ``a b``); a
   ``>`` in a quoted attribute value does not end it; a ``<`` without a later ``>`` is text;
3. character references are decoded, ``&amp;`` last so ``&amp;lt;`` stays ``&lt;``;
   numeric ones also without their ``;``, named ones only with it;
4. whitespace runs collapse to one space and the ends are trimmed.

Code blocks (``<pre>``, with or without ``<code>``) are pulled out first; an
unclosed one ends with the text.  Inside a block tags vanish without a space and only the outer whitespace is trimmed.
Nested ``<pre>`` is not handled (needs a real parser).  A ``<pre`` whose tag the text cuts off is an empty block.

Every pattern takes time in proportion to the text, whatever is left open in it.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrank.functions.core import let

# All named character references that end in a semicolon, from the standard
# library's table.  ``amp`` is applied last, separately.
NAMED_ENTITIES = sorted((name[:-1], text) for name, text in html5.items()
                        if name.endswith(";") and name.lower() != "amp;")

# Comments, script and style bodies in one left-to-right pass: whichever
# construct opens first is removed whole (a comment marker inside a script is
# script text, and the reverse).
NON_TEXT_RE = (r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*(?:>.*?(?:</script\s*>|\z)|\z)"
               r"|style\b[^>]*(?:>.*?(?:</style\s*>|\z)|\z))")
# Runs are possessive: a quote that is never closed is looked for once, and a tag of any length needs no stack.
TAG_RE = r"""<[A-Za-z/!?][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
PRE_RE = r"(?is)<pre\b[^>]*(?:>(.*?)(?:</pre\s*>|\z)|\z)"
# What each construct of NON_TEXT_RE and PRE_RE begins with.
BLOCK_RE = r"(?i)<(?:pre|!--|script|style)"
# White space beyond ASCII; the range around it settles most characters.
WIDE_SPACE_RE = r"[\x85-\u3000&&[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
# What the UTF-8 of U+2000 to U+203F begins with, and the rest of that white space.
GENERAL_PUNCTUATION = b"\xe2\x80"
WIDE_SPACES = ("\x85", "\xa0", "\u1680", "\u205f", "\u3000")
DEC_REF_RE = r"&#([0-9]+);"
HEX_REF_RE = r"&#[xX]([0-9a-fA-F]+);"
NAMED_REF_RE = r"&([A-Za-z][A-Za-z0-9]{1,31});"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _codepoint_to_char(n: Column) -> Column:
    """Code point (bigint) -> one-character string, via a UTF-32 round trip."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _replace_refs(s: Column, pattern: str, radix: int, end: str = ";") -> Column:
    """Replace every numeric reference matching ``pattern`` (digits in group 1) that closes with ``end``;
    longer ones first, so that without an end none is taken for the beginning of another."""
    def step(acc, digits):
        short = F.ltrim(digits, F.lit("0"))  # leading zeros carry nothing; 8 digits are beyond Unicode
        cp = F.when(F.length(short).between(1, 7), F.conv(short, radix, 10).cast("bigint")).otherwise(0)
        ok = (cp > 0) & (cp <= 0x10FFFF) & ~((cp >= 0xD800) & (cp <= 0xDFFF))
        char = F.when(ok, _codepoint_to_char(cp)).otherwise(F.lit("\ufffd"))
        out = F.replace(acc, F.concat(F.lit("&#x" if radix == 16 else "&#"), digits, F.lit(end)), char)
        return F.replace(out, F.concat(F.lit("&#X"), digits, F.lit(end)), char) if radix == 16 else out

    def found(v):
        refs = F.array_distinct(F.regexp_extract_all(v, F.lit(pattern), 1))
        return refs if end else F.array_sort(refs, lambda a, b: F.length(b) - F.length(a))

    return let(s, lambda v: F.aggregate(found(v), v, step))


def _replace_numeric(s: Column) -> Column:
    """Numeric references, closed ones first."""
    def body(v):
        out = _replace_refs(_replace_refs(v, DEC_REF_RE, 10), HEX_REF_RE, 16)
        out = let(out, lambda w: F.when(F.instr(w, "&#") > 0, _replace_refs(_replace_refs(
            w, DEC_REF_RE.rstrip(";"), 10, ""), HEX_REF_RE.rstrip(";"), 16, "")).otherwise(w))
        return F.when(F.instr(v, "&#") > 0, out).otherwise(v)

    return let(s, body)


def _replace_named(s: Column) -> Column:
    # One string literal, which the optimizer folds to a constant map.
    table = F.str_to_map(F.lit("\x02".join(f"{name}\x01{text}" for name, text in NAMED_ENTITIES)),
                         F.lit("\x02"), F.lit("\x01"))

    def step(acc, name):
        ch = F.try_element_at(table, name)
        return F.when(ch.isNotNull(), F.replace(acc, F.concat(F.lit("&"), name, F.lit(";")), ch)
                      ).otherwise(acc)

    return let(s, lambda v: F.aggregate(
        F.array_distinct(F.regexp_extract_all(v, F.lit(NAMED_REF_RE), 1)), v, step))


def decode_entities(col) -> Column:
    """Decode named and numeric character references; ``&amp;`` last.

    One regex pass finds the names present; only those are replaced, so text
    full of bare ``&`` costs one scan, not one per known entity.
    """
    def body(s):
        out = _replace_numeric(_replace_named(s))
        out = F.regexp_replace(out, "&(?:amp|AMP);", "&")
        # Most text carries no '&': skip the work for it.
        return F.when(_holds(s, "&"), out).otherwise(s)

    return let(_c(col), body)


def _holds(col: Column, *parts: str) -> Column:
    """Whether any part is in a text, by plain scans, which take a fraction of a pattern's time."""
    return reduce(or_, (F.contains(col, F.lit(p)) for p in parts))


def plain_spaces(col) -> Column:
    """Every Unicode white space character as a space.  Patterns run only on text that holds rare ones, or bytes that those
    beyond ASCII begin with."""
    def body(v):
        out = (F.when(_holds(v, "\t", "\x0b", "\x0c", "\r"), F.regexp_replace(v, r"[\t-\r]", " "))
               .when(_holds(v, "\n"), F.replace(v, F.lit("\n"), F.lit(" "))).otherwise(v))
        rare = _holds(v, *WIDE_SPACES) | F.contains(v.cast("binary"), F.lit(GENERAL_PUNCTUATION))
        return F.when(F.octet_length(v) == F.length(v), out).when(rare, F.regexp_replace(out, WIDE_SPACE_RE, " ")).otherwise(out)

    return let(_c(col), body)


def single_spaces(col) -> Column:
    """``re.sub(r'\\s+', ' ', s)`` with Unicode whitespace; most text has no run of it left to search for."""
    return let(plain_spaces(col), lambda v: F.when(_holds(v, "  "), F.regexp_replace(v, " {2,}", " ")).otherwise(v))


def collapse_ws(col) -> Column:
    """``re.sub(r'\\s+', ' ', s).strip()`` with Unicode whitespace."""
    return F.trim(single_spaces(col))


def _inner(col: Column) -> Column:
    """What one paragraph holds; other text as it is.  It is cut by bytes, as characters would have to be counted."""
    inner = F.substring(col.cast("binary"), F.lit(4), F.octet_length(col) - 7).cast("string")
    return F.when(F.startswith(col, F.lit("<p>")) & F.endswith(col, F.lit("</p>")), inner).otherwise(col)


def replace_tags(col, by: str) -> Column:
    """Every tag replaced.  Behind the last ``>`` there is none, so no search for one starts there; nor in one paragraph
    of plain text."""
    def search(v):
        tail = F.substring_index(v, ">", -1)
        return F.concat(F.regexp_replace(F.left(v, F.length(v) - F.length(tail)), TAG_RE, by), tail)

    def body(v):
        return let(_inner(v), lambda w: F.when(_holds(w, "<"), search(v)).when(w == v, v).otherwise(
            F.concat(F.lit(by), w, F.lit(by))))

    return let(_c(col), body)


def has_blocks(col) -> Column:
    """Whether a text may hold code, a comment, a script or a style: one pass that spares the rest theirs."""
    s = F.coalesce(_c(col), F.lit(""))
    return _holds(_inner(s), "<") & s.rlike(BLOCK_RE)


def html_to_text(col, blocks: Column | None = None) -> Column:
    """Tags -> separators, entities decoded, whitespace collapsed and trimmed.  ``blocks``: ``has_blocks``, if known."""
    s = F.coalesce(_c(col), F.lit(""))
    text = F.regexp_replace(s, NON_TEXT_RE, " ")
    s = replace_tags(text if blocks is None else F.when(blocks, text).otherwise(s), " ")
    return collapse_ws(decode_entities(s))


def html_code_blocks(col) -> Column:
    """Every ``<pre>`` block's text (tags dropped without a space, trimmed)."""
    s = F.coalesce(_c(col), F.lit(""))
    blocks = F.regexp_extract_all(s, F.lit(PRE_RE), 1)
    return F.transform(blocks, lambda b: F.regexp_replace(
        decode_entities(replace_tags(b, "")), r"(?U)^\s+|\s+$", ""))


def html_without_code(col) -> Column:
    """The HTML with each ``<pre>`` block replaced by `` [CODE] ``."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), PRE_RE, " [CODE] ")
