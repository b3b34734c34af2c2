"""Surrogates for personal data.

Detected entities (e-mail addresses, phone numbers, payment cards, IPv4
addresses, national ids, secrets, names after a title) get keyed replacements of
their own type: digits become digits and letters letters of the same case and
script, separators, country codes and lengths stay, card numbers keep a valid
check digit if they had one, and a given name is replaced by one of the same
gender and script.  One entity, however it is spelt (case, separators), has one
surrogate in all documents; a person's family name has one surrogate with or
without the given name.  A name is what follows one title or several: initials,
particles and any number of words, of which the last is the family name.  Its words
are replaced wherever else they stand capitalised in the same text, too.  A phone
number is known by all its digits, of which the first are the country's code.

The distinct entities of the corpus form a table.  Each draws a candidate from
its key; a candidate that is itself an entity of the corpus, or that another
entity has, is drawn again with the next attempt, until all differ.  Only
documents with an entity are joined with the table; the others pass unchanged.

Defined cases: null and empty texts pass as they are; repeated rows get equal
texts; extra columns pass through; rows with a null ``doc_id`` are treated like
any other.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.common import documents, map_slices, stored

KEY = b"quillrank-surrogates"

# Titles by gender, and given names by script and gender.
TITLES = {"m": ["mr", "herr", "señor", "monsieur", "господин"], "f": ["mrs", "ms", "miss", "frau", "señora", "madame", "госпожа"], "n": ["dr", "prof"]}
GIVEN = {
    "latin": {"m": ["James", "Robert", "David", "Thomas", "Daniel", "Pierre", "Carlos", "Hans", "Luis", "Peter"],
              "f": ["Mary", "Linda", "Sarah", "Laura", "Anna", "Marie", "Carmen", "Julia", "Elena", "Sophie"]},
    "cyrillic": {"m": ["Иван", "Сергей", "Андрей", "Дмитрий", "Павел"], "f": ["Анна", "Мария", "Елена", "Ольга", "Наталья"]},
    "greek": {"m": ["Νίκος", "Γιώργος", "Δημήτρης"], "f": ["Μαρία", "Ελένη", "Κατερίνα"]},
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_GENDER = {n.lower(): g for names in GIVEN.values() for g, own in names.items() for n in own} | {t: g for g, own in TITLES.items() for t in own}

_TITLE = "|".join(form for own in TITLES.values() for t in own for form in (t.capitalize(), t.upper()))
_UPPER = r"[^\W\d_a-zа-яα-ωß-öø-ÿ]"
#: A title or a suffix is no name word; a possessive s is no part of one.
_NAME = rf"(?!(?:{_TITLE}|Jr|Sr|II|III|IV|PhD|MD)\b){_UPPER}(?:[^\W\d_]+|['’][^\W\d_]{{2,}})(?:[-'’](?![sS]\b)[^\W\d_]+)*"
_INITIAL = rf"{_UPPER}(?:\.-?|(?= ))"
_PARTICLE = r"(?:(?:von|van|vom|zu|zur|de|del|della|di|da|do|dos|das|du|la|le|der|den|ter|ten|bin|ibn|al|el|y) |d['’])"
_FULL = rf"(?:{_INITIAL} ?|{_PARTICLE})*{_NAME}(?: (?:{_INITIAL} ?|{_PARTICLE})*{_NAME})*"
#: The words of a full name: an initial, or a word that is not a particle.
_PARTS = re.compile(rf"{_PARTICLE}|(?P<word>{_NAME})|(?P<initial>{_UPPER})")
_BARE = re.compile(rf"(?<!\w)(?:(?<!\w[-'’])|(?<=\bd['’])){_NAME}(?!\w)")
#: Country calling codes of two digits; those that start with 1 or 7 have one, the others three.
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: A mailbox from its run's first letter or digit on.  A run is tried once, where it begins, so long runs without an @ cost their length.
_EMAIL = r"[_.%+-]*+(?P<email>[^\W_](?:[\w.%+-]*[\w])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w]))"
_EMAIL_HERE = re.compile(_EMAIL)
PATTERN = re.compile(
    rf"(?<![\w.%+-]){_EMAIL}"
    r"|(?P<secret>(?:(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9]))|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,})\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\d])|(?<![\d.])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d))"
    rf"|(?P<name>\b(?:{_TITLE})\b\.?(?: (?P<last>{_TITLE})\b\.?)*(?: (?P<full>{_FULL}))?)"  # titles alone are passed over
)
#: A text without any of these holds no entity.  A digit of any script counts, also one that only Python's newer Unicode knows (Cn).
MAYBE = (r"[@\p{Nd}\p{Cn}]", "AKIA|gh[pousr]_|[0-9A-Fa-f]{32}", "(?=[" + "".join(sorted({t[0] for t in _TITLE.split("|")})) + f"])({_TITLE})\\.? ")


def may_hold(text):
    return F.coalesce(text.rlike(MAYBE[0]) | text.rlike(MAYBE[1]) | text.rlike(MAYBE[2]), F.lit(False))


def _digits(found: str) -> str:
    """The digits of a text, as ASCII."""
    return "".join(str(int(c)) for c in found if c.isdecimal())


def _country(found: str) -> str:
    """The country code of a phone number as it is written, with its plus sign and a trunk "(0)" after it."""
    if not found.startswith("+"):
        return ""
    digits = _digits(found[:12])
    size = 1 if digits[:1] in ("1", "7") else 2 if digits[:2] in _TWO else 3
    m = re.match(rf"\+(?:\D*\d){{{size}}}(?:[ .-]?\(0\))?", found)
    return m.group() if m else ""


def normal(kind: str, value: str) -> str:
    """The spelling that all forms of an entity share."""
    if kind in ("email", "secret", "given", "family", "initial"):
        return value.lower()
    if kind == "phone":
        code = _country(value)
        return ("+" + _digits(code.partition("(")[0]) if code else "") + "|" + _digits(value[len(code):])
    return _digits(value) if kind != "ip" else ".".join(map(_digits, value.split(".")))


def _matches(text: str):
    """The pattern's matches that are entities.  After each one, a mailbox may go on in the middle of its run."""
    at = 0
    while m := PATTERN.search(text, at):
        at = m.end()
        bare = m.group("name") is not None and m.group("full") is None
        if not bare:
            yield m
        start = m.start("last") if bare and m.group("last") else m.start() if bare else at
        if here := _EMAIL_HERE.match(text, start):
            yield here
            at = here.end()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, normal form of the entities of a text, in order; a name gives a part for each of its words."""
    out, names = [], {}
    for m in _matches(text or ""):
        kind = "email" if m.group("email") is not None else next(
            k for k in ("secret", "ip", "phone", "ssn", "card", "name") if m.group(k) is not None)
        if kind != "name":
            out.append((*m.span(kind), kind, normal(kind, m.group(kind))))
            continue
        parts = [x for x in _PARTS.finditer(text, m.start("full"), m.end("full")) if x.lastgroup]
        words = [x for x in parts if x.lastgroup == "word"]
        titles = re.findall(r"[^\W\d_]+", text[m.start():m.start("full")].lower())
        gender = next((g for w in (words[0].group().lower(), *titles) if (g := _GENDER.get(w, "n")) != "n"), "n")
        for x in parts:
            if x.lastgroup == "initial":
                role = "initial"
            elif x is words[-1]:
                role = "family"
            else:
                role = f"given-{_GENDER.get(x.group().lower(), gender)}"
            value = normal(role.split("-")[0], x.group())
            out.append((x.start(), x.end(), role, value))
            if role != "initial" and (role == "family" or value not in names):
                names[value] = role
    return _with_bare(text, out, names) if names else out


def _with_bare(text: str, found: list[tuple[int, int, str, str]], names: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """The entities and, between them, the words of the text's names where they stand without a title."""
    out, at = [], 0
    for entity in [*found, (len(text), len(text), "", "")]:
        for m in _BARE.finditer(text, at, entity[0]):
            value = m.group().lower()
            if value in names:
                out.append((m.start(), m.end(), names[value], value))
        if entity[2]:
            out.append(entity)
        at = entity[1]
    return out


class _Stream:
    """Numbers drawn from a key, an entity and an attempt."""

    def __init__(self, key: bytes, *parts):
        self.key, self.seed, self.left, self.n = key, "\x1f".join(map(str, parts)).encode(), b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(x, "big") % n


def script(word: str) -> str:
    for name, alphabet in ALPHABETS.items():
        if any(c in alphabet for c in word.lower()):
            return name
    return "latin"


def _letters(value: str, rng: _Stream) -> str:
    """Letters of the same script, digits for digits; the rest stays."""
    return "".join(ALPHABETS[script(c)][rng.below(len(ALPHABETS[script(c)]))] if c.isalpha() else str(rng.below(10)) if c.isdigit() else c
                   for c in value)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def candidate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate's normal form.  After every eight attempts a name or mailbox is a letter longer: short ones are few."""
    rng = _Stream(key, kind, value, attempt)
    longer = attempt // 8
    if kind == "email":  # the local part; the domain becomes a reserved one of the same depth
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return _letters(local + ALPHABETS[script(local)][0] * longer, rng) + "@" + ".".join([_letters(x, rng) for x in labels[:-1]] + ["example" if len(labels) > 1 else "invalid"])
    if kind == "secret":
        digits = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", value) else ALPHABETS["latin"] + "0123456789"
        return "".join(digits[rng.below(len(digits))] if c.isalnum() else c for c in value)
    if kind == "ip":
        return ".".join(str(1 + rng.below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + "".join(str(rng.below(10)) for _ in value[2:])
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if luhn(value) else str((int(last) + 1 + rng.below(9)) % 10))
    if kind == "family":
        return _letters(value + ALPHABETS[script(value)][0] * longer, rng)
    if kind.startswith("given-"):
        gender, own = kind[-1], GIVEN[script(value)]
        names = own[gender] if gender in own else own["m"] + own["f"]
        base = names[rng.below(len(names))].lower()
        return base if attempt < 3 else base + "-" + _letters(value + ALPHABETS[script(value)][0] * longer, rng)  # the list is short: then a double name
    code, bar, rest = value.rpartition("|")  # phone, ssn
    return code + bar + "".join(str(rng.below(10)) for _ in rest)


def initial(letter: str, key: bytes) -> str:
    """The surrogate of an initial: the next letter of its script in keyed order, so two never share one."""
    alphabet = ALPHABETS[script(letter)]
    order = sorted(alphabet, key=lambda c: hmac.new(key, f"initial\x1f{c}".encode(), hashlib.sha256).digest())
    return order[(order.index(letter) + 1) % len(order)] if letter in alphabet else order[_Stream(key, "initial", letter).below(len(order))]


def fitted(kind: str, found: str, surrogate: str) -> str:
    """The surrogate in the format of one mention: its separators and letter case; a phone keeps its country code."""
    if kind in ("phone", "ssn", "card"):
        code = _country(found) if kind == "phone" else ""
        digits = iter(surrogate.rpartition("|")[2])
        return code + "".join(chr(ord(c) - int(c) + int(next(digits))) if c.isdecimal() else c for c in found[len(code):])
    if kind == "ip":
        zero = next(ord(c) - int(c) for c in found if c.isdecimal())
        return "".join(chr(zero + int(c)) if c.isdecimal() else c for c in surrogate)
    if found.isupper():
        return surrogate.upper()
    if kind == "family" or kind.startswith("given"):
        return "-".join(x[:1].upper() + x[1:] for x in surrogate.split("-"))
    if len(found) == len(surrogate):
        return "".join(s.upper() if f.isupper() else s for f, s in zip(found, surrogate))
    return surrogate


_ENTITY = "kind string, value string"


def entities(found: DataFrame) -> DataFrame:
    """The distinct entities of the scanned texts (column ``_found``)."""
    return found.select(F.explode("_found").alias("e")).select("e.kind", "e.value").distinct()


def _drawn(left: DataFrame, attempt: int, key: bytes) -> DataFrame:
    def run(batches):
        for batch in batches:
            kinds, values = (batch.column(c).to_pylist() for c in ("kind", "value"))
            made = [candidate(k, v, attempt, key) for k, v in zip(kinds, values)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array(made, pa.string())], ["kind", "value", "surrogate"])

    return left.select("kind", "value").mapInArrow(run, _ENTITY + ", surrogate string")


def assign(found: DataFrame, key: bytes = KEY, rounds: int = 64) -> DataFrame:
    """kind, value, surrogate: distinct within a kind, and none of them an entity of its kind in the corpus.

    Each round keeps the least entity of each free candidate; the
    others draw again.  Where the corpus holds nearly every value of a format, no
    free one is left: after ``rounds`` such entities trade values among themselves.
    """
    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    found = stored(found.withColumn("pool", group), "entities")
    taken, left, done = found.select("pool", F.col("value").alias("surrogate")), found, None
    for attempt in range(rounds):
        drawn = _drawn(left, attempt, key).withColumn("pool", group)
        free = drawn.join(taken, ["pool", "surrogate"], "left_anti")
        won = stored(free.groupBy("pool", "surrogate").agg(F.min(F.struct("kind", "value")).alias("w")).select("w.*", "surrogate", "pool"), "surrogates")
        done = won if done is None else done.unionAll(won)
        taken = taken.unionAll(won.select("pool", "surrogate"))
        left = stored(left.join(won, ["kind", "value"], "left_anti"), "entities")
        if left.isEmpty():
            return done.select("kind", "value", "surrogate")
    return done.unionAll(_rotated(left, key)).select("kind", "value", "surrogate")


def _rotated(left: DataFrame, key: bytes) -> DataFrame:
    """For entities whose format the corpus has used up: each takes the next one's value, in keyed order.

    Only numbers come here.  A group shares the kind, the country code, the length
    and all digits but the last six, so a window holds a million values at most.
    None of these values has been given away before, so all surrogates still differ.
    """
    digits = F.substring_index("value", "|", -1)
    group = ["kind", F.length("value"), F.expr("left(value, greatest(0, length(value) - 6))"),
             F.when(F.col("value").contains("|"), F.substring_index("value", "|", 1)), F.length(digits)]
    turn = Window.partitionBy(*group).orderBy(F.sha2(F.concat(F.lit(key.hex()), "value"), 256))
    after = F.coalesce(F.lead("value").over(turn), F.first("value").over(turn))
    alone = F.when(after == F.col("value"), F.raise_error(F.lit("an entity found no free surrogate")))
    moved = left.select("kind", "value", F.coalesce(alone.cast("string"), after).alias("surrogate"), "pool")
    return moved


def replace(text: str, table: dict[tuple[str, str], str], key: bytes = KEY) -> str:
    out, at = [], 0
    for start, end, kind, value in find(text):
        out += [text[at:start], fitted(kind, text[start:end], initial(value, key) if kind == "initial" else table[kind, value])]
        at = end
    return "".join(out) + text[at:]


def pseudonymise(docs: DataFrame, key: bytes = KEY, counts: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``counts`` also ``n_entities``.

    Equal texts have equal entities, so a text's digest keys its part of the
    surrogate table; the texts themselves move once, and only those with an entity.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    docs_ = docs.select(packed.alias("row"), "text")   # other columns travel by place, so their names cannot clash
    maybe = may_hold(F.col("text"))
    row = f"row {docs_.schema['row'].dataType.simpleString()}, text string"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def mentions(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({(k, v) for _, _, k, v in find(t) if k != "initial"}) for t in batch.column("text").to_pylist()]
        found = pa.array([[{"kind": k, "value": v} for k, v in x] for x in found], kind)
        return pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_found"])

    scanned = stored(map_slices(docs_.where(maybe), mentions, row + ", _found array<struct<kind:string,value:string>>"), "mentions")
    table = assign(entities(scanned), key)
    held = scanned.where(F.size("_found") > 0).withColumn("_key", F.sha2("text", 256))
    parts = held.select("_key", F.explode("_found").alias("e")).select("_key", "e.kind", "e.value").distinct()
    tables = stored(parts.join(table, ["kind", "value"]).groupBy("_key").agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias("_table")), "surrogates-by-text")

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, owns = batch.column("text").to_pylist(), batch.column("_table").to_pylist()
        new = [replace(t, {(x["kind"], x["value"]): x["surrogate"] for x in own}, key) for t, own in zip(texts, owns)]
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        return batch.select(["row", "text", "n"])

    joined = held.withColumn("n", F.size("_found")).drop("_found").join(tables, "_key")
    changed = map_slices(joined, rewrite, row + ", n int")
    bare = scanned.where(F.size("_found") == 0).select("row", "text").unionAll(docs_.where(~maybe))
    result = changed.unionAll(bare.withColumn("n", F.lit(0)))
    place = {c: F.col("row")[f"c{i}"] for i, c in enumerate(others)}
    columns = [place.get(c, F.col("text")).alias(c) for c in docs.columns]
    return result.select(*columns, *([F.col("n").alias("n_entities")] if counts else []))


def op7(spark, sf_dir):
    return pseudonymise(documents(spark, sf_dir), counts=True).select("doc_id", "text", "n_entities")
