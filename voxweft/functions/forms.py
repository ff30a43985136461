"""Unicode forms and full case folding as column expressions.

Tables made of the standard library's character data are literals of the plan: a character's code point leads to a page of 256
entries, and a page that has any leads to them. Few texts need them: what a form may change is a class of characters,
and a text, or a stretch of one, without any is left as it is. The rest goes by the standard's three steps. Characters are
decomposed by the table; the text is split into stretches so that no mark is parted from what it stands on; and
in a stretch with marks these are sorted by their classes and, in composed forms, joined with what they stand on by a fold over the
stretch. So the work is linear in a text, and quadratic only in the marks on one character.

Defined cases: null stays null, an empty text empty. Characters that the library's version of the standard doesn't have stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
#: Parts of the tables' literals; no text holds them as a result of a mapping.
CUT = "\x01"
PAGE = 256


def characters() -> Iterable[str]:
    return (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)


@cache
def changed(form: str) -> dict[str, str]:
    """What single characters become in a form."""
    return {c: d for c in characters() if (d := unicodedata.normalize(form, c)) != c}


@cache
def classes() -> dict[str, str]:
    """The combining classes of marks, as text."""
    return {c: str(k) for c in characters() if (k := unicodedata.combining(c))}


@cache
def pairs() -> dict[str, dict[str, str]]:
    """By the second of two characters that compose: the first, and what they become. A character that its own parts compose to
    is made of its last part and what the others compose to."""
    out: dict[str, dict[str, str]] = {}
    for c, parts in changed("NFD").items():
        if len(parts) > 1 and unicodedata.normalize("NFC", c) == c:
            out.setdefault(parts[-1], {})[unicodedata.normalize("NFC", parts[:-1])] = c
    return out


def char_class(found: Iterable[str]) -> str:
    """A character class of a regular expression: a tree of ranges, of which a character meets only those it may be in."""
    points = sorted(map(ord, found))
    ranges: list[tuple[int, int]] = []
    for c in points:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], c)
        elif not ranges or c > ranges[-1][1]:
            ranges.append((c, c))

    def tree(part: list[tuple[int, int]]) -> str:
        whole = f"\\x{{{part[0][0]:x}}}-\\x{{{part[-1][1]:x}}}"
        if len(part) == 1:
            return f"[{whole}]"
        half = len(part) // 2
        return f"[{whole}&&[{tree(part[:half])}{tree(part[half:])}]]"

    return tree(ranges)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    """A function from a character to its entry, or null."""
    pages = sorted({ord(c) // PAGE for c in table})
    place = {p: k for k, p in enumerate(pages)}
    entries = [table.get(chr(p * PAGE + k) if not 0xD800 <= p * PAGE + k <= 0xDFFF else "", "") for p in pages for k in range(PAGE)]
    index = F.split(F.lit(CUT.join(str(place.get(p, "")) for p in range(pages[-1] + 1))), CUT)
    values = F.split(F.lit(CUT.join(entries)), CUT)

    def get(char: Column) -> Column:
        code = F.ascii(char)
        page = F.nullif(F.get(index, F.floor(code / PAGE).cast("int")), F.lit("")).cast("int")
        return F.nullif(F.get(values, page * PAGE + code % PAGE), F.lit(""))

    return get


def mapped(text: Column, table: dict[str, str]) -> Column:
    """Every character that the table has, replaced; only stretches of such characters are looked at one by one."""
    found, inner = lookup(table), char_class(table)

    def change(stretch: Column) -> Column:
        return F.array_join(F.transform(F.split(stretch, ""), lambda c: F.coalesce(found(c), c)), "")

    return stretches(text, inner, f"{inner}+|[^{inner}]+", change)


def stretches(text: Column, inner: str, part: str, change: Callable[[Column], Column], has: str | None = None) -> Column:
    """The text with each part that the pattern finds changed if it has a character of the class (or what ``has`` matches)."""
    has = has or inner
    # a pattern is compiled once for a task here, but for each value by split
    parts = F.regexp_extract_all(text, F.lit(part), F.lit(0))
    return F.when(text.rlike(has), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(has), change(p)).otherwise(p)), "")).otherwise(text)


def with_bases(text: Column, inner: str, change: Callable[[Column], Column], has: str | None = None) -> Column:
    """The text with each stretch of characters of the class changed, together with the character before it; only those in which
    ``has`` is found, if that is given."""
    return stretches(text, inner, f"[^{inner}]?{inner}+|[^{inner}]+(?=[^{inner}]{inner}|\\z)", change, has)


def sorted_marks(stretch: Column) -> Column:
    """(class, character) of a stretch in canonical order: marks by class within what stands between starters."""
    of = lookup(classes())
    coded = F.transform(F.split(stretch, ""), lambda c: F.struct(F.coalesce(of(c).cast("int"), F.lit(0)).alias("k"), c.alias("c")))
    return let(coded, by_class)


def by_class(coded: Column) -> Column:
    placed = F.transform(coded, lambda x, i: F.struct(F.size(F.filter(F.slice(coded, 1, i + 1), lambda y: y["k"] == 0)).alias("block"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c")))
    ordered = F.transform(F.array_sort(placed), lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c")))
    return F.when((F.size(coded) < 3) & (F.get(coded, F.lit(0))["k"] == 0), coded).otherwise(ordered)


def composed(ordered: Column) -> Column:
    """A stretch in canonical order as text, marks joined with their starters where the standard has a character for both."""
    firsts, made = (lookup({c: "".join(side(known)) for c, known in pairs().items()}) for side in (dict.keys, dict.values))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(s: Column, x: Column) -> Column:
        at = F.when((s["starter"] != "") & ((s["marks"] == "") | (s["last"] < x["k"])), F.instr(firsts(x["c"]), s["starter"]))
        joins, begins = F.coalesce(at, F.lit(0)) > 0, x["k"] == 0
        return F.struct(
            F.when(joins | ~begins, s["done"]).otherwise(F.concat(s["done"], s["starter"], s["marks"])).alias("done"),
            F.when(joins, F.substring(made(x["c"]), at, F.lit(1))).when(begins, x["c"]).otherwise(s["starter"]).alias("starter"),
            F.when(joins, s["marks"]).when(begins, F.lit("")).otherwise(F.concat(s["marks"], x["c"])).alias("marks"),
            F.when(joins, s["last"]).when(begins, 0).otherwise(x["k"]).alias("last"),
        )

    return F.aggregate(ordered, start, step, lambda s: F.concat(s["done"], s["starter"], s["marks"]))


@cache
def inner_class(form: str) -> str:
    """Characters that may change in a form or join with one before them."""
    return char_class({*changed(form), *classes(), *(pairs() if form.endswith("C") else ())})


@cache
def mark_class() -> str:
    return char_class({*classes(), *pairs()})


def with_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD."""
    if form not in FORMS:
        raise ValueError(f"{form} is none of {FORMS}")
    parts = changed("NFKD" if "K" in form else "NFD")
    join = composed if form.endswith("C") else lambda ordered: F.array_join(F.transform(ordered, lambda x: x["c"]), "")
    marks = mark_class() if form.endswith("C") else char_class(classes())

    def whole(stretch: Column) -> Column:
        return let(mapped(stretch, parts), lambda t: with_bases(t, marks, lambda p: join(sorted_marks(p)), None if form.endswith("C") else marks + marks))

    # the class leaves out what composed forms keep, so their stretches are few
    return let(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(with_bases(t, inner_class(form), whole) if form.endswith("C") else whole(t)))


@cache
def bare_letters() -> dict[str, str]:
    """What characters that decompose leave without their marks."""
    return {c: "".join(x for x in d if not unicodedata.category(x).startswith("M")) for c, d in changed("NFD").items()}


def without_marks(text: Column) -> Column:
    """The text decomposed, without marks. Their order doesn't matter as they go, so characters are replaced one by one, by a
    translation where one or none is left of them; the few others by the table."""
    table = bare_letters()
    several = {c: b for c, b in table.items() if len(b) > 1}
    single = sorted((c for c, b in table.items() if len(b) < 2), key=lambda c: -len(table[c]))
    bare = lambda t: F.regexp_replace(F.translate(mapped(t, several), "".join(single), "".join(table[c] for c in single)), r"\p{M}", "")
    return let(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(bare(t)))


@cache
def folds() -> dict[str, str]:
    return {c: f for c in characters() if (f := c.casefold()) != c}


def folded(text: Column) -> Column:
    """Full case folding: characters that fold to several by the table, all others by translation."""
    table = folds()
    several = {c: f for c, f in table.items() if len(f) > 1}
    single = {c: f for c, f in table.items() if len(f) == 1}
    return let(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(mapped(t, several), "".join(single), "".join(single.values()))))
