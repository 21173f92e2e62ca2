"""Text functions as Columns: normal forms, keyword tests, spans with offsets, windows and lines around a span.

Patterns run on Java's engine. \\d, \\w and \\s are ASCII there; \\b looks at all letters and digits (of Unicode) in Java
17, so no match begins right after an accented letter. Offsets count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space that is cut off at a value's ends.
BLANKS = " \t\n\r\f\x0b"


def stripped(v: Column) -> Column:
    return F.btrim(v, F.lit(BLANKS))


def digits_only(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def compact_alnum(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "[^A-Za-z0-9]", ""))


def collapse(v: Column) -> Column:
    return stripped(F.regexp_replace(v, "\\s+", " "))


def upper_collapsed(v: Column) -> Column:
    return F.upper(collapse(v))


def phone_digits(v: Column) -> Column:
    d = digits_only(v)
    n = F.length(d)
    return F.when((n >= 11) & d.startswith("1"), F.substring(d, 2, 10)).when(n >= 10, F.substring(d, 1, 10)).otherwise(d)


def person_form(v: Column) -> Column:
    """Letters only, single blanks, upper case: the form that attribution compares names in."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z]+", " "), " +", " ")))


def keyword_pattern(words: list[str]) -> str:
    """Any of the keywords, not next to a letter or digit, blanks standing for any white space."""
    import re

    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join("\\s+".join(re.escape(p) for p in w.split()) for w in words) + ")(?![A-Za-z0-9])"


def contains_any(low: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds the first part of any of the words: a cheap test that no match of theirs fails."""
    heads = sorted({w.split()[0].lower() for w in words})
    # a head that holds another one as a part is told by that one
    heads = [h for h in heads if not any(o != h and o in h for o in heads)]
    if len(heads) == 1:
        return low.contains(heads[0])
    return F.exists(F.array(*[F.lit(h) for h in heads]), lambda h: F.contains(low, h))


def has_any(v: Column, words: list[str], low: Column | None = None) -> Column:
    """Whether any of the keywords is in v; low: v in lower case, where it is at hand."""
    return contains_any(F.lower(v) if low is None else low, words) & v.rlike(keyword_pattern(words))


def hits(v: Column, words: list[str], low: Column | None = None) -> Column:
    """The first text that each keyword matches, in the keywords' order; those without a match are left out."""
    if not words:
        return F.array().cast("array<string>")
    low = F.lower(v) if low is None else low
    found = [F.when(low.contains(w.split()[0].lower()), F.regexp_extract(v, keyword_pattern([w]), 0)).otherwise("") for w in words]
    return F.filter(F.array(*found), lambda x: x != "")


#: A private letter that marks the ends of matches; texts that hold it lose it to another one of the same length.
MARK, OTHER = "\ue000", "\ue001"


def spans(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, raw, span, whole>> of the pattern's matches from left to right; a group is always a match's end.

    One replacement marks the matches (and their groups), one split cuts there, and one fold over the parts adds up
    their lengths: a text is searched once, and a text without a match costs nothing more.
    """
    clean = F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)
    marked = F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}" + (f"${group}{MARK}" if group else ""))
    parts = F.split(marked, MARK, -1)
    empty = F.expr("cast(array() as array<struct<start:int,raw:string,span:string,whole:string>>)")
    kinds = 3 if group else 2  # a gap, a match, and the group that ends it
    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit("").alias("m"), empty.alias("out"))

    def step(acc, x):
        kind, n = acc["i"] % kinds, F.length(x)
        at = F.when(kind < 2, acc["at"] + n).otherwise(acc["at"])
        whole = F.when(kind == 1, x).otherwise(acc["m"])
        one = F.struct((at - n).cast("int").alias("start"), stripped(x).alias("raw"), x.alias("span"), whole.alias("whole"))
        return F.struct((acc["i"] + 1).alias("i"), at.cast("int").alias("at"), whole.alias("m"), F.when(kind == kinds - 1, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def window(text: Column, start: Column, end: Column, width: Column | int) -> Column:
    """The text from `width` before start to `width` after end, clipped."""
    w = F.lit(width) if isinstance(width, int) else width
    low = F.greatest(start - w, F.lit(0))
    return F.substr(text, low + 1, end + w - low)


def before(text: Column, start: Column, width: int) -> Column:
    low = F.greatest(start - width, F.lit(0))
    return F.substr(text, low + 1, start - low)


def line_prefix(text: Column, start: Column, near: int = 1000) -> Column:
    """The line from its begin to start. Only if it is longer than `near` is more of the text looked at."""
    some = before(text, start, near)
    whole = F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)
    return F.when((start <= near) | some.contains("\n"), F.substring_index(some, "\n", -1)).otherwise(whole)


def line_of(text: Column, start: Column, span: Column, near: int = 1000) -> Column:
    """From the line's begin to the first newline after the span, which may itself cross lines."""
    end = start + F.length(span) + 1
    some = F.substr(text, end, F.lit(near))
    rest = F.when((F.length(some) < near) | some.contains("\n"), F.substring_index(some, "\n", 1)).otherwise(F.substring_index(F.substr(text, end, F.length(text)), "\n", 1))
    return F.concat(line_prefix(text, start, near), span, rest)


def last_label(prefix: Column) -> Column:
    """The last `Label:` before the value, in lower case; empty without one."""
    labels = F.regexp_extract_all(prefix, F.lit("([A-Za-z][A-Za-z /'&()\\-]{1,40})\\s*:\\s*"), F.lit(1))
    return F.coalesce(F.lower(F.trim(F.get(labels, F.size(labels) - 1))), F.lit(""))


# A page's shapes and what they become, in this order.
HTML_STEPS = [
    ("(?is)<(script|style).*?>.*?</\\1>", " "),
    ("(?i)<br\\s*/?>", "\n"),
    ("(?i)</(p|div|li|tr|h1|h2|h3|h4|h5|h6)>", "\n"),
    ("(?i)<(p|div|li|tr|table|ul|ol|h1|h2|h3|h4|h5|h6)[^>]*>", "\n"),
    ("<[^>]+>", " "),
]
HTML_SPACE = [("\\r\\n?", "\n"), ("[ \\t\\f\\x0B]+", " "), ("\\n[ \\t]+", "\n"), ("\\n{3,}", "\n\n")]


def _entities() -> tuple[dict[str, str], list[str]]:
    """Named entities of HTML 5 that end with a semicolon, and the older ones that need none, longest first."""
    from html.entities import html5

    return {k[:-1]: v for k, v in html5.items() if k.endswith(";")}, sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def code_point(n: Column) -> Column:
    """The character of a code point; what stands for none is U+FFFD, and numbers of C1 controls are read as Windows-1252."""
    from html import unescape

    odd = {i: unescape(f"&#{i};") for i in range(128, 160)} | {0: "\ufffd", 13: "\r"}
    table = F.create_map(*[F.lit(x) for kv in odd.items() for x in kv])
    valid = (n < 0xD800) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(table, n.cast("int")), F.when(valid, char), F.lit("\ufffd"))


def unescaped(v: Column, bare: bool = True) -> Column:
    """Entities replaced: named ones (of HTML 5, and, if bare, the older ones without a semicolon), decimal and hexadecimal numbers."""
    names, short = _entities()
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    old = "^(" + "|".join(short) + ")"

    def one(x):
        """A part after an ampersand."""
        decimal, hexadecimal = F.regexp_extract(x, "^#([0-9]+);?", 1), F.regexp_extract(x, "^#[xX]([0-9a-fA-F]+);?", 1)
        name, without = F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(x, old, 1) if bare else F.lit("")
        number = F.when(decimal != "", F.coalesce(decimal.try_cast("long"), F.lit(1 << 40))).when(hexadecimal != "", F.coalesce(F.conv(F.right(hexadecimal, F.lit(12)), 16, 10).try_cast("long"), F.lit(1 << 40)))
        return (
            F.when(x.startswith("#"), F.coalesce(F.concat(code_point(number), F.regexp_replace(x, "^#([0-9]+|[xX][0-9a-fA-F]+);?", "")), F.concat(F.lit("&"), x)))
            .otherwise(F.coalesce(F.concat(F.try_element_at(table, F.nullif(name, F.lit(""))), F.substr(x, F.length(name) + 2, F.length(x))), F.concat(F.try_element_at(table, F.nullif(without, F.lit(""))), F.substr(x, F.length(without) + 1, F.length(x))), F.concat(F.lit("&"), x)))
        )

    first, rest = F.substring_index(v, "&", 1), F.slice(F.split(v, "&", -1), F.lit(2), F.lit(1 << 30))
    return F.when(v.contains("&"), F.concat(first, F.array_join(F.transform(rest, one), ""))).otherwise(v)


def html_text(html: Column, bare: bool = True) -> Column:
    """A page's text: scripts and styles dropped, blocks on lines of their own, entities replaced (bare: see unescaped()), blanks collapsed."""
    out = html
    for p, to in HTML_STEPS:
        out = F.regexp_replace(out, p, to)
    out = unescaped(out, bare)
    for p, to in HTML_SPACE:
        out = F.regexp_replace(out, p, to)
    return stripped(out)
