"""Validators as boolean Columns, and the parsing of dates of birth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_alnum, digits_only


def luhn(v: Column) -> Column:
    d = digits_only(v)
    return F.coalesce((F.length(d) >= 2) & F.call_function("luhn_check", d), F.lit(False))


def aba(v: Column) -> Column:
    d = digits_only(v)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), F.lit(0))
    return F.coalesce((F.length(d) == 9) & (total % 10 == 0), F.lit(False))


def sin(v: Column) -> Column:
    d = digits_only(v)
    return (F.length(d) == 9) & ~d.startswith("0") & luhn(d)


def npi(v: Column) -> Column:
    d = digits_only(v)
    return (F.length(d) == 10) & luhn(F.concat(F.lit("80840"), d))


def iban(v: Column) -> Column:
    c = compact_alnum(v)
    turned = F.concat(F.substr(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    value = F.filter(F.split(turned, ""), lambda x: x != "")
    rest = F.aggregate(value, F.lit(0), lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97).cast("int"))
    return F.coalesce(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}$") & (rest == 1), F.lit(False))


def _kinds(v: Column) -> Column:
    return F.size(F.array_distinct(F.split(v, "")))


def bank_account(v: Column) -> Column:
    d = digits_only(v)
    return F.length(d).between(6, 17) & ~d.rlike("^(.)\\1*$")


def passport(v: Column) -> Column:
    c = compact_alnum(v)
    return F.length(c).between(6, 12) & c.rlike("[0-9]")


def drivers_license(v: Column) -> Column:
    c = compact_alnum(v)
    return F.length(c).between(5, 20) & c.rlike("[0-9]") & ~c.rlike("^([0-9])\\1*$")


def mrn_shape(v: Column) -> Column:
    c = compact_alnum(v)
    return F.length(c).between(5, 12) & (digits_only(c) != "")


def mrn(v: Column) -> Column:
    return mrn_shape(v) & ~digits_only(v).rlike("^(.)\\1*$")


# Words that no token of a name may be.
NAME_STOP_WORDS = (
    "account address benefits birth card code compliance credential date details diagnosis dob documentation ein for full home intake login "
    "member mobile mrn ndc npi number packet patient personal phone provider record records review routing tax verification"
).split()


def full_name(v: Column) -> Column:
    tokens = F.split(F.trim(v), "\\s+")
    stop = F.array(*[F.lit(w) for w in NAME_STOP_WORDS])
    plain = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "^['.-]+|['.-]+$", "")))
    return F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike("^[A-Za-z][A-Za-z'.-]{0,30}$")) & ~F.arrays_overlap(plain, stop)


def date_of_birth(v: Column) -> Column:
    """The date of any of ten forms, or null; years 1800 to 2100, and two-digit ones from 69 on in the 1900s."""
    s = F.regexp_replace(F.regexp_replace(F.trim(v), ",", ""), "\\s+", " ")
    titled = F.initcap(s)
    short = F.regexp_replace(s, "^([0-9]{1,2})([/-])([0-9]{1,2})[/-]([0-9]{2})$", "$4$2$1$2$3")
    century = F.when(short.rlike("^[0-9]{2}[/-]") & (short != s), F.concat(F.when(F.substring(short, 1, 2).try_cast("int") >= 69, F.lit("19")).otherwise(F.lit("20")), short))
    found = F.coalesce(
        *[F.try_to_date(F.when(s.rlike(p), s), f) for p, f in (("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"))],
        F.try_to_date(F.regexp_replace(century, "/", "-"), "yyyy-M-d"),
        *[F.try_to_date(F.when(titled.rlike(p), titled), f) for p, f in (("^[A-Z][a-z]{3,} [0-9]{1,2} [0-9]{4}$", "MMMM d yyyy"), ("^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$", "MMM d yyyy"), ("^[0-9]{1,2} [A-Z][a-z]{3,} [0-9]{4}$", "d MMMM yyyy"), ("^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$", "d MMM yyyy"))],
    )
    return F.when(F.year(found).between(1800, 2100), found)


def dob(v: Column) -> Column:
    return date_of_birth(v).isNotNull()


def dob_iso(v: Column) -> Column:
    return F.coalesce(F.date_format(date_of_birth(v), "yyyy-MM-dd"), F.trim(v))
