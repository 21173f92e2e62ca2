"""Entities: roll-up of attributed findings, merging of names that differ by a misreading, ids, risk scores, bands and regulations."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import RISK_WEIGHTS
from .attribution import file_of, name_from_email

NOBODY = "UNATTRIBUTED"
# Name spaces of version 5 ids (DNS, URL), and how alike two names have to be.
DNS, URL = "6ba7b8109dad11d180b400c04fd430c8", "6ba7b8119dad11d180b400c04fd430c8"
ALIKE, MOST_EDITS = 0.84, 2


def half_even(v: Column) -> Column:
    """Two places, halves of the decimal value to the even digit."""
    return F.bround(v, 2)


def running_mean(values: Column) -> Column:
    """The mean as it comes about finding by finding, cut to two places at each step."""
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"))
    return F.aggregate(values, start, lambda a, x: F.struct(half_even((a["mean"] * a["n"] + x) / (a["n"] + 1)).alias("mean"), (a["n"] + 1).alias("n")), lambda a: a["mean"])


def _in_order(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def roll_up(findings: DataFrame) -> DataFrame:
    """A row an entity_key: name, email, entity_type, confidence, names, emails, methods, evidence, files, n_findings, findings.

    Findings are taken in order of file, source, offset and rule; names and mailboxes are the first ones, lists keep the
    order of first sight, and the type is the last that is not PERSON. findings: array<struct> of what risk and reports ask for.
    """
    rows = findings.withColumn("file", file_of(F.col("source_ref")))
    kept = ["file", "source_ref", "char_offset", "rule_ord", "pii_type", "pii_category", "normalized_value", "redacted_value", "risk_level", "confidence", "hipaa", "ccpa", "pipeda", "notification_required"]
    item = F.struct(*kept, F.col("entity_name").alias("name"), F.col("entity_email").alias("email"), F.col("entity_type").alias("type"), F.col("attribution_confidence").alias("sure"), F.col("attribution_method").alias("method"), F.col("attribution_evidence").alias("evidence"))
    agg = rows.groupBy("entity_key").agg(F.array_sort(F.collect_list(item)).alias("f"))

    def each(c):
        return F.transform("f", lambda x: x[c])

    named = F.filter(each("name"), lambda n: n.isNotNull() & (n != NOBODY))
    types = F.filter(each("type"), lambda t: t != "PERSON")
    return agg.select(
        "entity_key", F.coalesce(F.get(named, F.lit(0)), F.get(each("name"), F.lit(0))).alias("name"), F.get(F.filter(each("email"), lambda e: e.isNotNull()), F.lit(0)).alias("email"),
        F.coalesce(F.element_at(F.when(F.size(types) > 0, types), -1), F.lit("PERSON")).alias("entity_type"), running_mean(each("sure")).alias("confidence"), _in_order(each("name")).alias("names"), _in_order(each("email")).alias("emails"),
        _in_order(each("method")).alias("methods"), _in_order(F.flatten(each("evidence"))).alias("evidence"), _in_order(each("file")).alias("files"), F.size("f").alias("n_findings"), F.col("f").alias("findings"),
    )


def may_be_one(a: Column, b: Column) -> Column:
    """The cheap tests of two names in person_form: as many parts, the same first letter, first and last part at most two edits apart."""
    x, y = F.split(a, " "), F.split(b, " ")
    ends = [(F.get(x, F.lit(0)), F.get(y, F.lit(0))), (F.element_at(x, -1), F.element_at(y, -1))]
    near = [F.levenshtein(p, q, MOST_EDITS) >= 0 for p, q in ends]
    return (F.size(x) >= 2) & (F.size(x) == F.size(y)) & (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & near[0] & near[1]


def likeness(a: Column, b: Column) -> Column:
    """The gestalt ratio of two texts, which Spark has no function for."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return run(a, b)


def variants(records: DataFrame) -> DataFrame:
    """a, b: entity_keys of records whose names may be misreadings of one another, the better record first.

    Names meet by their first letter, number of parts, and a part (the first or last) of which two misread letters at
    most are left out: a name of one letter less or more, or with one letter changed, has a key in common with the
    right one. Each key is a small group, and what meets in it is tested in full.
    """
    rows = records.filter((F.col("entity_type") == "PERSON") & F.col("name").isNotNull() & (F.col("name") != NOBODY))
    rows = rows.select("entity_key", "email", T.person_form(F.col("name")).alias("form"), priority().alias("rank")).filter(F.size(F.split("form", " ")) >= 2)
    words = F.split("form", " ")

    def fewer(w):
        """The part without any one letter, and as it is."""
        return F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w)))))

    def least(w):
        """The part without any two letters, too."""
        return F.array_distinct(F.flatten(F.transform(fewer(w), fewer)))

    head = F.concat_ws("|", F.size(words).cast("string"), F.left("form", F.lit(1)))
    keys = F.transform(least(F.element_at(words, -1)), lambda k: F.concat_ws("|", head, k))
    dealt = rows.select("*", F.explode(F.array_distinct(keys)).alias("key"))
    pairs = dealt.alias("x").join(dealt.alias("y"), "key").filter((F.col("x.rank") > F.col("y.rank")) | ((F.col("x.rank") == F.col("y.rank")) & (F.col("x.entity_key") < F.col("y.entity_key"))))
    pairs = pairs.filter(may_be_one(F.col("x.form"), F.col("y.form")) & (F.col("x.email").isNull() | F.col("y.email").isNull() | (F.col("x.email") == F.col("y.email"))))
    pairs = pairs.select(F.col("x.entity_key").alias("a"), F.col("y.entity_key").alias("b"), F.col("x.form").alias("p"), F.col("y.form").alias("q")).distinct()
    return pairs.filter(likeness(F.col("p"), F.col("q")) >= ALIKE).select("a", "b")


def priority() -> Column:
    """What makes a record the one that others are merged into."""
    return F.struct(F.col("email").isNotNull(), F.size("files"), F.col("n_findings"), F.col("confidence"), F.length(F.coalesce("name", F.lit(""))))


def merged(records: DataFrame) -> DataFrame:
    """records with those that are variants of a better one folded into it, as `entity_key` of the better one.

    In order of priority each record goes to the first kept one that it may be. Only records with a variant are
    settled, a task taking those of one first letter and number of parts, past which no variant goes.
    """
    pairs = variants(records)
    some = pairs.select(F.explode(F.array("a", "b")).alias("entity_key")).distinct()
    few = records.join(some, "entity_key").select("entity_key", "email", priority().alias("rank"), F.concat(F.left(T.person_form(F.col("name")), F.lit(1)), F.size(F.split(T.person_form(F.col("name")), " ")).cast("string")).alias("letter"))
    links = pairs.groupBy(F.col("b").alias("entity_key")).agg(F.collect_list("a").alias("better"))
    rows = few.join(links, "entity_key", "left")

    def settle(t: pa.Table) -> pa.Table:
        got = sorted(t.to_pylist(), key=lambda r: r["entity_key"])
        got.sort(key=lambda r: tuple(r["rank"].values()), reverse=True)
        kept: dict[str, str | None] = {}
        out = []
        for r in got:
            better = set(r["better"] or [])
            # a kept record has the mailbox of the first of its variants that has one
            to = next((k for k, mail in kept.items() if k in better and not (mail and r["email"] and mail != r["email"])), None)
            if to is None:
                kept[r["entity_key"]] = r["email"]
            elif not kept[to]:
                kept[to] = r["email"]
            out.append((r["entity_key"], to or r["entity_key"]))
        return pa.table({"entity_key": pa.array([a for a, _ in out], pa.string()), "into": pa.array([b for _, b in out], pa.string())})

    into = rows.groupBy("letter").applyInArrow(settle, "entity_key string, into string")
    whole = records.join(into, "entity_key", "left").withColumn("into", F.coalesce("into", "entity_key"))
    own = F.struct((F.col("into") != F.col("entity_key")).alias("later"), priority().alias("rank"), *[c for c in records.columns])
    got = whole.groupBy(F.col("into").alias("_key")).agg(F.sort_array(F.collect_list(own), asc=False).alias("_all"))
    # the record itself stands first, the others after it in order of priority
    got = got.withColumn("_all", F.concat(F.filter("_all", lambda r: ~r["later"]), F.filter("_all", lambda r: r["later"])))
    first = F.get("_all", F.lit(0))

    def every(c):
        return F.array_distinct(F.flatten(F.transform("_all", lambda r: r[c])))

    def step(a, r):
        n, m = a["n"] + r["n_findings"], r["n_findings"]
        both = (a["sure"] * F.greatest(F.lit(1), n - m) + r["confidence"] * F.greatest(F.lit(1), m)) / F.greatest(F.lit(1), n)
        return F.struct(half_even(F.greatest(a["sure"], both)).alias("sure"), n.alias("n"))

    rest = F.slice("_all", F.lit(2), F.size("_all"))
    sure = F.aggregate(rest, F.struct(first["confidence"].alias("sure"), first["n_findings"].alias("n")), step, lambda a: a["sure"])
    mails = F.filter(F.transform("_all", lambda r: r["email"]), lambda e: e.isNotNull())
    return got.select(
        F.col("_key").alias("entity_key"), first["name"].alias("name"), F.get(mails, F.lit(0)).alias("email"), first["entity_type"].alias("entity_type"), sure.alias("confidence"), every("names").alias("names"), every("emails").alias("emails"),
        every("methods").alias("methods"), every("evidence").alias("evidence"), every("files").alias("files"), F.size(every("findings")).alias("n_findings"), every("findings").alias("findings"),
    )


def uuid5(space: str, name: Column) -> Column:
    """The version 5 UUID of a name in a name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "utf-8")))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part[0], F.lit("-"), part[1], F.lit("-5"), part[2], F.lit("-"), variant, part[3], F.lit("-"), part[4])


def person_id(email: Column, name: Column, key: Column) -> Column:
    """From the mailbox, else the name; what has neither gets one from its key, so that runs agree."""
    return F.when(email.isNotNull(), uuid5(DNS, email)).when(name.isNotNull() & (name != NOBODY), uuid5(URL, T.person_form(name))).otherwise(uuid5(URL, key))


def persons(findings: DataFrame) -> DataFrame:
    """The entities of attributed findings: rolled up, merged, named, with person_id."""
    rows = merged(roll_up(findings))
    name = F.coalesce(F.nullif("name", F.lit("")), name_from_email(F.col("email")), F.lit(NOBODY))
    return rows.withColumn("person_id", person_id(F.col("email"), F.col("name"), F.col("entity_key"))).withColumn("name", name)


def risk_of(people: DataFrame) -> DataFrame:
    """people with the columns of risk() of their findings."""
    rows = people.select("entity_key", F.inline("findings"))
    return people.join(risk(rows), "entity_key", "left")


def weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RISK_WEIGHTS.items() for x in kv]), kind), F.lit(1.0))


def risk(findings: DataFrame, entity: str = "entity_key") -> DataFrame:
    """entity, risk_score, risk_band, hipaa, ccpa, pipeda, notification_required.

    The first of each (type, value) weighs in full and its repeats 15 %, by clamped confidence. Two aggregates with
    partial sums: of each value, then of each entity with conditional flags.
    """
    rows = findings.withColumn("_w", weight(F.col("pii_type")) * F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col("confidence"))))
    order = F.struct("source_ref", "char_offset", "rule_ord")
    flags = ("hipaa", "ccpa", "pipeda", "notification_required")
    values = rows.groupBy(entity, "pii_type", "normalized_value").agg(F.min_by(F.struct("_w", "risk_level"), order).alias("_f"), F.sum("_w").alias("_sum"), *[F.bool_or(c).alias(c) for c in flags])
    first = F.col("_f._w")

    def any_of(*kinds):
        return F.bool_or(F.col("pii_type").isin(*kinds))

    agg = values.groupBy(entity).agg(
        F.sum(first + (F.col("_sum") - first) * 0.15).alias("base"), F.count(F.when(F.col("_f.risk_level") == "HIGH", 1)).alias("n_high"), F.count("*").alias("n_unique"),
        *[any_of(*v).alias(k) for k, v in {"ssn": ["SSN"], "sin": ["SIN"], "card": ["CREDIT_CARD"], "mbi": ["MEDICARE"], "dob": ["DOB"], "addr": ["ADDRESS"], "bank": ["BANK_ACCOUNT", "IBAN"]}.items()],
        *[F.bool_or(c).alias(f"any_{c}") for c in flags],
    )
    # every record carries a name, so the identity conditions that a name meets hold for all
    score = F.col("base")
    for when, factor in (("ssn", 2.0), ("sin", 2.0), ("card", 2.0), ("mbi", 2.0), ("dob AND addr", 1.5), ("bank", 1.5), ("n_high >= 3", 1.8), ("n_unique >= 5", 1.3), ("any_hipaa", 1.2)):
        score = F.when(F.expr(when), score * factor).otherwise(score)
    out = agg.withColumn("exact", score)
    band = F.when(F.col("exact") >= 18, "CRITICAL").when(F.col("exact") >= 9, "HIGH").when(F.col("exact") >= 4, "MEDIUM").when(F.col("exact") >= 1, "LOW").otherwise("NONE")
    out = out.withColumn("risk_band", band)
    return out.select(
        entity, (F.floor(F.col("exact") * 100 + 0.5) / 100).alias("risk_score"), "risk_band", (F.col("any_hipaa") & F.col("risk_band").isin("HIGH", "CRITICAL")).alias("hipaa"),
        (F.col("any_ccpa") & (F.col("risk_band") != "NONE")).alias("ccpa"), (F.col("any_pipeda") & F.col("risk_band").isin("MEDIUM", "HIGH", "CRITICAL")).alias("pipeda"), F.col("any_notification_required").alias("notification_required"),
    )
