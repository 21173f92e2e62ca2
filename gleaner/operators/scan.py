"""Scanning sources for findings: spans, suppression, filters, validation, confidence, redaction, dedupe.

Everything is generated from the rule table as Columns. Spans of all rules are one array, exploded once; what a span
needs (its windows and line) is worked out once a finding, and each rule's tests stand in the arm of a CASE on the
rule, so a plan holds only the rules asked for. Nulls and empty texts have no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import FAKE_MAILBOXES, FAKE_VALUES, LIKELY_NAME, RULES, TEST_MARKERS, WORDS, Rule


def chosen(types: list[str] | None) -> list[tuple[int, Rule]]:
    return [(i, r) for i, r in enumerate(RULES) if types is None or r.type in types]


def _case(rules, f, otherwise=None) -> Column:
    out = None
    for i, r in rules:
        v = f(r)
        if v is None:
            continue
        out = F.when(F.col("rule") == i, v) if out is None else out.when(F.col("rule") == i, v)
    if out is None:
        return F.lit(otherwise)
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def _of_rule(i: int):
    return lambda s, k: F.struct(F.lit(i).alias("rule"), k.alias("match_ord"), s["start"].alias("start"), s["raw"].alias("raw"), s["span"].alias("span"))


# Words (in lower case) of which a text holds one if a rule's shape can match in it at all.
CUES = {
    "routing_number": ["routing", "aba", "transit"], "account_number": ["account", "acct", "checking", "savings"], "passport_number": ["passport", "passeport"],
    "drivers_license_number": ["driver", "driving"], "medical_record_number": ["mrn", "med", "record"], "national_provider_identifier": ["npi", "national"],
    "employer_identification_number": ["ein", "employer", "federal"], "full_name": ["name", "owner", "patient", "employee", "member", "student", "borrower", "applicant", "customer", "client", "insured", "subscriber", "dependent", "guarantor", "spouse", "child", "parent"],
}
#: Marks that a text holds if a shape can match in it, by the shape's type and place; cheaper than the shapes.
MARKS = {("EMAIL", 0): "@", ("DOB", 2): "\\d,?\\s+(?:19|20)\\d{2}\\b", ("DOB", 3): "\\d,?\\s+(?:19|20)\\d{2}\\b", ("DOB", 4): "[A-Za-z]\\s+(?:19|20)\\d{2}\\b"}
#: So many rules with CUES make up for a text in lower case.
CUED = 3
#: How far around a span its lines are looked for before the whole text is, and how far its windows go.
REACH, NEAR = 1000, 200


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly where its files may have fewer splits than the cluster has cores; a large table stays where it is.

    A scan costs far more than moving a text, and a file of one row group would else be one task.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < 2 * cores << 27 else df


def candidates(sources: DataFrame, ref: str = "source_ref", text: str = "text", types: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref, text, the columns to keep, rule, match_ord, start, raw, span of each match of each rule's shapes; blank ones left out."""
    rows = spread(sources.select(F.col(ref).alias("source_ref"), F.col(text).alias("text"), *keep).filter(F.length("text") > 0))
    none = F.expr("cast(array() as array<struct<rule:int,match_ord:int,start:int,raw:string,span:string>>)")
    cued = sum(r.subtype in CUES for _, r in chosen(types)) >= CUED
    rows = held(rows, low=F.lower(F.col("text"))) if cued else rows
    arrays = []
    for i, r in chosen(types):
        for k, p in enumerate(r.patterns):
            found = F.transform(T.spans(F.col("text"), "(?im)" + p, r.group), _of_rule(i))
            mark = MARKS.get((r.type, k))
            may = F.col("text").rlike(mark) if mark else T.contains_any(F.col("low"), CUES[r.subtype]) if cued and r.subtype in CUES else None
            arrays.append(found if may is None else F.when(may, found).otherwise(none))
    found = rows.select("source_ref", "text", *keep, F.explode(F.concat(*arrays)).alias("m"))
    return found.select("source_ref", "text", *keep, "m.*").filter("raw <> ''").withColumn("end", F.col("start") + F.length("span"))


def held(rows: DataFrame, **cols: Column) -> DataFrame:
    """rows with cols worked out once: a generator of one row, which no filter is pushed below and no later use inlines."""
    return rows.withColumn("_held", F.explode(F.array(F.struct(*[v.alias(k) for k, v in cols.items()])))).select("*", "_held.*").drop("_held")


def is_test_data(around: Column, raw: Column, real: bool = False) -> Column:
    """Whether a value is marked as made up in what stands around it (NEAR letters, in lower case), or (not if real) is a known fake."""
    marked = F.exists(F.array(*[F.lit(m) for m in TEST_MARKERS]), lambda m: F.contains(around, m))
    if real:
        return marked
    return marked | F.lower(F.regexp_replace(raw, "[^A-Za-z0-9@]", "")).isin(FAKE_VALUES) | F.lower(raw).isin(FAKE_MAILBOXES)


def generic_mailbox(v: Column) -> Column:
    local = F.lower(F.trim(F.substring_index(v, "@", 1)))
    core = F.regexp_replace(local, "[^a-z0-9]+", "")
    return local.isin(*WORDS["generic_mailbox"]) | core.isin(*WORDS["generic_mailbox"]) | local.rlike("^(?:" + "|".join(WORDS["generic_part"]) + ")") | core.rlike("|".join(WORDS["generic_part"]))


def personal_mailbox(v: Column) -> Column:
    low = F.lower(F.trim(v))
    local, domain = F.substring_index(low, "@", 1), F.substr(low, F.instr(low, "@") + 1, F.length(low))
    chunks = F.filter(F.split(local, "[._+-]+"), lambda c: c.rlike("^\\p{L}{2,}$"))
    webmail = domain.isin(*WORDS["webmail"])
    return low.contains("@") & ~generic_mailbox(low) & (local != "") & (domain != "") & ((F.size(chunks) >= 2) | (webmail & local.rlike("[._+-]")) | (webmail & local.rlike("^[a-z]{3,}[0-9]{0,4}$")))


def _near(rules) -> dict[str, Column]:
    """What the filters look at of a span's surroundings, by rule: of a test for many words each word would cut it out anew."""
    about, at, to = F.col("_about"), F.col("_at"), F.col("_to")
    wide = {"dob": 48, "email": 96}
    names = {"dob": 72, "email": 96, "phone": 72}

    def of(f):
        return _case([(i, r) for i, r in rules if r.keep in names], f).cast("string")

    return {
        "around_l": of(lambda r: F.lower(T.collapse(T.window(about, at, to, wide[r.keep]))) if r.keep in wide else None),
        "before_l": of(lambda r: F.lower(T.collapse(T.before(about, at, 56))) if r.keep == "email" else None),
        "names": of(lambda r: T.window(about, at, to, names[r.keep])),
    }


def _filters() -> dict[str, Column]:
    """Each filter's test of a row that holds line_l and window_l (line and window in lower case, blanks collapsed) and _near()."""
    line, window, label, raw = F.col("line_l"), F.col("window_l"), F.col("label"), F.col("raw")
    around, prefix, named = F.col("around_l"), F.col("before_l"), F.col("names").rlike(LIKELY_NAME)

    def has(v, k):
        return T.has_any(v, list(WORDS[k]), v)

    def either(k):
        return has(line, k) | has(window, k)

    person = has(prefix, "email_person") | has(line, "email_person") | either("record") | has(around, "record") | named | has(label, "email_person")
    service = has(prefix, "email_service") | either("email_service") | has(label, "email_service")
    header = label.isin("from", "to", "cc", "bcc", "reply to", "reply-to", "sender") | F.col("line").rlike("(?i)^\\s*(from|to|cc|bcc|reply[- ]to|sender)\\s*:")
    generic, personal = generic_mailbox(raw), personal_mailbox(raw)
    return {
        "ssn": F.when(either("ssn_label"), True).when(either("ssn_negative") | either("bank_negative"), False).otherwise(raw.contains("-") | raw.contains(" ")),
        "bank": either("bank_positive") | label.isin("checking", "savings"),
        "dob": F.when(has(label, "dob_explicit"), True).when((label == "date") | has(label, "dob_negative"), False).when(has(around, "dob_explicit"), True).when(has(around, "dob_negative"), False)
        .otherwise(either("dob_record") & (named | F.col("line").rlike("[|\\t,]"))),
        "email": F.when(person & ~generic, True).when(service | header, False).when(has(label, "email_label") | has(label, "email_person"), personal | ~generic)
        .when(has(prefix, "email_label") & ~has(prefix, "email_service"), personal | ~generic).otherwise(personal),
        "phone": F.when(has(label, "phone_label"), True).when(either("phone_negative"), either("record") | named).otherwise(True),
        "ipv4": F.when(has(line, "ip_label") & has(line, "ip_person"), True).when(either("ip_negative"), False).otherwise(either("ip_label") & either("ip_person")),
    }


def redacted(raw: Column, kind: Column) -> Column:
    d, n = T.digits_only(raw), F.length(raw)
    local = F.substring_index(raw, "@", 1)
    domain = F.substr(raw, F.instr(raw, "@") + 1, n)
    return (
        F.when(kind == "SSN", F.when(F.length(d) >= 4, F.concat(F.lit("XXX-XX-"), F.right(d, F.lit(4)))).otherwise("XXX-XX-XXXX"))
        .when(kind == "SIN", F.when(F.length(d) >= 3, F.concat(F.lit("XXX-XXX-"), F.right(d, F.lit(3)))).otherwise("XXX-XXX-XXX"))
        .when(kind == "CREDIT_CARD", F.when(F.length(d) >= 4, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))).otherwise("****-****-****-****"))
        .when(kind == "BANK_ACCOUNT", F.lit("****-ACCOUNT-****"))
        .when(kind == "EMAIL", F.when(~raw.contains("@"), "***@***.***").when(F.length(local) <= 1, F.concat(F.lit("*@"), domain)).otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.length(local) - 1), F.lit("@"), domain)))
        .when(kind == "PHONE", F.lit("(XXX) XXX-XXXX"))
        .when(kind.isin("DOB", "ZIP", "ADDRESS", "PASSPORT", "DRIVERS_LICENSE", "MRN", "FULL_NAME"), F.concat(F.lit("[REDACTED:"), kind, F.lit("]")))
        .when(n > 4, F.concat(F.substring(raw, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(raw, F.lit(2))))
        .otherwise(F.repeat(F.lit("*"), n))
    )


def excerpt(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    around = F.concat(F.lit("..."), T.before(text, start, 80), replacement, F.substr(text, end + 1, F.lit(80)), F.lit("..."))
    return F.left(T.collapse(around), F.lit(320))


def _round2(v: Column) -> Column:
    return F.floor(v * 100 + 0.5) / 100


def scored(found: DataFrame, types: list[str] | None = None, follow_up: bool = False, keep: tuple[str, ...] = (), real: bool = False) -> DataFrame:
    """Findings of candidates that pass suppression, filters, validation, context and threshold.

    real: the values are known to be none of the made-up ones, so those that look like them (123456789, an MRN of one
    digit) are findings too.
    """
    rules = chosen(types)
    # a long text is cut at a span once; what stands around the span is looked at in that part
    start, span = F.col("start"), F.col("span")
    rows = held(found, _part=T.window(F.col("text"), start, F.col("end"), REACH))
    rows = held(rows, _about=T.window(F.col("_part"), F.least(start, F.lit(REACH)), F.least(start, F.lit(REACH)) + F.length(span), NEAR))
    rows = held(rows, _about_l=F.lower("_about"), _at=F.least(start, F.lit(NEAR)), _to=F.least(start, F.lit(NEAR)) + F.length(span))
    rows = rows.filter(~is_test_data(F.col("_about_l"), F.col("raw"), real))
    width = _case(rules, lambda r: F.lit(r.width), 100)
    part, place = F.col("_part"), F.least(start, F.lit(REACH))
    so_far, after = F.left(part, place), F.substr(part, place + F.length(span) + 1, F.length(part))
    before = F.when((start <= REACH) | so_far.contains("\n"), F.substring_index(so_far, "\n", -1)).otherwise(T.line_prefix(F.col("text"), start))
    whole = (F.length(after) < REACH) | after.contains("\n")
    line = F.when(whole, F.concat(before, span, F.substring_index(after, "\n", 1))).otherwise(T.line_of(F.col("text"), start, span))
    rows = held(rows, line=line, window=T.window(F.col("_about"), F.col("_at"), F.col("_to"), width), prefix=before)
    rows = held(rows, line_l=F.lower(T.collapse(F.col("line"))), window_l=F.lower(T.collapse(F.col("window"))), label=T.last_label(F.col("prefix")), **_near(rules))
    filters = _filters()
    passed = _case(rules, lambda r: filters[r.keep] if r.keep else None, True)
    valid = _case(rules, lambda r: (r.shape if real and r.shape else r.valid)(F.col("raw")) if r.valid else None, True)
    rows = held(rows, ok=passed & valid).filter("ok").drop("ok")
    none = F.array().cast("array<string>")
    told = {}
    for k, (v, a) in {"strong": ("line", "strong"), "near": ("window", "context")}.items():
        cases = [(i, r) for i, r in rules if getattr(r, a)]
        told[k] = F.coalesce(_case(cases, lambda r, v=v, a=a: T.hits(F.col(v), list(getattr(r, a)), F.col(f"{v}_l"))), none) if cases else none
    against = [(i, r) for i, r in rules if r.negative]
    both = lambda r: F.array_distinct(F.concat(*[T.hits(F.col(v), list(r.negative), F.col(f"{v}_l")) for v in ("line", "window")]))
    rows = held(rows, **told, against=F.coalesce(_case(against, both), none) if against else none)
    if follow_up:
        rows = held(rows, anywhere=_case(rules, lambda r: T.hits(F.col("text"), list(r.strong))), around=_case(rules, lambda r: T.hits(F.col("text"), list(r.context))))
        rows = rows.withColumn("anywhere", F.when(F.size("anywhere") > 0, F.col("anywhere")).otherwise(F.col("around"))).drop("around")
    else:
        rows = rows.withColumn("anywhere", none)
    n = {k: F.size(k) for k in ("strong", "near", "against", "anywhere")}
    conf = _case(rules, lambda r: F.lit(r.base)) + _case(rules, lambda r: F.lit(0.08) if r.valid else None, 0.0)
    conf = F.when(n["strong"] > 0, conf + F.least(F.lit(0.18), n["strong"] * 0.06)).when(n["near"] > 0, conf + F.least(F.lit(0.1), n["near"] * 0.04)).when(n["anywhere"] > 0, conf + F.least(F.lit(0.05), n["anywhere"] * 0.02)).otherwise(conf)
    conf = F.when(n["against"] > 0, conf - F.when(n["strong"] > 0, F.least(F.lit(0.08), n["against"] * 0.04)).otherwise(F.least(F.lit(0.24), n["against"] * 0.08))).otherwise(conf)
    evidence = F.concat(
        F.when(_case(rules, lambda r: F.lit(True) if r.valid else None, False), F.array(F.lit("validated"))).otherwise(none),
        F.when(n["strong"] > 0, F.array(F.concat(F.lit("label:"), F.get("strong", F.lit(0))))).when(n["near"] > 0, F.array(F.concat(F.lit("context:"), F.get("near", F.lit(0))))).when(n["anywhere"] > 0, F.array(F.concat(F.lit("followup-context:"), F.get("anywhere", F.lit(0))))).otherwise(none),
        F.when(n["against"] > 0, F.array(F.concat(F.lit("negative:"), F.get("against", F.lit(0))))).otherwise(none),
        F.array(F.lit("qa_followup_scan")) if follow_up else none,
    )
    needs = _case(rules, lambda r: F.lit(True) if r.needs_context else None, False)
    rows = rows.filter(~needs | (n["strong"] + n["near"] + n["anywhere"] > 0))
    rows = held(rows, **{"normalized_value": _case(rules, lambda r: r.normal(F.col("raw"))), "exact": F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), "evidence": evidence, "pii_type": _case(rules, lambda r: F.lit(r.type))})
    least = _case(rules, lambda r: F.lit(r.least)) - (0.04 if follow_up else 0.0)
    rows = rows.filter((F.col("normalized_value") != "") & (F.col("exact") >= least))
    method = _case(rules, lambda r: F.when(n["strong"] > 0, F.lit(r.method if "context" in r.method else r.method + "+context")).otherwise(F.lit(r.method)))
    rows = rows.withColumn("redacted_value", redacted(F.col("raw"), F.col("pii_type")))
    flag = {k: _case(rules, lambda r, j=j: F.lit(r.flags[j] == "Y")) for j, k in enumerate(("hipaa", "ccpa", "pipeda", "notification_required"))}
    return rows.select(
        "source_ref", "pii_type", _case(rules, lambda r: F.lit(r.category)).alias("pii_category"), _case(rules, lambda r: F.lit(r.subtype)).alias("pii_subtype"), _case(rules, lambda r: F.lit(r.risk)).alias("risk_level"),
        "redacted_value", excerpt(F.col("_about"), F.col("_at"), F.col("_to"), F.col("redacted_value")).alias("excerpt"), F.col("start").alias("char_offset"), _round2(F.col("exact")).alias("confidence"),
        (F.concat(method, F.lit("+followup")) if follow_up else method).alias("detection_method"), *[v.alias(k) for k, v in flag.items()], "normalized_value", "evidence", F.col("rule").alias("rule_ord"), "match_ord", *keep,
    )


def deduped(findings: DataFrame) -> DataFrame:
    """The best finding of each source, type and value (names: and offset): confidence, evidence, offset, rule order."""
    value = F.when(F.col("pii_type") == "FULL_NAME", F.concat("normalized_value", F.lit("@"), F.col("char_offset").cast("string"))).otherwise(F.col("normalized_value"))
    best = Window.partitionBy("source_ref", "pii_type", value).orderBy(F.desc("confidence"), F.desc(F.size("evidence")), "char_offset", "rule_ord", "match_ord")
    return findings.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def scan(sources: DataFrame, ref: str = "source_ref", text: str = "text", types: list[str] | None = None, follow_up: bool = False, real: bool = False) -> DataFrame:
    """All findings of the sources' texts; real: see scored()."""
    return deduped(scored(candidates(sources, ref, text, types), types, follow_up, real=real))
