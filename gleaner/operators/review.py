"""Review policy: which messages a person has to look at, as boolean Columns over one row a message.

profile() gathers what the policy asks of a message's sources, attachments and findings in one aggregate of each; the
predicates are Columns over that row, so any number of them costs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scan

# Words and shapes of the review policy.
RECORD_WORDS = ["application", "beneficiary", "coverage", "claim", "claimant", "dependent", "eligibility", "employee", "enrollment", "household", "identity", "intake", "member", "patient", "record", "review_packet", "roster", "subscriber"]
OPERATIONAL_WORDS = ["operations", "operational", "ops", "ticket", "faq", "notice", "digest", "status", "runbook", "snapshot", "checklist"]
FORWARDED_MARKERS = ["----- original message -----", "forwarding the quoted intake excerpt", "only the quoted record block should be treated as candidate personal data"]
SECURITY_MARKERS = ["login ip", "portal sign-in", "user profile snapshot", "suspicious login"]
MULTI_ENTITY_MARKERS = ["co-applicant", "dependent", "spouse", "relationship", "primary", "household"]
SCANNED_MARKERS = ["[pdf page", "[rendered page", ".jpg]", ".png]", ".pdf]"]
SENSITIVE_TYPES = ["ADDRESS", "BANK_ACCOUNT", "CREDIT_CARD", "DOB", "DRIVERS_LICENSE", "EMAIL", "FULL_NAME", "IBAN", "ICD10", "MEDICARE", "MRN", "NDC", "PASSPORT", "PHONE", "SSN"]
# type -> what one of the texts must hold (all words of a set), and the shape of a label whose value was not recovered
LABELLED = {
    "EMAIL": ([["personal email"], ["email address"], ["email:"]], r"(?i)\b(?:personal\s+email|email(?:\s+address)?)\s*:\s*(?![A-Za-z0-9][A-Za-z0-9._%+\-]{0,62}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\b)[^\n]{0,120}(?:@|(?:gmail|yahoo|outlook|protonmail)\b)"),
    "DRIVERS_LICENSE": ([["driver", "license"]], r"(?i)\bdriver'?s?\s+licen[sc]e(?:\s+number)?\s*:\s*[A-Z0-9 -]{5,24}\b"),
    "IBAN": ([["iban"]], r"(?i)\biban\s*:\s*[A-Z0-9 ][A-Z0-9 .-]{10,40}\b"),
    "MEDICARE": ([["medicare"], ["mbi"]], r"(?i)\b(?:medicare(?:\s+number)?|mbi)\s*:\s*[A-Z0-9 ][A-Z0-9 .-]{8,24}\b"),
}
REASONS = {
    "multi_entity": "Multiple related subjects appear in the same file; human review is required.",
    "labelled_gap": "Labeled record fields were present but at least one sensitive value was not recovered cleanly.",
    "other": "Deterministic review policy requires human review.",
}


def holds(low: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds any of the words, as a part of whatever."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def source_priority(ref: Column) -> Column:
    """0 for sources that look like records, 1 for other attachments, 2 for operational ones, 3 for the rest."""
    low = F.lower(ref)
    return F.when(holds(low, RECORD_WORDS), 0).when(holds(low, OPERATIONAL_WORDS), 2).when(ref.contains(" > "), 1).otherwise(3)


def labelled_gaps(text: Column) -> Column:
    """The types whose label is in the text with a value that looks broken."""
    low = F.lower(text)

    def cue(sets):
        out = F.lit(False)
        for words in sets:
            every = F.lit(True)
            for w in words:
                every = every & low.contains(w)
            out = out | every
        return out

    return F.array_compact(F.array(*[F.when(cue(sets) & text.rlike(shape), F.lit(kind)) for kind, (sets, shape) in LABELLED.items()]))


def profile(messages: DataFrame, sources: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a message: file, subject, names (attachments, lower case), n_attachments, and what sources and findings tell.

    messages: file, subject, attachments (array<string> of names). sources: file, source_ref, text, structured, ocr_used,
    ocr_confidence, ocr_low, warnings, has_meta. findings: file, pii_type, confidence. Messages without sources or
    findings have a row too; nulls count as absent.
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    low = F.lower(F.coalesce("text", F.lit("")))
    gaps = F.when(no("has_meta") & ~(no("ocr_used") | no("structured")), F.array().cast("array<string>")).otherwise(labelled_gaps(F.coalesce("text", F.lit(""))))
    marks = {"forwarded_text": holds(low, FORWARDED_MARKERS), "quoted_text": low.contains(">"), "full_name_text": low.contains("full name:"), "security_text": holds(low, SECURITY_MARKERS), "multi_text": holds(low, MULTI_ENTITY_MARKERS), "scanned_text": holds(low, SCANNED_MARKERS)}
    meta = {
        "record_ref": no("has_meta") & holds(F.lower("source_ref"), RECORD_WORDS), "any_ocr": no("has_meta") & no("ocr_used"), "low_ocr": no("has_meta") & no("ocr_low"), "table_ocr": no("has_meta") & no("ocr_used") & no("structured"),
        "weak_ocr": no("has_meta") & no("ocr_used") & (F.coalesce("ocr_confidence", F.lit(0.0)) > 0) & (F.col("ocr_confidence") < 78), "empty_ocr": no("has_meta") & F.coalesce(F.array_contains("warnings", "empty_ocr_output"), F.lit(False)),
    }
    told = sources.groupBy("file").agg(*[F.bool_or(v).alias(k) for k, v in (marks | meta).items()], F.array_distinct(F.flatten(F.collect_list(gaps))).alias("gaps"), F.sort_array(F.collect_list(F.when(no("has_meta") & (no("ocr_low") | no("ocr_used")), F.col("source_ref")))).alias("ocr_refs"))
    found = findings.groupBy("file").agg(F.sort_array(F.collect_set("pii_type")).alias("types"), F.count("*").alias("n_findings"), F.min("confidence").alias("least_confidence"))
    names = F.filter(F.transform(F.coalesce("attachments", F.array().cast("array<string>")), lambda a: F.lower(a)), lambda a: a != "")
    rows = messages.select("file", F.coalesce("subject", F.lit("")).alias("subject"), names.alias("names"), F.size(F.coalesce("attachments", F.array().cast("array<string>"))).alias("n_attachments"))
    out = rows.join(told, "file", "left").join(found, "file", "left")
    flags = {k: F.coalesce(k, F.lit(False)) for k in marks | meta}
    none = F.array().cast("array<string>")
    return out.withColumns(flags | {"gaps": F.coalesce("gaps", none), "ocr_refs": F.coalesce("ocr_refs", none), "types": F.coalesce("types", none), "n_findings": F.coalesce("n_findings", F.lit(0))})


def policy(profiles: DataFrame) -> DataFrame:
    """file with each predicate of the policy, should_review, reason, and the references an analyst should look at."""
    subject, names, types, found = F.lower("subject"), F.col("names"), F.col("types"), F.col("n_findings") > 0

    def any_type(*kinds):
        return F.arrays_overlap(types, F.array(*[F.lit(k) for k in kinds]))

    record = F.exists(names, lambda n: holds(n, RECORD_WORDS) & ~holds(n, OPERATIONAL_WORDS))
    steps: list[tuple[str, Column]] = [
        ("record_attachment", record),
        ("record_context", F.col("record_attachment") | holds(subject, RECORD_WORDS) | F.col("record_ref")),
        ("labelled_gap", F.size(F.array_except("gaps", "types")) > 0),
        ("uncertain", (F.col("record_context") | found) & (F.col("low_ocr") | (F.col("table_ocr") & ~found) | F.col("weak_ocr") | F.col("empty_ocr") | F.col("labelled_gap"))),
        ("forwarded", (F.size("types") >= 2) & (holds(subject, FORWARDED_MARKERS) | F.col("forwarded_text") | ((subject.contains(">") | F.col("quoted_text")) & (subject.contains("full name:") | F.col("full_name_text"))))),
        ("security_profile", any_type("IPV4") & any_type("FULL_NAME", "EMAIL", "PHONE") & (holds(subject, SECURITY_MARKERS) | F.col("security_text"))),
        ("multi_entity", holds(subject, MULTI_ENTITY_MARKERS) | F.col("multi_text") | F.exists(names, lambda n: n.rlike("\\.(csv|xlsx|docx)$") & n.contains("household"))),
        ("mixed_packet", (F.col("n_attachments") >= 2) & F.col("record_attachment") & F.exists(names, lambda n: holds(n, OPERATIONAL_WORDS))),
        ("scanned_record", found & F.col("record_attachment") & (F.col("any_ocr") | F.col("scanned_text")) & any_type(*SENSITIVE_TYPES)),
        ("policy_review", F.col("multi_entity") | F.col("labelled_gap")),
    ]
    out = profiles
    for name, value in steps:
        out = out.withColumn(name, value)
    special = F.col("forwarded") | F.col("security_profile") | F.col("mixed_packet") | F.col("scanned_record") | F.coalesce(F.col("least_confidence") < 0.72, F.lit(False))
    should = F.col("uncertain") | F.col("policy_review") | F.when(found, special).otherwise(F.col("record_context"))
    reason = F.when(F.col("policy_review"), F.when(F.col("multi_entity"), REASONS["multi_entity"]).otherwise(REASONS["labelled_gap"]))
    refs = F.when(F.size("ocr_refs") > 0, F.slice("ocr_refs", 1, 3)).otherwise(F.array(F.when(F.col("subject") != "", F.col("subject")).otherwise(F.col("file"))))
    return out.select("file", *[n for n, _ in steps], should.alias("should_review"), reason.alias("reason"), refs.alias("uncertain_refs"))


# ---- follow-up rescans

# Shapes in a review's texts that hint at a type that was missed, and the types without any hint.
HINTS = {
    "FULL_NAME": [r"\b(full\s+name|patient\s+name|member\s+name|record\s+owner)\b"],
    "DOB": [r"\b(date\s+of\s+birth|dob|birth\s+date)\b", r"\b(?:0?8|do8|d0b)\s+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"],
    "SSN": [r"\b(ssn|social\s+security|ssh|ssm|s5n)\b"],
    "ADDRESS": [r"\b(home\s+address|address|mailing\s+address|adress)\b"],
    "PHONE": [r"\b(phone|mobile|telephone)\b"],
    "EMAIL": [r"\b(email|e-mail)\b", "@"],
    "DRIVERS_LICENSE": [r"\b(driver'?s?\s+license|driver\s+license)\b"],
    "PASSPORT": [r"\bpassport\b"],
    "MRN": [r"\b(mrn|medical\s+record|record\s+number)\b"],
    "MEDICARE": [r"\b(medicare|mbi)\b"],
    "ICD10": [r"\b(icd|diagnosis\s+code)\b"],
    "NDC": [r"\b(ndc|drug\s+code)\b"],
    "BANK_ACCOUNT": [r"\b(routing\s+number|account\s+number|bank\s+account|aba)\b"],
    "CREDIT_CARD": [r"\b(card\s+number|credit\s+card|debit\s+card)\b"],
    "IBAN": [r"\biban\b"],
    "EIN": [r"\b(ein|employer\s+identification)\b"],
}
UNHINTED = ["FULL_NAME", "DOB", "ADDRESS"]
MOST_SOURCES = 4


def flat(v: Column) -> Column:
    """Lower case, blanks collapsed: the form that quotes are looked for in."""
    return F.lower(T.collapse(v))


def followup_sources(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """file, source_ref, text of the sources to scan again for each review that needs a person.

    Those that hold one of the review's quotes; where none does, the first MOST_SOURCES: scanned ones, tables,
    attachments, bodies, long ones. Ranks are taken within a message.
    """
    asked = reviews.filter("needs_human_review").select("file", F.filter(F.transform(F.coalesce("evidence_quotes", F.array().cast("array<string>")), flat), lambda q: q != "").alias("_quotes"))
    rows = sources.join(asked, "file").withColumn("_text", flat(F.col("text")))
    rows = rows.withColumn("_quoted", F.exists("_quotes", lambda q: F.contains(F.col("_text"), q)))
    order = [F.desc(F.coalesce("ocr_used", F.lit(False))), F.desc(F.coalesce("structured", F.lit(False))), F.desc(F.col("source_ref").contains(" > ")), F.desc(F.col("source_ref").contains("(email body)")), F.desc(F.length("text")), "source_ref"]
    of = Window.partitionBy("file")
    rows = rows.withColumns({"_any": F.max("_quoted").over(of), "_n": F.row_number().over(of.orderBy(*order))})
    return rows.filter(F.when(F.col("_any"), F.col("_quoted")).otherwise(F.col("_n") <= MOST_SOURCES)).select("file", "source_ref", "text")


def hinted_types(v: Column) -> Column:
    """The types that a text in flat() form hints at, in order of HINTS."""
    return F.array_compact(F.array(*[F.when(v.rlike("|".join(shapes)), F.lit(kind)) for kind, shapes in HINTS.items()]))


def followup_types(reviews: DataFrame, chosen: DataFrame, policies: DataFrame) -> DataFrame:
    """file, types to look for again: the review's own, else those that its sources, quotes and reason hint at, else
    UNHINTED for messages that look like records and have no findings. policies: file, record_context, n_findings."""
    texts = chosen.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_ref", "text"))), lambda s: s["text"]), "\n").alias("_text"))
    rows = reviews.filter("needs_human_review").join(texts, "file", "left").join(policies.select("file", "record_context", "n_findings"), "file", "left")
    none = F.array().cast("array<string>")
    every = flat(F.concat_ws("\n", "_text", F.array_join(F.coalesce("evidence_quotes", none), "\n"), "reason"))
    own, hinted = F.array_sort(F.array_distinct(F.coalesce("suspected_missing_types", none))), F.array_sort(hinted_types(every))
    types = F.when(F.size(own) > 0, own).when(F.size(hinted) > 0, hinted).when(F.col("record_context") & (F.coalesce("n_findings", F.lit(0)) == 0), F.array_sort(F.array(*[F.lit(t) for t in UNHINTED]))).otherwise(none)
    return rows.select("file", types.alias("types"))


def followup(reviews: DataFrame, sources: DataFrame, findings: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """findings with those that the second scan adds, and the reviews brought up to date.

    findings: scan()'s columns and file. The second scan runs over the chosen sources only, in follow-up mode, for the
    types asked for; what it adds is what the first scan has no (source_ref, pii_type, normalized_value) of.
    """
    chosen = followup_sources(reviews, sources)
    types = followup_types(reviews, chosen, policies)
    again = scan.scan(chosen, follow_up=True).join(chosen.select("source_ref", "file").distinct(), "source_ref").join(types, "file").filter(F.array_contains("types", F.col("pii_type"))).drop("types")
    key = ["source_ref", "pii_type", "normalized_value"]
    added = again.join(findings.select(*key).distinct(), key, "left_anti")
    merged = scan.deduped(findings.unionByName(again))
    new = added.groupBy("file").agg(F.count("*").alias("_n"), F.sort_array(F.collect_set("pii_type")).alias("_types"), F.sort_array(F.collect_set("source_ref")).alias("_refs"))
    scanned = chosen.groupBy("file").agg(F.lit(True).alias("_scanned"))
    n = F.coalesce("_n", F.lit(0))
    note = F.concat(F.coalesce("reason", F.lit("")), F.lit(" Follow-up scan added "), n.cast("string"), F.when(n == 1, " deterministic match.").otherwise(" deterministic matches."))
    none = F.array().cast("array<string>")
    out = reviews.join(new, "file", "left").join(scanned, "file", "left").withColumns(
        {
            "reason": F.when(n > 0, T.stripped(note)).otherwise(F.col("reason")), "status": F.when(n > 0, "needs_review").otherwise(F.col("status")), "followup_scanned": F.coalesce("_scanned", F.lit(False)),
            "followup_match_count": n, "followup_pii_types": F.coalesce("_types", none), "followup_source_refs": F.coalesce("_refs", none),
        }
    )
    return merged, out.drop("_n", "_types", "_refs", "_scanned")
