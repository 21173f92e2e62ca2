"""Report roll-ups: matrices, rows an entity and file, rows a message, key figures, and the HTML page made of them."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attribution import file_of

ORDER = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
# What types and columns are called.
TYPE_LABELS = {
    "SSN": "Social Security Number", "SIN": "Canadian Social Insurance Number", "CREDIT_CARD": "Payment Card", "BANK_ACCOUNT": "Bank Account", "PASSPORT": "Passport", "DRIVERS_LICENSE": "Driver's License", "MEDICARE": "Medicare ID",
    "MRN": "Medical Record Number", "NPI": "National Provider Identifier", "IBAN": "IBAN", "EIN": "Employer ID Number", "EMAIL": "Email Address", "PHONE": "Phone Number", "DOB": "Date of Birth", "FULL_NAME": "Full Name",
    "ADDRESS": "Street Address", "ZIP": "ZIP / Postal Code", "VIN": "Vehicle ID Number", "ICD10": "ICD-10 Code", "NDC": "Drug Code", "IPV4": "IP Address",
}
HEADERS = {
    "risk_band": "Risk Level", "risk_score": "Risk Score", "attribution_confidence": "Attribution Confidence", "attribution_methods": "Attribution Methods", "entity_source_file_count": "Entity Source File Count",
    "entity_source_files": "Entity Source Email Files", "current_source_file": "Current Source Email File", "current_source_ref_count": "Current Source Reference Count", "current_source_refs": "Current Source References",
    "pii_match_count": "PII Matches", "unique_pii_type_count": "Unique PII Types", "pii_types_found": "PII Types Found", "avg_confidence": "Average Confidence", "hipaa_triggered": "HIPAA Triggered", "ccpa_triggered": "CCPA Triggered",
    "pipeda_triggered": "PIPEDA Triggered", "notification_required": "Notification Required", "source_file_count": "# Source Files", "source_files": "Source Email Files", "SSN": "Social Security Number", "SIN": "Canadian Social Insurance #",
    "CREDIT_CARD": "Credit Card", "BANK_ACCOUNT": "Bank Account", "PASSPORT": "Passport", "DRIVERS_LICENSE": "Driver's License", "MEDICARE": "Medicare Beneficiary ID", "MRN": "Medical Record Number", "NPI": "National Provider ID",
    "EMAIL": "Email Address (Content)", "PHONE": "Phone Number", "DOB": "Date of Birth", "ADDRESS": "Physical Address", "ZIP": "ZIP/Postal Code", "VIN": "Vehicle ID Number", "IBAN": "IBAN", "ICD10": "ICD-10 Code", "NDC": "NDC Drug Code",
    "FULL_NAME": "Full Name", "IPV4": "IP Address", "EIN": "Employer ID Number",
}


def header(name: str) -> str:
    return HEADERS.get(name) or " ".join(w.title() for w in name.split("_"))


def ordinal(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ORDER]), level).cast("int"), F.lit(1))


def _yes(c: Column) -> Column:
    return F.when(c, "Y").otherwise("N")


def type_matrix(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pii_type").agg(F.count("*").alias("n"))


def category_matrix(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pii_category").agg(F.count("*").alias("n"))


def ranked(matrix: DataFrame, code: str) -> DataFrame:
    """A matrix from the most frequent down, equal ones by code, with labels for types."""
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return matrix.withColumn("label", F.coalesce(F.try_element_at(labels, F.col(code)), F.initcap(F.replace(code, F.lit("_"), F.lit(" "))))).orderBy(F.desc("n"), code)


def entity_file(findings: DataFrame, types: list[str], entity: str = "entity_key") -> DataFrame:
    """A row an entity and file: Y or N for each type, distinct types, mean confidence in percent, highest risk."""
    rows = findings.withColumns({"file": file_of(F.col("source_ref")), "_level": ordinal(F.col("risk_level"))})
    agg = rows.groupBy(entity, "file").agg(
        *[_yes(F.bool_or(F.col("pii_type") == t)).alias(f"has_{t.lower()}") for t in types], F.count_distinct("pii_type").alias("n_types"),
        F.floor(F.avg("confidence") * 100 + 0.5).cast("long").alias("mean_confidence_pct"), F.max("_level").alias("_level"), F.bool_or("notification_required").alias("notify"),
    )
    return agg.withColumn("highest_risk", F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.col("_level"))).drop("_level")


def analyst_rows(people: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The analyst's table: a row an entity and file, its types pivoted to Y and N columns, the entity's columns repeated.

    people: entities.risk_of(). types: the columns wanted; the ones that are found, in order, where none are given.
    """
    owner = people.select(
        "entity_key", "person_id", F.col("name").alias("canonical_name"), F.coalesce("email", F.lit("")).alias("canonical_email"), "entity_type", F.format_string("%.2f", F.col("risk_score")).alias("risk_score"),
        F.format_string("%.2f", F.col("confidence")).alias("attribution_confidence"), F.array_join("methods", ", ").alias("attribution_methods"), F.size("files").alias("entity_source_file_count"), F.array_join(F.array_sort("files"), "|").alias("entity_source_files"),
    )
    rows = people.select("entity_key", F.inline("findings")).withColumn("_level", ordinal(F.col("risk_level")))
    keys = ["entity_key", "file"]
    told = rows.groupBy(*keys).agg(
        F.max("_level").alias("_level"), F.count_distinct("source_ref").alias("current_source_ref_count"), F.array_join(F.array_sort(F.collect_set("source_ref")), "|").alias("current_source_refs"), F.count("*").alias("pii_match_count"),
        F.count_distinct("pii_type").alias("unique_pii_type_count"), F.array_join(F.array_sort(F.collect_set("pii_type")), ", ").alias("pii_types_found"), F.format_string("%.2f", F.avg("confidence")).alias("avg_confidence"),
        *[_yes(F.bool_or(c)).alias(to) for c, to in (("hipaa", "hipaa_triggered"), ("ccpa", "ccpa_triggered"), ("pipeda", "pipeda_triggered"), ("notification_required", "notification_required"))],
    )
    each = rows.groupBy(*keys).pivot("pii_type", types) if types else rows.groupBy(*keys).pivot("pii_type")
    wide = each.agg(F.count("pii_type"))
    found = [c for c in wide.columns if c not in keys]
    wide = wide.select(*keys, *[_yes(F.coalesce(c, F.lit(0)) > 0).alias(c) for c in found])
    out = told.join(wide, keys).join(owner, "entity_key").withColumn("risk_band", F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.col("_level")))
    first = ["person_id", "canonical_name", "canonical_email", "entity_type", "risk_band", "risk_score", "attribution_confidence", "attribution_methods", "entity_source_file_count", "entity_source_files"]
    own = ["current_source_ref_count", "current_source_refs", "pii_match_count", "unique_pii_type_count", "pii_types_found", "avg_confidence"]
    last = ["hipaa_triggered", "ccpa_triggered", "pipeda_triggered", "notification_required"]
    return out.select(*first, F.col("file").alias("current_source_file"), *own, *found, *last, F.lit(1).alias("source_file_count"), F.col("file").alias("source_files"))


def types_of(rows: DataFrame, kinds: list[str], keys: list[str]) -> DataFrame:
    """keys, pii_type of the Y cells of analyst_rows(): the wide table made long again."""
    return rows.unpivot(keys, kinds, "pii_type", "found").filter("found = 'Y'").drop("found")


def file_review(messages: DataFrame, sources: DataFrame, findings: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """A row a message: what was found in it, how its sources were read, and its review.

    messages: file, subject, n_attachments. sources: file, source_ref, structured, ocr_used, ocr_low, warnings.
    findings: source_ref, pii_type. reviews: answers.reviewed() or review.followup()'s.
    """
    found = findings.groupBy(file_of(F.col("source_ref")).alias("file")).agg(F.count("*").alias("finding_count"), F.array_join(F.array_sort(F.collect_set("pii_type")), ", ").alias("pii_types_found"))
    warned = F.size("warnings") > 0
    read = sources.groupBy("file").agg(
        F.count_if(F.col("ocr_used")).alias("ocr_source_count"), F.count_if(F.col("ocr_low")).alias("low_confidence_ocr_source_count"), F.count_if(F.col("structured")).alias("structured_source_count"),
        F.count_if(warned).alias("extraction_warning_count"), F.array_join(F.sort_array(F.collect_list(F.when(warned, F.col("source_ref")))), " | ").alias("extraction_warning_refs"),
    )
    out = messages.select(F.col("file").alias("eml_filename"), F.coalesce("subject", F.lit("")).alias("subject"), "file", F.col("n_attachments").alias("attachment_count")).join(found, "file", "left").join(read, "file", "left")
    counts = ["finding_count", "ocr_source_count", "low_confidence_ocr_source_count", "structured_source_count", "extraction_warning_count"]
    out = out.na.fill(0, counts).na.fill("", ["pii_types_found", "extraction_warning_refs"])
    base = ["eml_filename", "subject", "finding_count", "attachment_count", "pii_types_found", *counts[1:], "extraction_warning_refs"]
    if reviews is None:
        return out.select(*base, F.lit("not_run").alias("qa_status"), F.lit("N").alias("qa_needs_human_review")).orderBy("eml_filename")
    q, have = reviews.drop("subject"), set(reviews.columns)
    out = out.join(q, "file", "left")

    def listed(c, by):
        return F.coalesce(F.array_join(c, by), F.lit("")) if c in have else F.lit("")

    return out.select(
        *base, F.coalesce("status", F.lit("not_run")).alias("qa_status"), _yes(F.col("status").isNotNull()).alias("qa_reviewed"), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))).alias("qa_confidence"),
        _yes(F.coalesce("needs_human_review", F.lit(False))).alias("qa_needs_human_review"), listed("suspected_missing_types", ", ").alias("qa_suspected_missing_types"), listed("questionable_detected_types", ", ").alias("qa_questionable_detected_types"),
        F.coalesce("reason", F.lit("")).alias("qa_reason"), listed("evidence_quotes", " | ").alias("qa_evidence_quotes"), F.coalesce("error", F.lit("")).alias("qa_error") if "error" in have else F.lit("").alias("qa_error"),
        _yes(F.coalesce("followup_scanned", F.lit(False))).alias("qa_followup_scanned") if "followup_scanned" in have else F.lit("N").alias("qa_followup_scanned"),
        F.coalesce("followup_match_count", F.lit(0)).alias("qa_followup_match_count") if "followup_match_count" in have else F.lit(0).alias("qa_followup_match_count"),
        listed("followup_pii_types", ", ").alias("qa_followup_pii_types"), listed("followup_source_refs", " | ").alias("qa_followup_source_refs"),
    ).orderBy("eml_filename")


def person_rows(people: DataFrame) -> DataFrame:
    """Entities from the highest risk down, with their types and mean confidence in percent."""
    mean = F.aggregate("findings", F.lit(0.0), lambda a, f: a + f["confidence"]) / F.greatest(F.lit(1), F.size("findings"))
    return people.select(
        "person_id", "name", "email", "entity_type", "risk_band", "risk_score", F.round(mean * 100).cast("int").alias("avg_confidence_pct"), F.round(F.col("confidence") * 100).cast("int").alias("attribution_confidence_pct"),
        F.size("findings").alias("match_count"), F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["pii_type"]))).alias("types"),
    ).orderBy(F.desc(ordinal(F.col("risk_band"))), F.desc("risk_score"), "name", "person_id")


def finding_rows(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(ordinal(F.col("risk_level"))), F.desc("confidence"), "source_ref", "char_offset")


def source_rows(messages: DataFrame, findings: DataFrame) -> DataFrame:
    """file, subject, pii_count, status (Error, Findings, Clear) of each message. messages: file, subject, error."""
    found = findings.groupBy(file_of(F.col("source_ref")).alias("file")).agg(F.count("*").alias("pii_count"))
    rows = messages.select("file", F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)")).alias("subject"), "error").join(found, "file", "left").na.fill(0, ["pii_count"])
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), "Error").when(F.col("pii_count") > 0, "Findings").otherwise("Clear")).orderBy("file")


def summary(people: DataFrame, messages: DataFrame, findings: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One row of key figures. people: risk_of(); messages: file, n_attachments, error."""
    band = F.col("risk_band")
    p = people.agg(
        F.count("*").alias("total_persons"), F.count_if(band.isin("CRITICAL", "HIGH")).alias("total_high_critical"), F.count_if(band == "MEDIUM").alias("total_medium"), F.count_if(band == "LOW").alias("total_low"),
        *[F.count_if(F.col(c)).alias(to) for c, to in (("notification_required", "total_notification"), ("hipaa", "hipaa_count"), ("ccpa", "ccpa_count"), ("pipeda", "pipeda_count"))],
    )
    m = messages.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("n_attachments"), F.lit(0)).alias("total_attachments"), F.count(F.col("error")).alias("processing_errors"))
    f = findings.agg(F.count("*").alias("total_findings"), F.count_distinct(file_of(F.col("source_ref"))).alias("emails_with_findings"))
    if reviews is None:
        q = people.sparkSession.range(1).select(F.lit(0).cast("long").alias("files_reviewed"), F.lit(0).cast("long").alias("files_human_review"))
    else:
        q = reviews.agg(F.count("*").alias("files_reviewed"), F.count_if(F.col("needs_human_review")).alias("files_human_review"))
    # four tables of one row each
    one = F.lit(1).alias("_one")
    out = p.select("*", one)
    for t in (m, f, q):
        out = out.join(t.select("*", one), "_one")
    return out.drop("_one")


def html(title: str, figures: DataFrame, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A page of key figures and tables, everything escaped. A page holds `most` rows of a table at most; what is over is counted."""
    row = figures.first().asDict()
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><dl>"]
    parts += [f"<dt>{escape(header(k))}</dt><dd>{escape(str(v))}</dd>" for k, v in row.items()]
    parts.append("</dl>")
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        parts.append(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(header(c))}</th>" for c in df.columns) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{escape('' if v is None else ', '.join(map(str, v)) if isinstance(v, list) else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most]]
        parts.append("</table>" + (f"<p>{df.count() - most} more</p>" if len(rows) > most else ""))
    return "".join([*parts, "</body></html>"])
