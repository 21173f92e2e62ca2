"""Mails as a stream, entities of attributed findings, and follow-up scans, on small inputs."""

from gleaner.operators import attribution, entities, reports, review, scan
from gleaner.streaming import mails
from tests.test_sources import _mail


def test_mail_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(_mail())
    found = mails.findings(mails.arriving(spark, str(tmp_path / "in")), types=["SSN"])
    mails.start(found, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert [r["normalized_value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["123456788"]


def test_persons_and_their_report(spark):
    src = spark.createDataFrame([("a.eml (email body)", "Full Name: William River\nSSN: 123-45-6788"), ("b.eml (email body)", "Full Name: Wiliam River\nMRN: A12345")], "source_ref string, text string")
    got = entities.persons(attribution.attribute(scan.scan(src, types=["SSN", "MRN", "FULL_NAME"]), src))
    rows = got.collect()
    assert len(rows) == 1 and sorted(rows[0]["files"]) == ["a.eml", "b.eml"] and set(rows[0]["names"]) == {"William River", "Wiliam River"}
    assert reports.analyst_rows(entities.risk_of(got)).count() == 2


def test_follow_up(spark):
    src = spark.createDataFrame([("a.eml", "a.eml (email body)", "Patient record. Date of Birth: 03/04/1985", False, False)], "file string, source_ref string, text string, ocr_used boolean, structured boolean")
    reviews = spark.createDataFrame([("a.eml", True, "needs_review", ["DOB"], ["date of birth"], "look")], "file string, needs_human_review boolean, status string, suspected_missing_types array<string>, evidence_quotes array<string>, reason string")
    policies = spark.createDataFrame([("a.eml", True, 0)], "file string, record_context boolean, n_findings int")
    none = scan.scan(src, types=["VIN"]).join(src.select("source_ref", "file"), "source_ref")
    merged, out = review.followup(reviews, src, none, policies)
    assert [(r["pii_type"], r["normalized_value"]) for r in merged.collect()] == [("DOB", "1985-03-04")]
    r = out.first()
    assert r["followup_match_count"] == 1 and r["reason"] == "look Follow-up scan added 1 deterministic match."
