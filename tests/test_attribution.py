from gleaner.operators import attribution, scan

TEXT = "Patient: Bo Lake\nEmail: bo.lake@x.org\nSSN: 123-45-6788\n\nA quiet paragraph.\n\nDear Ana River,\nyour notes."


def test_mentions_and_owners(spark):
    src = spark.createDataFrame([("a.eml (email body)", TEXT), ("b.eml (email body)", "SSN: 123-45-6788"), ("c.eml (email body)", None), ("d.eml (email body)", "")], "source_ref string, text string")
    got = attribution.attribute(scan.scan(src, types=["SSN", "EMAIL"]), src).collect()
    by = {(r["source_ref"][0], r["pii_type"]): r for r in got}
    assert by["a", "SSN"]["entity_key"] == "email:bo.lake@x.org" and by["a", "SSN"]["entity_name"] == "Bo Lake" and by["a", "SSN"]["attribution_confidence"] == 0.99
    assert by["b", "SSN"]["entity_type"] == "UNATTRIBUTED" and by["b", "SSN"]["entity_key"] == "block:b.eml (email body):0"
    assert {r["source_ref"][0] for r in got} == {"a", "b"}
    names = {(r["name"], r["email"], r["method"]) for r in attribution.mentions(attribution.B.segment(src)).collect()}
    assert ("Bo Lake", "bo.lake@x.org", "same_block_label") in names and ("Ana River", None, "salutation_match") in names
