"""Plans that stay within the driver's memory, values that look made up, and results on keys beyond the smallest tables'."""

from gleaner.operators import attribution, scan

LETTER = "Dear Ana River,\nyour SSN: 123-45-6788"


def test_no_text_is_broadcast_for_owners(spark):
    src = spark.createDataFrame([("a.eml (email body)", LETTER)], "source_ref string, text string")
    people = spark.createDataFrame([("a.eml", 0, "z@x.org", "Ana River", "recipient")], "file string, n int, email string, name string, role string")
    found = scan.scan(src, types=["SSN"])
    for got in (attribution.attribute(found, src), attribution.attribute(found, src, people)):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert [r["entity_name"] for r in got.collect()] == ["Ana River"]


def test_shapes_are_tried_only_where_they_can_match(spark):
    long = "x y, " * 400
    texts = {"a": "DOB: 3 May 1962", "b": "DOB: March 5,\n1990", "c": f"{long}Date of birth: Sep 7  2001 {long}", "d": "born 1962-03-04", "e": "due 3 May 1962"}
    src = spark.createDataFrame(list(texts.items()), "source_ref string, text string")
    got = scan.scan(src, types=["DOB"])
    assert sorted((r["source_ref"], r["normalized_value"], r["char_offset"]) for r in got.collect()) == [("a", "1962-05-03", 5), ("b", "1990-03-05", 5), ("c", "2001-09-07", 2015), ("d", "1962-03-04", 5)]
    plan = scan.candidates(src, types=["DOB", "MRN"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and plan.count("RLIKE") == 3


def _rows(spark, f, lo, hi):
    """A query's rows over customers lo to hi alone."""
    import tempfile

    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(lo, hi).withColumnRenamed("id", "c_custkey").write.parquet(f"{d}/customer.parquet")
    return f(spark, d)


def test_made_values_that_look_like_fakes_are_found_by_the_queries(spark):
    from gleaner import cases, registry  # noqa: F401

    q = registry.QUERIES
    assert [r["normalized_value"] for r in _rows(spark, q["mrn_findings"], 26523, 26524).collect()] == ["A22222"]
    assert [r["n"] for r in _rows(spark, q["type_matrix"], 26523, 26524).collect()] == [1, 1, 1, 1]
    assert [r["normalized_value"] for r in _rows(spark, q["filtered_ssn"], 6788, 6789).collect()] == ["123456789"]
    assert [r["attribution_method"] for r in _rows(spark, q["header_owners"], 5789, 5790).collect()] == ["unattributed"]


def test_scans_leave_out_what_looks_made_up(spark):
    src = spark.createDataFrame([("a", "MRN: A22222"), ("b", "SSN: 123-45-6789"), ("c", "MRN: A22223")], "source_ref string, text string")
    assert [r["source_ref"] for r in scan.scan(src, types=["SSN", "MRN"]).collect()] == ["c"]


def test_cards_beside_other_numbers(spark):
    texts = {"a": "the 4495589438270767 42.73.240.87", "b": "38.211.12.42 4366089147969128 ly", "c": "4111 1111 1111 1111", "d": "4111-1111-1111-1111.", "e": "44955894382707674273"}
    got = scan.scan(spark.createDataFrame(list(texts.items()), "source_ref string, text string"), types=["CREDIT_CARD"])
    assert sorted((r["source_ref"], r["normalized_value"], r["char_offset"]) for r in got.collect()) == [("a", "4495589438270767", 4), ("b", "4366089147969128", 13), ("c", "4111111111111111", 0), ("d", "4111111111111111", 0)]


def test_entities_of_pages_end_with_a_semicolon(spark, tmp_path):
    from gleaner import registry
    from gleaner.functions import text

    pages = spark.createDataFrame([(1, "<title>a &amp;&amp</title> &quot;b&quot; &am")], "page_id long, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert [r["text"] for r in registry.QUERIES["html_text"](spark, str(tmp_path)).collect()] == ['a &&amp "b" &am']
    assert [r["t"] for r in pages.select(text.html_text(pages["html"]).alias("t")).collect()] == ['a && "b" &am']
