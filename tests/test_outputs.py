"""Outputs and run history are written and read again; a model's answers change what they may and nothing else."""

import json

from pyspark.sql import functions as F

from gleaner.operators import answers, jobs, ocr, reports
from gleaner.sources import outputs

POLICY = "file string, n_findings long, record_attachment boolean, policy_review boolean, uncertain boolean, reason string, uncertain_refs array<string>"


def test_csv_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 'Ann "A" River', "a.eml", "two, with\ncomma"), ("p2", "", "b.eml", "x")], "person_id string, canonical_name string, current_source_file string, note string")
    outputs.write_csv(outputs.stamped(rows, "j1", "2", "abc"), str(tmp_path / "r"))
    back = outputs.read_report(spark, str(tmp_path / "r"))
    assert back.columns[:4] == ["report_job_id", "report_schema_version", "report_build_id", "report_generated_utc"]
    got = {r["person_id"]: r for r in back.collect()}
    assert got["p1"]["canonical_name"] == 'Ann "A" River' and got["p1"]["note"] == "two, with\ncomma" and got["p2"]["canonical_name"] == ""


def test_truth_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a.eml", True), ("b.eml", False)], "file string, needs_review boolean")
    expected = spark.createDataFrame([("a.eml", "a.eml (email body)", "SSN", "123456788", "Ann River"), ("a.eml", "a.eml (email body)", "SSN", "123456788", "Ann River")], "file string, source_ref string, pii_type string, normalized_value string, owner string")
    outputs.write_truth(files, expected, str(tmp_path / "t"))
    f, e = outputs.read_truth(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, f.collect())) == [("a.eml", True), ("b.eml", False)]
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, expected.collect()))  # repeats stay


def test_log_and_evaluation(spark, tmp_path):
    for n in (1, 2):
        outputs.append_log(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "log"))
    assert sorted(r["n"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]
    outputs.write_evaluation(spark, spark.createDataFrame([("SSN", 0.5)], "pii_type string, recall double"), str(tmp_path / "e"), "Figures")
    page = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "e/md")).collect())
    assert "# Figures" in page and "SSN" in page and "0.5" in page


def test_html_is_escaped_and_counts_the_rest(spark):
    figures = spark.createDataFrame([(2,)], "total_files int")
    rows = spark.createDataFrame([("<b>x</b>", ["A", "B"]), ("y", None), ("z", [])], "name string, types array<string>").coalesce(1)
    page = reports.html("T & Co", figures, {"people": rows}, most=2)
    assert "T &amp; Co" in page and "&lt;b&gt;x&lt;/b&gt;" in page and "<b>" not in page and "A, B" in page and "<p>1 more</p>" in page


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for status in ("queued", "processing"):
        jobs.record(spark, path, job_id="j1", status=status, total=3)
    for status in ("queued", "processing", "complete"):
        jobs.record(spark, path, job_id="j2", status=status, total=1)
    history = spark.read.parquet(path)
    assert {r["job_id"]: r["status"] for r in jobs.latest(history).collect()} == {"j1": "processing", "j2": "complete"}
    assert {r["job_id"]: r["status"] for r in jobs.recovered(history).collect()} == {"j1": "error", "j2": "complete"}
    assert tuple(jobs.free_slots(history).first()) == (1, 0, 1)
    later = F.current_timestamp() + F.make_interval(hours=F.lit(25))
    assert {r["job_id"] for r in jobs.kept(history, later).collect()} == {"j1"}  # j1 has not ended
    assert {r["job_id"] for r in jobs.kept(history, F.current_timestamp()).collect()} == {"j1", "j2"}


def test_config_and_fingerprint(tmp_path):
    c = jobs.Config.read({"GLEANER_SLOTS": "5", "GLEANER_REVIEW_ALL": "Yes", "GLEANER_BUILD": "b"})
    assert (c.slots, c.review_all, c.build, c.keep_hours) == (5, True, "b", 24)
    (tmp_path / "a.py").write_text("x = 1")
    before = jobs.fingerprint(str(tmp_path))
    (tmp_path / "a.py").write_text("x = 2")
    assert len(before) == 12 and jobs.fingerprint(str(tmp_path)) != before


def test_client_that_breaks_is_left_alone(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "n int, prompt string").coalesce(1)

    def client(p):
        if p == "bad":
            raise OSError("down")
        return p.upper()

    got = {r["n"]: (r["answer"], r["error"]) for r in answers.ask(prompts, client).collect()}
    assert got == {1: ("A", None), 2: (None, "unavailable:OSError"), 3: (None, "unavailable:OSError")}
    assert {r["error"] for r in answers.ask(prompts, None).collect()} == {"no_client"}


def test_reviews_clear_only_what_they_may(spark):
    def says(needs, sure, quotes=(), reason="fine"):
        return json.dumps({"needs_human_review": needs, "confidence": sure, "suspected_missing_types": ["ssn", "nope"], "questionable_detected_types": [], "evidence_quotes": list(quotes), "reason": reason})

    given = {
        "clear": says(False, 0.9, ["patient record", "not in the text"]), "unsure": says(False, 0.5), "asked": "```json\n" + says(True, 1.7) + "\n```", "zero": says(False, 0.9), "policy": says(False, 0.9),
        "scan": says(False, 0.9), "broken": "no json here", "cut": '{"needs_human_review": true, "confidence": 0.8, "suspected_missing_types": ["SSN", "DO',
    }
    a = spark.createDataFrame(list(given.items()), "file string, answer string")
    t = spark.createDataFrame([(f, "Re: " + f, ["A Patient  Record of Ann"]) for f in given], "file string, subject string, texts array<string>")
    p = spark.createDataFrame([(f, 0 if f == "zero" else 1, f == "zero", f == "policy", f == "scan", "policy says so", ["scan.png"]) for f in given], POLICY)
    got = {r["file"]: r for r in answers.reviewed(a, t, p).collect()}
    assert len(got) == len(given)
    assert (got["clear"]["status"], got["clear"]["evidence_quotes"], got["clear"]["suspected_missing_types"], got["clear"]["confidence"]) == ("clear", ["patient record"], ["SSN"], 0.9)
    assert got["unsure"]["needs_human_review"] and "not confident enough" in got["unsure"]["reason"] and got["unsure"]["evidence_quotes"] == ["Re: unsure"]
    assert got["asked"]["needs_human_review"] and got["asked"]["confidence"] == 1.0 and got["asked"]["error"] is None
    assert (got["zero"]["error"], got["zero"]["confidence"]) == ("record_attachment_zero_findings", 0.4)
    assert (got["policy"]["error"], got["policy"]["confidence"], got["policy"]["reason"]) == ("policy_review_required", 0.55, "policy says so")
    assert (got["scan"]["error"], got["scan"]["confidence"], got["scan"]["evidence_quotes"]) == ("uncertain_extraction_quality", 0.45, ["scan.png"])
    assert got["broken"]["error"] == "unreadable_answer" and got["broken"]["needs_human_review"]
    assert got["cut"]["needs_human_review"] and got["cut"]["reason"] == answers.TRUNCATED and got["cut"]["suspected_missing_types"] == ["SSN"]


def test_review_prompts_keep_to_the_budget(spark):
    profiles = spark.createDataFrame([("a.eml", "S", ["1", "2", "3", "4", "5", "6"]), ("b.eml", "T", [])], "file string, subject string, names array<string>")
    sources = spark.createDataFrame([("a.eml", f"a.eml > {i}.txt", "word " * 200) for i in range(7)], "file string, source_ref string, text string")
    findings = spark.createDataFrame([("a.eml", "a.eml > 0.txt", "SSN", "***", 0.5 + i / 100, 10 * i) for i in range(12)], "file string, source_ref string, pii_type string, redacted_value string, confidence double, char_offset int")
    got = {r["file"]: json.loads(r["prompt"]) for r in answers.review_prompts(profiles, sources, findings, budget=500).collect()}
    a = got["a.eml"]
    assert len(a["attachments"]) == 5 and [f["confidence"] for f in a["findings"]] == sorted([0.5 + i / 100 for i in range(4, 12)], reverse=True)
    assert 0 < len(a["context"]) <= 5 and sum(len(c["snippet"]) for c in a["context"]) <= 500 and "SSN" in a["known_types"]
    assert got["b.eml"]["attachments"] == [] and "findings" not in got["b.eml"]


def test_owner_requests_and_decisions(spark):
    asked = spark.createDataFrame([(1, "s", 1, "SSN", "***", "x")], "finding long, source_ref string, block_ix int, pii_type string, redacted_value string, excerpt string")
    blocks = spark.createDataFrame([("s", 0, "before"), ("s", 1, "The SSN of Ann"), ("s", 2, "after"), ("t", 0, "other")], "source_ref string, block_ix int, text string")
    c = [(1, "Ann River", "ann@x.org", "EMPLOYEE", "label", 0.8, ["l"]), (1, "Bob Lake", "bob@x.org", "EMPLOYEE", "label", 0.7, ["l"]), (1, "Bob Lake", "bob@x.org", "EMPLOYEE", "other", 0.6, ["l"])]
    ranked = answers.ranked_candidates(spark.createDataFrame(c, "finding long, name string, email string, role string, method string, score double, evidence array<string>"))
    assert [(r["candidate_id"], r["name"]) for r in ranked.orderBy("candidate_id").collect()] == [("C1", "Ann River"), ("C2", "Bob Lake")]
    r = answers.requests(asked, blocks, ranked).first()
    said = json.loads(r["prompt"])
    assert (said["previous"], said["current"], said["next"], len(said["candidates"]), r["context"]) == ("before", "The SSN of Ann", "after", 2, "before\nThe SSN of Ann\nafter")

    def answer(who, sure, quote="SSN of Ann"):
        return json.dumps({"candidate_id": who, "confidence": sure, "evidence_quotes": [quote], "reason": "r"})

    tried = [(1, answer("C1", 0.9)), (2, answer("C9", 0.9)), (3, answer("C1", 0.5)), (4, answer("C1", 0.9, "nowhere")), (5, answer("UNATTRIBUTED", 0.9)), (6, answer("C1", 1.5)), (7, "?")]
    rows = spark.createDataFrame(tried, "finding long, said string").withColumn("answer", answers.read_owner(F.col("said"), F.lit(r["context"]), F.array(F.lit("C1"), F.lit("C2"))))
    assert [x["finding"] for x in rows.filter("answer is not null").orderBy("finding").collect()] == [1, 5]
    choice = "struct<name:string,email:string,role:string,score:double>"
    had = spark.createDataFrame(
        [(1, "agreed", ("Ann River", "ann@x.org", None, 0.8), "Ann River", "ann@x.org", 0.8), (1, "unlike", ("Bob Lake", "bob@x.org", None, 0.8), "Ann River", "ann@x.org", 0.8), (1, "new", ("Bob Lake", "bob@x.org", None, 0.8), None, None, None), (5, "none", None, "Ann River", "ann@x.org", 0.8), (5, "sure", None, "Ann River", "ann@x.org", 0.9)],
        f"finding long, case string, choice {choice}, d_name string, d_email string, d_confidence double",
    )
    joined = had.join(rows.select("finding", "answer"), "finding").withColumn("finding", F.col("case"))
    got = {x["finding"]: (x["name"], x["confidence"], x["method"]) for x in answers.decided(joined).collect()}
    assert got == {
        "agreed": ("Ann River", 0.87, "hybrid_local_llm"), "unlike": ("Bob Lake", 0.87, "hybrid_local_llm"), "new": ("Bob Lake", 0.87, "hybrid_local_llm"), "none": ("UNATTRIBUTED", 0.0, "hybrid_local_llm_unattributed"),
    }


def test_ocr_pages_and_best_pass(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    words = ["Name:", "Ann", "River", "SSN:", "123-45-6788"]
    tsv = "\n".join([head, *[f"5\t1\t1\t1\t{1 if i < 3 else 2}\t{i + 1}\t{40 * i}\t10\t30\t10\t90\t{w}" for i, w in enumerate(words)]])
    got = {r["k"]: r for r in ocr.pages(spark.createDataFrame([("a", tsv), ("b", head), ("c", None)], "k string, tsv string"), ["k"]).collect()}
    assert got["a"]["text"].split("\n")[0].startswith("Name: Ann River") and "123-45-6788" in got["a"]["text"] and got["a"]["ocr_confidence"] == 90.0
    assert got["b"]["text"] == "" and "empty_ocr_output" in got["b"]["warnings"] and got["c"]["text"] == ""
    passes = spark.createDataFrame([("a", 2, "x", 5.0, False), ("a", 1, "y", 5.0, False), ("a", 3, "", 1.0, True)], "k string, pass int, text string, score double, ocr_low boolean")
    best = ocr.best_pass(passes, ["k"]).collect()
    assert [(r["text"], r["weak"]) for r in best] == [("y", True)]
