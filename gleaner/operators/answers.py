"""Answers of a language model: asking through a pluggable client, reading what comes back, and what it may change.

No model is shipped. A client is any picklable function from prompt to answer; what a broken answer, a failing client or
none at all gives is a row with an error, so a job goes on. Everything but the client's call is Columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import RULES
from . import review
from .attribution import entity_type, name_from_email

# Thresholds of the two kinds of questions.
TRIGGER, MARGIN, MOST_CALLS, MOST_CANDIDATES = 0.86, 0.08, 6, 6
ACCEPT_OWNER, ACCEPT_REVIEW = 0.68, 0.62
KNOWN_TYPES = sorted({r.type for r in RULES})
FIELDS = "needs_human_review string, confidence string, suspected_missing_types array<string>, questionable_detected_types array<string>, evidence_quotes array<string>, reason string"
TRUNCATED = "Local AI QA response was truncated; extracted the available decision fields."


def ask(prompts: DataFrame, client: Callable[[str], str] | None, prompt: str = "prompt") -> DataFrame:
    """prompts with answer and error. After its first failure a task's client is left alone, and the rest is an error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string, error string"

    def run(batches):
        import pyarrow as pa

        broken = None if client else "no_client"
        for batch in batches:
            answers, errors = [], []
            for p in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                answer = None
                if broken is None:
                    try:
                        answer = client(p or "")
                    except Exception as e:  # a model that is down must not end the job
                        broken = f"unavailable:{type(e).__name__}"
                answers.append(answer)
                errors.append(broken)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "answer", "error"])

    return prompts.mapInArrow(run, schema)


# ---- reading answers


def unfenced(v: Column) -> Column:
    return T.stripped(F.regexp_replace(F.regexp_replace(T.stripped(v), "(?i)^```(?:json)?\\s*", ""), "\\s*```$", ""))


def cleaned_json(v: Column) -> Column:
    """Curly quotes, commas before a closing bracket and Python's literals as JSON has them."""
    out = F.translate(T.stripped(v), "“”’", "\"\"'")
    for pattern, to in ((",\\s*([}\\]])", "$1"), ("\\bTrue\\b", "true"), ("\\bFalse\\b", "false"), ("\\bNone\\b", "null")):
        out = F.regexp_replace(out, pattern, to)
    return out


def first_object(v: Column) -> Column:
    """The text from the first brace to the one that closes it, or null; braces within strings do not count."""
    rest = F.substr(v, F.instr(v, "{"), F.length(v))
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(acc, c):
        quoted, plain = acc["quoted"], ~acc["quoted"]
        depth = acc["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        closed = (acc["end"] == 0) & plain & (c == "}") & (depth == 0)
        return F.struct(
            (acc["i"] + 1).alias("i"), depth.alias("depth"), F.when((c == '"') & ~acc["escaped"], ~quoted).otherwise(quoted).alias("quoted"),
            (quoted & (c == "\\") & ~acc["escaped"]).alias("escaped"), F.when(closed, acc["i"] + 1).otherwise(acc["end"]).alias("end"),
        )

    end = F.aggregate(F.split(rest, ""), state, step, lambda acc: acc["end"])
    return F.when(v.contains("{"), F.when(end > 0, F.substr(rest, F.lit(1), end)))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(v)).startswith("OBJECT<"), F.lit(False)) & (F.regexp_replace(v, "\\s", "") != "{}")


def as_json(v: Column) -> Column:
    """The text as a JSON object: as it is, cleaned, or written in Python's way; else null."""
    raw, clean = T.stripped(v), cleaned_json(v)
    # single quotes as Python writes them, where no double quote and no quote within a word would be mistaken
    turned = F.when(~clean.contains('"') & ~clean.rlike("[A-Za-z]'[A-Za-z]"), F.replace(clean, F.lit("'"), F.lit('"')))
    return F.when(_is_object(raw), raw).when(_is_object(clean), clean).when(_is_object(turned), turned)


def known_types(v: Column) -> Column:
    up = F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.upper(T.stripped(x)))
    return F.array_distinct(F.filter(up, lambda x: x.isin(KNOWN_TYPES)))


def _strings(v: Column, field: str) -> Column:
    """The quoted strings of a list that may be cut off."""
    inside = F.regexp_extract(v, f'(?is)"?{field}"?\\s*:\\s*(\\[[^\\]]*)', 1)
    found = F.transform(F.regexp_extract_all(inside, F.lit("\"([^\"\\n]{1,220})\"|'([^'\\n]{1,220})'"), F.lit(0)), lambda x: T.stripped(F.substr(x, F.lit(2), F.length(x) - 2)))
    return F.filter(found, lambda x: x != "")


def salvaged(v: Column) -> Column:
    """A struct of FIELDS from a cut-off answer that has at least the decision and its confidence, else null."""
    t = cleaned_json(unfenced(v))
    needs, sure = F.regexp_extract(t, '(?i)"?needs_human_review"?\\s*:\\s*(true|false)', 1), F.regexp_extract(t, '(?i)"?confidence"?\\s*:\\s*([0-9]+(?:\\.[0-9]+)?)', 1)
    double, single = '(?is)"?reason"?\\s*:\\s*"([^"]*)"?', "(?is)'?reason'?\\s*:\\s*'([^']*)'?"
    reason = F.when(t.rlike(double), F.regexp_extract(t, double, 1)).when(t.rlike(single), F.regexp_extract(t, single, 1)).otherwise(TRUNCATED)
    made = F.struct(
        F.lower(needs).alias("needs_human_review"), sure.alias("confidence"), known_types(_strings(t, "suspected_missing_types")).alias("suspected_missing_types"),
        known_types(_strings(t, "questionable_detected_types")).alias("questionable_detected_types"), _strings(t, "evidence_quotes").alias("evidence_quotes"), F.left(T.stripped(reason), F.lit(320)).alias("reason"),
    )
    return F.when((needs != "") & (sure != ""), made)


def read_review(v: Column) -> Column:
    """A struct of FIELDS from an answer: whole, without fences, what can be salvaged, or its first object; else null."""
    whole = F.coalesce(as_json(v), as_json(unfenced(v)))
    return F.coalesce(F.when(whole.isNotNull(), F.from_json(whole, FIELDS)), salvaged(v), F.from_json(as_json(first_object(v)), FIELDS))


# ---- reviews of messages


def reviewed(answers: DataFrame, texts: DataFrame, policies: DataFrame) -> DataFrame:
    """file, status, needs_human_review, confidence, type lists, evidence_quotes, reason, error of each answer.

    answers: file, answer. texts: file, subject, texts (all that quotes may come from). policies: policy() with
    n_findings. Unsure answers and quotes that are nowhere in the message do not clear it, and neither does an answer
    against the policy.
    """
    rows = answers.join(texts, "file").join(policies, "file").withColumn("_r", read_review(F.col("answer")))
    none = F.array().cast("array<string>")
    r = F.col("_r")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0))))
    asked = F.coalesce(~F.lower(r["needs_human_review"]).isin("", "false", "null", "0"), F.lit(False))
    text = review.flat(F.concat_ws("\n", "subject", F.array_join(F.coalesce("texts", none), "\n")))
    rows = rows.withColumns({"_text": text, "_sure": sure, "_asked": asked})
    quotes = F.transform(F.slice(F.coalesce(r["evidence_quotes"], none), 1, 4), lambda q: F.btrim(T.stripped(q), F.lit('"')))
    quotes = F.filter(quotes, lambda q: F.length(q).between(4, 200) & F.contains(F.col("_text"), review.flat(q)))
    unsure = (F.col("_sure") < ACCEPT_REVIEW) & ~F.col("_asked")
    given = F.left(T.stripped(F.coalesce(r["reason"], F.lit(""))), F.lit(320))
    rows = rows.withColumns(
        {
            "_quotes": quotes, "_clear": ~F.col("_asked") & ~unsure, "_first": F.array(F.when(F.col("subject") != "", F.col("subject")).otherwise(F.col("file"))),
            "_reason": F.when(unsure, "AI QA was not confident enough to clear this file automatically.").when(given == "", "No reason provided.").otherwise(given),
        }
    )
    guard = F.when(~F.col("_clear"), F.lit(None)).when((F.col("n_findings") == 0) & F.col("record_attachment"), "record_attachment_zero_findings").when(F.col("policy_review"), "policy_review_required").when(F.col("uncertain"), "uncertain_extraction_quality")
    rows = rows.withColumn("error", F.when(r.isNull(), "unreadable_answer").otherwise(guard))
    e = F.col("error")
    held = ~F.col("_clear") | e.isNotNull()
    cap = F.when(e == "record_attachment_zero_findings", 0.4).when(e == "policy_review_required", 0.55).when(e == "uncertain_extraction_quality", 0.45).otherwise(1.0)
    why = (
        F.when(e == "record_attachment_zero_findings", "Record-like attachment had no deterministic findings; human review is required.").when(e == "policy_review_required", F.col("reason"))
        .when(e == "uncertain_extraction_quality", "Extraction quality was uncertain due to OCR/layout confidence; human review is required.").otherwise(F.col("_reason"))
    )
    shown = F.when((F.size("_quotes") > 0) | ~held, F.col("_quotes")).when(e == "uncertain_extraction_quality", F.col("uncertain_refs")).otherwise(F.col("_first"))
    return rows.select(
        "file", F.when(held, "needs_review").otherwise("clear").alias("status"), held.alias("needs_human_review"), F.least(F.round("_sure", 2), cap).alias("confidence"), known_types(r["suspected_missing_types"]).alias("suspected_missing_types"),
        known_types(r["questionable_detected_types"]).alias("questionable_detected_types"), shown.alias("evidence_quotes"), why.alias("reason"), "error",
    )


def review_prompts(profiles: DataFrame, sources: DataFrame, findings: DataFrame, budget: int = 1000, reach: int = 180) -> DataFrame:
    """file, prompt (JSON): the 8 surest findings, 5 attachments, and the text round findings of the 5 first sources, within a budget of characters."""
    best = Window.partitionBy("file").orderBy(F.desc("confidence"), "source_ref", "char_offset", "pii_type")
    top = findings.withColumn("_n", F.row_number().over(best)).filter("_n <= 8")
    told = top.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "pii_type", "redacted_value", "confidence", "source_ref"))), lambda x: F.struct(x["pii_type"].alias("pii_type"), x["redacted_value"].alias("redacted_value"), x["confidence"].alias("confidence"), x["source_ref"].alias("source_ref"))).alias("findings"))
    first = Window.partitionBy("file").orderBy(review.source_priority(F.col("source_ref")), "source_ref")
    some = sources.withColumn("_n", F.row_number().over(first)).filter("_n <= 5").select("file", "source_ref", "text", F.col("_n").alias("_rank"))
    place = findings.groupBy("file", "source_ref").agg(F.min("char_offset").alias("_at"))
    met = some.join(place, ["file", "source_ref"], "left").withColumn("snippet", T.collapse(T.window(F.col("text"), F.coalesce("_at", F.lit(0)), F.coalesce("_at", F.lit(0)), reach)))
    before = Window.partitionBy("file").orderBy("_rank")
    met = met.withColumn("_room", F.lit(budget) - F.coalesce(F.sum(F.length("snippet")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = met.withColumn("snippet", F.left("snippet", F.greatest(F.lit(0), F.col("_room")).cast("int"))).filter("snippet <> ''")
    context = met.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "source_ref", "snippet"))), lambda x: F.struct(x["source_ref"].alias("source_ref"), x["snippet"].alias("snippet"))).alias("context"))
    rows = profiles.select("file", "subject", F.slice("names", 1, 5).alias("attachments")).join(told, "file", "left").join(context, "file", "left")
    return rows.select("file", F.to_json(F.struct("file", "subject", "attachments", "findings", "context", F.array(*[F.lit(t) for t in KNOWN_TYPES]).alias("known_types"))).alias("prompt"))


# ---- owners of findings


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """The MOST_CANDIDATES best candidates of each finding, each owner once, as C1, C2, ...

    candidates: finding, name, email, role, method, score, evidence.
    """
    best = Window.partitionBy("finding").orderBy(F.desc("score"), F.desc(F.size("evidence")), F.desc(F.coalesce("email", F.lit(""))), F.desc(F.coalesce("name", F.lit(""))))
    top = candidates.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= MOST_CANDIDATES)
    once = Window.partitionBy("finding", F.coalesce("email", F.lit("")), T.person_form(F.coalesce("name", F.lit(""))), F.coalesce("role", F.lit(""))).orderBy("_n")
    return top.withColumn("_k", F.row_number().over(once)).filter("_k = 1").withColumn("candidate_id", F.concat(F.lit("C"), F.col("_n").cast("string"))).drop("_n", "_k")


def consult(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """finding, file of the findings to ask about: unsure or close ones, at most MOST_CALLS a message in order.

    decisions: finding, file, ord, method, confidence (null method: none was made).
    """
    best = candidates.groupBy("finding").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"), F.count("*").alias("n"))
    rows = decisions.join(best, "finding")
    own = F.coalesce(F.col("method").isin("self_identifying_email", "self_identifying_name"), F.lit(False))
    sole = (F.col("n") == 1) & (F.get("s", F.lit(0)) >= TRIGGER)
    unsure = F.col("method").isNotNull() & (F.col("confidence") < TRIGGER)
    close = F.coalesce(F.get("s", F.lit(0)) - F.get("s", F.lit(1)) <= MARGIN, F.lit(False))
    asked = rows.filter(~own & ~sole & (unsure | close))
    return asked.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("ord"))).filter(F.col("_n") <= MOST_CALLS).select("finding", "file")


def requests(asked: DataFrame, blocks: DataFrame, ranked: DataFrame) -> DataFrame:
    """finding, prompt (JSON), cache_key: the finding's block and its neighbours, and the candidates. asked: finding, source_ref, block_ix, pii_type, redacted_value, excerpt."""
    near = Window.partitionBy("source_ref").orderBy("block_ix")
    around = blocks.select("source_ref", "block_ix", F.col("text").alias("current"), F.coalesce(F.lag("text").over(near), F.lit("")).alias("previous"), F.coalesce(F.lead("text").over(near), F.lit("")).alias("next"))
    listed = ranked.groupBy("finding").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "name", "email", "role", "method", F.round("score", 2).alias("score"), "evidence"))).alias("candidates"))
    rows = asked.join(around, ["source_ref", "block_ix"]).join(listed, "finding")
    key = F.sha2(F.concat_ws("|", "source_ref", F.left(review.flat(F.col("current")), F.lit(600)), F.array_join(F.transform("candidates", lambda c: c["candidate_id"]), ",")), 256)
    return rows.select("finding", F.to_json(F.struct("source_ref", "pii_type", "redacted_value", "excerpt", "current", "previous", "next", "candidates")).alias("prompt"), key.alias("cache_key"), F.concat_ws("\n", "previous", "current", "next").alias("context"))


OWNER = "candidate_id string, confidence string, evidence_quotes array<string>, reason string"


def read_owner(v: Column, context: Column, allowed: Column) -> Column:
    """A struct candidate_id, confidence, quotes, reason of an answer that names a candidate surely and quotes the context; else null."""
    r = F.from_json(F.coalesce(as_json(v), as_json(unfenced(v)), as_json(first_object(v))), OWNER)
    sure, flat = r["confidence"].try_cast("double"), review.flat(context)
    quotes = F.filter(F.transform(F.coalesce(r["evidence_quotes"], F.array().cast("array<string>")), T.stripped), lambda q: F.length(q).between(4, 180) & F.contains(flat, review.flat(q)))
    ok = (F.array_contains(allowed, r["candidate_id"]) | (r["candidate_id"] == "UNATTRIBUTED")) & sure.between(ACCEPT_OWNER, 1.0) & (F.size(quotes) > 0)
    return F.when(ok, F.struct(r["candidate_id"].alias("candidate_id"), sure.alias("confidence"), quotes.alias("quotes"), F.left(T.stripped(F.coalesce(r["reason"], F.lit(""))), F.lit(240)).alias("reason")))


def decided(rows: DataFrame) -> DataFrame:
    """finding, name, email, entity_type, confidence, method of each answer that changes a decision.

    rows: finding, answer (read_owner()'s struct), choice (the candidate's struct or null), d_name, d_email, d_confidence
    (the decision so far, null where none).
    """
    a, c = F.col("answer"), F.col("choice")
    had = F.col("d_confidence").isNotNull()
    none = a["candidate_id"] == "UNATTRIBUTED"
    agreed = had & F.col("d_email").eqNullSafe(c["email"]) & F.col("d_name").eqNullSafe(c["name"])
    score = F.when(agreed, 0.6 * c["score"] + 0.4 * a["confidence"] + 0.03).when(had & (a["confidence"] < TRIGGER), F.lit(None)).otherwise(0.55 * c["score"] + 0.45 * a["confidence"] + 0.02)
    sure = F.when(none, F.when(~had | (F.col("d_confidence") < TRIGGER), 0.0)).when(c.isNotNull(), F.round(F.least(F.lit(0.99), score), 2))
    out = rows.withColumn("confidence", sure).filter(F.col("confidence").isNotNull() & a.isNotNull())
    return out.select(
        "finding", F.when(none, "UNATTRIBUTED").otherwise(F.coalesce(c["name"], name_from_email(c["email"]))).alias("name"), F.when(~none, c["email"]).alias("email"),
        F.when(none, "UNATTRIBUTED_BLOCK").otherwise(entity_type(c["role"])).alias("entity_type"), "confidence", F.when(none, "hybrid_local_llm_unattributed").otherwise("hybrid_local_llm").alias("method"),
    )
