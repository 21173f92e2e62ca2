"""Whom a finding belongs to: mentions of people in blocks of text, scored against each finding near them.

All of it is Columns, and equi-joins: blocks meet the people of their message's header, findings the mentions of blocks
at most three away by shifted block numbers, and one aggregate keeps the best candidate of each finding. The joins are
merges by hint: what comes of texts is far larger than its plan's estimate, and would be broadcast through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks as B
from .scan import generic_mailbox, held

# Words before a name or a mail address, roles that are just people, words that are no name.
NAME_LABELS = "full\\s+name|name|patient|employee|member|customer|client|applicant|student|borrower|dependent|spouse|child|parent|subscriber|insured|guest|traveler|passenger|renter|tenant|buyer|seller|homeowner|driver|insured\\s+party"
EMAIL_LABELS = "email|e-mail|contact\\s+email|patient\\s+email|employee\\s+email|member\\s+email"
PERSON_ROLES = ["name", "full name", "email", "e-mail", "patient", "employee", "member", "customer", "client", "applicant", "student", "borrower", "guest", "traveler", "passenger", "renter", "tenant", "buyer", "seller", "homeowner", "driver"]
TABLE_NAMES = ["full name", "name", "patient", "patient name", "employee", "employee name", "member", "member name", "dependent", "dependent name", "subscriber", "subscriber name", "customer", "customer name"]
TABLE_EMAILS = ["email", "e-mail", "personal email", "contact email", "member email", "patient email", "employee email"]
ROLE_WORDS = (
    "admissions accounts account billing care center centre company compliance customer delivery department desk dev finance help hr human insurance "
    "legal management marketing office operations payroll recruiting resources sales service services support success systems team training university"
).split()
NOTICE = "(?i)\\b(?:dear|hello|hi|your|you)\\b"
RELATED = "(?i)\\b(?:dependent|spouse|child|co-applicant|household|subscriber|patient|member|beneficiary)\\b"
TOKEN = "(?:[A-Z][A-Za-z'.-]+|[A-Z]{2,})"
EMAIL = "[A-Za-z0-9](?:[A-Za-z0-9._%+\\-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\\-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,24}"

NAME = f"{TOKEN}(?: +{TOKEN}){{1,3}}"
PAIR = f"(?i)\\b({NAME})\\s*<({EMAIL})>"
NAMED = f"(?im)\\b({NAME_LABELS})\\b(?:\\s+name)?\\s*[:#-]\\s*({NAME})"
MAILED = f"(?im)\\b({EMAIL_LABELS})\\b\\s*[:#-]\\s*({EMAIL})"
GREETED = f"(?im)^\\s*(?:dear|hello|hi)\\s+({TOKEN}(?: +{TOKEN}){{0,2}})\\s*[,:\\n]"
MENTION = "array<struct<name:string,email:string,role:string,confidence:double,method:string,evidence:array<string>>>"
REACH = 3


def clean_name(v: Column) -> Column:
    return F.regexp_replace(T.collapse(F.regexp_replace(v, "(?<=[a-z])(?=[A-Z])", " ")), "^[ ,;:]+|[ ,;:]+$", "")


def is_person_name(v: Column) -> Column:
    """Two to four capitalised tokens that are not all words of a role."""
    words = F.transform(F.split(clean_name(v), " "), lambda t: F.regexp_replace(F.lower(t), "[^a-z]", ""))
    return clean_name(v).rlike(f"^{TOKEN}(?: {TOKEN}){{1,3}}$") & ~F.forall(words, lambda w: w.isin(ROLE_WORDS))


# ---- people of the header

PEOPLE = "array<struct<n:int,email:string,name:string,role:string>>"


def header(participants: DataFrame | None) -> DataFrame | None:
    """file, people: the participants (messages.participants()) of each message as one array in their order."""
    if participants is None:
        return None
    return participants.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "email", "name", "role"))).cast(PEOPLE).alias("people"))


def with_people(rows: DataFrame, people: DataFrame | None) -> DataFrame:
    none = F.array().cast(PEOPLE)
    if people is None:
        return rows.withColumn("people", none)
    return rows.withColumn("file", file_of(F.col("source_ref"))).join(people.hint("merge"), "file", "left").withColumn("people", F.coalesce("people", none)).drop("file")


def file_of(source_ref: Column) -> Column:
    """The message that a source belongs to."""
    return F.trim(F.when(source_ref.contains(" > "), F.substring_index(source_ref, " > ", 1)).otherwise(F.substring_index(source_ref, " (", 1)))


def by_email(people: Column, email: Column) -> Column:
    return F.get(F.filter(people, lambda p: p["email"] == F.lower(F.trim(email))), F.lit(0))


def by_name(people: Column, name: Column) -> Column:
    """The one person of that name; or the only person, if the name's words are all theirs."""
    form = T.person_form(name)
    same = F.filter(people, lambda p: T.person_form(p["name"]) == form)
    only = F.get(people, F.lit(0))
    within = (form != "") & (F.size(F.array_except(F.split(form, " "), F.split(T.person_form(only["name"]), " "))) == 0)
    return F.when(F.size(same) == 1, F.get(same, F.lit(0))).when((F.size(people) == 1) & within, only)


def tabular(text: Column, people: Column) -> Column:
    """The mention of a row of a table: labelled cells first, else any cell that is a name or holds an address."""
    cells = F.filter(F.transform(F.split(text, "\t"), T.stripped), lambda c: c != "")
    labelled = F.transform(F.filter(cells, lambda c: c.contains(":")), lambda c: F.struct(F.lower(T.stripped(F.substring_index(c, ":", 1))).alias("label"), T.stripped(F.substr(c, F.instr(c, ":") + 1, F.length(c))).alias("value")))

    def first(values):
        return F.get(values, F.lit(0))

    def mail(v):
        return F.nullif(F.lower(F.regexp_extract(v, f"({EMAIL})", 1)), F.lit(""))

    name = first(F.transform(F.filter(labelled, lambda x: x["label"].isin(TABLE_NAMES) & is_person_name(x["value"])), lambda x: clean_name(x["value"])))
    email = first(F.filter(F.transform(F.filter(labelled, lambda x: x["label"].isin(TABLE_EMAILS)), lambda x: mail(x["value"])), lambda m: m.isNotNull()))
    heading = (F.size(labelled) == 0) & F.forall(cells, lambda c: ~c.rlike("[0-9]") & (F.size(F.split(c, "\\s+")) <= 4))
    loose = name.isNull() & email.isNull() & ~heading
    name = F.coalesce(name, F.when(loose, first(F.transform(F.filter(cells, is_person_name), clean_name))))
    email = F.coalesce(email, F.when(loose, first(F.filter(F.transform(cells, mail), lambda m: m.isNotNull()))))
    person = F.when(name.isNotNull(), by_name(people, name)).otherwise(by_email(people, email))
    found = F.struct(F.coalesce(name, person["name"]).alias("name"), F.coalesce(email, person["email"]).alias("email"), person.isNotNull().alias("known"))
    return F.when(text.contains("\t") & (name.isNotNull() | email.isNotNull()), found)


def name_from_email(email: Column) -> Column:
    """The local part's words, capitalised; null where none are left."""
    words = T.collapse(F.regexp_replace(F.regexp_replace(F.substring_index(email, "@", 1), "[0-9]+", ""), "[._+-]+", " "))
    return F.nullif(F.initcap(words), F.lit(""))


def _labelled(text: Column, pattern: str) -> Column:
    """array<struct<label, value, at>> of a pattern whose second group ends the match."""
    return F.transform(T.spans(text, pattern, 2), lambda s: F.struct(T.collapse(F.lower(F.regexp_extract(s["whole"], pattern, 1))).alias("label"), s["raw"].alias("value"), s["start"].alias("at")))


def _mention(name, email, role, confidence, method: str, *evidence) -> Column:
    null = F.lit(None).cast("string")
    cols = {"name": name, "email": email, "role": role}
    return F.struct(*[(null if v is None else v).alias(k) for k, v in cols.items()], confidence.cast("double").alias("confidence"), F.lit(method).alias("method"), F.array_compact(F.array(*evidence)).alias("evidence"))


def mentions(blocks: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """source_ref, block_ix, name, email, role, confidence, method, evidence of each block's mentions; the surest of equal ones.

    people: header()'s rows, so that mailboxes of the header count as people's and give their names.
    """
    text, none = F.col("text"), F.array().cast(MENTION)
    empty = F.array().cast("array<struct<label:string,value:string,at:int>>")
    rows = with_people(blocks.select("source_ref", "block_ix", "text"), people).withColumn("_low", F.lower("text"))
    marks = F.col("_low").contains(":") | F.col("_low").contains("#") | F.col("_low").contains("-")
    rows = held(
        rows,
        named=F.when(marks, F.filter(_labelled(text, NAMED), lambda n: is_person_name(n["value"]))).otherwise(empty),
        mailed=F.when(text.contains("@"), _labelled(text, MAILED)).otherwise(empty),
        pairs=F.when(text.contains("<") & text.contains("@"), F.transform(T.spans(text, PAIR, 0), lambda s: F.struct(F.regexp_extract(s["span"], PAIR, 1).alias("name"), F.lower(F.regexp_extract(s["span"], PAIR, 2)).alias("email")))),
        greeting=F.when(F.col("_low").rlike("dear|hello|hi"), clean_name(F.regexp_extract(text, GREETED, 1))).otherwise(""),
        mails=F.when(text.contains("@"), F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1)), F.lower))).otherwise(F.array().cast("array<string>")),
        row=F.when(text.contains("\t"), tabular(text, F.col("people"))),
    )
    inline = F.transform(F.filter("pairs", lambda p: is_person_name(p["name"])), lambda p: _mention(clean_name(p["name"]), p["email"], None, F.lit(0.97), "inline_name_email_pair", F.lit("inline-name-email-pair")))

    def named(n):
        near = F.filter("mailed", lambda e: F.abs(e["at"] - n["at"]) <= 140)
        alike = F.filter(near, lambda e: F.startswith(e["label"], F.substring_index(n["label"], " ", 1)))
        mail = F.lower(F.coalesce(F.get(alike, F.lit(0))["value"], F.get(near, F.lit(0))["value"]))
        return _mention(clean_name(n["value"]), mail, n["label"], F.when(mail.isNotNull(), 0.95).otherwise(0.9), "same_block_label", F.concat(F.lit("label:"), n["label"]), F.when(mail.isNotNull(), "paired-labeled-email"))

    def known(mail):
        return F.exists("people", lambda p: p["email"] == F.lower(mail))

    def mailed(e):
        mail = F.lower(e["value"])
        return _mention(F.coalesce(by_email(F.col("people"), mail)["name"], name_from_email(mail)), mail, e["label"], F.lit(0.84), "same_block_email_label", F.concat(F.lit("label:"), e["label"]))

    own_mail = F.filter("mailed", lambda e: ~generic_mailbox(e["value"]) | known(e["value"]))
    greeted = F.when(F.col("greeting") != "", F.array(_mention(F.col("greeting"), None, None, F.lit(0.74), "salutation_match", F.lit("salutation-anchor"))))
    bare = F.filter("mails", lambda e: ~generic_mailbox(e) | known(e))
    sole = F.get(bare, F.lit(0))
    person = by_email(F.col("people"), sole)
    only = F.when(F.size(bare) == 1, F.array(_mention(F.coalesce(person["name"], name_from_email(sole)), sole, None, F.when(person.isNotNull(), 0.78).otherwise(0.72), "single_inline_email", F.lit("single-inline-email"))))
    row, sure = F.col("row"), F.when(F.col("row.name").isNotNull() & F.col("row.email").isNotNull(), 0.93).otherwise(0.82)
    sure = F.least(F.lit(0.98), sure + F.when(row["known"], 0.03).otherwise(0.0))
    lined = F.when(row.isNotNull(), F.array(_mention(row["name"], row["email"], None, sure, "tabular_row_anchor", F.lit("tabular-row-anchor"), F.when(row["known"], "header-participant-link"))))
    found = F.concat(*[F.coalesce(x.cast(MENTION), none) for x in (inline, lined, F.transform("named", named), F.transform(own_mail, mailed), greeted, only)])
    each = rows.select("source_ref", "block_ix", F.posexplode(found).alias("n", "m"))
    best = each.groupBy("source_ref", "block_ix", F.coalesce("m.name", F.lit("")).alias("_name"), F.coalesce("m.email", F.lit("")).alias("_email"), F.coalesce("m.role", F.lit("")).alias("_role")).agg(F.max_by("m", F.struct("m.confidence", -F.col("n"))).alias("m"))
    return best.select("source_ref", "block_ix", "m.*")


def entity_type(role: Column) -> Column:
    return F.when(role.isNull() | role.isin(PERSON_ROLES), "PERSON").otherwise(F.replace(F.upper(role), F.lit(" "), F.lit("_")))


def direct_notice(rows: DataFrame) -> Column:
    """The owner of a finding in a letter to one person: rows hold source_ref, people, and around (the blocks up to two before)."""
    people, around = F.col("people"), F.col("around")
    to = F.filter(people, lambda p: p["role"] == "recipient")
    others = F.exists(people, lambda p: p["role"].isin("cc", "bcc"))
    one = F.get(to, F.lit(0))
    name = F.coalesce(one["name"], name_from_email(one["email"]))
    form = T.person_form(name)
    # a block that is nothing but the recipient's name, or a part of it
    called = F.exists(F.transform(F.split(around, "\n"), T.person_form), lambda b: (b != "") & (F.size(F.split(b, " ")) <= 3) & (F.size(F.array_except(F.split(b, " "), F.split(form, " "))) == 0))
    told = around.rlike(NOTICE) | called
    greeted = around.rlike(GREETED) | called
    ok = (F.size(to) == 1) & ~others & ~F.col("source_ref").contains(">") & told & ~around.rlike(RELATED)
    return F.when(ok, F.struct(name.alias("name"), one["email"].alias("email"), F.lit("PERSON").alias("type"), F.when(greeted, 0.8).otherwise(0.74).alias("confidence"), F.lit("sole_recipient_direct_notice").alias("method")))


def candidates(findings: DataFrame, blocks: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """findings (with block_ix and finding_no) by the scored mentions near them: a row each, `m` null where there is none.

    m: score, n_evidence, email, name, role, method, evidence, in the order that decides; owners that come twice count once.
    """
    near = mentions(blocks, people).withColumn("_d", F.explode(F.array(*[F.lit(d) for d in range(-REACH, REACH + 1)])))
    near = near.select(F.col("source_ref").alias("_ref"), (F.col("block_ix") + F.col("_d")).alias("_block"), F.abs("_d").alias("_far"), F.struct("name", "email", "role", "confidence", "method", "evidence").alias("_m"))
    met = with_people(findings, people).join(near.hint("merge"), (F.col("source_ref") == F.col("_ref")) & (F.col("block_ix") == F.col("_block")), "left")
    m, value = F.col("_m"), F.col("normalized_value")
    same_mail = F.coalesce((F.col("pii_type") == "EMAIL") & (F.lower(value) == m["email"]), F.lit(False))
    same_name = F.coalesce((F.col("pii_type") == "FULL_NAME") & (T.person_form(m["name"]) == value), F.lit(False))
    met = held(met, _named=F.when(m["email"].isNull() & m["name"].isNotNull(), by_name(F.col("people"), m["name"])["email"]), _known=F.when(m["name"].isNull() & m["email"].isNotNull(), by_email(F.col("people"), m["email"])["name"]), _same_mail=same_mail, _same_name=same_name)
    linked, told = F.col("_named").isNotNull(), F.col("_known").isNotNull()
    score = m["confidence"] - 0.08 * F.col("_far") + F.when(F.col("_far") == 0, 0.04).otherwise(-0.06)
    for test, more in ((F.col("_same_mail"), 0.12), (F.col("_same_name"), 0.12), (linked, 0.05), (told, 0.04)):
        score = score + F.when(test, more).otherwise(0.0)
    labels = [F.when(F.col("_far") > 0, "neighbor-block"), F.when(F.col("_same_mail"), "finding-email-matched-anchor"), F.when(F.col("_same_name"), "finding-name-matched-anchor"), F.when(linked, "header-participant-matched-name"), F.when(told, "header-participant-matched-email")]
    evidence = F.concat(m["evidence"], F.array_compact(F.array(*labels)))
    email = F.coalesce(m["email"], F.col("_named"))
    name = F.coalesce(m["name"], F.col("_known"), name_from_email(email))
    ranked = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)).alias("score"), F.size(evidence).alias("n_evidence"), F.coalesce(email, F.lit("")).alias("email"), F.coalesce(name, F.lit("")).alias("name"), m["role"].alias("role"), m["method"].alias("method"), evidence.alias("evidence"))
    return met.select(*findings.columns, "people", F.when(m.isNotNull(), ranked).alias("m"))


def attribute(findings: DataFrame, sources: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """findings with entity_key, entity_name, entity_email, entity_type, attribution_confidence, attribution_method, attribution_evidence.

    Candidates first; then the one person that a letter is to; then values that name their owner (mail addresses, full
    names); what is left belongs to its block. participants: messages.participants().
    """
    blocks, people = B.segment(sources), header(participants)
    placed = B.lookup(findings, blocks)
    met = candidates(placed, blocks, people)
    keys = ["source_ref", "finding_no"]
    best = met.groupBy(*keys).agg(F.first(F.struct(*[c for c in placed.columns if c not in keys], "people")).alias("f"), F.max("m").alias("b")).select(*keys, "f.*", "b")
    if people is not None:
        near = Window.partitionBy("source_ref").orderBy("block_ix")
        around = blocks.select("source_ref", "block_ix", F.concat_ws("\n", F.lag("text", 2).over(near), F.lag("text", 1).over(near), "text").alias("around"))
        best = best.join(around.hint("merge"), ["source_ref", "block_ix"], "left").withColumn("around", F.coalesce("around", F.lit("")))
    b, value = F.col("b"), F.col("normalized_value")
    own_mail = (F.col("pii_type") == "EMAIL") & (value != "") & ~generic_mailbox(value)
    own_name = (F.col("pii_type") == "FULL_NAME") & (value != "")

    def decided(name, email, type_, confidence, method):
        return F.struct(name.alias("name"), email.alias("email"), type_.alias("type"), confidence.cast("double").alias("confidence"), method.alias("method"))

    null, person, nothing = F.lit(None).cast("string"), F.lit("PERSON"), F.lit("")
    owner = F.coalesce(
        F.when(b.isNotNull(), decided(F.nullif(b["name"], nothing), F.nullif(b["email"], nothing), entity_type(b["role"]), F.floor(b["score"] * 100 + 0.5) / 100, b["method"])),
        *([] if people is None else [direct_notice(best)]),
        F.when(own_mail, decided(name_from_email(F.lower(value)), F.lower(value), person, F.lit(0.95), F.lit("self_identifying_email"))),
        F.when(own_name, decided(F.initcap(F.lower(value)), null, person, F.lit(0.9), F.lit("self_identifying_name"))),
        decided(F.lit("UNATTRIBUTED"), null, F.lit("UNATTRIBUTED"), F.lit(0.0), F.lit("unattributed")),
    )
    out = held(best, o=owner)
    key = F.when(F.col("o.type") == "UNATTRIBUTED", F.concat_ws(":", F.lit("block"), "source_ref", F.col("block_ix").cast("string"))).when(F.col("o.email").isNotNull(), F.concat(F.lit("email:"), F.lower("o.email"))).otherwise(F.concat(F.lit("name:"), F.col("o.type"), F.lit(":"), T.person_form(F.col("o.name"))))
    return out.select(
        *findings.columns, "block_ix", key.alias("entity_key"), F.col("o.name").alias("entity_name"), F.col("o.email").alias("entity_email"), F.col("o.type").alias("entity_type"), F.col("o.confidence").alias("attribution_confidence"),
        F.col("o.method").alias("attribution_method"), F.coalesce(b["evidence"], F.array(F.col("o.method"))).alias("attribution_evidence"),
    )
