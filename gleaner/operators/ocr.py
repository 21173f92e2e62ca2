"""Scanned text: lines from recognised words, repair of damaged labels and values, and the choice among passes.

Recognition itself is left to whatever gives word tables (TSV); from there on all is Columns, but for the likeness of a
line's head to a label (a gestalt ratio, which Spark has no function for): that is one Arrow function over the few heads
a line may have.
"""

from __future__ import annotations

import difflib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T

# Common misreadings, labels and what they are read from, and letters that are taken for one another.
WORD_FIXES = {
    "adress": "address", "avenus": "avenue", "diagnesiscode": "diagnosis code", "diagnesis": "diagnosis", "identiy": "identity", "vertcaion": "verification",
    "atement": "statement", "supportcontact": "support contact", "follow-updue": "follow-up due", "prvacy": "privacy",
}
DOMAIN_FIXES = {
    "emailcom": "email.com", "gmailcom": "gmail.com", "yahoa.com": "yahoo.com", "yahoocom": "yahoo.com", "yah0o.com": "yahoo.com", "yah00.com": "yahoo.com", "yahoa.co": "yahoo.co", "yahoa.net": "yahoo.net",
    "gmai1.com": "gmail.com", "gmai1.co": "gmail.co", "outlookcom": "outlook.com", "out1ook.com": "outlook.com", "outiook.com": "outlook.com", "protonmailcom": "protonmail.com", "protonmai.com": "protonmail.com",
}
LABELS = {
    "Full Name": ["full name", "fullname", "full nane"], "Date of Birth": ["date of birth", "birth date", "dob", "d.o.b"], "SSN": ["ssn", "social security number", "social security"], "MRN": ["mrn", "medical record number", "record number"],
    "Medicare Number": ["medicare number", "medicare", "mbi"], "Diagnosis Code": ["diagnosis code", "icd10", "icd-10", "icd 10"], "NDC": ["ndc", "ndc code", "drug code"], "Home Address": ["home address", "address", "mailing address"],
    "Personal Email": ["personal email", "email", "e-mail", "email address"], "Mobile Phone": ["mobile phone", "phone", "phone number", "telephone"], "Passport Number": ["passport", "passport number"],
    "Driver's License Number": ["driver's license number", "driver license number", "drivers license number"], "IBAN": ["iban"], "Routing Number": ["routing number", "aba", "transit number"], "Account Number": ["account number", "bank account", "acct number"],
}
SHORT_LABELS = {"DOB": "d0b|do8|0?8|dob", "SSN": "ssn|ssh|ssm|s5n", "MRN": "mrn|mn|mrn\\.|m rn|wn", "NDC": "ndc|nbe|nde"}
TLDS = "com|org|net|io|co|edu|gov|us|ca"
PROVIDERS = [("e\\s*mail\\s*[LlI1]?", "email"), ("g\\s*mai\\s*[LlI1]?", "gmail"), ("y\\s*a\\s*h\\s*o\\s*o", "yahoo"), ("out\\s*look", "outlook"), ("proton\\s*mail", "protonmail")]
MAILBOX = "(?i)([A-Za-z0-9][A-Za-z0-9._%+\\-]{0,62})\\s*@\\s*([A-Za-z0-9][A-Za-z0-9.\\-]{1,80})"
DATE = "(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})"
PHONE = "(?<!\\d)(?:\\+?1[-.\\s]?)?(?:\\([2-9][0-9]{2}\\)|[2-9][0-9]{2})[-.\\s]?\\d{2,3}[-.\\s]?\\d{4}(?!\\d)"
TO_DIGIT, TO_DIGIT_OF = "OQIL5SB", ("OQILSB", "001158")
MEDICARE_DIGITS, MEDICARE_TO_DIGIT, MEDICARE_TO_LETTER = [0, 3, 6, 9, 10], ("OQILZSBEG", "001125866"), ("01258", "OIZSB")
IBAN_LENGTHS = {
    "AL": 28, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
ALIKE = {"0": "0O", "O": "O0", "1": "1ILM", "I": "I1L", "L": "L1I", "2": "2Z", "Z": "Z2", "5": "5S", "S": "S5", "6": "6GE", "G": "G6", "E": "E6", "8": "8B", "B": "B8", "M": "MNH1", "N": "NMH", "H": "HMN"}
PARTICLES = ["de", "del", "della", "di", "la", "le", "van", "von", "st"]
DATE_VALUE, SSN_VALUE, ADDRESS_VALUE = "\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}\\b", "\\b\\d{3}[-\\s]?\\d{2}[-\\s]?\\d{4}\\b", "\\b\\d{1,6}\\s+[A-Za-z0-9 .'-]+,\\s*[A-Za-z .'-]+,\\s*[A-Z]{2}\\s+\\d{5}(?:-\\d{4})?\\b"
FIELD_WORDS = ["full name", "date of birth", "dob", "ssn", "mrn", "medicare", "address", "phone", "email"]
LIKE_LABEL, LOW_CONFIDENCE, FEW_WORDS = 0.76, 72.0, 4
ENDS = " ,;:"


def _cut(v: Column, chars: str = ENDS) -> Column:
    return F.btrim(v, F.lit(chars))


# ---- labels


@cache
def label_of(head: str) -> str | None:
    """The label that a line's head is most like, letters alone compared; none below LIKE_LABEL."""
    letters = re.sub("[^a-z]", "", head.lower())
    if not letters:
        return None
    scored = [(difflib.SequenceMatcher(None, letters, re.sub("[^a-z]", "", a)).ratio(), label) for label, names in LABELS.items() for a in names]
    best = max(s for s, _ in scored)
    return next(label for s, label in scored if s == best) if best >= LIKE_LABEL else None


def labels_of(heads: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(v: pa.Array) -> pa.Array:
        if len(v) and label_of.cache_info().currsize > 100_000:
            label_of.cache_clear()
        return pa.array([[label_of(h) if h else None for h in x or []] for x in v.to_pylist()], pa.list_(pa.string()))

    return run(heads)


def _short_label(line: Column) -> Column:
    out = None
    for label, shapes in SHORT_LABELS.items():
        p = f"(?i)^\\s*(?:{shapes})\\b[\\s:.-]*(.+)$"
        one = F.struct(F.lit(label).alias("label"), F.regexp_extract(line, p, 1).alias("value"))
        out = F.when(line.rlike(p), one) if out is None else out.when(line.rlike(p), one)
    return out


def heads(line: Column) -> Column:
    """array<struct<head, value>>: where a line may be cut into a label and a value, the likelier first."""
    words = F.filter(F.split(line, "\\s+"), lambda w: w != "")
    plain = F.aggregate(F.slice(words, 1, 5), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + (a["on"] & ~w.rlike("[0-9]")).cast("int")).alias("n"), (a["on"] & ~w.rlike("[0-9]")).alias("on")), lambda a: a["n"])

    def pair(head, value):
        return F.struct(head.alias("head"), value.alias("value"))

    def at(mark, cond):
        place = F.instr(line, mark)
        return F.when(cond, pair(F.substr(line, F.lit(1), place - 1), F.substr(line, place + 1, F.length(line))))

    def found(shape):
        head = F.substring_index(F.regexp_replace(line, shape, T.MARK), T.MARK, 1)
        return F.when(line.rlike(shape) & (_cut(head, " ,-.:") != ""), pair(_cut(head, " ,-.:"), F.substr(line, F.length(head) + 1, F.length(line))))

    def first(n):
        head = F.array_join(F.slice(words, F.lit(1), n), " ")
        return pair(head, _cut(F.substr(line, F.length(head) + 1, F.length(line)), " ,-.:"))

    many = F.size(words) >= 2
    leading = F.when(many & (plain > 0), F.transform(F.reverse(F.sequence(F.lit(1), plain)), first)).otherwise(F.array().cast("array<struct<head:string,value:string>>"))
    four = F.when(many & (F.size(words) > 4), first(F.lit(4)))
    return F.concat(F.array_compact(F.array(at(":", line.contains(":")), at("-", F.left(line, F.lit(28)).contains("-")), found(MAILBOX), found(DATE), found("(?i)" + PHONE))), leading, F.array_compact(F.array(four)))


# ---- values


def digits_read(v: Column) -> Column:
    return F.translate(F.upper(v), *TO_DIGIT_OF)


def repaired_mail(v: Column) -> Column:
    """Mailboxes whose parts were set apart or misread, put together."""
    out = F.regexp_replace(v, "([A-Za-z0-9._%+\\-])\\s*[$€£]\\s*(?=@)", "$1")
    out = F.regexp_replace(out, f"(?i)@\\s*([A-Za-z0-9.-]+)\\s+[LlI1]?({TLDS})\\b", "@$1.$2")
    for shape, name in PROVIDERS:
        out = F.regexp_replace(out, f"(?i)@\\s*{shape}\\s*({TLDS})\\b", f"@{name}.$1")
    marked = F.split(F.regexp_replace(F.translate(out, T.MARK, T.OTHER), MAILBOX, f"{T.MARK}$0{T.MARK}"), T.MARK, -1)
    fixes = F.create_map(*[F.lit(x) for kv in DOMAIN_FIXES.items() for x in kv])

    def box(x):
        domain = F.replace(F.lower(F.regexp_replace(F.substring_index(x, "@", -1), "\\s+", "")), F.lit(".."), F.lit("."))
        domain = F.when(~domain.contains("."), F.regexp_replace(domain, f"^([a-z0-9-]+?)(?:[l1i])?({TLDS})$", "$1.$2")).otherwise(domain)
        return F.concat(F.regexp_replace(F.substring_index(x, "@", 1), "\\s+", ""), F.lit("@"), F.coalesce(F.try_element_at(fixes, domain), domain))

    out = F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, box(x)).otherwise(x)), "")
    out = F.regexp_replace(out, f"(?<=@)([A-Za-z0-9-]+)(?=(?:{TLDS})\\b)", "$1.")
    return F.regexp_replace(out, "\\s+\\.\\s+", ".")


def state_and_zip(v: Column) -> Column:
    return F.regexp_replace(v, "\\b([A-Z]{2})(\\d{5}(?:-\\d{4})?)\\b", "$1 $2")


def repaired_date(v: Column, this_year: Column | None = None) -> Column:
    """mm/dd/yyyy of the first date that the digits may be read as; the value as it is without one."""
    now = F.year(F.current_date()) if this_year is None else this_year
    read = digits_read(v)
    month, day, raw = (F.regexp_extract(read, DATE, i) for i in (1, 2, 3))
    year = raw.try_cast("int")
    turned = F.concat(F.lit("19"), F.substr(raw, F.lit(3), F.lit(9))).try_cast("int")
    year = F.when(F.length(raw) == 2, F.when(year > 30, year + 1900).otherwise(year + 2000)).when((year < 1900) & raw.startswith("1"), turned).when((year > now + 1) & raw.startswith("2"), turned).otherwise(year)

    def two(x, most):
        return F.lpad(F.greatest(F.lit(1), F.least(x.try_cast("int"), F.lit(most))).cast("string"), 2, "0")

    return F.when(raw != "", F.concat_ws("/", two(month, 12), two(day, 31), F.lpad(year.cast("string"), 4, "0"))).otherwise(_cut(v))


def repaired_ssn(v: Column) -> Column:
    read = digits_read(v)
    d = T.digits_only(read)
    return F.when(F.length(d) >= 9, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))).otherwise(T.stripped(F.regexp_replace(read, "[|,;]+$", "")))


def repaired_address(v: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(v, "(?i)\\bAvenus?\\b", "Avenue"), "(?i)\\b[PR]d\\b", "Rd")
    out = F.regexp_replace(state_and_zip(out), "\\b([A-Za-z .'-]+)\\s+([A-Z]{2})\\s+(\\d{5}(?:-\\d{4})?)\\b", "$1, $2 $3")
    out = F.regexp_replace(out, "(?i)\\bAdress\\b", "Address")
    for word in "avenue street road lane drive boulevard court place way circle trail parkway".split():
        out = F.regexp_replace(out, f"(?i)\\b{word}\\b", word.title())
    return _cut(F.regexp_replace(out, "\\s{2,}", " "))


def repaired_diagnosis(v: Column) -> Column:
    plain = F.translate(_cut(v), "£€", "EE")
    c = T.compact_alnum(plain)
    c = F.when((F.length(c) >= 3) & c.rlike("^[012568]"), F.concat(F.translate(F.substring(c, 1, 1), "012568", "OIZSGB"), F.substr(c, F.lit(2), F.length(c)))).otherwise(c)
    return F.when(c.rlike("^[A-Z][0-9]{2}([0-9A-Z]{1,4})?$"), F.concat_ws(".", F.substring(c, 1, 3), F.nullif(F.substr(c, F.lit(4), F.length(c)), F.lit("")))).otherwise(plain)


def repaired_medicare(v: Column) -> Column:
    c = T.compact_alnum(v)
    letters = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x, i: F.when(i.isin(MEDICARE_DIGITS), F.translate(x, *MEDICARE_TO_DIGIT)).otherwise(F.translate(x, *MEDICARE_TO_LETTER)))
    return F.when(F.length(c) == 11, F.array_join(letters, "")).otherwise(_cut(v))


def repaired_iban(v: Column) -> Column:
    """The IBAN itself, or the one valid reading with one letter changed, put in or left out; the rightmost change where there are more."""
    plain = T.stripped(F.regexp_replace(v, "[|,;]+$", ""))
    c = T.compact_alnum(plain)
    n, places = F.length(c), lambda last: F.sequence(F.lit(5), last)
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv]), F.substring(c, 1, 2))
    alike = F.create_map(*[x for k, vs in ALIKE.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in vs if o != k]))])
    every = F.array(*[F.lit(x) for x in sorted(set("".join(ALIKE.values())))])
    none = F.array().cast("array<string>")

    def put(i, x, skip):
        return F.struct(F.concat(F.substr(c, F.lit(1), i - 1), x, F.substr(c, i + skip, n)).alias("v"), i.alias("at"))

    def change(i):
        return F.transform(F.coalesce(F.try_element_at(alike, F.substr(c, i, F.lit(1))), none), lambda x: put(i, x, 1))

    tried = (
        F.when(n == wanted, F.flatten(F.transform(places(n), change))).when(n == wanted - 1, F.flatten(F.transform(places(n + 1), lambda i: F.transform(every, lambda x: put(i, x, 0)))))
        .when(n == wanted + 1, F.transform(places(n), lambda i: put(i, F.lit(""), 1)))
    )
    valid = F.filter(tried, lambda x: checks.iban(x["v"]))
    values = F.array_distinct(F.transform(valid, lambda x: x["v"]))
    last = F.array_max(F.transform(valid, lambda x: x["at"]))
    rightmost = F.array_distinct(F.transform(F.filter(valid, lambda x: x["at"] == last), lambda x: x["v"]))
    sound = (n >= 8) & c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    return F.when(sound & checks.iban(c), c).when(sound & (F.size(values) == 1), F.get(values, F.lit(0))).when(sound & (F.size(rightmost) == 1), F.get(rightmost, F.lit(0))).otherwise(plain)


def repaired_name(v: Column) -> Column:
    """Short parts of one word that stand apart are put together, but for particles of names."""
    tokens = F.filter(F.split(_cut(F.regexp_replace(v, "(?<=[a-z])(?=[A-Z])", " ")), "\\s+"), lambda t: t != "")

    def short(t):
        bare = F.regexp_replace(t, "['-]", "")
        return bare.rlike("^\\p{L}{1,3}$") & ~F.lower(bare).isin(PARTICLES)

    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(-1).alias("i"))

    def upper(t):
        return (t == F.upper(t)) & (t != F.lower(t))

    def step(acc, t):
        """held: the last token, while it may still be joined to the next one."""
        i, held = acc["i"] + 1, acc["held"]
        split = (t == F.lower(t)) & (t != F.upper(t)) | upper(held) | upper(t) | ((F.size(tokens) >= 3) & (i == 1))
        join = (held != "") & short(held) & short(t) & split
        out = F.when(join, F.concat(acc["out"], F.array(F.concat(held, t)))).when(held != "", F.concat(acc["out"], F.array(held))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(join, F.lit("")).otherwise(t).alias("held"), i.alias("i"))

    joined = F.aggregate(tokens, state, step, lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))
    return _cut(F.array_join(joined, " "))


def repaired_value(label: Column, value: Column) -> Column:
    v = _cut(value)
    return (
        F.when(label == "Full Name", repaired_name(v)).when(label.isin("Date of Birth", "DOB"), repaired_date(v)).when(label == "SSN", repaired_ssn(v)).when(label == "Personal Email", _cut(repaired_mail(v)))
        .when(label == "Home Address", repaired_address(v)).when(label == "Diagnosis Code", repaired_diagnosis(v)).when(label == "Medicare Number", repaired_medicare(v)).when(label == "IBAN", repaired_iban(v))
        .otherwise(T.stripped(F.regexp_replace(v, "[|,;]+$", "")))
    )


def cleaned(line: Column) -> Column:
    out = F.replace(F.replace(F.translate(line, "’“”", "'\"\""), F.lit("‘"), F.lit("")), F.lit("|"), F.lit(" | "))
    out = F.regexp_replace(out, "(?<=[a-z])(?=[A-Z])", " ")
    for wrong, right in WORD_FIXES.items():
        out = F.regexp_replace(out, f"(?i)\\b{re.escape(wrong)}\\b", right)
    return state_and_zip(repaired_mail(_cut(F.regexp_replace(out, "\\s+", " "))))


def repaired(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with `repaired`: each line as `Label: value` where its head is a label, else cleaned."""
    out = rows.withColumn("_clean", cleaned(F.col(line))).withColumn("_heads", heads(F.col("_clean")))
    out = out.withColumn("_labels", labels_of(F.transform("_heads", lambda h: h["head"])))
    at = F.array_position(F.transform("_labels", lambda x: x.isNotNull()), True).cast("int")
    like = F.when(at > 0, F.struct(F.get("_labels", at - 1).alias("label"), F.get("_heads", at - 1)["value"].alias("value")))
    out = out.withColumn("_found", F.coalesce(_short_label(F.col("_clean")), like))
    whole = F.btrim(F.concat(F.col("_found.label"), F.lit(": "), repaired_value(F.col("_found.label"), F.col("_found.value"))), F.lit(" :"))
    return out.withColumn("repaired", F.coalesce(whole, T.stripped(F.col("_clean")))).drop("_clean", "_heads", "_labels", "_found")


# ---- word tables


def lines_of(tables: DataFrame, keys: list[str], tsv: str = "tsv") -> DataFrame:
    """keys, page, block, par, line_no, line, and the sum and number of word confidences: words of level 5 grouped by line, left to right."""
    rows = tables.select(*keys, F.split(F.regexp_replace(tsv, "\\r", ""), "\n").alias("_all"))
    rows = rows.select(*keys, F.split(F.get("_all", F.lit(0)), "\t").alias("_head"), F.posexplode(F.slice("_all", F.lit(2), F.size("_all"))).alias("_n", "_row"))
    cells = F.split("_row", "\t", -1)

    def of(name):
        return F.get(cells, F.array_position("_head", name).cast("int") - 1)

    cols = {"level": "int", "page_num": "int", "block_num": "int", "par_num": "int", "line_num": "int", "left": "double", "conf": "double"}
    rows = rows.select(*keys, "_n", *[of(c).try_cast(t).alias(c) for c, t in cols.items()], T.stripped(of("text")).alias("word")).filter("level = 5 AND word <> ''")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col("left").cast("int").alias("left"), "_n", "word"))), lambda x: x["word"])
    sure = F.when(F.col("conf") >= 0, F.col("conf"))
    return rows.groupBy(*keys, F.col("page_num").alias("page"), F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line_no")).agg(F.array_join(in_order, " ").alias("line"), F.coalesce(F.sum(sure), F.lit(0.0)).alias("conf_sum"), F.count(sure).alias("conf_n"))


def field_score(text: Column) -> Column:
    """How many lines hold a labelled value of the right shape, a line once for each kind."""
    kinds = [("(?i)date of birth:|^dob:", DATE_VALUE), ("(?i)^ssn:", SSN_VALUE), ("(?i)address:", ADDRESS_VALUE)]

    def score(line):
        after = F.substr(line, F.instr(line, ":") + 1, F.length(line))
        name = line.rlike("(?i)full name:") & (F.size(F.filter(F.split(after, "\\s+"), lambda w: w != "")) >= 2)
        return sum(((line.rlike(label) & line.rlike(value)).cast("int") for label, value in kinds), name.cast("int"))

    return F.aggregate(F.transform(F.split(text, "\n"), score), F.lit(0), lambda a, x: a + x)


def quality_score(text: Column, confidence: Column, low: Column) -> Column:
    words = F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))
    hits = sum((F.lower(text).contains(w).cast("int") for w in FIELD_WORDS), F.lit(0))
    return confidence + words * 0.4 + hits * 10.0 + field_score(text) * 16.0 - F.when(low, 18.0).otherwise(0.0)


def structured(text: Column) -> Column:
    """Whether a scanned text looks like a record."""
    return F.coalesce(F.lower(text).rlike("full name|date of birth|ssn|member id|mrn"), F.lit(False))


def pages(tables: DataFrame, keys: list[str], tsv: str = "tsv") -> DataFrame:
    """keys, text (repaired lines), ocr_confidence (mean, two places), ocr_low, n_pages, warnings, score, structured of each word table."""
    lines = repaired(lines_of(tables, keys, tsv))
    got = lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "par", "line_no", "repaired"))), lambda x: x["repaired"]), "\n").alias("text"), F.sum("conf_sum").alias("_sum"),
        F.sum("conf_n").alias("_n"), F.max("page").alias("n_pages"), F.bool_or(F.col("repaired") != F.col("line")).alias("_changed"),
    )
    out = tables.select(*keys).join(got, keys, "left")
    mean = F.when(F.coalesce("_n", F.lit(0)) > 0, F.round(F.col("_sum") / F.col("_n"), 2)).otherwise(0.0)
    out = out.withColumns({"text": F.coalesce("text", F.lit("")), "ocr_confidence": mean, "n_pages": F.coalesce("n_pages", F.lit(1))})
    out = out.withColumn("ocr_low", (F.col("ocr_confidence") < LOW_CONFIDENCE) | (F.coalesce("_n", F.lit(0)) < FEW_WORDS))
    warnings = F.array_compact(F.array(F.when(F.col("text") == "", "empty_ocr_output"), F.when(F.col("ocr_low"), "low_confidence_ocr"), F.when(F.coalesce("_changed", F.lit(False)), "ocr_text_normalized")))
    return out.select(*keys, "text", "ocr_confidence", "ocr_low", "n_pages", warnings.alias("warnings"), quality_score(F.col("text"), F.col("ocr_confidence"), F.col("ocr_low")).alias("score"), structured(F.col("text")).alias("structured"))


def best_pass(passes: DataFrame, keys: list[str], order: str = "pass") -> DataFrame:
    """The pass of the best score of each key, the first among equals, with weak: whether further modes are worth a try."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), order)
    few = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")) < FEW_WORDS
    return passes.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").withColumn("weak", (F.col("text") == "") | F.col("ocr_low") | few | (field_score(F.col("text")) < 2))
