"""Mail archives as tables: one row a message, its attachments, and the texts ("sources") that findings refer to.

Files are read by Spark's binary reader, so any store it knows will do, and parsed in Arrow batches by the standard
library. A file that cannot be parsed is a row with `error` set and no sources.
"""

from __future__ import annotations

import email
import email.header
import email.policy
import html
import re
from email.utils import getaddresses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import attachments

PERSON = "struct<email:string,name:string>"
MESSAGE = f"file string, sender {PERSON}, recipients array<{PERSON}>, cc array<string>, bcc array<string>, subject string, body string, is_html boolean, attachments array<{attachments.RESULT}>, error string"


def people(header) -> list[dict]:
    """Mailboxes of an address header; entries without an address are left out."""
    return [{"email": a.strip(), "name": n.strip() or None} for n, a in getaddresses([str(header)]) if a] if header else []


def parts_of(part) -> tuple[list[str], list[str], list]:
    """Plain texts, HTML texts and files of a message, in one walk: what is an attachment gives no text, nor does what is inside it."""
    plain, pages, files = [], [], []

    def visit(p, hidden: bool) -> None:
        placed = p.get("Content-Disposition")
        hidden = hidden or "attachment" in (placed or "").lower()
        kind = p.get_content_type()
        if placed is not None and p.get_content_maintype() != "multipart":
            files.append(p)
        if p.is_multipart():
            for inner in p.iter_parts() if kind != "message/rfc822" else p.get_payload():
                visit(inner, hidden)
        elif not hidden and kind in ("text/plain", "text/html"):
            text = _decoded(p)
            if text:
                (plain if kind == "text/plain" else pages).append(text)

    visit(part, False)
    return plain, pages, files


def _decoded(part) -> str:
    try:
        return (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", errors="ignore")
    except LookupError:  # a charset that Python does not know
        return ""


def body_of(msg) -> tuple[str, bool]:
    """Plain parts joined by newlines; HTML parts only where there are none. Says whether it is HTML."""
    plain, pages, _ = parts_of(msg)
    return ("\n".join(plain), False) if plain else ("\n".join(pages), True)


def page_text(page: str) -> str:
    """functions.text.html_text() of one page, for pages within files."""
    for shape, to in T.HTML_STEPS:
        page = re.sub(shape, to, page)
    page = html.unescape(page)
    for shape, to in T.HTML_SPACE:
        page = re.sub(shape, to, page)
    return page.strip(T.BLANKS)


def _name(part) -> str | None:
    name = part.get_filename()
    if not name:
        return None
    first, charset = email.header.decode_header(name)[0]
    return first.decode(charset or "utf-8", errors="ignore") if isinstance(first, bytes) else first


def files_of(msg) -> list[tuple[str, str, bytes]]:
    """Name, MIME type and bytes of every part that has a disposition and a file name and is not empty."""
    out = []
    for part in parts_of(msg)[2]:
        inner = part.get_payload() if part.get_content_type() == "message/rfc822" else None
        data = inner[0].as_bytes() if isinstance(inner, list) and inner else part.get_payload(decode=True)
        name = _name(part) if data else None
        if name:
            out.append((name, part.get_content_type(), data))
    return out


def parsed(file: str, raw: bytes) -> dict:
    """A message's row."""
    row = {"file": file, "sender": None, "recipients": [], "cc": [], "bcc": [], "subject": "", "body": "", "is_html": False, "attachments": [], "error": None}
    try:
        msg = email.message_from_bytes(raw, policy=email.policy.default)
        first = people(msg.get("From"))[:1]
        body, is_html = body_of(msg)
        row |= {
            "sender": first[0] if first else None, "recipients": people(msg.get("To")), "cc": [p["email"] for p in people(msg.get("CC"))], "bcc": [p["email"] for p in people(msg.get("BCC"))],
            "subject": str(msg.get("Subject", "")).strip(), "body": body, "is_html": is_html, "attachments": [attachments.extract(n, m, d) for n, m, d in files_of(msg)],
        }
    except Exception as e:  # any broken file must not end the job
        row["error"] = str(e)[:200] or type(e).__name__
    return row


def parse(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """MESSAGE rows of (file, content) rows, and the columns to keep. HTML bodies are turned into text by Columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(MESSAGE))
    kept = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, (name, raw) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):  # a message at a time bounds memory
                row = pa.RecordBatch.from_pylist([parsed(name.as_py(), raw.as_py() or b"")], schema=schema)
                yield pa.RecordBatch.from_arrays([*row.columns, *[c.slice(i, 1) for c in batch.columns[2:]]], names=[*schema.names, *batch.schema.names[2:]])

    rows = files.select("file", "content", *keep).mapInArrow(run, MESSAGE + kept)
    return rows.withColumn("body", F.when(F.col("is_html"), T.html_text(F.col("body"))).otherwise(F.col("body"))).drop("is_html")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All .eml files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)
    return parse(files.select(below(F.col("path"), path).alias("file"), "content"))


def below(path: Column, root: str) -> Column:
    """A file's path below the folder that was read, so that equal names in two folders stay apart; its name where the folder is a pattern."""
    base = re.escape(root.split("://")[-1].removeprefix("file:").rstrip("/"))
    inside = F.regexp_extract(path, f"{base}/(.+)$", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_extract(path, "[^/]*$", 0))


def sources(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """file, the columns to keep, source_ref, text, method, structured, warnings: the subject, the body and each attachment, blank ones left out."""
    none = F.array().cast("array<string>")

    def one(ref, text, method, structured, warnings):
        return F.struct(ref.alias("source_ref"), text.alias("text"), method.alias("method"), structured.alias("structured"), warnings.alias("warnings"))

    def plain(what, text):
        return one(F.concat("file", F.lit(f" (email {what})")), text, F.lit("plain_text"), F.lit(False), none)

    own = F.array(plain("subject", F.when(F.col("subject") != "", F.concat(F.lit("Subject: "), F.col("subject")))), plain("body", F.col("body")))
    named = F.transform("attachments", lambda a: one(F.concat(F.col("file"), F.lit(" > "), a["name"]), F.concat(F.lit("Attachment filename: "), a["name"], F.lit("\n"), a["text"]), a["method"], a["structured"], a["warnings"]))
    rows = messages.filter("error IS NULL").select("file", *keep, F.explode(F.concat(own, named)).alias("s"))
    return rows.select("file", *keep, "s.*").filter("trim(text) <> ''")


def participants(messages: DataFrame) -> DataFrame:
    """file, email (lower case), name, role of each mailbox in the headers; the first role of an address stays."""

    def role(people_of, name):
        return F.transform(people_of, lambda p: F.struct(F.lower(F.trim(p["email"])).alias("email"), F.nullif(F.trim(p["name"]), F.lit("")).alias("name"), F.lit(name).alias("role")))

    def bare(c):
        return F.transform(F.col(c), lambda e: F.struct(e.alias("email"), F.lit(None).cast("string").alias("name")))

    sender = F.when(F.col("sender").isNotNull(), F.array("sender")).otherwise(F.array().cast(f"array<{PERSON}>"))
    all_of = F.concat(role(sender, "sender"), role(F.col("recipients"), "recipient"), role(bare("cc"), "cc"), role(bare("bcc"), "bcc"))
    ranked = messages.select("file", F.posexplode(all_of).alias("n", "p")).filter("p.email <> ''")
    return ranked.groupBy("file", F.col("p.email").alias("email")).agg(F.min_by("p", "n").alias("p"), F.min("n").alias("n")).select("file", "n", "email", "p.name", "p.role")
