import io
import zipfile
from email.message import EmailMessage

from gleaner.operators import scan
from gleaner.sources import attachments, messages


def _mail() -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Cc"], m["Subject"] = "Ana River <Ana@x.org>", "Bo Lake <bo@x.org>, ana@x.org", "cy@x.org", " Notes "
    m.set_content("SSN: 123-45-6788 of the patient\n")
    m.add_attachment(b"name,mail\nBo Lake,bo@x.org\n", maintype="application", subtype="octet-stream", filename="list.csv")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in.txt", "inner words")
    m.add_attachment(z.getvalue(), maintype="application", subtype="zip", filename="box.zip")
    m.add_attachment(b"%PDF-", maintype="application", subtype="pdf", filename="a.pdf")
    return m.as_bytes()


def _html() -> bytes:
    m = EmailMessage()
    m["Subject"] = "Page"
    m.set_content("<p>one</p><script>x</script><p>two &amp; three</p>", subtype="html")
    return m.as_bytes()


def test_messages(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(_mail())
    (tmp_path / "b.eml").write_bytes(_html())
    (tmp_path / "c.eml").write_bytes(b"\xff\x00")
    (tmp_path / "d.txt").write_bytes(b"no message")
    got = messages.read(spark, str(tmp_path))
    rows = {r["file"]: r for r in got.collect()}
    assert set(rows) == {"a.eml", "b.eml", "c.eml"} and not any(r["error"] for r in rows.values())
    a = rows["a.eml"]
    assert a["sender"]["email"] == "Ana@x.org" and a["sender"]["name"] == "Ana River" and a["subject"] == "Notes" and a["cc"] == ["cy@x.org"]
    texts = {r["source_ref"]: r for r in messages.sources(got).collect()}
    assert texts["a.eml (email subject)"]["text"] == "Subject: Notes"
    assert texts["a.eml > list.csv"]["text"] == "Attachment filename: list.csv\n[Sheet: Text]\nname\tmail\nname: Bo Lake\tmail: bo@x.org" and texts["a.eml > list.csv"]["structured"]
    assert texts["a.eml > box.zip"]["text"].endswith("[ZIP member: in.txt]\ninner words")
    assert texts["a.eml > a.pdf"]["warnings"] == ["no_reader_for:pdf_page_images"]
    assert texts["b.eml (email body)"]["text"].split() == ["one", "two", "&", "three"]
    people = {(r["file"], r["email"]): (r["name"], r["role"]) for r in messages.participants(got).collect()}
    assert people == {("a.eml", "ana@x.org"): ("Ana River", "sender"), ("a.eml", "bo@x.org"): ("Bo Lake", "recipient"), ("a.eml", "cy@x.org"): (None, "cc")}
    assert [r["normalized_value"] for r in scan.scan(messages.sources(got), types=["SSN"]).collect()] == ["123456788"]


def test_attachments_never_raise():
    for name, mime in (("a.docx", ""), ("a.xlsx", ""), ("a.zip", "application/zip"), ("a.eml", ""), ("a.rtf", ""), ("a.bin", "")):
        got = attachments.extract(name, mime, b"\x00\xffnot what it says")
        assert isinstance(got["text"], str)


def test_tables():
    assert attachments.table_lines("S", [["field", "value", "note"], ["full_name", "Bo Lake", ""], ["id", "7", "old"]]) == ["[Sheet: S]", "full name: Bo Lake", "id: 7\tnote: old"]
    assert attachments.table_lines("S", [["1", "2"], ["3", ""]]) == ["[Sheet: S]", "1\t2", "3"]
    assert attachments.delimited("a|b\n1|2") == [["a", "b"], ["1", "2"]] and attachments.delimited("a,b\n1") is None
    assert attachments.extract("x.rtf", "", rb"{\rtf1{\fonttbl{\f0 A;}}\b Hi\b0\par caf\'e9}")["text"] == "Hi\ncafé"


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for d in ("x", "y/z"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "a.eml").write_bytes(_mail())
    refs = {r["source_ref"] for r in messages.sources(messages.read(spark, str(tmp_path))).collect()}
    assert {"x/a.eml (email body)", "y/z/a.eml (email body)"} <= refs


def test_nested_pages_are_text():
    got = attachments.extract("in.eml", "message/rfc822", _html())
    assert got["text"].split() == ["one", "two", "&", "three"]


def test_kinds_of_files():
    assert attachments.kind_of("a", "", b"%PDF-1") == "application/pdf" and attachments.kind_of("a.txt", "application/octet-stream") == "text/plain"
    assert attachments.kind_of("a.msg", "", b"\xd0\xcf\x11\xe0") == attachments.BY_EXTENSION[".msg"] and attachments.kind_of("a.docx", "", b"PK\x03\x04") == attachments.BY_EXTENSION[".docx"]


def test_pdf_text():
    import zlib

    page = b"BT /F1 12 Tf 72 700 Td (Full Name: Bo \\(B\\) Lake and some more words) Tj 0 -14 Td [(SSN) -300 (123-45-6788)] TJ ET"
    squeezed = zlib.compress(page)
    pdf = b"%PDF-1.4 1 0 obj << /Type /Page >> endobj 2 0 obj << /Filter /FlateDecode /Length 9 >> stream\n" + squeezed + b"\nendstream endobj"
    got = attachments.extract("a.pdf", "application/pdf", pdf)
    assert got["text"] == "[PDF Page 1]\nFull Name: Bo (B) Lake and some more words\nSSN 123-45-6788" and got["warnings"] == []


def _compound(streams):
    """A compound file of small streams, for the reader to take apart."""
    import struct

    names = list(streams)
    mini, starts, at = b"", [], 0
    table = []
    for n in names:
        blocks = max(1, -(-len(streams[n]) // 64))
        mini += streams[n].ljust(64 * blocks, b"\0")
        starts.append(at)
        table += [*range(at + 1, at + blocks), 0xFFFFFFFE]
        at += blocks
    entries = [("Root Entry", 5, 0xFFFFFFFF, 0xFFFFFFFF, 1, 3, len(mini))] + [(n, 2, 0xFFFFFFFF, i + 2 if i + 1 < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, starts[i], len(streams[n])) for i, n in enumerate(names)]
    raw = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(n) + 2, k, 1, a, b, c) + b"\0" * 36 + struct.pack("<IQ", s, z) for n, k, a, b, c, s, z in entries)
    raw = raw.ljust(512, b"\0")[:512]
    store = mini.ljust(-(-len(mini) // 512) * 512, b"\0")
    n_store = len(store) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *range(4, 3 + n_store), 0xFFFFFFFE]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)

    def words(xs):
        return struct.pack("<128I", *(xs + [0xFFFFFFFF] * (128 - len(xs))))

    return head + words(fat) + raw + words(table) + store


def test_outlook_messages():
    data = _compound({"__substg1.0_0037001F": "Hi there".encode("utf-16-le"), "__substg1.0_1000001F": ("Body of words " * 9).encode("utf-16-le"), "other": b"x"})
    got = attachments.extract("a.msg", "", data)
    assert got["text"] == "Subject: Hi there\n" + "Body of words " * 9 and got["warnings"] == []
