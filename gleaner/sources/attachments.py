"""Text of attachments by kind of file: plain and delimited text, Word, Excel, RTF, archives, nested messages.

What needs a program that is not at hand (images, old Word and Excel files, RAR) gives a warning and no text. Of PDF
files the text that is written as text is read, page by page; pages that are pictures give a warning. Nothing here
raises: a broken file gives a warning. Archives are opened to a depth of 3 and members up to 50 MB.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import os
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

RESULT = "struct<name:string,mime:string,n_bytes:long,text:string,method:string,structured:boolean,tables:int,warnings:array<string>>"
MOST_BYTES, MOST_DEPTH = 50 << 20, 3

# MIME types by extension, and types that say nothing about what a file is.
BY_EXTENSION = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xls": "application/vnd.ms-excel", ".csv": "text/csv", ".txt": "text/plain",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".tiff": "image/tiff", ".zip": "application/zip",
    ".msg": "application/vnd.ms-outlook", ".eml": "message/rfc822", ".rtf": "text/rtf",
}
VAGUE = {"", "application/octet-stream", "application/zip", "application/x-zip-compressed"}
# What files begin with.
MAGIC = [(b"%PDF", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"{\\rtf", "text/rtf"), (b"\xd0\xcf\x11\xe0", "application/x-ole-storage")]
KEY_HEADERS, VALUE_HEADERS = {"field", "label", "attribute", "item", "key", "name"}, {"value", "data", "detail", "entry", "content"}


def kind_of(name: str, mime: str, data: bytes = b"") -> str:
    """The MIME type to go by: the declared one; that of the bytes where none is declared; that of the extension where either is vague."""
    declared, by_name = (mime or "").lower(), BY_EXTENSION.get(os.path.splitext(name or "")[1].lower())
    declared = declared or next((kind for head, kind in MAGIC if data.startswith(head)), "")
    vague = declared in VAGUE or declared == "application/x-ole-storage"
    return by_name if vague and by_name and by_name != "application/zip" else declared or by_name or "application/octet-stream"


def _is_header(cells: list[str]) -> bool:
    named = [c for c in cells if c]
    with_digits = sum(bool(re.search(r"\d", c)) for c in named)
    return len(named) >= 2 and len({c.lower() for c in named}) == len(named) and all(re.search("[A-Za-z]", c) for c in named) and with_digits <= max(1, len(named) // 3)


def table_lines(title: str, rows: list[list[str]]) -> list[str]:
    """A table as lines: a marker, then `header: cell` pairs, `label: value` for key-value sheets, or bare cells."""
    rows = [[str(c).strip() for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    marker = [f"[Sheet: {title}]"]
    if not rows:
        return marker
    head = [c.replace("_", " ") for c in rows[0]]
    if not _is_header(head):
        return marker + ["\t".join(c for c in r if c) for r in rows]

    def pairs(row, first=0):
        return [f"{head[i]}: {c}" if i < len(head) and head[i] else c for i, c in enumerate(row) if i >= first and c]

    if head[0].lower() in KEY_HEADERS and head[1].lower() in VALUE_HEADERS:
        lines = []
        for r in rows[1:]:
            label, value = r[0].replace("_", " "), r[1] if len(r) > 1 else ""
            if label or value:
                lines.append("\t".join([f"{label}: {value}" if value else label, *pairs(r, 2)]))
        return marker + lines
    return marker + ["\t".join(head)] + [x for x in ("\t".join(pairs(r)) for r in rows[1:]) if x]


def delimited(text: str) -> list[list[str]] | None:
    """Rows of a rectangular table of two columns and rows or more; None where the text is none."""
    for mark in ",\t|":
        try:
            rows = [r for r in csv.reader(io.StringIO(text), delimiter=mark) if any(c.strip() for c in r)]
        except csv.Error:
            continue
        if len(rows) >= 2 and len(rows[0]) >= 2 and {len(r) for r in rows} == {len(rows[0])}:
            return rows
    return None


def _plain(data: bytes, depth: int) -> dict:
    text = data.decode("utf-8", errors="ignore")
    rows = delimited(text)
    return {"text": "\n".join(table_lines("Text", rows)), "method": "structured_text", "structured": True, "tables": 1} if rows else {"text": text, "method": "plain_text"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _inside(node, name: str):
    return [x for x in node.iter() if _local(x.tag) == name]


def _words(node) -> str:
    return "".join(x.text or "" for x in _inside(node, "t"))


def _docx(data: bytes, depth: int) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _inside(ElementTree.fromstring(z.read("word/document.xml")), "body")[0]
    lines = [t for t in (_words(p) for p in body if _local(p.tag) == "p") if t.strip()]
    tables = [x for x in body if _local(x.tag) == "tbl"]
    for i, t in enumerate(tables, 1):
        lines += table_lines(f"Table {i}", [[_words(c) for c in _inside(r, "tc")] for r in _inside(t, "tr")])
    return {"text": "\n".join(lines), "method": "docx", "structured": bool(tables), "tables": len(tables)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref or "").group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _xlsx(data: bytes, depth: int) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_words(s) for s in _inside(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in _inside(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        lines = []
        for k, name in enumerate(sheets):
            rows = []
            for r in _inside(ElementTree.fromstring(z.read(name)), "row"):
                cells: dict[int, str] = {}
                for c in _inside(r, "c"):
                    v = next((x.text or "" for x in _inside(c, "v")), "")
                    v = shared[int(v)] if c.get("t") == "s" and v else _words(c) if c.get("t") == "inlineStr" else v
                    cells[_column(c.get("r")) if c.get("r") else len(cells)] = v
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            lines += table_lines(titles[k] if k < len(titles) else f"Sheet{k + 1}", rows)
    return {"text": "\n".join(lines), "method": "spreadsheet", "structured": True, "tables": len(sheets)}


def _rtf(data: bytes, depth: int) -> dict:
    text = data.decode("latin-1")
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "ignore"), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", re.sub(r"\\tab\b ?", "\t", text))
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    return {"text": re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).strip(), "method": "rtf"}


def _zip(data: bytes, depth: int) -> dict:
    if depth >= MOST_DEPTH:
        return {"text": "", "method": "zip", "warnings": ["archive_depth_exceeded"]}
    texts, warnings = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if m.is_dir():
                continue
            if m.file_size > MOST_BYTES:
                warnings.append("zip_member_exceeds_max_size")
                continue
            got = extract(m.filename, "", z.read(m), depth + 1)
            warnings += got["warnings"]
            if got["text"].strip():
                texts.append(f"[ZIP member: {m.filename}]\n{got['text']}")
    return {"text": "\n".join(texts), "method": "zip", "warnings": warnings}


def _message(data: bytes, depth: int) -> dict:
    from . import messages

    if depth >= MOST_DEPTH:
        return {"text": "", "method": "message", "warnings": ["message_depth_exceeded"]}
    msg = email.message_from_bytes(data, policy=email.policy.default)
    body, is_html = messages.body_of(msg)
    body = messages.page_text(body) if is_html else body
    inner = [extract(n, m, d, depth + 1) for n, m, d in messages.files_of(msg)]
    return {"text": "\n".join([body, *[x["text"] for x in inner if x["text"].strip()]]), "method": "message", "warnings": [w for x in inner for w in x["warnings"]]}


# ---- PDF


def _pdf_string(raw: bytes) -> str:
    """A string in parentheses or hexadecimal, as Latin letters or, with its mark, UTF-16."""
    if raw.startswith(b"<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        codes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else codes.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "ignore") if data.startswith(b"\xfe\xff") else data.decode("cp1252", "ignore")


_SHOWN = re.compile(rb"(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)|\b(T[dDmJj*]|ET|BT)|(-?\d+(?:\.\d+)?)|(['\"])", re.S)


def _page_lines(content: bytes) -> str:
    """What a page's drawing instructions show: a move to another line ends one, a wide gap within one is a blank."""
    out, held, numbers = [], [], []
    for m in _SHOWN.finditer(content):
        if m[1]:
            if numbers and held and float(numbers[-1]) < -200:
                held.append(" ")
            held.append(_pdf_string(m[1]))
            numbers = []
        elif m[3]:
            numbers.append(m[3])
        else:
            if m[2] in (b"Td", b"TD", b"Tm", b"T*", b"ET") or m[4]:
                flat = m[2] in (b"Td", b"TD") and len(numbers) >= 2 and float(numbers[-1]) == 0
                out.append(" " if flat else "\n")
            out += held
            held, numbers = [], []
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out + held).split("\n")) if x)


def _pdf(data: bytes, depth: int) -> dict:
    pages = []
    for m in re.finditer(rb"<<(.{0,2000}?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if b"FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw, MOST_BYTES)
            except zlib.error:
                continue
        if b"BT" in raw and b"ET" in raw:
            pages.append(_page_lines(raw))
    count = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data)) or len(pages)
    text = "\n".join(f"[PDF Page {i}]\n{p}" for i, p in enumerate(pages, 1) if p)
    return {"text": text, "method": "pdf", "warnings": [] if pages and len([p for p in pages if len(p) >= 40]) >= count else ["no_reader_for:pdf_page_images"]}


# ---- Outlook messages: streams in a compound file


def ole_streams(data: bytes) -> dict[str, bytes]:
    """Path and bytes of the streams of a compound file."""
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    size, small = 1 << shift, 1 << small_shift
    n_fat, first_dir, _, limit, first_mini = struct.unpack_from("<I", data, 44)[0], *struct.unpack_from("<I", data, 48), *struct.unpack_from("<I", data, 52), *struct.unpack_from("<I", data, 56), *struct.unpack_from("<I", data, 60)

    def sector(i: int) -> bytes:
        return data[(i + 1) * size : (i + 2) * size]

    fat_at = list(struct.unpack_from("<109I", data, 76))
    more = struct.unpack_from("<I", data, 68)[0]
    while more < 0xFFFFFFFA and len(fat_at) < n_fat + 200:
        block = struct.unpack(f"<{size // 4}I", sector(more))
        fat_at += block[:-1]
        more = block[-1]
    fat = [x for i in fat_at[:n_fat] if i < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(i))]

    def chain(i: int, table: list[int]) -> list[int]:
        out = []
        while i < len(table) and len(out) <= len(table):
            out.append(i)
            i = table[i]
        return out

    def whole(i: int) -> bytes:
        return b"".join(map(sector, chain(i, fat)))

    entries, raw = [], whole(first_dir)
    for at in range(0, len(raw) - 127, 128):
        n = struct.unpack_from("<H", raw, at + 64)[0]
        left, right, child = struct.unpack_from("<III", raw, at + 68)
        start, length = struct.unpack_from("<I", raw, at + 116)[0], struct.unpack_from("<I", raw, at + 120)[0]
        entries.append((raw[at : at + max(0, n - 2)].decode("utf-16-le", "ignore"), raw[at + 66], left, right, child, start, length))
    mini = [x for i in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(i))]
    store = whole(entries[0][5])
    out: dict[str, bytes] = {}
    todo = [(entries[0][4], "")]
    met = set()
    while todo:
        i, path = todo.pop()
        if i >= len(entries) or i in met:
            continue
        met.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            got = b"".join(store[j * small : (j + 1) * small] for j in chain(start, mini)) if length < limit else whole(start)
            out[path + name] = got[:length]
    return out


def _outlook(data: bytes, depth: int) -> dict:
    streams = ole_streams(data)

    def of(tag: str, path: str = "") -> str:
        wide, narrow = streams.get(f"{path}__substg1.0_{tag}001F"), streams.get(f"{path}__substg1.0_{tag}001E")
        return wide.decode("utf-16-le", "ignore") if wide else (narrow or b"").decode("cp1252", "ignore")

    subject, body = of("0037"), of("1000")
    texts, warnings = [f"Subject: {subject}" if subject else "", body], []
    for path in sorted({k.split("/")[0] + "/" for k in streams if k.startswith("__attach")}):
        content = streams.get(f"{path}__substg1.0_37010102")
        if content and depth < MOST_DEPTH:
            got = extract(of("3707", path) or of("3704", path), "", content, depth + 1)
            texts.append(got["text"])
            warnings += got["warnings"]
    return {"text": "\n".join(t for t in texts if t.strip()), "method": "outlook_msg", "warnings": warnings}


READERS = {
    BY_EXTENSION[".docx"]: _docx, "application/vnd.ms-word.document.macroenabled.12": _docx, BY_EXTENSION[".xlsx"]: _xlsx, "application/zip": _zip,
    "application/x-zip-compressed": _zip, "message/rfc822": _message, "text/rtf": _rtf, "application/rtf": _rtf, "application/pdf": _pdf, BY_EXTENSION[".msg"]: _outlook,
}


def extract(name: str, mime: str, data: bytes, depth: int = 0) -> dict:
    """A RESULT row of one file."""
    kind = kind_of(name, mime, data)
    row = {"name": name, "mime": kind, "n_bytes": len(data), "text": "", "method": "none", "structured": False, "tables": 0, "warnings": []}
    if len(data) > MOST_BYTES:
        return row | {"warnings": ["attachment_exceeds_max_size"]}
    if kind in (BY_EXTENSION[".doc"], BY_EXTENSION[".xls"], "application/vnd.rar", "application/x-rar-compressed") or kind.startswith("image/"):
        return row | {"warnings": [f"no_reader_for:{kind}"]}
    try:
        return row | READERS.get(kind, _plain)(data, depth)
    except Exception as e:  # a broken file is a warning
        return row | {"warnings": [f"extraction_failed:{type(e).__name__}:{e}"[:200]]}
