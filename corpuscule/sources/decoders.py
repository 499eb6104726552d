"""Decoders: the bytes of a file in, typed blocks out.

Each decoder is a plain function of one file; ``decoded`` runs whichever fits as an Arrow UDF, so that
a DataFrame of files becomes one of documents without leaving the plan. What a decoder can't read
becomes an error row, never a failed task.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from typing import Any, NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DecodeError
from ..functions.arrow import sliced
from ..functions.text import normalized, split_paragraphs

BLOCK = "struct<index:int,type:string,text:string,markdown:string,html:string,level:int,page:int,line_start:int,line_end:int,confidence:double,metadata:map<string,string>>"
ERROR = "struct<code:string,message:string,severity:string>"
DECODED = f"struct<title:string,blocks:array<{BLOCK}>,errors:array<{ERROR}>,metadata:map<string,string>>"

_MAP = pa.map_(pa.string(), pa.string())
_BLOCK = pa.struct(
    [("index", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("markdown", pa.string()), ("html", pa.string()), ("level", pa.int32()), ("page", pa.int32()),
     ("line_start", pa.int32()), ("line_end", pa.int32()), ("confidence", pa.float64()), ("metadata", _MAP)]
)
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string()), ("severity", pa.string())])
_DECODED = pa.struct([("title", pa.string()), ("blocks", pa.list_(_BLOCK)), ("errors", pa.list_(_ERROR)), ("metadata", _MAP)])

ROWS_A_TABLE = 25
OBJECTS_A_BLOCK = 20


class Result:
    """What a decoder found in one file."""

    def __init__(self, title: str):
        self.title, self.blocks, self.errors, self.metadata = title, [], [], {}

    def add(self, kind: str, text: str, *, markdown=None, html=None, level=None, page=None, lines=(None, None), confidence=1.0, metadata=None) -> None:
        self.blocks.append(
            dict(index=len(self.blocks), type=kind, text=text, markdown=markdown, html=html, level=level, page=page, line_start=lines[0], line_end=lines[1], confidence=confidence, metadata=list((metadata or {}).items()))
        )

    def fail(self, code: str, message: str, severity: str = "warning") -> None:
        self.errors.append(dict(code=code, message=message, severity=severity))

    def row(self) -> dict[str, Any]:
        return dict(title=self.title, blocks=self.blocks, errors=self.errors, metadata=[(k, str(v)) for k, v in self.metadata.items()])


def stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def read_text(content: bytes) -> tuple[str, str]:
    """UTF-8 where the bytes are, Latin-1 else; a byte-order mark stays."""
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("latin-1"), "latin-1"


def decode_text(content: bytes, path: str) -> Result:
    out, line = Result(stem(path)), 1
    raw, out.metadata["encoding"] = read_text(content)
    for part in split_paragraphs(raw):
        n = part.count("\n") + 1
        out.add("paragraph", part, lines=(line, line + n - 1))
        line += n + 1
    if not out.blocks:
        out.fail("empty_text", "The file has no text.")
    return out


_ATX = re.compile(r"(#{1,6})\s+(.+?)\s*$")
_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*+])\s+(.+?)\s*$")
_FENCED = re.compile(r"\s*```")


def decode_markdown(content: bytes, path: str) -> Result:
    out = Result(stem(path))
    raw, out.metadata["encoding"] = read_text(content)
    lines = raw.splitlines()
    held: list[str] = []
    first, fence, title = 1, 0, None

    def paragraph(last: int) -> None:
        text = normalized("\n".join(held))
        if text:
            out.add("paragraph", text, markdown=text, lines=(first, last))
        held.clear()

    def code(last: int, sure: float) -> None:
        text = "\n".join(lines[fence - 1 : last]).strip("\n")
        out.add("code", text, markdown=text, lines=(fence, last), confidence=sure)

    for n, line in enumerate(lines, 1):
        if _FENCED.match(line):
            if fence:
                code(n, 1.0)
                fence = 0
            else:
                paragraph(n - 1)
                fence = n
        elif fence:
            pass
        elif m := _ATX.match(line):
            paragraph(n - 1)
            text, level = normalized(m[2]), len(m[1])
            title = text if title is None and level == 1 else title
            out.add("heading", text, markdown=line.strip(), level=level, lines=(n, n))
        elif m := _ITEM.match(line):
            paragraph(n - 1)
            out.add("list_item", normalized(m[1]), markdown=line.strip(), lines=(n, n))
        elif not line.strip():
            paragraph(n - 1)
            first = n + 1
        else:
            first = first if held else n
            held.append(line)
    if fence:
        code(len(lines), 0.8)
    paragraph(len(lines))
    out.title = title or out.title
    if not out.blocks:
        out.fail("empty_markdown", "The file has no Markdown blocks.")
    return out


_EMPTY_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "noscript"}
_BLOCK_TAGS = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "li": "list_item", "pre": "code", "code": "code", "blockquote": "quote", "table": "table"}


class _Tree(HTMLParser):
    """Nodes nested as the tags say, nothing closed that isn't closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open, self.order = [self.root], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        self.order.append(node)
        if tag not in _EMPTY_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY_TAGS:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        children = self.open[-1][2]
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def _walk(node: list):
    """The node and what is in it, in document order, without unseen elements."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if not isinstance(x, str):
            stack.extend(c for c in reversed(x[2]) if isinstance(c, str) or c[0] not in _UNSEEN)


def _outer(node: list | str) -> str:
    """The node's markup; iterative, so that depth doesn't matter."""
    out, stack = [], [node]
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(escape(x))
        else:
            attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in x[1].items())
            if x[0] in _EMPTY_TAGS:
                out.append(f"<{x[0]}{attrs}/>")
            elif x[0] not in _UNSEEN:
                out.append(f"<{x[0]}{attrs}>")
                stack.append((f"</{x[0]}>",))
                stack.extend(reversed(x[2]))
    return "".join(out)


def _text(node: list) -> str:
    return normalized(" ".join(s for s in (x.strip() for x in _walk(node) if isinstance(x, str)) if s))


def decode_html(content: bytes, path: str) -> Result:
    out = Result(stem(path))
    raw, out.metadata["encoding"] = read_text(content)
    tree = _Tree()
    tree.feed(raw)
    tree.close()
    seen = [x for x in _walk(tree.root) if not isinstance(x, str)]
    title = next((x for x in seen if x[0] == "title"), None)
    if title is not None:
        out.title = normalized(" ".join(x for x in _walk(title) if isinstance(x, str)))
    for node in seen:
        kind = _BLOCK_TAGS.get(node[0])
        text = _text(node) if kind else ""
        if text:
            links = [x[1]["href"] for x in _walk(node) if not isinstance(x, str) and x[0] == "a" and x[1].get("href") and x is not node]
            out.add(kind, text, html=_outer(node), level=int(node[0][1]) if kind == "heading" else None, metadata={"links": json.dumps(links, ensure_ascii=False)} if links else None)
    if not out.blocks:
        text = normalized(" ".join(x for x in _walk(tree.root) if isinstance(x, str)))
        if text:
            out.add("paragraph", text, html=raw, confidence=0.7)
        else:
            out.fail("empty_html", "The page has no visible text.")
    return out


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    """A Markdown table; short rows are filled up to the widest."""
    width = max(map(len, [header, *rows]))
    line = lambda row: "| " + " | ".join([*row, *[""] * (width - len(row))]) + " |"
    return "\n".join([line(header), line(["---"] * width), *map(line, rows)])


def decode_csv(content: bytes, path: str) -> Result:
    out, rows = Result(stem(path)), []
    try:
        text = content.decode("utf-8-sig")
        dialect = csv.Sniffer().sniff(text[:4096]) if text[:4096].strip() else csv.excel
        rows = list(csv.reader(io.StringIO(text, newline=""), dialect))
    except Exception as e:
        out.fail("csv_decode_failed", f"The table can't be read: {e}", "error")
    width = max(map(len, rows), default=0)
    out.metadata |= {"row_count": len(rows), "column_count": width}
    if rows:
        out.add("metadata", f"CSV table with {len(rows)} rows and {width} columns.")
        for a in range(1, len(rows), ROWS_A_TABLE):
            group = rows[a : a + ROWS_A_TABLE]
            table = markdown_table(rows[0], group)
            out.add("table", normalized(table), markdown=table, lines=(a + 1, a + len(group)))
    else:
        out.fail("csv_empty", "The table has no rows.")
    return out


def decode_json(content: bytes, path: str) -> Result:
    out, value = Result(stem(path)), None
    pretty = lambda v: json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False)
    try:
        value = json.loads(content.decode("utf-8"))
    except Exception as e:
        out.fail("json_decode_failed", f"The file isn't JSON: {e}", "error")
    out.metadata["json_type"] = "invalid" if value is None else type(value).__name__
    if isinstance(value, list) and all(isinstance(x, dict) for x in value):
        out.add("metadata", f"JSON array with {len(value)} objects.")
        parts = [value[a : a + OBJECTS_A_BLOCK] for a in range(0, len(value), OBJECTS_A_BLOCK)]
    else:
        parts = [] if value is None else [value]
    for part in parts:
        out.add("code", normalized(pretty(part)), markdown=f"```json\n{pretty(part)}\n```")
    if isinstance(value, dict):
        out.title = next((value[k].strip() for k in ("title", "name", "id") if isinstance(value.get(k), str) and value[k].strip()), out.title)
    if not out.blocks:
        out.fail("json_empty", "The file has no JSON value.")
    return out


_PDF_STRING = re.compile(rb"\(([^()]{3,})\)")


def decode_pdf(content: bytes, path: str) -> Result:
    out = Result(stem(path))
    try:
        from pypdf import PdfReader  # optional

        for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
            try:
                for part in split_paragraphs(page.extract_text() or ""):
                    out.add("paragraph", part, page=n, confidence=0.85)
            except Exception as e:
                out.fail("pdf_page_extract_failed", f"Page {n}: {e}")
    except Exception as e:
        out.fail("pdf_decode_failed", f"The file can't be read as PDF: {e}")
    if not out.blocks:
        strings = [m.decode("latin-1") for m in _PDF_STRING.findall(content)]
        for part in split_paragraphs("\n".join(s for s in strings if any(c.isalpha() for c in s))):
            out.add("paragraph", part, confidence=0.35)
        if out.blocks:
            out.fail("pdf_fallback_text_extraction", "Only the file's plain strings were read.")
        else:
            out.fail("pdf_no_text_extracted", "The file has no text.")
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" for x in node.iter() if x.tag in (_W + "t", _W + "tab", _W + "br"))


def decode_docx(content: bytes, path: str) -> Result:
    out = Result(stem(path))
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(_W + "style"):
                name = style.find(_W + "name")
                names[style.get(_W + "styleId")] = (name.get(_W + "val") if name is not None else "") or ""
        for p in body.findall(_W + "p"):
            text = normalized(_docx_text(p))
            style = p.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(_W + "val", "") if style is not None else ""
            name = names.get(key, key).lower()
            if text and name.startswith("heading"):
                digits = re.search(r"\d+", name)
                level = min(6, max(1, int(digits[0]))) if digits else 1
                if level == 1 and out.title == stem(path):
                    out.title = text
                out.add("heading", text, level=level)
            elif text:
                out.add("paragraph", text)
        for table in body.findall(_W + "tbl"):
            rows = [[normalized("\n".join(map(_docx_text, cell.findall(_W + "p"))), False) for cell in row.findall(_W + "tc")] for row in table.findall(_W + "tr")]
            if rows and normalized(" ".join(c for r in rows for c in r)):
                markdown = markdown_table(rows[0], rows[1:])
                out.add("table", normalized(markdown), markdown=markdown, confidence=0.85)
    except Exception as e:
        out.blocks.clear()
        out.fail("docx_decode_failed", f"The file can't be read as DOCX: {e}")
        raw, encoding = read_text(content)
        for part in split_paragraphs(raw):
            out.add("paragraph", part, confidence=0.25)
        if out.blocks:
            out.fail("docx_text_fallback", f"Read as plain text ({encoding}).")
    if not out.blocks:
        out.fail("docx_empty", "The file has no text.")
    return out


class Decoder(NamedTuple):
    """A decoder and the files it is for."""

    name: str
    extensions: tuple[str, ...]
    media_types: tuple[str, ...]
    decode: Callable[[bytes, str], Result]


BUILT_IN: tuple[Decoder, ...] = (
    Decoder("markdown", (".md", ".markdown"), ("text/markdown", "text/x-markdown"), decode_markdown),
    Decoder("text", (".txt", ".text", ".log"), ("text/plain",), decode_text),
    Decoder("html", (".html", ".htm"), ("text/html", "application/xhtml+xml"), decode_html),
    Decoder("pdf", (".pdf",), ("application/pdf",), decode_pdf),
    Decoder("docx", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), decode_docx),
    Decoder("csv", (".csv",), ("text/csv", "application/csv"), decode_csv),
    Decoder("json", (".json",), ("application/json",), decode_json),
)


def decoder_name(extension: Column, media_type: Column, decoders: tuple[Decoder, ...] = BUILT_IN) -> Column:
    """The first decoder for this extension or media type; null where there is none."""
    picked = F.lit(None).cast("string")
    for d in reversed(decoders):
        picked = F.when(extension.isin(*d.extensions) | media_type.isin(*d.media_types), d.name).otherwise(picked)
    return picked


def decoded(content: Column, path: Column, name: Column, decoders: tuple[Decoder, ...] = BUILT_IN) -> Column:
    """Title, blocks, errors and metadata of a file, by the named decoder."""
    by = {d.name: d.decode for d in decoders}

    def run(contents: pa.Array, paths: pa.Array, names: pa.Array) -> pa.Array:
        rows: list[dict[str, Any] | None] = []
        for c, p, n in zip(contents.to_pylist(), paths.to_pylist(), names.to_pylist(), strict=True):
            if n not in by or c is None:
                rows.append(None)
                continue
            try:
                rows.append(by[n](c, p or "").row())
            except Exception as e:  # a broken file must not end the job
                failed = Result(stem(p or ""))
                failed.fail("decode_error" if isinstance(e, DecodeError) else "decoder_failed", f"{type(e).__name__}: {e}", "error")
                rows.append(failed.row())
        return pa.array(rows, _DECODED)

    return sliced(run, DECODED)(content, path, name)
