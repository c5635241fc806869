"""Text of PDFs: content streams with text operators, read with the fonts of their page. No encryption, no layout.

A content stream is read as lexical elements; strings are operands, and a table says what an operator does to the page.
Files whose objects make no page tree are read stream by stream.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.sources import pdf_objects

# Bounds of the format's reader.
MOST_INFLATED = 64 << 20
LEAST_TEXT = 16
#: Files that are read before their texts go on.
TOGETHER = 64

# How the format marks streams, elements of a content stream, pieces of a string and escapes.
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
ELEMENT = re.compile(r"(?P<string>\()|<(?P<hex>[^<>]*)>|/(?P<name>[^\s()<>\[\]{}/%]+)|(?P<operator>[A-Za-z'\"*][A-Za-z'\"*0]*)")
PIECE = re.compile(r"\\(?P<octal>[0-9]{1,3})|\\(?P<escaped>.)|(?P<bracket>[()])|(?P<plain>[^()\\]+)", re.S)
CONTROLS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": ""}


class Page:
    """What a content stream shows: rows of text, the last of which is being written, and the operands that wait."""

    def __init__(self, fonts: dict | None = None) -> None:
        self.rows, self.operands, self.fonts = [""], [], fonts or {}
        self.name, self.decode = "", None

    def take(self, value: str) -> None:
        self.operands.append(self.decode(value.encode("latin-1", "replace")) if self.decode else value)

    def choose_font(self) -> None:
        self.decode = self.fonts.get(self.name)

    def show(self) -> None:
        self.rows[-1] += "".join(self.operands)
        self.operands.clear()

    def move(self) -> None:
        self.show()
        self.rows.append("")

    def move_and_show(self) -> None:
        self.rows.append("")
        self.show()

    def text(self) -> str:
        self.show()
        return re.sub(r"\n{3,}", "\n\n", "\n".join(r.rstrip() for r in self.rows)).strip()


OPERATORS = {"Tj": Page.show, "TJ": Page.show, "'": Page.move_and_show, '"': Page.move_and_show, "Td": Page.move, "TD": Page.move, "T*": Page.move, "ET": Page.move, "Tf": Page.choose_font}


def literal(s: str, at: int) -> tuple[str, int]:
    """The string that begins at `at`, behind its opening bracket, and the place behind its closing one."""
    out, depth = [], 1
    for m in PIECE.finditer(s, at):
        if m["bracket"]:
            depth += 1 if m["bracket"] == "(" else -1
            if not depth:
                return "".join(out), m.end()
            out.append(m["bracket"])
        elif m["octal"]:
            out.append(chr(int(m["octal"], 8)) if not re.search("[89]", m["octal"]) else "")
        else:
            out.append(m["plain"] or CONTROLS.get(m["escaped"], m["escaped"]))
    return "".join(out), len(s)


def from_hex(digits: str) -> str:
    """The bytes of a hex string, a missing last digit as 0; nothing if it isn't one."""
    digits = re.sub(r"\s", "", digits)
    return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("latin-1") if re.fullmatch("[0-9A-Fa-f]*", digits) else ""


def stream_text(data: bytes, fonts: dict | None = None, shown: dict[str, str] | None = None) -> str:
    """The text that a content stream shows, a line for each move of the text position. fonts: decoders by name; shown: texts of forms by name."""
    page, s, at = Page(fonts), data.decode("latin-1"), 0
    while (b"T" in data or shown) and (m := ELEMENT.search(s, at)):
        at = m.end()
        if m["string"]:
            value, at = literal(s, at)
            page.take(value)
        elif m["hex"] is not None:
            page.take(from_hex(m["hex"]))
        elif m["name"]:
            page.name = m["name"]
        elif m["operator"] == "Do" and shown and shown.get(page.name):
            page.show()
            page.rows += [shown[page.name], ""]
        elif m["operator"] in OPERATORS:
            OPERATORS[m["operator"]](page)
    return page.text()


def inflate(data: bytes) -> bytes:
    """The data inflated, MOST_INFLATED bytes at most; as it is if it isn't deflated."""
    try:
        return zlib.decompressobj().decompress(data, MOST_INFLATED)
    except zlib.error:
        return data


def _shown(file: pdf_objects.File, content: bytes, resources: dict, depth: int = 0) -> str:
    inner = pdf_objects.forms(file, resources) if depth < pdf_objects.DEEPEST and re.search(rb"\bDo\b", content) else {}
    texts = {name: _shown(file, c, r, depth + 1) for name, (c, r) in inner.items() if r is not resources or c != content}
    return stream_text(content, pdf_objects.font_decoders(file, resources), texts)


def pdf_text(data: bytes) -> str:
    """The text of the pages in order; without pages of all content streams that show any. Nothing of encrypted files."""
    if re.search(rb"/Encrypt\b", data):
        return ""
    file = pdf_objects.File(data)
    pages = [t for content, resources in file.pages() if (t := _shown(file, content, resources))]
    if pages:
        return "\n".join(pages).strip()
    streams = (inflate(m[1]) for m in STREAM.finditer(data))
    return "\n".join(t for x in streams if re.search(rb"T[jJ]", x) and (t := stream_text(x))).strip()


def read_pdf(files: DataFrame) -> DataFrame:
    """file_id, name, text of PDFs (file_id, name, content); those with less than LEAST_TEXT characters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = []
                for file_id, name, content in zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns), strict=True):
                    text = pdf_text(content or b"")
                    if len(text) >= LEAST_TEXT:
                        rows.append((file_id, name, text))
                ids, names, texts = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file_id", "name", "text"])

    return files.select("file_id", "name", "content").mapInArrow(run, "file_id long, name string, text string")


def simple_pdf(lines: list[str], deflate: bool = False) -> bytes:
    """A one-page PDF that shows these lines; for tests and round trips."""
    escape = lambda x: re.sub(r"([()\\])", r"\\\1", x)
    shown = "".join(f"({escape(x)}) Tj T* " for x in lines)
    stream = f"BT /F1 10 Tf 40 780 Td {shown}ET".encode("latin-1", "replace")
    stream = zlib.compress(stream) if deflate else stream
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(stream)).encode() + b" >>\nstream\n" + stream + b"\nendstream\nendobj\n%%EOF\n"


def font_pdf(lines: list[str], shift: int = 3) -> bytes:
    """A PDF whose objects lie in a compressed object stream and whose font has numbers for letters; for tests and round trips.

    Lines of the basic plane. A code is the letter's number plus `shift`; the font's map says so, in ranges of 256 and one by one.
    """
    lines = [re.sub("[^\\x00-\ud7ff]", "", x) for x in lines]
    letters = sorted(map(ord, set().union(*lines)))
    code = lambda n: f"<{n + shift:04X}>"
    codes = {chr(n): f"{n + shift:04X}" for n in letters}
    blocks = sorted({n >> 8 for n in letters if n & 255 < 256 - shift})
    ranges = "".join(f"{code(b << 8)} {code((b << 8) + 255 - shift)} <{b << 8:04X}>\n" for b in blocks)
    single = "".join(f"{code(n)} <{n:04X}>\n" for n in letters if n & 255 >= 256 - shift)
    cmap = f"1 begincodespacerange <0000> <FFFF> endcodespacerange\n{len(blocks)} beginbfrange\n{ranges}endbfrange\n1 beginbfchar\n{single}endbfchar".encode()
    shown = "".join(f"<{''.join([codes[c] for c in x])}> Tj T*\n" for x in lines)
    content = f"BT /F1 10 Tf 40 780 Td\n{shown}ET".encode()
    packed = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: "<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: "<</Type/Page/Parent 2 0 R/Contents 7 0 R/Resources 4 0 R>>", 4: "<</Font<</F1 5 0 R>>>>", 5: "<</Type/Font/Subtype/Type0/ToUnicode 6 0 R>>"}
    bodies, head, at = "\n".join(packed.values()), [], 0
    for number, body in packed.items():
        head.append(f"{number} {at}")
        at += len(body) + 1
    first = " ".join(head) + " "
    out = b"%PDF-1.5\n"
    for number, info, body in ((8, f"/Type/ObjStm/N {len(packed)}/First {len(first)}", (first + bodies).encode()), (6, "", cmap), (7, "", content)):
        z = zlib.compress(body)
        out += f"{number} 0 obj\n<<{info}/Filter/FlateDecode/Length {len(z)}>>\nstream\n".encode() + z + b"\nendstream\nendobj\n"
    return out + b"%%EOF\n"
