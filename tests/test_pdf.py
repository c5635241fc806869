"""PDFs as writers make them: page trees, indirect lengths, forms, filters, compressed objects, fonts; and damaged ones."""

import random
import zlib

import pytest

from strandline.sources import pdf, pdf_objects

LINES = ["Hello – wörld (x) \\ ÿĀ", "漢字 and 日本", "second line", "", "last"]
TREE = (
    b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages /Kids [4 0 R 3 0 R 2 0 R] /Resources <</Font <</F1 9 0 R>> /XObject <</X1 8 0 R>> >> >> endobj\n"
    b"3 0 obj <</Type/Page /Contents [5 0 R]>> endobj\n4 0 obj <</Type/Page /Contents 6 0 R>> endobj\n5 0 obj <</Length 7 0 R>> stream\nBT /F1 9 Tf (second \\226 page) Tj ET /X1 Do\nendstream endobj\n"
    b"6 0 obj <</Length 999>> stream\nBT (first) Tj [( pa) -20 (ge)] TJ ET\nendstream endobj\n7 0 obj 42 endobj\n8 0 obj <</Subtype /Form /Filter [/ASCIIHexDecode /FlateDecode] /Length 3>> stream\n"
    + zlib.compress(b"BT (in a form) Tj /X1 Do ET").hex().encode() + b">\nendstream endobj\n9 0 obj <</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>> endobj\n"
)


def test_fonts_and_compressed_objects():
    assert pdf.pdf_text(pdf.font_pdf(LINES)) == "\n".join(LINES)
    every = ["".join(chr(k) for k in range(a, a + 64)) for a in range(0x4E00, 0x9F00, 64)]
    assert pdf.pdf_text(pdf.font_pdf(every)) == "\n".join(every)


def test_page_tree():
    """Pages in order and not in the file's; a tree that holds itself and a form that shows itself end."""
    assert pdf.pdf_text(TREE) == "first page\nsecond – page\n\nin a form"
    later = TREE + b"6 0 obj <</Length 30>> stream\nBT (changed later on) Tj ET\nendstream endobj\n"
    assert pdf.pdf_text(later).startswith("changed later on\nsecond")
    assert pdf.pdf_text(TREE + b"trailer <</Encrypt 9 0 R>>") == ""


@pytest.mark.parametrize("source, value", [
    (b"<</A [1 -2.5 (a\\)(b)\\101\\\n) <4 1>] /B#20C /D /E 3 0 R>>", {"A": [1, -2.5, b"a)(b)A", b"A"], "B C": pdf_objects.Name("D"), "E": pdf_objects.Ref(3)}),
    (b"[true null [[]] <</K <<>> >>]", [True, None, [[]], {"K": {}}]), (b"% note\n 7", 7), (b"<</A 1", {"A": 1}), (b"", None), (b"(open", b"open"), (b"(\\8\\0053)", b"8\x053"),
])
def test_values(source, value):
    assert pdf_objects.value_at(source, 0)[0] == value


def test_maps():
    source = b"begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange beginbfrange <20> <7E> <0020> <8001> <8003> [<0041> <00420043> <D83DDE00>] endbfrange beginbfchar <8140> <6F22> endbfchar"
    assert pdf_objects.CMap(source, True).decode(b"a\x80\x01\x80\x02\x80\x03\x81\x40\x99\x99z") == "aABC\U0001f600漢z"


def test_damaged_files():
    r = random.Random(0)
    for k in range(300):
        data = bytearray(TREE if k % 2 else pdf.font_pdf(LINES))
        for _ in range(r.randint(1, 20)):
            data[r.randrange(len(data))] = r.randrange(256)
        assert isinstance(pdf.pdf_text(bytes(data[: r.randint(1, len(data))])), str)
    assert pdf.pdf_text(pdf.simple_pdf(["a (b) \\ c", "d"], True)) == "a (b) \\ c\nd"


def test_a_code_is_looked_up_once(monkeypatch):
    """A long text's letters aren't looked for in the font's ranges over and over; unknown codes and broken ends show nothing."""
    asked, plain = [], pdf_objects.CMap.one
    monkeypatch.setattr(pdf_objects.CMap, "one", lambda self, code: asked.append(code) or plain(self, code))
    lines = ["tide and sand é " * 400, "sand " * 300]
    assert pdf.pdf_text(pdf.font_pdf(lines)) == "\n".join(x.strip() for x in lines)
    assert len(asked) == len(set(asked)) <= 12
    cmap = pdf_objects.CMap(b"1 beginbfrange <0041> <0043> <0061> endbfrange", True)
    assert cmap.decode(b"\x00A\x00Z\x00C\x00") == "ac" == cmap.decode(b"\x00A\x00Z\x00C\x00")
