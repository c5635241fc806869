"""Lexical rules as Column expressions: lines and white space as Python has them, quotes, signatures, fingerprints, dates.

All stay on the JVM. `let` names a value that an expression uses more than once, so it is computed once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import html5
from unicodedata import category

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators that Python's str counts as such.
WS = r"[\s\x1c-\x1f]"
#: The same, one by one.
SPACES = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())
#: Those that Unicode calls spaces, which DuckDB's trim takes.
BLANKS = "".join(c for c in SPACES if category(c) == "Zs")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Header names, separators and prefixes of the export format.
HEADER = r"^([A-Za-z][A-Za-z\-]*):[\s\x1c-\x1f]*(.*)$"
SEPARATOR = r"(?iU)^\s*-{2,}\s*(original message|forwarded message)\s*-{2,}\s*$"
ATTRIBUTION = r"(?iU)^On\b"
SIGNATURE = r"^--[ \t]?$"
#: A line that a separator, an attribution, a quoted line or a signature may begin; it may find more than those.
SUSPECT = rf"(?iU)(?:\A|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]){WS}*(?:>|--|On\b)"
SUBJECT_PREFIX = rf"(?iU)^({WS}*(re|fw|fwd){WS}*:{WS}*)+"
ANY_DATE = r"(\d{4})[-/](\d{2})[-/](\d{2})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def split_lines(c: Column) -> Column:
    """Lines without their ends; no line after a last line break, and none in an empty text."""
    lines = F.split(c, LINE_BREAK)
    return let(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def _cut(lines: Column, at: Column) -> Column:
    """The lines before 0-based line `at`; all if it is null."""
    return F.when(at.isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.greatest(at, F.lit(0))))


def attribution_index(lines: Column) -> Column:
    """0-based line that opens a quoted reply ("On ... wrote:" within three lines); null if none."""
    window = lambda i: F.lower(F.concat_ws(" ", F.transform(F.slice(lines, i + 1, F.lit(3)), strip)))
    return F.array_min(F.transform(lines, lambda x, i: F.when(strip(x).rlike(ATTRIBUTION) & window(i).contains("wrote:"), i)))


def strip_quoted(body: Column) -> Column:
    """The text before the first separator or attribution, without lines that begin with '>'."""

    def of(lines: Column) -> Column:
        separator = F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(SEPARATOR), i)))
        kept = F.filter(_cut(lines, F.least(separator, attribution_index(lines))), lambda x: ~x.rlike(rf"(?U)^{WS}*>"))
        return strip(F.array_join(kept, "\n"))

    return let(split_lines(text(body)), of)


def strip_signature(body: Column) -> Column:
    """The text before the first signature line."""
    of = lambda lines: F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(SIGNATURE), i)))
    return let(text(body), lambda b: let(split_lines(b), lambda lines: strip(F.when(of(lines).isNull(), b).otherwise(F.array_join(_cut(lines, of(lines)), "\n")))))


def clean_body(body: Column) -> Column:
    return strip_signature(strip_quoted(body))


def fingerprint(body: Column) -> Column:
    """What a message says: no quotes, no signature, one space between words, lower case. May be empty.

    Only a body with a line that could begin a quote or a signature is cut into lines; most have none.
    """
    return F.lower(squeeze(F.when(text(body).rlike(SUSPECT), clean_body(body)).otherwise(text(body))))


def normal_sender(sender: Column) -> Column:
    """The address in angle brackets, else the whole; lower case."""
    address = F.regexp_extract(text(sender), "<([^>]+)>", 1)
    return F.lower(strip(F.when(address != "", address).otherwise(text(sender))))


def display_name(sender: Column) -> Column:
    """The name before the address, else the address, else "Unknown"."""
    s = text(sender)
    bracket = s.rlike("<[^>]+>")
    name = strip(F.when(bracket, F.regexp_extract(s, r"(?s)\A(.*?)<[^>]+>", 1)).otherwise(s))
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(normal_sender(s), F.lit("")), F.lit("Unknown"))


def who(sender: Column) -> Column:
    """The sender without any address, else the address, else "Unknown"."""
    s = text(sender)
    plain = strip(F.regexp_replace(s, "<[^>]+>", ""))
    address = F.regexp_extract(s, "<([^>]+)>", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (plain, strip(F.when(address != "", address).otherwise(s)))], F.lit("Unknown"))


def parties(sender: Column, recipient: Column) -> Column:
    return F.when(text(recipient) != "", F.concat(display_name(sender), F.lit(" → "), display_name(recipient))).otherwise(display_name(sender))


def message_ref(raw: Column) -> Column:
    """A message id without brackets, lower case."""
    inner = F.regexp_extract(text(raw), "<([^>]+)>", 1)
    return F.lower(strip(F.when(inner != "", inner).otherwise(text(raw))))


def split_attachments(raw: Column) -> Column:
    return F.filter(F.transform(F.split(text(raw), "[;,]"), strip), lambda x: x != "")


def split_references(raw: Column) -> Column:
    """All ids in brackets, else the words."""
    bracketed = F.regexp_extract_all(text(raw), F.lit("<[^>]+>"), F.lit(0))
    return F.when(F.size(bracketed) > 0, bracketed).otherwise(F.filter(F.split(squeeze(text(raw)), " "), lambda x: x != ""))


def base_subject(subject: Column) -> Column:
    """Without any re:, fw:, fwd: in front."""
    return strip(F.regexp_replace(text(subject), SUBJECT_PREFIX, ""))


def slug(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single dashes; "x" if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("x"))


def snippet(c: Column, limit: int) -> Column:
    flat = squeeze(text(c))
    return let(flat, lambda x: F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, limit - 1), rf"(?U){WS}+\z", ""), F.lit("…"))))


# The forms of dates that are read, and where undated messages stand.
FAR_FUTURE = "timestamp_ntz'9999-12-31 23:59:59.999999'"


#: What is read as a time: a day with a clock (seconds only with dashes) or a day with dashes.
SENT = rf"(?U)^\d{{4}}(?:-\d{{1,2}}-\d{{1,2}}{WS}+\d{{1,2}}:\d{{1,2}}(?::\d{{1,2}})?|/\d{{1,2}}/\d{{1,2}}{WS}+\d{{1,2}}:\d{{1,2}}|-\d{{1,2}}-\d{{1,2}})$"
#: What is read as a timeline's date: a day, a month or a year.
DAY = r"^(?!0000)\d{4}(?:-\d{1,2}(?:-\d{1,2})?|/\d{1,2}/\d{1,2})?$"


def _made(text_of_numbers: Column, between: str) -> Column:
    """The time that year, month, day, hour, minute and second make; missing ones are the least. Null if there is none."""

    def of(parts: Column) -> Column:
        part = lambda k, least: F.coalesce(F.get(parts, F.lit(k)), F.lit(least)).try_cast("int")
        year, second = F.nullif(part(0, "1"), F.lit(0)), F.nullif(part(5, "0"), F.lit(60))  # Spark has a year 0 and makes a minute of 60 seconds
        return F.call_function("try_make_timestamp_ntz", year, part(1, "1"), part(2, "1"), part(3, "0"), part(4, "0"), second.cast("decimal(8,6)"))

    return let(F.split(text_of_numbers, between), of)


def sent_at(timestamp: Column) -> Column:
    """When a message was sent: known forms, else the first date in the text at midnight, else the far future."""

    t = strip(text(timestamp))
    known = F.when(t.rlike(SENT), _made(t, rf"(?U)[-/:]|{WS}+"))
    return F.coalesce(known, F.when(t.rlike(ANY_DATE), _made(F.regexp_extract(t, ANY_DATE, 0), "[-/]")), F.expr(FAR_FUTURE))


def iso_date(timestamp: Column) -> Column:
    t = text(timestamp)
    return F.when(t.rlike(ANY_DATE), F.concat_ws("-", *[F.regexp_extract(t, ANY_DATE, k) for k in (1, 2, 3)])).otherwise(t)


def event_date(value: Column) -> Column:
    """A timeline date: a day, a month or a year; null for anything else."""
    v = strip(text(value))
    whole = F.when(F.length(v) == 4, F.concat(v, F.lit("-1-1"))).when(v.rlike(r"^\d+-\d+$"), F.concat(v, F.lit("-1"))).otherwise(F.replace(v, F.lit("/"), F.lit("-")))
    return F.when(v.rlike(DAY), F.try_to_date(whole, "y-M-d"))


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMM d, yyyy")


def short_date(value: Column) -> tuple[Column, Column]:
    d = event_date(value)
    return F.coalesce(F.date_format(d, "MMM d"), text(value)), F.coalesce(F.date_format(d, "yyyy"), F.lit(""))


def title_case(c: Column) -> Column:
    """Python's str.title for letters: each run of letters begins with a capital."""
    pieces = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    # A letter whose capital is two letters, such as the sharp s, begins with the first of them.
    first = lambda up: F.concat(F.substring(up, 1, 1), F.lower(F.substr(up, F.lit(2))))
    return F.array_join(F.transform(pieces, lambda x: F.concat(first(F.upper(F.substring(x, 1, 1))), F.lower(F.substr(x, F.lit(2))))), "")


def tab_label(folder: Column) -> Column:
    """A folder's name without an ordering number in front."""
    name = strip(F.regexp_replace(F.regexp_replace(folder, rf"(?U)^\d+[-_\s\x1c-\x1f]*", ""), "[-_]+", " "))
    return F.when(name == "", folder).otherwise(title_case(name))


def prettify(c: Column) -> Column:
    return title_case(strip(F.regexp_replace(c, "[-_]+", " ")))


# What a plain colour looks like, and the beginnings of links that aren't let through.
PLAIN_COLOR = r"^#[0-9A-Fa-f]{3,8}$|^(?:rgb|rgba|hsl|hsla)\([0-9.,%/\s]+\)$|^[A-Za-z]+$"
UNSAFE_LINK = rf"(?iU)^{WS}*(?:javascript|vbscript|data){WS}*:"


def safe_color(c: Column) -> Column:
    """A plain colour, else null: hexadecimal, rgb()/hsl() or a name."""
    v = strip(text(c))
    return F.when(v.rlike(PLAIN_COLOR), v)


def safe_href(c: Column) -> Column:
    return F.when((text(c) != "") & ~text(c).rlike(UNSAFE_LINK), c)


def tint(color: Column, alpha: str) -> Column:
    """A hex colour with an opacity; grey for anything else."""
    h = F.regexp_replace(text(color), "^#+", "")
    six = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    channel = lambda k: F.conv(F.substring(six, k, 2), 16, 10)
    return F.when(six.rlike("^[0-9A-Fa-f]{6}"), F.concat(F.lit("rgba("), channel(1), F.lit(","), channel(3), F.lit(","), channel(5), F.lit(f",{alpha})"))).otherwise(F.lit(f"rgba(107,114,128,{alpha})"))


def safe_name(name: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(text(name), r"\\", "/"), "([^/]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", ""), F.lit("")), F.lit("upload"))


def local_path(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^file:/+", "/")


def href_for(path: Column, directory: str, link_base: str | None = None) -> Column:
    """A link to a source file: below link_base if there is one, else a file URL; paths of other file systems as they are."""
    plain, top = local_path(path), re.sub("^file:/+", "/", directory.rstrip("/")) + "/"
    if link_base:
        inside = F.when(F.startswith(plain, F.lit(top)), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)
        return F.concat(F.lit(link_base.rstrip("/") + "/"), inside)
    return F.when(plain.rlike("^[a-z0-9]+://"), plain).otherwise(F.concat(F.lit("file:///"), F.regexp_replace(plain, "^/", "")))


def _character(digits: Column, base: int) -> Column:
    """What a numeric reference stands for; digits without the base's sign."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("long")).otherwise(F.lit(1 << 32))
    named = F.get(F.lit(C1), (number - 0x80).cast("int"))

    def of(n: Column) -> Column:
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        none = n.between(0x01, 0x08) | n.isin(0x0B, 0x7F) | n.between(0x0E, 0x1F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        broken = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(broken, F.lit("\ufffd")).when(n.between(0x80, 0x9F), named).when(none, F.lit("")).otherwise(plain)

    return let(number, of)


def _buckets(names: dict[str, str]) -> Column:
    """The names' table as one literal: an array by first letter and length of maps that hold one to a few names."""
    buckets: list[dict[str, str]] = [{} for _ in range(64 * LONGEST)]
    for name, character in names.items():
        buckets[(ord(name[0]) - 65) * LONGEST + len(name) - 1][name] = character
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")


def _named(name: Column, buckets: Column) -> Column:
    """The character of a name, or null."""
    place = (F.ascii(name) - 65) * LONGEST + F.length(name) - 1
    held = F.get(buckets, F.when((F.length(name) <= LONGEST) & name.rlike("^[A-Za-z]"), place))
    return F.try_element_at(held, name)


def decode_entities(c: Column) -> Column:
    """Character references as HTML reads them, each once: what a decoded "&" makes is not decoded again.

    The text is cut before every "&". A name that ends in a semicolon is looked up whole; else the longest of the old names
    that it begins with counts, and what is behind it stays.
    """
    every, old = _buckets(html5), _buckets(OLD_NAMES)
    lengths = sorted({len(name) for name in OLD_NAMES}, reverse=True)

    def piece(x: Column) -> Column:
        token = F.regexp_extract(x, r"^&(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\x0c <&#;]{1,32};?)", 1)
        digits = F.regexp_extract(token, "^#[xX]?([0-9A-Fa-f]+)", 1)
        number = F.when(token.rlike("^#[xX]"), _character(digits, 16)).otherwise(_character(digits, 10))
        rest = lambda n: F.substr(x, F.lit(n + 2))
        begun = [F.concat(_named(F.substring(token, 1, n), old), rest(n)) for n in lengths]
        whole = F.concat(F.when(F.startswith(token, F.lit("#")), number).otherwise(_named(token, every)), F.substr(x, F.length(token) + 2))
        return F.when(token == "", x).otherwise(F.coalesce(whole, F.when(~F.startswith(token, F.lit("#")), F.coalesce(*begun)), x))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")).otherwise(c)


def decode_names(c: Column, names: dict[str, str]) -> Column:
    """These names alone, each with its semicolon, each once: the one that makes an "&" comes last."""
    for name, character in sorted(names.items(), key=lambda x: x[1] == "&"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(character))
    return c


def html_to_text(html: Column, names: dict[str, str] | None = None) -> Column:
    """Tags as spaces, entities decoded once, lines squeezed, empty lines dropped.

    names: the plain rule of pages instead of Python's. Only these references count; lines end at line feeds, spaces,
    tabs and returns are squeezed and Unicode's spaces stripped; null stays null.
    """
    if names is not None:
        plain = decode_names(F.regexp_replace(html, "<[^>]+>", " "), names)
        lines = F.transform(F.split(plain, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r]+", " "), F.lit(BLANKS)))
        return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    t = decode_entities(F.regexp_replace(text(html), r"(?s)<[^>]+>", " "))
    lines = F.transform(split_lines(t), lambda x: strip(F.regexp_replace(x, r"[ \t\r\x0c\x0b]+", " ")))
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


#: Names that count without a semicolon too.
OLD_NAMES = {name: character for name, character in html5.items() if not name.endswith(";")}
LONGEST = max(map(len, html5))
#: What the numbers 128 to 159 stand for: Windows-1252, or themselves where that has nothing.
C1 = [bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0)]
