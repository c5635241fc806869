"""Licence scan: one automaton finds notice phrases and identifier tags, a shunting-yard parser reads the tags' expressions.

A text is lower-cased (A-Z) and cut into words of letters, digits and all characters beyond ASCII; the words, joined by
single spaces, run through an Aho-Corasick automaton of phrases in one pass, so a phrase is found where its words stand
consecutively, whatever is between them. A hit of the identifier tag's words makes the scanner read the expressions
behind the tags in the text itself. Expressions of and, or, with, + and parentheses become postfix order by Dijkstra's
shunting-yard and are evaluated: which licences they name, and whether some choice that they allow is permissive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import raw, read, small_batches

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Wording of well-known licence notices and what it stands for.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "redistribution and use in source and binary forms with or without modification": "bsd-notice",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "creative commons attribution": "cc-by-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG_WORDS = "spdx license identifier"
TAG = re.compile(rb"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
# Licences whose terms are permissive.
PERMISSIVE = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc0-1.0 cc-by-4.0 isc mit mit-0 unlicense zlib".split())
# Identifiers of well-known licences, besides the permissive ones, and of exceptions.
OTHERS = frozenset(
    "afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 artistic-1.0 artistic-2.0 bsd-4-clause cc-by-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 "
    "cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later "
    "lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 "
    "ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-dfs-2016 upl-1.0 vim w3c wtfpl x11 zpl-2.1".split()
)
EXCEPTIONS = frozenset("autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception openssl-exception".split())
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: How sure a finding is; a text's score is that of its best. SURE_BROKEN: a tag whose expression can't be read or names something unknown.
SURE_EXPRESSION, SURE_NOTICE, SURE_BASE, SURE_BROKEN = 1.0, 0.9, 0.6, 0.3

#: All bytes that don't belong to words become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def known(name: str) -> bool:
    """Whether a lower-cased name is a listed licence or exception or a reference that a project defines itself."""
    name = name.rstrip("+")
    return name in PERMISSIVE or name in OTHERS or name in EXCEPTIONS or name.startswith(("licenseref-", "documentref-"))


def postfix(expression: str) -> list[str] | None:
    """The longest expression at the beginning in postfix order; None if none begins there. What follows it is left out."""
    out: list[str] = []
    operators: list[str] = []
    operand = True  # whether an operand is due
    best: list[str] | None = None
    for token in re.findall(r"[()]|[^\s()]+", expression):
        low = token.lower()
        if operand and token == "(":
            operators.append(token)
        elif operand and low not in PRECEDENCE and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.:+-]*", token):
            out.append(low)
            operand = False
        elif not operand and low in PRECEDENCE:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[low]:
                out.append(operators.pop())
            operators.append(low)
            operand = True
        elif not operand and token == ")" and "(" in operators:
            while operators[-1] != "(":
                out.append(operators.pop())
            operators.pop()
        else:
            break
        if not operand and "(" not in operators:
            best = out + operators[::-1]
    return best


def evaluate(rpn: list[str]) -> tuple[frozenset[str], bool] | None:
    """The licences named (an exception belongs to its licence) and whether the expression allows permissive use."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in rpn:
        if token not in PRECEDENCE:
            stack.append((frozenset([token]), token.rstrip("+") in PERMISSIVE))
            continue
        (b, b_free), (a, a_free) = stack.pop(), stack.pop()
        if token == "with":
            if len(a) != 1 or len(b) != 1:
                return None
            stack.append((frozenset([f"{min(a)} with {min(b)}"]), a_free))
        else:
            stack.append((a | b, a_free or b_free if token == "or" else a_free and b_free))
    return stack[0]


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES):
        self.automaton = ahocorasick.Automaton()
        meanings: dict[str, list[tuple[str, str]]] = {TAG_WORDS: [("tag", "")]}
        for kind, phrases in (("base", base), ("notice", notices)):
            for phrase, label in phrases.items():
                meanings.setdefault(phrase, []).append((kind, label))
        for phrase, what in meanings.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, what))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, score, expressions, permissive."""
        words = text.translate(WORD_BYTES).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        base: set[str] = set()
        labels: set[str] = set()
        n_base, first, last, tag, score, counted, start = 0, None, None, False, 0.0, 0, 0
        for end, (n, what) in self.automaton.iter(line):
            for kind, label in what:
                if kind == "tag":
                    tag = True
                    continue
                labels.add(label)
                score = max(score, SURE_BASE if kind == "base" else SURE_NOTICE)
                if kind == "base":
                    at = end - n  # the space before the phrase's first word; later hits may begin a little earlier
                    counted = counted + line.count(" ", start, at) if at >= start else counted - line.count(" ", at, start)
                    start = at
                    base.add(label)
                    n_base += 1
                    first = counted if first is None else min(first, counted)
                    last = counted if last is None else max(last, counted)
        expressions: list[str] = []
        free: list[bool] = []
        for m in TAG.finditer(text) if tag else ():
            expression = m[1].decode("utf-8", "replace").strip()
            rpn = postfix(expression)
            result = evaluate(rpn) if rpn else None
            expressions.append(expression)
            if result is None:
                labels.add("spdx:unparsed")
                score = max(score, SURE_BROKEN)
            else:
                sure = all(known(part) for x in result[0] for part in x.split(" with "))
                labels |= {f"spdx:{x}" for x in result[0] if all(map(known, x.split(" with ")))} | ({"spdx:unknown"} if not sure else set())
                free.append(result[1])
                score = max(score, SURE_EXPRESSION if sure else SURE_BROKEN)
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, all(free) if free else None


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each row of docs, with the columns of SCHEMA; expressions are those behind identifier tags, in order.

    n_base counts all places of base phrases, overlapping ones too. permissive: whether all expressions that can be read
    allow permissive use; null without one. Of an expression the longest part that can be read counts; names that are no
    listed licence give the label spdx:unknown and a low score. Null or empty text: no words, empty labels, score 0. Null doc_id stays null,
    repeated rows stay. Empty table: no rows. Other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in small_batches(batches):
            rows = [scanner.scan(t) for t in raw(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).withColumn("expressions", F.array_join("expressions", " | "))


def base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan finds of the base phrases alone, which SQL can say too."""
    out = scan_licenses(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_PLACES = " UNION ALL ".join(f"SELECT doc_id, p - 1 AS place, '{label}' AS label FROM words WHERE w[p:p + {len(phrase.split()) - 1}] = {phrase.split()!r}" for phrase, label in BASE.items())
BASE_SQL = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM texts),
places AS ({_PLACES})
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(place) AS n_base, CAST(min(place) AS BIGINT) AS first_word, CAST(max(place) AS BIGINT) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM texts t LEFT JOIN places USING (doc_id) GROUP BY t.doc_id, len(w)
"""
