"""Character references as html.unescape reads them: every name with random tails, numbers at all borders."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from strandline.functions import text as X


def test_references(spark):
    r = random.Random(1)
    tails = ["", ";", "x", "; ", "=", "é", "1", ";;", "&", " ", "\n", "mp;"]
    rows = [f"&{n}{r.choice(tails)}" for n in html5] + [f"&{n[: r.randint(1, len(n))]}{r.choice(tails)}" for n in html5]
    borders = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**7, 10**12, 10**30]
    rows += [f"a &#{k}{r.choice(tails)}" for k in borders] + [f"&#x{k:x}{r.choice(tails)}&#X{k:X}" for k in borders]
    rows += ["&#0000065;&#x00000000041;", "&amp;lt;", "&&amp&", "&#;&#x;&#xg", "& &", "", "plain", "&" + "a" * 40 + ";", "&notit;&notin;&NotEqualTilde;", "&é;", "\U0001f600&lt\U0001f600"]
    out = spark.createDataFrame(list(enumerate(rows)), "k int, x string").select("k", X.decode_entities(F.col("x")).alias("y")).collect()
    got = {k: y for k, y in out}
    assert [got[k] for k in range(len(rows))] == [html.unescape(x) for x in rows]
    assert spark.createDataFrame([(None,)], "x string").select(X.decode_entities(F.col("x"))).first()[0] is None
