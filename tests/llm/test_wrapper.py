"""Main text of pages: layouts, broken markup, templates of a host, alignment against a plain dynamic programme."""

import functools
import random

import duckdb
import pytest

from strandline.llm import queries, wrapper


def text(source, template=()):
    return wrapper.main_text(wrapper.Tree(source), set(template))


PAGE = "<!DOCTYPE html><html><head><title>T &amp; co</title><style>p{}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href=/a>A</a></li></ul></nav><!-- <p>ad</p> --><div class='ad'>Buy.</div>"


@pytest.mark.parametrize("source, expected", [
    ("", ""), ("   ", ""), ("plain &lt;text&gt; &amp", "plain <text> &"), ("<p>a<p>b<p>c", "a\nb\nc"),
    (PAGE + "<article><h1>Title&nbsp;one</h1><p><b>First<br>line.<p>Second  &mdash;\n line</article><footer>&copy; me</footer></body></html>", "Title one\nFirst line.\nSecond — line"),
    (PAGE + "<main><h1>T</h1><p>one</p><aside>side</aside><form><p>name<input></form><section class='comments'><p>first!</p></section></main><p>late", "T\none"),
    (PAGE + "<article><header><h1>T</h1></header><div class='share-buttons'>Share</div><p>one <a href='x'>two</a></p><article class='comment'>me too</article><footer>tags</footer></article>", "T\none two"),
    ("<div id='cookieConsent'>We use cookies</div><div class='has-sidebar'><article><p>kept</p></article><div class=sidebar>not</div></div>", "kept"),
    ("<div class=wrapper><header><h1>Site</h1></header><div class=x><h1>Head</h1><div><p>" + "long text " * 20 + "</p><p>more</p></div></div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div>", "Head\n" + "long text " * 19 + "long text\nmore"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y<ul><li>z</ul></ul><pre>q\n  r</pre></article>", "a\nb\nc\nx\ny\nz\nq r"),
    ("<article>one<script>if (a < b) x('<p>')</script>two<style>p</style><noscript>no</noscript></article>", "onetwo"),
    ("<article><p>a &lt;b&gt; &notanentity; &#8217;</p><p hidden>h</p><p style='display: none'>d</p><p aria-hidden=true>e</p></article>", "a <b> ¬anentity; ’"),
    ("<article><p class=a title='x > y'>1 < 2 and <b class=\"q'>\">3</b></p><textarea>form</textarea>", "1 < 2 and 3"),
    ("<article>unclosed <b>text <!-- comment", "unclosed text"), ("<article><p>x</p></article><script>never closed", "x"),
])
def test_pages(source, expected):
    assert text(source) == expected


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "inside" + "</div>" * 5000
    assert text(deep) == "inside" and wrapper.Wrapper(deep).agreeing(wrapper.Tree(deep)) == [(0, 0)]
    long = "<article>" + "".join(f"<p>word {k}</p><h2>{k}</h2>" for k in range(3000)) + "</article>"
    assert text(long).count("\n") == 5999 and len(wrapper.Wrapper(long).agreeing(wrapper.Tree(long))) == 6000


def test_alignment_is_the_largest_common_tree():
    r = random.Random(3)

    def some(depth):
        return (r.choice("ab"), tuple(some(depth - 1) for _ in range(r.randint(0, 4 if depth else 0))))

    @functools.cache
    def size(x, y):
        if x[0] != y[0]:
            return 0
        a, b = x[1], y[1]
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(p, q))
        return 1 + m[-1][-1]

    for _ in range(300):
        shapes = wrapper.Shapes()

        def number(t):
            key = (t[0], tuple(number(k) for k in t[1]))
            n = shapes.numbers.setdefault(key, len(shapes.parts))
            if n == len(shapes.parts):
                shapes.parts.append(key)
            return n

        x, y = ("r", some(3)[1]), ("r", some(3)[1])
        a, b = number(x), number(y)
        assert shapes.size(a, b) == size(x, y)
        pairs = shapes.matched(shapes.parts[a][1], shapes.parts[b][1])
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def soup(k, extra=""):
    """A page whose elements say nothing of themselves: the same strip, notice and closing words around an article of its own."""
    body = "".join(f"<div>Sentence {k} of paragraph {j} says {k * 37 + j}.</div>" for j in range(2 + k % 4))
    return f"<html><body><div><div>The Daily Strand</div><div>Today, tomorrow, archive and more of it all</div></div><div><div>Story number {k}</div>{body}{extra}</div><div><div>All rights are with the Strand, its writers and their heirs.</div></div></body></html>"


def test_templates_of_a_host(spark):
    rows = [(k, f"https://www.strand.example/{k}", soup(k)) for k in range(12)] + [(50, "https://WWW.strand.example:443/copy", soup(3))]
    rows += [(60 + k, "http://copies.example/x", "<div><div>Only one story here.</div><div>It is everywhere.</div></div>") for k in range(4)]
    rows += [(70, "http://single.example/", soup(1)), (80, None, "<article>no host</article>"), (None, "x", None), (90, "http://e.example", ""), (90, "http://e.example", "")]
    pages = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string").repartition(5)
    found = wrapper.extract_pages(pages).collect()
    out = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and sorted((r.page_id or -1, r.url or "") for r in found) == sorted((r[0] or -1, r[1] or "") for r in rows)
    for k in range(12):
        assert out[k].split("\n") == [f"Story number {k}", *(f"Sentence {k} of paragraph {j} says {k * 37 + j}." for j in range(2 + k % 4))]
    assert out[50] == out[3] and {out[60 + k] for k in range(4)} == {"Only one story here.\nIt is everywhere."}  # copies alone make no template
    assert (out[80], out[None], out[90]) == ("no host", "", "") and "Story number 1" in out[70]
    assert wrapper.extract_pages(pages.limit(0)).collect() == []


def test_joins_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(wrapper, "BROADCAST_HOSTS", -1)
    pages = spark.createDataFrame([(k, f"https://strand.example/{k}", soup(k)) for k in range(8)], "page_id long, url string, html string")
    assert all(r.text.startswith(f"Story number {r.page_id}\n") and "Strand" not in r.text for r in wrapper.extract_pages(pages).collect())


def test_query(spark, tmp_path):
    r = random.Random(4)
    article = lambda k: f"<article><h1>Head {k} &amp; &quot;tail&quot;</h1>" + "".join(f"<p>{'<b>Bold.<br><p>' if r.random() < 0.3 else ''}Words {k} {j}  &amp;&amp; é &copy</p>" for j in range(r.randint(0, 5))) + "</article>"
    rows = [(k, f"http://h{k % 3}.example/{k}", f"{PAGE}{article(k)}<footer>&copy; {k}</footer></body>".replace("&copy</p>", "</p>")) for k in range(40)] + [(40, "u", None), (41, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.queries()["op13_html_extraction"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    expected = con.sql(wrapper.OP13_SQL)
    assert out.columns == expected.columns and sorted(map(tuple, out.collect())) == sorted(expected.fetchall())


def test_pages_that_once_broke_a_task():
    """A reference of thousands of digits, and a page none of whose text counts."""
    for source, text in (("<p>a &#" + "1" * 5000 + "; b &amp; c</p>", "a � b & c"), ("<p>&#" + "0" * 5000 + "65; &lt;</p>", "A <"), ("<nav><a href=x>menu</a></nav>", ""), ("<svg><p>x</svg>", ""), ("<p><br></p>", "")):
        assert wrapper.main_text(wrapper.Tree(source), set()) == text
