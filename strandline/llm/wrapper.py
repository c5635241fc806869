"""Main text of web pages by wrapper induction.

The pages of one host are aligned, tree by tree, with one of them: simple tree matching finds the largest common tree of
the two, in which equal siblings in a row count as one repeated node. Text that stands at its aligned place on nearly all
different pages of a host is template; places whose text varies are slots. The article is looked for among the slots:
inside main or article elements where there are any, else in the smallest subtree that holds most of the slots' text.
What an element says of itself (navigation, footer, form, advert, comment and the like) takes it out.

A host's pages are never gathered: each is compared with the host's chosen page alone, and what agrees is counted. The
chosen page is the shortest of the host's commonest sequence of tags.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Remembered, read, strings
from strandline.scratch import table

#: Different pages a host needs for a template, and the share of them on which template text stands at its place.
LEAST_PAGES, TEMPLATE_SHARE = 3, 0.9
#: A found article of which more than this share is template is one article in many copies: nothing of it is template.
MOST_TEMPLATE = 0.5
#: A subtree with this share of the slots' text holds the article.
MAIN_SHARE = 0.7
#: A list or block with this share of its text in links, and as many links, is a menu.
MENU_SHARE, MENU_LINKS = 0.8, 3
#: Chosen pages up to this many bytes in all, and rows about hosts up to this many, are broadcast; beyond it they are joined
#: by a shuffle, in which Spark splits a host that has too many pages.
BROADCAST_BYTES, BROADCAST_HOSTS = 32 << 20, 400_000
#: Open elements beyond which further ones become siblings, as in browsers.
DEEPEST = 200

#: Numbers that Python doesn't read in one piece.
LONG_NUMBER = re.compile(r"&#0*([0-9]*)(;?)")


def unescape(text: str) -> str:
    """Character references as HTML reads them; a number of thousands of digits stands for no character, or is zeros."""
    try:
        return entities.unescape(text)
    except ValueError:
        short = LONG_NUMBER.sub(lambda m: m[0] if len(m[0]) < 1000 else "\ufffd" if len(m[1]) > 7 else f"&#{m[1] or 0}{m[2]}", text)
        return entities.unescape(short)


# ---- The tree. The sets are those of the HTML standard.

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CELLS = frozenset("td th caption".split())
SPECIAL = ENDS_P | CELLS | frozenset("html head body li dd dt tr thead tbody tfoot colgroup button object template select option optgroup iframe".split())
#: Elements that end when one of the first set begins, unless one of the second stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), **{k: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
}
#: Elements whose text is a block of its own.
BLOCKS = SPECIAL - {"button", "object", "template", "select", "iframe"}

# ---- What elements say of themselves.

APART = frozenset("head nav footer aside form button select option optgroup datalist textarea script style noscript template iframe object embed applet canvas svg audio video map title menu dialog search noembed noframes input fieldset".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr privacy notice notices notification notifications popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead comment comments commentlist disqus respond replies share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager tracking outbrain taboola".split()
)
#: A class that begins so tells of something else on the page.
NOT_ITSELF = frozenset("has no with without is".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?+|[\s/=])*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "label", "parent", "kids", "text", "apart")

    def __init__(self, tag: str, parent: Node | None, label: str = "", text: str = ""):
        self.tag, self.parent, self.label, self.text, self.apart = tag, parent, label or tag, text, False
        self.kids: list[Node] = []
        if parent is not None:
            parent.kids.append(self)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(source)}


def _set_apart(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether an element says that it is no part of the article. `inside`: it stands in an article or main element."""
    if tag in APART or "hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in APART_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "header" and not inside or "display:none" in at.get("style", "").replace(" ", ""):
        return True
    for name in [*at.get("class", "").split(), at.get("id", "")]:
        words = [w.lower() for w in NAME_PARTS.findall(name)]
        if words and words[0] not in NOT_ITSELF and not (inside and words[-1] == "header") and (words[0] in APART_WORDS or words[-1] in APART_WORDS):
            return True
    return False


class Tree:
    """A page's elements and texts; texts are leaves with the tag "#"."""

    def __init__(self, source: str):
        self.root = Node("html", None)
        self.texts: list[Node] = []
        self.open = [self.root]
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            self._text(source[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    self._element(tag, m[3])
                    if tag in RAW:
                        close = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                        at = close.start() if close else end
        del self.open

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            if self.open[-1].tag == "head":
                self.open.pop()
            self.texts.append(Node("#", self.open[-1], text=unescape(text)))

    def _pop_to(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """End the outermost of the given open elements that no element of `until` holds, and what is open in it."""
        found = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                found = k
            elif self.open[k].tag in until:
                break
        if found:
            del self.open[found:]

    def _element(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag not in HEAD:
            self._pop_to({"head"}, set())
        if tag in ENDS_P:
            self._pop_to({"p"}, CELLS | {"button", "object"})
        if tag in IMPLIED:
            self._pop_to(*IMPLIED[tag])
        parent = self.open[-1]
        at = _attributes(attributes) if attributes else {}
        node = Node(tag, parent, tag + "." + re.sub(r"\d+", "", at["class"]) if "class" in at else tag)
        node.apart = _set_apart(tag, at, bool(at or tag == "header") and any(n.tag in ("article", "main") for n in self.open))
        if at.get("role", "").lower() == "main":
            node.tag = "main"
        if tag not in VOID and len(self.open) < DEEPEST and not (attributes.endswith("/") and any(n.tag in ("svg", "math") for n in self.open)):
            self.open.append(node)

    def _close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if tag not in SPECIAL and self.open[k].tag in SPECIAL:
                return


# ---- Alignment by simple tree matching.


class Group:
    """Equal siblings in a row as one node: `texts` are the numbers of its texts, `kids` stand for the kids of all of them."""

    __slots__ = ("shape", "label", "kids", "texts")

    def __init__(self, shape: int, label: str, kids: list[Group], texts: list[int]):
        self.shape, self.label, self.kids, self.texts = shape, label, kids, texts

    def add(self, other: Group) -> None:
        self.texts += other.texts
        for a, b in zip(self.kids, other.kids, strict=True):
            a.add(b)


class Shapes:
    """Numbers of tree shapes and the size of the largest common tree of two of them."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.common: dict[tuple[int, int], int] = {}

    def grouped(self, tree: Tree) -> Group:
        number = {id(n): k for k, n in enumerate(tree.texts)}
        return self._group(tree.root, number)

    def _group(self, node: Node, number: dict[int, int]) -> Group:
        kids: list[Group] = []
        for kid in node.kids:
            g = self._group(kid, number)
            if kids and kids[-1].shape == g.shape:
                kids[-1].add(g)
            else:
                kids.append(g)
        key = (node.label, tuple(k.shape for k in kids))
        shape = self.numbers.setdefault(key, len(self.parts))
        if shape == len(self.parts):
            self.parts.append(key)
        return Group(shape, node.label, kids, [number[id(node)]] if node.tag == "#" else [])

    def size(self, a: int, b: int) -> int:
        """Nodes of the largest common tree of two shapes; 0 where the labels differ."""
        if (a, b) not in self.common:
            (x, kids_x), (y, kids_y) = self.parts[a], self.parts[b]
            self.common[a, b] = 0 if x != y else 1 + sum(self.size(kids_x[i], kids_y[j]) for i, j in self.matched(kids_x, kids_y))
        return self.common[a, b]

    def matched(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of two sequences of shapes that the best alignment in order puts together."""
        first, last = 0, 0
        short = min(len(a), len(b))
        # Equal ends belong together in some best alignment.
        while first < short and a[first] == b[first]:
            first += 1
        while last < short - first and a[-1 - last] == b[-1 - last]:
            last += 1
        out = [(k, k) for k in range(first)]
        x, y = a[first : len(a) - last], b[first : len(b) - last]
        if x and y:
            xs, at_x = np.unique(np.array(x), return_inverse=True)
            ys, at_y = np.unique(np.array(y), return_inverse=True)
            sizes = np.array([[self.size(int(p), int(q)) for q in ys] for p in xs])
            out += [(i + first, j + first) for i, j in _aligned(sizes, at_x, at_y, 0, 0)]
        return out + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def _best(sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weight of the best alignment of all of x with each beginning of y."""
    row = np.zeros(len(y) + 1, np.int64)
    for p in x:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + sizes[p][y])
        row = np.maximum.accumulate(new)
    return row


def _aligned(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Halves of x with their best halves of y, so that memory is linear however many siblings there are."""
    if not len(x) or not len(y):
        return []
    if len(x) == 1:
        k = int(sizes[x[0]][y].argmax())
        return [(i, j + k)] if sizes[x[0]][y[k]] else []
    half = len(x) // 2
    cut = int((_best(sizes, x[:half], y) + _best(sizes, x[half:][::-1], y[::-1])[::-1]).argmax())
    return _aligned(sizes, x[:half], y[:cut], i, j) + _aligned(sizes, x[half:], y[cut:], i + half, j + cut)


def _flat(text: str) -> str:
    return " ".join(text.split())


class Wrapper:
    """A host's chosen page, which other pages are aligned with."""

    MOST_SHAPES = 50_000

    def __init__(self, source: str):
        self.tree = Tree(source)
        self.texts = [_flat(n.text) for n in self.tree.texts]
        self._renew()

    def _renew(self) -> None:
        self.shapes = Shapes()
        self.group = self.shapes.grouped(self.tree)

    def agreeing(self, page: Tree) -> list[tuple[int, int]]:
        """(number of a text of the chosen page, number of an equal text of `page` at an aligned place)."""
        if len(self.shapes.parts) > self.MOST_SHAPES:
            self._renew()
        out: list[tuple[int, int]] = []
        waiting = [(self.group, self.shapes.grouped(page))]
        while waiting:
            own, other = waiting.pop()
            if own.label != other.label:
                continue
            if own.texts:
                number = {self.texts[k]: k for k in reversed(own.texts)}
                out += [(number[t], k) for k in other.texts if (t := _flat(page.texts[k].text)) in number]
            pairs = self.shapes.matched(tuple(k.shape for k in own.kids), tuple(k.shape for k in other.kids))
            waiting += [(own.kids[a], other.kids[b]) for a, b in pairs]
        return out


# ---- The article.


class Block:
    __slots__ = ("text", "node", "template", "links")

    def __init__(self, text: str, node: Node, template: bool, links: int):
        self.text, self.node, self.template, self.links = text, node, template, links


def _blocks(tree: Tree, template: set[int]) -> list[Block]:
    """Texts that no element sets apart, as blocks in page order."""
    out: list[Block] = []
    part: list[tuple[str, bool, bool]] = []
    holder = tree.root
    count = 0

    def end() -> None:
        text = _flat("".join(t for t, _, _ in part))
        if text:
            said = [(t, fixed, link) for t, fixed, link in part if t.strip()]
            out.append(Block(text, holder, all(fixed for _, fixed, _ in said), sum(len(_flat(t)) for t, _, link in said if link)))
        part.clear()

    def walk(node: Node, link: bool) -> None:
        nonlocal holder, count
        if node.tag == "#":
            part.append((node.text, count in template, link))
            count += 1
            return
        if node.tag == "br":
            part.append((" ", True, link))
            return
        if node.apart and not _holds_article(node):
            count += _count(node)
            if node.tag in BLOCKS:
                end()
            return
        block = node.tag in BLOCKS
        if block:
            end()
            holder = node
        for kid in node.kids:
            walk(kid, link or node.tag == "a")
        if block:
            end()
            holder = node.parent or tree.root

    walk(tree.root, False)
    end()
    return out


def _count(node: Node) -> int:
    return node.tag == "#" or sum(map(_count, node.kids))


def _holds_article(node: Node) -> bool:
    """A wrapper around the article may carry any class; an element that is none by its tag may not."""
    if node.tag in APART or node.tag in ("header", "article"):
        return False
    return any(k.tag in ("article", "main") and not k.apart or _holds_article(k) for k in node.kids)


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _within(blocks: list[Block], regions: set[int]) -> list[Block]:
    return [b for b in blocks if any(id(n) in regions for n in _above(b.node))]


def _densest(blocks: list[Block], root: Node) -> Node:
    """The smallest element that holds MAIN_SHARE of the blocks' text and more than one of them."""
    mass: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in blocks:
        for n in _above(b.node):
            mass[id(n)] = mass.get(id(n), 0) + len(b.text)
            count[id(n)] = count.get(id(n), 0) + 1
    node, most = root, MAIN_SHARE * mass.get(id(root), 0)
    while True:
        inner = [k for k in node.kids if mass.get(id(k), 0) >= most and count.get(id(k), 0) > 1]
        if not inner:
            return node
        node = inner[0]


def _menus(blocks: list[Block], region: Node) -> set[int]:
    """Elements inside the region whose text is nearly all links."""
    sums: dict[int, list] = {}
    for b in blocks:
        for n in _above(b.node):
            if n is region:
                break
            held = sums.setdefault(id(n), [0, 0, 0])
            held[0] += len(b.text)
            held[1] += b.links
            held[2] += b.links > 0
    return {k for k, (size, links, n) in sums.items() if n >= MENU_LINKS and links >= MENU_SHARE * size}


def main_text(tree: Tree, template: set[int]) -> str:
    """The article's blocks, one a line. `template`: numbers of the texts that stand on nearly all pages of the host."""
    blocks = _blocks(tree, template)
    for tag in ("main", "article"):
        regions = {id(n) for b in blocks for n in _above(b.node) if n.tag == tag}
        if regions:
            found = _within(blocks, regions)
            break
    else:
        slots = [b for b in blocks if not b.template] or blocks
        region = _densest(slots, tree.root)
        menus = _menus(blocks, region)
        found = [b for b in _within(blocks, {id(region)}) if not any(id(n) in menus for n in _above(b.node))]
        heads = [b for b in slots if b.node.tag == "h1"]
        if len(heads) == 1 and heads[0] not in found:
            found = [b for b in blocks if b in found or b is heads[0]]
    size = sum(len(b.text) for b in found)
    if sum(len(b.text) for b in found if b.template) <= MOST_TEMPLATE * size:
        found = [b for b in found if not b.template]
    return "\n".join(b.text for b in found)


# ---- DataFrames

WRAPPERS = 64  # parsed chosen pages that a worker remembers
_EVIDENCE = "host string, place int, digest long"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Remembered(Wrapper, WRAPPERS)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows = [(host, place, digest) for host, digest, source, chosen in zip(*(c.to_pylist() for c in part.columns), strict=True) for place in {a for a, _ in known[chosen].agreeing(Tree(source))}]
            host, place, digest = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(place, pa.int32()), pa.array(digest, pa.int64())], ["host", "place", "digest"])


_TEXTS = "page_id long, url string, text string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Remembered(Wrapper, WRAPPERS)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = []
            for source, chosen, fixed in zip(strings(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                tree = Tree(source)
                places = set(fixed or ())
                texts.append(main_text(tree, {k for a, k in known[chosen].agreeing(tree) if a in places} if places else set()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _small(chosen: DataFrame) -> DataFrame:
    """Broadcast where the bytes allow it."""
    size = chosen.agg(F.sum(F.octet_length("chosen"))).first()[0] or 0
    return F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen


def choose_pages(pages: DataFrame) -> DataFrame:
    """host, n (different pages), chosen (html): the page that a host's pages are aligned with, for hosts with enough of them."""
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)))
    known = pages.select("host", F.xxhash64(tags).alias("layout"), F.length("html").alias("size"), F.xxhash64("html").alias("digest"))
    known = known.groupBy("host", "layout", "size", "digest").agg(F.count(F.lit(1)).alias("copies"))
    layouts = known.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("size", "digest")).alias("shortest"))
    best = F.max_by("shortest", F.struct("n", "layout"))
    hosts = layouts.groupBy(F.col("host").alias("c_host")).agg(F.sum("n").alias("n"), best.alias("best")).where(F.col("n") >= LEAST_PAGES)
    hosts = table(hosts, "hosts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    same = (F.col("host") == F.col("c_host")) & (F.xxhash64("html") == F.col("best.digest")) & (F.length("html") == F.col("best.size"))
    return pages.join(hosts, same).groupBy("host", "n").agg(F.min("html").alias("chosen"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one row for each row of pages, with the article's blocks as lines; empty if there is none.

    Null or empty html: an empty text. Pages without a host (null, empty or relative URL) count as one host's. Equal
    pages count once for the template and keep their rows. Null page_id and url stay null. Empty table: no rows. Other
    columns are not read. White space is what Unicode calls so, a non-breaking space too. A line break is white space
    of its block.
    """
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("host", host_of(p["url"]))
    # Written: both passes over the pages read it.
    chosen = table(choose_pages(p.where(F.col("html") != "")), "chosen-pages")
    agreeing = p.join(_small(chosen), "host").select("host", F.xxhash64("html").alias("digest"), "html", "chosen").mapInArrow(_evidence, _EVIDENCE)
    fixed = agreeing.groupBy("host", "place").agg(F.countDistinct("digest").alias("seen"))
    fixed = fixed.join(chosen.select("host", "n"), "host").where(F.col("seen") >= TEMPLATE_SHARE * F.col("n"))
    fixed = fixed.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("places"))
    wrappers = table(chosen.join(fixed, "host"), "wrappers")
    rows = p.join(_small(wrappers.select("host", "chosen", "places")), "host", "left")
    return rows.select("page_id", "url", "html", "chosen", "places").mapInArrow(_extract, _TEXTS)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: The given pages name their article, so SQL can cut it out.
OP13_SQL = r"""
WITH parts AS (
  SELECT page_id, url, unnest(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>')) AS part, generate_subscripts(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>'), 1) AS k FROM pages),
blocks AS (
  SELECT page_id, url, k, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(part, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM parts),
texts AS (SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY k) FILTER (block <> ''), '') AS text FROM blocks GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
