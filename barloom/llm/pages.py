"""HTML extraction by wrapper induction.

Pages of one host and template are aligned with their pivot page by simple tree matching: two trees match at equal tags, and their children are
aligned in order so that most nodes match.  For every text block of the pivot it is counted over all pages of the host how
often the aligned block says the same and how often it says something else.  Blocks that nearly always say the same are the
wrapper's constants; the slots between them that vary are content.  Every page is then aligned once more, its constants and
the blocks of roles that are never the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) go, and what stays inside the article is the text, in page order.  The article is all outermost article and main elements, or
the whole page where less than half of the text is in them.  Headers inside them are the article's own.

A page whose article differs from the pivot in less than ``1 - COPY`` of its text is a copy, not evidence for a wrapper: a host that repeats one
article keeps it.  Constants go block by block, unless nothing else would be left of a page.

Pages with the same set of structural tags and first class names are one template; those of templates with too few pages for evidence go with the
host's most frequent one.  The pivot of each is the page with the least hash of those that have text.  Counts combine before they are shuffled, so a host with a third of
all pages costs each task one row per pivot block.  Pivots are broadcast while they measure at most 16 MB, so pages need not move; beyond
that pages and pivots meet by a shuffle on the host, whose large partitions Spark splits.

Defined cases: null and empty html give an empty text; a null url is a host of its own; hosts of few pages have no wrapper, and roles
alone decide; broken markup is closed where an enclosing element ends; repeated rows are extracted each; other columns
than ``page_id, url, html`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import aside, broadcast_if_small, table

CONSTANT = 0.9
EVIDENCE = 3
COPY = 0.95
#: Trees are not aligned further down than this.
DEEPEST = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend option".split())
DROPPED = frozenset(
    "head script style noscript template iframe svg math canvas object nav aside footer form button select textarea dialog menu title input".split())
#: An element that starts closes an open one of these, as far as the nearest of the barriers.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = frozenset("ul ol dl table div article section main body td th nav aside footer header form select".split())
NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|notice|cookie|cookies|consent|banner|ad|ads|advert|adverts|"
    r"advertisement|advertising|sponsor|sponsored|promo|promotion|comment|comments|commentlist|respond|disqus|social|share|sharing|breadcrumb|breadcrumbs|"
    r"subscribe|newsletter|signup|login|search|related|recommended|popup|modal|overlay|widget|toolbar|pagination|pager|disclaimer|alert|complementary|"
    r"contentinfo|doubleclick)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?<![^\s_-])(?:header|masthead)(?![^\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Structural tags, and first class names without digits, of a template.
PARTS = r"(?i)<(article|main|section|nav|header|footer|aside|table|form|h1|ul|ol|div)[\s>]"
NAMES = r"""(?i)<(?:article|main|section|div)\s[^>]*?\bclass\s*=\s*["']?\s*([a-z_-]+)"""
HAS_TEXT = r"(?is)^(?:\s|<[^>]*>)*+[^<\s]"
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")


class Node:
    """An element, or a run of text (``tag`` empty) inside its nearest block element."""

    __slots__ = ("tag", "children", "text", "dropped", "size")

    def __init__(self, tag: str, text: str = "", dropped: bool = False):
        self.tag, self.children, self.text, self.dropped, self.size = tag, [], text, dropped, 1


def _dropped(tag: str, markup: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "article", "main") or "=" not in markup and "hidden" not in markup:
        return False
    for name, *values in ATTRIBUTE.findall(markup[len(tag) + 1:]):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id", "role") and NOT_CONTENT.search(HEADER.sub("-", value) if in_article else value):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(source: str) -> Node:
    """Tree of block elements; inline markup only adds its text to the block around it."""
    root = Node("#")
    stack, held = [root], []

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1].children.append(Node("", text))

    at, end = 0, len(source)
    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        held.append(source[at:m.start()])
        at = m.end()
        markup = m[0]
        if markup[1] in "!?":
            continue
        name = TAG.match(markup)[1].lower()
        closing = markup[1] == "/"
        if not closing and name in RAW_TEXT:  # its text is not markup
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if name == "br":
            held.append(" ")
            continue
        block = name in BLOCKS or name in DROPPED
        if not block:
            if not closing and name not in VOID and _dropped(name, markup, any(x.tag in ("article", "main") for x in stack)):
                block = True  # an inline element that is hidden or an advert
            elif closing and any(x.tag == name for x in stack[1:]):
                block = True
            else:
                continue
        flush()
        if name in VOID:
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth:]
                    break
                if name == "p" and stack[depth].tag in BARRIERS:
                    break
            continue
        if stack[-1].tag == "p" and name in BLOCKS:
            stack.pop()
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in CLOSES.get(name, ()):
                del stack[depth:]
                break
            if stack[depth].tag in BARRIERS:
                break
        in_article = any(x.tag in ("article", "main") for x in stack)
        node = Node(name, dropped=_dropped(name, markup, in_article))
        stack[-1].children.append(node)
        if not markup.endswith("/>"):
            stack.append(node)
    held.append(source[at:])
    flush()
    return root


def leaves(node: Node, dropped: bool = False) -> Iterator[tuple[Node, bool]]:
    """Text blocks in page order, with whether their role rules them out."""
    stack = [(node, dropped)]
    while stack:
        one, out = stack.pop()
        if not one.tag:
            yield one, out
        out = out or one.dropped
        stack.extend((c, out) for c in reversed(one.children))


def _sizes(node: Node) -> None:
    order, stack = [], [node]
    while stack:
        one = stack.pop()
        order.append(one)
        stack.extend(one.children)
    for one in reversed(order):
        one.size = 1 + sum(c.size for c in one.children)


def align(a: Node, b: Node, depth: int = 0) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes that match in order, and the matched text blocks."""
    if a.tag != b.tag:
        return 0, []
    if not a.tag:
        return 1, [(a, b)]
    if depth > DEEPEST or not a.children or not b.children:
        return 1, []
    one, two = a.children, b.children
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def match(i: int, j: int) -> tuple[int, list]:
        if (i, j) not in known:
            known[i, j] = align(one[i], two[j], depth + 1)
        return known[i, j]

    # children that match from either end need no table
    n, m = len(one), len(two)
    lead = 0
    while lead < min(n, m) and _same_shape(one[lead], two[lead]):
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and _same_shape(one[n - 1 - tail], two[m - 1 - tail]):
        tail += 1
    best = [[0] * (m - lead - tail + 1)]
    for i in range(lead, n - tail):
        row, last = [0], best[-1]
        for j in range(lead, m - tail):
            k = j - lead
            score = last[k] + match(i, j)[0] if one[i].tag == two[j].tag else 0
            row.append(max(score, row[-1], last[k + 1]))
        best.append(row)
    pairs = [(k, k) for k in range(lead)] + [(n - 1 - k, m - 1 - k) for k in range(tail)]
    i, j = len(best) - 1, m - lead - tail
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((lead + i, lead + j))
    total, blocks = 1, []
    for i, j in pairs:
        weight, found = match(i, j)
        total += weight
        blocks += found
    return total, blocks


def _same_shape(a: Node, b: Node, depth: int = 0) -> bool:
    """Equal tags all the way down: such subtrees match whole."""
    if a.tag != b.tag or a.size != b.size or len(a.children) != len(b.children) or depth > DEEPEST:
        return False
    return all(_same_shape(x, y, depth + 1) for x, y in zip(a.children, b.children))


def content(root: Node, fixed: set[int] = frozenset()) -> list[Node]:
    """The article's text blocks in page order, without the ``fixed`` ones unless nothing else is left."""
    tops, stack = [], [root]
    while stack:
        one = stack.pop()
        if one.tag in ("article", "main"):
            tops.append(one)
        else:
            stack.extend(c for c in reversed(one.children) if not c.dropped)
    whole = [x for x, out in leaves(root) if not out]
    inside = [x for top in tops for x, out in leaves(top) if not out]
    for going in (fixed, frozenset()):
        all_left, left = ([x for x in some if id(x) not in going] for some in (whole, inside))
        if 2 * sum(len(x.text) for x in left) >= sum(len(x.text) for x in all_left) > 0:
            return left
        if all_left:
            return all_left
    return []


def extract(source: str, pivot: str | None = None, constants: frozenset[int] = frozenset()) -> str:
    """Text of a page's article; ``constants`` are the numbers of the pivot's constant blocks."""
    root = parse(source)
    fixed = set()
    if pivot is not None and constants:
        template, numbers = _pivot(pivot)
        _sizes(root)
        fixed = {id(b) for a, b in align(template, root)[1] if numbers[id(a)] in constants and a.text == b.text}
    return "\n".join(x.text for x in content(root, fixed))


@lru_cache(64)
def _pivot(source: str) -> tuple[Node, dict[int, int]]:
    root = parse(source)
    _sizes(root)
    return root, {id(x): i for i, (x, _) in enumerate(leaves(root))}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and block of its pivot: aligned pages that say the same, and all aligned pages."""
    counts: dict[tuple, list[int]] = {}

    def told() -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], ["host", "block", "same", "pages"])

    for batch in batches:
        for host, source, pivot in zip(*(batch.column(c) for c in ("host", "html", "pivot"))):
            template, numbers = _pivot(pivot.as_py())
            root = parse(source.as_py() or "")
            _sizes(root)
            pairs = align(template, root)[1]
            same = {id(b) for a, b in pairs if a.text == b.text}
            blocks = content(root)
            if sum(len(x.text) for x in blocks if id(x) in same) >= COPY * sum(len(x.text) for x in blocks):
                continue  # a copy of the pivot
            for a, b in pairs:
                seen = counts.setdefault((host.as_py(), numbers[id(a)]), [0, 0])
                seen[0] += a.text == b.text
                seen[1] += 1
        if len(counts) > 50_000:
            yield told()
    if counts:
        yield told()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [extract(s.as_py() or "", p.as_py(), frozenset(c.as_py() or ()))
               for s, p, c in zip(*(batch.column(n) for n in ("html", "pivot", "constants")))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))
    held = pages.select("page_id", "url", "html", host.alias("host"))
    found = [F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), F.lower))) for p in (PARTS, NAMES)]
    held = held.withColumn("skeleton", F.coalesce(F.xxhash64(*found), F.lit(0).cast("long")))
    sizes = aside(held.where(F.col("html").rlike(HAS_TEXT)).groupBy("host", "skeleton").agg(
        F.min_by("html", F.xxhash64("page_id", "html")).alias("pivot"), F.count(F.lit(1)).alias("n")))
    hosts = sizes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("main"), F.sum("n").alias("all"))
    # the pivot itself is no evidence
    kept = sizes.join(hosts, "host").where((F.col("n") > EVIDENCE) | (F.col("skeleton") == F.col("main")) & (F.col("all") > EVIDENCE))
    pivots = aside(kept.select(F.concat_ws(" ", "skeleton", "host").alias("site"), "pivot"))
    template = sizes.join(hosts, "host").select(
        "host", "skeleton", F.concat_ws(" ", F.when(F.col("n") > EVIDENCE, F.col("skeleton")).otherwise(F.col("main")), "host").alias("site"))
    held = held.join(broadcast_if_small(aside(template), "site"), ["host", "skeleton"], "left")
    counted = held.join(broadcast_if_small(pivots, "pivot"), "site").select(F.col("site").alias("host"), "html", "pivot").mapInArrow(_count, "host string, block int, same long, pages long")
    counted = counted.withColumnRenamed("host", "site").groupBy("site", "block").agg(F.sum("same").alias("same"), F.sum("pages").alias("pages"))
    constant = counted.where((F.col("pages") >= EVIDENCE) & (F.col("same") >= CONSTANT * F.col("pages")))
    # at most one number per block of the pivot
    wrappers = aside(pivots.join(constant.groupBy("site").agg(F.sort_array(F.collect_list("block")).alias("constants")), "site"))
    return held.join(broadcast_if_small(wrappers, "pivot"), "site", "left").select("page_id", "url", "html", "pivot", "constants").mapInArrow(
        _texts, f"page_id {kind}, url string, text string, n_chars long")


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
