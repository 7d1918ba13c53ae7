"""Main text of web pages by wrapper induction over pages of one host.

Each page is parsed into a tree of containers (elements that hold blocks), every container with a checksum of its text. A host's
pages are told apart by layout (the kinds of their top containers); layouts of fewer than ``LEAST_PAGES`` pages use a wrapper of
the whole host. One page of a layout, chosen by hash, is the pivot; all other pages are aligned with it by simple tree matching, and for each
pivot node the pages that carry each text there are counted. A node of the same text in at least ``CONSTANT`` of the distinct
pages (and at least ``LEAST_PAGES`` of them) is template with that text; nodes of other text are slots, also where they are aligned
with it. A page's main text is the blocks of its slots, found by aligning the page with the wrapper again. The unit of a template is a container: a paragraph inside a varying
container is content, however often it occurs.

Slots may also vary inside menus, adverts or footers, so nodes whose tag, role, class or id names such a part are
never content, on any host. Where a page has an ``article`` or ``main`` element, only its text counts.

A host may hold any share of the pages: pages travel as narrow skeletons, joined with pivots under salted keys, and counts are
summed in each task before they are shuffled. Null html is an empty text, as is a page without content. Hosts of one page have
no template. Pages of equal text outside the parts that are never content count once in a wrapper (by checksum) and give repeated results. Broken markup is read as far as
it goes. Empty tables give no rows."""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from playbill.llm.common import add_columns, binary, by_value, map_rows, written

by_value(__name__)

CONSTANT, LEAST_PAGES = 0.9, 5
#: Article or main elements are the main text if they hold this part of it, one in MARKED, at least.
MARKED = 5
REMEMBERED = 20_000
SALTS = 32
#: Child pairs whose matching is traced in one array; more are halved first.
CELLS = 1_000_000
#: Containers below this depth get no nodes of their own; their texts stay, in the node above.
DEPTH = 150

# Fixed values of HTML: elements without content, with raw content, with implied ends, and those that break lines of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body center details dialog div fieldset footer form header html main menu nav section table ul ol dl".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What is never main text.
NEVER_TAGS = frozenset("nav header footer aside form script style noscript template button select textarea input iframe svg math dialog menu head title object canvas".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments reply replies respond disqus form search skip pagination pager".split())
#: Of these, what an article element may be called too.
REPLY_NAMES = frozenset("comment comments reply replies respond disqus related recommended sponsored promo advert advertisement".split())
LAYOUT_WORDS = frozenset("list lists section area thread wrapper wrap container box bar block blocks content inner outer main top bottom left right item items link links unit slot page site".split())
OWN_PARTS = frozenset("article post entry story content".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: For what lies behind the last end of a CDATA section: looking for another one would read the rest of the page each time.
TAG_ONLY = re.compile(TAG.pattern.replace(r"<!\[CDATA\[.*?\]\]>|", ""), re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    """An element that holds blocks. ``parts`` are its texts (with block breaks as None) and nodes in page order."""

    __slots__ = ("tag", "key", "never", "depth", "parts")

    def __init__(self, tag: str, key: str, never: bool, depth: int = 0):
        self.tag, self.key, self.never, self.depth, self.parts = tag, key, never, depth, []

    def nodes(self) -> list["Node"]:
        return [p for p in self.parts if isinstance(p, Node)]


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def names_of(found: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id, in lower case."""
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}".replace("-", "_")).replace("_", "-")
    return [[w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()] for name in names.lower().split()]


def never_named(words: list[str]) -> bool:
    """A name says what an element is by its last word, or by its first if only words of layout follow: a comment list is one of comments, a guide to search results
    is no search. The header of an article or post is part of it."""
    if not words or (words[-1] == "header" and words[0] in OWN_PARTS):
        return False
    return words[-1] in NEVER_NAMES or (words[0] in NEVER_NAMES and LAYOUT_WORDS.issuperset(words[1:]))


def never_content(tag: str, found: dict[str, str], inside: bool = False) -> bool:
    """Whether an element is never main text; ``inside`` tells that it lies in an article, whose header holds its headline."""
    if (tag in NEVER_TAGS and not (inside and tag == "header")) or "hidden" in found or found.get("role", "").lower() in NEVER_ROLES or found.get("aria-hidden") == "true":
        return True
    names = names_of(found)
    if tag in ("article", "main"):
        return any(len(words) == 1 and words[0] in REPLY_NAMES for words in names)
    return tag not in ("html", "body") and any(map(never_named, names))


_judged: dict[tuple, bool] = {}


def judged(tag: str, source: str, inside: bool) -> tuple[dict[str, str], bool]:
    """Attributes of an element and whether it is never content; elements recur, so up to REMEMBERED verdicts are kept."""
    if not source.strip(" /"):
        return {}, never_content(tag, {}, inside)
    found = attributes(source)
    key = (tag, inside, found.get("class"), found.get("id"), found.get("role"), found.get("aria-hidden"), "hidden" in found)
    if key not in _judged:
        if len(_judged) >= REMEMBERED:
            _judged.clear()
        _judged[key] = never_content(tag, found, inside)
    return found, _judged[key]


def parse(source: str) -> Node:
    """The tree of a page. End tags close up to the nearest open element of their name; blocks end open paragraphs."""
    root = Node("html", "html", False)
    open_: list[tuple[str, Node]] = [("html", root)]  # every open element, with the node that takes its text
    count: Counter = Counter()  # of them, by tag: what is not open is not looked for
    at = 0

    def close_to(i: int) -> None:
        count.subtract(tag for tag, _ in open_[max(1, i):])
        del open_[max(1, i):]
        open_[-1][1].parts.append(None)

    def text(part: str) -> None:
        if part and not (part.isspace() and not open_[-1][1].parts):
            open_[-1][1].parts.append(part)

    closing, sections = source.rfind(">"), source.rfind("]]>")
    while at <= closing and (m := (TAG if at <= sections else TAG_ONLY).search(source, at)):
        text(source[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(open_) - 1 if count[tag] else 0, 0, -1):
                if open_[i][0] == tag:
                    if tag in BLOCKS or open_[i][1] is not open_[i - 1][1]:
                        close_to(i)
                    else:
                        del open_[i]
                        count[tag] -= 1
                    break
                if tag not in BLOCKS and open_[i][0] in BLOCKS:
                    break
            continue
        if tag in BLOCKS and (count["p"] or any(count[t] for t in SAME_ENDS.get(tag, ()))):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == "p" or open_[i][0] in SAME_ENDS.get(tag, ()):
                    close_to(i)
                    break
                if open_[i][0] in CONTAINERS:
                    break
        found, never = judged(tag, m[3], count["article"] > 0)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            open_[-1][1].parts.append(None if tag == "hr" else " ")
            continue
        holder = open_[-1][1]
        if tag in BLOCKS:
            holder.parts.append(None)
        if (never and not holder.never) or (tag in CONTAINERS and holder.depth < DEPTH):
            key = " ".join([tag, *sorted(found.get("class", "").split())[:3], *([f"#{found['id']}"] if found.get("id") else [])])
            node = Node(tag, key, never, holder.depth + 1)
            holder.parts.append(node)
            holder = node
        open_.append((tag, holder))
        count[tag] += 1
    if at < len(source):
        rest = source[at:]
        text(rest[:rest.find("<")] if re.search(r"<[a-zA-Z/!?]", rest) else rest)
    return root


def blocks(node: Node, drop=lambda node: False) -> list[str]:
    """Texts of the node's blocks in page order, without the nodes that are never content and those to drop."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = " ".join(entities.unescape("".join(line)).split())
        if words:
            out.append(words)
        line.clear()

    def walk(n: Node) -> None:
        for part in n.parts:
            if part is None:
                end()
            elif isinstance(part, str):
                line.append(part)
            elif not part.never and not drop(part):
                end()
                walk(part)
                end()

    walk(node)
    end()
    return out


def articles(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, that may be content."""
    def outermost(n: Node, tag: str) -> list[Node]:
        return [f for c in n.nodes() if not c.never for f in ([c] if c.tag == tag else outermost(c, tag))]

    return outermost(root, "article") or outermost(root, "main")


# Alignment.

def skeleton(node: Node) -> list:
    """[key, checksum of the text, children] of the tree. The checksum covers the node's own lines and its children's checksums."""
    items, line, children = [], [], []

    def end() -> None:
        words = " ".join(entities.unescape("".join(line)).split())
        if words:
            items.append(words)
        line.clear()

    for part in node.parts:
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        else:
            end()
            children.append(skeleton(part))
            if children[-1][1] and not part.never:
                items.append("\0" + children[-1][1])
    end()
    return [node.key, hashlib.blake2b("\n".join(items).encode(), digest_size=8).hexdigest() if items else "", children]


class _Matcher:
    """Simple tree matching of whole trees. Children that are the only ones of their key and text on both sides are paired first, in
    order; the runs between them by a largest order-keeping matching, whose sizes depend on the shapes (keys) of subtrees alone."""

    def __init__(self):
        self.names: dict[tuple, int] = {}
        self.shape: dict[int, int] = {}
        self.size: list[int] = []
        self.below: list[tuple] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def number(self, node: list) -> int:
        key = (node[0], *(self.number(c) for c in node[2]))
        if key not in self.names:
            self.names[key] = len(self.size)
            self.size.append(1 + sum(self.size[c] for c in key[1:]))
            self.below.append(key)
        self.shape[id(node)] = self.names[key]
        return self.names[key]

    def most(self, a: int, b: int) -> int:
        """Size of the largest order-keeping matching of two shapes."""
        if a == b:
            return self.size[a]
        if self.below[a][0] != self.below[b][0]:
            return 0
        if (a, b) not in self.sizes:
            x, y = self.below[a][1:], self.below[b][1:]
            self.sizes[a, b] = 1 + (int(self.rows(x, y)[-1][-1]) if x and y else 0)
        return self.sizes[a, b]

    def rows(self, x, y, every: bool = False) -> list[np.ndarray]:
        """The last row of the matching's table, or all rows."""
        kinds = {k: i for i, k in enumerate(dict.fromkeys(y))}
        column = np.array([kinds[k] for k in y])
        weights, out, last = {}, [], np.zeros(len(y) + 1, np.int32)
        if every:
            out.append(last)
        for k in x:
            if k not in weights:
                weights[k] = np.array([self.most(k, other) for other in kinds], np.int32)[column]
            row = last.copy()
            row[1:] = np.maximum(last[1:], last[:-1] + weights[k])
            last = np.maximum.accumulate(row)
            if every:
                out.append(last)
        return out if every else [last]

    def traced(self, x: list, y: list) -> list[tuple[int, int]]:
        """Positions that are paired in a largest matching of two runs of shapes."""
        if not x or not y:
            return []
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            ahead, behind = self.rows(x[:half], y)[0], self.rows(x[:half - 1:-1], y[::-1])[0][::-1]
            cut = int(np.argmax(ahead + behind))
            return self.traced(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in self.traced(x[half:], y[cut:])]
        best, out, i, j = self.rows(x, y, True), [], len(x), len(y)
        while i and j:
            got = self.most(x[i - 1], y[j - 1])
            if got and best[i][j] == best[i - 1][j - 1] + got:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def pairs(self, a: list, b: list) -> list[tuple[list, list]]:
        found, waiting = [], [(a, b)]
        while waiting:
            a, b = waiting.pop()
            found.append((a, b))
            at = done = 0
            for i, j in [*self.anchors(a[2], b[2]), (len(a[2]), len(b[2]))]:
                x, y = a[2][at:i], b[2][done:j]
                waiting += [(x[m], y[n]) for m, n in self.traced([self.shape[id(c)] for c in x], [self.shape[id(c)] for c in y])]
                if i < len(a[2]):
                    waiting.append((a[2][i], b[2][j]))
                at, done = i + 1, j + 1
        return found

    @staticmethod
    def anchors(x: list, y: list) -> list[tuple[int, int]]:
        """Longest increasing run of children that have one key and text on both sides, once each."""
        mine, theirs = (Counter((c[0], c[1]) for c in side if c[1]) for side in (x, y))
        place = {(c[0], c[1]): j for j, c in enumerate(y) if theirs[c[0], c[1]] == 1}
        both = [(i, place[c[0], c[1]]) for i, c in enumerate(x) if c[1] and mine[c[0], c[1]] == 1 and (c[0], c[1]) in place]
        ends, at, before = [], [], []
        for n, (_, j) in enumerate(both):
            k = bisect.bisect_left(ends, j)
            ends[k:k + 1], at[k:k + 1] = [j], [n]
            before.append(at[k - 1] if k else None)
        out, n = [], at[-1] if at else None
        while n is not None:
            out.append(both[n])
            n = before[n]
        return out[::-1]


def matching(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Matching of two trees that keeps order and parents: its size and its node pairs."""
    if a[0] != b[0]:
        return 0, []
    matcher = _Matcher()
    matcher.number(a)
    matcher.number(b)
    found = matcher.pairs(a, b)
    return len(found), found


def numbered(tree: list) -> dict[int, int]:
    """Level-order numbers by identity of the skeleton's nodes."""
    order, queue = {}, [tree]
    for node in queue:
        order[id(node)] = len(order)
        queue += node[2]
    return order


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def layout_of(tree: list) -> str:
    """Checksum of the kinds of a page's top containers: their tags and classes without digits, each once, below html and body."""
    tops = [tree]
    while len(tops) == 1 and tops[0][0].split(" ")[0] in ("html", "body") and tops[0][2]:
        tops = next(([c] for c in tops[0][2] if c[0].split(" ")[0] in ("html", "body")), tops[0][2])
    kinds = {" ".join(w for w in t[0].split(" ") if w[:1] != "#" and not re.search(r"\d", w)) for t in tops}
    return hashlib.blake2b("\n".join(sorted(kinds)).encode(), digest_size=8).hexdigest()


def induced(pages: DataFrame) -> DataFrame:
    """(host, layout, pivot, template): a pivot's skeleton and its template nodes as numbers with the checksum of their text, of the
    layout if it has at least LEAST_PAGES pages, else of the whole host. Layouts without template have no row."""
    def skeletons(batch):
        trees = [skeleton(parse(t.decode())) for t in binary(batch, "html")]
        return [[layout_of(t) for t in trees], [t[1] for t in trees], [json.dumps(t, separators=(",", ":")) for t in trees]]

    made = add_columns(pages.select(host_of(F.col("url")).alias("host"), "html"), "layout string, body string, tree string", skeletons)
    # Pages of one layout and one text outside the parts that are never content are one page for the wrapper.
    narrow = written(made.groupBy("host", "layout", "body").agg(F.min("tree").alias("tree")).withColumn("page", F.xxhash64("host", "tree")), "skeletons")
    chosen = (F.count(F.lit(1)).alias("pages"), F.min_by("tree", "page").alias("pivot"))
    layouts = narrow.groupBy("host", "layout").agg(*chosen)
    large, small = layouts.where(F.col("pages") >= LEAST_PAGES), layouts.where(F.col("pages") < LEAST_PAGES)
    mixed = narrow.join(small.select("host").distinct(), "host", "left_semi").withColumn("layout", F.lit(""))
    hosts = large.unionByName(mixed.groupBy("host", "layout").agg(*chosen).where(F.col("pages") >= LEAST_PAGES))
    hosts = written(hosts, "pivots")
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = narrow.unionByName(mixed).withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "layout", "salt"])

    def align(batches):
        for batch in batches:
            counts: dict[tuple, int] = {}
            pivots: dict[tuple, tuple] = {}
            for host, layout, tree, pivot in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "tree", "pivot"))):
                if (host, layout) not in pivots:
                    parsed = json.loads(pivot)
                    pivots[host, layout] = (parsed, numbered(parsed))
                against, order = pivots[host, layout]
                for mine, theirs in matching(json.loads(tree), against)[1]:
                    if mine[1] and theirs is not against:
                        spot = (host, layout, order[id(theirs)], mine[1])
                        counts[spot] = counts.get(spot, 0) + 1
            yield [*([k[i] for k in counts] for i in range(4)), list(counts.values())]

    counted = map_rows(met.select("host", "layout", "tree", "pivot"), "host string, layout string, node int, text string, n long", align)
    same = counted.groupBy("host", "layout", "node", "text").agg(F.sum("n").alias("n")).groupBy("host", "layout", "node").agg(
        F.max_by("text", "n").alias("text"), F.max("n").alias("n"))
    template = same.join(hosts.select("host", "layout", "pages"), ["host", "layout"]).where(F.col("n") >= CONSTANT * F.col("pages")).groupBy("host", "layout").agg(
        F.map_from_entries(F.collect_list(F.struct("node", "text"))).alias("template"))
    wrappers = hosts.select("host", "layout", "pivot").join(template, ["host", "layout"])
    whole = wrappers.where("layout = ''").drop("layout").join(small.select("host", "layout"), "host")
    return wrappers.where("layout <> ''").unionByName(whole)


def main_text(source: str, pivot: list | None, template: dict[int, str]) -> str:
    root = parse(source)
    drop = set()
    if pivot is not None and template:
        mine = skeleton(root)
        order = numbered(pivot)
        constant = {id(m) for m, p in matching(mine, pivot)[1] if template.get(order[id(p)]) == m[1] != ""}
        queue = [(root, mine)]
        for node, spot in queue:
            if id(spot) in constant:
                drop.add(id(node))
            queue += zip(node.nodes(), spot[2])
    dropped = lambda c: id(c) in drop
    every = blocks(root, dropped)
    marked = [b for n in articles(root) for b in blocks(n, dropped)]
    # An article or main counts if it holds a fair part of what is left; teasers do not stand for the body beside them.
    return "\n".join(marked if MARKED * sum(map(len, marked)) >= sum(map(len, every)) > 0 else every)


def extracted(pages: DataFrame) -> DataFrame:
    """The pages (page_id, url, html) with ``text``, their main text."""
    wrappers = written(induced(pages), "wrappers")

    def layouts(batch):
        return [[layout_of(skeleton(parse(t.decode()))) for t in binary(batch, "html")]]

    def run(batch):
        out = []
        for source, pivot, template in zip(binary(batch, "html"), batch.column("_pivot").to_pylist(), batch.column("_template").to_pylist()):
            out.append(main_text(source.decode(), json.loads(pivot) if pivot and template else None, dict(template or ())))
        return [out]

    found = wrappers.select(F.col("host").alias("_host"), F.col("layout").alias("_of"), F.col("pivot").alias("_pivot"), F.col("template").alias("_template"))
    rows = add_columns(pages, "_layout string", layouts)
    rows = rows.join(found, (host_of(rows["url"]) == found["_host"]) & (rows["_layout"] == found["_of"]), "left")
    return add_columns(rows, "text string", run).drop("_host", "_of", "_layout", "_pivot", "_template")


def digest(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
