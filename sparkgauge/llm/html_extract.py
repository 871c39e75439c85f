"""Main text of web pages by union-free wrappers, one inferred for each host.

Pages become nested streams of tags and text slots.  Runs of like siblings fold into repeated
groups.  The streams of a host's pages are aligned one after the other: where two mismatch, the
nearer of the two places at which they match again decides what was skipped, and that becomes
an optional group, or one more round of a repeated one.  The outcome is an expression of tags,
text slots, ``(...)?`` and ``(...)+`` without unions, in which each node also counts its
pages, its characters and whether its text ever changed.  Each task infers partial wrappers,
and those of a host are aligned in levels, so that no task has more than some of them at once,
however many partitions a host is in.  Nodes that are template (by name, by links, or by text that never changes) are
left out; the main region is the node that holds most of the remaining text.

Work is linear in a page however deep it nests and however broken its markup is: a tag that
never ends is text, and behind one whose quotes never end tags end at the first ``>``.

Defined results: a null or empty page, or one without tags or text, gives an empty text
or its plain text; a url without a host shares the wrapper of the empty host; repeated
ids give rows of their own; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, tidy

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
LEFT_OUT_TAGS = frozenset("head nav header footer aside form button select script style noscript template iframe textarea title svg canvas object audio video dialog menu".split())
#: Words that name menus, headers, footers, sidebars, notices, adverts, forms and comments in a class, an id or a role.
FURNITURE = frozenset(
    "menu menubar nav navbar navigation breadcrumb breadcrumbs pagination toolbar skip tabs header masthead topbar footer colophon legal copyright sidebar aside complementary widget widgets related recommended recommendations trending teaser notice notices alert announcement cookie cookies consent gdpr disclaimer paywall popup modal newsletter subscribe subscription signup ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion form search login comment comments discussion disqus replies reply respond share sharing social".split()
)
OPENING = re.compile(r"</?[a-zA-Z][^\s/>]*|<!--|<[!?]")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Words that only place or size what the others name, and the beginnings of names of states.
PLACING = frozenset("area bar block box bottom btn button buttons clearfix col column container first fixed flex fluid global grid group holder inner item items large last left lg link links list main md mini nofollow outer page panel posts primary region right row secondary section side site sm slot small space sub top unit wide wrap wrapper xl xs zone".split())
STATES = frozenset("has is js no not with without".split())
#: Words that name the text itself; beside these, a header is that of the article.
OF_THE_ARTICLE = frozenset("article content entry post story".split())
TEXT_WORDS = OF_THE_ARTICLE | frozenset("body text".split())
HEADERS = frozenset("header masthead topbar".split())
#: Distinct pages on which a text outside article and main must be the same to be taken for the template's.
SAME_ON = 5
#: The same for articles, of which a page's own may bear the other words.
NOT_THE_ARTICLE = frozenset("ad ads advert comment comments promo related replies reply sponsored teaser".split())
PLAIN = ("div", "span", "section", "table", "body", "html", "#root")


#: Characters of all wrappers that go to every executor; more are joined by exchange.
BROADCAST_CHARS = 16_000_000
#: Nodes of the partial wrappers that a task holds before it hands them on.
HELD_NODES = 200_000
#: Partitions whose partial wrappers of a host are aligned in one group.
TOGETHER = 32


class Node:
    """An element: its label, its children (elements and strings), and after folding its place in a wrapper."""

    __slots__ = ("label", "kids")

    def __init__(self, label: str):
        self.label, self.kids = label, []


def words_in(name: str) -> list[str]:
    """The words of a name, without digits, as they number things, and without what varies it."""
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name.partition("--")[0]).lower()) if w]


def furniture_by(names: list[str]) -> str:
    """What the names in one attribute say of an element: ``~`` furniture, ``~header`` a header, ``text`` the text itself, else nothing.

    The first that says anything decides, as what follows it varies it.  A name is that of
    furniture if each of its words names furniture, text or a place; another word makes it
    that of something else, whatever the rest.
    """
    for name in names:
        words = words_in(name)
        telling = [w for w in words if w not in PLACING]
        if not telling or words[0] in STATES:
            continue
        furniture = [w for w in telling if w in FURNITURE]
        if not furniture or not all(w in FURNITURE or w in TEXT_WORDS for w in telling):
            return "text" if not TEXT_WORDS.isdisjoint(telling) else "other"
        if HEADERS.issuperset(furniture):
            return "text" if len(telling) > len(furniture) else "~header"
        return "~"
    return ""


def label_of(tag: str, attributes: str) -> str:
    """Tag, the words of the naming attributes in order, and what these say."""
    found = ATTRIBUTE.findall(attributes) if attributes else ()
    return named_label(tag, tuple(found)) if found else tag


@lru_cache(20_000)
def named_label(tag: str, attributes: tuple[tuple[str, ...], ...]) -> str:
    """The same of an element with naming attributes, each with its value in one of three forms."""
    found = {a.lower(): (x or y or z).split() for a, x, y, z in reversed(attributes)}
    said = {a: furniture_by(found.get(a, [])) for a in ("role", "class", "id")}
    says = next((said[a] for a in ("role", "class", "id") if said[a].startswith("~")), "")
    if "text" in said.values():
        says = ""
    return ".".join([tag, *sorted({w for names in found.values() for name in names for w in words_in(name)}), *([says] if says else [])])


@lru_cache(20_000)
def left_out(label: str, in_article: bool = False) -> bool:
    """Whether a label names page furniture; within an article a header holds its title."""
    tag, *names = label.split(".")
    if tag in ("html", "body", "main"):
        return False
    says = names[-1] if names and names[-1].startswith("~") else ""
    if tag == "article":
        return bool(says) and not NOT_THE_ARTICLE.isdisjoint(names)
    header = tag == "header" or says == "~header"
    return tag in LEFT_OUT_TAGS - {"header"} or says == "~" or header and not in_article and OF_THE_ARTICLE.isdisjoint(names)


@contextmanager
def deep() -> Iterator[None]:
    """Recursion as deep as pages nest; from Python 3.11 on its frames are not on the C stack."""
    known = sys.getrecursionlimit()
    sys.setrecursionlimit(50_000_000)
    try:
        yield
    finally:
        sys.setrecursionlimit(known)


def end_of_tag(page: str, at: int) -> int:
    """Behind the ``>`` that ends the tag whose attributes begin here, outside of quotes; -1 without one."""
    while m := QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    return -1


def tags_of(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of tags in order, with ``/`` before the name of end tags; comments and declarations have no name.

    The caller may send the place from which to go on.
    """
    at, loose = 0, False
    while m := OPENING.search(page, at):
        start = m.start()
        if m[0] == "<!--":
            end = page.find("-->", m.end()) + 3
            sent = yield start, end if end > 2 else len(page), "", ""
            at = sent or (end if end > 2 else len(page))
            continue
        end = -1 if loose or m[0] in ("<!", "<?") else end_of_tag(page, m.end())
        if end < 0:
            loose = loose or m[0] not in ("<!", "<?")
            end = page.find(">", m.end()) + 1
            if not end:
                return  # nothing that follows can be a tag
        name = "" if m[0] in ("<!", "<?") else m[0][1:].lower()
        at = (yield start, end, name, page[m.end() : end - 1]) or end


def parse(page: str) -> Node:
    """A tree of the page; unclosed elements end with their parent, stray end tags are skipped."""
    root = Node("#root")
    stack, tags, at = [root], ["#root"], 0
    count = Counter(tags)

    def close(keep: int) -> None:
        count.subtract(tags[keep:])
        del stack[keep:], tags[keep:]

    found, go_on = tags_of(page), None
    while True:
        try:
            start, end, name, attributes = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            stack[-1].kids.append(page[at:start])
        at = end
        if not name:
            continue
        if name[0] == "/":
            if count[name[1:]]:
                keep = len(tags) - 1
                while tags[keep] != name[1:]:
                    keep -= 1
                close(keep)
            continue
        if name in CLOSES_P and count["p"]:
            last = len(tags) - 1
            while tags[last] in INLINE:
                last -= 1
            if tags[last] == "p":
                close(last)
        if name in SAME_CLOSES and count[name]:
            last = len(tags) - 1
            while tags[last] != name and tags[last] not in SAME_CLOSES[name]:
                last -= 1
            if tags[last] == name:
                close(last)
        node = Node(label_of(name, attributes))
        stack[-1].kids.append(node)
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(page, at)
            at = (page.find(">", over.end()) + 1 if over else 0) or len(page)
            go_on = at
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            tags.append(name)
            count[name] += 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


# A wrapper node is a list: label, flags (1 optional, 2 repeated), digests of up to SAME_ON distinct pages, characters of text,
# of which in links, checksum of its text (-1 once it has changed), children.
LABEL, FLAGS, PAGES, CHARS, LINKS, TEXT, KIDS = range(7)
OPTIONAL, REPEATED = 1, 2


def with_text(node: Node) -> bool:
    """Whether the element has text of its own."""
    return any(isinstance(k, str) and not k.isspace() for k in node.kids)


def flows(label: str, in_text: bool) -> bool:
    """Whether an element is part of its block's text: inline ones are, unless one stands apart from text and is named as furniture."""
    return label.partition(".")[0] in INLINE and (in_text or not left_out(label))


def digest(node: Node) -> int:
    """A checksum of the labels and texts of a page's tree."""
    out, left = 0, [node]
    while left:
        n = left.pop()
        out = zlib.crc32(f"\x00{n if isinstance(n, str) else n.label}".encode("utf-8", "replace"), out)
        if not isinstance(n, str):
            left.append("\x01")
            left.extend(n.kids)
    return out


def fold(node: Node, in_link: bool = False, page: int | None = None) -> list:
    """The tree of one page as a wrapper; inline elements are part of the text of their block."""
    page = digest(node) if page is None else page
    own, link, kids = [], 0, []

    def read(n: Node, linked: bool, in_text: bool) -> None:
        nonlocal link
        in_text = in_text or with_text(n)
        for k in n.kids:
            if isinstance(k, str):
                words = " ".join(html.unescape(k).split())
                own.append(words)
                link += len(words) * linked
            elif flows(k.label, in_text):
                read(k, linked or k.label.partition(".")[0] == "a", in_text)
            else:
                kids.append(fold(k, linked, page))

    read(node, in_link, False)
    text = " ".join(w for w in own if w)
    return [node.label, 0, [page], len(text), link, zlib.crc32(text.encode("utf-8", "replace")) if text else 0, repeated(kids)]


def like(a: list, b: list) -> bool:
    """Whether siblings count as the same: by label, and for plain containers by what they hold as well."""
    return a[LABEL] == b[LABEL] and (a[LABEL] not in PLAIN or [k[LABEL] for k in a[KIDS]] == [k[LABEL] for k in b[KIDS]])


def repeated(kids: list[list]) -> list[list]:
    """Tandem runs of one to three siblings fold into one repeated group."""
    out: list[list] = []
    for kid in kids:
        out.append(kid)
        for k in (1, 2, 3):
            while len(out) >= 2 * k and all(like(a, b) for a, b in zip(out[-2 * k : -k], out[-k:])):
                group = [merged(a, b, False) for a, b in zip(out[-2 * k : -k], out[-k:])]
                for g in group:
                    g[FLAGS] |= REPEATED
                out[-2 * k :] = group
    return out


def merged(a: list, b: list, pages: bool = True) -> list:
    """Two nodes as one; ``pages`` tells that they come from different pages."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else -1
    seen = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:SAME_ON]
    return [a[LABEL], a[FLAGS] | b[FLAGS], seen, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], text, align(a[KIDS], b[KIDS], pages)]


def pairs(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Which siblings of both sides match, in order.

    At a mismatch either side may have more than the other: whichever finds its match sooner
    on the other side is the one that goes on, and what it passes there is skipped.
    """
    if len(a) == len(b) and all(x[LABEL] == y[LABEL] for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    where: list[dict[str, list[int]]] = [{}, {}]
    for places, side in zip(where, (a, b)):
        for i, node in enumerate(side):
            places.setdefault(node[LABEL], []).append(i)

    def ahead(places: dict[str, list[int]], label: str, start: int) -> float:
        found = places.get(label, ())
        k = bisect_left(found, start)
        return found[k] - start if k < len(found) else float("inf")

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][LABEL] == b[j][LABEL]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = ahead(where[1], a[i][LABEL], j), ahead(where[0], b[j][LABEL], i)
        if in_b <= in_a and in_b < float("inf"):
            j += int(in_b)
        elif in_a < float("inf"):
            i += int(in_a)
        else:
            i, j = i + 1, j + 1
    return out


def align(a: list[list], b: list[list], pages: bool = True) -> list[list]:
    """Siblings of both sides in order; a mismatch makes an optional group, which may fold with its neighbours."""
    out, i, j = [], 0, 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        for skipped in (a[i:x], b[j:y]):
            for node in skipped:
                out.append([node[LABEL], node[FLAGS] | OPTIONAL, *node[PAGES:]])
        if x < len(a):
            out.append(merged(a[x], b[y], pages))
        i, j = x + 1, y + 1
    return repeated(out) if len(out) > max(len(a), len(b)) else out


def expression(node: list) -> str:
    """The wrapper as text: tags, ``#text`` slots (fixed text in quotes is not kept), ``(...)?`` and ``(...)+``."""
    slot = "" if not node[CHARS] else "#text" if node[TEXT] == -1 else "#fixed"
    body = f"<{node[LABEL]}>{slot}{''.join([expression(k) for k in node[KIDS]])}</{node[LABEL].partition('.')[0]}>"
    mark = {0: "", OPTIONAL: "?", REPEATED: "+", 3: "*"}[node[FLAGS]]
    return f"({body}){mark}" if mark else body


def flat(wrapper: list) -> str:
    """The wrapper as JSON that does not nest: each node with the number of its children, parents first."""
    out, left = [], [wrapper]
    while left:
        node = left.pop()
        out.append([*node[:KIDS], len(node[KIDS])])
        left.extend(reversed(node[KIDS]))
    return json.dumps(out, separators=(",", ":"))


def unflat(text: str) -> list:
    above = [[None] * KIDS + [[]]]
    missing = [1]
    for *values, kids in json.loads(text):
        node = [*values, []]
        above[-1][KIDS].append(node)
        missing[-1] -= 1
        above.append(node)
        missing.append(kids)
        while len(above) > 1 and not missing[-1]:
            above.pop(), missing.pop()
    return above[0][KIDS][0]


def size_of(wrapper: list) -> int:
    n, left = 0, [wrapper]
    while left:
        n += 1
        left.extend(left.pop()[KIDS])
    return n


def mark_regions(wrapper: list) -> list:
    """The wrapper as [label, keep, children]: keep is 0 left out, 1 path to the main region, 2 the region itself."""
    sums: dict[int, int] = {}
    totals: dict[int, tuple[int, int]] = {}

    def add_up(node: list) -> tuple[int, int]:
        chars, links = node[CHARS], node[LINKS]
        for k in node[KIDS]:
            more = add_up(k)
            chars, links = chars + more[0], links + more[1]
        totals[id(node)] = chars, links
        return chars, links

    add_up(wrapper)

    titled: set[int] = set()

    def find_titles(node: list) -> bool:
        found = node[LABEL].partition(".")[0] in ("h1", "main")
        for k in node[KIDS]:
            found |= find_titles(k)
        if found:
            titled.add(id(node))
        return found

    find_titles(wrapper)

    def named(node: list, in_article: bool) -> bool:
        """Left out by its label; a name alone does not outweigh the page's title or its main element inside."""
        return left_out(node[LABEL], in_article) and not (id(node) in titled and node[LABEL].endswith(".~") and node[LABEL].partition(".")[0] not in LEFT_OUT_TAGS)

    def template(node: list, in_article: bool, in_text: bool, in_region: bool = False) -> bool:
        if in_text or named(node, in_article):
            return named(node, in_article)
        all_, links = totals[id(node)]
        fixed = node[TEXT] not in (0, -1) and not node[KIDS] and len(node[PAGES]) >= SAME_ON and not re.match(r"h[1-6]\b", node[LABEL])
        return fixed or not in_region and all_ > 0 and links > 0.8 * all_ and not node[LABEL].startswith(("article", "main", "body", "html", "#root", "p"))

    def mass(node: list, strict: bool, in_article: bool = False, in_text: bool = False) -> int:
        tag = node[LABEL].partition(".")[0]
        in_article, in_text = in_article or tag == "article", in_text or tag in ("article", "main")
        if template(node, in_article, in_text) if strict else named(node, in_article):
            sums[id(node)] = 0
        else:
            found = node[CHARS] - node[LINKS] // 2
            for k in node[KIDS]:
                found += mass(k, strict, in_article, in_text)
            sums[id(node)] = found
        return sums[id(node)]

    strict = mass(wrapper, True) > 0
    if not strict:
        mass(wrapper, False)
    region = find_region(wrapper, sums)

    begun = False  # the region's text; links before it are a menu, behind it they are the text's

    def marked(node: list, inside: bool, in_article: bool, in_text: bool) -> list:
        nonlocal begun
        tag = node[LABEL].partition(".")[0]
        inside, in_article, in_text = inside or node is region, in_article or tag == "article", in_text or tag in ("article", "main")
        out = not sums.get(id(node)) and (template(node, in_article, in_text, inside and begun) if strict else named(node, in_article))
        begun = begun or inside and not out and node[CHARS] > node[LINKS] and not re.match(r"h[1-6]\b", node[LABEL])
        return [node[LABEL], 0 if out else 2 if inside else 1, [] if out else [marked(k, inside, in_article, in_text) for k in node[KIDS]]]

    return marked(wrapper, False, False, False)


def find_region(wrapper: list, sums: dict[int, int]) -> list:
    """An article or main element with half of the text, else the deepest container with most of its parent's."""
    named, node = [], wrapper

    def walk(n: list) -> None:
        for k in n[KIDS]:
            if sums.get(id(k)):
                if k[LABEL].partition(".")[0] in ("article", "main"):
                    named.append(k)
                walk(k)

    walk(wrapper)
    for tag in ("article", "main"):
        fit = [n for n in named if n[LABEL].partition(".")[0] == tag and 2 * sums[id(n)] >= sums[id(wrapper)]]
        if fit:
            return max(fit, key=lambda n: sums[id(n)])
    while True:
        below = max((k for k in node[KIDS] if k[KIDS]), key=lambda k: sums.get(id(k), 0), default=None)
        if below is None or below[FLAGS] & REPEATED or sums.get(id(below), 0) < 0.7 * sums[id(node)]:
            return node
        node = below


def blocks(node: Node, regions: list | None, out: list[list[str]], keep: int) -> None:
    """Text of the region, a list of parts for each block, in page order."""
    names: list[Node] = []

    def listed(n: Node, in_text: bool) -> None:
        in_text = in_text or with_text(n)
        for k in n.kids:
            if not isinstance(k, str):
                if flows(k.label, in_text):
                    listed(k, in_text)
                else:
                    names.append(k)

    listed(node, False)
    place = matches(names, regions[2]) if regions else [None] * len(names)
    found = dict(zip(map(id, names), place))
    out.append([])

    def walk(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                if keep == 2:
                    out[-1].append(k)
            elif id(k) not in found:
                out[-1].append(" " if k.label.partition(".")[0] in ("br", "img", "wbr") else "")
                walk(k)
            else:
                r = found[id(k)]
                state = r[1] if r else 0 if left_out(k.label) else keep
                if state:
                    blocks(k, r, out, state)
                out.append([])

    walk(node)


def matches(kids: list[Node], nodes: list[list]) -> list[list | None]:
    """The wrapper's node for each child, in order; repeated ones take several children."""
    places: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        places.setdefault(node[0], []).append(i)
    out: list[list | None] = []
    at = 0
    for kid in kids:
        found = places.get(kid.label)
        if found is None:
            out.append(None)
            continue
        k = bisect_left(found, at) % len(found)  # behind the last one, from the start
        out.append(nodes[found[k]])
        at = found[k]
        if kid.label in PLAIN and found[-1] > at:
            at += 1
    return out


def extract(page: str | None, regions: list) -> str:
    if not page:
        return ""
    root, out = parse(page), []
    blocks(root, regions, out, regions[1])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in out)
    return "\n".join(x for x in lines if x)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON, inferred from all its pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        size, part = 0, TaskContext.get().partitionId()

        def hand_on() -> pa.RecordBatch:
            columns = {"host": [*found], "part": [part] * len(found), "wrapper": [flat(w) for w in found.values()]}
            return pa.RecordBatch.from_pydict(columns, pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())]))

        with deep():
            for b in batches:
                for h, page in zip(b.column(0).to_pylist(), b.column(1)):
                    tree = fold(parse(page.as_py() or ""))
                    if h not in found:
                        size += size_of(tree)
                    found[h] = merged(found[h], tree) if h in found else tree
                    if size > HELD_NODES:
                        yield hand_on()
                        size, found = 0, {}
            if found:
                yield hand_on()

    def combine(table: pa.Table) -> pa.Table:
        with deep():
            rows = sorted(table.column("wrapper").to_pylist())
            whole = unflat(rows[0])
            for w in rows[1:]:
                whole = merged(whole, unflat(w))
            return pa.table({"host": [table.column("host")[0].as_py()], "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "wrapper": [flat(whole)]})

    rows = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(tidy(partial), "host string, part int, wrapper string")
    left = rows.rdd.getNumPartitions()
    while left:  # a level takes the wrappers of TOGETHER groups at most
        left = 0 if left <= TOGETHER else -(-left // TOGETHER)
        found = found.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("int") if left else F.lit(0))
        found = found.groupBy("host", "part").applyInArrow(combine, "host string, part int, wrapper string")
    return found.select("host", "wrapper")


@lru_cache(500)
def regions_of(wrapper: str | None) -> list:
    return mark_regions(unflat(wrapper)) if wrapper else ["#root", 2, []]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host(F.col(url_col)).alias("host"))
    known = stored(wrappers(pages, url_col, html_col), "wrappers")
    few = (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS
    # few go to the executors once, by host; else pages and wrappers meet by exchange, where Spark splits large hosts
    shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in known.collect()} if few else {})
    rows = rows.withColumn("wrapper", F.lit(None).cast("string")) if few else rows.join(known, "host", "left")

    def run(batches):
        for b in batches:
            with deep():
                wrapped = (w or shared.value.get(h) for h, w in zip(b.column(3).to_pylist(), b.column(4).to_pylist()))
                texts = [extract(page.as_py(), regions_of(w)) for page, w in zip(b.column(2), wrapped)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "wrapper").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
