"""Text of an article stays, however often its page is copied and whatever it links to; wrappers tell it from the rest."""

import random
import time

import pytest

from sparkgauge.llm import html_extract

ARTICLE = "<html><body><div>Site name</div><article><h1>Title</h1><p>The only paragraph.</p><ul><li><a href='/s'>Source list</a></ul><figure><figcaption>Caption</figcaption></figure></article></body></html>"
PLAIN = "<html><body><h1>Title</h1><blockquote>The only quote.</blockquote></body></html>"


def wrapper(pages):
    whole = None
    for p in pages:
        tree = html_extract.fold(html_extract.parse(p))
        whole = html_extract.merged(whole, tree) if whole else tree
    return whole


def texts(pages):
    with html_extract.deep():
        regions = html_extract.mark_regions(html_extract.unflat(html_extract.flat(wrapper(pages))))
        return [html_extract.extract(p, regions) for p in pages]


@pytest.mark.parametrize("copies", [1, 4, 5, 9])
def test_copies_keep_their_text(copies):
    assert set(texts([ARTICLE] * copies)) == {"Title\nThe only paragraph.\nSource list\nCaption"}
    assert set(texts([PLAIN] * copies)) == {"Title\nThe only quote."}


def test_template_outside_the_article_goes():
    pages = [f"<html><body><div>Same words</div><h1>T {i}</h1><blockquote>Own {i}</blockquote></body></html>" for i in range(6)]
    assert texts(pages)[2] == "T 2\nOwn 2"


def nameless(n, seed=1):
    """Pages of one host whose elements bear no telling names, and their main texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(900)]

    def line(k):
        return " ".join(r.choices(words, k=k)) + "."

    out = []
    for i in range(n):
        body = [line(r.randint(15, 40)) for _ in range(r.randint(2, 7))]
        quote = [line(9)] if i % 3 == 0 else []
        hint = "<div class='x7'>All of our pages are written by hand and with great care</div>" if i % 2 else ""
        links = "".join(f"<div><a href='/{r.random()}'>{line(6)}</a></div>" for _ in range(r.randint(2, 5)))
        marks = "".join(f"<p>{t}</p>" for t in body) + "".join(f"<blockquote>{t}</blockquote>" for t in quote)
        out.append((f"<html><body><div class='a'><div>The Hill Post</div><div>News from the hills since 1900</div></div><div class='b'><div class='c'><h1>Story {i}</h1>{hint}{marks}<div class='e'>Written and printed in the hills</div></div><div class='d'>{links}</div></div></body></html>", "\n".join([f"Story {i}", *body, *quote])))
    return out


def test_only_the_wrapper_tells_text_from_the_rest(monkeypatch):
    pages = nameless(40)
    assert texts([p for p, _ in pages]) == [t for _, t in pages]
    alone = [texts([p])[0] for p, _ in pages]  # the trivial wrapper of each page by itself knows no fixed text
    assert sum(a == t for a, (_, t) in zip(alone, pages)) < len(pages) / 4
    monkeypatch.setattr(html_extract, "mark_regions", lambda w: ["#root", 2, []])
    assert not any(a == t for a, (_, t) in zip(texts([p for p, _ in pages]), pages))


def test_hot_host_is_spread(spark, monkeypatch):
    """Partial wrappers of many partitions, handed on early, give the same texts."""
    monkeypatch.setattr(html_extract, "HELD_NODES", 60)
    monkeypatch.setattr(html_extract, "TOGETHER", 2)
    pages = nameless(60, 4)
    rows = [(i, f"http://{'hot' if i % 10 else 'cold'}.example/{i}", p) for i, (p, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert sum(got[i] == t for i, (_, t) in enumerate(pages)) >= 54 and all(got[i] == t for i, (_, t) in enumerate(pages) if i % 10)


@pytest.mark.parametrize("depth", [0, 10, 160, 3000])
def test_depth_changes_nothing(depth):
    page = "<div>" * depth + "<div class='menu'>MENU</div><p>one</p><p>two</p>" + "</div>" * depth
    assert texts([page]) == ["one\ntwo"]


HOSTILE = ["<b x=", '<b x="', "<b x='a' y=\"", "<div>", "<p><b>", "<li>", "<table><tr><td>", "<!", "<!--", "<script", "<script>x</script", "</", "<", "&#", "<ul><li><ul>", "<option>", "</p>", "<a b=c>x"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_seconds(piece):
    page = "<p>before</p>" + piece * (1_000_000 // len(piece)) + "after"
    began = time.process_time()
    assert texts([page])[0].startswith("before") and time.process_time() - began < 40


def test_unlike_siblings_take_seconds():
    pages = [f"<div>{''.join(f'<div class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + (i * k) % 26)}>t{i}</div>' for i in range(5000))}</div>" for k in (1, 3, 7)]
    began = time.process_time()
    assert all(t.count("\n") == 4999 for t in texts(pages)) and time.process_time() - began < 20


def test_mismatches_become_optional_and_repeated():
    one, two = "<ul><li>a</ul><p>x</p>", "<ul><li>b<li>c</ul><h2>z</h2><p>y</p>"
    assert html_extract.expression(wrapper([one, two])) == "<#root><ul>(<li>#text</li>)+</ul>(<h2>#fixed</h2>)?<p>#text</p></#root>"
    assert texts(["<p>a<b x=", "x"]) == ["a\n<b x=", "x"] or texts(["<p>a<b x="]) == ["a<b x="]


PARTS = {
    "layout classes": ("<div class='content right-sidebar'><h1>Title {i}</h1><p>First words {i} of the text.</p><p>More of it.</p></div>", "Title {i}\nFirst words {i} of the text.\nMore of it."),
    "state classes": ("<div class='site-content has-comments'><h1>Title {i}</h1><p>First words {i} of the text.</p></div>", "Title {i}\nFirst words {i} of the text."),
    "inline name": ("<article><h1>Title {i}</h1><p>The price was <span class='share-price'>12 dollars</span> today {i}.</p></article>", "Title {i}\nThe price was 12 dollars today {i}."),
    "inline furniture word in a sentence": ("<article><h1>Title {i}</h1><p>See <a class='related' href='/x'>the other story</a> of {i}.</p></article>", "Title {i}\nSee the other story of {i}."),
    "compound": ("<article><h1>Title {i}</h1><section class='form-of-government'><p>A republic {i}.</p></section><div class='promotion-history'><p>Promoted twice.</p></div></article>", "Title {i}\nA republic {i}.\nPromoted twice."),
    "references": ("<div><div><h1>Title {i}</h1><p>First words {i} of a text that is long enough to be one.</p><ol><li><a href='/{i}'>Some author, a book {i}</a></li><li><a href='/2'>Another, a paper</a></li></ol></div></div>", "Title {i}\nFirst words {i} of a text that is long enough to be one.\nSome author, a book {i}\nAnother, a paper"),
    "article with states": ("<article class='post has-comments no-sidebar'><h1>Title {i}</h1><p>Words {i}.</p></article>", "Title {i}\nWords {i}."),
    "article's header": ("<div class='entry'><div class='entry-header'><h1>Title {i}</h1></div><p>Words {i} of the entry, and so on.</p><div class='entry-footer'>Filed under news</div></div>", "Title {i}\nWords {i} of the entry, and so on."),
    "title inside": ("<div class='sidebar-left'><main><h1>Title {i}</h1><p>Words {i}.</p></main><div class='sidebar'>Elsewhere</div></div>", "Title {i}\nWords {i}."),
    "furniture by compound": ("<article><h1>Title {i}</h1><p>Words {i}.</p><div class='share-buttons'>Share this</div><div class='box related-posts'>Others</div><div id='comments-list' class='clearfix'>I agree {i}</div><section class='widget_area'>Widget</section><div class='cookie-notice large'>We use cookies</div></article>", "Title {i}\nWords {i}."),
    "inline apart from text": ("<article><h1>Title {i}</h1><div><span class='ad'>Buy now</span></div><p>Words {i}.</p></article>", "Title {i}\nWords {i}."),
    "text named by its id": ("<div id='content' class='sidebar'><h1>Title {i}</h1><p>Words {i} of the text, and so on.</p></div>", "Title {i}\nWords {i} of the text, and so on."),
}


@pytest.mark.parametrize("name", PARTS)
@pytest.mark.parametrize("n", [1, 6])
def test_names_mislead(name, n):
    """Hand-labelled pages: only what stands for the whole element, and leads its names, tells furniture."""
    part, text = PARTS[name]
    pages = [f"<html><body><div class='menu'><a href='/'>Home</a><a href='/about'>About</a></div>{part.format(i=i)}<div class='footer'>All rights reserved</div></body></html>" for i in range(n)]
    assert texts(pages) == [text.format(i=i) for i in range(n)]


def brute_pairs(a, b):
    """The rule of ``pairs`` with scans in place of tables of places."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = (side.index(x, start) - start if x in side[start:] else None for side, x, start in ((b, a[i], j), (a, b[j], i)))
        if in_b is not None and (in_a is None or in_b <= in_a):
            j += in_b
        elif in_a is not None:
            i += in_a
        else:
            i, j = i + 1, j + 1
    return out


def test_alignment_is_the_brute_force():
    r = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(r.choices("abcd"[: r.randint(1, 4)], k=r.randint(0, 9))) for _ in range(2))
        leaves = [[[c, 0, [1], 0, 0, 0, []] for c in x] for x in (a, b)]
        got = html_extract.pairs(*leaves)
        assert got == brute_pairs(a, b)
        optional = [n for n in html_extract.align(*leaves) if not n[html_extract.FLAGS] & html_extract.REPEATED]
        assert len(optional) <= len(a) + len(b) - len(got)


@pytest.mark.parametrize("together", [2, 3, 32])
def test_levels_of_alignment(spark, monkeypatch, together):
    """However many partials an alignment takes at once, every page of a host counts."""
    monkeypatch.setattr(html_extract, "TOGETHER", together)
    pages = nameless(40, 2)
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string").repartition(11)
    (row,) = html_extract.wrappers(df).collect()
    assert row.host == "h.example" and html_extract.unflat(row.wrapper)[html_extract.CHARS] == wrapper([p for p, _ in pages])[html_extract.CHARS]
    assert sum(k[html_extract.CHARS] for k in flat_nodes(html_extract.unflat(row.wrapper))) == sum(k[html_extract.CHARS] for k in flat_nodes(wrapper([p for p, _ in pages])))


def flat_nodes(node):
    return [node, *(x for k in node[html_extract.KIDS] for x in flat_nodes(k))]
