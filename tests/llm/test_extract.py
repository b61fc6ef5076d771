"""Extraction on written pages, repeated runs against a brute-force search, the tables by a plain pattern."""

import html
import random
import re
import time

import pytest

from tracewell.llm import extract as E
from tracewell.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header>Site</header><nav><ul><li>Menu</ul></nav><!-- x --><div class="ad-box">Buy</div>
<main><article><header>by me</header><h1>Head&shy;line &lt;1&gt;</h1><script>var a = "</p><p>no";</script>
<p>One <b>bo</b>ld&nbsp;  word<br>next &copy 2 &#233;</p><aside>aside</aside>
<p>Two<p class="notice">cookies</p><ul><li>a<li>b</ul><form>name <input></form>
<div id="cookieNotice">ok</div><div class="comments"><article>reader</article></div>
<table><tr><td>x<td>y</table></article></main><div role="contentinfo">foot</div><footer>F</footer></body></html>"""


def test_structure():
    settled, blocks = E.page_blocks(PAGE)
    assert settled
    assert blocks == ["Head\xadline <1>", "One bold word next © 2 é", "Two", "a", "b", "x", "y"]


@pytest.mark.parametrize("source,blocks", [
    (None, []), ("", []), ("plain", ["plain"]), ("<article>cut &am", ["cut &am"]), ("<article><p>a<p>b</article>c", ["a", "b"]),
    ("<article><div class=ad>x<p>y</div>z</article>", ["z"]), ("<p>a < b</p>", ["a < b"]), ("<article><p>a</b>c</p></div>d", ["ac", "d"]),
])
def test_broken_pages(source, blocks):
    assert E.page_blocks(source)[1] == blocks


def test_repeated_runs():
    rng = random.Random(6)
    for _ in range(60):
        pages = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 5))]
        run = rng.choice([1, 2, 4, 8])
        want = []
        for i, p in enumerate(pages):
            flags = [False] * len(p)
            for s in range(len(p) - run + 1):
                if any(q[x:x + run] == p[s:s + run] for j, q in enumerate(pages) if j != i for x in range(len(q) - run + 1)):
                    flags[s:s + run] = [True] * run
            want.append(flags)
        assert [x.tolist() for x in E.repeated(pages, run)] == want


def test_hosts_without_articles(spark):
    menu = " ".join(f"m{i}" for i in range(20))
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(30))
    rows = [(i, f"https://H.example/{i}", f"<div>{menu}</div><div>{own(i)}</div>") for i in range(6)]
    rows += [(6, "https://other.example/", f"<div>{menu}</div>"), (7, None, None), (8, "https://h.example/8", f"<article>{menu}</article>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("'t' AS text", "1 AS host", "2 AS row", "*")
    got = sorted((r.row.page_id, r.text) for r in E.extract_text(df).collect())
    assert got == sorted([(i, own(i)) for i in range(6)] + [(6, menu), (7, ""), (8, menu), (0, own(0))])
    assert E.extract_text(df.limit(0)).count() == 0


def test_repeats_count_on_the_whole_host(spark, monkeypatch):
    """A run on two pages of a large host goes, whatever group each page is dealt to; a copied page stays."""
    monkeypatch.setattr(E, "GROUP_PAGES", 3)
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(20))
    pair = lambda i: " ".join(f"pair{i // 2}x{j}" for j in range(18))
    rows = [(i, f"https://h.example/{i}", f"<div>{own(i)}</div><p>{pair(i)}</p>") for i in range(40)]
    rows += [(100 + i, f"https://h.example/copy{i}", f"<div>{own(99)}</div>") for i in range(6)]
    rows += [(200, "https://other.example/", f"<p>{pair(0)}</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.row.page_id: r.text for r in E.extract_text(df).collect()}
    assert got == {**{i: own(i) for i in range(40)}, **{100 + i: own(99) for i in range(6)}, 200: pair(0)}


@pytest.mark.parametrize("empty", ["<main></main>", "<aside><article>a</article></aside>", "<!-- <article> -->", "<script>'<main>'</script>", "<form><main>b</main></form>"])
def test_an_element_without_text_settles_nothing(spark, empty):
    menu = " ".join(f"m{i}" for i in range(20))
    rows = [(i, "https://h.example/", f"{empty}<div>{menu}</div><p>own{i}</p>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.row.page_id: r.text for r in E.extract_text(df).collect()} == {i: f"own{i}" for i in range(3)}


def test_long_page(spark):
    df = spark.createDataFrame([(1, "u", "<article>" + "<p>word</p>" * 100_000)], "page_id bigint, url string, html string")
    assert E.extract_text(df).first().text == "\n".join(["word"] * 100_000)


def test_whole_table(spark):
    """The given pages keep to one form, which a pattern can cut out."""
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op10_html_extraction"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"(?s)<article>(.*?)(</article>|$)", pages[r.page_id].html)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p|br)>", inside)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_hosts_of_every_small_size():
    """Streams shorter than a run, also by less than a power of two."""
    for size in range(1, 41):
        for pages in ([size], [size // 2, size - size // 2], [1] * size):
            streams = [[100 * i + j for j in range(n)] for i, n in enumerate(pages)]
            assert not any(m.any() for m in E.repeated(streams))
            assert [len(m) for m in E.repeated(streams)] == pages
        same = [list(range(size)) + [900], list(range(size)) + [901]]
        want = [True] * size + [False] if size >= E.RUN else [False] * (size + 1)
        assert [m.tolist() for m in E.repeated(same)] == [want, want]


def test_tiny_page_in_spark(spark):
    df = spark.createDataFrame([(1, "https://h.example/", "<p>Not found</p>")], "page_id bigint, url string, html string")
    assert E.extract_text(df).first().text == "Not found"


def walked(html_text):
    """Blocks by looking at every open element, one by one."""
    class Walker(E.Reader):
        def _close_before(self, tag):
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name in E.CLOSED_BY_BLOCK or (name == tag and tag in E.CLOSED_BY_SAME):
                    return self.pop(len(self.open) - i)
                if (name in E.BLOCKS and name not in E.CLOSED_BY_SAME) or name in E.CLOSED_BY_SAME.get(tag, ()):
                    return None

        def handle_endtag(self, tag):
            if tag in E.BLOCKS and not any(name == tag for name, _ in self.open):
                return self.cut()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    return self.pop(len(self.open) - i)
                if tag not in E.BLOCKS and self.open[i][0] in E.BLOCKS:
                    return None

    reader = Walker()
    reader.feed(html_text)
    reader.close()
    reader.cut()
    return reader.blocks


def test_open_elements_as_if_walked():
    rng = random.Random(3)
    names = "p div span b a li ul ol table tr td th dl dt dd select option article nav".split()
    for _ in range(1500):
        text = "".join(rng.choice([f"<{n}>", f"<{n}>", f"</{n}>", f"w{i} "]) for i in range(rng.randint(1, 30)) for n in [rng.choice(names)])
        reader = E.Reader()
        reader.feed(text)
        reader.close()
        reader.cut()
        assert reader.blocks == walked(text)


@pytest.mark.parametrize("opened", ["<span>", "<li>", "<td>", "<b><i>"])
def test_many_unclosed_elements(opened):
    begin = time.perf_counter()
    settled, blocks = E.page_blocks("<div>" + opened * 50_000 + "<p>w</p>" * 50_000)
    assert blocks == ["w"] * 50_000 and not settled
    assert time.perf_counter() - begin < 5


def test_text_elements_go_by_whole_names():
    """Inside of an article, a paragraph goes for a class that is such a word, not for one that contains it."""
    kept = '<p class="lead-notice">a</p><p id="comments-policy">b</p><h2 class="AdHoc">c</h2><li class="menu-item">d</li>'
    gone = '<p class="notice">x</p><p class="big ad">x</p><div class="lead-notice">x</div><section id="comments-policy"><p>x</p></section>'
    assert E.page_blocks(f"<article>{kept}{gone}</article>") == (True, ["a", "b", "c", "d"])


def test_repeats_on_pages_with_an_article_count(spark):
    """Text of pages that their structure settles makes the same text boilerplate on a page without an article."""
    menu, note, own = (" ".join(f"{w}{i}" for i in range(20)) for w in ("menu", "note", "own"))
    rows = [(1, "https://h.example/1", f"<div>{menu}</div><article>{note}</article>"), (2, "https://h.example/2", f"<div>{menu}</div><p>{own}</p><p>{note}</p>"), (3, "https://h.example/3", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.row.page_id: r.text for r in E.extract_text(df).collect()} == {1: note, 2: own, 3: ""}


def test_repetition_decides_doubtful_blocks(spark):
    """A paragraph whose class only contains a notice's word is one if other pages of its host have it."""
    note = " ".join(f"note{i}" for i in range(18))
    page = lambda i, c: f'<article><p class="{c}">{note}</p><p>own{i}</p><p class="lead-notice">single{i}</p></article>'
    rows = [(i, f"https://h.example/{i}", page(i, "lead-notice")) for i in range(3)] + [(3, "https://h.example/3", page(3, "lead"))]
    rows += [(4, "https://other.example/", page(4, "lead-notice"))]
    rows += [(i, "https://copies.example/", f'<div>{i}</div><article><p class="lead-notice">{note}</p><p>{note}</p></article>') for i in (5, 6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {i: f"own{i}\nsingle{i}" for i in range(3)} | {i: f"{note}\nown{i}\nsingle{i}" for i in (3, 4)} | {i: f"{note}\n{note}" for i in (5, 6)}
    assert {r.row.page_id: r.text for r in E.extract_text(df).collect()} == want


@pytest.mark.parametrize("group_pages", [2, 7, 500])
def test_groups_as_the_whole_host(spark, monkeypatch, group_pages):
    """Random pages in groups and shards of any size give what a search of all pairs of pages gives."""
    monkeypatch.setattr(E, "GROUP_PAGES", group_pages)
    monkeypatch.setattr(E, "SHARD_GROUPS", 3)
    rng = random.Random(8)
    pieces = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([7, 9, 15, 16, 17, 25]))] for _ in range(12)]
    rows = []
    for i in range(60):
        own = iter(range(10**6))
        words = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(pieces) if rng.random() < 0.6 else [f"own{i}x{next(own)}" for _ in range(rng.randint(1, 20))])]
        rows.append((i, f"https://h{i % 2}.example/{i}", f"<main>{' '.join(words)}</main>" if i % 3 == 0 else f"<p>{' '.join(words)}</p>", words))
    rows += [(100 + r[0], f"{r[1]}?copy", r[2], r[3]) for r in rows[:9]]
    want = {}
    for i, url, page, words in rows:
        others = {tuple(w[x:x + E.RUN]) for _, u, _, w in rows if u[:18] == url[:18] and w != words for x in range(len(w) - E.RUN + 1)}
        gone = {y for x in range(len(words) - E.RUN + 1) if tuple(words[x:x + E.RUN]) in others for y in range(x, x + E.RUN)}
        want[i] = " ".join(w for y, w in enumerate(words) if page.startswith("<main>") or y not in gone)
    assert sum(want[r[0]] != " ".join(r[3]) for r in rows) > 10
    df = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string")
    assert {r.row.page_id: r.text for r in E.extract_text(df).collect()} == want
