import itertools
import math
import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq

from gristmill.llm import htmltext

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_viterbi_equals_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        field = htmltext.Field({f"f{k}": rng.gauss(0, 2) for k in range(5)}, [[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"], [rng.gauss(0, 1) for _ in "ab"])
        rows = [[f"f{rng.randrange(6)}" for _ in range(3)] for _ in range(rng.randrange(1, 8))]

        def score(labels):
            s = field.first[labels[0]] + sum(field.steps[a][b] for a, b in zip(labels, labels[1:]))
            return s + sum(field.weights.get(f, 0) for row, y in zip(rows, labels) if y for f in row)

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert math.isclose(score(field.decode(rows)), score(best))
    assert field.decode([]) == []


def test_held_out_pages():
    field = htmltext.trained()
    right = total = 0
    for page, truth in htmltext.labelled_pages(150, seed=99):
        rows = htmltext.labelled_blocks(page, truth)
        got = field.decode([f for f, _ in rows])
        right += sum(a == y for a, (_, y) in zip(got, rows))
        total += len(rows)
    assert right >= 0.97 * total


class Article(HTMLParser):
    """The article's blocks by the standard library's parser: an independent reading of pages as simple as the given ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag not in htmltext.INLINE and tag not in ("script", "style"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag not in htmltext.INLINE and tag not in ("script", "style"):
            self.blocks.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def article_of(page):
    parser = Article()
    parser.feed(page)
    return "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.strip())


def test_given_pages_give_their_article():
    field = htmltext.trained()
    for page in pq.read_table(PAGES).column("html").to_pylist():
        assert htmltext.main_text(page, field) == article_of(page)


def test_names_that_tell_of_the_page():
    """Root elements and wrappers named after a sidebar hold the article all the same."""
    field = htmltext.trained()
    text = [f"This is paragraph {k} of an article that goes on for a while, with some words in it." for k in range(4)]
    inner = "<h1>A heading of it</h1>" + "".join(f"<p>{t}</p>" for t in text)
    around = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>", '<div class="sidebar"><h3>Popular</h3><ul><li><a href=z>Other</a></li></ul></div><footer>&copy; 2020 me</footer>'
    want = "\n\n".join(["A heading of it", *text])
    for page in (
        f'<body class="sidebar single">{around[0]}<div class="entry-content">{inner}</div>{around[1]}</body>', f'<body>{around[0]}<div class="content with-sidebar">{inner}</div>{around[1]}</body>',
        f'<body class="has-comments">{around[0]}<div id="page" class="has-sidebar"><article>{inner}</article>{around[1]}</div></body>', f'<body><div class="layout sidebar-right">{around[0]}<main>{inner}</main>{around[1]}</div></body>',
    ):
        assert htmltext.main_text(page, field) == want, page[:80]
    assert htmltext.cues(' class="sidebar-content"') == ("sidebar", "content") and htmltext.cues(' class="content with-sidebar"') == ("content",) and htmltext.cues(' id=main class="post sidebar-left"') == ("main", "post")


def test_long_and_deep_pages_are_linear():
    for odd in (
        "<x>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<x>" * 50_000 + "<li>a</li>" * 50_000, "<div>" * 50_000 + "a<p>" * 50_000, "</div>" * 200_000, "<td>a" * 100_000, "<ul><li>" * 50_000 + "</li>" * 50_000,
        "<div class='ad nav'>" * 50_000 + "text", "<p>" + "word " * 500_000 + "© all", "<script>" * 50_000, "<!--" * 50_000, "<svg>" * 50_000 + "<g>x" * 50_000,
    ):
        began = time.process_time()
        htmltext.blocks(odd)
        assert time.process_time() - began < 5, odd[:20]


def test_all_ancestors_and_the_whole_block_count():
    deep = "<article>" + "<div>" * 500 + "Some words." + "</div>" * 500 + "</article>"
    assert {"in=article", "place=10"} <= set(htmltext.blocks(deep)[0][1])
    assert "rights" in htmltext.blocks("<p>" + "word " * 1000 + "© me")[0][1]


def test_markup():
    field = htmltext.trained()
    page = """<body><script>if (a < b) "</p>";</script><nav><a href=x>Home</a></nav><article><h1>A &amp; B&nbsp;</h1><p title="x > y">One <b>two
    </b>three.<!-- <p>no --><p>Caf&eacute; &#8364; 5 &lt; 6 and so on, it went.</article><section class=comments><p>Nice post, thank you for it.</p></section><footer>&copy; me</footer>"""
    assert htmltext.main_text(page, field) == "A & B\n\nOne two three.\n\nCafé € 5 < 6 and so on, it went."
    for odd in (None, "", "<", "<<<a", "<!--", "</p></p>", "a < b", "<script>", "<p" * 20000, "<a href='" * 20000 + ">", "<div>" * 30000, "<p>x" * 30000):
        htmltext.main_text(odd, field)


def test_only_scripts_and_styles_are_dropped():
    texts = lambda page: [t for t, _ in htmltext.blocks(page)]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><g><title>a</title><text>drawn</text></g></svg> in<script>no</script> one.</p>") == ["Let x=2 be a drawn in one."]
    assert texts("<p>See <object data=x><param name=y>the table</object> and <noscript>its still</noscript> <iframe src=x>frame</iframe>.</p>") == ["See the table and its still frame."]
    for name in ("noscript", "object", "svg", "math", "template", "iframe"):
        assert texts(f"<p>One<{name}>two</p><p>three</p>") == ["Onetwo", "three"]
    assert texts("<p>One<style>p {}</style> two</p><svg><path d=x /><circle></svg><h2>Three</h2>") == ["One two", "Three"]
    field = htmltext.trained()
    page = "<nav><a href=x>Home</a></nav><article><p>Some words are here, and <math><mi>y</mi></math> more.</p><noscript><p>This is the rest of it, all told.</p></article>"
    assert htmltext.main_text(page, field) == "Some words are here, and y more.\n\nThis is the rest of it, all told."


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some words are here, and more.</p></article>", 5), (1, "u", "<article><p>Some words are here, and more.</p></article>", 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in htmltext.extract(df).collect()), key=str)
    assert got == [(1, "u", "Some words are here, and more.", 30)] * 2 + [(None, None, "", 0)]
    assert htmltext.extract(df.limit(0)).count() == 0
