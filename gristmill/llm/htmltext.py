"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of text between block-level tags, each with the tags and class words of all its open ancestors. The field
scores each block from those, above all from the nearest ones, and from its text, and neighbouring blocks together; Viterbi decoding marks each as article or not. It is
trained by maximum likelihood (forward-backward, with a quadratic penalty) on the labelled pages that labelled_pages() composes: articles
amid menus, headers, footers, sidebars, notices, adverts, forms and reader comments, in many wordings and nestings.

Scripts, styles and comments in the markup are no text, and they end no block; nothing else is dropped before the field judges it: formulas, drawings, and what
noscript, template, object and iframe hold are text of the block around them, unless block-level tags within cut it. Character references are decoded, white space within a block becomes one
space, and the article's blocks are joined in page order by a blank line. Nulls: a null html is empty and gives the empty text; null ids and urls stay
null. Repeated rows each give their row. Pages are read whole, in time linear in their length, whether well formed or not: an open element carries what all its ancestors
say, and where the last open element of a name stands is known without a walk.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import once, row_map

TRAINING_PAGES = 400
ROUNDS = 150
PENALTY = 0.02

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr noscript template iframe object param embed svg math".split())
RAW = frozenset("script style".split())
#: Tags that end a drawing or formula that was left open; all others within one are its own. SPACED ones part words there.
BREAKS = frozenset(
    "html head body main article section nav aside header footer h1 h2 h3 h4 h5 h6 p div blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend label button select option textarea input "
    "figure figcaption address details summary hr center hgroup dialog menu search".split()
)
RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
SPACED = frozenset("text title desc mtr mtd annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body article section div main aside nav".split())
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+>)""")
NAMES = re.compile(r"""(?i)(?:\b(?:class|id|role|aria-label)\s*=\s*)("[^"]*"|'[^']*'|[^\s>"']+)""")
PIECES = re.compile(r"[a-z]+")
CUES = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs header masthead topbar footer bottom copyright sidebar side aside widget related "
    "recommended popular trending more comment comments reply replies discussion disqus respond cookie cookies consent notice alert warning gdpr privacy popup modal newsletter subscribe signup login form search share social "
    "tags meta byline pagination pager legal toolbar article post entry content story main body text prose".split()
)


#: Cues of an article's own containers; all others and FOREIGN_TAGS are seldom above its blocks.
OWN = frozenset("article post entry content story main body text prose".split())
FOREIGN = CUES - OWN - {"more"}
FOREIGN_TAGS = frozenset("nav footer aside form header head select button label".split())
#: In a class name, these say that a page has a part (or where), not that the element is that part: the first ones always, the others beside a class of OWN cues.
SAYS_HAS, SAYS_WHERE = frozenset("with has no without open closed enabled".split()), frozenset("left right both single".split())
PLAIN = frozenset("html body div span".split())


def cues(attributes: str) -> tuple[str, ...]:
    """The cue words of an element's class, id, role and label."""
    names = [(PIECES.findall(token), token) for x in NAMES.findall(attributes) for token in x.lower().strip("\"'").split()]
    own = any(not OWN.isdisjoint(p) and FOREIGN.isdisjoint(p) for p, _ in names)
    found: list[str] = []
    for pieces, _ in names:
        if SAYS_HAS.isdisjoint(pieces) and not (own and not SAYS_WHERE.isdisjoint(pieces)):
            found += [w for w in pieces if w in CUES]
    return tuple(found)


class Open:
    """An open element: its name, the features that its blocks inherit from it and all elements above, the cues of the nearest that has any, and whether OWN or FOREIGN ones are above."""

    __slots__ = ("foreign", "inherited", "inside", "name", "near")

    def __init__(self, name: str, words: tuple[str, ...], above: Open | None):
        inherited = above.inherited if above else frozenset()
        new = {f"cue={w}" for w in words} | (set() if name in PLAIN else {f"in={name}"})
        self.name, self.inherited = name, inherited if new <= inherited else inherited | new
        self.near = words or (above.near if above else ())
        self.inside = bool(above and above.inside) or name in ("article", "main") or not OWN.isdisjoint(words)
        self.foreign = bool(above and above.foreign) or name in FOREIGN_TAGS or not FOREIGN.isdisjoint(words)


class Stack:
    """Open elements, with the places of each name's."""

    def __init__(self) -> None:
        self.items: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def top(self) -> Open | None:
        return self.items[-1] if self.items else None

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        if name in SCOPES:
            self.scopes.append(len(self.items))
        self.items.append(Open(name, words, self.top()))

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def cut(self, k: int) -> None:
        """Closes the element at k and all within it."""
        while len(self.items) > k >= 0:
            name = self.items.pop().name
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    def make_way(self, name: str) -> None:
        """Closes what the start of an element ends: a paragraph, and its like up to the nearest scope."""
        if self.items and self.items[-1].name == "p":
            self.cut(len(self.items) - 1)
        k = max((self.last(x) for x in CLOSES.get(name, ())), default=-1)
        if k > (self.scopes[-1] if self.scopes else -1):
            self.cut(k)


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block that has text, in page order."""
    out: list[tuple[str, list[str]]] = []
    stack = Stack()
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, features(text, stack.top(), linked)))
            parts.clear()
        linked = 0

    at, last = 0, page.rfind(">")
    in_link = drawn = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            lt = len(page)
        if lt > at:
            parts.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == len(page):
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = len(page) if close < 0 else close + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name = m[1], m[2].lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            if not closing and not m[3].endswith("/>"):
                close = RAW_END[name].search(page, at)
                at = len(page) if not close else page.find(">", close.start()) + 1 or len(page)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name in ("svg", "math") and not m[3].endswith("/>"):
                drawn = max(0, drawn - 1) if closing else drawn + 1
            continue
        if drawn and name not in BREAKS:
            if name in SPACED:
                parts.append(" ")
            continue
        end()
        in_link = drawn = 0
        if closing:
            stack.cut(stack.last(name))
            continue
        if name in VOID or m[3].endswith("/>"):
            continue
        stack.make_way(name)
        # what a page's root elements are called tells of the whole page, not of a part
        stack.push(name, cues(m[3]) if len(m[3]) > 5 and name not in ("html", "body") else ())
    end()
    return out


def features(text: str, element: Open | None, linked: int) -> list[str]:
    found = {"bias", f"own={element.name if element else 'none'}"}
    if element:
        found |= element.inherited
        found.update(f"near={w}" for w in element.near)
    inside, foreign = bool(element and element.inside), bool(element and element.foreign)
    found.add(f"place={inside:d}{foreign:d}")
    if element and element.near:
        found.add(f"nearest={not OWN.isdisjoint(element.near):d}{not FOREIGN.isdisjoint(element.near):d}")
    found.add(f"words={min(7, (text.count(' ') + 1).bit_length())}")
    found.add(f"links={min(4, 4 * linked // max(1, len(text)))}")
    if text[-1] in ".!?:;…":
        found.add("ends")
    if "©" in text or "copyright" in text.lower():
        found.add("rights")
    return sorted(found)


def words_of(rng: random.Random, n: int) -> str:
    pool = ("the", "of", "and", "que", "la", "der", "und", "les", "ation", "ing", "ter", "on", "re", "ón", "é", "sch", "heit", "para", "eau", "men")
    text = " ".join("".join(rng.choice(pool) for _ in range(rng.choice((1, 1, 2, 3)))) for _ in range(n))
    return text[:1].upper() + text[1:]


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """(html, its blocks' texts with label 1 for the article)."""
    truth: list[tuple[str, int]] = []
    out: list[str] = []

    def text(label: int, low: int, high: int, stop: str = "") -> str:
        s = words_of(rng, rng.randint(low, high)) + stop
        truth.append((s, label))
        return s

    def links(n: int) -> None:
        kind = rng.random()
        if kind < 0.6:
            out.append("<ul>" + "".join(f'<li><a href="/{k}">{text(0, 1, 3)}</a></li>' for k in range(n)) + "</ul>")
        else:
            out.append("".join(f'<div><a href="/{k}">{text(0, 1, 4)}</a></div>' for k in range(n)))

    def wrap(names: tuple[str, ...], cues: tuple[str, ...], plain: float = 0.4) -> tuple[str, str]:
        name = rng.choice(names)
        attrs = "" if name != "div" and rng.random() < plain else f' {rng.choice(("class", "id"))}="{rng.choice(cues)}"'
        return f"<{name}{attrs}>", f"</{name}>"

    def part(names: tuple[str, ...], cues: tuple[str, ...], body) -> None:
        a, b = wrap(names, cues)
        out.append(a)
        body()
        out.append(b)

    def paragraphs(label: int, n: int) -> None:
        for _ in range(n):
            long = rng.random() < 0.75
            out.append(rng.choice(("<p>", "<p>", "<p><b>", "<div>")) + (text(label, 8, 80, ".") if long else text(label, 1, 7, rng.choice(("", ".", "!")))))
            out.append(rng.choice(("</p>", "<br>", "</p>")) if not out[-1].startswith("<div>") else "</div>")

    def aside() -> None:
        out.append(f"<h3>{text(0, 1, 4)}</h3>")
        rng.choice((lambda: links(rng.randint(2, 6)), lambda: paragraphs(0, rng.randint(1, 2))))()

    def comments() -> None:
        out.append(f"<h3>{text(0, 1, 3)}</h3>")
        for _ in range(rng.randint(1, 4)):
            k = rng.choice(("div", "li", "article", ""))
            out.append(f'<{k} class="{rng.choice(("comment", "comment", "reply", "comment-body"))}"><p>{text(0, 3, 50, ".")}</p></{k}>' if k else f"<p>{text(0, 3, 50, '.')}</p>")

    def form() -> None:
        out.append(f'<form><label>{text(0, 1, 4)}</label><input name="q"><button>{text(0, 1, 2)}</button></form>')

    def article() -> None:
        if rng.random() < 0.8:
            out.append(f"<h1>{text(1, 2, 12, rng.choice(('', '.')))}</h1>")
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.62:
                paragraphs(1, rng.randint(1, 4))
            elif kind < 0.72:
                out.append(f"<h2>{text(1, 1, 8)}</h2>")
            elif kind < 0.80:
                out.append("<ul>" + "".join(f"<li>{text(1, 2, 25, '.')}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote>{text(1, 4, 40, '.')}</blockquote>")
            elif kind < 0.88:
                out.append("<table><tr>" + "".join(f"<td>{text(1, 1, 6)}</td>" for _ in range(rng.randint(1, 4))) + "</tr></table>")
            elif kind < 0.91:
                out.append(f"<pre>{text(1, 4, 20)}</pre>")
            elif kind < 0.95:
                part(("div", "aside"), ("ad", "ads", "advert", "sponsored", "promo banner"), lambda: paragraphs(0, 1))
            elif kind < 0.98:
                part(("aside", "div"), ("related", "sidebar", "newsletter", "share social"), aside)
            else:
                form()

    out.append("<!DOCTYPE html><html><head><title>x</title></head><body>".replace("<title>x</title>", f"<title>{text(0, 2, 12)}</title>") if rng.random() < 0.8 else "<html><body>")
    if rng.random() < 0.35:  # root elements and wrappers whose names tell of parts of the page
        out[-1] = out[-1].replace("<body>", f'<body class="{rng.choice(("sidebar single", "home blog has-sidebar", "right-sidebar", "comments-open", "with-banner"))}">')
    around = f'<div class="{rng.choice(("layout sidebar-right", "page has-sidebar", "wrap with-banner", "site sidebar", "container comments-open", "content with-sidebar"))}">' if rng.random() < 0.25 else ""
    out.append(around)
    before = [
        lambda: part(("nav", "div"), ("nav", "menu", "navbar", "breadcrumbs", "navigation"), lambda: links(rng.randint(2, 8))),
        lambda: part(("header", "div"), ("header", "masthead", "topbar"), lambda: (out.append(f"<h1>{text(0, 1, 4)}</h1>"), rng.random() < 0.5 and links(3))),
        lambda: part(("div", "section"), ("cookie consent", "notice", "alert", "gdpr", "banner"), lambda: paragraphs(0, rng.randint(1, 2))),
        lambda: part(("div", "aside"), ("ad", "ads", "advert", "advertisement", "sponsor", "promo"), lambda: rng.random() < 0.5 and paragraphs(0, 1) or out.append(text(0, 3, 40, "."))),
        lambda: part(("aside", "div"), ("sidebar", "widget", "related"), aside),
        form,
    ]
    after = [before[3], before[4], lambda: part(("section", "div"), ("comments", "discussion", "replies", "respond"), comments), form]
    for f in rng.sample(before, rng.randint(1, len(before))):
        f()
    outer = rng.choice((("", ""), ("<main>", "</main>"), ('<div class="wrap">', "</div>"), ('<div id="page"><div>', "</div></div>"), ('<div class="main with-sidebar">', "</div>"), ('<div class="columns sidebar-left">', "</div>")))
    out.append(outer[0])
    part(("article", "article", "main", "div", "section"), ("content", "post", "entry", "article", "story body", "prose text", "entry-content", "post-body", "content with-sidebar"), article)
    out.append(outer[1])
    for f in rng.sample(after, rng.randint(0, len(after))):
        f()
    if rng.random() < 0.85:
        part(("footer", "div"), ("footer", "bottom", "legal copyright"), lambda: out.append(f"&copy; {text(0, 2, 20, '.')}") or rng.random() < 0.3 and links(3))
    out.append("</div>" if around else "")
    out.append("</body></html>" if rng.random() < 0.8 else "")
    return "".join(out), truth


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]


def labelled_blocks(page: str, truth: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Each block's features with the label of the piece of truth that it holds. Pieces come in page order."""
    out, k = [], 0
    for text, found in blocks(page):
        label = 0
        while k < len(truth) and truth[k][0] in text:
            label = truth[k][1]
            text = text.split(truth[k][0], 1)[1]
            k += 1
        out.append((found, label))
    return out


class Field:
    """weights: of each feature for article over other; steps[a][b]: from label a to b; first: of the first label."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], first: list[float]):
        self.weights, self.steps, self.first = weights, steps, first

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels of a page's blocks."""
        w = self.weights
        (s00, s01), (s10, s11) = self.steps
        back: list[tuple[int, int]] = []
        a, b = 0.0, 0.0
        for k, row in enumerate(rows):
            x = sum(w.get(f, 0.0) for f in row)
            if not k:
                a, b = self.first[0], self.first[1] + x
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + x
        if not rows:
            return []
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[tuple[str, int]]]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Field:
    """Maximum likelihood by gradient ascent with per-weight steps; all pages at once, padded to the longest."""
    data = [rows for p in pages if (rows := labelled_blocks(*p))]
    names = sorted({f for rows in data for found, _ in rows for f in found})
    number = {f: k for k, f in enumerate(names)}
    n, longest = len(data), max(map(len, data))
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, rows in enumerate(data):
        for t, (found, label) in enumerate(rows):
            x[i, t, [number[f] for f in found]] = 1
            y[i, t], live[i, t] = label, True
    w, steps, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(p, 1e-6) for p in (w, steps, first)]
    both = live[:, 1:]
    pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(rounds):
        score = np.stack([np.zeros((n, longest)), x @ w], 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + steps, 1) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(steps + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        step_p = np.exp(alpha[:, :-1, :, None] + steps + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grads = (
            np.tensordot((y * live - p[:, :, 1]), x, 2) / n - penalty * w,
            (pairs - step_p.sum((0, 1))) / n - penalty * steps,
            np.array([(y[:, 0] == k).mean() for k in (0, 1)]) - p[:, 0].mean(0) - penalty * first,
        )
        for value, grad, seen in zip((w, steps, first), grads, sums, strict=True):
            seen += grad * grad
            value += 0.5 * grad / np.sqrt(seen)
    return Field({f: float(w[k]) for f, k in number.items()}, steps.tolist(), first.tolist())


def trained() -> Field:
    return once("html-field", lambda: train(labelled_pages()))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n\n".join(text for (text, _), label in zip(found, field.decode([f for _, f in found]), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html), in one narrow pass. The field's some hundred weights go with the task."""
    own = field or trained()
    parts, kind = (own.weights, own.steps, own.first), Field

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        used = kind(*parts)
        for page_id, url, page in given:
            text = main_text(page, used)
            yield page_id, url, text, len(text)

    return row_map(pages.select("page_id", "url", "html"), rows, "page_id long, url string, text string, n_chars long")
