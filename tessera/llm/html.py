"""HTML extraction by a tree-structured graphical model.

A page's DOM elements are binary variables (holds main text or not).  Each has a
potential of its own (tag, class and id words, lengths, link share) and one with its
parent (a 2 x 2 table for each kind of child).  Sum-product messages, upward and then
downward, give each element's marginal; text whose element has a marginal of half or more
is the main text.  Weights are learned by gradient ascent on the exact likelihood of
labelled pages: pages composed from labelled parts (compose()), and a bounded sample of
the corpus's own pages whose <article> or <main> tells the labels (PAGES at most).

Each page is worked on by itself, in one pass and without a shuffle; passes over the
tree are loops over arrays in document order, so depth and length are not limited.

Defined cases: a null or empty page has the empty text; stray tags are skipped, and a tag, comment or quoted
attribute that isn't closed reaches to the end of the page, as in browsers (a quote counts only after a "="); any attributes are
allowed and none is a label; pages of any length are read in one pass; a page without main text has the empty text; repeated
rows get equal texts; an empty table gives an empty result; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import table

#: Pages of the corpus to learn from, at most, taken by the hash of their id.
PAGES = 150
#: Larger pages are not learned from.
PAGE_BYTES = 1 << 18
#: Composed pages to learn from.
COMPOSED = 350

#: What begins markup; all other "<" are text.
_OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
#: White space and slashes, then an attribute: its name and, after "=", its value in quotes or bare. No part can be read in two ways.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\s>"'][^\s>]*+))?)?)""")
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is never text of the page.
_DROPPED = frozenset("script style template noscript head title svg math textarea select button iframe object canvas audio video map".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
#: An opening tag closes these open elements, but not beyond the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ENDS_SEARCH = frozenset("td th table body html article section div".split())


@dataclass
class Page:
    """A page's variables, each after its parent, and its text pieces (block, variable, text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)


def read_tag(html: str, at: int) -> tuple[int, bool, list[tuple[str, str]]]:
    """From behind a tag's name: the place behind its ">" (-1 if it isn't closed), whether it closes itself, its attributes."""
    found: list[tuple[str, str]] = []
    while m := _ATTRIBUTE.match(html, at):
        at = m.end()
        if m[1]:
            return at, html[at - 2] == "/", found
        if m[3] is not None and not m[4] or m[5] is not None and not m[6]:
            break
        found.append((m[2].lower(), m[3] or m[5] or m[7] or ""))
    return -1, False, found


def parse(html: str, labels: dict[int, int] | None = None) -> Page:
    """The variables of a page. labels: of elements, by the place of their opening tag."""
    page = Page([-1], ["html"], [[]], [None])
    stack: list[tuple[str, int, bool]] = [("", 0, True)]
    spots: dict[str, list[int]] = defaultdict(lambda: [0])  # places in the stack of open elements, by tag
    blocks = [0]  # those of elements that aren't inline
    block = at = links = 0

    def text(a: int, b: int) -> None:
        if a < b:
            page.pieces.append((block, stack[-1][1], html[a:b]))
            page.linked.append(links > 0)

    def pop(to: int) -> None:
        nonlocal links
        for t, _, is_block in stack[to:]:
            spots[t].pop()
            links -= t == "a"
            if is_block:
                blocks.pop()
        del stack[to:]

    while m := _OPENS.search(html, at):
        text(at, m.start())
        if m[1] or m[2]:
            end = html.find("-->" if m[1] else ">", m.end())
            at = len(html) if end < 0 else end + (3 if m[1] else 1)
            continue
        closing, tag = m[3], m[4].lower()
        at, closed, attributes = read_tag(html, m.end())
        if at < 0:
            at = len(html)
            break
        inline = tag in _INLINE
        if tag == "br":
            page.pieces.append((block, stack[-1][1], " "))
            page.linked.append(links > 0)
            continue
        if not inline:
            block += 1
        if closing:
            last = spots[tag][-1]
            if last and not (inline and blocks[-1] > last):  # an inline element isn't closed through a block
                pop(last)
            continue
        if tag in _RAW and not closed:
            end = _RAW_ENDS[tag].search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = len(html) if close < 0 else close + 1
            continue
        if tag in _VOID:
            continue
        if not inline:
            closes, stop = _CLOSES.get(tag, ({"p"}, _ENDS_SEARCH))
            last = max(spots["p"][-1], *(spots[t][-1] for t in closes))
            if last and last > max(spots[t][-1] for t in stop):
                pop(last)
        node = stack[-1][1]
        names, label = [], (labels or {}).get(m.start())
        for key, value in attributes:
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                names += _NAME_WORDS.findall(_CAMEL.sub(" ", value).lower())
            elif key in ("hidden", "aria-hidden"):
                names.append("hidden")
        if not inline or names or label is not None:
            page.parent.append(node)
            page.tag.append(tag)
            page.names.append(names)
            page.label.append(label)
            node = len(page.parent) - 1
        if not (closed and tag in _DROPPED):
            spots[tag].append(len(stack))
            if not inline:
                blocks.append(len(stack))
            stack.append((tag, node, not inline))
            links += tag == "a"
    text(at, len(html))
    return page


def features(page: Page) -> list[list[str]]:
    """The active features of each variable."""
    n = len(page.parent)
    own, linked, below = [0] * n, [0] * n, [0] * n
    for (_, node, said), link in zip(page.pieces, page.linked, strict=True):
        size = len(said.strip())
        own[node] += size
        linked[node] += size if link else 0
    below[:] = own
    links = linked[:]
    for i in range(n - 1, 0, -1):
        below[page.parent[i]] += below[i]
        links[page.parent[i]] += links[i]
    out = []
    for i in range(n):
        tag, up = page.tag[i], page.tag[page.parent[i]] if i else ""
        share = links[i] / below[i] if below[i] else 0.0
        out.append(
            ["1", "tag=" + tag, f"in={up}>{tag}", f"own={min(9, own[i].bit_length())}", f"all={min(14, below[i].bit_length())}", f"links={int(share * 4)}", *("name=" + w for w in page.names[i]), *("stem=" + w[:5] for w in page.names[i] if len(w) > 4), *(["dropped"] if tag in _DROPPED else [])]
        )
    return out


def kind_of(page: Page, i: int) -> int:
    """The table of parent and child that variable i has: plain or named elements, and inline ones."""
    return 2 if page.tag[i] in _INLINE else 1 if page.names[i] or page.tag[i] in ("nav", "aside", "header", "footer", "form") else 0


@dataclass
class Model:
    weights: dict[str, float]
    #: pair[kind][parent's state][child's state], logarithms.
    pair: list[list[list[float]]]

    def messages(self, page: Page, active: list[list[str]]) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
        """Marginals of each variable's 1, of each (parent, child) pair of states, and the logarithm of the partition sum."""
        n, weights = len(page.parent), self.weights
        unary = [sum(weights.get(f, 0.0) for f in fs) for fs in active]
        kinds = [kind_of(page, i) for i in range(n)]
        tables = [[[exp(v) for v in row] for row in t] for t in self.pair]
        # upward: the message to the parent's states, scaled to sum 1
        inside = [(1.0, exp(max(-30.0, min(30.0, u)))) for u in unary]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        log_z = 0.0
        for i in range(n - 1, 0, -1):
            a, b = inside[i]
            t = tables[kinds[i]]
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            s = m0 + m1
            log_z += log(s)
            up[i] = (m0 / s, m1 / s)
            p = page.parent[i]
            c, d = inside[p][0] * up[i][0], inside[p][1] * up[i][1]
            r = c + d
            log_z += log(r)
            inside[p] = (c / r, d / r)
        log_z += log(sum(inside[0]))
        # downward: what the rest of the tree says of each parent's states, without its child's own message
        marginal, pairs = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        outside: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n):
            if i:
                p, t = page.parent[i], tables[kinds[i]]
                c0 = outside[p][0] * inside[p][0] / max(up[i][0], 1e-300)
                c1 = outside[p][1] * inside[p][1] / max(up[i][1], 1e-300)
                a, b = inside[i]
                q = (c0 * t[0][0] * a, c0 * t[0][1] * b, c1 * t[1][0] * a, c1 * t[1][1] * b)
                s = sum(q) or 1.0
                pairs[i] = tuple(x / s for x in q)
                o0, o1 = c0 * t[0][0] + c1 * t[1][0], c0 * t[0][1] + c1 * t[1][1]
                s = o0 + o1 or 1.0
                outside[i] = (o0 / s, o1 / s)
            a, b = inside[i][0] * outside[i][0], inside[i][1] * outside[i][1]
            marginal[i] = b / ((a + b) or 1.0)
        return marginal, pairs, log_z

    def extract(self, html: str | None) -> str:
        """The main text of a page."""
        if not html:
            return ""
        page = parse(html)
        marginal = self.messages(page, features(page))[0]
        hidden = [False] * len(page.parent)
        for i in range(len(page.parent)):
            hidden[i] = page.tag[i] in _DROPPED or (i > 0 and hidden[page.parent[i]])
        out: list[str] = []
        now, held = -1, []
        for block, node, said in [*page.pieces, (-2, 0, "")]:
            if block != now:
                if whole := " ".join(unescape("".join(held)).split()):
                    out.append(whole)
                now, held = block, []
            if marginal[node] >= 0.5 and not hidden[node]:
                held.append(said)
        return "\n\n".join(out)


def states(page: Page) -> list[int]:
    """The labels of all variables: 1 where main text is at or below."""
    n = len(page.parent)
    near: list[int] = [0] * n
    for i in range(n):
        own = page.label[i]
        near[i] = own if own is not None else near[page.parent[i]] if i else 0
    out = [0] * n
    for _, node, said in page.pieces:
        if said.strip() and near[node]:
            out[node] = 1
    for i in range(n - 1, 0, -1):
        if out[i]:
            out[page.parent[i]] = 1
    return out


def learn(pages: list[Page], rounds: int = 14, rate: float = 0.15, decay: float = 1e-4, seed: int = 5) -> Model:
    """Weights by stochastic gradient ascent (Adagrad) on the likelihood of the pages' states; gradients come from the marginals."""
    model = Model({}, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)])
    rng = Random(seed)
    known = [(p, features(p), states(p)) for p in pages]
    seen: dict[object, float] = defaultdict(lambda: 1e-2)
    for _ in range(rounds):
        rng.shuffle(known)
        for page, active, y in known:
            # now and then a feature is left out, so that none is relied on alone
            active = [[f for f in fs if f in ("1", "dropped") or rng.random() > 0.2] for fs in active]
            marginal, pairs, _ = model.messages(page, active)
            step: dict[object, float] = defaultdict(float)
            for i, fs in enumerate(active):
                d = y[i] - marginal[i]
                for f in fs:
                    step[f] += d
                if i:
                    k, q = kind_of(page, i), pairs[i]
                    for a in (0, 1):
                        for b in (0, 1):
                            step[k, a, b] += (y[page.parent[i]] == a and y[i] == b) - q[2 * a + b]
            for f, g in step.items():
                seen[f] += g * g
                by = rate * g / seen[f] ** 0.5
                if isinstance(f, tuple):
                    k, a, b = f
                    model.pair[k][a][b] = (1 - decay) * model.pair[k][a][b] + by
                else:
                    model.weights[f] = (1 - decay) * model.weights.get(f, 0.0) + by
    return model


#: Names of parts of pages that are not main text, by kind, with their usual tags.
PARTS = {
    "menu": ("nav div ul", "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs pagination pager toc"),
    "header": ("header div", "header masthead site-header top-bar topbar logo branding page-header hero-banner"),
    "footer": ("footer div", "footer site-footer page-footer bottom copyright colophon legal imprint"),
    "sidebar": ("aside div section", "sidebar side-bar aside right-column rail widget widgets related related-posts recommended trending popular read-more more-stories"),
    "notice": ("div section p", "notice cookie cookie-banner cookies consent gdpr alert banner message popup modal overlay disclaimer warning toast paywall"),
    "advert": ("div aside section span", "ad ads advert advertisement adsense banner-ad sponsor sponsored promo promotion promoted"),
    "form": ("form div", "form search search-form login signup subscribe subscription newsletter contact-form register"),
    "comments": ("div section ol article ul", "comments comment comment-list commentlist discussion replies reply respond disqus responses thread user-comment"),
    "share": ("div ul", "share sharing social social-links share-buttons follow tags tag-list post-tags toolbar"),
}
#: Names of elements that hold main text.
HOLDERS = ("article main div section", "content post entry article article-body post-content entry-content story story-body text body main main-content post-body blog-post page-content prose")


def compose(rng: Random) -> tuple[str, dict[int, int]]:
    """A page put together from labelled parts, and the labels (1 for main text) by the places of the parts' tags."""
    marks = {0: "\x00", 1: "\x01"}

    def said(low: int, high: int) -> str:
        n = rng.randint(low, high)
        words = ["".join(rng.choice("a e i o u n r t s l d th en er on in".split()) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        return " ".join(w.capitalize() if not i or words[i - 1].endswith(".") else w for i, w in enumerate(w + "." * (rng.random() < 0.1) for w in words)) + rng.choice(["", ".", ".", "!"])

    def named(names: str) -> str:
        r = rng.random()
        n = rng.choice(names.split())
        if r < 0.12:
            return ""
        n = n.replace("-", rng.choice(["-", "_", "-"])) + rng.choice(["", "", "", "-" + str(rng.randint(1, 9)), "-wrapper", "-container", " clearfix"])
        return f' {"id" if r < 0.3 else "class"}="{n}"'

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{rng.randint(1, 99)}">{said(1, 4)}</a>' for _ in range(rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else rng.choice([" ", " | ", ""]).join(items)

    def part(kind: str) -> str:
        tags, names = PARTS[kind]
        tag = rng.choice(tags.split())
        plain = tag in ("nav", "header", "footer", "aside", "form")
        attributes = named(names) if not plain or rng.random() < 0.5 else ""
        attributes = attributes or ("" if plain else f' class="{rng.choice(names.split())}"')
        if kind in ("menu", "share"):
            inside = links(3, 9)
        elif kind == "comments":
            inside = "<h3>" + said(1, 3) + "</h3>" * (rng.random() < 0.9) + "".join(f'<{t}{rng.choice(["", " class=comment", " class=reply"])}><p>{said(4, 60)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inside = f"<label>{said(1, 3)}</label><input name=q><p>{said(2, 14)}</p><button>{said(1, 2)}</button>"
        elif kind == "sidebar":
            inside = rng.choice([f"<h3>{said(1, 4)}</h3>{links(2, 7)}", f"<h4>{said(1, 3)}</h4><p>{said(5, 40)}</p>", f"<p>{said(5, 50)}</p>"])
        elif kind == "header":
            inside = rng.choice([f"<h1>{said(1, 4)}</h1>", f"<div>{said(1, 5)}</div>", f"<a href=/>{said(1, 3)}</a>"]) + rng.choice(["", links(2, 6), f"<p>{said(2, 9)}</p>"])
        else:
            inside = rng.choice([said(3, 30), f"<p>{said(3, 40)}</p>", f"<p>{said(3, 20)} <a href=/x>{said(1, 3)}</a></p>", f"&copy; {said(2, 12)}"])
        return f"{marks[0]}<{tag}{attributes}>{inside}</{tag}>"

    def body() -> str:
        out = [f"<h1>{said(2, 10)}</h1>"] if rng.random() < 0.8 else []
        if out and rng.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(rng.randint(1, 12)):
            r = rng.random()
            if r < 0.62:
                out.append(f"<p>{said(1, 6) if rng.random() < 0.2 else said(8, 110)}</p>")
            elif r < 0.7:
                out.append(f"<h{(h := rng.randint(2, 4))}>{said(1, 8)}</h{h}>")
            elif r < 0.76:
                out.append("<ul>" + "".join(f"<li>{said(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.8:
                out.append(f"<blockquote>{rng.choice(['<p>%s</p>', '%s']) % said(6, 40)}</blockquote>")
            elif r < 0.84:
                out.append(f"<p>{said(6, 40)} <a href=/y>{said(1, 4)}</a> {said(2, 20)} <em>{said(1, 3)}</em></p>")
            elif r < 0.87:
                out.append(f"<pre><code>{said(3, 30)}</code></pre>")
            elif r < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{said(1, 5)}</td><td>{said(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.92:
                out.append(f"<figure><img src=x><figcaption>{said(3, 15)}</figcaption></figure>")
            elif r < 0.95:
                out.append(f"<p><b>{said(1, 9)}<br><p>{said(8, 60)}</p>")
            else:
                out.append(part(rng.choice(["advert", "share", "notice", "form", "sidebar"])))
        return "".join(out)

    tags, names = HOLDERS
    tag = rng.choice(tags.split())
    main = f'{marks[1]}<{tag}{named(names) if tag in ("div", "section") or rng.random() < 0.4 else ""}>{body()}</{tag}>'
    for _ in range(rng.choice([0, 0, 1, 2])):
        wrap = rng.choice(["div", "div", "main", "section"])
        main = f"<{wrap}{named('wrapper container page row column content main inner layout grid')}>{main}</{wrap}>"
    before = [part(k) for k in rng.sample(["menu", "header", "notice", "advert", "form", "menu"], rng.randint(1, 4))]
    after = [part(k) for k in rng.sample(["footer", "comments", "sidebar", "share", "advert", "notice", "form", "footer"], rng.randint(1, 5))]
    if rng.random() < 0.25:
        main = f"<div{named('wrapper container page row layout grid')}>{main}{part('sidebar')}{part('comments') if rng.random() < 0.4 else ''}</div>"
    marked = f"<!DOCTYPE html><html><head><title>{said(2, 8)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
    pieces = re.split("([\x00\x01])", marked)
    html, labels = pieces[0], {}
    for mark, piece in zip(pieces[1::2], pieces[2::2], strict=True):
        labels[len(html)] = ord(mark)
        html += piece
    return html, labels


def told_by_tags(html: str) -> Page | None:
    """A page whose only <article> or <main> tells its labels, or None."""
    page = parse(html)
    for tag in ("article", "main"):
        if page.tag.count(tag) == 1:
            page.label[page.tag.index(tag)] = 1
            for i, t in enumerate(page.tag):
                if t in ("nav", "aside", "footer", "form"):
                    page.label[i] = 0
            return page
    return None


def fit(pages: DataFrame, most: int = PAGES) -> Model:
    """The model from composed pages and a bounded sample of pages (page_id, html)."""
    known = pages.filter("page_id is not null and html is not null").filter(F.octet_length("html") <= PAGE_BYTES)
    # the ids first: each task sends its first ids to the driver, not its first pages
    ids = [r.page_id for r in known.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(most).collect()]
    sample = known.filter(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).select("html").collect()
    rng = Random(11)
    found = [parse(*compose(rng)) for _ in range(COMPOSED)]
    return learn(found + [p for r in sorted(sample) if (p := told_by_tags(r.html))])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages) if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
