"""Operator 4, HTML extraction: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, each with its word count and link density, those of its
neighbours, and what kind of element holds it. A decision tree, trained on the small labelled table
below, tells the article's blocks from the rest; the tree is one Spark conditional expression. Each
labelled page is learned from twice, as it is and with all elements taken for plain ones, and any
question may be asked at any level. Where a leaf has seen few blocks, the element is asked too.
"""

from __future__ import annotations

import collections
import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|[^<]+|<""", re.S)
#: Fixed values of HTML: elements whose content is no text, elements without content, elements inside a line.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title", "canvas", "math", "audio", "video"}
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "address"}
ARTICLE = {"article", "main"}
WHOLE = {"html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsored|promo|promotion|banner|cookies?|consent|notice|popup|modal|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widget|footer|header|masthead|comments?|replies|reply|disqus|share|sharing|social|related|recommended|subscribe|subscription|newsletter|signup|login|search|pagination|pager|copyright|toolbar|skip)(?:$|[\s_-])", re.I)
#: Of an article only these: readers' comments and adverts are articles too.
ARTICLE_HINT = re.compile(r"^(?:ads?|adverts?|advertisement|sponsored|promo|promotion|comments?|reply|replies|related|recommended|teaser)(?:$|[_-])", re.I)
#: A page with a sidebar is none.
ABOUT = ("with-", "has-", "no-", "without-", "hide-", "show-")
ROLE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: What the tree may ask: words and link densities of a block and its neighbours (0 where there is none), whether it is a heading, and two of the elements around it.
TEXT_FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after"]
ELEMENT_FEATURES = ["in_article", "in_shell"]
FEATURES = [*TEXT_FEATURES, "heading", *ELEMENT_FEATURES]
#: Questions one below the other, blocks on either side of one, and blocks that a leaf must have seen to be sure without the element.
DEPTH, LEAST_BLOCKS, SURE = 10, 6, 100
#: An element that holds this share of a page's words is no shell, whatever its name.
MOST = 0.5
BLOCK = "array<struct<text:string,words:int,link_density:double,words_before:int,link_density_before:double,words_after:int,link_density_after:double,heading:int,in_article:int,in_shell:int,label:int>>"

#: The labelled table, to which made_page() adds: small pages, y="1" on what holds the article and y="0" on the rest.
LABELLED = [
    '<body><nav y="0"><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li></ul></nav><div class="ad" y="0">Buy two lamps and get a third one for nothing today.</div><article y="1"><h1>A long walk by the river</h1><p>We left the town before the sun was up and followed the water for many hours.</p><p>Short.</p><p>Later the path turned away from the river and climbed a low hill with old trees.</p></article><footer y="0">&copy; Example press, all rights reserved.</footer></body>',
    '<body><header y="0"><a href="/">The daily page</a></header><main y="1"><h2>Bread</h2><p>Mix <a href="/f">flour</a> and water, then wait.</p><ul><li>One pound of flour</li><li>Salt</li></ul><p>Bake until the crust is brown and the loaf sounds hollow when tapped from below.</p></main><aside y="0"><h3>Related</h3><p>How to bake rolls in a small oven at home</p></aside><footer y="0"><p>Write to us at the address on this page.</p></footer></body>',
    '<body><div class="menu" y="0"><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div><div class="content" y="1"><h1>Notes on stone walls</h1><p>A dry wall has no mortar and stands by the weight of its stones and the skill of its builder.</p><p>Frost moves it little because water runs through the gaps between the stones.</p></div><div class="comments" y="0"><p>Great piece, I built one of these with my father last year and it still stands.</p><p>Thanks!</p></div></body>',
    '<body><div id="cookie-notice" y="0">We use cookies to give you the best experience on this site, read more in our policy.</div><article y="1"><p>The council met on Monday and spoke about the new bridge for three hours.</p><p>No vote was held.</p></article><form y="0"><p>Leave your mail to get our letter each week</p></form><div class="share" y="0"><a href="/s">Share this</a></div></body>',
    '<body><article y="1"><h1>Stars</h1><p>On clear nights the band of the galaxy is visible from the valley, far from any lamp.</p><p>See also <a href="/x">the chart</a>.</p><div class="ad" y="0">A new telescope for less money, order now.</div><p>Take a blanket.</p></article><div class="sidebar" y="0"><p>Most read stories of this week in a list</p></div></body>',
    '<body><header y="0"><p>The paper of the northern coast, printed each morning since the year the harbour was built by the town.</p></header><article y="1"><h1>Tides</h1><p>The moon pulls the sea up the beach two times each day, and the sun helps or hinders it.</p><p>Mind the gap.</p><ul><li>Spring tide</li><li><a href="/n">Neap tide</a></li></ul></article><footer y="0"><p>&copy; The northern coast paper, all rights kept, printed on the old machine by the quay and sent by van.</p><p>Contact</p></footer></body>',
    '<body><nav y="0"><p>Here you find all parts of this site, from the front page to the archive of older stories.</p><a href="/m">Map</a></nav><article y="1"><h1><a href="/t">On chairs</a></h1><p>Yes.</p><p>A chair with three legs never rocks, whatever the floor is like, since three points lie in one plane.</p></article><aside y="0"><p>Writers of this site have also made a book of tables, which you can find in every good shop of the town.</p></aside><footer y="0">Made by people who like wood and who answer each letter that they get within two or three days or so.</footer></body>',
    '<body><form y="0"><p>Tell us what you think of this page and we will write back to you as soon as we have read it.</p></form><main y="1"><p>Bees find their way home by the sun and by the marks that they learned on the first flights out.</p><p>They dance.</p></main><div class="advert" y="0">The best honey of the region is now sold at half the price in all shops near the market until Sunday.</div><section class="comments" y="0"><p>I kept bees for ten years and they never once came home late, what a fine piece this is, thank you.</p></section></body>',
    '<body><div class="banner" y="0"><p>Today only: read all stories of this site for one coin, and keep reading for a month after that.</p></div><div y="1"><h2>Ink</h2><p>Old ink was made of galls, iron and gum, and it turned dark only after the page had dried in air.</p><p>It bites.</p><p>Paper suffers when too much iron is in the ink, so that old letters have holes where words had been.</p></div><div class="newsletter" y="0"><p>Give us your address and we send you one letter a week with all that happened on these pages.</p></div></body>',
    '<body><div y="0"><ul><li><a href="/1">Sport</a></li><li><a href="/2">Weather</a></li><li><a href="/3">Stocks</a></li></ul></div><div y="1"><p>Rain fell through the night and the streets near the harbour were under water at dawn.</p><p>Pumps ran all day.</p></div><div y="0"><a href="/p">Previous</a> <a href="/n">Next</a></div></body>',
    '<body><main y="1"><h1>Clocks</h1><nav y="0"><a href="#a">Dials</a> <a href="#b">Weights</a></nav><p>A clock with a pendulum loses time in summer, when the rod grows longer with the heat of the day.</p><p>So.</p><aside y="0"><p>Readers of this page also bought a book of clocks, which is sold out in most towns by now.</p></aside><p>Brass and steel rods side by side cancel that.</p><form y="0"><p>Tell us which clock you have at home and when it was last cleaned by a clockmaker.</p></form><footer y="0"><p>Written by the keeper of the tower, who may be reached at noon.</p></footer></main></body>',
    '<body><article y="1"><header y="0"><p>Filed under gardens, on a Tuesday in spring</p></header><h1>Hedges</h1><p>Cut a hedge narrow at the top, so that light reaches the lowest twigs and they do not go bare.</p><p>Twice a year is enough.</p></article><section y="0" class="replies"><article class="comment" y="0"><p>I cut mine three times and it looks better than ever, thanks for all these pages.</p></article><article class="comment" y="0"><p>Nice.</p></article></section></body>',
    '<body><article y="1"><p>Four maps of the coast are known from before the harbour was built, and all of them can be seen in the library.</p><ul><li><a href="/1">The map of the abbey</a></li><li><a href="/2">The pilot chart</a></li><li><a href="/3">The tax map</a></li><li><a href="/4">The small chart</a></li><li><a href="/5">Soundings</a></li><li><a href="/6">Lights</a></li><li><a href="/7">Buoys</a></li></ul></article><div y="0"><ul><li><a href="/x">Lamps</a></li><li><a href="/y">Ropes and nets</a></li><li><a href="/z">Old boats</a></li></ul></div></body>',
    '<body><div y="0"><a href="/h">Home</a> <a href="/a">About us</a> <a href="/c">Contact</a></div><div y="1"><p>The ferry leaves twice a day, and in winter only if the ice in the bay is thin enough for its bow.</p><p>Wait.</p><p>Cars go first.</p><p>Walkers stand on the upper deck</p></div></body>',
    '<body><div y="1"><h2>Wells</h2><p>Dig where the grass is green in August.</p><p>Line it with stones, from the bottom up, without mortar, so that water can come in from the sides.</p><p>Look at <a href="/s">a sketch</a> of one before.</p><p>Done.</p></div><div y="0"><p><a href="/2">Next page</a></p><p><a href="/all">All pages of this part</a></p></div></body>',
]


#: Words and number of the pages that made_page() adds to the table.
FILL = "the river carried old boats past a mill where people of the town had kept bees and bread for many winters while snow lay on hills and no road led north".split()
MADE = 180


def made_page(seed: int) -> str:
    """A labelled page with links, an advert, an article and perhaps a sidebar and a footer; half of the pages name their elements, the other half have plain boxes."""
    rng, bare = random.Random(seed), seed % 2
    say = lambda lo, hi: " ".join(rng.choice(FILL) for _ in range(rng.randint(lo, hi)))
    links = lambda n, most: "".join(f'<li><a href="/{i}">{say(1, most)}</a></li>' for i in range(n))
    box = lambda tag, inner, y: f'<{"div" if bare else tag} y="{y}">{inner}</{"div" if bare else tag}>'
    kinds = [lambda: f"<p>{say(25, 160)}</p>", lambda: f"<p>{say(1, 24)}</p>", lambda: f"<ul><li>{say(2, 9)}</li><li>{say(2, 9)}</li></ul>", lambda: f"<ul>{links(rng.randint(2, 4), 4)}</ul>"]
    heads = [lambda: f"<h1>{say(1, 8)}</h1>", lambda: f"<h1>{say(4, 24)}</h1>", lambda: f"<h1>{say(12, 60)}</h1>", lambda: f"<p>{say(12, 40)}</p>"]
    ends = [lambda: say(1, 4), lambda: say(5, 24), lambda: say(25, 120)]
    out = box("nav", f"<ul>{links(rng.randint(1, 9), 3)}</ul>", 0) if rng.random() < 0.8 else ""
    if rng.random() < 0.7:
        out += f'<div class="{"" if bare else "ad"}" y="0">{say(3, rng.choice([14] * 6 + [24]))}</div>'
    body = [f() for f in rng.choices(kinds, [65, 20, 10, 5], k=rng.randint(2, 8))]
    out += box("article", f"{rng.choices(heads, [50, 35, 5, 10])[0]()}{''.join(body)}<p>{rng.choices(ends, [35, 35, 30])[0]()}</p>", 1)
    if rng.random() < 0.4:
        out += box("aside", f"<ul>{links(rng.randint(2, 6), 5)}</ul>", 0)
    if rng.random() < 0.5:
        out += box("footer", f"<p>{say(5, 30)}</p>", 0)
    return f"<body>{out}</body>"


def boiler_name(attributes: str, hint: re.Pattern) -> bool:
    """Whether a class, id or role among these attributes says that the element is no text of the article."""
    names = (n for x in ROLE.findall(attributes) for n in (x[0] or x[1] or x[2]).split())
    return any(hint.search(n) and not n.lower().startswith(ABOUT) for n in names)


def blocks(page: str) -> list[tuple]:
    """(text, words, link words, in_article, hinted elements that hold it, in_boiler, label, heading) for each block of text, in page order."""
    out: list[tuple] = []
    stack: list[tuple[str, int, tuple, int, int]] = []  # tag, then what holds inside it: article, hinted elements, boiler, label
    n_hinted = 0
    text, link = [], 0
    linked: list[str] = []

    def flush() -> None:
        nonlocal link
        words = "".join(text).split()
        if words:
            tag, *state = stack[-1] if stack else ("", 0, (), 0, -1)
            out.append((" ".join(words), len(words), len("".join(linked).split()), *state, int(tag in HEADINGS)))
        text.clear()
        linked.clear()

    at = 0
    while m := TOKEN.match(page, at):
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                s = html.unescape(m[0])
                text.append(s)
                if link:
                    linked.append(s + " ")
            continue
        tag = tag.lower()
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):  # what is inside is no markup; without an end tag it goes on to the page's end
                end = END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = 0 if m[1] else 1
        hinted = not m[1] and tag not in VOID and tag not in WHOLE and "=" in m[3] and boiler_name(m[3], ARTICLE_HINT if tag in ARTICLE else HINT)
        if tag in INLINE and not (hinted and tag == "span"):
            if tag == "br":
                text.append(" ")
                linked.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if m[1]:
            link = 0 if tag not in INLINE else link
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if opened >= 0:
                del stack[opened:]
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] == tag in ("li", "tr", "td", "th", "dt", "dd", "option")):
            stack.pop()
        a, held, b, y = stack[-1][1:] if stack else (0, (), 0, -1)
        given = re.search(r'\by="([01])"', m[3])
        n_hinted += hinted
        stack.append((tag, int(a or tag in ARTICLE), (*held, n_hinted) if hinted else held, int(b or tag in BOILER), int(given[1]) if given else y))
    flush()
    return out


def described(page: str) -> list[dict]:
    """BLOCK entries of a page."""
    found = blocks(page)
    total, inside = sum(b[1] for b in found), collections.Counter()
    for b in found:
        inside.update(dict.fromkeys(b[4], b[1]))
    wrappers = {h for h, n in inside.items() if n > MOST * total}
    shell = [bool(b[5] or set(b[4]) - wrappers) for b in found]
    articles = any(b[3] and not s for b, s in zip(found, shell))  # then all that is outside them is shell
    words, density = [0, *(b[1] for b in found), 0], [0.0, *(b[2] / b[1] for b in found), 0.0]
    return [
        {"text": b[0], "words": b[1], "link_density": density[i], "words_before": words[i - 1], "link_density_before": density[i - 1], "words_after": words[i + 1], "link_density_after": density[i + 1], "heading": b[7], "in_article": int(b[3] and not s), "in_shell": int(s or (articles and not b[3])), "label": b[6]}
        for i, (b, s) in enumerate(zip(found, shell), 1)
    ]


def grow_tree(x: np.ndarray, y: np.ndarray, level: int = 0) -> dict:
    """A binary tree by Gini impurity over rows of FEATURES: {'y': label} or {'f': feature, 't': threshold, 'le': tree, 'gt': tree}."""
    n, ones = len(y), int(y.sum())
    leaf = {"y": int(2 * ones >= n)}
    best = (1e-9, None)
    gini = lambda n, p: 2 * p * (n - p) / n
    if level < DEPTH and 0 < ones < n:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            value, left = x[order, f], np.cumsum(y[order])
            cut = np.arange(LEAST_BLOCKS, n - LEAST_BLOCKS + 1)
            cut = cut[value[cut - 1] < value[np.minimum(cut, n - 1)]]
            if len(cut):
                gain = gini(n, ones) - gini(cut, left[cut - 1]) - gini(n - cut, ones - left[cut - 1])
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-12:
                    best = (gain[at], (f, float(value[cut[at] - 1] + value[cut[at]]) / 2))
    if best[1] is None:
        if n >= SURE:
            return leaf
        return {"f": "in_shell", "t": 0.5, "le": {"f": "in_article", "t": 0.5, "le": leaf, "gt": {"y": 1}}, "gt": {"y": 0}}
    f, t = best[1]
    low = x[:, f] <= t
    return {"f": FEATURES[f], "t": t, "le": grow_tree(x[low], y[low], level + 1), "gt": grow_tree(x[~low], y[~low], level + 1)}


@lru_cache(1)
def train() -> dict:
    """The tree of the labelled table."""
    found = [b for p in [*LABELLED, *map(made_page, range(MADE))] for b in described(p) if b["label"] >= 0]
    rows = np.array([[b[f] for f in FEATURES] for b in found], float)
    plain = rows.copy()
    plain[:, -len(ELEMENT_FEATURES) :] = 0
    return grow_tree(np.concatenate([rows, plain]), np.tile([b["label"] for b in found], 2))


def tree_column(tree: dict, block: Column) -> Column:
    if "y" in tree:
        return F.lit(bool(tree["y"]))
    return F.when(block[tree["f"]] <= tree["t"], tree_column(tree["le"], block)).otherwise(tree_column(tree["gt"], block))


def extract(pages: DataFrame, column: str = "html", tree: dict | None = None) -> DataFrame:
    """pages with blocks (all, with their features) and text (the article's blocks joined by a newline).

    A null or empty page has no blocks and the text ''. Blocks that repeat stay. Columns named
    blocks or text are replaced. Pages are whole; nothing is shuffled.
    """
    tree = train() if tree is None else tree

    @F.pandas_udf(BLOCK)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([described(x or "") for x in s], dtype=object)

    out = pages.withColumn("blocks", parse(F.col(column)))
    kept = F.transform(F.filter("blocks", lambda b: tree_column(tree, b)), lambda b: b["text"])
    return out.withColumn("text", F.array_join(kept, "\n"))
