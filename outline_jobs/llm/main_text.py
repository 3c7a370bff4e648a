"""Main text of web pages by a tree-structured graphical model.

Every block of a page is a node with a hidden label, content or not. Unary potentials are log-linear in what the block shows (element,
names in class, id and role, own text, links, place on the page); a table of parent-child potentials joins every block to the block
around it. Sum-product messages passed upward, then downward, give the exact marginal of every block; text of blocks whose
marginal is at least one half is kept. The weights maximise the likelihood of labelled pages: those of labelled_pages(), layouts with
a known article, made by rule from a seed, or any pages whose blocks carry data-label="1" or "0".

Defined cases. Null and empty pages give an empty text. Pages without any block that looks like content give an empty text, never the whole
page. Repeated rows have equal results. Markup cut off at the end of a page is dropped, open elements end there. Empty tables give empty results; extra
columns are kept by extracted().
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.dom import Block, read
from outline_jobs.llm.common import apart, table

PAGES, ROUNDS, RATE, DECAY, SEED = 300, 120, 0.15, 1e-3, 3

#: Elements by kind. Fixed values.
KINDS = {
    "top": "html body", "box": "div section center details dialog hgroup search", "main": "main", "article": "article", "nav": "nav menu dir", "aside": "aside",
    "header": "header", "footer": "footer address", "form": "form fieldset legend", "list": "ul ol dl", "item": "li dd dt", "h1": "h1", "heading": "h2 h3 h4 h5 h6 summary",
    "p": "p", "quote": "blockquote pre", "figure": "figure figcaption", "table": "table tbody thead tfoot tr caption", "cell": "td th", "rule": "hr",
}
KIND = {t: k for k, ts in enumerate(KINDS.values()) for t in ts.split()}
#: Parts of names by what they tell of a block. Fixed values.
CUES = {
    "content": "article content post entry story main body text", "menu": "nav menu breadcrumb crumb toolbar tabs pager pagination", "head": "header masthead topbar logo branding",
    "foot": "footer copyright legal colophon", "side": "sidebar side aside widget rail related recommend popular trending more", "notice": "cookie consent notice banner alert gdpr popup modal overlay message",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner", "form": "form search login signup subscribe newsletter contact", "comment": "comment comments reply replies discussion disqus respond reader",
    "share": "share social follow tags meta byline author date",
}
CUE_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(CUES.values()):
    for _w in _words.split():
        CUE_OF.setdefault(_w, []).append(_k)
ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "main": "content", "article": "content", "dialog": "notice", "alert": "notice"}

_BINS = {"chars": (1, 20, 60, 150, 400), "linked": (0.01, 0.3, 0.7), "stops": (0.5, 1.5, 4.5), "place": (0.08, 0.25, 0.75, 0.92), "depth": (2, 3, 4, 6), "children": (1, 2, 5, 12)}
_OFFSET = {}
_n = 1 + len(KINDS) + len(CUES)
for _name, _cut in _BINS.items():
    _OFFSET[_name] = _n
    _n += len(_cut) + 1
FLAGS = ("hidden", "inputs", "copyright", "in_list", "after_h1", "no_names")
_OFFSET["flags"] = _n
SIZE = _n + len(FLAGS)


def cues_of(attrs: dict[str, str]) -> set[int]:
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()
    found = {c for w in re.split(r"[^a-z]+", names) for c in CUE_OF.get(w, CUE_OF.get(w.removesuffix("s"), ()))}
    role = ROLES.get(attrs.get("role", "").lower())
    return found | ({list(CUES).index(role)} if role else set())


def features(blocks: list[Block]) -> np.ndarray:
    """0/1 inputs of every block."""
    x = np.zeros((len(blocks), SIZE), np.float32)
    x[:, 0] = 1
    h1 = next((i for i, b in enumerate(blocks) if b.tag == "h1"), len(blocks))
    for i, b in enumerate(blocks):
        x[i, 1 + KIND.get(b.tag, 1)] = 1
        cues = cues_of(b.attrs)
        for c in cues:
            x[i, 1 + len(KINDS) + c] = 1
        joined = " ".join(b.text)
        stops = sum(joined.count(c) for c in ".!?")
        for name, value in (("chars", b.chars), ("linked", b.linked / max(b.chars, 1)), ("stops", stops), ("place", i / len(blocks)), ("depth", b.depth), ("children", b.children)):
            x[i, _OFFSET[name] + sum(value >= c for c in _BINS[name])] = 1
        hidden = "hidden" in b.attrs or b.attrs.get("aria-hidden") == "true" or "display:none" in b.attrs.get("style", "").replace(" ", "")
        flags = (hidden, b.inputs > 0, "©" in joined, b.tag in ("li", "ul", "ol"), i > h1, not cues)
        x[i, _OFFSET["flags"] : _OFFSET["flags"] + len(FLAGS)] = flags
    return x


@dataclass
class Forest:
    """Trees side by side: parents come before children."""

    x: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray

    @classmethod
    def of(cls, pages: list[list[Block]]) -> Forest:
        first = np.cumsum([0, *map(len, pages)])[:-1]
        parent = np.concatenate([[b.parent + o if b.parent >= 0 else -1 for b in p] for p, o in zip(pages, first)])
        flat = [b for p in pages for b in p]
        return cls(np.concatenate([features(p) for p in pages]), parent.astype(np.intp), np.array([b.depth for b in flat]), np.array([KIND.get(b.tag, 1) for b in flat]))


@dataclass
class Model:
    unary: np.ndarray  # weights of the inputs for the label content
    edge: np.ndarray  # kind of child, label of parent, label of child


def marginals(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over all trees at once, level by level: P(label of a block) and P(label of parent, label of block)."""
    own = np.zeros((len(f.x), 2))
    own[:, 1] = f.x @ m.unary
    edge = m.edge[f.kind]
    order = np.argsort(f.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(f.depth[order])) + 1)
    up, below = np.zeros_like(own), own.copy()
    for here in reversed(levels[1:]):
        up[here] = np.logaddexp(edge[here, :, 0] + below[here, None, 0], edge[here, :, 1] + below[here, None, 1])
        np.add.at(below, f.parent[here], up[here])
    above, joint = np.zeros_like(own), np.zeros((len(own), 2, 2))
    for here in levels[1:]:
        rest = above[f.parent[here]] + below[f.parent[here]] - up[here]
        both = rest[:, :, None] + edge[here] + below[here][:, None, :]
        above[here] = np.logaddexp(rest[:, 0, None] + edge[here, 0], rest[:, 1, None] + edge[here, 1])
        top = both.max(axis=(1, 2), keepdims=True)
        joint[here] = np.exp(both - top)
        joint[here] /= joint[here].sum(axis=(1, 2), keepdims=True)
    belief = above + below
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def fit(pages: list[tuple[list[Block], list[int]]]) -> Model:
    """Gradient ascent (Adam) on the likelihood: counts under the labels less expected counts under the marginals."""
    f = Forest.of([b for b, _ in pages])
    y = np.concatenate([lab for _, lab in pages])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[f.parent[child]], y[child]] = 1
    m = Model(np.zeros(SIZE), np.zeros((len(KINDS), 2, 2)))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (m.unary, m.edge)]
    for step in range(1, ROUNDS + 1):
        p, joint = marginals(f, m)
        ge = np.zeros_like(m.edge)
        np.add.at(ge, f.kind[child], seen[child] - joint[child])
        for w, g, mo in zip((m.unary, m.edge), (f.x.T @ (y - p), ge), moments):
            g = g / len(pages) - DECAY * w
            mo[0] = 0.9 * mo[0] + 0.1 * g
            mo[1] = 0.99 * mo[1] + 0.01 * g**2
            w += RATE * (mo[0] / (1 - 0.9**step)) / (np.sqrt(mo[1] / (1 - 0.99**step)) + 1e-8)
    return m


def labels_of(blocks: list[Block]) -> list[int]:
    """The data-label of each block, or of the nearest block around it that has one."""
    out: list[int] = []
    for b in blocks:
        out.append(int(b.attrs["data-label"]) if b.attrs.get("data-label") in ("0", "1") else out[b.parent] if b.parent >= 0 else 0)
    return out


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages of varied layouts with data-label on their parts; words are invented, so that only structure tells content."""
    return [_page(random.Random(f"{seed}/{k}")) for k in range(n)]


def _page(r: random.Random) -> str:
    said = lambda a, b: " ".join("".join(r.choice(("ba", "le", "ti", "no", "ras", "er", "um", "is", "on", "qua", "é", "ü")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(said(3, 14).capitalize() + r.choice((".", ".", ".", "!", "?")) for _ in range(r.randint(1, 6)))
    noise = r.random() < 0.12
    dirty = lambda s: " ".join(w + r.choice(("%%%", "***", "###", "$$$")) for w in s.split()) if noise else s
    link = lambda: f'<a href="/{said(1, 1)}">{said(1, 3)}</a>'
    named = lambda *names: r.choice(("", *(f' class="{n}"' for n in names), *(f' id="{n}"' for n in names), f' class="{r.choice(names)} x{r.randint(1, 99)}"'))
    surely = lambda *names: r.choice((*(f' class="{n}"' for n in names), *(f' id="{n}"' for n in names)))
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.7 else " ".join(link() for _ in range(r.randint(2, 9)))
    few = lambda: r.choice((prose(), said(2, 9), f"{said(2, 8)} {link()}", f"<p>{prose()}</p>"))
    off = ' data-label="0"'
    menu = lambda: r.choice((f"<nav{off}{named('nav', 'menu')}>{links()}</nav>", f"<div{off}{surely('nav', 'menu', 'navbar', 'breadcrumb', 'main-menu')}>{links()}</div>", f"<ul{off}{surely('nav', 'menu')}>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>"))
    head = lambda: r.choice((f"<header{off}{named('header', 'masthead', 'site-header')}>{r.choice((said(1, 4), f'<h1>{said(1, 3)}</h1>', f'<p>{said(2, 8)}</p>', menu()))}{r.choice(('', menu()))}</header>", f"<div{off}{surely('header', 'masthead', 'topbar', 'page-header')}>{few()}</div>"))
    foot = lambda: r.choice((f"<footer{off}{named('footer', 'site-footer')}>{r.choice(('&copy; ', ''))}{few()}</footer>", f"<div{off}{surely('footer', 'copyright', 'legal')}>&copy; {few()}</div>", f"<footer{off}><p>{said(3, 12)}</p>{links()}</footer>"))
    side = lambda: r.choice((f"<aside{off}{named('sidebar', 'related', 'widget')}>{r.choice(('', f'<h3>{said(1, 4)}</h3>'))}{r.choice((links(), few()))}</aside>", f"<div{off}{surely('sidebar', 'related', 'widget', 'side', 'popular')}><h3>{said(1, 3)}</h3>{r.choice((links(), few()))}</div>"))
    note = lambda: f"<{(t := r.choice(('div', 'div', 'section', 'p', 'aside')))}{off}{surely('cookie', 'cookie-notice', 'consent', 'banner', 'notice', 'alert', 'popup', 'gdpr')}>{prose() if t == 'p' else few()}</{t}>"
    advert = lambda: f"<{(t := r.choice(('div', 'div', 'aside', 'section', 'p')))}{off}{surely('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot')}>{prose() if t == 'p' else few()}</{t}>"
    form = lambda: f"<form{off}{named('search', 'newsletter', 'login', 'subscribe')}>{r.choice((said(2, 8), f'<p>{prose()}</p>', f'<label>{said(1, 4)}</label>'))}<input name=q><button>{said(1, 1)}</button></form>"

    def comments() -> str:
        one = r.choice((lambda: f"<li>{r.choice(('', f'<b>{said(1, 2)}</b> '))}{prose()}</li>", lambda: f"<div{named('comment', 'reply')}><p>{prose()}</p></div>", lambda: f"<article{named('comment')}><p>{prose()}</p></article>", lambda: f"<p{named('comment')}>{prose()}</p>"))
        body = "".join(one() for _ in range(r.randint(1, 6)))
        t = r.choice(("div", "section", "ol" if "<li>" in body else "div", "aside"))
        return f"<{t}{off}{surely('comments', 'comment-list', 'discussion', 'replies', 'reader-comments', 'disqus')}>{r.choice(('', f'<h3>{said(1, 3)}</h3>')) if t != 'ol' else ''}{body}</{t}>"

    def part() -> str:
        return r.choices((
            f"<p>{dirty(prose())}</p>", f"<p>{said(1, 3).capitalize()}.</p>", f"<p><b>{prose()}<br><p>{dirty(prose())}</p>", f"<h2>{said(1, 6)}</h2><p>{prose()}</p>", f"<p>{prose()} {link()} {prose()}</p>",
            "<ul>" + "".join(f"<li>{said(2, 14)}</li>" for _ in range(3)) + "</ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<blockquote>{prose()}</blockquote>", f"<div>{prose()}</div>",
            "<table>" + "".join(f"<tr><td>{said(1, 3)}</td><td>{said(1, 3)}</td></tr>" for _ in range(3)) + "</table>", f"<figure><img src=x><figcaption>{said(3, 12)}</figcaption></figure>", f"<pre>{said(3, 12)}</pre>",
        ), (12, 3, 3, 2, 2, 1, 0.5, 0.5, 1, 0.5, 0.5, 0.3))[0]

    parts = [part() for _ in range(r.randint(1, 12))]
    inside = [advert, note, form, side, lambda: f"<div{off}{surely('share', 'social', 'tags', 'meta', 'byline')}>{r.choice((links(), said(2, 6)))}</div>"]
    if r.random() < 0.35:
        parts.insert(r.randrange(len(parts) + 1), r.choice(inside)())
    if r.random() < 0.15:
        parts.append(comments())
    title = r.choice(("", f"<h1>{said(2, 9)}</h1>", f"<h1>{said(2, 9)}</h1>", f"<h1>{said(2, 9)}</h1>", f"<h2>{said(2, 9)}</h2>"))
    on = ' data-label="1"'
    t, name = r.choice((("article", named("post", "entry")), ("article", ""), ("main", named("content")), ("div", surely("content", "article", "post", "entry-content", "story", "main", "article-body")), ("section", surely("content", "article-body", "story"))))
    main = f"<{t}{on}{name}>{title}{''.join(parts)}</{t}>"
    if r.random() < 0.4:
        w = r.choice(("div", "main", "section"))
        main = f"<{w}{on}{named('wrapper', 'container', 'page', 'layout')}>{r.choice(('', menu(), advert()))}{main}{r.choice(('', side(), comments(), form()))}</{w}>"
    before = [x() for x in (menu, head, note, advert, form) if r.random() < 0.4]
    after = [x() for x in (comments, side, advert, form, note) if r.random() < 0.35] + [foot() for _ in range(r.random() < 0.8)]
    r.shuffle(before)
    out = f'<!DOCTYPE html><html><head><title>{said(2, 6)}</title><style>p{{margin:0}}</style></head><body data-label="1">{"".join(before)}{main}{"".join(after)}</body></html>'
    return out[: r.randrange(len(out) // 2, len(out))] if r.random() < 0.1 else out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of labelled_pages(); a few seconds, once in a driver."""
    pages = [read(p)[0] for p in labelled_pages()]
    return fit([(b, labels_of(b)) for b in pages])


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    done = [read(p) for p in pages]
    if not done:
        return []
    p, _ = marginals(Forest.of([b for b, _ in done]), model)
    out, first = [], 0
    for blocks, runs in done:
        out.append("\n".join(t for b, t in runs if p[first + b] >= 0.5))
        first += len(blocks)
    return out


def extracted(pages: DataFrame, model: Model | None = None, source: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of their column `source`; an own column that is called as the result, in any case, is called own_...."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a fixed size, whatever the input

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        found = []
        for i in range(0, len(html), 64):
            found += main_texts([x if isinstance(x, str) else None for x in html[i : i + 64]], shared.value)
        return pd.Series(found, dtype=object)

    rows, names = apart(pages, (to,))
    at = dict(zip((c.lower() for c in pages.columns), names))[source.lower()]
    return rows.withColumn(to, text(F.col(f"`{at}`")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
