"""Main-text extraction: boosted trees over block-node features, decoded over the tree.

No labelled pages exist, so the trees are fitted to pages drawn from a template generator that knows which blocks it
wrote as article and which as page furniture. Decoding picks the most likely set of kept nodes in which nothing is
kept below a dropped node.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted, fit
from .common import frugal, slices
from .dom import Node, attributes, clean, parse

#: Groups of attribute tokens (from class, id, role and similar), each one feature.
TOKENS = {
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager paging toc topbar skip tabs links sitemap index",
    "header": "header masthead head logo brand top title-bar banner",
    "footer": "footer foot copyright legal colophon bottom contentinfo credits",
    "side": "sidebar side aside rail widget widgets complementary related recommended popular trending teaser more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense adbox outbrain taboola banner-ad dfp commercial",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog banner-notice toast warning paywall disclaimer subscribe subscription newsletter signup",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses reader feedback thread",
    "form": "form login signin register search searchbox input contact field poll",
    "social": "share sharing social tweet follow facebook twitter tags tag meta byline author date",
    "content": "article content post entry main body story text maincontent page prose blog document copy",
}
GROUP = {t: n for n, words in enumerate(TOKENS.values()) for t in words.split()}
TAGS = ("nav header footer aside article main section form p h li list div cell quote pre figure caption button #text body other").split()
TAG_OF = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "menu": "list", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "table": "cell", "tr": "cell", "tbody": "cell", "thead": "cell", "tfoot": "cell", "blockquote": "quote", "figcaption": "caption", "select": "button", "option": "button", "legend": "button", "html": "body", "#root": "body", "fieldset": "form", "search": "form", "dialog": "aside"}
TAG_INDEX = {t: n for n, t in enumerate(TAGS)}
N_GROUPS = len(TOKENS)
SPLIT = re.compile(r"[^a-z]+")
END = re.compile(r"[.!?…。！？]")
#: What footers and headings over readers' comments say. Fixed values.
RIGHTS = re.compile(r"(?i)©|\(c\) ?\d{4}|copyright|all rights reserved")
ANSWERS = re.compile(r"(?i)\b(comments?|repl(y|ies)|responses?|discussion|kommentare?|commentaires?|comentarios?)\b")
N_FEATURES = len(TAGS) + 2 * N_GROUPS + 30


@functools.lru_cache(4096)
def groups_of(raw: str) -> tuple[int, ...]:
    """Which token groups the attributes of a tag name."""
    found = set()
    for k, v in attributes(raw).items():
        if k in ("class", "id", "role", "itemprop", "aria-label", "data-component", "name"):
            low = v.lower()
            for t in (*low.split(), *SPLIT.split(low)):
                if t in GROUP:
                    found.add(GROUP[t])
    return tuple(sorted(found))


class Flat:
    """The nodes of a page in page order: parents before children; runs of text are nodes too."""

    __slots__ = ("extra", "parent", "text", "x")

    def __init__(self, root: Node) -> None:
        nodes: list = []
        self.parent: list[int] = []
        todo: list = [(root, -1)]
        while todo:
            x, up = todo.pop()
            k = len(nodes)
            nodes.append(x)
            self.parent.append(up)
            if isinstance(x, Node):
                todo.extend((kid, k) for kid in reversed(x.kids))
        n = len(nodes)
        self.text: list[str | None] = [None] * n
        chars, linked, stops, blocks, paras = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        rights, answers, prose = [0] * n, [0] * n, [0] * n
        kids, tags, own, above = [0] * n, [""] * n, [()] * n, [frozenset()] * n
        depth = [0] * n
        order: list[list[int]] = [[] for _ in range(n)]
        for k, x in enumerate(nodes):
            up = self.parent[k]
            if up >= 0:
                kids[up] += 1
                order[up].append(k)
                depth[k] = depth[up] + 1
                above[k] = above[up]
            if isinstance(x, list):
                t = clean(x[0])
                self.text[k] = t
                tags[k] = "#text"
                chars[k], linked[k], stops[k] = len(t), min(x[1], len(t)), len(END.findall(t))
                rights[k] = int(len(t) < 300 and RIGHTS.search(t) is not None)
                answers[k] = int(len(t) < 60 and ANSWERS.search(t) is not None)
                prose[k] = chars[k] - linked[k] if stops[k] else 0
            else:
                tag = TAG_OF.get(x.tag, x.tag)
                tags[k] = tag if tag in TAG_INDEX else "other"
                own[k] = groups_of(x.attrs) if x.attrs else ()
                here = [g for g in own[k]]
                extra = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 7, "article": 9, "main": 9}.get(tags[k])
                if extra is not None:
                    here.append(extra)
                if here:
                    above[k] = above[k] | frozenset(here)
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            stops[up] += stops[k]
            blocks[up] += blocks[k] + 1
            paras[up] += paras[k] + (tags[k] == "p")
            rights[up] += rights[k]
            answers[up] += answers[k]
            prose[up] += prose[k]
        # nodes behind the end of an article (or main), and behind a heading over comments, in page order
        last = list(range(n))
        for k in range(n - 1, 0, -1):
            last[self.parent[k]] = max(last[self.parent[k]], last[k])
        closed = min((last[k] for k in range(n) if tags[k] in ("article", "main") and prose[k] * 3 > prose[0]), default=n)
        told = [n] * n  # by parent: the first brother that is, or begins with, such a heading
        for up, brothers in enumerate(order):
            for b in brothers:
                if answers[b] and chars[b] < 60:
                    told[up] = b
                    break
        total = max(1, chars[0])
        x = np.zeros((n, N_FEATURES), np.float32)
        base = len(TAGS) + 2 * N_GROUPS
        rows: list = [None] * n
        seen = [0] * n
        so_far = 0
        for k in range(n):
            seen[k] = so_far
            if self.text[k] is not None:
                so_far += chars[k]
        under = [False] * n
        rows[0] = (0, chars[0], linked[0], linked[0] / (chars[0] + 1), stops[0], stops[0] / (chars[0] + 1) * 100, blocks[0], chars[0] / (blocks[0] + 1), paras[0], kids[0], 1, 0, -1, -1, 1, 1, 0, chars[0], 0, 0, 0, 1, 0, 0, 0, 0, 0, prose[0], 0, 0)
        for up, brothers in enumerate(order):
            if not brothers:
                continue
            m = len(brothers)
            alike: dict[str, int] = {}
            for b in brothers:
                alike[tags[b]] = alike.get(tags[b], 0) + 1
            near, up_stops, up_links, up_paras = chars[up], stops[up], linked[up] / (chars[up] + 1), paras[up]
            sizes = [-1, *(chars[b] for b in brothers), -1]
            for i, k in enumerate(brothers):
                c = sizes[i + 1]
                under[k] = under[up] or k >= told[up]
                rows[k] = (
                    depth[k], c, linked[k], linked[k] / (c + 1), stops[k], stops[k] / (c + 1) * 100, blocks[k], c / (blocks[k] + 1), paras[k], kids[k], m, i / m, sizes[i], sizes[i + 2], c / total, c / (near + 1), seen[k] / total, near, up_stops, up_links, up_paras, alike[tags[k]] / m,
                    rights[k], rights[up], under[k], k > closed, last[k] == n - 1, prose[k], prose[k] / (prose[up] + 1), prose[brothers[i + 1]] if i + 1 < m else -1,
                )
                if above[up]:
                    for g in above[up]:
                        x[k, len(TAGS) + N_GROUPS + g] = 1
                if own[k]:
                    for g in own[k]:
                        x[k, len(TAGS) + g] = 1
        x[np.arange(n), [TAG_INDEX[t] for t in tags]] = 1
        x[:, base:] = rows
        self.x = x

    def kept(self, margin: np.ndarray) -> list[str]:
        """The text runs under the best choice of kept nodes; nothing is kept under a dropped node."""
        n = len(self.parent)
        keep = -np.logaddexp(0, -margin)
        drop = -np.logaddexp(0, margin)
        keep[0] = 0.0
        keep, down = keep.tolist(), drop.tolist()
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            keep[up] += max(keep[k], down[k])
            down[up] += down[k]
        chosen = [True] * n
        for k in range(1, n):
            chosen[k] = chosen[self.parent[k]] and keep[k] > down[k]
        return [t for k, t in enumerate(self.text) if t and chosen[k]]


class Template:
    """Draws pages with known labels: every text run of the article starts with KEEP, every other with DROP."""

    KEEP, DROP = "", ""

    def __init__(self, seed: int, foreign: bool = True) -> None:
        """foreign: with articles of links, comments and footers without telling names, bare and table layouts."""
        self.r, self.foreign = random.Random(seed), foreign

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("aeioustnrlmdc") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.12:
            out = [w + r.choice(("%%%", "***", "###", "$$$", "&amp;&amp;&amp;")) for w in out]
        elif style < 0.16:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.2:
            out = out[:1] * len(out)
        elif style < 0.24:
            out = " | ".join(out).split()
        elif style < 0.9:
            for i in range(0, len(out), r.randint(5, 14)):
                out[i] = (out[i].title() if i == 0 else out[i] + r.choice((".", ",", ".", "?")))
            out[-1] += r.choice((".", ".", ".", "!", ""))
        return " ".join(out)

    def say(self, mark: str, low: int, high: int) -> str:
        return mark + self.words(low, high)

    def named(self, *groups: str, neutral: float = 0.15) -> str:
        r = self.r
        if r.random() < neutral:
            return f' class="c{r.randint(1, 99)}"'
        token = r.choice(TOKENS[r.choice(groups)].split())
        form = r.choice(('{0}', '{0}', 'site-{0}', '{0}-box', 'l-{0} c{1}', '{0} block', 'js-{0}'))
        return f' {r.choice(("class", "class", "id"))}="{form.format(token, r.randint(1, 99))}"'

    def links(self, mark: str, low: int = 3, high: int = 9) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.say(mark, 1, 3)}</a>' for i in range(r.randint(low, high))]
        kind = r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if kind < 0.8:
            return " | ".join(items)
        return "".join(f"<div>{x}</div>" for x in items)

    def furniture(self, kind: str) -> str:
        r, d = self.r, self.DROP
        text = lambda low, high: r.choice((self.say(d, low, high), f"<p>{self.say(d, low, high)}</p>", f"<div>{self.say(d, low, high)}</div>"))
        if kind == "nav":
            tag = r.choice(("nav", "nav", "div", "ul-div"))
            return f"<nav>{self.links(d)}</nav>" if tag == "nav" else f"<div{self.named('navigation', neutral=0.05)}>{self.links(d)}</div>"
        if kind == "header":
            body = r.choice((f"<h1>{self.say(d, 1, 4)}</h1>", f"<a href='/'>{self.say(d, 1, 3)}</a>", "")) + r.choice((text(2, 9), self.links(d), ""))
            body = body or self.links(d)
            return f"<header{r.choice(('', self.named('header')))}>{body}</header>" if r.random() < 0.6 else f"<div{self.named('header', neutral=0)}>{body}</div>"
        if kind == "footer":
            body = r.choice(("&copy; ", "", "")) + r.choice((text(3, 30), self.links(d) + text(3, 20), self.say(d, 3, 40)))
            if self.foreign and r.random() < 0.25:  # nothing but the mark tells
                mark = r.choice(("&copy; {0} ", "(c) {0} ", "Copyright {0} ", "© ")).format(r.randint(1995, 2026))
                return f"<{(t := r.choice(('div', 'p', 'div')))}{r.choice(('', f' class=c{r.randint(1, 99)}'))}>{d}{mark}{self.words(1, 8)}</{t}>"
            return f"<footer{r.choice(('', self.named('footer')))}>{body}</footer>" if r.random() < 0.65 else f"<div{self.named('footer', neutral=0)}>{body}</div>"
        if kind == "side":
            body = r.choice((f"<h3>{self.say(d, 1, 4)}</h3>", "")) + r.choice((self.links(d), text(5, 40), text(5, 30) + self.links(d), text(20, 80)))
            return f"<aside{r.choice(('', self.named('side')))}>{body}</aside>" if r.random() < 0.5 else f"<{(t := r.choice(('div', 'section')))}{self.named('side', neutral=0)}>{body}</{t}>"
        if kind == "advert":
            return f"<{(t := r.choice(('div', 'div', 'p', 'aside', 'section')))}{self.named('advert', neutral=0)}>{r.choice((text(2, 30), self.say(d, 2, 25)))}</{t}>"
        if kind == "notice":
            return f"<{(t := r.choice(('div', 'div', 'section', 'aside', 'p')))}{self.named('notice', neutral=0)}>{r.choice((text(4, 40), self.say(d, 4, 30)))}{r.choice(('', f'<button>{self.say(d, 1, 2)}</button>'))}</{t}>"
        if kind == "form":
            return f"<form{r.choice(('', self.named('form')))}><label>{self.say(d, 1, 4)}</label><input name=q>{r.choice(('', text(2, 12)))}<button>{self.say(d, 1, 2)}</button></form>"
        if kind == "social":
            return f"<div{self.named('social', neutral=0)}>{r.choice((self.links(d), self.say(d, 1, 8)))}</div>"
        if self.foreign:
            heading = r.choice(("comments", "Comments", "Replies", "Responses", "Discussion", "Kommentare", "Comentarios"))
            if r.random() < 0.45:  # nothing but its heading tells
                head = f"<h{r.choice('234')}>{d}{r.choice(('', f'{r.randint(1, 40)} '))}{heading}</h3>"
                items = [r.choice((f"<p>{self.say(d, 2, 60)}</p>", self.say(d, 2, 60), f"<b>{self.say(d, 1, 2)}</b><p>{self.say(d, 2, 40)}</p>")) for _ in range(r.randint(1, 7))]
                body = r.choice(("<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>", "".join(f"<div>{x}</div>" for x in items), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"))
                return head + body if r.random() < 0.6 else f"<{(t := r.choice(('div', 'section')))}{self.named('comment', neutral=0.8)}>{head}{body}</{t}>"
        each = lambda: r.choice((f"<p>{self.say(d, 4, 60)}</p>", f"<div{self.named('comment')}><b>{self.say(d, 1, 2)}</b><p>{self.say(d, 4, 60)}</p></div>", f"<li>{self.say(d, 4, 50)}</li>", f"<article{self.named('comment', neutral=0)}><p>{self.say(d, 4, 50)}</p></article>"))
        return f"<{(t := r.choice(('div', 'section', 'ol', 'aside')))}{self.named('comment', neutral=0)}>{r.choice((f'<h3>{self.say(d, 1, 3)}</h3>', ''))}{''.join(each() for _ in range(r.randint(1, 6)))}</{t}>"

    def article(self) -> str:
        r, k = self.r, self.KEEP
        out = [f"<h{r.choice('1112')}>{self.say(k, 1, 12)}</h1>" if r.random() < 0.8 else ""]
        n = r.choice((1, 1, 2, 3, 5, 8, 15, 30))
        sloppy, linked = r.random() < 0.3, self.foreign and r.random() < 0.25
        for _ in range(n):
            kind = r.random()
            p = self.say(k, 1, r.choice((3, 12, 40, 90)))
            if r.random() < 0.15:
                p += f' <a href="x">{self.words(1, 3)}</a> ' + self.words(1, 15)
            elif self.foreign and r.random() < (0.5 if linked else 0.04):  # as much link as text
                p = self.KEEP + " ".join(f'{self.words(1, 2)} <a href="x">{self.words(1, 6)}</a>{r.choice((",", "", " and"))}' for _ in range(r.randint(1, 5))) + r.choice((".", ".", " " + self.words(2, 9)))
            if kind < 0.74:
                out.append(f"<p>{p}" + ("" if sloppy else "</p>") if r.random() < 0.9 else f"<div>{p}</div>")
            elif kind < 0.8:
                out.append(f"<p><b>{p}<br>" + ("" if sloppy else "</b></p>"))
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.say(k, 1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<h{r.choice('23')}>{self.say(k, 1, 8)}</h2>")
            elif kind < (0.87 if self.foreign else 1):
                out.append(f"<blockquote>{p}</blockquote>")
            elif kind < 0.95:
                out.append(f"<pre>{p}</pre>")
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.say(k, 1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<figure><img src=a><figcaption>{self.say(k, 2, 12)}</figcaption></figure>")
            if r.random() < 0.04:
                out.append(self.furniture(r.choice(("advert", "advert", "social", "side", "notice", "form"))))
        if r.random() < 0.1:
            out.append(self.furniture(r.choice(("comment", "social"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        kind = r.random()
        body = self.article()
        if kind < 0.5:
            body = f"<article{r.choice(('', '', self.named('content')))}>{body}</article>"
            body = f"<main>{body}</main>" if r.random() < 0.3 else body
        elif kind < 0.65:
            body = f"<main{r.choice(('', self.named('content')))}>{body}</main>"
        elif kind < (0.83 if self.foreign else 0.9):
            body = f"<{(t := r.choice(('div', 'section')))}{self.named('content', neutral=0.2)}>{body}</{t}>"
        elif kind < (0.87 if self.foreign else 1):
            body = f"<div>{body}</div>"
        before = [self.furniture(x) for x in ("notice", "header", "nav", "advert", "form", "side") if r.random() < {"nav": 0.75, "header": 0.5, "advert": 0.4}.get(x, 0.25)]
        after = [self.furniture(x) for x in ("social", "comment", "side", "advert", "form", "notice", "footer") if r.random() < {"footer": 0.8, "comment": 0.4, "side": 0.4}.get(x, 0.25)]
        if r.random() < 0.3:
            r.shuffle(before)
        alone = r.random() if self.foreign else 1  # the article may begin or end the page
        after = [] if alone < 0.22 else after
        before = [] if 0.12 < alone < 0.34 else before
        if self.foreign and r.random() < 0.24:  # laid out by a table
            side = [f"<td{r.choice(('', ' width=150', ' class=c3'))}>{self.links(self.DROP)}</td>" for _ in range(r.choice((1, 1, 2)))]
            cells = [*side, f"<td>{body}</td>"]
            r.shuffle(cells)
            rows = [f"<tr>{''.join(cells)}</tr>"]
            if r.random() < 0.7:
                rows.insert(0, f"<tr><td colspan=2>{r.choice((self.say(self.DROP, 1, 5), self.links(self.DROP)))}</td></tr>")
            if r.random() < 0.8:
                mark = r.choice(("(c) {0} ", "&copy; {0} ", "")).format(r.randint(1995, 2026))
                rows.append(f"<tr><td colspan=2>{r.choice((self.DROP + mark + self.words(1, 8), self.links(self.DROP)))}</td></tr>")
            body, after, before = f"<table>{''.join(rows)}</table>", [x for x in after if r.random() < 0.2], [x for x in before if r.random() < 0.2]
        inner = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            inner = f'<div{r.choice(("", " class=wrap", " id=page", self.named("content", neutral=0.9)))}>{inner}</div>'
        return f"<html><head><title>t</title></head><body>{inner}</body></html>"


def labelled(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (1: holds article text) and weights of the nodes of drawn pages."""
    draw, xs, ys, ws = Template(seed), [], [], []
    for _ in range(pages):
        source = draw.page()
        flat = Flat(parse(re.sub("[]", "", source))[0])
        marked = Flat(parse(source)[0])
        good = [float(bool(t) and t.startswith(Template.KEEP)) if t is not None else 0.0 for t in marked.text]
        for k in range(len(good) - 1, 0, -1):
            good[marked.parent[k]] = max(good[marked.parent[k]], good[k])
        if len(good) != len(flat.parent):
            continue
        xs.append(flat.x)
        ys.append(np.array(good))
        ws.append(np.full(len(good), 1 / np.sqrt(len(good))))
    return np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)


@functools.lru_cache(2)
def model(pages: int = 900, seed: int = 5) -> Boosted:
    x, y, w = labelled(pages, seed)
    return fit(x, y, w / w.mean(), trees=48, rate=0.25, bins=16)


def main_text(pages: list[str | None], trees: Boosted) -> list[str]:
    flats = [Flat(parse(p)[0]) if p else None for p in pages]
    real = [f for f in flats if f is not None]
    margins = trees.margin(np.concatenate([f.x for f in real])) if real else np.zeros(0)
    out, at = [], 0
    for f in flats:
        if f is None:
            out.append("")
            continue
        out.append("\n\n".join(f.kept(margins[at : at + len(f.parent)])))
        at += len(f.parent)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = 900) -> DataFrame:
    """Per page: id, url, text (the article's blocks joined by two newlines), n_chars.

    A null, empty or article-less page has the empty text; very long pages are read whole; broken markup is read as far as it goes; repeated rows
    each give a row; an empty table gives none; other columns are not read. The trees are fitted on the driver to
    `train_pages` generated pages, a fixed bound.
    """
    trees = model(train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "h", 1 << 20):
                texts = main_text(part.column("h").to_pylist(), trees)
                yield pa.record_batch([part.column("i"), part.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    frame = pages.selectExpr(f"cast(`{id_col}` as bigint) i", f"cast(`{url_col}` as string) u", f"cast(`{html_col}` as string) h")
    return frame.mapInArrow(frugal(run), f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
