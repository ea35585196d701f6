"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf text blocks, each with its tag path (tags, classes and ids of
the open elements), its words and a few numbers. A bidirectional LSTM in numpy reads hashed
tag-path and word vectors of the whole sequence and labels every block as main text or not.

It is trained when first used on PAGES generated pages (a documented bound, independent of the
input) whose labels are known because the generator makes them; the seed is fixed, so every
process gets the same weights.

Defined cases: a null html is empty; pages without main blocks give an empty text. Tags are read in one
pass in time linear in the page, attributes with stray quotes included; unclosed comments and
scripts, and a tag without an end, take the rest of the page. Only RAW elements (scripts, styles, the
title and other plain characters), templates and lists of choices never make blocks; other skipped elements end with
the element that they are in. Text of formulas and drawings stands in the line that holds them. The head
ends before the first text or element that can't be in it. A line break inside a
block is white space. Pages of any length and depth
are read whole; of a path deeper than 64 elements the outer 16 and inner 48 are features. Equal rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .hashing import Words, text_bytes

PAGES, EPOCHS, SEED = 1200, 14, 5
PATH_BUCKETS, PATH_DIM, WORD_BUCKETS, WORD_DIM, NUMBERS, HIDDEN = 1024, 12, 1024, 6, 5, 12
#: Elements that hold plain characters up to their end tag or the end of the page, and those whose content is not shown or is a form control.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = RAW - {"xmp"} | frozenset("template select datalist".split())
#: What can be in a head without ending it.
IN_HEAD = frozenset("base link meta script style noscript template title".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Drawings and formulas stand in a line of text; what a drawing says of itself is not shown, and an element that can't be in one ends it.
FOREIGN, UNSHOWN = frozenset(("svg", "math")), frozenset("title desc metadata style script".split())
ENDS_FOREIGN = frozenset(
    "article aside b big blockquote body br center code dd div dl dt em embed footer form h1 h2 h3 h4 h5 h6 head header hr i img li main menu meta nav ol p pre ruby s section small span strike strong sub sup table tt u ul var".split()
)
#: An element of the first kind ends an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "button": {"button"}}
#: Of the path of a block the labeller reads so many outer and inner elements.
OUTER, INNER = 16, 48
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: One attribute: its name, and its value with quotes, or up to white space.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)""")
#: A tag without oddities, read in one go.
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[a-zA-Z][^\s"'>/=]*+(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'>=]++))?+)*+)\s*+(/?)>""")
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def end_of_tag(html: str, at: int) -> tuple[int, bool, str]:
    """From behind the name of a tag: where it ends (-1 if it does not), whether it closes itself, and its class, id and role."""
    told = []
    while True:
        m = ATTRIBUTE.match(html, at)
        if m.end() >= len(html):
            return -1, False, ""
        if m[1] and m[1].lower() in ("class", "id", "role"):
            told.append(f' {m[1]}="{(m[2] or m[3] or m[4] or "").replace(chr(34), " ")}"')
        if html[m.end()] == ">":
            return m.end() + 1, html[m.end() - 1] == "/" and not m[4], "".join(told)
        if m.end() == at:  # nothing that an attribute can begin with
            at += 1
        else:
            at = m.end()


def pieces(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, attributes, text): kind is "start", "empty" (closes itself), "end" or "text". Every character is looked at a bounded number of times.

    Comments, declarations and what RAW elements hold are left out, but for xmp. A tag that does not end is left out with the rest of the page.
    """
    at, size, last = 0, len(html), html.rfind(">")
    foreign = 0
    while at < size:
        begin = html.find("<", at)
        if begin < 0 or begin + 1 >= size:
            yield "text", "", "", html[at:]
            return
        if begin > at:
            yield "text", "", "", html[at:begin]
        after = html[begin + 1]
        if after == "!" or after == "?":
            if html.startswith("<!--", begin):
                if html.startswith(">", begin + 4) or html.startswith("->", begin + 4):
                    at = html.index(">", begin) + 1
                    continue
                end = html.find("-->", begin + 4)
                at = end + 3 if end >= 0 else size
            else:
                end = html.find(">", begin)
                at = end + 1 if end >= 0 else size
            continue
        m = PLAIN_TAG.match(html, begin)
        if m:
            ends, tag, names, closed = bool(m[1]), m[2].lower(), m[3], bool(m[4])
            at = m.end()
        else:
            m = TAG.match(html, begin)
            if not m:
                if after == "/" and begin + 2 < size:  # an end tag without a name
                    end = html.find(">", begin)
                    at = end + 1 if end >= 0 else size
                else:
                    yield "text", "", "", "<"
                    at = begin + 1
                continue
            if begin > last:
                return
            ends, tag = after == "/", m[1].lower()
            at, closed, names = end_of_tag(html, m.end())
            if at < 0:
                return
        if ends:
            foreign -= tag in FOREIGN and foreign > 0
            yield "end", tag, "", ""
            continue
        if tag in ENDS_FOREIGN:
            foreign = 0
        elif tag in FOREIGN and not closed:
            foreign += 1
        if tag in RAW and not foreign:
            m = RAW_END[tag].search(html, at)
            if tag == "xmp":
                yield "text", "", "", html[at : m.start() if m else size]
            if not m:
                return
            at = max(end_of_tag(html, m.end())[0], 0) or size
            continue
        yield "empty" if closed else "start", tag, names, ""


def blocks_of(html: str) -> list[tuple[str, str, float]]:
    """(tag path, text, share of the text in links) of each leaf block."""
    out: list[tuple[str, str, float]] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = links = 0
    foreign: list[str] = []
    muted = 0  # open elements whose text is not shown

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                some = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                out.append(("\n".join(x[1] for x in some), whole, min(1.0, linked / max(1, sum(map(len, text))))))
            text, linked = [], 0

    def close() -> None:
        nonlocal muted
        tag = stack.pop()[0]
        opened[tag] -= 1
        muted -= tag in SKIPPED

    for kind, tag, names, data in pieces(html):
        if kind == "text":
            if stack and stack[-1][0] == "head" and data.strip():
                flush()
                close()
            if not muted and not (foreign and foreign[-1] in UNSHOWN):
                text.append(data)
                if links:
                    linked += len(data)
            continue
        if foreign:
            if kind != "end" and tag not in ENDS_FOREIGN:
                if kind == "start":
                    foreign.append(tag)
                continue
            if kind == "end" and tag in foreign:
                while foreign.pop() != tag:
                    pass
                continue
            if kind == "end" and not opened.get(tag):
                continue
            foreign = []
        elif tag in FOREIGN and kind != "end":
            if kind == "start":
                foreign.append(tag)
            continue
        if kind == "end":
            if tag == "a":
                links = 0
            if tag in INLINE:
                continue
            flush()
            if opened.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
        else:
            if stack and stack[-1][0] == "head":
                if tag in ("html", "head"):
                    continue
                if tag not in IN_HEAD:
                    flush()
                    close()
            if tag in INLINE:
                if tag == "a":
                    links = 1
                elif tag == "br":
                    text.append(" ")
                continue
            flush()
            if tag in EMPTY:
                continue
            if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
                close()
            name = tag
            if names:
                for a in NAMES.findall(names):
                    name += "".join(" " + tag + "." + x for x in re.split(r"[\s_-]+", max(a).lower()) if x)
            stack.append((tag, name))
            opened[tag] = opened.get(tag, 0) + 1
            muted += tag in SKIPPED
        if tag in ("p", "li", "div", "td"):
            links = 0
    flush()
    return out


@functools.lru_cache(100_000)
def path_ids(path: str) -> np.ndarray:
    """Hash buckets of the elements' tags and names; the innermost element's count twice, once as such."""
    parts = path.split("\n") if path else ["none"]
    names = [x for p in parts for x in p.split()] + ["last:" + x for x in parts[-1].split()]
    return np.array([zlib.crc32(x.encode()) % PATH_BUCKETS for x in names])


class Features:
    """Of the blocks of several pages: bucket lists of paths and words, numbers, and the first block of each page."""

    def __init__(self, pages: list[list[tuple[str, str, float]]]):
        flat = [b for p in pages for b in p]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(int)
        ids = [path_ids(b[0]) for b in flat]
        self.path, self.path_n = (np.concatenate(ids) if ids else np.zeros(0, int)), np.array([len(i) for i in ids], int)
        w = Words(*text_bytes(pa.array([b[1] for b in flat], pa.string())))
        self.word, self.word_n = (w.hash % np.uint64(WORD_BUCKETS)).astype(int), np.diff(w.first)
        chars = np.array([len(b[1]) for b in flat], np.float32)
        page = np.repeat(np.arange(len(pages)), np.diff(self.first))
        place = (np.arange(len(flat)) - self.first[page]) / np.maximum(1, np.diff(self.first)[page])
        ends = np.array([b[1][-1] in ".!?:\"'" for b in flat], np.float32)
        self.numbers = np.stack([np.log1p(chars) / 5, np.array([b[2] for b in flat], np.float32), place.astype(np.float32), ends, np.log1p(self.word_n) / 4], 1).astype(np.float32) if flat else np.zeros((0, NUMBERS), np.float32)


def mean_rows(vectors: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, vectors.shape[1]), np.float64), np.cumsum(vectors[ids], 0, dtype=np.float64)])
    end = np.cumsum(n)
    return ((sums[end] - sums[end - n]) / np.maximum(1, n)[:, None]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block sequences, with training by back-propagation through time and Adam."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + NUMBERS, HIDDEN
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"path": g(PATH_BUCKETS, PATH_DIM) * 8, "word": g(WORD_BUCKETS, WORD_DIM) * 4, "out": g(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": g(d, 4 * h), f"U{k}": g(h, 4 * h), f"c{k}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([mean_rows(self.p["path"], f.path, f.path_n), mean_rows(self.p["word"], f.word, f.word_n), f.numbers], 1)

    def run(self, k: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Hidden states of one direction; x is (time, page, dim), steps outside the mask hand the state on."""
        p, h = self.p, HIDDEN
        z = x @ p[f"W{k}"] + p[f"c{k}"]
        s = c = np.zeros((x.shape[1], h), np.float32)
        out, tape = np.zeros((*x.shape[:2], h), np.float32), []
        for t in range(len(x)) if k == "f" else range(len(x) - 1, -1, -1):
            a = z[t] + s @ p[f"U{k}"]
            i, f, o, g = sigmoid(a[:, :h]), sigmoid(a[:, h : 2 * h]), sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            m = mask[t][:, None]
            new = f * c + i * g
            if keep:
                tape.append((t, i, f, o, g, c, s, new, m))
            c = m * new + (1 - m) * c
            s = m * (o * np.tanh(new)) + (1 - m) * s
            out[t] = s
        return out, tape

    def back(self, k: str, x: np.ndarray, tape: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
        p = self.p
        ds = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        dx = np.zeros_like(x)
        for t, i, f, o, g, c, s, new, m in reversed(tape):
            ds = ds + d_out[t]
            th = np.tanh(new)
            dn = m * (ds * o * (1 - th * th) + dc)
            a = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), m * ds * th * o * (1 - o), dn * i * (1 - g * g)], 1)
            grad[f"W{k}"] += x[t].T @ a
            grad[f"U{k}"] += s.T @ a
            grad[f"c{k}"] += a.sum(0)
            dx[t] = a @ p[f"W{k}"].T
            dc = (1 - m) * dc + dn * f
            ds = (1 - m) * ds + a @ p[f"U{k}"].T
        return dx

    def padded(self, f: Features, pages: np.ndarray, x: np.ndarray):
        n = f.first[pages + 1] - f.first[pages]
        at = f.first[pages][None, :] + np.arange(n.max())[:, None]
        mask = np.arange(n.max())[:, None] < n[None, :]
        at = np.where(mask, at, 0)
        return x[at] * mask[..., None], mask.astype(np.float32), at

    def probabilities(self, f: Features) -> np.ndarray:
        """For every block; pages are run together with others of about their length."""
        x, out = self.inputs(f), np.zeros(f.first[-1], np.float32)
        order = np.argsort(np.diff(f.first), kind="stable")
        order = order[np.diff(f.first)[order] > 0]
        for a in range(0, len(order), 128):
            seq, mask, at = self.padded(f, order[a : a + 128], x)
            h = np.concatenate([self.run("f", seq, mask)[0], self.run("b", seq, mask)[0]], 2)
            y = sigmoid(h @ self.p["out"] + self.p["bias"])[..., 0]
            out[at[mask > 0]] = y[mask > 0]
        return out

    def train(self, pages: list[list[tuple[str, str, float]]], labels: list[list[int]], epochs: int = EPOCHS, rate: float = 0.01) -> Labeller:
        r = np.random.default_rng(SEED)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for a in range(0, len(order), 32):
                part = [pages[i] for i in order[a : a + 32]]
                f = Features(part)
                y = np.concatenate([labels[i] for i in order[a : a + 32]]).astype(np.float32)
                seq, mask, at = self.padded(f, np.arange(len(part)), self.inputs(f))
                hf, tf = self.run("f", seq, mask, True)
                hb, tb = self.run("b", seq, mask, True)
                h = np.concatenate([hf, hb], 2)
                d = (sigmoid(h @ self.p["out"] + self.p["bias"])[..., 0] - y[at]) * mask / mask.sum()
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["out"], grad["bias"] = np.einsum("tbh,tb->h", h, d)[:, None], np.array([d.sum()], np.float32)
                dh = d[..., None] * self.p["out"][:, 0]
                dx = self.back("f", seq, tf, dh[..., :HIDDEN], grad) + self.back("b", seq, tb, dh[..., HIDDEN:], grad)
                flat = np.zeros((f.first[-1], dx.shape[2]), np.float32)
                flat[at[mask > 0]] = dx[mask > 0]
                for name, ids, n, cols in (("path", f.path, f.path_n, slice(0, PATH_DIM)), ("word", f.word, f.word_n, slice(PATH_DIM, PATH_DIM + WORD_DIM))):
                    np.add.at(grad[name], ids, np.repeat(flat[:, cols] / np.maximum(1, n)[:, None], n, 0))
                step += 1
                for k, v in self.p.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * grad[k] ** 2
                    v -= rate * (0.93**epoch) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
        return self


def made_page(r: random.Random) -> tuple[list[tuple[str, str, float]], list[int]]:
    """Blocks and labels of a generated page; main text is between marks that are taken out again."""
    vowels, rest = r.choice(["aeiou", "aeiouäöü", "aeiouéèç", "aeouáíó"]), "bcdfghklmnprstvwz"
    word = lambda: "".join(r.choice(rest) + r.choice(vowels) for _ in range(r.randint(1, 4)))

    def sentence(n: int) -> str:
        return (" ".join(word() + ("," if r.random() < 0.05 else "") for _ in range(n))).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def prose(a: int, b: int) -> str:
        k, n = r.random(), r.randint(a, b)
        if k < 0.04:  # one phrase again and again
            return " ".join([word().capitalize() + r.choice(["", ".", " |"])] * (n * r.randint(3, 15)))
        if k < 0.08:  # signs
            return " ".join(word() + r.choice(["", "$$$", "###", "%", "&amp;", "|", "&lt;b&gt;"]) for _ in range(n * 8))
        return " ".join(sentence(r.choice([1, 2, 5, 9, 14, 18, 40])) for _ in range(n))

    name = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'])
    links = lambda n: "".join(f'<li><a href="/{(x := word())}">{r.choice([x, x.capitalize(), "Home", "About", "Login", "News", "Contact"])}</a></li>' for _ in range(n))
    main = lambda tag, text: f"<{tag}>\x01{text}</{tag}>"

    def paragraph() -> str:
        k = r.random()
        if k < 0.1:
            return f"<p><b>\x01{prose(1, 3)}<br>"
        if k < 0.2:
            return main(r.choice(["h2", "h3", "blockquote", "pre"]), prose(1, 1))
        if k < 0.27:
            return "<ul>" + "".join(main("li", prose(1, 2)) for _ in range(r.randint(1, 4))) + "</ul>"
        if k < 0.33:
            return main("p", sentence(r.randint(1, 2)))
        if k < 0.37:
            return "<table><tr>" + "".join(main(r.choice(["td", "th"]), sentence(r.randint(1, 5))) for _ in range(4)) + "</tr></table>"
        if k < 0.44:
            return f'<p>\x01{sentence(4)} <a href="/{word()}">{word()}</a> {prose(1, 3)}</p>'
        return main("p", prose(1, r.choice([1, 3, 8, 30])))

    def box() -> str:
        """Anything but main text."""
        k = r.randrange(10)
        if k == 0:
            return f"<div{name('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'advertisement')}>{r.choice([prose(1, 2), '<p>' + prose(1, 2) + '</p>'])}</div>"
        if k == 1:
            return f"<aside{r.choice(['', name('sidebar', 'related', 'widget')])}><h3>{sentence(2)}</h3><ul>{links(r.randint(2, 6))}</ul>{r.choice(['', '<p>' + prose(1, 3) + '</p>'])}</aside>"
        if k == 2:
            return f"<div{name('sidebar', 'side', 'related', 'recommended', 'widget', 'menu', 'share', 'social', 'tags', 'breadcrumb')}>{r.choice([prose(1, 2), '<ul>' + links(4) + '</ul>', '<p>' + prose(1, 2) + '</p>'])}</div>"
        if k == 3:
            return f"<div{name('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'popup', 'alert', 'newsletter', 'cookie-notice', 'modal')}>{r.choice(['', '<p>'])}{r.choice(['We use cookies. ', 'Accept ', ''])}{prose(1, 2)}</div>"
        if k == 4:
            return f"<form{r.choice(['', name('search', 'login', 'subscribe')])}><label>{r.choice(['Search', 'Email', sentence(2)])}</label><input name=q><p>{prose(1, 1)}</p><button>{word()}</button></form>"
        if k in (5, 6):
            tag, one = r.choice(["section", "div", "ul", "ol"]), r.choice(["div", "article", "p", "li"])
            one = "li" if tag in ("ul", "ol") else one
            each = "".join(f"<{one}{name('comment', 'reply', 'comment-body')}>{r.choice(['<b>' + word() + '</b> ', '<p>', '<h4>' + word() + '</h4><p>', ''])}{prose(1, 3)}</{one}>" for _ in range(r.randint(1, 5)))
            return f"<{tag}{name('comments', 'discussion', 'responses', 'replies', 'comment-list')}>{r.choice(['', '<h3>Comments</h3>', '<h3>' + sentence(2) + '</h3>'])}{each}</{tag}>"
        if k == 7:
            return f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>"
        if k == 8:
            return f"<footer>{r.choice(['&copy; ', 'Copyright ', ''])}{word()}.com &middot; {prose(1, 2)}</footer>"
        return f"<header{r.choice(['', name('site', 'top', 'header', 'masthead')])}>{r.choice(['<h1>' + sentence(3) + '</h1>', '<p>' + sentence(5) + '</p>', '<a href=/>' + word() + '</a>'])}</header>"

    article = "".join([main("h1", sentence(r.randint(2, 9))) if r.random() < 0.8 else "", *(paragraph() for _ in range(r.choice([0, 1, 2, 4, 9, 16])))])
    if r.random() < 0.25:
        article += box()
    body = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="article">{}</div>', '<div class="post-body">{}</div>']).format(article)
    before, after = "".join(box() for _ in range(r.randint(0, 3))), "".join(box() for _ in range(r.randint(0, 3)))
    if r.random() < 0.5:
        before = f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>" + before
    if r.random() < 0.5:
        after += f"<footer>&copy; {word()}.org &middot; {prose(1, 2)}</footer>"
    page = f"<!DOCTYPE html><html><head><title>{sentence(4)}</title></head><body>{before}{body}{after}" + r.choice(["</body></html>", ""])
    found = blocks_of(page)
    return [(p, t.replace("\x01", "") or ".", k) for p, t, k in found], [int("\x01" in t) for _, t, _ in found]


@functools.cache
def labeller() -> Labeller:
    r = random.Random(SEED)
    made = [made_page(r) for _ in range(PAGES)]
    made = [x for x in made if x[0]]
    return Labeller().train([x[0] for x in made], [x[1] for x in made])


def extract_rows(batches: Iterator[pa.RecordBatch], model: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [blocks_of(x or "") for x in batch.column("html").to_pylist()]
        f = Features(pages)
        main = model.probabilities(f) > 0.5
        texts = ["\n".join(b[1] for b, ok in zip(p, main[f.first[i] : f.first[i + 1]], strict=True) if ok) for i, p in enumerate(pages)]
        n = np.diff(f.first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n.astype(np.int64))], ["page_id", "url", "text", "n_chars", "n_blocks"]
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every page. Nothing is shuffled."""
    small_batches(pages.sparkSession)
    model = labeller()
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(lambda batches: extract_rows(batches, model), "page_id long, url string, text string, n_chars long, n_blocks long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
