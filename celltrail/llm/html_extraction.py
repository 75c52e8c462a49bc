"""Main text of web pages by a recurrent block labeller in numpy.

A page is taken apart into its sequence of leaf blocks: runs of text between block
tags, each with the path of open tags above it. A bidirectional LSTM reads the
sequence; each block is a vector of hashed tag-path features (the tags of the path
and the words of their class, id and role attributes), hashed words, and a few
numbers such as length and share of links. Every block is classified as main text or
not in the context of the whole document.

The network is trained here, once in a driver process, on pages that this module
makes up from a grammar of layouts (:func:`invented`): what is an article and what is
menu, advert, comment and so on is known by construction. No page of the table is
used, so it is the same network for every table. :data:`TRAINING_PAGES` bounds the
training. Every block of every page is classified.

Defined cases: a null or empty page has empty text; what cannot be read as a tag is
text; unclosed tags close with their parents, a head that is not closed with the first element
that it may not hold; formulas and drawings stand in a line of text; a page of one block is
classified like any other; a very long page is read once, in time that grows with its length;
repeated rows give equal rows; other columns take no part, but those named ``text`` or
``n_chars`` give way to the result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import column, others, prepare, table, unused
from ._words import prefix_sums, span_hash, spans

PATH_SLOTS, WORD_SLOTS, NUMBERS = 96, 32, 8
WIDTH = PATH_SLOTS + WORD_SLOTS + NUMBERS
HIDDEN = 16
TRAINING_PAGES, EPOCHS = 800, 7
#: Blocks of pages that are labelled together, at most.
TOGETHER = 1 << 15

# Elements that stand in a line of text.
INLINE = frozenset(
    (
        "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "math", "q", "rp", "rt", "ruby",
        "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr",
    )
)
# Elements that hold no text of a page.
HIDDEN_TEXT = frozenset(("script", "style", "noscript", "template", "canvas", "iframe", "object", "head", "title", "select", "option", "textarea", "button", "desc", "metadata", "annotation", "annotation-xml"))
# Elements that never close.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that an opening block element of the same kind closes.
SELF_CLOSING = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
#: Elements that a head may hold; any other closes it.
OF_HEAD = frozenset(("title", "meta", "link", "script", "style", "noscript", "template", "base", "object"))
#: Drawings and formulas: what stands in them is in a line, whatever the elements are called.
DRAWN = frozenset(("math", "svg"))

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"[>\"']")


class Pieces:
    """A page's tags and runs of text, each character looked at a bounded number of times.

    What is behind the last ``>`` or quote of a page is found once, so tags and values that
    never end are not searched for again and again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ('>', '"', "'", "-->", "]]>")}

    def _found(self, what: str, at: int) -> int:
        return self.page.find(what, at) if self.last[what] >= at else -1

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; quoted values may hold others. -1 if there is none."""
        if self.last[">"] < at:
            return -1
        start = at
        while (m := _TAG_END.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.start()
            # a quote opens a value behind an equals sign only, and only if it closes
            close = self._found(m[0], m.end()) if self.page[start : m.start()].rstrip()[-1:] == "=" else -1
            at = start = close + 1 if close >= 0 else m.end()
        return self._found(">", start)

    def __iter__(self) -> Iterator[tuple[str, str, bool, int]]:
        """(tag or "", text or attributes, whether it closes, where it ends)."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            if page[at] != "<":
                end = page.find("<", at)
                end = size if end < 0 else end
                at = yield "", page[at:end], False, end
                continue
            if page.startswith("<!--", at):
                end = self._found("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith("<![CDATA[", at):
                end = self._found("]]>", at + 9)
                at = size if end < 0 else end + 3
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                end = self._found(">", at)
                at = size if end < 0 else end + 1
                continue
            m = _TAG.match(page, at)
            end = self._tag_end(m.end()) if m else -1
            if end < 0:
                at = yield "", "<", False, at + 1
            else:
                at = yield m[1].lower(), page[m.end() : end], page[at + 1] == "/", end + 1


_NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE_WORD = re.compile(r"[a-z]+")
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}
_UNSEEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v \u0085  -     　]+")


@dataclass
class Block:
    """A run of text between block tags."""

    path: tuple[str, ...]
    text: str
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with white space inside as single spaces; none is empty."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, and its attributes' words
    text: list[str] = []
    state = {"links": 0, "linked": 0, "skip": 0, "drawn": 0}

    def close_block() -> None:
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip(" ")
            if whole:
                path = tuple(x for tag, named in stack if tag not in INLINE for x in (tag, *named.split()))
                out.append(Block(path, whole, min(state["linked"], len(whole))))
            text.clear()
            state["linked"] = 0

    def pop(to: int) -> None:
        for tag, _ in stack[to:]:
            state["skip"] -= tag in HIDDEN_TEXT
            state["links"] -= tag == "a"
            state["drawn"] -= tag in DRAWN
        del stack[to:]

    pieces = iter(Pieces(page))
    found = next(pieces, None)
    while found is not None:
        tag, held, closes, at = found
        if not tag:
            if not state["skip"]:
                text.append(held)
                if state["links"]:
                    state["linked"] += len(held)
        elif closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if not state["drawn"] and any(t not in INLINE for t, _ in stack[k:]):
                        close_block()
                    pop(k)
                    break
        else:
            at = _opened(tag, held, at, page, stack, state, close_block, pop)
        try:
            found = pieces.send(at)
        except StopIteration:
            found = None
    close_block()
    return out


def _opened(tag: str, held: str, at: int, page: str, stack: list, state: dict, close_block, pop) -> int:
    """What an opening tag with attributes ``held`` does; returns where reading goes on."""
    if tag not in OF_HEAD and tag != "head":
        for k, (t, _) in enumerate(stack):
            if t == "head":
                pop(k)
                break
    inline = tag in INLINE or state["drawn"] > 0
    if not inline:
        close_block()
    if tag in VOID:
        return at
    if tag in SELF_CLOSING and not inline:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                pop(k)
                break
            if stack[k][0] not in INLINE:
                break
    if held.rstrip().endswith("/") and tag not in ("a", "p", "div"):
        return at
    named = ""
    if held:
        named = " ".join(w for n in _NAMED.findall(held) for w in _ATTRIBUTE_WORD.findall("".join(n).lower()))
        if _UNSEEN.search(held):
            named += " hidden"
    stack.append((tag, named))
    state["skip"] += tag in HIDDEN_TEXT
    state["links"] += tag == "a"
    state["drawn"] += tag in DRAWN
    if tag in _RAW:  # raw text up to its own end
        end = _RAW[tag].search(page, at)
        return end.start() if end else len(page)
    return at


@lru_cache(maxsize=1 << 14)
def _path_row(path: tuple[str, ...]) -> np.ndarray:
    row = np.zeros(PATH_SLOTS, np.float32)
    for x in path:
        row[zlib.crc32(x.encode()) % PATH_SLOTS] = 1
    return row


_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashed_words(texts: list[str]) -> np.ndarray:
    """(texts, WORD_SLOTS): how often words of each slot come, over the root of how many there are."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, raw)))]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = np.zeros((len(texts), WORD_SLOTS), np.float32)
    start, end, text = spans(_LETTER, data, offsets)
    if len(start):
        slot = (span_hash(prefix_sums(data), start, end) >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
        out += np.bincount(text * WORD_SLOTS + slot, minlength=out.size).reshape(out.shape)
        out /= np.sqrt(np.maximum(np.bincount(text, minlength=len(texts)), 1))[:, None]
    return out


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page (blocks, WIDTH) features."""
    every = [b for blocks in pages for b in blocks]
    if not every:
        return [np.zeros((0, WIDTH), np.float32) for _ in pages]
    size = np.array([len(b.text) for b in every])
    ends = np.array([b.text.count(".") + b.text.count("!") + b.text.count("?") for b in every])
    place = np.concatenate([np.arange(len(p)) / max(len(p) - 1, 1) for p in pages])
    numbers = np.column_stack(
        [
            np.log1p(size) / 5, np.array([b.linked for b in every]) / np.maximum(size, 1), place, ends / (1 + size / 40),
            [b.path[-1:] == ("p",) for b in every], [any(x in ("h1", "h2", "h3") for x in b.path) for b in every],
            [len(b.path) / 10 for b in every], np.repeat([len(p) == 1 for p in pages], [len(p) for p in pages]),
        ]
    )
    paths = np.stack([_path_row(b.path) for b in every])
    whole = np.concatenate([paths, hashed_words([b.text for b in every]), numbers], axis=1).astype(np.float32)
    return np.split(whole, np.cumsum([len(p) for p in pages])[:-1])


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.weights = {}
        for side in "fb":
            self.weights[side + "x"] = (rng.standard_normal((WIDTH, 4 * h)) / np.sqrt(WIDTH)).astype(np.float32)
            self.weights[side + "h"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.weights[side + "b"] = bias
        self.weights["o"] = (rng.standard_normal(2 * h + WIDTH) * 0.05).astype(np.float32)
        self.weights["c"] = np.zeros(1, np.float32)

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        h = HIDDEN
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
        return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN) of one direction over padded pages (steps, pages, WIDTH)."""
        steps, pages, _ = x.shape
        wx, wh, b = (self.weights[side + k] for k in "xhb")
        fed = x.reshape(-1, WIDTH) @ wx
        fed = fed.reshape(steps, pages, -1) + b
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            i, f, o, g = self._gates(fed[t] + h @ wh)
            new = f * c + i * g
            m = mask[t][:, None]
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._pass(x, mask, s, kept[k] if kept else None) for k, s in enumerate("fb")] + [x], axis=2)
        return both @ self.weights["o"] + self.weights["c"], both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: tuple[list, list] = ([], [])
        z, both = self.scores(x, mask, kept)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        n = mask.sum()
        loss = float(-(np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / n)
        d = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.einsum("tp,tpk->k", d, both), "c": np.array([d.sum()], np.float32)}
        for k, side in enumerate("fb"):
            wh = self.weights[side + "h"]
            own = d[:, :, None] * self.weights["o"][k * HIDDEN : (k + 1) * HIDDEN]
            gx = np.zeros_like(self.weights[side + "x"])
            gh, gb = np.zeros_like(wh), np.zeros_like(self.weights[side + "b"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[k]):
                dh = dh + own[t]
                live = dh * m
                do = live * tanh
                d_new = dc * m + live * o * (1 - tanh**2)
                dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), do * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gb += dz.sum(0)
                dh = dz @ wh.T + np.where(m, 0, dh)
                dc = d_new * f + np.where(m, 0, dc)
            grads |= {side + "x": gx, side + "h": gh, side + "b": gb}
        return loss, grads

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, which blocks are main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end + 1 - begin) * len(pages[order[end]]) <= TOGETHER:
                end += 1
            group = [pages[k] for k in order[begin:end]]
            x, mask = padded(group)
            z, _ = self.scores(x, mask)
            for c, k in enumerate(order[begin:end]):
                out[k] = z[: len(pages[k]), c] > 0
            begin = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


# --- training pages -----------------------------------------------------------------------------


def invented(rng: np.random.Generator) -> str:
    """A made-up page; main text is marked by the character U+E000 in front of each of its blocks."""

    def word() -> str:
        return "".join(rng.choice(list("aeioubcdfghlmnprstvéüñ"), rng.integers(2, 9)))

    def sentence(least: int = 3, most: int = 18) -> str:
        return (" ".join(word() for _ in range(rng.integers(least, most)))).capitalize() + str(rng.choice([".", ".", ".", "!", "?", ",", ""]))

    def prose(most: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.integers(1, most)))

    def named(*names: str) -> str:
        kind = rng.random()
        if kind < 0.2:
            return ""
        own = rng.choice(names) if kind < 0.9 else f"{word()}-{rng.choice(names)}"
        return f' {rng.choice(["class", "id"])}="{own}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))

    mark = ""

    def bar() -> str:
        each = rng.choice([" ", " | ", ""]).join(f'<a href="/{word()}">{sentence(1, 3).rstrip(".,!?")}</a>' for _ in range(rng.integers(1, 6)))
        return f'<{(t := rng.choice(["div", "header", "div"]))}{named("masthead", "topbar", "header", "toolbar", "logo", "site-header", "navigation")}>{rng.choice(["", f"<h1><a href=/>{word()}</a></h1>", word() + " "])}{each}</{t}>'

    def menu() -> str:
        if rng.random() < 0.3:
            return bar()
        tag = rng.choice(["nav", "div", "header", "ul"])
        name = "" if tag == "nav" and rng.random() < 0.5 else named("nav", "menu", "navbar", "main-menu", "site-nav", "breadcrumbs", "header")
        return f"<{tag}{name}><ul>{links(rng.integers(2, 9))}</ul></{tag}>"

    def advert() -> str:
        return f'<{(t := rng.choice(["div", "aside", "section"]))}{named("ad", "ads", "advert", "banner", "sponsored", "promo")}>{rng.choice(["", "<p>"])}{prose(3)}</{t}>'

    def notice() -> str:
        return f'<div{named("cookie", "cookie-notice", "consent", "notice", "alert", "newsletter", "popup")}><p>{prose(3)}</p><button>{word()}</button></div>'

    def sidebar() -> str:
        inner = rng.choice([f"<h3>{sentence(1, 4)}</h3><ul>{links(5)}</ul>", f"<p>{prose(3)}</p>", f"<h2>{word()}</h2><p>{prose(2)}</p>"])
        return f'<{(t := rng.choice(["aside", "div"]))}{named("sidebar", "related", "widget", "share", "social", "recommended", "author-box")}>{inner}</{t}>'

    def form() -> str:
        return f'<form{named("search", "login", "subscribe", "contact")}><label>{sentence(1, 4)}</label><input name="q"><p>{sentence()}</p><button>{word()}</button></form>'

    def comments() -> str:
        tag, name = rng.choice([("div", "comment"), ("div", "comment"), ("li", "reply"), ("div", "comment-body")])
        each = "".join(f'<{tag} class="{name}"><b>{word()}</b><p>{prose(3)}</p></{tag}>' for _ in range(rng.integers(1, 5)))
        return f'<{(t := rng.choice(["section", "div"]))}{rng.choice([" class=" + chr(34), " id=" + chr(34)])}{rng.choice(["comments", "comment-list", "responses", "discussion"])}"><h3>{word()}</h3>{each}</{t}>'

    def footer() -> str:
        return f'<{(t := rng.choice(["footer", "footer", "div"]))}{named("footer", "site-footer", "copyright") if t == "div" or rng.random() < 0.4 else ""}>{rng.choice(["&copy; ", "", "© 2024 "])}{word()}.{word()} &middot; {sentence()}</{t}>'

    def ending() -> str:
        if rng.random() < 0.6:
            return footer()
        own = f'{rng.choice(["&copy; ", "© 2023 ", "Copyright "])}{sentence(1, 4)}'
        more = " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(rng.integers(0, 5)))
        t = rng.choice(["footer", "div"])
        return f'<{t}{' class="' + str(rng.choice(["footer", "bottom", "legal", "colophon"])) + '"' if t == "div" else ""}>{rng.choice([own + " " + more, f"<p>{own}</p>{more}", f"<ul><li>{more}</li></ul><p>{own}</p>"])}</{t}>'

    def body() -> str:
        out = [f"<h{(k := rng.choice([1, 1, 1, 2]))}>{mark}{sentence(2, 12)}</h{k}>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.06:
                out.append(f"<p>{mark}{word().capitalize()}{rng.choice(['.', ' ' + word() + '.', ''])}</p>")
            elif kind < 0.1:  # the same line over and over
                out += [f"<p>{mark}{sentence(1, 8)}</p>"] * int(rng.integers(2, 12))
            elif kind < 0.13:
                out.append(f"<p>{mark}{' '.join([word()] * int(rng.integers(20, 200)))}.<br>")
            elif kind < 0.6:
                out.append(f"<p>{mark}{prose()}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{mark}{prose(3)}<br>{rng.choice([mark + prose(3), ''])}")
            elif kind < 0.76:
                out.append(f"<h{rng.integers(2, 5)}>{mark}{sentence(1, 7)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{mark}{sentence()}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{mark}{prose(3)}</blockquote>")
            elif kind < 0.9:
                out.append(f'<p>{mark}{sentence()} <a href="/x">{word()}</a> {sentence()}</p>')
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{mark}{word()}</td><td>{mark}{word()}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif kind < 0.97:
                out.append(advert())
            else:
                out.append(f"<pre>{mark}{prose(2)}</pre>")
        return "".join(out)

    holder = rng.choice(["article", "article", "main", "div", "div", "section"])
    name = named("content", "post", "article", "entry-content", "story", "main-content", "story-body", "article-text", "entry", "post-body") if holder in ("div", "section") or rng.random() < 0.3 else ""
    if holder == "div" and not name and rng.random() < 0.7:
        name = ' class="content"'
    before = [f() for f in rng.permutation([menu, bar, advert, notice, sidebar, form])[: rng.integers(0, 4)]]
    after = [f() for f in rng.permutation([advert, notice, sidebar, form, comments, menu])[: rng.integers(0, 4)]]
    head = f"<header><h2>{word()}</h2><p>{sentence()}</p></header>" if rng.random() < 0.2 else ""
    inside = comments() if rng.random() < 0.15 else ""
    end = ending() if rng.random() < 0.85 else ""
    text = f"<{holder}{name}>{body()}{inside}</{holder}>"
    if rng.random() < 0.3:
        text = f'<{(t := rng.choice(["main", "div", "section"]))}{named("main", "column", "primary", "row", "content-area")}>{text}</{t}>'
    whole = f"{head}{''.join(before)}{text}{''.join(after)}{end}"
    if rng.random() < 0.4:
        whole = f'<div{named("wrapper", "page", "container", "site", "root", "layout")}>{whole}</div>'
    return f"<html><head><title>{sentence()}</title></head><body>{whole}</body></html>"


def examples(pages: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(pages):
        found = blocks_of(invented(rng))
        truth = np.array([b.text.startswith("") for b in found])
        for b in found:
            b.text = b.text.replace("", "")
        keep = [k for k, b in enumerate(found) if b.text]
        if keep:
            out.append((vectors([[found[k] for k in keep]])[0], truth[keep]))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """The network after ``epochs`` over ``pages`` made-up pages (Adam, batches of like length)."""
    data = sorted(examples(pages, seed), key=lambda e: len(e[1]))
    batches = [data[k : k + 16] for k in range(0, len(data), 16)]
    net, rng = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(w) for k, w in net.weights.items()}
    second = {k: np.zeros_like(w) for k, w in net.weights.items()}
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            x, mask = padded([v for v, _ in batches[b]])
            y = np.zeros(mask.shape, bool)
            for k, (_, t) in enumerate(batches[b]):
                y[: len(t), k] = t
            _, grads = net.gradients(x, mask, y)
            step += 1
            rate = 0.02 * (0.5 ** (epoch / 2))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


# --- the operator -------------------------------------------------------------------------------


def extract(pages: list[str | None], net: Labeller) -> list[str]:
    """The main text of each page: blocks in page order, two line feeds between."""
    taken = [blocks_of(p) if p else [] for p in pages]
    marks = net.label(vectors(taken))
    return ["\n\n".join(b.text for b, m in zip(found, mark, strict=True) if m) for found, mark in zip(taken, marks, strict=True)]


def extracted(df: DataFrame, net: Labeller, html_col: str = "html") -> DataFrame:
    """``df`` without its pages' source, with ``text`` and ``n_chars``."""
    prepare(df.sparkSession)
    keep = others(df, html_col, "text", "n_chars")
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = extract(part.column(len(keep)).to_pylist(), net)
                own = [part.column(k) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return df.select(*map(column, keep), column(html_col).alias(unused(df, "_html"))).mapInArrow(run, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"), trained())
