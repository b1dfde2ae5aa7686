"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags, inline markup removed, character
references decoded. Each block is read as a tag-path vector (tags, classes, ids and roles of what encloses
it), a hashed-word vector, and a few shape figures. A bidirectional LSTM, written in numpy, reads the whole
sequence of a page's blocks, so what stands before and after decides with, and says for every block whether
it is main text.

The labeller is trained here, on pages that :func:`synthetic_page` makes up: templates with menus, headers,
notices, adverts, sidebars, forms, comments and footers around an article, whose labels are known. Training is
deterministic and needs no data; the model is about 100 kB.

Null and empty pages, and pages without main text, give an empty string. Nothing is dropped or cut by length.
Pages with equal ids are rows of their own.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.words import slices, texts_of, words_of

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre "
    "section select summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes open ones of these, up to the nearest that bounds them.
CLOSES = {
    **dict.fromkeys(BLOCK - {"button", "label", "option", "optgroup"}, ({"p"}, {"button", "td", "th", "li", "dd", "dt"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
#: Quoted values are whole and come after "=" alone; any other quote is an ordinary character.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(script|style)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)|[=\"'])*+)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Attributes from this length on are not kept in memory.
LONG = 2_000

PATH_ROWS, PATH_DIM = 2048, 16
WORD_ROWS, WORD_DIM = 1024, 8
SHAPE = 8
INPUT = PATH_DIM + WORD_DIM + SHAPE
HIDDEN = 16


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    shape: tuple[float, ...]


def _hash(token: str, rows: int) -> int:
    return zlib.crc32(token.encode()) % rows


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    """The path features of one enclosing tag."""
    out = {_hash("<" + tag, PATH_ROWS)}
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "style":
            if name == "hidden" or "none" in value:
                out.add(_hash("hidden", PATH_ROWS))
            continue
        for word in WORD.findall(value):
            if not word.isdigit():
                out.add(_hash(word, PATH_ROWS))
                out.add(_hash(word.rstrip("s"), PATH_ROWS))
    return tuple(sorted(out))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in page order, blank ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int]]] = []  # open tags, each with the features of all that encloses it and its own
    pieces: list[str] = []
    linked, links, in_link = 0, 0, 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                path = stack[-1][1] if stack else ()
                n = len(text)
                shape = (np.log1p(n) / 6, min(1.0, linked / n), links / 4 if links < 8 else 2.0, float(text[-1] in ".!?:;»”\""), len(stack) / 10, float(bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")), float(bool(stack) and stack[-1][0] == "p"), 1.0)
                out.append(Block(text, tuple(sorted(path)), shape))
        pieces.clear()
        linked = links = 0

    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            piece = page[at : match.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = match.end()
        tag = match[3]
        if tag is None:
            continue
        tag = tag.lower()
        if match[2]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCK:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link, links = 1, links + 1
        elif tag in BLOCK:
            flush()
            in_link = 0
            closed, bound = CLOSES.get(tag, ((), ()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in closed:
                    del stack[i:]
                    if tag not in ("tr", "td", "th"):
                        break
            if tag not in VOID:
                marks = _marks if len(match[4]) < LONG else _marks.__wrapped__
                above, own = stack[-1][1] if stack else frozenset(), marks(tag, match[4])
                stack.append((tag, above if above.issuperset(own) else above.union(own)))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


# --- network -------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Batch:
    """Pages padded to one length: features by (step, page)."""

    path: np.ndarray
    path_ends: np.ndarray
    word: np.ndarray
    word_ends: np.ndarray
    shape: np.ndarray
    slot: np.ndarray
    steps: int
    pages: int

    @classmethod
    def of(cls, pages: list[list[Block]]) -> Batch:
        flat = [b for page in pages for b in page]
        steps = max(map(len, pages), default=0)
        words = words_of(pa.array([b.text for b in flat], pa.string()), lower=True)
        rows = np.fromiter((_hash(w, WORD_ROWS) for w in words.dictionary.to_pylist()), dtype=np.int64, count=len(words.dictionary))
        ends = np.concatenate(([0], np.cumsum([len(b.path) for b in flat]))).astype(np.int64)
        slot = np.array([t * len(pages) + i for i, page in enumerate(pages) for t in range(len(page))], dtype=np.int64)
        return cls(np.array([i for b in flat for i in b.path], dtype=np.int64), ends, rows[words.codes], words.offsets, np.array([b.shape for b in flat], dtype=np.float32).reshape(-1, SHAPE), slot, steps, len(pages))


def _group_sum(table: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ends) - 1, table.shape[1]), dtype=np.float32)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        step = max(1, len(some) // max(1, len(rows) // 200_000))  # bounds the gathered rows held at once
        for at in range(0, len(some), step):
            part = some[at : at + step]
            begin, end = ends[part[0]], ends[part[-1] + 1]
            out[part] = np.add.reduceat(table[rows[begin:end]], ends[part] - begin, axis=0)
    return out


class Labeller:
    """Embeddings, two LSTMs and one output; parameters in a dictionary so that the optimiser can walk over them."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {"path": r.normal(0, 0.1, (PATH_ROWS, PATH_DIM)).astype(f), "word": r.normal(0, 0.01, (WORD_ROWS, WORD_DIM)).astype(f), "out": r.normal(0, 0.1, (2 * HIDDEN, 1)).astype(f), "out_b": np.zeros(1, f)}
        for side in "fb":
            self.p["w" + side] = r.normal(0, 1 / np.sqrt(INPUT + HIDDEN), (INPUT + HIDDEN, 4 * HIDDEN)).astype(f)
            bias = np.zeros(4 * HIDDEN, f)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["b" + side] = bias

    def inputs(self, batch: Batch) -> np.ndarray:
        x = np.zeros((batch.steps * batch.pages, INPUT), dtype=np.float32)
        word = _group_sum(self.p["word"], batch.word, batch.word_ends) / np.maximum(np.diff(batch.word_ends), 1)[:, None]
        x[batch.slot] = np.concatenate((_group_sum(self.p["path"], batch.path, batch.path_ends), word, batch.shape), axis=1)
        return x.reshape(batch.steps, batch.pages, INPUT)

    def _scan(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states; where the mask is 0 the state passes through unchanged."""
        steps, pages, _ = x.shape
        w, b = self.p["w" + side], self.p["b" + side]
        first = x @ w[:INPUT] + b
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, trail = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = first[t] + h @ w[INPUT:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            cell = f * c + i * g
            state = o * np.tanh(cell)
            if keep:
                trail.append((t, h, c, i, f, o, g, cell))
            h, c = m * state + (1 - m) * h, m * cell + (1 - m) * c
            out[t] = h
        return out, trail

    def forward(self, batch: Batch, keep: bool = False):
        x = self.inputs(batch)
        mask = np.zeros(batch.steps * batch.pages, np.float32)
        mask[batch.slot] = 1
        mask = mask.reshape(batch.steps, batch.pages)
        (hf, tf), (hb, tb) = self._scan(x, mask, "f", keep), self._scan(x, mask, "b", keep)
        both = np.concatenate((hf, hb), axis=2)
        score = _sigmoid((both @ self.p["out"])[:, :, 0] + self.p["out_b"])
        return score.reshape(-1)[batch.slot], (x, mask, both, score, tf, tb)

    def gradients(self, batch: Batch, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        score, (x, mask, both, full, tf, tb) = self.forward(batch, keep=True)
        n = len(labels)
        loss = -float(np.mean(labels * np.log(score + 1e-7) + (1 - labels) * np.log(1 - score + 1e-7)))
        error = np.zeros(batch.steps * batch.pages, np.float32)
        error[batch.slot] = (score - labels) / n
        error = error.reshape(batch.steps, batch.pages, 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"] = np.tensordot(both, error, axes=([0, 1], [0, 1]))
        grad["out_b"] = error.sum(axis=(0, 1))
        dboth, dx = error @ self.p["out"].T, np.zeros_like(x)
        for side, trail, dout in (("f", tf, dboth[:, :, :HIDDEN]), ("b", tb, dboth[:, :, HIDDEN:])):
            w = self.p["w" + side]
            dh, dc = np.zeros((batch.pages, HIDDEN), np.float32), np.zeros((batch.pages, HIDDEN), np.float32)
            for t, h, c, i, f, o, g, cell in reversed(trail):
                m = mask[t][:, None]
                dh = dh + dout[t]
                ds, th = dh * m, np.tanh(cell)
                dcell = dc * m + ds * o * (1 - th**2)
                dz = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), ds * th * o * (1 - o), dcell * i * (1 - g**2)), axis=1)
                grad["w" + side][:INPUT] += x[t].T @ dz
                grad["w" + side][INPUT:] += h.T @ dz
                grad["b" + side] += dz.sum(axis=0)
                dx[t] += dz @ w[:INPUT].T
                dh = dh * (1 - m) + dz @ w[INPUT:].T
                dc = dc * (1 - m) + dcell * f
        flat = dx.reshape(-1, INPUT)[batch.slot]
        np.add.at(grad["path"], batch.path, np.repeat(flat[:, :PATH_DIM], np.diff(batch.path_ends), axis=0))
        each = flat[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(np.diff(batch.word_ends), 1)[:, None]
        np.add.at(grad["word"], batch.word, np.repeat(each, np.diff(batch.word_ends), axis=0))
        return grad, loss

    def labels(self, pages: list[list[Block]], group: int = 256) -> list[np.ndarray]:
        """Probability of each block of each page to be main text. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest, to = len(pages[order[at]]), at + 1
            while to < len(order) and to - at < group and len(pages[order[to]]) * (to - at + 1) < 60_000 and len(pages[order[to]]) <= 2 * longest + 8:
                to += 1
            mine = order[at:to]
            score, _ = self.forward(Batch.of([pages[i] for i in mine]))
            ends = np.cumsum([0, *(len(pages[i]) for i in mine)])
            for k, i in enumerate(mine):
                out[i] = score[ends[k] : ends[k + 1]]
            at = to
        return out


# --- training pages ------------------------------------------------------------------------------------

MAIN = "article main content post entry story text prose blog page document paper body-content article-body post-content entry-content main-content story-body read".split()
WRAP = "wrapper container outer inner row col grid layout site page-wrap app root column region wrap section block".split()
FURNITURE = {
    "nav": ("nav menu navbar navigation top-menu main-menu breadcrumb breadcrumbs links tabs toolbar pager pagination toc".split(), ("nav", "div", "ul", "menu", "header")),
    "header": ("header masthead site-header top topbar branding logo banner-top hero-header".split(), ("header", "div")),
    "notice": ("notice cookie cookies consent alert gdpr warning cookie-banner announcement message popup modal overlay paywall".split(), ("div", "section", "aside", "dialog")),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner adsense ad-slot partner commercial".split(), ("div", "aside", "section", "ins")),
    "aside": ("sidebar side aside widget related recommended more-stories popular trending tags tag-cloud archive recent author-box share social sharing follow".split(), ("aside", "div", "section")),
    "form": ("form search newsletter subscribe signup login contact-form subscription feedback poll".split(), ("form",)),
    "comments": ("comments comment comment-list respond reply replies discussion thread disqus reader-comments user-comments responses".split(), ("section", "div", "ol", "ul", "aside")),
    "footer": ("footer site-footer bottom copyright legal colophon foot credits imprint".split(), ("footer", "div")),
}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la que ion ment tre eau ü ä ß ung keit é è ció ñ rr".split()


def synthetic_page(seed: int) -> tuple[str, list[int]]:
    """A made-up page and the labels of its leaf blocks (1: main text), in page order."""
    r = random.Random(seed)
    out: list[str] = []
    labels: list[int] = []
    style = r.choice(("repeat", "caps", "marked", "marked", "", "", "", "", ""))
    mark = r.choice((" |", " |", "!!", "%%%", "&amp;&amp;", "###", ",", " -")) if style == "marked" else ""

    def words(n: int) -> str:
        if style == "repeat":
            some = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(max(1, n // 8))]
            return " ".join(x.capitalize() for x in some for _ in range(8))
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + (mark if r.random() < 0.7 else "") for _ in range(n))

    def sentence(n: int) -> str:
        text = words(n)
        if style == "caps":
            return text.upper() + "!!"
        return (text[:1].upper() + text[1:] + r.choice((".", ".", ".", "!", "?", ""))).replace(" ", r.choice((" ", " ", " ", "\n ", "  ")), 1)

    def attributes(names: list[str]) -> str:
        if not names or r.random() < 0.1:
            return ""
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice((" ", "-", "_")) + r.choice(("box", "area", "list", "inner", "item", "1", "wide", "default", "left"))
        return f' {r.choice(("class", "class", "class", "id", "role"))}="{name}"'

    def inline(text: str) -> str:
        if r.random() < 0.35:
            parts = text.split(" ")
            i = r.randrange(len(parts))
            tag = r.choice(("a href='/x'", "b", "em", "strong", "i", "span class=x", "code"))
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
            text = " ".join(parts)
        return text

    def leaf(tag: str, text: str, label: int, more: str = "") -> None:
        form = r.random()
        if tag == "p" and form < 0.12:
            out.append(f"<p{more}><b>{text}<br>")
        elif tag in ("p", "li") and form < 0.25:
            out.append(f"<{tag}{more}>{inline(text)}")
        else:
            out.append(f"<{tag}{more}>{inline(text)}</{tag}>")
        labels.append(label)

    def furniture(kind: str) -> None:
        names, tags = FURNITURE[kind]
        tag = r.choice(tags)
        plain = tag in ("div", "section", "ul", "ol", "ins")
        mark = attributes(names) if not plain else f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-box", " box", "-1", "_area"))}"'
        out.append(f"<{tag}{mark}>")
        if kind in ("nav", "header", "footer") and r.random() < 0.75:
            listed = tag not in ("ul", "ol", "menu") and r.random() < 0.7
            out.append("<ul>" if listed else "")
            for _ in range(r.randint(2, 8)):
                if listed or tag in ("ul", "ol", "menu"):
                    out.append(f'<li><a href="/{r.randint(1, 99)}">{words(r.randint(1, 3))}</a></li>')
                else:
                    out.append(f'<div><a href="/{r.randint(1, 99)}">{words(r.randint(1, 3))}</a></div>')
                labels.append(0)
            out.append("</ul>" if listed else "")
        if kind == "form":
            for _ in range(r.randint(1, 3)):
                leaf(r.choice(("label", "p", "button", "div")), words(r.randint(1, 6)), 0)
            if r.random() < 0.4:
                out.append("<select>" + "".join(f"<option>{words(1)}" for _ in range(2)) + "</select>")
                labels.extend((0, 0))
        elif kind == "comments":
            if r.random() < 0.7:
                leaf(r.choice(("h2", "h3", "h4")), words(r.randint(1, 3)), 0)
            for _ in range(r.randint(1, 5)):
                own = r.random() < 0.6
                shell = "li" if tag in ("ol", "ul") else r.choice(("div", "article", "section"))
                out.append(f"<{shell}{attributes(['comment', 'comment-body', 'reply', 'comment-item']) if own else ''}>")
                if r.random() < 0.5:
                    leaf("div", words(2), 0)
                for _ in range(r.randint(1, 2)):
                    leaf("p", sentence(r.randint(3, 40)), 0)
                out.append(f"</{shell}>")
        elif kind not in ("nav",) or r.random() < 0.2:
            if tag in ("ul", "ol"):
                for _ in range(r.randint(1, 4)):
                    leaf("li", words(r.randint(1, 6)), 0)
            elif r.random() < 0.4:
                out.append(inline(sentence(r.randint(2, 25))))
                labels.append(0)
            else:
                if r.random() < 0.5:
                    leaf(r.choice(("h2", "h3", "h4", "p")), words(r.randint(1, 5)), 0)
                for _ in range(r.randint(1, 4)):
                    leaf(r.choice(("p", "p", "div", "p")), sentence(r.randint(3, 30)), 0)
        out.append(f"</{tag}>")

    def article() -> None:
        kind = r.random()
        tag = "article" if kind < 0.5 else "main" if kind < 0.65 else r.choice(("div", "div", "section", "td"))
        named = tag in ("div", "section", "td")
        mark = f' {r.choice(("class", "class", "id"))}="{r.choice(MAIN)}"' if named and r.random() < 0.85 else attributes(MAIN)
        if tag == "td":
            out.append("<table><tr>")
        out.append(f"<{tag}{mark}>")
        if r.random() < 0.15:
            out.append("<header>")
        if r.random() < 0.85:
            leaf("h1", sentence(r.randint(1, 14)), 1)
            if out[-2] == "<header>":
                out.append("</header>")
        elif out[-1] == "<header>":
            out.pop()
        deeper = r.random() < 0.3
        if deeper:
            out.append(f"<div{attributes(MAIN)}>")
        for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20, 30))):
            what = r.random()
            if what < 0.72:
                leaf("p", sentence(r.choice((1, 2, 5, 15, 30, 60, 90))), 1)
            elif what < 0.80:
                leaf(r.choice(("h2", "h3")), words(r.randint(1, 6)), 1)
            elif what < 0.86:
                out.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    leaf("li", sentence(r.randint(1, 15)), 1)
                out.append("</ul>")
            elif what < 0.90:
                out.append("<blockquote>")
                leaf("p", sentence(r.randint(3, 30)), 1)
                out.append("</blockquote>")
            elif what < 0.92:
                leaf(r.choice(("pre", "figcaption")), words(r.randint(2, 15)), 1)
            elif what < 0.94:
                out.append("<table>")
                for _ in range(2):
                    out.append("<tr>")
                    for _ in range(2):
                        leaf("td", words(r.randint(1, 4)), 1)
                    out.append("</tr>")
                out.append("</table>")
            else:
                furniture(r.choice(("ad", "aside", "ad", "notice", "form", "nav")))
            if r.random() < 0.04:
                out.append("<script>if(a<b){c('</p>')}</script><!-- x > y -->")
        if deeper:
            out.append("</div>")
        if r.random() < 0.15:
            furniture(r.choice(("aside", "comments", "footer")))
        out.append(f"</{tag}>")
        if tag == "td":
            out.append("</tr></table>")

    out.append(f"<!DOCTYPE html><html><head><title>{words(r.randint(1, 8))}</title><style>p{{margin:0}}</style></head><body>")
    labels.append(0)
    shells = [r.choice(("div", "section")) for _ in range(r.choice((0, 0, 1, 2, 3)))]
    for tag in shells:
        out.append(f"<{tag}{attributes(WRAP)}>")
    before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < 0.4]
    r.shuffle(before)
    for kind in before:
        furniture(kind)
    article()
    after = [k for k in ("aside", "comments", "ad", "form", "nav", "notice", "footer") if r.random() < 0.4]
    for kind in after:
        furniture(kind)
    for tag in reversed(shells):
        out.append(f"</{tag}>")
    if r.random() < 0.4:
        furniture("footer")
    out.append("</body></html>")
    return r.choice(("", "", "\n")).join(out), labels


@lru_cache(maxsize=2)
def trained(pages: int = 2400, rounds: int = 10, seed: int = 11) -> Labeller:
    """The labeller, trained on ``pages`` made-up pages by Adam. Deterministic."""
    model = Labeller()
    data = []
    for i in range(pages):
        page, labels = synthetic_page(seed * 100_003 + i)
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            data.append((blocks, np.array(labels, dtype=np.float32)))
    data.sort(key=lambda x: len(x[0]))
    groups = [data[at : at + 24] for at in range(0, len(data), 24)]
    batches = [(Batch.of([b for b, _ in g]), np.concatenate([y for _, y in g])) for g in groups]
    mean, square, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    order = random.Random(seed)
    for epoch in range(rounds):
        rate = 0.01 * (1 - epoch / rounds) + 0.0005
        order.shuffle(batches)
        for batch, labels in batches:
            grad, _ = model.gradients(batch, labels)
            step += 1
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                if k == "word":  # what words are in a block should tip the scales, not carry the decision
                    model.p[k] *= np.float32(1 - 0.1 * rate)
                model.p[k] -= ((0.1 * rate if k == "word" else rate) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def main_text(model: Labeller, pages: list[str]) -> list[str]:
    """The blocks labelled as main text, one to a line."""
    blocks = [blocks_of(page) for page in pages]
    return ["\n".join(b.text for b, y in zip(page, label, strict=True) if y >= 0.5) for page, label in zip(blocks, model.labels(blocks), strict=True)]


def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            text = main_text(model, texts_of(batch, "html").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html). One pass, no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract(model or trained()), "page_id long, url string, text string, n_chars long")
