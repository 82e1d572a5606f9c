"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: text between the borders of block-level tags. A block's vector holds its hashed tag
path (names, classes, ids and roles of the open elements), hashed words and a few measures. A bidirectional LSTM in numpy
reads the whole sequence and labels every block with both directions' states; blocks labelled main are joined.

The labeller is trained here, on the ``sample_pages`` different pages of the smallest hashes. Their labels come from the page's own
elements (an article without its asides), and each page is read several times with other tags, hidden classes and
inserted blocks (comments, forms, notices, adverts, sidebars), so that it learns context and not one template.

Cases: null or empty html has no text; pages are read whole, however long; the content of scripts, styles, templates,
titles, frames and form controls is no text, all other content is, formulas and what stands in for objects included; a
head needs no end; broken markup is read as far as it goes: an open comment, script or style swallows the rest; repeated rows are rows; an empty table gives no rows; columns not in
``keep`` are left out.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .arrow import map_slices

# Elements whose tags do not end a block, elements whose content is no text, and elements without content.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span "
    "strike strong sub sup time tt u var wbr object canvas svg g text tspan math mrow mi mn mo ms mtext mfrac msqrt mroot "
    "mstyle msub msup msubsup munder mover munderover semantics annotation".split()
)
SKIPPED = frozenset("script style template title textarea select button iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names that say what a part of a page is, as the trainer reads them.
MAIN = frozenset("article main content post story entry".split())
ASIDE = frozenset(
    "nav header footer aside form ad ads advert banner cookie notice sidebar menu comment comments promo related share "
    "social popup newsletter breadcrumb widget".split()
)

_TAG = re.compile(r"<!--|<([/!?]?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAMES = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order; white space is one space, character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(page)

    def end_block() -> None:
        nonlocal linked, in_link
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append(Block(text, tuple(x for _, names in stack for x in names), linked))
        held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        held.append(text)
        if in_link:
            linked += len(text.strip())

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None or m[1] in ("!", "?"):
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            if tag == "br":
                held.append(" ")
            continue
        end_block()
        in_link = False
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in SKIPPED:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = n if close is None else close.end()
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if stack and stack[-1][0] == "p" or stack and tag == "li" and stack[-1][0] == "li":
            stack.pop()
        names = [tag]
        for found in _NAMED.findall(m[3]):
            names += _NAMES.findall("".join(found).lower())
        if tag not in ("html", "head", "body"):
            stack.append((tag, tuple(names)))
    end_block()
    return out


PATH, WORDS, MEASURES = 96, 32, 8
INPUT, HIDDEN = PATH + WORDS + MEASURES, 24
REMEMBERED = 200_000


class Places(dict):
    """A name's place in a vector of ``size``, by hash."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        k = self[name] = crc32(name.encode()) % self.size
        return k


_PATHS, _WORDS = Places(PATH), Places(WORDS)


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block: tag path, words and measures."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    for i, b in enumerate(blocks):
        row = out[i]
        for depth, name in enumerate(reversed(b.path)):
            row[_PATHS[name]] += 1 / (1 + 0.2 * depth)
        words = b.text.split()
        counts = np.bincount([_WORDS[w] for w in words], minlength=WORDS)
        row[PATH:PATH + WORDS] = counts / np.sqrt(len(words))
        size = len(b.text)
        row[PATH + WORDS:] = (
            np.log1p(size) / 8, b.linked / size, np.log1p(len(words)) / 6, b.text.count(".") / len(words),
            b.text.count(",") / len(words), b.text[-1:] in ".!?", i / len(blocks), 1 / (1 + len(blocks)),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 7):
        rnd = np.random.default_rng(seed)
        scale = lambda a, b: (rnd.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w["x" + side] = scale(INPUT, 4 * HIDDEN)
            self.w["h" + side] = scale(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1
            self.w["b" + side] = bias
        self.w["out"] = scale(2 * HIDDEN + INPUT, 1)
        self.w["c"] = np.zeros(1, np.float32)

    def _read(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States of one direction; x: steps, pages, inputs. Masked steps keep the state."""
        steps, pages, _ = x.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        into = x @ self.w["x" + side] + self.w["b" + side]
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = into[t] + h @ self.w["h" + side]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, tanh, m))
            h = m * (o * tanh) + (1 - m) * h
            c = m * new + (1 - m) * c
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        forward, kept_f = self._read(x, mask, "f")
        backward, kept_b = self._read(x, mask, "b")
        both = np.concatenate((forward, backward, x), axis=2)
        return _sigmoid((both @ self.w["out"])[:, :, 0] + self.w["c"]), (both, kept_f, kept_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, kept_f, kept_b) = self.forward(x, mask)
        d = ((p - y) * mask / max(1.0, mask.sum()))[:, :, None].astype(np.float32)
        g = {"out": np.einsum("tpk,tpo->ko", both, d), "c": d.sum((0, 1))}
        back = d @ self.w["out"].T
        for side, kept, part in (("f", kept_f, back[:, :, :HIDDEN]), ("b", kept_b, back[:, :, HIDDEN:2 * HIDDEN])):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w["h" + side])
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, h, c, i, f, o, cell, tanh, m in reversed(kept):
                dh = dh + part[t]
                inner = m * dh
                dnew = inner * o * (1 - tanh**2) + m * dc
                dz = np.concatenate((
                    dnew * cell * i * (1 - i), dnew * c * f * (1 - f), inner * tanh * o * (1 - o), dnew * i * (1 - cell**2)
                ), axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = (1 - m) * dh + dz @ self.w["h" + side].T
                dc = dnew * f + (1 - m) * dc
            g["x" + side] = np.einsum("tpi,tpz->iz", x, dz_all)
            g["h" + side], g["b" + side] = gh, dz_all.sum((0, 1))
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 14, batch: int = 32, rate: float = 0.01) -> None:
        """Adam over batches of pages of about equal length, in a fixed order of shuffles."""
        rnd = np.random.default_rng(3)
        ordered = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        groups = [ordered[k:k + batch] for k in range(0, len(ordered), batch)]
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        spread = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(rounds):
            for k in rnd.permutation(len(groups)):
                x, mask, y = padded([pages[i] for i in groups[k]])
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    mean[name] = 0.9 * mean[name] + 0.1 * g
                    spread[name] = 0.99 * spread[name] + 0.01 * g * g
                    move = mean[name] / (1 - 0.9**step) / (np.sqrt(spread[name] / (1 - 0.99**step)) + 1e-8)
                    self.w[name] = (self.w[name] - rate * move).astype(np.float32)

    def label(self, pages: list[np.ndarray], most: int = 20_000) -> list[np.ndarray]:
        """Main or not for every block; pages of about equal length are read together, ``most`` blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        ordered = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        held: list[int] = []
        for place, k in enumerate(ordered):
            held.append(k)
            last = place + 1 == len(ordered)
            if last or (len(held) + 1) * len(pages[ordered[place + 1]]) > most:
                x, mask, _ = padded([(pages[j], np.zeros(len(pages[j]))) for j in held])
                p, _ = self.forward(x, mask)
                for column, j in enumerate(held):
                    out[j] = p[:len(pages[j]), column] >= 0.5
                held = []
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask, y = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, (rows, labels) in enumerate(pages):
        x[:len(labels), k], mask[:len(labels), k], y[:len(labels), k] = rows, 1, labels
    return x, mask, y


def by_elements(blocks: list[Block]) -> list[int]:
    """Labels from the page's own elements: main inside an article or main element, but for its asides."""
    inside = any(not MAIN.isdisjoint(b.path) for b in blocks)
    return [
        int(ASIDE.isdisjoint(b.path) and (not MAIN.isdisjoint(b.path) if inside else "p" in b.path)) for b in blocks
    ]


# Other elements that stand for the same part of a page, as the trainer writes them.
OTHER_MAIN = (("article",), ("main",), ("div", "content"), ("div", "post"), ("section", "story"), ("div", "entry", "content"), ("div",), ("td",))
OTHER_ASIDE = {
    "nav": (("nav",), ("ul", "menu"), ("div", "navbar"), ("div", "menu"), ("div", "breadcrumb")),
    "header": (("header",), ("div", "header"), ("div", "masthead")),
    "footer": (("footer",), ("div", "footer"), ("div", "copyright")),
    "ad": (("div", "ad"), ("div", "advert"), ("div", "sponsored"), ("ins", "ads"), ("div", "promo")),
    "aside": (("aside",), ("div", "sidebar"), ("div", "related"), ("div", "widget")),
    "form": (("form",), ("form", "search"), ("div", "newsletter", "form")),
    "notice": (("div", "cookie", "notice"), ("div", "banner"), ("div", "popup"), ("div", "notice")),
    "comments": (("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment", "list")),
}


def varied(blocks: list[Block], labels: list[int], others: list[Block], rnd: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page as another template would show it, with blocks of ``others`` in parts that are not the article."""
    main = OTHER_MAIN[rnd.integers(len(OTHER_MAIN))]
    aside = {k: v[rnd.integers(len(v))] for k, v in OTHER_ASIDE.items()}
    out: list[tuple[Block, int]] = []

    def strange(kind: str, most: int, inner: tuple[str, ...] = ("p",)) -> list[tuple[Block, int]]:
        found = []
        for _ in range(rnd.integers(1, most + 1)):
            b = others[rnd.integers(len(others))]
            words = b.text.split()[:int(rnd.integers(1, 60))]
            text = " ".join(words)
            found.append((Block(text, (*aside[kind], *inner) if rnd.random() < 0.8 else aside[kind], len(text) if rnd.random() < 0.2 else 0), 0))
        return found

    def within(path: tuple[str, ...]) -> tuple[str, ...]:
        new: tuple[str, ...] = ()
        for name in path:
            new += main if name in MAIN else aside.get(name, (name,))
        return new

    if rnd.random() < 0.4:
        out += strange("notice", 2)
    if rnd.random() < 0.4:
        out += strange("header", 3, ("h1",) if rnd.random() < 0.5 else ("p",))
    if rnd.random() < 0.3:
        out += strange("aside", 4, ("li",) if rnd.random() < 0.5 else ("p",))
    for b, y in zip(blocks, labels):
        out.append((Block(b.text, within(b.path), b.linked), y))
        if y and rnd.random() < 0.05:
            out += [(Block(c.text, (*main, *c.path), c.linked), 0) for c, _ in strange("ad" if rnd.random() < 0.6 else "form", 1)]
    foot = len(out)
    while foot and out[foot - 1][1] == 0:
        foot -= 1
    tail: list[tuple[Block, int]] = []
    for kind, chance in (("comments", 0.5), ("form", 0.3), ("aside", 0.3)):
        if rnd.random() < chance:
            tail += strange(kind, 5, ("div", "p") if kind == "comments" else ("p",))
    if tail and rnd.random() < 0.3:
        tail = [(Block(c.text, (*main, *c.path), c.linked), 0) for c, _ in tail]
    out[foot:foot] = tail
    return [b for b, _ in out], [y for _, y in out]


def sampled(pages: DataFrame, html: str, most: int) -> list[str]:
    """The ``most`` different pages of the smallest hashes, or all if there are fewer; copies count once."""
    hashed = pages.where(F.col(html).isNotNull()).select(F.col(html).alias("html"), F.xxhash64(html).alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(most).collect()]
    return sorted(r["html"] for r in hashed.where(F.col("h").isin(least)).select("html").distinct().collect())


def fit(pages: DataFrame, html: str = "html", sample_pages: int = 300, copies: int = 4) -> Labeller:
    """Train on ``sample_pages`` different pages, each as it is and in ``copies`` variants."""
    sample = sampled(pages, html, sample_pages)
    rnd = np.random.default_rng(11)
    parsed = [b for b in map(blocks_of, sample) if b]
    others = [b for page in parsed for b in page]
    made = []
    for blocks in parsed:
        labels = by_elements(blocks)
        made.append((blocks, labels))
        made += [varied(blocks, labels, others, rnd) for _ in range(copies)]
    labeller = Labeller()
    if made:
        labeller.train([(vectors(b), np.array(y)) for b, y in made])
    return labeller


def extract(pages: DataFrame, labeller: Labeller, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` beside text: every page's main blocks in page order, joined by a space."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(part: pa.RecordBatch) -> list:
        parsed = [blocks_of(h or "") for h in part.column(part.schema.get_field_index(html)).to_pylist()]
        labels = shared.value.label([vectors(b) for b in parsed])
        return [[" ".join(b.text for b, y in zip(page, ys) if y) for page, ys in zip(parsed, labels)]]

    kept = [c for c in keep if c != "text"]
    source = pages.select(*dict.fromkeys([*kept, html]))
    return map_slices(source, run, StructType([StructField("text", StringType())]), html, kept)
