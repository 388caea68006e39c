"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks of text. A bidirectional LSTM in numpy reads a vector of each block's tag path and of
its hashed words, and says of each block, with the whole page in view, whether it belongs to the article.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
_BROKEN = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Elements without blocks of their own, without an end, without text of the page, and that end an open one of their kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object select textarea title head math canvas audio video".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

#: Words of tags, classes and ids that mark what surrounds an article, and the article.
AROUND = frozenset(
    "ad ads advert adverts advertisement aside banner breadcrumb breadcrumbs button byline comment comments consent cookie cookies copyright dialog disclaimer disqus "
    "footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended related "
    "reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
WITHIN = frozenset("article main content post entry story".split())
#: First parts of names such as no-sidebar or has-ads, which tell of a layout and not of a block; tags that hold one block of text.
LAYOUT = frozenset("has hide hidden is no not show with without".split())
SINGLE = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd label figcaption".split())


@dataclass
class Leaf:
    node: int  # the innermost open block
    text: str
    linked: float  # share of the characters in links


@dataclass
class Page:
    """Blocks as they open (node 0 is the page itself): the block around each, and its words; and the leaves in page order."""

    parent: list[int]
    words: list[tuple[str, ...]]
    leaves: list[Leaf]


@lru_cache(1 << 15)
def _words(name: str, attributes: str) -> tuple[str, ...]:
    """Tag and words of class, id and role; a name with a layout part stays whole."""
    words = [name]
    for match in _NAMES.finditer(attributes):
        for one in next(g for g in match.groups() if g is not None).lower().split():
            parts = [w for w in re.split(r"[^a-z0-9]+", one) if w]
            words += ["-".join(parts)] if len(parts) > 1 and parts[0] in LAYOUT else parts
    return tuple(words)


def _tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, closing, tag, attributes) in page order, in linear time; the tag is empty where only text comes."""
    at = from_ = 0
    last = page.rfind(">")
    text: list[str] = []
    while (lt := page.find("<", from_)) >= 0:
        follows = page[lt + 1 : lt + 9]
        if follows.startswith("!--"):
            end = page.find("-->", lt + 4)
            stop = len(page) if end < 0 else end + 3
        elif follows == "![CDATA[":
            end = page.find("]]>", lt)
            text += [page[at:lt], html.escape(page[lt + 9 : len(page) if end < 0 else end])]
            at = from_ = len(page) if end < 0 else end + 3
            continue
        elif follows[:1] in ("!", "?"):
            end = page.find(">", lt)
            stop = len(page) if end < 0 else end + 1
        else:
            tag = _TAG.match(page, lt) if lt < last and (follows[:1].isalpha() or follows[:1] == "/") else None
            if tag:
                yield "".join([*text, page[at:lt]]), tag[1], tag[2].lower(), tag[3]
                text = []
                at = from_ = tag.end()
                if tag[2].lower() in SILENT and not tag[1] and not tag[3].rstrip().endswith("/"):
                    stop = _ends(tag[2].lower()).search(page, at)
                    # an unclosed head ends with what follows it
                    at = from_ = stop.end() if stop else at if tag[2].lower() == "head" else len(page)
                continue
            if lt > last:  # no tag can end: a broken one at the end of the page goes
                rest = _BROKEN.search(page, page.rfind("<"))
                text.append(page[at : rest.start() if rest else len(page)])
                at = len(page)
                break
            from_ = lt + 1
            continue
        text.append(page[at:lt])
        at = from_ = stop
    yield "".join([*text, page[at:]]), "", "", ""


@lru_cache(64)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


def parse(page: str | None) -> Page:
    """Blocks of text in page order, character references decoded, white space runs as one space, markup and scripts gone."""
    out = Page([0], [()], [])
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    links = inside = 0

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.leaves.append(Leaf(stack[-1][1] if stack else 0, text, min(1.0, links / len(text))))
            parts.clear()
        links = 0

    def pop(names: tuple[str, ...], barrier: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in barrier:
                return

    for text, closing, name, rest in _tokens(page or ""):
        if text:
            parts.append(text)
            links += len(text) if inside else 0
        if not name or name in SILENT:
            continue
        if name == "br":
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                inside = 0 if closing else 1
        elif closing:
            end()
            pop((name,))
        else:
            end()
            if name in BLOCKS_END_P:
                pop(("p",), frozenset({"td", "th", "li", "div", "article", "section"}))
            if name in CLOSES:
                pop(CLOSES[name], frozenset({"ul", "ol", "dl", "table"} - {name}))
            if name not in VOID and not rest.rstrip().endswith("/"):
                out.parent.append(stack[-1][1] if stack else 0)
                out.words.append(_words(name, rest))
                stack.append((name, len(out.parent) - 1))
    end()
    return out


class Blocks:
    """What can be said of each block of a page, in one pass up and one down: blocks open after those around them."""

    def __init__(self, page: Page):
        n = len(page.parent)
        self.held, self.count = [0.0] * n, [0] * n
        total = 0.0
        for leaf in page.leaves:
            size = len(leaf.text) * (1 - leaf.linked)
            total += size
            self.held[leaf.node] += size
            self.count[leaf.node] += 1
        marked, has = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            up, words = page.parent[k], page.words[k]
            self.held[up] += self.held[k]
            self.count[up] += self.count[k]
            if self.count[k] and (has[k] or words[0] == "h1" or not WITHIN.isdisjoint(words)):
                has[up] = marked[up] = True
        self.held = [h / total if total else 0.0 for h in self.held]
        # A wrapper says nothing of a block: it holds over half of the text outside links with a headline or an article below it, or nine tenths in three leaves.
        self.wide = [k == 0 or page.words[k][0] in ("html", "body") or (self.held[k] > 0.5 and marked[k]) or (self.held[k] > 0.9 and self.count[k] >= 3) for k in range(n)]
        # Blocks of one shape side by side, with several leaves each: entries of a list, rows of a table, comments.
        alike: dict[tuple, int] = {}
        for k in range(1, n):
            if self.count[k] > 1:
                key = (page.parent[k], page.words[k])
                alike[key] = alike.get(key, 0) + 1
        title = next((leaf.node for leaf in page.leaves if page.words[leaf.node][:1] == ("h1",)), 0)
        around = {0}
        while title:
            around.add(title)
            title = page.parent[title]
        self.like, self.depth, self.shared, self.several = [0] * n, [0] * n, [0] * n, [0] * n
        self.heading, self.item = [False] * n, [False] * n
        for k in range(1, n):
            up, words = page.parent[k], page.words[k]
            self.like[k] = max(self.like[up], alike.get((up, words), 0))
            self.depth[k] = self.depth[up] + 1
            self.shared[k] = self.depth[k] if k in around else self.shared[up]
            self.several[k] = self.several[up] if words[0] in SINGLE else k
            self.heading[k] = self.heading[up] or words[0] in ("h1", "h2", "h3")
            self.item[k] = self.item[up] or words[0] == "li"
        self.deepest = max(1, max(self.depth[k] for k in around) - 1)


def surrounded(page: Page, blocks: Blocks) -> list[bool]:
    """Of each leaf whether the words of its path say that it isn't of the article. A header within an article may hold its title."""
    bad, within = [False] * len(page.parent), [False] * len(page.parent)
    for k in range(1, len(page.parent)):
        bad[k], within[k] = bad[page.parent[k]], within[page.parent[k]]
        if blocks.wide[k]:
            continue
        for word in page.words[k]:
            bad[k] = bad[k] or word in AROUND and not (within[k] and word == "header")
            within[k] = within[k] or word in WITHIN
    return [bad[leaf.node] for leaf in page.leaves]


PATH, WORDS = 32, 16
SIZE = PATH + WORDS + 15


class _Slots(dict):
    """Place and sign of a word as one number below 2 * places: the second half is negative."""

    def __init__(self, places: int):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        code = zlib.crc32(word.encode())
        self[word] = slot = code % self.places + (0 if code >> 16 & 1 else self.places)
        return slot


_SLOTS = _Slots(WORDS)


@lru_cache(1 << 15)
def _hashed_words(words: tuple[str, ...]) -> tuple[np.ndarray, float]:
    """What a block's own words add to a path's vector, and how much of the path around it remains."""
    out = np.zeros(PATH, np.float32)
    for depth, word in enumerate(reversed(words)):
        code = zlib.crc32(word.encode())
        out[code % PATH] += (1.0 if code >> 16 & 1 else -1.0) * 0.7**depth
    return out, 0.7 ** len(words)


def vectors(page: Page) -> np.ndarray:
    """A row for each leaf: hashed tag path, hashed words, and what can be measured on the block. No list of names is consulted
    but to find wrappers (see Blocks)."""
    x = np.zeros((len(page.leaves), SIZE), np.float32)
    if not len(x):
        return x
    blocks = Blocks(page)
    paths = [np.zeros(PATH, np.float32)]
    for k in range(1, len(page.parent)):
        around = paths[page.parent[k]]
        if blocks.wide[k] or not blocks.count[k]:
            paths.append(around)
        else:
            own, rest = _hashed_words(page.words[k])
            paths.append(own + rest * around)
    title = next((k for k, leaf in enumerate(page.leaves) if page.words[leaf.node][:1] == ("h1",)), 0)
    for k, leaf in enumerate(page.leaves):
        node = leaf.node
        x[k, :PATH] = paths[node]
        words = leaf.text.lower().split()
        hashed = np.bincount([_SLOTS[w] for w in words], minlength=2 * WORDS)
        x[k, PATH : PATH + WORDS] = (hashed[:WORDS] - hashed[WORDS:]) / np.sqrt(len(words))
        n = len(leaf.text)
        x[k, PATH + WORDS :] = (
            blocks.held[page.parent[node]] if node else 1.0,
            blocks.held[blocks.several[node]] if blocks.several[node] else 1.0,
            np.log1p(n) / 6,
            leaf.linked,
            sum(leaf.text.count(c) for c in ".,;:!?") / np.sqrt(n + 1),
            leaf.text[-1] in ".!?\"'»”",
            sum(leaf.text.count(c) for c in "0123456789") / n,
            page.words[node][:1] == ("p",),
            blocks.heading[node],
            blocks.item[node],
            k / max(1, len(x) - 1),
            "©" in leaf.text,
            np.log1p(blocks.like[node]) / 2,
            k >= title,
            blocks.shared[node] / blocks.deepest,
        )
    return x


LINKED = PATH + WORDS + 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output a block."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.15, (SIZE, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.15, 2 * hidden + SIZE + 1).astype(np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States over time of one direction; the padding is at the end of what is read."""
        n, steps, _ = x.shape
        hid = self.hidden
        fed = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        states, tape = np.zeros((n, steps, hid), np.float32), []
        for t in range(steps):
            z = fed[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * hid : (k + 1) * hid]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * hid :])
            new = f * c + i * g
            tape.append((h, c, i, f, o, g, new))
            on = mask[:, t : t + 1]
            c = np.where(on, new, c)
            h = np.where(on, o * np.tanh(new), h)
            states[:, t] = h
        return states, tape

    def forward(self, pages: list[np.ndarray]) -> tuple[np.ndarray, dict]:
        lengths = np.array([len(x) for x in pages])
        steps = int(lengths.max())
        x = np.zeros((len(pages), steps, SIZE), np.float32)
        for k, page in enumerate(pages):
            x[k, : len(page)] = page
        mask = np.arange(steps) < lengths[:, None]
        # reading backwards begins at each page's own end
        back = np.where(mask, lengths[:, None] - 1 - np.arange(steps), np.arange(steps))
        rows = np.arange(len(pages))[:, None]
        ahead, tape_f = self._pass(x, mask, "f")
        behind, tape_b = self._pass(x[rows, back], mask, "b")
        both = np.concatenate([ahead, behind[rows, back], x, np.ones((*mask.shape, 1), np.float32)], axis=2)
        return _sigmoid(both @ self.p["o"]), {"x": x, "mask": mask, "back": back, "both": both, "f": tape_f, "b": tape_b}

    def _backward(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list, slope: np.ndarray, grads: dict) -> None:
        n, steps, _ = x.shape
        hid = self.hidden
        dz_all = np.zeros((n, steps, 4 * hid), np.float32)
        dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        for t in reversed(range(steps)):
            h, c, i, f, o, g, new = tape[t]
            on = mask[:, t : t + 1]
            top = (dh + slope[:, t]) * on
            squashed = np.tanh(new)
            inner = (top * o * (1 - squashed**2) + dc * on) * on
            dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), top * squashed * o * (1 - o), inner * i * (1 - g**2)], axis=1)
            dz_all[:, t] = dz
            grads[f"h{d}"] += h.T @ dz
            dh = np.where(on, dz @ self.p[f"h{d}"].T, dh)
            dc = np.where(on, inner * f, dc)
        flat = dz_all.reshape(-1, 4 * hid)
        grads[f"x{d}"] += x.reshape(-1, SIZE).T @ flat
        grads[f"c{d}"] += flat.sum(axis=0)

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        """Cross-entropy by back-propagation through time, in Adam steps over shuffled batches."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        sizes = np.array([len(x) for x in pages])
        for _ in range(epochs):
            # pages of like length share a batch, and batches come in any order
            order = np.argsort(sizes * rng.uniform(0.7, 1.3, len(sizes)), kind="stable")
            for at in batch * rng.permutation(-(-len(order) // batch)):
                chosen = order[at : at + batch]
                some = [pages[i] for i in chosen]
                out, kept = self.forward(some)
                want = np.zeros_like(out)
                for k, i in enumerate(chosen):
                    want[k, : len(labels[i])] = labels[i]
                slope = ((out - want) * kept["mask"] / kept["mask"].sum()).astype(np.float32)
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["o"] = np.einsum("ntf,nt->f", kept["both"], slope)
                down = slope[..., None] * self.p["o"][: 2 * self.hidden]
                rows = np.arange(len(some))[:, None]
                self._backward(kept["x"], kept["mask"], "f", kept["f"], down[..., : self.hidden], grads)
                self._backward(kept["x"][rows, kept["back"]], kept["mask"], "b", kept["b"], down[..., self.hidden :][rows, kept["back"]], grads)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of the blocks of each page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            most = max(1, min(128, 20_000 // max(1, len(pages[order[min(at + 127, len(order) - 1)]]))))
            some = order[at : at + most]
            found, _ = self.forward([pages[i] for i in some])
            for k, i in enumerate(some):
                out[i] = found[k, : len(pages[i])]
            at += most
        return out


def site(url: str | None) -> str:
    """Host of an address, without case."""
    return re.sub(r"^[a-z][a-z0-9+.-]*:", "", (url or "").strip().lower()).lstrip("/").split("/")[0].split("?")[0].split("#")[0]


def _code(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def keys(url: str | None, page: Page) -> list[int]:
    """Of each leaf a number of (site, text)."""
    return [_code(site(url), leaf.text) for leaf in page.leaves]


def evidence(page: Page, repeated: Iterable[bool]) -> np.ndarray:
    """Labels without a look at the vectors: 0 where most of a block is in links, its text stands on other pages of the site
    or a name says so, else 1. A headline (h1) may repeat: lists and copies carry it too."""
    named, titled = surrounded(page, Blocks(page)), [False] * len(page.parent)
    for k in range(1, len(titled)):
        titled[k] = titled[page.parent[k]] or page.words[k][0] == "h1"
    return np.array([float(not (leaf.linked >= 0.5 or again and not titled[leaf.node] or name)) for leaf, again, name in zip(page.leaves, repeated, named, strict=True)])


def agreed(parsed: list[Page], labels: list[np.ndarray], least: int = 5, share: float = 0.9) -> list[np.ndarray]:
    """Labels after a vote of like paths: where at least `share` of the blocks of one path, `least` of them, stand around the article, all do."""
    paths, votes = [], {}
    for page, y in zip(parsed, labels, strict=True):
        blocks, own = Blocks(page), [()]
        for k in range(1, len(page.parent)):
            around = own[page.parent[k]]
            own.append(around if blocks.wide[k] else hash((around, page.words[k])))
        paths.append([own[leaf.node] for leaf in page.leaves])
        for path, good in zip(paths[-1], y, strict=True):
            n, bad = votes.get(path, (0, 0))
            votes[path] = n + 1, bad + (not good)
    out = {path for path, (n, bad) in votes.items() if n >= least and bad >= share * n}
    return [np.array([0.0 if path in out else v for path, v in zip(of, y, strict=True)]) for of, y in zip(paths, labels, strict=True)]


#: Marks the article's blocks in a designed page, until it is parsed.
_GOOD = "\x01"
#: Listed names of what surrounds an article, for designed pages; reader comments apart.
_SIDE = ("ad", "advert", "banner", "cookie", "newsletter", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "teaser", "widget", "notice", "subscribe")
_TALK = ("comments", "comment", "replies", "reply", "respond", "disqus")


class Designer:
    """Training pages of invented designs from texts of real ones, every block's label known.

    Wrappers, articles, bars, adverts, notices, forms, footers and comments have listed, invented or no names; articles hold
    headings, lists, quotations, tables and code; comments are prose like the article's, signed and dated, in blocks of one shape.
    """

    def __init__(self, good: list[str], bad: list[str], rng: np.random.Generator):
        self.good, self.bad, self.rng = good or ["text"], bad or ["text"], rng

    def any(self, *of: str) -> str:
        return str(of[int(self.rng.integers(0, len(of)))])

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def name(self, *listed: str) -> str:
        """A class or id: one of the listed, or an invented one; never one that speaks for something else."""
        word = self.any(*listed) if listed and self.chance(0.5) else "".join(chr(97 + c) for c in self.rng.integers(0, 26, self.rng.integers(4, 11)))
        return f' {self.any("class", "id")}="{word}"'

    def prose(self, least: int = 8, most: int = 90) -> str:
        words = self.good[int(self.rng.integers(0, len(self.good)))].split()
        n = int(self.rng.integers(least, most))
        at = int(self.rng.integers(0, max(1, len(words) - n)))
        return html.escape(" ".join(words[at : at + n]).rstrip(",;:")) + self.any(".", ".", ".", "!", "?", "")

    def short(self) -> str:
        words = (self.bad if self.chance(0.5) else self.good)[0 if len(self.good) < 2 else int(self.rng.integers(0, min(len(self.good), len(self.bad))))].split()
        return html.escape(" ".join(words[: int(self.rng.integers(1, 6))]).rstrip(".,;:"))

    def date(self) -> str:
        d, m, y, h = (int(self.rng.integers(a, b)) for a, b in ((1, 28), (1, 13), (2008, 2026), (0, 24)))
        return self.any(f"{d}.{m}.{y}", f"{y}-{m:02d}-{d:02d}", f"{d}/{m}/{y} {h}:15", f"{self.short()} {d}, {y}", f"{d} {self.short()} {y}")

    def link(self) -> str:
        return f'<a href="/{int(self.rng.integers(0, 999))}">{self.short()}</a>'

    def body(self) -> str:
        out = []
        for _ in range(int(self.rng.integers(2, 9))):
            kind = self.rng.random()
            g = lambda least=2, most=14: _GOOD + self.prose(least, most)
            if kind < 0.62:
                tag = self.any("p", "p", "p", "p", "div")
                out.append(f"<{tag}>{g(6, 110)}</{tag}>")
            elif kind < 0.72:
                tag = self.any("h2", "h3", "h2")
                out.append(f"<{tag}>{_GOOD}{self.short()}</{tag}>")
            elif kind < 0.82:
                tag = self.any("ul", "ol")
                out.append(f"<{tag}>" + "".join(f"<li>{g(1, 25)}</li>" for _ in range(int(self.rng.integers(2, 7)))) + f"</{tag}>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{g(5, 50)}</p></blockquote>" if self.chance(0.6) else f"<blockquote>{g(5, 50)}</blockquote>")
            elif kind < 0.95:
                width = int(self.rng.integers(2, 5))
                cell = lambda tag: f"<{tag}>{_GOOD}{self.short() if self.chance(0.5) else int(self.rng.integers(0, 9999)) / 10}</{tag}>"
                out.append("<table>" + "".join("<tr>" + "".join(cell("th" if r == 0 else "td") for _ in range(width)) + "</tr>" for r in range(int(self.rng.integers(2, 6)))) + "</table>")
            else:
                out.append(f"<pre><code>{_GOOD}{self.short()} = {self.short()}({int(self.rng.integers(0, 99))}); {self.prose(2, 12)}</code></pre>" if self.chance(0.5) else f"<figure><img src=x><figcaption>{g(3, 15)}</figcaption></figure>")
        return "".join(out)

    def comments(self) -> str:
        name, rng = self.name(*_TALK), self.rng
        tag = self.any("section", "div", "ul", "ol", "div", "section")
        inner = "li" if tag in ("ul", "ol") else self.any("div", "article", "div", "section")
        own = self.name("comment", "reply") if self.chance(0.6) else ""
        if "comment" in name or "repl" in name or "respond" in name or "disqus" in name:
            if self.chance(0.35):  # the name alone tells
                return f"<{tag}{name}>" + "".join(f"<{'li' if inner == 'li' else 'p'}>{self.prose()}</{'li' if inner == 'li' else 'p'}>" for _ in range(int(rng.integers(1, 6)))) + f"</{tag}>"
        author, when = self.any("b", "strong", "span", "div", "p", "h4", "cite"), self.any("span", "time", "div", "small", "p")
        shape = int(rng.integers(0, 3))
        part = lambda t, x: f"<{t}>{x}</{t}>" if t in ("div", "p", "h4") else f"<div><{t}>{x}</{t}></div>"
        out = []
        for _ in range(int(rng.integers(1, 9))):
            text = "".join(f"<p>{self.prose(3, 70)}</p>" for _ in range(1 + self.chance(0.25)))
            head = part(author, self.short()) + (part(when, self.date()) if shape != 1 else "")
            tail = f"<div>{self.any('Reply', 'Antworten', '')}</div>" if shape == 2 else ""
            out.append(f"<{inner}{own}>{head}{text}{tail}</{inner}>")
        title = f"<{self.any('h2', 'h3', 'h4')}>{self.short()}</{self.any('h2', 'h3', 'h4')}>" if self.chance(0.6) and inner != "li" else ""
        form = f"<form><label>{self.short()}</label><textarea></textarea><button>{self.short()}</button></form>" if self.chance(0.3) and inner != "li" else ""
        return f"<{tag}{name}>{title}{''.join(out)}{form}</{tag}>"

    def side(self) -> str:
        name, kind = self.name(*_SIDE), int(self.rng.integers(0, 5))
        tag = self.any("div", "aside", "section", "div")
        if kind == 0:
            return f"<{tag}{name}><p>{self.prose(3, 25)}</p></{tag}>" if self.chance(0.5) else f"<{tag}{name}>{self.prose(3, 25)}</{tag}>"
        if kind == 1:
            return f"<{tag}{name}><h3>{self.short()}</h3><ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(int(self.rng.integers(2, 7)))) + f"</ul></{tag}>"
        if kind == 2:
            return f"<form{name}><label>{self.short()}</label><input><p>{self.prose(3, 15)}</p><button>{self.short()}</button></form>"
        if kind == 3:
            return f"<{tag}{name}><h3>{self.short()}</h3><p>{self.prose(4, 30)}</p><p>{self.link()}</p></{tag}>"
        return f"<{tag}{name}>" + " ".join(self.link() for _ in range(int(self.rng.integers(2, 6)))) + f"</{tag}>"

    def bar(self) -> str:
        if self.chance(0.5):
            return f"<nav><ul>{''.join(f'<li>{self.link()}</li>' for _ in range(int(self.rng.integers(3, 9))))}</ul></nav>"
        return f"<div{self.name('menu', 'navbar', 'topbar', 'masthead', 'navigation')}>{''.join(f'<div>{self.link()}</div>' if self.chance(0.5) else self.link() + ' ' for _ in range(int(self.rng.integers(3, 9))))}</div>"

    def foot(self) -> str:
        tag = self.any("footer", "div", "footer", "div")
        name = self.name("footer", "copyright", "legal") if tag == "div" else ""
        lines = [f"© {int(self.rng.integers(1999, 2026))} {self.short()}"] * self.chance(0.7) + [self.prose(3, 25) for _ in range(int(self.rng.integers(0, 3)))] + [self.link()] * self.chance(0.6)
        return f"<{tag}{name}>" + "".join(f"<p>{x}</p>" if self.chance(0.6) else f"<div>{x}</div>" for x in lines or [self.short()]) + f"</{tag}>"

    def reworded(self, page: Page, labels: np.ndarray) -> Page:
        """The page with other texts, some like an article's, in the blocks around the article: their place and path tell, not their words."""
        leaves = []
        for leaf, good in zip(page.leaves, labels, strict=True):
            text = leaf.text
            if not good and self.chance(0.7):
                text = html.unescape(self.prose(3, 30)) if self.chance(0.5) else self.bad[int(self.rng.integers(0, len(self.bad)))]
            leaves.append(Leaf(leaf.node, text or "-", leaf.linked))
        return Page(page.parent, page.words, leaves)

    def page(self) -> tuple[Page, np.ndarray]:
        tag = self.any("article", "div", "main", "section", "div")
        name = self.name("content", "article", "post", "entry", "story", "main") if tag in ("div", "section") or self.chance(0.3) else ""
        title = f"<h1>{_GOOD}{self.short()} {self.short()}</h1>"
        before = "".join(self.side() for _ in range(int(self.rng.integers(0, 3))))
        after = [self.side() for _ in range(int(self.rng.integers(0, 3)))]
        if self.chance(0.65):
            after.insert(int(self.rng.integers(0, len(after) + 1)), self.comments())
        within = self.chance(0.25)  # what follows stands inside the article's block
        body = self.body() if not self.chance(0.15) else self.body() + self.side() + self.body()
        head = f"<header>{title}</header>" if self.chance(0.2) else title
        article = f"<{tag}{name}>{head}{body}{''.join(after) if within else ''}</{tag}>"
        if self.chance(0.15):
            article = f"<div{self.name()}>{title}</div><{tag}{name}>{body}{''.join(after) if within else ''}</{tag}>"
        middle = before + article + ("" if within else "".join(after))
        for _ in range(int(self.rng.integers(0, 3))):
            middle = f"<div{self.name('wrapper', 'page', 'container', 'site')}>{middle}</div>"
        page = parse(f"<body>{self.bar() if self.chance(0.8) else ''}{middle}{self.foot() if self.chance(0.85) else ''}</body>")
        labels = np.array([float(_GOOD in leaf.text) for leaf in page.leaves])
        for leaf in page.leaves:
            leaf.text = leaf.text.replace(_GOOD, "") or "-"
        return page, labels


def train(parsed: list[Page], labels: list[np.ndarray], designed: int = 500, seed: int = 11, span: int = 256) -> Labeller:
    """A labeller from pages with their evidence and from `designed` pages made of their texts.

    The real pages come as often as the designed ones, as they are once and then with other words around the article. Half of all hide their links, which are evidence themselves. Every leaf of a page is learned, of a long page in
    spans of `span` leaves.
    """
    rng, labels = np.random.default_rng(seed), agreed(parsed, labels)
    texts = {good: sorted({leaf.text for page, y in zip(parsed, labels, strict=True) for leaf, v in zip(page.leaves, y, strict=True) if bool(v) == good}) for good in (True, False)}
    designer = Designer(texts[True], texts[False], rng)
    known = [(page, y) for page, y in zip(parsed, labels, strict=True) if page.leaves]
    again = max(1, round(designed / max(1, len(known)))) - 1
    known += [(designer.reworded(page, y), y) for _ in range(again) for page, y in known] + [designer.page() for _ in range(designed if known else 0)]
    pages, wanted = [], []
    for page, y in known:
        x = vectors(page)
        if rng.random() < 0.5:
            x[:, LINKED] = 0
        for at in range(0, len(x), span):
            pages.append(x[at : at + span])
            wanted.append(y[at : at + span])
    model = Labeller()
    if pages:
        model.fit(pages, wanted)
    return model


def repeated_keys(pages: DataFrame, wanted: set[int], least: int = 3) -> set[int]:
    """Of the wanted keys of (site, text) those on `least` pages at least that differ in their three longest other blocks: copies of a page count once."""
    shared = pages.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(source)
                found = keys(url, page)
                longest = [k for _, k in sorted(set(zip((-len(x.text) for x in page.leaves), found, strict=True)))[:4]]
                for key in set(found) & shared.value:
                    pairs.add((key, _code(*(str(k) for k in [k for k in longest if k != key][:3]))))
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in (0, 1)], ["key", "page"])

    seen = pages.select("url", "html").mapInArrow(run, "key long, page long").groupBy("key").agg(F.countDistinct("page").alias("n"))
    return {r["key"] for r in seen.filter(F.col("n") >= least).select("key").collect()}


def extract(pages: DataFrame, sample: int = 200, longest: int = 100_000, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars, the blocks of the article joined by line feeds.

    The labeller learns from the `sample` pages of at most `longest` characters with the least hash of page_id; which of their
    blocks repeat on a site is counted over all pages. Null, empty or textless html gives an empty text. Repeated rows are
    read alike; no rows give no rows.
    """
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    usable = slim.filter((F.length("html") > 0) & (F.length("html") <= longest))
    chosen = usable.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    taken = usable.join(F.broadcast(chosen), "page_id", "left_semi").orderBy("page_id", "url", "html").select("url", "html").limit(2 * sample)
    learned = [(r["url"], parse(r["html"])) for r in taken.collect()]
    known = [keys(*x) for x in learned]
    again = repeated_keys(slim, {k for found in known for k in found}) if learned else set()
    labels = [evidence(page, [k in again for k in found]) for (_, page), found in zip(learned, known, strict=True)]
    shared = slim.sparkSession.sparkContext.broadcast(train([page for _, page in learned], labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [parse(x) for x in part.column("html").to_pylist()]
                found = shared.value.label([vectors(x) for x in parsed])
                texts = ["\n".join(leaf.text for leaf, p in zip(page.leaves, likely, strict=True) if p >= 0.5) for page, likely in zip(parsed, found, strict=True)]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
