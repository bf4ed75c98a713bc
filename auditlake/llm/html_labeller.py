"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, in page order. Each block becomes a vector of its hashed tag path, its hashed
words and a few measures; a bidirectional LSTM in numpy reads the whole sequence, so that every block is
judged in the context of all others, and labels it main text or not. The network is trained here, by
back-propagation through time, on pages that a generator lays out at random with known labels; nothing about
the pages to label goes into it. labeller.npz beside this file holds what `train()` gives; after a change to the
features or the generator, `python -m auditlake.llm.html_labeller` writes it anew.
"""

from __future__ import annotations

import html
import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from pathlib import Path as File

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm._tables import table
from auditlake.llm._words import LANES, LOWER, NOT_SPACE, U, find_words, slices, word_hashes

PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 96, 32, 6, 20
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
SEED = 7

# possessive throughout: a tag is scanned once, and one that does not end before the page does ends the scan
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_OPENS_TAG = re.compile(r"</?[a-zA-Z]")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template noscript textarea select option svg iframe object head title".split())
_RAW = frozenset("script style textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_P = frozenset({"p"})
_CLOSES = {k: _P | set(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}
_CELLS = frozenset({"td", "th", "table"})
_TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in _RAW}


class Path:
    """An open element and, through its parent, all around it. Equal paths are one object, whatever page they are in."""

    __slots__ = ("_around", "_vector", "kids", "names", "parent", "tag")

    def __init__(self, parent: Path | None, tag: str, names: tuple):
        self.parent, self.tag, self.names, self.kids, self._around, self._vector = parent, tag, names, {}, None, None

    def child(self, tag: str, names: tuple) -> Path:
        own = self.kids.get((tag, names))
        if own is None:
            own = self.kids[tag, names] = Path(self, tag, names)
        return own

    def _add(self, v: np.ndarray, near: str) -> np.ndarray:
        if self.tag not in ("", "html", "body"):
            v = v.copy()
            for token in (near + self.tag, *[f".{n}" for n in self.names]):
                k, sign = _slot(token, PATH_SIZE)
                v[k] += sign
        return v

    def around(self) -> np.ndarray:
        """Sum of the hashed names of this element and all around it: one addition for each that has not been asked yet."""
        todo, at = [], self
        while at._around is None and at.parent is not None:
            todo.append(at)
            at = at.parent
        v = at._around if at._around is not None else np.zeros(PATH_SIZE, np.float32)
        for at in reversed(todo):
            v = at._around = at._add(v, "")
        return v

    def vector(self) -> np.ndarray:
        if self._vector is None:
            v = self._add(self.parent.around(), "leaf:") if self.parent is not None else np.zeros(PATH_SIZE, np.float32)
            self._vector = v / max(1.0, float(np.linalg.norm(v)) / 2)
        return self._vector


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Open:
    """The open elements, with counts by tag, in all and since the innermost table or cell, so that no search is in vain."""

    def __init__(self, root: Path):
        self.path, self.stack, self.total, self.scopes, self.silent = root, [], Counter(), [Counter()], 0

    def push(self, tag: str, names: tuple) -> None:
        if tag in _CELLS:
            self.scopes.append(Counter())
        self.path = self.path.child(tag, names)
        self.stack.append(tag)
        self.total[tag] += 1
        self.scopes[-1][tag] += 1
        self.silent += tag in _SILENT

    def pop(self) -> str:
        tag = self.stack.pop()
        self.path = self.path.parent
        self.total[tag] -= 1
        self.scopes[-1][tag] -= 1
        self.silent -= tag in _SILENT
        if tag in _CELLS:
            self.scopes.pop()
        return tag

    def close(self, tag: str) -> None:
        """Ends the innermost element of that name and all in it. Only the parts of tables end cells and tables around them."""
        if (self.total if tag in _TABLE_PARTS else self.scopes[-1])[tag]:
            while self.pop() != tag:
                pass

    def make_way(self, tag: str) -> None:
        """Ends the paragraph, list item or cell that the start of this block element ends."""
        shut, stack = _CLOSES.get(tag, _P), self.stack
        while stack and (stack[-1] in shut or (stack[-1] not in _BLOCK and stack[-1] not in _SILENT and any(t in shut for t in stack[-4:]))):
            self.pop()


_root = Path(None, "", ())
_asked = 0


def _paths(size: int) -> Path:
    """The root of all paths; a new one after so many characters of html that the old one may have grown large."""
    global _root, _asked
    _asked += size
    if _asked > 1 << 26:
        _root, _asked = Path(None, "", ()), size
    return _root


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text: path (tags and class names of all open elements), text, and the characters in links.

    Text between two marks of block elements is one block; inline marks and <br> do not end it. Unclosed
    paragraphs, list items and cells end where the next one begins. White space runs become one space. A tag
    or comment that is still open at the page's end has no text. Time and memory grow with the page's length,
    however deep it is nested.
    """
    out: list[Block] = []
    parts: list[str] = []
    opened = _Open(_paths(len(page)))
    path, linked = opened.path, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(path, text, linked))
            parts.clear()
        linked = 0

    def add(t: str) -> None:
        nonlocal linked
        if not opened.silent:
            parts.append(html.unescape(t) if "&" in t else t)
            if opened.total["a"]:
                linked += len(t)

    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        if mark > at:
            add(page[at:mark])
        m = _TAG.match(page, mark)
        if m is None:
            if page.startswith("<!--", mark):
                at = page.find("-->", mark + 4) + 3
                at = at if at > 2 else end
            elif page.startswith(("<!", "<?"), mark):
                at = page.find(">", mark) + 1 or end
            elif _OPENS_TAG.match(page, mark):
                at = end
            else:
                add("<")
                at = mark + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            flush()
        if m[1]:
            opened.close(tag)
        else:
            if tag in _BLOCK:
                opened.make_way(tag)
            if not m[3].endswith("/"):
                names = tuple(w for x in _NAMES.findall(m[3]) for w in re.split(r"[\s_\-]+", (x[0] or x[1] or x[2]).lower()) if w) if m[3] else ()
                opened.push(tag, names)
                if tag in _RAW:
                    ends = _RAW_END[tag].search(page, at)
                    at = ends.start() if ends else end
        path = opened.path
    flush()
    return out


@lru_cache(65536)
def _slot(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % size, 1.0 if h >> 31 else -1.0


def features(pages: list[list[Block]]) -> np.ndarray:
    """One row per block, of all pages one behind the other."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    for k, b in enumerate(flat):
        x[k, :PATH_SIZE] = b.path.vector()
    at = 0
    counts = np.zeros((len(flat), WORD_SIZE), np.float32)
    for s in slices(pa.array([b.text for b in flat], pa.string())):
        s.data = LOWER[s.data]
        w = find_words(s, NOT_SPACE)
        h = word_hashes(s.data, w, LANES[0])
        np.add.at(counts, (w.text + at, (h % U(WORD_SIZE)).astype(np.int64)), np.where(h >> U(63), 1, -1).astype(np.float32))
        x[at : at + len(s.start), -1] = np.log1p(np.diff(w.upto)) / 5
        at += len(s.start)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
    k = PATH_SIZE + WORD_SIZE
    size = np.fromiter((len(b.text) for b in flat), np.float32, len(flat))
    x[:, k] = np.log1p(size) / 6
    x[:, k + 1] = np.minimum(np.fromiter((b.linked for b in flat), np.float32, len(flat)) / np.maximum(size, 1), 1)
    x[:, k + 2] = np.fromiter((b.text[-1] in ".!?:;…\"”" for b in flat), np.float32, len(flat))
    place = np.concatenate([np.arange(len(p)) / max(len(p) - 1, 1) for p in pages])
    x[:, k + 3], x[:, k + 4] = place, 1 - place
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output. Parameters of both directions: W (input), U (recurrent), b; then v, c."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = []
        for _ in range(2):
            self.p += [rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32), np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)]
        self.p += [rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]

    def _run(self, x: np.ndarray, mask: np.ndarray, k: int, keep: bool) -> tuple[np.ndarray, list]:
        """x: time x pages x input. Padding keeps the state, so that a direction can start behind it. The tape is for training."""
        w, u, bias = self.p[3 * k : 3 * k + 3]
        n, pages = mask.shape
        z, h, c, out, tape = x @ w + bias, np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32), np.zeros((n, pages, HIDDEN), np.float32), [None] * n * keep
        for t in range(n) if k == 0 else range(n - 1, -1, -1):
            g = z[t] + h @ u
            i, f, o = (_sigmoid(g[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in (0, 1, 2))
            a, m = np.tanh(g[:, 3 * HIDDEN :]), mask[t][:, None]
            c2 = f * c + i * a
            tc = np.tanh(c2)
            if keep:
                tape[t] = (h, c, i, f, o, a, tc)
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[t] = h
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, k, False)[0] for k in (0, 1)], 2)
        return _sigmoid(both @ self.p[6] + self.p[7])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        (a, ta), (b, tb) = self._run(x, mask, 0, True), self._run(x, mask, 1, True)
        both = np.concatenate([a, b], 2)
        p = _sigmoid(both @ self.p[6] + self.p[7])
        n = mask.sum()
        d = np.where(mask, p - y, 0) / n
        loss = -float(np.sum(np.where(mask, np.log(np.where(y > 0, p, 1 - p) + 1e-9), 0)) / n)
        grads = [np.zeros_like(q) for q in self.p]
        grads[6], grads[7] = np.tensordot(d, both, ([0, 1], [0, 1])), np.array([d.sum()], np.float32)
        up = d[:, :, None] * self.p[6]
        for k, tape in ((0, ta), (1, tb)):
            u, steps = self.p[3 * k + 1], range(len(tape) - 1, -1, -1) if k == 0 else range(len(tape))
            dh, dc, dz = np.zeros_like(tape[0][0]), np.zeros_like(tape[0][0]), np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            for t in steps:
                h, c, i, f, o, g, tc = tape[t]
                m = mask[t][:, None]
                dh = dh + up[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                live = np.where(m, dh, 0)
                dct = np.where(m, dc, 0) + live * o * (1 - tc**2)
                dg = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
                dz[t] = dg
                grads[3 * k + 1] += h.T @ dg
                dh, dc = np.where(m, dg @ u.T, dh), np.where(m, dct * f, dc)
            grads[3 * k], grads[3 * k + 2] = np.tensordot(x, dz, ([0, 1], [0, 1])), dz.sum((0, 1))
        return loss, grads


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, rows))
    x, mask = np.zeros((n, len(rows), *rows[0].shape[1:]), np.float32), np.zeros((n, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


#: Class names that the generator gives to its parts; a part often has none.
_MAIN = "content article post entry body text story main page single blog news copy prose wrapper container col".split()
_PARTS = {
    "menu": ("nav ul div header", "nav menu navbar links topbar breadcrumb breadcrumbs site navigation primary tabs"),
    "head": ("header div", "header masthead banner top site brand logo hero"),
    "side": ("aside div section", "sidebar side widget related popular recent archive tags categories rail more recommended"),
    "notice": ("div section p aside", "notice alert cookie consent banner message gdpr warning info newsletter popup"),
    "ad": ("div aside section ins", "ad ads advert advertisement sponsor sponsored promo promoted banner"),
    "form": ("form div", "form search login subscribe signup newsletter contact comment"),
    "comments": ("div section ol ul", "comments comment reply replies discussion responses thread disqus"),
    "foot": ("footer div", "footer bottom copyright legal colophon site credits foot"),
    "share": ("div ul p", "share social meta byline tools follow buttons print"),
}


def training_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page laid out at random, and for each of its blocks whether it is main text."""
    syllables = ["".join(rng.choice(list("aeioubcdfglmnprstvé"), rng.integers(1, 4))) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))

    def words(lo: int, hi: int) -> str:
        t = " ".join(word() for _ in range(rng.integers(lo, hi + 1)))
        return t.capitalize() + str(rng.choice([".", ".", ".", "", "!", "?"]))

    html_, labels = [], []

    def named(kind: str, share: float = 0.75) -> tuple[str, str]:
        tags, names = _PARTS[kind]
        tag, names = str(rng.choice(tags.split())), names.split()
        if tag in ("div", "section", "ul", "ol", "p", "ins") or rng.random() < share - 0.35:
            return tag, f' {rng.choice(["class", "class", "id"])}="{" ".join(rng.choice(names, rng.integers(1, 3)))}"'
        return tag, ""

    def leaf(tag: str, text: str, y: int, inner: str = "{}") -> None:
        html_.append(f"<{tag}>{inner.format(text)}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))
        labels.append(y)

    def part(kind: str) -> None:
        tag, attr = named(kind)
        html_.append(f"<{tag}{attr}>")
        linked = kind in ("menu", "side", "share") or rng.random() < 0.2
        if kind in ("menu", "side", "share") and rng.random() < 0.8:
            if rng.random() < 0.4 and tag != "ul":
                leaf("h3", words(1, 3), 0)
            if tag not in ("ul", "ol"):
                html_.append("<ul>")
            for _ in range(rng.integers(2, 9)):
                leaf("li", words(1, 4 if kind == "menu" else 9), 0, '<a href="/x">{}</a>')
            if tag not in ("ul", "ol"):
                html_.append("</ul>")
        elif kind == "form":
            for _ in range(rng.integers(1, 4)):
                leaf(str(rng.choice(["div", "p"])), words(1, 6), 0)
            html_.append('<input type="text"><select><option>a<option>b</select>')
        elif kind == "comments":
            leaf("h3", words(1, 3), 0)
            for _ in range(rng.integers(1, 6)):
                html_.append(f'<{"li" if tag in ("ol", "ul") else "div"} class="comment">')
                if rng.random() < 0.6:
                    leaf("div", words(1, 4), 0)
                for _ in range(rng.integers(1, 3)):
                    leaf("p", words(4, 60), 0)
                html_.append(f'</{"li" if tag in ("ol", "ul") else "div"}>')
        elif kind in ("menu", "head", "foot", "share") and rng.random() < 0.5:
            html_.append(str(rng.choice([" ", " | ", "<br>"])).join(f'<a href="/x">{words(1, 3)}</a>' for _ in range(rng.integers(2, 7))))
            labels.append(0)
        elif rng.random() < 0.5:
            html_.append(words(2, 25))
            labels.append(0)
        else:
            for _ in range(rng.integers(1, 4)):
                leaf("div", words(2, 30), 0, '<a href="/y">{}</a>' if linked else "{}")
        html_.append(f"</{tag}>")

    def article(bare: bool = False) -> None:
        tag = "td" if bare else str(rng.choice(["article", "article", "main", "div", "section"]))
        attr = "" if bare else f' class="{" ".join(rng.choice(_MAIN, rng.integers(1, 3)))}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        html_.append(f"<{tag}{attr}>")
        if rng.random() < 0.8:
            leaf(str(rng.choice(["h1", "h1", "h2"])), words(2, 10), 1)
        if rng.random() < 0.15:
            part("share")
        for _ in range(rng.integers(30, 110) if rng.random() < 0.08 else rng.integers(1, 16)):
            r = rng.random()
            if r < 0.74:
                leaf("p", words(1, 5) if rng.random() < 0.35 else words(8, 90), 1, str(rng.choice(["{}", "{}", "<b>{}</b>", "<b>{}<br>", "<em>{}</em>", '{} <a href="/z">' + word() + "</a>"])))
            elif r < 0.82:
                leaf(str(rng.choice(["h2", "h3"])), words(1, 8), 1)
            elif r < 0.88:
                html_.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    leaf("li", words(1, 20) if rng.random() < 0.7 else words(8, 40), 1)
                html_.append("</ul>")
            elif r < 0.91:
                html_.append("<blockquote>")
                leaf("p", words(4, 40), 1)
                html_.append("</blockquote>")
            elif r < 0.93:
                leaf("pre", words(3, 20), 1)
            elif r < 0.95:
                html_.append("<table><tr>")
                for _ in range(rng.integers(1, 5)):
                    leaf("td", words(1, 6), 1)
                html_.append("</tr></table>")
            elif r < 0.97:
                part("ad")
            else:
                part("notice")
        if rng.random() < 0.1:
            part("comments")
        html_.append(f"</{tag}>")

    if rng.random() < 0.1:  # a page laid out as a table
        html_.append("<table>")
        for kind in ("head", "", "foot"):
            html_.append("<tr>")
            if kind or rng.random() < 0.8:
                html_.append("<td>" + str(rng.choice(["{}", "<font>{}</font>", "<b>{}</b>", '<a href="/x">{}</a>', '<a href="/x">{}</a><br><a href="/y">{}</a><br><a href="/z">{}</a>'])).replace("{}", words(1, 4 if kind != "foot" else 8)) + "</td>")
                labels.append(0)
            if not kind:
                article(bare=True)
                if rng.random() < 0.3:
                    leaf("td", words(1, 12), 0, '<a href="/x">{}</a>')
            html_.append("</tr>")
        html_.append("</table>")
        return f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(html_)}</body></html>", labels
    wrap = rng.random() < 0.4
    if wrap:
        html_.append(f'<div class="{rng.choice(["page", "wrapper", "container", "site", "layout"])}">')
    for kind, share in (("head", 0.4), ("menu", 0.8), ("notice", 0.25), ("ad", 0.4), ("side", 0.2), ("form", 0.1)):
        if rng.random() < share:
            part(kind)
    inner = rng.random() < 0.3  # the article shares its frame with what stands beside it
    if inner:
        html_.append(f'<div {rng.choice(["id", "class"])}="{rng.choice(["main", "content", "wrapper", "body", "page"])}">')
    if rng.random() < 0.97:
        article()
    if inner:
        for kind in ("side", "ad", "side"):
            if rng.random() < 0.5:
                part(kind)
        html_.append("</div>")
    for kind, share in (("share", 0.25), ("ad", 0.2), ("form", 0.15), ("comments", 0.4), ("side", 0.4), ("notice", 0.1), ("menu", 0.15), ("foot", 0.85)):
        if rng.random() < share:
            part(kind)
    if wrap:
        html_.append("</div>")
    return f"<html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(html_)}</body></html>", labels


WEIGHTS = "labeller.npz"


@lru_cache(1)
def trained() -> Labeller:
    """The network of train() as it was written to the package; training it takes the driver several seconds."""
    net = Labeller()
    with np.load(io.BytesIO(resources.files(__package__).joinpath(WEIGHTS).read_bytes())) as kept:
        net.p = [kept[f"p{k}"] for k in range(len(net.p))]
    return net


def train(seed: int = SEED, pages: int = 1500, epochs: int = 14, batch: int = 32) -> Labeller:
    """Adam over generated pages; the same network in every run and on every machine of one kind."""
    rng, net = np.random.default_rng(seed), Labeller(seed)
    made = [(blocks(page), y) for page, y in (training_page(rng) for _ in range(pages))]
    made = [(features([b]), np.array(y, np.float32)) for b, y in made if len(b) == len(y) and y]
    m, v, step = [np.zeros_like(q) for q in net.p], [np.zeros_like(q) for q in net.p], 0
    for epoch in range(epochs):
        order = sorted(range(len(made)), key=lambda k: (len(made[k][1]) + rng.integers(0, 8), k))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            x, mask = _padded([made[k][0] for k in groups[g]])
            y, _ = _padded([made[k][1] for k in groups[g]])
            _, grads = net.gradient(x, mask, y)
            scale = min(1.0, 1 / (1e-9 + float(np.sqrt(sum(float((q**2).sum()) for q in grads)))))
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for k, q in enumerate(grads):
                q = q * scale
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_blocks(net: Labeller, pages: list[list[Block]], most: int = 4096) -> list[np.ndarray]:
    """For each page which of its blocks are main text. Pages of like length are run together, at most `most` steps of padding wide."""
    size, x = [len(p) for p in pages], features(pages)
    upto = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = [np.zeros(n, bool) for n in size]
    order = [k for k in np.argsort(size, kind="stable").tolist() if size[k]]
    while order:
        n = max(1, min(len(order), 64, most // max(size[order[-1]], 1)))
        group, order = order[-n:], order[:-n]
        a, mask = _padded([x[upto[k] : upto[k + 1]] for k in group])
        p = net.probabilities(a, mask)
        for j, k in enumerate(group):
            out[k] = p[: size[k], j] >= 0.5
    return out


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, y in zip(bs, ys.tolist(), strict=True) if y) for bs, ys in zip(cut, label_blocks(net, cut), strict=True)]


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for s in slices(b.column("html"), 1 << 20):  # a MB of html at a time, or one longer page
                own = b.slice(s.first, s.last - s.first)
                texts = main_texts(net, [p or "" for p in own.column("html").to_pylist()])
                yield pa.record_batch([own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null, empty and blockless html gives empty text.

    Blocks labelled main are joined in page order by two newlines; a block's text has its character
    references decoded and its white space made single spaces. Nothing is cut short, and no shuffle is needed.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(net or trained())), schema)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


if __name__ == "__main__":
    np.savez_compressed(File(__file__).with_name(WEIGHTS), **{f"p{k}": q for k, q in enumerate(train().p)})
