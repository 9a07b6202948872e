"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with the path of open tags (and the
words of their classes, ids and roles) above it, hashed as tags open, so a block costs the same at any depth.
Each block becomes a vector: hashed path, hashed words and a few counts.  A bidirectional LSTM in numpy reads the blocks of the whole page in order, both ways,
and labels every block as main text or not, so a block is judged in the context of the document.

The labeller is trained here, with a fixed seed, on ``TRAINING_PAGES`` generated pages of many layouts
whose labels are known; tests measure it on held-out pages.  Training takes seconds and happens once in a
driver process; the weights (a fixed, small size) go to the executors with the task.

Text of scripts and styles is no block, nor is that of templates, text areas, selections and frames that
are closed; where one of those is not closed, it is read as any other element.  Formulas and drawings are
part of the text they stand in; players, objects and noscript elements are blocks for the labeller to judge.  Character
references are decoded, white space in a block becomes one space, and blocks without text go.  A tag whose
quotes never close ends at the next '>'.

Defined results: a null or empty page, and one without main text, gives an empty string; broken markup
never fails; a very long page takes time and memory in proportion to its length, at any depth of its tags;
repeated rows are extracted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import map_slices

#: Fixed lists of HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul noscript object canvas audio video".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; those of RAW reach to the page's end where they are not closed.
RAW_TAGS = frozenset("script style".split())
SILENT_TAGS = RAW_TAGS | frozenset("template select textarea iframe".split())
#: A start tag that ends an open element of the given kinds.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE_TAGS = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote".split())

_HEAD = r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)"
MARKUP = re.compile(_HEAD + r"((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.DOTALL)
#: The same without regard to quotes, for the rest of a page where quotes don't close.
LENIENT = re.compile(_HEAD + r"([^>]*+)(>?)", re.DOTALL)
CLOSED = {tag: re.compile(f"</{tag}(?![a-z0-9])[^>]*+>?", re.IGNORECASE | re.ASCII) for tag in SILENT_TAGS}
NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

PATH_SIZE, WORD_SIZE, COUNTS = 128, 48, 6
INPUT = PATH_SIZE + WORD_SIZE + COUNTS
HIDDEN = 20
TRAINING_PAGES, EPOCHS, SEED = 2400, 6, 11


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: np.ndarray, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _path_words(tag: str, attributes: str) -> list[str]:
    out = [tag]
    for groups in NAMED.findall(attributes) if "=" in attributes else ():
        for word in " ".join(groups).split():
            out += ["." + p.lower() for p in PARTS.findall(word)]
    return out


class _Open:
    """The open elements of a page; each operation takes constant time but for the elements that it closes."""

    def __init__(self):
        self.stack: list[tuple[str, np.ndarray]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def path(self) -> np.ndarray:
        return self.stack[-1][1] if self.stack else _NO_PATH

    def push(self, tag: str, attributes: str) -> None:
        path = self.path()
        if tag in BLOCK_TAGS or tag == "a":
            path = path.copy()
            for word in _path_words(tag, attributes):
                at, sign = _path_at[word]
                path[at] += sign
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE_TAGS:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, path))

    def cut(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > at:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPE_TAGS:
                self.scopes.pop()

    def last(self, names: tuple) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def end(self, names: tuple) -> None:
        """Close the last element of these kinds, if no scope has opened in it."""
        at = self.last(names)
        if at >= 0 and (not self.scopes or self.scopes[-1] <= at):
            self.cut(at)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; text is decoded and its white space is single spaces."""
    out: list[Block] = []
    pieces: list[str] = []
    open_, markup, unclosed = _Open(), MARKUP, set()
    linked = at = 0
    path = _NO_PATH

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        pieces.append(piece)
        if open_.places.get("a"):
            linked += len(piece.strip())

    while m := markup.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # the page ends before the tag does
            if markup is MARKUP:
                markup, at = LENIENT, m.start()
                continue
            at = m.start()  # no '>' is left: what follows is text
            break
        tag = m[2].lower()
        if tag in SILENT_TAGS and not m[1] and not m[3].endswith("/"):
            close = None if tag in unclosed else CLOSED[tag].search(page, at)
            if close or tag in RAW_TAGS:
                at = close.end() if close else len(page)
                pieces.append(" ")
                continue
            unclosed.add(tag)
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if m[1]:
            if (place := open_.last((tag,))) >= 0:
                open_.cut(place)
        else:
            if block:
                open_.end(("p",))
            if tag in ENDED_BY:
                open_.end(ENDED_BY[tag])
            if tag not in VOID_TAGS and not m[3].endswith("/"):
                open_.push(tag, m[3])
        if block:
            path = open_.path()
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _bucket(size: int):
    return lambda word: (zlib.crc32(word.encode("utf-8", "replace")) % size, 1.0 if zlib.crc32(b"#" + word.encode("utf-8", "replace")) & 1 else -1.0)


_path_at = Remembered(_bucket(PATH_SIZE), 1 << 16)
_word_at = Remembered(_bucket(WORD_SIZE), 1 << 17)
_NO_PATH = np.zeros(PATH_SIZE, np.float32)
#: Bound of a path's component, for pages of unheard-of depth.
MOST_PATH = 8.0


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT), np.float32)
    n = len(blocks)
    for i, b in enumerate(blocks):
        row = out[i]
        row[:PATH_SIZE] = b.path
        words = b.text.split()
        votes: dict[int, float] = {}
        for w in words:
            at, sign = _word_at[w]
            votes[at] = votes.get(at, 0.0) + sign
        scale = 1 / math.sqrt(len(words))
        for at, v in votes.items():
            row[PATH_SIZE + at] = max(-1.0, min(1.0, v * scale * 0.2))
        size = len(b.text)
        row[-COUNTS:] = (math.log1p(size) / 6, b.linked / size, min(1.0, sum(b.text.count(c) for c in ".,;!?") / len(words)), i / n, 1 - i / n, min(len(words), 40) / 40)
    return out.clip(-MOST_PATH, MOST_PATH)


class Labeller:
    """A bidirectional LSTM over block vectors, with one logistic unit on both directions' states."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"], self.w[f"h{d}"] = draw(INPUT, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # keep at first
            self.w[f"c{d}"] = bias
        self.w["o"], self.w["p"] = draw(2 * HIDDEN, 1), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """States (time, pages, HIDDEN) of one direction, and with ``keep`` what its gradient needs."""
        w, times = self.w, range(len(x))
        pre = x @ w[f"x{d}"] + w[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in times if d == "f" else reversed(times):
            z = pre[t] + h @ w[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep:
                kept.append((t, i, f, o, g, c, th, h, m))
            c, h = np.where(m, c_new, c), np.where(m, o * th, h)
            states[t] = h
        return states, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]), 2)
        return (both @ self.w["o"] + self.w["p"])[..., 0]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), 2)
        z = (both @ self.w["o"] + self.w["p"])[..., 0]
        p = 1 / (1 + np.exp(-z))
        n = mask.sum()
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n
        dz = ((p - y) * mask / n)[..., None].astype(np.float32)
        grad = {"o": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "p": dz.sum((0, 1))}
        dboth = dz @ self.w["o"].T
        for k, d in enumerate("fb"):
            dstates = dboth[..., k * HIDDEN : (k + 1) * HIDDEN]
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(self.w[f"h{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, i, f, o, g, c, th, h, m in reversed(runs[d][1]):
                dh = dh + dstates[t]
                dhm, dcm = np.where(m, dh, 0), np.where(m, dc, 0)
                dct = dcm + dhm * o * (1 - th * th)
                dgate = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), dhm * th * o * (1 - o), dct * i * (1 - g * g)), 1)
                dpre[t] = dgate
                dwh += h.T @ dgate
                dh = np.where(m, dgate @ self.w[f"h{d}"].T, dh)
                dc = np.where(m, dct * f, dc)
            flat = dpre.reshape(-1, 4 * HIDDEN)
            grad |= {f"x{d}": x.reshape(-1, INPUT).T @ flat, f"h{d}": dwh, f"c{d}": flat.sum(0)}
        return float(loss), grad

    def main(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            longest, end = len(pages[order[at]]), at
            while end < len(order) and end - at < 128 and len(pages[order[end]]) * (end - at + 1) <= max(20_000, longest):
                end += 1
            chosen = order[at : max(end, at + 1)]
            x, mask = _padded([features(pages[i]) for i in chosen])
            z = self.scores(x, mask)
            for k, i in enumerate(chosen):
                out[i] = z[: len(pages[i]), k] > 0
            at += len(chosen)
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, rows))
    x, mask = np.zeros((most, len(rows), INPUT), np.float32), np.zeros((most, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


#: Class words of generated pages: chrome and main text.
CHROME = {
    "nav": "nav navbar menu topnav breadcrumb breadcrumbs navigation toc links tabs".split(),
    "header": "header masthead topbar branding banner logo site-header hero".split(),
    "footer": "footer site-footer copyright legal colophon bottom foot".split(),
    "aside": "sidebar aside widget related recommended popular rail side secondary trending".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adsense banner-ad commercial".split(),
    "notice": "cookie cookies consent notice alert gdpr warning popup modal message paywall".split(),
    "form": "newsletter subscribe signup login search search-form contact form".split(),
    "comments": "comments comment reply replies responses disqus discussion comment-list reader-comments".split(),
    "share": "share social sharing follow tags meta byline author-box pagination pager".split(),
}
MAIN = "content post entry article story body main text post-content entry-content article-body story-body page-content".split()


def generated_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A page of a random layout with its blocks' texts and labels."""
    letters = "abcdefghiklmnoprstuvwäéñöüß"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(120)]
    labels: list[tuple[str, bool]] = []
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

    def words(a: int, b: int) -> str:
        return " ".join(rng.choices(vocabulary, k=rng.randint(a, b)))

    def odd(text: str) -> str:
        """Text as it also occurs on pages: shouted, with signs, as cells, one word again and again, numbers."""
        own = text.split()
        return (
            "!! ".join(own).upper() + "!!",
            " ".join(w + rng.choice(("***", "&&&", "$$$", "%%%", "###")) for w in own),
            " | ".join(own),
            " ".join([own[0]] * len(own)),
            " ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in own),
        )[style]

    style = rng.randrange(5)
    strange = rng.choice((0.0, 0.0, 0.05, 0.5, 0.9))

    def sentence(a: int = 4, b: int = 30) -> str:
        text = words(a, b).capitalize() + rng.choice(".....!?")
        return odd(text) if rng.random() < strange else text

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, 6)))

    def block(tag: str, text: str, main: bool, attributes: str = "") -> str:
        labels.append((" ".join(text.split()), main))
        inner = esc(text)
        if rng.random() < 0.15 and not main:
            inner = f'<a href="/{rng.randrange(99)}">{inner}</a>'
        if rng.random() < 0.1:
            inner = f"<b>{inner}" + ("</b>" if rng.random() < 0.5 else "<br>")
        end = "" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"
        return f"<{tag}{attributes}>{inner}{end}" + rng.choice(("", "\n", " "))

    def fallback() -> str:
        """What shows where scripts or players don't work."""
        tag = rng.choice(("noscript", "video", "audio", "object", "canvas"))
        labels.append((text := words(3, 10), False))
        return f"<{tag}>{esc(text)}</{tag}>"

    def listed(main: bool, linked: bool) -> str:
        items = []
        for _ in range(rng.randint(2, 8)):
            text = words(1, 3) if linked else sentence(3, 12)
            labels.append((text, main))
            items.append(f"<li><a href='/{rng.randrange(999)}'>{esc(text)}</a></li>" if linked else f"<li>{esc(text)}</li>")
        return f"<{(t := rng.choice(('ul', 'ol')))}>{''.join(items)}</{t}>"

    def filler(kind: str) -> str:
        if kind in ("nav", "share") or rng.random() < 0.25:
            return listed(False, kind != "comments")
        if kind == "form":
            return "".join(block(rng.choice(("label", "p", "button", "h3")), words(1, 8), False) for _ in range(rng.randint(1, 4)))
        if kind == "comments":
            return "".join(block(rng.choice(("p", "div", "li")), prose(), False) for _ in range(rng.randint(1, 6)))
        if kind == "footer" and rng.random() < 0.6:
            text = f"© {words(1, 3)} · {sentence(2, 12)}"
            labels.append((" ".join(text.split()), False))
            return esc(text).replace("©", "&copy;").replace("·", "&middot;")
        if rng.random() < 0.4:
            text = prose()
            labels.append((" ".join(text.split()), False))
            return esc(text)
        return "".join(block(rng.choice(("p", "h3", "div", "p")), rng.choice((prose, sentence))(), False) for _ in range(rng.randint(1, 3)))

    def chrome(kind: str) -> str:
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "ad": "aside"}.get(kind)
        if semantic and rng.random() < 0.55:
            attributes = f' class="{rng.choice(CHROME[kind])}"' if rng.random() < 0.4 else ""
            tag = semantic if kind != "ad" else "div"
            attributes = attributes or (f' class="{rng.choice(CHROME["ad"])}"' if kind == "ad" else "")
        else:
            tag, attributes = rng.choice(("div", "section", "div")), f' {rng.choice(("class", "id"))}="{rng.choice(CHROME[kind])}"'
        return f"<{tag}{attributes}>{filler(kind)}</{tag}>"

    def article() -> str:
        parts = []
        kind = rng.random()
        if kind < 0.55:
            start, end = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>")))
        else:
            start, end = f'<div {rng.choice(("class", "id"))}="{rng.choice(MAIN)}">', "</div>"
        if rng.random() < 0.85:
            parts.append(block(rng.choice(("h1", "h1", "h2")), words(3, 10), True))
        for _ in range(rng.randint(1, 14) if rng.random() < 0.85 else rng.randint(15, 60)):
            r = rng.random()
            if r < 0.72:
                parts.append(block("p", prose(), True))
            elif r < 0.80:
                parts.append(block(rng.choice(("h2", "h3")), words(1, 7), True))
            elif r < 0.85:
                parts.append(f"<blockquote>{block('p', prose(), True)}</blockquote>")
            elif r < 0.90:
                parts.append(listed(True, False))
            elif r < 0.93:
                parts.append(block("p", words(1, 3) + ".", True))
            elif r < 0.955:
                parts.append(block("pre", words(2, 20), True))
            elif r < 0.965:
                parts.append(fallback())
            else:
                parts.append(chrome(rng.choice(("ad", "share", "aside", "form"))))
        return start + "".join(parts) + end

    title = words(3, 9)
    labels.append((title, False))
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
    before = [k for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.45]
    after = [k for k in ("share", "aside", "comments", "ad", "form", "nav", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    wrap = rng.random() < 0.4
    body = (fallback() if rng.random() < 0.1 else "") + "".join(chrome(k) for k in before) + ("<div id='page'>" if wrap else "")
    body += article()
    body += "".join(chrome(k) for k in after) + ("</div>" if wrap else "")
    return head + body + rng.choice(("</body></html>", "")), labels


def labelled(page: str, labels: list[tuple[str, bool]]) -> tuple[list[Block], np.ndarray]:
    """A generated page's blocks with their labels; they come in the order in which they were made."""
    blocks, out, at = blocks_of(page), [], 0
    for b in blocks:
        while at < len(labels) and labels[at][0] != b.text:
            at += 1
        out.append(labels[at][1] if at < len(labels) else False)
        at += 1
    return blocks, np.array(out, np.float32)


def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = random.Random(seed)
    made = [labelled(*generated_page(rng)) for _ in range(pages)]
    made = [(features(b), y) for b, y in made if b]
    model = Labeller(np.random.default_rng(seed))
    first, second, step = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    made.sort(key=lambda m: len(m[1]))
    batches = [made[i : i + 24] for i in range(0, len(made), 24)]
    for epoch in range(epochs):
        rng.shuffle(batches)
        for batch in batches:
            x, mask = _padded([f for f, _ in batch])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, own) in enumerate(batch):
                y[: len(own), k] = own
            _, grad = model.gradient(x, mask, y)
            step += 1
            rate = 0.01 * (0.5 ** (epoch // 2))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


@functools.lru_cache(maxsize=1)
def labeller() -> Labeller:
    """The trained labeller, once in a process."""
    return train()


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    cut = [blocks_of(p or "") for p in pages]
    return ["\n".join(b.text for b, keep in zip(blocks, chosen) if keep) for blocks, chosen in zip(cut, model.main(cut))]


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    model = labeller()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(batch.column(2).to_pylist(), model)
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return map_slices(chosen, work, "page_id long, url string, text string, n_chars long")
