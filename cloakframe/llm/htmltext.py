"""Main text of pages: a bidirectional LSTM in numpy labels every leaf block with the whole page as context."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cloakframe.llm.common import text_bytes
from cloakframe.llm.htmlblocks import Block, blocks

PATH_ROWS, PATH_DIM = 2048, 24
WORD_ROWS, WORD_DIM = 1024, 8
NUMBERS = 8


@dataclass(frozen=True)
class LabellerRules:
    hidden: int = 24
    #: Generated pages to train on, passes over them, and pages to a step.
    pages: int = 1800
    passes: int = 6
    batch: int = 30
    rate: float = 0.01
    seed: int = 11
    threshold: float = 0.5


# --- features ---------------------------------------------------------------


def path_rows(path: tuple[str, ...]) -> list[int]:
    """Hash rows of a tag path: each step's tag and names, and the last two tags by place."""
    rows = [crc32(w.encode()) % PATH_ROWS for step in path for w in dict.fromkeys(step.split())]
    for place, step in enumerate(path[-2:]):
        rows.append(crc32(f"{place - len(path[-2:])}:{step.split()[0]}".encode()) % PATH_ROWS)
    return rows or [0]


def word_rows(text: str) -> list[int]:
    return [crc32(w) % WORD_ROWS for w in text_bytes(text).lower().split()]


def numbers(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), NUMBERS), np.float32)
    for i, b in enumerate(page):
        size = len(b.text)
        n = b.text.count(" ") + 1
        out[i] = (np.log1p(size) / 5, np.log1p(n) / 4, min(1, b.link_chars / size), min(0.3, sum(map(b.text.count, ".,;!?")) / size * 5), b.text[-1] in ".!?…", i / len(page), min(3, b.depth / 10), b.text[:1].isupper())
    return out


class Page:
    def __init__(self, page: list[Block], cache: dict):
        self.numbers = numbers(page)
        self.paths = [cache.setdefault(b.path, path_rows(b.path)) for b in page]
        self.words = [word_rows(b.text) for b in page]

    def __len__(self) -> int:
        return len(self.paths)


def mean_rows(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((r for x in lists for r in x), np.int64, sizes.sum())
    return np.add.reduceat(table[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]


# --- the network ------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_weights(rules: LabellerRules) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(rules.seed)
    inputs, h = PATH_DIM + WORD_DIM + NUMBERS, rules.hidden
    made = {"path": rng.normal(0, 0.3, (PATH_ROWS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * h), "bias": np.zeros(1)}
    for side in ("f", "b"):
        made[f"w{side}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * h))
        made[f"u{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        made[f"c{side}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]  # open forget gates
    return {k: v.astype(np.float32) for k, v in made.items()}


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, c0: np.ndarray, keep: bool):
    """States (T, B, H) over x (T, B, D); masked steps carry the state on."""
    steps, count, _ = x.shape
    hidden = u.shape[0]
    given = x @ w + c0
    h, c = np.zeros((count, hidden), np.float32), np.zeros((count, hidden), np.float32)
    out, saved = np.zeros((steps, count, hidden), np.float32), []
    for t in range(steps):
        z = given[t] + h @ u
        gates = sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            saved.append((h, c, i, f, o, g, tanh))
        c = np.where(m, new, c)
        h = np.where(m, o * tanh, h)
        out[t] = h
    return out, saved


def lstm_back(dout: np.ndarray, x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, saved: list):
    """Gradients of x, w, u and the bias from those of the states."""
    steps, count, _ = x.shape
    dz_all = np.zeros((steps, count, u.shape[1]), np.float32)
    du = np.zeros_like(u)
    dh_next = np.zeros((count, u.shape[0]), np.float32)
    dc_next = np.zeros_like(dh_next)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh = saved[t]
        m = mask[t][:, None]
        dh_whole = dout[t] + dh_next
        dh, skip_h = np.where(m, dh_whole, 0), np.where(m, 0, dh_whole)
        dc, skip_c = np.where(m, dc_next, 0) + dh * o * (1 - tanh**2), np.where(m, 0, dc_next)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh_next = dz @ u.T + skip_h
        dc_next = dc * f + skip_c
    flat = dz_all.reshape(-1, dz_all.shape[2])
    return dz_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def inputs_of(pages: list[Page], weights: dict) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for b, page in enumerate(pages):
        n = len(page)
        mask[:n, b] = True
        x[:n, b] = np.concatenate([mean_rows(weights["path"], page.paths), mean_rows(weights["word"], page.words), page.numbers], axis=1)
    return x, mask


def forward(x: np.ndarray, mask: np.ndarray, weights: dict, keep: bool = False):
    front, saved_f = lstm(x, mask, weights["wf"], weights["uf"], weights["cf"], keep)
    back, saved_b = lstm(x[::-1], mask[::-1], weights["wb"], weights["ub"], weights["cb"], keep)
    both = np.concatenate([front, back[::-1]], axis=2)
    return sigmoid(both @ weights["out"] + weights["bias"]), both, saved_f, saved_b


def truth_of(page: list[Block], truth: set[str]) -> np.ndarray:
    """Which blocks have a text of the article; the document's title repeats one outside it."""
    return np.array([b.text in truth and "title" not in b.path for b in page], bool)


@lru_cache(maxsize=2)
def trained(rules: LabellerRules = LabellerRules()) -> dict[str, np.ndarray]:
    """Weights fitted to generated pages, by backpropagation through time and Adam; the same for the same rules."""
    rng = random.Random(rules.seed)
    cache: dict = {}
    made = []
    for _ in range(rules.pages):
        html, truth = generate_page(rng)
        page = blocks(html)
        labels = truth_of(page, truth).astype(np.float32)
        if page:
            made.append((Page(page, cache), labels))
    weights = start_weights(rules)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for _ in range(rules.passes):
        rng.shuffle(made)
        for at in range(0, len(made), rules.batch):
            part = made[at : at + rules.batch]
            grads = gradients([p for p, _ in part], [y for _, y in part], weights, rules)
            step += 1
            rate = rules.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return weights


def gradients(pages: list[Page], labels: list[np.ndarray], weights: dict, rules: LabellerRules) -> dict[str, np.ndarray]:
    x, mask = inputs_of(pages, weights)
    prob, both, saved_f, saved_b = forward(x, mask, weights, keep=True)
    y = np.zeros_like(prob)
    for b, own in enumerate(labels):
        y[: len(own), b] = own
    d = np.where(mask, prob - y, 0).astype(np.float32) / mask.sum()
    h = rules.hidden
    dboth = d[:, :, None] * weights["out"]
    dx_f, dwf, duf, dcf = lstm_back(dboth[:, :, :h], x, mask, weights["wf"], weights["uf"], saved_f)
    dx_b, dwb, dub, dcb = lstm_back(dboth[::-1, :, h:], x[::-1], mask[::-1], weights["wb"], weights["ub"], saved_b)
    dx = dx_f + dx_b[::-1]
    grads = {"wf": dwf, "uf": duf, "cf": dcf, "wb": dwb, "ub": dub, "cb": dcb, "out": np.einsum("tb,tbh->h", d, both), "bias": d.sum(keepdims=True).reshape(1)}
    grads["path"], grads["word"] = np.zeros_like(weights["path"]), np.zeros_like(weights["word"])
    for b, page in enumerate(pages):
        for name, lists, a, z in (("path", page.paths, 0, PATH_DIM), ("word", page.words, PATH_DIM, PATH_DIM + WORD_DIM)):
            sizes = np.array([len(r) for r in lists])
            flat = np.concatenate([np.array(r, np.int64) for r in lists])
            np.add.at(grads[name], flat, np.repeat(dx[: len(page), b, a:z] / sizes[:, None], sizes, axis=0))
    return grads


# --- generated training pages -----------------------------------------------

#: Names that pages commonly give to their parts; fixed lists for the generator.
MAIN = ("article", "main", "div content", "div post", "div article body", "div entry content", "section story", "div main content", "div post body", "main article", "div text", "div")
MENUS = ("nav", "ul menu", "div navbar", "div nav", "div breadcrumb", "div menu main", "nav site", "div pagination", "ul topnav", "div")
HEADS = ("header", "div header", "div masthead", "div top bar", "header site")
FEET = ("footer", "div footer", "div site footer", "div copyright", "footer page", "div")
SIDES = ("aside", "div sidebar", "div widget", "aside related", "div related posts", "div recommended", "section trending", "div")
NOTICES = ("div cookie", "div notice", "div cookie banner", "div consent", "div alert", "div gdpr", "section newsletter", "div popup", "p notice")
ADS = ("div ad", "div ads", "div advert", "div banner", "div sponsored", "div promo", "aside ad", "div advertisement", "section sponsor")
COMMENTS = ("div comments", "section comments", "ul comment list", "div comment thread", "div disqus thread", "ol commentlist", "div replies", "section responses")
SHARES = ("div share", "div social", "ul share links", "div tags", "div author box")
#: What the parts around an article commonly say.
MENU_WORDS = "home news about contact us sports weather archive login register search sitemap help services products blog gallery events careers navigation menu page talk edit history read view tools print".split()
FOOT_WORDS = "copyright all rights reserved privacy policy terms of use contact last modified this page was powered by disclaimers about".split()
NOTICE_WORDS = "we use cookies accept privacy policy agree consent settings subscribe newsletter terms".split()
COMMENT_WORDS = "reply said ago comment user posted like report great thanks".split()


class Writer:
    """Prose of made-up words, and the parts of a page around it."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = rng.choice(("aeiou", "aeiouäöü", "aeéèiouê", "aeiouáóí"))
        self.syllables = ["".join((rng.choice("bcdfghlmnprstvw"), rng.choice(letters), rng.choice(("", "n", "r", "s", "t")))) for _ in range(60)]
        self.short = [rng.choice(self.syllables) for _ in range(12)]
        self.junk = rng.choice(("", "", "", "", "", "###", "%%%", "&amp;&amp;", "$$$", " |", " |", " /", " -"))

    def word(self) -> str:
        if self.rng.random() < 0.35:
            return self.rng.choice(self.short)
        return "".join(self.rng.choices(self.syllables, k=self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() + (self.junk if self.junk and self.rng.random() < 0.7 else "") for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        made = []
        for _ in range(self.rng.randint(low, high)):
            s = self.words(1, 14)
            made.append((s[:1].upper() + s[1:]).replace(" ", ", ", 1 if self.rng.random() < 0.3 else 0) + ".")
        return " ".join(made)

    def tag(self, spec: str, inner: str, plain: bool = False) -> str:
        name, *names = spec.split()
        if not names or plain and name == "div":
            extra = f' class="c{self.rng.randint(1, 9)}"' if self.rng.random() < 0.3 else ""
            return f"<{name}{extra}>{inner}</{name}>"
        glue = self.rng.choice(("-", " ", "_"))
        return f'<{name} {self.rng.choice(("class", "class", "id"))}="{glue.join(names)}">{inner}</{name}>'

    def pick(self) -> str:
        """A word as it stands in a text, with the mark after it or a capital."""
        word = self.word()
        return (word.capitalize() if self.rng.random() < 0.4 else word) + self.rng.choice(("", "", "", ".", ",", ":"))

    def common(self, words: list[str], low: int, high: int) -> str:
        return " ".join(self.rng.choices(words, k=self.rng.randint(low, high))).capitalize()

    def links(self, low: int, high: int) -> str:
        style = self.rng.random()
        text = lambda: self.common(MENU_WORDS, 1, 2) if style < 0.15 else self.words(1, 3) if style < 0.6 else self.pick()
        made = [f'<a href="/{i}">{text()}</a>' for i in range(self.rng.randint(low, high))]
        style = self.rng.random()
        if style < 0.6:
            return f"<ul>{''.join(f'<li>{x}</li>' for x in made)}</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(made) if style < 0.8 else "".join(f"<div>{x}</div>" for x in made)


def old_page(w: Writer, title: str, kept: Callable[[str], str], foot: Callable[[], str]) -> str:
    """A page laid out by tables, without names: a head, a menu beside the article, and a foot."""
    rng = w.rng
    breaks = rng.choice(("<br><br>", "<p>", "<br>\n<br>"))
    body = [kept(w.sentences(1, rng.choice((2, 5, 9)))) for _ in range(rng.randint(1, 6))]
    text = "".join(f"<p>{x}</p>" for x in body) if breaks == "<p>" else "".join(f"<div>{x}</div>" for x in body)
    menu = "".join(f'<a href="{w.word()}.html">{w.common(MENU_WORDS, 1, 2) if rng.random() < 0.6 else w.words(1, 2)}</a>{rng.choice(("<br>", " | ", "<br><br>"))}' for _ in range(rng.randint(2, 9)))
    heading = rng.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<center><font size=5><b>{}</b></font></center>")).format(kept(title))
    cells = [f'<td width="{rng.randint(100, 180)}" valign=top>{menu}</td>', f"<td>{heading}{text}</td>"]
    if rng.random() < 0.3:
        cells.reverse()
    head = f'<tr><td colspan="2">{rng.choice((f"<img src=logo.gif> {w.words(1, 4)}", f"<b>{w.words(1, 3)}</b>", w.words(1, 4)))}</td></tr>' if rng.random() < 0.7 else ""
    tail = f'<tr><td colspan="2" align="center">{rng.choice(("{}", "<font size=1>{}</font>", "<small>{}</small>")).format(foot())}</td></tr>'
    return f"<html><head><title>{title}</title></head><body bgcolor=white><table>{head}<tr>{''.join(cells)}</tr>{tail}</table></body></html>"


def wiki_page(w: Writer, title: str, kept: Callable[[str], str], foot: Callable[[], str]) -> str:
    """A page of an encyclopaedia: contents and edit links in the article's element, menus after it."""
    rng = w.rng
    portlet = lambda: f'<div class="portlet" id="p-{w.word()}"><h3>{w.common(MENU_WORDS, 1, 2)}</h3>{w.links(2, 6)}</div>'
    sections = "".join(f"<h2>{kept(w.words(1, 4))}</h2>" + "".join(f"<p>{kept(w.sentences(1, 6))}</p>" for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
    contents = f'<div id="toc" class="toc"><h2>{rng.choice(("Contents", w.word()))}</h2>{w.links(2, 6)}</div>' if rng.random() < 0.5 else ""
    hat = f'<div id="jump-to-nav">{w.common(MENU_WORDS, 2, 4)}: {w.links(1, 2)}</div>' if rng.random() < 0.5 else ""
    article = f'<div id="content" class="mw-body"><h1 id="firstHeading">{kept(title)}</h1>{hat}<div id="bodyContent"><p>{kept(w.sentences(1, 5))}</p>{contents}{sections}</div></div>'
    around = f'<div id="mw-navigation"><h2>{rng.choice(("Navigation menu", w.common(MENU_WORDS, 1, 3)))}</h2>{"".join(portlet() for _ in range(rng.randint(1, 4)))}</div><div id="footer">{foot()}</div>'
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{article}{around}</body></html>"


def generate_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page from a random template, and the texts of its article's blocks."""
    w = Writer(rng)
    truth: set[str] = set()
    plain = rng.random() < 0.2  # no telling names

    def kept(inner: str) -> str:
        truth.update(b.text for b in blocks(f"<p>{inner}</p>"))
        return inner

    def paragraph() -> str:
        body = w.sentences(1, rng.choice((1, 3, 6, 12)))
        if rng.random() < 0.3:
            body = body.replace(" ", f' <a href="/x">{w.words(1, 2)}</a> ', 1)
        if rng.random() < 0.2:
            body = f"<{(t := rng.choice(('b', 'i', 'em', 'span')))}>{body}</{t}>"
        style = rng.random()
        if plain and rng.random() < 0.35:
            return f"<div>{kept(body)}</div>"
        if style < 0.12:
            return f"<p><b>{kept(body)}<br>"
        if style < 0.2:
            return f"<p>{kept(body)}"
        if style < 0.27:
            return f"<ul>{''.join(f'<li>{kept(w.sentences(1, 1))}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if style < 0.32:
            return f"<blockquote><p>{kept(body)}</p></blockquote>"
        if style < 0.36:
            return f"<table><tr><td>{kept(w.words(1, 4))}</td><td>{kept(w.words(1, 4))}</td></tr></table>"
        if style < 0.40:
            return f"<pre>{kept(w.words(5, 20))}</pre>"
        if style < 0.43:
            return f"<div>{kept(body)}</div>"
        if style < 0.46:
            return f"<figure><img src=x><figcaption>{kept(w.sentences(1, 1))}</figcaption></figure>"
        return f"<p>{kept(body)}</p>"

    def other(kinds: tuple[str, ...], inner: str) -> str:
        return w.tag(rng.choice(kinds), inner, plain)

    def small() -> str:
        kind = rng.randrange(5)
        if kind == 0:
            return other(ADS, w.sentences(1, 2) if rng.random() < 0.6 else f"<p>{w.sentences(1, 2)}</p>{w.links(0, 2)}")
        if kind == 1:
            return other(NOTICES, f"<p>{' '.join(rng.choices(NOTICE_WORDS, k=rng.randint(5, 20)))} {w.sentences(1, 2)}</p><button>{w.words(1, 2)}</button>")
        if kind == 2:
            return other(SHARES, w.links(1, 5))
        if kind == 3:
            return f'<form action="/s"><label>{w.words(1, 3)}</label><input name=q><p>{w.sentences(1, 1)}</p><select><option>{w.word()}</option><option>{w.word()}</option></select><button>{w.word()}</button></form>'
        return other(SIDES, f"<h3>{w.words(1, 4)}</h3>{w.links(2, 6)}" + (f"<p>{w.sentences(1, 2)}</p>" if rng.random() < 0.5 else ""))

    def comments() -> str:
        rows = "".join(f'<{(t := rng.choice(("li", "div")))} class="comment"><span>{w.word()} {rng.choice(COMMENT_WORDS)}</span><p>{w.sentences(1, 4)} {rng.choice(COMMENT_WORDS)}</p></{t}>' for _ in range(rng.randint(1, 6)))
        return other(COMMENTS, f"<h3>{rng.choice(COMMENT_WORDS)} {w.words(1, 2)}</h3>{rows}")

    def foot() -> str:
        if rng.random() < 0.4:
            said = f"{rng.choice(('Copyright', '&copy;', 'Copyright &copy;'))} {rng.randint(1996, 2025)} {w.words(1, 3)}" + (f" {w.common(FOOT_WORDS, 1, 8)}." if rng.random() < 0.6 else "")
            return said if rng.random() < 0.5 else f"<p>{said}</p>{w.links(0, 4)}"
        return rng.choice((f"&copy; {w.words(1, 3)} &middot; {w.sentences(1, 3)}", f"<p>&copy; {w.sentences(1, 2)}</p>", w.links(2, 5) + f"<p>{w.sentences(1, 2)}</p>"))

    title = w.sentences(1, 1)
    layout = rng.random()
    if layout < 0.08:
        return (old_page if layout < 0.05 else wiki_page)(w, title, kept, foot), truth
    parts = [paragraph() for _ in range(rng.choice((1, 2, 4, 8, 14)))]
    if rng.random() < 0.3:
        parts.insert(rng.randint(0, len(parts)), f"<h2>{kept(w.words(2, 6))}</h2>")
    if rng.random() < 0.25:
        parts.insert(rng.randint(0, len(parts)), small())
    heading = f"<h1>{kept(title)}</h1>"
    if rng.random() < 0.2:
        heading = f"<header>{heading}</header>"
    inside = comments() if rng.random() < 0.1 else ""
    article = w.tag(rng.choice(MAIN), heading + "".join(parts) + inside, plain)
    before = []
    if rng.random() < 0.4:
        before.append(other(HEADS, f"<p>{w.words(1, 5)}</p>" + (w.links(2, 6) if rng.random() < 0.5 else "")))
    if rng.random() < 0.8:
        before.append(other(MENUS, w.links(2, 9)))
    before += [small() for _ in range(rng.choice((0, 0, 1, 2)))]
    after = [small() for _ in range(rng.choice((0, 0, 1, 2)))]
    if rng.random() < 0.35:
        after.append(comments())
    if rng.random() < 0.8:
        after.append(other(FEET, foot()))
    if rng.random() < 0.15:
        body = "".join(before) + f"<div>{article}{''.join(after)}</div>"
    else:
        body = "".join([*before, article, *after])
    script = f"<script>var t=\"</p>\";{w.word()}();</script><style>p{{margin:0}}</style>"
    ending = "</body></html>" if rng.random() < 0.85 else ""
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title>{script}</head><body>{body}{ending}", truth


# --- the operator -----------------------------------------------------------


def label(pages: list[list[Block]], weights: dict, cells: int = 20_000) -> list[np.ndarray]:
    """The probability of each block to be main text; pages of like length go through the network together."""
    cache: dict = {}
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        longest = len(pages[order[-1]])
        part = [order.pop() for _ in range(min(len(order), max(1, cells // longest), 512))]
        prob = forward(*inputs_of([Page(pages[i], cache) for i in part], weights), weights)[0]
        for b, i in enumerate(part):
            out[i] = prob[: len(pages[i]), b]
    return out


def extract(pages: DataFrame, html: str = "html", rules: LabellerRules = LabellerRules()) -> DataFrame:
    """Pages with text, the main blocks joined by line breaks, and n_chars, its code points.

    Null or empty pages, and pages without main text, give an empty text. Blocks
    are whole: nothing is cut, and deep nesting costs no more than its markup.
    Repeated rows stay. Columns of the new names are replaced, others stay. The
    network is trained on the driver from generated pages and has a fixed size.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars")])
    model = pages.sparkSession.sparkContext.broadcast(trained(rules))
    where, names, threshold = pages.columns.index(html), pages.columns, rules.threshold

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(v.as_py()) for v in batch.column(where)]
            texts = ["\n".join(b.text for b, p in zip(page, prob, strict=True) if p >= threshold) for page, prob in zip(found, label(found, model.value), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(read, StructType(list(pages.schema.fields)).add("text", "string").add("n_chars", "long"))
