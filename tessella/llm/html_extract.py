"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A fast tokenizer turns a page into its leaf blocks in page order, each with the tags and class names of its ancestors. The
CRF labels each block as main text or not from ancestor-tag and text features and from the label before it; Viterbi gives the best
labelling. The model is trained on labelled pages: those that ``labelled_pages`` composes, of many layouts with and without
semantic tags, or the caller's own.

Defined results: a null or empty page has no blocks and gives an empty text; scripts, styles, templates, comments and the head are
never text; character references are decoded; white space inside a block becomes one space; repeated rows give equal texts; pages
are parsed whole, however long, and malformed markup never fails.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_RAW = {"script", "style", "template", "iframe", "title", "desc", "noembed", "noframes", "annotation", "annotation-xml", "xmp"}
#: Those whose content is never text, closed or not; any other that has no end tag is taken as an ordinary element.
_NEVER_TEXT = {"script", "style", "template"}
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.ASCII | re.IGNORECASE) for name in _RAW}
#: Elements that a head may hold; any other, and text, ends it where its end tag was omitted.
_IN_HEAD = {"title", "base", "basefont", "bgsound", "link", "meta", "style", "script", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements of formulas and drawings: their text stands in the line.
_INLINE |= set("math mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics svg g text tspan textpath path rect circle line".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_FAMILIES = {
    "menu": ("nav", "menu", "breadcrumb", "tabs", "toolbar", "pager", "pagination", "skip"),
    "side": ("sidebar", "aside", "related", "widget", "recommend", "trending", "popular", "share", "social", "tags", "toc", "rail"),
    "foot": ("footer", "foot", "copyright", "legal", "colophon", "contentinfo"),
    "head": ("header", "masthead", "topbar", "brand", "logo", "banner", "hero"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "dfp"),
    "notice": ("notice", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "alert", "popup", "modal", "overlay", "paywall", "warning", "disclaimer", "message"),
    "comment": ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "thread", "reader", "reviews"),
    "form": ("form", "search", "login", "signup", "input"),
    "main": ("content", "article", "post", "entry", "body", "story", "main", "text", "prose", "markdown"),
}
_FAMILY = {w: f for f, ws in _FAMILIES.items() for w in ws}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text of one leaf block with the features of its place."""

    text: str
    tag: str
    path: tuple[str, ...]
    linked: int


@lru_cache(maxsize=4096)
def _families(attributes: str) -> tuple[str, ...]:
    found = {f for m in _ATTRIBUTE.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "") if (f := _FAMILY.get(w.lower()))}
    return tuple(f"@{f}" for f in sorted(found))


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; none is empty."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = next((t for t, _ in reversed(stack) if t not in _INLINE), "body")
                path = tuple(dict.fromkeys(f for t, fs in stack for f in (t, *fs)))
                out.append(Block(text, block, path, linked))
            parts.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal links
        for t, _ in stack[to:]:
            links -= t == "a"
        del stack[to:]

    at, in_head = 0, False
    unclosed: set[str] = set()
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if in_head and not page[at : m.start()].isspace() and at < m.start():
            in_head = False
        put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        in_head = name == "head" and not m[1] or in_head and name in _IN_HEAD
        if m[1]:
            if name in _INLINE:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name or stack[k][0] not in _INLINE), -1)
                if k >= 0 and stack[k][0] == name:
                    links -= name == "a"
                    del stack[k]
                continue
            flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if k >= 0:
                pop(k)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "head":
            flush()
            continue
        if name in _RAW:
            if name in ("xmp", "iframe", "noframes"):
                flush()
            end = None if name in unclosed else _END[name].search(page, at)
            if end:
                if name == "xmp":  # shown as it stands
                    parts.append(page[at : end.start()])
                    flush()
                at = end.end()
                continue
            unclosed.add(name)
            if name in _NEVER_TEXT:
                at = len(page)
                break
        if name not in _INLINE:
            flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in _INLINE), -1)
            if k >= 0 and stack[k][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                pop(k)
            if name in _CLOSES:
                same, scope = _CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same and (name != "tr" or stack[k][0] == "tr"):
                        pop(k)
                        break
                    if stack[k][0] in scope:
                        break
        if name in _VOID:
            continue
        stack.append((name, _families(m[3]) if m[3] else ()))
        links += name == "a"
    put(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of the active features of each block."""
    n = len(blocks)
    out = []
    seen_heading = False
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.linked / len(b.text)
        fs = ["bias", f"tag={b.tag}", *[f"in={p}" for p in b.path if p not in _INLINE]]
        inner = [p for p in b.path if p in ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table", "ul", "ol", "blockquote", "figure", "button", "label", "fieldset", "select", "dialog", "menu")]
        fs.append("inner=" + (inner[-1] if inner else "none"))
        families = [p for p in b.path if p[0] == "@"]
        fs.append("nearest=" + (families[-1] if families else "none"))
        fs.append("words=" + ("1" if words == 1 else "3" if words <= 3 else "8" if words <= 8 else "20" if words <= 20 else "50" if words <= 50 else "more"))
        fs.append("links=" + ("none" if density == 0 else "few" if density < 0.3 else "many" if density < 0.8 else "all"))
        fs.append("stop" if b.text[-1] in ".!?…:;»”\"" else "nostop")
        if "©" in b.text or "·" in b.text or "|" in b.text:
            fs.append("marks")
        if b.tag in ("h1", "h2", "h3"):
            fs.append("first_heading" if not seen_heading else "later_heading")
            seen_heading = True
        fs.append("before_heading" if not seen_heading else "after_heading")
        if i == 0:
            fs.append("first")
        if i == n - 1:
            fs.append("last")
        out.append(fs)
    return out


@dataclass
class Crf:
    """Weights of each feature for the labels (0 other, 1 main text), of transitions, and of the first and last label."""

    feature: dict[str, tuple[float, float]]
    transition: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi: the most probable labels; ties go to other."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.transition
        get, none = self.feature.get, (0.0, 0.0)
        back, s0, s1 = [], 0.0, 0.0
        for i, fs in enumerate(page):
            e0 = e1 = 0.0
            for f in fs:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i:
                a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
                back.append((int(b > a), int(d > c)))
                s0, s1 = (b if b > a else a) + e0, (d if d > c else c) + e1
            else:
                s0, s1 = e0, e1
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by forward-backward and Adam over labelled pages (features and labels of blocks)."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for b in fs for f in b}))}
    if not pages:
        return Crf({}, ((0.0, 0.0), (0.0, 0.0)))
    longest, n = max(len(ls) for _, ls in pages), len(pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (fs, ls) in enumerate(pages):
        for j, (b, label) in enumerate(zip(fs, ls)):
            x[i, j, [names[f] for f in b]] = 1
            y[i, j], mask[i, j] = label, True
    flat = x[mask]
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    hot = np.eye(2)[y] * mask[:, :, None]
    pairs = np.einsum("nia,nib->ab", hot[:, :-1], hot[:, 1:])
    total = mask.sum()
    for step in range(1, epochs + 1):
        e = np.zeros((n, longest, 2))
        e[mask] = flat @ w.astype(np.float32)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for j in range(1, longest):
            forward[:, j] = np.where(mask[:, j, None], np.logaddexp.reduce(forward[:, j - 1, :, None] + t, axis=1) + e[:, j], forward[:, j - 1])
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        for j in range(longest - 2, -1, -1):
            backward[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(t + (e[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2), 0)
        one = np.exp(forward + backward - z[:, None, None]) * mask[:, :, None]
        two = forward[:, :-1, :, None] + t + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        two = (np.exp(two) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        gw = flat.T @ (one - hot)[mask].astype(np.float32) / total + decay * w
        gt = (two - pairs) / total + decay * t
        for k, (value, g) in enumerate(((w, gw), (t, gt))):
            m, s = moments[2 * k], moments[2 * k + 1]
            m[:] = 0.9 * m + 0.1 * g
            s[:] = 0.999 * s + 0.001 * g * g
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Crf({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, tuple(map(tuple, t.tolist())))


def labelled_pages(pages: int = 350, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Composed pages of many layouts, each with the texts of its main blocks in order."""
    rng = random.Random(seed)
    syllables = [c + v for c in "b c d f g h l m n p r s t v st tr ch".split() for v in "a e i o u é ö ou".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3, 4))))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(2, 18).capitalize() + "."
    sentences = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    chance = lambda p: rng.random() < p
    wrap = lambda tag, cls, body: f'<{tag}{f" class={chr(34)}{rng.choice(cls)}{chr(34)}" if cls else ""}>{body}</{tag}>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" if chance(0.8) else f"<li>{link()}" for _ in range(rng.randint(2, 9)))
        return f"<nav><ul>{items}</ul></nav>" if chance(0.6) else wrap("div", ["nav", "menu", "main-menu", "breadcrumb", "top-nav"], f"<ul>{items}</ul>" if chance(0.6) else " | ".join(link() for _ in range(4)))

    def head() -> str:
        inside = rng.choice((f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f'<a href="/">{words(1, 2)}</a><span>{words(2, 5)}</span>', f'<div class="logo">{words(1, 3)}</div>'))
        return f"<header>{inside}</header>" if chance(0.7) else wrap("div", ["header", "site-header", "masthead", "topbar"], inside)

    def foot() -> str:
        inside = rng.choice((f"&copy; {word()}.example.net &middot; {sentences(1, 3)}", f"<p>&copy; {words(1, 4)}</p><p>{link()} {link()}</p>", f"<ul><li>{link()}<li>{link()}</ul>{sentence()}", sentences(1, 2)))
        return f"<footer>{inside}</footer>" if chance(0.75) else wrap("div", ["footer", "site-footer", "copyright", "legal"], inside)

    def advert() -> str:
        return wrap(rng.choice(("div", "div", "section", "aside", "p")), ["ad", "ads", "advert", "sponsored", "promo box", "ad-slot"], rng.choice((sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f"{sentence()} {link()}")))

    def side() -> str:
        inside = rng.choice((f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<h2>{words(1, 3)}</h2><p>{sentences(1, 3)}</p>", f"<p>{sentences(1, 4)}</p>"))
        return f"<aside>{inside}</aside>" if chance(0.6) else wrap("div", ["sidebar", "related", "widget", "social share", "trending"], inside)

    def notice() -> str:
        return wrap(rng.choice(("div", "section", "p", "div")), ["notice", "cookie-banner", "newsletter", "consent", "alert alert-info", "subscribe-box", "popup", "paywall"], rng.choice((sentences(1, 3), f"<p>{sentences(1, 2)}</p><button>{words(1, 2)}</button>")))

    def form() -> str:
        parts = [f"<label>{words(1, 3)}</label><input name=q>", f"<p>{sentence()}</p><input>", f"<select><option>{word()}<option>{word()}</select>", f"<p>{sentences(1, 2)}</p><textarea>{words(0, 3)}</textarea>"]
        return f'<form action="/{word()}">{"".join(rng.sample(parts, rng.randint(1, 3)))}<button>{words(1, 2)}</button></form>'

    def comments() -> str:
        each = lambda: rng.choice((f'<div class="comment"><b>{word()}</b><p>{sentences(1, 4)}</p></div>', f"<li><p>{sentences(1, 5)}</p></li>", f'<article class="comment"><h4>{word()}</h4><p>{sentences(1, 3)}</p></article>', f"<p>{sentences(1, 4)}</p>"))
        return wrap(rng.choice(("section", "div", "ol")), ["comments", "comment-list", "reader-comments", "discussion", "replies"], (f"<h3>{words(1, 2)}</h3>" if chance(0.6) else "") + "".join(each() for _ in range(rng.randint(1, 5))))

    def fallback() -> str:
        return rng.choice((f"<video controls src=v><p>{sentence()}</p></video>", f"<audio controls>{sentence()}</audio>", f"<canvas>{words(1, 6)}</canvas>", f"<div class=video><video>{sentence()} {link()}</video></div>"))

    def junk() -> str:
        return rng.choice((menu, advert, side, notice, form, form, comments, fallback))()

    out = []
    for _ in range(pages):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(" ".join(text.split()))
            return text.replace("&", "&amp;")

        title = words(2, 9).capitalize()
        body = []
        if chance(0.85):
            h1 = f"<h1>{keep(title)}</h1>"
            body.append(f"<header>{h1}</header>" if chance(0.2) else wrap("header", ["entry-header", "post-header", "article-header"], h1) if chance(0.1) else h1)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                text = sentences(1, 7) if chance(0.9) else words(1, 4).capitalize()
                bold = chance(0.2)
                body.append(f"<p>{'<b>' if bold else ''}{keep(text)}{rng.choice(('</p>', '</p>', '</b></p>' if bold else '</p>', '', '<br>'))}")
            elif kind < 0.69:
                body.append(f"<h2>{keep(words(1, 7).capitalize())}</h2>")
            elif kind < 0.76:
                body.append("<ul>" + "".join(f"<li>{keep(sentence() if chance(0.6) else words(1, 6))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.81:
                body.append(f"<blockquote>{keep(sentences(1, 3))}</blockquote>")
            elif kind < 0.85:
                body.append("<table>" + "".join(f"<tr><td>{keep(words(1, 4))}<td>{keep(words(1, 4))}" for _ in range(rng.randint(1, 3))) + "</table>")
            elif kind < 0.86:
                body.append(f"<noscript><p>{keep(sentences(1, 4))}</p></noscript>")
            elif kind < 0.89:
                a, b = sentence(), sentence()
                main.append(" ".join(f"{a} {b}".split()))
                body.append(f'<div>{a} <a href="/{word()}">{b}</a></div>')
            else:
                body.append(junk())
        if chance(0.3):
            body.append(comments())
        inside = "".join(body)
        shell = rng.choice(("article", "article", "article", "main", "content", "both", "bare"))
        if shell in ("article", "main"):
            inside = f"<{shell}>{inside}</{shell}>"
        elif shell == "content":
            inside = wrap("div", ["content", "post-body", "entry", "article-text", "story"], inside)
        elif shell == "both":
            inside = f"<main><article>{inside}</article></main>"
        before = [f for f, p in ((head, 0.4), (menu, 0.8), (notice, 0.25), (advert, 0.5), (form, 0.15), (side, 0.15)) if chance(p)]
        after = [f for f, p in ((advert, 0.25), (comments, 0.25), (side, 0.35), (form, 0.2), (notice, 0.2), (foot, 0.85)) if chance(p)]
        if chance(0.1):
            before.append(lambda: f"<noscript>{sentence()}</noscript>")
        if chance(0.1):
            before, after = [], []
        rng.shuffle(before)
        page = "".join(f() for f in before) + inside + "".join(f() for f in after)
        out.append((f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{page}' + ("</body></html>" if chance(0.8) else ""), main))
    return out


def block_labels(page: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features of a page's blocks and which of them are the main texts given, matched in order."""
    blocks = leaf_blocks(page)
    labels, k = [], 0
    for b in blocks:
        hit = k < len(main) and b.text == main[k]
        labels.append(int(hit))
        k += hit
    return features(blocks), labels


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train([block_labels(page, main) for page, main in labelled_pages()])


def extract(page: str | None, model: Crf) -> str:
    """The main text of one page: its blocks in order, joined by one space."""
    blocks = leaf_blocks(page)
    return " ".join([b.text for b, keep in zip(blocks, model.decode(features(blocks))) if keep])


def main_text(page: Column, model: Crf | None = None) -> Column:
    """The main text of each whole page."""
    model = model or default_model()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p.as_py(), model) for p in batch], pa.string())

    return texts(page)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """Rows (page_id, url, text) of all pages."""
    return pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), main_text(col(html_col).cast("string"), model).alias("text"))  # null ids and URLs stay null
