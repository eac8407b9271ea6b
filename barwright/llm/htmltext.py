"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags,
each with its chain of ancestors. Each block has binary features of its
ancestors (tags, words of class and id), its tag, its text and its place. The
field scores each block's label (main or not) and each pair of neighbouring
labels; its weights maximise the conditional likelihood of labelled pages, with
a quadratic penalty, and Viterbi finds a page's best labels.

training_pages() makes the labelled pages, a bounded number of them from a
seed; train() takes any (html, texts of main blocks). Pages are decoded where
they are read; the model, some thousand weights, travels with the task.

Blocks share what their ancestors have: a tag that adds nothing new to the
features of its parent holds a reference, and open tags are found by name, so
time and memory grow with the page whatever its nesting.

Defined results: null and empty html give an empty text; an unclosed comment,
script, style, noscript, template, iframe, textarea or title runs to the end of
the page; closing tags without an opening one are skipped; repeated rows are
alike; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: No part can run over another tag's start outside quotes, and none gives back what it took, so time grows with the page only.
TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:\"[^\"]*+\"|'[^']*+'|[^><\"'])*+|[^><]*+)>|<[!?][^><]*+>", re.S)
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements without text of the page, and elements that never close.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "button", "canvas", "math"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: An opening tag of the key ends open elements of these names.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "div", "nav", "aside", "header", "footer", "form"}


class Block:
    __slots__ = ("text", "above", "linked", "tag")

    def __init__(self, text: str, above: frozenset[str], tag: str, linked: int):
        self.text, self.above, self.tag, self.linked = text, above, tag, linked


class Path:
    """The open elements: names, features of all ancestors, and where the open ones of a name and those that are not inline are."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.above: list[frozenset[str]] = [frozenset()]
        self.at: dict[str, list[int]] = {}
        self.outer: list[int] = []
        self.silent = 0

    def enter(self, tag: str, names: Iterable[str]) -> None:
        new = {f"name={n}" for n in names} | ({f"in={tag}"} if tag not in UNTOLD else set())
        last = self.above[-1]
        self.above.append(last if new <= last else last | new)
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.outer.append(len(self.tags))
        self.tags.append(tag)
        self.silent += tag in SILENT

    def leave(self, upto: int) -> None:
        while len(self.tags) > upto:
            tag = self.tags.pop()
            self.above.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.outer.pop()
            self.silent -= tag in SILENT

    def last(self, tag: str) -> int | None:
        found = self.at.get(tag)
        return found[-1] if found else None

    def close(self, tag: str) -> None:
        """An inline element closes only if all that is open inside it is inline."""
        k = self.last(tag)
        if k is not None and (tag not in INLINE or not self.outer or k > self.outer[-1]):
            self.leave(k)

    def tag(self) -> str:
        return self.tags[self.outer[-1]] if self.outer else ""


#: Tags that most pages have around everything.
UNTOLD = {"html", "body", "div", "span"}


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, texts with their references decoded and white space made one space."""
    out: list[Block] = []
    path = Path()
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                out.append(Block(text, path.above[-1], path.tag(), linked))
            held.clear()
            linked = 0

    page, at = page or "", 0
    while True:
        m = TOKEN.search(page, at)
        if not path.silent and (chunk := page[at : m.start() if m else len(page)]):
            held.append(chunk := entities.unescape(chunk))
            if path.last("a") is not None:
                linked += len(chunk.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag != "br" and tag != "wbr":
            flush()
        if tag == "br" and not path.silent:
            held.append(" ")
        if m[1]:
            path.close(tag)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if (tag in ENDS or tag not in INLINE) and path.tag() in ENDS.get(tag, {"p"}):
            path.leave(path.outer[-1])
        if tag == "body" and (head := path.last("head")) is not None:
            path.leave(head)
        path.enter(tag, (w for a in ATTRIBUTE.finditer(m[3]) for w in re.split(r"[^a-z]+", (a[2] or a[3] or a[4] or "").lower()) if w))
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\s*>").search(page, at)
            at = end.end() if end else len(page)
            path.leave(len(path.tags) - 1)
    flush()
    return out


#: Words of notices, navigation and the like, in the languages of the pages (fixed values).
SIGNS = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|sign in|log ?in|privacy|terms|copyright|rights reserved|share|advertisement|sponsored|comments?|reply|read more|related|menu|search|impressum|datenschutz|anmelden|connexion|mentions|suscríbete|aviso)\b|©")


def observed(block: Block, k: int, n: int) -> list[str]:
    words = len(block.text.split())
    out = {f"tag={block.tag}", f"words={min(words.bit_length(), 8)}", f"links={(4 * block.linked) // max(1, len(block.text))}", f"end={block.text[-1] in '.!?…:;»”'}", f"stop={min(2, sum(block.text.count(c) for c in '.!?'))}", "all"}
    out |= block.above
    if SIGNS.search(block.text):
        out.add(f"sign={min(words.bit_length(), 6)}")
    if k == 0:
        out.add("first")
    if k == n - 1:
        out.add("last")
    return sorted(out)


class Field:
    """emission: weight of each feature for "main"; step: score of (before, after); ends: first and last label."""

    def __init__(self, index: dict[str, int], emission: np.ndarray, step: np.ndarray, ends: np.ndarray):
        self.weight = {f: float(emission[i]) for f, i in index.items()}
        self.step, self.ends = step.tolist(), ends.tolist()

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi."""
        if not page:
            return []
        get, n, step = self.weight.get, len(page), self.step
        best, back = None, []
        for k, block in enumerate(page):
            main = sum(get(f, 0.0) for f in observed(block, k, n))
            if best is None:
                best = [self.ends[0][0], self.ends[0][1] + main]
                continue
            before = [0 if best[0] + step[0][y] >= best[1] + step[1][y] else 1 for y in (0, 1)]
            best = [best[before[y]] + step[before[y]][y] + main * y for y in (0, 1)]
            back.append(before)
        y = int(best[1] + self.ends[1][1] > best[0] + self.ends[1][0])
        out = [y]
        for before in reversed(back):
            out.append(y := before[y])
        return [bool(y) for y in reversed(out)]


class Likelihood:
    """The log likelihood of labelled pages, as a function of the weights: those of the features, then step, then ends."""

    def __init__(self, pages: Iterable[tuple[str, set[str]]]):
        self.index: dict[str, int] = {}
        rows, cols, labels, where = [], [], [], []
        for p, (page, main) in enumerate(pages):
            found = blocks(page)
            for k, block in enumerate(found):
                for f in observed(block, k, len(found)):
                    rows.append(len(labels))
                    cols.append(self.index.setdefault(f, len(self.index)))
                labels.append(block.text in main)
                where.append((p, k))
        self.rows, self.cols, self.n = np.array(rows), np.array(cols), len(labels)
        self.page, self.pos = np.array(where).T
        n_pages, longest = self.page.max() + 1, self.pos.max() + 1
        self.mask = np.zeros((n_pages, longest), bool)
        self.mask[self.page, self.pos] = True
        truth = np.zeros((n_pages, longest), int)
        truth[self.page, self.pos] = labels
        self.size, self.every, f = self.mask.sum(axis=1), np.arange(n_pages), len(self.index)
        self.pairs = self.mask[:, 1:]
        self.seen = np.zeros(f + 8)
        self.seen[:f] = np.bincount(self.cols, np.array(labels, float)[self.rows], f)
        np.add.at(self.seen, f + 2 * truth[:, :-1][self.pairs] + truth[:, 1:][self.pairs], 1)
        np.add.at(self.seen, f + 4 + truth[:, 0], 1)
        np.add.at(self.seen, f + 6 + truth[self.every, self.size - 1], 1)

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = len(self.index)
        return theta[:f], theta[f : f + 4].reshape(2, 2), theta[f + 4 :].reshape(2, 2)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and slope: counts seen less counts expected, by the forward and backward sums."""
        emission, step, ends = self.parts(theta)
        mask, size, page, pos = self.mask, self.size, self.page, self.pos
        score = np.zeros((*mask.shape, 2))
        score[page, pos, 1] = np.bincount(self.rows, emission[self.cols], self.n)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + ends[0]
        for k in range(1, mask.shape[1]):
            forward[:, k] = np.logaddexp(forward[:, k - 1, :1] + step[0], forward[:, k - 1, 1:] + step[1]) + score[:, k]
        backward[self.every, size - 1] = ends[1]
        for k in range(mask.shape[1] - 2, -1, -1):
            go = backward[:, k + 1] + score[:, k + 1]
            value = np.logaddexp(step[:, 0] + go[:, :1], step[:, 1] + go[:, 1:])
            backward[:, k] = np.where((k < size - 1)[:, None], value, backward[:, k])
        whole = np.logaddexp(*(forward + backward)[:, 0].T)
        node = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
        edge = forward[:, :-1, :, None] + step + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
        edge = np.exp(np.where(self.pairs[:, :, None, None], edge, -np.inf))
        expected = np.concatenate([np.bincount(self.cols, node[page, pos, 1][self.rows], len(emission)), edge.sum(axis=(0, 1)).ravel(), node[:, 0].sum(axis=0), node[self.every, size - 1].sum(axis=0)])
        return float(theta @ self.seen - whole.sum()), self.seen - expected


def train(pages: Iterable[tuple[str, set[str]]], *, rounds: int = 150, penalty: float = 0.3, rate: float = 0.1) -> Field:
    """The field of greatest penalised likelihood; pages are (html, texts of the main blocks)."""
    likelihood = Likelihood(pages)
    theta = np.zeros(len(likelihood.seen))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        slope = likelihood(theta)[1] - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field(likelihood.index, *likelihood.parts(theta))


#: Class and id words of containers in the labelled pages (fixed values).
MAIN_NAMES = ("content", "post", "entry", "entry-content", "article-body", "story", "main", "text", "page", "body-text")
AD_NAMES = ("ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement", "adsbox")
NOTICE_NAMES = ("cookie", "cookie-notice", "consent", "notice", "popup", "alert", "gdpr", "newsletter", "modal")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "recommended", "trending", "rail")
COMMENT_NAMES = ("comments", "comment", "comment-list", "discussion", "replies", "disqus", "responses")
NAV_NAMES = ("nav", "menu", "navbar", "breadcrumb", "topnav", "links", "pagination", "toc", "share", "social")
FOOT_NAMES = ("footer", "foot", "site-footer", "copyright", "bottom")
HEAD_NAMES = ("header", "masthead", "site-header", "topbar", "logo", "branding")


def training_pages(n: int = 240, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """Labelled pages of many layouts, from a seed."""
    rng = random.Random(seed)
    pick = rng.choice
    letters = "aeiourstnlmdéüñ"

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 1, hi: int = 40) -> str:
        return words(lo, hi).capitalize() + pick([".", ".", ".", "?", "!", "", " ***", "###"])

    def prose() -> str:
        return " ".join(sentence() for _ in range(pick([1, 1, 2, 4, 8])))

    def links(tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{words(1, 1)}'>{words(1, 3)}</a></{tag}>" for _ in range(rng.randint(1, 8)))

    def box(tags: tuple[str, ...], names: tuple[str, ...], inner: str, named: float = 0.8) -> str:
        tag = pick(tags)
        mark = f' {pick(["class", "class", "id"])}="{pick(names)}"' if tag in ("div", "section", "ul", "p") or rng.random() < 1 - named else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    def junk(kind: str) -> str:
        if kind == "nav":
            return box(("nav", "nav", "ul", "div"), NAV_NAMES, pick([f"<ul>{links()}</ul>", links("span"), links("p")]))
        if kind == "head":
            return box(("header", "header", "div"), HEAD_NAMES, f"<h1>{words(1, 4)}</h1><p>{sentence(2, 9)}</p>" if rng.random() < 0.6 else f"<div>{words(1, 5)}</div>{junk('nav')}")
        if kind == "foot":
            return box(("footer", "footer", "div"), FOOT_NAMES, f"<p>&copy; {words(1, 4)} &middot; {sentence(2, 9)}</p>" if rng.random() < 0.5 else f"&copy; {words(1, 3)}. {sentence(1, 12)}")
        if kind == "ad":
            return f"<!-- ad {rng.randint(0, 9)} -->" + box(("div", "div", "aside"), AD_NAMES, pick([prose(), f"<p>{prose()}</p>", f"<a href='x'>{sentence(2, 12)}</a>"]))
        if kind == "notice":
            return box(("div", "section", "div"), NOTICE_NAMES, f"<p>{pick(['', 'We use cookies. ', 'Subscribe: '])}{prose()}</p><button>{words(1, 2)}</button>")
        if kind == "side":
            return box(("aside", "aside", "div"), SIDE_NAMES, f"<h3>{words(1, 4)}</h3>" + pick([f"<ul>{links()}</ul>", f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>"]))
        if kind == "form":
            return f"<form action='/{words(1, 1)}'><label>{words(1, 4)}</label><input name='q'><p>{sentence(2, 10)}</p><select><option>{words(1, 2)}</option></select><button>{words(1, 2)}</button></form>"
        each = lambda: pick(["<div class='comment'><p>{}</p></div>", "<li class='comment'><b>{}</b></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"]).format(prose())
        return box(("section", "div", "div"), COMMENT_NAMES, f"<h3>{words(1, 3)}</h3>" * rng.randint(0, 1) + "".join(each() for _ in range(rng.randint(1, 5))))

    kinds = ("nav", "ad", "notice", "side", "form", "comments")
    for _ in range(n):
        main: set[str] = set()

        def own(text: str, main: set[str] = main) -> str:
            main.add(" ".join(text.split()))
            return entities.escape(text, quote=False)

        inner = [f"<h1>{own(sentence(1, 12))}</h1>"] if rng.random() < 0.8 else []
        for _ in range(pick([0, 1, 2, 4, 8, 14])):
            r = rng.random()
            text = own(prose())
            if r < 0.6:
                inner.append(pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p class='lead'>{}</p>", "<p><b>{}<br>"]).format(text))
            elif r < 0.7:
                inner.append(f"<h2>{text}</h2>")
            elif r < 0.8:
                inner.append(f"<ul><li>{text}</li><li>{own(sentence(1, 9))}</li></ul>")
            elif r < 0.86:
                inner.append(f"<blockquote><p>{text}</p></blockquote>")
            elif r < 0.9:
                inner.append(f"<table><tr><td>{text}</td><td>{own(words(1, 2))}</td></tr></table>")
            elif r < 0.94:
                inner.append(f"<pre>{text}</pre>")
            else:
                inner.append(f"<div>{text}</div>")
            if rng.random() < 0.07:
                inner.append(junk(pick(("ad", "side", "notice", "form"))))
        if rng.random() < 0.15:
            inner.append(junk("comments"))
        body = "".join(inner)
        style = rng.random()
        if style < 0.45:
            body = f"<article>{body}</article>"
        elif style < 0.6:
            body = f"<main>{body}</main>"
        elif style < 0.9:
            body = f'<div {pick(["class", "id"])}="{pick(MAIN_NAMES)}">{body}</div>'
        if rng.random() < 0.25:
            body = f'<div class="{pick(("wrapper", "container", "row", "layout"))}">{body}{junk("side") * rng.randint(0, 1)}</div>'
        before = [junk(pick(("nav", "head", *kinds[:5]))) for _ in range(rng.randint(0, 4))]
        after = [junk(pick(kinds)) for _ in range(rng.randint(0, 3))] + [junk("foot")] * (rng.random() < 0.8)
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>x('</p>')</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", main


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, field.decode(found), strict=True) if keep)


def _extracted(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(h.as_py(), field) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, field: Field, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(functools.partial(_extracted, field=field), f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
