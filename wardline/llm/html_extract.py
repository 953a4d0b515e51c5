"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A block is the text between two block-level borders. Its features are the tags, classes and ids of its ancestors and a few traits of its
text; the two labels are main text and everything else. The field is trained on labelled pages (by default those of ``labelled_pages``, a
seeded generator of many layouts) by maximum likelihood with forward-backward sums, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|textarea)(?=[\s/>]|\Z)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements left out with all they hold, from a start tag to its own end tag; without one the tag alone is left out.
UNSHOWN = frozenset("template svg select object".split())
#: Attributes that end in the slash of an unquoted value, which closes nothing.
SLASH_VALUE = re.compile(r"=\s*[^\s\"'>]+/\Z")
ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements of the first kind end where one of the second starts.
ENDS_AT = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: Parts of class names and ids that tell a region; each is a feature whose weight is learned.
HINTS = "ad ads advert sponsor promo banner nav menu breadcrumb head foot side widget related share social comment reply respond discuss cookie consent notice alert popup modal newsletter subscribe signup form search login copyright legal tag meta byline author date caption pager pagination article content post entry story body main text".split()


class Place:
    """An open element: its tag, and what it and the elements around it say. That is shared with the element around it where it is the
    same, so pages with very many nested elements take no more."""

    __slots__ = ("tag", "within")

    def __init__(self, around: Place | None, tag: str, names: str):
        base, own = around.within if around else frozenset(), _says(names)
        self.tag, self.within = tag, base if own <= base else base | own


@dataclass
class Block:
    text: str
    place: Place | None
    linked: int


def _names(tag: str, attrs: str) -> str:
    """tag, then its class, id and role words, joined by dots."""
    words = [tag]
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            words += ["hidden"] if m[1].lower() == "hidden" else NAME.findall((m[2] or "").lower())
    return ".".join(words)


def _unshown(tokens: list[re.Match]) -> dict[int, int]:
    """Tokens that are start tags of UNSHOWN elements, with the token of their end tag (their own, if they have none)."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        tag = m["tag"]
        if not tag or tag.lower() not in UNSHOWN:
            continue
        tag = tag.lower()
        if not m["close"]:
            found[i] = i
            if tag != "svg" or not m["attrs"].endswith("/") or SLASH_VALUE.search(m["attrs"]):
                opened.setdefault(tag, []).append(i)
        elif opened.get(tag):
            found[opened[tag].pop()] = i
    return found


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, character references decoded, white space single; scripts, styles and markup are not text."""
    page = page or ""
    out: list[Block] = []
    stack: list[Place] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, links = 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    at = past = 0
    tokens = list(TOKEN.finditer(page))
    unshown = _unshown(tokens)
    for i, m in enumerate(tokens):
        if i < past:
            continue
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"] and m["raw"].lower() not in ("script", "style", "noscript"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in UNSHOWN:
            last = unshown.get(i, i)
            past, at = last + 1, tokens[last].end()
            if tag in ("select", "object"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if m["close"] else 1))
            continue
        end()
        if m["close"]:
            while opened[tag]:
                last = stack.pop().tag
                opened[last] -= 1
                if last == tag:
                    break
            links = 0
        elif tag not in VOID and not m["attrs"].endswith("/"):
            while stack and stack[-1].tag in ENDS_AT and (ENDS_AT[stack[-1].tag] is None or tag in ENDS_AT[stack[-1].tag]):
                opened[stack.pop().tag] -= 1
            stack.append(Place(stack[-1] if stack else None, tag, _names(tag, m["attrs"])))
            opened[tag] += 1
            links = 0
    say(page[at:])
    end()
    return out


@lru_cache(maxsize=50_000)
def _says(names: str) -> frozenset[str]:
    """Features of an element from its tag and its class, id and role words."""
    tag, *words = names.split(".")
    return frozenset({f"in {tag}"} | {f"word {w}" for w in words} | {f"hint {h}" for w in words for h in HINTS if (w == h if len(h) < 4 else h in w)})


_PLACES: dict[tuple[frozenset[str], str], tuple[str, ...]] = {}


def place_features(place: Place | None) -> tuple[str, ...]:
    if place is None:
        return ()
    key = place.within, place.tag
    if key not in _PLACES:
        if len(_PLACES) > 50_000:
            _PLACES.clear()
        _PLACES[key] = tuple(sorted(place.within | {f"at {place.tag}"}))
    return _PLACES[key]


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    share = 4 * b.linked // max(1, n)
    found = ["bias", f"words {min(7, words.bit_length())}", f"linked {min(4, share)}"]
    if b.text[-1] in ".!?…\"”»":
        found.append("ends a sentence")
    if "©" in b.text[:40] or b.text[:9].lower() == "copyright":
        found.append("copyright")
    return found


@dataclass
class Field:
    """weights: two numbers for each feature (else, main); step[a, b]: from label a to b; first: the first label's."""

    weights: dict[str, np.ndarray]
    step: np.ndarray
    first: np.ndarray

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        w = self.weights
        out = []
        for b in page:
            key = (b.place and (b.place.within, b.place.tag), *text_features(b))
            got = self._memo.get(key)
            if got is None:
                if len(self._memo) > 100_000:
                    self._memo.clear()
                known = [w[f] for f in (*place_features(b.place), *key[1:]) if f in w]
                got = self._memo[key] = (float(sum(k[0] for k in known)), float(sum(k[1] for k in known)))
            out.append(got)
        return out

    def __post_init__(self) -> None:
        self._memo: dict[tuple, tuple[float, float]] = {}

    def viterbi(self, page: list[Block]) -> list[bool]:
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        back: list[tuple[bool, bool]] = []
        a, b = self.first.tolist()
        for i, (x, y) in enumerate(self.scores(page)):
            if i:
                from_a, from_b = a + s01 > b + s11, b + s10 > a + s00
                back.append((from_b, not from_a))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
            a, b = a + x, b + y
        label = b > a
        out = [label]
        for row in reversed(back):
            label = row[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = 250, l2: float = 0.002) -> Field:
    """Maximum likelihood with forward-backward sums over all pages at once; Adam; features of two pages at least."""
    seen: dict[str, set[int]] = {}
    rows = [[(*place_features(b.place), *text_features(b)) for b in page] for page, _ in pages]
    for i, page in enumerate(rows):
        for f in {f for r in page for f in r}:
            seen.setdefault(f, set()).add(i)
    names = {f: i for i, f in enumerate(sorted(f for f, where in seen.items() if len(where) > 1))}
    longest, n = max(len(p) for p in rows), len(pages)
    x, mask, y = np.zeros((n, longest, len(names)), np.float32), np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    for i, (page, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        mask[i, : len(page)], y[i, : len(page)] = True, labels
        for t, r in enumerate(page):
            x[i, t, [names[f] for f in r if f in names]] = 1
    x = x[mask]
    params = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    gold = np.eye(2)[y] * mask[..., None]
    for step in range(steps):
        u = np.zeros((n, longest, 2))
        u[mask] = x @ params[0].astype(np.float32)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = params[2] + u[:, 0]
        for t in range(1, longest):
            on = np.logaddexp.reduce(ahead[:, t - 1, :, None] + params[1], 1) + u[:, t]
            ahead[:, t] = np.where(mask[:, t, None], on, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            on = np.logaddexp.reduce(params[1] + (u[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], on, behind[:, t + 1])
        total = np.logaddexp.reduce(ahead[:, -1], 1)
        p = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        d_step = np.zeros((2, 2))
        for t in range(1, longest):
            q = np.exp(ahead[:, t - 1, :, None] + params[1] + (u[:, t] + behind[:, t])[:, None, :] - total[:, None, None]) * mask[:, t, None, None]
            d_step += q.sum(0) - np.einsum("na,nb->ab", gold[:, t - 1], gold[:, t])
        grads = [x.T @ (p - gold)[mask].astype(np.float32) / n + l2 * params[0], d_step / n, (p[:, 0] - gold[:, 0]).sum(0) / n]
        for w, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Field({f: params[0][i] for f, i in names.items()}, params[1], params[2])


def labelled_pages(n: int = 700, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages of many layouts with the texts of their main blocks. Words are drawn at random, so only structure and shape can be learned."""
    r = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu tion er an ich eau que os".split()

    def words(a: int, b: int, stop: str = ".") -> str:
        if r.random() < 0.25:  # noise of any kind: no block's label hangs on its characters
            stop = r.choice(["", "!", " |", "...", "***", ":", " 1", " ;)"])
        if r.random() < 0.1:
            b = a
        return (r.choice([" ", " ", " ", " | ", "### "]).join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(a, b))).capitalize()) + stop

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 2, "")}</a></li>' for i in range(k))

    def other() -> str:
        """A region that is not main text."""
        text, para = words(2, 30), f"<p>{words(4, 40)}</p>"
        kind = r.choice("nav header footer aside ad cookie form comments related share menu side notice crumbs login pager tags sponsor newsletter footer2 author".split())
        return {
            "nav": f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>",
            "menu": f'<div class="{r.choice(["menu", "navbar", "topmenu", "main-menu", "site-nav"])}"><ul>{links(r.randint(2, 7))}</ul></div>',
            "header": f'<header class="{r.choice(["", "site-header", "masthead", "top"])}"><h1>{words(1, 4, "")}</h1><p>{words(2, 9)}</p></header>',
            "footer": f"<footer>{r.choice(['', '&copy; '])}{text}{r.choice(['', para])}</footer>",
            "footer2": f'<div {r.choice(["id", "class"])}="{r.choice(["footer", "site-footer", "legal", "copyright", "colophon"])}"><p>&copy; {text}</p></div>',
            "aside": f"<aside><h3>{words(1, 3, '')}</h3>{para}<ul>{links(3)}</ul></aside>",
            "side": f'<div {r.choice(["id", "class"])}="{r.choice(["sidebar", "side", "widget", "right-column sidebar", "widget-area"])}"><h3>{words(1, 3, "")}</h3>{para}</div>',
            "ad": f'<div {r.choice(["id", "class"])}="{r.choice(["ad", "ads", "advert", "advertisement", "ad-box", "ad banner", "promo"])}">{r.choice([text, para])}</div>',
            "sponsor": f'<section class="{r.choice(["sponsored", "sponsor", "promotion", "promoted"])}"><h4>{words(1, 4, "")}</h4>{para}</section>',
            "cookie": f'<div {r.choice(["id", "class"])}="{r.choice(["cookie-notice", "cookies", "consent", "cookie-banner", "gdpr consent"])}"><p>{text}</p><button>{words(1, 2, "")}</button></div>',
            "notice": f'<div {r.choice(["role", "class"])}="{r.choice(["notice", "alert", "popup", "modal", "site-notice"])}">{r.choice([text, para])}</div>',
            "form": f"<form action='/s'><label>{words(1, 3, '')}</label><input name='q'><button>{words(1, 1, '')}</button>{r.choice(['', para])}</form>",
            "login": f'<div class="login"><form><p>{words(2, 8)}</p><button>{words(1, 1, "")}</button></form></div>',
            "newsletter": f'<div class="{r.choice(["newsletter", "subscribe", "signup"])}"><h3>{words(1, 4, "")}</h3><p>{words(4, 18)}</p></div>',
            "comments": f'<{(c := r.choice(["section", "div"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "responses", "discussion", "reader-comments"])}"><h3>{words(1, 3, "")}</h3>'
            + "".join(f'<div class="{r.choice(["comment", "comment-body", "reply"])}"><p>{words(4, 60)}</p></div>' for _ in range(r.randint(1, 4)))
            + f"</{c}>",
            "related": f'<div class="{r.choice(["related", "related-posts", "more-stories", "recommended"])}"><h3>{words(1, 3, "")}</h3><ul>{links(4)}</ul></div>',
            "share": f'<div class="{r.choice(["share", "social", "share-buttons"])}"><a href="#">{words(1, 2, "")}</a> <a href="#">{words(1, 1, "")}</a></div>',
            "crumbs": f'<div class="{r.choice(["breadcrumb", "breadcrumbs"])}"><a href="/">{words(1, 1, "")}</a> » <a href="/x">{words(1, 1, "")}</a></div>',
            "pager": f'<div class="{r.choice(["pager", "pagination"])}"><a href="/2">{words(1, 2, "")}</a></div>',
            "tags": f'<div class="{r.choice(["tags", "meta", "post-meta", "byline"])}">{words(1, 5, "")}</div>',
            "author": f'<div class="{r.choice(["author", "author-bio", "about-author"])}"><p>{words(5, 30)}</p></div>',
        }[kind]

    pages = []
    for _ in range(n):
        main: list[str] = []

        def say(tag: str, text: str, close: bool = True, main: list[str] = main) -> str:
            main.append(text)
            return f"<{tag}>{text}" + (f"</{tag}>" if close else "")

        holder = r.choice(["article", "article", "article", "main", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div id="main"', "div", "body"])
        inner = [say(r.choice(["h1", "h1", "h2"]), words(1, 12, r.choice(["", "."])))] if r.random() < 0.9 else []
        if holder == "article" and inner and r.random() < 0.15:
            inner[0] = f"<header>{inner[0]}</header>"
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                inner.append(say("p", words(1, r.choice([3, 20, 120])), r.random() < 0.9))
            elif kind < 0.8:
                a, b = words(2, 20), words(2, 60)
                main += [a, b]
                inner.append(f"<p><b>{a}<br><p>{b}</p>")
            elif kind < 0.85:
                inner.append("<ul>" + "".join(say("li", words(1, 14)) for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                inner.append("<blockquote>" + say("p", words(3, 30)) + "</blockquote>")
            elif kind < 0.94:
                inner.append(say("h2", words(1, 6, "")))
            elif kind < 0.97:
                inner.append(say("pre", words(3, 12, "")))
            elif holder != "body":
                inner.append(other())
        body = "".join(inner)
        tag = holder.split()[0]
        if tag != "body":
            body = f"<{holder}>{body}</{tag}>"
            if r.random() < 0.3:
                body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        if tag == "article" and r.random() < 0.2:
            body = f"<main>{body}</main>"
        before, after = "".join(other() for _ in range(r.randint(0, 4))), "".join(other() for _ in range(r.randint(0, 4)))
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 8, '')}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>", main))
    return pages


def training_set(pages: list[tuple[str, list[str]]]) -> list[tuple[list[Block], list[bool]]]:
    """Blocks with labels: a block is main text if the page's labels hold its text, each label once and in order."""
    out = []
    for page, main in pages:
        got, left = blocks(page), list(main)
        labels = []
        for b in got:
            labels.append(bool(left) and b.text == " ".join(left[0].split()))
            if labels[-1]:
                left.pop(0)
        out.append((got, labels))
    return out


def main_text(field: Field, page: str | None) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, main in zip(found, field.viterbi(found), strict=True) if main)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Main text of each page, blocks joined by two line feeds.

    Null and empty html, and pages without main text, give an empty text. Unclosed and misplaced tags are read as browsers do; a tag cut
    off by the page's end is no text. Repeated rows give repeated results; an empty table gives no rows; other columns than page_id, url
    and html are not looked at. Returns page_id, url, text, n_chars.
    """
    field = field or train(training_set(labelled_pages()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(field, page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op4(pages: DataFrame) -> DataFrame:
    return extract(pages)
