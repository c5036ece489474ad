"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read once into flat blocks, the runs of text between block-level tags. A block is
described by its word count and link density, those of the blocks before and after it, and where it
stands (the container around it, heading, list item). A decision tree, grown by Gini gain on a small
labelled table, tells main text from the rest. The labelled table comes from page layouts written
down here, so fitting reads no data. Half of the layouts have no telling container at all: there,
words and links decide.

The nearest container wins: an article inside something called a sidebar is an article. Menus,
asides, adverts and comments keep what stands in them, whatever it is called.

Defined cases: null and empty pages, and pages without main text, give an empty text; unclosed and
misnested tags, missing ends, stray ``<`` and unknown character references are read as text or
skipped as browsers do; character references end at the next tag; repeated rows give repeated rows;
further columns pass through, but for one called like ``into``, which is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements by what they do to text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup
option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio object canvas""".split())
FURNITURE = frozenset("""nav aside footer button select menu dialog template noscript svg head fieldset video audio object
canvas search""".split())
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words in class names and ids: of blocks that are never main text, of page parts, and of main text.
FIRM_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted cookie cookies consent
gdpr newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond remark remarks talkback
guestbook sharing social related recommended recommendations popup modal overlay login breadcrumb breadcrumbs pagination pager
teaser outbrain taboola skip""".split())
LOOSE_WORDS = frozenset("""promotion banner notice notices alert sidebar menu navigation nav navbar footer header masthead topbar
discussion share widget copyright legal disclaimer toolbar search feedback rating reviews form""".split())
MAIN_WORDS = frozenset("article content post entry story main text body".split())
# Words that only say what a block has or lacks, and words of blocks that hold a whole page.
MODIFIERS = frozenset("has no with without hide show".split())
WHOLE = frozenset("layout page site app".split())
# Where a block stands: in article or main; in a block named like main text; in either inside a loosely named part;
# in none; in a loosely named part; in a firm one.
ARTICLE, NAMED, INSIDE, PLAIN, LOOSE, FIRM = range(6)


def _names(found: dict[str, str]) -> set[str]:
    """Telling words of an element's class names and id."""
    words, whole = set(), False
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        for word in PARTS.findall(token):
            if word.lower() in MODIFIERS:
                break
            words.add(word.lower())
        whole = whole or token.lower() in WHOLE
    return words - LOOSE_WORDS if whole else words


def _place(tag: str, attributes: str, place: int) -> int:
    """Where the text of an element stands, from its name and where the element itself stands."""
    strong, named = tag in ("article", "main"), False
    loose = tag == "form"
    firm = tag in FURNITURE or tag == "header" and place not in (ARTICLE, NAMED, INSIDE)
    if attributes and ("=" in attributes or "hidden" in attributes) and tag not in ("html", "body"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        words = _names(found)
        strong = strong or role in ("main", "article")
        firm = firm or role in ROLES or bool(words & FIRM_WORDS) and tag != "main"
        loose = loose or bool(words & LOOSE_WORDS) and not strong
        named = bool(words & MAIN_WORDS) and not loose
        firm = firm or found.get("aria-hidden") == "true" \
            or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""))) \
            or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))
    if place == FIRM or firm:
        return FIRM
    if loose:
        return LOOSE
    if strong or named:
        if place in (LOOSE, INSIDE):
            return INSIDE
        return ARTICLE if strong or place == ARTICLE else NAMED
    return place


def blocks(page: str) -> list[tuple[str, int, float, int, str]]:
    """Flat blocks of a page: text, words, link density, where it stands, tag."""
    out: list[tuple] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    in_link, at, end = 0, 0, len(page)

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                n = text.count(" ") + 1
                links = len("".join(linked).split()) if linked else 0
                tag, place = stack[-1]
                out.append((text, n, min(1.0, links / n), place, tag))
            pieces.clear()
            linked.clear()

    def leave() -> None:
        opened[stack.pop()[0]] -= 1

    while at < end:
        m = TAG.search(page, at)
        text = html.unescape(page[at:m.start() if m else end])
        if text:
            pieces.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            if not closing:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
            linked.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in BLOCK:
            flush()
            in_link = in_link if tag in ("div", "p", "h1", "h2", "h3", "h4") and not closing else 0
            if closing:
                # Only an end with an open start ends anything, so each start is left once.
                if opened[tag]:
                    while stack[-1][0] != tag:
                        leave()
                    leave()
            else:
                ends = ENDS.get(tag, ENDS["p"] if tag != "html" else ())
                while len(stack) > 1 and stack[-1][0] in ends:
                    leave()
                while tag == "body" and len(stack) > 1:  # whatever the head left open
                    leave()
                stack.append((tag, _place(tag, attributes, stack[-1][1])))
                opened[tag] += 1
    flush()
    return out


def container(found: list[tuple]) -> int:
    """The kind of place that holds a page's main text: an article if there is one, else the one with most plain words."""
    plain = [0.0] * 6
    for _, n, density, place, _ in found:
        plain[place] += n * (1 - density)
    if plain[ARTICLE]:
        return ARTICLE
    if plain[NAMED] and 4 * plain[NAMED] >= plain[PLAIN]:
        return NAMED
    return INSIDE if plain[INSIDE] > plain[PLAIN] else PLAIN


COLUMNS = ("words", "link density", "words before", "link density before", "words after", "link density after",
           "in the container", "container", "place", "heading", "list item")


def features(found: list[tuple]) -> np.ndarray:
    """A row of ``COLUMNS`` for each block."""
    n, best = len(found), container(found)
    own = np.array([[b[1], b[2]] for b in found], np.float64).reshape(n, 2)
    none = np.zeros((1, 2))
    place = np.array([[b[3] == best, best, b[3], b[4] in ("h1", "h2", "h3", "h4", "h5", "h6"), b[4] in ("li", "td", "th", "dd", "dt")]
                      for b in found], np.float64).reshape(n, 5)
    return np.column_stack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), place])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2) -> tuple | float:
    """Decision tree by Gini gain: (feature, threshold, low, high) or the share of main text."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        low, high = np.cumsum(t)[:-1] / n, (t.sum() - np.cumsum(t)[:-1]) / (len(t) - n)
        gain = share * (1 - share) - (n * low * (1 - low) + (len(t) - n) * high * (1 - high)) / len(t)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = 0
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (gain[k], f, float(v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def classify(tree: tuple | float, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def labelled_pages(pages: int = 300, seed: int = 4) -> list[tuple[str, str]]:
    """Small pages of common layouts; the words of main text all start with ``m``."""
    rng = np.random.default_rng(seed)

    def words(kind: str, low: int, high: int) -> str:
        return " ".join(f"{kind}{i}" for i in range(rng.integers(low, high)))

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{i}">{words("x", 1, 4)}</a></li>' for i in range(rng.integers(low, high)))

    def paragraph(least: int) -> str:
        link = f' <a href="#">{words("m", 1, 4)}</a>' if rng.random() < 0.2 else ""
        return f"<p>{words('m', least, 120)}{link}</p>"

    def named(k: int) -> str:
        """A page whose main text stands in a container that says so."""
        parts = [
            f"<h2>{words('m', 1, 6)}</h2>" if kind < 0.15 else
            f"<ul><li>{words('m', 1, 20)}</li><li><a href='#'>{words('m', 1, 9)}</a></li></ul>" if kind < 0.25 else
            f"<p><a href='#'>{words('m', 1, 40)}</a></p>" if kind < 0.3 else
            f"<p>{words('m', 1, 5)}</p>" if kind < 0.45 else paragraph(8)
            for kind in rng.random(rng.integers(1, 12))]
        text = f"<h1>{words('m', 2, 12)}</h1>{''.join(parts)}"
        inner = (f'<div class="ad">{words("x", 2, 60)}</div>' if k % 3 == 0 else
                 f'<div class="comments"><article><p>{words("x", 2, 60)}</p></article></div>' if k % 3 == 1 else
                 f"<aside><p>{words('x', 2, 60)}</p></aside>")
        main = (f"<article>{text}{inner}</article>", f"<main>{text}</main>{inner}", f'<div id="content">{text}{paragraph(30)}{inner}</div>',
                f'<div class="sidebar-box"><article>{text}{paragraph(30)}</article></div>{inner}')[k % 4]
        plain = f"<div>{words('x', 1, 90)}</div>" if k % 4 < 3 and k % 5 < 2 else ""  # text beside the article
        return (f'{plain}<header><p>{words("x", 1, 9)}</p></header>{main}'
                f'<section id="comments"><h3>{words("x", 1, 3)}</h3><p>{words("x", 3, 60)}</p><p>{words("x", 10, 90)}</p></section>'
                f'<div class="sidebar"><h3>{words("x", 1, 3)}</h3><ul>{links(2, 6)}</ul><p>{words("x", 10, 50)}</p></div>'
                f"<form><label>{words('x', 1, 4)}</label><p>{words('x', 4, 30)}</p></form><div>{words('x', 1, 6)}</div>")

    def bare(k: int) -> str:
        """A page on which nothing tells but words and links."""
        crowd = "".join(f'<div><a href="/{i}">{words("x", 4, 70)}</a></div>' for i in range(rng.integers(1, 4)))
        long_link = f'<div><a href="/l">{words("x", 15, 40)}</a> <a href="/k">{words("x", 15, 40)}</a></div>'
        head = f"<h1>{words('m', 2, 12)}</h1>" if k % 3 else ""
        body = "".join(paragraph(20) + (f"<h2>{words('m', 1, 6)}</h2>{paragraph(15)}" if kind < 0.3 else
                                        f"<p>{words('m', 1, 15)}</p>{paragraph(15)}" if kind < 0.7 else "")
                       for kind in rng.random(rng.integers(1, 9)))
        menu = "" if k % 5 == 0 else f"<ul>{links(3, 9)}</ul>" if k % 2 else f"<div>{words('x', 1, 5)}</div>"
        return (f"{menu}{crowd if k % 4 == 2 else ''}{head}{body}{long_link if k % 4 < 2 else ''}"
                f"<ul>{links(1, 5)}</ul><div>{words('x', 1, 9)}</div>")

    out = []
    for k in range(pages):
        body = named(k // 2) if k % 2 else bare(k // 2)
        out.append((
            f"<html><head><title>{words('x', 2, 9)}</title></head><body>"
            + (f"<nav><ul>{links(2, 9)}</ul></nav>" if (k // 2) % 5 else "")
            + (f'<div class="cookie-notice"><p>{words("x", 8, 40)}</p><button>{words("x", 1, 3)}</button></div>' if k % 3 == 1 else "")
            + f"{body}<footer><p>{words('x', 2, 30)}</p></footer></body></html>", "m"))
    return out


def trained_tree(pages: list[tuple[str, str]] | None = None) -> tuple | float:
    """Tree for labelled pages; a block is main text if it starts with the page's mark."""
    x, y = [], []
    for page, mark in labelled_pages() if pages is None else pages:
        found = blocks(page)
        x.append(features(found))
        y += [float(b[0].startswith(mark)) for b in found]
    return grow(np.vstack(x), np.array(y))


def main_blocks(page: str, tree: tuple | float) -> list[str]:
    found = blocks(page)
    return [b[0] for b, row in zip(found, features(found)) if classify(tree, row)] if found else []


EXTRACTED = "struct<text: string, blocks: int, main: int>"
_EXTRACTED_ARROW = pa.struct([("text", pa.string()), ("blocks", pa.int32()), ("main", pa.int32())])


def extract(pages: DataFrame, *, page: str = "html", tree: tuple | float | None = None, into: str = "extracted") -> DataFrame:
    """``pages`` with a struct column: main text, number of blocks and of main blocks."""
    model = trained_tree() if tree is None else tree

    @F.arrow_udf(EXTRACTED)
    def extracted(values: pa.Array) -> pa.Array:
        out = []
        for value in values:
            found = blocks(value.as_py() or "")
            main = [b[0] for b, row in zip(found, features(found)) if classify(model, row)] if found else []
            out.append({"text": " ".join(main), "blocks": len(found), "main": len(main)})
        return pa.array(out, type=_EXTRACTED_ARROW)

    return pages.withColumn(into, extracted(F.col(page).cast("string")))
