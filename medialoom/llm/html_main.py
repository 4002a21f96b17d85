"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import map_slices

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# the rest of a tag: a quoted value stands after "=" and may hold ">"; nothing is tried twice
REST = re.compile(r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*+["']))*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# HTML element names by their role, and words in class, id or role that mark what is not the article.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var br img wbr".split()
)
OUTSIDE = frozenset("nav footer aside form button select dialog menu head".split()) | RAW
CONTAINERS = frozenset("article main section div body html td center".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert sidebar widget comment comments disqus reply replies menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription signup "
    "login popup modal overlay paywall toolbar pagination pager contentinfo complementary search foot copyright opinions reactions responses discussion feedback".split()
)
FRAMES = frozenset("area bar block bottom box button buttons container field form group holder inner item left links list outer page reader readers right site top unit user users wrap wrapper".split())
PUNCTUATION = frozenset(string.punctuation + "。，、；：？！…“”‘’«»")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li ul ol dl dd dt div section".split())
CLOSES_P = frozenset(
    "p div article aside blockquote dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section "
    "table ul address details".split()
)


def unseen(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" or name.lower() == "style" and "display:none" in "".join(values).lower().replace(" ", ""):
            return True
    return False


def hinted(attributes: str) -> bool:
    """Whether a whole token of class, id or role is a hint: made of hints, and words for a frame, alone."""
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("hidden", "style"):
            continue
        for token in "".join(values).lower().split():
            pieces = set(re.split(r"[^a-z]+", token)) - {""}
            if pieces & HINTS and pieces <= HINTS | FRAMES:
                return True
    return False


def tags_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, slash, name, rest)`` of every tag, comment and declaration (these without a name), in page order.

    Each character is looked at a bounded number of times, whatever is left open: a comment without an end reaches to the
    end of the page, what starts a tag before the last ">" ends there at the latest, and once a quote has no partner, the
    tags after it end at the next ">".
    """
    at, last, quotes = page.find("<"), page.rfind(">"), True
    while 0 <= at:
        end = 0
        if page.startswith("<!--", at):
            shut = page.find("-->", at + 4)
            end = shut + 3 if shut >= 0 else len(page)
            yield at, end, "", "", ""
        elif at < last:
            if page[at + 1] in "!?":
                end = page.index(">", at) + 1
                yield at, end, "", "", ""
            elif m := NAME.match(page, at + 1, last):
                end = m.end() + 1
                if page[m.end()] != ">":
                    rest = REST.match(page, m.end()) if quotes else None
                    quotes = rest is not None
                    end = rest.end() if rest else page.index(">", m.end()) + 1
                yield at, end, m[1], m[2].lower(), page[m.end() : end - 1]
        at = page.find("<", end or at + 1)


class Paths:
    """Paths of block elements as numbers: each knows its parent, its name, its holder and whether it is in an article.

    A path's holder is the outermost part that is an innermost article or main element, else its innermost container.
    A number is larger than its parent's, so what paths hand down is found in one pass.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.name, self.holder, self.article = [0], [""], [0], [False]

    def below(self, parent: int, name: str) -> int:
        at = self.known.setdefault((parent, name), len(self.parent))
        if at == len(self.parent):
            article = name in ("article", "main")
            own = article or name in CONTAINERS and not self.article[parent]
            self.parent.append(parent)
            self.name.append(name)
            self.holder.append(at if own else self.holder[parent])
            self.article.append(article or self.article[parent])
        return at


def blocks_of(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's text blocks in order: path of block elements, text, characters within links.

    What stands in elements that never hold the article is left out; a page header only outside an article. Hinted elements
    are left out unless they are, or hold, an article or main element, or hold more than half of the text outside links.
    """
    paths = Paths()
    found, words, linked = [], [], 0
    stack: list[tuple[str, bool, int, int]] = []  # name, left out, path and innermost hinted element around it
    opened: Counter[str] = Counter()
    around: list[int] = [-1]  # of each hinted element, the next one around it; element 0 is the page
    within: list[int] = []  # innermost hinted element of each block
    holding = {0}
    path = hint = outside = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            found.append((path, text, min(linked, len(text))))
            within.append(hint)
        words.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal path, hint, outside, in_link
        if name in INLINE:
            in_link = 0 if name == "a" else in_link
            return
        flush()
        while stack:
            top, out, path, hint = stack.pop()
            opened[top] -= 1
            outside -= out
            if top == name:
                break

    def take(start: int, stop: int) -> None:
        nonlocal linked
        if stop > start and not outside:
            words.append(page[start:stop])
            if in_link:
                linked += stop - start

    at = 0
    for start, end, slash, name, rest in tags_of(page):
        if start < at:  # within a script or the like
            continue
        take(at, start)
        at = end
        if not name:
            continue
        if slash:
            if name in INLINE or opened[name]:
                close(name)
            continue
        if name in INLINE:
            in_link = 1 if name == "a" else in_link
            if name == "br" and not outside:
                words.append(" ")
            continue
        if name in VOID:
            flush()
            continue
        if name in RAW:
            shut = shut_of(name).search(page, end)
            at = shut.end() if shut else len(page)
            continue
        if name in CLOSES_P and opened["p"]:
            close("p")
        elif stack and name == stack[-1][0] and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            close(name)
        flush()
        in_article = opened["article"] or opened["main"]
        out = name in OUTSIDE or name == "header" and not in_article or name not in ("html", "body") and unseen(rest)
        stack.append((name, out, path, hint))
        opened[name] += 1
        if name in ("article", "main"):
            holding.add(hint)
        elif name not in ("html", "body") and not outside and not out and hinted(rest):
            around.append(hint)
            hint = len(around) - 1
        outside += out
        path = paths.below(path, name)
    take(at, len(page))
    flush()
    inside = [0] * len(around)
    for (_, text, in_links), n in zip(found, within, strict=True):
        inside[n] += len(text) - in_links
    for n in range(len(around) - 1, 0, -1):
        inside[around[n]] += inside[n]
        if n in holding:
            holding.add(around[n])
    drop = [False]
    for n in range(1, len(around)):
        drop.append(drop[around[n]] or n not in holding and 2 * inside[n] <= inside[0])
    return paths, [x for x, n in zip(found, within, strict=True) if not drop[n]]


@cache
def shut_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*+>", re.I)


def smooth(values: np.ndarray) -> np.ndarray:
    padded = np.pad(values, 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def main_text(page: str | None, share: float = 0.3, least: float = 0.2, in_links: float = 0.8) -> str:
    """Blocks of the paths whose fused ratio is at least ``share`` of the best, with what their holders hold, in page order.
    Before smoothing it has to be at least ``least`` of the best, so a large neighbour alone makes no path content.

    A path's ratios are its text length outside links and its punctuation marks per block. Both are smoothed over the
    paths in page order and fused by their product; paths in an article or main element count three times.

    What stands beside such a path in its holder, outside any article, is held against thresholds of its own. List items and
    bare elements of which at least ``in_links`` is linked text go. So does the text of a further container whose paths
    all stay below ``least``, unless it is a table cell or holds a heading. Headings, captions and other short blocks stay.
    """
    paths, blocks = blocks_of(page or "")
    if not blocks:
        return ""
    order = list(dict.fromkeys(p for p, _, _ in blocks))
    at = {p: i for i, p in enumerate(order)}
    whole, length, marks, n = np.zeros((4, len(order)))
    for p, text, linked in blocks:
        whole[at[p]] += len(text)
        length[at[p]] += len(text) - linked
        marks[at[p]] += sum(map(text.count, PUNCTUATION & set(text)))
        n[at[p]] += 1
    weight = np.array([3.0 if paths.article[p] else 1.0 for p in order])
    fused = np.sqrt(smooth(length / n) * (1 + smooth(marks / n))) * weight
    alone = np.sqrt(length / n * (1 + marks / n)) * weight
    strong = alone >= least * alone.max()
    best = (fused >= share * fused.max()) & strong
    seeds = [p for p, is_best in zip(order, best if best.any() else strong, strict=True) if is_best]
    holders = {paths.holder[p] for p in seeds}
    good = {paths.holder[p] for p, is_strong in zip(order, strong, strict=True) if is_strong or paths.name[p] in HEADINGS}
    held = [False] * len(paths.parent)
    for p in range(len(held)):
        wide = paths.name[p] in ("body", "html", "")
        held[p] = p in holders and not wide or held[paths.parent[p]]
    kept = set()
    for p, linked in zip(order, 1 - length / whole, strict=True):
        own = paths.holder[p]
        listed = linked >= in_links and paths.name[p] in LISTED and not paths.article[p]
        weak = own not in holders and own not in good and not paths.article[p] and paths.name[own] not in ("td", "center")
        if (held[p] or own in holders) and not listed and not weak:
            kept.add(p)
    return "\n\n".join(text for p, text, _ in blocks if p in kept)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    Character references are decoded, white space within a block becomes one space, blocks are joined by an empty
    line. Null, empty or markup-only pages give an empty text. Ids and urls may be null and are passed on; repeated
    rows give repeated rows; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))

    def extract(cols: dict) -> dict:
        texts = [main_text(h.as_py()) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    kinds = dict(rows.dtypes)
    return map_slices(rows, extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
