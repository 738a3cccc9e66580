"""Main text of web pages by two passes of block rules.

The first pass decides blocks by themselves: by the elements that hold them, by length, by the share of characters in
links and by the share of stop words. The second lets short and near-decided blocks take the label of their nearest
decided neighbours. Inside an article element its edges count as good neighbours; outside the page's edges count as
none: there a short heading or paragraph follows its only neighbour, and a heading goes with what comes after it. Where no
block is good by itself the nearly good ones are. Names in class and id are evidence only: one on an element that holds the
article or nearly all text says nothing, as a form around the page doesn't, and within an article layout names, and names
with words that no layout has, need the consent of length and stop words. Pages in a language without a stop list are
decided by length and links. Ideographs, which stand for whole words, count as LETTERS characters each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import tidy_batches
from .columns import free

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by can could did do for from had has have he her his how i if in into is it its "
        "more no not of on one or our she so some than that the their them then there these they this to up was we were "
        "what when which who will with would you your "
        "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes moi mon "
        "ne nos notre nous on ont ou par pas plus pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos vous y "
        "aber als am an auch auf aus bei bin bis da das dass dem den der des die dir du durch ein eine einem einen einer er es "
        "für hat ich ihr im in ist ja kein mein mich mir mit nach nicht noch nur ob oder sein sich sie sind so über um und uns "
        "unter vom von vor war was wenn werden wie wir zu zum zur "
        "al algo ante antes como con contra cual cuando de del desde donde durante e el ella ellos en entre era es esa ese eso "
        "esta este esto fue ha hay la las le les lo los más me mi muy no nos o os otra para pero por porque que se sin sobre "
        "su sus también te tiene todo tu un una uno unos y ya yo"
    ).split()
)

#: Elements that hold no article text, elements that hold the article, and parts of names in class or id that mark the former: ones that do anywhere, and ones that page layouts use too; parts before or beside which a mark says nothing; and roles.
OUTSIDE = frozenset("nav footer aside form button select option textarea iframe object svg math canvas dialog menu template noscript head title".split())
INSIDE = frozenset(("article", "main"))
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HELD = (BLOCKS | OUTSIDE) - frozenset("p li dd dt td th tr tbody thead tfoot h1 h2 h3 h4 h5 h6 hr option body html".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies reply respond share sharing social related recommended recommendations".split()
)
WEAK = frozenset("header masthead sidebar side widget widgets footer notice alert banner overlay tags disclaimer copyright topbar toolbar".split())
NEGATED = frozenset("has have with without no not non is hide show enable enabled".split())
#: Words that stand beside a strong one in names of layouts.
LAYOUT = frozenset(
    "a all area articles aside bar block body bottom bottoms box button buttons center col column columns container content count desktop fixed float footer form google grid group head header holder icon icons id inline inner item items label large "
    "left link links list lists main mobile module nav next news outer overlay panel placeholder post posts prev primary right row secondary section site slot small social space stories story sticky tab tabs text thread title titles top topics unit units view widget widgets wrap wrapper zone".split()
)
OF_ARTICLE = frozenset("article entry post story content main body".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())

#: Ideographs, kana and hangul, and the characters of a Latin text that one of them counts as.
_IDEOGRAPHS, LETTERS = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"), 3
#: A short block with one of these belongs to the page.
_OF_PAGE = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)

#: Lengths in characters, shares of link characters and of stop words that decide a block.
SHORT, LONG = 70, 200
MOST_LINKS, FEW_STOPS, MANY_STOPS = 0.2, 0.2, 0.28
#: A page with a smaller share of stop words is in a language without a list: length and links alone decide.
KNOWN = 0.15
#: A marked element with so much of the page's or its article's longer text is a layout's wrapper: strong and weak marks.
WRAPS = {"form": 0.9, "strong": 0.9, "weak": 0.5}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\bhidden\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    """A run of text: share of its characters in links; whether an element outside the article holds it; the number of its article element (0: none); whether a weak mark within the article puts it in doubt; the element whose text it is."""

    text: str
    links: float
    outside: bool
    article: int
    doubtful: bool = False
    element: str = ""


def size(text: str) -> int:
    """Characters, ideographs as LETTERS each."""
    return len(text) + (LETTERS - 1) * len(_IDEOGRAPHS.findall(text))


def mark(value: str) -> str | None:
    """strong, weak or None: what the names of a class or id say of an element."""
    found = None
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
        if not parts or parts[0] in NEGATED:
            continue
        if STRONG.intersection(parts):
            if all(p in STRONG or p in LAYOUT or p in WEAK or p.isdigit() or len(p) == 1 for p in parts):
                return "strong"
            found = "weak"
            continue
        weak = WEAK.intersection(parts)
        if weak and not OF_ARTICLE.intersection(parts) and not (weak == {"side"} and len(parts) > 2):
            found = "weak"
    return found


def _look(name: str, attributes: str, in_article: bool) -> tuple[bool, str | None]:
    """Whether an element is outside the article by itself, and the mark of its names."""
    if (name in OUTSIDE and (name != "form" or in_article)) or (name == "header" and not in_article):
        return True, None
    found = "form" if name == "form" else None  # around nearly all text, or the article, it is a page's wrapper
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1] is None:
            return True, None
        key, value = m[1].lower(), m[2].strip("\"'")
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, None
        elif key == "aria-hidden":
            if value.lower() == "true":
                return True, None
        elif key == "role":
            if value.strip().lower() in ROLES:
                return True, None
        else:
            found = "strong" if "strong" in (found, mark(value)) else found if found == "form" else mark(value) or found
    return False, found


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[tuple[str, float, bool, int, tuple[int, ...], str]] = []
    held: list[tuple[str, bool, int, tuple[int, ...]]] = []  # open elements that matter: name, outside, article, marked elements around
    marked: list[tuple[str, int, bool]] = []  # kind of each marked element, its article, whether it holds an article element
    text: list[str] = []
    linked, links, articles = 0, 0, 0
    outside, article, marks, element = False, 0, (), ""

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, min(1.0, linked / len(whole)), outside, article, marks, element))
            text.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(html.unescape(piece).strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                text.append(" ")
            continue
        if name == "a":
            links = 0 if m["end"] else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS or name in OUTSIDE:
            close()
            links = 0
            element = "" if m["end"] else name
            if name in HELD:
                if m["end"]:
                    for k in range(len(held) - 1, -1, -1):
                        if held[k][0] == name:
                            del held[k:]
                            break
                elif not m["attributes"].endswith("/"):
                    alone, kind = _look(name, m["attributes"], article > 0)
                    here, around, number = outside or alone, marks, article
                    if name in INSIDE and not here and not article:
                        articles += 1
                        number = articles
                        for k in marks:  # what holds an article element isn't beside it
                            marked[k] = (*marked[k][:2], True)
                    elif kind and not here:
                        marked.append((kind, article, False))
                        around = (*marks, len(marked) - 1)
                    held.append((name, here, number, around))
                outside, article, marks = held[-1][1:] if held else (False, 0, ())
    if at < len(page):
        text.append(page[at:])
    close()
    # How much of the longer text of the page, or of the article around it, a marked element holds.
    whole: dict[int, int] = {}
    mine = [0] * len(marked)
    for body, share, out_, number, around, _ in out:
        if not out_ and share <= MOST_LINKS and size(body) >= SHORT:
            for scope in {0, number}:
                whole[scope] = whole.get(scope, 0) + len(body)
            for k in around:
                mine[k] += len(body)
    counts = [not holds and (kind == "form" and articles > 0 or mine[k] <= WRAPS[kind] * whole.get(scope, 0)) for k, (kind, scope, holds) in enumerate(marked)]
    made = []
    for body, share, out_, number, around, tag in out:
        kinds = {(marked[k][0], marked[k][1] > 0) for k in around if counts[k]}
        made.append(Block(body, share, out_ or bool(kinds - {("weak", True)}), number, ("weak", True) in kinds, tag))
    return made


def labels(found: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    good, bad, short, near = "good", "bad", "short", "near"
    found = [Block(*b) for b in found]
    sizes = [size(b.text) for b in found]
    stops, words = [], []
    for b in found:
        w = _WORD.findall(b.text.lower())
        words.append(len(w))
        stops.append(sum(x in STOP_WORDS for x in w))
    asked = [i for i, b in enumerate(found) if not b.outside and sizes[i] >= SHORT and b.links <= MOST_LINKS]
    known = sum(stops[i] for i in asked) >= KNOWN * max(1, sum(words[i] for i in asked))
    first = []
    for b, s, w, long in zip(found, stops, words, sizes, strict=True):
        share = s / max(1, w) if known else MANY_STOPS
        if b.outside:
            first.append(bad)
        elif b.links > MOST_LINKS:
            first.append(short if b.article and b.links < 0.5 and not b.doubtful else bad)
        elif b.doubtful and (long <= LONG or share < MANY_STOPS):
            first.append(bad)
        elif long < SHORT:
            first.append(short)
        elif share >= MANY_STOPS:
            first.append(good if long > LONG or b.article else near)
        elif share >= FEW_STOPS or b.article:
            first.append(near)
        else:
            first.append(bad)
    if good not in first and not any(b.article for b in found):
        first = [good if x == near else x for x in first]
    # Nearest decided neighbours: those before and after within the same article, or else its edges; None at the page's.
    n = len(found)
    before: list[str | None] = [None] * n
    after: list[str | None] = [None] * n
    for ahead, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, where = None, 0
        for i in order:
            if found[i].article != where:
                last = good if found[i].article else bad
                where = found[i].article
            ahead[i] = last
            if first[i] in (good, bad):
                last = first[i]
    result = []
    for i, b in enumerate(found):
        label = first[i]
        heading = len(b.element) == 2 and b.element[0] == "h" and b.element != "hr"
        if label == short and b.article:
            label = bad if before[i] == after[i] == bad else good
        elif label == short:
            if before[i] == after[i] == good:
                label = good
            elif after[i] == good:
                label = good if heading or (before[i] is None and b.element == "p") else bad
            elif before[i] == good:
                label = good if b.element in ("p", "blockquote", "pre") and after[i] is None and not _OF_PAGE.search(b.text) else bad
            else:
                label = bad
        elif label == near:
            label = good if b.article or good in (before[i], after[i]) else bad
        result.append(label == good)
    return result


def main_text(page: str | None) -> str:
    """The main text of one page: its good blocks in page order, joined by two line feeds; empty for a null or a page without any."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns of pages but html_col, and out_col with the main text.

    A null or empty page has an empty text; each row keeps a row, repeated or not. Other columns stay as they are; out_col
    may be html_col itself, else it must be a new name.
    """
    others = [c for c in pages.columns if c != html_col]
    if out_col in others:
        raise ValueError(f"there is a column {out_col} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*others, out_col])

    schema = pages.select(*others, F.lit("").alias(out_col)).schema
    return pages.select(*others, F.col(html_col).cast("string").alias(free(pages, "html")[0])).mapInArrow(tidy_batches(run), schema)
