"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import in_small_batches, slices

# Function words of the languages that pages come in.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they
    you were their one all we can her has there been if more when will would who so no she what
    der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis unter man sein
    le la les de des du et à un une en que qui est dans pour pas au sur se il elle par ce ne sont plus avec son sa ses aux ou
    mais comme nous vous leur cette
    el los las que y del se un una por con no su para es al lo como más o pero sus le ha me si sin sobre este ya entre
    cuando todo esta ser son dos también fue había muy hasta desde""".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead title tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("li dt dd".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title".split())
#: Elements that hold what surrounds an article.
FRAMES = frozenset("nav footer aside form header menu dialog button select textarea fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar
    navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer footnav masthead topbar
    toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond replies
    pagination pager tags copyright legal disclaimer skip""".split())
#: Of the marks those that never name a part of an article: adverts, consent, sign-up, comments, links to other pages.
STRONG = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup
    modal overlay newsletter subscribe subscription signup login nav navbar menu menus breadcrumb breadcrumbs sidebar
    sidebars share sharing related recommended recommendations comment comments commentlist disqus respond replies
    pagination pager""".split())
#: Words that say how a marked element is built; an id of marks and these alone is no heading's.
BUILT = frozenset(
    """list box wrapper wrap banner section area container block inner outer item items thread form title header content panel
    unit slot bar bottom top group holder body count row col column link links button buttons posts""".split())
#: An aside of an article that repeats its words.
QUOTES = frozenset("pullquote pull quote blockquote".split())
#: Beside these a mark speaks of the page's layout ("has-sidebar", "comments-enabled").
LAYOUT = frozenset("has no with without enabled disabled free ready".split())
SITE_HEADS = frozenset("header site-header page-header topnav".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?=[\s=/]|$)")
_LETTERS = re.compile(r"[^\W\d_]+")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_LATIN = re.compile(r"[a-zà-öø-ÿœß]")
#: Languages that STOP_WORDS holds.
LISTED = frozenset("en de fr es".split())
#: So many blocks of links in a row, outside lists, are no part of an article.
RUN = 3


@dataclass(frozen=True)
class Rules:
    """Lengths in code points, densities as shares; in an article the stop-word bars are lower."""

    short: int = 70
    long: int = 200
    links: float = 0.35
    high: float = 0.30
    low: float = 0.18
    article_low: float = 0.0


@dataclass
class Block:
    text: str
    linked: int
    framed: bool
    article: int
    heading: bool
    label: str = ""
    marked: int = 0
    in_list: bool = False


def _kinds(word: str) -> tuple[set[str], set[str]]:
    """The marks of one class or id name, and what else it consists of; none for names that speak of layout."""
    parts = set(re.split(r"[-_]+", word)) | ({word} & MARKS)
    return (set(), parts) if parts & LAYOUT else (parts & MARKS, parts - MARKS - BUILT - {""})


def _in_doubt(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether, inside an article, a block may be what its mark says: ids are often made from headings."""
    if not in_article or not attributes or tag in HEADINGS or tag not in BLOCKS:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        for word in (a or b or c).lower().split() if name.lower() in ("class", "id") else ():
            if _kinds(word)[0]:
                return True
    return False


def _framed(tag: str, attributes: str, in_article: bool) -> bool:
    given = [(name.lower(), (a or b or c).lower()) for name, a, b, c in _ATTRIBUTE.findall(attributes or "")]
    if tag in FRAMES and not (tag == "header" and in_article):
        words = {p for name, value in given if name == "class" for p in re.split(r"[-_\s]+", value)}
        return not (tag == "aside" and in_article and words & QUOTES)
    if tag in ("body", "html", "main", "article"):
        return False
    if attributes and _HIDDEN.search(_QUOTED.sub("", attributes)):
        return True
    for name, value in given:
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name not in ("class", "id"):
            continue
        for word in value.split():
            marks, rest = _kinds(word)
            if not in_article:
                if marks or word in SITE_HEADS:
                    return True
            elif marks & STRONG and (name == "class" or not rest):
                return True
            elif marks and name == "class" and word in MARKS and tag in BLOCKS and tag not in HEADINGS:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """Text between block-level tags, with the link text in it and what it stands in.

    Unclosed elements end with the element around them; a stray end tag is ignored.
    """
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, framed, article, number of the mark in doubt
    articles, marks, links, at, skip = 0, 0, 0, 0, ""

    def flush():
        nonlocal text, linked
        whole = " ".join(references.unescape("".join(text)).split())
        if whole:
            inner = " ".join(references.unescape(" ".join(linked)).split())
            top = stack[-1] if stack else ("", False, 0, 0)
            found.append(Block(whole, len(inner), top[1], top[2], any(s[0] in HEADINGS for s in stack[-3:]), marked=top[3],
                               in_list=any(s[0] in LISTS for s in stack)))
        text, linked = [], []

    def put(piece: str):
        if piece and not skip:
            text.append(piece)
            if links:
                linked.append(piece)

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside a skipped element
        put(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            put(m[1])
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if not closing and tag in SKIPPED and not m[4].rstrip().endswith("/"):
            if tag in BLOCKS:
                flush()
            if tag != "head":
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCKS and tag not in FRAMES:
            # Inline; one that is marked (a notice in a span, say) stands for itself.
            inside = bool(stack and stack[-1][2])
            if not closing and m[4] and _framed(tag, m[4], inside):
                flush()
                stack.append((tag, True, stack[-1][2] if stack else 0, 0))
            elif closing and any(s[0] == tag for s in stack[-1:]):
                flush()
                stack.pop()
            continue
        flush()
        if tag == "hr":
            continue
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "p" or tag in HEADINGS:  # never hold blocks: an open one ends here
            while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS):
                stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()
        framed, article, mark = stack[-1][1:] if stack else (False, 0, 0)
        if tag in ("article", "main") and not article:
            articles += 1
            article = articles
        if _in_doubt(tag, m[4], bool(article)):
            marks += 1
            mark = marks
        stack.append((tag, framed or _framed(tag, m[4], bool(article)), article, mark))
    put(page[at:] if at < len(page) else "")
    flush()
    return found


def has_stop_words(found: list[Block], lang: str, rules: Rules) -> bool:
    """Whether stop-word density can judge this page: false for languages without a list."""
    if any(b.article for b in found):
        return True  # there, density decides nothing but what stands outside the article
    if lang and lang not in LISTED:
        return False
    text = " ".join(b.text.lower() for b in found if not b.framed and b.linked <= rules.links * len(b.text) and len(b.text) >= rules.short)
    words = _LETTERS.findall(text)
    if 2 * len(_LATIN.findall(text)) < sum(map(len, words)):
        return False
    return sum(w in STOP_WORDS for w in words) >= rules.low / 2 * len(words)


def settle(found: list[Block], rules: Rules) -> None:
    """What a mark in doubt holds is framed unless it has a block of some length and is mostly no links."""
    held: dict[int, list[Block]] = {}
    for b in found:
        if b.marked:
            held.setdefault(b.marked, []).append(b)
    for members in held.values():
        chars, linked = sum(len(b.text) for b in members), sum(b.linked for b in members)
        if linked > rules.links * chars or not any(len(b.text) >= rules.short and b.linked <= rules.links * len(b.text) for b in members):
            for b in members:
                b.framed = True


def classify(found: list[Block], rules: Rules, listed: bool = True) -> None:
    """First pass: good, bad, or still open (near-good, short). Without a list of stop words length decides.

    In an article a block of links is a source or a reference, unless it is one of a run outside lists.
    """
    dense = [b.linked > rules.links * len(b.text) for b in found]
    runs, at = [0] * len(found), 0
    while at < len(found):
        end = at
        while end < len(found) and dense[end] and not found[end].in_list and found[end].article == found[at].article:
            end += 1
        runs[at:end] = [end - at] * (end - at)
        at = max(end, at + 1)
    for b, many, run in zip(found, dense, runs, strict=True):
        n = len(b.text)
        words = _LETTERS.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.framed or (run >= RUN if b.article else many):
            b.label = "bad"
        elif not b.article and re.match(r"(?i)©|copyright\b|all rights reserved", b.text):
            b.label = "bad"
        elif n < rules.short or b.heading:
            b.label = "short" if not b.linked or b.article else "bad"
        elif not listed or density >= rules.high or b.article and density >= rules.article_low:
            b.label = "good" if n >= rules.long or b.article else "near"
        else:
            b.label = "near" if density >= rules.low else "bad"


def inherit(found: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided neighbours.

    Neighbours in the same article count first; near-good blocks need one good side. Equal
    distances, or an article without a decided block, speak for the text.
    """
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]
    section = [(b.article, b.framed) for b in found]
    n = len(found)

    def nearest(same: bool) -> tuple[list, list]:
        sides = []
        for order in (range(n), range(n - 1, -1, -1)):
            last: dict = {}
            side: list = [None] * n
            for i in order:
                key = section[i] if same else 0
                side[i] = last.get(key)
                if decided[i]:
                    last[key] = i
            sides.append(side)
        return sides[0], sides[1]

    near, far = nearest(True), nearest(False)
    for i, b in enumerate(found):
        if decided[i]:
            continue
        sides = [j for j in (near[0][i], near[1][i]) if j is not None]
        if not sides and b.article:
            b.label = "good"
            continue
        sides = sides or [j for j in (far[0][i], far[1][i]) if j is not None]
        good = [abs(j - i) for j in sides if decided[j] == "good"]
        bad = [abs(j - i) for j in sides if decided[j] == "bad"]
        if b.label == "near":
            b.label = "good" if good or not bad else "bad"
        else:
            b.label = "good" if good and (not bad or min(good) <= min(bad)) else "bad"


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    if not page:
        return ""
    found = blocks(page)
    settle(found, rules)
    lang = _LANG.search(page)
    classify(found, rules, has_stop_words(found, lang[1].lower() if lang else "", rules))
    inherit(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page, or one without an article, has the empty text. Blocks come in
    page order, one a line; nothing else is dropped or cut. Repeated rows give repeated
    rows, a null id or url stays null, an empty table gives none. Other columns are not read.
    """

    def run(batches):
        for part in slices(batches):
            texts = [main_text(page, rules) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return in_small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
