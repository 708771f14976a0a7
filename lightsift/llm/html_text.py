"""Main text of web pages by two-pass block rules: stop-word, length and link density, then nearest decided neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that for on with as was be by at are this from or an not have he she they you we his her
    de la le les et des en un une du que qui dans est pour pas sur par au avec ce il elle ne se plus son sa
    der die das und ist von zu mit den dem ein eine nicht auf sich als auch es an im für wie bei nach aus
    el los las y que se del por con no una su para es al lo como más pero sus
    il di che non per sono con da si lo gli
    o os as um uma do da em não com mais na no
    het een van dat niet te zijn voor met
    """.split()
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Raw text: whatever stands inside these is no markup, only their own end tag ends them; it is never text of the page.
RAW = "script|style|noscript|textarea|title|iframe|noembed|noframes|xmp"
#: What stands inside these is never text of the page either. Buttons and lists of choices hold no other one of their kind.
UNSEEN = frozenset("template select svg math object canvas audio video button".split())
SINGLE = frozenset(("button", "select"))
#: What stands inside these is never part of the article.
OUTSIDE = frozenset("nav footer aside header dialog menu".split())
#: Whole tokens of class, id and role. Part of a longer token says little: has-sidebar, page-with-comments, social-science.
NAME = r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav(?:s|bar|menu|igation)?|newsletter|notice|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget"
OUTSIDE_NAMES = re.compile(rf"(?:(?:site|page|global)[-_])?(?:{NAME})|(?:{NAME})[-_](?:area|list|section|box|bar|banner|links?|buttons?|icons?|posts?|signup|form|popup|modal|slot|unit|menu)", re.I)
#: Words of such tokens (between - and _) that name a box whatever stands beside them, unless a word says that the token only tells of one.
BOXES = frozenset("ad ads adsbygoogle adslot advert adverts advertisement advertising advertorial breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu modal nav navbar navigation newsletter notice popup promo promotion respond sidebar sponsor sponsored subscribe".split())
TELLING = frozenset("has have with without no not page hide".split())
COMMENTS = frozenset("comment comments disqus respond".split())
#: Landmarks that are no part of an article.
ROLES = frozenset("banner complementary contentinfo navigation search".split())
PARTS = re.compile(r"[-_]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of its values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}} | {t: {"p"} for t in BLOCKS - {"li", "dt", "dd", "td", "th", "tr", "option", "html", "body"}}
# a quote begins a quoted value only after an equals sign
INNER = r"(?:[^<>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<({RAW})(?=[\s/>]){INNER}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)({INNER})>", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in UNSEEN}
#: Letters beyond Latin script, and those of scripts that need few of them for a word.
BEYOND = re.compile(r"[^\W\d_\x00-\u024f\u1e00-\u1eff]")
DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, LINKED = 70, 140, 0.33
#: A page whose running text holds a smaller share of stop words is in none of their languages; blocks of fewer words tell nothing.
UNLISTED, FEW = 0.08, 8
STOP_LOW, STOP_HIGH = 0.10, 0.20
GOOD, BAD, NEAR, OPEN, LINKS = "good", "bad", "near", "open", "links"


class Block:
    __slots__ = ("text", "linked", "scope", "outside", "within", "heading", "label", "size", "words", "stops")

    def __init__(self, text: str, linked: int, scope: int, outside: bool, within: tuple[int, ...], heading: bool) -> None:
        self.text, self.linked, self.scope, self.outside, self.within, self.heading = text, linked, scope, outside, within, heading
        #: Length as of Latin script, and words and stop words of running text (none where stop words tell nothing).
        self.size, self.words, self.stops = len(text), 0, 0
        self.label = BAD if outside else self.first_pass()

    def by_length(self) -> str:
        return GOOD if self.size >= LONG else NEAR if self.size >= SHORT else OPEN

    def first_pass(self) -> str:
        if self.linked > LINKED * self.size:
            return LINKS if self.scope and self.size < LONG else BAD
        if not self.text.isascii():
            self.size += 2 * len(DENSE.findall(self.text))
            if 2 * len(BEYOND.findall(self.text)) > sum(map(len, WORD.findall(self.text))):
                return self.by_length()  # no stop words of its script
        if self.size < SHORT:
            return OPEN
        words = WORD.findall(self.text.lower())
        self.words, self.stops = len(words), sum(w in STOP_WORDS for w in words)
        if self.stops >= STOP_HIGH * max(1, self.words):
            return GOOD if self.size >= LONG else NEAR
        return NEAR if self.stops >= STOP_LOW * max(1, self.words) else OPEN


class Wrapper:
    """An element that its class, id or role (or being a form) says is no part of the article, unless it wraps that."""

    __slots__ = ("comments", "main", "article", "good")

    def __init__(self, comments: bool) -> None:
        self.comments, self.main, self.article, self.good = comments, False, False, 0


def box_words(name: str) -> frozenset[str]:
    """The words of a token of class, id or role if it names a box that is no part of the article, else none."""
    words = frozenset(PARTS.split(name.lower()))
    return words if OUTSIDE_NAMES.fullmatch(name) or words & BOXES and not words & TELLING else frozenset()


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; the first of a name counts, one without a value is ''."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        if name:
            out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(NOT_SHOWN.search(attrs.get("style", "")))


def without_stop_words(found: list[Block]) -> None:
    """On a page in a language that the stop words don't know, length and link density alone decide."""
    if sum(b.stops for b in found) < UNLISTED * sum(b.words for b in found):
        for b in found:
            if b.words >= FEW:
                b.label = b.by_length()


def settle(found: list[Block], wrappers: list[Wrapper], articles: list[tuple[int, ...]]) -> None:
    """Blocks inside of wrappers become bad.

    A wrapper does not count if it holds a main element or more than half of the good text, or, where no
    article stands outside of wrappers, if it holds one. Comments only do not count if they hold a main element.
    """
    total = 0
    for b in found:
        if b.label == GOOD:
            total += len(b.text)
            for w in b.within:
                wrappers[w].good += len(b.text)
    counts = [not (w.main or not w.comments and 2 * w.good > total) for w in wrappers]
    if not any(all(not counts[w] for w in around) for around in articles):
        counts = [c and (w.comments or not w.article) for c, w in zip(counts, wrappers, strict=True)]
    for b in found:
        if any(counts[w] for w in b.within):
            b.outside, b.label = True, BAD


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. scope: number of the article or main element around a block, 0 outside of any."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, tuple[int, ...], bool]] = []  # tag, in a part that is no article, scope, wrappers around, in an article's header
    wrappers: list[Wrapper] = []
    articles: list[tuple[int, ...]] = []  # the wrappers around each article or main element
    parts: list[str] = []
    linked, heading, scopes, links, breaks = 0, False, 0, 0, 0

    def end() -> None:
        nonlocal parts, linked, heading
        if text := " ".join("".join(parts).split()):
            out.append(Block(text, linked, stack[-1][2] if stack else 0, bool(stack) and stack[-1][1], stack[-1][3] if stack else (), heading))
        parts, linked, heading = [], 0, False

    def add(raw: str) -> None:
        nonlocal linked, breaks
        text = html.unescape(raw)
        parts.append(text)
        size = len("".join(text.split()))
        if size:
            breaks = 0
        if links:
            linked += len(text.strip())

    # unseen: the element whose content is left out, and whether the next block ends it, as it has no end tag of its own
    at, unseen, unended = 0, "", False
    none_left: set[str] = set()  # without a tag of their kind in the rest of the page
    for m in TOKEN.finditer(page):
        if not unseen and m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if unseen:
            if tag == unseen and closing:
                unseen = ""
                continue
            if not (unended and tag in BLOCKS):
                continue
            unseen = ""
        if tag in UNSEEN:
            if not closing and not m[4].endswith("/"):
                ahead = None if tag in none_left else NEXT[tag].search(page, at)
                if ahead is None:
                    none_left.add(tag)
                unended = ahead is None or tag in SINGLE and not ahead[1]
                unseen = "" if ahead is None and tag not in SINGLE else tag
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                end()
            continue
        if tag not in BLOCKS:
            if tag in VOID:
                parts.append(" " if tag in ("img", "input", "embed") else "")
            continue
        end()
        links = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            stack.pop()
        inner = stack[-1] if stack else ("", False, 0, (), False)
        attrs = attributes(m[4]) if m[4] else {}
        outside = inner[1] or tag in OUTSIDE or hidden(attrs)
        scope, within = inner[2], inner[3]
        # of an article's header its headings are text
        titles = (tag == "header" and scope > 0 and not inner[1] or inner[4] and tag not in OUTSIDE) and not hidden(attrs)
        if inner[4] and titles and tag in HEADINGS:
            outside = False
        if tag in ("article", "main"):
            if not outside:
                scopes += 1
                scope = scopes
                articles.append(within)
                for w in within:
                    wrappers[w].article = True
                    wrappers[w].main |= tag == "main"
        elif tag not in ("body", "html"):
            names = [w for a in ("class", "id", "role") for x in attrs.get(a, "").split() if (w := box_words(x))]
            if names or tag == "form" or attrs.get("role", "").strip().lower() in ROLES:
                within = (*within, len(wrappers))
                wrappers.append(Wrapper(any(w & COMMENTS for w in names)))
        if tag not in VOID:
            stack.append((tag, outside, scope, within, titles))
        heading = tag[0] == "h" and tag[1:].isdigit()
    if not unseen:
        add(page[at:])
    end()
    without_stop_words(out)
    settle(out, wrappers, articles)
    return out


def main_text(page: str) -> str:
    """Text of the blocks that the two passes call good, joined by an empty line."""
    found = blocks(page)
    for b, good in [(b, between_good(found, i)) for i, b in enumerate(found) if b.label == LINKS]:
        b.label = f"inherited {GOOD}" if good else BAD
    for i, b in enumerate(found):
        if b.label in (NEAR, OPEN):
            b.label = second_pass(found, i)
    return "\n\n".join(b.text for b in found if b.label.endswith(GOOD))


def between_good(found: list[Block], i: int) -> bool:
    """Whether a short block of links of an article stands between good ones: its nearest decided neighbours there are both good."""
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(found) and (found[j].label not in (GOOD, BAD) or found[j].scope != found[i].scope):
            j += step
        if not (0 <= j < len(found) and found[j].label == GOOD):
            return False
    return True


def second_pass(found: list[Block], i: int) -> str:
    """An undecided block takes the label of the nearest decided neighbour on either side inside its article.

    Where the neighbours differ the nearer one counts; at equal distance, and where nothing is decided,
    near-good blocks, headings and blocks of an article are good. Labels given here are marked as
    inherited, so they decide no other block. A heading of an article doesn't ask the boxes beside it.
    """
    own = found[i]
    sides = []
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(found) and (found[j].label not in (GOOD, BAD) or found[j].scope != own.scope or own.heading and own.scope and found[j].outside):
            j += step
        sides.append((abs(j - i), found[j].label) if 0 <= j < len(found) else None)
    known = sorted(s for s in sides if s)
    lean = GOOD if own.label == NEAR or own.heading or own.scope else BAD
    if not known:
        label = lean if own.scope or own.label == NEAR else BAD
    elif own.heading:
        label = sides[1][1] if sides[1] else known[0][1]
    elif len(known) == 2 and known[0][0] == known[1][0] and known[0][1] != known[1][1]:
        label = lean
    else:
        label = known[0][1]
    return "inherited " + label


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the `keep` columns and text (main text, '' if there is none) of each page; null html counts as empty.

    One row per input row, also of repeated rows and null ids; columns not named are ignored, whatever
    they are called. Pages of any length are parsed whole where they are read, in time proportional to it, and nothing is shuffled.
    """
    chosen = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in keep], F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return chosen.mapInArrow(run, "id long, " + "".join(f"`{c}` string, " for c in keep) + "text string")
