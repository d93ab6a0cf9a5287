"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block of text; pieces that stand in a menu, header, footer, sidebar, notice, advert, form or
reader comment are no text, and a line of nothing else is a blank one.  A line weighs as many characters as it has outside of links.
Weights are summed over sliding windows of WINDOW lines; text begins where the sums surge over THRESHOLD and ends where they dive to
zero, and the lines between the two points are kept, those of links alone too (of such lines ahead of the first weighty one, only from the
first heading or paragraph on, as others are a menu's end).  If no window surges, the run of lines with the greatest sum is kept.

Article and main elements are a prior on the weights.  The zone that a page marks with the greatest weight, and marked zones of at least
SHARE of it, are believed: each of their lines weighs ABOVE characters more, so that a short one surges too, and lines outside all zones
weigh OUTSIDE characters less.  Smaller zones (teasers, cards) weigh what they have.  If the text that surges outside outweighs each
zone, no mark is believed, and all lines weigh what they have.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 3, 86
ABOVE, OUTSIDE, SHARE = THRESHOLD + 1, 200, 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
#: Elements whose content is no markup, and those of them that are shown: one as it stands, one with character references.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SHOWN = {"xmp": False, "textarea": True}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul xmp".split()
)
SPACE = frozenset("br td th".split())
#: Controls, pictures and replacements that stand within a line; what is in them neither is text nor ends the line.
ATOMS = frozenset("button select datalist template noscript svg object canvas audio video".split())
#: Elements that are never main text.
DROP = ATOMS | frozenset("head nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open p ends where one of these begins.
CLOSES_P = BLOCK - {"li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "legend", "html", "head", "body"}
#: Words in a class that name an advert, a reader comment, a menu, a footer, a sidebar or a notice, wherever it stands.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo comment comments commentlist disqus respond replies"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices newsletter subscribe popup".split()
)
#: Whole classes of bars of buttons within an article.
BARS = frozenset("share sharing share-bar share-buttons social-share social-links toolbar pagination pager".split())
#: Words in a class that name boilerplate of a container outside marked zones.
OUTER = NAMES | frozenset(
    "sponsor promotion banner header masthead topbar modal overlay subscription share sharing social related recommended recommendations"
    " reply widget toolbar copyright legal disclaimer login signup search pagination pager skip alert".split()
)
#: Words in an id that do.
OUTER_IDS = NAMES | frozenset("header masthead topbar banner modal overlay toolbar login signup search pagination".split())
#: The same, where the element is the article itself or its main container.
ARTICLE_NAMES = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Prefixes that say what a container has, not what it is; and those of parts of an article, whose headers hold its title.
NOT_NAMES = frozenset("has with no without".split())
PARTS = frozenset("article post entry content story".split())
KEPT = frozenset("html body".split())
ZONES = frozenset("article main".split())
#: Containers without a meaning of their own.
PLAIN = frozenset("div ul ol dl table tr td center".split())


class Line(NamedTuple):
    """A block's text, empty where all of it is boilerplate; characters of links; the number of its article, -1 in main alone, or
    0; and whether it is a heading or a paragraph."""

    text: str
    links: int
    zone: int
    prose: bool

    @property
    def weight(self) -> int:
        return max(0, len(self.text.replace(" ", "")) - self.links)


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())


def _named(name: str, names: frozenset[str]) -> bool:
    words = _words(name)
    return bool(words) and words[0] not in NOT_NAMES and any(w in names and not (w == "header" and words[0] in PARTS) for w in words)


def _bad(tag: str, text: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its attributes.

    A class is read word by word, an id as a whole (it is mostly an address of its text) but on plain containers.  Inside a marked zone, and
    for elements other than plain containers, only NAMES count.
    """
    if tag in KEPT or not text or "=" not in text and "hidden" not in text:
        return False
    have = attributes(html.unescape(text) if "&" in text else text)
    if "hidden" in have or have.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", have.get("style", ""), re.I):
        return True
    if have.get("role", "").lower() in ROLES and tag not in ZONES:
        return True
    classes, own_id = have.get("class", "").split(), have.get("id", "")
    if tag in ZONES:
        return any(_named(x, ARTICLE_NAMES) for x in (*classes, own_id))
    names = NAMES if inside or tag not in PLAIN else OUTER
    if any(_named(x, names) or x.lower() in BARS for x in classes):
        return True
    return tag not in HEADINGS and (own_id.lower() in names or own_id.lower() == "disqus_thread" or not inside and tag in PLAIN and _named(own_id, OUTER_IDS))


class _Stripper:
    """Strips the markup of one page, a tag at a time."""

    def __init__(self) -> None:
        self.out: list[Line] = []
        self.parts: list[str] = []
        self.blank = False  # the open line has boilerplate
        self.links = self.link = self.article = self.articles = self.main = 0
        self.bad: list[str] = []  # the tag that began the boilerplate, then nested elements of that name
        self.heads = 0  # open headers of a zone, of which headings are kept
        self.in_heading = False
        self.opened = ""  # the block that the last tag of one opened, if it did

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.blank:
            zone = self.articles if self.article else -1 if self.main else 0
            self.out.append(Line(text, self.links, zone, self.in_heading or self.opened == "p"))
        self.parts.clear()
        self.links, self.blank = 0, False

    def say(self, text: str, decode: bool = True) -> None:
        if not text:
            return
        if self.bad or self.heads and not self.in_heading:
            self.blank = self.blank or not text.isspace()
            return
        if decode and "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.link:
            self.links += len("".join(text.split()))

    def close(self, tag: str) -> None:
        if self.bad:
            if tag == self.bad[0]:
                self.bad.pop()
            elif tag in ZONES | KEPT and tag not in self.bad:
                self.bad.clear()  # the boilerplate was never closed; its surroundings are
            else:
                return
            if self.bad or tag not in ZONES:
                return
        if tag == "article":
            self.article = max(0, self.article - 1)
        elif tag == "main":
            self.main = max(0, self.main - 1)
        elif tag == "a":
            self.link = 0
        elif tag == "header" and self.heads:
            self.heads -= 1
        elif tag in HEADINGS:
            self.in_heading = False

    def open(self, tag: str, rest: str) -> None:
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            return
        if self.bad:
            if self.bad[0] == "p" and tag in CLOSES_P or self.bad[0] == tag == "li":
                self.bad.clear()
            else:
                if tag == self.bad[0]:
                    self.bad.append(tag)
                return
        inside = bool(self.article or self.main)
        if tag == "header" and inside and not _bad("article", rest, True):
            self.heads += 1
        elif tag in DROP or tag == "header" or _bad(tag, rest, inside):
            self.bad.append(tag)
        elif tag == "article":
            self.articles += not self.article
            self.article += 1
        elif tag == "main":
            self.main += 1
        elif tag == "a":
            self.link = 1
        elif tag in HEADINGS:
            self.in_heading = True

    def strip(self, page: str) -> list[Line]:
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                self.say(page[at:])
                break
            self.say(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, rest = m[1] or m[4], m[3] if m[2] else m[6]
            if tag in BLOCK and not (self.bad and self.bad[0] in ATOMS):
                self.end_line()
                self.opened = "" if closing else tag
            elif tag in SPACE and not self.bad:
                self.parts.append(" ")
            if closing:
                self.close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag in SHOWN and not (self.bad or _bad(tag, rest, bool(self.article or self.main))):
                    self.say(page[at : end.start() if end else n], SHOWN[tag])
                if tag in BLOCK:
                    self.end_line()
                at = end.end() if end else n
            else:
                self.open(tag, rest)
        self.end_line()
        return self.out


def lines(page: str) -> list[Line]:
    """The lines of a page in its order."""
    return _Stripper().strip(page)


def spans(weights: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(surge, dive) points: from the first weighty line of a run whose window sum exceeds the threshold, to the next zero sum.

    If no sum does, the run with the greatest one.
    """
    n = len(weights)
    run = [0]
    for w in weights:
        run.append(run[-1] + w)
    sums = [run[min(n, i + window)] - run[i] for i in range(n)]
    found, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        found.append((max(sums[i:j]), i, j))
        i = j
    over = [(i, j) for top, i, j in found if top > threshold]
    return over or [max(found, key=lambda x: x[0])[1:] for _ in found[:1]]


def weigh(found: list[Line]) -> tuple[list[int], bool]:
    """(weight of each line, whether the page's marks are believed)."""
    own = [x.weight for x in found]
    zones: dict[int, int] = {}
    for x, w in zip(found, own, strict=True):
        if x.zone and x.text:
            zones[x.zone] = zones.get(x.zone, 0) + w
    if not zones:
        return own, False
    top = max(zones.values())
    beside = [0 if x.zone else w for x, w in zip(found, own, strict=True)]
    if sum(beside[k] for i, j in spans(beside) for k in range(i, j)) > max(THRESHOLD, top):
        return own, False
    believed = {z for z, w in zones.items() if w >= SHARE * top}

    def prior(x: Line, w: int) -> int:
        if not x.zone:
            return max(0, w - OUTSIDE)
        return w + ABOVE if x.zone in believed and x.text else w

    return [prior(x, w) for x, w in zip(found, own, strict=True)], True


def main_text(page: str | None) -> str:
    """The lines of the main text, joined by two line feeds; empty if there is none."""
    found = lines(page or "")
    weights, believed = weigh(found)
    kept = []
    for i, j in spans(weights):
        begun = False
        for x, w in zip(found[i:j], weights[i:j], strict=True):
            begun = begun or w > 0 or x.prose and bool(x.text)
            if begun and x.text and (w or x.zone or not believed):
                kept.append(x.text)
    return "\n\n".join(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html, and one without main text, gives an empty text; page_id and url are passed on, null or not; repeated
    rows are each returned; more columns are ignored; no rows give no rows.  Not shown, and so no text: hidden elements, templates, and what
    stands in place of scripts, sounds, films and drawings.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
