"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, forms and containers that name themselves boilerplate
(menus, headers, footers, sidebars, notices, adverts, comments) are left out, unless they hold the article. The first
pass classifies each block by stop-word density, length and link density as good, bad, near good or short; on a page
whose language has no stop words here, by length and link density. In the second pass, ambiguous blocks take the label
of the nearest decided neighbours. Inside an article or main element, whose edges count as good neighbours, only link
lists are bad, and what belongs to them goes with them: a short line that ends no sentence heads what follows it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.common import table

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    (
        "a about after all an and are as at be been but by for from had has have he her his i if in into is it its more no not of on or our she so that the their there "
        "they this to was we were what when which who will with would you your "
        "au aux avec ce ces comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa sans se ses son sont sur un une vous "
        "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann mit nach nicht noch nur oder "
        "sich sie sind so über um und vom von vor war was wenn wie wir zu zum zur "
        "al como con del el ella ellos entre era es esta este esto ha hay lo los las más mi muy nos o para pero por sí sin sobre su sus también te tu y ya"
    ).split()
)
LOW_DENSITY, HIGH_DENSITY = 0.15, 0.30
SHORT, LONG, MOST_LINKS = 70, 200, 0.4

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|/|$)", re.I)
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "xmp")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_BAD_TAGS = frozenset("nav footer aside form menu dialog select button head label input fieldset datalist".split())
#: Words in a class or id that name boilerplate, and words that say no more than that something is a container.
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation navlinks menu menus menubar "
    "breadcrumb breadcrumbs header masthead topbar footer footers sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices popup popups modal overlay newsletter newsletters "
    "subscribe subscription subscriptions signup login comment comments commentlist disqus replies reply respond share sharing shares social socials related recommend recommended recommendation "
    "recommendations search searchbar searchbox searchform pagination pager toolbar skip skiplink skiplinks".split()
)
_BOX_WORDS = frozenset(
    "area articles bar block body bottom box button buttons container content form group holder icon icons inner item items left link links list listing main media outer page panel posts right row section "
    "site slot stories text the top unit wrap wrapper".split()
)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_INSIDE = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Where a left-out container was never closed, it ends before one of these.
_STOPS = frozenset("article main footer header nav aside section body html".split())


def _names_boilerplate(value: str, inside: bool) -> bool:
    """Whether one of the names has a word for boilerplate; inside an article, no other telling word beside it."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = re.findall(r"[^\W\d_]+", name)
        bad = [w in _BAD_WORDS for w in words]
        if any(bad) and (not inside or all(b or w in _BOX_WORDS for w, b in zip(words, bad))):
            return True
    return False


def _is_bad(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _BAD_TAGS or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and _names_boilerplate(value, inside):
            return True
        if name == "role" and value.lower() in _BAD_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _tags(html: str):
    """(start, end, closing, name, attributes) of each tag; raw elements and comments are single items named ''."""
    at = 0
    while m := _TOKEN.search(html, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name in _RAW and not (m[1] or m[4]):
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else (len(html) if name in ("script", "style", "title", "textarea", "xmp") else at)
            yield m.start(), at, False, "", ""
        elif name:
            yield m.start(), at, bool(m[1] or m[4]), name, m[3] if m[3] is not None else m[6] or ""
        else:
            yield m.start(), at, False, "", ""


def _end_of(tags: list, i: int, end: int) -> tuple[int, int]:
    """Index of the last tag of the container opened at i, and where what follows it begins."""
    name, depth = tags[i][3], 0
    for k in range(i, len(tags)):
        if tags[k][3] == name:
            depth += -1 if tags[k][2] else 1
            if not depth:
                return k, tags[k][1]
    return next(((k - 1, tags[k][0]) for k in range(i + 1, len(tags)) if tags[k][3] in _STOPS), (len(tags) - 1, end))


def _holds_text(tags: list, html: str, i: int, last: int) -> bool:
    """Whether a container that would be left out holds an article, or is a form that holds most of the page's text."""
    if any(t[3] in _INSIDE and not t[2] for t in tags[i : last + 1]):
        return True
    if tags[i][3] != "form":
        return False
    sizes = [len(html[t[1] : n[0]].strip()) for t, n in zip(tags, [*tags[1:], (len(html),)])]
    return 2 * sum(sizes[i:last]) > sum(sizes)


def blocks(html: str) -> list[tuple[str, float, bool]]:
    """(text, link density, inside an article or main element) of each block in page order."""
    tags = list(_tags(html))
    out: list[tuple[str, float, bool]] = []
    parts: list[str] = []
    links, inside, link, at, i = 0, 0, False, 0, 0

    def close():
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append((text, min(1.0, links / len(text)), inside > 0))
        parts.clear()
        links = 0

    def add(piece: str):
        nonlocal links
        if piece:
            parts.append(piece)
            if link:
                links += len(" ".join(piece.split()))

    while i < len(tags):
        start, end, closing, name, attributes = tags[i]
        add(html[at:start])
        at = end
        if not name:
            pass
        elif name == "a":
            link = not closing
        elif name == "br":
            parts.append(" ")
        elif not closing and name not in _VOID and _is_bad(name, attributes, inside > 0):
            if name in _BLOCK:
                close()
            last, after = _end_of(tags, i, len(html))
            if not _holds_text(tags, html, i, last):
                i, at = last, after
        elif name in _BLOCK:
            close()
            link = False
            if name in _INSIDE:
                inside = max(0, inside + (-1 if closing else 1))
        i += 1
    add(html[at:])
    close()
    return out


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = [w.strip(".,;:!?\"'()[]{}*#%&$|-").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(text: str, density: float, inside: bool, foreign: bool = False) -> str:
    if density > MOST_LINKS:
        return "bad"
    if len(text) < SHORT:
        return "bad" if density and not inside else "short"
    stops, words = _stops(text)
    if foreign or stops >= HIGH_DENSITY * words:
        return "good" if len(text) > LONG else "near"
    if stops >= LOW_DENSITY * words:
        return "near"
    return "short" if inside else "bad"


def is_foreign(found: list[tuple[str, float, bool]]) -> bool:
    """Whether the longer blocks of a page have too few stop words for any of the languages known here."""
    stops, words = map(sum, zip((0, 0), *(_stops(text) for text, density, _ in found if len(text) >= SHORT and density <= MOST_LINKS)))
    return stops < LOW_DENSITY * words


def second_pass(labels: list[str], inside: list[bool], ends: list[bool]) -> list[bool]:
    """Whether each block is main text. ends: whether it ends as a sentence does.

    The edge of an article counts as good, the page's as bad. Near-good blocks need one good neighbour among the nearest
    decided ones, short ones outside an article two. Inside, a short block between a good and a bad one takes the label
    of the nearer if it ends a sentence, good where both are as near, else of the one that follows. Where a page without
    an article has no good block, the near-good ones are good.
    """
    n = len(labels)
    if "good" not in labels and not any(inside):
        labels = ["good" if x == "near" else x for x in labels]
    sides = []
    for order, step in ((range(n), -1), (range(n - 1, -1, -1), 1)):
        side, last, far = [("bad", 0)] * n, "bad", 0
        for i in order:
            k = i + step
            if not (0 <= k < n and inside[k] == inside[i]):
                last, far = "good" if inside[i] else "bad", 0
            far += 1
            side[i] = last, far
            if labels[i] in ("good", "bad"):
                last, far = labels[i], 0
        sides.append(side)
    out = []
    for label, within, ended, (before, a), (after, b) in zip(labels, inside, ends, *sides):
        if label == "near":
            out.append("good" in (before, after))
        elif label == "short" and within and before != after:
            out.append((before == "good" if a < b else after == "good" if b < a else True) if ended else after == "good")
        else:
            out.append(label == "good" or label == "short" and before == after == "good")
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    foreign = is_foreign(found)
    labels = [first_pass(*b, foreign) for b in found]
    kept = second_pass(labels, [b[2] for b in found], [b[0].rstrip("\"')]»”’").endswith((".", "!", "?", "…", ":")) for b in found])
    return "\n".join(b[0] for b, k in zip(found, kept) if k)


def _extract(batches):
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null and empty html, and pages without main text, give an empty text. Pages of any length are read whole. Null ids and addresses are returned as they
    are, repeated rows each give a row, an empty table gives no rows, other columns are ignored.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_extract": op8_html_extract}
