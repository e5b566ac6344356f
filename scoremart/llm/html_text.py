"""Main text of web pages by tag-path ratios.

Each text block of a page has the path of open block elements from the root to it.  Per path, text length, punctuation
and link text are summed.  The text-to-node ratio is smoothed over the paths that stand near each other in a container
(an article, a main element, or the elements around paragraphs and cells), and fused with the path's punctuation, its
share of text outside links, and weights: paths inside ``article`` and ``main`` count more, paths below an element whose
class or id only mentions a word of boilerplate count less, headings count as much as the text that follows them.  Paths
whose fused ratio reaches a fraction of the best one are content; their blocks are kept in page order.  So a list of links
inside an article goes, while short items beside its paragraphs stay.  Elements whose name or whole class says that they
are no running text (menus, forms, notices, adverts, comments, ...) have no content paths.

Null or empty html and pages without content give the empty string; null page ids and urls are carried as they are; repeated rows give equal texts; unclosed elements
are closed by their parents; broken tags count as text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)",
    re.S,
)
_CLASS = re.compile(r"(?<![\w-])(?:class|id|role|itemtype|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
#: Element names of the HTML standard by their role here.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark nobr output q rb rp rt ruby s samp"
    " small span strike strong sub sup time tt u var".split()
)
_BOILER_TAG = set("nav header footer aside form noscript template svg math button select option dialog menu object canvas audio video head".split())
_BOILER_WORD = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus"
    " dialog footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo"
    " promoted promotion related recommended reply replies responses search share sharing sidebar sidebars signup skip social sponsor"
    " sponsored subscribe subscription tags toolbar widget alert paywall discussion complementary contentinfo disclaimer".split()
)
#: Words that also name parts of an article; inside one they only lower the weight.
_UNSURE_WORD = set("alert comment dialog discussion disclaimer header notice recommended related reply search share social tags".split())
#: Words that leave the meaning of the word beside them as it is.
_NEUTRAL_WORD = set(
    "area bar block bottom box button buttons container content fixed inner item items left links list main mobile outer page panel"
    " primary right secondary section site sticky top wrap wrapper".split()
)
_CLOSES_P = set(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main menu nav ol p pre section summary table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements at which the search for an open sibling or paragraph ends.
_SCOPE = set("article section div table ul ol dl main body html blockquote nav aside header footer form tbody thead tfoot figure details".split())
_LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary address tr tbody thead tfoot table ul ol dl figure".split())
#: Share of the best path's fused ratio that content needs.
SHARE = 0.3
#: What a path keeps of the ratio of the one before or after it in its container.
SMOOTHING = 0.9
#: How much more a path inside an article or main element counts, and how much less one below a doubtful class or id.
INSIDE, DOUBT = 2, 0.5
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}


def doubt(name: str, attributes: str, inside: bool) -> float:
    """Weight of an element: 0 if it is no running text by its name or a whole class, id or role, ``DOUBT`` if one of
    these only mentions such a word, else 1.  A header inside an article is text."""
    if name in _BOILER_TAG and not (name == "header" and inside):
        return 0
    if not attributes:
        return 1
    if _HIDDEN.search(attributes):
        return 0
    if name in ("body", "html", "article", "main"):
        return 1
    weight = 1.0
    for m in _CLASS.finditer(attributes):
        for token in "".join(x or "" for x in m.groups()).lower().split():
            words = {w for w in _WORD.findall(token) if not w.isdigit()}
            named = words & _BOILER_WORD
            if not named:
                continue
            if words <= _BOILER_WORD | _NEUTRAL_WORD and not (inside and named <= _UNSURE_WORD):
                return 0
            weight = DOUBT
    return weight


def marks(attributes: str) -> str:
    """Classes and id of an element, as they stand in its path."""
    found = ["".join(x or "" for x in m.groups()) for m in _CLASS.finditer(attributes)] if attributes else []
    return "".join("." + "-".join(x.replace("/", "-").split()) for x in found)


def text_blocks(page: str) -> list[tuple[str, str, int, float]]:
    """Path, text, characters in links and weight of each block outside boilerplate, in page order."""
    out: list[tuple[str, str, int, float]] = []
    stack: list[tuple[str, float, str]] = []  # block elements: name, weight, path part
    text: list[str] = []
    links = link_depth = boiler = article = 0

    def flush() -> None:
        nonlocal links
        if text:
            value = " ".join("".join(text).split())
            if value and not boiler:
                path = "/".join(part for _, _, part in stack)
                out.append((path, value, min(links, len(value)), min((w for _, w, _ in stack), default=1)))
            text.clear()
        links = 0

    def pop() -> None:
        nonlocal boiler, article
        name, own, _ = stack.pop()
        boiler -= not own
        article -= name in ("article", "main")

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else end
        if begin > at and not boiler:
            piece = html.unescape(page[at:begin]) if "&" in page[at:begin] else page[at:begin]
            text.append(piece)
            if link_depth:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1))
        if name in _INLINE:
            if name == "a":
                link_depth = 0 if closing else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name in ("img", "input", "embed"):
                text.append(" ")
            continue
        if name in _RAW:
            if not closing:
                close = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        flush()
        link_depth = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
            continue
        shut = _SIBLINGS.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in shut:
                while len(stack) > k:
                    pop()
                break
            if stack[k][0] in _SCOPE:
                break
        attributes = m.group(3) or ""
        own = doubt(name, attributes, article > 0)
        stack.append((name, own, name if name in _LEAF else name + marks(attributes)))
        boiler += not own
        article += name in ("article", "main")
    flush()
    return out


def container(path: str) -> str:
    """The path down to its article or main element, or else without the elements that only hold a paragraph or cell."""
    parts = path.split("/")
    for k, part in enumerate(parts):
        if part.split(".")[0] in ("article", "main"):
            return "/".join(parts[: k + 1])
    while parts and parts[-1] in _LEAF:
        parts.pop()
    return "/".join(parts)


def smoothed(ratios: list[float], places: list[str]) -> list[float]:
    """Each ratio, or what it keeps of its neighbours' in the same container, whichever is larger."""
    out = list(ratios)
    for order in (range(1, len(out)), range(len(out) - 2, -1, -1)):
        for i in order:
            beside = i - order.step
            if places[beside] == places[i]:
                out[i] = max(out[i], SMOOTHING * out[beside])
    return out


def path_ratios(blocks: list[tuple[str, str, int, float]]) -> dict[str, float]:
    """The fused ratio of each tag path."""
    paths: dict[str, list[float]] = {}  # text outside links, punctuation, blocks, text in links, weight
    for path, text, links, weight in blocks:
        sums = paths.setdefault(path, [0, 0, 0, 0, 1.0])
        sums[0] += len(text) - links
        sums[1] += sum(unicodedata.category(c)[0] == "P" for c in text)
        sums[2] += 1
        sums[3] += links
        sums[4] = min(sums[4], weight)
    places = [container(p) for p in paths]
    smooth = smoothed([x[0] / x[2] for x in paths.values()], places)
    out: dict[str, float] = {}
    following = 0.0  # best ratio up to the next heading
    for path, place, value in zip(reversed(paths), reversed(places), reversed(smooth), strict=True):
        length, points, _, links, weight = paths[path]
        inside = place.split("/")[-1].split(".")[0] in ("article", "main")
        value *= (1 + points / max(1, length)) * length / max(1, length + links) * weight * (INSIDE if inside else 1)
        if path.split("/")[-1] in _HEADING:
            value, following = max(value, following), 0.0
        else:
            following = max(value, following)
        out[path] = value
    return out


def main_text(page: str | None) -> str:
    """Blocks of the content paths, joined by two line feeds."""
    blocks = text_blocks(page) if page else []
    ratios = path_ratios(blocks)
    best = max(ratios.values(), default=0)
    return "\n\n".join(text for path, text, _, _ in blocks if ratios[path] > 0 and ratios[path] >= SHARE * best)


def extract_text(pages: DataFrame, page: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns, ``text`` and ``n_chars`` (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                text = [main_text(x) for x in part.column(0).to_pylist()]
                columns = [*part.columns[1:], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
                yield pa.record_batch(columns, [*carry, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carry).schema)
    return pages.select(F.col(page).alias("html"), *carry).mapInArrow(run, f"{kinds}, text string, n_chars long")
