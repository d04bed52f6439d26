"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block element. A line's weight is the length of its text
outside links; text of menus, forms, adverts, scripts and the like weighs nothing. Weights are summed over
sliding windows of lines; where a window is silent the page is parted, and an article is a part. The
text runs from the first part that surges to the last one after which the page dives, by the page's own
figures: a run of lines surges with SURGE characters or half of the longest part, an article with a quarter of
it. Markup only weighs: where a page names its article (article, main), text outside counts a quarter, and
surges only with half of the longest part then; links inside count in full. So a short article beside
a long text doesn't win, and cards, teasers and comments in articles of their own don't either. Between the
two points every line with weight is kept, but for text outside of a named article. At the
edges of text that no article holds, lines of mere boxes that are far below the page's peak go if they
are no sentence, or a copyright line.

Null or empty html: empty text. Repeated rows: a result row each. Empty table: empty. Broken markup
(unclosed tags, a cut end) never fails; an unclosed menu ends where the article begins.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import text_slices, workers_ready

WINDOW = 3
#: Characters with which a run of lines surges; on pages of shorter parts, half the longest one's.
SURGE = 120
ARTICLE, RUN, OUTSIDE = "article", "run", "outside"
# Element names.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option optgroup p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
SILENT = frozenset("nav footer aside form noscript button select textarea template iframe svg menu dialog object canvas audio video head datalist".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that mark what isn't the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices banner alert popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe signup login search widget pagination pager skip toolbar complementary contentinfo".split())
# Words that name a box without telling what is in it.
BOXES = frozenset("area bar bars block body bottom box button buttons column container content fixed form global group header holder icons inner item items js left link links list main module outer page panel post posts primary region right row secondary section site slot small sticky stories story text thread title top unit wrap wrapper zone".split())
# Elements whose lines are text of their own, not just boxes.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption summary address".split())
TITLE = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*(?:title|heading|headline)", re.I)
RIGHTS = re.compile(r"©|\(c\)|^copyright\b|all rights reserved", re.I)
SENTENCE_ENDS = ".!?…:;\"'”’»)"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*?)(/?)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked(attributes: str) -> bool:
    """Whether a class, an id or the role tells of something else than text: by its whole name, or by a
    compound of nothing but such words and words for boxes ("ad-slot", but not "side-effects")."""
    if "=" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in PARTS.findall(name)]
            if name.lower() in MARKS or (any(x in MARKS for x in parts) and all(x in MARKS or x in BOXES for x in parts)):
                return True
    return False


@dataclass
class Line:
    """A block's text, its weight, the article and the main element around it (0: none), and whether its
    element is one for text (a paragraph, a heading, a list item) and not just a box."""

    text: str
    weight: int
    article: int
    main: int
    prose: bool


def lines(page: str, roles: bool = True) -> list[Line]:
    """The page's blocks. roles: heed class names, ids and roles."""
    out: list[Line] = []
    parts: list[str] = []
    linked = depth = 0
    silent = ""  # the element whose text counts for nothing, and how deep it is nested in its like
    link = prose = False
    depths, numbers = {"article": 0, "main": 0}, {"article": 0, "main": 0}
    inside = lambda: depths["article"] or depths["main"]

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            now = [numbers[x] if depths[x] else 0 for x in ("article", "main")]
            out.append(Line(text, 0 if silent else max(0, len(text) - linked), *now, prose))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link and not inside():
                linked += len(text.strip())

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            say(m[1])
            continue
        name = (m[3] or m[7] or "").lower()
        if not name:
            continue
        ending, attributes = bool(m[2] or m[6]), m[4] or m[8] or ""
        if name in RAW and not ending:
            end = re.compile(rf"</{name}[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            link = not ending
        if name in BLOCKS or name in SILENT:
            close()
            if name != "br":
                prose = not ending and (name in PROSE or (not prose and bool(TITLE.search(attributes))))
        if name in depths:
            if ending:
                depths[name] = max(0, depths[name] - 1)
            else:
                silent = silent if inside() else ""
                depths[name] += 1
                numbers[name] += depths[name] == 1
            continue
        if name in VOID:
            continue
        if silent:
            if name == silent:
                depth += -1 if ending else 1
                if depth == 0:
                    close()
                    silent = ""
        elif not ending and not m[5] and (name in SILENT or (name == "header" and not inside()) or (roles and name not in ("body", "html") and _marked(attributes))):
            close()
            silent, depth = name, 1
    close()
    return out


def main_text(page: str) -> str:
    rows = lines(page)
    if rows and not any(x.weight for x in rows):  # all of it stands in elements whose names tell of something else
        rows = lines(page, roles=False)
    return " ".join(x.text for x in text_lines(rows))


def text_lines(rows: list[Line]) -> list[Line]:
    """The lines of the text: between the first and the last part of the page that surge. An article is a
    part, and so is a run of other lines whose windows are never silent. Markup only weighs: where the page
    names an article (or a main element with weight), text outside counts a quarter."""
    articles = any(x.article and x.weight for x in rows)
    named = articles or any(x.main and x.weight for x in rows)
    parts: list[list[int]] = []  # kind, number of the article, first line, last line, weight of its text
    part_of = [0] * len(rows)
    for i, x in enumerate(rows):
        if not x.weight:
            continue
        kind, number = (ARTICLE, x.article or -x.main) if x.article or (x.main and not articles) else (OUTSIDE if named and not x.main else RUN, 0)
        last = parts[-1] if parts else None
        if kind == ARTICLE:
            k = next((k for k, p in enumerate(parts) if p[:2] == [kind, number]), None)
        else:
            k = len(parts) - 1 if last and last[0] == kind and i - last[3] < WINDOW + 1 else None
        if k is None:
            parts.append([kind, number, i, i, 0])
            k = len(parts) - 1
        parts[k][3] = i
        parts[k][4] += x.weight
        part_of[i] = k
    if not parts:
        return []
    mass = [n * (1 if kind == OUTSIDE else 4) for kind, _, _, _, n in parts]
    longest = max(mass)
    least = {ARTICLE: longest / 4, RUN: min(4 * SURGE, longest / 2), OUTSIDE: longest / 2}
    surges = [m >= least[p[0]] for m, p in zip(mass, parts, strict=True)]
    first = min(p[2] for p, s in zip(parts, surges, strict=True) if s)
    end = max(p[3] for p, s in zip(parts, surges, strict=True) if s) + 1
    stays = lambda k: surges[k] or parts[k][0] == RUN
    kept = [(x, parts[k][0]) for x, k in zip(rows[first:end], part_of[first:end], strict=True) if x.weight and stays(k)]
    peak = max(sum(x.weight for x, _ in kept[i : i + WINDOW]) for i in range(len(kept)))
    while len(kept) > 1 and kept[0][1] != ARTICLE and _stray(kept[0][0], peak):
        kept.pop(0)
    while len(kept) > 1 and kept[-1][1] != ARTICLE and _stray(kept[-1][0], peak):
        kept.pop()
    return [x for x, _ in kept]


def _stray(x: Line, peak: int) -> bool:
    """A line at the text's edge that is far below the page's peak and no sentence or paragraph of it."""
    return x.weight < peak / 8 and not x.prose and (x.text[-1] not in SENTENCE_ENDS or bool(RIGHTS.search(x.text)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[str] = []
        for _, _, texts in text_slices(b, "html"):
            out += [main_text(t.decode("utf-8", "replace")) for t in texts]
        yield pa.record_batch({"page_id": b.column(0), "url": b.column(1), "text": pa.array([x.encode("utf-8", "replace").decode() for x in out], pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    workers_ready(pages.sparkSession)
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return read.mapInArrow(_extract, f"page_id {dict(read.dtypes)['page_id']}, url string, text string, n_chars long")
