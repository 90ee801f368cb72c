"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  A block knows where it stands (in an
article, in the plain body, or in an area that is never main text, such as menus,
footers, adverts and comments), its words, the stop words among them and the share
of its characters inside links.  The first pass decides what these tell clearly:
areas and link lists are bad, long blocks rich in stop words are good.  All others
are ambiguous; in the second pass they take the label of the nearest decided block of
the same section.  Where a section has none, an article is good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import query, table

#: A block with more of its characters in links is bad.
LINKS = 0.5
#: A block of that many words and that share of stop words is good.
LONG, STOPS = 10, 0.15
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son lui nous comme mais elle y sa aux cette été même ces ses leur"
    " el los las del y por con para su lo al más o pero sus este ya entre cuando todo esta ser son también fue había era muy hasta desde está mi sin sobre".split()
)
# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
AREAS = frozenset("nav footer aside form button select dialog menu head fieldset datalist".split())
ARTICLES = frozenset("article main".split())
SECTIONS = frozenset("section div td".split())
#: These end an open paragraph.
CLOSING = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Words of a class, id or role that mark an area.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr legal masthead menu menubar nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promoted promotion related respond search share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|\Z)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOKEN = re.compile(r"[A-Za-z]+")
BAD, GOOD, OPEN = "bad", "good", "ambiguous"


def _marked(tag: str) -> bool:
    """Whether the attributes of a tag mark an area, or hide it."""
    for name, value in ATTRIBUTE.findall(tag):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return True
        if name in ("class", "id", "role") and any(t.lower() in MARKS for t in TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))):
            return True
    return False


def blocks(html: str) -> list[tuple[str, float, bool, bool, int]]:
    """Blocks in page order: text, share of characters in links, in an area, in an article, section."""
    out, text, linked, links, chars = [], [], 0, 0, 0
    stack: list[tuple[str, bool, bool, int]] = []  # open elements with: area, article, section
    state, sections, skip = (False, False, 0), 0, None

    def flush():
        nonlocal text, links, chars
        body = " ".join("".join(text).split())
        if body:
            out.append((body, links / max(chars, 1), *state))
        text, links, chars = [], 0, 0

    def drop(to: int):
        """Close the open elements from number ``to`` on."""
        nonlocal state, linked
        if any(e[0] not in INLINE for e in stack[to:]):
            flush()
        linked -= sum(e[0] == "a" for e in stack[to:])
        state = stack[to][1:]
        del stack[to:]

    for m in PIECES.finditer(html):
        piece = m.group()
        if piece[0] != "<" or piece == "<":
            if skip is None:
                decoded = unescape(piece)
                size = len("".join(decoded.split()))
                text.append(decoded)
                chars += size
                links += size if linked else 0
            continue
        if piece[1] in "!?":
            continue
        name = NAME.match(piece).group(1).lower()
        if skip is not None:
            if piece[1] == "/" and name == skip:
                skip = None
            continue
        if piece[1] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None and not (name in INLINE and any(e[0] not in INLINE for e in stack[at:])):
                drop(at)
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            skip = None if piece.endswith("/>") and name in ("svg", "math") else name
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in CLOSING or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {name} if name not in CLOSING else {"p"}
            stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}.get(name, tuple(AREAS | ARTICLES | SECTIONS))
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in same or stack[i][0] in stop), None)
            if at is not None and stack[at][0] in same:
                drop(at)
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        area, article, section = state
        stack.append((name, area, article, section))
        linked += name == "a"
        # A header is one of the page unless it stands in an article.
        area = area or name in AREAS or (name == "header" and not article) or (name not in ("html", "body") and _marked(piece))
        if name in ARTICLES or name in SECTIONS or area != state[0]:
            sections += 1
            section = sections if name in ARTICLES or area != state[0] or not article else section
        state = (area, article or name in ARTICLES, section)
    flush()
    return out


def first_pass(text: str, links: float, area: bool, article: bool) -> str:
    """Good, bad or ambiguous, by the block alone."""
    if area or links > LINKS:
        return BAD
    tokens = text.lower().split()
    stops = sum(t.strip(".,;:!?\"'()%*#$&") in STOP_WORDS for t in tokens)
    if len(tokens) >= LONG and stops >= STOPS * len(tokens):
        return GOOD
    return OPEN


def second_pass(labels: list[str], sections: list[int], articles: list[bool]) -> list[bool]:
    """Whether each block is kept: ambiguous ones follow the nearest decided block of their section.

    At equal distances the bad one wins.  In an article only two bad ones, one on either
    side, make a block bad.  Without any, blocks of an article are kept, and others
    where the page has no article.
    """
    n, some_article = len(labels), any(articles)
    nearest: list[list[tuple[int, str] | None]] = [[None, None] for _ in range(n)]
    for side, order in enumerate((range(n), range(n - 1, -1, -1))):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            if labels[i] != OPEN:
                last[sections[i]] = (i, labels[i])
            nearest[i][side] = last.get(sections[i])
    kept = []
    for i in range(n):
        near = sorted((abs(i - x[0]), x[1] == GOOD) for x in nearest[i] if x)
        if labels[i] != OPEN:
            kept.append(labels[i] == GOOD)
        elif articles[i]:
            kept.append(len(near) < 2 or any(good for _, good in near))
        elif near:
            kept.append(near[0][1])
        else:
            kept.append(not some_article)
    return kept


def main_text(html: str | None) -> tuple[str, int, int]:
    """Main text of a page, its blocks and how many of them it has."""
    found = blocks(html or "")
    labels = [first_pass(*b[:4]) for b in found]
    kept = second_pass(labels, [b[4] for b in found], [b[3] for b in found])
    return " ".join(b[0] for b, k in zip(found, kept) if k), len(found), sum(kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to ``keep`` with ``text``, ``n_chars``, ``n_blocks`` and ``n_kept`` of every page.

    White space inside a block is one space, blocks are joined by one space.  A null
    or empty page, or one without main text, has an empty text; repeated rows stay.
    """
    chosen = pages.select(F.col(html).cast("string").alias("_html"), *keep)
    names = [f"c{i}" for i in range(len(keep))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                done = [main_text(part.column(0)[i].as_py()) for i in range(part.num_rows)]
                texts, n, kept = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())],
                    [*names, "text", "n_chars", "n_blocks", "n_kept"],
                )

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, chosen.schema.fields[1:]))
    done = chosen.toDF("_html", *names).mapInArrow(rows, f"{schema}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
    return done.toDF(*keep, "text", "n_chars", "n_blocks", "n_kept")


@query("op11_html_text", r"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM cut
), decoded AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&amp;?', '&', 'g') AS t FROM plain
), done AS (
  SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM decoded
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM done
""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return extract(table(spark, d, "pages")).drop("n_blocks", "n_kept")
