"""HTML extraction by line-block distribution.

Markup is stripped to lines: a line per block of text, with scripts, styles, forms and the
boilerplate containers (menus, headers, footers, sidebars, notices, adverts, comments) left as
empty lines. The text lengths of each line (less its link text) are summed over sliding windows
of ``WINDOW`` lines. Text surges where such a sum reaches ``SURGE``, or ``SHARE`` of the page's
largest sum if that is less, and dives where it falls to nothing; every line between the two
points is main text, links too, and so are the lines with a length that lead up to a surge.
A word of class, id or role marks boilerplate, but never an element that holds the article or, on
pages without one, most of the text. Marks of the main part (article, main) are a weight only: lines in it count ``WEIGHT`` times,
link text in it half, and none for nothing, so that text doesn't dive there.

Defined results: null html and pages without main text give the empty string; unclosed and
cut-off markup is read as far as it goes (an element to drop that is never closed is its start
tag alone, only scripts and the like run to the end); repeated rows are extracted one by one; an empty
table gives an empty result; ids are whole numbers or text that is one (other ids are an error);
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_arrow

WINDOW = 3
SURGE = 80
SHARE, WEIGHT = 0.5, 2

#: Elements by what they do to the text.
RAW = "script style textarea title".split()
DROPPED = "noscript template select option svg iframe object canvas head math audio video map datalist".split()
BOILER = "nav footer aside form button menu dialog fieldset label input legend".split()
MAIN = "article main".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br""".split()
#: Words of class, id and role that mark boilerplate.
BOILER_WORDS = """ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion
nav navbar navigation menu menus breadcrumb breadcrumbs toolbar sidebar sidebars side-bar aside widget widgets header masthead footer
cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search
comment comments commentlist disqus reply replies respond share sharing social related recommended pagination pager copyright legal
complementary contentinfo""".split()

#: Marks of what readers add, marks of headings, and words before a mark that tell of a page and mark nothing.
OTHERS = "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter".split()
HEADINGS = "header masthead".split()
TELLING = "no has with without not show hide is single".split()
#: Shares of a page's text from which a marked element is its main part where the page has no article or main; the greater for marks of readers' texts.
MOSTLY, SURELY = 0.5, 0.9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_BOILER_WORDS, _BLOCK, _VOID, _MAIN, _BOILER, _DROPPED, _OTHERS, _HEADINGS, _TELLING = map(frozenset, (BOILER_WORDS, BLOCK, VOID, MAIN, BOILER, DROPPED, OTHERS, HEADINGS, TELLING))
#: Elements that an opening block closes if it is still open, as browsers do.
_SELF_CLOSED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))


def _marks(attrs: str) -> set[str]:
    """The words of class, id and role that mark boilerplate; a name that denies one or tells what a page has is none."""
    if "hidden" in attrs.split():
        return {"hidden"}
    found = set()
    for mark in _MARK.finditer(attrs):
        for word in re.split(r"[\s_]+", (mark[1] or mark[2] or mark[3] or "").lower()):
            parts = word.split("-")
            if word in _BOILER_WORDS:
                found.add(word)
            elif parts[0] not in _TELLING:
                found |= _BOILER_WORDS.intersection(parts)
    return found


def _elements(tokens: list[re.Match], html: str) -> tuple[dict[int, int], set[int]]:
    """Where elements to drop start (as token numbers) and end, those that are closed before what they stand in;
    and the starts of elements that are main although a word marks them: they hold an article or main,
    or most of the page's text."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    spans: dict[int, int] = {}
    upto, text, at = [], 0, 0  # characters of text before each token
    holds = [0]  # article and main elements that begin before each token
    for k, token in enumerate(tokens):
        text += len(html[at : token.start()].strip())
        at = token.end()
        upto.append(text)
        name = (token["name"] or "").lower()
        opens = bool(name) and not token["close"] and name not in _VOID
        holds.append(holds[-1] + (opens and name in _MAIN and not (token["attrs"] and _marks(token["attrs"]))))
        if not name or name in _VOID:
            continue
        if token["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in _DROPPED:
                        ends[stack[depth][1]] = k
                    spans.update((start, k) for _, start in stack[depth:])
                    del stack[depth:]
                    break
        elif not (name in ("svg", "math") and token["attrs"].rstrip().endswith("/")):
            if name == "body" and stack and stack[-1][0] == "head":
                stack.pop()
            stack.append((name, k))
    text += len(html[at:].strip())
    main = set()
    spans.update((start, len(tokens)) for _, start in stack)
    upto.append(text)
    for start, end in spans.items():
        attrs = tokens[start]["attrs"]
        if attrs and (marks := _marks(attrs)):
            inside = upto[end] - upto[start]
            least = SURELY if marks & _OTHERS else MOSTLY
            if marks != {"hidden"} and (holds[end] > holds[start + 1] or (not holds[-1] and inside >= least * text)):
                main.add(start)
    return ends, main


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters of link text, in the main part) per block; boilerplate is an empty text."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether their text is boilerplate
    parts: list[str] = []
    links = mains = anchors = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                off = bool(stack) and stack[-1][1]
                lines.append(("" if off else text, 0 if off else min(links, len(text)), mains > 0))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal mains, anchors
        while len(stack) > depth:
            name, off = stack.pop()
            mains -= name in _MAIN and not off
            anchors -= name == "a"

    at = past = 0
    tokens = list(_TOKEN.finditer(html))
    ends, main = _elements(tokens, html)
    for k, found in enumerate(tokens):
        if k < past:
            continue
        if found.start() > at:
            parts.append(html[at : found.start()])
            if anchors:
                links += found.start() - at
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if name in _DROPPED:
            if k in ends:
                past, at = ends[k] + 1, tokens[ends[k]].end()
            elif name == "option" and not found["close"]:
                at = tokens[k + 1].start() if k + 1 < len(tokens) else len(html)
            continue
        if name in _BLOCK:
            flush()
        if found["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
        elif name not in _VOID and not found["attrs"].rstrip().endswith("/"):
            if name in _BLOCK:
                # An open paragraph, item or cell ends here, up to the container it stands in.
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in _SELF_CLOSED and (stack[depth][0] == "p" or stack[depth][0] == name):
                        close(depth)
                        break
                    if stack[depth][0] in _BLOCK:
                        break
            off = (bool(stack) and stack[-1][1]) or name in _BOILER or (name == "header" and not mains)
            if not off and found["attrs"] and name not in ("body", "html", "main") and k not in main:
                # The heading of the main part is part of it.
                off = bool(_marks(found["attrs"]) - (_HEADINGS if mains else frozenset()))
            stack.append((name, off))
            mains += name in _MAIN and not off
            anchors += name == "a"
    if at < len(html):
        parts.append(html[at:])
    flush()
    return lines


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surge and dive points, joined by line breaks."""
    lines = lines_of(html)
    lengths = [max(1, WEIGHT * len(t) - links) if m else max(0, len(t) - 2 * links) for t, links, m in lines]
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    least = min(surge, SHARE * max(sums, default=0))
    kept, inside, dive = [], False, 0
    for k, (text, _, _) in enumerate(lines):
        if not inside and lengths[k] and sums[k] >= least:
            inside, start = True, k
            while start > dive and lengths[start - 1]:
                start -= 1
            kept += [t for t, _, _ in lines[start:k] if t]
        elif inside and not sums[k]:
            inside, dive = False, k
        if inside and text:
            kept.append(text)
    return "\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        counts = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return in_arrow(given, _extracted, "page_id long, url string, text string, n_chars long")
