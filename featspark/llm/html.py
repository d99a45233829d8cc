"""Main text of HTML pages by tree scoring.

A tolerant scanner builds the tree of block elements. Navigation, adverts, forms, comments and the
like are cut by tag, role, class or id. Each remaining block of text earns points for its length and
commas, less its share of link text, and passes them to its ancestors in falling parts. The element
with most points, discounted by its own link density, is the container, widened to the article or main
element around it if there is one; siblings that are not mostly links are kept with it. Time is linear
in the page, whatever its tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
CUT = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head header iframe input map math menu meter nav "
    "noembed noframes noscript object optgroup option output progress script search select style svg template textarea title video".split())
CUT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox status "
    "tablist toolbar tooltip".split())
CUT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promoted promotion related recommended replies reply respond share sharing sidebar signup social "
    "sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
NEVER_CUT = frozenset("html body article main".split())
CONTAINERS = frozenset("article body center div html main section td".split())
#: A start tag of the key closes an open element of the value, up to an element of SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
SCOPE = frozenset("ul ol dl table select article section div body html main td th".split())
SHUT = frozenset().union(*CLOSES.values())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)", re.S)
#: What may be left after the last ``>``: a comment or the like that never ends.
COMMENT = re.compile(r"<(?:!--|[!?/]).*", re.S)
#: The slash of an empty element, not the end of an unquoted value.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
MARKED = re.compile(r"class|id|role|hidden|style", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A class that says what stands beside an element or not, as in ``has-sidebar``.
STATE = re.compile(r"(?:has|with|without|no)[-_]", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_cut(tag: str, attrs: str) -> bool:
    if tag in CUT:
        return True
    if not attrs or not MARKED.search(attrs):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and INVISIBLE.search(value):
            return True
        if tag in NEVER_CUT:
            continue
        if name == "role" and value.lower() in CUT_ROLES:
            return True
        if name in ("class", "id") and any(w.lower() in CUT_WORDS for token in value.split() if not STATE.match(token) for w in WORDS.findall(token)):
            return True
    return False


class _Tree:
    """Nodes by number; blocks of text in page order as (node, text, length of link text)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.blocks = [-1], ["#root"], []
        # tag, block node, cut, in a link, place of the nearest block, place of the nearest element of SCOPE or SHUT
        stack: list[tuple[str, int, bool, bool, int, int]] = [("#root", 0, False, False, 0, 0)]
        open_tags: dict[str, int] = {}
        last = html.rfind(">")
        parts: list[str] = []
        linked = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                if text := " ".join("".join(parts).split()):
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def text_to(end: int) -> None:
            nonlocal linked
            if end > at and not stack[-1][2]:
                piece = html[at:end]
                if "&" in piece:
                    piece = unescape(piece)
                parts.append(piece)
                if stack[-1][3]:
                    linked += len(piece.strip())

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][0] in BLOCK:
                    flush()
                open_tags[stack.pop()[0]] -= 1

        while m := TOKEN.search(html, at, last + 1) or COMMENT.search(html, at):
            text_to(m.start())
            at = m.end()
            if m.re is COMMENT or m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)  # a comment that never ends
                break
            end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
            if not tag:
                continue
            tag = tag.lower()
            if end:
                if open_tags.get(tag):
                    close_to(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag))
                continue
            if tag in VOID:
                if not stack[-1][2]:
                    parts.append(" ") if tag == "br" else flush() if tag == "hr" else None
                continue
            if tag in BLOCK:
                flush()
                if stack[-1][0] == "head":
                    close_to(len(stack) - 1)
                if stack[stack[-1][4]][0] == "p":
                    close_to(stack[-1][4])
                if shut := CLOSES.get(tag):
                    depth = stack[-1][5]
                    while depth > 0 and stack[depth][0] not in shut and stack[depth][0] not in SCOPE:
                        depth = stack[depth - 1][5]
                    if depth > 0 and stack[depth][0] in shut:
                        close_to(depth)
            cut = stack[-1][2] or _is_cut(tag, attrs)
            if tag in RAW:
                shut_at = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = shut_at.end() if shut_at else len(html)
                continue
            if tag in BLOCK:
                self.parent.append(stack[-1][1])
                self.tag.append(tag)
                node = len(self.tag) - 1
            else:
                node = stack[-1][1]
            if tag in BLOCK or not SELF_CLOSED.search(attrs):
                here = len(stack)
                stack.append((tag, node, cut, stack[-1][3] or tag == "a", here if tag in BLOCK else stack[-1][4], here if tag in SCOPE or tag in SHUT else stack[-1][5]))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        text_to(len(html))
        flush()


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, one space between and for any white space inside."""
    if not html:
        return ""
    tree = _Tree(html)
    if not tree.blocks:
        return ""
    n = len(tree.tag)
    score, length, links = [0.0] * n, [0] * n, [0] * n
    for node, text, linked in tree.blocks:
        length[node] += len(text)
        links[node] += linked
        up = node if tree.tag[node] in CONTAINERS else tree.parent[node]
        score[up] += (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / len(text))
    for i in range(n - 1, 0, -1):  # children come after parents
        up = tree.parent[i]
        score[up] += score[i] / 2
        length[up] += length[i]
        links[up] += links[i]
    density = [links[i] / length[i] if length[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (score[i] * (1 - density[i]), -i))
    for wanted in ("article", "main"):
        up = best
        while up > 0 and tree.tag[up] != wanted:
            up = tree.parent[up]
        if up > 0:
            best = up
            break
    kept = {best}
    if best and tree.tag[best] not in ("main", "body", "html"):
        kept.update(i for i in range(n) if tree.parent[i] == tree.parent[best] and length[i] and density[i] < 0.5)
    inside = [False] * n
    for i in range(n):  # parents come before children
        p = tree.parent[i]
        menu = tree.tag[i] in ("ul", "ol", "div", "section", "table") and density[i] > 0.8
        inside[i] = i in kept or p >= 0 and inside[p] and not menu
    return " ".join(text for node, text, _ in tree.blocks if inside[node])


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row for each row of ``pages``: the columns ``keep``, text and n_chars (code points).

    Null or empty html, and pages without an article, have an empty text. Pages of any length are read
    whole; repeated rows give repeated results; other columns are ignored, whatever their names.
    """
    fields = [pages.schema[k] for k in keep]
    rows = pages.select(*[F.col(k) for k in keep], F.col(html_col).cast("string"))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
