r"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block-level tags from
the root to it.  Per path, the text's length and punctuation are summed and
divided by the number of blocks; both ratios are smoothed over neighbouring
paths in page order and fused into one score.  What a path's tags and names say
is a feature of that score, a weight: each element that as a rule holds no
article text (a menu, a footer, comments, an advert, by tag, class, id or role)
takes off a part that depends on how sure the sign is.  Paths whose weighted
score passes a threshold hold the content nodes, so a name that is only part of
what it seems to say can't drop a paragraph that reads like the article.

The content nodes choose the article: the innermost element for which the text
of its content nodes, less that of its menus, adverts and the like and of its
links, is greatest; or the article or main element around that one.  All its
content nodes are returned, and so are headings and short lines beside them
that no sign speaks against; in an article that no tag names,
so are parts without a content node that are links for the most part.

Defined cases: null or empty html gives an empty text; markup that is cut off,
unknown character references and stray end tags are read as browsers do, and
raw text ends at its end tag only; long and deeply nested pages are read as a
whole, in time and memory that grow with their length; repeated rows are each
extracted; a null page_id or url stays null; other columns don't matter; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import lean, text_batches

#: Tags that end a block, tags without content, and tags whose content is no article text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
FOREIGN = frozenset(("svg", "math"))  # these may close themselves
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
NEVER = frozenset("head nav footer aside form menu button select dialog object canvas audio video".split())
#: What is left of a path's score: in elements of these tags, or hidden ones; in those whose name is made of ASIDE's words; in those of whose name one of SURE's words is a part; in those of whose name another of ASIDE's is.
TAGGED, NAMED, PARTLY, HINTED = 0.01, 0.02, 0.05, 0.5
#: An open element of the second set ends when a tag of the first opens.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body html blockquote select td th main".split())
#: Elements that hold others; a word of a name says what such a one is, while a line of text is beside the article only if its whole name says so.
HOLDERS = frozenset("address article aside body center details dialog dir div dl fieldset figure footer form header hgroup html main menu nav ol section summary table tbody td tfoot thead tr ul".split())
#: Words in class, id or role that name a part beside the article.
ASIDE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe signup login comment comments commentlist disqus respond replies reply pagination pager search skip copyright complementary contentinfo advertorial outbrain taboola toc tags disclaimer".split())

#: Those of them that leave little doubt even as a part of a name.
SURE = frozenset("ad ads advert adverts advertisement advertising adsense sponsored promo cookie cookies consent gdpr alert popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars widget footer masthead topbar newsletter subscribe signup login comment comments commentlist disqus respond replies pagination pager copyright contentinfo advertorial outbrain taboola disclaimer".split())

PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·।؟،]")
SPACE = re.compile(r"\s+")
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?", re.S)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[a-z]+")
#: The threshold on the fused score, as a part of its mean over the text.
THRESHOLD = 0.35
#: Elements that can be the article.
WIDE = frozenset(("", "html", "body", "article", "main", "section", "div", "td"))


def _weight(tag: str, attributes: str) -> float:
    """What class, id, role and style leave of the score of an element's text."""
    least = 1.0
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return TAGGED
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return TAGGED
        elif name in ("class", "id", "role"):
            for own in map(WORDS.findall, value.split()):
                if own and ASIDE.issuperset(own):
                    least = min(least, NAMED)
                elif tag in HOLDERS and not SURE.isdisjoint(own):
                    least = min(least, PARTLY)
                elif tag in HOLDERS and not ASIDE.isdisjoint(own):
                    least = min(least, HINTED)
    return least


class Page:
    """blocks in page order: (path, node of the innermost block element, text, characters in links); nodes: (parent, tag); weights, by path.

    Of each tag, and of the scopes, the places of open elements on the stack are
    kept, so an end tag finds its element at once.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, int, str, int]] = []
        self.weights: list[float] = [1.0]
        self.numbers: dict[tuple[int, str, float], int] = {}
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, node, path, in an article
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.pieces: list[str] = []
        self.in_link = self.linked = 0
        at, end = 0, len(html)
        while at < end:
            m = MARKUP.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                self.in_link = not closing
            if closing:
                self.close(tag)
            elif tag in RAW:
                if not (tag in FOREIGN and attributes.rstrip().endswith("/")):
                    over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                    at = over.end() if over else end
            else:
                self.open(tag, attributes)
        self.flush()

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        if self.in_link:
            self.linked += len(piece.strip())

    def flush(self) -> None:
        if self.pieces:
            text = SPACE.sub(" ", entities.unescape("".join(self.pieces))).strip()
            if text:
                self.blocks.append((self.stack[-1][2], self.stack[-1][1], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        for tag, *_ in self.stack[k:]:
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
        del self.stack[k:]

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag not in BLOCKS and tag not in NEVER:
            if tag not in VOID and attributes and (weight := _weight(tag, attributes)) < 1:
                self.push(tag, weight)
            return
        self.flush()
        if tag in CLOSES_P:
            self.end({"p"})
        if tag in ENDS:
            self.end(ENDS[tag])
        if tag not in VOID:
            self.push(tag, _weight(tag, attributes) if attributes else 1.0)

    def push(self, tag: str, weight: float) -> None:
        self.flush()
        _, parent, path, inside = self.stack[-1]
        named = tag in ("article", "main")
        if named or tag in ("html", "body"):  # their names say more of the page than of its parts
            weight = 1.0
        if tag in NEVER or tag == "header" and not inside:
            weight = min(weight, TAGGED)
        weight = max(weight * self.weights[path], 1e-6)
        number = self.numbers.setdefault((path, tag, weight), len(self.weights))
        if number == len(self.weights):
            self.weights.append(weight)
        self.nodes.append((parent, tag))
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, len(self.nodes) - 1, number, inside or named))

    def end(self, tags: set[str]) -> None:
        """End the innermost open element of these tags, if no element of another scope is inside."""
        k = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if k and k >= (self.scopes[-1] if self.scopes else 0):
            self.pop_to(k)

    def close(self, tag: str) -> None:
        if self.places.get(tag):
            self.flush()
            self.pop_to(self.places[tag][-1])
        elif tag in BLOCKS:
            self.flush()


def smooth(values: list[float], weights: list[float]) -> list[float]:
    """Weights 1, 2, 1 over neighbouring paths, each times its own weight."""
    n, out = len(values), []
    for i in range(n):
        near = [(max(i - 1, 0), 1), (i, 2), (min(i + 1, n - 1), 1)]
        out.append(sum(k * weights[j] * values[j] for j, k in near) / sum(k * weights[j] for j, k in near))
    return out


def content_paths(blocks: list[tuple], weights=None) -> set:
    """Paths whose fused ratio, times their weight, passes the threshold: a part of the mean over the text, in which a path counts by its weight."""
    sums: dict = {}
    for path, _, text, *_ in blocks:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(PUNCTUATION.findall(text))
    if not sums:
        return set()
    of = [1.0 if weights is None else weights[path] for path in sums]
    lengths = [s[1] / s[0] for s in sums.values()]
    marks = [s[2] / s[0] for s in sums.values()]
    own = [a * (1 + b) for a, b in zip(lengths, marks)]
    fused = [(x * a * (1 + b)) ** 0.5 for x, a, b in zip(own, smooth(lengths, of), smooth(marks, of))]
    mean = sum(f * w * s[1] for f, w, s in zip(fused, of, sums.values())) / sum(w * s[1] for w, s in zip(of, sums.values()))
    return {path for path, f, w in zip(sums, fused, of) if f * w >= THRESHOLD * mean}


def _up(own: list[int], nodes: list[tuple[int, str]]) -> list[int]:
    """Sums over each node and all below it; parents come before their children."""
    out = list(own)
    for node in range(len(nodes) - 1, 0, -1):
        out[nodes[node][0]] += out[node]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    nodes, against = page.nodes, {path for path, weight in enumerate(page.weights) if weight < 1}
    paths = content_paths(page.blocks, page.weights)
    content, gain, links, size = ([0] * len(nodes) for _ in range(4))
    for path, node, text, linked in page.blocks:
        size[node] += len(text)
        links[node] += linked
        content[node] += len(text) * (path in paths)
        gain[node] += len(text) if path in paths else -len(text) if path in against else -linked
    content, gain, links, size = (_up(x, nodes) for x in (content, gain, links, size))
    around = [k for k, (_, tag) in enumerate(nodes) if tag in WIDE and content[k]]
    if not around:
        return ""
    article = max(around, key=lambda k: (gain[k], k))
    named, up = False, article
    while up >= 0 and not named:
        named = nodes[up][1] in ("article", "main")
        article, up = (up if named else article), nodes[up][0]
    inside, kept = [False] * len(nodes), []
    for node, (parent, _) in enumerate(nodes):
        menu = not named and not content[node] and 2 * links[node] > size[node]
        inside[node] = node == article or parent >= 0 and inside[parent] and not menu
    for path, node, text, _ in page.blocks:
        if inside[node] and (path in paths or path not in against):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    text_batches(pages.sparkSession)
    return rows.mapInArrow(lean(run), f"page_id {kinds['page_id']}, url string, text string, n_chars long")
