"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into text blocks at block-level tags.  A block's inputs are its word count and
link density, those of the blocks before and after it, how surely a container around it names
a page part that is not the article (by element, or by words of class, id and role), whether it
stands in an article or main element or in a container named as an article's text, and
whether it is a heading.  The tree is trained with Spark ML's DecisionTreeClassifier on the small
labelled table below, whose rows are blocks of real markup read by the same parser.  Words of
class and id are evidence, not a verdict: a word that also names things in articles (related,
search, header, widget) beside other words is left to the tree, and a container around the
article's own title names nothing.  Pages are mapped over; nothing is shuffled.

Defined results: a null or empty html has the empty text; broken markup is read as far as it
goes (an unclosed comment, script or style hides the rest); character references are decoded
once; extra columns are ignored.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedyard.llm.common import prep

INPUTS = ("words", "density", "words_before", "density_before", "words_after", "density_after", "part", "article", "heading")

#: Labelled blocks, page by page: path of elements (with classes), words, linked words, 1 for main text.
LABELLED_PAGES = [
    # an article element among the other parts of a page
    [("header.site-header p", 5, 0, 0), ("nav ul li", 1, 1, 0), ("nav ul li", 2, 2, 0), ("div.cookie-bar p", 25, 2, 0), ("article h1", 9, 0, 1), ("article p", 45, 2, 1),
     ("article p", 3, 0, 1), ("article blockquote", 14, 3, 1), ("article ul li", 6, 0, 1), ("article ul li", 5, 1, 1), ("article div.ad p", 12, 0, 0), ("article p", 80, 0, 1),
     ("article p.promo", 4, 0, 0), ("article h2", 4, 0, 1), ("article p", 1, 0, 1), ("article p", 30, 15, 1), ("aside p", 60, 0, 0), ("section.comments p", 40, 0, 0),
     ("section.comments p", 120, 3, 0), ("footer p", 8, 1, 0), ("footer p", 200, 0, 0)],
    # sections of an article whose class words also name page parts
    [("main div.post-header h1", 7, 0, 1), ("main div.post-header p", 12, 0, 1), ("main p", 50, 0, 1), ("article section.related-work h2", 2, 0, 1), ("article section.related-work p", 40, 0, 1),
     ("article section.related-work p", 18, 2, 1), ("article section.search-methods h2", 2, 0, 1), ("article section.search-methods p", 35, 0, 1), ("article section.search-methods p", 9, 0, 1),
     ("article div.widget-theory p", 22, 1, 1), ("article div.discussion-of-results p", 70, 2, 1), ("article div.header h1", 8, 0, 1), ("article div.header p", 6, 0, 1),
     ("article div.related-posts h3", 2, 0, 0), ("article div.related-posts li", 6, 6, 0), ("article div.related-posts li", 7, 7, 0), ("article div.search-box p", 4, 0, 0), ("footer p", 9, 2, 0)],
    # the same words where they hold links or scraps
    [("article p", 60, 1, 1), ("article div.related-topics li", 3, 3, 0), ("article div.related-topics li", 4, 4, 0), ("article div.related-reading li", 9, 9, 0), ("article div.widget-trending li", 5, 5, 0),
     ("div.widget-recent li", 6, 6, 0), ("div.search-tips li", 3, 3, 0), ("div.widget p", 30, 0, 0), ("div.related p", 22, 4, 0), ("div.recommended-stories p", 15, 8, 0)],
    # running text without an article element, in containers with such words
    [("nav li", 1, 1, 0), ("div.content.widget h1", 6, 0, 1), ("div.content.widget p", 55, 1, 1), ("div.content.widget p", 30, 0, 1), ("div.content.widget p", 14, 0, 1), ("div.header-story p", 40, 0, 1),
     ("div.search-engines-explained p", 33, 2, 1), ("div.sidebar p", 35, 0, 0), ("div.newsletter h3", 4, 0, 0), ("div.newsletter p", 20, 0, 0), ("div.post-comments p", 45, 0, 0), ("div.header p", 6, 1, 0)],
    # short pages
    [("article p", 1, 0, 1), ("article p", 1, 0, 1)], [("article p", 7, 0, 1)], [("article h1", 5, 0, 1), ("article p", 150, 15, 1)], [("article p", 4, 4, 1)], [("div p", 12, 0, 1)], [("div p", 120, 6, 1)],
    [("div p", 18, 0, 1)], [("aside p", 15, 0, 0)], [("div.banner p", 15, 0, 0)], [("form p", 2, 0, 0)], [("article p", 2, 0, 1), ("article p", 2, 0, 1), ("article p", 2, 0, 1)],
    [("nav li", 1, 1, 0), ("article p", 1, 0, 1)], [("nav li", 1, 1, 0), ("article p", 10, 0, 1), ("footer p", 1, 1, 0)],
    # links in an article: in running text, and in lists
    [("article p", 70, 0, 1), ("article p", 2, 2, 1), ("article p", 65, 0, 1), ("article p", 50, 0, 1), ("article p", 6, 6, 1), ("article p", 45, 0, 1), ("article p", 30, 30, 1), ("article p", 45, 0, 1)],
    [("article h1", 6, 0, 1), ("article p", 40, 0, 1), ("article ul li", 2, 2, 0), ("article ul li", 5, 5, 0), ("article ul li", 7, 7, 0), ("article ul li", 3, 3, 0), ("article ul li", 1, 1, 0), ("article ul li", 4, 4, 0)],
    [("article p", 20, 0, 1), ("article p", 6, 4, 1), ("article p", 25, 1, 1), ("article p", 5, 5, 1), ("article p", 22, 0, 1), ("article p", 3, 2, 1), ("article p", 12, 0, 1), ("article p", 2, 2, 1), ("article p", 9, 0, 1)],
    [("article p", 15, 0, 1), ("article ul li", 6, 6, 0), ("article ul li", 3, 3, 0), ("article p", 3, 0, 1), ("article p", 18, 0, 1), ("article ul li", 4, 4, 0), ("article ul li", 8, 8, 0), ("article p", 2, 0, 1)],
    # the first blocks of an article after the page's links
    [("nav ul li", 1, 1, 0), ("article h1", 2, 0, 1), ("article p", 40, 0, 1)], [("nav ul li", 2, 2, 0), ("article p", 2, 0, 1), ("article p", 3, 0, 1)], [("nav ul li", 1, 1, 0), ("article p", 3, 0, 1)],
    [("nav ul li", 3, 3, 0), ("main h1", 3, 0, 1), ("main p", 12, 0, 1)], [("ul li", 1, 1, 0), ("div h1", 2, 0, 1), ("div p", 60, 0, 1)], [("ul li", 2, 2, 0), ("div h1", 3, 0, 1), ("div p", 35, 0, 1)],
    # short blocks of an article before links
    [("article h1", 2, 0, 1), ("article p", 12, 10, 1), ("article p", 40, 0, 1)], [("article p", 40, 0, 1), ("article p", 2, 0, 1), ("ul li", 3, 3, 0), ("ul li", 2, 2, 0)],
    [("article p", 3, 0, 1), ("ul li", 1, 1, 0), ("ul li", 6, 6, 0)], [("article h1", 3, 0, 1), ("article p", 2, 0, 1), ("div p", 2, 2, 0), ("div p", 3, 3, 0)],
    # text in a container named as an article's text
    [("div.post-content h1", 4, 0, 1), ("div.post-content p", 2, 0, 1), ("div.post-content p", 3, 0, 1), ("div.post-content p", 60, 2, 1), ("div.post-content p", 1, 0, 1), ("div.sidebar li", 4, 4, 0)],
    # pages without an article element: running text, headings, link lists and scraps between them
    [("ul li", 1, 1, 0), ("ul li", 3, 3, 0), ("div h1", 5, 0, 1), ("div p", 60, 0, 1), ("div p", 35, 0, 1), ("div p", 14, 0, 1), ("div h2", 7, 0, 1), ("div p", 120, 6, 1), ("div p", 25, 3, 1),
     ("div p", 4, 0, 1), ("div p", 40, 12, 1), ("div p", 22, 0, 1), ("ul li", 3, 3, 0), ("ul li", 2, 2, 0), ("p", 2, 0, 0), ("ul li", 4, 4, 0), ("p", 3, 0, 0), ("ul li", 1, 1, 0)],
    [("ul li", 5, 4, 0), ("ul li", 20, 18, 0), ("ul li", 15, 14, 0), ("p", 2, 0, 0), ("ul li", 30, 29, 0), ("ul li", 25, 25, 0), ("ul li", 12, 9, 0), ("div p", 45, 0, 1), ("div p", 3, 0, 1), ("div p", 70, 2, 1)],
    [("div h1", 9, 0, 1), ("div p", 20, 0, 1), ("div p", 11, 0, 1), ("div p", 12, 0, 1), ("div p", 18, 0, 1), ("ul li", 6, 6, 0), ("ul li", 4, 4, 0)],
]

#: Element names by their role in a page.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "head"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "menu", "dialog", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "center"}
OTHER_PARTS = {"nav", "aside", "footer", "menu", "dialog", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role that name a part outside the article.
PART_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "billboard", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments",
              "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "cookiebar", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav",
              "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "replies", "reply", "respond",
              "share", "sharing", "sidebar", "signup", "sitemap", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "topbar", "alert", "alerts", "alertdialog", "notices", "banners", "sponsors", "adsbygoogle"}
#: Words that name such a part, or something that an article tells of.
LOOSE_WORDS = {"discussion", "header", "promotion", "recommended", "related", "search", "subscription", "widget", "widgets"}
#: Words beside loose ones that say no more than that it is a part of the page.
COMPANIONS = {"area", "articles", "bar", "block", "bottom", "box", "col", "column", "container", "form", "global", "inner", "items", "left", "link", "links", "list", "outer", "page", "pages", "panel",
              "posts", "right", "row", "section", "site", "stories", "text", "top", "wrap", "wrapper"}
#: Endings of compound names such as `sidenav` or `usercomments`.
PART_ENDS = ("nav", "menu", "sidebar", "footer", "banner", "comment", "comments", "advert", "popup", "newsletter")
ARTICLE_ROLES = {"main", "article"}
#: Class words that together name the text of an article.
ARTICLE_NAMES, TEXT_NAMES = {"article", "entry", "post", "story"}, {"body", "content", "text"}

#: How surely a container names a part outside the article: not, beside words of its own, alone, by a plain word or element.
NONE, LOOSE, LIKELY, SURE = range(4)

_TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(parts: set[str], in_article: bool) -> int:
    """How surely the words of one class, id, role or label name a part outside the article."""
    if parts & PART_WORDS or any(x.endswith(PART_ENDS) for x in parts):
        return SURE
    loose = parts & LOOSE_WORDS
    if not loose or loose == {"header"} and in_article:
        return LOOSE if loose else NONE
    return LIKELY if all(x in COMPANIONS or x.isdigit() for x in parts - loose) else LOOSE


def _role(name: str, attrs: str, in_article: bool) -> tuple[int, int, bool]:
    """(part by element or hidden, part by words or as a form, names the article) of a tag."""
    fixed = SURE if name in OTHER_PARTS or (name == "header" and not in_article) else NONE
    part, article = SURE if name == "form" else NONE, name in ("article", "main")
    if attrs and name not in ("html", "body"):
        for k, v in _ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'")
            if k in ("class", "id", "role", "aria-label"):
                parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower())) - {""}
                if k == "role" and parts & ARTICLE_ROLES:
                    article = True
                else:
                    part = max(part, _named(parts, in_article))
                    article |= bool(parts & ARTICLE_NAMES and parts & TEXT_NAMES) and part == NONE
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and _HIDDEN.search(v)):
                fixed = SURE
    return fixed, part, article


class _Boxes:
    """Containers of a page in order of their start, a parent before its children."""

    def __init__(self) -> None:
        self.parent, self.fixed, self.part, self.article = [0], [NONE], [NONE], [False]
        self.wraps: list[bool] = [False]
        self.titled = False

    def add(self, parent: int, name: str, role: tuple[int, int, bool]) -> int:
        self.parent.append(parent)
        self.fixed.append(role[0])
        self.part.append(NONE if name == "main" else role[1])
        self.article.append(self.article[parent] or role[2])
        self.wraps.append(False)
        return len(self.parent) - 1

    def title(self, box: int) -> None:
        """The article's title: the containers around it name nothing by their words."""
        if self.article[box] and not self.titled:
            self.titled = True
            inside = True  # of the article's own element
            while box:
                inside = inside and self.article[self.parent[box]]
                self.wraps[box] = not inside
                box = self.parent[box]

    def parts(self) -> list[int]:
        out: list[int] = []
        for i, p in enumerate(self.parent):
            out.append(max(out[p] if i else NONE, self.fixed[i], NONE if self.wraps[i] else self.part[i]))
        return out


def blocks(page: str) -> list[tuple[str, int, float, int, bool, bool]]:
    """(text, words, link density, part, article, heading) of the text blocks in order."""
    out: list = []
    parts: list[tuple[str, bool]] = []
    boxes = _Boxes()
    stack: list[tuple[str, int]] = [("", 0)]
    in_link = heading = False
    own = NONE  # how surely the block's own tag names another part

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                n = len(text.split(" "))
                inside = sum(len(t.split()) for t, a in parts if a)
                out.append((text, n, min(1.0, inside / n), own, stack[-1][1], heading))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            parts.append((html.unescape(text), in_link))
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            if page.startswith(">", at) or page.startswith("->", at):
                at = page.index(">", at) + 1
                continue
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None:
            continue
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if name in SKIPPED and not closing:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title"):
                    at = n
            if name not in ("button", "svg", "math", "select"):
                flush()
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            parts.append((" ", in_link))
            continue
        if name in INLINE:
            continue
        flush()
        in_link = in_link and name not in CONTAINERS
        box = stack[-1][1]
        own = max(_role(name, attrs, boxes.article[box])[:2]) if not closing and name not in CONTAINERS and attrs.strip() else NONE
        if name in HEADINGS:
            heading = not closing
            if name == "h1" and heading:
                boxes.title(box)
        elif name in CONTAINERS:
            heading = False
            if not closing:
                if not attrs.rstrip().endswith("/"):
                    stack.append((name, boxes.add(box, name, _role(name, attrs, boxes.article[box]))))
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
        elif not closing and name in ("p", "li", "td", "th", "dt", "dd", "blockquote", "pre"):
            heading = False
    flush()
    around = boxes.parts()
    return [(text, n, d, max(own, around[box]), boxes.article[box], head) for text, n, d, own, box, head in out]


def inputs(found: Sequence[tuple]) -> np.ndarray:
    """(blocks, INPUTS) of one page."""
    x = np.zeros((len(found), len(INPUTS)))
    for i, (_, n, d, part, article, heading) in enumerate(found):
        x[i, 0], x[i, 1], x[i, 6:] = n, d, (part, article, heading)
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    return x


def markup(rows: Sequence[tuple]) -> str:
    """A page of labelled rows: each block in the elements of its path."""
    out = []
    for path, words, linked, _ in rows:
        steps = [step.split(".") for step in path.split(" ")]
        out += [f"<{name} class='{' '.join(classes)}'>" if classes else f"<{name}>" for name, *classes in steps]
        out.append(f"<a href=/>{'word ' * linked}</a>{'word ' * (words - linked)}")
        out += [f"</{name}>" for name, *_ in reversed(steps)]
    return "".join(out)


#: The inputs of the labelled blocks, then 1 for main text.
LABELLED = [(*x, row[-1]) for rows in LABELLED_PAGES for x, row in zip(inputs(blocks(markup(rows))).tolist(), rows, strict=True)]


def train(spark: SparkSession, labelled: Sequence[tuple] = LABELLED, depth: int = 8) -> list[tuple]:
    """The tree as rows (input, threshold, left row, right row, class); input -1: a leaf."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector
    rows = spark.createDataFrame([(float(r[-1]), [float(v) for v in r[:-1]]) for r in labelled], "label double, x array<double>")
    rows = rows.coalesce(1).select("label", array_to_vector("x").alias("features"))
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=256, minInstancesPerNode=1, seed=1).fit(rows)
    out: list[tuple] = []

    def add(node) -> int:
        here = len(out)
        out.append(())
        if node.getClass().getSimpleName() == "LeafNode":
            out[here] = (-1, 0.0, 0, 0, int(node.prediction()))
        else:
            split = node.split()
            out[here] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0)
        return here

    add(model._java_obj.rootNode())
    return out


def decide(tree: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    """Class of each block: all blocks walk down the tree together."""
    feature, threshold = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
    left, right, leaf = (np.array([t[i] for t in tree]) for i in (2, 3, 4))
    at = np.zeros(len(x), np.int64)
    while True:
        f = feature[at]
        on = np.flatnonzero(f >= 0)
        if not len(on):
            return leaf[at].astype(bool)
        low = x[on, f[on]] <= threshold[at[on]]
        at[on] = np.where(low, left[at[on]], right[at[on]])


def main_text(page: str | None, tree: Sequence[tuple]) -> str:
    found = blocks(page or "")
    return " ".join(b[0] for b, keep in zip(found, decide(tree, inputs(found)), strict=True) if keep) if found else ""


def extract(pages: DataFrame, tree: Sequence[tuple] | None = None) -> DataFrame:
    """page_id, url, text (main text), n_chars (its code points), blocks, kept_blocks."""
    spark = prep(pages.sparkSession)
    tree = tree or train(spark)
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, every, kept = [], [], []
            found = [blocks(p or "") for p in b.column("html").to_pylist()]
            x = [inputs(f) for f in found]
            keep = decide(tree, np.concatenate(x)) if x else np.zeros(0, bool)
            at = 0
            for f in found:
                k = keep[at:at + len(f)]
                at += len(f)
                texts.append(" ".join(t[0] for t, y in zip(f, k, strict=True) if y))
                every.append(len(f))
                kept.append(int(k.sum()))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *(pa.array(v, pa.int64()) for v in ([len(t) for t in texts], every, kept))],
                                             names=["page_id", "url", "text", "n_chars", "blocks", "kept_blocks"])

    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, blocks long, kept_blocks long")
