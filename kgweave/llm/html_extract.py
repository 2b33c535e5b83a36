"""Main text of web pages by tree scoring.

A page becomes a tree of blocks.  Parts that are never article text (scripts,
menus, headers and footers of the page, side bars, notices, adverts, forms,
comments; by tag, role, and whole classes and ids) are cut first; a form, or what is
only named as furniture, stays if it holds the page's articles or most of its points,
and so do headings, paragraphs, and what only an id names inside an article.  Readers'
comments go whatever their tag.  Every paragraph then gives
points for its length and its commas to its ancestors: all to its parent, half to
the next, less further up; an ancestor's sum is discounted by its link density.
From the container with most points the way leads up to the article or main element
around it, else to the highest parent whose parts are all prose; that is the article,
and with it those of its siblings that score near it or read like prose.  All its
uncut blocks, in page order, are the text.

Pages are independent: one pass, one task per split, no shuffle.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's element kinds, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "script style noscript template title head iframe object embed svg canvas math nav footer aside "
    "button select option input textarea dialog menu audio video map xmp noembed noframes search".split()
)
#: Cut unless the page's text is in them.
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner masthead header footer nav navbar "
    "navigation menu sidebar aside widget breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond reply replies "
    "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing "
    "related recommended recommendations toolbar skip tags hidden copyright legal disclaimer response responses".split()
)
#: Of these, what names readers' comments, and what may be a part of an article within it.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies response responses".split())
OWN_PARTS = frozenset("header masthead banner legal notice notices alert disclaimer copyright tags skip".split())
#: Words that may stand beside one of FURNITURE in a class or id, as in "site-footer".
PLACES = frozenset(
    "bar box block list area wrap wrapper container section item items link links button buttons icon icons panel banner menu inner outer "
    "left right top bottom upper lower primary secondary main site page global post form message body text reader readers user users thread entry".split()
)
ROOTS = frozenset("html body main article".split())
ARTICLES = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article section div main td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper stand beside each other, as in browsers; so every step up is bounded.
DEEPEST = 512
#: Share of characters inside links from which a block counts as links, not prose.
LINKED = 0.25

#: A tag; quotes hold a value only after an equals sign.  No repetition can be taken back, so a search is linear.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>""")
#: The same where quotes mean nothing.
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT_END = re.compile("--!?>")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "score", "chars", "link_chars", "soft", "depth", "in_article", "in_form")

    def __init__(self, tag: str, parent: Node | None, cut: bool, soft: str = ""):
        self.tag, self.parent, self.cut, self.soft = tag, parent, cut, soft
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.link_chars = 0
        self.depth = parent.depth + 1 if parent is not None else 0
        # Whether it is one or stands in one.
        self.in_article = tag in ARTICLES or parent is not None and parent.in_article
        self.in_form = tag in FORMS or parent is not None and parent.in_form


def _furniture(tag: str, attributes: str, parent: Node) -> bool:
    if tag in NEVER:
        return True
    # An article's own head belongs to it; the page's does not.
    if tag == "header" and not parent.in_article:
        return True
    if tag == "label" and parent.in_form:
        return True
    if not attributes or tag in ROOTS:
        return False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
    return False


def _named(tag: str, attributes: str, parent: Node) -> str:
    """"form" for a form, "comments" or "furniture" if a whole class or id names that, else nothing.

    Headings and paragraphs are never furniture by name, nor is an article; inside an
    article only classes count, and not those that name its own parts.
    """
    if tag in FORMS:
        return "form"
    if not attributes or tag in ROOTS and tag != "article":
        return ""
    inside, found = parent.in_article, ""
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value == "form":
            return "form"
        for token in value.split() if name in ("class", "id") else ():
            said = set(_WORD.findall(token))
            if not said & FURNITURE or not said <= FURNITURE | PLACES:
                continue
            if said & COMMENTS and tag != "p" and tag not in HEADINGS:
                return "comments"
            plain = tag in ("article", "header", "p") or tag in HEADINGS
            if not plain and not (inside and (name == "id" or said & FURNITURE <= OWN_PARTS)):
                found = "furniture"
    return found


def _settle(root: Node) -> None:
    """Cut comments, and of what is named as furniture all but what holds all articles of the page or most of its points."""
    points: dict[int, float] = {}
    total, stack, named, articles = 0.0, [root], [], []
    while stack:
        node = stack.pop()
        if node.cut or node.soft == "comments":
            node.cut = True
            continue
        if node.soft:
            named.append(node)
        if node.tag in ARTICLES:
            articles.append(node)
        stack.extend(n for n in node.children if isinstance(n, Node))
    if not named:
        return
    for owner, text, links in blocks(root):
        worth = _points(owner, text, links)
        total += worth
        while owner is not None:
            if owner.soft:
                points[id(owner)] = points.get(id(owner), 0.0) + worth
            owner = owner.parent
    inside: dict[int, int] = {}
    for up in articles:
        while up is not None:
            if up.soft:
                inside[id(up)] = inside.get(id(up), 0) + 1
            up = up.parent
    for node in named:
        within = inside.get(id(node), 0)
        around, up = 0, node.parent
        while up is not None:
            around += up.tag in ARTICLES
            up = up.parent
        # Where an article stands beside it, points alone do not make furniture an article.
        held = within == len(articles) if articles and within else within + around == len(articles) and points.get(id(node), 0.0) > total / 2
        node.cut = not held


def parse(page: str) -> Node:
    """The tree of a page; open elements are closed as browsers do for paragraphs, items and cells."""
    root = here = Node("#root", None, False)
    at, size, last, pattern = 0, len(page), page.rfind(">"), _TAG
    while at < size:
        mark = page.find("<", at)
        if not 0 <= mark < last:
            here.children.append(html.unescape(page[at:]))
            break
        if mark > at:
            here.children.append(html.unescape(page[at:mark]))
        if page.startswith("<!--", mark):
            end = _COMMENT_END.search(page, mark + 2)
            at = end.end() if end else size
            continue
        if page.startswith("<![CDATA[", mark):
            end = page.find("]]>", mark)
            at = end + 3 if end >= 0 else size
            continue
        if page[mark + 1] in "!?":
            at = page.index(">", mark) + 1
            continue
        tag = pattern.match(page, mark)
        if tag is None and pattern is _TAG and _BARE_TAG.match(page, mark):
            # A quote that never ends: from here on quotes mean nothing.
            pattern = _BARE_TAG
            tag = pattern.match(page, mark)
        if tag is None:
            here.children.append("<")
            at = mark + 1
            continue
        at = tag.end()
        name = tag[2]
        name = name.lower()
        if tag[1]:
            up = here
            while up is not None and up.tag != name:
                # An inline end tag does not reach out of its block.
                up = None if up.tag in BLOCKS and name not in BLOCKS else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if name in BLOCKS:
            up = here
            while up.tag != "#root" and up.tag not in SCOPES and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                here = up.parent
            if name in CLOSES:
                up = here
                while up.tag != "#root" and up.tag not in CLOSES[name] and (up.tag not in SCOPES or up.tag in ("td", "th")):
                    up = up.parent
                if up.tag in CLOSES[name]:
                    here = up.parent
                    if name == "tr" and here.tag == "tr":
                        here = here.parent
        node = Node(name, here, here.cut or _furniture(name, tag[3], here), _named(name, tag[3], here))
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if not node.cut:
                node.children.append(html.unescape(page[at : end.start() if end else size]))
            at = end.end() if end else size
        elif name not in VOID and (name in BLOCKS or not tag[3].rstrip().endswith("/")) and node.depth < DEEPEST:
            here = node
    return root


def _tidy(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, characters inside links) of every run of text between block borders."""
    out: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked: list[str] = []

    def flush(owner: Node) -> None:
        text = _tidy(pieces)
        if text:
            out.append((owner, text, len(_tidy(linked))))
        pieces.clear()
        linked.clear()

    # Without recursion: pages may nest deeply.
    stack: list[tuple[Node, int, Node, bool]] = [(root, 0, root, False)]
    while stack:
        node, k, owner, in_link = stack.pop()
        children = node.children
        while k < len(children):
            child = children[k]
            k += 1
            if isinstance(child, str):
                pieces.append(child)
                if in_link:
                    linked.append(child)
            elif child.tag == "br":
                pieces.append(" ")
            elif not child.cut:
                stack.append((node, k, owner, in_link))
                block = child.tag in BLOCKS
                if block:
                    flush(owner)
                stack.append((child, 0, child if block else owner, in_link or child.tag == "a"))
                break
        else:
            if node is owner:
                flush(owner)
    return out


def _points(owner: Node, text: str, links: int) -> float:
    points = (0.5 if owner.tag in HEADINGS else 1.0) + text.count(",") + min(len(text) / 100, 3.0)
    return points * (1 - links / len(text))


def _add_points(found: list[tuple[Node, str, int]]) -> list[Node]:
    scored: dict[int, Node] = {}
    for owner, text, links in found:
        points = _points(owner, text, links)
        # Text straight inside a container counts for the container itself.
        up = owner.parent if owner.tag not in SCOPES or owner.tag in ("td", "th") else owner
        level = 0
        while up is not None and up.tag not in ("#root", "html"):
            up.score += points if level == 0 else points / (2 * level)
            scored[id(up)] = up
            up, level = up.parent, level + 1
        up = owner
        while up is not None:
            up.chars += len(text)
            up.link_chars += links
            up = up.parent
    return list(scored.values())


def main_text(page: str | None) -> tuple[str, int, str, float]:
    """Text, number of blocks, tag of the container and its points; nothing for a page without text."""
    if not page:
        return "", 0, "", 0.0
    root = parse(page)
    _settle(root)
    found = blocks(root)
    if not found:
        # Names may mislead: once more by tags and roles alone.
        found = blocks(parse(page))
    if not found:
        return "", 0, "", 0.0
    candidates = _add_points(found)
    if not candidates:
        return " ".join(t for _, t, _ in found), len(found), "", 0.0
    density = lambda n: n.link_chars / n.chars if n.chars else 0.0
    rating = lambda n: n.score * (1 - density(n))
    best = max(candidates, key=rating)
    # Up to the article that the container is a part of, else as far as it stands among prose.
    up = best
    while up is not None and up.tag not in ARTICLES:
        up = up.parent
    if up is not None:
        best = up
    else:
        while best.parent is not None and best.parent.tag not in ("#root", "html"):
            if any(isinstance(n, Node) and n is not best and not n.cut and density(n) >= LINKED for n in best.parent.children):
                break
            best = best.parent
    kept = {id(best)}
    limit = max(1.0, 0.2 * rating(best))
    for near in best.parent.children if best.parent is not None and up is None else ():
        if isinstance(near, Node) and near.chars and not near.cut and (rating(near) >= limit or density(near) < LINKED):
            kept.add(id(near))
    if up is not None and best.parent is not None:
        for near in best.parent.children:
            if isinstance(near, Node) and near is not best and near.chars and not near.cut:
                prose = near.tag == "p" and density(near) == 0
                if rating(near) >= limit or prose or (near.tag == "h1" and density(near) == 0):
                    kept.add(id(near))
    # Text that stands among the kept siblings without an element of its own.
    beside = best.parent if up is None else None
    texts = []
    for owner, text, links in found:
        if owner is beside and links < LINKED * len(text):
            texts.append(text)
            continue
        up = owner
        while up is not None and id(up) not in kept:
            up = up.parent
        if up is not None:
            texts.append(text)
    return " ".join(texts), len(texts), best.tag, rating(best)


OUTPUT = ["text", "n_chars", "n_blocks", "container", "points"]


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` without `column`, with text, n_chars (code points), n_blocks, container and points.

    Null or empty html, or a page of furniture only, gives an empty text; an empty table
    gives an empty one.  Broken or unclosed markup is read as far as it goes, in time
    linear in the page: what follows the last ">" is text, and after a quoted value that
    never ends quotes mean nothing.  Nothing is cut by length; a long page is held whole
    by its task.  Of containers with equal ratings the one that was scored first counts.
    Repeated rows are extracted again; columns named like an output are replaced.
    """
    plain = pages.drop(*(set(OUTPUT) & set(pages.columns) - {column}))
    keep = [f for f in plain.schema if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars bigint, n_blocks bigint, container string, points double"])

    def run(batches):
        for batch in batches:
            rows = [main_text(page) for page in batch.column(column).to_pylist()]
            texts, counts, tags, points = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in keep),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(tags, pa.string()),
                    pa.array(points, pa.float64()),
                ],
                names=[*(f.name for f in keep), *OUTPUT],
            )

    return plain.mapInArrow(run, schema)
