"""The main text of web pages, by tree scoring.

The page becomes a tree without the parts that by their tag or role are not article text. Each
paragraph gives its parent points for its length and commas, half of them to the next ancestor and
less further up; links take points off. The container with the most points and those of its siblings
that read like text are kept. Elements whose names say that they are something else (a sidebar, a
comment) are cut after a first scoring, which tells the names of wrappers around the article apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset(("script style noscript template head title nav footer aside form button select textarea iframe object "
                      "svg canvas dialog menu audio video map datalist").split())
_IN_HEAD = frozenset("head title meta link base script style noscript template".split())
_BLOCK = frozenset(("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr "
                    "ul title caption legend").split())
_PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends the nearest open element of these, if nothing of the second set lies between.
_SCOPES = {"p": ({"p"}, {"table", "td", "th", "button", "object"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS = {tag: scope for scope, (tags, _) in _SCOPES.items() if scope != "p" for tag in tags}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion promoted "
    "sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer foot masthead topbar header "
    "comment comments disqus discussion respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar skip hidden").split())
_TALK = frozenset("comment comments disqus discussion respond reply replies".split())
#: Words that may stand beside those names: where and how, not what.
_BESIDE = frozenset((
    "box bar block area list section wrapper wrap container content slot unit button buttons link links icon icons left right top bottom "
    "main site page global primary secondary inner outer col column item items group panel pane region row mobile desktop sticky fixed "
    "post article entry user reader js the form thread text body holder zone media id blog web google policy warning message dialog").split())
#: A class with these says how the page is laid out or what state it is in.
_STATES = frozenset("has with no not without is hide open opened closed collapsed expanded enabled disabled active ready loaded off on".split())
_OF_ARTICLE = frozenset("article post entry story content title chapter hero".split())
_JOINED = re.compile(r"^(?:user|reader|post|site|main|top|page)?(?:ad|advert|sponsor|promo|sidebar|comment|cookie|footer|header|nav|menu|newsletter|"
                     r"breadcrumb|popup|notice)(?:s|box|bar|block|area|list|section|wrapper|container|banner|content|slot|unit|s?\d+)*$")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_OPEN_END = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
#: How many ancestors a paragraph gives points to.
LEVELS = 12


class Node:
    """An element: children are elements and pieces of text, in order.

    ``named`` is what its names say it is, ``near`` the nearest open element of each scope.
    """

    __slots__ = ("tag", "parent", "children", "points", "chars", "link_chars", "unwanted", "named", "near", "inline")

    def __init__(self, tag: str, parent: Node | None, unwanted: bool = False, named: str = "") -> None:
        self.tag, self.parent, self.unwanted, self.named = tag, parent, unwanted, named
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.link_chars = 0
        self.near: dict[str, Node] = parent.near if parent is not None else {}
        if tag in _CHANGES:
            self.near = {k: v for k, v in self.near.items() if tag not in _SCOPES[k][1]}
            for scope, (tags, _) in _SCOPES.items():
                if tag in tags:
                    self.near[scope] = self
        #: Open inline elements by tag since the nearest block, which they share.
        self.inline: Counter[str] = Counter() if parent is None or tag in _BLOCK else parent.inline


_CHANGES = frozenset().union(*(tags | bounds for tags, bounds in _SCOPES.values()))


def _unwanted(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether the tag, the role or a hiding attribute says that an element is no article text."""
    if tag in _SKIPPED:
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main") or not attrs:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and (value or "").lower() in _ROLES:
            return True
        if name == "style" and "display:none" in (value or "").replace(" ", "").lower():
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> str:
    """The word of a class or id that names something else than an article, if all of its words do or only say where."""
    if tag in ("html", "body", "main"):
        return ""
    for name, value in attrs:
        if name not in ("class", "id"):
            continue
        for token in (value or "").split():
            parts = [p for p in _SPLIT.split(_CAMEL.sub("-", token).lower()) if p]
            found = [p for p in parts if p in _NAMES or _JOINED.match(p)]
            if not found or _STATES.intersection(parts) or not all(p in found or p in _BESIDE or p.isdigit() for p in parts):
                continue
            if found[-1] in ("header", "head") and (in_article or _OF_ARTICLE.intersection(parts)):
                continue
            return "comment" if any(p in _TALK or "comment" in p for p in found) else found[0]
    return ""


class _Builder(HTMLParser):
    """Builds the tree. Unwanted elements open and end like others, but neither they nor what is in them is anyone's child."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", None)
        self.articles = 0
        self.open: Counter[str] = Counter()
        self.html, self.ahead = html, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.ahead is not None:
            self.ahead[tag] -= 1
        if self.open["head"] and tag not in _IN_HEAD:
            self._leave_tag("head")
        if tag in _VOID:
            if not self.here.unwanted:
                self.here.children.append(" " if tag != "hr" else Node("hr", self.here))
            return
        if tag in ("article", "main") and self.here.unwanted:
            self._leave_unclosed()
        if tag in _BLOCK:
            self._close("p")
        if tag in _ENDS:
            self._close(_ENDS[tag])
        inside = self.here.unwanted
        unwanted = inside or _unwanted(tag, attrs, self.articles > 0)
        node = Node(tag, self.here, unwanted, "" if unwanted or not attrs else _named(tag, attrs, self.articles > 0))
        if not node.unwanted:
            self.here.children.append(node)
        elif tag in _BLOCK and not inside:  # what stands before and after it are different blocks
            self.here.children.append(Node("hr", self.here))
        self.here = node
        self.open[tag] += 1
        if tag not in _BLOCK:
            node.inline[tag] += 1
        self.articles += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        if self.ahead is not None:
            self.ahead["/" + tag] -= 1
        # An inline end tag doesn't end the block around it.
        if (self.open if tag in _BLOCK else self.here.inline)[tag]:
            self._leave_tag(tag)

    def handle_data(self, data: str) -> None:
        if self.here.tag == "head" and data.strip():
            self._leave_tag("head")
        if not self.here.unwanted:
            self.here.children.append(data)

    def _close(self, scope: str) -> None:
        node = self.here.near.get(scope)
        if node is not None:
            self._leave(node)

    def _leave_unclosed(self) -> None:
        """An article ends the unwanted elements around it for which the page has no end tags left."""
        if self.ahead is None:
            line, column = self.getpos()
            at = sum(len(x) + 1 for x in self.html.split("\n", line - 1)[:line - 1]) + column
            self.ahead = Counter("/" * bool(m[1]) + m[2].lower() for m in _TAG.finditer(self.html, at + 1))
        outer, node = None, self.here
        while node is not None and node.unwanted:
            if self.ahead["/" + node.tag] <= self.ahead[node.tag]:
                outer = node
            node = node.parent
        if outer is not None:
            self._leave(outer)

    def _leave_tag(self, tag: str) -> None:
        node = self.here
        while node.tag != tag:
            node = node.parent
        self._leave(node)

    def _leave(self, node: Node) -> None:
        while True:
            left = self.here
            self.articles -= left.tag in ("article", "main")
            self.open[left.tag] -= 1
            if left.tag not in _BLOCK:
                left.inline[left.tag] -= 1
            self.here = left.parent
            if left is node:
                return


def _ordered(root: Node) -> list[Node]:
    """Elements, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.link_chars = 0
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.link_chars += child.link_chars
            else:
                node.chars += len(child.strip())
        if node.tag == "a":
            node.link_chars = node.chars


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _own_text(node: Node) -> str:
    """Text of an element and its inline children, without that of inner blocks."""
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag not in _BLOCK:
            todo += reversed(child.children)
    return "".join(out)


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        node.points = 0.0
    for node in nodes:
        if node.tag not in _PARAGRAPHS and node.tag not in ("div", "section", "article", "main", "body"):
            continue
        text = _own_text(node).strip()
        if not text:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - _density(node))
        holder, share = (node.parent if node.tag in _PARAGRAPHS else node), 1.0
        level = 0
        while holder is not None and level < LEVELS:
            holder.points += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            holder = holder.parent


def _best(nodes: list[Node]) -> Node | None:
    best = max(nodes, key=lambda n: n.points * (1 - _density(n)), default=None)
    return best if best is not None and best.points > 0 else None


def _around(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _cut_named(nodes: list[Node]) -> list[Node]:
    """Takes out the elements that their names say are no article, unless one holds the best container of the page."""
    if not any(node.named for node in nodes):
        return nodes
    _measure(nodes)
    _score(nodes)
    best = _best(nodes)
    if best is not None and any(n.named for n in _around(best)):
        holds = {id(n) for start in nodes if start.tag in ("article", "main", "h1") for n in _around(start.parent)}
        inside: set[int] = set()
        for node in nodes:
            if node.named or (node.parent is not None and id(node.parent) in inside):
                inside.add(id(node))
        most = best.points
        clean = [n for n in nodes if id(n) not in inside]
        _score(clean)
        other = _best(clean)
        for node in _around(best):
            # Comments may well be longer than the article.
            weak = other is None or (node.named != "comment" and other.points < 0.25 * most)
            if node.named and (id(node) in holds or weak):
                node.named = ""
    for node in nodes:
        # What stands before and after an element are different blocks.
        node.children = [c if not isinstance(c, Node) or not c.named else Node("hr", node) if c.tag in _BLOCK else " " for c in node.children]
    return _ordered(nodes[0])


def _kept(nodes: list[Node]) -> list[Node]:
    """The best container, or the article around it, and its siblings that read like text."""
    best = _best(nodes)
    if best is None:
        marked = [n for n in nodes if n.tag in ("article", "main") and n.chars]
        return marked[:1] or nodes[:1]
    top = best
    for node in _around(best):
        if node.tag in ("article", "main"):
            top = node
    if top.parent is None:
        return [top]
    out, least = [], max(3.0, 0.2 * best.points)
    for child in top.parent.children:
        if not isinstance(child, Node):
            continue
        good = child.points * (1 - _density(child)) >= least or child.tag in _HEADINGS or (
            child.tag in _PARAGRAPHS and _density(child) < 0.25 and _reads(child))
        if child is top or good:
            out.append(child)
    return out


def _reads(node: Node) -> bool:
    """Whether a short paragraph is a sentence."""
    text = _own_text(node).strip()
    return node.chars >= 80 or (text[-1:] in tuple(".!?…:\"”»") and not text.lower().startswith(("©", "copyright", "(c)")))


def _blocks(kept: list[Node]) -> Iterator[str]:
    pieces: list[str] = []
    whole = any(n.tag in ("article", "main") for n in kept)
    todo: list[Node | str | None] = list(reversed(kept))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            pieces.append(node)
            continue
        if node is None or node.tag in _BLOCK:
            yield " ".join("".join(pieces).split())
            pieces = []
        if node is None:
            continue
        if node.tag in ("ul", "ol") and not whole and _density(node) > 0.9:
            continue  # a menu without a name, where nothing marks the article
        if node.tag in _BLOCK:
            todo.append(None)
        todo += reversed(node.children)
    yield " ".join("".join(pieces).split())


def main_text(html: str | None) -> str:
    """The article of a page, a line for each block; empty if there is none."""
    if not html:
        return ""
    cut = _OPEN_END.search(html, html.rfind(">") + 1)
    html = html[:cut.start()] if cut else html
    builder = _Builder(html)
    builder.feed(html)
    builder.close()
    nodes = _cut_named(_ordered(builder.root))
    _measure(nodes)
    _score(nodes)
    return "\n".join(b for b in _blocks(_kept(nodes)) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` (code points) of each page, from its whole html.

    Null and empty html, and pages without text, give an empty text. Cut-off and wrongly nested
    pages are read as far as they go. Rows that repeat are read alike; further columns are ignored.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "url": batch["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    done = source.mapInPandas(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
