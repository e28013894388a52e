"""Main text of web pages: subtrees that recur on many pages of a host are its template and go.

Every block element of a page is hashed with all below it, and Spark counts on how many different pages of its host
each hash occurs. A second look at the page leaves out recurring subtrees and those whose tag, role or class says
that they are no article, and returns the blocks of the article, or of the body where a page has none.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from arborlake.llm.urltree import host_and_path
from arborlake.runtime import materialize

#: Different pages of a host from which on a subtree is part of its template, and the share of its pages that it
#: also has to be on inside an article.
PAGES, ARTICLE_SHARE = 5, 0.3

# Kinds of HTML elements, and words of class, id and role that name parts around an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th caption".split())
BLOCK = PROSE | frozenset("html body article main section div header footer nav aside form ul ol dl table thead tbody tfoot tr "
                          "figure address fieldset details summary hgroup center dialog menu".split())
UNSEEN = frozenset("head script style noscript template iframe object svg canvas math audio video map title".split())
AROUND = frozenset("nav aside footer form button select textarea label option menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar "
                  "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
                  "subscribe signup login share sharing social related recommended comment comments respond disqus replies footer masthead toolbar "
                  "widget pagination pager tags skip".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "about", "children", "parent")

    def __init__(self, tag: str, about: str = "", parent: Node | None = None):
        self.tag, self.about, self.parent = tag, about, parent
        self.children: list[Node | str] = []


class _Builder(HTMLParser):
    """A tree of the elements; ends that are missing are supplied as browsers do, stray ones are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and tag != "html":
            self._close({"p"}, {"button", "td", "th", "li", "article", "section", "div", "blockquote", "body"} - {tag})
        if tag in CLOSES:
            self._close(CLOSES[tag], {"table", "ul", "ol", "dl", "select", "menu"})
        known = dict(attrs)
        words = " ".join(known.get(k) or "" for k in ("class", "id"))
        about = f"{words}|{known.get('role') or ''}|{'hidden' if 'hidden' in known or known.get('aria-hidden') == 'true' else ''}"
        node = Node(tag, about, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tags, holders):
        """Ends the nearest open element of ``tags`` unless one of ``holders`` lies between."""
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in holders:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def around(node: Node, inside: bool) -> bool:
    """Whether an element is by its kind no part of an article; ``inside``: it lies in one."""
    if node.tag in AROUND or node.tag == "header" and not inside:
        return True
    if node.about == "||":
        return False
    words, role, hidden = node.about.rsplit("|", 2)
    if hidden or role.lower() in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    return any(t.lower() in NAMES for t in _TOKEN.findall(words))


def hashes(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """(hash by element, 1 if it lies in an article by element) of block elements with text, by Python id."""
    found: dict[int, int] = {}
    within: dict[int, int] = {}
    digests: dict[int, bytes] = {}
    # Children before parents, without recursion, as pages may nest deeply.
    stack, order = [(root, 0)], []
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        inside = int(inside or node.tag in ("article", "main"))
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN]
    for node, inside in reversed(order):
        h, text = blake2b(f"{node.tag}|{node.about}".encode(), digest_size=8), False
        for c in node.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                if words:
                    text = True
                    h.update(b"t" + words.encode("utf-8", "surrogatepass"))
            elif id(c) in digests:
                text = text or bool(digests[id(c)])
                h.update(b"e" + digests[id(c)])
        digests[id(node)] = h.digest() if text else b""
        if text and node.tag in BLOCK:
            found[id(node)] = int.from_bytes(h.digest(), "little", signed=True)
            within[id(node)] = inside
    return found, within


def _links(node: Node) -> tuple[int, int, int]:
    """(letters, letters in links, links) below an element."""
    total = linked = links = 0
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            n = len(x.strip())
            total += n
            linked += n * inside
        elif x.tag not in UNSEEN:
            links += x.tag == "a"
            stack += [(c, inside or x.tag == "a") for c in x.children]
    return total, linked, links


def _menu(node: Node) -> bool:
    if node.tag not in ("ul", "ol", "div", "table", "section", "p"):
        return False
    total, linked, links = _links(node)
    return links >= 3 and linked >= 0.8 * total


#: Words of names that never belong to a part around the article, however much text it has.
REPLIES = frozenset("comment comments respond disqus replies".split())


def _holders(root: Node) -> set[int]:
    """Elements that lie around an article or main element, by Python id."""
    out: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            while node is not None and id(node) not in out:
                out.add(id(node))
                node = node.parent
        else:
            stack += [c for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN]
    return out


def _bulk(root: Node) -> set[int]:
    """Elements with more than half of the page's letters, but for readers' comments; by Python id."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN]
    letters: dict[int, int] = {}
    for node in reversed(order):
        letters[id(node)] = sum(len(c.strip()) if isinstance(c, str) else letters.get(id(c), 0) for c in node.children)
    most = letters[id(root)] / 2
    replies = lambda node: any(t.lower() in REPLIES for t in _TOKEN.findall(node.about))
    return {id(n) for n in order if letters[id(n)] > most and not replies(n)}


def blocks(root: Node, template: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks of the article (or articles), in page order; of the body if there is none.

    Names and forms leave out no element that holds the only articles of a page, nor, where there is no article, one that holds
    most of its text.
    """
    found = hashes(root)[0] if template else {}
    stays: set[int] = set()
    dropped = lambda node, inside: (node.tag in UNSEEN or id(node) not in stays and around(node, inside)
                                    or found.get(id(node)) in template or not inside and _menu(node))

    def gather(kind: tuple[str, ...]) -> list[Node]:
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag in kind:
                out.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Node) and not dropped(c, False)]
        return out

    tops = gather(("article",)) or gather(("main",))
    if not tops and (stays := _holders(root)):
        tops = gather(("article",)) or gather(("main",))
    article = bool(tops)
    if not article:
        tops, stays = [root], _bulk(root)
    out: list[str] = []
    line: list[str] = []

    def end():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    for top in tops:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x is not top and dropped(x, article):
                if x.tag in BLOCK:
                    end()
            elif x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                end()
                stack += [None, *reversed(x.children)]
            else:
                stack += reversed(x.children)
        end()
    return out


def _subtrees(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for key, host, html in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html"))):
            root = parse(html)
            found, within = hashes(root)
            page = found.get(id(root), 0)
            seen = {}
            stack: list[Node] = [root]
            while stack:
                node = stack.pop()
                stack += [c for c in node.children if isinstance(c, Node)]
                h = found.get(id(node))
                # The page itself, its article and the prose in it are never template.
                if h is not None and node.tag not in ("html", "body", "article", "main") and not (within[id(node)] and node.tag in PROSE):
                    seen[h] = min(seen.get(h, 1), within[id(node)])
            rows += [(key, host, page, h, bool(inside)) for h, inside in seen.items()]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                         names=["key", "host", "page", "subtree", "inside"])


def _texts(batches):
    import pyarrow as pa

    for batch in batches:
        texts = ["\n".join(blocks(parse(html), set(gone or ())))
                 for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         names=["page_id", "url", "text"])


def templates(subtrees: DataFrame) -> DataFrame:
    """Rows (host, subtree) of what recurs on PAGES different pages of a host.

    Copies of a page count once. Inside an article a subtree also has to be on ARTICLE_SHARE of the host's pages.
    Every step combines before the exchange, so a host with a third of all pages is no larger group than others.
    """
    each = subtrees.groupBy("host", "subtree", "page").agg(F.min("inside").alias("inside"))
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("pages"), F.min("inside").alias("inside"))
    pages = each.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all_pages"))
    often = counts.filter(F.col("pages") >= PAGES).join(pages, "host")
    return often.filter(~F.col("inside") | (F.col("pages") >= ARTICLE_SHARE * F.col("all_pages"))).select("host", "subtree")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text), one for each row of ``pages``.

    Blocks of the article in page order, joined by a line feed; white space in a block is one space. A null html is
    empty, a page without article gives the blocks of its body, broken markup gives what can be read of it. Pages
    without host share the empty one; repeated rows get equal texts. An empty table gives no rows.
    """
    key = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))
    host = host_and_path(F.col(url_col))[0]
    rows = pages.select(key.alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    subtrees = materialize(rows.select("key", "host", "html").mapInArrow(
        _subtrees, "key long, host string, page long, subtree long, inside boolean"), "subtrees")
    often = materialize(templates(subtrees), "template")
    gone = subtrees.join(often, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("gone"))
    marked = rows.join(gone, "key", "left").select("page_id", "url", "html", "gone")
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema.fields}
    return marked.mapInArrow(_texts, f"page_id {kinds['page_id']}, url string, text string")
