"""Main text of web pages by consensus of a host's pages.

Each page is read into a tree, and its containers are scored: how much of the page's running text a
container has, less the part of its own text that is links or boilerplate. The best containers vote with
their generalised tag-class path (numbers in class names become ``#``); Spark adds the votes up per host,
and the page is read again with the path that its host has chosen. A page without that path keeps its own
best container.

The text is the container's blocks in page order, without menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, hidden parts and reader comments. A null or empty page has the text "".
Pages without a host vote among themselves. Repeated rows vote and are returned as often as they occur.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import map_texts, materialize

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg select".split())
#: Of these, the ones without an end tag of their own end with their parent.
MARKUP = RAW - frozenset("script style xmp".split())
NESTS = frozenset("svg template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body caption dd dt html li legend tbody td tfoot th thead tr".split())
#: Start tag: open elements of these names end, but not beyond the limits.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "p": ({"p"}, {"table", "td", "th", "button", "html", "caption"}),
}
CONTAINERS = frozenset("article body center div main section td".split())
DROPPED = frozenset("aside button dialog fieldset footer form head label menu nav object search audio video canvas annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Class and id words that mean boilerplate wherever they stand in a name ...
ANYWHERE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr "
    "menu modal nav navbar navigation newsletter overlay paywall popup popover promo promoted promotion recommended related sidebar signup "
    "social sponsor sponsored subscribe toolbar".split()
)
#: ... and those that mean it at its end.
AT_END = frozenset("alert banner disclaimer discussion footer form header login masthead notice notices pager pagination replies reply respond search share sharing skip topbar widget widgets".split())
WITHOUT = frozenset("with has no without is js".split())
#: Words that articles use as well: with others than those of a page's frame beside them, links decide. So they do for a discussion.
DOUBTFUL = AT_END | {"recommended", "related", "social"}
FRAME = frozenset("bar bottom box container div global inner left list main outer page right site top web website wrap wrapper".split())

#: Elements that can belong to an article next to the container of its body.
TEXTS = HEADINGS | frozenset("p blockquote figure ul ol dl pre table".split())
LITTLE = 50  # an element with less than this part of the running text of the page's own best one holds no article

DEPTH = 250  # elements nested deeper are read as if beside one another

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "names", "parent", "inside", "drop", "good", "all", "boxed", "path", "id", "doubt")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.inside, self.good, self.all, self.boxed, self.path = tag, parent, [], 0, 0, 0, None
        self.id, self.doubt = "", False
        found = {}
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
        self.names = found.get("class", "")
        self.drop = bool(parent and parent.drop) or tag in DROPPED or _hidden(found) or found.get("role", "").lower() in ROLES
        if not self.drop and tag not in ("html", "body", "main", "article"):
            classes, ids = self.names.split(), [] if tag == "p" or tag in HEADINGS else found.get("id", "").split()
            bad = [x for x in classes + ids if boilerplate(x)]
            self.drop = any(not doubtful(x) for x in bad if x in classes or len(_WORD.findall(x)) < 2)
            self.doubt, self.id = bool(bad) and not self.drop, next((x for x in bad if x not in classes and not doubtful(x)), "")
        if not self.drop and tag == "header":
            up = parent
            while up and up.tag not in ("article", "main"):
                up = up.parent
            self.drop = up is None


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(found.get("style")) and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found["style"], re.I))


_KNOWN: dict[str, bool] = {}


def boilerplate(name: str) -> bool:
    """Whether a class name or id says that its element is no part of an article."""
    found = _KNOWN.get(name)
    if found is None:
        words = [w.lower() for w in _WORD.findall(name)]
        for k, w in enumerate(words):
            if w in WITHOUT:
                words = words[:k]
                break
        words = [w for w in words if not w.isdigit()]
        found = any(w in ANYWHERE for w in words) or bool(words) and words[-1] in AT_END and not (words[-1] == "header" and len(words) > 1 and words[-2] in ("article", "post", "entry", "story"))
        if len(_KNOWN) > 50_000:
            _KNOWN.clear()
        _KNOWN[name] = found
    return found


def doubtful(name: str) -> bool:
    """Whether a name that means boilerplate may be an article's as well."""
    words = [w for x in _WORD.findall(name) if not (w := x.lower()).isdigit()]
    if any(w in ANYWHERE and w not in DOUBTFUL for w in words):
        return False
    return words == ["discussion"] or any(w not in ANYWHERE and w not in AT_END and w not in FRAME for w in words)


def _settle(node: Node):
    """Drops an element of doubtful names if half of its text is links, or if its id is bad and not made from its heading."""
    sizes, heading = [0, 0], []

    def walk(x: Node, link: bool, title: list | None):
        for y in x.inside:
            if isinstance(y, str):
                sizes[0] += len(y.strip())
                sizes[1] += len(y.strip()) if link else 0
                if title is not None:
                    title.append(y)
            elif y.tag in HEADINGS and not heading:
                heading.append([])
                walk(y, link or y.tag == "a", heading[0])
            else:
                walk(y, link or y.tag == "a", title)

    def drop(x: Node):
        x.drop = True
        for y in x.inside:
            if not isinstance(y, str):
                drop(y)

    walk(node, False, None)
    title = entities.unescape("".join(heading[0])) if heading else ""
    made = [w.lower() for w in re.findall(r"\w+", title)] == [w.lower() for w in re.findall(r"[^\W_]+", node.id)]
    if node.id and not made or 2 * sizes[1] >= sizes[0]:
        drop(node)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as browsers do."""
    root = Node("html", None, "")
    stack, at, n, low, unopened, ends, doubts = [root], 0, len(page), None, {}, {}, []
    last = page.rfind(">")
    while at < n:
        m = _TOKEN.search(page, at) if at < last or page.startswith("<!--", at) else None
        if m is None:
            stack[-1].inside.append(page[at:])
            break
        if m.start() > at:
            stack[-1].inside.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if unopened.get(tag):
                unopened[tag] -= 1
            else:
                _close(stack, tag)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                if low is None:
                    low = page.lower()
                end = ends.get(tag, 0)
                if 0 <= end < at:
                    end = ends[tag] = low.find(f"</{tag}", at)
                if tag in MARKUP and (end < 0 or tag not in NESTS and low.find(f"<{tag}", at, end) >= 0):
                    node = Node(tag, stack[-1], "hidden")
                    stack[-1].inside.append(node)
                    if len(stack) < DEPTH:
                        stack.append(node)
                else:
                    at = n if end < 0 else (low.find(">", end) + 1 or n)
            continue
        if tag in ("html", "body", "head") and any(x.tag == tag for x in stack):
            continue
        if tag in ENDS_P:
            _end(stack, *SIBLINGS["p"])
        if tag in SIBLINGS and tag != "p":
            _end(stack, *SIBLINGS[tag])
        if tag in BLOCK and "head" in (stack[-1].tag, stack[-2].tag if stack[-1].tag in RAW else ""):
            del stack[-1 if stack[-1].tag == "head" else -2 :]
        node = Node(tag, stack[-1], attributes)
        stack[-1].inside.append(node)
        if node.doubt:
            doubts.append(node)
        if tag in VOID:
            continue
        if len(stack) < DEPTH:
            stack.append(node)
        else:
            unopened[tag] = unopened.get(tag, 0) + 1
    for node in doubts:
        if not node.drop:
            _settle(node)
    return root


def _end(stack: list[Node], names: set[str], limits: set[str]):
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            if names == {"p"}:
                return
            return _end(stack, names, limits)
        if stack[k].tag in limits:
            return


def _close(stack: list[Node], tag: str):
    special = tag in BLOCK
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            if tag not in ("body", "html"):  # what follows them still belongs to the page
                del stack[k:]
            return
        if not special and stack[k].tag in BLOCK or special and stack[k].tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            return


def measure(node: Node, link: bool = False) -> int:
    """Sets, for each element, its characters of running text, of those the ones in inner containers, and of any text.

    Returns the characters of links.
    """
    links = 0
    link = link or node.tag == "a"
    for x in node.inside:
        if isinstance(x, str):
            size = len(x) - x.count(" ") - x.count("\n")
            node.all += size
            if link:
                links += size
            elif not node.drop:
                node.good += size
        else:
            links += measure(x, link)
            node.all += x.all
            node.good += x.good
            node.boxed += x.good if x.tag in CONTAINERS else x.boxed
    return links


def containers(root: Node):
    """(score in thousandths, depth, node) of each container that may hold the article.

    A mere wrapper, with hardly any text beside its inner containers, counts less than one that has text of its own.
    """
    total = root.good
    if not total:
        return
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node.tag in CONTAINERS and not node.drop and node.good:
            wraps = node.tag not in ("article", "main") and 100 * (node.good - node.boxed) < node.good
            yield round((750 if wraps else 1000) * node.good / total - 1000 * (1 - node.good / node.all)), depth, node
        todo += [(x, depth + 1) for x in reversed(node.inside) if not isinstance(x, str) and x.good * 5 > total]


def path(node: Node) -> str:
    if node.path is None:
        own = ".".join([node.tag, *sorted({_DIGITS.sub("#", c) for c in node.names.split()})])
        node.path = f"{path(node.parent)}>{own}" if node.parent else own
    return node.path


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under a container, white space made one."""
    out, run = [], []

    def close():
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    def walk(x: Node):
        if x.drop and x is not node:
            if x.tag in BLOCK:
                close()
            else:
                run.append(" ")
            return
        block = x.tag in BLOCK
        if block:
            close()
        elif x.tag == "br":
            run.append(" ")
        for y in x.inside:
            if isinstance(y, str):
                run.append(y)
            else:
                walk(y)
        if block:
            close()

    walk(node)
    close()
    return out


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _best(root: Node) -> Node:
    return max(containers(root), key=lambda c: (c[0], c[1]), default=(0, 0, root))[2]


def _find(root: Node, wanted: str) -> list[Node]:
    """All elements at a generalised path in page order, if any of them has running text."""
    level = [root] if wanted.split(">")[0] == path(root) else []
    steps = wanted.count(">")
    for _ in range(steps):
        level = [y for x in level for y in x.inside if not isinstance(y, str) and not y.drop and (wanted == path(y) or wanted.startswith(path(y) + ">"))]
    return level if any(x.good for x in level) else []


def _beside(node: Node) -> bool:
    """Whether an element next to the article's container is text of its own and no container: a headline or a paragraph, say."""
    return not node.drop and node.tag in TEXTS and 2 * node.good >= node.all > 0


def _climb(chosen: list[Node]) -> list[Node]:
    """``chosen`` with the headlines and paragraphs that stand directly in the containers around it, in page order.

    Other containers beside it have paths of their own, which the host has not chosen. Directly in the
    body only headlines before the article are taken.
    """
    if not chosen or any(x.parent is None for x in chosen):
        return chosen
    up = chosen[0].parent
    while up is not None and any(up not in _above(x) for x in chosen[1:]):
        up = up.parent
    inner, out = set(map(id, chosen)), chosen
    while up is not None and up.tag != "html" and not up.drop:
        taken, seen = [], False
        for x in up.inside:
            if isinstance(x, str):
                continue
            own = [y for y in out if y is x or x in _above(y)]
            seen = seen or bool(own)
            if own:
                taken += own
            elif _beside(x) and (up.tag != "body" or x.tag in HEADINGS and not seen):
                taken.append(x)
        out, up = taken, up.parent
    return out if inner <= set(map(id, out)) else chosen


def _above(node: Node) -> list[Node]:
    found = []
    while (node := node.parent) is not None:
        found.append(node)
    return found


def read(page: str) -> Node:
    root = parse(page)
    measure(root)
    return root


def text_of(page: str, wanted: str | None) -> str:
    """The main text of a page, taken at its host's path where it has that."""
    root = read(page)
    chosen, best = _find(root, wanted) if wanted else [], _best(root)
    if LITTLE * sum(x.good for x in chosen) < best.good:  # the host's place is as good as empty here
        chosen = [best]
    return "\n\n".join(t for node in _climb(chosen or [best]) for t in blocks(node))


def ballots(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, depth, score): what the containers of each page stand for."""

    def run(batch):
        rows = []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            at = host(url)
            found = list(containers(read(page)))
            most = max((s for s, _, _ in found), default=0)
            rows += [(at, path(n), d, s) for s, d, n in found if s > 0 and 2 * s >= most]
        return dict(zip(("host", "path", "depth", "score"), zip(*rows))) if rows else {k: [] for k in ("host", "path", "depth", "score")}

    return map_texts(pages.select(F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")), run, "host string, path string, depth long, score long", "html")


def winners(votes: DataFrame) -> DataFrame:
    """(host, path): the path with the highest score over all pages of the host; the deeper one among equals."""
    sums = votes.groupBy("host", "path", "depth").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("score", "depth", "path"))["path"].alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    chosen = materialize(winners(ballots(pages, url_col, html_col)), "paths")

    def hosts(batch):
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "html": batch.column("html"), "host": [host(u) for u in batch.column("url").to_pylist()]}

    def run(batch):
        texts = [text_of(p, w) for p, w in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    named = map_texts(own, hosts, "page_id long, url string, html string, host string", "html")
    # few hosts: the written table is small enough for Spark to broadcast; many: a join whose large hosts Spark splits
    return map_texts(named.join(chosen, "host", "left"), run, "page_id long, url string, text string, n_chars long", "html")
