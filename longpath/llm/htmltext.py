"""Main text of web pages by a site style tree.

* parse: a page becomes a tree of elements (end tags that may be left out are supplied; comments, declarations and the
  contents of script, style and the like are no text). Time grows with the length of the page, however broken it is.
* merge: the trees of one host are laid over each other: elements with the same path of tags and classes are one style
  node (paths are told apart down to ``DEPTH`` levels). So are, once more, the trees of all hosts, for templates that many hosts share.
* importance: for every style node Spark counts on how many pages each presentation (its children's tags) and each piece of
  content (a run of text between separators) stands. Of m pages with the node, a piece on k pages has entropy log k / log m:
  0 if it is found nowhere else, 1 if every page has it. The content importance of a node is 1 less the mean entropy of
  the pieces below it, links counting ``links`` less; its presentation importance is likewise 1 less the
  mean entropy of its presentations (for one a page, that is their entropy to base m). With l children on average and g = ``decay``, importance is (1 - g^l) presentation + g^l content. It is taken
  relative to the site's mean content importance by characters, so a site whose articles repeat is not emptied. A node on one
  page has nothing to be compared with and is not judged; from two on the entropies say the same at any number of pages. The score of a path is the lower one of host and all hosts.
* removal: a branch goes if the score of its node and of all nodes below is less than what its place asks for:
  ``inside`` for those inside of an article or main element (its headings stay), ``plain`` where a page has no such element. If it has one,
  what stands outside has to score ``outside`` itself. Names break ties: a class or id that says menu, advert and so on asks for ``named``
  (inside of articles only names that articles don't use for their own parts do, others for ``weak``). What is not judged goes if it is outside of the
  article or so named: there its place is all that is known.
  No name removes an element around an article. What HTML itself calls navigation, footer, header (outside of articles), aside,
  form, menu or hidden goes, and so do reader comments (also as article elements), which no repetition tells from the text.
  A form of more than ``PROSE`` words a control is a wrapper around the page, not a form. A page that the tree would leave empty (one of many copies, say) is
  judged by HTML and names alone; if they leave nothing, its text is empty.
* text: character references are decoded; each block's white space becomes single spaces; blocks are trimmed, empty ones left out, and
  joined by one line end in page order.

The host is the part of the URL between :// and the next /, ?, # or :, in lower case, without user. A null URL is a host of its own. Null or
empty html: empty text. Equal rows give equal results. Only a host's judged paths reach its pages again: a
broadcast when their number is small, else a join on host with hot hosts dealt over ``salts`` parts.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import kernel, stored

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption".split())
CLOSED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
    "tbody": frozenset(("tr", "td", "th", "thead", "tbody")), "tfoot": frozenset(("tr", "td", "th", "tbody")),
}
WALL = frozenset("ul ol dl table article section div body html main aside nav td th".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select textarea input label script style noscript template iframe svg canvas object embed audio video head title".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side aside widget widgets comment comments respond reply replies discussion disqus menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer foot bottom share sharing social related recommended newsletter subscribe subscription signup login search toolbar tags copyright legal hidden".split()
)
# Names that headings, sections and titles of an article also have: inside of one they need the style tree's word.
WEAK_NAMES = frozenset("side aside notice notices alert respond reply replies discussion header masthead foot footer bottom related recommended search tags legal login signup promotion".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
KEEP_TAGS = frozenset(("html", "body", "article", "main"))
COMMENT_NAMES = frozenset(("comment", "comments", "disqus"))
SEPARATOR = re.compile("[\u00b7\u2022|\u00bb\u00ab\u2013\u2014]+")
ATTRIBUTES = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
CONTROLS = frozenset("input select textarea button".split())
PROSE = 40  # words a control
DEPTH, STEP = 48, 5  # levels of a path, and bytes for each


@dataclass(slots=True)
class Node:
    tag: str
    names: str = ""
    noise: bool = False  # by role or as hidden
    named: int = 0  # noise by class or id: 1 a part of a name, 2 a whole name outside of articles, 3 a whole name anywhere
    comment: bool = False  # reader comments by name
    holds: bool = False  # an article or main element
    parts: list = field(default_factory=list)  # strings and nodes


def _attributes(tag: str, raw: str) -> tuple[str, bool, int, bool]:
    """Class names, sorted, whether role or style mark noise, how far names do (see Node.named), and whether they say reader comments."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return "", False, 0, False
    names, noise, named, comment = [], False, 0, False
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            words = value.lower().split()
            if key == "class":
                names += words
            elif tag in HEADINGS:
                continue  # the target of a link
            for w in words:
                parts = [x for x in re.split(r"[-_\d]+", w) if x]
                if parts and all(x in NOISE_NAMES for x in parts):
                    named = max(named, 2 if key == "id" or all(x in WEAK_NAMES for x in parts) else 3)
                elif any(x in NOISE_NAMES for x in parts):
                    named = max(named, 1)
                comment = comment or bool(parts) and parts[0] in COMMENT_NAMES
        elif key == "role":
            noise = noise or value.lower() in NOISE_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            noise = True
        elif key == "style" and re.search(r"display\s*:\s*none", value):
            noise = True
    return ".".join(sorted(set(names))), noise, named, comment


class Stack:
    """The open elements, with how many of each tag there are, in all and above the last one of WALL."""

    def __init__(self, root: Node):
        self.nodes, self.open, self.scopes = [root], {}, [{}]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1
        if node.tag in WALL:
            self.scopes.append({})
        else:
            self.scopes[-1][node.tag] = self.scopes[-1].get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.open[node.tag] -= 1
        if node.tag in WALL:
            self.scopes.pop()
        else:
            self.scopes[-1][node.tag] -= 1
        return node

    def close(self, tags: frozenset[str], through_walls: bool = False) -> bool:
        """Closes the innermost element of these tags, if there is one this side of a wall (or at all)."""
        if not any(self.scopes[-1].get(x) for x in tags):
            wall = len(self.scopes) > 1 and next((x.tag for x in reversed(self.nodes) if x.tag in WALL), "") in tags if tags & WALL and not through_walls else False
            if not wall and not (through_walls and any(self.open.get(x) for x in tags)):
                return False
        while len(self.nodes) > 1 and self.pop().tag not in tags:
            pass
        return True


def parse(text: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at, n = Stack(root), 0, len(text)
    last = text.rfind(">")
    quotes = True  # a page whose quotes don't end is read without them from there on

    while at < n:
        begin = text.find("<", at)
        while 0 <= begin and not (text.startswith(("!", "?"), begin + 1) or TAG.match(text, begin + 1)):
            begin = text.find("<", begin + 1)
        if begin < 0 or begin > last and not text.startswith(("!", "?"), begin + 1):
            stack.nodes[-1].parts.append(text[at:])
            break
        if begin > at:
            stack.nodes[-1].parts.append(text[at:begin])
        if text.startswith("<!--", begin):
            ends = [x for x in (text.find("-->", begin + 4), text.find("--!>", begin + 4)) if x >= 0]
            at = text.index(">", min(ends)) + 1 if ends else n
            continue
        if text.startswith("<![CDATA[", begin):
            end = text.find("]]>", begin)
            stack.nodes[-1].parts.append(_html.escape(text[begin + 9 : end if end >= 0 else n]))
            at = end + 3 if end >= 0 else n
            continue
        if text[begin + 1] in "!?":
            end = text.find(">", begin)
            at = end + 1 if end >= 0 else n
            continue
        name = TAG.match(text, begin + 1)
        found = ATTRIBUTES.match(text, name.end()) if quotes else None
        if found:
            at = found.end()
        else:
            quotes, at = False, text.index(">", name.end() - 1) + 1
        raw, tag = text[name.end() : at - 1], name[2].lower()
        if name[1]:
            if tag == "p" and not stack.open.get("p"):
                stack.nodes[-1].parts.append(Node("p"))
            stack.close(frozenset((tag,)), tag in BLOCK)
            continue
        if tag in CLOSES_P:
            stack.close(frozenset(("p",)))
        if tag in CLOSED_BY:
            while stack.close(CLOSED_BY[tag]) and any(x.tag in CLOSED_BY[tag] for x in stack.nodes[-2:]):
                pass
        node = Node(tag, *_attributes(tag, raw))
        if tag in ("article", "main") and not node.comment:
            for x in reversed(stack.nodes):
                if x.holds:
                    break
                x.holds = True
        stack.nodes[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.IGNORECASE).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID and not (raw.endswith("/") and tag == "svg"):
            stack.push(node)
    return root


_steps: dict[tuple[str, str], bytes] = {}


def step_of(node: Node) -> bytes:
    """A style node's part of a path: tag and classes, hashed."""
    key = node.tag, node.names
    if key not in _steps:
        if len(_steps) > 100_000:
            _steps.clear()
        _steps[key] = hashlib.blake2b(f"{node.tag}.{node.names}".encode("utf-8", "replace"), digest_size=STEP).digest()
    return _steps[key]


def walk(root: Node) -> list[tuple[Node, int, bytes]]:
    """Node, number of its parent and path of all elements, parents first."""
    out, todo = [], [(root, -1, b"")]
    while todo:
        node, parent, path = todo.pop()
        me = len(out)
        out.append((node, parent, path))
        for x in reversed(node.parts):
            if not isinstance(x, str):
                todo.append((x, me, path if len(path) >= DEPTH * STEP else path + step_of(x)))
    return out


def judged(node: Node) -> bool:
    return node.tag in BLOCK and node.tag not in KEEP_TAGS


def runs(root: Node) -> list[tuple[bytes, str, int]]:
    """Path of the nearest block, text and characters in links of every run of text that no block interrupts."""
    out, todo, run, linked = [], [(root, b"", b"", False)], [], 0

    def flush(path: bytes) -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(run)).split()) if run else ""
        if text:
            out.append((path, text, min(linked, len(text))))
        run.clear()
        linked = 0

    while todo:
        node, path, block, link = todo.pop()
        if node is None:
            flush(block)
        elif isinstance(node, str):
            run.append(node)
            linked += len(node) if link else 0
        elif node.tag not in RAW and node.tag not in VOID:
            inner, link = block, link or node.tag == "a"
            if node.tag in BLOCK:
                flush(block)
                inner = path
                todo.append((None, b"", inner, False))
            todo.extend((x, b"" if isinstance(x, str) else path if len(path) >= DEPTH * STEP else path + step_of(x), inner, link) for x in reversed(node.parts))
        elif node.tag == "br":
            run.append(" ")
    flush(b"")
    return out


def style_rows(root: Node) -> list[tuple[bytes, bool, int, int, bool, int, int]]:
    """(path, whether content, value, count, whether the path's first on the page, children or characters, characters in links) of a page.

    Presentations count as often as they stand; a piece of content counts once.
    """

    def number(x: str) -> int:
        return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)

    looks: dict[tuple[bytes, str], list[int]] = {}
    for node, _, path in walk(root):
        if judged(node):
            tags = [x.tag for x in node.parts if not isinstance(x, str)]
            row = looks.setdefault((path, ",".join(tags)), [0, len(tags)])
            row[0] += 1
    seen, out = set(), []
    for (path, look), (n, children) in looks.items():
        out.append((path, False, number(look), n, path not in seen, n * children, 0))
        seen.add(path)
    texts: dict[tuple[bytes, str], list[int]] = {}
    for path, text, linked in runs(root):
        if path in seen:
            for piece in SEPARATOR.split(text):
                if piece := piece.strip():
                    row = texts.setdefault((path, piece), [0, 0])
                    row[0] += len(piece)
                    row[1] += round(len(piece) * linked / len(text))
    return out + [(path, True, number(piece), 1, False, size, linked) for (path, piece), (size, linked) in texts.items()]


@dataclass(frozen=True)
class Asks:
    """Scores that places ask for."""

    inside: float = 0.2
    plain: float = 0.65
    outside: float = 0.9
    named: float = 0.98
    weak: float = 0.3


def main_text(page: str, scores: dict[bytes, tuple[float, int]] | None = None, asks: Asks = Asks(), names: bool = True) -> str:
    """The text blocks of a page without the branches that go (see above); scores: score and pages of judged paths."""
    root = parse(page)
    nodes = walk(root)
    wrappers = _wrappers(nodes)
    return _text(nodes, scores or {}, asks, names, wrappers) or (_text(nodes, {}, asks, names, wrappers) if scores else "")


def _wrappers(nodes: list[tuple[Node, int, bytes]]) -> set[int]:
    """Forms that hold more than PROSE words a control (of those that have any)."""
    forms = [i for i, (node, _, _) in enumerate(nodes) if node.tag == "form"]
    if not forms:
        return set()
    words, controls = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node, up, _ = nodes[i]
        if node.tag in CONTROLS:
            words[i], controls[i] = 0, 1
        elif node.tag not in RAW:
            words[i] += sum(len(x.split()) for x in node.parts if isinstance(x, str))
        if up >= 0:
            words[up] += words[i]
            controls[up] += controls[i]
    return {i for i in forms if words[i] > PROSE * max(controls[i], 1)}


def _text(nodes: list[tuple[Node, int, bytes]], scores: dict[bytes, tuple[float, int]], asks: Asks, names: bool, wrappers: set[int]) -> str:
    n = len(nodes)
    gone, within, body = [False] * n, [False] * n, [False] * n  # body: an article or main that is the page's own
    for tag in ("article", "main"):
        for i, (node, up, _) in enumerate(nodes):
            gone[i] = up >= 0 and gone[up] or node.comment or i not in wrappers and _by_html(node, within[up] if up >= 0 else False)
            body[i] = node.tag == tag and not gone[i]
            within[i] = body[i] or up >= 0 and within[up]
        if any(body):
            break
    has = any(body)
    found = [scores.get(path) if judged(node) else None for node, _, path in nodes]
    own = [x[0] if x else None for x in found]
    best = [x if x is not None else 1.0 if judged(node) else -1.0 for x, (node, _, _) in zip(own, nodes, strict=True)]
    for i in range(n - 1, 0, -1):
        best[nodes[i][1]] = max(best[nodes[i][1]], best[i])
    around = [body[i] or within[i] for i in range(n)]  # holds what is the page's own, or is of it
    for i in range(n - 1, 0, -1):
        around[nodes[i][1]] = around[nodes[i][1]] or around[i]

    def beneath(x: float | None, least: float) -> bool:
        return x is None or x < least

    drop = [False] * n
    for i, (node, up, _) in enumerate(nodes):
        by = node.named if names else 0
        if gone[i] or up >= 0 and drop[up]:
            drop[i] = True
        elif within[i]:
            if body[i] or node.tag in KEEP_TAGS:
                continue
            low = own[i] is not None and (by > 0 and own[i] < asks.weak or node.tag not in HEADINGS and best[i] < asks.inside)
            drop[i] = low or by == 3 and beneath(own[i], asks.named)
        elif has and not around[i]:
            if judged(node):
                drop[i] = beneath(own[i], asks.named if by >= 2 else asks.outside)
            else:  # inline elements stay with a block that stays
                drop[i] = node.tag in KEEP_TAGS or around[up]
        elif not around[i] and node.tag not in KEEP_TAGS:
            drop[i] = by >= 2 and beneath(own[i], asks.named) or own[i] is not None and best[i] < asks.plain
    return _joined(nodes, drop, has, within)


def _by_html(node: Node, within: bool) -> bool:
    """Whether HTML itself says noise. A header inside of an article holds its title and stays, and so does a form around it."""
    if node.tag in KEEP_TAGS:
        return False
    if node.tag == "form":
        return not node.holds
    return node.tag in NOISE_TAGS or node.noise or node.tag == "header" and not within and not node.holds


def _joined(nodes: list[tuple[Node, int, bytes]], drop: list[bool], has: bool, within: list[bool]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = " ".join(_html.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run.clear()

    number = {id(node): i for i, (node, _, _) in enumerate(nodes)}
    todo: list = [(nodes[0][0], False)]
    while todo:
        x, bare = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not bare:
                run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif drop[i := number[id(x)]]:
            if x.tag in BLOCK:
                flush()
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((None, False))
            bare = has and x.holds and not within[i]  # text beside the article
            todo.extend((c, bare) for c in reversed(x.parts))
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _importance(counts: DataFrame, links: float, decay: float) -> DataFrame:
    """host, path, pages, presentation, content, importance and score of every style node, from host, path, content, value, n, k (pages that have it), pages, size and linked."""
    content, n = F.col("content"), F.col("n")
    per = counts.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum(F.when(~content, n)).alias("stands"), F.sum(F.when(~content, n * F.log2("k"))).alias("s_look"), F.sum(F.when(~content, F.col("size"))).alias("children"),
        F.count_if(content).alias("pieces"), F.coalesce(F.sum(F.when(content, F.log2("n"))), F.lit(0.0)).alias("s_piece"),
        F.coalesce(F.sum(F.when(content, F.col("size"))), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(content, F.col("linked"))), F.lit(0)).alias("linked"),
    )
    m = F.log2(F.greatest("pages", F.lit(2)))
    per = per.select(
        "host", "path", "pages", "pieces", "chars", "linked", (F.col("children") / F.col("stands")).alias("l"), (F.col("s_piece") / m).alias("entropy"),
        F.when(F.col("pages") > 1, 1 - F.col("s_look") / F.col("stands") / m).otherwise(1.0).alias("presentation"),
    )
    site = per.groupBy("host").agg((F.sum(F.when(F.col("pieces") > 0, F.col("chars") * (1 - F.col("entropy") / F.col("pieces")))) / F.sum("chars")).alias("mean"))
    # a node's pieces are those of all nodes below: of the paths that its path begins
    up = per.withColumn("own", F.explode(F.transform(F.sequence(F.lit(1), (F.length("path") / STEP).cast("int")), lambda i: F.substr("path", F.lit(1), i * STEP))))
    me = F.col("own") == F.col("path")
    tree = up.groupBy("host", "own").agg(
        *[F.max(F.when(me, F.col(c))).alias(c) for c in ("pages", "presentation", "l")], F.sum("pieces").alias("pieces"), F.sum("entropy").alias("entropy"), F.sum("linked").alias("linked"), F.sum("chars").alias("chars")
    )
    weight = F.pow(F.lit(decay), F.col("l"))
    value = (1 - F.col("entropy") / F.greatest("pieces", F.lit(1))) * (1 - links * F.col("linked") / F.greatest("chars", F.lit(1)))
    tree = tree.where("pages is not null").withColumn("contents", value).withColumn("importance", (1 - weight) * F.col("presentation") + weight * F.col("contents"))
    out = tree.join(site, "host").withColumn("score", F.col("importance") / F.greatest(F.coalesce("mean", F.lit(1.0)), F.lit(1e-9)))
    return out.select("host", F.col("own").alias("path"), "pages", "presentation", "contents", "importance", "score")


def style_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """How often each presentation and piece of content stands in each style node of each host."""

    def make():
        names = ("host", "path", "content", "value", "n", "pages", "size", "linked")

        def f(batch: pa.RecordBatch) -> dict:
            hosts, rows = batch.column("host").to_pylist(), [style_rows(parse(x.as_py() or "")) for x in batch.column("html")]
            flat = [(h, *r) for h, part in zip(hosts, rows, strict=True) for r in part]
            return {n: [r[i] for r in flat] for i, n in enumerate(names)}

        return f

    rows = kernel(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), make, "host string, path binary, content boolean, value bigint, n bigint, pages boolean, size bigint, linked bigint", text="html")
    return rows.groupBy("host", "path", "content", "value").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.count_if("pages").alias("pages"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", few: int = 2, links: float = 0.3, decay: float = 0.9) -> DataFrame:
    """host, path, pages, presentation, contents and importance (on the host), score (the lower one of host and all hosts; null if not judged) and all_pages."""
    counts = stored(style_counts(pages, url_col, html_col), "html-counts")
    own = _importance(counts, links, decay)
    common = counts.groupBy("path", "content", "value").agg(*[F.sum(c).alias(c) for c in ("n", "k", "pages", "size", "linked")]).withColumn("host", F.lit(""))
    common = _importance(common, links, decay).where(F.col("pages") >= few).select("path", F.col("score").alias("common"), F.col("pages").alias("all_pages"))
    both = own.join(common, "path", "left").withColumn("score", F.when(F.col("pages") >= few, F.col("score")))
    return both.withColumns({"score": F.least("score", "common"), "all_pages": F.coalesce("all_pages", "pages")}).drop("common")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = 20_000, salts: int = 64, few: int = 2, names: bool = True, asks: Asks = Asks()) -> DataFrame:
    """id, url, text and n_chars (code points) of each page's main text; names: whether class and id names break ties."""
    tree = style_tree(pages, url_col, html_col, few).where("score is not null").select("host", "path", "score", "all_pages")
    tree = stored(tree, "html-scores")
    paths = tree.groupBy("host").agg(F.collect_list(F.struct("path", "score", "all_pages")).alias("scores"))  # bounded by the site's style nodes
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    if tree.count() <= small:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
        paths = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", salt).join(paths, ["host", "salt"], "left")

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts, last, scores = [], None, {}
            for x, host, y in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("scores"), strict=True):
                if last is None or host != last:
                    last, scores = host, {z["path"]: (z["score"], z["all_pages"]) for z in y.as_py() or ()}
                texts.append(main_text(x.as_py() or "", scores, asks, names))
            return {id_col: batch.column(id_col), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    kind = pages.schema[id_col].dataType.simpleString()
    return kernel(rows.select(id_col, "url", "host", "html", "scores"), make, f"`{id_col}` {kind}, url string, text string, n_chars bigint", text="html")
