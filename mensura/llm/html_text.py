"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching.  A page's DOM is first reduced to an
outline, in which siblings of one kind count once.  The host's most frequent outline is
its exemplar; every outline of the host is matched with it, and what stands at each of its
nodes is combined over the pages: a node with one text everywhere is template, one whose
text varies is a slot.  The wrapper names the nodes that hold the content: the outermost
article and main elements if there are any, else the smallest node that holds all slots
outside menus, headers and the like.

A page's text is what stands under the nodes matched with those, without the parts that
are never content and without template: elements below, but no headings and paragraphs,
whose text is the same on most pages of the host, pages that differ elsewhere.  So what a
few copies of an article share is no template, and articles and main elements that are the
same on all pages are none of the content if others vary.  A page in which nothing matches
names its own nodes by the same rule.

Some marks (a class ``related``, a header) tell of menus and the like only perhaps.  Such
elements name no content; within it they go if their text is the same over the host.

Tasks combine their pages by host and outline before anything is shuffled; what follows
are sums, minima and maxima by host and node, and an outline's alignment, made once.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import body, cut

BROADCAST_BYTES = 8 << 20
OUTLINES_HELD = 4096  # that a task combines before it hands them on
NEVER_MARK = "-"  # in the kind of an element that is never content
PERHAPS_MARK = "!"  # in that of one that is none outside the content and, within, by its host's alignment

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form label button select option textarea input menu dialog title".split()
)
CONTENT = frozenset(("article", "main"))
PERHAPS = frozenset(("header",))
COMMENTS = frozenset("comment comments comment-list commentlist comments-area comments-section comment-section comment-thread comment-respond".split())
BOXES = frozenset("div ol ul dl".split())
TEXT_SECTIONS = frozenset(("article", "main", "section"))  # of the marks only those of comments hold
UNMARKED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figcaption caption summary".split())  # never all the content
MAX_DEPTH = 256  # deeper elements become siblings, as in browsers
# Whole words of class and role that mark what is not content; as an id they do so perhaps.
BOILERPLATE = COMMENTS | frozenset(
    "ad ads adv advert advertisement breadcrumb breadcrumbs disqus footer masthead nav navbar navigation newsletter pagination sidebar sponsored "
    "ad-banner ad-box advert-box ad-container ad-slot ad-unit cookie-banner cookie-consent cookie-notice main-menu main-nav nav-menu newsletter-signup related-articles "
    "related-posts search-form share-buttons site-footer site-header site-nav skip-link skip-links social-links social-share".split()
)
# Words of class and role that may mark it, or name what a text is about.
AMBIGUOUS = frozenset(
    "advertising banner consent cookie cookies copyright form header legal menu modal notice notices popup promo related search share sharing signup "
    "skip social sponsor subscribe toolbar widget".split()
)
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

# quoted values may hold a greater-than sign; no part is tried twice, so that a page is read in linear time
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)>")  # from the first quote on that isn't closed
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_TOLD = frozenset("class id role hidden aria-hidden".split())
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element: its kind (name and marks), children, and text and child elements in order."""

    __slots__ = ("tag", "kind", "skip", "content")

    def __init__(self, tag: str, kind: str, skip: bool):
        self.tag, self.kind, self.skip = tag, kind, skip
        self.content: list[str | Node] = []

    def blocks(self) -> list[Node]:
        """Child elements that make blocks, those within inline elements too."""
        found: list[Node] = []
        for child in self.content:
            if isinstance(child, Node) and child.tag not in VOID:
                found += child.blocks() if child.tag in INLINE else [child]
        return found


def _element(tag: str, attributes: str) -> Node:
    """An element whose kind has its class, id and role words in order, less digits."""
    skip, perhaps, marks = tag in NEVER, tag in PERHAPS, []
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.lower().strip("\"'")
            if name not in _TOLD:
                continue
            words, whole = _NAME.findall(value), value.replace("_", "-").split()
            marks += words
            skip |= name == "hidden" or (name == "aria-hidden" and words == ["true"])
            if tag in UNMARKED or name not in ("class", "role", "id"):
                continue
            comments = any(w in COMMENTS or "comments" in w.split("-") for w in whole)
            never = comments or (tag not in TEXT_SECTIONS and not BOILERPLATE.isdisjoint(whole))
            # an id may name what a text is about, but not that of a box or list of comments
            skip |= never and (name != "id" or (comments and tag in BOXES))
            perhaps |= tag not in TEXT_SECTIONS and (never or (name != "id" and not AMBIGUOUS.isdisjoint(whole)))
    mark = [NEVER_MARK] if skip else [PERHAPS_MARK] * perhaps
    return Node(tag, ".".join([tag, *mark, *sorted(set(marks))]), skip)


def parse(page: str) -> Node:
    """DOM of a page; missing end tags are supplied and stray ones passed over."""
    root = Node("#root", "#root", False)
    stack, at, text_from, tags = [root], 0, 0, _TAG
    while (at := page.find("<", at)) >= 0:
        mark = page[at + 1 : at + 2]
        found = None
        if mark in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + 2 * comment)
            after = len(page) if end < 0 else end + (3 if comment else 1)
        elif mark == "/" or "a" <= mark.lower() <= "z":
            found = tags.match(page, at)
            if not found and tags is _TAG:
                tags = _BROKEN_TAG
                found = tags.match(page, at)
            if not found:
                if page.find(">", at) < 0:
                    break  # no tag comes
                at += 1
                continue
            after = found.end()
        else:
            at += 1
            continue
        if at > text_from:
            stack[-1].content.append(page[text_from:at])
        at = text_from = after
        if not found:
            continue
        tag = found[2].lower()
        if found[1]:
            places = [i for i, node in enumerate(stack) if node.tag == tag]
            if places:
                # an end tag of an inline element doesn't end the blocks within
                if not (tag in INLINE and any(n.tag not in INLINE for n in stack[places[-1] + 1 :])):
                    del stack[places[-1] :]
            continue
        for depth in range(len(stack) - 1, 0, -1):
            node = stack[depth]
            if tag in CLOSED_BY.get(node.tag, ()):
                del stack[depth:]
                break
            if node.tag in _SCOPE.get(tag, ()) or (node.tag not in INLINE and node.tag not in CLOSED_BY):
                break
        element = _element(tag, found[3])
        stack[-1].content.append(element)
        if tag in VOID or found[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            element.content.append(page[at : end.start() if end else len(page)])
            at = text_from = end.end() if end else len(page)
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(element)
    if text_from < len(page):
        stack[-1].content.append(page[text_from:])
    return root


def text_blocks(nodes: list[Node], omitted: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks under nodes, in order, without what is never content and nodes whose ``id()`` is omitted."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            line.append(item)
        elif not item.skip and id(item) not in omitted:
            if item.tag == "br":
                line.append(" ")
                continue
            block = item.tag not in INLINE
            if block:
                close()
                todo.append(None)
            todo.extend(reversed(item.content))
    close()
    return blocks


# An outline is a tuple (kind, outlines of the children); siblings of one kind are merged.
Outline = tuple


def outline(nodes: list[Node]) -> Outline:
    """Outline of nodes of one kind taken together."""
    kinds: dict[str, list[Node]] = {}
    for node in nodes:
        for child in node.blocks():
            kinds.setdefault(child.kind, []).append(child)
    return nodes[0].kind, tuple(outline(same) for same in kinds.values())


def encoded(tree: Outline) -> str:
    return tree[0] + "(" + " ".join(map(encoded, tree[1])) + ")"


@lru_cache(1 << 14)
def decoded(text: str) -> Outline:
    stack: list[tuple[str, list]] = [("", [])]
    for name, close in re.findall(r"([^() ]+)\(|(\))", text):
        if close:
            kind, children = stack.pop()
            stack[-1][1].append((kind, tuple(children)))
        else:
            stack.append((name, []))
    return stack[0][1][0] if stack[0][1] else ("#root", ())


def paths(tree: Outline, prefix: str = "") -> list[str]:
    """Paths of the nodes of an outline, parents first; kinds name siblings uniquely."""
    here = f"{prefix}/{tree[0]}"
    return [here, *(p for child in tree[1] for p in paths(child, here))]


def simple_tree_match(a: Outline, b: Outline) -> tuple[int, dict[str, str]]:
    """Size of the largest order-keeping match of two trees whose roots match, and the matched paths of ``a`` in ``b``."""

    def match(a: Outline, b: Outline) -> tuple[int, tuple]:
        """Size and matched pair of nodes with those of their children."""
        rows = [[0] * (len(b[1]) + 1)]
        under: dict[tuple[int, int], tuple[int, tuple]] = {}
        for i, x in enumerate(a[1]):
            row = [0]
            for k, y in enumerate(b[1]):
                best = max(rows[-1][k + 1], row[-1])
                if _tag_of(x) == _tag_of(y):
                    size, pair = match(x, y)
                    size += x[0] == y[0]  # of equal matches, that of equal marks
                    if rows[-1][k] + size > best:
                        best = rows[-1][k] + size
                        under[i + 1, k + 1] = best, pair
                row.append(best)
            rows.append(row)
        pairs, i, k = [], len(a[1]), len(b[1])
        while i and k:
            size, pair = under.get((i, k), (-1, ()))
            if size == rows[i][k]:
                pairs.append(pair)
                i, k = i - 1, k - 1
            elif rows[i - 1][k] == rows[i][k]:
                i -= 1
            else:
                k -= 1
        return rows[-1][-1] + 1, (a[0], b[0], pairs)

    if _tag_of(a) != _tag_of(b):
        return 0, {}
    size, pair = match(a, b)
    found, todo = {}, [("", "", pair)]
    while todo:
        to_a, to_b, (x, y, pairs) = todo.pop()
        to_a, to_b = f"{to_a}/{x}", f"{to_b}/{y}"
        found[to_a] = to_b
        todo += [(to_a, to_b, p) for p in pairs]
    return size, found


def _tag_of(tree: Outline) -> str:
    return tree[0].partition(".")[0]


@lru_cache(1 << 14)
def alignment(page: str, exemplar: str) -> dict[str, str]:
    """Paths of one encoded outline in another; a node that the order keeps from matching goes to one of its kind under the same parent."""
    own, other = decoded(page), decoded(exemplar)
    pairs = simple_tree_match(own, other)[1]
    left = set(paths(other)).difference(pairs.values())
    for path in paths(own):
        if left and path not in pairs:
            above, _, kind = path.rpartition("/")
            place = f"{pairs.get(above)}/{kind}"
            if place in left:
                pairs[path] = place
                left.remove(place)
    return pairs


def at_path(root: Node, path: str) -> list[Node]:
    nodes = [root]
    for kind in path.split("/")[2:]:
        nodes = [c for node in nodes for c in node.blocks() if c.kind == kind]
    return nodes


def slots(root: Node) -> list[tuple[str, int, int]]:
    """Path, digest and length of the text that stands directly in each node of a page's outline."""
    found: dict[str, list[str]] = {}

    def visit(node: Node, path: str, skip: bool) -> None:
        if skip or node.skip:
            return
        for item in node.content:
            if isinstance(item, str):
                found.setdefault(path, []).append(item)
            elif item.tag in INLINE or item.tag in VOID:
                visit(item, path, skip)
            else:
                visit(item, f"{path}/{item.kind}", skip)

    visit(root, "/#root", False)
    merged = {p: " ".join("".join(t).split()) for p, t in found.items()}
    return [(p, crc32(t.encode("utf-8", "surrogatepass")), len(t)) for p, t in merged.items() if t]


def _tag(path: str) -> str:
    return path.rsplit("/", 1)[1].partition(".")[0]


def _within(path: str, above: str) -> bool:
    return path == above or path.startswith(f"{above}/")


def _marked(path: str, mark: str) -> bool:
    return any(kind.split(".")[1:2] == [mark] for kind in path.split("/"))


def _skipped(path: str) -> bool:
    return _marked(path, NEVER_MARK)


def _lifted(path: str) -> str:
    """Path of the next element about a node, or of itself, that may be all the content."""
    while _tag(path) in PARTS:
        path = path.rsplit("/", 1)[0]
    return path


def _outermost(found: list[str]) -> list[str]:
    return [p for p in found if not any(p != q and _within(p, q) for q in found)]


def named_paths(tree: Outline) -> list[str]:
    """Paths of the outermost article and main elements that aren't in a part that is never content."""

    def named(path: str) -> bool:
        return _tag(path) in CONTENT or "main" in path.rsplit("/", 1)[1].split(".")[1:]

    found = [p for p in paths(tree) if named(p) and not _skipped(p)]
    return _outermost([p for p in found if not _marked(p.rsplit("/", 1)[0], PERHAPS_MARK)] or found)


@lru_cache(1 << 12)
def _named_in(exemplar: str) -> frozenset[str]:
    return frozenset(named_paths(decoded(exemplar)))


def content_paths(exemplar: Outline, varying: dict[str, int], template: frozenset[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Paths of the nodes that hold the content, and of those below that are template.

    Given are the length of varying text by path, and the paths whose text is the same on
    most pages.  A template node goes only as a whole element, no heading or paragraph, in
    which nothing varies; headings and paragraphs only if they are marked as perhaps no
    content.
    """
    full = [p for p, n in varying.items() if n and not _skipped(p)]
    found = named_paths(exemplar)
    if not full:
        return found, []
    if found:
        found = [p for p in found if any(_within(q, p) for q in full)] or found
    else:
        full = [p for p in full if not _marked(p, PERHAPS_MARK)] or full
        steps = [p.split("/") for p in full]
        shared = next((i for i, kinds in enumerate(zip(*steps)) if len(set(kinds)) > 1), min(map(len, steps)))
        found = [_lifted("/".join(steps[0][:shared]))]

    def fixed(path: str) -> bool:
        perhaps = path.rsplit("/", 1)[1].split(".")[1:2] == [PERHAPS_MARK]
        if not perhaps and _tag(path) in PARTS:
            return False
        return any(_within(q, path) for q in template) and not any(_within(q, path) for q in varying if q not in template)

    return found, _outermost([p for p in paths(exemplar) if any(p != above and _within(p, above) for above in found) and fixed(p)])


def _beside(found: list[str], own: Outline) -> list[str]:
    """Where a page's body itself is the content, paths of its elements that perhaps are none."""
    if not any(_tag(p) in ("#root", "html", "body") for p in found):
        return []
    return [p for p in paths(own) if p.rsplit("/", 1)[1].split(".")[1:2] == [PERHAPS_MARK] and not any(k.partition(".")[0] in TEXT_SECTIONS for k in p.split("/"))]


def _nodes_at(root: Node, found: list[str]) -> list[Node]:
    """Nodes at any of some paths, in the order of the page."""
    if len(found) < 2:
        return at_path(root, found[0]) if found else []
    wanted, nodes, todo = {id(n) for p in found for n in at_path(root, p)}, [], [root]
    while todo:
        node = todo.pop()
        if id(node) in wanted:
            nodes.append(node)
        else:
            todo.extend(reversed(node.blocks()))
    return nodes


def page_text(page: str, exemplar: str | None, path: str | None, template: str | None = None) -> str:
    """Main text of a page by the wrapper of its host, or by itself where that doesn't match.

    ``path`` and ``template`` are paths in the exemplar, divided by spaces.
    """
    root = parse(page)
    own = outline([root])
    found, wanted, fixed = named_paths(own), (path or "").split(), set((template or "").split())
    # articles and main elements tell of themselves, also those that the exemplar lacks
    named = found and any(_tag(q) in CONTENT or "main" in q.rsplit("/", 1)[1].split(".") for q in wanted)
    gone: list[str] = []
    unwanted = _named_in(exemplar).difference(wanted) if exemplar and named else ()
    if exemplar and wanted and (fixed or unwanted or not named):
        pairs = alignment(encoded(own), exemplar)
        if unwanted:
            found = [p for p in found if pairs.get(p) not in unwanted] or found
        if not named:
            found = _outermost([p for p, q in pairs.items() if q in wanted and _tag(p) == _tag(q) and not _skipped(p)]) or found
        if fixed:
            alone = [p for p in paths(own) if p not in pairs]  # of which the host's template doesn't tell
            gone = [p for p, q in pairs.items() if q in fixed and not any(_within(x, p) for x in alone)]

    def blocks_of(found: list[str], gone: list[str]) -> list[str]:
        nodes = _nodes_at(root, found)
        omitted = frozenset(id(n) for p in [*gone, *_beside(found, own)] for n in at_path(root, p))
        return text_blocks(nodes, omitted) or (text_blocks(nodes) if omitted else [])

    blocks = blocks_of(found, gone)
    if not blocks:
        blocks = blocks_of(content_paths(own, {p: n for p, _, n in slots(root)})[0], [])
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host of a URL, with its port, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1))


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Exemplar outline of every host and in it the paths of content and template: ``host``, ``exemplar``, ``path``, ``template``."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), body(html_col).alias("html"))
    ends = ["least", "most", "first", "last"]
    slot = pa.struct([("node", pa.int32()), ("n", pa.int64()), *((e, pa.int64()) for e in ends), ("length", pa.int64())])

    def outlined(batches):
        """Pages by outline and, by node, those with text: their number, least and greatest digest of it and of the page, and its length."""
        held: dict[tuple[str, str], tuple[list, dict[int, list]]] = {}

        def made() -> pa.RecordBatch:
            slots_of = [[{"node": k, "n": v[0], **dict(zip(ends, v[1:5])), "length": v[5]} for k, v in nodes.items()] for _, nodes in held.values()]
            columns = [pa.array([h for h, _ in held], pa.string()), pa.array([o for _, o in held], pa.string()), pa.array([c[0] for c, _ in held.values()], pa.int64()), pa.array(slots_of, pa.list_(slot))]
            return pa.RecordBatch.from_arrays(columns, ["host", "outline", "pages", "slots"])

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1)):
                root = parse(str(page))
                tree, found = outline([root]), slots(root)
                count, nodes = held.setdefault((str(host), encoded(tree)), ([0], {}))
                count[0] += 1
                number = {p: k for k, p in enumerate(paths(tree))}
                whole = crc32(repr(found).encode())
                for path, digest, length in found:
                    if path not in number:
                        continue
                    v = nodes.setdefault(number[path], [0, digest, digest, whole, whole, 0])
                    v[:] = v[0] + 1, min(v[1], digest), max(v[2], digest), min(v[3], whole), max(v[4], whole), v[5] + length
            if len(held) > OUTLINES_HELD:
                yield made()
                held.clear()
        if held:
            yield made()

    combined = [F.sum("n").alias("n"), *(f(e).alias(e) for e, f in zip(ends, (F.min, F.max, F.min, F.max))), F.sum("length").alias("length")]
    stats = ["n", *ends, "length"]
    parsed = cut(source.mapInArrow(outlined, f"host string, outline string, pages long, slots array<struct<node:int,n:long,{','.join(e + ':long' for e in ends)},length:long>>"))
    outlines = cut(parsed.groupBy("host", "outline").agg(F.sum("pages").alias("n")).withColumn("code", F.xxhash64("outline")))
    exemplars = cut(outlines.groupBy("host").agg(F.max(F.struct("n", "outline")).alias("best"), F.sum("n").alias("pages")).select("host", F.col("best.outline").alias("exemplar"), "pages"))

    @F.arrow_udf("array<int>")
    def aligned(page: pa.Array, exemplar: pa.Array) -> pa.Array:
        """For each node of an outline, its number in the exemplar; -1 for none."""
        found = []
        for own, other in zip(page.to_pylist(), exemplar.to_pylist()):
            number = {p: k for k, p in enumerate(paths(decoded(other)))}
            pairs = alignment(own, other)
            found.append([number.get(pairs.get(p), -1) for p in paths(decoded(own))])
        return pa.array(found, pa.list_(pa.int32()))

    places = cut(outlines.join(exemplars.select("host", "exemplar"), "host").select("host", "code", aligned("outline", "exemplar").alias("places")))
    seen = parsed.select("host", F.xxhash64("outline").alias("code"), F.explode("slots").alias("s")).select("host", "code", "s.node", *[f"s.{c}" for c in stats]).groupBy("host", "code", "node").agg(*combined)
    by_node = (
        seen.join(places, ["host", "code"])
        .withColumn("place", F.get("places", F.col("node")))
        .where("place >= 0")
        .groupBy("host", "place")
        .agg(*combined)
        .join(exemplars.select("host", "pages"), "host")
    )
    same = F.col("least") == F.col("most")
    # a text seen once may vary, and one of which all pages are copies of each other; what few pages share is no template of the host
    shared = same & (F.col("n") > 1) & (F.col("first") != F.col("last"))
    fixed = shared & (2 * F.col("n") >= F.col("pages"))
    nodes = by_node.groupBy("host").agg(  # an entry for each node of the exemplar
        F.collect_list(F.struct("place", F.when(shared, 0).otherwise(F.col("length")).alias("length"), fixed.alias("fixed"))).alias("nodes")
    )

    @F.arrow_udf("struct<path:string,template:string>")
    def chosen(exemplar: pa.Array, nodes: pa.Array) -> pa.Array:
        rows = []
        for text, held in zip(exemplar.to_pylist(), nodes.to_pylist()):
            tree = decoded(text)
            at = paths(tree)
            held = [(at[n["place"]], n["length"], n["fixed"]) for n in held or []]
            found = content_paths(tree, {p: n for p, n, _ in held}, frozenset(p for p, _, f in held if f))
            rows.append({"path": " ".join(found[0]), "template": " ".join(found[1])})
        return pa.array(rows, pa.struct([("path", pa.string()), ("template", pa.string())]))

    by_host = exemplars.join(nodes, "host", "left").select("host", "exemplar", chosen("exemplar", "nodes").alias("found"))
    return by_host.select("host", "exemplar", "found.path", "found.template")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Main text of every page from its whole HTML.

    Returns ``page_id``, ``url``, ``text`` (blocks joined by line feeds; empty if none)
    and ``n_chars``.  Null HTML counts as empty, and pages without a host share one.
    Repeated rows come back each.

    The wrappers are broadcast while they take at most ``broadcast_bytes``, and joined by
    host beyond that.
    """
    wrappers = cut(induce_wrappers(pages, url_col, html_col))
    size = wrappers.agg(F.sum(F.length("host") + F.length("exemplar") + F.length("path") + F.length("template"))).first()[0] or 0

    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    joined = source.join(F.broadcast(wrappers) if size <= broadcast_bytes else wrappers, "host", "left")

    def extracted(batches):
        for batch in batches:
            texts = [page_text(str(h), *(w.as_py() for w in wrapper)) for h, *wrapper in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "exemplar", "path", "template").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
