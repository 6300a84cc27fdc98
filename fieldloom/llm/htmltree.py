"""HTML extraction with a site style tree.

The element trees of a host's pages are merged: a style node is a host and a
path of tags with their classes. Two entropies say how much a style node varies
over the host's pages: of its presentation (the sequence of child tags) and of
its content (the words directly inside). Both are divided by the log of the
number of observations, the larger one is the node's own importance, and a
node seen once counts as wholly important. The composite importance of a node
is the mean over itself and all below it, each weighted by its observations and
by ``damping`` to the power of its depth below the node; beyond REACH levels that
is a thousandth, and left out. A branch whose
composite importance is under ``threshold`` is removed from a page, if each element in
it with words of its own is under ``threshold`` as well: so no wrapper, however
deep, takes a story along. Elements that are boilerplate by their
tag, role or class go besides. What remains of the article elements (of the body, where
none of them remains with any text) is the text. An element that is or holds an article, and the page
itself, are never removed for low importance.

Branches inside articles are observed once for each of the host's differing
articles, as equal articles on many pages are still articles. They go where all
of the branch repeats (no importance in it reaches ``threshold``) over at least
``least_pages`` differing articles. An inline element beside its parent's own
words is part of their sentence: it counts there and stays with them. Where
nothing of a page's articles, or of its body, would be left, they stay whole.

Defined results: null or empty html gives an empty text; a null or malformed
url falls under the host ""; repeated rows each give a result; malformed markup
is read as far as it goes, in time linear in its length at any depth of nesting;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import map_arrow, narrow, record, slices
from fieldloom.runtime import materialise

THRESHOLD, DAMPING, LEAST_PAGES = 0.2, 0.9, 5
#: Unimportant style nodes that may be broadcast; beyond, they are joined by host.
BROADCAST_ROWS = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose text runs on within the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags with no article text, wherever they stand.
DROPPED = frozenset("script style noscript template nav footer aside form head title iframe object svg button select textarea option dialog menu canvas audio video".split())
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_OPEN = frozenset("ul ol dl table article main section div body html td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NOISE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footer|menus?|nav|navbar|navigation|newsletter|notices?|popup|modal|promo\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[-_\s])", re.IGNORECASE)

#: Class names that begin so tell of a wrapper's state, not what it is (has-sidebar, no-comments).
STATES = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "without_", "is-", "is_")

#: Noise outside articles only: inside, a header holds the title.
HEADERS = re.compile(r"(?:^|[-_\s])(?:header|masthead)(?:$|[-_\s])", re.IGNORECASE)
#: Levels below a node that its composite importance looks at.
REACH = 64


def path_of(*names: str, above: int = 0) -> int:
    """The number of a style path from its names (tag, or tag.class), below the path ``above``: a chained hash, so that deep paths are no longer than others."""
    for name in names:
        above = xxhash.xxh3_64_intdigest(name, above) >> 1
    return above


class Node:
    __slots__ = ("children", "holds", "kept", "live", "main", "name", "parent", "path", "runs_on", "speaks", "tag", "text")

    def __init__(self, tag: str, name: str, parent: Node | None) -> None:
        self.tag, self.name, self.parent = tag, name, parent
        self.path = path_of(name, above=parent.path) if parent else 0
        self.main = bool(parent and parent.main) or tag in MAIN
        self.kept, self.children, self.text = True, [], []
        self.live, self.runs_on, self.speaks = True, False, False
        self.holds = tag in ("", "html", "body")
        above = parent
        while self.main and above and not above.holds:
            above.holds, above = True, above.parent


class Tree(HTMLParser):
    """A page's elements. A node's children hold nodes and strings in page order."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", "", None)
        self.nodes: list[Node] = []
        self.open: Counter = Counter()
        self.feed(html)
        self.close()
        for node in self.nodes:  # parents come first
            if node.tag == "form" and node.holds:  # a wrapper of the article
                node.kept = True
            node.live = node.kept and node.parent.live
            node.runs_on = node.main and node.tag in INLINE and (node.parent.runs_on or node.parent.speaks)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, KEEPS_OPEN)
        if tag in SAME_CLOSES:
            self._close(SAME_CLOSES[tag], KEEPS_OPEN - {"td", "th"} if tag in ("tr", "td", "th") else KEEPS_OPEN)
        said = {k: v or "" for k, v in attrs}
        label = ".".join(said.get("class", "").split())
        node = Node(tag, f"{tag}.{label}" if label else tag, self.at)
        node.kept = not (
            tag in DROPPED
            or (not self.at.main and (tag == "header" or HEADERS.search(said.get("class", "")) or HEADERS.search(said.get("id", ""))))
            or said.get("role", "").lower() in ROLES
            or "hidden" in said
            or (tag not in ("html", "body", "article", "main") and any(NOISE.search(name) for a in ("class", "id") for name in said.get(a, "").split() if not name.lower().startswith(STATES)))
        )
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.at.tag != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)
        self.at.text.append(data)
        self.at.speaks = self.at.speaks or bool(data.strip())

    def _leave(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def _close(self, tags: set[str], stop: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent and node.tag not in stop:
            if node.tag in tags:
                while self.at is not node:
                    self._leave()
                self._leave()
                return
            node = node.parent


def above(node: Node) -> list[int]:
    """The paths of the element and of those around it, REACH at most."""
    out = []
    while node.parent and len(out) < REACH:
        out.append(node.path)
        node = node.parent
    return out


def observations(tree: Tree) -> Iterator[tuple[Node, int, int]]:
    """For each element outside articles: itself, hash of its presentation, hash of its content."""
    for node in tree.nodes:
        if node.kept and not node.main and not node.holds:
            shown = ">".join(c.name for c in node.children if isinstance(c, Node))
            said = " ".join("".join(node.text).split())
            yield node, xxhash.xxh3_64_intdigest(shown) >> 1, xxhash.xxh3_64_intdigest(said) >> 1


def sentence(node: Node) -> str:
    """The words directly in the element, those of inline elements among them included."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in VOID:
            out.append(" ")
        elif c.runs_on and c.kept:
            stack.extend(reversed(c.children))
    return "".join(out)


def in_articles(tree: Tree) -> tuple[int, list[tuple[Node, int, int]]]:
    """A hash of what the page's articles say (0 for nothing), and ``observations`` of each element inside them."""
    found = []
    for node in tree.nodes:
        if node.live and node.main and not node.holds and not node.runs_on and node.tag not in MAIN and node.tag not in VOID:
            shown = ">".join(c.name for c in node.children if isinstance(c, Node) and not c.runs_on)
            said = " ".join(sentence(node).split())
            found.append((node, xxhash.xxh3_64_intdigest(shown) >> 1, xxhash.xxh3_64_intdigest(said) >> 1))
    text = text_under(tree, set(), True) if found else ""
    return (xxhash.xxh3_64_intdigest(text) >> 1 or 1) if text else 0, found


def pruned(tree: Tree, low: set[int], weak: set[int]) -> set[int]:
    """The elements (by id) whose branches go: those with a path in ``weak``, where all in the branch is in ``low``.

    Outside articles all with words of their own, inside all but inline elements among words.
    """
    firm: set[int] = set()  # elements with something important in their branch
    for node in reversed(tree.nodes):  # children come before their parents
        counts = not node.runs_on and node.tag not in VOID if node.main else node.speaks
        if id(node) in firm or (counts and node.kept and node.path not in low):
            firm.add(id(node))
            firm.add(id(node.parent))
    return {id(n) for n in tree.nodes if n.path in weak and id(n) not in firm and not n.holds and not n.runs_on and n.tag not in MAIN and not (n.main and n.tag in VOID)}


def text_under(tree: Tree, gone: set[int], use_main: bool) -> str:
    out: list[str] = []
    stack: list[Node | str | None] = [tree.top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if not x.kept or id(x) in gone:
            continue
        if x.tag in VOID:
            out.append(" " if x.tag in ("br", "hr") else "")
        inner = [c for c in x.children if isinstance(c, Node) or x.main or not use_main]
        if x.tag not in INLINE:
            inner = [" ", *inner, " "]
        stack.extend(reversed(inner))
    return " ".join("".join(out).split())


def main_text(html: str, low: set[int] | frozenset[int] = frozenset(), weak: set[int] | frozenset[int] | None = None) -> str:
    """The text of what is kept, blocks and white space alike turned into one space.

    Articles are the text if those that no dropped element holds say anything; else the body is.
    ``weak`` are the paths of low composite importance (``low``, where none are given).
    """
    tree = Tree(html)
    gone = pruned(tree, low, low if weak is None else weak) if low else set()
    if any(n.tag in MAIN and n.live for n in tree.nodes):
        text = text_under(tree, gone, True) or text_under(tree, set(), True)
        if text:
            return text
    return text_under(tree, gone, False) or text_under(tree, set(), False)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return narrow(pages, "page_id", "url", "html").withColumn("host", host)


def style_tree(pages: DataFrame, damping: float = DAMPING) -> DataFrame:
    """host, path (``path_of``), m (observations), importance, articles (differing ones it was seen in; null
    outside articles) and composite of every style node."""
    item = pa.struct([("path", pa.int64()), ("kind", pa.int8()), ("value", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("host", pa.string()), ("article", pa.int64()), ("items", pa.list_(item)), ("chains", pa.list_(pa.list_(pa.int64())))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            seen: dict[tuple[str, int | None], Counter] = {}
            chains: dict[str, dict[int, list[int]]] = {}
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tree, outside = Tree(html or ""), seen.setdefault((host, None), Counter())
                known = chains.setdefault(host, {})
                for node, shown, said in observations(tree):
                    outside[node.path, 0, shown] += 1
                    outside[node.path, 1, said] += 1
                    if node.path not in known:
                        known[node.path] = above(node)
                article, found = in_articles(tree)
                if article:
                    inside = Counter((path, 2, article) for path in {f[0].path for f in found})
                    for node, shown, said in found:
                        inside[node.path, 0, shown] += 1
                        inside[node.path, 1, said] += 1
                        if node.path not in known:
                            known[node.path] = above(node)
                    # Of equal articles with other markup the smaller observations count, here as in the table.
                    seen[host, article] = min(seen.get((host, article), inside), inside, key=lambda c: sorted(c.items()))
            if seen:
                items = [[dict(zip(("path", "kind", "value", "n"), (*k, n), strict=True)) for k, n in sorted(c.items())] for c in seen.values()]
                yield record(schema, [h for h, _ in seen], [a for _, a in seen], items, [list(chains[h].values()) if a is None else None for h, a in seen])

    found = materialise(map_arrow(with_host(pages).select("host", "html"), kernel, "host string, article long, items array<struct<path:long,kind:byte,value:long,n:long>>, chains array<array<long>>"), "observed")
    differing = found.where("article is not null").groupBy("host", "article").agg(F.min("items").alias("items")).select("host", "items")
    values = found.where("article is null").select("host", "items").union(differing).select("host", F.inline("items")).groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    # Entropy over the log of the number of observations: log(N) - sum(n log n) / N, all over log(N).
    kinds = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"))
    entropy = F.when(F.col("m") > 1, F.lit(1.0) - F.col("s") / (F.col("m") * F.log(F.greatest(F.col("m"), F.lit(2)).cast("double")))).otherwise(F.lit(1.0))
    is_seen = F.col("kind") < 2
    own = kinds.groupBy("host", "path").agg(F.max(F.when(is_seen, F.col("m"))).alias("m"), F.max(F.when(is_seen, entropy)).alias("importance"), F.max(F.when(~is_seen, F.col("m"))).alias("articles"))
    own = materialise(own, "nodes")
    chain = found.where("chains is not null").select("host", F.explode("chains").alias("chain")).select("host", "chain", F.col("chain")[0].alias("path")).dropDuplicates(["host", "path"])
    each = own.join(chain.hint("merge"), ["host", "path"]).select("host", "m", "importance", F.posexplode("chain").alias("up", "path")).withColumn("w", F.pow(F.lit(damping), F.col("up")))
    composite = each.groupBy("host", "path").agg((F.sum(F.col("w") * F.col("m") * F.col("importance")) / F.sum(F.col("w") * F.col("m"))).alias("composite"))
    return own.join(composite.hint("merge"), ["host", "path"])


def extract(pages: DataFrame, threshold: float = THRESHOLD, damping: float = DAMPING, least_pages: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    A style node counts as unimportant if it was seen at least ``least_pages``
    times (inside articles, in as many differing ones) and its importance is under
    ``threshold``; a branch of such nodes goes where its composite importance is
    under it too, inside articles in any case. The unimportant nodes are
    broadcast only after a count shows that they are few; else pages meet them
    by a join on the host.
    """
    often = (F.coalesce("articles", "m") >= least_pages) & (F.col("importance") < threshold)
    weak = F.col("articles").isNotNull() | (F.col("composite") < threshold)
    low = style_tree(pages, damping).where(often).select("host", F.struct("path", weak.alias("weak")).alias("node"))
    low = materialise(low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("nodes")), "unimportant")
    few = (low.agg(F.sum(F.size("nodes"))).first()[0] or 0) <= broadcast_rows
    both = with_host(pages).join(low.hint("broadcast" if few else "merge"), "host", "left")
    both = both.select("page_id", "url", "html", F.transform("nodes", lambda n: n["path"]).alias("low"), F.transform(F.filter("nodes", lambda n: n["weak"]), lambda n: n["path"]).alias("weak"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            texts = [main_text(h or "", set(u or ()), set(v or ())) for h, u, v in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield record(schema, part.column(0), part.column(1), texts, [len(t) for t in texts])

    return map_arrow(both, kernel, "page_id long, url string, text string, n_chars long")


def entropy_of(counts: list[int]) -> float:
    """Normalised entropy of one style node's observations (the plain form of what ``style_tree`` sums)."""
    m = sum(counts)
    return 1.0 if m <= 1 else -sum(n / m * math.log(n / m) for n in counts) / math.log(m)
