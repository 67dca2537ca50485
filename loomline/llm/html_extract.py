"""Operator 6: main text of web pages by a site style tree.

Method: the pages of a host are merged into one tree of styles: a node is the path of tags and names from the root, its
features are how it presents its children or, at a leaf, its contents. Entropies of the features over the host's distinct
pages give each node an importance, and each branch a composite one from its leaves upwards. From each page go the
contents of low-importance leaves and branches that other pages have as well. Beside the tree stands a fallback: branches
whose tag or name says that they present no content (menus, forms, adverts and so on) and what is outside of article or
main elements go too, for hosts with too few pages and for templates that fill themselves anew on each page.

What is merged is counted by (host, node, feature) first, so that a host with a third of all pages is spread over all
tasks; whole copies of a page count once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import common


#: No quantifier gives back what it took, so that a page takes linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<raw>script|style|noscript|template|svg|iframe|object)\b[^>]*+>.*?(?:</(?P=raw)\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that hold no main text, whatever is in them.
_DROPPED = frozenset("head title nav header footer aside form button select option input textarea label fieldset dialog menu canvas audio video map".split())
#: Words in class, id or role that name what isn't main text.
_NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|aside|header|masthead|footer|foot|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|search|share|social|related|recommend(?:ed|ations)?|comments?|disqus|reply|replies|widget|toolbar|pagination|pager|copyright|complementary|contentinfo)(?=$|[\s_-])", re.I)
#: Names that say what a page has or lacks, not what the element is; and names that in an article stand for its own head.
_ABOUT = re.compile(r"(?<![^\s])(?:has|with|without|no|not|show|hide)[-_][\w-]+", re.I)
_HEAD = re.compile(r"(?<![^\s])[\w-]*header[\w-]*", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags inside which text runs on; all others begin and end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: An open tag of these ends where another one of them (or of the second set) begins.
_ENDS = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_SPACE = re.compile(r"\s+")
#: Importance below which a node is a template's, and below which all leaves of a branch must be for the branch to be one.
LEAST, LEAST_OF_LEAVES = 0.2, 0.5
#: What a style's presentation weighs against its children: 1 - GAMMA ** (number of styles).
GAMMA = 0.9
#: Levels of the tree; what lies deeper belongs to the node at this level.
DEPTH = 48


def _is_noise(names: str, depth: int) -> bool:
    names = _ABOUT.sub("", names)
    return bool(_NOISE.search(_HEAD.sub("", names) if depth == 2 else names))


@dataclass
class Page:
    """What a page holds. Of each block: its leaf in the style tree, its text, and whether the fallback by names and tags
    keeps it. Of the tree: each node's chain of nodes from the root, and the hashes of how it presents its children."""

    leaves: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)
    chains: dict[int, tuple[int, ...]] = field(default_factory=dict)
    styles: dict[int, set[int]] = field(default_factory=dict)


class _Open:
    """An element that is open: its tag, whether names drop it, depth of main content (2 article, 1 main), its node, and
    what it has presented so far."""

    __slots__ = ("tag", "dropped", "depth", "chain", "last", "style")

    def __init__(self, tag: str, dropped: bool, depth: int, chain: tuple[int, ...]):
        self.tag, self.dropped, self.depth, self.chain, self.last, self.style = tag, dropped, depth, chain, None, 0


_ROOT = (1,)


def parse(source: str) -> Page:
    """The blocks of a page in its order, character references decoded and white space made one blank.

    The fallback keeps what is outside dropped tags and names and, where the page has article elements (or else a main
    element), in these. An element is a node of the tree unless it is inline and without a name; its node is its path of
    tags and names. Takes time in proportion to the page's length, however its tags are nested or left open.
    """
    page, depths, text = Page(), [], []
    top = _Open("", False, 0, _ROOT)
    stack, nodes, places, blocks = [top], [top], {}, [0]  # open elements; those that are nodes; places by tag; of blocks
    page.chains[1] = _ROOT
    where = (_ROOT, False, 0)

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                chain, dropped, depth = where
                leaf = _number(chain[-1], "#")
                page.chains.setdefault(leaf, (*chain, leaf))
                page.leaves.append(leaf)
                page.texts.append(joined)
                depths.append(-1 if dropped else depth)
            text.clear()

    def put(piece: str) -> None:
        nonlocal where
        if not text:
            where = (nodes[-1].chain, stack[-1].dropped, stack[-1].depth)
        text.append(piece)

    def close(k: int) -> None:
        while len(stack) > k:
            gone = stack.pop()
            places[gone.tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            if nodes[-1] is gone:
                nodes.pop()
                page.styles.setdefault(gone.chain[-1], set()).add(gone.style)

    end = source.rfind(">") + 1
    at = 0
    for m in _TOKEN.finditer(source, 0, end):
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:].removesuffix("]]>")))
            elif m["raw"] and not m[0].endswith(">") or m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(source)  # a comment or script that doesn't end
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if not inline:
            flush()
        if tag == "br":
            put(" ")
        if m["end"]:
            k = places[tag][-1] if places.get(tag) else 0
            if k and (not inline or k > blocks[-1]):  # a stray end of an inline tag ends no block
                if k <= blocks[-1]:
                    flush()
                close(k)
            continue
        if tag in _VOID:
            continue
        if not inline:
            # Tags left open end with the block that they are in; of these tags, one kind lies in another but a few times.
            for k in reversed(blocks):
                if tag in _ENDS.get(stack[k].tag, ()):
                    close(k)
                    break
                if stack[k].tag not in _ENDS:
                    break
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(m["attrs"])) if m["attrs"] else ""
        dropped, depth = stack[-1].dropped, stack[-1].depth
        dropped = dropped or tag in _DROPPED and not (tag == "header" and depth == 2) or bool(names and tag not in ("html", "body", "article", "main") and _is_noise(names, depth))
        depth = max(depth, 2 if tag == "article" else 1 if tag == "main" else 0)
        above = nodes[-1]
        chain = above.chain
        if not inline or names:
            style = tag + "." + ".".join(sorted(names.lower().split())) if names else tag
            if style != above.last:  # runs of one style are one
                above.last, above.style = style, _number(above.style, style)
            if len(chain) < DEPTH:
                node = _number(chain[-1], style)
                chain = page.chains.setdefault(node, (*chain, node))
        if m["attrs"].rstrip().endswith("/"):
            continue
        new = _Open(tag, dropped, depth, chain)
        places.setdefault(tag, []).append(len(stack))
        if not inline:
            blocks.append(len(stack))
        if chain is not above.chain:
            nodes.append(new)
        stack.append(new)
    rest = source[at:].split("<!--", 1)[0] if at >= end else source[at:]
    if rest:
        put(rest)
    flush()
    close(1)
    page.styles.setdefault(1, set()).add(top.style)
    best = max((d for d in depths), default=0)
    page.kept = [d == best and d >= 0 for d in depths]
    return page


def blocks(source: str) -> list[str]:
    """Texts that the fallback by names and tags keeps of one page alone."""
    page = parse(source)
    return [t for t, k in zip(page.texts, page.kept, strict=True) if k]


def _number(*parts: int | str) -> int:
    return int.from_bytes(xxhash.xxh64_digest("\0".join(map(str, parts)).encode(errors="surrogatepass")), "big", signed=True)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_FEATURE = pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("chain", pa.list_(pa.int64())), ("leaf", pa.bool_())])
PARSED = "page long, features array<long>, texts array<string>, kept array<boolean>, tree array<struct<node:long,feature:long,chain:array<long>,leaf:boolean>>"


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host; page: a hash of all texts and styles; of each block its feature (leaf and text), its text and
    whether the fallback keeps it; tree: each node with its features, and once with none and its chain."""
    kind = pages.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 3, rows=200):
                out = []
                for source in part.column(3).to_pylist():
                    page = parse(source or "")
                    features = [_number(leaf, text) for leaf, text in zip(page.leaves, page.texts, strict=True)]
                    held = set(zip(page.leaves, features, strict=True)) | {(node, style) for node, styles in page.styles.items() for style in styles}
                    leaves = set(page.leaves)
                    both = [*sorted(held), *((n, None) for n in sorted({n for n, _ in held}))]
                    tree = [{"node": n, "feature": f, "chain": page.chains[n] if f is None else None, "leaf": n in leaves} for n, f in both]
                    out.append((_number(*features, *(f for _, f in sorted(held))), features, page.texts, page.kept, tree))
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(_FEATURE)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=["page_id", "url", "host", "page", "features", "texts", "kept", "tree"])

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, f"page_id {kind.simpleString()}, url string, host string, {PARSED}")


def style_tree(counts: DataFrame) -> DataFrame:
    """The tree of each host: host, node, chain, pages that have the node, is_leaf, importance, composite and poor.

    counts has host, node, feature (null for the node itself), chain, leaf, and n, the distinct pages with it. A node's
    importance is 1 less how evenly pages share its features (the contents of a leaf, the presentations of others), a mean
    of log n to the base of pages: 0 where all pages have the same, 1 where each has its own. It is shrunk to 1 as by one
    page more, so that few pages say little. The composite importance of a branch is its node's own, weighted by
    1 - GAMMA ** (its presentations), and that of its children in proportion to their pages. A leaf is poor if its
    importance is below LEAST, or if it lies in a branch whose composite is and none of whose leaves reaches LEAST_OF_LEAVES.
    """
    pages = F.max(F.when(F.col("feature").isNull(), F.col("n")))
    known = F.col("feature").isNotNull()
    nodes = counts.groupBy("host", "node").agg(
        F.first("chain").alias("chain"),
        pages.alias("pages"),
        F.sum(F.when(known, F.col("n"))).alias("total"),
        F.sum(F.when(known, F.col("n") * F.log("n"))).alias("spread"),
        F.count(F.when(known, 1)).alias("styles"),
        F.first("leaf").alias("is_leaf"),
    )
    raw = F.when(F.col("pages") > 1, 1 - F.col("spread") / (F.col("total") * F.log("pages"))).otherwise(1.0)
    nodes = nodes.select("host", "node", "chain", "pages", "is_leaf", "styles", ((F.col("pages") * raw + 1) / (F.col("pages") + 1)).alias("importance"))
    nodes = nodes.withColumn("parent", F.when(F.size("chain") > 1, F.element_at("chain", -2)).otherwise(0))
    siblings = nodes.groupBy("host", "parent").agg(F.sum("pages").alias("of"))
    nodes = nodes.join(siblings, ["host", "parent"]).withColumn("share", F.col("pages") / F.col("of"))
    passed = F.when(F.col("is_leaf"), 0.0).otherwise(F.pow(F.lit(GAMMA), "styles"))
    facts = nodes.select("host", F.col("node").alias("above"), passed.alias("passed"), "share")
    # Every node meets the nodes above it; what it adds to one of them is a product along the way.
    ways = nodes.select("host", "node", "is_leaf", "importance", (F.col("importance") * (1 - passed)).alias("own"), F.posexplode("chain").alias("place", "above")).join(facts, ["host", "above"])
    step = F.struct("place", "above", "passed", "share")
    ways = ways.groupBy("host", "node").agg(F.first("own").alias("own"), F.first(F.when(F.col("is_leaf"), F.col("importance"))).alias("leaf_importance"), F.sort_array(F.collect_list(step), asc=False).alias("way"))
    # From the node upwards: the factor that it had below, times what each further node passes on of it.
    factors = F.aggregate(
        "way",
        F.array().cast("array<double>"),
        lambda done, x: F.array_append(done, F.when(F.size(done) == 0, F.lit(1.0)).otherwise(F.element_at(done, -1) * F.element_at("way", F.size(done))["share"] * x["passed"])),
    )
    parts = ways.select("host", "own", "leaf_importance", F.explode(F.arrays_zip(F.col("way")["above"].alias("above"), factors.alias("factor"))).alias("x"))
    branches = parts.groupBy("host", F.col("x.above").alias("above")).agg(F.sum(F.col("own") * F.col("x.factor")).alias("composite"), F.max("leaf_importance").alias("best_leaf"))
    branches = branches.withColumn("noise", (F.col("composite") < LEAST) & (F.coalesce("best_leaf", F.lit(0.0)) < LEAST_OF_LEAVES))
    in_noise = nodes.select("host", "node", F.explode("chain").alias("above")).join(branches, ["host", "above"]).groupBy("host", "node").agg(F.max("noise").alias("in_noise"), F.max(F.when(F.col("above") == F.col("node"), F.col("composite"))).alias("composite"))
    return nodes.join(in_noise, ["host", "node"]).select("host", "node", "chain", "pages", "is_leaf", "importance", "composite", (F.col("is_leaf") & ((F.col("importance") < LEAST) | F.col("in_noise"))).alias("poor"))


def extract_main_text(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars, removed_by_tree (blocks that the style tree took away)
    and removed_by_names (blocks that only the fallback by names and tags took away).

    A null html counts as empty, and a page without blocks has an empty text. A null url belongs to a host of its own,
    without name. What only one distinct page of a host has at a node is never the tree's to remove. Repeated rows and
    null ids stay; an empty table gives an empty result; other columns aren't read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    parsed = common.written(_parsed(pages), f"{folder}/parsed", compression="zstd")
    tree = parsed.select("host", "page", F.explode("tree").alias("x")).select("host", "page", "x.*")
    rows = tree.select("host", "page", "node", "feature").distinct()  # copies of a page count once
    rows = common.written(rows, f"{folder}/rows", compression="zstd")
    chains = tree.filter("feature is null").groupBy("host", "node").agg(F.first("chain").alias("chain"), F.first("leaf").alias("leaf"))
    counts = rows.groupBy("host", "node", "feature").agg(F.count("*").alias("n")).join(chains, ["host", "node"])
    counts = common.written(counts, f"{folder}/counts", compression="zstd")
    poor = common.written(style_tree(counts), f"{folder}/style-tree").filter("poor").select("host", "node")
    # Written, so that both sides of the joins are dealt out anew and Spark can split what very many pages have.
    repeated = common.written(counts.filter("n > 1 and feature is not null").join(poor, ["host", "node"], "left_semi").select("host", "node", "feature"), f"{folder}/repeated")
    # Page by page and not host by host, as a large host may have many contents that repeat.
    drop = rows.join(repeated, ["host", "node", "feature"], "left_semi").groupBy("host", "page").agg(F.collect_set("feature").alias("drop"))
    drop = common.written(drop, f"{folder}/drop")
    for used in ("rows", "counts", "repeated"):
        common.remove(pages.sparkSession, f"{folder}/{used}")
    joined = parsed.select("page_id", "url", "host", "page", "features", "texts", "kept").join(drop, ["host", "page"], "left").withColumn("drop", F.coalesce("drop", F.array()))
    joined = joined.withColumn("blocks", F.arrays_zip("features", "texts", "kept"))
    stays = lambda x: ~F.array_contains("drop", x["features"])
    text = F.array_join(F.transform(F.filter("blocks", lambda x: x["kept"] & stays(x)), lambda x: x["texts"]), "\n\n")
    count = lambda condition: F.size(F.filter("blocks", condition)).cast("long")
    out = joined.select("page_id", "url", text.alias("text"), count(lambda x: ~stays(x)).alias("removed_by_tree"), count(lambda x: stays(x) & ~x["kept"]).alias("removed_by_names"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "removed_by_tree", "removed_by_names")
