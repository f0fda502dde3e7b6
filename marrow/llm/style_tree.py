"""Main text of web pages by site style trees.

The pages of a host are merged into one tree.  A node is a path of block elements with their class, id and role
names; its presentation is the sequence of its children on a page, its content the blocks of text that lie directly
in it.  The entropy of either over the pages that have the node tells how important it is: content that comes back
on all pages and a presentation that never changes say little, what differs from page to page says much.  Content
counts DECAY, and what is left of 1 goes by presentation; content that comes back isn't saved by its presentation.
Pages with equal content count as one, and on fewer than FEW_PAGES pages repetition tells less.  Nodes whose
importance is under LEAST are removed from each page; so a branch goes as a whole if no node in it is important.

Tags and names only shift the importance: by NUDGE for an element that calls itself noise (a menu, a notice, an
advert, comments ...) or is mostly links, and by BONUS for text in an article.  Both are less than what lies between
text that comes back and text that doesn't.  What an element says of itself counts only where the host's own text
(that doesn't come back) is elsewhere: a label without which hardly any of it would be left tells of the layout, such
as a page "with-sidebar" or a form around the page, and is ignored.  Labels are ignored from the branch with the
most of the host's own text downwards, until MIN_SHARE of that text is free of noise labels (text in an article
counts ARTICLE times here); a branch with less than MIN_CHARS of it a page is never freed.

Pages are parsed once, to (node, text) segments that are saved; counts are partial sums by (node, content), so a
host with a third of all pages makes no large group.  Parsing takes time in proportion to a page's length, however
deep its elements are nested.  Nodes of low importance are broadcast if they are few (counted) and else looked up by
a shuffle of (page, node) rows.

Defined results: a null or empty page, or one without text in its body, has an empty text; a null page_id is kept.
Pages without a url share one tree.  Repeated rows get equal texts and count as one page.  Truncated markup is read
as far as it goes.  Columns other than id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import saved
from marrow.llm.groups import look_up

LEAST, DECAY, FEW_PAGES = 0.3, 0.9, 10
NUDGE, BONUS = 0.75, 0.2
#: The share of a host's own text that must be free of noise labels, and the own text a page that a branch needs to be freed of its label.
MIN_SHARE, MIN_CHARS, ARTICLE = 0.05, 200, 10.0
#: Shares are compared in so many steps, and of noise labels inside one another the outer so many are told apart.
STEPS, MARKS = 200, 16
#: An element is mostly links if so much of its text lies in them.
LINKS = 0.6
#: So many nodes of low importance are broadcast (8 bytes each); more are looked up by a shuffle.
BROADCAST_NODES = 200_000
_HOST = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
#: Elements whose text is never page text, and those that don't break a line of text.
HIDDEN = frozenset("head title script style noscript template iframe svg math object select option button textarea audio video canvas datalist".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
NOISE_NAMES = re.compile(r"(?:^|[-_. ])(?:ads?|advert\w*|adsense|banner|bottom|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[-_. ])", re.I)
#: Elements that hold the page or its content, whose names tell of the layout, and names that say what is there or not.
OUTER_TAGS = frozenset("html body main article".split())
MODIFIERS = re.compile(r"(?:has|have|with|without|no|not|show|hide)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.I)
#: A header inside of an article holds its title.
_TITLE = re.compile(r"(?:^|[-_. ])header(?:$|[-_. ])", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def names_of(attrs: str) -> list[str]:
    """All words of class, id and role, without digits."""
    if "=" not in attrs:
        return []
    return _DIGITS.sub("", " ".join(m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attrs))).split()


def noisy(tag: str, names: list[str], in_article: bool) -> bool:
    """Whether an element calls itself noise."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if tag in OUTER_TAGS:
        return False
    for n in names:
        if not MODIFIERS.fullmatch(n) and NOISE_NAMES.search(_TITLE.sub(" ", n) if in_article else n):
            return True
    return False


class Node:
    """An element of a page: its place in the host's tree, and what it has in it on this page."""

    __slots__ = ("id", "article", "marks", "kids", "blocks", "links", "tag")

    def __init__(self, tag: str, at: int, article: bool, marks: tuple[int, ...]):
        self.tag, self.id, self.article, self.marks = tag, at, article, marks
        self.kids: list[str] = []
        self.blocks: list[str] = []
        self.links = 0


def parse(page: str, host: str = "") -> list[tuple[Node, str]]:
    """The (element, text) of each block of text in page order; the elements' kids are labels, complete at the end."""
    stack = [Node("", _hash(host), False, ())]
    opened: Counter[str] = Counter()
    segments: list[tuple[Node, str]] = []
    parts: list[str] = []
    links, in_link, hidden = 0, False, 0

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                node = stack[-1]
                node.blocks.append(text)
                node.links += links
                segments.append((node, text))
            parts.clear()
        links = 0

    def pop() -> None:
        nonlocal hidden
        tag = stack.pop().tag
        opened[tag] -= 1
        hidden -= tag in HIDDEN

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if not hidden:
                parts.append(text)
                links += len(text) if in_link else 0
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m["end"]
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
            continue
        flush()
        in_link = False
        if m["end"]:
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if stack[-1].tag == "p":  # a block ends an open paragraph
            pop()
        ends = CLOSES.get(tag, ())
        while stack[-1].tag in ends:
            pop()
        above, names = stack[-1], names_of(m["attrs"])
        label = ".".join([tag, *names])
        above.kids.append(label)
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        at = _hash(str(above.id), label)
        article = above.article or tag in ("article", "main")
        marks = above.marks
        if len(marks) < MARKS and noisy(tag, names, article):
            marks = (*marks, at)
        stack.append(Node(tag, at, article, marks))
        opened[tag] += 1
        hidden += tag in HIDDEN
    flush()
    return segments


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_BLOCKS = pa.list_(pa.struct([("f", pa.int64()), ("chars", pa.int64())]))
_NODES = pa.list_(pa.struct([("node", pa.int64()), ("article", pa.bool_()), ("marks", pa.list_(pa.int64())), ("style", pa.int64()), ("blocks", _BLOCKS), ("links", pa.int64())]))
_SEGMENTS = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string())]))


def _parsed(pages: DataFrame) -> DataFrame:
    """(id, url, host, tree, segments, nodes): segments (node, text) in page order; for each node of the page that
    holds text its presentation and its blocks' hashes and lengths; tree names the host with all of these blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                hosts, trees, all_segments, all_nodes = [], [], [], []
                for url, page in zip(batch.column(1).slice(at, 200), batch.column(2).slice(at, 200), strict=True):
                    host = host_of(url.as_py())
                    segments = parse(page.as_py() or "", host)
                    nodes: dict[int, dict] = {}
                    done = set()
                    for node, _ in segments:
                        if id(node) in done:
                            continue
                        done.add(id(node))
                        blocks = [{"f": _hash(t), "chars": len(t)} for t in node.blocks]
                        if (n := nodes.get(node.id)) is None:
                            nodes[node.id] = {"node": node.id, "article": node.article, "marks": list(node.marks), "style": _hash(*node.kids), "blocks": blocks, "links": node.links}
                        else:  # the same path once more, such as the next paragraph
                            n["style"] = _hash(str(n["style"]), *node.kids)
                            n["blocks"] += blocks
                            n["links"] += node.links
                    hosts.append(_hash(host))
                    trees.append(_hash(host, *(f"{n['node']} {b['f']}" for n in nodes.values() for b in n["blocks"])))
                    all_segments.append([{"node": n.id, "text": t} for n, t in segments])
                    all_nodes.append(list(nodes.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 200), batch.column(1).slice(at, 200), pa.array(hosts, pa.int64()), pa.array(trees, pa.int64()), pa.array(all_segments, _SEGMENTS), pa.array(all_nodes, _NODES)], names=["id", "url", "host", "tree", "segments", "nodes"])

    kind = pages.schema["id"].dataType.simpleString()
    nodes = "array<struct<node:long,article:boolean,marks:array<long>,style:long,blocks:array<struct<f:long,chars:long>>,links:long>>"
    return pages.mapInArrow(run, f"id {kind}, url string, host long, tree long, segments array<struct<node:long,text:string>>, nodes {nodes}")


def entropies(parsed: DataFrame) -> DataFrame:
    """(node, host, article, marks, m, chars, own, entropy, dense) of every node that holds text: m pages have it,
    own of its characters don't come back, entropy is its importance before labels."""
    seen = parsed.dropDuplicates(["tree"]).select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    named = seen.groupBy("node").agg(F.min("host").alias("host"), F.max("article").alias("article"), F.max("marks").alias("marks"), F.sum("links").alias("links"))
    style = F.array(F.struct(F.col("style").alias("f"), F.lit(-1).cast("long").alias("chars")))  # a length of -1 marks the presentation
    rows = seen.select("node", F.explode(F.concat(style, "blocks")).alias("x")).select("node", "x.f", "x.chars")
    counted = rows.groupBy("node", "f", (F.col("chars") < 0).alias("is_style")).agg(F.count("*").alias("c"), F.sum("chars").alias("chars"))
    total = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    is_style = F.col("is_style")
    node = counted.groupBy("node").agg(
        total(is_style, F.col("c")).alias("m"), total(is_style, F.col("c") * F.log("c")).alias("clogc"),
        total(~is_style, F.col("chars")).alias("chars"), total(~is_style, F.col("chars") * F.log("c")).alias("logc"),
    )
    log_m = F.log(F.greatest("m", F.lit(float(FEW_PAGES))))
    content = F.greatest(F.lit(0.0), 1 - F.col("logc") / F.greatest("chars", F.lit(1.0)) / log_m)
    shape = F.when(F.col("m") < 2, 1.0).otherwise((F.log("m") - F.col("clogc") / F.col("m")) / F.log("m"))
    node = node.join(named, "node")
    return node.select("node", "host", "article", "marks", "m", "chars", (F.col("chars") * content).alias("own"), (content * (DECAY + (1 - DECAY) * shape)).alias("entropy"), (F.col("links") > LINKS * F.col("chars")).alias("dense"))


def importance(parsed: DataFrame) -> DataFrame:
    """(node, importance, pages) of every node that holds text."""
    node = saved(entropies(parsed), "nodes")
    hosts = node.groupBy("host").agg(F.sum("own").alias("host_own"), F.count("*").alias("host_nodes"))
    held = node.filter(F.size("marks") > 0).select("host", "own", "m", F.explode("marks").alias("mark"))
    held = held.groupBy("mark").agg(F.min("host").alias("host"), F.sum("own").alias("mark_own"), F.max("m").alias("mark_m"), F.count("*").alias("k"))
    held = look_up(held, hosts, ["host"], "host_own", "host_nodes")
    freeable = F.col("mark_own") >= MIN_CHARS * F.col("mark_m")
    held = held.select("mark", "k", F.when(freeable, F.floor(STEPS * F.col("mark_own") / F.greatest("host_own", F.lit(1.0)))).otherwise(-1).cast("int").alias("step"))
    # the innermost label is of the smallest branch: what frees it frees those around it
    node = look_up(node.withColumn("mark", F.element_at(F.when(F.size("marks") > 0, F.col("marks")), -1)), held, ["mark"], "step", "k")
    node = saved(node.withColumn("step", F.when(F.col("mark").isNull(), STEPS + 1).otherwise(F.col("step"))), "marked")
    free_own = F.col("own") * F.when(F.col("article"), ARTICLE).otherwise(1.0)
    by_step = node.groupBy("host", "step").agg(F.sum(free_own).alias("own"), F.sum("own").alias("plain"), F.count("*").alias("n"))  # STEPS + 3 rows at most for a host
    free = by_step.groupBy("host").agg(F.sum("plain").alias("host_own"), F.sum("n").alias("n"), F.reverse(F.array_sort(F.collect_list(F.struct("step", "own")))).alias("by_step"))
    upto = F.aggregate("by_step", F.struct(F.lit(0.0).alias("own"), F.lit(STEPS + 1).alias("step")), lambda a, x: F.when((a["own"] >= MIN_SHARE * F.col("host_own")) | (x["step"] < 0), a).otherwise(F.struct((a["own"] + x["own"]).alias("own"), x["step"].alias("step"))))["step"]
    node = look_up(node, free.select("host", "n", upto.alias("upto")), ["host"], "upto", "n")
    label = F.when(F.col("step") < F.col("upto"), -NUDGE).when(F.col("article"), BONUS).when(F.col("dense"), -NUDGE).otherwise(0.0)
    return node.select("node", (F.col("entropy") + label).alias("importance"), F.col("m").cast("long").alias("pages"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST) -> DataFrame:
    """One row for each row of pages: id, url and text."""
    parsed = saved(_parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "pages", "zstd")
    low = saved(importance(parsed).filter(F.col("importance") < least), "low").select("node", "pages")
    rows = low.select("node").limit(BROADCAST_NODES + 1).collect()
    if len(rows) <= BROADCAST_NODES:
        low_nodes_of = pages.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in rows))
        kind = pages.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low_nodes = low_nodes_of.value
            for batch in batches:
                texts = [" ".join(s["text"] for s in page if s["node"] not in low_nodes) for page in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

        out = parsed.select("id", "url", "segments").mapInArrow(run, f"id {kind}, url string, text string")
        return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
    keyed = parsed.select("id", "url", "segments", F.sha2(F.to_json(F.struct("id", "url", "segments")), 256).alias("key"))
    nodes = keyed.select("key", F.explode(F.array_distinct("segments.node")).alias("node")).distinct()
    gone = look_up(nodes, low.withColumn("low", F.lit(True)), ["node"], "low", "pages").filter("low").groupBy("key").agg(F.collect_set("node").alias("gone"))
    out = keyed.join(gone, "key", "left")
    kept = F.filter("segments", lambda s: ~F.coalesce(F.array_contains(F.col("gone"), s["node"]), F.lit(False)))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(F.transform(kept, lambda s: s["text"]), " ").alias("text"))
