"""Main-text extraction with site style trees.

Pages of one host are merged into one tree: nodes are keyed by their path of tags and first class names; pages with a
landmark (an article or main element with text) and pages without one grow apart from the root. For every node of a host the
corpus gives two entropies. Presentation: how evenly its occurrences spread over different child sequences. Content: how
rarely the same text comes back in its leaves. Together they are the node's importance, from 0 to 1: uniform, repetitive branches
(templates, notices, link lists) get a low one, varied ones a high one. Copies of a page count as one page.

HTML semantics are priors: they say how much importance a node needs (NEEDS). A node that is navigation, page furniture, a form, an
advert or reader comments by tag, role or class name, or that lies outside the landmarks of pages that have them, needs nearly all there
is: its texts must never come back and its structure hardly ever. A landmark, what it holds and what holds it, needs next to none, so only
what is the same on page after page, such as a notice inside the article, goes. Entropies that go against a prior must be certain: one
over the number of pages is taken off what speaks for furniture and added to what a landmark has. Entropies of a node seen on fewer than
MIN_SEEN pages of its host tell nothing: furniture is then judged by the entropies of its tag and class over all hosts, and where these
too were seen too rarely the prior stands by itself: furniture goes, everything else stays. Every page loses the branches that need
more than they have.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .url_filter import split_url

#: importance below which a node goes, by its prior: furniture (-1), neither (0), landmark (1)
NEEDS = {-1: 0.99, 0: 0.3, 1: 0.05}
#: pages on which a node must be seen before its entropies count
MIN_SEEN = 8
#: weight of the content of what lies below a node against its own presentation
GAMMA = 0.9
#: copied pages up to this many are broadcast (24 bytes each); beyond, pages are joined to them
COPIES = 1_000_000
#: host verdicts up to this many are broadcast (about 100 bytes each); beyond, they are joined to their pages
BROADCAST_ROWS = 200_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ODD = re.compile(r"[^a-z0-9:_.-]")

# Names with a meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style svg template textarea".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
COMMENT_NAMES = frozenset("comment comments replies reply disqus".split())
HEADERS = frozenset("header masthead".split())
LANDMARKS = frozenset("article main".split())


class Node:
    __slots__ = ("tag", "path", "noise", "landmark", "children", "texts")

    def __init__(self, tag, path, noise, landmark, texts=None, children=None):
        self.tag, self.path, self.noise, self.landmark, self.children, self.texts = tag, path, noise, landmark, [] if children is None else children, texts


def _names(attrs: str) -> tuple[list[str], str, bool]:
    """(class and id words, role, hidden) of a tag's attributes."""
    words, role, hidden = [], "", False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words += [w.lower() for w in WORD.findall(value)]
        elif name == "role":
            role = value.lower()
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return words, role, hidden


def parse(page: str):
    """(blocks, nodes): blocks (path, text) in page order; nodes (path, children) of all elements and texts.

    A path is a step a node from the root, which says whether the page has a landmark (L) or not (N). A step is a tag and first
    class name, with + for a landmark and ! for noise; # is text. Noise is one node with all its text.
    """
    root = Node("", "", False, False)
    stack, blocks, nodes, buffer = [root], [], [], []
    at = 0

    def text(raw: str) -> None:
        if raw:
            top = stack[-1]
            (top.texts if top.noise else buffer).append(html.unescape(raw) if "&" in raw else raw)

    def block_of(path: str, parts: list[str]) -> None:
        joined = " ".join("".join(parts).split())
        parts.clear()
        if joined:
            blocks.append((path, joined))

    def flush() -> None:
        if buffer:
            path = stack[-1].path + ">#"
            block_of(path, buffer)
            nodes.append((path, ""))

    def leave() -> None:
        node = stack.pop()
        if not node.noise:
            nodes.append((node.path, " ".join(node.children)))
        elif not stack[-1].noise:
            nodes.append((node.path, " ".join(node.children)))
            block_of(node.path, node.texts)

    while True:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                if not stack[-1].noise and any(n.tag in BLOCK for n in stack[depth:]):
                    flush()
                while len(stack) > depth:
                    leave()
            continue
        attrs = m[3] if m[2] else m[6]
        if tag == "br":
            text(" ")
            continue
        block = tag in BLOCK
        if block:
            if stack[-1].noise:
                text(" ")
            else:
                flush()
            if tag in CLOSES_P and any(n.tag == "p" for n in stack):
                depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p")
                while len(stack) > depth:
                    leave()
        if tag in SIBLINGS:
            same, edge = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in edge:
                    break
                if stack[i].tag in same:
                    while len(stack) > i:
                        leave()
                    break
        if tag in VOID:
            continue
        top = stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
            top.children.append(tag)
            continue
        words, role, hidden = _names(attrs) if attrs and attrs.strip() else ([], "", False)
        noise = False
        if not top.noise and tag not in ("html", "body"):
            named = set(words)
            if tag in LANDMARKS:
                noise = bool(named & COMMENT_NAMES) or hidden
            else:
                noise = tag in NOISE_TAGS or role in NOISE_ROLES or hidden or bool(named & NOISE_NAMES) or not top.landmark and (tag == "header" or bool(named & HEADERS))
        if top.noise:
            top.children.append(tag)  # furniture is one node: its tags in order are its structure
            stack.append(Node(tag, top.path, True, False, top.texts, top.children))
            continue
        landmark = top.landmark or not noise and (tag in LANDMARKS or role == "main")
        key = (tag if tag.isalnum() else ODD.sub("_", tag)) + ("." + re.sub(r"\d+", "0", words[0]) if words else "") + ("!" if noise else "+" if landmark and not top.landmark else "")
        top.children.append(key)
        stack.append(Node(tag, f"{top.path}>{key}", noise, landmark and not noise, [] if noise else None))
    while len(stack) > 1:
        if not stack[-1].noise:
            flush()
        leave()
    flush()
    kind = "L" if any("+" in p and "!" not in p for p, _ in blocks) else "N"
    return [(kind + p, t) for p, t in blocks], [(kind + p, c) for p, c in nodes]


def main_blocks(page: str | None, low: set[str]) -> list[str]:
    """Texts of a page's blocks that have no branch of low importance above them."""
    if not page:
        return []
    out, known = [], {}
    for path, t in parse(page)[0]:
        if path not in known:
            known[path] = bool(low) and (path in low or any(path[:i] in low for i, c in enumerate(path) if c == ">"))
        if not known[path]:
            out.append(t)
    return out


def weighted(pages: DataFrame, copies: int = COPIES) -> DataFrame:
    """(url, html, weight): a page of which a host has n copies weighs 1 / n."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?s)://([^/?#]*)", 1))
    base = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("html IS NOT NULL AND html <> ''")
    keyed = base.withColumns({"a": F.xxhash64(F.lit(1), host, "html"), "b": F.xxhash64(F.lit(2), host, "html")})
    often = cut(keyed.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"))
    few = often.limit(copies + 1).count() <= copies
    joined = keyed.join(F.broadcast(often) if few else often, ["a", "b"], "left")
    return joined.select("url", "html", (1 / F.coalesce("n", F.lit(1))).alias("weight"))


def _values(per_feature: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, m, v) of features counted n times: pages seen, and entropy of child sequences (kind 0) or rarity of texts (1)."""
    per_feature = per_feature.groupBy(*by, "kind", "f").agg(F.sum("n").alias("n"))
    log_n = F.log("n")
    per_node = per_feature.groupBy(*by, "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * log_n).alias("nlogn"), F.avg(log_n).alias("logn"))
    log_m = F.log("m")
    spread = F.when(F.col("m") < 1.5, 1.0).when(F.col("kind") == 0, (log_m - F.col("nlogn") / F.col("m")) / log_m).otherwise(1 - F.col("logn") / log_m)
    return per_node.select(*by, "kind", "m", F.least(F.greatest(spread, F.lit(0.0)), F.lit(1.0)).alias("v"))


def statistics(pages: DataFrame) -> DataFrame:
    """(host, path, importance, seen, prior, step_importance, step_seen) of every node of every host's tree.

    prior: -1 furniture, 1 landmark, 0 neither. The last two are those of furniture's last step over all hosts, else NULL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
        for pdf in batches:
            out = {}
            for url, page, weight in zip(pdf["url"], pdf["html"], pdf["weight"]):
                host = split_url(url)[0]
                blocks, nodes = parse(page)
                for kind, found in ((0, nodes), (1, blocks)):
                    for path, feature in found:
                        k = (host, path, kind, digest(feature))
                        out[k] = out.get(k, 0.0) + weight
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["host", "path", "kind", "f", "n"])

    seen = weighted(pages).mapInPandas(run, "host string, path string, kind int, f long, n double")
    per_feature = cut(seen.groupBy("host", "path", "kind", "f").agg(F.sum("n").alias("n")))  # pages are parsed once for what follows
    per_node = cut(_values(per_feature, ["host", "path"]))
    # content of a node: its leaves' content, weighted by how often they occur
    steps = F.split("path", ">")
    up = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ">"))
    good = F.contains("path", F.lit("+")) & ~F.contains("path", F.lit("!"))
    leaves = per_node.where("kind = 1").select("host", F.explode(up).alias("path"), "m", "v", good.alias("good"))
    content = leaves.groupBy("host", "path").agg((F.sum(F.col("m") * F.col("v")) / F.sum("m")).alias("content"), F.bool_or("good").alias("good"))
    nodes = per_node.where("kind = 0").select("host", "path", F.col("m").alias("seen"), F.col("v").alias("presentation"))
    whole = lambda content, presentation: F.when(content.isNull(), presentation).otherwise((1 - GAMMA) * presentation + GAMMA * content)
    prior = F.when(F.contains("path", F.lit("!")), -1).when(F.contains("path", F.lit("+")) | F.col("good"), 1).when(F.startswith("path", F.lit("L")), -1).otherwise(0)
    nodes = nodes.join(content, ["host", "path"], "left").select("host", "path", whole(F.col("content"), F.col("presentation")).alias("importance"), "seen", prior.alias("prior"))
    # furniture over all hosts, by its last step: as many rows as there are tags with class names
    last = F.element_at(F.split("path", ">"), -1)
    per_step = _values(per_feature.where(F.contains("path", F.lit("!"))).select(last.alias("step"), "kind", "f", "n"), ["step"])
    kinds = per_step.groupBy("step").agg(F.max(F.when(F.col("kind") == 0, F.col("m"))).alias("step_seen"), F.max(F.when(F.col("kind") == 0, F.col("v"))).alias("p"), F.max(F.when(F.col("kind") == 1, F.col("v"))).alias("c"))
    kinds = kinds.select("step", whole(F.col("c"), F.col("p")).alias("step_importance"), "step_seen")
    return nodes.withColumn("step", F.when(F.col("prior") < 0, last)).join(kinds, "step", "left").drop("step")


def low_nodes(pages: DataFrame, needs: dict[int, float] | None = None, min_seen: int = MIN_SEEN) -> DataFrame:
    """(host, path) of the nodes that go, without those right below another one."""
    needs = NEEDS if needs is None else needs
    enough = lambda c: F.col(c) > min_seen - 0.5  # noqa: E731  weights add up to whole numbers but for rounding
    sure = lambda v, m: F.col(v) + F.col("prior") / F.col(m)
    told = F.when(enough("seen"), sure("importance", "seen")).when(enough("step_seen"), sure("step_importance", "step_seen"))
    need = F.when(F.col("prior") < 0, needs[-1]).when(F.col("prior") > 0, needs[1]).otherwise(needs[0])
    low = cut(statistics(pages).where(F.coalesce(told < need, F.col("prior") < 0)).select("host", "path"))
    above = low.select("host", F.col("path").alias("parent"))
    return low.withColumn("parent", F.regexp_extract("path", "^(.*)>", 1)).join(above, ["host", "parent"], "left_anti").select("host", "path")


def extract(pages: DataFrame, needs: dict[int, float] | None = None, min_seen: int = MIN_SEEN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main blocks, white space squeezed, joined by two newlines.

    Null or empty html gives an empty text; a null or odd url belongs to the host ''. Repeated rows each give a row.
    Nothing is capped. Only nodes of low importance are gathered: broadcast while they are few, else brought to their own
    pages by joins on a hash of url and html, whatever page_id is.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = cut(low_nodes(pages, needs, min_seen))
    out = f"page_id {kind}, url string, text string, n_chars long"

    def rows(pdf: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if len(low.take(broadcast_rows + 1)) <= broadcast_rows:
        by_host: dict[str, set[str]] = {}
        for host, path in low.collect():
            by_host.setdefault(host, set()).add(path)
        shared = spark.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none: set[str] = set()
            for pdf in batches:
                yield rows(pdf, ["\n\n".join(main_blocks(h, shared.value.get(split_url(u)[0], none))) for u, h in zip(pdf["url"], pdf["html"])])

        return base.mapInPandas(run, out)

    whole = [F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))]  # rows that agree in both have one result
    keyed = base.withColumn("key", F.struct(F.xxhash64(F.lit(1), *whole).alias("a"), F.xxhash64(F.lit(2), *whole).alias("b")))

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(a, b, split_url(u)[0], path) for a, b, u, h in zip(pdf["a"], pdf["b"], pdf["url"], pdf["html"]) if h for path in {x for x, _ in parse(h)[1]}]
            yield pd.DataFrame(found, columns=["a", "b", "host", "path"])

    mine = keyed.select("key.a", "key.b", "url", "html").mapInPandas(paths, "a long, b long, host string, path string").join(low, ["host", "path"])
    mine = mine.groupBy(F.struct("a", "b").alias("key")).agg(F.collect_set("path").alias("low"))  # bounded by the page's own nodes

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield rows(pdf, ["\n\n".join(main_blocks(h, set() if x is None else set(x))) for h, x in zip(pdf["html"], pdf["low"])])

    return keyed.join(mine, "key", "left").select("page_id", "url", "html", "low").mapInPandas(joined, out)
