"""Main text of web pages by site style trees.

The pages of a host are merged: block elements with the same path of tags and class names are one
element node of the host's tree, and the trees of all hosts are merged once more by path.
A node's content importance is what the entropy of its blocks of text leaves: a block on k of the node's m pages
carries ``1 - log_m k``, in the host's tree and in the merged one, and the lesser counts. Its
presentation importance is the entropy of the sequences of blocks that its parent shows,
``-sum p log_m p``. What differs from page to page is content, what recurs is furniture.

The evidence of a node is ``log2`` of its pages. With little of it a prior from the markup's meaning weighs in as
``prior`` further units, so a page that stands alone is read by its markup and a node seen often by its entropies.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, staged

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
DIGITS = re.compile(r"\d+")
STYLE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Fixed values (element kinds of HTML, and usual names of furniture).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas select option object video audio".split())
BLOCK = frozenset("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset form nav header footer aside hgroup menu dialog center search".split())
FURNITURE = frozenset("head nav footer aside button menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
FURNITURE_NAMES = frozenset("ad ads advert advertisement advertisements advertising sponsored promo nav navbar navigation menu sidebar footer cookie cookies consent notice popup modal newsletter breadcrumb breadcrumbs pagination".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
CONTENT_NAMES = frozenset("article content story post entry main".split())
#: Words in a class name that deny the rest, and words for a mere container.
WITHOUT = frozenset("has no not with without is hide show".split())
CONTAINER = frozenset("list box bar slot area wrap wrapper container block section unit links left right top bottom group panel".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Opening one of these ends an open element of the listed kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
#: An implied end does not go beyond these.
SCOPE = frozenset("ul ol dl table article main section div body td th li dd blockquote aside nav header footer form".split())


def signed(x: str) -> int:
    h = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def noun(name: str) -> str:
    """The noun of a hyphenated class name, past words for containers; empty if the name denies it."""
    parts = re.split("[-_]+", name.strip("-_"))
    while len(parts) > 1 and parts[-1] in CONTAINER:
        parts.pop()
    return "" if parts[0] in WITHOUT else parts[-1]


def likely_content(path: list[tuple[str, tuple[str, ...], str]]) -> float:
    """The prior importance of a text under a path of (tag, names, role): 0 furniture, 1 an article, 0.65 unknown, -9 reader comments.

    The nearest element whose markup says anything decides. A form says so only of text that stands in no
    paragraph or heading, and a header only outside articles. Comments differ from page to page as articles do, so
    no entropy tells them and their prior outweighs it.
    """
    textual = False
    for at in range(len(path) - 1, -1, -1):
        tag, names, role = path[at]
        textual = textual or tag in TEXTUAL
        if tag in ("article", "main") or role in ("article", "main"):
            return 1.0
        if tag in FURNITURE or role in FURNITURE_ROLES or tag == "form" and not textual:
            return 0.0
        if tag == "header" and not any(t in ("article", "main") for t, _, _ in path[:at]):
            return 0.0
        if tag in ("html", "body"):
            continue
        nouns = set(map(noun, names))
        if nouns & COMMENT_NAMES:
            return -9.0
        if nouns & FURNITURE_NAMES:
            return 0.0
        if CONTENT_NAMES.intersection(names):
            return 1.0
    return 0.65


#: Hash and prior of paths that this process has met.
KNOWN: dict[str, tuple[int, float]] = {}


class Node:
    """An element of a page that holds text or blocks: hash of its path, its parent's, its prior, its blocks of text and its children in order."""

    __slots__ = ("path", "up", "prior", "texts", "children")

    def __init__(self, path: int, up: int, prior: float):
        self.path, self.up, self.prior = path, up, prior
        self.texts: list[str] = []
        self.children: list[str] = []


class Page:
    """Blocks of text of a page, in order, and its nodes by path."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str]] = []  # hash of the path, text
        self.nodes: dict[int, Node] = {}
        root = Node(signed(""), signed(""), 0.65)
        #: tag, path as text, path as (tag, names, role), node
        self.stack: list[tuple] = [("", "", [], root)]
        self.nodes[root.path] = root
        self.text: list[str] = []
        self.read(source)
        self.flush()

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if text:
                node = self.stack[-1][3]
                self.blocks.append((node.path, text))
                node.texts.append(text)

    def close(self, tag: str, within: frozenset = frozenset()) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.stack[at][0]
            if name == tag:
                if self.stack[-1][3] is not self.stack[at - 1][3]:
                    self.flush()
                del self.stack[at:]
                return
            if name in within:
                return

    def open(self, tag: str, attributes: str) -> None:
        _, path, parts, node = self.stack[-1]
        if tag in BLOCK or tag == "button" or attributes and "role" in attributes:
            self.flush()
            names, role = [], ""
            for m in STYLE.findall(attributes) if attributes else ():
                value = (m[1] or m[2] or m[3]).lower()
                if m[0].lower() == "role":
                    role = value.strip()
                else:
                    names += value.split()
            # numbers in names are counters of posts and pages
            style = ".".join([tag, *sorted({DIGITS.sub("#", n) for n in names})]) + (f"[{role}]" if role else "")
            node.children.append(style)
            path = f"{path}/{style}"
            parts = [*parts, (tag, tuple(names), role)]
            if path not in KNOWN:
                if len(KNOWN) > 50_000:
                    KNOWN.clear()
                KNOWN[path] = signed(path), likely_content(parts)
            h, prior = KNOWN[path]
            if h not in self.nodes:
                self.nodes[h] = Node(h, node.path, prior)
            node = self.nodes[h]
        self.stack.append((tag, path, parts, node))

    def read(self, source: str) -> None:
        at, lower = 0, None
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "p" and all(x[0] != "p" for x in self.stack):
                    self.flush()
                self.close(tag)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self.flush()
            elif tag in RAW:
                if not m[3].endswith("/"):
                    lower = lower if lower is not None else source.lower()
                    end = lower.find(f"</{tag}", at)
                    at = len(source) if end < 0 else (lower.find(">", end) + 1 or len(source))
            else:
                if tag in BLOCK and tag not in ("html", "head", "body"):
                    self.close("p", SCOPE)
                for t in ENDS.get(tag, ()):
                    self.close(t, SCOPE - {t})
                if tag == "body":
                    self.close("head")
                self.open(tag, m[3])
        if at < len(source):
            self.text.append(source[at:])

    def main_text(self, low: dict[int, float], threshold: float) -> str:
        """The blocks that are left without the branches in ``low`` (importance by path).

        A page keeps its most important branch that no markup names as furniture, and its equals, so that an article of which
        there are very many copies is not lost with all that recurs.
        """
        rest = [low.get(p, 1.0) for p, _ in self.blocks if self.nodes[p].prior > 0]
        least = min(threshold, 0.9 * max(rest, default=1.0))
        return "\n".join(t for p, t in self.blocks if low.get(p, 1.0) >= (least if self.nodes[p].prior > 0 else threshold))


def features(page: Page, host: str) -> list[tuple[int, int, int, float]]:
    """``(path, feature, weight, x)`` of a page's nodes with text.

    Weight above 0: a block of text, weighed by its length; the page's own host name in it says nothing. Weight 0: the
    node's presence, ``x`` its prior and the feature its parent. Weight -1: the presentation of a node, its children in order.
    """
    out, shown = [], set()
    for node in page.nodes.values():
        if node.texts:
            out.append((node.path, node.up, 0, node.prior))
            for text in dict.fromkeys(node.texts):
                plain = text.lower().replace(host, "") if host else text.lower()
                out.append((node.path, signed(plain), max(1, len(plain)), 0.0))
            if node.up not in shown:
                shown.add(node.up)
                out.append((node.up, signed("\x00" + " ".join(page.nodes[node.up].children)), -1, 0.0))
    return out


def importances(pages: DataFrame, threshold: float, gamma: float, prior: float) -> DataFrame:
    """``(host, low)``: per host, ``(path, importance)`` of the nodes with text whose importance is below the threshold.

    Importance of a node is ``(e (gamma c + (1 - gamma) s) + prior p) / (e + prior)``: evidence e, content importance c,
    presentation importance s of its parent (1 with one page), prior p of the markup. Pages of the same text on one host count
    once.
    """

    def run(batches):
        names = ["host", "copy", "path", "feature", "weight", "x"]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float32())
        for hosts, sources in rows_of(batches, ["host", "html"], 256):
            rows: list[tuple] = []
            for host, source in zip(hosts, sources, strict=True):
                if source:
                    page = Page(source)
                    copy = signed("\n".join(f"{p}:{t}" for p, t in page.blocks))
                    rows += [(host, copy, *f) for f in features(page, host)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    seen = pages.select("host", "html").mapInArrow(run, "host string, copy long, path long, feature long, weight int, x float")
    one = seen.groupBy("host", "path", "feature", "weight").agg(F.countDistinct("copy").alias("k"), F.max("x").alias("x"))
    one = staged(one, "style")
    # in the merged tree only what recurs on several hosts has another count than in the host's
    merged = one.where("weight >= 0").groupBy("path", "feature", "weight").agg(F.sum("k").alias("kk"), F.count("*").alias("hosts")).where("hosts > 1").drop("hosts")
    both = one.join(merged, ["path", "feature", "weight"], "left").withColumn("kk", F.coalesce("kk", "k"))
    here, text, shape = F.col("weight") == 0, F.col("weight") > 0, F.col("weight") == -1
    share = F.col("weight") * F.col("k")
    node = both.groupBy("host", "path").agg(
        F.max(F.when(here, F.col("k"))).alias("m"), F.max(F.when(here, F.col("kk"))).alias("mm"), F.max(F.when(here, F.col("x"))).alias("p"), F.max(F.when(here, F.col("feature"))).alias("up"),
        F.sum(F.when(text, share)).alias("w"), F.sum(F.when(text, share * F.log("k"))).alias("wk"), F.sum(F.when(text, share * F.log("kk"))).alias("wkk"),
        F.sum(F.when(shape, F.col("k"))).alias("s"), F.sum(F.when(shape, F.col("k") * F.log("k"))).alias("sk"),
    )
    node = staged(node, "nodes")
    left = lambda wk, m: F.when(F.col(m) > 1, F.greatest(F.lit(0.0), 1 - F.col(wk) / F.col("w") / F.log(m))).otherwise(1.0)
    content = F.least(left("wk", "m"), left("wkk", "mm"))
    parents = node.where("s > 0").select("host", F.col("path").alias("up"), F.when(F.col("s") > 1, (F.log("s") - F.col("sk") / F.col("s")) / F.log("s")).otherwise(1.0).alias("shown"))
    texts = node.where("w > 0").withColumn("c", content).withColumn("e", F.log2(F.greatest("m", "mm"))).drop("s", "sk")
    found = gamma * F.col("c") + (1 - gamma) * F.coalesce("shown", F.lit(1.0))
    weighed = (F.col("e") * found + prior * F.col("p")) / (F.col("e") + prior)
    rated = texts.join(parents, ["host", "up"], "left").select("host", "path", weighed.alias("importance"))
    return rated.where(F.col("importance") < threshold).groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("low"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, gamma: float = 0.9, prior: float = 8.0) -> DataFrame:
    """Per row of ``pages``: id, ``url``, main ``text`` and ``n_chars``, its code points.

    Character references are decoded, white space in a block becomes one space, blocks are
    joined by line ends. A null or empty page has an empty text, an empty table an empty result. Null URLs share one host.
    Repeated rows count as one page in the statistics and each get a result; ties of importance stay or go together. Broken
    markup is read as far as it goes, pages of any length are read whole. Other columns are not read.

    Scale: two narrow passes over the pages. Features of pages are hashes and are counted with map-side
    combination, so a host with a third of all pages is no hot spot; the branches of a host are joined back
    to its pages in a join that adaptive execution splits.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    low = staged(importances(rows, threshold, gamma, prior), "low")

    def run(batches):
        for ids, urls, sources, lows in rows_of(batches, ["id", "url", "html", "low"], 256):
            texts = []
            for source, x in zip(sources, lows, strict=True):
                below = {r["path"]: r["importance"] for r in x or ()}
                texts.append(Page(source).main_text(below, threshold) if source else "")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    return rows.join(low, "host", "left").select("id", "url", "html", "low").mapInArrow(run, f"`{id_col}` long, url string, text string, n_chars long")
