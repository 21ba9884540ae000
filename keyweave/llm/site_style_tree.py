"""The main text of web pages by a site style tree.

The pages of a host are merged into one tree of styles: a node is an element's tag and class below its parent's node. A node
is important as far as its pages differ in it. For presentation that is the entropy of its child sequences over the
pages; for content it is one minus the entropy of each text over the pages that show it, so what many pages repeat is
worth little. The log base is the node's number of pages; a node of one page counts as important.

What elements say of themselves comes first: branches that are named as navigation, footer, advert, form and so on have no
weight, and where a page marks its article, nothing else has. Importance decides on all branches that pages leave open, and
on the branches inside an article; its plain headings and paragraphs are its own text. A branch whose name only hints at
noise keeps half of its importance, so it stays where its site shows something else on nearly every page. Equal pages of a
host count once. What is repeated in most of an article is a copy's text and stays.

Nodes are numbered by hashes of their parent's number and their style, so a page takes memory for its elements, however deep
they are nested. A page is parsed in its task; the merged tree is never in one place, but counted by (host, node, variant), first in the
map tasks, so a host with most of the pages is no more than its nodes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.llm.columns import column, fresh

# Element names of HTML by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
NOISE_TAGS = set(
    "aside button canvas dialog fieldset footer form head iframe input label menu nav noscript object option select style svg"
    " template textarea title".split()
)
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disclaimer disqus footer login menu modal nav navbar navigation newsletter notice notices notification notifications pager"
    " pagination popup promo related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " toolbar".split()
)
#: With a noise word they name a part of it: `ad-slot`, `cookie-bar`, `user-comment`.
PART_WORDS = set(
    "area author bar body block bottom box button buttons center container count form global group icons inline inner item"
    " items label left link links list message meta more native overlay page panel posts primary reader readers right"
    " secondary section site slot thread top unit user users wrap wrapper".split()
)
#: They may name noise or an article's own part; so does a noise word in a token with other words.
HINT_WORDS = set("discussion promotion widget widgets".split())
#: Before a noise word they tell of an element beside or below: `has-sidebar`.
STATE_WORDS = set("has is no not with without open closed enabled disabled".split())
#: Noise only outside an article, whose own header holds its title.
OUTER_NOISE_WORDS = {"header", "masthead", "top"}
SITE_WORDS = {"global", "page", "site"}
#: Never noise by a class or id: what these hold is the page. Ids of headings are the targets of links.
WHOLE_TAGS = set("html body main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
COMMENT_WORDS = set("comment comments reply replies respond".split())
#: An article's own text where they have no class; other blocks inside it are branches.
PLAIN_TAGS = set("blockquote br h1 h2 h3 h4 h5 h6 header hgroup p pre".split())
ARTICLE_ROLES, ARTICLE_WORDS = {"article", "main"}, {"article", "articlebody", "post", "entry", "story"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1[^>]*+>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>|<(/?)([a-z][^\s/>]*+)([^>]*+)>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")  # with its value, so no value is read as names
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]{3,}|\s+|/")  # numbers of pages and posts don't tell styles apart
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", re.IGNORECASE)
_NAMES = NOISE_WORDS | OUTER_NOISE_WORDS | ARTICLE_WORDS | PART_WORDS

NOISE, OPEN, ARTICLE, BRANCH, DOUBTED, OPEN_DOUBTED = 0, 1, 2, 3, 4, 5  # a branch is inside an article, a doubted one has a hint of noise
INSIDE = (ARTICLE, BRANCH, DOUBTED)


@dataclass(frozen=True)
class TreeRule:
    least_importance: float = 0.4
    #: The weight of content against the presentation of the node above it.
    content_weight: float = 0.9
    #: What is left of the importance of a branch whose name hints at noise.
    hinted_weight: float = 0.5


@dataclass(slots=True)
class _Element:
    tag: str
    node: str  # a hash of its style and of the nodes above it
    path: str  # the node above and its own
    mark: int
    children: list[str]
    block: str  # path of the nearest block
    in_article: bool


def _named_noise(token: set[str]) -> bool:
    """A class or id names noise if it has a noise word and all its words are names: `post-footer`, but not `has-sidebar`."""
    return bool(token & NOISE_WORDS) and token <= _NAMES


def _hints_at_noise(token: set[str]) -> bool:
    return bool(token & HINT_WORDS or token & NOISE_WORDS) and not token & STATE_WORDS


def _style_and_names(tag: str, attributes: str) -> tuple[str, str | None, list[set[str]]]:
    """The style of an element, its role (None if it is hidden), and the words of each of its classes and ids."""
    style, role, tokens = tag, "", []
    for name, *values in _ATTRIBUTE.findall(attributes):
        kind = name.lower()
        if kind == "hidden":
            return f"{tag}.hidden", None, []
        if kind not in ("class", "id", "role", "itemprop") or (kind == "id" and tag in HEADINGS):
            continue
        value = "".join(values).lower()
        if kind == "role":
            role = value
        else:
            tokens += [set(_WORD.findall(token)) for token in value.split()]
            style += "." + _NUMBER.sub("#", value) if kind == "class" and value else ""
    return style, role, tokens


def _marks(tag: str, attributes: str, above: int, in_article: bool = False) -> tuple[str, int]:
    """The style of an element, and whether it is noise, an article, a branch inside one or left open, with a hint of noise or without."""
    style, role, tokens = _style_and_names(tag, attributes)
    if role is None or above == NOISE or tag in NOISE_TAGS or role in NOISE_ROLES:
        return style, NOISE
    if tag == "article":
        # Articles inside an article are its comments or other articles: their names count, and else their importance.
        if any(_named_noise(t) and (in_article or t <= COMMENT_WORDS) for t in tokens):
            return style, NOISE
        return style, BRANCH if in_article else ARTICLE
    named = tag not in WHOLE_TAGS
    if named and any(map(_named_noise, tokens)):
        return style, NOISE
    if tag == "main" or role in ARTICLE_ROLES:
        return style, ARTICLE
    if tag in ("div", "section") and any(t & ARTICLE_WORDS and not t & NOISE_WORDS for t in tokens):
        return style, above if above == DOUBTED else ARTICLE
    inside = above in INSIDE
    if not inside and (tag == "header" or (named and any(t - SITE_WORDS and t - SITE_WORDS <= OUTER_NOISE_WORDS for t in tokens))):
        return style, NOISE
    if named and any(map(_hints_at_noise, tokens)):
        return style, DOUBTED if inside else OPEN_DOUBTED
    if above == ARTICLE and tag in BLOCKS and (style != tag or tag not in PLAIN_TAGS):
        return style, BRANCH
    return style, above


class PageParser:
    """One page as blocks (path, mark, text) in page order, and the child sequences of its nodes."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, str]] = []
        self.nodes: dict[str, list[str]] = {}
        self.stack = [_Element("", "", "", OPEN, [], "", False)]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        at = 0
        for m in _TOKEN.finditer(page):
            self._add(page[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag:
                self._tag(tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or "")
        self._add(page[at:])
        self._end_block()
        for element in self.stack:
            self._leave(element)

    def _add(self, text: str) -> None:
        if text:
            self.text.append(text)

    def _end_block(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.stack[-1].block, self.stack[-1].mark, text))
            self.text = []

    def _leave(self, element: _Element) -> None:
        if element.children:
            self.nodes.setdefault(element.node, []).extend(element.children)

    def _pop(self) -> _Element:
        element = self.stack.pop()
        self.open[element.tag] -= 1
        self._leave(element)
        return element

    def _tag(self, tag: str, ends: bool, attributes: str) -> None:
        above = self.stack[-1]
        style, mark = (tag, above.mark) if ends or tag in VOID else _marks(tag, attributes, above.mark, above.in_article)
        if tag in BLOCKS or (not ends and mark != above.mark) or (ends and above.tag == tag and len(self.stack) > 1 and above.mark != self.stack[-2].mark):
            self._end_block()
        if tag in VOID:
            return
        if ends:
            if self.open[tag]:
                while self._pop().tag != tag:
                    pass
            return
        if tag == "p" and above.tag == "p" or tag == "li" and above.tag == "li":
            self._pop()
            above = self.stack[-1]
            style, mark = _marks(tag, attributes, above.mark, above.in_article)
        if not above.children or above.children[-1] != style:
            above.children.append(style)
        if not attributes.endswith("/"):
            node = xxhash.xxh3_64_hexdigest(f"{above.node} {style}".encode("utf-8", "surrogatepass"))
            path = f"{above.node}/{node}"
            self.open[tag] += 1
            self.stack.append(_Element(tag, node, path, mark, [], path if tag in BLOCKS else above.block, above.in_article or tag == "article"))


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _same(blocks: list[dict]) -> int:
    """A digest of what isn't noise in a page: equal pages of a host count once."""
    return _digest(" ".join(f"{b['path']} {b['digest']}" for b in blocks if b["mark"]))


def parse_page(page: str | None) -> tuple[list[dict], list[dict]]:
    """Blocks (path, mark, digest, and the text unless it is noise), and nodes (path, digest of the child sequence)."""
    if not page:
        return [], []
    parsed = PageParser(page)
    has_article = any(mark in INSIDE for _, mark, _ in parsed.blocks)
    blocks = []
    for path, mark, text in parsed.blocks:
        mark = NOISE if has_article and mark not in INSIDE else mark
        blocks.append({"path": path, "mark": mark, "digest": _digest(text), "text": text if mark else None})
    return blocks, [{"path": path, "digest": _digest(" ".join(c))} for path, c in parsed.nodes.items() if c]


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


_BLOCK = pa.struct([("path", pa.string()), ("mark", pa.int8()), ("digest", pa.int64()), ("text", pa.string())])
_NODE = pa.struct([("path", pa.string()), ("digest", pa.int64())])
PARSED = (
    "struct<host: string, same: bigint, blocks: array<struct<path: string, mark: tinyint, digest: bigint, text: string>>,"
    " nodes: array<struct<path: string, digest: bigint>>>"
)


def parsed_pages(urls: pa.Array, pages: pa.Array) -> pa.Array:
    found = [parse_page(page.as_py()) for page in pages]
    return pa.StructArray.from_arrays(
        [
            pa.array([host_of(url.as_py()) for url in urls], pa.string()),
            pa.array([_same(blocks) for blocks, _ in found], pa.int64()),
            pa.array([blocks for blocks, _ in found], pa.list_(_BLOCK)),
            pa.array([nodes for _, nodes in found], pa.list_(_NODE)),
        ],
        ["host", "same", "blocks", "nodes"],
    )


def _of_variants(rows: DataFrame, name: str) -> DataFrame:
    """For rows (host, path, digest), one for each page and variant: pages, and the entropy parts, of each node."""
    counted = rows.groupBy("host", "path", "digest").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("host", "path").agg(F.sum(F.col("c") * F.log("c")).alias(f"{name}_log"), F.sum("c").alias(f"{name}_sum"))


def node_importance(pages: DataFrame, rule: TreeRule) -> DataFrame:
    """(host, path, importance) of the nodes that hold blocks, from pages (host, blocks, nodes)."""
    texts = pages.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["digest"].alias("digest"))))).alias("b"))
    content = _of_variants(texts.select("host", "b.path", "b.digest"), "content")
    shown = pages.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["path"]))).alias("path"))
    content = content.join(shown.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")), ["host", "path"])
    # Over m pages, a text that c of them show has entropy log(c) / log(m); the mean is taken over all shown texts.
    repeated = F.when(F.col("pages") > 1, F.col("content_log") / F.col("content_sum") / F.log("pages")).otherwise(0.0)
    above = F.regexp_replace("path", "/[^/]*$", "")
    content = content.select("host", "path", above.alias("above"), (1 - repeated).alias("content"))

    nodes = pages.select("host", F.inline("nodes"))
    styled = _of_variants(nodes, "style")
    varied = F.when(
        F.col("style_sum") > 1, (F.log("style_sum") - F.col("style_log") / F.col("style_sum")) / F.log("style_sum")
    ).otherwise(1.0)
    styled = styled.select("host", F.col("path").alias("above"), varied.alias("presentation"))
    w = rule.content_weight
    both = w * F.col("content") + (1 - w) * F.coalesce("presentation", F.lit(1.0))
    return content.join(styled, ["host", "above"], "left").select("host", "path", both.alias("importance"))


def _differing(pages: DataFrame) -> DataFrame:
    """One of each equal pages of a host, from pages (host, same, page, blocks, nodes)."""
    counted = pages.groupBy("host", "same").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = cut(counted.where("n > 1").drop("n"), "copied-pages")
    return pages.join(copied, ["host", "same"], "left").where("first IS NULL OR page = first").select("host", "blocks", "nodes")


def _decided(block: Column) -> Column:
    """Importance decides on it."""
    return ~block["mark"].isin(NOISE, ARTICLE)


def _weight(mark: Column, rule: TreeRule) -> Column:
    return F.when(mark.isin(DOUBTED, OPEN_DOUBTED), rule.hinted_weight).otherwise(1.0)


def extract_text(df: DataFrame, url: str = "url", page: str = "html", out: str = "main_text", rule: TreeRule = TreeRule(), keep_page: bool = True) -> DataFrame:
    """Add the main text of each whole page: its blocks in page order, joined by a space.

    White space in a block is one space, character references are decoded. A page without text, a null or an empty one gives
    an empty text; pages without a host in their url are one site. Rows stay as they are; repeated ones count as pages of
    their own. Other columns are kept, one named like the output is replaced. With `keep_page` false the page isn't
    written nor returned.
    """
    own = [c for c in df.columns if c != out and (keep_page or c != page)]
    kept, found = fresh(df, "kept"), fresh(df, "parsed")
    packed = df.select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(own)]).alias(kept) if own else F.lit(None).alias(kept),
        F.arrow_udf(parsed_pages, PARSED)(column(url).cast("string"), column(page).cast("string")).alias(found),
    )
    pages = cut(packed.select(kept, f"{found}.*").withColumn("page", F.monotonically_increasing_id()), "parsed-pages")
    judged = node_importance(_differing(pages), rule)
    weak = cut(judged.where(F.col("importance") * rule.hinted_weight < rule.least_importance), "weak-nodes")
    # Each page looks up its own nodes, so a site's weak styles are never in one row.
    asked = F.array_distinct(F.transform(F.filter("blocks", _decided), lambda b: F.struct(b["path"].alias("path"), b["mark"].alias("mark"))))
    found_weak = pages.select("page", "host", F.inline(asked)).join(weak, ["host", "path"]).where(F.col("importance") * _weight(F.col("mark"), rule) < rule.least_importance)
    lost = cut(found_weak.groupBy("page").agg(F.collect_list(F.struct("path", "mark")).alias("weak")), "weak-branches")
    joined = pages.join(lost, "page", "left").withColumn("weak", F.coalesce("weak", F.array().cast("array<struct<path: string, mark: tinyint>>")))
    shown = F.filter("blocks", lambda b: b["mark"] != NOISE)
    strong = F.filter("blocks", lambda b: (b["mark"] != NOISE) & ~F.array_contains("weak", F.struct(b["path"].alias("path"), b["mark"].alias("mark"))))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.char_length(b["text"]))
    # An article that would lose most of its text is itself what pages repeat: an edited copy.
    copy = F.exists("blocks", lambda b: b["mark"].isin(*INSIDE)) & (chars(strong) * 2 < chars(shown))
    text = F.array_join(F.transform(F.when(copy, shown).otherwise(strong), lambda b: b["text"]), " ")
    texts = joined.select(kept, text.alias("text"))
    return texts.select(*[F.col(f"{kept}.c{i}").alias(c) for i, c in enumerate(own)], F.col("text").alias(out))
