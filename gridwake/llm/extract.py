"""Main text of web pages: boilerplate by tag and role, and site templates by recurring subtrees.

Each page is parsed into elements; scripts, styles, navigation, headers, footers, sidebars, forms,
and blocks whose class, id or role says notice, advert or comments are left out. The main content is
the page's article or main element if it has one. Site templates: every other block's subtree is
hashed, hashes are counted per host in Spark, and subtrees that recur on RECURS pages of a host, and
on a share SHARE of them, are deleted. Pages of a host with equal html count as one page. Within main
content only containers can be templates, on half of the host's pages at least, and none that holds
half of the content: a paragraph or an article that a site shows on many pages is still the page's
text. Nor is html or body a template on pages without main content, or a block with half of the
page's text; such a block is kept whole.

Text: character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by one newline, empty ones left out.

Defined results: null or empty html gives an empty text; a null or odd url is a host of its own
name (the empty one); very long pages are parsed whole; repeated rows are extracted each; a subtree that
recurs on just the least share is a template; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import common

#: A subtree is a template if so many pages of its host have it, and that share of them.
RECURS, SHARE = 3, 0.2
#: Containers in main content need more, and must hold less than half of its characters.
INNER_RECURS, INNER_SHARE = 5, 0.5

#: Templates' keys of all hosts up to which they are broadcast, 8 bytes each; tasks that a host's pages go to beyond.
#: A key is on a fifth of its host's pages at least, so a host has five times as many as its pages have blocks at most.
BROADCAST_KEYS, SALTS = 500_000, 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S)
#: A tag whose quotes do not close.
_OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "template", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROP = _RAW | {"nav", "header", "footer", "aside", "form", "head", "noscript", "button", "select", "svg", "object", "dialog", "menu", "canvas", "audio", "video", "fieldset"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|newsletter|subscribe|signup|comments?|disqus|replies|respond|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|footer|masthead|social|share|sharing|related|recommended|widget|toolbar|pagination|skip-link|login|search)(?:$|[\s_-]|\d)", re.I)
_SPACES = re.compile(r"\s+")
#: An element that a start tag of these closes if it is open, up to a container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "td", "blockquote", "nav", "aside", "header", "footer", "form"}
_P_ENDS = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}


#: Elements that hold a whole page.
_FRAME = {"html", "body"}
_CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "figure", "blockquote"}


class Node:
    __slots__ = ("tag", "noise", "main", "children", "key", "size")

    def __init__(self, tag: str, noise: bool = False, main: bool = False):
        self.tag, self.noise, self.main = tag, noise, main
        self.children: list = []
        self.key = self.size = 0


def parse(html: str) -> Node:
    """A tree of elements and text; unclosed and stray tags are taken as browsers roughly do."""
    root = Node("html")
    open_ = [root]
    at, n = 0, len(html)
    match = _TOKEN.match
    while at < n:
        m = match(html, at)
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text == "<" and (html[at : at + 1].isalpha() or html[at : at + 1] == "/" and html[at + 1 : at + 2].isalpha()):
            m = _OPEN_QUOTE.match(html, at - 1)
            if m is None:  # a tag that never ends
                break
            at = m.end()
            close, tag, attributes = m.groups()
        elif text is not None:
            open_[-1].children.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
                if open_[i].tag in _SCOPE and tag not in _BLOCK:
                    break
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at) if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea") else None
            if end is None and (tag in ("script", "style", "textarea", "title", "xmp")):
                at = n
            elif end is not None:
                at = end.end()
            continue
        if tag in _P_ENDS:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == "p":
                    del open_[i:]
                    break
                if open_[i].tag in _SCOPE:
                    break
        if tag in _CLOSES:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in _CLOSES[tag]:
                    del open_[i:]
                    break
                if open_[i].tag in _SCOPE - {"td"}:
                    break
        noise, main = tag in _DROP, tag in ("article", "main")
        if attributes and not noise:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value = a or b or c
                name = name.lower()
                if name in ("class", "id"):
                    # the page's own frame may be called anything
                    noise |= tag not in ("body", "html", "article", "main") and bool(_NOISE.search(value))
                elif name == "role":
                    noise |= value.lower() in _ROLE
                    main |= value.lower() == "main"
                elif name in ("hidden", "aria-hidden"):
                    noise |= name == "hidden" or value == "true"
                elif name == "style" and "display:none" in value.replace(" ", "").lower():
                    noise = True
        node = Node(tag, noise, main)
        open_[-1].children.append(node)
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            open_.append(node)
    return root


def hashed(node: Node) -> int:
    """Keys of an element's subtree, 64 bits by its tag and its children's keys and text."""
    stack = [(node, False)]
    while stack:
        x, done = stack.pop()
        if not done:
            stack.append((x, True))
            stack += [(c, False) for c in x.children if isinstance(c, Node)]
        else:
            x.size = sum(c.size if isinstance(c, Node) else len(c) for c in x.children)
            body = "\x00".join(str(c.key) if isinstance(c, Node) else _SPACES.sub(" ", c).strip() for c in x.children)
            x.key = int.from_bytes(hashlib.blake2b(f"{x.tag}\x01{body}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return node.key


def mains(root: Node) -> list[Node]:
    """The outermost main elements that are in no left-out block: `main` ones only if no article is."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.main and not x.noise:
            found.append(x)
            continue
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.noise]
    if len(found) == 1 and found[0].tag != "article":
        inner = [a for c in found[0].children if isinstance(c, Node) and not c.noise for a in mains(c)]
        articles = [a for a in inner if a.tag == "article"]
        return articles or found
    return found


def candidates(root: Node) -> list[tuple[Node, bool]]:
    """Elements that may be templates, and whether they are in main content.

    Outside it any block counts, inside only containers; left-out blocks need no hash.
    """
    inside = set(map(id, mains(root)))
    out, stack = [], [(root, False)]
    while stack:
        x, inner = stack.pop()
        if x.noise:
            continue
        if inner and x.tag in _CONTAINER or not inner and x.tag in _BLOCK and x.tag not in _FRAME and id(x) not in inside:
            out.append((x, inner))
        inner = inner or id(x) in inside
        stack += [(c, inner) for c in x.children if isinstance(c, Node)]
    return out


def text_of(roots: list[Node], templates: frozenset | set = frozenset(), most: float = float("inf")) -> str:
    """Blocks of the elements, one a line, without left-out blocks and templates of up to `most` characters."""
    blocks: list[str] = []
    run: list[str] = []

    def end():
        if run:
            line = _SPACES.sub(" ", entities.unescape("".join(run))).strip()
            if line:
                blocks.append(line)
            run.clear()

    stack: list = list(reversed(roots))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.noise or (templates and x.key in templates and x.tag in _BLOCK and x.size <= most):
            if x.tag in _BLOCK or x.tag not in _RAW:
                end()
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in _BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return "\n".join(blocks)


def visible(node: Node) -> int:
    """Characters of an element's text outside left-out blocks."""
    n, stack = 0, [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            n += len(_SPACES.sub(" ", x).strip())
        elif not x.noise:
            stack += x.children
    return n


def leave_out(root: Node, templates: frozenset | set) -> None:
    """Marks the templates of a page without main content, but none with half of its text, nor what is in such a block."""
    most, stack = visible(root) / 2, [root]
    while stack:
        x = stack.pop()
        if x.noise:
            continue
        if x.key in templates and x.tag in _BLOCK and x.tag not in _FRAME:
            x.noise = visible(x) < most
        else:
            stack += [c for c in x.children if isinstance(c, Node)]


def main_text(html: str, outer=frozenset(), inner=frozenset()) -> str:
    """outer, inner: keys of the host's templates outside and inside of main content."""
    root = parse(html)
    found = mains(root)
    if found:
        if inner:
            hashed(root)
        return text_of(found, inner, sum(x.size for x in found) / 2)
    if outer:
        hashed(root)
        leave_out(root, outer)
    return text_of([root])


def host(url) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][-+.\w]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url) if isinstance(url, str) else None
    return m[1].lower().removeprefix("www.") if m else ""


def templates(pages: DataFrame, recurs: int = RECURS, share: float = SHARE) -> DataFrame:
    """(host, outer, inner): keys of the subtrees that recur over a host's pages."""

    @common.lean
    def run(frames):
        for f in frames:
            found = {}
            for url, page in zip(f["url"], f["html"], strict=True):
                where = host(url)
                text = page if isinstance(page, str) else ""
                same = where, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if same in found:
                    continue
                root = parse(text)
                blocks = candidates(root)
                if blocks:
                    hashed(root)
                found[same] = [sorted({x.key for x, inner in blocks if inner == side}) for side in (False, True)]
            yield pd.DataFrame({"host": [k[0] for k in found], "page": [k[1] for k in found], "outer": [v[0] for v in found.values()], "inner": [v[1] for v in found.values()]})

    # pages of equal html have equal keys, so any of them stands for all
    once = common.texts(pages, "url", "html").mapInPandas(run, "host string, page binary, outer array<long>, inner array<long>").groupBy("host", "page").agg(F.first("outer").alias("outer"), F.first("inner").alias("inner"))
    marked = [F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(c == "inner").alias("inner"))) for c in ("outer", "inner")]
    page = F.array(F.struct(F.lit(None).cast("long").alias("key"), F.lit(False).alias("inner")))
    counts = once.select("host", F.inline(F.concat(page, *marked))).groupBy("host", "key", "inner").agg(F.count("*").alias("n"))
    counts = common.stored(counts.where(F.col("key").isNull() | (F.col("n") >= recurs)), "subtrees")
    total = counts.where("key is null").select("host", F.col("n").alias("pages"))
    least = F.when(F.col("inner"), F.greatest(F.lit(INNER_RECURS), INNER_SHARE * F.col("pages"))).otherwise(share * F.col("pages"))
    kept = counts.where("key is not null").join(total, "host").where(F.col("n") >= least)
    return kept.groupBy("host").agg(F.collect_set(F.when(~F.col("inner"), F.col("key"))).alias("outer"), F.collect_set(F.when(F.col("inner"), F.col("key"))).alias("inner"))


def extract(pages: DataFrame, recurs: int = RECURS, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    found = common.stored(templates(pages, recurs, share), "templates")
    rows = pages.select("page_id", "url", "html")
    if found.isEmpty():
        rows = rows.withColumns({c: F.lit(None).cast("array<long>") for c in ("outer", "inner")})
    else:
        named = F.pandas_udf(lambda u: u.map(host, na_action=None), "string")
        rows = rows.withColumn("host", named("url"))
        keys = found.agg(F.sum(F.size("outer") + F.size("inner"))).first()[0]
        if keys <= BROADCAST_KEYS:
            rows = rows.join(F.broadcast(found), "host", "left").drop("host")
        else:  # a host's pages go to SALTS tasks
            salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
            rows = rows.join(salted, ["host", "salt"], "left").drop("host", "salt")

    @common.lean
    def run(frames):
        for f in frames:
            keys = [[frozenset() if k is None else frozenset(k) for k in f[c]] for c in ("outer", "inner")]
            text = [main_text(h, *k) if isinstance(h, str) else "" for h, *k in zip(f["html"], *keys, strict=True)]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": [len(t) for t in text]})

    return common.texts(rows, *rows.columns).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
