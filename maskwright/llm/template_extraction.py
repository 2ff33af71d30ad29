"""Main text of web pages by equivalence-class template deduction.

A token is an element, known by its path of tags and classes, or a text node,
known by its path and its text. For every token of a host, Spark sums how many
different pages have it and a hash of its occurrence vector (which pages, how
often). Tokens of one host with equal vectors form an equivalence class; a class
of at least two tokens that stands on at least the share `support` of the host's
pages is valid. A valid class nests in the deepest element of another one that
all its tokens stand in; together they are the host's template. What the elements
of the page's own class (those that stand exactly once on every page) hold
besides template tokens are slots. The main slot is the deepest of these elements
that holds blocks and over half of the host's text, where text that varies counts
twice; no title (h1) is left behind on the way to it.

On a host with a template, at least `least_pages` different pages, the article is
what the main slot holds. Elsewhere, and on pages without that slot, it is what
an article or main element holds, else all that is left but text of the template.
Elements that are never article text by their tag or by the words of their class,
id or role (menus, adverts, forms, comments and so on) are left out everywhere,
since a template can't tell a reader's comment from a paragraph.

Nulls: a null url is a host of its own name, a null html an empty page, which
has an empty text. Repeated rows return each; the template counts equal pages
once. Empty tables give empty results. Unclosed and misnested tags end where
their parents do. Pages of any length are read whole. Columns other than the id,
url and html are not read, so no name clashes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table, written
from .url_cascade import host_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("head nav footer aside form script style noscript template textarea title button select option input iframe object svg canvas audio video dialog menu menuitem".split())
#: Words of a class, id or role that say an element is not the article's text.
OTHER = frozenset(
    "ad ads advert advertisement adverts advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus dialog donate "
    "footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup promo promotion promoted related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar widget widgets".split()
)
#: How surely an element is the article's: by its tag, or by a word of its class, id, role or itemprop.
ARTICLE_TAGS = {"article": 3, "main": 2}
ARTICLE_WORDS = {"articlebody": 3, "main": 1, "maincontent": 1}
#: An opening tag in the first set ends an open element of the second, as far up as the third allows.
ENDS = {
    "p": (frozenset(["p"]), frozenset(["article", "main", "section", "div", "td", "th", "li", "body", "blockquote", "button", "object"])),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())


@dataclass
class Element:
    tag: str
    path: str
    left_out: bool
    article: int


@dataclass
class Block:
    """A run of text that no block element divides, and the elements it stands in."""

    path: str
    text: str
    left_out: bool
    article: int


@dataclass
class Page:
    elements: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _marks(attributes: str) -> tuple[str, set[str]]:
    """The class and id as they stand in a path, and the words of class, id and role in lower case."""
    if "=" not in attributes:
        return "", set()
    names, words = [], set()
    for key, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key in ("class", "id"):
            names.append(("." if key == "class" else "#") + re.sub(r"\d+", "0", value.strip()).replace("/", "_"))
        words |= {w.lower() for w in PART.findall(value)}
        words.add(re.sub(r"[^a-z]", "", value.lower()))
    return "".join(names), words


def read_page(source: str | None) -> Page:
    """The page's elements and blocks, in page order."""
    page = Page()
    if not source:
        return page
    stack = [Element("", "", False, 0)]
    pieces: list[str] = []
    where = stack[0]

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                page.blocks.append(Block(where.path, text, where.left_out, where.article))
            pieces.clear()

    def close(names: frozenset[str], until: frozenset[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in names:
                if any(e.tag not in INLINE for e in stack[at:]):
                    flush()
                del stack[at:]
                return
            if stack[at].tag in until:
                return

    at, size = 0, len(source)
    match = TOKEN.match
    while at < size:
        m = match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if not pieces:
                    where = next((e for e in reversed(stack) if e.tag not in INLINE), stack[0])
                inner = stack[-1]
                if inner.left_out and not where.left_out:
                    continue
                pieces.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                pieces.append(" ")
            elif tag not in VOID:
                close(frozenset([tag]), frozenset())
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS:
                close(*ENDS[tag])
            elif tag in BLOCKS_END_P:
                close(*ENDS["p"])
        name, words = _marks(m[3])
        parent = stack[-1]
        article = max(parent.article, ARTICLE_TAGS.get(tag, 0), *(ARTICLE_WORDS.get(w, 0) for w in words)) if words else max(parent.article, ARTICLE_TAGS.get(tag, 0))
        left_out = parent.left_out or tag in LEFT_OUT or (tag == "header" and parent.article < ARTICLE_TAGS["article"]) or not words.isdisjoint(OTHER)
        if tag in ("html", "body"):
            left_out = False
        element = Element(tag, f"{parent.path}/{tag}{name}", left_out, article)
        page.elements.append(element.path)
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else size
            continue
        stack.append(element)
    flush()
    return page


def text_hash(text: str) -> int:
    """Of a text node; never 0, which stands for the element itself."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) - (1 << 63) or 1


# --- deduction -------------------------------------------------------------

TOKENS = "host string, path string, text long, page long, number long, chars long"


def page_tokens(source: str | None) -> dict[tuple[str, int], list[int]]:
    """A page's tokens: how often each stands there, and the characters that may be article text. The page itself is one, with an empty path."""
    page = read_page(source)
    counts: dict[tuple[str, int], list[int]] = {("", 0): [1, 0]}
    for path in page.elements:
        counts.setdefault((path, 0), [0, 0])[0] += 1
    for block in page.blocks:
        slot = counts.setdefault((block.path, text_hash(block.text)), [0, 0])
        slot[0] += 1
        slot[1] += 0 if block.left_out else len(block.text)
    return counts


def tokens(pages: DataFrame, host: str, source: str) -> DataFrame:
    """A row for each token of each page. page: a hash of the page's source."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch[host], batch[source], strict=True):
                page = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 7) - (1 << 63)
                out += [(name, path, hashed, page, n, chars) for (path, hashed), (n, chars) in page_tokens(text).items()]
            yield pd.DataFrame(out, columns=["host", "path", "text", "page", "number", "chars"])

    return pages.select(host, source).mapInPandas(rows, TOKENS)


@dataclass
class Template:
    #: Of every valid class: its tokens (path and text hash, 0 for elements) and the element that it nests in.
    classes: list[tuple[list[tuple[str, int]], str]]
    slot: str | None


def nest(found: list[tuple[str, int, object, int, int]]) -> Template:
    """The template of a host's frequent tokens: (path, text, vector, score, deep) of each. score: the text that an element holds; deep: that of its inner blocks."""
    by_vector: dict[object, list[tuple[str, int]]] = {}
    for path, text, vector, _, _ in found:
        by_vector.setdefault(vector, []).append((path, text))
    valid = {v: sorted(m) for v, m in by_vector.items() if len(m) >= 2}
    # Elements of valid classes, from the deepest.
    elements = sorted(((path, v) for v, m in valid.items() for path, text in m if text == 0), key=lambda x: (-x[0].count("/"), x[0]))
    classes = []
    for v, members in valid.items():
        shared = next((e for e, other in elements if other != v and all(p == e and t or p.startswith(e + "/") for p, t in members)), "")
        classes.append((members, shared))
    own = next((v for v, m in valid.items() if ("", 0) in m), None)
    score = {path: (s, d) for path, text, v, s, d in found if text == 0 and v == own}
    titles = [e for e in score if re.search(r"/h1[^/]*$", e)]
    slot = None
    for e in sorted(score, key=lambda x: (x.count("/"), x)):
        inside = e.startswith(slot + "/") if slot else e != ""
        total, deep = score[e]
        if inside and 2 * total > score[""][0] and 2 * deep > total and all(t.startswith(e + "/") for t in titles):
            slot = e
    return Template(sorted(classes), slot)


def deduce_templates(pages: DataFrame, host: str = "host", source: str = "html", support: float = 0.5, least_pages: int = 3, text_support: float = 0.9, salts: int = 32) -> DataFrame:
    """(host, paths, texts, constants, classes, slot): the template's element paths, its constant texts, those with their paths, its nested classes and the main slot.

    Copies of a page count once. A template has at most 1/support times as many
    tokens as a page has on average, so what is gathered by host is small however
    many pages it has; the tokens of a very common host meet its number of pages
    in `salts` parts.
    """
    same = ["host", "path", "text"]
    # Copies meet by their tokens, which are much smaller than pages.
    each = tokens(pages, host, source).dropDuplicates([*same, "page"]).withColumn("v", F.xxhash64("page", "number"))
    low, high = F.col("v").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("v", 32)
    sums = written(each.groupBy(*same).agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("chars").alias("chars")), "tokens")
    sizes = sums.where("path = '' and text = 0").select("host", F.col("n").alias("pages")).where(F.col("pages") >= least_pages)
    salted = sizes.select("host", "pages", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    frequent = sums.where("n > 1").withColumn("salt", F.pmod(F.hash("path", "text"), F.lit(salts))).join(salted, ["host", "salt"]).where(F.col("n") >= support * F.col("pages"))
    frequent = written(frequent.drop("salt"), "frequent")
    by_path = sums.where("text <> 0").groupBy("host", "path").agg(F.sum("chars").alias("total"))
    fixed = frequent.where("text <> 0").groupBy("host", "path").agg(F.sum("chars").alias("fixed"))
    parts = F.split("path", "/")
    above = by_path.join(fixed, ["host", "path"], "left").select("host", "path", (2 * F.col("total") - F.coalesce("fixed", F.lit(0))).alias("score"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("element"))
    held = above.groupBy("host", F.col("element").alias("path")).agg(F.sum("score").alias("score"), F.sum(F.when(F.col("element") != F.col("path"), F.col("score")).otherwise(0)).alias("deep"))
    marked = frequent.join(held.withColumn("text", F.lit(0).cast("long")), same, "left")
    most = (F.col("n") >= text_support * F.col("pages")) & (F.col("text") != 0)
    member = F.struct("path", "text", "n", "low", "high", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("deep", F.lit(0)).alias("deep"), most.alias("most"))
    by_host = marked.groupBy("host").agg(F.collect_list(member).alias("members"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("paths", "texts", "constants", "classes", "slot")}
            for members in batch["members"].to_pylist():
                members.sort(key=lambda m: (m["path"], m["text"]))
                template = nest([(m["path"], m["text"], (m["n"], m["low"], m["high"]), m["score"], m["deep"]) for m in members])
                valid = {t for c, _ in template.classes for t in c}
                fixed = [(m["path"], m["text"]) for m in members if m["most"] and (m["path"], m["text"]) in valid]
                out["paths"].append([p for p, t in sorted(valid) if t == 0])
                out["texts"].append(sorted({t for _, t in fixed}))
                out["constants"].append([{"path": p, "text": t} for p, t in fixed])
                out["classes"].append([{"inside": inside, "tokens": [{"path": p, "text": t} for p, t in c]} for c, inside in template.classes])
                out["slot"].append(template.slot)
            yield {"host": batch["host"], **out}

    return map_columns(by_host, rows, "host string, paths array<string>, texts array<long>, constants array<struct<path:string,text:long>>, classes array<struct<inside:string,tokens:array<struct<path:string,text:long>>>>, slot string")


# --- extraction ------------------------------------------------------------


def main_text(source: str | None, constants: frozenset[tuple[str, int]] = frozenset(), slot: str | None = None) -> str:
    """The article's blocks, two line feeds between them: those of the slot but for constants; without it, of an article or main element; else all but constants (path and text hash)."""
    blocks = [b for b in read_page(source).blocks if not b.left_out]
    if slot and (held := [b for b in blocks if b.path == slot or b.path.startswith(slot + "/")]):
        # What every page has in its slot is the template's too, such as a notice under each article; where that is most of the slot, pages are copies of one article.
        own = [b for b in held if (b.path, text_hash(b.text)) not in constants]
        if 2 * sum(len(b.text) for b in own) < sum(len(b.text) for b in held):
            own = held
        return "\n\n".join(b.text for b in own)
    surest = max((b.article for b in blocks), default=0)
    if surest > 0:
        return "\n\n".join(b.text for b in blocks if b.article == surest)
    return "\n\n".join(b.text for b in blocks if not constants or (b.path, text_hash(b.text)) not in constants)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", broadcast_tokens: int = 200_000) -> DataFrame:
    """(page_id, url, text) of every page. Templates go to every worker while they have at most broadcast_tokens tokens together; larger ones are joined by host, where Spark splits a host that is very common."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.coalesce(F.col(url), F.lit(""))).alias("host"))
    templates = written(deduce_templates(own), "templates")
    size = templates.agg(F.sum(F.size("texts") + F.size("constants") + F.size("paths"))).first()[0] or 0
    needed = templates.select("host", "constants", "slot")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("html", "constants", "slot"))
            out = [main_text(h, frozenset((x["path"], x["text"]) for x in c or ()), s) for h, c, s in zip(*columns, strict=True)]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": out}

    joined = own.join(F.broadcast(needed) if size <= broadcast_tokens else needed, "host", "left").select("page_id", "url", "html", "constants", "slot")
    kind = own.schema["page_id"].dataType.simpleString()
    return map_columns(joined, rows, f"page_id {kind}, url string, text string")


def op5_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
