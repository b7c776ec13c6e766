"""Main text of web pages by removal of site templates.

Each page is parsed to its elements once. Blocks of text are kept with the tree of the block
elements around them, as the place of each element's parent and a hash of its subtree. Spark counts per host on how many pages each such subtree recurs, and
every subtree that recurs on many pages of its host is deleted: menus, notices and teasers that
a site repeats. Pages with the same article count once, so an article that a host serves under
many addresses is not taken for its template.

What a page declares not to be article text goes without counting: menus, footers, sidebars,
forms, scripts, styles, and elements whose class or id names an advert, a notice or comments. A
class counts as a whole: "site-footer" names a footer, "has-sidebar" and "social-news" name
nothing. An element that contains an article or main element stays, whatever it declares; only
for comments, related pages, adverts, asides, menus and what is hidden does an article inside
not count if the page has another one. A form stays if it holds a page's frame or main heading.
If a page has an article or main element, only text inside of it counts.

"Many" is MIN_PAGES articles, whatever the size of the host. A host's templates may be as many as
its pages, so they are never gathered: the subtrees of each page meet those that recur one by
one, in a join that is salted by page, with a row only for salts that occur. Only hashes take part
in it. What it finds is dealt back to the stored pages, whose texts are never shuffled.

Nulls: a null html is empty and its text too; a null url belongs to a host of its own. An empty
table has no rows. Unclosed elements end with their parents; a tag cut off by the end is dropped.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.storage import partitions
from shelfscan.sources.workspace import fresh_path

MIN_PAGES = 10
SALTS = 64

# Element names of the HTML standard, and words by which sites name what is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math template".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option menu dialog canvas object audio video".split())
CONTROLS = frozenset("button select option canvas object audio video".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup"
    " html li main ol p pre section summary table tbody td tfoot th thead tr ul hr".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
CLOSED_BY_SAME = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body html blockquote td".split())
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies"
    " share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HOLDING_OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising comment comments disqus promo promoted related reply replies"
    " sponsor sponsored".split()
)
# Words that leave the meaning of an unwanted one beside them in a class, and words for an article that do so for some.
NEUTRAL = frozenset(
    "area bar block bottom box cell col column container content desktop fixed floating form global holder in inner item left"
    " link links list lower main mobile outer overlay page panel primary right row secondary section site slot sticky thread"
    " top unit upper wrap wrapper".split()
)
OF_ARTICLE = frozenset("article articles blog entry post posts stories story user".split())
BESIDE_ARTICLE = frozenset("comment comments footer nav navigation pagination related reply replies share sharing".split())
CONTENT = frozenset("article blog entry entry-content hentry post post-body post-content story".split())
FRAME = frozenset("h1 header nav footer".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(?=/?[a-zA-Z])[^<]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")


KEEP, LAYOUT, OTHERS, ALWAYS = range(4)  # what an element is taken for: see _drop


def _attributes(attributes: str) -> dict[str, str]:
    """Values by name; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape("".join(values)).lower())
    return found


def _named(tokens: set[str], in_article: bool) -> int:
    """What classes or ids say: each counts as a whole, so all its words must say the same."""
    found = KEEP
    for token in tokens:
        words = set(_WORD.findall(token))
        telling = words & UNWANTED
        if not in_article and "header" in words:
            telling.add("header")
        rest = words - telling - NEUTRAL
        if telling and (not rest or rest <= OF_ARTICLE and telling <= BESIDE_ARTICLE):
            found = max(found, OTHERS if telling & HOLDING_OTHERS else LAYOUT)
    return found


def _unwanted(name: str, attributes: str, in_article: bool) -> int:
    if name in DROPPED:
        return ALWAYS if name in RAW or name in CONTROLS else LAYOUT if name == "form" else OTHERS
    if name == "header" and not in_article:
        return LAYOUT
    if not attributes or name in ("html", "body"):
        return KEEP
    found = _attributes(attributes)
    tokens = {*found.get("class", "").split(), *found.get("id", "").split()}
    if name in ("article", "main"):
        return OTHERS if any({"comment", "comments"} & set(_WORD.findall(t)) and _named({t}, in_article) for t in tokens) else KEEP
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return OTHERS
    said = _named(tokens, in_article)
    if said == LAYOUT and tokens & CONTENT:
        said = KEEP
    return max(said, LAYOUT if found.get("role", "").strip() in UNWANTED_ROLES else KEEP)


class _Element:
    __slots__ = ("name", "parts", "parent", "article", "unwanted", "dropped", "holds", "form", "among_others", "code")

    def __init__(self, name: str, parent: _Element | None, article: bool, unwanted: int):
        self.name, self.parent, self.article, self.unwanted = name, parent, article, unwanted
        self.among_others = unwanted == OTHERS or parent is not None and parent.among_others
        self.dropped = self.holds = False
        self.form: _Element | None = None  # the form around, with nothing between that could hold its parts
        self.parts: list = []  # texts and block elements, in order
        self.code = 0


def _drop(elements: list[_Element]) -> None:
    """Mark what goes: an unwanted element with all inside, unless it holds the page's article.

    Articles among comments, related pages and the like count only if the page has no other.
    """
    articles = [e for e in elements if e.name in ("article", "main") and e.unwanted == KEEP]
    free = [e for e in articles if not e.among_others]
    for e in (free or articles) + [e for e in articles if e.name == "main"]:
        while (e := e.parent) is not None and not e.holds:
            e.holds = True
    for e in elements:  # parents before children
        if e.name in FRAME and e.parent.form is not None:
            e.parent.form.holds = True
        if e.name == "form" and not e.article:
            e.form = e
        elif e.parent is not None and e.unwanted in (KEEP, LAYOUT) and e.name not in FRAME:
            e.form = e.parent.form
    for e in elements:
        above = e.parent is not None and e.parent.dropped
        e.dropped = above or e.unwanted == ALWAYS or e.unwanted != KEEP and not e.holds


def _tree(page: str) -> _Element:
    """The block elements of a page with their texts; inline elements leave their text to the block around."""
    root = _Element("#page", None, False, KEEP)
    elements = [root]
    block, stack = root, []  # stack: (name, block before it), for open elements
    opened: Counter[str] = Counter()  # how many of each name are on it
    place = 0

    def close(depth: int) -> None:
        nonlocal block
        block = stack[depth][1]
        opened.subtract(name for name, _ in stack[depth:])
        del stack[depth:]

    raw_until = None
    for token in _TOKEN.finditer(page):
        if raw_until is not None and not (token[1] and token[2].lower() == raw_until):
            continue
        if raw_until is None and token.start() > place and block.unwanted != ALWAYS:
            block.parts.append(page[place : token.start()])
        place = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if token[1]:
            raw_until = None
            for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if name in VOID:
            if name == "br":
                block.parts.append(" ")
            elif name == "hr":
                elements.append(_Element(name, block, block.article, ALWAYS))
                block.parts.append(elements[-1])
            continue
        enders = CLOSED_BY_SAME.get(name) or (("p",) if name in CLOSES_P else ())
        if any(opened[x] for x in enders):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in enders:
                    close(depth)
                    break
                if stack[depth][0] in SCOPES:
                    break
        article = block.article or name in ("article", "main")
        unwanted = _unwanted(name, token[3], block.article)
        stack.append((name, block))
        opened[name] += 1
        if name in BLOCKS or unwanted != KEEP:
            inner = _Element(name, block, article, unwanted)
            elements.append(inner)
            block.parts.append(inner)
            block = inner
        if name in RAW and not token[3].endswith("/"):
            raw_until = name
    if raw_until is None and place < len(page) and block.unwanted != ALWAYS:
        block.parts.append(page[place:])
    _drop(elements)
    return root


def _pieces(element: _Element) -> list:
    """Texts of an element with white space put right, and its block elements."""
    out, texts = [], []
    for part in [*element.parts, None]:
        if isinstance(part, str):
            texts.append(part)
            continue
        if texts and (text := " ".join(html.unescape("".join(texts)).split())):
            out.append(text)
        texts = []
        if part is not None and not part.dropped:
            out.append(part)
    return out


class Blocks(NamedTuple):
    """Blocks of text in order and the element around each; of elements with a block inside, in an order that puts
    parents first, the place of the parent (-1: none) and a hash of the subtree; a hash of the article."""

    texts: list[str]
    inside: list[int]
    parents: list[int]
    codes: list[int]
    article: int


def blocks(page: str) -> Blocks:
    root = _tree(page)
    order, pieces = [root], {}
    for element in order:  # parents before children, without recursion
        pieces[id(element)] = _pieces(element)
        order += [x for x in pieces[id(element)] if isinstance(x, _Element)]
    for element in reversed(order):
        digest = xxhash.xxh64(element.name)
        for x in pieces[id(element)]:
            digest.update(x.encode() if isinstance(x, str) else x.code.to_bytes(8, "little"))
            digest.update(b"\0")
        element.code = digest.intdigest()
    some_article = any(e.article and pieces[id(e)] for e in order)

    texts, owners, article = [], [], xxhash.xxh64()
    waiting = [(root, iter(pieces[id(root)]))]
    while waiting:
        element, rest = waiting[-1]
        x = next(rest, None)
        if x is None:
            waiting.pop()
        elif isinstance(x, str):
            if element.article or not some_article:
                texts.append(x)
                owners.append(element)
                article.update(x.encode() + b"\0")
        else:
            waiting.append((x, iter(pieces[id(x)])))

    place: dict[int, int] = {}
    parents, codes = [], []
    for owner in owners:
        above = []
        while owner is not root and id(owner) not in place:
            above.append(owner)
            owner = owner.parent
        for element in reversed(above):
            parents.append(place.get(id(element.parent), -1))
            codes.append(_signed(element.code))
            place[id(element)] = len(place)
    return Blocks(texts, [place.get(id(e), -1) for e in owners], parents, codes, _signed(article.intdigest()))


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


_PARSED = (
    "part long, row long, page_id long, url string, host string, article long, texts array<string>, inside array<int>,"
    " parents array<int>, codes array<long>"
)


def parse(pages: DataFrame) -> DataFrame:
    """Per page: part (the task that parsed it), row (its place there), its host, and its ``Blocks``."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [blocks(page or "") for page in part.column("html").to_pylist()]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int64()),
                        pa.array(range(row, row + n), pa.int64()),
                        part.column("page_id"),
                        part.column("url"),
                        part.column("host"),
                        pa.array([x.article for x in found], pa.int64()),
                        pa.array([x.texts for x in found], pa.list_(pa.string())),
                        pa.array([x.inside for x in found], pa.list_(pa.int32())),
                        pa.array([x.parents for x in found], pa.list_(pa.int32())),
                        pa.array([x.codes for x in found], pa.list_(pa.int64())),
                    ],
                    "part row page_id url host article texts inside parents codes".split(),
                )
                row += n

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(parsed, _PARSED)


def by_part(parsed: DataFrame) -> DataFrame:
    """``parsed``, stored in buckets by part, so that it can meet other rows by part without moving.

    A task's rows are of one part and so of one bucket: it writes one file. The catalog's entry
    serves to read the files as buckets and goes at once; the files are in the shared folder.
    """
    spark, name = parsed.sparkSession, f"blocks_{uuid.uuid4().hex}"
    writer = parsed.write.format("parquet").option("compression", "zstd").option("path", fresh_path(spark, "blocks"))
    writer.bucketBy(partitions(spark), "part").saveAsTable(name)
    try:
        stored = spark.table(name)
        stored.schema  # noqa: B018  resolves the table
        return stored
    finally:
        spark.sql(f"DROP TABLE {name}")


def recurring(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The subtrees that recur in enough articles of their host: key and salt, for the salts that occur."""
    salts = F.bit_or(F.expr("shiftleft(1L, salt)"))
    articles = subtrees.groupBy("key", "article").agg(salts.alias("salts"))
    return (
        articles.groupBy("key")
        .agg(F.count("*").alias("n"), F.bit_or("salts").alias("salts"))
        .where(F.col("n") >= min_pages)
        .select("key", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt"))
    )


def _kept_text(texts: list[str], inside: list[int], parents: list[int], gone: set[int]) -> str:
    """The texts of blocks around which no element is ``gone``."""
    if not gone:
        return " ".join(texts)
    dropped = []
    for place, parent in enumerate(parents):
        dropped.append(place in gone or parent >= 0 and dropped[parent])
    return " ".join([text for text, e in zip(texts, inside, strict=True) if e < 0 or not dropped[e]])


def without_templates(stored: DataFrame, hits: DataFrame) -> DataFrame:
    """Per page of ``by_part``: page_id, url, text, n_chars, without what ``hits`` (of_part, of_row, element) names.

    Pages stay where they are stored and hits are dealt to them by part. What a task gathers for one
    part are the pages that one task has parsed, which the size of input splits bounds.
    """

    def cut(pages: pa.Table, found: pa.Table) -> pa.Table:
        gone: dict[int, set[int]] = {}
        for row, element in zip(found.column("of_row").to_pylist(), found.column("element").to_pylist(), strict=True):
            gone.setdefault(row, set()).add(element)
        texts = []
        for chunk in pages.select(["row", "texts", "inside", "parents"]).to_batches(max_chunksize=512):
            columns = [chunk.column(i).to_pylist() for i in range(4)]
            texts += [_kept_text(t, i, p, gone.get(row, set())) for row, t, i, p in zip(*columns, strict=True)]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        return pa.Table.from_arrays(
            [pages.column("page_id"), pages.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"]
        )

    pages = stored.select("part", "row", "page_id", "url", "texts", "inside", "parents")
    schema = "page_id long, url string, text string, n_chars long"
    return pages.groupBy("part").cogroup(hits.groupBy("of_part")).applyInArrow(cut, schema)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    stored = by_part(parse(pages))
    subtrees = (
        stored.withColumn("salt", F.pmod(F.xxhash64("part", "row"), F.lit(SALTS)).cast("int"))
        .select("part", "row", "host", "article", "salt", F.posexplode("codes").alias("element", "subtree"))
        .select("part", "row", "article", "salt", "element", F.xxhash64("host", "subtree").alias("key"))
    )
    found = subtrees.join(recurring(subtrees, min_pages), ["key", "salt"])
    hits = found.select(F.col("part").alias("of_part"), F.col("row").alias("of_row"), "element")
    return without_templates(stored, hits)
