"""HTML extraction (operator 6): site template removal.

Pages are parsed by a tolerant tree builder. Every element has two subtree
hashes: one of its tags and texts, and one of its skeleton: its place (the tag
above it), tags, class names, and children, repeated ones counted once, without
any text. Both are counted per host in Spark.

- Outside the main text (``article`` and ``main`` elements), a subtree that
  ``LEAST_PAGES`` pages of its host have is template, whatever the size of the
  host; so is a skeleton that as many pages have beside a main element, as a
  menu or a footer whose words differ from page to page. A page without a main
  element could hold its text in such a place: there a skeleton counts only
  if most of the subtree's text is in links.
- Inside the main text, a subtree is template if most pages of the host have it.
- Elements that by their tag, role, class or id are no main text (menus,
  headers, footers, side bars, notices, adverts, forms, scripts, styles,
  comments) go as well (``lists``). A form, header or named element that holds a
  main element stays; inside the main text only names that leave no doubt count.

What is left of the outermost main elements is the text; in pages without any,
and in all pages with ``main_only=False``, what is left of the whole body.

Only pages whose text outside the main elements is asked for are joined with
templates one by one: each of their subtrees by (host, hash), common ones by
broadcast, so a host with a third of all pages is no single key. What recurs
inside the main text is a list per host, bounded by its share.

Character references are decoded, block elements and breaks separate, and
white space runs become one space. Parsing is linear in the page.

Defined cases: null and empty html give an empty text; a page without a host
has no template and is only cleaned; equal pages of a host count one by one;
unclosed and stray tags, comments and raw elements end where browsers end them
or with the page. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches
from glmframe.session import scratch_path

#: A subtree outside the main text is template on a host if so many of its pages have it.
LEAST_PAGES = 5
#: The share of pages needed besides inside the main text.
ARTICLE_SHARE = 0.6
#: The share of its text that a menu has in links.
LINK_SHARE = 0.5
#: Keys with more than this share's inverse of all rows are joined by broadcast; there are fewer than so many.
HOT_KEYS = 1000

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Never text.
_DROPPED = frozenset(
    "button canvas datalist embed head iframe map noscript object script select style svg template textarea title".split()
)
#: Text about other things than the page's.
_BESIDE = frozenset("aside dialog footer menu nav".split())
_MAIN = frozenset(("article", "main"))
#: Which open elements a start tag ends.
_ENDS = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
#: Elements that such an end never crosses.
_FENCES = frozenset("article aside blockquote body button div dl footer form header html li main nav ol section table td th ul".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id that mark an element as no main text.
_MARKS = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination popup promo promotion recommended related reply replies respond search share sharebar "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]++|<""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"']+)""")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: First words of class names that say something about a part of the element, not what it is.
_ABOUT = frozenset("has no with without is not hide show include".split())
#: Names of lists of other texts, which are no main text even if they are made of articles.
_OTHERS = frozenset("comment comments reply replies disqus respond related recommended".split())
#: Names that say enough as a part of a longer one inside the main text, too.
_SURE = frozenset(
    "ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments cookie cookies newsletter promo related "
    "replies reply share sharing sidebar sponsored subscribe".split()
)
#: What a start tag can end: kept per element, with the depth of the nearest one.
_ENDED = frozenset("p li dt dd tr td th option".split())


class Element:
    """A node of the tree; ``parts`` are texts and elements in order."""

    __slots__ = ("tag", "names", "marked", "beside", "dropped", "main", "inside", "holds_main", "parts", "digest", "skeleton", "reach")

    def __init__(self, tag: str, inside: bool = False, reach: dict | None = None):
        self.tag, self.inside, self.reach = tag, inside, reach or {}
        self.names: tuple[str, ...] = ()
        self.marked = self.beside = self.dropped = self.main = self.holds_main = False
        self.parts: list = []
        self.digest = self.skeleton = ""  # 64-bit hashes in hexadecimal


def _named(value: str, inside: bool) -> bool:
    """Whether class or id names mark an element; inside the main text only sure ones do as a part of a name."""
    for name in value.split():
        if name in _MARKS:
            return True
        words = _SPLIT.split(name)
        if words[0] not in _ABOUT and (_SURE if inside else _MARKS).intersection((words[0], words[-1])):
            return True
    return False


def _read_attributes(element: Element, attributes: str) -> None:
    """What tag, role and names say: ``dropped`` never text, ``beside`` other texts, ``marked`` no main text of its own."""
    tag = element.tag
    element.dropped, element.beside = tag in _DROPPED, tag in _BESIDE
    element.marked = tag == "form" or (tag == "header" and not element.inside)
    if not attributes.strip("/ \t\n\r\f") or tag in ("html", "body"):
        return
    for name, a, b, c, alone in _ATTRIBUTE.findall(attributes):
        name, value = (name or alone).lower(), (a or b or c).lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
            element.dropped = True
        elif name == "role" and value.strip() in _ROLES:
            element.beside = True
        elif name in ("class", "id"):
            names = value.split()
            if name == "class":
                element.names = tuple(sorted(names))
            if tag == "article":
                names = [w for n in names for w in _SPLIT.split(n)]
            if _OTHERS.intersection(names):
                element.beside = element.beside or tag != "main"
            elif tag not in _MAIN and _named(value, element.inside):
                element.marked = True


def parse(page: str, hashes: bool = True, lists: bool = True, beside: bool = True) -> Element:
    """The tree of a page; every element knows its hashes, and whether it is dropped (never text only, without ``lists``).

    Where all main elements lie in parts ``beside`` the page's own text, those that hold one stay.
    """
    root = Element("")
    stack = [root]
    open_tags: Counter = Counter()
    lost = []  # parts beside that hold a main element

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            tag, above = element.tag, stack[-1]
            open_tags[tag] -= 1
            holds_main = element.holds_main or element.main
            if lists and not element.dropped:
                if element.beside and holds_main:
                    lost.append(element)
                element.dropped = (element.beside and (beside or not holds_main)) or (element.marked and not holds_main)
            element.holds_main = holds_main and not element.dropped
            if element.holds_main:
                above.holds_main = True
            if hashes:
                words, shapes = [tag], {}
                for part in element.parts:
                    if isinstance(part, str):
                        words.append(part)
                    else:
                        words.append(part.digest)
                        shapes[part.skeleton] = None
                element.digest = xxhash.xxh3_64_hexdigest("\x00".join(words))
                element.skeleton = xxhash.xxh3_64_hexdigest("\x00".join([above.tag, tag, *element.names, "", *shapes]))

    def open_tag(name: str, attributes: str) -> None:
        ends = _ENDS.get(name) or (frozenset(("p",)) if name in _BLOCKS and name != "br" else None)
        while ends:
            reach = stack[-1].reach
            depth = max([reach.get(t, 0) for t in ends]) if reach else 0
            if not depth:
                break
            close(depth)
            if name != "tr":
                break
        above = stack[-1]
        reach = {} if name in _FENCES else above.reach
        if name in _ENDED:
            reach = {**reach, name: len(stack)}
        element = Element(name, above.inside or above.main, reach)
        _read_attributes(element, attributes)
        element.main = name in _MAIN and not element.inside and not (lists and (element.dropped or (element.beside and beside)))
        above.parts.append(element)
        stack.append(element)
        open_tags[name] += 1
        if name in _VOID:
            close(len(stack) - 1)

    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.match(page, at)
        at = token.end()
        slash, name, attributes = token.groups()
        if name is None:
            text = token.group()
            if not text.startswith(("<!", "<?")):
                stack[-1].parts.append(_spaced(html.unescape(text)))
            continue
        name = name.lower()
        if slash:
            if open_tags[name]:
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                close(depth)
            continue
        open_tag(name, attributes)
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            stop = end.start() if end else n
            if name == "title" or name == "textarea":
                stack[-1].parts.append(" ".join(html.unescape(page[at:stop]).split()))
            at = end.end() if end else n
            close(len(stack) - 1)
    close(1)
    if lost and beside and not root.holds_main:
        return parse(page, hashes, lists, beside=False)
    return root


def _spaced(text: str) -> str:
    """White space runs as one space, kept at the ends."""
    inner = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + inner + (" " if inner and text[-1:].isspace() else "")


def _linked(element: Element) -> bool:
    """Whether most of an element's text is in links."""
    total = linked = 0
    stack = [(element, element.tag == "a")]
    while stack:
        now, link = stack.pop()
        for part in now.parts:
            if isinstance(part, str):
                total += len(part)
                linked += len(part) if link else 0
            else:
                stack.append((part, link or part.tag == "a"))
    return linked > LINK_SHARE * total


def _elements(root: Element) -> Iterator[Element]:
    """Elements that could be template: not the main elements, nor what holds one."""
    stack = [root]
    while stack:
        for part in stack.pop().parts:
            if not isinstance(part, str) and not part.dropped:
                if not part.holds_main and part.parts and part.tag not in ("html", "body"):
                    yield part
                stack.append(part)


#: What a hash stands for.
INSIDE, OUTSIDE, SHAPE = 0, 1, 2


def _keys(root: Element, counted: bool) -> set[tuple[int, str]]:
    """(kind, hash) of a page's subtrees; as ``counted``, skeletons count beside a main element only."""
    found = set()
    for e in _elements(root):
        found.add((INSIDE if e.inside else OUTSIDE, e.digest))
        if not e.inside and (root.holds_main or (not counted and _linked(e))):
            found.add((SHAPE, e.skeleton))
    return found


def main_text(root: Element, template: frozenset = frozenset(), main_only: bool = True) -> str:
    """Text of the main elements, or of the page, without the ``template`` subtrees, (kind, hash) pairs."""
    only_main, out = main_only and root.holds_main, []
    # a string on the stack is text that is due, as are block ends
    stack: list[tuple] = [(root, False)]
    while stack:
        part, inside = stack.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        gone = part.dropped
        if template and not gone and not part.holds_main and part.parts:
            if inside:
                gone = (INSIDE, part.digest) in template
            else:
                gone = (OUTSIDE, part.digest) in template
                gone = gone or ((SHAPE, part.skeleton) in template and (root.holds_main or _linked(part)))
        if gone:
            if part.tag in _BLOCKS:
                out.append(" ")
            continue
        inside = inside or part.main
        edge = [(" ", inside)] if part.tag in _BLOCKS else []
        inner = [(p, inside) for p in part.parts if not isinstance(p, str) or inside or not only_main]
        stack += reversed([*edge, *inner, *edge])
    return " ".join("".join(out).split())


SUBTREES = "page long, host string, kind int, hash string, pages long"


def _subtrees(lists: bool, main_only: bool):
    """How many pages of a host have a subtree, within each batch; and one by one (``page`` set) the subtrees of
    pages whose text outside the main elements is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            own = []
            for page, host, text in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html")), strict=True):
                root = parse(text or "", lists=lists)
                counts.update([(host, *key) for key in _keys(root, True)])
                if not (main_only and root.holds_main):
                    own += [(page, host, *key, 1) for key in _keys(root, False) if key[0] != INSIDE]
            own += [(None, *key, n) for key, n in counts.items()]
            columns = list(zip(*own, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SUBTREES.split(", ")]
            )

    return run


def site_templates(subtrees: DataFrame, pages: DataFrame) -> DataFrame:
    """host, kind, hash, pages: the subtrees that recur on a host.

    ``kind``: 0 in the main text, on most of the host's pages; 1 outside of it,
    and 2 by skeleton, on ``LEAST_PAGES``.
    """
    counts = subtrees.where("page is null").groupBy("host", "kind", "hash").agg(F.sum("pages").alias("pages"))
    total = pages.groupBy("host").agg(F.count("*").alias("all_pages"))
    often = counts.where(F.col("pages") >= LEAST_PAGES).join(total, "host")
    often = often.where((F.col("kind") != INSIDE) | (F.col("pages") >= ARTICLE_SHARE * F.col("all_pages")))
    return often.select("host", "kind", "hash", "pages")


def _extract(lists: bool, main_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, strict, own in zip(*(batch.column(c).to_pylist() for c in ("html", "strict", "own")), strict=True):
                template = {(INSIDE, x) for x in strict or ()} | {(t["kind"], t["hash"]) for t in own or ()}
                texts.append(main_text(parse(page or "", bool(template), lists), frozenset(template), main_only))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return run


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    lists: bool = True,
    main_only: bool = True,
) -> DataFrame:
    """page_id, url and main text of every page.

    Without ``lists`` no element goes by its tag, role or names, but for raw
    ones; without ``main_only`` text outside the main elements is kept too,
    unless it is template or listed.
    """
    spark = bound_batches(pages).sparkSession
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
        host.alias("host"),
    )
    page = F.xxhash64("host", "html").alias("page")
    known = rows.where("host <> ''")

    def written(df: DataFrame, name: str) -> DataFrame:
        """A written table: Spark knows its size when it plans the joins."""
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    subtrees = written(known.select(page, "host", "html").mapInArrow(_subtrees(lists, main_only), SUBTREES), "subtrees")
    found = written(site_templates(subtrees, known), "site-templates")
    strict = found.where(F.col("kind") == INSIDE).groupBy("host").agg(F.collect_list("hash").alias("strict"))

    # the templates among the own subtrees of pages; equal pages have equal ones
    keys, own = ["host", "kind", "hash"], subtrees.where("page is not null").select("page", "host", "kind", "hash").distinct()
    outside = found.where(F.col("kind") != INSIDE)
    hot = F.broadcast(outside.where(F.col("pages") > F.lit(max(1, known.count() // HOT_KEYS))).select(*keys))
    matched = own.join(hot, keys, "left_semi").union(own.join(hot, keys, "left_anti").join(outside, keys, "left_semi"))
    listed = written(matched.groupBy("page").agg(F.collect_list(F.struct("kind", "hash")).alias("own")), "page-templates")

    kind = rows.schema["url"].dataType.simpleString()
    joined = rows.withColumn("page", page).join(strict, "host", "left").join(listed, "page", "left")
    return joined.mapInArrow(_extract(lists, main_only), f"page_id long, url {kind}, text string")


def op6_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every page."""
    found = extract_main_text(pages.select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
