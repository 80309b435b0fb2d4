"""Main text of web pages by consensus host paths.

Each page's containers are scored by their text, and the winner is raised to the whole article around it. It votes for
its generalised path: the tags and classes above it with numbers taken out, as a hash. Spark sums the votes by host and
path, and the page is extracted again below the path that won its host. Where a page lacks the winning path, has its
own container around it, or nearly all its text elsewhere, its own container stands in.

Score of a container: characters of running text in its own paragraphs, those inside links not counted and furniture
(navigation, forms, comments, adverts) left out; a paragraph counts for its parent in full and for the one above by
half. The winner is raised to the outermost ``article``, else ``main``, around it, else for as long as what is around
it adds running text, or a heading, more than links.

Furniture is known by its tag or by a class, id or role of its own, read as a whole: ``comments``, ``share-buttons`` or
``site-footer`` is furniture, ``share-price`` is not. Outside the chosen container a telling part is enough.

Every character is read once, whatever is left unclosed. Nulls: a null html is an empty page and gives an empty text; a
null url is a host of its own, "". Pages without any text give "". Ties go to the container that comes first, and to
the smaller path. Repeated rows are extracted each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are one piece of text of the container above them.
PIECES = frozenset("p li blockquote pre dd dt td th figcaption caption".split())
#: An opening tag of the key closes an open element of the values, up to a container that holds such lists.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select menu tr".split())
BOILER_TAGS = frozenset("nav header footer aside form button select label script style noscript template iframe textarea title head menu svg dialog".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disclaimer disqus footer form header legal login masthead menu modal nav navbar navigation navigational newsletter notice notices pager pagination popup promo promoted promotion related remark remarks replies reply respond response responses search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Words that say where or in what form a thing stands: beside one of the above they leave a name what it is.
PLAIN_WORDS = frozenset(
    "area area bar block bottom box button buttons card col column container content desktop element global group head holder icon icons inner inline item items layout left link links list main mobile module outer page panel placeholder policy post posts primary region right row secondary section site slot sticky text thread title top unit wrap wrapper wrapping".split()
)
#: Words that tell furniture by themselves in a longer name, outside the chosen container.
TELLING = frozenset("advert advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter pagination popup promo sidebar sponsored topbar".split())
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"[\d_-]+")
#: Classes that say what stands beside an element, not what it is.
_ABOUT = re.compile(r"(?:has|with|no|without|hide|show)[-_]")
VOTE = "host string, path long, score double"
TEXT = "page_id long, url string, text string, n_chars long"


def label_path(above: int, label: str) -> int:
    """The path one element further down, as a signed 64-bit hash."""
    found = xxhash.xxh64_intdigest(label, seed=above & (1 << 64) - 1)
    return found - (1 << 64) if found >> 63 else found


def path_of(*labels: str) -> int:
    """The hash of a path given by its labels, such as "html", "body", "div.story"."""
    path = 0
    for label in labels:
        path = label_path(path, label)
    return path


class Element:
    __slots__ = ("tag", "path", "boiler", "doubt", "link", "parent", "children", "around", "plain", "linked", "heads", "main")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.plain = self.linked = self.heads = 0
        names, whole, part, self.main = [], False, False, tag == "main"
        for kind, a, b, c in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
            kind, value = kind.lower(), (a or b or c).lower()
            if kind == "class":
                names = sorted({_DIGITS.sub("", x) for x in value.split()} - {""})
            elif kind == "role" and value == "main":
                self.main = True
            for word in value.split():
                if not _ABOUT.match(word):
                    parts = _PART.findall(word)
                    known = [x for x in parts if x in BOILER_WORDS]
                    whole = whole or bool(known) and all(x in BOILER_WORDS or x in PLAIN_WORDS for x in parts)
                    part = part or any(x in TELLING for x in known)
        above = parent.path if parent else 0
        # inline markup has no place in a path
        self.path = label_path(above, tag + "".join("." + x for x in names)) if tag in BLOCK else above
        #: The nearest block around, this one for a block.
        self.around = self if tag in BLOCK or parent is None else parent.around
        body = tag in ("html", "body", "article") or self.main
        in_article = parent is not None and any_article(parent)
        # a header is that of the page, unless it stands in the article, or turns out to stand in the chosen container
        heading = tag == "header" and (in_article or parent.around.tag not in ("", "html", "body"))
        self.boiler = bool(parent and parent.boiler) or (tag in BOILER_TAGS and not heading) or (whole and not body)
        self.doubt = self.boiler or bool(parent and parent.doubt) or ((part or tag == "header") and not body and not in_article)
        self.link = tag == "a" or bool(parent and parent.link)


def any_article(element: Element) -> bool:
    """Whether the element is, or stands in, an article or main part; kept in ``heads`` while the tree is made."""
    return element.heads == 1


def parse(page: str) -> Element:
    """A tolerant tree: unclosed elements end with their block, stray end tags are passed over, void tags stay empty.
    Children are elements and strings (character references decoded). Where a quote in a tag is never closed, quotes
    mean nothing from there on; a tag that never ends is text."""
    root = Element("", "", None)
    stack, where, blocks = [root], {}, [0]
    low, end, quotes = 0, len(page), True

    def pop_to(size: int) -> None:
        while len(stack) > size:
            gone = stack.pop()
            where[gone.tag].pop()
            if gone.tag in BLOCK:
                blocks.pop()

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    while low < end:
        at = page.find("<", low)
        if at < 0:
            at = end
        if at > low:
            stack[-1].children.append(html.unescape(page[low:at]))
        if at == end:
            break
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 2)
            low = end if stop < 0 else stop + 3
            continue
        found = _TAG.match(page, at + 1)
        if not found:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                stop = page.find(">", at)
                low = end if stop < 0 else stop + 1
            else:
                stack[-1].children.append("<")
                low = at + 1
            continue
        closing, tag = found.group(1), found.group(2).lower()
        stop = _INSIDE.match(page, found.end()).end() if quotes else page.find(">", found.end())
        if stop < 0 or stop >= end or page[stop] != ">":
            quotes = False
            stop = page.find(">", found.end())
            if stop < 0:
                stack[-1].children.append(html.unescape(page[at:]))
                break
        attributes, low = page[found.end() : stop], stop + 1
        if tag == "br":
            stack[-1].children.append("\n")
        elif closing:
            # an inline end tag does not close the block it stands in
            place = where[tag][-1] if where.get(tag) else 0
            if place and (tag in BLOCK or place > blocks[-1]):
                pop_to(place)
        else:
            if tag in BLOCK:
                # a paragraph ends where a block begins
                block = stack[blocks[-1]]
                if block.tag == "p" or block.tag in HEADINGS:
                    pop_to(blocks[-1])
            if tag in CLOSES:
                place = last(CLOSES[tag])
                if place > last(HOLDERS - CLOSES[tag]):
                    pop_to(place)
            above = stack[-1]
            node = Element(tag, attributes, above)
            node.heads = 1 if above.heads == 1 or tag == "article" or node.main else 0
            above.children.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(page, low)
                low = stop.end() if stop else end
            elif tag not in VOID and not attributes.rstrip().endswith("/"):
                where.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    blocks.append(len(stack))
                stack.append(node)
    return root


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def container(root: Element) -> Element | None:
    """The page's own container: the best scored one, raised to the whole article. Fills in what each element holds."""
    order, todo, scores, own = [], [root], {}, {}
    while todo:
        node = todo.pop()
        node.plain = node.linked = node.heads = 0
        order.append(node)
        if node.doubt:
            continue
        for x in node.children:
            if isinstance(x, str):
                n = _length(x)
                if node.link:
                    node.linked += n
                else:
                    node.plain += n
                    own[node.around] = own.get(node.around, 0) + n
        todo += [x for x in reversed(node.children) if not isinstance(x, str)]
    for node in reversed(order):
        if node.tag in ("h1", "h2", "h3"):
            node.heads = node.plain
        if node.parent is not None and not node.doubt:
            up = node.parent
            up.plain, up.linked, up.heads = up.plain + node.plain, up.linked + node.linked, up.heads + node.heads
    for block, n in own.items():
        if n and block.tag not in HEADINGS:
            holder = block.parent.around if block.tag in PIECES and block.parent is not None else block
            for weight in (1.0, 0.5):
                if holder is None or not holder.tag:
                    break
                scores[holder] = scores.get(holder, 0.0) + weight * n
                holder = holder.parent.around if holder.parent is not None else None
    if not scores:
        return None
    best = max(scores, key=scores.__getitem__)
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for kind in (lambda x: x.tag == "article", lambda x: x.main):
        whole = [x for x in above if kind(x)]
        if whole:
            return whole[-1]
    for x in above[1:]:
        if x.tag in ("", "html", "body"):
            break
        if x.tag in BLOCK:
            more, links = x.plain - best.plain, x.linked - best.linked
            if links > max(more, 0.1 * best.plain):
                break
            if more >= 0.1 * best.plain or x.heads > best.heads:
                best = x
    return best


def blocks_below(nodes: list[Element]) -> list[str]:
    """Blocks of text, in page order, of these elements."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(text)
            held.clear()

    for top in nodes:
        stack, blocks = [iter(top.children)], [True]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                if blocks.pop():
                    flush()
            elif isinstance(child, str):
                held.append(child)
            elif not child.boiler:
                block = child.tag in BLOCK
                if block:
                    flush()
                stack.append(iter(child.children))
                blocks.append(block)
            elif child.tag in BLOCK:
                flush()
        flush()
    return out


def at_path(root: Element, path: int) -> list[Element]:
    """The outermost elements with this path that are no furniture, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.boiler:
            continue
        if node.path == path and node.tag in BLOCK:
            out.append(node)
        else:
            todo += [x for x in reversed(node.children) if not isinstance(x, str)]
    return out


def extract(page: str, host_path: int | None = None) -> str:
    """The main text, from the host's path or the page's own container."""
    root = parse(page)
    own = container(root)
    chosen = at_path(root, host_path) if host_path is not None else []
    if chosen and own is not None:
        held = sum(x.plain for x in chosen)
        up, around = chosen[0], False
        while up is not None and not around:
            around, up = up is own, up.parent
        if around or 20 * held < own.plain:
            chosen = []
    if not chosen:
        chosen = [own] if own is not None else [root]
    return "\n\n".join(blocks_below(chosen))


def host_of(column):
    """The host of a URL, lower case and without its port; "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path): the path that won the host's vote. A page votes for its container with the share of its text that
    the container holds; votes are summed before the exchange, by host and path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(page.as_py() or "")
                own = container(root)
                if own is not None:
                    total[host, own.path] = total.get((host, own.path), 0.0) + own.plain / max(1, root.plain)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.int64()), pa.array(list(total.values()), pa.float64())], names=["host", "path", "score"])

    rows = pages.select(host_of(F.col(quoted(url)).cast("string")).alias("host"), F.col(quoted(html_column)).cast("string").alias("html"))
    summed = rows.mapInArrow(vote, VOTE).groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("score"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html", broadcast_hosts: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars), a row per page. The winning paths are counted first: up to ``broadcast_hosts`` are
    broadcast; more are joined by host to the pages' keys and then by key to the pages, so no page meets its host."""
    chosen = written(host_paths(pages, url, html_column), "host-paths")
    rows = pages.select(F.col(quoted(key)).cast("long").alias("page_id"), F.col(quoted(url)).cast("string").alias("url"), host_of(F.col(quoted(url)).cast("string")).alias("host"), F.col(quoted(html_column)).cast("string").alias("html"))
    if chosen.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(chosen), "host", "left")
    else:
        # rows with a null or repeated key share a url only by chance, so the url is part of the key
        paths = rows.select("page_id", "url", "host").distinct().join(chosen, "host").select(F.col("page_id").alias("k"), F.col("url").alias("u"), "path")
        joined = rows.join(paths, F.col("page_id").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")), "left")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", path) for page, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(again, TEXT)
