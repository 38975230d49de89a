"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of its block elements with text between. A wrapper is an expression over such
trees: a sequence of items, each an element (with a wrapper of its content), a repeated group or a text
slot, and each possibly optional. Pages of one host are aligned with the host's wrapper one after the
other: equal elements are aligned and their contents in turn; an element on one side only becomes
optional; neighbours that repeat become a repeated group; texts that differ become a slot. Wrappers
align with wrappers in the same way, so each partition makes partial wrappers of its hosts, and these
are combined in two steps (by host and salt, then by host); no group of pages ever meets in one task.

Wrappers hold no texts. Once a host's wrapper is known, every page is matched with it, and each text with its
slot is counted over all pages of the host, by a shuffle; so texts that are the same on every page are told
even among neighbours that vary. Pages of the same main text are one page, whatever their menus. A text that
stands in one slot in more than half of the host's different pages, and at least LEAST of them, is part of the
template; the share is exact for any number of pages, and at most two such texts a text of the average page are kept.

A page is then matched with its host's wrapper again. The texts within its article, except those in menus,
headers, footers, sidebars, notices, adverts, forms and comments, are its main text; where it has no
article, all texts outside such elements are. Texts of the template go, but an article keeps its prose (PROSE),
and keeps all where more than half of it is also that of other pages: then these are copies of
it, not a template. No page loses all its text to the template. A notice that varies by page is told by its
element's words alone.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import Written, table, tidy
from marlstone.llm.url_filter import url_host

# Element names and words of class, id and role, as fixed values. A name of several parts counts by the last one that isn't a word of LAYOUT, so "site-header" and "ad-slot" do and "ad-hoc" doesn't.
BLOCKS = frozenset("html head body title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary fieldset nav header footer aside form menu dialog noscript template iframe svg button select option textarea script style center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
NEVER_TEXT = frozenset("head title script style noscript template iframe svg button select option textarea form fieldset dialog menu nav header footer aside".split())
NO_MAIN_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices gdpr newsletter subscribe popup modal overlay share sharing social related recommended comment comments disqus respond reply replies login signup search form widget skip".split())
LAYOUT = frozenset("area bar block box button buttons container content group icons inner item items left link links list panel right row section slot top bottom unit wrapper wrap".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold prose: in an article their text is the article's own, be it on many pages.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption blockquote pre summary".split())
#: An open element of the key closes when one of these starts directly in it.
CLOSED_BY = {"p": BLOCKS - {"script", "style", "template", "noscript", "iframe", "svg", "button", "select", "option", "textarea"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: Elements that a start or end tag of an inner element never closes.
SCOPES = frozenset("html body article main section div nav header footer aside form table ul ol dl blockquote details figure fieldset".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|=)*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
#: A text seen unchanged in more than this share of a host's different pages belongs to the template.
TEMPLATE_SHARE = 0.5
#: Different pages that show a template, outside of articles and inside, where two or three may well say the same.
LEAST, LEAST_IN_ARTICLE = 2, 4
#: Shapes of a host's pages that a task remembers, to align equal ones once.
SHAPES = 200
#: Depth to which wrappers describe pages; no text nested deeper is told to be of the template. Menus, forms and articles are told at any depth.
WRAPPER_DEPTH = 150
#: Elements of a repeated group, at most.
GROUP = 8
#: Pairs of equal labels up to which sequences are aligned by a longest common subsequence; beyond it, by a common one found in one pass.
PAIRS = 1 << 18
#: Characters of all wrappers up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
SALTS = 64


class Element:
    """An element of a page; `label` is its name and the words of its class, id and role."""

    __slots__ = ("children", "label", "name", "never")

    def __init__(self, name: str, label: str, never: bool):
        self.name, self.label, self.never, self.children = name, label, never, []


def _word(name: str) -> str:
    """The word that a class, an id or a role counts by."""
    parts = [x for x in _PARTS.split(name) if x]
    while len(parts) > 1 and parts[-1].lower() in LAYOUT:
        parts.pop()
    return parts[-1].lower() if parts else ""


def _element(name: str, attributes: str) -> Element:
    words = sorted({_word(w) for m in _ATTRIBUTE.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()} & NO_MAIN_WORDS) if "=" in attributes else []
    never = name in NEVER_TEXT or name not in ("html", "body") and bool(words)
    return Element(name, ".".join([name, *words]), never)


def parse(html: str | None) -> Element:
    """The tree of a page's block elements; other tags go, a line break counts as a space. Any text parses."""
    root = Element("", "", False)
    stack, at, text = [root], 0, html or ""
    while True:
        tag = _TAG.search(text, at)
        piece = text[at:tag.start() if tag else len(text)]
        if piece:
            _add_text(stack[-1], piece)
        if not tag:
            return root
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name in BLOCKS:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name or stack[k].name in SCOPES and name not in SCOPES), 0)
                if k and stack[k].name == name:
                    del stack[k:]
        elif name == "br":
            _add_text(stack[-1], " ")
        elif name in BLOCKS:
            while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
                stack.pop()
            if stack[-1].name in ("dt", "dd", "li") or name in ("li", "dt", "dd", "td", "th", "tr"):
                # an unclosed paragraph or item inside the list closes with the next item
                for k in range(len(stack) - 1, 0, -1):
                    if name in CLOSED_BY.get(stack[k].name, ()) and stack[k].name != "p":
                        del stack[k:]
                        break
                    if stack[k].name in SCOPES:
                        break
            element = _element(name, tag[3])
            stack[-1].children.append(element)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
                if name == "title":
                    _add_text(element, text[at:end.start() if end else len(text)])
                at = end.end() if end else len(text)
            elif name not in VOID and not tag[3].endswith("/"):
                stack.append(element)


def _add_text(element: Element, text: str) -> None:
    if element.children and isinstance(element.children[-1], str):
        element.children[-1] += text
    else:
        element.children.append(text)


def _clean(text: str) -> str:
    return " ".join(html_module.unescape(text).split())


# A wrapper item is a list: ["t", optional] or ["e", optional, repeated, label, never, items]; a repeated group of several
# elements is ["g", optional, items]. A settled slot is ["t", optional, number, texts of the template].


def digest(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _form(text: str) -> str:
    """A text as wrappers hold it."""
    return text if len(text) <= 60 else f"\0{digest(text):x}"


def _says(text: str) -> bool:
    """Whether a text isn't white space alone."""
    return bool(text.strip()) and ("&" not in text or bool(_clean(text)))


def infer(element: Element, depth: int = WRAPPER_DEPTH) -> list:
    """The wrapper items of one page's element."""
    items: list = []
    for child in element.children if depth else ():
        if isinstance(child, str):
            if _says(child):
                items.append(["t", 0])
        else:
            items.append(["e", 0, 0, child.label, int(child.never), [] if child.never else infer(child, depth - 1)])
    return fold(items)


def _key(item: list) -> str:
    return "#" if item[0] == "t" else item[3] if item[0] == "e" else "(" + " ".join(map(_key, item[2])) + ")"


def fold(items: list) -> list:
    """Neighbours of equal labels become one repeated item, then neighbouring equal sequences a repeated group."""
    out: list = []
    for item in items:
        if out and _key(out[-1]) == _key(item):
            out[-1] = _merge(out[-1], item)
            if item[0] == "e":
                out[-1][2] = 1
        else:
            out.append(item)
    keys, size = [_key(i) for i in out], 2
    while size <= GROUP and 2 * size <= len(out):
        k = 0
        while k + 2 * size <= len(out):
            if keys[k] == keys[k + size] and keys[k:k + size] == keys[k + size:k + 2 * size]:
                one, group = keys[k:k + size], out[k:k + size]
                while keys[k + size:k + 2 * size] == one:
                    group = [_merge(x, y) for x, y in zip(group, out[k + size:k + 2 * size])]
                    del out[k + size:k + 2 * size], keys[k + size:k + 2 * size]
                out[k:k + size] = [["g", 0, group]]
                keys[k:k + size] = [_key(out[k])]
            k += 1
        size += 1
    return out


def _merge(a: list, b: list) -> list:
    """Of two items with the same key."""
    optional = a[1] | b[1]
    if a[0] == "t":
        return ["t", optional]
    if a[0] == "g":
        return ["g", optional, align(a[2], b[2])]
    return ["e", optional, a[2] | b[2], a[3], a[4], align(a[5], b[5])]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, rising; where there are more than PAIRS pairs of equal elements, of one that takes the next equal element each time."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(k, k) for k in range(head)], [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    inner = _middle(a[head:len(a) - tail], b[head:len(b) - tail])
    return [*ends[0], *((i + head, j + head) for i, j in inner), *ends[1]]


def _middle(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    places: dict[str, list[int]] = {}
    for j, key in enumerate(b):
        places.setdefault(key, []).append(j)
    if sum(len(places.get(key, ())) for key in a) > PAIRS:
        out, j = [], 0
        for i, key in enumerate(a):
            of = places.get(key, ())
            k = bisect_left(of, j)
            # an element far ahead would leave out what stands between
            if k < len(of) and of[k] - j <= GROUP:
                out.append((i, of[k]))
                j = of[k] + 1
        return out
    ends: list[int] = []  # the least end in b of a common subsequence by its length
    links: list[tuple] = []
    for i, key in enumerate(a):
        for j in reversed(places.get(key, ())):
            k = bisect_left(ends, j)
            if k == len(ends):
                ends.append(j)
                links.append((i, j, links[k - 1] if k else None))
            elif j < ends[k]:
                ends[k] = j
                links[k] = (i, j, links[k - 1] if k else None)
    out, at = [], links[-1] if links else None
    while at:
        out.append(at[:2])
        at = at[2]
    return out[::-1]


def align(a: list, b: list) -> list:
    """The least wrapper of this kind for what either matches: a longest common subsequence is merged, the rest becomes optional."""
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [_merge(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in (*common(ka, kb), (len(a), len(b))):
        out += [[x[0], 1, *x[2:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_merge(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def has_article(page: Element) -> bool:
    """Whether an article stands outside the elements that hold no main text."""
    left = [page]
    while left:
        for child in left.pop().children:
            if not isinstance(child, str) and not child.never:
                if child.name in ARTICLE:
                    return True
                left.append(child)
    return False


def settle(items: list, texts: list[tuple[int, str, int]]) -> list:
    """The items with numbered slots, each with those of `texts` (slot, text, pages that have it there) that belong to the template."""
    by_slot: dict[int, list] = {}
    for slot, text, n in texts:
        by_slot.setdefault(slot, []).append((text, n))
    numbers = count()

    def settled(items: list, article: bool) -> list:
        out, few = [], LEAST_IN_ARTICLE if article else LEAST
        for item in items:
            if item[0] == "t":
                slot = next(numbers)
                out.append(["t", item[1], slot, sorted(text for text, n in by_slot.get(slot, ()) if n >= few)])
            else:
                out.append([*item[:-1], settled(item[-1], article or item[0] == "e" and item[3].split(".")[0] in ARTICLE)])
        return out

    return settled(items, False)


class Level:
    """The items of a settled wrapper's element by their keys, so that a child's item is found at once."""

    def __init__(self, items: list):
        self.by: dict[str, list[tuple[int, tuple[int, frozenset] | Level]]] = {}
        self._add(items, None)

    def _add(self, items: list, place: int | None) -> None:
        for k, item in enumerate(items):
            at = k if place is None else place
            if item[0] == "g":
                self._add(item[2], at)
            else:
                self.by.setdefault(_key(item), []).append((at, (item[2], frozenset(item[3])) if item[0] == "t" else Level(item[5])))

    def find(self, key: str, begin: int) -> tuple[tuple[int, frozenset] | Level | None, int]:
        """The first item of the key from `begin` on, else from the start, and where it is."""
        found = self.by.get(key)
        if not found:
            return None, begin
        k = bisect_left(found, begin, key=lambda x: x[0])
        at, item = found[k if k < len(found) else 0]
        return item, at


_NOTHING = Level([])


def _texts(page: Element, wrapper: Level, article: bool, seen: set[tuple[int, str]] | None = None) -> tuple[str, int, int]:
    """The main text without texts of the template, and the characters kept and dropped; `seen` gets (slot, text) of each text that a template could have."""
    blocks: list[str] = []
    held: list[str] = []
    kept = dropped = 0

    def flush() -> None:
        if text := _clean("".join(held)):
            blocks.append(text)
        held.clear()

    # elements that are open: their children, the wrapper's items for them, where the last child matched, whether in the article, whether in prose of it
    open_ = [[iter(page.children), wrapper, 0, not article, False]]
    while open_:
        children, items, at, inside, prose = open_[-1]
        child = next(children, None)
        if child is None:
            open_.pop()
            flush()
            continue
        if isinstance(child, str) and not (text := _clean(child)):  # has no item
            held.append(child)
            continue
        item, open_[-1][2] = items.find("#" if isinstance(child, str) else child.label, at)
        if isinstance(child, str):
            if seen is not None and item is not None and not prose:
                seen.add((item[0], _form(text)))
            if inside:
                if item is not None and not prose and item[1] and _form(text) in item[1]:
                    dropped += len(text)
                else:
                    kept += len(text)
                    held.append(child)
        else:
            flush()
            if not child.never:
                within = inside or child.name in ARTICLE
                open_.append([iter(child.children), item or _NOTHING, 0, within, article and within and (prose or child.name in PROSE)])
    return "\n".join(blocks), kept, dropped


def extract(page: Element, wrapper: Level = _NOTHING) -> str:
    """The page's main text, one line for each block, without what the wrapper has as its host's template."""
    article = has_article(page)
    text, kept, dropped = _texts(page, wrapper, article)
    if dropped and (dropped > kept if article else not kept):
        return _texts(page, _NOTHING, article)[0]
    return text


def add_page(found: list, html: str | None, shapes: set[str] | None = None) -> list:
    """A host's [texts of the template, items] with the items of one more page; texts are counted once all pages are in. `shapes` has the pages that need no aligning."""
    items = infer(parse(html))
    if shapes is not None:
        if (shape := repr(items)) in shapes:
            return found
        shapes.add(shape)
    return [found[0], align(found[1], items) if found[1] else items]


def _hosts(url_col: str) -> Column:
    return F.coalesce(url_host(F.col(url_col)), F.lit(""))


def host_shapes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper's items as JSON): one row for each host of `pages`; pages without a host share the empty one."""

    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        shapes: dict[str, set[str]] = {}
        for batch in batches:
            for host, text in zip(batch.column("w_host").to_pylist(), batch.column("w_html"), strict=True):
                known = shapes.setdefault(host, set())
                found[host] = add_page(found.get(host, [[], []]), text.as_py(), known)
                if len(known) > SHAPES:
                    known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(items) for _, items in found.values()], pa.string())], ["host", "wrapper"])

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = reduce(align, map(json.loads, sorted(set(rows["wrapper"]))))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(items)]})

    parts = pages.select(_hosts(url_col).alias("w_host"), F.col(html_col).alias("w_html")).mapInArrow(partial, "host string, wrapper string")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    return parts.groupBy("host", "salt").applyInPandas(merged, "host string, wrapper string").groupBy("host").applyInPandas(merged, "host string, wrapper string")


def with_wrappers(pages: DataFrame, wrappers: Written, keep: tuple[str, ...], url_col: str, html_col: str) -> DataFrame:
    """The columns in `keep`, w_host, w_html and w_wrapper for every row."""
    small = (wrappers.df.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0) <= BROADCAST_BYTES
    rows = pages.select(*keep, _hosts(url_col).alias("w_host"), F.col(html_col).alias("w_html"))
    side = wrappers.df.select(F.col("host").alias("w_of"), F.col("wrapper").alias("w_wrapper"))
    if small:
        joined = rows.join(F.broadcast(side), rows["w_host"] == side["w_of"], "left")
    else:  # hosts of many pages are spread by a salt
        rows = rows.withColumn("w_salt", F.pmod(F.xxhash64("w_html"), F.lit(SALTS)))
        side = side.withColumn("w_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(side, (rows["w_host"] == side["w_of"]) & (rows["w_salt"] == side["w_s"]), "left")
    return joined.select(*keep, "w_host", "w_html", "w_wrapper")


class _Levels(dict):
    """Levels of wrappers by their JSON; of those whose slots aren't settled without texts."""

    def __init__(self, settled: bool):
        self.settled = settled

    def __missing__(self, source: str) -> Level:
        if len(self) >= 1000:
            self.clear()
        items = json.loads(source)
        self[source] = level = Level(items if self.settled else settle(items, []))
        return level


@tidy
def _slot_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w_host, w_html, w_wrapper) -> (host, slot, text, page): the texts in each page's slots, and a row of slot -1 for the page; `page` is the digest of its main text."""
    levels = _Levels(False)
    for batch in batches:
        found: set[tuple[str, int, str, int]] = set()
        for host, html, wrapper in zip(*(batch.column(c) for c in ("w_host", "w_html", "w_wrapper")), strict=True):
            page, seen = parse(html.as_py()), set()
            text, _, _ = _texts(page, levels[wrapper.as_py() or "[]"], has_article(page), seen)
            name, number = host.as_py(), digest(text) - (1 << 63)
            found.add((name, -1, "", number))
            found.update((name, slot, form, number) for slot, form in seen)
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["host", "slot", "text", "page"])


@tidy
def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [json.dumps(settle(json.loads(wrapper), [(t["slot"], t["text"], t["n"]) for t in texts or ()])) for wrapper, texts in zip(batch.column("wrapper").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], ["host", "wrapper"])


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> Written:
    """(host, settled wrapper as JSON), the texts of slots counted over every page."""
    shapes = Written(host_shapes(pages, url_col, html_col), "shapes")
    texts = with_wrappers(pages, shapes, (), url_col, html_col).mapInArrow(_slot_texts, "host string, slot int, text string, page long").distinct()
    counts = Written(texts.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where((F.col("slot") < 0) | (F.col("n") >= LEAST)), "counts")
    different = counts.df.where("slot < 0").select("host", F.col("n").alias("pages"))
    told = counts.df.where("slot >= 0").join(different, "host").where(F.col("n") > F.lit(TEMPLATE_SHARE) * F.col("pages"))
    told = told.groupBy("host").agg(F.collect_list(F.struct("slot", "text", "n")).alias("texts"))
    out = Written(shapes.df.join(told, "host", "left").select("host", "wrapper", "texts").mapInArrow(_settled, "host string, wrapper string"), "wrappers")
    shapes.drop()
    counts.drop()
    return out


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns in `keep` and `text` for every row; null, empty and broken html gives what text it has, the empty string at least. Repeated rows stay repeated."""
    joined = with_wrappers(pages, host_wrappers(pages, url_col, html_col), keep, url_col, html_col)
    schema = StructType([*pages.select(*keep).schema.fields, *StructType.fromDDL("text string").fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _Levels(True)
        for batch in batches:
            texts = [extract(parse(page.as_py()), levels[wrapper.as_py() or "[]"]) for page, wrapper in zip(batch.column("w_html"), batch.column("w_wrapper"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], schema.names)

    return joined.select(*keep, "w_html", "w_wrapper").mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
