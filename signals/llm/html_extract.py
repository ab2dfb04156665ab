"""Main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signals.llm.batches import bound_batches
from signals.sources.scratch import write_once

# Element names of the HTML standard by the part they play here.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav footer aside form button select input dialog menu head".split())
MAIN = frozenset("article main".split())
# Words of class, id and role by which pages mark what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice"
    " alert popup modal newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs"
    " footer comment comments respond disqus replies reply share sharing social related recommended widget toolbar pagination"
    " pager skip login search contentinfo complementary dialog".split()
)
PAGE_HINTS = frozenset("header masthead topbar".split())
# Of those, words that also name honest parts of an article; inside one they must repeat on other pages of the host.
WEAK_HINTS = frozenset("notice alert search skip login social dialog widget signup subscription subscribe reply replies consent".split())
# Words that mark furniture as a part of any class name, and ids of reader comments.
SURE_HINTS = frozenset("ad ads advert adverts advertisement advertising sponsored disqus newsletter cookie cookies breadcrumb sidebar navbar".split())
COMMENT_IDS = frozenset("comment comments disqus_thread respond".split())
#: A host's container beside the main elements takes their place if it holds this many times their varied text.
RIVAL = 4.0
#: Pages that must show a text inside a main element before it can count as template.
SEEN_INSIDE = 3

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile("[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
ROOT = 0


@dataclass
class Node:
    """An element, or a text if ``text`` is set; ``token`` names it by its path, ``classes`` are the whole
    names in class and role, those of ``SURE_HINTS`` also as parts of one."""

    tag: str
    names: str
    parent: Node | None
    token: int
    text: str | None = None
    classes: frozenset[str] = frozenset()


def _hash(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def parse(page: str) -> Iterator[tuple[str, Node]]:
    """``open``, ``close`` and ``text`` events in page order.

    A close tag ends the innermost element of its name and all inside it; without one it is ignored. A block ends an
    open paragraph, a list item the one before it. Elements still open at the end are ended there. Comments,
    declarations and the inside of scripts and the like give nothing.
    """
    root = Node("", "", None, ROOT)
    stack, paths = [root], [""]
    at, start = 0, 0

    def text(upto: int) -> Iterator[tuple[str, Node]]:
        raw = page[start:upto]
        if raw:
            value = html.unescape(raw)
            yield "text", Node("", "", stack[-1], _hash(f"{paths[-1]}:{' '.join(value.split())}"), value)

    def end(depth: int) -> Iterator[tuple[str, Node]]:
        while len(stack) > depth:
            paths.pop()
            yield "close", stack.pop()

    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            yield from text(at)
            stop = page.find("-->", at + 4)
            start = at = len(page) if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), at):
            yield from text(at)
            stop = page.find(">", at)
            start = at = len(page) if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            at += 1
            continue
        yield from text(at)
        start = at = m.end()
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                yield from end(depth)
            continue
        if tag in BLOCK:
            closes = ("li",) if tag == "li" else ("dd", "dt") if tag in ("dd", "dt") else ("p",)
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in BLOCK), 0)
            if depth and stack[depth].tag in (*closes, "p"):
                yield from end(depth)
        named = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])}
        names = " ".join(named[k] for k in ("class", "id", "role", "itemprop") if k in named).lower()
        path = f"{paths[-1]}/{tag}.{_DIGITS.sub('0', names)}" if tag in BLOCK else paths[-1]
        classes = set(f"{named.get('class', '')} {named.get('role', '')}".lower().split())
        classes |= SURE_HINTS.intersection(_WORD.findall(" ".join(classes)))
        if named.get("id", "").strip().lower() in COMMENT_IDS:
            classes.add("comments")
        node = Node(tag, names, stack[-1], _hash(path if tag in BLOCK else f"{path}/{tag}"), classes=frozenset(classes))
        yield "open", node
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            close = page.find(">", stop.end()) if stop else -1
            start = at = len(page) if close < 0 else close + 1
            yield "close", node
        elif tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            yield "close", node
        else:
            stack.append(node)
            paths.append(path)
    yield from text(len(page))
    yield from end(1)


@dataclass
class Seen:
    """A token on a page: how often and where first, the element it stands in, and the unlinked text characters inside it."""

    n: int
    place: int
    parent: int
    chars: int = 0


@dataclass
class Template:
    """What the pages of a host share.

    ``classes`` of tokens that occur together, in template order, largest first; of each such token the mean unlinked
    characters inside it (``chars``) and the pages that show it (``support``); ``repeated`` are the elements of
    ambiguous names that stand on more than one page.
    """

    classes: list[list[int]]
    chars: dict[int, float]
    support: dict[int, int]
    repeated: set[int]


NO_TEMPLATE = Template([], {}, {}, set())


def text_below(events: list[tuple[str, Node]], size: Callable[[Node, bool], int]) -> Counter[int]:
    """The summed size of the texts inside each element, by the id of its node; ``size`` is told whether a link is open."""
    total: Counter[int] = Counter()
    links = 0
    for kind, node in events:
        if node.tag == "a":
            links += 1 if kind == "open" else -1
        if kind == "text":
            total[id(node.parent)] += size(node, links > 0)
        elif kind == "close":
            total[id(node.parent)] += total[id(node)]
    return total


def page_tokens(events: list[tuple[str, Node]]) -> dict[int, Seen]:
    """Each tag or text token of a page; ``ROOT`` stands once on every page."""
    found = {ROOT: Seen(1, 0, ROOT)}
    below = text_below(events, lambda node, linked: 0 if linked else len(node.text.strip()))
    for n, (kind, node) in enumerate(events, start=1):
        if kind == "close" or node.text is not None and not node.text.strip():
            continue
        seen = found.setdefault(node.token, Seen(0, n, node.parent.token))
        seen.n += 1
        seen.chars += below[id(node)]
    return found


def _is_main(node: Node) -> bool:
    return node.tag in MAIN or "main" in node.names.split() or "articlebody" in node.names.split()


def _chrome(node: Node, inside: bool, template: Template) -> bool:
    """Whether an element is page furniture.

    ``inside`` a main element headers belong to the article, only whole class names count, ids do not (but for reader
    comments), and a name that honest parts share must stand on other pages of the host as well, if it has a template.
    """
    if node.tag in RAW or node.tag in CHROME or node.tag == "header" and not inside:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and bool({"comment", "comments", "reply"} & set(_WORD.findall(node.names)))
    if inside:
        known = not template.classes or node.token in template.repeated
        return bool(node.classes & (HINTS if known else HINTS - WEAK_HINTS))
    words = set(_WORD.findall(node.names))
    return bool(words & HINTS or words & PAGE_HINTS)


def valid_tokens(places: dict[int, Seen], classes: list[list[int]]) -> set[int]:
    """The tokens of the classes that hold on a page: all there, in template order, and nested.

    Classes come largest first. A class holds if its first places rise in template order, and if it lies
    within one gap of every class accepted before it or spans that class in one gap of its own.
    """
    accepted: list[list[int]] = []
    tokens: set[int] = set()
    for members in classes:
        at = [places[t].place for t in members if t in places]
        if len(at) < len(members) or any(a >= b for a, b in zip(at, at[1:], strict=False)):
            continue
        if all(bisect(o, at[0]) == bisect(o, at[-1]) or bisect(at, o[0]) == bisect(at, o[-1]) for o in accepted):
            accepted.append(at)
            tokens.update(members)
    return tokens


def content_elements(
    events: list[tuple[str, Node]], known: set[int], template: Template, hidden: dict[int, bool], inside: dict[int, bool]
) -> set[int]:
    """The elements (ids of nodes) whose slots are the main text; none if nothing marks any.

    Elements named as main by their tag or class are taken, those of the template before others and articles before
    the rest. Names can be wrong, so the template decides between them and the page's other containers: one outside
    furniture that holds over ``RIVAL`` times as much of the host's varied text takes their place, as deep as nine tenths
    of that text reach.
    """
    opened = [n for kind, n in events if kind == "open" and not hidden[id(n)]]
    mains = [n for n in opened if _is_main(n) and not inside.get(id(n.parent), False)]
    mains = [m for m in mains if m.token in known] or mains
    mains = [m for m in mains if m.tag == "article"] or mains
    if not mains or not known:
        return {id(m) for m in mains}
    static = text_below(events, lambda n, _: len(n.text.strip()) if n.token in known else 0)
    varied = lambda n: template.chars.get(n.token, 0.0) - static[id(n)]
    around = {ROOT}
    for m in mains:
        while m.parent is not None:
            m = m.parent
            around.add(id(m))
    rivals = [n for n in opened if n.token in known and n.tag in BLOCK and id(n) not in around and not inside[id(n)]]
    best = max(rivals, key=varied, default=None)
    if best is None or varied(best) <= RIVAL * max(varied(m) for m in mains):
        return {id(m) for m in mains}
    return {id([n for n in rivals if varied(n) >= 0.9 * varied(best)][-1])}


def main_text(page: str, template: Template) -> str:
    """The blocks of a page's content slots, joined by blank lines.

    The tokens of the host's equivalence classes that hold on this page are its template, and what lies between them are
    slots. Of the content elements (``content_elements``) every slot outside furniture is text. A text token of the template
    is no slot and goes, inside a content element if ``SEEN_INSIDE`` pages show it, unless such texts are more than half of
    all that is held: then the pages are copies of one article, not pages with a common frame. Without any content
    element every slot outside furniture is taken, but blocks that are mostly links.
    """
    events = list(parse(page))
    known = valid_tokens(page_tokens(events), template.classes) if template.classes else set()
    hidden: dict[int, bool] = {}
    inside: dict[int, bool] = {}
    for kind, node in events:
        if kind == "open":
            within = inside.get(id(node.parent), False)
            hidden[id(node)] = hidden.get(id(node.parent), False) or _chrome(node, within, template)
            inside[id(node)] = within or _is_main(node) and not hidden[id(node)]
    chosen = content_elements(events, known, template, hidden, inside)
    held: dict[int, bool] = {}
    for kind, node in events:
        if kind == "open":
            held[id(node)] = id(node) in chosen or held.get(id(node.parent), not chosen)
    slots = [n for k, n in events if k == "text" and not hidden.get(id(n.parent), False) and held.get(id(n.parent), not chosen)]
    fixed = {n.token for n in slots if n.token in known and n.text.strip()}
    if chosen:
        fixed = {t for t in fixed if template.support[t] >= SEEN_INSIDE}
        if 2 * sum(len(n.text.strip()) for n in slots if n.token in fixed) > sum(len(n.text.strip()) for n in slots):
            fixed = set()
    taken = {id(n) for n in slots if n.token not in fixed}

    blocks: dict[int, list[tuple[str, bool]]] = {}
    block = links = 0
    for kind, node in events:
        if node.tag == "a":
            links += 1 if kind == "open" else -1
        if kind == "text":
            if id(node) in taken:
                blocks.setdefault(block, []).append((node.text, links > 0))
        elif node.tag in BLOCK:
            block += 1
        elif node.tag == "br" and kind == "open":
            blocks.setdefault(block, []).append((" ", links > 0))
    if not chosen:
        linked = lambda parts: sum(len(t.strip()) for t, link in parts if link)
        blocks = {n: p for n, p in blocks.items() if 2 * linked(p) <= sum(len(t.strip()) for t, _ in p)}
    lines = (" ".join("".join(t for t, _ in parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def host_templates(pages: DataFrame, host: str, body: str, share: float) -> DataFrame:
    """``host, tokens, chars, support, repeated``: what a ``Template`` holds, one row a host.

    Equal pages of a host count once. A token's occurrence vector is kept as two order-free hashes of its (page, count) pairs,
    merged by aggregation, so a host with a third of all pages costs one small row per token and task. Tokens found on
    two pages and on ``share`` of the pages that hold the element they stand in, which follows the layouts of a host, form a
    class with those of the same vector; classes of two tokens or more are kept. They are bounded by the tokens of a few pages.
    """
    keyed = pages.where(F.col(host) != "").select(
        F.col(host).alias("host"), F.xxhash64(body).alias("page"), F.col(body).alias("body")
    )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, of, names, seen, hinted = [], [], [], [], []
            for h, page, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                events = list(parse(body))
                weak = {n.token for k, n in events if k == "open" and n.classes & WEAK_HINTS}
                for token, s in page_tokens(events).items():
                    hosts.append(h)
                    of.append(page)
                    names.append(token)
                    seen.append(s)
                    hinted.append(token in weak)
            columns = [pa.array(hosts, pa.string()), pa.array(of, pa.int64()), pa.array(names, pa.int64())]
            columns += [pa.array([getattr(s, f) for s in seen], pa.int64()) for f in ("parent", "n", "place", "chars")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(hinted, pa.bool_())], names=["host", "page", "token", "parent", "n", "place", "chars", "weak"]
            )

    kinds = "host string, page bigint, token bigint, parent bigint, n bigint, place bigint, chars bigint, weak boolean"
    # Equal pages give equal rows; hashes are summed by exclusive or, so each must count once.
    once = keyed.mapInArrow(tokens, kinds).distinct()
    vectors = write_once(
        once.groupBy("host", "token")
        .agg(
            F.count(F.lit(1)).alias("support"),
            F.bit_xor(F.xxhash64("page", "n")).alias("a"),
            F.bit_xor(F.xxhash64("n", "page", F.lit("#"))).alias("b"),
            F.avg("place").alias("place"),
            F.avg("chars").alias("chars"),
            F.min("parent").alias("parent"),
            F.bool_or("weak").alias("weak"),
        )
        .where(F.col("support") > 1)
    )
    around = vectors.select("host", F.col("token").alias("parent"), F.col("support").alias("around"))
    members = F.struct("place", "token", "chars", "support")
    classes = (
        vectors.where(F.col("token") != ROOT)
        .join(around, ["host", "parent"])
        .where(F.col("support") >= share * F.col("around"))
        .groupBy("host", "a", "b")
        .agg(F.max("support").alias("most"), F.array_sort(F.collect_list(members)).alias("members"))
        .where(F.size("members") > 1)
    )
    largest = F.struct((-F.col("most")).alias("s"), (-F.size("members")).alias("n"), F.col("members.token").alias("tokens"), "members")
    of_host = classes.groupBy("host").agg(F.array_sort(F.collect_list(largest)).alias("classes"))
    repeated = vectors.where("weak").groupBy("host").agg(F.collect_set("token").alias("repeated"))
    all_members = F.flatten("classes.members")
    return of_host.join(repeated, "host", "left").select(
        "host",
        "classes.tokens",
        F.transform(all_members, lambda m: m["chars"]).alias("chars"),
        F.transform(all_members, lambda m: m["support"]).alias("support"),
        "repeated",
    )


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", share: float = 0.5
) -> DataFrame:
    """One row per input row: ``page_id, url, text``.

    Pages are grouped by the host of their address; pages without one, and hosts of a single page, are read
    without a template. Character references are decoded, white space inside a block becomes one space, blocks are
    joined by two line feeds. Null and empty bodies give an empty text, as do pages without content.
    Broken markup and pages cut off are read as far as they go; a page of any length is read whole. Repeated rows keep a row
    each and count once for the template; an empty table gives none; further columns are ignored.
    """
    bound_batches(pages.sparkSession)
    read = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("_url"),
        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("_body"),
    ).withColumn("_host", host_of(F.col("_url")))
    templates = write_once(host_templates(read, "_host", "_body", share)).withColumnRenamed("host", "_host")
    kind = read.schema["page_id"].dataType.simpleString()
    parts = ["tokens", "chars", "support", "repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.select(["_body", *parts]).to_pylist():
                classes = row["tokens"] or []
                names = list(chain.from_iterable(classes))
                chars, support = (dict(zip(names, row[k] or [], strict=True)) for k in ("chars", "support"))
                texts.append(main_text(row["_body"], Template(classes, chars, support, set(row["repeated"] or []))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return read.join(templates, "_host", "left").select("page_id", "_url", "_body", *parts).mapInArrow(
        run, f"page_id {kind}, url string, text string"
    )
