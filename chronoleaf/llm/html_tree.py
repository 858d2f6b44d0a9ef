"""Main text of pages by a site style tree.

Pages of one host are merged into a tree of presentation nodes (paths of tags with their classes and roles).
Per node, the entropy of its styles (sequences of child tags) over pages says how much layouts vary there, and
the entropy of each content feature (a text, a link) over pages says how often it repeats; both combine, from
the leaves up, to an importance from 0 (the same everywhere) to 1. PRIOR further pages on which everything varies
are taken for granted, so that a few pages prove little and one page nothing; there is no least number of pages.

What tags and classes declare is evidence: a number per node, passed down the tree, to which the share of the host's text below
the node adds (a form or a "sidebar" that holds most of a page is no aside). The importance is multiplied by a logistic
weight of that evidence: about 0.9 where nothing is declared, nearly 1 in articles, 0.7 for a class name that has a
telling word among others. Two kinds of evidence decide alone, unless the node holds most of the text: elements that are
menus, footers, asides, buttons, forms or the like by their tag or role, and class names that say nothing but a word like
"comments", "cookie" or "ad" (CERTAIN). Any other telling class name ("notice", "related") leaves 0.34, so that
something has to agree: a low entropy, links that make up most of its text, or a place outside the page's article.
Branches whose product is under LOW are removed from each page of the host.

Articles survive. Pages of a host with the same main text (that of the article, else all that nothing speaks against) count
once, so mirrors do not make their article common. A heading is judged with the element around it, so subheadings that every page has
stay. And a page never loses more than half of its article: then all of it stays that no tag or class speaks against.

The merged trees are sums per (host, path, feature), so a host with a third of all pages is counted in all
tasks; only a host's distinct paths, not its pages, meet in one task. Class names lose their numbers and generated names all
but their place, so that paths follow the layouts of a host and not its pages.

Defined cases: null or empty html gives an empty text; a null url has the host ""; a null page_id stays null; repeated rows
get repeated results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoleaf.llm.common import bound_batches, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HREF = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Element names of HTML and words that sites use in class names.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes template".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li option optgroup tbody td tfoot th thead title tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NEVER = frozenset("head nav footer aside button select dialog menu noscript svg canvas object audio video".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td dt dd figcaption caption a abbr b bdi bdo big cite code data dfn del em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Of these, the words that leave no doubt as a whole class name.
CERTAIN = frozenset("ad ads advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav navbar navigation newsletter pagination share sharing sidebar signup sponsor sponsored subscribe".split())
HEADERS = frozenset("header masthead banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption legend summary".split())
#: Words that say nothing beside one of WORDS.
GENERIC = frozenset("area bar block bottom box container group inner item left list main outer panel primary right secondary section site slot top unit wrap wrapper".split())
PAGES = "page_id long, url string, host string, page long, blocks array<struct<path:bigint,text:string,main:boolean>>, nodes array<struct<path:bigint,parent:bigint,kind:int,feature:bigint>>"
#: Share of a node's importance that its content keeps per further style; pages taken for granted; what is removed.
GAMMA, PRIOR, LOW = 0.9, 2.0, 0.25
#: Evidence in tenths: of an element that is a menu or the like, of a form or a certain class name, of a telling name, of a name that is telling in part, of an article.
SURE, NAMED, TELLING, HINT, ARTICLE = -30, -25, -16, -10, 20
#: What agrees with a telling name: a place outside the page's article, links as most of the text below.
OUTSIDE = LINKED = -10
#: A node that holds more than MOSTLY of a page's text gets BULK times the excess, unless its element is SURE.
MOSTLY, BULK = 0.6, 50.0
#: The weight is 1 / (1 + exp(-(BASE + SLOPE * evidence))).
BASE, SLOPE = 2.2, 0.18


def hash64(text: str, seed: int = 0) -> int:
    h = xxhash.xxh64_intdigest(text, seed & 0x7FFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def telling(name: str, words: frozenset[str]) -> int:
    """Evidence of a class name or id: NAMED or TELLING if it says no more than words of the list, HINT if it has one among others."""
    parts = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words.intersection(parts):
        return 0
    if not all(w in words or w in GENERIC for w in parts):
        return HINT
    return NAMED if CERTAIN.intersection(words, parts) else TELLING


#: A part of a class name that a tool made: letters and figures mixed.
MADE = re.compile(r"(?=[a-z]*\d)(?=\d*[a-z])[a-z\d]{5,}")


@lru_cache(maxsize=100_000)
def node(parent: int, tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """Path of an element under ``parent``, and its evidence. inside: an article is around it, whose headers belong to it."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    names = re.sub(r"\d+", "0", MADE.sub("0", f"{found.get('class', '')} {found.get('id', '')}")).split()
    role = found.get("role", "")
    path = hash64(f"{parent}/{tag}.{' '.join(sorted(names))}.{role}")
    if tag in ("html", "body"):
        return path, 0
    if tag in ("article", "main") or role in ("main", "article"):
        return path, ARTICLE
    if tag in NEVER or role in ROLES or tag == "header" and not inside:
        return path, SURE
    words = WORDS - HEADERS if inside else WORDS
    worst = min((telling(n, words) for n in names), default=0)
    if tag in TEXTUAL:
        worst = HINT if worst <= TELLING else 0
    return path, NAMED if tag == "form" else worst


IN, FREE = 2, 1


def summed(above: float, own: float) -> float:
    """Evidence that reaches a node: what speaks against it adds to what speaks against its parent, not for it."""
    return max(float(SURE), min(float(ARTICLE), min(above, 0.0) + own if own < 0 else above + own))


def parse(page: str) -> tuple[list[tuple[int, str]], set[tuple[int, int, int, int]]]:
    blocks, nodes, _ = parse_page(page)
    return blocks, nodes


def parse_page(page: str) -> tuple[list[tuple[int, str]], set[tuple[int, int, int, int]], list[int]]:
    """Blocks (path, text) in page order, nodes (path, parent, kind, feature), and of each block what it is to its page.

    kind 0: the node is there, its feature is its evidence; 1: a style, a hash of its child tags; 2: a content feature, a hash of a text or
    link; 3: its feature is the length of the node's own text; 4: it is a heading; 5: the length of its own text in links.
    A block is IN an article, FREE of any evidence against it, or neither; if it is both, IN.
    """
    blocks: list[tuple[int, str]] = []
    nodes: set[tuple[int, int, int, int]] = set()
    # of each open element: tag, path, parent's path, whether it is in an article, whether it is inline and set apart, child tags
    stack: list[list] = [["", 0, 0, False, False, []]]
    buffer: list[str] = []
    own: dict[tuple[int, int], int] = {}
    linked: dict[tuple[int, int], int] = {}
    # of each path: the evidence that reaches it, and whether it is in an article; what it declares itself
    reach: dict[int, tuple[float, bool]] = {0: (0.0, False)}
    declared: dict[tuple[int, int], int] = {}
    # text of inline elements that are set apart from the block around them, as they declare a menu or the like
    beside: dict[tuple[int, int], list[str]] = {}
    at, home = 0, stack[0]

    def put(path: int, parent: int, parts: list[str]) -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append((path, text))
            if path:
                nodes.add((path, parent, 2, hash64(text)))
                own[path, parent] = own.get((path, parent), 0) + len(text)

    def flush() -> None:
        if buffer:
            put(home[1], home[2], buffer)
        for (path, parent), parts in beside.items():
            put(path, parent, parts)
        beside.clear()

    def add(raw: str) -> None:
        nonlocal home
        if raw:
            block = next(e for e in reversed(stack) if e[0] in BLOCK or not e[0])
            text = html.unescape(raw) if "&" in raw else raw
            if stack[-1][4]:
                beside.setdefault((stack[-1][1], stack[-1][2]), []).append(text)
                return
            if not buffer:
                home = block
            buffer.append(text)
            if any(e[0] == "a" for e in stack):
                at_ = (home[1], home[2])
                linked[at_] = linked.get(at_, 0) + len(text.strip())

    def close() -> None:
        tag, path, parent, _, _, children = stack.pop()
        nodes.add((path, parent, 1, hash64(" ".join(c for i, c in enumerate(children) if not i or children[i - 1] != c))))

    def close_to(names: set[str] | frozenset[str], barrier: set[str] | frozenset[str] = frozenset()) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    close()
                return True
            if stack[i][0] in barrier:
                return False
        return False

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if m[1]:
            close_to({tag}, {"table"} if tag not in ("table", "body", "html") and tag not in SCOPE else frozenset())
            continue
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close_to({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            while close_to(SIBLINGS[tag], SCOPE[tag]):
                pass
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?|\\Z", re.I).search(page, at)
            at = end.end()
            continue
        above = stack[-1]
        path, evidence = node(above[1], tag, m[3] or "", above[3])
        above[5].append(tag)
        stack.append([tag, path, above[1], above[3] or evidence == ARTICLE, tag not in BLOCK and (above[4] or evidence <= TELLING), []])
        declared[path, above[1]] = evidence
        reach[path] = summed(reach[above[1]][0], evidence), stack[-1][3]
        if tag in HEADINGS:
            nodes.add((path, above[1], 4, 1))
        if tag == "a" and (link := HREF.search(m[3] or "")):
            nodes.add((path, above[1], 2, hash64(link[1] or link[2] or link[3] or "")))
    add(page[at:])
    flush()
    while len(stack) > 1:
        close()
    nodes.update((path, parent, 3, n) for (path, parent), n in own.items())
    nodes.update((path, parent, 5, n) for (path, parent), n in linked.items() if n)
    inside = [reach[p][1] and reach[p][0] > 0 for p, _ in blocks]
    for (path, parent), evidence in declared.items():
        out = any(inside) and evidence == TELLING and not reach[path][1]
        nodes.add((path, parent, 0, evidence + OUTSIDE * out))
    return blocks, nodes, [IN if i else FREE * (reach[p][0] > HINT) for i, (p, _) in zip(inside, blocks, strict=True)]


def key_of(page: str, blocks: list[tuple[int, str]], kinds: list[int]) -> int:
    """A hash of what the page is about: the texts IN its article, else its FREE ones, else its html."""
    for kind in (IN, FREE):
        if texts := [t for (_, t), k in zip(blocks, kinds, strict=True) if k == kind]:
            return hash64("\n\n".join(texts))
    return hash64(page)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def parsed(pages: DataFrame) -> DataFrame:
    """PAGES of each row, written to the shared folder: a page is parsed once. ``page`` is a hash of its main text, if any."""
    bound_batches(pages.sparkSession)
    names = [x.split()[0] for x in PAGES.split(", ")]
    block = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string()), ("main", pa.bool_())]))
    part = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 256):
                b = big.slice(a, 256)
                urls = b.column(1).to_pylist()
                raw = [x or "" for x in b.column(2).to_pylist()]
                made = [parse_page(x) for x in raw]
                rows = [[{"path": p, "text": t, "main": k == IN} for (p, t), k in zip(x, kinds, strict=True)] for x, _, kinds in made]
                nodes = [[{"path": p, "parent": q, "kind": k, "feature": f} for p, q, k, f in sorted(x)] for _, x, _ in made]
                keys = [key_of(h, x, kinds) for (x, _, kinds), h in zip(made, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(map(host_of, urls), pa.string()), pa.array(keys, pa.int64()), pa.array(rows, block), pa.array(nodes, part)], names=names)

    return written(pages.select("page_id", "url", "html").mapInArrow(run, PAGES), "parsed-pages")


def importance(rows: list[tuple], gamma: float = GAMMA) -> dict[int, float]:
    """rows of one host (path, parent, pages, styles, style_sum, style_log, features, feature_log, evidence, length[, heading, linked])
    -> path -> importance.

    length: of the node's own text on all pages; linked: of what of it is in links.
    """
    children: dict[int, list[tuple]] = {}
    for r in rows:
        children.setdefault(r[1], []).append(r)
    order, todo = [], list(children.get(0, []))
    while todo:
        r = todo.pop()
        order.append(r)
        todo += children.get(r[0], [])
    # from the leaves up: what styles and contents say, and the text below each node
    said: dict[int, float] = {}
    below: dict[int, int] = {}
    links: dict[int, int] = {}
    for path, _, m, styles, total, logs, features, feature_log, _, length, *rest in reversed(order):
        below[path] = length + sum(below[c[0]] for c in children.get(path, []))
        links[path] = (rest[1] if rest else 0) + sum(links[c[0]] for c in children.get(path, []))
        if m < 2:
            said[path] = 1.0
            continue
        style = (math.log(total) - logs / total) / math.log(m) if total else 0.0
        parts = [(c[2] / m, said[c[0]]) for c in children.get(path, [])]
        if features:
            parts.append((1.0, max(0.0, 1 - feature_log / (features * math.log(m)))))
        inner = sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else 0.0
        keep = gamma ** max(styles, 1)
        said[path] = (1 - keep) * min(style, 1.0) + keep * inner
    # from the root down: evidence
    pages, text = max((r[2] for r in rows), default=0), sum(r[9] for r in rows)
    evidence: dict[int, float] = {0: 0.0}
    out: dict[int, float] = {}
    for path, parent, m, _, _, _, _, _, own, _, *rest in order:
        own += LINKED * (own == TELLING and 2 * links[path] > below[path])
        x = min(evidence[parent], 0.0) + own if own < 0 else evidence[parent] + own
        if own != SURE and text:
            x += BULK * max(0.0, below[path] / text * pages / m - MOSTLY)
        evidence[path] = max(float(SURE), min(float(ARTICLE), x))
        out[path] = (m * said[path] + PRIOR) / (m + PRIOR) / (1 + math.exp(-BASE - SLOPE * evidence[path]))
        if rest and rest[0] and own >= 0 and parent in out:
            out[path] = max(out[path], out[parent])
    return out


def low_branches(table: DataFrame, low: float = LOW) -> DataFrame:
    """host, low: paths of low importance of the host's merged tree, for hosts that have any."""
    nodes = table.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.*").distinct()
    counted = nodes.groupBy("host", "path", "parent", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0)).cast("double")
    n, log = F.col("n").cast("double"), F.log(F.col("n"))
    tree = counted.groupBy("host", "path", "parent").agg(of(0, n).alias("m"), of(1, F.lit(1)).alias("styles"), of(1, n).alias("total"), of(1, n * log).alias("logs"), of(2, F.lit(1)).alias("features"), of(2, log).alias("feature_log"), F.max(F.when(F.col("kind") == 0, F.col("feature"))).cast("int").alias("evidence"), of(3, n * F.col("feature")).alias("length"), of(4, F.lit(1)).alias("heading"), of(5, n * F.col("feature")).alias("linked"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(host: str, rows: list[tuple]) -> pa.RecordBatch:
            found = [p for p, v in importance(rows).items() if v < low]
            return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([found], pa.list_(pa.int64()))], names=["host", "low"])

        host, rows = None, []
        for b in batches:
            for h, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != host:
                    if rows:
                        yield result(host, rows)
                    host, rows = h, []
                rows.append(tuple(r))
        if rows:
            yield result(host, rows)

    ordered = tree.repartition("host").sortWithinPartitions("host")
    return ordered.mapInArrow(weigh, "host string, low array<bigint>").filter(F.size("low") > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``."""
    table = parsed(pages)
    lows = written(low_branches(table), "low-branches").withColumnRenamed("host", "h")
    x = table.select("page_id", "url", "host", "blocks").join(lows, F.col("host") == F.col("h"), "left")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("low", b["path"]), F.lit(False)))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    article = F.filter("blocks", lambda b: b["main"])
    lost = 2 * size(F.filter(kept, lambda b: b["main"])) < size(article)
    kept = F.when(lost, F.filter("blocks", lambda b: b["main"] | ~F.coalesce(F.array_contains("low", b["path"]), F.lit(False)))).otherwise(kept)
    x = x.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text"))
    return x.withColumn("n_chars", F.length("text").cast("long"))
