"""HTML extraction with a site style tree.

Pages of a host are merged by the paths of their elements.  A node's evidence
is how much its presentation (the tags and classes of its children) and its
content vary over the host's pages; what mark-up says of a block is its prior.
Both are added up for every block of every page, and blocks below zero leave.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.tables import table, text_of
from topotide.plans.scratch import written

#: Prior log odds of a block: inside a main or article element, of its own, and where mark-up names it as noise.
PRIOR = {"main": 1.4, "open": 0.0, "noise": -4.0}
#: Added to the prior inside a main element by a class, id or role that may name noise or a part of the story.
DOUBT = -2.9
#: Log odds of text beside main elements with as many characters as they have.
AS_LONG = -0.5
#: Change of the log odds from entropy 1/2 to 1 or 0, of a node's texts and of its parent's children.
CONTENT, PRESENTATION = 2.5, 1.0
#: With fewer distinct pages than that, a host's tree says nothing of a node.
LEAST_PAGES = 4
#: Most nodes that are broadcast; more are joined by a shuffle.
MAX_NODES = 200_000

# HTML's own element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object textarea title head".split())
BLOCK = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset figure figcaption blockquote pre address details summary hr dialog menu".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("li dt dd td th tr thead tbody tfoot caption html body summary figcaption".split())
#: An opening tag ends an open element of its own group, up to the nearest container.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table body html div section article nav aside".split())
MAIN = frozenset(("main", "article"))
NOISE = frozenset("nav header footer aside form button select menu dialog label".split())
#: Words of class, id and role attributes that name what is not main text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr alert popup modal overlay sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments disqus replies reply respond reader-comments share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager tags legal copyright contentinfo complementary".split()
)
#: Those that also name parts of a story: inside a main element they are outweighed where a node's texts vary over the host.
DOUBTFUL = frozenset("alert banner legal notice notices promo promotion".split())
#: Words that may stand beside them in a hyphenated name.
BESIDE = frozenset("area bar block box buttons container content form global icons inner left links list main outer panel posts right section site slot top bottom wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def host_of(url: str | None) -> str:
    """The host of an address without its port, in lower case."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def names_noise(name: str) -> bool:
    """Whether a class, id or role names what is not main text: as a whole, or in hyphenated parts of which no other has a meaning of its own."""
    parts = re.split("[-_]+", name)
    return name in NOISE_WORDS or not NOISE_WORDS.isdisjoint(parts) and all(x in NOISE_WORDS or x in BESIDE for x in parts)


def _style(attributes: str) -> tuple[str, bool, bool]:
    """The classes of an element as part of its path, whether a class, id or role names noise, and whether only doubtful words do."""
    cls, noise = "", []
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower().split()
            noise += filter(names_noise, value)
            if m[1].lower() == "class":
                cls = "." + ".".join(value)
    return cls, bool(noise), bool(noise) and all(NOISE_WORDS.intersection(re.split("[-_]+", x)) <= DOUBTFUL for x in noise)


def blocks_of(page: str) -> list[tuple[str, str, int]]:
    """(path, text, role) of the text blocks of a page in their order.

    path holds tag and class of the block elements above the text; role is 0
    inside what the mark-up names as noise, 2 inside an article or main
    element, 3 where there only a doubtful word names it as noise, else 1.
    Where all such elements stand inside what only class or
    id words name as noise, the words name a layout and the elements have
    role 2.  Texts have references decoded and white space as one
    space.  Unclosed paragraphs and list items end where HTML ends them;
    closing tags without an open element are ignored.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = [("", "", 1)]  # tag, path, role
    texts: list[str] = []

    def flush() -> None:
        if texts:
            text = _SPACE.sub(" ", "".join(texts)).strip(" ")
            texts.clear()
            if text:
                out.append((stack[-1][1], text, stack[-1][2]))

    def pop_to(i: int) -> None:
        flush()
        del stack[i:]

    at, n, lower = 0, len(page), None
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            texts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            texts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if name not in BLOCK:
            if name == "br":
                texts.append(" ")
            elif name in RAW and not m[1] and not m[3].endswith("/"):
                lower = page.lower() if lower is None and page.isascii() else lower
                end = re.compile(f"</{name}[\\s>/]", re.I).search(page, at)
                if name == "head":  # an unclosed head ends with the body
                    body = re.compile(r"<body[\s>]", re.I).search(page, at)
                    end = min((x for x in (end, body) if x), key=lambda x: x.start(), default=None)
                if end is None:
                    at = n if name in ("script", "style", "template") else at
                else:
                    at = end.start()
            elif name in ("button", "select", "label") and not m[1]:
                end = re.compile(f"</{name}[\\s>/]", re.I).search(page, at)
                at = end.start() if end else at
            continue
        if m[1]:
            if name == "p" and all(x[0] != "p" for x in stack):
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            continue
        if name == "hr":
            flush()
            continue
        if name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
        if name in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[name]:
                    pop_to(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
        flush()
        style, named, doubtful = _style(m[3])
        _, path, role = stack[-1]
        # a header inside an article holds its title; the page's own header does not
        noise = 2 if name in NOISE and not (name == "header" and role in (2, -2)) else int(named)
        if name in ("html", "body"):
            noise = 0
        # -1 is noise by words alone, -2 an article or main element of such noise, -3 doubtful inside that
        if role == 0 or noise == 2 or noise and abs(role) > 1 and not doubtful:
            role = 0
        elif abs(role) == 3 or noise and abs(role) == 2:
            role = 3 if role > 0 else -3
        elif name in MAIN:
            role = -2 if noise or role < 0 else 2
        elif noise:
            role = -1
        stack.append((name, f"{path}/{name}{style}", role))
    flush()
    hidden = any(x[2] == -2 for x in out) and not any(x[2] == 2 for x in out)
    return [(path, text, -role if hidden and role < -1 else max(role, 0)) for path, text, role in out]


def priors(blocks: list[tuple[str, str, int]]) -> list[float]:
    """The prior log odds of the blocks of a page.

    Text beside main elements has AS_LONG and the log ratio of its characters,
    with those of all such text in the same element, to the main elements'
    characters, at least that of noise and at most that of main text.
    """
    main = sum(len(t) for _, t, role in blocks if role == 2)
    beside: dict[str, int] = {}
    for path, text, role in blocks:
        if role == 1:
            up = path.rpartition("/")[0]
            beside[up] = beside.get(up, 0) + len(text)

    def prior(path: str, role: int) -> float:
        if role == 1 and main:
            return min(PRIOR["main"], max(PRIOR["noise"], AS_LONG + math.log(beside[path.rpartition("/")[0]] / main)))
        return (PRIOR["noise"], PRIOR["open"], PRIOR["main"], PRIOR["main"] + DOUBT)[role]

    return [prior(path, role) for path, _, role in blocks]


def child_sequences(paths: list[str]) -> list[tuple[str, str]]:
    """(path, children) of each element above the blocks with these paths: tags and classes of its children in page order.

    A child that holds blocks of its own counts once for blocks in a row.
    """
    seen: dict[str, list[str]] = {}
    for path in paths:
        parts = path.split("/")
        for i in range(1, len(parts)):
            of = seen.setdefault("/".join(parts[:i]), [])
            inner = i + 1 < len(parts)
            name = parts[i] + "/" if inner else parts[i]
            if not (inner and of and of[-1] == name):
                of.append(name)
    return [(p, " ".join(x)) for p, x in seen.items()]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks, nodes) of each page.

    blocks is an array of (path, text, prior, mark), nodes of (path, mark) of
    the elements above them; marks are hashes of text or children.  Texts whose
    prior no evidence can outweigh are left out.
    """

    def mark(t: str) -> int:
        return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("prior", pa.float64()), ("mark", pa.int64())]))
        node = pa.list_(pa.struct([("path", pa.string()), ("mark", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                urls = part.column(1).to_pylist()
                found = [blocks_of(h.as_py()) for h in part.column(2)]
                rows = [[{"path": p, "text": t if o + CONTENT + PRESENTATION >= 0 else None, "prior": o, "mark": mark(t)} for (p, t, _), o in zip(x, priors(x))] for x in found]
                nodes = [[{"path": p, "mark": mark(c)} for p, c in child_sequences([p for p, _, _ in x])] for x in found]
                columns = [part.column(0), part.column(1), pa.array([host_of(u) for u in urls]), pa.array(rows, block), pa.array(nodes, node)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "blocks", "nodes"])

    slim = pages.select("page_id", "url", text_of("html").alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, url string, host string, blocks array<struct<path:string,text:string,prior:double,mark:bigint>>, nodes array<struct<path:string,mark:bigint>>")


def _entropies(marks: DataFrame, name: str) -> DataFrame:
    """(host, path, pages, ``name``): entropy of the marks of each node to a base of their number, so 1 means that all differ.

    Counts by mark come before those by node, so no task gets all of a host.
    """
    counted = marks.groupBy("host", "path", "mark").agg(F.count(F.lit(1)).alias("c"))
    sums = counted.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("clogc") / F.col("n")) / F.log("n")).otherwise(1.0)
    return sums.select("host", "path", F.col("n").alias("pages"), entropy.alias(name))


def style_tree(parsed_pages: DataFrame) -> DataFrame:
    """(host, path, pages, presentation, content, evidence): the nodes with text of the merged trees of all hosts.

    presentation is the entropy of the child sequences of the node's parent,
    content that of the node's texts, a text counting once a page.  pages
    counts the pages that have the parent.  Copies of a page count once, as
    they say nothing about the site's design: a page stands for all with the
    same sequence of paths and texts.  evidence is 0 with fewer than
    LEAST_PAGES pages.
    """
    slim = parsed_pages.select("host", F.xxhash64("blocks.path", "blocks.mark").alias("page"), F.expr("transform(blocks, b -> struct(b.path, b.mark))").alias("blocks"), "nodes")
    slim = slim.where(F.size("blocks") > 0)
    each = {c: slim.select("host", "page", F.explode(c).alias("x")).select("host", "page", "x.path", "x.mark").distinct() for c in ("blocks", "nodes")}
    content = _entropies(each["blocks"], "content").drop("pages")
    above = _entropies(each["nodes"], "presentation").select(F.col("host").alias("h"), F.col("path").alias("parent"), "pages", "presentation")
    both = content.withColumn("up", F.expr("regexp_replace(path, '/[^/]*$', '')")).join(above, (F.col("host") == F.col("h")) & (F.col("up") == F.col("parent")))
    evidence = CONTENT * (2 * F.col("content") - 1) + PRESENTATION * (2 * F.col("presentation") - 1)
    return both.select("host", "path", "pages", "presentation", "content", F.when(F.col("pages") < LEAST_PAGES, 0.0).otherwise(evidence).alias("evidence"))


def main_text(pages: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of ``pages``.

    A block stays if its prior and its node's evidence are not below zero
    together (``priors``, ``style_tree``).  Null or empty html gives an empty
    text; a null url has a host of its own, the empty one.  Repeated rows come
    as often as they are; long pages are read whole; an empty table gives no
    rows; other columns are not read.
    """
    read = written(parsed(pages), "parsed", codec="zstd")
    tree = written(style_tree(read).where("evidence <> 0").select("host", "path", "evidence"), "tree")
    few = tree.count() <= max_nodes
    tree = tree.groupBy(F.col("host").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("path", "evidence"))).alias("tree"))  # bounded by the host's tree
    found = read.drop("nodes").join(F.broadcast(tree) if few else tree, F.col("host") == F.col("h"), "left")
    text = F.expr("array_join(transform(filter(blocks, b -> b.prior + coalesce(tree[b.path], 0D) >= 0), b -> b.text), ' ')")
    return found.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
