"""HTML extraction with site style trees.

The pages of one host are merged into one tree. A node of the tree is an element in its place: the tags and classes from
the root down, with runs of like siblings taken as one. For each node two entropies tell how much pages vary there:

* presentation: the entropy of the child sequences that pages have below the node, to the base of the number of pages;
* content: one minus the mean entropy of its pieces of text over the pages, to the same base. A piece that each page has
  has entropy 1, a piece of one page has 0.

The importance of a node is the larger one of both (composite, since a branch goes only if nothing in it is important,
cutting the largest unimportant branches is the same as leaving out the text of unimportant nodes). Text whose node has an
importance below `least` over at least `pages` pages is removed from each page.

Elements that say what they are (nav, footer, aside, form, script, a class or role such as `menu`, `ad`, `comments`) are
removed as well. All other text enters the tree, that inside `article`, `main` or an equal role too; there a block that the
tree finds unimportant is counted in `n_spared` but stays, as copies of one page on a host would go otherwise. If the tree
would leave a page nothing, the page keeps all its unmarked text.

Statistics are sums per (host, node, piece), so a host with a third of all pages is no task of its own. Broken markup is
read as browsers do where it matters: an unclosed `p` or `li` ends at the next one, unknown end tags are skipped, script
and style run to their own end tag. Null html is the empty page. A null url has host ''. Repeated pages are pages. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.session import checkpoint_dir

LEAST = 0.2
PAGES = 8

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object select button option canvas audio video".split())
MARKED = set("nav header footer aside form dialog menu head".split()) | RAW
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = {"article", "main"}
MARKED_WORDS = set(
    "ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer header masthead "
    "menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies responses share sharing sidebar "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
MARKED_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())
CLOSES_P = BLOCKS - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_PIECE = re.compile(r"[^.!?|·•]+")
_ROW = "xxhash64(page_id, url, CAST(html AS STRING))"


def _key(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Element:
    __slots__ = ("tag", "label", "key", "children", "seen", "marked", "main")

    def __init__(self, tag: str, label: str, key: int, marked: bool, main: bool):
        self.tag, self.label, self.key, self.marked, self.main = tag, label, key, marked, main
        self.children: list[str] = []
        self.seen: Counter = Counter()


def _attributes(text: str) -> tuple[str, bool, bool]:
    """Label (class and role), whether the element is marked, whether it is declared content."""
    label, marked, main = [], False, False
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            marked = True
        elif name == "role":
            marked |= value in MARKED_ROLES
            main |= value in MAIN
            label.append(value)
        elif name in ("class", "id"):
            marked |= not MARKED_WORDS.isdisjoint(_WORD.findall(value))
            if name == "class":
                label.append(".".join(value.split()))
    return ".".join(label), marked, main


def parse(page: str) -> tuple[list[tuple[str, int, bool, bool]], list[tuple[int, int]]]:
    """Text runs (block of text, node, marked, in declared content) in page order, and (node, child sequence) pairs."""
    root = _Element("", "", 0, False, False)
    stack, texts, styles = [root], [], []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                # Inline elements lie in the block around them.
                block = next((e for e in reversed(stack) if e.tag in BLOCKS or e.tag in MARKED), top)
                texts.append((text, block.key, any(e.marked for e in stack), any(e.main for e in stack)))

    def close() -> None:
        e = stack.pop()
        styles.append((e.key, _key(*e.children)))

    def end(tags: set[str], barrier: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in barrier:
                return

    raw = None
    for m in _TOKEN.finditer(page):
        slash, tag, attributes = m.group(1), m.group(2), m.group(3)
        if tag is None:
            token = m.group(0)
            if raw is None and not token.startswith(("<!", "<?")):
                buffer.append(html.unescape(token))
            continue
        tag = tag.lower()
        if raw is not None:
            if slash and tag == raw:
                raw = None
            continue
        if slash:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                flush()
            elif tag in BLOCKS or tag in MARKED:
                end({tag}, set())
            continue
        if tag == "br" or tag in VOID:
            if tag == "hr":
                flush()
            buffer.append(" ")
            continue
        if tag in RAW:
            raw = None if attributes.endswith("/") else tag
            buffer.append(" " if tag in ("script", "style") else "")
            continue
        if tag not in BLOCKS and tag not in MARKED:
            _, marked, _ = _attributes(attributes)
            if not marked:
                continue  # inline
        if tag in CLOSES_P:
            end({"p"}, BLOCKS - {"p"})
        if tag in CLOSED_BY:
            end(CLOSED_BY[tag], {"ul", "ol", "dl", "table"})
        flush()
        label, marked, main = _attributes(attributes)
        name, above = f"{tag}.{label}", stack[-1]
        if not above.children or above.children[-1] != name:
            above.children.append(name)
            above.seen[name] += 1
        inside = above.main or tag in MAIN or main
        marked = marked or (tag in MARKED and not (tag == "header" and inside))
        stack.append(_Element(tag, label, _key(above.key, name, above.seen[name]), marked, tag in MAIN or main))
        if tag in ("main", "article"):
            stack[-1].marked = False
    flush()
    while len(stack) > 1:
        close()
    return texts, styles


def host_of(url: str | None) -> str:
    m = re.match(r"[^:]*://([^/?#]*)", url or "", re.DOTALL)
    return m[1].lower() if m else ""


def trees(pages: DataFrame) -> DataFrame:
    """(page_id, row, host, nodes, styles, owners, pieces): what each page brings to the tree of its host.

    `nodes` are the places with text that is not marked, in declared content or not. `styles` are pairs of node and child
    sequence, one after the other; `pieces` the hashes of the pieces of text and `owners` their nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
                texts, styles = parse(page.as_py() or "")
                kept = [(t, n) for t, n, marked, _ in texts if not marked]
                nodes = {n for _, n in kept}
                pieces = [(n, _key(piece.strip())) for t, n in kept for piece in _PIECE.findall(t)]
                pairs = [x for style in styles if style[0] in nodes for x in style]
                out.append((host_of(url.as_py()), list(nodes), pairs, [n for n, _ in pieces], [k for _, k in pieces]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("row"), pa.array(columns[0], pa.string()), *(pa.array(c, many) for c in columns[1:])],
                ["page_id", "row", "host", "nodes", "styles", "owners", "pieces"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in ("nodes", "styles", "owners", "pieces"))
    return pages.selectExpr("page_id", "url", "CAST(html AS STRING) AS html", f"{_ROW} AS row").mapInArrow(
        run, f"page_id {kind}, row bigint, host string, {lists}"
    )


def _texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, row, texts, nodes, main): text that is not marked, its node, and whether it lies in declared content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column("html"):
                kept = [(t, n, main) for t, n, marked, main in parse(page.as_py() or "")[0] if not marked]
                out.append(tuple(zip(*kept, strict=True)) or ((), (), ()))
            texts, nodes, main = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "row")), pa.array(texts, pa.list_(pa.string())),
                 pa.array(nodes, pa.list_(pa.int64())), pa.array(main, pa.list_(pa.bool_()))],
                ["page_id", "url", "row", "texts", "nodes", "main"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.selectExpr("page_id", "url", "CAST(html AS STRING) AS html", f"{_ROW} AS row").mapInArrow(
        run, f"page_id {kind}, url string, row bigint, texts array<string>, nodes array<bigint>, main array<boolean>"
    )


def statistics(trees: DataFrame) -> DataFrame:
    """(host, node, is_text, feature, n, weight): sums of occurrences c and of c ln c, of styles and of pieces of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[float]] = {}
            for host, styles, owners, pieces in zip(*(batch.column(c).to_pylist() for c in ("host", "styles", "owners", "pieces")), strict=True):
                here = Counter({(node, False, style): 1 for node, style in zip(styles[0::2], styles[1::2], strict=True)})
                here.update((node, True, piece) for node, piece in zip(owners, pieces, strict=True))
                for (node, is_text, feature), c in here.items():
                    held = sums.setdefault((host, node, is_text, feature), [0, 0.0])
                    held[0] += c
                    held[1] += c * log(c)
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64()))]
                + [pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64())],
                ["host", "node", "is_text", "feature", "n", "weight"],
            )

    rows = trees.select("host", "styles", "owners", "pieces").mapInArrow(
        run, "host string, node bigint, is_text boolean, feature bigint, n bigint, weight double"
    )
    return rows.groupBy("host", "node", "is_text", "feature").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def importance(sums: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content) of every node with text that is not marked."""
    found = sums.groupBy("host", "node").agg(
        F.expr("sum(IF(is_text, 0, n))").alias("pages"),
        F.expr("sum(IF(is_text, 0, n * ln(n)))").alias("styles"),
        F.expr("sum(IF(is_text, 1, 0))").alias("pieces"),
        F.expr("sum(IF(is_text, ln(n) - weight / n, 0))").alias("spread"),
    )
    return found.selectExpr(
        "host", "node", "pages", "IF(pages > 1, 1 - styles / (pages * ln(pages)), 1.0D) AS presentation",
        "IF(pages > 1 AND pieces > 0, 1 - least(1.0D, spread / pieces / ln(pages)), 1.0D) AS content",
    )


def extract(pages: DataFrame, least: float = LEAST, at_least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed, n_spared): main text, the blocks that the tree removed, and those it found unimportant
    but that stay as declared content."""
    # Parsed once for the tree, of which hashes are stored, and once for the text. What to cut is stored too: its size is known to
    # the join then, which moves the texts only if many pages have unimportant blocks.
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    trees(pages).write.parquet(f"{path}/pages")
    grown = spark.read.parquet(f"{path}/pages")
    low = importance(statistics(grown)).where(f"pages >= {at_least} AND greatest(presentation, content) < {least}").select("host", "node")
    found = (
        grown.select("page_id", "row", "host", F.explode("nodes").alias("node"))
        .join(low, ["host", "node"]).groupBy("page_id", "row").agg(F.collect_set("node").alias("cut"))  # of one page
    )
    found.selectExpr("page_id AS _id", "row AS _r", "cut").write.parquet(f"{path}/cuts")
    unimportant = "cut IS NOT NULL AND array_contains(cut, get(nodes, i))"
    cut = _texts(pages).join(spark.read.parquet(f"{path}/cuts"), F.expr("page_id <=> _id AND row = _r"), "left").selectExpr(
        "page_id", "url", "texts", f"filter(texts, (t, i) -> NOT ({unimportant}) OR get(main, i)) AS left_over",
        f"CAST(size(filter(texts, (t, i) -> {unimportant} AND get(main, i))) AS BIGINT) AS n_spared",
    )
    text = "array_join(IF(size(left_over) = 0, texts, left_over), '\\n\\n')"
    return cut.selectExpr(
        "page_id", "url", f"{text} AS text", f"CAST(length({text}) AS BIGINT) AS n_chars",
        "CAST(IF(size(left_over) = 0, 0, size(texts) - size(left_over)) AS BIGINT) AS n_removed", "n_spared",
    )
