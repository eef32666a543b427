"""Main text of web pages: subtrees that recur on many pages of a host are its template and go.

Every page is parsed once into a tree. Spark counts, per host and over its distinct pages, two hashes of each
element subtree: of its content, and of its shape (the path of tags, classes and ids, its *slot*).

* A slot that holds one element a page and most of the host's text is the article (ties: an article or main
  element with a tenth of the text wins). What lies outside it is left out.
* A slot on half of the pages is template if it holds a quarter of the host's text at most, or is mostly
  links (`LINKS` a page or more; such slots go inside the article too). So furniture whose words differ from
  page to page is found as well. The holder of a page's only h1 stays. Headings, paragraphs, quotes, lists and
  tables without a name are running text, not furniture: outside the article only their links or their contents
  make them template, inside it only their contents, and none of them is taken for the article itself.
* A content on `MIN_PAGES` pages and half of the host's is template outside the article; inside, where
  passages are quoted, it takes `INNER_PAGES` and `INNER_SHARE` of the pages.

What counting cannot see (hosts of few pages, a widget on a few pages) is decided by the meaning of elements
and of class, id and role words. Of a compound name the head decides (`site-footer-wrapper` is a footer, `share-price`
and `has-sidebar` are none). Inside an article only whole names and words for reader comments count; a header there
is the article's own, and what is named a menu, share bar, search or related matter goes only if half of its text
is links. Where the counts would leave nothing, only these rules are applied. `lists=False` switches the class, id
and role words off.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed,
empty ones dropped, and the rest joined in page order by one newline. A line break element ends a block.

Rules: null html is empty html and gives empty text; a null or odd url has the host it parses to, else the
empty host; unclosed and stray tags are tolerated, and a tag whose quotes swallow the rest of the page ends
at its next `>` (after `STRIKES` such tags quotes no longer count); repeated rows get a row each (equal pages
of a host count once); other columns are ignored; empty in, empty out. Parsing takes time and memory in
proportion to a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, table

MIN_PAGES, SHARE, INNER_PAGES, INNER_SHARE = 5, 0.5, 20, 0.8
SMALL, LINKS, STRIKES = 0.25, 3, 16

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""["'>]""")
_ATTR = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements by their part in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROP = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea title head dialog audio video menu noembed noframes xmp".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "body": ("head", "p"), "option": ("p",)}
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol li dl dt dd pre figure figcaption".split())
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
_COMMENTS = frozenset("comment comments disqus replies respond responses".split())
_WORDS = _COMMENTS | frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login share sharing social related recommended skip pagination pager search toolbar".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Names that an article's own parts have too (such an element goes if it is links), its header's names,
#: words that name a part of what stands before them, and words that say the opposite.
_LINKED = frozenset("menu pager pagination recommended related search share sharing skip social toolbar".split())
_TITLED = frozenset("header masthead".split())
_PARTS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content form group holder icon icons inner item items label left link links list main media outer panel post posts right row section slot space stories story text title to top unit wrap wrapper zone".split()
)
_NOT = frozenset("has no non with without".split())
_BODY = ("", "html", "body")


def _furniture(name: str) -> bool:
    """Whether the head of a class name or id, trailing words for parts aside, is a word for furniture."""
    words = [w for w in (x.rstrip("0123456789") for x in re.split(r"[^a-z0-9]+", name)) if w.isalpha()]
    while len(words) > 1 and words[-1] in _PARTS:
        words.pop()
    return bool(words) and words[0] not in _NOT and words[-1] in _WORDS


def _chrome(tag: str, attrs: list[tuple[str, str]], inside: bool) -> tuple[bool, bool]:
    """Whether an element's attributes say that it is furniture, and whether only if it is links (inside an article)."""
    linked = False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
            return True, False
        if name in ("class", "id"):
            names = value.split()
            said = set(re.split(r"[^a-z]+", value))
            if tag == "p" or tag in _INLINE:
                said.discard("comment")  # a remark; readers' comments are larger elements
                names = [n for n in names if n != "comment"]
            if said & _COMMENTS and not said & _NOT:
                return True, False
            if not inside and tag not in ("article", "main"):
                if any(map(_furniture, names)):
                    return True, False
                continue
            hit = _WORDS.intersection(names)
            if inside:
                linked |= bool(hit & _LINKED)
                hit = hit - _LINKED - _TITLED
            if hit:
                return True, False
    return False, linked


class _Node:
    __slots__ = ("tag", "up", "block", "article", "main", "link", "drop", "faint", "hash", "slot", "chars", "linked", "links", "at", "depth", "kind")

    def __init__(self, tag: str, up: _Node | None, attrs: str, lists: bool):
        found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs)] if attrs else []
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        inside = up is not None and up.article
        chrome, self.faint = _chrome(tag, found, inside) if lists and tag not in _BODY and found else (False, False)
        self.drop = (up is not None and up.drop) or tag in _DROP or (tag == "header" and not inside) or chrome
        self.main = tag in ("article", "main") and not self.drop
        self.article = inside or self.main
        self.link = tag == "a" or (up is not None and up.link)
        self.block = up.block if tag in _INLINE and up is not None else self
        self.hash = xxhash.xxh64(f"<{tag}{attrs.strip()}>".encode("utf-8", "replace"))
        self.chars = self.linked = self.links = 0
        self.at = -1
        self.kind = 0
        if self.block is self:
            plain = not any(k in ("class", "id") for k, v in found)
            self.kind = 2 if tag == "h1" and not self.drop else 1 if self.main else 3 if plain and (tag in _FLOW or tag in _TABLE) else 0
            look = " ".join(re.sub(r"\d+", "", v) for k, v in found if k in ("class", "id"))
            self.slot = xxhash.xxh64_intdigest(f"{up.block.slot if up else 0}<{tag} {look}>".encode("utf-8", "replace")) >> 1


class Page:
    """blocks: (text, element, dropped by a rule); elements with text in page order: their parents, content hashes, slots, and kinds (1 article, 2 h1, 3 running text without a name); slots: what they hold."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, bool]] = []
        self.up: list[int] = []
        self.hash: list[int] = []
        self.slot: list[int] = []
        self.kind: list[int] = []
        self.slots: dict[int, list[int]] = {}


def parse(page: str | None, lists: bool = True) -> Page:
    page = page or ""
    blocks: list[tuple[str, _Node, bool]] = []
    root = top = _Node("", None, "", lists)
    made, open_ = [root], dict.fromkeys(("",), 1)
    words: list[str] = []
    owner, dropped = root, False
    at, n, last, strikes = 0, len(page), page.rfind(">"), 0

    def flush() -> None:
        nonlocal words
        if words and (said := " ".join("".join(words).split())):
            blocks.append((said, owner, dropped))
        words = []

    def close(node: _Node) -> _Node:
        """Ends a node: its hash and sums become part of the one above."""
        if node.block is node:
            flush()
        open_[node.tag] -= 1
        up = node.up
        up.hash.update(node.hash.digest())
        up.chars, up.linked, up.links = up.chars + node.chars, up.linked + node.linked, up.links + node.links
        return up

    def text(raw: str) -> None:
        nonlocal owner, dropped
        if not raw:
            return
        top.hash.update(raw.encode("utf-8", "replace"))
        size = len(raw) - raw.count(" ")
        top.chars += size
        top.linked += size * top.link
        if words and dropped != top.drop:
            flush()  # an inline element that is dropped ends what is not, and the other way round
        if not words:
            owner, dropped = top.block, top.drop
        words.append(html.unescape(raw) if "&" in raw else raw)

    def tag_end(i: int) -> int:
        """Position after the tag's `>`; quoted ones do not count."""
        nonlocal strikes
        first = page.find(">", i)
        if strikes >= STRIKES:
            return first + 1
        while m := _STOP.search(page, i):
            if m[0] == ">":
                return m.end()
            close_ = page.find(m[0], m.end())
            i = close_ + 1 if close_ >= 0 else m.end()
        strikes += 1
        return first + 1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if page.startswith("<!--", lt):
            text(page[at:lt])
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            text(page[at:lt])
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = _NAME.match(page, lt + 1)
        if m is None or lt > last:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = tag_end(m.end())
        tag = m[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if open_.get(tag, 0) > 0:
                while True:
                    ended, top = top, close(top)
                    if ended.tag == tag:
                        break
            continue
        if tag in _CLOSES_P or tag in _ENDS:
            ends = _ENDS.get(tag, ("p",))
            while top.block.tag in ends:
                ended = top.block
                while top is not ended:
                    top = close(top)
                top = close(top)
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            top.hash.update(tag.encode())
            continue
        top = _Node(tag, top, page[m.end() : at - 1], lists)
        top.links = tag == "a"
        made.append(top)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            top.hash.update(page[at:stop].encode("utf-8", "replace"))
            at = stop
    while top.up is not None:
        top = close(top)
    flush()
    out = Page()
    for x in made:
        if x.block is x and x.chars:
            x.at = len(out.up)
            out.up.append(x.up.block.at if x.up is not None else -1)
            out.hash.append(x.hash.intdigest() - (1 << 63))
            out.slot.append(x.slot)
            out.kind.append(x.kind)
            own = out.slots.setdefault(x.slot, [x.depth, int(x.main), int(x.tag in _BODY), 0, 0, 0, 0, int(x.tag in _FLOW)])
            for k, v in enumerate((1, x.chars, x.linked, x.links), 3):
                own[k] += v
    for x in made:  # those above come first
        if x.block is x:
            x.faint = (x.faint and 2 * x.linked >= x.chars) or (x.up is not None and x.up.block.faint)
    out.blocks = [(said, x.at, drop or x.faint) for said, x, drop in blocks if x.at >= 0]
    return out


def choose(blocks, up, hashes, slots, kind, main, small, menus, outer, inner) -> list[str]:
    """The texts that stay of a page, given its host's template (main: the article's slot; the others are sets)."""
    n = len(up)
    is_main = [s == main if main else k == 1 for s, k in zip(slots, kind)]
    holds, title, inside, gone = is_main[:], [k == 2 for k in kind], [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        if up[i] >= 0:
            holds[up[i]] |= holds[i]
            title[up[i]] |= title[i]
    for i in range(n):
        inside[i] = is_main[i] or (up[i] >= 0 and inside[up[i]])
    own_title = any(t and inside[i] for i, t in enumerate(title))
    for i in range(n):
        spared = holds[i] or (title[i] and not own_title and not inside[i])
        if inside[i]:
            by_slot = not spared and kind[i] != 3 and slots[i] in menus
        else:
            by_slot = not spared and slots[i] in (menus if kind[i] == 3 else small)
        by_content = not holds[i] and hashes[i] in (inner if inside[i] else outer)
        gone[i] = by_slot or by_content or (up[i] >= 0 and gone[up[i]])
    within = any(inside[i] for _, i, drop in blocks if not drop)
    own = [(t, i) for t, i, drop in blocks if not drop and (not within or inside[i] or (kind[i] == 2 and not own_title))]
    return [t for t, i in own if not gone[i]] or [t for t, _ in own]


_PARSED = """page_id long, url string, page long, blocks array<struct<text:string,at:int,drop:boolean>>, up array<int>, hash array<long>, slot array<long>, kind array<int>,
slots array<struct<slot:long,depth:int,main:int,top:int,n:int,chars:long,linked:long,links:int,flow:int>>"""
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("drop", pa.bool_())]))
_SLOTS = pa.list_(pa.struct([("slot", pa.int64()), ("depth", pa.int32()), ("main", pa.int32()), ("top", pa.int32()), ("n", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64()), ("links", pa.int32()), ("flow", pa.int32())]))


def trees(pages: DataFrame, id_col: str, url_col: str, html_col: str, lists: bool) -> DataFrame:
    """The parsed pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 1 << 20):
            texts = b.column("html").to_pylist()
            got = [parse(t, lists) for t in texts]
            same = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "replace")) - (1 << 63) for t in texts]
            blocks = [[dict(zip(("text", "at", "drop"), x)) for x in p.blocks] for p in got]
            slots = [[dict(zip(("slot", "depth", "main", "top", "n", "chars", "linked", "links", "flow"), (s, *v))) for s, v in p.slots.items()] for p in got]
            lists_ = [pa.array([getattr(p, k) for p in got], pa.list_(t)) for k, t in (("up", pa.int32()), ("hash", pa.int64()), ("slot", pa.int64()), ("kind", pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(same, pa.int64()), pa.array(blocks, _BLOCKS), *lists_, pa.array(slots, _SLOTS)], ["page_id", "url", "page", "blocks", "up", "hash", "slot", "kind", "slots"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, _PARSED)


def templates(rows: DataFrame, min_pages: int, share: float, inner_pages: int, inner_share: float) -> DataFrame:
    """(of, main, small, menus, outer, inner) of each host of rows (row, host, page, hash, slots).

    The lists are bounded by a page's elements over the share that a template needs.
    """
    first = rows.groupBy("host", "page").agg(F.min("row").alias("row"))
    once = rows.select("row", "host", "hash", "slots").join(first.select("row"), "row", "left_semi")
    slot = once.select("host", F.explode("slots").alias("s")).groupBy("host", "s.slot").agg(
        F.count("*").alias("pages"), F.max("s.depth").alias("depth"), F.max("s.main").alias("main"), F.max("s.top").alias("top"), F.max("s.flow").alias("flow"), F.sum("s.n").alias("n"), F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"), F.sum("s.links").alias("links")
    )
    total = once.groupBy("host").agg(F.count("*").alias("all"), F.sum(F.expr("aggregate(slots, 0L, (m, s) -> greatest(m, s.chars))")).alias("text"))
    slot = slot.join(total.withColumnRenamed("host", "of"), F.col("host") == F.col("of")).where((F.col("all") >= min_pages) & (F.col("pages") >= share * F.col("all")))
    part = F.col("chars") / F.greatest("text", F.lit(1))
    likely = (F.col("n") <= 1.2 * F.col("pages")) & (F.col("top") == 0) & (F.col("flow") == 0) & F.when(F.col("main") == 1, part >= 0.1).otherwise(part >= 0.5)
    menu = (F.col("linked") >= 0.5 * F.col("chars")) & (F.col("links") >= LINKS * F.col("pages"))
    by_slot = slot.groupBy("host").agg(
        F.max(F.when(likely, F.struct("main", F.when(F.col("main") == 1, part).otherwise(F.col("depth")).alias("by"), F.col("slot")))).alias("best"),
        F.collect_set(F.when((F.col("top") == 0) & ((part <= SMALL) | menu), F.col("slot"))).alias("small"),
        F.collect_set(F.when((F.col("top") == 0) & menu, F.col("slot"))).alias("menus"),
    )
    seen = once.select("host", F.explode(F.array_distinct("hash")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    seen = seen.join(total.select(F.col("host").alias("of"), "all"), F.col("host") == F.col("of")).where(F.col("n") >= share * F.col("all"))
    by_content = seen.groupBy("host").agg(F.collect_set("h").alias("outer"), F.collect_set(F.when((F.col("n") >= inner_pages) & (F.col("n") >= inner_share * F.col("all")), F.col("h"))).alias("inner"))
    both = by_slot.join(by_content, "host", "full")
    return both.select(F.col("host").alias("of"), F.coalesce("best.slot", F.lit(0)).alias("main"), "small", "menus", "outer", "inner")


def main_text(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    share: float = SHARE,
    inner_pages: int = INNER_PAGES,
    inner_share: float = INNER_SHARE,
    lists: bool = True,
) -> DataFrame:
    """(page_id, url, text) of every row."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = materialize(trees(pages, id_col, url_col, html_col, lists).withColumn("host", host).withColumn("row", F.monotonically_increasing_id()))
    # a table, so that its size decides how the texts meet it
    known = materialize(templates(rows, min_pages, share, inner_pages, inner_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("main", "small", "menus", "outer", "inner")
        held: dict[str, tuple] = {}
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("host", "blocks", "up", "hash", "slot", "kind")]
            out = []
            for i, (of, blocks, *page) in enumerate(zip(*cols)):
                if of not in held:
                    held = {of: tuple(v if k == "main" else frozenset(v or ()) for k in names for v in (b.column(k)[i].as_py(),))}
                out.append("\n".join(choose([(x["text"], x["at"], x["drop"]) for x in blocks], *page, *held[of])))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    full = rows.join(known, F.col("host") == F.col("of"), "left")
    return full.select("page_id", "url", "host", "blocks", "up", "hash", "slot", "kind", "main", "small", "menus", "outer", "inner").mapInArrow(run, "page_id long, url string, text string")


def op6(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
