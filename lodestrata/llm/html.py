"""HTML main-text extraction by host suffix arrays, guided by structure.

A page's markup gives its blocks of text, without what elements, roles and class names mark as boilerplate, and
without what is outside its article where it has one. The blocks that are left are decided by the host: the token streams of a
host's distinct pages are concatenated and put in suffix order by prefix doubling; an interval of suffixes with a long common
prefix is a repeated string, and one that more than a share of the host's pages have is boilerplate. Blocks that such
strings cover as a whole go, unique runs stay. On a page with an article the share must be larger.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import durable, slices
from lodestrata.llm.lines import few
from lodestrata.llm.tokens import grams, mixed, word_hashes

#: Tokens of a repeated string; with the marks of a page's edges, so a short block at an edge can be one.
RUN = 8
#: Distinct pages that have a repeated string at least, and the share of the host's distinct pages that it exceeds: on other pages, and on pages with an article.
PAGES, SHARE = 3, 0.1
SURE_PAGES, SURE_SHARE = 5, 0.5
#: Pages and bytes of markup from which a host's suffix array is made in shards.
SHARD_PAGES, SHARD_BYTES = 256, 16 << 20
#: Repeated strings up to which every task gets them all.
BROADCAST_RUNS = 2_000_000
EDGE = np.uint64(0x0ED6E0FA9A6E0ED6)

#: Markup: where it may begin, a tag's name, the rest of a tag with quoted values.
OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?[a-zA-Z]")
CLOSING = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
AWAY = frozenset("nav footer aside form menu dialog head fieldset noscript template iframe object svg canvas audio video select button".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
INLINE_OK = frozenset("html body main a span b i em strong u small sup sub code abbr cite q mark time label font".split())
#: Words of a class, id or role that mark boilerplate, what may follow them in a name, and what takes their meaning away.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo "
    "cookie cookies disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert".split()
)
HOLDERS = frozenset("area bar block bottom box button buttons container footer form header holder inner item items left link links list menu notice panel pane placeholder right section signup slot thread top unit widget wrap wrapper zone".split())
NEUTRAL = frozenset("has with no not without is content layout show hide toggle".split())
ARTICLE_MARKS = frozenset("ad ads advert advertisement comment comments promo promoted related reply sponsored".split())


def names_boilerplate(name: str, inside: bool) -> bool:
    """Whether a class or id name means boilerplate; inside an article long names don't."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if len(parts) <= 1:
        return bool(parts) and parts[0] in MARKS
    if parts[0] in NEUTRAL or inside and len(parts) > 2:
        return False
    return parts[-1] in MARKS or len(parts) == 2 and parts[0] in MARKS and parts[1] in HOLDERS


def marked(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element's attributes make it boilerplate."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, values = m[1].lower(), (m[2] or m[3] or m[4] or "").lower().split()
        if name == "hidden" or name == "aria-hidden" and "true" in values:
            return True
        if name == "role" and tag not in INLINE_OK and MARKS.intersection(values):
            return True
        if name in ("class", "id") and tag == "article" and ARTICLE_MARKS.intersection(values):
            return True
        if name in ("class", "id") and tag not in INLINE_OK and tag != "article" and any(names_boilerplate(v, inside) for v in values):
            return True
    return False


def main_role(attributes: str) -> bool:
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() == "main" for m in ATTRIBUTE.finditer(attributes)) if "role" in attributes.lower() else False


class Page:
    """The blocks of a page, in one pass: time in proportion to the page, whatever its markup."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.found: dict[str, list[str]] = {"article": [], "main": [], "": []}
        self.stack: list[tuple[str, str]] = []  # open elements and what each is: away, article, main or nothing
        self.open: Counter[str] = Counter()
        self.depth = {"away": 0, "article": 0, "main": 0, "": 0}
        self.forms = 0  # open forms that are away
        self.held: list[str] = []
        self.next_close: dict[str, int] = {}
        self.read()

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.held)).split())
        self.held.clear()
        if text:
            for kind in ("article", "main", ""):
                if self.depth[kind] or not kind:
                    self.found[kind].append(text)

    def hold(self, text: str) -> None:
        if not self.depth["away"]:
            self.held.append(text)

    def closes(self, tag: str, at: int) -> int:
        """Where the next end tag of ``tag`` starts, or the page's length."""
        if self.next_close.get(tag, -1) < at:
            m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(self.page, at)
            self.next_close[tag] = m.start() if m else len(self.page)
        return self.next_close[tag]

    def read(self) -> None:
        page, at, quotes = self.page, 0, True
        while m := OPENING.search(page, at):
            self.hold(page[at : m.start()])
            if m[0] in CLOSING:
                close = page.find(CLOSING[m[0]], m.end())
                at = len(page) if close < 0 else close + len(CLOSING[m[0]])
                continue
            name = NAME.match(page, m.start())
            rest = REST.match(page, name.end()) if quotes else None
            end = rest.end() - 1 if rest else page.find(">", name.end())
            quotes = rest is not None  # a quote that never ends: from here on quotes are plain characters
            if end < 0:  # a tag that never ends
                at = len(page)
                break
            at = end + 1
            if m[0][1] == "/":
                self.end(name[1].lower())
            else:
                at = self.start(name[1].lower(), page[name.end() : end], at)
        self.hold(page[at:])
        self.flush()

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not self.open[tag]:
            return
        while True:
            name, kind = self.stack.pop()
            self.depth[kind] -= 1
            self.open[name] -= 1
            self.forms -= name == "form" and kind == "away"
            if name == tag:
                return

    def start(self, tag: str, attributes: str, at: int) -> int:
        """Takes a start tag and returns where reading goes on."""
        alone = attributes.endswith("/")
        if tag in RAW and not alone:
            close = self.closes(tag, at)
            self.hold(" ")
            return close if close < len(self.page) or tag in ("script", "style") else at
        if tag in BLOCKS:
            self.flush()
        if tag in VOID or alone and tag not in BLOCKS:
            self.hold(" ")
            return at
        if tag in ("td", "th"):
            self.hold(" ")
        inside = self.depth["article"] > 0
        kind = ""
        if tag in AWAY:
            kind = "away" if self.closes(tag, at) < len(self.page) else ""
        elif tag == "header" and not inside or marked(tag, attributes, inside):
            kind = "away"
        elif tag == "article":
            kind = "article"
        elif tag == "main" or main_role(attributes):
            kind = "main"
        if kind in ("article", "main") and 0 < self.depth["away"] == self.forms:  # a form around the whole page
            self.stack = [(n, "" if k == "away" else k) for n, k in self.stack]
            self.depth[""] += self.forms
            self.depth["away"] = self.forms = 0
        self.stack.append((tag, kind))
        self.forms += tag == "form" and kind == "away"
        self.open[tag] += 1
        self.depth[kind] += 1
        return at


def blocks(page: str) -> tuple[bool, list[str]]:
    """(whether the page has an article, the blocks): the articles' if they have half of main's words, or else main's, or else all that isn't marked as boilerplate."""
    found = Page(page).found
    words = {kind: sum(x.count(" ") + 1 for x in own) for kind, own in found.items()}
    if words["main"] and 2 * words["article"] < words["main"]:
        return True, found["main"]
    if words["article"]:
        return True, found["article"]
    return False, found[""]


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def streams(texts: pa.Array, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of pages with RUN - 1 marks at either edge, the page of each, and the text (a block or a whole page) of each, -1 for marks.

    ``page`` says for each text to which page it belongs, ascending.
    """
    h, rows = word_hashes(texts)
    own = page[rows] if len(rows) else rows
    there, first = np.unique(own, return_index=True)
    last = np.append(first[1:], len(own))[: len(there)]
    at = np.concatenate((np.repeat(first, RUN - 1), np.repeat(last, RUN - 1)))
    who = np.concatenate((np.repeat(there, RUN - 1), np.repeat(there, RUN - 1)))
    order = np.argsort(np.concatenate((np.repeat(2 * there, RUN - 1), np.repeat(2 * there + 1, RUN - 1))), kind="stable")
    at, who = at[order], who[order]
    return np.insert(h, at, EDGE), np.insert(own, at, who), np.insert(rows, at, -1)


def suffix_ranks(h: np.ndarray, page: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix of the concatenated streams in the order of its first ``depth`` tokens (a power of two); suffixes end with their page."""
    rank = np.unique(h, return_inverse=True)[1] + 1
    size, n = 1, len(h)
    while size < depth:
        far = np.zeros(n, np.int64)
        far[: n - size] = np.where(page[size:] == page[: n - size], rank[size:], 0)
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + far, return_inverse=True)[1] + 1
        size *= 2
    return rank


def repeated_runs(texts: list[str], share: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(distinct pages, hashes, pages): the strings of RUN tokens that two distinct pages at least, and more than ``share`` of them, have.

    They are the intervals of the suffix array whose suffixes have a common prefix of RUN tokens.
    """
    own = list(dict.fromkeys(texts))
    h, page, _ = streams(pa.array(own, pa.string()), np.arange(len(own)))
    hashes, at = grams(h, page, RUN)
    if not len(at):
        return len(own), hashes, at
    rank = suffix_ranks(h, page, RUN)[at]
    pairs = np.unique(rank * len(own) + page[at])
    pages = np.bincount(pairs // len(own), minlength=int(rank.max()) + 1)
    _, first = np.unique(rank, return_index=True)
    n = pages[rank[first]]
    on = (n >= 2) & (n > share * len(own))
    return len(own), hashes[first][on], n[on]


def keyed(runs: np.ndarray, host: np.ndarray | int) -> np.ndarray:
    """Hashes of strings of a host."""
    return mixed(runs ^ mixed(np.atleast_1d(np.asarray(host, dtype=np.int64)).view(np.uint64)))


def host_runs(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """``host, key, often``: hashes of the strings that ``least`` distinct pages and more than ``share`` of the host's have; ``often``: so many
    that they count on pages with an article too.

    ``pages`` has ``host`` (a hash), ``shards`` and ``html``. Equal pages meet in one shard and count once. A string
    is counted in the shards in which more than half the share of pages have it, so each shard sends on a bounded list.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = ["\n".join(blocks(x or "")[1]) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("shards"), pa.array(texts, pa.string())], names=["host", "shards", "text"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        group: tuple[int, int] | None = None

        def done() -> pa.RecordBatch:
            n, runs, pages = repeated_runs(held, share / 2)
            keys = [*keyed(runs, group[0]).view(np.int64).tolist(), None]  # the last row has the shard's pages
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array([*pages.tolist(), n], pa.int64())], names=["host", "key", "pages"])

        for batch in batches:
            for own in zip(*(batch.column(c).to_pylist() for c in ("host", "shard", "text")), strict=True):
                if group is not None and own[:2] != group:
                    yield done()
                    held.clear()
                group = own[:2]
                held.append(own[2])
        if group is not None:
            yield done()

    dealt = pages.select("host", "shards", "html").mapInArrow(parsed, "host long, shards int, text string").where("text <> ''")
    dealt = dealt.select("host", F.pmod(F.xxhash64("text"), "shards").cast("int").alias("shard"), "text").repartition("host", "shard").sortWithinPartitions("host", "shard")
    found = durable(dealt.mapInArrow(arrays, "host long, key long, pages long").groupBy("host", "key").agg(F.sum("pages").alias("pages")))
    totals = found.where("key is null").select("host", F.col("pages").alias("total"))
    runs = found.where("key is not null").join(F.broadcast(totals) if few(totals) else totals, "host")
    often = (F.col("pages") >= SURE_PAGES) & (F.col("pages") > SURE_SHARE * F.col("total"))
    return runs.where((F.col("pages") >= least) & (F.col("pages") > share * F.col("total"))).select("host", "key", often.alias("often"))


def without_runs(sure: list[bool], own: list[list[str]], host: np.ndarray, keys: np.ndarray, often: np.ndarray) -> list[list[str]]:
    """Each page's blocks without those that the host's repeated strings cover as a whole; a page of which nothing would be left stays.

    ``keys`` are sorted; ``often`` says which of them count on pages with an article.
    """
    sizes = np.array([len(b) for b in own], dtype=np.int64)
    page = np.repeat(np.arange(len(own)), sizes)
    flat = [x for b in own for x in b]
    h, of_page, block = streams(pa.array(flat, pa.string()), page)
    runs, at = grams(h, of_page, RUN)
    if not len(at) or not len(keys):
        return own
    key = keyed(runs, host[of_page[at]])
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = (keys[place] == key) & (often[place] | ~np.array(sure)[of_page[at]])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + RUN, -1)
    covered = (np.cumsum(edge)[:-1] > 0) & (block >= 0)
    gone = (np.bincount(block[covered], minlength=len(flat)) == np.bincount(block[block >= 0], minlength=len(flat))).tolist()
    ends = np.cumsum(sizes).tolist()
    return [[x for x, out in zip(b, gone[e - len(b) : e], strict=True) if not out] or b for b, e in zip(own, ends, strict=True)]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """``page_id, url, text``: the main text of every page, blocks joined by a line feed.

    Null html: the empty text. Null url: the host ''. Null ids and repeated rows are pages of their own, but
    pages of a host with the same text count once, so copies never make each other boilerplate. Other columns are ignored. No rows give no rows. A page's
    markup may be of any length and need not be well formed.

    Markup is parsed twice, for the suffix arrays and for the result; only the first time texts are shuffled, by host and shard. A host's
    repeated strings are at most as many as a page has tokens, divided by the share, whatever its size.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).withColumn("host", F.xxhash64(host_of("url")))
    sizes = source.groupBy("host").agg(F.greatest(F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.sum(F.octet_length("html")) / SHARD_BYTES)).cast("int").alias("shards")).where("shards > 1")
    sizes = durable(sizes)
    dealt = source.join(F.broadcast(sizes) if few(sizes) else sizes, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    runs = durable(host_runs(dealt, share, least))
    kind = dict(source.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string"
    small = few(runs, BROADCAST_RUNS)
    if small:
        own = runs.select("key", "often").toPandas().sort_values("key")
        key = own["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        sent = pages.sparkSession.sparkContext.broadcast((key[order], own["often"].to_numpy(bool)[order]))
    else:
        lists = runs.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("key", "often"))).alias("runs"))
        source = source.join(lists, "host", "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                sure, own = zip(*(blocks(x or "") for x in part.column("html").to_pylist()), strict=True)
                host = np.asarray(part.column("host"), dtype=np.int64)
                if small:
                    keys, often = sent.value
                else:
                    rows = {h: i for i, h in enumerate(host.tolist())}.values()
                    every = [x for i in rows for x in part.column("runs")[i].as_py() or ()]
                    keys = np.array([x["key"] for x in every], dtype=np.int64).view(np.uint64)
                    order = np.argsort(keys)
                    keys, often = keys[order], np.array([x["often"] for x in every], dtype=bool)[order]
                texts = ["\n".join(b) for b in without_runs(list(sure), list(own), host, keys, often)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return source.mapInArrow(kept, schema)
