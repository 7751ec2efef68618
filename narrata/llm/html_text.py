"""Main text of web pages: blocks that markup proposes, judged by the suffix array of their host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import releasing, slices, staged, texts_of

OPENING = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name up to its end; possessive, so that a quote which doesn't end is found in one pass.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME = re.compile(r"[a-z0-9]+")

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold the article.
DROPPED = frozenset("head nav footer aside form button select textarea dialog menu script style noscript template iframe svg object canvas audio video".split())
#: Words of a class, id or role that mark menus, notices, adverts, side matter and reader comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal"
    " overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies"
    " share sharing social related recommended widget toolbar pagination pager login search skip contentinfo complementary dialog".split()
)
#: Words that may stand beside a mark in one name (site-footer, cookie-box); with any other word (related-work) the name leaves
#: what it holds to the host's repeats. Numbers say nothing either (sidebar-1, banner-v2).
BESIDE = frozenset(
    "site page main global top bottom left right box bar block list item items links link icons icon buttons button wrapper wrap container inner outer area section"
    " group row col panel slot unit header head body content text posts post articles stories primary secondary form thread feed message"
    " article entry reader readers user users inline label google sticky floating fixed mobile desktop".split()
)
NUMBER = re.compile(r"v?\d+")
#: These mark a page's head only outside the article.
PAGE_MARKS = frozenset("header".split())
#: Elements of emphasis and the like, whose names mark nothing.
PHRASES = frozenset("a b i em strong mark small code q cite abbr time sub sup u s kbd var dfn".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open paragraph, and those that a search for one to end doesn't leave.
ENDS_P = BLOCK - frozenset("body br caption dd dt head html legend li option tbody td tfoot th thead title tr".split()) | frozenset(["li", "dd", "dt"])
P_SCOPE = frozenset("body html table td th caption button object template".split())
#: Elements that end an open one of their kind, up to where.
ENDS_OWN = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset("ul ol menu".split()))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["option"], (frozenset(["option"]), frozenset(["select", "datalist"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["table", "tr"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr"]), frozenset(["table"]))),
}


def mark_in(name: str, marks: frozenset[str]) -> str:
    """"sure" if one of the names in an attribute is a mark, alone or with words that say nothing else; "doubtful" if one holds a
    mark among other words; else empty."""
    found = ""
    for token in name.lower().split():
        words = {w for w in NAME.findall(token) if not NUMBER.fullmatch(w)}
        if words & marks:
            if words <= marks | BESIDE:
                return "sure"
            found = "doubtful"
    return found


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(raw)}


class _Page:
    """The blocks of a page, collected while its tags open and close elements."""

    def __init__(self) -> None:
        self.article: list[str] = []
        self.doubts: list[bool] = []  # of each block of the article: whether it stands in an element of a doubtful name
        self.silent: list[str] = []
        self.side: list[str] = []
        self.pieces: list[str] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, dropped, in the article, doubtful
        self.places: dict[str, list[int]] = {}  # where in `open` the elements of each name stand
        self.heads: list[list[int]] = []  # of open headers in the article: their depth, the article's blocks so far, headings
        self.marked = self.dropped = self.inside = self.doubtful = False

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                (self.side if self.dropped else self.article if self.inside else self.silent).append(text)
                if self.inside and not self.dropped:
                    self.doubts.append(self.doubtful)

    def enter(self, dropped: bool, inside: bool, doubtful: bool) -> None:
        if (dropped, inside, doubtful) != (self.dropped, self.inside, self.doubtful):
            self.flush()
        self.dropped, self.inside, self.doubtful = dropped, inside, doubtful

    def close_to(self, depth: int) -> None:
        """Ends all open elements from this depth on."""
        while self.heads and self.heads[-1][0] >= depth:
            _, start, headings = self.heads.pop()
            self.flush()
            if not headings:  # the head of a site, not of the article
                self.side += self.article[start:]
                del self.article[start:], self.doubts[start:]
        for name, *_ in self.open[depth:]:
            self.places[name].pop()
        del self.open[depth:]
        _, dropped, inside, doubtful = self.open[-1] if self.open else ("", False, False, False)
        self.enter(dropped, inside, doubtful)

    def close_nearest(self, names: frozenset[str], scope: frozenset[str]) -> None:
        last = lambda of: max((self.places[n][-1] for n in of if self.places.get(n)), default=-1)
        i = last(names)
        if i >= 0 and i >= last(scope):
            self.close_to(i)

    def start(self, name: str, raw: str) -> None:
        if name in ENDS_P:
            self.close_nearest(frozenset(["p"]), P_SCOPE)
        if name in ENDS_OWN:
            self.close_nearest(*ENDS_OWN[name])
        drop, inside, doubtful = self.dropped or name in DROPPED, self.inside, self.doubtful
        if not drop and raw and name not in ("html", "body"):
            given = attributes(raw)
            named = [given[k] for k in ("class", "id", "role") if k in given]
            if name != "main" and name not in PHRASES:
                marks = {mark_in(n, MARKS) for n in named}
                drop = "sure" in marks or not inside and any(mark_in(n, PAGE_MARKS) == "sure" for n in named)
                doubtful = doubtful or "doubtful" in marks and name != "article"
            drop = drop or "hidden" in given or given.get("aria-hidden") == "true"
            inside = inside or not drop and (given.get("role") == "main" or given.get("itemprop") == "articleBody")
        if name == "header" and not inside:
            drop = True
        if name in ("article", "main") and not drop:
            inside = True
        self.enter(drop, inside, doubtful)
        self.marked = self.marked or inside and not drop
        if name == "header" and inside and not drop:
            self.heads.append([len(self.open), len(self.article), 0])
        elif name in HEADINGS and self.heads:
            self.heads[-1][2] += 1
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, drop, inside, doubtful))

    def end(self, name: str) -> None:
        if self.places.get(name):
            self.close_to(self.places[name][-1])


def parse(page: str) -> tuple[list[str], list[str], list[str], bool, list[bool]]:
    """(article blocks, blocks that no markup assigns, blocks of menus and the like, whether the page marks an article, for
    each article block whether it stands in an element whose name holds a mark among other words).

    A block is the text between two block-level tags with its character references decoded and its white space as
    single blanks. An element lasts until its end tag, that of an element around it, or a tag that ends it unsaid, as that
    of the next paragraph or list item does. A header in the article belongs to it if it holds a heading. Time grows with
    the page's length, whatever it holds.
    """
    found = _Page()
    at, last = 0, page.rfind(">")
    while at < len(page):
        i = page.find("<", at)
        if i < 0 or i > last and not page.startswith("<!--", i):
            found.pieces.append(entities.unescape(page[at:]))
            break
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            end, tag = j + 3 if j >= 0 else len(page), None
        elif page.startswith(("<!", "<?"), i):
            end, tag = page.find(">", i) + 1, None
        elif (tag := OPENING.match(page, i + 1)) is None:  # a sign in the text
            found.pieces.append(entities.unescape(page[at : i + 1]))
            at = i + 1
            continue
        else:
            rest = REST.match(page, tag.end())
            end = rest.end() if rest else page.find(">", tag.end()) + 1
        if i > at:
            found.pieces.append(entities.unescape(page[at:i]))
        at = end
        if tag is None:
            continue
        name = tag[2].lower()
        if name in BLOCK:
            found.flush()
        if tag[1]:
            found.end(name)
        elif name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name not in VOID:
            found.start(name, page[tag.end() : end - 1])
        elif name in ENDS_P:
            found.close_nearest(frozenset(["p"]), P_SCOPE)
    found.flush()
    found.close_to(0)
    return found.article, found.silent, found.side, found.marked, found.doubts


def host_of(url: str) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower() if m else ""


BREAK = "\x00"
#: Bytes of text whose suffixes one step holds at once: a word of some six bytes has a suffix of some two hundred in Python.
SUFFIX_BYTES = 1_000_000


def stream(blocks: list[str]) -> list[str]:
    """The words of the blocks, each block closed by a break."""
    return [w for b in blocks for w in (*b.split(), BREAK)]


def open_suffixes(host: bytes, tokens: list[str], depth: int) -> list[bytes]:
    """The suffixes of a stream that have `depth` tokens, as far as they are compared: the digest of the host and 32 bits of
    each of those tokens, whose bytes sort by host and then token by token."""
    ids = b"".join(map(xxhash.xxh32_digest, tokens))
    return [host + ids[i : i + 4 * depth] for i in range(0, 4 * (len(tokens) - depth + 1), 4)]


def block_suffixes(host: bytes, blocks: list[str], others: set[int], depth: int) -> list[tuple[int, bytes]]:
    """(number, suffix) of the blocks of an article but for those numbered in others, and for shorter ones than `depth`. The suffix
    begins at the block and is compared to the block's end: behind its first tokens the rest stands as one name."""
    out = []
    for k, block in enumerate(blocks):
        tokens = block.split(" ", depth)
        if len(tokens) >= depth and k not in others:
            out.append((k, host + b"".join(map(xxhash.xxh32_digest, tokens[:depth])) + xxhash.xxh64_digest(block)))
    return out


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suffix, pages) of each interval of a sorted run of suffixes whose neighbours agree as far as they are compared, with
    the number of different pages in it, if that is two at least. The intervals at the run's two ends, which may go on in
    other runs, are given whatever they hold."""
    open_key, open_page, n, first = None, None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, pages = batch.column(0), batch.column(1).to_numpy()
        new_key, new_page = np.ones(len(pages), bool), np.ones(len(pages), bool)
        new_key[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(pages) - 1)).to_numpy(zero_copy_only=False)
        new_key[0] = keys[0].as_py() != open_key
        new_page[1:] = new_key[1:] | (pages[1:] != pages[:-1])
        new_page[0] = new_key[0] or pages[0] != open_page
        seen = np.concatenate([[0], np.cumsum(new_page)])
        starts = np.flatnonzero(new_key)
        found, counts = [], []
        if len(starts):
            n += int(seen[starts[0]])
            if open_key is not None and (first or n > 1):
                found, counts = [open_key], [n]
            first = first and open_key is None and len(starts) == 1
            sizes = np.diff(seen[starts])
            inner = sizes > 1
            if open_key is None and len(sizes):
                inner[0] = True
            at = np.flatnonzero(inner)
            found += keys.take(pa.array(starts[:-1][at])).to_pylist()
            counts += sizes[at].tolist()
            n, open_key = int(seen[-1] - seen[starts[-1]]), keys[int(starts[-1])].as_py()
        else:
            n += int(seen[-1])
        open_page = pages[-1]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(counts, pa.int64())], names=["suffix", "pages"])
    if open_key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_key], pa.binary()), pa.array([n], pa.int64())], names=["suffix", "pages"])


def gone_blocks(lengths: list[int], open_: list[int], covered: set[int]) -> list[int]:
    """The numbers of the open blocks that covered positions of the stream take up whole."""
    ends = np.cumsum([n + 1 for n in lengths]).tolist()
    return [k for k in open_ if all(i in covered for i in range(ends[k] - lengths[k] - 1, ends[k] - 1))]


def content_digest(article: list[str], silent: list[str], marked: bool) -> int:
    """What a page is about: its article, or without one the longest block that no markup assigns."""
    text = " ".join(article) if marked else max(silent, key=lambda b: (len(b), b), default="")
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def main_text(pages: DataFrame, depth: int = 8, share: float = 0.8, least: int = 10, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, marked) per row of pages; marked tells whether markup named the article.

    Markup proposes a page's blocks: its article, where it names one, else those that it leaves unassigned. Which of them stay
    is told by the suffix array of the page's host. It holds the suffixes of the token streams outside articles, and of whole
    articles that hold a block of a doubtful name (a mark of menus or notices among other words), at every token, compared
    to `depth` tokens, and those of all named articles at the beginnings of their blocks, compared to the block's end.
    They are sorted by host and token, and neighbours with a common prefix as long as they are compared form the intervals.

    - A block that markup leaves unassigned or whose name is doubtful goes if passages of `depth` tokens or more that the host
      repeats on different pages cover it whole: two pages share such a passage just if suffixes of theirs agree to `depth`,
      and longer ones show as runs of positions. One between others that is shorter than `depth` can't be told from a
      heading and stays.
    - Another block of an article, of `depth` tokens or more, goes if it stands in `share` of the host's different articles and in
      `least` at least: such a line is the site's notice. Lines that fewer articles share belong to them.

    Pages about the same thing (equal articles, or equal longest blocks) count as one page, so copies of an article don't
    remove it. The array is sorted by ranges of suffix and page, so neither a host with most of the pages nor a line
    on most pages needs a large task; intervals that a range's end cuts are put together.

    Cases: a null or empty html has an empty text; a null url has an empty host; rows that repeat each get a row; an
    empty table gives no rows; other columns are ignored.
    """
    page_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    named = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    @releasing
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [parse(h) for h in texts_of(batch, "html")]
            hosts = [xxhash.xxh64_digest(host_of(u if isinstance(u, str) else "")) for u in batch.column(2).to_pylist()]
            digests = [content_digest([b for b, doubtful in zip(a, d, strict=True) if not doubtful], s, m) for a, s, _, m, d in found]
            judged = ["\n".join(a if m else s) for a, s, _, m, _ in found]  # no block holds a line end
            side = ["\n".join(s + o if m else o) for _, s, o, m, _ in found]
            open_ = [[k for k, doubtful in enumerate(d) if doubtful] if m else list(range(len(s))) for _, s, _, m, d in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(hosts, pa.binary()), pa.array(digests, pa.int64()), pa.array([m for *_, m, _ in found]), pa.array(judged), pa.array(side), pa.array(open_, pa.list_(pa.int32()))],
                names=["row", "page_id", "url", "host", "content", "marked", "judged", "side", "open"],
            )

    parsed = staged(named.mapInArrow(read, f"row long, page_id {page_type}, url {url_type}, host binary, content long, marked boolean, judged string, side string, open array<int>"), "pages", compression="zstd")

    def blocks_of(text: str) -> list[str]:
        return text.split("\n") if text else []

    @releasing
    def array_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "judged", SUFFIX_BYTES), "side", SUFFIX_BYTES):
            found = set()
            for host, content, marked, judged, side, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = blocks_of(judged)
                found |= {(key, content) for key in open_suffixes(host, stream(blocks if open_ else []) + stream(blocks_of(side)), depth)}
                if marked:
                    found |= {(key, content) for _, key in block_suffixes(host, blocks, set(open_), depth)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int64())], names=["suffix", "page"])

    def placed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.binary()])], names=["row", "at", "suffix"])

    @releasing
    def open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "judged", SUFFIX_BYTES), "side", SUFFIX_BYTES):
            yield placed([(row, i, key) for row, host, judged, side in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, key in enumerate(open_suffixes(host, stream(blocks_of(judged)) + stream(blocks_of(side)), depth))])

    @releasing
    def block_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "judged", SUFFIX_BYTES):
            yield placed([(row, k, key) for row, host, judged, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, key in block_suffixes(host, blocks_of(judged), set(open_), depth)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [sorted([*whole, *gone_blocks(lengths, open_, {i + k for i in at for k in range(depth)})]) for lengths, open_, at, whole in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])

    entries = parsed.select("host", "content", "marked", "judged", "side", "open").mapInArrow(array_of, "suffix binary, page long")
    array = entries.repartitionByRange("suffix", "page").sortWithinPartitions("suffix", "page")
    # Equal suffixes of one page lie in one range, so the counts of an interval's parts add up.
    intervals = array.mapInArrow(repeats, "suffix binary, pages long").groupBy("suffix").agg(F.sum("pages").alias("pages")).where("pages > 1")
    repeated = staged(intervals.where((F.length("suffix") == 8 + 4 * depth) | (F.col("pages") >= least)), "repeats")
    articles_of_host = parsed.where("marked").groupBy("host").agg(F.count_distinct("content").alias("of"))
    wide = repeated.where(F.length("suffix") > 8 + 4 * depth).withColumn("host", F.substring("suffix", 1, 8)).join(articles_of_host, "host").where(F.col("pages") >= share * F.col("of"))
    wide = staged(wide.select("suffix"), "wide")  # few or none, which the join then sees
    place = "row long, at int, suffix binary"
    passages = parsed.where("size(open) > 0").select("row", "host", "judged", "side").mapInArrow(open_places, place).join(repeated, "suffix").select("row", "at", F.lit(False).alias("whole"))
    notices = parsed.where("marked").select("row", "host", "judged", "open").mapInArrow(block_places, place).join(wide, "suffix").select("row", "at", F.lit(True).alias("whole"))
    hits = passages.union(notices)
    of_row = hits.groupBy("row").agg(*(F.collect_list(F.when(F.col("whole") == flag, F.col("at"))).alias(name) for name, flag in (("covered", False), ("wide", True))))
    lengths = F.transform(F.split("judged", "\n"), lambda b: F.size(F.split(b, " ")))
    gone = staged(parsed.select("row", lengths.alias("lengths"), "open").join(of_row, "row").mapInArrow(judge, "row long, gone array<int>"), "gone")
    kept = F.filter(F.split("judged", "\n"), lambda b, k: ~F.array_contains("gone", k))
    text = F.when(F.col("gone").isNull(), F.translate("judged", "\n", " ")).otherwise(F.array_join(kept, " "))
    out = parsed.join(gone, "row", "left").select("page_id", "url", text.alias("text"), "marked")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "marked")
