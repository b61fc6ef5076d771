"""HTML extraction: the main text of a page as blocks.

Every page goes through the host suffix array: the words of a host's pages (without the parts that elements, roles or
class names mark as menu, header, footer, sidebar, notice, advert, form or reader comments) are concatenated, suffixes are
ordered by prefix doubling, and neighbours that agree for RUN words on distinct pages are a repeated passage. An exact check by
the page's structure follows, because articles that are copied between pages repeat too:

- A page with text in an `article` or `main` element gives that element's blocks, repeated or not. The array decides the blocks
  whose own name leaves it open (a paragraph of class `lead-notice`): one that is repeated as a whole is a notice,
  if the article has other text that is not.
- Of all other pages repeated words are removed and unique runs stay.

A host of more than GROUP_PAGES pages is dealt over groups by a hash, and each group has a suffix array. What repeats between
groups is found in two exchanges of hashes. A run's anchor is the least hash of the RUN / 2 words long passages in it, so equal
runs have equal anchors, and neighbouring runs mostly share theirs. First the anchors, then 96-bit hashes of those runs whose anchor another
group has, meet by shard, and a bit for each goes back. So a repeat counts on the whole host, whatever its size.

Blocks are cut at block elements; white space inside a block becomes one blank, `br` is white
space, character references are decoded, and blocks are joined by a line feed. Defined cases: a null or empty html
has an empty text; unclosed elements end with the element around them, a truncated page with its
last character; repeated rows are treated alike (and are one page for the suffix array); other columns pass through.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 16                # tokens, a power of two
GROUP_PAGES = 500
SHARD_GROUPS = 16       # groups whose hashes one shard takes
OUTSIDE, INSIDE, DOUBTFUL = "o", "i", "d"       # of an article; inside of one, and its name leaves open what it is
ENTRY = np.dtype([("first", "<u8"), ("second", "<u4"), ("page", "<u8")])       # a run, and its page or 0: several
FACTORS = np.array([xxhash.xxh3_64_intdigest(str(i)) | 1 for i in range(RUN)], dtype=np.uint64)

# Names of the elements, roles and class words that decide.
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""
script style noscript template head title nav menu header footer aside form button select textarea input
iframe object svg canvas dialog
""".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = frozenset("""
ad ads advert adverts advertisement advertising sponsor sponsored banner promo cookie cookies consent gdpr
notice notices notification popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb
breadcrumbs footer masthead comment comments disqus respond replies
""".split())
# Elements that a part of a class name marks; others need a whole name.
CONTAINERS = frozenset("div section ul ol dl table details figure fieldset center span a iframe".split())
HEADER_WORDS = frozenset("header site page top global main".split())
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

STOPS = BLOCKS - CLOSED_BY_BLOCK - CLOSED_BY_SAME.keys()

_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


def is_noise(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "role" and (value or "").lower() in DROPPED_ROLES:
            return True
        if name in ("class", "id"):
            for part in (value or "").split():
                words = {w.lower() for w in _WORD.findall(part)} if tag in CONTAINERS else {part.lower()}
                if words & DROPPED_WORDS or ("header" in words and words <= HEADER_WORDS):
                    return True
    return False


def is_doubtful(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a part of a text element's class name or id is a word that marks containers."""
    if tag not in BLOCKS or tag in CONTAINERS or tag in ("html", "body", "article", "main"):
        return False
    return any(name in ("class", "id") and {w.lower() for w in _WORD.findall(value or "")} & DROPPED_WORDS for name, value in attributes)


class Reader(HTMLParser):
    """Blocks of a page: (inside an article or main, text), and whether each is doubtful."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.doubts: list[bool] = []
        self.open: list[tuple[str, bool]] = []      # name, dropped
        self.blocks_at: list[int] = []      # places in `open` of block elements
        self.stops_at: list[int] = []       # of those that no start tag closes
        self.places: dict[str, list[int]] = {}      # places in `open` by name
        self.doubtful_at: list[int] = []    # of doubtful elements inside of an article
        self.dropped = self.articles = 0
        self.text: list[str] = []

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.articles > 0, text))
            self.doubts.append(bool(self.doubtful_at))
        self.text = []

    def pop(self, count: int) -> None:
        for _ in range(count):
            name, dropped = self.open.pop()
            self.places[name].pop()
            for places in (self.blocks_at, self.stops_at):
                if places and places[-1] == len(self.open):
                    places.pop()
            self.dropped -= dropped
            if name in BLOCKS:
                self.cut()
            self.articles -= name in ("article", "main")
            if self.doubtful_at and self.doubtful_at[-1] == len(self.open):
                self.doubtful_at.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close_before(tag)
            self.cut()
        elif tag == "br":
            self.handle_data(" ")
        if tag not in VOID:
            dropped = is_noise(tag, attrs)
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCKS:
                self.blocks_at.append(len(self.open))
            if tag in STOPS:
                self.stops_at.append(len(self.open))
            if self.articles and is_doubtful(tag, attrs):
                self.doubtful_at.append(len(self.open))
            self.open.append((tag, dropped))
            self.dropped += dropped
            self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)        # a slash closes nothing but void elements

    def _close_before(self, tag: str) -> None:
        """Close the paragraph, or the item or cell of the same name, that this block element ends.

        Inline elements and items of other names lie between; last places by name are compared, so
        that any number of them costs nothing."""
        def last(names) -> int:
            return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

        closed = last([*CLOSED_BY_BLOCK, *([tag] if tag in CLOSED_BY_SAME else [])])
        around = max(last(CLOSED_BY_SAME.get(tag, ())), self.stops_at[-1] if self.stops_at else -1)
        if closed > around:
            self.pop(len(self.open) - closed)

    def handle_endtag(self, tag):
        place = self.places[tag][-1] if self.places.get(tag) else -1
        if tag in BLOCKS and place < 0:
            self.cut()
        # an inline element is not closed from within a block inside of it
        elif place >= 0 and (tag in BLOCKS or not self.blocks_at or self.blocks_at[-1] < place):
            self.pop(len(self.open) - place)

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)


def page_parts(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of every block that the page's structure does not drop."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader.cut()
    return [((DOUBTFUL if doubt else INSIDE) if article else OUTSIDE, text) for (article, text), doubt in zip(reader.blocks, reader.doubts, strict=True)]


def page_blocks(html: str | None) -> tuple[bool, list[str]]:
    """Whether the page's structure settles its main text, and the blocks."""
    parts = page_parts(html)
    inside = [text for kind, text in parts if kind != OUTSIDE]
    return (True, inside) if inside else (False, [text for _, text in parts])


def repeated_words(flat: np.ndarray, sizes: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which words of concatenated pages, numbered from 0 without gaps, lie in a run that stands on another page too."""
    # A number of its own ends each page, so no run goes on into the next.
    stream = np.insert(flat, np.cumsum(sizes), flat.max(initial=0) + 1 + np.arange(len(sizes)))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    n, width, rank = len(stream), 1, stream
    at = np.arange(n)               # suffixes whose first `width` words another suffix has; all others are in their place
    while width < run:
        told = np.full(n + width, -1, dtype=np.int64)
        told[at] = rank
        at, rank = (x[told[at + width] >= 0] for x in (at, rank))
        _, rank, count = np.unique(rank * (2 * n + 2) + told[at + width], return_inverse=True, return_counts=True)
        at, rank = (x[count[rank] > 1] for x in (at, rank))
        width *= 2
    order = np.argsort(rank, kind="stable")     # suffixes by their first `run` words
    at, rank = at[order], rank[order]
    begin = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
    if len(at):
        shared = np.minimum.reduceat(owner[at], begin) != np.maximum.reduceat(owner[at], begin)
        at = at[np.repeat(shared, np.diff(np.append(begin, len(at))))]
    edge = np.zeros(n + run + 1, dtype=np.int64)
    edge[at] += 1
    edge[at + run] -= 1
    return np.delete(np.cumsum(edge)[:n] > 0, np.cumsum(sizes + 1) - 1)


def repeated(pages: list[list[int]], run: int = RUN) -> list[np.ndarray]:
    """Per page of token numbers: which tokens lie in a run that stands on another page too."""
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    _, flat = np.unique(np.array([t for p in pages for t in p], dtype=np.int64), return_inverse=True)
    return np.split(repeated_words(flat, sizes, run), np.cumsum(sizes)[:-1])


class Group:
    """The pages of a host's group as numbered words, equal pages once, and the hashes of their runs."""

    def __init__(self, pages: list[str]) -> None:
        # equal pages are one page: a copy does not make a text boilerplate
        place = {text: i for i, text in enumerate(dict.fromkeys(pages))}
        self.page_of = [place[text] for text in pages]
        self.pages = list(place)
        self.sizes = np.array([text.count(" ") + 1 if text else 0 for text in place], dtype=np.int64)
        whole = pa.array([" ".join(text for text in place if text)], pa.large_string())
        words = pc.split_pattern(whole, " ").flatten().dictionary_encode()
        self.flat = words.indices.to_numpy().astype(np.int64)[:int(self.sizes.sum())]
        self.words = words.dictionary

    def hash_runs(self) -> None:
        """`at`, the places of all runs in the concatenated pages, and their `anchors`."""
        n, grams = len(self.flat), RUN // 2
        self.at = np.flatnonzero(np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(n) >= RUN)
        self.anchors = np.zeros(len(self.at), dtype=np.uint64)
        if len(self.at):
            words = self.words.to_numpy(zero_copy_only=False)       # many times faster than to_pylist
            self.hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
            first, runs = self.hashes[self.flat, 0], n - RUN + 1
            mixed = sum(first[j:n - grams + 1 + j] * FACTORS[j] for j in range(grams))
            least = mixed[:runs]
            for j in range(1, RUN - grams + 1):
                least = np.minimum(least, mixed[j:runs + j])
            self.anchors = least[self.at] & np.uint64((1 << 48) - 1)

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors in order, and the place of each run's among them."""
        new = np.concatenate([[True], self.anchors[1:] != self.anchors[:-1]])[:len(self.anchors)]
        anchors, place = np.unique(self.anchors[new], return_inverse=True)
        return anchors, place[np.cumsum(new) - 1]

    def asked(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries of the runs whose anchor is shared, in order; numbers of these runs, and the entry of each."""
        runs = np.flatnonzero(shared)
        held = np.zeros(len(runs), dtype=ENTRY)
        if len(runs):
            mixed = [sum(self.hashes[self.flat[self.at[runs] + j], half] * FACTORS[j] for j in range(RUN)) for half in (0, 1)]
            pages = np.array([xxhash.xxh3_64_intdigest(text) or 1 for text in self.pages], dtype=np.uint64)
            held["first"], held["second"] = mixed[0], mixed[1] >> np.uint64(32)
            held["page"] = np.repeat(pages, self.sizes)[self.at[runs]]
        order = np.lexsort((held["second"], held["first"]))
        runs, held = runs[order], held[order]
        new = np.ones(len(runs), dtype=bool)
        new[1:] = (held["first"][1:] != held["first"][:-1]) | (held["second"][1:] != held["second"][:-1])
        entry = np.cumsum(new) - 1
        distinct = held[new]
        distinct["page"][entry[held["page"] != distinct["page"][entry]]] = 0
        return distinct, runs, entry

    def covered(self, known: np.ndarray) -> list[np.ndarray]:
        """Per page: which words lie in a run that another page has, of this group or (numbers of runs) known from others."""
        marks = repeated_words(self.flat, self.sizes)
        edge = np.zeros(len(marks) + 1, dtype=np.int64)
        if len(known):
            edge[self.at[known]] += 1
            edge[self.at[known] + RUN] -= 1
        pages = np.split(marks | (np.cumsum(edge)[:-1] > 0), np.cumsum(self.sizes)[:-1])
        return [pages[i] for i in self.page_of]


def main_text(parts: list[tuple[str, str]], covered: np.ndarray) -> list[str]:
    """Blocks of the main text, from the page's blocks and which of their words are repeated on the host."""
    kinds = {kind for kind, _ in parts}
    if INSIDE in kinds and DOUBTFUL not in kinds:
        return [text for kind, text in parts if kind == INSIDE]
    ends = np.cumsum([len(text.split()) for _, text in parts])
    marks = np.split(covered, ends[:-1]) if parts else []
    if kinds <= {OUTSIDE}:
        left = (" ".join([t for t, m in zip(text.split(), mark.tolist(), strict=True) if not m]) for (_, text), mark in zip(parts, marks, strict=True))
        return [text for text in left if text]
    own = any(kind == INSIDE and not mark.all() for (kind, _), mark in zip(parts, marks, strict=True))
    return [text for (kind, text), mark in zip(parts, marks, strict=True) if kind == INSIDE or (kind == DOUBTFUL and not (own and mark.all()))]


def _pack(parts: list[tuple[str, str]]) -> bytes:
    data = "\n".join([kind + text for kind, text in parts]).encode()
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _parse(batches):
    """Columns before the html, and the packed blocks of the page."""
    for batch in batches:
        packed = [_pack(page_parts(h)) for h in batch.column("html").to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "packed"])


def _unpack(table: pa.Table) -> list[list[tuple[str, str]]]:
    data = [pa.decompress(p[4:], int.from_bytes(p[:4], "little"), "zstd", asbytes=True).decode() for p in table.column("packed").to_pylist()]
    return [[(line[0], line[1:]) for line in page.split("\n") if line] for page in data]


def _shards(table: pa.Table) -> np.uint64:
    return np.uint64(table.column("shards")[0].as_py())


def _group(pages: list[list[tuple[str, str]]]) -> Group:
    return Group([" ".join([text for _, text in parts]) for parts in pages])


SENT = "host string, part bigint, shard bigint, entries binary"
NOTHING = pa.schema([("host", pa.string()), ("part", pa.int64()), ("shard", pa.int64()), ("entries", pa.binary())]).empty_table()
ANSWERED = "host string, part bigint, step int, shard bigint, bits binary"


def _sent(table: pa.Table, shards: np.ndarray, packed) -> pa.Table:
    """Rows (SENT): the entries of each shard, in order."""
    host, part = (table.column(c)[0].as_py() for c in ("host", "part"))
    rows = [(host, part, s, packed(shards == s)) for s in np.unique(shards).tolist()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(NOTHING.schema.types)], NOTHING.schema.names)


def _answered(table: pa.Table, step: int, bits: list[np.ndarray]) -> pa.Table:
    columns = [table.column("host"), table.column("part"), pa.array([step] * len(bits), pa.int32()), table.column("shard"), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())]
    return pa.table(columns, ["host", "part", "step", "shard", "bits"])


def _bits(answers: pa.Table, step: int, shards: np.ndarray) -> np.ndarray:
    """The bits of one step's answers, in the order of the entries that were asked about."""
    found = np.zeros(len(shards), dtype=bool)
    for row in answers.to_pylist():
        if row["step"] == step:
            mine = shards == row["shard"]
            found[mine] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=int(mine.sum())).astype(bool)
    return found


def _send_anchors(table: pa.Table) -> pa.Table:
    """The anchors of a group, six bytes each."""
    if table.column("groups")[0].as_py() == 1:
        return NOTHING
    group = _group(_unpack(table))
    group.hash_runs()
    anchors, _ = group.distinct_anchors()
    return _sent(table, (anchors % _shards(table)).astype(np.int64), lambda of: anchors[of].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())


def _meet_anchors(table: pa.Table) -> pa.Table:
    """Of each anchor of each group, whether another group has it."""
    sent = [np.frombuffer(e, dtype=np.uint8).reshape(-1, 6) for e in table.column("entries").to_pylist()]
    wide = np.zeros((sum(map(len, sent)), 8), dtype=np.uint8)
    wide[:, :6] = np.concatenate(sent)
    _, place, count = np.unique(wide.view("<u8")[:, 0], return_inverse=True, return_counts=True)
    return _answered(table, 1, np.split(count[place] > 1, np.cumsum([len(x) for x in sent])[:-1]))


def _asked(group: Group, table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs whose anchor another group has: distinct entries, their shards, runs, the entry of each run."""
    group.hash_runs()
    anchors, place = group.distinct_anchors()
    shards = _shards(table)
    shared = _bits(answers, 1, (anchors % shards).astype(np.int64))[place]
    entries, runs, entry = group.asked(shared)
    return entries, (entries["first"] % shards).astype(np.int64), runs, entry


def _send_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
    if not answers.num_rows:
        return NOTHING
    entries, shards, _, _ = _asked(_group(_unpack(table)), table, answers)
    return _sent(table, shards, lambda of: entries[of].tobytes())


def _meet_runs(table: pa.Table) -> pa.Table:
    """Of each run of each group, whether it stands on a distinct page of another group."""
    sent = [np.frombuffer(e, dtype=ENTRY) for e in table.column("entries").to_pylist()]
    held = np.concatenate(sent)
    order = np.lexsort((held["second"], held["first"]))
    first, second, page = (held[c][order] for c in ENTRY.names)
    new = np.ones(len(held), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    shared = (np.bincount(run) > 1) & ((np.minimum.reduceat(page, begin) == 0) | (np.minimum.reduceat(page, begin) != np.maximum.reduceat(page, begin)))
    found = np.zeros(len(held), dtype=bool)
    found[order] = shared[run]
    return _answered(table, 2, np.split(found, np.cumsum([len(x) for x in sent])[:-1]))


def _finish(table: pa.Table, answers: pa.Table) -> pa.Table:
    pages = _unpack(table)
    group, known = _group(pages), np.zeros(0, dtype=np.int64)
    if answers.num_rows:
        _, shards, runs, entry = _asked(group, table, answers)
        known = runs[_bits(answers, 2, shards)[entry]]
    texts = ["\n".join(main_text(parts, marks)) for parts, marks in zip(pages, group.covered(known), strict=True)]
    return pa.table([table.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def extract_text(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """`row` (all columns of pages but the html) and text of every row."""
    rest = [c for c in pages.columns if c != html_column]
    host = F.coalesce(F.lower(F.regexp_extract(url_column, r"://([^/?#]*)", 1)), F.lit("")).alias("host")
    # at most one row for GROUP_PAGES pages
    large = pages.select(host).groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).alias("groups")).where("groups > 1")
    held = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
        host,
        F.xxhash64(url_column, html_column).alias("deal"),
        F.coalesce(F.col(html_column), F.lit("")).alias("html"),
    ).join(F.broadcast(large), "host", "left")
    groups = F.coalesce("groups", F.lit(1).cast("bigint"))
    shards = F.ceil(groups / SHARD_GROUPS).alias("shards")
    held = held.select("row", "host", groups.alias("groups"), shards, F.pmod("deal", groups).alias("part"), "html")
    # all readers of the groups take all columns, so that they share one exchange
    dealt = held.mapInArrow(_parse, held.drop("html").schema.add("packed", "binary"))
    by_group = lambda: dealt.groupBy("host", "part")
    anchors = by_group().applyInArrow(_send_anchors, SENT).groupBy("host", "shard").applyInArrow(_meet_anchors, ANSWERED)
    runs = by_group().cogroup(anchors.groupBy("host", "part")).applyInArrow(_send_runs, SENT).groupBy("host", "shard").applyInArrow(_meet_runs, ANSWERED)
    answers = anchors.unionAll(runs)
    return by_group().cogroup(answers.groupBy("host", "part")).applyInArrow(_finish, held.select("row").schema.add("text", "string"))
