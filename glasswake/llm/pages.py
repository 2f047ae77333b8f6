"""Main text of pages: markup seeds each block's place, and the suffix array of its host judges what
markup leaves open.

Blocks of an article without any sign of page furniture are its text. Blocks that markup names as
furniture go. Others are judged by the runs that other pages of their host repeat: outside an article
they lose these, and a block within one, under a class or id that only partly reads like furniture,
goes if these make most of it.

The token streams of a host's pages, article text and all, are taken as one text. Its suffixes are
sorted by their first LONG tokens (in the order of the tokens' numbers), the hosts' arrays one behind
the other, by a distributed sort: no host has to fit in one task. Where neighbours in the array share
LONG tokens and come from different pages, the tokens they share belong to a long substring repeated
across pages. A longer repeat is the union of its LONG-token repeats, so the array is only sorted to
that depth; suffixes of fewer tokens hold none.

Pages are parsed once and travel once, packed in blocks. A suffix whose first tokens no other page of
the host has can have no neighbour: blocks first send short hashes of all their suffixes, as sorted
packed lists, and hear which of them occur on another page. A hash that only seems to occur there costs
a row in the sort, nothing else. Only those suffixes become rows, whole, and are sorted and compared.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from glasswake.llm.common import cut

LONG = 6                    # tokens
BLOCK_CHARS = 8_000_000     # of the markup of a block's pages
PAGES_A_BATCH = 256
SHORT = 36                  # bits of a short hash

# Elements and words in class, id or role that name page furniture.
HIDDEN = frozenset("script style noscript template head title svg math iframe object embed select option button input "
                   "textarea canvas audio video".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
HINTS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies disqus footer header masthead menu nav navbar navigation newsletter notice pager pagination "
                  "popup promo related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
                  "toolbar widget".split())
#: Beside such words, these leave a class or id a name of furniture ("related-posts"); others don't ("related-work").
NEUTRAL = frozenset("area article bar block blocks bottom box btn button buttons col column container content entry group "
                    "holder inner item items js left link links list main module outer page panel post posts primary "
                    "region right row secondary section site slot text title top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the same list.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th")}
SPACE = " \t\n\r\x0b\x0c"


def _sign(names: str) -> str:
    """What class and id say: "furniture", "doubt" (some word of a name hints at it) or nothing."""
    found = ""
    for name in names.lower().split():
        words = "".join(c if c.isalpha() else " " for c in name).split()
        if not HINTS.isdisjoint(words):
            if all(w in HINTS or w in NEUTRAL for w in words):
                return "furniture"
            found = "doubt"
    return found


class Blocks(HTMLParser):
    """Blocks of visible text in page order, with their place: article, doubt (in an article,
    under a name that may be furniture), furniture or open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []       # (element, place)
        self.blocks: list[tuple[str, str]] = []      # (place, text)
        self.now: list[str] = []
        self.place = "open"

    def _flush(self) -> None:
        text = " ".join("".join(self.now).split())
        self.now = []
        if text and self.place != "hidden":
            self.blocks.append((self.place, text))

    def _enter(self) -> None:
        self.place = self.stack[-1][1] if self.stack else "open"

    def _pop_to(self, depth: int) -> None:
        self._flush()
        del self.stack[depth:]
        self._enter()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
            return
        if tag in ENDS:
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.stack[depth][0]
                if name in ENDS[tag]:
                    self._pop_to(depth)
                    break
                if name not in INLINE and name not in ENDS["td"]:
                    break
        place = self._place(tag, attrs)
        if tag not in INLINE or place != self.place:
            self._flush()
        if tag not in VOID:
            self.stack.append((tag, place))
            self.place = place

    def _place(self, tag, attrs) -> str:
        above = self.place
        if tag in HIDDEN or above == "hidden":
            return "hidden"
        held = {k: v or "" for k, v in attrs}
        if "hidden" in held or held.get("aria-hidden", "").lower() == "true":
            return "hidden"
        main = tag in MAIN or held.get("role", "").lower() == "main"
        if above == "furniture":
            return "article" if main and self._wrapped() else "furniture"
        if tag in FURNITURE and not (tag == "header" and above in ("article", "doubt")):
            return "furniture"
        if held.get("role", "").lower() in ROLES:
            return "furniture"
        sign = "" if tag in ("html", "body", *MAIN) else _sign(held.get("class", "") + " " + held.get("id", ""))
        if sign == "furniture":
            return sign
        if main:
            return "article"
        return "doubt" if sign and above == "article" else above

    def _wrapped(self) -> bool:
        """Whether the furniture around is an element that was never closed, or one that holds the whole page."""
        around = next(name for name, place in self.stack if place == "furniture")
        return around in ("nav", "header", "menu", "form")

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                if tag in INLINE and self.stack[depth][1] == (self.stack[depth - 1][1] if depth else "open"):
                    del self.stack[depth]             # an inline element ends without a new block
                    self._enter()
                else:
                    self._pop_to(depth)
                return

    def handle_data(self, data):
        if self.place != "hidden":
            self.now.append(data)

    def read(self, page: str) -> list[tuple[str, str]]:
        self.feed(page)
        self.close()
        self._flush()
        return self.blocks


def _host() -> Column:
    """A number of the host in ``url``: what stands between the scheme, if any, and a path, query or fragment."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.coalesce(F.nullif(F.regexp_extract(url, "(?s)^.*?://(.+)$", 1), F.lit("")), url)
    return F.xxhash64(F.lower(F.regexp_extract(rest, "^[^/?#]*", 0)))


class Numbers(dict):
    """The number of each token, kept for the next ones."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1 << 20:
            self.clear()
        number = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return number


_NUMBERS = Numbers()


def _tokens(blocks: list) -> np.ndarray:
    """The numbers of a page's tokens."""
    words = [w for _, t in blocks for w in t.split(" ")]
    return np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))


def _checks(tokens: np.ndarray, host: int) -> np.ndarray:
    """A hash over the host and the first LONG tokens of every suffix that has so many."""
    n = max(len(tokens) - LONG + 1, 0)
    check = np.full(n, host, np.int64).view(np.uint64)
    for k in range(LONG):
        check = (check ^ tokens[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        check ^= check >> np.uint64(29)
    return check


def _windows(tokens: np.ndarray, host: int) -> np.ndarray:
    """Rows (first, second, third, check) for every suffix that has LONG tokens: 32-bit numbers of its first
    tokens, two in a number, and as many bits of a hash over them and the host that keep apart what these don't."""
    check = _checks(tokens, host)
    n = len(check)
    top, low = tokens >> np.uint64(32) << np.uint64(32), tokens >> np.uint64(32)
    two = [top[k:k + n] | low[k + 1:k + 1 + n] for k in range(0, LONG, 2)]
    return np.stack([*two, check >> np.uint64(32)], 1).view(np.int64)


def _runs(covered: np.ndarray) -> np.ndarray:
    """The covered runs of a block that are the whole block or LONG tokens of it: the end of a
    repeat that began in the block before doesn't cut into a sentence."""
    edges = np.flatnonzero(np.diff(np.r_[0, covered, 0].astype(np.int8)))
    out = np.zeros(len(covered), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= LONG or b - a == len(covered)
    return out


def _columns(kinds: str, rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                      names=[x.split()[0] for x in kinds.split(", ")])


def _pack(data: bytes, level: int) -> bytes:
    return pa.py_buffer(len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)).to_pybytes()


def _unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


BLOCKS = "block long, packed binary"


def _rows(pages: DataFrame) -> DataFrame:
    """The pages in blocks of about BLOCK_CHARS of markup, dealt to tasks by block: packed rows of page_id, url,
    number of the host, ``page`` (a hash of the row: equal rows are one page) and its blocks of text: place and text."""
    cols = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    rows = pages.select(*(c.alias(n) for c, n in zip(cols, ("page_id", "url", "html"))))
    rows = rows.select("page_id", "url", _host().alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << BLOCK_BITS
        held, chars = [], 0

        def close() -> pa.RecordBatch:
            packed = _pack(json.dumps(held, ensure_ascii=False).encode("utf-8", "surrogatepass"), 9)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary())], names=["block", "packed"])

        for b in batches:
            for i in range(0, b.num_rows, PAGES_A_BATCH):
                for *key, html in zip(*(c.to_pylist() for c in b.slice(i, PAGES_A_BATCH).columns)):
                    held.append((*key, Blocks().read(html or "")))
                    chars += len(html or "")
                    if chars >= BLOCK_CHARS:
                        yield close()
                        held, chars, block = [], 0, block + 1
        if held:
            yield close()

    return rows.mapInArrow(run, BLOCKS).repartition("block")


#: A suffix is named by its block and its place among the suffixes of the block.
BLOCK_BITS, AT_BITS = 12, 31


def _read(packed: bytes) -> list:
    return json.loads(_unpack(packed).decode("utf-8", "surrogatepass"))


def _numbered(packed: bytes) -> tuple[list, list[np.ndarray]]:
    """A block's pages and the numbers of their tokens."""
    pages = _read(packed)
    return pages, [_tokens(p[4]) for p in pages]


def _short(pages: list, tokens: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the distinct short hashes of its suffixes, ascending; how many suffixes have each; which stand
    on two pages of the block; and the order of the suffixes by these."""
    own = [_checks(t, p[2]) for p, t in zip(pages, tokens)]
    page = np.repeat(np.array([x[3] for x in pages], np.int64), [len(x) for x in own])
    short = np.concatenate([*own, np.empty(0, np.uint64)]) >> np.uint64(64 - bits)
    order = np.argsort(short, kind="stable")
    short, page = short[order], page[order]
    first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]][:len(short)])
    again = np.r_[False, (short[1:] == short[:-1]) & (page[1:] != page[:-1])][:len(short)]
    return short[first], np.diff(np.r_[first, len(short)]), np.add.reduceat(again, first) > 0 if len(first) else again, order


LISTS = "block long, part int, hashes binary, again binary"


def _lists(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct short hashes by their range, as differences, and which are on two of its pages."""
    bits = SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(*(c.to_pylist() for c in b.columns)):
                short, _, again, _ = _short(*_numbered(packed), bits)
                ends = np.searchsorted(short * np.uint64(parts) >> np.uint64(bits), np.arange(parts + 1))
                out = []
                for part, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    steps = np.diff(np.r_[np.uint64(0), short[i:j]]).astype("<u8")
                    # byte by byte: most of the high ones are zeros
                    out.append((block, part, _pack(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1),
                                _pack(np.packbits(again[i:j]).tobytes(), 1)))
                yield _columns(LISTS, out, [pa.int64(), pa.int32(), pa.binary(), pa.binary()])

    return blocks.mapInArrow(run, LISTS)


SHARED = "block long, part int, shared binary"


def _shared(blocks: DataFrame, parts: int) -> DataFrame:
    """Which of each block's distinct short hashes, by their range, are on two pages of a host or may be."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(np.frombuffer(_unpack(x), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()) for x in pdf["hashes"]]
        sizes = [len(x) for x in lists]
        found = np.concatenate([np.unpackbits(np.frombuffer(_unpack(x), np.uint8), count=n) for x, n in zip(pdf["again"], sizes)])
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        found[order[1:][same]] = found[order[:-1][same]] = 1
        # equal hashes are shared wherever they are
        shared = [_pack(np.packbits(x).tobytes(), 1) for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "shared": shared})

    return _lists(blocks, parts).groupBy("part").applyInPandas(run, SHARED)


ORDER = ["host", "first", "second", "third", "check"]
SUFFIXES = "host long, first long, second long, third long, check long, page long, at long"


def suffixes(blocks: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One row per suffix of the tokens of each page that has LONG tokens: its place and the numbers it is sorted by.
    With ``shared`` (see ``_shared``), of those that can have a neighbour of another page."""

    def rows(block: int, pages: list, tokens: list[np.ndarray], wanted: np.ndarray | None) -> list[np.ndarray]:
        own, at = [], 0
        for (_, _, host, page, _), words in zip(pages, tokens):
            found = _windows(words, host)
            places = np.arange(at, at + len(found))
            at += len(found)
            if wanted is not None:
                found, places = found[wanted[places]], places[wanted[places]]
            own.append(np.column_stack([np.full(len(found), host, np.int64), found, np.full(len(found), page, np.int64),
                                        (block << AT_BITS) + places]))
        return list(np.concatenate(own).T.copy())

    names, bits = [x.split()[0] for x in SUFFIXES.split(", ")], SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows(block, *_numbered(packed), None)], names=names)

    def met(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        out = []
        for block, packed in zip(own["block"].tolist(), own["packed"]):
            pages, tokens = _numbered(packed)
            short, counts, _, order = _short(pages, tokens, bits)
            ends = np.searchsorted(short * np.uint64(len(parts)) >> np.uint64(bits), np.arange(len(parts) + 1))
            mask = [np.unpackbits(np.frombuffer(_unpack(x), np.uint8), count=n) for x, n in zip(parts["shared"], np.diff(ends).tolist())]
            wanted = np.zeros(len(order), bool)
            wanted[order] = np.repeat(np.concatenate(mask).astype(bool), counts)
            out.append(pd.DataFrame(dict(zip(names, rows(block, pages, tokens, wanted)))))
        return pd.concat(out) if out else pd.DataFrame(columns=names, dtype="int64")

    if shared is None:
        return blocks.mapInArrow(run, SUFFIXES)
    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(met, SUFFIXES)


def suffix_array(found: DataFrame) -> DataFrame:
    """The suffixes in order. Those that share LONG tokens are in one partition, by page."""
    return found.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "page", "at")


REPEATED = "page long, at long"


def repeated(array: DataFrame) -> DataFrame:
    """Page and place of the suffixes whose first LONG tokens stand beside them in the array under another page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, at = len(ORDER), len(ORDER) + 1
        held, given = np.empty((0, at + 1), np.int64), 0      # of the last run: one page's, or two rows already given
        for b in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1)])
            if not len(rows):
                continue
            first = np.flatnonzero(np.r_[True, (rows[1:, :page] != rows[:-1, :page]).any(1)])
            stop = np.r_[first[1:], len(rows)]
            shared = rows[first, page] != rows[stop - 1, page]
            out = np.repeat(shared, stop - first)
            out[:given] = False
            yield pa.RecordBatch.from_arrays([pa.array(rows[out, page]), pa.array(rows[out, at])],
                                             names=["page", "at"])
            last = rows[first[-1]:]
            held, given = (last[[0, -1]], 2) if shared[-1] else (last, 0)

    return array.select(*ORDER, "page", "at").mapInArrow(run, REPEATED)


OUT = "page_id long, url string, text string, n_chars long, n_repeated long"


def _finish(blocks: list, starts: np.ndarray) -> tuple[str, int]:
    """A page's text and number of repeated tokens; ``starts``: the places of its suffixes that another page shares."""
    sizes = [t.count(" ") + 1 for _, t in blocks]
    covered = np.zeros(sum(sizes) + LONG, bool)
    for k in range(LONG if len(starts) else 0):
        covered[starts + k] = True
    article = any(p in ("article", "doubt") for p, _ in blocks)
    kept, at = [], 0
    for (p, t), k in zip(blocks, sizes):
        if p == "article" or p == "doubt" and 2 * covered[at:at + k].sum() <= k:
            kept.append(t)
        elif p == "open" and not article:
            gone = _runs(covered[at:at + k])
            kept.append(" ".join(w for w, g in zip(t.split(" "), gone) if not g))
        at += k
    return "\n".join(t for t in kept if t), int(covered.sum())


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (tokens that other pages of the host repeat, those of the article
    too).

    Pages with an article give its blocks; those under a class or id that may name furniture go where
    runs that other pages of the host repeat cover over half of them, the others are whole, however
    often the host repeats them. Other pages give their open blocks without such runs (a whole block,
    or LONG tokens of it). Null or empty pages give an empty text; equal rows are one page to the suffix array and
    each get their row; pages without a host form one group. Broken markup is read to its end; an
    article in a menu that was never closed is an article. Suffixes count as equal by at least 64 bits.
    """
    blocks = _rows(pages)
    chars = pages.agg(F.sum(F.length(F.col("html").cast("string")))).first()[0] or 0
    array = suffix_array(suffixes(blocks, _shared(blocks, 1 + chars // (2 * BLOCK_CHARS))))
    found = repeated(array).select(F.shiftright("at", AT_BITS).alias("block"), F.col("at").bitwiseAND(2**AT_BITS - 1).alias("at"))

    def finish(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for packed in own["packed"]:
            starts = np.sort(found["at"].to_numpy(np.int64))
            at = 0
            for key, url, _, _, blocks in _read(packed):
                n = max(sum(t.count(" ") + 1 for _, t in blocks) - LONG + 1, 0)
                i, j = np.searchsorted(starts, (at, at + n))
                text, repeats = _finish(blocks, starts[i:j] - at)
                out.append((key, url, text, len(text), repeats))
                at += n
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"page_id": "Int64"})

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(finish, OUT)
