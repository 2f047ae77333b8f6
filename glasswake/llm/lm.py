"""Language-model scores from a log-frequency Bloom filter.

Counting: documents are dealt into blocks of about 16 million characters. A block sends, per
hash segment, its different words and word pairs with their counts as packed arrays; a
segment adds them up. Exact word counts go back to the blocks that asked for them.

Filter: a pair or word that occurs c times is entered under levels 1 to q, q growing with the
logarithm of c; a reader probes level after level until one is missing. Every word and every pair of
the training texts is in it. Each n-gram has all its bits in one slice of 2**17 bits, so slices are
built apart, and the filter is the row of slices. Up to ``FILTER_BITS`` it is broadcast; a larger one
stays in shards of slices, and blocks send their questions there. Both give the same levels.

p(w | v) = (c(vw) + D(v) p(w)) / (T(v) + D(v)), p(w) = (c(w) + 1) / (S + V + 1), counts c as the
filter has them: T(v) sums c(vw) over the D(v) different words behind v, S sums c(w) over the V words.
Over all words and one unknown word these probabilities make 1, but for the filter's false hits.
T and D are kept exactly, as numbers that blocks get back with the counts of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswake.llm.common import buckets_for, cut, fold

BLOCK_CHARS = 16_000_000
SEGMENT_WORDS = 1_000_000
FILTER_BITS = 1 << 29       # of a broadcast filter
SHARD_SLICES = 128          # of one that is not
SLICE_BITS = 1 << 17
BITS_PER_ENTRY, PROBES = 12, 6
CONTEXT_BITS = 36           # at least 32, by which words are dealt to segments
LOW_BITS = np.uint64(64 - CONTEXT_BITS)
KNOWN_WORDS = 400_000
CHUNK_WORDS = 400_000       # words looked up at once
END = 0x9AE16A3B2F90404F    # the end token's number
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit numbers of a text's words, A-Z in lower case, with the end token behind them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = text.encode().lower().split() if text else []
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxh64_intdigest(w)
        out = np.fromiter((known[w] for w in words), np.uint64, len(words) + 0)
        return np.append(out, np.uint64(END))


def pairs(words: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that end at each word; the first follows an end token."""
    return two_words(np.r_[np.uint64(END), words[:-1]], words)


def two_words(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The upper CONTEXT_BITS are those of the word before, the others a hash of both: so a pair
    tells its context without another number. Two contexts are taken for one, or two words behind
    the same context, far more rarely than the filter has false hits."""
    both = scramble(before * np.uint64(0x9E3779B97F4A7C15) + words)
    return (context_of(before) << LOW_BITS) | (both & ((np.uint64(1) << LOW_BITS) - np.uint64(1)))


def context_of(numbers: np.ndarray) -> np.ndarray:
    return numbers >> LOW_BITS


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each doubling."""
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    return np.where(levels > 0, (3.0 * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def _places(numbers: np.ndarray, lv: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice of each n-gram, and its bits at that level: (PROBES, n)."""
    h = scramble(numbers + lv.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    step = (h >> np.uint64(34)) | np.uint64(1)
    bits = (h[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(SLICE_BITS - 1)
    return (scramble(numbers) % np.uint64(slices)).astype(np.int64), bits.astype(np.int64)


class Filter:
    """Reads levels back from the bits (one byte array over all slices, or those from ``first`` on)."""

    def __init__(self, bits: np.ndarray, slices: int, first: int = 0):
        self.bits, self.slices, self.first = bits, slices, first

    def levels(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        alive = np.arange(len(numbers))
        if not self.slices:
            return out
        for lv in range(1, 65):
            own = numbers[alive]
            which, bits = _places(own, np.full(len(own), lv), self.slices)
            base = (which - self.first) * SLICE_BITS
            ok = np.arange(len(alive))
            for k in range(PROBES):
                at = base[ok] + bits[k, ok]
                ok = ok[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            alive = alive[ok]
            if not len(alive):
                break
            out[alive] = lv
        return out


SENT = "block long, segment long, kind int, numbers binary, counts binary"


def _segment_of(numbers: np.ndarray, segments: int) -> np.ndarray:
    return ((numbers >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def _send(block: int, kind: int, numbers: np.ndarray, counts: np.ndarray, segments: int) -> list[tuple]:
    of = _segment_of(scramble(numbers) if kind else numbers, segments)     # pairs of one context are dealt out
    order = np.lexsort((numbers, of))
    numbers, counts, of = numbers[order], counts[order], of[order]
    bounds = np.searchsorted(of, np.arange(segments + 1))
    return [(block, k, kind, numbers[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]


def _blocks(docs: DataFrame, parts: int, modulus: int, out_fold: int) -> DataFrame:
    """Rows with their block and whether they are held out, dealt by block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (fold(F.col("doc_id"), modulus) == out_fold).alias("held_out"))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))


def _count(blocked: DataFrame, parts: int, segments: int) -> DataFrame:
    """Packed counts of the training words (kind 0, words of held-out documents with count 0)
    and training pairs (kind 1) of each block, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, held = Words(), None, []

        def flush() -> Iterator[pa.RecordBatch]:
            trained = np.concatenate([w for w, out in held if not out] or [np.empty(0, np.uint64)])
            # each text ends in an end token, behind which the next one starts
            before = np.r_[np.uint64(END), trained[:-1]][:len(trained)]
            asked = np.concatenate([w for w, _ in held])
            words, inverse = np.unique(np.r_[trained, asked], return_inverse=True)
            counts = np.bincount(inverse[:len(trained)], minlength=len(words))
            rows = _send(now, 0, words, counts, segments)
            if len(trained):
                rows += _send(now, 1, *np.unique(two_words(before, trained), return_counts=True), segments)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 64]), kinds)],
                                                 names=[x.split()[0] for x in SENT.split(", ")])

        for b in batches:
            for block, text, out in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and block != now:
                    yield from flush()
                    held = []
                now = block
                held.append((of(text), out))
        if held:
            yield from flush()

    dealt = blocked.repartition(parts, "block").sortWithinPartitions("block").select("block", "text", "held_out")
    return dealt.mapInArrow(run, SENT)


REPLIES = ("kind int, block long, segment long, counts binary, numbers binary, known long, total long, "
           "histogram binary, followers binary")


def _add_up(sent: DataFrame, segments: int) -> DataFrame:
    """Kind 0: the totals of the words each block asked for, plus one row per segment (block -1)
    with the levels of the segment's words. Kind 1: one row per segment with the levels of all its
    pairs; kind 2: what these add to T (counts) and D (followers) of the contexts of each segment.
    Rows of block -1 have the number of n-grams, the sum of counts and a histogram of levels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iloc[0])
        parts = [np.frombuffer(x, np.uint64) for x in pdf["numbers"]]
        numbers, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]), len(numbers))
        counts = counts.astype(np.int64)
        rows, at = [], 0
        segment = int(pdf["segment"].iloc[0])
        if kind == 0:
            for block, p in zip(pdf["block"], parts):
                rows.append((0, int(block), segment, counts[inverse[at:at + len(p)]].tobytes(), p.tobytes(), 0, 0, None, None))
                at += len(p)
            numbers, counts = numbers[counts > 0], counts[counts > 0]
        lv = level(counts)
        rows.append((kind, -1, segment, lv.astype(np.uint8).tobytes(), numbers.tobytes(), len(numbers), int(counts.sum()),
                     np.bincount(lv, minlength=64)[:64].astype(np.int64).tobytes(), None))
        if kind == 1:
            contexts, which, followers = np.unique(context_of(numbers), return_inverse=True, return_counts=True)
            mass = np.bincount(which, count_of(lv), len(contexts))
            of = _segment_of(contexts << LOW_BITS, segments)
            order = np.argsort(of, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                rows.append((2, -1, int(of[k[0]]), mass[k].tobytes(), contexts[k].tobytes(), 0, 0, None,
                             followers[k].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in REPLIES.split(", ")])

    return sent.groupBy("kind", "segment").applyInPandas(run, REPLIES)


ANSWERS = "block long, kind int, numbers binary, counts binary, mass binary, followers binary"


def _with_contexts(added: DataFrame) -> DataFrame:
    """The words each block asked for, with their counts, T and D (0 where no text has them before a word)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, parts = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 2]
        empty = np.empty(0, np.uint64)
        all_of = np.concatenate([np.frombuffer(x, np.uint64) for x in parts["numbers"]] or [empty])
        contexts, which = np.unique(all_of, return_inverse=True)
        mass = np.bincount(which, np.concatenate([np.frombuffer(x) for x in parts["counts"]] or [np.empty(0)]), len(contexts))
        behind = np.bincount(which, np.concatenate([np.frombuffer(x, "<u4") for x in parts["followers"]] or [np.empty(0)]),
                             len(contexts))
        contexts = np.r_[contexts, np.uint64(2**64 - 1)]
        mass, behind = np.r_[mass, 0.0], np.r_[behind, 0.0]
        rows = []
        for block, numbers, counts in zip(asked["block"], asked["numbers"], asked["counts"]):
            own = context_of(np.frombuffer(numbers, np.uint64))
            at = np.searchsorted(contexts, own)
            met = contexts[at] == own
            rows.append((block, 0, numbers, counts, np.where(met, mass[at], 0.0).tobytes(),
                         np.where(met, behind[at], 0).astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    return (added.where("kind = 0 and block >= 0 or kind = 2")
            .select("segment", "kind", "block", "numbers", "counts", "followers")
            .groupBy("segment").applyInPandas(run, ANSWERS))


def _build_filter(grams: DataFrame) -> tuple[DataFrame | None, int, float]:
    """(slices as rows, their number, S). The driver receives one histogram, added up by Spark."""

    def levels(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pdf:
            for kind, h in zip(b["kind"], b["histogram"]):
                n = np.frombuffer(h, np.int64)
                lv = np.flatnonzero(n)
                yield pd.DataFrame({"kind": np.full(len(lv), kind), "level": lv, "n": n[lv]})

    found = (grams.select("kind", "histogram").mapInPandas(levels, "kind long, level long, n long")
             .groupBy("kind", "level").agg(F.sum("n").alias("n")).collect())     # at most 2 x 64 rows
    total = sum(r["n"] * float(count_of(np.array(r["level"]))) for r in found if r["kind"] == 0)
    slices = -(-sum(r["n"] * r["level"] for r in found) * BITS_PER_ENTRY // SLICE_BITS)
    if not slices:
        return None, 0, 0.0

    def deal(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pdf:
            for kind, numbers, lv in zip(b["kind"], b["numbers"], b["counts"]):
                numbers, lv = _salted(np.frombuffer(numbers, np.uint64), kind), np.frombuffer(lv, np.uint8)
                of = (scramble(numbers) % np.uint64(slices)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                numbers, lv, of = numbers[order], lv[order], of[order]
                names, first = np.unique(of, return_index=True)
                if len(of):
                    yield pd.DataFrame({"slice": names, "numbers": [x.tobytes() for x in np.split(numbers, first[1:])],
                                        "levels": [x.tobytes() for x in np.split(lv, first[1:])]})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SLICE_BITS, bool)
        numbers = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["numbers"]])
        lv = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["levels"]]).astype(np.int64)
        for k in range(1, int(lv.max()) + 1):
            own = numbers[lv >= k]
            _, at = _places(own, np.full(len(own), k), slices)
            bits[at.ravel()] = True
        return pd.DataFrame([{"slice": int(pdf["slice"].iloc[0]), "bits": np.packbits(bits, bitorder="little").tobytes()}])

    built = (grams.select("kind", "numbers", "counts").mapInPandas(deal, "slice long, numbers binary, levels binary")
             .groupBy("slice").applyInPandas(fill, "slice long, bits binary"))
    return built, slices, total


def _joined(rows: Iterator[tuple[int, bytes]], first: int, slices: int) -> np.ndarray:
    bits = np.zeros(slices * SLICE_BITS // 8, np.uint8)
    for k, x in rows:
        bits[(k - first) * SLICE_BITS // 8:(k - first + 1) * SLICE_BITS // 8] = np.frombuffer(x, np.uint8)
    return bits


def _ask_shards(blocked: DataFrame, built: DataFrame, slices: int, per_shard: int) -> DataFrame:
    """The levels of the different words and pairs of each block, from the shard of the filter that holds them.
    Every column of ``blocked`` is read, so that its rows are shuffled once for these questions and the scores."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        of, found, block = Words(), [], int(pdf["block"].iloc[0])
        for text in pdf["text"]:
            w = of(text if isinstance(text, str) else None)
            found += [np.unique(w), np.unique(_salted(pairs(w), 1))]
        numbers = np.unique(np.concatenate(found))
        shard = (scramble(numbers) % np.uint64(slices)).astype(np.int64) // per_shard
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        return pd.DataFrame({"block": block, "shard": names, "numbers": [x.tobytes() for x in np.split(numbers[order], first[1:])]})

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked):
            first = int(asked["shard"].iloc[0]) * per_shard
            read = Filter(_joined(zip(held["slice"], held["bits"]), first, per_shard), slices, first)
            for block, numbers in zip(asked["block"], asked["numbers"]):
                lv = read.levels(np.frombuffer(numbers, np.uint64))
                rows.append((block, 1, numbers, lv.astype(np.uint8).tobytes(), None, None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    asked = blocked.groupBy("block").applyInPandas(ask, "block long, shard long, numbers binary")
    shards = cut(built, "filter").withColumn("shard", F.expr(f"slice div {per_shard}"))
    return asked.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(answer, ANSWERS)


class Answers:
    """Levels that shards of the filter have sent to a block."""

    def __init__(self, rows: pd.DataFrame):
        numbers = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["numbers"]] or [np.empty(0, np.uint64)])
        lv = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["counts"]] or [np.empty(0, np.uint8)])
        order = np.argsort(numbers)
        self.numbers, self.found = numbers[order], lv[order]

    def levels(self, numbers: np.ndarray) -> np.ndarray:
        return self.found[np.searchsorted(self.numbers, numbers)].astype(np.int64)


def _salted(numbers: np.ndarray, kind: int) -> np.ndarray:
    return scramble(numbers + np.uint64(0xA0761D6478BD642F)) if kind else numbers


OUT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, modulus: int = 7, out_fold: int = 2) -> DataFrame:
    """See OUT: one row per document. Null texts are empty and consist of the end token. Documents
    whose id falls in ``out_fold`` are scored but not learnt from; equal texts score alike."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length(F.col("text").cast("string"))).alias("c"), F.count("*").alias("n")).first()
    chars = (size["c"] or 0) + size["n"]
    parts, segments = buckets_for(chars, BLOCK_CHARS), buckets_for(chars // 6, SEGMENT_WORDS)
    blocked = _blocks(docs, parts, modulus, out_fold)
    added = cut(_add_up(_count(blocked, parts, segments), segments), "ngrams")
    grams = added.where("block = -1 and kind < 2")
    sums = {r["kind"]: r for r in grams.groupBy("kind").agg(F.sum("known").alias("v"), F.sum("total").alias("n")).collect()}
    n, v = (sums[0]["n"], sums[0]["v"]) if 0 in sums else (0, 0)
    built, slices, total = _build_filter(grams)
    replies, shared = _with_contexts(added), None
    if slices * SLICE_BITS > FILTER_BITS:
        replies = replies.unionByName(_ask_shards(blocked, built, slices, SHARD_SLICES))
    else:
        rows = built.toLocalIterator() if slices else ()
        shared = spark.sparkContext.broadcast(_joined(rows, 0, slices))       # at most FILTER_BITS

    def run(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        read, of = Filter(shared.value, slices) if shared else Answers(replies[replies["kind"] == 1]), Words()
        replies = replies[replies["kind"] == 0]
        numbers = np.concatenate([np.frombuffer(x, np.uint64) for x in replies["numbers"]] or [np.empty(0, np.uint64)])
        order = np.argsort(numbers)
        counts, mass, behind = (np.concatenate([np.frombuffer(x, k) for x in replies[c]] or [np.empty(0, k)])[order]
                                for c, k in (("counts", np.int64), ("mass", float), ("followers", "<u4")))
        numbers = numbers[order]
        base_of = np.log10((counts + 1) / (n + v + 1))
        single_of = (count_of(read.levels(numbers)) + 1) / (total + v + 1)
        end, m = int(np.searchsorted(numbers, np.uint64(END))), len(numbers)
        rows, held, waiting = [], [], 0

        def flush() -> None:
            """Looks up the words of all held documents at once, each different pair once."""
            w = np.concatenate([x for _, _, x in held])
            starts = np.cumsum([0, *(len(x) for _, _, x in held)])[:-1]
            at = np.searchsorted(numbers, w)
            before = np.r_[end, at[:-1]]
            before[starts] = end
            two, which = np.unique(before * m + at, return_inverse=True)
            cw = count_of(read.levels(_salted(two_words(numbers[two // m], numbers[two % m]), 1)))[which]
            d, single = behind[before], single_of[at]
            p = np.log10(np.where(d > 0, (cw + d * single) / np.maximum(mass[before] + d, 1), single))
            sums = [np.add.reduceat(x, starts) for x in (counts[at] > 0, base_of[at], p)]
            for (key, out, x), known, base, full in zip(held, *(x.tolist() for x in sums)):
                rows.append((None if pd.isna(key) else int(key), bool(out), len(x), int(known), n, base, full))
            held.clear()

        for key, text, out in zip(texts["doc_id"], texts["text"], texts["held_out"]):
            held.append((key, out, of(text if isinstance(text, str) else None)))
            waiting += len(held[-1][2])
            if waiting > CHUNK_WORDS:
                flush()
                waiting = 0
        if held:
            flush()
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, OUT)
