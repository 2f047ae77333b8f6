"""Document fingerprints from improbable features.

Every window of 64 bytes has an entropy. Text windows crowd around a typical entropy, so a
window counts as the rarer the further its entropy lies from there. In each run of 64
neighbouring windows the rarest gets a vote; windows with enough votes are the document's
features. Features go into a chain of Bloom filters, a new one after 160, and two chains
are compared by the overlap of their bits beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


WINDOW, RUN, VOTES = 64, 64, 16
BITS, PROBES, PER_FILTER = 2048, 5, 160
TYPICAL = 3.9               # bits of entropy that most windows of text have
LEAST = 1.0                 # windows under this are padding or repetition and never features
DOCS_PER_RANGE = 4096

_c = np.arange(WINDOW + 2, dtype=np.float64)
#: c * log2(c) in millionths, so that sliding sums are exact
_CLOG = np.round(np.where(_c > 0, _c * np.log2(np.maximum(_c, 1)), 0) * 1e6).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, in thousandths of a bit, of every whole window of ``data`` (bytes)."""
    n = len(data)
    before = np.ones(n, np.uint8)        # equal bytes among the window's last 65, itself included
    behind = np.ones(n, np.uint8)        # likewise ahead
    for lag in range(1, WINDOW + 1):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        behind[:-lag] += same
    counts = np.bincount(data[:WINDOW], minlength=256)
    enter = before[WINDOW:]
    leave = behind[:n - WINDOW]
    step = (_CLOG[enter] - _CLOG[enter - 1]) - (_CLOG[leave] - _CLOG[leave - 1])
    total = np.r_[_CLOG[counts].sum(), step].cumsum()
    return ((np.log2(WINDOW) - total / 1e6 / WINDOW) * 1000 + 0.5).astype(np.int64)


def _hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of equal-length rows of bytes."""
    width = rows.shape[1]
    factors = np.cumprod(np.full(width, 0x9E3779B97F4A7C15, np.uint64)) | np.uint64(1)
    x = (rows.astype(np.uint64) * factors).sum(1, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def features(data: bytes) -> np.ndarray:
    """Hashes of the improbable windows in the order of the text. A text shorter than a window
    is one feature; an empty text has none."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= WINDOW:
        return _hash(np.r_[raw, np.zeros(WINDOW - len(raw), np.uint8)][None, :]) if len(raw) else np.empty(0, np.uint64)
    e = entropies(raw)
    n = len(e)
    rarity = np.abs(e - int(TYPICAL * 1000))
    rarity[e < LEAST * 1000] = -1
    # the largest rarity of a run, the first of equals: one number carries both
    key = (rarity << 32) + (n - np.arange(n))
    run = min(RUN, n)
    top, span = key, 1
    while span < run:
        hop = min(span, run - span)
        top = np.maximum(top[:-hop], top[hop:])
        span += hop
    at = n - (top & 0xFFFFFFFF)
    votes = np.bincount(at, minlength=n)
    chosen = np.flatnonzero((votes >= min(VOTES, run)) & (rarity >= 0))
    if not len(chosen):
        chosen = np.array([int(key.argmax())])
    return _hash(np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[chosen])


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters, one row of bits each. A repeated feature takes no place."""
    if not len(hashes):
        return np.zeros((0, BITS), bool)
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = np.zeros((-(-len(hashes) // PER_FILTER), BITS), bool)
    of = np.arange(len(hashes)) // PER_FILTER
    for k in range(PROBES):
        out[of, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return out


def digest(data: bytes) -> np.ndarray:
    return chain(features(data))


def as_text(filters: np.ndarray) -> str:
    return base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8), axis=1).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. For each filter of the shorter chain its best overlap with the other chain, between
    what chance gives and the most that is possible; the mean, weighed by features held. Two
    empty digests are alike (1), an empty and another are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a.sum() > b.sum():
        a, b = b, a
    na, nb = a.sum(1).astype(np.float64), b.sum(1).astype(np.float64)
    shared = a.astype(np.float32) @ b.astype(np.float32).T
    chance = na[:, None] * nb[None, :] / BITS
    most = np.minimum(na[:, None], nb[None, :])
    norm = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((norm * na).sum() / na.sum())


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the beginning of the following document."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _ranges(docs: DataFrame, per: int) -> list[int]:
    """Ids that cut the table, by descending id, into ranges of about ``per`` documents."""
    n = docs.count()
    parts = -(-n // per)
    if parts < 2:
        return []
    at = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    return sorted(set(at or []))


def fingerprints(docs: DataFrame, per: int = DOCS_PER_RANGE) -> DataFrame:
    """See OUT: one row per document, compared with its edited text and with the document that
    follows by descending id (null ids last, repeated ids by their texts' hash); after the last
    comes the first. Null texts are empty. A single document follows itself.

    The table is cut into ranges of ids. Texts travel once, to their range; the first document of
    a range also travels to the range before it. What the driver holds is one id per range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = _ranges(rows, per)
    at = len(bounds) - F.size(F.filter(F.lit(bounds or [0]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("range", F.coalesce(at, F.lit(len(bounds))).cast("int"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # the first document of each range, and the range that needs it as a guest
    top = F.max_by(F.struct("doc_id", "h"), F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), -F.col("h").cast("decimal(20,0)")))
    firsts = sorted(rows.groupBy("range").agg(top.alias("t")).collect(), key=lambda r: r["range"])
    guests = rows.sparkSession.createDataFrame(
        [(f["range"], f["t"]["doc_id"], f["t"]["h"], firsts[i - 1]["range"]) for i, f in enumerate(firsts)],
        "g_range int, g_id long, g_h long, host int")
    hit = ((F.col("range") == F.col("g_range")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")))
    rows = rows.join(F.broadcast(guests), hit, "left").drop("g_range", "g_id", "g_h")
    rows = rows.select("doc_id", "text", "h", F.explode(F.when(
        F.col("host").isNull(), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")),
                F.struct(F.col("host").alias("r"), F.lit(1).alias("guest"))))).alias("x"))
    rows = rows.select("x.r", "x.guest", "doc_id", "h", "text")
    dealt = rows.repartition(max(1, len(firsts)), "r").sortWithinPartitions(
        "r", "guest", F.col("doc_id").desc_nulls_last(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                   # (range, id, text, digest) that waits for the next
        closed = None
        out: list[tuple] = []
        for batch in batches:
            for r, guest, key, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and closed == r:
                    continue                          # a repeated row is one guest
                own = digest(text.encode())
                if held is not None and held[0] == r:
                    out.append(compare(held, (r, key, text, own)))
                held = (r, key, text, own)
                if guest:
                    closed, held = r, None
                if len(out) >= 500:
                    yield arrow(out)
                    out = []
        if out:
            yield arrow(out)

    def compare(a, b) -> tuple:
        changed = edited(a[2], b[2]).encode()
        other = digest(changed)
        return (a[1], len(a[2]), hashlib.sha256(changed).hexdigest(), as_text(a[3]), as_text(other),
                likeness(a[3], other), likeness(a[3], b[3]))

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in OUT.split(", ")]

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return dealt.mapInArrow(run, OUT)
