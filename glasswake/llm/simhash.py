"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints within 3 of 64 bits, cut into a ring of four 16-bit segments: by the
pigeonring principle some segment starts a chain whose summed differences stay within
3/4 of a bit per segment for every chain length, that is at most 0, 1, 2 and 3 bits over
one, two, three and four segments. So a pair shares a whole segment and, of the next
one, at least one half; that 24-bit key is what is joined on. Pairs that meet are tested
for the longer chains, and the full distance is computed for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from glasswake.llm.common import cut

BLOCK = 1024
SHINGLE, SEED, DISTANCE = 3, 42, 3


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' hashes. No words: 0."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxh64_digest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digests = [xxh64_digest(joined[a:b], seed)
                   for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    on = bits.sum(0, dtype=np.int64) * 2 > len(digests)
    return int.from_bytes(np.packbits(on).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Words are runs of anything but ASCII white
    space, A-Z in lower case; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 48 - 16 * (i % 4)).bitwiseAND(0xFFFF)


def _keys():
    """The eight (start, half, 24 bits) keys of a fingerprint, as one long each."""
    fp, out = F.col("fp"), []
    for i in range(4):
        nxt = _segment(fp, i + 1)
        for half in range(2):
            part = F.shiftrightunsigned(nxt, 8 * half).bitwiseAND(0xFF)
            out.append(F.lit((2 * i + half) << 24) + F.shiftleft(_segment(fp, i), 8) + part)
    return F.array(*out)


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _near(a: np.ndarray, b: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Chain test from segment ``start`` on, then the full distance, for pairs a, b."""
    x = a ^ b
    ok = np.ones(len(x), bool)
    total = np.zeros(len(x), np.int16)
    for k in range(4):
        shift = (48 - 16 * ((start + k) % 4)).astype(np.uint64)
        total[ok] += _count_bits((x[ok] >> shift[ok]) & np.uint64(0xFFFF))
        ok &= total * 4 <= most * (k + 1)
    return ok & (_count_bits(x) <= most)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (smaller, larger) that connect what the pairs connect, fewer than nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y)))
    return out


def _block_links(fps: np.ndarray, left: np.ndarray, key: int, most: int) -> list[tuple[int, int]]:
    """Links among one block, or between the rows of two blocks (``left`` marks the first)."""
    start = np.int64(key >> 25)
    out_a, out_b = [], []
    two = left.any() and not left.all()
    rows, cols = (fps[left], fps[~left]) if two else (fps, fps)
    for i in range(len(rows)):
        others = cols if two else cols[i + 1:]
        if len(others):
            hit = _near(np.broadcast_to(rows[i], others.shape), others, np.full(len(others), start), most)
            out_b.append(others[hit])
            out_a.append(np.full(int(hit.sum()), rows[i]))
    if not out_a:
        return []
    return _forest(np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64))


def links(fps: DataFrame, most: int = DISTANCE) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp) that connect all those within
    ``most`` bits. Rows that share a key meet in blocks of about 1,024; a larger set is cut
    into blocks and each two of them meet in a task of their own, giving back no more links
    than rows, so no set has to fit in one task and no list of all pairs is made."""
    if not 0 <= most <= 3:
        raise ValueError("four segments find distances up to 3")
    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = keyed.join(shared, "key").select(
        "key", "fp", blocks.alias("m"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    met = met.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")).select(
        "key", "fp", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        (F.col("own") <= F.col("other")).alias("first"))
    parts = met.sparkSession.conf.get("spark.sql.shuffle.partitions")
    met = met.repartition(int(parts), "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, _, p, q, _ = cols
            new = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            yield from emit([c[:last] for c in cols], new[:-1])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield from emit(held, np.array([], np.int64))

    def emit(cols, cuts) -> Iterator[pa.RecordBatch]:
        key, fp, p, q, first = cols
        if not len(key):
            return
        fp = fp.view(np.uint64)
        bounds = np.r_[0, cuts, len(key)].astype(np.int64)
        sizes = np.diff(bounds)
        out: list[tuple[int, int]] = []
        pairs = bounds[:-1][sizes == 2]               # most sets are pairs: all at once
        same = pairs[p[pairs] == q[pairs]]
        hit = same[_near(fp[same], fp[same + 1], key[same] >> 25, most)] if len(same) else same
        out += zip(*(np.sort(np.c_[fp[hit], fp[hit + 1]].view(np.int64), 1).T.tolist())) if len(hit) else []
        done = set(same.tolist())
        for at, size in zip(bounds[:-1].tolist(), sizes.tolist()):
            if size > 1 and at not in done:
                s = slice(at, at + size)
                left = first[s].astype(bool) if p[at] != q[at] else np.ones(size, bool)
                if p[at] != q[at] and left.all():
                    continue
                out += _block_links(fp[s], left, int(key[at]), most)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) is connected with.

    Large-star and small-star steps: each hands every node its smallest known neighbour, and
    paths shrink by halves. Every step is written to the shared folder.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .where("a <> b").distinct())
        up = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        edges = cut(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that
    links reach). Equal fingerprints are one node, so copies are never paired. A null id is
    never the component's id unless the component has no other."""
    fps = cut(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = cut(nodes, "nodes")
    comp = components(links(nodes, most))
    rooted = (nodes.join(comp, nodes["fp"] == comp["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return (fps.join(by_fp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, one for each group: the smallest id; of repeated rows with that id
    any one. Documents without an id are all kept, as nothing names them."""
    found = near_duplicates(docs, shingle, seed, most)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(keep, F.col("doc_id").cast("long") == F.col("__id")).dropDuplicates(["__id"]).drop("__id")
    return named.unionByName(docs.where("doc_id IS NULL"))
