"""Best-fit packing planned on the histogram of piece lengths.

The plan sees only how many pieces there are of each length (at most ``capacity`` numbers),
so its cost and size do not grow with the documents. Longest first, pieces go into the
fullest sequences that still have room; sequences of equal content are handled as one
range. Each piece then takes the planned slot of its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswake.llm.common import ROWS_PER_BUCKET, cut, prefix_sum
from glasswake.llm.tokens import encoded, encoder, ids_crc32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): the pieces of that length
    with ranks from ``first rank`` go to consecutive sequences, at the same offset.

    Equal rest capacities are ranges of sequences; at most one range is split per length,
    so the number of runs depends on ``capacity`` alone.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rests: list[int] = []                              # sorted rest capacities in use
    ranges: dict[int, list[tuple[int, int]]] = {}      # rest -> ranges of sequences
    opened = 0

    def give_back(rest: int, first: int, count: int) -> None:
        if rest and count:
            if rest not in ranges:
                insort(rests, rest)
                ranges[rest] = []
            ranges[rest].append((first, count))

    for length in range(capacity, 0, -1):
        left, rank = histogram.get(length, 0), 0
        while left:
            at = bisect_left(rests, length)
            if at < len(rests):
                rest = rests[at]
                first, count = ranges[rest].pop()
                if not ranges[rest]:
                    del ranges[rest], rests[at]
            else:
                rest, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = rest // length
            full = min(count, left // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - rest + k * length))
                rank += full
            left -= full * each
            give_back(rest - each * length, first, full)
            first, count = first + full, count - full
            if count and left:                         # fewer pieces than fill one more sequence
                for k in range(left):
                    runs.append((length, rank + k, 1, first, capacity - rest + k * length))
                give_back(rest - left * length, first, 1)
                left, first, count = 0, first + 1, count - 1
            give_back(rest, first, count)
    return runs


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of every document: its ids and the end id 0; only a longer one is cut, so that
    all pieces but the first are full. Null texts are empty (one piece of one id)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.zeros(1, enc.dtype).tobytes()
        for batch in batches:
            rows = []
            for key, raw in encoded(enc, batch):
                ids = np.frombuffer(raw + end, enc.dtype)
                at, size = 0, (len(ids) - 1) % capacity + 1
                for k in range(-(-len(ids) // capacity)):
                    rows.append((key, k, at, size, ids_crc32(ids[at:at + size])))
                    at, size = at + size, capacity
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)],
                names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (see PIECES).

    Every row is packed; repeated rows are pieces of their own. Lengths with many pieces
    are ranked in several buckets, so no length has to fit in one task.
    """
    pieces = cut(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}   # at most capacity rows
    runs = sorted(plan(counts, capacity))
    shares = [1] * (capacity + 1)
    for length, n in counts.items():
        shares[length] = -(-n // ROWS_PER_BUCKET)
    several = F.lit(shares)[F.col("length").cast("int")]
    ranked = pieces.withColumn("__one", F.lit(1)).withColumn(
        "__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), several))
    ranked = prefix_sum(ranked, ["length"], "__bucket", ["doc_id", "piece", "start", "ids_crc32"], "__one", "__rank")
    table = np.array(runs, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda i: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(keys, (col(3) << 48) + col(5), side="right") - 1] if len(batch) else table[:0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 3] + col(5) - run[:, 1]), pa.array(run[:, 4])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return (ranked.select(*[f.split()[0] for f in PIECES.split(", ")], F.col("__rank").cast("long"))
            .mapInArrow(take, PIECES + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    return pack(pieces_of(docs, vocabulary, capacity), capacity)
