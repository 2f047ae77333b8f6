"""Token ids as raw shards, with a minimal perfect hash index from key to place.

Files: one per shard, in ascending key order. A record is a header (flag u16: 1 if the
key is set; key i64; number of ids u32, the end id included), then the ids, little
endian, 2 bytes each for vocabularies up to 65,536 ids and else 4. The end id 0 is the
record separator of Spark's text writer, so executors write the files with the usual
commit protocol to whatever store the shared folder lives in.

Index: keys are dealt by hash into buckets of about 4,096. Each bucket is a minimal
perfect hash of its own: small groups of keys get a seed that sends them to free slots,
until n keys fill n slots. A slot holds a 32-bit fingerprint, shard, byte offset and the
number of records of that key. Looking a key up is one bucket, one seed and one slot.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from glasswake.llm.common import buckets_for, cut, new_folder

SHARD_CHARS = 16_000_000
CACHE_UNITS = 450_000
UNITS_A_CALL, DOCS_A_CALL = 64, 64
CORE_UNITS = 200_000         # the words met first stay in the cache: they are the frequent ones
HEADER = "<HqI"
HEADER_SIZE = struct.calcsize(HEADER)
# Unicode white space, as the tokenizer's own pattern reads it
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Encoder:
    """Ids of whole texts as bytes.

    A byte-level tokenizer never merges across a blank, so a text is the concatenation
    of its blank-led words. Each different word is encoded once by the library and kept
    in a bounded cache; other kinds of tokenizers get whole texts, and so do texts in which
    the string of an added token occurs (the library makes it one id by default).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.width = np.array([len(self.lib.id_to_token(i) or "") for i in range(size)])
        kind = repr(self.lib.pre_tokenizer)
        self.by_word = (self.lib.normalizer is None and "ByteLevel" in kind
                        and "add_prefix_space=False" in kind and "use_regex=True" in kind)
        self.find = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.known: dict[str, bytes] = {}

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, units: Iterable[str]) -> None:
        led, bare, blank = [], [], []
        for u in units:
            (blank if u.isspace() else led if u[0] == " " else bare).append(u)
        self._learn_together(led, "")
        self._learn_together(bare, "\n")        # the tokenizer never merges a line end with the word behind it
        for u in blank:
            self.known[u] = self._raw(u).tobytes()

    def _learn_together(self, units: list[str], between: str) -> None:
        """Units that stay apart when each follows ``between``, by few calls of the library."""
        size = self.dtype.itemsize
        skip = len(between) * size               # a line end is one byte and one id
        for i in range(0, len(units), UNITS_A_CALL):
            part = units[i:i + UNITS_A_CALL]
            text = between + between.join(part)
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum([len(u.encode()) + len(between) for u in part])
            stops = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * size
            raw, at = ids.tobytes(), skip
            for u, stop in zip(part, stops.tolist()):
                self.known[u] = raw[at:stop]
                at = stop + skip

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The words that are new in any of the texts are learned together."""
        out: list[bytes] = [b""] * len(texts)
        units: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if text and (not self.by_word or any(t in text for t in self.special)):
                out[i] = self._raw(text).tobytes()
            elif text:
                units[i] = self.find(text)
        met = set().union(*units.values())
        new = met.difference(self.known)
        if new and len(self.known) + len(new) > CACHE_UNITS:
            self.known = dict(islice(self.known.items(), CORE_UNITS))
            new = met.difference(self.known)
        self._learn(new)
        for i, own in units.items():
            out[i] = b"".join(map(self.known.__getitem__, own))
        return out


def encoded(enc: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(key, ids) of the rows of a batch of keys and texts."""
    for i in range(0, batch.num_rows, DOCS_A_CALL):
        part = batch.slice(i, DOCS_A_CALL)
        yield from zip(part.column(0).to_pylist(), enc.encode_many(part.column(1).to_pylist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its cache lives on over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_shards(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Writes ``docs`` (doc_id, text) as shards below ``path``.

    Null texts are empty (only the end id). Null ids come first. Repeated ids stay in one
    shard, in the order of their texts' hash; equal rows are all kept. Other columns are
    ignored. An empty table gives no shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // SHARD_CHARS))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        size = enc.dtype.itemsize
        for batch in batches:
            out = []
            for key, ids in encoded(enc, batch):
                out.append(struct.pack(HEADER, key is not None, key or 0, len(ids) // size + 1) + ids)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    end = "\0" * encoder(vocabulary).dtype.itemsize
    (rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
     .mapInArrow(records, "record binary")
     .select(F.col("record").cast("string"))
     .write.option("lineSep", end).text(path))


RECORDS = ("shard long, offset long, first_offset long, doc_id long, n_tokens long, "
           "start_in_shard long, ids_crc32 long")


def read_shards(spark, path: str, vocabulary: str) -> DataFrame:
    """The records of the files below ``path``: place, key, number and checksum of ids.
    ``first_offset`` is the place of the first record of the same key."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(vocabulary).dtype
        for batch in batches:
            for name, view in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = view.as_buffer()
                raw = memoryview(content)
                shard = int(re.search(r"part-(\d+)", name.rpartition("/")[2])[1])
                at, start, last, first, rows = 0, 0, None, 0, []
                while at < len(raw):
                    flag, key, n = struct.unpack_from(HEADER, raw, at)
                    key = key if flag else None
                    if not rows or key != last:
                        first, last = at, key
                    ids = np.frombuffer(raw, dtype, n, at + HEADER_SIZE)
                    rows.append((shard, at, first, key, n, start, ids_crc32(ids)))
                    start += n
                    at += HEADER_SIZE + n * dtype.itemsize
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols],
                    names=[f.split()[0] for f in RECORDS.split(", ")])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select("path", "content"))
    return files.mapInArrow(records, RECORDS)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, so different keys stay different."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    step = seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (_mix(h + step) % np.uint64(n)).astype(np.int64)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys + np.int64(0x632BE59B)) % np.uint64(buckets)).astype(np.int64)


def _place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the groups and the slot of each key."""
    n = len(h)
    groups = max(1, n // 4)
    of = ((h >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(groups + 1))
    seeds, slot, free = np.zeros(groups, np.uint32), np.empty(n, np.int64), np.ones(n, bool)
    tries = np.arange(256)
    for g in sorted(range(groups), key=lambda g: bounds[g] - bounds[g + 1]):
        own = order[bounds[g]:bounds[g + 1]]
        at = 0
        while len(own):
            where = _slots(h[own][None, :], (tries + at)[:, None], n)
            good = free[where].all(1)
            if len(own) > 1:
                s = np.sort(where, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                seeds[g], slot[own] = at + k, where[k]
                free[where[k]] = False
                break
            at += 256
    return seeds, slot


def build_index(records: DataFrame) -> DataFrame:
    """One row per bucket: bucket, buckets, base, n, seeds, fingerprints, shards, offsets,
    copies (binary, by slot). Null keys are not indexed; a repeated key points to its first
    record. ``base`` + slot numbers all keys from 0 without a gap."""
    keys = (records.where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min(F.struct("shard", F.col("first_offset").alias("offset"))).alias("p"),
                 F.count("*").alias("copies"))
            .select("doc_id", "p.shard", "p.offset", "copies"))
    keys = cut(keys, "keys")
    buckets = buckets_for(keys.count())

    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(_bucket_of(keys.to_numpy(np.int64), buckets))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _mix(pdf["doc_id"].to_numpy(np.int64))
        seeds, slot = _place(h)
        put = {}
        for name, value, kind in (("fingerprints", h & np.uint64(0xFFFFFFFF), "<u4"),
                                  ("shards", pdf["shard"], "<u4"), ("offsets", pdf["offset"], "<u8"),
                                  ("copies", pdf["copies"], "<u4")):
            by_slot = np.empty(len(h), kind)
            by_slot[slot] = np.asarray(value)
            put[name] = by_slot.tobytes()
        return pd.DataFrame([{"bucket": int(pdf["bucket"].iloc[0]), "buckets": buckets, "n": len(h),
                              "seeds": seeds.astype("<u4").tobytes(), **put}])

    udf = F.pandas_udf(bucket_of, "long")
    index = (keys.withColumn("bucket", udf("doc_id")).groupBy("bucket").applyInPandas(
        build, "bucket long, buckets long, n long, seeds binary, fingerprints binary, "
               "shards binary, offsets binary, copies binary"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    index = cut(index, "mph")
    base = index.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(base, "bucket")


PLACES = "doc_id long, slot long, shard long, offset long, copies long"


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Place of every key (column doc_id) that the index knows. A bucket and the keys that
    fall into it meet in one task; both are about 4,096 rows at most for distinct keys."""
    buckets = (index.select("buckets").first() or [1])[0]
    udf = F.pandas_udf(lambda k: pd.Series(_bucket_of(k.to_numpy(np.int64), buckets)), "long")

    def probe(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(keys):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in PLACES.split(", ")})
        row = index.iloc[0]
        n = int(row["n"])
        k = keys["doc_id"].to_numpy(np.int64)
        h = _mix(k)
        seeds = np.frombuffer(row["seeds"], "<u4")
        seed = seeds[((h >> np.uint64(40)) % np.uint64(len(seeds))).astype(np.int64)]
        slot = _slots(h, seed, n)
        held = np.frombuffer(row["fingerprints"], "<u4")[slot] == (h & np.uint64(0xFFFFFFFF))
        pick = lambda name, kind: np.frombuffer(row[name], kind)[slot].astype(np.int64)
        return pd.DataFrame({"doc_id": k, "slot": slot + int(row["base"]), "shard": pick("shards", "<u4"),
                             "offset": pick("offsets", "<u8"), "copies": pick("copies", "<u4")})[held]

    distinct = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return (distinct.withColumn("bucket", udf("doc_id")).groupBy("bucket")
            .cogroup(index.groupBy("bucket")).applyInPandas(probe, PLACES))


def fetch(records: DataFrame, places: DataFrame) -> DataFrame:
    """The records at ``places`` and the records of the same key behind them."""
    p = places.select("slot", "shard", F.col("offset").alias("first_offset"), F.col("doc_id").alias("__key"))
    return records.join(p, ["shard", "first_offset"]).where("__key = doc_id").drop("__key")


def encode_to_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the shards and the index, then returns every record as read back from the
    files: through the index where it has a key. Columns: doc_id, start, n_tokens,
    ids_crc32, shard, offset, slot (null for records without a key)."""
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    write_shards(docs, vocabulary, path)
    index = build_index(read_shards(spark, path, vocabulary))
    records = read_shards(spark, path, vocabulary)
    places = lookup(docs, index)
    got = fetch(records, places).unionByName(
        records.where("doc_id IS NULL").withColumn("slot", F.lit(None).cast("long")))
    got = cut(got, "records")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (got.groupBy("shard").agg(F.sum("n_tokens").alias("__n"))
            .select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")))
    return (got.join(base, "shard")
            .select("doc_id", (F.col("__base") + F.col("start_in_shard")).alias("start"),
                    "n_tokens", "ids_crc32", "shard", "offset", "slot"))
