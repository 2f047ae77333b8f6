"""A store of review findings that is merged when it is read.

A batch of reviews writes its own rows and nothing else:

    delta/<token>      findings of a batch, sorted by (bucket, review_id)
    reviewed/<token>   the ids that the batch reviewed; they replace all their older findings
    base/<token>       findings carried over by a compaction
    manifest/seq=N     one entry, written last: the batch or compaction N and its token

Every attempt writes below a token of its own. Entry N is created by a write that fails if it is there already, so a batch is visible as a
whole or not at all, a batch that is run again changes nothing, and of two writers that meet
one takes the next number. The manifest also keeps the number of buckets; it may change
at any time, and takes effect with a compaction of the whole store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
ENTRY = "seq long, kind string, batch string, buckets int, only array<int>, upto long, row_count long, token string"


@dataclass(frozen=True)
class Entry:
    """``delta``: a batch. ``base``: a compaction of the buckets ``only`` (null: of all, with
    ``buckets`` from then on) that holds what the entries up to ``upto`` left of them."""

    seq: int
    kind: str
    batch: str | None
    buckets: int
    only: tuple[int, ...] | None
    upto: int
    row_count: int
    token: str


class ReviewStore:
    """Findings of reviews below ``path``, by the latest batch that reviewed each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.first_buckets = spark, path.rstrip("/"), buckets

    def _at(self, kind: str, token: str) -> str:
        return f"{self.path}/{kind}/{token}"

    def entries(self) -> list[Entry]:
        """The manifest in order: a row per batch and compaction, not per review."""
        try:
            rows = self.spark.read.schema(ENTRY).json(f"{self.path}/manifest/seq=*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":     # an unreadable store is not an empty one
                raise
            return []
        return sorted((Entry(r.seq, r.kind, r.batch, r.buckets, tuple(r.only) if r.only is not None else None,
                             r.upto, r.row_count, r.token) for r in rows), key=lambda e: e.seq)

    def _enter(self, entry: Entry) -> bool:
        row = (entry.seq, entry.kind, entry.batch, entry.buckets,
               list(entry.only) if entry.only is not None else None, entry.upto, entry.row_count, entry.token)
        try:
            (self.spark.createDataFrame([row], ENTRY).coalesce(1)
             .write.mode("errorifexists").json(f"{self.path}/manifest/seq={entry.seq}"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            return False
        return True

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("review_id"), F.lit(buckets)).cast("int")

    def commit(self, findings: DataFrame, reviews: DataFrame, batch: str) -> int | None:
        """Add a batch: the findings of ``reviews`` (their ids). Findings of other reviews are
        not part of it. Returns its number; None if a batch of that name is there already."""
        while True:
            known = self.entries()
            if any(e.kind == "delta" and e.batch == batch for e in known):
                return None
            seq = known[-1].seq + 1 if known else 0
            buckets = known[-1].buckets if known else self.first_buckets
            ids = reviews.select("review_id").where("review_id IS NOT NULL").distinct()
            token = uuid.uuid4().hex
            ids.withColumn("bucket", self._bucket(buckets)).write.parquet(self._at("reviewed", token))
            self._write(findings.join(self.spark.read.parquet(self._at("reviewed", token)).select("review_id"),
                                      "review_id", "left_semi"), "delta", token, buckets)
            rows = self.spark.read.parquet(self._at("delta", token)).count()
            if self._enter(Entry(seq, "delta", batch, buckets, None, seq, rows, token)):
                return seq

    def _write(self, rows: DataFrame, kind: str, token: str, buckets: int) -> None:
        """Sorted by bucket and id, so that files can be skipped by either; a review with very
        many findings is cut by the rest of the row."""
        rest = [c for c in ("analyzer_ord", "file_ord", "rule_ord") if c in rows.columns]
        rows = rows.withColumn("bucket", self._bucket(buckets))
        (rows.repartitionByRange("bucket", "review_id", *rest).sortWithinPartitions("bucket", "review_id", *rest)
         .write.parquet(self._at(kind, token)))

    def _live(self) -> tuple[Entry | None, list[Entry], list[Entry]]:
        """Latest compaction of the whole store, later ones of some buckets, and the batches that
        the former does not hold."""
        known = self.entries()
        whole = next((e for e in reversed(known) if e.kind == "base" and e.only is None), None)
        upto = whole.upto if whole else -1
        parts = [e for e in known if e.kind == "base" and e.only is not None and e.seq > (whole.seq if whole else -1)]
        return whole, parts, [e for e in known if e.kind == "delta" and e.seq > upto]

    def read(self) -> DataFrame | None:
        """Findings of every review as its latest batch left them; None for a store without any
        batch. A review that was found clean has no rows."""
        whole, parts, deltas = self._live()
        return self._merge(whole, parts, deltas)

    def _rows(self, kind: str, entry: Entry) -> DataFrame:
        return self.spark.read.parquet(self._at(kind, entry.token)).withColumn("seq", F.lit(entry.seq).cast("long"))

    def _merge(self, whole: Entry | None, parts: list[Entry], deltas: list[Entry],
               only: list[int] | None = None) -> DataFrame | None:
        if whole is None and not deltas:
            return None
        holder: dict[int, Entry] = {b: e for e in parts for b in e.only}        # the latest compaction of a bucket
        upto = lambda bucket: reduce(lambda c, b: F.when(F.col("bucket") == b, F.lit(holder[b].upto)).otherwise(c),
                                     holder, F.lit(-1)) if holder else F.lit(-1)
        asked = (lambda df: df) if only is None else (lambda df: df.where(F.col("bucket").isin(only)))
        pieces = [asked(self._rows("delta", e)).where(F.col("seq") > upto("bucket")) for e in deltas]
        ids = [asked(self._rows("reviewed", e)).where(F.col("seq") > upto("bucket")) for e in deltas]
        if whole:
            taken = list(holder)
            base = asked(self._rows("base", whole))
            pieces.append((base.where(~F.col("bucket").isin(taken)) if taken else base).withColumn("seq", F.lit(-1).cast("long")))
        for e in set(holder.values()):
            own = [b for b, h in holder.items() if h == e]
            pieces.append(asked(self._rows("base", e)).where(F.col("bucket").isin(own)).withColumn("seq", F.lit(-1).cast("long")))
        union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        rows = union(pieces)
        if not ids:
            return rows.drop("seq", "bucket")
        latest = union(ids).groupBy("review_id").agg(F.max("seq").alias("latest"))
        # one row a review on the right: a review with very many findings is split on the left
        kept = rows.join(latest, "review_id", "left").where("latest IS NULL OR seq = latest")
        return kept.drop("seq", "bucket", "latest")

    def hot_buckets(self, batches: int) -> list[int]:
        """Buckets that so many batches or more have touched since their last compaction."""
        _, parts, deltas = self._live()
        since = {b: e.upto for e in parts for b in e.only}
        touched: dict[int, int] = {}
        for e in deltas:            # at most as many rows as buckets from each batch
            for r in self._rows("reviewed", e).select("bucket").distinct().collect():
                if e.seq > since.get(r.bucket, -1):
                    touched[r.bucket] = touched.get(r.bucket, 0) + 1
        return sorted(b for b, n in touched.items() if n >= batches)

    def compact(self, batches: int = 8) -> int | None:
        """Rewrite the hot buckets into one sorted run; the others are not touched."""
        hot = self.hot_buckets(batches)
        return self._compact(hot, None) if hot else None

    def rebucket(self, buckets: int) -> int | None:
        """Rewrite the whole store with another number of buckets, which holds from then on."""
        return self._compact(None, buckets)

    def _compact(self, only: list[int] | None, buckets: int | None) -> int | None:
        known = self.entries()
        whole, parts, deltas = self._live()
        rows = self._merge(whole, parts, deltas, only)
        if rows is None:
            return None
        seq = known[-1].seq + 1
        buckets = buckets or known[-1].buckets
        token = uuid.uuid4().hex
        self._write(rows, "base", token, buckets)
        n = self.spark.read.parquet(self._at("base", token)).count()
        entry = Entry(seq, "base", None, buckets, tuple(only) if only is not None else None, known[-1].seq, n, token)
        # a batch that came meanwhile took the number: what it left is compacted anew
        return seq if self._enter(entry) else self._compact(only, buckets)
