"""Mixing sources to target weights by weighted fair queueing.

A source's documents stand in shuffled order. The virtual finish time of a document is
the number of words of its source up to and including it, divided by the source's target;
further rounds through the source go on counting. All copies are range-sorted by finish
time and the mix ends at the total budget: at virtual time 1 each source has its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from glasswake.llm.common import WHITE, buckets_for, cut, prefix_sum

WEIGHTS = (5, 2, 1)
MOST_ROUNDS = 3
SIZES = "doc_id long, source string, size long, h long, t long"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words, a hash that shuffles the documents, a hash of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.count_substring_regex(b.column(2), f"[^{WHITE}]+"), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, b.column(3), b.column(4)],
                                             names=["doc_id", "source", "size", "h", "t"])

    return docs.select(*_keys(), F.col("text").cast("string"), F.xxhash64(F.lit("mix"), *_keys()),
                       F.xxhash64("text")).mapInArrow(count, SIZES)


def _keys() -> list[Column]:
    return [F.col("doc_id").cast("long"), F.col("source").cast("string")]


def targets(sizes: dict[str | None, int], weights: Sequence[float], most: int = MOST_ROUNDS) -> dict[str | None, float]:
    """Words each source shall give: the total of all sizes by weight; a target above
    ``most`` times its source is set there and the excess goes to the rest by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0.0
        above = [s for s in rest if unit * weight[s] > most * sizes[s]]
        if not above:
            return fixed | {s: unit * weight[s] for s in rest}
        fixed |= {s: float(most * sizes[s]) for s in above}


def queue(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> tuple[DataFrame, int]:
    """The documents with ``source_size``, ``target`` and the words ``before`` them in their
    source's shuffled order; and the budget. One row per source passes through the driver:
    sources are names of collections, not data that grows with the documents."""
    rows = cut(sized(docs), "sizes")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights)
    spark = docs.sparkSession
    sources = spark.createDataFrame([(s, sizes[s], goal[s]) for s in sizes],
                                    "__s string, source_size long, target double")
    n = buckets_for(rows.count())
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("h", 1) % F.lit(n))
    rows = prefix_sum(rows, ["source"], "__bucket", ["h", "doc_id", "t"], "size", "before")
    rows = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "__bucket")
    return cut(rows, "queue"), int(sum(sizes.values()))


def _need() -> Column:
    """Rounds through its source that a document may be asked for."""
    rounds = F.ceil(F.col("target") / F.col("source_size")).cast("int")
    return F.when(F.col("size") > 0, F.greatest(F.lit(1), F.least(F.lit(MOST_ROUNDS), rounds))).otherwise(0)


def _finish(k: Column) -> Column:
    return (F.col("before") + F.col("size") + k * F.col("source_size")) / F.col("target")


def copies(rows: DataFrame) -> DataFrame:
    """Each document with words once per round, with its virtual finish time."""
    out = rows.withColumn("round", F.explode(F.expr("sequence(0, 2)"))).where(F.col("round") < _need())
    return out.withColumn("finish", _finish(F.col("round")))


ORDER = ("finish", "source", "h", "doc_id", "t", "round")


def last_taken(rows: DataFrame, budget: int) -> Row | None:
    """The last copy, by the global order ORDER, that starts within the budget; None if there is
    no document with words. Finish times are counted in narrow ranges first, so only the range
    in which the budget ends is put in order; shuffled sources fill all ranges alike."""
    n = buckets_for(rows.count())
    ranged = copies(rows).withColumn("__range", F.floor(F.col("finish") * n).cast("long"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("__range").agg(F.sum("size").alias("__n")).withColumn("__upto", F.sum("__n").over(upto))
    crossing = sums.where(F.col("__upto") - F.col("__n") < budget).orderBy(F.col("__range").desc()).first()
    if crossing is None:
        return None
    inside = ranged.where(F.col("__range") == crossing["__range"])
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER]).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("size").over(w), F.lit(0)) + (crossing["__upto"] - crossing["__n"])
    inside = inside.withColumn("__begins", begins).where(F.col("__begins") < budget)
    return inside.orderBy(*[F.col(c).desc_nulls_first() for c in ORDER]).select(*ORDER).first()


def _up_to(last: Row, finish: Column, k: Column) -> Column:
    """Whether round ``k`` of a document is not after ``last`` in ORDER; nulls stand last."""
    of = {c: F.col(c) for c in ORDER[1:-1]} | {"finish": finish, "round": k}
    done = F.lit(True)
    for name in reversed(ORDER):
        at, c = last[name], of[name]
        if at is None:
            done = c.isNotNull() | done
        else:
            done = F.coalesce((c < F.lit(at)) | ((c == F.lit(at)) & done), F.lit(False))
    return done


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix in its order: doc_id, source, size, round, finish of every copy that is taken."""
    rows, budget = queue(docs, weights)
    last = last_taken(rows, budget)
    taken = copies(rows)
    taken = taken.limit(0) if last is None else taken.where(_up_to(last, F.col("finish"), F.col("round")))
    return (taken.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
            .select("doc_id", "source", "size", "round", "finish"))


def taken_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of all its copies in the mix),
    source, t.

    A null text has no words; documents without words are never taken. A null source is a
    source of its own. Equal rows have places of their own in the order.
    """
    rows, budget = queue(docs, weights)
    last = last_taken(rows, budget)
    rounds = F.lit(0)
    for k in range(MOST_ROUNDS if last is not None else 0):
        here = (F.lit(k) < _need()) & _up_to(last, _finish(F.lit(k)), F.lit(k))
        rounds = rounds + here.cast("int")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * rounds).alias("taken"), "source", "t")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with their columns.
    Rows that share id, source and text share what they are given as evenly as possible."""
    taken = taken_words(docs, weights).where("taken > 0")
    per = (taken.groupBy("doc_id", "source", "t")
           .agg(F.sum((F.col("taken") / F.col("size")).cast("int")).alias("n"), F.count("*").alias("m")))
    rows = docs.select(F.struct("*").alias("__row"), *[k.alias(f"__{i}") for i, k in enumerate(_keys())],
                       F.xxhash64("text").alias("__2"))
    cond = F.lit(True)
    for i, c in enumerate(("doc_id", "source", "t")):
        cond = cond & F.col(f"__{i}").eqNullSafe(F.col(c))
    joined = rows.join(per, cond)
    place = F.row_number().over(Window.partitionBy("__0", "__1", "__2").orderBy("__0")) - 1
    times = F.floor(F.col("n") / F.col("m")) + (place < F.col("n") % F.col("m")).cast("int")
    joined = joined.withColumn("__times", times.cast("int")).where("__times > 0")
    return (joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
            .select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
