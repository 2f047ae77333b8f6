"""Toxicity: a convolutional text classifier, trained on Spark by parameter mixing.

Words have hashed embeddings (the word and its first four letters), filters of widths 1,
2 and 3 run over the whole text, each filter keeps its maximum, and a logistic layer
weighs the maxima. Embeddings start at zero, so words that training never used add
nothing, however long the text. The decision threshold is set for each language, told by
frequent words of the text itself, and moved to a score of 0.5.

All labelled documents outside fold 0 are used, whole: three of four teach the weights, the
others set the thresholds. They are dealt to shards by a hash of their id. In each round every
shard goes once through its documents from the weights of the round before, and Spark averages
what the shards changed. The model has at most HASHES embeddings, however many documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glasswake.llm.common import cut, fold

HASHES = 1 << 20            # embeddings that a model can have
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
SHARD_DOCS = 4096           # documents that teach one copy of the weights before copies are averaged
CHECK = 4                   # one of so many documents sets thresholds instead of weights
ROUNDS, BATCH, RATE, POSITIVE = 5, 16, 0.1, 4.0
SETTLED = 0.005             # smaller errors of a document are not learnt from
SLOTS = 1 << 27             # bits that tell which ids may be labelled
PIECE = 1 << 14             # words that filters run over at a time
GRID = 1024                 # steps of a logit that thresholds tell apart
KNOWN_WORDS = 300_000       # size of the word cache in a worker
ROWS = 1024                 # rows of a batch that a worker scores at a time

# Frequent words that tell the language of a text.
FREQUENT = (
    ("the", "of", "and", "to", "is", "that", "was", "with"),
    ("der", "die", "und", "das", "den", "von", "mit", "ist"),
    ("les", "des", "est", "dans", "pour", "pas", "qui", "avec"),
    ("los", "del", "el", "y", "por", "con", "las", "para"),
)
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-"


class Features:
    """Per word: hash of the word, hash of its first letters, language told by it (0: none)."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.language = {w: i + 1 for i, ws in enumerate(FREQUENT) for w in ws}

    def __call__(self, text: str | None) -> np.ndarray:
        """Rows (word hash, prefix hash, language) of the text's words."""
        words = (text or "").split()
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > KNOWN_WORDS:
            known.clear()
            new = set(words)
        for raw in new:
            w = raw.lower().strip(MARKS)
            if not w:
                known[raw] = 0
                continue
            b = w.encode()
            known[raw] = ((1 + zlib.crc32(b) % (HASHES - 1)) | (1 + zlib.crc32(w[:4].encode(), 7) % (HASHES - 1)) << 24
                          | self.language.get(w, 0) << 48)
        packed = np.fromiter((known[w] for w in words), np.int64, len(words))
        return np.stack([packed & (HASHES - 1), packed >> 24 & (HASHES - 1), packed >> 48])


def language_of(codes: np.ndarray) -> int:
    """0 if no frequent word occurs; of equal counts the first language."""
    counts = np.bincount(codes, minlength=len(FREQUENT) + 1)[1:]
    return int(counts.argmax()) + 1 if counts.any() else 0


# The columns of the filter matrix: per width and place in it, one for each filter.
TAPS = [(k, j) for k in WIDTHS for j in range(k)]
TOP = FILTERS * len(WIDTHS)
TAP_FILTER = np.concatenate([WIDTHS.index(k) * FILTERS + np.arange(FILTERS) for k, _ in TAPS])
TAP_PLACE = np.repeat([j for _, j in TAPS], FILTERS)
N_FILTER = DIM * len(TAP_FILTER)
N_DENSE = N_FILTER + 2 * TOP + 1
PAD = max(WIDTHS) - 1


@dataclass
class Model:
    """Embeddings in use (sorted hashes, vectors, sums of squared gradients), the other weights
    and theirs, thresholds by language (0 for none), and the numbers of documents used."""

    hashes: np.ndarray
    table: np.ndarray
    slow: np.ndarray
    dense: np.ndarray
    dense_slow: np.ndarray
    thresholds: np.ndarray
    learned: int = 0
    checked: int = 0


def start(seed: int = 42) -> Model:
    rng = np.random.default_rng(seed)
    dense = np.concatenate([rng.normal(0, 0.5, N_FILTER), np.full(TOP, 0.1), rng.normal(0.3, 0.1, TOP), [-1.0]])
    return Model(np.empty(0, np.int64), np.empty((0, DIM), np.float32), np.empty(0, np.float32), dense.astype(np.float32),
                 np.zeros(N_DENSE, np.float32), np.zeros(len(FREQUENT) + 1))


class Net:
    """A worker's copy of the weights. Documents are arrays (2, words) of word and prefix hashes. Only a
    copy that learns has a row for every hash; others have those in use, and row 0 for the rest."""

    def __init__(self, model: Model, learn: bool = False):
        self.row = None
        if learn:
            self.table = np.zeros((HASHES, DIM), np.float32)
            self.table[model.hashes] = model.table
            self.slow = np.zeros(HASHES, np.float32)
            self.slow[model.hashes] = model.slow
        else:
            self.row = np.zeros(HASHES, np.int32)
            self.row[model.hashes] = 1 + np.arange(len(model.hashes))
            self.table = np.concatenate([np.zeros((1, DIM), np.float32), model.table])
        self.dense, self.dense_slow = model.dense.copy(), model.dense_slow.copy()
        self.filters = self.dense[:N_FILTER].reshape(DIM, -1)
        self.bias = self.dense[N_FILTER:N_FILTER + TOP]
        self.out = self.dense[N_FILTER + TOP:-1]
        self.thresholds = model.thresholds

    def pooled(self, docs: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, ...]:
        """Filter maxima of each document (0 where no word answers) and, if asked for, the words, where
        each document begins in them, and where its maxima are."""
        sizes = np.array([d.shape[1] for d in docs])
        begin = np.concatenate([[0], np.cumsum(sizes + PAD)[:-1]])
        total = int((sizes + PAD).sum())
        words = np.zeros((2, total + PAD), np.int32)
        quiet = np.ones(total, bool)
        for d, a in zip(docs, begin):
            words[:, a:a + d.shape[1]] = d
            quiet[a:a + d.shape[1]] = False
        best = np.full((len(docs), TOP), -np.inf, np.float32)
        where = np.zeros((len(docs), TOP), np.int64)
        for a in range(0, total, PIECE):
            b = min(a + PIECE, total)
            at = words[:, a:b + PAD]
            if self.row is not None:
                at = self.row[at]
            answers = (self.table[at[0]] + self.table[at[1]]) @ self.filters
            top = np.zeros((b - a, TOP), np.float32)
            for c, (k, j) in enumerate(TAPS):
                f = WIDTHS.index(k) * FILTERS
                top[:, f:f + FILTERS] += answers[j:j + b - a, c * FILTERS:(c + 1) * FILTERS]
            top[quiet[a:b]] = 0
            first = int(np.searchsorted(begin, a, "right")) - 1
            cuts = np.concatenate([[a], begin[first + 1:np.searchsorted(begin, b)]]) - a
            if not places:
                part = slice(first, first + len(cuts))
                best[part] = np.maximum(best[part], np.maximum.reduceat(top, cuts, axis=0))
                continue
            for i, (x, y) in enumerate(zip(cuts, [*cuts[1:], b - a]), first):
                p = top[x:y].argmax(0)
                high = top[x + p, np.arange(TOP)]
                more = high > best[i]
                best[i][more], where[i][more] = high[more], (a + x + p)[more]
        best = best + self.bias
        return (best, words, begin, where) if places else (best,)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(docs)[0], 0) @ self.out + self.dense[-1]

    def scores(self, docs: list[np.ndarray], languages: list[int]) -> np.ndarray:
        z = self.logits(docs).astype(np.float64) - self.thresholds[np.array(languages, np.int64)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def learn(self, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """One step on a batch; gives the hashes whose embeddings changed."""
        top, words, begin, where = self.pooled(docs, places=True)
        h = np.maximum(top, 0)
        d = (1 / (1 + np.exp(-np.clip(h @ self.out + self.dense[-1], -30, 30))) - y) * np.where(y, POSITIVE, 1.0)
        d = np.where(np.abs(d) < SETTLED, 0, d) / len(docs)
        back = d[:, None] * self.out * (top > 0)
        g = back[:, TAP_FILTER]
        # places behind a document's end are pads: hash 0, no embedding
        at = words[:, where[:, TAP_FILTER] + TAP_PLACE]
        end = (begin + [x.shape[1] for x in docs])[:, None]
        at = np.where(where[:, TAP_FILTER] + TAP_PLACE < end, at, 0)
        g_dense = np.concatenate([
            np.einsum("bc,bcd->dc", g, self.table[at[0]] + self.table[at[1]]).ravel(),
            back.sum(0), d @ h, [d.sum()]]).astype(np.float32)
        moved = (g[:, :, None] * self.filters.T).reshape(-1, DIM)
        moved, at = np.concatenate([moved, moved]), at.reshape(-1)
        some = np.flatnonzero((at > 0) & np.tile(g.reshape(-1) != 0, 2))
        some = some[np.argsort(at[some], kind="stable")]
        hashes, first = np.unique(at[some], return_index=True)
        if len(hashes):
            g_rows = np.add.reduceat(moved[some], first, axis=0).astype(np.float32)
            self.slow[hashes] += (g_rows * g_rows).mean(1)
            self.table[hashes] -= RATE * g_rows / np.sqrt(self.slow[hashes] + 1e-3)[:, None]
        self.dense_slow += g_dense * g_dense
        self.dense -= RATE * g_dense / np.sqrt(self.dense_slow + 1e-3)
        return hashes


def _word_groups(docs: list, words: int = 8 * PIECE) -> Iterator[slice]:
    """Runs of documents with about so many words."""
    first = held = 0
    for i, d in enumerate(docs):
        held += d.shape[1]
        if held >= words:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(docs):
        yield slice(first, len(docs))


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32).reshape(2, -1) for x in column.to_pylist()]


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), doc_id), F.lit(SLOTS)) + 1


def _bitmap(known: DataFrame) -> np.ndarray:
    """Bits of the slots of the known ids: a bounded table, whatever the number of labels."""
    slot = _slot(F.col("doc_id"))
    got = (known.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow())
    out = np.zeros((SLOTS >> 15, 1 << 12), np.uint8)
    for bucket, bits in zip(got.column("bucket").to_pylist(), got.column("bits").to_pylist()):
        out[bucket - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def examples(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """All labelled documents outside fold 0, whole, as numbers: shard, y, language, check, x. Ids that
    are labelled both ways or repeated in ``labels`` count once (1 wins). Texts are not shuffled: numbers of
    documents whose id may be labelled (all that are, by a bitmap of slots) are dealt to the shards with the
    labels, and the label in front of an id's documents is handed on to them."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), folds) != 0)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")))
    shards = max(1, round(known.count() * (CHECK - 1) / CHECK / SHARD_DOCS))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(known))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL").withColumn("slot", _slot(F.col("doc_id")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bits = Features(), bitmap.value
        for b in _parts(batches):
            slot = b.column(2).to_numpy() - 1
            b = b.filter(pa.array((bits[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            xs = [of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([language_of(x[2]) for x in xs], pa.int32()),
                 pa.array([x[:2].astype(np.int32).tobytes() for x in xs], pa.binary())], names=["doc_id", "language", "x"])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = label = None
        for b in batches:
            y, keep = [], []
            for i, (doc_id, given) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist())):
                if given is not None:
                    now, label = doc_id, given
                elif doc_id == now:
                    y.append(label)
                    keep.append(i)
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(y, pa.int32()), *(b.column(c) for c in ("language", "check", "x"))],
                                             names=["shard", "y", "language", "check", "x"])

    found = rows.mapInArrow(features, "doc_id long, language int, x binary")
    dealt = (known.unionByName(found, allowMissingColumns=True)
             .withColumn("order", F.xxhash64(F.lit("toxic"), "doc_id"))
             .withColumn("check", F.pmod("order", F.lit(CHECK)) == 0)
             .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards))))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order", "doc_id", F.col("x").asc_nulls_first())
    return cut(dealt.mapInArrow(labelled, "shard long, y int, language int, check boolean, x binary"), "toxic-examples")


#: A shard's changes: DIM values and a sum of squares per embedding. The other weights follow in rows of the
#: same width under numbers below 0. Whole numbers, so that their sum does not depend on its order.
CHANGES = "hash long, " + ", ".join(f"d{i} long" for i in range(DIM + 1))
UNIT = float(1 << 24)


def _round(rows: DataFrame, model: Model) -> Model:
    """The model after every shard went once through its documents."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def changes(net: Net, touched: np.ndarray) -> pa.RecordBatch:
        old, at = shared.value, np.flatnonzero(touched)
        # rows of zeros for hashes that the model did not have
        _, here, there = np.intersect1d(at, old.hashes, assume_unique=True, return_indices=True)
        before = np.zeros((len(at), DIM + 1), np.float32)
        before[here] = np.c_[old.table[there], old.slow[there]]
        rest = np.concatenate([net.dense - old.dense, net.dense_slow - old.dense_slow])
        rest = np.pad(rest, (0, -len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
        moved = np.c_[net.table[at], net.slow[at]] - before
        values = np.rint(np.r_[rest, moved].astype(np.float64) * UNIT).astype(np.int64)
        hashes = np.r_[-1 - np.arange(len(rest)), at]
        return pa.RecordBatch.from_arrays([pa.array(hashes), *(pa.array(v) for v in values.T)],
                                          names=[x.split()[0] for x in CHANGES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, touched, held = None, None, None, []

        def step():
            if held:
                touched[net.learn([x for x, _ in held], np.array([y for _, y in held]))] = True
                held.clear()

        for b in batches:
            for shard, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpacked(b.column(2))):
                if shard != now:
                    if net:
                        step()
                        yield changes(net, touched)
                    net = None                      # one copy at a time
                    now, net, touched = shard, Net(shared.value, learn=True), np.zeros(HASHES, bool)
                held.append((x, y))
                if len(held) == BATCH:
                    step()
        if net:
            step()
            yield changes(net, touched)

    names = [f"d{i}" for i in range(DIM + 1)]
    got = (rows.select("shard", "y", "x").mapInArrow(run, CHANGES).groupBy("hash")
           .agg(*((F.sum(c) / F.count(c) / UNIT).cast("float").alias(c) for c in names)).toArrow())
    shared.destroy()
    hashes = got.column("hash").to_numpy()
    values = np.stack([got.column(c).to_numpy() for c in names], 1)
    order = np.argsort(hashes)
    hashes, values = hashes[order], values[order]
    k = int(np.searchsorted(hashes, 0))
    rest = values[:k][::-1].ravel()                 # number -1 comes first
    net = Net(model, learn=True)
    net.table[hashes[k:]] += values[k:, :DIM]
    net.slow[hashes[k:]] += values[k:, DIM]
    used = np.union1d(model.hashes, hashes[k:]).astype(np.int64)
    return Model(used, net.table[used], net.slow[used], model.dense + rest[:N_DENSE],
                 model.dense_slow + rest[N_DENSE:2 * N_DENSE], model.thresholds)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Without both labels every score is just under 0.5."""
    rows = examples(docs, labels, folds)
    counts = {(r.check, r.y): r["count"] for r in rows.groupBy("check", "y").count().collect()}
    model = start()
    if len([1 for check, _ in counts if not check]) < 2:
        model.thresholds += 1e-6
        model.dense[-1] = 0
        model.dense[N_FILTER:-1] = 0
    else:
        for _ in range(ROUNDS):
            model = _round(rows.where("NOT check"), model)
        model.thresholds = _thresholds(rows.where("check"), model)
    model.learned = sum(n for (check, _), n in counts.items() if not check)
    model.checked = sum(n for (check, _), n in counts.items() if check)
    return model


def _thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """Per language the middle of the widest gap with the best F1 on documents that the filters
    never saw; a language with under 10 of either label takes the threshold of all. All these documents
    are counted by language and step of their logit, so the driver gets a bounded table."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(shared.value)
        for b in batches:
            docs = _unpacked(b.column(2))
            for part in _word_groups(docs):
                z = np.rint(np.clip(net.logits(docs[part]).astype(np.float64), -40, 40) * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], pa.array(z)], names=["language", "y", "z"])

    got = (rows.select("language", "y", "x").mapInArrow(run, "language int, y int, z long")
           .groupBy("language", "z").agg(F.count("y").alias("n"), F.sum("y").alias("hits")).toPandas())
    shared.destroy()

    def best(some) -> float:
        some = some.groupby("z")[["n", "hits"]].sum().sort_index(ascending=False)
        z = some.index.to_numpy() / GRID
        f1 = 2 * some.hits.cumsum().to_numpy() / (some.n.cumsum().to_numpy() + some.hits.sum())
        after = np.r_[z[1:], z[-1] - 2.0]
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)
        k = top[np.argmax((z - after)[top])]
        return float((z[k] + after[k]) / 2)

    def both(some, least: int) -> bool:
        return min(some.hits.sum(), some.n.sum() - some.hits.sum()) >= least

    out = np.zeros(len(FREQUENT) + 1)
    if both(got, 1):
        out += best(got)
    for k in range(len(out)):
        if both(own := got[got.language == k], 10):
            out[k] = best(own)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a worker has few texts twice, as Arrow and as Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def _scores(net: Net, of: Features, texts: list[str | None]) -> Iterator[np.ndarray]:
    docs, languages = [], []
    held = 0
    for t in texts:
        x = of(t)
        docs.append(x[:2])
        languages.append(language_of(x[2]))
        held += x.shape[1]
        if held >= 8 * PIECE:
            yield net.scores(docs, languages)
            docs, languages, held = [], [], 0
    if docs:
        yield net.scores(docs, languages)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; null texts are empty. The model is
    learnt from ``labels`` (doc_id, toxic) outside fold 0. It is broadcast: it has at most HASHES embeddings."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, of = Net(model.value), Features()
        for b in _parts(batches):
            s = np.concatenate([*_scores(net, of, b.column(1).to_pylist()), np.empty(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, in one pass; every column is kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, of = Net(model.value), Features()
        for b in _parts(batches):
            s = np.concatenate([*_scores(net, of, b.column(at).to_pylist()), np.empty(0)])
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
