"""Whitening, token alignment and the Jaccard join against brute force and on awkward rows."""

import bisect
import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from glasswake.llm import alignment, overlap, queries, whitening

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, node long, row long, key string, block int, n long, component_id int"
A, B = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")


def read(table, columns):
    return duckdb.sql(f"select {columns} from '{DATA}/{table}.parquet'").fetchall()


def awkward(spark, more=()):
    long = "word another third fourth. " * 5_000
    rows = [(1, "Same text here, with more words."), (1, "Same text here, with more words."), (2, None), (3, ""), (4, " \t\n "),
            (5, long), (6, "ä漢字 😀 <|endoftext|> <s> \x1c x y"), (None, "no id"), (7, "same TEXT here, with more words."),
            (2**40, "one\ntwo\none\none two"), (-9, "one"), (8, "a ▁ b"), (9, "　wide  blanks \r\n x"), (10, long + "end"), *more]
    return spark.createDataFrame([(*r, "en", 5, 1, "k", 2, 3, 4) for r in rows], DOCS)


# whitening

def whitened(rows):
    x = np.array([np.floor(np.asarray(v, np.float64) * 1024) + 100_000 for v in rows])
    c = x - x.mean(0)
    cov = c.T @ c / len(x)
    values, vectors = np.linalg.eigh(cov)
    return x.astype(np.int64), c @ vectors[:, ::-1], values[::-1], np.trace(cov)


def test_whitening_equals_a_local_one(spark):
    rows = dict(read("embeddings", "vec_id, embedding"))
    x, projected, values, trace = whitened(list(rows.values()))
    got = collections.defaultdict(dict)
    for r in queries.op11_block_whitening(spark, DATA).collect():
        got[r.vec_id][r.component] = r
    assert set(got) == set(rows) and all(set(g) == set(range(1, 9)) for g in got.values())
    n, sums = len(rows), [sum(c) for c in zip(*x.tolist())]
    for vec, own in zip(rows, x.tolist()):
        assert {r.deviation for r in got[vec].values()} == {sum((n * v - s) ** 2 for v, s in zip(own, sums))}
    for k in range(8):
        have = np.array([got[v][k + 1].whitened for v in rows])
        want = projected[:, k] / np.sqrt(values[k])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert got[next(iter(rows))][k + 1].explained == pytest.approx(values[k] / trace, rel=1e-9)
    assert all(r.identity_error < 1e-9 and r.n == n for g in got.values() for r in g.values())


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(12)]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, float("nan"), 2.0]), (23, [float("inf"), 0.0, 0.0]),
           (24, []), (25, [1.0, 2.0]), (26, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in [*good, *bad, (None, good[0][1]), good[0]]],
                                  "vec_id long, embedding array<double>, row int, part int, x string")
    got = whitening.whiten(frame).collect()
    assert collections.Counter(r.vec_id for r in got) == {**{i: 3 for i in range(1, 12)}, 0: 6, None: 3}
    assert {r.component for r in got} == {1, 2, 3} and all(r.whitened is not None for r in got)
    one = whitening.whiten(frame.where("vec_id = 20 or vec_id = 5")).collect()          # nothing varies
    assert [(r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [
        (k, None, None, None, 0) for k in (1, 2, 3)]
    assert whitening.whiten(frame.where("vec_id >= 20")).count() > 0                      # (25) alone is usual
    assert whitening.whiten(frame.limit(0)).collect() == []


def test_scatter_in_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    monkeypatch.setattr(whitening, "BLOCKS_PER_PART", 2)
    values = np.random.default_rng(5).normal(size=(100, 10))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "row long, v array<double>")
    got = whitening.scatter(whitening.block_matrix(rows, "row", rows["v"], 100, 10))
    assert np.abs(got - values.T @ values).max() < 1e-10


# alignment

def tokens_of(text, lib, sp):
    chars = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if b not in chars.values()]
    chars |= {chr(256 + i): b for i, b in enumerate(rest)}
    a = [(i, bytes(chars[c] for c in lib.id_to_token(i))) for i in lib.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    return a, b


def brute_alignment(rows):
    lib, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    made = []
    for doc_id, text in rows:
        a, b = tokens_of(text or "", lib, sp)
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            made.append((doc_id, 0, 0, [], []))
            continue
        spans = []
        for side in (a, b):
            ends = list(itertools.accumulate(len(x) for _, x in side))
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        links, first = [], 0
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            at = first
            while at < len(spans[1]) and spans[1][at][1] < e:
                links.append((i, spans[1][at][0]))
                at += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        parts = [collections.defaultdict(list) for _ in spans]
        for part, side in zip(parts, spans):
            for i, _, e in side:
                part[cuts[bisect.bisect_left(cuts, e)]].append(str(i))
        groups = [",".join(parts[0][c]) + "|" + ",".join(parts[1][c]) for c in cuts]
        made.append((doc_id, len(a), len(b), links, groups))
    count = collections.Counter(p for *_, links, _ in made for p in links)
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(doc_id, na, nb, len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc_id, na, nb, links, groups in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark):
    got = queries.op12_token_alignment(spark, DATA).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute_alignment(read("documents", "doc_id, text")))


def test_alignment_of_awkward_texts(spark, monkeypatch):
    frame = awkward(spark)
    want = collections.Counter(map(str, brute_alignment([(r.doc_id, r.text) for r in frame.collect()])))
    got = alignment.align_documents(frame, A, B).select(*COLUMNS).collect()
    assert collections.Counter(str(tuple(r)) for r in got) == want
    assert alignment.align_documents(frame.limit(0), A, B).collect() == []


def test_row_product_equals_the_dense_one():
    rng = np.random.default_rng(2)
    for shape in ((7, 5, 9), (1, 1, 1), (20, 40, 3)):
        left, right = rng.random(shape[:2]) < 0.3, rng.random(shape[1:]) < 0.3
        make = lambda m: alignment.Rows(np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1], m.shape[1])
        row, column, value = alignment.row_product(make(left), make(right))
        dense = np.zeros((shape[0], shape[2]), int)
        dense[row, column] = value
        assert (dense == left.astype(int) @ right.astype(int)).all()
        assert (alignment.row_sizes(make(left), make(right)) == left.astype(int) @ right.sum(1)).all()
        turned = make(right).transpose()
        assert (np.diff(turned.starts) == right.sum(0)).all()


def test_links_of_a_text(spark):
    frame = spark.createDataFrame([(1, "unbelievable 漢字 results"), (2, None)], "doc_id long, text string")
    by_range = alignment.links(frame, A, B).collect()
    by_group = alignment.links(frame, A, B, by_group=True).collect()
    row = alignment.align_documents(frame, A, B).where("doc_id = 1").first()
    assert len(by_range) == row.n_links and len(by_group) == row.n_shared
    assert {(r.a, r.b) for r in by_range} == {(r.a, r.b) for r in by_group if r.n_bytes}
    assert sum(r.n_bytes for r in by_range) == len(" unbelievable 漢字 results".encode())


# Jaccard join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_classes(rows, words=5, percent=80):
    sets = []
    for _, text in rows:
        found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [(d, len(s), least.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def same(got, want):
    assert collections.Counter(str(tuple(r)) for r in got) == collections.Counter(map(str, want))


def test_classes_equal_brute_force(spark):
    same(queries.op13_jaccard_classes(spark, DATA).collect(), brute_classes(read("documents", "doc_id, text")))


def edited(rng, n, size, edits):
    base = [f"w{v}" for v in rng.integers(0, 5000, size)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, size, edits):
            own[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [1 << 18, 400])
def test_groups_of_near_copies(spark, monkeypatch, block):
    """Edited copies around the threshold, a passage in every text, copies; also in many blocks."""
    monkeypatch.setattr(overlap, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for n, size, edits in ((25, 100, 2), (15, 60, 1), (10, 30, 1), (8, 8, 0)) for t in edited(rng, n, size, edits)]
    texts += [" ".join(f"y{v}" for v in rng.integers(0, 10**6, k)) + " " + passage for k in (5, 6, 10, 20, 30, 100, 200)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    got = overlap.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, brute_classes(rows))


def test_classes_of_awkward_texts(spark):
    frame = awkward(spark)
    same(overlap.jaccard_classes(frame).collect(), brute_classes([(r.doc_id, r.text) for r in frame.collect()]))
    assert overlap.jaccard_classes(frame.limit(0)).collect() == []


def test_t_occurrence_equals_counting():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lists = [sorted(set(rng.integers(0, 40, rng.integers(1, 60)).tolist())) for _ in range(rng.integers(1, 30))]
        least = int(rng.integers(1, len(lists) + 1))
        count = collections.Counter(m for own in lists for m in own)
        want = {(m, n) for m, n in count.items() if n >= least}
        assert set(overlap.t_occurrence(lists, least)) == want
        assert dict(overlap.merge_skip(lists, least)) == dict(want)
