"""The merge-on-read review store against a dictionary that replaces whole reviews."""

import os
import random

import pytest

from glasswake.sources.review_store import ReviewStore

SCHEMA = "review_id long, analyzer_ord int, file_ord long, rule_ord int, rule_id string, seq int"


def frame(spark, rows):
    return spark.createDataFrame([(r, 1, f, 0, rule, 9) for r, f, rule in rows], SCHEMA).drop("seq")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "review_id long")


def held(store):
    rows = store.read()
    return sorted((r.review_id, r.file_ord, r.rule_id) for r in rows.collect()) if rows is not None else []


def expected(state):
    return sorted(x for rows in state.values() for x in rows)


def files_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


def test_batches_compactions_and_bucket_changes(spark, tmp_path):
    rng, state = random.Random(5), {}
    store = ReviewStore(spark, str(tmp_path / "s"), buckets=4)
    assert store.read() is None and store.compact() is None
    steps = ["batch"] * 3 + ["compact"] + ["batch"] * 2 + ["rebucket"] + ["batch"] * 2 + ["compact", "batch"]
    for n, step in enumerate(steps):
        if step == "batch":
            reviewed = rng.sample(range(12), 5)
            rows = [(r, f, f"{n}-{f}") for r in reviewed for f in range(rng.randrange(3))]
            state |= {r: [x for x in rows if x[0] == r] for r in reviewed}
            store.commit(frame(spark, rows), ids(spark, reviewed), f"b{n}")
        elif step == "compact":
            assert store.compact(batches=2) is not None
        else:
            store.rebucket(7)
            assert store.entries()[-1].buckets == 7
        assert held(store) == expected(state), (n, step)


def test_a_batch_writes_only_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    store = ReviewStore(spark, path)
    store.commit(frame(spark, [(r, f, "old") for r in range(500) for f in range(4)]), ids(spark, range(500)), "first")
    before = files_below(path)
    store.commit(frame(spark, [(r, 0, "new") for r in range(200)]), ids(spark, range(200)), "second")
    after = files_below(path)
    assert all(after[f] == t for f, t in before.items())                   # nothing is rewritten
    assert [e.row_count for e in store.entries()] == [2000, 200]
    assert len(held(store)) == 200 + 300 * 4


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.commit(frame(spark, [(1, 0, "a"), (2, 0, "a")]), ids(spark, [1, 2]), "b")
    assert store.commit(frame(spark, [(1, 0, "other")]), ids(spark, [1, 2]), "b") is None
    assert held(store) == [(1, 0, "a"), (2, 0, "a")]


def test_a_batch_without_an_entry_is_not_seen(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.commit(frame(spark, [(1, 0, "a")]), ids(spark, [1]), "one")
    with monkeypatch.context() as m:
        m.setattr(ReviewStore, "_enter", lambda self, entry: 1 / 0)        # lost before the last step
        with pytest.raises(ZeroDivisionError):
            store.commit(frame(spark, [(1, 0, "b")]), ids(spark, [1]), "two")
    assert held(store) == [(1, 0, "a")]
    store.commit(frame(spark, [(1, 0, "b")]), ids(spark, [1]), "two")
    assert held(store) == [(1, 0, "b")]


def test_two_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    first, second = ReviewStore(spark, path), ReviewStore(spark, path)
    write, done = ReviewStore._enter, []

    def meet(self, entry):
        if self is first and not done:
            done.append(second.commit(frame(spark, [(2, 0, "second")]), ids(spark, [2]), "second"))
        return write(self, entry)

    monkeypatch.setattr(ReviewStore, "_enter", meet)
    first.commit(frame(spark, [(1, 0, "first")]), ids(spark, [1]), "first")
    assert [e.batch for e in first.entries()] == ["second", "first"]
    assert held(first) == [(1, 0, "first"), (2, 0, "second")]


def test_clean_reviews_odd_ids_and_foreign_findings(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.commit(frame(spark, [(1, 0, "a"), (5, 0, "nobody asked")]), ids(spark, [1, None, -3, 1]), "one")
    assert held(store) == [(1, 0, "a")]
    store.commit(frame(spark, []), ids(spark, [1]), "two")                  # found clean
    assert held(store) == []
    store.commit(frame(spark, []), ids(spark, []), "three")                 # an empty batch
    assert held(store) == [] and store.rebucket(3) is not None and held(store) == []


def test_an_unreadable_manifest_is_an_error(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.commit(frame(spark, [(1, 0, "a")]), ids(spark, [1]), "one")
    for f in (tmp_path / "s" / "delta").rglob("part-*"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        store.read().collect()
