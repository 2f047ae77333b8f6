"""Counters and first-wins findings over batches in any order, and the quarantine of payloads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glasswake.operators.findings import deduplicate
from glasswake.sources import captures
from glasswake.streaming import live, tables

FINDING = ("scan_id long, page_id long, det_ord int, item_ord long, rule_ord int, pos int, severity string, category string, "
           "title string, description string, url string, asset_url string, evidence string, confidence string")


def findings(n=400):
    rng = random.Random(3)
    return [(rng.randrange(2), rng.randrange(3), rng.choice((1, 3, 5, 11, 31)), i, 0, 0, rng.choice(("high", "low")), rng.choice("ab"),
             "t", "", "u", None, rng.choice(("same" * 20, "other")), "low") for i in range(n)]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_give_the_batch_result(spark, tmp_path, seed):
    made = findings()
    whole = spark.createDataFrame(made, FINDING)
    random.Random(seed).shuffle(made)
    parts = [spark.createDataFrame(made[i::5], FINDING) for i in range(5)]
    path = str(tmp_path / "w")
    assert tables.winners(spark, path) is None
    for i, part in enumerate(parts):
        tables.write_batch(deduplicate(part), i, path)
        tables.write_batch(tables.count_findings(part), i, path + "c")
    for _ in range(2):
        assert rows(tables.winners(spark, path)) == rows(deduplicate(whole).select(*tables.winners(spark, path).columns))
        assert rows(tables.counters(spark, path + "c")) == rows(tables.count_findings(whole))
        tables.write_batch(deduplicate(parts[1]), 1, path)                       # delivered again
        tables.write_batch(tables.count_findings(parts[1]), 1, path + "c")
        tables.fold(spark, path, 2, deduplicate)
        tables.fold(spark, path + "c", 2, tables.sum_counts)
    tables.write_batch(tables.count_findings(parts[1]), 1, path + "c")           # after it was folded
    tables.fold(spark, path + "c", 4, tables.sum_counts)
    tables.fold(spark, path + "c", 3, tables.sum_counts)                         # an older fold changes nothing
    assert rows(tables.counters(spark, path + "c")) == rows(tables.count_findings(whole))


def test_streams_write_the_tables(spark, tmp_path):
    src, made = str(tmp_path / "src"), findings(90)
    for i in range(3):
        spark.createDataFrame(made[i::3], FINDING).coalesce(1).write.mode("append").parquet(src)
    whole = spark.read.parquet(src)
    for start, read, want in ((tables.winner_batches, tables.winners, deduplicate(whole)),
                              (tables.count_batches, tables.counters, tables.count_findings(whole))):
        out, state = str(tmp_path / start.__name__), str(tmp_path / (start.__name__ + "-state"))
        for _ in range(2):                                                       # nothing new the second time
            arriving = live.read_arriving(spark, src, whole.schema, files_per_trigger=1)
            start(arriving, lambda df: df, out, state).trigger(availableNow=True).start().awaitTermination()
            assert rows(read(spark, out).select(*want.columns)) == rows(want)


def test_quarantine(spark, tmp_path):
    good = json.dumps({"title": "t", "user": {"login": "u"}, "files": [{"filename": "a", "additions": 1}]})
    cases = [(1, good, None), (2, good[:-5], "malformed"), (3, "", "empty"), (4, None, "empty"), (5, "[" + good + "]", "malformed"),
             (None, good, "review"), (6, '{"files": 3}', "malformed"), (7, "{}", None), (8, "3", "malformed"), (1, good, None)]
    raw = spark.createDataFrame([(i, "p", p) for i, p, _ in cases], captures.RAW_PULL_REQUESTS)
    sound, rejected = captures.quarantine(raw)
    assert sorted(r.review_id for r in sound.collect()) == [1, 1, 7]
    assert sorted((str(r.review_id), r.reason) for r in rejected.collect()) == sorted((str(i), w) for i, _, w in cases if w)
    folder = tmp_path / "saved"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([json.dumps({"review_id": 1, "pr_url": "p", "payload": good}), '{"review_id": 2, "pay',
                                              json.dumps({"review_id": 3, "pr_url": "p", "payload": "nothing"})]))
    sound, rejected = captures.quarantine(captures.read_raw_pull_requests(spark, str(folder)))
    assert [r.reason for r in rejected.orderBy(F.desc("reason")).collect()] == ["malformed", "line"]
    reviews, files = captures.read_pull_requests(spark, str(folder))
    assert [r.review_id for r in reviews.collect()] == [1] and files.count() == 1
    for _ in range(2):
        captures.write_rejected(rejected, str(tmp_path / "out"), "run")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
