"""Work that may start, and reviews run batch by batch from a stream."""

from glasswake.plans.change_review import startable
from glasswake.streaming.live import review_batches

WORK = "review_id bigint, status string, checks_status string, reviewer_assigned boolean, updated_at date"
FILES = "review_id bigint, file_ord bigint, path string, additions int, deletions int, patch string"
PATCH = "+const a = eval(input)\n+console.log(a)\n+document.body.innerHTML = a\n+// TODO later"


def test_startable(spark):
    states = ("pending", "failed", "running", "done", None)
    work = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "id int, status string")
    assert {r.id for r in startable(work, "scan").collect()} == {0}
    assert {r.id for r in startable(work, "review").collect()} == {0, 1}
    assert startable(work.limit(0), "review").collect() == []


def test_reviews_of_a_stream_replace_older_ones(spark, tmp_path):
    work, out = str(tmp_path / "work"), str(tmp_path / "out")
    content = {1: PATCH, 2: PATCH, 3: PATCH}

    def files(todo):
        rows = [(i, 1, f"src/api/{i}.ts", 2, 0, p) for i, p in content.items()]
        return spark.createDataFrame(rows, FILES).join(todo.select("review_id"), "review_id", "left_semi")

    def run(rows):
        spark.createDataFrame([(i, s, "pass", False, None) for i, s in rows], WORK).write.mode("append").parquet(work)
        stream = review_batches(spark.readStream.schema(WORK).parquet(work), files, "2024-01-01", out, str(tmp_path / "state"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return {(r.review_id, r.rule_id) for r in spark.read.parquet(out).collect()}

    first = run([(1, "pending"), (2, "running"), (3, "failed")])
    assert {i for i, _ in first} == {1, 3}                      # running work is left alone
    of = lambda found, i: {rule for k, rule in found if k == i}
    assert of(first, 1) == of(first, 3) and len(of(first, 1)) > 1
    content[1] = "+const b = 1"
    again = run([(1, "failed"), (2, "pending")])
    assert of(again, 3) == of(first, 3) == of(again, 2)
    assert of(again, 1) < of(first, 1)                          # what the new patch no longer shows is gone
