"""Line rules look for words first: what they find is what their patterns alone find."""

from pyspark.sql import functions as F

from glasswake.functions import patch as P
from glasswake.operators import change_review as cr, change_rules as R

LINES = [
    "+const apiKey = 'sk-AbCdEfGhIjKlMnOpQrStUvWx'", "+API_KEY: \"ABCDEFGHIJKLMN\"", "+PassWord = 'abc'", "+x Bearer a.b", "+'RK-abcdefghijklmnopqr'",
    "+Const Secret = 'abcdefg'", "+ADMIN-TOKEN='abc'", "+console.info(Session)", "+Console.log(token)", "+SKIPAUTH", "+testMode  =  true",
    "+mocked auth =", "+Seed_x seed DB", "+Test_Token", "+ToDo TODO", "+x FIXME", "+TEMP", "+Temporary", "+a WORKAROUND", "+quick_fix", "+Quick-Fix",
    "+HardCoded", "+ByPass", "+skip it FOR NOW", "+import a from b", "+await x", "+} else if (a) {", "+a||b", "+a && b", "+let res = 1", "+resolve(validate)",
    "+tmpK", "+let open = 1", "+opened", "+async function x", "+const f = async (", "+reVALIDATe", "+ VALIDATE", "+processorder", "+ ProcessOrder",
    "+a\rPAYMENT", "+a\rreturn x", "+if (a) {", "+If (a) {", "+try", "+throw  new Error", "+return x", "+İreturn x", "+router.get('/x/admin/y')",
    "+router.post(\"/login\")", "+app.put(`/debug`)", "+app.get('/open')", "+{{{{", "+", "+++ b", "-router.use(requireAuth)", "-a", " Password = 'abc'", "@@ -1 +1 @@",
]


def _files(spark, patches):
    return spark.createDataFrame([(i, i, "src/services/a.ts", 1, 1, p) for i, p in enumerate(patches)],
                                 "review_id long, file_ord long, path string, additions int, deletions int, patch string")


def test_words_lose_no_line(spark):
    files = _files(spark, LINES + ["\n".join(LINES), "\n".join(reversed(LINES)), "", None])
    df = R.lowered(P.split_patch(files))
    for pattern in R.WORDS:
        plain = F.filter("added", lambda l: l.rlike(pattern))
        assert df.select(R._matching(pattern).alias("a"), plain.alias("b")).where("a <> b").count() == 0, pattern
    logic = F.size(F.filter("added", lambda l: l.rlike(R.LOGIC)))
    assert df.where(R.logic_line_count() != logic).count() == 0
    vague = F.filter("added", lambda l: l.rlike(R.VAGUE))
    assert df.where(F.size(vague) != F.coalesce(F.size(R._facts_of_lines()["vague"]), F.lit(0))).count() == 0
    assert df.select(F.sum(F.size(vague))).first()[0] >= 3 * 2


def test_lines_are_not_read_without_the_words(spark):
    """A rule reads no line of a text without its words: the plan asks for them first."""
    plan = cr.file_results(_files(spark, ["+x"]))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(low" in plan


def test_runs_and_levels(spark):
    long, deep = "\n".join(["+x"] * 41), "+{{{{"
    rows = R.file_findings(_files(spark, [long, long[3:], deep, "+{{\n+{{", long + "\n x\n" + "\n".join(["+y"] * 71)])).collect()
    assert sorted((r.review_id, r.rule_id[6:], r.severity) for r in rows if r.rule_id.startswith("maint/")) == [
        (0, "complexity-spike", "medium"), (2, "deep-nesting", "medium"), (4, "complexity-spike", "high")]


def test_line_numbers_by_hunk(spark):
    patch = "+a\n b\n@@ -1,2 +10,3 @@ x\n c\n-d\n+e\n+++ f\n@@ -5 +40 @@\n@@ -x\n+g\n@@ -1 +99999999999999999999 @@\n+h"
    rows = P.line_numbers(_files(spark, [patch, None, ""])).orderBy("line_no").collect()
    assert [(r.line_no, r.new_line, r.text) for r in rows] == [
        (0, 1, "+a"), (5, 11, "+e"), (6, 12, "+++ f"), (9, 41, "+g"), (11, None, "+h")]
