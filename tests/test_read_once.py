"""Patches are read no oftener, and no further, than their rules need; the results stay those of all lines."""

import datetime

from pyspark.sql import functions as F

from checks import queries as Q
from glasswake.functions import patch as P
from glasswake.operators import change_review as cr, change_rules as R

LINES = ["+} else if (a) {", "+a||b", " a && b", "-x||y", "+a\rb && c", "&&", "", " ", "+skipAuth", "+router.get('/x/admin/y')", "+İ||b",
         "+TODO", "+import a from b", "+await x", "+let open = 1", "+temp", "+console.log(token)", "+PassWord = 'abc'", "+Test_Token", "+plain"]


def _files(spark, patches):
    return spark.createDataFrame([(i // 3, i, "src/services/a.ts", 1, 1, p) for i, p in enumerate(patches)],
                                 "review_id long, file_ord long, path string, additions int, deletions int, patch string")


def _patches():
    turned = ["\n".join(LINES[i:] + LINES[:i]) for i in range(len(LINES))]
    return LINES + turned + ["\n".join(["+import a from b"] * 5 + ["+await x"] * 5 + ["+a||b"] * 5), "+x\n", "\n\n||\n\n\n", None]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_are_found_without_splitting(spark):
    files = _files(spark, _patches())
    got = P.snippets(files, R.CONDITIONAL_SNIPPET, R.WORDS[R.CONDITIONAL][0])
    want = {}
    for r in files.collect():
        lines = (r.patch or "").split("\n")
        at = next((i for i, l in enumerate(lines) if any(w in l for w in ("else if", "||", "&&"))), None)
        if at is not None:
            text = "\n".join(lines[at:at + 3])
            want[r.file_ord] = text[text.startswith("+"):].strip()
    assert {r.file_ord: r.snippet for r in got.collect()} == {k: v for k, v in want.items() if v}
    assert len(want) > 10 and "split(" not in _plan(got)


def test_files_without_a_rules_words_are_not_split(spark):
    files = _files(spark, _patches())
    for only in [*((n,) for n in R.FILE_RULES), ("bypass", "route"), R.FILE_RULES]:
        got = R.file_findings(files, only)
        whole = R.explode_hits(R.with_hits(R.lowered(P.with_lines(files)), only))
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())), only
        assert ("contains(text_" in _plan(got).lower()) == all(n in R.NEEDS for n in only), only


def _views(spark):
    v = Q.Views(spark, "/none")
    v.__dict__["review_files"] = _files(spark, _patches())
    v.__dict__["reviews"] = spark.createDataFrame(
        [(i, "pass", True, datetime.date(1998, 1, 1)) for i in range(20)],
        "review_id long, checks_status string, reviewer_assigned boolean, updated_at date")
    return v


def test_findings_read_once_are_not_written_before(spark, monkeypatch):
    v, names = _views(spark), ("rv_score", "rv_focus_files", "rv_summary", "rv_counts")
    cut, written = Q.cut, []
    monkeypatch.setattr(Q, "cut", lambda df: written.append(df.columns) or cut(df))
    got = {n: sorted(map(str, Q.QUERIES[n](v).collect())) for n in names}
    assert not written
    v.__dict__["review_findings_once"] = v.review_findings
    assert got == {n: sorted(map(str, Q.QUERIES[n](v).collect())) for n in names} and got["rv_focus_files"]


def test_the_search_for_untested_services_reads_a_table_of_its_own(spark, monkeypatch):
    cut, written = cr.cut, []
    monkeypatch.setattr(cr, "cut", lambda df: written.append(df.columns) or cut(df))
    v = _views(spark)
    cr.all_findings(v.reviews, v.review_files, "1998-06-01")
    assert ["review_id", "file_ord", "path", "is_test", "is_service", "logic_changed"] in written


def test_overlay_makes_its_findings_once(spark):
    assert "split(" not in _plan(Q.QUERIES["enrich_overlay"](_views(spark)))


def test_written_hits_hold_only_what_differs(spark):
    files = _files(spark, _patches())
    names = lambda df: df.schema["hits"].dataType.elementType.names
    assert names(cr.file_results(files, texts=False)) == ["rule", "severity", "score_impact"]
    assert names(cr.file_results(files)) == ["rule", "severity", "score_impact", "summary", "snippet"]
    whole = R.explode_hits(cr.file_results(files))
    assert whole.columns == ["review_id", *R.REVIEW_FIELDS]
    short = R.explode_hits(cr.file_results(files, texts=False), texts=False)
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.drop(*R.TEXT_FIELDS).collect())) and short.count() > 20
    assert sorted(map(str, R.file_findings(files, texts=False).collect())) == sorted(map(str, short.collect()))


def test_review_report_reads_patches_once_and_writes_findings_once(spark, monkeypatch):
    v, made, written, cut = _views(spark), [], [], cr.cut
    v.__dict__["reviews"] = v.reviews.withColumns({"pr_url": F.lit("https://github.com/o/r/pull/1"), "status": F.lit("completed")})
    split = cr.split_patch
    monkeypatch.setattr(cr, "split_patch", lambda files: made.append(1) or split(files))
    monkeypatch.setattr(Q, "cut", lambda df: written.append(df.columns) or cut(df))
    assert Q.QUERIES["review_report"](v).count() > 20
    assert len(made) == 1 and not written
