"""Reports as nested documents, read back from their pieces."""

import json

from pyspark.sql import functions as F

from glasswake.plans import documents

LINE = ("scan_id long, section_ord int, section string, k0 long, k1 string, k2 long, k3 long, k4 long, body string")


def line(scan, at, section, body, *keys):
    keys = (list(keys) + [None] * 5)[:5]
    return (scan, at, section, *keys, json.dumps(body))


def scan_lines(scan, findings, pages):
    head = {"version": "1.0", "reportType": "r", "generatedAt": None, "sourceApp": {"name": "x", "formatVersion": "1"},
            "scanId": scan, "targetUrl": 'http://a/?q="[{', "status": "completed", "startedAt": None, "pagesScanned": 2}
    out = [line(scan, 0, "target", head), line(scan, 1, "summary", {"findingsCount": findings, "categoryCounts": {"a": 1}}),
           line(scan, 2, "options", {"scanOptions": {"depth": 2, "deep": {"x": [1, "}"]}}}), line(scan, 8, "handoff", {"intendedUse": "i"})]
    out += [line(scan, 3, "finding", {"id": f"f{i % 7}", "evidence": 'a "quoted" \\ ]}', "pageId": None}, i % 3, "c", i) for i in range(findings)]
    out += [line(scan, 4, "page", {"id": i}, i) for i in range(pages)]
    out += [line(scan, 7, "scenario", {"id": "s", "evidence": [{"url": "u"}]}, 1)]
    return out


def read(folder):
    for part in sorted(folder.glob("part-*")):
        yield from part.read_text().splitlines()


def test_scan_documents_are_nested(spark, tmp_path):
    """A hot scan, a small one and one without findings; equal findings are all kept."""
    rows = scan_lines(7, 3000, 5) + scan_lines(1, 1, 1) + scan_lines(3, 0, 0)
    lines = spark.createDataFrame(rows, LINE).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # small parts stay apart
    try:
        pieces = documents.scan_documents(lines)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    documents.write_documents(pieces, str(tmp_path / "out"))
    got = {d["target"]["scanId"]: d for d in documents.parse_documents(read(tmp_path / "out"))}
    assert list(got) == [1, 3, 7]
    for scan, findings, pages in ((7, 3000, 5), (1, 1, 1), (3, 0, 0)):
        d = got[scan]
        assert list(d) == ["version", "reportType", "generatedAt", "sourceApp", "target", "summary", "scanOptions", "findings",
                           "pages", "requests", "thirdPartyScripts", "attackerSimulation", "handoff"]
        assert list(d["target"]) == list(documents.TARGET) and d["target"]["targetUrl"] == 'http://a/?q="[{'
        assert d["sourceApp"] == {"name": "x", "formatVersion": "1"} and d["generatedAt"] is None
        assert d["scanOptions"] == {"depth": 2, "deep": {"x": [1, "}"]}}
        assert d["summary"]["findingsCount"] == len(d["findings"]) == findings
        assert [p["id"] for p in d["pages"]] == list(range(pages)) and d["requests"] == d["thirdPartyScripts"] == []
        assert d["attackerSimulation"] == {"version": "1.0", "scenarios": [{"id": "s", "evidence": [{"url": "u"}]}]}
    # the hot scan lies in several tasks
    assert pieces.where("scan_id = 7").select(F.shiftright("at", 33)).distinct().count() > 1


def test_review_documents_are_nested(spark, tmp_path):
    rows = [line(5, 0, "review", {"id": 5, "pr": {"title": "a, \"b\""}, "focusFiles": None})]
    rows += [line(5, 1, "finding", {"ruleId": f"r{i}"}, i) for i in range(4)] + [line(6, 0, "review", {"id": 6})]
    lines = spark.createDataFrame(rows, LINE.replace("scan_id", "review_id"))
    documents.write_documents(documents.review_documents(lines), str(tmp_path / "out"))
    got = list(documents.parse_documents(read(tmp_path / "out")))
    assert got == [{"id": 5, "pr": {"title": "a, \"b\""}, "focusFiles": None, "findings": [{"ruleId": f"r{i}"} for i in range(4)]},
                   {"id": 6, "findings": []}]


def test_no_lines_no_documents(spark, tmp_path):
    documents.write_documents(documents.scan_documents(spark.createDataFrame([], LINE)), str(tmp_path / "out"))
    assert list(documents.parse_documents(read(tmp_path / "out"))) == []
