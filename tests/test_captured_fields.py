"""Fields of captures: storage as JSON, headers, previews, international hosts, assets by body."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glasswake.functions import hosts, json_text, urls as U
from glasswake.operators import content, findings as fi, probes
from glasswake.plans.site_scan import Captures, site_scan
from glasswake.sources import captures
from glasswake.sources.asset_store import AssetStore


@pytest.mark.parametrize("text, want", [
    ('{"b":1,"a":[1,2.50,{ },[ ]],"c":"x\\u0041\\/\\n \\" \\\\"}',
     '{\n  "b": 1,\n  "a": [\n    1,\n    2.5,\n    {},\n    []\n  ],\n  "c": "xA/\\n \\" \\\\"\n}'),
    ("[]", "[]"), ("null", "null"), ("[1e3,1.0,-0,1e-7]", "[\n  1000,\n  1,\n  0,\n  1e-7\n]"),
    ("not json", None), ("", None), (None, None), ('{"a":}', None),
])
def test_indented(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(json_text.indented("t", 400).alias("p")).first().p == want


def test_indented_is_cut_and_marked(spark):
    texts = ['{"k":"' + "\\n" * 9000 + '"}', "[" + ",".join(["12"] * 5000) + "]", "[" + ",".join(["1"] * 79) + "]",
             "[" + ",".join(["1"] * 80) + "]", '"' + "é" * 398 + '"', '"' + "é" * 399 + '"']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(json_text.indented("t", 400).alias("p"))
    for text, row in zip(texts, df.collect()):
        whole = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        assert row.p == (whole[:400] + "\n…" if len(whole) > 400 else whole)


def test_probe_evidence_shows_indented_json(spark):
    rows = [(1, "/api/users", "u", 200, "application/json", '{"email":"a@b.c"}'),
            (1, "/admin", "u", 200, "text/html", '{"email":"a@b.c"}')]
    df = spark.createDataFrame(rows, "scan_id long, path string, url string, status int, content_type string, body string")
    got = {r.det_ord * 10 + r.rule_ord: r.evidence for r in probes.probe_findings(df).collect()}
    assert got[310].endswith('Preview:\n{\n  "email": "a@b.c"\n}')
    assert got[311].endswith('Preview:\n{"email":"a@b.c"}')


def test_international_hosts_equal_the_codec(spark):
    rnd = random.Random(3)
    letters = "abcxyz-019äéßñüжшщ中文字日本語한국😀𐍈ωλ"
    labels = ["münchen", "ليهمابتكلموشعربي", "3年b組金八先生", "ü" * 60, "a" * 50 + "é", "plain", ""]
    labels += ["".join(rnd.choices(letters, k=rnd.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in labels], "h string").select(F.expr(hosts.ascii_host("h")).alias("a"))
    for label, row in zip(labels, df.collect()):
        assert row.a == (label if label.isascii() else "xn--" + label.encode("punycode").decode())


@pytest.mark.parametrize("raw, want", [
    ("https://BÜCHER.example:443/ä", "https://xn--bcher-kva.example/%C3%A4"),
    ("http://www。ｅｘａｍｐｌｅ．com/", "http://www.example.com/"),
    ("https://a.中文.b.한국/x?q=1", "https://a.xn--fiq228c.b.xn--3e0b707e/x?q=1"),
])
def test_international_addresses(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert U.with_normalized(df, "raw", "n").first().n == want


PAGES = "scan_id long, page_id long, url string, html string, headers_json string, content_type string, storage_json string"


def _pages(spark):
    stored = '{"localStorage":{"b":"1","auth_token":"Bearer abcdefgh123456789012","b":"2","n":null},"sessionStorage":{"z":"{}"}}'
    return spark.createDataFrame([
        (1, 1, "https://h.io/", "", '{"Content-Type":"text/html"}', None, stored),
        (1, 2, "https://h.io/2", "", None, "text/plain", None),
        (1, 3, "https://h.io/3", "", "broken", None, "broken"),
        (1, 4, "https://h.io/4", None, "{}", None, '{"localStorage":null}'),
        (None, None, None, None, None, None, '{"sessionStorage":{}}')], PAGES)


def test_storage_json_keeps_order(spark):
    got = [tuple(r) for r in captures.storage_items(_pages(spark)).orderBy("page_id", "storage_type", "item_ord").collect()]
    where = (1, 1, "https://h.io/")
    assert got == [(*where, 0, "localStorage", "b", "1"), (*where, 1, "localStorage", "auth_token", "Bearer abcdefgh123456789012"),
                   (*where, 2, "localStorage", "b", "2"), (*where, 3, "localStorage", "n", None), (*where, 0, "sessionStorage", "z", "{}")]
    assert captures.storage_items(_pages(spark).limit(0)).count() == 0


def test_content_type_from_capture_or_headers(spark):
    got = {r.page_id: r.content_type for r in captures.pages(_pages(spark)).collect()}
    assert got == {1: "text/html", 2: "text/plain", 3: None, 4: None, None: None}


def test_readers_fill_fields_that_older_files_lack(spark, tmp_path):
    _pages(spark).drop("storage_json", "content_type").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(1, 1, 1, '{"A":"b"}')], "scan_id long, page_id long, request_id long, response_headers_json string"
                          ).write.parquet(str(tmp_path / "r"))
    page = captures.read_pages(spark, str(tmp_path / "p")).where("page_id = 1").first()
    assert page.content_type == "text/html" and page.storage_json is None
    request = captures.read_requests(spark, str(tmp_path / "r")).first()
    assert request.response_headers == {"A": "b"} and request.request_headers is None and request.response_snippet is None


def test_scan_reads_storage_of_pages_and_gates_by_defaults(spark):
    pages = captures.pages(_pages(spark).where("page_id IS NOT NULL"))
    scans = spark.createDataFrame([(1, "https://h.io/")], "scan_id long, target_url string")
    answers = spark.createDataFrame([(1, "/.env", "https://h.io/.env", 200, "text/plain", "A=b")],
                                    "scan_id long, path string, url string, status int, content_type string, body string")
    rules = ("storage", "storage_secrets", "probes")
    found = site_scan(Captures(scans=scans, pages=pages, as_of=0, responses=answers), rules)
    assert {r.det_ord for r in found.collect()} == {fi.DET["localStorage"]}      # probes are off by default


def _assets(spark, rows):
    return spark.createDataFrame(rows, "asset_url string, body string")


def _shown(df):
    cols = [*fi.ORDER, "severity", "title", "asset_url", "evidence"]
    return sorted(map(str, df.select(cols).collect()))


def test_equal_bodies_are_scanned_once(spark, tmp_path):
    hot = 'password = "kJ8s7d6f5g4h"; fetch("/internal/x")\n//# sourceMappingURL=a.js.map'
    first = _assets(spark, [(f"https://c{i}.io/a.js", hot) for i in range(300)] + [
        ("https://d.io/b.js", "DB_PASSWORD=abcd1234xyz"), ("https://d.io/b.js", "DB_PASSWORD=abcd1234xyz"),
        (None, hot), ("https://e.io/none.js", None), ("https://e.io/empty.js", "")])
    second = first.unionByName(_assets(spark, [("https://new.io/c.js", hot), ("https://new.io/d.js", 'fetch("/debug")')]))
    store = AssetStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.findings(first)
    store.add(first)
    assert store.scanned().count() == 3                       # hot, b.js and the empty body
    token = store.add(second)
    assert store._read("scanned").where(F.col("token") == token).count() == 1
    store.add(second)
    assert store.scanned().count() == 4
    direct = content.content_findings(content.bundle_bodies(second.dropDuplicates())).where("asset_url IS NOT NULL")
    assert _shown(store.findings(second).where("asset_url IS NOT NULL")) == _shown(direct)
    assert "digest" in store.findings(second).columns


def test_a_run_that_stops_before_its_digests_changes_nothing(spark, tmp_path):
    assets = _assets(spark, [("https://a.io/a.js", 'fetch("/debug")')])
    store = AssetStore(spark, str(tmp_path / "s"))
    store.add(assets)
    kept = _shown(store.findings(assets))
    spark.read.parquet(f"{store.path}/results").drop("token").write.parquet(f"{store.path}/results/token=0")
    assert kept and _shown(store.findings(assets)) == kept
    other = AssetStore(spark, str(tmp_path / "s"), rules="2")
    assert other.scanned() is None
