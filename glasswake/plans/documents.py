"""Whole reports as nested JSON documents, written as a stream of pieces.

``reports`` gives a report as lines: bounded parts and one line per element of each list. Here
the lines become pieces of text that, read in order, are one nested document per scan or
review, whatever its size: brackets are pieces of their own that sort before and after the
elements of their list, and every element but the first of its list starts with a comma. The
order is one range-partitioned sort of all pieces, so a scan that holds a third of all
findings lies in many tasks and files, and never in one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from glasswake.plans.lineage import cut

# The names and order of the parts of a document.
META = ("version", "reportType", "generatedAt", "sourceApp")
TARGET = ("scanId", "targetUrl", "normalizedOrigin", "status", "startedAt", "finishedAt", "pagesScanned", "requestsCaptured")
SCAN_LISTS = {"finding": "findings", "page": "pages", "request": "requests", "script_domain": "thirdPartyScripts",
              "scenario": "scenarios"}
SIMULATION = ("attackerSimulation", "1.0")

OPEN, ELEMENT, CLOSE = 0, 1, 2
SORT = ["section_ord", "edge", "k0", "k1", "k2", "k3", "k4", "text"]


def _members(body: Column, names: Iterable[str]) -> Column:
    """The named members of a JSON object, as they stand within an object."""
    raw = lambda name: F.to_json(F.try_variant_get(F.parse_json(body), f"$.{name}", "variant"))
    return F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.coalesce(raw(n), F.lit("null"))) for n in names])


def _pieces(lines: DataFrame, key: str, heads: dict[str, Column], lists: dict[str, tuple[int, str, str]],
            first: str) -> DataFrame:
    """Rows (key, sort columns, section, text). ``heads``: the text of bounded parts; ``lists``:
    position and the texts before and after each list, made for every line of ``first``."""
    text = F.col("body")
    for section, made in heads.items():
        text = F.when(F.col("section") == section, made).otherwise(text)
    elements = lines.select(key, "section_ord", "section", F.lit(ELEMENT).alias("edge"), "k0", "k1", "k2", "k3", "k4",
                            text.alias("text"))
    edges = F.explode(F.array(*[F.struct(
        F.lit(at).alias("section_ord"), F.lit(section).alias("section"), F.lit(edge).alias("edge"), F.lit(mark).alias("text"))
        for section, (at, before, after) in lists.items() for edge, mark in ((OPEN, before), (CLOSE, after))]))
    null = {c: F.lit(None).cast(lines.schema[c].dataType) for c in ("k0", "k1", "k2", "k3", "k4")}
    brackets = lines.where(F.col("section") == first).select(key, edges.alias("e")).select(
        key, "e.section_ord", "e.section", "e.edge", *[v.alias(c) for c, v in null.items()], "e.text")
    return elements.unionByName(brackets)


def _stream(pieces: DataFrame, key: str, lists: Iterable[str]) -> DataFrame:
    """(key, at, section, text): pieces in the order of ``at``, with commas."""
    placed = cut(pieces.orderBy(key, *SORT).withColumn("at", F.monotonically_increasing_id()))
    element = (F.col("edge") == ELEMENT) & F.col("section").isin(*lists)
    firsts = placed.where(element).groupBy(key, "section").agg(F.min("at").alias("at")).select(
        "at", F.lit(True).alias("is_first"))
    comma = F.when(element & F.col("is_first").isNull(), ",").otherwise("")
    return placed.join(firsts, "at", "left").select(key, "at", "section", "edge", F.concat(comma, "text").alias("text"))


def scan_documents(lines: DataFrame) -> DataFrame:
    """Pieces of one document per scan from the lines of ``reports.ingestion_report``."""
    body = F.col("body")
    heads = {
        "target": F.concat(F.lit("{"), _members(body, META), F.lit(',"target":{'), _members(body, TARGET), F.lit("}")),
        "summary": F.concat(F.lit(',"summary":'), body),
        "options": F.concat(F.lit(',"scanOptions":'), F.coalesce(F.get_json_object(body, "$.scanOptions"), F.lit("{}"))),
        "handoff": F.concat(F.lit(',"handoff":'), body, F.lit("}")),
    }
    lists = {section: (at, f',"{SCAN_LISTS[section]}":[', "]") for at, section in enumerate(SCAN_LISTS, 3)}
    name, version = SIMULATION
    at, before, after = lists["scenario"]
    lists["scenario"] = (at, f',"{name}":{{"version":"{version}"{before}', after + "}")
    return _stream(_pieces(lines, "scan_id", heads, lists, "target"), "scan_id", SCAN_LISTS)


def review_documents(lines: DataFrame) -> DataFrame:
    """Pieces of one document per review from the lines of ``reports.review_report``."""
    heads = {"review": F.expr("left(body, length(body) - 1)")}
    lists = {"finding": (1, ',"findings":[', "]}")}
    return _stream(_pieces(lines, "review_id", heads, lists, "review"), "review_id", ["finding"])


def write_documents(pieces: DataFrame, path: str) -> None:
    """Text files that, in the order of their names, hold one document after the other; a piece
    is a line, and JSON may break between any two of them."""
    pieces.orderBy("at").select("text").write.mode("overwrite").text(path)


def parse_documents(lines: Iterable[str]) -> Iterator[dict]:
    """The documents in a stream of pieces, for readers that can hold one of them."""
    held: list[str] = []
    depth = 0
    for line in lines:
        held.append(line)
        depth += _depth(line)
        if depth == 0:
            yield json.loads("".join(held))
            held = []


def _depth(piece: str) -> int:
    """Brackets that a piece opens, less those it closes, outside of strings."""
    depth, quoted, escaped = 0, False, False
    for c in piece:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
    return depth
