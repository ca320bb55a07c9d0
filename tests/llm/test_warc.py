from __future__ import annotations

import gzip
import hashlib
import re
from pathlib import Path

import pytest
from compare import both, connect
from pyspark.sql import functions as F

from papyrus.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload_digest string, n string"


def test_query_by_sql(spark, sf_dir):
    ours, theirs = both(spark, connect(sf_dir), queries.op8_warc_archive, queries.oracle_sql()["op8_warc_archive"], sf_dir)
    assert ours == theirs


@pytest.fixture
def pages(spark):
    big, tricky = "é" * 60, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb" + "x" * 100
    rows = [(3, "http://a/ b\r\nX: y", big, None, None), (5, None, big, "d", "n"), (4, "http://c", "short", None, None), (6, "http://c", "short", None, None), (7, "http://d", None, None, None), (8, "http://e", tricky, None, None), (None, "http://f", "no id", None, None), (9, "http://g", "z" * 3_000_000, None, None), (3, "http://a", big, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark, pages, tmp_path):
    warc.write_archive(pages, f"file://{tmp_path}/w")
    found = warc.read_archive(spark, f"file://{tmp_path}/w").collect()
    want = {(r["page_id"], r["html"] or "") for r in pages.collect()}
    assert len(found) == 9
    assert {(r["page_id"], r["payload"]) for r in found if r["record_type"] == "response"} == want - {(5, "é" * 60)}
    again = next(r for r in found if r["record_type"] == "revisit")
    assert (again["page_id"], again["refers_to"], again["payload_bytes"], again["payload_digest"], again["payload"]) == (5, 3, 120, hashlib.sha256(("é" * 60).encode()).hexdigest(), None)


def test_filters_and_skipped_payloads(spark, pages, tmp_path):
    warc.write_archive(pages, f"file://{tmp_path}/w")
    path = f"file://{tmp_path}/w"
    some = warc.read_archive(spark, path, "page_id > 6 and record_type in ('response')")
    assert sorted(r["page_id"] for r in some.collect()) == [7, 8, 9]
    assert [r["page_id"] for r in some.where("page_id = 8").collect()] == [8]
    assert some.count() == 3
    df = warc.read_archive(spark, path)
    assert [r["page_id"] for r in df.where("record_type = 'revisit'").collect()] == [5]
    assert df.count() == 9
    bare = warc.read_archive(spark, path, payload="false")
    assert bare.where(F.col("payload").isNotNull()).count() == 0
    assert bare.agg(F.sum("payload_bytes")).first()[0] == df.agg(F.sum("payload_bytes")).first()[0]
    reader = warc.WarcReader({"path": f"{tmp_path}/w"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), "x")]))
    assert [f.attribute for f in left] == [("payload",)] and len(reader.filters) == 1
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[0] for r in rows} == {"response"} and len(rows) == 8


def test_compressed_archives(spark, pages, tmp_path):
    """Gzip files, and files of one gzip member a record, as archives come."""
    warc.write_archive(pages, f"file://{tmp_path}/w")
    warc.write_archive(pages, f"file://{tmp_path}/z", compression="gzip")
    assert all(f.name.endswith(".gz") for f in Path(tmp_path / "z").glob("part-*"))
    (tmp_path / "m").mkdir()
    for f in Path(tmp_path / "w").glob("part-*"):
        records = [r + b"\r\n\r\n" for r in re.split(rb"\r\n\r\n(?=WARC/1.1\r\nWARC-Type)", f.read_bytes()[:-4]) if r]
        (tmp_path / f"m/{f.name}.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    want = sorted(map(repr, warc.read_archive(spark, f"file://{tmp_path}/w").collect()))
    some = sorted(map(repr, warc.read_archive(spark, f"file://{tmp_path}/w", "page_id > 6 and record_type in ('response')").collect()))
    for folder in ("z", "m"):
        assert sorted(map(repr, warc.read_archive(spark, f"file://{tmp_path}/{folder}").collect())) == want
        assert sorted(map(repr, warc.read_archive(spark, f"file://{tmp_path}/{folder}", "page_id > 6 and record_type in ('response')").collect())) == some


def test_damaged_files(spark, tmp_path):
    (tmp_path / "w").mkdir()
    Path(tmp_path / "w/a.warc").write_bytes(b"no record\r\n\r\n")
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    with pytest.raises(ValueError, match="no WARC record"):
        [r for p in reader.partitions() for r in reader.read(p)]


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert warc.read_archive(spark, f"file://{tmp_path}/w").count() == 0
