import gzip
import hashlib

import pytest

from framelake.llm.common import Workspace
from framelake.llm.warc import _Records, as_responses, read_archives, record_text, warc_revisits, write_archives

BIG = "x" * 1500
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 1000 + "\r\n"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, archive string, payload_bytes string")


def expected(rows):
    best = {}
    for page, _, html, *_ in rows:
        best[html or ""] = max(best.get(html or "", -1), page)
    out = set()
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        first = best[html or ""]
        revisit = len(body) >= 1000 and page != first
        out.add((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a", BIG, "x", "y"), (2, "http://b", BIG, "x", "y"), (3, None, None, "x", "y"), (4, "http://c\r\nX: y", "", "x", "y"), (5, "u", TRICKY, "x", "y")]
    rows += [(6, "u", TRICKY, "x", "y"), (7, "u", "short", "x", "y"), (8, "u", "short", "x", "y"), (9, "u", "é" * 600, "x", "y"), (10, "u", "é" * 499, "x", "y")]
    rows += [(n, f"http://h/{n}", BIG, "x", "y") for n in range(20, 60)]
    got = warc_revisits(spark, pages(spark, rows)).drop("target_uri").collect()
    assert {tuple(r) for r in got} == expected(rows)
    assert len(got) == len(rows)


def test_repeated_rows_are_separate_records(spark):
    got = warc_revisits(spark, pages(spark, [(1, "u", BIG, "", "")] * 3)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {1}


def test_empty_table_and_null_key(spark):
    assert warc_revisits(spark, pages(spark, [])).count() == 0
    (row,) = warc_revisits(spark, pages(spark, [(None, "u", BIG, "", "")])).collect()
    assert row.page_id is None and row.payload_bytes == 1500


def test_archives_are_warc_files(spark, tmp_path):
    records = as_responses(pages(spark, [(1, "http://a", TRICKY, "", ""), (2, "http://b", "z", "", "")]).coalesce(1), "page_id", "url", "html", "2024-01-01T00:00:00Z")
    from pyspark.sql import functions as F

    write_archives(records, str(tmp_path / "out"), F.lit(False))
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "out").glob("*.gz"))
    stream, found = _Records(), []
    for piece in data.split(b"\r\n\r\n"):
        found += stream.feed(piece)
    assert [f["warc-type"] for f, _ in found] == ["response"] * 2
    assert found[0][1].partition(b"\r\n\r\n")[2] == TRICKY.encode()
    back = read_archives(spark, str(tmp_path / "out")).orderBy("row_key").collect()
    assert bytes(back[0].payload) == TRICKY.encode() and back[1].target_uri == "http://b"
    assert back[0].record_id.startswith("<urn:uuid:") and back[0].record_id != back[1].record_id


def test_archives_are_deflated_at_a_low_level(spark, tmp_path):
    from pyspark.sql import functions as F

    words = [hashlib.sha1(str(n).encode()).hexdigest()[: 3 + n % 6] for n in range(500)]
    html = " ".join(words[int(hashlib.sha1(f"w{n}".encode()).hexdigest(), 16) % 500] for n in range(60_000))
    records = as_responses(pages(spark, [(1, "http://a", html, "", "")]).coalesce(1), "page_id", "url", "html", "2024-01-01T00:00:00Z")
    write_archives(records, str(tmp_path / "out"), F.lit(False))
    records.select(record_text(F.lit(False)).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(str(tmp_path / "default"))
    (low,), (default,) = ([p.read_bytes() for p in (tmp_path / d).glob("*.gz")] for d in ("out", "default"))
    assert gzip.decompress(low) == gzip.decompress(default)
    assert len(default) < len(low) < 1.5 * len(default)  # the default level costs several times the CPU seconds


@pytest.mark.parametrize("cut", [1, 5, 40])
def test_a_cut_archive_loses_only_its_last_record(cut):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\n" + b"q" * 50 + b"\r\n\r\n"
    data = (record * 2)[: -4 - cut]
    stream, found = _Records(), []
    for piece in data.split(b"\r\n\r\n"):
        found += stream.feed(piece)
    assert len(found) == 1


def test_workspace_drops_tables(spark):
    work = Workspace(spark, "t")
    assert work.stage(spark.range(3), "a").count() == 3
    work.drop("a")
    with pytest.raises(Exception):
        spark.read.parquet(work.at("a"))


def test_keys_that_are_no_numbers_and_long_payloads(spark):
    big, other = "x" * 20_000_000, "y" * 1200
    rows = [("a", "u", other), ("12", "u", other), ("7", "u", other), ("b-1", "u", "z" * 1500), (None, "u", "z" * 1500), ("c", "u", big), ("d", None, big)]
    got = {r.page_id: r for r in warc_revisits(spark, spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert {k: r.refers_to for k, r in got.items() if k in ("a", "12", "7")} == {"a": "12", "12": None, "7": "12"}
    assert sorted(r.record_type for k, r in got.items() if k in ("b-1", None)) == ["response", "revisit"]
    assert sorted(r.record_type for k, r in got.items() if k in ("c", "d")) == ["response", "revisit"] and {got["c"].payload_bytes, got["d"].payload_bytes} == {20_000_000}
    numbered = warc_revisits(spark, spark.createDataFrame([(3, "u", other), (9, "u", other)], "page_id int, url string, html string"))
    assert numbered.schema["page_id"].dataType.simpleString() == "bigint" and {r.page_id: r.refers_to for r in numbered.collect()} == {3: 9, 9: None}
