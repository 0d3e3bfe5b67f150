import hashlib

import pytest

from testlog.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    rows = [
        (1, "http://a", "x" * 50), (2, "http://b\r\nEvil: 1", "y" * 200), (3, "c", "y" * 200), (4, None, None), (5, "e", ""),
        (6, "f", FAKE * 3 + "tail"), (7, "g", "WARC/1.1\r\n" * 40), (8, "h", "é€" * 500 + FAKE), (9, "i", "q" * 3000 + FAKE * 60),
        (10, "j", "x" * 50), (11, "k", FAKE), (12, "l", "WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 99999\r\n\r\n"),
        (None, "m", "z" * 150), (14, "n", "z" * 150),
    ]
    return rows + [(100 + i, f"u{i}", f"p{i} " * (i % 50) + (FAKE if i % 7 == 0 else "")) for i in range(60)]


def expected(rows):
    first, out = {}, {}
    for page, _, html in rows:
        html = html or ""
        if len(html.encode()) >= 100 and page is not None:
            first[html] = min(first.get(html, page), page)
    for page, _, html in rows:
        html = html or ""
        again = html in first and page != first[html]
        body = html.encode()
        out[page] = ("revisit" if again else "response", first[html] if again else None, len(body), hashlib.sha256(body).hexdigest())
    return out


@pytest.mark.parametrize("split, files", [(1 << 27, 3), (6000, 1), (1500, 2)])
def test_round_trip(spark, tmp_path, split, files):
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(files)
    warc.write_archives(table, str(tmp_path / "w"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = warc.page_records(spark, str(tmp_path / "w")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(out) == len(rows)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out}
    assert got == expected(rows)
    texts = {r.page_id: bytes(r.payload).decode() for r in out if r.payload is not None}
    assert all(texts[p] == (t or "") for p, _, t in rows if p in texts)


def test_no_pages(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(table, str(tmp_path / "w"))
    assert warc.page_records(spark, str(tmp_path / "w")).count() == 0


def test_damaged_tail(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (folder / "a.warc").write_bytes((record.format(1) + record.format(2) + "junk" + record.format(3)).encode())
    assert sorted(r.page_id for r in warc.page_records(spark, str(folder)).collect()) == [1, 2]
