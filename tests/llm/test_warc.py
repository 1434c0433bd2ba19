import hashlib

from siteloom.llm import warc

SCHEMA = "page_id long, url string, html string, address string, payload string"


def test_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    data = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u\\r\\\\n\r\\", "small"), (9, "", "e"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", "n" * 2000)]
    df = spark.createDataFrame([(*r, "a", "p") for r in data], SCHEMA).repartition(3)
    sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    want = sorted(
        [(i, len((h or "").encode()), sha(h), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, _, h in data],
        key=repr,
    )
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    assert sorted((tuple(r) for r in warc.archive_digest(spark, path).collect()), key=repr) == want
    assert spark.read.parquet(f"{path}/payloads").count() == 6
    records = {r.page_id: bytes(r.record) for r in warc.records_with_payload(spark, path).collect()}
    for i, url, html in data:
        head, _, rest = records[i].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4
        assert fields["WARC-Payload-Digest"] == "sha1:" + sha(html)
        body = rest[:-4].partition(b"\r\n\r\n")[2]
        assert body == (b"" if i in (1, 2) else (html or "").encode())
        assert fields.get("WARC-Target-URI") == (url and url.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n"))
    assert {r.page_id: r.url for r in warc.read_records(spark, path).collect()} == {i: u for i, u, _ in data}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
