import gzip
import hashlib
from collections import Counter

import pytest

from emberlog.llm.warc import arc_records, arc_to_warc, archive_pages, read_arc, read_warc, write_arc


def pages():
    hot, near = "same é " * 200, "same é " * 200 + "x"
    rows = [(i, f"http://h{i % 5}.org/{i}", hot if i % 3 == 0 else f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n" * (i % 90)) for i in range(200)]
    return rows + [(900, "http://x.org/a b\nc", near), (901, None, None), (902, "ftp://x", ""), (903, "http://x.org/", "x" * 999), (904, "http://x.org/", "x" * 999), (905, "http://y.org/", "z" * 1000), (906, "http://y.org/", "z" * 1000), (907, "http://big.org", "漢" * 400_000), (905, "http://y.org/", "z" * 1000), (None, "http://n.org/", "n" * 2000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS record_id").repartition(4)
    best = {}
    for key, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), key if key is not None else -1)
    want = Counter()
    for key, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= 1000 and key is not None and key != best[html]
        want[key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", best[html] if revisit else None] += 1
    assert Counter(map(tuple, archive_pages(df).collect())) == want
    assert archive_pages(df.limit(0)).count() == 0


def test_groups_by_shuffle_and_payloads(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    write_arc(df, arc := str(tmp_path / "arc"))
    assert {r.warc_type for r in read_arc(spark, arc).collect()} == {"warcinfo", "response"}
    for limit, name in ((0, "a"), (10, "b")):
        arc_to_warc(spark, arc, path := str(tmp_path / name), broadcast_groups=limit)
        got = read_warc(spark, path).collect()
        assert Counter(r.record_type for r in got)["revisit"] == 66 + 2
        assert len({r.record_id for r in got}) == len(rows)
        held = {r.payload_digest: bytes(r.payload) for r in got if r.payload is not None}
        assert all((html or "").encode() == held[hashlib.sha1((html or "").encode()).hexdigest()] for _, _, html in rows)


def test_header_versions():
    one = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 22\n1 0 someone\nURL IP-ad\n\nhttp://a b/ 1.2.3.4 20010203040506 text/html 21\nHTTP/1.0 200 OK\r\n\r\nhi\n\ndns:a.org 1.1.1.1 2001 text/dns 3\n\xff\n\x00"
    got = list(arc_records("a.arc", gzip.compress(one)))
    assert [r[5] for r in got] == ["warcinfo", "response", "resource"]
    assert got[1][1] == "http://a b/" and got[1][3] == "2001-02-03T04:05:06Z" and got[1][8] == b"hi" and got[2][8] == b"\xff\n\x00"
    two = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc 4\n2 0\n\nhttp://a/ 1.2.3.4 20010203040506 text/html 404 - - 9 b.arc 4\nbody\n"
    assert [r[8] for r in arc_records("b.arc", two)] == [b"2 0\n", b"body"]
    with pytest.raises(ValueError):
        list(arc_records("c.arc", b"http://a/ 1.2.3.4 2001 text/html 50\nshort"))
