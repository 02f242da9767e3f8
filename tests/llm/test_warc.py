import gzip
import hashlib
import io

import pytest

from duskwatch.llm import queries, warc
from duskwatch.llm.common import table


def plain(rows):
    pages = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in pages:
        if len(p) >= 100:
            first[p] = min(first.get(p, (True, 0)), (i is None, i or 0))
    out, used = [], set()
    for i, p in pages:
        digest = hashlib.sha256(p).hexdigest()
        if len(p) < 100 or (first[p] == (i is None, i or 0) and p not in used):
            used.add(p)
            out.append((i, len(p), digest, "response", None))
        else:
            out.append((i, len(p), digest, "revisit", None if first[p][0] else first[p][1]))
    return sorted(out, key=repr)


def test_archive_edges(spark):
    big, other = "ü" * 80, "x" * 99
    rows = [(5, "http://a/ b", big), (3, None, big), (3, "http://c/", big), (None, "http://d/", big), (1, "", other), (2, "http://e/\n", other), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "y" * 300_000), (9, None, "y" * 300_000), (10, "u", "a\nhttp://x 0.0.0.0 2000 text/html 5\n")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, file int").repartition(3)
    assert sorted((tuple(r) for r in warc.archive(pages).collect()), key=repr) == plain(rows)
    assert warc.archive(pages.limit(0)).count() == 0


def test_op1_query(spark, small):
    rows = [tuple(r) for r in table(spark, small, "pages").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op1_warc(spark, small).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nbody\n", b"", b"no header at all\n\n", b"\n" * 5]
    whole = warc.arc_version_block("a.arc.gz", version, "19970101120000")
    for k, b in enumerate(blocks):
        whole += warc.arc_record(f"http://x/{k}", b, version, "19970101120000", "a.arc.gz", len(whole))
    got = list(warc.read_arc(io.BytesIO(whole)))
    assert [c.block for c in got] == blocks and [c.url for c in got] == [f"http://x/{k}" for k in range(4)]
    assert got[0].page_id == 7 and got[0].payload == b"body\n" and got[2].page_id is None and got[2].payload == blocks[2]
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(whole[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(whole.replace(b"Archive-date", b"Another-name"))))


def test_warc_fields(spark, tmp_path):
    pages = spark.createDataFrame([(2, "http://b/", "z" * 200), (1, "http://a/", "z" * 200)], "page_id long, url string, html string").coalesce(1)
    arcs = warc.write_arc(pages, f"{tmp_path}/arc")
    name = warc.convert(arcs, f"{tmp_path}/arc", f"{tmp_path}/warc").first()["file"]
    with gzip.open(tmp_path / "warc" / name) as source:
        info, *records = warc.read_warc(source)
    assert info[0]["warc-type"] == "warcinfo"
    by_type = {f["warc-type"]: (f, b) for f, b in records}
    response, revisit = by_type["response"][0], by_type["revisit"][0]
    assert response["warc-target-uri"] == "http://a/" and response["warc-date"] == "2000-01-01T00:00:00Z"
    assert revisit["warc-refers-to"] == response["warc-record-id"] != revisit["warc-record-id"]
    assert revisit["warc-refers-to-target-uri"] == "http://a/" and revisit["warc-profile"] == warc.REVISIT_PROFILE
    assert revisit["warc-payload-digest"] == response["warc-payload-digest"] and by_type["revisit"][1].endswith(b"\r\n\r\n")
    assert warc.iso_date("19970314") == "1997-03-14T00:00:00Z"


def test_header_lines_of_old_crawlers():
    one, two = (warc.ARC_FIELDS[v].split(" ") for v in (1, 2))
    head = warc.header_of(b"http://a/b c d 10.0.0.1 19970314 text/html; charset=x 12\n", one)
    assert head == {"URL": "http://a/b c d", "IP-address": "10.0.0.1", "Archive-date": "19970314", "Content-type": "text/html; charset=x", "Archive-length": "12"}
    head = warc.header_of(b"http://a/ ::1 19970314101112 text/html 404 - - 5 f.arc 7\r\n", two)
    assert (head["Result-code"], head["Offset"], head["Filename"], head["Archive-length"]) == ("404", "5", "f.arc", "7")
    for bad in (b"http://a/ 10.0.0.1 text/html 12\n", b"http://a/ b c 1997 text/html 12\n", b"http://a/ 10.0.0.1 19970314 text/html x\n"):
        with pytest.raises(ValueError):
            warc.header_of(bad, one)


def test_bad_records_are_left_out_and_counted(spark, tmp_path):
    body, http = b"k" * 150, b"HTTP/1.0 200 OK\r\n\r\n"
    record = lambda url, block: f"{url} 10.0.0.1 19990101000000 text/dns {len(block)}\n".encode() + block + b"\n"
    whole = warc.arc_version_block("a.arc.gz", 1, "19990101000000")
    whole += record("dns:a", body) + record("http://a/x y", http + body) + b"http://bad/ no date 4\nabcd\nmore\n" + record("dns:b", body) + record("http://c/", http + body)
    whole += b"http://short/ 10.0.0.1 19990101000000 text/html 900\nabc"
    (tmp_path / "arc").mkdir()
    with gzip.open(tmp_path / "arc" / "part-0.arc.gz", "wb") as out:
        out.write(whole)
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(whole)))
    files = spark.createDataFrame([("part-0.arc.gz",)], "file string")
    listed = warc.captures(files, f"{tmp_path}/arc")
    assert listed.where("defect is not null").count() == 2 and listed.where("defect is null").count() == 4
    with pytest.warns(UserWarning, match="2 ARC records"):
        made = warc.convert(files, f"{tmp_path}/arc", f"{tmp_path}/warc")
    found = {r["url"]: r for r in warc.records(made, f"{tmp_path}/warc").collect()}
    assert {u: r["record_type"] for u, r in found.items()} == {"dns:a": "resource", "http://a/x%20y": "response", "dns:b": "resource", "http://c/": "revisit"}
    assert found["http://c/"]["refers_to_id"] == found["http://a/x%20y"]["record_id"] and {r["payload_bytes"] for r in found.values() if r["record_type"] != "revisit"} == {150}
    with gzip.open(tmp_path / "warc" / made.first()["file"]) as source:
        kinds = {f["warc-target-uri"]: (f["content-type"], f.get("arc-content-type")) for f, _ in warc.read_warc(source) if "warc-target-uri" in f}
    assert kinds["dns:a"] == ("text/dns", "text/dns") and kinds["http://c/"][0] == "application/http; msgtype=response"
