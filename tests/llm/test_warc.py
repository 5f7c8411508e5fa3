import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from rasterloom.llm import warc

CASES = {
    "empty table": [],
    "nulls": [(3, None), (1, ""), (None, "x"), (2, "x"), (None, "only"), (5, None)],
    "repeats": [(4, "same"), (4, "same"), (4, "other"), (2, "same"), (9, "same")],
    "chunks": [(1, "é" * 100_000), (2, "a" * warc.CHUNK), (3, "a" * (warc.CHUNK + 1)), (4, "\r\n\r\nWARC/1.1\r\n" * 9000), (5, "é" * 100_000)],
}


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string").selectExpr("*", "1 AS id", "'s' AS sha", "2 AS size", "3 AS payload", "4 AS uri")


@pytest.mark.parametrize("case", CASES)
def test_round_trip(spark, case):
    rows = CASES[case]
    got = warc.record_rows(warc.write_warc(pages(spark, rows), "page_id", "html", "url")).collect()
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want, seen = [], set()
    for i, h in rows:
        p = (h or "").encode()
        told = i == first.get(h or "") and (i, h or "") not in seen
        seen.add((i, h or ""))
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if told or (h or "") not in first and (i, h, "n") not in seen else "revisit", None if told else first.get(h or "")))
        seen.add((i, h, "n"))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_chunks_carry_digests_and_payload(spark):
    rows = CASES["chunks"]
    chunks = warc.read_warc(warc.write_warc(pages(spark, rows), "page_id", "html", "url")).where("record_type = 'response'").collect()
    by = {}
    for r in sorted(chunks, key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["chunk"]) <= warc.CHUNK
        h, text = by.setdefault(r["record_id"], (hashlib.sha1(), []))
        h.update(r["chunk"])
        text.append(bytes(r["chunk"]))
        assert r["digest_so_far"] == base64.b32encode(h.digest()).decode() and r["bytes_so_far"] == sum(map(len, text)) and r["target_uri"].startswith("http://x/")
    assert {b"".join(t).decode() for _, t in by.values()} == {h for _, h in rows} and max(r["chunk_no"] for r in chunks) >= 3


URIS = ["http://x/\r\n\r\nboo", "http://x/\r\nWARC-Type: revisit", " a\tb ", "%0D%0A", "100%\n", "", None, "é\x85", "http://x/a%20b", "\x00"]


def test_uris_come_back_as_they_were(spark):
    rows = [(i, u, f"payload {i}") for i, u in enumerate(URIS)] + [(99, u, "same") for u in URIS * 2] + [(None, u, "") for u in ("b", "a", None)]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "html", "url")
    got = warc.read_warc(manifest).where("last").collect()
    assert len(got) == len({r["record_id"] for r in got}) == len(rows)
    number = lambda r: r["record_id"].split(":")[2]
    assert sorted(((number(r), r["target_uri"]) for r in got), key=str) == sorted((("" if i is None else str(i), u) for i, u, _ in rows), key=str)
    assert {(number(r), r["record_type"]) for r in got if number(r) not in ("99", "")} == {(str(i), "response") for i in range(len(URIS))}
    for n in ("99", ""):
        assert sorted(r["record_type"] for r in got if number(r) == n) == ["response"] + ["revisit"] * (sum(n == ("" if i is None else str(i)) for i, _, _ in rows) - 1)


def test_small_payloads_are_not_shared(spark):
    rows = [(1, "u", "ab"), (1, "u", "ab"), (1, "v", "ab"), (2, None, "a" * 70_000), (2, None, "a" * 70_000)]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "html", "url", dedup_bytes=1 << 20)
    assert sorted((r["id"], r["payload_bytes"], r["record_type"]) for r in warc.record_rows(manifest).collect()) == [(1, 2, "response")] * 3 + [(2, 70_000, "response")] * 2
    got = warc.record_rows(warc.write_warc(pages(spark, [(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")]), "page_id", "html", dedup_bytes=5)).collect()
    assert {r["id"]: (r["record_type"], r["refers_to"]) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_each_record_is_a_gzip_member(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, CASES["repeats"]), "page_id", "html", folder=str(tmp_path / "a")).collect()
    raw = b"".join(Path(r["archive"]).read_bytes() for r in manifest)
    assert raw.count(b"\x1f\x8b\x08") >= sum(r["records"] for r in manifest) == 5 and gzip.decompress(raw).count(b"WARC/1.1\r\n") == 5


def test_a_cut_archive_is_an_error(spark, tmp_path):
    manifest = warc.write_warc(pages(spark, CASES["chunks"]).where("page_id = 4"), "page_id", "html", folder=str(tmp_path / "a"))
    path = Path(manifest.first()["archive"])
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes())[:5000]))
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(manifest).collect()
