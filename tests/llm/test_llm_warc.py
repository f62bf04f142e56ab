"""WARC files: round trips, equal bytes on reruns, rolling, roles, odd inputs."""

import base64
import gzip
import hashlib
import json
import os

import pytest

from gridprobe.llm import warc


def write(spark, pages, folder, **sizes):
    manifest = warc.write(pages, str(folder), **sizes)
    return warc.read(spark, str(folder), manifest).collect()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i * 3, f"http://h/{i}", f"<p>{'word ' * (i % 7)}{i % 11}</p>" * 40) for i in range(300)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def plain(rows, min_bytes=0):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault((html or "").encode(), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = first[data] if first[data] != page and len(data) >= min_bytes else None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out)


def test_round_trip_and_rolling(spark, pages, tmp_path):
    given = [tuple(r) for r in pages.collect()]
    got = write(spark, pages, tmp_path / "a", file_bytes=1_000, shard_bytes=20_000)
    assert sorted(map(tuple, got)) == plain(given)
    lines = [json.loads(x) for x in open(tmp_path / "a" / "manifest.json")]
    assert len(lines) > 20 and all(x["bytes"] <= 1_000 or x["records"] == 1 for x in lines)
    assert [x["first_page"] for x in lines] == sorted(x["first_page"] for x in lines)
    assert all(a["last_page"] < b["first_page"] for a, b in zip(lines, lines[1:]))
    for x in lines:
        data = open(tmp_path / "a" / x["name"], "rb").read()
        assert (len(data), hashlib.sha1(data).hexdigest()) == (x["bytes"], x["sha1"])
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == x["records"] + 1


def test_reruns_give_equal_bytes(spark, pages, tmp_path):
    listed = []
    for name, parts in (("a", 1), ("b", 5)):
        warc.write(pages.repartition(parts), str(tmp_path / name), file_bytes=5_000, shard_bytes=20_000)
        files = sorted(f for f in os.listdir(tmp_path / name) if f.endswith(".warc.gz"))
        listed.append([(f, open(tmp_path / name / f, "rb").read()) for f in files] + [open(tmp_path / name / "manifest.json").read()])
    assert listed[0] == listed[1]


def test_commit_may_be_repeated(spark, pages, tmp_path):
    manifest = warc.write(pages, str(tmp_path / "a"))
    before = sorted(os.listdir(tmp_path / "a"))
    warc._commit(spark, manifest, str(tmp_path / "a"))
    assert sorted(os.listdir(tmp_path / "a")) == before
    assert len(warc.read(spark, str(tmp_path / "a"), manifest).collect()) == 300


def test_a_lost_file_is_no_commit(spark, pages, tmp_path):
    manifest = warc.write(pages, str(tmp_path / "a"))
    name = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))[0]
    (tmp_path / "a" / name).unlink()
    (tmp_path / "a" / "manifest.json").unlink()
    with pytest.raises(Exception, match="neither is there"):
        warc._commit(spark, manifest, str(tmp_path / "a"))
    assert "manifest.json" not in os.listdir(tmp_path / "a")


def test_damage_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    manifest = warc.write(pages, str(tmp_path / "a"))
    name = manifest.first()["name"]
    data = gzip.decompress(open(tmp_path / "a" / name, "rb").read()).replace(b"text\r\n\r\n", b"next\r\n\r\n")
    at = data.index(b"WARC/1.1", 1)
    open(tmp_path / "a" / name, "wb").write(gzip.compress(data[:at]) + gzip.compress(data[at:]))
    with pytest.raises(Exception, match="does not match its digests"):
        warc.read(spark, str(tmp_path / "a"), manifest).collect()


def test_odd_pages(spark, tmp_path):
    rows = [
        (5, None, None), (1, "http://a\r\nX: y", ""), (2, "u", "\r\n\r\nWARC/1.1\r\n"), (3, "ü", "é" * 100_000), (4, "u", "é" * 100_000),
        (-7, "u", "x\0y"), (9, "u", "x\0y"), (9, "u", "x\0y"), (9, "u", "other"), (None, "u", "lost"),
    ]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, sha string, page int")
    kept = [r for r in rows if r[0] is not None]
    assert sorted(map(tuple, write(spark, pages, tmp_path / "a")), key=str) == sorted(plain(kept), key=str)
    assert sorted(map(tuple, write(spark, pages, tmp_path / "b", min_bytes=10)), key=str) == sorted(plain(kept, 10), key=str)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert write(spark, pages, tmp_path / "a") == []
    assert open(tmp_path / "a" / "manifest.json").read() == ""
