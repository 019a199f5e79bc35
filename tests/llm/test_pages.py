import io
import zipfile

import pytest
from pyspark.sql import functions as F

from driftline.llm import urls, zipwarc
from driftline.session import scratch_dir

URLS = ["http://a.com/x", "http://com", "https://WWW.Example.COM/en/1?q=1", "https://sub.www.example.com/en/", "http://example.com/en/2",
        "http://blog.example.com/en/2#x", "http://example.com/eno", "http://foo.net/es/1", "http://net/es/", "http://foo.net/en/1",
        "http://foonet/fr/1", "ftp://x.net/fr/?a://b", "no scheme", "", None, "http://", "http://h?x=/a", "http://ä.net/fr/é",
        "http://a.com/x"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for kind, rule in urls.RULES:
        top, _, rest = rule.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, kind))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in urls.judge(pages).collect():
        host, path, rule, kind = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == kind if kind else r.verdict in ("allow", "block")


def test_models_tell_hosts_apart(spark):
    rows = [(i, f"http://good{i % 7}.com/news/{i}") for i in range(60)] + [(100 + i, f"http://x{i % 5}.net/es/casino-{i}") for i in range(60)]
    rows += [(300, "http://good3.org/news/5"), (301, "http://x1.org/es/casino-7"), (302, None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[300].verdict == "allow" and got[301].verdict == "block" and got[302].verdict in ("allow", "block")


def test_probabilities_sum_to_one():
    import numpy as np
    counts = np.zeros(urls.N_SYMBOLS ** 4, np.int64)
    code, _ = urls.codes(np.frombuffer(b"a.com/enb.com/de", np.uint8), np.array([0, 8, 16]))
    np.add.at(counts, code, 1)
    p = urls.smooth(counts)
    np.testing.assert_allclose(p.sum(-1), 1, atol=1e-9)
    assert code.size == 18


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(none).count() == 0
    assert zipwarc.read_records(zipwarc.write_archives(none, f"{scratch_dir(spark)}/none")).count() == 0


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "http://a/3\r\nX: y", ""), (4, "u", None),
         (5, "u", "é" * 5000), (6, "u", "own"), (None, "u", "own"), (7, "u", "a\r\n\r\nWARC/1.1\r\n"), (8, "u", "twice"), (8, "u", "twice")]


@pytest.mark.parametrize("force64", [False, True])
def test_round_trip(spark, force64, monkeypatch):
    monkeypatch.setattr(zipwarc, "RANGE_RECORDS", 2)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(0)).coalesce(2)
    archives = zipwarc.write_archives(pages, f"{scratch_dir(spark)}/trip{force64}", force64=force64)
    rows = zipwarc.read_records(archives).collect()
    assert len(rows) == len(PAGES) == archives.agg(F.sum("records")).first()[0]
    last = {"same": 9, "": 4, "own": 6, "twice": 8}
    for r in rows:
        html = next(h or "" for i, u, h in PAGES if i == r.page_id and (u == r.url))
        raw = html.encode()
        first = last.get(html, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), zipwarc.base32_sha1(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload == (raw if r.record_type == "response" else b"")
    for a in archives.collect():
        where, name = zipwarc.locate(a.archive)
        with where.open_input_file(name) as f:
            with zipfile.ZipFile(io.BytesIO(f.read())) as z:
                assert z.testzip() is None and z.namelist() == [zipwarc.DATA, zipwarc.INDEX]


def test_a_second_attempt_in_another_order_changes_nothing(spark, monkeypatch):
    """A lost executor's partition is written again, cut elsewhere: the committed manifest still reads each page once."""
    monkeypatch.setattr(zipwarc, "ARCHIVE_BYTES", 600)
    folder = f"{scratch_dir(spark)}/attempts"
    schema = "page_id long, url string, html string"
    rows = [(i, f"http://h/{i}", f"text {i} " * (i % 7)) for i in range(40)]
    first = zipwarc.write_archives(spark.createDataFrame(rows, schema).coalesce(1), folder)
    committed = spark.createDataFrame(first.collect(), first.schema)
    zipwarc.write_archives(spark.createDataFrame(rows[::-1], schema).coalesce(1), folder).collect()
    assert sorted(r.page_id for r in zipwarc.read_records(committed).collect()) == list(range(40))
    assert committed.count() > 3


def test_foreign_archives_and_damage(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored", b"hello")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as m:
            m.write(b"wide data")
        z.comment = b"a note PK\x05\x06 with a false sign"
    with open(path, "rb") as f:
        members = zipwarc.directory(f, path.stat().st_size)
        assert set(members) == {"stored", "wide"}
        assert zipwarc._fetch(f, *members["wide"]) == b"wide data"
    (tmp_path / "y").write_bytes(b"not an archive")
    with open(tmp_path / "y", "rb") as f, pytest.raises(ValueError):
        zipwarc.directory(f, 14)


def test_models_read_query_and_schemeless_urls(spark):
    rows = [(i, f"http://a{i % 7}.com/p?topic=news{i}") for i in range(60)] + [(100 + i, f"http://a{i % 7}.net/es/p?casino=win{i}") for i in range(60)]
    rows += [(300, "http://b.org/p?topic=news5"), (301, "http://b.org/p?casino=win7"), (302, "a3.com/p?topic=news8"), (303, "a3.net/es/p?casino=win8")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i].verdict for i in (300, 301, 302, 303)] == ["allow", "block", "allow", "block"]
    assert (got[302].host, got[302].path, got[301].path) == ("", "", "/p")
