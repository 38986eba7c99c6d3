import hashlib
import io
import random

import pytest

from featurelens.llm import warc


def test_round_trip_with_revisits(rows, spark):
    r = random.Random(1)
    pool = ["", "short", "é" * 499, "é" * 500, "a" * 1000, "".join(chr(r.randrange(32, 900)) for _ in range(400_000))]
    data = [(i, f"http://x.org/{i}\r\nX: y é%41", r.choice(pool), 3) for i in range(60)]
    data += [(60, None, None, 3), (None, "u", "a" * 1000, 3), (59, "again", data[59][2], 3)]
    pages = rows.frame(data, "page_id long, url string, html string, payload_bytes int")
    folder = warc.new_folder(spark, "warc-test")
    read = warc.read(spark, warc.write(pages, folder), folder, keep_payload=True).collect()
    assert len(read) == len(data)
    first = {}
    for i, _, html, _ in data:
        if i is not None:
            first[html] = max(i, first.get(html, -1))
    expected = []
    for i, _, html, _ in data:
        body = (html or "").encode()
        refers = first.get(html) if len(body) >= 1000 and first.get(html) != i else None
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers,
                         b"" if refers is not None else body))
    got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], bytes(x["payload"]))
           for x in read]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert warc.archive(pages.limit(0)).count() == 0


def archive(n=3):
    return b"".join(warc.member(warc.record(i, "http://x/", bytes([65 + i]) * 5000, None, "2000-01-01T00:00:00Z")) for i in range(n))


class Slow(io.BytesIO):
    """Gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reads_in_small_steps():
    assert [r["page_id"] for r in warc.records(Slow(archive()))] == [0, 1, 2]


@pytest.mark.parametrize("harm", [lambda d: d[:-20], lambda d: d.replace(b"AAAA", b"AAAB", 1),
                                  lambda d: d.replace(b"Content-Length: 5000", b"Content-Length: 4999"),
                                  lambda d: d.replace(b"\r\n\r\n\r\n", b"\r\n\r\n")])
def test_harmed_records_are_found(harm):
    plain = warc.record(0, "http://x/", b"A" * 5000, None, "2000-01-01T00:00:00Z")
    harmed = harm(plain) if harm(plain) != plain else plain[:-2]
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(warc.member(harmed))))


def test_cut_file_is_found():
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(archive()[:-30])))


def test_files_roll(rows, spark, monkeypatch):
    pages = rows.frame([(i, "u", str(i) * 100) for i in range(20)], "page_id long, url string, html string")
    folder = warc.new_folder(spark, "warc-test")
    manifest = warc.write(pages.coalesce(1), folder)
    assert sum(r["records"] for r in manifest.collect()) == 20
