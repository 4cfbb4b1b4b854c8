"""Ogg columns: round trips, pages written by hand, lost and broken pages, times."""

import hashlib
import random
import zlib

import pytest

from lodestar.llm import ogg

from .helpers import documents, frame


def _slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_the_long_division():
    r = random.Random(1)
    for n in (0, 1, 3, 64, 257):
        data = r.randbytes(n)
        assert ogg.checksum(data) == _slow_checksum(data)


@pytest.mark.parametrize("n", [64, 128, 255 * 128, 64 * 1000, 64 * 3001])
def test_samples_come_back(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.encode(payload)
    back, tracks, rate = ogg.decode(media)
    assert back == payload and rate == ogg.RATE and [t.lost for t in tracks] == [0, 0] and all(t.ended for t in tracks)
    for t in tracks:
        assert t.packets[-1].end == n // 2
        assert all(a.end == b.start for a, b in zip(t.packets[1:], t.packets[2:], strict=False))


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 510, 255 * 255, 255 * 255 + 1, 200000])
def test_packets_of_any_length(size):
    r = random.Random(size)
    sent = [b"head", r.randbytes(size), r.randbytes(7), b"", r.randbytes(size)]
    data = b"".join(p for _, p in ogg.write_track(5, sent, [0, 1, 2, 3, 4]))
    (track,) = ogg.demultiplex(b"noise" + data)
    assert [p.data for p in track.packets] == sent and track.lost == 0
    spans = [p for p in ogg.read_pages(data) if p.flags & ogg.CONTINUED]
    assert bool(spans) == (size >= 255 * 254)
    # A page on which no packet ends has no time.
    assert all(p.granule == ogg.NO_PACKET_ENDS for p in ogg.read_pages(data) if p.lacing and all(n == 255 for n in p.lacing))


def test_broken_and_lost_pages():
    payload = random.Random(3).randbytes(64 * 700)
    media = ogg.encode(payload, channels=1)
    (whole,) = ogg.demultiplex(media)
    found = list(ogg.read_pages(media))
    third = found[3]
    bad = bytearray(media)
    bad[third.at + 100] ^= 1
    assert [p.valid for p in ogg.read_pages(bytes(bad))].count(False) == 1
    (track,) = ogg.demultiplex(bytes(bad))
    left = {p.number for p in whole.packets if p.page != third.number}
    assert track.lost == 1 and {p.data for p in track.packets} == {p.data for p in whole.packets if p.number in left}
    later = {p.data: (p.start, p.end) for p in whole.packets}
    assert all(later[p.data] == (p.start, p.end) for p in track.packets if p.page > third.number + 1)
    cut = media[: third.at] + media[found[4].at :]
    assert ogg.demultiplex(cut)[0].lost == 1


def test_chained_and_interleaved_streams():
    a, b = (b"".join(p for _, p in ogg.write_track(7, [x, b"1" * 300], [0, 300])) for x in (b"one", b"two"))
    tracks = ogg.demultiplex(a + b"junk" + b)
    assert [[p.data for p in t.packets] for t in tracks] == [[b"one", b"1" * 300], [b"two", b"1" * 300]]
    x, y = ogg.write_track(1, [b"x"] + [b"a" * 5000] * 3, [0, 1, 2, 3]), ogg.write_track(2, [b"y"] + [b"b" * 5000] * 3, [0, 1, 2, 3])
    mixed = b"".join(p for pair in zip(x, y, strict=True) for _, p in pair)
    assert [[p.data[:1] for p in t.packets] for t in ogg.demultiplex(mixed)] == [[b"x", b"a", b"a", b"a"], [b"y", b"b", b"b", b"b"]]


def test_a_last_page_cuts_samples():
    head = ogg.HEAD.pack(ogg.MARK, 0, 1, 8, 8000)
    data = b"".join(p for _, p in ogg.write_track(1, [head, b"a" * 5000, b"b" * 1000], [0, 5000, 5400]))
    (track,) = ogg.demultiplex(data)
    assert [(p.start, p.end) for p in track.packets] == [(0, 0), (0, 5000), (5000, 5400)]
    assert ogg.decode(data)[0] == b"a" * 5000 + b"b" * 400


def test_query_equals_plain_values(spark):
    rows = documents()
    got = sorted(map(tuple, ogg.read_back(ogg.store(frame(spark, rows))).collect()), key=repr)
    want = []
    for d, t, *_ in rows:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        media = ogg.encode(payload)
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert [g[:-1] for g in got] == sorted(want, key=repr)
    by_text = {}
    for g in got:
        by_text.setdefault(g[3], set()).add(g[2:])
    assert all(len(v) == 1 for v in by_text.values())
    assert ogg.read_back(ogg.store(frame(spark, []))).count() == 0


def test_pages_and_packets_as_rows(spark):
    media = ogg.encode(bytes(range(256)) * 100)
    df = spark.createDataFrame([(1, media), (2, None), (3, b""), (4, b"OggS and no more"), (None, media[:-1])], "k long, m binary")
    pages = ogg.pages(df, "k", "m").collect()
    assert {r["key"] for r in pages} == {1, None} and all(r["valid"] for r in pages)
    assert len([r for r in pages if r["key"] == 1]) == len(list(ogg.read_pages(media)))
    packets = [r for r in ogg.packets(df, "k", "m").collect() if r["key"] == 1]
    assert b"".join(r["data"] for r in sorted(packets, key=lambda r: r["number"]) if r["stream"] == 0 and r["number"]) == (bytes(range(256)) * 100)[::2]
    assert max(r["end_s"] for r in packets) == 256 * 100 / 2 / 8000
    assert ogg.read_back(spark.createDataFrame([(1, 0, b"x"), (2, 0, None)], "doc_id long, n_bytes long, media binary")).agg({"payload_bytes": "sum"}).first()[0] == 0
