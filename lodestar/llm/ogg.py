"""Ogg media columns: pages verified by checksum, packets put together from lacing values, logical streams taken apart, times from granule positions.

A column of binary values, each a whole physical stream, is read by pages() and packets();
store() writes texts as such a column and read_back() reads their samples again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import frugal, lean_batches

# Fixed values of the container format: the capture pattern, the header's layout and the flags of a page.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1

#: The first packet of a stream of samples: a mark, the channel, the channels, bits of a sample and samples a second.
HEAD = struct.Struct("<6sBBBI")
MARK = b"PCMraw"
RATE = 8000
CHANNELS = 2
#: Samples of a packet, and bytes from which a page is full.
PACKET = 1000
PAGE = 4096
#: A payload is filled up with zero bytes to a positive multiple of this.
UNIT = 64

_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC of a page whose checksum field is zero: polynomial 04C11DB7, highest bit first, nothing inverted.

    That is zlib's CRC of the bytes with their bits turned round, itself turned round.
    """
    crc = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_TURNED), "big")


@dataclass
class Page:
    """A page as it stands in the stream."""

    at: int
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes
    valid: bool


@dataclass
class Packet:
    """A packet of a logical stream; start and end count samples and are None where they are not known."""

    serial: int
    number: int
    data: bytes
    page: int
    start: int | None = None
    end: int | None = None


@dataclass
class Track:
    """A logical stream: its packets and what was lost of it."""

    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a physical stream; after a page of a wrong checksum the search goes on behind its capture pattern."""
    at = data.find(CAPTURE)
    while at >= 0:
        body = at + HEADER.size
        if body <= len(data):
            _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
            lacing = data[body : body + n]
            end = body + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data):
                whole = data[at:end]
                valid = checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc
                yield Page(at, flags, granule, serial, number, lacing, whole[HEADER.size + n :], valid)
                if valid:
                    at = end if data.startswith(CAPTURE, end) else data.find(CAPTURE, end)
                    continue
        at = data.find(CAPTURE, at + 1)


def head(track: Track) -> tuple[int, int, int] | None:
    """Channel, channels and samples a second of a stream of samples, None of another one."""
    first = track.packets[0].data if track.packets else b""
    if not (len(first) == HEAD.size and first.startswith(MARK)):
        return None
    _, channel, channels, _, rate = HEAD.unpack(first)
    return channel, max(1, channels), rate


def _duration(track: Track, data: bytes) -> int | None:
    """Samples of a packet; only the stream's own head tells, and it has none itself."""
    if head(track if track.packets else Track(0, [Packet(0, 0, data, 0)])) is None:
        return None
    return len(data) if track.packets else 0


def demultiplex(data: bytes) -> list[Track]:
    """The logical streams of a physical one, in order of their first page.

    Pages of a wrong checksum count as lost, as do missing numbers; a packet that touches
    a lost page is left out. A serial that begins again after its last page is a new
    stream. The samples before a page's granule position belong to the packets that end on
    it, the last one first; on a last page they are counted on from the page before, and
    what passes the granule position is no sample.
    """
    tracks: list[Track] = []
    now: dict[int, Track] = {}
    part: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    reached: dict[int, int | None] = {}
    made: dict[int, int] = {}
    for page in read_pages(data):
        s = page.serial
        if not page.valid:
            continue  # its serial cannot be trusted; the next page's number tells the loss
        if s not in now or page.flags & FIRST and now[s].ended:
            now[s] = Track(s)
            tracks.append(now[s])
            part[s], expected[s], reached[s], made[s] = None, page.number if page.flags & FIRST else 0, 0, 0
        track = now[s]
        track.pages += 1
        if page.number != expected[s]:
            track.lost += (page.number - expected[s]) & 0xFFFFFFFF
            part[s], reached[s] = None, None
        expected[s] = (page.number + 1) & 0xFFFFFFFF
        held = part[s] if page.flags & CONTINUED else bytearray()
        ended: list[tuple[Packet, int | None]] = []
        at = 0
        for n in page.lacing:
            if held is not None:
                held += page.body[at : at + n]
            at += n
            if n < 255:
                if held is not None:
                    packet = Packet(s, made[s], bytes(held), page.number)
                    ended.append((packet, _duration(track, packet.data)))
                    track.packets.append(packet)
                made[s] += 1
                held = bytearray()
        part[s] = held if page.lacing and page.lacing[-1] == 255 else None
        if page.granule != NO_PACKET_ENDS and ended:
            if all(n is not None for _, n in ended):
                total = sum(n for _, n in ended)
                begin = reached[s] if page.flags & LAST and reached[s] is not None else max(0, page.granule - total)
                for packet, n in ended:
                    packet.start, packet.end = min(begin, page.granule), min(begin + n, page.granule)
                    begin += n
            else:
                ended[-1][0].end = page.granule
            reached[s] = page.granule
        track.ended |= bool(page.flags & LAST)
    return tracks


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def write_track(serial: int, packets: list[bytes], granules: list[int], full: int = PAGE) -> list[tuple[int, bytes]]:
    """(granule position, page) of a logical stream. The first packet has the first page alone; packets longer than a page go on in the next."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, open_packet = bytearray(), bytearray(), NO_PACKET_ENDS, False

    def flush(last: bool) -> None:
        nonlocal granule, open_packet
        flags = (CONTINUED if open_packet else 0) | (0 if pages else FIRST) | (LAST if last else 0)
        pages.append((granule, _page(serial, len(pages), flags, granule, bytes(lacing), bytes(body))))
        open_packet = bool(lacing) and lacing[-1] == 255
        granule = NO_PACKET_ENDS
        lacing.clear()
        body.clear()

    for k, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        for at in range(0, len(packet) + 1, 255):
            if len(lacing) == 255:
                flush(False)
            piece = packet[at : at + 255]
            lacing.append(len(piece))
            body += piece
        granule = end
        last = k == len(packets) - 1
        if last or not k or len(body) >= full:
            flush(last)
    return pages


def encode(payload: bytes, channels: int = CHANNELS, rate: int = RATE) -> bytes:
    """A physical stream of 8-bit samples, one logical stream a channel, whose samples are dealt in turn; pages go by time."""
    serial = zlib.crc32(payload)
    firsts, rest = [], []
    for c in range(channels):
        samples = payload[c::channels]
        pieces = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
        ends = np.minimum(np.arange(1, len(pieces) + 1) * PACKET, len(samples)).tolist()
        pages = write_track((serial + c) & 0xFFFFFFFF, [HEAD.pack(MARK, c, channels, 8, rate), *pieces], [0, *ends])
        firsts.append(pages[0][1])
        reached = 0
        for granule, page in pages[1:]:
            reached = max(reached, granule)
            rest.append((reached, c, len(rest), page))
    return b"".join([*firsts, *(page for *_, page in sorted(rest, key=lambda x: x[:3]))])


def decode(media: bytes) -> tuple[bytes, list[Track], int]:
    """The samples of all channels in turn, the logical streams and the samples a second."""
    channels: dict[int, Track] = {}
    n, rate = 0, RATE
    tracks = demultiplex(media)
    for track in tracks:
        if (known := head(track)) is not None and known[0] < known[1]:
            c, n, rate = known
            channels[c] = track
    parts = {c: b"".join(p.data[: p.end - p.start] if p.end is not None else p.data for p in t.packets[1:]) for c, t in channels.items()}
    size = max((len(samples) for samples in parts.values()), default=0)
    out, there = np.zeros((size, n), np.uint8), np.zeros((size, n), bool)
    for c, samples in parts.items():
        if c < n:
            out[: len(samples), c], there[: len(samples), c] = np.frombuffer(samples, np.uint8), True
    return out[there].tobytes(), tracks, rate


def feature(payload: bytes, tracks: list[Track], rate: int) -> str:
    """What the samples and their times say, in words that equal payloads share."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = max((p.end for t in tracks for p in t.packets if p.end is not None), default=0)
    n = max(1, len(x))
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    names = {"streams": len(tracks), "pages": sum(t.pages for t in tracks), "packets": sum(len(t.packets) for t in tracks), "lost": sum(t.lost for t in tracks), "ms": 1000 * last // rate, "mean": int(x.sum()) * 1000 // n, "power": int((x * x).sum()) * 1000 // n, "turns": turns}
    return " ".join(f"{k}={v}" for k, v in names.items())


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, filled up with zero bytes to a multiple of 64, as Ogg samples.

    A null text is empty, and an empty one is 64 zero bytes. Rows stay rows, those of a
    null key and repeated ones as well; other columns are not read.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 64):
                rows, sizes, media = b.slice(s, 64), [], []
                for t in rows.column(1).to_pylist():
                    data = (t or "").encode()
                    sizes.append(len(data))
                    media.append(encode(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    lean_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes give: payload and media sizes and digests, tail_crc32 and feature.

    Media that hold no whole stream of samples give an empty payload; null media are empty.
    """

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in b.column(2).to_pylist():
                media = media or b""
                payload, tracks, rate = decode(media)
                row = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, tracks, rate)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(frugal(run), schema)


def pages(rows: DataFrame, key: str, media: str) -> DataFrame:
    """key, at, serial, number, flags, granule, n_bytes and valid: one row for each page found in a column of media, broken ones as well.

    Null, empty and foreign media have no page. Rows of a null key or repeated ones are read like any.
    """

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(k, p.at, p.serial, p.number, p.flags, p.granule, len(p.body), p.valid) for p in read_pages(data or b"")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    names = ["key", "at", "serial", "number", "flags", "granule", "n_bytes", "valid"]
    kinds = [pa.int64()] * 3 + [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    return rows.select(F.col(key).cast("long"), F.col(media).cast("binary")).mapInArrow(run, "key long, at long, serial long, number long, flags int, granule long, n_bytes long, valid boolean")


def packets(rows: DataFrame, key: str, media: str, rate: int | None = None) -> DataFrame:
    """key, stream, serial, number, page, data, start_s and end_s: one row for each whole packet in a column of media.

    stream counts the logical streams of one value from 0. Seconds come from granule
    positions at the head's rate, or at `rate` for streams of a codec that this module does
    not know, of which only packets that end a page have a time. Null media have none.
    """

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, track in enumerate(demultiplex(data or b"")):
                    known = head(track)
                    per = known[2] if known else rate
                    at = lambda x, per=per: None if x is None or not per else x / per
                    found = [(k, n, p.serial, p.number, p.page, p.data, at(p.start), at(p.end)) for p in track.packets]
                    for s in range(0, len(found), 1024):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[s : s + 1024], strict=True), kinds, strict=True)], names)

    names = ["key", "stream", "serial", "number", "page", "data", "start_s", "end_s"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64()]
    return rows.select(F.col(key).cast("long"), F.col(media).cast("binary")).mapInArrow(run, "key long, stream int, serial long, number long, page long, data binary, start_s double, end_s double")


def op13(spark, sf_dir: str) -> DataFrame:
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
