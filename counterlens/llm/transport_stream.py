"""Payloads as MPEG transport streams: written to a media column, read back and checked.

A payload is cut into access units of 16 frames of 576 bytes, one PES packet each, with a
presentation time of 1080 ticks a frame (48,000 samples a second of a 90 kHz clock) and a
random-access point at its start. Program tables (PAT and PMT with their CRC) come first
and again every eight units. Reading parses the tables to find the stream, checks the
continuity counters of every PID, reassembles the PES packets from the 188-byte packets
and returns times and random-access points with the payload.

Cases: null text is an empty payload, which is padded like any other to 576 bytes. Equal
texts give equal streams. Rows with equal ids are separate. A stream that is cut, out of
step or without tables is an error for ``demux`` in strict use; counts of continuity and
CRC errors are reported otherwise. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from counterlens.llm import kernel as K
from counterlens.llm.shared import Scratch

PACKET = 188
FRAME = 576
UNIT = 16 * FRAME
TICKS = 1080
TABLES_EVERY = 8
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID, PROGRAM = 0x06, 0xBD, 1
FILL = 255
_HEAD, _CLOCKED = 14, 8  # bytes of a PES header, and of an adaptation field with a clock


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        out.append(x)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    x = 0xFFFFFFFF
    for b in data:
        x = (x << 8 & 0xFFFFFFFF) ^ _CRC[x >> 24 ^ b]
    return x


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    size = len(body) + 9
    raw = bytes([table_id, 0xB0 | size >> 8, size & 255]) + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return raw + crc32_mpeg(raw).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = [
    _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")),
]


def padded(raw: bytes) -> bytes:
    """The bytes filled up to a positive multiple of a frame."""
    return raw + bytes([FILL]) * (-len(raw) % FRAME if raw else FRAME)


def _time_bytes(t: int) -> bytes:
    return bytes([0x21 | (t >> 30 & 7) << 1, t >> 22 & 255, 1 | (t >> 15 & 127) << 1, t >> 7 & 255, 1 | (t & 127) << 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, count = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        if k % TABLES_EVERY == 0:
            step = k // TABLES_EVERY & 15
            out += [p[:3] + bytes([0x10 | step]) + p[4:] for p in _TABLES]
        data = np.frombuffer(payload, np.uint8, min(UNIT, len(payload) - at), at)
        time = at // FRAME * TICKS & (1 << 33) - 1
        size = len(data) + 8
        head = b"\x00\x00\x01" + bytes([STREAM_ID, size >> 8 & 255, size & 255, 0x84, 0x80, 5]) + _time_bytes(time)
        clock = bytes([_CLOCKED - 1, 0x50]) + (time << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4 - _CLOCKED - _HEAD
        full, rest = divmod(max(0, len(data) - room), PACKET - 4)
        n = 1 + full + (rest > 0)
        pk = np.full((n, PACKET), 255, np.uint8)
        pk[:, 0], pk[:, 1], pk[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
        pk[0, 1] |= 0x40
        pk[:, 3] = 0x10 | (count + np.arange(n)) & 15
        pk[0, 3] |= 0x20
        pk[0, 4 : 4 + _CLOCKED + _HEAD] = np.frombuffer(clock + head, np.uint8)
        pk[0, 4 + _CLOCKED + _HEAD :] = data[:room]
        pk[1 : 1 + full, 4:] = data[room : room + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if rest:
            pk[-1, 3] |= 0x20
            pk[-1, 4] = PACKET - 5 - rest
            if rest < PACKET - 5:
                pk[-1, 5] = 0
            pk[-1, PACKET - rest :] = data[len(data) - rest :]
        count = count + n & 15
        out.append(pk.tobytes())
    return b"".join(out)


def _tables(packets: np.ndarray, pids: np.ndarray, pid: int) -> tuple[bytes, int]:
    """The first sound section of a PID, and how many of its sections have a wrong CRC."""
    found, bad, known = b"", 0, {}
    for row in packets[(pids == pid) & (packets[:, 1] & 0x40 != 0)]:
        raw = row.tobytes()
        at = 5 + raw[4] if raw[3] & 0x20 else 4  # after an adaptation field
        at += 1 + raw[at]  # and the pointer to the section
        size = ((raw[at + 1] & 15) << 8 | raw[at + 2]) + 3
        section = raw[at : at + size]
        if section not in known:
            known[section] = len(section) == size and crc32_mpeg(section) == 0
        bad += not known[section]
        if known[section] and not found:
            found = section
    return found, bad


def demux(stream: bytes, strict: bool = True) -> dict:
    """payload, pts, access (packet numbers of random-access points), and error counts."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost packet synchronisation")
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    has_field, has_data = packets[:, 3] & 0x20 != 0, packets[:, 3] & 0x10 != 0
    gaps = 0
    for pid in np.unique(pids):
        steps = packets[(pids == pid) & has_data, 3] & 15
        gaps += int(((steps[1:] - steps[:-1]) & 15 != 1).sum())
    pat, bad = _tables(packets, pids, PAT_PID)
    if not pat:
        raise ValueError("no program association table")
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(pat) - 4, 4)]
    pmt_pid = next(p for n, p in programs if n)
    pmt, more = _tables(packets, pids, pmt_pid)
    if not pmt:
        raise ValueError("no program map table")
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    kind, pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    if strict and (gaps or bad or more):
        raise ValueError(f"{gaps} continuity errors, {bad + more} wrong section CRCs")
    rows = np.flatnonzero((pids == pid) & has_data)
    own, field = packets[rows], has_field[rows]
    begin = np.where(field, 5 + own[:, 4].astype(np.int64), 4)
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    first = np.flatnonzero(own[:, 1] & 0x40 != 0)
    starts = np.where(first > 0, ends[first - 1], 0).tolist()
    parts, pts = [], []
    for a, b in zip(starts, [*starts[1:], len(data)]):
        if data[a : a + 3] != b"\x00\x00\x01":
            raise ValueError("a packet unit does not start with a PES header")
        if data[a + 7] & 0x80:
            t = data[a + 9 : a + 14]
            pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
        size = int.from_bytes(data[a + 4 : a + 6], "big")
        parts.append(data[a + 9 + data[a + 8] : a + 6 + size if size else b])
    access = rows[field & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)]
    return {"payload": b"".join(parts), "pts": pts, "access": access.tolist(), "pid": pid, "kind": kind, "gaps": gaps, "bad": bad + more}


def _mux():
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, "text"):
            buf, offs = K.utf8(part.column("text"))
            raw = buf.tobytes()
            media = [mux(padded(raw[a:b])) for a, b in zip(offs.tolist(), offs[1:].tolist())]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(offs), pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return run


DEMUXED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access array<long>"


def _demux():
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "access"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for media in part.column("media"):
                    stream = media.as_buffer().to_pybytes()
                    got = demux(stream)
                    p, pts = got["payload"], got["pts"]
                    feature = f"pid={got['pid']};type={got['kind']};units={len(pts)};first_pts={pts[0]};last_pts={pts[-1]};access={len(got['access'])};packets={len(stream) // PACKET};gaps={got['gaps']}"
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, pts, got["access"]))
                cols = [part.column("doc_id"), part.column("n_bytes"), *map(list, zip(*rows))]
                yield pa.record_batch([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(cols, kinds)], names=names)

    return run


def store(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The media column of every document, written to a table: doc_id, n_bytes, media."""
    return scratch.table(docs.select("doc_id", "text").mapInArrow(_mux(), "doc_id long, n_bytes long, media binary"), "media")


def inspect(media: DataFrame) -> DataFrame:
    """Digests, features, times and random-access points of stored streams."""
    return media.mapInArrow(_demux(), DEMUXED)


def query(spark, sf_dir: str) -> DataFrame:
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "media"))
    return inspect(stored).drop("pts", "access")
