"""Media columns as MPEG transport streams.

Writing: the payload (UTF-8 bytes, then zero bytes up to a positive multiple of 64) is cut into access units of
``UNIT`` bytes. Each unit is one elementary packet with a presentation timestamp; its first transport packet is marked as a random-access
point and carries the clock reference, and its last is filled up with adaptation-field stuffing. A program association table and a program map table lead.

Reading: the stored bytes are parsed from the tables on: sync bytes, table sections (over several packets too) and their checksums, the first program's first stream,
continuity counters (with stated discontinuities, packets sent twice, and packets without payload), adaptation fields, then the elementary packets
are put together again by their stated lengths, or up to the next one where none is stated. A packet's timestamp is read if its flags say that it has one.

Cases: null text counts as empty (64 zero bytes); a stream that is damaged gives ``intact`` false and null payload
instead of an error, however it is damaged; repeated rows stay; a column of ``df`` with the name of a result column is replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from quillmatch.llm.rows import map_blocks, texts

PACKET, UNIT, PAD, TICKS = 188, 16_384, 64, 3_600
MAP_PID, STREAM_PID, STREAM_ID, STREAM_TYPE = 0x1000, 0x100, 0xBD, 0x06  # private data
TIME = (1 << 33) - 1
# Ids of elementary packets that have no optional header (ISO/IEC 13818-1): fixed values.
HEADLESS = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def table_packet(pid: int, table_id: int, body: bytes) -> bytes:
    """One packet with a program table section."""
    length = len(body) + 9
    section = bytes([table_id, 0xB0 | length >> 8, length & 255, 0, 1, 0xC1, 0, 0]) + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


TABLES = table_packet(0, 0, bytes([0, 1, 0xE0 | MAP_PID >> 8, MAP_PID & 255])) + table_packet(
    MAP_PID, 2, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])
)


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % PAD if data else PAD)


def timestamp(ticks: int) -> bytes:
    """33 bits of 90 kHz ticks with marker bits, as a presentation timestamp."""
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, ticks << 1 & 254 | 1])


def clock_reference(ticks: int) -> bytes:
    """33 bits of 90 kHz ticks, six reserved bits, and nine bits of 27 MHz ticks that are 0."""
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream of ``payload``."""
    units, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        clock = k * TICKS & TIME
        data = payload[at : at + UNIT]
        data = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(clock + TICKS & TIME) + data
        rest = max(0, len(data) - 176)  # the first packet has an adaptation field of eight bytes at least
        n = 1 + -(-rest // 184)
        packets = np.full((n, PACKET), 255, np.uint8)
        packets[:, 0] = 0x47
        packets[:, 1] = STREAM_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = STREAM_PID & 255
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        packets[0, 3] |= 0x20
        first = min(176, len(data))
        packets[0, 4], packets[0, 5] = 183 - first, 0x50  # random access, clock reference
        packets[0, 6:12] = np.frombuffer(clock_reference(clock), np.uint8)
        packets[0, PACKET - first :] = np.frombuffer(data, np.uint8, first)
        body = np.frombuffer(data, np.uint8, rest, first)
        full = rest // 184
        packets[1 : 1 + full, 4:] = body[: full * 184].reshape(full, 184)
        if left := rest - full * 184:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - left
            if left < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - left :] = body[full * 184 :]
        units.append(packets.tobytes())
    return b"".join(units)


def bodies(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins: beyond its end for packets without one, or with a field that is too long."""
    control = packets[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + packets[:, 4].astype(np.int64), 4)
    return np.where((control & 1 == 0) | (begin > PACKET), PACKET + 1, begin)


def section_of(packets: np.ndarray, table: int) -> bytes | None:
    """The body of the first table section of ``packets``, which are of one id, if it is whole and its checksum holds."""
    held = None
    for packet, begin in zip(packets, bodies(packets).tolist()):
        body = packet[begin:].tobytes()
        if packet[1] & 0x40 and body:
            held = body[1 + body[0] :] if held is None else held + body[1:]
        elif held is not None:
            held += body
        if held is not None and len(held) >= 3:
            section = held[: 3 + ((held[1] & 15) << 8 | held[2])]
            if len(section) >= 12 and len(section) == 3 + ((held[1] & 15) << 8 | held[2]):
                return section[8:-4] if section[0] == table and crc32_mpeg_cached(section) == 0 else None
    return None


_seen: dict[bytes, int] = {}


def crc32_mpeg_cached(section: bytes) -> int:
    if section not in _seen:
        if len(_seen) > 100:
            _seen.clear()
        _seen[section] = crc32_mpeg(section)
    return _seen[section]


_streams: dict[bytes, int | None] = {}


def stream_of(packets: np.ndarray, pids: np.ndarray) -> int | None:
    """The packet id of the first stream of the first program."""
    lead = packets[:2].tobytes()  # most often both tables
    if lead in _streams:
        return _streams[lead]
    programs = section_of(packets[pids == 0], 0) or b""
    # programs are of four bytes each; number 0 isn't one
    at = next(((programs[i + 2] & 31) << 8 | programs[i + 3] for i in range(0, len(programs) - 3, 4) if programs[i] or programs[i + 1]), None)
    program = b"" if at is None else section_of(packets[pids == at], 2) or b""
    skip = 4 + ((program[2] & 15) << 8 | program[3]) if len(program) >= 4 else 0
    found = (program[skip + 1] & 31) << 8 | program[skip + 2] if skip and len(program) >= skip + 5 else None
    if len(packets) >= 2 and pids[0] == 0 and pids[1] == at and section_of(packets[:1], 0) and section_of(packets[1:2], 2):
        if len(_streams) > 100:
            _streams.clear()
        _streams[lead] = found
    return found


def demux(stream: bytes | None) -> dict | None:
    """payload, packets, pts (None for units without) and random_access (offsets into payload of the units that begin at such a point); None if damaged."""
    if not stream or len(stream) % PACKET:
        return None
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any() or (packets[:, 1] & 0x80).any():
        return None
    pids = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    pid = stream_of(packets, pids)
    own = packets[pids == pid] if pid is not None else packets[:0]
    control = own[:, 3] >> 4 & 3
    if (control == 0).any() or (own[:, 3] & 0xC0).any():  # reserved, scrambled
        return None
    own = own[control & 1 > 0]  # the others have no payload, and the counter stays
    begin = bodies(own)
    if not len(own) or (begin > PACKET).any():
        return None
    has_flags = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0)
    flags = np.where(has_flags, own[:, 5], 0)
    steps = (own[1:, 3].astype(np.int32) - own[:-1, 3]) & 15
    jump = flags[1:] & 0x80 > 0
    twice = (steps == 0) & ~jump
    if ((steps != 1) & ~jump & ~twice).any():
        return None
    if twice.any():
        for i in np.flatnonzero(twice).tolist():
            if i and twice[i - 1] or begin[i] != begin[i + 1] or (own[i, begin[i] :] != own[i + 1, begin[i] :]).any():
                return None
        once = np.concatenate([[True], ~twice])
        own, begin, flags = own[once], begin[once], flags[once]
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    starts = np.flatnonzero(own[:, 1] & 0x40)
    offsets = np.concatenate([[0], np.cumsum(PACKET - begin)])
    random = flags[starts] & 0x40 > 0
    parts, pts, points, done = [], [], [], 0
    for k, (i, stop) in enumerate(zip(offsets[starts].tolist(), [*offsets[starts[1:]].tolist(), len(data)])):
        if stop - i < 9 or data[i : i + 3] != b"\0\0\1":
            return None
        length, head, t = int.from_bytes(data[i + 4 : i + 6], "big"), 9 + data[i + 8], None
        end = i + 6 + length if length else stop
        if data[i + 3] in HEADLESS:
            head = 6
        elif data[i + 6] & 0xC0 != 0x80:
            return None
        elif data[i + 7] & 0x80:
            b = data[i + 9 : i + 14]
            if data[i + 8] < 5 or len(b) < 5 or not b[0] & b[2] & b[4] & 1:
                return None
            t = (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1
        if end > stop or i + head > end:
            return None
        body = data[i + head : end]
        pts.append(t)
        if random[k]:
            points.append(done)
        done += len(body)
        parts.append(body)
    return {"payload": b"".join(parts), "packets": len(packets), "pts": pts, "random_access": points} if parts else None


def write_streams(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """Puts the transport stream of each text in column ``to`` in place of ``text``; adds n_bytes."""

    def make():
        def run(block):
            data = [t.encode() for t in texts(block, text)]
            return [[mux(padded(d)) for d in data], [len(d) for d in data]]

        return run

    return map_blocks(df, make, f"`{to}` binary, n_bytes long", drop=[text])


def read_streams(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what the stored streams hold: intact, payload, pts and random_access (arrays), n_packets."""

    def make():
        def run(block):
            got = [demux(m) for m in block.column(block.schema.get_field_index(media)).to_pylist()]
            return [[g is not None for g in got], *[[g and g[k] for g in got] for k in ("payload", "pts", "random_access", "packets")]]

        return run

    return map_blocks(df, make, "intact boolean, payload binary, pts array<long>, random_access array<long>, n_packets long")


def stream_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the stored streams back and describes each in place of ``media``, so that payloads don't leave the worker.

    feature: packets, units, random-access points, latest timestamp, sum of the payload's bytes and their distinct values. pts and random_access are stored as read.
    """

    def make():
        def run(block):
            rows = []
            for m in block.column(block.schema.get_field_index(media)).to_pylist():
                got = demux(m)
                if got is None:
                    rows.append((None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), "damaged", None, None))
                    continue
                p = got["payload"]
                counts = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
                feature = f"packets={got['packets']};units={len(got['pts'])};random={len(got['random_access'])};pts={max((t for t in got['pts'] if t is not None), default='none')};sum={int(counts @ np.arange(256))};values={int((counts > 0).sum())}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, got["pts"], got["random_access"]))
            return list(map(list, zip(*rows))) if rows else [[]] * 8

        return run

    return map_blocks(df, make, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>", drop=[media])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return stream_features(write_streams(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access")
