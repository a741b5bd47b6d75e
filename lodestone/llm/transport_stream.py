"""Media columns: payloads in MPEG transport streams.

``mux`` writes a program association table, a program map table and the payload in packetised elementary packets of
up to UNIT bytes on one private-data PID; every RAP_EVERY-th elementary packet is a random-access point. ``demux``
reads such bytes again (any number of private streams of one program): it parses the program tables, over as many
packets as they take, and checks their CRC, checks continuity counters, reassembles elementary packets and lists
timestamps and random-access points. A packet that repeats the one before, counter and all, is dropped, as is permitted
once; a counter's jump is counted as a discontinuity unless the stream announces it. Other broken streams raise ValueError.

Null and empty texts are a payload of 64 zero bytes. doc_ids of any type, null or repeated, are carried through; repeated
rows return equal values. Other columns, whatever their names, are left out. Each text is held by itself, so memory is
bounded by a batch.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, materialise

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM, PRIVATE_STREAM, PRIVATE_ID = 0x0000, 0x1000, 0x0100, 1, 0x06, 0xBD
UNIT, RAP_EVERY, TICKS, FIRST_PTS = 8192, 8, 3600, 90_000

READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 04C11DB7, not reflected, no final xor."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, content: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (5 + len(content) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    section = head + content
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet.ljust(PACKET, b"\xff")


_TABLES = _table(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")) + _table(
    PMT_PID, 0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        piece = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (8 + len(piece)).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes((FIRST_PTS + k * TICKS) % (1 << 33)) + piece
        random_access = k % RAP_EVERY == 0
        first = BODY - 2 if random_access else BODY  # a two-byte adaptation field holds the flag
        packets = 1 + max(0, -(-(len(pes) - first) // BODY))
        block = np.full((packets, PACKET), 0xFF, "u1")
        block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | ((counter + np.arange(packets)) & 0x0F)
        counter += packets
        data = np.frombuffer(pes, "u1")
        stuffing = first + (packets - 1) * BODY - len(data)  # in the last packet's adaptation field
        begin = 6 if random_access else 4
        if random_access:
            block[0, 3] |= 0x20
            block[0, 4:6] = 1, 0x40
        if packets == 1:
            if stuffing and random_access:
                block[0, 4] = 1 + stuffing
            elif stuffing:
                block[0, 3] |= 0x20
                block[0, 4] = stuffing - 1
                if stuffing > 1:
                    block[0, 5] = 0
            block[0, begin + stuffing :] = data
        else:
            block[0, begin:] = data[:first]
            middle = (packets - 2) * BODY
            block[1:-1, 4:] = data[first : first + middle].reshape(-1, BODY)
            if stuffing:
                block[-1, 3] |= 0x20
                block[-1, 4] = stuffing - 1
                if stuffing > 1:
                    block[-1, 5] = 0
            block[-1, 4 + stuffing :] = data[first + middle :]
        out.append(block.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds of one program."""

    program: int
    pmt_pid: int
    kinds: dict[int, int]
    units: list[tuple[int, int, bool]] = field(default_factory=list)  # elementary packet: PID, timestamp, random access
    payload: bytes = b""
    discontinuities: int = 0
    packets: int = 0


def _payload(packet: np.ndarray) -> bytes:
    """A packet's bytes behind its header and adaptation field."""
    if not packet[3] & 0x10:
        return b""
    return packet[4 + (int(packet[4]) + 1 if packet[3] & 0x20 else 0) :].tobytes()


def _section(rows: np.ndarray, pid: int) -> bytes:
    """The first whole section of a PID, from as many packets as it takes."""
    own = rows[((rows[:, 1].astype("i4") & 0x1F) << 8 | rows[:, 2]) == pid]
    starts = np.flatnonzero((own[:, 1] & 0x40) != 0)
    if not len(starts):
        raise ValueError(f"no table on PID {pid}")
    section, counter = b"", -1
    for packet in own[starts[0] :]:
        if section and packet[3] & 0x0F == counter:
            continue  # a repeated packet
        body, counter = _payload(packet), packet[3] & 0x0F
        if section:
            section += body[1:][: body[0]] if packet[1] & 0x40 else body
        else:
            section = body[1 + body[0] :]
        if len(section) >= 3 and len(section) >= (length := 3 + (int.from_bytes(section[1:3], "big") & 0x0FFF)):
            if crc32_mpeg(section[:length]):
                raise ValueError(f"the table on PID {pid} has a wrong CRC")
            return section[:length]
    raise ValueError(f"the table on PID {pid} has no end")


def _in_order(own: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets with payload of one PID, without repeated ones, and the jumps of their counter that aren't announced."""
    adapted = ((own[:, 3] & 0x20) != 0) & (own[:, 4] > 0)
    announced = np.cumsum(adapted & ((own[:, 5] & 0x80) != 0))
    filled = (own[:, 3] & 0x10) != 0
    own, announced = own[filled], announced[filled]
    same = np.concatenate([[False], (own[1:, 3:] == own[:-1, 3:]).all(1)]) if len(own) else np.zeros(0, "?")
    run = np.arange(len(own)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(own)))) if len(own) else np.zeros(0, "i8")
    keep = run % 2 == 0  # one repetition is permitted; a third packet alike is a jump
    own, announced = own[keep], announced[keep]
    counters = own[:, 3] & 0x0F
    jump = ((counters[1:] - counters[:-1]) & 0x0F) != 1
    return own, int((jump & (announced[1:] == announced[:-1])).sum())


def demux(media: bytes) -> Stream:
    """Parse a transport stream."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(media, "u1").reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    pat = _section(rows, PAT_PID)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(pat) - 4, 4)]
    program, pmt_pid = next((x for x in programs if x[0]), (0, 0))
    if not program:
        raise ValueError("the association table has no program")
    pmt = _section(rows, pmt_pid)
    i, kinds = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF), {}
    while i < len(pmt) - 4:
        kinds[int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF] = pmt[i]
        i += 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0x0FFF)
    out = Stream(program, pmt_pid, kinds, packets=len(rows))
    pids = (rows[:, 1].astype("i4") & 0x1F) << 8 | rows[:, 2]
    pieces = []
    for pid in kinds:
        own, jumps = _in_order(rows[pids == pid])
        if not len(own):
            continue
        out.discontinuities += jumps
        adapted = (own[:, 3] & 0x20) != 0
        skip = 4 + np.where(adapted, own[:, 4].astype("i4") + 1, 0)
        flagged = adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x40) != 0)
        keep = np.arange(PACKET) >= skip[:, None]
        data, ends = own[keep].tobytes(), np.cumsum(PACKET - skip)
        starts = np.flatnonzero(own[:, 1] & 0x40)
        at = (ends - (PACKET - skip))[starts]
        for begin, end, random_access in zip(at, [*at[1:], len(data)], flagged[starts]):
            pes = data[begin:end]
            if pes[:3] != b"\x00\x00\x01":
                raise ValueError("an elementary packet lacks its start code")
            length, header = int.from_bytes(pes[4:6], "big"), pes[8]
            p = pes[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 else -1
            out.units.append((pid, pts, bool(random_access)))
            pieces.append(pes[9 + header : 6 + length if length else len(pes)])
    out.payload = b"".join(pieces)
    return out


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row, in a table of the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                texts = b.column("text").slice(i, 512).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, 512), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    bound_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    media = own.mapInArrow(write, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")
    return materialise(media, "media", "zstd")


def feature_of(s: Stream) -> str:
    rap = [pts for _, pts, flag in s.units if flag]
    return f"program={s.program} streams={','.join(f'{pid}:{kind}' for pid, kind in sorted(s.kinds.items()))} packets={s.packets} units={len(s.units)} pts={min(u[1] for u in s.units)}-{max(u[1] for u in s.units)} rap={len(rap)} discontinuities={s.discontinuities}"


def read(media: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, n_bytes, media), from the stored bytes alone, with the timestamps and random-access points."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, m in zip(b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
                s = demux(m)
                rows.append((n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), binascii.crc32(s.payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(s), [u[1] for u in s.units], [u[1] for u in s.units if u[2]]))
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return media.mapInArrow(parse, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {READ}, timestamps array<long>, random_access array<long>")
