import binascii
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import transport_stream as ts


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3 * ts.UNIT), st.randoms(use_true_random=False))
def test_round_trip(size, random):
    payload = random.randbytes(size) or b"\x00"
    media = ts.mux(payload)
    stream = ts.demux(media)
    assert stream.payload == payload and len(media) % ts.PACKET == 0
    assert stream.discontinuities == 0 and stream.kinds == {ts.DATA_PID: ts.PRIVATE_STREAM} and stream.program == ts.PROGRAM
    units = -(-len(payload) // ts.UNIT)
    assert [u[1] for u in stream.units] == [ts.FIRST_PTS + k * ts.TICKS for k in range(units)]
    assert [u[2] for u in stream.units] == [k % ts.RAP_EVERY == 0 for k in range(units)]


@pytest.mark.parametrize("size", [160, 168, 169, 170, 171, 172, 354, 8000])
def test_every_stuffing(size):
    for n in range(size, size + 12):
        assert ts.demux(ts.mux(b"x" * n)).payload == b"x" * n


def test_faults():
    media = ts.mux(b"a" * 2000)
    rows = [media[i : i + ts.PACKET] for i in range(0, len(media), ts.PACKET)]
    assert ts.demux(b"".join(rows[:4] + rows[5:])).discontinuities == 1
    with pytest.raises(ValueError):
        ts.demux(media[:-1])
    with pytest.raises(ValueError):
        ts.demux(b"\x00" + media[1:])
    broken = bytearray(media)
    broken[10] ^= 1
    with pytest.raises(ValueError):
        ts.demux(bytes(broken))


def test_columns(spark):
    texts = [None, "", "abc", "abc", "é" * 32, "long " * 40_000]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in ts.read(ts.store(df)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        payload, r = ts.padded(t), rows[i]
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == binascii.crc32(payload[-64:])
        media = ts.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[0].feature == rows[1].feature and rows[2][1:] == rows[3][1:]
    assert ts.read(ts.store(df.limit(0))).count() == 0


def packets_of(section, pid):
    """A section over as many packets as it takes."""
    data, out = b"\x00" + section, []
    for k, at in enumerate(range(0, len(data), ts.BODY)):
        head = bytes([ts.SYNC]) + ((0x4000 if not k else 0) | pid).to_bytes(2, "big") + bytes([0x10 | k % 16])
        out.append((head + data[at : at + ts.BODY]).ljust(ts.PACKET, b"\xff"))
    return out


def test_tables_over_several_packets():
    streams = b"".join(bytes([6]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(100))
    content = (0xE000 | ts.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([6]) + (0xE000 | ts.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + streams
    section = b"\x02" + (0xB000 | (5 + len(content) + 4)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + content
    pmt = packets_of(section + ts.crc32_mpeg(section).to_bytes(4, "big"), ts.PMT_PID)
    media = ts.mux(b"q" * 3000)
    found = ts.demux(media[: ts.PACKET] + b"".join(pmt) + media[2 * ts.PACKET :])
    assert len(pmt) > 2 and len(found.kinds) == 101 and found.payload == b"q" * 3000
    with pytest.raises(ValueError):
        ts.demux(media[: ts.PACKET] + b"".join(pmt[:-1]) + media[2 * ts.PACKET :])
    empty = b"\x00\xb0\x09\x00\x01\xc1\x00\x00"
    with pytest.raises(ValueError, match="no program"):
        ts.demux(b"".join(packets_of(empty + ts.crc32_mpeg(empty).to_bytes(4, "big"), ts.PAT_PID)) + media[ts.PACKET :])


def test_repeated_packets_and_announced_jumps():
    payload = bytes(range(256)) * 20
    media = ts.mux(payload)
    rows = [media[i : i + ts.PACKET] for i in range(0, len(media), ts.PACKET)]
    for at in (2, 5, len(rows) - 1):
        found = ts.demux(b"".join([*rows[: at + 1], rows[at], *rows[at + 1 :]]))
        assert (found.payload, found.discontinuities) == (payload, 0)
    assert ts.demux(b"".join([*rows[:6], rows[5], rows[5], *rows[6:]])).discontinuities >= 1
    announce = bytes([ts.SYNC]) + ts.DATA_PID.to_bytes(2, "big") + b"\x20\xb7\x80" + b"\xff" * (ts.PACKET - 6)
    assert ts.demux(b"".join([*rows[:5], announce, *rows[6:]])).discontinuities == 0


def plainly(media):
    """(payload, timestamps, random-access timestamps) by one look at each packet."""
    units, flags = [], []
    for at in range(0, len(media), ts.PACKET):
        p = media[at : at + ts.PACKET]
        if (p[1] & 0x1F) * 256 + p[2] != ts.DATA_PID:
            continue
        body, flag = p[4:], False
        if p[3] & 0x20:
            flag, body = bool(p[4] and p[5] & 0x40), p[5 + p[4] :]
        if p[1] & 0x40:
            units.append(b"")
            flags.append(flag)
        units[-1] += body
    stamps = [int(f"{u[9]:08b}"[4:7] + f"{u[10]:08b}" + f"{u[11]:08b}"[:7] + f"{u[12]:08b}" + f"{u[13]:08b}"[:7], 2) for u in units]
    return b"".join(u[14:] for u in units), stamps, [s for s, f in zip(stamps, flags) if f]


def test_columns_like_a_plain_reader(spark):
    texts = ["", "x" * 100, "word " * 9000, "é" * 70_000]
    df = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    rows = {r.doc_id: r for r in ts.read(ts.store(df)).collect()}
    for i, t in enumerate(texts):
        payload, stamps, random_access = plainly(ts.mux(ts.padded(t)))
        r = rows[f"id{i}"]
        assert payload == ts.padded(t) and (r.timestamps, r.random_access) == (stamps, random_access)
        assert r.feature == f"program=1 streams=256:6 packets={r.media_bytes // 188} units={len(stamps)} pts={min(stamps)}-{max(stamps)} rap={len(random_access)} discontinuities=0"
