"""Ogg pages: checksums, lacing, streams, times, damage; round trip of texts."""

import hashlib
import random
import zlib

import pytest

from rainloom.llm import ogg
from rainloom.llm.queries import QUERIES


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 3, 9, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)
    assert ogg.checksum(b"123456789") == 0x89A1897F


@pytest.mark.parametrize("sizes", [[0], [254], [255], [256], [510], [65025], [65024, 1], [70000, 5, 0, 130050], [1] * 600, [0] * 300])
def test_packets_survive_lacing(sizes):
    rng = random.Random(2)
    packets, end = [], 0
    for s in sizes:
        end += s
        packets.append((rng.randbytes(s), end))
    other = [(b"note", 0), (b"x" * 300, 7)]
    found = ogg.demux(ogg.mux({5: packets, 9: other}))
    assert not found.errors
    assert [p.data for p in found.streams[5].packets] == [d for d, _ in packets]
    assert [p.data for p in found.streams[9].packets] == [d for d, _ in other]
    assert found.streams[5].ended and found.streams[9].ended


def test_times_count_back_from_the_page():
    found = ogg.demux(ogg.mux({1: [(b"head", 0), (b"a" * 10, 10), (b"b" * 30, 40), (b"c" * 5, 45)]}), rate=10)
    assert [(p.end, p.seconds) for p in found.streams[1].packets] == [(0, 0.0), (10, 0.0), (40, 1.0), (45, 4.0)]


def test_damage_is_found_and_left_out():
    blocks = [(bytes([k]) * 576, 576 * (k + 1)) for k in range(200)]
    data = bytearray(ogg.mux({1: [(b"h", 0), *blocks]}))
    second = data.index(b"OggS", data.index(b"OggS", 1) + 1)
    data[second + 400] ^= 1  # in the body of the third page
    found = ogg.demux(bytes(data))
    assert any("checksum" in e for e in found.errors) and any("instead of" in e for e in found.errors)
    got = [p.data for p in found.streams[1].packets]
    assert got == [b"h"] + [b for b, _ in blocks[85 : 85 * (len(got) // 85) + 85]][: len(got) - 1] or len(got) < len(blocks)
    assert {bytes(g) for g in got[1:]} <= {b for b, _ in blocks}
    assert ogg.demux(bytes(data[: second + 10])).errors  # cut short
    assert ogg.demux(b"junk" + ogg.mux({1: [(b"h", 0)]})).streams[1].packets[0].data == b"h"
    assert not ogg.demux(b"").streams


def test_lost_page_cuts_its_packets():
    data = ogg.mux({1: [(b"h", 0), (b"x" * 100_000, 100_000), (b"y" * 10, 100_010)]})
    starts = [k for k in range(len(data)) if data[k : k + 4] == b"OggS"]
    found = ogg.demux(data[: starts[1]] + data[starts[2] :])
    assert [p.data for p in found.streams[1].packets] == [b"h", b"y" * 10]
    with pytest.raises(ValueError):
        ogg.decode(data[: starts[1]] + data[starts[2] :])


def expected(text):
    raw = (text or "").encode()
    n = max(576, -(-len(raw) // 576) * 576)
    payload = raw.ljust(n, b"\xff")
    return len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_query_on_whole_table(spark, data_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op1_ogg_media"](spark, data_dir).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        assert tuple(got[d][1:5]) == expected(t)
        media = ogg.encode(t.encode())
        assert (got[d]["media_bytes"], got[d]["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_edges(awkward, empty):
    got = ogg.load(ogg.store(awkward), payload=True).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d, t in ((1, None), (2, ""), (4, "one"), (None, "no id")):
        assert tuple(by[d][0][1:5]) == expected(t)
        assert bytes(by[d][0]["payload"])[: len((t or "").encode())] == (t or "").encode()
    assert len(by[11]) == 2 and by[10][0]["media_sha256"] == by[11][0]["media_sha256"]
    assert ogg.load(ogg.store(empty)).count() == 0


def test_damaged_and_missing_media(spark, make_docs):
    """Each row comes back: whole ones with their data, others with the reason."""
    media = {r["doc_id"]: bytes(r["media"]) for r in ogg.store(make_docs([(k, f"text {k} " * 200) for k in range(6)])).collect()}
    broken = {
        0: media[0], 1: None, 2: b"", 3: media[3][: len(media[3]) // 2], 4: media[4][:900] + bytes([media[4][900] ^ 1]) + media[4][901:], 5: b"no bitstream at all",
    }
    df = spark.createDataFrame([(k, m) for k, m in broken.items()], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in ogg.load(df).collect()}
    assert len(got) == 6 and got[0]["errors"] is None and got[0]["n_bytes"] == len("text 0 " * 200)
    for k in range(1, 6):
        assert got[k]["errors"] and got[k]["payload_sha256"] is None and got[k]["n_bytes"] is None
        assert got[k]["media_bytes"] == (None if broken[k] is None else len(broken[k]))
