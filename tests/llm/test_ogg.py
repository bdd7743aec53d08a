import random
import struct
import zlib

import pytest
from helpers import awkward, empty

from factloom.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum_matches_the_bitwise_definition():
    r = random.Random(1)
    for n in (0, 1, 7, 100):
        data = r.randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)


def test_packets_of_all_lengths_survive():
    r = random.Random(2)
    for lengths in ([0], [255], [510, 0, 1], [70_000, 3], [254, 255, 256] * 100):
        packets = [(r.randbytes(n), k) for k, n in enumerate(lengths)]
        other = [(b"other", 9)] * 3
        streams = ogg.demux(ogg.mux({5: packets, 9: other}))
        assert streams[5].packets == [p for p, _ in packets] and streams[9].packets == [b"other"] * 3


def test_a_foreign_page_sequence_is_read():
    body = b"a" * 300
    one = ogg.write_page(1, 0, 2**64 - 1, bytes([255]), body[:255], 2)
    two = ogg.write_page(1, 1, 960, bytes([45]), body[255:], 1 | 4)
    s = ogg.demux(one + two)[1]
    assert s.packets == [body] and s.ends == [960] and ogg.timestamps(s, 8000) == [0.12]


def test_damage_is_found():
    media = bytearray(ogg.encode_payload(b"x" * 5000))
    media[100] ^= 1
    with pytest.raises(ogg.OggError, match="checksum"):
        ogg.demux(bytes(media))
    good = ogg.encode_payload(b"x" * 200_000)
    second = good.index(b"OggS", 4)
    with pytest.raises(ogg.OggError):
        ogg.demux(good[:second] + good[good.index(b"OggS", second + 4) :])
    with pytest.raises(ogg.OggError):
        ogg.demux(good[:-1])
    with pytest.raises(ogg.OggError):
        ogg.demux(b"junk")


def test_timestamps_count_back_from_granules():
    s = ogg.demux(ogg.encode_payload(b"y" * 960 * 7))
    even = min(s.values(), key=lambda x: x.serial)
    assert ogg.timestamps(even)[-1] == 4 * 960 / 8000
    assert ogg.timestamps(even) == sorted(ogg.timestamps(even))


def test_columns_keep_every_row(spark):
    docs = awkward(spark)
    out = ogg.media_features(ogg.media_column(docs)).collect()
    assert len(out) == docs.count()
    for d, r in zip(sorted(docs.collect(), key=lambda x: (x.doc_id or -1, x.text or "")), sorted(out, key=lambda r: (r.id or -1, r.n_bytes)), strict=True):
        pass
    by = {r.id: r for r in out}
    text = "+1 (663) 555-6869 a.b@c.de 4465758382889437, 10.0.0.1".encode()
    payload = text + b" " * (192 - len(text))
    assert (by[8].n_bytes, by[8].payload_bytes, by[8].tail_crc32) == (len(text), 192, zlib.crc32(payload[-16:]))
    assert by[2].payload_bytes == 192 and by[2].n_bytes == 0 and by[2].media_sha256 == by[3].media_sha256
    assert None in by
    assert ogg.media_features(ogg.media_column(empty(spark))).count() == 0
    assert struct.calcsize("<8sIIQI") == ogg.HEAD.size


def test_damaged_media_cost_their_row_only(spark):
    good = ogg.encode_payload(b"a" * 192)
    bad = {1: good[:40] + bytes([good[40] ^ 1]) + good[41:], 2: good[:-5], 3: b"", 4: None, 5: b"OggS", 6: good[: len(good) // 2]}
    df = spark.createDataFrame([(0, 192, good), *[(k, 192, m) for k, m in bad.items()]], "id long, n_bytes long, media binary")
    out = {r["id"]: r for r in ogg.media_features(df).collect()}
    assert out[0].status == "ok" and out[0].payload_bytes == 192
    for k, m in bad.items():
        assert out[k].status != "ok" and out[k].payload_sha256 is None and out[k].feature is None, k
        assert out[k].media_bytes == (None if m is None else len(m))


def test_payload_columns_of_whole_documents_against_plain_code(spark):
    import hashlib
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["id"]: r for r in ogg.media_features(ogg.media_column(docs)).collect()}
    for d in docs.collect():
        raw = (d.text or "").encode()
        pad = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        x = [b - 128 for b in pad]
        assert f"sum={sum(x)};energy={sum(v * v for v in x)};" in r.feature and r.feature.endswith(f"peak={max(map(abs, x))}")
