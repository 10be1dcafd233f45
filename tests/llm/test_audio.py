import hashlib
import random
import zlib

import pytest

from motif.llm import audio


def test_features_hold_durations_and_the_place_of_every_frame(make):
    texts = [None, "", "short", "long text " * 30_000, "short"]
    rows = {r["doc_id"]: r for r in audio.media_features(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        stored = audio.write(audio.padded(t)[0])
        r = rows[i]
        assert all(stored[at] == 0xFF and stored[at + 1] >> 5 == 7 for at in r["seek_offsets"])
        assert r["samples"] == 1152 * len(r["seek_offsets"]) and r["sample_rate"] in (32000, 44100, 48000)
    assert rows[2].asDict() | {"doc_id": 4} == rows[4].asDict() and len(rows[3]["seek_offsets"]) > 300


@pytest.mark.parametrize("n", [0, 1, 63, 64, 936, 937, 938, 5000, 60000])
def test_round_trip_and_seek_offsets(n):
    payload = bytes(random.Random(n).choices([0xFF, 0xFB, 0xFA, 0xE0, 0, 1, 0x90], k=n))
    stored = audio.write(payload)
    found = audio.parse(stored)
    assert audio.read(stored, found) == payload
    assert found.samples == 1152 * len(found.offsets) and found.rate == 48000 and found.seconds == found.samples / 48000
    assert found.checked == len(found.offsets) and not found.failed and not found.skipped
    assert found.table["kind"] == "Xing" and found.table["frames"] == len(found.offsets)
    assert all(stored[i] == 0xFF for i in found.offsets)


def test_payloads_that_hold_a_tag_at_any_place_from_the_end():
    for n in (128, 192, 936, 1024):
        for at in range(max(0, n - 260), n - 2):
            payload = (b"x" * at + b"TAG").ljust(n, b"y")
            assert audio.read(audio.write(payload)) == payload


def test_resynchronises_after_junk_and_counts_damage():
    stored = audio.write(bytes(range(256)) * 20)
    clean = audio.parse(stored)
    junk = b"\xff\xfb\x90\x00 junk " * 5
    assert audio.parse(junk + stored).offsets[-1] == clean.offsets[-1] + len(junk)
    cut = clean.offsets[2]
    noisy = audio.parse(stored[:cut] + b"????" + stored[cut:])
    assert noisy.samples == clean.samples and noisy.skipped == 4
    broken = bytearray(stored)
    broken[clean.offsets[1] + 10] ^= 1
    assert audio.parse(bytes(broken)).failed == 1
    with pytest.raises(ValueError):
        audio.read(bytes(broken))
    assert audio.parse(b"").offsets == [] and audio.parse(b"no audio").offsets == []


def test_foreign_headers_tags_and_tables():
    assert audio.read_header(bytes.fromhex("fffb9064")).size == 417
    assert audio.read_header(bytes.fromhex("fff38064")).samples == 576
    assert audio.read_header(bytes.fromhex("ffff9064")).kind[1] == 1
    assert audio.read_header(bytes.fromhex("fffbf064")) is None and audio.read_header(b"ID3\x04") is None
    frame = bytes.fromhex("fffb9064") + bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + bytes(8)
    tail = b"TAG" + b"Name".ljust(125, b"\0")
    found = audio.parse(frame.ljust(417, b"\0") + (bytes.fromhex("fffb9064") + bytes(413)) * 3 + tail)
    assert found.table["kind"] == "VBRI" and found.table["frames"] == 12 and len(found.offsets) == 3 and found.tags["title"] == "Name"


def test_crc_of_known_rows():
    def slow(data):
        crc = 0xFFFF
        for byte in data:
            for bit in range(7, -1, -1):
                top = crc >> 15 ^ byte >> bit & 1
                crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        return crc

    import numpy as np

    rows = np.random.default_rng(2).integers(0, 256, (20, 19), dtype=np.uint8)
    assert audio.crc16(rows).tolist() == [slow(r.tolist()) for r in rows]


def test_features(make):
    rows = [(1, "héllo"), (2, None), (2, None), (None, ""), (3, "héllo"), (4, "x" * 64), (5, "x" * 65)]
    found = audio.media_features(make(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r["doc_id"]] or ""
        raw = text.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert len({repr(r[1:]) for r in found if r["doc_id"] in (1, 3)}) == 1
    assert audio.media_features(make([])).collect() == []
    stored = audio.media_column(make(rows[:1])).first()
    assert audio.read(bytes(stored["media"])).startswith("héllo".encode()) and stored["sample_rate"] == 48000
