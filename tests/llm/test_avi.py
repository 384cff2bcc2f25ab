import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import avi

SCHEMA = "doc_id long, text string, media string, n_bytes int"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_round_trip(raw):
    payload = raw + bytes(-len(raw) % 192 or (192 if not raw else 0))
    media = avi.write_avi(avi.encode_frames(payload))
    frames, seconds = avi.read_avi(media)
    assert avi.decode_frames(frames).tobytes() == payload and seconds == 0.04


def test_extreme_steps_and_stuffing():
    payload = bytes([0, 255] * 96) + bytes([255] * 192) + bytes(range(192))
    frames = avi.encode_frames(payload)
    head = avi.frame_head()
    assert any(b"\xff\x00" in f[len(head) :] for f in frames)
    assert avi.decode_frames(frames).tobytes() == payload
    # the reader that takes any Huffman tables agrees with the one for ours
    slow = b"".join(avi._read_bits(f[len(head) : -2].replace(b"\xff\x00", b"\xff"), head).tobytes() for f in frames)
    assert slow == payload


def test_file_structure():
    media = avi.write_avi(avi.encode_frames(bytes(192 * 5)))
    assert media[:4] == b"RIFF" and struct.unpack("<I", media[4:8])[0] == len(media) - 8
    without = media[: media.index(b"idx1")]
    without = without[:4] + struct.pack("<I", len(without) - 8) + without[8:]
    assert avi.read_avi(without)[0] == avi.read_avi(media)[0]
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFX" + bytes(20))


def test_flat_block_decodes_to_its_byte():
    # DC alone: each sample of the inverse transform is quantiser * coefficient / 8, shifted by 128
    for value in (0, 1, 127, 128, 255):
        assert 8 * (value - 128) / 8 + 128 == value


def test_shots():
    a, b = np.full((10, 192), 40, np.uint8), np.full((7, 192), 200, np.uint8)
    firsts, change = avi.shots(np.concatenate([a, b, a]))
    assert firsts.tolist() == [0, 10, 17] and change.max() == 1.0
    assert avi.shots(a[:1])[0].tolist() == [0]


def test_report(spark):
    texts = [(1, "héllo " * 100), (2, None), (3, ""), (4, "x" * 192), (5, "y" * 193), (None, "z"), (1, "héllo " * 100), (6, "long " * 60_000)]
    rows = avi.report(spark.createDataFrame([(*t, "m", 1) for t in texts], SCHEMA)).collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    for doc, text in texts:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = by_id[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = avi.write_avi(avi.encode_frames(payload))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert by_id[2]["media_sha256"] == by_id[3]["media_sha256"]
    assert avi.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clips(spark):
    docs = spark.createDataFrame([(1, "a" * 192 * 4 + "\x05" * 192 * 4)], "doc_id long, text string")
    got = [(r["clip"], round(r["start_s"], 2), round(r["end_s"], 2), r["frames"]) for r in avi.clips(avi.media_column(docs)).orderBy("clip").collect()]
    assert got == [(0, 0.0, 0.16, 4), (1, 0.16, 0.32, 4)]
