"""Media columns: AVI files of motion-JPEG frames, written, parsed, decoded and cut into shots.

A frame is a baseline JPEG of 128 x 96 grey samples, 16 x 12 blocks of 8 x 8. Each block is flat and carries one byte:
with a DC quantiser of 8 its only coefficient is the byte less 128, and any decoder gives the byte back as the value of
all 64 samples, so storing is lossless. The Huffman table gives category s a code of 9 - s bits and s further bits
follow, so each difference takes 9 bits and each block, with one bit that ends it, 10: a frame's entropy-coded data is
read without a loop over bits. Frames with other tables are read bit by bit.

Frames are intra coded; the RIFF index (idx1) is parsed for their places. Shots are cut where the difference of
successive grey histograms exceeds the mean of the differences before it by a multiple of their deviation.

Defined cases: a null text is empty and gives one frame of spaces; equal texts give equal bytes; repeated rows come
back each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

ACROSS, DOWN, RATE = 16, 12, 25
UNIT = ACROSS * DOWN  # payload bytes of a frame
PAD = b" "
#: Fixed values of the format: order of coefficients in a table, and markers.
SOI, EOI, APP0, DQT, SOF0, DHT, SOS = 0xD8, 0xD9, 0xE0, 0xDB, 0xC0, 0xC4, 0xDA
#: Bits that a DC category's code takes in our table; category s adds s bits, so all take 9.
WIDTH = 9


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def frame_head() -> bytes:
    """All before a frame's entropy-coded data, the same for every frame."""
    quantisers = bytes([8] + [1] * 63)
    dc = bytes([sum(WIDTH - s == n for s in range(9)) for n in range(1, 17)]) + bytes(range(8, -1, -1))
    ac = bytes([1] + [0] * 15) + bytes([0])  # one code of one bit: the block's end
    return (
        struct.pack(">BB", 0xFF, SOI)
        + _segment(APP0, b"AVI1" + bytes(10))
        + _segment(DQT, bytes([0]) + quantisers)
        + _segment(SOF0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
        + _segment(DHT, bytes([0x00]) + dc + bytes([0x10]) + ac)
        + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@lru_cache(maxsize=1)
def _code_of() -> np.ndarray:
    """For each difference from -255 to 255 its 10 bits: code, further bits, end of block."""
    codes, code = {}, 0
    for n in range(1, WIDTH + 1):  # canonical: codes of n bits follow on those of n - 1
        codes[WIDTH - n] = code
        code = (code + 1) << 1
    table = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        table[d + 255] = (((codes[s] << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1) & 0x3FF
    return table


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG for each UNIT bytes of the payload."""
    values = np.frombuffer(payload, np.uint8).astype(np.int16).reshape(-1, UNIT) - 128
    steps = np.diff(values, axis=1, prepend=np.int16(0))
    bits = _code_of()[steps + 255].reshape(-1, 4).astype(np.uint64)
    five = (bits[:, 0] << 30) | (bits[:, 1] << 20) | (bits[:, 2] << 10) | bits[:, 3]
    data = five.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    size, head, tail = UNIT * 10 // 8, frame_head(), struct.pack(">BB", 0xFF, EOI)
    return [head + data[i : i + size].replace(b"\xff", b"\xff\x00") + tail for i in range(0, len(data), size)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """One video stream of motion-JPEG with an index."""
    n, largest = len(frames), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 24, b"MJPG", ACROSS * 8 * DOWN * 8 * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        parts += [b"00dc", struct.pack("<I", len(frame)), frame, b"\0" * (len(frame) % 2)]
        at += 8 + len(frame) + len(frame) % 2
    body = b"AVI " + head + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """(frames, seconds of a frame). Places come from idx1, whose offsets count from the list's name; without it, from the list itself."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    spans = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while spans:
        at, end = spans.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                found[kind] = (at + 8, size)
                if kind != b"movi":
                    spans.append((at + 12, at + 8 + size))
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + size % 2
    seconds = struct.unpack_from("<I", media, found[b"avih"][0])[0] / 1e6
    base, size = found[b"movi"]
    if b"idx1" in found:
        at, n = found[b"idx1"]
        rows = np.frombuffer(media, np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), n // 16, at)
        places = [(base + a + 8, s) for a, s in zip(rows["at"].tolist(), rows["size"].tolist())]
    else:
        places, at = [], base + 4
        while at + 8 <= base + size:
            n = struct.unpack_from("<I", media, at + 4)[0]
            places.append((at + 8, n))
            at += 8 + n + n % 2
    return [media[a : a + n] for a, n in places], seconds


@lru_cache(maxsize=64)
def _tables(head: bytes) -> tuple[int, int, int, dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Blocks down and across, DC quantiser, and the DC and AC codes (bits, code) -> symbol of a frame's head."""
    at, quantiser, shape, codes = 2, {}, None, {}
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + size], at + 2 + size
        if marker == DQT:
            quantiser[body[0] & 15] = body[1]
        elif marker == SOF0:
            shape = struct.unpack_from(">HH", body, 1)
        elif marker == DHT:
            i = 0
            while i < len(body):
                key, counts = body[i], body[i + 1 : i + 17]
                symbols, i, code, table = body[i + 17 : i + 17 + sum(counts)], i + 17 + sum(counts), 0, {}
                it = iter(symbols)
                for bits, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[bits, code] = next(it)
                        code += 1
                    code <<= 1
                codes[key] = table
    return shape[0] // 8, shape[1] // 8, quantiser[0], codes[0x00], codes[0x10]


@lru_cache(maxsize=64)
def _steps(head: bytes) -> np.ndarray | None:
    """Difference of each 10 bits, if the head's table makes all blocks 10 bits long."""
    _, _, _, dc, ac = _tables(head)
    if ac != {(1, 0): 0} or any(bits + s != WIDTH for (bits, _), s in dc.items()):
        return None
    table = np.zeros(1024, np.int16)
    for (bits, code), s in dc.items():
        for x in range(1 << s):
            table[((code << s) | x) << 1] = x if s == 0 or x >> (s - 1) else x - (1 << s) + 1
    return table


def _read_bits(data: bytes, head: bytes) -> np.ndarray:
    """A frame's DC values by whatever Huffman tables its head has; AC coefficients are passed over."""
    down, across, quantiser, dc, ac = _tables(head)
    bits, at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0
    out, last = [], 0

    def symbol(table):
        nonlocal at
        code = n = 0
        while (n, code) not in table or n == 0:
            code, n, at = code << 1 | bits[at], n + 1, at + 1
        return table[n, code]

    def extra(s):
        nonlocal at
        x = int("0" + "".join(map(str, bits[at : at + s])), 2)
        at += s
        return x if s == 0 or x >> (s - 1) else x - (1 << s) + 1

    for _ in range(down * across):
        last += extra(symbol(dc))
        out.append(last * quantiser // 8 + 128)
        k = 1
        while k < 64 and (rs := symbol(ac)):
            k += (rs >> 4) + 1
            extra(rs & 15)
    return np.array(out, np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Block values (frames, blocks) of JPEGs whose blocks are flat; frames of one head are decoded together."""
    by_head: dict[bytes, list[int]] = {}
    data = []
    for i, frame in enumerate(frames):
        cut = frame.index(b"\xff\xda")
        cut += 2 + struct.unpack_from(">H", frame, cut + 2)[0]
        by_head.setdefault(frame[:cut], []).append(i)
        data.append(frame[cut : frame.rindex(b"\xff\xd9")])
    out = None
    for head, of in by_head.items():
        down, across, quantiser, _, _ = _tables(head)
        steps = _steps(head)
        if steps is None:
            values = np.stack([_read_bits(data[i].replace(b"\xff\x00", b"\xff"), head) for i in of])
        else:
            raw = np.frombuffer(b"".join(data[i] for i in of).replace(b"\xff\x00", b"\xff"), np.uint8).reshape(-1, 5).astype(np.uint16)
            ten = np.empty((len(raw), 4), np.uint16)
            for k in range(4):
                ten[:, k] = ((raw[:, k] << (2 + 2 * k)) | (raw[:, k + 1] >> (6 - 2 * k))) & 0x3FF
            values = (np.cumsum(steps[ten].reshape(len(of), down * across), axis=1) * quantiser // 8 + 128).astype(np.uint8)
        if out is None:
            out = np.empty((len(frames), values.shape[1]), np.uint8)
        out[of] = values
    return out


def shots(values: np.ndarray, *, bins: int = 16, times: float = 2.0, window: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(first frames of shots, histogram differences). A frame begins a shot if its histogram differs from the one before by more
    than mean + times * deviation of the `window` differences before it, and by a tenth of the blocks at least."""
    n = len(values)
    flat = (np.arange(n)[:, None] * bins + values // (256 // bins)).ravel()
    counts = np.bincount(flat, minlength=n * bins).reshape(n, bins).astype(np.int64)
    change = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * values.shape[1])
    first = np.concatenate(([0.0], np.cumsum(change)))
    second = np.concatenate(([0.0], np.cumsum(change**2)))
    i = np.arange(len(change))
    a = np.maximum(i - window, 0)
    k = np.maximum(i - a, 1)
    mean = (first[i] - first[a]) / k
    deviation = np.sqrt(np.maximum((second[i] - second[a]) / k - mean**2, 0))
    return np.concatenate(([0], np.flatnonzero((change > mean + times * deviation) & (change >= 0.1)) + 1)), change


def timed(firsts: np.ndarray, change: np.ndarray, frames: int, seconds: float) -> list[tuple[float, float, int, float]]:
    """(start, end, frames, the difference that began it) of each shot."""
    ends = [*firsts[1:].tolist(), frames]
    return [(a * seconds, b * seconds, b - a, float(change[a - 1]) if a else 0.0) for a, b in zip(firsts.tolist(), ends)]


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as an AVI file. Batches go on at about batch_bytes of media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_bytes", "media"])

        for batch in batches:
            rows, total = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                payload = padded(text)
                media = write_avi(encode_frames(payload))
                rows.append((doc.as_py(), len((text or "").encode("utf-8", "surrogatepass")), media))
                total += len(media)
                if total >= batch_bytes:
                    yield out(rows)
                    rows, total = [], 0
            if rows:
                yield out(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames, change: a timed row for each shot of each file; change is the difference that began it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                if blob.as_py() is None:
                    continue
                frames, seconds = read_avi(blob.as_py())
                values = decode_frames(frames)
                rows += [(doc, i, *clip) for i, clip in enumerate(timed(*shots(values), len(values), seconds))]
            types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], ["doc_id", "clip", "start_s", "end_s", "frames", "change"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, start_s double, end_s double, frames long, change double")


_REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double,frames:bigint,change:double>>"


def digests(media: DataFrame) -> DataFrame:
    """One row for each file: digests of the bytes that decoding gives and of the file, and its shots as a feature string and as timed clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, blob in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                blob = blob.as_py()
                frames, seconds = read_avi(blob)
                values = decode_frames(frames)
                payload = values.tobytes()
                firsts, change = shots(values)
                feature = f"frames={len(values)};seconds={len(values) * seconds:.2f};shots={len(firsts)};starts={','.join(f'{a * seconds:.2f}' for a in firsts.tolist())};change={change.max(initial=0.0):.6f}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, timed(firsts, change, len(values), seconds)))
            clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64()), ("change", pa.float64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip)
            names = [x.split()[0] for x in _REPORT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names)
        release()

    return media.mapInArrow(run, _REPORT)


def report(docs: DataFrame) -> DataFrame:
    return digests(media_column(docs))
