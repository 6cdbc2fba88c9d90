"""Media columns: AVI motion-JPEG, lossless.

A payload becomes the 8-bit samples of intra frames 64 samples wide.  Each frame is a
lossless JPEG (process SOF3, left-neighbour prediction, one Huffman table, a restart
after every line), so what is read back is what was stored; the frames lie in a RIFF AVI
with an ``idx1`` index.  The last frame may have fewer lines, as its own header states.

Restarts make every line a lane of its own: all lines of a batch are coded and decoded
side by side, one sample column after another.

Shots are cut where the histogram difference of neighbouring frames exceeds a threshold
that adapts to the differences within the shot so far.

Edge cases: a null or empty text is a payload of 64 zero bytes; equal texts give equal
values; repeated rows give repeated results; an empty table gives an empty result; a
null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

WIDTH, LINES, FPS = 64, 32, 25
#: Code lengths by difference category, short for those that text has most of; the all-ones code stays free, as the standard asks.
LENGTHS = {4: 2, 7: 2, 2: 3, 3: 3, 0: 4, 1: 4, 5: 4, 6: 5, 8: 6}
PEEK = 14


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Category -> (code, length), codes given out in order of length."""
    codes, code, last = {}, 0, 0
    for category, length in lengths.items():
        code <<= length - last
        codes[category], last = (code, length), length
        code += 1
    return codes


@lru_cache(maxsize=1)
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For a difference d, at d + 255: its code with the additional bits, and how many bits that is."""
    codes, value, bits = canonical(LENGTHS), np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = codes[category]
        value[d + 255] = code << category | (d if d >= 0 else d + (1 << category) - 1)
        bits[d + 255] = length + category
    return value, bits


@lru_cache(maxsize=8)
def peek_tables(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the next PEEK bits: the difference they begin with, and its bits (0: no code), by a DHT segment's body."""
    counts, symbols = spec[1:17], spec[17:]
    lengths = dict(zip(symbols, (n for n, k in enumerate(counts, 1) for _ in range(k))))
    diff, used = np.zeros(1 << PEEK, np.int16), np.zeros(1 << PEEK, np.int64)
    for category, (code, length) in canonical(lengths).items():
        for extra in range(1 << category):
            total = length + category
            if total > PEEK:
                raise ValueError("code too long")
            d = extra if not category or extra >> (category - 1) else extra - (1 << category) + 1
            at = (code << category | extra) << (PEEK - total)
            diff[at : at + (1 << (PEEK - total))], used[at : at + (1 << (PEEK - total))] = d, total
    return diff, used


@lru_cache(maxsize=LINES)
def frame_head(lines: int) -> bytes:
    by_length = [sum(n == length for n in LENGTHS.values()) for length in range(1, 17)]
    table = bytes([0, *by_length, *LENGTHS])
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + segment(0xC4, table)
        + segment(0xC3, struct.pack(">BHHB", 8, lines, WIDTH, 1) + bytes([1, 0x11, 0]))
        + segment(0xDD, struct.pack(">H", WIDTH))
        + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def encode_lines(samples: np.ndarray, last_of_frame: np.ndarray, line_of_frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all lines with stuffing and restart markers, and where each line starts in them (and the end)."""
    value, bits = code_tables()
    d = np.ascontiguousarray(samples.T).astype(np.int16)  # a sample column a row
    d[1:] -= d[:-1].copy()
    d[0] -= 128
    d += 255
    end = np.cumsum(bits[d], axis=0)
    size = (end[-1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    raw, at = np.zeros(base[-1] + 3, np.uint8), 8 * base[:-1]
    for j in range(len(d)):  # the lines' bytes are apart, so no index repeats
        n = bits[d[j]]
        v = value[d[j]] << (24 - n - (at & 7)).astype(np.uint32)
        b = at >> 3
        raw[b] |= (v >> 16).astype(np.uint8)
        raw[b + 1] |= (v >> 8).astype(np.uint8)
        raw[b + 2] |= v.astype(np.uint8)
        at = at + n
    raw = raw[:-3]
    raw[base[1:] - 1] |= ((1 << (8 * size - end[-1])) - 1).astype(np.uint8)
    stuffed = np.concatenate([[0], np.cumsum(raw == 255)])
    marks = np.concatenate([[0], np.cumsum(~last_of_frame)]) * 2
    start = base + stuffed[base] + marks
    out = np.zeros(start[-1], np.uint8)
    out[np.arange(len(raw)) + stuffed[:-1] + np.repeat(marks[:-1], size)] = raw
    restart = np.flatnonzero(~last_of_frame)
    out[start[restart + 1] - 2] = 255
    out[start[restart + 1] - 1] = 0xD0 + line_of_frame[restart] % 8
    return out, start


def avi(frames: list[bytes], lines: int) -> bytes:
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    biggest = max(map(len, frames))
    head = struct.pack("<14I", 1_000_000 // FPS, biggest * FPS, 0, 0x10, len(frames), 0, 1, biggest, WIDTH, lines, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), biggest, 10_000, 0, 0, 0, WIDTH, lines)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, lines, 1, 8, b"MJPG", WIDTH * lines, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        body = chunk(b"00dc", frame)
        movi.append(body)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body)
    body = b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload, whose length is a positive multiple of 64."""
    if not payloads:
        return []
    counts = np.array([len(p) // WIDTH for p in payloads])
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    first = np.concatenate([[0], np.cumsum(counts)])
    line = np.arange(len(samples)) - np.repeat(first[:-1], counts)
    last = (line % LINES == LINES - 1) | (line == np.repeat(counts, counts) - 1)
    out, start = encode_lines(samples, last, line % LINES)
    data, out = memoryview(out), []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        frames = []
        for a in range(begin, end, LINES):
            b = min(a + LINES, end)
            frames.append(b"".join((frame_head(b - a), data[start[a] : start[b]], b"\xff\xd9")))
        out.append(avi(frames, min(LINES, end - begin)))
    return out


def chunks(data: memoryview, at: int, end: int):
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def frames_of(media: bytes) -> list[memoryview]:
    """The video frames that the index of an AVI lists."""
    data = memoryview(media)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not a RIFF AVI")
    movi = index = None
    for name, at, size in chunks(data, 12, len(data)):
        if name == b"LIST" and bytes(data[at : at + 4]) == b"movi":
            movi = at
        elif name == b"idx1":
            index = data[at : at + size]
    if movi is None or index is None:
        raise ValueError("no movi list or no idx1 index")
    out = []
    for kind, _, at, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if kind[2:] in (b"dc", b"db"):
            out.append(data[movi + at + 8 : movi + at + 8 + size])
    return out


def frame_parts(frame: memoryview) -> tuple[bytes, int, memoryview]:
    """(DHT body, lines, entropy-coded data) of a lossless JPEG frame of this module's profile."""
    at, table, lines = 2, b"", 0
    if bytes(frame[:2]) != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        marker, size = frame[at + 1], frame[at + 2] << 8 | frame[at + 3]
        body = bytes(frame[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xC4:
            table = body
        elif marker == 0xC3:
            precision, lines, width, _ = struct.unpack_from(">BHHB", body)
            if (precision, width) != (8, WIDTH):
                raise ValueError("unknown frame size or precision")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only lossless frames are decoded")
        elif marker == 0xDD and body != struct.pack(">H", WIDTH):
            raise ValueError("only a restart after each line is decoded")
        elif marker == 0xDA:
            return table, lines, frame[at : len(frame) - 2]


def decode(media: list[bytes]) -> tuple[np.ndarray, list[list[int]]]:
    """All samples of the media, a row a line, and for each media the lines of its frames."""
    parts, heights = [], []
    for one in media:
        own = [frame_parts(f) for f in frames_of(one)]
        heights.append([p[1] for p in own])
        parts += own
    tables = {p[0] for p in parts}
    if len(tables) > 1:  # frames of other encoders: each table by itself
        both = [decode([m]) for m in media] if len(media) > 1 else None
        if not both:
            raise ValueError("the frames of one AVI differ in their tables")
        return np.concatenate([b[0] for b in both]), heights
    if not parts:
        return np.zeros((0, WIDTH), np.uint8), heights
    data = np.frombuffer(b"".join(p[2] for p in parts) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])[:-1]
    flags = np.flatnonzero(data[:-1] == 255)
    after = data[flags + 1]
    keep = np.ones(len(data), bool)
    keep[flags[after == 0] + 1] = False
    marks = flags[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    lanes = np.sort(np.concatenate([place[begin], place[marks + 2]]))
    if len(lanes) != sum(map(sum, heights)):
        raise ValueError("restart markers and lines differ")
    raw = np.concatenate([data[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    diff, used = peek_tables(tables.pop())
    at, value = lanes.astype(np.int64) * 8, np.full(len(lanes), 128, np.int16)
    samples = np.empty((WIDTH, len(lanes)), np.uint8)
    for j in range(WIDTH):
        peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - PEEK)
        n = used[peek]
        value += diff[peek]
        at += n
        samples[j] = value
    return np.ascontiguousarray(samples.T), heights


def shots(histograms: np.ndarray, *, spread: float = 3.0, least: float = 0.2, memory: int = 8) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A shot ends where the L1 difference of neighbouring normalised histograms exceeds
    ``least`` and the mean of the shot's last ``memory`` differences by ``spread``
    standard deviations.
    """
    total = histograms.sum(axis=1, keepdims=True)
    change = np.abs(np.diff(histograms / total, axis=0)).sum(axis=1)
    out, start, past = [], 0, []
    for i, d in enumerate(change.tolist(), 1):
        recent = past[-memory:]
        mean = sum(recent) / len(recent) if recent else least
        deviation = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(least, mean + spread * deviation):
            out.append((start, i))
            start, past = i, []
        else:
            past.append(d)
    return [*out, (start, len(histograms))]


def histograms_of(samples: np.ndarray, heights: list[list[int]], bins: int = 16) -> list[np.ndarray]:
    """For each media the histograms of its frames."""
    flat = [h for own in heights for h in own]
    frame = np.repeat(np.arange(len(flat)), flat)
    counted = np.bincount((frame[:, None] * bins + (samples >> 4)).ravel(), minlength=bins * len(flat)).reshape(-1, bins)
    return np.split(counted, np.cumsum([len(own) for own in heights])[:-1])


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def portions(values: list, size, most: int = 2_000_000):
    """Runs of ``values`` of about ``most`` bytes, a larger value alone."""
    run, total = [], 0
    for v in values:
        if run and total + size(v) > most:
            yield run
            run, total = [], 0
        run.append(v)
        total += size(v)
    if run:
        yield run


def to_media(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, n_bytes and the AVI in the binary column media."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *payload_of(t)) for at, some in common.slices(batch.column(1), 256) for i, t in zip(ids[at:], some)]
            for part in portions(rows, lambda r: len(r[2])):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in part], pa.int64()), "n_bytes": pa.array([r[1] for r in part], pa.int64()), "media": pa.array(encode([r[2] for r in part]), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of ``media(doc_id, media)``: one row for each shot, times in seconds."""

    def run(batches):
        for batch in batches:
            rows = []
            for part in portions(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), lambda r: len(r[1] or b"")):
                part = [r for r in part if r[1]]
                for (doc, _), counted in zip(part, histograms_of(*decode([r[1] for r in part])) if part else []):
                    rows += [(doc, n, a, b, a / FPS, b / FPS) for n, (a, b) in enumerate(shots(counted))]
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame long, end_frame long, start_s double, end_s double")


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text, reads it back and describes both: one row per document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in common.slices(batch.column(1), 1024):
                done = at
                for part in portions([payload_of(t) for t in texts], lambda p: len(p[1])):
                    media = encode([p[1] for p in part])
                    samples, heights = decode(media)
                    rows, line = [], 0
                    for (n_bytes, _), stored, own, counted in zip(part, media, heights, histograms_of(samples, heights)):
                        back = samples[line : line + sum(own)].tobytes()
                        line += sum(own)
                        cut = "|".join(f"{a / FPS:.2f}-{b / FPS:.2f}" for a, b in shots(counted))
                        rows.append((ids[done], n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"frames={len(own)};clips={cut}"))
                        done += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in FIELDS))


FIELDS = [("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
