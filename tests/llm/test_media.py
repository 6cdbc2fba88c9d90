"""op4: exact round trips and shot detection."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from pagegraph.llm import media


def test_round_trip_of_any_bytes():
    payloads = [os.urandom(64 * n) for n in (1, 2, 31, 32, 33, 65, 200)] + [bytes(64), b"\xff" * 640, b"\0\xff" * 3200]
    stored = media.encode(payloads)
    samples, heights = media.decode(stored)
    assert samples.tobytes() == b"".join(payloads)
    assert [sum(h) * 64 for h in heights] == [len(p) for p in payloads]
    one, _ = media.decode(stored[6:7])
    assert one.tobytes() == payloads[6]


def test_container_is_walked_by_its_index():
    stored = media.encode([bytes(range(256)) * 40])[0]
    frames = media.frames_of(stored)
    assert len(frames) == 5 and all(bytes(f[:2]) == b"\xff\xd8" and bytes(f[-2:]) == b"\xff\xd9" for f in frames)
    for broken in (b"", b"RIFF....WAVE", stored[:40], stored.replace(b"idx1", b"idxx")):
        with pytest.raises(ValueError):
            media.frames_of(broken)


def test_shots_follow_the_histograms():
    dark, light = np.eye(16)[2] * 100, np.eye(16)[13] * 100
    assert media.shots(np.array([dark, dark, light, light, light, dark])) == [(0, 2), (2, 5), (5, 6)]
    assert media.shots(np.array([dark])) == [(0, 1)]


def test_digests(spark, sf_dir, nasty, nothing, docs):
    for frame, got in ((nasty, media.digests(nasty)), (docs, media.op4_avi_mjpeg(spark, sf_dir))):
        want, by_text = [], {}
        for r in frame.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            padded = raw + bytes(-len(raw) % 64 if raw else 64)
            want.append((r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
        rows = got.collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
        for r in rows:  # equal texts, equal values
            assert by_text.setdefault((r.n_bytes, r.payload_sha256), tuple(r)[5:]) == tuple(r)[5:]
    assert media.digests(nothing).count() == 0


def test_clip_rows(nasty):
    stored = media.to_media(nasty)
    rows = media.clips(stored).orderBy("doc_id", "clip").collect()
    frames = {r.doc_id: len(media.frames_of(r.media)) for r in stored.where("doc_id not in (7, 9)").collect()}
    for doc, n in frames.items():
        own = [r for r in rows if r.doc_id == doc]
        if doc is not None:
            assert own[0].first_frame == 0 and own[-1].end_frame == n and own[-1].end_s == n / media.FPS
            assert all(a.end_frame == b.first_frame for a, b in zip(own, own[1:]))
