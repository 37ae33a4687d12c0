import hashlib
import zlib

import numpy as np

from tallyweave.llm import media

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é" * 1000, "Same text", "Same text", "long " * 30_000]


def test_lossless_and_digests(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, "n", "z")], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.media_columns(docs).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert media.from_wav(rows[i].media) == payload
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(raw), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert rows[i].media_sha256 == hashlib.sha256(rows[i].media).hexdigest()
    assert rows[6].fingerprint == rows[7].fingerprint and rows[0].fingerprint == rows[1].fingerprint


def test_fingerprints_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (64, 640, 6400)]
    together = media.fingerprints(payloads)
    for p, got in zip(payloads, together, strict=True):
        assert np.array_equal(media.fingerprints([p])[0], got) and (np.diff(got) >= 0).all()


def test_shared_passage_gives_shared_pairs():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 256, media.FRAME * 20, dtype=np.uint8).tobytes()
    a, b = media.fingerprints([passage + bytes(media.FRAME), bytes(media.FRAME * 3) + passage])
    pairs = lambda x: set((x & 0xFFFFFFFF).tolist())
    assert len(pairs(a) & pairs(b)) > 0.8 * len(pairs(a))


def test_passages_shifted_by_odd_bytes_share_pairs():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    pairs = lambda p: set((media.fingerprints([p])[0] & 0xFFFFFFFF).tolist())
    own = pairs(passage)
    for shift in (1, 13, 47, 97, 129, 333, 1001):
        moved = pairs(rng.integers(0, 256, shift, dtype=np.uint8).tobytes() + passage)
        assert len(own & moved) > 0.5 * len(own), shift
    assert len(own & pairs(rng.integers(0, 256, 5000, dtype=np.uint8).tobytes())) < 0.2 * len(own)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.query_feature(media.media_columns(docs)).collect() == []


def plain_fingerprint(payload):
    """The definition by loops: frames of the payload between silences, sums of sines, local maxima, pairs."""
    lead = media.FRAME - media.HOP
    n = -(-(len(payload) + lead) // media.HOP)
    samples = np.array([128] * lead + list(payload) + [128] * (n * media.HOP - len(payload)), dtype=float) - 128
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    waves = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    peaks = []
    for k in range(n):
        power = np.rint(np.abs(waves @ (samples[k * media.HOP : k * media.HOP + media.FRAME] * window)) * 16)
        tops = [b for b in range(2, len(power) - 1) if power[b] > 0 and power[b] >= power[b - 1] and power[b] > power[b + 1]]
        peaks.append(sorted(tops, key=lambda b: (-power[b], b))[: media.PEAKS])
    step = media.FRAME // media.HOP
    return sorted(k << 32 | a << 20 | b << 8 | gap for k in range(n) for gap in range(step, media.FAN * step + 1, step) if k + gap < n for a in peaks[k] for b in peaks[k + gap])


def test_fingerprints_equal_the_definition():
    rng = np.random.default_rng(5)
    payloads = [bytes(64), b"a".ljust(64, b"\0"), b"The quick brown fox jumps over the lazy dog and goes on.".ljust(64, b"\0"), rng.integers(0, 256, 1024, dtype=np.uint8).tobytes(), b"abc " * 160]
    for p, got in zip(payloads, media.fingerprints(payloads), strict=True):
        want = plain_fingerprint(p)
        # single precision may part two bins that are equal but for rounding
        assert len(set(want) ^ set(got.tolist())) <= 0.02 * len(want) and len(want) > 0


def test_short_texts_have_features_of_their_own():
    texts = ["", "a", "b", "hello", "hello!", "x" * 64, "y" * 200]
    prints = media.fingerprints([media.padded(t)[0] for t in texts])
    assert all(len(p) for p in prints) and len({p.tobytes() for p in prints}) >= len(texts) - 1
