import hashlib
import zlib

from revaudit.llm import media

from .fixtures import empty, frame, rows


def test_table(spark):
    out = media.media_columns(frame(spark)).collect()
    assert len(out) == len(rows())
    seen = {}
    for r in out:
        raw, _ = media.from_wav(bytes(r.media))
        assert len(raw) % 64 == 0 and len(raw) >= 64 and hashlib.sha256(raw).hexdigest() == r.payload_sha256 and zlib.crc32(raw[-64:]) == r.tail_crc32
        assert len(r.times) == len(r.codes) == r.n_pairs and r.times == sorted(r.times) and hashlib.sha256(bytes(r.media)).hexdigest() == r.media_sha256
        assert seen.setdefault(r.payload_sha256, r.feature) == r.feature
    texts = sorted(hashlib.sha256(media.payload((r[1] or "").encode())).hexdigest() for r in rows())
    assert sorted(r.payload_sha256 for r in out) == texts
    assert media.media_columns(empty(spark)).count() == 0


def test_padding():
    assert [len(media.payload(b"a" * n)) for n in (0, 1, 63, 64, 65)] == [64, 64, 64, 64, 128]


def test_fingerprint_of_two_tones():
    import numpy as np

    t = np.arange(8000)
    wave = lambda f: (128 + 60 * np.sin(2 * np.pi * f * t / 8000)).astype(np.uint8).tobytes()
    (_, a), (_, b) = media.fingerprint(wave(500)), media.fingerprint(wave(1500))
    assert len(a) and len(b) and {16} <= set((a >> 20).tolist()) <= {15, 16, 17} and {48} <= set((b >> 20).tolist()) <= {47, 48, 49}
    assert media.feature(*media.fingerprint(wave(500))) == media.feature(*media.fingerprint(wave(500)))


def brute(samples: bytes, s=media.Spectrum()):
    """[(time, code)] by sums over samples, frame by frame and band by band."""
    import cmath
    import math

    x = list(samples)
    frames = max(1, math.ceil((len(x) - s.frame) / s.hop) + 1)
    x += [128] * ((frames - 1) * s.hop + s.frame - len(x))
    peaks = []
    for k in range(frames):
        part = [v - 128 for v in x[k * s.hop : k * s.hop + s.frame]]
        mean = sum(part) / s.frame
        part = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / s.frame)) for i, v in enumerate(part)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * b * i / s.frame) for i, v in enumerate(part))) for b in range(s.frame // 2 + 1)]
        level = s.factor * sum(power[1:]) / (len(power) - 1)
        ends = [*s.edges[1:], len(power)]
        best = [max(range(a, b), key=lambda i: (power[i], -i)) for a, b in zip(s.edges, ends)]
        peaks.append([i if power[i] >= max(level, 1e-6) else 0 for i in best])
    out = []
    for t in range(frames):
        for apart in range(1, s.reach + 1):
            for k, a in enumerate(peaks[t]):
                for j in (k - 1, k, k + 1):
                    if t + apart < frames and 0 <= j < len(s.edges) and a and peaks[t + apart][j]:
                        out.append((t, a << 20 | peaks[t + apart][j] << 8 | apart))
    return sorted(out)


def test_fingerprint_against_brute_force():
    texts = [r[1] for r in rows() if r[1]][:8] + ["x", "ab" * 200, "the quick brown fox " * 40]
    for t in texts:
        samples = media.payload(t.encode())[:1500]
        assert list(zip(*(x.tolist() for x in media.fingerprint(samples)))) == brute(samples)
