"""Operators over whole songs against plain Python."""

import numpy as np
import pytest

from notegrain.plans.ops import apply
from notegrain.queries import OPS
from test_operators import NOTES


def notes_of(seed, n, songs=3, most=200_000):
    r = np.random.default_rng(seed)
    return [(int(r.integers(songs)), i, int(r.integers(most) // 30 * 30), int(r.integers(0, 3000)), int(r.integers(0, 6)), int(r.integers(48, 72)), 80) for i in range(n)]


def structure(notes, tpb=480, most=256):
    """The reference's windows; its thresholds compared without rounding errors."""
    span = float(max(t for t, _ in notes)) + 1
    win = tpb * 2.0
    n = int(min(span / win + 1, most))
    if n < 4:
        return n, 0, 0.0, 0
    if span / win > most:
        win, n = span / most, most
    x = np.zeros((n, 12))
    for t, p in notes:
        x[min(int(t / win), n - 1), p % 12] += 1
    dot, ss = x @ x.T, (x * x).sum(1)
    both = ss[:, None] * ss[None, :]
    gap = max(2, n // 16)
    far = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) > gap
    hits = int((far & (10000 * dot * dot > 9025 * both)).any(1).sum())
    new = np.array([4 * dot[i, i + 1] ** 2 < both[i, i + 1] or not both[i, i + 1] for i in range(n - 1)]).astype(int)
    return n, int(1 + (np.diff(new) == 1).sum()), round(hits / n, 6), int(10 * hits > 3 * n)


@pytest.mark.parametrize("seed, n, most", [(1, 900, 200_000), (2, 150, 60_000), (3, 400, 900_000), (4, 12, 2_500)])
def test_song_structure(spark, seed, n, most):
    rows = notes_of(seed, n, most=most)
    # a motif of two windows in two places far apart
    rows += [(0, 10_000 + i, 960 * w + t, 60, 0, p, 80) for i, (w, t, p) in enumerate((w, t, p) for w in (1, 40) for t, p in ((0, 60), (480, 64), (700, 67)))]
    got = {r.song: (r.n_windows, r.n_sections, pytest.approx(r.repetition_ratio, abs=1.1e-6), r.has_repetition) for r in apply(OPS["song_structure"], notes=spark.createDataFrame(rows, NOTES)).collect()}
    assert got == {s: structure([(r[2], r[5]) for r in rows if r[0] == s]) for s in {r[0] for r in rows}}


def test_beat_sounding(spark):
    rows = notes_of(5, 300, most=100_000) + [(0, 5_000, 240, 480 * 5, 0, 60, 80), (9, 5_001, 70 * 480, 0, 0, 50, 80), (9, 5_002, 0, 960, 9, 40, 80)]
    want = {}
    for song, _, start, dur, chan, pitch, _ in rows:
        if chan not in (9, 10):
            for beat in range(400):
                if start < beat * 480 + 480 and start + max(dur, 1) > beat * 480:
                    want.setdefault((song, beat), []).append(pitch)
    got = {(r.song, r.beat): (r.hi, r.lo, r.sounding) for r in apply(OPS["beat_sounding"], notes=spark.createDataFrame(rows, NOTES)).collect()}
    assert got == {k: (max(p), min(p), len(p)) for k, p in want.items()} and (9, 70) in got


def nearest(a, b, within):
    """Pairs (i, j) of the nearest onsets of two voices, seen from either."""
    out = set()
    for swap, (x, y) in enumerate(((a, b), (b, a))):
        for i, t in enumerate(x):
            j = min(range(len(y)), key=lambda j: (abs(y[j] - t), y[j]))
            if abs(y[j] - t) < within:
                out.add((j, i) if swap else (i, j))
    return out


def test_voice_motion_and_overlap(spark):
    rows = notes_of(6, 500, most=120_000) + [(7, 9_000 + i, t, 60, c, p, 80) for i, (t, c, p) in enumerate(((0, 0, 60), (30, 1, 50), (480, 0, 62), (700, 1, 48), (1200, 0, 45), (1230, 1, 48)))]
    voices = {}
    for song, _, start, _, chan, pitch, _ in rows:
        if chan not in (9, 10):
            v = voices.setdefault(song, {}).setdefault(chan, {})
            v[start] = max(pitch, v.get(start, 0))
    motion, over = {}, {}
    for song, by in voices.items():
        lines = [sorted(by[c].items()) for c in sorted(by)]
        for i, a in enumerate(lines):
            for b in lines[i + 1 :]:
                sa, sb = ([(t, p - q) for (_, q), (t, p) in zip(v, v[1:])] for v in (a, b))
                for x, y in nearest([t for t, _ in sa], [t for t, _ in sb], 480):
                    d, e = sa[x][1], sb[y][1]
                    k = "oblique" if not d or not e else "contrary" if d * e < 0 else "parallel" if abs(abs(d) - abs(e)) <= 2 else "similar"
                    motion[song, k] = motion.get((song, k), 0) + 1
                hi, lo = (b, a) if a[0][1] < b[0][1] else (a, b)
                o = over.setdefault(song, [0, 0])
                for x, y in nearest([t for t, _ in hi], [t for t, _ in lo], 240):
                    o[0] += 1
                    o[1] += abs(hi[x][0] - lo[y][0]) < 120 and hi[x][1] < lo[y][1]
    df = spark.createDataFrame(rows, NOTES)
    assert {(r.song, r.motion): r.n for r in apply(OPS["voice_motion"], notes=df).collect()} == motion
    assert {r.song: [r.overlaps, r.crossings] for r in apply(OPS["voice_overlap"], notes=df).collect()} == over and over[7][1] == 1 and (7, "contrary") in motion
