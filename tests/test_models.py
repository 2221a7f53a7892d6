"""The clip head, isotonic fits and fault isolation, against loops."""

import math
import random

import numpy as np
import pytest

from spanloom.plans import clip_head, models


def head(rng, d, hidden, classes):
    g = rng.normal
    return {"project": g(size=(d, hidden)), "project_bias": g(size=hidden), "attend": 4 * g(size=hidden), "attend_bias": g(), "classify": g(size=(hidden, classes)), "classify_bias": g(size=classes)}


def slow_probabilities(x, w):
    """One window's probabilities, frame by frame."""
    h = []
    for frame in x:
        z = [sum(frame[i] * w["project"][i][k] for i in range(len(frame))) + w["project_bias"][k] for k in range(len(w["project_bias"]))]
        h.append([v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in z])
    a = [sum(p * q for p, q in zip(row, w["attend"], strict=True)) + w["attend_bias"] for row in h]
    e = [math.exp(v - max(a)) for v in a]
    mean = [sum(s * row[k] for s, row in zip(e, h, strict=True)) / sum(e) for k in range(len(h[0]))]
    z = [sum(m * w["classify"][k][c] for k, m in enumerate(mean)) + w["classify_bias"][c] for c in range(len(w["classify_bias"]))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


@pytest.mark.parametrize(("width", "stride", "blocks"), [(6, 2, 64), (4, 1, 1), (5, 7, 2), (1, 1, 3)])
def test_clip_head(spark, tmp_path, monkeypatch, width, stride, blocks):
    monkeypatch.setattr(clip_head, "BLOCKS", blocks)
    rng = np.random.default_rng(width)
    clip_head.write_head(spark, head(rng, 5, 7, 4), str(tmp_path / "head"))
    w = clip_head.read_head(spark, str(tmp_path / "head"))
    clips = {v: rng.normal(size=(n, 5)) * (30 if v == 2 else 1) for v, n in enumerate((1, 3, 40, 23, width))}
    rows = [(v, i, x.tolist()) for v, xs in clips.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    found = {(r.video_id, r.st): r for r in clip_head.head_windows(spark.createDataFrame(rows, "video_id int, i bigint, emb array<double>").repartition(3), w, width, stride).collect()}
    want = {(v, st) for v, xs in clips.items() for st in {*range(0, max(0, len(xs) - width) + 1, stride), max(0, len(xs) - width)}}
    assert found.keys() == want
    for (v, st), r in found.items():
        assert r.en == min(len(clips[v]), st + width)
        assert np.allclose(r.probs, slow_probabilities(clips[v][st : r.en].tolist(), w), rtol=0, atol=1e-9)


def pooled_by_hand(pairs):
    """Isotonic means of truths by rising score, equal scores together."""
    blocks = []
    for score in sorted({s for s, _ in pairs}):
        ys = [y for s, y in pairs if s == score]
        blocks.append([sum(ys), len(ys), [score]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + s]
    return {s: y / n for y, n, scores in blocks for s in scores}


def test_isotonic_for_each_class(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice((s := round(rng.random(), 2), round(rng.random(), 6))), float(rng.random() < s)) for c in ["a", "b", "c", None] for _ in range(300)] + [("one", 0.5, 1.0), ("a", None, 1.0)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "cls string, p double, y double").repartition(parts)
        got = [(r.cls, r.p, r.calibrated) for r in models.isotonic_by_class(df, "cls", "p", "y").collect()]
        assert len(got) == len(rows)
        for c in {r[0] for r in rows}:
            want = pooled_by_hand([(p, y) for k, p, y in rows if k == c and p is not None])
            own = sorted((p, v) for k, p, v in got if k == c and p is not None)
            assert all(v == pytest.approx(want[p], abs=1e-12) for p, v in own) and all(a[1] <= b[1] + 1e-12 for a, b in zip(own, own[1:], strict=False))
        assert [v for _, p, v in got if p is None] == [None]


def test_faults_stay_with_their_rows(spark):
    frames = spark.createDataFrame([(k, [float(k), 1.0] if k % 4 else ([1.0] if k % 8 else None)) for k in range(40)], "i bigint, emb array<double>").repartition(3)

    def load():
        def model(x):
            if (x[:, 0] == 7).any():
                raise ValueError("seven")
            return np.column_stack([x[:, 0], x[:, 1] - x[:, 0]])

        return model

    seen = models.observed_faults("faults")
    found = {r.i: r for r in models.external_scorer(frames, load, faults=seen).collect()}
    bad = {k for k in range(40) if k % 4 == 0 or k == 7}
    assert {k for k, r in found.items() if r.error} == bad and len(found) == 40
    assert all(found[k].probs == [float(k), 1.0 - k] for k in set(range(40)) - bad)
    assert "seven" in found[7].error and found[0].probs is None
    assert seen.get == {"scored": 40 - len(bad), "failed": len(bad)}
    good, dead = models.split_faults(models.external_scorer(frames, load))
    assert good.count() == 40 - len(bad) and dead.count() == len(bad) and "error" not in good.columns
    assert models.external_scorer(frames.limit(0), load).isEmpty()


def test_gradient(spark):
    """Against differences of the loss, weight by weight."""
    rng = np.random.default_rng(5)
    w, x = head(rng, 4, 5, 3), rng.normal(size=(6, 4))
    loss, guess, slope = clip_head.clip_gradient(x, 2, 1.5, w)
    p = slow_probabilities(x.tolist(), w)
    assert loss == pytest.approx(-1.5 * math.log(p[2])) and guess == int(np.argmax(p))
    for name, g in slope.items():
        for at in np.ndindex(np.shape(w[name])):
            sides = []
            for d in (1e-6, -1e-6):
                moved = {k: np.array(v, float) for k, v in w.items()}
                moved[name][at] += d
                sides.append(clip_head.clip_gradient(x, 2, 1.5, moved)[0])
            assert np.asarray(g)[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_training(spark):
    """Losses equal a loop over all clips, at any partitioning, and fall; the head is the best epoch's."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(3, 4))
    data = [((centre[k % 3] + 0.3 * rng.normal(size=(rng.integers(1, 7), 4))).tolist(), k % 3, 1.0 + (k % 3)) for k in range(24)]
    start = clip_head.initial_head(4, 6, 3, 1)
    seen = []
    for parts in (1, 5):
        df = spark.createDataFrame(data, "embs array<array<double>>, label int, weight double").repartition(parts)
        best, history = clip_head.train_head(df, start, 6, rate=0.05)
        seen.append([loss for _, loss, _ in history])
    assert np.allclose(seen[0], seen[1], rtol=1e-9) and seen[0][-1] < 0.7 * seen[0][0]

    w, m, v, losses, right = {k: np.array(x, float) for k, x in start.items()}, {}, {}, [], []
    for t in range(1, 7):
        each = [clip_head.clip_gradient(np.array(x), y, c, w) for x, y, c in data]
        mass = sum(c for _, _, c in data)
        losses.append(sum(loss for loss, _, _ in each) / mass)
        right.append((np.mean([np.mean([g == k for (_, g, _), (_, y, _) in zip(each, data, strict=True) if y == k]) for k in range(3)]), w))
        for k in list(w):
            g = sum(s[k] for _, _, s in each) / mass
            m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.999 * v.get(k, 0) + 0.001 * g * g
            w = w | {k: w[k] - 0.05 * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + 0.01 * w[k])}
    assert np.allclose(seen[0], losses, rtol=1e-9)
    want = max(right, key=lambda r: r[0])[1]
    assert all(np.allclose(best[k], want[k], atol=1e-9) for k in want)
