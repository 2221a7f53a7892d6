import random

import numpy as np
import pytest

from spanloom.llm.best_paths import Lattice, best_paths, times


def brute(pieces, penalty, text):
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            score = pieces.get(text[i:j], (0, penalty if j == i + 1 else -np.inf))[1]
            best[j] = max(best[j], best[i] + score)
    return best[-1]


def vocabulary(rng):
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)} | {"a", "b"}
    return {w: (k + 1, -rng.random() * 10) for k, w in enumerate(sorted(words))}


@pytest.mark.parametrize("chunk, block", [(1, 2), (3, 4), (7, 64), (1000, 64)])
def test_best_paths(spark, chunk, block):
    rng = random.Random(chunk)
    pieces = vocabulary(rng)
    texts = ["".join(rng.choice("abcx") for _ in range(n)) for n in (1, 2, 30, 200)] + ["", None, "xxx", "aba"]
    data = [(k, t, k) for k, t in enumerate([*texts, texts[2]])]
    df = spark.createDataFrame(data, "doc_id bigint, text string, key bigint")
    lattice, by_id = Lattice(pieces, 0), {i: (w, s) for w, (i, s) in pieces.items()}
    found = best_paths(df, pieces, 0, chunk, block).select("row.doc_id", "row.text", "ids").collect()
    assert len(found) == len(data)
    for r in found:
        text, at, score = r.text or "", 0, 0.0
        for i in r.ids:
            word, s = by_id.get(i, (text[at : at + 1], lattice.penalty))
            assert text.startswith(word, at)
            at, score = at + len(word), score + s
        assert at == len(text) and score == pytest.approx(brute(pieces, lattice.penalty, text))
    assert best_paths(df.limit(0), pieces).isEmpty()


def test_products_are_associative_and_equal_the_whole():
    rng = random.Random(5)
    lattice = Lattice(vocabulary(rng), 0)
    text = "".join(rng.choice("abcx") for _ in range(60))
    cuts = [0, 11, 30, 60]
    a, b, c = (lattice.matrix(text[i : j + lattice.longest], j - i) for i, j in zip(cuts, cuts[1:], strict=False))
    whole = lattice.matrix(text, 60)
    assert np.allclose(times(times(a, b), c)[0, 0], whole[0, 0])
    assert np.allclose(times(times(a, b), c), times(a, times(b, c)))
