"""Near-duplicates, against all pairs."""

import numpy as np

from tidemark.operators import neardup


def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch):
    """Texts meet in the bands' tasks by their hashes alone, with pairs compared some at a time (F7)."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = rng.choice(words, 80).tolist()
        for _ in range(4):
            own = list(base)
            for at in rng.integers(0, 80, int(rng.integers(0, 4))):
                own[at] = str(rng.choice(words))
            texts.append(" ".join(own))
    texts += [texts[0], "", None, "  "]
    monkeypatch.setattr(neardup, "PAIRS", 50)
    got = neardup.clusters(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").toPandas().set_index("k")["cluster"]
    sets = [set(neardup.shingles(t).tolist()) if (t or "").strip() else None for t in texts]
    want = list(range(len(texts)))
    for _ in range(8):
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85:
                    want[i] = want[j] = min(want[i], want[j])
    assert got.loc[range(len(texts))].tolist() == want and len(got) == len(texts)
    assert len(set(want)) < len(texts) - 10


def test_pairs_of_a_crowd_come_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 7)
    pieces = list(neardup._runs_of_pairs(np.array([2, 9]), np.array([5, 3])))
    assert sorted((int(a), int(b)) for i, j in pieces for a, b in zip(i, j)) == sorted([(a, b) for a in range(2, 7) for b in range(a + 1, 7)] + [(9, 10), (9, 11), (10, 11)])
    assert max(len(i) for i, _ in pieces) <= 7
