import numpy as np
import pytest

from tidewatch.llm import embedding_dups


def brute(rows, d, cosine=0.95):
    ok = [(k, np.array(v, float)) for k, v in rows if k is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = np.array([v / np.sqrt((v * v).sum()) for _, v in ok])
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    root = list(range(len(ok)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(link)):
        a, b = find(i), find(j)
        if ok[a][0] > ok[b][0]:
            a, b = b, a
        root[b] = a
    got = {k: (0, k) for k, _ in rows}
    got |= {k: (int(link[i].sum()), ok[find(i)][0]) for i, (k, _) in enumerate(ok)}
    return got


@pytest.mark.parametrize("sparse", [0, 4])
def test_links_are_those_of_all_pairs(spark, monkeypatch, sparse):
    monkeypatch.setattr(embedding_dups, "BLOCK_STORED", 50)
    monkeypatch.setattr(embedding_dups, "BLOCK_QUERIES", 70)
    monkeypatch.setattr(embedding_dups, "SPARSE", sparse)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 24))
    for i in range(100, 400):  # groups of copies near the threshold
        x[i] = x[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.33])
    x[500:560] = x[0]
    x[560] = 3 * x[0]
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, []), (2005, [1.0] * 3), (2006, [float("inf")] + [1.0] * 23), (None, x[0].tolist())]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_vectors(frame, certainty=1e9).collect()}
    want = brute(rows, 24)
    assert got == want
    near = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_vectors(frame).collect()}
    links = sum(n for n, _ in want.values())
    recall = sum(n for n, _ in near.values()) / links
    assert links > 1000 and 0.98 <= recall <= 1, recall
    assert embedding_dups.near_vectors(frame.limit(0)).count() == 0
    assert [(r.n_links, r.component_id) for r in embedding_dups.near_vectors(frame.where("vec_id = 2000")).collect()] == [(0, 2000)]


def test_each_length_is_linked_on_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0]), (4, [5.0]), (5, [-1.0]), (6, [1.0] * 7), *((10 + i, rng.normal(size=2).tolist()) for i in range(40))]
    rows += [(60 + i, (np.array([1.0, 2.0, 3.0, 4.0, 5.0]) + rng.normal(size=5) * 0.1).tolist()) for i in range(30)]
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        own = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
        want = {}
        for d in (1, 2, 3, 5, 7):
            want |= {k: v for k, v in brute([r for r in own if len(r[1]) == d], d).items()}
        assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_vectors(frame, certainty=1e9).collect()} == want
        assert want[2] == (1, 1) and want[4] == (1, 3) and want[6] == (0, 6)
