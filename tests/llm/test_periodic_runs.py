import hashlib
import random
import re
import zlib

import pytest
from tests.llm.test_names import NAMES, frame

from tidewatch.llm import periodic_runs as pr


def plain(words, exponent, least):
    """(start, length, period) of all runs, by comparing at every distance."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = p
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                found.setdefault((i - p, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


def made_up(rng, most):
    words = []
    while len(words) < rng.randint(0, most):
        words += [rng.choice([b"a", b"b", b"c"][: rng.choice([1, 2, 3])]) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
    return words


@pytest.mark.parametrize("chunk", [1, 3, 7, 50, 1 << 16])
def test_runs_are_the_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(pr, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(120):
        lists = [made_up(rng, 110) for _ in range(rng.randint(1, 5))]
        exponent, least = rng.choice([2, 3, 4]), rng.choice([1, 6])
        got = pr.runs_of(lists, exponent, least, pr.Numbers())
        assert got == [plain(x, exponent, least) for x in lists]
        assert [pr.collapse(x, r) for x, r in zip(lists, got, strict=True)] == [collapsed(x, r) for x, r in zip(lists, got, strict=True)]


def test_blocks_of_equal_hash_are_compared(monkeypatch):
    """With a hash that tells nothing apart the result is the same."""
    import numpy as np

    monkeypatch.setattr(pr, "mix", lambda x: np.zeros_like(x))
    rng = random.Random(9)
    for _ in range(40):
        words = made_up(rng, 60)
        assert pr.runs_of([words], 4, 6, pr.Numbers()) == [plain(words, 4, 6)]


def test_long_texts():
    assert pr.runs_of([[b"a"] * 300_000], 4, 6, pr.Numbers()) == [[(0, 300_000, 1)]]
    words = [str(i).encode() for i in range(30_000)]
    assert pr.runs_of([words * 4 + words[:7]], 4, 6, pr.Numbers()) == [[(0, 120_007, 30_000)]]
    many = ([b"a"] * 6 + [b"x"] + [b"a"] * 6 + [b"y"] + [b"z"]) * 3
    assert pr.runs_of([many], 2, 6, pr.Numbers()) == [plain(many, 2, 6)]


def rows_of_query(rows):
    out = []
    for key, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n = len(words)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain(words, 4, 6)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(collapsed(words, runs))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_is_the_brute_force_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = pr.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted([tuple(r) for r in got.collect()], key=repr)
    short = {k for k, t in rows if len((t or "").split()) < 3000}
    assert [r for r in got if r[0] in short] == rows_of_query([x for x in rows if x[0] in short])
    assert any(r[1] for r in got) and len(got) == len(rows)


def test_query_of_hard_rows(spark, tmp_path):
    """Null, empty and blank texts, null and repeated ids, other white space, ties of the strongest run."""
    rows = [(k, t) for k in range(40) for t in ("go " * 9, "a b " * 5 + "x " + "c d " * 5)] + [(None, "go " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "é\x85é\xa0é " * 8), (5, "x\x0by\x0cz\r" * 6), (5, "x\x0by\x0cz\r" * 6), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted([tuple(r) for r in pr.op12_periodic_runs(spark, str(tmp_path)).collect()], key=repr) == rows_of_query(rows)


def test_empty_tables_and_own_columns(spark):
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "go " * 9), (2, None), (None, "go " * 9)]
    bare, full = (pr.periodic_runs(frame(spark, rows, "doc_id long, text string", x)) for x in ([], NAMES))
    columns = [c for c in bare.columns if c not in NAMES]
    assert sorted(repr([r[c] for c in columns]) for r in full.collect()) == sorted(repr([r[c] for c in columns]) for r in bare.collect())
    with pytest.raises(ValueError, match="exponent"):
        pr.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), exponent=1)
