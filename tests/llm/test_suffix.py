import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tidewatch.llm import suffix_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, length=50):
    first = {}
    for key, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if key is not None:
                first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if key is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < key:
                    gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def hard_rows():
    rng = random.Random(11)
    text = lambda n, alphabet="abcdefgh é": "".join(rng.choice(alphabet) for _ in range(n))
    base = [text(400) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 500), (5, "ab" * 200), (6, "xab" + "ab" * 60), (None, base[0])]
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(len(t))
            t[a : a + rng.randint(0, 2)] = rng.choice(["", "q", "zz"])
        a, b = sorted((rng.randrange(len(t)), rng.randrange(len(t))))
        rows.append((100 - i, "".join(t[a:b]) + text(rng.randint(0, 60)) + base[2][: rng.randint(0, 90)]))
    return rows


def shown(df):
    return sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())))


@pytest.mark.parametrize("phrases, filter_bits", [(50_000, 27), (2, 20)])
def test_removed_bytes_are_those_of_all_strings(spark, monkeypatch, phrases, filter_bits):
    monkeypatch.setattr(suffix_dedup, "GROUP_PHRASES", phrases)
    monkeypatch.setattr(suffix_dedup, "RUN_PHRASES", 40)
    monkeypatch.setattr(suffix_dedup, "BITS", filter_bits)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_MASK", 3)
    rows = hard_rows()
    docs = spark.createDataFrame([(*r, 1, b"x", 2, 3) for r in rows], "doc_id long, text string, n_bytes int, kept binary, doc int, spans int").repartition(5)
    assert shown(suffix_dedup.remove_repeats(docs)) == sorted(map(repr, brute(rows)))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {(k, n, r, s, hashlib.sha256(b).hexdigest()) for k, n, r, s, b in brute([tuple(x) for x in docs.collect()])}
    assert {tuple(r) for r in suffix_dedup.op10_suffix_dedup(spark, SF).collect()} == want


def test_merge_is_a_sort():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    runs = [sorted(strings[i::7]) for i in range(7)]

    def coded(run):
        for k, s in zip(suffix_dedup.prefixes(run).tolist(), run):
            yield k, s, ()

    got = list(suffix_dedup.merge([coded(r) for r in runs]))
    assert [s for _, s, _ in got] == sorted(strings)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert all(k == common(a[1], s) for a, (k, s, _) in zip(got, got[1:]))


def test_lengths_and_long_texts(spark, monkeypatch):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (21, 127):
        assert shown(suffix_dedup.remove_repeats(docs, length=length)) == sorted(map(repr, brute(rows, length)))
    with pytest.raises(ValueError, match="from 21 to 127"):
        suffix_dedup.remove_repeats(docs, length=300)
    data = np.frombuffer(rows[20][1].encode() * 9, np.uint8)
    strings = lambda p: {(f + i, h) for a, f, l, h in zip(*(x.tolist() for x in p[1:5])) for i in range(l - f + 1)}  # noqa: E731, E741
    whole = strings(suffix_dedup.phrases(data, np.array([0, len(data)])))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    assert strings(suffix_dedup.phrases(data, np.array([0, len(data)]))) == whole


def test_repeats_come_from_the_common_prefixes(monkeypatch):
    """Two phrases of one anchor: with the prefix that they share, then with a shorter one, which has to lose strings."""
    left = {(b"r" * 50 + b"x", 1): [1, 5, 0, 1, 2], (b"r" * 49 + b"sx", 1): [2, 9, 0, 1, 2]}
    for pairwise in (16, 1):
        monkeypatch.setattr(suffix_dedup, "PAIRWISE", pairwise)
        assert list(suffix_dedup.resolve(left, [0, 49], 50)) == [(2, 0, 0, 5)]
        assert list(suffix_dedup.resolve(left, [0, 30], 50)) == []


def test_both_ways_of_resolving_agree(monkeypatch):
    rng = random.Random(7)
    for _ in range(300):
        base, group = "".join(rng.choice("ab") for _ in range(40)), {}
        for n in range(rng.randint(2, 14)):
            before = rng.randint(0, 6)
            count = rng.randint(1, before + 1)
            right = (base[: 12 - before + count - 1 - (k := rng.choice([0, 0, 1, 3]))] + "".join(rng.choice("ab") for _ in range(k))).encode()
            group[right + "".join(rng.choice("aab") for _ in range(before)).encode(), before] = [n, rng.randint(0, 9), rng.randint(0, 1), before, count]
        group = dict(sorted(group.items()))
        keys = [s for s, _ in group]
        commons = [0] + [suffix_dedup.common(a, b) if a != b else len(a) for a, b in zip(keys, keys[1:])]
        got = []
        for pairwise in (100, 1):
            monkeypatch.setattr(suffix_dedup, "PAIRWISE", pairwise)
            doc = {v[0]: v[1] for v in group.values()}
            got.append({(c, x) for c, i, j, d in suffix_dedup.resolve(group, commons, 12) if d < doc[c] for x in range(i, j + 1)})
        assert got[0] == got[1]


def test_what_a_crowd_holds_grows_with_its_phrases():
    """Phrases of one anchor with 31 strings each: what is held stays far below a tuple for every string."""
    rows = [(k, k % 90, 30, 31, 50, random.Random(k).randbytes(30)) for k in range(4000)]
    tracemalloc.start()
    found = sum(1 for _ in suffix_dedup.crowd(rows, [0, *[60] * (len(rows) - 1)], 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 1000 * len(rows)


def test_records_of_a_run_are_read_some_at_a_time():
    strings = sorted(f"{k:06d}".encode() * 10 for k in range(20_000))
    run = suffix_dedup.pack(strings, np.array([(k, k, 0, 0, 1) for k in range(len(strings))], suffix_dedup.RECORD))
    tracemalloc.start()
    first = next(read := suffix_dedup.unpack(run))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000 and [first, *read] == [(k, s, (n, n, 0, 0, 1)) for n, (k, s) in enumerate(zip(suffix_dedup.prefixes(strings).tolist(), strings))]
