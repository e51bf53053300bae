import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidewatch.llm import decontaminate, line_dedup

SF = "/root/testdata/sf0.01"


def brute_lines(rows, least):
    """Every run of consecutive lines against every earlier one, by its words."""
    docs = sorted({r for r in rows if r[0] is not None and r[1]})
    runs, gone = {}, {}
    lines = {}
    for key, text in docs:
        own = [(i, x) for i, x in enumerate(text.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        lines[key, text] = own
        for a in range(len(own)):
            words = 0
            for b in range(a, min(len(own), a + 60)):
                words += len(re.findall(r"[^\x20\x09-\x0D]+", own[b][1]))
                if words >= least:
                    runs.setdefault(tuple(x for _, x in own[a : b + 1]), []).append((key, text, a, b))
    for places in runs.values():
        first = min(places, key=lambda p: (p[0], p[2]))
        for key, text, a, b in places:
            if (key, a) > (first[0], first[2]):
                own = lines[key, text]
                gone.setdefault((key, text), set()).update(range(own[a][0], own[b][0] + 1))
    return [(k, t if not gone.get((k, t)) else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t]), len(gone.get((k, t), ()))) for k, t in rows]


@pytest.mark.parametrize("phrases", [64, 3, 0])
def test_deleted_lines_are_those_of_all_runs(spark, monkeypatch, phrases):
    monkeypatch.setattr(line_dedup, "PHRASES", phrases)
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.choice([1, 1, 2, 3, 6]))) for _ in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(70, None), (71, ""), (None, "\n".join(pool)), (5, None), (80, "x y z\n" * 30)]
    rows += [rows[3], (90, rows[4][1])]
    for least in (4, 7):
        docs = spark.createDataFrame([(*r, 0, 9, "g", 1) for r in rows], "doc_id long, text string, lines_removed int, id int, gone string, mark int")
        got = line_dedup.dedup_lines(docs, least=least)
        assert got.columns == ["doc_id", "text", "id", "gone", "mark", "lines_removed"]
        assert sorted(map(repr, ((r.doc_id, r.text, r.lines_removed) for r in got.collect()))) == sorted(map(repr, brute_lines(rows, least)))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup_lines(docs).collect()}
    want = {k: (t, n) for k, t, n in brute_lines([tuple(r) for r in docs.collect()], line_dedup.WORDS)}
    assert got == want and any(n for _, n in want.values())


def test_matches_are_extended_both_ways(monkeypatch):
    line = lambda *x: np.array(x, "<u8").tobytes()
    words = lambda n: np.full(n, 20, "<u4").tobytes()
    group = {"place_id": [1, 2, 3], "place_mark": [0, 0, 0], "place_at": [3, 5, 1], "before": [2, 2, 1], "lines": [line(1, 2, 3, 4, 5), line(9, 2, 3, 4, 8), line(2, 3, 7)], "words": [words(5), words(5), words(3)]}
    got = lambda: line_dedup.matches_of(group, 50)
    assert got() == [(2, 0, 5, 1, 1)]
    monkeypatch.setattr(line_dedup, "extended", lambda *_: (0, 0))
    assert got() == []


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    data = np.frombuffer(("one two\n\n three\n" + "x" * 90 + "\na b c\n" * 9 + "end").encode(), np.uint8)
    whole = line_dedup.lines_of(data, np.array([0, len(data)]))
    monkeypatch.setattr(line_dedup, "CHUNK", 30)
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, line_dedup.lines_of(data, np.array([0, len(data)])), strict=True))


def test_the_mask_misses_no_window():
    n, k = decontaminate.WINDOW, decontaminate.DIFFERENCES
    for bad in combinations(range(n), k):
        assert any(all(i + p not in bad for p in m) for m in decontaminate.MASKS for i in range(n - m[-1]))


def test_overlaps_tolerate_substitutions(spark):
    item = [f"w{i}" for i in range(20)]
    hit, short = list(item), [f"s{i}" for i in range(9)]
    hit[3], hit[9] = "x", "y"
    miss = ["x" if i % 4 == 3 else w for i, w in enumerate(item)]
    rows = [(1, "A b, " + " ".join(hit[:13]).upper() + " c"), (2, " ".join(miss)), (3, None), (4, ""), (5, " ".join(short)), (6, " ".join(short[:8])), (7, " ".join(item * 3)), (7, " ".join(item * 3)), (None, " ".join(item)), (8, "w0 " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, item_id int, tokens string")
    bench = spark.createDataFrame([(0, " ".join(item)), (0, " ".join(item)), (1, " ".join(short)), (2, None), (3, "w0 w1"), (None, "a")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 0): 11, (5, 1): 9, (7, 0): 13, **{(k, 3): 2 for k in (1, 2, 7)}}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "6", "8", "None"]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_short_items_and_parts(spark, monkeypatch):
    """Items of any length, against the SQL, with the seeds in one part, in several and shuffled."""
    import duckdb

    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 30)}"
    bench = [(n, " ".join(word() for _ in range(n))) for n in (*range(0, 16), 20, 30)]
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(0, 60))), *(bench[i % len(bench)][1].split()), *(word() for _ in range(9))])) for i in range(80)]
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", bench)):
        con.execute(f"create table {name} ({'doc_id' if name == 'documents' else 'item_id'} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    want = set(con.execute(decontaminate.OP8_SQL).fetchall())
    assert {1, 2, 3, 5, 7, 8, 12, 13, 30} <= {r[1] for r in want}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for rows, parts in ((2_000_000, 8), (60, 8), (60, 1)):
        monkeypatch.setattr(decontaminate, "SEED_ROWS", rows)
        monkeypatch.setattr(decontaminate, "MOST_PARTS", parts)
        assert {tuple(r) for r in decontaminate.overlaps(d, b).collect()} == want


def test_lines_that_a_polynomial_hash_confuses_are_kept(spark):
    """Orders of two words, and of two lines, that every polynomial hash modulo 2^64 takes for their complements."""
    bits = [bin(i).count("1") & 1 for i in range(512)]
    line = lambda flip: " ".join("ab"[x ^ flip] for x in bits)
    lines = lambda flip: "\n".join(("one two", "six ten")[x ^ flip] for x in bits)
    rows = [(1, f"first\n{line(0)}"), (2, f"second\n{line(1)}"), (3, f"third\n{lines(0)}"), (4, f"fourth\n{lines(1)}")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=600).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in got) == sorted(brute_lines(rows, line_dedup.WORDS))
