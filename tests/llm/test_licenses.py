import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewatch.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.lists(st.sampled_from("abcdefghij"), max_size=30), st.lists(st.sampled_from("abcdefghij"), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)
    if a == b:
        assert len(pairs) == len(a)


@given(st.lists(st.integers(0, 50), unique=True, max_size=40))
def test_patience_finds_a_longest_rise(order):
    pairs = list(enumerate(order))
    assert len(licenses.increasing(pairs)) == lcs(order, sorted(order))


def test_templates_are_found_in_noise(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(n))
    rows, want = [(0, None), (1, ""), (2, noise(20_000))], set()
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        if name.endswith("statement") or name == "Reserved":
            body = text
        else:
            body = " ".join(w for w in text.split() if rng.random() > 0.05)
        rows.append((10 + i, f"{noise(300)}\n{body.upper()}\n{noise(200)}"))
        want.add((10 + i, name))
    rows.append((10, rows[3][1]))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = licenses.scan_licenses(docs).collect()
    assert want <= {(r.doc_id, r.license) for r in got}
    assert all(0.8 <= r.coverage <= 1 and r.first_word >= 295 for r in got)
    assert not [r for r in got if r.doc_id < 3]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.op6_license_scan(spark, "/root/testdata/sf0.01").collect()}
    lines = {"Released under the MIT License.": "MIT statement", "Licensed under CC BY-NC 4.0.": "CC-BY-NC statement", "All rights reserved.": "Reserved"}
    for r in docs.collect():
        for line, name in lines.items():
            if line in r.text.split("\n"):
                assert (r.doc_id, name) in got


def english(rng, n):
    common = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old between both life being under three never know same last another while us might great go come since against right came take used himself few house use place during without again home around small however found thought went say part once general high upon school every"
    return " ".join(rng.choice(common.split()) for _ in range(n))


def test_two_copies_hide_nothing():
    rng, scanner = random.Random(8), licenses.Scanner()
    assert [f[0] for f in scanner.scan("a b c d All rights reserved e All rights reserved f g h i")] == ["Reserved"]
    for name, text in licenses.TEMPLATES.items():
        size = len(licenses.words(text))
        for between in (0, 1, size // 2, size, 2 * size, 5 * size):
            first = {f[0]: f for f in scanner.scan(f"{english(rng, 300)}\n{text}\n{english(rng, between)}\n{text}\n{english(rng, 300)}")}
            assert first[name][1] == 1 and first[name][3] >= 300 and first[name][4] - first[name][3] == size, (name, between, first)


def test_worn_copies_in_prose_are_found():
    rng, scanner = random.Random(9), licenses.Scanner()
    for name in ("MIT", "ISC", "Apache-2.0"):
        worn = lambda: " ".join(w for w in licenses.TEMPLATES[name].split() if rng.random() > 0.08)  # noqa: B023, E731
        for between in (0, 40, 400):
            assert name in {f[0] for f in scanner.scan(f"{english(rng, 500)} {worn()} {english(rng, between)} {worn()} {english(rng, 500)}")}


def test_licenses_are_told_apart():
    rng, scanner = random.Random(10), licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        assert [f[0] for f in scanner.scan(f"{english(rng, 100)} {text} {english(rng, 100)}")] == [name]
    assert [f[0] for f in scanner.scan(licenses.TEMPLATES["LGPL-2.1"].replace("program", "library"))] == ["LGPL-2.1"]
    assert scanner.scan("Released under the Frobnicate License.") == []
    assert scanner.scan("Licensed under CC BY-XX 4.0.") == []
    assert scanner.scan(licenses.TEMPLATES["GPL-3.0"].replace("version 3", "version 1")) == []


def test_given_documents_have_no_other_rows(spark):
    lines = {"Released under the MIT License.": "MIT statement", "Licensed under CC BY-NC 4.0.": "CC-BY-NC statement", "All rights reserved.": "Reserved", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 statement", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 statement"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, name) for r in docs.collect() for line, name in lines.items() if line in r.text)
    assert sorted((r.doc_id, r.license) for r in licenses.op6_license_scan(spark, "/root/testdata/sf0.01").collect()) == want


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 12, 20])
def test_templates_with_foreign_words_after_each_word(k):
    rng, scanner = random.Random(k), licenses.Scanner()
    for name in ("MIT", "ISC", "BSD-3-Clause"):
        template = licenses.words(licenses.TEMPLATES[name])
        text = " ".join(x for w in template for x in (w, *(f"q{rng.randint(0, 10**6)}" for _ in range(k))))
        head = " ".join(f"z{i}" for i in range(300))
        got = {f[0]: f for f in scanner.scan(f"{head} {text} {head}")}
        assert set(got) == {name}
        _, share, matched, first, end = got[name]
        assert share == matched / len(template) > 0.95 and 300 <= first < end <= 300 + len(template) * (k + 1)


def test_words_in_another_order_are_no_template():
    rng, scanner = random.Random(2), licenses.Scanner()
    for name in ("MIT", "ISC", "BSD-3-Clause"):
        mixed = licenses.words(licenses.TEMPLATES[name])
        rng.shuffle(mixed)
        assert name not in {f[0] for f in scanner.scan(" ".join(mixed))}


def test_reach_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in "ab")
        n, place = licenses.lcs_reach(a, b)
        assert n == lcs(a, b) == lcs(a[:place], b) and (not place or lcs(a[: place - 1], b) < n)
