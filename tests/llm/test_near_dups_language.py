import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidewatch.llm import language_id, near_dups

SF = "/root/testdata/sf0.01"


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    pairs = {p for v in at.values() if len(v) > 1 for p in combinations(v, 2)}
    for i, j in pairs:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for (k, _), s in zip(rows, sets)}


def hard_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (5, "one"), (6, "x" * 10_000), (7, "É é"), (8, "é é")]
    base = [word() for _ in range(150)]
    for i in range(40):  # copies of copies, near the threshold, each a few words away
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        rows.append((100 + i, " ".join(t)))
    chain = [word() for _ in range(120)]
    for i in range(30):  # a chain: neighbours are alike, ends are not
        chain = list(chain)
        chain[(4 * i) % 120] = word()
        rows.append((300 - i, " ".join(chain)))
    rows += [(400 + i, rows[20][1]) for i in range(20)]
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = hard_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, "one two", 2, None)], "doc_id long, text string, component_id int, id string")
    got = near_dups.near_duplicates(docs).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.op3_minhash_near_dups(spark, SF).collect()}
    assert got == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("pairs", [0, 1, 1000])
def test_small_blocks_lose_no_link(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    monkeypatch.setattr(near_dups, "SIGNATURE_BLOCK", 9)
    monkeypatch.setattr(near_dups, "PAIRS", pairs)
    rows = hard_rows()
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in brute(rows).items()}


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    for text in ("ab  cd\n" * 40 + "x" * 200 + " y", "x" * 300, "a " * 100):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = near_dups.word_hashes(data, np.array([0, len(data)]))
        with monkeypatch.context() as m:
            m.setattr(near_dups, "CHUNK", 50)
            pieces = near_dups.word_hashes(data, np.array([0, len(data)]))
        assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()


def test_bounds_never_drop_equal_signatures():
    least = near_dups.least_matches(85, 1e-6)
    assert len(least) == 7 and all(0 < m < (i + 1) * 18 for i, m in enumerate(least))


def test_language_held_out(spark):
    got = language_id.op2_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert held and len(got) == len(lang)
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right, "rejected", sum(r.rejected for r in got))
    assert right > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) < 0.01 * len(got)


def test_language_edges(spark):
    rows = [(1, "the and of the", "en", "x"), (2, "der die das und", "de", "y"), (3, None, "en", None), (4, "", None, None), (5, "123 !?", "en", None), (None, "the " * 50_000, None, None), (7, "ß", "de", "z"), (1, "the and of the", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id not in (3, 4, 5))
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("text", ["abc", "é", "a" * 1000])
def test_scores_do_not_depend_on_the_batch(text):
    model = language_id.fit(["the of and", "der die das", "le la les", "el los que"] * 10, ["en", "de", "fr", "es"] * 10)
    alone = model.logits(*language_id.packed([text.encode()]))
    among = model.logits(*language_id.packed([b"", b"x", text.encode(), b"yy"]))[2:3]
    assert abs(alone - among).max() < 1e-9


def test_words_that_a_polynomial_hash_confuses_are_apart(spark):
    """4,096 letters in an order that every polynomial hash modulo 2^64 takes for its complement."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    rows = [(k, "".join("ab"[x ^ k] for x in bits)) for k in (0, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1, 0), 1: (1, 1)}


def test_words_are_forgotten_and_found_again():
    small, large = near_dups.Words(most=20), near_dups.Words()
    words = [b"the", b"a" * 70, b"cat", b"sat", b"on", b"longer-word"] * 3
    assert [small[w] for w in words] == [large[w] for w in words] and small.held <= 20


def test_scores_are_those_of_a_plain_computation():
    """Every subword by itself: hashed, looked up, averaged, turned into probabilities."""
    import math

    import numpy as np

    model = language_id.fit(["the of and", "der die das", "le la les", "el los que"] * 10, ["en", "de", "fr", "es"] * 10)
    fold = lambda c: c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32
    for text in ("The cat", "a", "", "LOS niños 12", "der\ndie  das é"):
        raw, total, n = [fold(c) for c in text.encode()], np.zeros(4), 0
        for order in language_id.ORDERS:
            for at in range(len(raw) - order + 1):
                code = raw[at]
                for c in raw[at + 1 : at + order]:
                    code = (code * 0x01000193 + c) % 2**32
                total += model.scores[(code * 0x9E3779B1 + order - 1) % 2**32 >> 16]
                n += 1
        logits = (total / max(n, 1) + model.bias) / model.temperature
        p = [math.exp(x - max(logits)) for x in logits]
        best, score = model.predict(*language_id.packed([text.encode()]))
        assert best[0] == int(np.argmax(p)) and abs(score[0] - max(p) / sum(p)) < 1e-9


def test_the_sample_has_a_bounded_size(spark, monkeypatch):
    """Long texts are cut down to stretches of all of them before they leave their task."""
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda texts, languages: seen.append((texts, languages)))
    rows = [(i, ("the cat " if i % 2 else "der Hund ") * (50 * (i + 1)) + f"end{i}", "en" if i % 2 else "de") for i in range(30)]
    rows += [rows[3], (50, None, "en"), (51, "x y", None), (52, "12", "en"), (None, "la le", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language_id.train(docs)
    texts, languages = seen.pop()
    assert len(texts) == 31 and sorted(texts) == sorted({r[1] for r in rows if r[1] and r[2] and any(c.isalpha() for c in r[1])})
    language_id.train(docs, sample_bytes=40_000)
    cut, same = seen.pop()
    assert same == languages and 20_000 < sum(map(len, cut)) < 40_000 + 31 * language_id.STRETCH
    longest = max(range(31), key=lambda i: len(texts[i]))
    assert len(cut[longest]) < len(texts[longest]) and cut[longest].endswith(texts[longest][-5:]) and cut[longest][:5] == texts[longest][:5]
    language_id.train(docs, sample_rows=5)
    assert len(seen.pop()[0]) == 5
