import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.test_names import NAMES, frame

from tidewatch.llm import token_alignment as ta
from tidewatch.llm.common import tokenizer_path, written

BYTES, PIECE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
HARD = [None, "", " ", "a", "  two  spaces ", "<|endoftext|> and <s></s><unk>", "▁", "a▁b", "日本語のテキスト 😀😀 text", "x" * 3000, "= " * 40 + "=" * 200, "\x00\x1c\x85\xa0", "don't 'S we'll\n\n\r\n\tend", "ՠ ٠٣ ₿ ꟍ new letters", "é " * 9]


@pytest.fixture(scope="module")
def sides():
    return ta.byte_level(BYTES), ta.sentence_pieces(PIECE)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def tokens(libraries, text):
    """Ids and bytes of both sides, by the libraries."""
    a, b = libraries
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    shown = {ta.byte_sign(x): x for x in range(256)}
    bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    return ids_a, bytes_a, ids_b, bytes_b


def plain(libraries, text):
    """Groups by a set of common ends."""
    if not text:
        return None
    ids_a, bytes_a, ids_b, bytes_b = tokens(libraries, text)
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    both = sorted(set(ends_a) & set(ends_b))
    at = [0, *both]
    return [([i for i, e in zip(ids_a, ends_a, strict=True) if s < e <= t], [i for i, e in zip(ids_b, ends_b, strict=True) if s < e <= t]) for s, t in zip(at, both, strict=False)]


def brute(libraries, rows):
    groups = {n: plain(libraries, t) for n, (_, t) in enumerate(rows)}
    held = Counter()
    for g in groups.values():
        held.update({(a, b) for x, y in g or [] for a in x for b in y})
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for n, (key, _) in enumerate(rows):
        g = groups[n]
        links = [(a, b) for x, y in g or [] for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((key, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def scored(spark, rows, **k):
    aligned = written(ta.align_tokens(spark.createDataFrame(rows, "doc_id long, text string")))
    counts = written(ta.link_counts(aligned, ta.pair_base()))
    got = ta.score_links(aligned, counts, **k).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    return sorted([(*r[:-1], hashlib.sha256(r.groups.encode()).hexdigest() if r.n_groups else "") for r in got], key=repr)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("the ingab'sé▁\n<|>0", max_size=120), st.sampled_from([x for x in HARD if x])))
def test_ids_are_the_libraries(sides, libraries, text):
    if text:
        ids_a, bytes_a, ids_b, bytes_b = tokens(libraries, text)
        a, b = sides[0].ids([" " + text])[0], sides[1].ids([" " + text])[0]
        assert a is None or a.tolist() == ids_a
        assert (b is None) == (b"".join(bytes_b) != (" " + text).encode()) and (b is None or b.tolist() == ids_b)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_groups_of_any_ends(data):
    last = data.draw(st.integers(1, 120))
    a, b = (sorted(data.draw(st.sets(st.integers(1, last), max_size=120)) | {last}) for _ in "ab")
    cut_a, cut_b = ta.diagonal_groups(np.array(a), np.array(b))
    both = sorted(set(a) & set(b))
    assert [a[i - 1] for i in cut_a] == both and [b[j - 1] for j in cut_b] == both


def test_stretches_are_jumped(monkeypatch):
    """A million one-to-one tokens with two odd groups between take some dozens of comparisons, not a million."""
    a = list(range(1, 1_000_001))
    b = [x for x in a if x not in (500_000, 700_001)]
    cut_a, cut_b = ta.diagonal_groups(np.array(a), np.array(b))
    assert len(cut_a) == len(b) and [a[i - 1] for i in cut_a[::1000]] == b[::1000]


@pytest.mark.parametrize("hot", [2_000_000, 3, 60, 0])
def test_scores_are_the_brute_force(spark, libraries, hot):
    """The same whether pairs are looked up or joined; ties, repeated rows, null ids."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "tokenization", "  gaps", "naïve", "<|endoftext|>", "=====", "12,500"]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(HARD)] + [(3, rows[3][1]), (None, "the tokenization"), (None, None)]
    assert scored(spark, rows, hot_pairs=hot) == brute(libraries, rows)


def test_wide_groups_count_each_link(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300).astype("<i4"), rng.integers(0, 7, 200).astype("<i4")
    cut_a, cut_b = [10, 250, 300], [4, 150, 200]
    want = ta.link_keys(a, b, cut_a, cut_b, 7)
    monkeypatch.setattr(ta, "WIDE", 100)
    got = ta.link_keys(a, b, cut_a, cut_b, 7)
    assert got[2] == want[2] == int(want[1].sum()) and all((x == y).all() for x, y in zip(got[:2], want[:2], strict=True))


def test_query_is_the_brute_force_on_the_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = ta.op11_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(libraries, rows)


def test_empty_tables_and_own_columns(spark):
    assert ta.score_links(*(lambda x: (x, written(ta.link_counts(x, 32000))))(written(ta.align_tokens(spark.createDataFrame([], "doc_id long, text string"))))).count() == 0
    rows = [(1, "the tokens"), (2, None), (None, "the tokens")]

    def made(extra):
        x = written(ta.align_tokens(frame(spark, rows, "doc_id long, text string", extra)))
        return ta.score_links(x, written(ta.link_counts(x, ta.pair_base())), hot_pairs=2)

    extra = [*NAMES, "row", "rest_keys", "rest_times", "more_sum", "more_best", "n_best", "link_key", "times"]
    bare, full = made([]), made(extra)
    assert [c for c in full.columns if c not in extra or c == "n_best"] == bare.columns
    assert sorted(repr([r[c] for c in bare.columns]) for r in full.collect()) == sorted(repr([r[c] for c in bare.columns]) for r in bare.collect())


def test_words_are_met_once_for_both_sides(monkeypatch):
    """A word that is known is not encoded again on either side, nor are a text's words looked up a side at a time."""
    asked = []

    def side(name):
        def encode(words):
            asked.append((name, "".join(words)))
            return [list(w.encode()) for w in words]

        return ta.Side(ta.STRETCH.findall, encode, [bytes([i]) for i in range(256)])

    known = ta.Remembered([side("a"), side("b")])
    texts = [" one two\nthree two", " two", " one  gap"]
    for _ in range(2):
        for ids, n, lossy in known.laid(texts):
            assert bytes(ids.tolist()).decode() == "".join(texts) and n.tolist() == [len(t) for t in texts] and not lossy.any()
    assert asked == [(name, " one two\nthree  gap") for name in "ab"]


def test_groups_are_not_walked_one_by_one():
    """Ten thousand odd groups on ever new diagonals take some thousand lines of Python, not some for each."""
    rng = np.random.default_rng(2)
    ends = np.arange(1, 200_001)
    last = ends == len(ends)
    a, b = ends[(rng.random(len(ends)) > 0.03) | last], ends[(rng.random(len(ends)) > 0.03) | last]
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        cut_a, cut_b = ta.diagonal_groups(a, b)
    finally:
        sys.settrace(before)
    assert a[cut_a - 1].tolist() == b[cut_b - 1].tolist() == np.intersect1d(a, b).tolist()
    assert lines < 5000


@pytest.mark.parametrize("lane, reach, few", [(1, 0, 0), (2, 1, 3), (3, 32, 16)])
def test_lanes_give_the_groups_of_any_ends(monkeypatch, lane, reach, few):
    monkeypatch.setattr(ta, "LANE", lane)
    monkeypatch.setattr(ta, "REACH", reach)
    monkeypatch.setattr(ta, "FEW", few)
    rng = random.Random(lane)
    for _ in range(300):
        last = rng.randint(1, 150)
        a, b = (sorted({x for x in range(1, last) if rng.random() < rng.choice([0.1, 0.5, 0.9])} | {last}) for _ in "ab")
        cut_a, cut_b = ta.diagonal_groups(np.array(a), np.array(b))
        both = sorted(set(a) & set(b))
        assert [a[i - 1] for i in cut_a] == both and [b[j - 1] for j in cut_b] == both


def test_ids_are_the_libraries_beside_any_spaces(sides, libraries, monkeypatch):
    """Texts of all kinds of spaces, in one block and with little remembered."""
    monkeypatch.setattr(ta, "CACHE_SIZE", 300)
    rng = random.Random(8)
    signs = [" ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "\u180e", "\u2003", "\u200b", "\u3000", "▁", "the", "Word,", "don't", "12", "==", "ñ", "日本", "😀", "x" * 80]
    known = ta.Remembered(list(sides))
    for _ in range(20):
        texts = [" " + "".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(30)]
        (a, n_a, lossy_a), (b, n_b, lossy_b) = known.laid(texts)
        each = zip(texts, np.split(a, np.cumsum(n_a)[:-1]), lossy_a, np.split(b, np.cumsum(n_b)[:-1]), lossy_b, strict=True)
        for text, own_a, bad_a, own_b, bad_b in each:
            ids_a, bytes_a, ids_b, bytes_b = tokens(libraries, text[1:])
            assert bad_a == (b"".join(bytes_a) != text.encode()) and bad_b == (b"".join(bytes_b) != text.encode())
            assert (bad_a or own_a.tolist() == ids_a) and (bad_b or own_b.tolist() == ids_b)
