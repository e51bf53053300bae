import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import bpe, token_counts
from tidewatch.llm.common import tokenizer_path

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
HARD = ["", None, " ", "a", "  a  b ", "Hello, World's 12 ÉÉ!!'<|startoftext|>X<|endoftext|>", "x" * 5000, "ab" * 3000 + " é" * 10, "日本語 テキスト ΑΣ ①ｆｕ İi", "\x1c \x85a\n\n\r\nb\tc", "don't we'll 'S", "<s>a</s>▁b <unk>", "é " * 3, "\0a", "😀😀 text", "ﬁ ǅ ß ẞ ı"]


@pytest.fixture(scope="module")
def words():
    return bpe.WordEncoder(WORD, long=24, leaf=5)


@pytest.fixture(scope="module", params=[3, 17, 2048])
def pieces(request):
    return bpe.WordEncoder(WORD, piece=request.param)


@pytest.fixture(scope="module")
def lengths():
    return token_counts.Lengths(token_counts.frequent_lengths(PIECE), PIECE)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("abtheing ", max_size=200), st.text("aé'sΣΑ<|>12 \n", max_size=80), st.sampled_from([x for x in HARD if x])))
def test_ids_are_the_librarys(words, text):
    ids = words.library.encode(text, add_special_tokens=False).ids
    assert list(memoryview(words.encode([text])[0]).cast("i") if text else []) == ids


TEXTS = st.one_of(st.text(max_size=300), st.text("ab the'sing.,\n", min_size=20, max_size=400), st.text("aé'sΣΑ<|>12 \n\x1c\x85", max_size=80), st.sampled_from([x for x in HARD if x]))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_join_to_the_librarys_ids(pieces, text):
    ids = pieces.library.encode(text, add_special_tokens=False).ids
    assert list(memoryview(pieces.encode([text])[0]).cast("i") if text else []) == ids


def test_the_joins_carry_the_text(monkeypatch):
    """Without re-encoding around the joins, words that a cut falls into come out wrong."""
    small, texts = bpe.WordEncoder(WORD, piece=20), ["these are the words of a text, and they're cut anywhere " * 20]
    want = [small.library.encode(t, add_special_tokens=False).ids for t in texts]
    got = lambda: [list(memoryview(x).cast("i")) for x in small.encode(texts)]
    assert got() == want
    monkeypatch.setattr(bpe.TextTree, "join", lambda self, text, start, cut, end, left, right: [*left, *right])
    assert got() != want


def test_given_documents_are_the_librarys(spark):
    """Every document of the given table, by the tokenizers library and by sentencepiece."""
    sf = "/root/testdata/sf0.01"
    library, sp = bpe.WordEncoder(WORD).library, token_counts._processor(PIECE)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.op1_bpe(spark, sf).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    for r in token_counts.op5_token_counts(spark, sf).collect():
        assert r.n_tokens == len(sp.encode(text[r.doc_id]))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="lower-casing"):
        bpe.known(tokenizer_path("byte_bpe_50k.json"))


def test_the_cache_is_bounded_by_characters():
    small = token_counts.Lengths({" the": 1}, PIECE, most=50)
    for text in ("the quick brown fox " * 3, "x" * 500, "a b c d e f g h " * 9):
        n = sum(map(small.__getitem__, token_counts.PRE_TOKEN.findall(" " + text)))
        assert n == len(small.sp.encode(text)) and sum(map(len, small)) < 150


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("abthe ing▁\n\t", max_size=200), st.sampled_from([x for x in HARD if x])))
def test_lengths_are_the_librarys(lengths, text):
    n = sum(map(lengths.__getitem__, token_counts.PRE_TOKEN.findall(" " + text))) if text else 0
    assert n == len(lengths.sp.encode(text))


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(HARD)] + [(None, "a", "x"), (1, None, None)], "doc_id long, text string, token_ids string")
    got = bpe.digests(bpe.decode(bpe.encode(docs))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, bpe.digests(bpe.round_trip(docs)).collect()))
    library = bpe.WordEncoder(WORD).library
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1)}
    for i, t in enumerate(HARD):
        if i == 1:
            continue
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(got) == len(HARD) + 2
    counts = token_counts.count_tokens(docs).collect()
    sp = token_counts._processor(PIECE)
    assert all(r.n_tokens == len(sp.encode(r.text or "")) for r in counts)
    empty = docs.limit(0)
    assert bpe.decode(bpe.encode(empty)).count() == 0 and token_counts.count_tokens(empty).count() == 0


def test_a_full_cache_changes_nothing():
    small, texts = bpe.WordEncoder(WORD, most=3), ["the cat", "a dog and the cat", "one two three four five", "the cat<|endoftext|>"]
    for t in texts * 2:
        assert list(memoryview(small.encode([t])[0]).cast("i")) == small.library.encode(t, add_special_tokens=False).ids


def test_given_documents_come_through_joins_of_ids(spark, monkeypatch):
    """Documents of more than one piece are joined as ids; without encoding ids again around the joins they come out wrong."""
    encoder, joins = bpe.WordEncoder(WORD), []
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and len(r.text) > bpe.PIECE]
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    got = lambda: [list(memoryview(x).cast("i")) for x in encoder.encode(texts)]
    join = bpe.TextTree.join

    def counted(self, text, start, cut, end, left, right):
        joins.append(all(isinstance(i, int) for i in (*left[:3], *right[:3])))
        return join(self, text, start, cut, end, left, right)

    monkeypatch.setattr(bpe.TextTree, "join", counted)
    assert got() == want and len(joins) >= len(texts) > 100 and all(joins)
    assert any(len(t) > bpe.MANY * bpe.PIECE for t in texts)
    monkeypatch.setattr(bpe.TextTree, "join", lambda self, text, start, cut, end, left, right: [*left, *right])
    assert got() != want


def test_the_frequent_table_is_counted(spark):
    """The commonest pre-tokens with the library's lengths; they serve most look-ups of the given table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = token_counts.counted_lengths(docs, "text", PIECE)
    texts = [" " + r.text for r in docs.collect() if r.text]
    pieces = [p for t in texts for p in token_counts.PRE_TOKEN.findall(t)]
    assert len(found) <= token_counts.FREQUENT and sum(p in found for p in pieces) > 0.8 * len(pieces)
    sp = token_counts._processor(PIECE)
    assert all(n == len(sp.encode("\n" + w)) - 2 for w, n in list(found.items())[::50])
    assert token_counts.counted_lengths(docs.limit(0), "text", PIECE) == {} and len(token_counts.counted_lengths(docs, "text", PIECE, rows=50, most=10)) == 10
