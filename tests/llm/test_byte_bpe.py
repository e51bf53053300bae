import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.test_names import NAMES, frame

from tidewatch.llm import byte_bpe as bb
from tidewatch.llm.common import tokenizer_path

RANKS, MULTI = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_multi_50k.tiktoken")
HARD = ["", None, " ", "a", "  a  b ", "don't we'll 'S '", "<|endoftext|>", "x" * 4000, "ab" * 3000 + " é" * 10, "日本語 テキスト ①", "\x1c \x85a\n\n\r\nb\tc \xa0", "ՠ ٠٣ ₿ ꟍ 𖹀 new letters", "😀😀 text", "\0a", "   \n  x", "1234567890" * 30]


def library(path=RANKS):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(f"own-{path}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module", params=[RANKS, MULTI])
def both(request):
    return bb.CorpusEncoder(request.param, most=3000), library(request.param)


def ids(x):
    return list(memoryview(x).cast("i")) if x else []


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("the ing'sab \n", max_size=120), st.sampled_from(HARD)), max_size=6))
def test_ids_are_the_librarys(both, texts):
    encoder, lib = both
    assert [ids(x) for x in encoder.encode(texts)] == [lib.encode_ordinary(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.lists(st.text("abc", min_size=1, max_size=50), min_size=1, max_size=12))
def test_any_rank_table_is_replayed_like_word_by_word(seed, words):
    """Also where merges make pairs of lower ranks than their own, which no trained table has."""
    import tiktoken

    rng = random.Random(seed)
    tokens = [bytes([i]) for i in range(256)]
    rng.shuffle(tokens)
    tokens += sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(40)}, key=lambda _: rng.random())
    ranks = {t: i for i, t in enumerate(tokens)}
    lib = tiktoken.Encoding("random", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
    assert [ids(x) for x in bb.Replay(ranks).ids([w.encode() for w in words])] == [lib.encode_ordinary(w) for w in words]


def test_a_replay_touches_only_pairs_that_merge(monkeypatch):
    """Merges over a corpus need as many look-ups as merges have neighbours, whatever the number of ranks."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    replay = bb.Replay(bb.read_ranks(RANKS))
    replay.ranks = Counted(replay.ranks)
    words = [b"thetheing", b"shouldered-ing", b"xyzzyx"] * 20
    out = replay.replay(words)
    merges = sum(len(w) - len(o) for w, o in zip(words, out, strict=True))
    assert merges and Counted.asked <= 2 * merges


def test_segments_join_to_the_whole(monkeypatch):
    lib = library()
    texts = ["these are  the words,\nof a text　and they're cut " * 30, "x" * 900, " " * 300 + "a " * 100, "ՠ ٠٣  b c " * 40]
    for size in (1, 7, 100):
        monkeypatch.setattr(bb, "SEGMENT", size)
        monkeypatch.setattr(bb, "LAID_OUT", size)
        assert [ids(x) for x in bb.CorpusEncoder(RANKS).encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_plain_characters_have_the_librarys_classes():
    """What the plain pattern takes for granted, and what the stand-ins say of every other character."""
    encoder, lib = bb.CorpusEncoder(RANKS), library()
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(4)
    for c in [*chars[: bb.PLAIN], *rng.sample(chars[bb.PLAIN :], 3000)]:
        text = f"a{c}a 1{c}1 !{c}! {c} {c}{c}\n"
        assert [i for x in encoder.encode([text]) for i in ids(x)] == lib.encode_ordinary(text)


def test_query_is_the_librarys_on_the_table(spark):
    sf, lib = "/root/testdata/sf0.01", library()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(k, len(i), sha(" ".join(map(str, i)).encode()), sha(lib.decode_bytes(i))) for k, t in rows for i in [lib.encode_ordinary(t or "")]]
    got = bb.op13_byte_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_rows_and_own_columns(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1, " "), (None, "a b"), (None, None)]
    lib = library()
    out = {}
    for extra in ([], [*NAMES, "token_ids", "decoded"]):
        got = bb.decode_bytes(bb.encode_bytes(frame(spark, rows, "doc_id long, text string", extra))).collect()
        out[bool(extra)] = sorted(repr((r.doc_id, r.text, r.token_ids, bytes(r.decoded))) for r in got)
    assert out[True] == out[False] == sorted(repr((k, t, lib.encode_ordinary(t or ""), (t or "").encode())) for k, t in rows)
    assert bb.encode_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decoding_leaves_out_what_is_no_id(spark):
    got = bb.decode_bytes(spark.createDataFrame([([64, None, -5, 10**6, 65],), ([],), (None,)], "token_ids array<int>")).collect()
    lib = library()
    assert sorted(bytes(r.decoded) for r in got) == sorted([lib.decode_bytes([64, 65]), b"", b""])
