"""Byte-level BPE from a rank file, by merge replay over a corpus, and its decoding.

The distinct pre-tokens of a block of documents are laid end to end. An inverted index leads from each mergeable
token pair to all its places in these words. The merges are applied in the order of their ranks, each at all its
places at once; only the pairs on either side of a merged place change, and only these enter the index anew. So the
work is that of the merges that apply, whatever the number of ranks. What a block has learned is remembered for the
next ones in a bounded cache; a word that is remembered is not laid out again.

A replay over the whole table at once would have to bring the ids of every word back to its places, a shuffle
of all tokens; a block (1 MB of text) needs none, gives the same ids, and has a bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.blocks import block_columns, lists_of
from tidewatch.llm.common import map_batches, table, tokenizer_path

IDS = T.ArrayType(T.IntegerType())
CACHE_CHARS, LONG = 5_000_000, 64  # characters of all remembered pre-tokens, and of the longest that is remembered
SEGMENT = 1 << 20  # characters of a text that are cut into pre-tokens at a time
LAID_OUT, BLOCK = 1 << 18, 1 << 20  # bytes of words in one replay, but for a longer word, and of texts in a block, but for a longer text

#: Up to here classes of characters have been the same for long; beyond, the library is asked.
PLAIN = 0x250
_kinds: dict[str, list[str]] = {"L": [], "N": [], "s": [], "o": []}
for _c in map(chr, range(PLAIN)):
    _kinds["s" if _c in "\t\n\x0b\x0c\r \x85\xa0" else unicodedata.category(_c)[0] if unicodedata.category(_c)[0] in "LN" else "o"].append(_c)
_L, _N, _S, _O = ("[" + re.escape("".join(_kinds[k])) + "]" for k in "LNso")
#: public_tokenizers.PATTERN for plain characters.
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_O}+|{_S}+(?!{_L}|{_N}|{_O})|{_S}+")
UNUSUAL = re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]")
SAFE_CUT = re.compile(r"(?<=[^\s\x85\xa0]) (?=[^\s\x85\xa0])")


class Splitter:
    """Pre-tokens of a text. Each unusual character is classed once by the library and then stands as a plain one of its class."""

    STAND_INS = (("a", r"\p{L}"), ("0", r"\p{N}"), ("\t", r"\s"))

    def __init__(self) -> None:
        self.known: dict[int, str] = {}
        self.asked: list = []

    def ask(self, chars: set[str]) -> None:
        import tiktoken

        if not self.asked:
            byte_ranks = {bytes([i]): i for i in range(256)}
            self.asked = [(sign, tiktoken.Encoding(f"class-{sign}", pat_str=p, mergeable_ranks=byte_ranks, special_tokens={})) for sign, p in self.STAND_INS]
        for c in chars:
            self.known[ord(c)] = next((sign for sign, e in self.asked if e.encode_ordinary(c)), "!")

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, a segment of the text at a time. A space between two other characters always begins one."""
        at = 0
        while at < len(text):
            cut = SAFE_CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            yield self.split(text[at:end])
            at = end

    def split(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return PRE_TOKEN.findall(text)
        new = {c for c in set(text) if ord(c) >= PLAIN and ord(c) not in self.known}
        if new:
            self.ask(new)
        return [text[m.start() : m.end()] for m in PRE_TOKEN.finditer(text.translate(self.known))]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 and number in each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """Merges of a rank table, replayed over many words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a rank table needs all single bytes")
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit bytes; a word that is a token itself is that token, as the library has it."""
        out: list[bytes] = [b""] * len(words)
        laid = []
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif w:
                laid.append(i)
        for i, ids in zip(laid, self.replay([words[i] for i in laid]), strict=True):
            out[i] = array("i", ids).tobytes()
        return out

    def replay(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(data)
        first = np.zeros(n, np.int64)
        first[:-1] = self.byte_pairs[data[:-1].astype(np.int64) * 256 + data[1:]]
        first[ends - 1] = -1  # no pair spans two words
        first[-1] = -1
        places = np.flatnonzero(first >= 0)
        order = np.argsort(first[places], kind="stable")
        sorted_ranks, places = first[places][order], places[order]
        cuts = np.flatnonzero(np.diff(sorted_ranks)) + 1
        index = {int(sorted_ranks[a]): places[a:b].tolist() for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True) if b > a}
        due = list(index)
        heapq.heapify(due)
        ids, pair = self.byte_ids[data].tolist(), first.tolist()  # pair: rank of the pair that begins here, or -1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        starts = [0, *ends.tolist()]
        for end in starts[1:]:
            after[end - 1] = -1
        for start in starts[:-1]:
            before[start] = -1
        token, get = self.token, self.ranks.get
        alone: set[int] = set()
        while due:
            rank = heapq.heappop(due)
            places = index.pop(rank)
            if len(places) > 1:
                places.sort()  # of overlapping places the left one merges
            made = token[rank]
            for p in places:
                if pair[p] != rank:
                    continue
                q = after[p]
                nxt, prv = after[q], before[p]
                ids[p], pair[q], after[p] = rank, -1, nxt
                if nxt >= 0:
                    before[nxt] = p
                    pair[p] = new = get(made + token[ids[nxt]], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(due, new)
                        if new < rank:
                            alone.add(bisect_right(starts, p) - 1)
                else:
                    pair[p] = -1
                if prv >= 0:
                    pair[prv] = new = get(token[ids[prv]] + made, -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(prv)
                        else:
                            index[new] = [prv]
                            heapq.heappush(due, new)
                        if new < rank:
                            alone.add(bisect_right(starts, p) - 1)
        out = []
        for i, start in enumerate(starts[:-1]):
            if i in alone:
                out.append(self.by_itself(words[i]))
                continue
            own, p = [], start
            while p >= 0:
                own.append(ids[p])
                p = after[p]
            out.append(own)
        return out

    def by_itself(self, word: bytes) -> list[int]:
        """A word in which a merge made a pair of a lower rank than its own, so that its order is not that of the whole corpus."""
        ids: list[int] = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get, token = self.ranks.get, self.token
        pair = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]
        due = [(r, i) for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(due)
        while due:
            rank, p = heapq.heappop(due)
            if pair[p] != rank:
                continue
            q = after[p]
            ids[p], pair[q], pair[p], after[p] = rank, -1, -1, after[q]
            if after[p] >= 0:
                before[after[p]] = p
            for left in (before[p], p):
                if left >= 0 and after[left] >= 0:
                    pair[left] = get(token[ids[left]] + token[ids[after[left]]], -1)
                    if pair[left] >= 0:
                        heapq.heappush(due, (pair[left], left))
        out, p = [], 0
        while p >= 0:
            out.append(ids[p])
            p = after[p]
        return out


class CorpusEncoder(dict):
    """Pre-token -> ids as bytes. The words of a block that are not remembered are replayed together.

    When what is remembered has reached its bound it becomes old; old words that come again are taken over, others are
    dropped the next time.
    """

    def __init__(self, path: str, most: int = CACHE_CHARS, long: int = LONG) -> None:
        super().__init__()
        self.replay, self.splitter, self.most, self.long, self.held = Replay(read_ranks(path)), Splitter(), most, long, 0
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [[piece for some in self.splitter.pieces(text) for piece in some] if text else [] for text in texts]
        out: list[bytes | None] = []
        new: set[str] = set()
        for p in pieces:
            try:
                out.append(b"".join(map(self.__getitem__, p)))
            except KeyError:
                out.append(None)
                new.update([w for w in p if w not in self])
        if new:
            known = {w: self.old[w] for w in new if w in self.old}
            self.update(known)
            self.update(self.learned(sorted(new.difference(known))))
            out = [b"".join(map(self.__getitem__, p)) if x is None else x for x, p in zip(out, pieces, strict=True)]
            for word in [w for w in new if len(w) > self.long]:  # used for this block only
                del self[word]
            self.held += sum(len(w) for w in new if len(w) <= self.long)
            if self.held > self.most:
                self.old = dict(self)
                self.clear()
                self.held = 0
        return out

    def learned(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        some, held = [], 0
        for w in words:
            some.append(w)
            held += len(w)
            if held > LAID_OUT:
                out.update(zip(some, self.replay.ids([x.encode() for x in some]), strict=True))
                some, held = [], 0
        if some:
            out.update(zip(some, self.replay.ids([x.encode() for x in some]), strict=True))
        return out


@lru_cache(1)
def worker_encoder(path: str) -> CorpusEncoder:
    """The encoder with what it remembers, kept by a worker for its next task."""
    return CorpusEncoder(path)


def _ids_of(path: str, text: str) -> Callable[[pa.RecordBatch], pa.Array]:
    encoder = worker_encoder(path)
    return lambda batch: lists_of(encoder.encode(batch.column(text).to_pylist()))


def _bytes_of(path: str) -> Callable[[pa.Array], pa.Array]:
    tokens = {r: t for t, r in read_ranks(path).items()}

    def each(column: pa.Array) -> pa.Array:
        flat, at, out = column.flatten().to_pylist(), 0, []
        for n in pa.compute.list_value_length(column).to_pylist():
            own = flat[at : at + (n or 0)]
            at += n or 0
            try:
                out.append(b"".join(map(tokens.__getitem__, own)))
            except KeyError:
                out.append(b"".join([tokens[i] for i in own if i in tokens]))
        return pa.array(out, pa.binary())

    return each


def encode_bytes(docs: DataFrame, text: str = "text", ranks: str | None = None, out: str = "token_ids") -> DataFrame:
    """docs with the token ids of the whole text by the merge ranks, without special tokens.

    Each match of public_tokenizers.PATTERN is encoded by itself; special strings in a text are plain text. Null and
    empty texts give an empty list. An own column of the name out is replaced; rows are neither joined nor reordered, so
    repeated rows, null ids, ties and empty tables need no care. Texts and words have no length limit.
    """
    path = ranks or tokenizer_path("byte_bpe_50k.tiktoken")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        each = _ids_of(path, text)
        return lambda batch: [each(batch)]

    return block_columns(docs, text, [T.StructField(out, IDS)], make, BLOCK)


def decode_bytes(docs: DataFrame, ids: str = "token_ids", ranks: str | None = None, out: str = "decoded") -> DataFrame:
    """docs with the bytes of the token ids. Null and empty lists give no bytes; ids that are null or no rank are left out.

    The bytes need not be UTF-8 where ids are not those of a whole text, so out is binary.
    """
    path = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    kept = [f for f in docs.schema.fields if f.name != out]

    def make() -> Callable[[pa.RecordBatch], list[pa.RecordBatch]]:
        each = _bytes_of(path)

        def run(whole: pa.RecordBatch):
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), each(batch.column(ids))], names=[*(f.name for f in kept), out])

        return run

    return map_batches(docs, make, T.StructType([*kept, T.StructField(out, T.BinaryType())]))


def bytes_round_trip(docs: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """encode_bytes() and decode_bytes() in one pass: docs with token_ids and decoded."""
    path = ranks or tokenizer_path("byte_bpe_50k.tiktoken")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        ids_of, bytes_of = _ids_of(path, text), _bytes_of(path)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = ids_of(batch)
            return [ids, bytes_of(ids)]

        return each

    return block_columns(docs, text, [T.StructField("token_ids", IDS), T.StructField("decoded", T.BinaryType())], make, BLOCK)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytes_round_trip(docs).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
