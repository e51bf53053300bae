"""BPE encoding and decoding, exactly as the library does it, by tree concatenation.

A normalised text is halved down to pieces at fixed places, wherever they fall. Each piece is encoded to ids on its own, those
of a long text side by side in threads. Then ids are joined pair by pair, as a tree: a window of text around each
join is encoded again, and grows until its ids begin and end like those that both sides had there. Windows begin
and end at white space, where a word ends at least. A pre-token without white space that is too long to be
looked up is encoded by the same tree on its symbols. Ordinary pre-tokens come from a bounded cache, and from the
library on a miss.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table, tokenizer_path, with_columns

LONG, LEAF, CACHE_WORDS, AT_ONCE = 1024, 512, 150_000, 2000
PIECE = 2048  # characters of a piece of a text
MANY = 16  # pieces from which on the library encodes them whole, in threads
IDS = T.ArrayType(T.IntegerType())

#: Characters whose class and case are the same in every Unicode version in use; texts of other ones go to the library whole.
SAFE = "".join(chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2020), *range(0x2030, 0x203B), 0x20AC] if unicodedata.category(chr(c)) != "Cn")
SAFE = "".join(c for c in SAFE if c.lower() in SAFE)
_class = lambda test: "[" + re.escape("".join(c for c in SAFE if test(c))) + "]"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_letter, _number = (_class(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
_other = _class(lambda c: unicodedata.category(c)[0] not in "LN" and c not in _SPACES)
UNSAFE = re.compile(f"[^{re.escape(SAFE)}]")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{_letter}+|{_number}|{_other}+")


class TreeEncoder:
    """Encodes one long run of symbols by tree concatenation.

    inner and final encode a text to tokens, final as the end of a pre-token; text_of gives a token's symbols.
    """

    def __init__(self, inner: Callable[[str], list[int]], final: Callable[[str], list[int]], text_of: Callable[[int], str], leaf: int = LEAF, threads: int = 2) -> None:
        self.inner, self.final, self.text_of, self.leaf, self.threads = inner, final, text_of, max(1, leaf), threads

    def encode(self, text: str) -> list[int]:
        starts = range(0, len(text), self.leaf)
        pieces = [(text[i : i + self.leaf], i + self.leaf >= len(text)) for i in starts]
        with ThreadPoolExecutor(self.threads) as pool:  # the library encodes without Python's lock
            parts = list(pool.map(lambda p: (self.final if p[1] else self.inner)(p[0]), pieces))
            while len(parts) > 1:
                pairs = [(parts[i], parts[i + 1], i + 2 >= len(parts)) for i in range(0, len(parts) - 1, 2)]
                parts = [*pool.map(lambda p: self.join(*p), pairs), *parts[len(parts) & ~1 :]]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        n = 4
        while True:
            whole_left, whole_right = n >= len(left), n >= len(right)
            a, b = (left if whole_left else left[-n:]), (right if whole_right else right[:n])
            window = "".join(map(self.text_of, a)) + "".join(map(self.text_of, b))
            again = (self.final if ends and whole_right else self.inner)(window)
            if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
                return [*left[: len(left) - len(a)], *again, *right[len(b) :]]
            n *= 2


def known(path: str) -> str:
    """The path of a tokenizer file, if it is of the one kind whose normaliser, splitter and model this module knows."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer, splitter = json.dumps(spec["normalizer"]), json.dumps(spec["pre_tokenizer"])
    flags = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if spec["model"]["type"] != "BPE" or '"Lowercase"' not in normalizer or '"NFC"' not in normalizer or "'s|'t|'re" not in splitter or flags:
        raise ValueError(f"{path}: encode() takes lower-casing word BPE tokenizers only, with special tokens that stand for themselves")
    return path


class TextTree:
    """Encodes a normalised text to ids by tree concatenation; encode gives the ids of each of some stretches of text."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], piece: int = PIECE) -> None:
        self.encode, self.piece = encode, max(1, piece)

    def ids(self, text: str) -> list[int]:
        cuts = list(range(self.piece, len(text), self.piece))
        parts = self.encode([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        while len(parts) > 1:
            edges = [0, *cuts, len(text)]
            parts = [self.join(text, edges[i], edges[i + 1], edges[i + 2], parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            cuts = cuts[1::2]
        return parts[0]

    def join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its halves."""
        n = 16
        while True:
            a, b = max(start, cut - n), min(end, cut + n)
            if a > start:  # back to white space, on to white space
                a = max(start, text.rfind(" ", start, a + 1), text.rfind("\n", start, a + 1))
            if b < end:
                b = min([x for x in (text.find(" ", b, end), text.find("\n", b, end)) if x >= 0], default=end)
            before, after, again = self.encode([text[a:cut], text[cut:b], text[a:b]])
            agree = (a == start or (again[:1] == before[:1] and left[len(left) - len(before) :] == before)) and (b == end or (again[-1:] == after[-1:] and right[: len(after)] == after))
            if agree:
                return [*left[: len(left) - len(before)], *again, *right[len(after) :]]
            n *= 2


class WordEncoder(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes; missing ones are encoded together, and remembered while there is room."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, most: int = CACHE_WORDS, piece: int = PIECE) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of parallel work
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.long, self.leaf, self.most, self.piece = path, long, leaf, most, piece
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare = Tokenizer(self.library.model)  # for a pre-token, which is normalised already
        self.bare.pre_tokenizer = self.to_bytes
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def tree(self) -> TreeEncoder:
        """Made for the first long pre-token only."""
        from tokenizers import Tokenizer, models

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        final = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix))
        names = {i: w.removesuffix(suffix) if suffix else w for w, i in model["vocab"].items()}
        return TreeEncoder(lambda s: inner.encode(s, add_special_tokens=False).ids, lambda s: final.encode(s, add_special_tokens=False).ids, names.__getitem__, self.leaf)

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > self.most:
            self.clear()
        new = [w for w in words if w not in self and len(w) <= self.long]
        for i in range(0, len(new), AT_ONCE):  # the library's results are far larger than the ids
            some = new[i : i + AT_ONCE]
            for w, e in zip(some, self.bare.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self[w] = array("i", e.ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        tree = self.tree
        return np.asarray(tree.encode(self.to_bytes.pre_tokenize_str(word)[0][0]), "<i4").tobytes()

    @cached_property
    def unsplit(self) -> Callable[[str], list[int]]:
        """Encodes normalised text whole, by the library, which leaves Python's lock meanwhile."""
        from tokenizers import Tokenizer

        whole = Tokenizer(self.library.model)
        whole.pre_tokenizer = self.library.pre_tokenizer
        return lambda text: whole.encode(text, add_special_tokens=False).ids

    def words(self, segment: str) -> list[str | bytes]:
        """Pre-tokens of a text, or the ids of a longer one as bytes.

        Python's tables are used where they are surely the library's, else its own normaliser and splitter.
        """
        if not UNSAFE.search(segment):
            whole, split = unicodedata.normalize("NFC", segment).lower(), WORDS.findall
        else:
            whole, split = self.library.normalizer.normalize_str(segment), self.split
        if len(whole) <= self.piece:
            return split(whole)

        def encode(texts: list[str]) -> list[list[int]]:
            if len(texts) >= MANY:
                with ThreadPoolExecutor(2) as pool:
                    return list(pool.map(self.unsplit, texts))
            parts = [split(t) for t in texts]
            seen = set().union(*parts)
            if new := {w for w in seen if w not in self}:  # set.difference would walk all that is remembered
                self.learn(seen if len(self) + len(new) > self.most else new)
            return [np.frombuffer(b"".join(map(self.__getitem__, p)), "<i4").tolist() for p in parts]

        return [np.asarray(TextTree(encode, self.piece).ids(whole), "<i4").tobytes()]

    def split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str | None) -> list[str | bytes]:
        """Pre-tokens; special tokens and longer texts as their ids' bytes."""
        if not text:
            return []
        if not self.cut or "<|" not in text:
            return self.words(text)
        return [x for s in self.cut.split(text) if s for x in ([np.asarray([self.special[s]], "<i4").tobytes()] if s in self.special else self.words(s))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.parts(t) for t in texts]
        seen = set().union(*parts)
        special = {x for x in seen if isinstance(x, bytes)}
        if new := {w for w in seen if w not in self and w not in special}:
            self.learn(seen - special if len(self) + len(new) > self.most else new)
        if special:
            return [b"".join([x if isinstance(x, bytes) else self[x] for x in p]) for p in parts]
        return [b"".join(map(self.__getitem__, p)) for p in parts]


def _encoder(path: str, text: str, long: int, leaf: int) -> Callable[[pa.RecordBatch], pa.Array]:
    encoder = WordEncoder(path, long, leaf)

    def each(batch: pa.RecordBatch) -> pa.Array:
        parts = encoder.encode(batch.column(text).to_pylist())
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return each


def _decoder(path: str) -> Callable[[pa.Array], pa.Array]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    names = {i: sys.intern(w) for w, i in library.get_vocab(True).items()}
    plain = library.decoder is None  # then the library puts a space between tokens

    def text_of(ids: list[int]) -> str:
        return " ".join([names[i] for i in ids]) if plain else library.decode(ids, skip_special_tokens=False)

    def each(column: pa.Array) -> pa.Array:
        flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), 0
        texts = []
        for n in pa.compute.list_value_length(column).to_pylist():
            own = flat[at : at + (n or 0)]
            at += n or 0
            try:
                texts.append(text_of(own))
            except (KeyError, TypeError, OverflowError):
                texts.append(text_of([int(i) for i in own if i == i and i in names]))
        return pa.array(texts, pa.string())

    return each


def encode(docs: DataFrame, text: str = "text", tokenizer: str | None = None, out: str = "token_ids", long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """docs with the token ids of the whole text, without begin or end tokens.

    Null and empty texts give an empty list. Strings of special tokens inside a text become those tokens,
    as the library has it. An own column of the name out is replaced; rows are neither joined nor
    reordered, so repeated rows, null ids and empty tables need no care. Texts have no length limit.
    tokenizer is the file of a lower-casing word BPE tokenizer; of another kind it is refused.
    """
    path = known(tokenizer or tokenizer_path("word_bpe_49k.json"))

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        each = _encoder(path, text, long, leaf)
        return lambda batch: [each(batch)]

    return with_columns(docs, [T.StructField(out, IDS)], make)


def decode(docs: DataFrame, ids: str = "token_ids", tokenizer: str | None = None, out: str = "decoded") -> DataFrame:
    """docs with the text of the token ids, as the library decodes with special tokens kept.

    Null and empty lists give an empty text. Ids that are null or not in the vocabulary are left out, as the library does.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        each = _decoder(path)
        return lambda batch: [each(batch.column(ids))]

    return with_columns(docs, [T.StructField(out, T.StringType())], make)


def round_trip(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """encode() and decode() in one pass, by one Python worker a task: docs with token_ids and decoded."""
    path = known(tokenizer or tokenizer_path("word_bpe_49k.json"))

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        ids_of, text_of = _encoder(path, text, LONG, LEAF), _decoder(path)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = ids_of(batch)
            return [ids, text_of(ids)]

        return each

    return with_columns(docs, [T.StructField("token_ids", IDS), T.StructField("decoded", T.StringType())], make)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents."""
    return docs.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs))
