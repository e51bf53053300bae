"""Alignment of the tokens of two tokenizers by diagonal run skipping, and the links that it gives over a corpus.

Each tokenizer's tokens of a text have the byte offsets at which they end. Where both have the same offset a group of
tokens ends. On a diagonal (the shift between the two token numbers) stretches of one-to-one groups are jumped by
exponential probing: 4, 8, 16 ... ends are compared at once, up to the first difference. There the group is resolved
locally by advancing the side that lags, which gives the new shift. The texts of a block are laid end to end and walked
in many lanes at once; a lane begins at any common end.

Texts are cut for both tokenizers at once, at borders that no token of either crosses, so that a word is looked up under
one name for both. Only the ids of such stretches are remembered; groups are found in the whole texts.

The links of a document (pairs of ids in a common group) are kept as distinct pairs with their numbers, so that counts over
the corpus shuffle pairs pre-aggregated a task. Scores look the commonest pairs up in a broadcast table of bounded size;
only pairs that are not in it, which are rare ones by choice, are joined by a shuffle.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc  # by a name of its own, which goes with a function to a new Python worker
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import token_counts
from tidewatch.llm.blocks import block_columns
from tidewatch.llm.common import fresh, map_batches, settle, table, tokenizer_path, written

CACHE_SIZE, LONG = 12_000_000, 64  # characters and ids of all remembered stretches, characters of the longest that is kept
AT_ONCE = 200  # stretches that are encoded at once
HOT_PAIRS = 2_000_000  # pairs of the broadcast table, 17 bytes each
WIDE = 1 << 16  # links of a group from which on its distinct ids are counted first
AT_ONCE_PAIRS = 1 << 21  # pairs of wide groups that are held before they are added up
LANE, REACH, FEW = 128, 32, 16  # A tokens of a lane, steps to find its begin, lanes from which on steps are taken for all at once
#: All that either tokenizer, or any version of the character classes, takes as a space.
_SPACES = f"\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000{token_counts.SPACE}"
#: A stretch ends before a space or line break that follows another character. There a pre-token of a byte-level pattern
#: ends and the next one begins, whatever comes before or after, and a pre-token of the piece model, too.
STRETCH = re.compile(f"[{_SPACES} \n]*+[^{_SPACES} \n]++(?:[{_SPACES}][{_SPACES} \n]*+[^{_SPACES} \n]*+)*+|[{_SPACES} \n]++")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "link_keys", "link_times")


class Side:
    """One tokenizer: how it cuts texts into stretches that it encodes each by itself, its ids of them, and the bytes of its tokens.

    Where joined is set, stretches that a text of them all is cut into are encoded as that text, and their ids told apart by their bytes.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[list[int]]], token: list[bytes], joined: bool = True) -> None:
        self.split, self.encode, self.token, self.joined = split, encode, token, joined
        self.lengths = np.array([len(t) for t in token], np.int64)
        self.names = [str(i) for i in range(len(token))]

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text; None where their bytes are not the text's."""
        ids, n, lossy = Remembered([self]).laid(texts)[0]
        return [None if bad else some for some, bad in zip(np.split(ids, np.cumsum(n)[:-1]), lossy.tolist(), strict=True)] if texts else []

    def encoded(self, words: list[str], ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in a row, how many each has, and whether their bytes are not the word's.

        ends are the words' ends in the bytes of all, if these cut into the words again.
        """
        if self.joined and ends is not None:
            text = "".join(words)
            ids = self.encode([text])[0]
            reached = np.cumsum(self.lengths[ids])
            at = np.searchsorted(reached, ends) + 1
            if b"".join(map(self.token.__getitem__, ids)) == text.encode() and (reached[at - 1] == ends).all():
                return np.asarray(ids, np.int32), np.diff(at, prepend=0), np.zeros(len(words), bool)
        each = self.encode(words)
        lossy = [b"".join([self.token[i] for i in x]) != w.encode() for x, w in zip(each, words, strict=True)]
        return np.fromiter(chain.from_iterable(each), np.int32), np.array([len(x) for x in each], np.int64), np.array(lossy, bool)


class Grown:
    """An array that grows at its end."""

    def __init__(self, first: np.ndarray) -> None:
        self.room, self.n = first, len(first)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.now, np.empty(self.n // 2 + len(more) + 1024, self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def now(self) -> np.ndarray:
        return self.room[: self.n]


class Remembered:
    """Stretches of text and their ids on some sides that cut alike; those of a block that are missing are encoded together.

    When what is remembered has reached its bound the short stretches that were seen most, up to half the bound, are kept.
    """

    def __init__(self, sides: list[Side]) -> None:
        self.sides, self.split = sides, sides[0].split
        self.begin([], np.zeros(0, np.int64), [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in sides])

    def begin(self, words: list[str], seen: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.known: defaultdict[str, int] = defaultdict(None, zip(words, range(len(words)), strict=True))
        self.known.default_factory = self.known.__len__  # a new stretch gets the next number
        self.seen, self.held = Grown(seen), sum(map(len, words)) + sum(len(ids) for ids, _, _ in sides)
        self.flat, self.ends, self.lossy = ([Grown(x) for x in y] for y in zip(*((ids, np.concatenate([[0], np.cumsum(n)]), bad) for ids, n, bad in sides), strict=True))

    def laid(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each side the ids of all texts in a row, how many each text has, and whether their bytes are not the text's."""
        pieces = [self.split(t) for t in texts]
        before = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64)
        if len(self.known) > before:
            self.learn([*islice(reversed(self.known), len(self.known) - before)][::-1])
        self.seen.now[:] += np.bincount(numbers, minlength=len(self.known))
        texts_end = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        within = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[texts_end], prepend=0)
        out = []
        for flat, ends, lossy in zip(self.flat, self.ends, self.lossy, strict=True):
            start = ends.now[numbers]
            count = ends.now[numbers + 1] - start
            out.append((flat.now[spread(start, count)], within(count), within(lossy.now[numbers]) > 0))
        if self.held > CACHE_SIZE:
            self.drop()
        return out

    def learn(self, words: list[str]) -> None:
        self.held += sum(map(len, words))
        self.seen.add(np.zeros(len(words), np.int64))
        parts = [words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]
        byte_ends = [joined_ends(p) if self.split("".join(p)) == p else None for p in parts]
        for side, flat, ends, lossy in zip(self.sides, self.flat, self.ends, self.lossy, strict=True):  # one tokenizer's tables at a time
            for part, own_ends in zip(parts, byte_ends, strict=True):
                ids, n, bad = side.encoded(part, own_ends)
                ends.add(flat.n + np.cumsum(n))
                flat.add(ids)
                lossy.add(bad)
                self.held += len(ids)

    def drop(self) -> None:
        words, seen = list(self.known), self.seen.now
        cost = np.array([len(w) for w in words], np.int64)
        short = cost <= LONG
        for ends in self.ends:
            cost += np.diff(ends.now)
        order = np.argsort(-seen, kind="stable")
        order = order[short[order]]
        keep = np.sort(order[np.cumsum(cost[order]) <= CACHE_SIZE // 2])
        sides = []
        for flat, ends, lossy in zip(self.flat, self.ends, self.lossy, strict=True):
            start, n = ends.now[keep], np.diff(ends.now)[keep]
            sides.append((flat.now[spread(start, n)], n, lossy.now[keep]))
        self.begin([words[k] for k in keep.tolist()], seen[keep] // 2, sides)


def joined_ends(words: list[str]) -> np.ndarray:
    """Where each word ends in the UTF-8 bytes of all in a row."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte at which each character begins
    return chars[np.cumsum([len(w) for w in words])]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each, count of them."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def byte_level(path: str) -> Side:
    """Tokens of a byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    bare = Tokenizer(library.model)
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    shown = {s: b for b in range(256) for s in [byte_sign(b)]}
    names = {i: w for w, i in library.get_vocab(False).items()}
    token = [bytes(shown[c] for c in names[i]) if i in names and all(c in shown for c in names[i]) else b"" for i in range(max(names) + 1)]
    return Side(STRETCH.findall, lambda words: [e.ids for e in bare.encode_batch_fast(words, add_special_tokens=False)], token)


def byte_sign(b: int) -> str:
    """The character that stands for a byte in byte-level vocabularies: itself if it is printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in printable else chr(256 + sum(1 for x in range(b) if x not in printable))


def sentence_pieces(path: str) -> Side:
    """Tokens of a sentencepiece BPE model that puts a space in front of the text; texts are given with that space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    token = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(token_counts.SPACE, " ").encode() for i, p in enumerate(pieces)]
    if token_counts.splits_at_spaces(path):
        # After a line break, which never merges, the library adds no space of its own: two tokens are taken off.
        return Side(STRETCH.findall, lambda words: [x[2:] for x in sp.encode(["\n" + w for w in words], num_threads=1)], token)
    return Side(lambda t: [t], lambda texts: sp.encode([t[1:] for t in texts], num_threads=1), token, joined=False)


def meet(ends_a: np.ndarray, ends_b: np.ndarray, i: np.ndarray, j: np.ndarray, most: int | None = None) -> np.ndarray:
    """Moves i and j, in place, to the next common end of each by advancing the side that lags; gives which have met.

    After most steps those that have not met stay where they are. A few that are left take their steps one by one.
    """
    apart = np.flatnonzero(ends_a[i] != ends_b[j])
    steps = 0
    while len(apart) and (steps < most if most is not None else len(apart) > FEW):
        x, y = ends_a[i[apart]], ends_b[j[apart]]
        i[apart] += x < y
        j[apart] += y < x
        apart = apart[ends_a[i[apart]] != ends_b[j[apart]]]
        steps += 1
    met = np.ones(len(i), bool)
    met[apart] = False
    if most is None and len(apart):
        view_a, view_b = memoryview(ends_a), memoryview(ends_b)
        for k in apart.tolist():
            p, q = int(i[k]), int(j[k])
            x, y = view_a[p], view_b[q]
            while x != y:
                if x < y:
                    p += 1
                    x = view_a[p]
                else:
                    q += 1
                    y = view_b[q]
            i[k], j[k] = p, q
        met[:] = True
    return met


def diagonal_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers at which groups end, in both lists of rising byte ends, whose last ends are the same."""
    ends_a, ends_b = np.ascontiguousarray(ends_a, np.int64), np.ascontiguousarray(ends_b, np.int64)
    n, m = len(ends_a), len(ends_b)
    # A lane begins after the first common end at or after every LANE-th token; where that is far the lane before goes on.
    i = np.arange(LANE - 1, n, LANE)
    j = np.searchsorted(ends_b, ends_a[i])
    met = meet(ends_a, ends_b, i, j, REACH)
    i, first = np.unique(np.concatenate([[0], i[met] + 1]), return_index=True)
    j = np.concatenate([[0], j[met] + 1])[first]
    stop = np.append(i[1:], n)
    odd: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # first and last token of irregular groups, in A and B
    going = np.flatnonzero(i < stop)
    while len(going):
        run, step = going, 4
        while len(run):  # on the diagonal j - i: 4, 8 ... ends at once while all of them agree
            ahead = np.arange(step)
            at_a, at_b = i[run][:, None] + ahead, j[run][:, None] + ahead
            differ = ends_a[np.minimum(at_a, n - 1)] != ends_b[np.minimum(at_b, m - 1)]
            differ |= at_a >= stop[run][:, None]
            some = differ.any(axis=1)
            far = np.where(some, differ.argmax(axis=1), step)
            i[run] += far
            j[run] += far
            run, step = run[~some], step * 2
        going = going[i[going] < stop[going]]
        if len(going):
            to_a, to_b = i[going], j[going]
            meet(ends_a, ends_b, to_a, to_b)
            odd.append((i[going], to_a, j[going], to_b))
            i[going], j[going] = to_a + 1, to_b + 1
            going = going[i[going] < stop[going]]
    first_a, last_a, first_b, last_b = map(np.concatenate, zip(*odd, strict=True)) if odd else [np.zeros(0, np.int64)] * 4
    return group_ends(n, first_a, last_a), group_ends(m, first_b, last_b)


def group_ends(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where groups of n tokens end, each of one token but for those from first to last."""
    change = np.zeros(n + 1, np.int8)
    change[first] += 1
    change[last] -= 1
    return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8) == 0) + 1


class GroupText:
    """Groups as `a1,a2|b1;a3|b2,b3`: every id with the sign after it is one row of a table of bytes, filled up with zeros."""

    def __init__(self, names_a: list[str], names_b: list[str]) -> None:
        self.size_a, self.size_b = len(names_a), len(names_b)
        signed = [f"{x}{sign}".encode() for names, signs in ((names_a, ",|"), (names_b, ",;")) for sign in signs for x in names]
        self.sizes = np.array([len(x) for x in signed], np.int64)
        self.table = np.array(signed, f"S{self.sizes.max()}")

    def of(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all groups, each with a sign at its end, and how many bytes there are before each of ends (numbers of groups)."""
        shown = np.empty(len(a) + len(b), np.int32)
        wide_a, wide_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        ids_a, ids_b = a.astype(np.int32), b.astype(np.int32) + 2 * self.size_a
        ids_a[cut_a - 1] += self.size_a
        ids_b[cut_b - 1] += self.size_b
        shown[np.arange(len(a)) + np.repeat(cut_b - wide_b, wide_a)] = ids_a  # after the B tokens of earlier groups
        shown[np.arange(len(b)) + np.repeat(cut_a, wide_b)] = ids_b  # after the A tokens up to its own group
        filled = self.table[shown].view(np.uint8)
        before = np.concatenate([[0], np.cumsum(self.sizes[shown])])
        tokens = np.concatenate([[0], cut_a + cut_b])
        return filled[filled != 0], before[tokens[ends]]


def link_keys(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct keys a * size_b + b of linked ids in order, how often each is linked, and the number of links."""
    end_a, end_b = np.asarray(cut_a), np.asarray(cut_b)
    from_a, from_b = np.concatenate([[0], end_a])[:-1], np.concatenate([[0], end_b])[:-1]
    wide_a, wide_b = end_a - from_a, end_b - from_b
    links = wide_a * wide_b
    some = links <= WIDE
    count = links[some]
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    across = np.repeat(wide_b[some], count)
    keys = a[np.repeat(from_a[some], count) + place // across].astype(np.int64) * size_b + b[np.repeat(from_b[some], count) + place % across]
    found, held = [np.unique(keys, return_counts=True)], 0
    for g in np.flatnonzero(~some):  # distinct ids first, so that a wide group costs its distinct pairs only
        ids_a, times_a = np.unique(a[from_a[g] : end_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[from_b[g] : end_b[g]], return_counts=True)
        found.append(((ids_a.astype(np.int64)[:, None] * size_b + ids_b[None, :]).ravel(), (times_a[:, None] * times_b[None, :]).ravel()))
        held += len(found[-1][0])
        if held > AT_ONCE_PAIRS:
            found, held = [added_up(found)], 0
    return *added_up(found), int(links.sum())


def added_up(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order, and their numbers."""
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, at, np.concatenate([t for _, t in found]))
    return keys, times


@lru_cache(1)
def sides(path_a: str, path_b: str) -> tuple[Side, Side, Callable[[list[str]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]], GroupText]:
    """Both tokenizers, what gives the ids of both, with all it remembers, and the text of groups, kept by a worker for its next task."""
    a, b = byte_level(path_a), sentence_pieces(path_b)
    known = [Remembered([a, b])] if a.split == b.split else [Remembered([a]), Remembered([b])]
    return a, b, lambda texts: [x for k in known for x in k.laid(texts)], GroupText(a.names, b.names)


def align_tokens(docs: DataFrame, text: str = "text", byte_tokenizer: str | None = None, piece_model: str | None = None) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, groups, link_keys and link_times.

    A are the tokens of space + text by the byte-level file, B those of text by the sentencepiece model, which adds that
    space itself; both without special tokens. groups is `a1,a2|b1;a3|b2,b3`, ids in order; a link is a pair of an A and a B
    token of one group; link_keys are the distinct linked ids in order, each a * pair_base() + b, link_times how often
    each is linked. Null and empty texts, and texts whose tokens' bytes are not those of space + text (a text with
    U+2581, which stands for a space in B), have zeros, an empty groups and empty lists. Own columns of these names are
    replaced; rows are neither joined nor reordered, so repeated rows, null ids and empty tables need no care. Texts
    and groups have no length limit.
    """
    path_a, path_b = byte_tokenizer or tokenizer_path("byte_bpe_50k.json"), piece_model or tokenizer_path("piece_bpe_32k.model")
    base = pair_base(path_b)
    fields = [T.StructField(c, T.StringType() if c == "groups" else T.ArrayType(T.LongType()) if c == "link_keys" else T.ArrayType(T.IntegerType()) if c == "link_times" else T.LongType()) for c in COLUMNS]

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        side_a, side_b, tokens, shown = sides(path_a, path_b)
        span = shown.size_a * base

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text).to_pylist()
            (a, n_a, lossy_a), (b, n_b, lossy_b) = tokens([" " + t for t in texts if t])
            fine = ~(lossy_a | lossy_b)
            a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
            place = np.flatnonzero([bool(t) for t in texts])
            (n_a, n_b), given_n = np.zeros((2, len(texts)), np.int64), (n_a * fine, n_b * fine)
            n_a[place], n_b[place] = given_n
            # All texts as one: each ends with a common end, so no group reaches from one to the next.
            cut_a, cut_b = diagonal_groups(np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b]))
            groups = np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(n_a)]), "right")
            row = np.repeat(np.arange(len(texts)), n_a)
            keys, times, _ = link_keys(row * shown.size_a + a, b, cut_a, cut_b, base)  # distinct within a text
            offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
            links = np.diff(np.concatenate([[0], np.cumsum(times)])[offsets])
            signs, ends = shown.of(a, b, cut_a, cut_b, groups)
            closed = np.ones(len(signs), bool)
            closed[ends[1:][np.diff(ends) > 0] - 1] = False  # no sign after a text's last group
            ends = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
            described = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype("<i4")), pa.py_buffer(signs[closed]))
            listed = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (keys % span, times.astype(np.int32))]
            return [*(pa.array(x.astype(np.int64)) for x in (n_a, n_b, np.diff(groups), links)), described, *listed]

        return each

    return block_columns(docs, text, fields, make, most=1 << 20)


def pair_base(piece_model: str | None = None) -> int:
    """The number of B's ids, by which a link's key is divided into A's id and the remainder, B's id."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model or tokenizer_path("piece_bpe_32k.model")).get_piece_size()


def link_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(link_key, n_docs, is_best) of all linked id pairs: in how many rows of aligned, and whether that is most for its A id.

    Keys are counted within tasks before they are shuffled. The highest counts have a row for each id of A's vocabulary at most,
    so they are broadcast. Without links the table is empty; a row without links (null keys too) counts for nothing.
    """
    counts = written(aligned.select(F.explode("link_keys").alias("link_key")).groupBy("link_key").agg(F.count("*").alias("n_docs")), "links")
    a = F.expr(f"link_key div {base}")
    best = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("link_key", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))


def commonest(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The pairs of the highest counts, most of them at most, and whether these are all; pairs of one count stay together."""
    if counts.limit(most + 1).count() <= most:
        return counts, True
    step = F.floor(F.log2("n_docs") * 8)
    total, least = 0, None
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # eight steps a doubling: some hundreds
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["s"]
    return (counts.where(step >= least) if least is not None else counts.limit(0)), False


def score_links(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """aligned with n_best and count_sum: its links whose pair is a best one of its A id, and the sum of the counts of its links.

    counts is link_counts() of the whole corpus, as a written table; aligned is a written table, too. Rows without links have
    zeros. A link that counts does not hold counts for nothing. Repeated rows are scored each, ties of best are all best.
    Own columns n_best and count_sum are replaced.
    """
    spark = aligned.sparkSession
    settle(spark)
    hot, whole = commonest(counts, hot_pairs)
    found = hot.toArrow()
    keys = found.column("link_key").to_numpy()
    order = np.argsort(keys, kind="stable")
    shared = spark.sparkContext.broadcast((keys[order], found.column("n_docs").to_numpy()[order], found.column("is_best").to_numpy()[order]))
    kept = [f for f in aligned.schema.fields if f.name not in ("n_best", "count_sum")]
    row, rest_keys, rest_times = fresh(aligned, "row", "rest_keys", "rest_times")
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    extra = [] if whole else [T.StructField(rest_keys, T.ArrayType(T.LongType())), T.StructField(rest_times, T.ArrayType(T.IntegerType()))]

    def make():
        known, n_docs, is_best = shared.value

        def run(batch: pa.RecordBatch):
            own, often = batch.column("link_keys"), batch.column("link_times")
            sizes = np.array([n or 0 for n in pc.list_value_length(own).to_pylist()], np.int64)
            key, times = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), often.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            weight = np.where(hit, times, 0)
            ends = np.cumsum(sizes)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
            best = add(weight * is_best[at]) if len(known) else np.zeros(len(sizes), np.int64)
            total = add(weight * n_docs[at]) if len(known) else np.zeros(len(sizes), np.int64)
            made = [pa.array(best.astype(np.int64)), pa.array(total.astype(np.int64))]
            if not whole:
                offsets = pa.array(np.concatenate([[0], np.cumsum(add((~hit).astype(np.int64)))]).astype(np.int32))
                made += [pa.ListArray.from_arrays(offsets, pa.array(key[~hit])), pa.ListArray.from_arrays(offsets, pa.array(times[~hit].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=[*(f.name for f in kept), "n_best", "count_sum", *(f.name for f in extra)])

        return run

    scored = map_batches(aligned, make, T.StructType([*kept, *longs("n_best", "count_sum"), *extra]))
    names = [f.name for f in kept]
    if whole:
        return scored
    scored = written(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    rare = scored.select(row, F.explode(F.arrays_zip(F.col(rest_keys).alias("link_key"), F.col(rest_times).alias("times"))).alias("l")).select(row, "l.link_key", "l.times")
    more = rare.join(counts, "link_key").groupBy(row).agg(F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    more = more.withColumnsRenamed({"more_sum": (s := fresh(scored, "more_sum")[0]), "more_best": (b := fresh(scored, "more_best")[0])})
    return scored.join(more, row, "left").select(*names, (F.col("n_best") + F.coalesce(b, F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce(s, F.lit(0))).alias("count_sum"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = written(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "link_keys", "link_times"), "aligned")
    counts = written(link_counts(aligned, pair_base()), "counts")
    return score_links(aligned, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
