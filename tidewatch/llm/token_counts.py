"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths, broadcast once: the commonest of a bounded
sample of rows, counted in tasks, each of which sends its own commonest only. The sample decides how often the table is
hit, never a result. Tier two is a cache in each worker, bounded by characters; a miss is encoded by the library. No
pre-token is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import map_batches, table, tokenizer_path, with_columns

SPACE = "▁"
#: A pre-token is a run of spaces with what follows it up to the next space or line break. No piece of the
#: vocabulary has a space after another character, nor a line break, so no merge crosses these borders.
PRE_TOKEN = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n")
SAMPLE_ROWS, FREQUENT = 4000, 60_000  # rows that pre-tokens are counted in, and entries of the frequent table
CACHE_CHARS, LONG = 8_000_000, 64  # characters of all remembered pre-tokens, and of the longest that is remembered


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(path: str) -> bool:
    """Whether the vocabulary allows PRE_TOKEN: no piece holds a space after another character, nor a line break."""
    sp = _processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths of the pre-tokens that are word-initial pieces of the vocabulary: what is frequent where nothing could be counted."""
    sp = _processor(path)
    words = [p.replace(SPACE, " ") for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if re.fullmatch(f"{SPACE}[^{SPACE}<]+", p)]
    return dict(zip(words, (len(x) for x in sp.encode([w[1:] for w in words], num_threads=1)), strict=True))


def counted_lengths(docs: DataFrame, text: str, path: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of about rows random rows of docs, most of them at most."""
    n = docs.count()
    some = docs.select(F.col(text).alias("text")).where("text is not null")
    some = some if n <= rows else some.sample(rows / n, 7)

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for x in batch.column("text"):
                seen.update(w for w in PRE_TOKEN.findall(" " + x.as_py()) if len(w) <= LONG)
            words, counts = zip(*seen.most_common(most), strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        return each

    found = map_batches(some, make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    sp = _processor(path)
    words = [r.word for r in found.collect()]
    return dict(zip(words, (len(x) - 2 for x in sp.encode(["\n" + w for w in words], num_threads=1)), strict=True))


class Lengths(dict):
    """Pre-token lengths; a missing one is encoded, and remembered if it is short, while there is room."""

    def __init__(self, first: dict[str, int], path: str, most: int = CACHE_CHARS) -> None:
        super().__init__(first)
        self.first, self.sp, self.most, self.held = first, _processor(path), most, 0
        self["\n"] = 1

    def __missing__(self, word: str) -> int:
        # After a line break, which never merges, the library adds no space of its own: it costs the two tokens taken off.
        n = len(self.sp.encode("\n" + word)) - 2
        if len(word) <= LONG:
            self.held += len(word)
            if self.held > self.most:
                self.clear()
                self.update(self.first)
                self["\n"], self.held = 1, len(word)
            self[word] = n
        return n


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with n_tokens, the number of tokens that the library gives the whole text.

    Null and empty texts have 0. No begin, end or added special tokens. Texts of any length are read once,
    left to right. An own column n_tokens is replaced; rows are neither joined nor reordered, so repeated
    rows and ids, null ids and empty tables need no care.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")
    safe = splits_at_spaces(path)
    shared = docs.sparkSession.sparkContext.broadcast(counted_lengths(docs, text, path) if safe else {})

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        known = Lengths(shared.value, path)

        def count(value: str | None) -> int:
            if not value:
                return 0
            if not safe:
                return len(known.sp.encode(value))
            return sum(map(known.__getitem__, PRE_TOKEN.findall(" " + value)))

        return lambda batch: [pa.array([count(x.as_py()) for x in batch.column(text)], pa.int64())]

    return with_columns(docs, [T.StructField("n_tokens", T.LongType())], make)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
