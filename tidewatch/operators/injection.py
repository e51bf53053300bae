"""Text that addresses the model instead of describing a tool."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.enums import one_notch_down
from tidewatch.functions.shared import saved
from tidewatch.functions.text import file_extension, once, snippet
from tidewatch.functions.unions import union_all
from tidewatch.functions.whole import of_whole_files
from tidewatch.operators.findings import evidence, finding

FILE = ["target", "version", "path"]


class Signal(NamedTuple):
    rule_id: str
    pattern: str
    title: str
    severity: str
    confidence: str
    words: tuple[str, ...]  # every match has one of them, in lower case


# The signals' ids, patterns and ratings. The titles are our own.
SIGNALS = (
    Signal("injection.instruction_override", r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|earlier|above)\s+(?:instructions?|prompts?|rules?)|disregard\s+(?:all\s+)?(?:previous|prior|the\s+above)|forget\s+(?:everything|all\s+previous)|new\s+instructions?\s*:", "Tells the model to drop what it was told before", "CRITICAL", "HIGH", ("ignore", "disregard", "forget", "instruction")),
    Signal("injection.role_spoofing", r"(?im)<\s*(?:system|important|secret|admin)\s*>|\[\s*(?:system|admin)\s*\]|^\s*system\s*:|you\s+are\s+(?:now\s+)?(?:a|an|the)\s+\w+\s+(?:assistant|agent|model)", "Speaks as if it were the system", "HIGH", "MEDIUM", ("system", "important", "secret", "admin", "assistant", "agent", "model")),
    Signal("injection.concealment", r"(?i)do\s+not\s+(?:tell|inform|mention|show|reveal|display)\s+(?:this\s+)?(?:to\s+)?the\s+user|without\s+(?:telling|informing|notifying|asking)\s+the\s+user|do\s+not\s+mention\s+(?:this|that)|keep\s+this\s+(?:secret|hidden|confidential)\s+from|silently\s+(?:call|invoke|run|execute)", "Asks the model to keep something from the user", "CRITICAL", "HIGH", ("user", "mention", "keep", "silently")),
    Signal("injection.secret_solicitation", r"(?i)(?:read|send|include|attach|return|provide)\s+(?:the\s+)?(?:contents?\s+of\s+)?(?:~/\.ssh|\.env\b|environment\s+variables?|api[\s_-]?keys?|credentials?|tokens?|passwords?)|before\s+(?:using|calling)\s+this\s+tool[^.\n]{0,60}(?:read|open|fetch|load)", "Asks for secrets or files that the tool has no use for", "CRITICAL", "MEDIUM", (".ssh", ".env", "environment", "api", "credential", "token", "password", "tool")),
    Signal("injection.tool_redirection", r"(?i)(?:always\s+)?(?:call|invoke|use|run)\s+(?:the\s+)?[\w.]+\s+tool\s+(?:first|before|after|instead)|you\s+must\s+(?:also\s+)?(?:call|invoke|use)\s+", "Steers the model to other tools", "HIGH", "LOW", ("tool", "must")),
    Signal("injection.model_directed_language", r"(?i)\b(?:you\s+must\s+always|always\s+remember\s+to|it\s+is\s+critical\s+that\s+you|under\s+no\s+circumstances\s+should\s+you)\b", "Gives the model orders", "INFO", "LOW", ("must", "remember", "critical", "circumstances")),
)
# Lower-case signs other than ASCII that a pattern takes for s and i; a text with one is looked at whatever its words.
ALSO_LETTERS = ("\u017f", "\u0131", "i\u0307")
TOOL = re.compile(r"@(?:\w+\.)?tool\s*\(|@(?:\w+\.)?(?:list_tools|call_tool)\b")
OPENING = re.compile(r"""^\s*(?:[rubfRUBF]{0,2})(\"\"\"|''')""")
DESCRIPTION = r"""["']?description["']?\s*[:=]\s*["'](.{0,400}?)["']"""


def has_word(text: Column, words: Iterable[str]) -> Column:
    """Whether a text has one of the words in any case; never false where a pattern with that word would match."""
    return once(F.lower(text), lambda low: reduce(or_, [low.contains(w) for w in (*dict.fromkeys(words), *ALSO_LETTERS)]))


def signal_hits(texts: DataFrame, signals: tuple[Signal, ...] = SIGNALS) -> DataFrame:
    """texts (with a column text) and the signals that each shows, once a signal."""
    # Words first: most texts have none that a signal needs, and looking for them costs far less than a pattern.
    texts = texts.where(has_word(F.col("text"), [w for s in signals for w in s.words]))
    hits = [F.when(has_word(F.col("text"), s.words) & F.col("text").rlike("(?U)" + s.pattern), F.struct(*[F.lit(v).alias(k) for k, v in s._asdict().items() if k not in ("pattern", "words")])) for s in signals]
    return texts.withColumn("s", F.explode(F.array_compact(F.array(*hits)))).select("*", "s.*").drop("s")


def docstrings(lines: list[str]) -> list[tuple[int, str]]:
    """(line, text) of the docstring that follows each tool decorator within 25 lines, 60 lines of it at most."""
    out = []
    for at, line in enumerate(lines):
        if not TOOL.search(line):
            continue
        for start in range(at, min(at + 25, len(lines) - 1) + 1):
            opened = OPENING.match(lines[start])
            if opened:
                mark = opened[1]
                rest = "\n".join([lines[start].split(mark, 1)[1], *lines[start + 1 : start + 60]])
                out.append((start + 1, rest.split(mark, 1)[0].strip()))
                break
    return out


def tool_texts(lines: DataFrame) -> DataFrame:
    """(target, version, path, line, text, kind) of what a model reads of each tool: docstrings and description fields."""
    ext = file_extension(F.col("path"))
    python = lines.where(ext == ".py").select(*FILE, "line", "text")
    tools = python.where(F.col("text").rlike(TOOL.pattern)).select(*FILE).distinct()

    each = lambda path, numbers, texts: docstrings(texts)
    docs = of_whole_files(python.join(tools, FILE, "left_semi"), each, "line:int,text:string").withColumn("kind", F.lit("docstring"))
    fields = lines.where(ext.isin(".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")).select(*FILE, "line", F.explode(F.regexp_extract_all("text", F.lit("(?s)" + DESCRIPTION), F.lit(1))).alias("text"), F.lit("description-field").alias("kind"))
    return union_all(docs, fields.withColumn("text", F.trim("text")).where("text <> ''"))


def _first(hits: DataFrame, keys: list[str], order: list[str], most: int, detail: Column | None) -> DataFrame:
    """keys, first (the first pieces of evidence of each group) and n; only those pieces are gathered. Null keys are a group, too."""
    # Written, as they are read twice: else every text would be searched once for the pieces and once more for the numbers.
    hits = saved(hits.select(*dict.fromkeys([*keys, *order, "path", "line", "text"]), (F.lit(None).cast("string") if detail is None else detail).alias("detail")), "hits")
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= most)
    piece = F.struct("rn", evidence(F.col("path"), F.col("line"), snippet(F.col("text"), 240), F.col("detail")).alias("e"))
    first = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("first")).alias("f")
    counts = hits.groupBy(*keys).agg(F.count("*").alias("n")).alias("c")
    return first.join(counts, reduce(and_, [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])).select("f.*", "n")


def detect_tool_poisoning(lines: DataFrame | None, texts: DataFrame | None = None) -> DataFrame:
    """One finding for each signal in the texts of a target's tools, five pieces of evidence; texts if they are known already."""
    hits = signal_hits(tool_texts(lines) if texts is None else texts)
    rows = _first(hits, ["target", "version", "rule_id", "title", "severity", "confidence"], ["path", "line", "text"], 5, F.concat(F.lit("in a tool "), "kind"))
    return rows.select("target", "version", *finding(F.col("rule_id"), "PROMPT_INJECTION", F.col("severity"), F.col("confidence"), F.col("title"), F.transform("first", lambda x: x["e"]), F.col("n") - F.size("first")))


def detect_doc_injection(lines: DataFrame) -> DataFrame:
    """One finding for each document and signal, a notch lower and of low confidence, three pieces of evidence."""
    docs = lines.where(file_extension(F.col("path")).isin(".md", ".txt")).select(*FILE, "line", "text")
    hits = signal_hits(docs, tuple(s for s in SIGNALS if s.severity != "INFO"))
    rows = _first(hits, [*FILE, "rule_id", "title", "severity"], ["line"], 3, None)
    return rows.select("target", "version", *finding(F.concat("rule_id", F.lit(".documentation")), "PROMPT_INJECTION", one_notch_down(F.col("severity")), F.lit("LOW"), F.concat("title", F.lit(" (in documentation)")), F.transform("first", lambda x: x["e"]), F.col("n") - F.size("first")))
