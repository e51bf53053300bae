"""What needs a whole file, read off file rows (target, version, path, text) before they become lines.

Each helper is a vectorised function of the text column in place: no row is moved, so a tree is read, judged and left
where it lies. Files that cannot hold what is looked for are told by a pattern first and never reach Python. Texts
are those of functions.text.normal_text: sanitized, with line feeds between lines, as explode_lines numbers them.
Null texts give nothing, repeated rows give their results each, an empty table gives none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.literals import can_match, required
from tidewatch.functions.catalogue import CATALOGUE, Rule
from tidewatch.functions.text import SOURCE_EXTENSIONS, file_extension
from tidewatch.functions.unions import union_all
from tidewatch.operators.annotations import SCRIPT_HINTS, SCRIPT_TOOL, SEGMENT_LINES, python_claims
from tidewatch.operators.injection import DESCRIPTION, TOOL, docstrings
from tidewatch.operators.matches import LINE_COMMENT, python_prose
from tidewatch.operators.provider import profile, script_profile

FILE = ["target", "version", "path"]
SCRIPTS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")
HINT = "readonlyhint|read_only_hint|destructivehint|destructive_hint"


def _exploded(files: DataFrame, found: Column, *names: str) -> DataFrame:
    return files.select(*FILE, F.explode(found).alias("f")).select(*FILE, *(F.col(f"f.{n}") for n in names))


def _per_file(each, shape: str):
    """A vectorised function of texts from one of a text that gives rows."""

    @F.pandas_udf(f"array<struct<{shape}>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([each(t) if t else [] for t in texts], index=texts.index, dtype=object)

    return run


def script_claims_of(text: str) -> list[tuple[int, str, int, int]]:
    """(line of the hint, claim, first and last line) of registrations in a script: each reaches to the next one, 200 lines at most."""
    lines = text.split("\n")
    tools = [i for i, x in enumerate(lines, 1) if re.search(SCRIPT_TOOL, x)]
    out = []
    for at, following in zip(tools, [*tools[1:], len(lines) + 1], strict=True):
        last = min(following - 1, at + SEGMENT_LINES - 1)
        for claim, pattern in SCRIPT_HINTS.items():
            line = next((n for n in range(at, last + 1) if re.search(pattern, lines[n - 1])), None)
            if line:
                out.append((line, claim, at, last))
    return out


def prose_in_files(files: DataFrame, rules: tuple[Rule, ...] = CATALOGUE) -> DataFrame:
    """(target, version, path, line) of the prose lines of source files in which a rule can match."""
    ext = file_extension(F.col("path"))
    some = files.where(ext.isin(*SOURCE_EXTENSIONS) & can_match(F.col("text"), [required(r.pattern) for r in rules]))
    python = _exploded(some.where(ext == ".py"), _per_file(lambda t: [(n,) for n in sorted(python_prose(t))], "line:int")("text"), "line")
    rest = some.where(ext != ".py").select(*FILE, F.posexplode(F.split("text", "\n")).alias("line", "x")).where(F.col("x").rlike(LINE_COMMENT))
    return union_all(python, rest.select(*FILE, (F.col("line") + 1).alias("line")))


def tool_texts_in_files(files: DataFrame) -> DataFrame:
    """(target, version, path, line, text, kind) of what a model reads of each tool: docstrings and description fields."""
    ext = file_extension(F.col("path"))
    python = files.where((ext == ".py") & F.col("text").rlike(TOOL.pattern))
    docs = _exploded(python, _per_file(lambda t: docstrings(t.split("\n")), "line:int,text:string")("text"), "line", "text").withColumn("kind", F.lit("docstring"))
    lines = files.where(ext.isin(*SCRIPTS) & F.col("text").contains("description")).select(*FILE, F.posexplode(F.split("text", "\n")).alias("line", "x"))
    fields = lines.select(*FILE, (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("x", F.lit("(?s)" + DESCRIPTION), F.lit(1))).alias("text"))
    return union_all(docs, fields.select(*FILE, "line", F.trim("text").alias("text"), F.lit("description-field").alias("kind")).where("text <> ''"))


def tool_claims_in_files(files: DataFrame) -> DataFrame:
    """(target, version, path, line, claim, first, last, confidence) of the hints of tools."""
    ext = file_extension(F.col("path"))
    hinted = files.where(ext.isin(".py", *SCRIPTS) & F.lower("text").rlike(HINT))
    shape = "line:int,claim:string,first:int,last:int"
    made = lambda some, each, sure: _exploded(some, _per_file(each, shape)("text"), "line", "claim", "first", "last").withColumn("confidence", F.lit(sure))
    return union_all(made(hinted.where(ext == ".py"), python_claims, "MEDIUM"), made(hinted.where(ext != ".py"), script_claims_of, "LOW"))


def provider_profiles_in_files(files: DataFrame) -> DataFrame:
    """(target, version, path, credentials, destinations) of files that read the environment and have a profile."""
    ext = file_extension(F.col("path"))
    reading = files.where((ext.isin(".py", *SCRIPTS)) & (F.col("text").contains("environ") | F.col("text").contains("getenv") | F.col("text").contains("process.env")))
    shape = "credentials:array<string>,destinations:array<string>"
    made = lambda some, each: _exploded(some, _per_file(lambda t: [x] if (x := each(t)) else [], shape)("text"), "credentials", "destinations")
    return union_all(made(reading.where(ext == ".py"), profile), made(reading.where(ext != ".py"), script_profile))
