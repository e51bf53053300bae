"""Rules on lines, and the context of a match."""

from __future__ import annotations

import io
import tokenize

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as t
from tidewatch.functions.catalogue import CATALOGUE, Rule, checked
from tidewatch.functions.literals import required, rules_to_try
from tidewatch.functions.unions import union_all
from tidewatch.functions.whole import of_whole_files

# Fixed value: names of assignments that list what is refused.
EXCLUSION_NAME = r"(?i)\b[A-Za-z_]*(deny|denied|denylist|blocklist|blacklist|exclude|excluded|exclusion|skip|skipped|ignore|ignored|forbid|forbidden|refuse|never|secret_file|sensitive_file|redact|sanitiz|scrub|filter_out)[A-Za-z_]*\s*(?::[^=]*)?="
LINE_COMMENT = r"(?U)^\s*(#|//|--\s|;)"
LOOKBACK = 25
FILE = ["target", "version", "path"]


def match_rules(lines: DataFrame, rules: tuple[Rule, ...] = CATALOGUE, more: tuple[str, ...] = ()) -> DataFrame:
    """(target, version, path, line, text, rule_no, rule_id, ...) of every rule that a line of a source file meets.

    One projection holds every pattern as a literal, so each is compiled once; a line gives a rule once. Literals that
    each pattern needs are derived from it: one scan of a line finds them all, and only the patterns that they call for
    are tried. more are columns of lines that are carried along.
    """
    rules = checked(rules)
    ext = t.file_extension(F.col("path"))
    kept = [*FILE, "line", "text", *(c for c in more if c in lines.columns)]
    source = lines.select(*kept, ext.alias("ext")).where(F.col("ext").isin(*t.SOURCE_EXTENSIONS))
    # Outer, so that the scan is not repeated in a filter that the optimizer derives from the generator.
    tried = source.select("*", F.explode_outer(rules_to_try(F.col("text"), [required(r.pattern) for r in rules])).alias("rule_no"))
    meets, told = F, []
    for number, r in enumerate(rules):
        one = F.col("text").rlike("(?U)" + r.pattern)
        meets = meets.when(F.col("rule_no") == number, F.col("ext").isin(*r.extensions) & one if r.extensions else one)
        facts = {"rule_id": r.rule_id, "title": r.title, "severity": r.severity, "confidence": r.confidence, "capability": r.capability, "role": r.role}
        told.append(F.struct(F.lit(number).alias("rule_no"), *[F.lit(v).cast("string").alias(k) for k, v in facts.items()], F.lit(r.informational).alias("informational")))
    found = tried.where(F.col("rule_no").isNotNull() & meets.otherwise(False))
    return found.select(*kept, "ext", F.element_at(F.array(*told), F.col("rule_no") + 1).alias("r")).select(*kept, "ext", "r.*")


def python_prose(text: str) -> set[int]:
    """Lines that hold only comments and strings, as Python's own tokenizer sees them; none if it cannot."""
    prose, code = set(), set()
    layout = (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
    try:
        for kind, _, (first, _), (last, _), _ in tokenize.generate_tokens(io.StringIO(text).readline):
            if kind in (tokenize.COMMENT, tokenize.STRING):
                prose.update(range(first, last + 1))
            elif kind not in layout:
                code.add(first)
    except (SyntaxError, tokenize.TokenError, ValueError):
        return set()
    return prose - code


def prose_lines(lines: DataFrame) -> DataFrame:
    """(target, version, path, line) of the prose lines of Python files: each file is tokenized as a whole."""

    def each(path: str, numbers: list[int], texts: list[str]) -> list[tuple]:
        found = python_prose("\n".join(texts))
        return [(n,) for n in numbers if n in found]

    return of_whole_files(lines.where(t.file_extension(F.col("path")) == ".py"), each, "line:int")


def brackets(text: Column) -> Column:
    """(delta, low) of a line: how its brackets change the depth, and the lowest depth on the way, from 0."""
    signs = F.split(F.regexp_replace(text, r"[^()\[\]{}]+", ""), "")
    step = lambda c: F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("delta"), F.lit(0).alias("low"))
    change = F.aggregate(signs, start, lambda a, c: F.struct((a["delta"] + step(c)).alias("delta"), F.least(a["low"], a["delta"] + step(c)).alias("low")))
    return F.when(text.rlike(r"[()\[\]{}]"), change).otherwise(start)


def exclusion_lines(lines: DataFrame) -> DataFrame:
    """lines with is_exclusion: on an assignment that lists what is refused, or inside its open bracket.

    Only the nearest such assignment of the last 25 lines is judged. Depth never falls below 0, which each
    line's change and lowest point say without its text: after some lines it is the sum of their changes, less the
    lowest point on the way where that is below 0. Both are running values from one assignment to the next.
    """
    text = F.col("text")
    marked = lines.withColumn("named", F.coalesce(text.contains("=") & text.rlike(EXCLUSION_NAME), F.lit(False))).withColumn("b", brackets(text))
    marked = marked.withColumn("block", F.count_if("named").over(Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*FILE, "block").orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumns({"place": F.row_number().over(w), "depth": F.coalesce(F.sum("b.delta").over(before), F.lit(0))})
    lowest = F.least(F.lit(0), F.min(F.col("depth") + F.col("b.low")).over(before))
    inside = (F.col("block") > 0) & (F.col("place") <= LOOKBACK + 1) & (F.col("depth") > lowest)
    return marked.withColumn("is_exclusion", F.col("named") | F.coalesce(inside, F.lit(False))).drop("named", "b", "block", "place", "depth")


def match_context(matches: DataFrame, lines: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """matches with context prose, exclusion or null; prose wins. Only files that have a match are looked at.

    prose are the prose lines of the files if they are known already; else they are found in lines.
    """
    files = matches.select(*FILE).distinct()
    own = lines.join(files, FILE, "left_semi")
    ext = t.file_extension(F.col("path"))
    if prose is None:
        prose = union_all(prose_lines(own), own.where((ext != ".py") & F.col("text").rlike(LINE_COMMENT)).select(*FILE, "line"))
    prose = prose.select(*FILE, "line", F.lit(True).alias("is_prose"))
    refused = exclusion_lines(own).where("is_exclusion").select(*FILE, "line", "is_exclusion")
    out = matches.join(prose, [*FILE, "line"], "left").join(refused, [*FILE, "line"], "left")
    return out.withColumn("context", F.when(F.col("is_prose"), "prose").when(F.col("is_exclusion"), "exclusion")).drop("is_prose", "is_exclusion")
