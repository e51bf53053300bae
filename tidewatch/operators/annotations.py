"""Hints that a tool declares, held against what its own code does.

Python files are parsed: a hint counts where a tool's decorator holds it, itself or by the name of a constant, and
reaches over the function. In scripts a registration reaches to the next one, which windows over the lines show.
"""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.enums import severity_of, severity_rank
from tidewatch.functions.text import file_extension, snippet, walk_key
from tidewatch.functions.unions import union_all
from tidewatch.functions.whole import of_whole_files
from tidewatch.operators.findings import evidence, finding

FILE = ["target", "version", "path"]
# The hints with the value that makes a claim, where scripts register tools, how far a registration
# reaches, and what each claim rules out at which severity.
HINTS = {"readOnlyHint": ("read-only", True), "read_only_hint": ("read-only", True), "destructiveHint": ("non-destructive", False), "destructive_hint": ("non-destructive", False)}
SCRIPT_HINTS = {"read-only": r"""(?:\breadOnlyHint\b|\bread_only_hint\b|["']readOnlyHint["'])\s*[=:]\s*(?:True|true)\b""", "non-destructive": r"""(?:\bdestructiveHint\b|\bdestructive_hint\b|["']destructiveHint["'])\s*[=:]\s*(?:False|false)\b"""}
SCRIPT_TOOL = r"\.(?:registerTool|tool)\s*\(|\bregisterTool\s*\("
SEGMENT_LINES = 200
RULED_OUT = {
    "read-only": {"shell.execute": "HIGH", "process.spawn": "HIGH", "code.eval": "HIGH", "code.remote_execution": "HIGH", "filesystem.delete": "HIGH", "filesystem.chmod": "HIGH", "persistence.scheduler": "HIGH", "persistence.startup": "HIGH", "package.install": "HIGH", "filesystem.write": "MEDIUM"},
    "non-destructive": {"filesystem.delete": "HIGH", "shell.execute": "MEDIUM"},
}


def hints_in(node: ast.AST, constants: dict[str, set[str]]) -> dict[str, int]:
    """Claims that an expression makes, with the line of the first of each."""
    out: dict[str, int] = {}

    def note(claim: str, line: int) -> None:
        out[claim] = min(line, out.get(claim, line))

    def value(name: object, given: ast.AST, line: int) -> None:
        if isinstance(name, str) and name in HINTS and isinstance(given, ast.Constant) and given.value is HINTS[name][1]:
            note(HINTS[name][0], line)

    for part in ast.walk(node):
        if isinstance(part, ast.keyword):
            value(part.arg, part.value, part.value.lineno)
        elif isinstance(part, ast.Dict):
            for name, given in zip(part.keys, part.values, strict=True):
                if isinstance(name, ast.Constant):
                    value(name.value, given, name.lineno)
        elif isinstance(part, ast.Name):
            for claim in constants.get(part.id, ()):
                note(claim, part.lineno)
    return out


def registers(decorator: ast.expr) -> bool:
    """Whether a decorator is a call of something named tool."""
    called = decorator.func if isinstance(decorator, ast.Call) else None
    return getattr(called, "attr", getattr(called, "id", None)) == "tool"


def body_end(node: ast.FunctionDef | ast.AsyncFunctionDef, lines: list[str]) -> int:
    """Last line of a function, with comments that follow it and are indented as its body is."""
    end = node.end_lineno
    for number in range(end + 1, len(lines) + 1):
        text = lines[number - 1].lstrip()
        if text and not (text.startswith("#") and len(lines[number - 1]) - len(text) > node.col_offset):
            break
        end = number if text else end
    return end


def python_claims(text: str) -> list[tuple[int, str, int, int]]:
    """(line of the claim, claim, first and last line of the tool's function) of a file; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    constants: dict[str, set[str]] = {}
    for node in tree.body:
        if isinstance(node, ast.Assign | ast.AnnAssign) and node.value is not None:
            for name in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(name, ast.Name) and name.id.isupper():
                    constants[name.id] = set(hints_in(node.value, {}))
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            claims: dict[str, int] = {}
            for decorator in filter(registers, node.decorator_list):
                for claim, line in hints_in(decorator, constants).items():
                    claims.setdefault(claim, line)
            end = body_end(node, text.split("\n")) if claims else 0
            out += [(line, claim, node.lineno, end) for claim, line in sorted(claims.items())]
    return sorted(out)


def script_claims(lines: DataFrame) -> DataFrame:
    """The same of registrations in scripts: each reaches to the next one, 200 lines at most."""
    order = Window.partitionBy(*FILE).orderBy("line")
    ends = lines.groupBy(*FILE).agg(F.max("line").alias("end"))
    tools = lines.where(F.col("text").rlike(SCRIPT_TOOL)).select(*FILE, F.col("line").alias("first"), (F.lead("line").over(order) - 1).alias("before_next"))
    tools = tools.join(ends, FILE).withColumn("last", F.least(F.coalesce("before_next", "end"), F.col("first") + SEGMENT_LINES - 1))
    made = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(claim)) for claim, p in SCRIPT_HINTS.items()]))
    hints = lines.select(*FILE, "line", F.explode(made).alias("claim"))
    found = tools.join(hints, FILE).where("line between first and last")
    return found.groupBy(*FILE, "claim", "first", "last").agg(F.min("line").alias("line")).select(*FILE, "line", "claim", "first", "last", F.lit("LOW").alias("confidence"))


def tool_claims(lines: DataFrame) -> DataFrame:
    """(target, version, path, line, claim, first, last, confidence) of the hints of tools; only files with a hint are read."""
    ext = file_extension(F.col("path"))
    code = lines.where(ext.isin(".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")).select(*FILE, "line", "text", (ext == ".py").alias("python"))
    hinted = code.where(F.lower("text").rlike("readonlyhint|read_only_hint|destructivehint|destructive_hint")).select(*FILE).distinct()
    code = code.join(hinted, FILE, "left_semi")

    each = lambda path, numbers, texts: python_claims("\n".join(texts))
    found = of_whole_files(code.where("python"), each, "line:int,claim:string,first:int,last:int").withColumn("confidence", F.lit("MEDIUM"))
    return union_all(found, script_claims(code.where("not python")))


def contradict_annotations(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches inside a claiming tool's lines whose capability the claim rules out, with the severity of that."""
    table = F.create_map(*[F.lit(x) for claim, caps in RULED_OUT.items() for cap, severity in caps.items() for x in (f"{claim}/{cap}", severity)])
    real = matches.where("capability is not null and context is null").select(*FILE, F.col("line").alias("hit_line"), "text", "capability", "rule_no")
    hits = claims.join(real, FILE).where("hit_line between first and last")
    return hits.withColumn("severity", table[F.concat_ws("/", "claim", "capability")]).where("severity is not null")


def contradicted_annotations(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """One finding for each kind of claim that the code contradicts: four claims with two hits each as evidence."""
    hits = contradict_annotations(claims, matches).withColumn("walk", walk_key(F.col("path")))
    claim_key = ["target", "version", "claim", "walk", "line", "first"]
    ranked = hits.withColumn("hit", F.row_number().over(Window.partitionBy(*claim_key).orderBy("hit_line", "rule_no"))).withColumn("tool", F.dense_rank().over(Window.partitionBy("target", "version", "claim").orderBy("walk", "line", "first")))
    told = F.concat(F.when(F.col("hit") == 1, F.array(evidence(F.col("path"), F.col("line"), None, F.concat("claim", F.lit(" claim"))))).otherwise(F.array().cast("array<struct<path:string,line:int,snippet:string,detail:string,context:string>>")), F.array(evidence(F.col("path"), F.col("hit_line"), snippet(F.col("text")), F.col("capability"))))
    shown = (F.col("tool") <= 4) & (F.col("hit") <= 2)
    rows = ranked.groupBy("target", "version", "claim").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("tool", "hit", told.alias("e"))))), lambda x: x["e"])).alias("evidence"),
        F.collect_set("capability").alias("caps"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.bool_or(F.col("confidence") == "MEDIUM").alias("sure"),
    )
    runs = F.exists("caps", lambda c: c.startswith("shell.") | c.startswith("process.") | c.startswith("code."))
    verb = F.when(runs, "runs commands or code").when(F.array_contains("caps", "filesystem.delete"), "deletes files").when(F.array_contains("caps", "filesystem.write"), "writes files").otherwise("changes the system")
    rule = F.concat(F.lit("annotations."), F.replace("claim", F.lit("-"), F.lit("_")), F.lit("_contradicted"))
    return rows.select("target", "version", *finding(rule, "CAPABILITIES", severity_of(F.col("rank")), F.when(F.col("sure"), "MEDIUM").otherwise("LOW"), F.concat(F.lit("Tool is annotated "), "claim", F.lit(" but its code "), verb), F.col("evidence")))
