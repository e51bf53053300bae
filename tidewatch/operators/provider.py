"""Flows that are a client sending a provider's own key to that provider.

A Python file is parsed and its names are resolved: import aliases, from-imports, sessions bound to names, and tables of
literals that entries are taken from. Every use of the environment and every outbound call has to be accounted for by
what the file shows as a literal, or a constant bound once to one. Any doubt - another use of the environment or of a
module as a value, a computed address, a raw socket, a file that does not parse - gives no profile, and a flow without
one keeps its full severity. Scripts are judged by the same rule with operators.script_profiles.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.hosts import INFRASTRUCTURE, LOCAL, MODEL_HOSTS, SUSPICIOUS, registrable_name
from tidewatch.functions.text import file_extension
from tidewatch.functions.whole import of_whole_files
from tidewatch.operators.network import SECRETISH
from tidewatch.operators.script_profiles import script_findings

FILE = ["target", "version", "path"]
SCRIPTS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")
SENDERS = {"get", "post", "put", "patch", "delete", "head", "request", "send", "stream"}
#: Methods that only a client has; get() and the like are also a dictionary's.
SURE_SENDERS = {"post", "put", "patch", "request", "stream", "urlopen", "ws_connect"}
CLIENTS = {"requests", "httpx", "aiohttp"}
SESSIONS = {"requests.Session", "requests.session", "requests.sessions.Session", "httpx.Client", "httpx.AsyncClient", "aiohttp.ClientSession"}
ENVIRONMENT_READS = {"os.environ.get", "os.getenv", "os.environ.pop", "os.environ.setdefault"}
#: Ways out, and ways to reach a name unseen, that are not followed.
UNSEEN_MODULES = {"smtplib", "ftplib", "telnetlib", "http.client", "urllib3", "websocket", "websockets", "paramiko", "pycurl", "grpc", "asyncssh", "xmlrpc.client", "aiohttp.client", "importlib", "ctypes"}
UNSEEN_CALLS = {"eval", "exec", "compile", "__import__", "globals", "locals", "vars", "socket.socket", "socket.create_connection", "socket.gethostbyname", "socket.getaddrinfo", "asyncio.open_connection"}
HOST = re.compile(r"https?://([A-Za-z0-9._~-]+)")
ENDED = re.compile(r"https?://([A-Za-z0-9._~-]+)(?=[/:?#])")


class Doubt(Exception):
    """Something that the source does not show."""


class _File(ast.NodeVisitor):
    def __init__(self, tree: ast.Module) -> None:
        self.names: set[str] = set()
        self.hosts: set[str] = set()
        self.aliases: dict[str, str] = {}
        self.bound: dict[str, list[ast.expr | None]] = {}
        self.loops: dict[str, list[ast.expr]] = {}
        for node in ast.walk(tree):
            self.bind(node)
        once = {n: v[0] for n, v in self.bound.items() if len(v) == 1 and n not in self.aliases}
        self.constants = {n: v.value for n, v in once.items() if n.isupper() and isinstance(v, ast.Constant) and isinstance(v.value, str)}
        self.tables = {n: v for n, v in once.items() if n.isupper() and isinstance(v, ast.Dict | ast.List | ast.Tuple)}
        self.sessions: dict[str, list[ast.Call]] = {}
        for name, values in self.bound.items():
            made = [v.value if isinstance(v, ast.Await) else v for v in values]
            made = [v for v in made if isinstance(v, ast.Call) and self.dotted(v.func) in SESSIONS]
            if made:
                self.sessions[name] = made if len(made) == len(values) else []
        self.believed: set[int] = set()
        self.visit(tree)

    # --- names ---

    def bind(self, node: ast.AST) -> None:
        put = lambda target, value: self.bound.setdefault(ast.unparse(target), []).append(value)
        if isinstance(node, ast.Import):
            for a in node.names:
                if a.name in UNSEEN_MODULES:
                    raise Doubt
                self.alias(a.asname or a.name.partition(".")[0], a.name if a.asname else a.name.partition(".")[0])
        elif isinstance(node, ast.ImportFrom) and not node.level:
            for a in node.names:
                whole = f"{node.module}.{a.name}"
                if node.module in UNSEEN_MODULES or whole in UNSEEN_MODULES or (a.name == "*" and node.module.partition(".")[0] in {"os", "urllib", *CLIENTS}):
                    raise Doubt
                self.alias(a.asname or a.name, whole)
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                simple = isinstance(target, ast.Name | ast.Attribute)
                for part in [target] if simple else [n for n in ast.walk(target) if isinstance(n, ast.Name)]:
                    put(part, node.value if simple else None)
        elif isinstance(node, ast.AnnAssign | ast.NamedExpr | ast.AugAssign):
            put(node.target, None if isinstance(node, ast.AugAssign) else node.value)
        elif isinstance(node, ast.For | ast.AsyncFor | ast.comprehension):
            for part in ast.walk(node.target):
                if isinstance(part, ast.Name):
                    put(part, None)
            last = node.target.elts[-1] if isinstance(node.target, ast.Tuple) and len(node.target.elts) == 2 else node.target
            if isinstance(last, ast.Name):
                self.loops.setdefault(last.id, []).append(node.iter)
        elif isinstance(node, ast.withitem) and node.optional_vars is not None:
            put(node.optional_vars, node.context_expr)
        elif isinstance(node, ast.arg):
            self.bound.setdefault(node.arg, []).append(None)

    def alias(self, name: str, whole: str) -> None:
        if self.aliases.setdefault(name, whole) != whole:
            raise Doubt

    def dotted(self, node: ast.expr) -> str | None:
        """What a name or an attribute stands for, by the imports; None for other expressions."""
        if isinstance(node, ast.Name):
            return self.aliases.get(node.id, node.id)
        if isinstance(node, ast.Attribute):
            owner = self.dotted(node.value)
            return f"{owner}.{node.attr}" if owner else None
        return None

    # --- values ---

    def entry_table(self, node: ast.expr) -> ast.expr | None:
        """The table that an expression is an entry of: TABLE[x], TABLE.get(x), or a name bound to such, or looping over it."""
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name):
            return self.tables.get(node.value.id)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and isinstance(node.func.value, ast.Name) and len(node.args) == 1:
            return self.tables.get(node.func.value.id)
        if isinstance(node, ast.Name) and node.id in self.bound:
            values, loops = self.bound[node.id], self.loops.get(node.id, [])
            if len(values) == 1 and values[0] is not None and not isinstance(values[0], ast.Name):
                return self.entry_table(values[0])
            if len(values) == len(loops) == 1:
                over = loops[0]
                if isinstance(over, ast.Call) and isinstance(over.func, ast.Attribute) and over.func.attr in ("values", "items") and not over.args:
                    over = over.func.value
                return self.tables.get(over.id) if isinstance(over, ast.Name) else None
        return None

    def column(self, node: ast.expr) -> list[str] | None:
        """All values that entry["key"] can have, where entry is of a table of literals."""
        if isinstance(node, ast.Subscript):
            owner, key = node.value, node.slice
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and node.args:
            owner, key = node.func.value, node.args[0]
        else:
            return None
        table = self.entry_table(owner)
        if table is None or not (isinstance(key, ast.Constant) and isinstance(key.value, str)):
            return None
        entries = table.values if isinstance(table, ast.Dict) else table.elts
        out = []
        for entry in entries:
            if not isinstance(entry, ast.Dict) or None in entry.keys:
                raise Doubt
            for k, v in zip(entry.keys, entry.values, strict=True):
                if not isinstance(k, ast.Constant):
                    raise Doubt
                if k.value == key.value and not (isinstance(v, ast.Constant) and v.value is None):
                    if not (isinstance(v, ast.Constant) and isinstance(v.value, str)):
                        raise Doubt
                    out.append(v.value)
        return out

    def text(self, node: ast.expr | None) -> tuple[str, bool]:
        """The literal that an expression is, or begins with; and whether it is all of it."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value, True
        if isinstance(node, ast.Name) and node.id in self.constants:
            return self.constants[node.id], True
        if isinstance(node, ast.JoinedStr) and node.values:
            first = node.values[0]
            if len(node.values) > 1 and isinstance(first, ast.FormattedValue) and isinstance(node.values[1], ast.Constant):
                return self.text(first.value)[0] + node.values[1].value, len(node.values) == 2
            return self.text(first.value if isinstance(first, ast.FormattedValue) else first)[0], len(node.values) == 1
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            left = self.text(node.left)[0]
            return (left + node.right.value, True) if isinstance(node.right, ast.Constant) and isinstance(node.right.value, str) else (left, False)
        raise Doubt

    def places(self, node: ast.expr | None) -> set[str]:
        """The hosts that an address can have."""
        if node is not None and (column := self.column(node)) is not None:
            found = [HOST.match(x) for x in column]
        else:
            whole, sure = self.text(node)
            found = [(HOST if sure else ENDED).match(whole)]
        if not found or not all(found):
            raise Doubt
        return {f[1].lower() for f in found}

    def send_to(self, node: ast.expr | None, session: str | None) -> None:
        """Accounts for a call that goes to an address; on a session with a literal base the address may be a path."""
        if isinstance(node, ast.Call) and self.dotted(node.func) == "urllib.request.Request":
            words = {k.arg: k.value for k in node.keywords}
            node = words.get("url", node.args[0] if node.args else None)
        made = self.sessions.get(session, []) if session else []
        if made and all(any(k.arg == "base_url" for k in c.keywords) for c in made):
            try:
                if self.text(node)[0][:1] == "/":
                    return
            except Doubt:
                pass
        self.hosts |= self.places(node)

    def environment(self, node: ast.AST, name: ast.expr) -> None:
        column = self.column(name)
        if column is not None:
            if not column:
                raise Doubt
            self.names |= set(column)
        else:
            whole, _ = self.text(name)
            if isinstance(name, ast.JoinedStr | ast.BinOp):
                raise Doubt
            self.names.add(whole)
        self.believed.add(id(node))

    # --- the walk ---

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if self.dotted(node.value) == "os.environ":
            self.environment(node.value, node.slice)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        self.judge(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.judge(node)
        if isinstance(node.value, ast.Name):
            self.believed.add(id(node.value))  # a module's attribute is judged as a whole
        self.generic_visit(node)

    def judge(self, node: ast.Name | ast.Attribute) -> None:
        """A module, its environment or its senders as a value: where it goes is not seen."""
        whole = self.dotted(node)
        if id(node) in self.believed or whole is None:
            return
        root = whole.partition(".")[0]
        imported = isinstance(node, ast.Attribute) or node.id in self.aliases
        if imported and (whole in ("os", "os.environ", "os.environb", "os.getenv", "os.getenvb", "urllib", "urllib.request", "urllib.request.urlopen", "socket", *CLIENTS) or (root in CLIENTS and whole.rpartition(".")[2] in SENDERS)):
            raise Doubt

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            self.hosts |= {h.lower() for h in HOST.findall(node.value)}

    def visit_Expr(self, node: ast.Expr) -> None:
        if not isinstance(node.value, ast.Constant):  # a docstring does nothing
            self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        called = self.dotted(node.func) or ""
        shown = ast.unparse(node.func)
        owner, _, method = shown.rpartition(".")
        words = {k.arg: k.value for k in node.keywords}
        first = node.args[1:] if method in ("request", "stream") and len(node.args) > 1 else node.args
        address = words.get("url", first[0] if first else None)
        root = called.partition(".")[0]
        if called in ENVIRONMENT_READS or shown == "getenv":
            if not node.args:
                raise Doubt
            self.environment(node.func if called in ("os.getenv", "getenv") else node.func.value if isinstance(node.func, ast.Attribute) else node.func, node.args[0])
            self.believed.add(id(node.func))
        elif called in UNSEEN_CALLS:
            raise Doubt
        elif called.startswith("litellm.") or owner == "litellm":
            self.model_call(words)
        elif called in SESSIONS:
            if "base_url" in words:
                self.hosts |= self.places(words["base_url"])
        elif called == "urllib.request.urlopen" or (root in CLIENTS and called.count(".") == 1 and called.rpartition(".")[2] in SENDERS):
            self.believed.add(id(node.func))
            self.send_to(address, None)
        elif owner in self.sessions or (isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) and self.dotted(node.func.value.func) in SESSIONS):
            if method in SENDERS | SURE_SENDERS:
                self.send_to(address, owner)
        elif method == "urlopen" or (method in SENDERS and re.search(r"(?i)(client|session|http)$", owner)):
            self.send_to(address, owner)
        elif method in SURE_SENDERS and node.args and not (isinstance(node.args[0], ast.Constant) and str(node.args[0].value).startswith("/")):
            raise Doubt  # something unknown with a client's method; a route of a server has a path
        self.generic_visit(node)

    def model_call(self, words: dict) -> None:
        base = words.get("api_base", words.get("base_url"))
        if base is not None and not (isinstance(base, ast.Constant) and base.value is None):
            self.hosts |= self.places(base)
        if "fallbacks" in words or None in words or "model" not in words:
            raise Doubt
        column = self.column(words["model"])
        for model in [self.text(words["model"])[0]] if column is None else column:
            prefix = model.partition("/")[0]
            if prefix not in MODEL_HOSTS:
                raise Doubt
            self.hosts.add(prefix)


def _kept(names: set[str], hosts: set[str]) -> tuple[list[str], list[str]] | None:
    secrets = sorted(n for n in names if re.search(SECRETISH, n))
    hosts = sorted(h for h in hosts if h not in LOCAL and h not in INFRASTRUCTURE)
    return (secrets, hosts) if secrets and hosts else None


def profile(text: str) -> tuple[list[str], list[str]] | None:
    """(secret-looking names read, destinations) of a Python file, or None."""
    try:
        found = _File(ast.parse(text))
    except (Doubt, SyntaxError, ValueError, RecursionError):
        return None
    return _kept(found.names, found.hosts)


def script_profile(text: str) -> tuple[list[str], list[str]] | None:
    """The same of a JavaScript or TypeScript file."""
    found = script_findings(text)
    return _kept(*found) if found else None


def provider_profiles(lines: DataFrame) -> DataFrame:
    """(target, version, path, credentials, destinations) of files that read the environment and have a profile.

    For lines that are all there is; file_helpers.provider_profiles_in_files gives the same of file rows and moves none.
    """
    ext = file_extension(F.col("path"))
    code = lines.where(ext.isin(".py", *SCRIPTS))
    reading = code.where(F.col("text").contains("environ") | F.col("text").contains("getenv") | F.col("text").contains("process.env")).select(*FILE).distinct()

    def each(path: str, numbers: list[int], texts: list[str]) -> list[tuple]:
        found = (profile if path.lower().endswith(".py") else script_profile)("\n".join(texts))
        return [found] if found else []

    return of_whole_files(code.join(reading, FILE, "left_semi"), each, "credentials:array<string>,destinations:array<string>")


def provider_documented(profiles: DataFrame, docs: DataFrame) -> DataFrame:
    """(target, version, destination, label, documented): whether a line of the target's documents names each destination."""
    rows = profiles.select("target", "version", F.explode("destinations").alias("destination")).distinct()
    dotted = F.col("destination").contains(".")
    models = F.create_map(*[F.lit(x) for kv in MODEL_HOSTS.items() for x in kv])
    label = F.when(dotted, registrable_name(F.col("destination"))).otherwise(F.substring_index("destination", "_", 1))
    domain = F.when(dotted, F.substring_index("destination", ".", -2)).otherwise(models[F.col("destination")])
    rows = rows.withColumns({"label": label, "domain": domain})
    # Each line is split once: its words, and the ends of its dotted names, are met by equality.
    text, keys = F.lower("text"), ["target", "version"]
    dotted_names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0)), lambda x: F.array(x, F.substring_index(x, ".", -2), F.substring_index(x, ".", -3))))
    asked = docs.join(rows.select(*keys).distinct(), keys, "left_semi")
    said = asked.select(*keys, F.explode(F.array_distinct(F.concat(F.split(text, r"(?U)\W+"), dotted_names))).alias("word")).distinct()
    wanted = rows.select(*keys, "destination", "label", F.explode(F.array("label", "domain")).alias("word"))
    found = wanted.join(said, [*keys, "word"], "left_semi").select(*keys, "destination").distinct().withColumn("documented", F.lit(True))
    return rows.select(*keys, "destination", "label").join(found, [*keys, "destination"], "left").withColumn("documented", F.coalesce("documented", F.lit(False)))


def scope_provider_flows(flows: DataFrame, lines: DataFrame | None, docs: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """flows with provider_scope: set for environment-to-network flows of files whose keys are named for the
    documented, unsuspicious providers that they call, every one of them; null in any other case.

    profiles are those of the files if they are known already; else they are found in lines.
    """
    profiles = provider_profiles(lines) if profiles is None else profiles
    known = provider_documented(profiles, docs)
    bad = F.col("destination").isin(*SUSPICIOUS) | F.col("destination").rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    rows = profiles.withColumn("destination", F.explode("destinations")).join(known, ["target", "version", "destination"])
    files = rows.groupBy(*FILE).agg(F.bool_and(F.col("documented") & ~bad).alias("fine"), F.collect_set("label").alias("labels"), F.first("credentials").alias("credentials"), F.first("destinations").alias("destinations"))
    meets = lambda n, x: (F.length(x) >= 3) & (F.array_contains(F.split(F.upper(n), "_"), F.upper(x)) | F.upper(n).startswith(F.upper(x)))
    own = F.forall("credentials", lambda n: F.exists("labels", lambda x: meets(n, x)))
    files = files.where(F.col("fine") & own).select(*FILE, F.concat(F.lit("keys named for the documented providers called: "), F.array_join("destinations", ", ")).alias("scope"))
    out = flows.join(files, FILE, "left")
    return out.withColumn("provider_scope", F.when((F.col("source") == "environment.read") & F.col("sink").isin("network.external", "network.socket", "network.dns"), F.col("scope"))).drop("scope")
