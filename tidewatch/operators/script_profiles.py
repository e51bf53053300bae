"""What a JavaScript or TypeScript file reads of the environment and where it sends to, by a bracket-matching scan.

The scan knows comments, strings and templates, and follows brackets. It believes string literals, constants bound once to
one, and entries of tables of literals. What it cannot account for - the environment as a whole, a computed address, a
sender as a value, sockets, other clients, quotes that do not close - gives nothing.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|\s+|.", re.S)
HOST = re.compile(r"https?://([A-Za-z0-9._~-]+)")
ENDED = re.compile(r"https?://([A-Za-z0-9._~-]+)(?=[/:?#])")
OPEN, CLOSE = "([{", ")]}"
METHODS = {"get", "post", "put", "patch", "delete", "head", "request"}
UNSEEN_NAMES = {"WebSocket", "XMLHttpRequest", "EventSource", "eval", "Function", "createConnection", "sendBeacon"}
UNSEEN_MODULES = {"net", "tls", "dgram", "dns", "http", "https", "http2", "ws", "undici", "got", "request", "superagent", "needle", "ky", "process"}


class Doubt(Exception):
    """Something that the source does not show."""


def tokens_of(text: str) -> list[str]:
    """Names, strings and signs; what stands in ${} of a template follows it in brackets."""
    out = []
    for t in TOKEN.findall(text):
        if t.isspace() or t.startswith(("//", "/*")):
            continue
        if t in "'\"`":
            raise Doubt
        out.append(t)
        if t[0] == "`" and "${" in t:
            for inner in re.findall(r"\$\{([^{}]*)\}", t):
                out += ["(", *tokens_of(inner), ")"]
            if t.count("${") != len(re.findall(r"\$\{[^{}]*\}", t)):
                raise Doubt
    return out


def is_text(t: str) -> bool:
    return t[0] in "'\"`"


class Script:
    def __init__(self, text: str) -> None:
        self.t = tokens_of(text)
        self.names: set[str] = set()
        self.hosts: set[str] = set()
        self.partner: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.t):
            if t in OPEN:
                stack.append(i)
            elif t in CLOSE:
                if not stack or OPEN.index(self.t[stack[-1]]) != CLOSE.index(t):
                    raise Doubt
                self.partner[stack.pop()] = i
        if stack:
            raise Doubt
        self.constants: dict[str, str] = {}
        self.tables: dict[str, tuple[int, int]] = {}
        self.entries: dict[str, str] = {}
        self.clients: dict[str, bool] = {"axios": False}
        self.declare()
        self.walk()

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def literal(self, t: str) -> str:
        return re.sub(r"\\(.)", r"\1", t[1:-1])

    def declare(self) -> None:
        """Constants, tables, entries taken from tables and clients made with a base address; a name bound twice is none of them."""
        bound: dict[str, int] = {}
        for i, t in enumerate(self.t):
            if t in ("const", "let", "var") and re.match(r"[A-Za-z_$]", self.at(i + 1)):
                bound[self.at(i + 1)] = bound.get(self.at(i + 1), 0) + 1
            if re.match(r"[A-Za-z_$]", t) and self.at(i + 1) == "=" and self.at(i + 2) not in ("=", ">") and self.at(i - 1) not in ("const", "let", "var", "."):
                bound[t] = bound.get(t, 0) + 2
        for i, t in enumerate(self.t):
            name, eq = self.at(i + 1), i + 2
            if t == "const" and name == "[" and self.partner.get(i + 1, -1) == i + 5 and self.at(i + 6) == "of":  # [key, entry] of Object.entries(TABLE)
                name, eq = self.at(i + 4), i + 6
                bound[name] = bound.get(name, 0) + 1
            if t != "const" or bound.get(name) != 1:
                continue
            if self.at(eq) == ":":  # a type up to the sign of equality
                eq = next((k for k in range(eq, min(eq + 30, len(self.t))) if self.t[k] == "="), eq)
            value = self.at(eq + 1)
            if self.at(eq) == "of" and value == "Object" and self.at(eq + 3) in ("values", "entries"):
                self.entries[name] = self.at(eq + 5)
            elif self.at(eq) == "=" and name.isupper() and is_text(value or " ") and "${" not in value and self.at(eq + 2) in (";", "", "const", "let", "export", "function", "import", "async", "class", "var"):
                self.constants[name] = self.literal(value)
            elif self.at(eq) == "=" and name.isupper() and value in ("{", "["):
                self.tables[name] = (eq + 1, self.partner[eq + 1])
            elif self.at(eq) == "=" and self.at(eq + 2) == "[" and value.isupper():
                self.entries[name] = value
            elif self.at(eq) == "=" and value == "axios" and self.at(eq + 3) == "create":
                self.clients[name] = any(self.t[k] == "baseURL" for k in range(eq + 4, self.partner.get(eq + 4, eq + 4)))

    def column(self, i: int) -> list[str] | None:
        """Values of entry.key, entry["key"], TABLE[x].key at place i."""
        if self.at(i) in self.entries:
            table, k = self.entries[self.at(i)], i + 1
        elif self.at(i) in self.tables and self.at(i + 1) == "[":
            table, k = self.at(i), self.partner[i + 1] + 1
        else:
            return None
        if table not in self.tables:
            return None
        key = self.at(k + 1) if self.at(k) == "." else self.literal(self.at(k + 1)) if self.at(k) == "[" and is_text(self.at(k + 1) or " ") else None
        if key is None:
            return None
        a, b = self.tables[table]
        out = []
        for n in range(a, b):
            if (self.t[n] == key or (is_text(self.t[n]) and self.literal(self.t[n]) == key)) and self.at(n + 1) == ":":
                if not is_text(self.at(n + 2) or " ") or "${" in self.at(n + 2) or self.at(n + 3) not in (",", "}"):
                    raise Doubt
                out.append(self.literal(self.at(n + 2)))
        if not out:
            raise Doubt
        return out

    def places(self, a: int, b: int) -> set[str]:
        """Hosts of the address in tokens a to b."""
        if self.at(a) == "new" and self.at(a + 1) == "URL" and self.at(a + 2) == "(":
            parts = self.arguments(a + 2)
            return self.places(*parts[-1]) if parts else self.doubt()
        column = self.column(a)
        if column is not None:
            found = [HOST.match(x) for x in column]
        else:
            t, alone = self.at(a), b == a + 1
            if t in self.constants:
                whole, sure = self.constants[t], alone
            elif t and t[0] == "`" and "${" in t:
                lead = re.match(r"`\$\{(\w+)\}", t)
                whole = (self.constants.get(lead[1], "") + t[lead.end() : -1] if lead else t[1:-1]).partition("${")[0]
                sure = False
            elif t and is_text(t):
                whole, sure = self.literal(t), alone
            else:
                raise Doubt
            if not sure and self.at(a + 1) == "+" and is_text(self.at(a + 2) or " "):
                whole += self.literal(self.at(a + 2)).partition("${")[0]
            found = [(HOST if sure else ENDED).match(whole)]
        if not all(found):
            raise Doubt
        return {f[1].lower() for f in found}

    def doubt(self) -> set[str]:
        raise Doubt

    def arguments(self, i: int) -> list[tuple[int, int]]:
        """Token ranges of the arguments in the bracket at i."""
        end, out, a, k = self.partner[i], [], i + 1, i + 1
        while k < end:
            if k in self.partner:
                k = self.partner[k]
            elif self.t[k] == ",":
                out.append((a, k))
                a = k + 1
            k += 1
        return [*out, (a, end)] if a < end else out

    def send(self, i: int, base: bool) -> None:
        parts = self.arguments(i)
        if not parts:
            raise Doubt
        a, b = parts[0]
        if self.at(a) == "{":  # a request as an object: its url
            url = next((k for k in range(a, b) if self.t[k] == "url" and self.at(k + 1) == ":"), None)
            if url is None:
                raise Doubt
            a = url + 2
            b = next((k for k in range(a, b) if self.t[k] in (",", "}")), b)
        if base and is_text(self.at(a) or " ") and self.at(a)[1:2] == "/":
            return
        self.hosts |= self.places(a, b)

    def environment(self, i: int) -> None:
        """process.env at i: a read of one name, or names that are taken out of it."""
        after = i + 3
        if self.at(after) == "." and re.match(r"[A-Za-z_$]", self.at(after + 1)):
            self.names.add(self.at(after + 1))
        elif self.at(after) == "[":
            a, b = after + 1, self.partner[after]
            column = self.column(a)
            if column is not None:
                self.names |= set(column)
            elif b == a + 1 and is_text(self.at(a)) and "${" not in self.at(a):
                self.names.add(self.literal(self.at(a)))
            elif b == a + 1 and self.at(a) in self.constants:
                self.names.add(self.constants[self.at(a)])
            else:
                raise Doubt
        elif self.at(i - 1) == "=" and self.at(i - 2) == "}":
            start = next(a for a, b in self.partner.items() if b == i - 2)
            for a, b in self.arguments(start):
                if self.at(a) == "." or not re.match(r"[A-Za-z_$]", self.at(a)):
                    raise Doubt
                self.names.add(self.at(a))
        else:
            raise Doubt

    def walk(self) -> None:
        for i, t in enumerate(self.t):
            before, after = self.at(i - 1), self.at(i + 1)
            if is_text(t):
                self.hosts |= {h.lower() for h in HOST.findall(t)}
                module = self.literal(t).removeprefix("node:").partition("/")[0]
                if module in UNSEEN_MODULES and (before in ("from", "import") or (before == "(" and self.at(i - 2) in ("require", "import"))):
                    raise Doubt
                continue
            if before == "." and self.at(i - 2) not in (".", "globalThis", "window", "self"):  # two points before: it is spread
                if t in UNSEEN_NAMES - {"Function"}:
                    raise Doubt
                continue
            if t == "process":
                if after != ".":
                    raise Doubt
                if self.at(i + 2) == "env":
                    self.environment(i)
            elif t in UNSEEN_NAMES or (t in ("Deno", "Bun") and after == "."):
                raise Doubt
            elif t == "meta" and self.at(i - 2) == "import":
                raise Doubt
            elif t == "fetch" and after != ":":
                if before == "import" or self.at(i + 1) == "from":
                    continue
                if after != "(":
                    raise Doubt
                self.send(i + 1, False)
            elif t in self.clients and before not in ("const", "import", "{", ","):
                if after == "(":
                    self.send(i + 1, self.clients[t])
                elif after == "." and self.at(i + 2) in METHODS and self.at(i + 3) == "(":
                    self.send(i + 3, self.clients[t])
                elif after == "." and self.at(i + 2) == "create" and self.at(i + 3) == "(":
                    for k in range(i + 4, self.partner[i + 3]):
                        if self.t[k] == "baseURL":
                            self.hosts |= self.places(k + 2, next((n for n in range(k + 2, self.partner[i + 3]) if self.t[n] in (",", "}")), k + 3))
                elif after != "." and after != "from":
                    raise Doubt


def script_findings(text: str) -> tuple[set[str], set[str]] | None:
    """(names read of the environment, hosts) of a file, or None."""
    try:
        found = Script(text)
    except (Doubt, RecursionError, StopIteration, KeyError):
        return None
    return found.names, found.hosts
