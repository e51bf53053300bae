"""The rule catalogue as data. Add rules by passing CATALOGUE plus your own to match_rules()."""

from __future__ import annotations

from typing import NamedTuple

PY = (".py",)
JS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx")
PY_JS = PY + JS
ANY: tuple[str, ...] = ()


class Rule(NamedTuple):
    rule_id: str
    pattern: str
    title: str
    severity: str
    confidence: str
    extensions: tuple[str, ...] = ANY
    capability: str | None = None
    role: str | None = None
    informational: bool = False


# Ids, patterns, ratings, capabilities and roles of the rules, in catalogue order. The titles are our own.
CATALOGUE: tuple[Rule, ...] = (
    Rule("source.shell_true", r"(?:[(,]|^)\s*shell\s*=\s*True\b", "Runs a child process by way of a shell", "HIGH", "HIGH", PY, "shell.execute", "exec"),
    Rule("source.os_system", r"\bos\.system\s*\(|^\s*from\s+os\s+import\b[^#\n]*\bsystem\b|__import__\(\s*['\"]os['\"]\s*\)\s*\.\s*system\b", "Hands a command string to the shell with os.system", "HIGH", "HIGH", PY, "shell.execute", "exec"),
    Rule("source.os_popen", r"\bos\.popen\s*\(|^\s*from\s+os\s+import\b[^#\n]*\bpopen\b|__import__\(\s*['\"]os['\"]\s*\)\s*\.\s*popen\b", "Hands a command string to the shell with os.popen", "HIGH", "HIGH", PY, "shell.execute", "exec"),
    Rule("source.subprocess", r"\bsubprocess\.(?:run|call|check_call|check_output|Popen)\s*\(", "Starts other programs", "MEDIUM", "HIGH", PY, "process.spawn", "exec"),
    Rule("source.node_exec", r"(?:\bchild_process\s*\.\s*|\brequire\(\s*['\"](?:node:)?child_process['\"]\s*\)\s*\.\s*|\b(?:cp|childProcess|child|proc)\s*\.\s*|(?<![\w$.]))exec(?:Sync)?\s*\(", "Runs a command string in a shell from Node", "HIGH", "MEDIUM", JS, "shell.execute", "exec"),
    Rule("source.node_spawn", r"\bspawn(?:Sync)?\s*\(|\bexecFile(?:Sync)?\s*\(", "Starts other programs from Node", "MEDIUM", "MEDIUM", JS, "process.spawn", "exec"),
    Rule("source.python_eval", r"(?<![\w.])eval\s*\(", "Evaluates an expression given as text", "HIGH", "MEDIUM", PY, "code.eval", "exec"),
    Rule("source.python_exec", r"(?<![\w.])exec\s*\(", "Executes statements given as text", "HIGH", "MEDIUM", PY, "code.eval", "exec"),
    Rule("source.js_function_ctor", r"new\s+Function\s*\(|(?<![\w.])eval\s*\(", "Makes code from text while running", "HIGH", "MEDIUM", JS, "code.eval", "exec"),
    Rule("source.dynamic_import", r"__import__\s*\(|importlib\.import_module\s*\(", "Chooses what to import while running", "MEDIUM", "MEDIUM", PY, "code.dynamic_import"),
    Rule("source.pickle_load", r"\bpickle\.loads?\s*\(|\bmarshal\.loads\s*\(", "Loads pickled or marshalled objects", "HIGH", "MEDIUM", PY, "code.eval"),
    Rule("source.curl_pipe_shell", r"(?:curl|wget)[^\n|;]{0,200}\|\s*(?:sudo\s+)?(?:ba|z|d)?sh", "Feeds a download directly to a shell", "CRITICAL", "HIGH", ANY, "code.remote_execution", "exec"),
    Rule("source.fs_read", r"\bopen\s*\(|\.read_text\s*\(|\.read_bytes\s*\(|readFileSync?\s*\(|fs\.promises\.readFile", "Opens files for reading", "INFO", "MEDIUM", PY_JS, "filesystem.read", "source", True),
    Rule("source.fs_write", r"\.write_text\s*\(|\.write_bytes\s*\(|writeFileSync?\s*\(|fs\.promises\.writeFile|\bopen\s*\([^)\n]{0,120}[\"'][wax]", "Creates or changes files", "LOW", "MEDIUM", PY_JS, "filesystem.write", None, True),
    Rule("source.fs_delete", r"shutil\.rmtree\s*\(|\bos\.remove\s*\(|\bos\.unlink\s*\(|fs\.rmSync\s*\(|fs\.unlinkSync?\s*\(|rm\s+-rf\b", "Removes files or folders", "MEDIUM", "MEDIUM", ANY, "filesystem.delete"),
    Rule("source.chmod_exec", r"chmod\s+(?:-R\s+)?(?:[ugoa]*\+[rwst]*x|0?[0-7]?[0-7](?:[1357][0-7]|[0-7][1357])\b)|chmod(?:Sync)?\s*\([^)\n]{0,80}?(?<![\w.])(?<!&)(?<!&\s)(?:0o|0)?[0-7]?[0-7](?:[1357][0-7]|[0-7][1357])\b|chmod(?:Sync)?\s*\([^)\n]{0,80}?['\"][0-7]?[0-7](?:[1357][0-7]|[0-7][1357])['\"]|chmod(?:Sync)?\s*\([^)\n]{0,80}?\bS_I(?:EXEC|XUSR|XGRP|XOTH|RWXG|RWXO)\b", "Gives a file the right to run", "MEDIUM", "MEDIUM", ANY, "filesystem.chmod"),
    Rule("source.http_client", r"\brequests\.(?:get|post|put|patch|delete|request)\s*\(|\bhttpx2?\.(?:get|post|put|patch|delete|request|stream|AsyncClient|Client)\s*\(|\baiohttp\.(?:ClientSession|request)\s*\(|urllib\.request\.urlopen\s*\(|\bfetch\s*\(|\baxios\.|\bgot\s*\(|http\.request\s*\(", "Sends HTTP requests", "INFO", "HIGH", PY_JS, "network.external", "sink", True),
    Rule("source.llm_api_call", r"\blitellm\.a?(?:completion|text_completion|embedding|image_generation|image_edit|speech|transcription|responses|rerank|moderation)\s*\(", "Sends prompts to a hosted model by litellm", "INFO", "HIGH", PY, "network.external", "sink", True),
    Rule("source.raw_socket", r"socket\.socket\s*\(|net\.createConnection\s*\(|new\s+WebSocket\s*\(", "Talks over sockets of its own", "MEDIUM", "MEDIUM", PY_JS, "network.socket", "sink"),
    Rule("source.dns_exfil_shape", r"socket\.gethostbyname\s*\(|dns\.(?:resolve|lookup)\s*\(", "Looks up host names by DNS", "LOW", "LOW", PY_JS, "network.dns", "sink"),
    Rule("source.env_read", r"\bos\.environ\b|\bos\.getenv\s*\(|\bprocess\.env\b|\bENV\[", "Looks at the environment", "INFO", "HIGH", PY_JS, "environment.read", "source", True),
    Rule("source.ssh_key_access", r"\.ssh/id_[a-z0-9_]+|\.ssh/authorized_keys|id_rsa\b|known_hosts\b", "Names SSH keys or their folder", "HIGH", "MEDIUM", ANY, "credentials.ssh", "source"),
    Rule("source.cloud_credentials", r"\.aws/credentials|AWS_SECRET_ACCESS_KEY|\.config/gcloud|AZURE_CLIENT_SECRET|\.kube/config", "Names where cloud credentials lie", "HIGH", "MEDIUM", ANY, "credentials.cloud", "source"),
    Rule("source.browser_secrets", r"Login\s+Data\b|cookies\.sqlite|Local\s+State\b|key4\.db|logins\.json", "Names a browser's password or cookie files", "CRITICAL", "MEDIUM", ANY, "credentials.browser", "source"),
    Rule("source.netrc_access", r"\.netrc\b|_netrc\b", "Names the netrc password file", "HIGH", "MEDIUM", ANY, "credentials.netrc", "source"),
    Rule("source.keychain_access", r"\bsecurity\s+find-generic-password\b|\bkeyring\.get_password\s*\(|libsecret", "Asks the system's key store", "HIGH", "MEDIUM", ANY, "credentials.keychain", "source"),
    Rule("source.base64_decode", r"b64decode\s*\(|base64\.b64decode|\batob\s*\(|Buffer\.from\s*\([^)\n]{0,80}base64", "Unpacks base64 while running", "INFO", "HIGH", PY_JS, "encoding.base64", None, True),
    Rule("source.hex_decode", r"bytes\.fromhex\s*\(|codecs\.decode\s*\([^)\n]{0,60}hex", "Unpacks hexadecimal text while running", "LOW", "MEDIUM", PY, "encoding.hex"),
    Rule("source.reversed_string_call", r"\[::-1\]\s*\)|split\(['\"]{2}\)\.reverse\(\)\.join", "Turns strings around before use", "LOW", "LOW", PY_JS),
    Rule("source.cron_persistence", r"\bcrontab\b|/etc/cron\.|\bschtasks\b", "Touches scheduled jobs", "HIGH", "MEDIUM", ANY, "persistence.scheduler"),
    Rule("source.startup_persistence", r"\.bashrc\b|\.zshrc\b|\.bash_profile\b|LaunchAgents|systemctl\s+enable|/etc/systemd/system", "Touches what starts with a shell or the system", "HIGH", "MEDIUM", ANY, "persistence.startup"),
    Rule("source.package_install", r"\bpip\s+install\b|\bnpm\s+(?:i|install)\b|\buv\s+pip\s+install\b|\bpipx\s+install\b", "Installs packages while running", "MEDIUM", "MEDIUM", ANY, "package.install"),
)


def checked(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """rules, if no two of them share an id."""
    ids = [r.rule_id for r in rules]
    if twice := {i for i in ids if ids.count(i) > 1}:
        raise ValueError(f"rule ids used twice: {sorted(twice)}")
    return tuple(rules)


# Capabilities that carry data out, and what a newly gained capability is rated.
OUTBOUND = ("network.external", "network.socket", "network.dns")
ESCALATION = {
    "shell.execute": "HIGH", "code.eval": "HIGH", "code.remote_execution": "CRITICAL", "credentials.ssh": "CRITICAL", "credentials.cloud": "CRITICAL",
    "credentials.browser": "CRITICAL", "credentials.netrc": "HIGH", "credentials.keychain": "HIGH", "persistence.startup": "HIGH", "persistence.scheduler": "HIGH",
    "process.spawn": "MEDIUM", "network.external": "MEDIUM", "network.socket": "MEDIUM", "environment.read": "MEDIUM", "filesystem.write": "LOW",
    "filesystem.delete": "MEDIUM", "package.install": "MEDIUM",
}
# Severity and wording of a sensitive read near an outbound call.
EXFIL_WORTHY = {
    "environment.read": ("HIGH", "environment variables"), "credentials.ssh": ("CRITICAL", "SSH key material"), "credentials.cloud": ("CRITICAL", "cloud credentials"),
    "credentials.browser": ("CRITICAL", "browser credential stores"), "credentials.netrc": ("CRITICAL", ".netrc credentials"), "credentials.keychain": ("CRITICAL", "OS keychain secrets"),
    "filesystem.read": ("MEDIUM", "local files"),
}
