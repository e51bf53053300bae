"""What a finding means and what to do about it, in our own words, by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beginning of a rule's id -> (explanation, remediation); the longest that fits counts.
ADVICE: dict[str, tuple[str, str]] = {
    "source.": ("The code has a construct that deserves a look.", "Read the lines shown and decide whether the tool needs them."),
    "source.shell_true": ("A shell reads the whole string, so anything put into it may become a command.", "Pass a list of arguments and leave the shell out."),
    "source.os_": ("A shell reads the whole string, so anything put into it may become a command.", "Use subprocess with a list of arguments."),
    "source.subprocess": ("Other programs run with the rights of the server.", "Check which programs these are and where their arguments come from."),
    "source.node_": ("Other programs run with the rights of the server.", "Prefer execFile with a fixed program and a list of arguments."),
    "source.python_e": ("Text turns into code, so who controls the text controls the server.", "Parse the data instead, for example with ast.literal_eval or JSON."),
    "source.js_function_ctor": ("Text turns into code, so who controls the text controls the server.", "Parse the data instead."),
    "source.dynamic_import": ("What is loaded depends on data that a reader of the code does not see.", "Import from a fixed list of names."),
    "source.pickle_load": ("Loading such data can run any code that its author put in.", "Use a format without code, as JSON."),
    "source.curl_pipe_shell": ("Whatever the other side sends today is run, unseen.", "Download, check a digest, then run."),
    "source.fs_": ("The server touches files.", "Check that the paths stay within a folder of its own."),
    "source.chmod_exec": ("A file is made runnable, often one that was just fetched.", "Find out what the file is and where it comes from."),
    "source.raw_socket": ("Traffic over own sockets escapes most reviews of requests.", "Check who is at the other end."),
    "source.dns_exfil_shape": ("Names that are made up while running can carry data out.", "Check what the looked-up names hold."),
    "source.ssh_key_access": ("SSH keys open other machines.", "A tool that does not manage keys has no business there."),
    "source.cloud_credentials": ("Cloud credentials open the whole account.", "Give the tool a role of its own instead."),
    "source.browser_secrets": ("These files hold saved passwords and sessions.", "Do not install without an explanation by the author."),
    "source.netrc_access": ("The file holds passwords in plain text.", "Give the tool a token of its own instead."),
    "source.keychain_access": ("The key store holds secrets of other programs.", "Check that only the tool's own entry is read."),
    "source.hex_decode": ("Encoded data hides what it says.", "Decode it by hand and read it."),
    "source.reversed_string_call": ("Turned-around strings hide what they say.", "Turn them back and read them."),
    "source.cron_persistence": ("A scheduled job outlives the server.", "Check that the tool has to schedule anything at all."),
    "source.startup_persistence": ("What starts with the shell or the system outlives the server.", "Check that the tool has to start on its own."),
    "source.package_install": ("Packages that are fetched while running were never reviewed.", "Declare them as dependencies with fixed versions."),
    "source.unanalyzed": ("Source files were not read, so nothing is known about them.", "Read these files by hand."),
    "source.file_limit_reached": ("There are more files than were read, so nothing is known about the rest.", "Audit again with a higher limit."),
    "combo.decode_then_execute": ("Decoding and running code in one project is how payloads are hidden.", "Decode what is there and read it before you install."),
    "combo.runtime_package_install": ("The server can fetch and run new code at any time.", "Declare dependencies instead."),
    "dataflow.": ("Something sensitive is read close to where data leaves.", "Follow the value from the first line shown to the second."),
    "network.suspicious_destination": ("Such hosts take data from anyone and are a usual way out.", "Ask why the tool has to talk to them."),
    "network.cleartext_http": ("Anyone on the way can read and change the traffic.", "Use https."),
    "injection.": ("A model reads this text and may follow it.", "Read the text as the model would; do not connect the tool if it gives orders."),
    "annotations.": ("Clients may skip their question to the user on the word of such a hint.", "Treat the tool as if it had no hint."),
    "install.remote_script_execution": ("Installing runs whatever the other side sends.", "Download, read, then run."),
    "install.setup_py_executes": ("Installing runs code of the package.", "Read setup.py, or install a wheel."),
    "install.dockerfile_binary_download": ("The image holds a program that nobody reviewed.", "Pin a digest."),
    "dependencies.install_scripts": ("Installing runs these scripts.", "Install with scripts turned off."),
    "dependencies.non_registry_source": ("Such sources can change without a new version.", "Depend on a published version."),
    "dependencies.unpinned": ("Tomorrow's install may fetch other code than today's.", "Fix the versions or commit a lockfile."),
    "diff.": ("The new version can do or wants more than the old one.", "Compare the change with the release notes before you upgrade."),
    "popularity.": ("The numbers do not look like slow growth by users.", "Do not count stars as trust."),
    "trust.": ("The repository's own state gives reason to be careful.", "Weigh who maintains it, and how."),
    "provenance.": ("What is published and what was audited may not be the same.", "Compare the registry entry with the repository."),
}


def with_advice(findings: DataFrame) -> DataFrame:
    """findings with explanation and remediation, by the longest known beginning of their rule's id."""
    fits = [F.when(F.col("rule_id").startswith(k), F.struct(F.lit(why).alias("explanation"), F.lit(what).alias("remediation"))) for k, (why, what) in sorted(ADVICE.items(), key=lambda x: -len(x[0]))]
    return findings.withColumn("a", F.coalesce(*fits)).withColumns({"explanation": F.col("a.explanation"), "remediation": F.col("a.remediation")}).drop("a")
