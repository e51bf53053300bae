"""Hosts: extraction from text and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an address looks like, local hosts, and labels that stand before a country code.
URL = r"(https?)://([A-Za-z0-9._~-]+)(?::(\d+))?"
URL_WITH_PORT = r"https?://([A-Za-z0-9._~-]+(?::\d+)?)"
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0")
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov")

# Hosts of each kind.
INFRASTRUCTURE = ("registry.npmjs.org", "npmjs.com", "www.npmjs.com", "pypi.org", "files.pythonhosted.org", "crates.io", "proxy.golang.org", "sum.golang.org", "rubygems.org", "packagist.org", "github.com", "raw.githubusercontent.com", "objects.githubusercontent.com", "gitlab.com", "bitbucket.org", "codeload.github.com", "schemas.modelcontextprotocol.io", "static.modelcontextprotocol.io", "modelcontextprotocol.io", "spdx.org", "json-schema.org", "www.w3.org", "opensource.org", "creativecommons.org", "img.shields.io", "shields.io", "localhost", "127.0.0.1", "0.0.0.0", "example.com", "www.example.com", "example.org", "example.net", "docs.python.org", "nodejs.org", "developer.mozilla.org")
SUSPICIOUS = ("pastebin.com", "hastebin.com", "paste.ee", "ghostbin.com", "transfer.sh", "0x0.st", "file.io", "anonfiles.com", "termbin.com", "ngrok.io", "trycloudflare.com", "loca.lt", "serveo.net", "webhook.site", "requestbin.com", "pipedream.net", "requestcatcher.com", "beeceptor.com", "interact.sh", "oast.fun", "burpcollaborator.net", "canarytokens.com")
TELEMETRY = ("google-analytics.com", "www.google-analytics.com", "analytics.google.com", "sentry.io", "ingest.sentry.io", "segment.io", "api.segment.io", "mixpanel.com", "api.mixpanel.com", "amplitude.com", "api.amplitude.com", "posthog.com", "app.posthog.com", "bugsnag.com", "datadoghq.com")

# Hosts behind the prefixes of model names.
MODEL_HOSTS = {
    "openai": "api.openai.com", "anthropic": "api.anthropic.com", "groq": "api.groq.com", "mistral": "api.mistral.ai", "gemini": "generativelanguage.googleapis.com", "cerebras": "api.cerebras.ai", "cohere": "api.cohere.ai", "deepseek": "api.deepseek.com", "openrouter": "openrouter.ai",
    "together_ai": "api.together.xyz", "fireworks_ai": "api.fireworks.ai", "perplexity": "api.perplexity.ai", "xai": "api.x.ai", "nvidia_nim": "integrate.api.nvidia.com", "huggingface": "api-inference.huggingface.co", "replicate": "api.replicate.com", "sambanova": "api.sambanova.ai",
}


def purpose_tokens(purpose: Column) -> Column:
    """Words of more than two letters or digits."""
    return F.filter(F.split(F.lower(F.coalesce(purpose, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def registrable_name(host: Column) -> Column:
    """The label before the public suffix, roughly."""
    parts = F.split(F.lower(host), r"\.")
    n = F.size(parts)
    return F.when((n >= 3) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL), F.try_element_at(parts, F.lit(-3))).when(n >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(host)


def classify_host(host: Column, tokens: Column) -> Column:
    """SUSPICIOUS, UNEXPLAINED (telemetry), SUSPICIOUS (bare address), INFRASTRUCTURE, EXPECTED, else UNEXPLAINED."""
    return (
        F.when(host.isin(*SUSPICIOUS), "SUSPICIOUS")
        .when(host.isin(*TELEMETRY), "UNEXPLAINED")
        .when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "SUSPICIOUS")
        .when(host.isin(*INFRASTRUCTURE), "INFRASTRUCTURE")
        .when(F.array_contains(tokens, registrable_name(host)), "EXPECTED")
        .otherwise("UNEXPLAINED")
    )


def urls_in(text: Column) -> Column:
    """array<struct<scheme, host>> of the URLs of a line, in order; hosts lower, without trailing dots."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    pairs = F.transform(found, lambda u: F.struct(F.regexp_extract(u, URL, 1).alias("scheme"), F.regexp_replace(F.lower(F.regexp_extract(u, URL, 2)), r"\.+$", "").alias("host")))
    return F.filter(pairs, lambda p: (p["host"] != "") & (p["host"].contains(".") | (p["host"] == "localhost")))
