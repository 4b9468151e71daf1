"""Endpoint settings: where they come from, which one a chain has, and what of them must not be shown."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

#: What documentation puts where a value belongs.
PLACEHOLDERS = {"your_key_here", "your-key-here", "changeme", "todo", "xxx", "<key>", "your_rpc_url_here", "https://", "<url>"}
#: Characters from which a part of an address may be a credential.
SECRET = 8


class MissingEndpoint(Exception):
    """No endpoint is set: a fault of the configuration, not of a provider."""


def env_lines(text: str) -> dict[str, str]:
    """``NAME=value`` lines; comments and empty values go, one quote at each end too."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().partition("=")
        if equals and name.strip() and not name.startswith("#"):
            value = re.sub(r"^[\"']|[\"']$", "", value.strip())
            if value:
                out[name.strip()] = value
    return out


class Settings:
    """Layers of names and values; the first layer with a usable value counts. Placeholders are no values."""

    def __init__(self, *layers: Mapping[str, str]):
        self.layers = layers

    @classmethod
    def of_process(cls, path: str | Path | None = None) -> Settings:
        """The environment, then a file of lines; a file that is missing or can't be read is empty."""
        try:
            text = Path(path).read_text() if path else ""
        except OSError:
            text = ""
        return cls(os.environ, env_lines(text))

    def names(self) -> list[str]:
        return list(dict.fromkeys(n for layer in self.layers for n in layer))

    def get(self, name: str) -> str | None:
        values = ((layer.get(name) or "").strip() for layer in self.layers)
        return next((v for v in values if v and v.lower() not in PLACEHOLDERS), None)

    def urls(self) -> Iterable[str]:
        return (v for n in self.names() if (n == "RPC_URL" or n.startswith("RPC_URL_")) and (v := self.get(n)))


def url_variable(chain: str) -> str:
    return "RPC_URL_" + re.sub("[^A-Z0-9]", "_", chain.upper())


def own_url(chain: str, settings: Settings) -> str | None:
    """The chain's address, else the one for all chains."""
    return settings.get(url_variable(chain)) or settings.get("RPC_URL")


def has_endpoint(settings: Settings) -> bool:
    return bool(settings.get("RPC_TEMPLATE") or any(settings.urls()))


def rpc_url(chain: str, settings: Settings) -> str:
    """An own address before one of RPC_TEMPLATE, in which ``{chain}`` and ``{key}`` stand for the chain and for RPC_KEY."""
    if url := own_url(chain, settings):
        return url
    if not (template := settings.get("RPC_TEMPLATE")):
        raise MissingEndpoint(f"set RPC_URL, {url_variable(chain)} or RPC_TEMPLATE")
    return template.replace("{chain}", chain).replace("{key}", settings.get("RPC_KEY") or "")


def provider_label(chain: str, settings: Settings) -> str:
    """Who answers, without a credential."""
    host = urlsplit(rpc_url(chain, settings)).netloc.rpartition("@")[2]
    return f"RPC {host}" if host else "RPC custom endpoint"


def secrets(settings: Settings) -> list[str]:
    """Addresses, keys, passwords, and long parts of paths and queries; the longest first, so no part of one survives."""
    found = set(filter(None, [settings.get("RPC_KEY")]))
    for url in settings.urls():
        parts = urlsplit(url)
        found |= {url} | {p for p in [*parts.path.split("/"), *(v for _, v in parse_qsl(parts.query))] if len(p) >= SECRET}
        if parts.password:
            found.add(parts.password)
    return sorted(found, key=lambda s: (-len(s), s))


def scrub(text: str, settings: Settings) -> str:
    for secret in secrets(settings):
        text = text.replace(secret, "***")
    return text
