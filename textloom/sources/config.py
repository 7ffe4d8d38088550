"""Settings: a YAML file, checked and turned into frozen records."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

from textloom.functions.url import UrlRules


class ConfigError(ValueError):
    """A setting is missing or has the wrong form."""


def environment(name: str) -> str:
    """The value of an environment variable that must be set."""
    value = os.environ.get(name, "")
    if not value:
        raise ConfigError(f"the environment variable {name} is not set")
    return value


def read_yaml(path: str) -> dict[str, Any]:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            root = yaml.safe_load(f)
    except OSError as e:
        raise ConfigError(f"{path} cannot be read: {e}") from e
    if not isinstance(root, dict) or not root:
        raise ConfigError(f"{path} must hold an object")
    return root


def section(root: dict[str, Any], name: str) -> dict[str, Any]:
    """A part that must be an object; absent ones are empty."""
    value = root.get(name)
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError(f"{name} must be an object")
    return value


def _positive(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ConfigError(f"{name} must be a positive whole number")
    return value


@dataclass(frozen=True)
class Source:
    name: str
    allowed_domains: tuple[str, ...]

    @property
    def domain(self) -> str:
        return self.allowed_domains[0]


@dataclass(frozen=True)
class Recrawl:
    enabled: bool = True
    revisit_after_hours: float = 168.0
    only_if_changed: bool = True
    use_etag: bool = True
    use_last_modified: bool = True
    use_content_hash: bool = True


@dataclass(frozen=True)
class Http:
    retries: int = 3
    backoff_sec: float = 2.0
    max_redirects: int = 5
    max_response_bytes: int = 25 << 20
    #: Requests of one URL that a host may turn away as too many, and the wait if it names none.
    too_many_retries: int = 3
    too_many_wait_sec: float = 15.0


@dataclass(frozen=True)
class Bootstrap:
    projects: tuple[str, ...] = ()
    resources: tuple[str, ...] = ("page", "categorylinks", "linktarget")
    seed_category: str = ""
    max_depth: int = 1
    download_dumps: bool = True
    import_dumps: bool = True
    export_seeds: bool = True


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    recrawl: Recrawl = field(default_factory=Recrawl)
    http: Http = field(default_factory=Http)
    urls: UrlRules = field(default_factory=UrlRules)
    bootstrap: Bootstrap = field(default_factory=Bootstrap)
    max_unique_docs: int = 32000
    max_per_source: int = 28000
    checkpoint_every: int = 50
    shuffle: bool = True
    shuffle_seed: int = 42


def parse(root: dict[str, Any]) -> Config:
    """A checked configuration; absent settings keep their defaults."""
    sources = []
    for entry in root.get("sources") or []:
        domains = tuple(str(d).strip().lower() for d in (entry or {}).get("allowed_domains") or [] if str(d).strip())
        if not isinstance(entry, dict) or not entry.get("name") or not domains:
            raise ConfigError("each source needs a name and allowed_domains")
        sources.append(Source(str(entry["name"]), domains))
    if not sources:
        raise ConfigError("sources must not be empty")
    logic, http, rules, boot, seeds = (section(root, n) for n in ("logic", "http", "normalization", "bootstrap", "seeds"))
    if str(seeds.get("format", "tsv")).lower() != "tsv":
        raise ConfigError("seeds.format must be tsv")
    recrawl = section(logic, "recrawl")
    change = section(recrawl, "change_detection")
    retries = section(http, "retries")
    resources = tuple(boot.get("dump_resources") or Bootstrap.resources)
    if bad := [r for r in resources if not re.fullmatch("[a-z0-9_]+", str(r))]:
        raise ConfigError(f"bad dump resources: {bad}")
    return Config(
        tuple(sources),
        Recrawl(
            bool(recrawl.get("enabled", True)),
            float(recrawl.get("revisit_after_hours", 168)),
            bool(recrawl.get("only_if_changed", True)),
            bool(change.get("use_etag", True)),
            bool(change.get("use_last_modified", True)),
            bool(change.get("use_content_hash", True)),
        ),
        Http(int(retries.get("count", 3)), float(retries.get("backoff_sec", 2)), int(http.get("max_redirects", 5)), int(float(http.get("max_response_mb", 25)) * (1 << 20))),
        UrlRules(str(rules.get("default_scheme", "https")), bool(rules.get("strip_fragment", True)), bool(rules.get("lowercase_host", True)), bool(rules.get("drop_trailing_slash", True))),
        Bootstrap(
            tuple(str(p).strip() for p in boot.get("wiki_projects") or []),
            resources,
            str(boot.get("seed_category", "")).strip(),
            int(boot.get("max_depth", 1)),
            bool(boot.get("download_dumps", True)),
            bool(boot.get("import_dumps", True)),
            bool(boot.get("export_seeds", True)),
        ),
        _positive(logic.get("max_unique_docs", 32000), "logic.max_unique_docs"),
        _positive(seeds.get("max_per_source", 28000), "seeds.max_per_source"),
        _positive(section(logic, "checkpoint").get("flush_every_n", 50), "logic.checkpoint.flush_every_n"),
        bool(seeds.get("shuffle", True)),
    )
