"""A crawl's configuration, checked when it is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """The configuration is wrong; the message says where."""


@dataclass(frozen=True)
class CrawlConfig:
    start_url: str = ""
    max_depth: int = 2
    max_pages: int = 50
    concurrency: int = 5
    per_origin_limit: int = 2
    min_interval_ms: int = 200
    timeout_ms: int = 10000
    max_response_bytes: int = 1_000_000
    retry_count: int = 2
    retry_base_delay_ms: int = 500
    respect_robots: bool = True
    user_agent: str = "SkeinBot/1.0"
    max_duration_ms: int | None = None
    max_total_attempts: int | None = None
    max_url_length: int = 2048
    max_path_depth: int = 16
    max_segment_repeats: int = 2
    dedupe_content: bool = True
    respect_canonical: bool = True

    def __post_init__(self):
        from skein.functions import weburl

        if not isinstance(self.start_url, str) or not self.start_url:
            raise ConfigError("startUrl is required")
        if weburl.canonical_key(self.start_url) is None:
            raise ConfigError("startUrl must be an http or https URL without userinfo")
        rules = {"a non-negative integer": "max_depth min_interval_ms retry_count retry_base_delay_ms", "a boolean": "respect_robots dedupe_content respect_canonical",
                 "null or a positive integer": "max_duration_ms max_total_attempts",
                 "a positive integer": "max_pages concurrency per_origin_limit timeout_ms max_response_bytes max_url_length max_path_depth max_segment_repeats"}
        kind = {name: rule for rule, names in rules.items() for name in names.split()}
        for field in fields(self):
            rule, value = kind.get(field.name), getattr(self, field.name)
            whole = isinstance(value, int) and not isinstance(value, bool)
            right = {"a non-negative integer": whole and value >= 0, "a positive integer": whole and value > 0, "a boolean": isinstance(value, bool),
                     "null or a positive integer": value is None or whole and value > 0, None: True}[rule]
            if not right:
                raise ConfigError(f"{camel(field.name)} must be {rule}")
        if not isinstance(self.user_agent, str) or not self.user_agent:
            raise ConfigError("userAgent must be a non-empty string")
        if re.search(r"[\x00-\x1f\x7f]", self.user_agent):
            raise ConfigError("userAgent must not contain control characters")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def from_options(options: dict) -> CrawlConfig:
    """From a dict with the keys in camel case; unknown keys are refused."""
    known = {camel(f.name): f.name for f in fields(CrawlConfig)}
    for key in options:
        if key not in known:
            raise ConfigError(f"Unknown config key: {key}")
    return CrawlConfig(**{known[k]: v for k, v in options.items()})
