"""Checks of input at the edge of the API, and as predicates over columns."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_QUERY, MAX_NAME, MAX_TAG, MAX_VERSION, MAX_URL = 1_000, 100, 50, 50, 2_048
# Signs that a query must not hold, hosts and ports that are never fetched.
FORBIDDEN = re.compile(r"[;'\"\\]|--|/\*|\*/")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata.azure.com")
BLOCKED_PORTS = (22, 23, 25, 110, 135, 139, 445, 3389)


def query(text: str) -> str:
    """A search query without tags and surrounding white space; raises if it's empty, too long or holds forbidden signs."""
    if not text or len(text) > MAX_QUERY:
        raise ValueError("a query has 1 to 1000 characters")
    plain = re.sub(r"<[^>]+>", "", text)
    if FORBIDDEN.search(plain):
        raise ValueError("forbidden signs in the query")
    return plain.strip()


def name(text: str, limit: int = MAX_NAME) -> str:
    if not text or len(text) > limit or not re.fullmatch(r"[a-zA-Z0-9._-]+", text):
        raise ValueError("a name has letters, digits, dots, underscores and hyphens")
    return text


def tag(text: str) -> str:
    return name(text)[:MAX_TAG]


def version(text: str) -> str:
    if text in ("latest", "stable") or re.fullmatch(r"\d+\.\d+\.\d+(-[a-zA-Z0-9.-]+)?", text or "") and len(text) <= MAX_VERSION:
        return text
    raise ValueError("a version is latest, stable or three numbers")


def document_id(value) -> int:
    number = int(value)
    if number <= 0:
        raise ValueError("an id is positive")
    return number


def _ends_in(host: str, domains: list[str]) -> bool:
    return any(host == d.lower() or host.endswith("." + d.lower()) for d in domains)


def url(text: str, allowed: list[str] | None = None, blocked: list[str] | None = None) -> str:
    """A URL that may be fetched; raises for other schemes, local, private or blocked hosts and ports."""
    if len(text) > MAX_URL:
        raise ValueError("a URL has at most 2048 characters")
    parts = urlparse(text)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host or ".." in host:
        raise ValueError("a URL has http or https and a host")
    if host in LOCAL_HOSTS or host in METADATA_HOSTS:
        raise ValueError("the host is local")
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        address = None
    if address is not None and not address.is_global:
        raise ValueError("the address is private or reserved")
    if allowed and not _ends_in(host, allowed) or blocked and _ends_in(host, blocked):
        raise ValueError("the host isn't allowed")
    if parts.port in BLOCKED_PORTS:
        raise ValueError("the port isn't allowed")
    return text


def fetchable(column: Column, blocked: list[str] | None = None) -> Column:
    """The same as a predicate over URLs, without the ranges of addresses but the private ones."""
    host = F.lower(F.regexp_extract(column, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    port = F.regexp_extract(column, r"^https?://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]+):(\d+)", 1)
    private = host.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)")
    ok = (F.length(column) <= MAX_URL) & (host != "") & ~host.isin(*LOCAL_HOSTS, *METADATA_HOSTS) & ~private & ~port.isin(*map(str, BLOCKED_PORTS)) & ~F.contains(host, F.lit(".."))
    for domain in blocked or []:
        ok = ok & (host != domain.lower()) & ~host.endswith("." + domain.lower())
    return F.coalesce(ok, F.lit(False))


def without_escapes(column: Column) -> Column:
    """Text without ANSI sequences and control characters other than line breaks and tabs."""
    return F.regexp_replace(F.regexp_replace(column, r"\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
