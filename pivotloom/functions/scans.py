"""Scans of text for indicators, credentials and commands, and small string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings by which text is taken for a host's name: the generic ones of RFC 1591, those of the
#: year 2000, and some of countries. A parameter of `sensitive_tld` and `indicators`.
ENDINGS = ("com", "edu", "gov", "int", "mil", "net", "org", "arpa", "aero", "biz", "coop", "info", "museum", "name", "pro", "at", "br", "ch", "de", "es", "eu", "fr", "in", "it", "jp", "nl", "pl", "se", "uk", "us")
#: Programs and phrases of `commands`; a caller has lists of their own.
TOOLS = ("nmap", "masscan", "sqlmap", "nikto", "hydra", "hashcat", "mimikatz", "netcat")
PHRASES = ("bind shell", "reverse shell", "buffer overflow", "privilege escalation", "remote code execution")


def indicators(endings: tuple[str, ...] = ENDINGS) -> dict[str, str]:
    """Patterns of addresses, names, digests and vulnerability numbers."""
    return {
        "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
        "url": r"https?://[^\s<>\"]+",
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "domain": r"\b(?:[a-z0-9-]+\.)+(?:" + "|".join(endings) + r")\b",
        "sha256": r"\b[a-f0-9]{64}\b",
        "md5": r"\b[a-f0-9]{32}\b",
        "cve": r"CVE-[0-9]{4}-[0-9]{4,7}",
    }


def commands(tools: tuple[str, ...] = TOOLS, phrases: tuple[str, ...] = PHRASES) -> dict[str, str]:
    """Patterns of lines that run something: an interpreter with a flag, a download, a rule's head, named tools and phrases."""
    return {
        "interpreter": r"(?i)\b(?:ba|z|k|da)?sh\s+-[a-z]|\b(?:python3?|perl|ruby|node|pwsh)\s+-[a-z]",
        "download": r"(?i)\b(?:curl|wget|invoke-webrequest)\s+[^\s.,;]",
        "rule_head": r"\brule\s+[A-Za-z_][A-Za-z0-9_]{0,127}\s*(?::[\sA-Za-z0-9_]+)?\{",
        "tool": r"(?i)\b(?:" + "|".join(tools) + r")\b",
        "phrase": r"(?i)\b(?:" + "|".join(phrases) + r")\b",
    }


INDICATORS = indicators()
COMMANDS = commands()
# Beginnings and lengths of tokens as their vendors publish them.
CREDENTIALS = {
    "cloud_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "map_key": r"\bAIza[A-Za-z0-9_-]{35}",
    "code_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}",
    "chat_token": r"\bxox(?:b|p|a|r|s|e)-[A-Za-z0-9-]{10,}",
    "token": r"token = \"[0-9a-f]{40}\"",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "password": r"password=[^\s]{8,}",
}
#: What a text must hold for a pattern to be tried at all.
GUARDS = {
    "url": "http", "email": "@", "cve": "CVE-", "cloud_key": "IA", "map_key": "AIza", "code_token": "gh", "chat_token": "xox", "token": "token = ", "private_key": "PRIVATE KEY", "password": "password=",
}
#: Credentials that say themselves that they are none.
REDACTED = r"(?i)example|redacted|placeholder|changeme|x{6,}|\*{4,}"
# Networks for documentation (RFC 5737) and names for special use (RFC 2606, RFC 6761).
DOCUMENTATION_NETS = ("192.0.2.", "198.51.100.", "203.0.113.")
SPECIAL_DOMAINS = ("example.com", "example.net", "example.org", "test", "invalid", "localhost", "example")


def counts_as_find(kind: Column, value: Column) -> Column:
    """Addresses and names for documentation, and redacted credentials, are no finds."""
    net, redacted = F.lit(False), value.rlike(REDACTED)
    for start in DOCUMENTATION_NETS:
        net = net | F.startswith(value, F.lit(start))
    return (
        F.when(kind == "ipv4", ~net).when(kind == "domain", ~special_use(value))
        .when(kind.isin(*CREDENTIALS), ~redacted).otherwise(True)
    )


def sensitive_tld(host: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    return F.substring_index(host, ".", -1).isin(*endings) & (F.instr(host, ".") > 0)


def extract(rows: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, kind, value of every match, one pass over the text."""
    found = F.flatten(F.array(*[_matches(text, k, p) for k, p in patterns.items()]))
    return rows.select(F.col(key), F.explode(found).alias("m")).select(key, "m.kind", "m.value")


def _matches(text: str, kind: str, pattern: str) -> Column:
    every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    if kind in GUARDS:
        every = F.when(F.contains(F.col(text), F.lit(GUARDS[kind])), every).otherwise(F.array().cast("array<string>"))
    return F.transform(every, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def flags(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [text.rlike(p).alias(k) for k, p in patterns.items()]


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def placeholder_hex(value: Column) -> Column:
    """Repeated units of 1 to 8 digits, or nothing but runs of four and more."""
    return value.rlike(r"^(.{1,8})\1+$") | value.rlike(r"^((.)\2{3,})+$")


def special_use(host: Column) -> Column:
    out = F.lit(False)
    for name in SPECIAL_DOMAINS:
        out = out | (host == name) | F.endswith(host, F.lit("." + name))
    return out


def literal_path(path: Column) -> Column:
    """No empty, dot or parent segment, no control character or backslash."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return ~path.rlike(r"[\x00-\x1f\x7f\\]") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def offset_timestamp(text: Column) -> Column:
    """Whether a text is a timestamp with an offset that names a real instant."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return shape & F.try_to_timestamp(text).isNotNull()


def canonical_digest(json: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys."""
    return F.sha2(F.to_json(F.parse_json(json)), 256)


def pointer_path(pointer: str) -> str:
    """A JSON pointer as a JSON path."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)
