"""Indicators of compromise as column functions: what a text holds, not whether it is malicious."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number up to 255 without leading zeros, and an address of four. It is no part of a word or of a longer row of numbers; a port, a bracket or a stop may follow.
_BYTE = r"(?:\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])"
IPV4 = rf"\b(?<!\d\.){_BYTE}(?:\.{_BYTE}){{3}}\b(?!\.\d)"
#: A host name (RFC 1123): labels of 63 letters, digits and inner hyphens at most, the last of letters. Not the host of an e-mail address.
_LABEL = r"(?!-)[A-Za-z\d-]{1,63}(?<!-)"
DOMAIN = rf"(?<!@)\b(?:{_LABEL}\.)+[A-Za-z]{{2,63}}\b"
#: What a URL may hold (RFC 3986) but the apostrophe.
URL = r"(?i)https?://[a-z\d._~:/?#\[\]@!$&()*+,;=%-]+"
HEX_RUN = r"(?<![A-Fa-f\d])[A-Fa-f\d]{32,64}(?![A-Fa-f\d])"
#: Hexadecimal digits of MD5, SHA-1 and SHA-256.
HASH_LENGTHS = [32, 40, 64]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
#: Endings of names that are files or units, not domains.
NOT_DOMAINS = ["so", "dll", "exe", "bin", "service", "socket", "target", "conf", "cfg", "ini", "json", "log", "txt", "xml", "yaml", "yml"]


def valid_ipv4(c: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^(0|[1-9]\d{0,2})$") & (p.cast("int") <= 255))


def private_ipv4(c: Column) -> Column:
    """Private, loopback, link-local, this-network, documentation, benchmark and reserved ranges."""
    p = [F.get(F.split(c, r"\."), F.lit(k)).try_cast("int") for k in range(4)]
    three = lambda a, b, d: (p[0] == a) & (p[1] == b) & (p[2] == d)
    return (
        p[0].isin(0, 10, 127)
        | ((p[0] == 172) & p[1].between(16, 31))
        | ((p[0] == 192) & (p[1] == 168))
        | ((p[0] == 169) & (p[1] == 254))
        | ((p[0] == 198) & p[1].isin(18, 19))
        | three(192, 0, 0)
        | three(192, 0, 2)
        | three(198, 51, 100)
        | three(203, 0, 113)
        | (p[0] >= 240)
    )


#: Labels that end an organisation's name and so begin no host of two labels, and those of libraries and programs.
TOP, PROGRAMS = ["org", "com", "net", "edu"], ["so", "dll", "exe"]


def plausible_domain(c: Column) -> Column:
    """A host name of 253 characters at most that is no file, library version (``libc.so.6.x``) or package (``org.name``)."""
    parts = F.split(F.lower(c), r"\.")
    package = (F.size(parts) == 2) & F.element_at(parts, 1).isin(TOP)
    return (F.size(parts) >= 2) & (F.length(c) <= 253) & ~F.element_at(parts, -1).isin(NOT_DOMAINS) & ~F.arrays_overlap(parts, F.array(*map(F.lit, PROGRAMS))) & ~package


#: What a command holds that starts another one, or hands it a script.
STARTERS = [" -e ", " --exec", " /bin/sh", " /bin/bash", " /bin/zsh", "powershell", "cmd.exe", "nc -", "ncat ", "socat ", "python -c", "perl -e", "ruby -e", "bash -c", "sh -c", "| /bin/", "&& /bin/", "; /bin/"]


def starts_others(context: Column) -> Column:
    """Whether a row's texts show that its process ran something else: only then is a process an indicator and not just a name."""
    text = F.concat(F.lit(" "), F.lower(context), F.lit(" "))
    return F.exists(F.array(*map(F.lit, STARTERS)), lambda s: text.contains(s))


def _all(pattern: str):
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


#: kind -> column function that lists a text's values of that kind.
INDICATORS = {
    "ipv4": _all(IPV4),
    "url": lambda c: F.transform(_all(URL)(c), lambda u: F.regexp_replace(u, r"[.,;:)\]}]+$", "")),
    "hash": lambda c: F.transform(F.filter(_all(HEX_RUN)(c), lambda h: F.length(h).isin(HASH_LENGTHS)), F.lower),
    "domain": lambda c: F.transform(F.filter(_all(DOMAIN)(c), plausible_domain), F.lower),
    "email": lambda c: F.transform(_all(EMAIL)(c), F.lower),
    "cve": lambda c: F.transform(_all(CVE)(c), F.upper),
}
