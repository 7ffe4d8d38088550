"""URL normalisation, hosts and titles, as native expressions over the parts of RFC 3986."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of RFC 3986, appendix B, with a strict scheme.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@dataclass(frozen=True)
class UrlRules:
    """What normalisation does."""

    default_scheme: str = "https"
    strip_fragment: bool = True
    lowercase_host: bool = True
    drop_trailing_slash: bool = True


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def normalize_url(url: Column, rules: UrlRules = UrlRules()) -> Column:  # noqa: B008
    """One form for equal URLs; null for blank ones and those without a host, which nothing can fetch."""
    own = F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    scheme, authority, path, query, fragment = (_part(own, n) for n in range(1, 6))
    scheme = F.when(scheme == "", F.lit(rules.default_scheme)).otherwise(F.lower(scheme))
    if rules.lowercase_host:  # user information keeps its case
        at = F.instr(authority, "@")
        authority_out = F.concat(F.substring(authority, F.lit(1), at), F.lower(F.substring(authority, at + 1, F.length(authority))))
    else:
        authority_out = authority
    path = F.when(path == "", F.lit("/")).otherwise(path)
    if rules.drop_trailing_slash:
        path = F.when((path != "/") & F.endswith(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    out = F.concat(scheme, F.lit("://"), authority_out, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    if not rules.strip_fragment:
        out = F.concat(out, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    return F.when(authority != "", out)


def host(url: Column) -> Column:
    """The lower-cased host without user information and port; empty if there is none."""
    server = F.regexp_replace(_part(F.coalesce(url, F.lit("")), 2), r"^.*@", "")
    return F.lower(F.when(F.startswith(server, F.lit("[")), F.regexp_extract(server, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(server, r":.*$", "")))


def host_allowed(name: Column, domains: Column) -> Column:
    """Whether the host is one of an array of domains or below one."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (low != "") & F.exists(domains, lambda d: (low == F.lower(d)) | F.endswith(low, F.concat(F.lit("."), F.lower(d))))


def unquoted(url: Column) -> Column:
    """Percent escapes decoded; plus signs and malformed escapes stay."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def title_key(title: Column) -> Column:
    """A page title as it stands in a URL and in link tables."""
    return F.replace(title, F.lit(" "), F.lit("_"))


def page_url(domain: Column, title: Column) -> Column:
    """The address of a wiki page: all but letters, digits and ( ) _ : - . ~ percent-encoded."""
    coded = F.url_encode(title_key(title))
    for escape, plain in (("%28", "("), ("%29", ")"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A"), ("+", "%20")):
        coded = F.replace(coded, F.lit(escape), F.lit(plain))
    return F.concat(F.lit("https://"), domain, F.lit("/wiki/"), coded)


def dump_name(project: Column, resource: Column) -> Column:
    """The file name of a table dump; null for resources with other characters than a-z, 0-9 and _."""
    return F.when(resource.rlike("^[a-z0-9_]+$"), F.concat(project, F.lit("-latest-"), resource, F.lit(".sql.gz")))
