"""Host parsing and validation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions.text import strip
from wardlight.lexicon import TWO_PART_SUFFIXES

# Shapes and limits of acceptable names.
SCHEME = r"^[a-z][a-z0-9+.-]*://"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_LIKE = rf"(?:^|[.-]){OCTET}(?:[.-]{OCTET}){{3}}(?:$|[.-])"
IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
LABEL = (r"^[a-z0-9\x{a1}-\x{ffff}]"
         r"(?:[a-z0-9\x{a1}-\x{ffff}-]{0,61}[a-z0-9\x{a1}-\x{ffff}])?$")
TLD = r"^(?:xn--[a-z0-9-]+|[a-z\x{a1}-\x{ffff}]{2,})$"
AUTHORITY = (r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#]*@)?"
             r"(\[[^/?#]*|[^/?#:]*)")
URL_HOST = (r"^\s*https?://(?:[^/?#\\]*@)?"
            r"(?!localhost\.?(?:[:/?#\\]|$)|127\.|\[?::1\]?\.?(?:[:/?#\\]|$)"
            r"|[^/?#\\:]*\.local(?:host)?\.?(?:[:/?#\\]|$))"
            r"(\[[^\]/?#\\]*\]|[^/?#\\:]*)")
PARTS = (r"^(?:(.*?)\.)??([^.]*)\.(" + "|".join(s.replace(".", r"\.") for s in TWO_PART_SUFFIXES)
         + r"|[^.]+)$")
MAX_DOMAIN_LENGTH = 253


def before_any(col: Column, separators: str) -> Column:
    """The part in front of the first occurrence of any separator."""
    for sep in separators:
        col = F.substring_index(col, sep, 1)
    return col


def normalize_host(raw: Column) -> Column:
    """Bare lower-case host of a domain or URL; total, never fails."""
    text = F.lower(strip(F.coalesce(raw, F.lit(""))))
    return F.btrim(F.regexp_extract(text, AUTHORITY, 1), F.lit("."))


def match_key(domain: Column) -> Column:
    """Lookup form for the curated list: one leading ``www.`` removed."""
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def url_host(url: Column) -> Column:
    """Host of an http(s) URL worth analysing, else the empty string."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), URL_HOST, 1), r"\.$", "")


def last_two_labels(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def default_parts(host: Column) -> dict[str, Column]:
    """Subdomain, second-level name and suffix by the built-in suffix list."""
    return {"subdomain": F.regexp_extract(host, PARTS, 1),
            "sld": F.when(host.contains("."), F.regexp_extract(host, PARTS, 2)).otherwise(host),
            "tld": F.regexp_extract(host, PARTS, 3)}


def split_parts(host: Column, two_part: Column) -> dict[str, Column]:
    """The same three parts, given whether the last two labels are a suffix."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    wide = two_part & (labels >= 3)
    tail = F.when(wide, F.substring_index(host, ".", -3)).otherwise(last_two_labels(host))
    single = labels < 2
    tld = F.when(single, "").when(wide, last_two_labels(host)).otherwise(
        F.substring_index(host, ".", -1))
    sld = F.when(single, host).otherwise(F.substring_index(tail, ".", 1))
    rest = F.length(host) - F.length(tail) - 1
    sub = F.when(single | (rest <= 0), "").otherwise(F.substring(host, F.lit(1), rest))
    return {"subdomain": sub, "sld": sld, "tld": tld}


def registrable(host: Column, sld: Column, tld: Column) -> Column:
    return F.when((sld != "") & (tld != ""), F.concat_ws(".", sld, tld)).otherwise(host)


def requested_domain(raw: Column) -> Column:
    """Normalisation applied to API requests (user info goes before the path)."""
    text = F.regexp_replace(F.lower(strip(raw)), SCHEME, "")
    text = before_any(F.substring_index(text, "@", -1), "/?#:")
    return F.rtrim(strip(text), F.lit("."))


def domain_error(raw: Column, clean: Column) -> Column:
    """Why a request is unusable (first failing rule), or null."""
    odd = F.get(F.filter(F.split(clean, r"\."), lambda l: (l == "") | ~l.rlike(LABEL)), F.lit(0))
    return (
        F.when(raw.isNull(), "not_string")
        .when(strip(raw) == "", "empty")
        .when(clean == "", "empty_after_normalization")
        .when(F.length(clean) > MAX_DOMAIN_LENGTH, "too_long")
        .when(clean.rlike(IPV4), "ip_address")
        .when(~clean.contains("."), "no_dot")
        .when(odd == "", "empty_label")
        .when(odd.isNotNull(), "bad_label")
        .when(~F.substring_index(clean, ".", -1).rlike(TLD), "bad_tld")
    )
