"""Pieces of DuckDB SQL used by the checking queries."""

from __future__ import annotations

from wardlight import lexicon as L

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
SCHEME = "^[a-z][a-z0-9+.-]*://"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_LIKE = rf"(?:^|[.-]){OCTET}(?:[.-]{OCTET}){{3}}(?:$|[.-])"


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def host(x: str) -> str:
    bare = (f"split_part(split_part(split_part(split_part(regexp_replace(lower(trim(coalesce({x}, ''), {WS})),"
            f" '{SCHEME}', ''), '/', 1), '?', 1), '#', 1), '@', -1)")
    return f"trim(CASE WHEN starts_with({bare}, '[') THEN {bare} ELSE split_part({bare}, ':', 1) END, '.')"


def parts(source: str, keep: str = "*", host_col: str = "host") -> str:
    """SELECT adding subdomain, sld and tld to a relation with a host."""
    return f"""SELECT {keep},
      CASE WHEN n < 2 THEN '' ELSE array_to_string(l[1:n - k], '.') END AS subdomain,
      CASE WHEN n < 2 THEN {host_col} ELSE l[n - k + 1] END AS sld,
      CASE WHEN n < 2 THEN '' ELSE array_to_string(l[n - k + 2:n], '.') END AS tld
      FROM (SELECT *, CASE WHEN n >= 3 AND list_contains({words(L.TWO_PART_SUFFIXES)}, array_to_string(l[n-1:n], '.'))
                 THEN 3 ELSE 2 END AS k
            FROM (SELECT *, string_split({host_col}, '.') AS l, len(string_split({host_col}, '.')) AS n FROM {source}))"""


def entropy(x: str) -> str:
    chars = f"string_split({x}, '')"
    p = f"len(list_filter({chars}, lambda q: q = ch))::DOUBLE / length({x})"
    return (f"CASE WHEN {x} = '' THEN 0.0 ELSE round(abs(list_sum(list_transform(list_distinct({chars}),"
            f" lambda ch: ({p}) * log2({p})))), 9) END::DOUBLE")


def count_class(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"


def count_words(x: str, items) -> str:
    return f"len(list_filter({words(items)}, lambda w: contains({x}, w)))"


def structural(source: str, keep: str, names=L.TOP_BRANDS) -> str:
    """SELECT of the thirty features from a relation with host and parts."""
    safe = "greatest(length(sld), 1)"
    hay = "CASE WHEN subdomain = '' THEN sld ELSE subdomain || '.' || sld END"
    digits, letters = count_class("host", r"\p{Nd}"), count_class("host", r"\p{L}")
    dist = f"CASE WHEN sld = '' THEN 99 ELSE list_min(list_transform({words(names)}, lambda w: levenshtein(replace(sld, 'ü', '~'), w))) END"

    def ratio(a, b=safe):
        return f"round(({a})::DOUBLE / ({b}), 9)"

    return f"""SELECT {keep},
      length(host)::INT AS domain_length, length(sld)::INT AS sld_length, tld,
      list_contains({words(L.SUSPICIOUS_TLDS)}, tld)::INT AS tld_is_suspicious,
      {count_class('host', '.')}::INT AS num_dots, {count_class('host', '-')}::INT AS num_hyphens,
      {digits}::INT AS num_digits, {ratio(digits)} AS digit_ratio, {entropy('sld')} AS entropy,
      {ratio(count_class('sld', 'aeiou'))} AS vowel_ratio,
      {ratio(count_class('sld', 'bcdfghjklmnpqrstvwxyz'))} AS consonant_ratio,
      coalesce(list_max(list_transform(regexp_extract_all(sld, '[bcdfghjklmnpqrstvwxyz]+'), lambda r: length(r))), 0)::INT AS longest_consonant_run,
      CASE WHEN sld = '' THEN 0 ELSE len(list_distinct(string_split(sld, ''))) END::INT AS num_unique_chars,
      {ratio("length(sld) - CASE WHEN sld = '' THEN 0 ELSE len(list_distinct(string_split(sld, ''))) END")} AS char_repeat_ratio,
      regexp_matches(host, '{IP_LIKE}')::INT AS has_ip_in_name,
      (len(list_filter(string_split(host, '.'), lambda q: starts_with(q, 'xn--'))) > 0)::INT AS is_punycode,
      CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END::INT AS num_subdomains,
      starts_with(host, 'www.')::INT AS has_www, regexp_matches(sld, '^\\p{{Nd}}+$')::INT AS sld_is_numeric,
      ({count_words(hay, L.PHISHING_KEYWORDS)} > 0)::INT AS contains_phishing_keyword,
      {count_words(hay, L.PHISHING_KEYWORDS)}::INT AS num_phishing_keywords,
      ({count_words('sld', L.TOP_BRANDS)} > 0)::INT AS contains_brand_name,
      ({count_words('subdomain', L.TOP_BRANDS)} > 0 AND {count_words('sld', L.TOP_BRANDS)} = 0)::INT AS brand_in_subdomain,
      ({dist})::INT AS typosquat_distance, ({dist} BETWEEN 1 AND 2)::INT AS is_typosquat_candidate,
      {ratio(count_class('sld', '0-9a-f'))} AS hex_ratio,
      length(regexp_replace(host, '[\\p{{L}}\\p{{N}}.-]', '', 'g'))::INT AS num_special_chars,
      {entropy("replace(subdomain, '.', '')")} AS subdomain_entropy, length(tld)::INT AS tld_length,
      {ratio(digits, f'{letters} + 1')} AS ratio_digits_to_letters FROM {source}"""
