import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardlight import lexicon
from wardlight.operators.lexical import structural_features
from wardlight.operators.parse import hosts_from_urls, split_domain, validate_domains
from wardlight.operators import typosquat
from wardlight.operators.typosquat import nearest_popular, typosquat_candidates
from wardlight.schemas import STRUCTURAL_FEATURES

CASES = [
    ("sub.example.com", "domain_length", 15), ("example.com", "sld_length", 7), ("a.b.example.com", "num_dots", 3),
    ("pay-pal-secure.com", "num_hyphens", 2), ("abc123.com", "num_digits", 3), ("abc123.com", "digit_ratio", 0.5),
    ("a.b.example.com", "num_subdomains", 2), ("example.com", "num_subdomains", 0), ("google.com", "tld_length", 3),
    ("secure.info", "tld_length", 4), ("aeiou.com", "vowel_ratio", 1), ("aeiou.com", "consonant_ratio", 0),
    ("bcdfg.com", "consonant_ratio", 1), ("bcdfg.com", "longest_consonant_run", 5), ("aaaa.com", "num_unique_chars", 1),
    ("aaaa.com", "char_repeat_ratio", 0.75), ("aaaa.com", "entropy", 0), ("google.com", "ratio_digits_to_letters", 0),
    ("google.com", "subdomain_entropy", 0), ("google.com", "num_special_chars", 0), ("abcdef.com", "hex_ratio", 1),
    ("192-168-0-1.com", "has_ip_in_name", 1), ("a1-2-3-4.com", "has_ip_in_name", 0), ("google.com", "has_ip_in_name", 0),
    ("xn--pypal-4ve.com", "is_punycode", 1), ("www.example.com", "has_www", 1), ("example.com", "has_www", 0),
    ("12345.com", "sld_is_numeric", 1), ("google.com", "sld_is_numeric", 0), ("free-prize.xyz", "tld_is_suspicious", 1),
    ("google.com", "tld_is_suspicious", 0), ("secure-login.com", "contains_phishing_keyword", 1),
    ("secure-login.com", "num_phishing_keywords", 2), ("google.com", "num_phishing_keywords", 0),
    ("paypal-login.com", "contains_brand_name", 1), ("randomsite123.com", "contains_brand_name", 0),
    ("paypal.attacker-site.com", "brand_in_subdomain", 1), ("google.com", "typosquat_distance", 0),
    ("google.com", "is_typosquat_candidate", 0), ("gooogle.com", "is_typosquat_candidate", 1),
    ("zzqwvblkxmpq12345.com", "is_typosquat_candidate", 0), ("co.uk", "tld", "uk"), ("bbc.co.uk", "tld", "co.uk"),
    ("x" * 200 + ".com", "typosquat_distance", 99), ("", "typosquat_distance", 99), ("[::1]:443/x", "num_special_chars", 5),
]


def test_literal_cases(spark):
    df = spark.createDataFrame(sorted({(c[0],) for c in CASES}), "domain string")
    got = {r["domain"]: r for r in structural_features(df).collect()}
    for domain, feature, want in CASES:
        assert got[domain][feature] == want, (domain, feature, got[domain][feature])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def bits(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def plain_features(host):
    """A separate row-wise statement of the features for plain ASCII hosts."""
    labels = host.split(".")
    n = 3 if len(labels) >= 3 and ".".join(labels[-2:]) in lexicon.TWO_PART_SUFFIXES else 2
    if len(labels) < 2:
        sub, sld, tld = "", host, ""
    else:
        sub, sld, tld = ".".join(labels[:-n]), labels[-n], ".".join(labels[len(labels) - n + 1:])
    size, digits = max(len(sld), 1), sum(c.isdigit() for c in host)
    text = sub + "." + sld if sub else sld
    words = sum(w in text for w in lexicon.PHISHING_KEYWORDS)
    brand = any(b in sld for b in lexicon.TOP_BRANDS)
    near = min([99] + [edit_distance(sld, b) for b in lexicon.TOP_BRANDS]) if sld else 99
    runs = re.findall("[bcdfghjklmnpqrstvwxyz]+", sld)
    octet = "(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
    return dict(
        domain_length=len(host), sld_length=len(sld), tld=tld, tld_is_suspicious=int(tld in lexicon.SUSPICIOUS_TLDS),
        num_dots=host.count("."), num_hyphens=host.count("-"), num_digits=digits, digit_ratio=digits / size,
        entropy=bits(sld), vowel_ratio=sum(c in "aeiou" for c in sld) / size,
        consonant_ratio=sum(c.isalpha() and c not in "aeiou" for c in sld) / size,
        longest_consonant_run=max(map(len, runs), default=0), num_unique_chars=len(set(sld)),
        char_repeat_ratio=(len(sld) - len(set(sld))) / size,
        has_ip_in_name=int(bool(re.search(rf"(^|[.-]){octet}([.-]{octet}){{3}}($|[.-])", host))),
        is_punycode=int(any(p.startswith("xn--") for p in labels)), num_subdomains=len(sub.split(".")) if sub else 0,
        has_www=int(host.startswith("www.")), sld_is_numeric=int(sld.isdigit()), contains_phishing_keyword=int(words > 0),
        num_phishing_keywords=words, contains_brand_name=int(brand),
        brand_in_subdomain=int(any(b in sub for b in lexicon.TOP_BRANDS) and not brand), typosquat_distance=near,
        is_typosquat_candidate=int(near in (1, 2)), hex_ratio=sum(c in "0123456789abcdef" for c in sld) / size,
        num_special_chars=sum(not (c.isalnum() or c in ".-") for c in host), subdomain_entropy=bits(sub.replace(".", "")),
        tld_length=len(tld), ratio_digits_to_letters=digits / (sum(c.isalpha() for c in host) + 1))


def random_hosts(n):
    rng = random.Random(7)
    pieces = lexicon.TOP_BRANDS + lexicon.PHISHING_KEYWORDS + ["xn--", "www", "a", "zz9", "10-0-0-1", "77", "b_c", "q!"]
    tlds = ["com", "xyz", "co.uk", "com.au", "uk", "de", "top", "1a"]
    return sorted({".".join(rng.choice(pieces) + rng.choice(["", "-", str(rng.randrange(99))]) + rng.choice(pieces)
                            for _ in range(rng.randrange(1, 4))) + "." + rng.choice(tlds) for _ in range(n)})


def test_against_row_wise_statement(spark):
    hosts = random_hosts(600)
    rows = structural_features(spark.createDataFrame([(h,) for h in hosts], "domain string")).collect()
    assert len(rows) == len(hosts)
    for r in rows:
        want = plain_features(r["domain"])
        for name in STRUCTURAL_FEATURES:
            if isinstance(want[name], float):
                assert r[name] == pytest.approx(want[name], abs=1e-9), (r["domain"], name)
            else:
                assert r[name] == want[name], (r["domain"], name)


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame([(h,) for h in random_hosts(100)], "domain string")
    results = [sorted(map(str, structural_features(df.repartition(n)).collect())) for n in (1, 4, 64)]
    assert results[0] == results[1] == results[2]


def test_popular_list_paths_agree(spark):
    names = [f"brand{i}x{i * 7 % 13}" for i in range(3000)]
    popular = spark.createDataFrame([(n,) for n in names], "name string")
    df = spark.createDataFrame([(s,) for s in ["brand5x9", "brnd77x6", "zzz", "", "brand12"] * 3], "sld string")
    small = nearest_popular(df, popular, literal_limit=5000).collect()
    long = nearest_popular(df, popular, literal_limit=10).collect()
    assert sorted(map(str, small)) == sorted(map(str, long)) and len(small) == 15
    for r in small:
        want = (min((edit_distance(r["sld"], n), n) for n in names)) if r["sld"] else (99, None)
        assert (r["typosquat_distance"], r["similar_domain"]) == want


def test_long_popular_list_compares_few_pairs(spark, monkeypatch):
    """Typos, far names, names without a common character, lengths from 1 to 120: equal to all pairs, few compared."""
    rng = random.Random(1)
    word = lambda of, sizes: "".join(rng.choice(of) for _ in range(rng.choice(sizes)))
    names = sorted({word("abcdefghijklmnopqrstuvwxyz0-", [3, 6, 8, 9, 10, 11, 14]) for _ in range(4000)})
    typos = [n[:3] + "x" + n[4:] for n in names[:300]] + [n[1:] for n in names[300:500]]
    odd = [word("abcdefghijklmnopqrstuvwxyz0-é", [1, 2, 3, 7, 40, 120]) for _ in range(60)] + ["", None, "ÿÿÿ", "ÿ" * 12, *names[5:8]]
    popular = spark.createDataFrame([(n,) for n in names], "name string")
    compared, plain = [], typosquat.gram_candidates

    def counted(slds, pop, size):
        found = plain(slds, pop, size)
        compared.append(found.count())
        return found

    def listed(slds, pop):
        found = by_length(slds, pop)
        compared.append(found.select(F.sum(F.size("_names"))).first()[0] or 0)
        return found

    by_length = typosquat.length_candidates
    monkeypatch.setattr(typosquat, "gram_candidates", counted)
    monkeypatch.setattr(typosquat, "length_candidates", listed)
    for slds, share in ((typos, 0.06), (odd, 0.9)):
        compared.clear()
        df = spark.createDataFrame([(s,) for s in slds], "sld string")
        got = nearest_popular(df, popular, literal_limit=10).collect()
        assert sorted(map(str, got)) == sorted(map(str, nearest_popular(df, popular, literal_limit=10**6).collect()))
        assert sum(compared) <= share * len(names) * len(slds)
    few = spark.createDataFrame([("bbbb",), ("ccccccc",)], "name string")
    df = spark.createDataFrame([("a",), ("aaaaa",), ("aaaaaaaaa",)], "sld string")
    got = {r["sld"]: (r["typosquat_distance"], r["similar_domain"]) for r in nearest_popular(df, few, literal_limit=1).collect()}
    assert got == {"a": (4, "bbbb"), "aaaaa": (5, "bbbb"), "aaaaaaaaa": (9, "bbbb")}


def test_candidates_match_all_pairs(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)})
    left, right = words[:50], words[30:]
    got = typosquat_candidates(spark.createDataFrame([(w,) for w in left], "sld string"),
                               spark.createDataFrame([(w,) for w in right], "name string")).collect()
    want = {(a, b, edit_distance(a, b)) for a in left for b in right if 1 <= edit_distance(a, b) <= 2}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_url_hosts_and_validation(spark):
    urls = {"https://A.Example.COM.:8443/x?q#f": "a.example.com", "http://user:p@w.org/": "w.org", "ftp://a.com/": None,
            "http://localhost:3000/": None, "http://localhostess.com/": "localhostess.com", "http://printer.local": None,
            "http://x.localhost/": None, "http://127.0.0.1/": None, "http://127.evil.com/": None, "http://[::1]/": None,
            "about:blank": None, "HTTPS://x.localdomain/": "x.localdomain", "http:///nohost": None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["host"] for r in hosts_from_urls(df).collect()}
    assert got == {u: h for u, h in urls.items() if h}
    cases = [("ex.com", None), ("http://a.com/x@y", "no_dot"), ("a..b", "empty_label"), ("-a.com", "bad_label"),
             ("a." + "b" * 64 + ".com", "bad_label"), ("1.2.3.4", "ip_address"), ("a.c", "bad_tld"), ("a.c1", "bad_tld"),
             ("x" * 260 + ".com", "too_long"), (" ", "empty"), ("http://", "empty_after_normalization"), (None, "not_string")]
    rows = validate_domains(spark.createDataFrame([(c[0],) for c in cases], "domain string")).collect()
    assert [(r["domain"], r["error_code"]) for r in rows] == cases


def test_suffix_table_replaces_builtin(spark):
    hosts = spark.createDataFrame([("a.b.gov.xx",), ("b.co.uk",)], "host string")
    suffixes = spark.createDataFrame([("gov.xx",)], "suffix string")
    got = {r["host"]: (r["subdomain"], r["sld"], r["tld"]) for r in split_domain(hosts, "host", suffixes).collect()}
    assert got == {"a.b.gov.xx": ("a", "b", "gov.xx"), "b.co.uk": ("b", "co", "uk")}


def test_filter_runs_after_extraction(spark):
    df = spark.range(10).select(F.concat(F.lit("a"), "id", F.lit(".com")).alias("domain"))
    kept = structural_features(df).where("num_phishing_keywords = 0 and is_typosquat_candidate = 0")
    assert kept.count() + structural_features(df).where("num_phishing_keywords > 0 or is_typosquat_candidate = 1").count() == 10
