from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlight.functions import scores as S
from wardlight.functions.sqlfuncs import register_sql_functions
from wardlight.operators import audit, clean, encode, explain
from wardlight.operators.assemble import assemble, assemble_batch
from wardlight.operators.lookups import known_lookup, known_verdict, route_verdicts
from wardlight.schemas import DNS_OBS, FEATURE_NAMES, NETWORK_DEFAULTS, WHOIS_OBS

NOW = datetime(2024, 6, 1, 12)


def observations(spark):
    dns = [("example.com", t, f"r{i}", 3600, NOW) for i, t in enumerate(["A", "A", "MX", "NS", "NS", "TXT", "AAAA"])]
    dns += [("fastflux.example", "A", f"1.1.1.{i}", 60, NOW) for i in range(5)] + [("fastflux.example", "NS", "n", 60, NOW)]
    days = lambda n: NOW + timedelta(days=n)
    whois = [
        ("young.com", [days(-4)], [days(361)], "GoDaddy.com, LLC", "US", "", None, None, None, NOW, None),
        ("old.com", [days(-3650)], [days(365)], "GoDaddy.com, LLC", " US ", "", None, None, None, NOW, None),
        ("private.com", [days(-500), days(-1)], [days(200)], "NameCheap", None, "REDACTED FOR PRIVACY", None, None, ["whoisguard@x"], NOW, None),
        ("future.com", [days(3)], [days(-1.5)], None, None, "", None, None, None, NOW, None)]
    return spark.createDataFrame(dns, DNS_OBS), spark.createDataFrame(whois, WHOIS_OBS)


def test_network_cases(spark):
    dns, whois = observations(spark)
    names = ["example.com", "fastflux.example", "nothing.test", "www.young.com", "old.com", "private.com", "future.com"]
    hosts = spark.createDataFrame([(n,) for n in names], "domain string")
    got = {r["domain"]: r for r in assemble(hosts, dns, whois, F.lit(NOW)).collect()}
    a = got["example.com"]
    assert (a["num_a_records"], a["num_ns_records"], a["has_mx_record"], a["has_txt_record"], a["dns_resolves"], a["dns_ttl"]) == (2, 2, 1, 1, 1, 3600)
    assert a["has_ipv6"] == 1 and a["is_fast_flux"] == 0 and a["network_features_available"] == 1
    assert got["fastflux.example"]["is_fast_flux"] == 1
    assert {k: got["nothing.test"][k] for k in NETWORK_DEFAULTS} == NETWORK_DEFAULTS
    y = got["www.young.com"]
    assert (y["domain_age_days"], y["is_newly_registered"], y["registration_length_days"], y["whois_country"], y["registrar_is_common"]) == (4, 1, 365, "us", 1)
    assert got["old.com"]["domain_age_days"] == 3650 and got["old.com"]["is_newly_registered"] == 0
    assert got["private.com"]["whois_privacy_enabled"] == 1 and got["private.com"]["domain_age_days"] == 500
    f = got["future.com"]
    assert (f["domain_age_days"], f["days_until_expiry"], f["registration_length_days"], f["is_newly_registered"]) == (-1, -2, -1, 0)
    assert list(got["old.com"].asDict())[1:] == FEATURE_NAMES


def test_snapshots_and_as_of(spark):
    day = timedelta(days=1)
    dns = [("a.com", "A", "1.1.1.1", 60, NOW - k * day + timedelta(hours=1)) for k in range(1, 6)]
    dns += [("a.com", "A", "1.1.1.1", 90, NOW - timedelta(hours=23))]
    whois = [("a.com", [NOW - 9 * day], None, None, "US", "", None, None, None, NOW + day, "hidden by proxy"),
             ("a.com", [NOW - 9 * day], None, None, "FR", "", None, None, None, NOW - day, "hidden by proxy")]
    dns, whois = spark.createDataFrame(dns, DNS_OBS), spark.createDataFrame(whois, WHOIS_OBS)
    host = spark.createDataFrame([("a.com",)], "domain string")

    def at(when, **given):
        return assemble(host, as_of=F.lit(when), **given).first()

    r = at(NOW, dns_obs=dns, whois_obs=whois)
    assert (r["num_a_records"], r["is_fast_flux"], r["dns_ttl"], r["whois_country"], r["whois_privacy_enabled"]) == (1, 0, 60, "fr", 1)
    before = at(NOW - 300 * day, dns_obs=dns, whois_obs=whois)
    assert {k: before[k] for k in NETWORK_DEFAULTS} == NETWORK_DEFAULTS
    one = at(NOW, dns_obs=dns)
    assert one["num_a_records"] == 1 and one["whois_country"] == "unknown" and one["network_features_available"] == 1
    assert at(NOW + day, whois_obs=whois)["whois_country"] == "us"
    with pytest.raises(ValueError):
        assemble(host, dns)


def test_batch_error_rules(spark):
    df = spark.createDataFrame([("a.com",), ("  ",)], "domain string")
    assert assemble_batch(df, "skip").count() == 1
    zero = {r["domain"]: r for r in assemble_batch(df, "zero").collect()}
    assert zero["  "]["typosquat_distance"] == 0 and zero["a.com"]["domain_length"] == 5
    with pytest.raises(Exception, match="domain is empty"):
        assemble_batch(df, "raise").collect()


def test_score_bands(spark):
    want = [(.01, "safe"), (.49, "safe"), (.50, "suspicious"), (.64, "suspicious"), (.79, "suspicious"), (.80, "malicious"), (.93, "malicious"), (.999, "malicious")]
    df = spark.createDataFrame([(s,) for s, _ in want], "s double")
    assert [r[0] for r in df.select(S.score_to_label(F.col("s"))).collect()] == [l for _, l in want]
    register_sql_functions(spark)
    assert [r[0] for r in df.selectExpr("risk_label(s)").collect()] == [l for _, l in want]


def test_md5_code_matches_digest(spark):
    import hashlib
    tokens = ["com", "xyz", "bücher", "unknown", "a b"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(S.hash_encode(F.col("t"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(t.encode()).hexdigest(), 16) % 100003 for t in tokens]


def test_vocab_unknown_last_and_unseen(spark):
    train = spark.createDataFrame([(" COM", "us"), ("xyz", None), ("", "us")], "tld string, whois_country string")
    vocab = encode.fit_vocab(train)
    assert {(r["feature"], r["token"]): r["code"] for r in vocab.collect()} == {
        ("tld", "com"): 0, ("tld", "xyz"): 1, ("tld", "unknown"): 2, ("whois_country", "us"): 0, ("whois_country", "unknown"): 1}
    new = spark.createDataFrame([("com", "fr"), ("zzz", "US")], "tld string, whois_country string")
    assert sorted(tuple(r) for r in encode.apply_vocab(new, vocab).collect()) == [(0, 1), (2, 0)]


def test_cleaning_rules(spark):
    rows = [(1, " A.com ", "1"), (2, "", "0"), (3, "b.com", "x"), (4, "c.com", "2"), (5, "d.com", "0.5"), (6, "a.com", "0"), (7, None, "1"), (8, "e.com", "nan"), (9, "f.com", "1e30")]
    df = spark.createDataFrame(rows, "row_id long, domain string, label string")
    kept = clean.clean_labeled(df)
    assert sorted((r["row_id"], r["domain"], r["label"]) for r in kept.collect()) == [(1, "a.com", 1), (5, "d.com", 0), (6, "a.com", 0)]
    assert clean.drop_report(df).first().asDict() == {
        "n_raw": 9, "dropped_empty_domain": 2, "dropped_non_numeric_label": 2, "dropped_label_out_of_range": 2, "n_valid": 3}
    assert [r["domain"] for r in clean.label_conflicts(kept).collect()] == ["a.com"]
    assert sorted((r["domain"], r["row_id"]) for r in clean.dedupe_first(kept).collect()) == [("a.com", 1), ("d.com", 5)]


def test_reasons_with_context_and_order(spark):
    dns, whois = observations(spark)
    hosts = spark.createDataFrame([("paypal.secure-verify.xyz",)], "domain string")
    from wardlight.operators.lexical import structural_features
    wide = structural_features(hosts, context=True)
    full = wide.withColumns({k: F.lit(v) for k, v in NETWORK_DEFAULTS.items()}).withColumn("label", F.lit("malicious"))
    push = {"brand_in_subdomain": 3.0, "contains_phishing_keyword": 2.0, "num_phishing_keywords": 1.9, "tld_is_suspicious": 1.0, "has_mx_record": 9.0, "has_www": 0.5}
    full = full.withColumn("contributions", F.array(*[F.lit(push.get(n, -0.1)) for n in FEATURE_NAMES]))
    told = explain.explain(full, context=True).first()["reasons"]
    assert told == ["'paypal' appears in a subdomain, not the main domain",
                    "The domain name contains phishing keywords: 'pay', 'secure', 'verify'",
                    "The domain uses a high-risk extension (.xyz)"]
    plain = explain.explain(full).first()["reasons"]
    assert plain[1] == "The domain name contains a phishing-related keyword" and len(plain) == 3
    assert explain.explain(full.withColumn("label", F.lit("safe"))).first()["reasons"] == []


def test_known_domains(spark):
    known = spark.createDataFrame([("bad.com", "phishing", None, True), ("ok.com", "safe", "list", True), ("off.com", "malicious", "x", False)],
                                  "domain string, verdict string, source string, is_active boolean")
    df = spark.createDataFrame([("WWW.bad.com",), ("ok.com",), ("off.com",), ("www.www.bad.com",)], "domain string")
    hit, miss = route_verdicts(df, known)
    assert {r["domain"] for r in hit.collect()} == {"WWW.bad.com", "ok.com"} and miss.count() == 2
    got = {r["domain"]: r for r in known_verdict(known_lookup(hit, known)).collect()}
    assert (got["WWW.bad.com"]["score"], got["WWW.bad.com"]["reasons"]) == (1.0, ["This domain is on a curated threat list (source: manual)"])
    assert (got["ok.com"]["label"], got["ok.com"]["reasons"]) == ("safe", [])


def test_log_reports(spark):
    log = spark.createDataFrame([("a.com", 0.9, "malicious", datetime(2024, 1, 1)), ("b.com", 0.6, "suspicious", datetime(2024, 1, 2))],
                                "domain string, score double, label string, created_at timestamp")
    assert audit.recent_analyses(log, 10, "safe").count() == 0
    assert [r["domain"] for r in audit.recent_analyses(log, 1).collect()] == ["b.com"]
    with pytest.raises(ValueError):
        audit.recent_analyses(log, 501)
    assert audit.purge_count(log, F.lit(datetime(2024, 3, 31)), 90).first().asDict() == {"purged": 0, "kept": 2}
    assert audit.purge_count(log, F.lit(datetime(2024, 4, 1)), 90).first()["purged"] == 1
