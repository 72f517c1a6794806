"""Row-wise operators against plain versions, and the odd cases that their docstrings define."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from wardlight.llm import decontaminate, language, packing, pii, quality, secret_scan, token_counts, toxicity
from wardlight.llm.queries import QUERIES, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key int, kept boolean"
ODD = [None, "", " \n\t ", "x" * 70_000, "don't «Ä»ÿ×÷ 3½ Ⅷ İstanbul x", "日本語 テキスト <|endoftext|>", "áb é",
       "'s 't !'re <|STARTOFTEXT|>", "the and of " * 900, "\x01\x1c odd \x7f", "same text twice", "same text twice"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, None if i % 3 else "en", None if i % 4 else "s", 0, "clash", 1, False) for i, t in enumerate(ODD)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return table(spark, folder, "documents")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(spark, folder, documents, odd, empty):
    for docs, found in ((documents, QUERIES["op8_token_counts"](spark, folder)),
                        (odd, token_counts.count_tokens(odd, brute.PATH))):
        got = by_id(found)
        for i, t in texts(docs).items():
            n = len(brute.ids(t))
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048), i
    assert token_counts.count_tokens(odd, brute.PATH).count() == len(ODD) + 1
    assert token_counts.count_tokens(empty, brute.PATH).count() == 0


def packed(docs, found):
    rows = found.collect()
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in texts(docs).items():
        assert own[i] == set(brute.pieces(t)), i
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
    return len(places), sum(r["length"] for r in rows)


def test_packing(spark, folder, documents, odd, empty):
    n, total = packed(documents, QUERIES["op4_best_fit_packing"](spark, folder))
    assert n <= total / 2048 + 2
    packed(odd, packing.pack(odd, brute.PATH))
    assert packing.pack(empty, brute.PATH).count() == 0
    packed(documents, packing.pack(documents, brute.PATH, per_shard=40))


def test_best_two_fit_swaps_for_a_tighter_pair():
    import numpy as np
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 0] and sorted(offsets[[0, 2, 3]].tolist()) == [0, 6, 8]


def test_decontamination(spark, folder, documents, odd, empty):
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    got = by_id(QUERIES["op2_decontaminate"](spark, folder))
    hit = 0
    for i, t in list(texts(documents).items())[:120]:
        n, words, found = brute.contamination(t, items)
        r = got[i]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            n, words, len(found), sha, words > 0), i
        hit += words > 0
    assert hit
    bench = spark.createDataFrame([(1, "the and"), (2, None), (None, "same text"), (4, ""), (5, "text  SAME")],
                                  "item_id int, text string")
    for block in (1 << 20, 8):
        rows = decontaminate.find_passages(odd, bench, block_bytes=block).collect()
        assert len(rows) == len(ODD) + 1
        same = [r for r in rows if r["doc_id"] == 11]
        assert all(r["items"] == [""] and r["hits"] == [0, 1] and r["near_items"] == ["", "5"] for r in same) and len(same) == 2
        assert next(r for r in rows if r["doc_id"] == 8)["hits"] == [p for k in range(900) for p in (3 * k, 3 * k + 1)]
    assert decontaminate.find_passages(empty, bench).count() == 0
    assert decontaminate.find_passages(odd, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ODD) + 1 - 4


def test_pii(spark, folder, documents, odd, empty):
    got = by_id(QUERIES["op3_pii"](spark, folder))
    for i, t in texts(documents).items():
        spans = brute.pii_spans(t)
        assert got[i]["base_sha256"] == brute.sha(spans), i
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    assert pii.find_pii(odd).count() == len(ODD) + 1 and pii.find_pii(empty).count() == 0
    masked = pii.redact(odd)
    assert masked.columns == odd.columns and masked.count() == len(ODD) + 1


@pytest.mark.parametrize("text", [
    "a@b.c d@e", "x@@y.z.w", "a.b@c.d@e.f.g", "@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "1" * 5000, "1-" * 3000 + "1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "12  4111111111111111", "+1 (988) 555-2485, +12", "+" * 4000, "a" * 5000 + "@",
    "card 4111111111111111+1 (988) 555-2485"])
def test_pii_base_spans(text):
    assert [s[:3] for s in pii.spans_of(text) if s.kind in pii.BASE] == brute.pii_spans(text)


def test_pii_context_and_checksums():
    def kinds(t):
        return [s.kind for s in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 please") == []
    assert kinds("social security 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []
    near, far = pii.spans_of("visa card 4111111111111111")[0], pii.spans_of("isbn 4111111111111111")[0]
    assert near.score > far.score
    assert pii.redacted("to a@b.com!") == "to <EMAIL>!" and pii.redacted(None) is None


@pytest.mark.parametrize("text, masked", [
    ("pay GB82 WEST 1234 5698 7654 32 BIC DEUTDEFF", "pay <IBAN> BIC DEUTDEFF"),
    ("DE89370400440532013000 BIC COBADEFFXXX", "<IBAN> BIC COBADEFFXXX"),
    ("DE89370400440532013000 GB82WEST12345698765432", "<IBAN> <IBAN>"),
    ("AB12 DE89 3704 0044 0532 0130 00 SWIFT", "AB12 <IBAN> SWIFT"),
    ("DE88370400440532013000 BIC COBADEFFXXX", "DE88370400440532013000 BIC COBADEFFXXX")])
def test_iban_before_capitals(text, masked):
    assert pii.redacted(text) == masked


def test_token_counts_of_a_text_with_millions_of_words():
    import numpy as np
    import pyarrow as pa

    from wardlight.llm.bpe import Encoder, tables
    encode = Encoder(tables(brute.PATH))
    rng = random.Random(2)
    ways = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3_001_000)})
    assert len(ways) >= 3_000_000
    per_row, lengths, starts, pool = encode(pa.array([" ".join(ways)]))
    assert per_row.tolist() == [len(ways)] and len(np.unique(starts)) == len(ways)
    for i in range(0, len(ways), 100_000):
        assert pool[starts[i]:starts[i] + lengths[i]].tolist() == brute.ids(ways[i])
    encode(pa.array(["after it"]))
    assert encode.slots == Encoder.SLOTS


def test_language(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    rows = QUERIES["op5_language"](spark, folder).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = language.learn(table(spark, folder, "documents"))
    got = [tuple(r) for r in language.predict(odd, model).where("doc_id in (1, 2) or doc_id is null").select("lang_pred", "score").collect()]
    assert set(got) == {("und", 0.0)} and language.predict(empty, model).count() == 0
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_language_mixture(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.learn(docs)
    part = {x: docs.where((F.col("lang") == x) & (F.length("text") > 3000)).first()["text"][:2000] for x in ("de", "es")}
    mixed = spark.createDataFrame([(1, part["de"] + " " + part["es"]), (2, part["de"])], "doc_id int, text string")
    got = by_id(language.predict(mixed, model))
    assert {x.split(":")[0] for x in got[1]["languages"]} == {"de", "es"} and 0.3 < got[1]["score"] < 0.7
    assert got[2]["languages"] == ["de:1.0000"]


def test_secrets(spark, folder, documents, odd, empty):
    got = by_id(QUERIES["op6_secret_scan"](spark, folder))
    for i, t in texts(documents).items():
        spans = brute.secret_spans(t)
        assert got[i]["base_sha256"] == brute.sha(spans), i
        assert [got[i][f"n_{k}"] for k in secret_scan.BASE] == [sum(s[0] == k for s in spans) for k in secret_scan.BASE]
    assert secret_scan.digest(secret_scan.find_secrets(odd)).count() == len(ODD) + 1
    assert secret_scan.find_secrets(empty).count() == 0


def test_secrets_random_strings(spark):
    rng = random.Random(3)
    rows = [(i, "key " + "".join(rng.choices(secret_scan.BASE64[:62], k=40)) + "1aA end") for i in range(40)]
    rows += [(100 + i, f"see AAAAbbbb1111AAAAbbbb1111AAAAbbbb1111{i} end") for i in range(40)]
    rows += [(200, "password=token=abcdefghijklmn"), (201, "password=secret:abcdefghijklmnop"), (202, "é AKIA" + "A1" * 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = by_id(secret_scan.digest(secret_scan.find_secrets(docs)))
    assert sum(got[i]["n_random"] for i in range(40)) >= 34
    assert sum(got[100 + i]["n_random"] for i in range(40)) == 0
    for i, t in rows[80:]:
        assert got[i]["base_sha256"] == brute.sha(brute.secret_spans(t))
    assert got[202]["spans"] == "access:2:22"


def test_secrets_need_no_python(spark, folder):
    plan = secret_scan.scan(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality(spark, folder, documents, odd, empty):
    for docs, found in ((documents, QUERIES["op9_quality_rules"](spark, folder)), (odd, quality.apply_rules(odd))):
        got = by_id(found)
        for i, t in texts(docs).items():
            r = got[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.measures(t), i
            assert r["base_failed"] == brute.base_failed(t) and not (r["kept"] and r["base_failed"])
    assert quality.apply_rules(odd).count() == len(ODD) + 1 and quality.apply_rules(empty).count() == 0
    assert quality.keep_good(empty).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d", "x y z q x y z q x y z", "a b a b a b", "l\nl\n \nl \nl"])
def test_quality_repeats(spark, text):
    r = quality.measures(spark.createDataFrame([(text,)], "text string")).first()
    assert tuple(r) == brute.measures(text)


def test_host_verdicts(spark):
    rows = [("bad", i >= 5) for i in range(100)] + [("good", i < 5) for i in range(300)] + [("small", True)] * 1 + [(None, False)] * 3
    got = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"), "host").collect()}
    assert got["bad"]["rejected"] and not got["good"]["rejected"] and not got[None]["rejected"]
    assert got["small"]["rate"] < 1 and got["small"]["n"] == 1
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, good if i < 2 else "short", "h") for i in range(60)] + [(100 + i, good, "g") for i in range(60)],
                                 "doc_id int, text string, source string")
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {100 + i for i in range(60)}
    assert {r["doc_id"] for r in quality.apply_rules(docs).where("kept").collect()} == {100 + i for i in range(60)}


def test_toxicity(spark, odd, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").withColumn(
        "low_quality", (F.col("quality") == 0).cast("int"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    chain = toxicity.fit(docs, labels.where(~held), ["low_quality", "toxic"])
    insults = "(?i)\\b(loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid)\\b"
    plain = docs.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(insults), F.lit(0)))).alias("insults"))
    rows = toxicity.predict(docs, chain).join(labels.where(held).select("doc_id", F.col("toxic").alias("y")), "doc_id").join(
        plain, "doc_id").collect()
    right = sum(r["toxic"] and r["y"] for r in rows)
    sure = [r for r in rows if r["insults"] >= 2]
    assert len(sure) > 30 and sum(r["toxic"] for r in sure) >= 0.97 * len(sure)
    assert right >= 0.93 * sum(r["y"] for r in rows) and right >= 0.97 * sum(r["toxic"] for r in rows)
    assert toxicity.predict(odd, chain).count() == len(ODD) + 1 and toxicity.predict(empty, chain).count() == 0
    assert not any(r["toxic"] for r in toxicity.predict(odd.where("text is null or text = ''"), chain).collect())


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit(odd, none, ["low_quality", "toxic"])
    assert not any(r["toxic"] for r in toxicity.predict(odd, chain).collect())
