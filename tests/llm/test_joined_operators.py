"""Near-duplicates, archives and the pipeline against plain versions."""

import base64
import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardlight.llm import near_dup, pii, warc
from wardlight.llm.queries import QUERIES, table
from wardlight.session import scratch_path


def groups(found):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()}


def expected(docs, size, percent):
    roots, sizes = brute.components(docs, size, percent)
    return {i: (sizes[i], roots[i], roots[i] == i) for i in roots}


def test_near_duplicates(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert groups(QUERIES["op7_near_duplicates"](spark, folder)) == expected(docs, 3, 85)


def test_near_duplicates_of_a_large_group(spark):
    """A base text with one to three words changed, exact copies, and chains just above the limit."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = word()
        rows.append((i, " ".join(own)))
    chain = list(base[::-1])
    for i in range(12):
        rows.append((1000 + i, " ".join(chain)))
        chain[10 * i] = word()
    rows += [(2000 + i, " ".join(word() for _ in range(60))) for i in range(60)]
    got = groups(near_dup.find_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert got == expected(rows, 3, 85)


def test_near_duplicates_in_a_template_region(spark):
    """Thousands of pages of one template lie just below the limit; the planted pairs in it lie just above."""
    rng = random.Random(11)
    word = lambda k: ["".join(rng.choices("abcdefghij", k=9)) for _ in range(k)]
    template, rows, pairs = word(220), [], set()
    for i in range(3000):
        own = word(20)
        if i % 60 == 0:
            pairs.add((i, i + 1))
            rows += [(i, " ".join(template + own)), (i + 1, " ".join(template + own[:4] + word(16)))]
        elif i % 60 > 1:
            rows.append((i, " ".join(template + own)))
    sets = {i: brute.shingles(t, 3) for i, t in rows}
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ids = rng.sample(sorted(sets), 300)
    assert all(similar(a, b) for a, b in pairs)
    assert not any(similar(a, b) for a in ids for b in ids if a < b and (a, b) not in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = groups(near_dup.find_groups(docs, 3, 85))
    assert {(r[1], i) for i, r in got.items() if not r[2]} == pairs


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a"), (7, "x" * 100_000),
            (8, "a b c d"), (9, "a b c  d"), (9, "a b c  d"), (10, "b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
    found = near_dup.find_groups(docs, 3, 85)
    got = groups(found)
    assert found.count() == len(rows)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[None] == (2, None, True)
    assert got[5] == (1, 4, False) and got[6] == (1, 6, True) and got[9] == (2, 8, False) and got[10] == (1, 10, True)
    kept = near_dup.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert near_dup.find_groups(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 80)] + [(300, 299)]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and {got[100 + k] for k in range(1, 80)} == {100} and got[300] == 299


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def check_pages(pages, found, least=0):
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    first = {}
    for i, h in rows:
        first[h] = i if first.get(h) is None else min(first[h], i if i is not None else first[h])
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=str)
    want = []
    for i, h in rows:
        revisit = len(h.encode()) >= least and first[h] is not None and first[h] != i
        want.append((i, len(h.encode()), digest(h), "revisit" if revisit else "response", first[h] if revisit else None))
    assert got == sorted(want, key=str)


def test_archives(spark, folder):
    check_pages(table(spark, folder, "pages"), QUERIES["op1_warc_index"](spark, folder))


def test_archives_odd_pages(spark):
    rows = [(1, "http://a.com/x\r\ny", "p\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "", ""), (4, "http://a.com/", "p\r\n\r\nWARC/1.1\r\n"),
            (5, "https://WWW.A.com/b", "é" * 500), (6, "https://www.a.com/b", "é" * 500), (None, "http://b.org", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("size", F.lit(0))
    check_pages(pages, warc.archive_and_index(pages))
    check_pages(pages, warc.archive_and_index(pages, least=20), 20)
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_index_is_in_global_order_with_histories(spark, folder):
    """One url holds half of the captures and the ranges are tiny."""
    pages = table(spark, folder, "pages").withColumn(
        "url", F.when(F.col("page_id") % 2 == 0, "http://hot.example/").otherwise(F.col("url")))
    path, runs, merged = (scratch_path(spark, x) for x in ("warc", "runs", "index"))
    warc.write_archives(pages, path, archive_bytes=30_000)
    warc.index_runs(spark, path).write.parquet(runs)
    warc.merge_runs(spark.read.parquet(runs), per_range=10).write.parquet(merged)
    rows = sorted(warc.capture_histories(spark.read.parquet(merged)).collect(), key=lambda r: r["position"])
    assert spark.read.parquet(merged).select("part").distinct().count() > 3
    assert [r["position"] for r in rows] == list(range(pages.count()))
    order = [(r["urlkey"], r["captured"], r["page_id"]) for r in rows]
    assert order == sorted(order)
    seen = {}
    for r in rows:
        assert r["capture_no"] == seen.get(r["urlkey"], 0)
        seen[r["urlkey"]] = r["capture_no"] + 1


def test_damaged_archive_is_noticed():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n"))


def test_pipeline(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").select("doc_id", "text").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    left = {i: t for i, t in docs.items() if not brute.base_failed(t)}
    roots, _ = brute.components(left.items(), 5, 80)
    left = {i: pii.redacted(t) for i, t in left.items() if roots[i] == i and not brute.contamination(t, items)[1]}
    got = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {(i, *p) for i, t in left.items() for p in brute.pieces(t)}


def test_pipeline_on_odd_and_empty_tables(spark, folder):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text + " mail a@b.com", "en", "s", 3), (1, text + " mail a@b.com", "en", "s", 3), (None, text[::-1], None, None, None),
            (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1))
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, "stage")
            stage(spark, out, folder).write.parquet(path)
            out = spark.read.parquet(path)
            if name != "pack_sequences":
                assert out.columns == docs.columns
        assert out.count() == (2 if given is docs else 0)


def test_keep_one_loses_no_text_of_a_shared_id(spark):
    """Rows of one id with different texts are different documents; equal rows are one."""
    text = lambda seed: " ".join(random.Random(seed).choices("abcdefgh", k=60))
    rows = [(1, text(1), "x"), (1, text(2), "y"), (1, text(1), "x"), (2, text(3), "z"), (None, text(4), "u"), (None, text(4), "u"), (3, None, "v"), (4, "", "w")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()
    assert {(r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None} == {(i, t) for i, t, _ in rows if i is not None}
    assert sum(r["doc_id"] == 1 for r in kept) == 2 and sum(r["doc_id"] is None for r in kept) == 2
