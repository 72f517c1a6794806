"""Language proportions of documents by expectation-maximisation over n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.words import sliced

BUCKETS = 1 << 14
STEPS = 12
#: At most so many languages are learned: the model is BUCKETS numbers for each.
MOST_LANGUAGES = 500


def _folded() -> np.ndarray:
    """Each BMP code point as its lower-case letter, or a blank."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the letter trigrams of each text, and which rows hold a letter.

    Words are padded with one blank; trigrams hold at least one letter.
    """
    if not _table:
        _table.append(_folded())
    codes = np.frombuffer("".join(f"  {t or ''}  " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = codes > 0xFFFF
    folded = _table[0][np.where(wide, 0, codes)]
    if wide.any():
        rare, back = np.unique(codes[wide], return_inverse=True)
        folded[wide] = np.array([c if chr(c).isalpha() else 32 for c in rare.tolist()], np.uint32)[back]
    sizes = np.array([len(t or "") + 4 for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = folded != 32
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    mixed = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    use = letter[1:-1] | (letter[:-2] & letter[2:])
    use &= row[:-2] == row[2:]
    bucket = (mixed[use] >> np.uint32(18)).astype(np.int64)
    key = row[:-2][use] * BUCKETS + bucket
    if len(texts) * BUCKETS <= 4_000_000:
        counts = np.bincount(key, minlength=1)
        key = np.flatnonzero(counts)
        counts = counts[key]
    else:
        key, counts = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, counts, has


def _chunks(texts: list, most: int = 128) -> Iterator[tuple[int, list]]:
    for i in range(0, len(texts), most):
        yield i, texts[i:i + most]


def learn(docs: DataFrame, label: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, probability of each n-gram bucket given the language).

    Counts run over all rows with a label and are summed in each task before they are
    shuffled.  The result has BUCKETS numbers a language; more than ``MOST_LANGUAGES``
    labels raise.  Without labelled text there are no languages.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            labels = batch["label"].to_pylist()
            for at, texts in _chunks(batch["text"].to_pylist()):
                row, bucket, count, _ = ngrams(texts)
                own = np.array(labels[at:at + len(texts)], object)[row] if len(row) else np.zeros(0, object)
                for x in set(labels[at:at + len(texts)]):
                    of = own == x
                    sums = totals.setdefault(x, np.zeros(BUCKETS, np.int64))
                    sums += np.bincount(bucket[of], weights=count[of], minlength=BUCKETS).astype(np.int64)
                if len(totals) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for x, sums in totals.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())],
                ["label", "bucket", "n"])

    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    counted = (rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket")
               .agg(F.sum("n").alias("n")))
    vectors = (counted.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("x"))
               .orderBy("label").limit(MOST_LANGUAGES + 1).collect())
    if len(vectors) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = np.zeros((len(vectors), BUCKETS))
    for i, r in enumerate(vectors):
        pairs = np.array(r["x"], np.int64).reshape(-1, 2)
        sums[i, pairs[:, 0]] = pairs[:, 1]
    smooth = sums + 0.1
    return [r["label"] for r in vectors], smooth / smooth.sum(1, keepdims=True)


def mixtures(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, given: np.ndarray,
             penalty: float = 0.5) -> np.ndarray:
    """Proportions of each language (columns) for each of ``n`` rows.

    EM over all languages; then languages are dropped one at a time, the least first,
    while log-likelihood minus ``penalty`` times log(n-grams) a language doesn't fall.
    """
    k = len(given)
    share = np.full((n, k), 1.0 / k)
    if not len(row):
        return share
    like = given.T[bucket]
    total = np.bincount(row, weights=count, minlength=n)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    present = row[starts]

    def em(share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            weight = like * share[row]
            weight *= (count / weight.sum(1))[:, None]
            new = share.copy()
            new[present] = np.add.reduceat(weight, starts) / total[present, None]
            share = new
        logs = np.zeros(n)
        logs[present] = np.add.reduceat(count * np.log((like * share[row]).sum(1)), starts)
        return share, logs

    share, logs = em(share, STEPS)
    cost = penalty * np.log(np.maximum(total, 2))
    open_ = np.ones(n, bool)
    for _ in range(k - 1):
        size = (share > 0).sum(1)
        open_ &= size > 1
        if not open_.any():
            break
        least = np.where(share > 0, share, np.inf).argmin(1)
        trial = share.copy()
        trial[open_, least[open_]] = 0
        trial /= np.maximum(trial.sum(1, keepdims=True), 1e-300)
        trial = np.where(trial.sum(1, keepdims=True) > 0, trial, share)
        trial, trial_logs = em(trial, 3)
        better = open_ & (trial_logs + cost >= logs)
        share[better], logs[better] = trial[better], trial_logs[better]
        open_ &= better
    return share


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """A row (key, lang_pred, score, languages) for each row of ``docs``.

    ``lang_pred`` is the language with the greatest proportion and ``score`` that
    proportion; ``languages`` lists the selected set as language:proportion, greatest
    first, ties by name.  A text that is null or has no letter, and every text if no
    language was learned, gets "und" and 0.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probabilities = given.value
        for batch in sliced(batches):
            best, score, sets = [], [], []
            for _, texts in _chunks(batch["text"].to_pylist()):
                row, bucket, count, has = ngrams(texts)
                if not names:
                    has[:] = False
                share = mixtures(row, bucket, count, len(texts), probabilities) if has.any() else None
                for i, known in enumerate(has.tolist()):
                    if not known:
                        best.append("und")
                        score.append(0.0)
                        sets.append([])
                        continue
                    order = np.argsort(-share[i], kind="stable")
                    best.append(names[order[0]])
                    score.append(float(min(1.0, share[i, order[0]])))
                    sets.append([f"{names[j]}:{share[i, j]:.4f}" for j in order.tolist() if share[i, j] > 0])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(sets, pa.list_(pa.string()))], ["key", "lang_pred", "score", "languages"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, lang_pred string, score double, languages array<string>")
            .withColumnRenamed("key", key))
