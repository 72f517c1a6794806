"""Token ids of whole texts for a word-end BPE vocabulary.

The tokenizer drops white space before it looks at anything else, so a text's ids
are those of its white-space words in turn.  A word's pre-tokens are looked up in
the whole-token table first; only the rest is merged, by ``tiktoken`` over the same
merges (a marker byte stands for the word end) or, for words outside ASCII and
Latin-1 and for special strings, by the tokenizer's own library.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from wardlight.llm.words import spread, text_bytes, unit_hashes

#: Bytes of text encoded at once; an encoder's arrays take some 40 bytes for each.
ENCODED_BYTES = 1 << 20
PRE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
MARK = b"\x01"
_one = regex.compile(PRE)
_plain = regex.compile(r"[!-&(-~À-ÿ]*")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def tables(path: str) -> dict:
    """What tasks need of a vocabulary: made once on the driver, bounded by its size.

    ``whole`` is proved, not assumed: every vocabulary string that ends a word is
    encoded alone by the library and kept if exactly its own id comes back.
    ``trusted`` says that ``tiktoken`` over the merges agreed on all of those.
    """
    with open(path, encoding="utf-8") as f:
        body = f.read()
    spec = json.loads(body)
    suffix = spec["model"].get("end_of_word_suffix")
    splits = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"]]
    if suffix != "</w>" or PRE not in {(s or "").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
                                       for s in splits}:
        raise ValueError("only word-end BPE vocabularies with the usual word pattern are supported")
    byte_of, vocab = _byte_of(), spec["model"]["vocab"]

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        body = token[:-len(suffix)] if end else token
        return bytes(byte_of[c] for c in body) + MARK * end

    special = {t["content"] for t in spec["added_tokens"]}
    ranks: dict[bytes, int] = {}
    ids: list[int] = []
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    singles = [t for t in vocab if t not in special and len(raw(t)) == 1]
    ends = [t for t in vocab if t not in special and len(raw(t)) == 2 and t.endswith(suffix)]
    for token in [*ends, *(a + b for a, b in merges), *singles]:
        if (key := raw(token)) not in ranks:
            ranks[key] = len(ids)
            ids.append(vocab[token])
    library = Tokenizer.from_str(body)
    alone = {}
    for token, i in vocab.items():
        if token not in special and token.endswith(suffix):
            try:
                text = raw(token)[:-1].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _one.fullmatch(text) and text == text.lower():
                alone[text] = i
    texts = list(alone)
    got = library.encode_batch_fast(texts, add_special_tokens=False)
    whole = {t: alone[t] for t, e in zip(texts, got, strict=True) if e.ids == [alone[t]]}
    out = {"library": body, "whole": whole, "ranks": ranks, "ids": np.array(ids, np.uint32)}
    merged = Merger(out | {"trusted": True})
    plain = [t for t in whole if _plain.fullmatch(t)]
    lengths, flat = merged.merge(plain)
    out["trusted"] = bool((lengths == 1).all() and flat.tolist() == [whole[t] for t in plain])
    return out


class Merger:
    """Merges pre-tokens, and whole words by the library, with one vocabulary."""

    def __init__(self, given: dict) -> None:
        self.whole, self.ids, self.body = given["whole"], given["ids"], given["library"]
        self.library = None
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=given["ranks"],
                                      special_tokens={})
        self.last = np.zeros(len(self.ids), bool)
        for key, rank in given["ranks"].items():
            self.last[rank] = key.endswith(MARK) and len(key) > 1

    def merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per pre-token, all ids) by the vocabulary's merges."""
        if not pretokens:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        ranks = np.array(self.fast.encode_ordinary("\x01".join(pretokens) + "\x01"), np.int64)
        ends = np.flatnonzero(self.last[ranks])
        return np.diff(ends, prepend=-1), self.ids[ranks]

    def by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.library is None:
            self.library = Tokenizer.from_str(self.body)
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return (np.array([len(x) for x in found], np.int64),
                np.array([i for x in found for i in x], np.uint32))

    def pretokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whole tokens from the table, the rest merged."""
        whole = self.whole
        found = np.array([whole.get(u, -1) for u in units], np.int64)
        lengths = (found >= 0).astype(np.int64)
        rest = np.flatnonzero(found == -1)
        lengths[rest], rest_ids = self.merge([units[i] for i in rest])
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        one = found >= 0
        flat[starts[one]] = found[one]
        flat[spread(starts[rest], lengths[rest])] = rest_ids
        return lengths, flat


#: Classes of bytes: white space, letters, digits, other signs, and those left to the library.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = SIGN
    kind[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
    kind[48:58] = DIGIT
    kind[39] = OTHER
    kind[list(b" \t\n\x0b\x0c\r")] = SPACE
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


_KIND, _LOWER = _classes()


class Encoder:
    """Ids of whole texts; one per task.

    Units are pre-tokens of ASCII and Latin-1 words, and whole white-space words that
    hold anything else (apostrophes, other scripts, control characters, special
    strings).  The ids of units met are kept under their 64-bit hash in a table that is
    emptied before a slice when half full, and grows for a slice that has more units.
    """

    SLOTS = 1 << 21

    def __init__(self, given: dict) -> None:
        self.merger, self.trusted = Merger(given), given.get("trusted", True)
        self.reset()

    def reset(self) -> None:
        self.sized(self.SLOTS)
        self.start, self.length, self.pool, self.n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
        self.pooled = 0
        self.flat: tuple | None = None

    def sized(self, slots: int) -> None:
        """An empty table of ``slots``, a power of two."""
        self.slots, self.shift = slots, np.uint64(65 - slots.bit_length())
        self.keys = np.zeros(slots, np.uint64)
        self.value = np.full(slots, -1, np.int32)

    def units(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(units per row, start, length, hash, bytes, is a whole word for the library)."""
        raw, ends = text_bytes(text)
        kind = _KIND[raw]
        data = _LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        if len(lead):
            second = raw[lead + 1]
            cross = (second == 0x97) | (second == 0xB7)
            kind[lead + 1] = np.where(cross, SIGN, LETTER)
            kind[lead[cross]] = SIGN
            upper = (second < 0x9F) & ~cross
            data[lead[upper] + 1] += 32
        special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
        kind[special] = OTHER
        inside = kind != SPACE
        begins = np.zeros(len(raw), bool)
        begins[ends[:-1][ends[:-1] < len(raw)]] = True
        opens = begins.copy()
        opens[1:] |= kind[1:] != kind[:-1]
        opens |= kind == DIGIT
        opens &= inside
        odd = np.zeros(len(raw), bool)
        strange = kind == OTHER if self.trusted else inside
        if strange.any():
            word_opens = begins.copy()
            word_opens[1:] |= ~inside[:-1]
            word_opens &= inside
            word = np.cumsum(word_opens) - 1
            bad = np.bincount(word[strange], minlength=int(word[-1]) + 1) > 0
            odd = inside & bad[word]
            opens[odd] = word_opens[odd]
            data = np.where(odd, raw, data)
        start = np.flatnonzero(opens)
        unit = np.cumsum(opens)[inside] - 1
        length = np.bincount(unit, minlength=len(start)) if len(start) else np.zeros(0, np.int64)
        hashes = unit_hashes(data, inside, start, length)
        whole = odd[start]
        hashes = np.where(whole, hashes * np.uint64(0xD1342543DE82EF95) + np.uint64(1), hashes)
        return np.diff(np.searchsorted(start, ends)), start, length, hashes, data, whole

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number kept under each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.value[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((found < 0) & (self.value[slot] >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (self.slots - 1)
            value = self.value[slot]
            hit = (value >= 0) & (self.keys[slot] == hashes[open_])
            found[open_[hit]] = value[hit]
            on = (value >= 0) & ~hit
            open_, slot = open_[on], slot[on]
        return found

    def put(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Files distinct hashes that the table doesn't hold."""
        slot = (hashes >> self.shift).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = self.value[slot[todo]] < 0
            first = todo[free]
            _, once = np.unique(slot[first], return_index=True)
            put = first[once]
            self.value[slot[put]], self.keys[slot[put]] = number[put], hashes[put]
            left = np.ones(len(hashes), bool)
            left[put] = False
            todo = todo[left[todo]]
            slot[todo] = np.where(self.keys[slot[todo]] == hashes[todo], slot[todo], (slot[todo] + 1) & (self.slots - 1))

    def keep(self, hashes: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        if 2 * (self.n + len(hashes)) > self.slots:
            used = self.value >= 0
            keys, value = self.keys[used], self.value[used]
            self.sized(1 << (2 * (self.n + len(hashes))).bit_length())
            self.put(keys, value)
        self.put(hashes, self.n + np.arange(len(hashes)))
        self.start.append(self.pooled + np.cumsum(lengths) - lengths)
        self.length.append(lengths)
        self.pool.append(flat)
        self.pooled += len(flat)
        self.n += len(hashes)
        self.flat = None

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(units per row, ids per unit, first id's place per unit, places' ids)."""
        per_row, start, length, hashes, data, whole = self.units(text)
        if self.n > self.SLOTS // 2 - 500_000:
            self.reset()
        found = self.find(hashes)
        missed = np.flatnonzero(found < 0)
        if len(missed):
            _, once = np.unique(hashes[missed], return_index=True)
            new = missed[once]
            body = data.tobytes()
            for chosen, way in ((new[~whole[new]], self.merger.pretokens), (new[whole[new]], self.merger.by_library)):
                if len(chosen):
                    texts = [body[a:b].decode("utf-8") for a, b in
                             zip(start[chosen].tolist(), (start[chosen] + length[chosen]).tolist(), strict=True)]
                    self.keep(hashes[chosen], *way(texts))
            found[missed] = self.find(hashes[missed])
        if self.flat is None:
            self.start, self.length = [np.concatenate(self.start)], [np.concatenate(self.length)]
            self.pool = [np.concatenate(self.pool)] if self.pool else [np.zeros(0, np.uint32)]
            self.flat = (self.start[0], self.length[0], self.pool[0])
        kept_start, kept_length, pool = self.flat
        return per_row, kept_length[found], kept_start[found], pool
