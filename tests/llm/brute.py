"""Plain versions of the operators, one document at a time, for small tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path("word_bpe_49k.json")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_library = []


def ids(text):
    if not _library:
        _library.append(Tokenizer.from_file(PATH))
    return _library[0].encode(text or "", add_special_tokens=False).ids


def pieces(text, size=2048):
    every = np.array([*ids(text), 0], "<u4")
    return [(k, k * size, len(every[k * size:(k + 1) * size]), zlib.crc32(every[k * size:(k + 1) * size].tobytes()))
            for k in range(-(-len(every) // size))]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def windows(text, size=10):
    w = BENCH_WORD.findall((text or "").translate(UPPER))
    return [w] if 0 < len(w) < size else [w[i:i + size] for i in range(len(w) - size + 1)]


def contamination(text, items):
    """(words, words hit, items)."""
    w = BENCH_WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, passage in items:
        for own in windows(passage):
            for i in range(len(w) - len(own) + 1):
                if w[i:i + len(own)] == own:
                    hit.update(range(i, i + len(own)))
                    found.add(str(item))
    return len(w), len(hit), found


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def secret_spans(text):
    text = text or ""
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = SPACE_WORD.findall(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
    lines = Counter(x for x in text.split("\n") if SPACE_WORD.search(x))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(n - 1 for n in lines.values()), len(again)


def base_failed(text):
    n, _, _, _, again = measures(text)
    return n < 50 or 100 * again > 50 * n


def shingles(text, size):
    w = SPACE_WORD.findall((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def components(docs, size, percent):
    """doc_id -> smallest doc_id reachable, over (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}
