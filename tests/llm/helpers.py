"""Small tables and plain versions that the tests compare with."""

import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words=80, kind="en"):
    r = random.Random(f"{kind}{seed}")
    parts = {"en": ["the", "ing", "er", "an", "th", "ou", "ed", "sh"], "de": ["ei", "sch", "un", "ge", "ö", "ß", "ver", "ich"],
             "fr": ["é", "eau", "qu", "le", "ment", "ç", "ai", "oi"]}[kind]
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in out)


#: Texts that should not crash anything: null, empty, blanks, no letter, other scripts, one very long.
ODD = [None, "", " \t\n", "!!! ... 123", "漢字 かな", "a", "Σ İ ß \x00 \x1c x", "word " * 40_000, "é" * 5000]


def odd_rows(start=1000):
    return [(start + k, t, None, None, None) for k, t in enumerate(ODD)]


def groups_of(pairs):
    """Class of every key under the links."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return find


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))
