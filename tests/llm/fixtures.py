"""Small documents with every edge case, and plain-Python reference versions of the contracts."""

import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean"
_SYLLABLES = ["tion", "er", "an", "the", "ou", "re", "ble", "nd", "é", "in", "st"]


def prose(rng, n):
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    lines, out = [], []
    for i, w in enumerate(words):
        out.append(w.capitalize() if not out else w)
        if rng.random() < 0.08 or i == n - 1:
            out[-1] += "."
        if rng.random() < 0.03:
            lines.append(" ".join(out) + ("" if out[-1].endswith(".") else "."))
            out = []
    lines.append(" ".join(out))
    return "\n".join(x for x in lines if x)


def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice([3, 30, 80, 200, 400])) for _ in range(24)]
    passage = prose(rng, 70).replace("\n", " ")
    texts = list(base)
    texts += [base[3], base[3], base[5].upper(), base[4] + " tail."]  # copies and near copies
    for k in range(4, 10):  # a passage in many documents, whole or in part
        w = passage.split()
        texts.append(prose(rng, 60) + "\n" + " ".join(w[: 49 + 5 * (k - 4)]) + "\n" + prose(rng, 30))
    words = base[6].split()
    for k in range(5):  # near copies by edits
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t ", "one", "a b c d", "a b c d", "A B C D", "same same same " * 60, "x" * 5000, "line one is here.\n" * 40, "tab\x0bvt\x0cff\rcr nb em"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    out = [(i, t, "en", "src", 0 if t is None else len(t), 7, None) for i, t in zip(ids, texts)]
    out += [(None, base[3], None, None, None, None, None), (None, None, None, None, None, None, None), (out[0][0], out[0][1], "en", "src", 1, 1, True), (out[1][0], base[7], "en", "src", 1, 1, True)]
    return out


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def substring_reference(docs, length):
    first = {}
    for i, t in docs:
        w = words(t)
        for a in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[a : a + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if i is not None and first.get(tuple(w[a : a + length]), i) < i:
                gone[a : a + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingle_set(text, k=5):
    w = words(fold(text))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def component_reference(docs, percent=80):
    """Least id each row reaches; by row number."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(docs)]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def contamination_reference(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = bench_words(t)
        if w and i is not None:
            for a in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
