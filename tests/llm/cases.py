"""Small tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
words = re.compile(r"[^\x20\x09-\x0D]+").findall
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "é", "ñ", "ß", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def documents(seed=1, n=60):
    """Prose with exact and near copies, shared passages, nulls, empty and odd texts, one very long text."""
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    passage = sentence(rng, 60)
    base = sentence(rng, 150)
    for k in range(12):
        edited = base.split(" ")
        for _ in range(k // 3):
            edited[rng.randrange(len(edited))] = "edited" + str(rng.randint(0, 9))
        texts.append(" ".join(edited))
    texts += [texts[0], texts[0], texts[3], base]
    texts += [sentence(rng, 10) + " " + passage + " " + sentence(rng, 12) for _ in range(5)]
    texts += [None, "", " ", "\n\n\t", "a", "a b c", "Only three words", "x" * 450, "ab" * 300, "é" * 220, "Home | About | Contact | Help\n" * 3, "&&& ### $$$ %%%" * 20]
    texts += [" ".join(sentence(rng, 40) for _ in range(250))]
    return [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def near(docs, size, percent=80):
    """doc_id -> (n_shingles, component)."""

    def shingles(text):
        w = words((text or "").translate(lower))
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t, *_ in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, length=100):
    """doc_id -> (bytes, bytes removed, spans, hash of the rest, the rest)."""
    seen, out = set(), {}
    for doc, text, *_ in sorted(docs, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(window)
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def leaks(docs, items, least=0.8):
    """(doc_id, item_id) -> best similarity over all windows of the item's size."""
    out = {}
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    for doc, text, *_ in docs:
        w = split(text)
        for item, t in items:
            own = split(t)
            k = min(5, len(own))
            if not own or len(w) < k:
                continue
            grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))  # noqa: B023, E731
            target, n = grams(own), min(len(own), len(w))
            for start in range(len(w) - n + 1):
                window = grams(w[start : start + n])
                both = sum((window & target).values())
                s = both / (sum(window.values()) + sum(target.values()) - both)
                if s >= least - 1e-9:
                    out[doc, item] = max(s, out.get((doc, item), 0))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
