"""Plain answers that the operators are held against."""

import numpy as np
import regex
import xxhash

SPACE_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return regex.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(text, shingle=3):
    w = SPACE_WORD.findall(ascii_lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    return majority([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams])


def components(ids, fps, radius=3):
    """The smallest id of each row's component."""
    unique = sorted(set(fps))
    links = [(i, j) for i in range(len(unique)) for j in range(i) if (unique[i] ^ unique[j]).bit_count() <= radius]
    root = dict(zip(unique, roots(len(unique), links), strict=True))
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[root[f]] = min(least.get(root[f], i), i)
    return [least[root[f]] for f in fps]


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def words_of(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()


def deduped(rows, similarity=0.8, radius=3):
    """Texts less repeated lines, for (key, text) rows in order of their keys."""
    first = {}
    for k, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if words_of(line):
                first.setdefault(words_of(line), (k, i))
    names = list(first)
    sims = [majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in set(n.split(" "))]) for n in names]
    links = []
    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
            if (sims[i] ^ sims[j]).bit_count() <= radius and abs(len(a) - len(b)) <= most and edits(a, b) <= most:
                links.append((i, j))
    least = {}
    for r, n in zip(roots(len(names), links), names, strict=True):
        least[r] = min(least.get(r, first[n]), first[n])
    stays = set(least.values())
    return ["\n".join(x for i, x in enumerate((t or "").split("\n")) if not words_of(x) or (k, i) in stays) for k, t in rows]


def measures(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = np.zeros(len(w), bool)
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered[i : i + 8] = True
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
        "n_exclamations": text.count("!"),
        "n_repeat_words": int(covered.sum()),
    }
