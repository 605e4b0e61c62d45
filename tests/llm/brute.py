"""Plain versions of what the operators compute, for small fixtures."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose_words(seed, n):
    """Random words, hardly ever the same sequence twice."""
    rng = random.Random(seed)
    parts = ["ta", "re", "mo", "lin", "sha", "do", "ver", "ki", "on", "bel"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def split(text):
    return WORD.findall(text or "")


def base_counts(text):
    text = text or ""
    words = split(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


def shingles(text, n=5):
    words = split(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near(rows, threshold=0.8):
    """Links of each row, and the least id that its links lead to, by comparing all pairs."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if rows[i][1] == rows[j][1] or union and len(sets[i] & sets[j]) / union >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return links, [least[root(i)] for i in range(len(rows))]


def repeated_words(rows, least=50):
    owner, copies = defaultdict(set), Counter(r[1] or "" for r in rows)
    for r in rows:
        words = split(r[1])
        for i in range(len(words) - least + 1):
            owner[tuple(words[i : i + least])].add(r[1])
    out = []
    for r in rows:
        words = split(r[1])
        marked = [copies[r[1] or ""] > 1 and len(words) >= least] * len(words)
        for i in range(len(words) - least + 1):
            if len(owner[tuple(words[i : i + least])]) > 1:
                marked[i : i + least] = [True] * least
        out.append(marked)
    return out


def edit_distance(item, text):
    """Least word edit distance of item to a stretch of text."""
    last = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        now = [i]
        for j, other in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (word != other)))
        last = now
    return min(last)


def normal(text):
    kept = "".join(c for c in (text or "") if not (33 <= ord(c) < 127 and not c.isalnum()))
    return split(re.sub("[A-Z]", lambda m: m.group().lower(), kept))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 * (c > 9)
    return total % 10 == 0


def personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            valid = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append((m.start(), k, m.end()))
    return [f"{list(PII)[k]}:{a}:{b}" for a, k, b in sorted(out)]
