"""Plain versions of the operators' results, over lists of ``(doc_id, text)``."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def op1(docs, window=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p:p + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def op2(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, rows in groups.items():
        keep = min(rows)[1]
        out |= {i: (keep, len(rows), i == keep, sha(norm)) for _, i in rows}
    return out


def op6(docs, base):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t or ""))
        at = [(p, label) for label, phrase in base for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in at]
        out[i] = (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    return out


def op3(rows, temper, seed=17):
    """Of every ``(id, text, lang, source)``: probability and whether it is kept; and which targets the mix has."""
    def topic(t):
        rules = [("legal", "icense" in t and re.search("[Ll]icense", t)), ("table", " | " in t), ("contact", "@" in t), ("figures", re.search("[0-9]", t))]
        return next((name for name, holds in rules if holds), "prose")

    cell_of = [(s or "(none)", lang or "(none)", topic(t or "")) for _, t, lang, s in rows]
    tokens = Counter()
    for c, (_, t, _, _) in zip(cell_of, rows):
        tokens[c] += len(WORD.findall(t or ""))
    dims = [(d, temper[name]) for d, name in enumerate(("source", "lang", "topic"))]

    def sums(of, d):
        out = Counter()
        for c, x in of.items():
            out[c[d]] += x
        return out

    raised = {d: {v: n ** power for v, n in sums(tokens, d).items()} for d, power in dims}
    target = {d: {v: x / (sum(r.values()) or 1) for v, x in r.items()} for d, r in raised.items()}
    weight = {c: n / max(sum(tokens.values()), 1) for c, n in tokens.items()}
    law = "tempered"
    while any(weight.values()):
        off, mean, ahead = 0, 0.0, Counter()
        for d, _ in dims:
            factor = {v: target[d][v] / x if x > 0 else 1 for v, x in sums(weight, d).items()}
            weight = {c: x * factor[c[d]] for c, x in weight.items()}
            off = max([off, *[abs(f - 1) for f in factor.values()]])
            mean += sum(target[d][v] * math.log(f) for v, f in factor.items() if f > 0)
            for c in weight:
                ahead[c] += math.log(factor[c[d]]) if factor[c[d]] > 0 else -math.inf
        if off <= 1e-6:
            break
        if mean > max(ahead[c] for c in weight if tokens[c]) + 1e-12:  # no table of these cells has the targets
            law = "joint"
            break
    if law == "joint":
        held = {d: sums(tokens, d) for d, _ in dims}
        weight = {c: n and n * math.prod(held[d][c[d]] ** (power - 1) for d, power in dims) for c, n in tokens.items()}
    rate = {c: weight[c] / n for c, n in tokens.items() if n}
    chance = [float(f"{rate[c] / max(rate.values()):.6g}") if c in rate else 1.0 for c in cell_of]
    uniform = [int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2 ** 32 for i, *_ in rows]
    return [(p, u < p) for p, u in zip(chance, uniform)], law


def op4(rows, letter_vector, dimension=1024):
    """Of every ``(id, text, lang)``: the language predicted and its cosine."""
    def bundle(t):
        gaps = re.sub("\0+", "\0", "".join(c if c.isalpha() else "\0" for c in f" {(t or '').lower()} "))
        grams = Counter(gaps[p:p + 3] for p in range(len(gaps) - 2) if gaps[p + 1] != "\0")
        total = np.zeros(dimension)
        for (a, b, c), n in grams.items():
            total += float(n) * np.roll(letter_vector(ord(a), dimension), 2) * np.roll(letter_vector(ord(b), dimension), 1) * letter_vector(ord(c), dimension)
        return total, sum(grams.values())

    bundles = [bundle(t) for _, t, _ in rows]
    learned = {}
    for (i, _, lang), (v, n) in zip(rows, bundles):
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and n:
            learned[lang] = learned.get(lang, 0) + v / n
    out = []
    for v, n in bundles:
        cosines = [(float(v @ learned[x] / ((np.linalg.norm(v) or 1) * (np.linalg.norm(learned[x]) or 1))), x) for x in sorted(learned)] if n else []
        best = max(cosines, key=lambda x: x[0], default=(0, "und"))
        out.append((best[1], min(max(best[0], 0), 1)))
    return out


def shingle_sets(docs, width=2):
    out = {}
    for i, t in docs:
        w = WORD.findall(lower_az(t or ""))
        out[i] = {tuple(w[p:p + width]) for p in range(max(len(w) - width + 1, 1))} if w else set()
    return out


def op7(docs, percent=80, width=2):
    sets = shingle_sets(docs, width)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def op9(docs, tokenizer):
    start, out = 0, {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    return out


def op10(docs):
    out = {}
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[p:p + 5]) for p in range(len(w) - 4))
        covered = {p + j for p in range(len(w) - 4) if windows[tuple(w[p:p + 5])] > 1 for j in range(5)}
        symbols = sum(t.count(c) for c in "#*$%&|<>")
        out[i] = (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
    return out


def op10_kept(docs, navigation, boilerplate):
    """Of every ``(id, text)``: the verdict, the words left, and the cleaned text."""
    def fails(line):
        low = line.strip(" \t\r\x0b\x0c|>-»:/.·•").lower()
        if low in navigation or (low.count("|") > 1 and {p.strip() for p in low.split("|")} <= set(navigation)):
            return True
        if any(b in low for b in boilerplate) or re.search("(\\.\\.\\.|…)[ \t\r\x0b\x0c\"')\\]»”’]*$", line):
            return True
        solid = [c for c in line if not c.isspace()]
        letters = sum(unicodedata.category(c)[0] in "LM" for c in solid)
        return 10 * sum(c in "#*$%&|<>{}~^_=\\" for c in solid) > 3 * len(solid) or 2 * letters < len(solid)

    base, out = op10(docs), {}
    for i, t in docs:
        lines, left = (t or "").split("\n"), []
        for p, line in enumerate(lines):
            if not WORD.search(line) or not (line in lines[:p] or fails(line)):
                left.append(line)
        n = len(WORD.findall("\n".join(left)))
        out[i] = (not base[i][5] and 2 * n >= base[i][0], n, "\n".join(left))
    return out


def op13(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall(lower_az(t or "")))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_all, total = len(held), sum(n for _, _, n in held)
    df = Counter(x for _, c, _ in held for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m))
                    for x in set(term.findall(lower_az(text or ""))) if x in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def op12(rows, least=30, top=2000):
    """Of every ``(text, lang)``."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_az(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[p:p + k])) for p in range(len(w) - k + 1))
    chosen = {x: a for x, a in counts.items() if a >= least and len(x[1]) > 1}
    longer = Counter()
    for (lang, w), a in chosen.items():
        for size in range(2, len(w)):
            for p in range(len(w) - size + 1):
                key = lang, w[p:p + size]
                longer[key] = max(longer[key], a)
    out = defaultdict(list)
    for (lang, w), a in chosen.items():
        if 100 * longer[lang, w] >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))
