"""Plain Python versions of the operators, for small tables."""
import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(seqs, window):
    """Marks of removed units, for (id, sequence) rows."""
    first = {}
    for i, s in seqs:
        for k in range(len(s) - window + 1):
            w = s[k:k + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, s in seqs:
        gone, to = [False] * len(s), 0
        for k in range(len(s) - window + 1):
            if first[s[k:k + window]] < i:
                for z in range(max(k, to), k + window):
                    gone[z] = True
                to = k + window
        out.append(gone)
    return out


def substring_rows(rows, window=50):
    seqs = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, s), gone in zip(seqs, repeats(seqs, window)):
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(s), sum(gone), runs, sha(bytes(c for c, g in zip(s, gone) if not g))))
    return out


def passage_rows(rows, window=50):
    seqs = [(i, tuple(words(t))) for i, t in rows]
    return [(i, len(s), sum(g), sha(" ".join(w for w, x in zip(s, g) if not x))) for (i, s), g in zip(seqs, repeats(seqs, window))]


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_rows(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(s), least[find(x)] if s else i) for x, (i, s) in enumerate(sets)]


def line_rows(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text):
    text = text or ""
    def digits(m):
        return re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


def quality_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:]))
    often = collections.Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def edit_distance_in(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def lm_rows(rows, order=3):
    """Scores by the recursive definition of the model."""
    import math
    import zlib
    texts = []
    for i, t in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        texts.append((i, held, ["<"] + ["w" + w for w in words((t or "").translate(LOWER))] + [">"]))
    count, after = collections.Counter(), collections.defaultdict(set)
    for _, held, s in texts:
        for k in range(1, order + 1):
            for j in range(len(s) - k + 1):
                if not held:
                    count[tuple(s[j:j + k])] += 1
                    after[tuple(s[j:j + k - 1])].add(s[j + k - 1])
    known = [g for g in count if len(g) == 1 and g != ("<",)]
    total = sum(count[g] for g in known)
    floor = total + len(known) + 1
    discount = {}
    for k in range(2, order + 1):
        n1, n2 = (sum(1 for g, c in count.items() if len(g) == k and c == x) for x in (1, 2))
        discount[k] = (n1 + 0.5) / (n1 + 2 * n2 + 1)

    def p(context, w):
        if not context:
            return (count[w,] + 1) / floor
        if not count[context]:
            return p(context[1:], w)
        d = discount[len(context) + 1]
        seen = count[context + (w,)]
        return ((seen - d) if seen else 0) / count[context] + d * len(after[context]) / count[context] * p(context[1:], w)

    out = []
    for i, held, s in texts:
        base = sum(math.log10((count[w,] + 1) / floor) for w in s[1:])
        score = sum(math.log10(p(tuple(s[max(0, j - order + 1):j]), s[j])) for j in range(1, len(s)))
        out.append((i, held, len(s) - 1, sum(count[w,] > 0 for w in s[1:]), total, base, score))
    return out


def spelling_rows(rows, min_chars=5, min_count=3):
    import zlib
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count and len(w) >= min_chars}
    near = {w: [] for w in n}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    ws = sorted(n)
    for x, a in enumerate(ws):
        for b in ws[:x]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def phrase_rows(rows, threshold=30, top=2000):
    """rows: (lang, text)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            s = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(s)
            for k in range(1, 5):
                for j in range(len(s) - k + 1):
                    f[lang][tuple(s[j:j + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        most = collections.Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for j in range(len(p) - k + 1):
                    most[p[j:j + k]] = max(most[p[j:j + k]], a)
        best = []
        for p, a in cand.items():
            if 100 * most[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out
