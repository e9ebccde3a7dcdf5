"""Plain Python versions of the operators' contracts, for small inputs."""

import collections
import hashlib
import re

import xxhash


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


BLANK = " \t\n\x0b\x0c\r"


def lines(docs, min_chars=20, min_docs=3):
    """[(doc_id, n_lines, n_dropped, kept)] for rows (doc_id, text); a null id is below all ids."""
    key = lambda line: low(line.strip(BLANK))
    rank = lambda i: (i is not None, i or 0)
    found, keeper = collections.Counter(), {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                found[k] += 1
                keeper[k] = max(keeper.get(k, (False, 0)), rank(i))
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (found[key(x)] >= min_docs and keeper[key(x)] != rank(i))]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def contamination(docs, bench, width=10):
    """[(doc_id, n_words, n_hit, items)]."""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = rx.findall(low(t or ""))
        k = min(width, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j : j + k])].add(str(i))
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, t in docs:
        w, hit, items = rx.findall(low(t or "")), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if s := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    items |= s
        out.append((i, len(w), len(hit), sorted(items)))
    return out


def statistics(docs):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)]."""
    rx, out = re.compile(r"[^\x20\x09-\x0D]+"), []
    for i, t in docs:
        t = t or ""
        w = rx.findall(t)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cov = {p for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        own = [x for x in t.split("\n") if rx.search(x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)))
    return out


def mix(h, k):
    if k == 0:
        return h
    x = h ^ k * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return [" ".join(w[j : j + width]) for j in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []


def jaccard(a, b, width=5):
    a, b = set(shingles(a, width)), set(shingles(b, width))
    return len(a & b) / len(a | b) if a | b else 1.0


def print_of(text, width, words):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(text, width)]
    out = 0
    for k in range(words):
        m = [mix(x, k) for x in h]
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * sum(x >> b & 1 for x in m) > len(h))
    return out


def wide_print(text):
    return print_of(text, 5, 8)


def roots(prints, radius):
    """The first index of each print's component."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(prints))]


def simhash(docs, width=3, radius=3):
    """[(doc_id, fingerprint hex, component)]."""
    prints = [print_of(t, width, 1) for _, t in docs]
    root, best = roots(prints, radius), {}
    for r, (i, _) in zip(root, docs):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [(i, f"{p:016x}", best.get(r)) for (i, _), p, r in zip(docs, prints, root)]


def one_of_each(docs):
    """The rows that stay: the smallest id of each class of wide prints, nulls last, the earlier row among equals."""
    first = {}
    for at, (r, (i, t)) in enumerate(zip(roots([wide_print(t) for _, t in docs], 94), docs)):
        own = (i is None, i or 0, at, t)
        first[r] = min(first.get(r, own), own)
    return [(None if unnamed else i, t) for unnamed, i, _, t in first.values()]


def personal(text):
    kinds = ["email", "ip", "card", "phone"]
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    t = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))
