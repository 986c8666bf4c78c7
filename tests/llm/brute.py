"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_groups(rows, k, percent=80):
    """rows of (doc_id, text) to {doc_id: (n_shingles, component_id)}; doc_id unique."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = set()
    for held in holders.values():
        pairs.update((a, b) for i, a in enumerate(held) for b in held[:i])
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """[(kind, start, end)] as the contract of op4 has them."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, good in tests for m in pattern.finditer(text) if good(m)]


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed as the contract of op1 has them."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def lm_scores(rows, order=2):
    """[(n_words, score)] for texts, by dictionaries of n-grams."""
    import math
    from collections import Counter

    texts = [WORD.findall(lower(t)) for t in rows]
    count = Counter(tuple(t[i : i + n]) for t in texts for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(map(len, texts))

    def log_s(gram):
        if len(gram) == 1:
            return math.log(count[gram] / total)
        if count[gram] >= 2:
            return math.log(count[gram] / count[gram[:-1]])
        return math.log(0.4) + log_s(gram[1:])

    return [(len(t), sum(log_s(tuple(t[max(0, i - order + 1) : i + 1])) for i in range(len(t))) / len(t) if t else None) for t in texts]


KINDS = ("email", "ip", "card", "phone")


def occurrences(text):
    """[(start, end, instance, seed kind or None, patterns)] as the docstring of private_data has them."""
    import regex

    text = text or ""
    spans = base_spans(text)
    all_words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    marked = [i for i, w in enumerate(all_words) if regex.search(r"[0-9@_\p{Lu}]", w[2])]

    def patterns(i, j):
        near = lambda k, edge: all_words[k][2].lower() if 0 <= k < len(all_words) else edge
        return [f"l {near(i - 2, '^')} {near(i - 1, '^')}", f"b {near(i - 1, '^')} _ {near(j + 1, '$')}"]

    out = []
    for kind, a, b in spans:
        inside = [i for i in marked if all_words[i][1] > a and all_words[i][0] < b]
        out.append((a, b, text[a:b].lower(), KINDS.index(kind), patterns(inside[0], inside[-1])))
    trimmed = []
    for i in marked:
        start, end, w = all_words[i]
        core = regex.sub(r"[^\p{L}0-9]+$", "", (bare := regex.sub(r"^[^\p{L}0-9+@]+", "", w)))
        a = start + len(w) - len(bare)
        free = not any(s < a + len(core) and a < e for _, s, e in spans)
        leads = free and regex.search(r"^[^\p{L}0-9+@]*(?:[A-Z]{2}(?=[0-9]{2}$)|\+?)\(?[0-9][0-9().-]*(?<=[0-9)])$", w)
        follows = free and i and text[all_words[i - 1][1] : start] == " " and regex.search(r"^\(?[0-9][0-9().-]*[^\p{L}0-9@]*$", w)
        trimmed.append((i, a, a + len(core), free, start if w[0] == "(" else a, leads, follows))
    k = 0
    while k < len(trimmed):
        last = k
        while last + 1 < len(trimmed) and trimmed[last + 1][6] and trimmed[last][5] and trimmed[last + 1][0] == trimmed[last][0] + 1:
            last += 1
        i, a, _, free, opened, _, _ = trimmed[k]
        a, b = a if last == k else opened, trimmed[last][2]
        if free and a < b:
            secret = last == k and re.fullmatch("[0-9a-f]{32,}", text[a:b]) and re.search("[0-9]", text[a:b]) and re.search("[a-f]", text[a:b])
            out.append((a, b, text[a:b].lower(), 4 if secret else None, patterns(i, trimmed[last][0])))
        k = last + 1
    return out


def discovered(texts, min_seeds=3, min_worth=0.7):
    """For each text the sorted [(kind, start, end)] that trusted patterns add."""
    from collections import Counter

    each = [occurrences(t) for t in texts]
    edges = Counter((p, o[2]) for os in each for o in os for p in o[4])
    known = {}
    for os in each:
        for o in os:
            if o[3] is not None:
                known[o[2]] = (min(o[3], known.get(o[2], (9,))[0]), 1.0)
    while True:
        totals, sums, seeds = Counter(), Counter(), Counter()
        for (p, x), n in edges.items():
            totals[p] += n
            if x in known:
                sums[p, known[x][0]] += n * known[x][1]
                seeds[p, known[x][0]] += 1
        trusted = {}
        for (p, kind), s in sums.items():
            worth = s / (totals[p] + 1)
            if seeds[p, kind] >= min_seeds and worth >= min_worth:
                trusted[p] = max(trusted.get(p, (0, -9)), (worth, -kind))
        new = {}
        for p, x in edges:
            if p in trusted and x not in known:
                new[x] = max(new.get(x, (0, -9)), trusted[p])
        if not new:
            break
        known.update({x: (-k, w) for x, (w, k) in new.items()})
    out = []
    for os in each:
        found = [(max((trusted[p] for p in o[4] if p in trusted), default=None), o) for o in os if o[3] is None]
        found += [((1.0, -4), o) for o in os if o[3] == 4]
        out.append(sorted((-best[1], o[0], o[1]) for best, o in found if best))
    return out


def fingerprint(text, size, bound):
    """[(hash, position)] of closed syncmers: windows of 4 words whose least 2-word hash (signed) is the first's or the last's."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda *hs: _chain(struct, xxhash, hs)
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    s = [chain(a, b) for a, b in zip(h, h[1:], strict=False)]
    mask = (1 << 48) - 1
    if len(s) < 3:
        found = [(chain(*h) & mask, 0)] if h else []
    else:
        found = [(chain(s[i], s[i + 2]) & mask, i) for i in range(len(s) - 2) if s[i + 1] >= min(s[i], s[i + 2])]
    least = {}
    for x, i in found:
        least.setdefault(x, i)
    out = sorted(least.items())
    return out[: max(size, sum(x < bound for x, _ in out))]


def _chain(struct, xxhash, hs):
    seed = 42
    for x in hs:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def positional_likeness(a, b, size, bound):
    """Share of anchors that two or more others share the difference of places with, among those that both fingerprints cover."""
    from collections import Counter

    if not a or not b:
        return float(not a and not b)
    union = sorted({x for x, _ in a} | {x for x, _ in b})
    covered = union[: max(size, sum(x < bound for x in union))]
    at, other = dict(a), dict(b)
    shifts = Counter(other[x] - at[x] for x in covered if x in at and x in other)
    return sum(n for n in shifts.values() if n >= min(2, len(covered))) / len(covered)


def classifier_features(text, bits, scale):
    """{bucket: value} of one text as the docstring of quality_model has them, word by word. Only the hash of a single word is the library's."""
    import numpy as np

    from voicegrain.llm.hashing import mix, word_hashes

    full = (1 << 64) - 1
    mixed = lambda x: int(mix(np.array([x & full], np.uint64))[0])
    spoken = [w.encode() for w in WORD.findall(text or "")]
    hashes = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in spoken]
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 4
    shapes = []
    for i, w in enumerate(spoken):
        again = sum(1 << back for back in (1, 2) if i >= back and hashes[i] == hashes[i - back])
        shouted = int(len(w) > 2 and not any(97 <= b <= 122 for b in w))
        ending = {2: 97, 3: 48}.get(kind(w[-1]), w[-1])
        shapes.append(mixed((((kind(w[0]) * 256 + ending) * 2 + shouted) * 8 + again) ^ 0xA5A5A5A5A5A5))
    out = defaultdict(float)
    for number, grams in enumerate((hashes, shapes)):
        pairs = [mixed(a * 3 + b + number) for a, b in zip(grams, grams[1:], strict=False)]
        for found in (grams, pairs):
            for g in found:
                out[g & ((1 << bits) - 1)] += scale / len(found)
    return dict(out)


def ftrl(rows, size, epochs=6, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-4):
    """FTRL-proximal, one weight at a time; rows of ({bucket: value}, label), the last weight is the bias."""
    import math

    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for row, label in rows:
            values = {**row, size: 1.0}
            w = {i: weight(i) for i in values}
            wx = max(-30.0, min(30.0, sum(w[i] * x for i, x in values.items())))
            error = 1 / (1 + math.exp(-wx)) - label
            for i, x in values.items():
                g = error * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]
