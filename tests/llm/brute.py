"""Plain Python forms of the operators' results."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
split = lambda t: (t or "").encode().translate(LOWER).split()


def documents(rows):
    """Distinct rows in the order of ids, then MD5 of the text; null ids last."""
    return sorted(set(rows), key=lambda x: (x[0] is None, x[0] if x[0] is not None else type(next((y for y, _ in rows if y is not None), 0))(), hashlib.md5(x[1].encode()).hexdigest() if x[1] is not None else ""))


def decontaminate(docs, bench, span=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().translate(LOWER).decode())
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(span, len(w))
        if n and i is not None:
            for a in range(len(w) - n + 1):
                windows[tuple(w[a : a + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if g := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    items |= g
        out.append((d, len(w), len(hit), sorted(map(str, items))))
    return sorted(out, key=str)


def simhash(text):
    w = split(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, bits=4):
    fps = [simhash(t) for _, t in docs]
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def statistics(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count = Counter(grams)
        again = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed))
    return sorted(out, key=str)


def repeats(rows, length=100):
    first, found = {}, {}
    for me, (d, t) in enumerate(documents(rows)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], (me, p)) != (me, p):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        found[d, t] = (d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted((found[r] for r in rows), key=str)


def lines(rows):
    sets, inverted, exact, found = [], defaultdict(list), set(), {}
    for d, t in documents(rows):
        own, removed = t.split("\n") if t is not None else [], []
        for i, x in enumerate(own):
            w = frozenset(split(x))
            if not w:
                continue
            hit = w in exact
            if not hit:
                share = Counter(j for token in w for j in inverted[token])
                hit = any(9 * o >= 4 * (len(w) + len(sets[j])) for j, o in share.items())
                for token in w:
                    inverted[token].append(len(sets))
                sets.append(w)
                exact.add(w)
            if hit:
                removed.append(i)
        found[d, t] = (d, len(own), removed, None if t is None else "\n".join(x for i, x in enumerate(own) if i not in removed))
    return sorted((found[r] for r in rows), key=str)


def features(text):
    """The statistics that quality rules test, by name."""
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, n = max(1, sum(map(len, w))), max(1, len(w))
    repeated = statistics([(0, text)])[0][5]
    return {
        "word_length": sum(map(len, w)) / n, "symbol_share": len(re.findall(r"[#*$%&|<>]", text)) / chars, "stutter_share": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        "upper_share": len(re.findall("[A-Z]", text)) / chars, "repeat_share": repeated / n, "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }


def mixture(docs, weights, budget, seed):
    """Places of the rows (id, text, *levels) that one pass takes; weights: a function of each level's value."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = [f"{'null' if d is None else d}-{'null' if t is None else md5(t)}" for d, t, *_ in docs]
    sizes = [len([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]) for _, t, *_ in docs]

    def fill(rows, depth, amount):
        if depth == len(weights):
            more, run, taken = math.floor(amount), 0, []
            whole = more == sum(sizes[i] for i in rows) > 0
            for i in sorted(rows, key=lambda i: (md5(f"{seed}-{int(whole)}-{names[i]}")[:15], names[i], sizes[i])):
                taken += [i] * (whole or run + sizes[i] <= more)
                run += sizes[i]
            return taken
        by = defaultdict(list)
        for i in rows:
            by[docs[i][2 + depth]].append(i)
        cap = {k: sum(sizes[i] for i in v) for k, v in by.items()}
        order = sorted(by, key=lambda k: (cap[k] / weights[depth](k), k is not None, k or ""))
        taken, rest = [], sum(map(weights[depth], by))
        for n, k in enumerate(order):
            if cap[k] * rest > amount * weights[depth](k):
                for x in order[n:]:
                    taken += fill(by[x], depth + 1, amount * weights[depth](x) / rest)
                break
            taken += fill(by[k], depth + 1, cap[k])
            amount, rest = amount - cap[k], rest - weights[depth](k)
        return taken

    return set(fill(range(len(docs)), 0, float(sum(sizes) * budget[0] // budget[1])))


def kneser_ney(docs, discounts):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    grams = lambda w: zip(["begin", "begin", *w][: len(w)], ["begin", *w[:-1]], w, strict=True)
    uni, tri = Counter(), Counter()
    for d, t in docs:
        if not held(d):
            w = [*split(t), None]
            uni.update(w)
            tri.update(grams(w))
    total, size = sum(uni.values()), len(uni)
    fours = lambda c: [sum(1 for x in c.values() if x == i) for i in (1, 2, 3, 4)]
    bi = Counter()
    for (_, v, w), c in tri.items():
        bi[v, w] += c if v == "begin" else 1
    before = Counter(w for _, w in bi)
    d3, d2, d1 = ([0, *discounts(fours(x))] for x in (tri, bi, before))

    def sums(of):
        mass, kinds = Counter(), defaultdict(lambda: [0] * 4)
        for (*v, _), c in of.items():
            mass[tuple(v)] += c
            kinds[tuple(v)][min(c, 3)] += 1
        return mass, kinds

    (mass3, kinds3), (mass2, kinds2) = sums(tri), sums(bi)
    rest = sum(d1[min(c, 3)] for c in before.values()) / len(bi)

    def p(u, v, w):
        low = (before[w] - d1[min(before[w], 3)]) / len(bi) + rest / (size + 1)
        for d, mass, kinds, of, context in ((d2, mass2, kinds2, bi, (v,)), (d3, mass3, kinds3, tri, (u, v))):
            if mass[context]:
                c = of[*context, w]
                low = (c - d[min(c, 3)]) / mass[context] + sum(d[i] * kinds[context][i] for i in (1, 2, 3)) / mass[context] * low
        return low

    out = []
    for d, t in docs:
        w = [*split(t), None]
        out.append((d, held(d), len(w), sum(1 for x in w if uni[x]), total, sum(math.log10((uni[x] + 1) / (total + size + 1)) for x in w), sum(math.log10(p(*g)) for g in grams(w))))
    return out, [sum(p(*v, w) for w in [*uni, "unknown"]) for v in list(mass3)[:3]]
