"""Loop forms of the mapper's rules, written apart from the operators."""

import math

import numpy as np


def mix(x, k):
    m = (1 << 2 * k) - 1
    x = (~x + (x << 21)) & m
    x ^= x >> 24
    x = (x * 265) & m
    x ^= x >> 14
    x = (x * 21) & m
    x ^= x >> 28
    return (x + (x << 31)) & m


def codes(seq):
    return [(ord(c) & 15) >> 1 for c in seq]


def minimizers(seq, w, k, right=False):
    code, picked = codes(seq), {}
    for s in range(len(seq) - w - k + 2):
        if any(c >= 4 for c in code[s : s + w + k - 1]):
            continue
        best = None
        for i in range(s, s + w):
            f = r = 0
            for j in range(k):
                f = f << 2 | code[i + j]
                r |= (code[i + j] ^ 2) << 2 * j
            if f != r:
                x = (mix(min(f, r), k), -i if right else i, i, int(f > r))
                best = x if best is None or x < best else best
        if best:
            picked[best[2]] = (best[0], best[2] + k - 1, best[3])
    return sorted(picked.values(), key=lambda x: x[1])


def f32(share, x):
    return int(np.float32(share) * np.float32(x))


def mapped(read, keys, p, m):
    """Records of a read, best first, from keys hash -> [(chrom, loc, str)]."""
    anchors = []
    for h, q, s in minimizers(read, p.w, p.k):
        for chrom, t, z in keys.get(h, ()):
            z ^= s
            anchors.append(((chrom << 30) + (t + q if z else t - q + (1 << 21)), q, z))
    anchors.sort()
    if not anchors:
        return []
    return vote(anchors, len(read), m)


def vote(anchors, length, m):
    need, records = f32(m.coverage, length), []

    def push(g, z):
        if g["qe"] - g["qs"] >= need:
            records.append((-g["n"], abs((g["qe"] - g["qs"]) - (g["te"] - g["ts"])), len(records), g["n"], g["qs"], g["qe"], g["ts"], g["te"], z))

    zero = lambda: {"n": 0, "qs": 0, "qe": 0, "ts": 0, "te": 0, "ref": 0}
    state = [zero(), zero()] if m.compat_origin else [None, None]
    for T, q, z in anchors:
        L = T - q if z else T + q - (1 << 21)
        g = state[z]
        if g is not None and T <= g["ref"] + m.distance:
            g["n"] += 1
            if q < g["qs"]:
                g["qs"], g["ref"] = q, T
            g["qe"], g["te"], g["ts"] = max(g["qe"], q), max(g["te"], L), min(g["ts"], L)
        else:
            if g is not None:
                push(g, z)
            state[z] = {"n": 1, "qs": q, "qe": q, "ts": L, "te": L, "ref": T}
    for z in (0, 1):
        if state[z] is not None:
            push(state[z], z)
    best = [x[3:] for x in sorted(records)[: m.top]]
    if len(best) > 1:
        if m.reject_ties and best[0][0] == best[1][0]:
            return []
        low = f32(m.fraction, best[0][0])
        for n in range(1, len(best)):
            if best[n][0] < low:
                return best[:n]
    return best


def paf(name, read, best, targets, k):
    out, u32 = [], (1 << 32) - 1
    for n, (score, qs, qe, ts, te, z) in enumerate(best):
        quality = 0
        if n == 0:
            second = best[1][0] if len(best) > 1 else 0
            quality = min(60, int((1 - second / score) * math.log(score) * min(score, 40)))
        t = targets[ts >> 30]
        start = ((ts & (1 << 30) - 1) - (k - 1)) & u32
        end = te & (1 << 30) - 1
        out.append([name, len(read), (qs - (k - 1)) & u32, qe, "+-"[z], t[0], len(t[1]), start, end, score * k, (end - start) & u32, quality, f"vt:i:{score}"])
    return out


def records(text):
    """(name, bases) of a file of records, byte by byte."""
    at = min((x for x in (text.find(">"), text.find("@")) if x >= 0), default=len(text))
    out = []
    while at < len(text):
        if text[at] == "\n":
            at += 1
            continue
        fastq = text[at] == "@"
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        name = text[at + 1 : end].split(" ")[0]
        at = end + 1
        if fastq:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.append((name, text[at:end]))
            plus = text.find("\n", end + 1)
            at = len(text) if plus < 0 else plus + 1 + (end - at) + 1
        else:
            end = text.find(">", at)
            end = len(text) if end < 0 else end
            out.append((name, text[at:end].replace("\n", "")))
            at = end
    return out
