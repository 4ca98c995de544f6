"""Peak calling on dense arrays, position by position, as the semantics are laid down: what the library is held against.

Arrays have one place for each position from 0 to l; place 0 is 0.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

LOG_0 = -(2.0**30)


def dense(runs, l):
    x = np.zeros(l + 1)
    for s, e, v in runs:
        x[s : e + 1] = v
    return x


def tail(signal, control, flip=0.5):
    """ln of the lower binomial tail of the whole part of control in trunc(signal + control) throws."""
    n, total = int(signal + control), LOG_0
    for i in range(int(control) + 1):
        term = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + n * math.log(flip)
        total = np.logaddexp(total, term)
    return float(total)


def median(x, half, skip=None):
    l, out = len(x) - 1, np.zeros(len(x))
    for i in range(1, l + 1):
        w = sorted(int(v) for v in x[max(1, i - half) : min(l, i + half) + 1] if skip is None or v != skip)
        out[i] = w[len(w) // 2] if w else 0
    return out


def mappable(x, mapp, window, most):
    masked = x.copy()
    for i in range(1, len(x)):
        if i < len(mapp) - 1 and mapp[i] > most:
            masked[i] = -1
    return np.maximum(median(masked, window // 2, -1), x)


def extrema(x):
    """(place, is maximum, height) of plateaus and points of x[0..n-1], with the two posts."""
    n, found, a = len(x), [], 0
    runs = []
    for i in range(1, n + 1):
        if i == n or x[i] != x[a]:
            runs.append((a, i - 1))
            a = i
    for k in range(1, len(runs) - 1):
        (a, b), left, right = runs[k], x[runs[k][0] - 1], x[runs[k][1] + 1]
        if (left < x[a]) == (right < x[a]):
            found.append(((a + b + 1) // 2, left < x[a], x[a]))
    if len(found) < 2:
        return []
    return [(0, not found[0][1], x[0]), *found, (n - 1, not found[-1][1], x[-1])]


def minima_regions(x, scale, gamma):
    l, half = len(x) - 1, int(scale) // 2
    y = median(x, half)
    lows = [p for p, top, _ in extrema(y[:l]) if not top]
    out = []
    for a, b in zip(lows, lows[1:]):
        raw = x[max(1, a - half) : min(l, b + half) + 1].max(initial=0.0)
        if y[a : b + 1].max(initial=0.0) >= raw / gamma:
            out.append((a, b))
    return out


def scales(start, end, step):
    s, out = 1.0, []
    while True:
        if s >= start:
            out.append(s)
            if s >= end:
                return out
        s *= step


def merge(regions, gap):
    out = []
    for s, e in sorted(regions):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(r) for r in out]


def thresholds(x, fdr, width, first=1):
    """[(begin, length, threshold)] of the windows."""
    l, out, at = len(x) - 1, [], first
    while at < l:
        n = l - at if at + width > l else width
        mass = x[max(at, 1) : min(at + n, l) + 1].sum()
        top = int(x[at : min(at + n, l)].max(initial=0.0))
        t, rate, cdf, term = 0, mass / n, None, None
        if mass > 0:
            cdf = term = -rate
            for k in range(1, top + 1):
                term += math.log(rate) - math.log(k)
                cdf = np.logaddexp(cdf, term)
                if cdf > math.log(1 - fdr):
                    t = k
                    break
        out.append((at, n, t))
        at += width
    return out


def tune(regions, x, fdr, width, by):
    l = len(x) - 1
    value = lambda p: x[p] if p <= l else 0.0
    out = [list(r) for r in regions]
    done = set()
    for at, n, t in thresholds(x, fdr, width):
        for k, r in enumerate(out):
            if t > 0 and at <= r[0] < at + n and k not in done:
                done.add(k)
                if value(r[0]) >= t:
                    r[0] = max(r[0] - by, 1)
                elif value(r[1]) >= t:
                    r[1] = min(r[1] + by, l)
    return [tuple(r) for r in out]


def rd_trim(regions, x, fdr, width):
    l, out = len(x) - 1, []
    for at, n, t in thresholds(x, fdr, width):
        for s, e in regions:
            if t > 0 and at <= s < at + n:
                above = [p for p in range(s, min(e, l - 1) + 1) if x[p] > t]
                if above:
                    out.append((above[0], above[-1]))
    return out


def median_kept(regions, x, fdr, width):
    out = []
    for at, n, t in thresholds(x, fdr, width, 0):
        for s, e in regions:
            if t > 0 and at <= s < at + n:
                w = sorted(x[p] if p < len(x) else 0.0 for p in range(s, e + 1))
                if w[len(w) // 2] > t:
                    out.append((s, e))
    return out


def p_trim(regions, x, y, fragment, modified=False):
    out = []
    for s, e in regions:
        if e > len(y) - 1:
            continue
        at = lambda a, b: np.array([x[p] if p < len(x) else 0.0 for p in range(a, b + 1)])
        region, tried = at(s, e), []
        for t in range(int(math.floor(region.min())), min(int(math.floor(region.max())), 500) + 1):
            above = [k for k, v in enumerate(region) if v > t]
            a, b = (s + above[0], s + above[-1]) if above else (s, e)
            c = np.floor(y[a : b + 1]) if modified else y[a : b + 1]
            tried.append((tail(np.floor(at(a, b)).sum() / fragment, c.sum() / fragment), a, b))
            if region.sum() > 0 and at(a, b).sum() / region.sum() <= 0.5:
                break
        out.append(next(k[1:] for k in tried if k[0] <= min(t[0] for t in tried) + 1e-10))
    return out


def grid(regions, x, y, fragment, least, share=40):
    out = []
    for s, e in regions:
        if e > len(y) - 1:
            continue
        value = lambda a, b: np.array([x[p] if p < len(x) else 0.0 for p in range(a, b + 1)])
        step, total, tried = max(least, (e - s) // share), value(s, e).sum(), []
        for a in range(s, e + 1, step):
            if not total or value(a, e).sum() / total < 0.5:
                break
            for b in range(a + step, e, step):
                if value(a, b).sum() / total > 0.5:
                    p = tail(np.floor(value(a, b)).sum() / fragment, y[a : b + 1].sum() / fragment)
                    tried.append((p, a, b))
        out.append(next((k[1:] for k in tried if k[0] <= min(t[0] for t in tried) + 1e-10), (s, e)))
    return out


def vicinity(s, e, x, y, fragment, norm, reach=1):
    l = len(y) - 1
    signal, length = np.floor(x[s : e + 1]).sum(), e - s + 1
    a, b = (s, e) if length > norm else ((s + e) // 2 - norm, (s + e) // 2 + norm)
    a, b = 1 if a < 0 else a, min(b, l)
    if b <= a:
        return 0.0
    width, top, at = b - a, 0.0, max(1, a - reach * (b - a))
    while at < min(l, b + reach * width):
        top = max(top, y[at : min(l, at + width) + 1].sum())
        at += width
    c, v = top * length / (width + 1) / fragment, signal / fragment
    if length > norm:
        v, c = v / (length / norm), c / (length / norm)
        c = 1.0 if math.floor(c) == 0 else c
        if math.floor(v) == 0:
            return 0.0
    return tail(v, c)


def strongest(s, e, x, y, fragment, norm, reach=3):
    l, length = len(y) - 1, e - s + 1
    value = lambda z, a, b: sum(z[p] if p < len(z) else 0.0 for p in range(a, b))
    whole = np.floor(x)
    if length > norm:
        signal, at = value(whole, s, s + norm), s
        while True:
            at += 1
            signal = max(signal, value(whole, at, at + norm))
            if at + norm >= e:
                break
    else:
        signal, norm = value(whole, s, e + 1), e - s
    a, b = max(1, s - reach * length), min(l, e + reach * length)
    if a + norm > l:
        return 0.0
    control, at = value(y, a, a + norm), a
    while True:
        at += 1
        control = max(control, value(y, at, at + norm))
        if at + norm >= b:
            break
    v, c = signal / fragment, control / fragment
    c = 1.0 if math.floor(c) == 0 else c
    return 0.0 if math.floor(v) == 0 else tail(v, c)


def summit(s, e, x, y):
    """chip mass, control mass, greatest chip and control, place."""
    top, place, begin = 0.0, 0, 0
    for i in range(s + 1, e + 1):
        now, before = int(x[i]), int(x[i - 1])
        if now > before:
            begin = i
        if now < before:
            if top < before:
                top, place = float(before), (i - 1 + begin) // 2
            begin = i
    return np.floor(x[s + 1 : e + 1]).sum(), np.floor(y[s + 1 : e + 1]).sum(), top, float(np.floor(y[s + 1 : e + 1]).max(initial=0.0)), place


def trough(s, e, x, mapp, most, width=100):
    found = extrema(x[s : e + 1])
    highs = sorted(((p, h) for p, top, h in found if top), key=lambda m: (-m[1], m[0]))
    lows = sorted(((p, h) for p, top, h in found if not top), key=lambda m: (m[1], m[0]))
    if not highs or not lows:
        return 0
    worst = 2 * len(highs) + len(lows)
    ranks = []
    for k, (p, _) in enumerate(lows):
        left, right = ([i for i, m in enumerate(highs) if side(m[0])] for side in (lambda q: q < p, lambda q: q > p))  # noqa: B023
        bad = mapp is not None and sum(mapp[s + i] if s + i < len(mapp) else 0.0 for i in range(max(0, p - width // 2), p + width // 2)) / width >= most
        ranks.append(k + left[0] + right[0] if left and right and not bad else worst)
    best = min(range(len(lows)), key=lambda k: (min(ranks[k], worst), k))
    return s + lows[best][0]


def background(x, window, fragment, mean_window, step=0.05, most=500, target=0.1, enough=100):
    l, half = len(x) - 1, mean_window // 2
    y = np.zeros(len(x))
    for i in range(1, l + 1):
        y[i] = max(1.0, x[max(1, i - half) : min(l, i + half) + 1].mean())
    wins = [(x[k * window + 1 : k * window + window].sum(), y[k * window + 1 : k * window + window].sum()) for k in range(l // window)]
    many = False
    for k in range(most + 1):
        n = defaultdict(int)
        for a, b in wins:
            b += k * window * step
            if a >= window and b >= window:
                sig = tail(int(a / fragment), int(b / fragment)) < math.log(0.05)
                n[sig, 1 if a / b > 2 else -1 if a / b < 1.5 else 0] += 1
        pp, pi, ip = n[True, 1], n[True, -1], n[False, 1]
        many |= pp + ip > enough and pp + pi > enough
        over = pp + ip > 0 and ip / (pp + ip) > target
        under = pp + pi > 0 and pi / (pp + pi) < target
        if k == most or many and not over and not under:
            break
    y[1:l] += k * step
    return y


def benjamini_hochberg(ps):
    order = sorted(range(len(ps)), key=lambda k: ps[k])
    return {k: ps[k] + math.log(len(ps) / (r + 1)) for r, k in enumerate(order)}


def scale_regions(x, y, mapp, p):
    """[(scale, start, end)]: the significant regions of each scale."""
    smooth = x if mapp is None else mappable(x, mapp, p.mappability_window, p.mappability_limit)
    base = median(smooth, int(p.scale_start) // 2)
    l = len(x) - 1
    n = l // p.bin_width
    bins = np.array([0.0, *(base[k * p.bin_width + 1 : (k + 1) * p.bin_width + 1].sum() for k in range(n))])
    kept = []
    for scale in scales(p.scale_start / p.bin_width, p.scale_end / p.bin_width, p.scale_step):
        found = [(a * p.bin_width, b * p.bin_width) for a, b in minima_regions(bins, scale, p.gamma)]
        found = merge(tune(found, x, p.tune_fdr, p.poisson_window, p.tune_by), -2 * p.bin_width)
        for s, e in p_trim(rd_trim(found, x, p.rd_fdr, p.poisson_window), x, y, p.fragment):
            log_p = vicinity(s, e, x, y, p.fragment, p.window) if e < len(y) - 1 and e < l else 0.0
            if log_p < math.log(p.q if p.p_cutoff is None else p.p_cutoff) and (not p.filter_length or e - s > p.scale_start):
                kept.append((scale * p.bin_width, s, e))
    return kept


def scale_spectrum(x, y, p):
    """[(scale, number, coverage)]: merged regions of all scales by the largest scale with a region that overlaps them."""
    found = scale_regions(x, y, None, p)
    rows = {s * p.bin_width: [0, 0] for s in scales(p.scale_start / p.bin_width, p.scale_end / p.bin_width, p.scale_step)}
    for a, b in merge([(s, e) for _, s, e in found], 0):
        row = rows[max(k for k, s, e in found if s <= b and a <= e)]
        row[0] += 1
        row[1] += b - a + 1
    return [(k, n, c) for k, (n, c) in rows.items()]


def call(chips, controls, strands, reads, p, mapps=None):
    """[(chrom, start, end, summit, trough, chip mass, control mass, log_p, log_q)]. chips, controls: {chrom: array}, the latter scaled;
    strands: {(chrom, strand): array}; reads: {chrom: (forward, reverse)}."""
    peaks, share = [], p.strand_share
    for chrom in sorted(chips):
        x, y, mapp = chips[chrom], controls[chrom], (mapps or {}).get(chrom)
        l = len(x) - 1
        if share is None:
            f, r = reads[chrom]
            share = min(f / r, r / f) / 2 if f and r else 0.0
        kept = [(s, e) for _, s, e in scale_regions(x, y, mapp, p)]
        regions = rd_trim(merge(kept, 1), x, p.rd_fdr, p.poisson_window)
        if p.trim_after_merge:
            regions = p_trim(regions, x, y, p.fragment, True)
        for s, e in regions:
            f, r = (max(strands[chrom, k][s : e + 1].sum(), 0.0) or 1.0 for k in "FR")
            if not (f / r > share and r / f > share):
                continue
            log_p, marks = 0.0, (0.0, 0.0, 0.0, 0.0, 0)
            if e < len(y) - 1 and e < l:
                marks = summit(s, e, x, y)
                log_p = strongest(s, e, x, y, p.fragment, p.window) if p.peak_mode else vicinity(s, e, x, y, p.fragment, p.window)
            peaks.append((chrom, s, e, marks[4], trough(s, e, x, mapp, p.mappability_limit) if p.trough else 0, marks[0], marks[1], log_p))
    q = benjamini_hochberg([k[-1] for k in peaks])
    return [(*peak, q[k]) for k, peak in enumerate(peaks) if q[k] < math.log(p.q)]
