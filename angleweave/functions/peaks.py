"""Peak counting on one chain, in numpy alone, so that Python workers import no session code."""

from __future__ import annotations


def peaks(x) -> int:
    """3-point mean, peaks of a prominence of at least the median that stand 3 apart or more, highest first."""
    import numpy as np

    s = np.convolve(x, np.ones(3) / 3, mode="same")
    n, tops, k = len(s), [], 1
    while k < n - 1:
        if s[k - 1] < s[k]:
            e = k
            while e + 1 < n and s[e + 1] == s[k]:
                e += 1
            if e + 1 < n and s[e + 1] < s[k]:
                tops.append((k + e) // 2)
            k = e
        k += 1
    kept = dict.fromkeys(tops, True)
    for p in sorted(tops, key=lambda p: s[p])[::-1]:
        if kept[p]:
            kept |= {q: False for q in tops if q != p and abs(q - p) < 3}
    least, found = np.median(s), 0
    for p in (p for p in tops if kept[p]):
        left, right = p, p
        lo, ro = s[p], s[p]
        while left >= 0 and s[left] <= s[p]:
            lo = min(lo, s[left])
            left -= 1
        while right < n and s[right] <= s[p]:
            ro = min(ro, s[right])
            right += 1
        found += s[p] - max(lo, ro) >= least
    return found
