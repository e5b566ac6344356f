"""Suffix arrays of byte strings by induced sorting, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour.  The leftmost S suffixes of each run are
sorted by their substrings, and all others are induced from them in two linear passes, bucket by bucket: every entry of
a bucket names its predecessor's place, so that a whole bucket is induced at once.  Where substrings repeat, the order of
the leftmost S suffixes comes from the string of substring names, whose ranks are doubled until they cover ``depth``
bytes; suffixes that agree in so many bytes may stand in any order.
"""

from __future__ import annotations

import numpy as np



def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded.tobytes(), ">u8", (len(padded) - k) // 8, k)
        own = out[k::8]
        own[:] = part[: len(own)]
    return out[: len(data)]


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last one is followed by the empty suffix and so is L."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    # Equal neighbours take the type of the next place where they differ.
    at = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order."""
    n, sigma = len(text), 256
    size = np.bincount(text, minlength=sigma)
    end = np.cumsum(size)
    begin = end - size
    order = np.full(n, -1, np.int64)

    lead = text[leftmost]
    seeds = [leftmost[lead == c] for c in range(sigma)]
    head = begin.copy()

    def put(places: np.ndarray) -> np.ndarray:
        """Larger suffixes at their buckets' fronts, in the order given; returns those that are in bucket ``c``."""
        chars = text[places]
        rank = np.argsort(chars, kind="stable")
        moved, count = places[rank], np.bincount(chars, minlength=sigma)
        first = np.cumsum(count) - count
        used = chars[rank].astype(np.int64)
        order[head[used] + np.arange(len(moved)) - first[used]] = moved
        head[:] += count
        return places[chars == c]

    def before(entries: np.ndarray, kind: bool) -> np.ndarray:
        places = entries[entries > 0] - 1
        return places[small[places] == kind]

    start = np.array([n - 1])  # the suffix before the empty one
    c = -1
    put(start)
    for c in range(sigma):
        front = order[begin[c] : head[c]]
        while len(front):
            front = put(before(front, False))
        if len(seeds[c]):
            put(before(seeds[c], False))

    tail = end.copy()

    def put_back(places: np.ndarray) -> np.ndarray:
        """Smaller suffixes at their buckets' backs, from the last on."""
        chars = text[places]
        rank = np.argsort(chars, kind="stable")
        moved, count = places[rank], np.bincount(chars, minlength=sigma)
        first = np.cumsum(count) - count
        used = chars[rank].astype(np.int64)
        order[tail[used] - 1 - (np.arange(len(moved)) - first[used])] = moved
        tail[:] -= count
        return places[chars == c]

    for c in range(sigma - 1, -1, -1):
        front = order[tail[c] : end[c]][::-1]
        while len(front):
            front = put_back(before(front, True))
        larger = order[begin[c] : head[c]][::-1]
        if len(larger):
            put_back(before(larger, True))
    return order


def same_substrings(words: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the substrings at ``a`` and ``b`` are equal, eight bytes at a time."""
    same = size_a == size_b
    at = 0
    live = np.flatnonzero(same)
    while len(live):
        left = np.minimum(size_a[live] - at, 8)
        drop = (np.uint64(8) * (8 - left).astype(np.uint64)).astype(np.uint64)
        x, y = (words[np.minimum(p[live] + at, len(words) - 1)] >> drop for p in (a, b))
        equal = x == y
        same[live[~equal]] = False
        at += 8
        live = live[equal & (size_a[live] > at)]
    return same


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (bytes) in the order of their suffixes, exact in their first ``depth`` bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = classify(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(leftmost):
        return induce(text, small, leftmost)
    # First pass: sorts the leftmost S substrings.
    order = induce(text, small, leftmost)
    mark = np.zeros(n, bool)
    mark[leftmost] = True
    ranked = order[mark[order]]
    size = np.empty(n, np.int64)
    size[leftmost] = np.diff(np.append(leftmost, n - 1)) + 1
    words = eight_bytes(text)
    new = np.ones(len(ranked), bool)
    new[1:] = ~same_substrings(words, ranked[1:], ranked[:-1], size[ranked[1:]], size[ranked[:-1]])
    name = np.empty(n, np.int64)
    name[ranked] = np.cumsum(new)
    names = name[leftmost]
    covered = 1  # names that ranks tell apart; each spans two bytes at least
    while covered * 2 < depth + 2 and names.max() < len(names):
        pair = names * (len(names) + 2)
        pair[:-covered] += names[covered:] if covered < len(names) else 0
        _, names = np.unique(pair, return_inverse=True)
        names = names + 1
        covered *= 2
    return induce(text, small, leftmost[np.argsort(names, kind="stable")])


def permuted_match(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each position, whether it agrees with the position before it in ``order`` in ``length`` bytes: the permuted
    common prefixes, cut at ``length``.  Positions are compared in text order; those outside ``order`` agree with none."""
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    words = eight_bytes(text)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = at[words[np.minimum(at + k, len(words) - 1)] == words[np.minimum(before[at] + k, len(words) - 1)]]
    out = np.zeros(len(text), bool)
    out[at] = True
    return out
