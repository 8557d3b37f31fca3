"""Suffix arrays by induced sorting, recursively, and permuted common prefixes.

Bytes have few and large buckets, which numpy fills whole; names of substrings have many and small ones, and long runs of one
symbol take one step a place, so that these are filled place by place. Both are the same linear scans.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size, without runs of a symbol longer than this, are induced bucket by bucket; others place by place.
BUCKETS, RUN = 600, 2_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last is larger than the empty suffix (L type)."""
    n = len(s)
    step = np.sign(np.append(s[1:], -1).astype(np.int64) - s)
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return step[np.minimum(nearest, n - 1)] > 0


def _place(sa: np.ndarray, s: np.ndarray, found: np.ndarray, ends: np.ndarray, sign: int) -> None:
    """Put found suffixes, in order, at the heads (sign 1) or tails (sign -1) of their buckets."""
    c = s[found]
    order = np.argsort(c, kind="stable")
    c = c[order]
    n = np.bincount(c, minlength=len(ends))
    rank = np.arange(len(c)) - (np.cumsum(n) - n)[c]
    sa[ends[c] + sign * rank] = found[order]
    ends += sign * n


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order of ``seeds``."""
    count = np.bincount(s, minlength=k)
    first = np.cumsum(count) - count
    last = first + count - 1
    sa = np.full(len(s), -1, np.int64)
    seed_of = np.argsort(s[seeds], kind="stable")
    by_char = seeds[seed_of]
    cut = np.searchsorted(s[by_char], np.arange(k + 1))
    used = np.flatnonzero(count)
    head = first.copy()
    end = np.array([len(s) - 1])
    if not small[end[0]]:
        _place(sa, s, end, head, 1)
    for c in used.tolist():  # larger suffixes, from small characters up
        done = int(first[c])
        while done < head[c]:
            wave = sa[done : head[c]]
            done = int(head[c])
            before = wave[wave > 0] - 1
            _place(sa, s, before[~small[before]], head, 1)
        wave = by_char[cut[c] : cut[c + 1]]
        before = wave[wave > 0] - 1
        _place(sa, s, before[~small[before]], head, 1)
    tail = last.copy()
    for c in used[::-1].tolist():  # smaller suffixes, from large characters down
        done = int(last[c])
        while done > tail[c]:
            wave = sa[int(tail[c]) + 1 : done + 1][::-1]
            done = int(tail[c])
            before = wave[wave > 0] - 1
            _place(sa, s, before[small[before]], tail, -1)
        wave = sa[int(first[c]) : int(head[c])][::-1]
        before = wave[wave > 0] - 1
        _place(sa, s, before[small[before]], tail, -1)
    return sa


def induce_places(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The same place by place, for many buckets or long runs."""
    count = np.bincount(s, minlength=k)
    ends = np.cumsum(count)
    head, tail = (ends - count).tolist(), (ends - 1).tolist()
    text, is_small, n = s.tolist(), small.tolist(), len(s)
    sa = [-1] * n
    for j in seeds[::-1].tolist():
        c = text[j]
        sa[tail[c]] = j
        tail[c] -= 1
    if not is_small[n - 1]:
        c = text[n - 1]
        sa[head[c]] = n - 1
        head[c] += 1
    for i in range(n):  # larger suffixes, from small ones up; sa grows ahead of i
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = (ends - 1).tolist()
    for i in range(n - 1, -1, -1):  # smaller suffixes, from large ones down
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            sa[tail[c]] = j
            tail[c] -= 1
    return np.array(sa, np.int64)


def longest_run(s: np.ndarray) -> int:
    cuts = np.flatnonzero(s[1:] != s[:-1])
    return int(np.diff(np.concatenate(([-1], cuts, [len(s) - 1]))).max()) if len(s) else 0


def prefix_sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(s) + 1
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    salt = (s.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
    salt ^= salt >> _U(29)
    salt *= _U(0xBF58476D1CE4E5B9)
    total = np.zeros(n, np.uint64)
    np.cumsum((salt ^ (salt >> _U(32))) * powers[0][:-1], out=total[1:])
    return total, powers[1]


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffixes of s (symbols 0 to k - 1) in order."""
    if len(s) < 2:
        return np.arange(len(s))
    sort = induce if k <= BUCKETS and longest_run(s) <= RUN else induce_places
    small = types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        # substrings from one leftmost-smaller place to the next are sorted by inducing from any order
        sa = sort(s, small, lms, k)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        sorted_lms = sa[is_lms[sa]]
        total, down = prefix_sums(s)
        stop = np.append(lms[1:] + 1, len(s))
        finger = (total[stop] - total[lms]) * down[lms]
        size = stop - lms
        slot = np.empty(len(s), np.int64)
        slot[lms] = np.arange(len(lms))
        q = slot[sorted_lms]
        names = np.empty(len(lms), np.int64)
        names[q] = np.concatenate(([0], np.cumsum((finger[q][1:] != finger[q][:-1]) | (size[q][1:] != size[q][:-1]))))
        # the text of names is half as long at most
        if names[q[-1]] + 1 < len(lms):
            lms = lms[suffix_array(names, int(names.max()) + 1)]
        else:
            lms = sorted_lms
    return sort(s, small, lms, k)


def extend(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at i and at j, compared symbol by symbol in blocks that grow."""
    out = np.zeros(len(i), np.int64)
    room = len(s) - np.maximum(i, j)
    open_, block = np.flatnonzero(room > 0), 16
    while len(open_):
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate((s, np.full(block, -1, s.dtype))), block)
        rest = []
        for at in range(0, len(open_), 1 << 17):
            part = open_[at : at + (1 << 17)]
            same = view[i[part] + out[part]] == view[j[part] + out[part]]
            whole = same.all(axis=1)
            out[part] = np.minimum(out[part] + np.where(whole, block, same.argmin(axis=1)), room[part])
            rest.append(part[whole & (out[part] < room[part])])
        open_, block = np.concatenate(rest), min(4096, block * 2)
    return out


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, in the order of the text, its predecessor in the suffix array (-1: none) and the length of their common prefix.

    Where both places follow the same symbol, the length is one less than at the place before; only the others are
    compared, and their lengths add up to n log n at most.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = s[place[follows] - 1] == s[before[follows] - 1]
    own = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    some = own[before[own] >= 0]
    length[some] = extend(s, some, before[some])
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return before, length[last] - (place - last)


def repeated_windows(pieces: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``width`` bytes start at another place of the pieces too."""
    size = np.array([len(p) for p in pieces])
    # a symbol that no byte has ends each piece
    s = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(size + 1) - 1
    s[ends] = 0
    starts = ends - size
    valid = np.zeros(len(s), bool)
    reach = np.zeros(len(s) + 1, np.int64)
    fits = size >= width
    np.add.at(reach, starts[fits], 1)
    np.add.at(reach, ends[fits] - width + 1, -1)
    valid = np.cumsum(reach[:-1]) > 0
    sa = suffix_array(s.astype(np.int64), 257)
    before, common = permuted_prefixes(s, sa)
    hit = np.flatnonzero(valid & (common >= width))
    flags = np.zeros(len(s), bool)
    flags[hit] = True
    flags[before[hit]] = True
    flags &= valid
    return [flags[a : max(a, e - width + 1)] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
