"""Levenshtein distances of many pairs of strings at once, by bit vectors of 64 rows of the matrix (Myers, Hyyrö)."""

from __future__ import annotations

import numpy as np

#: Pairs that are worked on at a time.
SLAB = 8192
_ONE, _LAST = np.uint64(1), np.uint64(63)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of each text plus one, padded by zeros; lengths)"""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out, size


def distances(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distance of left[i[p]] and right[j[p]] for each p, in code points."""
    (a, m), (b, n) = _letters(left), _letters(right)
    letters = np.union1d(a, [0])
    at = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
    text = np.where(letters[at] == b, at, 0)  # letters that no left text has are as the padding: without bits
    words = -(-a.shape[1] // 64)
    masks = np.zeros((words, len(left), len(letters)), np.uint64)
    row, col = np.nonzero(a)
    np.bitwise_or.at(masks, (col // 64, row, np.searchsorted(letters, a[row, col])), _ONE << (col % 64).astype(np.uint64))
    of = -(-m[i] // 64)
    order = np.lexsort((-n[j], of))
    out = np.empty(len(i), np.int64)
    for words in np.unique(of):
        same = order[np.searchsorted(of[order], words) : np.searchsorted(of[order], words, "right")]
        for s in range(0, len(same), SLAB):
            part = same[s : s + SLAB]
            out[part] = _slab(masks[:words], len(letters), m[i[part]], n[j[part]], i[part], text[j[part]].T) if words else n[j[part]]
    return out


def _slab(masks: np.ndarray, letters: int, m: np.ndarray, n: np.ndarray, i: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Distances of pairs whose left texts take as many words; right texts, a column each, by falling length."""
    words, many = len(masks), len(i)
    masks, base = masks.reshape(words, -1), i * letters
    up, down = np.full((words, many), ~np.uint64(0)), np.zeros((words, many), np.uint64)
    eq, x, h, ph, mh, t = (np.empty(many, np.uint64) for _ in range(6))
    live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")  # pairs whose right text goes on
    for at, k in enumerate(live):
        place = base[:k] + text[at, :k]
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(words):
            pv, mv, e, v, xh, p, q, u = up[w, :k], down[w, :k], eq[:k], x[:k], h[:k], ph[:k], mh[:k], t[:k]
            np.take(masks[w], place, out=e)
            np.bitwise_or(e, mv, out=v)
            np.bitwise_or(e, minus, out=e)
            np.bitwise_and(e, pv, out=xh)
            np.add(xh, pv, out=xh)
            np.bitwise_xor(xh, pv, out=xh)
            np.bitwise_or(xh, e, out=xh)
            np.bitwise_or(xh, pv, out=u)
            np.invert(u, out=u)
            np.bitwise_or(mv, u, out=p)
            np.bitwise_and(pv, xh, out=q)
            next_plus, next_minus = p >> _LAST, q >> _LAST
            np.left_shift(p, _ONE, out=p)
            np.bitwise_or(p, plus, out=p)
            np.left_shift(q, _ONE, out=q)
            np.bitwise_or(q, minus, out=q)
            np.bitwise_or(v, p, out=u)
            np.invert(u, out=u)
            np.bitwise_or(q, u, out=pv)
            np.bitwise_and(p, v, out=mv)
            plus, minus = next_plus, next_minus
    # The last column falls and rises by the bits of the left text's own rows.
    rest = m - 64 * (words - 1)
    last = np.where(rest == 64, ~np.uint64(0), (_ONE << (rest % 64).astype(np.uint64)) - _ONE)
    up[-1] &= last
    down[-1] &= last
    return n + np.bitwise_count(up).sum(0, dtype=np.int64) - np.bitwise_count(down).sum(0, dtype=np.int64)
