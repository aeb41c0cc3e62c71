"""Scores of all pairs between two lists of strings, by arrays.

What a text is worth in any pair (counts of characters, tokens) is worked out once for a list; pairs are then looked
at in blocks. A bound from above that needs no comparison of sequences (common characters with repeats, in hash
classes; common tokens; lengths) drops most pairs; what is left is compared exactly. Bounds of common characters are one
matrix product a block: a count n is written as ones in the columns "at least 1" to "at least n", so that the
product of two rows adds up the smaller counts. Longest common subsequences are taken for many pairs at once, one 64-bit word
per pair; pairs whose both strings are longer go one by one. Bounds hold for every pair, so nothing is lost, and scores are
those of samewise.functions.scorers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

from samewise.functions import scorers as S

#: Character classes, counts told apart in each, names a side of a block, tokens a product; tolerance of bounds.
CLASSES, DEPTH, BLOCK, TOKENS, CHUNK, _EPS = 48, 8, 1024, 2048, 1 << 17, 1e-6

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By character of all texts: its number, the text's, and its place in the text."""
    lengths = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    return codes, owner, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def lcs_pairs(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a[i] and b[j] (Hyyro, 2004, one word per pair)."""
    out = np.empty(len(i), np.int64)
    used_a, i = np.unique(i, return_inverse=True)
    used_b, j = np.unique(j, return_inverse=True)
    a, b = [a[n] for n in used_a.tolist()], [b[n] for n in used_b.tolist()]
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    (ca, oa, pa), (cb, ob, pb) = _flat(a), _flat(b)
    alphabet, numbers = np.unique(np.concatenate((ca, cb)), return_inverse=True)
    masks = np.zeros((len(a), len(alphabet) + 1), np.uint64)
    early = pa < 64
    np.bitwise_or.at(masks, (oa[early], numbers[: len(ca)][early]), np.uint64(1) << pa[early].astype(np.uint64))
    codes = np.full((len(b), int(lb.max(initial=0))), len(alphabet), np.int32)  # filled up with a number that no text has
    codes[ob, pb] = numbers[len(ca) :]
    full = np.array([(1 << min(n, 64)) - 1 for n in la.tolist()], np.uint64)
    fits = np.nonzero(la[i] <= 64)[0]
    # by length of b, so that few pairs wait for the longest
    fits = fits[np.argsort(lb[j[fits]], kind="stable")]
    for at in range(0, len(fits), CHUNK):
        part = fits[at : at + CHUNK]
        x, y = i[part], j[part]
        row = full[x]
        for k in range(int(lb[y].max(initial=0))):
            u = row & masks[x, codes[y, k]]
            row = (row + u) | (row - u)
        out[part] = la[x] - np.bitwise_count(row & full[x])
    for n in np.nonzero(la[i] > 64)[0]:
        out[n] = S.lcs(a[i[n]], b[j[n]])
    return out


def _norm(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, (1 - d / np.maximum(n, 1)) * 100, 100.0)


class _Bags:
    """Upper bounds of the characters that two texts have in common, with repeats; characters in `skip` are left out."""

    def __init__(self, a: list[str], b: list[str], skip: str = "") -> None:
        x, y = (self._counts(texts, skip) for texts in (a, b))
        most = np.minimum(x.max(axis=0, initial=0), y.max(axis=0, initial=0))
        top = np.minimum(most, DEPTH)
        classes = np.repeat(np.arange(CLASSES), top)
        levels = np.concatenate([np.arange(1, n + 1) for n in top]) if len(top) else np.zeros(0, np.int64)
        self.a, self.b = ((side[:, classes] >= levels).astype(np.float32) for side in (x, y))
        # counts beyond DEPTH are bounded by the smaller of both sides' sums
        self.more_a, self.more_b = (np.maximum(np.minimum(side, most) - top, 0).sum(axis=1).astype(np.float32) for side in (x, y))
        self.deep = bool(self.more_a.any() and self.more_b.any())

    @staticmethod
    def _counts(texts: list[str], skip: str) -> np.ndarray:
        codes, owner, _ = _flat(texts)
        keep = ~np.isin(codes, [ord(c) for c in skip])
        return np.bincount(owner[keep] * CLASSES + codes[keep] % CLASSES, minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)

    def common(self, rows: slice, cols: slice) -> np.ndarray:
        out = self.a[rows] @ self.b[cols].T
        return out + np.minimum(self.more_a[rows][:, None], self.more_b[cols][None, :]) if self.deep else out


class _Side:
    """Facts about the token sets of one list."""

    def __init__(self, texts: list[str], known: dict[str, int]) -> None:
        sets = [set(t.split()) for t in texts]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.whole = np.array([sum(map(len, s)) + len(s) - 1 for s in sets], np.float32)
        self.sorted = [" ".join(sorted(s)) for s in sets]
        self.repeats = np.array([len(t.split()) for t in texts], np.int64) > self.n
        self.ids = np.array([known.setdefault(t, len(known)) for s in sets for t in s], np.int64)
        self.owner = np.repeat(np.arange(len(sets)), self.n)

    def of(self, part: slice) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.owner, (part.start, part.stop))
        return self.ids[low:high], self.owner[low:high] - part.start


class _Bigrams:
    """Counts of neighbouring characters in hash classes, for bounds of single pairs."""

    def __init__(self, texts: list[str]) -> None:
        codes, owner, place = _flat(texts)
        second = np.nonzero(place > 0)[0]
        kind = (codes[second].astype(np.int64) * 31 + codes[second - 1]) % 251
        counts = np.bincount(owner[second] * 251 + kind, minlength=len(texts) * 251).reshape(len(texts), 251)
        self.full = (counts > 255).any(axis=1)  # counts that do not fit say nothing
        self.counts = np.minimum(counts, 255).astype(np.uint8)

    def common(self, other: _Bigrams, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By pair an upper bound of the bigrams in common, with repeats."""
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), CHUNK // 8):
            x, y = i[at : at + CHUNK // 8], j[at : at + CHUNK // 8]
            out[at : at + CHUNK // 8] = np.minimum(self.counts[x], other.counts[y]).sum(axis=1, dtype=np.int64)
        return np.where(self.full[i] | other.full[j], np.iinfo(np.int64).max, out)


class Cell:
    """Two lists of texts and what is worked out for them once."""

    def __init__(self, a: list[str], b: list[str]) -> None:
        self.a, self.b = a, b
        self.la, self.lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))

    @cached_property
    def bags(self) -> _Bags:
        return _Bags(self.a, self.b)

    @cached_property
    def sides(self) -> tuple[_Side, _Side, dict[str, int]]:
        known: dict[str, int] = {}
        return _Side(self.a, known), _Side(self.b, known), known

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(t) + 1 for t in self.sides[2]], np.float32)

    @cached_property
    def bigrams(self) -> tuple[_Bigrams, _Bigrams]:
        return _Bigrams(self.a), _Bigrams(self.b)

    def common_tokens(self, rows: slice, cols: slice) -> np.ndarray:
        """By pair the length of the common tokens, with a space after each, from the tokens' postings in the block."""
        x, y, _ = self.sides
        (ids_a, own_a), (ids_b, own_b) = x.of(rows), y.of(cols)
        shared = np.intersect1d(ids_a, ids_b)  # postings of other tokens meet nobody in this block
        out = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)

        def table(part: np.ndarray, ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(part, ids), len(part) - 1)
            here = part[at] == ids
            one = np.zeros((n, len(part)), np.float32)
            one[owner[here], at[here]] = 1
            return one

        for at in range(0, len(shared), TOKENS):
            part = shared[at : at + TOKENS]
            out += (table(part, ids_a, own_a, out.shape[0]) * self.sizes[part]) @ table(part, ids_b, own_b, out.shape[1]).T
        return out

    def token_sets(self, rows: slice, cols: slice, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        """(common tokens' lengths, whether token_set_ratio may reach the cutoff), by pair.

        With common tokens of length c (spaces counted) and sets of lengths w and v, the ratios of the common tokens with
        either set reach q only if c >= q min(w, v) / (2 - q) + 1. The ratio of both sets is at most
        2 (characters in common + spaces) / (w + v), spaces being at most the smaller number of tokens.
        """
        x, y, _ = self.sides
        common = self.common_tokens(rows, cols)
        q = np.float32(min(max(cutoff / 100 - 1e-5, 0.0), 1.0))
        w, v = x.whole[rows][:, None], y.whole[cols][None, :]
        reach = (common > 0) & (common >= np.minimum(w, v) * (q / (2 - q)) + np.float32(1 - 1e-3))
        fewer = np.minimum(x.n[rows][:, None], y.n[cols][None, :])
        reach |= 2 * (self.set_bags.common(rows, cols) + fewer.astype(np.float32)) >= q * (w + v) - np.float32(1e-3)
        return common, (reach & (fewer > 0)) | (cutoff <= 0)

    @cached_property
    def set_bags(self) -> _Bags:
        return _Bags(self.sides[0].sorted, self.sides[1].sorted, " ")

    @cached_property
    def in_order(self) -> tuple[list[str], list[str]]:
        return tuple([" ".join(sorted(s.split())) for s in texts] for texts in (self.a, self.b))

    @cached_property
    def trimmed(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(s) for s in side], np.int64) for side in self.in_order)

    @cached_property
    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first four characters of either side as numbers; where a text is shorter, numbers that differ."""
        out = []
        for texts, fill in ((self.a, 1 << 22), (self.b, 1 << 23)):
            codes, owner, place = _flat(texts)
            first = np.full((len(texts), 4), fill, np.int64)
            first[owner[place < 4], place[place < 4]] = codes[place < 4]
            out.append(first)
        return tuple(out)

    def exact(self, name: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        f = S.scorer(name)
        return np.array([f(self.a[x], self.b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.float64)


def _found(mask: np.ndarray, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a block that are set, in the block and in the lists."""
    x, y = np.nonzero(mask)
    return x, y, x + rows.start, y + cols.start


def _ratio(cell: Cell, rows: slice, cols: slice, cutoff: float, allowed: np.ndarray | None) -> Pairs:
    n = (cell.la[rows][:, None] + cell.lb[cols][None, :]).astype(np.float32)
    near = cell.bags.common(rows, cols) >= n * np.float32(cutoff / 200 - 1e-5) - np.float32(1e-3)
    _, _, i, j = _found(near if allowed is None else near & allowed, rows, cols)
    n = cell.la[i] + cell.lb[j]
    return i, j, _norm(n - 2 * lcs_pairs(cell.a, cell.b, i, j), n)


def _token_set(cell: Cell, rows: slice, cols: slice, cutoff: float, allowed: np.ndarray | None) -> Pairs:
    common, near = cell.token_sets(rows, cols, cutoff)
    x, y, i, j = _found(near if allowed is None else near & allowed, rows, cols)
    left, right, _ = cell.sides
    out = np.zeros(len(i))
    apart = np.nonzero((common[x, y] == 0) & (left.n[i] > 0) & (right.n[j] > 0))[0]  # the ratio of both sets alone
    n = (left.whole[i[apart]] + right.whole[j[apart]]).astype(np.int64)
    out[apart] = _norm(n - 2 * lcs_pairs(left.sorted, right.sorted, i[apart], j[apart]), n)
    meet = np.nonzero(common[x, y] > 0)[0]
    out[meet] = cell.exact("token_set_ratio", i[meet], j[meet])
    return i, j, out


def _partial_bound(common: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """No window holds more than `common` characters of the shorter text in their order."""
    c = np.minimum(common, shorter)
    return np.where(shorter == 0, 100.0, 200.0 * c / np.maximum(shorter + c, 1))


def partial_pairs(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """partial_ratio of a[i] and b[j]: all windows of all pairs are compared at once."""
    out = np.zeros(len(i))
    shorter: list[str] = []
    windows: list[str] = []
    at: list[int] = []

    def score() -> None:
        n = np.array([len(s) for s in shorter], np.int64) + np.array([len(w) for w in windows], np.int64)
        every = np.arange(len(windows))
        np.maximum.at(out, np.array(at, np.int64), _norm(n - 2 * lcs_pairs(shorter, windows, every, every), n))
        shorter.clear()
        windows.clear()
        at.clear()

    letters = 0
    for k, (s, t) in enumerate(zip([a[x] for x in i.tolist()], [b[y] for y in j.tolist()], strict=True)):
        for s, t in ((s, t), (t, s)) if len(s) == len(t) else ((s, t),) if len(s) < len(t) else ((t, s),):  # noqa: B020, PLW2901
            m, known = len(s), set(s)
            if not m:
                out[k] = 0.0 if t else 100.0
                continue
            cuts = [t[p : p + m] for p in range(len(t) - m + 1) if t[p + m - 1] in known]
            cuts += [t[:p] for p in range(1, m) if t[p - 1] in known] + [t[-p:] for p in range(1, m) if t[-p] in known]
            windows += cuts
            shorter += [s] * len(cuts)
            at += [k] * len(cuts)
            letters += m * len(cuts)
        if letters > 32 * CHUNK:
            score()
            letters = 0
    score()
    return out


def _windowed(cell: Cell, i: np.ndarray, j: np.ndarray, cutoff: np.ndarray | float) -> np.ndarray:
    """Whether partial_ratio may reach the cutoff, by pair.

    A window of w characters with s in common, in order, with a shorter text of m scores 200 s / (m + w), and keeps at least
    3 s - m - w - 1 of its bigrams, as a character left out breaks two and one put in breaks one; w is at least
    m c / (2 - c) for a share c. Then the same by the whole texts' subsequence.
    """
    m = np.minimum(cell.la[i], cell.lb[j])
    c = np.minimum(np.maximum(np.asarray(cutoff, np.float64) / 100, 0.0), 1.0)
    need = np.where(c > 2 / 3, (1.5 * c - 1) * m * (2 / (2 - c)) - 1, 0.0)
    near = np.nonzero((cell.bigrams[0].common(cell.bigrams[1], i, j) >= need - _EPS) | (m == 0))[0]
    out = np.zeros(len(i), bool)
    bound = _partial_bound(lcs_pairs(cell.a, cell.b, i[near], j[near]), m[near])
    out[near] = bound >= (np.asarray(cutoff)[near] if np.ndim(cutoff) else cutoff) - _EPS
    return out


def _partial(cell: Cell, rows: slice, cols: slice, cutoff: float, allowed: np.ndarray | None) -> Pairs:
    shorter = np.minimum(cell.la[rows][:, None], cell.lb[cols][None, :])
    # 200 c / (shorter + c) >= cutoff
    need = shorter.astype(np.float32) * np.float32(max(cutoff, 0.0) / (200 - min(cutoff, 100.0)) - 1e-5) - np.float32(1e-3)
    near = cell.bags.common(rows, cols) >= need
    _, _, i, j = _found(near if allowed is None else near & allowed, rows, cols)
    keep = _windowed(cell, i, j, cutoff)
    i, j = i[keep], j[keep]
    return i, j, partial_pairs(cell.a, cell.b, i, j)


def _weighted(cell: Cell, rows: slice, cols: slice, cutoff: float, allowed: np.ndarray | None) -> Pairs:
    la, lb = cell.la[rows].astype(np.float32)[:, None], cell.lb[cols].astype(np.float32)[None, :]
    # tokens joined by one space may be shorter than the text
    ta, tb = cell.trimmed
    n, least = (ta[rows][:, None] + tb[cols][None, :]).astype(np.float32), np.minimum(ta[rows][:, None], tb[cols][None, :]).astype(np.float32)
    shorter, longer = np.minimum(la, lb), np.maximum(la, lb)
    characters = cell.bags.common(rows, cols)
    slack = np.float32(1e-3)
    both = characters >= n * np.float32(cutoff / 200 - 1e-5) - slack  # ratio, and token_sort_ratio with it
    near = longer < np.float32(1.5 + 1e-5) * shorter
    common, sets = cell.token_sets(rows, cols, cutoff / 0.95)
    sets &= cutoff <= 95.0 + _EPS
    left, right, _ = cell.sides
    # a common token, or sets of tokens that are shorter than the tokens
    free = (common > 0) | left.repeats[rows][:, None] | right.repeats[cols][None, :]
    windows = np.zeros(n.shape, bool)
    for part, there in ((0.9, longer <= np.float32(8 + 1e-4) * shorter), (0.6, longer > np.float32(8 - 1e-4) * shorter)):
        share = cutoff / part
        if share <= 100 + _EPS:
            windows |= there & (characters >= least * np.float32(share / (200 - min(share, 100.0)) - 1e-5) - slack)
        if 95.0 * part >= cutoff - _EPS:
            windows |= there & free
    mask = both | (near & sets) | (~near | (longer >= np.float32(1.5 - 1e-5) * shorter)) & windows
    x, y, i, j = _found(mask if allowed is None else mask & allowed, rows, cols)
    # again by subsequences of the texts and of their sorted tokens
    p, q = cell.la[i], cell.lb[j]
    sub = np.maximum(lcs_pairs(cell.a, cell.b, i, j), lcs_pairs(*cell.in_order, i, j))
    keep = 200.0 * sub >= cutoff * (ta[i] + tb[j]) - _EPS * 100
    keep |= near[x, y] & sets[x, y]
    part = np.where(np.maximum(p, q) <= 8 * np.minimum(p, q), 0.9, 0.6)
    far = np.maximum(p, q) >= 1.5 * np.minimum(p, q)
    keep |= far & ((part * _partial_bound(sub, np.minimum(ta[i], tb[j])) >= cutoff - _EPS) | (free[x, y] & (95.0 * part >= cutoff - _EPS)))
    i, j = i[keep], j[keep]
    return i, j, cell.exact("WRatio", i, j)


def _jaro(name: str) -> Callable[..., Pairs]:
    def run(cell: Cell, rows: slice, cols: slice, cutoff: float, allowed: np.ndarray | None) -> Pairs:
        la, lb = cell.la[rows][:, None], cell.lb[cols][None, :]
        common = np.minimum(cell.bags.common(rows, cols), np.minimum(la, lb))
        bound = np.where((la == 0) & (lb == 0), 1.0, np.where(common > 0, (common / np.maximum(la, 1) + common / np.maximum(lb, 1) + 1) / 3, 0.0))
        if name == "jaro_winkler":
            starts = np.zeros(bound.shape)
            same = np.ones(bound.shape, bool)
            x, y = cell.starts
            for k in range(4):
                same &= x[rows, k][:, None] == y[cols, k][None, :]
                starts += same
            bound = bound + 0.1 * starts * (1 - bound)
        near = bound >= cutoff - _EPS / 100
        _, _, i, j = _found(near if allowed is None else near & allowed, rows, cols)
        return i, j, cell.exact(name, i, j)

    return run


_SCORERS: dict[str, Callable[..., Pairs]] = {"ratio": _ratio, "token_sort_ratio": _ratio, "token_set_ratio": _token_set, "partial_ratio": _partial, "WRatio": _weighted, "jaro": _jaro("jaro"), "jaro_winkler": _jaro("jaro_winkler")}


def score_tiles(name: str, a: list[str], b: list[str], cutoff: float, same: bool) -> Pairs:
    """(i, j, score) of the pairs a[i], b[j] with a score of at least cutoff; with same, a is b and only i < j are taken.

    For token_sort_ratio the texts are those of sorted tokens. Lists sorted by length let whole blocks be skipped.
    """
    cell, least = Cell(a, b), least_share(name, cutoff)
    out: list[Pairs] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64))]
    for at in range(0, len(a), BLOCK):
        rows = slice(at, min(at + BLOCK, len(a)))
        for to in range(at if same else 0, len(b), BLOCK):
            cols = slice(to, min(to + BLOCK, len(b)))
            x, y = cell.la[rows], cell.lb[cols]
            if x.max() < least * y.min() - _EPS or y.max() < least * x.min() - _EPS:
                continue
            allowed = np.triu(np.ones((len(x), len(y)), bool), 1) if same and at == to else None
            i, j, raw = _SCORERS[name](cell, rows, cols, cutoff, allowed)
            found = raw >= cutoff
            out.append((i[found], j[found], raw[found]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def least_share(name: str, cutoff: float) -> float:
    """The length of the shorter text as a share of the longer one's, below which no pair reaches the cutoff."""
    if name in ("ratio", "token_sort_ratio"):
        t = min(cutoff, 100.0)
        return max(0.0, t / (200.0 - t))
    if name == "jaro":
        return max(0.0, 3 * cutoff - 2)
    if name == "jaro_winkler":
        return max(0.0, 3 * (cutoff - 0.4) / 0.6 - 2)
    return 0.0
