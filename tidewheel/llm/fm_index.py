"""A compressed full-text index over word sequences, and matching statistics of streamed sequences against it.

The Burrows-Wheeler transform of all indexed sequences is kept as a wavelet tree in matrix form: one bit vector
for each bit of a symbol, packed to 64 bits a word with a running count. Backward search steps many streams at
once; where a stream's match can't be extended, it falls back along the suffix tree's parents.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with rank: one counter for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(64 + -n % 64, bits.dtype)]), bitorder="little")
        self.word = packed.view("<u8").astype(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = n - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        low = self.word[w] & ((U(1) << (i & 63).astype(U)) - U(1))
        return self.before[w] + np.bitwise_count(low)


class WaveletTree:
    """Rank of any symbol in a sequence of small integers."""

    def __init__(self, seq: np.ndarray, width: int):
        self.levels = []
        for level in range(width - 1, -1, -1):
            bit = (seq >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit)))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where each place, and what of a symbol's occurrences lies before it, is led by the symbol's bits.

        The occurrences before a place are its result less that of place 0.
        """
        many, at = len(places), np.concatenate(places)
        for level, bits in self.levels:
            one = np.tile((symbol >> level & 1).astype(bool), many)
            ones = bits.rank(at)
            at = np.where(one, bits.zeros + ones, at - ones)
        return np.split(at, many)


class FMIndex:
    """Index of sequences of hashed words, each with an owner (a number); the owners' minimum can be asked for.

    ``depth``: the length of match from which owners can be asked for.
    """

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray, depth: int):
        self.depth, many = depth, len(sequences)
        size = np.array([len(s) for s in sequences], np.int64)
        every = np.concatenate(sequences)
        self.alphabet, symbol = np.unique(every, return_inverse=True)
        end = np.cumsum(size + 1) - 1
        n = self.n = int(end[-1]) + 1
        # each sequence ends in a separator of its own, so that no match runs over
        text = np.empty(n, np.int64)
        is_end = np.zeros(n, bool)
        is_end[end] = True
        text[end] = np.arange(many)
        text[~is_end] = symbol.reshape(-1) + many
        self.many = many
        sa, ranks = self._suffixes(text, int(size.max()) + 1)
        prev = np.where(sa > 0, text[sa - 1], 0)
        bwt = np.where(prev < many, 0, prev - many + 1)
        self.tree = WaveletTree(bwt, max(1, int(len(self.alphabet)).bit_length()))
        # suffixes that begin with a smaller symbol
        first = many + np.concatenate([[0], np.cumsum(np.bincount(symbol.reshape(-1), minlength=len(self.alphabet)))[:-1]])
        every_symbol = np.arange(len(self.alphabet))
        self.shift = first - self.tree.rank(every_symbol + 1, np.zeros(len(every_symbol), np.int64))[0]
        # the tables over these are the largest part of the index; sequences are short, and so are the numbers
        self.lcp = self._common(sa, ranks, n).astype(np.int8 if size.max() < 127 else np.int32)
        self._ahead: list[np.ndarray] = []
        self._back: list[np.ndarray] = []
        # the least owner among all suffixes that share their first ``depth`` words
        begins = np.flatnonzero(self.lcp[:-1] < depth)
        least = np.minimum.reduceat(np.repeat(owner, size + 1)[sa], begins)
        self.least = np.repeat(least, np.diff(np.append(begins, n)))

    @staticmethod
    def _suffixes(text: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The suffix array by prefix doubling, and the ranks by each prefix length on the way."""
        ranks = [(1, text)]
        while True:
            length, rank = ranks[-1]
            n = len(rank)
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - length)] = rank[length:] + 1
            key = rank * (int(rank.max()) + 3) + follow
            sa = np.argsort(key, kind="stable")
            ordered = key[sa]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[sa] = new
            ranks.append((2 * length, rank))
            if 2 * length >= longest or new[-1] == n - 1:
                return sa, ranks

    @staticmethod
    def _common(sa: np.ndarray, ranks: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
        """Words that each suffix in order shares with the one before it; 0 at both ends."""
        a, b = sa[:-1].copy(), sa[1:].copy()
        out = np.zeros(n + 1, np.int32)
        got = out[1:n]
        for length, rank in reversed(ranks):
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            got[same] += length
            a[same] += length
            b[same] += length
        return out

    def _nearest(self, at: np.ndarray, depth: np.ndarray, ahead: bool) -> np.ndarray:
        """From each place, the nearest one at or after it (or before) where the common prefix is below depth.

        Tables hold the least common prefix of 1, 2, 4 ... places that begin (or end) at each; -1 where there are fewer.
        """
        if not self._ahead:
            t = self.lcp
            while True:
                lack = np.full(len(self.lcp) - len(t), -1, self.lcp.dtype)
                self._ahead.append(np.concatenate([t, lack]))
                self._back.append(np.concatenate([lack, t]))
                w = 1 << (len(self._ahead) - 1)
                if len(t) <= w:
                    break
                t = np.minimum(t[: len(t) - w], t[w:])
        tables, depth = self._ahead if ahead else self._back, np.maximum(depth, 1)
        for k in range(len(tables) - 1, -1, -1):
            jump = (tables[k][at] >= depth).astype(np.int64) << k
            at = at + jump if ahead else at - jump
        return at

    def _step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.tree.rank(c + 1, lo, hi)
        return self.shift[c] + a, self.shift[c] + b

    def matching_statistics(self, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each place of each streamed sequence: the length of the longest match that begins there, and the least
        owner of such matches' first ``depth`` words (-1 if the match is shorter).

        A stream that can no more reach ``depth`` is given up, and its remaining lengths read 0.
        """
        size = np.array([len(s) for s in sequences], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        every = np.concatenate(sequences) if sequences else np.zeros(0, U)
        c = np.minimum(np.searchsorted(self.alphabet, every), len(self.alphabet) - 1)
        c = np.where(self.alphabet[c] == every, c, -1)
        length_at, owner_at = np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
        live = np.flatnonzero(size >= self.depth)
        lo, hi, got = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64), np.zeros(len(live), np.int64)
        left = size[live]
        while len(live):
            at = base[live] + left - 1
            word = c[at]
            known = word >= 0
            lo[~known], hi[~known], got[~known] = 0, self.n, 0
            todo = np.flatnonzero(known)
            while len(todo):
                a, b = self._step(word[todo], lo[todo], hi[todo])
                fine = a < b
                good = todo[fine]
                lo[good], hi[good] = a[fine], b[fine]
                got[good] += 1
                todo = todo[~fine]
                todo = todo[got[todo] > 0]  # every indexed word matches by itself: the root never fails
                parent = np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]]).astype(np.int64)
                lo[todo], hi[todo], got[todo] = (
                    np.where(parent > 0, self._nearest(lo[todo], parent, False), 0),
                    np.where(parent > 0, self._nearest(hi[todo], parent, True), self.n),
                    parent,
                )
            length_at[at] = got
            deep = got >= self.depth
            owner_at[at[deep]] = self.least[lo[deep]]
            left -= 1
            stay = got + left >= self.depth
            stay &= left > 0
            live, lo, hi, got, left = live[stay], lo[stay], hi[stay], got[stay], left[stay]
        return np.split(length_at, base[1:-1]), np.split(owner_at, base[1:-1])
