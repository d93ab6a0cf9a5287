"""Cluster scoring of many boards at once.

A board of up to 63 cells is one integer of bits; a cluster grows by shifting bits to the four neighbours, for all boards of a batch
together.  Wilds join any cluster, once in each; other cells belong to one cluster.
"""

from __future__ import annotations

import numpy as np

from ..sources.config import Mode


class Clusters:
    """Tables of one mode."""

    def __init__(self, mode: Mode) -> None:
        self.mode, self.cells = mode, mode.columns * mode.rows
        if self.cells > 63:
            raise ValueError("cluster boards have at most 63 cells")
        self.kind = np.uint32 if self.cells < 32 else np.uint64
        bit = lambda c: sum(1 << (r * mode.columns + c) for r in range(mode.rows))
        whole = (1 << self.cells) - 1
        self.not_first, self.not_last, self.whole, self.one, self.up = map(self.kind, (whole & ~bit(0), whole & ~bit(mode.columns - 1), whole, 1, mode.columns))
        self.pay, self.least = np.array(mode.pay_table, np.int64), mode.least_paid
        self.starts = [s for s, (w, p) in enumerate(zip(mode.wild, mode.paid, strict=True)) if p and not w]
        self.wild = np.array(mode.wild)
        self.rows = self._row_table() if len(mode.symbols) ** mode.columns <= 1 << 20 and len(mode.symbols) * mode.columns <= 63 else None

    def _row_table(self) -> np.ndarray:
        """For each row of cells, read as a number of base len(symbols), a field of ``columns`` bits for each symbol: where the row has it."""
        k, columns = len(self.mode.symbols), self.mode.columns
        code = np.arange(k**columns)
        out = np.zeros(k**columns, np.uint64)
        for c in range(columns):
            symbol = code // k**c % k
            out |= np.uint64(1) << (symbol * columns + c).astype(np.uint64)
        return out

    def masks(self, boards: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(wild cells of each board, cells of each symbol in ``starts``) as integers of bits."""
        if self.rows is None or (boards < 0).any() or (boards >= len(self.mode.symbols)).any():
            k = len(self.wild)
            known = np.where((boards >= 0) & (boards < k), boards, k)
            return self.bits(np.append(self.wild, False)[known]), [self.bits(boards == s) for s in self.starts]
        k, columns, rows = len(self.mode.symbols), self.mode.columns, self.mode.rows
        grid = boards.reshape(-1, rows, columns)
        code = grid[:, :, columns - 1].astype(np.int32)
        for c in range(columns - 2, -1, -1):
            code = code * np.int32(k) + grid[:, :, c]
        fields = [self.rows.take(code[:, r]) for r in range(rows)]
        field = np.uint64((1 << columns) - 1)

        def mask(s: int) -> np.ndarray:
            at = np.uint64(s * columns)
            out = fields[0] >> at & field
            for r in range(1, rows):
                out |= (fields[r] >> at & field) << np.uint64(r * columns)
            return out.astype(self.kind)

        wild = np.zeros(len(boards), self.kind)
        for s in np.flatnonzero(self.wild):
            wild |= mask(int(s))
        return wild, [mask(s) for s in self.starts]

    def bits(self, cells: np.ndarray) -> np.ndarray:
        """Each row of booleans as one integer, cell 0 lowest."""
        packed = np.packbits(cells, axis=1, bitorder="little")
        out = np.zeros((len(cells), np.dtype(self.kind).itemsize), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(self.kind)[:, 0]

    def spread(self, bits: np.ndarray) -> np.ndarray:
        """The inverse of :meth:`bits`: a row of booleans for each integer."""
        return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), self.kind().itemsize), axis=1, count=self.cells, bitorder="little").view(bool)

    def grow(self, seed: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """All cells of the mask that are connected with the seed."""
        while True:
            more = (seed | ((seed << self.one) & self.not_first) | ((seed & self.not_first) >> self.one) | (seed << self.up) | (seed >> self.up)) & mask
            if np.array_equal(more, seed):
                return seed
            seed = more

    def score(self, boards: np.ndarray, bet_mult: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """(win, bits of all hit cells, [(rows, symbols, sizes, wins, bits)]) of boards (n, cells).

        All (board, symbol) pairs that have enough cells grow one cluster at a time together.
        """
        n = len(boards)
        wins, hit, found = np.zeros(n, np.int64), np.zeros(n, self.kind), []
        mult = np.broadcast_to(np.asarray(bet_mult, np.int64), (n,))
        wild, owns = self.masks(boards)
        parts = []
        for s, own in zip(self.starts, owns, strict=True):
            whole = own | wild
            # enough cells, and enough neighbours among them for a cluster of the least size
            beside = np.bitwise_count(whole & (whole >> self.one) & self.not_last) + np.bitwise_count(whole & (whole >> self.up))
            at = np.flatnonzero((own > 0) & (np.bitwise_count(whole) >= self.least) & (beside >= self.least - 1))
            parts.append((at, np.full(len(at), s), own[at], whole[at]))
        row, symbol, left, mask = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), hit[:0], hit[:0])
        while len(row):
            one = self.grow(left & (~left + self.one), mask)
            size = np.minimum(np.bitwise_count(one).astype(np.int64), self.pay.shape[1])
            pay = self.pay[symbol, size - 1] * mult[row]
            good = pay > 0
            r = row[good]
            np.add.at(wins, r, pay[good])
            np.bitwise_or.at(hit, r, one[good])
            found.append((r, symbol[good], size[good], pay[good], one[good]))
            left = left & ~one
            more = left > 0
            row, symbol, left, mask = row[more], symbol[more], left[more], mask[more]
        return wins, hit, found
