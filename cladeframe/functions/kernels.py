"""Dynamic programs over batches of (query, profile) pairs, as numpy array steps.

These are the bodies of the distributed joins in ``operators``: Spark decides which
queries meet which profiles and in which task; one call here fills that cell.

Every step advances one query residue for a whole batch.  Arrays are laid out
(columns, queries, profiles), so that the only sequential part - carrying a gap
along the profile - is a loop over columns whose body is a long vector operation.
Scores are kept relative to the running sum of column gap costs; then carrying a
gap along costs nothing and a row needs one running maximum.  This is exact when
opening a gap never costs less than extending one, which is checked.
"""

from __future__ import annotations

import heapq

import numpy as np

LANES = 6144  # (query, profile) pairs advanced together at most
CACHE_BYTES = 1 << 18  # of one array of a step, where that leaves LEAST_LANES pairs; keeps a step in a core's own cache
LEAST_LANES = 1024
PIECE = 1024  # residues of a query that one lane takes; longer ones are cut
DTW_LANES = 1536  # pairs of series advanced together
TRACE_LANES = 1024  # pairs traced together
TRACE_ROWS = 128  # query residues between two kept rows of a trace


def _dtype(bound: float) -> tuple[np.dtype, int]:
    if bound < 12000:
        return np.dtype(np.int16), -16000
    return np.dtype(np.int32), -(1 << 29)


def _by_length(lens: np.ndarray) -> np.ndarray:
    return np.argsort(-lens, kind="stable")


def _pad(rows: list[np.ndarray], width: int, fill: int) -> np.ndarray:
    out = np.full((len(rows), width), fill, dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : r.size] = r
    return out


def _running_max(x: np.ndarray) -> np.ndarray:
    """Running maximum along axis 0: in blocks of the square root of the rows, as :class:`_Columns` has them."""
    x = np.ascontiguousarray(x)
    n, width = x.shape[0], max(1, int(np.sqrt(x.shape[0])))
    whole = n // width * width
    part = x[:whole].reshape(-1, width, *x.shape[1:])
    for k in range(1, width):
        np.maximum(part[:, k], part[:, k - 1], out=part[:, k])
    for b in range(1, part.shape[0]):
        np.maximum(part[b, -1], part[b - 1, -1], out=part[b, -1])
    np.maximum(part[1:, :-1], part[:-1, -1:], out=part[1:, :-1])
    for j in range(whole, n):
        np.maximum(x[j], x[j - 1], out=x[j])
    return x


class _Columns:
    """Order of columns in which the running maximum along them takes few steps over memory in a row.

    Columns are in blocks of about their square root; the first columns of all blocks lie side by
    side, then the second ones.  All blocks advance together, then their ends, and the ends go to
    the rest of the next blocks in one step.  Columns beyond the real ones end the last blocks.
    """

    def __init__(self, n: int, queries: int, profiles: int, dt: np.dtype):
        self.width = max(1, int(np.sqrt(n)))
        self.blocks, self.rest, self.dt = -(-n // self.width), (queries, profiles), dt
        self.at = np.arange(n) % self.width * self.blocks + np.arange(n) // self.width

    def laid(self, x: np.ndarray, fill: np.ndarray | int = 0) -> np.ndarray:
        """``x`` in this order, ``fill`` in the columns beyond."""
        out = np.empty((self.width * self.blocks, *x.shape[1:]), self.dt)
        out[:] = fill
        out[self.at] = x
        return out

    def new(self) -> np.ndarray:
        return np.zeros((self.width * self.blocks, *self.rest), self.dt)

    def grid(self, x: np.ndarray, live: int) -> np.ndarray:
        """The first ``live`` queries of an array of this order, by columns of a block and blocks."""
        return x.reshape(self.width, self.blocks, *x.shape[1:])[:, :, :live]

    def carry(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Steps ``later = max(later, earlier)`` of the running maximum of a grid."""
        steps = [(x[k], x[k - 1]) for k in range(1, self.width)]
        steps += [(x[-1, b], x[-1, b - 1]) for b in range(1, self.blocks)]
        return steps + [(x[:-1, 1:], x[-1, :-1])] * (self.blocks > 1 and self.width > 1)


def affine_scores(
    table: np.ndarray,
    col_open: np.ndarray,
    col_extend: np.ndarray,
    queries: list[np.ndarray],
    gap_open: int,
    gap_extend: int,
    local: bool = False,
    widths: np.ndarray | None = None,
    soft_start: bool = False,
    end_row: np.ndarray | None = None,
) -> np.ndarray:
    """Best score of each query against each profile: shape (queries, profiles).

    ``table[col, symbol, profile]`` is the substitution score and ``col_open`` /
    ``col_extend`` (cols, profiles) the cost of a gap that consumes the column;
    ``gap_open`` / ``gap_extend`` cost a gap that consumes a query residue.  Both ends
    are free (best over the last row and the last column), or with ``local`` any cell may
    start and end an alignment.  ``widths`` gives each profile's real column count.
    ``soft_start`` charges a gap before the first column as an extension.
    Queries without residues score the lowest representable value.  ``end_row``, of the shape of
    the result, takes the first residue with which the best score is reached; not with ``local``.

    Unless ``local``, a long query is cut into overlapping pieces that are lanes of their own.  A
    piece begins with all columns skipped, which is never above the true row; where that was
    below it, ``overlap`` residues later it no longer matters, so all scores are exact.
    """
    if np.any(col_open > col_extend) or gap_open > gap_extend:
        raise ValueError("opening a gap must not be cheaper than extending it")
    n_col, _, n_prof = table.shape
    longest = max((q.size for q in queries), default=0)
    out = np.full((len(queries), n_prof), np.iinfo(np.int32).min, dtype=np.int64)
    if n_col == 0 or longest == 0:
        return out
    carry = np.cumsum(col_extend, axis=0, dtype=np.int64)
    shifted, start_cost = table - col_extend[:, None, :], col_open - col_extend
    if soft_start:
        start_cost = start_cost.copy()
        start_cost[0] = 0
    if local:
        steps = np.abs(table).max(initial=0) + np.abs(col_open).max(initial=0) + abs(gap_open)
        reach = np.abs(carry).max(initial=0) + 2 * int(steps) + int(np.abs(table).max(initial=0)) * (
            min(n_col, longest) + 1
        ) + abs(gap_extend) * 2
        dt, low = _dtype(float(reach) * 1.5)
        zero = 0
        pieces = [(k, 0, q.size) for k, q in enumerate(queries) if q.size]
    else:
        least = int(min(start_cost[0].min(), 0))
        low = least + gap_open
        bottom = least + int(min(shifted.min(), gap_open + gap_extend, start_cost.min())) - 1
        top = int(np.maximum(-col_extend, np.maximum(shifted.max(axis=1), 0)).sum(axis=0).max())
        dt, zero = _offset_type(bottom, top)
        low -= zero
        gain = int(np.maximum(table.max(axis=1), 0).sum(axis=0).max())
        back = overlap(n_col, gain, least + int(carry.min()), gap_extend)
        pieces = [(k, a, b) for k, q in enumerate(queries) for a, b in cuts(q.size, back)]
    start_cost = start_cost.astype(dt)[:, None, :]
    last = (widths if widths is not None else np.full(n_prof, n_col)) - 1
    lanes = np.arange(n_prof)
    inside = np.arange(n_col)[:, None] <= last
    ragged = bool((last != n_col - 1).any())

    fit = CACHE_BYTES // (n_col * np.dtype(dt).itemsize)
    queues = _queues([b - a for _, a, b in pieces], max(1, min(LANES, max(LEAST_LANES, fit)) // n_prof))
    symbols = [np.concatenate([queries[k][a:b] for k, a, b in (pieces[x] for x in queue)]) for queue in queues]
    begins: dict[int, list[tuple[int, int]]] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for lane, queue in enumerate(queues):
        at = 0
        for x in queue:
            begins.setdefault(at, []).append((lane, x))
            at += pieces[x][2] - pieces[x][1]
            ends.setdefault(at - 1, []).append((lane, x))
    size = np.array([q.size for q in symbols])
    sym, nb = np.ascontiguousarray(_pad(symbols, int(size[0]), 0).T), len(queues)
    cols = _Columns(n_col, nb, n_prof, dt)
    shifted = cols.laid(shifted)
    fresh = cols.laid((-carry - zero)[:, None, :], (-carry[-1] - zero)[None, None, :])
    wholes = [cols.new() for _ in range(6)]
    wholes[4][:] = cols.laid(start_cost)
    best = np.empty((nb, n_prof), dtype=dt)
    reached = None if end_row is None else np.zeros((nb, n_prof), dtype=np.int32)
    live = 0
    end_at = cols.at[last if ragged else n_col - 1]
    skipped = start_cost[0] - dt.type(zero)
    first = np.broadcast_to(skipped, (nb, n_prof)).copy()
    for i in range(int(size[0])):
        if i == 0 or size[live - 1] <= i:
            live = int(np.searchsorted(-size, -i))
            s, up, h, tmp, starts, run = (x[:, :live] for x in wholes)
            s_grid, _, h_grid, _, start_grid, run_grid = (cols.grid(x, live) for x in wholes)
            runs, first = cols.carry(run_grid), first[:live]
        for lane, x in begins.get(i, ()):
            s[:, lane] = skipped if pieces[x][1] else fresh[:, 0]
            up[:, lane] = best[lane] = low
            if reached is not None:
                reached[lane] = i
        np.take(shifted, sym[i, :live], axis=1, out=h, mode="clip")
        h_grid[1:] += s_grid[:-1]
        h_grid[0, 1:] += s_grid[-1, :-1]
        if zero:
            h[0] -= dt.type(zero)
        np.add(s, dt.type(gap_open), out=tmp)
        up += dt.type(gap_extend)
        np.maximum(up, tmp, out=up)
        np.maximum(h, up, out=h)
        if local:
            np.maximum(h, fresh, out=h)
        np.add(h_grid[:-1], start_grid[1:], out=run_grid[1:])
        np.add(h_grid[-1, :-1], start_grid[0, 1:], out=run_grid[0, 1:])
        run[0] = first
        for later, earlier in runs:
            np.maximum(later, earlier, out=later)
        np.maximum(h, run, out=h)
        s, h, s_grid, h_grid = h, s, h_grid, s_grid
        wholes[0], wholes[2] = wholes[2], wholes[0]
        if local:
            np.subtract(s, fresh, out=tmp)
            np.maximum(best[:live], tmp.max(axis=0), out=best[:live])
        else:
            ends_with = s[end_at, :, lanes].T if ragged else s[end_at]
            if reached is not None:
                better = ends_with > best[:live]
                if better.any():
                    np.copyto(reached[:live], i, where=better)
            np.maximum(best[:live], ends_with, out=best[:live])
        for lane, x in ends.get(i, ()):
            k, a, b = pieces[x]
            if reached is not None:
                row = reached[lane].astype(np.int64) + (b - 1 - i)
            found = best[lane].astype(np.int64)
            if not local:
                found += zero + carry[last, lanes]
            if not local and b == queries[k].size:
                tail = s[cols.at, lane] + (carry + zero)
                tail = (np.where(inside, tail, np.iinfo(np.int32).min) if ragged else tail).max(axis=0)
                if reached is not None:
                    row = np.where(tail > found, b - 1, row)
                found = np.maximum(found, tail)
            if reached is not None:
                sooner = (found > out[k]) | ((found == out[k]) & (row < end_row[k]))
                end_row[k] = np.where(sooner, row, end_row[k])
            np.maximum(out[k], found, out=out[k])
    return out


def _queues(sizes: list[int], lanes: int) -> list[list[int]]:
    """Pieces dealt out to lanes, the longest first and always to the shortest lane; the longest lane first.

    More lanes than fill the time of the longest piece twice would only wait for it.
    """
    queues: list[list[int]] = [[] for _ in range(min(lanes, len(sizes), 2 * -(-sum(sizes) // max(sizes))))]
    filled = [(0, k) for k in range(len(queues))]
    for x in _by_length(np.array(sizes)).tolist():
        total, k = filled[0]
        queues[k].append(x)
        heapq.heapreplace(filled, (total + sizes[x], k))
    return [queues[k] for _, k in sorted(filled, key=lambda f: (-f[0], f[1]))]


def _offset_type(bottom: int, top: int) -> tuple[np.dtype, int]:
    """The narrowest type for values from ``bottom`` to ``top``, and what is taken off them to fit."""
    if top - bottom < 250:
        return np.dtype(np.int8), bottom + 126
    if max(top, -bottom) < 32000:
        return np.dtype(np.int16), 0
    return np.dtype(np.int32), 0


def overlap(n_col: int, gain: int, least: int, gap_extend: int) -> int | None:
    """Residues before a cell that can matter to it: an alignment over more of them is worse than skipping all columns.

    ``gain`` is the most that all columns can give and ``least`` the score of skipping them; None where
    insertions are free.
    """
    return n_col + (gain - least) // -gap_extend + 2 if gap_extend < 0 else None


def cuts(size: int, back: int | None) -> list[tuple[int, int]]:
    """Pieces ``(first, end)`` of a query: each begins ``back`` residues before the end of the one before it."""
    if back is None or size <= max(PIECE, 4 * back):
        return [(0, size)] if size else []
    step = max(PIECE, 4 * back)
    return [(max(0, a - back), min(size, a + step)) for a in range(0, size, step)]


def profile_scores(
    state: np.ndarray,
    flag: np.ndarray,
    symbol_states: np.ndarray,
    queries: list[np.ndarray],
    match: int,
    match_flag: int,
    gap_open: int,
    gap_extend: int,
    end_row: np.ndarray | None = None,
) -> np.ndarray:
    """Free-shift score of symbol-index queries against edge profiles (cols, profiles).

    A residue matches when its state shares a bit with the column; flagged columns add
    ``match_flag`` to a match step and can be skipped for free.
    """
    hit = (state[:, None, :] & symbol_states[None, :, None]) != 0
    table = np.where(hit, match, 0) + np.where(flag, match_flag, 0)[:, None, :]
    return affine_scores(
        table,
        np.where(flag, 0, gap_open),
        np.where(flag, 0, gap_extend),
        queries,
        gap_open,
        gap_extend,
        end_row=end_row,
    )


def matrix_scores(
    profiles: list[np.ndarray],
    queries: list[np.ndarray],
    matrix: np.ndarray,
    gap_open: int,
    gap_extend: int,
    local: bool,
    soft_start: bool = False,
) -> np.ndarray:
    """Sequence-against-sequence scores under a residue matrix: (queries, profiles)."""
    widths = np.array([p.size for p in profiles], dtype=np.int64)
    width = int(widths.max(initial=0))
    floor = -8 * (np.abs(matrix).max(initial=1) + abs(gap_open))
    padded = np.vstack([matrix, np.full((1, matrix.shape[1]), floor)])
    cols = _pad(profiles, width, matrix.shape[0]).T
    table = padded[cols].transpose(0, 2, 1)
    ones = np.ones((width, len(profiles)), dtype=np.int64)
    scores = affine_scores(
        table, ones * gap_open, ones * gap_extend, queries, gap_open, gap_extend, local, widths, soft_start
    )
    scores[:, widths == 0] = np.iinfo(np.int32).min
    return scores


def trace_pairs(
    state: np.ndarray,
    flag: np.ndarray,
    queries: list[np.ndarray],
    match: int,
    match_flag: int,
    gap_open: int,
    gap_extend: int,
    ends: np.ndarray | None = None,
) -> tuple[np.ndarray, list[bytes]]:
    """Score and forward operations of each query on its own profile (cols, pairs).

    Operations are ASCII digits: 0 residue on column, 1 column skipped, 2 residue
    inserted.  Ties: insert only if strictly best, skip if at least as good as
    insert and better than a match, else match; the first best end cell in row order.

    A first sweep finds the end cells, a long query in pieces as in :func:`affine_scores`, unless
    their rows are given as ``ends``; then the score is that of the best cell there.  A second one goes over the residues that the best alignment can reach back to from there and
    keeps one row in every ``TRACE_ROWS``; directions are recomputed from those.
    """
    n_col = state.shape[0]
    lens = np.array([q.size for q in queries], dtype=np.int64)
    scores = np.full(len(queries), np.iinfo(np.int32).min, dtype=np.int64)
    ops: list[bytes] = [b"1" * n_col] * len(queries)
    if n_col == 0 or lens.max(initial=0) == 0:
        return scores, ops
    costs = match, match_flag, gap_open, gap_extend
    gain = int(np.where(flag, max(0, match_flag, match + match_flag), max(0, match)).sum(axis=0).max())
    back = overlap(n_col, gain, n_col * min(0, gap_extend) + min(0, gap_open), gap_extend)
    pieces = [(k, a, b) for k, q in enumerate(queries) for a, b in cuts(q.size, back)] if ends is None else []
    end_row, end_col = np.zeros_like(lens), np.zeros_like(lens)
    if ends is not None:
        end_row = np.asarray(ends, np.int64)
        if ((end_row < 0) | (end_row >= lens))[lens > 0].any():
            raise ValueError("an end is outside its query")
    order = _by_length(np.array([b - a for _, a, b in pieces]))
    for lo in range(0, order.size, TRACE_LANES):
        part = [pieces[x] for x in order[lo : lo + TRACE_LANES]]
        pick = [k for k, _, _ in part]
        pairs = _Pairs(state[:, pick], flag[:, pick], [queries[k][a:b] for k, a, b in part], *costs,
                       begun=np.array([a > 0 for _, a, _ in part]), whole=np.array([b == lens[k] for k, _, b in part]))
        best = pairs.sweep(keep=False)
        for x, (k, a, _) in enumerate(part):
            if (best[x], -int(pairs.end_row[x]) - a) > (scores[k], -int(end_row[k])):
                scores[k], end_row[k], end_col[k] = best[x], pairs.end_row[x] + a, pairs.end_col[x]
    first = np.zeros_like(lens) if back is None else np.maximum(0, end_row + 1 - back)
    order = _by_length(np.where(lens > 0, end_row + 1 - first, 0))
    order = order[lens[order] > 0]
    for lo in range(0, order.size, TRACE_LANES):
        pick = order[lo : lo + TRACE_LANES]
        pairs = _Pairs(state[:, pick], flag[:, pick], [queries[k][first[k] : end_row[k] + 1] for k in pick], *costs,
                       begun=first[pick] > 0, whole=(end_row == lens - 1)[pick])
        pairs.sweep()
        if ends is not None:
            scores[pick], end_col[pick] = pairs.final, pairs.final_col
        pairs.end_row, pairs.end_col = pairs.lens - 1, end_col[pick]
        for k, t in zip(pick, pairs.walk()):
            head, tail = b"2" * int(first[k]), b"2" * int(lens[k] - 1 - end_row[k])
            ops[k] = head + t + tail + b"1" * int(n_col - 1 - end_col[k])
    return scores, ops


class _Pairs:
    """Aligned pairs traced together; lanes are sorted by query length, longest first.

    A lane that has ``begun`` is the rest of a query, and one that is not ``whole`` lacks its end.
    """

    def __init__(self, state, flag, queries, match, match_flag, gap_open, gap_extend, begun, whole) -> None:
        self.n_col, self.n = state.shape
        steps = abs(match) + abs(match_flag) + abs(gap_extend)
        dt, self.low = _dtype(2.0 * (self.n_col * steps + 4 * abs(gap_open) + steps))
        self.dt = dt
        self.match, self.open, self.extend = dt.type(match), dt.type(gap_open), dt.type(gap_extend)
        self.lens = np.array([q.size for q in queries], dtype=np.int64)
        qs = _pad(queries, int(self.lens.max()), 0)
        bits = np.int8 if max(state.max(), qs.max()) < 128 else np.int32
        self.state, self.qs = state.astype(bits), qs.T.astype(bits)
        self.o = np.where(flag, 0, gap_open).astype(dt)
        self.e = np.where(flag, 0, gap_extend).astype(dt)
        self.extra = np.where(flag, match_flag, 0).astype(dt)
        self.carry = np.cumsum(self.e, axis=0, dtype=dt)
        self.whole = whole
        self.before = np.where(begun, self.o[0] - self.e[0] + self.carry, 0).astype(dt)

    def cells(self, lanes) -> tuple[np.ndarray, ...]:
        """What a row needs of some lanes."""
        return tuple(x[:, lanes] if isinstance(lanes, slice) else x.take(lanes, axis=1) for x in (self.state, self.extra, self.o - self.carry, self.carry))

    def row(self, cells, residues, s, up):
        """One query residue further: match, insert, skip and best values per column."""
        state, extra, start, carry = cells
        sm = ((state & residues) != 0) * self.match
        sm += extra
        sm[1:] += s[:-1]
        up = np.maximum(s + self.open, up + self.extend)
        h = np.maximum(sm, up)
        run = start.copy()
        run[1:] += h[:-1]
        left = _running_max(run)
        left += carry
        return sm, up, left, np.maximum(h, left)

    def sweep(self, keep: bool = True) -> np.ndarray:
        s = self.before
        up = np.full_like(s, self.low)
        self.kept = []
        self.best = np.full(self.n, self.low, dtype=np.int64)
        # the best cell of a pair's last row, as far as it may be an end
        self.final, self.final_col = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        self.end_col = np.zeros(self.n, dtype=np.int64)
        self.end_row = np.zeros(self.n, dtype=np.int64)
        live = self.n
        cells = self.cells(slice(0, live))
        for i in range(int(self.lens[0])):
            if self.lens[live - 1] <= i:
                live = int(np.searchsorted(-self.lens, -i))
                s, up = s[:, :live], up[:, :live]
                cells = self.cells(slice(0, live))
            if keep and i % TRACE_ROWS == 0:
                self.kept.append((s, up))
            _, up, _, s = self.row(cells, self.qs[i, :live], s, up)
            # ends: the last column of every row, any column of a pair's last row
            ended = self.lens[:live] == i + 1
            final = ended & self.whole[:live]
            value, col = s[-1].astype(np.int64), np.full(live, self.n_col - 1)
            if final.any():
                value = np.where(final, s.max(axis=0), value)
                col = np.where(final, s.argmax(axis=0), col)
            if ended.any():
                self.final[:live][ended], self.final_col[:live][ended] = value[ended], col[ended]
            better = value > self.best[:live]
            self.best[:live][better] = value[better]
            self.end_col[:live][better] = col[better]
            self.end_row[:live][better] = i
        return self.best

    def moves(self, lanes: np.ndarray, block: int) -> np.ndarray:
        """Direction bits of one kept stretch: (rows, cols, lanes)."""
        s, up = (x.take(lanes, axis=1) for x in self.kept[block])
        first = block * TRACE_ROWS
        rows = min(TRACE_ROWS, int(self.end_row[lanes].max()) + 1 - first)
        bits = np.empty((rows, self.n_col, lanes.size), dtype=np.uint8)
        cells, more, anew = self.cells(lanes), self.e[1:].take(lanes, axis=1), self.o[1:].take(lanes, axis=1)
        for r in range(rows):
            old_s, old_up = s, up
            sm, up, left, s = self.row(cells, self.qs[first + r, lanes], s, up)
            stay_up = old_up + self.extend > old_s + self.open
            stay_left = np.zeros_like(stay_up)
            stay_left[1:] = left[:-1] + more > s[:-1] + anew
            skip = (left >= up) & (left > sm)
            insert = (up > left) & (up > sm)
            bits[r] = stay_left | (stay_up << 1) | (skip << 2) | (insert << 3)
        return bits

    def walk(self) -> list[bytes]:
        """Follow the paths of all pairs back from their end cells, stretch by stretch: operations up to there."""
        a, b = self.end_col.copy(), self.end_row.copy()
        skipping = np.zeros(self.n, dtype=bool)
        inserting = np.zeros(self.n, dtype=bool)
        body: list[list[np.ndarray]] = [[] for _ in range(self.n)]
        for block in range(len(self.kept) - 1, -1, -1):
            first = block * TRACE_ROWS
            lanes = np.flatnonzero((a >= 0) & (b >= first))
            if lanes.size == 0:
                continue
            bits = self.moves(lanes, block)
            here = np.arange(lanes.size)
            codes = np.zeros((lanes.size, self.n_col + TRACE_ROWS), dtype=np.uint8)
            x, y = a[lanes], b[lanes] - first
            left, up = skipping[lanes], inserting[lanes]
            taken = 0
            while True:
                on = (x >= 0) & (y >= 0)
                if not on.any():
                    break
                cell = bits[np.maximum(y, 0), np.maximum(x, 0), here]
                fresh = on & ~left & ~up
                left = left | (fresh & ((cell & 4) != 0))
                up = up | (fresh & ((cell & 8) != 0))
                go_up, go_left = on & up, on & left & ~up
                codes[:, taken] = np.where(go_up, 50, np.where(go_left, 49, np.where(on, 48, 0)))
                taken += 1
                x = x - (on & ~go_up)
                y = y - (on & ~go_left)
                up = np.where(go_up, (cell & 2) != 0, up)
                left = np.where(go_left, (cell & 1) != 0, left)
            a[lanes], b[lanes] = x, y + first
            skipping[lanes], inserting[lanes] = left, up
            for k, lane in enumerate(lanes):
                body[lane].append(codes[k, :taken][codes[k, :taken] > 0])
        out = []
        for k in range(self.n):
            head = b"1" * int(a[k] + 1) + b"2" * int(b[k] + 1)
            path = np.concatenate(body[k])[::-1].tobytes() if body[k] else b""
            out.append(head + path)
        return out


def dtw_distances(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Dynamic-time-warping distance (absolute difference) of every x to every y.

    A step takes one anti-diagonal of many pairs, whose cells do not need one another.  Lanes are
    xs of one length times ys; whole numbers that fit are worked out in 32 bits, which is exact.
    """
    lx, ly = (np.array([x.size for x in side]) for side in (xs, ys))
    out = np.empty((len(xs), len(ys)))
    dt, far = _dtw_type(xs, ys)
    by_y = np.argsort(ly, kind="stable")
    for cols in np.array_split(by_y, -(-len(ys) // DTW_LANES)):
        high = int(ly[cols[-1]])
        # last sample first: along an anti-diagonal x goes on and y goes back
        back = np.zeros((high, cols.size), dt)
        for k, c in enumerate(cols):
            back[high - ly[c] :, k] = ys[c][::-1]
        per = max(1, DTW_LANES // cols.size)
        for wide in np.unique(lx):
            same, lanes = np.flatnonzero(lx == wide), None
            for at in range(0, same.size, per):
                rows = same[at : at + per]
                if lanes is None or rows.size != lanes.n:
                    lanes = _Warped(int(wide), rows.size, back, ly[cols], far)
                out[np.ix_(rows, cols)] = lanes.distances(np.array([xs[r] for r in rows], dt))
    return out


def _dtw_type(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.dtype, float]:
    """The type in which all distances are exact, and a value above all of them."""
    values = np.concatenate([*xs, *ys])
    steps = max(x.size for x in xs) + max(y.size for y in ys)
    whole = bool(np.isfinite(values).all()) and bool((values == np.floor(values)).all())
    if whole and 2 * float(np.abs(values).max()) * steps < 1 << 29:
        return np.dtype(np.int32), 1 << 30
    return np.dtype(float), np.inf


class _Warped:
    """``n`` xs of ``wide`` samples against all ys of ``back``, reversed columns sorted by length, over and over.

    Cell ``(i, d - i)`` of anti-diagonal ``d`` is in row ``middle + i - d // 2`` of one of two arrays, over
    the cell before it on the diagonal.  The views of all steps are made once.
    """

    def __init__(self, wide: int, n: int, back: np.ndarray, lens: np.ndarray, far: float) -> None:
        (high, ny), self.n, self.far = back.shape, n, far
        self.out = np.empty((n, ny), back.dtype)
        y = np.tile(back, (1, n))
        self.x = np.empty((wide, n, ny), back.dtype)
        x = self.x.reshape(wide, n * ny)
        self.middle = middle = high // 2 + 1
        self.both = both = np.empty((2, middle + wide // 2 + 3, n * ny), back.dtype)
        cost = np.empty((min(wide, high), n * ny), back.dtype)
        ends = np.searchsorted(lens, np.arange(high + 2))
        self.steps = []
        for d in range(wide + high - 1):
            lo, hi = max(0, d - high + 1), min(wide - 1, d) + 1
            row, before = middle - d // 2, middle - (d - 1) // 2
            here, last = both[d % 2, row + lo : row + hi], both[1 - d % 2]
            ended = slice(ends[max(0, d - wide + 2)], ends[max(0, d - wide + 3)])
            done = (self.out[:, ended], here[wide - 1 - lo].reshape(n, ny)[:, ended]) if ended.stop > ended.start else None
            self.steps.append((
                y[high - 1 - d + lo : high - 1 - d + hi], x[lo:hi], cost[: hi - lo], here,
                last[before + lo : before + hi], last[before + lo - 1 : before + hi - 1], done,
            ))

    def distances(self, xs: np.ndarray) -> np.ndarray:
        self.x[:] = xs.T[:, :, None]
        self.both.fill(self.far)
        self.both[0, self.middle] = 0
        for k, (y, x, cost, here, left, up, done) in enumerate(self.steps):
            np.subtract(y, x, cost)
            np.abs(cost, cost)
            if k:
                np.minimum(here, left, here)
                np.minimum(here, up, here)
            np.add(here, cost, here)
            if done:
                done[0][:] = done[1]
        return self.out


def dtw_path(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Distance and warping path of one pair; ties prefer the diagonal, then a step in x."""
    n, m = x.size, y.size
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0.0
    for s in range(2, n + m + 1):  # cells of one anti-diagonal do not need one another
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        d[i, j] = np.abs(x[i - 1] - y[j - 1]) + np.minimum(np.minimum(d[i - 1, j - 1], d[i - 1, j]), d[i, j - 1])
    i, j, path = n, m, []
    while i > 0 or j > 0:
        path.append((i - 1, j - 1))
        options = [(d[i - 1, j - 1], i - 1, j - 1), (d[i - 1, j], i - 1, j), (d[i, j - 1], i, j - 1)]
        _, i, j = min(options, key=lambda t: t[0])
    return float(d[n, m]), path[::-1]


def log_odds_scores(
    match_lo: np.ndarray,
    residue_lo: np.ndarray,
    gap_lo: np.ndarray,
    queries: list[np.ndarray],
    delta: float,
    epsilon: float,
    path: str = "max",
) -> np.ndarray:
    """Log-odds of each query on each profile: shape (queries, profiles).

    ``match_lo`` is (columns, symbols, profiles), ``residue_lo`` / ``gap_lo`` (columns,
    profiles) weigh a match step that follows a match or a gap.  ``delta`` opens and
    ``epsilon`` extends a gap on either side.  ``path="sum"`` adds up all paths.
    The end is free over the columns from the query length on.
    """
    n_col, _, n_prof = match_lo.shape
    join = np.logaddexp if path == "sum" else np.maximum
    first_gap = 0.0 if path == "sum" else -np.inf
    log_d, log_e = np.log(delta), np.log(epsilon)
    out = np.full((len(queries), n_prof), -np.inf)
    lens = np.array([q.size for q in queries], dtype=np.int64)
    order = _by_length(lens)
    batch = max(1, LANES // max(1, n_prof))
    ramp = (np.arange(n_col + 1) * log_e)[:, None, None]
    for lo in range(0, len(order), batch):
        pick = order[lo : lo + batch]
        blen = lens[pick]
        sym = _pad([queries[k] for k in pick], int(blen.max(initial=0)), 0)
        nb = pick.size
        m = np.zeros((n_col + 1, nb, n_prof))
        d = np.zeros_like(m)
        d[0] = first_gap
        ins = np.full_like(m, first_gap)
        ins[0] = 0.0
        live = nb
        for i in range(int(blen.max(initial=0)) + 1):
            done = live
            while done > 0 and blen[done - 1] == i:
                done -= 1
            if done < live:
                tail = m[min(i, n_col) :, done:live]
                if path == "sum":
                    value = np.logaddexp(0.0, np.logaddexp.reduce(tail, axis=0))
                else:
                    value = tail.max(axis=0)
                out[pick[done:live]] = value
                live = done
                m, d, ins = m[:, :live], d[:, :live], ins[:, :live]
            if live == 0:
                break
            step = join(
                join(m[:-1] + residue_lo[:, None], d[:-1] + gap_lo[:, None]), ins[:-1] + gap_lo[:, None]
            )
            new_m = np.zeros_like(m)
            new_m[1:] = step + np.take(match_lo, sym[:live, i], axis=1)
            new_i = join(m + log_d, ins + log_e)
            new_i[0] = 0.0
            # a skipped column extends at one rate, so the chain is one running join
            run = np.full_like(m, first_gap)
            run[1:] = new_m[:-1] + log_d - ramp[1:]
            if path == "sum":
                np.logaddexp.accumulate(run, axis=0, out=run)
            else:
                run = _running_max(run)
            d = run + ramp
            d[0] = first_gap
            m, ins = new_m, new_i
    return out


class _LogOddsRows:
    """Rows of the log-odds lattice for several queries on one profile, one query a lane.

    A row holds, for every column boundary, the best score of a path that ends there in a
    match, in a skipped column, or in an inserted residue.  With each row come the choices
    that led to it, one byte a cell: bits 0-1 the state before a match (0 match, 1
    insertion, 2 skip; the first of equals), bit 2 an insertion that goes on, bit 3 a skip
    that goes on.
    """

    def __init__(self, match_lo, residue_lo, gap_lo, delta: float, epsilon: float) -> None:
        self.match_lo, self.residue_lo, self.gap_lo = match_lo, residue_lo[:, None], gap_lo[:, None]
        self.n_col = match_lo.shape[0]
        self.open, self.extend = np.log(delta), np.log(epsilon)
        self.ramp = (np.arange(self.n_col + 1) * self.extend)[:, None]

    def first(self, lanes: int) -> np.ndarray:
        row = np.full((3, self.n_col + 1, lanes), -np.inf)
        row[0], row[1, 0], row[2, 1:] = 0.0, 0.0, 0.0
        return row

    def after(self, row: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next row and its choices."""
        match, inserted, skipped = row
        new = np.empty_like(row)
        choice = np.zeros(match.shape, dtype=np.uint8)
        before = np.stack([match[:-1] + self.residue_lo, inserted[:-1] + self.gap_lo, skipped[:-1] + self.gap_lo])
        choice[1:] = before.argmax(axis=0)
        new[0, 0] = 0.0
        new[0, 1:] = before.max(axis=0) + self.match_lo[:, symbols]
        opened, extended = match + self.open, inserted + self.extend
        new[1] = np.maximum(opened, extended)
        choice |= (opened < extended).astype(np.uint8) << 2
        new[1, 0] = 0.0
        new[2, 0] = -np.inf
        new[2, 1:] = np.maximum.accumulate(new[0, :-1] + self.open - self.ramp[1:], axis=0) + self.ramp[1:]
        going_on = new[0, :-1] + self.open < new[2, :-1] + self.extend
        choice[1:] |= going_on.astype(np.uint8) << 3
        return new, choice


#: By state: residues and columns that one step back leaves behind, and its operation.
_STEP_ROWS = np.array([1, 1, 0])
_STEP_COLUMNS = np.array([1, 0, 1])
_STEP_OPS = np.frombuffer(b"021", dtype=np.uint8)


def log_odds_traces(
    match_lo: np.ndarray,
    residue_lo: np.ndarray,
    gap_lo: np.ndarray,
    queries: list[np.ndarray],
    delta: float,
    epsilon: float,
) -> tuple[np.ndarray, list[bytes]]:
    """Scores and forward operations of several queries on one profile (columns, symbols).

    About sqrt(length) rows are kept; the walk back makes the choices of one stretch of rows
    at a time from the kept row above it, and all queries of a batch walk together.
    """
    n_col = match_lo.shape[0]
    rows = _LogOddsRows(match_lo, residue_lo, gap_lo, delta, epsilon)
    lens = np.array([q.size for q in queries], dtype=np.int64)
    scores, out = np.empty(len(queries)), [b""] * len(queries)
    order = np.argsort(lens, kind="stable")
    lanes = max(1, LANES // (n_col + 1))
    for lo in range(0, len(order), lanes):
        pick = order[lo : lo + lanes]
        blen = lens[pick]
        longest = int(blen.max(initial=0))
        sym = _pad([queries[k] for k in pick], longest, 0)
        stretch = max(1, int(np.sqrt(longest)))
        row, kept = rows.first(pick.size), {}
        end = np.zeros(pick.size, dtype=np.int64)
        for i in range(longest + 1):
            if i % stretch == 0:
                kept[i] = row
            for k in np.flatnonzero(blen == i):
                tail = row[0, min(i, n_col) :, k]
                end[k] = min(i, n_col) + tail.argmax()
                scores[pick[k]] = tail.max()
            if i < longest:
                row, _ = rows.after(row, sym[:, i])
        left, column, state = blen.copy(), end.copy(), np.zeros(pick.size, dtype=np.int64)
        walked: list[np.ndarray] = []
        lane = np.arange(pick.size)
        for top in sorted(kept, reverse=True):
            row, choices = kept[top], []
            for i in range(top, min(top + stretch, longest)):
                row, choice = rows.after(row, sym[:, i])
                choices.append(choice)
            choices = np.stack(choices) if choices else None
            while True:
                on = (left > top) & (column > 0)
                if not on.any():
                    break
                k = lane[on]
                cell = choices[left[k] - top - 1, column[k], k]
                here = state[k]
                op = np.zeros(pick.size, dtype=np.uint8)
                op[k] = _STEP_OPS[here]
                walked.append(op)
                left[k] -= _STEP_ROWS[here]
                column[k] -= _STEP_COLUMNS[here]
                goes_on = np.where(here == 1, cell & 4, cell & 8) > 0
                state[k] = np.where(here == 0, cell & 3, np.where(goes_on, here, 0))
        path = np.array(walked, dtype=np.uint8).reshape(-1, pick.size)[::-1]
        for k, q in enumerate(pick):
            steps = path[:, k]
            head = b"2" * int(left[k]) + b"1" * int(column[k])
            out[q] = head + steps[steps > 0].tobytes() + b"1" * int(n_col - end[k])
    return scores, out


def penalty_scores(
    state: np.ndarray,
    flag: np.ndarray,
    symbol_states: np.ndarray,
    queries: list[np.ndarray],
    gap_open: int,
    gap_extend: int,
    mismatch: int,
    match_flag: int,
) -> np.ndarray:
    """Smallest penalty of each query on each profile, within the band of free shifts.

    A query must be shorter than the profile.  Opening a gap pays open and extend at
    once, an insertion pays a mismatch, flagged columns are skipped for free and add
    ``match_flag`` to a match step.
    """
    n_col, n_prof = state.shape
    big = 1 << 28
    out = np.empty((len(queries), n_prof), dtype=np.int64)
    hit = (state[:, None, :] & symbol_states[None, :, None]) != 0
    step = np.where(hit, 0, mismatch) + np.where(flag, match_flag, 0)[:, None, :]
    opened = np.where(flag, 0, gap_open + gap_extend)
    carry = np.cumsum(np.where(flag, 0, gap_extend), axis=0)
    for k, q in enumerate(queries):
        if q.size >= n_col:
            raise ValueError("the penalty scheme needs queries shorter than the profile")
        if q.size == 0:
            out[k] = 0
            continue
        band = n_col - q.size + 1
        cur = np.zeros((band, n_prof), dtype=np.int64)
        for i, b in enumerate(q):
            cols = slice(i, i + band)
            up = np.full_like(cur, big)
            up[:-1] = cur[1:] + mismatch
            h = np.minimum(cur + step[cols, b], up)
            run = np.full_like(h, big)
            run[1:] = h[:-1] + opened[cols][1:] - carry[cols][1:]
            left = np.minimum.accumulate(run, axis=0) + carry[cols]
            cur = np.minimum(h, left)
        out[k] = cur.min(axis=0)
    return out
