"""Slow cell-by-cell recurrences used as the yardstick in tests."""

LOW = -10**9


def free_shift(cols, query, sub, col_open, col_extend, gap_open, gap_extend, up_start=LOW, local=False):
    """Best score; ``sub(col, residue)`` scores a match step."""
    n = len(cols)
    s, up = [0] * n, [up_start] * n
    best = LOW
    for i, b in enumerate(query):
        left, prev_s, diag = LOW, 0, 0
        row = []
        for j in range(n):
            m = diag + sub(cols[j], b)
            diag = s[j]
            left = max(left + col_extend(cols[j]), prev_s + col_open(cols[j]))
            up[j] = max(up[j] + gap_extend, s[j] + gap_open)
            v = max(m, left, up[j])
            if local:
                v = max(v, 0)
                best = max(best, v)
            elif j == n - 1 or i == len(query) - 1:
                best = max(best, v)
            row.append(v)
            prev_s = v
        s = row
    return best


def profile_score(state, flag, query, match=2, match_flag=-3, gap_open=-3, gap_extend=-1):
    cols = list(zip(state, flag))
    return free_shift(
        cols,
        query,
        lambda c, b: (match if c[0] & b else 0) + (match_flag if c[1] else 0),
        lambda c: 0 if c[1] else gap_open,
        lambda c: 0 if c[1] else gap_extend,
        gap_open,
        gap_extend,
    )


def trace_score(state, flag, query, ops, match=2, match_flag=-3, gap_open=-3, gap_extend=-1):
    """Re-score a forward operation string with free ends."""
    a = b = 0
    total, prev = 0, None
    first = next((k for k, o in enumerate(ops) if o == "0"), len(ops))
    last = len(ops) - 1 - next((k for k, o in enumerate(reversed(ops)) if o == "0"), len(ops))
    for k, o in enumerate(ops):
        if o == "0":
            total += (match if state[a] & query[b] else 0) + (match_flag if flag[a] else 0)
        elif first < k < last:
            if o == "1":
                cost = (0, 0) if flag[a] else (gap_open, gap_extend)
            else:
                cost = (gap_open, gap_extend)
            total += cost[1] if prev == o else cost[0]
        a += o in "01"
        b += o in "02"
        prev = o
    return total, a, b


def dtw(x, y):
    inf = float("inf")
    d = [[inf] * (len(y) + 1) for _ in range(len(x) + 1)]
    d[0][0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            d[i + 1][j + 1] = abs(a - b) + min(d[i][j], d[i][j + 1], d[i + 1][j])
    return d[-1][-1]
