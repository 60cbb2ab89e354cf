"""Model of the chunking rules for tests, stated over cut positions.

``cuts(lo, hi, level)``: the ends of the chunks of tokens lo..hi at a separator level.
"""


def cuts(tokens, lo, hi, separators, mx):
    if hi - lo <= mx:
        return [hi]
    if not separators:
        return [min(k + mx, hi) for k in range(lo, hi, mx)]
    ends = sorted({k + 1 for k in range(lo, hi) if tokens[k] == separators[0]} | {hi})
    piece = dict(zip([lo, *ends], ends))
    out, first = [], lo  # first: where the chunk under way begins
    at = lo
    while at < hi:
        end = piece[at]
        if end - at > mx:  # too long even alone: what came before ends here, and it is cut at the next level
            out += [at] + cuts(tokens, at, end, separators[1:], mx)
            first = end
        elif end - first >= mx:  # would reach the limit: a chunk ends where this piece begins
            out.append(at)
            first = at
        at = end
    return out + ([hi] if first < hi else [])


def hierarchical_chunks(tokens, separators, mx):
    """The chunks in order; empty ones stand where nothing lay before an oversize piece
    or before the first piece of a chunk."""
    if len(tokens) <= mx:
        return [list(tokens)]
    ends = cuts(tokens, 0, len(tokens), list(separators), mx)
    return [list(tokens[a:b]) for a, b in zip([0, *ends], ends)]
