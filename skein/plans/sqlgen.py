"""DuckDB SQL fragments shared by the oracle queries.

These are the *checks* for the Spark operators (the driver runs them in
DuckDB); nothing here runs in the library itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..config import DEFAULT_PRE_FILTERS, HASH_DIMS, TOKEN_PATTERN, WORD_PATTERN


def lit(s: str) -> str:
    """SQL string literal (DuckDB: no backslash escapes in standard strings;
    control characters are spelled with chr())."""
    parts, buf = [], []
    for ch in s:
        if ch in "\n\r\t":
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


P = lit(TOKEN_PATTERN)
W = lit(WORD_PATTERN)


def tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, {P})"


def prefilter(expr: str, patterns: Sequence[str] = DEFAULT_PRE_FILTERS) -> str:
    out = expr
    for p in patterns:
        # RE2 does not accept an escaped space; it means a plain space
        out = f"regexp_replace({out}, {lit(p.replace(chr(92) + ' ', ' '))}, ' ', 'g')"
    if patterns:
        out = f"replace({out}, '  ', ' ')"
    return out


def chunk_ctes(src: str, key: str, text_expr: str, separators: Sequence[str], mx: int,
               post_filter: Sequence[str] = (), prefix: str = "c") -> tuple[str, str]:
    """CTEs computing hierarchical chunks of ``src`` (one row per document with
    ``key`` and text ``text_expr``). Returns (ctes, name of final CTE with
    ``key, chunk_no, text, n_tokens``).

    Per level a recursive CTE folds the pieces of each oversize segment:
    state (st, en); a piece (en, x] longer than max flushes and goes to the
    next level; one that keeps the chunk below max extends it; otherwise flush
    and start a new chunk."""
    ctes = [
        f"{prefix}_tok AS MATERIALIZED (SELECT {key} AS k, {tokens(text_expr)} AS tk FROM {src})",
        f"{prefix}_seg0 AS (SELECT k, '0' AS seg, 0 AS lo, len(tk) AS hi FROM {prefix}_tok WHERE len(tk) > {mx})",
    ]
    bounds = [f"SELECT k, 1 AS s, len(tk) AS e FROM {prefix}_tok WHERE len(tk) <= {mx}"]
    level = 0
    for sep in separators:
        seg, nxt = f"{prefix}_seg{level}", f"{prefix}_seg{level + 1}"
        ends, fold = f"{prefix}_end{level}", f"{prefix}_fold{level}"
        ctes.append(
            f"{ends} AS MATERIALIZED (SELECT k, seg, lo, hi, row_number() OVER (PARTITION BY k, seg ORDER BY i) AS j, i AS x "
            f"FROM (SELECT s.k, s.seg, s.lo, s.hi, t.tk, unnest(range(s.lo + 1, s.hi + 1)) AS i "
            f"FROM {seg} s JOIN {prefix}_tok t USING (k)) WHERE tk[i] = {lit(sep)} OR i = hi)")
        flush = f"(e.x - f.en > {mx} OR e.x - f.st + 1 >= {mx})"
        ctes.append(
            f"{fold}(k, seg, j, st, en, fs, fe, ps, pe) AS ("
            f"SELECT k, seg, 0, lo + 1, lo, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM {seg} "
            f"UNION ALL SELECT f.k, f.seg, e.j, "
            f"CASE WHEN e.x - f.en > {mx} THEN e.x + 1 WHEN e.x - f.st + 1 < {mx} THEN f.st ELSE f.en + 1 END, "
            f"e.x, "
            f"CASE WHEN {flush} AND f.en >= f.st THEN f.st END, "
            f"CASE WHEN {flush} AND f.en >= f.st THEN f.en END, "
            f"CASE WHEN e.x - f.en > {mx} THEN f.en END, "
            f"CASE WHEN e.x - f.en > {mx} THEN e.x END "
            f"FROM {fold} f JOIN {ends} e ON e.k = f.k AND e.seg = f.seg AND e.j = f.j + 1)")
        ctes.append(
            f"{nxt} AS (SELECT k, seg || '.' || j AS seg, ps AS lo, pe AS hi FROM {fold} WHERE ps IS NOT NULL)")
        bounds.append(f"SELECT k, fs AS s, fe AS e FROM {fold} WHERE fs IS NOT NULL")
        bounds.append(
            f"SELECT k, st AS s, en AS e FROM (SELECT *, row_number() OVER (PARTITION BY k, seg ORDER BY j DESC) AS r "
            f"FROM {fold}) WHERE r = 1 AND en >= st")
        level += 1
    last = f"{prefix}_seg{level}"
    bounds.append(
        f"SELECT k, w AS s, least(w + {mx - 1}, hi) AS e FROM (SELECT k, hi, unnest(range(lo + 1, hi + 1, {mx})) AS w "
        f"FROM {last})")
    ctes.append(f"{prefix}_bounds AS ({' UNION ALL '.join(bounds)})")
    piece = "t.tk[b.s:b.e]"
    if post_filter:
        conds = " AND ".join(f"x <> {lit(t)}" for t in post_filter)
        piece = f"list_filter({piece}, lambda x: {conds})"
    ctes.append(
        f"{prefix}_pieces AS (SELECT b.k, b.s, {piece} AS ptk FROM {prefix}_bounds b JOIN {prefix}_tok t USING (k))")
    ctes.append(
        f"{prefix}_chunks AS (SELECT k AS {key}, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::BIGINT AS chunk_no, "
        f"array_to_string(ptk, '') AS text, len(ptk)::BIGINT AS n_tokens FROM {prefix}_pieces WHERE len(ptk) > 0)")
    return ",\n".join(ctes), f"{prefix}_chunks"


def hash_sparse(src: str, key_cols: str, text_expr: str, dims: int = HASH_DIMS) -> str:
    """Sparse hash embedding rows ``key..., dim, value`` (value may be 0)."""
    return (
        f"SELECT {key_cols}, dim, sum(sgn)::BIGINT AS value FROM ("
        f"SELECT {key_cols}, (('0x' || substr(md5(w), 1, 4))::INTEGER % {dims}) AS dim, "
        f"CASE WHEN ('0x' || substr(md5(w), 5, 1))::INTEGER < 8 THEN 1 ELSE -1 END AS sgn "
        f"FROM (SELECT {key_cols}, unnest(regexp_extract_all(lower({text_expr}), {W})) AS w FROM {src})) "
        f"GROUP BY ALL")


def hash_dense(src: str, key_cols: str, text_expr: str, dims: int = HASH_DIMS) -> str:
    """Dense hash embedding rows ``key..., vec DOUBLE[]`` (zeros filled)."""
    keys = [k.strip() for k in key_cols.split(",")]
    on = " AND ".join(f"a.{k} = s.{k}" for k in keys)
    ak = ", ".join(f"a.{k}" for k in keys)
    return (
        f"SELECT {ak}, list(coalesce(s.value, 0)::DOUBLE ORDER BY a.dim) AS vec FROM "
        f"(SELECT {key_cols}, unnest(range({dims})) AS dim FROM {src}) a "
        f"LEFT JOIN ({hash_sparse(src, key_cols, text_expr, dims)}) s ON {on} AND a.dim = s.dim "
        f"GROUP BY {ak}")


def content_id(expr: str, namespace_hex: str = "067FB304F9B14E748ACA28051B8492AB") -> str:
    h = f"sha1(unhex('{namespace_hex}') || encode({expr}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"lower(printf('%x', ((('0x' || substr({h}, 17, 1))::INTEGER & 3) | 8))) || substr({h}, 18, 3) || '-' || "
        f"substr({h}, 21, 12))")
