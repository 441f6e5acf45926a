"""DuckDB SQL of operators whose own modules have none: suffix-array dedup and SimHash."""

from __future__ import annotations

from latewise.llm.simhash import SEED

OP3_SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(n_bytes - 99)) AS i FROM bytes)),
repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
islands AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS island
            FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS apart FROM repeats)),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM islands GROUP BY doc_id, island),
pieces AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
           UNION ALL SELECT b.doc_id, coalesce(max(e), 0), any_value(n_bytes) FROM bytes b LEFT JOIN spans USING (doc_id) GROUP BY b.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS h FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT b.doc_id, n_bytes, coalesce(gone.n, 0) AS n_removed, coalesce(gone.k, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM bytes b JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

# The primes of the XXH64 hash.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261
_ALL = 1 << 64


def _u(x: int) -> str:
    return f"{x % _ALL if x != _ALL else x}::UHUGEINT"


def _mod(e: str) -> str:
    return f"(({e}) % {_u(_ALL)})"


def _times(e: str, k: int) -> str:
    return _mod(f"{e} * {_u(k)}")


def _turn(e: str, r: int) -> str:
    """A rotation to the left by r bits."""
    return f"(({e} * {_u(1 << r)}) % {_u(_ALL)} + {e} // {_u(1 << (64 - r))})"


def _with(e: str, body: str) -> str:
    """``body`` with q standing for ``e``, which is worked out once."""
    return f"list_transform([{e}], lambda q: {body})[1]"


def _round(acc: str, lane: str) -> str:
    return _with(_mod(f"{acc} + {_times(lane, P2)}"), _times(_turn("q", 31), P1))


def _number(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes of the list b from index ``at`` on."""
    return "(" + " + ".join(f"b[{at} + {k + 1}] * {_u(1 << 8 * k)}" for k in range(size)) + ")"


def _xxh64_ctes(seed: int) -> str:
    """CTEs from ``octets`` (s, b: bytes, n: their count) to ``hashed`` (s, h)."""
    sums = ", ".join(f"CASE WHEN n >= 32 THEN list_reduce(list_prepend({_u(start)}, list_transform(range(n // 32), lambda t: lanes[4 * t + {i}])), "
                     f"lambda acc, lane: {_round('acc', 'lane')}) END AS v{i}" for i, start in enumerate((seed + P1 + P2, seed + P2, seed, seed - P1), 1))
    joined = _mod(" + ".join(_turn(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18), 1)))
    merged = "".join(f"m{i} AS (SELECT *, CASE WHEN n >= 32 THEN {_mod(_times(f'xor(h{i - 1}, {_round(_u(0), f'v{i}')})', P1) + ' + ' + _u(P4))} END AS h{i} FROM m{i - 1}),\n"
                     for i in range(1, 5))
    eight = _with(f"xor(h, {_round(_u(0), 'lane')})", _mod(f"{_times(_turn('q', 27), P1)} + {_u(P4)}"))
    four = _with(f"xor(h8, {_times(_number('8 * (n // 8)', 4), P1)})", _mod(f"{_times(_turn('q', 23), P2)} + {_u(P3)}"))
    one = _with(f"xor(h, {_times('x', P5)})", _times(_turn("q", 11), P1))
    return f"""lanes AS (SELECT *, list_transform(range(n // 8), lambda j: {_number('8 * j', 8)}) AS lanes FROM octets),
striped AS (SELECT *, {sums} FROM lanes),
m0 AS (SELECT *, CASE WHEN n >= 32 THEN {joined} END AS h0 FROM striped),
{merged}eights AS (SELECT *, list_reduce(list_prepend({_mod(f'coalesce(h4, {_u(seed + P5)}) + n::UHUGEINT')}, lanes[4 * (n // 32) + 1:]), lambda h, lane: {eight}) AS h8 FROM m4),
fours AS (SELECT *, CASE WHEN n % 8 < 4 THEN h8 ELSE {four} END AS hf FROM eights),
ones AS (SELECT s, list_reduce(list_prepend(hf, b[4 * (n // 4) + 1:]), lambda h, x: {one}) AS h FROM fours),
mixed AS (SELECT s, {_times(f'xor(h, h // {_u(1 << 33)})', P2)} AS h FROM ones),
again AS (SELECT s, {_times(f'xor(h, h // {_u(1 << 29)})', P3)} AS h FROM mixed),
hashed AS (SELECT s, xor(h, h // {_u(1 << 32)})::UBIGINT AS h FROM again)"""


OP5_SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM tokens),
octets AS (SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::INTEGER::UHUGEINT) AS b, strlen(s) AS n
           FROM (SELECT DISTINCT s FROM shingles)),
{_xxh64_ctes(SEED)},
bits AS (SELECT doc_id, k, sum((h >> k) & 1) * 2 > count(*) AS is_set FROM shingles JOIN hashed USING (s), range(64) r(k) GROUP BY doc_id, k),
codes AS (SELECT doc_id, coalesce(bit_or(CASE WHEN is_set THEN (2::UHUGEINT ** k)::UHUGEINT::UBIGINT ELSE 0::UBIGINT END), 0::UBIGINT) AS code
          FROM documents LEFT JOIN bits USING (doc_id) GROUP BY doc_id),
nodes AS (SELECT code, min(doc_id) AS least FROM codes GROUP BY code),
links AS (SELECT a.code AS a, b.code AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.code, b.code)) <= 3),
reach AS (SELECT code AS a, code AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT a AS code, min(least) AS component_id FROM reach JOIN nodes ON nodes.code = reach.b GROUP BY a)
SELECT doc_id, lower(lpad(hex(code), 16, '0')) AS fingerprint, component_id FROM codes JOIN found USING (code)
"""
