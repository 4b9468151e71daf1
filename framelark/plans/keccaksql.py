"""Keccak-256 as CTEs for DuckDB, so that queries which hash are held against hashes that no Python made.

A message of at most 135 bytes is one block. A state is a list of 25 lanes, lane x + 5 y at place x + 5 y + 1; each of the 24 rounds is
one step of a recursive CTE.
"""

from __future__ import annotations

from framelark.functions.hashing import CONSTANTS, OFFSETS

ONES = (1 << 64) - 1


def _list(numbers) -> str:
    return "[" + ", ".join(f"{int(n)}::UBIGINT" for n in numbers) + "]"


def _rotated(lane: str, n: str) -> str:
    """Lane and amount may be any expressions; bits that would leave the word are masked out before the shift."""
    return f"((({lane}) & ({_list([ONES >> n for n in range(64)])})[({n}) + 1]) << ({n})) | (({lane}) >> (64 - ({n})))"


def keccak(messages: str) -> str:
    """CTEs that end in ``keccak(k, digest)`` of ``messages``, a query with a column ``k`` of texts; to stand after WITH RECURSIVE."""
    source = [0] * 25  # the lane that comes to a place, and how far it is rotated
    amount = [0] * 25
    for x in range(5):
        for y in range(5):
            to = y + 5 * ((2 * x + 3 * y) % 5)
            source[to], amount[to] = x + 5 * y, OFFSETS[x][y]
    lane = "(" + " || ".join(f"substr(h, 16 * i - {2 * b + 1}, 2)" for b in range(8)) + ")"
    xor5 = "xor(xor(xor(xor(a[x + 1], a[x + 6]), a[x + 11]), a[x + 16]), a[x + 21])"
    return f"""keccak_messages AS (SELECT DISTINCT k FROM ({messages}) WHERE k IS NOT NULL),
keccak_padded AS (
  SELECT k, CASE WHEN strlen(k) = 135 THEN hex(encode(k)) || '81' ELSE hex(encode(k)) || '01' || repeat('00', 134 - strlen(k)::INT) || '80' END AS h
  FROM keccak_messages WHERE strlen(k) <= 135),
keccak_rounds(k, r, a) AS (
  SELECT k, 0, list_concat(list_transform(range(1, 18), lambda i: ('0x' || {lane})::UBIGINT), list_transform(range(8), lambda i: 0::UBIGINT)) FROM keccak_padded
  UNION ALL
  SELECT k, r + 1, list_transform(range(25), lambda i: CASE WHEN i = 0 THEN xor(c[1], {_list(CONSTANTS)}[r + 1]) ELSE c[i + 1] END) FROM (
    SELECT k, r, list_transform(range(25), lambda i: xor(b[i + 1], xor(b[i // 5 * 5 + (i + 1) % 5 + 1], {ONES}::UBIGINT) & b[i // 5 * 5 + (i + 2) % 5 + 1])) AS c FROM (
      SELECT k, r, list_transform(range(25), lambda i: {_rotated(f"t[{source}[i + 1] + 1]", f"{amount}[i + 1]")}) AS b FROM (
        SELECT k, r, list_transform(range(25), lambda i: xor(a[i + 1], xor(p[(i + 4) % 5 + 1], {_rotated('p[(i + 1) % 5 + 1]', '1')}))) AS t FROM (
          SELECT k, r, a, list_transform(range(5), lambda x: {xor5}) AS p FROM keccak_rounds WHERE r < 24))))),
keccak AS (
  SELECT k, '0x' || list_aggregate(list_transform(range(4), lambda i: list_aggregate(list_transform(range(8), lambda b: lpad(lower(hex((a[i + 1] >> (8 * b)) & 255)), 2, '0')), 'string_agg', '')), 'string_agg', '') AS digest
  FROM keccak_rounds WHERE r = 24)"""
