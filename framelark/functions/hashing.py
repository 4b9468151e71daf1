"""Keccak-256 (the original padding) and what is made of it: selectors, topics, checksummed addresses.

Spark has no such function. A batch is hashed at once: lane i of every message is one NumPy vector, so a permutation costs
the same few hundred vector operations for one message as for thousands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 136


def _round_constants() -> list[int]:
    """From the linear feedback shift register x^8 + x^6 + x^5 + x^4 + 1."""
    out, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state >> 7 else 0)
        out.append(value)
    return out


def _offsets() -> list[list[int]]:
    """Rotation of lane (x, y): triangular numbers along the walk (x, y) -> (y, 2x + 3y)."""
    out = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        out[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


CONSTANTS, OFFSETS = [np.uint64(c) for c in _round_constants()], _offsets()


def _rotated(lane: np.ndarray, n: int) -> np.ndarray:
    return lane if not n else (lane << np.uint64(n)) | (lane >> np.uint64(64 - n))


def _permute(a: np.ndarray) -> np.ndarray:
    """Keccak-f[1600] of states ``a[x, y, message]``."""
    for constant in CONSTANTS:
        c = np.bitwise_xor.reduce(a, axis=1)
        d = np.stack([c[(x - 1) % 5] ^ _rotated(c[(x + 1) % 5], 1) for x in range(5)])
        a = a ^ d[:, None]
        b = np.empty_like(a)
        for x in range(5):
            for y in range(5):
                b[y, (2 * x + 3 * y) % 5] = _rotated(a[x, y], OFFSETS[x][y])
        a = b ^ (~np.roll(b, -1, axis=0) & np.roll(b, -2, axis=0))
        a[0, 0] ^= constant
    return a


def keccak(messages: list[bytes]) -> list[bytes]:
    """Digests of messages, those of as many blocks together."""
    out: list[bytes] = [b""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by_blocks.setdefault(len(m) // RATE + 1, []).append(i)
    for blocks, own in by_blocks.items():
        data = np.zeros((len(own), blocks * RATE), dtype=np.uint8)
        for row, i in enumerate(own):
            data[row, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            data[row, len(messages[i])] ^= 0x01
            data[row, -1] ^= 0x80
        state = np.zeros((5, 5, len(own)), dtype=np.uint64)
        lanes = data.view("<u8").reshape(len(own), blocks, RATE // 8)
        for block in range(blocks):
            for lane in range(RATE // 8):
                state[lane % 5, lane // 5] ^= lanes[:, block, lane]
            state = _permute(state)
        digests = np.stack([state[i % 5, i // 5] for i in range(4)], axis=1).astype("<u8").view(np.uint8).reshape(len(own), 32)
        for row, i in enumerate(own):
            out[i] = digests[row].tobytes()
    return out


def keccak_hex(texts: list[str]) -> list[str]:
    return ["0x" + d.hex() for d in keccak([t.encode() for t in texts])]


def checksums(addresses: list[str]) -> list[str]:
    """EIP-55: a letter is upper case where the digest of the lower-case digits has a nibble of 8 or more; what is no address stays."""
    plain = [a.lower().removeprefix("0x") for a in addresses]
    good = [len(p) == 40 and not set(p) - set("0123456789abcdef") for p in plain]
    digests = keccak([p.encode() for p in plain])
    return [
        "0x" + "".join(c.upper() if int(h, 16) >= 8 else c for c, h in zip(p, d.hex())) if g else a for a, p, g, d in zip(addresses, plain, good, digests)
    ]


def _column(function):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        distinct = values.dropna().unique().tolist()  # signatures repeat; each is hashed once a batch
        return values.map(dict(zip(distinct, function(distinct))))

    return run


def keccak256(text: Column) -> Column:
    return _column(keccak_hex)(text)


def topic0(signature: Column) -> Column:
    return keccak256(signature)


def selector(signature: Column) -> Column:
    return F.substring(keccak256(signature), 1, 10)


def to_checksum(address: Column) -> Column:
    return _column(checksums)(address)
