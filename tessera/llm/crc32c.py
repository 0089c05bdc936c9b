"""CRC-32C (Castagnoli) of many messages at once, by table look-ups over columns of equal blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BLOCK = 256


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Byte table; tables that move a register over a block of zeros; four bytes that set the register from 0 to all ones."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    shift = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_BLOCK):
        shift = table[shift & 0xFF] ^ (shift >> np.uint32(8))
    by_top = {int(x) >> 24: k for k, x in enumerate(table)}
    register, used = 0xFFFFFFFF, []
    for _ in range(4):  # backwards: which table entry made the top byte
        used.append(k := by_top[register >> 24])
        register = ((register ^ int(table[k])) << 8) & 0xFFFFFFFF
    state, lead = 0, []
    for k in reversed(used):
        lead.append(k ^ (state & 0xFF))
        state = int(table[k]) ^ (state >> 8)
    return table, shift.reshape(4, 256), bytes(lead)


def crc32c(messages: list[bytes]) -> np.ndarray:
    """Checksums, as uint32. Each message is led by zeros, which leave the register 0, and by four bytes that set it."""
    table, shift, lead = _tables()
    if not messages:
        return np.empty(0, np.uint32)
    blocks = np.array([-(-(len(m) + 4) // _BLOCK) for m in messages])
    data = b"".join(lead.rjust(int(n) * _BLOCK - len(m), b"\0") + m for m, n in zip(messages, blocks))
    columns = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, _BLOCK).T)
    part = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        part = table[(part ^ column) & 0xFF] ^ (part >> np.uint32(8))
    order = np.argsort(-blocks, kind="stable")
    first = (np.cumsum(blocks) - blocks)[order]
    register, counts = np.zeros(len(messages), np.uint32), blocks[order]
    for k in range(int(counts[0])):
        n = int(np.searchsorted(-counts, -k, "left"))  # messages with more than k blocks
        r = register[:n]
        r = shift[0][r & 0xFF] ^ shift[1][(r >> 8) & 0xFF] ^ shift[2][(r >> 16) & 0xFF] ^ shift[3][r >> 24]
        register[:n] = r ^ part[first[:n] + k]
    out = np.empty(len(messages), np.uint32)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that a checksum over stored checksums stays sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
