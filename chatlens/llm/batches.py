"""Whole Arrow batches of text as numpy arrays, for operators that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a character outside ASCII
_IN_WORD = np.array([48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
#: bytes of text worked on at once; one text may be longer and then is worked on alone
CHUNK = 4 << 20


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, A-Z lower-cased; start of each text and the end); null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return _LOWER[raw], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs (first text, end) of about ``size`` bytes each, one text at least."""
    k = 0
    while k < len(off) - 1:
        e = max(k + 1, int(np.searchsorted(off, off[k] + size, side="right")) - 1)
        yield k, e
        k = e


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_features(data: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit feature) of each word and of its byte prefixes of the given
    lengths, where a word is longer than that. Words are runs of letters and digits."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _IN_WORD[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[off[:-1][off[:-1] < len(data)]] = True
    first = inside & (cut | ~np.concatenate([[False], inside[:-1]]))
    last = inside & np.concatenate([cut[1:] | ~inside[1:], [True]])
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, s, side="right") - 1
    size = e - s
    out_doc, out = [doc], []
    with np.errstate(over="ignore"):
        whole = np.zeros(len(s), dtype=np.uint64)
        step, live = 0, np.arange(len(s))
        while len(live):  # as many steps as the longest word has bytes; few words stay long
            whole[live] = (whole[live] + data[s[live] + step] + np.uint64(1)) * _BASE
            whole[live] ^= whole[live] >> np.uint64(32)
            step += 1
            if step in prefixes:
                more = live[size[live] > step]
                out_doc.append(doc[more])
                out.append(mixed(whole[more] + np.uint64(step)))
            live = live[size[live] > step]
        out.insert(0, mixed(whole))
    return np.concatenate(out_doc), np.concatenate(out)
