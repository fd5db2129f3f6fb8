"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash


def op1(rows, tokenizer_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    out, start = [], 0
    for doc_id, text in sorted(rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def fingerprint(text, shingle):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op3(rows, shingle=4, radius=4):
    fps = {d: fingerprint(t, shingle) for d, t in rows}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    arr = np.array([fps[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= radius):
            a, b = find(d), find(ids[j])
            root[max(a, b)] = min(a, b)
    return [(d, f"{fps[d]:016x}", find(d)) for d in ids]
