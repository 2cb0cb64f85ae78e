"""SuperMinHash signatures, many documents at once."""

from __future__ import annotations

import numpy as np

from annalist.llm.textnum import mix64

U = np.uint64
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15


def signatures(elements: np.ndarray, first: np.ndarray, size: int = 128) -> np.ndarray:
    """Signature rows (uint64) of the sets ``elements[first[i]:first[i + 1]]``; an empty set's is all UNSET.

    Step j gives every element of a set one value in [j, j + 1) and one slot,
    the slots of an element's steps being a random permutation (Fisher-Yates,
    drawn from the element's hash).  A slot keeps its smallest value.  A set is
    finished as soon as all its slots hold values below j, since later steps
    cannot lower them: large sets stop after a step or two.
    """
    n_sets = len(first) - 1
    out = np.full((n_sets, size), UNSET, dtype=np.uint64)
    flat = out.reshape(-1)
    counts = np.diff(first)
    active = np.flatnonzero(counts > 0)
    doc = np.repeat(np.arange(n_sets), counts)
    element = elements[first[0] : first[-1]]
    perm: np.ndarray | None = None
    slots = np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16)
    for j in range(size):
        draw = mix64(element + U((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        value = (draw >> U(32)) | U(j << 32)
        k = (((draw & U(0xFFFFFFFF)) * U(size - j)) >> U(32)).astype(np.int64) + j
        if j == 0:
            slot = k
        else:
            if perm is None:  # as it stands after step 0
                perm = np.tile(slots, (len(element), 1))
                row = np.arange(len(element))
                first_k = (((mix64(element + U(_STEP)) & U(0xFFFFFFFF)) * U(size)) >> U(32)).astype(np.int64)
                perm[row, first_k] = 0
                perm[:, 0] = first_k
            row = np.arange(len(element))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(flat, doc * size + slot, value)
        active = active[out[active].max(axis=1) >= U((j + 1) << 32)]
        if not len(active):
            break
        going = np.zeros(n_sets, dtype=bool)
        going[active] = True
        stay = going[doc]
        if perm is None or stay.mean() < 0.7:
            element, doc = element[stay], doc[stay]
            perm = perm[stay] if perm is not None else None
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots."""
    n, size = signature.shape
    bands = size // rows
    cut = signature[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        key = mix64(key * U(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key


def short_signature(signature: np.ndarray) -> np.ndarray:
    """32 bits a slot, enough to compare slots."""
    return (mix64(signature) >> U(32)).astype(np.uint32)
