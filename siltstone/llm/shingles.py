"""Shingle sets of documents as 64-bit hashes, for joins by overlap."""

from __future__ import annotations

#: A-Z to a-z and nothing else; UTF-8 keeps these bytes for these letters alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def release() -> None:
    """Give freed memory back to the machine: a worker that waits for its next task keeps it else."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def words(text: str | None) -> list[bytes]:
    """Words of the text: bytes.split() divides at space and at the bytes 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_set(text: str | None, n: int):
    """Sorted distinct hashes of the text's ``n``-word shingles; of all its words if they are fewer."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as digest

    w = words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    join = b" ".join
    hashes = [digest(join(w[i : i + n])) for i in range(max(1, len(w) - n + 1))]
    return np.unique(np.array(hashes, dtype=np.uint64))


def set_signature(hashes) -> bytes:
    """16 bytes that stand for the set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def bitmap(hashes, bits: int) -> bytes:
    """Parity of the set's members by hash modulo ``bits``: two sets' bitmaps differ in no more
    places than the sets differ in members."""
    import numpy as np

    counts = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()
