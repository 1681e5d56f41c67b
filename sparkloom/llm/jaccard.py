"""Sets of word shingles: their hashes, min-hash band keys, and exact groups by Jaccard similarity."""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import WORD_BLOCK_BYTES, Words, blocks, byte_hashes, mix

#: Similarity from which texts are near copies, as a fraction. Sets that alike share no band key once in two million at 4/5 exactly, and rarer above.
SIMILARITY, BANDS, ROWS = (4, 5), 48, 6
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], k: int):
    """(from, to, hashes, first, names) for blocks of lower-cased texts: each text's distinct shingles in order from first[i] on.

    A text of k words or fewer is one shingle; one without words has none. names identify the sets, 0 the empty one.
    """
    for lo, hi in blocks([len(t) for t in texts], WORD_BLOCK_BYTES):
        words = Words([t.lower() for t in texts[lo:hi]])
        n = np.where(words.counts > 0, np.maximum(words.counts - k + 1, 1), 0)
        doc = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + words.first[doc]
        last = np.minimum(at + k, words.first[doc + 1]) - 1
        h = byte_hashes(words.array, words.starts[at], words.ends[last], 0xD1B54A32D192ED03)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        names = np.zeros(hi - lo, np.uint64)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            names[full] = mix(np.add.reduceat(mix(h + np.uint64(7)), first[full]) + np.diff(first)[full].astype(np.uint64))
        yield lo, hi, h, first, names


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set that isn't empty, from the least of its hashes under many multiplications."""
    begin = first[:-1][np.diff(first) > 0]
    keys = np.empty((len(begin), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, np.uint64)
        for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * factor, begin))
        keys[:, band] = key
    return keys


def groups(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs (first member, member) with the same components as all pairs of sets whose Jaccard similarity is similarity or more.

    Every set that is reached is compared, by its shingles' postings, with all that aren't yet.
    """
    num, den = similarity
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    owners = np.repeat(np.arange(len(sets)), size)[order]
    ptr = np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
    left = np.ones(len(sets), bool)
    pairs = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        reached = [seed]
        while reached and left.any():
            x = reached.pop()
            mine = ids[ends[x] - size[x] : ends[x]]
            many = ptr[mine + 1] - ptr[mine]
            at = np.repeat(ptr[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(owners[at], minlength=len(sets))
            hit = np.flatnonzero(left & (common > 0) & (common * den >= num * (size[x] + size - common)))
            left[hit] = False
            reached.extend(hit.tolist())
            pairs.extend((seed, h) for h in hit.tolist())
    return pairs
