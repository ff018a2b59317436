"""Permutation tables of the supported generators. Tables depend only on method, sizes and seed, and are made on the driver."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np

METHODS = ("srand", "gsl", "numpy")


def glibc_words(seed: int) -> Iterator[int]:
    """The stream of the C library's ``rand()`` after ``srand(seed)``: additive feedback over 31 words."""
    r = [seed or 1]
    for _ in range(30):
        r.append(16807 * r[-1] % 2147483647)
    r += r[:3]
    ring = r[3:34]  # the last 31 words
    at = 0
    skipped = 310
    while True:
        word = (ring[at] + ring[(at + 28) % 31]) & 0xFFFFFFFF
        ring[at] = word
        at = (at + 1) % 31
        if skipped:
            skipped -= 1
        else:
            yield word >> 1


def mt_words(seed: int) -> Iterator[int]:
    """MT19937 seeded as the GNU Scientific Library does (0 stands for 4357)."""
    bits = np.random.RandomState(seed or 4357)._bit_generator  # noqa: SLF001 - the raw words have no public reader
    while True:
        yield from bits.random_raw(4096).tolist()


def _shuffled(words: Iterator[int], most: int, n: int, n_perm: int) -> np.ndarray:
    """Each permutation shuffles the one before: position ``i`` swaps with ``i + word // (most // (n - i) + 1)``."""
    out, row = np.empty((n_perm, n), np.int32), list(range(n))
    width = [most // (n - i) + 1 for i in range(n - 1)]
    for p in range(n_perm):
        for i, w in zip(range(n - 1), words):  # noqa: B905 - the stream has no end
            j = i + w // width[i]
            row[i], row[j] = row[j], row[i]
        out[p] = row
    return out


@functools.lru_cache(maxsize=16)
def permutations(method: str, n: int, n_perm: int, seed: int) -> np.ndarray:
    """``n_perm`` permutations of ``n`` positions. ``srand`` and ``gsl`` are cumulative, ``numpy`` draws afresh."""
    if method not in METHODS:
        raise ValueError(f"unknown generator {method!r}; one of {', '.join(METHODS)}")
    if method == "numpy":
        state = np.random.RandomState(seed)
        return np.stack([state.permutation(n) for _ in range(n_perm)]).astype(np.int32) if n_perm else np.empty((0, n), np.int32)
    words, most = (glibc_words(seed), 2**31 - 1) if method == "srand" else (mt_words(seed), 2**32 - 1)
    return _shuffled(words, most, n, n_perm)


class Generator:
    """A stream of words of one generator: 31 bits of ``srand``, 32 of ``gsl``; ``numpy`` draws whole permutations."""

    def __init__(self, method: str = "srand", seed: int = 0):
        if method not in METHODS:
            raise ValueError(f"unknown generator {method!r}; one of {', '.join(METHODS)}")
        self.method, self.most = method, 2**31 - 1 if method == "srand" else 2**32 - 1
        self._state = np.random.RandomState(seed) if method == "numpy" else None
        self._words = glibc_words(seed) if method == "srand" else mt_words(seed) if method == "gsl" else None

    def word(self) -> int:
        return int(self._state.randint(0, 2**32, dtype=np.uint32)) if self._words is None else next(self._words)

    def below(self, n: int) -> int:
        """A number from 0 to ``n - 1``."""
        return int(self._state.randint(n)) if self._words is None else self.word() // (self.most // n + 1)

    def permutations(self, n: int, n_perm: int) -> np.ndarray:
        """The next ``n_perm`` permutations; those of ``srand`` and ``gsl`` begin from the identity and go on from each other."""
        if self._words is None:
            return np.stack([self._state.permutation(n) for _ in range(n_perm)]).astype(np.int32) if n_perm else np.empty((0, n), np.int32)
        return _shuffled(self._words, self.most, n, n_perm)


def stored(folder: str, method: str, n: int, n_perm: int, seed: int, inverted: bool = False) -> np.ndarray:
    """A table from a file of ``folder``, which is made if it is not there; its name has all that decides it."""
    path = os.path.join(folder, f"{method}_{n}_{n_perm}_{seed}{'_inverse' if inverted else ''}.npy")
    if os.path.exists(path):
        return np.load(path)
    table = permutations(method, n, n_perm, seed)
    table = inverse(table) if inverted else table
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{os.getpid()}.npy"
    np.save(part, table)
    os.replace(part, path)  # a reader sees a whole file or none
    return table


def inverse(table: np.ndarray) -> np.ndarray:
    out = np.empty_like(table)
    np.put_along_axis(out, table, np.broadcast_to(np.arange(table.shape[1], dtype=table.dtype), table.shape), 1)
    return out


def clear_tables() -> None:
    permutations.cache_clear()


def kept_tables() -> int:
    """How many tables the session keeps."""
    return permutations.cache_info().currsize


def chosen(rng_method: str | None, use_gsl_rng: bool = True) -> str:
    """An explicit method wins; the older flag means ``srand`` when true and ``numpy`` when false."""
    if rng_method:
        if rng_method not in METHODS:
            raise ValueError(f"unknown generator {rng_method!r}; one of {', '.join(METHODS)}")
        return rng_method
    return "srand" if use_gsl_rng else "numpy"
