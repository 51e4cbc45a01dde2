"""Recompression of sequences of symbols into a run-length grammar, and longest common extensions on it.

Levels alternate: block compression makes a run of one symbol one symbol (symbol, length); pair compression splits the
alphabet in two and makes every pair of a left symbol before a right one one symbol. What a place becomes depends on its
neighbours alone, so equal stretches become equal symbols, but for their ends. Many sequences are compressed side by side in
one array, with symbols of their own; a sequence leaves once none of its symbols occurs twice, as nothing is left to match.

An extension climbs while both places begin a symbol of the next level, comparing at most a few symbols for each level, and
descends from where they differ. All queries climb and descend together, in array operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Ways to split an alphabet that are tried, of which the one that makes most pairs is taken.
TRIES = 3


@dataclass
class Level:
    """A sequence: symbols, their length in words, and where they go in the next level (-1: nowhere). first and last are the
    places of a symbol's outermost children one level below. Each array has one more entry, for places outside."""

    symbols: np.ndarray
    spans: np.ndarray
    owners: np.ndarray
    first: np.ndarray
    last: np.ndarray
    parents: np.ndarray
    blocks: bool = False  # whether the next level is made of blocks


def _ids(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


def _bits(symbols: np.ndarray, seed: int) -> np.ndarray:
    x = (symbols.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(bool)


def _level(symbols: np.ndarray, spans: np.ndarray, owners: np.ndarray, first: np.ndarray, last: np.ndarray, below: int) -> Level:
    out = lambda x, end: np.append(x, end)
    return Level(out(symbols, -1), out(spans, 0), owners, out(first, below), out(last, -1), np.full(len(symbols) + 1, -1, np.int64))


class Grammar:
    """symbols: of all sequences, one after the other; equal symbols of different sequences have different numbers. owners:
    the sequence of each place, in order, from 0."""

    def __init__(self, symbols: np.ndarray, owners: np.ndarray):
        places = np.arange(len(symbols), dtype=np.int64)
        self.levels = [_level(symbols.astype(np.int64), np.ones(len(symbols), np.int64), owners.astype(np.int64), places, places, len(symbols))]
        seed = 0
        while True:
            top = self.levels[-1]
            s, owner = top.symbols[:-1], top.owners
            if not len(s):
                return
            again = np.bincount(s)[s] > 1
            live = np.bincount(owner, weights=again)[owner] > 0
            if not live.any():
                return
            kept = np.flatnonzero(live)
            s, owner, span = s[kept], owner[kept], top.spans[:-1][kept]
            differs = s[1:] != s[:-1]
            if not differs.all():
                self._grow(top, kept, np.flatnonzero(np.append(True, differs)), s, owner, span, True)
                continue
            best = None
            for t in range(TRIES):
                bits = _bits(s, seed * TRIES + t)
                same = owner[1:] == owner[:-1]
                for way in (bits[:-1] & ~bits[1:] & same, ~bits[:-1] & bits[1:] & same):
                    if best is None or way.sum() > best.sum():
                        best = way
            seed += 1
            self._grow(top, kept, np.flatnonzero(np.append(True, ~best)), s, owner, span, False)

    def _grow(self, top: Level, kept: np.ndarray, heads: np.ndarray, s: np.ndarray, owner: np.ndarray, span: np.ndarray, blocks: bool) -> None:
        """Adds the level whose symbols begin at the heads among the kept places."""
        sizes = np.diff(np.append(heads, len(s)))
        tails = heads + sizes - 1
        if blocks:
            keys = s[heads] * (int(sizes.max()) + 1) + sizes
        else:
            keys = s[heads] * (int(s.max()) + 2) + np.where(sizes == 2, s[tails] + 1, 0)
        spans = np.add.reduceat(span, heads)
        top.parents[kept] = np.repeat(np.arange(len(heads)), sizes)
        top.blocks = blocks
        self.levels.append(_level(_ids(keys), spans, owner[heads], kept[heads], kept[tails], len(top.symbols) - 1))

    def extensions(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words from a and from b on are equal, going right (step 1) or left (-1). a and b differ."""
        total = np.zeros(len(a), np.int64)
        stuck: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        for k, low in enumerate(self.levels):
            sym, span, up = low.symbols, low.spans, low.parents
            done = np.zeros(len(which), bool)
            if k + 1 < len(self.levels):
                high = self.levels[k + 1]
                edge = high.first if step > 0 else high.last
                far = high.last if step > 0 else high.first
                for _ in range(2):
                    inside = (up[a] >= 0) & (up[b] >= 0)
                    move = ~done & ~(inside & (edge[up[a]] == a) & (edge[up[b]] == b))
                    equal = sym[a] == sym[b]
                    done |= move & ~(equal & inside)
                    move &= equal & inside
                    if not move.any():
                        break
                    at, one, two = np.flatnonzero(move), a[move], b[move]
                    if low.blocks:
                        left, right = np.abs(far[up[one]] - one) + 1, np.abs(far[up[two]] - two) + 1
                        n = np.minimum(left, right)
                        done[at] |= left != right
                    else:
                        n = 1
                    total[which[at]] += n * span[one]
                    a[at] += step * n
                    b[at] += step * n
                inside = (up[a] >= 0) & (up[b] >= 0)
                done |= ~(inside & (edge[up[a]] == a) & (edge[up[b]] == b))
            else:
                done[:] = True
            stuck.append((which[done], a[done], b[done]))
            which, a, b = which[~done], up[a[~done]], up[b[~done]]
            if not len(which):
                break
        which, a, b = stuck.pop()
        for k in range(len(stuck), 0, -1):
            high, low = self.levels[k], self.levels[k - 1]
            edge, far = (high.first, high.last) if step > 0 else (high.last, high.first)
            one, two = edge[a], edge[b]
            equal = low.symbols[one] == low.symbols[two]
            n = equal.astype(np.int64)
            if low.blocks:
                n *= np.minimum(np.abs(far[a] - one), np.abs(far[b] - two)) + 1
            total[which] += n * low.spans[one]
            one, two = one + step * n, two + step * n
            more = stuck.pop()
            which, a, b = (np.concatenate(x) for x in zip((which, one, two), more, strict=True))
        return total
