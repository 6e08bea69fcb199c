"""Chinese-restaurant seating of many dishes at once, sampled by Gibbs.

A dish has customers at tables. A step takes one customer of every dish from their table, which closes if
nobody is left, and seats them again given all others: at a table of n in proportion to n less the
discount, or at a new one in proportion to the dish's pull. In a sweep a dish has as many steps as customers.
Dishes of over LARGE customers have them reseated in groups, each customer being in a round's group with a chance of
one in ROUNDS; within a group the odds are held.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LARGE, ROUNDS = 32, 16

#: (dishes, their tables now, tables that have just closed) -> pull of each; and a note of how many tables have opened.
Pull = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Note = Callable[[np.ndarray, np.ndarray], None]


class Seating:
    """Tables of dishes 0 to n - 1: `dish` (rising) and `size` of each table."""

    def __init__(self, n: int, dish: np.ndarray, size: np.ndarray):
        self.n, self.dish, self.size = n, dish.astype(np.int64), size.astype(np.int64)

    @staticmethod
    def together(counts: np.ndarray) -> Seating:
        """All customers of a dish at one table."""
        some = np.flatnonzero(counts > 0)
        return Seating(len(counts), some, counts[some])

    def customers(self) -> np.ndarray:
        return np.bincount(self.dish, weights=self.size, minlength=self.n).astype(np.int64)

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=self.n)

    def sweep(self, discount: float, pull: Pull, rng: np.random.Generator, note: Note = lambda dishes, opened: None) -> None:
        """Reseat customers of all dishes that have two or more."""
        counts, tables = self.customers(), self.tables()
        first = np.searchsorted(self.dish, np.arange(self.n + 1))
        done = [(self.dish[k], self.size[k]) for k in [np.flatnonzero(counts[self.dish] < 2)]]
        width = 2
        while width <= LARGE:
            own = np.flatnonzero((counts > width // 2) & (counts <= width) & (counts > 1))
            if len(own):
                rows = np.zeros((len(own), width), dtype=np.int64)
                column = np.arange(width)
                there = column < tables[own, None]
                rows[there] = self.size[(first[own, None] + column)[there]]
                _small(rows, own, counts[own], tables[own], discount, pull, rng, note)
                at, _ = np.nonzero(rows)
                done.append((own[at], rows[rows > 0]))
            width *= 2
        own = np.flatnonzero(counts > LARGE)
        if len(own):
            mine = np.flatnonzero(counts[self.dish] > LARGE)
            done.append(_large(np.searchsorted(own, self.dish[mine]), self.size[mine], own, discount, pull, rng, note))
        dish, size = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]

    def resize(self, counts: np.ndarray, discount: float, pull: Pull, rng: np.random.Generator) -> None:
        """Take random customers away or seat new ones until every dish has as many as it should."""
        while True:
            change = counts - self.customers()
            which = np.flatnonzero(change)
            if not len(which):
                return
            # a sixteenth of a dish's customers at once, one at least
            most = np.maximum(1, self.customers()[which] // ROUNDS)
            less = np.minimum(-change[which], most)
            more = np.minimum(change[which], most)
            self._take(which[less > 0], less[less > 0], rng)
            self._seat(which[more > 0], more[more > 0], discount, pull, rng)

    def _take(self, which: np.ndarray, how_many: np.ndarray, rng: np.random.Generator) -> None:
        """Of a drawn group with repetitions, no table gives more than it has; `resize` asks again for what is missing."""
        if not len(which):
            return
        sums = np.append(0, np.cumsum(self.size))
        low, high = np.searchsorted(self.dish, which), np.searchsorted(self.dish, which, side="right")
        who = np.repeat(np.arange(len(which)), how_many)
        place = sums[low[who]] + np.floor(rng.random(len(who)) * (sums[high[who]] - sums[low[who]]))
        table = np.minimum(np.searchsorted(sums, place, side="right") - 1, len(self.size) - 1)
        self.size = np.maximum(self.size - np.bincount(table, minlength=len(self.size)), 0)
        kept = self.size > 0
        self.dish, self.size = self.dish[kept], self.size[kept]

    def _seat(self, which: np.ndarray, how_many: np.ndarray, discount: float, pull: Pull, rng: np.random.Generator) -> None:
        if not len(which):
            return
        counts, tables = self.customers()[which], self.tables()[which]
        draw = pull(which, tables, np.zeros(len(which), dtype=np.int64))
        opened = np.where(counts > 0, rng.binomial(how_many, np.clip(draw / (draw + counts - discount * tables), 0, 1)), 1)
        joined = np.where(counts > 0, how_many - opened, 0)
        self.size = self.size + _joins(self.dish, self.size, which, joined, discount, rng)
        dish = np.concatenate([self.dish, np.repeat(which, opened)])
        size = np.concatenate([self.size, np.ones(int(opened.sum()), dtype=np.int64)])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]


def _joins(dish: np.ndarray, size: np.ndarray, which: np.ndarray, joined: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many of the joining customers each table gets, in proportion to its size less the discount."""
    sums = np.append(0, np.cumsum(np.maximum(size - discount, 0)))
    low, high = np.searchsorted(dish, which), np.searchsorted(dish, which, side="right")
    who = np.repeat(np.arange(len(which)), joined)
    place = sums[low[who]] + rng.random(len(who)) * (sums[high[who]] - sums[low[who]])
    table = np.clip(np.searchsorted(sums, place, side="right") - 1, low[who], high[who] - 1)
    return np.bincount(table, minlength=len(size))


def _small(rows: np.ndarray, dishes: np.ndarray, counts: np.ndarray, tables: np.ndarray, discount: float, pull: Pull, rng: np.random.Generator, note: Note) -> None:
    """One customer of every dish at a time; `rows` has a dish's tables, 0 where there is none."""
    for step in range(int(counts.max())):
        own = np.flatnonzero(counts > step)
        here = np.arange(len(own))
        some, n = rows[own], counts[own]
        who = np.floor(rng.random(len(own)) * n)
        table = (np.cumsum(some, axis=1) <= who[:, None]).sum(axis=1)
        some[here, table] -= 1
        closed = (some[here, table] == 0).astype(np.int64)
        t = tables[own] - closed
        draw = pull(dishes[own], t, closed)
        weights = np.cumsum(np.where(some > 0, some - discount, 0.0), axis=1)
        total = weights[:, -1]
        place = rng.random(len(own)) * (total + draw)
        opened = place >= total
        table = np.where(opened, (some == 0).argmax(axis=1), (weights <= place[:, None]).sum(axis=1))
        some[here, table] += 1
        rows[own] = some
        tables[own] = t + opened
        note(dishes[own], opened - closed)


def _large(dish: np.ndarray, size: np.ndarray, dishes: np.ndarray, discount: float, pull: Pull, rng: np.random.Generator, note: Note) -> tuple[np.ndarray, np.ndarray]:
    """ROUNDS groups of customers of every dish."""
    n = len(dishes)
    every = np.arange(n)
    counts = np.bincount(dish, weights=size, minlength=n).astype(np.int64)
    for _ in range(ROUNDS):
        before = np.bincount(dish, minlength=n)
        left = size - rng.binomial(size, 1 / ROUNDS)
        stay = np.bincount(dish, weights=left, minlength=n).astype(np.int64)
        left = np.where(stay[dish] == 0, size, left)  # a group must leave somebody
        stay = np.where(stay == 0, counts, stay)
        dish, left = dish[left > 0], left[left > 0]
        t = np.bincount(dish, minlength=n)
        draw = pull(dishes, t, before - t)
        group = counts - stay
        opened = rng.binomial(group, np.clip(draw / (draw + stay - discount * t), 0, 1))
        left = left + _joins(dish, left, every, group - opened, discount, rng)
        dish = np.concatenate([dish, np.repeat(every, opened)])
        size = np.concatenate([left, np.ones(int(opened.sum()), dtype=np.int64)])
        order = np.argsort(dish, kind="stable")
        dish, size = dish[order], size[order]
        note(dishes, opened - (before - t))
    return dishes[dish], size
