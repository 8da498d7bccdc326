"""Automata over bytes, scanned in pieces whose entry states aren't known yet.

A piece is summed up by what it does from every state: the state it ends in and how often each kind of
mark occurs on the way. Summaries compose associatively, so pieces are scanned in parallel, here the
lanes of a buffer and in :mod:`fill_in_middle` the chunks of a giant document, and a second look with
the resolved entry state finds a mark by its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbol beyond the bytes: a new text begins here.
RESET = 256


@dataclass(frozen=True)
class Automaton:
    """``step[s, c]`` is the state after symbol c (0 to 255, or RESET); ``marks[kind][s, c]`` is 1 where c
    is such a mark. State 0 is the first."""

    step: np.ndarray
    marks: tuple[np.ndarray, ...]


def unit_automaton(units: str = "lines") -> Automaton:
    """Marks the first byte of every unit. Lines end with a line feed, which belongs to them; words are
    runs of anything but white space, and what lies between them belongs to the word before."""
    step, mark = np.zeros((2, 257), np.uint8), np.zeros((2, 257), np.uint8)
    if units == "lines":  # 0: before a unit, 1: inside one
        step[:, :256] = 1
        step[:, 10] = 0
        mark[0, :256] = 1
    elif units == "words":
        gap = [9, 10, 11, 12, 13, 32]
        step[:, :256] = 1
        step[:, gap] = 0
        mark[0, :256] = 1
        mark[0, gap] = 0
    else:
        raise ValueError(f"no such units: {units}")
    return Automaton(step, (mark,))


def string_automaton(strings: list[bytes]) -> Automaton:
    """Marks the last byte of every occurrence of any of ``strings``."""
    heads = sorted({s[:i] for s in strings for i in range(len(s) + 1)}, key=lambda h: (len(h), h))
    number = {h: i for i, h in enumerate(heads)}
    step, mark = np.zeros((len(heads), 257), np.uint8), np.zeros((len(heads), 257), np.uint8)
    for h, i in number.items():
        for c in range(256):
            seen = h + bytes([c])
            longest = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in number)
            step[i, c] = number[longest]
            mark[i, c] = any(seen.endswith(s) for s in strings)
    return Automaton(step, (mark,))


def minimal(a: Automaton) -> Automaton:
    """The same with states merged that nothing to come can tell apart (the number of the first stays 0)."""
    table = np.hstack([*a.marks])
    group = np.zeros(len(a.step), np.int64)
    while True:
        _, first, nxt = np.unique(np.hstack([group[:, None], table, group[a.step]]), axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)  # numbered by the first state of each group
        nxt = np.argsort(order)[nxt.ravel()]
        if (nxt == group).all():
            keep = first[order]
            return Automaton(group[a.step[keep]].astype(np.uint8), tuple(m[keep] for m in a.marks))
        group = nxt


def product(a: Automaton, b: Automaton) -> Automaton:
    """Both at once; only pairs of states that can be reached from the first ones are kept."""
    number, todo = {(0, 0): 0}, [(0, 0)]
    for s, t in todo:
        for pair in set(zip(a.step[s].tolist(), b.step[t].tolist())):
            if pair not in number:
                number[pair] = len(number)
                todo.append(pair)
    step = np.array([[number[p] for p in zip(a.step[s].tolist(), b.step[t].tolist())] for s, t in todo], np.uint8)
    left, right = [s for s, _ in todo], [t for _, t in todo]
    return Automaton(step, (*(m[left] for m in a.marks), *(m[right] for m in b.marks)))


def _lanes(symbols: np.ndarray) -> np.ndarray:
    """Symbols as a matrix whose columns, the lanes, are runs of about as many symbols as there are lanes;
    the rest is filled with a symbol of its own, 257, that changes nothing."""
    width = max(16, int(len(symbols) ** 0.5))
    n = -(-len(symbols) // width)
    full = np.full(n * width, 257, np.int64)
    full[: len(symbols)] = symbols
    return np.ascontiguousarray(full.reshape(n, width).T)


def _widened(a: Automaton) -> tuple[np.ndarray, list[np.ndarray]]:
    """Flat tables with the symbol 257, looked up at row + symbol; a state is the row it begins at."""
    idle = np.arange(len(a.step), dtype=np.int64)[:, None]
    return 258 * np.hstack([a.step, idle]).ravel().astype(np.int64), [np.hstack([m, 0 * idle]).ravel() for m in a.marks]


def _rows(a: Automaton, n: int) -> np.ndarray:
    """Every state for each of n lanes, as rows of the tables."""
    return np.repeat(258 * np.arange(len(a.step), dtype=np.int64), n).reshape(-1, n)


def summary(a: Automaton, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end state, marks of each kind) of the whole run from every entry state, by composing its lanes."""
    states = np.arange(len(a.step))
    if not len(symbols):
        return states, np.zeros((len(a.marks), len(states)), np.int64)
    lanes = _lanes(symbols)
    step, marks = _widened(a)
    end = _rows(a, lanes.shape[1])
    count = np.zeros((len(marks), *end.shape), np.int64)
    for column in lanes:
        end += column
        for total, m in zip(count, marks):
            total += m.take(end)
        end = step.take(end)
    end, count = (end // 258).T, count.transpose(0, 2, 1)
    while len(end) > 1:  # neighbours are composed two by two
        odd_end, odd_count = (end[-1:], count[:, -1:]) if len(end) % 2 else (end[:0], count[:, :0])
        half = len(end) // 2 * 2
        first, second, c1, c2 = end[0:half:2], end[1:half:2], count[:, 0:half:2], count[:, 1:half:2]
        end = np.concatenate([np.take_along_axis(second, first, 1), odd_end])
        count = np.concatenate([c1 + np.take_along_axis(c2, np.broadcast_to(first, c1.shape), 2), odd_count], 1)
    return end[0], count[:, 0]


def marked(a: Automaton, symbols: np.ndarray, entry: int = 0) -> list[np.ndarray]:
    """Positions of the marks of each kind, for a run entered in state ``entry``: lanes are scanned from
    every state, their functions composed, and then once more from the state that each is entered in."""
    if not len(symbols):
        return [np.zeros(0, np.int64) for _ in a.marks]
    lanes = _lanes(symbols)
    step, marks = _widened(a)
    state = _rows(a, lanes.shape[1])
    for column in lanes:
        state += column
        state = step.take(state)
    entered = []
    for lane in (state // 258).T.tolist():
        entered.append(entry)
        entry = lane[entry]
    at = 258 * np.array(entered, np.int64)
    for column in lanes:
        column += at  # where the tables are looked up takes the symbol's place
        at = step.take(column)
    seen = lanes.T.ravel()
    return [np.flatnonzero(m.take(seen)) for m in marks]
