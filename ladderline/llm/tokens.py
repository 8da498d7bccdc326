"""Token ids of whole texts, by the tokenizers library, at the cost of distinct words.

A text is cut where no token can reach across, each distinct piece is encoded once, and the ids of
a text are gathered from the ids of its pieces with numpy. Cuts are exact:

* a tokenizer that drops white space (``space_prefix=False``): at every space;
* a byte-level tokenizer whose pattern gives a space to the word after it (``space_prefix=True``):
  before a space that has a non-space on both sides. Nothing else of its pattern holds a space
  together with something before it, and no lookahead crosses such a place.

New pieces made of Latin letters, sentence punctuation and line feeds are cut further into units that
both patterns keep apart (a run of letters, a run of punctuation, a line feed); a run of letters goes
to the library's BPE model directly, which its own pipeline does too, after a mapping of bytes to
characters. All other new pieces go through the library's whole pipeline.

The memory of pieces lives as long as the Python worker. At ``max_pieces`` the half of it that came
least often is forgotten, which costs time, never ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that is not between two non-spaces (white space as Python or Unicode sees it).
_LOOSE = "^ | $|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] | [\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Latin letters that stay one letter each when lowered and composed.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Pieces that fall into units (letters, punctuation, single line feeds between words), and the units.
_PLAIN = re.compile(f"[{_LETTERS}]+[.,;:!?]*(?:\n[{_LETTERS}]+[.,;:!?]*)*")
_UNIT = re.compile(f"[{_LETTERS}]+|[.,;:!?]+|\n")
_WORD = re.compile(f"[{_LETTERS}]+")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Distinct pieces that go to the tokenizer at once, and bytes of text that are worked on at once.
_AT_ONCE, _SLICE_BYTES = 4096, 4 << 20

_ENCODERS: dict[tuple, Encoder] = {}


def _byte_characters() -> dict[int, str]:
    """The character that byte-level models have for each byte: itself if it prints, else one after 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """``encode`` gives the ids of an Arrow string array, each text closed by ``end_id``."""

    def __init__(self, path: str, space_prefix: bool, end_id: int, max_pieces: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.space_prefix, self.end_id, self.max_pieces = space_prefix, end_id, max_pieces
        normal = self.tokenizer.normalizer
        #: Texts may be lowered first (A-Z), which joins many pieces, if the tokenizer does so itself.
        self.lowers = normal is not None and normal.normalize_str("AZ") == "az"
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.direct = self._model_agrees()
        self._clear()

    def _model_agrees(self) -> bool:
        """Whether the model alone gives a run of letters the ids that the whole pipeline does."""
        some = ["a", "Hello", "straße", "Écoutez", "niñoÿ", "zzzzqx"]
        spaced = (False, True) if self.space_prefix else (False,)
        whole = [self.tokenizer.encode(" " * s + x, add_special_tokens=False).ids for x in some for s in spaced]
        return whole == [self._letters(x, s) for x in some for s in spaced]

    def _letters(self, run: str, spaced: bool) -> list[int]:
        if self.lowers:
            run = run.lower()
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(self.characters[32] + run if spaced else run)]

    def _clear(self) -> None:
        # piece -> number; the piece as it stands, and with a space before it
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.flat = np.array([self.end_id], dtype=np.uint32)  # number 0 is the end id
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.seen = np.ones(1, np.int64)  # in how many slices of text
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def _trim(self) -> None:
        """Keep the half of ``max_pieces`` that came most often; what it came before counts half from now on."""
        keep = np.zeros(len(self.seen), bool)
        keep[np.argsort(-self.seen, kind="stable")[: max(self.max_pieces // 2, 1)]] = True
        keep[0] = True
        number, kept = (np.cumsum(keep) - 1).tolist(), keep.tolist()
        self.known = tuple({p: number[n] for p, n in known.items() if kept[n]} for known in self.known)
        length = self.lengths[keep]
        start = np.cumsum(length) - length
        self.flat = self._gather(np.flatnonzero(keep))
        self.starts, self.lengths, self.seen = start, length, self.seen[keep] // 2

    def _numbers(self, pieces: pa.Array, spaced: bool) -> np.ndarray:
        """The number of each distinct piece; encodes those that are new."""
        known, values = self.known[spaced], pieces.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(known.get, values, repeat(-1)), np.int64, len(values))
        fresh = np.flatnonzero(numbers < 0).tolist()
        if fresh:
            self._learn([values[k] for k in fresh], spaced)
            numbers[fresh] = np.fromiter(map(known.__getitem__, (values[k] for k in fresh)), np.int64, len(fresh))
        self.seen[numbers] += 1
        return numbers

    def _learn(self, fresh: list[str], spaced: bool) -> None:
        """Number distinct new pieces."""
        known, made, plain = self.known[spaced], [], []
        whole: tuple[list[str], list[str]] = ([], [])  # for the whole pipeline
        for p in fresh:
            if not (self.direct and _PLAIN.fullmatch(p)):
                whole[spaced].append(p)
            elif _WORD.fullmatch(p):
                plain.append((p, spaced))
            else:
                units = _UNIT.findall(p)
                made.append((p, units))
                plain.append((units[0], spaced))
                for u in units[1:]:
                    if u[0].isalpha():
                        plain.append((u, False))
                    elif u not in self.known[False]:
                        whole[False].append(u)
        ids, lengths = [], []
        first = len(self.lengths)
        for p, s in plain:
            if p not in self.known[s]:
                own = self._letters(p, s)
                self.known[s][p] = first + len(lengths)
                ids += own
                lengths.append(len(own))
        self.waiting.append((np.array(ids, dtype=np.uint32), np.array(lengths, dtype=np.int64)))
        for s in (False, True):
            new = list(dict.fromkeys(whole[s]))
            for i in range(0, len(new), _AT_ONCE):
                part = new[i : i + _AT_ONCE]
                e = self.tokenizer.encode([" " + p for p in part] if s else part, is_pretokenized=True, add_special_tokens=False)
                word = np.array(e.word_ids, dtype=np.int64)
                self._add(self.known[s], part, np.array(e.ids, dtype=np.uint32), np.bincount(word, minlength=len(part)))
        self._settle()
        if made:
            lone = self.known[False]
            each = [[known[u[0]], *(lone[x] for x in u[1:])] for _, u in made]
            count = np.fromiter(map(len, each), np.int64, len(each))
            parts = np.fromiter((n for x in each for n in x), np.int64, int(count.sum()))
            sizes = np.add.reduceat(self.lengths[parts], np.cumsum(count) - count)
            self._add(known, [p for p, _ in made], self._gather(parts), sizes)
            self._settle()

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        length = self.lengths[numbers]
        start = np.cumsum(length) - length
        return self.flat[np.arange(length.sum()) + np.repeat(self.starts[numbers] - start, length)]

    def _add(self, known: dict[str, int], pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Number new pieces; :meth:`_settle` puts their ids where they can be gathered."""
        first = len(self.lengths) + sum(len(x[1]) for x in self.waiting)
        known.update(zip(pieces, range(first, first + len(pieces))))
        self.waiting.append((ids, lengths.astype(np.int64)))

    def _settle(self) -> None:
        if self.waiting:
            length = np.concatenate([x[1] for x in self.waiting])
            start = len(self.flat) + np.cumsum(length) - length
            self.flat = np.concatenate([self.flat, *(x[0] for x in self.waiting)])
            self.starts = np.concatenate([self.starts, start])
            self.lengths = np.concatenate([self.lengths, length])
            self.seen = np.concatenate([self.seen, np.zeros(len(length), np.int64)])
            self.waiting = []

    def _distinct(self, pieces: pa.Array, spaced: bool) -> np.ndarray:
        if not len(pieces):
            return np.zeros(0, np.int64)
        d = pieces.dictionary_encode()
        return self._numbers(d.dictionary, spaced)[d.indices.to_numpy(zero_copy_only=False)]

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and how many each text has."""
        if self.lowers:  # but for texts that may hold special tokens, which are found as they stand
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.split_pattern(texts, " ")
        counts = np.diff(split.offsets.to_numpy())
        pieces = split.flatten()
        if not self.space_prefix:
            return self._distinct(pieces, False), counts
        first = np.zeros(len(pieces), bool)
        first[np.cumsum(counts) - counts] = True
        numbers = np.empty(len(pieces), np.int64)
        numbers[first] = self._distinct(pieces.filter(pa.array(first)), False)
        numbers[~first] = self._distinct(pieces.filter(pa.array(~first)), True)
        return numbers, counts

    def _slices(self, texts: pa.Array) -> Iterator[pa.Array]:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            if size and size + n > _SLICE_BYTES:
                yield texts.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < len(texts):
            yield texts.slice(at)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each slice of the texts: how many it has, their ids, and the ids of each one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts):  # offsets that don't begin at 0 mislead some kernels
            texts = texts.take(pa.array(np.arange(len(texts))))
        for part in self._slices(texts):
            if len(self.lengths) > self.max_pieces:
                self._trim()
            if self.space_prefix and pc.any(loose := pc.match_substring_regex(part, _LOOSE)).as_py():
                numbers, counts = self._mixed(part, loose.to_numpy(zero_copy_only=False))
            else:
                numbers, counts = self._pieces(part)
            ends = np.cumsum(counts)
            numbers = np.insert(numbers, ends, 0)
            total = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
            bounds = total[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
            yield len(part), self._gather(numbers), np.diff(bounds)

    def _mixed(self, part: pa.Array, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with loose spaces are cut by the general pattern, the others as usual."""
        tight = np.flatnonzero(~loose)
        odd = np.flatnonzero(loose)
        a, n_a = self._pieces(part.take(pa.array(tight))) if len(tight) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        cut = [_CUT.split(part[int(i)].as_py()) for i in odd]
        b = self._distinct(pa.array([p for c in cut for p in c], pa.large_string()), False)
        n_b = np.array([len(c) for c in cut], np.int64)
        counts = np.empty(len(part), np.int64)
        counts[tight], counts[odd] = n_a, n_b
        owner = np.concatenate([np.repeat(tight, n_a), np.repeat(odd, n_b)])
        return np.concatenate([a, b])[np.argsort(owner, kind="stable")], counts


def encoder(path: str, space_prefix: bool, end_id: int) -> Encoder:
    """One per Python worker and tokenizer file."""
    key = (path, space_prefix, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
