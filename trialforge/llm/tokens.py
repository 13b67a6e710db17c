"""Token ids of whole texts by the tokenizers library, with a memo of repeated units.

A text is cut before each ASCII space that is followed by a character that is no white space.
The byte-level pre-tokenizer always starts a pre-token at such a space, so the ids of the text
are the ids of its units one after another; a unit is encoded by the library once and then
remembered (a unit of Latin letters and then ASCII symbols is two pre-tokens at most, which go
straight to the library's BPE model). A text with a cut that is not certain (runs of white space,
very long units) is encoded whole.

Units are found by a 62-bit hash in a table of numpy arrays, a slice of texts at a time, and a hit
counts only where 32 further bits agree. The memo is per worker process and is emptied when it has
`limit` units, or when the process turns to another operator.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

from trialforge.llm.common import Ranges, buffers, quiet_env, slices

LONGEST_UNIT = 200
#: Letters, then symbols that cannot start a contraction.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-;=?-@\[-`~]*)")
_LATER = np.uint64(0x2545F4914F6CDD1D)


def byte_letters() -> list[str]:
    """The byte-level alphabet by its rule: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class UnitTokenizer:
    def __init__(self, path: str, limit: int = 1_000_000):
        quiet_env()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = limit
        self.mask = np.uint64((1 << (2 * limit).bit_length()) - 1)
        self.narrow = self.library.get_vocab_size() <= 1 << 16
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.checks = np.zeros(int(self.mask) + 1, np.uint32)
        self.values = np.zeros(int(self.mask) + 1, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.units = self.used = 0

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Unit numbers by hash; -1: not there."""
        at = h & self.mask
        got = self.keys[at]
        hit = (got == h) & (self.checks[at] == check)
        out = np.where(hit, self.values[at], -1)
        left = np.flatnonzero(~hit & (got != 0))
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            got = self.keys[at]
            hit = (got == h[left]) & (self.checks[at] == check[left])
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (got != 0)
            left, at = left[on], at[on]
        return out

    def _insert(self, h: np.ndarray, check: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        at = h & self.mask
        while len(h):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == 0]
            self.keys[at[first]], self.checks[at[first]], self.values[at[first]] = h[first], check[first], values[first]
            on = np.ones(len(h), bool)
            on[first] = False
            h, check, values, at = h[on], check[on], values[on], (at[on] + np.uint64(1)) & self.mask

    def _add(self, encoded: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, total = len(encoded), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.units + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.int32, total)
        self.size[self.units : self.units + n] = sizes
        self.begin[self.units : self.units + n] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.units += n

    def _certain(self, part: str, later: bool) -> bool:
        """Whether a unit may be encoded by itself, besides the rules on its length and first character."""
        return True

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_ids(self, units: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        model, letters, left = self.library.model.tokenize, self.letters, []
        for k, unit in enumerate(units):
            if m := _PLAIN.fullmatch(unit):
                space, word, symbols = m.groups()
                ids = [t.id for t in model((space + word).encode().decode("latin-1").translate(letters))]
                out.append(ids + [t.id for t in model(symbols)] if symbols else ids)
            else:
                left.append(k)
                out.append(None)
        for k, ids in zip(left, self._library_ids([units[k] for k in left])):
            out[k] = ids
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts and how many each text has."""
        if self.units > self.limit:
            self.clear()
        docs = len(offsets) - 1
        spaces = np.flatnonzero(data == 0x20)
        # a unit for each text's start and each space: empty ones are dropped or unsafe
        starts = np.concatenate([offsets[:-1], spaces + 1])
        later = np.concatenate([np.zeros(docs, bool), np.ones(len(spaces), bool)])
        order = np.argsort(np.concatenate([offsets[:-1] * 2, spaces * 2 + 1]), kind="stable")
        starts, later = starts[order], later[order]
        doc = np.cumsum(~later) - 1
        # text k starts before the units of its spaces; texts without bytes start at the same place
        ends = np.minimum(np.append(starts[1:] - 1, len(data)), offsets[doc + 1])
        ends = np.where(np.append(~later[1:], True), offsets[doc + 1], ends)
        keep = later | (ends > starts)
        starts, ends, later, doc = starts[keep], ends[keep], later[keep], doc[keep]
        h, check = Ranges(data, 4).of(starts, ends)
        check = check.astype(np.uint32)
        h ^= np.where(later, _LATER, np.uint64(0))
        h[h == 0] = 1
        unit = self._find(h, check)
        missing = np.flatnonzero(unit < 0)
        if len(missing):
            fresh, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            raw, strings, safe = data.tobytes(), [], np.ones(len(fresh), bool)
            # one hash, two units: their texts are encoded whole
            apart = check[missing] != check[missing[first]][back]
            for j, (a, b, sp) in enumerate(zip(starts[missing[first]].tolist(), ends[missing[first]].tolist(), later[missing[first]].tolist())):
                part = raw[a:b].decode()
                if b - a > LONGEST_UNIT or sp and (not part or part[0].isspace()) or not self._certain(part, sp):
                    safe[j] = False
                else:
                    strings.append(" " + part if sp else part)
            number = np.full(len(fresh), -1, np.int64)
            number[safe] = self.units + np.arange(len(strings))
            # the table stays at most two thirds full: what finds no room is used but not remembered
            room = max(0, (len(self.keys) * 2) // 3 - self.units)
            self._add(self._unit_ids(strings))
            self._insert(fresh[safe][:room], check[missing[first]][safe][:room], number[safe][:room].astype(np.int32))
            unit[missing] = np.where(apart, -1, number[back])
        kept = self.units, self.used
        whole = np.unique(doc[unit < 0])
        if len(whole):
            at = self.units
            raw = data.tobytes()
            self._add(self._library_ids([raw[offsets[k] : offsets[k + 1]].decode() for k in whole]))
            on = ~np.isin(doc, whole)
            unit, doc = np.concatenate([unit[on], at + np.arange(len(whole))]), np.concatenate([doc[on], whole])
        if end_id is not None:
            self._add([[end_id]])
            unit, doc = np.concatenate([unit, np.full(docs, self.units - 1)]), np.concatenate([doc, np.arange(docs)])
        order = np.argsort(doc, kind="stable")
        unit, doc = unit[order], doc[order]
        sizes = self.size[unit].astype(np.int64)
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[unit] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
        self.units, self.used = kept
        return ids, np.bincount(doc, weights=sizes, minlength=docs).astype(np.int64)

    def encode_column(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by end_id, and offsets (n + 1) into them; ids of 16 bits if all fit."""
        data, offsets = buffers(column)
        out, sizes = [np.zeros(0, "<u2" if self.narrow else "<u4")], [np.zeros(1, np.int64)]
        for a, b in slices(offsets):
            ids, counts = self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
            out.append(ids.astype(out[0].dtype))
            sizes.append(counts)
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))


_LOADED: dict[str, UnitTokenizer] = {}


def forget() -> None:
    """Empty the memos of this process."""
    for t in _LOADED.values():
        t.clear()


def tokenizer(path: str) -> UnitTokenizer:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = UnitTokenizer(path)
    return _LOADED[path]
