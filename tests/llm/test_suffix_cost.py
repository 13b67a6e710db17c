"""Suffix order by packed sorts: the same order as by comparison, and nothing settled is sorted again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from trialforge.llm import substring


def texts():
    rng = np.random.default_rng(11)
    passage = rng.integers(0, 256, 90).astype(np.uint8)
    yield rng.integers(97, 99, 700).astype(np.uint8)
    yield np.zeros(300, np.uint8)
    yield np.tile(rng.integers(97, 123, 7).astype(np.uint8), 80)
    yield np.concatenate([passage, rng.integers(0, 256, 50).astype(np.uint8), passage, passage[:60], passage])
    yield np.arange(256).repeat(3).astype(np.uint8)


@pytest.mark.parametrize("chunk", [1, 16, 1 << 17])
def test_order_and_classes(monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    for text in texts():
        for length in (9, 17, 33, 60, 200):
            for at in (None, np.arange(0, len(text) - length, 3), np.arange(max(0, len(text) - length))):
                if at is not None and not len(at):
                    continue
                levels, orders = [], []
                rank = substring.suffix_classes(text, length, at, levels, orders)
                places = np.arange(len(text)) if at is None else at
                keys = [text[i : i + length].tobytes() for i in places.tolist()]
                (order,) = orders
                assert sorted(order.tolist()) == list(range(len(places)))
                for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
                    assert keys[a] <= keys[b] and (rank[a] == rank[b]) == (keys[a] == keys[b]) and rank[a] <= rank[b]
                for depth, ranks in levels:
                    assert depth < length and len(ranks) == len(text)
                    whole = [text[i : i + depth].tobytes() for i in range(len(text))]
                    assert len(set(zip(whole, ranks.tolist()))) == len(set(whole)) == len(set(ranks.tolist()))


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    """Of a text without repeats, nothing is sorted after the first bytes; of one repeat of 300 bytes, its two copies."""
    sorted_again = []
    whole = substring.split_classes
    monkeypatch.setattr(substring, "split_classes", lambda classes, key, bits: (sorted_again.append(len(classes)), whole(classes, key, bits))[1])
    text = np.random.default_rng(2).integers(0, 256, 40000).astype(np.uint8)
    substring.suffix_classes(text, 200)
    assert sum(sorted_again) < 100
    text[30000:30300] = text[1000:1300]
    sorted_again.clear()
    substring.suffix_classes(text, 200)
    assert 0 < sum(sorted_again) < 6 * 600


def test_anchors_do_not_look_beyond_a_string(monkeypatch):
    """Runs of strings are as by looking at every string, and the search for lesser hashes ends within its length."""
    rng = np.random.default_rng(7)
    words = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(1, 9, 60)]
    rows = [" ".join(words[k] for k in rng.integers(0, 60, n)) for n in (0, 1, 40, 400, 3, 900)] + ["é" * 300, "a" * 700]
    group = substring.Group(pa.table({"doc_id": list(range(len(rows))), "text": rows}))
    rounds = []
    smaller = substring.nearest_smaller
    monkeypatch.setattr(substring, "nearest_smaller", lambda *a, **k: (rounds.append(k.get("reach")), smaller(*a, **k))[1])
    for length, gram in ((200, 32), (40, 12)):
        found = substring.ByteAnchors(group, length, gram)
        covered = np.concatenate([np.arange(a, b) for a, b in zip(found.run_start.tolist(), found.run_end.tolist())])
        want = [p for a, b in zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist()) for p in range(a, b - length + 1)]
        assert covered.tolist() == want
        # equal strings have equal anchors
        anchor = np.repeat(found.hash, found.run_end - found.run_start)
        seen: dict[bytes, int] = {}
        assert all(seen.setdefault(group.data[p : p + length].tobytes(), int(h)) == int(h) for p, h in zip(want, anchor))
    assert set(rounds) == {200 - 32 + 1, 40 - 12 + 1}
