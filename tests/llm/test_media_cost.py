"""What a document costs the codec, and the short ways it takes."""

from __future__ import annotations

import cProfile
import pstats

import numpy as np
import pytest

from trialforge.llm import webp


def payload(n_words: int) -> bytes:
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"etaoinshrdlucmfwypvbgk"), rng.integers(1, 10)).tolist()) for _ in range(300)]
    text = b" ".join(words[k] for k in rng.zipf(1.3, n_words) % 300)
    return text + bytes(-len(text) % 64)


def test_calls_of_a_document():
    """A document of 2.5 KB took 1882 calls in and out; they, not its bytes, were most of the time."""
    text = payload(450)
    webp.from_media(webp.to_media(text))
    with cProfile.Profile() as calls:
        found = webp.from_media(webp.to_media(text))
    assert found == text and pstats.Stats(calls).total_calls < 1500


def test_tables_of_short_codes_equal_prefix_codes():
    rng = np.random.default_rng(5)
    for n in range(1, 20):
        counts = np.zeros(19, np.int64)
        counts[rng.choice(19, n, replace=False)] = rng.integers(1, 60, n)
        lengths = webp.code_lengths(counts, 7).astype(np.int64)
        used = np.flatnonzero(lengths)
        table, mask = webp._table_of_lengths(lengths.tolist())
        code = webp.PrefixCode(used, lengths[used])
        assert table == code.table.tolist() and mask == (1 << code.longest) - 1
    for lengths in ([0] * 19, [1, 2], [1, 1, 1], [2, 2, 2]):
        with pytest.raises(ValueError):
            webp._table_of_lengths(lengths)


def test_repeats_of_green_pixels_are_exact():
    """The same pixels through the general way, which compares hashes and then pixels, give a file of the same pixels."""
    flat = np.frombuffer(payload(900), np.uint8).astype(np.uint32) << np.uint32(8)
    for exact in (True, False):
        end = 0
        for b, m, d in zip(*(x.tolist() for x in webp.back_references(flat, exact))):
            assert b >= max(end, d) and (flat[b : b + m] == flat[b - d : b - d + m]).all()
            end = b + m


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(8)
    for n in (2, 3, 40, 280):
        counts = np.zeros(300, np.int64)
        counts[rng.choice(300, n, replace=False)] = rng.integers(1, 1000, n)
        mine, best = webp._lengths(counts, 15), webp.code_lengths(counts, 15)
        assert (mine * counts).sum() == (best * counts).sum() and (2.0 ** -mine[mine > 0]).sum() == 1


def test_small_values_have_the_symbols_of_all():
    values = np.arange(1, 20000)
    for k in (1, 100, 8191, 8192, 19999):
        assert all((a == b).all() for a, b in zip(webp._prefix(values[:k]), webp._prefix_of(values[:k])))
