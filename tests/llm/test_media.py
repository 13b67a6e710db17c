"""The media table is stored, and what the query tells is read from it."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from trialforge.llm import queries, webp
from trialforge.llm.common import documents, shared_dir


def test_media_are_read_from_storage(spark, sf):
    got = queries.op9_lossless_webp(spark, sf)
    files = [f for f in got.inputFiles() if f.startswith(shared_dir(spark))]
    assert files and all(Path(f.removeprefix("file://")).exists() for f in files) and len(files) == len(got.inputFiles())
    stored = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(*files).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark, sf).collect()}
    assert stored.keys() == texts.keys()
    assert all(webp.from_media(stored[k])[: len(t)] == t for k, t in texts.items())


def pictures():
    """Pictures with more colours than a palette holds, with few, with runs and with repeats."""
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:37, :53]
    smooth = np.stack([3 * x + y, x + 2 * y, 2 * x + y // 3, np.full_like(x, 255)], axis=-1)
    noisy = smooth + rng.integers(0, 4, smooth.shape)
    noise = rng.integers(0, 256, (20, 31, 4))
    tiles = np.tile(rng.integers(0, 256, (5, 8, 4)), (6, 4, 1))
    few = rng.integers(0, 3, (9, 13, 1)) * np.array([1, 0, 0, 0])
    out = [p.astype(np.uint8).view("<u4")[..., 0] for p in map(np.ascontiguousarray, (smooth, noisy, noise, tiles, few, noise[:1, :1], noise[:1], noise[:, :1]))]
    return out + [rng.integers(0, n, (17, 16)).astype("<u4") << 8 for n in (1, 2, 3, 5, 16, 17, 256)]


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
def test_every_tool_of_the_encoder(cache_bits):
    for picture in pictures():
        for size_bits in (2, 4, 9):
            assert (webp.decode_webp(webp.encode_webp(picture, cache_bits, size_bits)) == picture).all()


def test_decoding_at_once_equals_symbol_by_symbol(monkeypatch):
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 110, rng.integers(1, 9)).tolist()) for _ in range(50)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 50, n)) for n in (1, 30, 600)] + [b"a" * 9000, b"ab" * 3000, b"line of text\n" * 500, bytes(range(256)) * 4, rng.integers(0, 256, 5000).astype(np.uint8).tobytes()]
    media = [webp.to_media(t + bytes(-len(t) % 64)) for t in texts]
    assert [webp.from_media(m)[: len(t)] for m, t in zip(media, texts)] == texts
    assert all(len(m) < 300 for m in media[3:6])
    files = [*media, *(webp.encode_webp(p) for p in pictures())]
    at_once = [webp.decode_webp(f) for f in files]
    monkeypatch.setattr(webp, "_at_once", lambda bits, group, n, width: webp._one_by_one(bits, [group], n, width))
    assert all((webp.decode_webp(f) == p).all() for f, p in zip(files, at_once))


def test_copies_do_not_overlap_and_are_true():
    rng = np.random.default_rng(9)
    for n, letters in ((1, 2), (7, 1), (8, 1), (300, 2), (5000, 3), (20000, 1)):
        pixels = rng.integers(0, letters, n).astype(np.uint32)
        begin, length, back = webp.back_references(pixels)
        end = 0
        for b, m, d in zip(begin.tolist(), length.tolist(), back.tolist()):
            assert b >= max(end, d) and 0 < m <= webp.LONGEST_COPY
            assert all(pixels[k] == pixels[k - d] for k in range(b, b + m))
            end = b + m


def test_a_cut_file_is_refused():
    whole = webp.encode_webp(np.random.default_rng(1).integers(0, 90, (64, 64)).astype("<u4") << 8)
    for n in (30, 60, 400, len(whole) - 40):
        with pytest.raises(ValueError):
            webp.decode_webp(whole[:n])


def test_long_texts_have_several_files():
    payload = np.random.default_rng(2).integers(97, 123, webp.WIDTH * (webp.MAX_SIDE + 5)).astype(np.uint8).tobytes()
    media = webp.to_media(payload)
    assert media.count(b"WEBPVP8L") == 2 and webp.from_media(media) == payload


def test_documents_use_predictors_where_shorter():
    """A text of even steps is predicted; one of repeats keeps its palette and copies, which are shorter."""
    ramp = bytes((i // 3 + i % 64) % 256 for i in range(64 * 200))
    first_transform = lambda media: (int.from_bytes(media[20:28], "little") >> 40) & 7  # noqa: E731  after signature and size: present, kind
    media = webp.to_media(ramp)
    assert webp.from_media(media) == ramp and first_transform(media) == 1
    for text in (b"the same words again. " * 400, bytes((7 * (i // 64) + i * i % 3) % 256 for i in range(64 * 120))):
        payload = text + bytes(-len(text) % 64)
        media = webp.to_media(payload)
        assert webp.from_media(media) == payload and first_transform(media) == 1 | 3 << 1
