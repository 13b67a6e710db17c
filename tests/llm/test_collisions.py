"""Texts that polynomials modulo 2**64 take for each other: Thue-Morse words and their complements."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from trialforge.llm import neardup, substring
from trialforge.llm.common import Words, buffers, tokenizer_path
from trialforge.llm.tokens import UnitTokenizer


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_differ():
    for n in (1024, 2048, 4096):
        w = Words(*buffers(pa.array([" ".join(thue_morse(n))])))
        for h in w.wide():
            assert h[0] != h[1]


def test_near_duplicates_without_a_common_shingle(spark):
    one, two = thue_morse(2048)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x y"), (4, f"{two} x z")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, "0.85").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_windows_that_differ_in_one_word(spark):
    one, two = thue_morse(2048)
    rest = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_contents_of_two_kilobytes(spark):
    """Complements share no 200 bytes with each other beyond what brute force finds."""
    one, two = thue_morse(2048)
    texts = [f"{one}", f"{two}", "p" * 150 + one[:700], two[100:600] + "q" * 30]
    seen = {}
    for t in texts:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    want = {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = "".join(c for c, g in zip(t, gone) if not g)
        want[i] = (int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring.suffix_dedup(docs, keep_first=False).collect()}
    assert got == want


def test_previous_factors():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        t = "".join(rng.choice(list("ab"), n))
        order = sorted(range(n), key=lambda i: t[i:])
        common = lambda a, b: next((k for k in range(n) if max(a, b) + k >= n or t[a + k] != t[b + k]), 0)
        lcp = np.array([0] + [common(order[i - 1], order[i]) for i in range(1, n)])
        got = substring.previous_factors(np.array(order), lcp)
        assert got.tolist() == [max([common(j, i) for j in range(i)], default=0) for i in order]


def test_units_of_a_tokenizer():
    one, two = thue_morse(128)
    tok = UnitTokenizer(tokenizer_path())
    ids, at = tok.encode_column(pa.array([f"x {one}", f"x {two}", f"x {one}"]), None)
    parts = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert parts[0] == parts[2] != parts[1]
    assert parts[1] == tok.library.encode(f"x {two}", add_special_tokens=False).ids


def test_common_prefixes():
    """Lengths by ranks are those of the bytes, whatever the limit, in texts that repeat themselves."""
    rng = np.random.default_rng(3)
    for limit in (9, 40, 200, 230):
        unit = rng.integers(0, 2, 37).astype(np.uint8)
        text = np.concatenate([np.tile(unit, 12), rng.integers(0, 2, 300).astype(np.uint8), np.tile(unit[:5], 90), np.zeros(400, np.uint8)])
        a, b = (rng.integers(0, len(text) - limit, 500) for _ in range(2))
        a[:50] = b[:50]
        levels = []
        substring.suffix_classes(text, limit, None, levels)
        got = substring.common_prefixes(text, levels, a, b, limit)
        for x, y, n in zip(a.tolist(), b.tolist(), got.tolist()):
            same = text[x : x + limit] == text[y : y + limit]
            assert n == (limit if same.all() else int(np.argmin(same)))
