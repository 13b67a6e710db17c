"""Token alignment, conversation tries and token counts against brute force, on small awkward rows."""

from __future__ import annotations

import hashlib
import importlib.util
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trialforge.llm import alignment, counts, pieces, tries
from trialforge.llm.common import tokenizer_path
from trialforge.llm.tokens import byte_letters

_spec = importlib.util.spec_from_file_location("operator_tests", Path(__file__).with_name("test_llm.py"))
cases = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(cases)

ODD = ["a▁b and ▁▁ c", " starts with a space", "  two", "ends ", "a  b   c    d", "<s> x</s> <unk> <0x0A>", "\x00\x01 control\x07", "if (x) {\r\n\treturn;\r\n}\r\n", "﻿mark", "no break　wide", "é é", "x" * 3000, " ", "   ", "\n\n\n", "😀😀 😀", "<|endoftext|>", "a<|endoftext|> b"]
ROWS = cases.ROWS + [(9000 + k, t, "en", "s", len(t), "x", 7, "y", 1, 2) for k, t in enumerate(ODD)]
MODEL, JSON = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# 11


def aligned(rows, model):
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_letters())}

    def meaning(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends[:-1]], ends))

    found, count = [], Counter()
    for doc_id, text, *_ in rows:
        raw = b" " + (text or "").encode()
        a, b = plain.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        mine, theirs = [bytes(back[c] for c in plain.id_to_token(i)) for i in a], [meaning(i) for i in b]
        if not text or b"".join(mine) != raw or b"".join(theirs) != raw:
            found.append((doc_id, None))
            continue
        sa, sb = spans(mine), spans(theirs)
        pairs = [(a[i], b[j]) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y] if len(a) < 2000 else None
        if pairs is None:
            pairs, j = [], 0
            for i, (x, y) in enumerate(sa):
                while sb[j][1] <= x:
                    j += 1
                k = j
                while k < len(sb) and sb[k][0] < y:
                    pairs.append((a[i], b[k]))
                    k += 1
        groups, at = [], 0
        for end in sorted({y for _, y in sa} & {y for _, y in sb}):
            groups.append(",".join(str(i) for i, (_, y) in zip(a, sa) if at < y <= end) + "|" + ",".join(str(i) for i, (_, y) in zip(b, sb) if at < y <= end) if len(a) < 2000 else "")
            at = end
        count.update(set(pairs))
        found.append((doc_id, (len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = Counter()
    for doc_id, v in found:
        out[(doc_id, 0, 0, 0, 0, 0, 0, "") if v is None else (doc_id, v[0], v[1], v[2], len(v[3]), sum(count[p] == top[p[0]] for p in v[3]), sum(count[p] for p in v[3]), v[4])] += 1
    return out


def test_alignment(docs, library):
    rows = [r for r in ROWS if len(r[1] or "") < 20_000]
    got = alignment.align(docs.where("length(coalesce(text, '')) < 20000")).collect()
    assert Counter(tuple(r) for r in got) == aligned(rows, library)


def test_alignment_in_gangs(docs, monkeypatch):
    """Many levels of sums and small stripes give the same."""
    small = docs.where("length(coalesce(text, '')) < 3000").repartition(7)
    want = Counter(tuple(r) for r in alignment.align(small).collect())
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "CELLS", 1 << 20)
    assert Counter(tuple(r) for r in alignment.align(small).collect()) == want


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], cases.SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.align(blank).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")}


def test_piece_ids(library):
    texts = [t for _, t, *_ in ROWS]
    tok = pieces.PieceTokenizer(MODEL, limit=50)
    ids, offsets = tok.encode_column(pieces.spaced(pa.array(texts)), None)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library.encode(t or "") for t in texts]


# 12


def rebuilt(rows, share=5, most=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, share))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def trie(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in rebuilt(rows).items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return Counter((min(v), len(n), min(members[n[:-1]]) if n else None, len(v), children[n], leaves[n], saved[n], digest(n)) for n, v in members.items())


def talks(seed):
    rng = random.Random(seed)
    stock = [("user", "hi"), ("user", "hi there"), ("system", ""), (None, None), ("", "é" * 3), ("assistant", "hi"), ("user", None)]
    rows = []
    for c in range(-7, 120):
        if c % 11 == 3:
            continue
        n = rng.choice([0, 1, 2, 3, 9, 14]) if c % 3 else 12
        same = random.Random(c % 4) if c % 2 else rng
        rows += [(c, None if t == 0 and c % 5 == 1 else t // 2 if c % 7 == 2 else t, *same.choice(stock)) for t in range(n)]
    rows += [(None, 0, "user", "lost"), (500, 3, "user", "late"), (500, 3, "user", "late"), (500, None, "x", "first")]
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed, monkeypatch):
    rows = talks(seed)
    monkeypatch.setattr(tries, "SHARD", 40 if seed == 2 else tries.SHARD)
    frame = spark.createDataFrame([r + ("k1", 1) for r in rows], TALK + ", k1 string, depth int").repartition(5)
    assert Counter(tuple(r) for r in tries.prefix_trie(frame).collect()) == trie(rows)


def test_prefix_trie_of_long_and_equal_conversations(spark):
    """One conversation over many partitions, many equal ones, and tables without any."""
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(3000)] + [(c, t, "user", f"say {t}") for c in range(1000, 1400) for t in range(4)]
    frame = spark.createDataFrame(rows, TALK)
    assert Counter(tuple(r) for r in tries.prefix_trie(frame).collect()) == trie_of_chains(rows)
    assert tries.prefix_trie(frame.limit(0)).count() == 0
    assert tries.prefix_trie(frame.limit(0).unionByName(spark.createDataFrame([(None, 1, "a", "b")], TALK))).count() == 0


def trie_of_chains(rows):
    con = duckdb.connect()
    con.register("conversations", pa.table({k: [r[i] for r in rows] for i, k in enumerate(("conv_id", "turn", "role", "text"))}))
    return Counter(con.sql(tries.ORACLE).fetchall())


def test_prefix_trie_sql():
    rows = [r for r in talks(3) if r[0] is not None]
    assert trie_of_chains(rows) == trie(rows)


def test_louds():
    parents = np.array([0, 0, 1, 1, 1, 3, 4])
    bits = tries.louds(parents)
    assert "".join(map(str, bits.astype(int))) == "110" "1110" "0" "10" "10" "0" "0" "0"
    assert tries.parents_of(bits).tolist() == parents.tolist()
    assert tries._roll_up(parents, np.ones(7, np.int64)).tolist() == [7, 6, 1, 2, 2, 1, 1, 1]


# 13


@pytest.mark.parametrize("path", [MODEL, JSON, tokenizer_path("word_bpe_49k.json")])
def test_token_counts(docs, library, path):
    if path == MODEL:
        size = lambda t: len(library.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = counts.token_counts(docs, path, limit=50).collect()
    want = [(r[0], len((r[1] or "").encode()), size(r[1] or ""), size(r[1] or "") > 50) for r in ROWS]
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_token_counts_of_nothing(spark):
    assert counts.token_counts(spark.createDataFrame([], cases.SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r) for r in counts.token_counts(blank).collect()} == {(1, 0, 0, False), (None, 0, 0, False)}


def test_cuts_never_change_pieces(library):
    """Pieces of random texts of white space, marks and letters are those of their pre-tokens."""
    rng, count = random.Random(4), pieces.PieceCounter(MODEL)
    for _ in range(300):
        text = "".join(rng.choice(" \n\t\r  ab;)}{>.'éß▁1日") for _ in range(rng.randint(1, 60)))
        data = np.frombuffer(count.prepared(pa.array([text]))[0].as_py().encode(), np.uint8)
        at = [0, *count.cuts(data).tolist(), len(data)]
        assert sum(count.count([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])) == len(library.encode(text))


def test_remembered_numbers():
    rng, table, want = np.random.default_rng(1), counts.Remembered(4), {}
    for _ in range(30):
        keys = np.unique(rng.integers(1, 1 << 12, 200).astype(np.uint64))
        checks = (keys % 7).astype(np.uint32)
        known, found = table.find(keys, checks)
        assert [want.get(int(k)) for k in keys] == [int(v) if h else None for h, v in zip(known, found)]
        table.add(keys[~known], checks[~known], keys[~known].astype(np.int64) * 3)
        want |= {int(k): int(k) * 3 for k in keys[~known]}
