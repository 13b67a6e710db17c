"""Repeated passages across documents, found by shared anchors and decided exactly.

Rounds over one shuffle of the texts (every round reads the same exchange, which Spark reuses):

1. Each bucket of documents names the hashes of its anchors, each once. Hash buckets find those
   that two buckets hold, or one bucket twice, and tell the buckets. A hash costs a bucket one
   entry however often it holds it, so a passage in a third of all rows is no hot group.
2. Each bucket looks at the windows around its repeated anchors only. It sends what is needed to
   decide them (distinct within the bucket) to hash buckets, which answer by bit maps in the
   order sent; the bucket works out the same order again, so no positions travel back.
3. Each bucket applies the answers to its documents.

Words (op7): anchors are windows at positions of a difference cover; the windows around repeated
anchors are told apart by 124 bits of polynomials modulo a prime (for 10**12 windows, a chance of
about 10**-13 that any two are mistaken for each other). Bytes (op4): anchors are the minimal hashes
of each string; contents of segments that several buckets hold are named by 128-bit BLAKE2b digests
first and sent once, and the deciding buckets order suffixes and make longest-previous-factor
arrays from the previous and next smaller places, or, where any other place counts, from the
neighbours in suffix order.

A bucket sends at most one message row for each of its hashes, so messages grow with the input.

A document's place in its bucket is its rank by (doc_id, text), so rows that share a doc_id keep
apart; equal rows share a bucket and stay in a fixed order. A null doc_id comes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import Words, buffers, constants, mix, n_parts, ranges_union, rolling, slices

LAST = np.iinfo(np.int64).max
BLOBS = "to int, of int, blob binary"


class Group:
    """A bucket's documents in order of (doc_id, text)."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end")
        table = table.take(order)
        self.ids = table.column("doc_id").combine_chunks()
        self.keys = self.ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.offsets = buffers(table.column("text").cast(pa.large_string()))

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Slices of documents: first, end, bytes, offsets."""
        for a, b in slices(self.offsets):
            yield a, b, self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a]


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("of", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))


def _split(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each hash, and 32 further bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32), h.astype(np.uint32)


def name_hashes(of: int, h: np.ndarray, n: int) -> pa.Table:
    """Rows (to, of, blob) with the distinct hashes, those held twice or more first."""
    values, counts = np.unique(h, return_counts=True)
    to, rest = _split(values, n)
    rows = {"to": [], "of": [], "blob": []}
    edges = np.searchsorted(to, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)):
        a, b = edges[k], edges[k + 1]
        twice = counts[a:b] > 1
        rows["to"].append(int(k))
        rows["of"].append(of)
        rows["blob"].append(np.uint32(twice.sum()).tobytes() + rest[a:b][twice].tobytes() + rest[a:b][~twice].tobytes())
    return pa.table(rows, schema=pa.schema([("to", pa.int32()), ("of", pa.int32()), ("blob", pa.binary())]))


def repeated_hashes(table: pa.Table) -> pa.Table:
    """Answer each bucket with those of its hashes that are held elsewhere too, or twice by itself."""
    blobs = [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
    counts = np.array([len(b) - 1 for b in blobs])
    rest = np.concatenate([b[1:] for b in blobs])
    by = np.repeat(np.arange(len(blobs)), counts)
    twice = np.concatenate([np.arange(len(b) - 1) < b[0] for b in blobs])
    order = np.argsort(rest, kind="stable")
    s = rest[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    # repeats of a hash stand together: one that is held twice by any bucket repeats by itself
    repeat = same | twice[order]
    hit = np.zeros(len(s), bool)
    hit[order] = repeat
    to = table.column("to")[0].as_py()
    found = np.split(rest[hit], np.cumsum(np.bincount(by[hit], minlength=len(blobs)))[:-1])
    of = table.column("of").to_pylist()
    rows = [(o, to, f.tobytes()) for o, f in zip(of, found) if len(f)]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.int32(), pa.int32(), pa.binary()))], names=["to", "of", "blob"])


def known(table: pa.Table, h: np.ndarray, n: int) -> np.ndarray:
    """Which hashes are among the answers (rows: of is the hash bucket that answered)."""
    parts = [(np.uint64(o) << np.uint64(32)) | np.frombuffer(b, np.uint32).astype(np.uint64) for o, b in zip(table.column("of").to_pylist(), table.column("blob").to_pylist())]
    values = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
    to, rest = _split(h, n)
    key = (to.astype(np.uint64) << np.uint64(32)) | rest
    at = np.searchsorted(values, key)
    at[at == len(values)] = 0
    return values[at] == key if len(values) else np.zeros(len(h), bool)


def rounds(docs: DataFrame, anchors: Callable, ask: Callable, decide: Callable, apply: Callable, schema: str, deciders: int, each: int) -> DataFrame:
    """The plan of the three rounds, lazy and in one piece, so that exchanges are reused."""
    buckets = n_parts(docs, each)
    texts = bucketed(docs, buckets)
    first = texts.groupBy("of").applyInArrow(lambda t: name_hashes(t.column("of")[0].as_py(), anchors(Group(t)), buckets), BLOBS)
    repeats = first.groupBy("to").applyInArrow(repeated_hashes, BLOBS)

    def questions(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"to": pa.array([], pa.int32()), "of": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        rows = [(to, t.column("of")[0].as_py(), blob) for to, blob in ask(Group(t), answers, buckets, deciders)[0]]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [(), (), ()], (pa.int32(), pa.int32(), pa.binary()))], names=["to", "of", "blob"])

    asked = texts.groupBy("of").cogroup(repeats.groupBy("to")).applyInArrow(questions, BLOBS)
    decided = asked.groupBy("to").applyInArrow(decide, BLOBS)
    answers = repeats.withColumn("kind", F.lit(0)).unionByName(decided.withColumn("kind", F.lit(1)))

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy()
        if not t.num_rows:
            return apply(None, None, None, buckets, deciders)
        verdicts = answers.filter(pa.array(kind == 1))
        return apply(Group(t), answers.filter(pa.array(kind == 0)), dict(zip(verdicts.column("of").to_pylist(), verdicts.column("blob").to_pylist())), buckets, deciders)

    return texts.groupBy("of").cogroup(answers.groupBy("to")).applyInArrow(finish, schema)


# Words: difference cover.

#: A difference cover: any two positions have a common shift below PERIOD that puts both on it.
PERIOD, COVER = 13, (0, 1, 3, 9)


def _word_parts(group: Group, lanes: int = 2) -> Iterator[tuple[int, int, Words, list[np.ndarray], np.ndarray]]:
    for a, b, data, offsets in group.parts():
        w = Words(data, offsets)
        place = np.arange(len(w.start)) - np.repeat(w.first[:-1], np.diff(w.first))
        yield a, b, w, w.wide(lanes=lanes), place


def _cover(place: np.ndarray) -> np.ndarray:
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    return on[place % PERIOD]


def _word_windows(group: Group, answers: pa.Table, buckets: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes, document and start of each window around a repeated anchor, in order."""
    span = window - PERIOD + 1
    found: tuple[list, list, list, list] = ([], [], [], [])
    for a, b, w, h, place in _word_parts(group, 4):
        n = len(place)
        g, ok = w.grams(h[0], span)
        at = np.flatnonzero(ok & _cover(place))
        at = at[known(answers, g[at], buckets)]
        if not len(at):
            continue
        # windows that hold the anchor: those that start up to PERIOD - 1 words before it, in its document
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(at - (PERIOD - 1), at - place[at]), 1)
        np.add.at(mark, at + 1, -1)
        g, ok = w.grams(h[0], window)
        on = np.flatnonzero((np.cumsum(mark)[:n] > 0) & ok)
        doc = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(w.first))
        for x, part in zip(found, (g[on], w.grams(h[1], window, 2000)[0][on], doc[on], place[on].astype(np.int32))):
            x.append(part)
    kinds = (np.uint64, np.uint64, np.int32, np.int32)
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(found, kinds))


def _ask_words(window: int) -> Callable:
    def ask(group: Group, answers: pa.Table, buckets: int, deciders: int):
        h, more, doc, place = _word_windows(group, answers, buckets, window)
        order = np.lexsort((more, h))  # stable: documents and places are in order already
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
        at = order[new]
        of_window = np.empty(len(h), np.int64)
        of_window[order] = np.cumsum(new) - 1
        to, _ = _split(h[at], deciders)
        edges = np.searchsorted(to, np.arange(deciders + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            part = at[edges[k] : edges[k + 1]]
            rows.append((int(k), np.uint32(len(part)).tobytes() + h[part].tobytes() + more[part].tobytes() + group.keys[doc[part]].tobytes() + doc[part].astype("<u4").tobytes() + place[part].astype("<u4").tobytes()))
        return rows, (of_window, doc, place, at, edges)

    return ask


def _named(blobs: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """Both hashes, doc_id, document and place from messages, and how many each message has."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    counts = []
    for b in blobs:
        n = int(np.frombuffer(b, "<u4", 1)[0])
        counts.append(n)
        at = 4
        for column, kind in zip(columns, ("<u8", "<u8", "<i8", "<u4", "<u4")):
            column.append(np.frombuffer(b, kind, n, at))
            at += column[-1].nbytes
    return [np.concatenate(c) for c in columns], counts


def _decide_words(table: pa.Table) -> pa.Table:
    """A bit for each window sent: 1 if another bucket has an earlier one."""
    (h, more, key, doc, place), counts = _named(table.column("blob").to_pylist())
    of = np.array(table.column("of").to_pylist())
    by = np.repeat(np.arange(len(of)), counts)
    order = np.lexsort((place, doc, of[by], key, more, h))
    later = np.zeros(len(h), bool)
    later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    to = table.column("to")[0].as_py()
    rows = [(int(o), to, np.packbits(p).tobytes()) for o, p in zip(of, np.split(later, np.cumsum(counts)[:-1])) if p.any()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.int32(), pa.int32(), pa.binary()))], names=["to", "of", "blob"])


def substring_dedup(docs: DataFrame, window: int = 20, texts: bool = False, each: int = 4 << 20) -> DataFrame:
    """Remove words covered by a window of words that also starts earlier.

    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and on request
    kept_text. Earlier: a smaller doc_id, or the same document and an earlier start; null doc_ids
    come last, and rows that share a doc_id follow each other in a fixed order. Null and empty
    texts have no words. Windows are told apart by 124-bit hashes. Other columns are ignored.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    ask = _ask_words(window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())} | ({"kept_text": pa.array([], pa.string())} if texts else {}))

    def anchors(group: Group) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for _, _, w, h, place in _word_parts(group):
            g, ok = w.grams(h[0], window - PERIOD + 1)
            out.append(g[ok & _cover(place)])
        return np.concatenate(out)

    def apply(group, answers, verdicts, buckets, deciders) -> pa.Table:
        if group is None:
            return empty
        _, (of_window, doc, place, at, edges) = ask(group, answers, buckets, deciders)
        elsewhere = np.zeros(len(at), bool)
        for k, bits in verdicts.items():
            n = edges[k + 1] - edges[k]
            elsewhere[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        # a window's first place in the bucket goes if an earlier one is elsewhere, its other places always
        gone = elsewhere[of_window]
        first = np.zeros(len(gone), bool)
        first[at] = True
        gone |= ~first
        doc, place = doc[gone], place[gone]
        bounds = np.searchsorted(doc, np.arange(len(group.keys) + 1))
        words, removed, digests, kept = [], [], [], []
        for a, b, data, offsets in group.parts():
            w = Words(data, offsets)
            raw = data.tobytes()
            for k in range(a, b):
                n = int(w.first[k - a + 1] - w.first[k - a])
                pieces = raw[offsets[k - a] : offsets[k - a + 1]].split()
                starts, ends = ranges_union(place[bounds[k] : bounds[k + 1]].astype(np.int64), window)
                if len(starts):
                    cuts = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), n]
                    pieces = [p for i in range(0, len(cuts), 2) for p in pieces[cuts[i] : cuts[i + 1]]]
                joined = b" ".join(pieces)
                words.append(n)
                removed.append(n - len(pieces))
                digests.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept.append(joined.decode())
        columns = [group.ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept, pa.string())] if texts else [])
        return pa.table(columns, names=empty.column_names)

    return rounds(docs, anchors, ask, _decide_words, apply, schema, n_parts(docs, each), each)


# Bytes: minimal hashes and suffix order.


def nearest_smaller(values: np.ndarray, lcp: np.ndarray | None = None, places: np.ndarray | None = None, reach: int = 0) -> tuple[np.ndarray, ...]:
    """Index of the previous value that is at most, and of the next that is below each one (-1, n: none).

    Pointers start at the neighbour and jump along earlier answers until they fit. With `lcp` (of each
    one and the one before it), the least of it on the way to each of the two follows; a way on which
    it is 0 ends there. With `places`, a way ends at the first answer that is `reach` or more away, whatever
    its value: for who asks whether the nearest one is nearer. Places below 0 are walls and do not ask.
    """
    n = len(values)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    common = None
    if lcp is not None:
        common = [lcp.copy(), np.append(lcp[1:], 0)[:n]]
        common[0][:1] = 0
    left = np.arange(1, n)
    if places is not None:
        left = left[places[1:] >= 0]
    while len(left):
        at = before[left]
        on = (at >= 0) & (values[np.maximum(at, 0)] > values[left])
        if places is not None:
            on &= places[left] - places[at] < reach
        left = left[on]
        if common is not None:
            left = left[common[0][left] > 0]
            common[0][left] = np.minimum(common[0][left], common[0][before[left]])
        before[left] = before[before[left]]
    left = np.arange(0, n - 1)
    if places is not None:
        left = left[places[:-1] >= 0]
    while len(left):
        at = after[left]
        on = (at < n) & (values[np.minimum(at, n - 1)] >= values[left])
        if places is not None:
            on &= places[np.minimum(at, n - 1)] - places[left] < reach
        left = left[on]
        if common is not None:
            left = left[common[1][left] > 0]
            common[1][left] = np.minimum(common[1][left], common[1][after[left]])
        after[left] = after[after[left]]
    if common is None:
        return before, after
    common[0][before < 0], common[1][after >= n] = 0, 0
    return before, after, *common


def previous_factors(places: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors, in suffix order: the longest common prefix with any suffix at an earlier place.

    The suffixes with the longest common prefix among those at earlier places are the nearest ones
    in suffix order on either side, the previous and the next smaller place. Places are distinct.
    """
    _, _, left, right = nearest_smaller(places, lcp)
    return np.maximum(left, right)


def other_factors(lcp: np.ndarray) -> np.ndarray:
    """The longest common prefix with any other suffix, in suffix order: no suffix shares more than a neighbour does.

    Equal to the greater of the longest factors at earlier and at later places.
    """
    return np.maximum(lcp, np.append(lcp[1:], 0)) if len(lcp) else lcp


class ByteAnchors:
    """The anchor of each string of `length` bytes, by runs of strings that share one.

    Places whose hash of `gram` bytes passes a mask (one in eight) are candidates. A string's
    anchor is the first of the least hashes among the candidates in it, or its own start if it
    has none, so equal strings have anchors at equal places with equal hashes. A candidate is
    the anchor of the strings that start after the previous one that is no greater and end
    before the next smaller one.
    """

    def __init__(self, group: Group, length: int, gram: int):
        w = length - gram + 1
        empty = np.zeros(0, np.int64)
        starts, ends, hashes, base = [empty], [empty], [empty.astype(np.uint64)], 0
        table = constants(256, 23)
        for a, b in slices(group.offsets, 1 << 17):
            data, offsets = group.data[group.offsets[a] : group.offsets[b]], group.offsets[a : b + 1] - group.offsets[a]
            n = len(data)
            if n >= length:
                raw = rolling(table[data], gram)
                at = np.flatnonzero((raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == 0)
                doc = np.searchsorted(offsets, at, side="right") - 1
                inside = at + gram <= offsets[doc + 1]
                at, doc = at[inside], doc[inside]
                h = mix(raw[at])
                # a wall of the least hash between documents ends every run there
                first = np.searchsorted(doc, np.arange(b - a))
                walled, h_walled = np.insert(at, first, -1), np.insert(h, first, 0)
                # a candidate w bytes away is in no string with this one
                before, after = nearest_smaller(h_walled, places=walled, reach=w)
                keep = np.flatnonzero(walled >= 0)
                # a hash of 0 stands behind the wall of its document, and before the next one
                low, high = before[keep], after[keep]
                lo = np.where(low >= 0, walled[np.maximum(low, 0)], -1)
                hi = np.where(high < len(walled), walled[np.minimum(high, len(walled) - 1)], -1)
                begin, stop = offsets[doc], offsets[doc + 1]
                run_start = np.maximum(np.maximum(np.where(lo >= 0, lo + 1, 0), begin), at - w + 1)
                run_end = np.minimum(np.minimum(at, np.where(hi >= 0, hi - w, n)), stop - length) + 1
                on = run_end > run_start
                run_start, run_end, h = run_start[on], run_end[on], h[on]
                # strings without a candidate
                open_ = np.zeros(n + 1, np.int32)
                np.add.at(open_, run_start, 1)
                np.add.at(open_, run_end, -1)
                rest = np.flatnonzero(np.cumsum(open_[: n - length + 1]) == 0)
                owner = np.searchsorted(offsets, rest, side="right") - 1
                rest = rest[rest + length <= offsets[owner + 1]]
                starts += [base + run_start, base + rest]
                ends += [base + run_end, base + rest + 1]
                hashes += [h, mix(raw[rest])]
            base += n
        start, end, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        order = np.argsort(start, kind="stable")
        self.run_start, self.run_end, self.hash = start[order], end[order], h[order]


#: Suffixes of open classes that are sorted at once; a larger class is sorted by itself.
CHUNK = 1 << 17


def split_classes(classes: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by (class, key), and where another pair begins in it; classes stand in order, keys have `bits` bits.

    Whole classes are sorted in chunks: class within the chunk, key and place side by side in 64 bits.
    """
    n = len(classes)
    order, fresh, first = np.empty(n, np.int32), np.ones(n, bool), np.ones(n, bool)
    np.not_equal(classes[1:], classes[:-1], out=first[1:])
    starts = np.append(first.nonzero()[0], n)
    a = 0
    while a < n:
        k = int(starts.searchsorted(a + CHUNK, side="right")) - 1
        b = int(starts[k] if starts[k] > a else starts[k + 1])
        number = first[a:b].cumsum(dtype=np.uint64)
        place = (b - a - 1).bit_length()
        packed = (number - np.uint64(1)) << np.uint64(bits) | key[a:b].astype(np.uint64)
        packed <<= np.uint64(place)
        packed |= np.arange(b - a, dtype=np.uint64)
        packed.sort()
        order[a:b] = (packed & np.uint64((1 << place) - 1)).astype(np.int32) + np.int32(a)
        packed >>= np.uint64(place)
        np.not_equal(packed[1:], packed[:-1], out=fresh[a + 1 : b])
        a = b
    return order, fresh


def _open(fresh: np.ndarray) -> np.ndarray:
    """Places in suffix order of the classes that have several suffixes."""
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return (~alone).nonzero()[0]


def suffix_classes(text: np.ndarray, length: int, at: np.ndarray | None = None, levels: list[tuple[int, np.ndarray]] | None = None, orders: list[np.ndarray] | None = None) -> np.ndarray:
    """Rank of each position in the order of suffixes cut to `length` bytes (equal strings, equal ranks).

    With `at`, only these positions are ranked by the whole length, and returned. `levels` gets the ranks of all
    positions by each shorter length on the way, `orders` the order by the whole length.

    Prefix doubling: suffixes are sorted by as many numbers of two or three bytes as fit in 64 bits beside a
    place. Then only classes of several suffixes are sorted, by the ranks of what follows; a rank is the place
    of its class in suffix order, so suffixes that stand alone keep theirs. Past the end, rank 0.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    seen = np.bincount(text, minlength=256) > 0
    codes = np.append(seen.cumsum(dtype=np.int32)[text], np.zeros(2, np.int32))
    base = int(seen.sum()) + 1
    gram = 3 if base**3 <= 1 << 21 else 2
    value = codes[:n]
    for k in range(1, gram):
        value = value * np.int32(base) + codes[k : k + n]
    seen = np.zeros(base**gram, bool)
    seen[value] = True
    number = seen.cumsum(dtype=np.int32)
    bits, place = int(number[-1]).bit_length(), n.bit_length()
    ways = max(1, min((64 - place) // bits, length // gram))
    value = np.append(number[value], np.zeros(ways * gram, np.int32))
    key = np.zeros(n, np.uint64)
    for k in range(ways):
        key <<= np.uint64(bits)
        key |= value[k * gram : k * gram + n].astype(np.uint64)
    key <<= np.uint64(place)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << place) - 1)).astype(np.int32)
    key >>= np.uint64(place)
    fresh = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    del key, value, codes
    depth, bits = ways * gram, place
    rank = np.zeros(n + length, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1, dtype=np.int32), np.int32(0)))
    # what is left of the length takes two more numbers at most
    while 3 * depth < length:
        if levels is not None:
            levels.append((depth, rank[:n].copy()))
        slots = _open(fresh)
        sub = order[slots]
        by, apart = split_classes(rank[sub], rank[sub + np.int32(depth)], bits)
        sub = sub[by]
        order[slots], fresh[slots] = sub, apart
        rank[sub] = np.maximum.accumulate(np.where(apart, slots + 1, 0))
        depth *= 2
    if levels is not None and depth < length:
        levels.append((depth, rank[:n]))
    if at is not None:
        which = np.zeros(n, np.int32)
        which[at] = np.arange(1, len(at) + 1, dtype=np.int32)
        order = order[which[order] > 0]
        fresh = np.ones(len(at), bool)
        classes = rank[order]
        np.not_equal(classes[1:], classes[:-1], out=fresh[1:])
    reach = depth
    while reach < length:
        reach = min(length, reach + depth)
        slots = _open(fresh)
        sub = order[slots]
        by, apart = split_classes(fresh.cumsum(dtype=np.int32)[slots], rank[sub + np.int32(reach - depth)], bits)
        order[slots], fresh[slots] = sub[by], apart
    if at is not None:
        order = which[order] - np.int32(1)
    if orders is not None:
        orders[:] = [order]
    out = np.empty(len(order), np.int32)
    out[order] = fresh.cumsum(dtype=np.int32)
    return out


def common_prefixes(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, `limit` at most.

    Equal ranks by a length go that far at once, from the longest length down; then single bytes are compared.
    Suffixes at a and b have `limit` bytes at least.
    """
    out = np.zeros(len(a), np.int64)
    longer = limit + 1
    for depth, rank in (*reversed(levels), (1, text)):
        # what a longer length left over holds this one fewer times
        for _ in range((longer - 1) // depth):
            on = np.flatnonzero(out + depth <= limit)
            on = on[rank[a[on] + out[on]] == rank[b[on] + out[on]]]
            if not len(on):
                break
            out[on] += depth
        longer = depth
    return out


class Segments:
    """A bucket's strings with repeated anchors: runs of them, and the distinct contents of runs."""

    def __init__(self, group: Group, answers: pa.Table, buckets: int, deciders: int, length: int, gram: int):
        found = ByteAnchors(group, length, gram)
        on = known(answers, found.hash, buckets)
        self.group, self.start, self.end, h = group, found.run_start[on], found.run_end[on], found.hash[on]
        self.stop = self.end + length - 1
        self.doc = np.searchsorted(group.offsets, self.start, side="right") - 1
        raw = memoryview(np.ascontiguousarray(group.data))
        digests = b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(self.start.tolist(), self.stop.tolist()))
        name, more = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        order = np.lexsort((more, name))  # stable, so a content's first place comes first
        new = np.ones(len(order), bool)
        new[1:] = (name[order[1:]] != name[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
        self.first = order[new]
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.back, minlength=len(self.first))
        self.name, self.more = name[self.first], more[self.first]
        self.by_name = self._dealt(self.name, deciders)
        self.by_anchor = self._dealt(h[self.first], deciders)

    @staticmethod
    def _dealt(h: np.ndarray, deciders: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the contents by decider, and where each decider's begin."""
        to, _ = _split(h, deciders)
        order = np.argsort(to, kind="stable")
        return order, np.searchsorted(to[order], np.arange(deciders + 1))

    def places(self, at: np.ndarray) -> bytes:
        """Where contents stand first: doc_id, document and place."""
        seg = self.first[at]
        doc = self.doc[seg]
        return self.group.keys[doc].astype("<i8").tobytes() + doc.astype("<u4").tobytes() + (self.start[seg] - self.group.offsets[doc]).astype("<u4").tobytes()

    def names(self) -> list[tuple[int, bytes]]:
        order, edges = self.by_name
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            at = order[edges[k] : edges[k + 1]]
            rows.append((int(k), np.uint32(len(at)).tobytes() + self.name[at].tobytes() + self.more[at].tobytes() + self.places(at)))
        return rows

    def heard(self, verdicts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """By content: whether another bucket has it earlier, and whether it is there twice at all."""
        order, edges = self.by_name
        later, shared = np.zeros(len(self.first), bool), self.counts > 1
        for k, bits in verdicts.items():
            at = order[edges[k] : edges[k + 1]]
            both = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * len(at)) > 0
            later[at] = both[: len(at)]
            shared[at] |= both[len(at) :]
        return later, shared

    def contents(self, later: np.ndarray, shared: np.ndarray) -> list[tuple[int, bytes]]:
        """Contents that no other bucket sends."""
        order, edges = self.by_anchor
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            at = order[edges[k] : edges[k + 1]]
            at = at[~later[at]]
            if len(at):
                x, y = self.start[self.first[at]], self.stop[self.first[at]]
                text = np.concatenate([self.group.data[i:j] for i, j in zip(x.tolist(), y.tolist())])
                rows.append((int(k), np.uint32(len(at)).tobytes() + (y - x).astype("<u4").tobytes() + self.places(at) + shared[at].astype("u1").tobytes() + text.tobytes()))
        return rows


def _decide_names(table: pa.Table) -> pa.Table:
    """Two bits for each content named: another bucket has it earlier; another bucket has it."""
    (h, more, key, doc, place), counts = _named(table.column("blob").to_pylist())
    of = np.array(table.column("of").to_pylist())
    order = np.lexsort((place, doc, np.repeat(of, counts), key, more, h))
    same = (h[order[1:]] == h[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    later, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    cuts = np.cumsum(counts)[:-1]
    to = table.column("to")[0].as_py()
    return _blobs([(int(o), to, np.packbits(np.concatenate([x, y])).tobytes()) for o, x, y in zip(of, np.split(later, cuts), np.split(shared, cuts)) if y.any()])


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.int32(), pa.int32(), pa.binary()))], names=["to", "of", "blob"])


def _decide_bytes(length: int, keep_first: bool) -> Callable:
    def decide(table: pa.Table) -> pa.Table:
        """A bit for each string of each segment sent: 1 if it is there twice or more (or earlier)."""
        parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
        counts = []
        for b in table.column("blob").to_pylist():
            n = int(np.frombuffer(b, "<u4", 1)[0])
            counts.append(n)
            at = 4
            for k, kind in enumerate(("<u4", "<i8", "<u4", "<u4", "u1")):
                parts[k].append(np.frombuffer(b, kind, n, at))
                at += parts[k][-1].nbytes
            parts[5].append(np.frombuffer(b, np.uint8, offset=at))
        size, key, doc, place, twice, text = (np.concatenate(x) for x in parts)
        size = size.astype(np.int64)
        strings = size - (length - 1)
        begin, upto = np.cumsum(size) - size, np.cumsum(strings)
        within = np.arange(upto[-1]) - np.repeat(upto - strings, strings)
        at = np.repeat(begin, strings) + within
        levels: list[tuple[int, np.ndarray]] = []
        orders: list[np.ndarray] = []
        mine = suffix_classes(text, length, at, levels, orders)
        of = np.array(table.column("of").to_pylist())
        # suffix order; equal strings by their places in order of the documents, where an earlier place counts
        if keep_first:
            by_place = np.lexsort((np.repeat(place, strings) + within, np.repeat(doc, strings), np.repeat(np.repeat(of, counts), strings), np.repeat(key, strings)))
            places = np.empty(len(mine), np.int64)
            places[by_place] = np.arange(len(mine))
            order = np.lexsort((places, mine))
        else:
            (order,) = orders
        # the common prefixes of neighbours in it, and the longest factor at an earlier (or any other) place
        lcp = np.zeros(len(mine), np.int64)
        # equal ranks by the whole length are that long a prefix; the shorter ranks and the bytes tell the others' lengths
        lcp[1:] = length
        apart = np.flatnonzero(mine[order[1:]] != mine[order[:-1]]) + 1
        lcp[apart] = common_prefixes(text, levels, at[order[apart - 1]], at[order[apart]], length)
        factors = previous_factors(places[order], lcp) if keep_first else other_factors(lcp)
        again = np.zeros(len(mine), bool)
        again[order] = factors >= length
        if not keep_first:
            again |= np.repeat(twice > 0, strings)
        ends = np.cumsum(counts)
        total = np.concatenate([[0], upto])[ends]
        to = table.column("to")[0].as_py()
        rows = [(int(o), to, np.packbits(p).tobytes()) for o, p in zip(of, np.split(again, total[:-1])) if p.any()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.int32(), pa.int32(), pa.binary()))], names=["to", "of", "blob"])

    return decide


def suffix_dedup(docs: DataFrame, length: int = 200, keep_first: bool = True, texts: bool = False, gram: int = 32, each: int = 4 << 20) -> DataFrame:
    """Remove bytes covered by a string of `length` bytes that is elsewhere too.

    keep_first: the first copy stays (smaller doc_id, then place); otherwise every copy goes.
    doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes, and on request
    kept, those bytes. Strings never cross documents. Null and empty texts have no bytes, null
    doc_ids come last, rows that share a doc_id keep apart. Other columns are ignored.
    """
    if not 8 <= gram < length:
        raise ValueError("8 <= gram < length")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())} | ({"kept": pa.array([], pa.binary())} if texts else {}))
    buckets, deciders = n_parts(docs, each), n_parts(docs, max(1, each // 8))

    def open_group(t: pa.Table, answers: pa.Table) -> tuple[Segments, list[dict[int, bytes]]]:
        kind = answers.column("kind").to_numpy()
        heard = [answers.filter(pa.array(kind == k)) for k in (1, 2)]
        segments = Segments(Group(t), answers.filter(pa.array(kind == 0)), buckets, deciders, length, gram)
        return segments, [dict(zip(h.column("of").to_pylist(), h.column("blob").to_pylist())) for h in heard]

    def names(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _blobs([])
        of = t.column("of")[0].as_py()
        return _blobs([(to, of, blob) for to, blob in open_group(t, answers)[0].names()])

    def contents(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _blobs([])
        of = t.column("of")[0].as_py()
        segments, (verdicts, _) = open_group(t, answers)
        return _blobs([(to, of, blob) for to, blob in segments.contents(*segments.heard(verdicts))])

    def apply(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return empty
        segments, (named, decided) = open_group(t, answers)
        group = segments.group
        later, shared = segments.heard(named)
        start, strings = segments.start, segments.end - segments.start
        # bits of the contents sent, by decider
        order, edges = segments.by_anchor
        sent = np.where(later[order], 0, strings[segments.first[order]])
        upto = np.concatenate([[0], np.cumsum(sent)]).astype(np.int64)
        bits = np.zeros(upto[-1], bool)
        for k, packed in decided.items():
            a, b = upto[edges[k]], upto[edges[k + 1]]
            bits[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a)
        place = np.empty(len(order), np.int64)
        place[order] = upto[:-1]
        within = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        # a content that is elsewhere earlier goes as a whole; without keep_first, one that is there twice
        whole = (later if keep_first else later | shared)[segments.back]
        if keep_first:
            copy = np.ones(len(start), bool)
            copy[segments.first] = False
            whole |= copy
        gone = np.repeat(whole, strings)
        ask = np.flatnonzero(~gone)
        gone[ask] = bits[(np.repeat(place[segments.back], strings) + within)[ask]]
        at = (np.repeat(start, strings) + within)[gone]
        mark = np.zeros(len(group.data) + 1, np.int32)
        mark[at] += 1
        mark[at + length] -= 1
        removed = np.cumsum(mark[:-1]) > 0
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = group.offsets[:-1][group.offsets[:-1] < len(removed)]
        opens[inner] = removed[inner]
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[group.offsets])
        n_removed, n_spans = count(removed), count(opens)
        kept, digests = [], []
        for a, b, n in zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist(), n_removed.tolist()):
            piece = (group.data[a:b][~removed[a:b]] if n else group.data[a:b]).tobytes()
            digests.append(hashlib.sha256(piece).hexdigest())
            if texts:
                kept.append(piece)
        columns = [group.ids, pa.array(np.diff(group.offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept, pa.binary())] if texts else [])
        return pa.table(columns, names=empty.column_names)

    def with_kind(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind))

    # one lazy plan, so that exchanges are reused
    documents = bucketed(docs, buckets)
    first = documents.groupBy("of").applyInArrow(lambda t: name_hashes(t.column("of")[0].as_py(), ByteAnchors(Group(t), length, gram).hash, buckets), BLOBS)
    repeats = with_kind(first.groupBy("to").applyInArrow(repeated_hashes, BLOBS), 0)
    named = documents.groupBy("of").cogroup(repeats.groupBy("to")).applyInArrow(names, BLOBS)
    answers = repeats.unionByName(with_kind(named.groupBy("to").applyInArrow(_decide_names, BLOBS), 1))
    asked = documents.groupBy("of").cogroup(answers.groupBy("to")).applyInArrow(contents, BLOBS)
    answers = answers.unionByName(with_kind(asked.groupBy("to").applyInArrow(_decide_bytes(length, keep_first), BLOBS), 2))
    return documents.groupBy("of").cogroup(answers.groupBy("to")).applyInArrow(apply, schema)
