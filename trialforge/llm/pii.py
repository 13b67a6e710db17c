"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Seeds are the entities of the fixed patterns, and one half (by a hash of the string) of the random-looking
strings: 20 letters, digits, "-" or "_" at least, with four steps or more between letters and digits. Lexical patterns of an entity are
the one, two or three whole words before it, those after it, its neighbours on both sides together,
and for 16 characters or more its own form (letters in use, first four letters, length). Words are
lower-cased, without punctuation at their edges; a run of "=" is a word of its own.

Spark scores the graph of patterns and instances in rounds: a pattern is as good as the believed
share of all its occurrences, with any word or seed there, less a discount for few distinct believed
instances; an instance is believed as the noisy-or of its patterns, seeds always. So an identifier
that one round believes is evidence for its other patterns in the next. Patterns that end above
`sure` then give spans of kind "id" to what no fixed pattern covers: random-looking strings of either half,
and words of six characters or more with a digit, or after "=". Nothing is such a span by its looks alone.

Shares are of occurrences, not of distinct neighbours: distinct words run out as the input grows
and distinct seeds do not, so a common word would become sure by size alone. Occurrences of the
graph's patterns are counted in a second reading, summed by each task before they are shuffled. A
bit table of bounded size tells which patterns to count; what passes it by chance goes by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.llm.common import _WS, Ranges, buffers, constants, discard, keyed_rows, map_rows, meet, mix, slices, tidy, written

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits and, if they are there, the three further parts.
IP = re.compile(r"([0-9]+)(?:\.([0-9]+)\.([0-9]+)\.([0-9]+))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D=]+")
#: Runs that may be random-looking or have a form, steps between letters and digits, and the letters that forms tell apart.
RUN = re.compile(r"[A-Za-z0-9_-]{16,}")
STEP = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
LETTERS = (("hex", re.compile(r"[0-9a-f]+")), ("upper", re.compile(r"[A-Z0-9]+")), ("lower", re.compile(r"[a-z0-9]+")))
LONG, STEPS = 20, 4
STRIP = "\"'.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: the local part is the run before an @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if m[2] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def random_looking(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places of random-looking strings outside the given spans."""
    found = [m.span() for m in RUN.finditer(text) if m.end() - m.start() >= LONG and sum(1 for _ in STEP.finditer(m[0])) >= STEPS]
    return [(a, b) for a, b in found if not any(a < d and c < b for _, c, d in spans)] if found else []


def seeding(word: str) -> bool:
    """Whether a random-looking string is in the half that is believed from the start."""
    return hashlib.blake2b(word.encode(errors="replace"), digest_size=1).digest()[0] < 128


def form(word: str) -> int:
    """A number for the form of a run: letters in use, first four letters (not of hex), length."""
    kind = next((name for name, letters in LETTERS if letters.fullmatch(word)), "mixed")
    first = word[:4] if kind != "hex" and word[:4].isalpha() else ""
    return int.from_bytes(hashlib.blake2b(f"{kind}:{first}:{len(word)}".encode(), digest_size=8).digest(), "little", signed=True)


#: Most words in a pattern, most bits in a table of patterns.
WIDTH, MOST_BITS = 3, 1 << 27
#: Occurrences, and patterns with their counts, that a task holds.
HELD = 1 << 18
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(STRIP.encode())] = True
_STEP = constants(WIDTH, 31)
#: By side (before, after) and number of words.
_SIDE = constants(2 * WIDTH, 37).reshape(2, WIDTH)
_BOTH = constants(3, 41)


def _lower(text: str) -> bytes:
    """Lower-cased letters where that keeps their length, so that places stay."""
    raw, low = text.encode(errors="replace"), text.lower()
    out = low.encode(errors="replace")
    if len(low) != len(text) or len(out) != len(raw):
        out = "".join(c.lower() if len(c.lower().encode(errors="replace")) == len(c.encode(errors="replace")) else c for c in text).encode(errors="replace")
    return out


def _places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte places of spans sorted by their start."""
    if text.isascii():
        return spans
    out, at, size = [], 0, 0
    for a, b in spans:
        size += len(text[at:a].encode(errors="replace"))
        at = a
        out.append((size, size + len(text[a:b].encode(errors="replace"))))
    return out


class Neighbours:
    """Words without punctuation at their edges, their hashes and the patterns around them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.ranges_of = data, Ranges(data)
        self.start = self.end = np.zeros(0, np.int64)
        if n:
            kind = np.where(_WS[data], 0, np.where(data == 0x3D, 1, 2))
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            change = np.ones(n + 1, bool)
            change[1:n] = kind[1:] != kind[:-1]
            change |= edge
            start, end = np.flatnonzero(change[:n] & (kind > 0)), np.flatnonzero(change[1:] & (kind > 0)) + 1
            at, hard = np.arange(n), ~_EDGE[data]
            start = np.minimum.accumulate(np.where(hard, at, n)[::-1])[::-1][start]
            last = np.maximum.accumulate(np.where(hard, at, -1))[end - 1] + 1
            some = start < end
            self.start, self.end = start[some], last[some]
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self.ranges(self.start, self.end)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.ranges_of.of(start, end)[0]

    def context(self, a: int, b: int) -> list[int]:
        """Patterns of the place [a, b) of the only text; a word that runs into it counts as far as it is outside."""
        parts: tuple[list, list] = ([], [])
        j, k = int(np.searchsorted(self.start, a)) - 1, int(np.searchsorted(self.end, b, side="right"))
        if j >= 0 and self.end[j] > a:
            s, e = int(self.start[j]), a
            while e > s and _EDGE[self.data[e - 1]]:
                e -= 1
            parts[0].extend([(s, e)] if e > s else [])
            j -= 1
        if k < len(self.start) and self.start[k] < b:
            s, e = b, int(self.end[k])
            while s < e and _EDGE[self.data[s]]:
                s += 1
            parts[1].extend([(s, e)] if e > s else [])
            k += 1
        parts[0].extend((int(self.start[i]), int(self.end[i])) for i in range(j, max(-1, j - WIDTH), -1))
        parts[1].extend((int(self.start[i]), int(self.end[i])) for i in range(k, min(len(self.start), k + WIDTH)))
        out: list[int] = []
        hashes = []
        for side in (0, 1):
            words = np.array(parts[side][:WIDTH], np.int64).reshape(-1, 2)
            n = len(words)
            hashes.append(self.ranges(words[:, 0], words[:, 1]))
            acc = np.cumsum(hashes[side] * _STEP[:n], dtype=np.uint64)
            out += mix(acc + _SIDE[side, :n]).view(np.int64).tolist()
        if len(hashes[0]) and len(hashes[1]):
            out += mix(hashes[0][:1] * _BOTH[0] + hashes[1][:1] * _BOTH[1] + _BOTH[2]).view(np.int64).tolist()
        return out

    def around(self, chosen: np.ndarray) -> Iterator[np.ndarray]:
        """Patterns at the chosen words."""
        counts = np.diff(self.first)
        low, high = np.repeat(self.first[:-1], counts), np.repeat(self.first[1:], counts)
        for side, step in ((0, -1), (1, 1)):
            j, acc = chosen, np.zeros(len(chosen), np.uint64)
            for m in range(1, WIDTH + 1):
                ok = (j - m >= low[j]) if side == 0 else (j + m < high[j])
                j = j[ok]
                acc = acc[ok] + self.hash[j + step * m] * _STEP[m - 1]
                yield mix(acc + _SIDE[side, m - 1])
        j = chosen[(chosen - 1 >= low[chosen]) & (chosen + 1 < high[chosen])]
        yield mix(self.hash[j - 1] * _BOTH[0] + self.hash[j + 1] * _BOTH[1] + _BOTH[2])


def bit_table(patterns: DataFrame) -> np.ndarray:
    """Two bits of each pattern, in a table of 4 to 8 MB for a million of them and 16 MB at most."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (32 * patterns.count()).bit_length()))
    places = patterns.select(F.explode(F.expr(f"array(pattern & {size - 1}L, shiftrightunsigned(pattern, 32) & {size - 1}L)")).alias("at"))
    found = places.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    last = np.uint64(len(table) * 64 - 1)
    a, b = h & last, (h >> np.uint64(32)) & last
    bit = lambda x: (table[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1)
    return (bit(a) & bit(b)).astype(bool)


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each of the (distinct) patterns stands at a word outside base entities and random-looking strings: (pattern, n)."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(patterns))

    @tidy
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            both, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            return both, total

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["pattern", "n"])

        for batch in batches:
            column = batch.column(0)
            _, ends = buffers(column)
            for lo, hi in slices(ends):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                lowered = [_lower(t) for t in texts]
                offsets = np.cumsum([0, *map(len, lowered)])
                w = Neighbours(np.frombuffer(b"".join(lowered), np.uint8), offsets)
                free = np.ones(len(w.start), bool)
                forms = []
                for t, at in zip(texts, offsets.tolist()):
                    places, random = counted_places(t)
                    for a, b in _places(t, sorted(places)):
                        free[np.searchsorted(w.end, at + a, side="right") : np.searchsorted(w.start, at + b)] = False
                    forms += [form(m[0]) for m in RUN.finditer(t) if m.span() not in random]
                for pattern in (*w.around(np.flatnonzero(free)), np.array(forms, np.int64).view(np.uint64)):
                    held.append(pattern[_in_table(table.value, pattern)])
                    size += len(held[-1])
                if size > HELD:
                    keys, counts = summed()
                    held, size = [], 0
                    if len(keys) > HELD:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = summed()
        yield out()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(one, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return meet(found, patterns.select("pattern"), "pattern", "left_semi")


def totals(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each pattern of the graph with all its occurrences, and its distinct instances in the graph as support."""
    known = written(edges.groupBy("pattern").agg(F.count("*").alias("support"), F.sum("n_known").alias("n_known")), "pii-patterns")
    total = (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("total")
    return written(meet(known, occurrences(docs, known), "pattern", "left").select("pattern", "support", total), "pii-totals")


_NODE = pa.struct([("seed", pa.bool_()), ("random", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_NODE_DDL = "struct<seed: boolean, random: boolean, start: bigint, end: bigint, instance: bigint, patterns: array<bigint>>"


def counted_places(text: str) -> tuple[list[tuple[int, int]], set[tuple[int, int]]]:
    """Places that the graph counts by itself: of base entities and random-looking strings, and of the latter alone."""
    spans = base_spans(text)
    random = random_looking(text, spans)
    return [(a, b) for _, a, b in spans] + random, set(random)


def nodes(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds, and words outside them that may be identifiers, with their patterns."""
    random = random_looking(text, spans)
    found = [(True, False, a, b) for _, a, b in spans] + [(seeding(text[a:b]), True, a, b) for a, b in random]
    if "=" in text or DIGIT.search(text):
        covered = sorted((a, b) for _, _, a, b in found)
        k = 0
        for m in WORD.finditer(text):
            word = m[0]
            if len(word) < 6 or not (DIGIT.search(word) or text[max(0, m.start() - 9) : m.start()].rstrip(" \t\n\x0b\x0c\r").endswith("=")):
                continue
            a = m.start() + len(word) - len(word.lstrip(STRIP))
            b = m.end() - (len(word) - len(word.rstrip(STRIP)))
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            if b - a >= 6 and not (k < len(covered) and covered[k][0] < b):
                found.append((False, False, a, b))
    if not found:
        return []
    found.sort(key=lambda f: f[2])
    low = _lower(text)
    w = Neighbours(np.frombuffer(low, np.uint8), np.array([0, len(low)]))
    places = _places(text, [(a, b) for _, _, a, b in found])
    instances = w.ranges(*np.array(places).T).view(np.int64).tolist()
    runs = {m.span() for m in RUN.finditer(text)}
    return [{"seed": s, "random": r, "start": a, "end": b, "instance": i, "patterns": w.context(*p) + ([form(text[a:b])] if (a, b) in runs else [])} for (s, r, a, b), p, i in zip(found, places, instances)]


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and graph nodes of each document."""

    @tidy
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                kinds = [k for k, _, _ in spans]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined, nodes(text, spans)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(_NODE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "nodes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).mapInArrow(one, "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, nodes array<" + _NODE_DDL + ">")


def score_patterns(edges: DataFrame, degree: DataFrame, rounds: int, prior: float, least: float = 0.01) -> DataFrame:
    """Confidence of each pattern from (instance, pattern, seed, n) edges, all distinct, and the patterns' totals.

    Each round has two aggregations with partial sums, so that a pattern or an instance with
    very many edges is summed before it is shuffled. Patterns below `least` (common words, which
    have most edges) say nothing about instances.
    """
    believed = edges.withColumn("belief", F.col("seed").cast("double"))
    confidence = F.col("weight") / F.col("total") * F.col("sum") / (F.col("sum") + prior)
    patterns = None
    for k in range(rounds):
        sums = believed.groupBy("pattern").agg(F.sum("belief").alias("sum"), F.sum(F.col("belief") * F.col("n")).alias("weight"))
        patterns = meet(sums, degree, "pattern").select("pattern", "support", F.when(F.col("sum") > 0, confidence).otherwise(0.0).alias("confidence"))
        if k + 1 < rounds:
            telling = patterns.where(F.col("confidence") >= least)
            doubt = meet(edges.where("not seed"), telling, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence") * 0.999)))).alias("noisy_or"))
            last, believed = believed, written(meet(edges, doubt, "instance", "left").select("instance", "seed", "pattern", "n", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("noisy_or", F.lit(0.0))).alias("belief")), f"beliefs-{k}")
            if k:
                discard(last)
    return patterns


def find_pii(docs: DataFrame, rounds: int = 5, prior: float = 2.0, sure: float = 0.7, support: int = 5) -> DataFrame:
    """Counts, digest and spans of personal data in each row.

    n_* and base_sha256 tell of the fixed patterns; spans also has the spans of kind "id".
    A pattern's verdict rests on shares of its own occurrences, however many rows there are; with
    the given prior and `sure`, five distinct instances are the least evidence in any case.
    A null or empty text has none. Every row gives a row, also for null or repeated ids. Other
    columns are ignored.
    """
    scanned = written(scan(docs), "pii-scan")
    rows = written(scanned.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    discard(scanned)
    flat = rows.select("row", F.explode("nodes").alias("node")).select("row", "node.*")
    links = flat.select("row", "seed", "random", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    edges = written(links.groupBy("instance", "pattern").agg(F.max("seed").alias("seed"), F.count("*").alias("n"), F.sum((F.col("seed") | F.col("random")).cast("long")).alias("n_known")), "pii-edges")
    good = score_patterns(edges, totals(docs, edges), rounds, prior).where((F.col("confidence") >= sure) & (F.col("support") >= support)).select("pattern")
    found = meet(links.where("random or not seed"), good, "pattern", "left_semi").select("row", "start", "end").distinct()
    spans = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ids"))
    ids = F.transform("ids", lambda s: F.concat_ws(":", F.lit("id"), s["start"].cast("string"), s["end"].cast("string")))
    joined = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(ids, ","))
    return meet(rows.drop("nodes"), spans, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"), "text_hash")


def redact(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in square brackets; of overlapping spans, the first in text order."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with their own columns and the kind in brackets for each span in text; n_chars follows the text."""
    names = docs.columns
    at = names.index("text")
    found = find_pii(docs).where("spans <> ''").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("row_id"), F.col("text_hash").alias("row_hash"), F.col("spans").alias("found")).dropDuplicates(["row_id", "row_hash"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            if batch.columns[-1].null_count < batch.num_rows:
                spans = batch.columns[-1].to_pylist()
                texts = [redact(t, s) if s else t for t, s in zip(columns[at].to_pylist(), spans)]
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(t) if s and t else n for t, s, n in zip(texts, spans, columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    joined = meet(keyed_rows(docs), found, ["row_id", "row_hash"], "left")
    return map_rows(joined.select("row.*", F.col("found")), run, names)
