"""Benchmark decontamination by CGK embeddings and bit sampling.

A benchmark item of n words is looked for in every span of words of a
document, at most ``n // EDITS_PER`` word edits away. A random walk over the n
words from a place on (at each step it writes the word it stands on and moves on
if a random bit of that word and step says so) turns edit distance into Hamming
distance; windows and items that agree on all of ``SAMPLED`` random places of
the walk become candidates, over ``WALKS`` walks with ``TABLES`` samples each.
The exact edit distance to the nearest span around a candidate decides, whatever
the span's length. Equal windows always meet; of spans at the full distance, the
tests measure a recall above 0.95. Before walking, windows with too many words
that no item of their size has go: each is an edit of the span that starts there.
Items of fewer than ``EDITS_PER`` words may not be edited at all: they are found
by a hash of the whole window.

The benchmark's distinct texts go to the tasks in blocks of bounded size, so
documents are scanned once per block and never shuffled; items of equal text get
their findings by a join on the text's number. Of a walk, only the sampled places
are kept, so long items do not cost memory per window.

Defined cases: null or empty texts and items have no words and match nothing; an
item of one word is found wherever the word is. Where a document ends, windows
are shorter. Repeated rows are judged alike; an empty table gives an empty result.
``drop_leaky`` returns the input's columns whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import wordhash
from marquee.llm.common import WS, ship, table

EDITS_PER = 10
WALKS = 8
TABLES = 4
SAMPLED = 3
#: Windows walked at a time: bounds a task's memory.
WINDOWS = 50_000
#: Benchmark words in one block: bounds what the driver and each task hold.
BLOCK_WORDS = 200_000

_U = np.uint64


def edit_distance(a: list, b: list, most: int) -> int:
    """Word edits between two lists, or ``most + 1`` if they are more."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if low == 1:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > most:
            return most + 1
        row = new
    return min(row[-1], most + 1)


def span_edits(masks: dict[int, int], n: int, line: list[int]) -> list[int]:
    """Per place of ``line``, the least word edits between an item and any span that ends there (bit-parallel columns).

    ``masks`` has a bit for each place of a word in the item's n words.
    """
    full, top, out = (1 << n) - 1, 1 << (n - 1), []
    up, down, edits = full, 0, n
    for x in line:
        same = masks.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(diagonal | up)), up & diagonal
        edits += bool(more & top) - bool(less & top)
        more, less = (more << 1) & full, (less << 1) & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
        out.append(edits)
    return out


def span_words(own: list, line: list, edits: int) -> int:
    """Length of the start of ``line`` that is ``edits`` away from ``own``, the nearest to its length."""
    row = list(range(len(line) + 1))
    for i, x in enumerate(own, 1):
        new = [i]
        for j, y in enumerate(line, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min((j for j, e in enumerate(row) if e == edits), key=lambda j: (abs(j - len(own)), j))


def _joined(line: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbouring symbols."""
    out = np.zeros(len(line) - n + 1, dtype=_U)
    for m, k in zip(wordhash.seeds(n, 29), range(n), strict=True):
        out += wordhash.mix((line[k : k + len(out)].astype(_U) + _U(1)) * m)
    return out


class LeakFinder:
    """Finds the items of one benchmark block in word sequences."""

    def __init__(self, items: list[tuple[int, str]], walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED):
        texts = pa.array([t for _, t in items], type=pa.large_string())
        body, offsets = wordhash.flat(texts)
        starts, ends, first = wordhash.words(body, offsets)
        hashes = wordhash.word_hashes(body, starts, ends)
        self.vocabulary = np.unique(hashes)
        self.outside, self.pad = len(self.vocabulary), len(self.vocabulary) + 1
        self.walks, self.tables, self.sampled = walks, tables, sampled
        self.of_size: dict[int, list[tuple[int, list[int]]]] = {}
        #: Items that allow no edit: per size, the items by the hash of their words.
        self.exact: dict[int, dict[int, list[tuple[int, list[int]]]]] = {}
        for k, (item, _) in enumerate(items):
            own = self.symbols(hashes[first[k] : first[k + 1]])
            if len(own) >= EDITS_PER:
                self.of_size.setdefault(len(own), []).append((item, own.tolist()))
            elif len(own):
                self.exact.setdefault(len(own), {}).setdefault(int(_joined(own, len(own))[0]), []).append((item, own.tolist()))
        #: Per size, whether a symbol is a word of any item of this size.
        self.own_words = {n: np.zeros(self.pad + 1, dtype=bool) for n in self.of_size}
        for n, same in self.of_size.items():
            self.own_words[n][[x for _, own in same for x in own]] = True
        sizes = sorted(self.of_size)
        self.longest = max(sizes, default=0)
        self.item_keys: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.items = [own for n in sizes for own in self.of_size[n]]
        #: Per item, the places of each word counted from the item's end, as bits.
        self.masks: list[dict[int, int]] = []
        for _, own in self.items:
            masks: dict[int, int] = {}
            for k, x in enumerate(reversed(own)):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)
        line = np.array([x for _, own in self.items for x in own], dtype=np.int64)
        size = np.array([len(own) for _, own in self.items], dtype=np.int64)
        for walk in range(walks if self.items else 0):
            keys = self.keys(line, np.cumsum(size) - size, size, size, walk)
            self.item_keys.append([(k[o], o) for k in keys for o in [np.argsort(k, kind="stable")]])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, self.outside) if len(self.vocabulary) else np.zeros(0, np.int64)

    def keys(self, line: np.ndarray, at: np.ndarray, length: np.ndarray, n: np.ndarray, walk: int) -> list[np.ndarray]:
        """For each table of a walk, the key of each window ``line[at : at + length]`` for items of n words.

        The places a table samples are fractions of the walk of 2 * n steps.
        """
        names = np.arange(self.pad + 1, dtype=_U) + _U(1)
        drawn = np.random.default_rng((walk, 17)).random((self.tables, self.sampled)).ravel()
        kept = np.empty((len(drawn), len(at)), dtype=np.int32)
        # Windows for items of one size lie together and are sampled at the same steps.
        edges = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1, [len(n)]])
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            for k, part in enumerate(drawn):
                wanted.setdefault(int(part * 2 * n[low]) if high > low else 0, []).append((k, low, high))
        place, end, last = at.copy(), at + length, len(line) - 1
        for step in range(max(wanted) + 1):
            if step % 64 == 0:  # one random word per symbol has the bits of 64 steps
                bits = wordhash.mix(names * wordhash.seeds(1, 1000 * walk + step)[0])
            symbol = line[np.minimum(place, last)]
            symbol[place >= end] = self.pad
            for k, low, high in wanted.get(step, ()):
                kept[k, low:high] = symbol[low:high]
            place += ((bits[symbol] >> _U(step % 64)) & _U(1)).view(np.int64)
        out = []
        for table_at in range(0, len(drawn), self.sampled):
            key = wordhash.mix(n.astype(_U))
            for own in kept[table_at : table_at + self.sampled]:
                key = wordhash.mix(key * _U(31) + names[own])
            out.append(key)
        return out

    def _find_exact(self, line: np.ndarray, row_of: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        for n, by_key in self.exact.items():
            if len(line) < n:
                continue
            keys = _joined(line, n)
            known = np.fromiter(by_key, dtype=_U, count=len(by_key))
            seen = set()
            for at in np.flatnonzero(np.isin(keys, known) & (room[: len(keys)] >= n)):
                row = int(row_of[at])
                for item, own in by_key[int(keys[at])]:
                    if (row, item) not in seen and line[at : at + n].tolist() == own:
                        seen.add((row, item))
                        yield row, item, int(at), n, 0

    def find(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(row, item, start, words, edits)``: for each row and item the nearest span, the first of equals."""
        line = self.symbols(hashes)
        if not len(line):
            return []
        counts = np.diff(first)
        row_of = np.repeat(np.arange(len(counts)), counts)
        room = first[1:][row_of] - np.arange(len(line))
        whole = [(row, item, at - int(first[row]), n, 0) for row, item, at, n, _ in self._find_exact(line, row_of, room)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        short = np.flatnonzero(room < self.longest)
        windows: list[tuple[np.ndarray, int]] = []
        for n in sorted(self.of_size):  # like sizes together: short windows take few steps
            most = n // EDITS_PER
            known = np.concatenate([[0], np.cumsum(self.own_words[n][line], dtype=np.int32)])
            if len(line) >= n:
                few = known[n:] - known[:-n] >= n - most
                few &= room[: len(line) - n + 1] >= n
                windows.append((np.flatnonzero(few), n))
            last = short[(room[short] < n) & (room[short] >= max(1, n - most))]
            windows.append((last[known[last + room[last]] - known[last] >= n - most], n))
        all_at = np.concatenate([x for x, _ in windows]) if windows else np.empty(0, np.int64)
        all_n = np.repeat([n for _, n in windows], [len(x) for x, _ in windows]).astype(np.int64)
        for low in range(0, len(all_at), WINDOWS):
            at, n = all_at[low : low + WINDOWS], all_n[low : low + WINDOWS]
            length = np.minimum(room[at], n)
            pairs: set[tuple[int, int]] = set()
            for walk in range(self.walks):
                for keys, (own, order) in zip(self.keys(line, at, length, n, walk), self.item_keys[walk], strict=True):
                    left, right = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
                    for w in np.flatnonzero(right > left):
                        pairs.update((int(w), int(order[k])) for k in range(left[w], right[w]))
            spans: dict[tuple[int, int], list[list[int]]] = {}
            for start, k in sorted((int(at[w]), k) for w, k in pairs):
                size, row = len(self.items[k][1]), int(row_of[start])
                most = size // EDITS_PER
                low_at, high_at = max(int(first[row]), start - most), min(int(first[row + 1]), start + size + 2 * most)
                own = spans.setdefault((row, k), [])
                if own and low_at <= own[-1][1]:  # one pass over what overlaps
                    own[-1][1] = max(own[-1][1], high_at)
                else:
                    own.append([low_at, high_at])
            for (row, k), own in spans.items():
                size = len(self.items[k][1])
                most = size // EDITS_PER
                for low_at, high_at in own:
                    near = span_edits(self.masks[k], size, line[low_at:high_at][::-1].tolist())  # from the end: per start
                    edits = min(near)
                    start = high_at - 1 - max(j for j, e in enumerate(near) if e == edits)
                    if edits <= most and (edits, start) < best.get((row, k), (most + 1,)):
                        best[row, k] = edits, start
        out = whole
        for (row, k), (edits, start) in sorted(best.items()):
            item, own = self.items[k]
            end = min(int(first[row + 1]), start + len(own) + edits)
            out.append((row, item, start - int(first[row]), span_words(own, line[start:end].tolist(), edits), edits))
        return out


def _scan(finder: LeakFinder, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """Row offset and findings of some rows at a time."""
    body, offsets = wordhash.flat(texts)
    for low, high in wordhash.row_groups(offsets):
        part, at = body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = wordhash.words(part, at)
        yield low, finder.find(wordhash.word_hashes(part, starts, ends), first)


def _texts(bench: DataFrame) -> DataFrame:
    """``(number, text)`` of the benchmark's distinct texts; the number is a hash of the text."""
    return bench.filter("text is not null").select(F.xxhash64("text").alias("number"), "text").distinct()


def _blocks(texts: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct texts in blocks of about ``BLOCK_WORDS`` words."""
    total = texts.agg(F.sum(F.size(F.split("text", f"{WS}+")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for k in range(blocks):
        own = texts.filter(F.pmod("number", F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in own.collect()]


def find_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` and item found in it: where, and how many edits away.

    Columns doc_id, item_id, start_word, n_words, edits.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, number long, start_word long, n_words long, edits long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(_texts(bench)):

        shared = docs.sparkSession.sparkContext.broadcast(LeakFinder(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[low + row], *x) for low, some in _scan(finder, batch.column("text")) for row, *x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], type=pa.int64()) for k in range(5)],
                    names=["doc_id", "number", "start_word", "n_words", "edits"],
                )

        out = out.union(rows.mapInArrow(run, schema))
    items = bench.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("number"))
    return out.join(items, "number").select("doc_id", "item_id", "start_word", "n_words", "edits")


def drop_leaky(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, in which no benchmark item is found."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)
    out = docs
    for block in _blocks(_texts(bench)):

        shared = docs.sparkSession.sparkContext.broadcast(LeakFinder(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for low, found in _scan(finder, batch.column(place)):
                    clean[[low + x[0] for x in found]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
