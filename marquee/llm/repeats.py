"""Exact removal of long repeats with a logarithmic family of suffix arrays.

Every 400-byte string contains a place chosen by its content alone: the 64
bytes in it whose hash is smallest. Only suffixes at such anchors are indexed,
one for some 170 bytes of text, and two equal strings always have the same
anchor at the same distance, so no match is missed.

An anchor is first known by hashes: of its 64 bytes (the key) and of its whole
neighbourhood, the bytes of all strings that chose it. Keys seen once end here;
equal neighbourhoods are counted as one. Where a key has several different
neighbourhoods their bytes come together by key and enter an index family:
each batch becomes a suffix array (anchors sorted by the text that follows),
is merge-scanned against every existing level for strings that match over
400 bytes, and levels of equal size merge, so sizes grow geometrically.
Strings are judged on the input, and a byte goes if any repeated string covers it.

Defined cases: null and empty texts have no bytes; texts shorter than the
string never match. Repeated rows and equal texts are whole repeats of each
other, and wholly removed when long enough. An empty table gives an empty
result; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm import wordhash
from marquee.llm.common import ship, table, written

LENGTH = 400
GRAM = 64
#: Windows of one long text and bytes of short ones handled at a time, anchors in a
#: new batch, and kept bytes of one result batch: bounds on a task's memory.
SEGMENT = 1 << 18
BATCH = 8192
RESULT = 4 << 20

_U = np.uint64
_PLACE_BITS = _U(24)  # a group of rows has fewer bytes than 2 ** 24


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """``(row, first byte, end)``: each text's strings of ``length``, some at a time."""
    for row in np.flatnonzero(np.diff(offsets) >= length):
        n = int(offsets[row + 1] - offsets[row])
        for low in range(0, n - length + 1, SEGMENT):
            yield int(row), low, min(n, low + SEGMENT + length - 1)


def _groups(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    held, size = [], 0
    for row, low, high in _segments(offsets, length):
        if held and size + high - low > SEGMENT:
            yield held
            held, size = [], 0
        held.append((row, low, high))
        size += high - low
    if held:
        yield held


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, from running minima of blocks."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=_U)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(square, axis=1).ravel()
    n = len(values) - width + 1
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(row, key, around, first, last, anchor)`` arrays: the strings starting at first..last chose this anchor."""
    for group in _groups(offsets, length):
        rows = np.array([g[0] for g in group])
        lows = np.array([g[1] for g in group])
        sizes = np.array([g[2] - g[1] for g in group])
        at = np.concatenate([[0], np.cumsum(sizes)])
        part = np.concatenate([body[offsets[r] + a : offsets[r] + b] for r, a, b in group])
        up, down = wordhash._powers(len(part))
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(wordhash._VALUES[part] * up[: len(part)], out=sums[1:])
        grams = wordhash.mix((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        ranked = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=_U)
        least = _window_min(ranked, length - gram + 1)
        inside = np.zeros(len(part) + 1, dtype=np.int8)
        inside[at[:-1]] += 1
        inside[at[1:] - length + 1] -= 1
        start = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
        place = (least[start] & ((_U(1) << _PLACE_BITS) - _U(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
        first, last, own = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1], place[new]
        end = last + length
        around = wordhash.mix((sums[end] - sums[first]) * down[first] + _U(0x9E3779B97F4A7C15) * (own - first).astype(_U))
        around = wordhash.mix(around + (end - first).astype(_U))
        piece = np.searchsorted(at, first, side="right") - 1
        shift = lows[piece] - at[piece]
        yield rows[piece], grams[own], around, first + shift, last + shift, own + shift


class Level:
    """A sparse suffix array: anchors sorted by the text from the anchor on."""

    def __init__(self, right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, keys: np.ndarray, ids: np.ndarray):
        order = np.argsort(np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel(), kind="stable")
        self.right, self.left = right[order], left[order]
        self.near, self.far, self.keys, self.ids = near[order], far[order], keys[order], ids[order]

    def __len__(self) -> int:
        return len(self.ids)

    def merged(self, other: Level) -> Level:
        both = zip(self._parts(), other._parts(), strict=True)
        return Level(*(np.concatenate(x) for x in both))

    def sharing(self, keys: np.ndarray) -> Level:
        """The anchors with one of these keys, still in order."""
        own = np.isin(self.keys, keys)
        return Level(*(x[own] for x in self._parts()))

    def _parts(self) -> tuple[np.ndarray, ...]:
        return self.right, self.left, self.near, self.far, self.keys, self.ids


class IndexFamily:
    """Levels of geometrically growing size; each new batch is matched against all of them."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []
        #: Per anchor id, the least and greatest distance from a repeated string's start to the anchor.
        self.least: list[np.ndarray] = []
        self.most: list[np.ndarray] = []
        self.count = 0

    def add(self, right, left, near, far, keys) -> None:
        ids = np.arange(self.count, self.count + len(keys))
        self.count += len(keys)
        self.least.append(np.full(len(keys), self.length))
        self.most.append(np.full(len(keys), -1))
        self._least, self._most = np.concatenate(self.least), np.concatenate(self.most)
        batch = Level(right, left, near, far, keys, ids)
        self._scan(batch)
        for level in self.levels:
            known = level.sharing(np.unique(batch.keys))
            if len(known):
                self._scan(batch.sharing(np.unique(known.keys)).merged(known))
        self.least, self.most = [self._least], [self._most]
        while self.levels and len(self.levels[-1]) <= len(batch):
            batch = self.levels.pop().merged(batch)
        self.levels.append(batch)

    def _scan(self, level: Level) -> None:
        """Mark strings that two anchors of a merged order have in common.

        For strings starting d bytes before the anchor: neighbours whose common
        prefix reaches the string's end form a run, and within a run the d bytes
        before the anchor must be equal, too.
        """
        if len(level) < 2:
            return
        differs = level.right[1:] != level.right[:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), self.length)
        before = np.zeros(len(level), dtype=_U)
        up, _ = wordhash._powers(self.length)
        for d in range(level.left.shape[1] + 1):
            if d:
                before += wordhash._VALUES[level.left[:, d - 1]] * up[d]
            own = np.flatnonzero((level.near <= d) & (d <= level.far))
            if len(own) < 2:
                continue
            run = np.concatenate([[0], np.cumsum(common < self.length - d)])[own]
            code = wordhash.mix(before[own] + run.astype(_U) * _U(0xD6E8FEB86659FD93))
            order = np.argsort(code, kind="stable")
            same = code[order][1:] == code[order][:-1]
            hit = level.ids[own[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]]
            self._least[hit] = np.minimum(self._least[hit], d)
            self._most[hit] = np.maximum(self._most[hit], d)


def _matrix(body: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Per row, ``width`` bytes from ``at`` on (backwards for step -1), zero beyond ``size``."""
    k = np.arange(width)
    out = body[np.clip(at[:, None] + step * k[None, :], 0, max(0, len(body) - 1))]
    out[k[None, :] >= size[:, None]] = 0
    return out


def _match(length: int, gram: int):
    """Index family over one partition's neighbourhoods; gives each the span of its repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = IndexFamily(length)
        keys, around, anchor = [], [], []
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = whole.slice(low, BATCH)
                near_text = batch.column("bytes").cast(pa.large_binary())
                _, offsets, data = near_text.buffers()
                at = np.frombuffer(offsets, dtype=np.int64)[near_text.offset : near_text.offset + len(near_text) + 1]
                body = np.frombuffer(data, dtype=np.uint8)
                far = batch.column("anchor").to_numpy().astype(np.int64)
                near = length - (np.diff(at) - far)
                own = at[:-1] + far
                right = _matrix(body, own, at[1:] - own, length, 1)
                left = _matrix(body, own - 1, far, length - gram, -1)
                keys.append(batch.column("key").to_numpy())
                around.append(batch.column("around").to_numpy())
                anchor.append(far)
                family.add(right, left, near, far, keys[-1])
        if family.count:
            least, most, far = family._least, family._most, np.concatenate(anchor)
            hit = most >= 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys)[hit]),
                    pa.array(np.concatenate(around)[hit]),
                    pa.array((far - most)[hit]),
                    pa.array((far - least + length)[hit]),
                ],
                names=["key", "around", "low", "high"],
            )

    return run


_ANCHORS = "key long, around long, t1 long, t2 long, first long, last long, anchor long"


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for row, key, around, first, last, anchor in anchors(*wordhash.flat(batch.column("text")), length, gram):
                columns = [key.view(np.int64), around.view(np.int64), t1[row], t2[row], first, last, anchor]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "around", "t1", "t2", "first", "last", "anchor"])

    return run


def _cut(length: int):
    """The bytes of the neighbourhoods asked for, from each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                body = text.as_py().encode("utf-8")
                for w in wanted.as_py():
                    part = body[w["first"] : w["last"] + length]
                    rows.append((w["key"], w["around"], w["anchor"] - w["first"], part))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["key", "around", "anchor", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes that name the text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), body.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(t1, t2, spans)`` for texts with repeated bytes: byte ranges that may touch and overlap."""
    ship(docs.sparkSession)
    texts = _texts(docs)
    found = texts.filter(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(_find_anchors(length, gram), _ANCHORS)
    found = written(found, "anchors")
    kinds = found.groupBy("key", "around").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("kinds", F.count("*").over(Window.partitionBy("key"))).filter("n > 1 or kinds > 1")
    flagged = written(found.join(kinds, ["key", "around"]), "flagged")
    place = F.struct("t1", "t2", "first", "last", "anchor")
    ones = flagged.filter("kinds > 1").groupBy("key", "around").agg(F.min(place).alias("one"))
    asked = F.struct("key", "around", *(F.col(f"one.{c}").alias(c) for c in ("first", "last", "anchor")))
    wanted = ones.groupBy(F.col("one.t1").alias("t1"), F.col("one.t2").alias("t2")).agg(F.collect_list(asked).alias("wanted"))
    one_row = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("d"))
    # Not an equality for the planner: both joins with the texts then share one exchange by text.
    same = F.coalesce(F.col("doc_id") == F.col("d"), F.col("doc_id").isNull() & F.col("d").isNull())
    near = texts.join(wanted.join(one_row, ["t1", "t2"]), ["t1", "t2"]).filter(same).select("text", "wanted")
    near = near.mapInArrow(_cut(length), "key long, around long, anchor long, bytes binary")
    matched = near.repartition("key").mapInArrow(_match(length, gram), "key long, around long, low long, high long")
    hits = matched.groupBy("key", "around").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # Of a neighbourhood that occurs twice, every string repeats; else those that the family matched.
    whole = flagged.filter("n > 1").select("t1", "t2", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    parts = flagged.filter("n = 1").join(hits, ["key", "around"]).select(
        "t1", "t2", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high")).alias("stop")
    )
    spans = whole.union(parts)
    return spans.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


_CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cleaned(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)


def _clean(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, copies = (batch.column(c).to_pylist() for c in ("doc_id", "spans", "copies"))
            rows, held = [], 0
            for k, text in enumerate(batch.column("text")):
                body = text.as_py().encode("utf-8")
                if copies[k] and len(body) >= length:
                    gone = [(0, len(body))]
                else:
                    gone = merged([(s["start"], s["stop"]) for s in spans[k] or ()])
                edges = [0, *(x for span in gone for x in span), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((ids[k], len(body), len(body) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
                held += len(kept)
                if held > RESULT:
                    yield _cleaned(rows)
                    rows, held = [], 0
            yield _cleaned(rows)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: byte counts, removed runs, the bytes kept and their SHA-256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, length, gram)
    texts = _texts(docs)
    copies = texts.groupBy("t1", "t2").count().filter("count > 1").select("t1", "t2", F.lit(True).alias("copies"))
    known = spans.join(copies, ["t1", "t2"], "full")
    both = texts.join(known, ["t1", "t2"], "left").select("doc_id", "text", "spans", "copies")
    return both.mapInArrow(_clean(length), _CLEANED)


def cut_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``remove_repeats`` with the kept bytes as ``kept_text``, too, and ``changed``: whether any byte went.

    A cut may fall inside a character; the half that stays reads as U+FFFD in
    ``kept_text``, while the digest is of the bytes.
    """
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    cut = remove_repeats(docs, length, gram)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text.alias("kept_text"), (F.col("n_removed") > 0).alias("changed"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents"))
