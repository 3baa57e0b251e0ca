"""SentencePiece BPE encoding and decoding by a prefix table.

For each prefix of a unit of text the BPE encoding ends in exactly one token,
so one table over the prefixes holds the whole encoding: an automaton lists
the vocabulary pieces ending at a place, and the right one is that whose pair
with the last token before it survives merging as this pair. The ids are then
read backwards through the table.

A unit is a stretch of text over whose borders no vocabulary piece reaches:
the encoder may cut there and remember units it has seen. Characters outside
the vocabulary become byte tokens. Texts are encoded whole.

Defined cases: null and empty texts have no tokens and decode to the empty
text; the white-space mark U+2581 inside a text decodes to a space, as the
library does. Repeated rows are encoded alike, an empty table gives an empty
result, further columns of the input are carried by ``encode`` unless they are
named like its output, which then replaces them.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import ship, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Units an encoder remembers before it starts afresh: bounds a worker's memory.
REMEMBERED = 300_000


class Automaton:
    """Trie of the pieces with failure links; a state lists what ends there, longest first."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.fail: list[int] = [0]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]

    def add(self, word: str, value: tuple[int, int]) -> None:
        state = 0
        for c in word:
            state = self.next[state].setdefault(c, len(self.next))
            if state == len(self.next):
                self.next.append({})
                self.fail.append(0)
                self.ends.append(())
        self.ends[state] = (value,)

    def link(self) -> None:
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                self.ends[state] += self.ends[self.fail[state]]
                for c, child in self.next[state].items():
                    self.fail[child] = self.step(self.fail[state], c)
                    below.append(child)
            level = below

    def step(self, state: int, c: str) -> int:
        """The state after ``c``, by failure links where there is no edge."""
        while (to := self.next[state].get(c)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return to


class PieceEncoder:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_value = {i: v for v, i in self.byte.items()}
        self.score = {p: model.get_score(i) for i, p in enumerate(self.piece) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        # Runs of the space mark have tied scores, so their pairs are not decided by rank alone.
        self.tied = re.compile(f"{SPACE}{SPACE}")
        self.automaton = Automaton()
        #: Per token: the parts that stand at its left and right border while it is merged,
        #: each with the rank of the merge that takes it up (the token itself: none).
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        for p, i in self.id.items():
            parts, left, right = self.merged(p, borders=True)
            if parts == [p]:  # others never come out of merging
                self.automaton.add(p, (i, len(p)))
                self.left[i], self.right[i] = left, right
        self.automaton.link()
        self.units = self._unit_pattern()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.remembered = remembered

    def _unit_pattern(self) -> re.Pattern:
        """Units: space marks, then a run of signs, or a run of all other characters.

        Two characters belong together if they are neighbours in any piece; the
        signs are those that go with the full stop, and ASCII signs and controls
        that go with nothing. So no merge can reach over a unit's border.
        """
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                c = group[c]
            return c

        for p in self.id:
            for x, y in zip(p, p[1:], strict=False):
                if y == SPACE and x != SPACE:
                    raise ValueError("a piece holds a space mark after another character")
                if x != SPACE:
                    group[root(x)] = root(y)
        signs = {c for c in group if root(c) == root(".") != root("e")}
        signs |= {c for c in map(chr, range(128)) if c not in group and not c.isalnum()}
        own = re.escape("".join(sorted(signs)))
        return re.compile(f"{SPACE}*[{own}]+|{SPACE}*[^{own}{SPACE}]+|{SPACE}+")

    def merged(self, text: str, borders: bool = False):
        """BPE by its definition: the best-scored pair, leftmost of equals, until none is left.

        With ``borders`` also the parts that stood first and last on the way.
        """
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        # Pairs by score, then place; one whose parts have changed since is passed over.
        heap = [(-s, k, x, y) for k, (x, y) in enumerate(zip(text, text[1:], strict=False)) if (s := self.score.get(x + y)) is not None]
        heapq.heapify(heap)
        left, right = [], []
        while heap:
            rank, k, x, y = heapq.heappop(heap)
            j = after[k]
            if parts[k] != x or j < 0 or parts[j] != y:
                continue
            if before[k] < 0:
                left.append((x, rank))
            if after[j] < 0:
                right.append((y, rank))
            parts[k], parts[j] = x + y, None
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (s := self.score.get(parts[p] + parts[q])) is not None:
                    heapq.heappush(heap, (-s, p, parts[p], parts[q]))
        parts = [p for p in parts if p is not None]
        if not borders:
            return parts
        return parts, [*left, (parts[0], math.inf)], [*right, (parts[-1], math.inf)]

    def _pair(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay this pair when their joint text is encoded.

        Pieces are ranked in the order in which they can arise, so a merge over the
        border happens if its rank comes while both its parts stand there: before
        the left one is taken up, and not after the right one is (of equal ranks
        the leftmost goes first).
        """
        key = a * len(self.piece) + b
        if (ok := self.pairs.get(key)) is None:
            ok = self.pairs[key] = not self._crossed(self.right[a], self.left[b])
        return ok

    def _crossed(self, right: list[tuple[str, float]], left: list[tuple[str, float]]) -> bool:
        for x, until_x in right:
            for y, until_y in left:
                if (s := self.score.get(x + y)) is not None and -s < until_x and -s <= until_y:
                    return True
        return False

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[v] for v in char.encode("utf-8")]

    def unit_ids(self, unit: str) -> list[int]:
        if self.tied.search(unit):
            return [i for p in self.merged(unit) for i in ([self.id[p]] if p in self.id else self._bytes(p))]
        last: list[tuple[int, int] | None] = [None] * (len(unit) + 1)
        step, ends, state = self.automaton.step, self.automaton.ends, 0
        for end, c in enumerate(unit, 1):
            state = step(state, c)
            for match in ends[state]:
                before = last[end - match[1]]
                if before is None or self._pair(before[0], match[0]):  # None: the start, or a character of bytes
                    last[end] = match
                    break
        out: list[int] = []
        at = len(unit)
        while at:
            if (found := last[at]) is None:
                out.extend(reversed(self._bytes(unit[at - 1])))
                at -= 1
            else:
                out.append(found[0])
                at -= found[1]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: pieces joined, byte tokens read as UTF-8, marks as spaces."""
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_value:
                raw.append(self.byte_value[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(self.piece[i].replace(SPACE, " "))
        return "".join(parts) + raw.decode("utf-8", "replace")

    def _unit(self, unit: str) -> tuple[int, str, str]:
        if (got := self.known.get(unit)) is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            if len(self.pairs) >= 20 * self.remembered:
                self.pairs.clear()
            ids = self.unit_ids(unit)
            got = (len(ids), ",".join(map(str, ids)), self.decode(ids))
            if len(unit) <= 64:
                self.known[unit] = got
        return got

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text decoded from them."""
        if not text:
            return 0, "", ""
        known, make = self.known.get, self._unit
        found = [known(u) or make(u) for u in self.units.findall(SPACE + text.replace(" ", SPACE))]
        # The space put before the text is taken off again in decoding.
        return sum(x[0] for x in found), ",".join([x[1] for x in found]), "".join([x[2] for x in found])[1:]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    """One encoder per worker and model."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PieceEncoder(model_file)
    return _ENCODERS[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


_RESULT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.StringType()),
    ]
)


def encode(df: DataFrame, text: str = "text", model_file: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` (decimal, joined by commas) and ``decoded``.

    ``model_file`` must exist on every executor, as an installed package does.
    """
    ship(df.sparkSession)
    model_file = model_file or default_model()

    @F.pandas_udf(_RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = encoder(model_file)
        for part in parts:
            rows = [one.encode(t if isinstance(t, str) else None) for t in part]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    out = "__pieces_out"
    return df.withColumn(out, run(F.col(text))).select(
        *(df[c] for c in df.columns if c not in _RESULT.names), *(F.col(out)[c].alias(c) for c in _RESULT.names)
    )


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model_file = default_model()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = encoder(model_file)
        digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for part in parts:
            rows = [one.encode(t if isinstance(t, str) else None) for t in part]
            yield pd.DataFrame(
                [(n, digest(ids), digest(text)) for n, ids, text in rows],
                columns=["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.withColumn("d", digests("text")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
