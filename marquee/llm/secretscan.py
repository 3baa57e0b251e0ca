"""Secret scan: candidates judged by a random forest trained on labelled findings.

Candidates are runs of key-like characters holding a digit, keys of a known
issuer's form with or without one, and values assigned to a credential name or
following it after ``is``. The forest sees the candidate's length and
characters, how its character transitions compare with those of words, how
much of it a dictionary covers, the path (the document's source) and the
neighbouring words; it removes false positives such as numbers, digests and
placeholders.

Labelled findings are rows (value, before, after, path, is_secret). The
default ones are findings of the corpus that plain rules settle, in a sample
of at most ``LABELLED``, and look-alikes drawn by rule, so that classes the
corpus lacks are known too. Scans read whole texts; only training is bounded.

Defined cases: null and empty texts have no candidates. Equal candidates are
judged by their own neighbourhood. Offsets count code points. An empty table
gives an empty result. ``redact`` returns the input's columns whatever they
are named.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import ship, table
from marquee.llm.forest import Forest

#: Most findings of the corpus used for training, and look-alikes drawn per kind.
LABELLED = 4000
DRAWN = 120
NEAR = 48  # characters of neighbourhood on either side
MASK = "[SECRET]"

# Credential names, issuers' prefixes, words that go with harmless look-alikes.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key"
ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
HARMLESS = re.compile(r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|revision|rev|uuid|guid|isbn|phone|tel|order|invoice|card|id)\b\W*$")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|changeme|example\w*|your[_-]?\w+|dummy\w*|test\w*|placeholder\w*|redacted)$")
TESTS = re.compile(r"(?i)test|example|fixture|sample|docs?\b|mock|demo")

_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{10,}={0,2}")
_ASSIGNED = re.compile(rf"(?i)(?<![A-Za-z])(?:{NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"']{{6,}})")
_IS = re.compile(rf"(?i)(?<![A-Za-z])(?:{NAMES})[\"']?\s{{1,3}}is\s{{1,3}}[\"'(]?([^\s\"']{{6,}})")
_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{ISSUED.pattern})[A-Za-z0-9]*")
_NAMED = re.compile(rf"(?i)(?:{NAMES})[\"']?\s{{0,3}}(?:[:=]|is)\s{{0,3}}[\"']?$")
_NAME = re.compile(rf"(?i)(?:{NAMES})")
_WORD = re.compile(r"[^\W\d_]{2,}")


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each candidate, in order, none within another."""
    if not text:
        return []
    spans = {m.start(): m.end() for m in _RUN.finditer(text)}
    for form, group in ((_ASSIGNED, 1), (_KEY, 0)):
        for m in form.finditer(text):
            spans[m.start(group)] = max(m.end(group), spans.get(m.start(group), 0))
    for m in _IS.finditer(text):
        # In prose the sentence's mark is not the value's; an assignment or a key inside stays its own.
        start, value = m.start(1), m[1].rstrip(".,;:?)]")
        inner = _ASSIGNED.search(value) or any(k.start() for k in _KEY.finditer(value))
        if len(value) >= 6 and not inner:
            spans[start] = max(start + len(value), spans.get(start, 0))
    out: list[tuple[int, int]] = []
    for start in sorted(spans):
        if not out or start >= out[-1][1]:
            out.append((start, spans[start]))
    return out


def _runs(value: str) -> int:
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    return sum(a != b for a, b in zip(kind, kind[1:], strict=False))


class SecretModel:
    """Character transitions, dictionary and forest, all from one bounded table of labelled findings."""

    def __init__(self, findings: list[tuple[str, str, str, str, bool]]):
        around = Counter(w.lower() for _, a, b, _, _ in findings for w in _WORD.findall(f"{a} {b}"))
        self.words = {w for w in around if len(w) >= 3}
        pairs: Counter = Counter()
        ones: Counter = Counter()
        for w, n in around.items():
            for x, y in zip(f"^{w}", f"{w}$", strict=True):
                pairs[x, y] += n
                ones[x] += n
        self.pair = {k: math.log((n + 0.1) / (ones[k[0]] + 10.0)) for k, n in pairs.items()}
        self.unseen = {x: math.log(0.1 / (n + 10.0)) for x, n in ones.items()}
        x = np.array([self.features(v, a, b, p) for v, a, b, p, _ in findings], dtype=float)
        y = np.array([s for *_, s in findings], dtype=float)
        self.forest = Forest().fit(x, y) if len(y) else None

    def _covered(self, value: str) -> float:
        """Share of the value's characters inside dictionary words of three letters and more."""
        low, done, at = value.lower(), 0, 0
        while at < len(low):
            size = next((k for k in range(min(14, len(low) - at), 2, -1) if low[at : at + k] in self.words), 0)
            done += size
            at += size or 1
        return done / len(low)

    def features(self, value: str, before: str, after: str, path: str) -> list[float]:
        n = len(value)
        counts = Counter(value)
        low = value.lower()
        moves = [self.pair.get((a, b), self.unseen.get(a, -6.0)) for a, b in zip(low, low[1:], strict=False)]
        named = _NAMED.search(before)
        return [
            min(n, 200),
            sum(c.isdigit() for c in value) / n,
            sum(c.isupper() for c in value) / n,
            sum(c.islower() for c in value) / n,
            sum(not c.isalnum() for c in value) / n,
            len(counts) / n,
            -sum(k / n * math.log2(k / n) for k in counts.values()),
            _runs(value) / n,
            sum(moves) / max(1, len(moves)),
            self._covered(value),
            float(all(c in "0123456789abcdef" for c in low)),
            float(bool(named)),
            float(bool(_NAME.search(before[-24:]))),
            float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)),
            float(bool(HARMLESS.search(before))),
            float(bool(ISSUED.fullmatch(value))),
            float(bool(PLACEHOLDER.match(value))),
            float(bool(TESTS.search(path))),
            len(_WORD.findall(before)) / (1 + len(before)),
        ]

    def judge(self, found: list[tuple[str, str, str, str]]) -> np.ndarray:
        if not found or self.forest is None:
            return np.zeros(len(found))
        return self.forest.score(np.array([self.features(*x) for x in found], dtype=float))


def rule_label(value: str, before: str, after: str, path: str) -> bool | None:
    """What plain rules settle: True a secret, False none, None open."""
    if PLACEHOLDER.match(value) or HARMLESS.search(before) or value.isdigit():
        return False
    if ISSUED.fullmatch(value) or (_NAMED.search(before) and len(value) >= 8 and _runs(value) >= 3):
        return True
    return False if _runs(value) <= 2 and not _NAMED.search(before) else None


def drawn_findings(per_kind: int = DRAWN, seed: int = 5) -> list[tuple[str, str, str, str, bool]]:
    """Labelled look-alikes by rule: issued keys, assigned values, digests, numbers, placeholders, names."""
    draw = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(np.array(list(chars))[draw.integers(0, len(chars), n)])
    hexa, upper, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    letters = alnum[:-10]
    plain = ["required", "incorrect", "important", "encrypted", "expired", "invalid", "missing", "generated", "provided", "something", "stored", "different"]
    syllables = ["an", "ed", "ent", "ing", "or", "re", "the", "tion", "un", "ver"]
    word = lambda k: "".join(syllables[i] for i in draw.integers(0, len(syllables), k))
    out = []
    for k in range(per_kind):
        lead, tail, path = f"{word(2)} {word(3)} ", f" {word(2)} {word(1)}", f"src/{word(2)}"
        size = int(draw.integers(10, 44))
        name, common = ["password", "token", "secret", "passphrase"][k % 4], plain[k % len(plain)]
        out += [
            (f"AKIA{pick(upper, 16)}", lead, tail, path, True),
            (f"ghp_{pick(alnum, 36)}", lead, tail, path, True),
            (f"sk-{pick(alnum, 32)}", f'{lead}api_key: "', f'"{tail}', path, True),
            (pick(hexa, size), f"{lead}password=", tail, path, True),
            (pick(alnum, size), f"{lead}{['token', 'secret', 'passwd', 'api-key'][k % 4]} = \"", f'"{tail}', path, True),
            (pick(hexa, 40), f"{lead}{['commit', 'sha1', 'revision', 'digest'][k % 4]} ", tail, path, False),
            (pick(hexa, 32), f"{lead}{['md5', 'checksum', 'uuid', 'id'][k % 4]}: ", tail, path, False),
            (pick("0123456789", int(draw.integers(10, 20))), lead, tail, path, False),
            (f"{word(3)}{k}", lead, tail, path, False),
            (f"{word(2)}_{word(2)}_{k % 9}", lead, tail, path, False),
            (["changeme", "your_password", "xxxxxxxx", "example123"][k % 4], f"{lead}password=", tail, f"docs/{word(2)}", False),
            (f"{word(2)}/{word(2)}/{2000 + k}", lead, tail, path, False),
            (f"AKIA{pick(upper[:26], 16)}", lead, tail, path, True),
            (f"{['sk-', 'xoxb-', 'ghp_'][k % 3]}{pick(letters, [32, 24, 36][k % 3])}", lead, tail, path, True),
            (pick(alnum, int(draw.integers(8, 14))), f"{lead}{name} is ", tail, path, True),
            (f"{pick(letters[26:], 1)}{word(1)}{pick('0123456789', 2)}{word(1)}{pick('0123456789!$#', 1)}", f"{lead}the {name} is ", tail, path, True),
            (pick(letters, int(draw.integers(8, 20))), f"{lead}{name} is ", tail, path, True),
            (pick(letters[:26], int(draw.integers(10, 20))), f"{lead}{name} is ", tail, path, True),
            (common, f"{lead}the {name} is ", f" and not {plain[k // 5 % len(plain)]} {word(1)}", path, False),
            (word(int(draw.integers(2, 5))), f"{lead}{name} is ", f" {common} {word(1)}", path, False),
            (common, f"{lead}{name}: ", tail, path, False),
        ]
    return out


def _found(text: str | None, path: str | None) -> list[tuple[int, int, str, str, str, str]]:
    """Start, end, value, before, after and path of each candidate of a text."""
    return [(s, e, text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR], path or "") for s, e in candidates(text)]


def findings(docs: DataFrame) -> DataFrame:
    """All candidates of ``docs (doc_id, text, source)`` with their neighbourhood."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = batch.column("doc_id").to_pylist(), batch.column("path").to_pylist()
            rows = [
                (ids[k], *x) for k, text in enumerate(batch.column("text")) for x in _found(text.as_py(), paths[k])
            ]
            names = ["doc_id", "start", "stop", "value", "before", "after", "path"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, stop long, value string, before string, after string, path string")


def labelled(found: DataFrame, most: int = LABELLED) -> list[tuple[str, str, str, str, bool]]:
    """Labelled findings: at most ``most`` of the corpus, the first by hash, that rules settle, and drawn ones."""
    order = F.xxhash64("value", "before", "after", "path")
    sample = found.select("value", "before", "after", "path").orderBy(order, "value", "before", "after", "path").limit(most)
    known = [(*r, rule_label(*r)) for r in sample.collect()]
    return [x for x in known if x[-1] is not None] + drawn_findings()


def scan(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """Every candidate: doc_id, start, stop, score and is_secret.

    Candidates are found once for the labelled sample and once for the scores:
    a table of them in between would leave the secrets in clear on shared storage.
    """
    found = findings(docs)
    model = model or SecretModel(labelled(found))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(value: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(shared.value.judge(list(zip(value, before, after, path, strict=True))))

    scored = found.withColumn("score", judged("value", "before", "after", "path"))
    return scored.select("doc_id", "start", "stop", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, model: SecretModel | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """``docs``, columns unchanged, with every secret in ``text`` replaced by ``MASK``."""
    if model is None:
        model = SecretModel(labelled(findings(docs.select("doc_id", F.col(text).alias("text"), F.col(path).alias("source")))))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        rows = [(k, *x) for k, (t, p) in enumerate(zip(texts, paths, strict=True)) for x in _found(t, p)]
        scores = shared.value.judge([x[3:] for x in rows])
        out = list(texts)
        for (k, start, stop, *_), score in reversed(list(zip(rows, scores, strict=True))):
            if score >= 0.5:
                out[k] = out[k][:start] + MASK + out[k][stop:]
        return pd.Series(out, dtype=object)

    masked = F.when(F.col(text).isNotNull(), clean(F.col(text), F.col(path).cast("string")))
    return docs.withColumn(text, masked)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
