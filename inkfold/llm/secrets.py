"""Secret scans: known forms, and random-looking tokens by a battery of randomness tests.

Known forms are an assignment to a secret's name, an access key id and a long hex run. Any
other token of SHORTEST or more characters is tested in two steps, under the alphabet of the
encoding that it seems to have.

* The battery, under the hypothesis "random": chi-squared for uniform symbols, Wald-Wolfowitz
  runs about the alphabet's middle, lag-one serial correlation, joined by Bonferroni. A token
  that fails it (repetitions, sequences, alternations) is ordinary.
* The null hypothesis that discoveries are controlled under is "ordinary": a chain over letters,
  digits, capitals and marks whose counts are of all texts of the corpus. How much likelier the
  token is as a random string than as an ordinary one bounds its p-value (p <= ordinary / random,
  by Markov's inequality), so the power grows with the length, and words, identifiers and paths,
  which the chain explains, stay at 1. A token that fails the battery gets p = 1.

Benjamini-Hochberg runs over the p-values of all tokens of the corpus, apart for each class of
lengths since short tokens have little power; tokens for which "ordinary" is rejected are
reported, so RATE bounds the expected share of ordinary tokens among them. The procedure needs
only pair counts and a histogram of p-values by length class, both of fixed size.

Defined cases: a null text is the empty text and has no spans. Offsets count code points,
ends are exclusive. Columns other than the id and the text are ignored. Without any token the
result has base spans only.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import columns, map_whole, prepare, written

RATE = 0.05
SHORTEST = 20
#: Length classes begin here.
CLASSES = [20, 28, 40, 64, 128, 512]
#: p-values are counted by -log10 in steps of 1 / STEPS, up to DEEPEST.
STEPS, DEEPEST = 20, 30

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]


ALPHABETS = [("decimal", "0123456789"), *ENCODINGS]
#: Least p of the battery for a token to count as random.
BATTERY = 0.005


def encoding(token: str) -> tuple[str, str] | None:
    """The smallest alphabet that holds the token."""
    used = set(token.rstrip("="))
    return next(((name, alphabet) for name, alphabet in ALPHABETS if used and used <= set(alphabet)), None)


def _chi_tail(x: float, d: int) -> float:
    """P(chi-squared with d degrees >= x), by the Wilson-Hilferty approximation."""
    z = ((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(symbols: list[int], k: int) -> float:
    """p of at least this much unevenness."""
    n, counts = len(symbols), [0] * k
    for s in symbols:
        counts[s] += 1
    return _chi_tail(sum(c * c for c in counts) * k / n - n, k - 1)


def runs(symbols: list[int], k: int) -> float:
    above = [2 * s >= k for s in symbols]
    n, a = len(above), sum(above)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    seen = 1 + sum(x != y for x, y in zip(above, above[1:], strict=False))
    return _two_sided((seen - mean) / math.sqrt(spread)) if spread > 0 else 1.0


def serial(symbols: list[int]) -> float:
    n = len(symbols)
    mean = sum(symbols) / n
    d = [s - mean for s in symbols]
    square = sum(x * x for x in d)
    if not square:
        return 2.0 ** (1 - n)
    r = sum(x * y for x, y in zip(d, d[1:], strict=False)) / square
    return _two_sided((r + 1 / n) * math.sqrt(n))


def p_random(token: str, alphabet: str) -> float:
    """The battery's p-value under "random over this alphabet"."""
    place = {c: i for i, c in enumerate(alphabet)}
    symbols = [place[c] for c in token.rstrip("=")]
    return min(1.0, 3 * min(chi_squared(symbols, len(alphabet)), runs(symbols, len(alphabet)), serial(symbols)))


#: Symbols of the chain: small letters, capitals, digits, marks; all else breaks it.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_N = len(SYMBOLS) + 1
_TABLE = bytes(SYMBOLS.find(chr(b)) if chr(b) in SYMBOLS else _N - 1 for b in range(256))
_KIND = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * 4)


def pair_counts(texts: list) -> np.ndarray:
    """How often each symbol follows each other one, as a flat array of _N * _N counts."""
    at = np.frombuffer("\n".join(t for t in texts if t).encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    out = np.zeros(_N * _N, np.int64)
    for lo in range(0, len(at) - 1, 1 << 20):
        part = at[lo : lo + (1 << 20) + 1].astype(np.uint16)
        out += np.bincount(part[:-1] * np.uint16(_N) + part[1:], minlength=_N * _N)
    return out


class Ordinary:
    """The chain of ordinary tokens: kind of symbol by the kind before, then letter by the letter before.

    Both are mixed with even shares, so that what a small corpus hasn't shown isn't impossible:
    a fifth for kinds (identifiers change kinds more often than prose does), a tenth for letters.
    """

    def __init__(self, counts):
        pairs = np.asarray(counts, float).reshape(_N, _N)[:-1, :-1]
        ends = np.zeros((len(SYMBOLS), 4))
        ends[np.arange(len(SYMBOLS)), _KIND] = 1
        kinds = ends.T @ pairs @ ends + 1
        self.kind = np.log(0.8 * kinds / kinds.sum(axis=1, keepdims=True) + 0.05)
        letters = pairs[:52, :52].reshape(2, 26, 2, 26).sum(axis=(0, 2)) + 1 / 26
        first = letters.sum(axis=0)
        even = lambda x: np.log(0.9 * x / x.sum(axis=-1, keepdims=True) + 0.1 / 26)
        self.letter, self.first = even(letters), even(first)
        self.alone = np.log(np.array([0, 0, 0.1, 0.25]), where=[False, False, True, True], out=np.zeros(4))

    def log_p(self, body: str) -> float:
        """Half as it stands; half as words in capitals, which read like small ones."""
        own = self._log_p(body)
        return math.log(0.5) + (np.logaddexp(own, self._log_p(body.lower())) if body.upper() == body != body.lower() else own)

    def _log_p(self, body: str) -> float:
        at = [SYMBOLS.index(c) for c in body]
        kinds, total, before = _KIND[at], -math.log(4), None
        for i, (x, k) in enumerate(zip(at, kinds, strict=True)):
            if i:
                total += self.kind[kinds[i - 1], k]
            if k > 1:
                total += self.alone[k]
            else:
                total += self.first[x % 26] if before is None else self.letter[before, x % 26]
            before = x % 26 if k < 2 else None
        return float(total)


def p_ordinary(token: str, alphabet: str, chain: Ordinary) -> float:
    """A bound of the p-value of a token this random if it were an ordinary one; 1 if the battery finds it not random."""
    if p_random(token, alphabet) < BATTERY:
        return 1.0
    body = token.rstrip("=")
    more = math.log(len(ALPHABETS)) + chain.log_p(body) + len(body) * math.log(len(alphabet))
    return math.exp(more) if more < 0 else 1.0


def length_class(n: int) -> int:
    return sum(n >= x for x in CLASSES)


def _bin(p: float) -> int:
    return min(DEEPEST * STEPS, int(-math.log10(p) * STEPS)) if p > 0 else DEEPEST * STEPS


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans as (start, kind number, end), in order; tokens to test as (start, end, token).

    A token that meets a base span is not tested; both are in order, so one sweep tells.
    """
    base = []
    low = text.lower()
    if any(name in low for name in NAMES):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    at, found = 0, []
    for word in text.split():
        if len(word) < SHORTEST:
            continue
        at = text.index(word, at)
        base += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(word) if len(m[0]) >= 20]
        base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(word) if len(m[0]) >= 24]
        found += [(at + m.start(), at + m.end(), m[0]) for m in TOKEN.finditer(word)]
        at += len(word)
    base.sort()
    covered = []
    for s, _, e in base:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    tokens, i = [], 0
    for start, end, token in found:
        while i < len(covered) and covered[i][1] <= start:
            i += 1
        if (i == len(covered) or covered[i][0] >= end) and encoding(token):
            tokens.append((start, end, token))
    return base, tokens


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SPANS = "array<struct<start: int, kind: int, end: int>>"
_TOKENS = "array<struct<start: int, end: int, token: string>>"
_TESTED = "array<struct<start: int, end: int, class: int, bin: int>>"


def _scan_batches(with_base: bool):
    """A row for each text, and at a task's end one of the task's pair counts."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    tokens = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))

    def batch_of(ids, found, pairs):
        base = [None if b is None or not with_base else [{"start": s, "kind": k, "end": e} for s, k, e in b] for b, _ in found]
        sha = [None if b is None or not with_base else hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]
        tests = [[{"start": s, "end": e, "token": t} for s, e, t in x] for _, x in found]
        columns = [ids, pa.array(base, spans), pa.array(tests, tokens), pa.array(sha, pa.string()), pa.array([pairs] * len(found), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "tokens", "base_sha256", "pairs"])

    def run(batches):
        pairs, kind = np.zeros(_N * _N, np.int64), None
        for batch in batches:
            texts, kind = batch.column(1).to_pylist(), batch.column(0).type
            pairs += pair_counts(texts)
            yield batch_of(batch.column(0), [scan(t or "") for t in texts], None)
        if kind is not None:
            yield batch_of(pa.nulls(1, kind), [(None, [])], pairs.tolist())

    return run


def _scanned(docs: DataFrame, id_col: str, text_col: str, with_base: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(*(c.alias(n) for c, n in zip(columns([id_col, text_col]), ["doc_id", "text"], strict=True)))
    return source.mapInArrow(_scan_batches(with_base), f"doc_id {kind}, base {_SPANS}, tokens {_TOKENS}, base_sha256 string, pairs array<long>")


def _chain(found: DataFrame) -> Ordinary:
    """From the tasks' counts: one row for each pair of symbols."""
    counts = found.where("pairs is not null").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_N * _N)
    for r in counts:
        out[r["at"]] = r["n"]
    return Ordinary(out)


def _tested(found: DataFrame, chain: Ordinary) -> DataFrame:
    """(doc_id, base, base_sha256, candidates): tokens with their length class and bin of p."""
    tested = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())]))

    def run(batches):
        for batch in batches:
            own = [[_test(x["start"], x["end"], x["token"], chain) for x in row] for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([[dict(zip(("start", "end", "class", "bin"), x, strict=True)) for x in row] for row in own], tested)], ["doc_id", "base", "base_sha256", "candidates"]
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    rows = found.where("pairs is null").select("doc_id", "base", "base_sha256", "tokens")
    return rows.mapInArrow(run, f"doc_id {kind}, base {_SPANS}, base_sha256 string, candidates {_TESTED}")


def _test(start: int, end: int, token: str, chain: Ordinary) -> tuple[int, int, int, int]:
    return start, end, length_class(end - start), _bin(p_ordinary(token, encoding(token)[1], chain))


def cuts(histogram: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg by length class: from which bin on "ordinary" is rejected.

    histogram: (class, bin, count). A bin stands for its largest p, so rejections are never
    more than the exact procedure's.
    """
    out = {}
    for c in {c for c, _, _ in histogram}:
        own = sorted(((b, n) for k, b, n in histogram if k == c), reverse=True)
        total, seen, cut = sum(n for _, n in own), 0, DEEPEST * STEPS + 1
        for b, n in own:
            seen += n
            if 10 ** (-b / STEPS) <= rate * seen / total:
                cut = b
        out[c] = cut
    return out


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, base, base_sha256, spans): arrays of (start, kind, end), kinds numbered as in KINDS."""
    prepare(docs.sparkSession)
    found = written(_scanned(docs, id_col, text_col, True), "secrets")
    tested = written(_tested(found, _chain(found)), "tokens")
    cut = _cuts(tested, rate)
    random = F.transform(
        F.filter("candidates", lambda x: _passes(x["class"], x["bin"], cut)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))
    )
    return tested.select("doc_id", "base", "base_sha256", F.array_sort(F.concat("base", random)).alias("spans"))


def _passes(c, b, cut: dict[int, int]):
    out = F.lit(False)
    for k, first in sorted(cut.items()):
        out = F.when(c == k, b >= first).otherwise(out)
    return out


def _cuts(tested: DataFrame, rate: float) -> dict[int, int]:
    counted = tested.select(F.explode("candidates").alias("x")).groupBy("x.class", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    return cuts([tuple(r) for r in counted.collect()], rate)  # one row for each class and bin at most


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' hash and all spans as text."""
    text = F.array_join(
        F.transform("spans", lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )

    def of_kind(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of_kind(k) for k in range(3)]
    return found.select("doc_id", *counts, "base_sha256", text.alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """The documents with every span (base and random) replaced by ``mark``; all rows stay, texts without spans unchanged.

    The first pass keeps only the tokens to test and the pair counts. The second scans each text again
    while it masks: that costs less than a copy of all texts with their spans, to be written and read.
    """
    prepare(docs.sparkSession)
    found = written(_scanned(docs, id_col, text_col, False).where("size(tokens) > 0 or pairs is not null"), "tokens")
    chain = _chain(found)
    cut = _cuts(_tested(found, chain), rate)
    names = docs.columns
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def random(token: str) -> bool:
        _, _, c, b = _test(0, len(token), token, chain)
        return b >= cut.get(c, DEEPEST * STEPS + 1)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, tokens = scan(text)
        spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, t in tokens if random(t)])
        out, at = [], 0
        for s, e in spans:
            if e <= at:
                continue
            if s >= at:
                out += [text[at:s], mark]
            at = e
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            before = columns[text_at].to_pylist()
            after = [clean(t) for t in before]
            columns[text_at] = pa.array(after, pa.string())
            if chars_at is not None:
                old = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([len(b) if a != b else n for a, b, n in zip(before, after, old, strict=True)], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_whole(docs, run, docs.schema)
