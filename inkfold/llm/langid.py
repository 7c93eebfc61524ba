"""Language of whole texts, with spans of mixed-language text.

Word and letter-trigram counts of labelled documents give each word a score for each
learned language; the scripts of a word's letters (code-point ranges) narrow its
candidates first. Viterbi over the words, with a penalty for each switch, labels spans;
the language with most letters is the prediction and its share of letters the score.

Most texts have one language. For those an exact test of dominance replaces the dynamic
programme: if no stretch of words favours the others by more than the switches would
cost, staying is optimal, and prefix sums show that at C speed.

Fitting uses a sample of about ``max_rows`` labelled rows, chosen by a hash of the id, so
its cost and the model's size don't grow with the corpus; all rows are predicted. The sample
is drawn for each language: rare ones keep all their rows, the others share the rest evenly.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0 and no
spans, as does any text if no labelled row exists. Ties go to the language that comes
first in the alphabet. A null id counts as the empty text. Only the text is an input of a
prediction.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from inkfold.llm.common import columns, fields, fresh, map_whole, prepare

MAX_ROWS = 6_000
#: Steps of a sample's share.
GRAIN = 1 << 40
TOP_WORDS, TOP_TRIGRAMS, LEAST = 30_000, 20_000, 2
PENALTY = 8.0
FLOOR = -5.0
MEMO = 200_000
UNDETERMINED = "und"
HELD_OUT = 2
#: A clear document's language holds more than this share of its letters: the majority.
LEAST_SHARE = 0.5

WORD = re.compile(r"[^\W\d_]+")

#: First code points of ranges and the script from there on ("" is any other).
SCRIPT_RANGES = [
    (0x0000, ""), (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"),
    (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFF21, "Latin"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, ""),
    (0x20000, "Han"), (0x32000, ""),
]
_STARTS = [x for x, _ in SCRIPT_RANGES]


def script(letter: str) -> str:
    return SCRIPT_RANGES[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Per-word scores; holds bounded tables only."""

    def __init__(self, counts: dict[tuple[str, str], dict[str, int]], penalty: float = PENALTY):
        self.langs = sorted({lang for lang, _ in counts})
        self.penalty = penalty
        self.words = self._log_table("word", counts)
        self.trigrams = self._log_table("tri", counts)
        self.scripts: dict[str, int] = {}  # the languages written in a script, as bits
        for i, lang in enumerate(self.langs):
            total = sum(counts.get((lang, "script"), {}).values())
            for name, n in counts.get((lang, "script"), {}).items():
                if n * 50 >= total:
                    self.scripts[name] = self.scripts.get(name, 0) | 1 << i

    def _log_table(self, kind: str, counts) -> tuple[dict[str, int], np.ndarray]:
        """Row numbers of the known keys, and log shares by row and language; row 0 is for all others."""
        keys = sorted({k for lang in self.langs for k in counts.get((lang, kind), ())})
        table = np.full((len(keys) + 1, len(self.langs)), 0.5)
        for i, lang in enumerate(self.langs):
            own = counts.get((lang, kind), {})
            table[1:, i] += np.fromiter((own.get(k, 0) for k in keys), float, len(keys))
        return {k: i + 1 for i, k in enumerate(keys)}, np.log(table / table.sum(axis=0))

    def allowed(self, word: str) -> int:
        """The languages that the word's scripts leave, as bits; all if they leave none."""
        every = (1 << len(self.langs)) - 1
        if word.isascii():
            return self.scripts.get("Latin", 0) or every
        bits = every
        for c in set(word):
            bits &= self.scripts.get(script(c), every)
        return bits or every

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log shares of the languages, at least FLOOR, a row for each word; languages that a word's scripts rule out have FLOOR."""
        low = [w.lower() for w in words]
        known, table = self.words
        row = np.fromiter((known.get(w, 0) for w in low), np.int64, len(low))
        raw = table[row]
        if len(new := np.flatnonzero(row == 0)):
            known, table = self.trigrams
            parts = [[known.get(w[i : i + 3], 0) for i in range(len(w) - 2)] for w in (f"<{low[j]}>" for j in new)]
            ends = np.cumsum([len(p) for p in parts])
            flat = table[np.fromiter(chain.from_iterable(parts), np.int64, ends[-1])]
            raw[new] = 0.7 * np.add.reduceat(flat, ends - [len(p) for p in parts], axis=0)
        bits = np.fromiter(map(self.allowed, low), np.int64, len(low))
        raw[(bits[:, None] >> np.arange(len(self.langs)) & 1) == 0] = -np.inf
        raw -= raw.max(axis=1, keepdims=True)
        return np.maximum(raw - np.log(np.exp(raw).sum(axis=1, keepdims=True)), FLOOR)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels that maximise the sum of scores less ``penalty`` for each switch; ties stay, then go to the first."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int32)
    best = scores[0].copy()
    own = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty > best
        back[t] = np.where(switch, top, own)
        best = np.where(switch, best[top] - penalty, best) + scores[t]
    out = np.empty(n, np.int32)
    out[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def dominant(scores: np.ndarray, penalty: float) -> int:
    """The language of all words if no path that switches, and no other language, does better; else -1."""
    sums = scores.sum(axis=0)
    a = int(sums.argmax())
    if scores.shape[1] == 1:
        return a
    gain = scores - scores[:, a : a + 1]
    gain[:, a] = -np.inf
    run = np.concatenate(([0.0], np.cumsum(gain.max(axis=1))))
    if run.max() > penalty or run[-1] - run.min() > penalty:
        return -1
    return a if (run - np.minimum.accumulate(run)).max() <= 2 * penalty else -1


class Labeller:
    def __init__(self, model: Model, memo: int = MEMO):
        self.model, self.memo = model, memo
        self._fresh()

    def _fresh(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))

    def _scores(self, words: list[str]) -> np.ndarray:
        if not self.model.langs:
            return np.zeros((len(words), 0))
        row = self.row
        new = [w for w in dict.fromkeys(words) if w not in row]
        if new:
            if len(row) + len(new) > self.memo:
                self._fresh()
                row, new = self.row, list(dict.fromkeys(words))
            while len(row) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            first = len(row)
            self.table[first : first + len(new)] = self.model.word_scores(new)
            row.update(zip(new, range(first, first + len(new)), strict=True))
        return self.table[np.fromiter(map(row.__getitem__, words), np.int64, len(words))]

    def batch(self, texts: list) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; spans are (start, end, language) in code points, by runs of words."""
        words = [WORD.findall(t) if t else [] for t in texts]
        scores = self._scores(list(chain.from_iterable(words)))
        ends = np.cumsum([len(w) for w in words])
        return [self._label(t, w, scores[e - len(w) : e]) for t, w, e in zip(texts, words, ends, strict=True)]

    def __call__(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        return self.batch([text])[0]

    def _label(self, text: str | None, words: list[str], scores: np.ndarray):
        langs = self.model.langs
        if not words or not langs or not any(map(str.isalpha, words)) and not any(c.isalpha() for c in text):
            return UNDETERMINED, 0.0, []
        a = dominant(scores, self.model.penalty)
        if a >= 0:
            return langs[a], 1.0, [(text.find(words[0]), text.rfind(words[-1]) + len(words[-1]), langs[a])]
        path = viterbi(scores, self.model.penalty)
        letters, spans = Counter(), []
        for m, k in zip(WORD.finditer(text), path.tolist(), strict=True):
            letters[k] += m.end() - m.start()
            if spans and spans[-1][2] == langs[k]:
                spans[-1] = (spans[-1][0], m.end(), langs[k])
            else:
                spans.append((m.start(), m.end(), langs[k]))
        top = max(letters, key=lambda k: (letters[k], -k))
        return langs[top], letters[top] / sum(letters.values()), spans


def _count(batches):
    for batch in batches:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Counter(WORD.findall(text.lower()))
            counts[lang, "word"].update(words)
            tri, scripts = counts[lang, "tri"], counts[lang, "script"]
            for w, n in words.items():
                for t in trigrams(w):
                    tri[t] += n
                for c in w:
                    scripts[script(c)] += n
        rows = [(lang, kind, k, n) for (lang, kind), c in counts.items() for k, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "key", "n"])


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == HELD_OUT, F.lit(False))


def quota(counts: list[int], total: int) -> float:
    """The most rows of each language so that all together are ``total``: rare ones leave theirs to the others."""
    for i, n in enumerate(own := sorted(counts)):
        if n * (len(own) - i) > total:
            return total / (len(own) - i)
        total -= n
    return float("inf")


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> Model:
    """A model from rows with text and language, sampled by id and language down to about ``max_rows``.

    Only words and trigrams seen at least LEAST times, and the most frequent of each
    language, come to the driver: TOP_WORDS + TOP_TRIGRAMS for each language at most.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if sum(found.values()) > max_rows:
        most = quota(list(found.values()), max_rows)
        share = F.create_map(*(x for lang, n in found.items() for x in (F.lit(lang), F.lit(int(GRAIN * min(1.0, most / n))).cast("long"))))
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), F.coalesce("id", F.lit(""))), F.lit(GRAIN)) < share[F.col("lang")])
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = counts.where((F.col("n") >= LEAST) | (F.col("kind") == "script")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")))
    kept = ranked.where(F.col("rank") <= F.when(F.col("kind") == "word", TOP_WORDS).otherwise(TOP_TRIGRAMS)).select("lang", "kind", "key", "n")
    table: dict[tuple[str, str], dict[str, int]] = defaultdict(dict)
    for r in kept.toLocalIterator():
        table[r["lang"], r["kind"]][r["key"]] = r["n"]
    return Model(table, penalty)


SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])
FOUND = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))])


def labelled(docs: DataFrame, model: Model, name: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) as they are, and ``name``: a struct of lang_pred, score and spans."""
    spark = prepare(docs.sparkSession)
    names = list(keep if keep is not None else docs.columns)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = labeller.batch(batch.column(0).to_pylist())
            spans = pa.array([[{"start": s, "end": e, "lang": x} for s, e, x in f[2]] for f in found], kind)
            parts = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.StructArray.from_arrays(parts, ["lang_pred", "score", "spans"])], [*names, name])

    (text,) = fresh(docs, "_text")
    source = docs.select(*(c.alias(text) for c in columns([text_col])), *columns(names))
    return map_whole(source, run, StructType([*fields(docs, names), StructField(name, FOUND)]))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with ``lang_pred``, ``score`` and ``spans`` (named so; own columns of these names are dropped)."""
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("lang_pred", "score", "spans")]
    (found,) = fresh(docs, "_found")
    return labelled(docs, model, found, text_col=text_col, keep=names).select(*columns(names), f"{found}.*")


def confident(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, least: float = LEAST_SHARE, languages: list[str] | None = None) -> DataFrame:
    """The documents whose language is clear, all columns unchanged, whatever their names.

    Those go that are ``und``, in which no language holds more than ``least`` of the letters
    (texts mixed from several languages), or whose language isn't among ``languages`` (None: all are welcome).
    """
    model = fit(docs.where(~is_held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col, max_rows=max_rows)
    (name,) = fresh(docs, "_found")
    found = labelled(docs, model, name, text_col=text_col)
    clear = (F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] > least)
    if languages is not None:
        clear &= F.col(name)["lang_pred"].isin(languages)
    return found.where(clear).select(*columns(docs.columns))
