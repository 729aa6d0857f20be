"""Language ID (8): script ranges, then Viterbi over per-word scores.

A model has, for each language, counts of letter trigrams (with the edges of
words) and of whole words, hashed into a table of fixed size, and the share of
each script. A word's script narrows the candidates; each candidate scores the
word; Viterbi with a penalty for each switch labels the words, so that a text
is spans of languages. A text's language is the one with most of its letters.

Scale: one scan to count and one to label, in numpy. Counts are summed per task
and then by (language, bucket), so that what reaches the driver is bounded by
the table, not the corpus. A text in which no stretch gains more than half the
penalty by any other language has one span: there Viterbi's answer is known
without its steps; all other texts of a batch take them side by side.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewise import U, Text, chunks, lean, mix

BITS = 16
PENALTY = 20.0
#: The most languages a model has: those with most rows, of equals the first by name.
MOST_LANGUAGES = 256
#: A language is a candidate for a script that has this share of its letters.
SHARE = 0.005
UNKNOWN = "und"

#: First code points of blocks by script; each ends where the next begins. 0 is no script of its own.
SCRIPTS = ("other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "ethiopic", "khmer", "kana", "han")
BLOCKS = ((0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0900, 7), (0x0E00, 8), (0x0E80, 0), (0x10A0, 9), (0x1100, 10), (0x1200, 11), (0x1380, 0), (0x1780, 12), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x2E80, 14), (0x3040, 13), (0x3100, 14), (0xA000, 0), (0xAC00, 10), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB13, 0), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF66, 13), (0xFFA0, 10), (0x10000, 0), (0x20000, 14))
#: No letter is assigned from here on.
TOP = 0x40000

_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Letter, letter or mark, lower case, script: by code point up to TOP, which stands for all beyond."""
    if not _tables:
        letter, inside, lower = np.zeros(TOP + 1, bool), np.zeros(TOP + 1, bool), np.arange(TOP + 1, dtype=np.uint32)
        for c in range(TOP):
            if (kind := unicodedata.category(chr(c))[0]) in "LM":
                letter[c], inside[c] = kind == "L", True
                if len(low := chr(c).lower()) == 1:
                    lower[c] = ord(low)
        script = np.zeros(TOP + 1, np.int64)
        for first, s in BLOCKS:
            script[first:] = s
        _tables[:] = [letter, inside, lower, script]
    return _tables


class Words:
    """The words of some documents: maximal runs of letters and marks with a letter among them."""

    def __init__(self, text: Text):
        letter, inside, lower, script = tables()
        raw = text.data.tobytes().decode("utf-8", "replace").encode("utf-32-le")
        points = np.frombuffer(raw, "<u4")
        offsets = np.concatenate([[0], np.cumsum(text.per_doc((text.data & 0xC0) != 0x80))])
        if offsets[-1] != len(points):  # bytes that aren't UTF-8
            each = [text.data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(text.offsets[:-1], text.offsets[1:], strict=True)]
            points, offsets = np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])])
        kind = np.minimum(points, TOP)
        is_letter = inside[kind]
        chars = Text(kind, offsets)
        self.n = text.n
        self.starts, self.ends = chars.runs(is_letter)
        # Runs of marks alone are no words.
        before = np.concatenate([[0], np.cumsum(letter[kind])])
        real = before[self.ends] > before[self.starts]
        for a, b in zip(self.starts[~real].tolist(), self.ends[~real].tolist(), strict=True):
            is_letter[a:b] = False
        self.starts, self.ends = self.starts[real], self.ends[real]
        self.docs = chars.doc_of(self.starts)
        self.begin = self.starts - offsets[self.docs]
        self.size = self.ends - self.starts
        # A word's script is its first letter's.
        first = np.searchsorted(before, before[self.starts], "right") - 1
        self.script = script[kind[first]]
        # Letters one after the other; a word's first has no letter before it, its last none after.
        low = lower[kind[is_letter]].astype(U)
        edge = np.cumsum(self.size)
        self.first = edge - self.size
        before, after = np.roll(low, 1), np.roll(low, -1)
        if len(low):
            before[self.first], after[edge - 1] = 0, 0
        self.grams = self._bucket(before * U(0x9E3779B97F4A7C15) + low * U(0xC2B2AE3D27D4EB4F) + after * U(0x165667B19E3779F9))
        place = (np.arange(len(low)) - np.repeat(self.first, self.size)).astype(U)
        whole = np.add.reduceat(mix(low + (place << U(32))), self.first) if len(low) else np.zeros(0, U)
        self.whole = self._bucket(whole | U(1))

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        return (h >> U(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """languages; log probabilities [bucket, language]; candidates [script, language]."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """From counts by bucket and by script of each language."""
        languages = sorted(counts)
        by = np.array([counts[x][0] for x in languages], float).reshape(len(languages), 1 << BITS).T + 0.5
        script = np.array([counts[x][1] for x in languages], float).reshape(len(languages), len(SCRIPTS)).T
        share = script / np.maximum(script.sum(0), 1)
        can = share >= SHARE
        can[~can.any(1)] = True  # a script that no language has doesn't narrow
        return cls(languages, np.log(by / by.sum(0)).astype(np.float32), can)


def word_scores(words: Words, model: Model) -> np.ndarray:
    got = model.scores[words.whole].astype(np.float64)
    if len(words.grams):
        got += np.add.reduceat(model.scores[words.grams], words.first, axis=0)
    return np.where(model.candidates[words.script], got, got.min(initial=0.0) - 1000.0)


def viterbi(scores: np.ndarray, docs: np.ndarray, n: int, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word: the sum of scores less the penalty for each switch is the largest.

    If over no stretch any language gains more than half the penalty on the one
    that is best for the whole text, one language is the answer: m stretches of
    others need m - 1 switches at least, and one alone gains nothing.
    """
    count = np.bincount(docs, minlength=n)
    first = np.cumsum(count) - count
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, 0)])
    best = (sums[first + count] - sums[first]).argmax(1)
    mixed = np.zeros(n, bool)
    rows = np.arange(len(scores))
    for b in range(scores.shape[1]):
        gain = np.cumsum(scores[:, b] - scores[rows, best[docs]])
        gain -= np.repeat(np.where(first > 0, gain[np.maximum(first - 1, 0)], 0.0), count)
        # The least of all earlier sums of the document: each document is moved below the ones before.
        step = 2 * np.abs(gain).max(initial=0.0) + 1
        before = np.where(rows == first[docs], 0.0, np.roll(gain, 1)) - docs * step
        rise = gain - (np.minimum.accumulate(before) + docs * step)
        mixed |= np.bincount(docs, rise > penalty / 2, n) > 0
    out[:] = best[docs]
    # The others, longest first, step by step side by side.
    some = np.flatnonzero(mixed)
    some = some[np.argsort(-count[some], kind="stable")]
    if not len(some):
        return out
    begin, length = first[some], count[some]
    value, back = scores[begin].copy(), []
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))
        value_t = value[:live]
        top = value_t.argmax(1)
        jump = value_t[np.arange(live), top] - penalty
        stay = value_t >= jump[:, None]
        back.append(np.where(stay, np.arange(scores.shape[1])[None], top[:, None]))
        value[:live] = np.where(stay, value_t, jump[:, None]) + scores[begin[:live] + t]
    state = value.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        if t + 1 < int(length[0]):
            on = int(np.searchsorted(-length, -(t + 1), "left"))
            state[:on] = back[t][np.arange(on), state[:on]]
        out[begin[:live] + t] = state[:live]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for lo, hi, text in chunks(batch.column(0)):
            words = Words(text)
            names = sorted(set(lang[lo:hi]))
            code = np.array([names.index(x) for x in lang[lo:hi]], np.int64)
            of_word = code[words.docs]
            of_letter = np.repeat(of_word, words.size)
            for k, name in enumerate(names):
                both = held.setdefault(name, [np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS), np.int64)])
                both[0] += np.bincount(words.grams[of_letter == k], minlength=1 << BITS) + np.bincount(words.whole[of_word == k], minlength=1 << BITS)
                both[1] += np.bincount(words.script[of_word == k], words.size[of_word == k], len(SCRIPTS)).astype(np.int64)
    for name, (by, script) in held.items():
        for bucket, count in ((np.flatnonzero(by), by), (-1 - np.flatnonzero(script), script[::-1])):
            n = count[bucket] if bucket.size and bucket[0] >= 0 else held[name][1][-1 - bucket]
            yield pa.record_batch([pa.array([name] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])


def learn(rows: DataFrame) -> Model:
    """From rows (text, lang) without nulls in lang; a table of 2 ** BITS counts for each of MOST_LANGUAGES at most reaches the driver."""
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    rows = rows.filter(F.col("lang").isin([r["lang"] for r in most]))
    counts = rows.select("text", "lang").mapInArrow(lean(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect():
        by, script = got[row["lang"]] = np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS), np.int64)
        bucket, n = np.array(row["b"], np.int64), np.array(row["n"], np.int64)
        by[bucket[bucket >= 0]] = n[bucket >= 0]
        script[-1 - bucket[bucket < 0]] = n[bucket < 0]
    return Model.of(got)


SPANS = "array<struct<start:long,end:long,lang:string>>"


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans: one row for each row of ``docs``.

    spans are maximal runs of words of one language, in code points, end
    exclusive. lang_pred has most letters of the spans (of equals the first by
    name), score their share. A text that is null or has no letter is ``und``
    with score 0 and no spans, and so is any text if the model has no language.
    """

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in chunks(batch.column(1)):
                words, n = Words(text), hi - lo
                names = model.languages
                if not names:
                    none = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], ["start", "end", "lang"]))
                    yield pa.record_batch([batch.column(0)[lo:hi], pa.array([UNKNOWN] * n), pa.array([0.0] * n), none], ["doc_id", "lang_pred", "score", "spans"])
                    continue
                state = viterbi(word_scores(words, model), words.docs, n, penalty)
                letters = np.bincount(words.docs * len(names) + state, words.size, n * len(names)).reshape(n, len(names))
                total = letters.sum(1)
                top = letters.argmax(1)
                score = letters.max(1) / np.maximum(total, 1)
                fresh = np.ones(len(state), bool)
                fresh[1:] = (state[1:] != state[:-1]) | (words.docs[1:] != words.docs[:-1])
                at = np.flatnonzero(fresh)
                last = np.append(at[1:], len(state))[: len(at)] - 1
                per = np.concatenate([[0], np.cumsum(np.bincount(words.docs[at], minlength=n))]).astype(np.int32)
                said = pa.array(names).take(pa.array(state[at]))
                spans = pa.StructArray.from_arrays([pa.array(words.begin[at]), pa.array(words.begin[last] + words.size[last]), said], ["start", "end", "lang"])
                pred = [names[k] if some else UNKNOWN for k, some in zip(top.tolist(), (total > 0).tolist(), strict=True)]
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(pred), pa.array(score), pa.ListArray.from_arrays(pa.array(per), spans)], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(tag), f"doc_id long, lang_pred string, score double, spans {SPANS}")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans: learn from two thirds of the labelled rows, label all.

    A row is held out if crc32 of its id, as text (null: empty), leaves 1 when
    divided by 3; held-out rows and rows without lang teach nothing.
    """
    held = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = learn(docs.filter(~held("doc_id") & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return label(docs, model).select("doc_id", held("doc_id").alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
