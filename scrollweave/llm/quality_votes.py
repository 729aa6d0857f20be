"""Quality rules (2): weak supervision.

Each rule looks at one property of a text and votes that it is good, that it is
bad, or abstains. A property has several rules, so that a bad text mostly draws
several bad votes. Expectation-maximisation over all documents' votes estimates,
without labels, how often each rule votes so for good and for bad texts; the
posterior probability that a text is good then decides, so that no rule is a
veto and rules that often err weigh little. Only the base rules of the contract
(too few words, too many repeated words) reject alone.

Scale: properties come from one scan, in numpy, without a shuffle. EM needs
only how many documents have each pattern of votes: at most 3 ** rules pairs of
numbers (77 MB), on real texts some hundred; its result is a sum of weights per
rule, an expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewise import SPACE, U, Text, chunks, distinct, doc_key, lean, windows
from .common import settle

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_twice", "n_upper", "n_letters", "n_shouts", "n_ends", "n_symbol_words", "n_letter_words", "n_capital_words", "n_distinct", "n_function_words", "n_letter_chars")
MIN_WORDS, MAX_REPEAT = 20, 30
KEEP = 0.5
#: Before votes are seen: the share of good texts, and of good and of bad texts that a rule calls bad. It weighs as much as so many texts.
GOOD, MISFIRE, HIT, STRENGTH = 0.8, 0.05, 0.4, 20.0
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = "the of and to in that is with for be der die und das ist zu den mit nicht von le la les et de des est que pour dans el los las y en es por con una un".split()


@dataclass(frozen=True)
class Rule:
    """Votes by the ratio of two features: bad if it is ``bad`` or more, good if ``good`` or less (the other way round if good > bad); abstains between, or below ``least`` of the divisor."""

    name: str
    top: str
    bottom: str
    good: float
    bad: float
    least: int = 1


#: Thresholds of a bad vote follow rules in common use (a tenth of symbols, four fifths of words with a letter, three tenths of repeated lines); those of a good vote stand well apart.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.05, 0.1),
    Rule("symbol_words", "n_symbol_words", "n_words", 0.05, 0.1),
    Rule("letter_words", "n_letter_words", "n_words", 0.9, 0.8),
    Rule("letters", "n_letter_chars", "word_chars", 0.9, 0.8),
    Rule("capitals", "n_upper", "n_letters", 0.1, 0.3),
    Rule("capital_words", "n_capital_words", "n_words", 0.05, 0.2),
    Rule("shouts", "n_shouts", "n_words", 0.02, 0.1),
    Rule("repeats", "n_repeat_words", "n_words", 0.1, 0.2),
    Rule("twice", "n_twice", "n_words", 0.05, 0.2),
    Rule("distinct", "n_distinct", "n_words", 0.4, 0.3),
    Rule("lines", "n_dup_lines", "n_lines", 0.15, 0.3, 4),
    Rule("sentences", "n_ends", "n_words", 0.02, 0.005, 40),
    Rule("long_words", "word_chars", "n_words", 8.0, 10.0),
    Rule("function_words", "n_function_words", "n_words", 0.05, 0.02, 20),
)


def measure(text: Text) -> dict[str, np.ndarray]:
    """The features of each document."""
    data, n = text.data, text.n
    starts, ends = text.words()
    docs = text.docs_of(starts)
    per_doc = partial(np.bincount, minlength=n)
    out = {"n_words": per_doc(docs)}
    out["word_chars"] = text.per_doc(~SPACE[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = text.per_doc(SYMBOL[data])
    out["n_shouts"] = text.per_doc(data == ord("!"))
    # Lines; one that starts at the end of its document is empty and has no word.
    breaks = np.flatnonzero(data == 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[text.offsets], edge[breaks + 1] = True, True
    begin = np.flatnonzero(edge[:-1])
    stop = np.append(begin[1:], len(data))
    stop = stop - ((data[stop - 1] == 10) & (stop > begin))
    holds = np.searchsorted(starts, begin, "left") < np.searchsorted(starts, np.maximum(stop, begin), "left")
    begin, stop = begin[holds], stop[holds]
    of = text.docs_of(begin)
    out["n_lines"] = per_doc(of)
    line = text.codes(begin, stop)[0]
    again = pd.MultiIndex.from_arrays([of, line]).duplicated(keep="first")
    out["n_dup_lines"] = per_doc(of[again])
    # Words in windows of eight that the text has twice.
    hashes = text.hashes(starts, ends)
    codes, first, _ = text.codes(starts, ends, hashes)
    words = codes.astype(U)
    keys, at = windows(words, docs, 8)
    equal = lambda a, b: (docs[at[a]] == docs[at[b]]) & np.logical_and.reduce([words[at[a] + k] == words[at[b] + k] for k in range(8)])
    window, *_ = distinct(keys + doc_key(docs[at]), equal)
    twice = at[np.bincount(window)[window] > 1] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    out["n_repeat_words"] = per_doc(docs[np.cumsum(cover)[:-1] > 0])
    same = (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])
    out["n_twice"] = per_doc(docs[1:][same])
    # Capitals of ASCII and of Latin-1 (C3 80 to C3 9E).
    wide = np.zeros(len(data), bool)
    wide[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (wide & (data >= 0x80) & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | (wide & (data >= 0x9F))
    out["n_upper"], out["n_letters"] = text.per_doc(upper), text.per_doc(upper | lower)
    last = data[ends - 1]
    out["n_ends"] = per_doc(docs[(last == ord(".")) | (last == ord("?")) | (last == ord("!"))])
    # Words by what they hold; a letter is one of ASCII, or any character beyond it.
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0)
    held = lambda mask: np.bincount(np.searchsorted(starts, np.flatnonzero(mask), "right") - 1, minlength=len(starts))
    letters = np.add.reduceat(letter, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)
    big = held((data >= 65) & (data <= 90))
    out["n_symbol_words"], out["n_letter_words"] = per_doc(docs[held(SYMBOL[data]) > 0]), per_doc(docs[letters > 0])
    out["n_capital_words"] = per_doc(docs[(big >= 2) & (big == letters)])
    out["n_distinct"] = per_doc(pd.unique(docs * len(words) + codes) // max(1, len(words)))
    known = _function_hashes()
    function = known[np.minimum(np.searchsorted(known, hashes[first]), len(known) - 1)] == hashes[first]
    out["n_function_words"] = per_doc(docs[function[codes]])
    out["n_letter_chars"] = per_doc(docs, letters).astype(np.int64)
    return out


@cache
def _function_hashes() -> np.ndarray:
    """Of FUNCTION_WORDS, as they are and capitalised, in ascending order."""
    raw = [w.encode() for x in FUNCTION_WORDS for w in (x, x.capitalize())]
    end = np.cumsum([len(w) for w in raw])
    return np.sort(Text(np.frombuffer(b"".join(raw), np.uint8), np.array([0, end[-1]])).hashes(np.concatenate([[0], end[:-1]]), end))


SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, text in chunks(batch.column(1)):
            got = measure(text)
            yield pa.record_batch([batch.column(0)[lo:hi], *(pa.array(got[f].astype(np.int64)) for f in FEATURES)], ["doc_id", *FEATURES])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FEATURES: one row for each row of ``docs``; a null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_measured), "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def vote(rule: Rule) -> Column:
    """1 good, 0 bad, null abstains."""
    ratio = F.col(rule.top) / F.nullif(F.col(rule.bottom), F.lit(0))
    good, bad = (ratio <= rule.good, ratio >= rule.bad) if rule.good < rule.bad else (ratio >= rule.good, ratio <= rule.bad)
    return F.when(F.col(rule.bottom) >= rule.least, F.when(good, 1).when(bad, 0))


@dataclass(frozen=True)
class Model:
    """prior: of a good text. told: for each rule, P(votes good | good) and P(votes good | bad), given that it votes."""

    prior: float
    told: tuple[tuple[float, float], ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds: of the prior, and of a good and of a bad vote of each rule."""
        return math.log(self.prior / (1 - self.prior)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in self.told]


def learn(votes: np.ndarray, count: np.ndarray, strength: float = STRENGTH, rounds: int = 1000) -> Model:
    """EM over patterns of votes (1, 0, NaN: abstains) and how many documents have each.

    Beliefs (GOOD, MISFIRE, HIT) that weigh as much as ``strength`` documents,
    however many there are, say which of the two classes is the good one and
    keep estimates off 0 and 1. Of several starts (texts with less than one,
    two and three bad votes are good) the likeliest answer counts. Without
    documents the beliefs stay.
    """
    believed = np.array([1 - MISFIRE, 1 - HIT])
    best, told, prior = -np.inf, np.tile(believed, (votes.shape[1], 1)), GOOD
    if not count.sum():
        return Model(prior, tuple(map(tuple, told.tolist())))
    cast, good = ~np.isnan(votes), np.nan_to_num(votes)
    bad = (cast & (votes == 0)).sum(1)
    for start in (1, 2, 3):
        post, before = np.where(bad < start, 0.99, 0.01), -np.inf
        for _ in range(rounds):
            share = float((post @ count + strength * GOOD) / (count.sum() + strength))
            rate = np.empty_like(told)
            for k, p in enumerate((post, 1 - post)):
                weight = (p * count)[:, None] * cast
                rate[:, k] = ((weight * good).sum(0) + strength * believed[k]) / (weight.sum(0) + strength)
            said = good @ np.log(rate) + (cast * (1 - good)) @ np.log(1 - rate) + np.log([share, 1 - share])
            post = 1 / (1 + np.exp(np.clip(said[:, 1] - said[:, 0], -700, 700)))
            beliefs = GOOD * np.log(share) + (1 - GOOD) * np.log(1 - share) + (believed * np.log(rate) + (1 - believed) * np.log(1 - rate)).sum()
            likely = float(np.logaddexp(said[:, 0], said[:, 1]) @ count + strength * beliefs)
            if likely - before < 1e-9 * abs(likely):
                break
            before = likely
        if likely > best + 1e-6 * abs(likely):
            best, told, prior = likely, rate, share
    return Model(prior, tuple(map(tuple, told.tolist())))


def fit(measured: DataFrame, rules: tuple[Rule, ...] = RULES, strength: float = STRENGTH) -> Model:
    """Learn from the votes on all rows; a number and a count for each pattern of votes reach the driver."""
    code = F.lit(0)
    for k, rule in enumerate(rules):
        code = code + F.coalesce(vote(rule), F.lit(2)) * 3**k
    counts = measured.select(code.cast("long").alias("code")).groupBy("code").count().toArrow()
    order = np.argsort(codes := counts["code"].to_numpy())
    digits = codes[order][:, None] // 3 ** np.arange(len(rules)) % 3
    return learn(np.where(digits == 2, np.nan, digits.astype(float)), counts["count"].to_numpy()[order].astype(float), strength)


def posterior(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    start, weights = model.weights()
    odds = F.lit(start)
    for rule, (up, down) in zip(rules, weights, strict=True):
        odds = odds + F.coalesce(F.when(vote(rule) == 1, up).when(vote(rule) == 0, down), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, kept, p_quality, votes.

    A null or empty text has no words and fails. Ids may be null or repeat;
    other columns are not looked at; an empty table gives an empty result.
    votes has a letter for each rule: g, b or -.
    """
    measured = settle(features(docs, id_col, text_col), "features")
    model = fit(measured)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    letters = F.concat(*(F.coalesce(F.when(vote(r) == 1, "g").when(vote(r) == 0, "b"), F.lit("-")) for r in RULES))
    out = measured.withColumns({"base_failed": failed, "p_quality": posterior(model), "votes": letters})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_quality") >= keep)).alias("kept"), "p_quality", "votes")


def good_documents(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, whatever their names.

    The verdict is taken again where the row is, so texts are not shuffled. Rows
    with a null or empty text go; rows that repeat stay as often as they stand
    there; ids aren't looked at; an empty table gives an empty one.
    """
    start, weights = fit(features(docs)).weights()
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.zeros(batch.num_rows, bool)
            for lo, hi, text in chunks(batch.column(at)):
                stay[lo:hi] = verdicts(measure(text), start, weights, keep)
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(lean(sift), docs.schema)


def verdicts(got: dict[str, np.ndarray], start: float, weights: list[tuple[float, float]], keep: float) -> np.ndarray:
    """As ``kept`` of :func:`judge`, in numpy."""
    odds = np.full(len(got["n_words"]), start)
    for rule, (up, down) in zip(RULES, weights, strict=True):
        ratio = got[rule.top] / np.maximum(got[rule.bottom], 1)
        good, bad = (ratio <= rule.good, ratio >= rule.bad) if rule.good < rule.bad else (ratio >= rule.good, ratio <= rule.bad)
        odds += np.where(got[rule.bottom] >= rule.least, np.where(good, up, np.where(bad, down, 0.0)), 0.0)
    failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT * got["n_words"])
    return ~failed & (1 / (1 + np.exp(-odds)) >= keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
