"""Quality rules by weak supervision.

Each rule votes +1 (good), -1 (bad) or 0 (abstains) on a document. Expectation-maximisation estimates the
rules' accuracies from how they agree over all documents, and a document's posterior probability of being
good replaces the usual filter in which every rule must pass. Only the counts of vote patterns reach the
driver: at most 3**rules rows, whatever the number of documents.

A document on which no rule votes has the probability 0.5 and is kept, as nothing speaks against it. Null and
empty texts have no words, no votes and fail the base rule. Repeated rows are judged alike, each
as a row. An empty table gives an empty result. Other columns pass through; none is looked at by name but
the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import weak
from .common import arrow_flag, stored, table, with_columns
from .textcore import BLANK_WORDS, covered, hash_ranges, hash_windows, mix, per_row, text_slices, window_starts, words

LEAST_WORDS, REPEAT_SHARE, KEEP_AT = 50, 0.5, 0.5
RULES = ("symbols", "repeats", "lines", "shouting", "exclamations", "word_length", "letters", "prose")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern long, base_failed boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _measure_slice(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    w = words(data, off, BLANK_WORDS)
    n = len(off) - 1
    count = np.diff(w.first)

    def chars(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))
        return total[off[1:]] - total[off[:-1]]

    heads = np.concatenate(([0], np.cumsum(_HEAD[data], dtype=np.int64)))
    word_chars = per_row(heads[w.end] - heads[w.start], w.first)
    # words in repeated 3-word windows
    start, row = window_starts(w.first, 3)
    key = hash_windows(hash_ranges(data, w.start, w.end), start, start + 3) ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    repeated = per_row(covered(start[twice], 3, len(w.start)), w.first)
    # lines that hold a word, each found from its first word
    breaks, word_row = np.flatnonzero(data == 10), w.row()
    at = np.searchsorted(breaks, w.start)
    begin = np.maximum(np.concatenate(([0], breaks + 1))[at], off[:-1][word_row])
    opens = np.ones(len(begin), bool)
    opens[1:] = begin[1:] != begin[:-1]
    line_start, line_row = begin[opens], word_row[opens]
    line_end = np.minimum(np.append(breaks, len(data))[at][opens], off[1:][line_row])
    line_key = hash_ranges(data, line_start, line_end) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    _, kept = np.unique(line_key, return_index=True)
    lines = np.bincount(line_row, minlength=n)
    dup_lines = lines - np.bincount(line_row[kept], minlength=n)
    # the last byte of a line's last word
    last = w.end[np.searchsorted(w.start, line_end) - 1] - 1 if len(line_end) else line_end
    stopped = np.bincount(line_row[_STOP[data[last]]], minlength=n) if len(line_row) else np.zeros(n, int)
    return {"n_words": count, "word_chars": word_chars, "n_symbols": chars(_SYMBOL), "n_dup_lines": dup_lines, "n_repeat_words": repeated,
            "lines": lines, "stopped": stopped, "upper": chars(_UPPER), "letters": chars(_LETTER), "bangs": chars(np.arange(256) == 33), "heads": heads[off[1:]] - heads[off[:-1]]}


def _votes(x: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each of RULES. Most rules accuse or abstain; only the last two can speak for a document."""
    n, lines = np.maximum(x["n_words"], 1), np.maximum(x["lines"], 1)
    share = {k: x[k] / n for k in ("n_symbols", "n_repeat_words", "bangs")}
    dup, upper, length = x["n_dup_lines"] / lines, x["upper"] / np.maximum(x["letters"], 1), x["word_chars"] / n
    bad = lambda accused: np.where(accused, -1, 0)
    clean = (share["n_symbols"] < 0.05) & (share["bangs"] < 0.1) & (share["n_repeat_words"] < 0.2) & (upper < 0.3)
    letters = x["letters"] / np.maximum(x["word_chars"], 1)
    votes = np.stack([
        bad(share["n_symbols"] > 0.2), bad(share["n_repeat_words"] > 0.4), bad((dup > 0.3) & (x["n_dup_lines"] > 1)), bad(upper > 0.5), bad(share["bangs"] > 0.3),
        np.where((length > 20) | (length < 1.5), -1, np.where((length >= 2) & (length <= 14) & clean, 1, 0)),
        np.where(letters < 0.4, -1, np.where((letters > 0.75) & clean, 1, 0)),
        np.where(clean & (x["stopped"] >= 0.5 * lines), 1, 0),
    ], axis=1)
    votes[x["n_words"] == 0] = 0
    return votes


def _measure(column: pa.Array) -> list[np.ndarray]:
    parts = []
    for _, _, data, off in text_slices(column):
        x = _measure_slice(data, off)
        failed = (x["n_words"] < LEAST_WORDS) | (x["n_repeat_words"] > REPEAT_SHARE * x["n_words"])
        parts.append([*(x[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), weak.encode(_votes(x)), failed])
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6 + [np.zeros(0, bool)]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, the base counts, the vote pattern and whether the base rule fails."""
    return with_columns(docs, text, _measure, FEATURES, keep)


def probability(pattern: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    return weak.posterior(weak.decode(pattern, len(RULES)), accuracy)


def fit(features: DataFrame) -> np.ndarray:
    """The rules' accuracies, from the vote patterns of all documents that the base rule leaves."""
    rows = features.where("not base_failed").groupBy("pattern").count().collect()  # at most 3**8 rows
    pattern = np.array([r[0] for r in rows], np.int64)
    return weak.fit(weak.decode(pattern, len(RULES)), np.array([r[1] for r in rows]))


def judged(features: DataFrame, accuracy: np.ndarray) -> DataFrame:
    """Adds p_good and kept."""
    spark = features.sparkSession
    seen = features.select("pattern").distinct().collect()  # at most 3**8 rows
    pattern = np.array(sorted(r[0] for r in seen), np.int64)
    p = spark.createDataFrame([(int(k), float(v)) for k, v in zip(pattern, probability(pattern, accuracy), strict=True)], "pattern long, p_good double")
    out = features.join(F.broadcast(p), "pattern", "left")  # at most 3**8 rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base counts, base_failed, p_good and kept, a row for each document."""
    features = stored(measured(docs, [id_column], text), "quality")
    return judged(features, fit(features))


def filtered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns. Two passes over the texts and no shuffle of them; only
    the text goes to Python, and one bit comes back."""
    accuracy = fit(measured(docs, [], text))

    def keep(column: pa.Array) -> pa.Array:
        *_, pattern, failed = _measure(column)
        return pa.array(~failed & (probability(pattern, accuracy) >= KEEP_AT))

    return docs.where(arrow_flag(docs, text, keep))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
