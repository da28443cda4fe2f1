"""Personal data by weak supervision.

Base spans come from the fixed patterns and always stay. Besides them, wider candidate patterns propose
spans; a format, a gazetteer, a context and a border labeler vote on every candidate or abstain,
expectation-maximisation estimates their reliabilities, for each kind of its own, from the counts of vote patterns
over all documents, and a logistic classifier of the span's own features, trained on the resulting probabilities, decides which
candidates are added. Context words count only as whole words. Only counts by (kind, votes, features) reach the driver: at most
kinds * 3**4 * 2**8 rows, whatever the number of documents.

The work grows in proportion to the text, but for a logarithm in the checks of overlaps. Null and empty texts have no spans. Repeated rows get equal results, each as a row. An empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import weak
from .common import map_arrow, stored, table, with_columns

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE_KINDS, LABELERS, FEATURES, ADD_AT = 4, 4, 8, 0.5

# The contract's patterns. The address pattern starts at a run of digits, which finds the same
# matches without trying every digit of a run.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Wider candidates.
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\)[ -]?|[0-9]{3}[ -])[0-9]{3}-[0-9]{4}(?![0-9-])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")),
)
# Gazetteers.
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu ch at nl".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
SECRET_HEADS = ("sk-", "sk_", "ghp_", "gho_", "AKIA", "xox", "eyJ")
CONTEXT = {
    "email": ("mail", "email", "e-mail", "mailto", "contact", "write to", "reach"),
    "ip": ("ip", "ips", "host", "hosts", "server", "servers", "address", "addresses", "login", "logins"),
    "card": ("card", "cards", "visa", "mastercard", "payment", "payments", "credit"),
    "phone": ("phone", "phones", "telephone", "tel", "call", "calls", "fax", "mobile", "cell"),
    "secret": ("token", "tokens", "secret", "secrets", "key", "keys", "apikey", "password", "passwords", "passwd", "credential", "credentials"),
    "id": ("ssn", "social security", "passport", "identity", "id", "ids"),
}
AGAINST = ("version", "isbn", "doi", "sha1", "sha256", "md5", "checksum", "commit", "http", "https", "figure", "page", "pages", "order no")


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, words))})(?![a-z0-9])")


_AGAINST, _CONTEXT = _any_word(AGAINST), {k: _any_word(v) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, looked for only before each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _number(text: str) -> bool:
    """Whether a part of an address is at most 255, however many digits it has."""
    short = text.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(map(_number, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def _before(text: str, start: int) -> str:
    """The thirty characters before, without the rest of a word that they cut."""
    at = max(0, start - 30)
    while 0 < at < start and text[at].isalnum() and text[at - 1].isalnum():
        at += 1
    return text[at:start].lower()


class Covered:
    """Whether a span overlaps one of some spans (start, end), sorted by start."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start


def votes(kind: str, body: str, before: str, border: bool) -> tuple[int, int, int, int]:
    """Format, gazetteer, context and border labelers: 1 personal data, -1 not, 0 abstains."""
    digits = re.sub("[^0-9]", "", body)
    form = gaz = 0
    if kind == "email":
        tld = re.split(r"[.\])] ?", body.lower())[-1]
        form, gaz = (1 if re.fullmatch("[a-z]{2,24}", tld) else -1), (1 if tld in DOMAINS else 0)
    elif kind == "ip":
        form, gaz = (-1 if re.search(r"(^|\.)0[0-9]", body) else 1), (-1 if body.startswith(("0.", "127.", "255.")) else 0)
    elif kind == "card":
        form, gaz = (1 if len(digits) in (15, 16) else -1), (1 if digits.startswith(ISSUERS) else 0)
    elif kind == "phone":
        form = 1 if 9 <= len(digits) <= 15 else -1
        gaz = 1 if body.startswith("+") and digits.startswith(COUNTRY_CODES) else 0
    elif kind == "secret":
        upper, lower = bool(re.search("[A-Z]", body)), bool(re.search("[a-z]", body))
        share = len(digits) / len(body)
        form = -1 if not (0.15 <= share <= 0.9 and (upper or lower)) else 1 if len(body) >= 20 else 0
        gaz = 1 if body.startswith(SECRET_HEADS) else 0
    else:
        form, gaz = (-1 if body[:3] in ("000", "666") or body[0] == "9" else 1), 0
    said = 1 if _CONTEXT[kind].search(before) else -1 if _AGAINST.search(before) else 0
    return form, gaz, said, (1 if border else -1)


def features(kind: str, body: str, before: str, border: bool) -> int:
    """Eight yes-or-no features of the span itself and of its neighbours, as bits."""
    digits = sum(map(str.isdigit, body))
    flags = (
        digits * 4 >= len(body), digits * 2 >= len(body), len(body) >= 20, len(body) >= 30,
        bool(re.search(r"[=:][\s\"']*$", before)), before.endswith(('"', "'")), bool(_CONTEXT[kind].search(before)), border,
    )
    return sum(1 << i for i, f in enumerate(flags) if f)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, kind, end, base, votes, features) of the base spans and of the wider ones beside them."""
    found, taken = [(s, k, e, True) for s, k, e in base], Covered([(s, e) for s, _, e in base])
    for name, pattern in LOOSE:
        for m in pattern.finditer(text):
            s, e = m.span()
            if name == "secret" and not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            if not taken(s, e):
                found.append((s, KINDS.index(name), e, False))
    out = []
    for s, k, e, own in sorted(found):
        before, body = _before(text, s), text[s:e]
        border = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
        v = np.array([votes(KINDS[k], body, before, border)])
        out.append((s, k, e, own, int(weak.encode(v)[0]), features(KINDS[k], body, before, border)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


CANDIDATE = "array<struct<s:int,k:int,e:int,own:boolean,votes:int,features:int>>"
_STRUCT = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("own", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]))


def _measure(column: pa.Array) -> list[pa.Array]:
    counts: list[list[int]] = [[] for _ in range(BASE_KINDS)]
    digests, all_found = [], []
    for cell in column:
        text = cell.as_py() or ""
        base = base_spans(text)
        for k, c in enumerate(counts):
            c.append(sum(x[1] == k for x in base))
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        all_found.append([dict(zip(("s", "k", "e", "own", "votes", "features"), x, strict=True)) for x in candidates(text, base)])
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(all_found, _STRUCT)]


def reliabilities(patterns: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Labelers' reliabilities, a row for each kind, and the classifier's weights from (kind, votes, features, count)
    rows."""
    rows = np.array(patterns or [(0, weak.encode(np.zeros((1, LABELERS), int))[0], 0, 0)], np.int64)
    cast, accuracy, target = weak.decode(rows[:, 1], LABELERS), np.full((len(KINDS), LABELERS), weak.START), np.zeros(len(rows))
    for kind in np.unique(rows[:, 0]):
        own = rows[:, 0] == kind
        accuracy[kind] = weak.fit(cast[own], rows[own, 3])
        target[own] = weak.posterior(cast[own], accuracy[kind])
    count = rows[:, 3].astype(float)
    x = design(rows[:, 0], rows[:, 2])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method; the penalty of 1 keeps it stable on separable data
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (count * (target - p)) - w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return accuracy, w


def design(kind: np.ndarray, feature_bits: np.ndarray) -> np.ndarray:
    return np.hstack([np.eye(len(KINDS))[kind], (feature_bits[:, None] >> np.arange(FEATURES)) & 1])


def accepted(found: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans and of the candidates that the classifier adds, leftmost first."""
    own, loose = [(x["s"], x["k"], x["e"]) for x in found if x["own"]], [x for x in found if not x["own"]]
    if loose:
        base, end = Covered([(s, e) for s, _, e in own]), -1
        score = design(np.array([x["k"] for x in loose]), np.array([x["features"] for x in loose])) @ weights
        for x, z in zip(loose, score, strict=True):  # sorted by start
            if 1 / (1 + np.exp(-z)) >= ADD_AT and x["s"] >= end and not base(x["s"], x["e"]):
                own.append((x["s"], x["k"], x["e"]))
                end = x["e"]
    return own


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, counts by base kind, base_sha256, ``spans`` (all as kind:start:end, in code points) and n_spans."""
    measured = stored(with_columns(docs, text, _measure, f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, candidates {CANDIDATE}", [id_column]), "pii")
    c = F.col("c")
    counted = measured.select(F.explode("candidates").alias("c")).groupBy(c.k.alias("k"), c.votes.alias("v"), c.features.alias("f")).count()
    _, weights = reliabilities([tuple(r) for r in counted.collect()])  # at most 6 * 3**4 * 2**8 rows

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [accepted(cell, weights) for cell in batch.column(6).to_pylist()]
            more = [pa.array([joined(x) for x in out], pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *more], names=[*batch.schema.names[:6], "spans", "n_spans"])

    return map_arrow(measured, settle, T.StructType([*measured.schema.fields[:6], T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
