"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon, the trees and the calibration are fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of doc_id.
Scoring covers every whole text, Arrow-batched, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Isotonic
from .common import Scratch, map_blocks, spread, table

#: Bounds of the sample of labelled rows that the model is fitted on: rows, bytes of all texts, and bytes of one.
FIT_ROWS, FIT_BYTES, FIT_TEXT = 20_000, 64 << 20, 1 << 20
THRESHOLD = 0.3
HELD_OUT_OF, HELD_OUT = 4, 2
NEAR = 5

_LOWER = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Digits and signs that stand for letters.
_LEET = dict(zip(b"0134578@$!", b"oieastbasi"))
_DELEET = bytes(_LEET.get(b, _LOWER[b]) for b in range(256))
_SPACED = re.compile(rb"(?<![a-z])(?:[a-z][ ._*-]){3,}[a-z](?![a-z])")
_SECOND = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine tu toi ton te vous votre usted tus ti ihr euch eure".split())
_MARKS = b"!?#$%&*@"
#: Stems are beginnings of words of so many letters; so many different words of a text must share one for it to count.
STEM_MIN, STEM_MAX, STEM_WORDS = 5, 8, 2
FEATURES = ("hits", "density", "kinds", "weak", "near_you", "capitals", "marks", "obfuscated", "spaced", "digits", "length", "repeats", "stemmed", "stem_words")


def _folding() -> bytes:
    """Like _LOWER, and second bytes of accented Latin letters (their first, C3, is deleted) stand for the plain letters."""
    out = bytearray(_LOWER)
    for k, c in enumerate(b"aaaaaaaceeeeiiiidnooooo.ouuuuyts"):
        if c != 0x2E:
            out[0x80 + k] = out[0xA0 + k] = c
    return bytes(out)


_FOLD = _folding()


def folded(text: bytes) -> list[bytes]:
    """Words of a text without case and without accents of Latin letters."""
    return text.translate(_FOLD, b"\xc3").split()


def sure(a: float, b: float, n1: float, n0: float) -> float:
    """Twice the log-likelihood ratio of a word in a of n1 toxic and b of n0 other rows against equal shares."""
    n, k = n1 + n0, a + b
    cells = ((a, n1 * k / n), (b, n0 * k / n), (n1 - a, n1 * (n - k) / n), (n0 - b, n0 * (n - k) / n))
    return 2 * sum(x * np.log(x / e) for x, e in cells if x > 0)


def log_odds(a: float, b: float, n1: float, n0: float) -> float:
    return float(np.log((a + 0.1) / (n1 - a + 0.1)) - np.log((b + 0.1) / (n0 - b + 0.1)))


def _shared_stems(text: str) -> np.ndarray:
    """Stems that STEM_WORDS different words of a text start with, as whole numbers: STEM_MAX bytes, zeros at the end."""
    words = np.array(list(set(folded(text.encode("utf-8", "surrogatepass")))) or [b""], f"S{STEM_MAX}").view(">u8").astype(np.uint64)
    out = []
    for k in range(STEM_MIN, STEM_MAX + 1):
        cut = np.uint64(8 * (STEM_MAX - k))
        s, times = np.unique(words[(words >> cut) & np.uint64(0xFF) > 0] >> cut << cut, return_counts=True)
        out.append(s[times >= STEM_WORDS])
    return np.concatenate(out)


def stems_of(texts: list[str], toxic: np.ndarray) -> tuple[bytes, ...]:
    """Beginnings of words that mark toxic rows, so that inflected forms count which are rare one by one; none begins another.

    A row holds a stem if STEM_WORDS different words start with it. It marks toxic rows if more of them hold it than chance
    gives among all stems tried, in whatever language: no share of all toxic rows is asked for.
    """
    bad = [_shared_stems(t) for t, y in zip(texts, toxic) if y]
    tried, a = np.unique(np.concatenate(bad or [np.zeros(0, np.uint64)]), return_counts=True)
    tried, a = tried[a >= 3], a[a >= 3]
    b = np.zeros(len(tried), np.int64)
    for t, y in zip(texts, toxic):
        if not y and len(tried):
            own = _shared_stems(t)
            at = np.minimum(np.searchsorted(tried, own), len(tried) - 1)
            b[at[tried[at] == own]] += 1
    n1 = float(toxic.sum())
    n0 = len(toxic) - n1
    least = 2 * np.log(max(len(tried), 2))
    # by bytes, so that a stem comes before those that it begins
    out: list[bytes] = []
    for s, x, y in sorted((int(s).to_bytes(8, "big").rstrip(b"\0"), x, y) for s, x, y in zip(tried, a.tolist(), b.tolist())):
        if not (out and s.startswith(out[-1])) and log_odds(x, y, n1, n0) > 1.5 and sure(x, y, n1, n0) > least:
            out.append(s)
    return tuple(out)


def lexicon(texts: list[str], toxic: np.ndarray) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words that mark toxic rows: strong ones by log odds and more support than chance gives, weak ones by log odds against their standard error."""
    counts = (Counter(), Counter())
    for t, y in zip(texts, toxic.astype(int).tolist()):
        counts[y].update(set(t.encode("utf-8", "surrogatepass").translate(_LOWER).split()))
    n1 = float(toxic.sum())
    n0 = len(toxic) - n1
    strong, weak = {}, {}
    least = 2 * np.log(max(2, sum(a >= 3 for a in counts[1].values())))
    for w, a in counts[1].items():
        b = counts[0][w]
        if a < 3 or len(w) < 3:
            continue
        odds = log_odds(a, b, n1, n0)
        z = odds / np.sqrt(1 / (a + 0.1) + 1 / (b + 0.1))
        if odds > 3 and a >= 20 * b and sure(a, b, n1, n0) > least:
            strong[w] = odds
        elif z > 2 and odds > 2:
            weak[w] = odds
    return strong, weak


def features(texts: list[str | None], strong: dict[bytes, float], weak: dict[bytes, float], stems: tuple[bytes, ...] = ()) -> np.ndarray:
    out = np.zeros((len(texts), len(FEATURES)))
    starts = [b" " + s for s in stems]
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if not raw:
            continue
        words = raw.translate(_LOWER).split()
        n, size = max(1, len(words)), len(raw)
        kinds = strong.keys() & set(words)
        hits = sum(map(words.count, kinds)) if len(kinds) < 4 else sum(w in kinds for w in words)
        near = 0
        if kinds:
            for k, w in enumerate(words):
                if w in kinds and not _SECOND.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1]):
                    near += 1
        hidden = sum(map(strong.__contains__, raw.translate(_DELEET).split()))
        spaced = sum(re.sub(rb"[^a-z]", b"", m) in strong for m in _SPACED.findall(raw.lower()))
        letters = sum(raw.count(bytes([c])) for c in range(0x41, 0x5B))
        marks = sum(raw.count(bytes([c])) for c in _MARKS)
        digits = sum(raw.count(bytes([c])) for c in range(0x30, 0x3A))
        plain = b" " + raw.translate(_FOLD, b"\xc3") if starts else b""
        begun = sum(map(plain.count, starts))
        different = sum(w.startswith(stems) for w in set(plain.split())) if begun else 0
        out[i] = (
            hits + hidden_more(hidden, hits),
            (hits + hidden_more(hidden, hits)) / n,
            len(kinds),
            sum(map(weak.__contains__, words)) / n,
            near,
            letters / size,
            marks / size,
            hidden_more(hidden, hits),
            spaced,
            digits / size,
            np.log1p(size),
            1 - len(set(words)) / n,
            begun / n,
            different,
        )
    return out


def hidden_more(hidden: int, hits: int) -> int:
    """Lexicon words that show only once signs are read as letters."""
    return max(0, hidden - hits)


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray, fold: np.ndarray):
        """fold: rows where it is true calibrate; the others make the lexicon and the trees."""
        fit = ~fold if 0 < fold.sum() < len(fold) else np.ones(len(fold), bool)
        held = fold if 0 < fold.sum() < len(fold) else fit
        some = [t for t, f in zip(texts, fit) if f]
        self.strong, self.weak = lexicon(some, toxic[fit])
        self.stems = stems_of(some, toxic[fit])
        x = features(texts, self.strong, self.weak, self.stems)
        self.trees = BoostedTrees().fit(x[fit], toxic[fit])
        self.calibrate = Isotonic().fit(self.trees.predict(x[held]), toxic[held])

    def score(self, texts: list[str | None]) -> np.ndarray:
        p = self.trees.predict(features(texts, self.strong, self.weak, self.stems))
        # calibration ties whole ranges; a small part of the raw score keeps their order
        return 0.99 * self.calibrate.predict(p) + 0.01 * p


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    """The model, from labelled rows that aren't held out; None where there are none of one class.

    The sample of labels, bounded by ``fit_rows``, is broadcast; texts come to the driver for that sample only, and for so
    much of it as has ``fit_bytes`` bytes. A text of over ``FIT_TEXT`` bytes is scored but not fitted on.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    total = known.count()
    if total > fit_rows:
        # 5 % less than the bound, as a hash doesn't give the exact share; the limit can then hardly cut
        known = known.where(chance < int(950_000 * fit_rows / total)).limit(fit_rows)
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_TEXT)
    rows = Scratch(docs.sparkSession).save(short.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id", "text"]), "labelled")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > fit_bytes:
        # of the rows that are left, those with the least values of another hash
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(950_000 * fit_bytes / size))
    rows = sorted(tuple(r) for r in rows.select("doc_id", "text", "toxic").toLocalIterator(prefetchPartitions=False))
    y = np.array([r[2] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    fold = np.array([(r[0] * 2654435761 >> 7) % 5 == 0 for r in rows])
    return Model([r[1] for r in rows], y, fold)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold).

    Null text is scored as empty text. Without labelled rows of both classes the score is 0. Labels that repeat a
    doc_id are averaged; null labels are not used. Null or repeated doc_ids are scored as any row. Only the text
    makes a score. Empty tables give no rows. Other columns stay, same-named ones are replaced.
    """
    model = fit(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts, batch):
        s = np.zeros(len(texts)) if shared.value is None else shared.value.score(texts)
        return [s.tolist(), (s >= threshold).astype(int).tolist()]

    return map_blocks(docs, "score double, predicted int", work)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted; edge cases as in ``score_toxicity``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
