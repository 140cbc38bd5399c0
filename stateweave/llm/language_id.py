"""Language identification: a family first, then one-versus-one linear SVMs inside it.

A text in lower case is turned into hashed counts of byte 1- to 3-grams (marks and digits count as spaces), square roots
scaled to length 1. One-versus-rest linear SVMs choose the family; squared-hinge SVMs for each pair of languages of that
family vote. ``fit`` uses at most about ``SAMPLE_ROWS`` labelled rows, shared equally among all languages and chosen by a hash
of the id; prediction covers every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled row everything is
``und``; a null id counts as held out; repeated rows repeat; an empty table gives none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, materialize, small

SAMPLE_ROWS = 2_000
BUCKETS = 4096
# Families of closely related languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc ast", "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv", "celtic": "ga cy gd br", "uralic": "fi et hu", "turkic": "tr az kk uz ky tt", "indic": "hi bn mr gu pa ne ur",
    "iranian": "fa ku ps tg", "semitic": "ar he mt am", "austronesian": "id ms tl jv mg", "dravidian": "ta te kn ml", "sinitic": "zh yue wuu",
}
FAMILY_OF = {language: family for family, members in FAMILIES.items() for language in members.split()}
#: ASCII bytes that aren't letters become spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(b" ".join(text.lower().encode().translate(LETTERS).split()), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.float32)
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, 4):
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear SVM, by accelerated gradients; classes weigh the same. y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = z = np.zeros(x.shape[1], np.float32)
    t, step = 1.0, 1 / (decay + 2 * 2.0)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        nxt = z - step * (decay * z - 2 * ((share * y * slack) @ x))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, z, t = nxt, nxt + (t - 1) / t2 * (nxt - w), t2
    return w


class Model:
    """Families, their one-versus-rest weights and the pairs' weights inside each."""

    def __init__(self, x: np.ndarray, languages: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for language in sorted(set(languages.tolist())):
            self.families.setdefault(FAMILY_OF.get(language, language), []).append(language)
        family = np.array([FAMILY_OF.get(v, v) for v in languages.tolist()])
        sign = lambda hit: np.where(hit, 1, -1).astype(np.float32)
        self.names = sorted(self.families)
        self.top = np.array([svm(x, sign(family == f)) for f in self.names]) if len(self.names) > 1 else None
        self.pairs = {}
        for members in self.families.values():
            for a, b in itertools.combinations(members, 2):
                some = (languages == a) | (languages == b)
                self.pairs[a, b] = svm(x[some], sign(languages[some] == a))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(x), np.zeros(len(x))
        sure = np.ones(len(x))
        family = np.zeros(len(x), int)
        if self.top is not None:
            odds = np.exp(np.minimum(3 * (x @ self.top[:, :-1].T + self.top[:, -1]).astype(float), 50))
            family, sure = odds.argmax(1), odds.max(1) / odds.sum(1)
        out = np.array([self.families[self.names[f]][0] for f in family], object)
        for f, name in enumerate(self.names):
            members, mine = self.families[name], np.flatnonzero(family == f)
            if len(members) < 2 or not len(mine):
                continue
            votes, support = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
            for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
                w = self.pairs[a, b]
                p = 1 / (1 + np.exp(-3 * (x[mine] @ w[:-1] + w[-1]).astype(float)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                support[:, i] += p
                support[:, j] += 1 - p
            best = (votes + support / (len(members) + 1)).argmax(1)
            out[mine] = np.array(members, object)[best]
            sure[mine] *= support[np.arange(len(mine)), best] / (len(members) - 1)
        return out.tolist(), sure.clip(0, 1)


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from (text, lang) rows; ``pick`` is a hash that orders the sample."""
    rows = rows.where("lang is not null and text is not null")
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota = sample_rows / max(1, counts.count())
    uniform = (F.col("pick").bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    sample = rows.where(uniform < quota).join(small(counts), "lang").where(uniform * F.col("n") < quota).select("text", "lang")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = [(features(t).tobytes(), v) for t, v in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if has_letter(t)]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.binary()), pa.array([k[1] for k in keep], pa.string())], ["x", "lang"])

        return work

    got = map_rows(sample, make, "x binary, lang string").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, BUCKETS)
    return Model(x, np.array([r.lang for r in got], object))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            with_letter = [i for i, t in enumerate(texts) if has_letter(t)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if with_letter:
                names, sure = model.predict(np.array([features(texts[i]) for i in with_letter]))
                for i, name in zip(with_letter, names, strict=True):
                    pred[i] = name
                score[with_letter] = sure
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double", 256)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the rows that aren't held out, predict all."""
    labelled = docs.where(~held_out()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(17)).alias("pick"))
    return predict(docs, fit(labelled, sample_rows))
