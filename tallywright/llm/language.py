"""Language identification by error-correcting output codes over hashed character n-grams.

Every language has a codeword of bits; one binary logistic classifier predicts each bit. A text's predictions are
decoded to the language whose codeword has the least logistic loss, bit by bit weighted by the margins. Where the second
best is close, the decision is flagged as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, small_batches

#: Texts of each language, and of all, that the classifiers learn from, about (a bound by rate of a hash of doc_id).
PER_LANGUAGE, SAMPLE = 400, 20_000
#: Size of the hashed feature space.
FEATURES = 1 << 12


def features(text: str) -> np.ndarray:
    """Relative frequencies, square-rooted, of hashed runs of 1 to 3 characters of the whole lower-cased text; what is not a letter counts as a space."""
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c):
        c = folded(c)
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    total = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        h = h[: len(c) - n] * np.uint64(0x110001) + c[n:] + np.uint64(1)
        total += np.bincount((mixed(h + np.uint64(n << 56)) & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
    return np.sqrt(total / max(1, total.sum()))


_FOLD = np.array([i if chr(i).isalpha() else 32 for i in range(0x3000)], np.uint64)


def folded(c: np.ndarray) -> np.ndarray:
    """Code points, with 32 for each that is no letter."""
    out = _FOLD[np.minimum(c, np.uint64(0x2FFF)).astype(np.int64)]
    high = c >= 0x3000
    if high.any():
        seen, at = np.unique(c[high], return_inverse=True)
        out[high] = np.array([i if chr(i).isalpha() else 32 for i in seen.tolist()], np.uint64)[at]
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords as rows of +1 and -1: the exhaustive code for up to 7 languages, else the random code of 10 log2(k) bits with the largest least distance of 200."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, width = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, bits))
        gaps = (bits - m @ m.T) / 2 + np.eye(k) * bits
        if gaps.min() > width:
            best, width = m, gaps.min()
    return best


class Model:
    """Languages, their codewords, and the weights and biases of the classifiers of the bits."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.codes, self.weights, self.bias = langs, codes, weights, bias

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score (softmax of the mean losses' negatives, sharpened by the number of bits), gap to the second best."""
        z = x @ self.weights + self.bias
        loss = np.logaddexp(0, -z[:, None, :] * self.codes[None]).mean(2)
        e = np.exp(-(loss - loss.min(1, keepdims=True)) * self.codes.shape[1])
        best = loss.argmin(1)
        ranked = np.sort(loss, 1)
        gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(x), 1.0)
        return best, (e / e.sum(1, keepdims=True))[np.arange(len(x)), best], gap


def train(x: np.ndarray, y: np.ndarray, langs: list[str], rounds: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Model:
    """One logistic classifier for each bit, by full-batch gradient steps with momentum; languages weigh the same whatever their number of texts."""
    codes = codewords(len(langs)).astype(x.dtype)
    target = codes[y]
    w, b = np.zeros((x.shape[1], codes.shape[1]), x.dtype), np.zeros(codes.shape[1], x.dtype)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    share = 1 / np.bincount(y, minlength=len(langs))[y]
    share = (share / share.sum())[:, None].astype(x.dtype)
    for _ in range(rounds):
        g = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -50, 50)))
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        vb = 0.9 * vb - rate * 0.1 * g.sum(0)
        w, b = w + vw, b + vb
    return Model(langs, codes, w, b)


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id, which is never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> Model | None:
    """Learn every language of the rows that are not held out from a bounded sample: about `per_language` texts of each,
    fewer where that makes more than `most` in all, chosen by a hash of the id, and one text of each language at least.
    None if there is nothing to learn from. The driver holds the sample's features and a row for each language."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    draw = F.xxhash64(F.lit("language"), F.col("doc_id")).bitwiseAND(F.lit(2**53 - 1)) / F.lit(2.0**53)
    known = known.where(F.length("text") > 0).withColumn("draw", draw)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not sizes:
        return None
    langs, each = sorted(r["lang"] for r in sizes), min(per_language, most / len(sizes))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], min(1.0, each / r["n"]))) for r in sizes], "lang string, bound double")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf.lang, "x": [features(t).astype(np.float32).tobytes() for t in pdf.text]})

    rows = known.join(F.broadcast(bounds), "lang").where("draw <= bound").select("text", "lang").mapInPandas(run, "lang string, x binary").collect()
    at = {lang: i for i, lang in enumerate(langs)}
    return train(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([at[r["lang"]] for r in rows]), langs)


#: Gap of the mean losses below which a decision is ambiguous.
CLOSE = 0.05


def has_letter(text_col: str = "text") -> F.Column:
    """Whether a text has a letter; false for null."""

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([t is not None and any(map(str.isalpha, t)) for t in series], dtype=bool)

    return F.pandas_udf(run, "boolean")(F.col(text_col))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score, ambiguous, and the columns in `keep` unchanged.
    A text that is null or has no letter is `und` with score 0, and so is every text where nothing could be learnt. Only
    the text is looked at. Rows that repeat get the same answer each."""

    def run(series: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": pd.Series(["und"] * len(series), dtype=object), "score": 0.0, "ambiguous": False})
        ok = [i for i, t in enumerate(series) if t is not None and any(map(str.isalpha, t))] if model is not None else []
        for at in range(0, len(ok), 500):
            rows = ok[at : at + 500]
            best, score, gap = model.predict(np.stack([features(series.iloc[i]) for i in rows]))
            out.loc[rows, "lang_pred"] = [model.langs[b] for b in best]
            out.loc[rows, "score"] = score
            out.loc[rows, "ambiguous"] = gap < CLOSE
        return out

    small_batches(docs.sparkSession)
    predict = F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")
    cols = [F.col(c) for c in keep]
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.struct(*cols).alias("kept") if keep else F.lit(None).alias("kept"), predict(F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous", *(["kept"] if keep else []))
