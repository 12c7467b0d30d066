"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled text train a logistic model on the non-negative unbiased risk
``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])``: no negative label is used, nor counted. The class prior
is estimated from both samples: a first model tells positives from unlabelled text on one half of each, and on the other
half the prior is the least ratio of the shares of unlabelled and of positive texts above any score, a bound for what
few texts can tell added; of the best scored texts nearly all are positive. Features describe a text's form: how often
each kind of character follows each other kind, repeated words, and lengths; they come from whole texts, a pass over
the bytes.

The fit takes at most ``SAMPLE`` positives and about as many unlabelled texts, chosen by a hash of their ids. Scoring is
one narrow pass without a shuffle.

Nulls: a null text counts as empty and is scored; a null label or id is not learned from; repeated labels of an id count
once, by the smallest. Without any label every score is 0.5, without a positive one 0; without a second kind of text it
is 1. Texts are read whole, in slices of a bounded number of bytes; a longer text is taken alone and its bytes in
blocks. Equal texts have equal scores. Extra columns are carried or ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import crc_mod, narrow_batches, slices, text_words, tidy

SAMPLE, FOLDS, THRESHOLD = 8000, 5, 0.3
#: Kinds of bytes: other, space, line feed, lower, upper, digit, first and next bytes beyond ASCII, and signs of text or of markup.
_KINDS = 14
#: Bytes whose pairs are counted at once.
_BLOCK = 1 << 18
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(192, 256)), bytes(range(128, 192)), b".", b",;:'\"", b"!?", b"()-", b"*#%$&@^~", b"|<>{}[]=\\/_+`"), 1):
    _KIND[list(_bytes)] = _k
WIDTH = _KINDS * _KINDS + 5


def features(texts: list[str | None]) -> np.ndarray:
    """A row of features (float32) for each whole text."""
    raw = [(t or "").encode() for t in texts]
    n = len(raw)
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
    moves = np.zeros(n * _KINDS * _KINDS, np.int64)
    for at in range(0, len(data) - 1, _BLOCK):  # pairs of bytes that begin in this block
        kind = _KIND[data[at : at + _BLOCK + 1]]
        place = np.arange(at, at + len(kind) - 1)
        doc = np.searchsorted(ends, place, "right")
        moves += np.bincount((doc * (_KINDS * _KINDS) + kind[:-1] * _KINDS + kind[1:])[place + 1 < ends[doc]], minlength=len(moves))
    out[:, : _KINDS * _KINDS] = np.sqrt(moves.reshape(n, -1) / np.maximum(1, sizes - 1)[:, None])
    h, counts = text_words(texts)
    words = np.repeat(np.arange(n), counts)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words[1:] == words[:-1])
    order = np.lexsort((h, words))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words[order][1:] != words[order][:-1])
    some = np.maximum(1, counts)
    out[:, -5] = np.bincount(words, again, n) / some
    out[:, -4] = np.bincount(words[order], new, n) / some
    out[:, -3] = np.log1p(counts)
    out[:, -2] = sizes / some / 16
    out[:, -1] = np.log1p(sizes / np.maximum(1, [r.count(b"\n") for r in raw]))
    return out


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def non_negative_risk(g: np.ndarray, n_p: int, prior: float) -> tuple[float, np.ndarray]:
    """The risk of outputs g, positives first, with the logistic loss, and the direction to step against.

    That is the risk's gradient; where the estimated risk of negatives is below zero, it is that part's, turned round."""
    n_u, s, loss_neg = len(g) - n_p, _sigmoid(g), np.logaddexp(0, g)
    rest = float(loss_neg[n_p:].mean() - prior * loss_neg[:n_p].mean())
    dg = np.empty(len(g))
    if rest >= 0:
        dg[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
        dg[n_p:] = s[n_p:] / n_u
    else:
        dg[:n_p] = prior * s[:n_p] / n_p
        dg[n_p:] = -s[n_p:] / n_u
    return prior * float(np.logaddexp(0, -g[:n_p]).mean()) + max(0.0, rest), dg


def telling_apart(g: np.ndarray, n_p: int, _: float = 0.5) -> tuple[float, np.ndarray]:
    """The same of positives against unlabelled text as if that were negative."""
    dg = _sigmoid(g)
    value = float(np.logaddexp(0, -g[:n_p]).mean() + np.logaddexp(0, g[n_p:]).mean())
    dg[:n_p] = (dg[:n_p] - 1) / n_p
    dg[n_p:] /= len(g) - n_p
    return value, dg


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.03, decay: float = 1e-4, hidden: int = 24, seed: int = 7, risk: Callable = non_negative_risk) -> dict:
    """Weights of a one-layer network that minimises the risk."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    x = np.clip((both - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    w = {"a": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        z = np.tanh(x @ w["a"] + w["b"])
        _, dg = risk(z @ w["c"] + w["d"], len(positive), prior)
        dz = np.outer(dg, w["c"]) * (1 - z * z)
        grad = {"a": x.T @ dz + decay * w["a"], "b": dz.sum(0), "c": z.T @ dg + decay * w["c"], "d": dg.sum(keepdims=True)}
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w | {"mean": mean, "scale": scale}


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The class prior from scores of both samples: the share of unlabelled over that of positive texts above the best score.

    At each positive score the ratio is at least the prior if scores of positives are alike in both samples; the score is
    chosen by the ratio with what the sizes leave uncertain."""
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)
    share_p = np.arange(1, len(p) + 1) / len(p)
    share_u = (len(u) - np.searchsorted(u, p, "left")) / len(u)
    doubt = np.sqrt(np.log(4 / delta) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((share_u + 1.1 * doubt) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    first = fit_non_negative(positive[::2], unlabelled[::2], 0.5, steps=120, risk=telling_apart)
    return least_ratio(predict(first, positive[1::2]), predict(first, unlabelled[1::2]))


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.tanh(np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["a"] + model["b"])
    return _sigmoid(z @ model["c"] + model["d"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> dict | float:
    """The model, or a constant score where there is nothing to learn. Labels of fold 0 are left out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != 0))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"))
    total, good = known.agg(F.count("*"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
    if not good:
        return 0.5 if not total else 0.0
    order = F.xxhash64("id")
    # at most `sample` ids: small enough to broadcast whatever the size of the tables
    trusted = known.where("label = 1").select("id").orderBy(order, "id").limit(sample)
    rows = docs.count()
    share = min(1.0, sample / max(1, rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = texts.join(F.broadcast(trusted), "id").select(F.lit(True).alias("trusted"), "text")
    parts = parts.unionByName(texts.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.lit(False).alias("trusted"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in features(part.column(1).to_pylist())], pa.binary())], names=["trusted", "x"])

    table = parts.mapInArrow(tidy(run), "trusted boolean, x binary").toArrow()
    x = np.frombuffer(b"".join(b.as_py() for b in table["x"]), np.float32).reshape(-1, WIDTH)
    trust = np.array(table["trusted"].to_pylist(), bool)
    if not trust.any() or trust.all():
        return float(trust.any())
    # the fit doesn't depend on the order of tasks, and halves of a sample are alike
    arrange = lambda a: np.random.default_rng(11).permutation(a[np.lexsort(a.T)])
    positive, unlabelled = arrange(x[trust]), arrange(x[~trust])
    return fit_non_negative(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: dict | float, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), score_col: str = "score") -> DataFrame:
    """The ``carry`` columns and a score in [0, 1]: how likely the label 1 is."""
    chosen = narrow_batches(docs).select(*carry, F.col(text_col).cast("string").alias("_text_of_row"))
    schema = chosen.drop("_text_of_row").schema.add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                values = predict(model, features(part.column(part.num_columns - 1).to_pylist())) if isinstance(model, dict) else np.full(part.num_rows, model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values)], names=[*part.schema.names[:-1], score_col])

    return chosen.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), folds: int = FOLDS, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``carry`` columns, the id, held_out (whether the id's label was left out), score and predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample, folds=folds)
    scored = score(docs, model, text_col=text_col, carry=(*(c for c in carry if c != id_col), id_col))
    return scored.withColumn("held_out", crc_mod(id_col, folds) == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
