"""Document quality by a linear-chain conditional random field over lines.

Every line gets a label, bad or good. Its features are measures of the line
and of the lines next to it; neighbouring labels are tied by a transition
table. Only documents are labelled, so training alternates: it maximises the
conditional likelihood of the line labels by gradient steps, then gives each
line the label that is likelier, as far as good lines stay the larger part of
good documents, by length, and bad lines that of bad ones. At first all lines
have their document's label, and nothing ties neighbours. It sees a bounded, documented sample of labelled
documents (``sample`` rows, ``max_lines`` lines); only line features of those
reach the driver. For scoring, forward-backward gives each line's probability
of being good; a document's is their mean weighted by length, and two more
fitted numbers turn it into a score.

Null and empty texts have one empty line. Without labels of both kinds every
score is 0.5. Of several labels of an id the least holds; labels other than 0
and 1 and null ids teach nothing; rows that repeat whole teach once. Texts are
scored whole, whatever their length, one at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import add_by_text, pick

#: Classes of code points below 0x250: 0 other letters, 1 white space, 2 upper case, 3 digits, 4 sentence marks, 5 exclamation and question marks, 6 symbols, 7 bars.
CLASSES = np.zeros(0x250, np.uint8)
for _i in range(0x250):
    _c = chr(_i)
    CLASSES[_i] = 1 if _c.isspace() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:'\"()-" else 5 if _c in "!?" else 7 if _c == "|" else 0 if _c.isalnum() else 6
MEASURES = 13


def line_measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The measures of each line (lines x ``MEASURES``) and the lines' lengths."""
    lines = text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = np.where(points < 0x250, CLASSES[np.minimum(points, 0x24F)], 0)
    of = np.cumsum(points == 10)
    counts = np.bincount(of * 8 + kind if len(points) else np.zeros(0, np.int64), minlength=8 * len(lines)).reshape(-1, 8).astype(np.float64)
    length = counts.sum(axis=1)
    counts[1:, 1] -= 1  # the line break before a line is no part of it
    length[1:] -= 1
    size = np.maximum(length, 1)
    out = np.empty((len(lines), MEASURES))
    out[:, 0] = 1
    out[:, 1] = np.log1p(length) / 5
    out[:, 2:9] = np.sqrt(counts[:, 1:8] / size[:, None])
    for i, line in enumerate(lines):
        w = line.split()
        n = len(w)
        if n > 1:
            out[i, 9] = sum(map(str.__eq__, w, w[1:])) / n
            out[i, 10] = len(set(w)) / n
            out[i, 11] = min(1.0, (length[i] - counts[i, 1]) / n / 12)
        else:
            out[i, 9:12] = 0, 1, min(1.0, length[i] / 12)
        out[i, 12] = min(n, 20) / 20
    return out, length


def features(measures: np.ndarray) -> np.ndarray:
    """Measures of the line before, the line, and the line after."""
    edge = np.zeros((1, MEASURES))
    return np.hstack((np.vstack((edge, measures[:-1])), measures, np.vstack((measures[1:], edge))))


def marginals(unary: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Probability that each line is good. ``unary``: log-odds for good; ``ties``: 2 x 2 scores of neighbouring labels."""
    e = np.exp(ties - ties.max())
    (a, b), (c, d) = e.tolist()
    up = (1 / (1 + np.exp(-np.clip(unary, -30, 30)))).tolist()
    n = len(up)
    fore, good = [0.0] * n, 0.0
    for i, p in enumerate(up):
        if i:
            bad, fine = (1 - good) * a + good * c, (1 - good) * b + good * d
            p = p * fine / (p * fine + (1 - p) * bad)
        fore[i] = good = p
    back, out = 0.5, [0.0] * n
    for i in range(n - 1, -1, -1):
        p = fore[i] * back / (fore[i] * back + (1 - fore[i]) * (1 - back))
        out[i] = p
        q = up[i] * back / (up[i] * back + (1 - up[i]) * (1 - back))
        bad, fine = a * (1 - q) + b * q, c * (1 - q) + d * q
        back = fine / (bad + fine)
    return np.array(out)


def fit_chain(docs: list[np.ndarray], labels: list[np.ndarray], weight: np.ndarray, tied: bool = True, steps: int = 150, rate: float = 0.15, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ties by gradient ascent (Adam) on the conditional likelihood of the lines' labels, all documents line by line side by side."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    docs, labels, weight = [docs[i] for i in order], [labels[i] for i in order], weight[order]
    depth = len(docs[0])
    live = [sum(len(d) > i for d in docs) for i in range(depth)]  # the longest come first
    x = [np.stack([docs[j][i] for j in range(live[i])]) for i in range(depth)]
    y = [np.array([labels[j][i] for j in range(live[i])]) for i in range(depth)]
    weight = weight / np.array([len(d) for d in docs])
    w, ties = np.zeros(docs[0].shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        u = [np.stack((np.zeros(live[i]), x[i] @ w), axis=1) for i in range(depth)]
        fore = [u[0]]
        for i in range(1, depth):
            fore.append(u[i] + np.logaddexp(fore[-1][: live[i], :1] + ties[:1], fore[-1][: live[i], 1:] + ties[1:]))
        back = [np.zeros((live[i], 2)) for i in range(depth)]
        for i in range(depth - 2, -1, -1):
            nxt = u[i + 1] + back[i + 1]
            back[i][: live[i + 1]] = np.logaddexp(ties[:, 0] + nxt[:, :1], ties[:, 1] + nxt[:, 1:])
        norm = np.logaddexp(*(fore[0] + back[0]).T)
        g, gt = np.zeros(len(w)), np.zeros((2, 2))
        for i in range(depth):
            k = live[i]
            good = np.exp(fore[i][:, 1] + back[i][:, 1] - norm[:k])
            g += ((y[i] - good) * weight[:k]) @ x[i]
            if i:
                joint = np.exp(fore[i - 1][:k, :, None] + ties[None] + (u[i] + back[i])[:, None, :] - norm[:k, None, None])
                seen = np.zeros_like(joint)
                seen[np.arange(k), y[i - 1][:k], y[i]] = 1
                gt += ((seen - joint) * weight[:k, None, None]).sum(axis=0)
        grad = np.concatenate((g - ridge * w, (gt - ridge * ties).ravel() * tied))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, ties = w + move[:-4], ties + move[-4:].reshape(2, 2)
    return w, ties


def relabel(good: np.ndarray, length: np.ndarray, label: int) -> np.ndarray:
    """Line labels by their probabilities, such that lines of the document's own label are at least half of its length."""
    right = good if label == 1 else 1 - good
    order = np.argsort(-right, kind="stable")
    size = np.cumsum((length + 1e-3)[order])
    forced = np.zeros(len(good), bool)
    forced[order[: int(np.searchsorted(size, size[-1] / 2)) + 1]] = True
    return np.where(forced | (right >= 0.5), label, 1 - label)


def document_mean(x: np.ndarray, length: np.ndarray, w: np.ndarray, ties: np.ndarray) -> float:
    good = marginals(features(x) @ w, ties)
    weight = length + 1e-3
    return float(good @ weight / weight.sum())


def fit(docs: DataFrame, labels: DataFrame, admitted: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 2000, max_lines: int = 200_000, rounds: int = 3):
    """A model (weights, ties, slope, offset), or None without labels of both kinds.

    ``admitted`` filters the rows of ``labels``; of these the ``sample`` of
    least hash of the id are learned from, with their documents' whole texts,
    in this order as far as all their lines stay within ``max_lines``
    (documents that would pass it are left out).
    """
    rows = pick(labels.filter(admitted), [key, label]).toDF("k", "y").filter("y in (0, 1) and k is not null")
    chosen = rows.groupBy("k").agg(F.min("y").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    joined = pick(docs, [key, text]).toDF("k", "t").withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), "k")
    lines = F.size(F.split(F.coalesce("t", F.lit("")), "\n"))
    taken, left = [], max_lines
    for r in joined.select("k", "h", lines.alias("n")).distinct().orderBy(F.xxhash64("k"), "k", "h").limit(sample).collect():
        if r["n"] <= left:
            taken.append((r["k"], r["h"]))
            left -= r["n"]
    if not taken:
        return None
    sent = docs.sparkSession.createDataFrame(taken, StructType([StructField("k", joined.schema["k"].dataType), StructField("h", LongType())]))
    texts = joined.join(F.broadcast(sent), ["k", "h"]).dropDuplicates(["k", "h"]).select("k", "t", "y")

    def make():
        def of(texts):
            made = [line_measures(t) for t in texts]
            return [[x.ravel().tolist() for x, _ in made], [n.tolist() for _, n in made]]

        return of

    got = add_by_text(texts, make, "x array<float>, n array<float>", "t", ["k", "y"]).toPandas().sort_values("k", kind="stable")
    y = got["y"].to_numpy().astype(np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return None
    xs = [np.asarray(x, np.float64).reshape(-1, MEASURES) for x in got["x"]]
    sizes = [np.asarray(n, np.float64) for n in got["n"]]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())  # each label weighs alike, each document too
    made = [features(x) for x in xs]
    of_lines = [np.full(len(x), label) for x, label in zip(xs, y, strict=True)]
    for i in range(rounds):
        # The first labels never change within a document: what that says of neighbours isn't learned.
        w, ties = fit_chain(made, of_lines, weight, tied=i > 0)
        of_lines = [relabel(marginals(x @ w, ties), n, label) for x, n, label in zip(made, sizes, y.tolist(), strict=True)]
    means = np.array([document_mean(x, n, w, ties) for x, n in zip(xs, sizes, strict=True)])
    slope, offset = 4.0, -2.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(slope * means + offset)))
        d = (y - p) * weight
        slope, offset = slope + 5.0 * (d @ means) - 1e-4 * slope, offset + 5.0 * d.sum() - 1e-4 * offset
    return w, ties, float(slope), float(offset)


def score(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, then score (0 to 1) and bad_lines (numbers, from 0, of lines more likely bad)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def of(texts: list[str]) -> list:
            if model is None:
                return [[0.5] * len(texts), [[]] * len(texts)]
            w, ties, slope, offset = model
            scores, bad = [], []
            for t in texts:
                x, length = line_measures(t)
                good = marginals(features(x) @ w, ties)
                weight = length + 1e-3
                scores.append(float(1 / (1 + np.exp(-(slope * (good @ weight / weight.sum()) + offset)))))
                bad.append(np.flatnonzero(good < 0.5).tolist())
            return [scores, bad]

        return of

    return add_by_text(docs, make, "score double, bad_lines array<int>", text, keep)
