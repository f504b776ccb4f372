"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are computed from the characters of the line and of the
lines before and after it. Forward-backward gives the marginals, whose mean weighted by line
length is mapped to the document's score. The model learns from documents labelled as a whole:
a first pass finds the lines of bad documents that look bad, and these become the line labels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import bounded_batches, held_out, map_columns, stored, table, text_of

#: Classes of characters that are counted, by ASCII code; all codes from 128 on form one more.
SYMBOLS = b"#*$%&|<>=_^~@\\+"
_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _BANG, _PUNCT, _OTHER, _WIDE = range(9)


def _classes() -> np.ndarray:
    of = np.full(129, _OTHER, np.uint8)
    of[128] = _WIDE
    of[97:123], of[65:91], of[48:58] = _LOWER, _UPPER, _DIGIT
    of[[9, 10, 11, 12, 13, 32]] = _SPACE
    of[list(SYMBOLS)] = _SYMBOL
    of[[33, 63]] = _BANG
    of[[44, 45, 46, 58, 59, 39, 34, 40, 41]] = _PUNCT
    return of


CLASSES = _classes()
NOISE = np.random.default_rng(7).integers(1, 1 << 62, 4096, dtype=np.int64)
#: Code points whose classes and signatures are held at a time: about 60 bytes each.
BLOCK = 1 << 18
OWN = ("bias", "log_words", "upper", "digit", "symbol", "bang", "punct", "wide", "repeats", "word_length", "seen")
NEAR = ("upper", "symbol", "bang", "repeats")
FEATURES = (*OWN, *[f"before_{n}" for n in NEAR], *[f"after_{n}" for n in NEAR])


@dataclass(frozen=True)
class CrfConfig:
    """The sample that the model is fitted on has at most ``sample`` labelled documents, chosen by
    hash, with at most ``lines`` lines in all; every document in it is whole. While fitting, the
    chain of a document is cut every ``segment`` lines; scoring never cuts it."""

    sample: int = 8_000
    lines: int = 400_000
    segment: int = 128
    steps: int = 150
    rate: float = 0.3
    penalty: float = 1e-4
    threshold: float = 0.3
    folds: int = 5


@dataclass(frozen=True)
class CrfModel:
    """``emission``: score of good over bad by feature; ``move[a, b]``: from state a to b;
    ``first``: score of good over bad at the first line; ``scale`` and ``shift`` map the logit
    of the weighted mean to the logit of the document's score. State 1 is good."""

    emission: np.ndarray
    move: np.ndarray
    first: float
    scale: float
    shift: float


def _blocks(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """The code points of the texts, a newline behind each, in blocks of whole lines: no more than
    ``BLOCK`` code points, unless a line has more."""
    held, size = [], 0
    for text in texts:
        at = 0
        while at <= len(text):
            if len(text) - at < BLOCK - size:
                held.append(text[at:])
                size, at = size + len(text) - at + 1, len(text) + 1
                continue
            cut = text.rfind("\n", at, at + BLOCK - size)
            if cut < 0 and not held:  # a line longer than a block
                cut = text.find("\n", at)
                cut = len(text) if cut < 0 else cut
            if cut >= 0:
                held.append(text[at:cut])
                at = cut + 1
            yield np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "replace"), np.uint32)
            held, size = [], 0
    if held:
        yield np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "replace"), np.uint32)


def _line_counts(codes: np.ndarray, before: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of each line of a block: its length, the characters of each class, words, words equal to the
    one before, and signature. ``before`` has the signature of the last word of the block before,
    or nothing; so has what is returned beside."""
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = CLASSES[np.minimum(codes, 128)]

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return (total[ends] - total[starts]).astype(np.float32)

    out = {k: per_line(kinds == k) for k in range(9)} | {"length": (ends - starts).astype(np.float32)}
    blank = kinds == _SPACE
    word_first = ~blank & np.concatenate([[True], blank[:-1]])
    # A word's signature is the sum of random values of its characters, so equal words agree.
    with np.errstate(over="ignore"):
        total = np.concatenate([[0], np.cumsum(np.where(blank, 0, NOISE[codes & 4095] + codes))])
        at = np.flatnonzero(word_first)
        signature = np.concatenate([before, total[np.concatenate([at[1:], [len(codes)]])[: len(at)]] - total[at]])
        out["sign"] = total[ends] - total[starts]
    again = np.zeros(len(codes), bool)
    again[at[len(at) - len(signature) + 1 :]] = signature[1:] == signature[:-1]
    return out | {"words": per_line(word_first), "repeats": per_line(again)}, signature[-1:]


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lengths of the lines in code points, and where
    each text begins in the list of lines (one entry more than texts). An empty text is one
    empty line. What is held for each character is held for one block of lines at a time."""
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(n_lines)])
    found, last_word = [], np.zeros(0, np.int64)
    for codes in _blocks(texts):
        counts, last_word = _line_counts(codes, last_word)
        found.append(counts)
    count = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    length, words, repeats, line_sign = (count[k] for k in ("length", "words", "repeats", "sign"))
    seen = np.zeros(len(length), np.float32)
    owner = np.repeat(np.arange(len(texts)), n_lines)
    order = np.lexsort((np.arange(len(length)), line_sign, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (line_sign[order][1:] == line_sign[order][:-1])
    seen[order[1:][same & (words[order][1:] > 0)]] = 1
    solid = np.maximum(length - count[_SPACE], 1)
    own = {
        "bias": np.ones(len(length), np.float32), "log_words": np.log1p(words) / 4, "upper": count[_UPPER] / solid,
        "digit": count[_DIGIT] / solid, "symbol": count[_SYMBOL] / solid, "bang": count[_BANG] / solid,
        "punct": count[_PUNCT] / solid, "wide": count[_WIDE] / solid, "repeats": repeats / np.maximum(words, 1),
        "word_length": np.minimum(solid / np.maximum(words, 1), 40) / 10, "seen": seen,
    }
    inner_first = np.zeros(len(length), bool)
    inner_first[begin[:-1]] = True
    columns = [own[n] for n in OWN]
    for name in NEAR:
        moved = np.concatenate([[0], own[name][:-1]])
        columns.append(np.where(inner_first, 0, moved))
    last = np.concatenate([inner_first[1:], [True]])
    for name in NEAR:
        moved = np.concatenate([own[name][1:], [0]])
        columns.append(np.where(last, 0, moved))
    return np.stack(columns, 1).astype(np.float32), length, begin


def _rows(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by falling number of lines, so that those still running are always the first."""
    n = np.diff(begin)
    order = np.argsort(-n, kind="stable")
    return order, n[order]


def marginals(model: CrfModel, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good), and the log partition function of each text."""
    good, _, log_z = _forward_backward(x @ model.emission, model.move, model.first, begin)
    return good, log_z


def _forward_backward(score: np.ndarray, move: np.ndarray, first: float | np.ndarray, begin: np.ndarray):
    """Marginals of good, summed pair marginals by (from, to), and log Z per text; all texts side
    by side, one line after the other, in scaled probabilities. ``first`` is one score or one per
    text."""
    order, n = _rows(begin)
    at, longest = begin[:-1][order], int(n[0]) if len(n) else 0
    running = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest + 1)]  # texts with more than t lines
    score = np.clip(score.astype(np.float64), -30, 30)
    emit = np.stack([np.ones_like(score), np.exp(score)], 1)
    step = np.exp(np.clip(move, -30, 30))
    alpha, beta = np.empty((len(score), 2)), np.empty((len(score), 2))
    log_z, scale = np.zeros(len(n)), np.empty(len(score))
    now = np.exp(np.clip(np.broadcast_to(first, len(n)), -30, 30))[order]
    now = np.stack([np.ones(len(n)), now], 1)
    for t in range(longest):
        k = running[t]
        i = at[:k] + t
        raw = (now[:k] if t == 0 else alpha[i - 1] @ step) * emit[i]
        c = raw.sum(1)
        alpha[i], scale[i] = raw / c[:, None], c
        log_z[:k] += np.log(c)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        k, more = running[t], running[t + 1]
        i = at[:k] + t
        beta[i[more:]] = 1.0
        if more:
            j = i[:more]
            ahead = emit[j + 1] * beta[j + 1] / scale[j + 1][:, None]
            beta[j] = ahead @ step.T
            pairs += step * (alpha[j].T @ ahead)
    good = alpha[:, 1] * beta[:, 1]
    both = good + alpha[:, 0] * beta[:, 0]
    out = np.empty(len(n))
    out[order] = log_z
    return good / both, pairs, out


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(x: np.ndarray, length: np.ndarray, begin: np.ndarray, label: np.ndarray, config: CrfConfig = CrfConfig()) -> CrfModel:
    """Fit on documents with lines ``x`` and labels 1 (good) or 0. Without both labels in the
    sample the model gives every text the smoothed share of good ones."""
    width = len(FEATURES)
    prior = (label.sum() + 1) / (len(label) + 2)
    if label.min(initial=1) == label.max(initial=0) or not len(label):
        return CrfModel(np.zeros(width), np.zeros((2, 2)), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    n = np.diff(begin)
    doc_of = np.repeat(np.arange(len(n)), n)
    share = (length + 1) / np.add.reduceat(length + 1, begin[:-1])[doc_of]  # each document weighs one

    def lines_alone(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ ((p - label[doc_of]) * share) / len(n) + config.penalty * w

    alone = _adam(lines_alone, np.zeros(width), config.steps, config.rate)
    # Lines of a bad document that look good are taken for good, but for its worst one.
    looks = x @ alone
    worst = np.zeros(len(looks), bool)
    low = np.minimum.reduceat(looks, begin[:-1])
    worst[looks <= low[doc_of]] = True
    line = np.where(label[doc_of] == 1, 1, np.where((looks > 0) & ~worst, 1, 0))
    place = np.arange(len(line)) - begin[:-1][doc_of]
    chains = np.append(np.flatnonzero(place % config.segment == 0), len(line))
    opens = (place[chains[:-1]] == 0).astype(float)  # chains that begin their document
    inner = np.ones(len(line), bool)
    inner[chains[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (line[:-1][inner[1:]], line[1:][inner[1:]]), 1)
    first_good = line[begin[:-1]].sum()

    def crf(w):
        good, pairs, _ = _forward_backward(x @ w[:width], w[width : width + 4].reshape(2, 2), w[-1] * opens, chains)
        g = np.concatenate([x.T @ (good - line), (pairs - seen).ravel(), [good[begin[:-1]].sum() - first_good]])
        return g / len(line) + config.penalty * w

    w = _adam(crf, np.concatenate([alone, np.zeros(5)]), config.steps, config.rate)
    model = CrfModel(w[:width], w[width : width + 4].reshape(2, 2), float(w[-1]), 1.0, 0.0)
    raw = _logit(document_means(model, x, length, begin))

    def scaled(v):
        p = 1 / (1 + np.exp(-np.clip(v[0] * raw + v[1], -30, 30)))
        return np.array([((p - label) * raw).mean(), (p - label).mean()]) + 1e-4 * v

    scale, shift = _adam(scaled, np.array([1.0, 0.0]), 400, 0.05)
    return CrfModel(model.emission, model.move, model.first, float(scale), float(shift))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_means(model: CrfModel, x: np.ndarray, length: np.ndarray, begin: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
    """Mean of the marginals, a line weighing its length plus one."""
    good = marginals(model, x, begin)[0] if good is None else good
    weight = length.astype(np.float64) + 1
    return np.add.reduceat(good * weight, begin[:-1]) / np.add.reduceat(weight, begin[:-1])


def score_texts(model: CrfModel, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, numbers of lines and of bad lines."""
    if not len(texts):
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, length, begin = line_features(texts)
    good, _ = marginals(model, x, begin)
    mean = document_means(model, x, length, begin, good)
    score = 1 / (1 + np.exp(-(model.scale * _logit(mean) + model.shift)))
    return score, np.diff(begin), np.add.reduceat((good < 0.5).astype(np.int64), begin[:-1])


def train(docs: DataFrame, labels: DataFrame, config: CrfConfig = CrfConfig()) -> CrfModel:
    """Fit on labelled documents outside the held-out fold (crc32 of the id, modulo ``folds``).

    Of a document labelled more than once the lower label counts; equal rows count once. Features
    are computed by the tasks from whole texts. Documents enter in the order of their hash as long
    as ``sample`` and ``lines`` hold; one with more than ``lines`` lines of its own is left out, so
    what reaches the driver is bounded.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), config.folds))
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("label"))
    # The ids are at most `sample` rows, so they may be broadcast.
    ids = F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample))
    rows = docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, length, begin = line_features(batch["text"].tolist())
            out = []
            for i, (doc, th, label) in enumerate(zip(batch["doc_id"], batch["th"], batch["label"])):
                a, b = int(begin[i]), int(begin[i + 1])
                out.append((int(doc), int(th), int(label), b - a, x[a:b].astype("<f4").tobytes(), length[a:b].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc", "th", "label", "n", "x", "length"])

    hashed = rows.select("doc_id", F.xxhash64("text").alias("th"), "text", "label")
    made = stored(hashed.mapInPandas(features, "doc long, th long, label int, n int, x binary, length binary"))
    # One row per document and text, then the first `sample` of them: few and narrow rows.
    sizes = made.groupBy("doc", "th").agg(F.min("n").alias("n")).filter(F.col("n") <= config.lines)
    first = sizes.orderBy(F.xxhash64("doc"), "doc", "th").limit(config.sample)
    running = F.sum("n").over(W.orderBy(F.xxhash64("doc"), "doc", "th"))
    chosen = first.withColumn("running", running).filter(F.col("running") <= config.lines).select("doc", "th")
    got = made.join(F.broadcast(chosen), ["doc", "th"]).dropDuplicates(["doc", "th"]).toPandas()
    got = got.sort_values(["doc", "th"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, len(FEATURES)).astype(np.float64)
    length = np.frombuffer(b"".join(got["length"]), "<f4").astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(got["n"].to_numpy(np.int64))])
    return fit(x, length, begin, got["label"].to_numpy(np.int64), config)


def score(docs: DataFrame, model: CrfModel, config: CrfConfig = CrfConfig(), names: dict[str, str] | None = None) -> DataFrame:
    """Adds ``score`` (likelihood of a good text), ``predicted`` (1 from the threshold on),
    ``n_lines`` and ``bad_lines``; ``names`` renames them, and columns so called are replaced.
    One pass, no shuffle; texts of any length are read whole. A null or empty text is one empty line
    and gets what the model says of it; equal texts get equal scores, an empty table stays empty."""
    named = lambda c: (names or {}).get(c, c)
    threshold = config.threshold

    def run(batch: pa.RecordBatch) -> tuple[None, dict[str, list]]:
        value, lines, bad = score_texts(model, [t or "" for t in batch.column("text").to_pylist()])
        made = {"score": value, "predicted": (value >= threshold).astype(np.int32), "n_lines": lines, "bad_lines": bad}
        return None, {named(c): v for c, v in made.items()}

    return map_columns(docs, run, {named(c): t for c, t in {"score": "double", "predicted": "int", "n_lines": "long", "bad_lines": "long"}.items()})


def op2_quality_crf(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 8)
    config = CrfConfig()
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), config)
    rows = score(docs.select("doc_id", "text"), model, config)
    return rows.select("doc_id", held_out(F.col("doc_id"), config.folds).alias("held_out"), "score", "predicted", "n_lines", "bad_lines")


QUERIES = {"op2_quality_crf": op2_quality_crf}
ORACLES: dict[str, str] = {}
