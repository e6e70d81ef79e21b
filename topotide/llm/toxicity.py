"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained with numpy from confirmed
toxic texts and unlabelled texts.  The risk is corrected by the class prior;
where the estimated risk of the negatives falls below zero, the step goes
against it, as in the non-negative estimator.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topotide.llm.caches import hold, tidied
from topotide.llm.tables import plainly_named, table, text_of
from topotide.plans.scratch import written

#: Hashed word features.
DIM = 1 << 18
#: Bounds of the training sample of labelled rows, those with the smallest hash of doc_id.
POSITIVES = 6000
UNLABELLED = 18000
FOLDS = 5
#: Class prior when there are no labelled rows to count.
DEFAULT_PRIOR = 0.1
#: Lengths of the beginnings of words that are features besides the words.
PREFIXES = (5, 7)
#: Standard errors by which a feature must favour the positives.
EVIDENCE = 3.0
#: Words that a worker remembers.
CACHE_WORDS = 100_000
_word_ids: dict[bytes, tuple[int, ...]] = {}


#: ASCII characters other than letters and digits become spaces.
_MARKS = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def distinct_words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split())


def _forget() -> None:
    _word_ids.clear()
    _models.clear()


def features_of(word: bytes) -> tuple[int, ...]:
    """The hashed features of a word: itself and its beginnings."""
    letters = word.decode("utf-8", "surrogatepass")
    named = [word, *[("^" + letters[:n]).encode("utf-8", "surrogatepass") for n in PREFIXES if len(letters) >= n]]
    return tuple(xxhash.xxh32_intdigest(x) % DIM for x in named)


def word_ids(text: str) -> np.ndarray:
    """The distinct hashed features of a text: its words in lower case, and their beginnings."""
    got: set[int] = set()
    for w in distinct_words(text):
        known = _word_ids.get(w)
        if known is None:
            if len(_word_ids) > CACHE_WORDS:
                _word_ids.clear()
            known = _word_ids[w] = features_of(w)
        got.update(known)
    return np.array(sorted(got), np.int64)


class Model:
    """score = logistic(bias + sum of the weights of a text's distinct features)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._active: dict[bytes, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        """The score of a whole text; words without weight are remembered as such."""
        known, got = self._active, set()
        for w in distinct_words(text):
            ids = known.get(w)
            if ids is None:
                if len(known) > CACHE_WORDS:
                    known.clear()
                ids = known[w] = tuple(i for i in features_of(w) if self.weights[i])
            if ids:
                got.update(ids)
        margin = self.bias + float(sum(self.weights[i] for i in sorted(got)))
        return 1.0 / (1.0 + float(np.exp(-min(60.0, max(-60.0, margin)))))


_models: dict[str, Model] = {}


def shared_model(key: str, weights: np.ndarray, bias: float) -> Model:
    """The worker's copy of a model, kept from task to task."""
    hold("toxicity", _forget)
    if key not in _models:
        _forget()
        _models[key] = Model(weights, bias)
    return _models[key]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def evidence(c_p: np.ndarray, c_u: np.ndarray, n_p: int, n_u: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of features between n_p positives and n_u unlabelled texts, from the texts that have them, and which features count.

    A feature counts if two positives have it and its odds favour them by
    EVIDENCE standard errors.
    """
    odds = np.log((c_p + 0.5) / (n_p + 1)) - np.log((c_u + 0.5) / (n_u + 1))
    error = np.sqrt(1 / (c_p + 0.5) + 1 / (c_u + 0.5))
    return odds, (c_p >= 2) & (odds > EVIDENCE * error)


def risk(own: tuple[np.ndarray, np.ndarray], flat: tuple[np.ndarray, np.ndarray], n: tuple[int, int], prior: float, w: np.ndarray, bias: float) -> tuple[float, float, np.ndarray, float]:
    """(risk of the positives, risk of the negatives, gradient by weight, gradient by bias) of the non-negative estimator.

    own and flat hold the row and the weight's place of each feature, for
    positives and unlabelled texts.  Where the risk of the negatives is below
    zero, the gradient is that of its negative, to lead back.
    """
    (own_p, own_u), (flat_p, flat_u), (n_p, n_u) = own, flat, n
    g_p = bias + np.bincount(own_p, w[flat_p], n_p)
    g_u = bias + np.bincount(own_u, w[flat_u], n_u)
    s_p, s_u = _sigmoid(g_p), _sigmoid(g_u)
    negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    d_p, d_u = -prior * s_p / n_p, s_u / n_u
    if negative >= 0:
        d_p = d_p - prior * (1 - s_p) / n_p
    else:
        d_p, d_u = -d_p, -d_u
    grad = np.bincount(flat_p, d_p[own_p], len(w)) + np.bincount(flat_u, d_u[own_u], len(w))
    return prior * float(np.logaddexp(0, -g_p).mean()), float(negative), grad, float(d_p.sum() + d_u.sum())


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], odds: np.ndarray, prior: float, epochs: int = 120, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Fit (weights, bias) by the non-negative risk pi*R_p(+) + max(0, R_u(-) - pi*R_p(-)).

    Rows are places of weights.  Losses are logistic.  Weights start from
    ``odds``, and gradient steps (Adam) change them from there.
    """
    own = tuple(np.repeat(np.arange(len(rows)), [len(r) for r in rows]) for rows in (positives, unlabelled))
    flat = tuple(np.concatenate(rows) if rows else np.zeros(0, np.int64) for rows in (positives, unlabelled))
    size, w, bias = (len(positives), len(unlabelled)), odds.astype(float), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for epoch in range(1, epochs + 1):
        _, _, grad, grad_b = risk(own, flat, size, prior, w, bias)
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
        f1, f2 = 1 - 0.9**epoch, 1 - 0.999**epoch
        w = w - rate * (m / f1) / (np.sqrt(v / f2) + 1e-8)
        bias -= rate * (mb / f1) / (np.sqrt(vb / f2) + 1e-8)
    return w, float(bias)


def _in_training() -> Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(FOLDS)) != 0


def feature_counts(docs: DataFrame) -> DataFrame:
    """(id, n): the number of texts of ``docs`` that have each feature; id -1 counts the texts.

    Every task adds up its own rows, so at most DIM + 1 rows leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", _forget)
        counts, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for t in batch.column(0):
                counts[word_ids(t.as_py())] += 1
        ids = np.flatnonzero(counts)
        columns = [np.append(ids, -1), np.append(counts[ids], rows)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["id", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on the rows of ``docs`` whose crc32(doc_id) mod 5 isn't 0.

    How many texts have a feature is counted over all these rows.  The risk is
    fitted on a bounded sample of labelled rows, those with the smallest
    hashes of doc_id: at most ``positives`` of those labelled toxic, and at
    most ``unlabelled`` of all labelled rows, whose labels are hidden.  The
    class prior is the share of toxic labels among labelled rows.  Only
    features with evidence reach the driver: the texts' features are cut down
    to them in the tasks.  Without labels, or without features that count,
    the score is the prior.
    """
    train_docs = docs.where("doc_id is not null").where(_in_training())
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("k")).agg(F.max("toxic").alias("toxic"))
    marked = train_docs.select("doc_id", F.xxhash64("doc_id").alias("h")).join(marks, F.col("doc_id") == F.col("k")).select("k", "h", "toxic")
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    prior = min(0.5, max(1e-3, (counts["p"] or 0) / counts["n"])) if counts["n"] else DEFAULT_PRIOR
    nothing = Model(np.zeros(DIM), float(np.log(prior / (1 - prior))))
    if not counts["p"]:
        return nothing
    pos = marked.where("toxic = 1").orderBy("h", "k").limit(positives).select("k", F.lit(1).alias("pos"))
    unl = marked.orderBy("h", "k").limit(unlabelled).select("k", F.lit(0).alias("pos"))
    picked = written(pos.unionByName(unl).distinct(), "picked")  # at most positives + unlabelled rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", _forget)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [word_ids(t.as_py()).astype("<i4") for t in batch.column(2)[at : at + 256]]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], batch.column(1)[at : at + 256], lists], ["doc_id", "pos", "ids"])

    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("k")).select("doc_id", "pos", "text")
    sample = written(texts.mapInArrow(tidied(features), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, pos int, ids array<int>"), "features")
    everywhere = written(feature_counts(train_docs), "counts")  # at most DIM + 1 rows
    hot = sample.where("pos = 1").select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("p")).where("p > 1")
    n_p = sample.where("pos = 1").count()
    n_u = everywhere.where("id = -1").first()["n"]
    both = hot.join(everywhere, "id").select("id", "p", "n").toPandas().sort_values("id")  # at most DIM rows of three numbers
    odds, useful = evidence(both["p"].to_numpy(float), both["n"].to_numpy(float), n_p, n_u)
    chosen = both["id"].to_numpy(np.int64)[useful]
    if not len(chosen):
        return nothing
    kept = np.zeros(DIM, bool)
    kept[chosen] = True
    place = (np.cumsum(kept) - 1).astype("<i4")

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [place[x[kept[x]]].tobytes() for x in (r.values.to_numpy() for r in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "pos", "places"])

    # the limit holds where a doc_id repeats, too
    rows = sample.mapInArrow(tidied(slim), sample.schema["doc_id"].dataType.simpleString().join(("doc_id ", ", pos int, places binary"))).orderBy("doc_id", "pos", "places").limit(positives + unlabelled).collect()
    groups = [[np.frombuffer(r["places"], "<i4") for r in rows if r["pos"] == p] for p in (1, 0)]
    if not groups[0] or not groups[1]:
        return nothing
    weights = np.zeros(DIM)
    weights[chosen], bias = train(*groups, odds[useful], prior)
    return Model(weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.weights.astype(np.float32), model.bias))  # DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_model(*shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    slim = docs.select("doc_id", text_of().alias("text"))
    return slim.mapInArrow(tidied(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    Null texts score as empty ones do: by the bias alone.  A null doc_id is
    never in training, and its held_out is null.  Without labels every score
    is the prior.  Rows of ``labels`` with a null are left out, and of repeated
    ones the highest counts; equal texts have equal scores, repeated rows come
    as often as they are, and very long texts are scored whole.  An empty table
    gives no rows.  Other columns are not read, whatever their names.
    """
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (~_in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic, scored in place and not joined.

    Nulls, repeated rows, long texts and empty tables are as in ``toxicity``.
    The columns of ``docs`` return unchanged, whatever their names.
    """
    names, docs = docs.columns, plainly_named(docs, "doc_id", "text")
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.weights.astype(np.float32), model.bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_model(*shared.value)
        for batch in batches:
            keep = [own.score(t.as_py() or "") < 0.5 for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema).toDF(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
