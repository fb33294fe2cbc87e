"""Quality classifier: document evidence combined with host and path posteriors.

Two logistic heads (low quality, toxic) are trained on labelled documents from the shape of the
text and from naive Bayes sums over its words. Their evidence is a log Bayes factor. How often
documents of a host, and of a path on it, are bad is estimated by hierarchical empirical Bayes:
grouped sums of the documents' probabilities, path rates shrunk to their host's and host rates
to the global one by Beta priors whose strengths are fitted by moments. The path's rate without
the document itself is the document's prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import checkpoint, lookup, saved, text_buffers, text_slices

#: Labelled documents that are learned from, chosen by a hash of their ids.
MOST_LABELLED = 8_000
DIMS = 1 << 18
#: Words in fewer labelled documents, or with less evidence of a bad one (log of how much
#: likelier they are there), count for nothing: what is left is hardly ever there by chance.
#: Where few documents are labelled as bad, a quarter of their number is asked for, three at least.
LEAST_DOCUMENTS = (3, 8)
LEAST_EVIDENCE = 3.0
REJECT = 0.5
HEADS = ("low", "toxic")


@dataclass(frozen=True)
class Model:
    """Word evidence (head, dimension), shape means and deviations, weights (head, feature), base log-odds."""

    words: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    base: np.ndarray


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape features of each text, and the distinct hashed words with the text of each."""
    n = len(offsets) - 1
    starts, ends, rows = hashing.word_bounds(data, offsets)
    plain = hashing.word_hashes(data, starts, ends, lower=True)
    words = np.maximum(np.bincount(rows, minlength=n), 1)
    size = np.maximum(np.diff(offsets), 1)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = ~hashing.NOT_LETTERS[data]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ~(letter | digit | blank) & (data != 46) & (data != 44)
    again = np.zeros(len(rows), bool)
    again[1:] = (plain[1:] == plain[:-1]) & (rows[1:] == rows[:-1])
    lone = (ends - starts == 1) & ~letter[starts] if len(starts) else again
    l_starts, l_ends, l_rows = hashing.word_bounds(data, offsets, hashing.NOT_LETTERS)
    dims = (hashing.word_hashes(data, l_starts, l_ends, lower=True) >> np.uint64(46)).astype(np.int64)
    pairs = np.unique(l_rows * DIMS + dims)
    distinct = np.bincount(pairs // DIMS, minlength=n)
    per_word = lambda of: np.bincount(rows[of], minlength=n) / words
    features = np.column_stack(
        [np.sqrt(share(symbol)), np.sqrt(share(upper)), np.sqrt(share(digit)), np.sqrt(share(data == 33)),
         np.sqrt(per_word(again)), np.sqrt(per_word(lone)), np.log(words), size / words / 10,
         np.log((distinct + 1) / (words + 1))]
    )
    return features, pairs % DIMS, pairs // DIMS


def _standardised(features: np.ndarray, mean: np.ndarray, deviation: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Standardised features, then for each head the most telling words' evidence, then one."""
    z = np.clip((features - mean) / deviation, -6, 6)
    return np.column_stack([z, z[:, :6] ** 2 / 4, np.clip(sums, -25, 25) / 5, np.ones(len(features))])


def _inputs(model: Model, features: np.ndarray, dims: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sums = np.column_stack([np.bincount(rows, w[dims], minlength=len(features)) for w in model.words])
    return _standardised(features, model.mean, model.deviation, sums)


def evidence(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text and head the log Bayes factor of being bad."""
    return np.clip(_inputs(model, *shapes(data, offsets)) @ model.weights.T - model.base, -20, 20)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton steps; the last input, the constant, isn't shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """A model from at most ``most`` labelled documents; None if a class has no example."""
    known = (
        labels.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 0).cast("int").alias("low"),
            (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 1).cast("int").alias("toxic"),
        )
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(known), "doc_id"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            features, dims, owner = shapes(*text_buffers(batch.column("text")))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "fold": pa.array([int(hashing.mix(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(2)) for i in batch.column("doc_id").to_pylist()], pa.int32()),
                    "low": batch.column("low"),
                    "toxic": batch.column("toxic"),
                    "x": pa.array(list(features), pa.list_(pa.float64())),
                    "dims": pa.array([dims[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32())),
                }
            )

    read_rows = checkpoint(rows.mapInArrow(read, "fold int, low int, toxic int, x array<double>, dims array<int>"))
    # word counts of both folds, at most DIMS rows each
    counts = (
        read_rows.select("fold", "low", "toxic", F.explode("dims").alias("dim"))
        .groupBy("fold", "dim")
        .agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
        .withColumn("both", F.sum("n").over(Window.partitionBy("dim")))
        .where(F.col("both") >= LEAST_DOCUMENTS[0])  # rarer words count for nothing
        .drop("both")
        .toArrow().to_pandas()
    )
    totals = read_rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).toArrow().to_pandas()
    if len(totals) < 2 or (totals[list(HEADS)].min() == 0).any() or (totals["n"] - totals["low"]).min() == 0 or (totals["n"] - totals["toxic"]).min() == 0:
        return None

    def words(folds: list[int]) -> np.ndarray:
        own, whole = counts[counts["fold"].isin(folds)], totals[totals["fold"].isin(folds)]
        n, out = np.bincount(own["dim"], own["n"], DIMS), np.zeros((len(HEADS), DIMS), np.float32)
        for i, head in enumerate(HEADS):
            bad, every = np.bincount(own["dim"], own[head], DIMS), float(whole["n"].sum())
            with_bad = (bad + 0.5) / (float(whole[head].sum()) + 1)
            with_good = (n - bad + 0.5) / (every - float(whole[head].sum()) + 1)
            ratio = np.log(with_bad / with_good)
            least = np.clip(float(whole[head].sum()) / 4, *LEAST_DOCUMENTS)
            out[i] = np.where((n >= least) & (ratio >= LEAST_EVIDENCE), ratio, 0)
        return out

    # a document's words are weighed by the other fold's counts, in tasks: what comes back is a
    # row of a few numbers for each of at most ``most`` documents
    shared = docs.sparkSession.sparkContext.broadcast([words([1]), words([0])])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                [float(w[np.asarray(d, np.int64)].sum()) for w in shared.value[fold]]
                for fold, d in zip(batch.column("fold").to_pylist(), batch.column("dims").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*HEADS, "x")], pa.array(sums, pa.list_(pa.float64()))], names=[*HEADS, "x", "sums"]
            )

    sample = read_rows.mapInArrow(weigh, "low int, toxic int, x array<double>, sums array<double>").toArrow().to_pandas()
    shared.destroy()
    x, sums = np.stack(sample["x"].to_numpy()), np.stack(sample["sums"].to_numpy())
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    inputs = _standardised(x, mean, deviation, sums)
    weights, base = [], []
    for head in HEADS:
        y = sample[head].to_numpy(float)
        weights.append(fit_logistic(inputs, y))
        base.append(np.log(y.mean() / (1 - y.mean())))
    return Model(words([0, 1]), mean, deviation, np.array(weights), np.array(base))


def site(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document: of its url, else its source and language."""
    if "url" in docs.columns:
        url = F.lower(F.col("url").cast("string"))
        host = F.regexp_extract(url, r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)
        return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)", 1), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return text("source"), text("lang")


def strength(groups: DataFrame, rate: float) -> float:
    """How many documents the Beta prior of a group's rate is worth, by moments.

    ``groups`` has ``n``, ``bad`` and ``center``, the rate that each is shrunk to.
    """
    gap = F.col("bad") / F.col("n") - F.col("center")
    m = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * gap * gap).alias("q"),
    ).first()
    within = max(rate * (1 - rate), 1e-9)
    free = float(m["n"] or 0) - float(m["n2"] or 0) / max(float(m["n"] or 0), 1.0)
    between = (float(m["q"] or 0) - (m["k"] - 1) * within) / free if free > 0 else 0.0
    return float(np.clip(within / between - 1, 1.0, 1e6)) if between > 0 else 1e6


def posteriors(scored: DataFrame) -> DataFrame:
    """``_host, _path, n, bad, prior, weight``: sums over each path, and what its rate is shrunk to.

    ``scored`` has ``_host, _path, _bad``. All sums are grouped with partial sums, so a host with
    a third of all rows costs a row per task.
    """
    paths = checkpoint(scored.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.sum("_bad").alias("bad")))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = float(np.clip((whole["bad"] or 0.0) / max(whole["n"] or 0.0, 1.0), 1e-4, 1 - 1e-4))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("center", F.lit(rate))
    k = strength(hosts, rate)
    hosts = hosts.select("_host", ((F.col("bad") + k * rate) / (F.col("n") + k)).alias("prior"))
    joined = paths.join(hosts, "_host")
    w = strength(joined.withColumn("center", F.col("prior")), rate)
    return joined.withColumn("weight", F.lit(w))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, _version, _host, _path, _low, _toxic``: the row (id and hash of its text), site and log Bayes factors."""
    host, path = site(docs)
    rows = docs.select("doc_id", version().alias("_version"), host.alias("_host"), path.alias("_path"), F.col("text").cast("string").alias("_text"))
    if model is None:
        return rows.drop("_text").withColumns({"_low": F.lit(0.0), "_toxic": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "_text"):
            factor = evidence(shared.value, *text_buffers(batch.column("_text")))
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(factor[:, 0]), pa.array(factor[:, 1])], names=[*names, "_low", "_toxic"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(weigh, f"{kept}, _low double, _toxic double")


def version() -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def judge(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``doc_id, _version`` (see :func:`version`) with ``p_low, p_toxic, site_rate, p_bad, rejected``, a row for each.

    See :func:`classify`. Each text is read and scored once; what is kept of it are two numbers.
    """
    model = train(docs, labels)
    base = model.base if model is not None else np.array([-20.0, -20.0])
    low, toxic = _chance(F.col("_low") + float(base[0])), _chance(F.col("_toxic") + float(base[1]))
    site_key = [F.xxhash64("_host", "_path").alias("_s1"), F.xxhash64(F.lit(1), "_path", "_host").alias("_s2")]
    scored = saved(score(docs, model).withColumn("_bad", 1 - (1 - low) * (1 - toxic)))
    sites = posteriors(scored.select("_host", "_path", "_bad"))
    table = sites.select(*site_key, F.col("n").alias("_n"), F.col("bad").alias("_s"), F.col("prior").alias("_prior"), F.col("weight").alias("_weight"))
    bad = F.col("_bad")
    site_rate = (F.greatest(F.col("_s") - bad, F.lit(0.0)) + F.col("_weight") * F.col("_prior")) / (F.col("_n") - 1 + F.col("_weight"))
    overall = float(1 - np.prod(1 / (1 + np.exp(base))))
    shift = F.log(F.col("site_rate") / (1 - F.col("site_rate"))) - float(np.log(overall / (1 - overall)))
    certain = F.least(F.greatest(bad, F.lit(1e-9)), F.lit(1 - 1e-9))
    return (
        scored.select("*", *site_key)
        .join(lookup(table), ["_s1", "_s2"])
        .withColumns({"p_low": low, "p_toxic": toxic, "site_rate": F.least(F.greatest(site_rate, F.lit(1e-6)), F.lit(1 - 1e-6))})
        .withColumn("p_bad", _chance(F.log(certain / (1 - certain)) + shift))
        .withColumn("rejected", F.col("p_bad") > reject)
        .select("doc_id", "_version", *MADE)
    )


MADE = ("p_low", "p_toxic", "site_rate", "p_bad", "rejected")


def classify(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, reject: float = REJECT) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all) with ``p_low, p_toxic, site_rate, p_bad, rejected``.

    ``docs`` needs ``doc_id, text`` and may have ``url``, or ``source`` and ``lang``; ``labels``
    needs ``doc_id, quality, toxic``. ``p_low`` and ``p_toxic`` are the document classifier's
    own, ``site_rate`` is the shrunk share of bad documents among the path's others, ``p_bad``
    combines them and ``rejected`` says that it is over ``reject``. Columns of these names are
    replaced. A null text counts as empty, a null host or path as "". A label repeated for an id
    counts once, as bad if any is. If a class has no labelled document in either half of the
    sample, nothing is rejected. Repeated rows each count and each get a row; those of one id
    and text that stand on different sites get the verdict of the least bad.
    """
    names = [c for c in (carry if carry is not None else docs.columns) if c not in MADE]
    judged = judge(docs, labels, reject)
    if names == ["doc_id"]:
        return judged.select("doc_id", *MADE)
    one = judged.groupBy(F.col("doc_id").alias("_id"), F.col("_version").alias("_v")).agg(
        F.min(F.struct("p_bad", *[c for c in MADE if c != "p_bad"])).alias("_of")
    )
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col("doc_id").alias("_doc"), version().alias("_version"))
    return rows.join(one, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_v"))).select(
        *[F.col(f"`{c}`") for c in names], *[F.col(f"_of.{c}").alias(c) for c in MADE]
    )


def without_bad(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``docs`` without rejected documents, with its own columns; see :func:`classify`.

    Only ids and hashes of rejected rows are joined, so texts don't move if those are few.
    """
    judged = judge(docs, labels, reject).groupBy("doc_id", "_version").agg(F.min("rejected").alias("rejected"))
    bad = checkpoint(judged.where("rejected").select(F.col("doc_id").alias("_bad_id"), F.col("_version").alias("_bad_version")))
    return docs.join(lookup(bad), F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (version() == F.col("_bad_version")), "left_anti")
