"""Quality classifier as a sparse rule ensemble.

Statistics of the text are Spark columns. Small trees are grown on a bounded sample of labelled rows; every path from a root to a node is
a conjunctive rule; weights for the rules are fitted by lasso logistic regression, which leaves most at 0; the remaining rules are
compiled to one Spark column, so scoring is a scan without joins or Python.

Null and empty texts have all statistics 0 and get a score like any other. Texts are read whole. Rows whose doc_id is null count as not held
out. Labels that are null or name no document are ignored; without any label, or with one class only, the score is a constant. Repeated rows
get equal scores. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.shared import bounded_sample, free_name, n_words

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column, all of them ratios or counts of the whole text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = n_words(t)
    chars = F.greatest(n, F.lit(1)).cast("double")
    per_word = F.greatest(words, F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(t, pattern, ""))) / chars

    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return {
        "words": words.cast("double"),
        "word_chars": n / per_word,
        "upper": share(r"\p{Lu}+"),
        "letters": letters / chars,
        "digits": share(r"[0-9]+"),
        "marks": share(r"[*#$%&|!<>{}\[\]\\~^_=+@/]+"),
        "stops": F.regexp_count(t, F.lit(r"[.!?](?=\s|$)")) / per_word,
        "repeats": F.regexp_count(t, F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")) / per_word,
        "lines": F.regexp_count(t, F.lit("\n")) / per_word,
    }


@dataclass(frozen=True)
class Rules:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]  # ((statistic, above, cut), ...), weight

    def used(self) -> set[str]:
        return {s for p, _ in self.rules for s, _, _ in p}

    def column(self, names: dict[str, str]) -> Column:
        """The score, from columns that hold the statistics; names says which."""

        def holds(path) -> Column:
            return reduce(lambda a, b: a & b, [(F.col(names[s]) > cut) if above else (F.col(names[s]) <= cut) for s, above, cut in path])

        z = reduce(lambda a, b: a + b, [F.when(holds(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _paths(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: tuple, depth: int, least: int) -> list[tuple]:
    """Paths to the nodes of one least-squares tree grown greedily on these rows."""
    best = None
    total, n = residual[rows].sum(), len(rows)
    for j, own in enumerate(cuts):
        if not len(own):
            continue
        at = np.searchsorted(own, x[rows, j], side="left")
        count = np.cumsum(np.bincount(at, minlength=len(own) + 1))[:-1]
        left = np.cumsum(np.bincount(at, weights=residual[rows], minlength=len(own) + 1))[:-1]
        fine = (count >= least) & (n - count >= least)
        gain = np.where(fine, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -1.0)
        k = int(gain.argmax())
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            best = (gain[k], j, float(own[k]))
    if best is None or best[0] <= total**2 / n * (1 + 1e-9) + 1e-9:
        return []
    _, j, cut = best
    low = x[rows, j] <= cut
    out = []
    for side, above in ((rows[low], False), (rows[~low], True)):
        longer = (*path, (j, above, cut))
        out.append(longer)
        if depth > 1:
            out += _paths(x, residual, cuts, side, longer, depth - 1, least)
    return out


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3, seed: int = 7) -> Rules:
    """Rules from trees grown on random halves of the rows against the residual so far, weighted by lasso logistic regression."""
    if len(y) == 0:
        return Rules(0.0, ())
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return Rules(base, ())
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33)))
        cuts.append(q[:-1] + np.diff(q) / 2 if len(q) > 1 else q[:0])
    found: dict[tuple, None] = {}
    z = np.full(len(y), base)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(2, len(y) // 2)])
        paths = _paths(x, residual, cuts, rows, (), depth, max(2, len(rows) // 200))
        for p in paths:
            found.setdefault(tuple(sorted(p)), None)
        for p in paths:
            if len(p) == depth:
                hit = _holds(x, p)
                if hit.any():
                    z[hit] += 0.3 * 4 * residual[hit].mean()
    rules = list(found)
    m = np.stack([_holds(x, p) for p in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    distinct = np.unique(m, axis=1, return_index=True)[1] if rules else []
    rules, m = [rules[i] for i in sorted(distinct)], m[:, sorted(distinct)]
    # Accelerated proximal gradient; the intercept isn't penalised.
    w, b = np.zeros(m.shape[1]), base
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(np.column_stack([m, np.ones(len(y))]), 2) ** 2 / len(y))
    for _ in range(800):
        g = (1 / (1 + np.exp(-(m @ v + c))) - y) / len(y)
        new = v - step * (m.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    kept = [(tuple((names[j], above, cut) for j, above, cut in p), float(wt)) for p, wt in zip(rules, w, strict=True) if abs(wt) > 1e-6]
    return Rules(float(b), tuple(kept))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) if above else (x[:, j] <= cut) for j, above, cut in path])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Rules fitted on at most sample_rows labelled rows that aren't held out, chosen by a hash of doc_id."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    one = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = bounded_sample(one, "doc_id", sample_rows)  # a bounded table, so it may be broadcast
    stats = statistics(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *[c.cast("double").alias(s) for s, c in stats.items()])
    got = rows.groupBy("doc_id").agg(F.min("y").alias("y"), *[F.min(s).alias(s) for s in stats]).orderBy("doc_id").toPandas()
    return fit_rules(list(stats), got[list(stats)].to_numpy(np.float64), (got["y"].to_numpy() > 0.5).astype(np.float64))


def score_quality(docs: DataFrame, rules: Rules, name: str = "score") -> DataFrame:
    """docs with a column of this name; one that docs has is replaced."""
    stats, used = statistics(F.col("text")), rules.used()
    names = {s: free_name(f"stat_{s}", docs) for s in stats if s in used}
    cols = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*cols, *[stats[s].cast("double").alias(c) for s, c in names.items()]).select(*cols, rules.column(names).alias(name))


def op7_quality_rules(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, rules)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
