"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each text gets a vector of transformed statistics (mean word length, symbols per word, share of
repeated lines, share of words in repeated windows). Per language and source a regularised MCD
estimate is found by concentration steps over *all* rows of the group, and texts are rejected by
their Mahalanobis distance from it.

A concentration step is one Spark aggregate: distances are binned, and per group and bin the
number of rows and the integer moment sums are kept. The running sums over the bins are the
moments of every "nearest so many rows" subset, so no group is ever gathered or sorted, a hot
group costs no more than the bins it fills, and the sums are exact, whatever the order of tasks.

A group needs ``min_rows`` rows for a covariance of its own. A smaller one is judged by the
estimate of the next wider group (its language, then all documents), over all rows of that group;
the widest group judges whatever its size. ``_q_level`` says which: the number of grouping columns.

Nulls: a null text has no words and fails the base rules; null languages or sources are values of
their own. Repeated rows count as often as they occur, ties in distance share their verdict. Very
long texts are counted whole, each as a block of its own. An empty table gives an empty result.
Added columns start with ``_q_``; columns of the input that start so too are kept apart by
``robust_outliers`` and ``drop_outliers``, which read only the text and the grouping columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Shielded, blocks, gram_hashes, group_key, word_hashes, word_spans
from sitegrain.runtime import cut_lineage

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
DIMS = 4
#: Vectors are kept as integers in thousandths, so that sums of products are exact.
UNIT = 1000
#: Scale that every estimate gets added per coordinate, in units of the statistic: groups of texts made by one
#: template have hardly any spread, and without it their covariance is singular and any other text an outlier.
FLOORS = np.array([0.10, 0.15, 0.10, 0.05])
#: Share of rows that a concentration step keeps.
KEEP = 0.75
STEPS = 4
BINS_PER_E = 40
# Quantiles of the chi-squared distribution with 4 degrees of freedom at 0.75, 0.975 and 0.9999.
CHI2_KEEP, CHI2_WEIGHT, CHI2_CUT = 5.385269, 11.143287, 23.512742

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _counts(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in STATS]
    for _, _, data, offsets in blocks(batch, text):
        n = offsets.size - 1
        starts, ends, owner = word_spans(data, offsets)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        grams, at = gram_hashes(word_hashes(data, starts, ends, fold=False), owner, 5)
        covered = np.zeros(starts.size + 1, np.int64)
        if grams.size:
            # The text number goes into the key: a window counts only inside its own text.
            key = grams ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(key.size, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            np.add.at(covered, at[twice], 1)
            np.add.at(covered, at[twice] + 5, -1)
        in_window = np.cumsum(covered)[:-1] > 0
        repeats, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = data.tobytes()
        for i in range(n):
            own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            lines[i], repeats[i] = len(own), len(own) - len(set(own))
        for k, v in enumerate((
            np.bincount(owner, minlength=n),
            np.bincount(owner, weights=points[ends] - points[starts], minlength=n).astype(np.int64),
            symbols[offsets[1:]] - symbols[offsets[:-1]],
            repeats,
            np.bincount(owner, weights=in_window, minlength=n).astype(np.int64),
            lines,
        )):
            out[k].append(v.astype(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def with_statistics(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with the counts of each whole text under ``_q_...``; nothing is shuffled."""
    kept = [c for c in docs.columns if not (drop_text and c == text)]
    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for s in STATS:
        fields = fields.add(f"_q_{s}", "long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in kept] + [pa.array(v) for v in _counts(b, text)]
            yield pa.RecordBatch.from_arrays(columns, names=kept + [f"_q_{s}" for s in STATS])

    return docs.mapInArrow(add, fields)


def _q(name: str) -> Column:
    return F.col(f"_q_{name}")


def base_failed() -> Column:
    return (_q("n_words") < 10) | (100 * _q("n_repeat_words") > 20 * _q("n_words"))


def vector() -> list[Column]:
    """The transformed statistics in thousandths."""
    words = F.greatest(_q("n_words"), F.lit(1))
    parts = [
        F.log(F.greatest(_q("word_chars"), F.lit(1)) / words),
        F.log1p(_q("n_symbols") / words),
        _q("n_dup_lines") / F.greatest(_q("n_lines"), F.lit(1)),
        _q("n_repeat_words") / words,
    ]
    return [F.round(p * UNIT).cast("long").alias(f"_q_x{i}") for i, p in enumerate(parts)]


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_STATE = "grp string, start string, center array<double>, precision array<double>, logdet double, scale double, n long"


def _moment_sums() -> list[Column]:
    x = [F.col(f"_q_x{i}") for i in range(DIMS)]
    return [F.count(F.lit(1)).alias("n")] + [F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)] + [
        F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS
    ]


def _estimate(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    center = sums / n / UNIT
    cov = np.zeros((DIMS, DIMS))
    for (i, j), p in zip(_PAIRS, products):
        cov[i, j] = cov[j, i] = p / n / UNIT**2 - center[i] * center[j]
    return center, cov


def _row(grp: str, start: str, n: int, center: np.ndarray, cov: np.ndarray, scale: float = 1.0) -> dict:
    cov = cov * scale + np.diag(FLOORS**2)
    return {
        "grp": grp, "start": start, "center": center.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(),
        "logdet": float(np.linalg.slogdet(cov)[1]), "scale": scale, "n": int(n),
    }


def _distance(center: str = "center", precision: str = "precision") -> Column:
    """Squared Mahalanobis distance of the row's vector from its group's estimate."""
    d = [F.col(f"_q_x{i}") / UNIT - F.col(center)[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + d[i] * d[j] * F.col(precision)[i * DIMS + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _starts(vectors: DataFrame) -> DataFrame:
    """Two starting estimates per group: medians with median deviations, and the plain mean and covariance."""
    x = [F.col(f"_q_x{i}") for i in range(DIMS)]
    # Values are whole thousandths of bounded ranges: the exact percentile keeps a short count table.
    first = cut_lineage(
        vectors.groupBy("grp")
        .agg(*_moment_sums(), *[F.percentile(x[i], F.lit(0.5)).alias(f"m{i}") for i in range(DIMS)])
    )
    spread = vectors.join(first.select("grp", *[f"m{i}" for i in range(DIMS)]), "grp").groupBy("grp").agg(
        *[F.percentile(F.abs(x[i] - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i in range(DIMS)]
    )

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                center, cov = _estimate(
                    r.n, np.array([float(getattr(r, f"s{i}")) for i in range(DIMS)]),
                    np.array([float(getattr(r, f"p{i}{j}")) for i, j in _PAIRS]),
                )
                med = np.array([getattr(r, f"m{i}") for i in range(DIMS)]) / UNIT
                mad = 1.4826 * np.array([getattr(r, f"a{i}") for i in range(DIMS)]) / UNIT
                rows += [_row(r.grp, "mean", r.n, center, cov), _row(r.grp, "median", r.n, med, np.diag(mad**2))]
            yield pd.DataFrame(rows, columns=_STATE_NAMES)

    return first.join(spread, "grp").mapInPandas(make, _STATE)


_STATE_NAMES = ["grp", "start", "center", "precision", "logdet", "scale", "n"]


def _step(vectors: DataFrame, state: DataFrame, mode: str) -> DataFrame:
    """One pass over all vectors. ``keep``: a concentration step. ``scale``: the raw estimate of the best start,
    scaled so that the kept share agrees with the normal model. ``weight``: the reweighted estimate."""
    binned = vectors.join(state, "grp").withColumn("bin", F.floor(F.log1p(_distance()) * BINS_PER_E).cast("int"))
    sums = binned.groupBy("grp", "start", "bin").agg(
        *_moment_sums(), *[F.first(c).alias(c) for c in ("center", "precision", "scale")]
    )
    ps = [f"p{i}{j}" for i, j in _PAIRS]

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        seen = pdf["n"].cumsum().to_numpy()
        upper = np.expm1((pdf["bin"].to_numpy() + 1) / BINS_PER_E)
        if mode == "weight":
            k = max(1, int((upper <= CHI2_WEIGHT).sum()))
        else:
            k = int(np.searchsorted(seen, KEEP * seen[-1])) + 1
        part = pdf.iloc[:k]
        n = int(part["n"].sum())
        center, cov = _estimate(
            n, np.array([float(part[f"s{i}"].sum()) for i in range(DIMS)]), np.array([float(part[p].sum()) for p in ps])
        )
        scale = 1.0
        if mode == "scale":
            old = np.linalg.inv(np.array(pdf["precision"].iloc[0]).reshape(DIMS, DIMS))
            center, scale = np.array(pdf["center"].iloc[0]), max(1.0, float(upper[k - 1]) / CHI2_KEEP)
            cov = old - np.diag(FLOORS**2)
        return pd.DataFrame([_row(key[0], key[1], int(seen[-1]), center, cov, scale)], columns=_STATE_NAMES)

    return cut_lineage(sums.groupBy("grp", "start").applyInPandas(make, _STATE))


def _levels(groups: tuple[str, ...]) -> list[Column]:
    """The key of a row's group by all grouping columns, by all but the last, and so on to one for all rows."""
    return [
        F.concat(F.lit(f"{k}:"), group_key(*groups[:k])) if k else F.lit("0:") for k in range(len(groups), -1, -1)
    ]


def judges(vectors: DataFrame, levels: int, min_rows: int) -> DataFrame:
    """(g0, grp, level): which group's estimate judges the rows of each finest group.

    ``vectors`` has the keys ``g0`` (finest) to ``g{levels - 1}`` (all rows).
    """
    keys = [f"g{k}" for k in range(levels)]
    sizes = cut_lineage(vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    chosen = F.struct(F.lit(0).alias("level"), F.col(keys[-1]).alias("grp"))
    counted = sizes
    for k in reversed(range(levels - 1)):
        total = sizes.groupBy(keys[k]).agg(F.sum("n").alias(f"n{k}"))
        counted = counted.join(total, keys[k])
        chosen = F.when(F.col(f"n{k}") >= min_rows, F.struct(F.lit(levels - 1 - k).alias("level"), F.col(keys[k]).alias("grp"))).otherwise(chosen)
    return cut_lineage(counted.select(*keys, chosen.alias("j")).select(*keys, "j.grp", "j.level"))


def mcd_estimates(stats: DataFrame, groups: tuple[str, ...] = ("lang", "source"), min_rows: int = 50) -> DataFrame:
    """(g0, center, precision, level) per finest group with rows that pass the base rules.

    ``stats`` is read once per step, so hand over a narrow table that is cheap to read.
    """
    levels = _levels(groups)
    keyed = stats.filter(~base_failed()).select(*[g.alias(f"g{k}") for k, g in enumerate(levels)], *vector())
    judge = judges(keyed, len(levels), min_rows)
    # A row takes part in every group around it that judges some finest group.
    needed = judge.select("grp").distinct()
    around = judge.select("g0", F.explode(F.array(*[f"g{k}" for k in range(len(levels))])).alias("grp")).distinct()
    members = cut_lineage(around.join(needed, "grp", "left_semi"))
    vectors = keyed.join(members, "g0").select("grp", *[f"_q_x{i}" for i in range(DIMS)])
    state = cut_lineage(_starts(vectors))
    for _ in range(STEPS):
        state = _step(vectors, state, "keep")
    best = state.groupBy("grp").agg(F.min_by(F.struct("start", "center", "precision", "scale"), F.struct("logdet", "start")).alias("b"))
    state = best.select("grp", "b.*")
    state = _step(vectors, state, "scale")
    return judge.select("g0", "grp", "level").join(_step(vectors, state, "weight").select("grp", "center", "precision"), "grp").drop("grp")


def with_verdict(stats: DataFrame, estimates: DataFrame, groups: tuple[str, ...] = ("lang", "source"), cut: float = CHI2_CUT) -> DataFrame:
    """``stats`` plus ``_q_base_failed``, ``_q_distance``, ``_q_level`` and ``_q_kept``.

    Distance and level are null in groups without a row that passes the base rules.
    """
    own = stats.select("*", _levels(groups)[0].alias("_q_grp"), *vector())
    known = estimates.select(*[F.col(c).alias(f"_q_{n}") for c, n in (("g0", "grp"), ("center", "center"), ("precision", "precision"), ("level", "level"))])
    joined = own.join(known, "_q_grp", "left")
    distance = F.when(F.col("_q_center").isNotNull(), F.sqrt(_distance("_q_center", "_q_precision")))
    return (
        joined.withColumn("_q_base_failed", base_failed())
        .withColumn("_q_distance", distance)
        .withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce(F.col("_q_distance") <= F.lit(float(np.sqrt(cut))), F.lit(True)))
        .drop("_q_grp", "_q_center", "_q_precision", *[f"_q_x{i}" for i in range(DIMS)])
    )


def robust_outliers(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), min_rows: int = 50) -> DataFrame:
    """One row per document without its text: its counts, distance and verdict under ``_q_...``."""
    shield = Shielded(docs)
    text, groups = shield.of(text), tuple(shield.of(g) for g in groups)
    stats = cut_lineage(with_statistics(shield.df, text, drop_text=True))
    return shield.back(with_verdict(stats, mcd_estimates(stats, groups, min_rows), groups))


def drop_outliers(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), min_rows: int = 50) -> DataFrame:
    """The documents that pass, in their own columns.

    Counts are computed again beside each text instead of being joined back by an id, which may
    be null or repeated.
    """
    shield = Shielded(docs)
    text, groups = shield.of(text), tuple(shield.of(g) for g in groups)
    narrow = cut_lineage(with_statistics(shield.df.select(text, *groups), text, drop_text=True))
    estimates = mcd_estimates(narrow, groups, min_rows)
    judged = with_verdict(with_statistics(shield.df, text), estimates, groups)
    return shield.back(judged.filter("_q_kept").select(*shield.df.columns))
