"""Vector operators: weighted and plain mean pooling, decay-weighted stock-day
aggregation with forward fill, document embedding, sanity checks, PCA.

Vectors are ``array<float>`` columns. Means run through MLlib's
``Summarizer`` (JVM, partial aggregation), so pooling never collects a
group's vectors into one row. Keys are joined and exploded first and the
vectors attached last, so wide rows cross the network once.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, HashingTF, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list

# Fixed values of the stock-day aggregation.
WINDOW_DAYS = 30
HALF_LIFE_DAYS = 14


def mean_vectors(df: DataFrame, by, vec: str, weight: str | None = None, out: str = "vec",
                 count_col: str | None = None, dtype: str = "float32") -> DataFrame:
    """(weighted) mean of ``vec`` per group, as ``array<float>``.

    ``Summarizer`` aggregates partially on the map side; a group's vectors are
    never gathered in one place.
    """
    by = as_list(by)
    v = array_to_vector(F.col(vec))
    m = Summarizer.mean(v, F.col(weight)) if weight else Summarizer.mean(v)
    aggs = [m.alias("_m")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    g = df.groupBy(*by).agg(*aggs)
    return g.withColumn(out, vector_to_array("_m", dtype)).drop("_m")


def decay_weight(lag_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), lag_days.cast("double") / F.lit(float(half_life)))


def stockday_vectors(grid: DataFrame, docs: DataFrame, bridge: DataFrame, entity: str, date: str,
                     cik: str, doc_id: str, doc_date: str, vec: str,
                     window_days: int = WINDOW_DAYS, half_life: float = HALF_LIFE_DAYS,
                     dtype: str = "float32") -> DataFrame:
    """Per grid row ``(entity, date)`` the mean of the entity's document
    vectors filed ``0..window_days`` days earlier, weighted ``0.5^(lag/half_life)``;
    grid days without such a document carry the last value forward; rows before
    the entity's first hit are dropped.

    ``bridge`` maps entities to every cik ever seen on them. A document goes with
    its vector to the months it reaches, dealt by ``(entity, month)``; there it is
    spread to its days and pooled without another shuffle. Only the pooled days
    meet the grid, in the order that the carrying window needs.
    """
    dk = (docs.select(cik, doc_id, doc_date).join(docs.select(doc_id, vec), doc_id)
          .join(bridge.filter(F.col(entity).isNotNull()).select(entity, cik).distinct(), cik))
    end = F.date_add(doc_date, window_days)
    months = F.sequence(F.trunc(doc_date, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    near = dk.select(entity, doc_date, vec, F.explode(months).alias("_b")).repartition(entity, "_b")
    days = F.sequence(F.greatest(F.col(doc_date), F.col("_b")), F.least(end, F.last_day("_b")))
    cover = near.select(entity, "_b", doc_date, vec, F.explode(days).alias(date))
    cover = cover.withColumn("_w", decay_weight(F.datediff(date, doc_date), half_life))
    agg = mean_vectors(cover, [entity, "_b", date], vec, "_w", "_v", dtype=dtype)
    agg = agg.select(entity, date, "_v", F.lit(False).alias("_on"))
    g = grid.select(entity, date).distinct().withColumn("_on", F.lit(True))
    u = agg.unionByName(g, allowMissingColumns=True).repartition(entity)
    u = u.groupBy(entity, date).agg(F.first("_v", ignorenulls=True).alias("_v"), F.max("_on").alias("_on")).filter("_on")
    w = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return (u.withColumn(vec, F.last("_v", ignorenulls=True).over(w))
            .filter(F.col(vec).isNotNull()).select(entity, date, vec))


def embed_chunks(chunks: DataFrame, tok: str, dim: int = 64, out: str = "vec",
                 encoder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
                 schema: str | None = None) -> DataFrame:
    """G12 encoder step: one vector per chunk.

    The built-in encoder is feature hashing of the chunk's tokens, L2
    normalised (JVM, runs offline). A user encoder is a ``mapInPandas``
    function over batches of chunk rows returning ``schema`` with ``out``.
    """
    if encoder is not None:
        return chunks.mapInPandas(encoder, schema)
    tf = HashingTF(inputCol=tok, outputCol="_tf", numFeatures=dim).transform(chunks)
    nv = Normalizer(inputCol="_tf", outputCol="_n", p=2.0).transform(tf)
    return nv.withColumn(out, vector_to_array("_n", "float32")).drop("_tf", "_n")


def embed_documents(chunks: DataFrame, key: str, tok: str, dim: int = 64, out: str = "vec",
                    encoder=None, schema: str | None = None) -> DataFrame:
    """G12 + E9: chunk vectors mean-pooled per document, with ``n_chunks``."""
    cv = embed_chunks(chunks, tok, dim, out, encoder, schema)
    return mean_vectors(cv, key, out, out=out, count_col="n_chunks")


def vector_sanity(df: DataFrame, vec: str, by: str | None = None) -> DataFrame:
    """Rows with NaN/Inf, mean and population std of L2 norms."""
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"),
            F.avg(norm).alias("norm_mean"), F.stddev_pop(norm).alias("norm_std"),
            F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


# --------------------------------------------------------------------------- #
# G15-G19 PCA on the training matrix
# --------------------------------------------------------------------------- #
def training_matrix(day_embed: DataFrame, windows: DataFrame, entity: str, date: str, vec: str,
                    start: str, end: str, date_in: str = "date_in", date_out: str = "date_out") -> DataFrame:
    """Vectors inside ``[start, end]`` and inside a membership window; unique
    ``(entity, date)``; the vector column keeps its width even when empty."""
    from vintage.operators.temporal import membership_filter
    x = day_embed.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return membership_filter(x.select(entity, date, vec), windows, entity, date, date_in, date_out)


def fit_pca(matrix: DataFrame, vec: str, k: int, min_rows: int = 0):
    """Centred PCA (MLlib ``PCA`` does not centre by itself).

    Returns ``(scaler_model, pca_model)``; raises when the matrix has fewer
    than ``max(k, min_rows)`` rows (MLlib would silently accept n < k).
    """
    n = matrix.count()
    if n < max(k, min_rows):
        raise ValueError(f"PCA needs at least {max(k, min_rows)} rows, got {n}")
    v = matrix.withColumn("_v", array_to_vector(vec))
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(sc.transform(v))
    return sc, pca


def gram_by(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(key, n, s, g) per value of ``by``: rows, sum and sum of outer products of the vectors.

    One pass: every task sums its own rows, then one small row per task and key
    meets in the task of the key. Sums of several keys add up, so expanding
    windows need no further pass.
    """
    def partial(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            for k in np.unique(keys):
                r = x[keys == k]
                n, s, g = sums.get(int(k), (0, 0.0, 0.0))
                sums[int(k)] = (n + len(r), s + r.sum(axis=0), g + r.T @ r)
        yield _gram_batch(sums)

    def merge(key, table):
        parts = table.to_pylist()
        total = (sum(p["n"] for p in parts), np.sum([p["s"] for p in parts], axis=0),
                 np.sum([p["g"] for p in parts], axis=0).reshape(len(parts[0]["s"]), -1))
        return pa.Table.from_batches([_gram_batch({key[0].as_py(): total})])

    schema = "key long, n long, s array<double>, g array<double>"
    p = df.filter(F.col(vec).isNotNull()).select(F.col(by).cast("long").alias("key"), vec).mapInArrow(partial, schema)
    return p.groupBy("key").applyInArrow(merge, schema)


def _gram_batch(sums: dict):
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64()),
         pa.array([np.asarray(sums[k][1]).tolist() for k in keys], pa.list_(pa.float64())),
         pa.array([np.asarray(sums[k][2]).ravel().tolist() for k in keys], pa.list_(pa.float64()))],
        names=["key", "n", "s", "g"])


def add_grams(rows) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance) of several rows of :func:`gram_by`."""
    rows = list(rows)
    n = sum(r["n"] for r in rows)
    if n < 2:
        return n, np.zeros(0), np.zeros((0, 0))
    s = np.sum([r["s"] for r in rows], axis=0)
    g = np.sum([r["g"] for r in rows], axis=0).reshape(len(s), len(s))
    return n, s / n, (g - np.outer(s, s) / n) / (n - 1)


def explained_shares(cov: np.ndarray) -> np.ndarray:
    """Share of the variance per principal component, largest first."""
    ev = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0.0)
    return ev / max(ev.sum(), 1e-300)


def width_for(shares: np.ndarray, target: float) -> int:
    """The smallest width that reaches ``target``, plus one, at most all."""
    at = int(np.searchsorted(np.cumsum(shares), target - 1e-12)) + 1
    return min(at + 1, len(shares))


def components_of(cov: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` principal directions (columns); the largest loading of each is positive."""
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1][:, :n]
    return v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def project_on(df: DataFrame, mean: np.ndarray, directions: np.ndarray, vec: str, keys: Sequence[str],
               prefix: str = "pca_") -> DataFrame:
    """G19 with stated directions: ``(v - mean) . directions`` as columns ``pca_0..`` (float).

    The matrix (vector length x width) travels with the function; vectors stay in Arrow batches.
    """
    from pyspark.sql import types as T

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
            y = ((x - mean) @ directions).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))

    p = df.filter(F.col(vec).isNotNull()).select(*keys, run(F.col(vec)).alias("_p"))
    return p.select(*keys, *[F.col("_p")[i].alias(f"{prefix}{i}") for i in range(directions.shape[1])])


def explained_variance_table(pca_model, spark) -> DataFrame:
    """Eigenvalue table ``(component, explained, cumulative)``."""
    ev = [float(x) for x in pca_model.explainedVariance.toArray()]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(ev)], "component int, explained double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum("explained").over(w))


def pick_n(ev_table: DataFrame, target: float, cap: int | None = None) -> int:
    """Smallest n with cumulative >= target, plus one, capped; the full
    length when never reached."""
    r = ev_table.agg(F.min(F.when(F.col("cumulative") >= target, F.col("component") + 1)).alias("n"),
                     F.count(F.lit(1)).alias("m")).first()
    n = r["m"] if r["n"] is None else r["n"] + 1
    n = min(n, r["m"])
    return min(n, cap) if cap else n


def component_signs(pca_model) -> list[float]:
    """Sign per component that makes its largest-magnitude loading positive."""
    import numpy as np
    pc = pca_model.pc.toArray()
    return [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(pc.shape[1])]


def project(df: DataFrame, scaler, pca_model, vec: str, keys: Sequence[str], n: int | None = None,
            prefix: str = "pca_") -> DataFrame:
    """``(v - mean) . components`` as columns ``pca_0..`` (float), signs fixed."""
    k = n or pca_model.getK()
    signs = component_signs(pca_model)
    v = df.withColumn("_v", array_to_vector(vec))
    p = pca_model.transform(scaler.transform(v)).withColumn("_a", vector_to_array("_p"))
    return p.select(*keys, *[(F.col("_a")[i] * signs[i]).cast("float").alias(f"{prefix}{i}") for i in range(k)])


def save_walk_model(model, root: str, walk_id: int) -> str:
    """Persist a fitted model (or pipeline) for a walk under ``root``."""
    path = f"{root.rstrip('/')}/walk-{walk_id:03d}"
    model.write().overwrite().save(path)
    return path


def load_walk_model(loader, root: str, walk_id: int):
    """Load the walk's model with ``loader`` (e.g. ``PCAModel`` or ``PipelineModel``)."""
    return loader.load(f"{root.rstrip('/')}/walk-{walk_id:03d}")
