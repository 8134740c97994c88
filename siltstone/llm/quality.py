"""Quality by co-training: a text view and a metadata view teach each other.

The text view sees what a text is made of: its words (hashed to buckets), its
bytes and a few shares, all free of its length. The metadata view sees language,
source and length. No input is in both. Both start from labelled rows of the
training folds. In each round each view judges every row that has no label,
wherever it is sure its verdict is a label for the other view, and each view
takes a Newton step over its labelled rows and what it was taught. In the end
each view is calibrated on a fold that no view was fitted on, a last regression
joins the two, and all documents are scored.

Features are written once. A round is one pass of Spark over them that hands
back sums of a fixed size, so that all rows teach, and none reaches the driver.
Only the labelled rows are bounded (``max_labelled`` rows, drawn by a hash of
the id).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared
from .toxicity import fold, logistic_fit

BUCKETS = 256
SHARES = 8
TEXT_SIZE = BUCKETS + 256 + SHARES
META_SIZE = 64
SIZES = (TEXT_SIZE, META_SIZE)
RIDGES = (30.0, 3.0)


def text_features(data: bytes):
    """Word buckets, bytes and shares of a text; a text twice as long of the same make has the same."""
    import zlib

    import numpy as np

    out = np.zeros(TEXT_SIZE, np.float32)
    n = len(data)
    if not n:
        return out
    words = data.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if words:
        at = np.fromiter((zlib.crc32(w.lower()) % BUCKETS for w in counts), np.int64, len(counts))
        out[:BUCKETS] = np.sqrt(np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS) / m)
    b = np.frombuffer(data, np.uint8)
    share = np.bincount(b, minlength=256) / n
    out[BUCKETS : BUCKETS + 256] = np.sqrt(share)
    lower, upper = float(share[97:123].sum()), float(share[65:91].sum())
    lines = data.split(b"\n")
    out[BUCKETS + 256 :] = [
        upper / max(1e-9, upper + lower), max(counts.values(), default=0) / m, sum(map(len, words)) / m / 10, sum(a == c for a, c in zip(words, words[1:])) / m,
        len(set(lines)) / len(lines), sum(k for w, k in counts.items() if w[-1:] in b".,;:!?") / m, sum(k for w, k in counts.items() if not w.isalpha()) / m, float(share[48:58].sum()),
    ]
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None):
    import zlib

    import numpy as np

    out = np.zeros(META_SIZE, np.float32)
    out[zlib.crc32((lang or "").encode()) % 16] = 1
    out[16 + zlib.crc32((source or "").encode()) % 32] = 1
    size = math.log1p(max(0, n_chars or 0))
    out[48 + min(11, int(size))] = 1
    out[60], out[61], out[62] = size / 12, float(n_chars is None), float(source is None)
    return out


class View:
    """A linear model over standardised features; ``w`` ends in the offset."""

    def __init__(self, mean, scale, w) -> None:
        self.mean, self.scale, self.w = mean, scale, w

    def standard(self, x):
        import numpy as np

        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def odds(self, x):
        slope = self.w[:-1] / self.scale
        return x @ slope + (self.w[-1] - (slope * self.mean).sum())

    def sure(self, x, least: float):
        """1 and 0 where the view is that sure of a label, -1 elsewhere."""
        import numpy as np

        p = _chance(self.odds(x))
        return np.where(p >= least, 1, np.where(p <= 1 - least, 0, -1))


def _chance(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fitted(x, y, ridge: float) -> View:
    import numpy as np

    x = x.astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    view = View(mean, np.where(scale > 1e-6, scale, np.inf), np.zeros(x.shape[1] + 1))
    view.w = logistic_fit(view.standard(x), y, ridge, rounds=12)
    return view


def taught(models: list[View], views: list, least: float) -> list:
    """For each view: the gradient over the rows that the other view is sure of, and how many there are. Rows on which both are sure and differ teach neither."""
    said = [m.sure(x, least) for m, x in zip(models, views)]
    fair = (said[0] < 0) | (said[1] < 0) | (said[0] == said[1])
    out = []
    for i in (0, 1):
        use = fair & (said[1 - i] >= 0)
        z = models[i].standard(views[i][use])
        out.append((z.T @ (_chance(z @ models[i].w) - said[1 - i][use]), int(use.sum())))
    return out


def co_train(views: list, y, sums, rounds: int = 5) -> list[View]:
    """views: the labelled rows' features in both views. sums(models): see ``taught``, over all rows without a label.

    What a view is taught weighs as much as its labelled rows at most.
    """
    import numpy as np

    y = y.astype(np.float64)
    models = [fitted(x, y, r) for x, r in zip(views, RIDGES)]
    own = [m.standard(x.astype(np.float64)) for m, x in zip(models, views)]
    for _ in range(rounds):
        given = sums(models)
        if not any(n for _, n in given):
            break
        for model, z, ridge, (gradient, n) in zip(models, own, RIDGES, given):
            p = _chance(z @ model.w)
            weight = len(y) / max(len(y), n)
            g = z.T @ (p - y) + ridge * model.w + weight * gradient
            h = ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z) * (1 + weight * n / len(y)) + ridge * np.eye(len(model.w))
            model.w = model.w - np.clip(np.linalg.solve(h, g), -1, 1)
    return models


def _featured(rows: DataFrame) -> DataFrame:
    """rows: id, text, lang, source, n_chars. id and both views as bytes (half precision)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _shared.row_slices(batch, "text"):
                texts = part.column("text").cast(pa.binary())
                views = [[text_features(t.as_py()).astype(np.float16).tobytes() for t in texts], []]
                views[1] = [meta_features(*m).astype(np.float16).tobytes() for m in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(v, pa.binary()) for v in views)], ["id", "text_view", "meta_view"])

    return rows.transform(_shared.in_arrow, run, T.StructType([rows.schema["id"], *T._parse_datatype_string("text_view binary, meta_view binary").fields]))


def _views(batch) -> list:
    """Both views of an Arrow batch as arrays."""
    import numpy as np

    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float16).reshape(-1, size).astype(np.float32) for c, size in zip(("text_view", "meta_view"), SIZES)]


def _sums(pool: DataFrame, least: float):
    """``taught`` over a whole table, as one pass; the driver gets a few rows of a fixed size."""

    def over(models: list[View]) -> list:
        import numpy as np

        sent = pool.sparkSession.sparkContext.broadcast(models)  # two models of a fixed size
        sizes = [s + 1 for s in SIZES]

        def run(batches):
            import pyarrow as pa

            total = [[np.zeros(s), 0] for s in sizes]
            for batch in batches:
                if batch.num_rows:
                    for t, (g, n) in zip(total, taught(sent.value, _views(batch), least)):
                        t[0] += g
                        t[1] += n
            yield pa.RecordBatch.from_arrays([pa.array([t[0].tobytes()]) for t in total] + [pa.array([t[1]]) for t in total], ["g0", "g1", "n0", "n1"])

        def add(batches):
            import pyarrow as pa

            rows = [r for batch in batches for r in batch.to_pylist()]
            if rows:
                g = [pa.array([sum(np.frombuffer(r[c]) for r in rows).tobytes()]) for c in ("g0", "g1")]
                yield pa.RecordBatch.from_arrays([*g, *(pa.array([sum(r[c] for r in rows)]) for c in ("n0", "n1"))], ["g0", "g1", "n0", "n1"])

        schema = "g0 binary, g1 binary, n0 long, n1 long"
        rows = pool.transform(_shared.in_arrow, run, schema).repartition(16).transform(_shared.in_arrow, add, schema).collect()
        return [(sum((np.frombuffer(r[f"g{i}"]) for r in rows), np.zeros(sizes[i])), sum(r[f"n{i}"] for r in rows)) for i in (0, 1)]

    return over


def train(features: DataFrame, labels: DataFrame, id_column: str, label_column: str, max_labelled: int, rounds: int, sure: float):
    """Both views, the calibration of each and their joint; None without rows of both labels."""
    import numpy as np

    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).alias("label"))
    drawn = _shared.materialize(known.where(fold("id") != 0).orderBy(F.xxhash64("id"), "id").limit(max_labelled), "drawn")
    few = F.broadcast(drawn)  # max_labelled ids at most
    got = features.join(few, "id").orderBy(F.xxhash64("id"), "id", "text_view").limit(max_labelled).withColumn("fold", fold("id")).toArrow()
    y, folds = np.array(got["label"].to_pylist(), float), np.array(got["fold"].to_pylist(), int)
    fit = folds != 4
    if len(set(y[fit].tolist())) < 2:
        return None
    x = _views(got)
    models = co_train([v[fit] for v in x], y[fit], _sums(features.join(F.broadcast(drawn.select("id")), "id", "left_anti"), sure), rounds)
    check = ~fit if len(set(y[~fit].tolist())) == 2 else fit
    raw = np.stack([m.odds(v[check]) for m, v in zip(models, x)], axis=1)
    ones = np.ones((len(raw), 1))
    each = [logistic_fit(np.concatenate([raw[:, i : i + 1], ones], axis=1), y[check], 1e-2) for i in (0, 1)]
    calibrated = np.stack([raw[:, i] * each[i][0] + each[i][1] for i in (0, 1)], axis=1)
    return models, each, logistic_fit(np.concatenate([calibrated, ones], axis=1), y[check], 1e-2)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", size_column: str = "n_chars", label_column: str = "quality", max_labelled: int = 8000, rounds: int = 5, sure: float = 0.95) -> DataFrame:
    """One row per input row: id, held_out, text_score, meta_score, score (0 to 1), predicted.

    Rows whose crc32(id as text) is divisible by 5 are held out: their labels
    are not looked at. Nulls in any column are values of their own; null text
    counts as empty. Without labels of both kinds every score is 0.5. Other
    columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), _shared.text_of(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"), F.col(source_column).cast("string").alias("source"), F.col(size_column).cast("long").alias("n_chars"))
    features = _shared.materialize(_featured(rows), "views")
    sent = docs.sparkSession.sparkContext.broadcast(train(features, labels.select(F.col(id_column), F.col(label_column)), id_column, label_column, max_labelled, rounds, sure))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = sent.value
        for batch in batches:
            odds = np.zeros((3, batch.num_rows))
            if model and batch.num_rows:
                for i, (view, x, (slope, offset)) in enumerate(zip(model[0], _views(batch), model[1])):
                    odds[i] = view.odds(x) * slope + offset
                odds[2] = odds[0] * model[2][0] + odds[1] * model[2][1] + model[2][2]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x) for x in _chance(odds))], ["id", "text_score", "meta_score", "score"])

    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score"))])
    return features.transform(_shared.in_arrow, run, schema).select("id", (fold("id") == 0).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
