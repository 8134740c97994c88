"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary text, spell out each word as a chain of
ever longer beginnings (up to eight letters) that ends in the word itself. Each
step has a class-conditional count with an absolute discount; what is taken off
backs off to counts that both classes share: in how many distinct words a
beginning occurs. So rare words are judged by their beginnings, and words that
one class has just happened to see weigh nothing.

A word's evidence is the difference of its two log-likelihoods. Per text, the
evidence divided by the length is taken in full and for expressions beyond
``STRONG`` nats alone, and calibrated by logistic regression on labelled rows
that were not counted.

All counts are made by Spark over every training row and stay a table, whose rows
grow with the text: each beginning that either class has seen often enough, with
the evidence summed up to it. It is sent to the tasks up to ``MOST_SENT`` rows;
beyond, the words of the texts are joined with it. Both ways give the same scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared

#: The longest beginning, in letters.
DEPTH = 8
DISCOUNT = 2.0
STRONG = 3.0
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Closes the unit of a whole word.
END = "\x00"
#: The rows of the table that are sent to every task at most (24 bytes each).
MOST_SENT = 2_000_000


def split_words(texts):
    """Distinct words of an Arrow string array (lower case, without signs around them), the number of each word in order, and the offsets of the texts."""
    import numpy as np
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(texts)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    bare = pc.utf8_lower(pc.ascii_trim(coded.dictionary, characters=SIGNS)).dictionary_encode()
    if not len(coded):
        return bare.dictionary, np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    named = pc.not_equal(bare.dictionary, "").to_numpy(zero_copy_only=False)
    word = bare.indices.to_numpy()[coded.indices.to_numpy()]
    keep = named[word]
    return bare.dictionary, word[keep], np.concatenate([[0], np.cumsum(keep)])[bounds - bounds[0]]


def _keys(units):
    """The 64-bit hash of each unit (Arrow strings), as Spark's xxhash64 has it."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(u, 42) for u in units.cast(pa.binary()).to_pylist()), np.uint64, len(units)).view(np.int64)


@dataclass
class Model:
    """``units`` (see unit_evidence) and, if they are few, ``sent``: their columns in order of the key. ``prior`` alone where a class has no rows."""

    units: DataFrame | None
    sent: tuple | None
    root: float
    prior: float
    weights: tuple[float, ...] = (1.0, 0.0, 0.0, 1.0, 0.0)


def word_evidence(words, sent, root: float):
    """Log-likelihood difference of each word (Arrow strings): that of its longest known beginning, with the step beyond it unless it is the whole word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys, upto, beyond = sent
    out, open_ = np.full(len(words), root), np.arange(len(words))
    sizes = pc.utf8_length(words).to_numpy()
    for k in range(DEPTH + 1, 0, -1):
        due = open_ if k > DEPTH else open_[sizes[open_] >= k]
        if not len(due) or not len(keys):
            continue
        own = words.take(pa.array(due))
        found = _keys(pc.binary_join_element_wise(own, END, "") if k > DEPTH else pc.utf8_slice_codeunits(own, 0, k))
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        known = keys[at] == found
        out[due[known]] = (upto if k > DEPTH else beyond)[at[known]]
        open_ = np.setdiff1d(open_, due[known], assume_unique=True)
    return out


def text_sums(texts, sent, root: float):
    """Of each text: strong evidence, strong words, all evidence, words."""
    import numpy as np

    words, which, bounds = split_words(texts)
    each = word_evidence(words, sent, root)[which]

    def per_text(x):
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[bounds[1:]] - total[bounds[:-1]]

    strong = each > STRONG
    return per_text(np.where(strong, each, 0.0)), per_text(strong.astype(float)), per_text(each), np.diff(bounds).astype(float)


def logistic_fit(x, y, ridge: float = 1e-3, rounds: int = 60):
    """Newton's method for logistic regression; x has a column of ones."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """id, text, label of the labelled rows; only rows that may have a label move. Of several labels of an id the largest counts."""
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("int").alias("label"))
    known = _shared.materialize(known.withColumnRenamed("__id", "id"), "known-labels")
    rows = docs.select(F.col(id_column).alias("id"), _shared.text_of(text_column).alias("text")).where("id is not null")
    return _shared.matching(rows, "id", known).join(_shared.merged(known), "id").select("id", "text", "label")


def fold(id_column: str):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def unit_counts(rows: DataFrame) -> DataFrame:
    """rows: text, label. unit, parent, ordinary, toxic (occurrences), words (distinct words) of all beginnings."""

    def words(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _shared.row_slices(batch, "text"):
                names, which, bounds = split_words(part.column("text"))
                toxic = np.repeat(part.column("label").to_numpy() > 0, np.diff(bounds))
                n = [np.bincount(which[toxic == k], minlength=len(names)) for k in (False, True)]
                seen = pa.array(np.flatnonzero(n[0] + n[1]))
                yield pa.RecordBatch.from_arrays([names.take(seen), pa.array(n[0]).take(seen), pa.array(n[1]).take(seen)], ["word", "ordinary", "toxic"])

    counted = rows.select("text", "label").transform(_shared.in_arrow, words, "word string, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    size = F.char_length("word")
    begin = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(DEPTH))), lambda k: F.struct(F.substring(F.col("word"), F.lit(1), k).alias("unit"), F.when(k > 0, F.substring(F.col("word"), F.lit(1), k - 1)).alias("parent")))
    whole = F.array(F.struct(F.concat("word", F.lit(END)).alias("unit"), F.substring("word", 1, DEPTH).alias("parent")))
    units = counted.select(F.explode(F.concat(begin, whole)).alias("x"), "ordinary", "toxic")
    return units.groupBy("x.unit", "x.parent").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("words"))


def unit_evidence(counts: DataFrame) -> DataFrame:
    """counts (put aside): see unit_counts. key, upto, beyond of the units that a class has more often than the discount.

    ``upto`` is the sum of the log-likelihood differences of the steps up to the
    unit, ``beyond`` has one step to an unknown unit more. Below an unknown unit,
    whose counts are within the discount in both classes, likelihoods are alike.
    """
    held = counts.where("parent is not null").groupBy(F.col("parent").alias("unit")).agg(*[F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"held_{c}") for c in ("ordinary", "toxic")])
    told = _shared.materialize(counts.where(F.greatest("ordinary", "toxic") > DISCOUNT).join(_shared.merged(held), "unit", "left").na.fill(0.0, ["held_ordinary", "held_toxic"]), "told-units")
    above = told.select(F.col("unit").alias("parent"), *[F.col(c).alias(f"{c}_above") for c in ("ordinary", "toxic", "words", "held_ordinary", "held_toxic")])

    def step(ordinary, toxic, words, above: str = ""):
        """The log-likelihood difference of a unit with these counts, below one with the counts in the columns of that suffix."""
        of = lambda c: F.col(c + above)
        shared = (words + 0.5) / (of("words") + 32.0)
        likely = lambda c, n: F.when(of(c) > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + of(f"held_{c}") * shared) / of(c)).otherwise(shared)
        return F.log(F.greatest(likely("toxic", toxic), F.lit(1e-12)) / F.greatest(likely("ordinary", ordinary), F.lit(1e-12)))

    none = F.lit(0.0)
    steps = told.join(_shared.merged(above), "parent").select("unit", step(F.col("ordinary"), F.col("toxic"), F.col("words"), "_above").alias("step"))
    end = F.col("unit").endswith(END)
    bare = F.when(end, F.expr("substring(unit, 1, char_length(unit) - 1)")).otherwise(F.col("unit"))
    chain = F.transform(F.sequence(F.lit(1), F.least(F.char_length(bare), F.lit(DEPTH))), lambda k: F.substring(bare, F.lit(1), k))
    chain = F.when(F.char_length(bare) > 0, chain).otherwise(F.array().cast("array<string>"))
    parts = told.select(F.col("unit").alias("whole"), F.explode(F.when(end, F.array_append(chain, F.col("unit"))).otherwise(chain)).alias("unit"))
    sums = parts.join(_shared.merged(steps), "unit").groupBy(F.col("whole").alias("unit")).agg(F.sum("step").alias("upto"))
    out = told.join(_shared.merged(sums), "unit", "left").withColumn("upto", F.coalesce("upto", none))
    return out.select("unit", F.xxhash64("unit").alias("key"), "upto", (F.col("upto") + step(none, none, none)).alias("beyond"))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_calibration: int = 20_000, most_sent: int = MOST_SENT) -> Model:
    """Counts all training rows of folds 1 to 3; fold 4, up to ``max_calibration`` rows of it, calibrates. Fold 0 is not looked at."""
    import numpy as np

    rows = _shared.materialize(labelled(docs, labels, id_column, text_column, label_column).withColumn("fold", fold("id")).where("fold <> 0"), "labelled")
    sums = {(r["counted"], bool(r["toxic"])): r["n"] for r in rows.groupBy((F.col("fold") < 4).alias("counted"), (F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n = sum(sums.values())
    prior = sum(x for k, x in sums.items() if k[1]) / n if n else 0.0
    if not all((True, k) in sums for k in (False, True)):
        return Model(None, None, 0.0, prior)
    units = _shared.materialize(unit_evidence(_shared.materialize(unit_counts(rows.where("fold < 4")), "unit-counts")), "units")
    root = units.where("unit = ''").select("beyond").first()
    sent = None
    if units.count() <= most_sent:
        got = units.select("key", "upto", "beyond").toArrow().sort_by("key")
        sent = tuple(got.column(c).to_numpy() for c in ("key", "upto", "beyond"))
    model = Model(units, sent, root["beyond"] if root else 0.0, prior)
    if (False, True) in sums and (False, False) in sums:
        some = rows.where("fold = 4").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_calibration)
        asked = rows.where("fold = 4").join(F.broadcast(some), "id", "left_semi")  # max_calibration ids at most
        got = _scored(asked, model, ["label"]).select("label", "features").collect()
        x, y = np.array([r["features"] for r in got]), np.array([r["label"] > 0 for r in got], float)
        scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        w = logistic_fit(np.concatenate([x / scale, np.ones((len(x), 1))], axis=1), y, ridge=1.0)
        model.weights = (*(w[:-1] / scale).tolist(), float(w[-1]))
    return model


SUMS = ("strong", "strong_words", "evidence", "n")


def _sums_in_tasks(rows: DataFrame, model: Model) -> DataFrame:
    """rows, without their text, with SUMS: each task has the whole table."""
    keep = [c for c in rows.columns if c != "text"]
    sent = rows.sparkSession.sparkContext.broadcast((model.sent, model.root))  # MOST_SENT rows at most

    def run(batches):
        import pyarrow as pa

        table, root = sent.value
        for batch in batches:
            for part in _shared.row_slices(batch, "text"):
                sums = text_sums(part.column("text"), table, root)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, sums)], [*keep, *SUMS])

    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in SUMS)])
    return rows.select(*keep, "text").transform(_shared.in_arrow, run, schema)


def _sums_by_join(rows: DataFrame, model: Model) -> DataFrame:
    """As _sums_in_tasks, by joins: words with the table, then texts with their words.

    Texts go by two hashes; equal ones add to the same sums, which changes no
    ratio of them. Rows of a frequent word are split by adaptive execution.
    """
    keep = [c for c in rows.columns if c != "text"]
    keyed = rows.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), F.col("text"))})

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _shared.row_slices(batch, "text"):
                words, which, bounds = split_words(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                pairs, n = np.unique(row * max(len(words), 1) + which, return_counts=True)
                at, word = pa.array(pairs // max(len(words), 1)), pa.array(pairs % max(len(words), 1))
                yield pa.RecordBatch.from_arrays([part.column("__a").take(at), part.column("__b").take(at), words.take(word), pa.array(n)], ["__a", "__b", "word", "times"])

    tokens = _shared.materialize(keyed.select("__a", "__b", "text").transform(_shared.in_arrow, run, "__a long, __b long, word string, times long"), "text-words")
    chain = F.transform(F.sequence(F.lit(1), F.least(F.char_length("word"), F.lit(DEPTH))), lambda k: F.struct(k.alias("k"), F.xxhash64(F.substring(F.col("word"), F.lit(1), k)).alias("key")))
    whole = F.array(F.struct(F.lit(DEPTH + 1).alias("k"), F.xxhash64(F.concat("word", F.lit(END))).alias("key")))
    steps = tokens.select("word").distinct().select("word", F.inline(F.concat(chain, whole)))
    told = F.when(F.col("k") > DEPTH, F.col("upto")).otherwise(F.col("beyond"))
    known = steps.join(_shared.merged(model.units.select("key", "upto", "beyond")), "key").groupBy("word").agg(F.max_by(told, "k").alias("each"))
    each = tokens.join(_shared.merged(known), "word", "left").withColumn("each", F.coalesce("each", F.lit(model.root)))
    strong, of = F.col("each") > STRONG, lambda c: F.sum(F.col("times") * c).cast("double")
    none = F.lit(0.0)
    sums = each.groupBy("__a", "__b").agg(of(F.when(strong, F.col("each")).otherwise(none)).alias("strong"), of(strong.cast("int")).alias("strong_words"), of(F.col("each")).alias("evidence"), F.sum("times").cast("double").alias("n"))
    return keyed.select(*keep, "__a", "__b").join(_shared.merged(sums), ["__a", "__b"], "left").select(*keep, *[F.coalesce(c, none).alias(c) for c in SUMS])


def _scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """rows with a text column: the kept columns, features and score. A text's features are its strong evidence by length, share of strong words, its root, and all evidence by length."""
    rows = rows.select(*keep, "text")
    if model.units is None:
        none = F.array(*[F.lit(0.0)] * 4)
        return rows.select(*keep, none.alias("features"), F.lit(float(model.prior)).alias("score"))
    sums = (_sums_in_tasks if model.sent is not None else _sums_by_join)(rows, model)
    n = F.greatest("n", F.lit(1.0))
    share = F.col("strong_words") / n
    features = F.array(F.col("strong") / n, share, F.sqrt(share), F.col("evidence") / n)
    out = sums.select(*keep, features.alias("features"))
    linear = F.lit(float(model.weights[-1]))
    for i, w in enumerate(model.weights[:-1]):
        linear = linear + F.col("features")[i] * float(w)
    return out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(linear, F.lit(40.0)), F.lit(-40.0)))))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_calibration: int = 20_000, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted.

    Only the text is an input of the score. Null, empty and wordless texts get
    the score of no evidence. Without rows of both classes to count, every
    score is the share of toxic rows (0 without labels). Null ids are in fold 0;
    null labels are no labels; other columns of either table are not looked at.
    An empty table gives no rows.
    """
    model = train(docs, labels, id_column, text_column, label_column, max_calibration, most_sent)
    rows = docs.select(F.col(id_column).alias("id"), _shared.text_of(text_column).alias("text"))
    return _scored(rows, model, ["id"]).select("id", (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows predicted toxic, all columns as they were."""
    model = train(docs, labels, id_column, text_column)
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(names)], _shared.text_of(text_column).alias("text"))
    kept = _scored(rows, model, [f"__{i}" for i in range(len(names))]).where("score < 0.5")
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
