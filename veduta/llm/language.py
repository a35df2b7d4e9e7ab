"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 characters of the lower-cased text, every run of other characters than letters being
one space, hashed to 2**16 places.  Document frequencies cover every training document and whole texts.  The weights
are learned by follow-the-regularised-leader with L1 and L2 penalties from about ``sample`` rows, equally many of each
language as far as there are (chosen by a hash of doc_id), four fifths to fit and one fifth to find the temperature
that minimises the log loss.  The sample and the number of languages that can be told (the ``MOST_LANGS`` with the most
rows; of equals the smaller by code points) are the only bounds: prediction reads whole texts of all rows, however long.

Training rows have a non-null lang and crc32(doc_id as text) mod 4 other than 2; a null doc_id counts as "".  Null text
and text without a letter is ``und`` with score 0, as is all text if there is nothing to learn from.  Repeated rows get
equal answers, and of equally likely languages the smaller is told.  An empty table gives an empty result.  Only
doc_id, text and lang are read; ``language_filter`` keeps every column, whatever its name, and ``classified`` all but
those whose names its answers take.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veduta.llm.common import free_name, plain, table

BITS, SAMPLE, MOST_LANGS, EPOCHS, LEAST_SCORE = 16, 3000, 200, 3, 0.4


class Grams:
    """text -> (places, counts) of its hashed n-grams; no place for a text without a letter."""

    def __init__(self, bits: int = BITS):
        import sys
        import unicodedata

        import numpy as np

        self.bits, self.size = bits, 1 << bits
        self.letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool)
        self.combining = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)), bool)

    def __call__(self, text: str | None):
        import numpy as np

        c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = self.letter[c]
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c = np.where(letter | self.combining[c], c, 32)
        c = np.concatenate([[32], c, [32]]).astype(np.uint64)
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        mixed, found, h = np.uint64(0x9E3779B97F4A7C15), [], np.zeros(len(c), np.uint64)
        for k in range(min(3, len(c))):
            h = (h[: len(c) - k] * np.uint64(0x100000001B3)) + c[k:] + np.uint64(k + 1)
            own = ((h * mixed) ^ (h >> np.uint64(29))) * mixed >> np.uint64(64 - self.bits)
            found.append((own[c != 32] if k == 0 else own).astype(np.int64))
        counts = np.bincount(np.concatenate(found), minlength=self.size)
        places = np.flatnonzero(counts)
        return places, counts[places]


def _weighed(places, counts, idf):
    import numpy as np

    x = (1 + np.log(counts)) * idf[places]
    return x / (np.sqrt((x * x).sum()) or 1)


def ftrl(rows: list, labels, n_labels: int, size: int, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 1):
    """Weights (labels x size) and intercepts from (places, values) rows."""
    import numpy as np

    z, n = np.zeros((n_labels, size + 1)), np.zeros((n_labels, size + 1))
    penalty = np.full(size + 1, l1)
    penalty[size] = 0  # the intercept
    order = np.random.default_rng(seed)

    def weights(at):
        own, p = z[:, at], penalty[at]
        return np.where(np.abs(own) <= p, 0, (np.sign(own) * p - own) / ((beta + np.sqrt(n[:, at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = w @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = p[:, None] * x
            more = np.sqrt(n[:, at] + g * g)
            z[:, at] += g - (more - np.sqrt(n[:, at])) / alpha * w
            n[:, at] += g * g
    w = weights(np.arange(size + 1))
    return w[:, :size], w[:, size]


def temperature(logits, labels) -> float:
    """That minimises the log loss of softmax(logits / t), by golden section over log t."""
    import numpy as np

    def loss(u):
        p = logits / np.exp(u)
        p = p - p.max(axis=1, keepdims=True)
        return float((np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(labels)), labels]).mean())

    if not len(labels):
        return 1.0
    a, b, g = np.log(0.02), np.log(50), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """langs, weights, intercepts, idf, temperature; ``predict`` answers (lang, score)."""

    def __init__(self, langs, weights, intercepts, idf, heat, bits=BITS):
        self.langs, self.weights, self.intercepts, self.idf, self.heat, self.bits, self.grams = langs, weights, intercepts, idf, heat, bits, None

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        self.grams = self.grams or Grams(self.bits)
        places, counts = self.grams(text)
        if not len(places) or not self.langs:
            return "und", 0.0
        p = (self.weights[:, places] @ _weighed(places, counts, self.idf) + self.intercepts) / self.heat
        p = np.exp(p - p.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    import numpy as np

    known = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull())
    per_lang = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    langs = sorted(per_lang)
    size = 1 << bits

    def frequencies(batches):
        grams, df, n = Grams(bits), np.zeros(size + 1, np.int64), 0
        for b in batches:
            for x in b.column(0):
                df[grams(x.as_py())[0]] += 1
                n += 1
        df[size] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["place", "n"])

    if not langs:
        return Model([], np.zeros((0, size)), np.zeros(0), np.zeros(size), 1.0, bits)
    sums = known.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)
    df[sums["place"].to_numpy()] = sums["n"].to_numpy()
    idf = np.log((1 + df[size]) / (1 + df[:size])) + 1

    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, sample / len(langs) / per_lang[k]))])
    chance = (F.xxhash64("doc_id", F.lit("sample")).cast("double") / 2.0**64) + 0.5

    def features(batches):
        grams = Grams(bits)
        for b in batches:
            for i in range(0, len(b), 64):
                both = [grams(x.as_py()) for x in b.column(1)[i : i + 64]]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 64], b.column(2)[i : i + 64], pa.array([x.astype(np.int32) for x, _ in both], pa.list_(pa.int32())), pa.array([y.astype(np.int32) for _, y in both], pa.list_(pa.int32()))], ["place", "lang", "at", "n"])

    chosen = known.where(chance < F.try_element_at(share, F.col("lang"))).select(F.xxhash64("doc_id", F.lit("part")).alias("place"), "text", "lang")
    got = chosen.mapInArrow(features, "place long, lang string, at array<int>, n array<int>").toArrow().sort_by("place")
    rows, labels = [], []
    for at, n, lang in zip(got["at"], got["n"], got["lang"].to_pylist(), strict=True):
        places = at.values.to_numpy()
        if len(places):
            rows.append((places, _weighed(places, n.values.to_numpy(), idf)))
            labels.append(langs.index(lang))
    fit = [i for i in range(len(rows)) if i % 5 or len(rows) < 10]
    rest = [i for i in range(len(rows)) if not (i % 5 or len(rows) < 10)]
    labels = np.array(labels, int)
    w, b = ftrl([rows[i] for i in fit], labels[fit], len(langs), size, epochs)
    heat = temperature(np.array([w[:, rows[i][0]] @ rows[i][1] + b for i in rest]).reshape(len(rest), len(langs)), labels[rest])
    return Model(langs, w.astype(np.float32), b, idf, heat, bits)


def told(model: Model, text: F.Column) -> F.Column:
    """The struct (lang, score) of a text; only texts go to Python, and only answers come back."""

    @arrow_udf("struct<lang string, score double>")
    def answer(texts: pa.Array) -> pa.Array:
        got = [model.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["lang", "score"])

    return answer(text)


def classified(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the predicted language and its score, which replace columns of these names."""
    hidden = free_name(docs, "told")
    rows = docs.withColumn(hidden, told(model, F.col("text")))
    kept = [plain(c) for c in docs.columns if c not in names]
    return rows.select(*kept, F.col(hidden)["lang"].alias(names[0]), F.col(hidden)["score"].alias(names[1]))


def language_filter(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told: not ``und`` and with at least that score."""
    hidden = free_name(docs, "told")
    rows = docs.withColumn(hidden, told(train(docs), F.col("text")))
    return rows.where((F.col(hidden)["lang"] != "und") & (F.col(hidden)["score"] >= least)).select(*[plain(c) for c in docs.columns])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    answer = told(train(docs), F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), answer.alias("told")).select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))
