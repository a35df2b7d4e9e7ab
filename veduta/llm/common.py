"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and the ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"
#: Code points on which the ``regex`` module and the tokenizers' own splitter are known to agree.
_PLAIN = regex.compile(r"[^\x00-\x1b\x20-ɏ‐-‧€]")
SPECIAL = "<|endoftext|>"
#: Rows of a table that is joined by broadcast, about 10 MB.
MOST_BROADCAST = 200_000
_FOLDERS: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: the session's ``spark.checkpoint.dir``, or where that is unset, a local one.

    A local one serves only a local master; elsewhere executors would write to folders of their own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark not in _FOLDERS:
        _FOLDERS[spark] = tempfile.mkdtemp(prefix="tables-")
    return _FOLDERS[spark]


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: lost executors cost no recomputation.

    The columns must have names and types that Parquet knows.  ``release`` deletes the table.
    """
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(conf).delete(path, True)


def attached(rows: DataFrame, info: DataFrame, key: str, most: int = MOST_BROADCAST, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``info``, which has one row for each value of ``key`` and is a written table.

    Its size is checked: up to ``most`` rows, eight characters of ``key`` counting as one, it is broadcast; beyond that
    each of its rows is repeated for every salt, so that the rows of one key meet it in as many tasks.  Keys may be null.
    """
    own, more = f"__of_{key}", [c for c in info.columns if c != key]
    right = info.withColumnRenamed(key, own)
    r = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col(own).cast("string"))), F.lit(0)).alias("chars")).first()
    same = F.col(key).eqNullSafe(F.col(own))
    if r["n"] + r["chars"] // 8 <= most:
        return rows.join(F.broadcast(right), same).select(*rows.columns, *more)
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, same & (F.col("__salt") == F.col("__salt_of"))).select(*rows.columns, *more)


def grouped_rows(rows: DataFrame, groups: DataFrame, key: str, size: str, hint: str | None = None) -> DataFrame:
    """``rows`` joined to their ``groups`` (one row a ``key``, with the number of its rows in ``size``).

    Both come from written tables, as each is read twice.  Groups with over a thousandth of all rows, fewer than a
    thousand by that, are broadcast, so that their rows stay where they are; the others meet by key, as ``hint`` says.
    Which are which is told by hashes of these keys.  Rows without a group are left out, as are null keys.
    """
    least = max(100, rows.count() // 1000)
    own, more = f"__{key}", [c for c in groups.columns if c != key]
    right, same = groups.withColumnRenamed(key, own), F.col(key) == F.col(own)
    hot = [r[0] for r in groups.where(F.col(size) > least).select(F.xxhash64(key)).collect()]
    meet = lambda a, b: a.join(b, same).select(*rows.columns, *more)
    cold = lambda c: ~F.xxhash64(c).isin(hot)
    if not hot:
        return meet(rows, right.hint(hint) if hint else right)
    few = right.where(cold(own))
    there = meet(rows.where(~cold(key)), F.broadcast(right.where(~cold(own))))
    return there.unionByName(meet(rows.where(cold(key)), few.hint(hint) if hint else few))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = f"__{name}", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def repeated(rows: DataFrame, key: str = "doc_id") -> bool:
    """Whether a value of ``key``, null included, stands in several rows."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in ``kept`` (doc_id and text_hash, the xxhash64 of the text), one for each."""
    right = cut(kept.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    # The columns travel as one struct, so that their names clash with none of these.
    own = docs.select(F.col("doc_id").alias("__of"), F.xxhash64("text").alias("__own"), F.struct(*[plain(c) for c in docs.columns]).alias("__doc"))
    out = own.join(right, F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_semi")
    if repeated(docs):  # perhaps rows equal in doc_id and text
        out = out.dropDuplicates(["__of", "__own"])
    return out.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


class Splitter:
    """Cuts text into the pre-tokens of a byte-level BPE tokenizer file, special strings apart.

    ``fast`` names the same vocabulary as ranks, whose library encodes plain text several times faster with the same
    ids.  Texts with a special string, or with code points on which the two splitters could differ, or with very long
    unbroken runs go to the tokenizer itself.
    """

    RUN = regex.compile(r"\s{4000}|[^\s]{4000}")

    def __init__(self, path: str, fast: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.pattern = regex.compile(PATTERN)
        if fast:
            import base64

            import tiktoken

            with open(fast, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> list[str]:
        if _PLAIN.search(text) is None:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if SPECIAL not in text:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL] * bool(i) + self._plain(part)
        return out

    def _easy(self, text: str) -> bool:
        return bool(self.fast) and SPECIAL not in text and _PLAIN.search(text) is None and not (len(text) >= 4000 and self.RUN.search(text))

    def ids(self, text: str):
        """The token ids of a text."""
        import numpy as np

        if self._easy(text):
            return np.asarray(self.fast.encode_to_numpy(text), dtype="<u4")
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def counts(self, pretokens: list[str]) -> list[int]:
        """The number of pieces of each."""
        encode, slow = self.fast and self.fast.encode_ordinary, self.tokenizer.encode
        return [len(encode(x)) if self._easy(x) else len(slow(x, add_special_tokens=False)) for x in pretokens]
