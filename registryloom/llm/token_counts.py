"""Token counts of whole texts, encoded once per distinct content and kept in a digest cache.

A text's normalised content and the tokenizer's version each have a digest. The cache is a folder
of Parquet files by version, with a count for each content digest; a batch joins its distinct
digests to it, encodes one text for each digest that it lacks, and appends those counts. Texts of
known content are neither moved nor encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registryloom.llm.common import saved, small_batches
from registryloom.llm.words import held, string_chunks

#: Up to so many digests of 32 bytes are broadcast to pick the texts to encode; beyond, the texts
#: are reduced to one a digest first and join the digests by shuffle.
MAX_BROADCAST_DIGESTS = 100_000
#: Bytes of text that are encoded at once, unless one text is longer.
ENCODE_BYTES = 500_000
#: Bytes of stretches whose counts a worker keeps at hand.
MEMO_BYTES = 16_000_000
#: Goes into every version digest; raise it whenever ``content`` changes.
CONTENT_VERSION = 1
_BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer's file content: ``tokenizers`` reads ``json``, ``sentencepiece`` reads ``model``."""

    kind: str
    content: bytes

    @classmethod
    def load(cls, path: str) -> TokenizerFile:
        kind = Path(path).suffix.removeprefix(".")
        if kind not in ("json", "model"):
            raise ValueError(f"a tokenizer file ends in .json or .model: {path}")
        return cls(kind, Path(path).read_bytes())

    @property
    def library(self) -> str:
        return "tokenizers" if self.kind == "json" else "sentencepiece"

    @property
    def version(self) -> str:
        """Digest of all that a count depends on besides the text."""
        rules = [self.library, version(self.library), str(CONTENT_VERSION), str(self.drops_blanks)]
        return hashlib.sha256("\n".join(rules).encode() + b"\n" + self.content).hexdigest()

    @property
    def drops_blanks(self) -> bool:
        """Whether blanks only part words, so that how many there are and of which kind is all one."""
        return self.kind == "json" and _drops_blanks(self.content)


@cache
def _drops_blanks(content: bytes) -> bool:
    """True if blanks become one space first and the word pattern then leaves them out."""
    spec = json.loads(content)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    one_space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in steps
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    parted = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    plain = not any(c in a["content"] for a in spec["added_tokens"] for c in " \t\n\v\f\r")
    return one_space and parted and plain and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern


class TextCounter:
    """Numbers of tokens as the tokenizer's own library gives them."""

    def __init__(self, tokenizer: TokenizerFile):
        self.by_stretch = tokenizer.drops_blanks
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.size = 0
        if tokenizer.kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(tokenizer.content.decode())
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer.content)
            self.encode = lambda texts: [len(i) for i in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]

    def _learn(self, wanted: set[str]) -> None:
        if self.size > MEMO_BYTES:  # what is not met again until the next time goes
            self.older, self.known, self.size = self.known, {}, 0
        missing = wanted - self.known.keys()
        again = missing & self.older.keys()
        new = list(missing - again)
        self.known.update((s, self.older[s]) for s in again)
        self.known.update(zip(new, self.encode(new)))
        self.size += sum(map(len, missing)) + 150 * len(missing)

    def count(self, texts: Sequence[str]) -> list[int]:
        if not self.by_stretch:
            return self.encode(list(texts))
        split = [t.split(" ") for t in texts]
        self._learn(set().union(*split))
        return [sum(map(self.known.__getitem__, s)) for s in split]


def content(text: Column, tokenizer: TokenizerFile) -> Column:
    """What a text's count depends on; a null text is empty.

    For a tokenizer that drops blanks, runs of them are one space and outer ones go; for all
    others it is the text itself.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, _BLANKS, " ")) if tokenizer.drops_blanks else text


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestCache:
    """Stored counts in ``folder``, one subfolder a tokenizer version."""

    schema = "digest binary, n_tokens bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, tokenizer: TokenizerFile) -> str:
        return f"{self.folder}/{tokenizer.version}"

    def read(self, tokenizer: TokenizerFile) -> DataFrame:
        """``digest, n_tokens``; runs side by side may have stored a digest twice."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(tokenizer))
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._place(tokenizer))

    def append(self, tokenizer: TokenizerFile, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self._place(tokenizer))


def encode_texts(texts: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """``digest, n_tokens`` for each row of ``digest, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(tokenizer, lambda: TextCounter(tokenizer))
        for batch, texts in string_chunks(batches, "content", ENCODE_BYTES):
            counts = pa.array(counter.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    return small_batches(texts).select("digest", "content").mapInArrow(run, DigestCache.schema)


def misses_of(rows: DataFrame, missing: DataFrame, n_missing: int, n_distinct: int) -> DataFrame:
    """One ``digest, content`` of ``rows`` for each of the ``missing`` digests out of all distinct ones."""
    few = n_missing <= MAX_BROADCAST_DIGESTS and n_missing < n_distinct
    if few:
        rows = rows.join(F.broadcast(missing), "digest", "left_semi")
    # Each task keeps one text a digest before it sends any, so thousands of copies meet as a few.
    one = rows.groupBy("digest").agg(F.first("content").alias("content"))
    return one if few or n_missing == n_distinct else one.join(missing, "digest", "left_semi")


def count_tokens(
    docs: DataFrame, tokenizer: TokenizerFile, stored: DigestCache, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_bytes, n_tokens, cached`` per row of ``docs``; new contents are added to the cache.

    Counts are those of the tokenizer's library without begin, end or added special tokens;
    special strings inside texts are whatever the library makes of them. ``n_bytes`` is the UTF-8
    length of the text as it is; a null text is empty and has no tokens. ``cached`` tells whether
    the cache held the count before this run. Repeated rows and null keys pass through, other
    columns are ignored, an empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        content(F.col(text), tokenizer).alias("content"),
    ).withColumn("digest", _digest(F.col("content")))
    held = saved(rows.select("key", "n_bytes", "digest"))
    distinct = held.select("digest").distinct()
    looked_up = distinct.join(stored.read(tokenizer), "digest", "left")
    looked_up = saved(looked_up.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    missing = looked_up.filter(F.col("n_tokens").isNull()).select("digest")
    known = looked_up.filter(F.col("n_tokens").isNotNull()).withColumn("cached", F.lit(True))
    n_distinct, n_missing = looked_up.agg(F.count(F.lit(1)), F.count_if(F.col("n_tokens").isNull())).first()
    if n_missing:
        texts = misses_of(rows.select("digest", "content"), missing, n_missing, n_distinct)
        new = saved(encode_texts(texts, tokenizer))
        stored.append(tokenizer, new)
        known = known.unionByName(new.withColumn("cached", F.lit(False)))
    out = held.join(known, "digest").select("key", "n_bytes", "n_tokens", "cached")
    return out.withColumnRenamed("key", key)
