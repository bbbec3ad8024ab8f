"""Mixing sources to target token shares with capped repetition.

Plan. One Arrow pass counts tokens; sources are summed with map-side partial
aggregation; the repetition rates, one row a mix and source, join back to the
documents, each of which comes out floor(rate) times and once more with the rate's
fraction as probability, drawn from a hash of document and mix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import small
from scriptoria.llm.quotas import draw
from scriptoria.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SALT = "miscela"
# Fixed value: the pre-tokenisation pattern that belongs to that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The byte-level BPE tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_key(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, runs of blanks as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", "_")


def token_counts(docs: DataFrame, doc_id: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) with the source's one spelling; null and empty texts
    have no tokens, null and blank sources stay null."""
    src = spread(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.nullif(source_key(F.col(source)), F.lit("")).alias("source"), F.col(text).alias("text")
        )
    )
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return src.mapInArrow(run, f"doc_id {kind}, source string, tokens bigint")


def mix_rates(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """The weights (miscela_id, source, peso_pct, max_ripetizioni, dimensione_pct) with
    source_tokens, wanted (in ten-thousandths of a token), rate and capped (the source
    has no more than its share even when repeated as often as it may be).

    The mix's total is dimensione_pct % of the tokens of all documents, those without
    source included. A source without documents has 0 tokens and rate 0. The output
    keeps the weights' own spelling of the source.
    """
    per = small(counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens")))
    total = per.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).first()[0]
    have = per.filter("source is not null").withColumnRenamed("source", "key")
    most = F.col("max_ripetizioni")
    return (
        weights.select("miscela_id", "source", "peso_pct", "max_ripetizioni", "dimensione_pct", source_key(F.col("source")).alias("key"))
        .join(have, "key", "left")
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("wanted", F.lit(total).cast("bigint") * F.col("dimensione_pct").cast("bigint") * F.col("peso_pct").cast("bigint"))
        .withColumn("capped", F.col("source_tokens") * most * 10000 <= F.col("wanted"))
        .withColumn("rate", F.when(F.col("source_tokens") == 0, 0.0).when(F.col("capped"), most.cast("double")).otherwise(F.col("wanted") / 10000 / F.col("source_tokens")))
    )


def mixed(counted: DataFrame, rates: DataFrame) -> DataFrame:
    """(miscela_id, source, doc_id, copia, tokens): every chosen copy of a document,
    numbered from 1: floor(rate) of each, and one more where its draw is below the
    rate's fraction. Repeated doc ids draw the same number and are otherwise separate."""
    per = rates.filter("rate > 0").select("miscela_id", F.col("source").alias("name"), F.col("key").alias("source"), "rate")
    whole = F.floor("rate")
    extra = (draw(SALT, F.col("miscela_id"), F.col("doc_id")) < F.col("rate") - whole).cast("int")
    return (
        counted.join(small(per), "source")
        .withColumn("n", (whole + extra).cast("int"))
        .filter("n > 0")
        .select("miscela_id", F.col("name").alias("source"), "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copia"), "tokens")
    )


def mix_shares(counted: DataFrame, rates: DataFrame) -> DataFrame:
    """(miscela_id, source, peso_pct, wanted_tokens, drawn_tokens, actual_pct, short):
    what each source really gives to its mix; short where it gives all it may and that
    is less than its share."""
    got = mixed(counted, rates).groupBy("miscela_id", "source").agg(F.sum("tokens").alias("drawn_tokens"))
    out = small(rates.join(small(got), ["miscela_id", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0))))
    all_ = out.groupBy("miscela_id").agg(F.sum("drawn_tokens").alias("mix_tokens"))
    return out.join(all_, "miscela_id").select(
        "miscela_id",
        "source",
        "peso_pct",
        (F.col("wanted") / 10000).alias("wanted_tokens"),
        "drawn_tokens",
        (100.0 * F.col("drawn_tokens") / F.nullif(F.col("mix_tokens"), F.lit(0))).alias("actual_pct"),
        (F.col("capped") & (F.col("drawn_tokens") * 10000 < F.col("wanted"))).alias("short"),
    )


def counted_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> DataFrame:
    """token_counts, kept in the checkpoint folder, as rates and mix both read it."""
    return cut(token_counts(docs, doc_id, text, source, path))
