"""The cleaning step before a dataset row is written: prepare, clean by a model or by
the local fallback, measure. The model is a plug: any function from a list of prompts to
a list of (answer, input tokens, output tokens) or of exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import convert as C
from scriptoria.functions import text as T
from scriptoria.plans import sqlkit as Q
from scriptoria.session import spread, table

QUERIES: dict = {}
ORACLES: dict = {}

# Fixed value: the answer by which a model says that it did not write Italian.
LANGUAGE_ERROR = "ERRORE_LINGUA_NON_ITALIANA"
CLEAN, SUMMARY = "clean", "summary"


@dataclass(frozen=True)
class Variant:
    """One row of the parameter sweep."""

    head: int = 7
    tail: int = 7
    ocr: str = "auto"
    output_tokens: int = 350
    chunk_chars: int = 1000
    input_chars: int = 1000
    output_chars: int = 2500
    filter_blocks: bool = False
    system_prompt: str = CLEAN
    user_prompt: str = CLEAN
    reprocess_all: bool = False
    check_sequence: bool = True
    max_chunks: int = 1
    max_attempts: int = 1


# The parameters of the two pipelines and of the four variants.
VARIANTS = {
    "A": Variant(),
    "B": Variant(5, 3, "rapidocr", 180, 750, 750, 900, True, SUMMARY, SUMMARY),
    "VF": Variant(5, 3, reprocess_all=True, check_sequence=False),
    "VL": Variant(output_tokens=180, input_chars=750, output_chars=900, reprocess_all=True, check_sequence=False),
    "VO": Variant(ocr="rapidocr", reprocess_all=True, check_sequence=False),
    "VP": Variant(system_prompt=SUMMARY, reprocess_all=True, check_sequence=False),
}

Model = Callable[[list[str]], list]


def prompts(text: str, v: Variant):
    """The chunks a text is sent in: lines cleaned, blocks chosen, cut to the input limit.
    Line cleaning removes blank lines, so block choice sees one block; as published."""
    clean = T.preclean(text)
    chosen = T.filter_blocks(clean, v.input_chars) if v.filter_blocks else T.select_blocks(clean, v.input_chars)
    return F.slice(T.chunks(chosen, v.chunk_chars), 1, v.max_chunks)


def local_fallback(text: str, v: Variant):
    """The cleaned text cut to the output limit."""
    return T.truncate_unit(T.preclean(text), v.output_chars)


def clean_texts(df: DataFrame, id_: str, text: str, v: Variant = VARIANTS["A"], model: Model | None = None, price: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(id, testo, fallback_locale, errore_tecnico, tokens, costs, averages).

    Without a model, or where it raises, the local fallback answers and fallback_locale
    is 1, with no error. An empty answer or the language error code is an error with
    empty text and no fallback. Null and blank texts have the error that no text is
    available. The model is called once a batch of rows, never inside an expression.
    """
    src = spread(df.select(F.col(id_).alias("id"), F.col(text).alias("__t")))
    x = src.select("id", prompts("__t", v).alias("prompts"), local_fallback("__t", v).alias("local"))
    if model is None:
        y = x.select(
            "id",
            "local",
            F.array().cast("array<string>").alias("answers"),
            F.lit(True).alias("failed"),
            F.lit(0).cast("bigint").alias("input_tokens"),
            F.lit(0).cast("bigint").alias("output_tokens"),
            F.size("prompts").alias("num_chunk_llm"),
        )
    else:
        kind = x.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for id0, ps, local in zip(b["id"], b["prompts"], b["local"]):
                    try:
                        got = model(list(ps)) if local else []
                        bad = next((g for g in got if isinstance(g, Exception)), None)
                        if bad is not None:
                            raise bad
                        out.append((id0, local, [str(g[0] or "") for g in got], False, sum(int(g[1]) for g in got), sum(int(g[2]) for g in got), len(ps)))
                    except Exception:  # noqa: BLE001
                        out.append((id0, local, [], True, 0, 0, len(ps)))
                yield pd.DataFrame(out, columns=["id", "local", "answers", "failed", "input_tokens", "output_tokens", "num_chunk_llm"])

        y = x.mapInPandas(run, f"id {kind}, local string, answers array<string>, failed boolean, input_tokens bigint, output_tokens bigint, num_chunk_llm int")
    joined = T.truncate_unit(T.output_clean(F.array_join("answers", "\n\n")), v.output_chars)
    none = F.length("local") == 0
    y = y.withColumn("clean", joined).withColumn(
        "errore_tecnico",
        F.when(none, "Testo non disponibile per atto")
        .when(F.col("failed"), "")
        .when(F.exists("answers", lambda a: T.strip(a) == LANGUAGE_ERROR), LANGUAGE_ERROR)
        .when(F.length("clean") == 0, "Risposta LLM vuota")
        .otherwise(""),
    )
    n, i, o = F.col("num_chunk_llm"), F.col("input_tokens"), F.col("output_tokens")
    ok = F.col("errore_tecnico") == ""
    return y.select(
        "id",
        F.when(~ok, "").when(F.col("failed"), F.col("local")).otherwise(F.col("clean")).alias("testo"),
        (ok & F.col("failed")).cast("int").alias("fallback_locale"),
        "errore_tecnico",
        "num_chunk_llm",
        "input_tokens",
        "output_tokens",
        (i + o).alias("total_tokens"),
        C.cost(i, F.lit(price[0])).alias("costo_input"),
        C.cost(o, F.lit(price[1])).alias("costo_output"),
        F.round(i / 1000 * price[0] + o / 1000 * price[1], 6).alias("costo_totale"),
        C.average(i, n).alias("avg_input_tokens_per_chunk"),
        C.average(o, n).alias("avg_output_tokens_per_chunk"),
        C.average(i + o, n).alias("avg_total_tokens_per_chunk"),
    )


_PC = Q.preclean("txt")


def clean_local(s, d):
    """Scanned texts through the cleaning step with the local fallback."""
    x = clean_texts(table(s, d, "txt_opendataloader"), "txt_id", "txt")
    return x.select(F.col("id").alias("txt_id"), "testo", "fallback_locale", "errore_tecnico")


QUERIES["clean_local"] = clean_local
ORACLES["clean_local"] = (
    f"SELECT txt_id, {Q.truncate('pc', '2500')} AS testo, CAST(pc <> '' AS INT) AS fallback_locale, CASE WHEN pc = '' THEN 'Testo non disponibile per atto' ELSE '' END AS errore_tecnico FROM (SELECT txt_id, {_PC} AS pc FROM txt_opendataloader)"
)
