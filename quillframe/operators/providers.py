"""Language model, OCR and embedding providers: interfaces, deterministic offline stand-ins, and the maps over rows that call them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


from .retries import with_retries

UNKNOWN = "Non classifié"


class LanguageModel(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def echo_model(prompts: list[str]) -> list[str]:
    """Stand-in: an answer that depends on the prompt alone."""
    return [json.dumps({"classification": [p.rsplit(": ", 1)[-1][:20]], "length": len(p)}) for p in prompts]


def hash_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Stand-in: unit vectors of hashed words."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            d = hashlib.sha256(w.encode()).digest()
            v[d[0] % size] += 1.0 if d[1] % 2 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def asked(rows: DataFrame, prompt: str, model: LanguageModel, batch: int = 16) -> DataFrame:
    """rows with answer and error: the model's text for each prompt, in batches of each partition; busy and failing servers are asked again, a batch that keeps failing has its error in each row."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers: list = []
            for at in range(0, len(pdf), batch):
                some = pdf[prompt].iloc[at : at + batch].tolist()
                try:
                    answers += [(a, None) for a in with_retries(lambda x=some: model(x))]
                except Exception as e:  # goes to the rows it concerns
                    answers += [(None, f"{type(e).__name__}: {e}")] * len(some)
            yield pdf.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return rows.mapInPandas(ask, StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


def embedded(rows: DataFrame, text: str, embedder: Embedder, size: int, batch: int = 16, retries: int = 3) -> DataFrame:
    """rows with embedding and embedding_error: vectors of the right size, in order; zeros, and why, where the embedder keeps failing."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            errors: list = []
            for at in range(0, len(pdf), batch):
                some = pdf[text].fillna("").iloc[at : at + batch].tolist()
                found, error = None, None
                for _ in range(retries):
                    try:
                        found = with_retries(lambda x=some: embedder(x))
                        break
                    except Exception as e:  # goes to the rows it concerns
                        error = f"{type(e).__name__}: {e}"
                if found is None or len(found) != len(some):
                    found, error = [[]] * len(some), error or "vectors are missing"
                out += [v if len(v) == size else [0.0] * size for v in found]
                errors += [None if len(v) == size else error or "the vector has another size" for v in found]
            yield pdf.assign(embedding=out, embedding_error=errors)

    return rows.mapInPandas(embed, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("embedding_error", StringType())]))


def classification_prompt(text: Column, classes: list[str]) -> Column:
    return F.concat(F.lit("Classes:\n" + "\n".join(f"- {c}" for c in classes) + "\nDocument: "), F.substring(text, 1, 2000))


def mapped_answer(answers: Column, keys: dict[str, str]) -> Column:
    """The key of the first answer that the catalogue (name to key) has."""
    known = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    found = F.filter(F.transform(answers, lambda a: F.try_element_at(known, a)), lambda k: k.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(UNKNOWN))


def response_schema(attributes: list[dict]) -> dict:
    """JSON schema of a class's attributes (output_field, schema); a nullable string where none is given; every field required."""
    fields: dict[str, dict] = {}
    for a in attributes:
        schema = a.get("schema") or {"type": ["string", "null"]}
        if not isinstance(schema, dict):
            raise ValueError(f"{a['output_field']}: the schema is not an object")
        fields[a["output_field"]] = schema
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def spark_type(schema: dict) -> str:
    """Spark SQL type of a JSON schema; unions are VARIANT."""
    if "oneOf" in schema or "anyOf" in schema:
        return "variant"
    kind = schema.get("type", "string")
    kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
    if kind == "object":
        return "struct<" + ",".join(f"`{k}`:{spark_type(v)}" for k, v in schema.get("properties", {}).items()) + ">"
    if kind == "array":
        return f"array<{spark_type(schema.get('items', {}))}>"
    return {"integer": "bigint", "number": "double", "boolean": "boolean", "null": "void"}.get(kind, "string")


def decoded(rows: DataFrame, schema: dict, answer: str = "answer", into: str = "data", error: str = "error") -> DataFrame:
    """rows with `into`: the answer's JSON by the type that the schema gives, and an error where there was none but the answer is no such object or lacks required fields.

    Text around the object (a model's remarks, a fenced block) is cut off. Null answers stay null.
    """
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    value = F.try_parse_json(F.nullif(body, F.lit("")))
    missing = F.array_compact(F.array(*[F.when(F.try_variant_get(value, f"$['{k}']", "variant").isNull(), F.lit(k)) for k in schema.get("required", [])]))
    wrong = F.when(F.col(answer).isNotNull() & value.isNull(), "the answer is no JSON object").when(value.isNotNull() & (F.size(missing) > 0), F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    data = F.when(value.isNotNull(), F.from_json(body, spark_type(schema)))
    return rows.withColumns({into: data, error: F.coalesce(F.col(error), wrong) if error in rows.columns else wrong})


def page_marked(pages: Column) -> Column:
    """Pages of a scan, each between numbered marks."""
    n = F.size(pages).cast("string")
    mark = lambda p, i: F.concat(F.lit("[[PAGE "), (i + 1).cast("string"), F.lit(" / "), n, F.lit("]]\n"), p, F.lit("\n[[FIN PAGE "), (i + 1).cast("string"), F.lit(" / "), n, F.lit("]]"))
    return F.array_join(F.transform(pages, mark), "\n\n")


