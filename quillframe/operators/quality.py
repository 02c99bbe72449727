"""Extraction quality: matches in long form, accuracies, errors and confusion counts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.compare import Rule, both, exact
from ..functions.structured import at_path
from .providers import LanguageModel
from .retries import with_retries


#: Keys, each with the maps of both sides, that one task joins about.
PER_TASK = 20_000


def compared(found: DataFrame, truth: DataFrame, key: str, names: list[str], rules: dict[str, Rule] | None = None) -> DataFrame:
    """key, position, field, match: a row for each field of the keys that both sides have."""
    rules = rules or {}
    rows = found.alias("a").join(truth.alias("b"), key)
    items = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), rules.get(n, exact)(F.col(f"a.{n}"), F.col(f"b.{n}")).alias("match")) for i, n in enumerate(names)]
    return rows.select(key, F.explode(F.array(*items)).alias("f")).select(key, "f.*")


def by_row(found: DataFrame, truth: DataFrame, row: str = "row_id") -> DataFrame:
    """Both sides of the rows that share a place, as structs found and truth. The place is a column that each side brings along; one that repeats is an error."""
    once = lambda df, side: df.groupBy(row).agg(F.count("*").alias("n"), F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != row])).alias(side)).withColumn(side, F.when(F.col("n") == 1, F.col(side)).otherwise(F.raise_error(F.concat(F.lit(f"{side} repeats row "), F.col(row).cast("string"))))).drop("n")
    return once(found, "found").join(once(truth, "truth"), row)


def field_value(data: Column, name: str) -> Column:
    """A field of a map of texts; of a path with `*` the JSON list of what the items of the map's JSON list have there."""
    head, star, tail = name.partition(".*.")
    return values_at(items_of(data, head), tail) if star else F.try_element_at(data, F.lit(name))


def items_of(data: Column, head: str) -> Column:
    """The items of a map's JSON list. As a column of its own it is parsed once for all values_at() of it."""
    return F.try_variant_get(F.try_parse_json(F.try_element_at(data, F.lit(head))), "$", "array<variant>")


def values_at(items: Column, tail: str) -> Column:
    """The JSON list of what items_of() have at a path."""
    return F.to_json(F.transform(items, lambda x: at_path(x, tail, "variant")), {"ignoreNullFields": "false"})


def compared_by_class(found: DataFrame, truth: DataFrame, key: str, kind: str, data: str, rules: dict[str, dict[str, Rule]]) -> DataFrame:
    """key, kind, position, field, match: a row for each field of the class of each key that both sides have; the class is the truth's.

    data: map of texts (nested values as JSON). Classes without rules and null classes have no rows; null maps are empty.
    The join has a task for every PER_TASK keys, so that what one sorts doesn't grow with the tables.
    """
    mine, theirs = found.select(key, F.col(data).alias("__a")), truth.select(key, kind, F.col(data).alias("__b"))
    tasks = -(-max(mine.select(key).agg(F.count("*")).first()[0], theirs.select(key).agg(F.count("*")).first()[0]) // PER_TASK)
    if tasks > int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        mine, theirs = mine.repartition(tasks, key), theirs.repartition(tasks, key)
    rows = mine.join(theirs, key)
    parts = []
    for name, fields in rules.items():
        mine = rows.where(F.col(kind) == name)
        items = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), F.coalesce(rule(field_value(F.col("__a"), n), field_value(F.col("__b"), n)), F.lit(False)).alias("match")) for i, (n, rule) in enumerate(fields.items())]
        parts.append(mine.select(key, kind, F.explode(F.array(*items)).alias("f")).select(key, kind, "f.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What a judge is told to weigh, by subject.
_SUBJECTS = {
    "object": "deux objets de marché ; les synonymes, les formulations voisines et l'essentiel du contenu comptent, pas la forme",
    "administration": "deux administrations bénéficiaires ; les synonymes, les sigles connus, les services d'une même administration et leur territoire comptent",
}


def judge(model: LanguageModel, subject: str, batch: int = 16) -> Rule:
    """A rule that asks a model whether two texts mean the same. Two empty ones do, one empty one does not, and neither is sent; an answer that is no JSON, or none after retries, is a difference."""

    @F.pandas_udf(BooleanType())
    def answers(prompts: pd.Series) -> pd.Series:
        out, send = pd.Series([False] * len(prompts), index=prompts.index), prompts.dropna()
        for at in range(0, len(send), batch):
            some = send.iloc[at : at + batch]
            try:
                got = with_retries(lambda x=some.tolist(): model(x))
            except Exception:  # no answer is a difference
                continue
            for i, text in zip(some.index, got or ()):
                try:
                    out[i] = json.loads(text).get("sont_equivalentes") is True
                except (TypeError, ValueError, AttributeError):
                    pass
        return out

    def rule(a: Column, b: Column) -> Column:
        prompt = F.concat(F.lit(f"Compare {_SUBJECTS[subject]}.\nValeur extraite : "), a, F.lit("\nValeur de référence : "), b, F.lit('\nRéponds par un seul objet JSON : {"sont_equivalentes": true ou false, "explication": "..."}'))
        some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
        return answers(F.when(some, prompt))

    return both(rule, lambda x: F.coalesce(x, F.lit("")) == "")


def field_accuracy(matches: DataFrame) -> DataFrame:
    """field, total, matches, errors, accuracy."""
    n = F.count_if("match")
    return matches.groupBy("field").agg(F.count("*").alias("total"), n.alias("matches"), (F.count("*") - n).alias("errors"), F.round(n / F.count("*"), 6).alias("accuracy"))


def global_accuracy(matches: DataFrame) -> DataFrame:
    return matches.agg(F.round(F.count_if("match") / F.count("*"), 6).alias("accuracy"), F.count("*").alias("total"))


def errors_of_each(matches: DataFrame, key: str) -> DataFrame:
    """key, errors: the fields in error, in their order."""
    wrong = F.array_sort(F.collect_list(F.when(~F.col("match"), F.struct("position", "field"))))
    return matches.groupBy(key).agg(F.array_join(F.transform(wrong, lambda x: x["field"]), ",").alias("errors"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def recall_of_each(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, total, correct, recall."""
    n = F.count_if(F.col(truth).eqNullSafe(F.col(predicted)))
    return rows.groupBy(truth).agg(F.count("*").alias("total"), n.alias("correct"), F.round(n / F.count("*"), 6).alias("recall"))


def against_best(now: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """field, regressions (matched in best, not now), improvements, delta of accuracy."""
    a = now.select(key, "field", F.col("match").alias("now"))
    b = best.select(key, "field", F.col("match").alias("best"))
    share = lambda c: F.count_if(c) / F.count("*")
    return a.join(b, [key, "field"]).groupBy("field").agg(F.count_if(F.col("best") & ~F.col("now")).alias("regressions"), F.count_if(F.col("now") & ~F.col("best")).alias("improvements"), F.round(share("now") - share("best"), 6).alias("delta"))
