"""Attribute extraction and synthesis: prompts as aggregates, a provider's answers, cleaning, and the text that is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structured import cleaned
from ..functions.text import stripped, without_nul
from .providers import LanguageModel, asked
from .ranks import small
from .retrieval import SEPARATOR

#: Order of the synthesis's fields, and of classes where sources conflict.
SYNTHESIS_FIELDS = ("libelle", "description_detaillee", "administration_beneficiaire", "prestataire", "siret_prestataire", "date_prestation")
PRIORITY = ("acte_engagement", "avenant", "fiche_navette")
#: Words over which a document's chunks are sent instead of its text, and characters of the start that is sent if nothing is found.
LONG_WORDS, START_CHARS = 5000, 3000


def attribute_catalogue(spark, path: str) -> DataFrame:
    """Catalogue of attributes from a `;` table: classification, position, attribute, output_field, instruction, schema, search."""
    return spark.read.option("header", True).option("sep", ";").option("multiLine", True).csv(path).withColumn("position", F.col("position").cast("int"))


def attribute_prompts(attributes: DataFrame, kind: str = "classification") -> DataFrame:
    """kind, prompt: a JSON skeleton of each class's attributes, then their instructions, in order of position."""
    rows = attributes.groupBy(kind).agg(F.array_sort(F.collect_list(F.struct("position", "attribute", "instruction"))).alias("a"))
    skeleton = F.array_join(F.transform("a", lambda x: F.concat(F.lit('  "'), x["attribute"], F.lit('": ""'))), ",\n")
    orders = F.array_join(F.transform("a", lambda x: x["instruction"]), "\n")
    head = "Extrais les informations suivantes et réponds par un seul objet JSON, sans autre texte :\n{\n"
    return rows.select(kind, F.concat(F.lit(head), skeleton, F.lit("\n}\nConsignes :\n"), orders).alias("prompt"))


def analyzed(docs: DataFrame, attributes: DataFrame, model: LanguageModel, kind: str = "classification", text: str = "text") -> DataFrame:
    """docs with answer, error and structured_data (map, cleaned by class). Empty texts are errors and are not sent; classes without attributes have no answer."""
    prompts = attribute_prompts(attributes, kind)
    rows = docs.join(small(prompts), kind, "left")
    blank = F.length(F.coalesce(F.trim(F.col(text)), F.lit(""))) == 0
    send = rows.where(~blank & F.col("prompt").isNotNull()).withColumn("prompt", F.concat("prompt", F.lit("\n\nContexte : "), F.col(text)))
    keep = rows.where(blank | F.col("prompt").isNull()).withColumns({"answer": F.lit(None).cast("string"), "error": F.when(blank, F.lit("the text is empty"))})
    done = asked(send, "prompt", model).unionByName(keep).withColumn("structured_data", F.from_json("answer", "map<string,string>"))
    return cleaned(done, kind, "structured_data").drop("prompt")


def first_part(text: Column, size: int = 1000) -> Column:
    """The first chunk of a text; null for a blank one."""
    return F.nullif(F.substring(stripped(without_nul(text)), 1, size), F.lit(""))


def searched(semantic: DataFrame, lexical: DataFrame, group: list[str], item: str, k: int, weight: float | None = 0.7) -> DataFrame:
    """The k best items of each group by both lists; by the semantic one alone for a weight of 1, by the lexical one for 0."""
    from .retrieval import hybrid_top_k

    if weight not in (0, 1):
        return hybrid_top_k(semantic, lexical, group, item, k, 0.7 if weight is None else weight)
    rows = semantic if weight else lexical
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), item))
    return rows.select(*group, item, "score", rank.alias("rank")).where(F.col("rank") <= k)


def contexts(docs: DataFrame, hits: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int | None = None, first_chunk: bool = False) -> DataFrame:
    """doc_id, context of every document: its hits (chunk_id, text) by position, joined by a rule and cut; where there are none, the start of its text.

    first_chunk: the document's first chunk goes before hits that lack it.
    """
    own = hits.groupBy(doc_id).agg(F.array_sort(F.collect_set(F.struct("chunk_id", F.col("text").alias("part")))).alias("__hits"))
    rows = docs.select(doc_id, F.col(text).alias("__text")).join(own, doc_id, "left")
    parts = F.transform("__hits", lambda h: h["part"])
    if first_chunk:
        parts = F.when(F.exists("__hits", lambda h: h["chunk_id"] == 0), parts).otherwise(F.concat(F.array(first_part(F.col("__text"))), parts))
    whole = F.coalesce(F.array_join(parts, SEPARATOR), F.substring("__text", 1, START_CHARS))
    return rows.select(doc_id, (whole if most is None else F.substring(whole, 1, most)).alias("context"))


def attribute_hits(chunks: DataFrame, attributes: DataFrame, text: str = "text", most: int = 1000) -> DataFrame:
    """chunks with the attribute of each search text that they hold, a row for each: one look at a chunk, as the catalogue (attribute, search; at most `most` rows, more are an error) goes along as a value."""
    known = attributes.select("attribute", "search").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"over {most} attributes")
    if not known:
        return chunks.withColumn("attribute", F.lit(None).cast("string")).where("false")
    wanted = F.array(*[F.when(F.contains(text, F.lit(a.search)), F.lit(a.attribute)) for a in known])
    return chunks.withColumn("attribute", F.explode(F.array_compact(wanted)))


def attribute_contexts(docs: DataFrame, hits: DataFrame, attributes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, context: the contexts of each attribute's hits (attribute, chunk_id, text), by the attributes' positions, a line between.

    The first attribute's context begins with the document's first chunk. A document without hits for an attribute has its start there.
    """
    wanted = small(attributes.select("attribute", "position"))
    first = attributes.agg(F.min("position")).first()[0]
    own = hits.join(wanted, "attribute").groupBy(doc_id, "position").agg(F.array_sort(F.collect_set(F.struct("chunk_id", F.col("text").alias("part")))).alias("found"))
    own = own.groupBy(doc_id).agg(F.map_from_entries(F.collect_list(F.struct("position", "found"))).alias("by"))
    all_positions = F.array(*[F.lit(r[0]) for r in attributes.select("position").distinct().orderBy("position").collect()])  # a catalogue of attributes
    rows = docs.select(doc_id, F.col(text).alias("__text")).join(own, doc_id, "left")
    start = first_part(F.col("__text"))

    def one(p: Column) -> Column:
        found = F.try_element_at("by", p)
        parts = F.transform(found, lambda h: h["part"])
        lacks = (p == first) & ~F.exists(found, lambda h: h["chunk_id"] == 0)
        return F.coalesce(F.array_join(F.when(lacks, F.concat(F.array(start), parts)).otherwise(parts), SEPARATOR), F.substring("__text", 1, START_CHARS))

    return rows.select(doc_id, F.array_join(F.transform(all_positions, one), "\n").alias("context"))


def content(docs: DataFrame, found: DataFrame, words: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with content and is_embedded: the found context of documents of over LONG_WORDS words, the text of the others."""
    rows = docs.join(found.select(doc_id, F.col("context").alias("__context")), doc_id, "left").withColumn("is_embedded", F.coalesce(words > LONG_WORDS, F.lit(False)))
    return rows.withColumn("content", F.when(F.col("is_embedded"), F.col("__context")).otherwise(F.col(text))).drop("__context")


def synthesis_inputs(docs: DataFrame, key: str, name: str, kind: str, data: str) -> DataFrame:
    """key, field, prompt: for each field of the synthesis the documents of a key as JSON lines, by class priority and name."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col(kind))
    line = F.to_json(F.struct(F.col(name).alias("filename"), F.col(kind).alias("classification"), F.col(data).alias("data")))
    rows = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.when(rank > 0, rank).otherwise(len(PRIORITY) + 1).alias("rank"), F.col(name).alias("name"), line.alias("line")))).alias("d"))
    body = F.array_join(F.transform("d", lambda x: x["line"]), "\n")
    return rows.select(key, F.explode(F.array(*[F.lit(f) for f in SYNTHESIS_FIELDS])).alias("field"), body.alias("body")).select(key, "field", F.concat(F.lit("Champ à consolider : "), F.col("field"), F.lit("\nDocuments :\n"), F.col("body")).alias("prompt"))


def synthesis_value(answer: Column, field: Column) -> Column:
    """The value of an answer of any of three shapes: {"valeur": v}, {field: {"valeur": v}} or {field: v}; null if none fits."""
    whole = F.from_json(answer, "map<string,string>")
    inner = F.try_element_at(whole, field)
    return F.coalesce(F.try_element_at(whole, F.lit("valeur")), F.try_element_at(F.from_json(inner, "map<string,string>"), F.lit("valeur")), F.when(~F.coalesce(inner, F.lit("")).startswith("{"), inner))


def synthesized(answers: DataFrame, key: str) -> DataFrame:
    """key and a column for each field of the synthesis."""
    value = synthesis_value(F.col("answer"), F.col("field"))
    return answers.groupBy(key).pivot("field", list(SYNTHESIS_FIELDS)).agg(F.first(value))
