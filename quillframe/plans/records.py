"""Queries over keyed records, extraction prompts and cleaned objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured, text
from ..operators import access, extraction, quality, records, retrieval, workflow
from .documents import WORDS_SQL
from .tables import STEPS_SQL, read, steps_from_events


def null_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments of which some stand for no value."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("nan")).when(F.col("c_custkey") % 3 == 1, F.lit("#")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return records.null_sentinels(c, ["segment"]).where("segment is not null")


def array_contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose list of classes holds the class asked for."""
    kinds = F.when(F.col("n_regionkey") < 2, F.array(F.lit("rib"), F.lit("devis"))).otherwise(F.array(F.lit("ccap")))
    return read(spark, sf_dir, "nation").where(F.array_contains(kinds, "devis")).select("n_name")


def prefix_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("engagements.key"), F.col("o_orderstatus").alias("attachments.status"), "o_totalprice")
    return records.without_prefix(o, ["engagements.key", "attachments.status"], "engagements.", "attachments.")


def target_or_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(records.skipped_unless_target(F.col("event_type"), ("click", "view"), F.lit("SUCCESS")).alias("status")).agg(F.count("*").alias("n"))


def displayed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.groupBy(records.split_displayed(F.col("text"), F.col("lang"), ("en", "fr")).alias("displayed")).agg(F.count("*").alias("n"))


def suffixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations under clashing names."""
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return records.joined_with_suffixes(a, b, "key", "key", ("_a", "_b"))


def key_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (documents) of a list of users (keys) through their bridge, by class."""
    e = read(spark, sf_dir, "events")
    bridge = e.select("user_id", "event_id").distinct()
    asked = records.by_keys(bridge, spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8)], "user_id long").withColumn("user_id", F.col("user_id").cast(dict(e.dtypes)["user_id"])), "user_id")
    return e.select("event_id", "event_type").join(asked, "event_id").orderBy("event_type", "event_id").select("user_id", "event_id", "event_type")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each batch by how they ended."""
    s = F.col("status")
    jobs = workflow.job_status(steps_from_events(spark, sf_dir))
    return jobs.groupBy("batch_id").agg(F.count_if(s != "STARTED").alias("progress"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s == "FAILURE").alias("errors"), F.count("*").alias("total"))


def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct keys of orders, customers and their joins: twelve counters."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    with_orders = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    without = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return records.coverage({"orders": (o, ["o_orderkey", "o_custkey"]), "customers": (c, ["c_custkey", "c_nationkey"]), "joined": (with_orders, ["o_orderkey", "c_custkey"]), "without": (without, ["c_custkey", "c_nationkey"])})


def scopes_and_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge of users and types after later events' pairs are added once each."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), "user_id", "event_id")
    pairs = lambda odd: e.where(F.col("event_id") % 2 == odd).select("scope", "user_id")
    scopes, bridge = records.linked(pairs(0).distinct(), pairs(0).select("scope").distinct(), pairs(1), ["scope"], "user_id")
    return bridge.join(scopes, "scope", "left_semi")


def patched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"))
    return records.patch_values(e, ["kinds", "last_error"])


def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys in batches of a hundred, and each batch's ends."""
    rows = records.id_batches(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)
    return rows.groupBy("batch").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_ids(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


def set_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each user, earlier ones and later ones."""
    e = read(spark, sf_dir, "events")
    sets = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return records.added_to_sets(sets(0), sets(1), "user_id", "kinds").select("user_id", F.array_join("kinds", ",").alias("kinds"))


def set_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    sets = records.sets_edited(F.array(F.col("n_name"), F.lit("X")), F.array(F.lit("B"), F.lit("X")), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.col("n_name"))).otherwise(F.array(F.lit("B"))))
    return n.select("n_nationkey", F.array_join(sets, ",").alias("members"))


def sorted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each event's properties with one more, by key."""
    e = read(spark, sf_dir, "events")
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("a"), F.col("event_type")))
    return e.select("event_id", F.array_join(F.transform(records.sorted_items(props), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("items"))


def backfill_and_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response where it was missing, and a renamed step in a list and a scalar."""
    e = read(spark, sf_dir, "events")
    steps = records.renamed_in(F.array(F.col("event_type"), F.lit("other")), "click", "press")
    return e.select("event_id", F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("old")).alias("response"), F.array_join(steps, ",").alias("steps"), F.when(F.col("event_type") == "click", "press").otherwise(F.col("event_type")).alias("step"))


def bridge_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose list of engagements becomes bridge rows: the suppliers of each order's lines, some null, some repeated."""
    lines = read(spark, sf_dir, "lineitem")
    listed = lines.groupBy("l_orderkey").agg(F.transform(F.collect_list(F.struct("l_suppkey")), lambda x: F.when(x["l_suppkey"] % 4 != 0, x["l_suppkey"])).alias("engagements"))
    return records.expanded(listed, "l_orderkey", "engagements", "l_suppkey")


def close_and_retry_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of stuck batches to run again, once their open jobs are cancelled."""
    steps = steps_from_events(spark, sf_dir)
    jobs = workflow.job_status(steps).withColumn("document_id", F.col("job_id"))
    stuck = workflow.stuck_batches(workflow.batch_status(jobs), steps, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    _, again = records.closed_and_retried(jobs, stuck)
    return again.groupBy("batch_id").agg(F.count("*").alias("n"))


def list_as_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as rows under their headers."""
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.struct("n_name").alias("of")))).alias("items"))
    return n.select("n_regionkey", F.array_join(F.transform(records.table_of(F.col("items"), ["n_nationkey", "of.n_name"]), lambda r: F.array_join(r, "|")), ";").alias("shown"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    found = truth.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("?")).otherwise(F.col("quality")).alias("quality"))
    return quality.compared(found, truth, "doc_id", ["quality"], {})


def one_field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.field_report(_matches(spark, sf_dir), "quality", errors_only=True).select("doc_id", "field")


def error_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded error lists in four forms."""
    n = read(spark, sf_dir, "nation")
    raw = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit('["'), F.col("n_name"), F.lit('", "b"]'))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("['"), F.col("n_name"), F.lit("', 'b']"))).when(F.col("n_nationkey") % 4 == 2, F.concat(F.col("n_name"), F.lit(", b"))).otherwise("nan")
    return n.select("n_nationkey", F.array_join(records.error_list(raw), "/").alias("names"))


def json_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of each event's properties against those of the event before it by id."""
    e = read(spark, sf_dir, "events").select("event_id", structured.json_leaves(F.concat(F.lit('{"p": '), F.coalesce("props", F.lit("null")), F.lit(', "t": ["'), F.col("event_type"), F.lit('"]}'))).alias("leaves"))
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("leaves").alias("old"))
    d = structured.leaf_diff(F.col("old"), F.col("leaves"))
    return e.join(before, "event_id").select("event_id", F.array_join(d["only_a"], ",").alias("only_a"), F.array_join(d["only_b"], ",").alias("only_b"), F.array_join(d["changed"], ",").alias("changed"))


def attribute_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as attributes of their region's class."""
    n = read(spark, sf_dir, "nation")
    attributes = n.select(F.col("n_regionkey").alias("classification"), F.col("n_nationkey").alias("position"), F.lower("n_name").alias("attribute"), F.concat(F.lit("Donne "), F.col("n_name")).alias("instruction"))
    return extraction.attribute_prompts(attributes).select("classification", F.sha2("prompt", 256).alias("prompt_hash"))


def clean_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields of four classes, cleaned by their class: a number, a bank code, an address, and lists of lots."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fiche_navette", "rib", "ccap", "other")]), (k % 4 + 1).cast("int"))
    lot = F.concat(F.lit('[{"numero_lot": 2, "titre_lot": "B'), k.cast("string"), F.lit('"}, {"numero_lot": 1, "titre_lot": "A"}]'))
    data = F.create_map(
        F.lit("montant_ht"), F.concat((k % 1000).cast("string"), F.lit(",5 EUR")), F.lit("bic"), F.lit("bnpa frpp"), F.lit("lots"), lot, F.lit("montant_ht_lots"), F.lit('[{"numero_lot": 3, "montant_ht_maximum": "7"}]'),
    )
    rows = structured.cleaned(o.select("o_orderkey", kind.alias("kind"), data.alias("data")), "kind", "data")
    at = lambda name: F.try_element_at("data", F.lit(name))
    return rows.select("o_orderkey", at("montant_ht").alias("amount"), at("bic").alias("bic"), F.array_join(F.from_json(at("lots"), "array<struct<numero_lot:int>>")["numero_lot"], ",").alias("lots"), F.map_contains_key("data", "montant_ht_lots").alias("has_list"))


def _hits(docs: DataFrame) -> DataFrame:
    return retrieval.chunked(docs).where(F.contains("text", F.lit("entre"))).select("doc_id", "chunk_id", "text")


def select_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold `entre` (with the first one) of long documents, the text of others."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    words = text.count_words(F.col("text"))
    long = docs.where(words > extraction.LONG_WORDS)  # only these are cut to chunks
    found = extraction.contexts(long, _hits(long), most=20_000, first_chunk=True)
    rows = extraction.content(docs, found, words)
    return rows.select("doc_id", "is_embedded", F.sha2("content", 256).alias("content_hash"))


def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document that hold `entre`, or the start of its text."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return extraction.contexts(docs, _hits(docs)).select("doc_id", F.sha2("context", 256).alias("context_hash"))


def multi_attribute_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of two attributes, one after the other."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    attributes = spark.createDataFrame([("first", 1, "entre"), ("second", 2, "the")], "attribute string, position int, search string")
    hits = extraction.attribute_hits(retrieval.chunked(docs), attributes).select("doc_id", "attribute", "chunk_id", "text")
    return extraction.attribute_contexts(docs, hits, attributes).select("doc_id", F.sha2("context", 256).alias("context_hash"))


def synthesis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's orders as documents, the prompt of each field."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".pdf")).alias("name"), F.when(F.col("o_orderstatus") == "O", "avenant").when(F.col("o_orderstatus") == "F", "acte_engagement").otherwise("devis").alias("kind"), F.col("o_orderpriority").alias("data"))
    return extraction.synthesis_inputs(o, "o_custkey", "name", "kind", "data").select("o_custkey", "field", F.sha2("prompt", 256).alias("prompt_hash"))


def synthesis_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three shapes, a column for each field."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit("libelle"), F.lit("prestataire"))).alias("field"))
    v = F.concat(F.lit('"v'), F.col("c_custkey"), F.lit('"'))
    q = F.concat(F.lit('{"'), F.col("field"), F.lit('": '))
    answer = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"valeur": '), v, F.lit(', "sources": []}'))).when(F.col("c_custkey") % 3 == 1, F.concat(q, F.lit('{"valeur": '), v, F.lit("}}"))).otherwise(F.concat(q, v, F.lit("}")))
    return extraction.synthesized(c.withColumn("answer", answer), "c_custkey").select("c_custkey", "libelle", "prestataire", "siret_prestataire")


def numbered_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened file names made unique, some of which already look like copies of others."""
    o = read(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("_"), (F.col("o_orderkey") % 3 + 1).cast("string"))).otherwise("")
    paths = o.select("o_orderkey", F.concat(F.lit("root/"), F.col("o_custkey") % 100, F.lit("/"), F.col("o_orderstatus"), number, F.lit(".pdf")).alias("path"))
    rows = paths.select("o_orderkey", records.flattened_name(F.col("path"), "root").alias("name"))
    return records.unique_names(rows, "name", ["o_orderkey"])


def contract_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment, whether a day is inside, and the tax in euros."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.lit("1996-06-01").cast("date")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("days"), day.between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("active"), F.floor(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))


def acl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether customers as users may see orders as engagements: their own and the next customer's, by superuser, permission and the scopes of their nation's group."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    users = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50 == 0).alias("is_superuser"), F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit(access.VIEW))).alias("permissions"))
    groups = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"))
    nations = read(spark, sf_dir, "nation")
    permissions = nations.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("group_id"), F.lit(access.VIEW).alias("permission"))
    scopes = nations.select(F.col("n_nationkey").alias("group_id"), F.col("n_regionkey").cast("string").alias("pur_org"), F.explode(F.array(F.lit("O"), F.lit("F"))).alias("pur_group"))
    engagements = o.select((F.col("o_orderkey") % 5).cast("string").alias("pur_org"), F.col("o_orderstatus").alias("pur_group"), F.col("o_orderkey").alias("num_ej"))
    pairs = o.select(F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("user_id"), F.col("o_orderkey").alias("num_ej"))
    return access.may_see(pairs, users, groups, scopes, engagements, permissions)


def contract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key is the frame contract of another one: customers' keys stand for contracts, some of them sentinels."""
    o = read(spark, sf_dir, "orders")
    contracts = o.select(F.col("o_orderkey").cast("string").alias("num_ej"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("#")).when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("contract"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("key"), "o_orderstatus")
    return records.under_other_key(rows, contracts, "key", "num_ej", "contract")


def main_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main fields of each customer's synthesis, whose fields are objects, plain texts, null or not there; and whether a list of codes is by lot."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    field = F.when(k % 4 == 0, F.concat(F.lit('{"valeur": '), name, F.lit("}"))).when(k % 4 == 1, name).when(k % 4 == 2, F.lit('{"sources": []}')).otherwise(F.lit("null"))
    found = structured.main_fields(F.concat(F.lit('{"libelle": '), field, F.lit(', "siret_prestataire": {"valeur": "1"}}')))
    codes = F.when(k % 3 == 0, F.lit('[{"numero_lot": 1, "code": "x"}]')).when(k % 3 == 1, F.lit('["x", {"numero_lot": 1}]')).otherwise(F.lit('{"numero_lot": 1}'))
    return c.select("c_custkey", found["Designation"].alias("designation"), found["SIRET"].alias("siret"), found["Date"].alias("date"), structured.is_by_lot(codes).alias("by_lot"))


def clean_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields of acts, cleaned: contractors, other accounts, the mandatee's account and the duration, from each order."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    digits = F.lpad(k, 14, "1")
    parties = F.concat(F.lit('[{"nom": "A", "siret": "'), digits, F.lit('"}, {"nom": "", "siret": "1"}, {"nom": "B", "siret": "12 "}]'))
    accounts = F.concat(F.lit('[{"societe": "s", "rib": {"banque": "b'), k, F.lit('", "iban": "FR14 2004 1010 0505 0001 3M02 606"}}, {"societe": "t", "rib": {"banque": "", "iban": null}}]'))
    months = F.concat(F.lit('{"duree_initiale": "'), k, F.lit('", "duree_reconduction": null, "nb_reconductions": "0", "delai_tranche_optionnelle": "x"}'))
    good = F.replace(months, F.lit('"x"'), F.lit("null"))
    data = F.create_map(F.lit("cotraitants"), parties, F.lit("rib_autres"), accounts, F.lit("rib_mandataire"), F.lit('{"banque": "c", "iban": "no"}'), F.lit("duree"), F.when(F.col("o_orderkey") % 2 == 0, months).otherwise(good), F.lit("other"), k)
    rows = structured.cleaned(o.select("o_orderkey", F.lit("acte_engagement").alias("kind"), data.alias("data")), "kind", "data")
    at = lambda name, path: F.get_json_object(F.try_element_at("data", F.lit(name)), path)
    return rows.select(
        "o_orderkey", at("cotraitants", "$[0].siret").alias("siret"), at("cotraitants", "$[1].nom").alias("second"), at("cotraitants", "$[1].siret").alias("second_siret"), at("rib_autres", "$[0].rib.iban").alias("iban"),
        F.json_array_length(F.try_element_at("data", F.lit("rib_autres"))).alias("n_accounts"), at("rib_mandataire", "$.banque").alias("bank"), at("rib_mandataire", "$.iban").alias("bank_iban"), at("duree", "$.duree_initiale").alias("months"),
        at("duree", "$.error").alias("error"), F.try_element_at("data", F.lit("other")).alias("other"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        null_sentinels, array_contains_filter, prefix_projection, target_or_skipped, displayed_split, suffixed_join, key_documents, job_progress, coverage_counters, scopes_and_bridge, patched_values, id_batches, first_ids,
        set_update, set_edit, sorted_items, backfill_and_rename, bridge_expansion, close_and_retry_stuck, list_as_table, one_field_report, error_list_parse, json_diff, attribute_prompt, clean_by_class, select_content,
        document_contexts, multi_attribute_context, synthesis_prompts, synthesis_values, numbered_copies, contract_days,
        acl_view, contract_files, main_fields, clean_nested,
    )
}

_RULE = "chr(10) || chr(10) || '---------------------------------' || chr(10) || chr(10)"
_JOBS = STEPS_SQL + """, jobs AS (SELECT batch_id, job_id, CASE WHEN bool_or(status IN ('PENDING', 'STARTED')) THEN 'STARTED' WHEN bool_or(status = 'FAILURE') THEN 'FAILURE'
  WHEN bool_or(status = 'CANCELLED') THEN 'CANCELLED' WHEN bool_or(status = 'SKIPPED') THEN 'SKIPPED' ELSE 'SUCCESS' END AS status FROM steps GROUP BY ALL)"""
_STRIP = f"regexp_replace(text, '^{text.BLANK}+|{text.BLANK}+$', '', 'g')"
_CHUNKS = f"""WITH t AS (SELECT doc_id, text, {_STRIP} AS s FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, i::INT AS chunk_id, s[i * 800 + 1 : i * 800 + 1000] AS part FROM t, unnest(range(ceil(length(s) / 800.0)::BIGINT)) AS r(i) WHERE length(s) > 0)"""
_WORDS = WORDS_SQL
_SYNTHESIS = ", ".join(f"('{f}')" for f in extraction.SYNTHESIS_FIELDS)

ORACLE_SQL = {
    "null_sentinels": "SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 = 2",
    "array_contains_filter": "SELECT n_name FROM nation WHERE n_regionkey < 2",
    "prefix_projection": "SELECT o_orderkey AS \"key\", o_orderstatus AS status FROM orders",
    "target_or_skipped": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'SUCCESS' ELSE 'SKIPPED' END AS status, count(*) AS n FROM events GROUP BY 1",
    "displayed_split": "SELECT coalesce(length(text) > 0 AND lang IN ('en', 'fr'), false) AS displayed, count(*) AS n FROM documents GROUP BY 1",
    "suffixed_join": "SELECT c_nationkey AS \"key\", c_name AS name_a, c_custkey AS id, n_name AS name_b FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "key_documents": "SELECT DISTINCT user_id, event_id, event_type FROM events WHERE user_id IN (1, 2, 3, 5, 8)",
    "job_progress": f"{_JOBS} SELECT batch_id, count(*) FILTER (status <> 'STARTED') AS progress, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILURE') AS errors, count(*) AS total FROM jobs GROUP BY batch_id",
    "coverage_counters": """WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), w AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL))
  SELECT 'orders' AS metric, count(*) AS "value" FROM orders UNION ALL SELECT 'orders.o_orderkey', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'orders.o_custkey', count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'customers.c_custkey', count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'customers.c_nationkey', count(DISTINCT c_nationkey) FROM customer
  UNION ALL SELECT 'joined', count(*) FROM j UNION ALL SELECT 'joined.o_orderkey', count(DISTINCT o_orderkey) FROM j UNION ALL SELECT 'joined.c_custkey', count(DISTINCT c_custkey) FROM j
  UNION ALL SELECT 'without', count(*) FROM w UNION ALL SELECT 'without.c_custkey', count(DISTINCT c_custkey) FROM w UNION ALL SELECT 'without.c_nationkey', count(DISTINCT c_nationkey) FROM w""",
    "scopes_and_bridge": "SELECT DISTINCT event_type AS scope, user_id FROM events",
    "patched_values": "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds, coalesce((max(event_id) FILTER (event_type = 'error'))::VARCHAR, '') AS last_error FROM events GROUP BY user_id",
    "id_batches": "SELECT b::INT AS batch, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS b FROM orders) GROUP BY b",
    "first_ids": "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL",
    "set_update": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    "set_edit": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'B,X' ELSE array_to_string(list_sort([n_name, 'X']), ',') END AS members FROM nation",
    "sorted_items": "SELECT event_id, 'a=' || event_type || ';k=' || (props->>'$.k') AS items FROM events",
    "backfill_and_rename": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'old' END AS response, CASE event_type WHEN 'click' THEN 'press' ELSE event_type END || ',other' AS steps, CASE event_type WHEN 'click' THEN 'press' ELSE event_type END AS step FROM events",
    "bridge_expansion": "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 4 <> 0",
    "close_and_retry_stuck": f"""{_JOBS}, stuck AS (SELECT batch_id FROM steps GROUP BY batch_id HAVING max(finished_at) < TIMESTAMP '2024-01-30 11:30:00' INTERSECT SELECT batch_id FROM jobs WHERE status = 'STARTED')
  SELECT batch_id, count(DISTINCT job_id) AS n FROM jobs JOIN stuck USING (batch_id) WHERE status IN ('STARTED', 'FAILURE', 'CANCELLED') GROUP BY batch_id""",
    "list_as_table": "SELECT n_regionkey, 'n_nationkey|of.n_name;' || string_agg(n_nationkey || '|' || n_name, ';' ORDER BY n_nationkey) AS shown FROM nation GROUP BY n_regionkey",
    "one_field_report": "SELECT doc_id, 'quality' AS field FROM labels WHERE doc_id % 9 = 0",
    "error_list_parse": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE n_name || '/b' END AS names FROM nation",
    "json_diff": """WITH e AS (SELECT event_id, props->>'$.k' AS k, event_type FROM events)
  SELECT b.event_id, '' AS only_a, '' AS only_b, array_to_string(list_filter([CASE WHEN a.k <> b.k THEN 'p.k' END, CASE WHEN a.event_type <> b.event_type THEN 't.0' END], lambda x: x IS NOT NULL), ',') AS changed FROM e a JOIN e b ON b.event_id = a.event_id + 1""",
    "attribute_prompt": """SELECT n_regionkey AS classification, sha256('Extrais les informations suivantes et réponds par un seul objet JSON, sans autre texte :' || chr(10) || '{' || chr(10) || string_agg('  "' || lower(n_name) || '": ""', ',' || chr(10) ORDER BY n_nationkey)
  || chr(10) || '}' || chr(10) || 'Consignes :' || chr(10) || string_agg('Donne ' || n_name, chr(10) ORDER BY n_nationkey)) AS prompt_hash FROM nation GROUP BY n_regionkey""",
    "clean_by_class": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 1000) || '.50' ELSE (o_orderkey % 1000) || ',5 EUR' END AS amount, CASE WHEN o_orderkey % 4 = 1 THEN 'BNPAFRPP' ELSE 'bnpa frpp' END AS bic,
  CASE WHEN o_orderkey % 4 = 2 THEN '1,2,3' ELSE '2,1' END AS lots, o_orderkey % 4 <> 2 AS has_list FROM orders""",
    "select_content": f"""{_CHUNKS}, h AS (SELECT doc_id, string_agg(part, {_RULE} ORDER BY chunk_id) AS ctx, min(chunk_id) AS low FROM c WHERE contains(part, 'entre') GROUP BY doc_id),
  f AS (SELECT doc_id, substring(coalesce(CASE WHEN low = 0 THEN ctx ELSE (SELECT part FROM c WHERE c.doc_id = t.doc_id AND chunk_id = 0) || {_RULE} || ctx END, substring(text, 1, 3000)), 1, 20000) AS ctx FROM t LEFT JOIN h USING (doc_id))
  SELECT doc_id, {_WORDS} > 5000 AS is_embedded, sha256(CASE WHEN {_WORDS} > 5000 THEN ctx ELSE text END) AS content_hash FROM t JOIN f USING (doc_id)""",
    "document_contexts": f"""{_CHUNKS}, h AS (SELECT doc_id, string_agg(part, {_RULE} ORDER BY chunk_id) AS ctx FROM c WHERE contains(part, 'entre') GROUP BY doc_id)
  SELECT doc_id, sha256(coalesce(ctx, substring(text, 1, 3000))) AS context_hash FROM t LEFT JOIN h USING (doc_id)""",
    "multi_attribute_context": f"""{_CHUNKS}, a AS (SELECT doc_id, string_agg(part, {_RULE} ORDER BY chunk_id) AS ctx, min(chunk_id) AS low FROM c WHERE contains(part, 'entre') GROUP BY doc_id), b AS (SELECT doc_id, string_agg(part, {_RULE} ORDER BY chunk_id) AS other FROM c WHERE contains(part, 'the') GROUP BY doc_id),
  z AS (SELECT doc_id, part FROM c WHERE chunk_id = 0)
  SELECT doc_id, sha256(coalesce(CASE WHEN low = 0 THEN ctx ELSE part || {_RULE} || ctx END, substring(text, 1, 3000)) || chr(10) || coalesce(other, substring(text, 1, 3000))) AS context_hash FROM t LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN z USING (doc_id)""",
    "synthesis_prompts": f"""WITH o AS (SELECT o_custkey, 'f' || o_orderkey || '.pdf' AS name, CASE o_orderstatus WHEN 'O' THEN 'avenant' WHEN 'F' THEN 'acte_engagement' ELSE 'devis' END AS kind, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 4 END AS rank, o_orderpriority AS data FROM orders),
  b AS (SELECT o_custkey, string_agg('{{"filename":"' || name || '","classification":"' || kind || '","data":"' || data || '"}}', chr(10) ORDER BY rank, name) AS body FROM o GROUP BY o_custkey)
  SELECT o_custkey, field, sha256('Champ à consolider : ' || field || chr(10) || 'Documents :' || chr(10) || body) AS prompt_hash FROM b, (VALUES {_SYNTHESIS}) v(field)""",
    "synthesis_values": "SELECT c_custkey, 'v' || c_custkey AS libelle, 'v' || c_custkey AS prestataire, NULL::VARCHAR AS siret_prestataire FROM customer",
    "numbered_copies": """WITH o AS (SELECT o_orderkey, (o_custkey % 100) || '_' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN '_' || (o_orderkey % 3 + 1) ELSE '' END AS stem FROM orders),
  t AS (SELECT regexp_replace(stem, '_[0-9]+$', '') AS stem, list_sort(list(DISTINCT regexp_extract(stem, '_([0-9]+)$', 1)::BIGINT)) AS taken FROM o WHERE regexp_matches(stem, '_[0-9]+$') GROUP BY 1),
  n AS (SELECT o.*, row_number() OVER (PARTITION BY o.stem ORDER BY o_orderkey) - 1 AS n, coalesce(taken, []) AS taken FROM o LEFT JOIN t USING (stem))
  SELECT o_orderkey, CASE WHEN n = 0 THEN stem || '.pdf' ELSE stem || '_' || list_reduce(taken, lambda a, x: CASE WHEN x <= a THEN a + 1 ELSE a END, n) || '.pdf' END AS name FROM n""",
    "contract_days": "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days, DATE '1996-06-01' BETWEEN o_orderdate::DATE AND l_shipdate::DATE AS active, floor(l_extendedprice * l_tax)::BIGINT AS tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "acl_view": """WITH p AS (SELECT o_custkey + d AS user_id, o_orderkey AS num_ej, o_orderstatus AS s FROM orders, range(2) r(d))
  SELECT user_id, num_ej, coalesce(c_custkey % 50 = 0 OR ((c_custkey % 7 = 0 OR c_nationkey % 2 = 1) AND n_regionkey = num_ej % 5 AND s IN ('O', 'F')), false) AS visible
  FROM p LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "contract_files": """SELECT o_orderkey::VARCHAR AS "key", o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_custkey <> o_orderkey)""",
    "main_fields": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 3 THEN '' END AS designation, '1' AS siret, NULL::VARCHAR AS date, c_custkey % 3 = 0 AS by_lot FROM customer",
    "clean_nested": """SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 14, '1') AS siret, 'B' AS second, NULL::VARCHAR AS second_siret, 'FR1420041010050500013M02606' AS iban, 1::INT AS n_accounts, 'c' AS bank, NULL::VARCHAR AS bank_iban,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey::VARCHAR END AS months, CASE WHEN o_orderkey % 2 = 0 THEN 'delai_tranche_optionnelle is not a number' END AS error, o_orderkey::VARCHAR AS other FROM orders""",
}
