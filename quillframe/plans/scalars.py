"""Queries of single expressions, of answers and pages, and of what is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, dates, files, money, structured, text
from ..operators import providers, records, workflow
from ..operators.ranks import scratch_folder
from ..sources.files import delimited, unzipped
from .documents import archive
from .tables import STEPS_SQL, read, steps_from_events


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with NUL, line ends and tabs put in: without NUL, as they are embedded, and whether they are readable."""
    docs = read(spark, sf_dir, "documents")
    odd = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\x00a\r\n\t"), F.col("text"), F.lit("\x00"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\x01" * 40), F.substring("text", 1, 60))).otherwise(F.substring("text", 1, 9))
    rows = docs.select("doc_id", odd.alias("t"))
    return rows.select("doc_id", F.length(text.without_nul(F.col("t"))).alias("n_without"), F.sha2(text.for_embedding(F.col("t")), 256).alias("embedding_hash"), text.is_readable(F.col("t")).alias("readable"))


def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of documents' files as they are stored, their sizes in MB, and whether their type is one that text is taken from."""
    docs = read(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".exe", "", ".Docx")]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.col("source"), F.lit("/É œ ñ\\"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit("x" * 300)).otherwise(""), ending)
    stored = files.safe_name(name)
    return docs.select("doc_id", stored.alias("name"), files.size_in_mb(F.col("n_chars") * 1024).alias("mb"), F.coalesce(files.name_extension(name).isin(*files.SUPPORTED), F.lit(False)).alias("supported"))


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as percentages, whole or with one decimal, and ship dates without padding."""
    lines = read(spark, sf_dir, "lineitem")
    share = F.round(F.col("l_discount") + F.when(F.col("l_linenumber") == 2, 0.005).otherwise(0.0), 4)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", money.as_percentage(share).alias("shown"), dates.unpadded_date(F.col("l_shipdate").cast("date")).alias("shipped"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of a number and a unit as seconds; what is none as null."""
    e = read(spark, sf_dir, "events")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("s", "m", "h", "d", "w", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", dates.duration_seconds(F.concat((F.col("event_id") % 100).cast("string"), unit)).alias("seconds"))


def extraction_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's extracted fields the share that has a value; 0 for none."""
    k = F.col("c_custkey")
    data = F.when(k % 5 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.when(k % 2 == 0, ""), F.lit("c"), F.when(k % 3 == 0, "x").otherwise("")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(structured.extraction_ratio(data), 6).alias("ratio"))


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the key and the short name of their class, found by its full name; names that are no class have no key."""
    names = [n for _, n, _ in classes.CLASSES]
    docs = read(spark, sf_dir, "documents").withColumn("full_name", F.element_at(F.array(*[F.lit(n) for n in (*names, "none")]), (F.col("doc_id") % (len(names) + 1) + 1).cast("int")))
    key = classes.key_of(F.col("full_name"))
    return docs.groupBy(key.alias("class"), classes.short_name_of(F.coalesce(key, F.lit("other"))).alias("short_name")).agg(F.count("*").alias("n"))


def failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each batch's failed jobs, once: what a retry takes."""
    jobs = workflow.job_status(steps_from_events(spark, sf_dir)).withColumn("document_id", F.col("job_id") % 5)
    parts = [workflow.to_retry(jobs, b).withColumn("batch_id", F.lit(b)) for b in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as the pages of a scan."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))
    return turns.select("conv_id", F.sha2(providers.page_marked(F.col("pages")), 256).alias("text_hash"))


def answer_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a classifier, each a list of names, as the key of the first known one."""
    e = read(spark, sf_dir, "events")
    answers = F.array(F.lit("nothing"), F.col("event_type"), F.lit("view"))
    return e.groupBy(providers.mapped_answer(F.when(F.col("event_id") % 10 != 0, answers).otherwise(F.array(F.lit("?"))), {"click": "c", "view": "v", "error": "e"}).alias("class")).agg(F.count("*").alias("n"))


def zip_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in archives, some in archives inside archives: the files that come out, their archives and contents."""
    pages = read(spark, sf_dir, "pages")
    html, number = F.encode("html", "UTF-8"), F.col("page_id").cast("string")
    content = F.when(F.col("page_id") % 3 == 0, html).when(F.col("page_id") % 3 == 1, archive("page.html", html)).otherwise(archive("inner.zip", archive("page.html", html)))
    rows = unzipped(pages.select(F.concat(number, F.when(F.col("page_id") % 3 == 0, ".html").otherwise(".zip")).alias("file"), content.alias("content")))
    return rows.select("file", "parent", F.sha2("content", 256).alias("hash"))


def dump_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a nested column, written as a delimited table and as JSON lines, read again and joined."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct("c_nationkey", "c_mktsegment").alias("of"))
    folder = scratch_folder(spark, "dumps")
    records.csv_dump(records.loaded(c.union(c)), f"{folder}/csv")
    records.json_dump(c, f"{folder}/json")
    table = delimited(spark, f"{folder}/csv", "c_custkey long, c_name string, of string")
    lines = spark.read.schema("c_custkey long, of struct<c_nationkey: long, c_mktsegment: string>").json(f"{folder}/json")
    return table.join(lines.select("c_custkey", F.col("of.c_mktsegment").alias("segment")), "c_custkey").select("c_custkey", "c_name", F.get_json_object("of", "$.c_nationkey").cast("long").alias("nation"), "segment")


QUERIES = {f.__name__: f for f in (text_rules, file_rules, shown_values, durations, extraction_ratios, class_names, failed_documents, page_marks, answer_mapping, zip_expand, dump_and_load)}

_NAMES = ", ".join(f"({i}, '{k}', '{s.replace(chr(39), chr(39) * 2)}')" for i, (k, _, s) in enumerate(classes.CLASSES))
_NBSP = "chr(160)"

ORACLE_SQL = {
    "text_rules": """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(0) || 'a' || chr(13) || chr(10) || chr(9) || text || chr(0) WHEN 1 THEN repeat(chr(1), 40) || substring(text, 1, 60) ELSE substring(text, 1, 9) END AS t FROM documents),
  n AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '[\\p{L}\\p{N}\\p{P}\\p{S}\\p{Zs}\\n\\r\\t]')) AS p, len(regexp_extract_all(t, '[^\\p{L}\\p{N}\\p{P}\\p{S}\\s]')) AS o FROM d)
  SELECT doc_id, length(replace(t, chr(0), ''))::INT AS n_without, sha256(substring(trim(regexp_replace(translate(t, chr(0) || chr(13) || chr(10) || chr(9), '    '), ' +', ' ', 'g'), ' '), 1, 8000)) AS embedding_hash, n >= 10 AND p >= 0.7 * n AND o <= 0.3 * n AS readable FROM n""",
    "file_rules": """WITH d AS (SELECT doc_id, n_chars, source || '_É  n_' || doc_id || CASE WHEN doc_id % 7 = 0 THEN repeat('x', 300) ELSE '' END AS stem, ['.pdf', '.exe', '', '.docx'][doc_id % 4 + 1] AS ext FROM documents)
  SELECT doc_id, CASE WHEN length(stem || ext) > 250 THEN substring(stem, 1, (250 - length(ext) - 7)::INT) || '[trunc]' || ext ELSE stem || ext END AS name, round(n_chars * 1024 / 1e6, 2) AS mb, doc_id % 4 IN (0, 3) AS supported FROM d""",
    "shown_values": f"""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, round(l_discount * 100)::INT AS d, l_linenumber = 2 AS half FROM lineitem)
  SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN half THEN d || '.5' || {_NBSP} || '%' WHEN d > 0 THEN d || {_NBSP} || '%' END AS shown, year(l_shipdate) || '-' || month(l_shipdate) || '-' || day(l_shipdate) AS shipped FROM l""",
    "durations": "SELECT event_id, (event_id % 100) * CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END AS seconds FROM events",
    "extraction_ratios": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 3 = 0 THEN round(2 / 3, 6) ELSE round(1 / 3, 6) END AS ratio FROM customer",
    "class_names": f"WITH c(i, k, s) AS (VALUES {_NAMES}) SELECT k AS class, coalesce(s, 'other') AS short_name, count(*) AS n FROM documents LEFT JOIN c ON doc_id % {len(classes.CLASSES) + 1} = i GROUP BY ALL",
    "failed_documents": f"{STEPS_SQL} SELECT DISTINCT batch_id::INT AS batch_id, job_id % 5 AS document_id FROM (SELECT batch_id, job_id FROM steps WHERE batch_id IN (1, 2, 3) GROUP BY ALL HAVING bool_or(status = 'FAILURE') AND NOT bool_or(status IN ('PENDING', 'STARTED')))",
    "page_marks": """WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id, sha256(string_agg('[[PAGE ' || i || ' / ' || n || ']]' || chr(10) || text || chr(10) || '[[FIN PAGE ' || i || ' / ' || n || ']]', chr(10) || chr(10) ORDER BY i)) AS text_hash FROM t GROUP BY conv_id""",
    "answer_mapping": "SELECT CASE WHEN event_id % 10 = 0 THEN 'Non classifié' WHEN event_type = 'click' THEN 'c' WHEN event_type = 'error' THEN 'e' ELSE 'v' END AS class, count(*) AS n FROM events GROUP BY 1",
    "zip_expand": """SELECT page_id || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.zip/page.html' ELSE '.zip/inner.zip/page.html' END AS file,
  CASE page_id % 3 WHEN 1 THEN page_id || '.zip' WHEN 2 THEN page_id || '.zip/inner.zip' END AS parent, sha256(html) AS hash FROM pages""",
    "dump_and_load": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS nation, c_mktsegment AS segment FROM customer",
}
