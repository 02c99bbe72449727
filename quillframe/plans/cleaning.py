"""Queries that clean fields and compare extracted values, on inputs rendered from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, dates, ids, money, structured, text
from ..functions import compare
from ..functions.compare import contained, exact, same_multiset
from ..operators import quality
from .tables import dealt, read


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices rendered as `1 234,56 €`, some without a number."""
    lines = read(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    shown = F.concat(F.expr("cast(round(l_extendedprice * 100) as bigint) div 100000").cast("string"), F.lit(" "), F.lpad((F.expr("cast(round(l_extendedprice * 100) as bigint) div 100") % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    raw = F.when(F.col("l_linenumber") == 7, F.lit("€")).otherwise(shown)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", money.amount(raw).alias("amount"))


def percentage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit("TVA "), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("%"))
    found = money.percentage(raw)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", found.alias("percentage"), F.round(money.rate(found), 4).alias("rate"), money.ratio_text(F.col("l_tax")).alias("shown"))


def siret_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as 14 digits with spaces and `.0`, or as too few digits."""
    c = read(spark, sf_dir, "customer")
    digits = F.lpad((F.col("c_custkey") * 7919).cast("string"), 14, "1")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.substring(digits, 1, 3), F.lit(" "), F.substring(digits, 4, 11))).when(F.col("c_custkey") % 3 == 1, F.concat(digits, F.lit(".0"))).otherwise(F.substring(digits, 1, 13))
    return c.select("c_custkey", ids.siret(raw).alias("siret"), ids.in_groups(ids.siret(raw), 3).alias("shown"))


def bic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    raw = F.concat(F.lit(" bnpa frpp\n"), F.when(F.col("s_suppkey") % 3 == 0, F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")).when(F.col("s_suppkey") % 3 == 1, F.lit("")).otherwise("x"), F.lit(" "))
    return s.select("s_suppkey", ids.bic(raw).alias("bic"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", ids.french_iban(F.lit("30001"), F.lpad((F.col("c_custkey") % 100).cast("string"), 5, "0"), F.lpad((F.col("c_custkey") * 7907).cast("string"), 11, "0")).alias("iban"))


def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers with computed keys, some then changed in one digit."""
    wrong = F.concat(F.substring("iban", 1, 20), F.pmod(F.substring("iban", 21, 1).cast("int") + 1, F.lit(10)).cast("string"), F.substring("iban", 22, 6))
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("iban")).otherwise(wrong)
    return _accounts(spark, sf_dir).select("c_custkey", "iban", ids.iban_is_valid(raw).alias("valid"), ids.in_groups(F.col("iban"), 4).alias("shown"))


def iban_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with one wrong digit come back where no other substitution is valid too; spaced lower-case ones are cleaned."""
    wrong = F.concat(F.substring("iban", 1, 10), F.pmod(F.substring("iban", 11, 1).cast("int") + 3, F.lit(10)).cast("string"), F.substring("iban", 12, 16))
    # a row takes far more time than its bytes let Spark's splits expect
    rows = _accounts(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select("c_custkey", ids.iban(wrong).alias("corrected"), (ids.iban(F.lower(ids.in_groups(F.col("iban"), 4))) == F.col("iban")).alias("cleaned"))


def normalize_name_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer")
    raw = F.concat(F.lit("  saint-"), F.lower("c_mktsegment"), F.lit("  SUR "), F.col("c_mktsegment"))
    return n.select("c_custkey", text.name_case(raw).alias("city"))


def postal_address_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    code = F.when(F.col("c_custkey") % 4 == 0, F.lit("1234")).otherwise(F.concat(F.lit("75 "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")))
    raw = F.struct(F.col("c_custkey").cast("string").alias("numero_voie"), F.lit(" rue  de la  paix ").alias("nom_voie"), F.lit(None).cast("string").alias("complement_adresse"), code.alias("code_postal"), F.lit("PARIS").alias("ville"), F.when(F.col("c_custkey") % 5 == 0, F.lit("fr")).alias("pays"))
    clean = address.postal_address(raw)
    return c.select("c_custkey", clean["code_postal"].alias("code"), clean["pays"].alias("country"), address.address_line(clean).alias("line"))


def lots_full_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of each order's lines, by line number, merged to one."""
    lines = read(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")
    item = lambda cond, name: F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("l_linenumber").alias("numero_lot"), F.concat(F.lit(name), F.col("l_linenumber")).alias("v")))))
    rows = lines.groupBy("l_orderkey").agg(item(F.col("l_linenumber") < 5, "t").alias("titles"), item(F.col("l_linenumber") > 2, "a").alias("amounts"))
    merged = structured.merged_lots({"titre": (F.col("titles"), "v"), "montant": (F.col("amounts"), "v")})
    return rows.select("l_orderkey", F.explode(merged).alias("lot")).select("l_orderkey", "lot.*")


def json_props_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    v = F.try_parse_json(F.concat(F.lit('{"lots": [{"p": '), F.col("props"), F.lit('}, {"p": {"k": 1}}]}')))
    return e.select("event_id", structured.at_path(F.try_parse_json("props"), "k", "bigint").alias("k"), structured.at_path(v, "lots.*.p.k", "bigint").alias("ks"))


def api_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("/Date(x)/")).otherwise(F.concat(F.lit("/Date("), F.col("ms").cast("string"), F.lit(")/")))
    t = dates.api_timestamp(raw)
    return e.select("event_id", F.unix_millis(t).alias("ms"), dates.api_literal(t).alias("literal"))


def activity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "signup", F.lit("Engagement - Création")).when(F.col("event_type") == "click", F.lit("Engagement - Modification")).otherwise(F.col("event_type"))
    return e.groupBy(dates.activity_kind(raw).alias("kind")).agg(F.count("*").alias("n"))


def _labels(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    flip = lambda c, k: F.when((F.col("doc_id") + shift) % k == 0, 1 - F.col(c)).otherwise(F.col(c)).cast("string").alias(c)
    return labels.select("doc_id", flip("quality", 9), flip("toxic", 13))


def _matches(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    truth = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return quality.compared(_labels(spark, sf_dir, shift), truth, "doc_id", ["quality", "toxic"], {"quality": exact})


def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_accuracy(_matches(spark, sf_dir))


def global_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.global_accuracy(_matches(spark, sf_dir))


def errors_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.errors_of_each(_matches(spark, sf_dir), "doc_id")


def accuracy_against_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.against_best(_matches(spark, sf_dir), _matches(spark, sf_dir, 1), "doc_id")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").withColumn("predicted", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return quality.confusion(rows, "quality", "predicted")


def class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").withColumn("predicted", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return quality.recall_of_each(rows, "quality", "predicted")


def multiset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags of an order's lines against those of its even lines twice over."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))).alias("b"))
    return rows.select("l_orderkey", same_multiset(F.col("a"), F.concat("b", "b")).alias("same"), contained(F.col("a"), F.col("b")).alias("inside"))


def contractor_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contractors of an order's lines, found in another order, case and accents, some missing or with another siret: matched one to one, and contained."""
    lines = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    siret = F.lpad(F.col("l_suppkey").cast("string"), 14, "0")
    truth = F.struct(F.concat(F.lit("Société Générale d'Été "), F.col("l_suppkey").cast("string")).alias("nom"), siret.alias("siret"))
    wrong = (F.col("l_partkey") % 11 == 0) & (F.col("l_linenumber") == 2)
    found = F.struct(F.concat(F.lit("SOCIETE GENERALE D ETE-"), F.col("l_suppkey").cast("string")).alias("nom"), F.when(wrong, F.lit("0")).otherwise(siret).alias("siret"))
    kept = (F.col("l_partkey") % 7 != 0) | (F.col("l_linenumber") != 1)
    rows = lines.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(truth))).alias("truth"), F.to_json(F.reverse(F.array_sort(F.collect_list(F.when(kept, found))))).alias("found"))
    return rows.select("l_orderkey", compare.co_contractors(F.col("found"), F.col("truth")).alias("matched"), compare.sub_contractors(F.col("found"), F.col("truth")).alias("contained"))


def tolerant_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order's lines against those of its lines one on: pairs within 10 that are taken in order, so that an early choice can spoil a later one."""
    rows = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("b"))
    near = compare.matched(lambda x, y: F.abs(x - y) <= 10)
    turned = F.concat(F.slice("b", 2, F.size("b")), F.slice("b", 1, 1))
    return rows.select("l_orderkey", near(F.transform(turned, lambda x: x + 6), F.col("b")).alias("matched"))


def lots_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots made of an order's lines against lots with a changed title, form, duration or amount, by the rules of their class."""
    lines = dealt(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k")), "l_orderkey")

    def lot(changed: bool, n: F.Column, key: F.Column) -> F.Column:
        other = lambda c, x, y: F.when(c, y).otherwise(x) if changed else x
        title = other(F.lit(True), F.concat(F.lit("Lot n° "), n.cast("string"), F.lit(" - Été")), F.concat(F.lit("LOT N "), n.cast("string"), other(key % 5 == 0, F.lit("  ETE"), F.lit(" HIVER"))))
        form = F.struct(F.lit("simple").alias("structure"), other(key % 6 == 0, F.lit(None).cast("string"), F.lit("deux")).alias("tranches"), F.lit("forfaitaire").alias("forme_prix"), F.lit("1").alias("attributaires"))
        amount = F.struct(n.cast("string").alias("numero_lot"), other(key % 8 == 0, F.lit("10.00"), F.lit("11.00")).alias("montant_ht_maximum"), F.lit("max").alias("type_montant"))
        return F.struct(title.alias("titre"), form.alias("forme"), other(key % 7 == 0, F.lit("12 mois"), F.lit("6 mois")).alias("duree_lot"), amount.alias("montant_ht"))

    # both sides are made of one sorted list; their parsed lots and each field's value are columns, so that they are worked out once for all that looks at them
    side = lambda changed: F.create_map(F.lit("lots"), F.to_json(F.transform("items", lambda x: lot(changed, x["n"], x["k"])), {"ignoreNullFields": "false"}))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("items")).select("l_orderkey", side(False).alias("a"), side(True).alias("b"))
    rules = {k: v for k, v in compare.REGISTRY["ccap"].items() if k.startswith("lots.")}
    name = lambda k: k.rpartition(".")[2]
    items = rows.select("l_orderkey", *[quality.items_of(F.col(s), "lots").alias(s) for s in "ab"])
    values = items.select("l_orderkey", *[quality.values_at(F.col(s), name(k)).alias(f"{s} {name(k)}") for k in rules for s in "ab"])
    return values.select("l_orderkey", *[rule(F.col(f"a {name(k)}"), F.col(f"b {name(k)}")).alias(name(k)) for k, rule in rules.items()])


#: Truth, an equal value in another form, and another value, of the fields that are not plain texts.
_NESTED = {
    **dict.fromkeys(("adresse_postale_titulaire", "adresse_postale_sous_traitant"), ('{"numero_voie": "1", "nom_voie": "rue de l\'Été", "ville": "Paris"}', '{"numero_voie": "1", "nom_voie": "Rue de l ete", "ville": "PARIS"}', '{"numero_voie": "2", "nom_voie": "rue de l\'Été", "ville": "Paris"}')),
    **dict.fromkeys(("duree", "duree_marche", "duree_sous_traitance"), ('{"duree_initiale": 12, "nb_reconductions": 1}', '{"nb_reconductions": 1, "duree_initiale": 12}', '{"duree_initiale": 13, "nb_reconductions": 1}')),
    **dict.fromkeys(("rib_mandataire", "rib_sous_traitant"), ('{"banque": "B", "iban": "FR76 1"}', '{"banque": "C", "iban": "fr761"}', '{"banque": "B", "iban": "FR762"}')),
    "cotraitants": ('[{"nom": "É", "siret": "1"}, {"nom": "b", "siret": "2"}]', '[{"nom": "B", "siret": "2"}, {"nom": "e", "siret": "1"}]', '[{"nom": "B", "siret": "2"}, {"nom": "b", "siret": "2"}]'),
    "sous_traitants": ('[{"nom": "É", "siret": "1"}, {"nom": "b", "siret": "2"}]', '[{"nom": "e", "siret": "1"}]', '[{"nom": "c", "siret": "1"}]'),
    "rib_autres": ('[{"societe": "s", "rib": {"iban": "A1"}}, {"societe": "t", "rib": {"iban": "A2"}}]', '[{"societe": "t", "rib": {"iban": "a 2"}}, {"societe": "s", "rib": {"iban": "A1"}}]', '[{"societe": "t", "rib": {"iban": "A2"}}, {"societe": "s", "rib": {"iban": "A2"}}]'),
    "montants_en_annexe": ('{"annexe_financière": true, "classification": ["a", "b"]}', '{"annexe_financière": true, "classification": ["b", "a"]}', '{"annexe_financière": true, "classification": ["b"]}'),
}
_FORMS = {"acte_engagement": ('{"lot_concerne": {"numero_lot": 1}}', '{"lot_concerne": {"numero_lot": 1}}', '{"lot_concerne": {"numero_lot": 2}}'), "ccap": ('{"structure": "s"}', '{"structure": "s"}', '{"structure": "t"}')}
#: Of two lots, what each has: truth and another value.
_LOTS = {"titre": (('"t"', '"u"'), ('"t"', '"v"')), "forme": (('{"structure": "s"}', "null"), ("null", "null")), "duree_lot": (('"1"', '{"duree_initiale": 1}'), ('{"duree_initiale": 1}', '"1"')), "montant_ht": (('{"numero_lot": 1}', '{"numero_lot": 2}'), ('{"numero_lot": 1}', '{"numero_lot": 3}'))}


def _found_and_truth(kind: str) -> tuple[F.Column, F.Column]:
    """Maps of a class's fields: of the field at place i, another value where the order's key and i make a multiple of 7, none where one of 9."""
    found, truth, lots = [], [], []
    pick = lambda i, same, other, none: F.when((F.col("o_orderkey") + i) % 7 == 0, F.lit(other)).when((F.col("o_orderkey") + i) % 9 == 0, F.lit(none)).otherwise(F.lit(same))
    for i, (name, rule) in enumerate(compare.REGISTRY[kind].items()):
        if name.startswith("lots.*."):
            lots.append((name[7:], i))
            continue
        true, same, other = _FORMS[kind] if name == "forme_marche" else _NESTED.get(name, ("Valeur 1", "Valeur 1" if rule is compare.exact else "VALEUR-1", "autre"))
        truth += [F.lit(name), F.lit(true)]
        found += [F.lit(name), pick(i, same, other, None)]
    if lots:
        one = lambda at, value: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), value(n, i, at)) for n, i in lots]), F.lit("}"))
        both = lambda value: F.concat(F.lit("["), one(0, value), F.lit(", "), one(1, value), F.lit("]"))
        truth += [F.lit("lots"), both(lambda n, i, at: F.lit(_LOTS[n][0][at]))]
        found += [F.lit("lots"), both(lambda n, i, at: pick(i, _LOTS[n][0][at], _LOTS[n][1][at], "null"))]
    return F.create_map(*found), F.create_map(*truth)


def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by class and field over all six classes: orders stand for documents, whose every field is found in another form of the same value, as another one, or not at all."""
    kinds = list(compare.REGISTRY)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % len(kinds) + 1).cast("int"))
    maps = {k: _found_and_truth(k) for k in kinds}
    side = lambda i: F.coalesce(*[F.when(F.col("kind") == k, m[i]) for k, m in maps.items()])
    orders = read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind")).select("o_orderkey", "kind", side(0).alias("found"), side(1).alias("truth"))
    rows = quality.compared_by_class(orders.select("o_orderkey", F.col("found").alias("data")), orders.select("o_orderkey", "kind", F.col("truth").alias("data")), "o_orderkey", "kind", "data", compare.REGISTRY)
    n = F.count_if("match")
    return rows.groupBy("kind", "field").agg(F.count("*").alias("total"), n.alias("matches"))


QUERIES = {f.__name__: f for f in (amount_parse, percentage_parse, siret_parse, bic_parse, iban_mod97, iban_correct, normalize_name_city, postal_address_clean, lots_full_merge, json_props_path, api_date_parse, activity_kinds, field_accuracy, global_accuracy, errors_per_file, accuracy_against_best, confusion_matrix, class_recall, multiset_match, contractor_matching, tolerant_matching, lots_compare, registry_match)}

_REGISTRY = ", ".join(f"({k}, '{kind}', {i}, '{name}')" for k, (kind, fields) in enumerate(compare.REGISTRY.items()) for i, name in enumerate(fields))
_MATCHES = """WITH m AS (SELECT doc_id, 0 AS position, 'quality' AS field, doc_id % 9 <> 0 AS match, (doc_id + 1) % 9 <> 0 AS best FROM labels
  UNION ALL SELECT doc_id, 1, 'toxic', doc_id % 13 <> 0, (doc_id + 1) % 13 <> 0 FROM labels)"""
_PREDICTED = "WITH p AS (SELECT quality, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS predicted FROM labels)"
_KEY = "(97 - (89 * 30001 + 15 * (c_custkey % 100) + 3 * (c_custkey * 7907)) % 97)"
_BBAN = f"'30001' || lpad((c_custkey % 100)::VARCHAR, 5, '0') || lpad((c_custkey * 7907)::VARCHAR, 11, '0') || lpad({_KEY}::VARCHAR, 2, '0')"
_IBAN = f"""WITH b AS (SELECT c_custkey, {_BBAN} AS bban FROM customer),
  i AS (SELECT c_custkey, 'FR' || lpad((98 - (bban || '152700')::HUGEINT % 97)::VARCHAR, 2, '0') || bban AS iban FROM b)"""

ORACLE_SQL = {
    "amount_parse": """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE (round(l_extendedprice * 100)::BIGINT // 100)::VARCHAR || '.' || lpad((round(l_extendedprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') END AS amount
  FROM lineitem""",
    "percentage_parse": "SELECT l_orderkey, l_partkey, l_linenumber, round(l_tax * 100)::INT || '.00' AS percentage, round(CASE WHEN round(l_tax * 100) > 1 THEN round(l_tax * 100) / 100 ELSE round(l_tax * 100) END, 4) AS rate, round(l_tax * 100)::INT || '%' AS shown FROM lineitem",
    "siret_parse": """WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, 14, '1') AS s FROM customer), v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN s END AS siret FROM d)
  SELECT c_custkey, siret, trim(regexp_replace(siret, '(.{3})', '\\1 ', 'g')) AS shown FROM v""",
    "bic_parse": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'BNPAFRPP' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN 'BNPAFRPP' END AS bic FROM supplier",
    "iban_mod97": f"{_IBAN} SELECT c_custkey, iban, c_custkey % 2 = 0 AS valid, trim(regexp_replace(iban, '(.{{4}})', '\\1 ', 'g')) AS shown FROM i",
    "iban_correct": f"""{_IBAN}, w AS (SELECT c_custkey, iban, iban[:10] || ((iban[11]::INT + 3) % 10) || iban[12:] AS x FROM i),
  t AS (SELECT c_custkey, x[:p - 1] || d || x[p + 1:] AS y FROM w, range(5, 28) r(p), range(10) q(d) WHERE x[p] <> d::VARCHAR UNION ALL SELECT c_custkey, 'GR' || x[3:] FROM w),
  g AS (SELECT DISTINCT c_custkey, y FROM t WHERE CASE WHEN y[:2] = 'FR' THEN y[5:]::HUGEINT % 97 = 0 AND (y[5:] || '1527' || y[3:4])::HUGEINT % 97 = 1 ELSE (y[5:] || '1627' || y[3:4])::HUGEINT % 97 = 1 END)
  SELECT c_custkey, CASE WHEN count(y) = 1 THEN min(y) END AS corrected, true AS cleaned FROM w LEFT JOIN g USING (c_custkey) GROUP BY c_custkey""",
    "normalize_name_city": "SELECT c_custkey, 'Saint-' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Sur ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS city FROM customer",
    "postal_address_clean": """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN '75' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS code FROM customer), b AS (SELECT *, CASE WHEN c_custkey % 5 = 0 OR code IS NOT NULL THEN 'France' END AS country FROM a)
  SELECT c_custkey, code, country, concat_ws(', ', c_custkey || ' rue de la paix', concat_ws(' ', code, 'Paris'), country) AS line FROM b""",
    "lots_full_merge": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
  SELECT l_orderkey, l_linenumber AS numero_lot, CASE WHEN l_linenumber < 5 THEN 't' || l_linenumber END AS titre, CASE WHEN l_linenumber > 2 THEN 'a' || l_linenumber END AS montant FROM l""",
    "json_props_path": "SELECT event_id, (props->>'$.k')::BIGINT AS k, [(props->>'$.k')::BIGINT, 1] AS ks FROM events",
    "api_date_parse": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 END AS ms, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, 'datetime''%Y-%m-%dT%H:%M:%S''') END AS literal FROM events""",
    "activity_kinds": "SELECT CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'UPDATE' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "field_accuracy": f"{_MATCHES} SELECT field, count(*) AS total, count(*) FILTER (match) AS matches, count(*) FILTER (NOT match) AS errors, round(count(*) FILTER (match) / count(*), 6) AS accuracy FROM m GROUP BY field",
    "global_accuracy": f"{_MATCHES} SELECT round(count(*) FILTER (match) / count(*), 6) AS accuracy, count(*) AS total FROM m",
    "errors_per_file": f"{_MATCHES} SELECT doc_id, coalesce(string_agg(field, ',' ORDER BY position) FILTER (NOT match), '') AS errors FROM m GROUP BY doc_id",
    "accuracy_against_best": f"{_MATCHES} SELECT field, count(*) FILTER (best AND NOT match) AS regressions, count(*) FILTER (match AND NOT best) AS improvements, round(count(*) FILTER (match) / count(*) - count(*) FILTER (best) / count(*), 6) AS delta FROM m GROUP BY field",
    "confusion_matrix": f"{_PREDICTED} SELECT quality, predicted, count(*) AS n FROM p GROUP BY ALL",
    "class_recall": f"{_PREDICTED} SELECT quality, count(*) AS total, count(*) FILTER (quality = predicted) AS correct, round(count(*) FILTER (quality = predicted) / count(*), 6) AS recall FROM p GROUP BY quality",
    "multiset_match": """WITH o AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS a, coalesce(list(l_returnflag) FILTER (l_linenumber % 2 = 0), []) AS b FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, a = list_sort(list_concat(b, b)) AS same, list_has_all(b, a) AS inside FROM o""",
    "contractor_matching": """WITH l AS (SELECT l_orderkey, l_suppkey AS s, l_partkey % 11 = 0 AND l_linenumber = 2 AS wrong, l_partkey % 7 <> 0 OR l_linenumber <> 1 AS kept FROM lineitem),
  t AS (SELECT l_orderkey, list_sort(list(s || '/' || s)) AS truth, list_sort(coalesce(list(s || '/' || CASE WHEN wrong THEN 'x' ELSE s::VARCHAR END) FILTER (kept), [])) AS found FROM l GROUP BY l_orderkey)
  SELECT l_orderkey, found = truth AS matched, len(found) > 0 AND list_has_all(truth, found) AS contained FROM t""",
    "tolerant_matching": """WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS b FROM lineitem GROUP BY l_orderkey),
  p AS (SELECT l_orderkey, b, list_transform(list_concat(b[2:], b[1:1]), lambda x: x + 6) AS a FROM l),
  f AS (SELECT l_orderkey, len(b) AS n, list_reduce(b, lambda acc, y: list_concat(acc, coalesce(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(acc, i) AND abs(a[i] - y) <= 10)[1:1], [])), []::BIGINT[]) AS used FROM p)
  SELECT l_orderkey, len(used) = n AS matched FROM f""",
    "lots_compare": """WITH n AS (SELECT l_orderkey, bool_and(l_partkey % 5 <> 0) AS titre, bool_and(l_partkey % 6 <> 0) AS forme, bool_and(l_partkey % 7 <> 0) AS duree_lot, bool_or(l_partkey % 8 <> 0) AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber)
  SELECT l_orderkey, bool_and(titre) AS titre, bool_and(forme) AS forme, bool_and(duree_lot) AS duree_lot, bool_and(amount) AS montant_ht FROM n GROUP BY l_orderkey""",
    "registry_match": f"""WITH r(k, kind, i, field) AS (VALUES {_REGISTRY}) SELECT kind, field, count(*) AS total, count(*) FILTER ((o_orderkey + i) % 7 <> 0 AND (o_orderkey + i) % 9 <> 0) AS matches
  FROM orders JOIN r ON o_orderkey % {len(compare.REGISTRY)} = k GROUP BY kind, field""",
}
