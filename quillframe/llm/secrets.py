"""Secret scans through a trigram inverted index, as DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, maybe_broadcast, saved, table


@dataclass(frozen=True)
class Rule:
    """A Java regex; where `group` is set, a match counts only if that group has `least` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order that breaks ties of their starts. Of a maximal run of a class, `+` with a minimum checked
#: afterwards and the minimum as a repeat count find the same spans; assignments also swallow what is too short.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Texts that a piece of a regex can stand for are listed up to so many; beyond, the piece is taken for anything.
FEW = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000

#: A query is True (every text), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _all(queries: list[Query], op: str) -> Query:
    whole = op == "or"
    if whole and True in queries:
        return True
    kept = sorted({q for q in queries if q is not True}, key=repr)
    return True if not kept else kept[0] if len(kept) == 1 else (op, tuple(kept))


def _literal(texts: set[str] | None) -> Query:
    if not texts:
        return True
    return _all([_all([t[i : i + 3] for i in range(len(t) - 2)], "and") for t in texts], "or")


def _members(item: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in item:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < FEW:
            out |= {chr(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= FEW else None


def _read(item) -> tuple[set[str] | None, Query]:
    """Texts that the item stands for, if few, and a query that every text with a match satisfies."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg)}, True
    if op is C.IN:
        return _members(arg), True
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        read = [_sequence(x) for x in arg[1]]
        if all(t is not None for t, _ in read) and len(texts := set().union(*(t for t, _ in read))) <= FEW:
            return texts, True
        return None, _all([_all([q, _literal(t)], "and") for t, q in read], "or")
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        texts, query = _sequence(inner)
        if (low, high) == (0, 1) and texts is not None:
            return texts | {""}, True
        if low == high == 1:
            return texts, query
        return None, _all([query, _literal(texts)], "and") if low else True
    return ({""} if op is C.AT else None), True


def _sequence(items) -> tuple[set[str] | None, Query]:
    run: set[str] = {""}
    exact, queries = True, []
    for item in items:
        texts, query = _read(item)
        queries.append(query)
        joined = {a + b for a in run for b in texts} if texts is not None else None
        if joined is not None and len(joined) <= FEW:
            run = joined
        else:
            queries.append(_literal(run))
            exact, run = False, texts if texts is not None else {""}
    if exact:
        return run, _all(queries, "and")
    return None, _all([*queries, _literal(run)], "and")


def trigram_query(regex: str) -> Query:
    """A Boolean query over lower-cased trigrams that holds for every text in which the regex matches."""
    texts, query = _sequence(parser.parse(regex.removeprefix("(?i)")))
    fold = lambda q: q.translate(str.maketrans(UPPER, LOWER)) if isinstance(q, str) else q if q is True else _all([fold(x) for x in q[1]], q[0])
    return fold(_all([query, _literal(texts)], "and"))


def trigrams_in(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


def postings(docs: DataFrame, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index of the rules' trigrams: trigram (its place in the list), key (xxhash64 of the text).

    Equal texts are one entry. Two texts with one key would share candidates, which verification sorts out.
    """
    folded = docs.select(F.xxhash64(F.col(text)).alias("key"), F.translate(F.col(text), UPPER, LOWER).alias("folded"))
    found = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return folded.select("key", F.explode(found).alias("trigram")).groupBy("trigram", "key").agg(F.lit(1).alias("one")).select("trigram", "key")


def candidates(index: DataFrame, queries: list[Query], trigrams: list[str]) -> DataFrame:
    """key, rules (bit i: the postings meet query i), for keys that meet any query that isn't True."""
    words = range(0, len(trigrams), 60)
    place = {t: i for i, t in enumerate(trigrams)}
    bit = lambda w: F.expr(f"if(trigram between {w} and {w + 59}, shiftleft(1L, trigram - {w}), 0L)")
    met = index.groupBy("key").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            i = place[q]
            return F.col(f"w{i // 60 * 60}").bitwiseAND(F.lit(1 << (i % 60))) != 0
        parts = [holds(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out

    rules = F.lit(0)
    for i, q in enumerate(queries):
        if q is not True:
            rules = rules.bitwiseOR(F.when(holds(q), F.lit(1 << i)).otherwise(F.lit(0)))
    return met.select("key", rules.alias("rules")).where("rules != 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's leftmost non-overlapping matches: array of struct(start, order, end, kind), code points, end exclusive."""
    between = F.split(text, rule.regex, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    each = F.transform(F.arrays_zip(between.alias("gap"), matches.alias("hit"), checked.alias("part")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")))
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    walk = F.aggregate(
        F.filter(each, lambda x: x["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.when(
                x["part"] >= rule.least,
                F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("order"), (acc["at"] + x["gap"] + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind")))),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(rule.regex), walk).otherwise(none)


def scanned(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, into: str = "secret_spans") -> DataFrame:
    """docs with a column `into`: array of struct(start, order, end, kind), by start, then rule.

    Rules with mandatory trigrams are verified only on the texts whose postings meet their query; others scan every text.
    Null texts have no spans. All rows and columns stay, but for an old column of the name `into`; an empty table gives none.
    """
    if len(rules) > 31:
        raise ValueError("at most 31 rules")
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_in, queries)))
    found = saved(candidates(postings(docs, text, trigrams), queries, trigrams), "candidates")
    key, met, text_key = fresh(docs.columns, "key", "rules", "text_key")
    found = found.select(F.col("key").alias(key), F.col("rules").alias(met))
    rows = docs.withColumn(text_key, F.xxhash64(F.col(text)))
    rows = rows.join(maybe_broadcast(found, found.count(), BROADCAST_ROWS), F.col(text_key) == F.col(key), "left")
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    parts = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        spans = spans_of(F.col(text), rule, i)
        parts.append(spans if query is True else F.when(F.coalesce(F.col(met), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(none))
    spans = F.when(F.col(text).isNull(), none).otherwise(F.array_sort(F.concat(*parts)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], spans.alias(into))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text, overlapping ones as one, replaced by the mark. All rows and columns stay."""
    body = F.col(text)
    cut = lambda a, n: F.substring(body, a + F.lit(1), n)
    (spans,) = fresh(docs.columns, "secret_spans")
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], cut(acc["at"], s["start"] - acc["at"]), F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        ),
        lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(body))),
    )
    rows = scanned(docs, text, into=spans)
    return rows.withColumn(text, F.when(F.size(spans) > 0, walk).otherwise(body)).drop(spans)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and further spans of secrets in each text. Null texts are empty; repeated rows stay; an empty table gives none."""
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    count = lambda i: F.size(F.filter(spans, lambda s: s["order"] == i)).cast("long")
    base = F.filter(spans, lambda s: s["order"] < len(BASE))
    return rows.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _oracle() -> str:
    """The spans by splitting each text at a rule's matches, as SQL."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, {_quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {_quoted(r.regex)}, 0) AS hits, regexp_extract_all(t, {_quoted(r.regex)}, {r.group}) AS parts, string_split_regex(t, {_quoted(r.regex)}) AS gaps FROM d"
        for i, r in enumerate(BASE + MORE)
    )
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
  u AS (SELECT doc_id, k, kind, least, hits[i] AS hit, parts[i] AS part, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a FROM m, unnest(range(1, len(hits) + 1)) AS r(i)),
  s AS (SELECT doc_id, k, a, kind || ':' || a::BIGINT || ':' || (a + length(hit))::BIGINT AS span FROM u WHERE length(part) >= least)
  SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
  FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLE_SQL = _oracle()
