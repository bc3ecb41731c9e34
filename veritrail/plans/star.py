"""The star schema read as a record graph.

Nodes are customers, parts and orders (decisions); edges lead from customers to
orders and from orders to parts; urgent orders are retracted 30 days after their
date, recorded 45 days after it.  An order holds from its date: for ever (status
O), for 60 days (F) or for 120 (P).  Each definition stands beside its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(start: Column, n: Column | int) -> Column:
    return start + F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, valid_from, valid_until, recorded_at."""
    date = F.col("o_orderdate").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    first = F.lit("1995-01-01 00:00:00").cast("timestamp")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("node").alias("kind"), none.alias("valid_from"), none.alias("valid_until"), first.alias("recorded_at"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey"), F.lit("node"), none, none, first)
    end = F.when(F.col("o_orderstatus") == "F", days(date, 60)).when(F.col("o_orderstatus") == "P", days(date, 120))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey"), F.lit("decision"), date, end, days(date, (F.col("o_orderkey") % 30).cast("int")))
    return c.union(p).union(o)


NODES = """nodes AS (
  SELECT 'c:' || c_custkey AS id, 'node' AS kind, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_until, TIMESTAMP '1995-01-01' AS recorded_at FROM customer
  UNION ALL SELECT 'p:' || p_partkey, 'node', NULL, NULL, TIMESTAMP '1995-01-01' FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'decision', o_orderdate, CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 60 DAY WHEN 'P' THEN o_orderdate + INTERVAL 120 DAY END,
    o_orderdate + to_days((o_orderkey % 30)::INT) FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, target, type, weight, valid_from, valid_until, recorded_at."""
    date, shipped = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c:"), "o_custkey", F.lit("->o:"), "o_orderkey").alias("id"), F.concat(F.lit("c:"), "o_custkey").alias("source"), F.concat(F.lit("o:"), "o_orderkey").alias("target"),
        F.lit("CAUSED").alias("type"), F.lit(1.0).alias("weight"), date.alias("valid_from"), none.alias("valid_until"), date.alias("recorded_at"),
    )
    i = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o:"), "l_orderkey", F.lit("->p:"), "l_partkey", F.lit("#"), "l_linenumber"), F.concat(F.lit("o:"), "l_orderkey"), F.concat(F.lit("p:"), "l_partkey"),
        F.lit("INFLUENCED"), 1 - F.col("l_discount"), shipped, none, days(shipped, 1),
    )
    return o.union(i)


EDGES = """edges AS (
  SELECT 'c:' || o_custkey || '->o:' || o_orderkey AS id, 'c:' || o_custkey AS source, 'o:' || o_orderkey AS target, 'CAUSED' AS type, 1.0::DOUBLE AS weight,
    o_orderdate AS valid_from, NULL::TIMESTAMP AS valid_until, o_orderdate AS recorded_at FROM orders
  UNION ALL SELECT 'o:' || l_orderkey || '->p:' || l_partkey || '#' || l_linenumber, 'o:' || l_orderkey, 'p:' || l_partkey, 'INFLUENCED', 1 - l_discount,
    l_shipdate, NULL, l_shipdate + INTERVAL 1 DAY FROM lineitem)"""


def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, at, recorded_at."""
    date = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o:"), "o_orderkey").alias("subject"), days(date, 30).alias("at"), days(date, 45).alias("recorded_at"))


RETRACTIONS = """retractions AS (
  SELECT 'o:' || o_orderkey AS subject, o_orderdate + INTERVAL 30 DAY AS at_time, o_orderdate + INTERVAL 45 DAY AS recorded_at FROM orders WHERE o_orderpriority = '1-URGENT')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between conversation turns: each turn to the next and to the one after it."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    node = lambda c: F.concat("conv_id", F.lit(":"), c)
    steps = t.select("conv_id", "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("step"))
    there = t.select("conv_id", F.col("turn").alias("next"))
    both = steps.withColumn("next", F.col("turn") + F.col("step")).join(there, ["conv_id", "next"])
    return both.select(
        F.concat(node("turn"), F.lit("+"), "step").alias("id"), node("turn").alias("source"), node("next").alias("target"),
        F.when(F.col("step") == 1, "CAUSED").otherwise("INFLUENCED").alias("type"), (F.lit(1.0) - F.col("turn") % 3 * 0.125 - F.col("step") * 0.0625).alias("weight"),
    )


TURNS = """turns AS (
  SELECT t.conv_id || ':' || t.turn || '+' || s.step AS id, t.conv_id || ':' || t.turn AS source, t.conv_id || ':' || n.turn AS target,
    CASE s.step WHEN 1 THEN 'CAUSED' ELSE 'INFLUENCED' END AS type, (1.0 - (t.turn % 3) * 0.125 - s.step * 0.0625)::DOUBLE AS weight
  FROM (SELECT DISTINCT conv_id, turn FROM conversations) t, (VALUES (1), (2)) s(step), (SELECT DISTINCT conv_id, turn FROM conversations) n
  WHERE n.conv_id = t.conv_id AND n.turn = t.turn + s.step)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one log per user: workspace, pos, seq, id, kind, prev, digest, content_digest, salt, content.

    ``digest`` depends on the row alone, so ``prev`` needs no fold, and is made of the row
    before, so that digests need not be sorted.
    """
    w = Window.partitionBy("workspace").orderBy("pos")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("workspace"), F.col("event_id").alias("pos"), "event_type")
    rows = rows.withColumns({"seq": F.row_number().over(w).cast("long"), "_pos": F.lag("pos").over(w), "_type": F.lag("event_type").over(w)})

    def parts(pos: str, kind: str) -> tuple[Column, Column, Column, Column, Column]:
        id_, salt, content = F.concat(F.lit("e:"), pos), F.concat(F.lit("s"), F.col(pos) % 10), F.concat(F.lit('{"type":"'), kind, F.lit('"}'))
        content_digest = F.sha2(F.concat(F.lit("2:"), salt, content).cast("binary"), 256)
        return id_, salt, content, content_digest, F.sha2(F.concat(id_, F.lit("|"), content_digest).cast("binary"), 256)

    id_, salt, content, content_digest, digest = parts("pos", "event_type")
    return rows.select(
        "workspace", "pos", id_.alias("id"), F.lit("node").alias("kind"), salt.alias("salt"), content.alias("content"), "event_type",
        content_digest.alias("content_digest"), digest.alias("digest"), "seq", parts("_pos", "_type")[-1].alias("prev"),
    )


EVENT_LOG = """raw AS (
  SELECT user_id::VARCHAR AS workspace, event_id AS pos, 'e:' || event_id AS id, 's' || (event_id % 10) AS salt, '{"type":"' || event_type || '"}' AS content, event_type FROM events),
digested AS (SELECT *, sha256('2:' || salt || content) AS content_digest FROM raw),
selfed AS (SELECT *, sha256(id || '|' || content_digest) AS digest FROM digested),
log AS (SELECT *, row_number() OVER w AS seq, lag(digest) OVER w AS prev FROM selfed WINDOW w AS (PARTITION BY workspace ORDER BY pos))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names with their type and brand as records: id, name, type, props."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_brand").alias("brand"))
    return p.select(F.concat("p_name", F.lit("|"), "p_type").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.create_map(F.lit("brand"), "brand").alias("props"))


NAMES = "records AS (SELECT p_name || '|' || p_type AS id, p_name AS name, p_type AS type, min(p_brand) AS brand FROM part GROUP BY p_name, p_type)"

_PARTS = "list_filter(string_split(trim(regexp_replace(lower(name), '[_\\-/.\\s]+', ' ', 'g')), ' '), lambda t: t <> '')"
_RUNS = "regexp_replace({}, '1+', '1', 'g')"


def sound_sql(word: str) -> str:
    letters = f"regexp_replace(upper({word}), '[^A-Z]', '', 'g')"
    digits = f"translate(substr({letters}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE substr(substr({letters}, 1, 1) || {digits} || '000', 1, greatest(4, 0)) END"


def keys_sql(source: str, name: str = "name", type_: str | None = None, phonetic: bool = False) -> str:
    """id, key of a relation, as one SELECT."""
    parts = _PARTS.replace("lower(name)", f"lower({name})")
    kept = f"list_filter({parts}, lambda t: length(t) >= 3)"
    tokens = f"CASE WHEN len({kept}) > 0 THEN {kept} WHEN len({parts}) > 0 THEN [array_to_string({parts}, '')] ELSE [] END"
    out = [f"SELECT id, 'tok:' || substr(t, 1, 4) AS key FROM tokened, unnest(ts) AS u(t)"]
    if type_:
        out.append(f"SELECT id, 'type:' || lower(coalesce({type_}, 'unknown')) || ':' || substr(ts[1], 1, 4) FROM tokened WHERE len(ts) > 0")
    if phonetic:
        out.append(f"SELECT id, 'pho:' || {sound_sql('t')} FROM tokened, unnest(ts) AS u(t)")
    out.append("SELECT id, 'nameless:' FROM tokened WHERE len(ts) = 0")
    return f"(WITH tokened AS (SELECT *, {tokens} AS ts FROM {source}) SELECT DISTINCT id, key FROM ({' UNION ALL '.join(out)}))"


def grams_sql(text: str) -> str:
    padded = f"(' ' || trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')) || ' ')"
    return f"CASE WHEN length({padded}) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length({padded}) - 1), lambda i: substr({padded}, i, 3))) END"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE {both} / {union}::DOUBLE END"


def asked(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    """Queries: the first ``words`` words of each benchmark item, as in the SQL twin, or the whole item for None."""
    query = F.col("text") if words is None else F.array_join(F.slice(F.split("text", " "), 1, words), " ")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("query_id"), query.alias("query"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document to the next of its source, by residue of the id: 20 sources take turns."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    there = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next"))
    return d.join(there, "doc_id").select(F.col("doc_id").cast("string").alias("source"), F.col("next").cast("string").alias("target"))


RETRIEVAL = """asked AS (SELECT 'q' || item_id AS query_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS query FROM benchmark),
links AS (SELECT a.doc_id::VARCHAR AS source, b.doc_id::VARCHAR AS target FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
toks AS (SELECT doc_id::VARCHAR AS id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS ts FROM documents),
doc_tokens AS (SELECT DISTINCT id, n_tokens, token FROM (SELECT id, len(ts) AS n_tokens, unnest(ts) AS token FROM toks)),
query_tokens AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]{2,}')) AS token FROM asked)),
df AS (SELECT token, count(*) AS df FROM doc_tokens GROUP BY token),
weights AS (SELECT token, ln(1 + n / df) / ln(1 + n) AS w FROM df, (SELECT count(*)::DOUBLE AS n FROM documents)),
lexical_raw AS (
  SELECT query_id, id, round(sum(w) / sqrt(any_value(n_tokens)), 12) AS score FROM query_tokens JOIN weights USING (token) JOIN doc_tokens USING (token) GROUP BY query_id, id HAVING sum(w) > 0),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexical_raw),
seeds AS (SELECT query_id, id FROM lexical WHERE score >= {floor}),
around AS (SELECT source AS f, target AS id FROM links WHERE source <> target UNION ALL SELECT target, source FROM links WHERE source <> target),
structural_raw AS (
  SELECT s.query_id, a.id, count(*)::DOUBLE AS score FROM around a JOIN seeds s ON s.id = a.f WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.id = a.id) GROUP BY s.query_id, a.id),
structural AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM structural_raw),
channels AS (SELECT 'lexical' AS channel, * FROM lexical UNION ALL SELECT 'structural', * FROM structural),
passed AS (SELECT * FROM channels WHERE score >= CASE channel WHEN 'lexical' THEN {floor} ELSE 1 END),
fused_raw AS (SELECT query_id, id, round(sum(1.0::DOUBLE / ({k} + rank)), 15) AS fused, count(*) AS n_channels FROM passed GROUP BY query_id, id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS position FROM fused_raw),
served AS (SELECT * FROM fused WHERE position <= 10)"""


def retrieval_sql(floor: float = 0.3, k: int = 60) -> str:
    return RETRIEVAL.replace("{floor}", str(floor)).replace("{k}", str(k))
