"""The benchmark tables seen as a graph, a log and a corpus; and the same as SQL.

``SQL`` defines the relations nodes, edges, tags, log and spans by common table
expressions over the tables; the functions build the same DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import deal

PHRASES = [
    "Key decision about the storage layout was agreed", "Found the root cause of the crash in the loader", "Filed the daily report", "Discussed naming in the weekly meeting",
    "New workaround for the broken index", "Private note about a first time discovery", "Confidential strategy for the milestone", "Nothing much to say today",
    "Implemented the convention and fixed the build", "Session ran; observation written down", "Unexpected security finding in the agent", "Plain text with no signal words",
]
SENTENCES = [
    "Anna Keller met Boris Novak at the docker workshop.", "The team decided to Use Parquet Files, and python scripts read them.", "We found a bug in Loader Module. It depends on redis.",
    "Carla Jensen wrote the terraform guide.", "No signal here at all.", "Anna Keller and Carla Jensen reviewed the sqlite export.",
]
AS_OF, LOG_AS_OF = "2001-09-01 00:00:00", "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    ts = lambda s: F.to_timestamp(F.lit(s))

    def rows(df, **c):
        base = {"confidence": F.lit(1.0), "created_at": ts("1995-01-01 00:00:00"), "category": F.lit("knowledge"), "sensitivity": F.lit(0), "pinned": F.lit(False), "description": F.lit(""), "source_agent": F.lit(""), "namespace": F.lit("unclassified"), "last_reinforced": ts("2001-06-01 00:00:00")} | c
        order = ["id", "type", "name", "description", "salience", "confidence", "source_agent", "created_at", "last_reinforced", "category", "namespace", "sensitivity", "pinned"]
        return df.select([base[k].alias(k) for k in order])

    key = F.col("c_custkey")
    customer = rows(
        t("customer").join(last, key == F.col("o_custkey"), "left"), id=F.concat(F.lit("customer-"), key.cast("string")), type=F.lit("person"), name=F.col("c_name"), description=F.col("c_mktsegment"), salience=(F.col("c_acctbal") + 1000.0) / 11000.0,
        source_agent=F.lower("c_mktsegment"), last_reinforced=F.coalesce("last", ts("1995-01-01 00:00:00")), namespace=F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")), sensitivity=F.when(key % 5 == 4, None).otherwise((key % 4).cast("int")), pinned=key % 50 == 0)
    supplier = rows(t("supplier"), id=F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")), type=F.lit("tool"), name=F.col("s_name"), salience=(F.col("s_acctbal") + 1000.0) / 11000.0, source_agent=F.lit("supply"))
    part = rows(
        t("part"), id=F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), type=F.lit("pattern"), name=F.col("p_name"), description=F.concat("p_type", F.lit(" "), "p_brand"), salience=F.col("p_size") / 50.0, source_agent=F.lit("catalog"),
        category=F.lit("nrem"), last_reinforced=F.to_timestamp(F.date_add(F.to_date(F.lit("2000-01-01")), (F.col("p_partkey") % 600).cast("int"))))
    nation = rows(t("nation"), id=F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")), type=F.lit("concept"), name=F.col("n_name"), salience=F.lit(0.5))
    region = rows(t("region"), id=F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")), type=F.lit("initiative"), name=F.col("r_name"), salience=F.lit(0.9))
    return customer.unionByName(supplier).unionByName(part).unionByName(nation).unionByName(region)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    cat = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = lambda df, s, d: df.select(s.alias("source_id"), d.alias("target_id"), F.lit("belongs_to").alias("relationship"), F.lit(1.0).alias("weight"))
    out = one(t("customer"), cat("customer-", "c_custkey"), cat("nation-", "c_nationkey")).unionByName(one(t("supplier"), cat("supplier-", "s_suppkey"), cat("nation-", "s_nationkey"))).unionByName(one(t("nation"), cat("nation-", "n_nationkey"), cat("region-", "n_regionkey")))
    weight = F.least(F.lit(1.0), 0.1 * F.col("n")).alias("weight")
    supply = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).select(cat("part-", "l_partkey").alias("source_id"), cat("supplier-", "l_suppkey").alias("target_id"), F.lit("depends_on").alias("relationship"), weight)
    line = t("lineitem").select("l_orderkey", "l_partkey")
    met = deal(line, size := line.count(), "l_orderkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey")
    bought = deal(met, size, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    buys = bought.select(cat("customer-", "o_custkey").alias("source_id"), cat("part-", "l_partkey").alias("target_id"), F.lit("relates_to").alias("relationship"), weight)
    return out.unionByName(supply).unionByName(buys)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("node_id"), F.lower("c_mktsegment").alias("tag"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("node_id"), F.explode(F.array(F.lower("p_brand"), F.lower("p_type"))).alias("tag"))
    return c.unionByName(p).distinct()


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "action").when(F.col("event_type") == "click", "finding").otherwise("observation")
    phrase = F.element_at(F.array([F.lit(p) for p in PHRASES]), (F.col("event_id") % len(PHRASES) + 1).cast("int"))
    head = F.when(F.col("event_id") % 7 == 0, "Session Handover notes").otherwise("")
    tag = F.when(F.col("event_id") % 11 == 0, "ops, private").when(F.col("event_id") % 13 == 0, "internal").otherwise("")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(head == "", phrase).otherwise(F.concat(head, F.lit("\n"), phrase))
    return e.select(F.col("event_id").alias("seq"), ts.alias("ts"), F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string")).alias("agent"), kind.alias("type"), head.alias("heading"), phrase.alias("content"), tag.alias("tags"), text.alias("full_text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: each document below a sentence of the table; a path is a source and the document's number by tens."""
    d = read(spark, sf_dir, "documents")
    lead = F.element_at(F.array([F.lit(s) for s in SENTENCES]), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    return d.select(F.col("doc_id"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 10).cast("string")).alias("path"), lead.alias("lead"), F.concat(lead, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, embedding: vectors of the part nodes with their numbers."""
    return read(spark, sf_dir, "embeddings").select(F.concat(F.lit("part-"), F.col("vec_id").cast("string")).alias("node_id"), "embedding")


def _array(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = f"""
nodes as (
  select 'customer-' || c_custkey as id, 'person' as type, c_name as name, c_mktsegment as description, (c_acctbal + 1000.0) / 11000.0 as salience, lower(c_mktsegment) as source_agent,
    coalesce(last, timestamp '1995-01-01') as last_reinforced, 'knowledge' as category, 'nation-' || c_nationkey as namespace, case when c_custkey % 5 = 4 then null else (c_custkey % 4)::int end as sensitivity, c_custkey % 50 = 0 as pinned
  from customer left join (select o_custkey, max(o_orderdate) as last from orders group by 1) on c_custkey = o_custkey
  union all select 'supplier-' || s_suppkey, 'tool', s_name, '', (s_acctbal + 1000.0) / 11000.0, 'supply', timestamp '2001-06-01', 'knowledge', 'unclassified', 0, false from supplier
  union all select 'part-' || p_partkey, 'pattern', p_name, p_type || ' ' || p_brand, p_size / 50.0::double, 'catalog', (date '2000-01-01' + (p_partkey % 600)::int)::timestamp, 'nrem', 'unclassified', 0, false from part
  union all select 'nation-' || n_nationkey, 'concept', n_name, '', 0.5, '', timestamp '2001-06-01', 'knowledge', 'unclassified', 0, false from nation
  union all select 'region-' || r_regionkey, 'initiative', r_name, '', 0.9, '', timestamp '2001-06-01', 'knowledge', 'unclassified', 0, false from region),
edges as (
  select 'customer-' || c_custkey as source_id, 'nation-' || c_nationkey as target_id, 'belongs_to' as relationship, 1.0::double as weight from customer
  union all select 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'belongs_to', 1.0 from supplier
  union all select 'nation-' || n_nationkey, 'region-' || n_regionkey, 'belongs_to', 1.0 from nation
  union all select 'part-' || l_partkey, 'supplier-' || l_suppkey, 'depends_on', least(1.0::double, 0.1::double * count(*)) from lineitem group by l_partkey, l_suppkey
  union all select 'customer-' || o_custkey, 'part-' || l_partkey, 'relates_to', least(1.0::double, 0.1::double * count(*)) from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey),
tags as (
  select 'customer-' || c_custkey as node_id, lower(c_mktsegment) as tag from customer union select 'part-' || p_partkey, lower(p_brand) from part union select 'part-' || p_partkey, lower(p_type) from part),
log0 as (
  select event_id as seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, 'agent-' || (user_id % 5) as agent,
    case event_type when 'error' then 'error' when 'purchase' then 'decision' when 'signup' then 'action' when 'click' then 'finding' else 'observation' end as type,
    case when event_id % 7 = 0 then 'Session Handover notes' else '' end as heading, ({_array(PHRASES)})[(event_id % {len(PHRASES)} + 1)::int] as content,
    case when event_id % 11 = 0 then 'ops, private' when event_id % 13 = 0 then 'internal' else '' end as tags from events),
log as (select *, case when heading = '' then content else heading || chr(10) || content end as full_text from log0),
files as (
  select *, lead || chr(10) || body as text from (
    select doc_id, coalesce(source, '') || '/' || (doc_id // 10) as path, ({_array(SENTENCES)})[(doc_id % {len(SENTENCES)} + 1)::int] as lead, coalesce(text, '') as body from documents)),
node_embeddings as (select 'part-' || vec_id as node_id, embedding from embeddings)
"""
