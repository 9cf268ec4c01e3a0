"""Queries that put extractions, logs and code into a graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.operators import code_index, consolidate, graph
from graphloom.plans import projection as P
from graphloom.plans.catalogue import _DAYS, _IMP, _MARKS, _MENTIONS, _NOV, _as_of, _extractions, _g, _parsed, _state, query, r6
from graphloom.sources.code_parsers import parse_entities
from graphloom.sources.shared import settle

R6 = "floor(({0}) * 1e6 + 0.5) / 1e6"
#: What mentions m make of nodes: salience, description, and of new ones namespace and level.
_FOLD = f"""{_MENTIONS}, f as (select id, count(*) as n, arg_min(salience, seq) as first, arg_min(type, seq) as type, arg_min(name, seq) as name, arg_max(description, length(description) * 1000000000 - seq) as new, arg_min(seq, seq) as place from m group by 1),
grown as (
  select f.id, f.n, nodes.id is null as added, case when nodes.id is not null then least(1.0, nodes.salience + 0.1 * n) when n = 1 then first else least(1.0, first + 0.1 * (n - 1)) end as salience,
    f.type, place, new from f left join nodes on nodes.id = f.id)"""


@query(f"""with {_FOLD} select id, {R6.format('salience')} as salience, case when added then 'agent-scribe-' || (place % 3) end as namespace, case when added then case type when 'person' then 2 else 0 end end as sensitivity from grown""")
def ingest_extractions(spark, d):
    """An extraction an order by one of three agents: the nodes that they touch; of those added also namespace and level."""
    g = _g(spark, d)
    given = _extractions(spark, d).withColumn("agent", F.concat(F.lit("scribe-"), (F.col("seq") % 3).cast("string")))
    out, _, _ = consolidate.ingest_extractions(g, given, None, _as_of())
    new = F.col("namespace").startswith("agent-scribe")
    touched = out.nodes.filter(F.col("last_reinforced") == _as_of()).filter(new | F.col("id").startswith("customer-"))
    hit = given.select(F.concat(F.lit("customer-"), F.regexp_extract("json", '"name":"Customer ([0-9]+)"', 1)).alias("id")).distinct()
    touched = touched.filter(new).unionByName(touched.filter(~new).join(hit, "id", "left_semi"))
    return touched.select("id", r6("salience").alias("salience"), F.when(new, F.col("namespace")).alias("namespace"), F.when(new, F.col("sensitivity")).alias("sensitivity"))


def _entries(spark, d) -> DataFrame:
    return P.log(spark, d).select("seq", F.substring("ts", 1, 10).alias("date"), "heading", "content", F.col("type").alias("entry_type"), "full_text")


_SINCE = "2024-01-10"


@query(f"""with {_FOLD}, e as (select * from log where substr(ts, 1, 10) >= '{_SINCE}')
select (select count(*) from e) as entries_processed, (select count(*) from m) as entities_extracted, (select count(*) from orders) as relationships_extracted,
  (select count(*) from grown where added) as nodes_added, (select sum(n - added::int) from grown)::bigint as nodes_reinforced, (select count(*) from orders) as edges_added""")
def nrem_cycle(spark, d):
    """The log from a day on replayed with an extraction an order: the counts."""
    g = _g(spark, d)
    out = consolidate.nrem_replay(g, _entries(spark, d), _as_of(), since=_SINCE, extractions=_extractions(spark, d))
    return out.counts.select("entries_processed", "entities_extracted", "relationships_extracted", "nodes_added", "nodes_reinforced", "edges_added")


_COMB = "floor(least(1.0::double, imp * 0.7::double + nov * (1.0::double - 0.7::double)) * 1000 + 0.5) / 1000"


@query(f"with s as (select *, {_IMP} as imp, {_NOV} as nov from log where substr(ts, 1, 10) >= '{_SINCE}') select seq, '[' || printf('%.2f', {_COMB}) || '] ' || substr(ts, 1, 10) || ': ' || case when heading != '' then heading else substr(content, 1, 60) end as line from s where {_COMB} >= 0.7")
def nrem_high_salience(spark, d):
    """Lines of the replayed entries that stand out."""
    return consolidate.nrem_replay(graph.Graph.empty(spark), _entries(spark, d), _as_of(), since=_SINCE).high_salience.select("seq", "line")


_LESS = f"case when s0 > 0 and not coalesce(pinned, false) then greatest(0.0, s0 - 0.05::double * least(1.0, ({_DAYS}) / 7.0)) else s0 end"


@query(f"""with {_FOLD},
n0 as (
  select nodes.* replace (case when g.id is not null then timestamp '{P.AS_OF}' else last_reinforced end as last_reinforced), coalesce(g.salience, nodes.salience) as s0 from nodes left join grown g on g.id = nodes.id
  union all select g.id, g.type, g.id, g.new, g.salience, '', timestamp '{P.AS_OF}', 'knowledge', 'x', 0, false, g.salience from grown g where added),
e0 as (
  select source_id, target_id from edges union all select distinct 'customer-' || (o_custkey % 200), trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') from orders),
n1 as (select *, {_LESS} as s1 from n0), n2 as (select * from n1 where not (s1 < 0.05 and {_DAYS} > 30 and not coalesce(pinned, false))),
e2 as (select * from e0 where source_id in (select id from n2) and target_id in (select id from n2)),
n3 as (select * from n2 where not (category in ('knowledge', 'nrem') and s1 < 0.5 and not coalesce(pinned, false) and id not in (select source_id from e2) and id not in (select target_id from e2)))
select (select count(*) from n3) as nodes_left, (select count(*) from e2) as edges_left, {R6.format('(select sum(s1) from n3)')} as salience_left""")
def full_cycle(spark, d):
    """Replay, then decay and pruning: what is left."""
    g = _g(spark, d)
    n, e = settle(g.nodes, g.edges)
    _, after, _ = consolidate.full_cycle(g.with_(nodes=n, edges=e), _entries(spark, d), _as_of(), since=_SINCE, extractions=_extractions(spark, d))
    n, e = settle(after.nodes.select("salience"), after.edges.select("source_id"))
    return n.agg(F.count("*").alias("nodes_left"), r6(F.sum("salience")).alias("salience_left")).crossJoin(e.agg(F.count("*").alias("edges_left"))).select("nodes_left", "edges_left", "salience_left")  # one row each


def _extractor(chunks: DataFrame) -> DataFrame:
    """Stands for a model: an entity a chunk; every tenth chunk fails, every tenth after it gives no JSON."""
    text = F.concat(F.lit('{"entities": [{"type": "decision", "name": "'), "agent", F.lit(" topic "), (F.col("chunk") % 5).cast("string"), F.lit('", "salience": 0.6}]}'))
    return chunks.select("agent", "chunk", F.when(F.col("chunk") % 10 == 7, F.lit(None)).when(F.col("chunk") % 10 == 8, F.lit("oops")).otherwise(text).alias("json"))


def _slept(spark, d):
    g = graph.Graph.empty(spark)
    return consolidate.sleep(g.with_(state=_state(spark, d)), P.log(spark, d), _extractor, _as_of(), P.LOG_AS_OF)


_PENDING = f"{_MARKS}, p as (select log.*, row_number() over (partition by log.agent order by ts, seq) as rn from log left join marks using (agent) where mark is null or ts > mark), c as (select agent, (rn - 1) // 8 as chunk, count(*) as n, max(ts) as last_ts from p group by 1, 2), b as (select *, chunk % 10 in (7, 8) as bad from c)"


@query(f"""with {_PENDING}, x as (select *, sum(bad::int) over (partition by agent order by chunk) as before from b),
done as (select agent, max(last_ts) as ts, sum(n) as n from x where before = 0 group by 1)
select coalesce(d.agent, m.agent) as agent, coalesce(ts, mark) as last_consolidated_ts, (case when m.agent is null then 0 else 5 end + coalesce(n, 0))::bigint as entries_processed from done d full join marks m on d.agent = m.agent""")
def sleep_state(spark, d):
    """All pending chunks extracted and ingested; watermarks go up to the first failed chunk of each agent."""
    return _slept(spark, d)[0].state.select("agent", "last_consolidated_ts", F.col("entries_processed").cast("long").alias("entries_processed"))


@query(f"with {_PENDING} select agent, count(*) as chunks, sum(bad::int)::bigint as failed, sum(n)::bigint as entries from b group by 1")
def sleep_report(spark, d):
    return _slept(spark, d)[1].select("agent", "chunks", "failed", "entries")


@query(f"""with {_PENDING}, m as (select trim(regexp_replace(lower(agent || ' topic ' || (chunk % 5)), '[^a-z0-9]+', '-', 'g'), '-') as id, agent, count(*) as n from b where not bad group by 1, 2)
select id, {R6.format('least(1.0, 0.6 + 0.1 * (n - 1))')} as salience, 'agent-' || agent as namespace, 1 as sensitivity from m""")
def sleep_nodes(spark, d):
    return _slept(spark, d)[0].nodes.select("id", r6("salience").alias("salience"), "namespace", "sensitivity")


@query(f"""with {_MARKS}, p as (select log.*, row_number() over (partition by log.agent order by ts, seq) as rn from log left join marks using (agent) where mark is null or ts > mark)
select agent, agent || '-' || ((rn - 1) // 5 + 1) as batch, count(*) as n, substr(min(ts), 1, 10) as first_date, substr(max(ts), 1, 10) as last_date from p group by 1, 2""")
def sleep_plan(spark, d):
    return consolidate.sleep_plan(P.log(spark, d), _state(spark, d)).select("agent", "batch", "n", "first_date", "last_date")


@query("select name || ' (' || type || ')' as entity from nodes where salience >= 0.3 order by salience desc, id limit 200")
def prompt_entities(spark, d):
    return consolidate.prompt_entities(P.nodes(spark, d)).select("entity")


@query("""with n as (select *, salience * 1.5 - 0.2 as s from nodes where id not like '%7')
select (select count(*) from edges where source_id not in (select id from n) or target_id not in (select id from n)) as orphan_edges_removed, (select count(*) from n where s < 0 or s > 1) as salience_clamped""")
def integrity(spark, d):
    g = _g(spark, d)
    out, counts = consolidate.integrity(g.with_(nodes=g.nodes.filter("id not like '%7'").withColumn("salience", F.col("salience") * 1.5 - 0.2)))
    return counts.select("orphan_edges_removed", "salience_clamped")


# ---- code


def _indexed(spark, d) -> graph.Graph:
    every = _parsed(spark, d)
    return code_index.index_code(graph.Graph.empty(spark), every, every.select("file_path").distinct(), _as_of(), namespace="shop")


@query("""with t as (select p_brand || '.cs' as f, 'Part' || p_partkey as n, p_size from part)
select 'code:' || f || ':class:Shop.' || n as id, 'Class' as type, n as name, 'class ' || n || case p_size % 3 when 0 then ' extends IThing' when 1 then ' extends Base' else '' end as description, 'shop' as namespace from t
union all select 'code:' || f || ':method:Shop.' || n || '.Run', 'Method', 'Run', 'method Run', 'shop' from t where n like '%5' union all select distinct 'code:' || f || ':file:' || f, 'File', f, 'Source file: ' || f, 'shop' from t""")
def index_code_nodes(spark, d):
    """Parsed code put into a graph: its nodes."""
    return _indexed(spark, d).nodes.select("id", "type", "name", "description", "namespace")


@query("""with t as (select p_brand || '.cs' as f, 'Shop.Part' || p_partkey as q, p_size from part)
select source_id, target_id, relationship, 1.0::double as weight, 'code-graph' as source_agent from (
  select f as source_id, q as target_id, 'defines' as relationship from t union select q, 'Shop', 'belongs_to' from t
  union select q, case p_size % 3 when 0 then 'IThing' else 'Base' end, case p_size % 3 when 0 then 'implements' else 'inherits' end from t where p_size % 3 < 2 union select q, q || '.Run', 'contains' from t where q like '%5')""")
def index_code_edges(spark, d):
    """And its edges, in the graph's own columns."""
    return _indexed(spark, d).edges.select("source_id", "target_id", "relationship", "weight", "source_agent")


_SOURCES = {
    "python": ("py", "import os\nclass P{k}(Base):\n    def run{k}(self):\n        pass\ndef top{k}():\n    pass\n", [("class", "P{k}"), ("method", "run{k}"), ("function", "top{k}")]),
    "go": ("go", 'package shop\n\ntype S{k} struct {\n}\n\nfunc (s *S{k}) Do{k}() {\n}\n\nfunc New{k}() *S{k} { return nil }\n', [("struct", "S{k}"), ("method", "Do{k}"), ("function", "New{k}")]),
    "typescript": ("ts", "export class T{k} extends Base {\n  run{k}(x: number): void {\n  }\n}\nexport interface I{k} {\n}\n", [("class", "T{k}"), ("method", "run{k}"), ("interface", "I{k}")]),
    "csharp": ("cs", "namespace Shop {\n  public class C{k} : Base {\n    public void Run{k}() {\n    }\n  }\n}\n", [("class", "C{k}"), ("method", "Run{k}")]),
    "json": ("json", '{"first{k}": 1,\n"second{k}": {}}', [("config", "first{k}"), ("config", "second{k}")]),
    "yaml": ("yml", "stages:\n- stage: Build{k}\n  jobs:\n  - job: One{k}\n", [("config", "stages"), ("stage", "Build{k}"), ("job", "One{k}")]),
    "dockerfile": ("dockerfile", "FROM node:{k} AS build{k}\nRUN x\n", [("stage", "build{k}")]),
}


def _parser_query(language: str):
    ending, text, found = _SOURCES[language]
    fill = lambda s: "'" + s.replace("'", "''").replace("{k}", "' || k || '").replace("\n", "' || chr(10) || '") + "'"
    rows = " union all ".join(f"select {fill('f{k}.' + ending)} as file_path, '{kind}' as entity_type, {fill(name)} as name from k" for kind, name in found)

    def run(spark, d):
        k = P.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"))
        parts = text.split("{k}")
        whole = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(p)] if i == 0 else [F.col("k"), F.lit(p)])])
        files = k.select(F.concat(F.lit("f"), "k", F.lit(f".{ending}")).alias("file_path"), F.lit(language).alias("language"), whole.alias("text"))
        return parse_entities(files).select("file_path", "entity_type", "name")

    run.__name__ = f"parse_{language}"
    run.__doc__ = f"A {language} file a part: its entities."
    return query(f"with k as (select p_partkey as k from part) {rows}")(run)


for _language in _SOURCES:
    _parser_query(_language)


# ---- counters, and the commands that add a node or list a log


@query("""select case l_returnflag when 'A' then 'depends_on' when 'R' then 'conflicts_with' else 'relates_to' end as relationship, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey < 20 group by 1""")
def attempts_by_relationship(spark, d):
    """A relation a line of an order, from its part to its supplier; some suppliers are no nodes, so theirs are skipped."""
    from graphloom.operators import aggregates, extraction

    line = P.read(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "depends_on").when(F.col("l_returnflag") == "R", "conflicts_with").otherwise("relates_to")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    x = line.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), named("part-", "l_partkey").alias("source_id"), named("supplier-", "l_suppkey").alias("target_id"), kind.alias("relationship"))
    known = P.read(spark, d, "supplier").filter("s_nationkey < 20").select(named("supplier-", "s_suppkey").alias("id"))
    n = P.nodes(spark, d).select("id")
    none = spark.createDataFrame([], "id string, seq long")
    edges, _ = extraction.fold_edges(n.filter("id not like 'supplier-%'").unionByName(known), P.edges(spark, d), none, x)
    return aggregates.attempts_by_relationship(edges).select("relationship", F.col("n").cast("long").alias("n"))


@query("select floor(max(s_acctbal) + 0.5) / 20000 as salience from supplier")
def max_salience(spark, d):
    """Of extractions, one a supplier, each entity with a salience of its own."""
    from graphloom.operators import aggregates, extraction

    s = P.read(spark, d, "supplier")
    json = F.concat(F.lit('{"entities": [{"name": "s'), F.col("s_suppkey").cast("string"), F.lit('", "salience": '), (F.floor(F.col("s_acctbal") + 0.5) / 20000).cast("decimal(12,6)").cast("string"), F.lit("}]}"))
    return aggregates.max_salience(extraction.parse_extractions(s.select(F.col("s_suppkey").alias("seq"), json.alias("json")))[0])


@query("""with p as (select trim(regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '-', 'g'), '-') as id, lower(p_brand) as a, lower(p_type) as b from part)
select id, array_to_string(list_sort([a, b]), ',') as tags from p""")
def add_named(spark, d):
    """Nodes from a name and a text of tags."""
    rows = P.read(spark, d, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lower("p_brand"), F.lit(", "), F.lower("p_type"), F.lit(",")).alias("tags"))
    return graph.tags_by_node(graph.add_named(graph.Graph.empty(spark), rows, _as_of()).tags).select(F.col("node_id").alias("id"), F.array_join("tags", ",").alias("tags"))


@query("select count(*) as n from log where heading != '' or content != ''")
def entry_count(spark, d):
    from graphloom.sources import logs

    blank = P.log(spark, d).select(F.lit("  ").alias("value"))
    return logs.entry_count(P.log(spark, d).select(F.col("full_text").alias("value")).unionByName(blank))


@query(f"with s as (select *, {_IMP} as imp, {_NOV} as nov from (select seq, content as full_text, case when regexp_matches(content, '(?i)\\b(" + "|".join(V.DECISION_WORDS) + ")\\b') then 'decision' else '' end as type from log)) select seq, floor(imp * 1000 + 0.5) / 1000 as importance, floor(nov * 1000 + 0.5) / 1000 as novelty, " + _COMB + " as combined from s")
def scored_sections(spark, d):
    """A Markdown log an entry, parsed and scored."""
    from graphloom.sources import logs

    files = P.log(spark, d).select(F.col("seq").cast("string").alias("path"), F.concat(F.lit("## 2024-01-01\n"), "content").alias("text"))
    return logs.scored_sections(files).select(F.col("path").cast("long").alias("seq"), "importance", "novelty", "combined")
