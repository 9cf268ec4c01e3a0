"""Queries over the projected tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import signals as S
from graphloom.functions import vocabulary as V
from graphloom.functions.occurrences import spread
from graphloom.functions.text import round_to, slug
from graphloom.operators import aggregates, code_index, extraction, graph, homeostasis, notes, replay, reports, search
from graphloom.plans import projection as P
from graphloom.sources.shared import settle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            SQL[f.__name__] = f"with {P.SQL.strip()}" + (", " + body[5:] if body.startswith("with ") else "\n" + body)
        return f

    return add


def r6(c) -> F.Column:
    return round_to(c if not isinstance(c, str) else F.col(c), 6)


R6 = "floor(({0}) * 1e6 + 0.5) / 1e6"


def _g(spark: SparkSession, d: str) -> graph.Graph:
    empty = graph.Graph.empty(spark)
    return empty.with_(nodes=P.nodes(spark, d), edges=P.edges(spark, d), tags=P.tags(spark, d), embeddings=P.embeddings(spark, d))


def _as_of():
    return F.to_timestamp(F.lit(P.AS_OF))


# ---- nodes


@query(f"select id, name, {R6.format('salience')} as salience from nodes where salience >= 0.4 and type = 'person' and coalesce(sensitivity, 0) <= 1 order by nodes.salience desc, id limit 50")
def find_nodes_top(spark, d):
    """Customers of some salience under a ceiling, the 50 most salient."""
    return graph.find_nodes(P.nodes(spark, d), type="person", min_salience=0.4, ceiling=1).select("id", "name", r6("salience").alias("salience"))


@query("select id, salience from (select id, floor(salience * 1e6 + 0.5) / 1e6 as salience from nodes where id in (select node_id from tags where tag = 'building'))")
def tag_filter(spark, d):
    return graph.find_nodes(P.nodes(spark, d), P.tags(spark, d), tag="building", limit=None).select("id", r6("salience").alias("salience"))


@query("select id, name from nodes where pinned")
def pinned_nodes(spark, d):
    return graph.find_nodes(P.nodes(spark, d), pinned=True, limit=None).select("id", "name")


@query("select n.id, n.name, n.type, list_sort(list(t.tag)) as tags from nodes n join tags t on n.id = t.node_id where n.id = 'part-7' group by 1, 2, 3")
def get_node(spark, d):
    return graph.get_node(_g(spark, d), "part-7").select("id", "name", "type", "tags")


@query("""select id, name, type, category, floor(salience * 1e6 + 0.5) / 1e6 as salience, pinned from (
  select trim(regexp_replace(lower(r_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') as id, r_name || '!' as name, 'concept' as type, 'knowledge' as category, 0.5 as salience, false as pinned from region)""")
def add_nodes(spark, d):
    g = graph.Graph.empty(spark)
    new = P.read(spark, d, "region").select(F.concat("r_name", F.lit("!")).alias("name"))
    return graph.add_nodes(g, new, _as_of())[0].nodes.select("id", "name", "type", "category", r6("salience").alias("salience"), "pinned")


@query("""select id, floor(case when id like 'nation-%' then 0.75 else salience end * 1e6 + 0.5) / 1e6 as salience, case when id like 'nation-%' then 'changed' else description end as description from nodes where type in ('concept', 'initiative')""")
def update_nodes(spark, d):
    g = _g(spark, d)
    changes = P.read(spark, d, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(0.75).alias("salience"), F.lit("changed").alias("description"))
    return graph.update_nodes(g, changes).nodes.filter("type in ('concept', 'initiative')").select("id", r6("salience").alias("salience"), "description")


@query("""with gone as (select id from nodes where type = 'tool' and salience < 0.3)
select 'nodes' as part, count(*) as n from nodes where id not in (select id from gone)
union all select 'edges', count(*) from edges where source_id not in (select id from gone) and target_id not in (select id from gone)
union all select 'tags', count(*) from tags where node_id not in (select id from gone)""")
def delete_nodes(spark, d):
    g = _g(spark, d)
    out = graph.delete_nodes(g, g.nodes.filter("type = 'tool' and salience < 0.3").select("id"))
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count(out.nodes, "nodes").unionByName(count(out.edges, "edges")).unionByName(count(out.tags, "tags"))


@query("select id, floor(least(1.0, salience + 0.1 * h.n) * 1e6 + 0.5) / 1e6 as salience from nodes join (select 'customer-' || o_custkey as cid, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) h on id = h.cid")
def reinforce_nodes(spark, d):
    hits = P.read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("id"))
    n = P.nodes(spark, d)
    return graph.reinforce_nodes(n, hits, _as_of()).join(hits, "id", "left_semi").select("id", r6("salience").alias("salience"))


@query("select id, 2 as sensitivity from nodes where type = 'person' and coalesce(sensitivity, 0) <= 2")
def classify_nodes(spark, d):
    """Customers set to level 2 without a reason: those above it are refused."""
    g = _g(spark, d)
    out, refused = graph.classify(g, g.nodes.filter("type = 'person'").select("id"), 2)
    return out.nodes.filter("type = 'person'").join(refused, "id", "left_anti").select("id", "sensitivity")


# ---- edges, tags, properties


@query("select 'out' as direction, source_id, target_id, relationship, floor(weight * 1e6 + 0.5) / 1e6 as weight from edges where source_id = 'nation-3' union all select 'in', source_id, target_id, relationship, floor(weight * 1e6 + 0.5) / 1e6 from edges where target_id = 'nation-3'")
def edges_both(spark, d):
    return graph.edges_of(P.edges(spark, d), "nation-3").select("direction", "source_id", "target_id", "relationship", r6("weight").alias("weight"))


@query("""with n as (select id, name from nodes where id not like '%7')
select source_id, target_id, coalesce(a.name, source_id) as source_name, coalesce(b.name, target_id) as target_name from edges left join n a on source_id = a.id left join n b on target_id = b.id""")
def edges_with_names(spark, d):
    n = P.nodes(spark, d).filter("id not like '%7'")
    return graph.edges_with_names(P.edges(spark, d), n).select("source_id", "target_id", "source_name", "target_name")


@query("select source_id, target_id, relationship, rank from (select *, row_number() over (partition by source_id order by weight desc, target_id, relationship) as rank from edges) where rank <= 3")
def top3_edges(spark, d):
    return graph.top_edges(P.edges(spark, d), 3).select("source_id", "target_id", "relationship", F.col("rank").cast("long").alias("rank"))


@query("""with e as (select *, source_id like '%9' as there from edges where relationship = 'depends_on')
select source_id, target_id, relationship from e where not there and source_id not like '%5'""")
def add_edges(spark, d):
    """Edges offered to a graph that has some of them, and lacks some ends."""
    g = _g(spark, d)
    e = g.edges.filter("relationship = 'depends_on'")
    base = g.with_(edges=graph.add_edges(graph.Graph.empty(spark).with_(nodes=g.nodes), e.filter("source_id like '%9'"), _as_of())[0].edges, nodes=g.nodes.filter("not (id like 'part-%5')"))
    return graph.add_edges(base, e, _as_of())[0].edges.join(base.edges, ["source_id", "target_id", "relationship"], "left_anti").select("source_id", "target_id", "relationship")


@query("select e.source_id, e.target_id, floor(least(1.0, e.weight + 0.1 * h.n) * 1e6 + 0.5) / 1e6 as weight from edges e join (select 'part-' || l_partkey as s, 'supplier-' || l_suppkey as t, count(*) as n from lineitem where l_returnflag = 'R' group by 1, 2) h on e.source_id = h.s and e.target_id = h.t where e.relationship = 'depends_on'")
def reinforce_edges(spark, d):
    hits = P.read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("target_id"), F.lit("depends_on").alias("relationship"))
    out = _reinforced(P.edges(spark, d), hits)
    return out.select("source_id", "target_id", r6("weight").alias("weight"))


def _reinforced(edges: DataFrame, hits: DataFrame) -> DataFrame:
    full = edges.withColumn("last_reinforced", F.to_timestamp(F.lit("2000-01-01 00:00:00")))
    return graph.reinforce_edges(full, hits, _as_of()).filter(F.col("last_reinforced") == _as_of())


@query("select node_id, array_to_string(list_sort(list(tag)), ',') as tags from tags group by 1")
def tags_of_nodes(spark, d):
    return graph.tags_by_node(P.tags(spark, d)).select("node_id", F.array_join("tags", ",").alias("tags"))


@query("select node_id, string_agg(key || '=' || value, ',' order by key) as properties from (select 'customer-' || o_custkey as node_id, o_orderstatus as key, arg_max(o_orderpriority, o_orderkey) as value from orders group by 1, 2) group by 1")
def properties_last_write(spark, d):
    rows = P.read(spark, d, "orders").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("node_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    out = graph.properties_by_node(graph.set_properties(graph.Graph.empty(spark), rows).properties)
    return out.select("node_id", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"))


@query("select id from nodes where pinned or type = 'tool'")
def pin_nodes(spark, d):
    g = _g(spark, d)
    return graph.pin(g, g.nodes.filter("type = 'tool'").select("id")).nodes.filter("pinned").select("id")


@query("select node_id, tag from tags union select 'supplier-' || s_suppkey, 'supply' from supplier")
def add_tags(spark, d):
    """Tags offered twice, of which none was there, beside all that were offered again."""
    g = _g(spark, d)
    new = P.read(spark, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("supply").alias("tag"))
    return graph.add_tags(g, new.unionByName(new).unionByName(g.tags)).tags


@query("""select node_id, len(embedding) as dims, floor(embedding[1]::double * 1e6 + 0.5) / 1e6 as first_value from node_embeddings where substr(node_id, 6)::bigint % 3 != 0
union all select node_id, 2, 0.25 from node_embeddings where substr(node_id, 6)::bigint % 3 = 0""")
def upsert_embeddings(spark, d):
    """Every third vector written twice; the second counts."""
    g = _g(spark, d)
    third = g.embeddings.filter("cast(substring(node_id, 6) as bigint) % 3 = 0").select("node_id")
    written = lambda seq, *v: third.select("node_id", F.array(*map(F.lit, v)).cast("array<float>").alias("embedding"), F.lit(seq).alias("seq"))
    out = graph.upsert_embeddings(g, written(2, 0.25, 0.5).unionByName(written(1, 1.0))).embeddings
    return out.select("node_id", F.size("embedding").cast("long").alias("dims"), r6(F.get("embedding", F.lit(0)).cast("double")).alias("first_value"))


# ---- aggregates


@query("select (select count(*) from nodes) as node_count, (select count(*) from edges) as edge_count, (select count(distinct tag) from tags) as tag_count, (select floor(avg(salience) * 1000 + 0.5) / 1000 from nodes) as avg_salience")
def graph_stats(spark, d):
    return aggregates.stats(P.nodes(spark, d), P.edges(spark, d), P.tags(spark, d))


@query("select coalesce(category, 'unknown') as category, type, count(*) as n from nodes group by 1, 2")
def type_counts(spark, d):
    return aggregates.type_counts(P.nodes(spark, d))


@query("select relationship, count(*) as n from edges group by 1")
def rel_counts(spark, d):
    return aggregates.relationship_counts(P.edges(spark, d))


@query("select coalesce(namespace, 'personal') as namespace, count(*) as n from nodes group by 1")
def namespace_counts(spark, d):
    return aggregates.namespace_counts(P.nodes(spark, d))


@query("select total, embedded, floor(100.0 * embedded / total * 10 + 0.5) / 10 as percent from (select (select count(*) from nodes) as total, (select count(*) from nodes where id in (select node_id from node_embeddings)) as embedded)")
def embedding_coverage(spark, d):
    return aggregates.embedding_coverage(P.nodes(spark, d), P.embeddings(spark, d))


@query("select type, substr(ts, 1, 10) as date, count(*) as n from log group by 1, 2")
def entry_types(spark, d):
    return aggregates.entries_by(P.log(spark, d).withColumn("date", F.substring("ts", 1, 10)), "type", "date")


# ---- homeostasis

_DAYS = f"(epoch_ms(timestamp '{P.AS_OF}') - epoch_ms(last_reinforced)) / 86400000.0"
_DECAY = f"case when salience > 0 and not coalesce(pinned, false) then greatest(0.0, salience - 0.05::double * least(1.0, ({_DAYS}) / 7.0)) else salience end"


@query(f"select id, {R6.format(_DECAY)} as salience from nodes")
def decay(spark, d):
    return homeostasis.decay(P.nodes(spark, d), _as_of()).select("id", r6("salience").alias("salience"))


@query(f"select id from nodes where not (salience < 0.05 and {_DAYS} > 30 and not coalesce(pinned, false))")
def prune(spark, d):
    return homeostasis.prune(_g(spark, d), _as_of()).nodes.select("id")


@query("""with n as (select id from nodes where not (type = 'person' and coalesce(try_cast(substr(id, 10) as bigint), 1) % 97 = 0))
select source_id, target_id, relationship from edges where source_id not in (select id from n) or target_id not in (select id from n)""")
def orphan_edges(spark, d):
    n = P.nodes(spark, d).filter("not (type = 'person' and coalesce(try_cast(substr(id, 10) as bigint), 1) % 97 = 0)")
    return homeostasis.orphan_edges(P.edges(spark, d), n).select("source_id", "target_id", "relationship")


@query("""with n as (select id, category, salience, pinned from nodes union all select 'lone-' || s_suppkey, case when s_nationkey < 5 then 'meta' else 'knowledge' end, (s_acctbal + 1000.0) / 11000.0, s_nationkey > 20 from supplier)
select id from n where category in ('knowledge', 'nrem') and salience < 0.5 and not coalesce(pinned, false) and id not in (select source_id from edges) and id not in (select target_id from edges)""")
def orphan_nodes(spark, d):
    """Of the graph and of a node a supplier that no edge names, some of them pinned or of another category."""
    n, s = P.nodes(spark, d).select("id", "category", "salience", "pinned"), P.read(spark, d, "supplier")
    lone = s.select(F.concat(F.lit("lone-"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_nationkey") < 5, "meta").otherwise("knowledge").alias("category"), ((F.col("s_acctbal") + 1000.0) / 11000.0).alias("salience"), (F.col("s_nationkey") > 20).alias("pinned"))
    return homeostasis.orphan_nodes(n.unionByName(lone), P.edges(spark, d)).select("id")


@query("select node_id from node_embeddings where node_id not in (select id from nodes where not (type = 'pattern' and salience < 0.3))")
def orphan_embeddings(spark, d):
    """Vectors of parts, of which the least salient are no nodes any more."""
    n = P.nodes(spark, d).filter("not (type = 'pattern' and salience < 0.3)")
    return homeostasis.orphan_embeddings(P.embeddings(spark, d), n).select("node_id")


@query(f"""with e0 as (select * from edges),
n1 as (select *, {_DECAY} as s1 from nodes), n2 as (select * from n1 where not (s1 < 0.05 and {_DAYS} > 30 and not coalesce(pinned, false))),
e2 as (select * from e0 where source_id in (select id from n2) and target_id in (select id from n2)),
n3 as (select * from n2 where not (category in ('knowledge', 'nrem') and s1 < 0.5 and not coalesce(pinned, false) and id not in (select source_id from e2) and id not in (select target_id from e2)))
select (select count(*) from n1 where s1 != salience) as decayed, (select count(*) from nodes) - (select count(*) from n3) as pruned,
  (select count(*) from n3) as nodes_left, (select count(*) from e2) as edges_left, {R6.format('(select sum(s1) from n3)')} as salience_left""")
def rem_cycle(spark, d):
    g = _g(spark, d)
    n, e = settle(g.nodes, g.edges)
    out, counts = homeostasis.rem_cycle(g.with_(nodes=n, edges=e), _as_of())
    n, e, counts = settle(out.nodes.select("id", "salience"), out.edges.select("source_id"), counts)
    rest = n.agg(F.count("*").alias("nodes_left"), r6(F.sum("salience")).alias("salience_left")).crossJoin(e.agg(F.count("*").alias("edges_left")))  # one row each
    return counts.crossJoin(rest).select("decayed", "pruned", "nodes_left", "edges_left", "salience_left")


@query("select id, floor(least(greatest(salience * 1.5 - 0.2, 0.0), 1.0) * 1e6 + 0.5) / 1e6 as salience, salience * 1.5 - 0.2 < 0 or salience * 1.5 - 0.2 > 1 as changed from nodes")
def clamp(spark, d):
    n = P.nodes(spark, d).withColumn("salience", F.col("salience") * 1.5 - 0.2)
    fixed, changed = graph.clamp_salience(n)
    return n.select("id", changed.alias("changed")).join(fixed.select("id", r6("salience").alias("salience")), "id")


# ---- salience and sensitivity


def _strongest_sql(col: str, weights: dict[str, float], default: float) -> str:
    return f"coalesce(greatest({', '.join(f'case when contains({col}, {chr(39)}{k}{chr(39)}) then {v}::double end' for k, v in weights.items())}), {default}::double)"


_IMP = f"greatest({_strongest_sql('lower(full_text)', V.IMPORTANCE, 0.3)}, case type when 'handover' then 0.7 when 'decision' then 0.6 else 0.0 end::double)"
_NOV = _strongest_sql("lower(full_text)", V.NOVELTY, 0.2)
_SCORED = f"scored as (select seq, agent, {_IMP} as imp, {_NOV} as nov from log)"
_COMB = "floor(least(1.0::double, imp * 0.7::double + nov * (1.0::double - 0.7::double)) * 1000 + 0.5) / 1000"


@query(f"with {_SCORED} select seq, floor(imp * 1000 + 0.5) / 1000 as importance, floor(nov * 1000 + 0.5) / 1000 as novelty, {_COMB} as combined from scored")
def salience_score(spark, d):
    s = S.salience(F.col("full_text"), F.col("type"))
    return P.log(spark, d).select("seq", s.alias("s")).select("seq", "s.importance", "s.novelty", "s.combined")


@query(f"with {_SCORED} select agent, count(*) as n from scored where {_COMB} >= 0.7 group by 1")
def high_salience(spark, d):
    return replay.high_salience(P.log(spark, d).withColumn("entry_type", F.col("type"))).groupBy("agent").agg(F.count("*").alias("n"))


_BODY = "lower(heading || ' ' || content)"
_LISTED = r"regexp_split_to_array(lower(tags), '[,\s]+')"


def _met_sql(level: int) -> str:
    words = V.SENSITIVE[level][0]
    return "(" + " or ".join(f"contains({_BODY}, '{w}') or list_contains({_LISTED}, '{w}')" for w in words) + ")"


@query(f"""with f as (select seq, case type when 'decision' then 1 when 'action' then 2 else 0 end as by_type,
  case when {_met_sql(3)} then 3 when {_met_sql(2)} then 2 when {_met_sql(1)} then 1 else 0 end as floor_ from log)
select seq, greatest(floor_, by_type) as level, case when floor_ >= by_type then case floor_ when 3 then '{V.SENSITIVE[3][1]}' when 2 then '{V.SENSITIVE[2][1]}' when 1 then '{V.SENSITIVE[1][1]}' else 'source:public' end
  when by_type = 2 then 'type:person' else 'type:decision/meeting' end as reason from f""")
def infer_sensitivity(spark, d):
    kind = F.when(F.col("type") == "action", "person").otherwise(F.col("type"))
    s = S.sensitivity(F.col("tags"), F.col("heading"), F.col("content"), kind)
    return P.log(spark, d).select("seq", s.alias("s")).select("seq", "s.level", "s.reason")


@query(rf"""select seq, case when starts_with(heading, 'Session Handover') then 'handover' when regexp_matches(heading || chr(10) || content, '(?i)\b({'|'.join(V.DECISION_WORDS)})\b') then 'decision'
  when regexp_matches(heading || chr(10) || content, '(?i)\b({'|'.join(V.ACTION_WORDS)})\b') then 'action' else 'observation' end as class from log""")
def classify_entry(spark, d):
    return P.log(spark, d).select("seq", S.entry_class(F.col("heading"), F.col("content")).alias("class"))


# ---- replay

_MARKS = "marks as (select agent, (list_sort(list(ts)))[(count(*) * 9 // 10)::int] as mark from log where agent != 'agent-4' group by 1)"


def _state(spark, d) -> DataFrame:
    """A watermark at nine tenths of each agent's entries; one agent has none."""
    rows = P.log(spark, d).filter("agent != 'agent-4'").groupBy("agent").agg(F.array_sort(F.collect_list("ts")).alias("all"), F.count("*").alias("n"))
    return rows.select("agent", F.element_at("all", F.floor(F.col("n") * 9 / 10).cast("int")).alias("last_consolidated_ts"), F.lit(None).cast("string").alias("last_run_ts"), F.lit(5).alias("entries_processed"))


@query(f"with {_MARKS} select log.seq, log.agent from log left join marks using (agent) where mark is null or ts > mark")
def watermark_pending(spark, d):
    return replay.pending(P.log(spark, d), _state(spark, d)).select("seq", "agent")


@query(f"""with {_MARKS}, p as (select log.*, row_number() over (partition by log.agent order by ts, seq) as rn from log left join marks using (agent) where mark is null or ts > mark)
select agent, (rn - 1) // 8 as chunk, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, string_agg(full_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rn) as text from p group by 1, 2""")
def sleep_chunks(spark, d):
    return replay.chunks(replay.pending(P.log(spark, d), _state(spark, d))).select("agent", F.col("chunk").cast("long").alias("chunk"), "n", "first_ts", "last_ts", "text")


@query("select seq, ts, type from log where agent = 'agent-1' and ts > '2024-01-05' order by seq desc limit 15")
def recent_logs(spark, d):
    from graphloom.sources.logs import select_entries

    return select_entries(P.log(spark, d), agent="agent-1", after="2024-01-05", last=15).select("seq", "ts", "type")


@query(f"with {_MARKS} select agent, max(ts) as last_consolidated_ts, count(*) + case when agent = 'agent-4' then 0 else 5 end as entries_processed from log left join marks using (agent) where mark is null or ts > mark group by 1")
def watermark_upsert(spark, d):
    state = _state(spark, d)
    done = replay.pending(P.log(spark, d), state).groupBy("agent").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    return replay.advance(state, done, P.LOG_AS_OF).select("agent", "last_consolidated_ts", F.col("entries_processed").cast("long").alias("entries_processed"))


@query(f"""with c as (select agent, chunk, max(ts) as last_ts, count(*) as n from (select *, (row_number() over (partition by agent order by ts, seq) - 1) // 8 as chunk from log) group by 1, 2),
b as (select *, sum(case when chunk % 10 = 7 then 1 else 0 end) over (partition by agent order by chunk) as bad from c)
select agent, max(last_ts) as ts, sum(n)::bigint as n from b where bad = 0 group by 1""")
def finished_prefix(spark, d):
    c = replay.chunks(P.log(spark, d)).withColumn("ok", F.col("chunk") % 10 != 7)
    return replay.finished_prefix(c).select("agent", "ts", F.col("n").cast("long").alias("n"))


@query("select path, line_no as seq, date, content, entry_type from (select 'log-' || (seq // 50) as path, 3 + (seq % 50) * 4 as line_no, '2024-01-' || lpad((1 + seq % 28)::varchar, 2, '0') as date, content, case when regexp_matches(content, '(?i)\\b(" + "|".join(V.DECISION_WORDS) + ")\\b') then 'decision' when regexp_matches(content, '(?i)\\b(" + "|".join(V.ACTION_WORDS) + ")\\b') then 'action' else 'observation' end as entry_type from log)")
def parse_md_log(spark, d):
    """The log written as Markdown, 50 entries to a file, and parsed again."""
    from graphloom.sources.logs import parse_markdown

    day = F.lpad((1 + F.col("seq") % 28).cast("string"), 2, "0")
    part = F.concat(F.lit("## 2024-01-"), day, F.lit("\n### Note\n"), F.col("content"), F.lit("\n---\n"))
    files = P.log(spark, d).groupBy(F.concat(F.lit("log-"), F.floor(F.col("seq") / 50).cast("string")).alias("path")).agg(F.concat(F.lit("# Log\n_Append-only_\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"]), "")).alias("text"))
    out = parse_markdown(files)
    return out.select("path", F.col("seq").cast("long").alias("seq"), "date", "content", "entry_type")


# ---- extraction


def _extractions(spark, d) -> DataFrame:
    """An extraction an order: its customer and priority as entities, and an edge between them, as JSON."""
    o = spread(P.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"])  # JSON is the work of many tasks, though a file of orders is small
    name = F.concat(F.lit("Customer "), (F.col("o_custkey") % 200).cast("string"))
    body = F.struct(
        F.array(F.struct(F.lit("").alias("id"), F.lit("person").alias("type"), name.alias("name"), F.repeat(F.lit("d"), (F.col("o_orderkey") % 9).cast("int")).alias("description"), F.lit(0.4).alias("salience")),
                F.struct(F.col("o_orderpriority").alias("id"), F.lit("oddity").alias("type"), F.col("o_orderpriority").alias("name"), F.lit("p").alias("description"), F.lit(0.6).alias("salience"))).alias("entities"),
        F.array(F.struct(name.alias("source"), F.col("o_orderpriority").alias("target"), F.lit("depends_on").alias("relationship"))).alias("relationships"))
    return o.select(F.col("o_orderkey").alias("seq"), F.to_json(body).alias("json"))


_MENTIONS = """m as (
  select o_orderkey as seq, 0 as pos, 'customer-' || (o_custkey % 200) as id, 'person' as type, 'Customer ' || (o_custkey % 200) as name, repeat('d', (o_orderkey % 9)::int) as description, 0.4::double as salience from orders
  union all select o_orderkey, 1, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-'), 'concept', o_orderpriority, 'p', 0.6 from orders)"""


@query(f"with {_MENTIONS} select seq, pos, id, type, name, floor(salience * 1e6 + 0.5) / 1e6 as salience from m")
def llm_parse(spark, d):
    e, _, _ = extraction.parse_extractions(_extractions(spark, d))
    return e.select("seq", "pos", "id", "type", "name", r6("salience").alias("salience"))


@query(f"""with {_MENTIONS}, f as (select id, count(*) as n, arg_min(salience, seq) as first, arg_max(description, length(description) * 1000000000 - seq) as new from m group by 1)
select f.id, f.n as mentions, nodes.id is null as added, floor(case when nodes.id is not null then least(1.0, nodes.salience + 0.1 * n) when n = 1 then first else least(1.0, first + 0.1 * (n - 1)) end * 1e6 + 0.5) / 1e6 as salience,
  case when nodes.id is not null and length(new) <= length(nodes.description) then nodes.description else new end as description from f left join nodes on nodes.id = f.id""")
def load_extractions(spark, d):
    e, _, _ = extraction.parse_extractions(_extractions(spark, d))
    return extraction.fold_nodes(P.nodes(spark, d), e).select("id", "mentions", "added", r6("salience").alias("salience"), "description")


@query(f"""with {_MENTIONS}, r as (select a.seq, a.id as source_id, b.id as target_id from m a join m b on a.seq = b.seq and a.pos = 0 and b.pos = 1)
select source_id, target_id, 'depends_on' as relationship, count(*) as attempts, floor(case when count(*) = 1 then 1.0 else least(1.0, 1.0 + 0.1 * (count(*) - 1)) end * 1e6 + 0.5) / 1e6 as weight from r group by 1, 2""")
def edge_fold(spark, d):
    e, x, _ = extraction.parse_extractions(_extractions(spark, d))
    edges, _ = extraction.fold_edges(P.nodes(spark, d), P.edges(spark, d), e, x)
    return edges.select("source_id", "target_id", "relationship", "attempts", r6("weight").alias("weight"))


# ---- search


@query("select id, floor(salience * 1e6 + 0.5) / 1e6 as salience from nodes where (name ilike '%brand#1%' or description ilike '%brand#1%') and coalesce(sensitivity, 0) <= 1 order by nodes.salience desc, id limit 20")
def keyword_like(spark, d):
    return search.keyword_like(P.nodes(spark, d), "brand#1", 1, 20).select("id", r6("salience").alias("salience"))


_WORDS = "w as (select id, sensitivity, list_filter(regexp_split_to_array(lower(name || ' ' || description), '[^a-z0-9]+'), lambda x: x != '') as w from nodes)"


_DIST = "sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - q[i]::double) * (embedding[i]::double - q[i]::double))))"


def _bm25_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"sum((tf{i} > 0)::int) as df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(words)))
    hit = " and ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"with {_WORDS}, c as (select id, sensitivity, len(w) as len, {tf} from w), t as (select count(*) as docs, avg(len) as mean, {df} from c), s as (select id, {score} as rank from c, t where {hit} and coalesce(sensitivity, 0) <= 1)"


_FIRST = ["12", "brand"]


@query(_bm25_sql(_FIRST) + " select id, floor(rank / (1 + rank) * 1e6 + 0.5) / 1e6 as score from s")
def bm25_all(spark, d):
    """Every node with both words, with its score."""
    r = search.bm25(P.nodes(spark, d), "brand 12", 1)
    return r.select("id", r6(F.col("rank") / (1 + F.col("rank"))).alias("score"))


@query(_bm25_sql(["ring", "small"]) + """ select id, floor(score * 1e6 + 0.5) / 1e6 as score from (select id, rank / (1 + rank) as score from s order by rank desc, id limit 10)""")
def keyword_hits(spark, d):
    """Both words, by an index that is stored by term."""
    n = P.nodes(spark, d)
    index = settle(search.inverted_index(n).repartitionByRange("term").sortWithinPartitions("term"), search.index_totals(n))
    return search.query_by_keyword(n, "small ring", 1, 10, tuple(index)).select("id", r6("score").alias("score"))


@query("""select id, floor(salience * 1e6 + 0.5) / 1e6 as score from nodes where name ilike '%#0000000%' and coalesce(sensitivity, 0) <= 1 order by nodes.salience desc, id limit 10""")
def keyword_pieces(spark, d):
    """No words alone, so looked up as a piece of text."""
    return search.query_by_keyword(P.nodes(spark, d), "#0000000", 1, 10).select("id", r6("score").alias("score"))


@query(_bm25_sql(["ring"]) + f""", q as (select embedding as q from embeddings where vec_id = 1), kw as (select id, rank / (1 + rank) as score from s order by rank desc, id limit 10),
vec as (select node_id as id, 1 / (1 + {_DIST}) as score from node_embeddings, q where node_id in (select id from nodes where coalesce(sensitivity, 0) <= 1) order by {_DIST}, node_id limit 10)
select id, floor(max(score) * 1e6 + 0.5) / 1e6 as score from (select * from kw union all select * from vec where (select count(*) from kw) < 10) group by id order by max(score) desc, id limit 10""")
def hybrid_words(spark, d):
    """As many keyword hits as asked for: no vector counts."""
    return search.hybrid(P.nodes(spark, d), P.embeddings(spark, d), "ring", _vector(spark, d), 10).select("id", r6("score").alias("score"))


@query(_bm25_sql(["12", "brand", "hot"]) + f""", q as (select embedding as q from embeddings where vec_id = 1), kw as (select id, rank / (1 + rank) as score from s order by rank desc, id limit 10),
vec as (select node_id as id, 1 / (1 + {_DIST}) as score from node_embeddings, q where node_id in (select id from nodes where coalesce(sensitivity, 0) <= 1) order by {_DIST}, node_id limit 10)
select id, floor(max(score) * 1e6 + 0.5) / 1e6 as score from (select * from kw union all select * from vec where (select count(*) from kw) < 10) group by id order by max(score) desc, id limit 10""")
def hybrid_both(spark, d):
    """Few keyword hits or none: vectors fill up."""
    return search.hybrid(P.nodes(spark, d), P.embeddings(spark, d), "brand 12 hot", _vector(spark, d), 10).select("id", r6("score").alias("score"))


@query(_bm25_sql(_FIRST) + " select id, floor(rank / (1 + rank) * 1e6 + 0.5) / 1e6 as score from s order by floor(rank * 1e9) desc, id limit 10")
def bm25_top(spark, d):
    """The ten most relevant."""
    r = search.bm25(P.nodes(spark, d), "brand 12", 1)
    return r.orderBy(F.desc(F.floor(F.col("rank") * 1e9)), "id").limit(10).select("id", r6(F.col("rank") / (1 + F.col("rank"))).alias("score"))


def _vector(spark, d) -> list[float]:
    return P.read(spark, d, "embeddings").filter("vec_id = 1").first()["embedding"]


@query(f"with q as (select embedding as q from embeddings where vec_id = 1) select node_id as id, {R6.format(_DIST)} as distance from node_embeddings, q where node_id in (select id from nodes where category = 'nrem') order by {_DIST}, node_id limit 20")
def semantic_topk(spark, d):
    out = search.semantic_search(P.nodes(spark, d), P.embeddings(spark, d), _vector(spark, d), 20, category="nrem")
    return out.select("id", r6("distance").alias("distance"))


@query(f"""with q as (select embedding as q from embeddings where vec_id = 1),
v as (select node_id as id, 1 / (1 + {_DIST}) as score from node_embeddings, q where node_id in (select id from nodes) order by {_DIST}, node_id limit 10),
k as (select id, salience as score from nodes where name ilike '%-1%' order by salience desc, id limit 5)
select id, floor(max(score) * 1e6 + 0.5) / 1e6 as score from (select * from v union all select * from k) group by id order by max(score) desc, id limit 10""")
def hybrid(spark, d):
    n = P.nodes(spark, d)
    words = n.filter(F.col("name").ilike("%-1%")).orderBy(F.desc("salience"), "id").limit(5).select("id", F.col("salience").alias("score"))
    near = search.semantic_search(n, P.embeddings(spark, d), _vector(spark, d), 10)
    return search.merge_hits(words, near, 10).select("id", r6("score").alias("score"))


@query("select id, name from nodes where contains(lower(name), '#0000000') and coalesce(sensitivity, 0) <= 1 order by salience desc, id limit 10")
def show_nodes(spark, d):
    return search.show(P.nodes(spark, d), "#0000000", 1).select("id", "name")


@query("select p_partkey as key, substr(trim(regexp_replace(lower(p_name || ' -- ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) as slug from part")
def slugs(spark, d):
    return P.read(spark, d, "part").select(F.col("p_partkey").alias("key"), slug(F.concat("p_name", F.lit(" -- "), "p_type")).alias("slug"))


# ---- code


def _parsed(spark, d) -> DataFrame:
    """Parts as classes in a file a brand, suppliers as their members."""
    p = P.read(spark, d, "part").select(F.concat("p_brand", F.lit(".cs")).alias("file_path"), F.col("p_partkey").alias("k"), "p_type", "p_size")
    n = F.concat(F.lit("Part"), F.col("k").cast("string"))
    empty = F.array().cast("array<string>")
    base = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("IThing"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("Base"))).otherwise(empty)
    top = p.select("file_path", F.lit("csharp").alias("language"), F.lit("Shop").alias("namespace"), F.lit("class").alias("entity_type"), n.alias("name"), F.concat(F.lit("Shop."), n).alias("fqn"), F.lit(None).cast("string").alias("parent_fqn"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), empty.alias("modifiers"), base.alias("base_types"))
    sub = top.filter("fqn like '%5'").select("file_path", "language", "namespace", F.lit("method").alias("entity_type"), F.lit("Run").alias("name"), F.concat("fqn", F.lit(".Run")).alias("fqn"), F.col("fqn").alias("parent_fqn"), "line_start", "line_end", "modifiers", empty.alias("base_types"))
    return top.unionByName(sub)


@query("""with t as (select p_brand || '.cs' as f, 'Shop.Part' || p_partkey as q, p_size from part)
select f as source, q as target, 'defines' as relationship, f as file_path from t union select q, 'Shop', 'belongs_to', f from t
union select q, case p_size % 3 when 0 then 'IThing' else 'Base' end, case p_size % 3 when 0 then 'implements' else 'inherits' end, f from t where p_size % 3 < 2 union select q, q || '.Run', 'contains', f from t where q like '%5'""")
def structural_edges(spark, d):
    return code_index.structural_edges(_parsed(spark, d))


@query("""with t as (select p_brand || '.cs' as f, 'Shop.Part' || p_partkey as q from part)
select 'code:' || f || ':class:' || q as id from t where f like '%1.cs' union select 'code:' || f || ':method:' || q || '.Run' from t where f like '%1.cs' and q like '%5' union select 'code:' || f || ':file:' || f from t where f like '%1.cs'""")
def stale_code(spark, d):
    n = code_index.code_nodes(_parsed(spark, d))
    return code_index.stale_nodes(n, n.filter("file_path not like '%1.cs'").select("file_path").distinct()).select("id")


@query("""with t as (select p_brand || '.cs' as f, 'Shop.Part' || p_partkey as q from part),
old as (select f, 'code:' || f || ':class:' || q as id from t union select f, 'code:' || f || ':method:' || q || '.Run' from t where q like '%5' union select f, 'code:' || f || ':file:' || f from t),
new as (select f, 'code:' || f || ':class:' || q as id from t where f like '%1.cs' and q like '%3')
select id from old where f not like '%2.cs' and f not in (select f from new) union all select id from new union all select distinct 'code:' || f || ':file:' || f from new""")
def reindex_code(spark, d):
    """Some files parsed anew with fewer classes, some no longer walked; the others stay."""
    every = _parsed(spark, d)
    new = code_index.code_nodes(every.filter("file_path like '%1.cs' and entity_type = 'class' and fqn like '%3'"))
    g = graph.Graph.empty(spark)
    out = code_index.reindex(g.with_(nodes=code_index.code_nodes(every)), new, g.edges, every.filter("file_path not like '%2.cs'").select("file_path").distinct())
    return out.nodes.select("id")


_CALLS = "c_name || case when k % 2 = 0 then ' calls my' else repeat('.', 400) end || 'RunTheBigMethod' || k || 'x' || case when k % 3 = 0 then repeat('-', 500) || 'of' || c_name || ' RunTheBigMethodic' else '' end"


@query(f"""with c as (select c_custkey, c_name, c_custkey % 50 as k from customer), t as (select c_custkey as doc_id, 'customer-' || c_custkey as entity_id, c_name, {_CALLS} as content from c),
names as (select 'RunTheBigMethod' || k as name, 'code:Method' || k as code_id from (select distinct k from c) union all select 'RunTheBigMethodic', 'code:ic'),
met as (select doc_id, entity_id, code_id, list_filter(range(1, length(content) + 1), lambda i: substr(content, i, length(c_name)) = c_name) as a, list_filter(range(1, length(content) + 1), lambda i: substr(content, i, length(name)) = name) as b from t join names on instr(content, name) > 0)
select distinct entity_id, code_id, doc_id from (select *, unnest(a) as x from met), (select doc_id as d, code_id as cid, unnest(b) as y from met) where doc_id = d and code_id = cid and abs(x - y) <= 300""")
def code_references(spark, d):
    """A text a customer, with code names near or far from the customer's, inside words, inside each other, and twice."""
    c = P.read(spark, d, "customer").withColumn("k", F.col("c_custkey") % 50)
    texts = c.select(F.col("c_custkey").alias("doc_id"), F.expr(_CALLS).alias("content"))
    ents = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    called = c.select(F.col("k").cast("string").alias("k")).distinct().unionByName(spark.createDataFrame([("ic",)], "k string"))
    nodes = called.select(F.concat(F.when(F.col("k") == "ic", "code:").otherwise("code:Method"), "k").alias("id"), F.concat(F.lit("RunTheBigMethod"), "k").alias("name"), F.lit("Method").alias("type"), F.lit("code").alias("category"))
    return extraction.code_references(texts, ents, extraction.code_index(nodes))


# ---- notes and reports


@query("select o_orderkey as k, floor(least(0.9, greatest(0.5, 0.7 - greatest(0, date_diff('day', o_orderdate::date, date '1999-01-01')) / 7.0 * 0.01) + case when o_orderstatus = 'F' then 0.05 else 0 end) * 1e6 + 0.5) / 1e6 as salience from orders")
def heartbeat_salience(spark, d):
    o = P.read(spark, d, "orders")
    s = notes.learned_salience(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderstatus") == "F", "yes"), F.to_date(F.lit("1999-01-01")))
    return o.select(F.col("o_orderkey").alias("k"), r6(s).alias("salience"))


@query("""select 'fix-order-' || o_orderkey as id, 'Fix order ' || o_orderkey as name, 'rule' as type, 0.9::double as salience from orders
union all select 'order-' || o_orderkey || '-was-late', 'Order ' || o_orderkey || ' was late', 'concept', floor((least(0.9, greatest(0.5, 0.7 - greatest(0, date_diff('day', o_orderdate::date, date '1999-01-01')) / 7.0 * 0.01) + 0.05)) * 1e6 + 0.5) / 1e6 from orders
union all select 'undated-order-' || o_orderkey, 'Undated order ' || o_orderkey, 'concept', 0.7 from orders""")
def memory_import(spark, d):
    """A memory file an order: a corrected bullet, one of another section, a learned one reinforced later, and one without a date."""
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(
        F.lit("# Memory\n## Corrected\n- Fix order "), key, F.lit(" - *corrected: "), day, F.lit("*\n## Elsewhere\n- Passed over\n## Learned\n- Order "), key,
        F.lit(" was late - *learned: "), day, F.lit(", reinforced: 1998-12-01*\n- Undated order "), key)
    entries = notes.parse_memory(P.read(spark, d, "orders").select(key.alias("path"), text.alias("text")), F.lit("1999-01-01"))
    out = notes.memory_nodes(entries, P.nodes(spark, d), F.to_date(F.lit("1999-01-01")))
    return out.select("id", "name", "type", r6("salience").alias("salience"))


@query("""select trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g'), '-') as id, 'domain' as type, 0.8::double as salience from region
union all select trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-'), 'initiative', 0.8 from nation union all select trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 'person', 0.7 from customer""")
def vault_nodes(spark, d):
    """Folders and files of a vault: a domain a region, an initiative a nation, a person a customer."""
    at = lambda table, folder, c, rest: P.read(spark, d, table).select(F.concat(F.lit(f"vault/{folder}/"), F.col(c), F.lit(rest)).alias("path"))
    files = at("region", "domains", "r_name", "/notes.md").unionByName(at("nation", "initiatives", "n_name", ".md")).unionByName(at("customer", "people", "c_name", "/log.md"))
    return notes.vault_nodes(files).select("id", "type", "salience")


@query("""with k as (select c_custkey as k, 'customer-' || c_custkey as parent from customer)
select 'anna-roe' as source_id, parent as target_id, 'mentioned_in' as relationship, 0.7::double as weight from k union all select 'annabel-takes-plan-' || k, parent, 'belongs_to', 0.8 from k
union all select 'annabel-takes-plan-' || k, 'anna-roe', 'authored_by', 0.6 from k union all select 'anna-roe', parent, 'belongs_to', 0.7 from k union all select 'boris-novak', parent, 'belongs_to', 0.8 from k""")
def vault_edges(spark, d):
    """Notes, a decision, open and done actions in a file a customer, a first name of two people, alone and inside words."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("## 2024-01-02 Sync\n### Notes\n- Talked with Anna Keller\n- Savanna, Joanna, Hannah and Annalena\n### Decisions\n- Annabel takes plan "), key, F.lit("\n- short\n### Next steps\n- Anna: call back\n- ✅ Boris: sent the draft\n- Anna Keller: not a first name\n- Boris + Nobody: again"))
    c = P.read(spark, d, "customer")
    people = spark.createDataFrame([("anna-keller", "Anna Keller"), ("anna-roe", "Anna Roe"), ("boris-novak", "Boris Novak")], "id string, name string")
    sections = notes.parse_sections(c.select(key.alias("path"), text.alias("text")))
    out = notes.vault_edges(sections, c.select(key.alias("path"), F.concat(F.lit("customer-"), key).alias("parent_id")), people)
    return out.select("source_id", "target_id", "relationship", r6("weight").alias("weight"))


@query("""with fixed as (select id, 'Pinned' as section, salience from nodes where pinned order by salience desc, id limit 100),
own as (select id, type as section, salience from nodes where salience >= 0.3 and source_agent = 'building' and coalesce(sensitivity, 0) <= 1 order by salience desc, id limit 150),
tagged as (select id, type as section, salience from nodes where salience >= 0.3 and id in (select node_id from tags where tag = 'building') and coalesce(sensitivity, 0) <= 1 order by salience desc, id limit 150),
every as (select * from fixed union all select * from (select * from own union select * from tagged) where id not in (select id from fixed))
select id, section, floor(salience * 1e6 + 0.5) / 1e6 as salience from every order by case section when 'Pinned' then 0 else 1 end, every.salience desc, id limit 150""")
def boot_rows(spark, d):
    return reports.boot_nodes(P.nodes(spark, d), P.tags(spark, d), "building", limit=150).select("id", "section", r6("salience").alias("salience"))


@query("""select id, name, case type when 'pattern' then 'patterns' else 'knowledge' end as "group", contains('we know customer#000000001 and others', lower(name)) as present from (
  select * from nodes where salience >= 0.6 and source_agent = 'building' order by salience desc, id limit 50)""")
def persona_diff(spark, d):
    return reports.persona_diff(P.nodes(spark, d), P.tags(spark, d).filter("tag = 'nothing'"), "building", "We know Customer#000000001 and others").select("id", "name", "group", "present")


@query("""select 'nodes' as "check", count(*)::double as value, 'ok' as status from nodes union all select 'edges', count(*), 'ok' from edges
union all select 'embedded_nodes', count(*), 'ok' from nodes where id in (select node_id from node_embeddings)
union all select 'embedding_percent', p, case when p < 50 then 'low' else 'ok' end from (select floor(1000.0 * (select count(*) from nodes where id in (select node_id from node_embeddings)) / count(*) + 0.5) / 10 as p from nodes)
union all select 'dangling_targets', count(*), case when count(*) > 0 then 'warning' else 'ok' end from edges where target_id not in (select id from nodes) union all select 'agents_with_log', count(distinct agent), 'ok' from log""")
def doctor(spark, d):
    return reports.doctor(P.nodes(spark, d), P.edges(spark, d), P.embeddings(spark, d), P.log(spark, d))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, floor(sum(value) * 1e4 + 0.5) / 1e4 as total from events group by 1, 2")
def windowed_events(spark, d):
    """An extension: event-time windows, which run the same on a stream."""
    from graphloom.streaming.replay import windowed_counts

    return windowed_counts(P.read(spark, d, "events")).select("start", "event_type", "n", round_to(F.col("total"), 4).alias("total"))
