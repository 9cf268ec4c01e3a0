"""A vault of notes out of the tables, put into a graph, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import vault
from graphloom.operators.graph import Graph, complete
from graphloom.plans import projection as P
from graphloom.plans.catalogue import query, r6

_FIRST = ["Ann", "Bo", "Cy", "Dora", "Eva"]
#: Files by table: path and text of a row, as both engines read them.
_FOLDER = f"lower(element_at(array({', '.join(repr(x) for x in _FIRST)}), cast(s_suppkey % 5 + 1 as int))) || '-s' || s_suppkey"
_LONG = "Eva and Dora agree on" + " long words" * 8
_FILES = [
    ("customer", "'domains/area-' || c_nationkey || '/' || c_custkey || '.md'", "'top\n## 2024-01-02 Sync\nWork depends on area\n### Notes\n- Talked with Annabel\n- Cyclamen\n### Decisions\n- Bo takes plan ' || (c_custkey % 10) || '\n- short\n### Next steps\n- Cy: call\n- Dora S3: no\n### Other\n- replaces all\n'"),
    ("supplier", "'initiatives/plan-' || (s_nationkey % 5) || '/' || s_suppkey || '.md'", f"'## Work\n### Decisions\n- {_LONG} \n'"),
    ("nation", "'domains/area-' || n_nationkey || '/next-actions.md'", "'## Open\n- Ann: call\n- Bo: write\n## Done\n- Ann: old\n- Cy: gone'"),
    ("supplier", f"'domains/people/' || {_FOLDER} || '/log.md'", "'Met Dora at Area ' || s_nationkey || ' about plan-2'"),
    ("supplier", f"'domains/people/' || {_FOLDER} || '/next-actions.md'", "'## Open\n- a\n- b\n## Done\n- c'"),
    ("region", "'expertise/topic-' || r_regionkey || '/n.md'", "'Ann and Cy know'"),
    ("region", "'expertise/' || r_regionkey || '.md'", "'alone'"),
    ("region", "'elsewhere/' || r_regionkey || '.md'", "'passed over by Ann'"),
]


def _vault(spark, d) -> tuple[Graph, DataFrame]:
    files = None
    for table, path, text in _FILES:
        rows = P.read(spark, d, table).select(F.expr(path).alias("path"), F.expr(text.replace("\n", "\\n")).alias("text"))
        files = rows if files is None else files.unionByName(rows)
    now = F.to_timestamp(F.lit(P.AS_OF))
    there = complete(spark.createDataFrame([("ann", "Ann", "x", 0.4), ("dora-s3", "Dora", "x", 0.2)], "id string, name string, description string, salience double"), now)
    g = Graph.empty(spark)
    edge = spark.createDataFrame([("dora-s3", "domain-area-3", "belongs_to", 0.3)], "source_id string, target_id string, relationship string, weight double")
    return vault.vault_graph(g.with_(nodes=there, edges=g.edges.unionByName(edge, allowMissingColumns=True)), files, now)


_PEOPLE = f"""p0 as (select *, ({P._array(_FIRST)})[(s_suppkey % 5 + 1)::int] as first from supplier), p1 as (select *, lower(first) || '-s' || s_suppkey as folder from p0),
people as (select s_suppkey, s_nationkey, first, first || ' S' || s_suppkey as title, case when folder = 'dora-s3' then folder else 'person-' || folder end as id from p1),
lasts as (select first, max(id) as id from people group by 1),
plans as (select distinct 'initiative-plan-' || (s_nationkey % 5) as id, s_nationkey % 5 as k from supplier)"""
_LONG_ID = "substr(trim(regexp_replace(lower(substr('" + _LONG + "', 1, 60)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)"


@query(f"""with {_PEOPLE}, n as (
  select id, title as name, 'person' as type, 'Person tracked in vault' as description, 0.8::double as salience from people where id != 'dora-s3'
  union all select id, 'Dora', 'concept', 'Person tracked in vault', 0.4 from people where id = 'dora-s3' union all select 'dora-s3', 'Dora', 'concept', 'x', 0.2 where not exists (select 1 from people where id = 'dora-s3')
  union all select 'ann', 'Ann', 'concept', 'x', 0.4
  union all select 'domain-area-' || n_nationkey, 'Area ' || n_nationkey, 'concept', 'Domain: Area ' || n_nationkey, 0.8 from nation union all select id, 'Plan ' || k, 'initiative', 'Initiative: Plan ' || k, 0.8 from plans
  union all select 'bo-takes-plan-' || (c_custkey % 10), 'Bo takes plan ' || (c_custkey % 10), 'decision', 'Bo takes plan ' || (c_custkey % 10), least(1.0, 0.7 + 0.1 * (count(*) - 1)) from customer group by c_custkey % 10
  union all select {_LONG_ID}, '{_LONG[:77]}...', 'decision', '{_LONG}', least(1.0, 0.7 + 0.1 * (count(*) - 1)) from supplier having count(*) > 0
  union all select 'expertise-topic-' || r_regionkey, 'Topic ' || r_regionkey, 'concept', 'Expertise area: Topic ' || r_regionkey, 0.6 from region)
select id, name, type, description, floor(salience * 1e6 + 0.5) / 1e6 as salience from n""")
def vault_graph_nodes(spark, d):
    """A vault put into a graph that knows one of its people and one first name: people, domains, initiatives, decisions and areas."""
    return _vault(spark, d)[0].nodes.select("id", "name", "type", "description", r6("salience").alias("salience"))


_EVENTS = f"""ev as (
  select l.id as s, 'domain-area-' || c_nationkey as t, 'mentioned_in' as r, 0.6::double as w, 0 as o from customer, lasts l where l.first in ('Ann', 'Cy')
  union all select 'bo-takes-plan-' || (c_custkey % 10), 'domain-area-' || c_nationkey, 'belongs_to', 0.8, 0 from customer
  union all select 'bo-takes-plan-' || (c_custkey % 10), l.id, 'authored_by', 0.6, 0 from customer, lasts l where l.first = 'Bo'
  union all select {_LONG_ID}, 'initiative-plan-' || (s_nationkey % 5), 'belongs_to', 0.8, 0 from supplier
  union all select {_LONG_ID}, l.id, 'authored_by', 0.6, 0 from supplier, lasts l where l.first in ('Dora', 'Eva')
  union all select l.id, 'domain-area-' || c_nationkey, 'belongs_to', 0.7, 1 from customer, lasts l where l.first = 'Cy'
  union all select l.id, 'domain-area-' || n_nationkey, 'belongs_to', b.w, b.o from nation, (values ('Ann', 0.7, 2), ('Bo', 0.7, 3), ('Ann', 0.5, 4), ('Cy', 0.5, 5)) b(first, w, o) join lasts l using (first)
  union all select a.id, b.id, 'relates_to', 0.6, 6 from people a, people b where b.first = 'Dora' and a.id != b.id
  union all select id, 'domain-area-' || n_nationkey, 'belongs_to', 0.7, 7 from people, nation where starts_with(s_nationkey::varchar, n_nationkey::varchar)
  union all select p.id, x.id, 'belongs_to', 0.7, 8 from people p, plans x where x.k = 2
  union all select p.id, 'expertise-topic-' || r_regionkey, 'learned_from', 0.5, 9 from people p, region where p.first in ('Ann', 'Cy')),
there as (select 'dora-s3' as s, 'domain-area-3' as t, 'belongs_to' as r, 0.3::double as w),
folded as (
  select coalesce(ev.s, x.s) as s, coalesce(ev.t, x.t) as t, coalesce(ev.r, x.r) as r, case when x.w is not null then least(1.0, x.w + 0.1 * coalesce(n, 0)) else least(1.0, ev.w + 0.1 * (n - 1)) end as w
  from (select s, t, r, arg_min(w, o) as w, count(*) as n from ev group by 1, 2, 3) ev full join there x on ev.s = x.s and ev.t = x.t and ev.r = x.r)"""


@query(f"""with {_PEOPLE}, {_EVENTS}
select s as source_id, t as target_id, r as relationship, floor(w * 1e6 + 0.5) / 1e6 as weight from folded union all select 'ann', id, 'relates_to', 1.0 from people where first = 'Ann'""")
def vault_graph_edges(spark, d):
    """Its edges: what is met first sets the weight, also where notes, actions and people's own files say the same."""
    return _vault(spark, d)[0].edges.select("source_id", "target_id", "relationship", r6("weight").alias("weight"))


@query(f"""with {_PEOPLE}, made as (
  select id, 'person' as kind from people where id != 'dora-s3' union all select 'domain-area-' || n_nationkey, 'domain' from nation union all select id, 'initiative' from plans
  union all select distinct 'bo-takes-plan-' || (c_custkey % 10), 'domain' from customer union all select distinct {_LONG_ID}, 'initiative' from supplier union all select 'expertise-topic-' || r_regionkey, 'expertise' from region)
select id as node_id, 'vault' as tag from made union all select id, kind from made union all select distinct 'domain-area-' || c_nationkey, unnest(['signal:depends_on', 'signal:supersedes']) from customer""")
def vault_graph_tags(spark, d):
    """Its tags, with those of relation phrases in the sections of domains."""
    return _vault(spark, d)[0].tags.select("node_id", "tag")


@query(f"""with {_PEOPLE}, {_EVENTS} select (select count(*) from customer) + 3 * (select count(*) from supplier) + (select count(*) from nation) + 2 * (select count(*) from region) as files_processed,
  (select count(*) from people where id != 'dora-s3') + (select count(*) from nation) + (select count(*) from plans) + (select count(distinct c_custkey % 10) from customer) + 1 + (select count(*) from region) as nodes_added,
  (select count(*) from people where id = 'dora-s3') + (select count(*) - count(distinct c_custkey % 10) from customer) + (select count(*) - 1 from supplier) as nodes_reinforced, (select count(*) from ev) as edges_added""")
def vault_counts(spark, d):
    return _vault(spark, d)[1]
