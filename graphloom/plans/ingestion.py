"""Queries that take documents in, whole texts throughout, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import NAME, summary
from graphloom.operators import extraction, graph, ingest
from graphloom.plans import projection as P
from graphloom.plans.catalogue import _as_of, query, r6
from graphloom.sources.shared import settle

_SPACE = r"[ \t\n\x0B\f\r]"
#: Paragraphs are lines here; acc holds finished chunks and the current one, parted by character 1.
CHUNKS = rf"""paras as (
  select path || '#' || doc_id as path, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x != '') as ps from files),
packed as (
  select path, list_reduce(ps, lambda acc, x: case when acc = '' then x when length(string_split(acc, chr(1))[-1]) + length(x) > {ingest.CHUNK} then acc || chr(1) || x else acc || chr(10) || chr(10) || x end, '') as c from paras),
chunks_ as (select path, generate_subscripts(string_split(c, chr(1)), 1) - 1 as chunk_seq, unnest(string_split(c, chr(1))) as text from packed where c != '')"""

_SLUG = "case when {0} = '' then substr(sha256({1}), 1, 8) else {0} end"


def _slug(name: str) -> str:
    s = f"substr(regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40)"
    return _SLUG.format(s, name)


_PEOPLE = r"""people as (
  select path, chunk_seq, text, name, instr(text, name) - 1 as s from (select *, unnest(list_distinct(regexp_extract_all(text, '\b([A-Z][a-z]+ [A-Z][a-z]+)\b', 1))) as name from {0})
  where len(list_intersect(string_split(name, ' '), """ + P._array(V.NOT_NAMES) + ")) = 0 and name not in (select unnest(" + P._array(V.NOT_PEOPLE) + ")))"  # fmt: skip
_TOOLS = f"tools as (select path, chunk_seq, text, k, instr(lower(text), k) - 1 as s from chunks_, (select unnest({P._array(V.TOOL_KEYWORDS)}) as k) where contains(lower(text), k))"


def _signal_sql(kind: str, pattern: str) -> str:
    tail = V.SIGNAL_TAIL.replace("'", "''")
    return rf"""select path, chunk_seq, substr(trim(regexp_extract(after, '{tail}', 1)), 1, 60) as name, '{kind}' as type, s, s + length(m) + length(regexp_extract(after, '{tail}', 0)) as e, 3 as rule from (
    select *, substr(text, s + length(m) + 1, 120) as after from (select *, regexp_extract(text, '{pattern}', 0) as m, length(regexp_extract(text, '(?s)^(.*?){pattern}', 1)) as s from chunks_) where m != '')
    where length(trim(regexp_extract(after, '{tail}', 1))) > 3"""


def _heading_sql() -> str:
    label = "trim(regexp_extract(x, '^#{1,4}\\s+(.+)', 1))"
    any_ = lambda words: " or ".join(f"contains(low, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)
    kinds = [(i, k, w) for i, (k, w) in enumerate(V.ENTITY_KEYWORDS.items()) if k != "person"]
    hits = ", ".join(f"case when {any_(w)} then {i} end" for i, _, w in kinds)
    names = ", ".join(f"{i}: '{k}'" for i, k, _ in kinds)
    return rf"""heads as (
  select path, chunk_seq, lower(text) as low, substr(case when {label} != '' then {label} else x end, 1, 60) as name from (
    select *, list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y)), lambda x: {label} != '' or length(x) > 5 and length(x) < 80 and not starts_with(x, '-') and not starts_with(x, '*'))[1] as x from chunks_) where x is not null),
kinds as (select path, chunk_seq, name, unnest(list_filter([{hits}], lambda v: v is not null)) as i from heads
  where length(trim(lower(name))) > 2 and trim(lower(name)) not in (select unnest({P._array(V.GARBAGE)})) and not regexp_matches(name, '[/+&@#$%^*(){{}}\[\]<>|\\]')),
headings as (select path, chunk_seq, name, map {{{names}}}[i] as type, 0 as s, length(name) as e, 4 + i as rule from kinds)"""


#: All entities of chunks, first rule and place of an id in a chunk.
ENTS = rf"""{CHUNKS}, {_PEOPLE.format("chunks_")}, {_TOOLS}, {_heading_sql()},
every as (
  select path, chunk_seq, name, 'person' as type, s, s + length(name) as e, 1 as rule from people union all select path, chunk_seq, substr(text, s + 1, length(k)), 'tool', s, s + length(k), 2 from tools
  union all {" union all ".join(_signal_sql(*x) for x in V.SIGNALS)} union all select * from headings),
ids as (select *, {_slug("name")} as id from every),
ents as (select *, row_number() over (partition by path, chunk_seq order by rule, s, id) as q from (select *, row_number() over (partition by path, chunk_seq, id order by rule, s, name) as r from ids) where r = 1)"""
_GAP = "greatest(0, a.s - b.e, b.s - a.e)"
PAIRS = f"""pairs as (
  select a.path, a.chunk_seq, a.q as a_seq, b.q as b_seq, least(a.id, b.id) as source_id, greatest(a.id, b.id) as target_id, greatest(0.3::double, 1.0::double - 0.7::double * {_GAP} / 300) as weight, least(a.s, b.s) as lo, greatest(a.e, b.e) as hi
  from ents a join ents b on a.path = b.path and a.chunk_seq = b.chunk_seq and a.q < b.q where not (a.type = 'person' and b.type = 'person') and {_GAP} <= 300)"""
ACROSS = """firsts as (select id, path, min(row(path, chunk_seq, q)) as pos from ents group by 1, 2), seen as (select id, min(pos) as first from firsts group by 1 having count(*) >= 2),
across as (
  select a.id as source_id, b.id as target_id, count(*) as shared, least(1.0::double, 0.4::double + 0.15::double * count(*)) as weight, list_sort(list(a.path))[1:3] as files
  from firsts a join firsts b on a.path = b.path join seen x on x.id = a.id join seen y on y.id = b.id where x.first < y.first group by 1, 2)"""
R6 = "floor(({0}) * 1e6 + 0.5) / 1e6"


def _whole(spark, d) -> DataFrame:
    """Whole documents, each a file of its own."""
    return P.files(spark, d).select(F.concat("path", F.lit("#"), F.col("doc_id").cast("string")).alias("path"), "text")


def _chunks(spark, d) -> DataFrame:
    return ingest.chunk(_whole(spark, d), separator="\n")


def _entities(spark, d) -> DataFrame:
    """From chunks that are written once: every rule reads them."""
    return ingest.entities(settle(_chunks(spark, d))[0])


@query(f"with {CHUNKS} select path, count(*) as n_chunks, max(length(text)) as longest from chunks_ group by 1")
def chunks(spark, d):
    return _chunks(spark, d).groupBy("path").agg(F.count("*").alias("n_chunks"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"with {CHUNKS}, {_PEOPLE.format('chunks_')} select path, chunk_seq, name, s as start from people")
def person_spans(spark, d):
    return ingest.people(_chunks(spark, d)).select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), "name", F.col("start").cast("long").alias("start"))


@query(f"with {CHUNKS}, {_TOOLS} select path, chunk_seq, k as id, s as start from tools")
def tool_hits(spark, d):
    return ingest.tools(_chunks(spark, d)).select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), "id", F.col("start").cast("long").alias("start"))


@query(f"with {ENTS} select path, chunk_seq, q as ent_seq, id, type, s as start, e as \"end\", rule from ents")
def ingest_full(spark, d):
    """All rules: path, chunk, id, type, span."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return _entities(spark, d).select("path", long("chunk_seq"), long("ent_seq"), "id", "type", long("start"), long("end"), "rule")


@query(f"with {ENTS}, {PAIRS} select path, chunk_seq, source_id, target_id, {R6.format('weight')} as weight from pairs")
def pair_edges(spark, d):
    (e,) = settle(_entities(spark, d))
    return ingest.pair_edges(e).select("path", F.col("chunk_seq").cast("long").alias("chunk_seq"), "source_id", "target_id", r6("weight").alias("weight"))


@query(f"with {ENTS}, {ACROSS} select source_id, target_id, shared, {R6.format('weight')} as weight from across")
def crossdoc(spark, d):
    (e,) = settle(_entities(spark, d))
    return ingest.cross_document(e).select("source_id", "target_id", "shared", r6("weight").alias("weight"))


def _base(spark) -> graph.Graph:
    """A graph that knows docker and one person, and a link of theirs."""
    g = graph.Graph.empty(spark)
    nodes = spark.createDataFrame([("docker", "tool", "Docker", "containers", 0.85), ("anna-keller", "person", "Anna Keller", "", 0.3)], "id string, type string, name string, description string, salience double")
    edges = spark.createDataFrame([("anna-keller", "docker", "relates_to", 0.45)], "source_id string, target_id string, relationship string, weight double")
    return g.with_(nodes=graph.complete(nodes, _as_of()), edges=g.edges.unionByName(edges, allowMissingColumns=True))


def _ingested(spark, d):
    return ingest.ingest(_base(spark), _whole(spark, d), _as_of(), "papers", separator="\n")


_KNOWN = "base as (select * from (values ('docker', 'tool', 'Docker', 'containers', 0.85::double), ('anna-keller', 'person', 'Anna Keller', '', 0.3::double)) t(id, type, name, description, salience))"


@query(f"""with {ENTS}, {_KNOWN},
m as (select id, count(*) as n, arg_min(row(type, name, substr(text, 1, 200)), row(path, chunk_seq, q)) as x from ents join chunks_ using (path, chunk_seq) group by 1)
select coalesce(b.id, m.id) as id, coalesce(b.type, x[1]) as type, coalesce(b.name, x[2]) as name, coalesce(b.description, x[3]) as description, {R6.format("least(1.0::double, case when b.id is null then 0.6::double + 0.1::double * (n - 1) else b.salience + 0.1::double * coalesce(n, 0) end)")} as salience,
  case when b.id is null then 'papers' else 'unclassified' end as namespace, case when b.id is null then 'ingest' else '' end as source_agent
from m full join base b on m.id = b.id""")
def ingest_nodes(spark, d):
    """Documents taken into a graph that has two nodes: its nodes after it."""
    return _ingested(spark, d)[0].nodes.select("id", "type", "name", "description", r6("salience").alias("salience"), "namespace", "source_agent")


@query(f"""with {ENTS}, {PAIRS}, {ACROSS},
events as (
  select source_id, target_id, weight, substr(text, lo + 1, least(100, hi - lo)) as description, row(0, path, chunk_seq, a_seq, b_seq) as place from pairs join chunks_ using (path, chunk_seq)
  union all select source_id, target_id, weight, 'Co-occur in ' || shared || ' file(s): ' || array_to_string(files, ', '), row(1, '', 0, 0, 0) from across),
f as (select source_id, target_id, count(*) as n, arg_min(weight, place) as w, arg_min(description, place) as description from events group by 1, 2),
old as (select 'anna-keller' as source_id, 'docker' as target_id, 0.45::double as weight)
select coalesce(o.source_id, f.source_id) as source_id, coalesce(o.target_id, f.target_id) as target_id, 'relates_to' as relationship,
  {R6.format("least(1.0::double, case when o.source_id is null then w + 0.1::double * (n - 1) else o.weight + 0.1::double * coalesce(n, 0) end)")} as weight, case when o.source_id is null then description end as description
from f full join old o on f.source_id = o.source_id and f.target_id = o.target_id""")
def ingest_edges(spark, d):
    """The same graph's edges."""
    return _ingested(spark, d)[0].edges.select("source_id", "target_id", "relationship", r6("weight").alias("weight"), "description")


@query(f"""with {ENTS}, {PAIRS}, {ACROSS}, {_KNOWN}
select (select count(distinct path) from chunks_) as files, (select count(*) from chunks_) as chunks, (select count(*) from (select distinct path, chunk_seq from ents)) as chunks_with_entities, (select count(*) from ents) as entities,
  (select count(distinct id) from ents where id not in (select id from base)) as nodes_added, (select count(*) from ents) - (select count(distinct id) from ents where id not in (select id from base)) as nodes_reinforced,
  (select count(*) from pairs) + (select count(*) from across) as edges_added""")
def ingest_counts(spark, d):
    return _ingested(spark, d)[1].select("files", "chunks", "chunks_with_entities", "entities", "nodes_added", "nodes_reinforced", "edges_added")


_RELATION = "case " + " ".join(f"when {' or '.join(f'''contains(t, '{p}')''' for p in phrases)} then '{name}'" for name, phrases, _ in V.RELATION_PHRASES if name != "relates_to") + " else 'relates_to' end"


@query(rf"""with n as (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '\b([A-Z][a-z]+ [A-Z][a-z]+)\b', 1))) as name from files),
s as (select doc_id, text, name, instr(text, name) - 1 as s, instr(text, name) - 1 + length(name) as e from n),
p as (select a.doc_id, least(a.name, b.name) as source, greatest(a.name, b.name) as target, greatest(0, b.s - a.e, a.s - b.e) as gap, least(300, floor(length(a.text) * 0.4)) as bound,
  lower(substr(a.text, least(a.s, b.s) + 1, greatest(a.e, b.e) - least(a.s, b.s))) as t from s a join s b on a.doc_id = b.doc_id and a.name < b.name)
select doc_id, source, target, {_RELATION} as relationship, floor(greatest(0.3, 1.0 - gap / bound * 0.7) * 1000 + 0.5) / 1000 as weight from p where gap <= bound""")
def detect_relationships(spark, d):
    f = P.files(spark, d).select("doc_id", F.col("text").alias("content"))
    name = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(NAME), 1)))
    spans = f.select("doc_id", "content", name.alias("text")).withColumn("start", F.expr("instr(content, text)") - 1).withColumn("end", F.col("start") + F.length("text"))
    spans = spans.withColumn("seq", F.struct("start", "text")).withColumn("label", F.lit("thing"))
    return extraction.detect_relations(f, spans).select("doc_id", "source", "target", "relationship", "weight")


@query(r"""select doc_id, substr(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x), '^- ', '')), lambda x: length(x) > 10 and not starts_with(x, '_'))[1], text), 1, 200) as summary from files""")
def summaries(spark, d):
    return P.files(spark, d).select("doc_id", summary(F.col("text")).alias("summary"))
