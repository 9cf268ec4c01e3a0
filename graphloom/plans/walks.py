"""Queries over file listings, vault bullets, logs and searches of nodes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.operators import graph, notes
from graphloom.plans import projection as P
from graphloom.plans.catalogue import query, r6
from graphloom.sources import files, logs

_FOLDERS = ["src", "docs/build", "obj", "a/bin/b", ".git", "vendor/x", "notes/.hidden", "processed", "lib", "out", "coverage", ".vscode", "docs"]
_NAMES = [
    "a.md", "b.markdown", "c.JSONL", "d.html", "e.text", "f.csv", ".env", ".md", "g.Designer.cs", "h.cs", "AssemblyInfo.cs", "i.g.cs", "j.min.js", "k.jsx", "l.psm1", "package-lock.json", "yarn.lock", "Dockerfile", "web.dockerfile", "m.tsx",
    "n.yml", "o", "Dockerfile.dev", "p.go", "q.rst",
]


def _listing(spark, d) -> DataFrame:
    """A file an order: path, length."""
    pick = lambda values, i: F.element_at(F.array([F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    k = F.col("o_orderkey")
    return P.read(spark, d, "orders").select(F.concat(pick(_FOLDERS, k), F.lit("/"), k.cast("string"), F.lit("/"), pick(_NAMES, F.floor(k / 3))).alias("path"), F.when(k % 11 == 0, 0).when(k % 13 == 0, 500_000).otherwise(k % 1000 + 1).alias("length"))


_LISTING = f"""listing as (
  select ({P._array(_FOLDERS)})[(o_orderkey % {len(_FOLDERS)} + 1)::int] || '/' || o_orderkey || '/' || ({P._array(_NAMES)})[(o_orderkey // 3 % {len(_NAMES)} + 1)::int] as path, case when o_orderkey % 11 = 0 then 0 when o_orderkey % 13 = 0 then 500000 else o_orderkey % 1000 + 1 end as length from orders)"""


@query(rf"""with {_LISTING} select path from listing where length > 0 and length < 500000 and regexp_matches(lower(path), '[^/]\.({"|".join(files.TEXT)})$') and not regexp_matches(path, '(^|/)\.') and not regexp_matches(path, '(^|/)({"|".join(x.replace(".", "[.]") for x in files.SKIPPED)})/')""")
def discover_documents(spark, d):
    return files.document_paths(_listing(spark, d)).select("path")


_LANGUAGE = "case " + " ".join(f"when regexp_matches(lower(path), '[^/][.]{e}$') then '{kind}'" for e, kind in files.LANGUAGES.items()) + " end"


@query(rf"""with {_LISTING}, k as (select path, case when regexp_matches(path, '(^|/)[Dd]ockerfile$') or ends_with(lower(path), '.dockerfile') then 'dockerfile' else {_LANGUAGE} end as language from listing)
select path, language from k where language is not null and not regexp_matches(path, '(^|/)({"|".join(x.replace(".", "[.]") for x in files.CODE_FOLDERS)})/') and not regexp_matches(path, '{"|".join(files.CODE_FILES)}')""")
def walk_sources(spark, d):
    return files.source_paths(_listing(spark, d)).select("path", "language")


_BULLETS = ["Bo: ship it [x]", "✅ Ann Lee: call", "Ann + Bo: meet [X] now", "(✅) Cy: file it", "no person here", "Ann Lee Roe + Bo: too long a name", "Ann Lee Roe: three names", "[x] Bo: first [x] second", "lower: case"]


@query(rf"""with b as (select o_orderkey as k, ({P._array(_BULLETS)})[(o_orderkey % {len(_BULLETS)} + 1)::int] || ' ' || o_orderkey as item from orders),
c as (select k, regexp_matches(item, '{V.DONE}') as completed, regexp_replace(item, '{V.DONE_MARK}', '') as t from b),
m as (select *, '{V.ACTION_OF_TWO}' as two, '{V.ACTION}' as one from c)
select k, completed, unnest([regexp_extract(t, '{V.ACTION_OF_TWO}', 1), regexp_extract(t, '{V.ACTION_OF_TWO}', 2)]) as person,
  trim(regexp_extract(t, '{V.ACTION_OF_TWO}', 3)) as action from m where regexp_matches(t, '{V.ACTION_OF_TWO}')
union all select k, completed, regexp_extract(t, '{V.ACTION}', 1), trim(regexp_extract(t, '{V.ACTION}', 2)) from m where regexp_matches(t, '{V.ACTION}')""")
def vault_actions(spark, d):
    """A next-steps bullet an order."""
    k = F.col("o_orderkey")
    text = F.element_at(F.array([F.lit(b) for b in _BULLETS]), (k % len(_BULLETS) + 1).cast("int"))
    return notes.actions(P.read(spark, d, "orders").select(k.alias("k"), F.concat(text, F.lit(" "), k.cast("string")).alias("item"))).select("k", "completed", "person", "action")


@query("with t as (select doc_id as k, text as item from files) select k, relationship, phrase, substr(item, greatest(1, pos - 30), pos + length(phrase) + 60 - greatest(1, pos - 30)) as context from (select k, item, p[1] as relationship, p[2] as phrase, instr(lower(item), p[2]) as pos from t, (select unnest([" + ", ".join(f"['{r}', '{p}']" for r, ps, _ in V.RELATION_PHRASES for p in ps) + "]) as p)) where pos > 0")
def phrase_signals(spark, d):
    """Relation phrases in documents."""
    t = P.files(spark, d).select(F.col("doc_id").alias("k"), F.col("text").alias("item"))
    return notes.phrase_signals(t).select("k", "relationship", "phrase", "context")


@query("""with c as (select *, '{"n":' || seq || '}' as context, case when seq % 3 = 0 then '' else content end as detail, case when tags = '' then [] else string_split(tags, ', ') end as list from log0),
x as (select *, concat_ws(chr(10), case when detail != '' then detail end, case when len(list) > 0 then 'Tags: ' || array_to_string(list, ', ') end, case when seq % 2 = 0 then 'Context: ' || context end) as lines from c)
select seq, substr(ts, 1, 10) as date, heading, case when lines = '' then heading else lines end as content, type as entry_type from x""")
def log_entries(spark, d):
    """Structured entries as the replay reads them."""
    seq = F.col("seq")
    e = P.log(spark, d).select(
        "ts", "seq", "agent", "type", F.col("heading").alias("summary"), F.when(seq % 3 == 0, "").otherwise(F.col("content")).alias("detail"), F.lit("s").alias("session_id"),
        F.when(F.col("tags") == "", F.array().cast("array<string>")).otherwise(F.split("tags", ", ")).alias("tags"), F.when(seq % 2 == 0, F.concat(F.lit('{"n":'), seq.cast("string"), F.lit("}"))).alias("context"))
    return logs.to_log_entries(e).select("seq", "date", "heading", "content", "entry_type")


_ORDER = "case agent when 'agent-1' then 1 when 'agent-3' then 2 else 3 end"


@query(f"select agent, ts, detail from (select agent, ts, 'no ' || seq as detail, row_number() over (partition by agent in ('agent-1', 'agent-2') order by {_ORDER} desc, seq desc) as a from log where type in ('error', 'decision') and substr(ts, 1, 10) >= '2024-01-10' and agent in ('agent-1', 'agent-2')) where a <= 40")
def read_log(spark, d):
    """The last entries of two agents and types from a day on, out of a log appended to three times: one agent, another, then all others, the largest file."""
    from graphloom.sources.shared import folder

    e = P.log(spark, d).select("seq", "ts", "agent", "type", F.col("content").alias("summary"), F.concat(F.lit("no "), F.col("seq").cast("string")).alias("detail"))
    path = folder(spark)
    for part in ("agent = 'agent-1'", "agent = 'agent-3'", "agent not in ('agent-1', 'agent-3')"):
        logs.append_entries(e.filter(part).orderBy("seq").drop("seq"), path)
    rows, _ = logs.read_jsonl(spark, path)
    return logs.select_entries(rows.filter("agent in ('agent-1', 'agent-2') and type in ('error', 'decision')"), since_date="2024-01-10", last=40).select("agent", "ts", "detail")


@query("select agent, ts, detail from (select agent, ts, 'no ' || seq as detail from log where agent = 'agent-1' order by seq desc limit 25)")
def read_log_last(spark, d):
    """The last entries of an agent whose log was cut into appends of falling size: the newest is the smallest."""
    from graphloom.sources.shared import folder

    e = P.log(spark, d).filter("agent = 'agent-1'").select("seq", "ts", "agent", "type", F.col("content").alias("summary"), F.concat(F.lit("no "), F.col("seq").cast("string")).alias("detail"))
    path = folder(spark)
    most = e.agg(F.max("seq")).first()[0]
    for low, high in ((0.0, 0.7), (0.7, 0.95), (0.95, 1.0)):
        logs.append_entries(e.filter((F.col("seq") > low * most - (low == 0)) & (F.col("seq") <= high * most)).orderBy("seq").drop("seq"), path)
    return logs.select_entries(logs.read_jsonl(spark, path)[0], last=25).select("agent", "ts", "detail")


@query("select id, floor(salience * 1e6 + 0.5) / 1e6 as salience from (select *, case when type = 'pattern' then 'src/' || name || '.cs' end as file_path from nodes) where lower(type) = 'pattern' and contains(lower(file_path), 'red') and salience >= 0.2")
def find_nodes_by_path(spark, d):
    """Type in whatever case, and a part of the file path."""
    n = P.nodes(spark, d).withColumn("file_path", F.when(F.col("type") == "pattern", F.concat(F.lit("src/"), "name", F.lit(".cs"))))
    return graph.find_nodes(n, type="Pattern", any_case=True, path_part="RED", min_salience=0.2, limit=None).select("id", r6("salience").alias("salience"))


# ---- vaults: next actions, aliases, people and areas


def _people(spark, d) -> DataFrame:
    """A person a nation, with three first names among them."""
    k = F.col("n_nationkey")
    first = F.element_at(F.array(F.lit("Ann"), F.lit("Bo"), F.lit("Cy")), (k % 3 + 1).cast("int"))
    return P.read(spark, d, "nation").select(F.concat(F.lit("person-"), k.cast("string")).alias("id"), F.concat(first, F.lit(" Lee")).alias("name"))


_PEOPLE = "people as (select 'person-' || n_nationkey as id, (['Ann', 'Bo', 'Cy'])[(n_nationkey % 3 + 1)::int] || ' Lee' as name from nation)"
_TODO = "## Open\n- Ann: call {k}\n- Bo: write\n- no name\n## Done\n- Ann: old\n- Cy: gone\nplain"


def _todo(spark, d) -> DataFrame:
    """A next-actions file an order, of its customer: path, text, c."""
    k = F.col("o_orderkey").cast("string")
    head, tail = _TODO.split("{k}")
    return P.read(spark, d, "orders").select(k.alias("path"), F.concat(F.lit(head), k, F.lit(tail)).alias("text"), F.col("o_custkey").alias("c"))


@query(f"""with {_PEOPLE}, f as (select split_part(name, ' ', 1) as person, max(id) as id from people group by 1), b as (
  select 'Ann' as person, 0.7::double as w, 2 as n union all select 'Bo', 0.7, 1 union all select 'Cy', 0.5, 1), o as (select 'customer-' || o_custkey as parent, count(*) as files from orders group by 1)
select f.id as source_id, parent as target_id, 'belongs_to' as relationship, floor(least(1.0, w + 0.1 * (n * files - 1)) * 1e6 + 0.5) / 1e6 as weight from o, b join f using (person)""")
def parent_actions(spark, d):
    """Open and done actions of people in a customer's files."""
    t = _todo(spark, d)
    out = notes.parent_actions(notes.next_actions(t), t.select("path", F.concat(F.lit("customer-"), F.col("c").cast("string")).alias("parent_id")), _people(spark, d))
    return out.select("source_id", "target_id", "relationship", r6("weight").alias("weight"))


@query("select id, floor(least(1.0, salience + 0.05 * 3 * n) * 1e6 + 0.5) / 1e6 as salience from nodes join (select 'customer-' || o_custkey as id, count(*) as n from orders group by 1) using (id)")
def reinforced_owners(spark, d):
    """Each open bullet of an owner's files reinforces the owner."""
    t = _todo(spark, d)
    n = P.nodes(spark, d)
    owners = t.select("path", F.concat(F.lit("customer-"), F.col("c").cast("string")).alias("person_id"))
    out = notes.reinforce_owners(n, notes.next_actions(t), owners, F.to_timestamp(F.lit(P.AS_OF)))
    return out.filter("type = 'person'").join(owners.select(F.col("person_id").alias("id")).distinct(), "id", "left_semi").select("id", r6("salience").alias("salience"))


@query(f"with {_PEOPLE} select lower(split_part(name, ' ', 1)) as source_id, id as target_id, 1.0::double as weight, 'Alias: ' || split_part(name, ' ', 1) || ' → ' || name as description from people where split_part(name, ' ', 1) != 'Cy'")
def alias_edges(spark, d):
    """From nodes known by a first name to the people who have it; there is none called Cy."""
    known = spark.createDataFrame([("ann",), ("bo",)], "id string")
    return notes.alias_edges(_people(spark, d), known).select("source_id", "target_id", "weight", "description")


_TALK = ["Met Ann today", "Bo Lee and Cy spoke", "nobody", "Anna is not Ann Lee", "Boris"]


@query(f"""with {_PEOPLE}, n as (select 'person-' || (o_custkey % 25) as source_id, o_orderkey as path, ({P._array(_TALK)})[(o_orderkey % {len(_TALK)} + 1)::int] as t from orders),
m as (select source_id, p.id as target_id, count(*) as n from n join people p on contains(t, split_part(p.name, ' ', 1)) group by 1, 2)
select 'relates_to' as relationship, source_id, target_id, floor(least(1.0, 0.6 + 0.1 * (n - 1)) * 1e6 + 0.5) / 1e6 as weight from m where source_id != target_id
union all select 'learned_from', p.id, 'area-' || (path % 3), floor(least(1.0, 0.5 + 0.1 * (count(*) - 1)) * 1e6 + 0.5) / 1e6 from n join people p on contains(t, split_part(p.name, ' ', 1)) group by p.id, path % 3""")
def people_and_areas(spark, d):
    """Who is named in whose notes, and in which area's files."""
    k = F.col("o_orderkey")
    t = P.read(spark, d, "orders").select(k.cast("string").alias("path"), F.element_at(F.array([F.lit(x) for x in _TALK]), (k % len(_TALK) + 1).cast("int")).alias("text"), F.concat(F.lit("person-"), (F.col("o_custkey") % 25).cast("string")).alias("person_id"), F.concat(F.lit("area-"), (k % 3).cast("string")).alias("area_id"))
    people = _people(spark, d)
    out = notes.people_edges(t.select("path", "text"), t.select("path", "person_id"), people).unionByName(notes.expertise_edges(t.select("path", "text"), t.select("path", "area_id"), people))
    return out.select("relationship", "source_id", "target_id", r6("weight").alias("weight"))
