"""Queries of match expressions, of the upkeep of a stored index, of prototype classes and of sub-graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, prototypes, search, traverse
from graphloom.plans import projection as P
from graphloom.plans.catalogue import query, r6
from graphloom.sources.shared import folder, settle

# ---- match expressions


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x != '')"


_BOTH = f"w as (select id, sensitivity, salience, {_words('name')} as a, {_words('description')} as b from nodes)"


def _times(words: list[str], prefix: bool, columns: str = "ab") -> str:
    """How often a phrase stands in the lists of words."""
    test = lambda c, k, w: f"starts_with({c}[i + {k}], '{w}')" if prefix and k == len(words) - 1 else f"{c}[i + {k}] = '{w}'"
    return " + ".join(f"len(list_filter(range(1, len({c}) + 1), lambda i: " + " and ".join(f"coalesce({test(c, k, w)}, false)" for k, w in enumerate(words)) + "))" for c in columns)


def _match_sql(phrases: list[tuple], holds: str, nodes: str = "") -> str:
    """A relation s of id and rank; holds is written with p0, p1 .. for the phrases' counts."""
    tf = ", ".join(f"{_times(*p)} as p{k}" for k, p in enumerate(phrases))
    df = ", ".join(f"sum((p{k} > 0)::int) as d{k}" for k in range(len(phrases)))
    score = " + ".join(f"case when p{k} > 0 then ln(1 + (docs - d{k} + 0.5) / (d{k} + 0.5)) * p{k} * 2.2 / (p{k} + 1.2 * (0.25 + 0.75 * len / mean)) else 0 end" for k in range(len(phrases)))
    return f"with {nodes or _BOTH}, c as (select id, sensitivity, salience, len(a) + len(b) as len, {tf} from w), t as (select count(*) as docs, avg(len) as mean, {df} from c), s as (select id, {score} as rank from c, t where {holds} and coalesce(sensitivity, 0) <= 1)"


_ALL = " select id, floor(rank / (1 + rank) * 1e6 + 0.5) / 1e6 as score from s"


def _matched(spark, d, text: str) -> DataFrame:
    """Every node under the ceiling that a match expression holds for, with its score, out of a stored index."""
    n = P.nodes(spark, d)
    index = settle(search.inverted_index(n).repartitionByRange("term").sortWithinPartitions("term"), search.index_totals(n))
    hits = search.match(*index, text).join(n.filter("coalesce(sensitivity, 0) <= 1").select("id"), "id", "left_semi")
    return hits.select("id", r6(F.col("rank") / (1 + F.col("rank"))).alias("score"))


@query(_match_sql([(["small", "ring"], False)], "p0 > 0") + _ALL)
def match_phrase(spark, d):
    """Two words that follow each other in a name or in a description."""
    return _matched(spark, d, '"small ring"')


@query(_match_sql([(["bran"], True), (["custom"], True, "a")], "(p0 > 0 or p1 > 0)") + _ALL)
def match_prefix(spark, d):
    """Words that begin in some way, one of them in the name."""
    return _matched(spark, d, "bran* OR name: custom*")


@query(_match_sql([(["ring"], False), (["building"], False), (["small"], False)], "(p0 > 0 or p1 > 0 and p2 > 0)") + _ALL)
def match_or(spark, d):
    return _matched(spark, d, "ring OR building AND small")


@query(_match_sql([(["ring"], False), (["small"], False), (["brand", "1"], True)], "p0 > 0 and not (p1 > 0 or p2 > 0)") + _ALL)
def match_not(spark, d):
    """One word without another and without a phrase that ends in a prefix."""
    return _matched(spark, d, "ring NOT (small OR brand + 1*)")


@query("select id, floor(salience * 1e6 + 0.5) / 1e6 as score from nodes where (name ilike '%r#000%' or description ilike '%r#000%') and coalesce(sensitivity, 0) <= 1 order by nodes.salience desc, id limit 20")
def match_ill_formed(spark, d):
    """Not a match expression: a piece of text."""
    return search.query_by_keyword(P.nodes(spark, d), "r#000", 1, 20).select("id", r6("score").alias("score"))


_CHANGED = "(id like '%3' or id like '%6' or id like '%9')"
_FINAL = f"w as (select id, sensitivity, salience, {_words('name')} as a, {_words('description')} as b from (select id, sensitivity, salience, case when {_CHANGED} then 'changed ' || type else name end as name, case when {_CHANGED} then 'small ring ' || description else description end as description from nodes where id not like '%7' union all select 'new-' || id, sensitivity, salience, name, 'small ring of ' || name from nodes where type = 'concept'))"


@query(_match_sql([(["ring"], False), (["small"], False)], "p0 > 0 and p1 > 0", _FINAL) + _ALL)
def index_upkeep(spark, d):
    """An index made, three nodes in ten changed, one in ten deleted, some added, some changed and changed back, and all merged: a search gives what it gives over the final nodes."""
    (n,) = settle(P.nodes(spark, d).select("id", "type", "name", "description", "sensitivity"))  # every change reads them
    path, merged = folder(spark), folder(spark)
    search.create_index(n, path)
    other = n.withColumns({"name": F.concat(F.lit("changed "), F.col("type")), "description": F.concat(F.lit("small ring "), F.col("description"))})
    search.update_index(other.filter(f"{_CHANGED} or id like '%5'"), n.filter("id like '%70'").select("id"), path)
    fresh = n.filter("type = 'concept'").select(F.concat(F.lit("new-"), F.col("id")).alias("id"), "name", F.concat(F.lit("small ring of "), F.col("name")).alias("description"), "sensitivity")
    search.update_index(fresh.unionByName(n.filter("id like '%5'").select(fresh.columns)), n.filter("id like '%7'").select("id"), path)
    # what the second change deletes beside the first: ids that end in 70 come back
    search.update_index(n.filter("id like '%70'"), n.limit(0).select("id"), path)
    search.merge_index(spark, path, merged)
    final = n.filter(f"id not like '%7' and not {_CHANGED}").select("id", "sensitivity").unionByName(other.filter(f"id not like '%7' and {_CHANGED}").select("id", "sensitivity")).unionByName(fresh.select("id", "sensitivity"))
    hits = search.bm25_indexed(*search.stored_index(spark, merged), final, "small ring", 1)
    return hits.select("id", r6(F.col("rank") / (1 + F.col("rank"))).alias("score"))


# ---- prototype classes


@query("""select vec_id, class, floor(confidence * 1e6 + 0.5) / 1e6 as confidence from (
  select v.vec_id, case when max(dot) > 0.3 then arg_max(label, dot) end as class, greatest(0.3::double, max(dot)) as confidence
  from (select v.vec_id, p.label, list_dot_product(v.e, p.prototype) as dot from (select vec_id, embedding::double[] as e from embeddings where vec_id % 5 = 0) v, (
    select label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as prototype from (
      select label, list(x order by i) as m from (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as i from embeddings where vec_id % 5 != 0) group by 1, 2) group by 1)) p) v group by 1)""")
def prototype_classes(spark, d):
    """Classes' mean vectors, of four vectors in five, tried on the others: the nearest one's label, and how near it is."""
    v = P.read(spark, d, "embeddings")
    means = prototypes.class_means(v.filter("vec_id % 5 != 0"))
    out = prototypes.nearest(v.filter("vec_id % 5 = 0").select("vec_id", "embedding"), means)
    return out.select("vec_id", "class", r6("confidence").alias("confidence"))


# ---- sub-graphs


def _seen_sql(depth: int, prune: bool) -> str:
    """Relations v0, v1 ..: the nodes seen after so many rounds, and whether they are visible."""
    lead = "v" if prune else "true"
    rounds = ["v0 as materialized (select id, true as v from (select id from nodes where source_agent = 'building' and salience >= 0.3 and coalesce(sensitivity, 0) <= 1 order by salience desc, id limit 20))"]
    for k in range(1, depth + 1):
        rounds.append(f"v{k} as materialized (select id, v from v{k - 1} union all select id, id in (select id from ok) from (select distinct nxt as id from both_ways where s in (select id from v{k - 1} where {lead})) where id not in (select id from v{k - 1}))")
    return "with both_ways as materialized (select source_id as s, target_id as nxt from edges union all select target_id, source_id from edges), ok as materialized (select id from nodes where salience >= 0.3 and coalesce(sensitivity, 0) <= 1), " + ", ".join(rounds)


def subgraph_sql(depth: int, prune: bool) -> str:
    return _seen_sql(depth, prune) + f" select id, floor(salience * 1e6 + 0.5) / 1e6 as salience from nodes where id in (select id from v{depth} where v) order by nodes.salience desc, id limit 200"


def subgraph_of(spark, d, depth: int, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    n, e = settle(P.nodes(spark, d), P.edges(spark, d))
    seeds = graph.find_nodes(n, agent="building", min_salience=0.3, ceiling=1, limit=20).select(F.col("id").alias("node_id"), F.lit("seed").alias("tag"))
    return traverse.query_subgraph(n, e, seeds, tag="seed", min_salience=0.3, depth=depth, limit=200, ceiling=1, mode=mode)


def _nodes_of(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    return found[0].select("id", r6("salience").alias("salience"))


@query(subgraph_sql(1, False))
def subgraph_d1(spark, d):
    """All edges count, also weak ones and those of nations."""
    return _nodes_of(subgraph_of(spark, d, 1))


@query(subgraph_sql(2, False))
def subgraph_skip_d2(spark, d):
    return _nodes_of(subgraph_of(spark, d, 2))


@query(subgraph_sql(2, True))
def subgraph_prune_d2(spark, d):
    return _nodes_of(subgraph_of(spark, d, 2, "prune"))


@query(subgraph_sql(6, True))
def subgraph_d6(spark, d):
    """More rounds than it takes to see all that can be seen."""
    return _nodes_of(subgraph_of(spark, d, 6, "prune"))


@query(_seen_sql(1, False) + " select source_id, target_id, relationship, floor(weight * 1e6 + 0.5) / 1e6 as weight from edges where source_id in (select id from v1 where v) and target_id in (select id from v1 where v)")
def subgraph_edges(spark, d):
    """The edges between all that is visible after one round, of more nodes than the limit."""
    return subgraph_of(spark, d, 1)[1].select("source_id", "target_id", "relationship", r6("weight").alias("weight"))


@query(_seen_sql(2, True) + " select relationship, count(*) as n, floor(sum(weight) * 1e4 + 0.5) / 1e4 as weight from edges where source_id in (select id from v2 where v) and target_id in (select id from v2 where v) group by 1")
def subgraph_edges_d2(spark, d):
    e = subgraph_of(spark, d, 2, "prune")[1]
    return e.groupBy("relationship").agg(F.count("*").alias("n"), (F.floor(F.sum("weight") * 1e4 + 0.5) / 1e4).alias("weight"))
