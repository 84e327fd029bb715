"""Point lookups in a graph, deletion and insertion of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import expand
from kgloom.shared import written


def entity_triples(triples: DataFrame, entity: str) -> DataFrame:
    """Triples with the entity as subject, then those with it as object: a loop comes twice."""
    return triples.where(F.col("s") == entity).unionByName(triples.where((F.col("o") == entity) & ~F.col("is_lit")))


def delete_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples that touch none of the (node) entities."""
    left = triples.join(entities.select(F.col("node").alias("s")), "s", "left_anti")
    objects = entities.select(F.col("node").alias("__o"))
    return left.join(objects, (F.col("o") == F.col("__o")) & ~F.col("is_lit"), "left_anti").select(triples.columns)


def add(triples: DataFrame, more: DataFrame) -> DataFrame:
    """A graph is a set: repeated triples count once."""
    return triples.unionByName(more, allowMissingColumns=True).distinct()


def delete_entity(triples: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, what went) of a graph that loses an entity with all its triples."""
    gone = entity_triples(triples, entity).distinct()
    return delete_entities(triples, triples.sparkSession.createDataFrame([(entity,)], "node string")), gone


def typed(triples: DataFrame) -> DataFrame:
    """(s, p, o, object_type) rows, object_type being URI or Literal, as (s, p, o, is_lit)."""
    return triples.select("s", "p", "o", (F.col("object_type") == "Literal").alias("is_lit"))


def affected_nodes(triples: DataFrame, entity: str, nodes: DataFrame, depth: int) -> DataFrame:
    """(noi): the nodes of interest within `depth` of an entity."""
    start = triples.sparkSession.createDataFrame([(entity,)], "node string")
    near = expand.affected(triples, start, depth).where("NOT is_lit")
    return nodes.join(near, F.col("noi") == F.col("node"), "left_semi")


def upsert(nbh: DataFrame, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """The neighbourhoods of the recomputed (noi) nodes replaced, even by nothing."""
    return nbh.join(nodes.select("noi").distinct(), "noi", "left_anti").unionByName(fresh)


def refreshed_walks(old: DataFrame, walks: expand.Walks, nodes: DataFrame, changed: DataFrame, new: DataFrame, depth: int, skip: list[str] | None = None) -> expand.Walks:
    """The walks after a change of the graph from `old` to `new` that touched the (node) entities `changed`: only nodes
    within `depth` of them, before or after, are worked out again; the others keep theirs."""
    changed = written(changed, "changed")
    near = expand.affected(old, changed, depth).unionByName(expand.affected(new, changed, depth)).where("NOT is_lit").select("node").distinct()
    again = written(nodes.join(near, F.col("noi") == F.col("node"), "left_semi").select("noi").distinct(), "again")
    return walks.without(again).plus(expand.walks(new, again, depth, skip))


def refreshed(old: DataFrame, nbh: DataFrame, nodes: DataFrame, changed: DataFrame, new: DataFrame, depth: int, skip: list[str] | None = None) -> DataFrame:
    """The rows of `refreshed_walks` for the listed neighbourhoods nbh."""
    return refreshed_walks(old, expand.Walks(nbh), nodes, changed, new, depth, skip).rows()
