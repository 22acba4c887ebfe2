"""Explanations: a reason code and its evidence become evidence nodes, evidence edges and a clause of text.

The wording of the clauses, the code prefixes and the z-score from which an anomaly is mentioned are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What any known evidence may hold.
EVIDENCE = "txids array<string>, wallets array<string>, txid string, input_wallets array<string>, output_wallets array<string>, path array<string>, pattern_type string, nearest_reference_id string, similarity double"
NOTABLE_Z = 1.5
_NO_NODES, _NO_EDGES = "array<string>", "array<struct<a:string,b:string>>"


def two_digits(x: Column) -> Column:
    """x with two digits after the point, halves away from zero, by arithmetic that does not depend on the engine."""
    n = F.floor(F.abs(x) * 100 + 0.5).cast("bigint")
    return F.concat(
        F.when((x < 0) & (n > 0), "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")
    )


def _nodes() -> Column:
    return F.array().cast(_NO_NODES)


def _edges() -> Column:
    return F.array().cast(_NO_EDGES)


def _chain(path: Column) -> Column:
    """The edges between neighbours of a path."""
    n = F.size(path) - 1
    return F.when(
        n > 0,
        F.zip_with(
            F.slice(path, F.lit(1), F.greatest(n, F.lit(0))),
            F.slice(path, F.lit(2), F.greatest(n, F.lit(0))),
            lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        )
    ).otherwise(_edges())


def _list(name: str) -> Column:
    return F.coalesce(F.col(f"ev.{name}"), _nodes())


def _value() -> Column:
    return F.element_at(F.split("reason_code", "="), 2)


def _peel() -> tuple[Column, Column, Column]:
    return F.concat(_list("wallets"), _list("txids")), _chain(_list("wallets")), F.concat(
        F.lit("part of a peeling chain with "), _value(), F.lit(" hops")
    )


def _coinjoin() -> tuple[Column, Column, Column]:
    tx = F.col("ev.txid")
    into = F.transform(_list("input_wallets"), lambda w: F.struct(w.alias("a"), tx.alias("b")))
    out = F.transform(_list("output_wallets"), lambda w: F.struct(tx.alias("a"), w.alias("b")))
    return F.concat(F.array(tx), _list("input_wallets"), _list("output_wallets")), F.concat(into, out), F.concat(
        F.lit("a participant in a CoinJoin round with "), _value(), F.lit(" participants")
    )


def _risk() -> tuple[Column, Column, Column]:
    return _list("path"), _chain(_list("path")), F.when(_value() == "0", "a known-illicit seed wallet").otherwise(
        F.concat(_value(), F.lit(" hop(s) from a known-illicit seed"))
    )


def _anomaly() -> tuple[Column, Column, Column]:
    z = _value().try_cast("double")
    return _nodes(), _edges(), F.when(
        z > NOTABLE_Z, F.concat(F.lit("a statistical anomaly relative to its population (z-score "), two_digits(z), F.lit(")"))
    )


def _similar() -> tuple[Column, Column, Column]:
    ref = F.col("ev.nearest_reference_id")
    near = F.when(ref.isNotNull(), F.array(ref)).otherwise(_nodes())
    edge = F.when(ref.isNotNull(), F.array(F.struct(F.col("node_id").alias("a"), ref.alias("b")))).otherwise(_edges())
    text = F.concat(
        F.lit("an embedding-similarity near-variant of a confirmed "),
        F.coalesce("ev.pattern_type", F.lit("pattern")),
        F.lit(" instance ("),
        F.coalesce(ref, F.lit("an unspecified reference")),
        F.lit(", cosine similarity "),
        F.coalesce(two_digits(F.col("ev.similarity")), F.lit("an unspecified")),
        F.lit(")")
    )
    return near, edge, text


#: Prefix of the reason code -> builder of (nodes, edges, clause) over node_id, reason_code and ev. The first match counts.
TEMPLATES: dict[str, Callable[[], tuple[Column, Column, Column]]] = {
    "PEEL_CHAIN_HOPS": _peel,
    "COINJOIN_ROUND_N": _coinjoin,
    "SEED_DIST": _risk,
    "ANOMALY_ZSCORE": _anomaly,
    "PATTERN_SIM_PEELING": _similar,
    "PATTERN_SIM_COINJOIN": _similar
}


def register_template(prefix: str, builder: Callable[[], tuple[Column, Column, Column]]) -> None:
    """Add a template, or replace the one of the prefix."""
    TEMPLATES[prefix] = builder


def explained(reasons: DataFrame) -> DataFrame:
    """reasons (node_id, reason_code, evidence_json) with nodes, edges and clause; an unknown code is its own clause."""
    df = reasons.withColumn("ev", F.from_json("evidence_json", EVIDENCE))
    nodes, edges, clause = _nodes(), _edges(), F.col("reason_code")
    for prefix, build in reversed(TEMPLATES.items()):
        n, e, c = build()
        hit = F.col("reason_code").startswith(prefix)
        nodes, edges, clause = F.when(hit, n).otherwise(nodes), F.when(hit, e).otherwise(edges), F.when(hit, c).otherwise(clause)
    return df.select("node_id", "reason_code", nodes.alias("nodes"), edges.alias("edges"), clause.alias("clause"))


def rationale(node: Column, score: Column, clauses: Column) -> Column:
    """The sentence of a node from its clauses, in their order."""
    body = F.when(F.size(clauses) > 0, F.array_join(clauses, "; ")).otherwise("no specific structural signal")
    return F.concat(
        node,
        F.lit(" flagged (confidence "),
        two_digits(score),
        F.lit("). "),
        F.upper(F.substring(body, 1, 1)),
        F.substr(body, F.lit(2)),
        F.lit(".")
    )


def attention_clause(neighbors: Column) -> Column:
    """What the model itself looked at: neighbors is array<struct<weight, node_id>>; null where there are none."""
    top = F.array_max(F.transform(neighbors, lambda n: F.struct(n["weight"].alias("weight"), n["node_id"].alias("node_id"))))
    text = F.concat(
        F.lit("the model's own attention weighted "),
        top["node_id"],
        F.lit(" most heavily among "),
        F.size(neighbors).cast("string"),
        F.lit(" evidence-subgraph neighbors (weight "),
        two_digits(top["weight"]),
        F.lit(")")
    )
    return F.when(F.size(neighbors) > 0, text)
