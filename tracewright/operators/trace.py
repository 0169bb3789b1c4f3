"""Graph trace: bounded expansion, exact depth-first hops, lineage, chronology, insights.

hops have query_id, hop_index, parent_hop_index, source_type, source, ts,
method ("semantic" or "edge"), edge_type, confidence.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import BROADCAST_ROWS, checkpointed, importable, sized, tasks
from . import retrieval as R

MAX_HOPS, MAX_TOTAL = 3, 15
#: Rows of the groups that one task walks.
WALK_ROWS = 100_000


def reachable(seeds: DataFrame, edges: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(query_id, node, depth): nodes within ``hops`` steps along (node, other), with their least depth.

    One join a level; a level holds only nodes that were not reached before.
    """
    seen = seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0))
    level = seen
    for d in range(1, hops + 1):
        step = level.select("query_id", "node").join(edges.select("node", "other"), "node").select("query_id", F.col("other").alias("node")).distinct()
        level = step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(level)
    return seen


def _within(starts: DataFrame, edges: DataFrame, hops: int, fan: int) -> tuple[DataFrame, int]:
    """(query_id, node, other, type, direction, seq and the other columns of ``edges``), and how many rows, starts included: what a walk from each query's starts may take.

    A walk of at most ``fan / 2`` hops meets at most as many visited targets
    at a node as it has hops and takes at most as many new ones, so the first
    ``fan`` distinct targets of a node are all that it can use, each by its
    first edge. Only edges of nodes that were reached are looked at, and a
    large front is hashed, so that no edge of others is sorted. What is
    sorted is dealt by its count; a hub's targets are dealt too, and
    ``fan`` of each part meet.
    """
    keys = ["type", "direction", *(c for c in edges.columns if c not in ("node", "other", "type", "direction", "seq"))]
    level = seen = checkpointed(starts.select("query_id", "node").distinct())
    met = reached = last = level.count()
    many, out = edges.count(), None
    deals = tasks(many)
    for hop in range(1, hops + 1):
        front = checkpointed(level.select("node").distinct())
        small = front.count() <= BROADCAST_ROWS
        found = edges.join(front.hint("broadcast" if small else "shuffle_hash"), "node", "left_semi")
        found = found.withColumn("part", F.pmod(F.xxhash64("other"), F.lit(deals))).repartition(deals, "node", "part")
        first = found.groupBy("node", "part", "other").agg(F.min(F.struct("seq", *keys)).alias("e"))
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("e", "other"))
        n = tasks(many + last)
        first = first.withColumn("r", place("node", "part")).where(F.col("r") <= fan).drop("part", "r").repartition(n, "node")
        first = first.withColumn("r", place("node")).where(F.col("r") <= fan)
        step = checkpointed(level.repartition(n, "node").join(first, "node").select("query_id", "node", "other", *(f"e.{k}" for k in keys), "e.seq"))
        count = step.count()
        out, met = step if out is None else out.unionByName(step), met + count
        if hop < hops:
            n = tasks(count + reached)
            ends = step.select("query_id", F.col("other").alias("node")).repartition(n, "query_id", "node").distinct()
            level = checkpointed(ends.join(seen.repartition(n, "query_id", "node"), ["query_id", "node"], "left_anti"))
            last = level.count()
            seen, reached = seen.unionByName(level), reached + last
    return out, met


def _walk(starts: list[tuple], out: dict, max_hops: int, max_total: int) -> tuple[list[tuple], set]:
    """Hops (node, parent, edge or None, score or None) in depth-first order and the visited nodes; ``starts`` are (node, score), ``out`` lists (other, edge) by node."""
    hops: list[tuple] = []
    visited: set = set()
    for start, score in starts:
        if len(hops) >= max_total:
            break
        if start in visited:
            continue
        visited.add(start)
        hops.append((start, -1, None, score))
        stack = [(len(hops) - 1, 0, iter(out.get(start, ())))]
        while stack:
            parent, depth, rest = stack[-1]
            if depth >= max_hops or len(hops) >= max_total:
                stack.pop()
                continue
            found = next(rest, None)
            if found is None:
                stack.pop()
            elif found[0] not in visited:
                visited.add(found[0])
                hops.append((found[0], parent, found[1], None))
                stack.append((len(hops) - 1, depth + 1, iter(out.get(found[0], ()))))
    return hops, visited


def depth_first(seeds: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, max_total: int = MAX_TOTAL) -> DataFrame:
    """The exact depth-first hops of each query: seeds (query_id, node, ord), edges (node, other, type, direction, seq).

    Visited nodes are shared by a query's seeds; edges go in order of
    ``seq``; a query stops at ``max_total`` hops, seeds included. A group
    holds what one query's walk may take, which no hub can swell.
    """
    within, met = _within(seeds, edges, max_hops, 2 * max_total)
    none = lambda c: F.lit(None).cast("string").alias(c)
    starts = seeds.select("query_id", "node", none("other"), none("type"), none("direction"), F.col("ord").alias("seq"), F.lit(0).alias("kind"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "seq", "other"], kind="stable")
        out: dict[str, list] = {}
        for r in rows[rows.kind == 1].itertuples(index=False):
            out.setdefault(r.node, []).append((r.other, (r.type, r.direction)))
        hops, _ = _walk([(n, None) for n in rows[rows.kind == 0].node], out, max_hops, max_total)
        frame = pd.DataFrame([(n, p, "edge" if e else "semantic", *(e or (None, None))) for n, p, e, _ in hops], columns=["node", "parent_hop_index", "method", "edge_type", "direction"])
        frame.insert(0, "hop_index", range(len(frame)))
        frame.insert(0, "query_id", rows.query_id.iloc[0])
        return frame

    importable(seeds.sparkSession)
    schema = "query_id long, hop_index int, node string, parent_hop_index int, method string, edge_type string, direction string"
    rows = within.withColumn("kind", F.lit(1)).select(starts.columns).unionByName(starts)
    return rows.repartition(tasks(met, WALK_ROWS), "query_id").groupBy("query_id").applyInPandas(walk, schema)


def trace(
    queries: DataFrame, chunks: DataFrame, edges: DataFrame, max_per_source: int = 3, max_total: int = MAX_TOTAL, max_hops: int = MAX_HOPS, min_score: float = 0.3,
    include: list[str] | None = None, exclude: list[str] | None = None, type_boosts: dict[str, float] | None = None, diverse: bool = False,
) -> DataFrame:
    """The hops of a batch of queries: seeds by similarity, edges depth first, then the types that are still short.

    queries: query_id, vector; chunks: id, ord, embedding, source_type,
    source, ts; edges between chunk ids: node, other, type, direction, seq,
    evidence, confidence. Boosts and diversity widen the candidates five
    times and only reorder. An include list, even an empty one, decides alone
    what seeds and edges may reach; the types that are filled up at the end,
    in order of their first chunk, are not filtered. ``grouped`` marks the
    first ``max_per_source`` hops of each type. A group holds one query's
    candidates and what its walk may take: parameters bound both.
    """
    width = max_total * (5 if type_boosts or diverse else 1)
    near = R.top_k(queries, chunks.select("id", "embedding", "source_type"), max(width, max_per_source + max_total))
    near = checkpointed(near.withColumn("source_type", F.coalesce("source_type", F.lit("unknown"))))
    seeds = near.where(F.col("rank") <= width).withColumn("retrieval", R.composite(F.col("score"), None, type_boosts, F.col("source_type"))).drop("rank")
    seeds = seeds.withColumn("score", F.col("retrieval"))
    seeds = R.diversified(seeds, max_total) if diverse else R.ranked(seeds, max_total)
    allowed = lambda c: R.trace_allowed(c, include, exclude)
    seeds = checkpointed(seeds.where((F.col("score") >= min_score) & allowed(F.col("source_type"))).select("query_id", F.col("id").alias("node"), "rank", "score", "source_type"))
    kinds = chunks.select(F.col("id").alias("other"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"))
    if include is not None or exclude:
        edges = edges.join(kinds.where(allowed(F.col("source_type"))).select("other"), "other", "left_semi")
    within, met = _within(seeds, edges, max_hops, 2 * max_total)
    within = within.join(kinds, "other")
    columns = ["query_id", "kind", "place", "node", "other", "source_type", "type", "direction", "evidence", "score"]

    def shaped(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        none = {"node": "long", "other": "long", "source_type": "string", "type": "string", "direction": "string", "evidence": "string", "score": "double", "place": "long"}
        empty = {c: F.lit(None).cast(t) for c, t in none.items() if c not in given and c not in df.columns}
        return df.withColumns({"kind": F.lit(kind), **given, **empty}).select("query_id", "kind", F.col("place").cast("long").alias("place"), *columns[3:])

    order = chunks.groupBy(F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.min("ord").alias("place"))
    parts = [
        shaped(seeds, 0, place=F.col("rank")),
        shaped(within, 1, place=F.col("seq"), score=F.col("confidence")),
        shaped(near.where(F.col("rank") <= max_per_source + max_total), 2, place=F.col("rank"), node=F.col("id")),
        shaped(queries.select("query_id").crossJoin(sized(order, limit=10_000)), 3),
    ]
    rows = reduce(DataFrame.unionByName, parts)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "place", "node", "other"], kind="stable")
        part = {k: list(g.itertuples(index=False)) for k, g in rows.groupby("kind")}
        kind_of, out = {}, {}
        for r in part.get(0, ()):
            kind_of[r.node] = r.source_type
        for r in part.get(1, ()):
            kind_of[r.other] = r.source_type
            out.setdefault(r.node, []).append((r.other, (r.type, r.direction, r.evidence, r.score)))
        hops, visited = _walk([(r.node, r.score) for r in part.get(0, ())], out, max_hops, max_total)
        found = Counter(kind_of[h[0]] for h in hops)
        for t in part.get(3, ()):
            if len(hops) >= max_total:
                break
            if found[t.source_type] >= max_per_source:
                continue
            most = max_per_source - found[t.source_type] + len(visited)
            for c in [c for c in part.get(2, ()) if c.place <= most]:
                if len(hops) >= max_total or found[t.source_type] >= max_per_source:
                    break
                if c.score >= min_score and c.node not in visited and c.source_type == t.source_type:
                    visited.add(c.node)
                    kind_of[c.node] = c.source_type
                    hops.append((c.node, -1, None, c.score))
                    found[c.source_type] += 1
        made, count = [], Counter()
        for i, (node, parent, edge, score) in enumerate(hops):
            kind = kind_of[node]
            made.append((rows.query_id.iloc[0], i, int(node), parent, "edge" if edge else "semantic", edge[0] if edge else None, edge[1] if edge else None, edge[2] if edge else None, edge[3] if edge else score, kind, count[kind] < max_per_source))
            count[kind] += 1
        return pd.DataFrame(made, columns=["query_id", "hop_index", "node", "parent_hop_index", "method", "edge_type", "direction", "evidence", "confidence", "source_type", "grouped"])

    importable(chunks.sparkSession)
    hops = rows.repartition(tasks(met + near.count(), WALK_ROWS), "query_id").groupBy("query_id").applyInPandas(run, "query_id long, hop_index int, node long, parent_hop_index int, method string, edge_type string, direction string, evidence string, confidence double, source_type string, grouped boolean")
    return hops.join(chunks.select(F.col("id").alias("node"), "source", "ts"), "node")


def insights(hops: DataFrame, since: Column) -> DataFrame:
    """(query_id, place, kind, detail, strength): convergence, evidence chains and temporal clusters of each trace, the strongest first.

    ``since`` is where the recent days begin. Ties stay in that order of kinds.
    """
    from .upkeep import evidence_chains

    types = hops.groupBy("query_id").agg(F.array_sort(F.collect_set("source_type")).alias("types"))
    one = types.select("query_id", F.lit(0).alias("n"), F.lit("convergence").alias("kind"), F.array_join("types", ",").alias("detail"), convergence(F.size("types")).alias("strength"))
    chains = evidence_chains(lineage(hops)).select("query_id", F.lit(1).alias("n"), F.lit("evidence-chain").alias("kind"), F.col("label").alias("detail"), "strength")
    dated = hops.groupBy("query_id").agg(F.count("ts").alias("dated"), F.count_if(F.col("ts") >= since).alias("recent"))
    near = dated.select("query_id", F.lit(2).alias("n"), F.lit("temporal-cluster").alias("kind"), F.concat_ws("/", "recent", "dated").alias("detail"), recency(F.col("dated"), F.col("recent")).alias("strength"))
    every = one.unionByName(chains).unionByName(near).where("strength is not null")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("strength").desc(), "n", "detail"))
    return every.withColumn("place", place).drop("n")


def ranked_chains(chains: DataFrame) -> DataFrame:
    """Lineage chains with their ``place``: the longest first, then the most varied, then in order of their leaves."""
    best = Window.partitionBy("query_id").orderBy(F.col("length").desc(), F.col("variety").desc(), "leaf")
    return chains.withColumn("place", F.row_number().over(best))


def chronological(hops: DataFrame) -> DataFrame:
    """``chrono`` from 0: by time, ties and undated rows in traversal order, undated last."""
    w = Window.partitionBy("query_id").orderBy(F.col("ts").asc_nulls_last(), "hop_index")
    return hops.withColumn("chrono", F.row_number().over(w) - 1)


def lineage(hops: DataFrame) -> DataFrame:
    """Every root-to-leaf path: (query_id, leaf, path, types, length, variety), types without consecutive repeats.

    A trace's hops fit in one row, and the climb to the root is a fold of as
    many steps as it has hops.
    """
    hop = F.struct(F.col("hop_index").cast("int").alias("i"), F.col("parent_hop_index").cast("int").alias("up"), F.col("source_type").alias("kind"))
    traces = hops.groupBy("query_id").agg(F.array_sort(F.collect_list(hop)).alias("hops"))
    known = F.map_from_entries(F.transform("hops", lambda h: F.struct(h["i"], h)))
    leaves = F.filter("hops", lambda h: ~F.exists("hops", lambda c: c["up"] == h["i"]))
    rows = traces.select("query_id", known.alias("known"), F.explode(leaves).alias("end"))
    start = F.struct(F.array(F.col("end")).alias("path"), F.col("end.up").alias("up"))
    above = lambda x: F.get(F.transform(F.array(F.element_at("known", x["up"])), lambda h: F.struct(F.concat(F.array(h), x["path"]).alias("path"), h["up"].alias("up"))), F.lit(0))
    climbed = F.aggregate(F.sequence(F.lit(1), F.size("known")), start, lambda x, _: F.when(x["up"] < 0, x).otherwise(above(x)), lambda x: x["path"])
    paths = rows.select("query_id", F.col("end.i").alias("leaf"), climbed.alias("hops"))
    paths = paths.select("query_id", "leaf", F.transform("hops", lambda h: h["i"]).alias("path"), F.transform("hops", lambda h: h["kind"]).alias("all"))
    runs = F.filter("all", lambda t, i: (i == 0) | (t != F.get("all", i - 1)))
    return paths.select("query_id", "leaf", "path", runs.alias("types"), F.size("path").alias("length"), F.size(F.array_distinct("all")).alias("variety"))


def convergence(kinds: Column) -> Column:
    """Strength of a convergence of so many source types; null under three."""
    return F.when(kinds >= 3, F.least(0.5 + 0.1 * kinds, F.lit(1.0)))


def recency(dated: Column, recent: Column) -> Column:
    """Strength of a temporal cluster; null unless two are dated, two recent, and half of the dated are recent."""
    ratio = recent / F.nullif(dated, F.lit(0))
    return F.when((dated >= 2) & (recent >= 2) & (ratio >= 0.5), F.least(0.4 + 0.5 * ratio, F.lit(1.0)))


def conclusion(hops: DataFrame) -> DataFrame:
    """(query_id, role, hop_index): the primary root (surest, first on ties), candidate fixes, and next reads (leaves)."""
    w = Window.partitionBy("query_id").orderBy(F.col("confidence").desc_nulls_last(), "hop_index")
    primary = hops.where("parent_hop_index < 0").withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.lit("primary").alias("role"), "hop_index")
    fixes = hops.where(F.col("edge_type").isin("closes", "addresses")).select("query_id", F.lit("fix").alias("role"), "hop_index")
    inner = hops.where("parent_hop_index >= 0").select("query_id", F.col("parent_hop_index").alias("hop_index")).distinct()
    leaves = hops.where("parent_hop_index >= 0").join(inner, ["query_id", "hop_index"], "left_anti").select("query_id", F.lit("next").alias("role"), "hop_index")
    return primary.unionByName(fixes).unionByName(leaves)


def display_links(hops: DataFrame) -> DataFrame:
    """Each edge hop to the next later edge hop of another source; a semantic hop to the first edge hop of its type."""
    edge = hops.where("method = 'edge'").select("query_id", F.col("hop_index").alias("to"), F.col("source").alias("to_source"), F.col("source_type").alias("to_type"))
    later = hops.where("method = 'edge'").join(edge, "query_id").where("to > hop_index and to_source <> source").groupBy("query_id", "hop_index").agg(F.min("to").alias("to"))
    same = hops.where("method = 'semantic'").join(edge, "query_id").where("to_type = source_type").groupBy("query_id", "hop_index").agg(F.min("to").alias("to"))
    return later.unionByName(same)


def dotted(symbols: DataFrame) -> DataFrame:
    """(doc, i, path) of symbols (doc, i, parent, name): names from the root (parent 0) down, joined by dots.

    Each round joins every open path with the path above it, so paths double
    and a tree of any depth takes the logarithm of it in rounds. A symbol
    whose ancestors are not all there, or go round in a circle, has no path.
    """
    done = symbols.where("parent = 0").select("doc", "i", F.col("name").alias("path"))
    open_ = checkpointed(symbols.where("parent <> 0").select("doc", "i", F.col("parent").alias("up"), F.col("name").alias("path")))
    left = open_.count()
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        above = done.select("doc", F.col("i").alias("up"), F.col("path").alias("above"))
        ended = checkpointed(open_.join(above, ["doc", "up"]).select("doc", "i", F.concat_ws(".", "above", "path").alias("path")))
        higher = open_.select("doc", F.col("i").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        open_ = checkpointed(open_.join(ended.select("doc", "i"), ["doc", "i"], "left_anti").join(higher, ["doc", "up"]).select("doc", "i", F.col("next").alias("up"), F.concat_ws(".", "above", "path").alias("path")))
        done, left = done.unionByName(ended), open_.count()
    return done
