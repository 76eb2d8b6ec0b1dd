"""Customers linked by shared devices and IP addresses.

Two customers are adjacent if they used the same device or address. A key used by very many
customers (a hub) makes a number of pairs that grows with the square of its users, so pairs are
only written out for keys up to `HUB_CUSTOMERS` users; hubs are kept as memberships and enter
every result through sums over their members. Nothing is left out either way: `adjacency_sum`
gives exactly what the written-out graph would.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.functions.semantics import pair_corr, with_row
from swipesight.functions.stats import welch
from swipesight.session import settle

HUB_CUSTOMERS = 1000
RISK_FACTOR = 10
SAMPLED_SOURCES = 100
KINDS = {"device": "device_fingerprint", "ip": "ip_address"}


def incidence(df: DataFrame) -> DataFrame:
    """Distinct (customer, kind of key, key)."""
    rows = df.where("customer_id IS NOT NULL").selectExpr(
        "customer_id", *[f"{column} AS {kind}" for kind, column in KINDS.items()]
    )
    return rows.unpivot("customer_id", list(KINDS), "kind", "key").where("key IS NOT NULL").distinct()


def shared_keys(uses: DataFrame) -> DataFrame:
    """Memberships of keys with two or more customers, with the number of customers."""
    sizes = uses.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("users")).where("users > 1")
    return uses.join(sizes, ["kind", "key"])


def customer_pairs(members: DataFrame) -> DataFrame:
    """Pairs of customers sharing a key, from keys small enough to write out.

    `members`: (customer_id, kind, key). Weight is the number of shared keys.
    """
    a = members.selectExpr("kind", "key", "customer_id AS src")
    b = members.selectExpr("kind", "key", "customer_id AS dst")
    return a.join(b, ["kind", "key"]).where("src < dst").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("weight"),
        F.expr("bool_or(kind = 'device')").alias("device_shared"),
        F.expr("bool_or(kind = 'ip')").alias("ip_shared"),
    )


@dataclass(frozen=True)
class CustomerGraph:
    """`nodes`: (customer_id, hubs) with the sorted list of the hubs a customer uses, NULL for none.
    `pairs`: customers sharing a small key; `shares_hub` marks those also adjacent through a hub.
    `hub_links`: hub lists that have a hub in common, both directions and with themselves."""

    nodes: DataFrame
    pairs: DataFrame
    hub_links: DataFrame
    has_hubs: bool
    members: DataFrame


def customer_graph(df: DataFrame, hub_customers: int = HUB_CUSTOMERS) -> CustomerGraph:
    uses = incidence(df)
    customers = df.where("customer_id IS NOT NULL").select("customer_id").distinct()
    members = shared_keys(uses)
    small = members.where(F.col("users") <= hub_customers).drop("users")
    hubs = members.where(F.col("users") > hub_customers)
    pairs = customer_pairs(small)
    lists = hubs.groupBy("customer_id").agg(
        F.expr("sort_array(collect_set(concat(kind, ':', key)))").alias("hubs")
    )
    nodes = customers.join(lists, "customer_id", "left")
    a = lists.selectExpr("customer_id AS src", "hubs AS src_hubs")
    b = lists.selectExpr("customer_id AS dst", "hubs AS dst_hubs")
    common = "coalesce(array_intersect(src_hubs, dst_hubs), CAST(array() AS ARRAY<STRING>))"
    pairs = pairs.join(a, "src", "left").join(b, "dst", "left").selectExpr(
        "src", "dst", f"weight + size({common}) AS weight",
        f"device_shared OR exists({common}, h -> startswith(h, 'device:')) AS device_shared",
        f"ip_shared OR exists({common}, h -> startswith(h, 'ip:')) AS ip_shared",
        f"size({common}) > 0 AS shares_hub",
    )
    kinds = lists.select("hubs").distinct().selectExpr("hubs", "explode(hubs) AS hub")
    links = kinds.selectExpr("hub", "hubs AS from_hubs").join(
        kinds.selectExpr("hub", "hubs AS to_hubs"), "hub"
    ).select("from_hubs", "to_hubs").distinct()
    return CustomerGraph(nodes, pairs, links, not hubs.isEmpty(), members)


def customer_links(df: DataFrame, hub_customers: int = HUB_CUSTOMERS) -> DataFrame:
    """The whole link structure: pair rows, and for every hub one row per member with `hub` set."""
    graph = customer_graph(df, hub_customers)
    pairs = graph.pairs.selectExpr("src", "dst", "CAST(NULL AS STRING) AS hub", "weight",
                                   "device_shared", "ip_shared")
    hubs = graph.members.where(F.col("users") > hub_customers).selectExpr(
        "customer_id AS src", "CAST(NULL AS STRING) AS dst", "concat(kind, ':', key) AS hub",
        "users AS weight", "kind = 'device' AS device_shared", "kind = 'ip' AS ip_shared",
    )
    return pairs.unionByName(hubs)


def adjacency_sum(
    graph: CustomerGraph, x: DataFrame, value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """For each customer the sum of `value` over its neighbours: (keys..., customer_id, value).

    `x` has one row per (keys, customer_id); customers without a neighbour in it are left out.
    """
    keys = list(keys)
    own = graph.pairs.where("NOT shares_hub")
    both = own.selectExpr("src AS customer_id", "dst AS other").union(
        own.selectExpr("dst AS customer_id", "src AS other")
    )
    parts = x.select(*keys, "customer_id", value).join(both, "customer_id").select(
        *keys, F.col("other").alias("customer_id"), value
    )
    if graph.has_hubs:
        hubbed = x.select(*keys, "customer_id", value).join(
            graph.nodes.where("hubs IS NOT NULL"), "customer_id"
        )
        totals = hubbed.groupBy(*keys, F.col("hubs").alias("from_hubs")).agg(F.sum(value).alias(value))
        reached = totals.join(graph.hub_links, "from_hubs").groupBy(
            *keys, F.col("to_hubs").alias("hubs")
        ).agg(F.sum(value).alias(value))
        all_members = reached.join(graph.nodes.where("hubs IS NOT NULL"), "hubs").select(
            *keys, "customer_id", value
        )
        self_part = hubbed.select(*keys, "customer_id", (-F.col(value)).alias(value))
        parts = parts.unionByName(all_members).unionByName(self_part)
    return parts.groupBy(*keys, "customer_id").agg(F.sum(value).alias(value))


# --- components ------------------------------------------------------------------------------


def connected_components(members: DataFrame, customers: DataFrame) -> DataFrame:
    """Component of every customer, named by its smallest customer id.

    Works on memberships, so a key's users are never paired. Each round a key takes the smallest
    label of its users, a user the smallest label of its keys, and labels are then followed one
    step further (a label is a customer and has a label itself), which halves long chains.
    """
    uses = settle(members.selectExpr("customer_id", "concat(kind, ':', key) AS key"))
    labels = settle(customers.selectExpr("customer_id", "customer_id AS component"))
    while True:
        by_key = uses.join(labels, "customer_id").groupBy("key").agg(F.min("component").alias("component"))
        seen = uses.join(by_key, "key").groupBy("customer_id").agg(F.min("component").alias("_seen"))
        nearer = labels.join(seen, "customer_id", "left").selectExpr(
            "customer_id", "component AS _old", "least(component, _seen) AS component"
        )
        onward = nearer.selectExpr("customer_id AS component", "component AS _next")
        jumped = nearer.join(onward, "component", "left").selectExpr(
            "customer_id", "least(component, _next) AS component", "_old"
        )
        after = settle(jumped)
        moved = after.where("component <> _old").limit(1).count()
        labels = after.drop("_old")
        if not moved:
            return labels


def components_of_pairs(nodes: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an ordinary edge list: (a, component) with the smallest node as the name."""
    edges = pairs.selectExpr(f"{a} AS x", f"{b} AS y")
    edges = settle(edges.union(edges.selectExpr("y AS x", "x AS y")))
    labels = settle(nodes.selectExpr(f"{a} AS x", f"{a} AS component"))
    while True:
        seen = edges.join(labels, "x").groupBy("y").agg(F.min("component").alias("_seen"))
        nearer = labels.join(seen.withColumnRenamed("y", "x"), "x", "left").selectExpr(
            "x", "component AS _old", "least(component, _seen) AS component"
        )
        onward = nearer.selectExpr("x AS component", "component AS _next")
        after = settle(nearer.join(onward, "component", "left").selectExpr(
            "x", "least(component, _next) AS component", "_old"
        ))
        moved = after.where("component <> _old").limit(1).count()
        labels = after.drop("_old")
        if not moved:
            return labels.withColumnRenamed("x", a)


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("customers"))


def component_summary(components: DataFrame) -> DataFrame:
    return component_sizes(components).agg(
        F.count(F.lit(1)).alias("components"),
        F.min("customers").alias("smallest"),
        F.max("customers").alias("largest"),
        F.avg("customers").alias("mean_size"),
    )


# --- communities -----------------------------------------------------------------------------


def communities(members: DataFrame, customers: DataFrame) -> DataFrame:
    """Communities by label propagation through the shared keys: (customer_id, community).

    Each round a key takes the commonest label of its users (the smallest of equals), and a
    customer the commonest label of its keys; a key shared twice counts twice, as edge weight does.
    Rounds go on while they raise the modularity; the labels of the best round are returned.
    """
    uses = settle(members.selectExpr("customer_id", "concat(kind, ':', key) AS key"))
    labels = settle(customers.selectExpr("customer_id", "customer_id AS community"))
    best, quality = labels, float("-inf")
    while True:
        votes = uses.join(labels, "customer_id").groupBy("key", "community").agg(
            F.count(F.lit(1)).alias("_n")
        )
        by_key = votes.groupBy("key").agg(F.expr("min_by(community, struct(-_n, community))").alias("community"))
        heard = uses.join(by_key, "key").groupBy("customer_id", "community").agg(
            F.count(F.lit(1)).alias("_n")
        )
        chosen = heard.groupBy("customer_id").agg(
            F.expr("min_by(community, struct(-_n, community))").alias("_chosen")
        )
        labels = settle(labels.join(chosen, "customer_id", "left").selectExpr(
            "customer_id", "coalesce(_chosen, community) AS community"
        ))
        found = modularity(members, labels).first().modularity
        if found is None or found <= quality + 1e-12:
            return best
        best, quality = labels, found


def modularity(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of a partition, from counts per key: no pair is formed.

    A key with n users has n(n-1)/2 links; those inside a community follow from its users there.
    """
    inside = members.join(labels, "customer_id").groupBy("kind", "key", "users", "community").agg(
        F.count(F.lit(1)).alias("k")
    ).selectExpr("community", "CAST(k AS DOUBLE) * (k - 1) AS _in", "CAST(k AS DOUBLE) * (users - 1) AS _tot")
    parts = inside.groupBy("community").agg(F.sum("_in").alias("_in"), F.sum("_tot").alias("_tot"))
    return parts.agg(
        F.sum("_in").alias("_in"), F.sum("_tot").alias("_m2"), F.expr("sum(_tot * _tot)").alias("_sq")
    ).selectExpr("try_divide(_in, _m2) - try_divide(_sq, _m2 * _m2) AS modularity")


def customer_fraud(df: DataFrame) -> DataFrame:
    return df.where("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.expr("avg(CAST(is_fraud AS INT))").alias("fraud_rate"),
    )


def group_statistics(labels: DataFrame, fraud: DataFrame, group: str) -> DataFrame:
    """Customers, transactions, fraud and fraud rate of each component or community."""
    return labels.join(fraud, "customer_id").groupBy(group).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("fraud_count").alias("fraud_count"),
        F.sum("transactions").alias("transactions"),
    ).withColumn("fraud_rate", F.expr("try_divide(CAST(fraud_count AS DOUBLE), transactions)"))


def riskiest_groups(stats: DataFrame, group: str, n: int = 5) -> DataFrame:
    return stats.orderBy(F.desc_nulls_last("fraud_rate"), group).limit(n)


def fraud_neighbourhood(labels: DataFrame, fraud: DataFrame, group: str) -> DataFrame:
    """Customers in groups with any fraud against the rest: means, ratio, Welch's t, tenfold test.

    The rest is free of fraud by construction, so its mean is 0 whenever it exists and the ratio is
    then NULL; the comparison says little more than that fraud is grouped.
    """
    members = labels.join(fraud, "customer_id")
    totals = members.groupBy(group).agg(F.sum("fraud_count").alias("_fraud"))
    flagged = members.join(totals, group).selectExpr("fraud_rate", "_fraud > 0 AS near_fraud")
    out = welch(flagged, "fraud_rate", "near_fraud")
    return out.withColumn("goal_met", F.expr(f"coalesce(mean1 >= mean2 * {RISK_FACTOR}, false)"))


# --- centrality ------------------------------------------------------------------------------


def degrees(graph: CustomerGraph) -> DataFrame:
    """Distinct neighbours of every customer and the share of all other customers they make up."""
    ones = graph.nodes.selectExpr("customer_id", "1L AS degree")
    counted = adjacency_sum(graph, ones, "degree")
    total = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    joined = graph.nodes.select("customer_id").join(counted, "customer_id", "left")
    return with_row(joined, total, "_t").selectExpr(
        "customer_id", "coalesce(degree, 0L) AS degree",
        "try_divide(CAST(coalesce(degree, 0L) AS DOUBLE), _t.n - 1) AS degree_centrality",
    )


def betweenness(graph: CustomerGraph, sources: int = SAMPLED_SOURCES) -> DataFrame:
    """Betweenness centrality from sampled sources, scaled to all of them and normalised.

    Breadth-first search from all sources at once, one level per round, counting shortest paths;
    then dependencies are summed back level by level. Sources are the first customers by hash.
    """
    n = graph.nodes.count()
    k = min(sources, n)
    if n < 3:
        return graph.nodes.selectExpr("customer_id", "0D AS betweenness")
    graph = CustomerGraph(
        settle(graph.nodes), settle(graph.pairs), settle(graph.hub_links) if graph.has_hubs else graph.hub_links,
        graph.has_hubs, graph.members,
    )
    picked = graph.nodes.orderBy(F.xxhash64("customer_id"), "customer_id").limit(k)
    start = settle(picked.selectExpr("customer_id AS source", "customer_id", "1D AS paths"))
    levels, visited = [start], start.select("source", "customer_id")
    while True:
        ahead = adjacency_sum(graph, levels[-1], "paths", ["source"])
        fresh = settle(ahead.where("paths > 0.5").join(visited, ["source", "customer_id"], "left_anti"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        # neighbours of a level lie in it or in the two around it: older ones cannot come back
        visited = levels[-2].select("source", "customer_id").union(fresh.select("source", "customer_id"))
    dependency, collected = None, []
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        if dependency is None:
            share = here.selectExpr("source", "customer_id", "1D / paths AS share")
        else:
            share = here.join(dependency, ["source", "customer_id"], "left").selectExpr(
                "source", "customer_id", "(1D + coalesce(dependency, 0D)) / paths AS share"
            )
        back = adjacency_sum(graph, share, "share", ["source"])
        below = levels[depth - 1]
        dependency = settle(back.join(below, ["source", "customer_id"]).selectExpr(
            "source", "customer_id", "paths * share AS dependency"
        ))
        collected.append(dependency)
    scale = n / k / ((n - 1) * (n - 2))
    if not collected:
        return graph.nodes.selectExpr("customer_id", "0D AS betweenness")
    union = collected[0]
    for part in collected[1:]:
        union = union.unionByName(part)
    sums = union.where("source <> customer_id").groupBy("customer_id").agg(F.sum("dependency").alias("_d"))
    return graph.nodes.select("customer_id").join(sums, "customer_id", "left").selectExpr(
        "customer_id", f"coalesce(_d, 0D) * {scale!r}D AS betweenness"
    )


def centrality_fraud(central: DataFrame, fraud: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Correlation of each centrality with the customer's fraud rate: rows (measure, corr)."""
    rows = central.join(fraud.select("customer_id", "fraud_rate"), "customer_id")
    wide = rows.agg(*[pair_corr(F.col(m), F.col("fraud_rate")).alias(m) for m in measures])
    return wide.unpivot([], list(measures), "measure", "corr")


def fraud_trend(central: DataFrame, fraud: DataFrame, measure: str = "degree_centrality") -> DataFrame:
    """Least-squares line of the fraud rate over a centrality."""
    rows = central.join(fraud.select("customer_id", "fraud_rate"), "customer_id")
    x, y = f"CAST({measure} AS DOUBLE)", "fraud_rate"
    slope = f"try_divide(covar_pop({y}, {x}), var_pop({x}))"
    return rows.agg(
        F.expr(slope).alias("slope"), F.expr(f"avg({y}) - {slope} * avg({x})").alias("intercept")
    )


# --- PageRank ----------------------------------------------------------------------------------


def pagerank(
    members: DataFrame, customers: DataFrame, damping: float = 0.85, tolerance: float = 1e-12, most_rounds: int = 500,
) -> DataFrame:
    """Weighted PageRank of the customer graph: (customer_id, pagerank, pagerank_scaled, rounds).

    The weight of two customers is the number of devices and addresses they share, as in `customer_pairs`. With `W(u) = sum
    over v of w(u, v)`, `x = r / W` and `S_k` the sum of x over the members of key k, the flow into v is `sum over its K(v)
    shared keys of (S_k - x(v))`, since `w(u, v)` counts shared keys. So every round is two sums over memberships: no pair of
    customers is formed, hubs included, whatever their size (sums are combined map-side; a hub's rows are split by AQE at the
    join). Customers without a shared key (W = 0) are dangling: their mass is spread evenly. As nothing flows into them, all
    ranks are in proportion to the solution of `(W + d K) x = 1 + d * sum of S_k`, and the factor follows from their number.

    That is solved by Chebyshev rounds. Both sides are symmetric: the rounds' matrix has eigenvalues from 0 to at most the
    largest `d (W + K) / (W + d K)`, here `top`, so an error falls by 0.56 or less in a round (power iteration: 0.85). Each
    round is checkpointed, so a plan holds one round. It ends when the L1 change of the ranks is below `tolerance`, or after
    `most_rounds`. Ranks add up to 1; `pagerank_scaled` is N times the rank. `members`: (customer_id, kind, key, users) as
    `shared_keys` gives.
    """
    spark = members.sparkSession
    held = members.where("users > 1").select("customer_id", "kind", "key", "users")
    own = held.groupBy("customer_id").agg(
        F.sum(F.expr("users - 1")).cast("double").alias("w"), F.count(F.lit(1)).alias("keys")
    )
    nodes = settle(customers.select("customer_id").distinct().join(own, "customer_id", "left").selectExpr(
        "customer_id", "coalesce(w, 0D) AS w", "coalesce(keys, 0L) AS keys"
    ))
    d = damping
    n, lone, top = nodes.agg(
        F.count(F.lit(1)), F.count_if(F.expr("w = 0")), F.max(F.expr(f"IF(w > 0, {d!r}D * (w + keys) / (w + {d!r}D * keys), 0D)"))
    ).first()
    if n == 0:
        return spark.createDataFrame([], "customer_id string, pagerank double, pagerank_scaled double, rounds int")
    factor = (1 - d) / (n - d * lone)  # the rank of a customer without a shared key
    links = settle(held.select("customer_id", F.struct("kind", "key").alias("key")))
    state = nodes.where("w > 0").selectExpr("customer_id", "w", "keys", f"1D / (w * {1 - d!r}D) AS x", "0D AS before")
    gain, sigma, weight, rounds = 2 / (2 - top), top / (2 - top), 1.0, 0
    while rounds < most_rounds and lone < n:
        sums = state.join(links, "customer_id").groupBy("key").agg(F.sum("x").alias("s"))
        inflow = links.join(sums, "key").groupBy("customer_id").agg(F.sum("s").alias("total"))
        step = f"{gain!r}D * ((1D + {d!r}D * total) / (w + {d!r}D * keys) - x)"
        state = settle(state.join(inflow, "customer_id").selectExpr(
            "customer_id", "w", "keys",
            f"{weight!r}D * ({step} + x - before) + before AS x" if rounds else f"{step} + x AS x", "x AS before",
        ))
        rounds += 1
        weight = 1 / (1 - sigma * sigma * weight / (2 if rounds == 1 else 4))
        if factor * state.agg(F.sum(F.expr("w * abs(x - before)"))).first()[0] < tolerance:
            break
    ranks = state.selectExpr("customer_id", f"{factor!r}D * w * x AS r").unionByName(
        nodes.where("w = 0").selectExpr("customer_id", f"{factor!r}D AS r")
    )
    return ranks.selectExpr("customer_id", "r AS pagerank", f"r * {n}D AS pagerank_scaled", f"{rounds} AS rounds")


# --- Louvain -------------------------------------------------------------------------------------


def louvain(members: DataFrame, customers: DataFrame, idle_rounds: int = 3, most_rounds: int = 60) -> DataFrame:
    """Communities by Louvain: (customer_id, community, level), the community named by its smallest customer id.

    The graph is that of `modularity`: customers sharing k keys are linked with weight k. It is never written as pairs.
    A node X of a level is a set of customers, held as memberships (X, key, n) with n its customers among the key's
    users; then `w(X, Y) = sum over keys of n_X n_Y` and a node's degree is the sum of its customers' degrees.

    Local moves: every key proposes its commonest community (the smallest of equals). For a node X and a proposed
    community C the links into C are `sum over keys of X of n_X (N_C - [C = c(X)] n_X)`, with N_C the key's users in C;
    the modularity gain of the move is computed exactly and the best positive one is taken. Conflict rule for moving in
    parallel: nodes move only towards smaller community names in even rounds and larger in odd ones, so that two nodes
    never swap; after a round that was undone, only the nodes whose hash falls in the round's half move. A round whose
    modularity is not higher is undone.
    After `idle_rounds` rounds without a gain the level ends; its communities are contracted into the nodes of the next
    level (memberships summed per key), until a level merges nothing. Each round is checkpointed. Modularity never falls
    between rounds, and results do not depend on the partitioning (all choices are by value and hash).
    """
    links = settle(members.selectExpr("customer_id", "concat(kind, ':', key) AS key", "users"))
    degree = links.groupBy("customer_id").agg(F.sum(F.expr("CAST(users - 1 AS DOUBLE)")).alias("k"))
    people = customers.select("customer_id").distinct()
    two_m = links.agg(F.sum(F.expr("CAST(users - 1 AS DOUBLE)"))).first()[0] or 0.0
    assign = settle(people.selectExpr("customer_id", "customer_id AS node"))
    if two_m == 0:
        return assign.selectExpr("customer_id", "node AS community", "0 AS level")
    m = two_m / 2
    held = settle(links.selectExpr("customer_id AS node", "key", "1L AS n"))
    nodes = settle(people.join(degree, "customer_id", "left").selectExpr("customer_id AS node", "coalesce(k, 0D) AS k", "customer_id AS c"))
    quality = _modularity_of(links, assign, nodes)
    level, rounds = 0, 0
    while True:
        idle, moved_any = 0, False
        while idle < idle_rounds and rounds < most_rounds:
            rounds += 1
            tried = settle(_move(held, nodes, m, two_m, rounds, half=idle > 0))
            found = _modularity_of(links, assign, tried)
            if found > quality + 1e-12:
                nodes, quality, idle, moved_any = tried, found, 0, True
            else:
                idle += 1
        if not moved_any or rounds >= most_rounds:
            break
        level += 1
        assign = settle(assign.join(nodes.select("node", "c"), "node").selectExpr("customer_id", "c AS node"))
        held = settle(held.join(nodes.select("node", "c"), "node").groupBy("c", "key").agg(F.sum("n").alias("n")).withColumnRenamed("c", "node"))
        nodes = settle(nodes.groupBy("c").agg(F.sum("k").alias("k")).selectExpr("c AS node", "k", "c"))
    named = assign.join(nodes.select("node", "c"), "node").selectExpr("customer_id", "c AS community")
    smallest = named.groupBy("community").agg(F.min("customer_id").alias("_name"))
    return named.join(smallest, "community").selectExpr("customer_id", "_name AS community", f"{level} AS level")


def _move(held: DataFrame, nodes: DataFrame, m: float, two_m: float, round_: int, half: bool) -> DataFrame:
    """One round of parallel local moves under the conflict rule: (node, k, c)."""
    placed = held.join(nodes.select("node", "c"), "node")
    per_key = placed.groupBy("key", "c").agg(F.sum("n").alias("big_n"))
    proposal = per_key.groupBy("key").agg(F.expr("min_by(c, struct(-big_n, c))").alias("cand"))
    totals = nodes.groupBy("c").agg(F.sum("k").alias("tot"))
    direction = "cand < c" if round_ % 2 == 0 else "cand > c"
    mover = f"pmod(xxhash64(node, {round_}), 2) = 0" if half else "true"
    cands = placed.join(proposal, "key").where(f"{mover} AND {direction}").select("node", "cand").distinct()
    # Links of each moving node into its own and into each proposed community, over its keys.
    own = placed.join(per_key, ["key", "c"]).groupBy("node").agg(F.sum(F.expr("n * (big_n - n)")).alias("k_own"))
    into = cands.join(held, "node").join(per_key.withColumnRenamed("c", "cand"), ["key", "cand"]).groupBy("node", "cand").agg(
        F.sum(F.expr("n * big_n")).alias("k_in")
    )
    scored = (
        into.join(nodes, "node").join(own, "node", "left")
        .join(totals.withColumnRenamed("c", "cand").withColumnRenamed("tot", "tot_cand"), "cand")
        .join(totals.withColumnRenamed("tot", "tot_own"), "c")
        .selectExpr(
            "node", "cand",
            f"(k_in - coalesce(k_own, 0D)) / {m!r}D - k * (tot_cand - tot_own + k) / {two_m * two_m / 2!r}D AS gain",
        )
        .where("gain > 1e-12")
    )
    best = scored.groupBy("node").agg(F.expr("min_by(cand, struct(-gain, cand))").alias("_to"))
    return nodes.join(best, "node", "left").selectExpr("node", "k", "coalesce(_to, c) AS c")


def _modularity_of(links: DataFrame, assign: DataFrame, nodes: DataFrame) -> float:
    labels = assign.join(nodes.select("node", "c"), "node").selectExpr("customer_id", "c AS community")
    members = links.selectExpr("customer_id", "'k' AS kind", "key", "users")
    return modularity(members, labels).first().modularity or 0.0
