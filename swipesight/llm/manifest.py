"""Merkle manifest of a table of documents, built level by level with sibling-shift self-joins.

Every row is a leaf: `H(enc(doc_id) enc(source) enc(lang) enc(n_chars) enc(text))`, where H is lowercase hex SHA-256 and
`enc(v)` is `-` for null, else the UTF-8 byte count of v's decimal or text form, `:`, and that form. Per source the leaves
ascend by doc_id (null last; equal doc_ids by leaf). While a source has several nodes, every `ARITY` consecutive ones (the
last run may be shorter, even one) become H of their digests concatenated; what remains is the source's subroot (a lone
leaf stays itself). Subroots, ordered by source (null first, then UTF-8 bytewise), give the root the same way.

How a level is built: a node at index i has slot `i mod ARITY`; its run starts at `i - slot`. The slot-zero rows are joined
with all nodes on (source, run start), an equijoin on computed sibling indices, and each slot-zero row emits the parent
`H(run)` at index `i div ARITY`. A run has at most `ARITY` nodes, so no group is large however large a source is. Row
numbers come from running totals dealt out by range (`ranks.running_totals`), so a hot source is spread over many tasks.

Every node also keeps its left and right siblings (`left`, `right`: their digests concatenated). These steps are carried
down from the top, parent to children by the same kind of join, so a leaf ends with its whole path. From it:
`proof_sha256` is H of all siblings, level by level up to the root, left to right; `fold(path, leaf)` recomputes the root,
which is how a changed leaf is told from the original.

Corner cases: an empty table gives no rows. Null values are `-` in the leaf. Repeated rows are separate leaves with equal
digests; their order among themselves changes nothing. Extra columns are ignored (only the five named ones are read).
Texts of any length are hashed whole. Levels are checkpointed in `spark.checkpoint.dir`, so a lost executor redoes one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.functions.ranks import running_totals
from swipesight.session import settle

ARITY = 16


def _enc(value: str) -> str:
    return f"IF({value} IS NULL, '-', concat(CAST(octet_length({value}) AS STRING), ':', {value}))"


def leaf_sql(text: str = "text") -> str:
    """SQL of a leaf's digest over doc_id, source, lang, n_chars and the given text expression."""
    parts = [_enc("CAST(doc_id AS STRING)"), _enc("source"), _enc("lang"), _enc("CAST(n_chars AS STRING)"), _enc(text)]
    return f"sha2(concat({', '.join(parts)}), 256)"


def _number(nodes: DataFrame, group: str, order: str) -> DataFrame:
    """Index from 0 within `group` by `order` (distinct per row), and the node count of the group."""
    counted = running_totals(nodes.withColumn("_one", F.lit(1)), order, ["_one"], by=[group])
    return counted.withColumn("idx", F.expr("_one_through - 1")).withColumn("count", F.col("_one_all")).drop(
        "_one", "_one_through", "_one_all"
    )


def _runs(nodes: DataFrame, group: str, arity: int, extras: tuple[str, ...] = ()) -> DataFrame:
    """Runs of the groups that still have several nodes: the slot-zero rows joined with their siblings by computed index."""
    active = nodes.where("count > 1").selectExpr(
        group, "hash", "count", *extras, f"pmod(idx, {arity}) AS slot", f"idx - pmod(idx, {arity}) AS base"
    )
    zero = active.where("slot = 0").selectExpr(group, "base", "count")
    siblings = active.select(group, "base", "slot", "hash", *extras)
    fields = ", ".join(["slot", "hash", *extras])
    return (
        zero.join(siblings, [group, "base"])
        .groupBy(group, "base", "count")
        .agg(F.expr(f"array_sort(collect_list(struct({fields})))").alias("members"))
    )


def _parents(runs: DataFrame, group: str, arity: int) -> DataFrame:
    return runs.selectExpr(
        group, f"base div {arity} AS idx", "sha2(array_join(members.hash, ''), 256) AS hash",
        f"CAST(ceil(count / {arity}) AS BIGINT) AS count",
    )


_STEP = (
    "named_struct('left', array_join(slice(members.hash, 1, m.slot), ''), "
    "'right', array_join(slice(members.hash, m.slot + 2, size(members)), '')) AS step"
)
_EMPTY = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"


def _paths(nodes: DataFrame, group: str, arity: int, extras: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(group, hash, extras..., path) for every node given, and (group, top) for the node each group ends with.

    `nodes` holds group, idx, hash, count (nodes in its group) and extras. Paths of the levels above the first are built
    top-down on tables of a sixteenth of the rows and less; the first level's runs are joined to them before they are
    taken apart, so that whole paths of the nodes given are never shuffled or written.
    """
    most = nodes.agg(F.max("count")).first()[0] or 0
    tops = [nodes.where("count = 1").selectExpr(group, "hash AS top")]
    single = nodes.where("count = 1").selectExpr(group, "hash", *extras, f"{_EMPTY} AS path")
    if most <= 1:
        return single, tops[0]
    first = settle(_runs(nodes, group, arity, extras))
    level, steps = settle(_parents(first, group, arity)), []
    tops.append(level.where("count = 1").selectExpr(group, "hash AS top"))
    most = -(-most // arity)
    while most > 1:
        runs = _runs(level, group, arity)
        steps.append(runs.selectExpr(group, "base", "explode(members) AS m", "members").selectExpr(group, "base + m.slot AS idx", _STEP))
        level = settle(_parents(runs, group, arity))
        tops.append(level.where("count = 1").selectExpr(group, "hash AS top"))
        most = -(-most // arity)
    path = None  # of the nodes of the level above the one at hand
    for here in reversed(steps):
        if path is not None:
            up = path.selectExpr(f"{group} AS _g", "idx AS _up", "path AS _path")
            here = here.join(up, (here[group] == up["_g"]) & (F.expr(f"idx div {arity}") == up["_up"]), "left")
            here = here.selectExpr(group, "idx", f"concat(array(step), coalesce(_path, {_EMPTY})) AS path")
        else:
            here = here.selectExpr(group, "idx", "array(step) AS path")
        path = settle(here)
    if path is not None:
        up = path.selectExpr(f"{group} AS _g", "idx AS _up", "path AS _path")
        first = first.join(up, (first[group] == up["_g"]) & (F.expr(f"base div {arity}") == up["_up"]), "left")
    else:
        first = first.withColumn("_path", F.expr(_EMPTY))
    nodes_out = first.selectExpr(group, "explode(members) AS m", "members", "_path").selectExpr(
        group, "m.hash AS hash", *[f"m.{e} AS {e}" for e in extras], f"concat(array({_STEP.rsplit(' AS ', 1)[0]}), coalesce(_path, {_EMPTY})) AS path"
    )
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return nodes_out.unionByName(single), top


def manifest(docs: DataFrame, arity: int = ARITY, tamper: str = "pmod(crc32(CAST(doc_id AS STRING)), 5) = 0") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Where `tamper` holds (null: no), the text's A-Z are lower-cased before the leaf is folded with its original siblings
    into `folded_root`; `verified` tells whether that equals `root`. Rows in no particular order.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = f"IF(coalesce({tamper}, false), translate(text, '{upper}', '{lower}'), text)"
    leaves = docs.selectExpr(
        "IF(source IS NULL, '', concat('s', source)) AS _grp",
        f"struct(doc_id IS NULL AS null_id, doc_id, {leaf_sql()} AS hash, monotonically_increasing_id() AS row) AS _key",
        f"{leaf_sql(changed)} AS changed",
    )
    numbered = _number(leaves, "_grp", "_key").selectExpr("_grp", "idx", "count", "_key.hash AS hash", "_key.doc_id AS doc_id", "changed")
    leaf_paths, subroots = _paths(numbered, "_grp", arity, ("doc_id", "changed"))
    ordered = _number(subroots.withColumn("_top", F.lit(0)), "_top", "_grp").selectExpr("_top", "idx", "count", "top AS hash", "_grp")
    top_paths, root = _paths(ordered, "_top", arity, ("_grp",))
    # One row: the root.
    per_source = top_paths.join(F.broadcast(root.selectExpr("_top", "top AS root")), "_top").selectExpr(
        "_grp", "hash AS subroot", "path AS top_path", "root"
    )
    joined = leaf_paths.join(per_source, "_grp")
    full = "concat(path, top_path)"
    return joined.selectExpr(
        "doc_id",
        "hash AS leaf",
        "subroot",
        "root",
        f"sha2(aggregate({full}, '', (acc, s) -> concat(acc, s.left, s.right)), 256) AS proof_sha256",
        f"aggregate({full}, changed, (acc, s) -> sha2(concat(s.left, acc, s.right), 256)) AS folded_root",
    ).withColumn("verified", F.expr("folded_root = root"))
