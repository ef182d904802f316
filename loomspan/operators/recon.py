"""Record reconciliation: decide, order, cluster, respect must-not-link, merge properties, rewrite, emit, measure.

candidates (g, pos, u, v, score), must_not_link (g, a, b), attributes (g, node, key, value), canon (g, v, canonical),
edges (g, u, v[, w]); g tells independent cases apart. A null score is never accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.fixpoint import components
from loomspan.operators.graph import _value, symmetric
from loomspan.operators.kernels import by_group
from loomspan.session import written
from loomspan.u24 import wrap

# --- decide -------------------------------------------------------------------------------------------


def accepted(candidates: DataFrame, tau: int) -> DataFrame:
    """Rows with score >= tau, repeats kept."""
    return candidates.where(F.col("score") >= tau)


def normalised(candidates: DataFrame) -> DataFrame:
    """(g, u, v, score), u < v: the highest score of each pair in either direction."""
    return candidates.where("score is not null and u <> v").groupBy("g", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("score").alias("score"))


def drop_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Without the pairs that known (g, u, v) holds just so."""
    return candidates.join(known.select("g", "u", "v"), ["g", "u", "v"], "left_anti")


def processing_order(candidates: DataFrame, tau: int) -> DataFrame:
    """Accepted rows with their place `ord` from 0: by score descending, then u, v; equal ones by pos."""
    place = Window.partitionBy("g").orderBy(F.desc("score"), "u", "v", "pos")
    return accepted(candidates, tau).withColumn("ord", (F.row_number().over(place) - 1).cast("bigint"))


def staged(candidates: DataFrame, tau: int, cap: int) -> DataFrame:
    """(g, ord, u, v): the first cap accepted rows."""
    return processing_order(candidates, tau).where(F.col("ord") < cap).select("g", "ord", "u", "v")


def deferred(ids: DataFrame, candidates: DataFrame, tau: int, cap: int) -> DataFrame:
    n = accepted(candidates, tau).groupBy("g").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("value"))
    return _value(ids, n)


def singleton(probs: DataFrame, tau: Column, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """(keys..., value) for probs (keys..., i, p): the first of the most probable i if it reaches tau alone, else 6."""
    best = probs.groupBy(*keys).agg(F.max("p").alias("p"), F.max_by("i", F.struct("p", -F.col("i"))).alias("i"))
    return best.select(*keys, F.when(F.col("p") >= tau, F.col("i")).otherwise(F.lit(6)).cast("bigint").alias("value"))


def stage_once(proposals: DataFrame, ledger: DataFrame) -> DataFrame:
    """(g, pos, verb, target): first occurrences that no staged or applied entry (status 0 or 1) of ledger blocks."""
    fresh = proposals.join(ledger.where("status in (0, 1)").select("g", "verb", "target"), ["g", "verb", "target"], "left_anti")
    return fresh.groupBy("g", "verb", "target").agg(F.min("pos").alias("pos")).select("g", "pos", "verb", "target")


# --- cluster ------------------------------------------------------------------------------------------


def canonical(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, v, canonical): largest id of each node's cluster."""
    return components(nodes, pairs, largest=True).withColumnRenamed("label", "canonical")


def sizes(canon: DataFrame) -> DataFrame:
    """(g, canonical, n)."""
    return canon.groupBy("g", "canonical").agg(F.count(F.lit(1)).alias("n"))


def cluster_statistics(size: DataFrame) -> DataFrame:
    """Per case: clusters, the largest, singletons, pairs within clusters, clusters of at least 3."""
    n = F.col("n")
    return size.groupBy("g").agg(F.count(F.lit(1)).alias("clusters"), F.max(n).alias("largest"), F.count_if(n == 1).alias("singletons"), F.sum(F.expr("n * (n - 1) div 2")).alias("closure_pairs"), F.count_if(n >= 3).alias("ge3"), (F.sum(n) - F.count(F.lit(1))).alias("merges"))


def size_histogram(size: DataFrame) -> DataFrame:
    """(g, bucket 1..8, value): clusters by size, 8 for all larger ones."""
    buckets = size.select("g").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(8))))
    counts = size.groupBy("g", F.least("n", F.lit(8)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("value"))
    return buckets.join(counts, ["g", "bucket"], "left").fillna(0, ["value"])


def implied_unproposed(size: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs within clusters that no candidate proposed."""
    known = pairs.select("g", "u", "v").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    return cluster_statistics(size).join(known, "g", "left").select("g", (F.col("closure_pairs") - F.coalesce("m", F.lit(0))).alias("value"))


def cluster_lists(canon: DataFrame) -> DataFrame:
    """(g, pos, members): members ascending, clusters by their least member. A list holds a whole cluster."""
    lists = canon.groupBy("g", "canonical").agg(F.array_sort(F.collect_list("v")).alias("members"))
    return lists.select("g", (F.row_number().over(Window.partitionBy("g").orderBy(F.col("members")[0])) - 1).cast("bigint").alias("pos"), "members")


def emitted(canon: DataFrame) -> DataFrame:
    """(g, dup, canonical) for every node that isn't its own canonical one."""
    return canon.where("v <> canonical").select("g", F.col("v").alias("dup"), "canonical")


def emit_new(canon: DataFrame, existing: DataFrame) -> DataFrame:
    """Emitted facts that existing doesn't hold yet: emitting again gives nothing."""
    return emitted(canon).join(existing, ["g", "dup", "canonical"], "left_anti")


def members_of(canon: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, x, v): members of the cluster of each asked (g, x)."""
    of = asked.join(canon.select("g", F.col("v").alias("x"), "canonical"), ["g", "x"])
    return of.join(canon, ["g", "canonical"]).select("g", "x", "v")


def same_cluster(canon: DataFrame, queries: DataFrame) -> DataFrame:
    """(g, pos, value) 1 or 0 for queries (g, pos, a, b)."""
    a, b = (canon.select("g", F.col("v").alias(c), F.col("canonical").alias(f"c{c}")) for c in ("a", "b"))
    return queries.join(a, ["g", "a"]).join(b, ["g", "b"]).select("g", "pos", (F.col("ca") == F.col("cb")).cast("bigint").alias("value"))


# --- conflicts ----------------------------------------------------------------------------------------


def conflicts(canon: DataFrame, must_not_link: DataFrame) -> DataFrame:
    """(g, a, b, canonical): must-not-link pairs that ended in one cluster."""
    a, b = (canon.select("g", F.col("v").alias(c), F.col("canonical").alias(f"c{c}")) for c in ("a", "b"))
    return must_not_link.join(a, ["g", "a"]).join(b, ["g", "b"]).where("ca = cb").select("g", "a", "b", F.col("ca").alias("canonical"))


def conflict_flags(canon: DataFrame, found: DataFrame) -> DataFrame:
    """(g, canonical, value) 1 for clusters with a violated pair, else 0."""
    bad = found.select("g", "canonical").distinct().withColumn("value", F.lit(1).cast("bigint"))
    return canon.select("g", "canonical").distinct().join(bad, ["g", "canonical"], "left").fillna(0, ["value"])


#: What a decision log tells of each pair: action merge, noop, must_not_link or size; the least must-not-link pair in its way; which of both
#: reasons holds; and how large the clusters of u and v were at that time.
LOG = "u bigint, v bigint, score bigint, action string, blocker_a bigint, blocker_b bigint, mnl_bad boolean, cap_bad boolean, n_u bigint, n_v bigint"


def _merge(cap: int | None):  # noqa: ANN202
    """Kernel: rows (kind, x, y, z) of one component; kind 0 must-not-link (a, b, 0), kind 1 accepted in order (-score, u, v). Gives rows of LOG."""

    def kernel(rows: list[tuple]) -> list[tuple]:
        apart: dict[int, set[int]] = {}
        for kind, x, y, _ in rows:
            if kind == 0:
                apart.setdefault(x, set()).add(y)
                apart.setdefault(y, set()).add(x)
        group: dict[int, list[int]] = {}
        foes: dict[int, set[int]] = {}
        home: dict[int, int] = {}
        out = []
        for kind, score, u, v in rows:
            if kind == 0:
                continue
            for x in (u, v):
                if x not in home:
                    home[x], group[x], foes[x] = x, [x], apart.get(x, set())
            a, b = home[u], home[v]
            n_u, n_v = len(group[a]), len(group[b])
            if a == b:
                out.append((u, v, -score, "noop", None, None, False, False, n_u, n_v))
                continue
            if n_u > n_v:
                a, b = b, a
            wall = None
            if any(x in foes[b] for x in group[a]):
                wall = min((min(x, y), max(x, y)) for x in group[a] for y in apart.get(x, ()) if home.get(y) == b)
            large = cap is not None and n_u + n_v > cap
            if wall or large:
                out.append((u, v, -score, "must_not_link" if wall else "size", *(wall or (None, None)), wall is not None, large, n_u, n_v))
                continue
            for x in group[a]:
                home[x] = b
            group[b] += group.pop(a)
            foes[b] = foes[b] | foes.pop(a)
            out.append((u, v, -score, "merge", None, None, False, False, n_u, n_v))
        return out

    return kernel


def _facts(nodes: DataFrame, pairs: DataFrame, must_not_link: DataFrame, cap: int | None) -> DataFrame:
    """(g, label, kind, x, y, z): facts of the components in which a must-not-link pair lies or that are above cap, as _merge takes them."""
    labels = written(components(nodes, pairs), "labels")
    broken = conflicts(labels.withColumnRenamed("label", "canonical"), must_not_link).select("g", F.col("canonical").alias("label"))
    if cap is not None:
        large = labels.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
        broken = broken.unionByName(large.select("g", "label"))
    at = labels.join(broken.distinct(), ["g", "label"], "left_semi")
    ends = lambda c: at.select("g", F.col("v").alias(c), "label")
    fact = lambda kind, x, y, z: ["g", "label", F.lit(kind).alias("kind"), x.alias("x"), F.col(y).alias("y"), z.alias("z")]
    links = pairs.join(ends("u"), ["g", "u"]).select(*fact(1, -F.col("score"), "u", F.col("v")))
    walls = must_not_link.join(ends("a"), ["g", "a"]).select(*fact(0, F.col("a"), "b", F.lit(0).cast("bigint")))
    return links.unionByName(walls)


def decisions(nodes: DataFrame, pairs: DataFrame, must_not_link: DataFrame, cap: int | None = None) -> DataFrame:
    """(g, LOG...) for accepted pairs (g, u, v, score) in the components that need it.

    Merges happen in order of score descending, u, v; one is skipped if it would bring a must-not-link pair together or
    a cluster above cap. Merges stay within components of the accepted pairs, so components without a violated
    pair and not above cap are final as they are and only the others go through the kernel, each whole in one task.
    """
    return by_group(_facts(nodes, pairs, must_not_link, cap), ["g", "label"], ["kind", "x", "y", "z"], _merge(cap), LOG).drop("label")


def _flips(cap: int | None):  # noqa: ANN202
    """Kernel as _merge's, with whether each must-not-link refusal turns into a merge or a noop when the pair changes places with one that shares a node and has another score."""
    plain = _merge(cap)

    def kernel(rows: list[tuple]) -> list[tuple]:
        walls, links = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        near: dict[int, list[int]] = {}
        for i, (_, _, u, v) in enumerate(links):
            near.setdefault(u, []).append(i)
            near.setdefault(v, []).append(i)
        out = []
        for i, row in enumerate(plain(rows)):
            flips = False
            if row[6] and not row[7]:
                for j in sorted({*near[row[0]], *near[row[1]]} - {i}):
                    if links[j][1] == links[i][1]:
                        continue
                    changed = list(links)
                    changed[i], changed[j] = links[j], links[i]
                    if plain(walls + changed)[j][3] in ("merge", "noop"):
                        flips = True
                        break
            out.append((*row, flips))
        return out

    return kernel


def decision_pools(nodes: DataFrame, pairs: DataFrame, must_not_link: DataFrame, cap: int | None = None) -> DataFrame:
    """(g, pool, u, v, score, reason, order_dependent): decisions by kind, for explanations to be drawn from.

    MERGE: accepted pairs that ended in one cluster. Refusals with one reason alone: CAP by size; ORDER by a must-not-link pair, but
    not if the pair changed places with one neighbour of another score; MNL the other ones. A refusal with both reasons is in no pool.
    """
    log = by_group(_facts(nodes, pairs, must_not_link, cap), ["g", "label"], ["kind", "x", "y", "z"], _flips(cap), LOG + ", flips boolean").drop("label")
    log = written(log, "decisions")
    key = ["g", "u", "v", "score"]
    one = F.col("mnl_bad") != F.col("cap_bad")
    pool = F.when(F.col("cap_bad"), "CAP").when(F.col("flips"), "ORDER").otherwise("MNL")
    reason = F.when(F.col("cap_bad"), "size").otherwise("must_not_link")
    refused = log.where("action in ('must_not_link', 'size')")
    out = refused.where(one).select("g", pool.alias("pool"), "u", "v", "score", reason.alias("reason"), F.col("flips").alias("order_dependent"))
    merged = pairs.select(*key).join(refused.select(*key), key, "left_anti")
    # a pair that was refused can still end in one cluster by way of others
    canon = canonical(nodes, merged)
    ends = lambda c: canon.select("g", F.col("v").alias(c), F.col("canonical").alias(f"c{c}"))
    inside = pairs.join(ends("u"), ["g", "u"]).join(ends("v"), ["g", "v"]).where("cu = cv")
    return out.unionByName(inside.select("g", F.lit("MERGE").alias("pool"), "u", "v", "score", F.lit(None).cast("string").alias("reason"), F.lit(False).alias("order_dependent")))


def constrained(nodes: DataFrame, pairs: DataFrame, must_not_link: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(canon, decision log): clusters when pairs are merged in order under the constraints."""
    log = written(decisions(nodes, pairs, must_not_link, cap), "decisions")
    skipped = log.where("action in ('must_not_link', 'size')").select("g", "u", "v", "score")
    return canonical(nodes, pairs.select("g", "u", "v", "score").join(skipped, ["g", "u", "v", "score"], "left_anti")), log


# --- properties and rewriting -------------------------------------------------------------------------


def merged_properties(canon: DataFrame, attributes: DataFrame) -> DataFrame:
    """(g, canonical, key, value, n_values): commonest value of each cluster's key, ties to the smallest. Null values and keys are absent."""
    counts = attributes.where("value is not null and key is not null").join(canon.select("g", F.col("v").alias("node"), "canonical"), ["g", "node"]).groupBy("g", "canonical", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("g", "canonical", "key").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"), F.count(F.lit(1)).alias("n_values"))


def distinct_values(ids: DataFrame, attributes: DataFrame, keys: int = 4) -> DataFrame:
    """(g, key, value): number of different values of each key 0 .. keys - 1."""
    every = ids.withColumn("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(keys - 1).cast("bigint"))))
    found = attributes.groupBy("g", "key").agg(F.count_distinct("value").alias("n"))
    return every.join(found, ["g", "key"], "left").select("g", "key", F.coalesce("n", F.lit(0)).alias("value"))


def rewritten(canon: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, u, v, w): edges between canonical nodes, u < v, loops dropped, equal ones collapsed with w the wrapping sum of theirs."""
    one, other = canon.select("g", F.col("v").alias("u"), F.col("canonical").alias("cu")), canon.select("g", "v", F.col("canonical").alias("cv"))
    rows = edges.join(one, ["g", "u"]).join(other, ["g", "v"]).where("cu <> cv")
    return rows.groupBy("g", F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(wrap(F.sum("w")).alias("w"))


def collapsed(edges: DataFrame, new: DataFrame) -> DataFrame:
    """How many edges rewriting took away."""
    n = edges.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return n.join(new.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g", "left").select("g", (F.col("n") - F.coalesce("m", F.lit(0))).alias("value"))


def rewritten_degrees(canon: DataFrame, new: DataFrame) -> DataFrame:
    """(g, canonical, value): number of neighbours of each cluster."""
    found = symmetric(new.select("g", "u", "v")).groupBy("g", F.col("u").alias("canonical")).agg(F.count(F.lit(1)).alias("value"))
    return canon.select("g", "canonical").distinct().join(found, ["g", "canonical"], "left").fillna(0, ["value"])


def rewritten_neighbours(new: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, k, v): neighbours of each asked cluster (g, k)."""
    return symmetric(new.select("g", "u", "v")).withColumnRenamed("u", "k").join(asked, ["g", "k"]).select("g", "k", "v")


# --- metrics ------------------------------------------------------------------------------------------


def metrics(labels: DataFrame) -> DataFrame:
    """Per case of labels (g, v, pred, truth): pairs tp, fp, fn, agreeing pairs and purity, from the table of joint counts alone."""
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    joint = labels.groupBy("g", "pred", "truth").agg(F.count(F.lit(1)).alias("n"))
    by_pred = joint.groupBy("g", "pred").agg(F.sum("n").alias("a"), F.max("n").alias("most"), F.sum(pairs("n")).alias("tp"))
    by_truth = joint.groupBy("g", "truth").agg(F.sum("n").alias("b")).groupBy("g").agg(F.sum(pairs("b")).alias("same_truth"))
    whole = by_pred.groupBy("g").agg(F.sum("a").alias("m"), F.sum("most").alias("purity"), F.sum("tp").alias("tp"), F.sum(pairs("a")).alias("same_pred")).join(by_truth, "g")
    fp, fn = F.col("same_pred") - F.col("tp"), F.col("same_truth") - F.col("tp")
    return whole.select("g", wrap(F.col("tp")).alias("tp"), wrap(fp).alias("fp"), wrap(fn).alias("fn"), wrap(pairs("m") - fp - fn).alias("rand"), "purity")


# --- pipeline -----------------------------------------------------------------------------------------


def reconcile(nodes: DataFrame, candidates: DataFrame, tau: int) -> DataFrame:
    """(g, v, canonical): decide by the highest score of each pair, then cluster."""
    return canonical(nodes, accepted(normalised(candidates), tau))


def reconcile_full(nodes: DataFrame, candidates: DataFrame, tau: int, must_not_link: DataFrame, edges: DataFrame, attributes: DataFrame, cap: int | None = None) -> dict[str, DataFrame]:
    """canon, edges, attributes, conflicts and decisions of the whole pipeline under must-not-link."""
    pairs = written(accepted(normalised(candidates), tau), "accepted")
    canon, log = constrained(nodes, pairs, must_not_link, cap)
    canon = written(canon, "canon")
    return {"canon": canon, "edges": rewritten(canon, edges), "attributes": merged_properties(canon, attributes), "conflicts": conflicts(canon, must_not_link), "decisions": log}
