"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.llm.components import hash_to_min
from brookmill.session import SharedTable, join_hot


def related_components(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(record, component, n): each record of ``df`` with its component's smallest record and number of records.

    Records that share a non-null value of any key are related, and relation is transitive. ``id_col`` is a unique
    BIGINT. Records with the same values of all keys (exact copies, for one) are one node, pre-aggregated before any
    shuffle of edges; a key value is a node named by its smallest record, so that all labels are numbers of records.
    Records without any key are components of their own. Extra columns are ignored; an empty table gives no rows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(F.col(id_col).alias("record"), *(k.alias(n) for n, k in zip(names, keys.values())))
    rows = SharedTable(rows, "related").read()
    some = F.expr(" or ".join(f"{n} is not null" for n in names))
    nodes = SharedTable(rows.where(some).groupBy(*names).agg(F.min("record").alias("node"), F.count("*").alias("n")), "nodes").read()
    edges, size = None, nodes.count()
    for n in names:
        reps = nodes.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("node").alias("b"), F.count("*").alias("n_of"))
        part = join_hot(nodes.where(F.col(n).isNotNull()).select(n, F.col("node").alias("a")), reps, n, "n_of", size).select("a", "b")
        edges = part if edges is None else edges.unionByName(part)
    parts = hash_to_min(edges).read()
    weighed = nodes.withColumnRenamed("n", "n_rows").join(parts, "node")
    sizes = weighed.groupBy("component").agg(F.sum("n_rows").alias("n"), F.count("*").alias("n_of"))
    labelled = join_hot(weighed, sizes, "component", "n_of", size)
    keyed = labelled.select(F.xxhash64(*names).alias("_h"), *names, "component", "n", "n_rows")
    given = rows.where(some).withColumn("_h", F.xxhash64(*names))
    # The hash only brings rows together; equality is decided by the keys themselves, null-safe.
    for i, n in enumerate(names):
        keyed = keyed.withColumnRenamed(n, f"_r{i}")
    matched = join_hot(given, keyed, "_h", "n_rows", rows.count())
    same = [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)]
    for c in same:
        matched = matched.where(c)
    alone = rows.where(~some).select("record", F.col("record").alias("component"), F.lit(1).cast("bigint").alias("n"))
    return matched.select("record", "component", "n").unionByName(alone)


def rendezvous(component: Column, targets: list[tuple[str, float]], seed: int = 7) -> Column:
    """The split with the highest weighted rendezvous score ``-w / ln(u)``, u a hash of the component and the split.

    A change of one weight moves only components into or out of that split. Splits of weight 0 get nothing.
    """
    scored = []
    for name, w in targets:
        if w > 0:
            u = (F.pmod(F.xxhash64(component, F.lit(name), F.lit(seed)), F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float((1 << 52) - 1))
            scored.append(F.struct((-F.lit(float(w)) / F.ln(u)).alias("score"), F.lit(name).alias("split")))
    return F.greatest(*scored)["split"] if len(scored) > 1 else scored[0]["split"]


#: Components of over this share of all rows, fewer than its inverse, are placed one by one; all others by hashing.
LARGE = 0.01
#: Shares of rows that hashing gives are brought within CLOSE of what is wanted, in at most ROUNDS passes over components.
CLOSE, ROUNDS = 0.001, 12


def calibrated(sizes: DataFrame, wanted: dict[str, float], seed: int) -> list[tuple[str, float]]:
    """Weights by which rendezvous hashing of ``sizes`` (component, n) comes nearest to ``wanted`` rows a split.

    A split that got too many rows loses weight, which moves only components out of it, and so on in turn. Each round
    sums up rows by split; nothing else is collected. The best weights seen are taken.
    """
    weights = {k: max(v, 0.0) for k, v in wanted.items()}
    total = sum(weights.values())
    best: tuple[float, list[tuple[str, float]]] = (float("inf"), list(weights.items()))
    for _ in range(ROUNDS if total > 0 else 0):
        split = rendezvous(F.col("component"), list(weights.items()), seed)
        got = {r["split"]: r["n"] for r in sizes.groupBy(split.alias("split")).agg(F.sum("n").alias("n")).collect()}
        off = max(abs(got.get(k, 0) - max(v, 0.0)) for k, v in wanted.items()) / total
        if off < best[0]:
            best = off, list(weights.items())
        if off <= CLOSE:
            break
        # at most doubled or halved at a time; a split that got nothing is doubled
        weights = {k: w * min(2.0, max(0.5, max(wanted[k], 0.0) / got[k] if got.get(k) else 2.0)) for k, w in weights.items()}
    return best[1]


def assign_splits(related: DataFrame, targets: list[tuple[str, float]], seed: int = 7, large: float = LARGE) -> DataFrame:
    """Adds ``split`` to the rows of related_components so that components stay whole and shares of rows meet targets.

    Components go by weighted rendezvous hashing with weights calibrated to the shares of rows. Only those of over
    ``large`` of all rows, which would spoil the shares wherever hashing put them, go first, largest first, where most
    rows are still missing. The rule is the same at every size; with fewer than 1 / ``large`` rows every component is a
    large one. A split of share 0 gets nothing.
    """
    related = SharedTable(related, "components").read()
    of = SharedTable(related.where(F.col("record") == F.col("component")).select("component", "n"), "sizes").read()
    total = of.agg(F.sum("n")).first()[0] or 0
    left = {name: share * total for name, share in targets}
    placed: dict[int, str] = {}
    for r in of.where(F.col("n") > total * large).orderBy(F.desc("n"), "component").collect():
        name = max(left, key=lambda k: (left[k], k))
        placed[r["component"]] = name
        left[name] -= r["n"]
    weights = calibrated(of.where(F.col("n") <= total * large), left, seed)
    if not any(w > 0 for _, w in weights):
        weights = targets
    by_hash = rendezvous(F.col("component"), weights, seed)
    if not placed:
        return related.withColumn("split", by_hash)
    known = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])
    return related.withColumn("split", F.coalesce(F.try_element_at(known, F.col("component")), by_hash))
