"""Same or near-same records across splits: a weighted cosine join over inverted lists, then the exact rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.names import window_names
from brookmill.session import SharedTable, join_hot


def cosine_join(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of vectors of side 0 and side 1 whose cosine is at least ``threshold``.

    ``vectors``: (vec unique within its side, side INT, terms ARRAY<STRUCT<term, w DOUBLE>>), terms in one order that is
    the same for all vectors, each once and with w > 0. A vector is indexed under its leading terms only, until the
    norm of the rest is under the threshold: two vectors that share none of those have all their common terms in the
    rest of one of them, so their cosine is under the threshold. A posting carries the residual norm from its term on, the
    vector's largest weight and its weights' sum; a pair is kept if these bounds allow the threshold, and then the dot
    product over all terms decides. Nothing is capped. Vectors without terms match nothing. A term that is in many
    vectors makes a large partition of the join, which adaptive execution splits on both sides.
    """
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator is computed once, however often its column is used
    v = vectors.where(F.size("terms") > 0).select("vec", "side", once("terms").alias("terms"))
    total = F.aggregate("terms", F.struct(F.lit(0.0).alias("sq"), F.lit(0.0).alias("most"), F.lit(0.0).alias("sum")), lambda s, t: F.struct(
        (s["sq"] + t["w"] * t["w"]).alias("sq"), F.greatest(s["most"], t["w"]).alias("most"), (s["sum"] + t["w"]).alias("sum")))
    v = v.select("*", once(total).alias("_m")).select("vec", "side", "terms", "_m.sq", (F.col("_m.most") / F.sqrt("_m.sq")).alias("_max"), (F.col("_m.sum") / F.sqrt("_m.sq")).alias("_sum"))
    kind = v.schema["terms"].dataType.elementType["term"].dataType.simpleString()
    least = F.col("sq") * (1.0 - threshold * threshold + 1e-9)
    none = F.expr(f"cast(array() as array<struct<term:{kind},w:double,before:double>>)")

    def lead(s: Column, t: Column) -> Column:
        """Takes terms until the squared norm before one exceeds what the rest may lack."""
        more = F.struct(s["sq"] + t["w"] * t["w"], F.concat(s["kept"], F.array(F.struct(t["term"].alias("term"), t["w"].alias("w"), s["sq"].alias("before")))))
        return F.when(s["sq"] > least, s).otherwise(F.struct(more["col1"].alias("sq"), more["col2"].alias("kept")))

    kept = F.aggregate("terms", F.struct(F.lit(0.0).alias("sq"), none.alias("kept")), lead, lambda s: s["kept"])
    posting = v.select("vec", "side", "terms", "sq", "_max", "_sum", F.explode(kept).alias("_t")).select(
        "vec", "side", "terms", "sq", "_max", "_sum", "_t.term", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("_t.before") / F.col("sq"))).alias("rest"))
    a = posting.where("side = 0").select("term", *(F.col(c).alias(f"{c}_a") for c in ("vec", "terms", "sq", "rest", "_max", "_sum")))
    b = posting.where("side = 1").select("term", *(F.col(c).alias(f"{c}_b") for c in ("vec", "terms", "sq", "rest", "_max", "_sum")))
    low = threshold - 1e-9
    near = a.join(b, "term").where(
        (F.least(F.col("_sum_a") * F.col("_max_b"), F.col("_sum_b") * F.col("_max_a")) >= low)
        # holds at the first common term of every pair that reaches the threshold: nothing before it adds to the product
        & (F.col("rest_a") * F.col("rest_b") >= low)
    )
    near = near.select(F.col("vec_a").alias("a"), F.col("vec_b").alias("b"), "terms_a", "sq_a", "sq_b", once(F.map_from_entries("terms_b")).alias("_of_b"))
    dot = F.aggregate("terms_a", F.lit(0.0), lambda s, t: s + t["w"] * F.coalesce(F.try_element_at("_of_b", t["term"]), F.lit(0.0)))
    scored = near.select("a", "b", once(dot / F.sqrt(F.col("sq_a") * F.col("sq_b"))).alias("similarity"))
    return scored.where(F.col("similarity") >= low).distinct()


def interval_terms(first: Column, last: Column, key: list[Column], scale: Column) -> Column:
    """Terms of a window of frames: blocks of an eighth of 2**scale frames, weighted by the root of their frames.

    The cosine of two such vectors is at least that of the windows' frame sets, by Cauchy and Schwarz within blocks, so
    a threshold that holds for frame sets loses nothing; there are at most 18 terms however long the window is. Terms are hashes; should two meet, that adds a
    candidate and drops none, as the exact rule follows.
    """
    block = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), scale) / 8).cast("bigint")
    return F.transform(
        F.sequence(F.floor(first / block), F.floor(last / block)),
        lambda k: F.struct(
            F.xxhash64(*key, scale, k).alias("term"),
            F.sqrt((F.least(last, (k + 1) * block - 1) - F.greatest(first, k * block) + 1).cast("double")).alias("w")),
    )


#: Members of one class in one task when pairs of classes are multiplied out.
SHARE = 20_000
NAMES = ("id", "video_path", "timeseries_path")
HELD = ("val", "test")


def record_classes(manifest: DataFrame, names: tuple[str, ...] = NAMES, train: str = "train", held: tuple[str, ...] = HELD) -> tuple[DataFrame, DataFrame]:
    """Rows and their classes: (row_no, record) and (record, class_no, n).

    A class are the rows of one source and split that name the same windows, ``record``; class_no is the smallest of
    their row_no. Rows without a name, source or split, and rows of other splits, have none.
    """
    side = F.when(F.col("split") == train, 0).when(F.col("split").isin(*held), 1)
    found = F.array_sort(F.array_distinct(F.filter(window_names(F.array(*(F.col(c) for c in names))), lambda x: x.isNotNull())))
    rows = manifest.select("row_no", "source", "split", side.alias("side"), F.explode(F.array(found)).alias("names")).where("source is not null and side is not null and size(names) > 0")
    rows = SharedTable(rows.select("row_no", F.struct("source", "split", "side", "names").alias("record")), "records").read()
    return rows, SharedTable(rows.groupBy("record").agg(F.min("row_no").alias("class_no"), F.count("*").alias("n")), "classes").read()


def class_pairs(classes: DataFrame, least: float = 0.9) -> DataFrame:
    """(class_a, class_b, n_a, n_b, source, split, covered): train and held-out classes that are the same record, once each.

    Two are the same if a name of each has the same entity and channel (null equals null) and their windows share at
    least ``least`` of the frames that either covers. The cosine join is over distinct names, so copies cost nothing.
    """
    named = classes.select("class_no", "n", "record.split", "record.side", "record.source", F.explode("record.names").alias("name")).select(
        "class_no", "n", "split", "side", F.struct("source", "name.entity", F.coalesce("name.ch", F.lit(-1)).alias("ch"), "name.first", "name.last").alias("name"))
    vectors = named.select("side", "name").distinct()
    # windows that share nine tenths differ in length by a tenth: each is written at the scale of its length and, near a power of two, at the next one too
    first, last = F.col("name.first"), F.col("name.last")
    length = last - first + 1
    scales = F.array_distinct(F.array(*(F.floor(F.log2(x.cast("double"))).cast("int") for x in (length, length / F.lit(least)))))
    key = [F.col("name.source"), F.col("name.entity"), F.col("name.ch")]
    spread = vectors.select("*", F.explode(scales).alias("scale")).select(F.col("name").alias("vec"), "side", interval_terms(first, last, key, F.col("scale")).alias("terms"))
    # frame sets with Jaccard j have a cosine of at least 2j / (1 + j)
    near = cosine_join(spread, 2 * least / (1 + least)).select("a", "b").distinct()
    common = F.least("a.last", "b.last") - F.greatest("a.first", "b.first") + 1
    either = F.greatest("a.last", "b.last") - F.least("a.first", "b.first") + 1
    near = near.withColumn("covered", common / either).where((common >= 1) & (common * 1000 >= either * int(round(least * 1000))))
    a = named.where("side = 0").select(F.col("name").alias("a"), F.col("class_no").alias("class_a"), F.col("n").alias("n_a"))
    b = named.where("side = 1").select(F.col("name").alias("b"), F.col("class_no").alias("class_b"), F.col("n").alias("n_b"), "split")
    pairs = near.join(a, "a").join(b, "b").select("class_a", "class_b", "n_a", "n_b", F.col("a.source").alias("source"), "split", "covered")
    return pairs.groupBy("class_a", "class_b", "n_a", "n_b", "source", "split").agg(F.max("covered").alias("covered"))


def cross_split_pairs(manifest: DataFrame, names: tuple[str, ...] = NAMES, least: float = 0.9, train: str = "train", held: tuple[str, ...] = HELD) -> DataFrame:
    """(row_no_a, row_no_b, source, split, covered): train and held-out rows of one source that are the same record.

    Pairs of classes (class_pairs) multiplied out by their rows, as every repeated row counts; a class of many rows is
    dealt out in shares of about SHARE rows. Extra columns are ignored.
    """
    rows, classes = record_classes(manifest, names, train, held)
    pairs = SharedTable(class_pairs(classes, least), "pairs").read()
    of = join_hot(rows, classes, "record", "n", rows.count(), keep=True).select("row_no", "class_no", F.pmod(F.xxhash64("row_no"), _shares(F.col("n"))).alias("share"))
    of = SharedTable(of, "members").read()
    for side, row in (("a", "train_row"), ("b", "held_row")):
        dealt = pairs.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), _shares(F.col(f"n_{side}")) - 1)))
        pairs = dealt.join(of.select(F.col("class_no").alias(f"class_{side}"), "share", F.col("row_no").alias(row)), [f"class_{side}", "share"]).drop("share")
    return pairs.select(F.least("train_row", "held_row").alias("row_no_a"), F.greatest("train_row", "held_row").alias("row_no_b"), "source", "split", "covered")


def _shares(n: Column) -> Column:
    return F.ceil(n / F.lit(SHARE)).cast("bigint")


def overlap_report(manifest: DataFrame, names: tuple[str, ...] = NAMES, least: float = 0.9, train: str = "train", held: tuple[str, ...] = HELD) -> DataFrame:
    """Per source and held-out split: pairs, held-out rows that are also train rows, held-out rows.

    Counted from pairs of classes and how many rows they have, so no pair of rows is ever made. A null source has a row
    of its own, without pairs.
    """
    _, classes = record_classes(manifest, names, train, held)
    pairs = SharedTable(class_pairs(classes, least), "pairs").read()
    per = pairs.groupBy("source", "split").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_pairs"))
    hit = pairs.groupBy("source", "split", "class_b").agg(F.first("n_b").alias("n")).groupBy("source", "split").agg(F.sum("n").alias("n_leaked"))
    all_held = manifest.where(F.col("split").isin(*held)).groupBy("source", "split").agg(F.count("*").alias("n_held"))
    return all_held.join(per, ["source", "split"], "left").join(hit, ["source", "split"], "left").na.fill(0, ["n_pairs", "n_leaked"])
