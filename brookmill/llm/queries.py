"""Registered queries of this subpackage. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.names import canonical, entity
from brookmill.llm.leakage import find_leaks
from brookmill.llm.mixing import mix_report, mix_sources
from brookmill.llm.overlaps import cross_split_pairs, overlap_report
from brookmill.llm.packing import pack_items, pack_report
from brookmill.llm.sentences import split_sentences
from brookmill.llm.splits import assign_splits, related_components
from brookmill.operators.lengths import series_tokens, video_tokens
from brookmill.session import table


def _related(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "manifest").select("row_no", "id")
    # an id is a record's name: rows with the same id text are related, and so are rows whose ids name one entity
    return related_components(manifest, "row_no", {"id": F.nullif(canonical(F.col("id")), F.lit("")), "entity": entity(F.col("id"))})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "manifest").where(entity(F.col("id")).isNotNull()).select(F.col("row_no").alias("record"))
    return _related(spark, d).where("record <> component").join(named, "record", "left_semi").select(F.col("component").alias("row_no_a"), F.col("record").alias("row_no_b"))


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r["split"], r["target_share"]) for r in table(spark, d, "split_targets").orderBy("split").collect()]


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(_related(spark, d), _targets(spark, d)).select(F.col("record").alias("row_no"), F.col("component").alias("group_row_no"), "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    per = p1_split(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_row_no").alias("n_groups"))
    total = table(spark, d, "manifest").count()
    return table(spark, d, "split_targets").join(per, "split", "left").na.fill(0, ["n_rows", "n_groups"]).withColumn("share", F.col("n_rows") / F.lit(max(1, total)))


def p4_pack(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "manifest").select("row_no", (video_tokens(F.col("video_meta")) + series_tokens(F.col("ts_shape"))).alias("tokens"))
    return pack_items(lengths, table(spark, d, "pack_budgets"), "row_no", "tokens").withColumnRenamed("item", "row_no")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(p4_pack(spark, d), table(spark, d, "pack_budgets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(table(spark, d, "manifest")).select("row_no_a", "row_no_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "manifest").select("row_no", "id", "video_path", "timeseries_path", "source", "split")
    return overlap_report(manifest)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "documents").select("doc_id", "source")
    return p7_found(spark, d).join(sources, "doc_id").groupBy("item_id").agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_sentences(spark, d).select("doc_id", "end_pos")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_split": p1_split, "p1_shares": p1_shares, "p4_pack": p4_pack, "p4_report": p4_report, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_report": p7_report, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_sentences": p9_sentences}


#: An id as SQL reads it, and the entity, channel and window that it names.
_CANON = "lower(trim(regexp_replace(regexp_replace({c}, '%5[fF]', '_', 'g'), '[\\r\\n\\t]', ' ', 'g')))"
_NAME = r"'(?:^|[^a-z0-9])([0-9]*[a-z][a-z0-9]*)[^a-z0-9]+f?0*([0-9]+)[^a-z0-9]+f?0*([0-9]+)(?:[^a-z0-9]*ch[^a-z0-9]*0*([0-9]+))?'"


def _named(c: str, part: int) -> str:
    return f"regexp_extract({_CANON.format(c=c)}, {_NAME}, {part})"


_P6 = f"""
            named as (
              select row_no, source, split, x.e, x.c, cast(x.f as bigint) as f, cast(x.l as bigint) as l from (
                select row_no, source, split, unnest([
                  {', '.join("{'e': " + _named(c, 1) + ", 'c': " + _named(c, 4) + ", 'f': nullif(" + _named(c, 2) + ", ''), 'l': nullif(" + _named(c, 3) + ", '')}" for c in ('id', 'video_path', 'timeseries_path'))}
                ]) as x from manifest) where length(x.e) = 10),
            pairs as (
              select distinct t.row_no as train_row, h.row_no as held_row, source, h.split as split
              from named t join named h using (source, e, c)
              where t.split = 'train' and h.split in ('val', 'test') and t.f <= t.l and h.f <= h.l
                and 10 * (least(t.l, h.l) - greatest(t.f, h.f) + 1) >= 9 * (greatest(t.l, h.l) - least(t.f, h.f) + 1))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            with named as (select row_no, {_named('id', 1)} as e from manifest where id is not null),
            firsts as (select e, min(row_no) as a from named where length(e) = 10 group by e)
            select a as row_no_a, row_no as row_no_b from named join firsts using (e) where row_no <> a""",
        "p6_found": f"with {_P6} select least(train_row, held_row) as row_no_a, greatest(train_row, held_row) as row_no_b from pairs",
        "p6_report": f"""
            with {_P6}, held as (select source, split, count(*) as n_held from manifest where split in ('val', 'test') group by all),
            hit as (select source, split, count(*) as n_pairs, count(distinct held_row) as n_leaked from pairs group by all)
            select held.source, held.split, n_held, coalesce(n_pairs, 0) as n_pairs, coalesce(n_leaked, 0) as n_leaked from held left join hit on held.source = hit.source and held.split = hit.split""",
    }
