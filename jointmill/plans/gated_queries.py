"""Queries that raise where no split passes the gates, as on the smallest tables; each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jointmill.operators import splits
from jointmill.plans.core_queries import _CANDIDATES_WHOLE as CANDIDATES
from jointmill.plans.core_queries import RATIOS, SEARCHED, _grouped


def split_chosen_whole(spark: SparkSession, d: str) -> DataFrame:
    """Assignment of the best of all candidates of the reference's search."""
    return splits.choose(_grouped(spark, d), "g", "class", RATIOS, SEARCHED)[0].select("crop_id", "split")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"split_chosen_whole": split_chosen_whole}


def oracle_sql() -> dict[str, str]:
    return {
        "split_chosen_whole": f"""with {CANDIDATES}, best as (select candidate from per join size using (candidate) where fails_normal = 0 and fails_defect = 0 order by round(class_deviation, 12), round(size_deviation, 12), candidate limit 1),
a as (select cr.*, ('0x' || substr(md5(candidate::varchar || ':' || coalesce(group_id, crop_id)), 1, 8))::bigint % 5 as fold from cr cross join best where class is not null)
select crop_id, case when fold < 3 then 'train' when fold < 4 then 'val' else 'test' end as split from a"""
    }
