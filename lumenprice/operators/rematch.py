"""Matching again after the catalogue changed: only what the change can touch runs the cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenprice.functions import text
from lumenprice.operators.fuzzy import nearest_entries
from lumenprice.operators.resolve import LEXICAL, cascade, lexical_index
from lumenprice.sources.stored import stored

#: Entries of the fuzzy level that a name's candidates come from.
NEAR = 2 * LEXICAL


def nearest(items: DataFrame, services: DataFrame) -> DataFrame:
    """What a run knows of each name's fuzzy candidates: entry_of, service_id, seq, entry, ts of the NEAR best entries; to be kept for the next run."""
    names = items.select(text.normalize(F.col("name")).alias("entry_of")).distinct()
    return nearest_entries(names, lexical_index(services), NEAR)


def changed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of services that only the old or only the new catalogue has (their index rows depend on nothing else)."""
    columns = [c for c in ("service_id", "service_name", "synonyms", "icd_code", "is_active") if c in old.columns and c in new.columns]
    return stored(old.select(columns).exceptAll(new.select(columns)), "rematch-gone"), stored(new.select(columns).exceptAll(old.select(columns)), "rematch-new")


def touched(items: DataFrame, before: DataFrame, near: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """item_id of the items whose outcome can differ from the one before.

    items and before (the items of that run): item_id, name, code. An item is touched if it is new or has another name or code; if its code is one that a changed service
    had or has; if its name is an entry of such a service; if one of its candidates is such a service; or if an entry that
    came is at least as similar as its last candidate, or it had fewer candidates than it may have.
    """
    gone, came = changed(old, new)
    keys = gone.unionByName(came).filter("is_active").select(text.normalize_code(F.col("icd_code")).alias("key")).filter("key is not null").distinct()
    was, now = lexical_index(gone), lexical_index(came)
    entries = was.select("entry").unionByName(now.select("entry")).distinct()
    named = items.select("item_id", text.normalize(F.col("name")).alias("entry_of"), text.normalize_code(F.col("code")).alias("key"))
    least = near.groupBy("entry_of").agg(F.min("ts").alias("least"), F.count(F.lit(1)).alias("n"))
    best = nearest_entries(named.select("entry_of").distinct(), now, 1).select("entry_of", F.col("ts").alias("best"))
    by_entry = best.join(least, "entry_of", "left").filter(F.col("least").isNull() | (F.col("n") < NEAR) | (F.col("best") >= F.col("least"))).select("entry_of")
    lost = near.join(was.select("service_id").distinct(), "service_id", "left_semi").select("entry_of")
    names = by_entry.unionByName(lost).unionByName(entries.select(F.col("entry").alias("entry_of"))).distinct()
    same = items.join(before.select("item_id", F.col("name").alias("_n"), F.col("code").alias("_c")), "item_id").filter(F.col("name").eqNullSafe(F.col("_n")) & F.col("code").eqNullSafe(F.col("_c")))
    fresh = items.select("item_id").join(same.select("item_id"), "item_id", "left_anti")
    return fresh.unionByName(named.join(keys, "key", "left_semi").select("item_id")).unionByName(named.join(names, "entry_of", "left_semi").select("item_id")).distinct()


def rematch(items: DataFrame, before: DataFrame, outcomes: DataFrame, near: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The outcomes of cascade(items, new): those of touched items made anew, the others as outcomes has them from the run before."""
    again = stored(touched(items, before, near, old, new), "rematch-touched")
    fresh = cascade(items.join(again, "item_id", "left_semi"), new)
    return fresh.unionByName(outcomes.join(items.select("item_id"), "item_id", "left_semi").join(again, "item_id", "left_anti").select(fresh.columns))
