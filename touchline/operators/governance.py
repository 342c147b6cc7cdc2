"""Licences of models, content hashes of configurations, and the registry of stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a licence. The first list wins.
RESTRICTED = ["agpl", "gpl", "non-commercial", "noncommercial", "non commercial", "by-nc", "cc-by-nc", "research-only", "research only", "non-shippable", "selection-only", "proprietary"]
PERMISSIVE = ["apache", "mit", "bsd", "isc", "cc0", "public domain", "public-domain", "unlicense", "cc by", "cc-by", "synthetic", "owned", "self-recorded", "permissive"]


def licence_class(value: Column) -> Column:
    """permissive, non_permissive, or unknown for anything else: unknown never passes."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.when((text == "") | (text == "unknown"), "unknown").when(has(RESTRICTED), "non_permissive").when(has(PERMISSIVE), "permissive").otherwise("unknown")


def certify(models: DataFrame) -> DataFrame:
    """Per run, whether every axis of every model is permissive, and how many are not. models: run_id, stage, model, axis, value."""
    rows = models.withColumn("verdict", licence_class(F.col("value")))
    bad = F.count(F.when(F.col("verdict") != "permissive", 1))
    return rows.groupBy("run_id").agg((bad == 0).alias("passed"), bad.alias("n_findings"))


def findings(models: DataFrame) -> DataFrame:
    """The axes that keep a run from passing."""
    return models.withColumn("verdict", licence_class(F.col("value"))).where("verdict <> 'permissive'")


def config_hash(settings: DataFrame) -> DataFrame:
    """A hash of each configuration that does not depend on the order of its settings. settings: config, path, value."""
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat(F.to_json(F.struct("path", "value"))))), ",")
    return settings.groupBy("config").agg(F.substring(F.sha1(pairs), 1, 12).alias("hash"), F.sha2(pairs, 256).alias("sha256"))


Stage = Callable[..., DataFrame]
_STAGES: dict[tuple[str, str], Stage] = {}


def stage(slot: str, name: str) -> Callable[[Stage], Stage]:
    """Register an implementation of a slot; a name is taken once."""

    def register(function: Stage) -> Stage:
        if (slot, name) in _STAGES:
            raise ValueError(f"{slot}/{name} is registered already")
        _STAGES[slot, name] = function
        return function

    return register


def build(slot: str, name: str) -> Stage:
    if (slot, name) not in _STAGES:
        raise KeyError(f"no {slot} stage {name!r}; there are {sorted(n for s, n in _STAGES if s == slot)}")
    return _STAGES[slot, name]


def registered() -> list[tuple[str, str]]:
    return sorted(_STAGES)
