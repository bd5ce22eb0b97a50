"""Running named steps over DataFrames, and one evaluation for each configuration of data sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from ..operators.records import switched_union


@dataclass(frozen=True)
class Step:
    """A step takes and returns the state, a dict of named results; a step that may fail is reported and passed over."""

    name: str
    run: Callable[[dict[str, Any]], dict[str, Any]]
    may_fail: bool = False


@dataclass
class Outcome:
    state: dict[str, Any] = field(default_factory=dict)
    log: list[tuple[str, str, str]] = field(default_factory=list)

    def report(self, spark: SparkSession) -> DataFrame:
        """(step, outcome, reason)."""
        return spark.createDataFrame(self.log, "step string, outcome string, reason string")


def run(steps: Sequence[Step], state: Mapping[str, Any] | None = None, *, start: str | None = None, skip: Sequence[str] = ()) -> Outcome:
    """Runs the steps in order, from ``start`` on and without those in ``skip``. An unknown name is an error, a failing step ends the run."""
    names = [s.name for s in steps]
    unknown = {*skip, *([start] if start else [])} - set(names)
    if unknown:
        raise ValueError(f"no step {', '.join(sorted(unknown))}; there are {', '.join(names)}")
    out = Outcome(dict(state or {}))
    for i, step in enumerate(steps):
        if step.name in skip or (start and i < names.index(start)):
            out.log.append((step.name, "skipped", ""))
            continue
        try:
            out.state |= step.run(out.state)
            out.log.append((step.name, "done", ""))
        except Exception as e:
            out.log.append((step.name, "failed", str(e)))
            if not step.may_fail:
                raise
    return out


# The data sources and the configurations to compare.
FOLDS = tuple(f"ccks_fold{i}" for i in range(5))
SOURCES = ("traindata", "ccks_json", "ccks_validate", *FOLDS, "train_txt", "msra_train", "msra_test")
CCKS = ("ccks_json", "ccks_validate", *FOLDS)
CONFIGURATIONS: dict[str, tuple[str, ...]] = {
    "config_1_traindata_only": ("traindata",),
    "config_2_ccks_only": CCKS,
    "config_3_train_txt_only": ("train_txt",),
    "config_4_traindata_ccks": ("traindata", *CCKS),
    "config_5_all_except_msra": ("traindata", *CCKS, "train_txt"),
    "config_6_all_data": SOURCES,
}


def switches(spark: SparkSession, configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS, sources: Sequence[str] = SOURCES) -> DataFrame:
    """(config, source, enabled): every configuration's switch of every source."""
    return spark.createDataFrame([(c, s, s in on) for c, on in configurations.items() for s in sources], "config string, source string, enabled boolean")


def per_configuration(data: DataFrame, source: str, evaluate: Callable[[DataFrame], DataFrame], configurations: Mapping[str, Sequence[str]]) -> DataFrame:
    """The rows of ``evaluate`` on the enabled sources of each configuration, with its name."""
    out = None
    for name, on in configurations.items():
        part = evaluate(data.where(F.col(source).isin(*on))).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["CONFIGURATIONS", "SOURCES", "Outcome", "Step", "per_configuration", "profile", "run", "switched_union", "switches"]
