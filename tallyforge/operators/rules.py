"""Weak-label rules as a small table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

CHAIN, SET, FAMILY = "ordered_chain", "any_order_set", "family_sequence"

@dataclass(frozen=True)
class Rule:
    technique_id: str
    rule_name: str
    mode: str
    apis: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    min_len: int = 2
    singleton: bool = True
    caveat: str = ""


# Technique ids, rule names, API names and prefixes are the published rule set.
WINDOWS_API_RULES = (
    Rule("T1055", "process_injection", CHAIN,
         apis=("OpenProcess", "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread"),
         singleton=False,
         caveat="names and order only: injection into itself and into another process look the same"),
    Rule("T1547", "persistence", SET,
         apis=("RegSetValueExW", "RegSetValueExA", "CreateServiceW", "CreateServiceA")),
    Rule("T1071", "c2_communication", FAMILY, prefixes=("Internet", "WinHttp")),
    Rule("T1497", "anti_analysis", SET,
         apis=("IsDebuggerPresent", "CheckRemoteDebuggerPresent", "NtQueryInformationProcess")),
)


def rule_table(spark: SparkSession, rules: Iterable[Rule] = WINDOWS_API_RULES) -> DataFrame:
    """The rules as rows of literals, so that the planner knows how small the table is."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rows = [F.struct(
        F.lit(r.technique_id).alias("technique_id"), F.lit(r.rule_name).alias("rule_name"), F.lit(r.mode).alias("mode"),
        names(r.apis).alias("apis"), names(r.prefixes).alias("prefixes"), F.lit(r.min_len).alias("min_len"),
        F.lit(r.singleton).alias("singleton"), F.lit(r.caveat).alias("caveat")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
