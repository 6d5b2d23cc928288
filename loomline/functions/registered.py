"""A registry of DataFrame functions with declared inputs, outputs, preconditions and checks, and a table function for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class SkillBlocked(Exception):
    """A call that must not run; ``code`` says why: unknown skill, budget gate, precondition, input or output."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Skill:
    """A function of named tables: the columns that each must have (name -> type), the columns that it returns, what must be there first, and checks of its rows."""

    name: str
    run: Callable[..., DataFrame]
    inputs: Mapping[str, Mapping[str, str]]
    outputs: Mapping[str, str]
    cost: str = "cheap"
    requires: Mapping[str, str] = field(default_factory=dict)  # node -> committed, or exists
    checks: Mapping[str, str] = field(default_factory=dict)  # name -> SQL condition that every row must meet

    def lacking(self, states: Mapping[str, str]) -> str:
        """The first precondition that the nodes' states do not meet, or nothing."""
        for node, wanted in self.requires.items():
            state = states.get(node, "not_started")
            if (wanted == "committed" and state != "committed") or (wanted == "exists" and state == "not_started"):
                return f"{node} is {state}"
        return ""


class Registry:
    """Skills by name. Everything that can be known without data is checked before Spark starts a job."""

    def __init__(self) -> None:
        self.skills: dict[str, Skill] = {}

    def register(self, skill: Skill) -> Skill:
        self.skills[skill.name] = skill
        return skill

    def runnable(self, states: Mapping[str, str], budget: str = "cheap") -> list[str]:
        """Names of the skills that the budget and the nodes' states allow."""
        return sorted(s.name for s in self.skills.values() if (budget == "any" or s.cost == "cheap") and not s.lacking(states))

    def validate(self, name: str, tables: Mapping[str, DataFrame], states: Mapping[str, str], budget: str = "cheap") -> Skill:
        """The skill, if it may run on these tables; else ``SkillBlocked``. Reads schemas only."""
        skill = self.skills.get(name)
        if skill is None:
            raise SkillBlocked("unknown_skill", name)
        if budget != "any" and skill.cost != "cheap":
            raise SkillBlocked("budget_gate", f"{name} is {skill.cost}")
        if lacking := skill.lacking(states):
            raise SkillBlocked("precondition", lacking)
        if set(tables) != set(skill.inputs):
            raise SkillBlocked("input", f"{name} takes the tables {sorted(skill.inputs)}")
        for table, columns in skill.inputs.items():
            _match(f"{name}.{table}", dict(tables[table].dtypes), columns, "input")
        return skill

    def run(self, name: str, states: Mapping[str, str] | None = None, budget: str = "cheap", **tables: DataFrame) -> DataFrame:
        """The skill's rows, its declared columns only; a row that fails a check fails the job that reads it."""
        skill = self.validate(name, tables, states or {}, budget)
        out = skill.run(**tables)
        _match(name, dict(out.dtypes), skill.outputs, "output")
        out = out.select(*skill.outputs)
        for check, condition in skill.checks.items():
            failed = F.raise_error(F.lit(f"{name}: a row fails {check}")).cast("boolean")
            out = out.where(F.when(F.expr(condition), True).otherwise(failed))
        return out


def _match(what: str, got: Mapping[str, str], wanted: Mapping[str, str], code: str) -> None:
    for column, kind in wanted.items():
        if got.get(column) != kind:
            raise SkillBlocked(code, f"{what}.{column} must be {kind}, is {got.get(column, 'absent')}")


class OverlappingWindows:
    """Windows of ``width`` over [lo, hi] that share ``shared`` with the next, the last one clipped: rows (i, s, e)."""

    def eval(self, lo: int, hi: int, width: int, shared: int) -> Iterator[tuple[int, int, int]]:
        if lo is None or hi is None or hi <= lo:
            return
        step = width - shared
        for i in range(max(1, -((lo + shared - hi) // step))):
            s = lo + i * step
            yield i, s, min(hi, s + width)


def register_table_functions(spark: SparkSession) -> None:
    """Make ``loom_windows(lo, hi, width, shared)`` known to the session's SQL."""
    spark.udtf.register("loom_windows", udtf(OverlappingWindows, returnType="i bigint, s bigint, e bigint"))


REGISTRY = Registry()


def _windows(spans: DataFrame) -> DataFrame:
    """Overlapping windows of each span by the table function."""
    register_table_functions(spans.sparkSession)
    return spans.sparkSession.sql("SELECT key, i, w.s, w.e FROM {spans}, LATERAL loom_windows(lo, hi, width, shared) w", spans=spans)


REGISTRY.register(
    Skill(
        "overlapping_windows",
        _windows,
        {"spans": {"key": "bigint", "lo": "bigint", "hi": "bigint", "width": "bigint", "shared": "bigint"}},
        {"key": "bigint", "i": "bigint", "s": "bigint", "e": "bigint"},
        requires={"spans": "committed"},
        checks={"order": "e > s", "place": "i >= 0"},
    )
)
