"""Facts about the plan of a query, for tests and for tuning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Plan:
    text: str

    def count(self, node: str) -> int:
        """How often an operator stands in the plan's tree."""
        return len(re.findall(rf"^[\s:|+\-*()\d]*{node}\b", self.text.split("\n\n")[0], re.M))

    @property
    def exchanges(self) -> int:
        return self.count("Exchange")

    @property
    def python(self) -> int:
        return sum(self.count(n) for n in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow"))

    @property
    def pushed(self) -> list[str]:
        return re.findall(r"PushedFilters: \[([^\]]*)\]", self.text)

    @property
    def read(self) -> list[str]:
        return re.findall(r"ReadSchema: (\S+)", self.text)


def plan(df: DataFrame) -> Plan:
    """The formatted physical plan, before it runs."""
    return Plan(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
