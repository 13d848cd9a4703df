"""The engine: query text to DataFrames, violations, formatted text, findings and charts."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from querent.catalog.schema import Backend, Catalog
from querent.errors import InvalidQuery, QueryError, Violation
from querent.functions.registry import Registry
from querent.functions.standard import standard
from querent.lang.parser import parse
from querent.plans.analyze import Analysis
from querent.plans.compile import Compiler
from querent.plans.typing import Typing


class Engine:
    """Runs queries of one catalog. Without a session, everything that needs no data still works."""

    def __init__(self, catalog: Catalog, spark: SparkSession | None = None, tables=None, zone: str = "UTC", registry: Registry | None = None):
        """tables: a function from table names to DataFrames, a dict of them, or a folder with <name>.parquet."""
        self.catalog, self.spark, self.zone = catalog, spark, zone
        self.registry = registry or standard()
        if tables is None or callable(tables):
            read = tables
        elif isinstance(tables, dict):
            read = tables.__getitem__
        else:
            read = lambda name: spark.read.parquet(f"{tables}/{name}.parquet")
        self.backend = Backend(read, zone)

    # without data

    def analyse(self, text: str, values: dict | None = None) -> tuple[Analysis, Typing]:
        a = Analysis(parse(text), self.catalog, self.registry, text, values)
        return a, Typing(a)

    def validate(self, text: str, values: dict | None = None) -> list[Violation]:
        """Everything that is wrong with a query; a query that cannot be read or resolved has one violation."""
        try:
            return list(self.analyse(text, values)[0].violations)
        except QueryError as e:
            return [Violation("query", e.message, e.span)]

    def format(self, text: str, width: int = 80) -> str:
        from querent.lang.format import formatted

        return formatted(parse(text), width)

    def translate(self, text: str, other: Catalog, width: int = 80) -> str:
        """The query in the words of another model of the same tables."""
        from querent.lang.format import formatted
        from querent.lang.translate import translated

        return formatted(translated(parse(text), self.catalog, other), width)

    def findings(self, text: str, values: dict | None = None) -> list:
        """Role, unit, quantity and name of each output column."""
        from querent.insight.findings import findings

        a, types = self.analyse(text, values)
        return findings(a, types)

    # with data

    def explicit(self, text: str) -> DataFrame:
        """Runs a query in the explicit form (SELECT ... JOIN ... OWNER)."""
        from querent.lang.explicit_parser import parse_explicit

        a = Analysis(parse_explicit(text), self.catalog, self.registry, text)
        types = Typing(a)
        if a.violations:
            raise InvalidQuery(a.violations, text)
        return Compiler(self.spark, a, types, self.backend).query()

    def query(self, text: str, values: dict | None = None) -> DataFrame:
        a, types = self.analyse(text, values)
        if a.violations:
            raise InvalidQuery(a.violations, text)
        if a.query.description:
            self.spark.sparkContext.setJobDescription(a.query.description.splitlines()[0][:200])
        return Compiler(self.spark, a, types, self.backend).query()

    def sql(self, text: str) -> DataFrame:
        """Raw SQL over the catalog's tables by their names. Views of the session that have such a name stay as they are."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        used = set(re.findall(r"'UnresolvedRelation \[([^\],]+)\]", plan.toString())) & set(self.catalog.tables)
        mine = {t.name for t in self.spark.catalog.listTables() if t.isTemporary} & used
        before = {name: self.spark.table(name) for name in mine}
        try:
            for name in used:
                self.backend.frame(name).createOrReplaceTempView(name)
            return self.spark.sql(text)
        finally:
            for name in used:
                if name in before:
                    before[name].createOrReplaceTempView(name)
                else:
                    self.spark.catalog.dropTempView(name)

    def explain(self, text: str, values: dict | None = None) -> str:
        """The formatted plan of a query."""
        df = self.query(text, values)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def chart(self, text: str, values: dict | None = None) -> str:
        """The Vega-Lite specification of a query with a VISUALISE clause, with its data."""
        from querent.charts.vega import render

        a, types = self.analyse(text, values)
        if a.violations:
            raise InvalidQuery(a.violations, text)
        if a.query.chart is None:
            raise QueryError("the query has no VISUALISE clause", (0, 0), text)
        return render(a, types, Compiler(self.spark, a, types, self.backend).query())

    def check_chart(self, text: str, values: dict | None = None):
        """What rendering a chart would say, without data; never raises."""
        from querent.charts.vega import checked

        return checked(self, text, values)


def driver_engine(spark: SparkSession, sf_dir: str | Path) -> Engine:
    """The engine over the driver's tables."""
    from querent.catalog.builtin import catalog

    return Engine(catalog(), spark, str(sf_dir))
