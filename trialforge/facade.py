"""One batch or view, with its tables, statistics and figure data, and a report that isolates failures."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from trialforge.operators import filters, pairwise, plotdata, tables
from trialforge.sources import readers, sinks

#: Named groups of report items.
GROUPS = {"quick": ["overall_summary", "rank_table", "win_rate"], "paper": ["overall_summary", "rank_table", "win_rate", "significance", "correlation", "pareto"]}


class Analysis:
    """Queries over one frame of derived runs. Every method is lazy and returns a DataFrame unless it says otherwise."""

    def __init__(self, runs: DataFrame, config: dict[str, Any] | None = None, name: str = "batch"):
        self.runs, self.config, self.name = runs, config or {}, name

    @classmethod
    def load(cls, spark: SparkSession, batch_dir: str) -> Analysis:
        runs, config = readers.load_batch(spark, batch_dir)
        return cls(runs, config, os.path.basename(os.path.normpath(batch_dir)))

    @classmethod
    def view(cls, spark: SparkSession, spec: dict[str, Any], root: str) -> Analysis:
        """A union of filtered batches: {"name", "sources": [{"batch", "filters"}]}; the timeout is the greatest."""
        parts, configs = [], []
        for source in spec["sources"]:
            path = readers.resolve_batch(root, source["batch"])
            runs, config = readers.load_batch(spark, path)
            parts.append((runs, source.get("filters") or {}, os.path.basename(path)))
            configs.append(config)
        merged = dict(configs[0]) | {"timeout": max(float(c.get("timeout", 60)) for c in configs)}
        return cls(filters.view(parts), merged, spec.get("name", "view"))

    def filter_graphs(self, graphs: str | None = None, category: str | None = None) -> Analysis:
        return Analysis(filters.graph_filter(self.runs, graphs, category), self.config, self.name)

    def shared(self, algorithms: list[str]) -> Analysis:
        return Analysis(filters.shared_graphs(self.runs, algorithms), self.config, self.name)

    def items(self, metric: str = "avg_chain_length") -> dict[str, Any]:
        r = self.runs
        return {
            "overall_summary": lambda: tables.overall_summary(r),
            "summary_by_category": lambda: tables.summary_by_category(r, metric),
            "rank_table": lambda: tables.rank_table(r, metric),
            "win_rate": lambda: pairwise.win_rate_matrix(r, metric),
            "significance": lambda: pairwise.significance_tests(r, metric),
            "correlation": lambda: tables.correlation_matrix(r),
            "density_hardness": lambda: tables.density_hardness(r, metric),
            "heatmap": lambda: plotdata.category_heatmap(r, metric),
            "scaling": lambda: plotdata.scaling_trend(r),
            "pareto": lambda: plotdata.pareto_front(plotdata.pareto_points(r)),
            "consistency": lambda: plotdata.consistency(r),
            "topologies": lambda: plotdata.topology_comparison(r, metric),
        }

    def report(self, out: str, group: str | None = None, overwrite: bool = False) -> dict[str, str]:
        """CSV and TeX of each item, and an index. An item that fails is noted, and the others go on."""
        states = {}
        for name, make in self.items().items():
            if group and name not in GROUPS[group]:
                continue
            try:
                df = make()
                fresh = sinks.write_if_absent(os.path.join(out, f"{name}.csv"), sinks.csv_text(df, "%.15g"), overwrite)
                sinks.write_if_absent(os.path.join(out, f"{name}.tex"), sinks.latex(df, name), overwrite)
                states[name] = "written" if fresh else "kept"
            except Exception as e:
                states[name] = f"failed: {e}".splitlines()[0]
        sinks.write_if_absent(os.path.join(out, "report.md"), f"# {self.name}\n\n" + "".join(f"- {k}: {v}\n" for k, v in states.items()), True)
        return states
