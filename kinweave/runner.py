"""Experiments: settings with overrides, a registry of named runs, their reports and the table of results."""

from __future__ import annotations

import ast
import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import queries as Q
from kinweave.operators import linkage as L
from kinweave.operators import profile, tuning
from kinweave.plans import matcher
from kinweave.sources import stage, tables


@dataclass(frozen=True)
class Matching:
    kind: str = "gbt"
    features: tuple[str, ...] = tuple(matcher.FEATURES)


@dataclass(frozen=True)
class Pruning:
    budget: float = 0.001
    enabled: bool = False


@dataclass(frozen=True)
class Config:
    matching: Matching = field(default_factory=Matching)
    pruning: Pruning = field(default_factory=Pruning)
    rule: L.Rule = Q.RULE


def configured(config: Config, overrides: list[str]) -> Config:
    """``config`` with settings of the form a.b=value, the value a Python literal or a text; unknown names raise."""
    for item in overrides:
        path, _, text = item.partition("=")
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError):
            value = text
        config = _changed(config, path.split("."), value)
    return config


def _changed(node: object, path: list[str], value: object) -> object:
    if not is_dataclass(node) or path[0] not in {f.name for f in fields(node)}:
        raise KeyError(f"there is no setting {'.'.join(path)}")
    inner = value if len(path) == 1 else _changed(getattr(node, path[0]), path[1:], value)
    return replace(node, **{path[0]: inner})


def config_id(config: Config) -> str:
    return stage.fingerprint(asdict(config))


@contextmanager
def timed(seconds: dict[str, float], name: str) -> Iterator[None]:
    start = time.perf_counter()
    yield
    seconds[name] = round(time.perf_counter() - start, 3)


def table(rows: DataFrame, most: int = 40) -> str:
    """A Markdown table of the first rows, numbers with four places: a report."""
    shown = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows.limit(most).collect()]
    lines = [rows.columns, ["-"] * len(rows.columns), *shown]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def run_blocking(spark: SparkSession, sf_dir: str, config: Config) -> dict:
    w, rows = Q.scored(spark, sf_dir)
    return {"candidates": L.candidate_statistics(w.queries, w.pool, rows.select("q_id", "p_id"), w.truth), "passes": Q.er_recall_by_pass(spark, sf_dir)}


def run_rules(spark: SparkSession, sf_dir: str, config: Config) -> dict:
    """Metrics of the configured rule over all queries, by country and by how many matches a query has."""
    w, rows = Q.scored(spark, sf_dir)
    judged = L.per_query(w.queries, L.decide(rows, config.rule), w.truth)
    return {"metrics": L.metrics(judged), "countries": L.metrics(judged, ("country",)), "diagnostics": profile.country_diagnostics(w.queries, rows, L.decide(rows, config.rule))}


def run_model(spark: SparkSession, sf_dir: str, config: Config) -> dict:
    """A matcher fitted on the fit fold, its rule chosen on the tuning fold, judged on the fold held back."""
    w, rows = Q.scored(spark, sf_dir)
    cut = None
    if config.pruning.enabled:
        rows, cut = matcher.prune(w, rows, config.pruning.budget)
    scores = matcher.fit_and_score(w, rows, config.matching.kind, list(config.matching.features))
    own = scores.join(rows.select("q_id", "p_id", "src"), ["q_id", "p_id"]).withColumnRenamed("probability", "p").persist()
    folds = tables.folds(w.queries.select("id"))
    of = lambda fold: tables.World(w.queries.join(folds.filter(F.col("fold") == fold).select("id"), "id", "left_semi"), w.pool, w.truth)
    tune = of("tune").queries.select(F.col("id").alias("q_id")).join(w.truth.groupBy("q_id").agg(F.count("*").alias("n_true")), "q_id", "left").fillna(0, ["n_true"])
    kind, rule, trials = tuning.choose_rule(own.filter("fold = 'tune'"), tune)
    chosen = tuning.apply_rule(own.filter("fold = 'hold'"), rule)
    judged = L.per_query(of("hold").queries, chosen, w.truth.join(of("hold").queries.select(F.col("id").alias("q_id")), "q_id", "left_semi"))
    return {"metrics": L.metrics(judged), "countries": L.metrics(judged, ("country",)), "calibration": profile.calibration(own), "auc": L.auc(own), "rule": {"kind": kind, "rule": str(rule), "cut": str(cut), **trials}}


#: Named runs: what they do and with which overrides.
EXPERIMENTS: dict[str, tuple[Callable[[SparkSession, str, Config], dict], tuple[str, ...]]] = {
    "blocking": (run_blocking, ()),
    "rule": (run_rules, ()),
    "trees": (run_model, ()),
    "linear": (run_model, ("matching.kind=lr",)),
    "pruned": (run_model, ("pruning.enabled=True",)),
}
#: Runs in order.
PLANS = {"short": ("blocking", "rule"), "full": ("blocking", "rule", "linear", "trees", "pruned")}


def run(spark: SparkSession, sf_dir: str, name: str, out: str, overrides: tuple[str, ...] = ()) -> dict:
    """Run an experiment; its report goes to ``out``/name.md, its figures to ``out``/summary.json."""
    runner, own = EXPERIMENTS[name]
    config, seconds = configured(Config(), [*own, *overrides]), {}
    with timed(seconds, "seconds"):
        found = runner(spark, sf_dir, config)
        parts = [f"# {name} ({config_id(config)})"] + [f"## {k}\n\n{table(v) if isinstance(v, DataFrame) else json.dumps(v)}" for k, v in found.items()]
        figures = found["metrics"].first().asDict() if "metrics" in found else found["candidates"].first().asDict()
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.md").write_text("\n\n".join(parts) + "\n")
    at = folder / "summary.json"
    known = json.loads(at.read_text()) if at.exists() else []
    row = {"exp": name, "config": config_id(config), "ts": time.time(), **seconds, **figures}
    at.write_text(json.dumps([*known, row], indent=1, default=str))
    return row


def run_plan(spark: SparkSession, sf_dir: str, plan: str, out: str) -> list[dict]:
    """The runs of a plan; a failed one is reported and the plan goes on."""
    rows = []
    for name in PLANS[plan]:
        try:
            rows.append(run(spark, sf_dir, name, out))
        except Exception as error:  # noqa: BLE001
            rows.append({"exp": name, "error": f"{type(error).__name__}: {error}"})
    return rows


def leaderboard(spark: SparkSession, out: str) -> DataFrame:
    """The last row of each experiment, the best first."""
    rows = json.loads((Path(out) / "summary.json").read_text())
    frame = spark.createDataFrame([(r["exp"], r["config"], float(r["ts"]), float(r["f05"]) if r.get("f05") is not None else None) for r in rows], "exp string, config string, ts double, f05 double")
    return tables.latest_runs(frame)
