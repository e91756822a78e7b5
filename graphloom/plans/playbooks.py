"""Routing a goal to a playbook, and running it as one composition of operators."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup, search
from graphloom.plans import context

# Playbooks, and budgets of modes: classifier seconds, items, depth, files, seconds.
PLAYBOOKS = ("DISCOVER", "UNDERSTAND", "RELATIONSHIPS", "REFERENCES", "INSPECT_FILES", "IMPACT", "INVENTORY")
BUDGETS = {"fast": (0.15, 5, 1, 1, 1.0), "balanced": (0.5, 10, 2, 3, 7.0), "thorough": (1.0, 20, 3, 5, 35.0)}
EVIDENCE = "kind string, id string, position long, name string, node_type string, file_path string, start_line long, end_line long, stage string"
#: Positions of a stage, and rows of an answer.
STAGE, EVIDENCE_ROWS = 1 << 40, 2000


@dataclass(frozen=True)
class Request:
    goal: str
    file_paths: tuple[str, ...] = ()
    source_position: tuple[str, int] | None = None
    node_ids: tuple[str, ...] = ()
    symbol_name: str | None = None
    node_type: str | None = None
    vector: tuple[float, ...] = ()
    mode: str = "balanced"
    limit: int = 10

    def __post_init__(self) -> None:
        if not self.goal.strip() or self.mode not in BUDGETS or not 1 <= self.limit <= 50:
            raise ValueError("a request needs a goal, a known mode and a limit from 1 to 50")


@dataclass(frozen=True)
class Decision:
    playbook: str
    confidence: float = 1.0
    probabilities: dict[str, float] = field(default_factory=dict)
    model: str = "deterministic"


class DecisionProvider(Protocol):
    def classify(self, request: Request) -> Decision: ...


def eligible(request: Request) -> tuple[str, ...]:
    """The playbooks whose anchors the request has."""
    no = set()
    if not request.file_paths:
        no.add("IMPACT")
    if not (request.source_position or request.node_ids or request.symbol_name):
        no.add("REFERENCES")
    if request.node_type is not None and request.node_type not in lookup.SYMBOL_TYPES:
        no.add("INVENTORY")
    return tuple(p for p in PLAYBOOKS if p not in no)


def eligible_columns(requests: DataFrame) -> DataFrame:
    """eligible() for rows (files: int, anchored: boolean, node_type)."""
    no = [F.when(F.col("files") == 0, "IMPACT"), F.when(~F.col("anchored"), "REFERENCES"), F.when(F.col("node_type").isNotNull() & ~F.col("node_type").isin(*lookup.SYMBOL_TYPES), "INVENTORY")]
    return requests.withColumn("eligible", F.array_join(F.array_except(F.array(*[F.lit(p) for p in PLAYBOOKS]), F.array_compact(F.array(*no))), ","))


def check_probabilities(p: dict[str, float]) -> None:
    if set(p) != set(PLAYBOOKS) or not all(math.isfinite(v) and v >= 0 for v in p.values()) or abs(sum(p.values()) - 1) > 0.01:
        raise ValueError("probabilities must cover all playbooks and add up to 1")


class Deterministic:
    """Always the conservative search."""

    def classify(self, request: Request) -> Decision:
        return Decision("DISCOVER", 1.0, {p: float(p == "DISCOVER") for p in PLAYBOOKS})


def route(request: Request, provider: DecisionProvider | None = None) -> tuple[Decision, bool]:
    """The provider's decision, or the deterministic one (True) where it fails or isn't eligible."""
    try:
        decision = (provider or Deterministic()).classify(request)
        check_probabilities(decision.probabilities)
        if decision.playbook in eligible(request):
            return decision, False
    except (ValueError, TimeoutError, OSError):
        pass
    return Deterministic().classify(request), True


def evidence(rows: DataFrame, kind: str, stage: str, *order: Column, limit: int | None = None) -> DataFrame:
    """Rows as evidence of a stage: kind, id, name, node_type, file_path and lines (its own or its metadata's), stage.

    With an order and a limit, position is the row's place among the stage's first rows; else it is a hash of the id,
    which orders any number of rows without bringing them together.
    """
    has = set(rows.columns)

    def col(name: str, to: str = "string") -> Column:
        own = F.col(name).cast(to) if name in has else F.lit(None).cast(to)
        return F.coalesce(own, F.col("metadata").getItem(name).cast(to)) if "metadata" in has else own

    if limit is not None:
        order = order or (F.col("id").asc(),)
        rows = rows.orderBy(*order).limit(limit)
        position = F.row_number().over(Window.orderBy(*order)).cast("long")  # `limit` rows
    else:
        position = F.pmod(F.xxhash64("id"), F.lit(STAGE))
    return rows.select(F.lit(kind).alias("kind"), F.col("id"), F.col("name"), (F.col("type") if "type" in has else F.lit(None).cast("string")).alias("node_type"), col("file_path").alias("file_path"), col("start_line", "long").alias("start_line"), col("end_line", "long").alias("end_line"), F.lit(stage).alias("stage"), position.alias("position"))


def deduplicated(rows: DataFrame, keys: tuple[str, ...] = ("kind", "id")) -> DataFrame:
    """Each key once: at its first position, with its last payload."""
    rest = [c for c in rows.columns if c not in (*keys, "position")]
    by = rows.groupBy(*keys).agg(F.min("position").alias("position"), F.max_by(F.struct(*rest), "position").alias("last"))
    return by.select(*keys, "position", *[F.col(f"last.{c}").alias(c) for c in rest])


def complete(truncated: Column, degraded: Column, fallback: Column) -> Column:
    """Whether an answer lacks nothing: nothing was cut, no stage failed, the router had its way."""
    return ~(truncated | degraded | fallback)


class Choice:
    """A provider that asks an external service: ask(request, eligible playbooks) -> its answer.

    The answer is taken strictly: model, choice, confidence, and a probability for each eligible playbook and no other.
    """

    def __init__(self, model: str, ask: Callable[[Request, tuple[str, ...]], Mapping]):
        self.model, self.ask = model, ask

    def classify(self, request: Request) -> Decision:
        able = eligible(request)
        answer = dict(self.ask(request, able))
        if set(answer) != {"model", "choice", "confidence", "probabilities"}:
            raise ValueError("an answer has a model, a choice, a confidence and probabilities")
        if answer["model"] != self.model:
            raise ValueError("the model isn't the configured one")
        if set(answer["probabilities"]) != set(able):
            raise ValueError("an answer needs a probability for each eligible playbook")
        if answer["choice"] not in able:
            raise ValueError("the chosen playbook isn't eligible")
        return Decision(answer["choice"], float(answer["confidence"]), {p: float(answer["probabilities"].get(p, 0.0)) for p in PLAYBOOKS}, self.model)


@dataclass
class Answer:
    """A playbook's evidence, and whether it lacks something."""

    rows: DataFrame
    decision: Decision
    fallback: bool
    truncated: bool = False
    degraded: tuple[str, ...] = ()
    seconds: float = 0.0

    @property
    def complete(self) -> bool:
        return not (self.truncated or self.degraded or self.fallback)


def route_within(request: Request, provider: DecisionProvider | None, seconds: float) -> tuple[Decision, bool]:
    """route(), with the conservative decision if the provider takes longer."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(route, request, provider).result(seconds)
    except FutureTimeout:
        return Deterministic().classify(request), True
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def answer(spark: SparkSession, nodes: DataFrame, edges: DataFrame, request: Request, provider: DecisionProvider | None = None) -> Answer:
    """A request's evidence within its mode's seconds; stages that fail or are late are named, not raised."""
    classify, items, _, _, total = BUDGETS[request.mode]
    began = time.monotonic()
    decision, fallback = route_within(request, provider, classify)
    group = f"playbook-{uuid.uuid4().hex}"
    pool = ThreadPoolExecutor(1)

    def collected() -> list:
        spark.sparkContext.setJobGroup(group, decision.playbook, interruptOnCancel=True)
        return run(spark, nodes, edges, request, _Decided(decision))[0].orderBy("position").limit(EVIDENCE_ROWS + 1).collect()

    empty = spark.createDataFrame([], EVIDENCE)
    try:
        rows = pool.submit(collected).result(max(0.0, total - (time.monotonic() - began)))
        kept = spark.createDataFrame(rows[:EVIDENCE_ROWS], EVIDENCE)
        return Answer(kept, decision, fallback, len(rows) > EVIDENCE_ROWS, (), time.monotonic() - began)
    except FutureTimeout:
        spark.sparkContext.cancelJobGroup(group)
        return Answer(empty, decision, fallback, False, (decision.playbook.lower(),), time.monotonic() - began)
    except (PySparkException, ValueError) as e:
        return Answer(empty, decision, fallback, False, (f"{decision.playbook.lower()}: {type(e).__name__}",), time.monotonic() - began)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class _Decided:
    """A provider whose decision is made."""

    def __init__(self, decision: Decision):
        self.decision = decision

    def classify(self, request: Request) -> Decision:
        return self.decision


def run(spark: SparkSession, nodes: DataFrame, edges: DataFrame, request: Request, provider: DecisionProvider | None = None) -> tuple[DataFrame, Decision, bool]:
    """(evidence, decision, fallback): the chosen playbook's evidence, all stages lazily in one plan."""
    decision, fallback = route(request, provider)
    _, items, depth, files, _ = BUDGETS[request.mode]
    items = min(items, request.limit)
    named = lambda ids: lookup.by_ids(nodes, ids)
    given = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    found = search.by_name(nodes, request.symbol_name or request.goal, items)
    seeds = given(request.node_ids, "id") if request.node_ids else found.select("id")
    if decision.playbook == "DISCOVER":
        stages = [evidence(found, "symbol", "search", *search.name_order(request.symbol_name or request.goal), limit=items)]
    elif decision.playbook in ("UNDERSTAND", "RELATIONSHIPS"):
        around = context.related(edges, seeds, depth).select("id").distinct()
        stages = [evidence(named(around), "node", "related", limit=20 * items)]
        if decision.playbook == "UNDERSTAND":
            stages.insert(0, evidence(found, "symbol", "search", limit=items))
    elif decision.playbook == "REFERENCES":
        if request.source_position:
            at = spark.createDataFrame([request.source_position], "file_path string, line int")
            hit = graph.references(nodes, edges, at).select(F.col("source_id").alias("id"))
        else:
            ways = [graph.traverse(edges, seeds, 1, "in", r).filter("depth > 0") for r in graph.DEPENDENCY]
            hit = reduce(DataFrame.unionByName, ways).select("id")
        stages = [evidence(named(hit.join(seeds, "id", "left_anti")), "reference", "references")]
    elif decision.playbook == "INSPECT_FILES":
        # The nodes of each file in their order, and what the first edges of these lead to.
        stages = []
        for p in request.file_paths[:files]:
            own, around = graph.inspect_file(nodes, edges, p, 50)
            ends = around.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
            stages += [evidence(own, "symbol", f"inspect {p}", *graph.inspection_order(), limit=50), evidence(named(ends.join(own.select("id"), "id", "left_anti")), "relationship", f"edges {p}", limit=200)]
        stages = stages or [evidence(found, "symbol", "search", limit=items)]
    elif decision.playbook == "IMPACT":
        risk = graph.regression_risk(nodes, edges, given(request.file_paths, "file_path"))
        stages = [evidence(risk.filter("not is_test"), "dependent", "impact", limit=1000), evidence(risk.filter("is_test"), "test_target", "impact", limit=50)]
    else:
        stages = [evidence(lookup.symbols(nodes, request.node_type or "function", items)[0], "symbol", "inventory", limit=items)]
    rows = [s.withColumn("position", F.col("position") + STAGE * k) for k, s in enumerate(stages)]
    return deduplicated(reduce(DataFrame.unionByName, rows)), decision, fallback
