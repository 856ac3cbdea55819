"""Small deterministic simulations: one row a run, so runs spread over the cluster."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexwave.sources import lexicon as X


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def transmission(runs: DataFrame, n: int = 6, steps: int = 12, start: float = 0.85, threshold: float = 0.25) -> DataFrame:
    """runs: (run_id, beta, gamma, hybrid). Adoption over n communities in a row, step by step, in one expression."""
    eff = F.least(F.lit(1.0), F.col("beta") * (0.55 + 0.9 * F.col("hybrid")))
    first = F.array(*[F.lit(start if i == 0 else 0.0) for i in range(n)])

    def advance(state: Column) -> Column:
        out = []
        for j in range(n):
            weights = [(1.0 / abs(i - j) if abs(i - j) <= 2 else 0.08 / abs(i - j)) if i != j else 0.0 for i in range(n)]
            inflow = sum((state[i] * w for i, w in enumerate(weights) if w), F.lit(0.0)) / max(1, n - 1)
            growth = F.col("eff") * inflow * (1 - state[j]) * (1 - (0.05 + 0.12 * j / max(1, n - 1)))
            out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), state[j] + growth - F.col("gamma") * state[j])))
        return F.array(*out)

    mean = lambda state: F.round(_sum(state) / n, 4)
    # transform over one element binds the new state to a name, so that it is computed once
    step = lambda acc, _: F.transform(F.array(advance(acc["state"])), lambda new: F.struct(new.alias("state"), F.concat(acc["means"], F.array(mean(new))).alias("means")))[0]
    rows = runs.withColumn("eff", eff).withColumn("sim", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(first.alias("state"), F.array(mean(first)).alias("means")), step))
    rows = rows.withColumn("means", F.col("sim.means"))
    means = F.col("means")
    last, most = F.element_at(means, -1), F.array_max(means)
    tail = F.slice(means, -3, 3)
    mu = _sum(tail) / 3
    return rows.select(
        "run_id", "beta", "gamma", "hybrid", last.alias("final_mean"), F.greatest(F.lit(start), most).alias("peak"), F.when(most > start, F.array_position(means, most) - 1).otherwise(0).alias("time_to_peak"), most.alias("max_mean"),
        (F.aggregate(F.col("sim.state"), F.lit(0), lambda s, x: s + (x >= threshold).cast("int")) / n).alias("reach"), (_sum(F.transform(tail, lambda m: F.pow(m - mu, 2))) / 3 < 0.002).alias("stabilizing"),
    )


def population(n: int, mix: list[int] | None) -> list[tuple[str, float, float]]:
    base = sum(r[3] for r in X.ROLES)
    counts = mix if mix is not None else [max(1, round(n * r[3] / base)) for r in X.ROLES]
    agents = [(role, t, b) for (role, t, b, _), k in zip(X.ROLES, counts, strict=True) for _ in range(k)]
    if mix is None:
        pad = next((r, t, b) for r, t, b, _ in X.ROLES if r == "mainstream")
        agents = agents[:n] + [pad] * max(0, n - len(agents))
    return agents


def adoption(name: str, n: int, steps: int, seeds: int, influence: float, decay: float, mix: list[int] | None, memetic: float = 0.0) -> list[tuple[str, int, int, float, dict[str, int]]]:
    """(scenario, step, adopters, rate, adopters by role): agents adopt once their exposure reaches their threshold."""
    agents = population(n, mix)
    scale = 1.0 - 0.15 * memetic
    first = [i for i, a in enumerate(agents) if a[0] == "innovator"][:seeds]
    first += [i for i in range(len(agents)) if i not in first][: max(0, seeds - len(first))]
    adopted, exposure, out = set(first), [0.0] * len(agents), []
    for step in range(steps + 1):
        out.append((name, step, len(adopted), round(len(adopted) / len(agents), 4), dict(sorted(Counter(agents[i][0] for i in adopted).items()))))
        field = sum(agents[i][2] for i in adopted) / len(agents)
        new = set()
        for i, (_, threshold, _) in enumerate(agents):
            if i not in adopted:
                exposure[i] = max(0.0, exposure[i] * (1.0 - decay) + influence * field)
                if exposure[i] >= threshold * scale:
                    new.add(i)
        adopted |= new
    return out


def scenarios(spark: SparkSession) -> DataFrame:
    """Every preset's adoption by step."""
    presets = spark.createDataFrame(X.PRESETS, "name string, n int, steps int, seeds int, influence double, decay double, mix array<int>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for p in pdf.itertuples(index=False) for r in adoption(p.name, p.n, p.steps, p.seeds, p.influence, p.decay, None if p.mix is None else [int(x) for x in p.mix])]
            yield pd.DataFrame(rows, columns=["scenario", "step", "n_adopted", "rate", "by_role"])

    return presets.mapInPandas(run, "scenario string, step int, n_adopted int, rate double, by_role map<string, int>")


def ranked(history: DataFrame) -> DataFrame:
    """A row a scenario, best first by rank: final rate, step of half adoption, and whether a cascade came about (half adopted,
    the mainstream or amplifiers among them)."""
    last = F.max_by(F.struct("rate", "n_adopted", "by_role"), "step")
    out = history.groupBy("scenario").agg(last.alias("f"), F.min(F.when(F.col("rate") >= 0.5, F.col("step"))).alias("time_to_half"))
    wide = F.map_contains_key("f.by_role", F.lit("mainstream")) | F.map_contains_key("f.by_role", F.lit("amplifier"))
    out = out.select("scenario", F.col("f.rate").alias("final_rate"), F.col("f.n_adopted").alias("final_adopted"), "time_to_half", ((F.col("f.rate") >= 0.5) & wide).alias("cascade"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_rate"), "scenario")))


def default_cascades(spark: SparkSession) -> DataFrame:
    """(memetic, agent_rate, cascade): the default population's end by memetic score in hundredths, 101 rows."""
    rows = [(m, (last := adoption("", 20, 15, 2, 0.22, 0.05, None, m / 100)[-1])[3], last[3] >= 0.5 and bool({"mainstream", "amplifier"} & set(last[4]))) for m in range(101)]
    return spark.createDataFrame(rows, "memetic int, agent_rate double, cascade boolean")


def grid_search(pairs: DataFrame, betas: list[float], gammas: list[float]) -> DataFrame:
    """Mean absolute error of the peak against outcomes for each cell."""
    cells = [(i, b, g) for i, (b, g) in enumerate((b, g) for b in betas for g in gammas)]
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for i, b, g in cells]))
    runs = pairs.select(F.col("run_id").alias("pair"), "hybrid", "outcome", grid.alias("c")).select("pair", "hybrid", "outcome", "c.*")
    sim = transmission(runs.withColumn("run_id", F.struct("pair", "cell", "outcome")))
    return sim.groupBy(F.col("run_id.cell").alias("cell"), "beta", "gamma").agg(F.round(F.avg(F.abs(F.col("peak") - F.col("run_id.outcome"))), 6).alias("mae"), F.count(F.lit(1)).alias("n"))


def best_cells(cells: DataFrame, most: int = 5) -> DataFrame:
    """The cells of least error, ranked; the first of equal ones wins."""
    return cells.withColumn("rank", F.row_number().over(Window.orderBy("mae", "cell"))).filter(F.col("rank") <= most)
