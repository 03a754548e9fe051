"""Tree inference as Spark jobs: many starts, many trees or many moves are rows; each row is fitted in a task.

The matrix and priors of one data set are shared with the tasks; they are refused above SHARED_BYTES rather than sent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewright.functions import model, trees

SHARED_BYTES = 256 << 20
FITTED = "id long, nllh double, nu double, phi double, rounds int, newick string"


@dataclass
class Settings:
    """How trees are fitted; a given nu or phi is kept."""

    nu: float | None = None
    phi: float | None = None
    ultrametric: bool = False
    tolerance: float = 1e-8
    most_rounds: int = 1000


def data_from(characters: DataFrame, priors: DataFrame | None = None) -> model.Data:
    """The packed matrix of one data set from (cell, site, state) rows, null state for missing."""
    packed = characters.groupBy(F.col("cell").cast("string").alias("cell")).agg(F.transform(F.sort_array(F.collect_list(F.struct("site", "state"))), lambda x: x["state"]).alias("row"))
    rows = {r["cell"]: list(r["row"]) for r in packed.collect()}
    q = None
    if priors is not None:
        table: dict = {}
        for r in priors.orderBy("site", "state").collect():
            table.setdefault(r["site"], {})[r["state"]] = r["q"]
        q = [table[s] for s in sorted(table)]
    return model.data_of(rows, q)


def _shared(spark: SparkSession, data: model.Data):
    if data.states.nbytes + data.q.nbytes > SHARED_BYTES:
        raise ValueError(f"a matrix of {data.states.nbytes + data.q.nbytes} bytes is too large to share with tasks")
    return spark.sparkContext.broadcast(data)


def fit_all(jobs: DataFrame, data: model.Data, settings: Settings = Settings()) -> DataFrame:
    """Fits each row of jobs (id long, newick string, start_nu double, start_phi double)."""
    shared = _shared(jobs.sparkSession, data)

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples():
                tree, _ = trees.resolved(trees.parse_newick(r.newick))
                got = model.fit(tree, shared.value, settings.nu, settings.phi, (r.start_nu, r.start_phi), settings.ultrametric, None, settings.tolerance, settings.most_rounds)
                out.append((r.id, got.nllh, got.nu, got.phi, got.rounds, trees.write_newick(got.tree)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FITTED.split(", ")])

    return jobs.repartition(max(1, min(jobs.sparkSession.sparkContext.defaultParallelism, 64))).mapInPandas(run, FITTED)


def multi_start(spark: SparkSession, newick: str, data: model.Data, starts: int = 20, seed: int = 0, settings: Settings = Settings()) -> DataFrame:
    """Fits one tree from several starting rates; best first."""
    rng = np.random.default_rng(seed)
    rows = [(i, newick, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0.01, 0.5, (starts, 2)))]
    return fit_all(spark.createDataFrame(rows, "id long, newick string, start_nu double, start_phi double"), data, settings).orderBy("nllh", "id")


def score_moves(spark: SparkSession, moves: list[str], data: model.Data, nu: float, phi: float) -> list[tuple[float, str]]:
    """(nllh, newick) of each candidate after its lengths have been refitted; candidates are scored in parallel."""
    rows = [(i, t, nu, phi) for i, t in enumerate(moves)]
    got = fit_all(spark.createDataFrame(rows, "id long, newick string, start_nu double, start_phi double"), data, Settings(nu, phi, tolerance=1e-5, most_rounds=30)).collect()
    return [(r["nllh"], r["newick"]) for r in sorted(got, key=lambda r: r["id"])]


def search(spark: SparkSession, newick: str, data: model.Data, most_moves: int = 30, batch: int = 16, seed: int = 0, cool: float = 0.9, heat: float = 1.0, cold_at: int = 20) -> DataFrame:
    """Annealed search by nearest-neighbour interchange: (step, nllh, nu, phi, newick), one row per accepted tree.

    Candidates of shuffled inner edges are scored in batches and taken in that order: a better one always, a worse one
    with a probability that falls to nothing at step cold_at. The last row is the best tree, fitted in full.
    """
    rng = np.random.default_rng(seed)
    start = multi_start(spark, newick, data, 4, seed).first()
    now, nu, phi, best = start["nllh"], start["nu"], start["phi"], (start["nllh"], start["newick"])
    current, log = start["newick"], [(0, now, nu, phi, start["newick"])]
    for step in range(1, most_moves + 1):
        tree = trees.parse_newick(current)
        inner = [i for i in range(len(tree.parent) - 1) if i not in set(tree.leaves.tolist())]
        moves = [trees.write_newick(t) for e in rng.permutation(inner).tolist() for t in trees.nni_neighbours(tree, e)]
        taken = None
        for a in range(0, len(moves), batch):
            for value, text in score_moves(spark, moves[a : a + batch], data, nu, phi):
                limit = heat * max(0.0, cool**step - cool**cold_at) / (1 - cool**cold_at)
                if value < now - 1e-9 or (limit > 0 and rng.random() < np.exp(-(value - now) / limit)):
                    taken = (value, text)
                    break
            if taken:
                break
        if not taken:
            break
        now, current = taken
        best = min(best, taken)
        log.append((step, now, nu, phi, current))
    final = multi_start(spark, best[1], data, 4, seed).first()
    log.append((len(log), final["nllh"], final["nu"], final["phi"], final["newick"]))
    return spark.createDataFrame(log, "step int, nllh double, nu double, phi double, newick string")


def starting_tree(distances: DataFrame, root: str) -> str:
    """Neighbour joining of (a, b, d) rows; the matrix of one data set fits the driver, as joining is cubic in cells."""
    rows = distances.select(F.col("a").cast("string"), F.col("b").cast("string"), "d").collect()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at, m = {n: i for i, n in enumerate(names)}, np.zeros((len(names),) * 2)
    for a, b, d in rows:
        m[at[a], at[b]] = m[at[b], at[a]] = d
    return trees.write_newick(trees.neighbour_joining(names, m, root))
