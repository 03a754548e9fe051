"""Results and logs of many runs, from the lines of their files (file, block, line, value) as sources.lines numbers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewright.operators.stored import stored
from cladewright.sources.lines import counted_before, numbered_lines

#: What the lines of a result file begin with.
TREE, LLH, DROPOUT, SILENCING = "Optimal tree:", "Optimal negative-llh:", "Optimal dropout rate:", "Optimal silencing rate:"

#: What the lines of a search log hold.
ITERATION, CHECKED, SCORE, RUNTIME, BEST = "NNI Iter:", "Number of trees checked:", "Current score:", "Runtime (s):", "Optimal score for this search:"

#: Fixed value: a line of a log that compares solvers.
SOLVER_LINE = r"Current (\w+)_solver score: ([-\d.]+), ([-\d.]+), ([-\d.]+), (\d+\.\d+) seconds"


def _after(mark: str) -> Column:
    """What a line says behind the first colon, where it holds mark."""
    return F.when(F.col("value").contains(mark), F.trim(F.get(F.split("value", ":"), F.lit(1))))


def result_fields(lines: DataFrame) -> DataFrame:
    """(file, tree, llh, dropout, silencing): what result files say, the last line of a kind if there are several.

    A kind that a file does not have, or whose number cannot be read, is null.
    """
    def last(mark):
        told = F.when(F.startswith("value", F.lit(mark)), F.trim(F.substring("value", len(mark) + 1, 1 << 30)))
        return F.max_by(told, F.when(told.isNotNull(), F.col("line")))

    fields = lines.groupBy("file").agg(last(TREE).alias("tree"), *[last(m).try_cast("double").alias(n) for n, m in (("llh", LLH), ("dropout", DROPOUT), ("silencing", SILENCING))])
    return fields.select("file", "tree", "llh", "dropout", "silencing")


def compiled(fields: DataFrame, flags: tuple[str, ...] = ("nm", "bm", "nd", "ns")) -> DataFrame:
    """fields with rep_name and flag, from file names that end in _flag or _flag.txt; files of no such flag go."""
    name = r"([^/]*)_(" + "|".join(flags) + r")(?:\.txt)?$"
    told = fields.withColumns({"rep_name": F.regexp_extract("file", name, 1), "flag": F.regexp_extract("file", name, 2)})
    return told.filter("flag <> ''").select("rep_name", "flag", "tree", "llh", "dropout", "silencing")


def compile_results(spark: SparkSession, path: str | list[str], flags: tuple[str, ...] = ("nm", "bm", "nd", "ns")) -> DataFrame:
    """One row for each result file: compiled() of result_fields()."""
    return compiled(result_fields(numbered_lines(spark, path)), flags)


def search_statistics(lines: DataFrame) -> DataFrame:
    """(file, n_steps, n_trees, runtime_per_tree, trees_per_step, best): what search logs say of their steps.

    A step goes from one line of an iteration to the next, and what stands before the first is a step too; of several lines
    of a kind in a step the last counts, and a step without any is none. runtime_per_tree is 0 where no tree was checked.
    """
    starts = F.startswith("value", F.lit(ITERATION))
    told = counted_before(lines.select("file", "block", "line", "value"), starts, "earlier")
    told = told.withColumn("step", F.col("earlier") + starts.cast("int"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line")))
    number = lambda m: _after(m).try_cast("double")
    steps = told.groupBy("file", "step").agg(last(number(CHECKED)).cast("long").alias("trees"), last(number(SCORE)).alias("score"), last(number(RUNTIME)).alias("runtime"))
    real = steps.filter("trees is not null or score is not null or runtime is not null").groupBy("file")
    sums = real.agg(F.count(F.lit(1)).alias("n_steps"), F.sum("trees").alias("n_trees"), F.sum("runtime").alias("runtime"), F.avg("trees").alias("trees_per_step"))
    best = lines.groupBy("file").agg(last(number(BEST)).alias("best"))
    each = F.when(F.col("n_trees") > 0, F.col("runtime") / F.col("n_trees")).otherwise(0.0)
    return best.join(sums, "file", "left").select("file", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), "n_trees", each.alias("runtime_per_tree"), "trees_per_step", "best")


def solver_differences(lines: DataFrame, first: str = "oldEM", second: str = "fastEM") -> DataFrame:
    """(file, n_pairs, llh, phi, nu, first_seconds, second_seconds): how two solvers' scores differ, first less second.

    The k-th score of one solver in a file is compared with the k-th of the other; those without a counterpart count in the
    mean seconds only.
    """
    part = lambda k: F.regexp_extract("value", SOLVER_LINE, k)
    names = ("llh", "phi", "nu", "seconds")
    scores = F.struct(*[part(i + 2).try_cast("double").alias(n) for i, n in enumerate(names)]).alias("s")
    told = lines.filter(F.col("value").rlike(SOLVER_LINE)).select("file", "block", "line", part(1).alias("solver"), scores)
    # lines are read and parsed once; each count reads its rows several times
    told = stored(told.filter(F.col("solver").isin(first, second)))
    ranked = None
    for name, side in ((first, "a"), (second, "b")):
        mine = counted_before(told.filter(F.col("solver") == name), F.lit(True), "k")
        rows = mine.select("file", "k", F.lit(side).alias("side"), "s")
        ranked = rows if ranked is None else ranked.unionByName(rows)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("s")))
    pairs = ranked.groupBy("file", "k").agg(of("a").alias("a"), of("b").alias("b"))
    both = pairs.groupBy("file").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_pairs"), *[F.avg(F.col(f"a.{n}") - F.col(f"b.{n}")).alias(n) for n in names[:3]],
        F.avg("a.seconds").alias("first_seconds"), F.avg("b.seconds").alias("second_seconds"),
    )
    return both.select("file", "n_pairs", "llh", "phi", "nu", "first_seconds", "second_seconds")
