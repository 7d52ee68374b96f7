"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD, fresh, join_groups
from termloom.plans.staging import write_stage

SHARES = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2.0
SEED = 17
# A source's keys are summed in so many ranges; only the range at the cut is sorted.
RANGES = 4096


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1]: less, the more of the text is symbols."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return 1.0 / (1.0 + 20.0 * symbols / (F.length(text) + 1.0))


def _keyed(docs: DataFrame, id_column: str, text_column: str, source: str, seed: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with size, exponential key, range of the key and the two columns that settle ties."""
    size, key, part, tie, crc = fresh(docs, "mix_size", "mix_key", "mix_range", "mix_tie", "mix_crc")
    text = F.coalesce(F.col(text_column), F.lit(""))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    uniform = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 1.0) / (2.0**52 + 1.0)
    keyed = docs.withColumns(
        {
            size: F.regexp_count(text, F.lit(WORD)).cast("long"),
            tie: F.md5(name),
            key: -F.log(uniform) / quality_weight(F.col(text_column)),
            crc: F.crc32(text.cast("binary")),
        }
    )
    ranged = keyed.withColumn(part, F.floor((1.0 - F.exp(-F.col(key))) * RANGES).cast("int"))
    return ranged, [size, key, part, tie, crc]


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): shares by weight, none above twice its source.

    What lies above a source's limit is shared by weight among the others until none is above: all
    sources below their limit get the same tokens per weight. ``sizes`` has one row per source
    (source, source_size) and is ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(x) for x in SHARES])
    ranked = sizes.withColumn("weight", F.get(weights, (F.row_number().over(order) - 1) % len(SHARES)))
    limited = ranked.withColumns(
        {"most": MOST * F.col("source_size"), "ratio": MOST * F.col("source_size") / F.col("weight")}
    )
    all_ = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (TOTAL * F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = limited.withColumn("level", level)
    # The first source in order of ratio whose limit is not reached gives the level of all.
    found = levelled.withColumn(
        "level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                          F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(all_)
    )
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return found.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = SEED,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with how often each row is taken, and the names of the added columns by meaning.

    Method: a source's target holds complete epochs first; the rest is filled by the documents with
    the smallest exponential keys, scaled by quality weight, until their sizes reach it. Keys follow
    from the seed and the id, so reruns agree. The sums up to the cut are kept by range of keys, and
    only the rows of the range at the cut are sorted. What is taken by then is a filter on the key,
    so the texts themselves are never shuffled while there are few sources.

    A null or blank text has size 0; null sources are one source, the last; null ids share one key
    and are told apart by their texts; rows equal in id and text are taken or left together; an empty
    table gives no rows.
    """
    keyed, (size, key, part, tie, crc) = _keyed(docs, id_column, text_column, source_column, seed)
    thin = write_stage(
        keyed.select(F.col(source_column).alias("source"), F.col(size).alias("size"), F.col(key).alias("key"),
                     F.col(part).alias("part"), F.col(tie).alias("tie"), F.col(crc).alias("crc")),
        "mix",
    )
    sums = write_stage(thin.groupBy("source", "part").agg(F.sum("size").alias("size")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    budget = F.when(F.col("source_size") > 0, F.col("target") - epochs * F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumns({"epochs": epochs.cast("int"), "budget": budget})
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("upto", F.sum("size").over(upto)).alias("r")
    t = targets.alias("t")
    cut = (
        running.join(t, F.col("r.source").eqNullSafe(F.col("t.source")))
        .filter(F.col("r.upto") > F.col("t.budget"))
        .groupBy(F.col("t.source").alias("source"))
        .agg(F.min_by(F.struct(F.col("r.part").alias("part"), (F.col("r.upto") - F.col("r.size")).alias("before"),
                               F.col("t.budget").alias("budget")), F.col("r.part")).alias("cut"))
        .select("source", "cut.*")
    )
    at_cut = join_groups(thin, cut.withColumnsRenamed({"part": "cut_part"}), ["source"])
    at_cut = at_cut.filter(F.col("part") == F.col("cut_part"))
    sofar = Window.partitionBy("source").orderBy("key", "tie", "crc").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        at_cut.withColumn("begin", F.col("before") + F.sum("size").over(sofar) - F.col("size"))
        .filter(F.col("begin") + F.col("size") / 2 <= F.col("budget"))
        .groupBy("source")
        .agg(F.max(F.struct("key", "tie", "crc")).alias("last"))
    )
    c, l = cut.alias("c"), last.alias("l")
    plan = (
        targets.alias("t")
        .join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .join(l, F.col("t.source").eqNullSafe(F.col("l.source")), "left")
        .select("t.source", "t.source_size", "t.target", "t.epochs", F.col("c.part").alias("cut_part"), "l.last")
    )
    names = ("source_size", "target", "epochs", "cut_part", "last")
    added = dict(zip(names, fresh(keyed, *(f"mix_{n}" for n in names))))
    plan = plan.withColumnsRenamed(added).withColumnRenamed("source", source_column)
    joined = join_groups(keyed, plan, [source_column])
    whole = F.coalesce(F.col(part) < F.col(added["cut_part"]), F.lit(False))
    chosen = F.coalesce(F.struct(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(crc).alias("crc")) <= F.col(added["last"]), F.lit(False))
    times, = fresh(joined, "mix_times")
    # No budget is left where whole epochs fill the target.
    result = joined.withColumn(times, F.col(added["epochs"]) + (whole | chosen).cast("int"))
    return result, {"size": size, "source_size": added["source_size"], "target": added["target"], "times": times}


def mix_report(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, size, source_size, target and taken (size times how often the mix takes it) of every document."""
    mixed, at = mix(docs, id_column)
    return mixed.select(
        id_column,
        F.col(at["size"]).alias("size"),
        F.col(at["source_size"]).cast("long").alias("source_size"),
        F.col(at["target"]).alias("target"),
        (F.col(at["size"]) * F.col(at["times"])).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    mixed, at = mix(docs)
    again, = fresh(mixed, "mix_again")
    return mixed.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(at["times"])))).select(*docs.columns)
