"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1. Among rates that give each source its target of words, those nearest to 1 in relative entropy are
exponential tilts of the document's size, exp(lambda * size / mean size), cut at the largest repetition; lambda, one a source, solves
the convex dual. Each Newton step is one aggregation over counts of (source, size), the dual's sufficient statistic; the driver holds a
few numbers a source. Rates become copies by systematic rounding along sizes, so a source's total stays within about a document of its target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.tables import boxed, drop, keep, unboxed

#: Weights of sources in code-point order of their names (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of a document.
MOST = 3
STEPS, TOLERANCE = 60, 1e-7
#: Documents that are rounded together, on average.
GROUP = 1_000
#: Sources up to which their row each (some 100 bytes) is broadcast; beyond, they meet the documents by (source, salt).
BROADCAST_SOURCES, SALTS = 10_000, 64
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Source:
    name: str | None
    size: int
    docs: int
    target: float = 0.0
    mean: float = 1.0
    tilt: float = 0.0


def size_of(text: str) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; none above most times its size, the excess reshared by weight among the rest."""
    out, left, rest = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while rest:
        each = left / sum(weights[i] for i in rest)
        over = [i for i in rest if each * weights[i] > most * sizes[i]]
        for i in over or rest:
            out[i] = float(most * sizes[i]) if over else each * weights[i]
            left -= out[i]
        rest = [i for i in rest if i not in set(over)] if over else []
    return out


def _name(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def balance(counts: DataFrame, sources: list[Source], most: float = MOST) -> None:
    """Sets each source's tilt: Newton steps on the dual, kept inside a bracket, until words taken match the target.

    counts: name, size, n (documents of that source and size). A step is one pass over counts with partial sums a source.
    """
    low, high = {s.name: -60.0 for s in sources}, {s.name: 60.0 for s in sources}
    spark = counts.sparkSession
    todo = [s for s in sources if 0 < s.target < most * s.size]
    for s in sources:  # ends of the range need no search
        s.tilt = 0.0 if s in todo else (high[s.name] if s.target > 0 else low[s.name])
    for _ in range(STEPS):
        if not todo:
            return
        # one short row a source: its number is that of distinct sources
        now = spark.createDataFrame([(s.name, s.tilt, s.mean) for s in todo], "name string, tilt double, mean double")
        met = F.broadcast(now) if len(todo) <= BROADCAST_SOURCES else now
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.greatest(F.col("tilt") * x, F.lit(-700.0)), F.lit(700.0)))
        taken = F.col("n") * F.col("size") * F.least(raw, F.lit(float(most)))
        slope = F.when(raw < most, F.col("n") * F.col("size") * x * raw).otherwise(0.0)
        got = {r.name: r for r in counts.join(met, "name").groupBy("name").agg(F.sum(taken).alias("taken"), F.sum(slope).alias("slope")).collect()}
        for s in list(todo):
            r = got[s.name]
            gap = r.taken - s.target
            if abs(gap) <= TOLERANCE * s.target or high[s.name] - low[s.name] < 1e-9:
                todo.remove(s)
                continue
            low[s.name], high[s.name] = (low[s.name], s.tilt) if gap > 0 else (s.tilt, high[s.name])
            step = s.tilt - gap / r.slope if r.slope else None
            s.tilt = step if step is not None and low[s.name] < step < high[s.name] else (low[s.name] + high[s.name]) / 2


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> list[Source]:
    """Targets and tilts for (name, size) rows; one entry a distinct source reaches the driver."""
    counts = keep(sized.groupBy("name", "size").agg(F.count("*").alias("n")), "sizes")
    got = counts.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("docs"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("full")).collect()
    # "=" marks a name and "-" is null, so code points order names and null goes last
    got.sort(key=lambda r: (r.name == "-", r.name))
    sources = [Source(r.name, int(r["size"]), int(r.docs), mean=r["size"] / r.full if r.full else 1.0) for r in got]
    for s, t in zip(sources, targets([s.size for s in sources], [weights[i % len(weights)] for i in range(len(sources))], most), strict=True):
        s.target = t
    balance(counts, sources, most)
    drop(counts)
    for s in sources:
        s.tilt = round(s.tilt, 9)
    return sources


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (copies times size) of every row.

    Null texts have size 0; a null source is one of its own and comes last. Repeated rows are documents of their own. No sources: no rows.
    Texts are read once, whole; what is shuffled is (doc_id, source, size). Rounding groups are a source's documents dealt by hash of
    doc_id and text, about GROUP in each, so no source meets in one task, nor do the rows of a null or repeated id unless their texts are equal too.
    """
    spot = F.xxhash64(F.col(doc_id).cast("long"), F.col(text))
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), spot.alias("spot"))
    sized = keep(sized.withColumn("name", _name("source")), "sized")
    sources = plan(sized, weights, most)
    spark = docs.sparkSession
    rows = [(s.name, s.size, s.target, s.tilt, s.mean, max(1, round(s.docs / GROUP))) for s in sources]
    known = spark.createDataFrame(rows, "name string, source_size bigint, target double, tilt double, mean double, groups int")
    if len(rows) <= BROADCAST_SOURCES:
        out = sized.join(F.broadcast(known), "name")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = sized.withColumn("salt", F.pmod(F.col("spot"), F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"]).drop("salt")
    power = F.least(F.greatest(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(-700.0)), F.lit(700.0))
    full = F.col("target") >= most * F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(full, float(most)).otherwise(F.round(F.least(F.exp(power), F.lit(float(most))), 9))
    out = out.withColumn("rate", rate).withColumn("group", F.pmod(F.xxhash64("spot"), F.col("groups")))
    # a large source goes to many tasks, whatever the join dealt by
    out = out.repartition("name", "group")
    frac = F.col("rate") - F.floor("rate")
    # systematic rounding in order of size: the sum of copies follows the sum of rates step by step
    upto = Window.partitionBy("name", "group").orderBy("size", "spot", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("frac", frac).withColumn("after", F.sum(F.col("frac").cast("decimal(20,9)")).over(upto).cast("decimal(30,9)"))
    start = (F.pmod(F.xxhash64("name", "group"), F.lit(1_000_003)) / F.lit(1_000_003)).cast("decimal(10,9)")
    up = F.floor(F.col("after") + start) - F.floor(F.col("after") - F.col("frac").cast("decimal(20,9)") + start)
    out = out.withColumn("copies", F.least(F.floor("rate") + up, F.lit(most)).cast("int"))
    out = keep(out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")), "mixed")
    drop(sized)
    return out


def sample(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """docs, all their columns, with a row for each copy that the mix takes.

    Rows that repeat a doc_id (null is one too) take each the most copies of any of them. What is shuffled with the texts is one join by doc_id.
    """
    taken = mix(docs, text, doc_id, source, **how).groupBy("doc_id").agg(F.max("copies").alias("_copies")).filter("_copies > 0").withColumnRenamed("doc_id", "_id")
    rows = boxed(docs, _key=F.col(doc_id).cast("long")).join(taken, F.col("_key").eqNullSafe(F.col("_id")))
    return unboxed(rows.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))), docs.columns)
