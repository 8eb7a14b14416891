"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) over its quality weight, with u from a hash of its id. Within
a source the documents stand in the order of their keys, and sizes are summed along it up to the source's
word budget. A budget beyond the source's size takes complete epochs first; only the rest is
selected by key.

The running sum needs no source in one task: keys are dealt into ordered bins, bins are summed, and the one bin of each source
where its budget ends is dealt into bins again until it is small enough to be sorted. What comes out is one cut for
each source (whole epochs, the last key taken, and how many of the rows that tie there), so texts are never shuffled to apply a mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import text_of, written

#: Weights of the sources by code point, repeating; share of all words to take; most epochs of a source.
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
#: Ordered bins of the key in one round; rows of one source from which its last bin is dealt into bins again.
BINS, MANY = 512, 2_000
#: Tied rows that one task numbers.
PIECE_ROWS = 1_000
#: Characters that count against a text's quality weight.
NOISE = "!#$%&*+<=>@[]^_`{|}~"
UNIFORM_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text without noise characters, down to 0.05."""
    clean = F.length(F.translate(text, NOISE, ""))
    return F.greatest(F.lit(0.05), (clean + F.lit(1.0)) / (F.length(text) + F.lit(1.0)))


def uniform(id_text: Column, text_hash: Column, seed: int) -> Column:
    """In (0, 1], by the id and the text alone."""
    digits = F.substring(F.md5(F.concat(id_text, F.lit(f":{seed}:"), text_hash)), 1, UNIFORM_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 1.0) / F.lit(float(16**UNIFORM_DIGITS))


def drawn(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 7) -> DataFrame:
    """The columns ``keep`` of ``docs`` (as in_0, in_1 ...) with mix_id, mix_source, size, key and text_hash. Null weights count as 0.05."""
    text, id_text = text_of(text_col), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    weight = quality_weight(text) if weight is None else F.greatest(F.lit(0.05), F.coalesce(weight.cast("double"), F.lit(0.05)))
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(keep)),
        id_text.alias("mix_id"),
        F.col(f"`{source_col}`").cast("string").alias("mix_source"),
        word_count(text).alias("size"),
        weight.alias("weight"),
        F.md5(text.cast("binary")).alias("text_hash"),
    )
    return rows.withColumn("key", -F.log(uniform(F.col("mix_id"), F.col("text_hash"), seed)) / F.col("weight")).drop("weight")


def targets_of(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes`` (mix_source, source_size and more) with target: shares by weight, each at most ``most`` times its source's size, the excess reshared.

    One row per source of the mix comes in, a list of sources (one task orders it, so not one of millions). Sources reach their cap in the order of
    cap / weight, so the cap binds for a prefix of that order; the first prefix after which no further source is above its cap is the answer.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    nth = F.row_number().over(by_name) - 1
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    everything = Window.partitionBy()
    s = sizes.withColumn("nth", nth).withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("nth") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("total", F.sum("source_size").over(everything) * share)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("turn", F.row_number().over(by_cap)).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    # The level that holds is that of the first source in the order which stays within its cap.
    s = s.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    s = s.withColumn("first_fit", F.min_by("level", F.when(F.col("fits"), F.col("turn"))).over(everything))
    target = F.when(F.col("first_fit").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("first_fit") * F.col("w")))
    return s.select(*sizes.columns, target.alias("target"))


def cuts_of(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs, and the last (key, mix_id, text_hash) that the fraction takes, of which rows it takes cut_in of cut_n.

    All of it null where there is no fraction. ``rows`` are rows of drawn(), from a table.
    """
    facts = [F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")]
    sizes = rows.groupBy("mix_source").agg(*facts).withColumnRenamed("size", "source_size")
    sources = targets_of(written(sizes, "mix-sources"), weights, share, most)
    size = F.col("source_size")
    sources = sources.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    sources = written(sources.withColumn("rest", F.col("target") - F.col("epochs") * size), "mix-targets")

    # Where each source's budget ends: a range of keys, and the size of what stands before it.
    ends = sources.where("rest > 0").select(F.col("mix_source").alias("of_source"), "rest", F.lit(0).cast("long").alias("before"), "low", "high", "n")
    slim = rows.select("mix_source", "size", "key", "mix_id", "text_hash")
    inside = lambda e: slim.join(e, F.col("mix_source").eqNullSafe(F.col("of_source"))).where("key between low and high")
    many = F.col("n") > MANY
    while not ends.where(many & F.expr("low < high")).isEmpty():
        bin_ = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        binned = inside(ends.where("low < high")).select("of_source", "rest", "before", "size", "key", bin_.alias("bin"))
        sums = binned.groupBy("of_source", "rest", "before", "bin").agg(*facts)
        along = Window.partitionBy("of_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(along), F.lit(0)))
        last = sums.where("before < rest and rest <= before + size").select(ends.columns)
        ends = written(last.unionByName(ends.where("low = high")), "mix-ends")

    # Rows that agree in key, id and text are one place: of each as many are in as bring the sum nearest to the budget.
    places = inside(ends).groupBy("of_source", "rest", "before", "key", "mix_id", "text_hash", "size").agg(F.count("*").alias("n"))
    by_key = Window.partitionBy("of_source").orderBy("key", "mix_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(by_key), F.lit(0))
    taken = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("n")))
    places = places.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce(taken, F.lit(0)))).cast("long"))
    place = F.struct("key", "mix_id", "text_hash", "taken", "n")
    # If none is, the fraction ends before the first place of the range.
    cut = places.groupBy("of_source").agg(F.coalesce(F.max(F.when(F.col("taken") > 0, place)), F.min(place)).alias("cut"))
    cut = cut.select(F.col("of_source").alias("cut_source"), F.col("cut.key").alias("cut_key"), F.col("cut.mix_id").alias("cut_id"), F.col("cut.text_hash").alias("cut_hash"), F.col("cut.taken").alias("cut_in"), F.col("cut.n").alias("cut_n"))
    joined = sources.join(cut, F.col("mix_source").eqNullSafe(F.col("cut_source")), "left")
    return written(joined.select(F.col("mix_source").alias("of_source"), "source_size", "target", "epochs", *cut.columns[1:]), "mix-cuts")


def mixed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` of drawn() with source_size, target, copies and taken (copies times size).

    Only rows at a cut that takes a part of its tied rows are moved: they are numbered, in pieces, wherever they come from.
    """
    key, mix_id, text_hash = F.col("key"), F.col("mix_id"), F.col("text_hash")
    here = (key == F.col("cut_key")) & (mix_id == F.col("cut_id")) & (text_hash == F.col("cut_hash"))
    before = (key < F.col("cut_key")) | (key == F.col("cut_key")) & ((mix_id < F.col("cut_id")) | (mix_id == F.col("cut_id")) & (text_hash < F.col("cut_hash")))
    within = before | here & (F.col("cut_in") == F.col("cut_n"))
    some = F.coalesce(here & (F.col("cut_in") > 0) & (F.col("cut_in") < F.col("cut_n")), F.lit(False))
    out = rows.join(cuts, F.col("mix_source").eqNullSafe(F.col("of_source")), "left").withColumn("one_more", F.coalesce(within, F.lit(False)))
    if not cuts.where("cut_in > 0 and cut_in < cut_n").isEmpty():
        # Numbered once written, so that a task that runs again gives the same numbers.
        tied = written(out.where(some).withColumn("at", F.monotonically_increasing_id()), "mix-tied").withColumn("piece", F.expr(f"at div {PIECE_ROWS}"))
        start = written(tied.groupBy(F.col("of_source").alias("tie_source"), F.col("piece").alias("tie_piece")).agg(F.count("*").alias("n")), "mix-pieces")
        start = start.select("tie_source", "tie_piece", F.coalesce(F.sum("n").over(Window.partitionBy("tie_source").orderBy("tie_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        number = F.row_number().over(Window.partitionBy("of_source", "piece").orderBy("at"))
        tied = tied.withColumn("number", number).join(start, F.col("of_source").eqNullSafe(F.col("tie_source")) & (F.col("piece") == F.col("tie_piece")))
        tied = tied.withColumn("one_more", F.col("start") + F.col("number") <= F.col("cut_in"))
        out = out.where(~some).unionByName(tied.select(out.columns))
    out = out.withColumn("copies", F.col("epochs") + F.col("one_more").cast("int"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


#: The columns that mix_sources() makes.
MADE = ["size", "source_size", "target", "copies", "taken"]


def _mix(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int, weights: tuple, share: float, most: int) -> DataFrame:
    """The columns ``keep`` of ``docs`` as in_0, in_1 ... with MADE."""
    # Texts are read once, unless they go on: then the keys are drawn again beside them, which costs less than moving them.
    again = text_col in keep
    slim = written(drawn(docs, [] if again else keep, id_col, text_col, source_col, weight, seed), "mix-drawn")
    cuts = cuts_of(slim, weights, share, most)
    return mixed(drawn(docs, keep, id_col, text_col, source_col, weight, seed) if again else slim, cuts)


def mix_sources(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with size, source_size, target, copies and taken; one row per row of ``docs``.

    size is the text's number of words (null and empty text: 0). A null source is a source, the last. Each (id, text) draws a key of its own, null ids
    too; ties go by id, then text. Rows that agree in id and text are interchangeable: the cut takes as many of them as
    it has room for. A source of size 0 has target 0 and takes nothing. Reruns give the same mix, but for which of such equal rows
    are in. Columns in ``keep`` named like one that is made are replaced. An empty table gives an empty result.
    """
    keep = [c for c in keep if c.lower() not in MADE]
    out = _mix(docs, keep, id_col, text_col, source_col, weight, seed, weights, share, most)
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)), *MADE)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``docs``, the same columns of any name, each row as often as the mix takes it. Odd rows are treated as in mix_sources()."""
    out = _mix(docs, docs.columns, id_col, text_col, source_col, weight, seed, weights, share, most).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
