"""Near-duplicate skills merged in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.sources.tables import checkpoint

#: Share of the larger word set that two names must have in common, exclusive.
OVERLAP = 0.6
#: Candidate pairs that a batch of names may make among themselves.
CANDIDATES = 20_000_000


def _named(skills: DataFrame) -> DataFrame:
    """ord, w (the sorted set of name words) and rep, the first skill with the same words."""
    words = skills.select("ord", F.array_sort(F.array_distinct(F.split("name", "-"))).alias("w"))
    return words.join(words.groupBy("w").agg(F.min("ord").alias("rep")), "w")


def _index(sets: DataFrame) -> DataFrame:
    """Pairs of the rarest words of each word set: t, and ord, n, w of the set, and ``room``, how many of its words are no rarer than the pair's first.

    A pair of different word sets that overlap shares at least two words, and of floor(0.6 n) + 1 shared
    words two are among the n - floor(0.6 n) + 1 rarest. Words that are in most names thus make few keys.
    """
    tokens = sets.select("ord", F.explode("w").alias("t"))
    df = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ranked = tokens.join(df, "t").groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "t"))), lambda x: x.t).alias("r"))  # the words of one name
    n = F.size("r")
    rarest = F.slice("r", F.lit(1), (n - F.floor(n * OVERLAP) + 1).cast("int"))
    keys = F.flatten(F.transform(rarest, lambda x, i: F.transform(F.slice(rarest, i + 2, F.size(rarest)), lambda y: F.struct(F.concat(x, F.lit("-"), y).alias("t"), (n - i).alias("room")))))
    return ranked.select("ord", n.alias("n"), F.array_sort("r").alias("w"), F.explode(keys).alias("k")).select("k.t", "ord", "n", "w", "k.room")


def _close(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """ord_a < ord_b and overlap of similar word sets by two indexes. The first pair of words that both have leaves each as many shared words as it has from there on."""
    a, b = (index.select("t", *[F.col(c).alias(f"{c}_{x}") for c in ("ord", "n", "w", "room")]) for index, x in ((earlier, "a"), (later, "b")))
    larger = F.greatest("n_a", "n_b")
    overlap = F.size(F.array_intersect("w_a", "w_b")) / larger
    close = (F.col("ord_a") < F.col("ord_b")) & (F.least("n_a", "n_b", "room_a", "room_b") > OVERLAP * larger) & (overlap > OVERLAP)
    return a.join(b, "t").where(close).select("ord_a", "ord_b", overlap.alias("overlap")).distinct()


def similar_pairs(skills: DataFrame) -> DataFrame:
    """All pairs (ord_a < ord_b) of skills whose ``-``-split name words overlap by more than OVERLAP of the larger set.

    Of skills with the same words only the first takes part. Where many names are alike
    these are many rows; ``representatives`` finds what each skill is merged into without them.
    """
    index = _index(_named(skills).where("ord = rep"))
    return _close(index, index).select("ord_a", "ord_b")


def _batch(index: DataFrame) -> int | None:
    """The last ord of as many first names as make CANDIDATES pairs with a common key at most; None for all of them."""
    top = None
    while True:
        part = index if top is None else index.where(F.col("ord") <= top)
        by_key = part.groupBy("t").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
        pairs, lo, hi = by_key.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.min("lo"), F.max("hi")).first()
        if pairs is None or pairs <= CANDIDATES or lo == hi:
            return top
        top = min(part.agg(F.percentile_approx("ord", (CANDIDATES / pairs) ** 0.5)).first()[0], (lo + hi) // 2)


def _kept(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Of a batch the names that are kept: in rounds, those without an undecided or kept neighbour before them; their later neighbours are decided."""
    todo, kept = checkpoint(names), None
    while True:
        live = pairs.join(todo.select(F.col("ord").alias("ord_a")), "ord_a").join(todo.select(F.col("ord").alias("ord_b")), "ord_b")
        heads = checkpoint(todo.join(live.select(F.col("ord_b").alias("ord")), "ord", "left_anti"))
        if heads.isEmpty():
            return names.where("false") if kept is None else checkpoint(kept)
        kept = heads if kept is None else kept.union(heads)
        beaten = pairs.join(heads.select(F.col("ord").alias("ord_a")), "ord_a").select(F.col("ord_b").alias("ord"))
        todo = checkpoint(todo.join(heads, "ord", "left_anti").join(beaten, "ord", "left_anti"))


def representatives(skills: DataFrame) -> DataFrame:
    """(ord, kept, overlap): the kept skill that each skill goes to, itself if it is kept, and the share of words they have in common.

    In order, a skill is kept unless it is similar to a kept one before it, and then
    goes to the first such. The first names, as many as make CANDIDATES candidate pairs,
    are decided among themselves; what is similar to those kept is found by their index
    alone and leaves, and so on with the first names of the rest. No table of all pairs
    is made: a name meets the kept ones, and its own batch. Skills with the same words
    share a fate, as what is similar to one is similar to all, and the first meets it first.
    """
    named = checkpoint(_named(skills))
    sets = named.where("ord = rep").select("ord", "w")
    index = checkpoint(_index(sets))
    alone = sets.select("ord").join(index.select("ord"), "ord", "left_anti")  # single words
    decided = alone.select("ord", F.col("ord").alias("kept"), F.lit(1.0).alias("overlap"))
    nearest = [F.min("ord_a").alias("kept"), F.min_by("overlap", "ord_a").alias("overlap")]
    while not index.isEmpty():
        top = _batch(index)
        batch, rest = (index, None) if top is None else (index.where(F.col("ord") <= top), index.where(F.col("ord") > top))
        pairs = checkpoint(_close(batch, batch))
        kept = _kept(pairs, batch.select("ord").distinct())
        merged = pairs.join(kept.select(F.col("ord").alias("ord_a")), "ord_a").join(kept.select(F.col("ord").alias("ord_b")), "ord_b", "left_anti")
        if rest is not None:
            found = checkpoint(_close(batch.join(kept, "ord", "left_semi"), rest))
            merged, index = merged.unionByName(found), checkpoint(rest.join(found.select(F.col("ord_b").alias("ord")), "ord", "left_anti"))
        merged = merged.groupBy(F.col("ord_b").alias("ord")).agg(*nearest)
        decided = decided.unionByName(checkpoint(kept.select("ord", F.col("ord").alias("kept"), F.lit(1.0).alias("overlap")).unionByName(merged)))
        if rest is None:
            break
    return named.select("ord", "rep").join(decided.withColumnRenamed("ord", "rep"), "rep").select("ord", "kept", "overlap")


def merge_skills(skills: DataFrame) -> DataFrame:
    """Kept skills with the united source ids of those merged into them; one that took another loses its extraction_method."""
    groups = skills.select("ord", "source_task_uids").join(representatives(skills).drop("overlap"), "ord").groupBy("kept").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_task_uids")))).alias("_all"), F.count("*").alias("_n"))
    out = skills.join(groups, skills.ord == groups.kept)
    merged = F.col("_n") > 1
    out = out.withColumn("source_task_uids", F.when(merged, F.col("_all")).otherwise(F.col("source_task_uids")))
    if "extraction_method" in skills.columns:
        out = out.withColumn("extraction_method", F.when(merged, "").otherwise(F.col("extraction_method")))
    return out.select(*skills.columns)
