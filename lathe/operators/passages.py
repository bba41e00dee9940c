"""Passages from documents (P1-P4) and their validation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions.text import document_uid, passage_uid, strip

LEAST_CHUNK = 200


def chunks(text: Column, chunk_size: int, separator: str = "\n\n", least: int = LEAST_CHUNK) -> Column:
    """Paragraphs gathered in order to chunks of about ``chunk_size`` characters.

    A chunk is closed before a paragraph that would take it beyond the size, two
    characters counted for each separator; an over-long paragraph is a chunk of its
    own; chunks under ``least`` characters are dropped. A fold within the row: no
    shuffle, no Python.
    """
    parts = F.filter(F.transform(F.split(text, _quoted(separator)), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
    joined = lambda a: F.array_join(a, "\n\n")

    def put(acc, p):
        full = (acc.size > 0) & (acc.size + F.length(p) + 2 > chunk_size)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(joined(acc.open)))).otherwise(acc.done).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(acc.open, F.array(p))).alias("open"),
            (F.when(full, 0).otherwise(acc.size) + F.length(p) + 2).alias("size"),
        )

    end = lambda acc: F.when(F.size(acc.open) > 0, F.concat(acc.done, F.array(joined(acc.open)))).otherwise(acc.done)
    return F.filter(F.aggregate(parts, start, put, end), lambda c: F.length(c) >= least)


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def passages(docs: DataFrame, chunk_size: int, separator: str = "\n\n", method: str = "chunk-v1") -> DataFrame:
    """Passages of documents (source_artifact, text) with ids; a document's chunks are numbered after the short ones are dropped."""
    rows = docs.select("source_artifact", document_uid(F.col("source_artifact")).alias("source_document_uid"), chunks(F.col("text"), chunk_size, separator).alias("_c"))
    rows = rows.select("source_artifact", "source_document_uid", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "text"))
    return rows.select(passage_uid(F.col("source_document_uid"), F.col("chunk_index"), F.col("text")).alias("passage_uid"), "source_document_uid", "source_artifact", "text", "chunk_index", "total_chunks", F.lit(method).alias("extraction_method"))


def budget(docs: DataFrame, target: int) -> DataFrame:
    """Non-blank rows in order (ord) until their stripped length reaches ``target``; the row that crosses it is in.

    A prefix sum in two steps, over range partitions and within them, so no window
    holds all rows; one number per partition reaches the driver.
    """
    from lathe.sources.tables import checkpoint

    rows = docs.select("ord", F.length(strip(F.col("text"))).cast("bigint").alias("_n")).where("_n > 0")
    rows = checkpoint(rows.repartitionByRange("ord").withColumn("_p", F.spark_partition_id()))
    sums, base, at = rows.groupBy("_p").agg(F.sum("_n").alias("n")).orderBy("_p").collect(), [], 0
    for r in sums:
        base.append((r._p, at))
        at += r.n
    base = docs.sparkSession.createDataFrame(base, "_p int, _base bigint")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_b", before).join(F.broadcast(base), "_p").where(F.col("_b") + F.col("_base") < target)
    return docs.join(kept.select("ord"), "ord", "left_semi")


def _next_starts(ends: np.ndarray, chunk_size: int) -> np.ndarray:
    """For a chunk that starts at each paragraph, where the next one starts; ``ends`` are running sums of lengths with separators."""
    before = np.concatenate(([0], ends[:-1]))
    return np.maximum(np.searchsorted(ends, before + chunk_size, "right"), np.arange(len(ends)) + 1)


def _crossings(ends: np.ndarray, chunk_size: int) -> dict[str, list[int]]:
    """How a run of paragraphs goes on from any open chunk: by the paragraph before which that is closed first.

    before: characters of the run up to there; kept: kept chunks closed after that
    one; open: characters of the chunk left open. Only paragraphs that begin within
    the first ``chunk_size`` characters can be the first.
    """
    starts, total = _next_starts(ends, chunk_size), int(ends[-1])
    before = np.concatenate(([0], ends[:-1])).tolist()
    kept, left = [0] * len(ends), [0] * len(ends)
    for i in range(len(ends) - 1, -1, -1):
        j = int(starts[i])
        if j >= len(ends):
            left[i] = total - before[i]
        else:
            kept[i], left[i] = kept[j] + (before[j] - before[i] - 2 >= LEAST_CHUNK), left[j]
    n = max(int(np.searchsorted(ends, chunk_size, "right")), 1) + 1  # an over-long first paragraph is closed by the second
    return {"before": before[:n], "ends": ends[:n].tolist(), "kept": kept[:n], "open": left[:n]}


def dataset_chunks(docs: DataFrame, chunk_size: int, separator: str = "\n\n", max_chunks: int | None = None) -> DataFrame:
    """P1 over all rows of a source in order (source, ord, text): source, chunk_index, total_chunks, text.

    The lengths of paragraphs are dealt to range partitions, so a source of any size
    is split into runs. Each run is folded once for every way in which the chunk that
    is open before it can be closed (at most as many as paragraphs fit in a chunk);
    one small row a run then tells how the runs of a source follow each other, and
    the runs are numbered side by side. Texts are shuffled once, by chunk.
    """
    from lathe.sources.tables import checkpoint

    parts = docs.where(F.col("source").isNotNull()).select("source", F.col("ord").cast("bigint").alias("ord"), F.posexplode(F.filter(F.transform(F.split("text", _quoted(separator)), strip), lambda p: p != "")).alias("pos", "p"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = parts.select("source", "ord", "pos", (F.length("p") + 2).cast("bigint").alias("n"))
    runs = checkpoint(sizes.repartitionByRange(n, "source", "ord", "pos").withColumn("run", F.spark_partition_id()))

    def summary(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ord", "ascending"), ("pos", "ascending")])
        ends = np.cumsum(rows.column("n").to_numpy())
        found = _crossings(ends, chunk_size)
        return pa.Table.from_pylist([{"source": key[0].as_py(), "run": key[1].as_py(), "chars": int(ends[-1]), **found}], SUMMARY)

    def follow(batches):
        """Rows of runs in order of source and run: the chunk that is open at a run's begin, and what becomes of it."""
        source, size, kept, out = None, 0, 0, []

        def done():
            """A chunk's final size is known when it is closed: of those open at the end of a run, from the runs behind."""
            final = size
            for r in reversed(out):
                r["exit"] = final
                final = r["closed"] if r["closed"] else final
                r["enter"] = final
            total = kept + (size - 2 >= LEAST_CHUNK)
            return [{k: v for k, v in r.items() if k != "closed"} | {"total": total} for r in out]

        for batch in batches:
            ready = []
            for r in batch.to_pylist():
                if r["source"] != source:
                    ready += done() if out else []
                    source, size, kept, out = r["source"], 0, 0, []
                row = {"source": source, "run": r["run"], "size": size, "number": kept, "closed": 0}
                at = next((i for i, e in enumerate(r["ends"]) if size + e > chunk_size and size + r["before"][i] > 0), None)
                if at is None:
                    size += r["chars"]
                else:
                    row["closed"] = size + r["before"][at]
                    kept += (row["closed"] - 2 >= LEAST_CHUNK) + r["kept"][at]
                    size = r["open"][at]
                out.append(row)
            yield pa.RecordBatch.from_pylist(ready, FOLLOWED)
        yield pa.RecordBatch.from_pylist(done() if out else [], FOLLOWED)

    def place(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        rows, s = rows.sort_by([("ord", "ascending"), ("pos", "ascending")]), state.to_pylist()[0]
        number, size, chunk, own, closed = s["number"], s["size"], 0, [], []
        for n in rows.column("n").to_pylist():
            if size and size + n > chunk_size:
                closed.append(size)
                chunk, size = chunk + 1, 0
            own.append(chunk)
            size += n
        keep = np.array([s["enter"], *closed[1:], s["exit"]] if closed else [s["exit"]]) - 2 >= LEAST_CHUNK
        index = np.where(keep, number + np.cumsum(keep) - keep, -1)[own]
        total = s["total"] if max_chunks is None else min(s["total"], max_chunks)
        out = pa.table({"source": rows.column("source"), "ord": rows.column("ord"), "pos": rows.column("pos"), "chunk_index": pa.array(index, pa.int32()), "total_chunks": pa.array([total] * len(own), pa.int32())})
        return out.filter(pa.array((index >= 0) & (index < total)))

    keys = ["source", "run"]
    summaries = runs.groupBy(*keys).applyInArrow(summary, "source string, run int, chars bigint, before array<bigint>, ends array<bigint>, kept array<bigint>, open array<bigint>")
    followed = summaries.repartition("source").sortWithinPartitions(*keys).mapInArrow(follow, "source string, run int, size bigint, number bigint, exit bigint, enter bigint, total bigint")
    placed = runs.groupBy(*keys).cogroup(checkpoint(followed).groupBy(*keys)).applyInArrow(place, "source string, ord bigint, pos int, chunk_index int, total_chunks int")
    rows = parts.join(placed, ["source", "ord", "pos"])
    return rows.groupBy("source", "chunk_index").agg(F.first("total_chunks").alias("total_chunks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "pos", "p"))), lambda x: x.p), "\n\n").alias("text"))


_LONGS = pa.list_(pa.int64())
SUMMARY = pa.schema([("source", pa.string()), ("run", pa.int32()), ("chars", pa.int64()), ("before", _LONGS), ("ends", _LONGS), ("kept", _LONGS), ("open", _LONGS)])
FOLLOWED = pa.schema([("source", pa.string()), ("run", pa.int32()), ("size", pa.int64()), ("number", pa.int64()), ("exit", pa.int64()), ("enter", pa.int64()), ("total", pa.int64())])


def reject_reason(docs: DataFrame) -> Column:
    """The first rule that a normalized document breaks; null if it is valid."""
    text = F.col("text")
    return (
        F.when(~F.coalesce(F.col("source_type").isin("file", "dataset", "pdf"), F.lit(False)), "source_type")
        .when(strip(F.coalesce("source_name", F.lit(""))) == "", "source_name")
        .when(text.isNull(), "text_missing").when(F.length(strip(text)) < 200, "text_short").when(F.length(text) > 100_000, "text_long")
        .when(F.coalesce(F.col("chunk_index") < 0, F.lit(True)), "chunk_index").when(F.coalesce(F.col("total_chunks") < 1, F.lit(True)), "total_chunks")
        .when(F.col("chunk_index") >= F.col("total_chunks"), "chunk_index")
    )


def validate_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with reject_reason; keep the rows where it is null, quarantine the rest."""
    return docs.withColumn("reject_reason", reject_reason(docs))
