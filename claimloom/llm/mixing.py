"""Mixing sources to target weights by weighted fair queueing.

Every document is queued once per epoch in its source's shuffled order. Its virtual
finish time is the source's tokens up to and including it, divided by the source's
weight. The queue is served in order of finish time until the total budget is spent:
a source that runs out of epochs leaves its share to the others. Running sums are
taken over hash ranges of a source, and the cut is found by range sums, so neither a
source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._common import WORD_PATTERN, checkpoint, fresh, require, text_of

WEIGHTS = (5, 2, 1)
#: Hash ranges of a source, and finish-time ranges of each level of the cut.
RANGES = 1024
#: A table of sources up to this many rows is broadcast; a larger one is shuffled.
BROADCAST_SOURCES = 100_000


def document_size(text_col: str = "text"):
    return F.regexp_count(text_of(text_col), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, sid, weight, level, target): one row per source, from columns source and size.

    Sources are ordered by code point, null last, and weighed in turn. Targets are
    proportional to the weights up to `epochs` times a source's size; `level` is the
    water level at which they use up the budget, `share` of all sizes.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_ = Window.orderBy("ratio", "sid")
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name).cast("long"))
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long"))
    src = src.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    src = src.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    src = src.withColumn("full", F.coalesce(F.sum("cap").over(all_.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    src = src.withColumn("left", F.sum("weight").over(all_.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    src = src.withColumn("at", (F.col("budget") - F.col("full")) / F.col("left"))
    src = src.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("at"), F.struct("ratio", "sid", "at"))).over(whole)["at"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.max("ratio").over(whole)))
    return src.select("source", "source_size", "sid", "weight", "budget", "level", target.alias("target"))


def _with_finish(rows: DataFrame, src: DataFrame, prefix: DataFrame, c: dict[str, str]) -> DataFrame:
    """Adds the source's figures and `through`, the source's tokens up to and including the row."""
    rows = rows.join(src.withColumnRenamed("source", c["s"]), rows[c["source"]].eqNullSafe(F.col(c["s"])))
    rows = rows.join(prefix.select(F.col("sid").alias(c["psid"]), F.col("bucket").alias(c["pbucket"]), F.col("before").alias(c["before"])), (F.col(c["sid"]) == F.col(c["psid"])) & (F.col(c["bucket"]) == F.col(c["pbucket"])))
    run = Window.partitionBy(c["sid"], c["bucket"]).orderBy(c["key"], F.col(c["id"]).asc_nulls_first(), c["size"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(c["through"], F.col(c["before"]) + F.sum(c["size"]).over(run))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", sized: str | None = None) -> DataFrame:
    """`docs` with added columns size, source_size, target and taken (words the mix takes, repeats counted).

    size is the number of words of the text (null: 0), or the column named `sized`.
    A null source is a source. Documents of size 0 are taken zero times over. The
    order is the MD5 of the id, so reruns agree; rows that repeat an id are queued
    side by side. An empty table gives an empty result. Added columns that clash with
    columns of `docs` replace them.
    """
    require(docs, id_col, source_col, *([sized] if sized else [text_col]))
    if not weights or min(weights) <= 0 or epochs < 1:
        raise ValueError("weights must be positive and epochs at least 1")
    own = ["s", "sid", "psid", "pbucket", "before", "bucket", "key", "through", "weight", "budget", "level", "source_size", "target", "size"]
    c = {n: fresh(docs, f"__mix_{n}") for n in own} | {"id": id_col, "source": source_col}
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn(c["size"], F.col(sized).cast("long") if sized else document_size(text_col)).withColumn(c["key"], key)
    rows = rows.withColumn(c["bucket"], (F.conv(F.substring(c["key"], 1, 8), 16, 10).cast("long") * RANGES / F.lit(2**32)).cast("int"))
    small = checkpoint(rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(c["size"]).alias("size"), F.col(c["key"]).alias("key"), F.col(c["bucket"]).alias("bucket")))
    src = checkpoint(source_targets(small, weights, share, epochs))
    if src.count() <= BROADCAST_SOURCES:
        src = F.broadcast(src)
    sums = small.join(src.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s"))).groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    prefix = checkpoint(sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    names = {n: n for n in own} | {"id": "id", "source": "source"}
    queued = checkpoint(_with_finish(small, src, prefix, names).select("sid", "key", "id", "size", "weight", "source_size", "through"))
    cut = _cut(queued, src, epochs)
    fin = {n: fresh(docs, f"__src_{n}") for n in ("source_size", "sid", "weight", "budget", "level", "target")}
    named = src.select("source", *[F.col(n).alias(fin[n]) for n in fin])
    out = _with_finish(rows, named, prefix, c | {"sid": fin["sid"]})
    taken = F.lit(0).cast("long")
    for e in range(epochs):
        taken = taken + F.when(_served(F.col(c["through"]), F.col(fin["source_size"]), F.col(fin["weight"]), e, F.col(fin["sid"]), F.col(c["key"]), cut), F.col(c["size"])).otherwise(0)
    keep = [x for x in docs.columns if x.lower() not in ("size", "source_size", "target", "taken") or x in (id_col, source_col)]
    return out.select(*keep, F.col(c["size"]).alias("size"), F.col(fin["source_size"]).alias("source_size"), F.col(fin["target"]).alias("target"), taken.alias("taken"))


def _finish(through, source_size, weight, epoch: int):
    return (through + source_size * epoch) / weight


def _served(through, source_size, weight, epoch, sid, key, cut):
    """Whether the item comes no later in the queue than the last one served."""
    if cut is None:
        return F.lit(False)
    f = _finish(through, source_size, weight, epoch)
    at = F.lit(float(cut["finish"]))
    return (f < at) | ((f == at) & ((sid < cut["sid"]) | ((sid == cut["sid"]) & (key <= F.lit(cut["key"])))))


def _cut(queued: DataFrame, src: DataFrame, epochs: int):
    """The last (finish, sid, key) that the budget covers, or None if it covers none.

    Two levels of range sums (RANGES rows each come to the driver) leave about a
    millionth of the queue to sort.
    """
    top = src.agg(F.max("level").alias("level"), F.max("budget").alias("budget"), F.max(F.col("source_size") * epochs / F.col("weight")).alias("end")).first()
    if not top["budget"]:
        return None
    budget, span = top["budget"], 2 * (top["level"] or top["end"])
    items = queued.select("sid", "key", "size", F.explode(F.array(*[_finish(F.col("through"), F.col("source_size"), F.col("weight"), e) for e in range(epochs)])).alias("finish"))
    base, latest = 0, F.max(F.struct("finish", "sid", "key")).alias("m")
    place, tops = F.col("finish") / F.lit(span) * RANGES, []
    for _ in range(2):
        items = items.withColumn("r", F.least(F.floor(place), F.lit(RANGES))).withColumn("inside", place - F.col("r"))
        edge = None
        for r, n in sorted((row["r"], row["n"]) for row in items.groupBy("r").agg(F.sum("size").alias("n")).collect()):
            if base + n > budget:
                edge = r
                break
            base += n
        if edge is None:
            return items.agg(latest).first()["m"]
        tops.append(items.where(F.col("r") < edge).agg(latest))
        items, place = items.where(F.col("r") == edge), F.col("inside") * RANGES
    run = Window.partitionBy("r").orderBy("finish", "sid", "key")
    tops.append(items.withColumn("run", F.sum("size").over(run)).where(F.col("run") + base <= budget).agg(latest))
    return tops[0].union(tops[1]).union(tops[2]).agg(F.max("m").alias("m")).first()["m"]


def apply_mix(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document of mix_sources() as often as the mix takes it; documents never taken and empty ones go. `columns` may have any names; an empty table gives an empty result."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.where(F.col("taken") > 0).withColumn(fresh(mixed, "__times"), F.explode(F.array_repeat(F.lit(1), times))).select(*columns)
