"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source sends its documents, in the order of a hash of their ids, through a link it shares with the other
sources. A document's virtual finish time is the running number of its source's words divided by the source's
target; a second copy follows after the whole source has been sent once. All copies are ordered by finish time, over
all sources, and the mix is the longest prefix within the budget. Because every source reaches time 1 with exactly
its target, each one's taken words differ from the target by about one document.

Running sums never gather a source in one task: :func:`number_rows` range-partitions on (source, order), so a source
with a third of all rows takes a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmill.llm.common import blank_words, materialize, text_of
from featmill.operators.ordinals import number_rows

# Weights of the sources in their order, repeating; words of the mix in hundredths of all; most copies (fixed values).
WEIGHTS, BUDGET_PERCENT, COPIES = (3, 1, 2), 150, 2


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, copies: int = COPIES
) -> DataFrame:
    """``(source, source_size, weight, target)`` from rows with ``source`` and ``size``.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. A target is the source's share of the
    budget by weight, at most ``copies`` times its size; the excess is shared again until no target is above. Each
    round of sharing is one small aggregation, of which the driver gets three numbers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    placed = number_rows(per, order=["_null", "source"], global_ordinal="_o").drop("_null")
    listed = F.array(*[F.lit(int(w)) for w in weights])
    placed = materialize(
        placed.withColumn("weight", F.get(listed, (F.col("_o") % len(weights)).cast("int"))).drop("_o"), "sources"
    )
    most = F.col("source_size") * copies
    total = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") >= most
        n, words, left = placed.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not left:
            break
        full, level = n, (budget_percent * total - 100 * words) / (100.0 * left)
    target = F.least(most.cast("double"), F.lit(level) * F.col("weight")) if left else most.cast("double")
    return placed.withColumn("target", target)


def mix_plan(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, copies: int = COPIES
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken_copies`` to narrow rows of ``source``, ``size`` and key columns.

    Rows without words and rows of a source without words are taken no times. Repeated rows count one by one. Rows equal
    in every column may take each other's places. An empty table gives an empty plan.
    """
    keys = [c for c in rows.columns if c not in ("source", "size")]
    rows = materialize(rows.withColumn("_order", F.md5(F.col(keys[0]).cast("string"))), "sizes")
    targets = source_targets(rows, weights, budget_percent, copies)
    sent = number_rows(
        rows.withColumn("_null", F.col("source").isNull()), ["_null", "source"], ["_order", *keys],
        running={"_cum": "size"}, global_ordinal="_row", ties=True,
    ).drop("_null", "_order")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    sent = materialize(
        sent.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "sent"
    )
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

    def finish(copy):
        return (copy * F.col("source_size") + F.col("_cum")) / F.col("target")

    each = sent.where((F.col("size") > 0) & (F.col("target") > 0)).select(
        "_row", "size", F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), finish(F.lit(c)).alias("time")) for c in range(copies)])).alias("_c")
    )
    each = each.select(F.col("_c.time").alias("time"), "_row", F.col("_c.copy").alias("copy"), "size")
    used = number_rows(each, order=["time", "_row", "copy"], running={"_used": "size"})
    # All that the driver learns is the last copy that fits the budget.
    last = used.where(F.col("_used") * 100 <= F.lit(budget_percent * total)).agg(
        F.max(F.struct("time", "_row", "copy")).alias("last")
    ).first()["last"]
    if last is None:
        return sent.withColumn("taken_copies", F.lit(0).cast("bigint")).drop("_cum", "_row")
    end = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["_row"]).cast("bigint").alias("_row"), F.lit(last["copy"]).alias("copy"))
    taken = sum(
        (
            F.struct(finish(F.lit(c)).alias("time"), F.col("_row"), F.lit(c).alias("copy")) <= end
        ).cast("bigint")
        for c in range(copies)
    )
    live = (F.col("size") > 0) & (F.col("target") > 0)
    return sent.withColumn("taken_copies", F.when(live, taken).otherwise(F.lit(0).cast("bigint"))).drop("_cum", "_row")


def document_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``; size counts the words of the text, none for a null one."""
    return docs.select(
        "doc_id", "source", F.size(blank_words(text_of("text"))).cast("bigint").alias("size")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each document repeated as often as the mix takes it; all columns stay.

    Documents without words are in no mix. Equal rows, whatever their columns, are one document repeated.
    """
    key = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key"),
                        "source", "doc_id", F.size(blank_words(text_of("text"))).cast("bigint").alias("size"))
    plan = mix_plan(whole.select("doc_id", "source", "size", "_key"), **options)
    copies = plan.where(F.col("taken_copies") > 0).groupBy("_key").agg(F.sum("taken_copies").alias("_times"))
    once = whole.where(F.col("size") > 0).select("_key", "_doc").dropDuplicates(["_key"])
    out = once.join(copies, "_key").select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")))
    return out.select("_doc.*")


