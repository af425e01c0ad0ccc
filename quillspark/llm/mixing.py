"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a stream of words: its documents in a shuffled (hashed) order, end to end,
read again from the start for as many words as its target asks. Streams are cut into blocks
of equally many words. The slots of the mix are the points of the van der Corput sequence,
mapped through the cumulative block quotas of the sources, so that after any number of slots
every source is within a logarithmic distance of its share; over the whole period each gets
exactly its quota. A slot's rank within its source names the block it takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import WORD
from quillspark.operators.ordering import running
from quillspark.session import materialize

#: Words per block, whatever the corpus; a source's last block is shorter.
BLOCK = 4096
#: No document is taken more often.
EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Runs of slots that are matched with the sources' shares.
REACHES = 1000


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` of every source of ``sized`` (source, size).

    The total is shared by weight; a target stops at ``epochs`` times its source's size, and
    the excess is shared again among the others. Each round is one aggregate over the sources;
    only its sums reach the driver.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = running(sizes, [], [F.col("source").isNull(), F.col("source")], rank="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = materialize(place.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")))
    total, left, weight_left = (*weighed.agg(F.sum("source_size"), F.sum("source_size"), F.sum("weight")).first(),)
    while total:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(weight_left))
        capped, rest = weighed.agg(F.sum(F.when(share > F.col("cap"), F.col("cap"))), F.sum(F.when(share <= F.col("cap"), F.col("weight")))).first()
        state = (total - (capped or 0), rest)
        if not rest or state == (left, weight_left):
            break
        left, weight_left = state
    share = F.lit(float(left or 0)) * F.col("weight") / F.lit(float(weight_left or 1))
    return weighed.select("source", "source_size", F.least(share, F.col("cap").cast("double")).alias("target"), "place")


def schedule(quotas: DataFrame) -> DataFrame:
    """``place, block, slot``: the slot of the mix at which a source's block is taken.

    ``quotas`` has ``place`` and ``quota`` (blocks). The van der Corput point of slot ``i`` is
    ``i`` with its bits reversed; points below the sum of quotas fall into one source's share.
    """
    spark = quotas.sparkSession
    shares = running(quotas.where("quota > 0"), [], ["place"], rank=None, sums={"upper": F.col("quota")})
    shares = materialize(shares.withColumn("lower", F.col("upper") - F.col("quota")))
    total = shares.agg(F.max("upper")).first()[0] or 0
    bits = max(1, (max(total, 1) - 1).bit_length())
    reach = max(1, -(-total // REACHES))
    points = (
        spark.range(2**bits if total else 0).select(F.col("id").alias("slot"), F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long").alias("point"))
        .where(F.col("point") < total).withColumn("reach", F.floor(F.col("point") / reach))
    )
    reached = shares.select(
        "place", "lower", "upper", F.explode(F.sequence(F.floor(F.col("lower") / reach), F.floor((F.col("upper") - 1) / reach))).alias("reach")
    )
    slots = points.join(reached, "reach").where("point >= lower AND point < upper").select("place", "slot")
    return running(slots, ["place"], ["slot"], rank="rank").select("place", (F.col("rank") - 1).alias("block"), "slot")


def mix(sized: DataFrame, block: int = BLOCK, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """What a mix takes of every document.

    ``sized`` has ``doc_id, source, size`` (words) and perhaps ``row``, which tells apart rows
    that are otherwise equal. Adds ``source_size, target, taken`` (words, repeats counted) and
    ``parts``: per reading of the document its first word, its end and its first slot.

    A null source is a source of its own, last in order. Empty documents are taken 0 times.
    Repeated rows are documents of their own. An empty table gives an empty result. Hot
    sources are cut along the shuffled order; no task holds a whole source. Reruns agree: the
    order is a hash of the id, then id and size.
    """
    extra = [c for c in ("row",) if c in sized.columns]
    sized = materialize(sized.select("doc_id", "source", F.col("size").cast("long").alias("size"), *extra))
    shares = materialize(targets(sized, weights, epochs))
    shares = shares.withColumn("stream", F.floor("target")).withColumn("quota", F.ceil(F.col("stream") / block))
    slots = schedule(shares.select("place", "quota"))

    placed = sized.join(shares.select(F.col("source").alias("of"), "source_size", "target", "stream", "place"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    lined = materialize(
        running(placed.withColumn("order", F.xxhash64("doc_id")), ["place"], ["order", "doc_id", "size", *extra], rank=None, sums={"upto": F.col("size")})
    )
    # Each reading of a document as words [begin, end) of its source's stream, cut at the blocks.
    begin = F.col("upto") - F.col("size") + F.col("reading") * F.col("source_size")
    readings = (
        lined.where("size > 0").select("place", "upto", "size", "stream", "source_size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("reading"))
        .withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("stream"))).where("begin < end")
    )
    cuts = readings.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    taken = (
        cuts.join(slots, ["place", "block"])
        .withColumn("from", F.greatest(F.lit(0), F.col("block") * block - F.col("begin")))
        .withColumn("to", F.least(F.col("end"), (F.col("block") + 1) * block) - F.col("begin"))
        .groupBy("place", "upto", "reading").agg(F.sum(F.col("to") - F.col("from")).alias("words"), F.min("from").alias("first"), F.max("to").alias("last"), F.min("slot").alias("slot"))
        .groupBy("place", "upto").agg(F.sum("words").alias("words"), F.collect_list(F.struct("reading", "first", "last", "slot")).alias("parts"))
    )
    empty = lined.where("size = 0")
    columns = ["doc_id", *extra, "source", "size", "source_size", "target"]
    none = F.lit(None).cast("array<struct<reading:int,first:bigint,last:bigint,slot:bigint>>")
    return (
        lined.where("size > 0").join(taken, ["place", "upto"], "left")
        .select(*columns, F.coalesce("words", F.lit(0)).alias("taken"), "parts")
        .unionByName(empty.select(*columns, F.lit(0).cast("long").alias("taken"), none.alias("parts")))
    )


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``mix`` over a table of texts: ``doc_id, size, source_size, target, taken, first_slot, slots``.

    ``slots`` are the places in the mixed order at which the document is read, one per reading;
    ``first_slot`` is the first of them. Both are null for documents that are not taken. Sorting
    readings by their slot gives the mix.
    """
    sized = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[source_column].cast("string").alias("source"), words_in(docs[text_column]).alias("size"))
    slots = F.array_sort(F.transform("parts", lambda p: p["slot"]))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", F.array_min(slots).alias("first_slot"), slots.alias("slots"))
