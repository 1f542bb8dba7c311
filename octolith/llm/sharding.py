"""Balanced label propagation: linked documents gather in shards of even size.

Documents are linked if they share a group (equal texts, or any table of id and group). Each starts in a shard chosen by
its hash. In a round every document looks at the shards of its groups' other members: links are counted per group and
shard, joined back, and the shard with the most links is where it wants to go, if more of its neighbours are there than
where it is. Moves from one shard to another are admitted up to the quota: as many as want to go
the other way, and as many more as the shard has free places. Which ones are admitted is decided by a hash of group and
round, so that groups move together. Rounds end when nothing moves.

The law is `rows`: shards hold equal numbers of documents, at most one apart. Documents without links cut nothing wherever
they are; they fill the places that linked ones leave. A group larger than a shard's quota fills whole shards.

Links are never expanded into pairs; the driver sees counts per shard, per pair of shards and per partition.

Defined results: a null text has no bytes and is in one group with the empty text; null doc_ids and repeated rows are
documents like any other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.session import materialize

SHARDS, ROUNDS = 16, 40


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group (digest of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    data = F.encode(text, "UTF-8")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("group")
    )


def _share(key: Column, seed: Column) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(key, seed), F.lit(1 << 30)) / float(1 << 30)


def quotas(total: int, shards: int) -> list[int]:
    """Places in each shard, at most one apart."""
    return [(k + 1) * total // shards - k * total // shards for k in range(shards)]


def propagate(links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """links (group, shard, n): how many members of each group start in each shard. Returns it as it is in the end.

    Members of a group in one shard want the same, so that they are one row with a count; a move takes the admitted part.
    """
    shards = len(quota)
    loads = [0] * shards
    for r in links.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        loads[r["shard"]] = r["n"]
    still = 0
    for step in range(rounds):
        free = [max(0, q - load) for q, load in zip(quota, loads, strict=True)]
        open_ = F.array(*[F.lit(f > 0) for f in free])[F.col("shard")]
        # Of equal votes a shard with free places has the better one. Every other round full shards take part too: moves
        # into them are admitted against moves out of them.
        vote = F.struct("n", open_.alias("open"), F.xxhash64("group", "shard").alias("tie"), "shard")
        votes = links.groupBy("group").agg(F.max(F.when(open_ | F.lit(step % 2 == 0), vote)).alias("best"))
        # The best shard is joined back to the members in other shards.
        want = links.join(votes, "group").select("group", "shard", "n", F.when(F.col("best") > vote, F.col("best.shard")).otherwise(F.col("shard")).alias("to"))
        want = materialize(want, "wishes")
        asked = {(r["shard"], r["to"]): r["k"] for r in want.where("shard <> to").groupBy("shard", "to").agg(F.sum("n").alias("k")).collect()}
        rate = {}
        for (a, b), k in sorted(asked.items()):
            back = min(k, asked.get((b, a), 0))
            extra = min(k - back, free[b])
            free[b] -= extra
            rate[a * shards + b] = (back + extra) / k
        if not any(rate.values()):
            still += 1
            if still == 2 or not asked and step % 2 == 0:
                break
            continue
        rates = F.coalesce(F.create_map(*[F.lit(x) for kv in rate.items() for x in kv])[F.col("shard") * shards + F.col("to")], F.lit(0.0))
        # Small groups move whole or not at all; of large ones the admitted part moves.
        part = F.when(F.col("n") >= 64, F.floor(F.col("n") * rates)).when(_share(F.col("group"), F.lit(step)) < rates, F.col("n")).otherwise(0).cast("long")
        moved = materialize(want.withColumn("go", F.when(F.col("shard") == F.col("to"), F.lit(0).cast("long")).otherwise(part)), "moves")
        flows = moved.where("go > 0").groupBy("shard", "to").agg(F.sum("go").alias("k")).collect()
        if not flows:
            still += 1
            if still == 4:
                break
            continue
        still = 0
        for r in flows:
            loads[r["shard"]], loads[r["to"]] = loads[r["shard"]] - r["k"], loads[r["to"]] + r["k"]
        pieces = F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n"))))
        after = moved.select("group", pieces.alias("p")).select("group", "p.shard", "p.n").where("n > 0")
        links = materialize(after.groupBy("group", "shard").agg(F.sum("n").alias("n")), "labels")
    return links


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `place`: the row's number in this order, from 0, by partition counts and no single task.

    Ties beyond the order are broken by the place in the sorted file, which is written before it is numbered.
    """

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], names=[*batch.schema.names, "part", "nth"])
            at += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, f"{fields}, part bigint, nth bigint"), "ordered")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row per partition
    before = parts.withColumn("before", F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    return rows.join(before, "part").withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, group, shard, slot under the law `rows`."""
    nodes = materialize(nodes_of(docs).withColumn("shard", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")), "nodes")
    quota = quotas(nodes.count(), shards)
    cells = nodes.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(cells.groupBy("group").agg(F.sum("n").alias("members")).where("members > 1").select("group"), "groups")
    labels = propagate(materialize(cells.join(groups, "group"), "labels"), quota, rounds)
    # A group's members take its labels in the order of doc_id: place in the group against cumulative counts.
    ends = labels.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    upto = lambda i: F.aggregate(F.slice("cells", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    ends = ends.withColumn("cells", F.transform("cells", lambda c, i: F.struct(c["shard"].alias("shard"), upto(i).alias("end"))))
    ranked = numbered(nodes.join(groups, "group", "left_semi").drop("shard"), [F.col("group"), F.col("doc_id")])
    first = ranked.groupBy("group").agg(F.min("place").alias("first"))
    # Written, so that both sides are dealt by group for the next join alone and a large group is split at run time.
    targets = materialize(first.join(ends, "group"), "targets")
    ranked = ranked.join(targets, "group").withColumn("nth_of", F.col("place") - F.col("first"))
    placed = numbered(ranked.select("doc_id", "size", "text_crc32", "group", F.filter("cells", lambda c: F.col("nth_of") < c["end"])[0]["shard"].alias("shard")), [F.col("shard"), F.col("group"), F.col("doc_id")])
    begin, held = [0] * shards, [0] * shards
    for r in placed.groupBy("shard").agg(F.min("place").alias("p"), F.count(F.lit(1)).alias("n")).collect():
        begin[r["shard"]], held[r["shard"]] = r["p"], min(r["n"], quota[r["shard"]])
    of = lambda numbers: F.array(*[F.lit(x).cast("long") for x in numbers])[F.col("shard")]
    placed = placed.withColumn("slot", F.col("place") - of(begin))
    stay = placed.where(F.col("slot") < of(quota)).drop("place")
    # What has no links, and what linked documents are too many for a shard, fills the places left.
    spare = placed.where(F.col("slot") >= of(quota)).drop("place", "slot", "shard").unionByName(nodes.join(groups, "group", "left_anti").drop("shard"))
    spare = numbered(spare, [F.xxhash64("doc_id", "group"), F.col("doc_id")])
    gap_ends, total = [], 0
    for q, h in zip(quota, held, strict=True):
        total += q - h
        gap_ends.append(total)
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in gap_ends]), lambda e: e <= F.col("place"))).cast("int")
    spare = spare.withColumn("shard", fill).withColumn("slot", F.col("place") - of([0, *gap_ends[:-1]]) + of(held)).drop("place")
    return stay.unionByName(spare).select("doc_id", "size", "text_crc32", "group", "shard", "slot")


def op2_balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards with equal counts, equal texts together."""
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
