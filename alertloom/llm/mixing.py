"""Mixing sources to target weights, with DataFrame functions only.

Every source is one long run of words: its documents in the order of a hash, one after the other, cut into blocks of
BLOCK words (the last may be shorter). The mix is a sequence of slots, one block each, in shards of SHARD slots. For
each shard, source counts are drawn: the whole part of the expected count is given, the rest of the slots is drawn
from the multinomial of the remainders (residual resampling), so that totals stay near their targets. The k-th slot of
a source takes block p(k mod N) of its N blocks, where p is a pseudorandom permutation of its own for each pass over
the source: a bijective mix of the index bits, walked until it falls below N. Documents are cut into the blocks they
lie in, and slots and blocks meet in an equality join on (source, block).

Everything is seeded by hashes of values, so reruns agree. Running sums are made in two levels (within a slice of
about SLICE rows, then over slices), so no task holds a source, however hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom.session import durable

BLOCK = 64
SHARD = 4096
SLICE = 1024
SLOTS = 1 << 18  # slots that a task makes, about
SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
PICKS = 4096  # cells of [0, 1) by which draws find their source
STEPS = 2  # steps of a permutation that are projections, each leaves half of its rows at most; more take long to plan
WORD = r"\S+"  # all but \x20 and \x09 to \x0D


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame) -> DataFrame:
    """(source, sid, source_size, docs, target) of rows (source, size): one row a source, sid from 0 by code point, null last.

    A source gets its weight's share of SHARE * all sizes, but MOST times its own size at most; what is above is shared
    anew by weight. In the order of cap / weight, the capped sources come first: a source is capped if its cap is at
    most its share of what the ones before it leave.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    own = own.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("double"))
    own = own.withColumn("cap", MOST * F.col("source_size").cast("double"))
    all_rows = W.partitionBy()
    tight = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = tight.rowsBetween(W.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    own = own.withColumn("rate", left / shares)
    free = F.min(F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "sid", "rate"))).over(all_rows)
    rate = F.coalesce(free["rate"], F.lit(0.0))
    own = own.withColumn("target", F.when(rate > 0, F.least(F.col("cap"), rate * F.col("weight"))).otherwise(F.lit(0.0)))
    return own.select("source", "sid", "source_size", "docs", "target")


def running(df: DataFrame, group: str, chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group before this one, by (chunk, order); chunks are small."""
    inside = W.partitionBy(group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(group, chunk).agg(F.sum(value).alias("_total"))
    before = W.partitionBy(group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(group, chunk, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(totals, [group, chunk]).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before")


def _constants(n: Column, seed: Column) -> dict[str, Column]:
    """What a step of the permutation of 0..n-1 needs: the mask of its bits, half of them, two summands below the mask."""
    bits = F.greatest(F.lit(1), F.length(F.bin(n - 1))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return {
        "mask": mask, "half": F.ceil(bits / 2).cast("int"),
        "c1": F.xxhash64(seed, F.lit(1)).bitwiseAND(mask), "c2": F.xxhash64(seed, F.lit(2)).bitwiseAND(mask),
    }


def _step(x: Column, s: dict[str, Column] | Column) -> Column:
    """The place after x, among all that the mask allows."""
    for odd, add in ((740_101, "c1"), (915_781, "c2"), (610_537, "c1")):
        x = (x * F.lit(odd).cast("long") + s[add]).bitwiseAND(s["mask"])
        x = x.bitwiseXOR(_right(x, s["half"]))
    return x


def permuted(index: Column, n: Column, seed: Column, known: dict[str, Column] | None = None) -> Column:
    """A pseudorandom permutation of 0..n-1 at index, one for each seed; n is at most 2 ** 40.

    An index at n or above is a place where a walk goes on. known may give the constants of n and seed as columns.
    """
    known = known or _constants(n, seed)
    begin = F.struct(_step(index.cast("long"), known).alias("x"), n.alias("n"), *[c.alias(name) for name, c in known.items()])
    walk = lambda s, _: F.when(s["x"] < s["n"], s).otherwise(s.withField("x", _step(s["x"], s)))
    # Each step of the walk stays below n with a chance of half or more: few walks are longer than the first sequence.
    longer = lambda s: F.aggregate(F.sequence(F.lit(5), F.lit(64)), s, walk, lambda s: s["x"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), begin, walk, lambda s: F.when(s["x"] < s["n"], s["x"]).otherwise(longer(s)))


def with_permuted(rows: DataFrame, index: Column, n: str, seed: Column, out: str) -> DataFrame:
    """Add `out`: permuted(index, n, seed), with n a column of rows.

    The first STEPS steps are projections, which Spark compiles, while it interprets the lambdas of `permuted` for each
    row; that takes the rows whose walk is longer.
    """
    constants = {f"_{name}": c for name, c in _constants(F.col(n), seed).items()}
    known = {name[1:]: F.col(name) for name in constants}
    x = F.col(out)
    rows = rows.withColumns(constants).withColumn(out, _step(index.cast("long"), known))
    for _ in range(STEPS - 1):
        rows = rows.withColumn(out, F.when(x < F.col(n), x).otherwise(_step(x, known)))
    walked = F.when(x < F.col(n), x).otherwise(permuted(x, F.col(n), seed, known))
    # Never null: a join would look for nulls below the projections, and take the walk once more for that.
    return rows.withColumn(out, F.coalesce(walked, F.lit(-1).cast("long"))).drop(*constants)


def _right(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def placed(docs: DataFrame, carry: bool) -> DataFrame:
    """Rows with source, size and their place: sid, slice, number (unique together), start, source_size, target.

    Without carry, only doc_id and these; with carry, all columns of docs as the struct `row`.
    """
    kept = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = durable(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words_in(docs["text"]).alias("size"), *kept))
    plan = durable(targets(rows))
    slices = F.ceil(F.col("docs") / SLICE).cast("long").alias("slices")
    named = plan.select(F.col("source").alias("_name"), "sid", "source_size", "target", slices)
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_name"))).withColumn("token", F.xxhash64("doc_id", "size", F.lit(11)))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "size", F.lit(12)), F.col("slices"))).drop("_name", "slices")
    order = [F.col("token"), F.col("doc_id"), F.col("size")]
    if carry:
        rows = rows.withColumn("tie", F.xxhash64(F.col("row")["text"]))
        order.append(F.col("tie"))
    numbered = rows.withColumn("number", F.row_number().over(W.partitionBy("sid", "slice").orderBy(*order)))
    out = running(numbered, "sid", "slice", [F.col("number")], "size", "start")
    return durable(out.drop("token", "tie"))


def slots(plan: DataFrame) -> DataFrame:
    """(sid, pass, block): the blocks that the mix takes, of sources plan (sid, source_size, target)."""
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    plan = plan.where("target > 0").select("sid", "source_size", "target", blocks.alias("n"))
    # Slots a source should get: its target over the mean length of its blocks.
    plan = plan.withColumn("due", F.col("target") * F.col("n") / F.col("source_size"))
    plan = plan.withColumn("all", F.sum("due").over(W.partitionBy()))
    total = F.round("all").cast("long")
    # Two kinds of shard: the full ones, and the last.
    kinds = F.array(F.struct(F.lit(0).alias("last"), F.floor(total / SHARD).alias("shards"), F.lit(SHARD).cast("long").alias("slots")),
                    F.struct(F.lit(1).alias("last"), F.lit(1).cast("long").alias("shards"), (total % SHARD).alias("slots")))
    plan = plan.withColumn("kind", F.explode(kinds)).select("*", "kind.*").drop("kind").where("shards > 0 and slots > 0")
    share = F.col("slots") * F.col("due") / F.col("all")
    plan = plan.withColumn("given", F.floor(share)).withColumn("rest", share - F.col("given"))
    kind = W.partitionBy("last")
    plan = plan.withColumn("drawn", F.col("slots") - F.sum("given").over(kind)).withColumn("rests", F.sum("rest").over(kind))
    plan = plan.withColumn("hi", F.sum("rest").over(kind.orderBy("sid")) / F.col("rests")).withColumn("first_shard", F.when(F.col("last") == 1, F.floor(total / SHARD)).otherwise(F.lit(0)))
    plan = plan.withColumn("lo", F.coalesce(F.lag("hi").over(kind.orderBy("sid")), F.lit(0.0)))
    plan = durable(plan.withColumn("hi", F.when(F.col("sid") == F.max("sid").over(kind), F.lit(1.0)).otherwise(F.col("hi"))))

    # Draws: a uniform number for each slot that is left, and the source in whose range it falls.
    shards = plan.groupBy("last").agg(F.first("shards").alias("shards"), F.first("first_shard").alias("first_shard"), F.first("drawn").alias("drawn"))
    drawn = shards.where("drawn > 0").select("last", "drawn", F.explode(F.sequence(F.col("first_shard"), F.col("first_shard") + F.col("shards") - 1)).alias("shard"))
    drawn = drawn.select("last", "shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("drawn"))).alias("draw"))
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64("shard", "draw", F.lit(13)), F.lit(1 << 50)) / float(1 << 50))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * PICKS))
    ranges = plan.where("lo < hi").select("last", "sid", "lo", "hi")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * PICKS), F.least(F.floor(F.col("hi") * PICKS), F.lit(PICKS - 1).cast("long")))))
    # Rows that are spread from few grow with the mix, whatever their estimate: never broadcast.
    picked = drawn.hint("merge").join(ranges, ["last", "cell"]).where("u >= lo and u < hi").select("sid", "shard")
    given = plan.where("given > 0").select("sid", "given", F.explode(F.sequence(F.col("first_shard"), F.col("first_shard") + F.col("shards") - 1)).alias("shard"))
    counts = picked.select("sid", "shard", F.lit(1).cast("long").alias("count")).unionByName(given.select("sid", "shard", F.col("given").alias("count")))
    counts = counts.groupBy("sid", "shard").agg(F.sum("count").alias("count")).withColumn("chunk", F.floor(F.col("shard") / SLICE))
    counts = running(durable(counts), "sid", "chunk", [F.col("shard")], "count", "from")
    counts = durable(counts.join(plan.groupBy("sid").agg(F.first("n").alias("n")), "sid"))

    # Few rows become many: as many tasks as the slots ask for, not as the bytes of the counts do.
    tasks = -(-(counts.agg(F.sum("count")).first()[0] or 1) // SLOTS)
    one = counts.repartition(tasks, "sid", "shard").select("sid", "shard", "n", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("count") - 1)).alias("k"))
    one = one.withColumn("pass", F.floor(F.col("k") / F.col("n"))).where(F.col("pass") < MOST)
    return with_permuted(one, F.col("k") % F.col("n"), "n", F.xxhash64("sid", "pass"), "block").select("sid", "shard", "pass", "block")


def cut(rows: DataFrame) -> DataFrame:
    """(sid, slice, number, block, at, words): the parts of placed documents in the blocks of their source."""
    end = F.col("start") + F.col("size")
    spread = rows.where("size > 0").select(
        "sid", "slice", "number", "start", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * BLOCK)
    high = F.least(F.col("end"), (F.col("block") + 1) * BLOCK)
    return spread.select("sid", "slice", "number", "block", (low - F.col("start")).alias("at"), (high - low).alias("words"))


def _sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sid").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))


def met(rows: DataFrame) -> DataFrame:
    """Parts of documents and the slots that take them, by block index; both sides grow with the words: shuffled."""
    return cut(rows).hint("merge").join(slots(_sources(rows)).hint("merge"), ["sid", "block"])


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs (doc_id, text, source).

    Null texts have size 0; such rows, and those of a source without words, have taken 0. A null source is a source.
    Repeated rows are documents of their own. taken is at most MOST * size: a source's draws end after MOST passes.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = placed(docs, carry=False)
    key = ["sid", "slice", "number"]
    took = met(rows).groupBy(*key).agg(F.sum("words").alias("taken"))
    out = rows.join(took, key, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each document and pass that takes any of its words.

    Its text is the words that the pass takes, in the document's order, joined by a space; the text as it is where that
    is all of them. n_chars, where docs has it, is the new text's length. Documents without words are kept as they are.
    """
    rows = placed(docs, carry=True)
    key = ["sid", "slice", "number"]
    parts = met(rows)
    parts = parts.groupBy(*key, "pass").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"), F.sum("words").alias("taken"))
    out = rows.join(parts, key, "left").where("size = 0 or taken > 0")
    text = F.col("row")["text"]
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    chosen = F.flatten(F.transform("parts", lambda p: F.slice(F.col("found"), p["at"].cast("int") + 1, p["words"].cast("int"))))
    whole = F.coalesce(F.col("taken") == F.col("size"), F.lit(True))
    out = out.withColumn("found", F.when(~whole, found))
    out = out.select("row", F.when(whole, text).otherwise(F.array_join(chosen, " ")).alias("text"))
    fresh = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
