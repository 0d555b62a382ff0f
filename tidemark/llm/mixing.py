"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame
functions only.

Targets. Sources by code point, null last, weigh 3, 1, 2, repeating, and share ``share`` times all words.
A target stops at twice its source's words; the excess is shared again by weight until none is above
(in closed form: sources by words over weight, prefix sums). Targets are rounded to whole words.

Draws. Each source's documents are put in the order of md5(doc_id), which makes one stream of words, cut
into blocks of ``block_words``. An affine map permutes the blocks. A source takes the whole stream as
often as its target holds it, and for the rest the first blocks of the permutation, the last one cut, so
that exactly the target is taken and no word more than twice.

Whole documents (``whole``). A document belongs to the block in which its first word lies, and a source takes
whole documents in the order of the permuted blocks, of which here the last one moves too. Where its target ends, those of the ``FITTED`` documents
around that place are taken whose words come nearest to it; so targets are near, not exact, and nothing is cut.

Tree. All draws start at the root. Every node halves its draws between two children, and the number of
each source's draws that go left is drawn from the hypergeometric law given what the sources before it
took; quotas are exact at each level, and a quota is a range of the source's draws, so shards never
overlap. ``mixed_texts`` brings the rows of a shard together and puts them in the order of ``place``, a hash,
which is the shard's local shuffle; a written mix holds its shards one after the other.

Scale. Word offsets come from two levels of sums (4,096 hash ranges for each source), so a source with a
third of all documents is never gathered. Sources are a dimension: the table with one row for each of
them is ranked in one task and travels as an array in each tree node.

Defined cases. Null text: no words, never drawn. Documents without words: taken 0. Null source: a
source of its own. Repeated rows are separate documents. Extra columns are ignored. Same input, same
seed, same mix. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.lines import numbered
from tidemark.session import scratch, stage

WEIGHTS = (3, 1, 2)
#: Multipliers of the affine map; the first that has no factor in common with the count is used.
PRIMES = (1_000_003, 1_000_033)

#: Documents of a source whose best subset ends the last pass, and ranges of blocks that are summed.
FITTED, RANGES = 12, 4096
#: Subsets that a source offers, nearest first.
OFFERS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, src, source_size, target) from rows of (source, size)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights))
    every = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    cap = 2.0 * F.col("source_size")
    level = (
        F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = F.when(cap >= F.col("level") * F.col("weight"), F.col("level"))
    first = F.min(F.when(cap >= F.col("level") * F.col("weight"), F.col("at"))).over(whole)
    chosen = F.min(F.when(F.col("at") == F.col("first"), open_)).over(whole)
    return (
        totals.withColumn("src", rank.cast("long"))
        .withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("at", F.row_number().over(every))
        .withColumn("first", first)
        .withColumn("chosen", chosen)
        .select(
            "source",
            "src",
            "source_size",
            F.when(F.col("at") < F.col("first"), cap).otherwise(F.col("chosen") * F.col("weight")).alias("target"),
        )
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a draw of ``drawn``: inverse of the distribution.

    Walks up from eight deviations below the mode to eight above, weights by their ratios.
    """

    def bounds(v: Column) -> Column:
        n, k, d = v["n"], v["k"], v["d"]
        mode = F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")
        deviation = F.sqrt(d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))
        reach = F.ceil(8 * deviation) + 8
        return F.struct(
            n.alias("n"),
            k.alias("k"),
            d.alias("d"),
            v["u"].alias("u"),
            F.greatest(F.lit(0.0), d - (n - k), mode - reach).cast("long").alias("start"),
            F.least(k, d, mode + reach).cast("long").alias("stop"),
        )

    def draw(v: Column) -> Column:
        steps = F.when(v["stop"] > v["start"], F.sequence(v["start"], v["stop"] - 1)).otherwise(
            F.array().cast("array<long>")
        )
        begun = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"))

        def grow(s: Column, x: Column) -> Column:
            w = s["w"] * ((v["k"] - x) * (v["d"] - x) / ((x + 1) * (v["n"] - v["k"] - v["d"] + x + 1)))
            return _let(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

        def walk(goal: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                grown = grow(s, x)
                return _let(
                    grown,
                    lambda g: F.struct(
                        g["w"].alias("w"),
                        g["sum"].alias("sum"),
                        F.when(s["sum"] < goal, x + 1).otherwise(s["at"]).alias("at"),
                    ),
                )

            first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), v["start"].alias("at"))
            return F.aggregate(steps, first, step, lambda s: s["at"])

        return _let(F.aggregate(steps, begun, grow, lambda s: s["sum"]) * v["u"], walk)

    given = F.struct(
        total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("d"), uniform.alias("u")
    )
    found = _let(given, lambda v: _let(bounds(v), draw))
    return F.when(total > 0, found).otherwise(F.lit(0)).cast("long")


def _uniform(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split_quotas(quotas: DataFrame, levels: int, seed: int = 1) -> DataFrame:
    """(shard, src, begin, until) for 2**levels shards, from (src, draws)."""
    spark = quotas.sparkSession
    root = scratch(spark)
    nodes = quotas.agg(
        F.array_sort(
            F.collect_list(F.struct("src", F.lit(0).cast("long").alias("begin"), F.col("draws").alias("until")))
        ).alias("quota")
    ).select(F.lit(0).cast("long").alias("node"), "quota")

    def take(s: Column, q: Column) -> Column:
        n = q["until"] - q["begin"]
        drawn = _hypergeometric(s["total"], n, s["left"], _uniform(F.lit(seed), s["salt"], q["src"]))
        return _let(
            drawn,
            lambda x: F.struct(
                (s["total"] - n).alias("total"),
                (s["left"] - x).alias("left"),
                s["salt"].alias("salt"),
                F.concat(s["cuts"], F.array(q["begin"] + x)).alias("cuts"),
            ),
        )

    for level in range(levels):
        count = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q["until"] - q["begin"])
        begun = F.struct(
            F.col("count").alias("total"),
            F.floor(F.col("count") / 2).cast("long").alias("left"),
            F.xxhash64(F.lit(level), "node").alias("salt"),
            F.array().cast("array<long>").alias("cuts"),
        )
        cut = nodes.withColumn("count", count).withColumn("cuts", F.aggregate("quota", begun, take, lambda s: s["cuts"]))
        left = F.zip_with("quota", "cuts", lambda q, c: F.struct(q["src"].alias("src"), q["begin"].alias("begin"), c.alias("until")))
        right = F.zip_with("quota", "cuts", lambda q, c: F.struct(q["src"].alias("src"), c.alias("begin"), q["until"].alias("until")))
        nodes = cut.select("node", F.posexplode(F.array(left, right)).alias("side", "quota")).select(
            (F.col("node") * 2 + F.col("side")).alias("node"), "quota"
        )
        if level % 4 == 3:  # short plans, and enough tasks for the levels below
            nodes = stage(nodes.repartition("node"), f"{root}/{level}")
    return nodes.select(F.col("node").alias("shard"), F.explode("quota").alias("q")).select(
        "shard", "q.src", "q.begin", "q.until"
    )


class Mix:
    """``sizes``: a row for each document; ``drawn``: a row for each piece of a document in the mix."""

    def __init__(self, sizes: DataFrame, drawn: DataFrame):
        self.sizes, self.drawn = sizes, drawn


def _whole_pieces(placed: DataFrame) -> DataFrame:
    """A row for each copy of a document that its source takes whole."""
    placed = placed.withColumn("range", F.expr(f"at * {RANGES} div blocks"))
    along = Window.partitionBy("src").orderBy("range")
    ranges = (
        placed.groupBy("src", "range")
        .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        .withColumn("end", F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("begin", F.col("end") - F.col("words"))
        .withColumn("low", F.coalesce(F.lag("range").over(along), F.col("range")))
        .withColumn("high", F.coalesce(F.lead("range").over(along), F.col("range")))
        .withColumn("base", F.coalesce(F.lag("begin").over(along), F.col("begin")))
    )
    # The range in which a target ends, with its neighbours: a row for each source whose last pass is not empty.
    zones = ranges.filter("begin < rest AND rest <= end").select("src", "low", "high", "base")
    inside = Window.partitionBy("src").orderBy("at", "offset")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("src")
    near = (
        placed.join(zones, "src")
        .filter("range BETWEEN low AND high")
        .select("src", "offset", "at", "size", (F.col("rest") - F.col("base")).alias("left"))
        .withColumn("nth", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(upto))
        .withColumn("last", F.min(F.when(F.col("end") >= F.col("left"), F.col("nth"))).over(every))
        .withColumn("k", F.col("nth") - F.col("last") + FITTED // 2)  # 0 to FITTED - 1: may be taken or not
    )
    candidate = F.col("k").between(0, FITTED - 1)
    asked = near.groupBy("src").agg(
        F.sort_array(
            F.collect_list(F.when(candidate, F.struct("k", F.col("size").cast("long").alias("size"))))
        ).alias("some"),
        (F.first("left") - F.coalesce(F.sum(F.when(F.col("k") < 0, F.col("size"))), F.lit(0))).alias("gap"),
    )
    none = F.array(F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("bits")))
    subsets = F.aggregate(
        "some",
        none,
        lambda found, c: F.concat(
            found,
            F.transform(
                found,
                lambda f: F.struct(
                    (f["sum"] + c["size"]).alias("sum"), (f["bits"] + F.pow(F.lit(2.0), c["k"]).cast("long")).alias("bits")
                ),
            ),
        ),
    )
    near_ones = F.slice(
        F.array_sort(
            F.transform(
                subsets,
                lambda f: F.struct(
                    F.abs(f["sum"] - F.col("gap")).alias("off"), (f["sum"] - F.col("gap")).alias("over"), f["bits"].alias("bits")
                ),
            )
        ),
        1,
        OFFERS,
    )
    # What a source takes too much or too little, the next ones make up for, those that fit best last.
    def choose(s: Column, row: Column) -> Column:
        best = F.array_min(
            F.transform(
                row["offers"],
                lambda o: F.struct(F.abs(s["over"] + o["over"]).alias("off"), o["over"].alias("over"), o["bits"].alias("bits")),
            )
        )
        return _let(
            best,
            lambda x: F.struct(
                (s["over"] + x["over"]).alias("over"),
                F.concat(s["found"], F.array(F.struct(row["src"].alias("src"), x["bits"].alias("bits")))).alias("found"),
            ),
        )

    begun = F.struct(F.lit(0).cast("long").alias("over"), F.array().cast("array<struct<src:bigint,bits:bigint>>").alias("found"))
    fitted = (
        asked.select("src", near_ones.alias("offers"))
        .select(F.struct((-F.col("offers")[0]["off"] - F.col("offers")[F.size("offers") - 1]["off"]).alias("fit"), "src", "offers").alias("row"))
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select(F.explode(F.aggregate("rows", begun, choose, lambda s: s["found"])).alias("f"))
        .select("f.src", "f.bits")
    )
    picked = (
        near.join(fitted, "src")
        .filter((F.col("k") < 0) | (candidate & (F.expr("pmod(bits div cast(pow(2.0, greatest(k, 0)) as long), 2)") == 1)))
        .select("src", "offset", F.lit(1).alias("picked"))
    )
    last = (F.col("range") < F.col("low")) | F.col("picked").isNotNull()
    return (
        placed.join(zones.select("src", "low"), "src", "left")
        .join(picked, ["src", "offset"], "left")
        .withColumn("copies", F.col("whole") + F.coalesce(last, F.lit(False)).cast("long"))
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            "doc_id",
            "src",
            "offset",
            "copy",
            (F.col("copy") * F.col("blocks") + F.col("at")).alias("draw"),
            F.col("offset").alias("from"),
            F.col("size").alias("n_words"),
        )
    )


def mix_sources(
    documents: DataFrame,
    share: float = 1.5,
    block_words: int = 1024,
    shard_words: int = 1 << 20,
    seed: int = 1,
    whole: bool = False,
) -> Mix:
    """``sizes``: (doc_id, source, src, size, source_size, target, offset). ``drawn``: (doc_id, src,
    offset, copy, first_word, n_words, shard, place): words of a document that one draw takes, all of them if ``whole``."""
    spark = documents.sparkSession
    root = scratch(spark)
    counted = stage(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn(
            "order", F.md5(F.col("doc_id").cast("string"))
        ),
        f"{root}/counted",
    )
    targets = stage(source_targets(counted, share), f"{root}/targets")
    rows = counted.join(
        targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).withColumn("range", F.substring(F.coalesce("order", F.lit("")), 1, 3))
    inside = Window.partitionBy("src", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("src", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select("src", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("begin"))
    sizes = stage(
        rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(begins, ["src", "range"])
        .select(
            "doc_id", "source", "src", "size", "source_size", "target", (F.col("begin") + F.col("_in")).alias("offset")
        ),
        f"{root}/sizes",
    )
    b = F.lit(block_words).cast("long")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    plan = (
        targets.filter("source_size > 0")
        .select("src", "source_size", goal.alias("goal"))
        .withColumn("blocks", F.expr(f"(source_size + {block_words} - 1) div {block_words}"))
        .withColumn("whole", F.expr("goal div source_size"))
        .withColumn("rest", F.col("goal") - F.col("whole") * F.col("source_size"))
        .withColumn("full", F.expr(f"rest div {block_words}"))
        .withColumn("draws", F.col("whole") * F.col("blocks") + F.col("full") + (F.col("rest") % b > 0).cast("long"))
    )
    multiplier = F.when((F.col("blocks") - 1) % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1]))
    permuted = (
        F.when(F.col("block") == F.col("blocks") - 1, F.col("block"))
        .otherwise(F.pmod(F.col("block") * multiplier + F.lit(7919) * (F.col("src") + 1), F.col("blocks") - 1))
        .cast("long")
    )
    plan = stage(plan, f"{root}/plan")
    if whole:
        multiplier = F.when(F.col("blocks") % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1]))
        anywhere = F.pmod(F.col("block") * multiplier + F.lit(7919) * (F.col("src") + 1), F.col("blocks")).cast("long")
        placed = (
            sizes.filter("size > 0")
            .drop("source_size")
            .join(plan.drop("draws"), "src")
            .withColumn("block", F.expr(f"offset div {block_words}"))
            .withColumn("at", anywhere)
        )
        pieces = stage(_whole_pieces(stage(placed, f"{root}/placed")), f"{root}/pieces")
        plan = stage(pieces.groupBy("src").agg((F.max("draw") + 1).alias("draws"), F.sum("n_words").alias("goal")), f"{root}/draws")
    words = plan.agg(F.sum("goal")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, words) / shard_words)))
    shards = stage(split_quotas(plan.select("src", "draws"), levels, seed), f"{root}/shards")
    shard_of = shards.filter("until > begin").select(
        "src", "shard", F.explode(F.sequence("begin", F.col("until") - 1)).alias("draw")
    )
    if not whole:
        # Pieces: where a document meets a block.
        block = F.explode(
            F.sequence(F.expr(f"offset div {block_words}"), F.expr(f"(offset + size - 1) div {block_words}"))
        )
        pieces = (
            sizes.filter("size > 0")
            .drop("source_size")
            .join(plan, "src")
            .withColumn("block", block)
            .withColumn("at", permuted)
            .withColumn("from", F.greatest(F.col("offset"), F.col("block") * b))
            .withColumn("n", F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * b) - F.col("from"))
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
            .withColumn("draw", F.col("copy") * F.col("blocks") + F.col("at"))
            .withColumn(
                "limit",
                F.when((F.col("copy") < F.col("whole")) | (F.col("at") < F.col("full")), b)
                .when(F.col("at") == F.col("full"), F.col("rest") % b)
                .otherwise(F.lit(0).cast("long")),
            )
            .withColumn("n_words", F.least(F.col("n"), F.col("limit") - (F.col("from") - F.col("block") * b)))
            .filter("n_words > 0")
        )
    drawn = pieces.join(shard_of.hint("merge"), ["src", "draw"]).select(
        "doc_id",
        "src",
        "offset",
        "copy",
        (F.col("from") - F.col("offset")).alias("first_word"),
        "n_words",
        "shard",
        F.xxhash64(F.lit(seed), "src", "draw").alias("place"),
    )
    return Mix(sizes, drawn)


def taken_words(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    taken = mix.drawn.groupBy("src", "offset").agg(F.sum("n_words").alias("_taken"))
    some = mix.sizes.filter("size > 0").join(taken, ["src", "offset"], "left")
    none = mix.sizes.filter("size = 0").withColumn("_taken", F.lit(0).cast("long"))
    return some.unionByName(none).select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )


def mixed_texts(documents: DataFrame, mix: Mix) -> DataFrame:
    """A row for each document and copy in the mix, ``text`` holding the words that copy takes, in order
    and with the white space before each; other columns are those of ``documents``. Rows come shard by shard,
    each shard in one task and shuffled locally; a cut copy stands where its first piece does.

    Documents at the edges of the blocks of the last pass are cut, unless the mix takes ``whole`` ones.
    """
    documents, names = numbered(documents, ("doc_id", "text", "source"))
    key = [
        F.xxhash64("doc_id", "source", "_words").alias("_k1"),
        F.xxhash64(F.lit(5), "doc_id", "source", "_words").alias("_k2"),
    ]
    copies = (
        mix.drawn.groupBy("src", "offset", "copy")
        .agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("_ranges"), F.sum("n_words").alias("_n"), F.min(F.struct("first_word", "shard", "place")).alias("_at"))
        .join(mix.sizes.filter("size > 0").withColumnRenamed("size", "_words"), ["src", "offset"])
        .select(*key, "offset", F.struct("_ranges", "_n", "_at").alias("_copy"))
    )
    # Rows that share doc_id, source and size can take each other's place.
    row = F.dense_rank().over(Window.partitionBy("_k1", "_k2").orderBy("offset"))
    wanted = (
        copies.withColumn("_row", row)
        .groupBy("_k1", "_k2")
        .agg(F.collect_list(F.struct("_row", "_copy")).alias("_copies"))
    )
    met = (
        documents.withColumn("_words", word_count(F.col("text")))
        .select("*", *key)
        .join(wanted, ["_k1", "_k2"])
        .withColumn("_row", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")))
        .withColumn("_mine", F.explode(F.filter("_copies", lambda c: c["_row"] == F.col("_row"))))
    )
    tokens = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    slices = F.transform(
        F.col("_mine")["_copy"]["_ranges"],
        lambda r: F.array_join(F.slice(F.col("_tokens"), (r["first_word"] + 1).cast("int"), r["n_words"].cast("int")), ""),
    )
    whole = F.col("_mine")["_copy"]["_n"] == F.col("_words")
    cut = met.withColumn("_whole", whole).withColumn("_tokens", F.when(~whole, tokens))
    at = F.col("_mine")["_copy"]["_at"]
    return (
        cut.withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(F.array_join(slices, "")))
        .select(*documents.columns, at["shard"].alias("_shard"), at["place"].alias("_place"))
        .repartition("_shard")
        .sortWithinPartitions("_shard", "_place", F.xxhash64("doc_id"))
        .select(*documents.columns)
        .toDF(*names)
    )
