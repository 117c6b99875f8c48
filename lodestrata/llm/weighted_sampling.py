"""Document fingerprints by consistent weighted sampling. Spark SQL expressions only.

A text is a set of weighted terms: its pairs of neighbouring words, lower-cased, weighted
by how often they occur. Each of the 64 samples has for each term three random values of its
own, which depend on the term and the sample alone: r and c of Gamma(2, 1) and b uniform in
[0, 1). A weight w falls on the step t = floor(ln w / r + b) of the term's own ladder of
weights, y = exp(r (t - b)), and the sample is the pair (term, t) of the least
a = c / (y exp(r)). Two texts draw the same pair with the probability of their generalised
Jaccard similarity, for any positive weights. A slot of the fingerprint is a hash of the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import bound, materialise, spread

SAMPLES, HEX = 64, 4
#: Samples of a term that are drawn by one row: 64 took 16.1 s, 8 took 9.0 s, 4 and 2 took 6.9 s for 4,000,000 terms on 8 cores.
EACH = 4
EMPTY = "-" * HEX
NONE, ANY = 2**63 - 1, -(2**63)


def terms(text: Column, side: int = 0) -> Column:
    """Even hashes of the words' neighbouring pairs (of the word, if it is the only one), with repeats, plus ``side``."""
    marked = lambda h: h.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side).cast("long"))

    def paired(words: Column) -> Column:
        pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: marked(F.xxhash64(a, b)))
        return F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: marked(F.xxhash64(w))))

    return bound(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), paired)


def drawn(each: DataFrame, sample: Column, name: str, every: int = EACH) -> DataFrame:
    """Add ``<name>0`` and so on: for the columns term and ln_w (the logarithm of the weight) one long in each of ``every`` samples from ``sample`` on.

    Its 47 upper bits grow with a, the 16 lower ones are a hash of (term, t): the least one of a set holds the set's draw.
    r = e1 + e2 and b = e2 / r of two exponential values are a Gamma(2, 1) and a uniform value that do not depend
    on each other; so exp(-r (1 - b)) is the uniform value u1 behind e1, and a = c u1 exp(-r t). In the same way
    c u1 is itself exponential, with c = c u1 + e3 and u1 = c u1 / c. The order is that of the uniform value
    1 - exp(-a), 46 bits of it, so for step 0, which most weights, those of 1, have, it is the hash itself. Other steps
    go on below a = 2**-30 and above 20 by the fourth root; those of weight 1 do so one time in 10**8 and keep the hash.
    """
    uniform = lambda h, at, bits: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(2.0**-bits)
    heavy = lambda x: F.when(F.col("ln_w") != 0, x)
    at = range(every)
    # One step a projection, so that what is used twice is not worked out twice.
    each = each.withColumns({f"_one{j}": F.xxhash64("term", sample + j) for j in at})
    each = each.withColumns({f"_two{j}": heavy(F.xxhash64("term", sample + (SAMPLES + j))) for j in at} | {f"_cu{j}": heavy(-F.log1p(-uniform(F.col(f"_one{j}"), 18, 46))) for j in at})
    each = each.withColumns({f"_lu{j}": F.ln(uniform(F.col(f"_two{j}"), 0, 32)) for j in at})
    each = each.withColumns({f"_l{j}": F.col(f"_lu{j}") + F.ln(F.col(f"_cu{j}") / (F.col(f"_cu{j}") - F.ln(uniform(F.col(f"_two{j}"), 32, 32)))) for j in at})
    each = each.withColumns({f"_t{j}": F.floor((F.col(f"_lu{j}") - F.col("ln_w")) / F.col(f"_l{j}")) for j in at})
    each = each.withColumns({f"_a{j}": F.col(f"_cu{j}") * F.exp(F.col(f"_l{j}") * F.col(f"_t{j}")) for j in at})

    def one(j: int) -> Column:
        h, a, t = F.col(f"_one{j}"), F.col(f"_a{j}"), F.col(f"_t{j}")
        root = F.sqrt(F.sqrt(a))
        order = F.when(a < 2.0**-30, root * 2.0**52).when(a <= 20, -F.expm1(-a) * 2.0**46 + 2.0**45).otherwise(F.least(root * 2.0**30 + (2.0**46 + 2.0**45), F.lit(2.0**47 - 2)))
        low = F.lit(0xFFFF)
        light = F.shiftrightunsigned(h, 2).bitwiseAND(F.lit(-0x10000)).bitwiseOR(h.bitwiseAND(low)) + F.lit(1 << 61)
        return F.when(F.col("ln_w") == 0, light).otherwise(F.shiftleft(order.cast("long"), 16).bitwiseOR(h.bitwiseXOR(t * F.lit(40503)).bitwiseAND(low)))

    return each.withColumns({f"{name}{j}": one(j) for j in at})


def _prints(rows: DataFrame, keys: list[str], sets: dict[str, Column]) -> DataFrame:
    """``keys`` and a fingerprint of each of ``sets``: those rows (term, weight) for which its condition holds. All grouping is by the keys."""
    holds = [F.when(F.col("term").isNotNull() & held, F.lit(ANY)).otherwise(F.lit(NONE)).alias(f"_h{i}") for i, held in enumerate(sets.values())]
    each = rows.select(*keys, "term", F.ln("weight").alias("ln_w"), *holds, F.explode(F.array(*[F.lit(s) for s in range(0, SAMPLES, EACH)])).alias("_s"))
    # Every draw is taken once, whichever of the sets hold the term.
    least = [F.min(F.greatest(F.col(f"_d{j}"), F.col(f"_h{i}"))).alias(f"_v{i}_{j}") for j in range(EACH) for i in range(len(sets))]
    slot = lambda v: F.when(v == NONE, EMPTY).otherwise(F.lower(F.lpad(F.hex(v.bitwiseAND(F.lit(16**HEX - 1))), HEX, "0")))
    parts = [F.concat(*[slot(F.col(f"_v{i}_{j}")) for j in range(EACH)]).alias(f"_p{i}") for i in range(len(sets))]
    drawn_parts = drawn(each, F.col("_s"), "_d").groupBy(*keys, "_s").agg(*least).select(*keys, F.struct("_s", *parts).alias("_part"))
    whole = drawn_parts.groupBy(*keys).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    return whole.select(*keys, *[F.array_join(F.col(f"_parts._p{i}"), "").alias(name) for i, name in enumerate(sets)])


def sampled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``slots`` of sets given as rows (keys, term long, weight double); null terms stand for empty sets, weights are positive."""
    return _prints(rows, keys, {"slots": F.lit(True)})


def in_either(even: Column, odd: Column) -> Column:
    """array<struct<term,weight,sides>> of the terms of two texts, marked by even and odd hashes: sides is 1 for a term of the first, 2 of the second, 3 where both have it equally often.

    One sort of all hashes brings a term's copies together, those of the first text before those of the second.
    """

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bound(
            starts,
            lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(n)), lambda a, b: F.struct(F.get(ordered, a).alias("mark"), (b - a).alias("weight"))),
        )

    def merged(found: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            # Marks of a term differ in their last bit alone.
            alike = lambda y: y.isNotNull() & (y["mark"].bitwiseXOR(x["mark"]) == 1) & (y["weight"] == x["weight"])
            first = x["mark"].bitwiseAND(F.lit(1)) == 0
            sides = F.when(first, F.when(alike(F.get(found, i + 1)), 3).otherwise(1)).otherwise(F.when((i > 0) & alike(F.get(found, i - 1)), 0).otherwise(2))
            return F.struct(x["mark"].bitwiseAND(F.lit(-2)).alias("term"), x["weight"].alias("weight"), sides.alias("sides"))

        return F.filter(F.transform(found, at), lambda x: x["sides"] > 0)

    none = F.array().cast("array<struct<term:bigint,weight:int,sides:int>>")
    return bound(F.sort_array(F.concat(even, odd)), lambda o: F.when(F.size(o) > 0, bound(runs(o), merged)).otherwise(none))


def signatures(texts: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """``keys``, which identify a row, and a fingerprint of two text columns, named ``<column>_fingerprint``.

    What both texts hold with one weight is drawn once for both. All grouping is by the keys; rows partitioned
    by a key already are not shuffled again, others meet as SAMPLES / EACH rows of least draws per text and task.
    """
    both = in_either(terms(F.col(first)), terms(F.col(second), 1))
    each = texts.select(*keys, F.explode_outer(both).alias("x")).select(*keys, "x.sides", "x.term", F.col("x.weight").cast("double").alias("weight"))
    return _prints(each, keys, {f"{first}_fingerprint": F.col("sides") != 2, f"{second}_fingerprint": F.col("sides") != 1})


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those filled in at least one fingerprint; 1 if both are of texts without terms."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.struct(F.substr(a, i * HEX + 1, F.lit(HEX)).alias("a"), F.substr(b, i * HEX + 1, F.lit(HEX)).alias("b")))
    filled = F.filter(slots, lambda s: (s["a"] != EMPTY) | (s["b"] != EMPTY))
    share = bound(filled, lambda f: F.when(F.size(f) == 0, 1.0).otherwise(F.try_divide(F.size(F.filter(f, lambda s: s["a"] == s["b"])).cast("double"), F.size(f))))
    return F.when(a.isNotNull() & b.isNotNull(), share)


def neighbours(ids: DataFrame) -> DataFrame:
    """For distinct non-null ``doc_id``: ``next_id``, the following one; after the last comes the first.

    Ids are dealt by range; only the first id of each range crosses ranges, so the one
    unpartitioned window has as many rows as there are partitions.
    """
    ranged = materialise(ids.repartitionByRange(spread(ids), "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    beyond = firsts.select("part", F.coalesce(F.lead("first_id").over(Window.orderBy("part")), F.min("first_id").over(Window.partitionBy())).alias("beyond"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("inside", inside).join(beyond, "part").select(*ids.columns, F.coalesce("inside", "beyond").alias("next_id"))


def fingerprint_edits(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of the texts and of edited texts, whose last floor(n / ``share``) code points come from the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; one row per input row. A null text is empty. If rows share a doc_id, the
    next document's text is the least of its rows' beginnings, and near_next compares with
    the row of the least fingerprint. Rows of null doc_id have no next document: their edit
    only cuts, and near_next is 0. With a single document it is its own next.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = base.select("doc_id", F.floor(F.length("text") / share).alias("want"))
    ids = sized.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("want").alias("want"))
    order = materialise(neighbours(ids), "next-ids")
    wanted = order.select(F.col("next_id").alias("w_id"), F.col("doc_id").alias("for_id"), "want")
    # Both joins filter alike, so that they share one exchange of the texts.
    dealt = base.where("doc_id IS NOT NULL").repartition(spread(docs), "doc_id")
    heads = (
        dealt.join(wanted, dealt["doc_id"] == F.col("w_id")).select("for_id", F.substr("text", F.lit(1), F.col("want").cast("int")).alias("head"))
        .groupBy("for_id").agg(F.min("head").alias("head"))
    )
    paired = dealt.join(heads, dealt["doc_id"] == F.col("for_id"), "left").withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("long"))
    nameless = base.where("doc_id IS NULL").withColumn("head", F.lit(None).cast("string")).withColumn("row", F.monotonically_increasing_id())
    n, cut = F.length("text"), F.floor(F.length("text") / share).cast("int")
    edit = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("head", F.lit("")), F.lit(1), cut))

    # As a key of every draw the digest is four whole numbers: a text of 64 characters took 9.1 s where these took 6.3 s.
    packed = {f"_sha{i}": F.conv(F.substr("edited_sha256", F.lit(1 + 16 * i), F.lit(16)), 16, -10).cast("long") for i in range(4)}

    def printed(rows: DataFrame) -> DataFrame:
        edited = rows.select("doc_id", "row", n.cast("long").alias("n_chars"), "text", edit.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256)).withColumns(packed)
        found = signatures(edited, ["doc_id", "row", "n_chars", *packed], "text", "edited")
        return found.withColumn("edited_sha256", F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in packed])))

    # Joined rows lie by doc_id already, so their texts are not shuffled again; rows without an id, if there are any, never were.
    prints = printed(paired)
    if not nameless.isEmpty():
        prints = prints.unionByName(printed(nameless))
    prints = materialise(
        prints.select("doc_id", "n_chars", "edited_sha256", F.col("text_fingerprint").alias("fingerprint"), F.col("edited_fingerprint")), "fingerprints"
    )
    after = order.select("doc_id", "next_id").join(
        prints.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint")), "next_id"
    )
    return (
        prints.join(after.drop("next_id"), "doc_id", "left")
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)))
        .drop("next_fingerprint")
    )
