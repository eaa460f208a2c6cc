"""Mixing sources to target weights with DataFrame operations only.

Each row gets a hash-random key. Within a source, equal ranges of the key are
buckets; prefix sums of the buckets' words say in which bucket a source's
budget ends, and a prefix sum within that one bucket finds the row where it is
cut. Rows before the cut are taken once more than rows after it. So the wide
rows are never sorted or shuffled: they meet one small row for their source.

Null and empty texts have no words and are never cut; null sources are a source
of their own, the last; equal rows get equal shares, so a cut among m copies of
one row falls short of the budget by fewer than m words. An empty table gives
no rows. Other columns of the input are carried along untouched.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize, small

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_SPACE_BEFORE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
ROWS_A_BUCKET = 1_024
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """60 bits of a digest of the id; reruns and engines agree on it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) -> also target: the words each source should give.

    Weights repeat over the sources in code point order, null last. A target stops
    at ``most`` times the source's size, and what it can't take goes to the others by
    weight. In order of cap/weight, a source is capped exactly if its cap lies below
    its share of what the capped ones before it leave, so one pass settles it. The
    table has one row a source.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = (
        t.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("caps_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    t = t.withColumn("capped", F.col("cap") * F.col("weight_left") <= (F.col("all_words") - F.col("caps_before")) * F.col("weight"))
    t = t.withColumn("caps", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0)))
    t = t.withColumn("rest", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    share = (F.col("all_words") - F.col("caps")) * F.col("weight") / F.col("rest")
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def cuts(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (id, source, size, key) -> per source its target, whole epochs, and where the last epoch is cut."""
    rows = sizes.count()
    bits = min(20, max(0, ceil(log2(max(1, rows) / ROWS_A_BUCKET))))
    bucket = F.shiftright(F.col("key"), KEY_BITS - bits) if bits else F.lit(0).cast("long")
    sums = materialize(sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("if(source_size > 0, floor(target) div source_size, 0)"), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")

    at = lambda d, *on: [d[c].eqNullSafe(F.col(f"b.{c}")) for c in on]
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
    p = small(plan.select("source", F.col("rest").alias("due")).where("due > 0"))
    where = before.alias("a").join(p.alias("b"), at(before, "source"), "inner")
    where = where.where("due >= before and due < before + words").select("a.source", "a.bucket", (F.col("due") - F.col("before")).alias("due"))

    inside = sizes.withColumn("bucket", bucket)
    inside = inside.alias("a").join(small(where).alias("b"), at(inside, "source", "bucket"), "inner").select("a.*", "b.due")
    inside = inside.where("size > 0").groupBy("source", "key", "id", "size", "due").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size")
    words = F.col("copies") * F.col("size")
    inside = inside.withColumn("before", F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0)) - words)
    cut = inside.where((F.col("due") >= F.col("before")) & (F.col("due") < F.col("before") + words)).select(
        "source", F.struct("key", "id", "size", F.floor((F.col("due") - F.col("before")) / F.col("copies")).cast("long").alias("part")).alias("cut")
    )
    return plan.alias("a").join(small(cut).alias("b"), at(plan, "source"), "left").select("a.source", "a.source_size", "a.target", "a.epochs", "b.cut")


def share(source: Column, key: Column, doc_id: Column, size: Column) -> Column:
    """How much of a row the last, cut epoch takes: 1 all, 0 none, null the cut's ``part`` words."""
    before = (doc_id.isNull() & F.col("cut.id").isNotNull()) | (doc_id < F.col("cut.id"))
    same = doc_id.eqNullSafe(F.col("cut.id"))
    tie = F.when(before, 1).when(~same, 0).when(size < F.col("cut.size"), 1).when(size > F.col("cut.size"), 0)
    return F.when(F.col("cut").isNull(), 0).when(key < F.col("cut.key"), 1).when(key > F.col("cut.key"), 0).otherwise(tie)


def narrow(docs: DataFrame, seed: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), random_key(F.col(doc_id), seed).alias("key")
    )


def mix_taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """For each row of ``docs``: its words, its source's words and target, and the words the mix takes of it."""
    sizes = materialize(narrow(docs, seed), "mix-sizes")
    plan = small(materialize(cuts(sizes, weights, most), "mix-cuts"))
    j = sizes.alias("a").join(plan.alias("b"), F.expr("a.source <=> b.source"), "left")
    extra = share(F.col("a.source"), F.col("key"), F.col("id"), F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.coalesce(extra * F.col("size"), F.col("cut.part"))
    return j.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("a.source").alias("source"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each time a text is taken.

    The one text of a source that its budget cuts is shortened to the words taken.
    """
    sizes = materialize(narrow(docs, seed), "mix-sizes")
    plan = small(materialize(cuts(sizes, weights, most), "mix-cuts"))
    discard(sizes)
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    j = wide.alias("a").join(plan.alias("b"), F.expr("a.row.source <=> b.source"), "inner").select("row", "epochs", "cut")
    text = F.col("row.text")
    extra = share(F.col("row.source"), random_key(F.col("row.doc_id"), seed), F.col("row.doc_id"), word_count(text))
    shortened = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_AND_SPACE_BEFORE), F.lit(0)), 1, F.col("cut.part").cast("int")), "")
    j = j.withColumn("extra", extra).withColumn("whole", F.col("epochs") + F.coalesce("extra", F.lit(0)))
    part = F.col("extra").isNull() & (F.col("cut.part") > 0)
    copies = F.concat(F.array_repeat(F.lit(True), F.col("whole").cast("int")), F.when(part, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    j = j.withColumn("is_whole", F.explode(copies))
    columns = [(F.when(F.col("is_whole"), text).otherwise(shortened) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return j.select(*columns)


ORACLE = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key
  from documents),
totals as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight
  from sizes group by source),
caps as (
  select *, (source_size * 3)::double as cap, (sum(source_size) over ())::double as all_words from totals),
filled as (
  select *, sum(cap) over (order by cap / weight, source nulls last rows unbounded preceding) - cap as caps_before,
         sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_left
  from caps),
flagged as (select *, cap * weight_left <= (all_words - caps_before) * weight as capped from filled),
rested as (
  select *, coalesce(sum(cap) filter (capped) over (), 0.0) as capped_words, sum(weight) filter (not capped) over () as rest from flagged),
targets as (
  select source, source_size, case when capped then cap else (all_words - capped_words) * weight / rest end as target from rested),
plans as (
  select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from targets),
running as (
  select s.*, p.source_size, p.target, p.epochs, floor(p.target)::bigint - p.epochs * p.source_size as due,
         (sum(s.size) over (partition by s.source order by s.key, s.doc_id nulls first, s.size rows unbounded preceding) - s.size)::bigint as before
  from sizes s join plans p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, (epochs * size + least(greatest(due - before, 0), size))::bigint as taken, source
from running
"""
