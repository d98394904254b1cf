"""Queries over prefix trees of item sets; the sets are the orders' baskets of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweave.operators import compare, lists, tree, walk
from primeweave.plans.registry import query, table
from primeweave.stages import Stages

PATH_SQL = "with recursive b as (select l_orderkey, list(distinct l_partkey order by l_partkey) as path from lineitem group by 1), p as (select distinct path from b)"
ORDER_SQL = PATH_SQL + """,
 it as (select item, count(*) as cnt from (select unnest(path) as item from p) group by 1),
 cl as (select cnt, count(*) as class_size, row_number() over (order by cnt desc) as class_id from it group by 1),
 o as (select item, it.cnt, row_number() over (order by it.cnt desc, item desc) as rank, class_id, class_size, row_number() over (order by item) as value_index from it join cl on it.cnt = cl.cnt),
 rp as (select path, list(rank order by rank) as ranks from (select path, unnest(path) as item from p) join o using (item) group by 1),
 pre as (select ranks[1:k] as prefix, k as depth, k = len(ranks) as fin from (select ranks, unnest(range(0, len(ranks) + 1)) as k from rp)),
 nd as (select prefix, any_value(depth)::int as depth, bool_or(fin) as terminal, count(*) as paths from pre group by prefix),
 nr as (select *, coalesce(prefix[depth], 0) as rank, case when depth > 0 then prefix[1:depth - 1] end as parent from nd),
 si as (select *, row_number() over (partition by parent order by rank) - 1 as sibling, count(*) over (partition by parent) as siblings,
        coalesce(lag(rank) over (partition by parent order by rank), parent[depth - 1], 0) as before from nr where depth > 0),
 cc as (select parent as prefix, count(*) as c from si group by 1),
 ch as (select nr.*, sibling, siblings, before, si.rank - before as gap, coalesce(c, 0) as c from nr left join si using (prefix) left join cc on nr.prefix = cc.prefix),
 m as (select count(*) as m, length(bin(count(*))) + 1 as ab from o)"""
_CAP = "least(case when {v} > 0 then length(bin({v})) else 0 end, {k})"
_BITS = "(case when {v} > 0 then length(bin({v})) else 0 end)"
_BUCKET = "case when {v} <= 1 then 0 when {v} <= 3 then 1 when {v} <= 15 then 2 else 3 end"
PRODUCT_SQL = ORDER_SQL + """,
 pq as (select ch.prefix, coalesce(list_reduce(list_prepend(1::hugeint, list_transform(list(item), lambda x: x::hugeint)), lambda a, b: least(a * b, 1::hugeint << 81)), 1::hugeint) as q
        from (select prefix, unnest(prefix) as rank from ch where depth > 0) ch join o using (rank) group by ch.prefix),
 cb as (select ch.*, case when coalesce(q, 1) = 0 then 0 else least(length(bin(coalesce(q, 1::hugeint))), 81) end as pbits from ch left join pq using (prefix)),
 gk as (select x.*, y.pbits as above, x.siblings - x.sibling as lft, (x.sibling = 0)::int as f, (m - x.before) // (x.siblings - x.sibling) as room, ab, m from cb x join cb y on x.parent = y.prefix, m where x.depth > 0)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.baskets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def built(spark: SparkSession, sf_dir: str, prefixes: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order, ranked paths, nodes with their children's figures."""
    p = paths(spark, sf_dir).persist()  # each is read by several jobs
    order = tree.item_order(tree.item_counts(p).persist()).persist()
    ranks = tree.ranked_paths(p, order)
    return order, ranks, tree.children(tree.nodes(ranks, prefixes))


def _chunked(spark: SparkSession, sf_dir: str, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Order, and the sorted paths in chunks; each step is staged, for several jobs read it."""
    p = stages.put(tree.named_baskets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"), "paths")
    counts = stages.put(tree.item_counts(p), "counts")
    order = stages.put(tree.item_order(counts), "order")
    ranks = stages.put(tree.ranked_paths(p, order, "id"), "ranks")
    stages.drop(p, counts)
    out = walk.chunks(stages, ranks)
    stages.drop(ranks)
    return order, out


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query("item_counts", PATH_SQL + " select item, count(*) as cnt from (select unnest(path) as item from p) group by 1")
def _(spark, d):
    return tree.item_counts(paths(spark, d))


@query("item_order", ORDER_SQL + " select item, cnt, rank from o")
def _(spark, d):
    return tree.item_order(tree.item_counts(paths(spark, d)).persist()).select("item", "cnt", "rank")


@query("count_classes", ORDER_SQL + " select class_id, cnt, class_size from cl")
def _(spark, d):
    return tree.item_order(tree.item_counts(paths(spark, d)).persist()).select("class_id", "cnt", "class_size").distinct()


@query("value_index", ORDER_SQL + " select item, value_index from o")
def _(spark, d):
    return tree.item_order(tree.item_counts(paths(spark, d)).persist()).select("item", "value_index")


@query("top_items", ORDER_SQL + " select item, cnt, rank from o where rank <= 10")
def _(spark, d):
    return tree.item_order(tree.item_counts(paths(spark, d)).persist()).select("item", "cnt", "rank").orderBy("rank").limit(10)  # a top-k report


@query("path_length_hist", PATH_SQL + " select len(path)::int as length, count(*) as cnt from p group by 1")
def _(spark, d):
    return paths(spark, d).groupBy(F.size("path").alias("length")).agg(F.count("*").alias("cnt"))


@query("depth_max", PATH_SQL + " select k::int as depth, max(path[k]) as greatest from (select path, unnest(range(1, len(path) + 1)) as k from p) group by 1")
def _(spark, d):
    return paths(spark, d).select(F.posexplode("path").alias("k", "item")).groupBy((F.col("k") + 1).alias("depth")).agg(F.max("item").alias("greatest"))


@query("ranked_paths", ORDER_SQL + " select array_to_string(path, ' ') as path, array_to_string(ranks, ' ') as ranks from rp")
def _(spark, d):
    return built(spark, d)[1].select(_joined("path").alias("path"), _joined("ranks").alias("ranks"))


@query("paths_value_order", PATH_SQL + " select array_to_string(list_reverse(path), ' ') as reversed, row_number() over (order by path[len(path)], path) - 1 as place from p")
def _(spark, d):
    rows = paths(spark, d).withColumn("top", F.array_max("path"))
    return lists.ranked(rows, "top", F.col("path").asc(), name="place").select(_joined(F.reverse("path")).alias("reversed"), "place")


@query("tree_nodes", ORDER_SQL + " select array_to_string(prefix, ' ') as prefix, depth, rank, terminal, paths from nr")
def _(spark, d):
    return built(spark, d, True)[2].select(_joined("prefix").alias("prefix"), "depth", "rank", "terminal", "paths")


@query("tree_levels", ORDER_SQL + " select depth, count(*) as nodes, count(*) filter (terminal) as terminals, sum(c)::bigint as children, sum(paths)::bigint as paths from ch group by 1")
def _(spark, d):
    return built(spark, d)[2].groupBy("depth").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("terminal"), 1)).alias("terminals"), F.sum("c").alias("children"), F.sum("paths").alias("paths"))


@query("tree_children_gaps", ORDER_SQL + " select array_to_string(prefix, ' ') as prefix, sibling::int as sibling, siblings, before, gap from ch where depth > 0")
def _(spark, d):
    return built(spark, d, True)[2].where("depth > 0").select(_joined("prefix").alias("prefix"), "sibling", "siblings", "before", "gap")


@query("count_symbols", ORDER_SQL + " select array_to_string(prefix, ' ') as prefix, c, least(c, 4095) as set1, least(c, 63) as set2, case when c >= 63 then least(c, 4095) end as tail, case when c >= 4095 then c - 4094 end as escape from ch")
def _(spark, d):
    c = F.col("c")
    return built(spark, d, True)[2].select(_joined("prefix").alias("prefix"), "c", F.least(c, F.lit(4095)).alias("set1"), F.least(c, F.lit(63)).alias("set2"), F.when(c >= 63, F.least(c, F.lit(4095))).alias("tail"), F.when(c >= 4095, c - 4094).alias("escape"))


@query("raw_tree_bits", ORDER_SQL + " select sum(length(bin(gap)) - 1)::bigint as raw_bits from ch where depth > 0")
def _(spark, d):
    return tree.raw_bits(built(spark, d)[2]).select(F.col("raw_bits").cast("long").alias("raw_bits"))


STREAM_SQL = ORDER_SQL + """, ev as (select prefix, 0 as phase, 4 as cls, length(bin(gap)) as sym, length(bin(gap)) - 1 as w from ch where depth > 0
 union all select prefix, 1, 1, least(c, 63), case when c >= 4095 then 2 * length(bin(c - 4094)) - 1 else 0 end from ch
 union all select prefix, 2, 2, least(c, 4095), 0 from ch where c >= 63
 union all select prefix, 3, 3, terminal::bigint, 0 from ch where c > 0 and depth > 0)"""


@query("tree_stream", STREAM_SQL + " select row_number() over (order by prefix, phase) - 1 as position, cls::int as cls, sym::bigint as sym, (sum(w) over (order by prefix, phase) - w)::bigint as raw_at, w::bigint as raw_width from ev")
def _(spark, d):
    return walk.stream(_chunked(spark, d, Stages(spark))[1])


@query("table_gaps", ORDER_SQL + " select class_id, item, value_index - 1 as position, value_index - 1 - coalesce(lag(value_index - 1) over (partition by class_id order by value_index), -1) as gap from o")
def _(spark, d):
    return tree.table_gaps(tree.item_order(tree.item_counts(paths(spark, d)).persist()))


SET1_SQL = ORDER_SQL + f""", k as (select max(depth) as k from ch),
 s1 as (select 82 + depth * 42 + {_CAP.format(v="coalesce(value_index, m + 1)", k=41)} as ctx, least(c, 4095) as sym from ch left join o using (rank), m
  union all select 82 + (k + 1) * 42 + depth - 1, terminal::bigint from ch, k where c > 0 and depth > 0
  union all select 82 + (k + 1) * 42 + k + ((depth - 1) * 4 + {_BUCKET.format(v="siblings")}) * 42 + {_CAP.format(v="coalesce(parent[depth - 1], 0)", k=41)}, length(bin(gap)) from ch, k where depth > 0)"""


@query("tree_context_set1", SET1_SQL + " select ctx::bigint as ctx, sym::bigint as sym, count(*) as cnt from s1 group by 1, 2")
def _(spark, d):
    order, ranks, rows = built(spark, d)
    deepest = int(ranks.agg(F.max(F.size("ranks"))).first()[0] or 0)
    return tree.histogram(tree.set1_symbols(rows, order, deepest), "ctx")


SET2_SQL = PRODUCT_SQL + f""", s2 as (
 select 1 as cls, (((depth * ab + {_BITS.format(v="rank")}) * 82 + pbits) * 2 + coalesce((sibling = 0)::int, 0)) * 14 + {_CAP.format(v="coalesce(siblings - sibling - 1, 0)", k=13)} as key, least(c, 63) as sym from cb, m
 union all select 2, depth, least(c, 4095) from cb where c >= 63
 union all select 3, (depth - 1) * 4 + {_BUCKET.format(v="c")}, terminal::bigint from cb where c > 0 and depth > 0
 union all select 4, ((((((depth - 1) * 4 + {_BUCKET.format(v="siblings")}) * 2 + f) * ab + {_BITS.format(v="before")}) * ab + {_BITS.format(v="room")}) * 14 + {_CAP.format(v="lft", k=13)}) * 41 + above // 2, length(bin(gap)) from gk),
 h2 as (select cls::int as cls, key::bigint as key, sym::bigint as sym, count(*) as cnt from s2 group by 1, 2, 3)"""


@query("tree_context_set2", SET2_SQL + " select cls, count(*) as keys, sum(n)::bigint as symbols, sum(key)::hugeint::varchar as key_sum from (select cls, key, sum(cnt) as n from h2 group by 1, 2) group by 1")
def _(spark, d):
    order, _, rows = built(spark, d)
    h = tree.set2_symbols(rows, order).groupBy("cls", "key").agg(F.count("*").alias("n"))
    return h.groupBy("cls").agg(F.count("*").alias("keys"), F.sum("n").alias("symbols"), F.sum(F.col("key").cast("decimal(25,0)")).cast("string").alias("key_sum"))


@query("context_histogram", SET2_SQL + " select * from h2")
def _(spark, d):
    order, _, rows = built(spark, d)
    return tree.histogram(tree.set2_symbols(rows, order), "cls", "key")


@query("context_entropy", SET2_SQL + ", t as (select cls, key, sum(cnt) as n from h2 group by 1, 2) select h2.cls, sum(cnt)::bigint as n, round(sum(-cnt * log2(cnt / n)), 2) as entropy_bits from h2 join t on h2.cls = t.cls and h2.key = t.key group by 1")
def _(spark, d):
    order, _, rows = built(spark, d)
    e = lists.entropy(tree.histogram(tree.set2_symbols(rows, order), "cls", "key"), "cls", "key")
    return e.groupBy("cls").agg(F.sum("n").alias("n"), F.round(F.sum("entropy_bits"), 2).alias("entropy_bits"))


_VB = "(case when l <= 12 then l - 1 else 4 end)"
MANTISSA_SQL = PRODUCT_SQL + f""", mg as (select *, length(bin(gap)) as l from gk where gap >= 2),
 ms as (select (case when before < 1024 then before + 1024 * f else 2048 + (((depth - 1) * 2 + f) * ab + {_BITS.format(v="before")}) * ab + {_BITS.format(v="room")} end) * 64 + l as key, (gap - (1::bigint << (l - 1)::int)) >> (l - 1 - {_VB})::int as sym, {_VB} as vb from mg)"""


@query("tree_mantissa_keys", MANTISSA_SQL + " select key::bigint as key, sym::bigint as sym, vb::int as vb, count(*) as cnt from ms group by 1, 2, 3")
def _(spark, d):
    order, _, rows = built(spark, d)
    return tree.histogram(tree.mantissa_symbols(rows, order), "key", "vb")


QUANT_SQL = SET1_SQL + """, h as (select ctx, sym, count(*) as cnt from s1 group by 1, 2), ex as (select *, cnt / sum(cnt) over (partition by ctx)::double * 65536.0 as exact from h),
 bs as (select *, greatest(1, floor(exact))::bigint as base from ex), sh as (select *, 65536 - sum(base) over (partition by ctx) as short, row_number() over (partition by ctx order by exact - base desc, sym desc) as turn, count(*) over (partition by ctx) as n from bs)
 select ctx::bigint as ctx, sym::bigint as sym, cnt, (base + short // n + case when turn <= short % n then 1 else 0 end)::bigint as freq from sh where short >= 0"""


@query("model_quantize", QUANT_SQL)
def _(spark, d):
    order, ranks, rows = built(spark, d)
    deepest = int(ranks.agg(F.max(F.size("ranks"))).first()[0] or 0)
    return tree.quantized(tree.histogram(tree.set1_symbols(rows, order, deepest), "ctx"), "ctx")


_VBYTE = "greatest(1, ceil(length(bin({v})) / 7.0))"


def _model_sql(histogram: str, keys: str) -> str:
    """Quantised models of a histogram relation and their sizes, by keys."""
    return f""", ex as (select *, cnt / sum(cnt) over (partition by {keys})::double * 65536.0 as exact from {histogram}),
 bs as (select *, greatest(1, floor(exact))::bigint as base from ex), sh as (select *, 65536 - sum(base) over (partition by {keys}) as short, row_number() over (partition by {keys} order by exact - base desc, sym desc) as turn, count(*) over (partition by {keys}) as sy from bs),
 fr as (select *, (base + short // sy + case when turn <= short % sy then 1 else 0 end)::bigint as freq, sym - coalesce(lag(sym) over (partition by {keys} order by sym), 0) as step from sh),
 mo as (select {keys}, count(*) as symbols, sum(cnt)::bigint as n, (sum({_VBYTE.format(v="step")} + {_VBYTE.format(v="freq - 1")}) + {_VBYTE.format(v="count(*)")})::bigint as size, sum(cnt * (16 - log2(freq))) as ideal from fr group by {keys})"""


COST_SQL = SET2_SQL + _model_sql("h2", "cls, key") + f""", kg as (select *, key - coalesce(lag(key) over (partition by cls order by key), 0) as kgap from mo)
 select cls, count(*) as keys, sum(n)::bigint as n, (sum(size + {_VBYTE.format(v="kgap")}) + {_VBYTE.format(v="count(*)")})::bigint as table_bytes, round(sum(ideal), 2) as ideal_bits from kg group by 1"""


@query("table_costs", COST_SQL)
def _(spark, d):
    stages = Stages(spark)
    order, staged = _chunked(spark, d, stages)
    symbols = stages.put(tree.histogram(tree.set2_symbols(walk.nodes(staged), order), "cls", "key"), "histogram")
    stages.drop(staged)
    freqs = stages.put(tree.quantized(symbols, "cls", "key"), "freqs")
    return tree.class_costs(freqs).select("cls", "keys", "n", F.col("table_bytes").cast("long").alias("table_bytes"), F.round("ideal_bits", 2).alias("ideal_bits"))


@query("mantissa_kept", MANTISSA_SQL + ", hm as (select key, vb, sym, count(*) as cnt from ms group by 1, 2, 3)" + _model_sql("hm", "key, vb") + " select key::bigint as key, symbols, n, vb * n - ideal - 8 * (size + 3) > 0 as kept from mo")
def _(spark, d):
    order, _, rows = built(spark, d)
    return tree.kept_mantissas(tree.mantissa_symbols(rows, order))


TWO_SQL = "with a as (select distinct l_orderkey as item from lineitem where l_returnflag = 'A'), b as (select distinct l_orderkey as item from lineitem where l_returnflag = 'R')"


def _two(spark, d):
    """Orders with lines of either flag."""
    rows = table(spark, d, "lineitem")
    return tuple(rows.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("item")) for flag in "AR")


@query("paths_full_compare", TWO_SQL + " select count(*) filter (a.item is not null and b.item is not null) as common, count(*) filter (b.item is null) as only_a, count(*) filter (a.item is null) as only_b from a full join b on a.item = b.item")
def _(spark, d):
    return compare.full_compare(*_two(spark, d), "item")


@query("basket_paths_compare", PATH_SQL.replace("lineitem group", "lineitem where l_returnflag = 'A' group") + ", c as (select l_orderkey, list(distinct l_partkey order by l_partkey) as path from lineitem where l_returnflag = 'R' group by 1), q as (select distinct path from c) select count(*) filter (p.path is not null and q.path is not null) as common, count(*) filter (q.path is null) as only_a, count(*) filter (p.path is null) as only_b from p full join q on p.path = q.path")
def _(spark, d):
    rows = table(spark, d, "lineitem")
    a, b = (tree.baskets(rows.where(F.col("l_returnflag") == flag), "l_orderkey", "l_partkey") for flag in "AR")
    return compare.full_compare(a, b, "path")


@query("set_equality", TWO_SQL + ", x as ((select * from a except select * from b) union all (select * from b except select * from a)) select case when count(*) = 0 then 'SAME SET' else 'DIFFERENT' end as verdict from x")
def _(spark, d):
    return compare.set_verdict(*_two(spark, d), "item")


@query("positional_compare", TWO_SQL + ", x as (select item, row_number() over (order by item) - 1 as rank from a), y as (select item, row_number() over (order by item) - 1 as rank from b) select rank, x.item as left_value, y.item as right_value from x full join y using (rank) where x.item is distinct from y.item")
def _(spark, d):
    a, b = _two(spark, d)
    return compare.positional_compare(a.distinct(), b.distinct(), "item")


@query("first_mismatches", TWO_SQL + ", x as (select item, row_number() over (order by item) - 1 as rank from a), y as (select item, row_number() over (order by item) - 1 as rank from b) select rank, x.item as left_value, y.item as right_value from x full join y using (rank) where x.item is distinct from y.item order by rank limit 5")
def _(spark, d):
    a, b = _two(spark, d)
    return compare.positional_compare(a.distinct(), b.distinct(), "item").orderBy("rank").limit(5)  # a report of the first five


@query("multiset_equality", "with a as (select l_orderkey as item from lineitem where l_returnflag = 'A'), b as (select l_orderkey as item from lineitem where l_returnflag = 'R'), x as (select item, count(*) as n from a group by 1), y as (select item, count(*) as n from b group by 1), z as (select coalesce(x.n, 0) as p, coalesce(y.n, 0) as q from x full join y using (item)) select sum(least(p, q))::bigint as common, sum(greatest(p - q, 0))::bigint as only_a, sum(greatest(q - p, 0))::bigint as only_b, sum(abs(p - q)) = 0 as same from z")
def _(spark, d):
    return compare.multiset_compare(*_two(spark, d), "item")


@query("duplicate_check", "with b as (select l_orderkey, list(distinct l_partkey order by l_partkey) as path from lineitem group by 1) select array_to_string(path, ' ') as path, count(*) as copies from b group by 1 having count(*) > 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("path"))
    return compare.duplicates(rows, "path").select(_joined("path").alias("path"), "copies")


@query("rank_movement", "with recursive x as (select item, row_number() over (order by cnt desc, item desc) as rank from (select l_partkey as item, count(distinct l_orderkey) as cnt from lineitem where l_returnflag = 'A' group by 1)), y as (select item, row_number() over (order by cnt desc, item desc) as rank from (select l_partkey as item, count(distinct l_orderkey) as cnt from lineitem where l_returnflag = 'R' group by 1)) select count(*) as items, count(*) filter (x.rank = y.rank) as unmoved, max(abs(x.rank - y.rank)) as furthest, count(*) filter (x.rank is null) as appeared, count(*) filter (y.rank is null) as vanished from x full join y on x.item = y.item")
def _(spark, d):
    def order(flag):
        rows = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_orderkey", "l_partkey").distinct()
        counts = rows.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("cnt"))
        return lists.ranked(counts, "cnt", F.col("item").desc(), descending=True).select("item", F.col("rank").alias(f"rank_{flag}"))

    both = order("A").join(order("R"), "item", "full_outer")
    x, y = F.col("rank_A"), F.col("rank_R")
    return both.agg(F.count("*").alias("items"), F.count(F.when(x == y, 1)).alias("unmoved"), F.max(F.abs(x - y)).alias("furthest"), F.count(F.when(x.isNull(), 1)).alias("appeared"), F.count(F.when(y.isNull(), 1)).alias("vanished"))


__all__ = ["built", "paths"]
