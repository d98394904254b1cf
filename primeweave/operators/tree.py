"""Frequency-ordered prefix trees over item sets: counts, ranks, paths, nodes, contexts and their models, all as relations.

Items rank by how many sets hold them, ties to the greater item; a set is the ascending array of its ranks; a node is a prefix
of such an array. Node relations come from exploding prefixes and grouping, so no tree is ever in one place. What a node's contexts
need of its path (product, parent's rank) is carried along from the path, not joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from primeweave.functions import arith
from primeweave.operators.lists import ranked, with_previous

#: Set-1 contexts: counts saturate here; sets 2 and 3 use a first symbol that saturates earlier, and a tail.
COUNT_MOST, FIRST_MOST = 4095, 63


def baskets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(path): the distinct item sets of the groups, ascending."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("path")).select("path").distinct()


def named_baskets(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(path, id): the same, each with the smallest of its groups."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("path")).groupBy("path").agg(F.min(group).alias("id"))


def item_counts(paths: DataFrame) -> DataFrame:
    return paths.select(F.explode("path").alias("item")).groupBy("item").agg(F.count("*").alias("cnt"))


def item_order(counts: DataFrame) -> DataFrame:
    """(item, cnt, rank, class_id, class_size, value_index): ranks from 1; classes are runs of equal counts; value_index by item.

    Items are whole numbers below 10**19. Ranges are cut on count and item together, so that the many items of a low count are
    spread. The counts are read by several jobs: persist them.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")
    key = (wide("cnt") * F.lit("10000000000000000000").cast("decimal(20,0)") + wide("item")).cast("decimal(38,0)")
    order = ranked(counts.withColumn("_key", key), "_key", name="rank", descending=True).withColumn("rank", F.col("rank") + 1).drop("_key")
    classes = order.groupBy("cnt").agg(F.count("*").alias("class_size"))
    classes = ranked(classes, "cnt", name="class_id", descending=True).withColumn("class_id", F.col("class_id") + 1)
    order = order.join(classes, "cnt")
    return ranked(order, "item", name="value_index").withColumn("value_index", F.col("value_index") + 1).select("item", "cnt", "rank", "class_id", "class_size", "value_index")


def ranked_paths(paths: DataFrame, order: DataFrame, by: str = "path") -> DataFrame:
    """(path, ranks, items, indexes): each set with its ranks, ascending, and the items and value indexes in their order.

    by: a narrower column that tells the sets apart, which is then given instead of the path.
    """
    own = paths.select(by, F.explode("path").alias("item")).join(order.select("item", "rank", "value_index"), "item")
    own = own.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "item", "value_index"))).alias("own"))
    return own.select(by, F.col("own.rank").alias("ranks"), F.col("own.item").alias("items"), F.col("own.value_index").alias("indexes"))


def _product_bits(items: str, most_bits: int = 81) -> Column:
    """Bit lengths, at most 81, of the products of an array's beginnings; first of the empty one, 1."""
    top = F.lit(str(1 << most_bits)).cast(arith.WIDE)
    more = lambda acc, x: F.concat(acc, F.array(F.least((F.element_at(acc, -1) * x.cast("decimal(18,0)")).cast(arith.WIDE), top)))
    running = F.aggregate(items, F.array(F.lit(1).cast(arith.WIDE)), more)
    return F.transform(running, lambda v: F.least(arith.bits_wide(v), F.lit(most_bits)).cast("int"))


def nodes(ranks: DataFrame, prefixes: bool = True) -> DataFrame:
    """(node, up, depth, rank, parent_rank, index, pbits, above, terminal, paths[, prefix]): the root is the empty prefix, of rank 0.

    node and up are 64-bit hashes of a prefix and of its parent; with depth and rank beside them they name a node, and all joins
    go by them. pbits and above: bit lengths of the products of the prefix's items and of its parent's.
    """
    rows = ranks.select("ranks", "indexes", _product_bits("items").alias("bits")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("ranks"))))
    d = F.col("depth")
    at = lambda c, k: F.get(c, d - k)
    own = [F.slice("ranks", 1, d).alias("prefix")] if prefixes else []
    rows = rows.select(
        F.xxhash64(F.slice("ranks", 1, d)).alias("node"),
        F.when(d > 0, F.xxhash64(F.slice("ranks", 1, F.greatest(d - 1, F.lit(0))))).alias("up"),
        "depth",
        F.coalesce(at("ranks", 1), F.lit(0)).cast("long").alias("rank"),
        F.coalesce(at("ranks", 2), F.lit(0)).cast("long").alias("parent_rank"),
        at("indexes", 1).alias("index"),
        at("bits", 0).alias("pbits"),
        at("bits", 1).alias("above"),
        *own,
        (d == F.size("ranks")).alias("end"),
    )
    return rows.groupBy(*(c for c in rows.columns if c != "end")).agg(F.max("end").alias("terminal"), F.count("*").alias("paths"))


def children(node_rows: DataFrame) -> DataFrame:
    """Adds to every node but the root: sibling (from 0), siblings, before (previous sibling's rank, or the parent's), gap; to all: c."""
    parent = Window.partitionBy("up", "depth")
    by = parent.orderBy("rank")
    inner = F.col("depth") > 0
    rows = node_rows.withColumn("sibling", F.when(inner, F.row_number().over(by) - 1)).withColumn("siblings", F.when(inner, F.count("*").over(parent)))
    rows = rows.withColumn("before", F.when(inner, F.coalesce(F.lag("rank").over(by), F.col("parent_rank")))).withColumn("gap", F.col("rank") - F.col("before"))
    counts = node_rows.where("depth > 0").groupBy(F.col("up").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("c"))
    return rows.join(counts, ["node", "depth"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def bucket(c: Column) -> Column:
    return F.when(c <= 1, 0).when(c <= 3, 1).when(c <= 15, 2).otherwise(3)


def _symbols(rows: DataFrame, *symbols: Column) -> DataFrame:
    """A row for each symbol (a struct, or null) of each row."""
    return rows.select(F.explode(F.array_compact(F.array(*symbols))).alias("s")).select("s.*")


def set1_symbols(child_rows: DataFrame, order: DataFrame, deepest: int) -> DataFrame:
    """(ctx, sym): count, flag and gap symbols of the tree under context set 1."""
    m = order.count()
    depth, flags = F.col("depth"), 82 + (deepest + 1) * 42
    symbol = lambda ctx, sym: F.struct(ctx.cast("long").alias("ctx"), sym.cast("long").alias("sym"))
    count = symbol(82 + depth * 42 + arith.cap(F.coalesce("index", F.lit(m + 1)), 41), F.least("c", F.lit(COUNT_MOST)))
    flag = F.when((F.col("c") > 0) & (depth > 0), symbol(flags + depth - 1, F.col("terminal")))
    gap = F.when(depth > 0, symbol(flags + deepest + ((depth - 1) * 4 + bucket(F.col("siblings"))) * 42 + arith.cap(F.col("parent_rank"), 41), arith.bits(F.col("gap"))))
    return _symbols(child_rows, count, flag, gap)


def set2_symbols(child_rows: DataFrame, order: DataFrame) -> DataFrame:
    """(cls, key, sym): count (1), count tail (2), flag (3) and gap (4) symbols under context set 2."""
    m = order.count()
    ab = m.bit_length() + 1
    depth, c = F.col("depth"), F.col("c")
    symbol = lambda cls, key, sym: F.struct(F.lit(cls).alias("cls"), key.cast("long").alias("key"), sym.cast("long").alias("sym"))
    first = F.coalesce((F.col("sibling") == 0).cast("int"), F.lit(0))
    after = F.coalesce(F.col("siblings") - F.col("sibling") - 1, F.lit(0))
    k = (depth * ab + arith.bits(F.col("rank"))) * 82 + F.col("pbits")
    count = symbol(1, (k * 2 + first) * 14 + arith.cap(after, 13), F.least("c", F.lit(FIRST_MOST)))
    tail = F.when(c >= FIRST_MOST, symbol(2, depth, F.least("c", F.lit(COUNT_MOST))))
    flag = F.when((c > 0) & (depth > 0), symbol(3, (depth - 1) * 4 + bucket(c), F.col("terminal")))
    left, room, k, _ = _gap_parts(m)
    gap = F.when(depth > 0, symbol(4, ((k * ab + room) * 14 + arith.cap(left, 13)) * 41 + arith.quotient(F.col("above"), F.lit(2)), arith.bits(F.col("gap"))))
    return _symbols(child_rows, count, tail, flag, gap)


def _gap_parts(m: int) -> tuple[Column, Column, Column, Column]:
    """What gap keys are made of: left (R), room (bits of (m - a) div R), k, and whether the child is the first."""
    ab = m.bit_length() + 1
    left = F.col("siblings") - F.col("sibling")
    first = (F.col("sibling") == 0).cast("int")
    room = arith.bits(arith.quotient(m - F.col("before"), left))
    k = (((F.col("depth") - 1) * 4 + bucket(F.col("siblings"))) * 2 + first) * ab + arith.bits(F.col("before"))
    return left, room, k, first


def mantissa_symbols(child_rows: DataFrame, order: DataFrame) -> DataFrame:
    """(key, sym, vb): context set 3's mantissa of tree gaps of two bits or more."""
    m = order.count()
    ab = m.bit_length() + 1
    _, room, _, first = _gap_parts(m)
    rows, length = child_rows.where("depth > 0"), arith.bits(F.col("gap"))
    vb = F.when(length <= 12, length - 1).otherwise(4)
    b = F.when(F.col("before") < 1024, F.col("before") + 1024 * first).otherwise(2048 + (((F.col("depth") - 1) * 2 + first) * ab + arith.bits(F.col("before"))) * ab + room)
    power = lambda e: F.pow(F.lit(2.0), e).cast("long")
    value = F.floor((F.col("gap") - power(length - 1)) / power(length - 1 - vb))
    return rows.where(length >= 2).select((b * 64 + length).cast("long").alias("key"), value.cast("long").alias("sym"), vb.cast("int").alias("vb"))


def raw_bits(child_rows: DataFrame) -> DataFrame:
    """One row: bits of tree gaps below their leading ones."""
    return child_rows.where("depth > 0").agg(F.sum(arith.bits(F.col("gap")) - 1).alias("raw_bits"))


def table_gaps(order: DataFrame) -> DataFrame:
    """(class_id, item, position, gap): the rank table's gaps within classes, ascending; positions are value indexes from 0."""
    by = Window.partitionBy("class_id").orderBy("value_index")
    position = F.col("value_index") - 1
    return order.select("class_id", "item", position.alias("position"), (position - F.coalesce(F.lag(position).over(by), F.lit(-1))).alias("gap"))


def histogram(symbols: DataFrame, *key: str) -> DataFrame:
    return symbols.groupBy(*key, "sym").agg(F.count("*").alias("cnt"))


def quantized(hist: DataFrame, *key: str, total: int = 1 << 16) -> DataFrame:
    """Adds freq: counts scaled to sum to `total` for each key, at least 1, by largest remainder.

    A deficit goes to the largest remainders, ties to the higher symbol index; an excess (only possible when very many symbols
    were raised to 1) is taken from the largest frequencies in turn, for which the few keys that need it go to an Arrow function.
    """
    by = Window.partitionBy(*key)
    exact = F.col("cnt") / F.sum("cnt").over(by) * float(total)
    rows = hist.withColumn("exact", exact).withColumn("base", F.greatest(F.lit(1), F.floor("exact")).cast("long"))
    rows = rows.withColumn("short", F.lit(total) - F.sum("base").over(by))
    order = Window.partitionBy(*key).orderBy((F.col("exact") - F.col("base")).desc(), F.col("sym").desc())
    rows = rows.withColumn("turn", F.row_number().over(order))
    n = F.count("*").over(by)
    whole = F.floor(F.col("short") / n) + F.when(F.col("turn") <= F.col("short") % n, 1).otherwise(0)
    even = rows.withColumn("freq", F.when(F.col("short") >= 0, F.col("base") + whole).cast("long"))
    fine = even.where("short >= 0").select(*key, "sym", "cnt", "freq")
    kinds = dict(hist.dtypes)
    over = even.where("short < 0").select(*key, "sym", "cnt", "base", "short").groupBy(*key).applyInPandas(_taken, ", ".join(f"{c} {kinds[c]}" for c in (*key, "sym", "cnt")) + ", freq long")
    return fine.unionByName(over)


def _taken(frame):
    frame = frame.sort_values("sym").reset_index(drop=True)
    freq = frame["base"].to_numpy().copy()
    for _ in range(-int(frame["short"].iloc[0])):
        freq[freq.argmax()] -= 1
    frame["freq"] = freq
    return frame.drop(columns=["base", "short"])


def model_sizes(freqs: DataFrame, *key: str) -> DataFrame:
    """(key..., symbols, n, size, ideal_bits) of quantised models: bytes of a stored model, and bits of its symbols under it."""
    step = F.col("sym") - F.coalesce(F.lag("sym").over(Window.partitionBy(*key).orderBy("sym")), F.lit(0))
    rows = freqs.withColumn("bytes", arith.vbyte_length(step) + arith.vbyte_length(F.col("freq") - 1))
    sums = rows.groupBy(*key).agg(F.count("*").alias("symbols"), F.sum("cnt").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.col("cnt") * (16 - F.log2("freq"))).alias("ideal_bits"))
    return sums.select(*key, "symbols", "n", (F.col("bytes") + arith.vbyte_length(F.col("symbols"))).alias("size"), "ideal_bits")


def class_costs(freqs: DataFrame) -> DataFrame:
    """(cls, keys, n, table_bytes, ideal_bits): what the models of each class of contexts cost, for freqs(cls, key, sym, cnt, freq)."""
    at = (F.col("cls").cast("long") * (1 << 58) + F.col("key")).alias("at")  # keys stay far below 2**58
    models = model_sizes(freqs, "cls", "key").select("cls", "key", "n", "size", "ideal_bits", at)
    rows = with_previous(models, "at")
    gap = F.col("key") - F.coalesce(F.when(arith.quotient(F.col("previous"), F.lit(1 << 58)) == F.col("cls"), F.col("previous") % (1 << 58)), F.lit(0))
    sums = rows.groupBy("cls").agg(F.count("*").alias("keys"), F.sum("n").alias("n"), F.sum(F.col("size") + arith.vbyte_length(gap)).alias("bytes"), F.sum("ideal_bits").alias("ideal_bits"))
    return sums.select("cls", "keys", "n", (F.col("bytes") + arith.vbyte_length(F.col("keys"))).alias("table_bytes"), "ideal_bits")


def kept_mantissas(symbols: DataFrame) -> DataFrame:
    """(key, symbols, n, kept): whether a mantissa context's model saves more than it costs, for symbols(key, sym, vb)."""
    freqs = quantized(histogram(symbols.select("key", "sym", "vb"), "key", "vb"), "key", "vb")
    gain = F.col("vb") * F.col("n") - F.col("ideal_bits") - 8 * (F.col("size") + 3)
    return model_sizes(freqs, "key", "vb").select("key", "symbols", "n", (gain > 0).alias("kept"))
