"""Jaccard join of word-shingle sets by token-combination prefixes, and the components of its links.

Sets link when 100 * |intersection| >= 75 * |union|. Equal sets are one node from the start. A set of n shingles may miss at
most e = n - ceil(0.75 n) of them in a partner. Shingles are counted over all documents, by distinct sets: those of one set are
misses already; those of fewer than FREQUENT sets are rare and indexed alone; the others are frequent and indexed by pairs. All
sets order their shingles alike, rare before frequent. With e' misses left after the unshared ones,

- e' + 1 rare shingles hold one that the partner has too: each is a signature;
- with only a <= e' rare ones, the prefix is extended by e' - a + 1 + M frequent ones, of which the partner has M + 1, so that
  two of them fall in one of M classes (by hash): each pair within a class is a signature. M follows the size's level (powers
  of 4/3), and a set signs for its level and the next, so any two that may link share a level.

Of two linked sets, the one whose prefix ends first has these shared shingles within the other's prefix: no link is lost. The
sets that share a signature are verified exactly. To find components it isn't needed to emit all pairs of a group: rounds of
stars (each signature's sets against one pivot, another in each round) connect most of it; then, of components that share a
signature, all sets are held against each other in blocks that only give links.

Hashes have 64 bits for sets and set sizes and 48 for shingles in the join.

Null text, or none but blanks: n_shingles 0, linked with nothing. Fewer than five words: one shingle of them all. Rows may
repeat; they get the same component. Rows of null id get a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primeweave.llm.shared import Stages, at_work, components
from primeweave.llm.shingles import mix, shingle_sets

NUM, DEN = 75, 100
FREQUENT = 16
STARS = 3
#: Postings of a bucket, which one task holds, about.
BUCKET = 1_000_000
#: Sets of either side of a block; components of a signature beyond which it makes a family.
BLOCK, DENSE = 512, 24
_FREQ_BIT = np.int64(1 << 62)
_HOT = 0xFFFF


def _set_id(s: np.ndarray) -> int:
    if not len(s):
        return 0
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s)) ^ np.uint64(len(s)), s.sum(dtype=np.uint64)]).cumsum(dtype=np.uint64))[1] >> np.uint64(1))


def _summaries(batches):
    at_work("ngram_join")
    for batch in batches:
        n, sid = [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            sid.append(_set_id(s))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64())], ["id", "n", "sid"])


def _packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _postings(buckets: int):
    """Shingles of a part's distinct sets, dealt to buckets by hash: 6 bytes of token and 2 of set a posting.

    A token that FREQUENT sets of the part have is frequent whatever the rest: its postings stay out of the bucket, which is
    told so by one posting, and go on with their sets.
    """
    kinds = [("bucket", pa.int32()), ("tokens", pa.binary()), ("at", pa.binary()), ("sids", pa.binary()), ("sizes", pa.binary())]

    def flush(sets: dict[int, np.ndarray]):
        sids = np.array(list(sets), np.int64)
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        tokens = np.concatenate(list(sets.values())) >> np.uint64(16)
        of = np.repeat(np.arange(len(sids)), sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, of = tokens[by], of[by]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(head, len(tokens)))
        hot = np.repeat(count >= FREQUENT, count)
        rows = []
        if hot.any():
            t, o = tokens[hot], of[hot]
            by = np.argsort(o, kind="stable")
            t, o = t[by], o[by]
            for k in np.unique(o):
                a, b = np.searchsorted(o, [k, k + 1])
                rows.append((int(sids[k] % buckets), _packed(t[a:b]), None, sids[k : k + 1].tobytes(), sizes[k : k + 1].tobytes()))
            told = tokens[head[count >= FREQUENT]]
            tokens, of = np.concatenate([tokens[~hot], told]), np.concatenate([of[~hot], np.full(len(told), _HOT)])
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        tokens, of, bucket = tokens[by], of[by], bucket[by]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own, local = np.unique(of[a:b], return_inverse=True)
            if own[-1] == _HOT:
                local = np.where(of[a:b] == _HOT, _HOT, local)
                own = own[:-1]
            rows.append((int(bucket[a]), _packed(tokens[a:b]), local.astype("<u2").tobytes(), sids[own].tobytes(), sizes[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches):
        at_work("ngram_join")
        sets, held = {}, 0
        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                if len(s) > 2:  # smaller sets link with equal ones only
                    sid = _set_id(s)
                    if sid not in sets:
                        sets[sid] = s
                        held += len(s)
                        if held > 1_000_000 or len(sets) >= 60_000:
                            yield flush(sets)
                            sets, held = {}, 0
        if sets:
            yield flush(sets)

    return run


def _shared_tokens(table: pa.Table) -> pa.Table:
    """A bucket's tokens of two sets or more, by set; frequent ones have a bit set."""
    tokens, sids, sizes, passed = [], [], [], []
    for t, at, s, z in zip(*(table.column(c).to_pylist() for c in ("tokens", "at", "sids", "sizes")), strict=True):
        own, size = np.frombuffer(s, np.int64), np.frombuffer(z, np.int64)
        t = _unpacked(t).astype(np.int64)
        if at is None:
            passed.append((int(own[0]), int(size[0]), (t | _FREQ_BIT).tobytes()))
            continue
        at = np.frombuffer(at, "<u2").astype(np.int64)
        told = at == _HOT
        tokens.append(t)
        sids.append(np.where(told, -1, own[np.where(told, 0, at)] if len(own) else -1))
        sizes.append(np.where(told, 0, size[np.where(told, 0, at)] if len(own) else 0))
    out = passed
    if tokens:
        t, s, z = np.concatenate(tokens), np.concatenate(sids), np.concatenate(sizes)
        by = np.lexsort((s, t))
        t, s, z = t[by], s[by], z[by]
        keep = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        t, s, z = t[keep], s[keep], z[keep]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(head, len(t))) + np.where(s[head] == -1, FREQUENT, 0)
        count = np.repeat(count, np.diff(np.append(head, len(t))))
        keep = (count > 1) & (s != -1)
        t, s, z, count = t[keep], s[keep], z[keep], count[keep]
        t = np.where(count >= FREQUENT, t | _FREQ_BIT, t)
        by = np.argsort(s, kind="stable")
        t, s, z = t[by], s[by], z[by]
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else [0]
        out += [(int(s[a]), int(z[a]), t[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"sid": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "tokens": pa.array(cols[2], pa.binary())})


def _misses(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN


def _candidates(batches):
    """Sets that have few enough unshared shingles, with their shared tokens in order."""
    for batch in batches:
        out = []
        for sid, n, lists in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "lists")), strict=True):
            t = np.unique(np.frombuffer(b"".join(lists), np.int64))
            if n - len(t) <= _misses(n):
                out.append((sid, n, t.tobytes()))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["sid", "n", "tokens"])


def _level(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(4 / 3) + 1e-9))


def _classes(level: int) -> int:
    return max(1, int((4 / 3) ** level / 4))


def signatures(n: int, tokens: np.ndarray) -> np.ndarray:
    """The signatures of a set of n shingles with these shared tokens, in order (frequent ones with their bit set)."""
    left = _misses(n) - (n - len(tokens))
    rare = tokens[tokens < _FREQ_BIT]
    if len(rare) > left:
        return mix(rare[: left + 1].astype(np.uint64))
    out = [mix(rare.astype(np.uint64))]
    frequent = (tokens[len(rare) :] ^ _FREQ_BIT).astype(np.uint64)
    for level in (_level(n), _level(n) + 1):
        m = _classes(level)
        t = frequent[: left - len(rare) + 1 + m]
        of = mix(t) % np.uint64(m)
        by = np.argsort(of, kind="stable")
        t, of = t[by], of[by]
        for step in range(1, len(t)):
            same = np.flatnonzero(of[step:] == of[:-step])
            if not len(same):
                break
            a, b = t[same], t[same + step]
            out.append(mix(mix(np.minimum(a, b) + np.uint64(level << 50)) + np.maximum(a, b)))
    return np.unique(np.concatenate(out))


def _signed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sigs = [signatures(n, np.frombuffer(t, np.int64)) for n, t in zip(part.column("n").to_pylist(), part.column("tokens").to_pylist(), strict=True)]
            size = np.array([len(s) for s in sigs], np.int64)
            if size.sum():
                of = pa.array(np.repeat(np.arange(len(sigs)), size))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), part.column("sid").take(of), part.column("n").take(of)], ["sig", "sid", "n"])


def _verified(batches):
    for batch in batches:
        linked = []
        for na, nb, a, b in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ta", "tb")), strict=True):
            both = len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True))
            linked.append(DEN * both >= NUM * (na + nb - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked)"""
    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_verified, "a long, b long, linked boolean")


def _pivots(signed: DataFrame, star: int) -> DataFrame:
    """(sig, p, pn): a set of each signature; another one, mostly, for another star."""
    lot = F.struct(F.xxhash64("sid", F.lit(star)).alias("h"), "sid", "n")
    return signed.groupBy("sig").agg(F.min(lot).alias("p")).select("sig", F.col("p.sid").alias("p"), F.col("p.n").alias("pn"))


def _fits(a: str, b: str):
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def set_components(stages: Stages, docs: DataFrame, each: DataFrame) -> DataFrame:
    """(sid, component), staged, of the sets that link with another one; docs(text), each(sid, n)."""
    spark = stages.spark
    postings = each.where("n > 2").groupBy("sid").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // BUCKET))
    posted = docs.mapInArrow(_postings(buckets), "bucket int, tokens binary, at binary, sids binary, sizes binary")
    shared = posted.groupBy("bucket").applyInArrow(_shared_tokens, "sid long, n long, tokens binary")
    sets = shared.groupBy("sid").agg(F.max("n").alias("n"), F.collect_list("tokens").alias("lists"))
    sets = stages.put(sets.mapInArrow(_candidates, "sid long, n long, tokens binary"), "sets")
    signed = sets.mapInArrow(_signed, "sig long, sid long, n long")
    many = signed.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    signed, tried = stages.put(signed.join(many, "sig"), "signed"), None
    for star in range(STARS):
        pairs = signed.join(_pivots(signed, star), "sig").where((F.col("sid") != F.col("p")) & _fits("n", "pn"))
        pairs = pairs.select(F.least("sid", "p").alias("a"), F.greatest("sid", "p").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        verified = stages.put(_verify(pairs, sets), "verified")
        tried = verified if tried is None else tried.union(verified)
        links = tried.where("linked").select("a", "b")
        comp = stages.put(components(stages, links), "components")
        before, signed = signed, stages.put(_mixed(signed, comp), "signed")
        stages.drop(before)
        if signed.isEmpty():
            return comp
    rest = _across(stages, _labelled(signed, comp, "sid", "c"), sets)
    return stages.put(components(stages, links.union(rest)), "components")


def _across(stages: Stages, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between components that share a signature; rows(sig, sid, n, c).

    Signatures of few components give their pairs of components, of which the smaller one's sets are held against all of the
    other's. Signatures of more than DENSE are families: the components they join, one with another, are held against each
    other whole. Both go in blocks against blocks; a block pair is one small product of token lists, and only the links that
    join something come out of it.
    """
    rows = stages.put(rows, "rows")
    members = rows.groupBy("sid").agg(F.first("c").alias("c")).join(sets, "sid").select("c", "sid", "n", "tokens")
    members = stages.put(members, "members")
    size = members.groupBy("c").agg(F.count("*").alias("size"))
    # signatures with the same components say the same: one of each is enough
    present = rows.groupBy("sig", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    same = present.groupBy("sig").agg(F.count("*").alias("k"), F.sum(F.xxhash64("c").bitwiseAND((1 << 40) - 1)).alias("s"), F.bit_xor(F.xxhash64("lo", "hi", "c")).alias("x"))
    one = same.groupBy("k", "s", "x").agg(F.min("sig").alias("sig")).select("sig", "k")
    present = stages.put(present.join(one, "sig"), "present")
    few, dense = present.where(F.col("k") <= DENSE), present.where(F.col("k") > DENSE)
    x, y = (few.select("sig", *(F.col(k).alias(f"{k}{side}") for k in ("c", "lo", "hi"))) for side in "ab")
    able = (F.col("hia") * DEN >= F.col("lob") * NUM) & (F.col("hib") * DEN >= F.col("loa") * NUM)
    meet = stages.put(x.join(y, "sig").where((F.col("ca") < F.col("cb")) & able).select("ca", "cb").distinct(), "meet")
    meet = meet.join(size.select(F.col("c").alias("ca"), F.col("size").alias("sa")), "ca").join(size.select(F.col("c").alias("cb"), F.col("size").alias("sb")), "cb")
    first = F.col("sa") >= F.col("sb")
    meet = stages.put(meet.select(F.when(first, F.col("ca")).otherwise(F.col("cb")).alias("big"), F.when(first, F.col("cb")).otherwise(F.col("ca")).alias("c")), "meet")
    outer = meet.join(members, "c").select("big", "c", "sid", "n", "tokens").withColumn("side", F.lit(0))
    inner = meet.select(F.col("big").alias("c")).distinct().join(members, "c").select(F.col("c").alias("big"), "c", "sid", "n", "tokens").withColumn("side", F.lit(1))
    blocks = outer.select("big", "side").union(inner.select("big", "side")).groupBy("big").agg(*(F.ceil(F.count(F.when(F.col("side") == k, 1)) / BLOCK).cast("int").alias(f"b{k}") for k in (0, 1)))
    dealt = outer.unionByName(inner).join(blocks, "big")
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1)))
    dealt = dealt.withColumn("i", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    pairs = dealt.select("big", "i", "j", "side", "c", "sid", "n", "tokens")
    family = components(stages, dense.join(dense.groupBy("sig").agg(F.min("c").alias("least")), "sig").select(F.col("c").alias("a"), F.col("least").alias("b")))
    whole = family.select(F.col("id").alias("c"), F.col("component").alias("big")).join(members, "c")
    blocks = whole.groupBy("big").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("b"))
    whole = whole.join(blocks, "big").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("b")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    whole = whole.select("big", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "c", "sid", "n", "tokens")
    return stages.put(pairs.groupBy("big", "i", "j").applyInArrow(_block_links, "a long, b long").union(whole.groupBy("big", "i", "j").applyInArrow(_block_links, "a long, b long")), "links")


def _block_links(table: pa.Table) -> pa.Table:
    """Links that join components, between a block pair's sides 0 and 1, or among side 2."""
    side, comp, sid, n = (table.column(c).to_numpy() for c in ("side", "c", "sid", "n"))
    lists = [np.frombuffer(t, np.int64) for t in table.column("tokens").to_pylist()]
    inner, outer = np.flatnonzero(side > 0), np.flatnonzero(side != 1)
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    a, b = [], []
    if len(inner) and len(outer):
        size = np.array([len(lists[k]) for k in inner])
        tokens, ids = np.unique(np.concatenate([lists[k] for k in inner]), return_inverse=True)
        begin = np.cumsum(size) - size
        has = np.zeros(len(tokens), np.int32)
        for k in outer:
            if not ((DEN * n[inner] >= NUM * n[k]) & (DEN * n[k] >= NUM * n[inner])).any():
                continue
            at = np.searchsorted(tokens, lists[k])
            at = at[tokens[np.minimum(at, len(tokens) - 1)] == lists[k]]
            has[at] = 1
            both = np.add.reduceat(has[ids], begin)
            has[at] = 0
            for h in np.flatnonzero((DEN * both >= NUM * (n[k] + n[inner] - both)) & (comp[inner] != comp[k])):
                x, y = top(int(comp[k])), top(int(comp[inner[h]]))
                if x != y:
                    root[x] = y
                    a.append(int(sid[k]))
                    b.append(int(sid[inner[h]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _labelled(df: DataFrame, comp: DataFrame, col: str, name: str) -> DataFrame:
    own = comp.select(F.col("id").alias(col), F.col("component").alias(name))
    return df.join(own, col, "left").withColumn(name, F.coalesce(name, col))


def _mixed(signed: DataFrame, comp: DataFrame) -> DataFrame:
    """Signatures whose sets lie in several components yet."""
    own = _labelled(signed, comp, "sid", "_c")
    mixed = own.groupBy("sig").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi")).where("lo <> hi").select("sig")
    return own.join(mixed, "sig").select("sig", "sid", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row for each row; ids are anything that has an order."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    each = stages.put(rows.mapInArrow(_summaries, f"id {dict(rows.dtypes)['id']}, n long, sid long"), "each")
    comp = set_components(stages, rows.select("text"), each.select("sid", "n"))
    stages.only(each, comp)
    classes = each.where("n > 0").groupBy("sid").agg(F.min("id").alias("first"))
    own = classes.join(comp.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    of = own.join(least, "component").select("sid", "component_id")
    out = each.join(of, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
