"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct runs of five words (lower-cased by Unicode's rules, parted by blanks; fewer words: all of them as one). Lines
whose Jaccard similarity is SIMILAR or more match; of matching lines, those that come later (by document id, then row, then
place) are removed: a line goes if any line before it matches it.

Lines of the same words are joined first, by a hash, and only the first of each goes on. Of these, lines that share too few tokens
of a prefix by plain hashes with any other can't match and are left alone (_likely). Tokens of the others are ordered by rarity: a sketch of
SKETCH counters, counted over these lines, gives each its class (three to an octave of its counter), rare classes first, hashes
within. Two
matching lines of n and m tokens share one in the first n - ceil(SIMILAR * n) + 1 and m - ceil(SIMILAR * m) + 1; so prefixes are
joined on their tokens, pairs whose lengths or token places can't reach the overlap they need are dropped, and the others
verified on all tokens. A group of near copies is not paired with itself: of a token that many lines share, first STARS early
lines are held against the others; then, for lines that this has not removed, the lines before them.

Lines without a word match nothing and stay. Null text stays null; ids that are null come first. Rows may repeat: the second of
two equal rows comes later. An empty table gives no rows. Words and tokens are
compared by 64-bit hashes; where tokens are only joined, to be verified later, by 56 bits of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from primeweave.llm.shared import Stages, fits, numbered, replayable, small

SIMILAR = 0.75
SHINGLE = 5
SKETCH = 1 << 18
#: Of a token that more than HUB lines share, STARS early lines, of different hash classes, are held against the others first.
HUB, STARS = 32, 4
#: Tokens of its prefix that a line must share with others to be compared, if it has as many to share.
AGREE = 2
#: What parts words beside the space.
BLANKS = "\t\r\x0b\x0c"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows numbered by their place in the scan, so repeated rows differ."""
    return numbered(docs).select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """(row, id, line, key, said): lines of a word at least, lower-cased, their words parted by single spaces."""
    each = rows.select("row", "id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    each = each.where(F.ltrim("said", F.lit(" " + BLANKS)) != "")  # not by what is made of the line: the optimizer would make it for the filter once more
    other = [F.contains("said", F.lit(c)) for c in BLANKS]  # few lines hold any, and changing them is dear
    said = F.when(reduce(Column.__or__, other), F.translate("said", BLANKS, " " * len(BLANKS))).otherwise(F.col("said"))
    each = each.select("row", "id", "line", F.lower(said).alias("low"))
    low = F.col("low")
    ragged = low.contains("  ") | low.startswith(" ") | low.endswith(" ")
    each = each.select("row", "id", "line", F.when(ragged, F.array_join(F.array_remove(F.split(low, " "), ""), " ")).otherwise(low).alias("said"))
    return each.select("row", "id", "line", F.xxhash64("said").alias("key"), "said")


def _words() -> Column:
    """Of a line: its words by 64-bit hashes."""
    return F.transform(F.split("said", " "), lambda w: F.xxhash64(w))


def _tokens() -> Column:
    """Of a line's words; runs over the end hold nulls and are cut off."""
    runs = F.transform("words", lambda x, i: F.xxhash64(x, *(F.get("words", i + k) for k in range(1, SHINGLE))))
    return F.slice(runs, 1, F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1)))


def _token(i: Column) -> Column:
    """The i-th of _tokens(): where positions are rows, it's compiled."""
    return F.xxhash64(*(F.get("words", i + k) for k in range(SHINGLE)))


def _least(n: Column) -> Column:
    """Tokens that a line of n shares with any match, at least."""
    return F.ceil(n * SIMILAR - 1e-9).cast("int")


def _classes(lines: DataFrame, tokens: Column | None = None) -> bytearray:
    """Of the lines' tokens, or of the given arrays of them."""
    if tokens is None:
        each = lines.select("words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))).alias("i")).select(_token(F.col("i")).alias("t"))
    else:
        each = lines.select(F.explode(tokens).alias("t"))
    k = each.select(F.pmod("t", F.lit(SKETCH)).cast("int").alias("k"))
    four = [F.count(F.when(F.col("k").bitwiseAND(3) == j, 1)).alias(f"c{j}") for j in range(4)]  # a row for four counters: Spark's fast map holds 2**16 keys
    counted = k.groupBy(F.shiftright("k", 2).alias("q")).agg(*four).select("q", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("j", "c"))
    counted = counted.where("c > 0").select((F.col("q") * 4 + F.col("j")).alias("k"), "c")
    octave = F.least(F.floor(F.log2("c") * 3 + 1e-9), F.lit(127)).cast("int")
    blocks = counted.groupBy(F.shiftright("k", 8)).agg(F.collect_list(F.col("k") * 128 + octave).alias("held"))  # 256 counters a row: a row each takes the driver 100 MB
    out = bytearray(SKETCH)
    for r in blocks.select("held").collect():  # SKETCH / 256 rows at most
        for v in r["held"]:
            out[v >> 7] = v & 127
    return out


def _ordered(classes: bytearray) -> Column:
    """Of a line's tokens, rare classes first: the class above 56 bits of hash."""
    sketch = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<tinyint>")  # folded to a constant
    keyed = lambda t: F.shiftleft(F.get(sketch, t.bitwiseAND(SKETCH - 1)).cast("long"), 56).bitwiseOR(t.bitwiseAND((1 << 56) - 1))
    return F.sort_array(F.array_distinct(F.transform("tokens", keyed)))


def _prefix(n: Column) -> Column:
    return n - _least(n) + 1


def _pairs(x: DataFrame, y: DataFrame, whole: bool) -> DataFrame:
    """(key, before): lines of x and earlier ones of y that share a prefix token and pass the length and positional filters.

    Where y holds whole prefixes, the shared tokens are counted too: all that the line whose prefix ends first shares beyond
    them lies behind its prefix.
    """
    y = y.select("token", *(F.col(c).alias(f"{c}2") for c in ("key", "at", "n", "place")))
    n, m = F.col("n"), F.col("n2")
    overlap = F.ceil((n + m) * (SIMILAR / (1 + SIMILAR)) - 1e-9)
    reach = F.least("place", "place2") + F.least(n - F.col("place"), m - F.col("place2"))
    pairs = x.join(y, "token").where((F.col("at2") < F.col("at")) & (n >= SIMILAR * m) & (m >= SIMILAR * n) & (reach >= overlap))
    pairs = pairs.groupBy("key", F.col("key2").alias("before"), "n", "n2").agg(F.count("*").alias("shared"))
    if whole:
        pairs = pairs.where(F.col("shared") + F.greatest(n - _prefix(n), m - _prefix(m)) >= overlap)
    return pairs.select("key", "before")


def _matched(stages: Stages, pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key) of the pairs that match, staged."""
    a, b = lines.select("key", F.col("tokens").alias("ta")), lines.select(F.col("key").alias("before"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return stages.put(pairs.join(a, "key").join(b, "before").select("key", F.size("ta").alias("n"), F.size("tb").alias("m"), both.alias("both")).where(F.col("both") >= SIMILAR * (F.col("n") + F.col("m") - F.col("both"))).select("key").distinct(), "matched")


def _likely(stages: Stages, once: DataFrame) -> DataFrame:
    """(key, at, tokens), staged: the lines of which AGREE tokens are others' too, among those that must hold such if any line matches.

    In any order of tokens, the AGREE least that two matching lines have in common lie in the first n - ceil(SIMILAR * n) + AGREE of
    each (a line of one token has that one). Here the order is by the first word's hash, then any: so many distinct first words
    hold as many tokens at least, and no token need be sorted. n is bounded by the line's places.
    """
    words = once.select("key", _words().alias("words"))
    starts = F.slice("words", 1, F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1)))
    words = words.select("key", "words", F.size(starts).alias("n"), F.sort_array(F.array_distinct(starts)).alias("firsts"))
    need, held = F.least(F.lit(AGREE), F.size("firsts")), F.size("firsts")
    last = F.get("firsts", F.least(F.col("n") - _least(F.col("n")) + need, held) - 1)
    each = words.select("key", need.cast("byte").alias("need"), last.alias("last"), "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    tokens = each.where(F.get("words", F.col("i")) <= F.col("last")).select("key", "need", _token(F.col("i")).alias("token"))
    tokens = tokens.withColumn("others", F.count("*").over(Window.partitionBy("token"))).where("others > 1")
    near = small(tokens.groupBy("key", "need").agg(F.count("*").alias("c")).where("c >= need").select("key"), stages, "near")
    likely = once.join(near, "key").select("key", F.struct("id", "row", "line").alias("at"), _words().alias("words"))
    return stages.put(likely.select("key", "at", F.array_distinct(_tokens()).alias("tokens")), "likely")


def removed_lines(stages: Stages, rows: DataFrame) -> DataFrame:
    """(row, gone), staged: the places of the lines to remove, for each row that has any."""
    lines = stages.put(_lines(rows), "lines", {"compression": "zstd"})  # the largest stage: a third smaller than by snappy
    at = F.struct("id", "row", "line")
    several = small(lines.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), stages, "several")
    copies = stages.put(lines.join(several, "key").select("key", at.alias("own")), "copies")
    first = copies.groupBy("key").agg(F.min("own").alias("first"))
    again = stages.put(copies.join(first, "key").where("own <> first").select("own.row", "own.line"), "again")
    once = lines.join(F.broadcast(again) if fits(again) else again, ["row", "line"], "left_anti")
    likely = _likely(stages, once)
    stages.only(again, likely)
    tokens = likely.select("key", "at", _ordered(_classes(likely, F.col("tokens"))).alias("t"))
    n = F.size("t")
    tokens = tokens.select("key", "at", n.alias("n"), F.posexplode(F.slice("t", 1, _prefix(n))).alias("place", "token"))
    tokens = tokens.withColumn("others", F.count("*").over(Window.partitionBy("token"))).where("others > 1")
    tokens = stages.put(tokens.select("token", "key", "at", "n", "place", (F.col("others") > HUB).alias("hub")), "tokens")
    hubs = tokens.where("hub")
    earliest = hubs.groupBy("token", F.pmod(F.xxhash64("key"), F.lit(STARS)).alias("star")).agg(F.min(F.struct("at", "key", "n", "place")).alias("e")).select("token", "e.*")
    star = stages.put(_pairs(hubs, earliest, whole=False), "pairs")
    gone = _matched(stages, star, likely)
    rest = stages.put(_pairs(tokens.join(gone, "key", "left_anti"), tokens, whole=True).join(star, ["key", "before"], "left_anti").select("key", "before"), "pairs")
    stages.drop(tokens, star)
    more = _matched(stages, rest, likely)
    later = again.union(likely.select("key", "at").join(gone.union(more), "key").select("at.row", "at.line"))
    out = stages.put(later.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("gone")), "removed")
    stages.only(out)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, their text without the removed lines, and n_lines, n_removed (null text: 0, 0; columns of these names go)."""
    stages = Stages(docs.sparkSession)
    docs = replayable(stages, docs)
    gone = removed_lines(Stages(docs.sparkSession), _rows(docs, id_col, text_col))
    own = numbered(docs).join(F.broadcast(gone) if fits(gone) else gone, "row", "left")
    text = F.col(f"doc.`{text_col}`")
    lines = F.split(text, "\n")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1  # cheaper than splitting once more
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    done = F.struct(F.when(F.col("gone").isNull(), text).otherwise(left).alias("text"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    own = own.select("doc", done.alias("done"))  # before any name of the input is a column again
    kept = [F.col("done.text" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return own.select(*kept, "done.n_lines", "done.n_removed")
