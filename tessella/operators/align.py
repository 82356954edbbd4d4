"""Alignment: maximal runs of equal tokens shared by queries and fragments.

Runs of k tokens meet by an equi-join on 128 bits of hash; hits on one diagonal that follow each
other form an island, which is a maximal run of k - 1 more tokens than hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Grams of at most so many rows, 32 bytes each, are broadcast.
BROADCAST_GRAMS = 1_000_000


def ngram_starts(n: Column, k: int, stride: int = 1) -> Column:
    """Start positions, from 0, of the full n-grams; empty if there is none."""
    return F.when((n >= k) & F.lit(k > 0), F.sequence(F.lit(0), n - k, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column, k: int, stride: int = 1) -> Column:
    """Array of (pos, gram) of a token array."""
    return F.transform(ngram_starts(F.size(tokens), k, stride), lambda i: F.struct(i.alias("pos"), F.slice(tokens, i + 1, F.lit(k)).alias("gram")))


def shingles(df: DataFrame, id_col: str, k: int, tokens: str = "tokens") -> DataFrame:
    """The index of a table: (id, pos, h1, h2), one row for each start of a k-gram.

    Tokens are hashed once, to 64 bits; grams are slices of those numbers, and each has two hashes.
    h2 starts from another seed: behind the gram, a seed would be folded onto h1 and add no bit.
    """
    hashed = df.select(F.col(id_col).alias("id"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("t"))
    grams = F.transform(ngram_starts(F.size("t"), k), lambda i: F.struct(i.alias("pos"), F.slice("t", i + 1, F.lit(k)).alias("gram")))
    rows = hashed.select("id", F.explode(grams).alias("x"))
    return rows.select("id", "x.pos", F.xxhash64("x.gram").alias("h1"), F.xxhash64(F.lit(1), "x.gram").alias("h2"))


def tails(tokens: Column) -> Column:
    """All suffixes, longest first."""
    return F.transform(ngram_starts(F.size(tokens), 1), lambda i: F.slice(tokens, i + 1, F.size(tokens) - i))


def heads(tokens: Column) -> Column:
    """All prefixes, shortest first."""
    return F.transform(ngram_starts(F.size(tokens), 1), lambda i: F.slice(tokens, F.lit(1), i + 1))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading tokens that two arrays share."""
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def suppress_repeats(grams: DataFrame, key: str = "id", gap: int = 2, chain: int = 2) -> DataFrame:
    """(id, pos, h1, h2) less repeats: of an n-gram's copies that follow each other within gap positions,
    more than chain later ones at least, only the last stays."""
    by = Window.partitionBy(key, "h1", "h2").orderBy("pos")
    fresh = F.when((F.col("pos") - F.lag("pos").over(by) <= gap), 0).otherwise(1)
    marked = grams.withColumn("_f", fresh).withColumn("_i", F.sum("_f").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    of = Window.partitionBy(key, "h1", "h2", "_i")
    marked = marked.withColumn("_n", F.count("*").over(of)).withColumn("_last", F.max("pos").over(of))
    return marked.where((F.col("_n") <= chain + 1) | (F.col("pos") == F.col("_last"))).select(key, "pos", "h1", "h2")


def few_grams(df: DataFrame, k: int, most: int = BROADCAST_GRAMS) -> bool:
    """Whether the k-grams of a table are at most so many, by the sizes of its token arrays."""
    n = df.agg(F.sum(F.greatest(F.size("tokens") - (k - 1), F.lit(0)).cast("long"))).first()[0]
    return (n or 0) <= most


def exact_matches(queries: DataFrame, fragments: DataFrame, k: int, *, q_id: str = "query_id", f_id: str = "frag_id", skip_self: bool = False, no_repeats: bool = False) -> DataFrame:
    """(query_id, frag_id, q_start, q_end, f_start, f_end, dist): every maximal run of k or more equal tokens.

    queries and fragments hold an id and an array column tokens; shorter arrays and nulls match
    nothing. The grams of fragments go to every task only if they are counted and few; then those of
    queries are never shuffled, only their hits. no_repeats leaves out the grams that
    suppress_repeats takes from each query, so a repeated passage does not meet itself many times.
    """
    grams = shingles(queries, q_id, k)
    q = (suppress_repeats(grams) if no_repeats else grams).select(F.col("id").alias("query_id"), F.col("pos").alias("q"), "h1", "h2")
    f = shingles(fragments, f_id, k).select(F.col("id").alias("frag_id"), F.col("pos").alias("f"), "h1", "h2")
    hits = q.join(F.broadcast(f) if few_grams(fragments, k) else f, ["h1", "h2"])
    if skip_self:
        hits = hits.where("query_id <> frag_id")
    hits = hits.select("query_id", "frag_id", "q", (F.col("q") - F.col("f")).alias("diag"))
    run = F.row_number().over(Window.partitionBy("query_id", "frag_id", "diag").orderBy("q"))
    islands = hits.withColumn("island", F.col("q") - run).groupBy("query_id", "frag_id", "diag", "island").agg(F.min("q").alias("q_start"), (F.max("q") + k).alias("q_end"))
    return islands.select("query_id", "frag_id", "q_start", "q_end", (F.col("q_start") - F.col("diag")).alias("f_start"), (F.col("q_end") - F.col("diag")).alias("f_end"), F.lit(0).alias("dist"))


def all_suffix_matches(matches: DataFrame, k: int) -> DataFrame:
    """Each maximal run and its suffixes of k or more tokens, as a search from every start gives them."""
    cut = F.explode(F.sequence(F.lit(0), F.col("q_end") - F.col("q_start") - k)).alias("cut")
    rows = matches.select("*", cut)
    return rows.select("query_id", "frag_id", (F.col("q_start") + F.col("cut")).alias("q_start"), "q_end", (F.col("f_start") + F.col("cut")).alias("f_start"), "f_end", "dist")


def fuzzy_words(queries: DataFrame, words: DataFrame, most: int, *, q: str = "query", w: str = "word") -> DataFrame:
    """(query, word, dist): pairs of distinct strings at most `most` edits apart.

    A string cut into most + 1 parts keeps one of them whole at a shift of at most `most`; parts
    are the join keys, and Levenshtein distance decides. Strings of most or fewer characters, which
    have no such parts, meet by length.
    """
    parts = most + 1
    left = queries.select(F.col(q).alias("query")).where(F.col(q).isNotNull()).distinct()
    right = words.select(F.col(w).alias("word")).where(F.col(w).isNotNull()).distinct()
    n = F.length("word")
    cut = lambda i: F.floor(n * i / parts).cast("int")
    pieces = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), n.alias("n"), F.substring("word", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(parts)])).alias("x")
    keyed = right.where(n > most).select("word", pieces).select("word", "x.*")
    # A query of m characters may meet words of m - most to m + most.
    lengths = F.explode(F.sequence(F.greatest(F.length("query") - most, F.lit(most + 1)), F.length("query") + most)).alias("n")
    asks = left.where(F.length("query") >= 1).select("query", lengths)
    asks = asks.select("query", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i")).withColumn("a", F.floor(F.col("n") * F.col("i") / parts).cast("int")).withColumn("b", F.floor(F.col("n") * (F.col("i") + 1) / parts).cast("int"))
    asks = asks.select("query", "n", "i", F.explode(F.sequence(F.greatest(F.col("a") - most, F.lit(0)), F.col("a") + most)).alias("at"), (F.col("b") - F.col("a")).alias("size")).select("query", "n", "i", F.expr("substring(query, at + 1, size)").alias("piece"))
    near = asks.join(keyed, ["n", "i", "piece"]).select("query", "word").distinct()
    short = left.select("query", F.length("query").alias("m")).where(F.col("m") <= 2 * most).join(right.where(n <= most).select("word", n.alias("n")), F.col("m") <= F.col("n") + most).select("query", "word")
    both = near.union(short).distinct()
    return both.withColumn("dist", F.levenshtein("query", "word", most)).where("dist >= 0")


def corners(a: list, b: list, most: int) -> list[tuple[int, int, int]]:
    """(i, j, edits): prefixes a[:i], b[:j] at most `most` edits apart that end on an equal token, or are
    empty; less those inside others of no more edits. A band of an edit distance, row by row."""
    over, width = most + 1, 2 * most + 1
    row = [over] * most + list(range(most + 1))  # by j - i + most
    last: dict[tuple[int, int], int] = {(0, most): 0}
    for i, x in enumerate(a, 1):
        new: list[int] = []
        for s in range(width):
            j = i + s - most
            if j < 1 or j > len(b):
                c = i if j == 0 else over
            elif x == b[j - 1]:
                c = row[s]
                if c <= most:
                    last[c, s] = i
            else:
                c = 1 + min(row[s], new[s - 1] if s else over, row[s + 1] if s + 1 < width else over)
            new.append(c)
        row = new
        if min(row) > most:
            break
    found = [(i, i + s - most, e) for (e, s), i in last.items()]
    return [x for x in found if not any(y != x and y[0] >= x[0] and y[1] >= x[1] and y[2] <= x[2] for y in found)]


def grown(q: list, f: list, runs: list[tuple[int, int, int]], k: int, most: int) -> list[tuple[int, int, int, int, int]]:
    """(q_start, q_end, f_start, f_end, dist): the largest ranges of k or more tokens of q, at most `most`
    edits from their range of f, through any of the runs (q_start, f_start, size) of equal tokens.

    An alignment that meets a run follows it but for fewer than `most` tokens at either end, or lies in a
    larger one; so it goes through the middle of a long run.
    """
    best: dict[tuple[int, int, int, int], int] = {}
    for q0, f0, size in runs:
        for at in [size // 2] if size >= 2 * most else range(size + 1):
            p, r = q0 + at, f0 + at
            after = corners(q[p : p + len(f) - r + most], f[r : r + len(q) - p + most], most)
            before = corners(q[max(0, p - r - most) : p][::-1], f[max(0, r - p - most) : r][::-1], most)
            for i, j, e in before:
                for m, n, d in after:
                    if e + d <= most and i + m >= k:
                        key = (p - i, p + m, r - j, r + n)
                        best[key] = min(best.get(key, most), e + d)
    kept: list[tuple[int, int, int, int]] = []
    # Those that hold another come before it.
    for x in sorted(best, key=lambda x: (x[0], -x[1], x[2], -x[3])):
        if not any(y[1] >= x[1] and y[2] <= x[2] and y[3] >= x[3] for y in kept):
            kept.append(x)
    return [(*x, best[x]) for x in kept]


def fuzzy_matches(queries: DataFrame, fragments: DataFrame, k: int, most: int) -> DataFrame:
    """(query_id, frag_id, q_start, q_end, f_start, f_end, dist): every maximal pair of ranges, k or more
    tokens of the query, that start and end on equal tokens and are at most `most` edits apart.

    Such ranges share a run of k // (most + 1) tokens; each run is a seed that grows both ways by a banded
    edit distance. dist is the edit distance; ranges inside another pair of ranges are left out. With
    most = 0 it equals exact_matches.
    """
    base = exact_matches(queries, fragments, max(1, k // (most + 1)))
    if most == 0:
        return base
    runs = base.groupBy("query_id", "frag_id").agg(F.collect_list(F.struct("q_start", "f_start", (F.col("q_end") - F.col("q_start")).alias("size"))).alias("runs"))
    q, f = queries.select(F.col("query_id").alias("_q"), F.col("tokens").alias("_qt")), fragments.select(F.col("frag_id").alias("_f"), F.col("tokens").alias("_ft"))
    pairs = runs.join(q, F.col("query_id").eqNullSafe(F.col("_q"))).join(f, F.col("frag_id").eqNullSafe(F.col("_f")))
    # Only the part of the query that a fragment can reach goes on.
    low = F.greatest(F.lit(0), F.array_min(F.transform("runs", lambda x: x["q_start"] - x["f_start"])) - most)
    high = F.array_max(F.transform("runs", lambda x: x["q_start"] - x["f_start"])) + F.size("_ft") + most
    pairs = pairs.select("query_id", "frag_id", "runs", low.alias("low"), F.slice("_qt", low + 1, high - low).alias("q"), F.col("_ft").alias("f"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for at, (runs, low, q, f) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                found = grown(q, f, [(x["q_start"] - low, x["f_start"], x["size"]) for x in runs], k, most)
                rows += [at] * len(found)
                out += [(a + low, b + low, c, d, e) for a, b, c, d, e in found]
            at = pa.array(rows, pa.int64())
            columns = [pa.array([x[i] for x in out], pa.int32()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=[*names, "q_start", "q_end", "f_start", "f_end", "dist"])

    names = ["query_id", "frag_id"]
    types = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in names)
    return pairs.mapInArrow(grow, f"{types}, q_start int, q_end int, f_start int, f_end int, dist int")


def text_range(tokens: Column, start: Column, end: Column) -> Column:
    """Characters from the first to the last token of a range; tokens are structs with start and end."""
    return F.struct(F.get(tokens, start)["start"].alias("start"), F.get(tokens, end - 1)["end"].alias("end"))
