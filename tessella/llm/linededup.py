"""Removal of boilerplate lines that many distinct sites share.

Each line's hash gathers a HyperLogLog sketch of its sites; sketches merge in partial and final
aggregation, so a line on every site costs one small row a task. Lines whose estimate lies near
the threshold are counted exactly. A line above it stays only where it stands first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import materialize

NULL_SITE = "\0null"
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> list[Column]:
    """Two hashes of a trimmed line, 96 bits together."""
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def boilerplate_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, *, min_sites: int = 8, short_chars: int = 12, short_sites: int = 24, lg_k: int = 12) -> DataFrame:
    """(h1, h2, n_sites, first_id): trimmed lines, blank ones excepted, on at least min_sites sites.

    Lines under short_chars need short_sites, since few words say the same by chance. A null site is
    a site of its own. first_id is the least id of a document that holds the line.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit(NULL_SITE)).alias("site"), F.explode(_lines(F.col(text_col))).alias("line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.col("line") != "").select("id", "site", *_key(F.col("line")), F.when(F.length("line") >= short_chars, min_sites).otherwise(short_sites).alias("need"))
    slack = 4 * 1.04 / 2 ** (lg_k / 2)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("need").alias("need"))
    # A line with fewer occurrences than sites needed can't be on as many.
    found = spread.where("n >= need").withColumn("n_sites", F.hll_sketch_estimate("sketch")).where(F.col("n_sites") >= F.col("need") * (1 - slack) - 1)
    found = materialize(found.select("h1", "h2", "n_sites", "first_id", "need"), "spread")
    unsure = F.col("n_sites") <= F.col("need") * (1 + slack) + 1
    exact = lines.join(found.where(unsure).select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.min("id").alias("first_id"), F.max("need").alias("need")).groupBy("h1", "h2").agg(F.count("*").alias("n_sites"), F.min("first_id").alias("first_id"), F.max("need").alias("need"))
    return materialize(found.where(~unsure).unionByName(exact.where("n_sites >= need")).drop("need"), "boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = 8, short_chars: int = 12, short_sites: int = 24, lg_k: int = 12, n_removed: str = "lines_removed") -> DataFrame:
    """All rows and columns of docs, boilerplate lines cut from the text, with their number.

    A document's line goes if its trimmed text is on at least min_sites distinct sites (short_sites
    if it has under short_chars) and a document with a smaller id holds it too, or the same document
    earlier; the first stays. Blank lines stay. Null texts stay null with 0 removed, null sites count as one
    site, rows with a null id lose every boilerplate line, and repeated rows are treated alike.
    Other columns pass through.
    """
    own = "_ld"
    while any(c.startswith(own) for c in docs.columns):
        own = f"_{own}"
    boiler = boilerplate_lines(docs, id_col, text_col, site_col, min_sites=min_sites, short_chars=short_chars, short_sites=short_sites, lg_k=lg_k)
    places = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    places = places.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.col("line") != "").select("id", "body", "pos", *_key(F.col("line")))
    hits = places.join(boiler.select("h1", "h2", "first_id"), ["h1", "h2"])
    # In the first document the line's own first place stays.
    first = F.coalesce(F.col("id") == F.col("first_id"), F.lit(False))
    hits = hits.groupBy("id", "body", "h1", "h2", first.alias("first")).agg(F.array_sort(F.array_distinct(F.collect_list("pos"))).alias("at"))
    cut = F.when(F.col("first"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))
    cuts = hits.select("id", "body", cut.alias("at")).where(F.size("at") > 0).groupBy(F.col("id").alias(f"{own}id"), F.col("body").alias(f"{own}body")).agg(F.flatten(F.collect_list("at")).alias(f"{own}cut"))
    cuts = materialize(cuts, "cuts")
    joined = docs.withColumn(f"{own}b", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(cuts, F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}b") == F.col(f"{own}body")), "left")
    at = F.col(f"{own}cut")
    # The one-element array binds the lines, so they are split once; the places kept are a set difference.
    kept = F.transform(F.array(_lines(F.col(text_col))), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), at), lambda i: F.get(x, i)), "\n"))[0]
    text = F.when(at.isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.coalesce(F.size(at), F.lit(0)).cast("long").alias(n_removed))


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its text after the removal."""
    return remove_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), "lines_removed")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0) || 'null') AS site, i, trim(s[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) t, unnest(range(1, len(s) + 1)) AS u(i)
), b AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN length(line) >= 12 THEN 8 ELSE 24 END
), own AS (
  SELECT l.doc_id, l.line, min(l.i) AS at FROM l JOIN b ON l.line = b.line AND l.doc_id = b.first_id GROUP BY ALL
), cut AS (
  SELECT l.doc_id, l.i FROM l JOIN b ON l.line = b.line LEFT JOIN own ON own.doc_id = l.doc_id AND own.line = l.line
  WHERE own.at IS NULL OR l.i > own.at
), c AS (SELECT doc_id, list(i) AS cuts, count(*) AS n FROM cut GROUP BY doc_id),
t AS (
  SELECT d.doc_id, CASE WHEN n IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(cuts, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text, coalesce(n, 0) AS lines_removed
  FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
)
SELECT doc_id, text, coalesce(length(text), 0)::BIGINT AS n_chars_left, lines_removed::BIGINT AS lines_removed FROM t
"""


def keep_unrepeated_lines(docs: DataFrame) -> DataFrame:
    """Boilerplate lines go; so do documents of which nothing but blanks is left.

    Null texts, sites and ids and repeated rows are treated as in remove_boilerplate; a text that
    lost no line stays as it is, null and empty ones included.
    """
    got = remove_boilerplate(docs, n_removed="_removed" if "_removed" not in docs.columns else "__removed")
    removed = F.col(got.columns[-1])
    got = got.where((removed == 0) | (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0))
    return got.select(*[F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
