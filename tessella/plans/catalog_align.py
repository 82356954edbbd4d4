"""Queries of alignment, group filters and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import align, cluster, present, semantic
from ..settings import LOW, SearchSettings, with_overrides
from .catalog import Tables, query
from .search import prepare, search

K = 10
WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
Q = f"q AS (SELECT doc_id AS query_id, {WORDS} AS t FROM documents WHERE text IS NOT NULL)"
FRAG = f"f AS (SELECT item_id AS frag_id, {WORDS} AS t FROM benchmark WHERE text IS NOT NULL)"


def matches_sql(k: int = K, q: str = Q, f: str = FRAG, extra: str = "") -> str:
    return f"""WITH {q}, {f},
qs AS (SELECT query_id, i AS q, array_to_string(t[i+1:i+{k}], ' ') AS g FROM q, unnest(range(0, len(t) - {k - 1})) AS u(i)),
fs AS (SELECT frag_id, i AS f, array_to_string(t[i+1:i+{k}], ' ') AS g FROM f, unnest(range(0, len(t) - {k - 1})) AS u(i)),
h AS (SELECT query_id, frag_id, q, q - f AS diag FROM qs JOIN fs ON qs.g = fs.g {extra}),
r AS (SELECT *, q - row_number() OVER (PARTITION BY query_id, frag_id, diag ORDER BY q) AS isl FROM h),
m AS (SELECT query_id, frag_id, min(q) AS q_start, max(q) + {k} AS q_end, min(q) - diag AS f_start, max(q) + {k} - diag AS f_end, 0::BIGINT AS dist FROM r GROUP BY query_id, frag_id, diag, isl)"""


SUBSUMED = """s AS (SELECT a.* FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.query_id = a.query_id AND b.frag_id = a.frag_id
 AND b.q_start <= a.q_start AND a.q_end <= b.q_end AND b.f_start <= a.f_start AND a.f_end <= b.f_end AND b.dist <= a.dist
 AND (b.q_start <> a.q_start OR b.q_end <> a.q_end OR b.f_start <> a.f_start OR b.f_end <> a.f_end)))"""
COVER = """o AS (SELECT *, max(f_end) OVER (PARTITION BY query_id, frag_id ORDER BY f_start, f_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR f_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, frag_id ORDER BY f_start, f_end ROWS UNBOUNDED PRECEDING) AS isl FROM o),
c AS (SELECT query_id, frag_id, sum(e - b) AS covered FROM (SELECT query_id, frag_id, isl, min(f_start) AS b, max(f_end) AS e FROM i GROUP BY ALL) GROUP BY ALL),
cov AS (SELECT c.query_id, c.frag_id, covered / len(t) AS coverage FROM c JOIN f ON f.frag_id = c.frag_id)"""
COLS = "query_id, frag_id, q_start, q_end, f_start, f_end, dist"


def _prepared(t: Tables) -> tuple[DataFrame, DataFrame]:
    return prepare(t.documents, "doc_id", "text", "query_id"), prepare(t.benchmark, "item_id", "text", "frag_id")


def _matches(t: Tables, k: int = K) -> DataFrame:
    q, f = _prepared(t)
    return align.exact_matches(q, f, k)


def search_sql(k: int, least_sum: int, coverage: float) -> str:
    return f"""{matches_sql(k)}, {SUBSUMED}, {COVER},
l AS (SELECT query_id, frag_id, sum(f_end - f_start) AS sum_len FROM s GROUP BY ALL),
found AS (SELECT s.*, cov.coverage FROM s JOIN cov ON s.query_id = cov.query_id AND s.frag_id = cov.frag_id JOIN l ON s.query_id = l.query_id AND s.frag_id = l.frag_id WHERE sum_len >= {least_sum} AND coverage >= {coverage})"""


@query("flagship", f"""{search_sql(K, 0, 0.5)} SELECT query_id, frag_id, count(*)::BIGINT AS n_matches, sum(f_end - f_start)::BIGINT AS sum_len, max(coverage) AS coverage FROM found GROUP BY ALL""")
def flagship(t: Tables) -> DataFrame:
    """Which documents reuse which passages, and how completely."""
    q, f = _prepared(t)
    found = search(q, f, SearchSettings(min_match=K, coverage=0.5))
    return found.groupBy("query_id", "frag_id").agg(F.count("*").alias("n_matches"), F.sum(F.col("f_end") - F.col("f_start")).alias("sum_len"), F.max("coverage").alias("coverage"))


@query("aln01_ngrams_apart", f"SELECT item_id, i AS pos, array_to_string(t[i+1:i+{K}], ' ') AS gram FROM (SELECT item_id, {WORDS} AS t FROM benchmark), unnest(range(0, len(t) - {K - 1}, {K})) AS u(i)")
def ngrams_apart(t: Tables) -> DataFrame:
    g = align.ngrams(T.words(F.col("text")), K, K)
    return t.benchmark.select("item_id", F.explode(g).alias("g")).select("item_id", "g.pos", F.array_join("g.gram", " ").alias("gram"))


@query("aln02_ngrams", f"SELECT item_id, i AS pos, array_to_string(t[i+1:i+{K}], ' ') AS gram FROM (SELECT item_id, {WORDS} AS t FROM benchmark), unnest(range(0, len(t) - {K - 1})) AS u(i)")
def ngrams_all(t: Tables) -> DataFrame:
    g = align.ngrams(T.words(F.col("text")), K)
    return t.benchmark.select("item_id", F.explode(g).alias("g")).select("item_id", "g.pos", F.array_join("g.gram", " ").alias("gram"))


@query("aln03_suppress_repeats", """WITH g AS (SELECT doc_id, i AS pos, t[i+1] AS gram FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), unnest(range(0, len(t))) AS u(i)),
a AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, gram ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM g),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, gram ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM a),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram, isl) AS n, max(pos) OVER (PARTITION BY doc_id, gram, isl) AS last FROM b)
SELECT doc_id, count(*)::BIGINT AS n_kept FROM c WHERE n <= 3 OR pos = last GROUP BY doc_id""")
def suppress(t: Tables) -> DataFrame:
    g = align.shingles(t.documents.select("doc_id", T.words(F.col("text")).alias("tokens")), "doc_id", 1)
    return align.suppress_repeats(g).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_kept"))


@query("aln04_suffix_index", f"SELECT item_id, count(*)::BIGINT AS n_suffixes, sum(len(t) - i)::BIGINT AS n_tokens FROM (SELECT item_id, {WORDS} AS t FROM benchmark), unnest(range(0, len(t) - {K - 1})) AS u(i) GROUP BY item_id")
def suffix_index(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", T.words(F.col("text")).alias("tokens"))
    s = rows.select("item_id", F.explode(F.filter(align.tails(F.col("tokens")), lambda x: F.size(x) >= K)).alias("s"))
    return s.groupBy("item_id").agg(F.count("*").alias("n_suffixes"), F.sum(F.size("s")).alias("n_tokens"))


@query("aln10_common_prefix", f"""WITH p AS (SELECT a.item_id AS a_id, b.item_id AS b_id, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS x, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT a_id, b_id, coalesce((SELECT min(i) FROM unnest(range(0, least(len(x), len(y)))) AS u(i) WHERE x[i+1] <> y[i+1]), least(len(x), len(y)))::BIGINT AS n FROM p""")
def prefix(t: Tables) -> DataFrame:
    a, b = t.benchmark.select(F.col("item_id").alias("a_id"), T.words(F.col("text")).alias("x")), t.benchmark.select(F.col("item_id").alias("b_id"), T.words(F.col("text")).alias("y"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", align.common_prefix(F.col("x"), F.col("y")).alias("n"))


@query("aln12_gram_counts", f"SELECT gram, count(*)::BIGINT AS n FROM (SELECT array_to_string(t[i+1:i+{K}], ' ') AS gram FROM (SELECT {WORDS} AS t FROM benchmark), unnest(range(0, len(t) - {K - 1})) AS u(i)) GROUP BY gram")
def gram_counts(t: Tables) -> DataFrame:
    g = align.ngrams(T.words(F.col("text")), K)
    return t.benchmark.select(F.explode(g).alias("g")).groupBy(F.array_join("g.gram", " ").alias("gram")).agg(F.count("*").alias("n"))


@query("aln16_matches", f"{matches_sql()} SELECT {COLS} FROM m")
def matches(t: Tables) -> DataFrame:
    return _matches(t)


@query("aln16_all_suffixes", f"{matches_sql()} SELECT query_id, frag_id, q_start + x AS q_start, q_end, f_start + x AS f_start, f_end, dist FROM m, unnest(range(0, q_end - q_start - {K - 1})) AS u(x)")
def raw_matches(t: Tables) -> DataFrame:
    return align.all_suffix_matches(_matches(t), K)


@query("aln18_fuzzy_words", """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), b AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS w FROM part UNION SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT w.w AS query, b.w AS word, levenshtein(w.w, b.w)::BIGINT AS dist FROM w JOIN b ON levenshtein(w.w, b.w) <= 2 WHERE w.w <> ''""")
def fuzzy_words(t: Tables) -> DataFrame:
    names = t.part.select(F.explode(F.split("p_name", " ")).alias("w"))
    types = t.part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("w"))
    return align.fuzzy_words(names, types.union(names), 2, q="w", w="w").where("query <> ''")


@query("aln19_fuzzy_matches")
def fuzzy_matches(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    return align.fuzzy_matches(q, f, 20, 2)


@query("aln22_text_ranges", f"""{matches_sql()} SELECT m.query_id, m.frag_id, array_to_string(q.t[q_start+1:q_end], ' ') AS shared, len(array_to_string(q.t[q_start+1:q_end], ' '))::BIGINT AS n_chars FROM m JOIN q ON q.query_id = m.query_id""")
def shared_text(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    m = align.exact_matches(q, f, K).join(q.select("query_id", "tokens"), "query_id")
    shared = F.array_join(R.slice_of(F.col("tokens"), F.col("q_start"), F.col("q_end")), " ")
    return m.select("query_id", "frag_id", shared.alias("shared"), F.length(shared).alias("n_chars"))


@query("agg01_sum_length", f"{matches_sql()} SELECT query_id, frag_id, sum(f_end - f_start)::BIGINT AS sum_len FROM m GROUP BY ALL HAVING sum(f_end - f_start) >= 20")
def sum_length(t: Tables) -> DataFrame:
    return A.with_sum_length(A.min_sum_length(_matches(t), 20)).select("query_id", "frag_id", "sum_len").distinct()


@query("agg02_coverage", f"{matches_sql()}, s AS (SELECT * FROM m), {COVER} SELECT query_id, frag_id, coverage FROM cov WHERE coverage >= 0.3")
def group_coverage(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    return A.min_coverage(align.exact_matches(q, f, K), f, 0.3).select("query_id", "frag_id", "coverage").distinct()


@query("agg04_counts", f"{matches_sql()} SELECT query_id, count(DISTINCT frag_id)::BIGINT AS n_fragments, count(DISTINCT frag_id)::BIGINT AS n_groups, count(*)::BIGINT AS n_matches FROM m GROUP BY query_id")
def counts(t: Tables) -> DataFrame:
    return A.counts(_matches(t))


@query("jon08_subsumption", f"{matches_sql(3)}, {SUBSUMED} SELECT {COLS} FROM s")
def subsumption(t: Tables) -> DataFrame:
    return A.remove_subsumed(_matches(t, 3))


@query("flt06_min_length", f"{matches_sql()} SELECT {COLS} FROM m WHERE f_end - f_start >= 15")
def min_length(t: Tables) -> DataFrame:
    return A.min_length(_matches(t), 15)


@query("ord01_order", f"{matches_sql()} SELECT {COLS}, row_number() OVER (PARTITION BY query_id ORDER BY q_start, q_end - q_start DESC, frag_id, f_start) AS place FROM m")
def order(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("q_start", F.desc(F.col("q_end") - F.col("q_start")), "frag_id", "f_start"))
    return _matches(t).withColumn("place", place)


@query("search_low", f"{search_sql(LOW.min_match, LOW.min_sum, LOW.coverage)} SELECT {COLS}, coverage FROM found")
def search_low(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    return search(q, f, with_overrides(LOW, blocks=False)).drop("group_id")


@query("search_blocks")
def search_blocks(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    return search(q, f, LOW)


SEMANTIC = f"""{search_sql(LOW.min_match, LOW.min_sum, LOW.coverage)},
n AS (SELECT count(*) AS n FROM f), df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT frag_id, unnest(t) AS word FROM f) GROUP BY word),
qw AS (SELECT query_id, frag_id, word, count(*) AS a FROM (SELECT found.query_id, found.frag_id, unnest(q.t[q_start+1:q_end]) AS word FROM found JOIN q ON q.query_id = found.query_id) GROUP BY ALL),
fw AS (SELECT query_id, frag_id, word, count(*) AS b FROM (SELECT found.query_id, found.frag_id, unnest(f.t[f_start+1:f_end]) AS word FROM found JOIN f ON f.frag_id = found.frag_id) GROUP BY ALL),
both_ AS (SELECT coalesce(qw.query_id, fw.query_id) AS query_id, coalesce(qw.frag_id, fw.frag_id) AS frag_id, coalesce(qw.word, fw.word) AS word, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM qw FULL JOIN fw ON qw.query_id = fw.query_id AND qw.frag_id = fw.frag_id AND qw.word = fw.word),
wt AS (SELECT query_id, frag_id, a * ln((1 + n) / (1 + coalesce(df, 0))) AS a, b * ln((1 + n) / (1 + coalesce(df, 0))) AS b FROM both_ LEFT JOIN df ON df.word = both_.word, n),
sim AS (SELECT query_id, frag_id, CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END AS sim FROM wt GROUP BY ALL)"""


@query("search_semantic", f"{SEMANTIC} SELECT {', '.join('found.' + c for c in COLS.split(', '))}, coverage, round(sim, 8) AS sim FROM found JOIN sim ON sim.query_id = found.query_id AND sim.frag_id = found.frag_id WHERE sim >= 0.4")
def search_semantic(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    return search(q, f, with_overrides(LOW, blocks=False, semantic=0.4)).drop("group_id").withColumn("sim", F.round("sim", 8))


@query("sem06_document_frequency", f"SELECT word, sum(n)::BIGINT AS tf, count(*)::BIGINT AS df FROM (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest({WORDS}) AS word FROM benchmark) GROUP BY ALL) GROUP BY word")
def document_frequency(t: Tables) -> DataFrame:
    return semantic.term_counts(t.benchmark.select("item_id", T.words(F.col("text")).alias("words")), "item_id")


SIM = f"""WITH d AS (SELECT item_id, {WORDS} AS t FROM benchmark), n AS (SELECT count(*) AS n FROM d),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(t) AS word FROM d) GROUP BY word),
tf AS (SELECT item_id, word, count(*) AS tf FROM (SELECT item_id, unnest(t) AS word FROM d) GROUP BY ALL),
w AS (SELECT item_id, tf.word, tf * ln((1 + n) / (1 + df)) AS w FROM tf JOIN df ON tf.word = df.word, n),
z AS (SELECT item_id, sum(w * w) AS z FROM w GROUP BY item_id),
dot AS (SELECT a.item_id AS a_id, b.item_id AS b_id, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.word = b.word AND b.item_id = a.item_id + 1 GROUP BY ALL)
SELECT p.item_id AS a_id, q.item_id AS b_id, round(CASE WHEN p.z > 0 AND q.z > 0 THEN coalesce(dot, 0) / sqrt(p.z * q.z) ELSE 0 END, 9) AS sim FROM z p JOIN z q ON q.item_id = p.item_id + 1 LEFT JOIN dot ON a_id = p.item_id AND b_id = q.item_id"""


@query("sem07_cosine", SIM)
def cosine(t: Tables) -> DataFrame:
    d = t.benchmark.select("item_id", T.words(F.col("text")).alias("words"))
    pairs = d.select(F.col("item_id").alias("a_id"), F.col("words").alias("q_words")).join(d.select(F.col("item_id").alias("b_id"), F.col("words").alias("f_words")), F.col("b_id") == F.col("a_id") + 1)
    return semantic.cosine(pairs, d, ["a_id", "b_id"]).withColumn("sim", F.round("sim", 9))


SELF = f"q AS (SELECT item_id AS query_id, {WORDS} AS t FROM benchmark)"


@query("grf05_clusters", f"""WITH RECURSIVE {matches_sql(3, SELF, FRAG, 'AND query_id <> frag_id')[5:]}, {SUBSUMED}, {COVER},
e AS (SELECT query_id AS a, frag_id AS b FROM cov WHERE coverage >= 0.02),
p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a),
k AS (SELECT x.item_id AS node, least(x.item_id, coalesce((SELECT min(p.b) FROM p JOIN p r ON r.a = p.b AND r.b = p.a WHERE p.a = x.item_id), x.item_id)) AS cluster_id FROM benchmark x)
SELECT node, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM k""")
def clusters(t: Tables) -> DataFrame:
    f = prepare(t.benchmark, "item_id", "text", "frag_id")
    return cluster.cluster_patterns(f, SearchSettings(min_match=3, coverage=0.02))


SITES = f"""{search_sql(3, 0, 0.02)},
g AS (SELECT query_id, frag_id, array_to_string(list_transform(list_sort(list(DISTINCT [q_start, q_end])), lambda r: r[1] || '-' || r[2]), ',') AS site, sum(f_end - f_start)::BIGINT AS sum_len, max(coverage) AS coverage FROM found GROUP BY query_id, frag_id)"""


def _sites(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    return present.sites(search(q, f, SearchSettings(min_match=3, coverage=0.02)), f)


@query("ord05_sites", f"{SITES} SELECT query_id, site, frag_id, coverage, sum_len FROM g")
def sites(t: Tables) -> DataFrame:
    return _sites(t)


@query("ord06_rank", f"""{SITES}, rk AS (SELECT query_id, site, count(*) AS n_results, avg(coverage) AS cov, avg(sum_len) AS len FROM g GROUP BY ALL)
SELECT query_id, site, n_results, round(cov * len / max(len) OVER (PARTITION BY query_id), 9) AS score FROM rk""")
def rank(t: Tables) -> DataFrame:
    return present.rank_sites(_sites(t)).select("query_id", "site", "n_results", F.round("score", 9).alias("score"))


@query("ord07_first_of_site", f"""{SITES}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, site ORDER BY coverage DESC, frag_id) AS place, greatest(count(*) OVER (PARTITION BY query_id, site) - 3, 0) AS others FROM g)
SELECT query_id, site, frag_id, coverage, sum_len, place, others FROM rk WHERE place <= 3""")
def first_of_site(t: Tables) -> DataFrame:
    return present.first_of_each(_sites(t))


@query("ord03_by_coverage", f"{search_sql(K, 0, 0.5)} SELECT query_id, frag_id, coverage, row_number() OVER (ORDER BY coverage DESC, query_id, frag_id) AS place FROM (SELECT DISTINCT query_id, frag_id, coverage FROM found)")
def by_coverage(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    groups = search(q, f, SearchSettings(min_match=K, coverage=0.5)).select("query_id", "frag_id", "coverage").distinct()
    # A report over all results; its order is the result.
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("coverage"), "query_id", "frag_id")))


@query("jon11_with_texts", f"{search_sql(K, 0, 0.5)} SELECT DISTINCT found.query_id, found.frag_id, coalesce(CASE WHEN b.item_id % 2 = 0 THEN b.text END, '<missing fragment>') AS fragment_text FROM found LEFT JOIN benchmark b ON b.item_id = found.frag_id")
def with_texts(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    found = search(q, f, SearchSettings(min_match=K, coverage=0.5)).select("query_id", "frag_id").distinct()
    return present.with_texts(found, f.withColumn("text", F.when(F.col("frag_id") % 2 == 0, F.col("text")))).select("query_id", "frag_id", "fragment_text")


@query("fn17_messages")
def messages(t: Tables) -> DataFrame:
    q, f = _prepared(t)
    m = search(q, f, SearchSettings(min_match=K, coverage=0.5))
    m = m.select("*", *[F.col(x).alias(y) for x, y in (("q_start", "q_txt_start"), ("q_end", "q_txt_end"), ("f_start", "f_txt_start"), ("f_end", "f_txt_end"))])
    return present.match_messages(m).select("query_id", "source", F.to_json("matches").alias("matches"))
