"""Queries for the operators outside the training-data subpackage, and the same in DuckDB's SQL.

The tables hold no receptors, so operators run on stand-ins: ``embeddings`` as clouds, nations as samples
with parts as clones, sequences made from part keys.  Both sides build them by the same formulas.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.names import allele_to_major, allele_with_default, strip_allele, tokens, tokens_to_sequence
from plexivec.functions.names import prototype_hash as names_hash
from plexivec.functions.stats import benjamini_hochberg, fisher_combine, poisson_tail, size_weight
from plexivec.functions.vectors import l2sq
from plexivec.learn import sequences, sets
from plexivec.operators import basis, cluster, cohort, density, embedding, evaluate, neighbors, repertoire, strings, theory
from plexivec.plans.batches import spread
from plexivec.plans.staging import staged
from plexivec.sources.formats import allele_counts, antigen_subset, library_consistency, load_labels
from plexivec.sources.generator import generate_records, generator_counts, learn_generator
from plexivec.sources.tables import table
from plexivec.streaming.incremental import windowed_descriptor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RADIUS2 = 1.5
OMEGA, PHASE = basis.random_features(4, 6, 1.0, 7)


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    """A column rounded to six decimals."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c)


# ---- stand-ins

JUNCTION = "concat('C', translate(substr(md5(cast(p_partkey as string)), 1, cast(6 + p_partkey % 7 as int)), '0123456789abcdef', 'ADEFGHIKLNPQRSTV'), 'F')"
DENSE = "translate(substr(md5(cast(p_partkey as string)), 1, cast(3 + p_partkey % 3 as int)), '0123456789abcdef', 'AAEEGGIIKKLLSSTT')"
_JUNCTION = JUNCTION.replace("as string", "as varchar")
_DENSE = DENSE.replace("as string", "as varchar")
_CLONES = "clones AS (SELECT c_nationkey AS sample, l_partkey AS clone, sum(l_quantity) AS a, count(*)::BIGINT AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def junctions(spark: SparkSession, sf_dir: str, expr: str = JUNCTION) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.expr(expr).alias("seq"))


def clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as samples, parts as clones with their quantity ``a`` and number of lines ``k``."""
    l, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("sample"), F.col("l_partkey").alias("clone")).agg(F.sum("l_quantity").alias("a"), F.count("*").alias("k"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six random features of the first four coordinates, as expressions, with a weight by key."""
    v = vectors(spark, sf_dir)
    terms = [F.lit(float(np.sqrt(2 / 6))) * F.cos(sum((F.col("embedding")[i].cast("double") * float(OMEGA[i, j]) for i in range(4)), F.lit(0.0)) + float(PHASE[j])) for j in range(6)]
    return v.select("vec_id", "label", (F.col("vec_id") % 5 + 1).alias("a"), F.array(*terms).alias("psi"))


_PSI = "[" + ", ".join(f"{float(np.sqrt(2 / 6))!r}::DOUBLE * cos(" + " + ".join(f"embedding[{i + 1}]::DOUBLE * {float(OMEGA[i, j])!r}::DOUBLE" for i in range(4)) + f" + {float(PHASE[j])!r}::DOUBLE)" for j in range(6)) + "]"
_FEATURES = f"f AS (SELECT vec_id, label, vec_id % 5 + 1 AS a, {_PSI} AS psi FROM embeddings)"
_MEANS = f"{_FEATURES}, t AS (SELECT label, sum(ln(1 + a)) AS g, sum(ln(1 + a) * ln(1 + a)) AS gg FROM f GROUP BY 1), m0 AS (SELECT label, j, sum(ln(1 + a) * psi[j]) AS s FROM f, range(1, 7) r(j) GROUP BY 1, 2), m AS (SELECT label, list(s / g ORDER BY j) AS mean, any_value(g * g / gg) AS n_eff FROM m0 JOIN t USING (label) GROUP BY 1)"


def kernel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repertoire.sample_embedding(features(spark, sf_dir), "label", "a", "psi", blocks=("mean",))


# ---- A, B, C: sources, filters, names


@query("""SELECT o_orderpriority AS junction_aa, o_orderstatus AS v_call, o_orderstatus AS j_call, CASE WHEN o_orderkey % 2 = 0 THEN 'TRA' ELSE 'TRB' END AS chain, c_mktsegment AS epitope, min(CASE WHEN o_orderkey % 3 = 0 THEN 'MHCI' ELSE 'MHCII' END) AS mhc_class
FROM orders JOIN customer ON o_custkey = c_custkey WHERE length(o_orderpriority) >= 5 GROUP BY ALL""")
def dedup_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = o.select(F.col("o_orderpriority").alias("cdr3"), F.col("o_orderstatus").alias("v.segm"), F.col("o_orderstatus").alias("j.segm"), F.when(F.col("o_orderkey") % 2 == 0, "TRA").otherwise("TRB").alias("gene"), F.col("c_mktsegment").alias("antigen.epitope"), F.when(F.col("o_orderkey") % 3 == 0, "MHCI").otherwise("MHCII").alias("mhc.class"))
    return load_labels(raw)


@query("""WITH o AS (SELECT p_partkey, p_type AS chain, p_brand AS epitope FROM part), c AS (SELECT epitope, count(*) AS n FROM o WHERE chain = (SELECT min(p_type) FROM part) GROUP BY 1)
SELECT o.* FROM o JOIN c USING (epitope) WHERE chain = (SELECT min(p_type) FROM part) AND n >= 10""")
def antigen_subset_query(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("chain"), F.col("p_brand").alias("epitope"))
    return antigen_subset(p, p.agg(F.min("chain")).first()[0], 10)


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || '*02' WHEN 1 THEN p_brand || '*' WHEN 2 THEN p_brand ELSE '' END AS name FROM part),
b AS (SELECT *, regexp_extract(name, '^\\s*([^*\\s]+)', 1) AS base, regexp_extract(name, '\\*\\s*([^\\s]+)', 1) AS allele FROM n)
SELECT p_partkey, base AS gene, CASE WHEN base = '' THEN '' ELSE base || '*' || CASE WHEN allele = '' THEN '01' ELSE allele END END AS allele, base || '*01' AS major FROM b""")
def strip_allele_query(spark, sf_dir):
    k = F.col("p_size") % 4
    name = F.when(k == 0, F.concat("p_brand", F.lit("*02"))).when(k == 1, F.concat("p_brand", F.lit("*"))).when(k == 2, F.col("p_brand")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", strip_allele(name).alias("gene"), allele_with_default(name).alias("allele"), allele_to_major(name).alias("major"))


_KNOWN = ["Brand#11*02", "Brand#12*01", "Brand#13", "Brand#21*01", "Brand#22"]


@query(f"""WITH n AS (SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '*02' ELSE '' END AS name, p_brand AS base FROM part), k AS (SELECT {_KNOWN!r} AS known)
SELECT p_partkey, CASE WHEN list_contains(known, CASE WHEN name = base THEN base || '*01' ELSE name END) THEN CASE WHEN name = base THEN base || '*01' ELSE name END
 WHEN list_contains(known, base || '*01') THEN base || '*01' WHEN list_contains(known, base) THEN base END AS resolved FROM n, k""")
def allele_cascade(spark, sf_dir):
    name = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "*02").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", embedding.resolve_allele(name, F.array(*map(F.lit, _KNOWN))).alias("resolved"))


@query(f"""SELECT substr(sha256(string_agg({_JUNCTION} || chr(0), '' ORDER BY p_partkey)), 1, 16) AS hash FROM part WHERE p_partkey < 100""")
def prototype_hash(spark, sf_dir):
    p = junctions(spark, sf_dir).filter("p_partkey < 100").select(F.col("p_partkey").alias("proto_idx"), F.col("seq").alias("junction_aa"))
    return p.agg(names_hash(p).alias("hash"))


@query(f"""WITH s AS (SELECT p_partkey, {_JUNCTION} || CASE WHEN p_partkey % 3 = 0 THEN repeat('AB', 17) ELSE '' END AS s FROM part),
t AS (SELECT p_partkey, list_transform(string_split(s, ''), lambda c: CASE WHEN instr('ACDEFGHIKLMNPQRSTVWY', c) > 0 THEN instr('ACDEFGHIKLMNPQRSTVWY', c) - 1 ELSE 20 END) AS c, length(s) AS n FROM s),
u AS (SELECT p_partkey, CASE WHEN n <= 7 THEN c || list_transform(range(40 - n), lambda i: 20) ELSE c[1:4] || c[5:least(n - 3, 37)] || list_transform(range(40 - 7 - (least(n - 3, 37) - 4)), lambda i: 20) || c[n - 2:n] END AS ids FROM t)
SELECT p_partkey, array_to_string(ids, ' ') AS ids, len(ids)::INTEGER AS n, array_to_string(list_transform(list_filter(ids, lambda x: x < 20), lambda x: 'ACDEFGHIKLMNPQRSTVWY'[x + 1]), '') AS seq FROM u""")
def tokenize(spark, sf_dir):
    s = junctions(spark, sf_dir).withColumn("seq", F.concat("seq", F.when(F.col("p_partkey") % 3 == 0, "AB" * 17).otherwise("")))
    ids = tokens(F.col("seq"))
    return s.select("p_partkey", F.array_join(ids.cast("array<string>"), " ").alias("ids"), F.size(ids).alias("n"), tokens_to_sequence(ids).alias("seq"))


@query(f"""WITH {_CLONES} SELECT sample, clone, 1.0::DOUBLE AS g_distinct, round(ln(1 + a), 6) AS g_log1p, round(sqrt(a + 0.375::DOUBLE), 6) AS g_anscombe FROM clones""")
def size_weights(spark, sf_dir):
    a = F.col("a")
    return clones(spark, sf_dir).select("sample", "clone", size_weight(a, "distinct").alias("g_distinct"), r6(size_weight(a, "log1p"), "g_log1p"), r6(size_weight(a, "anscombe"), "g_anscombe"))


# ---- D: distances and the prototype embedding


@query(f"""SELECT a.vec_id, b.vec_id AS proto_idx, {_D2.format('a.embedding', 'b.embedding')} AS d FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 16) b""")
def prototype_embed(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return embedding.vector_embed(v, v.filter("vec_id < 16").select(F.col("vec_id").alias("proto_idx"), "embedding"), "vec_id", "embedding")


_GRAM = embedding.gram(embedding.substitution())


@query(f"""WITH s AS (SELECT p_partkey, {_JUNCTION} AS s FROM part), g AS (SELECT [{', '.join(str(int(x)) for x in _GRAM.ravel())}] AS g, '{embedding.RESIDUES}' AS r),
p AS (SELECT a.p_partkey, b.p_partkey AS proto_idx, CASE WHEN length(a.s) >= length(b.s) THEN a.s ELSE b.s END AS x, CASE WHEN length(a.s) >= length(b.s) THEN b.s ELSE a.s END AS y FROM s a JOIN s b ON b.p_partkey < 12),
q AS (SELECT *, length(x) - length(y) AS k, unnest(CASE WHEN length(x) = length(y) THEN [length(y)] ELSE list_transform([3, 4, length(y) - 4, length(y) - 3], lambda p: greatest(0, least(p, length(y)))) END) AS cut FROM p),
c AS (SELECT p_partkey, proto_idx, k, list_sum(list_transform(range(1, length(y) + 1), lambda i: g[(instr(r, x[CASE WHEN i <= cut THEN i ELSE i + k END]) - 1) * 20 + instr(r, y[i])])) AS cost FROM q, g)
SELECT p_partkey, proto_idx, min(cost + CASE WHEN k > 0 THEN 8 + (k - 1) ELSE 0 END)::DOUBLE AS d FROM c GROUP BY 1, 2""")
def gapblock_distance(spark, sf_dir):
    s = junctions(spark, sf_dir).select("p_partkey", "seq")
    protos = s.filter("p_partkey < 12").select(F.col("p_partkey").alias("proto_idx"), "seq")
    out = embedding.sequence_distances(s, protos, "seq", "d")
    return out.select("p_partkey", F.posexplode("d").alias("proto_idx", "d")).select("p_partkey", F.col("proto_idx").cast("long").alias("proto_idx"), F.col("d").cast("double").alias("d"))


@query()
def smith_waterman_distance(spark, sf_dir):
    s = junctions(spark, sf_dir).select("p_partkey", "seq")
    return embedding.sequence_distances(s, s.filter("p_partkey < 8").select(F.col("p_partkey").alias("proto_idx"), "seq"), "seq", "d", alignment="sw")


@query()
def clonotype_embedding(spark, sf_dir):
    j = junctions(spark, sf_dir).select("p_partkey", F.col("p_brand").alias("v_call"), F.col("p_type").alias("j_call"), F.col("seq").alias("junction_aa"))
    genes = [j.select(F.lit(c).alias("component"), allele_with_default(F.regexp_replace(col, " ", "_")).alias("allele"), F.md5(col).alias("seq")).distinct() for c, col in (("V", "v_call"), ("J", "j_call"))]
    distances = embedding.bake_germline(genes[0].unionByName(genes[1]).withColumn("seq", F.upper(F.translate("seq", "0123456789", "ACDEFGHIKL"))))
    j = j.withColumn("j_call", F.regexp_replace("j_call", " ", "_"))
    protos = j.filter("p_partkey < 10").withColumn("proto_idx", F.col("p_partkey"))
    return embedding.clonotype_embed(j, protos, staged(distances, "germline"))


@query(f"""SELECT a.p_partkey, levenshtein(a.s, b.s)::INTEGER AS edits FROM (SELECT p_partkey, {_JUNCTION} AS s FROM part) a JOIN (SELECT p_partkey - 1 AS k, {_JUNCTION} AS s FROM part) b ON a.p_partkey = b.k""")
def levenshtein(spark, sf_dir):
    s = junctions(spark, sf_dir)
    return s.join(s.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("seq").alias("other")), "p_partkey").select("p_partkey", F.levenshtein("seq", "other").alias("edits"))


@query(f"""WITH s AS (SELECT p_partkey, {_DENSE} AS s FROM part)
SELECT a.p_partkey, (count(b.p_partkey))::BIGINT AS n FROM s a LEFT JOIN s b ON length(a.s) = length(b.s) AND hamming(a.s, b.s) = 1 GROUP BY 1""")
def hamming1(spark, sf_dir):
    return strings.one_mismatch_counts(junctions(spark, sf_dir, DENSE), "p_partkey", "seq")


@query(f"""WITH p AS (SELECT {_D2.format('a.embedding', 'b.embedding')} AS d, {_D2.format('a.embedding[1:32]', 'b.embedding[1:32]')} AS e FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT round(corr(sqrt(d), sqrt(e)), 6) AS r, count(*)::BIGINT AS n_pairs FROM p""")
def pairwise_corr(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("half", F.slice("embedding", 1, 32))
    return neighbors.distance_corr(v, "vec_id", "embedding", "half").select(r6("r"), "n_pairs")


# ---- E: fit and transform


@query()
def projection(spark, sf_dir):
    v = vectors(spark, sf_dir)
    b = basis.with_random_features(basis.fit_projection(v, "embedding", 10, key="vec_id"), 1.0, 32, 8)
    return basis.transform(v.select("vec_id", "embedding"), b, "embedding", "z", "f", "f2").drop("embedding")


@query("""WITH x AS (SELECT vec_id, embedding[j]::DOUBLE AS x, j FROM embeddings, range(1, 65) r(j)), s AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1)
SELECT vec_id, round(sum(CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END), 5) AS total FROM x JOIN s USING (j) GROUP BY 1""")
def standardised(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return cohort.zscore(v, "x").select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, y: s + y), 5).alias("total"))


# ---- F: neighbour counts and enrichment

_SIDES = "o AS (SELECT * FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT * FROM embeddings WHERE vec_id % 2 = 1)"
_COUNTS = f"{_SIDES}, no AS (SELECT x.vec_id, count(*)::BIGINT - 1 AS n_obs FROM o x, o y WHERE {_D2.format('x.embedding', 'y.embedding')} <= {RADIUS2} GROUP BY 1), nb AS (SELECT x.vec_id, (count(*) FILTER (WHERE {_D2.format('x.embedding', 'y.embedding')} <= {RADIUS2}))::BIGINT AS n_bg FROM o x, b y GROUP BY 1)"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1")


@query(f"WITH {_COUNTS} SELECT vec_id, n_obs, n_bg FROM no JOIN nb USING (vec_id)")
def ball_counts(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    own = neighbors.ball_counts(o, o, "vec_id", "embedding", RADIUS2, output="n_obs").withColumn("n_obs", F.col("n_obs") - 1)
    return own.join(neighbors.ball_counts(o, b, "vec_id", "embedding", RADIUS2, output="n_bg"), "vec_id")


@query(f"WITH {_COUNTS} SELECT vec_id, n_bg FROM nb")
def ball_counts_indexed(spark, sf_dir):
    """The same through the metric index, in small blocks."""
    o, b = sides(spark, sf_dir)
    return neighbors.ball_counts(o, b, "vec_id", "embedding", RADIUS2, output="n_bg", block=64)


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_D2.format('a.embedding', 'b.embedding')} <= {RADIUS2}""")
def range_pairs(spark, sf_dir):
    return neighbors.pairs_within(vectors(spark, sf_dir), "vec_id", "embedding", RADIUS2).select("a", "b")


@query(f"""WITH {_SIDES}, d AS (SELECT x.vec_id, y.vec_id AS y, {_D2.format('x.embedding', 'y.embedding')} AS d FROM o x, b y), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, y) AS r FROM d)
SELECT vec_id, round(sqrt(d), 6) AS radius FROM k WHERE r = 3""")
def knn_radius(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    return neighbors.nearest(o, b, "vec_id", "embedding", 3).filter("rank = 3").select("vec_id", r6(F.sqrt("d2"), "radius"))


@query(f"""WITH {_SIDES}, d AS (SELECT x.vec_id, y.vec_id AS y, {_D2.format('x.embedding', 'y.embedding')} AS d FROM o x, b y), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, y) AS r FROM d)
SELECT vec_id, y AS neighbor, r::INT AS rank, round(sqrt(d), 6) AS dist FROM k WHERE r <= 5""")
def nearest_indexed(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    return neighbors.nearest(o, b, "vec_id", "embedding", 5, block=64).select("vec_id", "neighbor", "rank", r6(F.sqrt("d2"), "dist"))


_ENRICH = f"""{_COUNTS}, s AS (SELECT (SELECT count(*) FROM o) AS no_, (SELECT count(*) FROM b) AS nb_), e0 AS (SELECT vec_id, n_obs, n_bg, (no_ - 1)::DOUBLE * ((n_bg + 1.0::DOUBLE) / (nb_ + 1.0::DOUBLE)) AS raw FROM no JOIN nb USING (vec_id), s),
c AS (SELECT greatest(median(n_obs) / median(raw), 1.0::DOUBLE) AS c FROM e0 WHERE raw > 0), e AS (SELECT vec_id, n_obs, n_bg, raw * c AS expected FROM e0, c),
t AS (SELECT *, CASE WHEN n_obs <= 0 THEN 1.0::DOUBLE ELSE greatest(0, 1 - coalesce(list_sum(list_transform(range(0, n_obs), lambda i: exp(-expected + i * ln(expected) - lgamma(i + 1)))), 0)) END AS pvalue, n_obs / expected AS fold FROM e)"""


@query(f"WITH {_ENRICH}, q AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY pvalue RANGE UNBOUNDED PRECEDING) AS r FROM t), z AS (SELECT *, min(pvalue * n / r) OVER (ORDER BY pvalue DESC RANGE UNBOUNDED PRECEDING) AS m FROM q) SELECT vec_id, n_obs, n_bg, round(expected, 6) AS expected, round(fold, 6) AS fold, round(pvalue, 6) AS pvalue, round(least(m, 1), 6) AS qvalue, least(m, 1) < 0.9 AND fold > 1 AND n_obs >= 1 AS hit FROM z")
def enrichment(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    e = density.neighbor_enrichment(o, b, "vec_id", "embedding", RADIUS2)
    return e.select("vec_id", "n_obs", "n_bg", r6("expected"), r6("fold"), r6("pvalue"), r6("qvalue"), density.enriched_mask(e, alpha=0.9).alias("hit"))


@query()
def enrichment_weighted(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    return density.neighbor_enrichment(o.withColumn("a", F.col("vec_id") % 7 + 1), b, "vec_id", "embedding", abundance="a")


@query(f"""SELECT x.vec_id, round(sum(ln(1 + (y.vec_id % 7 + 1))) FILTER (WHERE y.vec_id <> x.vec_id AND {_D2.format('x.embedding', 'y.embedding')} <= {RADIUS2}), 6) AS mass FROM embeddings x, embeddings y GROUP BY 1""")
def weighted_mass(spark, sf_dir):
    o = vectors(spark, sf_dir).withColumn("g", F.log1p(F.col("vec_id") % 7 + 1))
    m = neighbors.ball_counts(o, o, "vec_id", "embedding", RADIUS2, weight_col="g", output="m").join(o.select("vec_id", "g"), "vec_id")
    return m.select("vec_id", r6(F.when(F.abs(F.col("m") - F.col("g")) > 1e-9, F.col("m") - F.col("g")), "mass"))


@query(f"""WITH {_CLONES}, s AS (SELECT sample, clone, a, (count(*) OVER (ORDER BY a DESC RANGE UNBOUNDED PRECEDING))::DOUBLE / count(*) OVER () AS p FROM clones)
SELECT sample, clone, round(p, 6) AS p_size, round(exp(ln(p) + ln(0.5::DOUBLE)) * (1 - ln(p) - ln(0.5::DOUBLE)), 6) AS p_fisher FROM s""")
def size_survival(spark, sf_dir):
    s = density.size_survival(clones(spark, sf_dir), "a", "p")
    return s.select("sample", "clone", r6("p", "p_size"), r6(fisher_combine(F.col("p"), F.lit(0.5)), "p_fisher"))


@query("""WITH p AS (SELECT p_partkey, ((p_partkey * 7919) % 1000 + 1) / 20000.0::DOUBLE AS p FROM part), q AS (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM p)
SELECT p_partkey, round(least(1, min(p * n / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM q""")
def false_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (((F.col("p_partkey") * 7919) % 1000 + 1) / F.lit(20000.0)).alias("p"))
    return benjamini_hochberg(p, "p", "q").select("p_partkey", r6("q"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 8 = 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, p_size % 8), lambda i: exp(-m + i * ln(m) - lgamma(i + 1)))) END, 6) AS p FROM (SELECT *, (p_partkey % 13 + 1) / 2.0::DOUBLE AS m FROM part)""")
def poisson(spark, sf_dir):
    n, m = (F.col("p_size") % 8).cast("int"), (F.col("p_partkey") % 13 + 1) / F.lit(2.0)
    return table(spark, sf_dir, "part").select("p_partkey", r6(poisson_tail(n, m), "p"))


@query("""WITH x AS (SELECT p_partkey, 780 + p_partkey % 500 AS n, 750 + p_size AS m FROM part)
SELECT p_partkey, round(log10(list_sum(list_transform(range(n, n + 2500), lambda i: exp(i * ln(m) - m - lgamma(i + 1) + n * 0.0)))), 4) AS log_p FROM x""")
def poisson_far_tail(spark, sf_dir):
    n, m = 780 + F.col("p_partkey") % 500, 750 + F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.log10(poisson_tail(n, m.cast("double"))), 4).alias("log_p"))


# ---- G: clusters


@query("""WITH d AS (SELECT p_partkey, p_brand AS l, CASE WHEN p_size % 6 = 0 THEN -1 ELSE p_size % 6 END AS c FROM part), n AS (SELECT c, l, count(*) AS n FROM d GROUP BY 1, 2),
b AS (SELECT c, l AS says FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, l) AS r FROM n WHERE c <> -1) WHERE r = 1),
t AS (SELECT l, sum(n) AS n, sum(CASE WHEN c <> -1 THEN n ELSE 0 END) AS kept, sum(CASE WHEN says = l THEN n ELSE 0 END) AS tp FROM n LEFT JOIN b USING (c) GROUP BY 1), s AS (SELECT says, sum(n) AS predicted FROM n JOIN b USING (c) GROUP BY 1),
z AS (SELECT l, n, CASE WHEN coalesce(predicted, 0) > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN kept > 0 THEN tp / kept ELSE 0 END AS re, kept / n AS ret FROM t LEFT JOIN s ON l = says)
SELECT l AS label, n::BIGINT AS n, round((CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END)::DOUBLE, 6) AS f1, round(pr::DOUBLE, 6) AS precision, round(re::DOUBLE, 6) AS recall, round(ret::DOUBLE, 6) AS retention FROM z""")
def cluster_metrics(spark, sf_dir):
    c = F.col("p_size") % 6
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("l"), F.when(c == 0, -1).otherwise(c).alias("c"))
    m = cluster.cluster_metrics(d, "c", "l")
    return m.select("label", "n", r6("f1"), r6("precision"), r6("recall"), r6("retention"))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_D2.format('a.embedding', 'b.embedding')} <= 1.3),
core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) + 1 >= 3), e AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
r(id, c) AS (SELECT id, id FROM core UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a AS id, min(c) AS c FROM p JOIN l ON p.b = l.id GROUP BY 1)
SELECT vec_id, coalesce(l.c, n.c, -1)::BIGINT AS cluster FROM embeddings LEFT JOIN l ON vec_id = l.id LEFT JOIN n ON vec_id = n.id""")
def dbscan(spark, sf_dir):
    return cluster.dbscan(vectors(spark, sf_dir), "vec_id", "embedding", eps=float(np.sqrt(1.3)), min_samples=3)


@query(ORACLE_SQL["dbscan"])
def dbscan_indexed(spark, sf_dir):
    """The same through the metric index, in small blocks."""
    return cluster.dbscan(vectors(spark, sf_dir), "vec_id", "embedding", eps=float(np.sqrt(1.3)), min_samples=3, block=128)


@query()
def hdbscan(spark, sf_dir):
    return cluster.cluster(vectors(spark, sf_dir), "vec_id", "embedding", method="hdbscan", min_samples=3, min_cluster_size=5)


# ---- H: samples


@query(f"""WITH {_CLONES}, s AS (SELECT sample, sum(ln(1 + a)) AS g, sum(ln(1 + a) * ln(1 + a)) AS gg, sum(a) AS a FROM clones GROUP BY 1)
SELECT sample, round(ln(1 + a), 6) AS log_mass, round(ln(g * g / gg), 6) AS log_neff, round(gg / (g * g), 6) AS simpson, round(g * g / gg, 6) AS n_eff FROM s""")
def descriptor(spark, sf_dir):
    return repertoire.descriptor(clones(spark, sf_dir), "sample", "a").select("sample", r6("log_mass"), r6("log_neff"), r6("simpson"), r6("n_eff"))


@query(f"""WITH {_CLONES}, f AS (SELECT sample, a / sum(a) OVER (PARTITION BY sample) AS f FROM clones)
SELECT sample, count(*)::DOUBLE AS d0, round(exp(-sum(f * ln(f))), 6) AS d1, round(1 / sum(f * f), 6) AS d2 FROM f GROUP BY 1""")
def hill(spark, sf_dir):
    return repertoire.hill(clones(spark, sf_dir), "sample", "a").select("sample", "d0", r6("d1"), r6("d2"))


@query(f"""WITH {_CLONES}, s AS (SELECT sample, sum(k)::DOUBLE AS n, count(*) FILTER (WHERE k = 1)::DOUBLE AS f1, count(*) FILTER (WHERE k = 2)::DOUBLE AS f2 FROM clones GROUP BY 1)
SELECT sample, round(CASE WHEN f1 = 0 THEN 1 ELSE 1 - f1 / n * ((n - 1) * f1) / ((n - 1) * f1 + 2 * f2) END, 6) AS coverage FROM s""")
def good_turing(spark, sf_dir):
    return repertoire.sample_coverage(clones(spark, sf_dir), "sample", "k").select("sample", r6("coverage"))


@query()
def coverage_hill(spark, sf_dir):
    return repertoire.coverage_hill(clones(spark, sf_dir), "sample", "k", 0.6)


@query(f"WITH {_MEANS} SELECT label, (j - 1)::BIGINT AS j, round(mean[j], 6) AS phi, round(n_eff, 6) AS n_eff FROM m, range(1, 7) r(j)")
def kernel_mean(spark, sf_dir):
    return kernel_means(spark, sf_dir).select("label", "n_eff", F.posexplode("mean").alias("j", "phi")).select("label", F.col("j").cast("long").alias("j"), r6("phi"), r6("n_eff"))


@query(f"""WITH {_FEATURES}, t AS (SELECT label, sum(ln(1 + a)) AS g FROM f GROUP BY 1), p AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS pos FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i <= j)
SELECT label, pos::BIGINT AS pos, round(sum(ln(1 + a) * psi[i] * psi[j] / g), 6) AS v FROM f JOIN t USING (label), p GROUP BY ALL""")
def second_moment(spark, sf_dir):
    e = repertoire.sample_embedding(features(spark, sf_dir), "label", "a", None, "psi", blocks=("second",))
    return e.select("label", F.posexplode("second").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), r6("v"))


@query(f"""WITH {_MEANS} SELECT a.label AS id_a, b.label AS id_b, round(CASE WHEN a.label = b.label THEN 0 ELSE sqrt(greatest(0, {_D2.format('a.mean', 'b.mean')})) END, 6) AS dist FROM m a, m b""")
def mmd_biased(spark, sf_dir):
    return repertoire.mmd_matrix(kernel_means(spark, sf_dir), "label").select("id_a", "id_b", r6("dist"))


@query(f"""WITH {_MEANS}, h AS (SELECT label, mean, ({_DOT.format('mean', 'mean')} - 1 / n_eff) / (1 - 1 / n_eff) AS h FROM m)
SELECT a.label AS id_a, b.label AS id_b, round(CASE WHEN a.label = b.label THEN 0 ELSE sqrt(greatest(0, a.h + b.h - 2 * {_DOT.format('a.mean', 'b.mean')})) END, 6) AS dist FROM h a, h b""")
def mmd_unbiased(spark, sf_dir):
    return repertoire.mmd_matrix(kernel_means(spark, sf_dir), "label", unbiased=True).select("id_a", "id_b", r6("dist"))


@query(f"""WITH {_MEANS}, h AS (SELECT label, mean, list_transform(range(0, label % 3), lambda i: (label + i) % 4) AS al FROM m)
SELECT a.label AS id_a, b.label AS id_b, round(CASE WHEN list_has_any(a.al, b.al) THEN CASE WHEN a.label = b.label THEN 0 ELSE sqrt(greatest(0, {_D2.format('a.mean', 'b.mean')})) END END, 6) AS dist FROM h a, h b""")
def hla_mmd(spark, sf_dir):
    al = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("label") % 3), lambda i: (F.col("label") + i) % 4)
    d = repertoire.stratified_mmd(kernel_means(spark, sf_dir).withColumn("al", al), "label", "al")
    return d.select("id_a", "id_b", r6(F.nanvl("dist", F.lit(None).cast("double")), "dist"))


@query(f"""WITH {_MEANS}, w AS (SELECT list(x ORDER BY j) AS w FROM (SELECT j, avg(mean[j]) FILTER (WHERE label < 5) - avg(mean[j]) FILTER (WHERE label >= 5) AS x FROM m, range(1, 7) r(j) GROUP BY 1))
SELECT vec_id, round({_DOT.format('psi', 'w')}, 6) AS score FROM f, w ORDER BY {_DOT.format('psi', 'w')} DESC, vec_id LIMIT 30""")
def witness_topk(spark, sf_dir):
    m = staged(kernel_means(spark, sf_dir), "means")
    w = repertoire.witness(m.filter("label < 5"), m.filter("label >= 5"))
    return repertoire.class_witness(features(spark, sf_dir), "psi", "vec_id", w, 30).select("vec_id", r6("score"))


@query(f"""WITH {_FEATURES}, c0 AS (SELECT label, j, avg(psi[j]) AS x FROM f, range(1, 7) r(j) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY j) AS c FROM c0 GROUP BY 1)
SELECT vec_id, label, round(1 - {_DOT.format('psi', 'c')} / ((sqrt({_DOT.format('psi', 'psi')}) + 1e-9::DOUBLE) * (sqrt({_DOT.format('c', 'c')}) + 1e-9::DOUBLE)), 6) AS atypicality FROM f JOIN c USING (label)""")
def atypicality(spark, sf_dir):
    return repertoire.centroid_atypicality(features(spark, sf_dir), "vec_id", "label", "psi").select("vec_id", "label", r6("atypicality"))


@query(f"""WITH s AS (SELECT p_brand AS brand, {_JUNCTION} AS s, p_size AS w FROM part), k AS (SELECT brand, substr(s, i, 3) AS kmer, sum(w) AS c FROM s, range(1, 13) r(i) WHERE i <= length(s) - 2 GROUP BY 1, 2)
SELECT brand, kmer, round(c::DOUBLE / sum(c) OVER (PARTITION BY brand), 6) AS frequency FROM k""")
def kmer_profile(spark, sf_dir):
    j = junctions(spark, sf_dir).withColumnRenamed("p_brand", "brand")
    return repertoire.kmer_profile(j, "brand", "seq", 3, "p_size").select("brand", "kmer", r6("frequency"))


# ---- I, J: cohorts and channels


@query("""WITH x AS (SELECT vec_id, label, embedding[j]::DOUBLE AS x, j FROM embeddings, range(1, 65) r(j)), m AS (SELECT label, j, avg(x) AS m FROM x GROUP BY 1, 2)
SELECT vec_id, round(sum((x - m) * j), 5) AS total FROM x JOIN m USING (label, j) GROUP BY 1""")
def residualize(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    out = cohort.residualize(v, "x", "label")
    return out.select("vec_id", F.round(F.aggregate(F.transform("x", lambda y, i: y * (i + 1)), F.lit(0.0), lambda s, y: s + y), 5).alias("total"))


@query("""WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS a, c_nationkey::DOUBLE AS b FROM customer), m AS (SELECT median(a) AS m FROM x), y AS (SELECT k, coalesce(a, m) AS a, b FROM x, m),
s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM y) SELECT k, round((a - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b FROM y, s""")
def impute_zscore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))).alias("a"), F.array(F.col("c_nationkey").cast("double")).alias("b"))
    x, _ = cohort.ChannelBuilder(c, "k").add("a", c, "a", 1).add("b", c, "b", 1).build()
    return x.select("k", r6(F.col("x")[0], "a"), r6(F.col("x")[1], "b"))


@query()
def correct_batch(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") % 3).alias("batch"), F.col("embedding").cast("array<double>").alias("x"))
    return cohort.correct_batch(v, "vec_id", "x", "batch", n_clusters=4)


@query()
def channel_report(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", (F.col("label") < 5).alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    spec = cohort.ChannelSpec({"first": [0, 1], "second": [2, 3, 4]}, frozenset({"first"}))

    def scorer(df: DataFrame, columns: list[int]) -> float:
        return evaluate.roc_auc(df.withColumn("s", sum((F.col("x")[c] for c in columns), F.lit(0.0))), "s", "y").first()[0]

    return cohort.channel_report(v, spec, scorer, base=0.5, mode="both")


@query()
def donor_fusion(spark, sf_dir):
    cloud = features(spark, sf_dir).withColumn("donor", F.col("vec_id") % 12).withColumn("locus", F.when(F.col("label") < 5, "TRA").otherwise("TRB"))
    args = (cloud.select("donor").distinct(), "donor", "locus", "a", "psi")
    return cohort.fit_donors(cloud, *args, ["TRA", "TRB"], id_pca=3).transform(cloud, *args)


@query(ORACLE_SQL["witness_topk"].replace("SELECT vec_id, round(", "SELECT 'identity' AS channel, vec_id, round("))
def channel_drivers(spark, sf_dir):
    m = staged(kernel_means(spark, sf_dir), "means")
    spec = cohort.ChannelSpec({"identity": [0, 1]}, frozenset({"identity"}))
    drivers = cohort.channel_drivers(spec, "identity", m.filter("label < 5"), m.filter("label >= 5"), features(spark, sf_dir), "psi", "vec_id")
    return drivers.select("channel", "vec_id", r6("score"))


_INCIDENCE = "i AS (SELECT DISTINCT l_partkey AS part, o_custkey AS cust, c_mktsegment = 'BUILDING' AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {_INCIDENCE}, t AS (SELECT count(DISTINCT cust) FILTER (WHERE pos) AS p, count(DISTINCT cust) FILTER (WHERE NOT pos) AS n FROM i), c AS (SELECT part, count(*) FILTER (WHERE pos) AS a, count(*) FILTER (WHERE NOT pos) AS b FROM i GROUP BY 1)
SELECT part, a::BIGINT AS n_pos, b::BIGINT AS n_neg, round((a + 0.5::DOUBLE) * (n - b + 0.5::DOUBLE) / ((p - a + 0.5::DOUBLE) * (b + 0.5::DOUBLE)), 6) AS odds_ratio FROM c, t WHERE a + b >= 3""")
def incidence(spark, sf_dir):
    i = _incidence(spark, sf_dir)
    return cohort.incidence_biomarkers(i, "part", "cust", "pos").select("part", "n_pos", "n_neg", r6("odds_ratio"))


def _incidence(spark, sf_dir):
    l, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("l_partkey").alias("part"), F.col("o_custkey").alias("cust"), (F.col("c_mktsegment") == "BUILDING").alias("pos"))


_HYPER = "exp(lgamma(p + 1) - lgamma({0} + 1) - lgamma(p - {0} + 1) + lgamma(n + 1) - lgamma(k - {0} + 1) - lgamma(n - k + {0} + 1) - lgamma(p + n + 1) + lgamma(k + 1) + lgamma(p + n - k + 1))"


@query(f"""WITH {_INCIDENCE}, t AS (SELECT count(DISTINCT cust) FILTER (WHERE pos) AS p, count(DISTINCT cust) FILTER (WHERE NOT pos) AS n FROM i), c AS (SELECT part, count(*) FILTER (WHERE pos) AS a, count(*) AS k FROM i GROUP BY 1 HAVING count(*) >= 3),
u AS (SELECT DISTINCT a, k, p, n FROM c, t), x AS (SELECT a, k, {_HYPER.format('a')} AS own, {_HYPER.format('j')} AS other FROM (SELECT *, unnest(range(greatest(0, k - n), least(p, k) + 1)) AS j FROM u)),
f AS (SELECT a, k, least(1, sum(other) FILTER (WHERE other <= own * (1 + 1e-7::DOUBLE)) / sum(other)) AS pvalue FROM x GROUP BY 1, 2),
q AS (SELECT part, pvalue, count(*) OVER () AS m, count(*) OVER (ORDER BY round(pvalue, 12) RANGE UNBOUNDED PRECEDING) AS r FROM c JOIN f USING (a, k))
SELECT part, round(pvalue, 6) AS pvalue, round(least(1, min(pvalue * m / r) OVER (ORDER BY round(pvalue, 12) DESC RANGE UNBOUNDED PRECEDING)), 5) AS qvalue FROM q""")
def incidence_fisher(spark, sf_dir):
    out = cohort.incidence_biomarkers(_incidence(spark, sf_dir), "part", "cust", "pos")
    return out.select("part", r6("pvalue"), F.round("qvalue", 5).alias("qvalue"))


@query()
def incidence_one_mismatch(spark, sf_dir):
    j = junctions(spark, sf_dir, DENSE).select("p_partkey", "seq")
    i = _incidence(spark, sf_dir).join(j, F.col("part") == F.col("p_partkey"))
    return cohort.incidence_biomarkers(i, "seq", "cust", "pos", match="1mm")


@query()
def ann_nearest(spark, sf_dir):
    """The ten nearest of every vector that a few cells hold."""
    v = vectors(spark, sf_dir)
    return neighbors.nearest(v, v, "vec_id", "embedding", 10, skip_self=True, block=128, backend="ann")


@query(f"""WITH s AS (SELECT p_brand AS brand, {_JUNCTION} AS s FROM part), k AS (SELECT brand, substr(s, i, 1) AS kmer, count(*) AS c FROM s, range(1, 40) r(i) WHERE i <= length(s) GROUP BY 1, 2),
t AS (SELECT brand, sum(c) AS t FROM k GROUP BY 1), w AS (SELECT DISTINCT kmer FROM k), a AS (SELECT brand, kmer, coalesce(c, 0) / t AS f, row_number() OVER (PARTITION BY brand ORDER BY kmer) AS j FROM t CROSS JOIN w LEFT JOIN k USING (brand, kmer))
SELECT brand, count(*)::INT AS width, round(sum(f * j), 6) AS total FROM a GROUP BY 1""")
def kmer_matrix_query(spark, sf_dir):
    m, words = repertoire.kmer_matrix(junctions(spark, sf_dir).withColumnRenamed("p_brand", "brand"), "brand", "seq", 1)
    return m.select("brand", F.size("x").alias("width"), r6(F.aggregate(F.transform("x", lambda y, i: y * (i + 1)), F.lit(0.0), lambda s, y: s + y), "total"))


@query()
def ann_counts(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    return neighbors.ann_ball_counts(o, b, "vec_id", "embedding", RADIUS2)


# ---- K: scorers and survival


@query("""WITH x AS (SELECT floor(o_totalprice / 1000) AS s, o_orderstatus = 'F' AS y FROM orders), g AS (SELECT s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM x GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM g)
SELECT round((sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc FROM c""")
def auc(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 1000).alias("s"), (F.col("o_orderstatus") == "F").alias("y"))
    return evaluate.roc_auc(o, "s", "y").select(r6("auc"))


@query("""WITH x AS (SELECT floor(c_acctbal / 500) AS a, c_nationkey AS b FROM customer), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x) SELECT round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_acctbal") / 500).alias("a"), F.col("c_nationkey").alias("b"))
    return evaluate.spearman(c, "a", "b").select(r6("rho"))


_SURVIVAL = "v AS (SELECT l_orderkey * 10 + l_linenumber AS id, abs(date_diff('day', o_orderdate, l_shipdate)) + 1 AS t, l_returnflag = 'R' AS e, l_quantity AS r, l_linestatus || l_returnflag AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def survival(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.abs(F.datediff("l_shipdate", "o_orderdate")) + 1).alias("t"), (F.col("l_returnflag") == "R").alias("e"), F.col("l_quantity").alias("r"), F.concat("l_linestatus", F.lit("")).alias("g"))


@query(f"""WITH {_SURVIVAL}, g AS (SELECT t, e, r, count(*) AS c FROM v GROUP BY 1, 2, 3), p AS (SELECT a.c * b.c AS w, a.r AS ra, b.r AS rb FROM g a JOIN g b ON a.e AND (a.t < b.t OR (a.t = b.t AND NOT b.e)))
SELECT sum(CASE WHEN ra > rb THEN w ELSE 0 END)::BIGINT AS concordant, sum(CASE WHEN ra = rb THEN w ELSE 0 END)::BIGINT AS tied, sum(w)::BIGINT AS comparable, round(((sum(CASE WHEN ra > rb THEN w ELSE 0 END) + sum(CASE WHEN ra = rb THEN w ELSE 0 END) / 2.0::DOUBLE) / sum(w))::DOUBLE, 6) AS cindex FROM p""")
def concordance(spark, sf_dir):
    return evaluate.concordance(survival(spark, sf_dir), "t", "e", "r", "id").withColumn("cindex", F.round("cindex", 6))


@query(f"""WITH {_SURVIVAL.replace("l_linestatus || l_returnflag", "l_linestatus")}, c AS (SELECT t, g, count(*) AS n, count(*) FILTER (WHERE e) AS d FROM v GROUP BY 1, 2), x AS (SELECT t, g, coalesce(n, 0) AS n, coalesce(d, 0) AS d FROM (SELECT DISTINCT t FROM c) CROSS JOIN (SELECT DISTINCT g FROM c) LEFT JOIN c USING (t, g)),
k AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS risk FROM x), y AS (SELECT t, sum(d) AS dt, sum(risk) AS rt FROM k GROUP BY 1)
SELECT g AS "group", sum(d)::BIGINT AS observed, round(sum(CASE WHEN rt > 0 THEN dt * risk / rt ELSE 0 END)::DOUBLE, 6) AS expected FROM k JOIN y USING (t) GROUP BY 1""")
def logrank_table(spark, sf_dir):
    return evaluate.logrank_table(survival(spark, sf_dir), "t", "e", "g").select("group", "observed", r6("expected"))


_LOGRANK = f"""WITH {_SURVIVAL.replace("l_linestatus || l_returnflag", "l_linestatus")}, c AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE e) AS d, count(*) FILTER (WHERE g = 'F') AS nf, count(*) FILTER (WHERE e AND g = 'F') AS df FROM v GROUP BY 1),
k AS (SELECT d, df, (sum(n) OVER (ORDER BY t DESC))::DOUBLE AS r, (sum(nf) OVER (ORDER BY t DESC))::DOUBLE AS rf FROM c),
u AS (SELECT sum(df - d * rf / r) AS u, sum(CASE WHEN r > 1 THEN d * (rf / r) * (1 - rf / r) * (r - d) / (r - 1) ELSE 0 END) AS w FROM k WHERE d > 0)"""


@query(f"""{_LOGRANK}
SELECT round(u * u / w, 4) AS statistic FROM u""")
def logrank(spark, sf_dir):
    return evaluate.logrank(survival(spark, sf_dir), "t", "e", "g").select(F.round("statistic", 4).alias("statistic"))


@query(f"""{_LOGRANK}, p AS (SELECT u * u / w AS x, least(u * u / w, 200) / 2 AS y FROM u)
SELECT round(x, 4) AS statistic, round(greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda i: exp((i + 0.5::DOUBLE) * ln(y) - y - lgamma(i + 1.5::DOUBLE))))), 6) AS pvalue FROM p""")
def logrank_pvalue(spark, sf_dir):
    return evaluate.logrank(survival(spark, sf_dir), "t", "e", "g").select(F.round("statistic", 4).alias("statistic"), r6("pvalue"))


@query()
def cox(spark, sf_dir):
    s = survival(spark, sf_dir).withColumn("x", F.array((F.col("r") - 25) / 14, (F.col("g") == "F").cast("double")))
    beta = evaluate.cox_fit(s, "t", "e", "x")
    return spark.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "j int, beta double")


@query("""WITH a AS (SELECT DISTINCT p_brand AS brand, l_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT p_brand AS brand, l_partkey AS part FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O')
SELECT coalesce(a.brand, b.brand) AS brand, count(*) FILTER (WHERE a.part IS NOT NULL AND b.part IS NOT NULL)::BIGINT AS n_both, count(*) FILTER (WHERE b.part IS NULL)::BIGINT AS n_only_a, count(*) FILTER (WHERE a.part IS NULL)::BIGINT AS n_only_b, count(a.part) > 0 AND count(b.part) > 0 AS in_both
FROM a FULL JOIN b ON a.brand = b.brand AND a.part = b.part GROUP BY 1""")
def library_consistency_query(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_partkey").alias("part"), "l_linestatus")
    return library_consistency(j.filter("l_linestatus = 'F'"), j.filter("l_linestatus = 'O'"), ["brand"], "part")


@query("""SELECT 'x' AS species, p_type AS locus, p_brand AS gene, count(*)::BIGINT AS n_alleles, count(*) FILTER (WHERE p_size % 3 = 1)::BIGINT AS n_major FROM part GROUP BY ALL""")
def allele_counts_query(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("x").alias("species"), F.col("p_type").alias("locus"), F.col("p_brand").alias("gene"), F.concat("p_brand", F.lit("*0"), (F.col("p_size") % 3).cast("string")).alias("allele"))
    return allele_counts(p)


@query()
def fit_distributions(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p = v.join(F.broadcast(v.filter("vec_id < 16").select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))), F.col("vec_id") > F.col("b"))
    return spark.createDataFrame(evaluate.fit_distributions(p.select(l2sq("embedding", "eb").alias("d")), "d"))


@query(f"""WITH c AS (SELECT p_partkey AS k, {_DENSE} AS s, {_JUNCTION} AS r FROM part), o AS (SELECT s, max(k) AS k FROM c GROUP BY 1), x AS (SELECT o.s, c.r, (o.k % 500)::DOUBLE AS v FROM o JOIN c USING (k)), h AS (SELECT v FROM x GROUP BY 1 HAVING count(*) > 1)
SELECT count(*)::BIGINT AS n, round(avg((v IN (SELECT v FROM h))::INTEGER), 6) AS collision_rate, round(1 - avg((v IN (SELECT v FROM h))::INTEGER), 6) AS ceiling, round(avg((s = r)::INTEGER), 6) AS exact_match, round(avg(levenshtein(s, r)), 6) AS mean_edit FROM x""")
def codec_losslessness(spark, sf_dir):
    s = junctions(spark, sf_dir, DENSE).join(junctions(spark, sf_dir).select("p_partkey", F.col("seq").alias("recon")), "p_partkey").withColumn("code", F.array((F.col("p_partkey") % 500).cast("double")))
    out = evaluate.codec_losslessness(s, "p_partkey", "seq", "code", "recon", eps=1e-3)
    return out.select("n", *[r6(c) for c in ("collision_rate", "ceiling", "exact_match", "mean_edit")])


_FRAME = "substr({0}, 1, 4) || rpad(substr({0}, 5, least(length({0}) - 7, 33)), 33, '-') || right({0}, 3)"


@query(f"""WITH o AS (SELECT DISTINCT {_JUNCTION} AS s FROM part), x AS (SELECT s, 'CA' || substr(s, 3) AS r FROM o), f AS (SELECT {_FRAME.format('s')} AS a, {_FRAME.format('r')} AS b FROM x),
p AS (SELECT i, avg((substr(a, i, 1) = substr(b, i, 1))::INTEGER) AS same FROM f, range(1, 41) t(i) GROUP BY 1)
SELECT (SELECT count(*) FROM x)::BIGINT AS n, round((SELECT avg((s = r)::INTEGER) FROM x), 6) AS exact_match, round(avg(same), 6) AS token_acc, round(avg(same) FILTER (WHERE i <= 4 OR i > 37), 6) AS anchor_acc, round(avg(same) FILTER (WHERE i > 4 AND i <= 37), 6) AS middle_acc FROM p""")
def token_accuracy(spark, sf_dir):
    s = junctions(spark, sf_dir).withColumn("code", F.array(F.col("p_partkey").cast("double"))).withColumn("recon", F.concat(F.lit("CA"), F.expr("substring(seq, 3)")))
    out = evaluate.codec_losslessness(s, "p_partkey", "seq", "code", "recon", eps=1e-3)
    return out.select("n", *[r6(c) for c in ("exact_match", "token_acc", "anchor_acc", "middle_acc")])


@query()
def density_space(spark, sf_dir):
    o, b = sides(spark, sf_dir)
    _, z, _ = basis.fit_density_space(o.select("vec_id", "embedding"), b.select("vec_id", "embedding"), "embedding", 10)
    return z.drop("embedding")


@query()
def embedding_distance_correlation(spark, sf_dir):
    s = junctions(spark, sf_dir)
    return theory.distance_correlation(s, "p_partkey", "seq", s.filter("p_partkey < 300"))


@query()
def mutation_drift(spark, sf_dir):
    s = junctions(spark, sf_dir)
    return theory.mutation_drift(s, s.filter("p_partkey < 50").withColumn("proto_idx", F.col("p_partkey")), "seq", 4, 2)


@query()
def neighbour_convergence(spark, sf_dir):
    s = junctions(spark, sf_dir, DENSE)
    return theory.neighbour_convergence(s, s.filter("p_partkey < 100").withColumn("proto_idx", F.col("p_partkey")), "p_partkey", "seq", 10)


# ---- L: networks on sequences


def _taught(spark, sf_dir, n_protos: int = 48):
    """Sequences of parts with their distances to a few of them, ``embedding``."""
    s = junctions(spark, sf_dir).select("p_partkey", F.col("seq").alias("junction_aa"))
    protos = s.filter(F.col("p_partkey") <= n_protos).withColumn("proto_idx", F.col("p_partkey"))
    return embedding.sequence_distances(spread(s), protos, output="embedding")


@query()
def sequence_regressor(spark, sf_dir):
    """Length and share of a letter class, learned from the sequence alone; ``test`` rows were not learned from."""
    s = spread(junctions(spark, sf_dir).select("p_partkey", "seq"))
    s = s.withColumn("label", -F.length("seq") + F.length(F.regexp_replace("seq", "[^DEKR]", "")) / 2.0)
    m = sequences.train_regressor(s, "p_partkey", "seq", "label", rounds=40)
    test = F.pmod(F.xxhash64(F.lit(0), F.lit("split"), "p_partkey"), F.lit(10)) == 9
    return m.predict(s, "seq").select("p_partkey", "label", "predicted", test.alias("test"))


@query()
def sequence_encoder(spark, sf_dir):
    """How near the encoder's vectors come to the distances that they stand for, as a cosine of each row."""
    s = staged(_taught(spark, sf_dir), "taught")
    m = sequences.train_encoder(s, "p_partkey", "junction_aa", "embedding", rounds=40)
    out = m.encode(s, "junction_aa", "_e")
    size = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x), F.lit(0.0), lambda t, x: t + x))
    near = F.aggregate(F.zip_with("_e", "embedding", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) / (size("_e") * size("embedding"))
    return out.select("p_partkey", near.alias("cosine"))


@query()
def sequence_codec(spark, sf_dir):
    """What comes back of every sequence from its code, scored by place."""
    s = staged(_taught(spark, sf_dir), "taught")
    m = sequences.train_codec(s, "p_partkey", "junction_aa", "embedding", rounds=60)
    back = m.decode(m.code(s, "junction_aa"), "code")
    return evaluate.reconstruction(back, "p_partkey", "junction_aa", "recon").select("n", "exact_match", "token_acc", "anchor_acc", "middle_acc")


@query()
def set_encoder(spark, sf_dir):
    """Customers as samples of the parts they bought: the share of small ones, learned from the cloud alone; ``apart`` samples were not learned from."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("a"))
    size = F.col("p_size") / 50.0
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(size, size * size, F.col("p_retailprice").cast("double") / 1000, F.lit(1.0)).alias("z"))
    c = staged(a.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "z", "a", "p_size"), "clouds")
    y = staged(c.groupBy("o_custkey").agg((F.sum(F.when(F.col("p_size") <= 15, F.col("a")).otherwise(0.0)) / F.sum("a")).alias("label")), "labels")
    m = sets.train_set_encoder(c, y, "o_custkey", "z", "a", "label", rounds=16, every=8, hidden=16, queries=4, rate=1e-2)
    return m.predict(c, "o_custkey", "z", "a").join(y, "o_custkey").select("o_custkey", "label", "predicted", sets.held_out(F.col("o_custkey"), 0.2).alias("apart"))


# ---- A-07 and the stream


def _records(spark, sf_dir):
    return junctions(spark, sf_dir).select(F.col("p_brand").alias("v_call"), F.col("p_type").alias("j_call"), F.col("seq").alias("junction_aa"))


@query(f"""WITH r AS (SELECT p_brand AS v, p_type AS j, {_JUNCTION} AS s FROM part), x AS (
SELECT 'genes' AS kind, v AS a, j AS b FROM r UNION ALL SELECT 'length', length(s)::VARCHAR, NULL FROM r UNION ALL SELECT 'first', NULL, left(s, 1) FROM r UNION ALL SELECT 'last', NULL, right(s, 1) FROM r
UNION ALL SELECT 'next', substr(s, i, 1), substr(s, i + 1, 1) FROM r, range(1, 40) t(i) WHERE i < length(s) - 1)
SELECT kind, a, b, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def background_model(spark, sf_dir):
    return generator_counts(_records(spark, sf_dir))


@query()
def background(spark, sf_dir):
    """As many records as the table has, drawn from the model that it teaches."""
    own = _records(spark, sf_dir)
    return generate_records(spark, learn_generator(own), own.count())


@query("""WITH c AS (SELECT date_trunc('hour', ts) AS window_start, user_id, event_type, count(*) AS a FROM events GROUP BY ALL)
SELECT window_start, user_id, count(*)::BIGINT AS n_items, round(sum(ln(1 + a)) * sum(ln(1 + a)) / sum(ln(1 + a) * ln(1 + a)), 6) AS n_eff FROM c GROUP BY ALL""")
def windowed_neff(spark, sf_dir):
    return windowed_descriptor(table(spark, sf_dir, "events"), "ts", "user_id", "event_type").withColumn("n_eff", F.round("n_eff", 6))
