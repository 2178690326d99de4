"""Reading and writing tables of receptors, labels, prototypes and gene libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plexivec.functions.names import CANONICAL, allele_to_major, allele_with_default, strip_allele, with_locus
from plexivec.functions.vectors import require_columns

CLONOTYPE = ("v_call", "j_call", "junction_aa", "duplicate_count", "locus")
# The columns that other formats use for ours.
RENAMES = {
    "v": "v_call", "j": "j_call", "d": "d_call", "cdr3aa": "junction_aa", "cdr3nt": "junction", "count": "duplicate_count", "freq": "frequency",
    "allVHitsWithScore": "v_call", "allJHitsWithScore": "j_call", "aaSeqCDR3": "junction_aa", "nSeqCDR3": "junction", "cloneCount": "duplicate_count", "readCount": "duplicate_count",
    "vGeneName": "v_call", "jGeneName": "j_call", "aminoAcid": "junction_aa", "v_gene": "v_call", "j_gene": "j_call", "cdr3_amino_acid": "junction_aa", "templates": "duplicate_count",
}


def sample_id(path: Column) -> Column:
    """The base name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def read_clonotypes(spark: SparkSession, path: str) -> DataFrame:
    """Clonotypes of a Parquet or delimited file (gzip too), named by our columns, with ``sample_id`` and ``locus``.

    The format is told by the header.  Hit lists keep their first gene; counts become long, absent ones 1.
    Other columns stay as they are.
    """
    if ".parquet" in path:
        raw = spark.read.parquet(path)
    else:
        head = spark.read.text(path).first()
        sep = "\t" if head and "\t" in head[0] else ","
        raw = spark.read.csv(path, sep=sep, header=True)
    seen: set[str] = set()
    cols = []
    for c in raw.columns:
        name = RENAMES.get(c, c)
        if name in seen or (name != c and name in raw.columns):
            name = c
        seen.add(name)
        cols.append(F.col(f"`{c}`").alias(name))
    df = raw.select(*cols)
    require_columns(df, ["v_call", "j_call", "junction_aa"])
    for c in ("v_call", "j_call"):
        df = df.withColumn(c, F.regexp_extract(F.col(c), r"^\s*([^,;(\s]+)", 1))
    count = F.coalesce(F.col("duplicate_count").cast("double").cast("long"), F.lit(1)) if "duplicate_count" in df.columns else F.lit(1).cast("long")
    locus = F.col("locus") if "locus" in df.columns else F.lit(None).cast("string")
    return df.withColumn("duplicate_count", count).withColumn("locus", with_locus(locus, F.col("v_call"))).withColumn("sample_id", sample_id(F.input_file_name()))


def pick_locus(df: DataFrame, requested: str | None = None) -> str:
    """The locus asked for, or the only one there is; ValueError that lists several or none."""
    if requested:
        return requested
    found = sorted(r[0] for r in df.filter("locus <> ''").select("locus").distinct().collect())
    if len(found) != 1:
        raise ValueError(f"choose one locus of {found}")
    return found[0]


def write_table(df: DataFrame, path: str | None) -> None:
    """Parquet for a path that ends with it, tab-separated text for others, standard output for none or ``-``."""
    if path in (None, "-"):
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
    elif path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, sep="\t", header=True)


def exploded(df: DataFrame, vector: str, width: int, prefix: str) -> DataFrame:
    """``df`` with the vector as columns ``prefix0`` and on."""
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(f"{prefix}{i}") for i in range(width)])


def load_prototypes(spark: SparkSession, path: str, n: int | None = None, most: int = 10_000) -> DataFrame:
    """The first ``n`` prototypes of a tab-separated file in file order, or all: ``proto_idx, v_call, j_call, junction_aa``.

    A set has at most ``most`` prototypes; ValueError for a longer file of which no ``n`` is named, and for one
    with fewer than ``n``.  The file is read as one partition, so that its order is kept.
    """
    if n is not None and not 1 <= n <= most:
        raise ValueError(f"n must be in 1 .. {most}")
    raw = spark.read.csv(path, sep="\t", header=True).coalesce(1)
    rows = raw.select((F.monotonically_increasing_id()).alias("proto_idx"), "v_call", "j_call", "junction_aa")
    found = rows.limit(most + 1).count()
    if n is None and found > most:
        raise ValueError(f"more than {most} prototypes in {path}; name how many")
    if n is not None and found < n:
        raise ValueError(f"only {found} prototypes in {path}")
    return rows if n is None else rows.filter(F.col("proto_idx") < n)


def list_available_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    """``species, locus, path`` of the prototype files ``<species>_<locus>.tsv`` (or gzip) of a folder, in order of species and locus."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.tsv*").load(folder).select("path")
    name = lambda k: F.regexp_extract("path", r"([^/_]+)_([^/_.]+)\.tsv(?:\.gz)?$", k)
    return files.select(name(1).alias("species"), name(2).alias("locus"), "path").filter("species <> ''").orderBy("species", "locus")


def resource_path(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a resource below a folder; FileNotFoundError if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(where.toString())
    return where.toString()


def make_prototypes(df: DataFrame, known: DataFrame | None = None, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Prototypes from a pool: canonical junctions, distinct, genes that resolve, ``n`` of them by a seeded hash."""
    pool = df.filter(F.col("junction_aa").rlike(CANONICAL)).select("v_call", "j_call", "junction_aa").distinct()
    if known is not None:
        alleles = known.select(F.col("allele").alias("_allele")).distinct()
        for c in ("v_call", "j_call"):  # the allele itself, allele 01, or the bare gene
            tries = F.array_distinct(F.array(allele_with_default(F.col("_gene")), allele_to_major(F.col("_gene")), strip_allele(F.col("_gene"))))
            genes = pool.select(F.col(c).alias("_gene")).distinct().withColumn("_allele", F.explode(tries))
            pool = pool.join(genes.join(alleles, "_allele", "left_semi").select(F.col("_gene").alias(c)).distinct(), c, "left_semi")
    chosen = pool.orderBy(F.xxhash64(F.lit(seed), "junction_aa", "v_call", "j_call"), "junction_aa", "v_call", "j_call").limit(n)
    order = W.orderBy(F.xxhash64(F.lit(seed), "junction_aa", "v_call", "j_call"), "junction_aa", "v_call", "j_call")
    return chosen.withColumn("proto_idx", F.row_number().over(order) - 1)


def load_labels(df: DataFrame) -> DataFrame:
    """A label table of strings with our names: rows with a sequence of 5 or more, genes and a label, distinct.

    ``mhc_class`` is not part of the key; the smallest of a duplicate group is taken.
    """
    names = {"cdr3": "junction_aa", "v.segm": "v_call", "j.segm": "j_call", "gene": "chain", "antigen.epitope": "epitope", "mhc.class": "mhc_class"}
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in names.items()])
    keys = ["junction_aa", "v_call", "j_call", "chain", "epitope"]
    ok = rows.filter(F.length("junction_aa") >= 5).dropna(subset=["v_call", "j_call", "epitope"])
    return ok.groupBy(*keys).agg(F.min("mhc_class").alias("mhc_class"))


def antigen_subset(df: DataFrame, chain: str, min_records: int, label: str = "epitope", chain_col: str = "chain") -> DataFrame:
    """Rows of a chain whose label has at least ``min_records`` rows of it."""
    own = df.filter(F.col(chain_col) == chain)
    return own.join(own.groupBy(label).count().filter(F.col("count") >= min_records).select(label), label, "left_semi")


def generate_background(spark: SparkSession, n: int, genes: tuple[list[str], list[str]], seed: int = 0, lengths: tuple[int, int] = (8, 16)) -> DataFrame:
    """``n`` synthetic records ``row_id, v_call, j_call, junction_aa`` from a seeded hash; no claim of biology."""
    pick = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(n)).cast("int")
    v, j = (F.array(*map(F.lit, g)) for g in genes)
    size = pick("length", lengths[1] - lengths[0] + 1) + lengths[0] - 2
    letters = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(20)).cast("int") + 1, F.lit(1)))
    return spark.range(n).select(F.col("id").alias("row_id"), v[pick("v", len(genes[0]))].alias("v_call"), j[pick("j", len(genes[1]))].alias("j_call"), F.concat(F.lit("C"), F.array_join(letters, ""), F.lit("F")).alias("junction_aa"))


def region_annotations(df: DataFrame) -> DataFrame:
    """One row for each V gene (its first regions by allele) and J gene (the common suffix of its junctions)."""
    v = df.groupBy("species", "locus", F.col("v_call").alias("gene")).agg(*[F.min_by(c, "row_id").alias(c) for c in ("fwr1_aa", "cdr1_aa", "fwr2_aa", "cdr2_aa", "fwr3_aa")])
    back = F.reverse(F.when(F.length("junction_aa") > 0, F.col("junction_aa")))
    # what the first and the last of the reversed junctions share at the front, all share at the end
    ends = df.groupBy("species", "locus", F.col("j_call").alias("gene")).agg(F.min(back).alias("_low"), F.max(back).alias("_high"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("_low"), F.length("_high"))), lambda n: F.left("_low", n) == F.left("_high", n))
    suffix = F.coalesce(F.reverse(F.expr("left(_low, _n)")), F.lit(""))
    j = ends.withColumn("_n", F.array_max(same)).withColumn("jcdr3_aa", F.substring_index(suffix, "X", -1)).drop("_low", "_high", "_n")
    return v.unionByName(j, allowMissingColumns=True)


def allele_counts(library: DataFrame) -> DataFrame:
    """``species, locus, gene, n_alleles, n_major`` of a gene library."""
    return library.groupBy("species", "locus", "gene").agg(F.count("*").alias("n_alleles"), F.count_if(F.col("allele").endswith("*01")).alias("n_major"))


def library_consistency(a: DataFrame, b: DataFrame, key: list[str], item: str) -> DataFrame:
    """For every key: how many items both have, and only one has, and whether the key is in both."""
    x = a.select(*key, F.col(item).alias("_i")).distinct().withColumn("_a", F.lit(1))
    y = b.select(*key, F.col(item).alias("_i")).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [*key, "_i"], "full").fillna(0, ["_a", "_b"])
    return j.groupBy(*key).agg(F.sum(F.col("_a") * F.col("_b")).alias("n_both"), F.sum(F.col("_a") * (1 - F.col("_b"))).alias("n_only_a"), F.sum((1 - F.col("_a")) * F.col("_b")).alias("n_only_b"), (F.max("_a") * F.max("_b") == 1).alias("in_both"))


def parse_library(spark: SparkSession, path: str, species: str) -> DataFrame:
    """``species, gene, allele, sequence, functionality`` of a FASTA file with fields split by ``|`` (names, status third to last used)."""
    text = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.split(F.split("value", "\n")[0], r"\|")
    sequence = F.regexp_replace(F.regexp_replace(F.expr("substring(value, locate('\n', value) + 1)"), r"[\s.]", ""), "[^A-Za-z*]", "")
    name = F.get(head, F.lit(1))
    from plexivec.functions.names import allele_with_default, normalize_functionality, strip_allele

    return text.select(F.lit(species).alias("species"), strip_allele(name).alias("gene"), allele_with_default(name).alias("allele"), F.upper(sequence).alias("sequence"), normalize_functionality(F.get(head, F.lit(3))).alias("functionality"))
