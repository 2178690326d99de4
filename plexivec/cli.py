"""Command line: ``python -m plexivec.cli embed clonotypes|repertoires ...``."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plexivec
from plexivec.functions.names import preset
from plexivec.operators.cohort import stack_embeddings
from plexivec.operators.basis import fit_projection, fit_repertoire_space, transform
from plexivec.operators.embedding import clonotype_embed, sequence_distances
from plexivec.operators.repertoire import mmd_matrix, sample_embedding
from plexivec.sources.formats import exploded, load_prototypes, pick_locus, read_clonotypes, write_table

WIDE = 500


def _read(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    df = reduce(DataFrame.unionByName, [read_clonotypes(spark, p).select("sample_id", "locus", "v_call", "j_call", "junction_aa", "duplicate_count") for p in paths])
    return df, load_prototypes(spark, args.prototypes, args.n_prototypes)


def _embed(df: DataFrame, protos: DataFrame, spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, int]:
    """``df`` with the vector ``e``, and its width: junctions alone, or three slots with a table of germline distances."""
    n = protos.count()
    if not args.germline:
        return sequence_distances(df, protos, output="e", metric=args.metric), n
    out = clonotype_embed(df, protos, spark.read.parquet(args.germline), mode=args.mode, metric=args.metric)
    return out.withColumnRenamed("embedding", "e"), 3 * n


def cmd_clonotypes(spark: SparkSession, args: argparse.Namespace) -> None:
    """One row a clonotype: its id columns and its vector."""
    df, protos = _read(spark, args, [args.input])
    df = df.filter(F.col("locus") == pick_locus(df, args.locus))
    if not df.take(1):
        raise SystemExit("no clonotypes of this locus")
    out, width = _embed(df, protos, spark, args)
    if args.pca:
        basis = fit_projection(out, "e", args.pca)
        out, width = transform(out.withColumnRenamed("e", "raw"), basis, "raw", "e").drop("raw"), basis.loadings.shape[1]
    if width > WIDE and not (args.output or "").endswith(".parquet"):
        print(f"warning: {width} text columns; a .parquet output keeps the vector as one", file=sys.stderr)
    write_table(exploded(out.select("v_call", "j_call", "junction_aa", "duplicate_count", "e"), "e", width, "e"), args.output)


def cmd_repertoires(spark: SparkSession, args: argparse.Namespace) -> None:
    """One row a sample and locus: its clonotypes, effective size and blocks as ``phi`` columns; with ``--mmd`` also the unbiased distances, a file a locus."""
    df, protos = _read(spark, args, args.input)
    blocks = args.blocks.split(",")
    loci = [args.locus] if args.locus else sorted(r[0] for r in df.select("locus").distinct().collect())
    results, width = [], 0
    for locus in loci:
        own = df.filter(F.col("locus") == locus)
        if own.count() < args.min_clonotypes:
            continue
        embed = lambda x: _embed(x, protos, spark, args)[0].withColumnRenamed("e", "embedding")
        n = args.n_components or preset(args.species, locus)[1]
        basis = fit_repertoire_space(own, embed, n, args.n_rff, args.n_rff_second if "second" in blocks else 0, length_scale=args.length_scale, seed=args.seed)
        cloud = transform(embed(own), basis, "embedding", "z", "f1", "f2" if "second" in blocks else None)
        phi = sample_embedding(cloud, "sample_id", "duplicate_count", "f1", "f2" if "second" in blocks else None, args.weight, blocks).withColumn("locus", F.lit(locus)).persist()
        if args.mmd:
            path = args.mmd if len(loci) == 1 else f"{args.mmd}.{locus}"
            matrix = mmd_matrix(phi, "sample_id", unbiased=True).groupBy("id_a").pivot("id_b").agg(F.first("dist"))
            write_table(matrix.withColumnRenamed("id_a", "sample_id").orderBy("sample_id"), path)
        rows, spec = stack_embeddings(phi, "phi")
        width = max(width, sum(map(len, (spec[b] for b in spec.names))))
        results.append(rows.join(own.groupBy("sample_id").agg(F.count("*").alias("n_clonotypes")), "sample_id").select("sample_id", "locus", "n_clonotypes", "n_eff", "phi"))
    if not results:
        raise SystemExit("no samples or loci to embed: see the inputs, --locus and --min-clonotypes")
    write_table(exploded(reduce(DataFrame.unionByName, results).orderBy("locus", "sample_id"), "phi", width, "phi"), args.output)


def parser() -> argparse.ArgumentParser:
    """The argument parser."""
    p = argparse.ArgumentParser(prog="plexivec")
    p.add_argument("--version", action="version", version=plexivec.__version__)
    embed = p.add_subparsers(dest="command", required=True).add_parser("embed").add_subparsers(dest="what", required=True)
    c, r = embed.add_parser("clonotypes"), embed.add_parser("repertoires")
    c.add_argument("input")
    c.add_argument("--pca", type=int)
    c.set_defaults(run=cmd_clonotypes)
    r.add_argument("input", nargs="+")
    r.add_argument("--weight", default="log1p")
    r.add_argument("--blocks", default="mean,diversity")
    r.add_argument("--n-rff", type=int, default=1024)
    r.add_argument("--n-rff-second", type=int, default=128)
    r.add_argument("--n-components", type=int)
    r.add_argument("--length-scale", type=float, help="kernel width; by default what one substitution moves a record")
    r.add_argument("--min-clonotypes", type=int, default=1, help="loci with fewer pooled rows are left out")
    r.add_argument("--mmd")
    r.add_argument("--seed", type=int, default=0)
    r.set_defaults(run=cmd_repertoires)
    for x in (c, r):
        x.add_argument("-o", "--output")
        x.add_argument("--prototypes", required=True)
        x.add_argument("--n-prototypes", type=int)
        x.add_argument("--locus")
        x.add_argument("--species", default="human")
        x.add_argument("--germline", help="parquet of component, a, b, d")
        x.add_argument("--mode", choices=("vjcdr3", "cdr123"), default="vjcdr3")
        x.add_argument("--metric", choices=("squared", "sqrt"), default="squared")
    return p


def main(argv: list[str] | None = None) -> None:
    """Run a command in the active Spark session, or a new one."""
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
