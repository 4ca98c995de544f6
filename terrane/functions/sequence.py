"""Nucleotide sequences as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases and their complements.
DNA, DNA_COMPLEMENT = "ACGTacgt", "TGCAtgca"
RNA_COMPLEMENT = "UGCAugca"
SIGNAL_CODES = {"A": 0, "C": 1, "G": 2, "U": 0, "T": 4}
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), DNA, DNA_COMPLEMENT)


def reverse_complement_rna(seq: Column) -> Column:
    """The reverse complement in the RNA alphabet; U reads as T."""
    return F.translate(F.reverse(seq), DNA + "Uu", RNA_COMPLEMENT + "Aa")


def transcribed(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def complement(seq: Column) -> Column:
    return F.translate(seq, DNA, DNA_COMPLEMENT)


def signal_code(base: Column) -> Column:
    """Number of a base; 0 for anything unknown."""
    out = F.lit(0)
    for b, code in SIGNAL_CODES.items():
        out = F.when(F.upper(base) == b, code).otherwise(out)
    return out


def base_number(base: Column) -> Column:
    """1 to 4 for A, C, G and T or U, 0 for others."""
    numbered = F.lit(0)
    for k, b in enumerate("ACGT", 1):
        numbered = F.when(F.translate(F.upper(base), "U", "T") == b, k).otherwise(numbered)
    return numbered


def is_base(base: Column) -> Column:
    return F.upper(base).isin("A", "C", "G", "T", "U")


def pairs_in_rna(a: Column, b: Column) -> Column:
    """Watson-Crick pairs and the G-U wobble."""
    return F.upper(F.concat(a, b)).isin("AU", "UA", "CG", "GC", "GU", "UG")


def matches_iupac(base: Column, code: Column) -> Column:
    out = F.lit(False)
    for c, bases in IUPAC.items():
        out = F.when(F.upper(code) == c, F.translate(F.upper(base), "U", "T").isin(*bases)).otherwise(out)
    return out


#: Lengths to which sequences are cut, one after the other, before their windows are listed: finding a place in a text takes time in
#: proportion to the place.
CUTS = (1 << 20, 1 << 15, 1 << 10)


def _cut(seqs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(..., offset, seq) in pieces of `size` that share `overlap` bases with the next one."""
    rest = [c for c in seqs.columns if c not in ("offset", "seq")]
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - overlap - 1, F.lit(0)), F.lit(size))
    return seqs.select(*rest, F.col("offset"), "seq", F.explode(starts).alias("_at")).select(*rest, (F.col("offset") + F.col("_at")).alias("offset"), F.substring(F.col("seq"), F.col("_at") + 1, F.lit(size + overlap)).alias("seq"))


def windows(seqs: DataFrame, length: int) -> DataFrame:
    """(..., offset, window): every window of `length` bases of the sequences, offsets from 0."""
    pieces = seqs.filter(F.length("seq") >= length).withColumn("offset", F.lit(0).cast("long"))
    for size in CUTS:
        pieces = _cut(pieces, size, length - 1)
    rest = [c for c in seqs.columns if c != "seq"]
    at = pieces.filter(F.length("seq") >= length).withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("seq") - length)))
    return at.select(*rest, (F.col("offset") + F.col("_at")).alias("offset"), F.substring(F.col("seq"), F.col("_at") + 1, F.lit(length)).alias("window"))


def fragments(seqs: DataFrame, length: int) -> DataFrame:
    """All windows of `length` bases at offsets 0 to len - length - 1 (the last window is left out), on both strands, as (chrom, strand, offset, fragment)."""
    both = seqs.select("chrom", F.explode(F.array(F.struct(F.lit("F").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("R").alias("strand"), reverse_complement(F.col("seq")).alias("s")))).alias("x"))
    short = F.expr("substring(x.s, 1, length(x.s) - 1)")
    return windows(both.select("chrom", "x.strand", short.alias("seq")), length).withColumnRenamed("window", "fragment")


def fragments_fasta(seqs: DataFrame, length: int) -> DataFrame:
    """The fragments as FASTA records, one text of two lines each."""
    return fragments(seqs, length).select(F.concat(F.lit(">"), "chrom", F.lit("_"), "strand", F.lit("_"), F.col("offset").cast("string"), F.lit("\n"), "fragment").alias("value"))


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    return windows(seqs.select("seq"), k).groupBy(F.col("window").alias("kmer")).agg(F.count("*").alias("n"))


def extracted(regions: DataFrame, seqs: DataFrame, upper: bool = False) -> DataFrame:
    """The sequence of each region (1-based, inclusive), reverse-complemented on the minus strand."""
    cut = F.substring(F.col("seq"), F.col("start"), F.col("end") - F.col("start") + 1)
    cut = F.upper(cut) if upper else cut
    return regions.join(seqs, "chrom").withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(cut)).otherwise(cut)).drop("seq")


def spliced(regions: DataFrame, seqs: DataFrame) -> DataFrame:
    """The joined sequence of the merged intervals of each region, reverse-complemented on the minus strand."""
    ordered = F.array_sort("intervals")
    joined = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"].cast("long")).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))))),
    )
    whole = F.array_join(F.transform("_m", lambda x: F.substring(F.col("seq"), x["start"], x["end"] - x["start"] + 1)), "")
    out = regions.withColumn("_m", joined).join(seqs, "chrom").withColumn("_w", whole)
    return out.withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(F.col("_w"))).otherwise(F.col("_w"))).drop("_m", "_w", "seq")


def genome_index(sequence_index: Column, start: Column, end: Column, strand: Column) -> Column:
    """Genome position of a 0-based place in a region's sequence; null outside it."""
    out = F.when(strand == "-", end - sequence_index).otherwise(start + sequence_index)
    return F.when(out.between(start, end), out)


def sequence_index(genome: Column, start: Column, end: Column, strand: Column) -> Column:
    """0-based place of a genome position in a region's sequence; null outside it."""
    return F.when(genome.between(start, end), F.when(strand == "-", end - genome).otherwise(genome - start))
