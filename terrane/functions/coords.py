"""Coordinate systems and chromosome names. Inside the package positions are 1-based and ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (base of starts, base of ends) of the formats read and written.
BASES = {"internal": (1, 1), "vcf": (1, 1), "bed": (0, 1), "bedgraph": (0, 1), "narrowpeak": (0, 1), "interval": (0, 1), "gff": (1, 1), "eland": (1, 1), "tagalign": (1, 1), "bowtie": (0, 0), "sam": (1, 1)}
#: Fixed value: characters of chromosome names that become underscores.
_REPLACED = "+-./*^$#@!&()~+=?\"`][}{"
MITOCHONDRIAL = "M"


def translate(position: Column, source_base: int, target_base: int) -> Column:
    return position - source_base + target_base


def to_internal(position: Column, system: str, which: str = "start") -> Column:
    return translate(position, BASES[system][which == "end"], 1)


def from_internal(position: Column, system: str, which: str = "start") -> Column:
    return translate(position, 1, BASES[system][which == "end"])


def normalise_chrom(name: Column) -> Column:
    return F.regexp_replace(F.translate(name, _REPLACED, "_" * len(_REPLACED)), "^(chr|Chr|CHR)", "")
