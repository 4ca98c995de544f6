"""Every registered query with SQL gives the SQL's rows; the others run."""

import oracle
import pytest
from pyspark.sql import functions as F

from terrane import registry
from terrane.operators import chunked
from terrane.plans import adapters

SF = "/root/testdata/sf0.001"
SLOW = {"peaks_broad", "peaks_punctate", "peaks_tf", "scale_spectrum"}


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.SQL:
        said = oracle.difference(df, con, registry.SQL[name])
        assert not said or said.startswith("("), said
    else:
        df.collect()


def test_peaks(spark):
    df = registry.QUERIES["peaks_punctate"](spark, SF)
    assert {"chrom", "start", "end", "summit", "log_q"} <= set(df.columns)
    df.collect()


@pytest.mark.parametrize("name", ["region_p_value_vicinity", "region_p_value_peak", "p_value_trim", "grid_trim", "summit"])
def test_regions_of_all_reads(spark, name):
    """A region for each distinct start, the deepest too; trims drop those that reach past control."""
    reads = adapters.reads(spark, SF)
    spots = reads.select("chrom", "start").distinct()
    if name.endswith("trim"):
        end = F.col("start") + F.regexp_extract("cigar", r"\d+", 0).cast("int") - 1
        spots = spots.join(reads.filter("sample = 'control'").groupBy("chrom").agg(F.max(end).alias("l")), "chrom").filter("start + 79 <= l")
    assert registry.QUERIES[name](spark, SF).count() == spots.count()


#: Queries that go through every operator with a plan for large inputs.
CHUNKED = ["sort_reads", "pileup", "pileup_stranded", "interval_merge", "interval_merge_stranded", "interval_subtract", "nearest_distance", "inter_region_distance", "top_coverage", "sorting_reach", "predecessor", "median_filter", "extrema", "extrema_pruned", "log_ratio", "exclude_signal", "bedgraph", "sum_tracks", "joint_prune", "list_association", "mass_trim"]


@pytest.mark.parametrize("name", CHUNKED)
def test_query_by_the_plan_for_large_inputs(spark, con, name, monkeypatch):
    monkeypatch.setattr(chunked, "PLAIN_BYTES", 0)
    said = oracle.difference(registry.QUERIES[name](spark, SF), con, registry.SQL[name])
    assert not said or said.startswith("("), said
