"""Registered queries: each operator applied to the driver's tables, with the same result in SQL where SQL can say it.

Genome-sized defaults are longer than the coordinates of these tables, so windows and scales are passed smaller.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import coords, sequence, stats
from .operators import enrichment as E
from .operators import intervals as J
from .operators import multiscale as M
from .operators import profile as P
from .operators import reads as R
from .operators import trimming as T
from .plans import adapters as A
from .plans import commands as C
from .plans import peaks, params
from .functions import strings as S
from .operators.chunked import new_path, ranked_overall, settled, tidied
from .sources import profiles as SP
from .sources import reads as SR
from .sources import regions as SG
from .sources import sinks as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Reads: the lines of each format are made from the reads and parsed back.


def _lines(spark, d, *parts):
    return A.reads(spark, d).withColumn("len", F.regexp_extract("cigar", r"\d+", 0).cast("int")).select(F.concat(*parts).alias("value"))


def _tab(*cols):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def _minus(reverse="-", forward="+"):
    return F.when(F.col("strand") == "R", reverse).otherwise(forward)


_PARSED = f"WITH {A.READS} SELECT chrom, strand, start, cigar, count(*) AS n FROM reads GROUP BY ALL"


def _counted(df):
    return df.groupBy("chrom", "strand", "start", "cigar").agg(F.count("*").alias("n"))


@query(_PARSED)
def parse_sam(spark, d):
    flag = F.when(F.col("strand") == "R", 16).otherwise(0)
    seq, star = F.repeat(F.lit("A"), F.col("len")), F.lit("*")
    return _counted(SR.parse_sam(_lines(spark, d, _tab(F.lit("r"), flag, F.concat(F.lit("chr"), "chrom"), "start", F.lit(37), "cigar", star, F.lit(0), F.lit(0), seq, star))))


@query(_PARSED)
def parse_bed6(spark, d):
    return _counted(SR.parse_bed6(_lines(spark, d, _tab("chrom", F.col("start") - 1, F.col("start") - 1 + F.col("len"), F.lit("."), F.lit(0), _minus()))))


@query(_PARSED)
def parse_bed5(spark, d):
    return _counted(SR.parse_bed5(_lines(spark, d, _tab("chrom", F.col("start") - 1, F.col("start") - 1 + F.col("len"), F.lit("."), _minus()))))


@query(_PARSED)
def parse_tagalign(spark, d):
    return _counted(SR.parse_tagalign(_lines(spark, d, _tab("chrom", "start", F.col("start") + F.col("len") - 1, F.lit("N"), F.lit(1000), _minus()))))


@query(_PARSED)
def parse_bowtie(spark, d):
    return _counted(SR.parse_bowtie(_lines(spark, d, _tab(F.lit("r"), _minus(), "chrom", F.col("start") - 1, F.repeat(F.lit("C"), F.col("len"))))))


@query(_PARSED)
def parse_eland(spark, d):
    seq = F.repeat(F.lit("G"), F.col("len"))
    return _counted(SR.parse_eland(_lines(spark, d, _tab(F.lit("r"), seq, F.lit("U0"), F.lit(1), F.lit(0), F.lit(0), "chrom", "start", _minus("R", "F")))))


@query(_PARSED)
def parse_gff_reads(spark, d):
    return _counted(SR.parse_gff_reads(_lines(spark, d, _tab("chrom", "start", "cigar", _minus()))))


@query(f"WITH {A.READS} SELECT count(*) AS mapped FROM reads WHERE strand = 'F'")
def mapped_lines(spark, d):
    return SR.mapped_lines(_lines(spark, d, _tab(F.lit("r"), F.when(F.col("strand") == "R", 20).otherwise(0), "chrom")))


@query(r"""SELECT o_orderkey, regexp_replace(translate(concat('chr', o_orderpriority, '.', o_orderkey), '+-./*^$#@!&()~+=?"`][}{', repeat('_', 24)), '^(chr|Chr|CHR)', '') AS chrom FROM orders""")
def normalize_chrom(spark, d):
    name = F.concat(F.lit("chr"), "o_orderpriority", F.lit("."), F.col("o_orderkey").cast("string"))
    return A.table(spark, d, "orders").select("o_orderkey", coords.normalise_chrom(name).alias("chrom"))


@query(f"""WITH {A.READS}, s AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, strand, cigar, sample) AS place FROM reads)
SELECT chrom, place, start, strand, cigar FROM s""")
def sort_reads(spark, d):
    from .operators.chunked import ranked

    return ranked(R.sort_reads(A.reads(spark, d)), ["chrom"], ["start", "strand", "cigar", "sample"], "place").select("chrom", "place", "start", "strand", "cigar")


@query(f"""WITH {A.READS}, n AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom, start ORDER BY strand, cigar) AS k FROM reads)
SELECT sample, chrom, strand, start, cigar FROM n WHERE k <= 2""")
def dedup_reads(spark, d):
    return R.remove_duplicates(A.reads(spark, d), 2).select("sample", "chrom", "strand", "start", "cigar")


@query(f"WITH {A.READS} SELECT CASE WHEN grouping(chrom) = 1 THEN 'Total' ELSE chrom END AS chrom, count(*) AS n_reads FROM reads GROUP BY ROLLUP (chrom)")
def count_reads_rollup(spark, d):
    return R.count_reads(A.reads(spark, d))


@query(f"WITH {A.READS} SELECT chrom, count(*) FILTER (strand = 'F') AS n_forward, count(*) FILTER (strand = 'R') AS n_reverse FROM reads GROUP BY chrom")
def strand_counts(spark, d):
    return R.strand_counts(A.reads(spark, d))


@query("""WITH r AS (SELECT CAST(l_orderkey + 1 AS BIGINT) AS s, CAST(floor(l_quantity) AS BIGINT) AS n, l_linenumber AS k FROM lineitem),
b AS (SELECT s AS start, s + n - 1 AS "end" FROM r UNION ALL SELECT s + n + k + 5, s + n + k + 9 FROM r)
SELECT start, "end", count(*) AS n FROM b GROUP BY ALL""")
def cigar_blocks(spark, d):
    x = A.table(spark, d, "lineitem")
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("D2I5N3S5M"))
    rows = x.select(F.explode(R.cigar_blocks(F.col("l_orderkey") + 1, cigar)).alias("b"), R.cigar_ok(cigar).alias("ok")).filter("ok")
    return rows.groupBy(F.col("b.start").alias("start"), F.col("b.end").alias("end")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT concat(CAST(floor(l_quantity) AS INT), CASE l_linenumber WHEN 1 THEN 'M' WHEN 2 THEN 'M3' WHEN 3 THEN 'MM' WHEN 4 THEN 'M2D4M' WHEN 5 THEN 'Q' ELSE 'M1S' END) AS cigar FROM lineitem)
SELECT cigar, regexp_matches(cigar, '^[0-9]*([MIDNSHPX=][0-9]+)*[MIDNSHPX=]?$') AS ok, regexp_matches(cigar, '[IDNSHPX=]') AS spliced, count(*) AS n FROM c GROUP BY ALL""")
def cigar_check(spark, d):
    k = F.col("l_linenumber")
    tail = F.when(k == 1, "M").when(k == 2, "M3").when(k == 3, "MM").when(k == 4, "M2D4M").when(k == 5, "Q").otherwise("M1S")
    c = A.table(spark, d, "lineitem").select(F.concat(F.col("l_quantity").cast("int").cast("string"), tail).alias("cigar"))
    return c.groupBy("cigar", R.cigar_ok(F.col("cigar")).alias("ok"), R.cigar_spliced(F.col("cigar")).alias("spliced")).agg(F.count("*").alias("n"))


def depth_sql(name: str, stretches: str, by: str = "chrom") -> str:
    """CTEs of the depth runs of stretches (by, s, e)."""
    return f"""{name}_ev AS (SELECT {by}, pos, sum(d) AS d FROM (SELECT {by}, s AS pos, 1 AS d FROM ({stretches}) UNION ALL SELECT {by}, e + 1, -1 FROM ({stretches})) GROUP BY {by}, pos HAVING sum(d) <> 0),
{name}_lv AS (SELECT {by}, pos, sum(d) OVER (PARTITION BY {by} ORDER BY pos) AS v, lead(pos) OVER (PARTITION BY {by} ORDER BY pos) AS nx FROM {name}_ev),
{name} AS (SELECT {by}, CAST(pos AS BIGINT) AS start, CAST(nx - 1 AS BIGINT) AS "end", CAST(v AS DOUBLE) AS value FROM {name}_lv WHERE v > 0)"""


_PLAIN = "SELECT chrom, start AS s, start + len - 1 AS e FROM reads"
_BLOCK = "SELECT chrom, strand, start AS s, start + len - 1 AS e FROM reads"
_EXT = "SELECT chrom, strand, CASE WHEN b < 0 THEN 1 ELSE b END AS s, b + 19 AS e FROM (SELECT *, CASE WHEN strand = 'F' THEN start ELSE start + len - 20 END AS b FROM reads) WHERE b + 19 >= CASE WHEN b < 0 THEN 1 ELSE b END"
RUNS_SQL = f"WITH {A.READS}, {depth_sql('p', _PLAIN)}"


def _chip(spark, d, extension=0):
    return R.pileup(A.reads(spark, d).filter("sample = 'chip'"), extension, keys=("chrom",))


def _control(spark, d, extension=0):
    return R.pileup(A.reads(spark, d).filter("sample = 'control'"), extension, keys=("chrom",))


_CHIP = depth_sql("chip", _PLAIN + " WHERE sample = 'chip'")
_CONTROL = depth_sql("control", _PLAIN + " WHERE sample = 'control'")
_BOTH = f"WITH {A.READS}, {_CHIP}, {_CONTROL}"


@query(f"{RUNS_SQL} SELECT * FROM p")
def pileup(spark, d):
    return R.pileup(A.reads(spark, d), keys=("chrom",))


@query(f"WITH {A.READS}, {depth_sql('p', _EXT)} SELECT * FROM p")
def pileup_extended(spark, d):
    return R.pileup(A.reads(spark, d), 20, keys=("chrom",))


@query(f"WITH {A.READS}, {depth_sql('p', _BLOCK, 'chrom, strand')} SELECT * FROM p")
def pileup_stranded(spark, d):
    return R.pileup(A.reads(spark, d), stranded=True, keys=("chrom",))


@query(f"""{RUNS_SQL} SELECT chrom, max("end") AS l_signal FROM p GROUP BY chrom""")
def signal_length(spark, d):
    return R.signal_length(R.pileup(A.reads(spark, d), keys=("chrom",)))


@query(f"WITH {A.READS} SELECT chrom, CAST(max(start) + 1020 AS BIGINT) AS l_signal FROM reads GROUP BY chrom")
def signal_length_bound(spark, d):
    return R.profile_length_bound(A.reads(spark, d), 20)


@query(f"WITH {A.READS} SELECT chrom, CAST(sum(len) AS BIGINT) AS n_bases FROM reads GROUP BY chrom")
def mapped_bases(spark, d):
    return R.mapped_bases(A.reads(spark, d))


@query(f"""WITH {A.READS} SELECT chrom, CAST(floor(start / 1000) AS BIGINT) AS "window", count(*) AS n_reads FROM reads GROUP BY ALL""")
def reads_per_window(spark, d):
    return R.reads_per_window(A.reads(spark, d), 1000)


_FR = "f AS (SELECT DISTINCT chrom, start AS pos FROM reads WHERE strand = 'F'), r AS (SELECT DISTINCT chrom, start + len AS pos FROM reads WHERE strand = 'R'), s AS (SELECT unnest(range(5, 61)) AS separation)"


@query(f"""WITH {A.READS}, {_FR}, c AS (SELECT CAST(r.pos - f.pos AS BIGINT) AS separation, count(*) AS n FROM f JOIN r ON f.chrom = r.chrom AND r.pos BETWEEN f.pos + 5 AND f.pos + 60 GROUP BY ALL)
SELECT s.separation, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (separation)""")
def fragment_length_scan(spark, d):
    return R.fragment_length_scan(A.reads(spark, d), 5, 60)


@query(f"""WITH {A.READS}, {_FR}, c AS (SELECT CAST(r.pos - f.pos AS BIGINT) AS separation, count(*) AS n FROM f JOIN r ON f.chrom = r.chrom AND r.pos BETWEEN f.pos + 5 AND f.pos + 60 GROUP BY ALL)
SELECT s.separation AS fragment_length FROM s LEFT JOIN c USING (separation) ORDER BY coalesce(n, 0), s.separation LIMIT 1""")
def fragment_length(spark, d):
    return R.fragment_length(R.fragment_length_scan(A.reads(spark, d), 5, 60))


@query(f"""WITH {A.READS}, e AS (SELECT strand, CASE WHEN strand = 'F' THEN start ELSE start + len - 1 END AS pos, count(*) AS n FROM reads WHERE chrom = 'AF' GROUP BY ALL), s AS (SELECT unnest(range(5, 41)) AS separation),
c AS (SELECT CAST(r.pos - f.pos AS BIGINT) AS separation, sum(f.n * r.n) AS product FROM e f JOIN e r ON f.strand = 'F' AND r.strand = 'R' AND r.pos BETWEEN f.pos + 5 AND f.pos + 40 GROUP BY ALL)
SELECT s.separation, CAST(coalesce(product, 0) AS BIGINT) AS product FROM s LEFT JOIN c USING (separation)""")
def cross_correlation(spark, d):
    return R.cross_correlation(A.reads(spark, d), "AF", 5, 40)


_MAPP = """mapp AS (SELECT chrom, (row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1) * 40 + 1 AS start, row_number() OVER (PARTITION BY chrom ORDER BY pos) * 40 AS "end", 0.9 + pos % 7 * 0.1 AS value FROM (SELECT DISTINCT chrom, CAST(floor(start / 40) AS BIGINT) AS pos FROM reads))"""


def _mappability(spark, d):
    """Made-up mappability: each 40th position of the reads' range gives a stretch its value."""
    from .operators.chunked import ranked

    x = A.reads(spark, d).select("chrom", F.floor(F.col("start") / 40).cast("long").alias("pos")).distinct()
    n = ranked(x, ["chrom"], ["pos"], "k")
    return n.select("chrom", ((F.col("k") - 1) * 40 + 1).alias("start"), (F.col("k") * 40).alias("end"), (F.lit(0.9) + F.col("pos") % 7 * F.lit(0.1)).alias("value"))


@query(f"""WITH {A.READS}, {_MAPP}, spots AS (SELECT DISTINCT chrom, start, start + len AS e FROM reads),
ok AS (SELECT s.chrom, s.start, s.e FROM spots s LEFT JOIN mapp m ON s.chrom = m.chrom AND s.start <= m."end" AND m.start <= s.e GROUP BY ALL
 HAVING coalesce(sum(m.value * (least(s.e, m."end") - greatest(s.start, m.start) + 1)), 0) / (s.e - s.start + 1) < 1.1502)
SELECT chrom, strand, count(*) AS n FROM reads JOIN ok USING (chrom, start) WHERE e = start + len GROUP BY ALL""")
def mappable_reads(spark, d):
    return R.mappable_reads(A.reads(spark, d), _mappability(spark, d), 1.1502).groupBy("chrom", "strand").agg(F.count("*").alias("n"))


_MAPPABLE = f"""WITH {A.READS}, {_MAPP}, spots AS (SELECT DISTINCT chrom, start, start + len AS e FROM reads),
ok AS (SELECT s.chrom, s.start, s.e FROM spots s LEFT JOIN mapp m ON s.chrom = m.chrom AND s.start <= m."end" AND m.start <= s.e GROUP BY ALL
 HAVING coalesce(sum(m.value * (least(s.e, m."end") - greatest(s.start, m.start) + 1)), 0) / (s.e - s.start + 1) < 1.1502), kept AS (SELECT reads.* FROM reads JOIN ok USING (chrom, start) WHERE e = start + len)"""


@query(f"""{_MAPPABLE}, lim AS (SELECT chrom, max(start) + 1000 AS l FROM reads GROUP BY chrom), f AS (SELECT DISTINCT chrom, start AS pos FROM kept WHERE strand = 'F'), r AS (SELECT DISTINCT chrom, start + len AS pos FROM kept WHERE strand = 'R'), s AS (SELECT unnest(range(5, 41)) AS separation),
h AS (SELECT separation, chrom, pos FROM s, f JOIN lim USING (chrom) WHERE pos + separation < l UNION SELECT separation, chrom, pos - separation FROM s, r JOIN lim USING (chrom) WHERE pos - separation >= 1 AND pos < l) SELECT separation, count(*) AS n FROM h GROUP BY separation""")
def fragment_length_scan_mappable(spark, d):
    return R.fragment_length_scan_mappable(A.reads(spark, d), _mappability(spark, d), 5, 40, 1.1502)


# Regions.

_MERGE = """{n} AS (SELECT {by}, min(start) AS start, max("end") AS "end", arg_max({last}) AS last_strand FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM
(SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {src})) GROUP BY {by}, island)"""
_LAST = """strand, {'s': start, 'e': "end", 'x': strand}"""


def merge_sql(n: str, src: str, gap: int = 0, by: str = "chrom") -> str:
    return _MERGE.format(n=n, src=src, gap=gap, by=by, last=_LAST)


def _all(spark, d):
    return A.regions(spark, d).drop("part")


@query(f"""WITH {A.REGIONS}, {merge_sql('m', 'regions')} SELECT chrom, start, "end", last_strand AS strand FROM m""")
def interval_merge(spark, d):
    return J.merge(_all(spark, d))


@query(f"""WITH {A.REGIONS}, {merge_sql('m', 'regions', 20)} SELECT chrom, start, "end", last_strand AS strand FROM m""")
def interval_merge_gap(spark, d):
    return J.merge(_all(spark, d), 20)


@query(f"""WITH {A.REGIONS}, {merge_sql('m', 'regions', -5, 'chrom, strand')} SELECT chrom, strand, start, "end" FROM m""")
def interval_merge_stranded(spark, d):
    return J.merge(_all(spark, d), -5, ("chrom", "strand"))


@query(f"""WITH {A.REGIONS}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b), {merge_sql('m', 'u')} SELECT chrom, start, "end", last_strand AS strand FROM m""")
def interval_merge_lists(spark, d):
    return J.merge_all(list(A.pair(spark, d)))


_OVERLAP = """a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" """
_CLIPPED = """a.chrom, a.name, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end", a.start AS src_start, a."end" AS src_end, b.start AS dst_start, b."end" AS dst_end, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS overlap"""


def _cut(df):
    return df.select("chrom", "name", "start", "end", "src_start", "src_end", "dst_start", "dst_end", "overlap")


@query(f"WITH {A.REGIONS} SELECT {_CLIPPED} FROM a JOIN b ON {_OVERLAP}")
def interval_intersect_all(spark, d):
    return _cut(J.intersect(*A.pair(spark, d)))


@query(f"WITH {A.REGIONS} SELECT {_CLIPPED} FROM a JOIN b ON {_OVERLAP} AND a.strand = b.strand")
def interval_intersect_stranded(spark, d):
    return _cut(J.intersect(*A.pair(spark, d), match_strands=True))


@query(f"""WITH {A.REGIONS} SELECT {_CLIPPED} FROM a JOIN b ON {_OVERLAP} QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY b.start, b."end") = 1""")
def interval_intersect_first(spark, d):
    return _cut(J.intersect(*A.pair(spark, d), find_all=False))


@query(f"""WITH {A.REGIONS}, {merge_sql('m', 'b')} SELECT chrom, name, start, "end" FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chrom = a.chrom AND m.start < a."end" AND m."end" >= a.start)""")
def interval_exclude(spark, d):
    return J.exclude(*A.pair(spark, d)).select("chrom", "name", "start", "end")


@query(f"""WITH {A.REGIONS}, {merge_sql('m', 'b')}, h AS (SELECT a.name, a.chrom, a.start AS s, a."end" AS e, greatest(a.start, m.start) AS hs, least(a."end", m."end") AS he FROM a JOIN m ON m.chrom = a.chrom AND m.start <= a."end" AND m."end" >= a.start),
p AS (SELECT name, chrom, coalesce(lag(he) OVER w + 1, s) AS start, hs - 1 AS "end" FROM h WINDOW w AS (PARTITION BY name ORDER BY hs) UNION ALL SELECT name, chrom, max(he) + 1, any_value(e) FROM h GROUP BY name, chrom
 UNION ALL SELECT name, chrom, start, "end" FROM a WHERE name NOT IN (SELECT name FROM h))
SELECT name, chrom, start, "end" FROM p WHERE start <= "end" """)
def interval_subtract(spark, d):
    return J.subtract(*A.pair(spark, d)).select("name", "chrom", "start", "end")


@query(f"""WITH {A.REGIONS}, p AS (SELECT a.name, a.start AS s1, a."end" AS e1, greatest(a.start, b.start) AS lo, least(a."end", b."end") AS hi FROM a JOIN b ON {_OVERLAP})
SELECT name, s1 AS start, lo AS "end" FROM p WHERE hi > lo AND s1 < lo UNION ALL SELECT name, hi, e1 FROM p WHERE hi > lo AND hi < e1 UNION ALL SELECT name, s1, e1 FROM p WHERE hi <= lo""")
def interval_subtract_pair(spark, d):
    from .operators.overlap import overlap_join

    pairs = overlap_join(*A.pair(spark, d))
    return pairs.select(F.col("a_name").alias("name"), F.explode(J.subtract_pair(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).alias("p")).select("name", "p.start", "p.end")


@query(f"""WITH {A.REGIONS}, {merge_sql('m', 'regions', 20)} SELECT m.chrom, min(r.start) AS start, arg_max(r."end", {{'s': r.start, 'e': r."end"}}) AS "end" FROM m JOIN regions r ON r.chrom = m.chrom AND r.start BETWEEN m.start AND m."end" GROUP BY m.chrom, m.start, m."end" """)
def interval_merge_within(spark, d):
    x = _all(spark, d)
    return J.merge_within(x, J.merge(x, 20))


@query(f"""WITH {A.REGIONS} SELECT CAST(sum("end" - start + 1) AS BIGINT) AS coverage FROM regions""")
def interval_coverage(spark, d):
    return J.coverage(_all(spark, d))


@query(f"""WITH {A.REGIONS}, f AS (SELECT least(a."end", b."end") - greatest(a.start, b.start) + 1 AS ol FROM a JOIN b ON {_OVERLAP} QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY b.start, b."end") = 1)
SELECT round(2.0 * (SELECT sum(ol) FROM f) / ((SELECT sum("end" - start + 1) FROM a) + (SELECT sum("end" - start + 1) FROM b)), 6) AS nuc_overlap""")
def nuc_overlap(spark, d):
    return rounded(J.nucleotide_overlap(*A.pair(spark, d)), "nuc_overlap")


@query(f"""WITH {A.REGIONS}, {merge_sql('ma', 'a')}, {merge_sql('mb', 'b')}, ha AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_OVERLAP})), hb AS (SELECT * FROM b WHERE EXISTS (SELECT 1 FROM a WHERE {_OVERLAP})),
v AS (SELECT (SELECT sum("end" - start + 1) FROM a) AS a, (SELECT sum("end" - start + 1) FROM ha) AS ha, (SELECT sum("end" - start + 1) FROM hb) AS hb,
 (SELECT sum(least(a."end", b."end") - greatest(a.start, b.start) + 1) FROM ma a JOIN mb b ON {_OVERLAP}) AS ab)
SELECT round(ha / a, 6) AS src_over_src, round(ab / (ha + hb - ab), 6) AS src_over_both FROM v""")
def overlap_fractions(spark, d):
    return rounded(J.overlap_fractions(*A.pair(spark, d)), "src_over_src", "src_over_both")


@query(f"""WITH {A.REGIONS}, o AS (SELECT a.name, any_value(a."end" - a.start + 1) AS len, coalesce(max(CASE WHEN b.start IS NOT NULL THEN least(a."end", b."end") - greatest(a.start, b.start) + 1 END), 0) AS ol FROM a LEFT JOIN b ON {_OVERLAP} GROUP BY a.name)
SELECT CAST(floor(ol / len / 0.125) AS BIGINT) AS bucket, count(*) AS n FROM o GROUP BY bucket""")
def overlap_histogram(spark, d):
    return J.overlap_histogram(*A.pair(spark, d), 0.125)


@query(f"""WITH {A.REGIONS} SELECT s.name, CAST(coalesce(min(least(10000000, greatest(0, s.start - b."end", b.start - s."end"))), 10000000) AS BIGINT) AS distance FROM a s LEFT JOIN b ON s.chrom = b.chrom GROUP BY s.name""")
def nearest_distance(spark, d):
    return J.nearest_distance(*A.pair(spark, d)).select("name", "distance")


@query(f"""WITH {A.REGIONS}, n AS (SELECT chrom, start, "end", lead(start) OVER (PARTITION BY chrom ORDER BY start, "end") - "end" AS distance FROM regions) SELECT chrom, start, "end", distance FROM n WHERE distance IS NOT NULL""")
def inter_region_distance(spark, d):
    return J.gaps(_all(spark, d))


@query(f"""WITH {A.REGIONS} SELECT name, greatest((start + "end") // 2 - 25, 1) AS start, (start + "end") // 2 + 25 AS "end" FROM regions""")
def region_mids(spark, d):
    return J.middles(_all(spark, d), 50).select("name", "start", "end")


@query(f"""WITH {A.REGIONS}, p AS (SELECT name, '5p' AS side, CASE WHEN strand = '-' THEN "end" ELSE start END AS p FROM regions UNION ALL SELECT name, '3p', CASE WHEN strand = '-' THEN start ELSE "end" END FROM regions)
SELECT name, side, greatest(p - 10, 1) AS start, p + 10 AS "end" FROM p""")
def region_ends(spark, d):
    return J.ends(_all(spark, d), 10).select("name", "side", "start", "end")


@query(f"""WITH {A.REGIONS}, p AS (SELECT name, CASE WHEN strand = '-' THEN "end" ELSE start END AS p, CAST(floor(("end" - start + 1) * 0.25) AS BIGINT) AS h FROM regions)
SELECT name, '5p' AS side, greatest(p - h, 1) AS start, p + h AS "end" FROM p""")
def region_ends_fraction(spark, d):
    return J.ends(_all(spark, d), fraction=0.25, three=False).select("name", "side", "start", "end")


@query(f"""WITH {A.REGIONS} SELECT name, 'left' AS side, greatest(start - 100, 1) AS start, start AS "end" FROM regions UNION ALL SELECT name, 'right', "end", "end" + 100 FROM regions""")
def flanks(spark, d):
    x = _all(spark, d).select("name", "start", "end")
    return J.left_flanks(x, 100).withColumn("side", F.lit("left")).unionByName(J.right_flanks(x, 100).withColumn("side", F.lit("right"))).select("name", "side", "start", "end")


@query(f"""WITH {A.REGIONS} SELECT name, CASE WHEN strand = '-' THEN greatest(start - 30, 1) ELSE start END AS start, CASE WHEN strand = '-' THEN "end" ELSE "end" + 30 END AS "end" FROM regions""")
def extend_regions(spark, d):
    return J.extend(_all(spark, d), 30, five=False).select("name", "start", "end")


@query(f"""WITH {A.REGIONS} SELECT name, start + k * 10 AS start, start + k * 10 + 4 AS "end" FROM regions, range(3) t(k)""")
def sub_intervals(spark, d):
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((F.col("start") + k * 10).alias("start"), (F.col("start") + k * 10 + 4).alias("end")))
    return J.sub_intervals(_all(spark, d).withColumn("intervals", parts)).select("name", "start", "end")


@query(f"""WITH {A.REGIONS} SELECT name FROM regions WHERE "end" - start > 50 AND "end" - start < 150 AND "end" < 900000 AND strand = '+' AND chrom = 'O'""")
def filter_length(spark, d):
    x = J.shorter_than(J.longer_than(J.ends_before(_all(spark, d), 900_000), 50), 150)
    return J.on(J.valid(x), strand="+", chrom="O").select("name")


@query(f"""WITH {A.REGIONS}, t AS (SELECT *, sum("end" - start + 1) OVER (ORDER BY score DESC, chrom, start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM regions) SELECT name FROM t WHERE coalesce(held, 0) < 50000""")
def top_coverage(spark, d):
    return J.top_coverage(_all(spark, d), 50_000).select("name")


@query(f"""WITH {A.REGIONS} SELECT name, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS furthest_end, min(start) OVER (PARTITION BY chrom ORDER BY start DESC, "end" DESC ROWS UNBOUNDED PRECEDING) AS least_start FROM regions""")
def sorting_reach(spark, d):
    return J.sorting_reach(_all(spark, d)).select("name", "furthest_end", "least_start")


@query(f"""WITH {A.REGIONS}, q AS (SELECT o_orderkey, o_orderstatus AS chrom, o_orderkey * 40 + 25 AS pos FROM orders), s AS (SELECT DISTINCT chrom, start FROM b) SELECT q.chrom, q.pos, s.start AS before FROM q ASOF LEFT JOIN s ON q.chrom = s.chrom AND q.pos >= s.start""")
def predecessor(spark, d):
    x = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("chrom"), (F.col("o_orderkey") * 40 + 25).alias("pos"))
    return J.predecessor(x, A.pair(spark, d)[1].select("chrom", F.col("start").alias("pos")))


@query(f"WITH {A.REGIONS} SELECT DISTINCT chrom FROM regions")
def chromosomes(spark, d):
    return J.chromosomes(_all(spark, d))


@query(f"""WITH {A.REGIONS} SELECT name, row_number() OVER (ORDER BY "end" - start DESC, chrom, start, "end", name) AS place FROM regions""")
def regions_by_length(spark, d):
    x = J.by_chromosome_and_strand(_all(spark, d)).withColumn("_n", F.col("start") - F.col("end"))
    return ranked_overall(x, ["_n", "chrom", "start", "end", "name"], "place").select("name", "place")


@query(f"""WITH {A.REGIONS} SELECT chrom, start, "end", strand, name, score FROM regions""")
def bed_round_trip(spark, d):
    return SG.parse_bed(K.bed_lines(_all(spark, d)))


@query(f"""WITH {A.REGIONS} SELECT chrom, start, "end", strand, name, start + 2 AS i_start, start + 6 AS i_end FROM regions""")
def interval_format_round_trip(spark, d):
    x = _all(spark, d).withColumn("intervals", F.array(F.struct((F.col("start") + 2).alias("start"), (F.col("start") + 6).alias("end"))))
    return SG.parse_interval(K.interval_lines(x)).select("chrom", "start", "end", "strand", "name", F.col("intervals")[0]["start"].alias("i_start"), F.col("intervals")[0]["end"].alias("i_end"))


@query(f"""WITH {A.REGIONS} SELECT chrom, start, "end", name, CAST(score AS DOUBLE) AS score, CASE WHEN strand = '-' THEN NULL ELSE 1.5::DOUBLE END AS signal FROM regions""")
def narrowpeak_read(spark, d):
    x = _all(spark, d).select(_tab("chrom", F.col("start") - 1, "end", "name", "score", F.lit("."), F.when(F.col("strand") == "-", ".").otherwise("1.5")).alias("value"))
    return SG.parse_narrowpeak(x).select("chrom", "start", "end", "name", "score", "signal")


@query(f"""WITH {A.REGIONS} SELECT chrom, start - 1 AS start, "end", name, start + 4 AS i_start, start + 9 AS i_end FROM regions""")
def bed12_read(spark, d):
    x = _all(spark, d).select(_tab("chrom", F.col("start") - 1, "end", "name", "score", "strand", F.lit(0), F.lit(0), F.lit(0), F.lit(2), F.lit("3,5"), F.lit("0,5")).alias("value"))
    return SG.parse_bed12(x).select("chrom", "start", "end", "name", F.col("intervals")[1]["start"].alias("i_start"), F.col("intervals")[1]["end"].alias("i_end"))


# Signals.


def _signal(spark, d):
    return P.runs_of(A.signal(spark, d))


_ENDS = "SELECT chrom, max(pos) AS l FROM signal GROUP BY chrom"


@query(f"WITH {A.SIGNAL} SELECT chrom, pos, round(avg(value) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS value FROM signal")
def mean_filter(spark, d):
    x = _signal(spark, d)
    return rounded(P.positions(P.mean_filtered(x, P.lengths(x), 20)).select("chrom", "pos", "value"), "value")


_MEDIAN = "list_sort(list(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING))"


def median_sql(name: str, h: int, src: str = "signal") -> str:
    return f"{name}_w AS (SELECT chrom, pos, {_MEDIAN.format(h=h)} AS x FROM {src}), {name} AS (SELECT chrom, pos, CAST(x[len(x) // 2 + 1] AS DOUBLE) AS value FROM {name}_w)"


@query(f"WITH {A.SIGNAL}, {median_sql('m', 10)} SELECT chrom, pos, value FROM m")
def median_filter(spark, d):
    x = _signal(spark, d)
    return P.positions(P.median_filtered(x, P.lengths(x), 20)).select("chrom", "pos", "value")


@query(f"WITH {A.SIGNAL}, {median_sql('m8', 4)}, {median_sql('m16', 8)}, {median_sql('m32', 16)} SELECT 8.0::DOUBLE AS scale, * FROM m8 UNION ALL SELECT 16.0::DOUBLE, * FROM m16 UNION ALL SELECT 32.0::DOUBLE, * FROM m32")
def multiscale_median(spark, d):
    x = _signal(spark, d)
    return P.positions(M.median_tracks(x, P.lengths(x), M.scales(8, 32, 2))).select("scale", "chrom", "pos", "value")


_EXTREMA = f"""WITH {A.SIGNAL}, {median_sql('m', 4)}, ends AS ({_ENDS}), z AS (SELECT chrom, pos, value FROM m UNION ALL SELECT DISTINCT chrom, 0, 0.0 FROM m),
i AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY chrom ORDER BY pos) THEN 0 ELSE 1 END AS f FROM z)),
r AS (SELECT chrom, min(pos) AS a, max(pos) AS b, any_value(value) AS v FROM i GROUP BY chrom, island),
n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS x FROM r WINDOW w AS (PARTITION BY chrom ORDER BY a)),
e AS (SELECT chrom, (a + b + 1) // 2 AS pos, CASE WHEN p < v THEN 'MAX' ELSE 'MIN' END AS kind, v AS height FROM n JOIN ends USING (chrom) WHERE b + 1 < l AND (p < v AND x < v OR p > v AND x > v)),
s AS (SELECT chrom, arg_min(kind, pos) AS k0, arg_max(kind, pos) AS k1, count(*) AS c FROM e GROUP BY chrom HAVING count(*) >= 2),
ex AS (SELECT * FROM e WHERE chrom IN (SELECT chrom FROM s) UNION ALL SELECT chrom, 0, CASE k0 WHEN 'MAX' THEN 'MIN' ELSE 'MAX' END, 0.0 FROM s UNION ALL SELECT s.chrom, l - 1, CASE k1 WHEN 'MAX' THEN 'MIN' ELSE 'MAX' END, z.value FROM s JOIN ends USING (chrom) JOIN z ON z.chrom = s.chrom AND z.pos = l - 1)"""


@query(f"{_EXTREMA} SELECT chrom, 8.0::DOUBLE AS scale, pos, kind, height FROM ex")
def extrema(spark, d):
    x = _signal(spark, d)
    ends = P.lengths(x)
    return M.extrema(M.median_tracks(x, ends, [8.0]), ends).select("chrom", "scale", "pos", "kind", "height")


@query(f"""{_EXTREMA}, g AS (SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end" FROM ex WHERE kind = 'MIN'),
k AS (SELECT g.chrom, g.start, g."end", max(m.value) FILTER (m.pos BETWEEN g.start AND g."end") AS filtered, max(s.value) AS raw FROM g JOIN ends USING (chrom) JOIN signal s ON s.chrom = g.chrom AND s.pos BETWEEN greatest(1, g.start - 4) AND least(l, g."end" + 4)
 JOIN m ON m.chrom = g.chrom AND m.pos = s.pos WHERE g."end" IS NOT NULL GROUP BY ALL)
SELECT chrom, 8.0::DOUBLE AS scale, start, "end" FROM k WHERE filtered >= raw / 1.5""")
def multiscale_minima_regions(spark, d):
    x = _signal(spark, d)
    return M.minima_regions(x, P.lengths(x), [8.0], 1.5)


@query(f"WITH {A.SIGNAL}, n AS ({_ENDS}) SELECT chrom, CAST((pos - 1) // 7 AS BIGINT) AS bin, round(sum(value), 6) AS value FROM signal JOIN n USING (chrom) WHERE (pos - 1) // 7 < l // 7 GROUP BY ALL")
def bin_signal(spark, d):
    return rounded(P.binned(_signal(spark, d), 7), "value")


_WIN = """{n} AS (SELECT chrom, w, sum(value * (least("end", w * 500 + 499, l - 1) - greatest(start, w * 500 + 1) + 1)) AS m FROM {src} JOIN lim USING (chrom), (SELECT unnest(range(0, (SELECT max(l) // 500 + 1 FROM lim))) AS w)
 WHERE least("end", w * 500 + 499, l - 1) >= greatest(start, w * 500 + 1) AND w < l // 500 GROUP BY ALL)"""
_LIM = """lim AS (SELECT chrom, least(a.l, b.l) AS l FROM (SELECT chrom, max("end") AS l FROM chip GROUP BY chrom) a JOIN (SELECT chrom, max("end") AS l FROM control GROUP BY chrom) b USING (chrom))"""
_FIT = f"""{_BOTH}, {_LIM}, {_WIN.format(n='wx', src='chip')}, {_WIN.format(n='wy', src='control')}, p AS (SELECT chrom, wx.m AS y, wy.m AS x FROM wx JOIN wy USING (chrom, w) WHERE wx.m > 0 AND wy.m > 0),
fit AS (SELECT chrom, sum(x * y) / sum(x * x) AS slope1, (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) AS slope2, corr(y, x) AS pearson FROM p GROUP BY chrom)"""


@query(f"""{_FIT}, tx AS (SELECT chrom, sum(value * ("end" - start + 1)) AS t FROM chip GROUP BY chrom), ty AS (SELECT chrom, sum(value * ("end" - start + 1)) AS t FROM control GROUP BY chrom)
SELECT chrom, round(slope1, 6) AS slope1, round(slope2, 6) AS slope2, round(tx.t / ty.t, 6) AS total_ratio, round(pearson, 6) AS pearson FROM fit JOIN tx USING (chrom) JOIN ty USING (chrom)""")
def scale_factors(spark, d):
    return rounded(P.scaling_factors(_chip(spark, d), _control(spark, d), 500), "slope1", "slope2", "total_ratio", "pearson")


_POSITIONS = """{n} AS (SELECT chrom, unnest(range(start, "end" + 1)) AS pos, value FROM {src})"""


@query(f"""{_BOTH}, {_LIM}, {_POSITIONS.format(n='pa', src='chip')}, {_POSITIONS.format(n='pb', src='control')}
SELECT chrom, pos, round(ln(pa.value / pb.value), 6) AS value FROM pa JOIN pb USING (chrom, pos) JOIN lim USING (chrom) WHERE pos <= l AND pa.value <> pb.value""")
def log_ratio(spark, d):
    return rounded(P.positions(P.log_ratio(_chip(spark, d), _control(spark, d)).filter("value <> 0")).select("chrom", "pos", "value"), "value")


@query(f"WITH {A.SIGNAL} SELECT chrom, pos, CASE WHEN value >= 300 THEN 300.0::DOUBLE WHEN value >= 100 THEN 100.0::DOUBLE WHEN value >= 10 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM signal")
def quantize_signal(spark, d):
    return P.quantised(A.signal(spark, d), [0.0, 10.0, 100.0, 300.0])


@query(f"""WITH {A.SIGNAL}, t AS (SELECT chrom, pos, value AS x, lead(value, 1, 0.0) OVER (PARTITION BY chrom ORDER BY pos) AS y FROM signal) SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS new_pos, x, y FROM t WHERE x > 200 OR y > 300""")
def joint_prune(spark, d):
    from .operators.chunked import neighbours

    t = neighbours(A.signal(spark, d), ["chrom"], ["pos"], ["value"], previous=False).select("chrom", "pos", F.col("value").alias("x"), F.coalesce("next_value", F.lit(0.0)).alias("y"), F.lit(1.0).alias("z"))
    return P.jointly_pruned(t, {"x": 200, "y": 300, "z": -1000}).select("chrom", "pos", "new_pos", "x", "y")


@query(f"""WITH {A.SIGNAL} SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS pos, value FROM signal WHERE pos % 50 >= 10""")
def exclude_signal(spark, d):
    x = _signal(spark, d)
    holes = P.lengths(x).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l"), F.lit(50).cast("long"))).alias("start")).withColumn("end", F.col("start") + 9)
    return P.positions(P.without_regions(x, holes.withColumn("start", F.greatest("start", F.lit(1))))).select("chrom", "pos", "value")


@query(f"WITH {A.SIGNAL} SELECT chrom, pos, round(ln(value + 1) / ln(2), 6) AS value FROM signal")
def log_plus_one(spark, d):
    return rounded(P.log_plus_one(A.signal(spark, d), 2.0), "value")


@query(f"WITH {A.SIGNAL} SELECT chrom, pos, floor(value) AS value FROM signal")
def floor_signal(spark, d):
    return P.floored(A.signal(spark, d))


@query(f"WITH {A.SIGNAL} SELECT chrom, min(value) AS least, max(value) AS most FROM signal GROUP BY chrom")
def signal_extremes(spark, d):
    return P.extremes(A.signal(spark, d))


@query(f"WITH {A.SIGNAL} SELECT chrom, pos - 99 AS pos, value FROM signal WHERE chrom = 'click' AND pos BETWEEN 100 AND 300")
def slice_signal(spark, d):
    return P.positions(P.sliced(_signal(spark, d), "click", 100, 300)).select("chrom", "pos", "value")


_ISLANDS = """SELECT {t} AS threshold, chrom, min(pos) AS start, max(pos) AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM signal WHERE value {op} {t}) JOIN n USING (chrom) GROUP BY chrom, g, l HAVING max(pos) < l"""


@query(f"WITH {A.SIGNAL}, n AS ({_ENDS}) " + " UNION ALL ".join(_ISLANDS.format(t=t, op=">=") for t in (100, 200)))
def threshold_peaks(spark, d):
    x = _signal(spark, d)
    return P.threshold_regions(x, [100, 200], P.lengths(x))


@query(f"WITH {A.SIGNAL}, n AS ({_ENDS}) " + " UNION ALL ".join(_ISLANDS.format(t=t, op="<=") for t in (50, 100)))
def threshold_valleys(spark, d):
    x = _signal(spark, d)
    return P.threshold_regions(x, [50, 100], P.lengths(x), valleys=True)


@query(f"""{RUNS_SQL}, g AS (SELECT chrom, lag("end", 1, 0) OVER (PARTITION BY chrom ORDER BY start) AS start, start - 1 AS "end", 0.0::DOUBLE AS value FROM p)
SELECT chrom, start, "end", value FROM g WHERE start < "end" UNION ALL SELECT chrom, start - 1, "end", value FROM p""")
def bedgraph(spark, d):
    x = R.pileup(A.reads(spark, d), keys=("chrom",))
    return P.bedgraph(x, P.lengths(x))


@query(f"""{RUNS_SQL} SELECT chrom, start, "end", value FROM p""")
def bedgraph_round_trip(spark, d):
    x = R.pileup(A.reads(spark, d), keys=("chrom",))
    return SG.parse_bedgraph(K.bedgraph_lines(P.bedgraph(x, P.lengths(x)))).filter("value > 0")


@query(f"""{RUNS_SQL} SELECT chrom, start, "end", CAST(least(255, ceil(value * 100 / 20)) AS INT) AS value FROM p""")
def mappability_quantize(spark, d):
    return P.mappability_quantised(R.pileup(A.reads(spark, d), keys=("chrom",)), 10)


@query(f"""{RUNS_SQL}, q AS (SELECT chrom, start, "end", value / 10 AS value FROM p), n AS (SELECT chrom, max("end") AS l FROM q GROUP BY chrom)
SELECT chrom, CAST(sum(CASE WHEN value > 0.995 AND value < 1.005 THEN "end" - start + 1 ELSE 0 END) AS BIGINT) AS n_unique, round(sum(CASE WHEN value > 0.995 AND value < 1.005 THEN "end" - start + 1 ELSE 0 END) / any_value(l), 6) AS fraction FROM q JOIN n USING (chrom) GROUP BY chrom""")
def mappability_stats(spark, d):
    return rounded(P.mappability_stats(P.scaled(R.pileup(A.reads(spark, d), keys=("chrom",)), F.lit(0.1))), "fraction")


@query(f"""{_BOTH}, {_POSITIONS.format(n='pa', src='chip')}, {_POSITIONS.format(n='pb', src='control')} SELECT chrom, pos, sum(value) AS value FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb) GROUP BY chrom, pos""")
def sum_tracks(spark, d):
    return P.positions(P.summed([_chip(spark, d), _control(spark, d)])).select("chrom", "pos", "value")


@query(f"WITH {A.SIGNAL}, n AS ({_ENDS}) SELECT chrom, (pos - 1 + 37) % l + 1 AS pos, value FROM signal JOIN n USING (chrom)")
def circular_shift(spark, d):
    x = _signal(spark, d)
    return P.positions(P.circularly_shifted(x, 37, P.lengths(x))).select("chrom", "pos", "value")


@query(f"""WITH {A.SIGNAL}, n AS ({_ENDS}), b AS (SELECT chrom, l, unnest(range(l // 50)) AS block FROM n),
t AS (SELECT chrom, block, row_number() OVER (PARTITION BY chrom ORDER BY md5(concat('key:', chrom, ':', block))) - 1 AS place FROM b)
SELECT chrom, pos + (coalesce(place, (pos - 1) // 50) - (pos - 1) // 50) * 50 AS pos, value FROM signal LEFT JOIN t USING (chrom) WHERE t.block = (pos - 1) // 50
UNION ALL SELECT chrom, pos, value FROM signal JOIN n USING (chrom) WHERE (pos - 1) // 50 >= l // 50""")
def block_permutation(spark, d):
    x = _signal(spark, d)
    return P.positions(P.permuted_blocks(x, 50, P.lengths(x), "key")).select("chrom", "pos", "value")


@query()
def mappable_median(spark, d):
    x = _chip(spark, d)
    return P.mappable_median(x, _mappability(spark, d), P.lengths(x), 20, 1.2)


_MIRRORED = " AND ".join(f"lag(pos, {i}) OVER w = pos - {i} AND lead(pos, {i}) OVER w = pos + {i} AND abs(lag(value, {i}) OVER w - lead(value, {i}) OVER w) <= 1e-5" for i in (1, 2, 3))


@query(f"""{_BOTH}, {_POSITIONS.format(n='pa', src='chip')}, m AS (SELECT chrom, pos, max(pos) OVER (PARTITION BY chrom) AS l, {_MIRRORED} AS good FROM pa WINDOW w AS (PARTITION BY chrom ORDER BY pos))
SELECT chrom, min(pos) AS pos FROM m WHERE good AND pos >= 4 AND pos < l - 4 GROUP BY chrom""")
def symmetry_origin(spark, d):
    chip = _chip(spark, d)
    return P.symmetry_origin(P.positions(chip.select("chrom", "start", "end", "value")).select("chrom", "pos", "value"), 4)


@query()
def background_profile(spark, d):
    return E.background(_chip(spark, d), 500, 20, 2000)


# Statistics.

_TAIL = """(SELECT ln(sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + {n} * ln(0.5)))) FROM (SELECT unnest(range(0, {k} + 1)) AS i))"""


@query(f"""WITH u AS (SELECT DISTINCT CAST(floor(l_quantity) AS BIGINT) AS s, CAST(l_linenumber * 4 AS BIGINT) AS c FROM lineitem) SELECT s, c, round({_TAIL.format(n='(s + c)', k='c')}, 6) AS log_p FROM u""")
def binom_log_p(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("s"), (F.col("l_linenumber") * 4).cast("long").alias("c")).distinct()
    return rounded(x.withColumn("log_p", stats.enriched_over_background(F.col("s").cast("double"), F.col("c").cast("double"))), "log_p")


_SPOTS = "spots AS (SELECT DISTINCT chrom, CAST(start AS BIGINT) AS start, CAST(start + 79 AS BIGINT) AS \"end\" FROM reads)"


def _spots(spark, d):
    """The spots of all reads."""
    x = A.reads(spark, d)
    return x.select("chrom", F.col("start").cast("long").alias("start"), (F.col("start") + 79).cast("long").alias("end")).distinct()


_MASS = """{n} AS (SELECT s.chrom, s.start, s."end", coalesce(sum(p.value * (least(s."end", p."end") - greatest(s.start, p.start) + 1)), 0) AS m FROM spots s LEFT JOIN {src} p ON p.chrom = s.chrom AND p.start <= s."end" AND s.start <= p."end" GROUP BY ALL)"""


@query(f"""{_BOTH}, {_SPOTS}, {_MASS.format(n='x', src='chip')}, {_MASS.format(n='y', src='control')}, j AS (SELECT chrom, start, "end", x.m AS signal, y.m AS control FROM x JOIN y USING (chrom, start, "end"))
SELECT chrom, start, "end", signal, control, round((SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))) FROM (SELECT unnest(range(0, k + 1)) AS i)), 6) AS log_p
FROM (SELECT *, CAST(floor(signal / 20 + control / 20) AS BIGINT) AS n, CAST(floor(control / 20) AS BIGINT) AS k FROM j)""")
def region_p_value(spark, d):
    return rounded(E.region_p_values(_spots(spark, d), _chip(spark, d), _control(spark, d), 20), "log_p").select("chrom", "start", "end", "signal", "control", "log_p")


@query(f"""{_BOTH}, {_SPOTS}, {_MASS.format(n='x', src='chip')}, {_MASS.format(n='y', src='control')}, j AS (SELECT chrom, start, "end", x.m AS signal, y.m AS control FROM x JOIN y USING (chrom, start, "end")),
k AS (SELECT *, signal / 20 / (80 / 50.0::DOUBLE) AS s, CASE WHEN control / 20 / (80 / 50.0::DOUBLE) < 1 THEN 1 ELSE control / 20 / (80 / 50.0::DOUBLE) END AS c FROM j)
SELECT chrom, start, "end", signal, control, CASE WHEN s < 1 THEN 0 ELSE round((SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.4)))) FROM (SELECT unnest(range(0, m + 1)) AS i)), 6) END AS log_p
FROM (SELECT *, CAST(floor(s + c) AS BIGINT) AS n, CAST(floor(c) AS BIGINT) AS m FROM k)""")
def region_p_value_modified(spark, d):
    out = E.region_p_values(_spots(spark, d), _chip(spark, d), _control(spark, d), 20, norm=50, flip=0.4, floor_control=True)
    return rounded(out, "log_p").select("chrom", "start", "end", "signal", "control", "log_p")


@query()
def region_p_value_vicinity(spark, d):
    return E.vicinity_p_values(_spots(spark, d), _chip(spark, d), _control(spark, d), 20, 50, 1, False)


@query()
@tidied
def region_p_value_peak(spark, d):
    return E.vicinity_p_values(_spots(spark, d), settled(_chip(spark, d)), settled(_control(spark, d)), 20, 50, 3, True)


#: Thresholds of the windows of 2,000 positions of the profile p: mean depths over a window's own length, depths up to its greatest.
_LIMITS = """ends AS (SELECT chrom, max("end") AS l FROM p GROUP BY chrom), pos AS (SELECT chrom, unnest(range(start, "end" + 1)) AS q, value FROM p),
w AS (SELECT chrom, (q - 1) // 2000 AS win, q, value FROM pos WHERE q >= 1 UNION ALL SELECT chrom, (q - 1) // 2000 - 1, q, value FROM pos WHERE q > 1 AND (q - 1) % 2000 = 0),
n AS (SELECT chrom, win, q, value, least(2000, l - (win * 2000 + 1)) AS n FROM w JOIN ends USING (chrom)),
lam AS (SELECT chrom, CAST(win AS BIGINT) AS win, sum(value) / n AS lm, floor(coalesce(max(value) FILTER (q < win * 2000 + 1 + n), 0)) AS mx FROM n WHERE n > 0 GROUP BY chrom, win, n),
c AS (SELECT chrom, win, t, mx, sum(exp(t * ln(lm) - lm - lgamma(t + 1))) OVER (PARTITION BY chrom, win ORDER BY t) AS cdf FROM lam, (SELECT unnest(range(0, (SELECT CAST(max(mx) AS BIGINT) + 1 FROM lam))) AS t)),
thr AS (SELECT chrom, win, CAST(coalesce(min(t) FILTER (t >= 1 AND t <= mx AND cdf > 0.95), 0) AS INT) AS threshold FROM c GROUP BY chrom, win)"""
_POISSON = f"{RUNS_SQL}, {_LIMITS} SELECT * FROM thr"
_DEEP = 400


@query(_POISSON)
def poisson_threshold(spark, d):
    return E.poisson_windows(R.pileup(A.reads(spark, d), keys=("chrom",)), 0.05, 2000)


@query(f"WITH {A.READS}, {depth_sql('p0', _PLAIN)}, p AS (SELECT chrom, start, \"end\", value * {_DEEP} AS value FROM p0), {_LIMITS} SELECT * FROM thr")
def poisson_threshold_deep(spark, d):
    """Windows with mean depths of thousands."""
    return E.poisson_windows(P.scaled(R.pileup(A.reads(spark, d), keys=("chrom",)), float(_DEEP)), 0.05, 2000)


@query(f"""WITH {A.REGIONS}, p AS (SELECT chrom, start, "end", name, -score / 1000.0 AS log_p FROM regions), r AS (SELECT *, row_number() OVER (ORDER BY log_p, chrom, start, "end", name) AS rank, count(*) OVER () AS n FROM p)
SELECT name, rank, round(log_p + ln(n / rank), 6) AS log_q FROM r""")
def bh_q_value(spark, d):
    x = _all(spark, d).withColumn("log_p", -F.col("score") / 1000.0)
    return rounded(stats.benjamini_hochberg(x, ("chrom", "start", "end", "name")), "log_q").select("name", "rank", "log_q")


_WSUM = """coalesce((SELECT sum(p.value * (least(w.e{d}, p."end") - greatest(w.start, p.start) + 1)) FROM {src} p WHERE p.chrom = w.chrom AND p.start <= w.e{d} AND w.start <= p."end"), 0)"""
_WINDOW_STATS = f"""{_BOTH}, ends AS (SELECT chrom, a.l, b.l AS m FROM (SELECT chrom, max("end") AS l FROM chip GROUP BY chrom) a JOIN (SELECT chrom, max("end") AS l FROM control GROUP BY chrom) b USING (chrom)),
w0 AS (SELECT chrom, l, m, asked, start FROM ends, (VALUES (40), (80), (160)) t(asked), LATERAL (SELECT unnest(range(1, l, 2 * asked)) AS start)),
w1 AS (SELECT chrom, l, m, start, CASE WHEN start + asked > l THEN l - start - 1 ELSE asked END AS lw FROM w0), w AS (SELECT chrom, start, lw, start + lw AS e FROM w1 WHERE lw > 0 AND start + lw < l AND start + lw < m),
g AS (SELECT lw, {_WSUM.format(d='', src='chip')} / 20.0 / ((lw + 1) / CAST(lw AS DOUBLE)) AS s, {_WSUM.format(d='', src='control')} / 20.0 / ((lw + 1) / CAST(lw AS DOUBLE)) AS c, {_WSUM.format(d=' - 1', src='chip')} AS x, {_WSUM.format(d=' - 1', src='control')} AS y FROM w),
h AS (SELECT lw, x, y, s, CASE WHEN c < 1 THEN 1 ELSE c END AS c FROM g), k AS (SELECT lw, x, y, s, CAST(floor(s + c) AS BIGINT) AS n, CAST(floor(c) AS BIGINT) AS k FROM h WHERE s >= 1 AND y > 0 AND x / lw > 1),
q AS (SELECT lw, x / y AS fc, (SELECT ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))) FROM (SELECT unnest(range(0, k + 1)) AS i)) < ln(0.05) AS sig FROM k)
SELECT CAST(lw AS INT) AS l_win, count(*) FILTER (sig AND fc > 2) AS n_pp, count(*) FILTER (sig AND fc < 1.5) AS n_pi, count(*) FILTER (NOT sig AND fc > 2) AS n_ip, count(*) FILTER (NOT sig AND fc < 1.5) AS n_ii,
round(n_ip / nullif(n_pp + n_ip, 0), 6) AS fc_fnr, round(n_ip / nullif(count(*) FILTER (NOT sig), 0), 6) AS p_fnr, round(n_pi / nullif(n_pi + n_ii, 0), 6) AS fc_fpr, round(n_pi / nullif(count(*) FILTER (sig), 0), 6) AS p_fpr, round(n_pp / nullif(n_pp + n_ip, 0), 6) AS sensitivity
FROM q WHERE lw IN (40, 80, 160) GROUP BY lw"""


@query(_WINDOW_STATS)
def window_2x2_stats(spark, d):
    return rounded(E.window_statistics(_chip(spark, d), _control(spark, d), [40, 80, 160], 20), "fc_fnr", "p_fnr", "fc_fpr", "p_fpr", "sensitivity")


_LWIN = """w AS (SELECT DISTINCT p_size AS l_win, p_size % 13 / 1000.0 AS p_fpr, p_size % 7 / 500.0 AS fc_fpr, 0.9 + p_size / 400.0 AS sensitivity FROM part)"""


@query(f"""WITH {_LWIN} SELECT CAST(coalesce(min(l_win) FILTER (greatest(p_fpr, fc_fpr) > 0.05 OR (greatest(p_fpr, fc_fpr) <= 0.01 AND sensitivity >= 0.96 AND (sensitivity >= 0.99 OR greatest(p_fpr, fc_fpr) <= 0)) OR (sensitivity >= 0.96 AND greatest(p_fpr, fc_fpr) > 0.01)), max(l_win)) AS INT) AS l_win FROM w""")
def select_window_length(spark, d):
    x = A.table(spark, d, "part").select(F.col("p_size").cast("int").alias("l_win"), (F.col("p_size") % 13 / 1000.0).alias("p_fpr"), (F.col("p_size") % 7 / 500.0).alias("fc_fpr"), (0.9 + F.col("p_size") / 400.0).alias("sensitivity")).distinct()
    return E.select_window_length(x)


@query("""SELECT l_orderkey, l_linenumber, round(ln(l_quantity + l_tax), 6) AS added, round(ln(l_extendedprice - l_quantity), 6) AS taken, round(ln(l_quantity) + ln(l_extendedprice), 6) AS times, round(3 * ln(l_quantity), 6) AS power FROM lineitem""")
def log_arithmetic(spark, d):
    x = A.table(spark, d, "lineitem")
    q, p, t = (stats.to_log(F.col(c)) for c in ("l_quantity", "l_extendedprice", "l_tax"))
    return rounded(x.select("l_orderkey", "l_linenumber", stats.log_add(q, t).alias("added"), stats.log_subtract(p, q).alias("taken"), stats.log_multiply(q, p).alias("times"), stats.log_power(q, F.lit(3)).alias("power")), "added", "taken", "times", "power")


_LINES = "n AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey)"


def _lines_of_orders(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.countDistinct("l_returnflag").alias("flags"))


@query(f"""WITH {_LINES} SELECT l_orderkey, i AS i0, j AS i1, k AS i2 FROM n, range((SELECT max(lines) FROM n)) a(i), range((SELECT max(lines) FROM n)) b(j), range((SELECT max(lines) FROM n)) c(k) WHERE i < j AND j < k AND k < lines""")
def combination_indices(spark, d):
    return stats.combinations(_lines_of_orders(spark, d), F.col("lines"), 3).select("l_orderkey", "i0", "i1", "i2")


# Trimming.

_THRESHOLDS = f"{_BOTH}, p AS (SELECT * FROM chip), {_LIMITS}"
_TRIM = """{_SPOTS}, inner_p AS (SELECT chrom, start, least("end", l - 1) AS "end", value FROM p JOIN ends USING (chrom) WHERE start < l) SELECT s.chrom, min(greatest(s.start, p.start)) AS start, max(least(s."end", p."end")) AS "end" FROM spots s JOIN ends USING (chrom)
JOIN thr t ON t.chrom = s.chrom AND t.win = (s.start - 1) // 2000 AND t.threshold > 0 AND s.start >= 1 AND s.start < l JOIN inner_p p ON p.chrom = s.chrom AND p.start <= s."end" AND s.start <= p."end" AND p.value > t.threshold GROUP BY s.chrom, s.start, s."end" """.replace("{_SPOTS}", _SPOTS)


@query(f"{_THRESHOLDS}, {_TRIM}")
def rd_trim(spark, d):
    return T.rd_trim(_spots(spark, d), _chip(spark, d), 0.05, 2000)


@query(f"{_BOTH}, p AS (SELECT chrom, start, \"end\", value * {_DEEP} AS value FROM chip), {_LIMITS}, {_TRIM}")
def rd_trim_deep(spark, d):
    return T.rd_trim(_spots(spark, d), P.scaled(_chip(spark, d), float(_DEEP)), 0.05, 2000)


@query(f"""{_THRESHOLDS.replace("(q - 1) // 2000", "q // 2000").replace("(q - 1) % 2000", "q % 2000").replace("win * 2000 + 1", "win * 2000").replace("q > 1 AND", "q >= 1 AND").replace("0.95", "0.5").replace("WHERE n > 0", "WHERE n > 0 AND win >= 0")}, {_SPOTS},
m AS (SELECT s.chrom, s.start, s."end", sum(least(s."end", p."end") - greatest(s.start, p.start) + 1) AS above FROM spots s JOIN ends USING (chrom) JOIN thr t ON t.chrom = s.chrom AND t.win = s.start // 2000 AND t.threshold > 0 AND s.start < l
 JOIN p ON p.chrom = s.chrom AND p.start <= s."end" AND s.start <= p."end" AND p.value > t.threshold GROUP BY s.chrom, s.start, s."end") SELECT chrom, start, "end" FROM m WHERE above >= 40""")
def median_filter_regions(spark, d):
    return T.median_filter_regions(_spots(spark, d), _chip(spark, d), 0.5, 2000)


@query(f"""{_THRESHOLDS}, {_SPOTS}, v AS (SELECT s.*, t.threshold AS t, l, coalesce(x.value, 0) AS vs, coalesce(y.value, 0) AS ve FROM spots s JOIN ends USING (chrom) LEFT JOIN thr t ON t.chrom = s.chrom AND t.win = (s.start - 1) // 2000
 LEFT JOIN p x ON x.chrom = s.chrom AND s.start BETWEEN x.start AND x."end" LEFT JOIN p y ON y.chrom = s.chrom AND s."end" BETWEEN y.start AND y."end")
SELECT chrom, CASE WHEN t > 0 AND start < l AND vs >= t THEN greatest(start - 25, 1) ELSE start END AS start, CASE WHEN t > 0 AND start < l AND vs < t AND ve >= t THEN least("end" + 25, l) ELSE "end" END AS "end" FROM v""")
def tune_boundaries(spark, d):
    return T.tune_boundaries(_spots(spark, d), _chip(spark, d), 0.05, 2000, 25)


@query(f"""WITH {A.READS}, {_SPOTS}, {depth_sql('p', _BLOCK + " WHERE sample = 'chip'", 'chrom, strand')}, m AS (SELECT s.chrom, s.start, s."end", coalesce(sum(p.value * (least(s."end", p."end") - greatest(s.start, p.start) + 1)) FILTER (p.strand = 'F'), 0) AS fore_mass,
 coalesce(sum(p.value * (least(s."end", p."end") - greatest(s.start, p.start) + 1)) FILTER (p.strand = 'R'), 0) AS rev_mass FROM spots s LEFT JOIN p ON p.chrom = s.chrom AND p.start <= s."end" AND s.start <= p."end" GROUP BY ALL)
SELECT * FROM m WHERE CASE fore_mass WHEN 0 THEN 1 ELSE fore_mass END / CASE rev_mass WHEN 0 THEN 1 ELSE rev_mass END > 0.7 AND CASE rev_mass WHEN 0 THEN 1 ELSE rev_mass END / CASE fore_mass WHEN 0 THEN 1 ELSE fore_mass END > 0.7""")
def strand_evenness(spark, d):
    s = R.pileup(A.reads(spark, d).filter("sample = 'chip'"), stranded=True, keys=("chrom",))
    return T.strand_even(T.strand_info(_spots(spark, d), s), 0.7).select("chrom", "start", "end", "fore_mass", "rev_mass")


@query()
@tidied
def p_value_trim(spark, d):
    return T.p_value_trim(_spots(spark, d), settled(_chip(spark, d)), settled(_control(spark, d)), 20)


@query()
@tidied
def grid_trim(spark, d):
    return T.grid_trim(_spots(spark, d), settled(_chip(spark, d)), settled(_control(spark, d)), 20, step=10)


@query()
def summit(spark, d):
    return T.summits(_spots(spark, d), _chip(spark, d), _control(spark, d))


@query()
@tidied
def trough(spark, d):
    return T.troughs(_spots(spark, d), settled(_chip(spark, d)), settled(_mappability(spark, d)), 1.2)


# Sequences.


@query(f"WITH {A.SEQUENCES} SELECT chrom, translate(reverse(seq), 'ACGTacgt', 'TGCAtgca') AS seq FROM seqs")
def reverse_complement(spark, d):
    return A.sequences(spark, d).withColumn("seq", sequence.reverse_complement(F.col("seq")))


@query(f"""WITH {A.SEQUENCES}, b AS (SELECT chrom, 'F' AS strand, seq FROM seqs UNION ALL SELECT chrom, 'R', translate(reverse(seq), 'ACGT', 'TGCA') FROM seqs)
SELECT strand, substr(seq, CAST(o AS BIGINT) + 1, 8) AS fragment, count(*) AS n FROM b, (SELECT unnest(range(0, (SELECT max(length(seq)) FROM seqs))) AS o) WHERE o < length(seq) - 8 GROUP BY ALL""")
def fragment_sequence(spark, d):
    return sequence.fragments(A.sequences(spark, d), 8).groupBy("strand", "fragment").agg(F.count("*").alias("n"))


@query(f"WITH {A.SEQUENCES} SELECT substr(seq, CAST(o AS BIGINT), 3) AS kmer, count(*) AS n FROM seqs, (SELECT unnest(range(1, (SELECT max(length(seq)) FROM seqs) + 1)) AS o) WHERE o <= length(seq) - 2 GROUP BY ALL")
def kmer_counts(spark, d):
    return sequence.kmer_counts(A.sequences(spark, d), 3)


@query(f"WITH {A.SEQUENCES} SELECT chrom, CASE WHEN CAST(chrom AS BIGINT) % 2 = 0 THEN translate(reverse(substr(seq, 11, 20)), 'ACGT', 'TGCA') ELSE substr(seq, 11, 20) END AS sequence FROM seqs")
def kmer_slice(spark, d):
    s = A.sequences(spark, d)
    spots = s.select("chrom", F.lit(11).alias("start"), F.lit(30).alias("end"), F.when(F.col("chrom").cast("long") % 2 == 0, "-").otherwise("+").alias("strand"))
    return sequence.extracted(spots, s).select("chrom", "sequence")


@query(f"WITH {A.SEQUENCES} SELECT chrom, concat(substr(seq, 3, 13), substr(seq, 31, 10)) AS sequence FROM seqs")
def spliced_sequence(spark, d):
    s = A.sequences(spark, d)
    exon = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spots = s.select("chrom", F.lit("+").alias("strand"), F.array(exon(31, 40), exon(3, 10), exon(8, 15)).alias("intervals"))
    return sequence.spliced(spots, s).select("chrom", "sequence")


@query(f"WITH {A.SEQUENCES} SELECT chrom, translate(reverse(seq), 'ACGT', 'UGCA') AS rna, translate(seq, 'T', 'U') AS transcribed FROM seqs")
def rna_sequences(spark, d):
    s = F.col("seq")
    return A.sequences(spark, d).select("chrom", sequence.reverse_complement_rna(s).alias("rna"), sequence.transcribed(s).alias("transcribed"))


@query("""SELECT n_nationkey, upper(n_name) AS upper_name, reverse(n_name) AS reversed, substr(n_name, 2, 3) AS part, starts_with(lower(n_name), 'nat') AS starts, regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS alphanumeric, CAST(regexp_extract(n_name, '[0-9]+') AS VARCHAR) AS digits FROM nation""")
def string_helpers(spark, d):
    from .functions import strings as S

    n = F.col("n_name")
    return A.table(spark, d, "nation").select("n_nationkey", F.upper(n).alias("upper_name"), F.reverse(n).alias("reversed"), S.between(n, 1, 3).alias("part"), S.starts_with(n, "nat").alias("starts"), S.alphanumeric(n).alias("alphanumeric"), F.regexp_extract(n, "[0-9]+", 0).alias("digits"))


# Whole commands.

SMALL = params.BROAD.but(scale_start=32, scale_end=128, bin_width=2, window=100, mappability_window=20, fragment=20, poisson_window=2000, scaling_window=500, p_cutoff=0.5, q=0.9, tune_by=10, filter_length=False)


@query()
def peaks_broad(spark, d):
    return peaks.call(A.reads(spark, d), SMALL)


@query()
def peaks_punctate(spark, d):
    return peaks.call(A.reads(spark, d), SMALL.but(scale_start=8, scale_end=32, bin_width=1, rd_fdr=0.05, peak_mode=True, trim_after_merge=True, trough=True, q=5.0))


@query()
def peaks_tf(spark, d):
    return peaks.call(A.reads(spark, d), SMALL.but(scale_start=8, scale_end=16, bin_width=1, window=50, trim_after_merge=True))


@query()
def scale_spectrum(spark, d):
    return C.scale_spectrum(A.reads(spark, d), SMALL.but(bin_width=1))


def _sample_ext(sample: str) -> str:
    return _EXT.replace("FROM reads", f"FROM reads WHERE sample = '{sample}'")


#: Upper medians of whole parts: the lower median of the negated ones.
_TRACK = """SELECT {s}::DOUBLE AS scale, chrom, pos, -quantile_disc(-floor(value), 0.5) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS value FROM full_p"""
_TRACKS = " UNION ALL ".join(_TRACK.format(s=s, h=int(s) // 2) for s in M.scales(SMALL.scale_start, SMALL.scale_end, SMALL.scale_step))


@query(f"""WITH {A.READS}, {depth_sql('chip', _sample_ext('chip'))}, {_POSITIONS.format(n='there', src='chip')}, full_p AS (SELECT e.chrom, e.pos, coalesce(t.value, 0) AS value FROM (SELECT chrom, unnest(range(1, max("end") + 1)) AS pos FROM chip GROUP BY chrom) e LEFT JOIN there t USING (chrom, pos)),
t AS ({_TRACKS}), i AS (SELECT *, sum(f) OVER (PARTITION BY chrom, scale ORDER BY pos) AS island FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY chrom, scale ORDER BY pos) THEN 0 ELSE 1 END AS f FROM t))
SELECT chrom, scale, min(pos) - 1 AS start, max(pos) AS "end", any_value(value) AS value FROM i GROUP BY chrom, scale, island""")
def decomposition_tracks(spark, d):
    return C.decomposition_tracks(A.reads(spark, d), SMALL)


_FIT_EXT = _FIT.replace(_BOTH, f"WITH {A.READS}, {depth_sql('chip', _sample_ext('chip'))}, {depth_sql('control', _sample_ext('control'))}")


@query(f"""{_FIT_EXT}, {_POSITIONS.format(n='pa', src='chip')}, {_POSITIONS.format(n='pb', src='control')}
SELECT chrom, pos, round(ln(pa.value / (pb.value * coalesce(slope1, 1))), 6) AS value FROM pa JOIN pb USING (chrom, pos) JOIN lim USING (chrom) LEFT JOIN fit USING (chrom) WHERE pos <= l AND pa.value <> pb.value * coalesce(slope1, 1)""")
def log_ratio_command(spark, d):
    return rounded(P.positions(C.log_ratio_signal(A.reads(spark, d), SMALL).filter("value <> 0")).select("chrom", "pos", "value"), "value")


@query(f"""{RUNS_SQL} SELECT chrom, start, "end", CAST(least(255, ceil(value * 100 / 20)) AS INT) AS value FROM p""")
def multimappability(spark, d):
    return C.multimappability(A.reads(spark, d), 10)


#: Reads of chip after deduplication, piled up; runs of depth 8 and more merged over gaps of 10; masses and fold change.
_TOP = f"""WITH {A.READS}, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom, start ORDER BY strand, cigar) AS k FROM reads) WHERE k <= 2), {depth_sql('chip', "SELECT chrom, start AS s, start + len - 1 AS e FROM dd WHERE sample = 'chip'")}, {depth_sql('control', "SELECT chrom, start AS s, start + len - 1 AS e FROM dd WHERE sample = 'control'")},
deep AS (SELECT chrom, start, "end", '+' AS strand FROM chip WHERE value >= 8), {merge_sql('spots', 'deep', 10)}, {_MASS.format(n='x', src='chip')}, {_MASS.format(n='y', src='control')}
SELECT chrom, start, "end", x.m AS chip_mass, y.m AS control_mass, round(x.m / (y.m + 1), 6) AS fold_change FROM x JOIN y USING (chrom, start, "end") """


@query(_TOP)
def enriched_regions(spark, d):
    kept = R.remove_duplicates(A.reads(spark, d), 2)
    chip, control = (R.pileup(kept.filter(F.col("sample") == s), keys=("chrom",)) for s in ("chip", "control"))
    spots = J.merge(chip.filter("value >= 8").select("chrom", "start", "end"), 10)
    both = E.range_sums(spots, [("chip_mass", chip, True), ("control_mass", control, False)])
    out = both.withColumn("fold_change", F.round(K.fold_change(F.col("chip_mass"), F.col("control_mass")), 6))
    return out.select("chrom", "start", "end", "chip_mass", "control_mass", "fold_change")


# More readers, sinks and helpers.


@query(f"""WITH {A.REGIONS} SELECT name, chrom, start, "end", strand, concat(chrom, chr(9), start - 1, chr(9), "end", chr(9), name, chr(9), score, chr(9), strand) AS line FROM regions""")
def bed_lines_kept(spark, d):
    x = _all(spark, d)
    return SG.parse_bed_with_lines(K.bed_lines(x)).withColumn("name", F.split("line", "\t")[3])


@query(f"""WITH {A.REGIONS} SELECT chrom, start, "end", '+' AS strand, CAST(score AS DOUBLE) AS log_p FROM regions""")
def bed_log_p_read(spark, d):
    return SG.parse_bed_log_p(_all(spark, d).select(_tab("chrom", "start", "end", F.lit("."), "score").alias("value")))


@query("SELECT n_name AS chrom, CAST(n_nationkey * 1000 + 7 AS BIGINT) AS length FROM nation WHERE n_name IS NOT NULL")
def chromosome_lengths_read(spark, d):
    return SG.parse_lengths(A.table(spark, d, "nation").select(_tab("n_name", F.col("n_nationkey") * 1000 + 7).alias("value")))


@query(f"""WITH {A.REGIONS} SELECT chrom, start, "end", strand, name, score, concat('ACGT', name) AS sequence FROM regions""")
def bed_sequence_read(spark, d):
    return SG.parse_bed_with_sequence(_all(spark, d).select(_tab("chrom", F.col("start") - 1, "end", "name", "score", "strand", F.concat(F.lit("ACGT"), "name")).alias("value")))


@query(f"""WITH {A.REGIONS} SELECT count(*) + 3 AS n_lines, count(*) + 2 AS n_filled FROM regions""")
def line_counts(spark, d):
    extra = spark.createDataFrame([("",), ("# note",), ("track x",)], "value string")
    return SG.line_count(K.bed_lines(_all(spark, d)).union(extra)).select("n_lines", "n_filled")


@query(f"""WITH {A.REGIONS}, l AS (SELECT concat_ws(chr(9), chrom, 'terrane', 'region', start, "end", '.', strand, '.', concat('ID=', name)) AS value FROM regions UNION ALL
SELECT concat_ws(chr(9), chrom, 'terrane', 'interval', start + 2, start + 6, '.', strand, '.', concat('Parent=', name)) FROM regions) SELECT value FROM l""")
def gff_lines(spark, d):
    return K.gff_lines(_all(spark, d).withColumn("intervals", F.array(F.struct((F.col("start") + 2).alias("start"), (F.col("start") + 6).alias("end")))))


@query(f"""WITH {A.REGIONS} SELECT concat_ws(chr(9), chrom, start, "end", '.', 0, '.', CAST(floor(score / (part + 1)) AS BIGINT), '0.0', '0.0') AS value FROM regions""")
def broadpeak_lines(spark, d):
    x = A.regions(spark, d).withColumns({"chip_mass": F.col("score").cast("double"), "control_mass": F.col("part").cast("double"), "log_p": F.lit(0.0), "log_q": F.lit(0.0)})
    return K.broadpeak_lines(x)


@query(f"""WITH {A.REGIONS} SELECT concat_ws(chr(9), chrom, start, "end", '.', '0.0', strand, start + 1, 0, concat(score, '.0')) AS value FROM regions""")
def er_lines(spark, d):
    x = _all(spark, d).withColumns({"chip_mass": F.col("score").cast("double"), "control_mass": F.lit(0.0), "log_q": F.lit(0.0), "summit": F.col("start") + 1, "trough": F.lit(0)})
    return K.er_lines(x)


@query(f"WITH {A.SIGNAL} SELECT chrom, pos, round(sum(value) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) / 16, 6) AS value FROM signal")
def multiscale_mean(spark, d):
    x = _signal(spark, d)
    return rounded(P.positions(M.mean_tracks(x, P.lengths(x), [16.0])).select("chrom", "pos", "value"), "value")


@query(f"WITH {A.SIGNAL} SELECT chrom, pos + 5 AS pos, round(value * 2.5, 6) AS value FROM signal")
def shift_and_scale(spark, d):
    return rounded(P.positions(P.shifted(P.scaled(_signal(spark, d), 2.5), 5)).select("chrom", "pos", "value"), "value")


@query(f"WITH {_LWIN} SELECT CAST(coalesce(min(l_win) FILTER ((greatest(p_fpr, fc_fpr) < 0.01 AND sensitivity >= 0.99) OR (greatest(p_fpr, fc_fpr) > 0.01 AND sensitivity > 0.96)), max(l_win)) AS INT) AS l_win FROM w")
def select_window_length_simple(spark, d):
    x = A.table(spark, d, "part").select(F.col("p_size").cast("int").alias("l_win"), (F.col("p_size") % 13 / 1000.0).alias("p_fpr"), (F.col("p_size") % 7 / 500.0).alias("fc_fpr"), (0.9 + F.col("p_size") / 400.0).alias("sensitivity")).distinct()
    return E.select_window_length_simple(x)


@query(f"WITH {_LINES} SELECT l_orderkey, i AS i0, j AS i1 FROM n, range((SELECT max(lines) FROM n)) a(i), range((SELECT max(flags) FROM n)) b(j) WHERE i < lines AND j < flags")
def index_tuples(spark, d):
    return stats.index_tuples(_lines_of_orders(spark, d), [F.col("lines"), F.col("flags")]).select("l_orderkey", "i0", "i1")


@query("SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS n, round(lgamma(l_linenumber + 1), 6) AS log_factorial FROM lineitem")
def log_factorials(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("n")).distinct()
    return rounded(x.withColumn("log_factorial", stats.log_factorial(F.col("n"))), "log_factorial")


@query("SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS n, round(lgamma(l_orderkey + 1), 4) AS log_factorial FROM lineitem")
def log_factorials_wide(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("n")).distinct()
    return x.withColumn("log_factorial", F.round(stats.log_factorial(F.col("n")), 4))


@query(f"""WITH {A.SEQUENCES}, c AS (SELECT substr(seq, CAST(o AS BIGINT), 1) AS base FROM seqs, (SELECT unnest(range(1, (SELECT max(length(seq)) FROM seqs) + 1)) AS o) WHERE o <= length(seq))
SELECT base, CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 4 ELSE 0 END AS code, strpos('ACGT', base) AS number, base IN ('A', 'G') AS purine, count(*) AS n FROM c GROUP BY base""")
def nucleotide_maps(spark, d):
    k = sequence.kmer_counts(A.sequences(spark, d), 1)
    b = F.col("kmer")
    return k.select(b.alias("base"), sequence.signal_code(b).alias("code"), sequence.base_number(b).cast("long").alias("number"), sequence.matches_iupac(b, F.lit("R")).alias("purine"), "n")


@query(f"""WITH {A.REGIONS} SELECT name, CASE WHEN strand = '-' THEN "end" - 3 ELSE start + 3 END AS genome, 3 AS place FROM regions WHERE "end" - start >= 3""")
def sequence_coordinates(spark, d):
    s, e, t = F.col("start"), F.col("end"), F.col("strand")
    x = _all(spark, d).withColumn("genome", sequence.genome_index(F.lit(3), s, e, t)).filter("genome is not null")
    return x.select("name", "genome", sequence.sequence_index(F.col("genome"), s, e, t).cast("int").alias("place"))


@query(f"""WITH {A.READS}, {_SPOTS}, {depth_sql('p', _BLOCK + " WHERE sample = 'chip'", 'chrom, strand')}, o AS (SELECT s.chrom, s.start, s."end", p.strand, p.value AS v, greatest(s.start, p.start) AS a, least(s."end", p."end") AS b FROM spots s JOIN p ON p.chrom = s.chrom AND p.start <= s."end" AND s.start <= p."end")
SELECT chrom, start, "end", max(v) FILTER (strand = 'F') AS fore_max, arg_max(a, {{'v': v, 'p': -a}}) FILTER (strand = 'F') AS fore_peak, max(v) FILTER (strand = 'R') AS rev_max, arg_max(b, {{'v': v, 'p': b}}) FILTER (strand = 'R') AS rev_peak,
round(sum(v * (b - a + 1) * (a + b) / 2) FILTER (strand = 'F') / sum(v * (b - a + 1)) FILTER (strand = 'F'), 6) AS fore_centre FROM o GROUP BY chrom, start, "end" """)
def strand_info(spark, d):
    s = R.pileup(A.reads(spark, d).filter("sample = 'chip'"), stranded=True, keys=("chrom",))
    out = T.strand_info(_spots(spark, d), s).filter("fore_max is not null or rev_max is not null")
    return rounded(out.select("chrom", "start", "end", "fore_max", "fore_peak", "rev_max", "rev_peak", "fore_centre"), "fore_centre")


@query(f"""WITH {A.REGIONS}, pooled AS (SELECT chrom, k AS scale, start, "end", strand FROM regions, range(4) t(k) WHERE part <= k), {merge_sql('m', 'pooled', 1, 'chrom, scale')}, {merge_sql('top', 'regions', 1)},
g AS (SELECT chrom, scale, start, "end", CAST(-(("end" + start) % 5 + 1) AS DOUBLE) AS log_p FROM m), h AS (SELECT g.*, top.start AS ts FROM g JOIN top ON top.chrom = g.chrom AND g.start BETWEEN top.start AND top."end"),
f AS (SELECT chrom, ts, max(scale) AS scale FROM h WHERE log_p < ln(0.02) GROUP BY chrom, ts) SELECT chrom, start, "end", CAST(scale AS DOUBLE) AS scale, log_p FROM h JOIN f USING (chrom, ts, scale)""")
def merge_by_significance(spark, d):
    """Scales 0 to 3; a made-up log p from -1 to -5."""
    x = A.regions(spark, d).select("chrom", F.col("part").cast("double").alias("scale"), "start", "end")
    return T.merge_by_significance(x, lambda r: r.withColumn("log_p", -((F.col("end") + F.col("start")) % 5 + 1.0)), 0.02)


@query("""SELECT DISTINCT o_orderpriority, string_split(o_orderpriority, '-')[1] AS head, array_to_string(list_filter(regexp_split_to_array(o_orderpriority, '[- ]'), lambda x: x <> ''), '|') AS parts,
len(regexp_extract_all(o_orderpriority, '[0-9]+')) AS n_integers, contains('0123456789', left(o_orderpriority, 1)) AS digit_first FROM orders""")
def tokenizers(spark, d):
    from .functions import strings as S

    p = F.col("o_orderpriority")
    x = A.table(spark, d, "orders").select(p).distinct()
    return x.select(p, S.first_tokens(p, "-", 1)[0].alias("head"), F.array_join(S.tokens(p, "- "), "|").alias("parts"), F.size(S.integers(p)).cast("long").alias("n_integers"), S.is_number(F.substring(p, 1, 1)).alias("digit_first"))


@query("""SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS n, printf('%x', l_linenumber * 37) AS hex, l_linenumber % 2 = 0 AS balanced FROM lineitem""")
def radix_and_brackets(spark, d):
    from .functions import strings as S

    n = F.col("l_linenumber").cast("long")
    text = F.when(F.col("l_linenumber") % 2 == 0, "(a(b)c)").otherwise("(a))b(")
    return A.table(spark, d, "lineitem").select(n.alias("n"), F.lower(S.in_base(n * 37, 16)).alias("hex"), S.balanced(text).alias("balanced")).distinct()


@query("SELECT event_type AS chrom, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The batch form of the windowed stream."""
    x = A.table(spark, d, "events")
    return x.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("event_type").alias("chrom"), F.col("window.start").alias("window_start"), "n", "total")


# Files, written to the run's folder and read back.


@query(f"WITH {A.READS} SELECT sample, chrom, strand, start, cigar, 2 * count(*) AS n FROM reads GROUP BY ALL")
@tidied
def pooled_reads(spark, d):
    """Reads in two files' worth each, pooled by sample into one table."""
    path, x = new_path(spark, "reads"), A.reads(spark, d)
    for _ in range(2):
        for sample in ("chip", "control"):
            SR.preprocess(x.filter(F.col("sample") == sample).drop("sample"), path, sample)
    back = spark.read.schema("strand string, start int, cigar string, sample string, chrom string").parquet(path)
    return back.groupBy("sample", "chrom", "strand", "start", "cigar").agg(F.count("*").alias("n"))


@query(f"WITH {A.READS} SELECT chrom, strand, start, cigar, count(*) AS n FROM reads GROUP BY ALL")
@tidied
def mapped_file_read(spark, d):
    path, n = new_path(spark, "lines"), F.regexp_extract("cigar", r"\d+", 0).cast("int")
    K.write(A.reads(spark, d).select(_tab("chrom", F.col("start") - 1, F.col("start") - 1 + n, F.lit("."), F.lit(0), _minus()).alias("value")), path)
    return _counted(SR.read_mapped(spark, path, "BED6"))


@query(f"WITH {A.READS} SELECT chrom, strand, start, cigar, count(*) AS n FROM reads GROUP BY ALL")
def preprocessed_read(spark, d):
    return _counted(SR.parse_preprocessed(A.reads(spark, d).select("chrom", F.concat_ws(" ", "cigar", "strand", F.col("start").cast("string")).alias("value"))))


def _profile_file(spark, d, kind):
    """The folder of a written profile."""
    path, x = new_path(spark, "profile"), settled(R.pileup(A.reads(spark, d), keys=("chrom",)))
    held = x.withColumn("value", F.least(F.col("value"), F.lit(250.0))) if kind == "uint8" else x
    SP.write_profiles(held, P.lengths(x), path, kind)
    return path


@query(f"{RUNS_SQL} SELECT chrom, start, \"end\", value FROM p WHERE start >= 1")
@tidied
def profile_file_round_trip(spark, d):
    return P.compact(SP.read_profiles(spark, _profile_file(spark, d, "double"), "double", range_bytes=40_000))


@query(f"{RUNS_SQL}, q AS (SELECT chrom, start, \"end\", least(value, 250) AS value FROM p) SELECT chrom, unnest(range(start, \"end\" + 1)) AS pos, round(value * 0.01, 6) AS value FROM q")
@tidied
def mappability_file_round_trip(spark, d):
    x = SP.read_profiles(spark, _profile_file(spark, d, "uint8"), "uint8", 0.01, range_bytes=5_000)
    return rounded(P.positions(x).select("chrom", "pos", "value"), "value")


@query(f"{RUNS_SQL} SELECT chrom, max(\"end\") AS l FROM p GROUP BY chrom UNION ALL SELECT 'absent', 0")
@tidied
def mappability_lengths(spark, d):
    """Lengths of mappability files; a chromosome without a file has length 0."""
    wanted = R.pileup(A.reads(spark, d), keys=("chrom",)).select("chrom").union(spark.sql("SELECT 'absent'"))
    return SP.read_lengths(spark, _profile_file(spark, d, "uint8"), wanted)


@query(f"WITH {A.SEQUENCES} SELECT chrom, seq FROM seqs")
@tidied
def sequence_file_round_trip(spark, d):
    path = new_path(spark, "sequences")
    SP.write_sequences(A.sequences(spark, d), path)
    return SP.read_sequences(spark, path)


@query(f"WITH {A.READS} SELECT chrom, strand, start, cigar, count(*) AS n FROM reads GROUP BY ALL")
@tidied
def gzip_read(spark, d):
    """Mapped reads from gzip files, as from plain ones."""
    path, n = new_path(spark, "gzip"), F.regexp_extract("cigar", r"\d+", 0).cast("int")
    lines = A.reads(spark, d).select(_tab("chrom", F.col("start") - 1, F.col("start") - 1 + n, F.lit("."), F.lit(0), _minus()).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return _counted(SR.read_mapped(spark, path, "BED6"))


@query(f"WITH {A.SEQUENCES} SELECT chrom, seq FROM seqs WHERE length(seq) > 1")
@tidied
def fasta_read(spark, d):
    path = new_path(spark, "fasta")
    lines = F.regexp_replace("seq", "(.{60})", "$1\n")
    K.write(A.sequences(spark, d).select(F.concat(F.lit(">chr"), "chrom", F.lit("\n"), lines).alias("value")), path)
    return SP.read_fasta(spark, path)


@query(f"""WITH {A.REGIONS} SELECT chrom, start, "end", round(-score / 1000.0 / ln(10), 6) AS log_p, round(-score / 2000.0, 6) AS log_q FROM regions""")
def bed_p_q_round_trip(spark, d):
    x = _all(spark, d).withColumns({"log_p": -F.col("score") / 1000.0, "log_q": -F.col("score") / 2000.0})
    p, q = SG.parse_bed_log_p(K.bed_p_lines(x.drop("name"))), SG.parse_bed_log_p(K.bed_q_lines(x)).withColumnRenamed("log_p", "log_q")
    at = ["chrom", "start", "end"]
    # regions are told apart by their scores: equal places with different scores pair up in their order
    number = lambda t, c: t.withColumn("_k", F.row_number().over(Window.partitionBy(*at).orderBy(c)))
    return rounded(number(p, "log_p").join(number(q, "log_q"), [*at, "_k"]).select(*at, "log_p", "log_q"), "log_p", "log_q")


@query("SELECT concat_ws(chr(9), l_orderkey, l_linenumber, printf('%.6f', l_quantity), printf('%.6f', l_discount)) AS value FROM lineitem")
def statistics_lines(spark, d):
    return K.statistics_lines(A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d")))


@query("SELECT 100 AS n, 100 AS n_known, true AS repeatable")
def lines_sampled(spark, d):
    """A sample of 100 lines: how many there are, how many are lines of the source, and whether another partitioning gives the same."""
    x = A.table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("value"))
    one, two = K.lines_sampled(x, 100, 5), K.lines_sampled(x.repartition(13), 100, 5)
    known = one.join(x, "value", "left_semi").agg(F.count("*").cast("int").alias("n_known"))
    same = one.exceptAll(two).agg((F.count("*") == 0).alias("repeatable"))
    return one.agg(F.count("*").cast("int").alias("n")).join(known).join(same)


# Entries of their own for operators that other queries hold inside.


@query(f"""WITH {A.REGIONS} SELECT name, "end" - start AS run FROM regions WHERE -score / 10000.0 < ln(0.0001) AND "end" - start > 60""")
def significant_regions(spark, d):
    x = _all(spark, d).withColumn("log_p", -F.col("score") / 10000.0)
    return T.significant(x, 0.0001, 60).select("name", (F.col("end") - F.col("start")).alias("run"))


@query(f"""WITH {A.READS}, {_SPOTS}, {depth_sql('p', _BLOCK + " WHERE sample = 'chip'", 'chrom, strand')}, m AS (SELECT s.chrom, s.start, s."end", coalesce(sum(p.value * (least(s."end", p."end") - greatest(s.start, p.start) + 1)) FILTER (p.strand = 'F'), 0) AS f,
 coalesce(sum(p.value * (least(s."end", p."end") - greatest(s.start, p.start) + 1)) FILTER (p.strand = 'R'), 0) AS r FROM spots s JOIN p ON p.chrom = s.chrom AND p.start <= s."end" AND s.start <= p."end" GROUP BY ALL)
SELECT chrom, start, "end" FROM m WHERE f > 0 AND r > 0 AND f / r > 0.7 AND r / f > 0.7""")
def strand_evenness_strict(spark, d):
    s = R.pileup(A.reads(spark, d).filter("sample = 'chip'"), stranded=True, keys=("chrom",))
    return T.strand_even(T.strand_info(_spots(spark, d), s), 0.7, both=True).select("chrom", "start", "end")


@query()
@tidied
def p_value_trim_modified(spark, d):
    return T.p_value_trim(_spots(spark, d), settled(_chip(spark, d)), settled(_control(spark, d)), 20, modified=True)


@query(f"""{_EXTREMA}, g AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) < 6 THEN 0 ELSE 1 END AS f FROM ex)),
h AS (SELECT chrom, island, count(*) AS n, min({{'pos': pos, 'kind': kind, 'height': height}}) AS a, max({{'pos': pos, 'kind': kind, 'height': height}}) AS b FROM g GROUP BY chrom, island),
k AS (SELECT chrom, b.pos AS pos, b.kind AS kind FROM h WHERE n % 2 = 1 UNION ALL SELECT chrom, a.pos, CASE a.kind WHEN 'MAX' THEN 'MIN' ELSE 'MAX' END FROM h QUALIFY n > 1 AND row_number() OVER (PARTITION BY chrom ORDER BY island) = 1
 UNION ALL SELECT chrom, b.pos, CASE b.kind WHEN 'MAX' THEN 'MIN' ELSE 'MAX' END FROM h QUALIFY n % 2 = 0 AND row_number() OVER (PARTITION BY chrom ORDER BY island DESC) = 1) SELECT * FROM k""")
def extrema_pruned(spark, d):
    x = _signal(spark, d)
    ends = P.lengths(x)
    return M.pruned_extrema(M.extrema(M.median_tracks(x, ends, [8.0]), ends), 6).select("chrom", "pos", "kind")


@query(f"""WITH {A.REGIONS} SELECT name, CASE WHEN strand = '-' THEN "end" ELSE start END AS five, CASE WHEN strand = '-' THEN start ELSE "end" END AS three, greatest(0, start - 1000, 900 - "end") AS distance FROM regions""")
def region_points(spark, d):
    s, e, t = F.col("start"), F.col("end"), F.when(F.col("strand") == "-", "R").otherwise("F")
    return _all(spark, d).select("name", R.five_prime(s, e, t).alias("five"), R.three_prime(s, e, t).alias("three"), J.distance(s, e, F.lit(900), F.lit(1000)).cast("long").alias("distance"))


@query("""SELECT CAST(floor(l_quantity) AS BIGINT) + 10 AS read_span, count(*) AS n FROM lineitem GROUP BY ALL""")
def cigar_read_span(spark, d):
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M4D2I5N3S5M"))
    return A.table(spark, d, "lineitem").groupBy(R.read_span(cigar).alias("read_span")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS n FROM lineitem), e AS (SELECT n, k FROM n, range(0, 40) t(k) WHERE (1::BIGINT << k) >= n) SELECT n, 1::BIGINT << min(k) AS power, CAST(min(k) AS INT) AS exponent FROM e GROUP BY n""")
def next_power(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("n")).distinct()
    return x.select("n", stats.next_power_of_two(F.col("n")).alias("p")).select("n", "p.power", "p.exponent")


@query("""SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice / l_quantity), 6) AS divided, round(l_extendedprice, 6) AS back, sign(l_quantity - 25) AS compared FROM lineitem""")
def log_arithmetic_rest(spark, d):
    x = A.table(spark, d, "lineitem")
    q, p = stats.to_log(F.col("l_quantity").cast("double")), stats.to_log(F.col("l_extendedprice").cast("double"))
    return rounded(x.select("l_orderkey", "l_linenumber", stats.log_divide(p, q).alias("divided"), stats.from_log(p).alias("back"), stats.log_compare(q, stats.to_log(F.lit(25.0))).alias("compared")), "divided", "back")


@query("""SELECT n_nationkey, ends_with(lower(n_name), '1') AS ends, lower(n_name) = 'nation_1' AS same, starts_with('NATION_1', upper(n_name)) OR starts_with(upper(n_name), 'NATION_1') AS common, trim(n_name) = '' AS empty,
 array_to_string(string_split(n_name, 'TIO'), '|') AS by_text, CAST(n_nationkey AS BIGINT) AS back FROM nation""")
def string_helpers_more(spark, d):
    n = F.col("n_name")
    return A.table(spark, d, "nation").select("n_nationkey", S.ends_with(n, "1").alias("ends"), S.same_text(n, F.lit("NATION_1")).alias("same"), S.common_prefix(F.upper(n), F.lit("NATION_1")).alias("common"), S.is_empty(n).alias("empty"), F.array_join(S.tokens_by_text(n, "TIO"), "|").alias("by_text"), S.from_base(S.in_base(F.col("n_nationkey").cast("long"), 7), 7).alias("back"))


@query("""WITH p AS (SELECT p_partkey, concat('/data/', p_size, '/', p_name, '.', p_size % 3, CASE WHEN p_size % 2 = 0 THEN '' ELSE '.gz' END) AS path FROM part)
SELECT p_partkey, split_part(path, '/', -1) AS file, split_part(path, '.', -1) AS extension, regexp_replace(path, '/[^/]*$', '') AS directory FROM p""")
def path_helpers(spark, d):
    k = F.col("p_size")
    path = F.concat(F.lit("/data/"), k.cast("string"), F.lit("/"), "p_name", F.lit("."), (k % 3).cast("string"), F.when(k % 2 == 0, "").otherwise(".gz"))
    return A.table(spark, d, "part").select("p_partkey", S.file_name(path).alias("file"), S.file_extension(path).alias("extension"), S.directory(path).alias("directory"))


@query("""SELECT DISTINCT p_size, CASE WHEN p_size <= 5 THEN p_size - 1 ELSE -1 END AS place, CASE WHEN p_size <= 5 THEN '1,2,3,4,5' ELSE concat('1,2,3,4,5,', p_size) END AS added, concat('1,', p_size, ',2,0,3,4,5') AS mixed, '1,2|3,4|5' AS dealt FROM part""")
def list_helpers(spark, d):
    k, five = F.col("p_size").cast("int"), F.sequence(F.lit(1), F.lit(5))
    text = lambda c: F.array_join(c, ",")
    return A.table(spark, d, "part").select("p_size", S.position(five, k).cast("int").alias("place"), text(S.with_item(five, k)).alias("added"), text(S.interleaved(five, F.array(k, F.lit(0)))).alias("mixed"), F.array_join(F.transform(S.batches(five, 3), text), "|").alias("dealt")).distinct()


@query(f"""WITH {A.REGIONS}, r(recipe, longer, q) AS (VALUES ('broad', 1000, 0.05::DOUBLE), ('punctate', -1, 0.05), ('relaxed_broad', 1000, 0.1), ('relaxed_punctate', -1, 0.1))
SELECT recipe, chrom, count(*) AS n_regions, CAST(sum(10 * ("end" - start) + 1) AS BIGINT) AS coverage FROM regions, r WHERE -score / 100000.0::DOUBLE < ln(q) AND 10 * ("end" - start) > longer GROUP BY ALL""")
def recipes(spark, d):
    """What each recipe's cutoffs keep of the regions, ten times as long."""
    x = _all(spark, d).select("chrom", "start", (F.col("start") + 10 * (F.col("end") - F.col("start"))).alias("end"), (-F.col("score") / 100000.0).alias("log_p"))
    kept = [T.significant(x, p.q, p.scale_start if p.filter_length else None).select(F.lit(n).alias("recipe"), "chrom", (F.col("end") - F.col("start") + 1).alias("w")) for n, p in params.RECIPES.items()]
    return reduce(DataFrame.unionByName, kept).groupBy("recipe", "chrom").agg(F.count("*").alias("n_regions"), F.sum("w").alias("coverage"))


#: Lists by the score, more of them than a word of a bitmap has places.
@query(f"""WITH {A.REGIONS}, listed AS (SELECT chrom, start, "end", strand, score % 70 AS list FROM regions), {merge_sql('m', 'listed', 0, 'chrom, list')},
o AS (SELECT x.list AS list_a, y.list AS list_b, sum(least(x."end", y."end") - greatest(x.start, y.start) + 1) AS shared FROM m x JOIN m y ON x.chrom = y.chrom AND x.start <= y."end" AND y.start <= x."end" GROUP BY ALL),
s AS (SELECT list_a AS list, shared AS n FROM o WHERE list_a = list_b)
SELECT list_a, list_b, CAST(shared AS BIGINT) AS shared, CAST(p.n AS BIGINT) AS of_a, CAST(q.n AS BIGINT) AS of_b, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM o JOIN s p ON p.list = list_a JOIN s q ON q.list = list_b""")
@tidied
def list_association(spark, d):
    return rounded(J.association(_all(spark, d).withColumn("list", F.col("score") % 70), "list"), "jaccard")


@query(f"""{_BOTH}, {_SPOTS}, {_POSITIONS.format(n='pos', src='chip')}, e AS (SELECT chrom, start AS src_start, "end" AS src_end, unnest(range(start, "end" + 1)) AS pos FROM spots),
u AS (SELECT e.*, value, sum(value) OVER (PARTITION BY chrom, src_start, src_end ORDER BY pos) AS c, sum(value) OVER (PARTITION BY chrom, src_start, src_end) AS t FROM e JOIN pos USING (chrom, pos))
SELECT chrom, src_start, src_end, min(pos) FILTER (c > floor(t * 0.1::DOUBLE / 2)) AS start, max(pos) FILTER (t - c + value > floor(t * 0.1::DOUBLE / 2)) AS "end" FROM u GROUP BY chrom, src_start, src_end""")
@tidied
def mass_trim(spark, d):
    return T.mass_trim(_spots(spark, d), _chip(spark, d), 0.1).select("chrom", "src_start", "src_end", "start", "end")
