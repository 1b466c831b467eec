"""The engine's operators over the derived genotype tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quantise, triangle
from .operators import covariates as cov
from .operators import extract as ext
from .operators import gram as gm
from .operators import lookup, projection, selection, standardize
from .plans import views
from .plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c: str | Column, name: str | None = None) -> Column:
    """Six places, no negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, 6) + 0.0).alias(name or c)


def standardized_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize.standardize(views.dosage(spark, sf_dir))


LD = with_views("dosage", "std", "ld")
ALL = with_views("vindex", "zfile", "dosage", "std", "ld", "store")


@query(with_views("dosage") + """
select variant_idx, round(m, 6) + 0.0 as mean, round(case when nrm = 0 then cast(1 as double) else nrm end, 6) + 0.0 as norm
from (select variant_idx, m, sqrt(sum((dosage - m) * (dosage - m))) as nrm
      from (select variant_idx, dosage, avg(dosage) over (partition by variant_idx) as m from dosage) a group by 1, 2) b""")
def variant_stats(spark, sf_dir):
    return standardize.variant_stats(views.dosage(spark, sf_dir)).select("variant_idx", rounded("mean"), rounded("norm"))


@query(with_views("dosage", "std") + "select sample_id, variant_idx, round(z, 6) + 0.0 as z from std")
def standardized(spark, sf_dir):
    return standardized_of(spark, sf_dir).select("sample_id", "variant_idx", rounded("z"))


@query(with_views("dosage") + "select sample_id, variant_idx, round(dosage - avg(dosage) over (partition by variant_idx), 6) + 0.0 as z from dosage")
def centered_only(spark, sf_dir):
    return standardize.standardize(views.dosage(spark, sf_dir), scale=False).select("sample_id", "variant_idx", rounded("z"))


@query(with_views("dosage") + """
select sample_id, variant_idx, round(case when nrm = 0 then dosage else dosage / nrm end, 6) + 0.0 as z
from (select *, sqrt(sum(dosage * dosage) over (partition by variant_idx)) as nrm from dosage) a""")
def scaled_only(spark, sf_dir):
    return standardize.standardize(views.dosage(spark, sf_dir), center=False).select("sample_id", "variant_idx", rounded("z"))


@query(LD + "select i, j, round(r, 6) + 0.0 as r from ld")
def ld_long(spark, sf_dir):
    return gm.gram(standardized_of(spark, sf_dir)).select("i", "j", rounded("r"))


@query(LD + "select i, j, round(r, 6) + 0.0 as r from ld")
def blocked_gram(spark, sf_dir):
    z = standardized_of(spark, sf_dir).withColumn("sample_pos", F.col("sample_id"))
    return gm.blocked_gram(z, views.VARIANTS, block=6, slice_=4096).select("i", "j", rounded("r"))


@query("""with e as (select vec_id, unnest(range(64)) as v, unnest(embedding) as x from embeddings),
c as (select vec_id, cast(v as int) as v, x - avg(x) over (partition by v) as g from (select vec_id, v, cast(x as double) as x from e) a),
s as (select vec_id, v, g / sqrt(sum(g * g) over (partition by v)) as z from c)
select a.v as i, b.v as j, round(sum(a.z * b.z), 6) + 0.0 as r from s a join s b on a.vec_id = b.vec_id and a.v <= b.v group by 1, 2""")
def ld_continuous(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("variant_idx", "dosage"))
    z = standardize.standardize(e.withColumn("dosage", F.col("dosage").cast("double"))).withColumn("sample_pos", F.col("sample_id"))
    return gm.blocked_gram(z, 64, block=32, slice_=1 << 16).select("i", "j", rounded("r"))


@query(with_views("vindex", "dosage", "std", "ld") + """
select a.idx as i, b.idx as j, round(r, 6) + 0.0 as r from ld
join vindex a on a.idx = ld.i and a.contig = '1' and a.position between 30 and 120
join vindex b on b.idx = ld.j and b.contig = '1' and b.position between 30 and 120""")
def ld_region(spark, sf_dir):
    chosen = selection.in_region(views.variant_index(spark, sf_dir), "1:30-120").select(F.col("idx").alias("variant_idx"))
    part = views.dosage(spark, sf_dir).join(chosen, "variant_idx", "left_semi")
    return gm.gram(standardize.standardize(part)).select("i", "j", rounded("r"))


@query(with_views("vindex", "zfile", "dosage", "std", "ld") + """, m as (
select zfile.ord, vindex.idx from zfile join vindex on contig = chromosome and vindex.position = zfile.position and ref = allele1 and alt = allele2)
select a.ord as i, b.ord as j, round(r, 6) + 0.0 as r from ld join m a on a.idx = ld.i join m b on b.idx = ld.j""")
def ld_zfile_ordered(spark, sf_dir):
    index = views.variant_index(spark, sf_dir)
    chosen = selection.exact(views.variant_list(index), index.withColumnsRenamed({"contig": "chrom", "position": "pos"})).select(F.col("idx").alias("variant_idx"), "ord")
    part = views.dosage(spark, sf_dir).join(chosen, "variant_idx").drop("variant_idx").withColumnRenamed("ord", "variant_idx")
    return gm.gram(standardize.standardize(part)).select("i", "j", rounded("r"))


@query(with_views("dosage").replace("with dosage", "with alldosage") + """, dosage as (
select d.* from alldosage d join customer c on c.c_custkey = d.sample_id where c.c_acctbal > 0),
""" + views.SQL["std"] + ",\n" + views.SQL["ld"] + " select i, j, round(r, 6) + 0.0 as r from ld")
def ld_sample_subset(spark, sf_dir):
    known = views.covariates(spark, sf_dir, "c_acctbal").where("c_acctbal > 0").select("sample_id")
    part = views.dosage(spark, sf_dir).join(known, "sample_id", "left_semi")
    return gm.gram(standardize.standardize(part)).select("i", "j", rounded("r"))


GAPS = "(sample_id + variant_idx) % 97 = 5"
GAPPY = with_views("dosage").replace("with dosage", "with full_dosage") + f", gappy as (select sample_id, variant_idx, case when {GAPS} then null else dosage end as dosage from full_dosage), "


@query(GAPPY + """dosage as (select sample_id, variant_idx, coalesce(dosage, avg(dosage) over (partition by variant_idx)) as dosage from gappy),
""" + views.SQL["std"] + ",\n" + views.SQL["ld"] + " select i, j, round(r, 6) + 0.0 as r from ld")
def ld_missing_mean(spark, sf_dir):
    gappy = views.dosage(spark, sf_dir).withColumn("dosage", F.when(~F.expr(GAPS), F.col("dosage")))
    return gm.gram(standardize.standardize(standardize.resolve_missing(gappy, "mean"))).select("i", "j", rounded("r"))


@query(GAPPY + """dosage as (select * from gappy g where not exists (select 1 from gappy b where b.sample_id = g.sample_id and b.dosage is null)),
""" + views.SQL["std"] + ",\n" + views.SQL["ld"] + " select i, j, round(r, 6) + 0.0 as r from ld")
def ld_missing_omit(spark, sf_dir):
    gappy = views.dosage(spark, sf_dir).withColumn("dosage", F.when(~F.expr(GAPS), F.col("dosage")))
    return gm.gram(standardize.standardize(standardize.resolve_missing(gappy, "omit"))).select("i", "j", rounded("r"))


@query(with_views("dosage").replace("with dosage", "with base") + """, dosage as (
select sample_id, variant_idx, case when variant_idx = 3 then cast(0.1 as double) else dosage end as dosage from base),
std as (select sample_id, variant_idx, case when lo = hi then cast(0 as double) else gc / nrm end as z
  from (select *, sqrt(sum(gc * gc) over (partition by variant_idx)) as nrm
        from (select *, dosage - avg(dosage) over (partition by variant_idx) as gc, min(dosage) over (partition by variant_idx) as lo, max(dosage) over (partition by variant_idx) as hi from dosage) a) b),
""" + views.SQL["ld"] + " select i, j, round(r, 6) + 0.0 as r from ld where i = 3 or j = 3")
def constant_variant(spark, sf_dir):
    flat = views.dosage(spark, sf_dir).withColumn("dosage", F.when(F.col("variant_idx") == 3, 0.1).otherwise(F.col("dosage")))
    return gm.gram(standardize.standardize(flat)).where("i = 3 or j = 3").select("i", "j", rounded("r"))


# --- covariates --------------------------------------------------------------

SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DUMMIES = ", ".join(f"case when c_mktsegment = '{s}' then cast(1 as double) else cast(0 as double) end as \"c_mktsegment_{s}\"" for s in SEGMENTS)


@query(f"select c_custkey as sample_id, c_acctbal, {DUMMIES} from customer")
def covariates_onehot(spark, sf_dir):
    return cov.one_hot(views.covariates(spark, sf_dir, "c_mktsegment", "c_acctbal"))


@query("select c_custkey as sample_id, c_acctbal from customer")
def covariates_identifier_dropped(spark, sf_dir):
    return cov.one_hot(views.covariates(spark, sf_dir, "c_name", "c_acctbal"))


def _adjusted(spark, sf_dir, *columns: str, extra: dict[str, str] | None = None) -> DataFrame:
    x = cov.one_hot(views.covariates(spark, sf_dir, *columns))
    for name, text in (extra or {}).items():
        x = x.withColumn(name, F.expr(text))
    return gm.gram(projection.project(standardized_of(spark, sf_dir), projection.basis(x)))


# the fit of one numeric covariate is a slope; that of a factor, its groups' means
NUMERIC = with_views("dosage", "std") + """, x as (
  select c_custkey as sample_id, c_acctbal - avg(c_acctbal) over () as x from customer),
b as (select variant_idx, sum(z * x) / sum(x * x) as slope from std join x using (sample_id) group by 1),
res as (select sample_id, variant_idx, z - slope * x as z from std join x using (sample_id) join b using (variant_idx))
"""
FACTOR = with_views("dosage", "std") + """, res as (
  select sample_id, variant_idx, z - avg(z) over (partition by variant_idx, c_mktsegment) as z
  from std join customer on c_custkey = sample_id)
"""
MIXED = with_views("dosage", "std") + """, zx as (
  select sample_id, variant_idx, z - avg(z) over (partition by variant_idx, c_mktsegment) as z,
         c_acctbal - avg(c_acctbal) over (partition by variant_idx, c_mktsegment) as x
  from std join customer on c_custkey = sample_id),
b as (select variant_idx, sum(z * x) / sum(x * x) as slope from zx group by 1),
res as (select sample_id, variant_idx, z - slope * x as z from zx join b using (variant_idx))
"""
PAIRS = "select a.variant_idx as i, b.variant_idx as j, round(sum(a.z * b.z), 6) + 0.0 as r from res a join res b on a.sample_id = b.sample_id and a.variant_idx <= b.variant_idx group by 1, 2"


@query(NUMERIC + PAIRS)
def fwl_numeric(spark, sf_dir):
    return _adjusted(spark, sf_dir, "c_acctbal").select("i", "j", rounded("r"))


@query(FACTOR + PAIRS)
def fwl_categorical(spark, sf_dir):
    return _adjusted(spark, sf_dir, "c_mktsegment").select("i", "j", rounded("r"))


@query(MIXED + PAIRS)
def fwl_mixed(spark, sf_dir):
    return _adjusted(spark, sf_dir, "c_acctbal", "c_mktsegment").select("i", "j", rounded("r"))


@query(NUMERIC + PAIRS)
def fwl_rank_deficient(spark, sf_dir):
    return _adjusted(spark, sf_dir, "c_acctbal", extra={"again": "2 * c_acctbal"}).select("i", "j", rounded("r"))


@query(MIXED + PAIRS)
def fwl_by_sums(spark, sf_dir):
    z = standardized_of(spark, sf_dir)
    found = projection.basis(cov.one_hot(views.covariates(spark, sf_dir, "c_acctbal", "c_mktsegment")))
    return projection.adjusted_by_sums(z, found, gm.gram(z)).select("i", "j", rounded("r"))


@query(MIXED + "select variant_idx, round(sum(z * z), 6) + 0.0 as r from res group by 1")
def adjusted_diagonal(spark, sf_dir):
    return _adjusted(spark, sf_dir, "c_acctbal", "c_mktsegment").where("i = j").select(F.col("i").alias("variant_idx"), rounded("r"))


SAMPLES = "(select distinct o_custkey as sample_id from orders)"


@query(f"select s.sample_id, c_acctbal from {SAMPLES} s join customer on c_custkey = s.sample_id where c_acctbal > 1000")
def covariate_alignment(spark, sf_dir):
    samples = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id")).distinct()
    return cov.align(samples, views.covariates(spark, sf_dir, "c_acctbal").where("c_acctbal > 1000"))


@query(f"select s.sample_id from {SAMPLES} s where not exists (select 1 from customer where c_custkey = s.sample_id and c_acctbal > 1000)")
def missing_samples(spark, sf_dir):
    samples = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id")).distinct()
    return cov.missing_samples(samples, views.covariates(spark, sf_dir, "c_acctbal").where("c_acctbal > 1000"))


# --- selection ---------------------------------------------------------------

TARGET = "cast(idx as bigint) as idx, contig as chrom, position as pos, ref, alt"


@query(with_views("vindex") + f"select cast(idx as bigint) as ord, {TARGET}, concat(contig, ':', cast(position as varchar), ':', ref, ':', alt) as rsid, false as flipped from vindex where contig = '2' and position between 1100 and 1600")
def variants_in_region(spark, sf_dir):
    return selection.region_targets(views.variant_index(spark, sf_dir), "2:1100-1600")


@query(with_views("vindex") + f"select cast(idx as bigint) as ord, {TARGET}, concat('idx_', cast(idx as varchar)) as rsid, false as flipped from vindex where idx >= 10 and idx < 40")
def variants_idx_range(spark, sf_dir):
    return selection.range_targets(views.variant_index(spark, sf_dir), 10, 40)


@query("select k as ord, k as idx, '' as chrom, 0 as pos, '' as ref, '' as alt, concat('idx_', cast(k as varchar)) as rsid, false as flipped from (select unnest(range(5, 25)) as k) a")
def placeholder_targets(spark, sf_dir):
    return selection.placeholder_targets(spark, 5, 25)


MATCHED = """matched as (
select cast(ord as bigint) as ord, cast(idx as bigint) as idx, chromosome as chrom, zfile.position as pos, allele1 as ref, allele2 as alt, rsid, not (vindex.ref = allele1 and vindex.alt = allele2) as flipped
from zfile join vindex on contig = chromosome and vindex.position = zfile.position
 and ((vindex.ref = allele1 and vindex.alt = allele2) or (vindex.ref = allele2 and vindex.alt = allele1)))"""


@query(with_views("vindex", "zlist") + ", " + MATCHED.replace("zfile", "zlist") + " select * from matched")
def zfile_match(spark, sf_dir):
    index = views.variant_index(spark, sf_dir)
    return selection.match(views.whole_list(index), index)


@query(with_views("vindex", "zlist") + ", " + MATCHED.replace("zfile", "zlist") + " select * from zlist where not exists (select 1 from matched where matched.ord = zlist.ord)")
def zfile_missing(spark, sf_dir):
    index = views.variant_index(spark, sf_dir)
    listed = views.whole_list(index)
    return selection.unmatched(listed, selection.match(listed, index))


TWICE = "(select ord, position - position % 30 as position, 'A' as allele1, case when ord % 2 = 0 then 'C' else 'G' end as allele2 from zlist)"


@query(with_views("vindex", "zlist") + f""", l as {TWICE},
e as (select position, count(*) as n from l group by position, allele1, allele2), p as (select position, count(*) as n from l group by position)
select cast(coalesce((select sum(n) from e where n > 1), 0) as bigint) as n_exact, cast(coalesce((select sum(n) from p where n > 1), 0) as bigint) as n_position, cast(coalesce((select sum(n - 1) from p), 0) as bigint) as n_repeats""")
def zfile_duplicates(spark, sf_dir):
    listed = views.whole_list(views.variant_index(spark, sf_dir))
    changed = listed.withColumns({"position": F.col("position") - F.col("position") % 30, "allele1": F.lit("A"), "allele2": F.when(F.col("ord") % 2 == 0, "C").otherwise("G")})
    return selection.duplicates(changed)


@query(with_views("vindex", "zlist") + """select 'Variant filter: ' || count(*) || ' variants on chromosome ' || min(chromosome) || ' (positions ' || format('{:,}', min(position)) || ' - ' || format('{:,}', max(position)) || ')' as summary from zlist""")
def zfile_summary(spark, sf_dir):
    return spark.createDataFrame([(selection.summary(views.whole_list(views.variant_index(spark, sf_dir))),)], "summary string")


@query(with_views("vindex", "zlist") + """, l as (select ord, chromosome, case when ord = 4 then 'x' when ord = 7 then '1' else cast(position as varchar) end as position from zlist),
p as (select *, try_cast(position as bigint) as p, lag(try_cast(position as bigint)) over (order by ord) as q from l)
select count(*) as n_rows, count(distinct chromosome) as n_chromosomes, count(*) filter (p is null) as bad_positions, count(*) filter (q > p) as unsorted from p""")
def zfile_validate(spark, sf_dir):
    listed = views.whole_list(views.variant_index(spark, sf_dir))
    return selection.faults(listed.withColumn("position", F.when(F.col("ord") == 4, "x").when(F.col("ord") == 7, "1").otherwise(F.col("position").cast("string"))))


# --- extraction --------------------------------------------------------------

EXTRACT = ALL + ", " + MATCHED + """, cells as (
select least(p.ord, q.ord) as a, greatest(p.ord, q.ord) as b, r * case when p.flipped <> q.flipped then -1 else 1 end as r
from store join matched p on p.idx = store.i join matched q on q.idx = store.j),
grid as (select p.ord as a, q.ord as b from matched p join matched q on p.ord <= q.ord),
filled as (select a, b, r from grid left join cells using (a, b))
"""


def _banded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    index = views.variant_index(spark, sf_dir)
    store = gm.gram(standardized_of(spark, sf_dir)).where(F.col("j") - F.col("i") <= views.BAND)
    return store, selection.match(views.variant_list(index), index)


@query(EXTRACT + "select a, b, round(coalesce(r, cast('nan' as double)), 6) + 0.0 as r from filled")
def extract_ld_nan(spark, sf_dir):
    return ext.extract(*_banded(spark, sf_dir)).select("a", "b", rounded("r"))


@query(EXTRACT + "select a, b, round(coalesce(r, 0), 6) + 0.0 as r from filled union all select b, a, round(coalesce(r, 0), 6) + 0.0 from filled where a < b")
def extract_ld_zero(spark, sf_dir):
    return ext.extract(*_banded(spark, sf_dir), fill="zero", mirror=True).select("a", "b", rounded("r"))


@query(EXTRACT + "select cast(sum(case when r is not null then 0 when a = b then 1 else 2 end) as bigint) as n_missing from filled")
def offband_count(spark, sf_dir):
    return ext.missing_cells(*_banded(spark, sf_dir))


@query("""with t as (select cast(p_partkey as bigint) as idx from part), b as (select distinct cast(floor(idx / 64) as int) as b from t), n as (select cast(max(b) + 1 as bigint) as n from b)
select p.b as bi, q.b as bj from b p join b q on p.b <= q.b cross join n where (p.b + q.b * n) % 4 <> 1""")
def block_pairs(spark, sf_dir):
    """The store lacks each fourth block of its grid."""
    targets = views.variant_index(spark, sf_dir)
    n = targets.agg(F.max("idx")).first()[0] // 64 + 1
    stored = spark.range(n * n).where("id % 4 <> 1").withColumnRenamed("id", "linear")
    return ext.block_pairs(targets, 64, stored, n)


# --- the binary store --------------------------------------------------------


@query("""with n as (select count(*) as n from part), p as (select distinct l_partkey as i, l_orderkey % n as j from lineitem cross join n)
select cast(i as int) as i, cast(j as int) as j, cast(least(i, j) * n - least(i, j) * (least(i, j) + 1) // 2 + greatest(i, j) - least(i, j) - 1 as bigint) as place from p cross join n where i <> j""")
def triangular_index(spark, sf_dir):
    """A pair of parts from every order line, in the triangle of all parts."""
    n = views.table(spark, sf_dir, "part").count()
    pairs = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("int").alias("i"), (F.col("l_orderkey") % n).cast("int").alias("j")).distinct().where("i <> j")
    return pairs.select("i", "j", triangle.place(F.col("i"), F.col("j"), n).alias("place"))


def _encode_sql(width: int) -> str:
    top, scale = quantise.missing(width), quantise.shift(width)
    return LD + f"select i, j, cast(floor(least(greatest((round(r, 9) + 1) * {scale}.0::double, 0), {top - 1}.0::double)) as bigint) as code from ld where i < j"


def _encode(width: int) -> Query:
    def run(spark, sf_dir):
        ld = gm.gram(standardized_of(spark, sf_dir)).where("i < j")
        return ld.select("i", "j", quantise.encode(F.round("r", 9), width).alias("code"))

    return run


for _width in (1, 2, 4):
    QUERIES[f"bcor_encode_{_width}b"] = _encode(_width)
    ORACLES[f"bcor_encode_{_width}b"] = _encode_sql(_width)


@query(f"""with v as (select unnest([-1.5, -1, -0.25, 0, 0.5, 1, 1.5]::double[]) as r)
select r, cast(cast(greatest((r + 1) * {quantise.shift(8)}.0::double, 0) as decimal(38, 0)) as varchar) as code from v
union all select cast('nan' as double), '{quantise.missing(8)}'""")
def bcor_encode_8b(spark, sf_dir):
    values = spark.createDataFrame([(x,) for x in (-1.5, -1.0, -0.25, 0.0, 0.5, 1.0, 1.5, float("nan"))], "r double")
    return values.select("r", quantise.encode(F.col("r"), 8).cast("string").alias("code"))


@query(LD + f"select i, j, round(cast(cast(floor((round(r, 9) + 1) * {quantise.shift(2)}.0::double) as double) / {quantise.shift(2)} - 1 as float)::double, 6) + 0.0 as r from ld where i < j")
def bcor_decode_2b(spark, sf_dir):
    codes = _encode(2)(spark, sf_dir)
    return codes.select("i", "j", rounded(quantise.decode(F.col("code"), 2).cast("double"), "r"))


@query(with_views("vindex") + """, l as (select idx as "row", 24 + length(concat('rs', cast(idx as varchar))) + length(contig) + length(ref) + length(alt) as n from vindex)
select "row", cast(32 + sum(n) over (order by "row") - n as bigint) as start, cast(32 + sum(n) over (order by "row") as bigint) as stop from l""")
def bcor_meta_offsets(spark, sf_dir):
    from .codec.bcor import meta_offsets

    index = views.variant_index(spark, sf_dir)
    return meta_offsets(index.select(F.col("idx").alias("row"), F.concat(F.lit("rs"), F.col("idx").cast("string")).alias("rsid"), F.col("contig").alias("chrom"), "ref", "alt"))


#: What is asked for: the row of each hundredth part, by a number that the store may lack.
REQUEST = "request as (select cast(p_partkey as bigint) as ord, concat('rs', cast((p_partkey // 100 * 5) % 23 as varchar)) as rsid from part where p_partkey % 100 = 0)"
#: The matrix's own variants; and all parts, which the lookup itself needs no matrix for.
META = "meta as (select idx as \"row\", concat('rs', cast(idx as varchar)) as rsid from vindex where idx < 16)"
EVERY = "request as (select cast(p_partkey as bigint) as ord, concat('rs', cast(p_partkey * 3 as varchar)) as rsid from part), meta as (select idx as \"row\", concat('rs', cast(idx as varchar)) as rsid from vindex)"


def _request(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = views.table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    request = part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("rs"), ((F.col("p_partkey") / 100).cast("int") * 5 % 23).cast("string")).alias("rsid"))
    meta = views.variant_index(spark, sf_dir).where("idx < 16").select(F.col("idx").alias("row"), F.concat(F.lit("rs"), F.col("idx").cast("string")).alias("rsid"))
    return request, meta


@query(with_views("vindex") + f', {EVERY} select ord, rsid, coalesce("row", -1) as "row" from request left join meta using (rsid)')
def rsid_lookup(spark, sf_dir):
    name = lambda k: F.concat(F.lit("rs"), k.cast("string")).alias("rsid")
    request = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), name(F.col("p_partkey") * 3))
    return lookup.rows_of(request, views.variant_index(spark, sf_dir).select(F.col("idx").alias("row"), name(F.col("idx"))))


FOUND = f', {REQUEST}, {META}, f as (select ord, "row" from request join meta using (rsid)), cells as (select * from ld where i < j)'


@query(with_views("vindex", "dosage", "std", "ld") + FOUND + """
select x.ord as a, y.ord as b, round(case when x."row" = y."row" then 1 else cast(r as float)::double end, 5) + 0.0 as r
from f x cross join f y left join cells on i = least(x."row", y."row") and j = greatest(x."row", y."row")""")
def submatrix_pairs(spark, sf_dir):
    rows = lookup.resolve(*_request(spark, sf_dir), missing="skip")
    cells = gm.gram(standardized_of(spark, sf_dir)).where("i < j")
    return lookup.submatrix(rows, rows, cells).select("a", "b", (F.round(F.col("r").cast("double"), 5) + 0.0).alias("r"))


@query(with_views("vindex", "dosage", "std", "ld") + FOUND + """
select cast(m."row" as bigint) as a, y.ord as b, round(case when m."row" = y."row" then 1 else cast(r as float)::double end, 5) + 0.0 as r
from meta m cross join f y left join cells on i = least(m."row", y."row") and j = greatest(m."row", y."row")""")
def submatrix_rows(spark, sf_dir):
    request, meta = _request(spark, sf_dir)
    cells = gm.gram(standardized_of(spark, sf_dir)).where("i < j")
    return lookup.columns_of(lookup.resolve(request, meta, missing="skip"), meta, cells).select("a", "b", (F.round(F.col("r").cast("double"), 5) + 0.0).alias("r"))


@query("""with o as (select distinct l_orderkey % 64 as f, cast(l_partkey * 8 as bigint) as s from lineitem),
m as (select f, s, case when s - max(s + 8) over (partition by f order by s rows between unbounded preceding and 1 preceding) <= 64 then 0 else 1 end as fresh from o),
g as (select f, s, sum(fresh) over (partition by f order by s) as k from m)
select f as file, min(s) as start, max(s) + 8 as stop from g group by f, k""")
def merge_ranges(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 64).alias("file"), (F.col("l_partkey") * 8).alias("offset"))
    return triangle.merge_ranges(rows, 8, 64, ["file"])


@query(LD + """select concat(cast(i as varchar), chr(9), cast(j as varchar), chr(9), printf('%.6f', round(r, 9) + 0.0)) as line from ld""")
def long_lines(spark, sf_dir):
    from .sources.text import long_lines as lines

    return lines(gm.gram(standardized_of(spark, sf_dir)).withColumn("r", F.round("r", 9) + 0.0)).select("line")


@query(LD + """, sq as (select i, j, round(r, 9) + 0.0 as r from ld union all select j, i, round(r, 9) + 0.0 from ld where i < j)
select i, string_agg(printf('%.6f', r), chr(9) order by j) as line from sq group by i""")
def matrix_rows(spark, sf_dir):
    from .sources.text import matrix_lines

    return matrix_lines(gm.gram(standardized_of(spark, sf_dir)).withColumn("r", F.round("r", 9) + 0.0)).select("i", "line")


@query(with_views("vindex") + """select contig, cast(position as bigint) as position, ref, alt, cast(idx as bigint) as idx from vindex""")
def variant_index_build(spark, sf_dir):
    from .sources.variant_index import from_locus_table

    index = views.variant_index(spark, sf_dir)
    locus = index.select(F.struct(F.col("contig"), F.col("position").cast("long").alias("position")).alias("locus"), F.array("ref", "alt").alias("alleles"), F.col("idx").cast("long").alias("idx"))
    return from_locus_table(locus)


@query("""select event_type, count(*) as runs, round(median(value), 6) + 0.0 as median, round(avg(value), 6) + 0.0 as mean, round(stddev_pop(value), 6) + 0.0 as std, round(min(value), 6) + 0.0 as least, round(max(value), 6) + 0.0 as most,
round((median(value) / (select median(value) from events where event_type = (select min(event_type) from events)) - 1) * 100, 4) + 0.0 as change,
median(value) > 1.1 * (select median(value) from events where event_type = (select min(event_type) from events)) as slower from events group by event_type""")
def benchmark_rollup(spark, sf_dir):
    from .operators.rollup import compare

    return compare(views.table(spark, sf_dir, "events").select(F.col("event_type"), F.col("value")), "event_type", "value")
