"""Registered queries for scans, preparation, missing data, joins and shapes, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varve.functions import scalars as S
from varve.operators import joins as J
from varve.operators import missing as M
from varve.operators import prep as P
from varve.operators import shape as E
from varve.operators.splits import assign_split
from varve.plans.visits import FEATURES, PAIRS, VISITS_SQL, table, visits
from varve.roles import Settings
from varve.session import stage, stage_root
from varve.sources import readers, registry, sinks

BASE, YEAR2, YEAR3, YEAR4 = 1995, 1997, 1998, 1999
VISITS = {"baseline": BASE, "year2": YEAR2, "year3": YEAR3, "year4": YEAR4}
SEX = {1: "male", 2: "female", 3: "intersex_other"}
EDGES = (150_000, 300_000)
LABELS = ("Control", "Subclinical", "Clinical")
Q, O = {}, {}


def with_visits(sql: str) -> str:
    return f"with {VISITS_SQL.strip()}, {sql}" if not sql.lstrip().lower().startswith("select") else f"with {VISITS_SQL.strip()} {sql}"


def r6(col, name=None):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or (col if isinstance(col, str) else "value"))


def query(key, sql=None, cohort=True):
    """Register a query under its inventory id; `cohort` prefixes the SQL with the visits table."""

    def add(fn):
        Q[key] = fn
        if sql is not None:
            O[key] = with_visits(sql) if cohort else sql
        return fn

    return add


def fresh(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- A: scans, sources, sinks ---------------------------------------------------------------------


@query("A1_csv_scan", "select c_custkey, c_acctbal, c_mktsegment from customer", cohort=False)
def a1(spark, d):
    path = fresh(spark, "customer-csv")
    table(spark, d, "customer").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, ["c_custkey", "c_acctbal", "c_mktsegment", "absent"])


@query("A3_missing_visit", "select id, site, 1995 as yr from visits where yr = 1995")
def a3(spark, d):
    base = visits(spark, d).where(F.col("yr") == BASE).select("id", "site")
    return readers.with_visit(base, "yr", BASE).select("id", "site", F.col("yr").cast("long").alias("yr"))


def _three(spark, d):
    v = visits(spark, d)
    return [
        v.where("id % 5 <> 0").select("id", "yr", "site", "target"),
        v.where("id % 7 <> 0").select("id", "yr", "qc", "qty_lh", "qty_rh"),
        v.where(F.col("yr") == BASE).select("id", "age", "sex"),
    ]


THREE = """
a as (select id, yr, site, target from visits where id % 5 <> 0),
b as (select id, yr, qc, qty_lh, qty_rh from visits where id % 7 <> 0),
c as (select id, 1995 yr, age, sex from visits where yr = 1995)
"""


@query(
    "A4_merge_all",
    THREE + """select coalesce(a.id, b.id, c.id) id, coalesce(a.yr, b.yr, c.yr) yr, site, target, qc, qty_lh, qty_rh, age, sex
    from a full join b on a.id = b.id and a.yr = b.yr
    full join c on coalesce(a.id, b.id) = c.id and coalesce(a.yr, b.yr) = c.yr""",
)
def a4(spark, d):
    return readers.merge_all(_three(spark, d), ["id", "yr"], BASE)


@query("A6_split_union", "select o_orderkey, o_totalprice, case when o_orderstatus = 'F' then 'train' when o_orderstatus = 'O' then 'val' else 'test' end as split from orders where o_orderstatus in ('F','O','P')", cohort=False)
def a6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    folder = fresh(spark, "splits")
    sinks.save_tables(folder, **{n: o.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for n, s in (("train", "F"), ("val", "O"), ("test", "P"))})
    return readers.read_splits(spark, folder)


@query("A7_run_scoped_sink", "select id, yr, target from visits")
def a7(spark, d):
    folder = sinks.run_path(fresh(spark, "out"), "anxiety", "run-1", 42, "datasets")
    sinks.save_tables(folder, include_csv=True, cohort=visits(spark, d).select("id", "yr", "target"))
    return readers.read_csv(spark, f"{folder}/cohort.csv", schema=spark.read.parquet(f"{folder}/cohort.parquet").schema)


@query("A5_dictionary", "select 'part_' || p_partkey as feature, p_name as label from part", cohort=False)
def a5(spark, d):
    folder = fresh(spark, "dictionary")
    named = table(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("var_name"), F.col("p_name").alias("var_label"))
    named.write.csv(folder, header=True)
    return readers.read_dictionary(spark, folder)


@query("A8_qc_sink", "select id, yr, qc, coalesce(qc <= 6, false) as qc_pass, case when qc is null then 'missing_surface_holes' when qc > 6 then 'surface_holes_gt_threshold' end as qc_reason from visits")
def a8(spark, d):
    folder = fresh(spark, "qc")
    annotated, mask = P.quality_control(visits(spark, d).select("id", "yr", "qc"), ["id", "yr"], "qc", 6)
    sinks.save_qc(folder, annotated, mask)
    return spark.read.parquet(f"{folder}/artifacts/qc/qc_mask.parquet")


SPLIT_CTE = """
k as (select id, yr, qc, md5(concat_ws('|', '42', 'split', id, yr)) h,
  coalesce(case when target <= 150000 then 'Control' when target <= 300000 then 'Subclinical' when target > 300000 then 'Clinical' end, 'unknown') s
  from visits where qc <= 6),
r as (select *, row_number() over (partition by s order by h, id, yr) rn, count(*) over (partition by s) n from k),
split_map as (select id, yr, s, case when rn <= round(n * 0.8) then 'train' when rn <= round(n * 0.9) then 'val' else 'test' end as split from r)
"""


def qc_visits(spark, d):
    """Visits with QC marks and group label, written once: the mask, the cuts and the split all read it."""
    v = visits(spark, d).select("id", "yr", "qc", "target")
    v, _ = P.quality_control(v, ["id", "yr"], "qc", 6)
    return stage(P.binning(v, "target", "grp", EDGES, LABELS))


def split_visits(checked):
    return assign_split(checked.where("qc_pass"), ["id", "yr"], (0.8, 0.1, 0.1), strata=["grp"])


@query("A9_split_map_sink", SPLIT_CTE + "select id, yr, split from split_map")
def a9(spark, d):
    folder = fresh(spark, "map")
    sinks.save_split_map(folder, split_visits(qc_visits(spark, d)).select("id", "yr", "split"))
    return spark.read.parquet(f"{folder}/artifacts/splits/split_map.parquet")


@query(
    "A10_provenance",
    SPLIT_CTE + """,
    m as (select case when qc is null then 'missing_surface_holes' when qc > 6 then 'surface_holes_gt_threshold' else 'pass' end reason from visits)
    select 'reason' as kind, reason as name, count(*) as n from m group by reason
    union all select 'count', 'total', count(*) from m
    union all select 'count', 'pass', count(*) from m where reason = 'pass'
    union all select 'count', 'fail', count(*) from m where reason <> 'pass'
    union all select 'split', split, count(*) from split_map group by split""",
)
def a10(spark, d):
    checked = qc_visits(spark, d)
    return sinks.provenance(checked.select("id", "yr", "qc", "qc_pass", "qc_reason"), split_visits(checked))


@query(
    "A11_harmonized_summary",
    """t as (select case when o_orderstatus = 'F' then 'train' else 'test' end split, o_orderpriority site, o_totalprice a, sqrt(o_totalprice) b from orders)
    select 'sites/' || split as scope, site as name, cast(count(*) as double) as value from t group by split, site
    union all select 'variance/' || split, 'a', round(var_pop(a), 2) from t group by split
    union all select 'variance/' || split, 'b', round(var_pop(b), 2) from t group by split
    union all select 'features/' || split, 'count', 2.0 from t group by split""".replace("t as (", "with t as (", 1),
    cohort=False,
)
def a11(spark, d):
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("split"),
        F.col("o_orderpriority").alias("site"), F.col("o_totalprice").alias("a"), F.sqrt("o_totalprice").alias("b"),
    )
    folder = fresh(spark, "harm")
    sinks.save_harmonized(folder, o)
    back = sinks.load_harmonized(spark, folder)
    return sinks.harmonized_summary(back, ["a", "b"]).withColumn("value", F.round("value", 2))


def _runs(spark, d):
    path = fresh(spark, "runs")
    o = table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("run_name"),
        F.col("o_custkey").alias("seed"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        F.col("o_orderstatus").alias("git_commit"), F.lit("c0").alias("config_hash"), F.lit("").alias("description"),
        F.lit("").alias("changes_from_last_run"), F.col("o_totalprice").alias("pearson_r"),
        F.lit(None).cast("double").alias("pearson_p_emp"), F.lit(None).cast("long").alias("n_samples"), F.lit("svr").alias("model_name"),
    )
    rows.write.mode("append").parquet(path)
    return registry.load_runs(spark, path)


@query("A12_list_runs", "select cast(o_orderkey as varchar) as run_id, o_orderpriority as run_name, strftime(o_orderdate, '%Y-%m-%d') as timestamp from orders where o_orderpriority = '1-URGENT'", cohort=False)
def a12(spark, d):
    return registry.list_runs(_runs(spark, d), "1-URGENT").select("run_id", "run_name", "timestamp")


@query(
    "A12_compare_runs",
    """with a as (select * from orders where o_orderkey = (select min(o_orderkey) from orders)),
    b as (select * from orders where o_orderkey = (select max(o_orderkey) from orders)),
    f as (select 'seed' as field, cast(a.o_custkey as varchar) as run_a, cast(b.o_custkey as varchar) as run_b from a, b
      union all select 'git_commit', a.o_orderstatus, b.o_orderstatus from a, b
      union all select 'pearson_r', cast(a.o_totalprice as varchar), cast(b.o_totalprice as varchar) from a, b)
    select * from f where run_a is distinct from run_b""",
    cohort=False,
)
def a12b(spark, d):
    runs = _runs(spark, d)
    ends = runs.agg(F.min(F.col("run_id").cast("long")).alias("a"), F.max(F.col("run_id").cast("long")).alias("b")).first()
    return registry.compare_runs(runs, str(ends["a"]), str(ends["b"]))


@query("A13_importance_sink", "select o_orderpriority as feature, round(sum(o_totalprice), 2) as importance from orders group by 1", cohort=False)
def a13(spark, d):
    imp = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(F.round(F.sum("o_totalprice"), 2).alias("importance"))
    path = fresh(spark, "importance")
    sinks.save_importance(path, imp)
    return readers.read_csv(spark, path)


# --- B: projections, filters, scalars --------------------------------------------------------------


@query("B1_baseline", "select id, target from visits where yr = 1995")
def b1(spark, d):
    return P.timepoint_split(visits(spark, d), "yr", BASE)[0].select("id", "target")


@query("B2_recode", "select id, yr, case sex when '1' then 'male' when '2' then 'female' end as sex_mapped from visits")
def b2(spark, d):
    return P.recode(visits(spark, d), "sex", "sex_mapped", {1: "male", "2": "female"}).select("id", "yr", "sex_mapped")


@query("B3_binning", "select id, yr, case when target <= 150000 then 'Control' when target <= 300000 then 'Subclinical' when target > 300000 then 'Clinical' end as grp from visits")
def b3(spark, d):
    return P.binning(visits(spark, d), "target", "grp", EDGES, LABELS).select("id", "yr", "grp")


@query(
    "B4_comorbid",
    """g as (select id, yr, case when target <= 150000 then 'Control' when target <= 300000 then 'Subclinical' when target > 300000 then 'Clinical' end a,
    case when qty_lh <= 40 then 'Control' when qty_lh <= 70 then 'Subclinical' when qty_lh > 70 then 'Clinical' end b from visits)
    select id, yr, case when a = 'Clinical' or b = 'Clinical' then 'Clinical' when a = 'Subclinical' or b = 'Subclinical' then 'Subclinical'
    when a = 'Control' and b = 'Control' then 'Control' end as comorbid_group from g""",
)
def b4(spark, d):
    v = P.binning(visits(spark, d), "target", "anx_group", EDGES, LABELS)
    v = P.binning(v, "qty_lh", "psych_group", (40, 70), LABELS)
    return P.comorbid_group(v).select("id", "yr", "comorbid_group")


HISTORY_SQL = """with e as (select event_id, cast(user_id % 3 as varchar) a, case when event_type = 'click' then '1' when event_type = 'error' then 'n/a' else '0' end b,
 cast(event_id % 2 as varchar) c, case when value > 50 then 1 else 0 end m from events)
 select event_id, cast(a = '1' or b = '1' or c = '1' as int) as fhx_psychosis_any, cast(a = '1' or b = '1' as int) as fhx_psychosis_parent,
 cast(a = '1' as int) + cast(b = '1' as int) + cast(c = '1' as int) as fhx_psychosis_count, m as fhx_mania_any from e"""


@query("B5_family_history", HISTORY_SQL, cohort=False)
def b5(spark, d):
    e = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 3).cast("string").alias("qa"),
        F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "error", "n/a").otherwise("0").alias("qb"),
        (F.col("event_id") % 2).cast("string").alias("qc"), F.when(F.col("value") > 50, "1").otherwise("0").alias("qm"),
    )
    return P.family_history(e, ["event_id"], {"psychosis": ["qa", "qb", "qc", "gone"], "mania": ["qm"]}, "broad", parents=["qa", "qb"])


@query("B6_quality_control", O["A8_qc_sink"], cohort=False)
def b6(spark, d):
    return P.quality_control(visits(spark, d), ["id", "yr"], "qc", 6)[1]


AI_SQL = ", ".join(
    f"round(case when abs({l}+{r}) >= 1e-6 then ({l}-{r})/({l}+{r}) end, 6) as {n}_AI" for n, l, r in PAIRS
)
TOTAL_SQL = ", ".join(f"round({l}+{r}, 6) as {n}_total" for n, l, r in PAIRS)
AI = [f"{n}_AI" for n, _, _ in PAIRS]
TOTAL = [f"{n}_total" for n, _, _ in PAIRS]


@query("B9_asymmetry", f"select id, yr, {AI_SQL}, {TOTAL_SQL} from visits")
def b9(spark, d):
    return P.asymmetry_table(visits(spark, d), ["id", "yr"], PAIRS).select("id", "yr", *[r6(c) for c in AI + TOTAL])


@query(
    "B10_lateralization_sets",
    f"""w as (select id, yr, {AI_SQL}, {TOTAL_SQL}, round(qty_lh, 6) qty_lh from visits)
    select 'ai' as set_name, count(qty_AI) as n, round(sum(qty_AI), 4) as total from w
    union all select 'total', count(qty_total), round(sum(qty_total), 4) from w
    union all select 'ai_total', count(qty_AI), round(sum(qty_AI), 4) from w
    union all select 'raw', count(qty_lh), round(sum(qty_lh), 4) from w""",
)
def b10(spark, d):
    sets = P.lateralization_sets(visits(spark, d), ["id", "yr"], PAIRS)
    picks = {"ai": "qty_AI", "total": "qty_total", "ai_total": "qty_AI", "raw": "qty_lh"}
    return J.union_all({n: s.select(F.round(picks[n], 6).alias("x")) for n, s in sets.items()}, "set_name").groupBy("set_name").agg(
        F.count("x").alias("n"), F.round(F.sum("x"), 4).alias("total")
    )


@query("B13_extreme_groups", "select id, yr, case when target >= 400000 then 'High' when target <= 100000 then 'Low' end as extreme, case when sex = '1' then 'High' when sex in ('2','3') then 'Low' end as listed from visits")
def b13(spark, d):
    return visits(spark, d).select(
        "id", "yr", S.extreme_group(F.col("target"), 100_000, 400_000).alias("extreme"),
        S.extreme_group(F.col("sex"), low_values=["2", "3"], high_values=["1"]).alias("listed"),
    )


@query("B14_task_filter", "select id, yr, cast(target > 300000 as int) as y from visits where target <= 150000 or target > 300000")
def b14(spark, d):
    v = P.binning(visits(spark, d), "target", "grp", EDGES, LABELS)
    return P.task_filter(v, "grp", "Clinical", "Control").select("id", "yr", "y")


@query("B15_target_filter", "select id, yr from visits where qty_lh is not null and sex in ('1','2') and site is not null and disc_lh is not null")
def b15(spark, d):
    v = P.recode(visits(spark, d), "sex", "sex_mapped", SEX)
    return P.target_filter(v, "qty_lh", "sex_mapped", ["site", "disc_lh"]).select("id", "yr")


@query("B16_range_filter", "select id, yr, target from visits where id in (select id from visits where yr = 1995 and target >= 100000 and target < 300000) and target >= 50000 and target < 400000")
def b16(spark, d):
    v = P.baseline_range_filter(visits(spark, d), "id", "yr", BASE, "target", 100_000, 300_000)
    return P.range_filter(v, "target", 50_000, 400_000).select("id", "yr", "target")


@query("B17_iqr_filter", "q as (select quantile_cont(target, 0.25) a, quantile_cont(target, 0.75) b from visits) select id, yr, target from visits, q where target >= a - 0.75 * (b - a) and target <= b + 0.75 * (b - a)")
def b17(spark, d):
    return P.iqr_filter(visits(spark, d).select("id", "yr", "target"), "target", 0.75)


@query("B18_small_sites", "select id, yr, family from visits where family not in (select family from visits group by family having count(*) < 10)")
def b18(spark, d):
    return P.drop_small_groups(visits(spark, d).select("id", "yr", "family"), "family", 10)


@query(
    "B19_backfill",
    """b as (select id, max(sex) sex, max(qty_lh) q from visits where yr = 1995 group by id)
    select v.id, v.yr, v.disc_lh as age, coalesce(case when v.yr <> 1995 then null else v.sex end, b.sex) as sex
    from visits v left join b on b.id = v.id where v.disc_lh is not null and coalesce(case when v.yr <> 1995 then null else v.sex end, b.sex) is not null""",
)
def b19(spark, d):
    v = visits(spark, d).select("id", "yr", "age", "disc_lh", F.when(F.col("yr") == BASE, F.col("sex")).alias("sex"))
    out = P.backfill_from_baseline(v, "id", "yr", BASE, {"age": "disc_lh"}, ["sex"])
    return out.dropna("any", subset=["age", "sex"]).select("id", "yr", "age", "sex")


@query("B20_clip", "select event_id, greatest(value - 20, 0) as yhat from events", cohort=False)
def b20(spark, d):
    return P.clip_predictions(table(spark, d, "events").select("event_id", (F.col("value") - 20).alias("yhat")))


@query(
    "B21_codes",
    "c as (select site, row_number() over (order by site) - 1 as k from (select distinct site from visits where yr = 1995)) select v.id, v.yr, coalesce(c.k, -1) as site_code from visits v left join c on c.site = v.site",
)
def b21(spark, d):
    v = visits(spark, d).select("id", "yr", "site")
    return P.apply_codes(v, P.fit_codes(v.where(F.col("yr") == BASE), "site"), "site").select("id", "yr", F.col("site_code").cast("long").alias("site_code"))


@query("B22_constant_covariates", "select column_name from (select 'age' as column_name, count(distinct age) n from visits where yr = 1995 union all select 'yr', count(distinct yr) from visits where yr = 1995 union all select 'qc', count(distinct qc) from visits where yr = 1995) where n > 1")
def b22(spark, d):
    base = visits(spark, d).where(F.col("yr") == BASE)
    live = P.varying(base, ["age", "yr", "qc"])
    return base.select(F.explode(F.array(*map(F.lit, live))).alias("column_name")).distinct()


@query(
    "B23_scalars",
    """select p_partkey, starts_with(p_name, 'a') as starts, ends_with(p_type, 'L') as ends, substring(p_name, 2, 3) as mid, split_part(p_type, ' ', 1) as word,
    replace(p_name, 'a', 'x') as swapped, try_cast(p_brand as double) as num, cast(trunc(p_retailprice) as bigint) as whole,
    least(greatest(p_retailprice, 950), 1200) as clipped, abs(p_size - 25) as away, cast(sign(p_size - 25) as int) as side, round(sqrt(p_retailprice), 6) as root,
    round(atanh(p_size / 100.0), 6) as z, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) as logistic, round(p_retailprice, 1) as rounded from part""",
    cohort=False,
)
def b23(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.startswith("p_name", F.lit("a")).alias("starts"), F.endswith("p_type", F.lit("L")).alias("ends"),
        F.substring("p_name", 2, 3).alias("mid"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word"),
        F.replace("p_name", F.lit("a"), F.lit("x")).alias("swapped"), S.number(F.col("p_brand")).alias("num"),
        F.col("p_retailprice").cast("long").alias("whole"), S.clip(F.col("p_retailprice"), 950, 1200).alias("clipped"),
        F.abs(F.col("p_size") - 25).alias("away"), F.signum(size - 25).cast("int").alias("side"), r6(F.sqrt("p_retailprice"), "root"),
        r6(F.atanh(size / 100), "z"), r6(S.expit((size - 25) / 10), "logistic"), F.round("p_retailprice", 1).alias("rounded"),
    )


@query(
    "B24_concordance",
    f"""w as (select id, yr, {", ".join(f"case when abs({l}+{r}) >= 1e-6 then ({l}-{r})/({l}+{r}) end as {n}" for n, l, r in PAIRS)} from visits)
    select id, yr, round((abs(qty) + abs(price) + abs(disc)) / 3, 6) as burden, round(abs((sign(qty) + sign(price) + sign(disc)) / 3.0), 6) as agreement from w""",
)
def b24(spark, d):
    burden, agreement = S.concordance([S.asymmetry(F.col(l), F.col(r)) for _, l, r in PAIRS])
    return visits(spark, d).select("id", "yr", r6(burden, "burden"), r6(agreement, "agreement"))


@query(
    "B25_embedding_metadata",
    """select id, yr, qc, coalesce(case when id % 3 = 0 then site end, 'maker') as scanner, site as "group", cast(trunc(age) as int) as age,
    case sex when '1' then 'male' when '2' then 'female' else 'Unknown' end as sex from visits""",
)
def b25(spark, d):
    v = visits(spark, d).withColumns({"model": F.when(F.col("id") % 3 == 0, F.col("site")), "maker": F.lit("maker")})
    return P.embedding_metadata(v, ["id", "yr"], "qc", "model", "maker", "site", "age", "sex", {1: "male", 2: "female"})


# --- C: missing data -------------------------------------------------------------------------------

MISS = ["qc", *FEATURES]


@query("C1_missing_summary", " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as missing, round((count(*) - count({c})) / count(*), 6) as rate from visits" for c in MISS))
def c1(spark, d):
    return M.missing_summary(visits(spark, d).select(*MISS)).select("column", "missing", r6("rate"))


@query("C2_missing_rows", "select id, yr from visits where qc is null or qty_lh is null or disc_rh is null")
def c2(spark, d):
    return M.missing_rows(visits(spark, d), ["qc", "qty_lh", "disc_rh"]).select("id", "yr")


@query("C3_drop_sparse_columns", "select id, yr, disc_lh, disc_rh from visits")
def c3(spark, d):
    v = visits(spark, d).select("id", "yr", *FEATURES)
    return M.drop_sparse_columns(v, FEATURES, _sparse_cut(v))[0]


def _sparse_cut(v):
    """A threshold between the null rates of the discount and the quantity columns."""
    rates = M.null_rates(v, FEATURES)
    disc = max(rates["disc_lh"], rates["disc_rh"])
    other = min(rates[c] for c in FEATURES if not c.startswith("disc"))
    return (disc + other) / 2 if disc < other else disc


@query("C4_drop_incomplete_rows", "select id, yr, qty_lh, qty_rh from visits where qty_lh is not null and qty_rh is not null")
def c4(spark, d):
    return M.drop_incomplete_rows(visits(spark, d).select("id", "yr", "qty_lh", "qty_rh"), ["qty_lh", "qty_rh"])


@query("C5_required_metadata", "select id, yr from visits where age is not null and qc is not null")
def c5(spark, d):
    return M.require_metadata(visits(spark, d), ["age", "qc", "absent"]).select("id", "yr")


@query(
    "C6_complete_families",
    """select 'qty' as stage, count(*) filter (where qty_lh is null or qty_rh is null) as removed from visits
    union all select 'disc', count(*) filter (where qty_lh is not null and qty_rh is not null and (disc_lh is null or disc_rh is null)) from visits""",
)
def c6(spark, d):
    v = visits(spark, d)
    s = Settings(families=("qty", "disc"), prefixes=(("qty", ("qty_",)), ("disc", ("disc_",))))
    return M.removed_counts(v, M.family_columns(v, s))


@query("C7_handle_missing", "select id, yr, qty_lh, qty_rh, price_lh, price_rh, disc_lh, disc_rh from visits where age is not null and qc is not null and qty_lh is not null and qty_rh is not null and price_lh is not null and price_rh is not null and disc_lh is not null and disc_rh is not null")
def c7(spark, d):
    s = Settings(required=("age", "qc"), families=("qty",), prefixes=(("qty", ("qty_",)),), max_null_rate=0.9)
    v = visits(spark, d).withColumn("empty", F.lit(None).cast("double"))
    return M.handle_missing(v, s, protected=["id", "yr", "site", "family", "age", "sex", "target", "qc"])[0].select("id", "yr", *FEATURES)


@query(
    "C8_forward_fill",
    """with e as (select event_id, user_id, ts, case when event_type <> 'error' then value end v from events)
    select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as v from e""",
    cohort=False,
)
def c8(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return M.forward_fill(e, "user_id", ["ts", "event_id"], ["v"], bucket=F.date_trunc("day", "ts")).select("event_id", "v")


@query(
    "C9_attrition",
    """select site as "group", count(*) as pre_qc, count(*) filter (where qc <= 6) as post_qc, count(*) filter (where qc <= 6 and qty_lh is not null) as final,
    round(100.0 * (count(*) - count(*) filter (where qc <= 6)) / count(*), 2) as removed_qc_pct,
    round(100.0 * (count(*) - count(*) filter (where qc <= 6 and qty_lh is not null)) / count(*), 2) as removed_total_pct from visits group by site""",
)
def c9(spark, d):
    ok = F.coalesce(F.col("qc") <= 6, F.lit(False))
    return M.attrition(visits(spark, d), "site", ok, ok & F.col("qty_lh").isNotNull())


# --- D: joins and set operations -------------------------------------------------------------------


@query("D1_full_outer", THREE + "select coalesce(a.id, b.id) id, coalesce(a.yr, b.yr) yr, site, target, qc, qty_lh, qty_rh from a full join b on a.id = b.id and a.yr = b.yr")
def d1(spark, d):
    return readers.merge_all(_three(spark, d)[:2], ["id", "yr"], BASE)


@query("D2_label_features", "select p_partkey as feature, coalesce(case when p_size > 25 then p_type end, cast(p_partkey as varchar)) as label from part", cohort=False)
def d2(spark, d):
    p = table(spark, d, "part")
    feats = p.select(F.col("p_partkey").cast("string").alias("feature"))
    dic = p.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_type").alias("label"))
    return J.label_features(feats, dic).select(F.col("feature").cast("long").alias("feature"), "label")


@query("D4_with_follow_up", "select a.id, a.target, b.target as score_fu from visits a join visits b on a.id = b.id where a.yr = 1995 and b.yr = 1997")
def d4(spark, d):
    return J.with_follow_up(visits(spark, d), "id", "yr", BASE, YEAR2, "target").select("id", "target", "score_fu")


@query("D5_keep_known", "select v.id, v.yr, c.c_nationkey as nation from visits v left join (select c_custkey, case when c_nationkey < 20 then c_nationkey end c_nationkey from customer) c on c.c_custkey = v.id where c.c_nationkey is not null")
def d5(spark, d):
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"))
    return J.keep_known(visits(spark, d), other, "id", "nation").select("id", "yr", "nation")


WIDE_SQL = ", ".join(f"max(case when yr = {v} then target end) as target_{n}" for n, v in VISITS.items())


@query("D6_wide_assembly", f"select id, {WIDE_SQL}, max(case when yr = 1995 then age end) as age, max(case when yr = 1995 then site end) as site from visits where yr in (1995, 1997, 1998, 1999) group by id")
def d6(spark, d):
    return J.wide_assembly(visits(spark, d), "id", "yr", "target", VISITS, ["age", "site"])


@query("D7_semi_join", "select id, yr from visits where id in (select id from visits where yr = 1997)")
def d7(spark, d):
    v = visits(spark, d).select("id", "yr")
    return J.within(v, v.where(F.col("yr") == YEAR2).select("id").distinct(), "id")


@query("D8_anti_join", "select id, yr from visits where id not in (select id from visits where yr = 1997)")
def d8(spark, d):
    v = visits(spark, d).select("id", "yr")
    return J.without(v, v.where(F.col("yr") == YEAR2).select("id").distinct(), "id")


@query("D9_lookup", "select v.id, v.yr, coalesce(case when v.yr = 1995 then v.qty_lh end, b.q) as qty_lh from visits v left join (select id, arg_min(qty_lh, yr) q from visits where qty_lh is not null group by id) b on b.id = v.id")
def d9(spark, d):
    v = visits(spark, d)
    src = v.where(F.col("qty_lh").isNotNull()).select("id", "yr", "qty_lh")
    return J.lookup(v.select("id", "yr", F.when(F.col("yr") == BASE, F.col("qty_lh")).alias("qty_lh")), src, "id", "qty_lh", "yr")


@query("D10_intersect", "select id from visits where yr = 1995 intersect select id from visits where yr = 1997")
def d10(spark, d):
    return J.visits_of_all(visits(spark, d), "id", "yr", [BASE, YEAR2])


@query("D11_union_all", "select id, 'baseline' as visit from visits where yr = 1995 union all select id, 'year2' from visits where yr = 1997")
def d11(spark, d):
    v = visits(spark, d).select("id", "yr")
    return J.union_all({n: v.where(F.col("yr") == y).select("id") for n, y in (("baseline", BASE), ("year2", YEAR2))}, "visit")


@query("D12_first_per_key", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1", cohort=False)
def d12(spark, d):
    return J.first_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("D13_paired_visits", "select a.id, a.target as target_1, b.target as target_2, a.qty_lh as qty_lh_1, b.qty_lh as qty_lh_2 from visits a join visits b on a.id = b.id where a.yr = 1995 and b.yr = 1997")
def d13(spark, d):
    return J.paired(visits(spark, d), "id", "yr", BASE, YEAR2, ["target", "qty_lh"])


# --- E: aggregation, pivot, sort -------------------------------------------------------------------


@query("E1_value_counts", "select qc, count(*) as n from visits group by qc")
def e1(spark, d):
    return E.value_counts(visits(spark, d), "qc")


@query("E2_describe", " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min, max({c}) as max from lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")), cohort=False)
def e2(spark, d):
    return E.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "E3_family_statistics",
    """f as (select family, count(distinct id) n from visits group by family)
    select 'families' as stat, count(*) as value from f union all select 'sibling_families', count(*) filter (where n > 1) from f
    union all select 'sibling_subjects', cast(sum(n) filter (where n > 1) as bigint) from f""",
)
def e3(spark, d):
    return E.family_statistics(visits(spark, d), "family", "id")


# The levels of o_orderpriority.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("E4_crosstab", "select o_orderstatus, " + ", ".join(f"count(*) filter (where o_orderpriority = '{p}') as \"o_orderpriority_{p}\"" for p in PRIORITIES) + " from orders group by 1", cohort=False)
def e4(spark, d):
    return E.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)


QCUT = "q as (select quantile_cont(target, 0.2) a, quantile_cont(target, 0.4) b, quantile_cont(target, 0.6) c, quantile_cont(target, 0.8) d from visits)"
QBIN = "cast(target > q.a as int) + cast(target > q.b as int) + cast(target > q.c as int) + cast(target > q.d as int)"


@query("E5_quantile_bin", f"{QCUT} select id, yr, {QBIN} as bin from visits, q")
def e5(spark, d):
    return E.quantile_bin(visits(spark, d).select("id", "yr", "target"), "target", 5).select("id", "yr", "bin")


@query(
    "E6_tercile_means",
    """q as (select quantile_cont(target, 1/3::double) a, quantile_cont(target, 2/3::double) b from visits)
    select cast(target > a as int) + cast(target > b as int) as bin, count(qty_lh) as n, round(avg(qty_lh), 6) as mean, round(stddev_samp(qty_lh) / sqrt(count(qty_lh)), 6) as sem from visits, q group by 1""",
)
def e6(spark, d):
    return E.tercile_means(visits(spark, d), "target", "qty_lh").select("bin", "n", r6("mean"), r6("sem"))


@query("E7_quantiles", " union all ".join(f"select l_returnflag, cast({p} as double) as prob, round(quantile_cont(l_extendedprice, {p}), 6) as value from lineitem group by 1" for p in (0.025, 0.25, 0.5, 0.75, 0.975)), cohort=False)
def e7(spark, d):
    return E.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.025, 0.25, 0.5, 0.75, 0.975], ["l_returnflag"]).select("l_returnflag", "prob", r6("value"))


@query("E8_top_k", "select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 20", cohort=False)
def e8(spark, d):
    return E.top_k(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 20, "c_custkey", absolute=True)


@query(
    "E9_pivot_melt",
    f"w as (select id, {WIDE_SQL} from visits where yr in (1995,1997,1998,1999) group by id) "
    + " union all ".join(f"select id, '{n}' as visit, target_{n} as value from w" for n in VISITS),
)
def e9(spark, d):
    wide = J.pivot_visits(visits(spark, d), "id", "yr", "target", VISITS)
    names = {n: F.col(f"target_{n}").alias(n) for n in VISITS}
    return E.melt(wide.select("id", *names.values()), ["id"], list(names), "visit", "value")


@query("E10_visit_index", "select id, yr, case yr when 1995 then 0 when 1997 then 1 when 1998 then 2 when 1999 then 3 end as tp_idx from visits")
def e10(spark, d):
    return visits(spark, d).select("id", "yr", J.visit_index(F.col("yr"), list(VISITS.values())).alias("tp_idx")).sortWithinPartitions("id", "tp_idx")


@query("E11_best_signed", "select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by abs(c_acctbal) desc, c_custkey) = 1", cohort=False)
def e11(spark, d):
    return E.best_signed(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal")


@query("E12_top_variance", "select * from (" + " union all ".join(f"select '{c}' as feature, round(var_samp({c}), 6) as variance from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ") order by variance desc limit 2", cohort=False)
def e12(spark, d):
    return E.top_variance(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2).select("feature", F.round("variance", 6).alias("variance"))


@query(
    "E13_histogram",
    """with e as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem)
    select l_returnflag, cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) as int) as bin, count(*) as n from lineitem, e group by 1, 2""",
    cohort=False,
)
def e13(spark, d):
    return E.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50, ["l_returnflag"])


@query(
    "E14_group_means",
    "s as (select * from visits where id in (select id from visits where yr = 1997)) "
    + " union all ".join(f"select '{c}' as feature, count({c}) as n, round(avg({c}), 6) as mean, round(stddev_pop({c}) / sqrt(count({c})), 6) as se from s" for c in ("qty_lh", "disc_rh")),
)
def e14(spark, d):
    v = visits(spark, d)
    ids = v.where(F.col("yr") == YEAR2).select("id").distinct()
    return E.group_means(v, ids, "id", ["qty_lh", "disc_rh"]).select("feature", "n", r6("mean"), r6("se"))


@query("E16_visit_counts", "select id, count(distinct yr) as visits from visits group by id having count(distinct yr) >= 2")
def e16(spark, d):
    return E.visit_counts(visits(spark, d), "id", "yr")


def _model_metrics(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 4).alias("task"),
        F.when(F.col("event_id") % 2 == 0, "balanced_accuracy").otherwise("roc_auc").alias("metric"), "value",
    )


@query("E17_model_comparison", "select event_type as model, round(avg(value) filter (where event_id % 2 = 0), 6) as avg_bal_acc, round(avg(value) filter (where event_id % 2 = 1), 6) as avg_roc_auc, count(distinct user_id % 4) as tasks from events group by 1", cohort=False)
def e17(spark, d):
    return E.model_comparison(_model_metrics(spark, d)).select("model", r6("avg_bal_acc"), r6("avg_roc_auc"), "tasks")


@query("E17_task_metrics", "select event_type as model, user_id % 4 as task, max(value) filter (where event_id % 2 = 0) as balanced_accuracy, max(value) filter (where event_id % 2 = 1) as roc_auc from events group by 1, 2", cohort=False)
def e17b(spark, d):
    return E.task_metrics(_model_metrics(spark, d), ["balanced_accuracy", "roc_auc"])
