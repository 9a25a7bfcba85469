"""Registered queries for resampling, association and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.functions import effects as X
from varve.functions import scalars as S
from varve.operators import association as A
from varve.operators import evaluation as V
from varve.operators import resample as R
from varve.operators import shape as E
from varve.operators import splits as L
from varve.functions.hashing import POISSON_CUTS
from varve.plans.catalog_prep import AI, BASE, QBIN, YEAR2, O, query, r6
from varve.plans.catalog_prep import SPLIT_CTE, qc_visits, split_visits
from varve.plans.visits import FEATURES, PAIRS, table, visits



def cohort_ai(spark, d):
    """Visits with asymmetry columns beside the raw ones."""
    return visits(spark, d).select("*", *S.asymmetry_columns(PAIRS))


AI_CTE = "ai as (select *, " + ", ".join(
    f"case when abs({l}+{r}) >= 1e-6 then ({l}-{r})/({l}+{r}) end as {n}_AI, {l}+{r} as {n}_total" for n, l, r in PAIRS
) + " from visits)"


# --- F: splits, folds, resampling ------------------------------------------------------------------


@query("F1_stratified_split", SPLIT_CTE + "select id, yr, split from split_map")
def f1(spark, d):
    return split_visits(qc_visits(spark, d)).select("id", "yr", "split")


@query("F1_hash_threshold_split", "select o_orderkey, case when u < 0.8 then 'train' when u < 0.9 then 'val' else 'test' end as split from (select o_orderkey, cast('0x' || substr(md5(concat_ws('|', '42', 'split', o_orderkey)), 1, 8) as bigint) / 4294967296.0 u from orders)", cohort=False)
def f1b(spark, d):
    return L.assign_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", exact=False)


@query("F2_inner_split", "with r as (select c_custkey, row_number() over (partition by c_mktsegment order by md5(concat_ws('|', '42', 'inner', c_custkey)), c_custkey) rn, count(*) over (partition by c_mktsegment) n from customer) select c_custkey, case when rn <= n - round(n * 0.25) then 'train' else 'val' end as \"inner\" from r", cohort=False)
def f2(spark, d):
    return L.inner_split(table(spark, d, "customer"), "c_custkey", ["c_mktsegment"]).select("c_custkey", "inner")


def _folded(spark, d):
    return L.assign_folds(table(spark, d, "orders"), "o_orderkey", 5, ["o_orderpriority"])


CUTS = "cast(rn > floor(n * 1 / 5.0) as int) + cast(rn > floor(n * 2 / 5.0) as int) + cast(rn > floor(n * 3 / 5.0) as int) + cast(rn > floor(n * 4 / 5.0) as int)"
FOLDED = f"(select *, {CUTS} as fold from (select *, row_number() over (partition by o_orderpriority order by md5(concat_ws('|', '42', 'fold', o_orderkey)), o_orderkey) rn, count(*) over (partition by o_orderpriority) n from orders))"


@query("F3_stratified_folds", f"select o_orderkey, fold from {FOLDED}", cohort=False)
def f3(spark, d):
    return _folded(spark, d).select("o_orderkey", "fold")


GROUP_CTE = f"""
c as (select cast(family as varchar) k, site, count(*) c from visits where yr = 1995 group by 1, 2),
fam as (select k, arg_min(site, (-c, site)) s from c group by k),
fr as (select k, row_number() over (partition by s order by md5(concat_ws('|', '42', 'family', k)), k) rn, count(*) over (partition by s) n from fam),
ff as (select k, {CUTS} as fold from fr)
"""


def _group_folded(spark, d):
    return L.assign_group_folds(visits(spark, d).where(F.col("yr") == BASE), "family", "id", "site", 5)


@query(
    "F4_group_folds",
    GROUP_CTE.replace("fam as (select k, arg_min(site, (-c, site)) s from c group by k)", "fam as (select k, site s from c qualify row_number() over (partition by k order by c desc, site) = 1)")
    + "select v.id, ff.fold from visits v join ff on ff.k = cast(v.family as varchar) where v.yr = 1995",
)
def f4(spark, d):
    return _group_folded(spark, d).select("id", "fold")


@query("F4_balanced_group_folds")
def f4b(spark, d):
    """Whole families in five folds, all visits; the spread of each site is tested against dealing families one after the other."""
    return L.balanced_group_folds(visits(spark, d).select("id", "yr", "family", "site"), "family", "id", "site").select("id", "yr", "fold")


@query("F5_stratification_key", "q as (select quantile_cont(target, 0.2) a, quantile_cont(target, 0.4) b, quantile_cont(target, 0.6) c, quantile_cont(target, 0.8) d from visits), t as (select id, yr, site, " + QBIN + " bin from visits, q), m as (select min(n) n from (select count(*) n from t group by bin, site)) select id, yr, case when (select n from m) >= 5 then bin || '|' || site else site end as key from t")
def f5(spark, d):
    v = E.quantile_bin(visits(spark, d).select("id", "yr", "site", "target"), "target", 5)
    key, _ = L.stratification_key(v, "bin", "site", 5)
    return v.select("id", "yr", key.alias("key"))


@query(
    "F6_fold_diagnostics",
    f"""with f as {FOLDED}
    select fold, (select count(*) from f) - count(*) as n_train, count(*) as n_test, round(avg(o_totalprice), 4) as mean_test, round(stddev_pop(o_totalprice), 2) as sd_test,
    (select count(distinct g.o_orderpriority) from f g where g.fold <> f.fold) as sites_train, count(distinct o_orderpriority) as sites_test from f group by fold""",
    cohort=False,
)
def f6(spark, d):
    return L.fold_diagnostics(_folded(spark, d), "fold", "o_totalprice", "o_orderpriority").withColumns({"mean_test": F.round("mean_test", 4), "sd_test": F.round("sd_test", 2)})


@query("F6_leaked_families", f"with f as {FOLDED} select count(*) as leaked from (select o_custkey from f group by 1 having count(distinct fold) > 1)", cohort=False)
def f6b(spark, d):
    return L.leaked_families(_folded(spark, d), "o_custkey", "fold")


@query(
    "F7_compare_folds",
    f"""with x as (select o_orderkey, {CUTS} as a from (select *, row_number() over (partition by o_orderpriority order by md5(concat_ws('|', '42', 'fold', o_orderkey)), o_orderkey) rn, count(*) over (partition by o_orderpriority) n from orders)),
    y as (select o_orderkey, {CUTS} as b from (select *, row_number() over (order by md5(concat_ws('|', '7', 'fold', o_orderkey)), o_orderkey) rn, count(*) over () n from orders))
    select j as fold, round(count(*) filter (where a = j and b = j) / count(*) filter (where a = j or b = j), 6) as jaccard,
    abs(count(*) filter (where a = j) - count(*) filter (where b = j)) as size_diff from x join y using (o_orderkey), (select unnest([0,1,2,3,4]) j) group by j""",
    cohort=False,
)
def f7(spark, d):
    both = L.assign_folds(_folded(spark, d).withColumnRenamed("fold", "a"), "o_orderkey", 5, seed=7, out="b")
    return L.compare_folds(both, "a", "b", 5).select("fold", r6("jaccard"), "size_diff")


@query("F8_balance_classes", "with r as (select doc_id, quality, row_number() over (partition by quality order by md5(concat_ws('|', '42', 'balance|3', doc_id)), doc_id) rn from labels) select doc_id, quality from r where rn <= (select min(n) from (select count(*) n from labels group by quality))", cohort=False)
def f8(spark, d):
    return L.balance_classes(table(spark, d, "labels"), "doc_id", "quality", iteration=3).select("doc_id", "quality")


@query("F10_bin_downsample", "with b as (select o_orderkey, cast(o_totalprice >= 100000 as int) + cast(o_totalprice >= 250000 as int) bin from orders), r as (select *, row_number() over (partition by bin order by md5(concat_ws('|', '42', 'balance|0', o_orderkey)), o_orderkey) rn from b) select o_orderkey, bin from r where rn <= (select min(n) from (select count(*) n from b group by bin))", cohort=False)
def f10(spark, d):
    b = table(spark, d, "orders").select("o_orderkey", S.left_closed_bin(F.col("o_totalprice"), [0, 100_000, 250_000, 1e9]).alias("bin"))
    return L.balance_classes(b, "o_orderkey", "bin")


@query(
    "F11_bootstrap_exact",
    """with r as (select c_custkey, c_acctbal, row_number() over (order by md5(concat_ws('|', '42', 'order', c_custkey)), c_custkey) rn from customer),
    p as (select b, cast('0x' || substr(md5(concat_ws('|', '42', 'pick|' || b, c_custkey)), 1, 15) as bigint) % (select count(*) from customer) + 1 rn from customer, range(0, 4) t(b))
    select cast(b as int) as b, c_custkey, count(*) as w from p join r using (rn) group by 1, 2""",
    cohort=False,
)
def f11(spark, d):
    return R.bootstrap_exact(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 4).select("b", "c_custkey", "w")


def poisson_sql(source, ids, draws, seed=42, tag="boot"):
    u = f"(cast('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}|' || (b // 4), {ids})), 1 + 8 * (b % 4), 8) as bigint) / 4294967296.0)"
    draw = " + ".join(f"cast(u >= {c!r} as int)" for c in POISSON_CUTS)
    return f"(select * exclude (u), {draw} as w from (select s.*, cast(b as int) as b, {u} as u from {source} s, (select unnest(range(0, {draws})) as b)) where {draw} > 0)"


@query("F11_bootstrap_poisson", "select b, c_custkey, w from " + poisson_sql("customer", "c_custkey", 8), cohort=False)
def f11b(spark, d):
    return R.poisson_weights(table(spark, d, "customer").select("c_custkey"), "c_custkey", 8).select("b", "c_custkey", "w")


PERM_SQL = """with o as (select c_custkey, c_acctbal, row_number() over (order by md5(concat_ws('|', '42', 'order', c_custkey)), c_custkey) rn from customer),
p as (select c_custkey, cast(perm as int) as perm, row_number() over (partition by perm order by md5(concat_ws('|', '42', 'perm', c_custkey, perm)), c_custkey) rn from customer, range(0, 3) t(perm))
select p.perm, p.c_custkey, o.c_acctbal as permuted from p join o using (rn)"""


@query("F12_permutation", PERM_SQL, cohort=False)
def f12(spark, d):
    return R.permute(table(spark, d, "customer"), "c_custkey", "c_acctbal", 3)


@query("F13_random_member", "with m as (select distinct id, family from visits)".replace("with ", "") + " select cast(it as int) as iteration, family, id from m, range(0, 3) t(it) qualify row_number() over (partition by it, family order by md5(concat_ws('|', '42', 'member|' || it, id)), id) = 1")
def f13(spark, d):
    m = visits(spark, d).select("id", "family").distinct().withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return L.random_member(m, "family", "id", F.col("it"))


@query("F14_random_halves", "m as (select distinct family from visits), r as (select cast(it as int) as iteration, family, row_number() over (partition by it order by md5(concat_ws('|', '42', 'half', family, it)), family) rn, count(*) over (partition by it) n from m, range(0, 3) t(it)) select iteration, family, case when rn <= floor(n / 2) then 'a' else 'b' end as half from r")
def f14(spark, d):
    return L.random_halves(visits(spark, d), "family", 3)


@query("F15_random_draw", "with r as (select cast(dr as int) as draw, p_partkey, row_number() over (partition by dr order by md5(concat_ws('|', '42', 'draw', p_partkey, dr)), p_partkey) rn from part, range(0, 4) t(dr)) select draw, p_partkey from r where rn <= 25", cohort=False)
def f15(spark, d):
    return L.random_draw(table(spark, d, "part"), "p_partkey", 4, 25)


# --- I: association and tests ----------------------------------------------------------------------


def corr_sql(features, target, source, groups="", min_n=2):
    g = groups + ", " if groups else ""
    by = f" group by {groups}" if groups else ""
    return " union all ".join(
        f"select {g}'{c}' as feature, round(corr({c}, {target}), 6) as r, count(*) filter (where {c} is not null and {target} is not null) as n from {source}{by} having count(*) filter (where {c} is not null and {target} is not null) >= {min_n}"
        for c in features
    )


@query("I1_correlations", corr_sql(FEATURES, "target", "visits"))
def i1(spark, d):
    return A.correlation_tests(visits(spark, d), FEATURES, "target").select("feature", r6("r"), "n")


@query("D3_match_coefficients", "with " + "u as (select o_orderpriority as feature, corr(o_totalprice, o_custkey) r from orders group by 1), k as (select o_orderpriority as feature, avg(o_totalprice) value from orders where o_orderstatus = 'F' group by 1) select feature, round(r, 6) as r, round(value, 4) as value from u join k using (feature)", cohort=False)
def d3(spark, d):
    from varve.operators.joins import match_coefficients

    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "feature")
    uni = o.groupBy("feature").agg(A.pearson(F.col("o_totalprice"), F.col("o_custkey")).alias("r"))
    coef = o.where("o_orderstatus = 'F'").groupBy("feature").agg(F.avg("o_totalprice").alias("value"))
    return match_coefficients(uni, coef).select("feature", r6("r"), F.round("value", 4).alias("value"))


@query("I2_asymmetry_correlations", f"{AI_CTE} " + corr_sql(AI, "target", "ai"))
def i2(spark, d):
    return A.correlation_tests(cohort_ai(spark, d), AI, "target").select("feature", r6("r"), "n")


@query("I3_correlation_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, count(*) filter (where {a} is not null and {b} is not null) as n from visits" for a in ("qty_lh", "price_rh", "disc_lh") for b in ("target", "age")))
def i3(spark, d):
    return A.correlation_matrix(visits(spark, d), ["qty_lh", "price_rh", "disc_lh"], ["target", "age"]).select("a", "b", r6("r"), "n")


@query(
    "I4_group_correlations",
    f"{AI_CTE}, q as (select quantile_cont(target, 0.75) hi, quantile_cont(target, 0.25) lo from visits), "
    + "p as ("
    + " union all ".join(
        f"select '{a}' a, '{b}' b, corr({a}, {b}) filter (where target >= hi) r_high, corr({a}, {b}) filter (where target < lo) r_low, count(*) filter (where target >= hi and {a} is not null and {b} is not null) n_high, count(*) filter (where target < lo and {a} is not null and {b} is not null) n_low from ai, q"
        for a, b in (("disc_AI", "price_AI"), ("disc_AI", "qty_AI"), ("price_AI", "qty_AI"))
    )
    + ") select a, b, round(r_high, 6) as r_high, round(r_low, 6) as r_low, n_high, n_low, round((atanh(r_high) - atanh(r_low)) / sqrt(1 / (n_high - 3) + 1 / (n_low - 3)), 5) as z from p",
)
def i4(spark, d):
    return A.contrast_group_correlations(cohort_ai(spark, d), AI, "target").select("a", "b", r6("r_high"), r6("r_low"), "n_high", "n_low", F.round("z", 5).alias("z"))


def rank_sql(x, y, source, group=None):
    by = f"partition by {group} " if group else ""
    g = f"{group}, " if group else ""
    return (
        f"rk as (select {g}rank() over ({by}order by {x}) + (count(*) over (partition by {g}{x}) - 1) / 2.0 a, rank() over ({by}order by {y}) + (count(*) over (partition by {g}{y}) - 1) / 2.0 b from {source} where {x} is not null and {y} is not null)"
    )


@query("I5_spearman", rank_sql("qty_lh", "target", "visits", "site") + " select site, round(corr(a, b), 6) as rho, count(*) as n from rk group by site")
def i5(spark, d):
    return A.spearman(visits(spark, d), "qty_lh", "target", ["site"]).select("site", r6("rho"), "n")


def t_sql(features, a, b, source, welch=False):
    parts = " union all ".join(
        f"select '{c}' feature, count({c}) filter (where {a}) n1, avg({c}) filter (where {a}) m1, var_samp({c}) filter (where {a}) v1, count({c}) filter (where {b}) n2, avg({c}) filter (where {b}) m2, var_samp({c}) filter (where {b}) v2 from {source}"
        for c in features
    )
    pooled = "((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)"
    t = "(m1 - m2) / sqrt(v1 / n1 + v2 / n2)" if welch else f"(m1 - m2) / sqrt({pooled} * (1 / n1 + 1 / n2))"
    return f"mo as ({parts}) select feature, n1, n2, round(m1, 6) as mean1, round(m2, 6) as mean2, round({t}, 5) as t, round((m1 - m2) / sqrt({pooled}), 5) as cohens_d from mo"


def t_cols(df):
    return df.select("feature", "n1", "n2", r6("mean1"), r6("mean2"), F.round("t", 5).alias("t"), F.round("cohens_d", 5).alias("cohens_d"))


@query("I6_t_tests", f"{AI_CTE}, " + t_sql(AI, "sex = '1'", "sex = '2'", "ai"))
def i6(spark, d):
    return t_cols(A.t_tests(cohort_ai(spark, d), AI, F.col("sex") == "1", F.col("sex") == "2"))


@query("I7_welch_tests", f"{AI_CTE}, " + t_sql(AI, "yr = 1995", "yr = 1997", "ai", True))
def i7(spark, d):
    return t_cols(A.t_tests(cohort_ai(spark, d), AI, F.col("yr") == BASE, F.col("yr") == YEAR2, welch=True))


@query("I8_paired_t", "p as (" + " union all ".join(f"select '{c}' feature, b.{c} - a.{c} x from visits a join visits b on a.id = b.id where a.yr = 1995 and b.yr = 1997" for c in ("target", "qty_lh", "disc_rh")) + ") select feature, count(x) as n, round(avg(x), 4) as mean_change, round(avg(x) * sqrt(count(x)) / stddev_samp(x), 5) as t, round(avg(x) / stddev_samp(x), 5) as cohens_d from p group by feature")
def i8(spark, d):
    return A.paired_t(visits(spark, d), "id", "yr", BASE, YEAR2, ["target", "qty_lh", "disc_rh"]).select("feature", "n", F.round("mean_change", 4).alias("mean_change"), F.round("t", 5).alias("t"), F.round("cohens_d", 5).alias("cohens_d"))


CHI = "round((a+b+c+d) * power(greatest(abs(a*d - b*c) - (a+b+c+d)/2.0, 0), 2) / (cast(a+b as double)*(c+d)*(a+c)*(b+d)), 6) as chi2"


@query("I9_chi_square", f"with t as (select cast(count(*) filter (where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') as double) a, cast(count(*) filter (where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT') as double) b, cast(count(*) filter (where o_orderstatus <> 'F' and o_orderpriority = '1-URGENT') as double) c, cast(count(*) filter (where o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT') as double) d from orders) select cast(a as bigint) as a, cast(b as bigint) as b, cast(c as bigint) as c, cast(d as bigint) as d, {CHI} from t", cohort=False)
def i9(spark, d):
    o = table(spark, d, "orders")
    return A.chi2_2x2(o, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT").select("a", "b", "c", "d", r6("chi2"))


@query("I10_cohens_d", "m as (select site, count(target) filter (where sex='1') n1, avg(target) filter (where sex='1') m1, var_samp(target) filter (where sex='1') v1, count(target) filter (where sex='2') n2, avg(target) filter (where sex='2') m2, var_samp(target) filter (where sex='2') v2 from visits group by site) select site, round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)), 6) as d from m")
def i10(spark, d):
    m = A.two_groups(visits(spark, d), ["target"], F.col("sex") == "1", F.col("sex") == "2", ["site"])
    return m.select("site", r6(X.cohens_d(*A._six()), "d"))


@query("I11_adjust", "with t as (select doc_id, (n_chars % 997 + 1) / 1000.0 p from documents), m as (select count(*) m from t), s as (select doc_id, p, p * m / count(*) over (order by p range between unbounded preceding and current row) st, m from t, m) select doc_id, round(least(p * m, 1), 6) as p_bonferroni, round(least(min(st) over (order by p desc range between unbounded preceding and current row), 1), 6) as p_fdr from s", cohort=False)
def i11(spark, d):
    t = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 997 + 1) / 1000.0).alias("p"))
    return A.adjust_many(t, "p").select("doc_id", r6("p_bonferroni"), r6("p_fdr"))


@query("E15_ranked_minimum", "with t as (select p_size k, p_brand g, (p_partkey % 97 + 1) / 1000.0 p from part), s as (select g, k, p, p * count(*) over (partition by g) / count(*) over (partition by g order by p range between unbounded preceding and current row) st from t) select g, k, round(p, 6) as p, round(least(min(st) over (partition by g order by p desc range between unbounded preceding and current row), 1), 6) as p_fdr from s", cohort=False)
def e15(spark, d):
    t = table(spark, d, "part").select(F.col("p_size").alias("k"), F.col("p_brand").alias("g"), ((F.col("p_partkey") % 97 + 1) / 1000.0).alias("p"))
    return A.adjust_many(t, "p", ["g"]).select("g", "k", r6("p"), r6("p_fdr"))


@query("I12_fisher_z", "g as (select site, corr(qty_lh, target) filter (where sex='1') r1, count(*) filter (where sex='1' and qty_lh is not null) n1, corr(qty_lh, target) filter (where sex='2') r2, count(*) filter (where sex='2' and qty_lh is not null) n2 from visits group by site) select site, round((atanh(r1)-atanh(r2))/sqrt(1/(n1-3)+1/(n2-3)), 5) as z from g")
def i12(spark, d):
    x, y = F.col("qty_lh"), F.col("target")
    g = visits(spark, d).groupBy("site").agg(*[c.alias(n) for i, s in (("1", "1"), ("2", "2")) for n, c in ((f"r{i}", A.pearson(F.when(F.col("sex") == s, x), y)), (f"n{i}", A.pairs_n(F.when(F.col("sex") == s, x), y)))])
    return g.select("site", F.round(X.fisher_z(F.col("r1"), F.col("n1"), F.col("r2"), F.col("n2")), 5).alias("z"))


MENG = "round((atanh(r_ai)-atanh(r_total))*sqrt((n-3)/(2*(1-r_x)*((1-least(greatest((1-r_x)/(2*(1-(r_ai*r_ai+r_total*r_total)/2)),0),1)*(r_ai*r_ai+r_total*r_total)/2)/(1-(r_ai*r_ai+r_total*r_total)/2)))), 5) as z"
VERSUS = "c as (" + " union all ".join(f"select '{n}' structure, corr({n}_AI, target) r_ai, corr({n}_total, target) filter (where {n}_AI is not null) r_total, corr({n}_AI, {n}_total) r_x, count({n}_AI) n from ai" for n, _, _ in PAIRS) + ")"


@query("I13_dependent_z", f"{AI_CTE}, {VERSUS} select structure, {MENG} from c")
def i13(spark, d):
    return A.asymmetry_versus_total(visits(spark, d), PAIRS, "target").select("structure", F.round("z", 5).alias("z"))


@query("I14_asymmetry_versus_total", f"{AI_CTE}, {VERSUS} select structure, n, round(r_ai, 6) as r_ai, round(r_total, 6) as r_total, {MENG} from c")
def i14(spark, d):
    return A.asymmetry_versus_total(visits(spark, d), PAIRS, "target").select("structure", "n", r6("r_ai"), r6("r_total"), F.round("z", 5).alias("z"))


@query("I15_sex_interaction", f"{AI_CTE} " + " union all ".join(f"select '{c}' as feature, round(regr_slope(target, {c}) filter (where sex = '2') - regr_slope(target, {c}) filter (where sex <> '2'), 3) as beta_interaction, round(corr({c}, target) filter (where sex <> '2'), 6) as r_male, round(corr({c}, target) filter (where sex = '2'), 6) as r_female from ai" for c in AI))
def i15(spark, d):
    return A.sex_interaction(cohort_ai(spark, d), AI, "target", F.col("sex") == "2").select("feature", F.round("beta_interaction", 3).alias("beta_interaction"), r6("r_male"), r6("r_female"))


@query("I16_pair_interactions")
def i16(spark, d):
    return A.pair_interactions(cohort_ai(spark, d), AI, "target")


#: Interaction by partial regression of a*b and y on a and b, from covariances.
_INTERACTION = " union all ".join(
    f"select '{a}' feature_a, '{b}' feature_b, count(*) n, var_pop({a}) aa, var_pop({b}) bb, covar_pop({a}, {b}) ab, covar_pop({a}, {a} * {b}) az, covar_pop({b}, {a} * {b}) bz, "
    f"covar_pop({a}, target) ay, covar_pop({b}, target) cy, covar_pop({a} * {b}, target) zy, var_pop({a} * {b}) zz, var_pop(target) yy from ai where {a} is not null and {b} is not null and target is not null"
    for i, a in enumerate(sorted(AI)) for b in sorted(AI)[i + 1 :]
)


@query(
    "I16_interaction_terms",
    f"{AI_CTE}, c as ({_INTERACTION}), g as (select *, (az * bb - bz * ab) / (aa * bb - ab * ab) ga, (bz * aa - az * ab) / (aa * bb - ab * ab) gb, (ay * bb - cy * ab) / (aa * bb - ab * ab) da, (cy * aa - ay * ab) / (aa * bb - ab * ab) db from c), "
    "h as (select *, zz - ga * az - gb * bz szz, zy - ga * ay - gb * cy szy from g), k as (select *, szy / szz beta, da * ay + db * cy + szy * szy / szz explained from h) "
    "select feature_a, feature_b, round(beta, 3) as beta_interaction, round(beta / sqrt((yy - explained) * n / (n - 4) / (n * szz)), 5) as t, round(explained / yy, 8) as r2, n from k",
)
def i16b(spark, d):
    out = A.pair_interactions(cohort_ai(spark, d), AI, "target")
    return out.select("feature_a", "feature_b", F.round("beta_interaction", 3).alias("beta_interaction"), F.round("t", 5).alias("t"), F.round("r2", 8).alias("r2"), "n")


@query("I17_history_t_tests", f"{AI_CTE}, " + t_sql(AI, "family % 3 = 0", "family % 3 <> 0", "ai"))
def i17(spark, d):
    v = cohort_ai(spark, d).withColumn("fh", (F.col("family") % 3 == 0).cast("int"))
    return t_cols(A.history_effects(v, AI, "target", "fh")[1])


@query("I17_history_model")
def i17b(spark, d):
    v = cohort_ai(spark, d).withColumn("fh", (F.col("family") % 3 == 0).cast("int"))
    return A.history_effects(v, AI, "target", "fh")[0]


def _c(e, s, y):
    return f"corr({e}, target) filter (where sex = '{s}' and yr = {y})"


def _n(e, s, y):
    return f"count(*) filter (where sex = '{s}' and yr = {y} and {e} is not null)"


@query(
    "I18_three_way",
    "g as (select " + ", ".join(f"{_c('qty_lh', s, y)} r_{k}, {_n('qty_lh', s, y)} n_{k}" for k, s, y in (("mb", 1, 1995), ("fb", 2, 1995), ("my", 1, 1997), ("fy", 2, 1997))) + " from visits) "
    + " union all ".join(f"select '{n}' as comparison, round((atanh(r_{a}) - atanh(r_{b})) / sqrt(1/(n_{a}-3) + 1/(n_{b}-3)), 5) as z from g" for n, a, b in (("sex_baseline", "mb", "fb"), ("sex_follow_up", "my", "fy"), ("male_change", "mb", "my"), ("female_change", "fb", "fy")))
    + " union all select 'three_way', round((atanh(r_mb - r_fb) - atanh(r_my - r_fy)) / sqrt(1/(n_mb-3)+1/(n_fb-3)+1/(n_my-3)+1/(n_fy-3)), 5) from g",
)
def i18(spark, d):
    return A.three_way(visits(spark, d), "qty_lh", "qty_rh", "target", "sex", "yr", BASE, YEAR2, "1", "2")[1].select("comparison", F.round("z", 5).alias("z"))


@query(
    "I19_demographics",
    "m as (" + " union all ".join(f"select '{c}' target, corr(age, {c}) r, count({c}) filter (where sex='1') n1, avg({c}) filter (where sex='1') m1, var_samp({c}) filter (where sex='1') v1, count({c}) filter (where sex='2') n2, avg({c}) filter (where sex='2') m2, var_samp({c}) filter (where sex='2') v2 from visits" for c in ("target", "qty_lh", "disc_rh"))
    + ") select target, round(r, 6) as age_r, round(m1, 6) as male_mean, round(m2, 6) as female_mean, round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)*(1/n1+1/n2)), 5) as sex_t from m",
)
def i19(spark, d):
    # The target list is melted, so the score column is read under another name.
    v = visits(spark, d).select("age", "sex", "target", "qty_lh", "disc_rh")
    return A.demographic_effects(v, ["target", "qty_lh", "disc_rh"], "age", "sex", "1", "2").select("target", r6("age_r"), r6("male_mean"), r6("female_mean"), F.round("sex_t", 5).alias("sex_t"))


@query("I20_sex_hemisphere", f"{AI_CTE}, m as (select * from ai where sex in ('1','2')) " + corr_sql(["qty_AI", "qty_lh", "qty_rh"], "target", "m", "sex"))
def i20(spark, d):
    return A.sex_hemisphere(visits(spark, d), PAIRS[0], "target", "sex", "1", "2")[0].select("sex", "feature", r6("r"), "n")


@query("I20_sex_hemisphere_z", f"{AI_CTE}, g as (" + " union all ".join(f"select '{c}' feature, corr({c}, target) filter (where sex='1') r1, count({c}) filter (where sex='1') n1, corr({c}, target) filter (where sex='2') r2, count({c}) filter (where sex='2') n2 from ai" for c in ("qty_AI", "qty_lh", "qty_rh")) + ") select feature, round((atanh(r1)-atanh(r2))/sqrt(1/(n1-3)+1/(n2-3)), 5) as z from g")
def i20b(spark, d):
    return A.sex_hemisphere(visits(spark, d), PAIRS[0], "target", "sex", "1", "2")[1].select("feature", F.round("z", 5).alias("z"))


@query("I21_pvalues")
def i21(spark, d):
    return A.correlation_tests(visits(spark, d), FEATURES, "target", ["site"]).select("site", "feature", "p", "p_bonferroni", "p_fdr")


@query("I22_lines", "select site, round(regr_slope(target, age), 6) as slope, round(regr_intercept(target, age), 4) as intercept, round(corr(age, target), 6) as r, count(*) as n from visits group by site")
def i22(spark, d):
    return A.lines(visits(spark, d), "age", "target", ["site"]).select("site", r6("slope"), F.round("intercept", 4).alias("intercept"), r6("r"), "n")


# --- M: evaluation ---------------------------------------------------------------------------------


def predictions(spark, d):
    """Outcome, score and fold: document quality against a length score."""
    doc = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"))
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return doc.join(lab, "doc_id").select("doc_id", "y", "score", (F.col("score") >= 0.5).cast("int").alias("yhat"), (F.col("doc_id") % 5).alias("fold"))


PRED = "pr as (select doc_id, quality y, n_chars / (n_chars + 1000) score, cast(n_chars / (n_chars + 1000) >= 0.5 as int) yhat, doc_id % 5 fold from documents join labels using (doc_id))"
CONF = "count(*) filter (where y=1 and yhat=1) tp, count(*) filter (where y=0 and yhat=1) fp, count(*) filter (where y=1 and yhat=0) fn, count(*) filter (where y=0 and yhat=0) tn"
RATE = {
    "accuracy": "(tp+tn)/(tp+fp+fn+tn)", "balanced_accuracy": "(coalesce(tp/nullif(tp+fn,0),0)+coalesce(tn/nullif(fp+tn,0),0))/(cast(tp+fn>0 as int)+cast(fp+tn>0 as int))",
    "precision_pos": "coalesce(tp/nullif(tp+fp,0),0)", "recall_pos": "coalesce(tp/nullif(tp+fn,0),0)", "f1_pos": "coalesce(2*tp/nullif(2*tp+fp+fn,0),0)",
}
AUC_EXPR = "(sum(r) filter (where y=1) - count(*) filter (where y=1) * (count(*) filter (where y=1) + 1) / 2.0) / nullif(count(*) filter (where y=1) * count(*) filter (where y=0), 0)"


def metrics_sql(group=None):
    g, by = (f"{group}, ", f" group by {group}") if group else ("", "")
    part = f"partition by {group} " if group else ""
    same = f"partition by {group}, score" if group else "partition by score"
    return f"cf as (select {g}{CONF} from pr{by}), rk as (select *, rank() over ({part}order by score) + (count(*) over ({same}) - 1) / 2.0 r from pr), mt as (" + " union all ".join(f"select {g}'{m}' metric, {e} v from cf" for m, e in RATE.items()) + f" union all select {g}'roc_auc', {AUC_EXPR} from rk{by})"


@query("M1_classification_metrics", f"with {PRED}, {metrics_sql()} select metric, round(v, 6) as value from mt", cohort=False)
def m1(spark, d):
    return V.classification_metrics(predictions(spark, d), "y", "yhat", "score").select("metric", r6("value"))


@query("M2_confusion_report", f"with {PRED}, c as (select {CONF} from pr), x as (select *, tp/nullif(tp+fp,0) ppv, (tp+fn)/(tp+fp+fn+tn) base from c) " + " union all ".join(f"select '{m}' as metric, round({e}, 6) as value from x" for m, e in {
    **{k: f"cast({k} as double)" for k in ("tp", "fp", "fn", "tn")}, **RATE,
    "fbeta": "1.25*tp/(1.25*tp+0.25*fn+fp)", "f2": "5*tp/(5*tp+4*fn+fp)", "specificity": "tn/(fp+tn)", "npv": "coalesce(tn/nullif(fn+tn,0),0)", "fpr": "fp/(fp+tn)", "fnr": "fn/(tp+fn)",
    "fdr": "fp/(tp+fp)", "mcc": "coalesce((tp*tn-fp*fn)/nullif(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(fp+tn)*sqrt(fn+tn),0),0)", "base_rate": "base", "lift": "ppv/base", "nns": "1/ppv", "flagged": "cast(tp+fp as double)"}.items()), cohort=False)
def m2(spark, d):
    return V.confusion_report(predictions(spark, d), "y", "yhat").select("metric", r6("value"))


CURVE = f"{PRED}, sc as (select score, sum(y) p, sum(1-y) q from pr group by score), cu as (select score, p, q, sum(p) over (order by score desc) cp, sum(q) over (order by score desc) cq, sum(p) over () tp, sum(q) over () tq from sc)"


@query("M3_roc_auc", f"with {PRED}, rk as (select *, rank() over (partition by fold order by score) + (count(*) over (partition by fold, score) - 1) / 2.0 r from pr) select fold, round({AUC_EXPR}, 6) as auc from rk group by fold", cohort=False)
def m3(spark, d):
    return V.roc_auc(predictions(spark, d), "y", "score", ["fold"]).select("fold", r6("auc"))


@query("M3_roc_points", f"with {CURVE} select round(score, 9) as threshold, round(cq / tq, 6) as fpr, round(cp / tp, 6) as tpr, cast(cp as bigint) as tp, cast(cq as bigint) as fp from cu", cohort=False)
def m3b(spark, d):
    return V.roc_points(predictions(spark, d), "y", "score").select(F.round("threshold", 9).alias("threshold"), r6("fpr"), r6("tpr"), "tp", "fp")


@query("M4_average_precision", f"with {CURVE} select round(sum(p / tp * cp / (cp + cq)), 6) as ap from cu", cohort=False)
def m4(spark, d):
    return V.average_precision(predictions(spark, d), "y", "score").select(r6("ap"))


@query("M4_pr_points", f"with {CURVE} select round(score, 9) as threshold, round(cp / (cp + cq), 6) as precision, round(cp / tp, 6) as recall from cu", cohort=False)
def m4b(spark, d):
    return V.pr_points(predictions(spark, d), "y", "score").select(F.round("threshold", 9).alias("threshold"), r6("precision"), r6("recall"))


GRID = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7)


def grid_sql(grid):
    return f"{PRED}, th as (select unnest([{', '.join(map(repr, grid))}]::double[]) t), cf as (select t, count(*) filter (where y=1 and score>=t) tp, count(*) filter (where y=0 and score>=t) fp, count(*) filter (where y=1 and score<t) fn, count(*) filter (where y=0 and score<t) tn from pr, th group by t)"


@query("M5_best_threshold", f"with {grid_sql(GRID)} select t as threshold, round(v, 6) as value from (select t, round({RATE['balanced_accuracy']}, 12) v from cf) order by v desc, t limit 1", cohort=False)
def m5(spark, d):
    return V.best_threshold(predictions(spark, d), "y", "score", GRID).select("threshold", r6("value"))


@query("M6_threshold_table", f"with {grid_sql([i / 99 for i in range(100)])} select t as threshold, tp, fp, fn, tn, round({RATE['recall_pos']}, 6) as recall_pos, round({RATE['precision_pos']}, 6) as precision_pos, round(coalesce(5*tp/nullif(5*tp+4*fn+fp,0),0), 6) as f2 from cf", cohort=False)
def m6(spark, d):
    return V.threshold_sweep(predictions(spark, d), "y", "score").select("threshold", "tp", "fp", "fn", "tn", r6("recall_pos"), r6("precision_pos"), r6("f2"))


@query("M7_precision_at_k", f"with {PRED}, r as (select y, row_number() over (order by score desc, doc_id) k from pr), s as (select k, sum(y) over (order by k) h from r) select k, round(h / k, 6) as precision from s where k % 10 = 0 and k < 500", cohort=False)
def m7(spark, d):
    return V.precision_at_k(predictions(spark, d), "y", "score", "doc_id").select(F.col("k").cast("long").alias("k"), r6("precision"))


@query("M8_calibration", f"with {PRED}, q as (" + " union ".join(f"select quantile_cont(score, {i / 10}) e from pr" for i in range(11)) + "), e as (select e from q where e > (select min(e) from q) and e < (select max(e) from q)), b as (select y, score, (select count(*) from e where pr.score > e.e) as bin from pr) select cast(bin as int) as bin, count(*) as n, round(avg(score), 6) as mean_score, round(avg(y), 6) as observed from b group by 1", cohort=False)
def m8(spark, d):
    return V.calibration(predictions(spark, d), "y", "score").select("bin", "n", r6("mean_score"), r6("observed"))


@query("M9_confidence_bins", f"with {PRED} select cast(score >= 0.4 as int) + cast(score >= 0.6 as int) + cast(score >= 0.8 as int) as bin, count(*) as n, cast(sum(y) as bigint) as positives, round(avg(y) filter (where score >= 0.5), 6) as ppv from pr where score >= 0.2 and score < 1.0 group by 1", cohort=False)
def m9(spark, d):
    return V.confidence_bins(predictions(spark, d), "y", "score", [0.2, 0.4, 0.6, 0.8, 1.0]).select("bin", "n", "positives", r6("ppv"))


QUAD = "case when y=1 and yhat=1 then 'TP' when yhat=1 then 'FP' when y=1 then 'FN' else 'TN' end"


@query("M10_error_summary", f"with {PRED} select {QUAD} as quadrant, count(*) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd, round(min(score), 6) as min, round(max(score), 6) as max from pr group by 1", cohort=False)
def m10(spark, d):
    return V.error_summary(predictions(spark, d), "y", "yhat", "score").select("quadrant", "n", *[r6(c) for c in ("mean", "sd", "min", "max")])


@query("M10_error_examples", f"with {PRED}, g as (select doc_id, score, {QUAD} quadrant, 0.5 - score gap from pr), r as (select *, row_number() over (partition by quadrant order by case when quadrant = 'FN' then gap else -score end, doc_id) rn from g where quadrant <> 'TN') select doc_id, round(score, 6) as score, quadrant, round(gap, 6) as gap from r where rn <= 10", cohort=False)
def m10b(spark, d):
    return V.error_examples(predictions(spark, d), "y", "yhat", "score", "doc_id").select("doc_id", r6("score"), "quadrant", r6("gap"))


def pooled_sql(stats):
    return f"with {PRED}, {metrics_sql()}, {metrics_sql('fold').replace('cf as', 'cf2 as').replace('from cf)', 'from cf2)').replace('from cf union', 'from cf2 union').replace('rk as', 'rk2 as').replace('from rk ', 'from rk2 ').replace('mt as', 'mt2 as')} select 'overall' as scope, metric, round(v, 6) as value from mt " + " ".join(f"union all select '{n}', metric, round({fn}(v), 6) from mt2 group by metric" for n, fn in stats)


@query("M11_pooled_classification", pooled_sql((("mean", "avg"), ("std", "stddev_pop"))), cohort=False)
def m11(spark, d):
    return V.pooled_classification(predictions(spark, d), "y", "yhat", "fold", "score").select("scope", "metric", r6("value"))


def regression_predictions(spark, d):
    """Order value against a noisy stand-in prediction from its customer's balance."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return o.join(c, "o_custkey").select("o_orderkey", "y", (0.5 * F.col("y") + 20 * F.col("c_acctbal")).alias("yhat"), (F.col("o_orderkey") % 5).alias("fold"))


RPRED = "rp as (select o_orderkey, o_totalprice y, 0.5 * o_totalprice + 20 * c_acctbal yhat, o_orderkey % 5 fold from orders join customer on c_custkey = o_custkey)"


def reg_sql(group=None, name="rm", source="rp"):
    g, by = (f"{group}, ", f" group by {group}") if group else ("", "")
    part, same = (f"partition by {group} ", f"{group}, ") if group else ("", "")
    m = {"r2": "1 - sum((y-yhat)*(y-yhat)) / (var_pop(y) * count(*))", "mae": "avg(abs(y-yhat))", "mse": "avg((y-yhat)*(y-yhat))", "rmse": "sqrt(avg((y-yhat)*(y-yhat)))", "pearson_r": "corr(y, yhat)", "spearman_r": "corr(ra, rb)"}
    return f"{name}_k as (select *, rank() over ({part}order by y) + (count(*) over (partition by {same}y) - 1) / 2.0 ra, rank() over ({part}order by yhat) + (count(*) over (partition by {same}yhat) - 1) / 2.0 rb from {source}), {name} as (" + " union all ".join(f"select {g}'{k}' metric, {e} v from {name}_k{by}" for k, e in m.items()) + ")"


VALUE = "round(v, case when metric in ('mae','mse','rmse') then 0 else 6 end)"


def rounded():
    return F.when(F.col("metric").isin("mae", "mse", "rmse"), F.round("value", 0)).otherwise(F.round("value", 6)).alias("value")


@query("M12_regression_metrics", f"with {RPRED}, {reg_sql()} select metric, {VALUE} as value from rm", cohort=False)
def m12(spark, d):
    return V.regression_metrics(regression_predictions(spark, d), "y", "yhat").select("metric", rounded())


@query("M13_pooled_regression", f"with {RPRED}, {reg_sql()}, {reg_sql('fold', 'rf')} select 'overall' as scope, metric, {VALUE} as value from rm " + " ".join(f"union all select '{n}', metric, {VALUE} from (select metric, {fn}(v) v from rf group by metric)" for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))), cohort=False)
def m13(spark, d):
    return V.pooled_regression(regression_predictions(spark, d), "y", "yhat", "fold").select("scope", "metric", rounded())


BOOT_CONF = "select b, sum(w) filter (where y=1 and yhat=1) tp, coalesce(sum(w) filter (where y=0 and yhat=1), 0) fp, coalesce(sum(w) filter (where y=1 and yhat=0), 0) fn, coalesce(sum(w) filter (where y=0 and yhat=0), 0) tn from pw group by b"
IVAL = "select metric, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper from mt group by metric"


@query(
    "M14_bootstrap_classification",
    f"with {PRED}, pw as {poisson_sql('pr', 'doc_id', 40)}, cf as ({BOOT_CONF}), sc as (select b, score, coalesce(sum(w) filter (where y=1), 0) p, coalesce(sum(w) filter (where y=0), 0) q from pw group by b, score), "
    + "cu as (select b, p, q, sum(q) over (partition by b order by score desc) cq, sum(p) over (partition by b) tp, sum(q) over (partition by b) tq from sc), mt as ("
    + " union all ".join(f"select '{m}' metric, {e} v from cf" for m, e in RATE.items())
    + f" union all select 'roc_auc', sum(p * (tq - cq + q / 2)) / (max(tp) * max(tq)) from cu group by b) {IVAL}",
    cohort=False,
)
def m14(spark, d, draws=40):
    out = V.bootstrap_classification(predictions(spark, d), "doc_id", "y", "yhat", "score", draws)
    return out.select("metric", *[r6(c) for c in ("mean", "lower", "upper")])


WSUM = "sum(w) n, sum(w*y) sa, sum(w*yhat) sb, sum(w*y*y) saa, sum(w*yhat*yhat) sbb, sum(w*y*yhat) sab, sum(w*(y-yhat)*(y-yhat)) sse"
WR = "(sab - sa*sb/n) / sqrt((saa - sa*sa/n) * (sbb - sb*sb/n))"


@query(
    "M15_bootstrap_regression",
    f"with {RPRED}, mu as (select avg(y) m from rp), rc as (select o_orderkey, y - m y, yhat - m yhat from rp, mu), pw as {poisson_sql('rc', 'o_orderkey', 40)}, s as (select b, {WSUM} from pw group by b), mt as (select 'pearson_r' metric, {WR} v from s union all select 'r2', 1 - sse / (saa - sa*sa/n) from s) {IVAL}",
    cohort=False,
)
def m15(spark, d, draws=40):
    out = V.bootstrap_regression(regression_predictions(spark, d), "o_orderkey", "y", "yhat", draws).where(F.col("metric").isin("pearson_r", "r2"))
    return out.select("metric", *[r6(c) for c in ("mean", "lower", "upper")])


@query(
    "M16_bootstrap_correlations",
    f"{AI_CTE}, ba as (select * from ai where yr = 1995), pw as {poisson_sql('ba', 'id', 40)}, t as ("
    + " union all ".join(f"select b, '{c}' feature, w, target - (select avg(target) from ba) y, {c} yhat from pw where {c} is not null" for c in AI)
    + f"), s as (select b, feature, {WSUM} from t group by b, feature), v as (select feature, {WR} v from s), u as ({corr_sql(AI, 'target', 'ba')}) select feature, any_value(u.r) as r, round(quantile_cont(v, 0.025), 6) as lower, round(quantile_cont(v, 0.975), 6) as upper, round(least(1, 2 * least(avg(cast(v <= 0 as int)), avg(cast(v >= 0 as int)))), 6) as p_boot from v join u using (feature) group by feature",
)
def m16(spark, d, draws=40):
    base = cohort_ai(spark, d).where(F.col("yr") == BASE)
    return V.bootstrap_correlations(base, "id", AI, "target", draws).select("feature", *[r6(c) for c in ("r", "lower", "upper", "p_boot")])


def _many_draws(key, fn):
    """The same query with the study's 10,000 draws."""
    query(f"{key}_10000", O[key].replace("range(0, 40)", "range(0, 10000)"), cohort=False)(lambda spark, d: fn(spark, d, 10_000))


_many_draws("M14_bootstrap_classification", m14)
_many_draws("M15_bootstrap_regression", m15)
_many_draws("M16_bootstrap_correlations", m16)


PERM_R = PERM_SQL.replace("range(0, 3)", "range(0, 30)").replace(
    "\nselect p.perm, p.c_custkey, o.c_acctbal as permuted from p join o using (rn)",
    ", n as (select p.perm, corr(c.c_nationkey, o.c_acctbal) r from p join o using (rn) join customer c on c.c_custkey = p.c_custkey group by p.perm), "
    "ob as (select abs(corr(c_nationkey, c_acctbal)) r from customer)",
)


@query("M17_permutation_p", f"{PERM_R} select count(*) filter (where abs(n.r) >= ob.r) as n_exceed, count(n.r) as n_perm, round((1 + count(*) filter (where abs(n.r) >= ob.r)) / (1 + count(n.r)), 6) as p from n, ob", cohort=False)
def m17(spark, d):
    c = table(spark, d, "customer")
    observed = c.agg(F.corr("c_nationkey", "c_acctbal")).first()[0]
    null = R.permute(c, "c_custkey", "c_acctbal", 30, keep=["c_nationkey"]).groupBy("perm").agg(F.corr("c_nationkey", "permuted").alias("r"))
    return R.permutation_pvalue(null, "r", observed).select("n_exceed", "n_perm", r6("p"))


@query("M22_coefficient_summary", "with c as (select o_orderkey % 5 fold, o_orderpriority feature, regr_slope(o_totalprice, o_custkey) value from orders group by 1, 2) select feature, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(avg(abs(value)), 6) as importance from c group by feature", cohort=False)
def m22(spark, d):
    c = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold"), F.col("o_orderpriority").alias("feature")).agg(F.regr_slope("o_totalprice", "o_custkey").alias("value"))
    return V.coefficient_summary(c).select("feature", *[r6(x) for x in ("mean", "std", "importance")])


@query("M24_residual_report", "with c as (select o_orderkey % 5 fold, 'slope' term, regr_slope(o_totalprice, o_custkey) value from orders group by 1 union all select o_orderkey % 5, 'intercept', regr_intercept(o_totalprice, o_custkey) from orders group by 1) select cast(fold as varchar) as row, term, round(value, 4) as value from c union all select 'mean', term, round(avg(value), 4) from c group by term union all select 'sd', term, round(stddev_pop(value), 4) from c group by term", cohort=False)
def m24(spark, d):
    g = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(F.regr_slope("o_totalprice", "o_custkey").alias("slope"), F.regr_intercept("o_totalprice", "o_custkey").alias("intercept"))
    return V.residual_report(g.unpivot(["fold"], ["slope", "intercept"], "term", "value")).select("row", "term", F.round("value", 4).alias("value"))


@query("M25_rank_agreement", "with u as (select c_nationkey f, corr(c_custkey, c_acctbal) r from customer group by 1), k as (select c_nationkey f, avg(c_acctbal) v from customer group by 1), j as (select * from u join k using (f)), " + rank_sql("r", "v", "j") + " select round(corr(a, b), 6) as rho, count(*) as n from rk", cohort=False)
def m25(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "feature")
    uni = c.groupBy("feature").agg(A.pearson(F.col("c_custkey"), F.col("c_acctbal")).alias("r"))
    return V.rank_agreement(uni, c.groupBy("feature").agg(F.avg("c_acctbal").alias("value"))).select(r6("rho"), "n")


@query("K21_ensemble", "select user_id, round(avg(value), 6) as score, cast(avg(value) >= 50 as int) as yhat from events group by user_id", cohort=False)
def k21(spark, d):
    return V.ensemble_average(table(spark, d, "events").select("user_id", F.col("value").alias("score")), ["user_id"], threshold=50).select("user_id", r6("score"), "yhat")
