"""The same queries as ANSI SQL on the raw test tables, for an independent engine."""

from __future__ import annotations

from trialweave.bindings import IMPUTATIONS, SEGMENTS
from trialweave.schema import ARMS, ASSIGNMENT_SEED, FIT_SEED, NONINFERIORITY_MARGIN, SENSITIVITY_SEED

SEED = 1

CLUSTERS = """
v_cluster as (
  select c.c_custkey as cluster_id,
    case when n.n_regionkey in (0, 1) then 'Major Cities' else 'Regional/Remote' end as remoteness,
    c.c_mktsegment as stype,
    case c.c_custkey % 3 when 0 then 'Ctrl' when 1 then 'H' else 'L' end as arm,
    case when c.c_custkey % 17 = 0 then null else c.c_custkey % 10 + 1 end as decile
  from customer c join nation n on c.c_nationkey = n.n_nationkey),
bound as (select max(c_custkey) as mx from customer)"""

UNITS = (
    CLUSTERS
    + """,
v_long as (
  select l_orderkey as unit_id, case when l_linenumber <= 3 then 1 else 2 end as time,
    min(l_extendedprice / 1000) as value
  from lineitem group by 1, 2),
v_unit as (
  select o.o_orderkey as unit_id, k.cluster_id, k.remoteness, k.stype, k.arm, k.decile,
    case when k.decile < 6 then 'Most' when k.decile >= 6 then 'Least' end as ses,
    b.value as baseline, f.value as outcome,
    case when k.cluster_id * 109 <= 62 * m.mx then 1 else 0 end as cohort
  from orders o join v_cluster k on o.o_custkey = k.cluster_id
  left join (select * from v_long where time = 1) b on b.unit_id = o.o_orderkey
  left join (select * from v_long where time = 2) f on f.unit_id = o.o_orderkey
  cross join bound m)"""
)

PREDS = (
    UNITS
    + f""",
v_preds as (
  select u.unit_id, a.arm, u.arm as old_arm,
    cast(u.unit_id % 97 + 10 * a.ix + i.imp as double) as pred, i.imp
  from v_unit u cross join (values ('Ctrl', 0), ('H', 1), ('L', 2)) a(arm, ix)
  cross join (values {", ".join(f"({i})" for i in range(1, IMPUTATIONS + 1))}) i(imp))"""
)

DRAWS = """
v_draws as (
  select o.o_orderkey as draw, o.o_orderkey % 5 + 1 as imp, o.o_orderkey % 4 + 1 as chain,
    (o.o_totalprice - 150000) / 10000 as b_h, c.c_acctbal / 200 - 10 as b_l
  from orders o join customer c on o.o_custkey = c.c_custkey)"""

REPS = (
    UNITS
    + """,
v_rep as (
  select * from (
    select *, avg(baseline) over (partition by cluster_id) as base_pa,
      row_number() over (partition by cluster_id order by unit_id) as rn
    from v_unit) where rn = 1)"""
)

SQL: dict[str, str] = {}


def add(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"with {ctes.strip()}\n{body.strip()}"


def arm_sql(rank: str, arms=ARMS, seed: str = str(SEED)) -> str:
    """The slot's arm: arms of the block ordered by the hash of seed, block and arm."""
    k = len(arms)
    block = f"cast(floor(({rank} - 1) / {float(k)}) as bigint)"
    cells = ", ".join(
        f"md5('{seed}|' || cast({block} as varchar) || '|{a}') || '|{a}'" for a in arms
    )
    picked = f"list_sort([{cells}])[cast(({rank} - 1) % {k} as integer) + 1]"
    return f"split_part({picked}, '|', 2)"


def block_sql(rank: str, arms=ARMS) -> str:
    return f"cast(floor(({rank} - 1) / {float(len(arms))}) as bigint)"


RANKED = """
ranked as (
  select *, row_number() over (partition by remoteness, stype order by cluster_id) as rownumber
  from v_cluster)"""

# Sources and sinks
add("q_csv_roundtrip", CLUSTERS, "select cluster_id, remoteness, stype, arm, decile from v_cluster")
add(
    "q_stage_roundtrip",
    PREDS,
    "select imp, arm, count(*) as n, sum(pred) as sum_pred from v_preds group by imp, arm",
)

add(
    "q_csv_quarantine",
    CLUSTERS
    + """,
kept as (select * from v_cluster where cluster_id % 29 <> 0)""",
    """select '(line)' as column_name, cast(0 as bigint) as n_rows, (select count(*) from v_cluster where cluster_id % 29 = 0) as n_bad
    union all select '(stype)', count(*), count(*) from kept
    union all select 'cluster_id', count(*), count(*) filter (where cluster_id % 11 = 0) from kept
    union all select 'decile', count(*), count(*) filter (where cluster_id % 13 = 0) from kept
    union all select 'stype', count(*), 0 from kept""",
)

# Recodes and filters
add(
    "q_recode_threshold",
    CLUSTERS,
    """select cluster_id, case when decile < 6 then 'Most' when decile >= 6 then 'Least' end as ses
    from v_cluster""",
)
add(
    "q_recode_member",
    CLUSTERS,
    """select cluster_id,
      case when nullif(stype, 'BUILDING') in ('MACHINERY', 'FURNITURE') then 'listed' else 'other' end as label
    from v_cluster""",
)
add(
    "q_recode_equal",
    CLUSTERS,
    """select cluster_id, case when nullif(stype, 'BUILDING') = 'MACHINERY' then 'yes'
      when nullif(stype, 'BUILDING') <> 'MACHINERY' then 'no' end as label
    from v_cluster""",
)
add(
    "q_levels",
    CLUSTERS,
    """select case when stype <> 'BUILDING' then stype end as level,
      cast(case stype when 'MACHINERY' then 1 when 'HOUSEHOLD' then 2 when 'FURNITURE' then 3
        when 'AUTOMOBILE' then 4 end as integer) as level_no,
      count(*) as n
    from v_cluster group by 1, 2""",
)
TEXT_ID = "case when cluster_id % 13 = 0 then 'x' || cast(cluster_id as varchar) else cast(cluster_id as varchar) end"
add(
    "q_cohort_flag",
    CLUSTERS,
    f"""select cluster_id, case when try_cast({TEXT_ID} as bigint) * 109 <= 62 * mx then 1
      when try_cast({TEXT_ID} as bigint) * 109 > 62 * mx then 0 end as cohort
    from v_cluster cross join bound""",
)
add("q_id_cast", CLUSTERS, f"select cluster_id, try_cast({TEXT_ID} as bigint) as id_no from v_cluster")
add(
    "q_filter_conj",
    CLUSTERS,
    """select cluster_id, remoteness, stype, arm, decile from v_cluster
    where remoteness = 'Major Cities' and stype = 'MACHINERY'""",
)
add(
    "q_interim_cut",
    UNITS,
    """select unit_id, cluster_id, arm, outcome from v_unit cross join bound
    where cluster_id * 109 <= 56 * mx""",
)
add("q_filter_in", UNITS, "select unit_id, cluster_id from v_unit where decile in (2, 4)")
add(
    "q_filter_not_in",
    UNITS,
    """select unit_id, cluster_id, decile from v_unit
    where decile is null or decile not in (2, 4, 7)""",
)
FLAGS = {
    "p_noninferior": f"b_l - b_h >= -{NONINFERIORITY_MARGIN}",
    "p_low_above_high": "b_l - b_h > 0",
    "p_high_above_control": "b_h > 0",
    "p_low_above_control": "b_l > 0",
}
add(
    "q_case_when",
    DRAWS,
    "select draw, "
    + ", ".join(f"case when {c} then 1 else 0 end as {n}" for n, c in FLAGS.items())
    + " from v_draws",
)

# Joins
add(
    "q_left_join",
    UNITS,
    """select o.o_orderkey as unit, b.value as baseline, f.value as outcome from orders o
    left join (select * from v_long where time = 1) b on b.unit_id = o.o_orderkey
    left join (select * from v_long where time = 2) f on f.unit_id = o.o_orderkey""",
)
add(
    "q_slot_join",
    CLUSTERS + "," + RANKED,
    f"""select cluster_id, remoteness, stype, rownumber, {block_sql("rownumber")} as block_id,
      {arm_sql("rownumber")} as treatment from ranked""",
)
add(
    "q_reallocate",
    UNITS + "," + RANKED,
    f"""select u.unit_id, u.cluster_id, u.arm as old_arm, {arm_sql("r.rownumber")} as arm
    from v_unit u left join ranked r on u.cluster_id = r.cluster_id""",
)
MATCH = """select p.unit_id, p.arm, {cluster} as cluster_id, p.old_arm, p.pred, p.imp from v_preds p
    {how} join (select v_unit.* from v_unit cross join bound where cluster_id * 109 <= 56 * mx) u
      on u.unit_id = p.unit_id and u.arm = p.arm"""
add("q_right_join", PREDS, MATCH.format(cluster="u.cluster_id", how="left"))
add("q_pred_join", PREDS, MATCH.format(cluster="u.cluster_id", how="inner"))
add("q_unassigned", UNITS, "select count(*) as n_unassigned from v_unit where decile is null")

# Descriptive tables and tests
add(
    "q_cluster_mean",
    UNITS,
    """select unit_id, cluster_id, round(avg(baseline) over (partition by cluster_id), 9) as base_pa
    from v_unit""",
)


def melted(source: str, keys: str, variables, kind: str) -> str:
    return " union all ".join(
        f"select {keys}, '{x}' as variable, cast({x} as {kind}) as value from {source}" for x in variables
    )


CATEGORICAL = ("stype", "ses", "remoteness")


def categorical_sql(keys: str) -> str:
    return f"""select {keys}, variable, value as level, count(*) as n,
      100.0 * count(*) / sum(count(*)) over (partition by {keys}, variable) as pct
    from ({melted("v_rep", keys, CATEGORICAL, "varchar")}) where value is not null
    group by {keys}, variable, value"""


def quartile(p: float) -> str:
    return (
        f"(percentile_disc({p}) within group (order by value)"
        f" + percentile_disc({1 - p}) within group (order by value desc)) / 2"
    )


def continuous_sql(keys: str, variables) -> str:
    return f"""select {keys}, variable, count(value) as n_values, {quartile(0.25)} as q1,
      {quartile(0.5)} as median, {quartile(0.75)} as q3
    from ({melted("v_rep", keys, variables, "double")}) where value is not null
    group by {keys}, variable"""


def missing_sql(keys: str, variables) -> str:
    return f"""select {keys}, variable, count(*) as n_rows, count(*) - count(value) as n_missing
    from ({melted("v_rep", keys, variables, "varchar")}) group by {keys}, variable"""


add(
    "q_tbl_categorical",
    REPS,
    f"select arm, variable, level, n, round(pct, 6) as pct from ({categorical_sql('arm')})",
)
add(
    "q_tbl_continuous",
    REPS,
    f"""select arm, variable, n_values, round(q1, 10) as q1, round(median, 10) as median, round(q3, 10) as q3
    from ({continuous_sql("arm", ("base_pa", "baseline"))})""",
)
add("q_tbl_missing", REPS, missing_sql("arm", (*CATEGORICAL, "base_pa", "baseline")))
KEYS = "cohort, arm"


def stat_sql(source: str, level: str, stats) -> str:
    return " union all ".join(
        f"select {KEYS}, variable, {level} as level, '{s}' as stat, round(cast({s} as double), 10) as value from {source}"
        for s in stats
    )


add(
    "q_tbl_strata",
    REPS
    + f", cat as ({categorical_sql(KEYS)}), con as ({continuous_sql(KEYS, ('base_pa',))}),"
    + f" mis as ({missing_sql(KEYS, (*CATEGORICAL, 'base_pa'))})",
    " union all ".join(
        [
            stat_sql("cat", "level", ("n", "pct")),
            stat_sql("con", "''", ("q1", "median", "q3")),
            stat_sql("mis", "''", ("n_rows", "n_missing")),
        ]
    ),
)


def chisq_sql(x: str) -> str:
    return f"""select '{x}' as variable,
      round(sum((coalesce(o.n, 0) - e.x) * (coalesce(o.n, 0) - e.x) / e.x), 6) as statistic,
      cast((count(distinct e.rl) - 1) * (count(distinct e.cl) - 1) as bigint) as df,
      round(min(e.x), 6) as min_expected
    from (select r.cohort as rl, c.{x} as cl, r.n * c.n / t.n as x
        from (select cohort, cast(count(*) as double) as n from v_rep where {x} is not null group by 1) r
        cross join (select {x}, cast(count(*) as double) as n from v_rep where {x} is not null group by 1) c
        cross join (select cast(count(*) as double) as n from v_rep where {x} is not null) t) e
      left join (select cohort as rl, {x} as cl, count(*) as n from v_rep group by 1, 2) o
        on o.rl = e.rl and o.cl = e.cl"""


add("q_test_chisq", REPS, " union all ".join(chisq_sql(x) for x in CATEGORICAL))


def ranksum_sql(x: str, source: str = "v_unit") -> str:
    return f"""select '{x}' as variable, cast(n1 as bigint) as n_first, cast(n2 as bigint) as n_second, round(w, 6) as w,
      round(tie, 6) as tie_term,
      round((w - n1 * n2 / 2 - 0.5 * sign(w - n1 * n2 / 2))
        / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z
    from (
      select cast(sum(a) as double) as n1, cast(sum(1 - a) as double) as n2,
        sum(a * mid) - sum(a) * (sum(a) + 1) / 2.0 as w, sum(ties) as tie
      from (
        select case when cohort = 1 then 1 else 0 end as a,
          rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0 as mid,
          cast(count(*) over (partition by {x}) as double) * count(*) over (partition by {x}) - 1 as ties
        from {source} where {x} is not null))"""


add("q_test_ranksum", UNITS, " union all ".join(ranksum_sql(x) for x in ("baseline", "outcome", "decile")))


add(
    "q_compare_tests",
    REPS,
    " union all ".join(
        [
            f"""select variable, case when {"true" if two else "false"} and min_expected < 5 then 'fisher' else 'chisq' end as test,
      statistic, min_expected < 5 as sparse from ({chisq_sql(x)})"""
            for x, two in (("stype", False), ("ses", True), ("remoteness", True))
        ]
        + [f"""select variable, 'rank_sum' as test, w as statistic, false as sparse from ({ranksum_sql("base_pa", "v_rep")})"""]
    ),
)


def fisher_sql(x: str, first: str) -> str:
    """Hypergeometric probabilities over all feasible tables, by log gamma."""
    log_p = (
        "lgamma(r1 + 1) + lgamma(n - r1 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1)"
        " - lgamma({k} + 1) - lgamma(r1 - {k} + 1) - lgamma(c1 - {k} + 1) - lgamma(n - r1 - c1 + {k} + 1)"
    )
    return f"""select '{x}' as variable, any_value(n11) as n11, any_value(r1 - n11) as n12,
      any_value(c1 - n11) as n21, any_value(n - r1 - c1 + n11) as n22,
      round(least(sum(case when {log_p.format(k="k")} <= {log_p.format(k="n11")} + 1e-7
        then exp({log_p.format(k="k")}) else 0 end), 1.0), 6) as p_value
    from (
      select *, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) as k
      from (select count(*) filter (cohort = 1 and {x} = '{first}') as n11,
          count(*) filter (cohort = 1) as r1, count(*) filter ({x} = '{first}') as c1, count(*) as n
        from v_rep where {x} is not null))"""


add(
    "q_test_fisher",
    REPS,
    " union all ".join((fisher_sql("ses", "Most"), fisher_sql("remoteness", "Major Cities"))),
)
CODED = (
    UNITS
    + f""",
v_coded as (
  select baseline, outcome, cohort, decile,
    list_position({list(ARMS)}, arm) as arm_no, list_position({list(SEGMENTS)}, stype) as stype_no,
    case ses when 'Least' then 1 when 'Most' then 2 end as ses_no,
    case remoteness when 'Major Cities' then 1 else 2 end as remoteness_no,
    baseline * 2 + 1 as baseline_scaled, 7 as fixed
  from v_unit)"""
)


def predictor_sql(x: str) -> str:
    value = f"corr({x}, baseline)"
    gone = f"corr({x}, case when baseline is null then 1.0 else 0.0 end)"
    if x == "baseline_scaled":  # never present where the baseline is missing
        gone = "cast(null as double)"
    return f"""select '{x}' as predictor, round({value}, 6) as cor_value, round({gone}, 6) as cor_missing,
      greatest(coalesce(abs({value}), 0), coalesce(abs({gone}), 0)) >= 0.1 as keep from v_coded"""


add(
    "q_select_predictors",
    CODED,
    " union all ".join(
        predictor_sql(x)
        for x in (
            "baseline_scaled", "outcome", "cohort", "decile", "arm_no", "stype_no", "ses_no", "remoteness_no",
        )
    ),
)
AUDITED = ("baseline", "baseline_scaled", "cohort", "decile", "stype_no")
add(
    "q_audit_columns",
    CODED,
    "select * from ("
    + " union all ".join(
        [
            f"""select '{c}' as column_name, '' as other,
            case when min({c}) = max({c}) or count({c}) = 0 then 'constant' end as finding,
            cast(null as double) as correlation from v_coded"""
            for c in (*AUDITED, "fixed")
        ]
        + [
            f"""select '{a}' as column_name, '{b}' as other,
            case when abs(corr({a}, {b})) > 0.999 then 'collinear' end as finding,
            round(corr({a}, {b}), 6) as correlation from v_coded"""
            for i, a in enumerate(AUDITED)
            for b in AUDITED[i + 1 :]
        ]
    )
    + ") where finding is not null",
)

# Draws
add(
    "q_decision_probs",
    DRAWS,
    "select "
    + ", ".join(f"round(avg(case when {c} then 1.0 else 0.0 end), 6) as {n}" for n, c in FLAGS.items())
    + " from v_draws",
)
add(
    "q_direction_prob",
    DRAWS,
    """select imp, round(avg(case when b_h < 0 then 1.0 else 0.0 end), 6) as p_below_zero
    from v_draws group by imp""",
)
SUMMARY = " union all ".join(
    f"""select imp, '{c}' as coefficient, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd,
      round(quantile_cont({c}, 0.025), 9) as lower, round(quantile_cont({c}, 0.975), 9) as upper
    from v_draws group by imp"""
    for c in ("b_h", "b_l")
)
add("q_posterior_summary", DRAWS, SUMMARY)
add("q_posterior_summary_ranges", DRAWS, SUMMARY)
add(
    "q_split_rhat",
    DRAWS
    + """,
numbered as (
  select *, row_number() over (partition by chain order by draw) as no,
    count(*) over (partition by chain) as len from v_draws),
halves as (
  select *, case when no <= len // 2 then 1 when no > len - len // 2 then 2 end as half from numbered),
long as (
  select chain, half, 'b_h' as coefficient, b_h as value from halves where half is not null
  union all select chain, half, 'b_l' as coefficient, b_l as value from halves where half is not null),
per as (
  select coefficient, chain, half, count(*) as n, avg(value) as m, var_samp(value) as v
  from long group by 1, 2, 3)""",
    """select coefficient,
      round(sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)), 6) as rhat
    from per group by coefficient""",
)
add(
    "q_variance_ratio",
    UNITS
    + """,
per as (select unit_id % 40 as draw, var_samp(baseline / 2) / var_samp(outcome) as ratio from v_unit group by 1)""",
    """select count(ratio) as n_draws, round(avg(ratio), 6) as mean,
      round(quantile_cont(ratio, 0.5), 6) as median, round(quantile_cont(ratio, 0.025), 6) as lower,
      round(quantile_cont(ratio, 0.975), 6) as upper from per""",
)
add(
    "q_pool",
    DRAWS
    + """,
per as (
  select imp, 'b_h' as coefficient, avg(b_h) as e, stddev_samp(b_h) as s from v_draws group by imp
  union all
  select imp, 'b_l' as coefficient, avg(b_l) as e, stddev_samp(b_l) as s from v_draws group by imp)""",
    """select coefficient, count(*) as n_imp, round(avg(e), 6) as pooled_mean,
      round(avg(s * s), 6) as within_var, round(var_pop(e), 6) as between_var,
      round(sqrt(avg(s * s) + var_pop(e)), 6) as pooled_sd
    from per group by coefficient""",
)


def contrast_sql(label: str, value: str, group: str = "") -> str:
    head = f"'{group}' as remoteness, " if group else ""
    return f"""select {head}'{label}' as contrast, count(*) as n_values,
      round(quantile_cont({value}, 0.5), 9) as estimate, round(quantile_cont({value}, 0.025), 9) as lower,
      round(quantile_cont({value}, 0.975), 9) as upper from v_draws"""


add(
    "q_contrasts",
    DRAWS,
    " union all ".join(
        contrast_sql(n, x) for n, x in (("H-Ctrl", "b_h"), ("L-Ctrl", "b_l"), ("L-H", "b_l - b_h"))
    ),
)
add(
    "q_contrasts_by",
    DRAWS,
    " union all ".join(
        contrast_sql(n, x, g)
        for g, h, low in (
            ("Major Cities", "b_h", "b_l"),
            ("Regional/Remote", "(b_h + b_l / 2)", "(b_l + b_h / 4)"),
        )
        for n, x in (("H-Ctrl", h), ("L-Ctrl", low), ("L-H", f"{low} - {h}"))
    ),
)
add(
    "q_icc",
    UNITS
    + """,
grand as (select cohort, avg(outcome) as g from v_unit where outcome is not null group by 1),
per as (
  select u.cohort, u.cluster_id, count(*) as n, avg(u.outcome) as m, var_pop(u.outcome) * count(*) as ss
  from v_unit u where u.outcome is not null group by 1, 2),
sums as (
  select p.cohort, count(*) as k, cast(sum(n) as double) as total, cast(sum(n * n) as double) as n2,
    sum(n * (m - g) * (m - g)) as ssb, sum(ss) as ssw
  from per p join grand g on p.cohort = g.cohort group by 1),
ms as (
  select *, ssb / (k - 1) as msb, ssw / (total - k) as msw, (total - n2 / total) / (k - 1) as n0 from sums)""",
    """select cohort, k as n_clusters, cast(total as bigint) as n_units, round(msb, 6) as ms_between,
      round(msw, 6) as ms_within, round((msb - msw) / (msb + (n0 - 1) * msw), 6) as icc from ms""",
)

# Order
SQL["q_first_per_unit"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (
  select *, row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1"""
add(
    "q_first_per_cluster",
    UNITS,
    """select cluster_id, unit_id, arm, baseline from (
      select *, row_number() over (partition by cluster_id order by unit_id) as rn from v_unit) where rn = 1""",
)
for _name in ("q_enrolment_rank", "q_enrolment_rank_ranges"):
    add(_name, CLUSTERS + "," + RANKED, "select cluster_id, remoteness, stype, rownumber from ranked")
add("q_sort", CLUSTERS, "select cluster_id, decile from v_cluster order by decile nulls last, cluster_id")

# Reshape
add(
    "q_union_fill",
    CLUSTERS,
    """select cluster_id, decile, cast(null as varchar) as stype from v_cluster
    union all select cluster_id, null, stype from v_cluster""",
)
_ARMS2 = ("H", "L")
add(
    "q_stage_union",
    CLUSTERS
    + """,
staged as (select *, cluster_id * 109 <= 56 * mx as early from v_cluster cross join bound),
ranked as (
  select *, row_number() over (partition by early, remoteness, stype order by cluster_id) as rownumber
  from staged)""",
    f"""select cluster_id, rownumber,
      case when early then {block_sql("rownumber")} else {block_sql("rownumber", _ARMS2)} end as block_id,
      case when early then {arm_sql("rownumber")} else {arm_sql("rownumber", _ARMS2)} end as treatment
    from ranked""",
)
add(
    "q_pivot_time",
    UNITS,
    """select unit_id, min(case when time = 1 then value end) as baseline,
      min(case when time = 2 then value end) as outcome from v_long group by unit_id""",
)
SQL["q_duplicate_keys"] = """select l_orderkey, l_linenumber, count(*) as n_rows from lineitem
group by 1, 2 having count(*) > 1"""
add(
    "q_stack_imp",
    UNITS,
    f"""select cast(i.imp as integer) as imp, row_number() over (partition by i.imp order by unit_id) as id,
      unit_id, outcome
    from v_unit cross join (values {", ".join(f"({i})" for i in range(1, IMPUTATIONS + 1))}) i(imp)""",
)
add(
    "q_harmonise",
    UNITS,
    """select unit_id, cluster_id, stype,
      case when cohort = 0 then arm when arm = 'Ctrl' then 'Ctrl' else 'H' end as arm,
      case ses when 'Least' then 'Least disadvantaged' when 'Most' then 'Most disadvantaged' end as ses,
      remoteness, baseline, outcome, cohort
    from v_unit where cohort = 0 or baseline is not null or outcome is not null""",
)
add(
    "q_assign_blocks",
    CLUSTERS + "," + RANKED,
    f"""select cluster_id, remoteness, stype, rownumber, {block_sql("rownumber")} as block_id,
      {arm_sql("rownumber")} as treatment from ranked""",
)
add(
    "q_seed_compare",
    CLUSTERS + "," + RANKED,
    " union all ".join(
        f"""select cluster_id, cast({s} as integer) as seed, {arm_sql("rownumber", seed=str(s))} as treatment
        from ranked"""
        for s in (FIT_SEED, SENSITIVITY_SEED)
    ),
)
add(
    "q_counterfactual",
    UNITS,
    """select unit_id, u.arm as old_arm, baseline, a.arm from v_unit u
    cross join (values ('Ctrl'), ('H'), ('L')) a(arm)""",
)
add(
    "q_substitute_outcome",
    PREDS,
    """select p.unit_id, p.arm, p.imp,
      case when u.outcome is null then null when p.old_arm = p.arm then u.outcome else p.pred end as outcome,
      case when p.old_arm = p.arm then u.outcome else p.pred end as outcome_filled
    from v_preds p join v_unit u on u.unit_id = p.unit_id""",
)

# Model
_X = {1: "h", 2: "l", 3: "baseline", 4: "cohort"}
_PAIRS = [(j, k) for j in _X for k in _X if j <= k]
_per = [f"sum({x}) as s{j}" for j, x in _X.items()]
_per += [f"sum({_X[j]} * {_X[k]}) as q{j}_{k}" for j, k in _PAIRS]
_per += [f"sum({x} * outcome) as r{j}" for j, x in _X.items()]
_all = [f"s{j}" for j in _X] + [f"q{j}_{k}" for j, k in _PAIRS] + [f"r{j}" for j in _X] + ["t", "yy"]
_totals = [(c, c) for c in _all] + [(f"ss{j}_{k}", f"s{j} * s{k}") for j, k in _PAIRS]
_totals += [(f"st{j}", f"s{j} * t") for j in _X] + [("tt", "t * t")]
_SQUARES = ("q3_3", "r3", "yy", "ss3_3", "st3", "tt")
_out = [f"round(sum({c}), {2 if n in _SQUARES else 6}) as {n}" for n, c in _totals]
add(
    "q_fit_stats",
    UNITS
    + f""",
x as (
  select cluster_id, case when arm = 'H' then 1.0::double else 0 end as h,
    case when arm = 'L' then 1.0::double else 0 end as l, baseline, cast(cohort as double) as cohort, outcome
  from v_unit where baseline is not null and outcome is not null),
per as (
  select cluster_id, count(*) as n, {", ".join(_per)}, sum(outcome) as t, sum(outcome * outcome) as yy
  from x group by 1)""",
    f"select n, count(*) as n_clusters, {', '.join(_out)} from per group by n",
)
add(
    "q_score_mean",
    UNITS
    + ","
    + DRAWS
    + """,
beta as (select imp, avg(b_h) as bh, avg(b_l) as bl from v_draws group by imp),
means as (
  select cluster_id, count(*) as n, avg(outcome) as ym, avg(case when arm = 'H' then 1.0 else 0.0 end) as hm,
    avg(case when arm = 'L' then 1.0 else 0.0 end) as lm, avg(baseline) as bm
  from v_unit where baseline is not null and outcome is not null group by 1),
scored as (
  select u.cluster_id, a.arm,
    361.0::double / 9 + case when a.arm = 'H' then bh when a.arm = 'L' then bl else 0 end + imp * 0.1::double * baseline
    + coalesce(n, 0) * 25.0::double / (400 + coalesce(n, 0) * 25)
      * coalesce(ym - (361.0::double / 9 + bh * hm + bl * lm + imp * 0.1::double * bm), 0) as pred
  from v_unit u cross join (values ('Ctrl'), ('H'), ('L')) a(arm) cross join beta
  left join means m on m.cluster_id = u.cluster_id)""",
    """select cluster_id, arm, count(*) as n_rows, count(pred) as n_pred, round(avg(pred), 6) as mean_pred
    from scored group by 1, 2""",
)

SCORED = """
beta as (select imp, avg(b_h) as bh, avg(b_l) as bl from v_draws group by imp),
means as (
  select cluster_id, count(*) as n, avg(outcome) as ym, avg(case when arm = 'H' then 1.0 else 0.0 end) as hm,
    avg(case when arm = 'L' then 1.0 else 0.0 end) as lm, avg(baseline) as bm
  from v_unit where baseline is not null and outcome is not null group by 1),
parts as (
  select u.cohort, imp,
    361.0::double / 9 + case when u.arm = 'H' then bh when u.arm = 'L' then bl else 0 end + imp * 0.1::double * baseline as line,
    coalesce(n, 0) * 25.0::double / (400 + coalesce(n, 0) * 25)
      * coalesce(ym - (361.0::double / 9 + bh * hm + bl * lm + imp * 0.1::double * bm), 0) as effect
  from v_unit u cross join beta left join means m on m.cluster_id = u.cluster_id),
per as (select cohort, imp, var_samp(line) / var_samp(line + effect) as ratio from parts group by 1, 2)"""
add(
    "q_variance_decomposition",
    UNITS + "," + DRAWS + "," + SCORED,
    """select cohort, count(ratio) as n_draws, round(avg(ratio), 6) as mean,
      round(quantile_cont(ratio, 0.5), 6) as median, round(quantile_cont(ratio, 0.025), 6) as lower,
      round(quantile_cont(ratio, 0.975), 6) as upper from per group by 1""",
)
add(
    "q_gls_fixed",
    UNITS
    + """,
sums as (
  select count(*)::double as n, sum(cohort)::double as s, sum(cohort * cohort)::double as q, sum(outcome) as t,
    sum(cohort * outcome) as r from v_unit where outcome is not null group by cluster_id),
system as (
  select sum(n / (1 + n * 0.25::double)) as a00, sum(s / (1 + n * 0.25::double)) as a01,
    sum(q - 0.25::double / (1 + n * 0.25::double) * s * s) as a11, sum(t / (1 + n * 0.25::double)) as b0,
    sum(r - 0.25::double / (1 + n * 0.25::double) * s * t) as b1 from sums)""",
    """select round((a11 * b0 - a01 * b1) / (a00 * a11 - a01 * a01), 6) as intercept,
      round((a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01), 6) as slope from system""",
)
add(
    "q_left_out",
    UNITS,
    """select cohort, count(*) as n_rows, count(*) filter (where outcome is null) as n_no_outcome,
      count(*) filter (where outcome is not null and cluster_id is null) as n_no_cluster,
      count(*) filter (where outcome is not null and cluster_id is not null and ses is null) as n_no_predictor
    from v_unit group by 1""",
)

# Imputation
# A donor's place among those with equal predictions, and the choice among them, follow from md5.
DONOR_ORDER = "cast('0x' || substr(md5(cast({id} as varchar) || '|{seed}|donor'), 1, 12) as bigint)"
PICK = "cast('0x' || substr(md5(cast({id} as varchar) || '|' || cast({imp} as varchar) || '|{seed}|rank'), 1, 12) as bigint)"

add(
    "q_pmm_candidates",
    UNITS
    + f""",
rows_ as (
  select o.o_orderkey as unit_id, floor(o.o_totalprice / 50) as yhat, b.value as baseline
  from orders o left join (select * from v_long where time = 1) b on b.unit_id = o.o_orderkey),
numbered as (
  select yhat, unit_id as donor_id, baseline as y,
    row_number() over (partition by yhat order by {DONOR_ORDER.format(id="unit_id", seed=1)}, unit_id) as no
  from rows_ where baseline is not null),
lev as (select yhat as level, count(*) as n from numbered group by 1),
near as (
  select t.yhat, l.level, l.n, abs(l.level - t.yhat) as d
  from (select distinct yhat from rows_ where baseline is null) t cross join lev l),
best as (
  select yhat, min(level) as low, max(level) as high, min(d) as d, sum(n) as total,
    max(case when first then n end) as n_low
  from (select *, rank() over (partition by yhat order by d) as r,
      row_number() over (partition by yhat order by d, level) = 1 as first from near)
  where r = 1 group by 1),
drawn as (
  select r.unit_id, b.d, {PICK.format(id="r.unit_id", imp=1, seed=1)} % cast(b.total as bigint) + 1 as u, b.low, b.high, b.n_low
  from rows_ r join best b on b.yhat = r.yhat where r.baseline is null)""",
    """select w.unit_id, n.donor_id, w.d as distance, n.y
    from drawn w join numbered n on n.yhat = case when w.u <= w.n_low then w.low else w.high end
      and n.no = case when w.u <= w.n_low then w.u else w.u - w.n_low end""",
)
add(
    "q_impute_pmm",
    UNITS
    + f""",
donors as (
  select arm, stype, remoteness, cohort, baseline as y,
    row_number() over (partition by arm, stype, remoteness, cohort
      order by {DONOR_ORDER.format(id="unit_id", seed=1)}, unit_id) as no,
    count(*) over (partition by arm, stype, remoteness, cohort) as n
  from v_unit where baseline is not null)""",
    # every combination of the factors has at least five donors, all at distance zero
    f"""select u.unit_id, cast(1 as integer) as imp, coalesce(u.baseline, d.y) as baseline, u.outcome
    from v_unit u left join donors d on u.baseline is null and d.arm = u.arm and d.stype = u.stype
      and d.remoteness = u.remoteness and d.cohort = u.cohort
      and d.no = {PICK.format(id="u.unit_id", imp=1, seed=1)} % d.n + 1""",
)

_SEEDED_PICK = "cast('0x' || substr(md5(cast(u.unit_id as varchar) || '|1|' || cast(s.seed as varchar) || '|rank'), 1, 12) as bigint)"
_SEEDED_ORDER = "cast('0x' || substr(md5(cast(unit_id as varchar) || '|' || cast(seed as varchar) || '|donor'), 1, 12) as bigint)"
add(
    "q_seed_units",
    UNITS
    + f""",
seeds as (select cast(range as integer) as seed from range(1, 4)),
donors as (
  select seed, arm, stype, remoteness, cohort, baseline as y,
    row_number() over (partition by seed, arm, stype, remoteness, cohort order by {_SEEDED_ORDER}, unit_id) as no,
    count(*) over (partition by seed, arm, stype, remoteness, cohort) as n
  from v_unit cross join seeds where baseline is not null)""",
    f"""select s.seed, u.unit_id, cast(1 as integer) as imp, coalesce(u.baseline, d.y) as baseline
    from v_unit u cross join seeds s left join donors d on u.baseline is null and d.seed = s.seed and d.arm = u.arm
      and d.stype = u.stype and d.remoteness = u.remoteness and d.cohort = u.cohort and d.no = {_SEEDED_PICK} % d.n + 1""",
)


def _md5_normal(key: str) -> str:
    """Standard normal number from md5, by imputation."""

    def uniform(which: str) -> str:
        return f"(cast('0x' || substr(md5(cast(imp as varchar) || '|{key}|1|proper/{which}'), 1, 12) as bigint) + 0.5::double) / 281474976710656"

    return f"sqrt(-2 * ln({uniform('radius')})) * cos(2 * pi() * {uniform('angle')})"


# Coefficients about the mean of the predictor: slope and level are independent given the variance.
add(
    "q_impute_proper",
    UNITS
    + f""",
rows_ as (
  select o.o_orderkey as unit_id, cast(floor(o.o_totalprice / 5000) as double) as x, b.value as y
  from orders o left join (select * from v_long where time = 1) b on b.unit_id = o.o_orderkey),
centre as (select avg(x) as mx, avg(y) as my, count(*)::double as n from rows_ where y is not null),
sums as (
  select sum((x - mx) * (x - mx)) as sxx, sum((x - mx) * (y - my)) as sxy, sum((y - my) * (y - my)) as syy
  from rows_, centre where y is not null),
fit as (
  select mx, my, n, sxx * 1.00001::double as pen, sxy / (sxx * 1.00001::double) as b,
    syy - 2 * sxy / (sxx * 1.00001::double) * sxy + sxx * (sxy / (sxx * 1.00001::double)) * (sxy / (sxx * 1.00001::double)) as rss
  from sums, centre),
z as (
  select cast(imp as integer) as imp, {_md5_normal("variance")} as zv, {_md5_normal("0")} as z0, {_md5_normal("1")} as z1
  from range(1, 6) r(imp)),
spread as (select z.*, sqrt(rss / ((n - 2) * pow(1 - 2 / (9 * (n - 2)) + zv * sqrt(2 / (9 * (n - 2))), 3))) as s from z, fit),
line as (select imp, my + s * z0 / sqrt(n) as level, b + s * z1 / sqrt(pen) as slope from spread, fit),
lev as (
  select x, my + b * (x - mx) as yhat, count(*) as n from rows_, fit where y is not null group by x, my, b, mx),
donors as (
  select x, y, row_number() over (partition by x order by {DONOR_ORDER.format(id="unit_id", seed=1)}, unit_id) as no
  from rows_ where y is not null),
near as (
  select t.x, imp, arg_min(lev.x, abs(lev.yhat - (level + slope * (t.x - mx)))) as dx
  from (select distinct x from rows_ where y is null) t, line, fit, lev group by 1, 2)""",
    f"""select unit_id, cast(imp as integer) as imp, y as baseline from rows_ cross join line where y is not null
    union all
    select r.unit_id, n.imp, d.y from rows_ r join near n on n.x = r.x join lev on lev.x = n.dx
    join donors d on d.x = n.dx and d.no = {PICK.format(id="r.unit_id", imp="n.imp", seed=1)} % lev.n + 1 where r.y is null""",
)

add(
    "q_store_exclusion",
    UNITS,
    """select count(distinct cluster_id) as n_clusters, count(*) as n, count(*) filter (where arm = 'H')::double as "sum_arm_H",
      count(*) filter (where arm = 'L')::double as "sum_arm_L", count(*) filter (where ses = 'Most')::double as "sum_ses_Most",
      sum(cohort)::double as sum_cohort, round(sum(outcome), 6) as sum_outcome
    from v_unit where outcome is not null and ses is not null and not (cohort = 1 and arm = 'H')""",
)
add(
    "q_quantile_sketch",
    UNITS,
    """select arm, count(outcome) as n, quantile, true as within
    from v_unit cross join (values ('q1'), ('median'), ('q3')) p(quantile) group by arm, quantile""",
)

# Whole analyses
STAGE = """
  select u.unit_id, u.cluster_id, u.new_arm as arm, p.old_arm, p.imp,
    case when u.outcome is null then null when p.old_arm = p.arm then u.outcome else p.pred end as outcome
  from {units} u join v_preds p on p.unit_id = u.unit_id and p.arm = u.new_arm"""
add(
    "q_interim_data",
    PREDS
    + f""",
chosen as (select v_unit.* from v_unit cross join bound where cluster_id * 109 <= 56 * mx),
ranked as (
  select *, row_number() over (partition by remoteness, stype order by cluster_id) as rownumber
  from (select distinct cluster_id, remoteness, stype from chosen)),
placed as (
  select c.*, {arm_sql("r.rownumber")} as new_arm from chosen c join ranked r on r.cluster_id = c.cluster_id)""",
    STAGE.format(units="placed"),
)
add(
    "q_interim_looks",
    UNITS
    + f""",
chosen as (select v_unit.* from v_unit cross join bound where cluster_id * 109 <= 56 * mx),
ranked as (
  select *, row_number() over (partition by remoteness, stype order by cluster_id) as rownumber
  from (select distinct cluster_id, remoteness, stype from chosen)),
placed as (
  select c.*, {arm_sql("r.rownumber")} as new_arm from chosen c join ranked r on r.cluster_id = c.cluster_id)""",
    """select cast(l.look as integer) as look, new_arm as arm, count(distinct cluster_id) as n_clusters, count(*) as n_units,
      count(outcome) as n_outcome, count(outcome) filter (where arm <> new_arm) as n_changed,
      round(sum(outcome) filter (where arm = new_arm), 6) as sum_seen
    from placed cross join bound join (values (1, 27), (2, 37), (3, 56)) l(look, share) on cluster_id * 109 <= l.share * mx
    group by 1, 2""",
)
add(
    "q_two_stage_data",
    PREDS
    + f""",
chosen as (select *, coalesce(decile <= 5, false) as early from v_unit),
ranked as (
  select *, row_number() over (partition by early, remoteness, stype order by cluster_id) as rownumber
  from (select distinct cluster_id, remoteness, stype, early from chosen)),
placed as (
  select c.*, case when c.early then {arm_sql("r.rownumber")} else {arm_sql("r.rownumber", _ARMS2)} end as new_arm
  from chosen c join ranked r on r.cluster_id = c.cluster_id)""",
    STAGE.format(units="placed"),
)
add(
    "q_two_stage_units",
    UNITS
    + f""",
chosen as (select *, decile <= 5 as early from v_unit where decile between 1 and 8),
ranked as (
  select *, row_number() over (partition by early, remoteness, stype order by cluster_id) as rownumber
  from (select distinct cluster_id, remoteness, stype, early from chosen)),
placed as (
  select c.*, case when c.early then {arm_sql("r.rownumber", seed=str(ASSIGNMENT_SEED))}
    else {arm_sql("r.rownumber", _ARMS2, str(ASSIGNMENT_SEED))} end as new_arm
  from chosen c join ranked r on r.cluster_id = c.cluster_id)""",
    """select new_arm as arm, cast(imp as integer) as imp, count(*) as n, count(outcome) as n_outcome
    from placed cross join range(1, 101) i(imp) group by 1, 2""",
)
add(
    "q_sensitivity_data",
    UNITS,
    """select unit_id, cluster_id, u.arm as old_arm, a.arm, outcome from v_unit u
    cross join (values ('Ctrl'), ('H'), ('L')) a(arm)
    where not (cohort = 1 and u.arm = 'H')""",
)
add(
    "q_within_arm_data",
    UNITS,
    """select case when cohort = 1 then 'Sup' else 'Noninf' end as trial, stype, count(*) as n,
      count(outcome) as n_outcome, round(avg(outcome), 6) as mean_outcome
    from v_unit where arm = 'H' group by 1, 2""",
)
