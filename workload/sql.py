"""SQL text of the tract-shaped tables, shared by the oracle queries."""

from __future__ import annotations

from workload.tables import LINEAR, MEASURES

_RAW = """
with li as (
  select l_orderkey, count(*) n_lines,
    sum(cast(l_quantity as decimal(18,2))) qty,
    sum(cast(l_extendedprice as decimal(18,2))) price,
    max(cast(l_extendedprice as decimal(18,2))) maxprice,
    sum(case when l_returnflag='R' then cast(l_extendedprice as decimal(18,2)) end) rprice,
    sum(case when l_returnflag='A' then cast(l_extendedprice as decimal(18,2)) end) aprice,
    sum(case when l_linestatus='O' then cast(l_quantity as decimal(18,2)) end) oqty,
    sum(cast(l_tax as decimal(18,2))) tax, sum(cast(l_discount as decimal(18,2))) disc
  from lineitem group by l_orderkey),
o as (
  select o_custkey, count(*) n_orders,
    sum(cast(o_totalprice as decimal(18,2))) tot, sum(n_lines) n_lines, sum(qty) qty,
    sum(price) price, max(maxprice) maxprice, sum(rprice) rprice, sum(aprice) aprice,
    sum(oqty) oqty, sum(tax) tax, sum(disc) disc,
    sum(case when o_orderpriority='1-URGENT' then cast(o_totalprice as decimal(18,2)) end) urg
  from orders left join li on l_orderkey=o_orderkey group by o_custkey),
raw as (
  select cast(r_regionkey+1 as bigint)*1000000000 + n_nationkey*1000000 + c_custkey ID,
    substr(r_name,1,2) ST_ABBREV, r_name STATE_NAME,
    case when c_custkey % 50 <> 0 then concat('County ', cast((n_nationkey - n_nationkey % 5)/5 as int)) end CNTY_NAME,
    cast(tot as double) CANCER, cast(price as double) RESP, cast(n_lines as double) PM25,
    cast(qty as double) OZONE, cast(rprice as double) DSLPM, cast(urg as double) PTRAF,
    cast(aprice as double) LDPNT, cast(oqty as double) PNPL, cast(maxprice as double) PRMP,
    cast(tax as double) PTSDF, cast(disc as double) UST, cast(n_orders as double) PWDIS,
    c_acctbal LOWINCPCT, cast(c_custkey % 101 as double) PEOPCOLORPCT,
    (c_acctbal+1000)/11000 DEMOGIDX_2
  from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
    left join o on o_custkey=c_custkey)
"""

P_COLUMNS = [f"P_{c}" for c in MEASURES]

_percentiles = ",\n  ".join(
    f"case when {c} is not null then 100*percent_rank() over "
    f"(partition by ST_ABBREV, {c} is null order by {c}) end P_{c}"
    for c in MEASURES
)

# Ends after the unit table, so that further tables follow with a comma.
UNIT = f"{_RAW},\nunit as (select ID, ST_ABBREV, STATE_NAME, CNTY_NAME, DEMOGIDX_2,\n  {_percentiles}\n  from raw)"

INDEX = f"""{UNIT},
idx as (select concat(' ', lpad(cast(ID as varchar),11,'0'), ' ') GEOID,
  percent_rank() over (order by P_PTSDF, ID) RPL_EJI
  from unit where DEMOGIDX_2 < 0.9 and P_PTSDF is not null)"""

# An index that covers all tracts, for the models.
WHOLE_INDEX = f"""{UNIT},
idx as (select concat(' ', lpad(cast(ID as varchar),11,'0'), ' ') GEOID,
  percent_rank() over (order by coalesce(P_PTSDF, -1), ID) RPL_EJI from unit)"""

_features = list(LINEAR["cancer"])
_contributions = ",\n  ".join(
    f"round({weight}*({f} - avg({f}) over (partition by ST_ABBREV)),7)+0.0 shap_{o}_{f}"
    for o, weights in LINEAR.items()
    for f, weight in weights.items()
)
_long = " union all ".join(
    f"select ID, ST_ABBREV, CNTY_NAME, '{o}' outcome, '{f}' feature, shap_{o}_{f} shap from contrib"
    for o in LINEAR
    for f in _features
)

DRIVERS = f"""{UNIT},
contrib as (select ID, ST_ABBREV, CNTY_NAME, {_contributions}
  from unit where {" and ".join(f"{f} is not null" for f in _features)}),
drv as ({_long}),
ranked as (select *, row_number() over (partition by ID, outcome order by abs(shap) desc, feature) rk from drv)"""


def r6(expression: str, digits: int = 6) -> str:
    """Rounded, with negative zero made plain."""
    return f"(round({expression},{digits})+0.0)"


def labelled(column: str, labels: dict[str, str]) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in labels.items())
    return f"case {column} {cases} else {column} end"


def plain(expression: str) -> str:
    """Text of a number with few decimals, whole numbers bare."""
    return f"regexp_replace(cast({expression} as varchar), '\\.0$', '')"


def fixed1(expression: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', round({expression},{digits}))"


STRIPPED = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,"
    "'(?is)<script\\b.*?</script>',' ','g'),'(?is)<style\\b.*?</style>',' ','g'),"
    "'<[^>]+>',' ','g'),'\\s+',' ','g'))"
)


def _ols_parts(y: str) -> dict[str, str]:
    """Coefficients of y on three predictors from the covariances in table m, by cofactors."""
    c = {
        "11": "(s_bb*s_cc-s_bc*s_bc)", "12": "(s_ac*s_bc-s_ab*s_cc)", "13": "(s_ab*s_bc-s_ac*s_bb)",
        "22": "(s_aa*s_cc-s_ac*s_ac)", "23": "(s_ab*s_ac-s_aa*s_bc)", "33": "(s_aa*s_bb-s_ab*s_ab)",
    }
    det = f"(s_aa*{c['11']}+s_ab*{c['12']}+s_ac*{c['13']})"
    a, b, d = f"s_a{y}", f"s_b{y}", f"s_c{y}"
    return {
        "ba": f"(({c['11']}*{a}+{c['12']}*{b}+{c['13']}*{d})/{det})",
        "bb": f"(({c['12']}*{a}+{c['22']}*{b}+{c['23']}*{d})/{det})",
        "bc": f"(({c['13']}*{a}+{c['23']}*{b}+{c['33']}*{d})/{det})",
    }


def _ols(keys: str, sample: str) -> str:
    """CTEs m (moments) and fit (coefficients) over the complete rows named sample."""
    x = {"a": "P_DSLPM", "b": "P_PTRAF", "c": "DEMOGIDX_2"}
    y = {"y": "P_CANCER", "z": "P_RESP"}
    every = {**x, **y}
    names = list(every)
    moments = [f"covar_pop({every[i]},{every[j]}) s_{i}{j}" for n, i in enumerate(names) for j in names[n:]]
    means = [f"avg({c}) m_{i}" for i, c in every.items()]
    group = f"group by {keys}" if keys else ""
    head = f"{keys}," if keys else ""
    parts = []
    for i, name in (("y", "cancer"), ("z", "resp")):
        p = _ols_parts(i)
        parts += [f"{p[k]} {k}_{name}" for k in p]
    inner = f"select *, {', '.join(parts)} from m"
    outer = []
    for i, name in (("y", "cancer"), ("z", "resp")):
        outer.append(f"m_{i}-ba_{name}*m_a-bb_{name}*m_b-bc_{name}*m_c i_{name}")
        outer.append(f"(ba_{name}*s_a{i}+bb_{name}*s_b{i}+bc_{name}*s_c{i})/s_{i}{i} r2_{name}")
    return f"""
m as (select {head} count(*) n, {", ".join(means)}, {", ".join(moments)} from {sample} {group}),
fit as (select *, {", ".join(outer)} from ({inner}))"""


FIVE = "P_CANCER is not null and P_RESP is not null and P_DSLPM is not null and P_PTRAF is not null and DEMOGIDX_2 is not null"

OLS = f"""{UNIT},
five as (select * from unit where {FIVE}),
{_ols("ST_ABBREV", "five")}"""

OLS_ALL = f"""{UNIT},
every as (select * from unit where {" and ".join(f"{c} is not null" for c in [*P_COLUMNS, "DEMOGIDX_2"])}),
{_ols("", "every")}"""

RESILIENCE = f"""{OLS},
pred as (select u.*, f.n,
    i_cancer+ba_cancer*P_DSLPM+bb_cancer*P_PTRAF+bc_cancer*DEMOGIDX_2 P_CANCER_pred,
    i_resp+ba_resp*P_DSLPM+bb_resp*P_PTRAF+bc_resp*DEMOGIDX_2 P_RESP_pred,
    DEMOGIDX_2 >= median(DEMOGIDX_2) over (partition by u.ST_ABBREV) high_vulnerability
  from five u join fit f on u.ST_ABBREV=f.ST_ABBREV where f.n >= 10),
res as (select *, P_CANCER-P_CANCER_pred resid_cancer, P_RESP-P_RESP_pred resid_resp,
    high_vulnerability and P_CANCER-P_CANCER_pred < 0 resilient_cancer,
    high_vulnerability and P_RESP-P_RESP_pred < 0 resilient_resp from pred),
summ as (select s.ST_ABBREV, cast(coalesce(f.n,0) as bigint) n_tracts, c.n_resilient_cancer, c.n_resilient_resp,
    case when f.n>=10 then {r6("f.r2_cancer", 4)} end r2_cancer, case when f.n>=10 then {r6("f.r2_resp", 4)} end r2_resp
  from (select distinct ST_ABBREV from unit where ST_ABBREV is not null) s
  left join fit f on f.ST_ABBREV=s.ST_ABBREV
  left join (select ST_ABBREV, count(*) filter (resilient_cancer) n_resilient_cancer,
    count(*) filter (resilient_resp) n_resilient_resp from res group by ST_ABBREV) c on c.ST_ABBREV=s.ST_ABBREV)"""

ROLLUP = ["P_CANCER", "P_RESP", "P_PM25", "P_OZONE", "P_DSLPM", "P_PTRAF", "P_LDPNT", "P_PNPL",
          "P_PRMP", "P_PTSDF", "P_UST", "P_PWDIS", "P_LOWINCPCT", "P_PEOPCOLORPCT"]


def exact_sum(expression: str) -> str:
    """A sum in whole units of 2^-60, so that neither the order of rows nor a last bit matters."""
    return f"cast(sum(cast(({expression}) * 1152921504606846976.0 as hugeint)) as double) / 1152921504606846976.0"


COUNTY_TABLE = f"""county as (select ST_ABBREV, coalesce(CNTY_NAME,'Unknown') county, count(*) tract_count,
  {", ".join(f"coalesce({exact_sum(c)} / count({c}),0) {c}" for c in ROLLUP)} from unit group by 1,2),
state as (select ST_ABBREV, cast(sum(tract_count) as bigint) tract_count, count(*) county_count,
  {", ".join(f"{exact_sum(f'{c}*tract_count')}/sum(tract_count) {c}" for c in ROLLUP)} from county group by 1)"""

COUNTY = f"{UNIT},\n{COUNTY_TABLE}"
