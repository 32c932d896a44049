"""DuckDB SQL for the registered queries, over the same tables and the same mapping."""

from __future__ import annotations

from riskloom.functions.privacy import _pads
from riskloom.plans.queries import AS_OF, GRAPH_WINDOW, K, ROUNDS, SALT, SIMILARITY
from riskloom.sources.adapters import SQL

BASE = f"with recursive {SQL.strip()}"


def _hmac(x: str) -> str:
    inner, outer = _pads(SALT)
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({x}))))"


def _days(low: str, high: str) -> str:
    return f"date_sub('day', {low}, {high})"


TEMPORAL = f"""
middle as (select provider_npi, median(date_of_service) as m from claims group by 1),
halves as (select provider_npi, min(date_of_service) as low, max(date_of_service) as high, count(*) as n, count_if(isodow(date_of_service) >= 6) as weekend,
  count_if(date_of_service >= m) as rn, count_if(date_of_service < m) as o_n,
  min(date_of_service) filter (where date_of_service >= m) as rl, max(date_of_service) filter (where date_of_service >= m) as rh,
  min(date_of_service) filter (where date_of_service < m) as ol, max(date_of_service) filter (where date_of_service < m) as oh from claims join middle using (provider_npi) group by 1),
months as (select provider_npi, stddev_samp(n) as s, avg(n) as a from (select provider_npi, month(date_of_service) as mo, count(*) as n from claims group by 1, 2) group by 1),
rates as (select *, cast(rn as double) / greatest({_days("rl", "rh")}, 1) as r, cast(o_n as double) / greatest({_days("ol", "oh")}, 1) as o, greatest({_days("low", "high")}, 1) as days from halves),
temporal as (select provider_npi, cast(days as bigint) as active_days, round(cast(n as double) / days, 9) as claims_per_day, round(cast(weekend as double) / n, 9) as weekend_ratio,
  round(coalesce(s / greatest(a, 1), 0), 4) as monthly_variation, round(case when o_n > 0 then (r - o) / greatest(o, 0.001) else 0 end, 9) as velocity_change from rates join months using (provider_npi))"""

EXACT = "cast(sum(cast({} as decimal(28,6))) as double)"
BILLING = f"""
p95 as (select provider_npi, quantile_cont(billed_amount, 0.95) as q from claims group by 1),
tops as (select provider_npi, max(n) as top from (select provider_npi, procedure_code, count(*) as n from claims group by 1, 2) group by 1),
sums as (select provider_npi, count(*) as n, {EXACT.format("billed_amount")} as b, {EXACT.format("paid_amount")} as p, coalesce(stddev_samp(billed_amount), 0) as s, max(billed_amount) as m,
  count_if(billed_amount > q) as h, count(distinct beneficiary_id) as u, count(distinct procedure_code) as c from claims join p95 using (provider_npi) group by 1),
billing as (select provider_npi, cast(n as bigint) as total_claims, round(b, 4) as total_billed, round(p, 4) as total_paid, round(b / n, 4) as avg_billed, round(s, 4) as std_billed, round(m, 9) as max_billed,
  round(cast(h as double) / n, 9) as high_value_ratio, round(case when b > 0 then p / b else 0 end, 8) as payment_ratio, cast(u as bigint) as unique_patients, round(cast(n as double) / greatest(u, 1), 9) as claims_per_patient,
  cast(c as bigint) as unique_procedures, round(cast(top as double) / n, 9) as top_procedure_concentration from sums join tops using (provider_npi))"""

LEVEL = "case procedure_code when '99203' then 3 when '99204' then 4 when '99213' then 3 when '99214' then 4 when '99215' then 5 end"
MINUTES = "case procedure_code when '99213' then 15 when '99214' then 25 when '99215' then 40 when '90837' then 60 else 15 end"
UPCODING = f"""
upcoding as (select provider_npi, round(coalesce(cast(sum({LEVEL}) as double) / nullif(count({LEVEL}), 0), 0), 9) as avg_complexity, round(coalesce(cast(count_if({LEVEL} >= 4) as double) / nullif(count({LEVEL}), 0), 0), 9) as high_complexity_ratio,
  round(coalesce(cast(count_if({LEVEL} = 5) as double) / nullif(count({LEVEL}), 0), 0), 9) as level_5_ratio from claims group by 1)"""
IMPOSSIBLE = f"""
days as (select provider_npi, cast(date_of_service as date) as d, sum({MINUTES}) as m from claims group by 1, 2),
impossible as (select provider_npi, cast(count_if(m > 1440) as bigint) as impossible_days_count, round(cast(count_if(m > 1440) as double) / count(*), 9) as impossible_days_ratio, round(cast(sum(m) as double) / count(*) / 60, 9) as avg_daily_hours,
  round(cast(max(m) as double) / 60, 9) as max_daily_hours from days group by 1)"""


def _co_bills(window: int) -> str:
    return f"""
near as (select a.beneficiary_id as b, a.provider_npi as src, b.provider_npi as dst, a.claim_id as c1, a.date_of_service as date, abs(epoch_us(b.date_of_service) - epoch_us(a.date_of_service)) as gap,
  row_number() over (partition by a.beneficiary_id, a.provider_npi, b.provider_npi, a.claim_id, a.date_of_service order by b.date_of_service, b.claim_id) as k
  from claims a join claims b on a.beneficiary_id = b.beneficiary_id and a.provider_npi < b.provider_npi and abs(epoch_us(b.date_of_service) - epoch_us(a.date_of_service)) <= {window} * 86400000000),
co_bills as (select distinct src, dst, 'CO_BILLS_WITH' as edge_type, date, b as beneficiary, cast(gap // 86400000000 as bigint) as date_diff_days, c1 from near where k = 1)"""


GRAPH = f"""{_co_bills(GRAPH_WINDOW)},
pairs as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as n from co_bills group by 1, 2),
graph as (select a as src, b as dst, 1.0::double as weight, cast(n as double) as w from pairs union all select b, a, 1.0::double, cast(n as double) from pairs),
nodes as (select distinct src as node_id from graph),
seeds as (select node_id from nodes join exclusions on node_id = entity_npi)"""
RESTART = """
counted as (select (select count(*) from seeds) as k, (select count(*) from nodes) as n),
restart as (select node_id, case when k > 0 then case when node_id in (select node_id from seeds) then 1.0::double / k else 0 end else 1.0::double / n end as r, 1.0::double / n as even from nodes, counted)"""


def _walk(name: str, weight: str, damping: str, start: str, share: str, loops: bool = False, restart: str = "r") -> str:
    looped = f"select src, dst, {weight} as w from graph" + (" union all select node_id, node_id, 1.0::double from nodes" if loops else "")
    return f"""
{name}_edges as ({looped}), {name}_total as (select {share} as t, sum(w) as s from {name}_edges group by 1),
{name}_steps as (select src, dst, w / s as part from {name}_edges join {name}_total on {share} = t),
{name}_loop as (select node_id, {start} as score, 0 as k from restart union all
  select n.node_id, {damping} * coalesce(sum(l.score * e.part), 0) + (1 - {damping}) * any_value(n.{restart}), any_value(l.k) + 1 from restart n join {name}_steps e on e.dst = n.node_id join {name}_loop l on l.node_id = e.src where l.k < {ROUNDS} group by n.node_id),
{name} as (select node_id, score from {name}_loop where k = {ROUNDS})"""


PPR = _walk("ppr", "w", "0.85::double", "even", "src")
PLAIN_PPR = _walk("ppr", "weight", "0.85::double", "even", "src")
RWR = _walk("rwr", "weight", "0.85::double", "r", "src", loops=True)
LABELS = """
labels as (select node_id, case when node_id in (select node_id from seeds) then 1.0::double else 0 end as r from nodes)"""
LP = _walk("lp", "weight", "0.8::double", "r", "dst").replace("from restart n ", "from labels n ").replace("from restart union", "from labels union")
ENSEMBLE = f"""{GRAPH},{RESTART},{LABELS},{PLAIN_PPR},{RWR},{LP},
ensemble as (select node_id, round(ppr.score, 7) as pagerank, round(rwr.score, 7) as rwr, round(lp.score, 7) as label_propagation, round((ppr.score + rwr.score + lp.score) / 3, 7) as ensemble_score from ppr join rwr using (node_id) join lp using (node_id))"""


def _scored(by: int = 7, name: str = "scored") -> str:
    return f"{name} as (select lpad(cast(s_suppkey as varchar), 10, '0') as id, cast(s_suppkey * {by} % 50 as double) / 50 as score, case when s_suppkey % 10 = 3 then 1 else 0 end as label from supplier)"


def _points(name: str = "scored") -> str:
    return f"""
by_{name} as (select score, count(*) as n, sum(label) as pos from {name} group by 1),
at_{name} as (select score, n, pos, sum(n) over w as nu, sum(pos) over w as pu, sum(n) over () as na, sum(pos) over () as pa from by_{name} window w as (order by score desc rows unbounded preceding))"""


AP = "round(coalesce(sum(cast(pos as double) / pa * pu / nu), 0), 9)"
AUC = "round(coalesce(sum(pos * ((na - pa) - (nu - pu) + (n - pos) / 2.0::double)) / nullif(max(pa) * (max(na) - max(pa)), 0), 0), 9)"


def _hits(name: str) -> str:
    return f"(select sum(label) from (select label from {name} order by score desc, id limit {K}))"


EDGE_SQL = {
    "bills_for": "select provider_npi as src, 'CLAIM_' || claim_id as dst, 'BILLS_FOR' as edge_type, date_of_service as date, round(billed_amount, 9) as amount from claims",
    "treats": "select provider_npi as src, beneficiary_id as dst, 'TREATS' as edge_type, date_of_service as date from claims where beneficiary_id <> ''",
    "refers_to": "select referring_provider_npi as src, provider_npi as dst, 'REFERS_TO' as edge_type, date_of_service as date from claims where referring_provider_npi <> '' and referring_provider_npi <> provider_npi",
    "flagged_by": "select entity_npi as src, 'EXCL_' || entity_npi || '_' || strftime(exclusion_date, '%Y%m%d') as dst, 'FLAGGED_BY' as edge_type, exclusion_date as date from exclusions",
    "owned_by": "select provider_npi as src, owner_id as dst, 'OWNED_BY' as edge_type, ownership_percentage from ownership",
    "shares_facility": "select distinct provider_npi as src, 'FAC_' || facility_id as dst, 'SHARES_FACILITY' as edge_type from claims where facility_id in (select facility_id from claims group by 1 having count(distinct provider_npi) > 1)",
    "shares_bank": "select distinct provider_npi as src, 'BANK_' || account_hash as dst, 'SHARES_BANK_ACCOUNT' as edge_type from bank_accounts where account_hash in (select account_hash from bank_accounts group by 1 having count(distinct provider_npi) > 1)",
}
def _similar(code: str, threshold: float) -> str:
    return f"""
vec as (select provider_npi as p, {code} as c, cast(count(*) as double) as n from claims where {code} is not null group by 1, 2), len as (select p, sqrt(sum(n * n)) as l from vec group by 1),
cos as (select a.p as src, b.p as dst, sum(a.n * b.n) / (any_value(la.l) * any_value(lb.l)) as s from vec a join vec b on a.c = b.c and a.p < b.p join len la on la.p = a.p join len lb on lb.p = b.p group by 1, 2),
similar_billing as (select src, dst, 'SIMILAR_BILLING_PATTERN' as edge_type, round(s, 9) as similarity from cos where s >= {threshold})"""


ALL_NODES = f"""
typed as (select npi as id, 'Provider' as node_type, specialty, license_state as state, null as source, null as role from providers
  union all select distinct 'CLAIM_' || claim_id, 'Claim', null, null, null, null from claims
  union all select distinct beneficiary_id, 'Beneficiary', null, null, null, null from claims where beneficiary_id <> ''
  union all select 'EXCL_' || entity_npi || '_' || strftime(exclusion_date, '%Y%m%d'), 'Exclusion', null, null, exclusion_source, null from exclusions
  union all select distinct owner_id, 'Owner', null, null, null, 'Owner' from ownership
  union all select distinct dst, 'Facility', null, null, null, null from ({EDGE_SQL["shares_facility"]})
  union all select distinct dst, 'BankAccount', null, null, null, null from ({EDGE_SQL["shares_bank"]}))"""


def oracle_sql() -> dict[str, str]:
    out = {
        "clean_claims": f"{BASE} select claim_id, provider_npi, date_of_service, round(cast(cast(billed_amount as decimal(18,2)) as double), 4) as billed_amount, 0.0::double as paid_amount, procedure_code from claims",
        "date_parts": f"{BASE} select claim_id, cast(isodow(date_of_service) - 1 as bigint) as day_of_week, cast(month(date_of_service) as bigint) as month, cast(quarter(date_of_service) as bigint) as quarter, cast(year(date_of_service) as bigint) as year, cast(isodow(date_of_service) >= 6 as bigint) as is_weekend, strftime(date_of_service, '%Y-%m-%d') as day from claims",
        "code_lookup": f"{BASE} select procedure_code, cast(coalesce({LEVEL}, 0) as bigint) as level, cast({MINUTES} as bigint) as minutes, count(*) as n from claims group by all",
        "scaled_risk": "select s_suppkey as id, round(x, 9) as scaled, round(1 / (1 + exp(-x)), 9) as risk from (select s_suppkey, (s_acctbal - min(s_acctbal) over ()) / (max(s_acctbal) over () - min(s_acctbal) over () + 1e-10) as x from supplier)",
        "hash_columns": f"{BASE} select npi, provider_name, {_hmac('npi')} as npi_hash, {_hmac('provider_name')} as provider_name_hash from providers",
        "entity_id": f"{BASE} select npi, {_hmac('''npi || '|' || specialty''')} as entity_id from providers",
        "verify_hash": f"{BASE} select npi, true as same, provider_name = npi as other from providers",
        "token_lookup": f"{BASE} select distinct npi as id, 32::bigint as n from providers",
        "temporal_features": f"{BASE},{TEMPORAL} select * from temporal",
        "billing_features": f"{BASE},{BILLING} select * from billing",
        "upcoding_features": f"{BASE},{UPCODING} select * from upcoding",
        "impossible_days": f"{BASE},{IMPOSSIBLE} select * from impossible",
        "all_claim_features": f"{BASE},{TEMPORAL},{BILLING},{UPCODING},{IMPOSSIBLE} select npi as provider_npi, coalesce(columns(* exclude (provider_npi, npi)), 0) from (select npi from providers) left join temporal on npi = temporal.provider_npi left join billing on npi = billing.provider_npi left join upcoding on npi = upcoding.provider_npi left join impossible on npi = impossible.provider_npi",
        "pipeline_claim_features": f"{BASE}, s as (select provider_npi, count(*) as n, {EXACT.format('billed_amount')} as b, count(distinct beneficiary_id) as u, {_days('min(date_of_service)', 'max(date_of_service)')} as d from claims group by 1) select npi as provider_npi, coalesce(n, 0) as claim_count, round(coalesce(b, 0), 4) as total_billed, round(coalesce(b / n, 0), 4) as avg_billed, coalesce(u, 0) as unique_patients, cast(coalesce(d, 0) as bigint) as active_days, round(coalesce(cast(n as double) / greatest(d, 1), 0), 9) as claims_per_day from providers left join s on npi = provider_npi",
        "validate_providers": f"{BASE} select count(*) as n_rows, count_if(npi is null)::bigint as missing_npi, count(*) - count(distinct npi) as duplicate_npi, count_if(not regexp_full_match(npi, '[0-9]{{10}}'))::bigint as invalid_npi from providers",
        "validate_claims": f"{BASE} select count(*) as n_rows, 0::bigint as bad_dates, count_if(date_of_service > timestamp '{AS_OF}')::bigint as future_dates, count_if(billed_amount < 0)::bigint as negative_amounts, count_if(billed_amount > 1000000)::bigint as high_amounts from claims",
        "validation_statistics": f"{BASE} select 'total_providers' as statistic, count(*) as value from providers union all select 'total_claims', count(*) from claims union all select 'total_exclusions', count(*) from exclusions union all select 'unique_providers_in_claims', count(distinct provider_npi) from claims union all select 'providers_without_claims', count(distinct npi) from providers where npi not in (select provider_npi from claims)",
        "temporal_consistency": f"{BASE}, e as (select exclusion_date - to_days(365) as d from exclusions) select (select min(date_of_service) from claims) as claims_min, (select max(date_of_service) from claims) as claims_max, min(d) as exclusions_min, max(d) as exclusions_max, (select max(date_of_service) from claims) > min(d) as potential_leakage from e",
        "validation_report": f"{BASE}, n as (select (select count(*) from providers) as p, (select count(*) from claims) as c, (select count(*) from exclusions) as e, (select count(distinct provider_npi) from claims) as u, (select count(distinct npi) from providers where npi not in (select provider_npi from claims)) as w) select unnest(['providers', 'claims', 'exclusions', 'statistics.total_providers', 'statistics.total_claims', 'statistics.total_exclusions', 'statistics.unique_providers_in_claims', 'statistics.providers_without_claims']) as \"table\", true as is_valid, unnest([p, c, e, p, c, e, u, w]) as num_records, 0::bigint as n_errors from n",
        "edges_co_bills": f"{BASE},{_co_bills(30)} select src, dst, edge_type, date, beneficiary, date_diff_days from co_bills",
        "edges_similar_billing": f"{BASE},{_similar('brand_code', SIMILARITY)} select * from similar_billing",
        "graph_nodes": f"{BASE},{ALL_NODES} select id, arg_min(node_type, o) as node_type, arg_min_null(specialty, o) as specialty, arg_min_null(state, o) as state, arg_min_null(source, o) as source, arg_min_null(role, o) as role from (select *, case node_type when 'Provider' then 0 when 'Claim' then 1 when 'Beneficiary' then 2 when 'Exclusion' then 3 when 'Owner' then 4 when 'Facility' then 5 else 6 end as o from typed) group by id",
        "graph_statistics": f"{BASE},{_co_bills(30)},{ALL_NODES},{_similar('procedure_code', 0.8)}, every as (select src, dst, edge_type from co_bills union all select src, dst, edge_type from similar_billing " +" ".join(f"union all select src, dst, edge_type from ({EDGE_SQL[k]})" for k in ("bills_for", "treats", "flagged_by", "owned_by", "shares_facility", "shares_bank", "refers_to")) + "), ends as (select src as id from every union select dst from every), n as (select coalesce(t.node_type, 'Unknown') as type, count(*) as n from (select distinct id, node_type from typed) t full join ends using (id) group by 1), e as (select edge_type as type, count(*) as n from every group by 1) select 'node' as kind, type, n from n union all select 'node', 'total', sum(n)::bigint from n union all select 'edge', type, n from e union all select 'edge', 'total', sum(n)::bigint from e",
        "metapath_graph": f"{BASE}, s as ({EDGE_SQL['shares_bank']}) select distinct a.src, b.src as dst, 2.0::double as weight from s a join s b on a.dst = b.dst and a.src < b.src",
        "provider_projection": f"{BASE},{GRAPH} select src, dst, w as weight from graph",
        "degree_centrality": f"{BASE},{_co_bills(GRAPH_WINDOW)}, every as (select distinct edge_type, src, dst from co_bills union all select distinct 'OWNED_BY', provider_npi, owner_id from ownership), ends as (select edge_type, src as node_id from every union all select edge_type, dst from every), d as (select edge_type, node_id, count(*) as k from ends group by 1, 2) select edge_type, node_id, round(cast(k as double) / (count(*) over (partition by edge_type) - 1), 9) as degree_centrality from d",
        "assembled_features": f"{BASE},{UPCODING},{IMPOSSIBLE},{GRAPH}, d as (select src as provider_npi, count(*) as degree from graph group by 1) select npi as node_id, coalesce(columns(* exclude (provider_npi, npi)), 0) from (select npi from providers) left join upcoding on npi = upcoding.provider_npi left join impossible on npi = impossible.provider_npi left join d on npi = d.provider_npi",
        "class_weights": f"{BASE}, rows as (select npi as node_id, cast(npi in (select entity_npi from exclusions) as bigint) as label from providers) select node_id, label, round(case when label = 1 then cast(count(*) filter (label = 0) over () as double) / sum(label) over () else 1 end, 9) as weight from rows",
        "degree": f"{BASE},{GRAPH} select src as node_id, count(*) as degree from graph group by 1",
        "personalized_pagerank": f"{BASE},{GRAPH},{RESTART},{PPR} select node_id, round(score, 9) as score from ppr",
        "random_walk_restart": f"{BASE},{GRAPH},{RESTART},{RWR} select node_id, round(score, 9) as score from rwr",
        "label_propagation": f"{BASE},{GRAPH},{LABELS},{LP} select node_id, round(score, 9) as score from lp",
        "baseline_ensemble": f"{BASE},{ENSEMBLE} select * from ensemble",
        "consensus_risk": f"{BASE},{ENSEMBLE}, r as (select node_id, " + " + ".join(f"rank() over (order by {c} desc) + (count(*) over (partition by {c}) - 1) / 2.0::double" for c in ("pagerank", "rwr", "label_propagation")) + f" as t from ensemble) select node_id, round(t / 3, 9) as avg_rank from r order by t, node_id limit {K}",
        "top_risk_providers": f"{BASE},{GRAPH},{RESTART},{PPR} select node_id, round(score, 7) as score from ppr where node_id not in (select entity_npi from exclusions) order by 2 desc, 1 limit {K}",
        "clustering_coefficient": f"{BASE},{GRAPH}, d as (select src, count(*) as d from graph group by 1), t as (select a.src as u, count(*) / 2 as t from graph a join graph b on a.src = b.src and a.dst <> b.dst join graph c on c.src = a.dst and c.dst = b.dst group by 1) select src as node_id, round(coalesce(2.0::double * t / nullif(d * (d - 1), 0), 0), 9) as clustering from d left join t on u = src",
        "ego_network_size": f"{BASE},{GRAPH} select npi as node_id, 1 + count(src) as ego_size from providers left join graph on npi = src group by 1",
        "distance_to_seeds": f"{BASE},{GRAPH}, most as (select count(*) as n from nodes), bfs as (select node_id, 0 as d from seeds union select g.dst, b.d + 1 from bfs b join graph g on g.src = b.node_id join most on b.d < most.n), best as (select node_id, min(d) as d from bfs group by 1) select npi as node_id, cast(coalesce(d, case when npi in (select entity_npi from exclusions) then 0 end, -1) as bigint) as distance from providers left join best on npi = node_id",
        "cooccurrence": "with p as (select o_custkey as c, o_orderpriority as x, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey, o_orderpriority) as i from orders) select a.x as a, b.x as b, round(sum(1.0::double / abs(a.i - b.i)), 6) as weight from p a join p b on a.c = b.c and a.i <> b.i and abs(a.i - b.i) <= 3 group by 1, 2",
        "pr_curve": f"with {_scored()},{_points()} select score as threshold, round(cast(pu as double) / nu, 9) as precision, round(coalesce(cast(pu as double) / nullif(pa, 0), 1), 9) as recall from at_scored union all select null, 1, 0",
        "average_precision": f"with {_scored()},{_points()} select {AP} as average_precision from at_scored",
        "roc_auc": f"with {_scored()},{_points()} select {AUC} as roc_auc from at_scored",
        "precision_recall_at_k": f"with {_scored()} select round({_hits('scored')} / {K}.0::double, 9) as precision_at_k, round(coalesce({_hits('scored')} / nullif(cast(sum(label) as double), 0), 0), 9) as recall_at_k from scored",
        "lift_at_k": f"with {_scored()}, {_scored(3, 'base')} select round(case when b > 0 then (m - b) / b when m > 0 then 'inf'::double else 0 end, 9) as lift_at_k from (select {_hits('base')} / {K}.0::double as b, {_hits('scored')} / {K}.0::double as m)",
        "optimal_threshold": f"with {_scored()},{_points()}, f as (select score, 2 * (pu::double / nu) * (pu::double / pa) / (pu::double / nu + pu::double / pa + 1e-10) as f from at_scored) select round(score, 9) as optimal_threshold, round(f, 9) as optimal_f1 from f order by round(f, 12) desc, score limit 1",
        "risk_report": f"with {_scored()}, t as (select *, row_number() over (order by score desc, id) as rank from scored) select id as provider_id, round(score, 9) as risk_score, cast(label as bigint) as is_fraud, rank, cast(sum(label) over (order by rank) as bigint) as cumulative_fraud, round(cast(sum(label) over (order by rank) as double) / rank, 9) as cumulative_precision from t where rank <= {K}",
        "model_comparison": "with " + ", ".join(f"{_scored(b, f'm{b}')},{_points(f'm{b}')}" for b in (3, 7, 9)) + ", every as (" + " union all ".join(f"select 'model_{b}' as model, {AP} as auc_pr, {AUC} as auc_roc, round({_hits(f'm{b}')} / {K}.0::double, 9) as precision_at_k, round({_hits(f'm{b}')} / cast((select sum(label) from m{b}) as double), 9) as recall_at_k from at_m{b}" for b in (3, 7, 9)) + ") select *, row_number() over (order by auc_pr desc, model) = 1 as is_best from every",
    }
    out |= {
        "pagerank_by_joins": out["personalized_pagerank"],
        "core_number": f"{BASE},{GRAPH}, cores as (select src as node_id, count(*) as c, 0 as k from graph group by 1 union all select g.src, list_max(list_transform(list_sort(list(l.c), 'DESC'), lambda x, i: least(x, i))), any_value(l.k) + 1 from cores l join graph g on g.dst = l.node_id where l.k < 60 group by g.src) select node_id, cast(c as bigint) as core from cores where k = 60",
        "betweenness": f"{BASE},{_co_bills(GRAPH_WINDOW)}, e as (select distinct src, dst from co_bills), ids as (select src as node_id from e union select dst from e), walks as (select src as s, dst as t, 1 as d, 1.0::double as n from e union all select w.s, e.dst, any_value(w.d) + 1, sum(w.n) from walks w join e on e.src = w.t group by w.s, e.dst), short as (select s, t, min(d) as d, arg_min(n, d) as n from walks group by 1, 2), b as (select v.t as node_id, sum(v.n * w.n / x.n) as b from short v join short w on w.s = v.t join short x on x.s = v.s and x.t = w.t and x.d = v.d + w.d group by 1) select node_id, round(coalesce(b, 0) / ((select count(*) from ids) - 1) / ((select count(*) from ids) - 2), 9) as betweenness from ids left join b using (node_id)",
        "eigenvector": f"{BASE},{GRAPH}, steps as (select src, dst from graph union all select node_id, node_id from nodes), eig as (select node_id, 1.0::double as x, 0 as k from nodes union all select s.dst, sum(l.x), any_value(l.k) + 1 from eig l join steps s on s.src = l.node_id where l.k < 10 group by s.dst) select node_id, round(x / sqrt(sum(x * x) over ()), 7) as eigenvector from eig where k = 10",
        "community_statistics": f"{BASE},{GRAPH}, parts as (select node_id, license_state as community from nodes join providers on npi = node_id), sizes as (select community, count(*) as size, count_if(node_id in (select entity_npi from exclusions)) as bad from parts group by 1) select npi as node_id, coalesce(community, '-1') as community_id, cast(coalesce(size, 0) as bigint) as community_size, round(coalesce(cast(bad as double) / size, 0), 9) as community_fraud_rate from providers left join parts on node_id = npi left join sizes using (community)",
        "baseline_evaluation": f"{BASE},{ENSEMBLE} select round(avg(ensemble_score) filter (where node_id in (select entity_npi from exclusions)), 6) as mean_positive, round(avg(ensemble_score) filter (where node_id not in (select entity_npi from exclusions)), 6) as mean_negative from ensemble",
        "predicted_risk": f"{BASE},{GRAPH},{RESTART},{PPR} select npi as node_id, coalesce(round(score, 7), 0) as score from providers left join ppr on npi = node_id",
        "embedding_lookup": "select lpad(cast(s_suppkey as varchar), 10, '0') as node_id, round(s_acctbal, 9) as e0, cast(s_nationkey as double) as e1, 0.0::double as e2 from supplier where s_suppkey % 10 = 3",
        "scan_providers": f"{BASE} select npi, provider_name, specialty, license_state, {_hmac('provider_name')} as provider_name_hash, case when provider_type in ('Organization', 'Facility') then 'Provider_Org' else 'Provider_Ind' end as node_type from providers",
        "scan_claims": f"{BASE} select claim_id, provider_npi, beneficiary_id, date_of_service, round(billed_amount, 4) as billed_amount, {_hmac('beneficiary_id')} as beneficiary_hash from claims",
        "scan_exclusions": f"{BASE} select entity_npi, exclusion_date, exclusion_source from exclusions",
        "scan_ownership": f"{BASE} select provider_npi, owner_id, ownership_percentage, {_hmac('owner_id')} as owner_hash from ownership",
        "scan_bank_accounts": f"{BASE} select provider_npi, account_hash from bank_accounts",
        "score_sink": f"with {_scored()} select id as provider_id, round(score, 9) as risk_score, round(score / 2, 9) as baseline_score, cast(label as bigint) as label from scored",
        "json_sink": out["precision_recall_at_k"],
    }
    wide = out["model_comparison"]
    names = ("auc_pr", "auc_roc", "precision_at_k", "recall_at_k")
    out["metrics_long"] = f"with w as ({wide}) " + " union all ".join(f"select model, '{m}' as metric, {m} as value from w" for m in names)
    p = "greatest(least(score, 1 - 1e-12), 1e-12)"
    out["focal_loss"] = f"with {_scored()}, p as (select id, label, case when label = 1 then {p} else 1 - {p} end as pt from scored) select id, round(case when label = 1 then 0.25::double else 0.75::double end * pow(1 - pt, 2) * -ln(pt), 9) as loss from p"
    return out | {f"edges_{k}": f"{BASE} {v}" for k, v in EDGE_SQL.items()}
