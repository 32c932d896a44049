"""The typed property graph as two DataFrames, nodes and edges, and its projections.

Shared facilities and accounts are hub nodes, so a group of n providers has n edges, not n squared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph_algorithms import written
from riskloom.operators.interval_sweep import DAY, first_in_window
from riskloom.operators.similarity import similar_counts, similar_pairs

#: Start nodes of a block, whose lists of neighbours are merged at a time.
MERGED = 16_384
PROVIDER_TYPES = ("Provider", "Provider_Ind", "Provider_Org")
#: The node types that edges of a type link, in their direction.
LINKS = {"BILLS_FOR": ("Provider", "Claim"), "TREATS": ("Provider", "Beneficiary"), "REFERS_TO": ("Provider", "Provider"), "CO_BILLS_WITH": ("Provider", "Provider"), "FLAGGED_BY": ("Provider", "Exclusion"), "OWNED_BY": ("Provider", "Owner"), "SHARES_FACILITY": ("Provider", "Facility"), "SHARES_BANK_ACCOUNT": ("Provider", "BankAccount"), "SIMILAR_BILLING_PATTERN": ("Provider", "Provider")}
NODES = {"id": "string", "node_type": "string", "taxonomy": "string", "specialty": "string", "state": "string", "enrollment_date": "date", "date_of_service": "timestamp_ntz", "billed_amount": "double", "paid_amount": "double", "source": "string", "exclusion_date": "timestamp_ntz", "role": "string"}
EDGES = {"src": "string", "dst": "string", "edge_type": "string", "date": "timestamp_ntz", "amount": "double", "beneficiary": "string", "date_diff_days": "int", "ownership_percentage": "double", "similarity": "double"}


def _as(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def _edges(df: DataFrame, kind: str, **columns) -> DataFrame:
    return _as(df.select(*[c.alias(k) if not isinstance(c, str) else F.col(c).alias(k) for k, c in columns.items()]).withColumn("edge_type", F.lit(kind)), EDGES)


def _nodes(df: DataFrame, kind: str, **columns) -> DataFrame:
    return _as(df.select(*[c.alias(k) if not isinstance(c, str) else F.col(c).alias(k) for k, c in columns.items()]).withColumn("node_type", F.lit(kind)), NODES)


def claim_node(c: str = "claim_id"):
    return F.concat(F.lit("CLAIM_"), F.col(c))


def exclusion_node():
    return F.concat(F.lit("EXCL_"), F.col("entity_npi"), F.lit("_"), F.date_format("exclusion_date", "yyyyMMdd"))


def bills_for(claims: DataFrame) -> DataFrame:
    return _edges(claims, "BILLS_FOR", src="provider_npi", dst=claim_node(), date="date_of_service", amount="billed_amount")


def treats(claims: DataFrame, patient: str = "beneficiary_id") -> DataFrame:
    rows = claims.where(F.col(patient).isNotNull() & (F.col(patient) != ""))
    return _edges(rows, "TREATS", src="provider_npi", dst=patient, date="date_of_service")


def refers_to(claims: DataFrame) -> DataFrame:
    """One edge for each row and referral column that names another provider."""
    parts = []
    for c in ("referring_provider_npi", "referring_npi"):
        if c in claims.columns:
            rows = claims.where(F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != F.col("provider_npi")))
            parts.append(_edges(rows, "REFERS_TO", src=c, dst="provider_npi", date="date_of_service"))
    return reduce(DataFrame.unionByName, parts) if parts else _as(claims.limit(0), EDGES)


def co_bills_with(claims: DataFrame, window_days: int = 30, patient: str = "beneficiary_id") -> DataFrame:
    """Providers who treat one beneficiary within ``window_days``, inclusive.

    For each beneficiary, pair of providers (src below dst) and claim of src: one edge, to the first claim of dst in the window.
    Claims of equal beneficiary, provider and time are combined, and each beneficiary's are swept once in order of time
    (``interval_sweep``), busy beneficiaries in ranges of time. Null beneficiaries, providers and dates join nothing.
    """
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', date_of_service)")
    events = claims.select(F.col(patient).cast("string").alias("g"), F.col("provider_npi").cast("string").alias("p"), at.alias("t"))
    met = first_in_window(events, window_days)
    date = F.expr("timestampadd(MICROSECOND, t, timestamp_ntz'1970-01-01 00:00:00')")
    gap = F.floor(F.abs(F.col("met") - F.col("t")) / DAY).cast("int")
    return _edges(met.withColumns({"date": date, "gap": gap}), "CO_BILLS_WITH", src="src", dst="dst", date="date", beneficiary="g", date_diff_days="gap")


def flagged_by(exclusions: DataFrame) -> DataFrame:
    return _edges(exclusions, "FLAGGED_BY", src="entity_npi", dst=exclusion_node(), date="exclusion_date")


def owned_by(ownership: DataFrame, owner: str = "owner_id") -> DataFrame:
    return _edges(ownership.where(F.col(owner).isNotNull()), "OWNED_BY", src="provider_npi", dst=owner, ownership_percentage="ownership_percentage")


def _hub_edges(rows: DataFrame, kind: str, prefix: str) -> DataFrame:
    """provider -> hub for hubs of more than one provider. ``rows``: p, hub."""
    pairs = rows.where("p is not null and hub is not null").distinct()
    shared = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub")
    return _edges(pairs.join(shared, "hub"), kind, src="p", dst=F.concat(F.lit(prefix), F.col("hub")))


def shares_facility(claims: DataFrame) -> DataFrame:
    """By facility_id, or by service_location where that column is all there is; none without either."""
    if not (at := next((c for c in ("facility_id", "service_location") if c in claims.columns), None)):
        return _as(claims.limit(0), EDGES)
    return _hub_edges(claims.select(F.col("provider_npi").alias("p"), F.col(at).alias("hub")), "SHARES_FACILITY", "FAC_")


def shares_bank_account(accounts: DataFrame) -> DataFrame:
    return _hub_edges(accounts.select(F.col("provider_npi").alias("p"), F.col("account_hash").alias("hub")), "SHARES_BANK_ACCOUNT", "BANK_")


def _code_counts(claims: DataFrame, code: str) -> DataFrame:
    return claims.groupBy(F.col("provider_npi").cast("string").alias("p"), F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def similar_billing_ends(claims: DataFrame, threshold: float = 0.8, code: str = "procedure_code") -> DataFrame:
    """(id, type, n): how many edges of :func:`similar_billing` end at each provider, without a row for each of them."""
    return similar_counts(_code_counts(claims, code), threshold).select(F.col("p").alias("id"), F.lit("SIMILAR_BILLING_PATTERN").alias("type"), "n")


def similar_billing(claims: DataFrame, threshold: float = 0.8, code: str = "procedure_code") -> DataFrame:
    """Pairs of providers whose code counts have a cosine of ``threshold`` or more (src below dst).

    Codes are counted for each provider; ``similarity`` joins the counts."""
    return _edges(similar_pairs(_code_counts(claims, code), threshold), "SIMILAR_BILLING_PATTERN", src="src", dst="dst", similarity="similarity")


def build_graph(providers: DataFrame, claims: DataFrame | None = None, exclusions: DataFrame | None = None, ownership: DataFrame | None = None, bank_accounts: DataFrame | None = None, window_days: int = 30, similarity_threshold: float = 0.8, patient: str = "beneficiary_id", owner: str = "owner_id", similarity_code: str = "procedure_code", edge_types: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Nodes are one for each id: of several types the first in the order below. ``edge_types`` asks for edges of these
    types only (all nodes stay); others, such as similar pairs, whose number grows with the square of the providers, are not made."""
    asked = lambda t: edge_types is None or t in edge_types
    present = lambda df, c: F.col(c) if c in df.columns else F.lit(None)
    nodes = [_nodes(providers, "Provider", id="npi", taxonomy="taxonomy_code", specialty="specialty", state=present(providers, "license_state"), enrollment_date=present(providers, "enrollment_date"))]
    edges = []
    if claims is not None:
        nodes.append(_nodes(claims, "Claim", id=claim_node(), date_of_service="date_of_service", billed_amount="billed_amount", paid_amount="paid_amount"))
        edges += [bills_for(claims), treats(claims, patient), refers_to(claims)]
        nodes.append(_nodes(edges[1].select("dst").distinct(), "Beneficiary", id="dst"))
        if asked("CO_BILLS_WITH"):
            edges.append(co_bills_with(claims, window_days, patient))
    if exclusions is not None:
        nodes.append(_nodes(exclusions, "Exclusion", id=exclusion_node(), source="exclusion_source", exclusion_date="exclusion_date"))
        edges.append(flagged_by(exclusions))
    if ownership is not None:
        roles = ownership.where(F.col(owner).isNotNull()).groupBy(owner).agg(F.min_by("owner_role", "provider_npi").alias("role"))
        nodes.append(_nodes(roles, "Owner", id=owner, role="role"))
        edges.append(owned_by(ownership, owner))
    if claims is not None:
        edges.append(shares_facility(claims))
        nodes.append(_nodes(edges[-1].select("dst").distinct(), "Facility", id="dst"))
    if bank_accounts is not None:
        edges.append(shares_bank_account(bank_accounts))
        nodes.append(_nodes(edges[-1].select("dst").distinct(), "BankAccount", id="dst"))
    if claims is not None and similarity_code in claims.columns and asked("SIMILAR_BILLING_PATTERN"):
        edges.append(similar_billing(claims, similarity_threshold, similarity_code))
    every = reduce(DataFrame.unionByName, [n.withColumn("order_", F.lit(k)) for k, n in enumerate(nodes)])
    rest = [c for c in NODES if c != "id"]
    key = F.struct("order_", F.coalesce("date_of_service", "exclusion_date"), "billed_amount")
    best = every.where("id is not null").groupBy("id").agg(*[F.min_by(c, key).alias(c) for c in rest])  # unread ones are pruned
    every_edge = reduce(DataFrame.unionByName, edges).where("src is not null and dst is not null")
    return best, every_edge if edge_types is None else every_edge.where(F.col("edge_type").isin(*edge_types))


def path_edge_types(paths) -> set[str]:
    """The edge types that hops of ``paths`` (lists of node types) go over, where each id has the type that its edges give it."""
    plain = [["Provider" if k in PROVIDER_TYPES else "Beneficiary" if k == "Patient" else k for k in path] for path in paths]
    hops = {tuple(sorted(hop)) for path in plain for hop in zip(path, path[1:], strict=False)}
    return {t for t, ends in LINKS.items() if tuple(sorted(ends)) in hops}


def graph_statistics(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(kind, type, n): totals and counts by type of nodes and edges. Ends of edges that are no node have type Unknown. One pass
    over the edges counts their ends by id and type, which gives both the ends and, halved, the edges; ``ends(id, type, n)`` are those of further edges, counted already."""
    each = edges.select(F.coalesce("edge_type", F.lit("Unknown")).alias("type"), F.explode(F.array("src", "dst")).alias("id"))
    each = each.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    each = written(each if ends is None else each.unionByName(ends).groupBy("id", "type").agg(F.sum("n").alias("n")), "edge-ends")
    typed = nodes.select("id", "node_type").join(each.select("id").distinct(), "id", "full").select(F.coalesce("node_type", F.lit("Unknown")).alias("type"))
    n = typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    e = each.groupBy("type").agg((F.sum("n") / 2).cast("long").alias("n"))
    total = lambda df: df.agg(F.lit("total").alias("type"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parts = [x.select(F.lit(k).alias("kind"), "type", "n") for k, df in (("node", n), ("edge", e)) for x in (df, total(df))]
    return reduce(DataFrame.unionByName, parts)


def project(edges: DataFrame, nodes: DataFrame | None = None, weighted: bool = False, loops: bool = False) -> DataFrame:
    """The undirected graph of ``edges``, both ways: (src, dst, weight). weight: the number of parallel edges, or 1.
    ``nodes(id)`` keeps edges between those only."""
    if nodes is not None:
        ids = nodes.select("id").distinct()
        edges = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.count(F.lit(1)) if weighted else F.lit(1)).cast("double").alias("weight"))
    pairs = pairs if loops else pairs.where("a <> b")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(pairs.where("a <> b").select("b", "a", "weight"))


def provider_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*PROVIDER_TYPES))


def _merged(block: int):
    """Pairs (a, b), a below b, once each, from rows (a, j, bs) in order of a and j; bs are numbers of block j."""

    def run(batches):
        key, mark = None, np.zeros(block, dtype=bool)

        def pairs():
            bs = np.flatnonzero(mark) + key[1] * block
            bs = bs[bs > key[0]]
            mark[:] = False
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(bs), key[0]), pa.int64()), pa.array(bs, pa.int64())], names=["a", "b"])

        for batch in batches:
            a, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(batch.column(2).value_lengths().to_numpy())
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(j) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if last == first:
                    continue
                if key != (now := (int(a[first]), int(j[first]))):
                    if key is not None:
                        yield pairs()
                    key = now
                mark[flat[ends[first - 1] if first else 0 : ends[last - 1]] - key[1] * block] = True
        if key is not None:
            yield pairs()

    return run


def _share_a_middle(hops: DataFrame, block: int) -> DataFrame:
    """(src, dst), src below dst: nodes that hop to a common one, from distinct hops (src, dst). A hop meets its middle's list of starts
    in each block, and a start's lists are merged there, so a pair is no row for each middle that it shares."""
    from riskloom.operators.ordered import numbered

    shared = hops.groupBy("dst").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").select("dst")
    hops = written(hops.join(shared, "dst", "left_semi"), "hops")
    ids = written(numbered(hops.select("src").distinct(), "src", "n"), "ids")
    at = written(hops.join(ids, "src").select("dst", "n"), "hops")
    j = F.expr(f"n div {block}")
    lists = at.groupBy("dst", j.alias("j")).agg(F.collect_list("n").alias("bs"))
    met = at.join(lists, "dst").where(F.col("j") >= j).select(F.col("n").alias("a"), "j", "bs")
    pairs = met.repartition("a").sortWithinPartitions("a", "j").mapInArrow(_merged(block), "a long, b long")
    return pairs.join(ids.select(F.col("n").alias("a"), "src"), "a").join(ids.select(F.col("n").alias("b"), F.col("src").alias("dst")), "b").select("src", "dst")


def metapath_graph(nodes: DataFrame, edges: DataFrame, path: list[str], block: int = MERGED) -> DataFrame:
    """(src, dst, weight), src below dst: pairs of start nodes that ``path``, a list of node types, connects over undirected
    hops; 2 where both ends reach each other, as by a path that reads the same both ways. Patient means Beneficiary."""
    kinds = ["Beneficiary" if k == "Patient" else k for k in path]
    typed = nodes.select(F.col("id"), F.when(F.col("node_type").isin(*PROVIDER_TYPES), "Provider").otherwise(F.col("node_type")).alias("kind"))
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    if len(kinds) == 3 and kinds[0] == kinds[2]:
        ends = [typed.where(F.col("kind") == kind).select(F.col("id").alias(c)) for kind, c in zip(kinds, ("src", "dst"), strict=False)]
        hops = both.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst").distinct()
        return _share_a_middle(hops, block).withColumn("weight", F.lit(2.0))
    at = typed.where(F.col("kind") == kinds[0]).select(F.col("id").alias("start"), F.col("id").alias("now"))
    for kind in kinds[1:]:
        there = typed.where(F.col("kind") == kind).select(F.col("id").alias("there"))
        hop = both.join(there, F.col("dst") == F.col("there"), "left_semi").distinct()
        at = at.join(hop, F.col("now") == F.col("src")).select("start", F.col("dst").alias("now")).distinct()
    pairs = at.where(F.col("start") != F.col("now"))
    return pairs.groupBy(F.least("start", "now").alias("src"), F.greatest("start", "now").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
