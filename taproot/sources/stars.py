"""Code-graph facts read off the star schema, so that every operator runs on the given tables.

Parts are files, consecutive lines of an order whose parts share a brand are
imports, return flags are target profiles, part types are workspaces, suppliers
are packages.  Each fact table is one SELECT that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FILE = "concat('src/p', cast({0} as string), '.ts')"
_PAIRS = """{lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
 join {part} pa on pa.p_partkey = a.l_partkey join {part} pb on pb.p_partkey = b.l_partkey and pa.p_brand = pb.p_brand"""

FACTS = {
    "files": f"select {_FILE.format('p_partkey')} as path, p_type as workspace, p_brand as brand, p_size = 50 and p_type = 'PROMO' as fatal from {{part}}",
    "profiles": "select distinct l_returnflag as profile from {lineitem}",
    "entries": f"select distinct l_returnflag as profile, {_FILE.format('p_partkey')} as path from {{lineitem}} join {{part}} on l_partkey = p_partkey where p_size = 1",
    "edges": f"select distinct a.l_returnflag as profile, {_FILE.format('a.l_partkey')} as src, {_FILE.format('b.l_partkey')} as dst from {_PAIRS}",
    "blockers": f"select distinct l_returnflag as profile, {_FILE.format('p_partkey')} as path from {{lineitem}} join {{part}} on l_partkey = p_partkey where l_returnflag = 'N' and l_quantity = 1 and p_type = 'SMALL'",
    # a symbol is a line number of a part; its name, kind and whether it is exported follow from its lines
    "symbols": f"select {_FILE.format('l_partkey')} as path, l_linenumber as symbol, concat('s', cast(l_partkey as string), '_', cast(l_linenumber as string)) as name, case when min(l_tax) = 0 then 'import' else 'function' end as kind, min(l_shipdate) < max(l_shipdate) as exported from {{lineitem}} group by l_partkey, l_linenumber",
    "links": f"select distinct {_FILE.format('a.l_partkey')} as src_path, a.l_linenumber as src_symbol, {_FILE.format('b.l_partkey')} as dst_path, b.l_linenumber as dst_symbol, case when b.l_linestatus = 'O' then 'runtime' else 'type' end as usage from {_PAIRS}",
    "symbol_roots": f"select distinct {_FILE.format('l_partkey')} as path, l_linenumber as symbol, case when l_linestatus = 'O' then 'runtime' else 'type' end as usage from {{lineitem}} join {{part}} on l_partkey = p_partkey where p_size = 1 and l_discount = 0.1",
    "declarations": "select distinct p_type as workspace, s_name as package, case when l_returnflag = 'A' then 'runtime' when l_returnflag = 'N' then 'peer' else 'optional' end as category from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey where l_discount = 0 and l_tax = 0",
    "evidence": "select distinct p_type as workspace, s_name as package, case when l_linestatus = 'O' then 'import' else 'script' end as kind from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey where l_quantity = 50 and l_tax = 0.08",
    "dependency_blockers": "select distinct p_type as workspace, case when p_type = 'SMALL' then cast(null as string) else s_name end as package from {lineitem} join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey where l_quantity = 1 and l_discount = 0.1 and l_tax = 0.08",
    "members": """select concat('C', cast(l_partkey as string)) as class, concat('m', cast(l_linenumber as string)) as name,
 case when l_suppkey % 4 = 0 then 'javascript_private' when l_suppkey % 4 = 1 then 'typescript_private' when l_suppkey % 4 = 2 then 'protected' else 'public' end as visibility,
 l_linestatus = 'O' as is_static, l_quantity > 45 as directly_referenced, false as framework_root, l_discount = 0.09 as implements_external_contract, l_discount = 0.08 as overrides_live_base_member, false as has_live_override,
 l_discount = 0.07 as decorated, l_discount = 0.06 as emitted_decorator_metadata, l_returnflag = 'A' as class_exported, l_tax = 0.01 as class_escaped, l_returnflag = 'A' and l_tax = 0.02 as open_world,
 l_tax = 0.03 as unknown_bracket_access, l_tax = 0.04 as reflected_or_enumerated, l_tax = 0.05 as serialized, l_tax = 0.06 as object_spread, l_tax = 0.07 as proxied, false as passed_to_unknown_code,
 l_quantity > 20 as receiver_targets_complete, l_discount > 0.03 as participates_in_inheritance, l_quantity > 30 as relationships_complete,
 case when l_quantity < 8 then 'resolved' when l_quantity < 14 then 'unavailable' else 'not_requested' end as deep, l_returnflag = 'R' as receiver_may_reference, l_discount = 0.05 as live_override_contract, l_orderkey as position
 from {lineitem}""",
    "findings": f"select l_returnflag as profile, 'ORP1001' as issue_id, case when l_linestatus = 'O' then 'unusedFiles' else 'unusedExport' end as issue_type, p_type as workspace, {_FILE.format('p_partkey')} as path, case when l_tax < 0.02 then 'low' when l_tax < 0.05 then 'medium' else 'high' end as confidence from {{lineitem}} join {{part}} on l_partkey = p_partkey where l_discount = 0.1 and l_quantity > 40",
}


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fact table of this name over the Parquet tables in ``sf_dir``."""
    sql = FACTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier") if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def in_sql(*names: str) -> str:
    """The same tables as the head of a WITH clause."""
    return ", ".join(f"{n} as ({FACTS[n].replace('{lineitem}', 'lineitem').replace('{part}', 'part').replace('{supplier}', 'supplier')})" for n in names)
