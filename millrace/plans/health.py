"""Queries on the health of capabilities, made from customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import health
from millrace.plans.base import query
from millrace.sources.tables import table

# Texts that Spark and DuckDB read alike. A customer is an instance; events are its receipts.
_INSTANCES = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'skill' WHEN 1 THEN 'native_tool' WHEN 2 THEN 'cli' WHEN 3 THEN 'plugin' WHEN 4 THEN 'api' WHEN 5 THEN 'mcp_tool' ELSE 'mcp_server' END AS kind,
CASE WHEN c_custkey % 4 = 0 THEN 'plugin' ELSE 'user' END AS origin, CASE WHEN c_custkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS discovery, c_custkey % 11 = 0 AS shadowed,
CASE WHEN c_custkey % 17 = 0 THEN 'absent' WHEN c_custkey % 13 = 0 THEN 'unknown' ELSE 'installed' END AS presence, CASE WHEN c_custkey % 19 = 0 THEN 'invalid' WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE 'valid' END AS configuration,
CASE c_nationkey % 3 WHEN 0 THEN 'callable' WHEN 1 THEN 'deferred' ELSE 'not_exposed' END AS exposure, CASE WHEN c_custkey % 23 = 0 THEN 'not_applicable' ELSE 'untested' END AS connectivity,
CASE WHEN c_custkey % 29 = 0 THEN 'required' ELSE 'unknown' END AS authentication, 'unknown' AS authorization, 'unknown' AS compatibility, CASE WHEN c_custkey % 10 = 0 THEN 'blocked' WHEN c_custkey % 31 = 0 THEN 'retired' ELSE 'enabled' END AS policy FROM customer"""
_RECEIPTS = """SELECT user_id AS id, event_id AS receipt, event_type AS operation, CASE event_id % 7 WHEN 0 THEN 'static_validation' WHEN 1 THEN 'host_exposure' WHEN 2 THEN 'transport_negotiation' WHEN 3 THEN 'tool_enumeration' WHEN 4 THEN 'approved_read_probe' WHEN 5 THEN 'observed_task_call' ELSE 'user_report' END AS type,
CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 3 <> 0 THEN 'OK' WHEN event_id % 2 = 0 THEN 'TRANSPORT_TIMEOUT' WHEN event_id % 5 = 0 THEN 'PERMISSION_DENIED' WHEN event_id % 11 = 0 THEN 'AUTHENTICATION_REQUIRED' WHEN event_id % 13 = 0 THEN 'SCHEMA_CHANGED' ELSE 'SERVICE_UNAVAILABLE' END AS reason,
CASE WHEN user_id % 4 = 1 OR event_id % 3 = 1 THEN 'historical' WHEN user_id % 4 = 2 AND event_id % 5 > 0 THEN 'expired' ELSE 'current' END AS state, event_id % 1000 AS observed FROM events"""


@query(f"""WITH i AS ({_INSTANCES}), r AS ({_RECEIPTS}), v AS (SELECT * FROM r WHERE state = 'current' AND type <> 'static_validation'),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, operation ORDER BY observed DESC, receipt DESC) = 1),
a AS (SELECT id, bool_or(state = 'current' AND type <> 'static_validation') AS live, bool_or(state = 'current' AND type = 'static_validation') AS static, bool_or(state = 'historical') AS historical, bool_or(state = 'expired') AS expired FROM r GROUP BY id),
b AS (SELECT id, bool_or(outcome = 'success' AND type IN ('transport_negotiation', 'tool_enumeration', 'approved_read_probe', 'observed_task_call')) AS reached, bool_or(outcome = 'success' AND type IN ('approved_read_probe', 'observed_task_call')) AS used,
bool_or(outcome = 'success' AND type IN ('transport_negotiation', 'tool_enumeration')) AS met, bool_or(outcome = 'failure' AND reason IN ('TRANSPORT_TIMEOUT', 'SERVICE_UNAVAILABLE')) AS broken, bool_or(type = 'host_exposure' AND reason = 'SERVICE_UNAVAILABLE') AS gone FROM v GROUP BY id),
o AS (SELECT id, bool_or(outcome = 'success') AS worked, bool_or(outcome = 'failure') AS partial, bool_or(reason = 'AUTHENTICATION_REQUIRED') AS asks, bool_or(reason = 'PERMISSION_DENIED') AS denied, bool_or(outcome = 'success' AND type IN ('approved_read_probe', 'observed_task_call')) AS allowed,
bool_or(reason = 'SCHEMA_CHANGED') AS changed, list(DISTINCT reason) FILTER (outcome = 'failure') AS failures FROM l GROUP BY id),
j AS (SELECT i.*, kind IN ('plugin', 'api', 'mcp_tool', 'mcp_server') AND connectivity <> 'not_applicable' AS joined, live, static, historical, expired, reached, used, met, broken, gone, coalesce(worked, false) AS worked, coalesce(partial, false) AS partial, asks, denied, allowed, changed, failures
FROM i LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN o USING (id)),
d AS (SELECT id, kind, origin, shadowed, worked, partial, coalesce(failures, []) AS failures, CASE WHEN joined AND gone AND discovery = 'complete' THEN 'absent' ELSE presence END AS presence, configuration, exposure,
CASE WHEN NOT joined THEN connectivity WHEN reached THEN 'verified' WHEN broken THEN 'failed' ELSE 'untested' END AS connectivity, CASE WHEN NOT joined THEN authentication WHEN asks THEN 'required' WHEN used THEN 'authenticated' ELSE authentication END AS authentication,
CASE WHEN NOT joined THEN "authorization" WHEN allowed THEN 'allowed' WHEN denied THEN 'denied' ELSE 'unknown' END AS "authorization", CASE WHEN NOT joined THEN compatibility WHEN changed THEN 'incompatible' WHEN met THEN 'compatible' ELSE compatibility END AS compatibility, policy,
CASE WHEN live OR (static AND NOT historical AND NOT expired) THEN 'fresh' WHEN expired THEN 'expired' WHEN historical THEN 'stale' ELSE 'unknown' END AS freshness FROM j),
e AS (SELECT *, CASE WHEN configuration = 'invalid' OR compatibility = 'incompatible' THEN 'MISCONFIGURED' WHEN authentication = 'required' THEN CASE WHEN worked THEN 'DEGRADED' ELSE 'AUTH_REQUIRED' END
WHEN presence = 'absent' OR (connectivity = 'failed' AND NOT worked) THEN 'UNAVAILABLE'
WHEN kind = 'skill' THEN CASE WHEN presence = 'installed' AND configuration = 'valid' AND freshness = 'fresh' THEN 'HEALTHY' WHEN presence = 'installed' AND configuration = 'valid' THEN 'UNTESTED' WHEN exposure = 'callable' AND configuration = 'unknown' THEN 'HEALTHY' ELSE 'UNTESTED' END
WHEN kind = 'native_tool' THEN CASE WHEN exposure = 'callable' THEN 'HEALTHY' ELSE 'UNTESTED' END WHEN kind = 'cli' THEN CASE presence WHEN 'installed' THEN 'UNTESTED' WHEN 'absent' THEN 'UNAVAILABLE' ELSE 'MISCONFIGURED' END
WHEN partial AND worked THEN 'DEGRADED' WHEN worked THEN 'HEALTHY' WHEN exposure IN ('callable', 'deferred') THEN 'UNTESTED' WHEN partial THEN 'DEGRADED' ELSE 'UNTESTED' END AS display,
configuration <> 'invalid' AND compatibility <> 'incompatible' AS sound FROM d),
f AS (SELECT *, sound AND authentication = 'required' AS asked, sound AND authentication <> 'required' AND (presence = 'absent' OR (connectivity = 'failed' AND NOT worked)) AS out FROM e),
g AS (SELECT *, sound AND NOT asked AND NOT out AND kind NOT IN ('skill', 'native_tool', 'cli') AS told FROM f)
SELECT id, kind, presence, configuration, exposure, connectivity, authentication, "authorization", compatibility, policy, freshness, display,
array_to_string(list_sort(list_distinct(list_filter(list_concat([CASE WHEN freshness = 'stale' THEN 'STALE_SESSION_EVIDENCE' END, CASE WHEN asked THEN 'AUTHENTICATION_REQUIRED' END, CASE WHEN told AND NOT worked AND exposure = 'callable' THEN 'CALLABLE_NOT_CONNECTION_TESTED' END, CASE WHEN policy <> 'enabled' THEN 'POLICY_DISABLED' END],
CASE WHEN out OR (told AND partial AND (worked OR exposure NOT IN ('callable', 'deferred'))) THEN failures ELSE [] END), lambda x: x IS NOT NULL AND x <> 'OK'))), ',') AS reasons,
concat_ws(',', CASE WHEN policy <> 'enabled' THEN upper(policy) END, CASE WHEN freshness IN ('stale', 'expired') THEN upper(freshness) END, CASE WHEN shadowed THEN CASE WHEN kind = 'plugin' OR origin = 'plugin' THEN 'OLD COPY' ELSE 'SHADOWED' END END) AS badges,
policy = 'enabled' AND display NOT IN ('MISCONFIGURED', 'UNAVAILABLE') AND NOT shadowed AS eligible FROM g""")
def health_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine dimensions of each instance from its receipts, and what is shown of them."""
    instances = spark.sql(_INSTANCES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    receipts = spark.sql(_RECEIPTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    got = health.assessed(instances, receipts, "id")
    return got.withColumns({"reasons": F.array_join("reasons", ","), "badges": F.array_join("badges", ",")})
