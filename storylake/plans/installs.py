"""Queries of module installs: every customer is a project, its orders are the settings of its files."""

from __future__ import annotations

from pyspark.sql import functions as F

from storylake.operators import installs
from storylake.sources.tables import table

KEYS = ("user_name", "communication_language", "output_folder", "docs", "plan", "extra", "name")


def _inputs(spark, folder):
    """Definitions, answers, settings, the user's settings and older files."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("project"), F.lower("c_mktsegment").alias("segment"), "c_name")
    key, order = F.col("project"), F.col("o_orderkey")
    none = F.lit(None).cast("string")
    line = lambda name, value, variable=False, result=none, user=F.lit(False): F.struct(F.lit(name).alias("key"), value.alias("value"), F.lit(variable).alias("variable"), result.alias("result"), user.alias("user_setting"))
    lines = F.array(
        line("code", F.when(key % 10 == 1, "").otherwise(F.col("segment"))), line("name", F.col("c_name")), line("module_version", F.when(key % 3 == 0, key.cast("string"))), line("description", F.upper("segment")),
        line("docs", none, True, F.lit("{project-root}/{value}")), line("plan", none, True, none, F.lit(True)), line("extra", none, True, F.lit("x-{value}"), key % 4 == 0),
    )
    definitions = customers.where(key % 10 != 0).select("project", F.explode(lines).alias("l")).select("project", "l.*")
    text = F.when(order % 11 == 0, none).when(order % 5 == 0, F.concat(F.lit("{project-root}/"), order.cast("string"))).otherwise(F.concat("o_orderpriority", F.lit(" "), order.cast("string")))
    at = F.floor(order / 4) % len(KEYS)
    rows = table(spark, folder, "orders").withColumnRenamed("o_custkey", "project").join(customers, "project")
    rows = rows.select("project", "segment", "o_orderstatus", (order % 4).alias("kind"), (at < 3).alias("core"), F.element_at(F.array(*map(F.lit, KEYS)), (at + 1).cast("int")).alias("key"), text.alias("value"))
    place = lambda f, o, p: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", o).otherwise(p)
    own = F.when(key % 2 == 0, F.col("segment")).otherwise("other")
    existing = rows.where("kind = 0").select("project", place(F.lit(""), F.lit("core"), own).alias("scope"), "key", "value")
    answers = rows.where("kind = 1").select("project", F.when(F.col("core"), "core").otherwise("module").alias("part"), "key", "value")
    legacy = rows.where("kind = 2").select("project", place(F.lit("core"), F.col("segment"), F.lit("other")).alias("folder"), "key", "value")
    return definitions, answers, existing, rows.where("kind = 3").select("project", "key", "value"), legacy


def install_settings(spark, folder):
    """Shared and user settings of every project after its module is installed."""
    done = installs.installed(*_inputs(spark, folder))
    shared, user = done.shared.select("project", F.lit("shared").alias("file"), "scope", "key", "value"), done.user.select("project", F.lit("user").alias("file"), F.lit("").alias("scope"), "key", "value")
    return shared.unionByName(user)


def install_report(spark, folder):
    """One row a project: whether the install went well, and what it wrote and read."""
    return installs.installed(*_inputs(spark, folder)).report


QUERIES = {f.__name__: f for f in (install_settings, install_report)}

_LIST = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_SQL = f"""c AS (SELECT c_custkey AS project, lower(c_mktsegment) AS segment, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'no_source' WHEN c_custkey % 10 = 1 THEN 'no_code' ELSE 'success' END AS status FROM customer),
  o AS (SELECT project, segment, status, o_orderstatus AS s, o_orderkey % 4 AS kind, ({_LIST})[1 + (o_orderkey // 4) % {len(KEYS)}] AS key,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '{{project-root}}/' || o_orderkey ELSE o_orderpriority || ' ' || o_orderkey END AS value FROM orders JOIN c ON o_custkey = project),
  e AS (SELECT project, status, segment, CASE s WHEN 'F' THEN '' WHEN 'O' THEN 'core' ELSE CASE WHEN project % 2 = 0 THEN segment ELSE 'other' END END AS scope, key, max(value) AS value FROM o WHERE kind = 0 GROUP BY ALL),
  g AS (SELECT project, key, max(value) AS value FROM o WHERE kind = 1 AND status = 'success' GROUP BY ALL),
  l AS (SELECT project, CASE s WHEN 'F' THEN 'core' ELSE 'own' END AS folder, key, max(value) AS value FROM o WHERE kind = 2 AND s <> 'P' AND status = 'success' GROUP BY ALL),
  usable AS (SELECT * FROM l WHERE key IN ('user_name', 'communication_language', 'output_folder') OR (folder = 'own' AND key IN ('docs', 'plan', 'extra'))),
  old AS (SELECT project, key, value FROM usable QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY folder) = 1),
  a AS (SELECT * FROM g UNION ALL SELECT * FROM old WHERE (project, key) NOT IN (SELECT project, key FROM g)),
  -- What fails keeps its settings; else sections other than the core's and the module's stay, and the root is laid anew.
  root AS (SELECT project, key, value, 1 AS ord FROM a WHERE key = 'output_folder' UNION ALL SELECT project, key, value, CASE scope WHEN 'core' THEN 2 ELSE 3 END FROM e WHERE status = 'success' AND scope IN ('', 'core') AND key NOT IN ('user_name', 'communication_language')),
  section AS (SELECT project, key, CASE WHEN value LIKE '%{{project-root}}%' THEN value WHEN key = 'docs' THEN '{{project-root}}/' || value WHEN key = 'extra' THEN 'x-' || value ELSE value END AS value FROM a WHERE key IN ('docs', 'plan', 'extra', 'name')
    UNION ALL SELECT project, 'name', c_name FROM c WHERE status = 'success' AND (project, 'name') NOT IN (SELECT project, key FROM a) UNION ALL SELECT project, 'description', upper(segment) FROM c WHERE status = 'success'
    UNION ALL SELECT project, 'version', CASE WHEN project % 3 = 0 THEN CAST(project AS VARCHAR) END FROM c WHERE status = 'success'),
  nu AS (SELECT * FROM a WHERE key IN ('user_name', 'communication_language', 'plan') OR (key = 'extra' AND project % 4 = 0))"""

ORACLES = {
    "install_settings": f"""WITH {_SQL}, u AS (SELECT project, key, max(value) AS value FROM o WHERE kind = 3 GROUP BY ALL)
        SELECT project, 'shared' AS file, scope, key, value FROM e WHERE status <> 'success' OR scope = 'other'
        UNION ALL SELECT project, 'shared', '', key, value FROM root QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY ord) = 1
        UNION ALL SELECT project, 'shared', segment, key, value FROM section JOIN c USING (project)
        UNION ALL SELECT project, 'user', '', key, value FROM nu UNION ALL SELECT project, 'user', '', key, value FROM u WHERE (project, key) NOT IN (SELECT project, key FROM nu)""",
    "install_report": f"""WITH {_SQL} SELECT project, status, EXISTS (SELECT 1 FROM a WHERE a.project = c.project AND key IN ('user_name', 'communication_language', 'output_folder')) AS core_updated,
        (SELECT count(*) FROM section s WHERE s.project = c.project) AS module_keys, (SELECT count(*) FROM nu WHERE nu.project = c.project) AS user_keys, (SELECT count(DISTINCT folder) FROM l WHERE l.project = c.project) AS legacy_found
        FROM c WHERE status <> 'no_source' OR project IN (SELECT project FROM o WHERE kind < 3)""",
}
