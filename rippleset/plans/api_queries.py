"""Queries of endpoint extraction and contract changes. Their SQL never reads the texts: it says what the tables they were made of must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.operators import contracts, diffs, endpoints, schema_change as sc
from rippleset.plans import views as v

#: One file a part: a controller of one of four frameworks, or plain lines.
API_FILES = """
SELECT 'repo' || (p_partkey % 5) AS repo, 'src/Part' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.java' WHEN 1 THEN '.py' WHEN 2 THEN '.py' WHEN 3 THEN '.js' ELSE '.md' END AS path,
  CASE p_partkey % 5 WHEN 0 THEN '@RestController' || chr(10) || '@RequestMapping("/api/parts/")' || chr(10) || 'public class C {{' || chr(10)
    || '  @GetMapping(value = "/' || p_partkey || '/items/{{id}}")' || chr(10) || '  @Deprecated // since (2.0' || chr(10) || '  public ResponseEntity<Map<String, List<Part>>> find(' || chr(10) || '      @PathVariable Long id,' || chr(10)
    || '      @RequestParam(value = "size", required = false, defaultValue = "f(' || p_size || '), x") Integer size,' || chr(10) || '      @RequestParam final Map<String, String> filter, HttpServletRequest request) {{' || chr(10)
    || '    return ok();' || chr(10) || '  }}' || chr(10) || '  @PostMapping' || chr(10) || '  void create(@RequestBody Part part) {{ }}' || chr(10) || '}}'
  WHEN 1 THEN 'from flask import Flask' || chr(10) || '@app.route("/api/parts/' || p_partkey || '", methods=["GET", "DELETE"])' || chr(10) || 'def part(brand, size=' || p_size || ',' || chr(10) || '         names=f(1, 2)):' || chr(10) || '    pass'
  WHEN 2 THEN 'from fastapi import APIRouter' || chr(10) || chr(10) || '@router.put("/api/parts/' || p_partkey || '")' || chr(10) || 'async def put(part: Part, size: int = ' || p_size || ', db=Depends(get)) -> List[Part]:' || chr(10) || '    pass'
  WHEN 3 THEN 'const express = require("express")' || chr(10) || 'router.patch("/api/parts/' || p_partkey || '/:brand/:size", (req, res) => {{ }})' ELSE 'GET /api/parts/' || p_partkey || ' gives a part.' END AS content
FROM {part}
"""

#: One diff a part: a new parameter, a moved path, a comment, another response, one endpoint for another, a new file.
API_DIFFS = """
SELECT p_partkey AS change_id, 'src/Part' || p_partkey || 'Controller.java' AS path, 'diff --git a/src/Part b/src/Part' || chr(10) || '--- a/src/Part' || chr(10) || '+++ b/src/Part' || chr(10) || '@@ -1,3 +1,4 @@' || chr(10) || CASE p_partkey % 6
  WHEN 0 THEN '     @GetMapping("/api/part/' || p_partkey || '")' || chr(10) || '-    public Part find(@RequestParam int size) {{' || chr(10) || '+    public Part find(@RequestParam int size,' || chr(10) || '+        @RequestParam(required = ' || CASE WHEN p_size % 2 = 0 THEN 'false' ELSE 'true' END || ') String brand) {{'
  WHEN 1 THEN '-    @PutMapping("/api/part/' || p_partkey || '/price")' || chr(10) || '+    @PutMapping("/api/part/' || p_partkey || '/cost")' || chr(10) || '     public void set(@RequestBody Price price) {{'
  WHEN 2 THEN '     @PostMapping("/api/part/' || p_partkey || '")' || chr(10) || '+    // a comment (only' || chr(10) || '     public void add(@RequestBody Part part) {{'
  WHEN 3 THEN '     @GetMapping("/api/part/' || p_partkey || '")' || chr(10) || '-    public ResponseEntity<?> all() {{' || chr(10) || '+    public ResponseEntity<Part> all() {{'
  WHEN 4 THEN '-    @DeleteMapping("/api/part/' || p_partkey || '")' || chr(10) || '-    public void drop() {{ }}' || chr(10) || '+    @PostMapping("/api/part/' || p_partkey || '/archive")' || chr(10) || '+    public ResponseEntity<Part> keep(@RequestParam String why) {{ }}'
  ELSE '+    @PostMapping("/api/part/' || p_partkey || '/archive")' || chr(10) || '+    public ResponseEntity<Part> keep(@RequestParam String why, @RequestParam int size) {{ }}' END AS diff
FROM {part}
"""

#: Paths of three segments under a brand; many share all but one.
PATHS_BEFORE = "SELECT p_brand AS change_id, CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || (p_partkey % 23) || '/' || CASE p_partkey % 4 WHEN 0 THEN '{{id}}' WHEN 1 THEN 'Price' ELSE 'x' || (p_partkey % 11) END AS path, min(p_partkey) AS first_line FROM {part} WHERE p_partkey % 3 = 0 GROUP BY 1, 2, 3"
PATHS_AFTER = "SELECT p_brand AS change_id, CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || (p_partkey % 29) || '/' || CASE p_partkey % 4 WHEN 0 THEN '{{key}}' WHEN 1 THEN 'price' ELSE 'x' || (p_partkey % 7) END AS path, min(p_partkey) AS first_line FROM {part} WHERE p_partkey % 3 = 1 GROUP BY 1, 2, 3"


def _diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_changes(v.view(spark, sf_dir, API_DIFFS, "part"), sc.call_sites(v.view(spark, sf_dir, v.CODE_FILES, "lineitem")))


def _api_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.endpoints(v.view(spark, sf_dir, API_FILES, "part")).withColumn("params", endpoints.shown(F.col("params")))


def _in_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = v.view(spark, sf_dir, API_DIFFS, "part")
    return diffs.endpoints_in_diff(given, diffs.contracts_of_side(diffs.diff_sides(given), "after"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "api_endpoints": _api_endpoints,
    "moved_endpoints": lambda s, d: contracts.moved_endpoints(v.view(s, d, PATHS_BEFORE), v.view(s, d, PATHS_AFTER)),
    "diff_lines": lambda s, d: diffs.explode_diff(v.view(s, d, API_DIFFS, "part")).groupBy("change_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")),
    "endpoints_in_diff": _in_diff,
    "diff_changes": lambda s, d: _diff_changes(s, d).withColumn("node_risk", contracts.endpoint_node_risk(F.col("change_type"))),
    "api_change_risk": lambda s, d: contracts.api_change_risk(_diff_changes(s, d), sc.call_sites(v.view(s, d, v.CODE_FILES, "lineitem"))),
    "api_routing": lambda s, d: v.view(s, d, v.CODE_FILES, "lineitem").groupBy(diffs.is_api_change(F.col("path"), F.col("content")).alias("is_api")).agg(F.count(F.lit(1)).alias("n")),
}

_PART = "p_partkey"
_ENDPOINTS = """
SELECT 'repo' || (p_partkey % 5) AS repo, 'src/Part' || p_partkey || suffix AS path, line, framework, method, replace(api_path, '#', p_partkey::VARCHAR) AS api_path, return_type, params
FROM part JOIN (VALUES
  (0, '.java', 4, 'spring_boot', 'GET', '/api/parts/#/items/{id}', 'ResponseEntity<Map<String, List<Part>>>', 'id:Long:true:path;size:Integer:false:query;filter:Map<String, String>:true:query'),
  (0, '.java', 12, 'spring_boot', 'POST', '/api/parts/', 'void', 'part:Part:true:body'),
  (1, '.py', 2, 'flask', 'GET', '/api/parts/#', NULL, 'brand:any:true:query;size:any:false:query;names:any:false:query'),
  (1, '.py', 2, 'flask', 'DELETE', '/api/parts/#', NULL, 'brand:any:true:query;size:any:false:query;names:any:false:query'),
  (2, '.py', 3, 'fastapi', 'PUT', '/api/parts/#', 'List[Part]', 'part:Part:true:body;size:int:false:query'),
  (3, '.js', 2, 'express', 'PATCH', '/api/parts/#/:brand/:size', NULL, 'brand:string:true:path;size:string:true:path'),
  (4, '.md', 1, 'generic', 'GET', '/api/parts/#', NULL, '')) AS f(kind, suffix, line, framework, method, api_path, return_type, params) ON p_partkey % 5 = kind
"""
_CHANGES = """
SELECT p_partkey AS change_id, method, replace(endpoint, '#', p_partkey::VARCHAR) AS endpoint, change_type, severity, replace(reason, '#', p_partkey::VARCHAR) AS reason, replace(old_path, '#', p_partkey::VARCHAR) AS old_path, found_by
FROM part JOIN (VALUES
  (0, 0, 'GET', '/api/part/#', 'MODIFIED', 'MEDIUM', 'New optional parameter ''brand'' added', NULL, 'contracts'), (0, 1, 'GET', '/api/part/#', 'BREAKING', 'CRITICAL', 'New required parameter ''brand'' added', NULL, 'contracts'),
  (1, NULL, 'PUT', '/api/part/#/cost', 'BREAKING', 'CRITICAL', 'Endpoint path changed from ''/api/part/#/price'' to ''/api/part/#/cost''', '/api/part/#/price', 'contracts'),
  (3, NULL, 'GET', '/api/part/#', 'BREAKING', 'CRITICAL', 'Return type changed: ResponseEntity<?> → ResponseEntity<Part>', NULL, 'contracts'),
  (4, NULL, 'DELETE', '/api/part/#', 'BREAKING', 'CRITICAL', 'Endpoint removed', NULL, 'contracts'), (4, NULL, 'POST', '/api/part/#/archive', 'ADDED', 'LOW', 'New endpoint added', NULL, 'contracts'),
  (5, NULL, 'POST', '/api/part/#/archive', 'BREAKING', 'CRITICAL', 'Required parameter(s) added: why, size', NULL, 'diff')) AS f(kind, odd, method, endpoint, change_type, severity, reason, old_path, found_by)
  ON p_partkey % 6 = kind AND (odd IS NULL OR p_size % 2 = odd)
"""
_BEFORE, _AFTER = v.sql(PATHS_BEFORE), v.sql(PATHS_AFTER)

ORACLES: dict[str, str] = {
    "api_endpoints": _ENDPOINTS,
    "moved_endpoints": f"""
      WITH p AS (SELECT a.change_id, a.method, a.path, b.path AS old_path, b.first_line, list_zip(string_split(regexp_replace(lower(a.path), '\\{{[^}}]+\\}}', '{{}}', 'g'), '/'), string_split(regexp_replace(lower(b.path), '\\{{[^}}]+\\}}', '{{}}', 'g'), '/')) AS z
        FROM ({_AFTER}) a JOIN ({_BEFORE}) b ON a.change_id = b.change_id AND a.method = b.method)
      SELECT change_id, method, path, arg_min(old_path, (first_line, old_path)) AS old_path FROM p WHERE len(list_filter(z, lambda x: x[1] <> x[2])) = 1 GROUP BY 1, 2, 3""",
    "diff_lines": """
      SELECT p_partkey AS change_id, kind, n::BIGINT AS n, first::INT AS first FROM part JOIN (VALUES (0, 'context', 1, 5), (0, 'removed', 1, 6), (0, 'added', 2, 7), (1, 'removed', 1, 5), (1, 'added', 1, 6), (1, 'context', 1, 7),
        (2, 'context', 2, 5), (2, 'added', 1, 6), (3, 'context', 1, 5), (3, 'removed', 1, 6), (3, 'added', 1, 7), (4, 'removed', 2, 5), (4, 'added', 2, 7), (5, 'added', 2, 5)) AS f(form, kind, n, first) ON p_partkey % 6 = form""",
    "endpoints_in_diff": """
      SELECT p_partkey AS change_id, method, '/api/part/' || p_partkey || ending AS path FROM part JOIN (VALUES (0, 'GET', ''), (1, 'PUT', '/cost'), (2, 'POST', ''), (3, 'GET', ''), (4, 'POST', '/archive'), (5, 'POST', '/archive')) AS f(kind, method, ending) ON p_partkey % 6 = kind""",
    "diff_changes": f"SELECT *, CASE change_type WHEN 'BREAKING' THEN 'critical' WHEN 'MODIFIED' THEN 'high' ELSE 'low' END AS node_risk FROM ({_CHANGES})",
    "api_change_risk": f"""
      WITH c AS (SELECT '/api/part/' || l_partkey AS endpoint, count(*) AS n FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1),
      s AS (SELECT change_id, sum((change_type = 'BREAKING')::INT)::BIGINT AS n_breaking, sum(coalesce(n, 0))::BIGINT AS n_consumers FROM ({_CHANGES}) LEFT JOIN c USING (endpoint) GROUP BY 1),
      r AS (SELECT *, (least(3.0 * n_breaking * CASE WHEN n_consumers > 10 THEN 1.5 WHEN n_consumers > 5 THEN 1.3 WHEN n_consumers > 0 THEN 1.1 ELSE 1.0 END, 10) * CASE WHEN n_breaking > 0 AND n_consumers > 0 THEN 1.5 ELSE 1.0 END)::DECIMAL(8,3) AS raw_score FROM s)
      SELECT change_id, n_breaking, n_consumers, raw_score, least(raw_score, 10)::DECIMAL(8,3) AS score, CASE WHEN raw_score >= 7.5 THEN 'CRITICAL' WHEN raw_score >= 5.5 THEN 'HIGH' WHEN raw_score >= 3.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""",
    "api_routing": f"SELECT (l_linenumber % 3 = 0 AND false) OR false AS is_api, count(*) AS n FROM lineitem GROUP BY 1",
}
