"""Endpoint extraction, contract and diff changes on literal files, diffs and contracts."""

import time

import pytest
from pyspark.sql import functions as F

from rippleset.operators import contracts, diffs, endpoints
from rippleset.operators.endpoints import PARAMETERS

FILES = {
    "a.java": '''@RestController
@RequestMapping(value = "/api/stocks/")
public class C {
    @GetMapping("/{id}/items")
    @Deprecated // until (1.0
    public ResponseEntity<Map<String, List<Stock>>> find(
        @PathVariable Long id, /* a, b( */
        @RequestParam(value = "size", required = false, defaultValue = "f(1), \\"x\\"") Integer size,
        @RequestParam final Map<String, String> filters,
        HttpServletRequest request
    ) {
        return ok(find(id));
    }
    @PostMapping
    public void create(@RequestBody Part body) { }
    @PutMapping(path = "/a", produces = "x")
    Part put() { }
    @DeleteMapping(produces = "application/json") public ResponseEntity<?> del(@PathVariable("id") String id) {}
    @PatchMapping("/broken(") public int f(int
}
''',
    "b.py": '''from flask import Flask
@app.route('/a/<id>', methods=['GET', "post"])
def a(id, q=None,  # a comment, (
      z=f(1, 2)):
    pass
@blueprint.route("/b")
@login
def b(self):
    pass
''',
    "c.py": '''from fastapi import APIRouter
@router.get("/x/{id}", tags=["a(b"])
async def x(id: int, limit: int = 10, item: Dict[str, int] = None, db=Depends(get_db)) -> List[Item]:
    pass
@app.POST('/y')
def y(
    body: Body,
):
    pass
''',
    "d.js": '''const express = require('express');
router.get('/u/:id/p/:pid', (req, res) => { app.post("/v", f) })
''',
    "e.md": 'Use GET /api/x and then\n post "/y/z" or forget /no\n',
    "f.java": None,
    "g.java": "class X { }",
    "h.java": "",
}
EXPECTED = [
    ("a.java", 4, "GET", "/api/stocks/{id}/items", "ResponseEntity<Map<String, List<Stock>>>", "id:Long:true:path;size:Integer:false:query;filters:Map<String, String>:true:query"),
    ("a.java", 14, "POST", "/api/stocks/", "void", "body:Part:true:body"),
    ("a.java", 16, "PUT", "/api/stocks/a", "Part", ""),
    ("a.java", 18, "DELETE", "/api/stocks/", "ResponseEntity<?>", "id:String:true:path"),
    ("a.java", 19, "PATCH", "/api/stocks/broken(", None, ""),
    ("b.py", 2, "GET", "/a/<id>", None, "id:any:true:query;q:any:false:query;z:any:false:query"),
    ("b.py", 2, "POST", "/a/<id>", None, "id:any:true:query;q:any:false:query;z:any:false:query"),
    ("b.py", 6, "GET", "/b", None, ""),
    ("c.py", 2, "GET", "/x/{id}", "List[Item]", "id:int:true:query;limit:int:false:query;item:Dict[str, int]:false:body"),
    ("c.py", 5, "POST", "/y", None, "body:Body:true:body"),
    ("d.js", 2, "GET", "/u/:id/p/:pid", None, "id:string:true:path;pid:string:true:path"),
    ("d.js", 2, "POST", "/v", None, ""),
    ("e.md", 1, "GET", "/api/x", None, ""),
    ("e.md", 2, "POST", "/y/z", None, ""),
]


def test_endpoints(spark):
    df = spark.createDataFrame([("r", p, c) for p, c in FILES.items()], "repo string, path string, content string")
    got = endpoints.endpoints(df).select("path", "line", "method", "api_path", "return_type", endpoints.shown(F.col("params")))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, EXPECTED))


def test_endpoints_in_linear_time(spark):
    """A file of 2 MB without an end to its brackets and strings is read in seconds."""
    big = "@RestController\n" + "int x = 1; // (\n" * 60_000 + '@GetMapping("/z")\npublic int f(' + '"a" (' * 200_000
    df = spark.createDataFrame([("r", "a.java", big)], "repo string, path string, content string")
    began = time.time()
    (row,) = endpoints.endpoints(df).collect()
    assert (row["line"], row["method"], row["api_path"]) == (60_002, "GET", "/z") and time.time() - began < 60


def contract(change, method, path, line=1, returned=None, params=()):
    return (change, method, path, line, returned, [tuple(p) for p in params])


def table(spark, rows):
    return spark.createDataFrame(rows, f"change_id long, method string, path string, line int, return_type string, params {PARAMETERS}")


def changed(spark, before, after):
    got = contracts.diff_contracts(table(spark, before), table(spark, after)).collect()
    return sorted((r["method"], r["endpoint"], r["change_type"], r["reason"]) for r in got)


Q = ("q", "int", True, "query")


@pytest.mark.parametrize(
    ("before", "after", "expected"),
    [
        ([contract(1, "GET", "/a")], [contract(1, "GET", "/a")], []),  # no return type on either side is no change
        ([contract(1, "GET", "/a", returned="X")], [contract(1, "GET", "/a")], []),
        ([contract(1, "GET", "/a", returned="X")], [contract(1, "GET", "/a", returned="Y")], [("GET", "/a", "BREAKING", "Return type changed: X → Y")]),
        ([contract(1, "GET", "/a")], [], [("GET", "/a", "BREAKING", "Endpoint removed")]),
        ([], [contract(1, "GET", "/a")], [("GET", "/a", "ADDED", "New endpoint added")]),
        ([contract(1, "GET", "/a")], [contract(2, "GET", "/a")], [("GET", "/a", "ADDED", "New endpoint added"), ("GET", "/a", "BREAKING", "Endpoint removed")]),
        ([contract(1, "GET", "/a/b/{x}")], [contract(1, "GET", "/a/c/{y}")], [("GET", "/a/c/{y}", "BREAKING", "Endpoint path changed from '/a/b/{x}' to '/a/c/{y}'")]),
        ([contract(1, "GET", "/a/{x}")], [contract(1, "GET", "/a/{y}")], [("GET", "/a/{x}", "BREAKING", "Endpoint removed"), ("GET", "/a/{y}", "ADDED", "New endpoint added")]),
        ([contract(1, "GET", "/a/b", 2), contract(1, "GET", "/a/c", 1)], [contract(1, "GET", "/a/d"), contract(1, "GET", "/a/e")],
         [("GET", "/a/b", "BREAKING", "Endpoint removed"), ("GET", "/a/d", "BREAKING", "Endpoint path changed from '/a/c' to '/a/d'"), ("GET", "/a/e", "BREAKING", "Endpoint path changed from '/a/c' to '/a/e'")]),
        # Of repeated contracts the last line wins.
        ([contract(1, "GET", "/a", 1, "X"), contract(1, "GET", "/a", 9, "Y")], [contract(1, "GET", "/a", 5, "Y"), contract(1, "GET", "/a", 3, "X")], []),
        ([contract(1, "GET", "/a", params=[Q])], [contract(1, "GET", "/a")], [("GET", "/a", "BREAKING", "Required parameter 'q' removed")]),
        ([contract(1, "GET", "/a", params=[("q", "int", False, "query")])], [contract(1, "GET", "/a")], [("GET", "/a", "MODIFIED", "Optional parameter 'q' removed")]),
        ([contract(1, "GET", "/a")], [contract(1, "GET", "/a", params=[Q])], [("GET", "/a", "BREAKING", "New required parameter 'q' added")]),
        ([contract(1, "GET", "/a", params=[Q])], [contract(1, "GET", "/a", params=[("q", "long", True, "query")])], [("GET", "/a", "BREAKING", "Parameter 'q' type changed: int → long")]),
        ([], [], []),
    ],
)
def test_diff_contracts(spark, before, after, expected):
    assert changed(spark, before, after) == expected


HEAD = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,4 +1,5 @@\n"
DIFFS = [
    (HEAD + '     @GetMapping("/account/{id}")\n-    public ResponseEntity<?> by(@PathVariable String id) {\n+    public ResponseEntity<Money> by(@PathVariable String id,\n+        @RequestParam String currency) {',
     [("GET", "/account/{id}", "BREAKING", "New required parameter 'currency' added; Return type changed: ResponseEntity<?> → ResponseEntity<Money>", "contracts")]),
    ('-    @GetMapping("/account/{id}")\n+    @GetMapping("/by-account/{id}")\n     public int by(@PathVariable String id) {',
     [("GET", "/by-account/{id}", "BREAKING", "Endpoint path changed from '/account/{id}' to '/by-account/{id}'", "contracts")]),
    (HEAD + '     @PostMapping("/buy")\n+    // only a comment\n     public ResponseEntity<?> buy(@RequestBody Order o) {', []),
    (HEAD + '+    @PostMapping("/buy")\n+    public int buy(@RequestParam int n, @RequestParam(required = false) int m) {', [("POST", "/buy", "BREAKING", "Required parameter(s) added: n", "diff")]),
    (HEAD + '+    @PostMapping("/buy")\n+    public int buy(@RequestParam(required = false) int m) {', [("POST", "/buy", "ADDED", "New endpoint added", "contracts")]),
    (HEAD + '     @GetMapping\n-    public ResponseEntity<?> all() {\n+\n+    public ResponseEntity<Item> all() {', [("GET", "", "BREAKING", "Return type changed: ResponseEntity<?> → ResponseEntity<Item>", "contracts")]),
    (None, []), ("", []),
]


def test_diff_changes(spark):
    df = spark.createDataFrame([(i, "src/A.java", d) for i, (d, _) in enumerate(DIFFS)], "change_id long, path string, diff string")
    got = {}
    for r in diffs.diff_changes(df).collect():
        got.setdefault(r["change_id"], []).append((r["method"], r["endpoint"], r["change_type"], r["reason"], r["found_by"]))
    assert [sorted(got.get(i, [])) for i in range(len(DIFFS))] == [want for _, want in DIFFS]


def test_diff_lines(spark):
    df = spark.createDataFrame([(1, " a\n@@ -1 +1 @@\n b\n-c\n+d\n\\ No newline\n\n+++ b/x")], "change_id int, diff string")
    rows = lambda hunk: [tuple(r)[1:] for r in diffs.explode_diff(df, hunk).collect()]
    assert rows(False) == [(1, "context", "a"), (3, "context", "b"), (4, "removed", "c"), (5, "added", "d")]
    assert rows(True) == rows(False)[1:]


def test_api_routing(spark):
    df = spark.createDataFrame([("src/UserController.java", None), ("src/a.py", "+@app.route('/x')"), ("src/a.py", "x = 1"), (None, None)], "path string, diff string")
    assert [r[0] for r in df.select(diffs.is_api_change(F.col("path"), F.col("diff"))).collect()] == [True, True, False, False]


def test_api_risk(spark):
    changes = spark.createDataFrame([(1, "/a", "BREAKING"), (1, "/b", "ADDED"), (2, "/c", "BREAKING"), (3, "/d", "ADDED")], "change_id int, endpoint string, change_type string")
    calls = spark.createDataFrame([("/a",)] * 6 + [("/d",)], "path string")
    risks = spark.createDataFrame([(2, 5)], "change_id int, n_risks int")
    got = {r["change_id"]: (r["n_breaking"], r["n_consumers"], float(r["raw_score"]), float(r["score"]), r["level"]) for r in contracts.api_change_risk(changes, calls, risks).collect()}
    assert got == {1: (1, 6, 5.85, 5.85, "HIGH"), 2: (1, 0, 5.0, 5.0, "MEDIUM"), 3: (0, 1, 0.0, 0.0, "LOW")}
