import pytest
from pyspark.sql import functions as F

from evidara.operators import openapi

SPEC = """# a comment
openapi: "3.0.0"
paths:
  /routes/{prefix}:
    summary: not an operation
    get:
      operationId: getRoute
      summary: One route

      parameters:
      - name: prefix
        in: path
      - in: query
        name: depth
      responses:
        "200":
          description: ok
  /routes:
    post:
      summary: Add routes
      description: >
        Long words about adding routes to the table of a router and what comes of it.
      parameters:
%s
      requestBody:
        required: true
        content:
          application/json:
            schema:
              type: object
              required:
                - prefix
              properties:
                prefix:
                  type: string
                origin:
                  type: object
                  required: &x
                    - asn
                  properties:
                    asn:
                      type: integer
                    name:
                      type: string
                hops:
                  type: array
                  items:
                    type: object
                    required:
                      - properties
                    properties:
                      properties:
                        type: string
                        description: a property of that name
                tags:
                  type: array
                  items:
                    type: string
      responses:
        "200":
          description: added
        '404':
          description: not there
        default:
          description: whatever
components:
  schemas:
    Small:
      type: string
  securitySchemes:
    key:
      type: apiKey
  responses:
    Gone:
      description: no more
"""
MANY = "\n".join(f"        - name: p{i}\n          in: {'query' if i % 2 else 'header'}\n          description: parameter number {i}" for i in range(12))


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc long, text string")


@pytest.fixture(scope="module")
def chunks(spark):
    return {(r["section"], r["part"], r["k"]): r for r in openapi.chunk_openapi(frame(spark, SPEC % MANY, None), 60).collect()}


def test_lines_know_their_path(spark):
    rows = openapi.yaml_lines(frame(spark, "a:\n  - b: 1\n    c:\n    - x\n    - y: 2\n  - z\nd: e\n\n# no\n  f: g")).orderBy("n").collect()
    assert [("/".join(r["path"]), r["value"]) for r in rows] == [("a", ""), ("a/[]", "1"), ("a/[]/c", ""), ("a/[]/c/[]", "x"), ("a/[]/c/[]", "2"), ("a/[]", "z"), ("d", "e"), ("d/f", "g")]


def test_paths_of_properties(spark):
    deep = "properties " + " ".join(f"n{k} properties" for k in range(60)) + " end type"
    cases = {"properties a": "a", "properties a properties b items properties c": "a.b[].c", "properties properties properties items items properties properties type": "properties.items[].properties", "properties a items type": "a", "type": "", "required []": "", deep: ".".join([*(f"n{k}" for k in range(60)), "end"])}
    df = spark.createDataFrame([(k.split(" "), v) for k, v in cases.items()], "path array<string>, want string")
    assert [r["got"] == r["want"] for r in df.select("want", openapi.property_path(F.col("path"))["path"].alias("got")).collect()] == [True] * len(cases)


def test_an_operation_that_fits_is_one_chunk(chunks):
    whole = chunks["GET /routes/{prefix}", "operation", 0]
    assert whole["content"].startswith("GET /routes/{prefix}\noperationId: getRoute\noperationId: getRoute\nsummary: One route\nparameters:\n- name: prefix\n  in: path\n")
    assert whole["content"].endswith('responses:\n  "200":\n    description: ok') and whole["tokens"] == -(-len(whole["content"]) // 4)


def test_a_large_operation_is_divided(chunks):
    own = {k[1:]: r["content"] for k, r in chunks.items() if k[0] == "POST /routes"}
    assert {p for p, _ in own} == {"overview", "parameters:header", "parameters:query", "parameters:body", "responses:2xx", "responses:4xx", "responses:default"}
    assert all(c.startswith("POST /routes\n") and (len(c) + 3) // 4 <= 60 for c in own.values())
    for place, which in (("query", range(1, 12, 2)), ("header", range(0, 12, 2))):
        text = "\n".join(c for (p, _), c in sorted(own.items()) if p == f"parameters:{place}")
        assert [f"name: p{i}\n" in text for i in which] == [True] * 6 and text.count("- name:") == 6
        assert len([1 for p, _ in own if p == f"parameters:{place}"]) > 1
    assert own["responses:4xx", 0] == "POST /routes\nresponses:\n  '404':\n    description: not there"
    assert "Long words about adding" in own["overview", 0]


def test_a_body_is_divided_by_properties(chunks):
    body = "\n".join(r["content"] for k, r in sorted(chunks.items()) if k[1] == "parameters:body")
    named = [x[2:] for x in body.split("\n") if x.startswith("- ")]
    assert named == ["prefix (required)", "origin.asn (required)", "origin.name", "hops[].properties (required)", "tags"]
    assert "description: a property of that name" in body and "type: integer" in body


def test_components(chunks):
    of = {(r["unit"], r["section"]): r["content"] for r in chunks.values() if r["unit"] != "operation"}
    assert of == {("schema", "components schemas Small"): "Schema Small\ntype: string", ("security", "components securitySchemes key"): "Security scheme key\ntype: apiKey", ("error", "components responses Gone"): "Response object Gone\ndescription: no more"}


def test_a_large_schema_is_divided(spark):
    spec = "paths:\n  /x:\n    get:\n      summary: s\ncomponents:\n  schemas:\n    Big:\n      type: object\n      required: \n      - f3\n      properties:\n" + "\n".join(f"        f{i}:\n          type: string" for i in range(20))
    got = [r["content"] for r in openapi.chunk_openapi(frame(spark, spec), 40).where("unit = 'schema'").orderBy("k").collect()]
    assert len(got) > 2 and all(c.startswith("Schema Big\n- f") and (len(c) + 3) // 4 <= 40 for c in got)
    assert [x for c in got for x in c.split("\n") if x.startswith("- ")] == [f"- f{i}" + " (required)" * (i == 3) for i in range(20)]


def test_what_cannot_be_divided_is_an_error(spark):
    long = SPEC % ("        - name: p\n          in: query\n          description: " + "x" * 400)
    with pytest.raises(Exception, match="cannot be divided"):
        openapi.chunk_openapi(frame(spark, long), 60).collect()
    with pytest.raises(ValueError, match="no paths"):
        openapi.chunk_openapi(frame(spark, "openapi: 3\ninfo:\n  x: y"))
    assert openapi.chunk_openapi(frame(spark, "").where("false")).count() == 0
