"""API descriptions in indented YAML, taken apart line by line: operations, parameters, responses, schemas by property.

Nested structure is read from indents. One window over a document's lines keeps the last line of every level in front of
each, which gives a line its path and the lines it lies under; there are as many levels as the deepest document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from ..plans.settled import settle
from ..sources.tables import table

#: Methods of operations, keys of an overview, tokens of a chunk at most.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
OVERVIEW = ("summary", "description", "security", "deprecated", "tags")
MOST_TOKENS = 800
_LINE = r"^( *)(- +)?(?:(?:\"([^\"]*)\"|'([^']*)'|([^\s:#'\"\[{][^:]*?)) *:(?: +(.*))?|(.*))$"


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def yaml_lines(documents: DataFrame) -> DataFrame:
    """doc, n, indent, raw, value, path and above of each line. documents: doc, text.

    path holds the keys from the root to the line's own, "[]" for an item of a list; above the numbers of these lines. Blank
    lines and comments are left out, tabs and carriage returns at ends trimmed. Items may stand as deep as their list's key.
    A null text has no lines.
    """
    raw = documents.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "raw")).withColumn("raw", F.rtrim("raw", F.lit(" \t\r")))
    part = lambda k: F.regexp_extract("raw", _LINE, k)
    lines = raw.where(~F.col("raw").rlike(r"^\s*(#.*|---.*|\.\.\.)?$")).select(
        "doc", F.col("n").cast("long").alias("n"), "raw", F.length(part(1)).alias("indent"), (part(2) != "").alias("item"), F.concat(part(3), part(4), part(5)).alias("key"), F.concat(part(6), part(7)).alias("value"),
    )
    lines = settle(lines.withColumn("level", 2 * F.col("indent") + F.col("item").cast("int")), "lines")
    levels = sorted(r["level"] for r in lines.select("level").distinct().collect()) or [0]
    before = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("n", F.when(F.col("item"), "[]").otherwise(F.col("key")).alias("key")))).over(before).alias(f"_{k}") for k in levels]
    known = lines.select("*", F.array(*last).alias("_last"))
    seen = F.transform("_last", lambda x, i: F.struct(F.get(F.lit(levels), i).alias("level"), x["n"].alias("n"), x["key"].alias("key")))
    smaller = F.filter(seen, lambda x: (x["level"] < F.col("level")) & x["n"].isNotNull())
    # A column, as a lambda that names the expression would evaluate it for every element.
    below = X.fixed(known, "doc", "n", "indent", "raw", "value", "item", "key", _smaller=smaller)
    # From the outermost on, a line of a level counts only if no line further out came after it.
    open_ = F.filter("_smaller", lambda x: ~F.exists("_smaller", lambda y: (y["level"] < x["level"]) & (y["n"] > x["n"])))
    held = X.fixed(below, "doc", "n", "indent", "raw", "value", "item", "key", _open=open_)
    own = F.struct(F.col("n").alias("n"), F.when(F.col("item"), "[]").otherwise(F.col("key")).alias("key"))
    chain = F.concat(F.transform("_open", lambda x: F.struct(x["n"].alias("n"), x["key"].alias("key"))), F.array(own))
    return X.fixed(held, "doc", "n", "indent", "raw", "value", "item", _chain=chain).select("doc", "n", "indent", "raw", "value", "item", F.col("_chain.key").alias("path"), F.col("_chain.n").alias("above"))


def property_path(path: Column) -> Column:
    """The properties from a schema down to a line, as a.b[].c, and whether the line begins the innermost of them.

    path: keys below the schema. It alternates between "properties" and a name, with "items" between for lists; what does
    not go on so belongs to the property before it.
    """
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit("key").alias("next"), F.lit("").alias("list"))

    def step(a: Column, key: Column) -> Column:
        name = F.struct(F.concat(a["names"], F.array(F.concat(a["list"], key))).alias("names"), F.lit("key").alias("next"), F.lit("").alias("list"))
        down = F.struct(a["names"].alias("names"), F.lit("name").alias("next"), a["list"].alias("list"))
        items = F.struct(a["names"].alias("names"), F.lit("key").alias("next"), F.lit("[].").alias("list"))
        over = F.struct(a["names"].alias("names"), F.lit("over").alias("next"), a["list"].alias("list"))
        return F.when(a["next"] == "name", name).when((a["next"] == "key") & (key == "properties"), down).when((a["next"] == "key") & (key == "items") & (a["list"] == ""), items).otherwise(over)

    found = F.aggregate(path, start, step)
    joined = F.regexp_replace(F.array_join(found["names"], "."), r"\.\[\]", "[]")
    return F.struct(joined.alias("path"), found["names"].alias("names"), ((found["next"] == "key") & (found["list"] == "")).alias("own"))


def flatten_properties(lines: DataFrame) -> DataFrame:
    """doc, schema, property, required, n, definition of each property that has no properties of its own.

    lines: doc, schema (a number of the schema), n, raw, value, below (the path under the schema). A property is required
    if its name is in the list of the object it stands in. definition: its lines, from its own on.
    """
    known = lines.withColumn("_p", property_path(F.col("below")))
    inner = known.where(F.size("_p.names") > 0)
    leaves = inner.groupBy("doc", "schema", F.col("_p.path").alias("property"), F.col("_p.names").alias("_names")).agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "raw"))).alias("_lines"))
    outer = inner.where(F.size("_p.names") > 1).select("doc", "schema", F.slice("_p.names", F.lit(1), F.size("_p.names") - 1).alias("_names")).distinct()
    leaves = leaves.join(outer, ["doc", "schema", "_names"], "left_anti")
    # An item under "required" of an object: the path ends in it, right below that object's names.
    asked = known.where(F.get("below", F.size("below") - 1) == "[]").where(F.get("below", F.size("below") - 2) == "required")
    asked = asked.select("doc", "schema", F.array_join("_p.names", ".").alias("_in"), F.regexp_replace("value", "^[\"']|[\"']$", "").alias("_name")).distinct()
    name = F.regexp_replace(F.get("_names", F.size("_names") - 1), r"^\[\]\.", "")
    inside = F.array_join(F.slice("_names", F.lit(1), F.size("_names") - 1), ".")
    found = leaves.withColumns({"_at": inside, "_leaf": name}).join(asked.select("doc", "schema", F.col("_in").alias("_at"), F.col("_name").alias("_leaf"), F.lit(True).alias("required")).distinct(), ["doc", "schema", "_at", "_leaf"], "left")
    return found.select("doc", "schema", "property", F.coalesce("required", F.lit(False)).alias("required"), "n", F.array_join(F.transform("_lines", lambda x: x["raw"]), "\n").alias("definition"))


def pack(items: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Items packed in order into groups whose head and texts stay under so many tokens. items: keys, head, n, text.

    An item that is too large alone is an error. Only one operation's items of a kind, or one schema's, meet in a row.
    """
    rows = items.groupBy(*keys, "head").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("_items"))
    size = lambda n: F.floor((F.length("head") + n + 3) / 4)
    start = F.struct(F.array().cast("array<int>").alias("group"), F.lit(0).alias("k"), F.lit(0).alias("size"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x["text"]) + 1
        fits = (a["size"] == 0) | (size(a["size"] + n) <= most)
        k = F.when(fits, a["k"]).otherwise(a["k"] + 1)
        return F.struct(F.concat(a["group"], F.array(k)).alias("group"), k.alias("k"), F.when(fits, a["size"] + n).otherwise(n).alias("size"))

    dealt = rows.withColumn("_g", F.aggregate("_items", start, step)["group"])
    each = dealt.select(*keys, "head", F.explode(F.arrays_zip("_items", "_g")).alias("x")).select(*keys, "head", "x._items.*", F.col("x._g").alias("k"))
    groups = each.groupBy(*keys, "head", "k").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("_items"))
    content = F.concat_ws("\n", "head", F.array_join(F.transform("_items", lambda x: x["text"]), "\n"))
    return groups.select(*keys, "k", content.alias("content"))


def _whole(most: int, what: Column, content: Column) -> Column:
    too_long = F.concat(what, F.lit(": cannot be divided under the limit"))
    return F.when(tokens(content) > most, F.raise_error(too_long)).otherwise(content)


def chunk_openapi(documents: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """doc, unit, section, part, n, k, content, tokens. documents: doc, text.

    An operation is one chunk if it fits; else its overview, its parameters by place, its body by properties and its
    responses by family are packed in order, each chunk under the operation's name. A schema that does not fit is packed by
    property. Security schemes and responses of components stay whole. A document without paths is an error, as is a part
    that cannot be divided. Null documents are left out.
    """
    lines = settle(yaml_lines(documents.where("text IS NOT NULL")), "yaml")
    at = lambda k: F.get("path", F.lit(k))
    without = documents.where("text IS NOT NULL").join(lines.where((at(0) == "paths") & (F.size("path") > 1)).select("doc").distinct(), "doc", "left_anti")
    if without.take(1):
        raise ValueError("a document has no paths")
    ops = lines.where((at(0) == "paths") & F.lower(at(2)).isin(*METHODS)).withColumns({"unit_n": F.get("above", F.lit(2)), "name": F.concat_ws(" ", F.upper(at(2)), at(1))})
    top = ops.where("n = unit_n").select("doc", "unit_n", "name", F.col("indent").alias("base"))
    named = ops.where((F.size("path") == 4) & (at(3) == "operationId")).select("doc", "unit_n", F.col("value").alias("_id"))
    heads = top.join(named, ["doc", "unit_n"], "left").select("doc", "unit_n", "base", "name", F.concat_ws("\n", "name", F.concat(F.lit("operationId: "), F.col("_id"))).alias("header"))
    body = ops.where("n > unit_n").drop("name").join(heads, ["doc", "unit_n"]).withColumn("line", F.substring("raw", F.col("base") + 3, F.length("raw")))
    sizes = body.groupBy("doc", "unit_n").agg((F.sum(F.length("line") + 1) + F.max(F.length("header"))).alias("_chars"))
    fits = settle(sizes.select("doc", "unit_n", (F.floor((F.col("_chars") + 3) / 4) <= most).alias("fits")), "fits")
    body = settle(body.join(fits, ["doc", "unit_n"]), "body")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    small = body.where("fits").groupBy("doc", "unit_n", "name", "header").agg(text.alias("text"))
    small = small.select("doc", F.lit("operation").alias("unit"), F.col("name").alias("section"), F.lit("operation").alias("part"), F.col("unit_n").alias("n"), F.lit(0).alias("k"), F.concat_ws("\n", "header", "text").alias("content"))

    large = body.where("NOT fits")
    section, item = at(3), F.get("above", F.lit(4))
    groups = large.where((section.isin("parameters", "responses")) & item.isNotNull()).withColumns({"kind": section, "item": item})
    items = groups.groupBy("doc", "unit_n", "name", "header", "kind", "item").agg(text.alias("text"), F.max(F.when(F.col("n") == F.col("item"), at(4))).alias("key"))
    place = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^\s*(?:- +)?in: +[\"']?([^\s\"']+)", 1), F.lit("")), F.lit("unknown"))
    family = F.when(F.col("key").rlike("^[2-5]"), F.concat(F.substring("key", 1, 1), F.lit("xx"))).otherwise("default")
    kind = F.when(F.col("kind") == "parameters", F.concat(F.lit("parameters:"), place)).otherwise(F.concat(F.lit("responses:"), family))
    items = items.select("doc", "unit_n", "name", kind.alias("part"), F.concat_ws("\n", "header", F.concat("kind", F.lit(":"))).alias("head"), F.col("item").alias("n"), "text")
    overview = large.where(section.isin(*OVERVIEW)).withColumn("item", F.get("above", F.lit(3))).groupBy("doc", "unit_n", "name", "header", "item").agg(text.alias("text"))
    overview = overview.select("doc", "unit_n", "name", F.lit("overview").alias("part"), F.col("header").alias("head"), F.col("item").alias("n"), "text")
    schemas = large.where((section == "requestBody") & (at(4) == "content") & (at(6) == "schema"))
    props = flatten_properties(schemas.select("doc", F.get("above", F.lit(6)).alias("schema"), "n", "raw", "value", F.slice("path", F.lit(8), F.size("path")).alias("below")))
    of = schemas.select("doc", F.get("above", F.lit(6)).alias("schema"), "unit_n", "name", "header", at(5).alias("media")).distinct()
    body_items = props.join(of, ["doc", "schema"]).select("doc", "unit_n", "name", F.lit("parameters:body").alias("part"), F.concat_ws("\n", "header", F.concat(F.lit("requestBody: "), "media")).alias("head"), "n", _property().alias("text"))
    plain = large.where(section == "requestBody").join(body_items.select("doc", "unit_n").distinct(), ["doc", "unit_n"], "left_anti")
    plain = plain.groupBy("doc", "unit_n", "name", "header").agg(F.min("n").alias("n"), text.alias("text")).select("doc", "unit_n", "name", F.lit("parameters:body").alias("part"), F.col("header").alias("head"), "n", "text")
    every = items.unionByName(overview).unionByName(body_items).unionByName(plain)
    packed = pack(every, ["doc", "unit_n", "name", "part"], most)
    parts = packed.select("doc", F.lit("operation").alias("unit"), F.col("name").alias("section"), "part", F.col("unit_n").alias("n"), "k", _whole(most, F.concat_ws(" ", "name", "part"), F.col("content")).alias("content"))
    out = small.unionByName(parts).unionByName(_components(lines, most))
    return out.withColumn("tokens", tokens(F.col("content")))


def _property() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("- "), F.col("property"), F.when(F.col("required"), " (required)").otherwise("")), F.col("definition"))


def _components(lines: DataFrame, most: int) -> DataFrame:
    at = lambda k: F.get("path", F.lit(k))
    titles = {"schemas": ("schema", "Schema "), "securitySchemes": ("security", "Security scheme "), "responses": ("error", "Response object ")}
    own = lines.where((at(0) == "components") & at(1).isin(*titles) & (F.size("path") > 2)).withColumns({"kind": at(1), "unit_n": F.get("above", F.lit(2)), "name": at(2)})
    unit, title = F.lit(None), F.lit(None)
    for kind, (u, t) in titles.items():
        unit, title = F.when(F.col("kind") == kind, u).otherwise(unit), F.when(F.col("kind") == kind, t).otherwise(title)
    base = own.where("n = unit_n").select("doc", "unit_n", F.col("indent").alias("base"))
    body = own.where("n > unit_n").join(base, ["doc", "unit_n"]).withColumn("line", F.substring("raw", F.col("base") + 3, F.length("raw")))
    body = settle(body.withColumn("head", F.concat(title, "name")).withColumn("unit", unit), "components")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    whole = body.groupBy("doc", "unit", "unit_n", "name", "head", "kind").agg(text.alias("text"), F.max(F.get("path", F.lit(3)) == "properties").alias("divided"))
    whole = whole.withColumn("content", F.concat_ws("\n", "head", "text"))
    split = (F.col("unit") == "schema") & F.col("divided") & (tokens(F.col("content")) > most)
    large = whole.where(split).select("doc", "unit_n", "name", "head")
    section = lambda name: F.concat_ws(" ", F.lit("components"), name)
    keep = whole.where(~F.coalesce(split, F.lit(False))).select("doc", "unit", section(F.concat_ws(" ", "kind", "name")).alias("section"), F.lit("whole").alias("part"), F.col("unit_n").alias("n"), F.lit(0).alias("k"), "content")
    of = body.join(large.select("doc", "unit_n"), ["doc", "unit_n"], "left_semi")
    props = flatten_properties(of.select("doc", F.col("unit_n").alias("schema"), "n", "raw", "value", F.slice("path", F.lit(4), F.size("path")).alias("below")))
    items = props.join(large.withColumnRenamed("unit_n", "schema"), ["doc", "schema"]).select("doc", F.col("schema").alias("unit_n"), "name", F.lit("properties").alias("part"), "head", "n", _property().alias("text"))
    packed = pack(items, ["doc", "unit_n", "name", "part"], most)
    return keep.unionByName(packed.select("doc", F.lit("schema").alias("unit"), section(F.concat(F.lit("schemas "), "name")).alias("section"), "part", F.col("unit_n").alias("n"), "k", _whole(most, F.col("name"), F.col("content")).alias("content")))


def _described(spark, d) -> DataFrame:
    """Fifty customers to a document: an operation for each, its orders as parameters."""
    place = F.when(F.col("o_orderstatus") == "F", "query").when(F.col("o_orderstatus") == "O", "header").otherwise("path")
    one = F.format_string("\n        - name: order_%d\n          in: %s\n          description: %s", "o_orderkey", place, "o_orderpriority")
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("t")))), lambda x: x["t"]), "").alias("parameters"))
    customers = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.format_string('\n  /customers/%d:\n    get:\n      summary: %s of %s\n      parameters:%s\n      responses:\n        "200":\n          description: nation %d\n        "404":\n          description: none', "c_custkey", "c_name", "c_mktsegment", F.coalesce("parameters", F.lit("")), "c_nationkey")
    grouped = customers.groupBy(F.expr("c_custkey DIV 50").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", text.alias("t")))).alias("ops"))
    return grouped.select("doc", F.concat(F.lit("openapi: 3.0.0\npaths:"), F.array_join(F.transform("ops", lambda x: x["t"]), "")).alias("text"))


@query(r"""WITH RECURSIVE p AS (SELECT o_custkey AS c, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'query' WHEN 'O' THEN 'header' ELSE 'path' END AS place, '  - name: order_' || o_orderkey || chr(10) || '    in: ' || CASE o_orderstatus WHEN 'F' THEN 'query' WHEN 'O' THEN 'header' ELSE 'path' END || chr(10) || '    description: ' || o_orderpriority AS t FROM orders),
a AS (SELECT c_custkey // 50 AS doc, c_custkey AS c, 'GET /customers/' || c_custkey AS h, 'summary: ' || c_name || ' of ' || c_mktsegment AS s, string_agg(t, chr(10) ORDER BY o_orderkey) AS t, '  "200":' || chr(10) || '    description: nation ' || c_nationkey AS ok FROM customer LEFT JOIN p ON p.c = c_custkey GROUP BY ALL),
w AS (SELECT *, h || chr(10) || s || chr(10) || 'parameters:' || coalesce(chr(10) || t, '') || chr(10) || 'responses:' || chr(10) || ok || chr(10) || '  "404":' || chr(10) || '    description: none' AS content FROM a),
big AS (SELECT * FROM w WHERE (length(content) + 3) // 4 > 120),
i AS (SELECT doc, b.c, h, place, p.t, length(h) + 12 AS head, row_number() OVER (PARTITION BY b.c, place ORDER BY o_orderkey) AS i, length(p.t) + 1 AS n FROM big b JOIN p ON p.c = b.c),
g AS (SELECT *, 0 AS k, n AS size FROM i WHERE i = 1 UNION ALL SELECT i.*, CASE WHEN (i.head + g.size + i.n + 3) // 4 <= 120 THEN k ELSE k + 1 END, CASE WHEN (i.head + g.size + i.n + 3) // 4 <= 120 THEN g.size + i.n ELSE i.n END FROM g JOIN i ON i.c = g.c AND i.place = g.place AND i.i = g.i + 1),
o AS (SELECT doc, h, 'operation' AS part, 0 AS k, content FROM w WHERE (length(content) + 3) // 4 <= 120 UNION ALL SELECT doc, h, 'overview', 0, h || chr(10) || s FROM big
  UNION ALL SELECT doc, h, 'responses:2xx', 0, h || chr(10) || 'responses:' || chr(10) || ok FROM big UNION ALL SELECT doc, h, 'responses:4xx', 0, h || chr(10) || 'responses:' || chr(10) || '  "404":' || chr(10) || '    description: none' FROM big
  UNION ALL SELECT doc, h, 'parameters:' || place, k, h || chr(10) || 'parameters:' || chr(10) || string_agg(t, chr(10) ORDER BY i) FROM g GROUP BY doc, h, place, k)
SELECT doc, h AS section, part, k, greatest(1, (length(content) + 3) // 4) AS tokens, md5(content) AS content_md5 FROM o""")
def openapi_chunks(spark, d):
    """Operations on customers, whole where they have few orders, else their parameters packed by place."""
    return chunk_openapi(_described(spark, d), 120).select("doc", "section", "part", "k", "tokens", F.md5("content").alias("content_md5"))


@query(r"""WITH n AS (SELECT n_nationkey AS doc, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT doc, p.path AS property, p.required, replace(replace(p.def, '$n', n_name), '$r', r_name) AS definition FROM n, (VALUES ('name', true, '      name:' || chr(10) || '        const: $n'), ('region.name', false, '          name:' || chr(10) || '            const: $r'),
('customers[].key', true, '            key:' || chr(10) || '              type: integer'), ('customers[].orders[].price', false, '                  price:' || chr(10) || '                    type: number')) p(path, required, def)""")
def schema_properties(spark, d):
    """The flattened properties of a schema for each nation, with what is required."""
    text = F.format_string(
        "schemas:\n  Nation:\n    required:\n      - name\n    properties:\n      name:\n        const: %s\n      region:\n        type: object\n        properties:\n          name:\n            const: %s\n      customers:\n        type: array\n        items:\n          required: \n          - key\n          properties:\n            key:\n              type: integer\n            orders:\n              items:\n                properties:\n                  price:\n                    type: number", "n_name", "r_name",
    )
    docs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("doc"), text.alias("text"))
    lines = yaml_lines(docs).where(F.size("path") > 2)
    below = F.slice("path", F.lit(3), F.size("path"))
    return flatten_properties(lines.select("doc", F.get("above", F.lit(1)).alias("schema"), "n", "raw", "value", below.alias("below"))).select("doc", "property", "required", "definition")
