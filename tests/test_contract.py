"""Contracts over inline records and frames: keys, references, cells; each case with its expected outcome."""

import datetime
import decimal
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.functions import decode
from keelson.operators import keys, rows
from keelson.plans.catalog import catalog, view_tables
from keelson.plans.contract import Contract, record_contract, record_warnings, wrong_width
from keelson.model import View
from keelson.sources.language import compile_text


def violations(spark, source, strict=True):
    rows = record_contract(spark, source, strict).violations().collect()
    return sorted((r["rule"], r["table_name"], r["message"]) for r in rows)


def warnings(spark, source):
    return sorted((r["column_name"], r["message"]) for r in record_warnings(spark, compile_text(source).result()).collect())


def test_composite_pk_duplicate(spark):
    found = violations(spark, "Table order_items {\n order_id int\n product_id int\n quantity int\n indexes {\n (order_id, product_id) [pk]\n }\n records (order_id, product_id, quantity) {\n 1, 100, 2\n 1, 100, 5\n 2, 100, 1\n }\n}")
    assert found == [("pk_duplicate", "order_items", "Duplicate Composite PK: (order_items.order_id, order_items.product_id) = (1, 100)")] * 2


def test_composite_pk_null(spark):
    found = violations(spark, "Table t {\n a int\n b int\n indexes {\n (a, b) [pk]\n }\n records (a, b) {\n 1, 100\n 1, null\n null, 101\n }\n}")
    assert [f[0] for f in found] == ["pk_null", "pk_null"] and "cannot be NULL" in found[0][2]


def test_increment_pk_has_no_violations(spark):
    assert not violations(spark, "Table users {\n id int [pk, increment]\n name varchar\n records (id, name) {\n 1, 'A'\n 1, 'B'\n null, 'C'\n }\n}")
    assert not violations(spark, "Table users {\n id serial [pk]\n name varchar\n records (id, name) {\n null, 'A'\n null, 'C'\n }\n}")


def test_default_fills_pk(spark):
    found = violations(spark, "Table users {\n id int [pk, not null, default: 1]\n name varchar\n records (id, name) {\n null, 'A'\n null, 'B'\n }\n}")
    assert found == [("pk_duplicate", "users", "Duplicate PK: users.id = null")] * 2


def test_unique_null_exempt_unless_filled(spark):
    source = "Table t {{\n a int [unique{}]\n b int\n records (a, b) {{\n null, 1\n null, 2\n 3, 3\n 3, 4\n }}\n}}"
    assert len(violations(spark, source.format(""))) == 2
    assert len(violations(spark, source.format(", default: 0"))) == 4


def test_expression_default_is_strict_only(spark):
    source = "Table t {\n a varchar [unique, default: `now()`]\n b int\n records (a, b) {\n null, 1\n null, 2\n }\n}"
    assert len(violations(spark, source)) == 2 and not violations(spark, source, strict=False)


def test_pk_missing_column(spark):
    found = violations(spark, "Table t {\n id int [pk]\n b int\n records (b) {\n 1\n 2\n }\n}")
    assert [f[0] for f in found] == ["pk_missing_column"] * 2


def test_composite_fk(spark):
    source = "Table merchants {\n id int\n country_code varchar\n indexes {\n (id, country_code) [pk]\n }\n records (id, country_code) {\n 1, 'US'\n 2, 'UK'\n }\n}\nTable orders {\n id int [pk]\n merchant_id int\n country varchar\n records (id, merchant_id, country) {\n 1, 1, 'US'\n 2, 1, 'UK'\n 3, null, 'UK'\n }\n}\nRef: orders.(merchant_id, country) > merchants.(id, country_code)"
    assert violations(spark, source) == [("fk", "orders", 'FK violation: (orders.merchant_id, orders.country) = (1, "UK") does not exist in (merchants.id, merchants.country_code)')]


def test_many_to_many_both_ways(spark):
    source = "Table p {\n id int\n r varchar\n indexes {\n (id, r) [pk]\n }\n records (id, r) {\n 1, 'US'\n 2, 'US'\n }\n}\nTable c {\n id int\n r varchar\n indexes {\n (id, r) [pk]\n }\n records (id, r) {\n 1, 'US'\n 3, 'EU'\n }\n}\nRef: p.(id, r) <> c.(id, r)"
    assert [(f[0], f[1]) for f in violations(spark, source)] == [("fk", "c"), ("fk", "p")]


def test_self_inline_and_partial_fk(spark):
    source = "TablePartial owned {\n user_id int [ref: > users.id]\n}\nTable users {\n id int [pk]\n records (id) {\n 1\n }\n}\nTable posts {\n id int [pk]\n ~owned\n records (id, user_id) {\n 1, 1\n 2, 999\n }\n}\nTable staff {\n id int [pk]\n boss int\n records (id, boss) {\n 1, null\n 2, 1\n 3, 999\n }\n}\nRef: staff.boss > staff.id"
    assert [(f[0], f[1]) for f in violations(spark, source)] == [("fk", "posts"), ("fk", "staff")]


def test_fk_to_nothing(spark):
    source = "Table follows {\n a int\n b int\n records (a, b) {\n 1, 2\n }\n}\nTable users {\n id int [pk]\n}\nRef: users.id < follows.a\nRef: users.id < follows.b"
    assert len(violations(spark, source)) == 2


def test_fk_kinds_must_agree(spark):
    a, b = spark.createDataFrame([("1",)], "k string"), spark.createDataFrame([(1,)], "id int")
    with pytest.raises(TypeError):
        keys.orphan_rows(a, ["k"], b, ["id"])


def test_booleans(spark):
    good = "true, false, 'true', \"false\", 't', 'f', 'y', 'n', 'YES', 'no', 1, 0, '1', \"0\"".split(", ")
    bad = ['"not_a_bool"', "99", "-1", '"invalid"', "2"]
    rows = "\n".join(f"{i}, {v}" for i, v in enumerate(good + bad))
    found = warnings(spark, f"Table data {{\n id int\n active boolean\n records (id, active) {{\n{rows}\n}}\n}}")
    assert len(found) == 5 and {f[0] for f in found} == {"active"}


def test_numbers(spark):
    source = "Table data {\n id int\n q int\n p decimal\n records (id, q, p) {\n 1, \"x\", 1\n 2, 10.5, 1\n 3, 1, \"y\"\n 4, 1, true\n }\n}"
    assert len(warnings(spark, source)) == 4


def test_precision_and_scale(spark):
    source = "Table p {\n id int\n price decimal(5,2)\n rate numeric(10,3)\n records (id, price, rate) {\n 1, 99.99, 1.234\n 2, 12345.67, 12345.678\n 3, 99.999, 1234567.890\n }\n}"
    assert warnings(spark, source) == [("price", "Column 'price' exceeds precision 5"), ("price", "Column 'price' exceeds scale 2")]


def test_string_bytes(spark):
    source = "Table m {\n id int\n a varchar(20)\n b varchar(10)\n c \"character varying\"(8)\n records (id, a, b, c) {\n 1, '😀😀😀😀😀', 'ok', 'x'\n 2, 'x', '😀😀😀', 'y'\n 3, 'x', 'y', 'much too long'\n }\n}"
    assert [w[0] for w in warnings(spark, source)] == ["b", "c"]


def test_empty_string_is_null_but_for_strings(spark):
    c = record_contract(spark, 'Table d {\n n int\n b boolean\n s varchar\n records (n, b, s) {\n "", "", ""\n }\n}')
    assert c.frame(c.db.tables[0]).first().asDict() == {"n": None, "b": None, "s": ""}


def test_enums(spark):
    source = "Enum auth.role {\n admin\n user\n}\nTable u {\n id int\n r auth.role\n records (id, r) {\n 1, auth.role.admin\n 2, 'user'\n 3, null\n 4, 1\n }\n}"
    assert warnings(spark, source) == [("r", "Invalid enum value for column 'r'")]


def test_wrong_width_rows_go(spark):
    c = record_contract(spark, "Table t {\n a int\n b int\n records (b, a) {\n 1, 2\n 3\n 4, 5, 6\n }\n}")
    assert wrong_width(c.db.records[0]) == [2, 3]
    assert [tuple(r) for r in c.frame(c.db.tables[0]).select("a", "b").collect()] == [(2, 1)]


def test_not_null_needs_no_default(spark):
    source = "Table t {{\n a int\n b int [not null{}]\n records (a, b) {{\n 1, null\n }}\n}}"
    assert len(warnings(spark, source.format(""))) == 1
    assert not warnings(spark, source.format(", default: 5")) and not warnings(spark, source.format(", increment"))
    assert len(warnings(spark, source.format(", default: null"))) == 1


def test_check_and_not_null_on_a_frame(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, n int")
    c = Contract.compile("Table t {\n id int [pk]\n n int [not null, check: `n > 0`]\n}", {"t": df})
    found = {(r["rule"], r["key_json"]) for r in c.violations().collect()}
    assert found == {("not_null", '{"id":2}'), ("check", '{"id":3}')}
    assert {r["rule"]: r["violations"] for r in c.summary().collect()} == {"not_null": 1, "check": 1, "pk_null": 0, "pk_duplicate": 0}


def plain_digits(x):
    """Digits before and after the point of a number's shortest text, without exponent."""
    whole, _, part = format(decimal.Decimal(repr(abs(x))), "f").partition(".")
    part = part.rstrip("0")
    return len(whole.lstrip("0")) or 1, len(part)


def test_digits(spark):
    r = random.Random(0)
    values = [0.5, 0.07, -12.5, 100.0, 0.0, 1234567.89, 2e20, 1e25, 1.5e-7, 1e-20, 9.999, 123456789012345680.0, 0.1 + 0.2, 1e15 / 3, -1e22]
    values += [r.choice([-1, 1]) * round(r.random() * 10 ** r.randint(0, 12), r.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    for p in (1, 3, 5, 9, 17, 21, 26, 40):
        over = {x["i"] for x in df.where(decode.exceeds_precision(F.col("x"), p)).collect()}
        assert over == {i for i, x in enumerate(values) if sum(plain_digits(x)) > p}
    for scale in (0, 1, 2, 8, 19):
        assert {x["i"] for x in df.where(decode.exceeds_scale(F.col("x"), scale)).collect()} == {i for i, x in enumerate(values) if plain_digits(x)[1] > scale}
    exact = spark.createDataFrame([(decimal.Decimal("12.30"),), (decimal.Decimal("12.34"),), (None,)], "x decimal(10,2)")
    assert [x[0] for x in exact.select(decode.exceeds_precision(F.col("x"), 3)).collect()] == [False, True, None]


def test_precision_at_powers_of_ten(spark):
    """10^k has k + 1 digits and the double below it at most k, whatever k; 10.0**23 isn't the double nearest to 10^23."""
    for k in (15, 18, 19, 22, 23, 24, 29, 300):
        values = [float(f"1e{k}"), math.nextafter(float(f"1e{k}"), 0)]
        over = spark.createDataFrame(list(enumerate(values)), "i int, x double").where(decode.exceeds_precision(F.col("x"), k))
        assert {r["i"] for r in over.collect()} == {i for i, x in enumerate(values) if sum(plain_digits(x)) > k}


def test_large_and_whole_decimals(spark):
    source = "Table p {\n id int\n a decimal(5,2)\n b decimal(5)\n records (id, a, b) {\n 1, 2e20, 1\n 2, 1e25, 1.5\n 3, 99.5, 100\n }\n}"
    assert warnings(spark, source) == [("a", "Column 'a' exceeds precision 5"), ("a", "Column 'a' exceeds precision 5"), ("b", "Column 'b' exceeds scale 0")]


DEFAULTS = ["null", "5", "1.5", "'5'", "'x'", "true", "`now()`"]
TYPES = {"int": 5, "bigint": 5, "smallint": 5, "double": 5.0, "decimal(9,2)": decimal.Decimal("5.00"), "string": "5", "boolean": True, "date": datetime.date(2020, 1, 2)}


@pytest.mark.parametrize("default", DEFAULTS)
def test_any_default_fills_any_type(spark, default):
    """A default never makes a null key vanish, whatever it is and whatever the column's type."""
    text = default.strip("'`")
    for kind, value in TYPES.items():
        equal = {"int": text == "5", "bigint": text == "5", "smallint": text == "5", "double": text == "5", "decimal(9,2)": text == "5", "string": text == "5", "boolean": text == "true", "date": False}[kind]
        df = spark.createDataFrame([(1, None), (2, None), (3, value)], f"i int, k {kind}")
        c = Contract.compile(f"Table t {{\n i int\n k {'varchar' if kind == 'string' else kind} [pk, default: {default}]\n}}", {"t": df})
        repeated = next(found for rule, _, found, *_ in c.key_parts(c.db.tables[0]) if rule == "pk_duplicate")
        assert {x["i"] for x in repeated.collect()} == ({1, 2, 3} if equal else {1, 2}), (kind, default)
        assert {x["rule"]: x["violations"] for x in c.summary().where("rule = 'pk_duplicate'").collect()} == {"pk_duplicate": 3 if equal else 2}
        parents = df.where("i = 3").select("k")
        fill = {"k": text}
        assert {x["i"] for x in keys.orphan_rows(df, ["k"], parents, ["k"], fill).collect()} == (set() if equal else {1, 2}), (kind, default)
        assert not keys.orphan_rows(df, ["k"], df.select("k"), ["k"], fill, target_defaults=fill).count()


def test_composite_keys_with_unfit_defaults(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, None, "b"), (4, 1, None), (5, 1, "a")], "i int, k int, m string")
    assert {x["i"] for x in keys.duplicate_rows(df, ["k", "m"], {"k": "now()"}).collect()} == {1, 2}
    target = spark.createDataFrame([(1, "a")], "k long, m string")
    assert {x["i"] for x in keys.orphan_rows(df, ["k", "m"], target, ["k", "m"], {"k": "now()"}).collect()} == {1, 2, 3}
    assert keys.duplicate_keys(df, ["k", "m"], {"k": "now()"}).collect() == [(None, "a", 2)]


def test_clashing_and_dotted_names(spark):
    df = spark.createDataFrame([(1, -1, "x", "y", "z", 0), (1, 2, "x", "y", "z", 0)], "`a.b` int, rule int, message string, broken string, __key0 string, n int")
    source = 'Table t {\n "a.b" int [pk]\n rule int [check: `rule > 0`]\n message int\n}'
    c = Contract.compile(source, {"t": df})
    found = {(x["rule"], x["key_json"]) for x in c.violations().collect()}
    assert found == {("check", '{"a.b":1}'), ("type", '{"a.b":1}'), ("pk_duplicate", '{"a.b":1}')}
    assert {x["rule"]: x["violations"] for x in c.summary().collect()} == {"check": 1, "type": 2, "integer": 0, "pk_null": 0, "pk_duplicate": 2}
    bad = rows.bad_rows(df, c.db.tables[0], c.db)
    assert bad.columns == [*df.columns, "rule_", "rule_column", "message_"] and bad.count() == 3
    assert keys.duplicate_rows(df, ["a.b"]).columns == df.columns and keys.orphan_rows(df, ["a.b"], df, ["rule"]).count() == 2


def test_random_keys_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1, 2, 3, 4]), r.choice([None, "x", "y"])) for i in range(300)]
    parents = [(1, "x"), (2, "y"), (4, "x")]
    df = spark.createDataFrame(rows, "i int, a int, b string")
    whole = Counter((a, b) for _, a, b in rows if a is not None and b is not None)
    assert {x["i"] for x in keys.duplicate_rows(df, ["a", "b"]).collect()} == {i for i, a, b in rows if whole[a, b] > 1}
    assert {x["i"] for x in keys.null_key_rows(df, ["a", "b"]).collect()} == {i for i, a, b in rows if a is None or b is None}
    target = spark.createDataFrame(parents, "a int, b string")
    assert {x["i"] for x in keys.orphan_rows(df, ["a", "b"], target, ["a", "b"]).collect()} == {i for i, a, b in rows if a is not None and b is not None and (a, b) not in parents}
    first = {(x["a"], x["b"]): x["i"] for x in keys.first_by(df, ["a", "b"], [F.col("i")]).collect()}
    assert first == {k: min(i for i, a, b in rows if (a, b) == k) for k in {(a, b) for _, a, b in rows}}


def test_views(spark):
    tables = catalog(spark, compile_text("Table a.x {\n i int\n}\nTable y {\n i int\n}\nTableGroup g {\n y\n}").result())["tables"]
    names = lambda v: sorted(r["table_name"] for r in view_tables(tables, v).collect())
    assert names(View("v")) == [] and names(View("v", schemas=[])) == ["x", "y"] and names(View("v", groups=["g"])) == ["y"] and names(View("v", tables=["a.x"])) == ["x"]


def test_streaming(spark, tmp_path):
    from keelson.streaming.checks import stream_orphans, stream_violations

    df = spark.createDataFrame([(1, 5), (2, -1), (7, 3)], "id int, n int")
    df.write.parquet(str(tmp_path / "in"))
    table = compile_text("Table t {\n id int\n n int [check: `n > 0`]\n}").result().tables[0]
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    parents = spark.createDataFrame([(1,), (2,)], "pid int")
    for name, frame in (("bad", stream_violations(stream(), table)), ("orphans", stream_orphans(stream(), ["id"], parents, ["pid"]))):
        query = frame.writeStream.format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert [r["id"] for r in spark.table("bad").collect()] == [2] and [r["id"] for r in spark.table("orphans").collect()] == [7]


def test_tasks_that_hold_keys_grow_in_number_with_the_input(spark, tmp_path):
    """Some 36 MB of keys, each twice: a task has a ninth of them, though Spark would use 4 tasks."""
    spark.range(6_000_000).select(F.xxhash64(F.expr("id div 2")).alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    most = lambda found: found.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    largest, n = most(keys.duplicate_keys(df, ["k"]))
    assert n == 3_000_000 and largest < 400_000
    largest, n = most(keys.duplicate_rows(df, ["k"]))
    assert n == 6_000_000 and largest < 800_000
    largest, n = most(keys.orphan_rows(df, ["k"], df.where("k > 0"), ["k"]))
    assert n == df.where("k <= 0").count() and largest < 450_000
    assert keys.duplicate_count(df, ["k"]).first()[0] == 6_000_000
