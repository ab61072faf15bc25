import pytest
from pyspark.sql import functions as F

from lattice.functions import scalars as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("confidence, tier", [(0.95, "verified"), (0.9, "verified"), (0.89, "accepted"), (0.7, "accepted"), (0.69, "low-confidence"), (0.0, "low-confidence")])
def test_tiers(spark, confidence, tier):
    assert one(spark, C.classify_node(F.lit(None).cast("string"), F.lit(confidence), F.lit("none"))["tier"]) == tier


@pytest.mark.parametrize("path, context", [("src/Ordering/Order.cs", "Ordering"), ("src/app/order-items/a.ts", "OrderItems"), ("Order.cs", "Root"), ("src/lib/x.py", "Root"), ("billing_core\\sub\\x.cs", "BillingCore")])
def test_contexts(spark, path, context):
    assert one(spark, C.infer_context(F.lit(path))) == context


@pytest.mark.parametrize("kind, symbol, role", [("Class", "OrdersController", "Controller"), ("Class", "orderservice", "Service"), ("Class", "UserRepo", "Repository"), ("Class", "PaymentSubscriber", "EventConsumer"), ("Class", "AppSettings", "Configuration"), ("Class", "OrderViewModel", "DTO"), ("Class", "Order", "Domain"), ("Module", "Order", "Component"), ("Interface", "IOrderService", "Contract"), ("Method", "X.Service", "Member"), ("Enum", "Kind", "Enumeration"), ("Record", "Dto", "DataRecord"), ("Struct", "Money", "ValueObject")])
def test_roles(spark, kind, symbol, role):
    assert one(spark, C.infer_role(F.lit(kind), F.lit(symbol))) == role


@pytest.mark.parametrize("path, test", [("src/tests/a.cs", True), ("src/Test/a.cs", True), ("a/OrderTests.cs", True), ("a/test_x.py", True), ("a/x.spec.ts", True), ("a/spec_x.rb", True), ("a/contest.cs", True), ("a/order.cs", False), ("latest/order.cs", False)])
def test_test_paths(spark, path, test):
    assert one(spark, C.is_test_path(F.lit(path))) is test


def test_texts(spark):
    assert one(spark, C.tokenize(F.lit("What does the Order_Service do? order_service não paga ÉTÉ"))) == ["order_service", "paga", "été"]
    assert one(spark, C.estimate_tokens(F.lit("12345"))) == 2 and one(spark, C.estimate_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, C.mermaid_id(F.lit("::"))) == "entity" and one(spark, C.mermaid_label(F.lit('a"b'))) == "a#quot;b"
    assert one(spark, C.normalize_name(F.lit(" a \n b "))) == "a b"
    assert round(one(spark, C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0)))), 6) == 0.707107
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    h = lambda callees: one(spark, C.structural_hash(F.lit("Class"), F.lit("A"), F.array(F.lit("B")), F.array(*map(F.lit, callees))))
    assert h(["a.x", "y"]) == h(["y", "b.x", "x"]) != h(["z"])
