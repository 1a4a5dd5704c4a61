import pytest

from retentio.operators import impute

SCHEMA = ("city string, gender string, tenure_months int, internet_service string, "
          "monthly_charges double, total_charges double, payment_method string")


@pytest.fixture()
def reference(spark):
    rows = [("New York", "M", 12, "DSL", 50.5, 606.0, "Mailed check"),
            ("New York", "F", 24, "Fiber optic", 60.75, 1458.0, "Credit card"),
            ("Los Angeles", "M", 36, "DSL", 55.25, 1989.0, "Mailed check")]
    return spark.createDataFrame(rows, SCHEMA)


def fill(spark, reference, row, **kw):
    batch = spark.createDataFrame([row], SCHEMA)
    return impute.impute_conditional(
        batch, reference, categorical=("city", "gender", "internet_service", "payment_method"),
        dependencies={"payment_method": "internet_service"}, **kw).first()


def test_fills_from_modes_and_medians(spark, reference):
    r = fill(spark, reference, (None, None, None, None, None, None, None))
    assert r.city == "New York" and r.tenure_months == 24
    assert r.internet_service == "DSL" and r.monthly_charges == 52.88
    assert r.payment_method == "Mailed check"
    assert r.total_charges == pytest.approx(round(52.88 * 24, 2))


def test_given_values_kept(spark, reference):
    r = fill(spark, reference, ("Boston", "F", 10, "Fiber optic", 80.0, None, None))
    assert (r.city, r.tenure_months, r.monthly_charges) == ("Boston", 10, 80.0)
    assert r.total_charges == 800.0
    assert r.payment_method == "Credit card"  # conditional on Fiber optic


def test_zero_is_missing_option(spark, reference):
    r = fill(spark, reference, ("Boston", "F", 0, "DSL", 80.0, None, "x"))
    assert r.tenure_months == 0
    r = fill(spark, reference, ("Boston", "F", 0, "DSL", 80.0, None, "x"), zero_is_missing=True)
    assert r.tenure_months == 24


def test_unknown_parent_falls_back_to_global(spark, reference):
    r = fill(spark, reference, ("Boston", "F", 5, "Satellite", None, None, None))
    assert r.monthly_charges == 55.25 and r.payment_method == "Mailed check"


def test_numeric_categorical_keeps_its_type(spark):
    ref = spark.createDataFrame([(1, "DSL", 10, 50.0, 500.0), (1, "DSL", 12, 52.0, 624.0),
                                 (0, "Fiber", 14, 70.0, 980.0)],
                                "senior int, internet_service string, tenure_months int, "
                                "monthly_charges double, total_charges double")
    batch = spark.createDataFrame([(None, None, None, None, None)], ref.schema)
    out = impute.impute_conditional(batch, ref, categorical=("senior", "internet_service"),
                                    dependencies={})
    assert dict(out.dtypes)["senior"] == "int"
    r = out.first()
    assert r.senior == 1 and r.internet_service == "DSL" and r.monthly_charges == 51.0


def test_service_dependencies(spark):
    """Every dependent service is filled from its parent's mode."""
    children = list(impute.SERVICE_DEPENDENCIES)
    full = [("a", "Yes", "DSL", 10, 20.0, 200.0, *["Yes"] * 7)] * 3 + [
        ("a", "No", "No", 10, 20.0, 200.0, "No phone service", *["No internet service"] * 6)] * 4
    schema = ("city string, phone_service string, internet_service string, tenure_months int, "
              "monthly_charges double, total_charges double, " + ", ".join(f"{c} string" for c in children))
    reference = spark.createDataFrame(full, schema)
    batch = spark.createDataFrame([("a", "Yes", "DSL", 1, 2.0, 3.0, *[None] * 7),
                                   ("a", "No", "No", 1, 2.0, 3.0, *[None] * 7)], schema)
    got = {r.internet_service: r for r in impute.impute_conditional(
        batch, reference, categorical=("city", "phone_service", "internet_service"),
        dependencies=impute.SERVICE_DEPENDENCIES).collect()}
    assert all(got["DSL"][c] == "Yes" for c in children)
    assert got["No"]["multiple_lines"] == "No phone service"
    assert got["No"]["streaming_tv"] == "No internet service"
