"""Identifiers and discriminators."""

from pyspark.sql import functions as F

from slotframe.functions import names


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_snake_case(spark):
    assert one(spark, "HTTPServer", names.snake_case) == "h_t_t_p_server"
    assert one(spark, "initialize", names.snake_case) == "initialize"
    assert one(spark, "setÅngström", names.snake_case) == "set_Ångström"


def test_sanitize_agrees_with_the_driver(spark):
    for value in ["My-Åcc 9_x", "a.b", "Straße²", "漢字!", "", "ÄÖ"]:
        assert one(spark, value, names.sanitize) == names.sanitize_name(value)
    assert names.sanitize_name("My-Åcc 9_x") == "my_Åcc_9_x"


def test_discriminators(spark):
    assert one(spark, "initialize", names.instruction_discriminator).hex() == "afaf6d1f0d989bed"
    assert one(spark, "GlobalState", names.account_discriminator).hex() == "a32e4aa8d87b8562"
    for kind, fn in (("instruction", names.instruction_discriminator), ("account", names.account_discriminator)):
        for value in ("placeOrder", "HTTPServer"):
            assert bytes(one(spark, value, fn)) == names.discriminator_of(kind, value)
