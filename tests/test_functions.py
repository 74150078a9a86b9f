from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_clean_light(spark):
    assert one(spark, tx.clean_light(F.col("t")), t="<p>a &amp; b</p>  ﬁne​ x ") == "a & b fine x"
    assert one(spark, tx.clean_light(F.col("t")), t="  ") is None
    assert one(spark, tx.clean_light(F.col("t")), t="&lt;p&gt;") == "<p>"


def test_match_key_folds_and_drops(spark):
    assert one(spark, tx.match_key(F.col("t")), t="L’Étude : Œuvre-2") == "letude uvre 2"
    assert one(spark, tx.slug(tx.match_key(F.col("t"))), t="Été d'or") == "ete_d_or"


def test_doi(spark):
    assert one(spark, tx.normalize_doi(F.col("t")), t="https://doi.org/10.1000/AbC.") == "10.1000/abc"
    assert one(spark, tx.normalize_doi(F.col("t")), t="doi: 10.1000%2Fx+y") == "10.1000/x+y"
    assert one(spark, tx.extract_doi(F.col("t")), t="see 10.1234/foo?x=1") == "10.1234/foo"
    assert one(spark, tx.normalize_doi(F.col("t")), t="11.1/x") is None


def test_person_name(spark):
    assert one(spark, tx.person_name(F.col("t")), t="Pr. Dr. EL-AMRANI m'sik") == "El-Amrani M'Sik"
    assert one(spark, tx.person_name(F.col("t")), t="Dr") == "Dr"


def test_abstract_and_wrapping(spark):
    assert one(spark, tx.clean_abstract(F.col("t")), t="Abstract: Some Words ...") == "some words"
    lines = F.array(F.lit("Hydro-"), F.lit("logie"), F.lit("Système -"), F.lit("Intelligent"))
    assert one(spark, tx.join_wrapped(lines), t="") == "Hydrologie Système - Intelligent"


def test_dates(spark):
    cases = {"2021/3/5": ("2021-03-05", 2021, "day"), "2021-02-30": ("2021-02", 2021, "month"), "2021/13": ("2021", 2021, "year"), "Jan 2021": ("2021-01", 2021, "month"), "5 March 2021": ("2021-03-05", 2021, "day"), "March 5, 2021": ("2021-03-05", 2021, "day"), "soon": ("2019", 2019, "year")}
    for raw, expected in cases.items():
        assert tuple(one(spark, vl.publication_date(F.col("t"), F.lit("2019")), t=raw)) == expected, raw


def test_numbers(spark):
    assert one(spark, vl.count_or_null(F.col("t")), t="12") == 12
    assert one(spark, vl.count_or_null(F.col("t")), t="-1") is None
    assert one(spark, vl.web_url(F.col("t")), t="ftp://a/b") is None
    assert one(spark, vl.external_id_fault(F.col("t")), t="abcdefghijk_") is None
    index = F.create_map(F.lit("world"), F.array(F.lit(1)), F.lit("hello"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, vl.words_from_index(index), t="") == "hello world hello"
