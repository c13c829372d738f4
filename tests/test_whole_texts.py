"""Rules that compare whole texts, over rows that a cut would change; SQL and Spark read the same files."""

import duckdb
import pytest

from tidemill.plans.oracle import ORACLE_SQL
from tidemill.plans.queries import QUERIES

from .conftest import rows_of

LONG = "rotor " + "x" * 2100 + " gasket flange casing 4711"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts beyond 2000 characters, in the hit document's lines and in its other lines; a document whose only hit is the last of thirteen."""
    d = str(tmp_path_factory.mktemp("whole"))
    turns = [(c, 1, "user", "rotor gasket flange casing 4711 torque value") for c in (10, 3)]
    lines = "\n".join(f"line {i}" for i in range(8))
    docs = [(10, f"{LONG}\n{lines}\n{LONG}"), (11, f"{LONG}\nshort gasket"), (12, "a\nb")]
    docs += [(3, lines), (4, lines), (5, "\n" * 8 + "casing and flange for gasket 4711")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def check(name, spark, folder):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL[name]).df()
    assert len(want) > 0 and rows_of(QUERIES[name](spark, folder).toPandas()) == rows_of(want)


@pytest.mark.parametrize("name", ["section_mates", "final_boost"])
def test_texts_are_compared_whole(name, spark, folder):
    check(name, spark, folder)


def test_every_element_that_holds_a_code_is_found(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(10, 1, "user", "which AB1234 ?")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    text = "\n".join(f"AB1234 line {i}" for i in range(50))
    spark.createDataFrame([(10, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    check("identifier_probe", spark, d)
    assert QUERIES["identifier_probe"](spark, d).where("code = 'AB1234'").count() == 50
