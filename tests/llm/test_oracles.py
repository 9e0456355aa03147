"""Every training-data query with SQL against DuckDB, on the smallest tables and on odd rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gatewise.llm import queries

DATA = Path("/root/testdata/sf0.001")


def same(spark, name, folder):
    got = entry.queries()[name](spark, str(folder)).toPandas()
    db = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/*.parquet' if file.is_dir() else ''}')")
    want = db.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    db.register("got", got)
    db.register("want", want)
    for a, b in (("got", "want"), ("want", "got")):
        assert not db.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall()
    return len(got)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert same(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(n for n in queries.oracle_sql() if n not in ("op2_url_filter", "op6_exact_top_k", "op13_conversation_trie")))
def test_odd_documents(spark, name, tmp_path):
    words = " ".join(f"w{i % 70}x{i}" for i in range(160))
    texts = [None, "", " \n\t ", "one", words, words, words + " and more", "Ünï <|endoftext|> ☃ " + words, "spam " * 90, "ab" * 700, "web " + words[200:900], "end"]
    rows = [(i * 3 - 6, t, ("en", None, "de")[i % 3], ("src1", "web", None, "src7", "")[i % 5], 7, True, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rank string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert same(spark, name, tmp_path) == len(rows)


def test_odd_pages(spark, tmp_path):
    urls = [None, "", "no scheme", "http://com/en/", "http://CheapPills.net/de/81/casino?x", "https://a.b-c.example.com/en/7#t", "http://über.org/es/x", "http://" + "q" * 70 + ".info/casino", "http://casinobonus.info/a", "http://recipehouse.shop/", "ftp://x://y/z", "http://recipehouse.shop/"]
    rows = [(i if i != 3 else None, u, f"<a casino>Casino bonus</a> recipe house{' pills' * i}" if i % 4 else None, "x") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    assert same(spark, "op2_url_filter", tmp_path) == len(rows)
