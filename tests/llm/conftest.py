from __future__ import annotations

import pytest

LONG = ("the quick brown fox jumps over the lazy dog and runs far away from here " * 40 + "\n") * 60
ODD = [
    (1, None), (2, ""), (3, " \t\n\r\n"), (4, LONG), (5, LONG), (6, LONG + "x"), (7, "MIT"), (8, "Ünïcode İ K \u2003 <|endoftext|> \x1c 'S 's ¼²"),
    (9, "a\n\na\nA \n a\n"), (10, "released under the MIT License. apache license, version 2.0"), (11, "one two"), (11, "one two"), (12, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (13, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (14, "ONE TWO"), (15, "aaaa" * 200), (16, "b" + "aaaa" * 200),
]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory) -> str:
    """A folder with small tables of odd rows; ids are unique but for one repeated row."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en" if i % 2 else None, "src0", len(t or "")) for i, t in ODD]
    rows += [(100 + i, f"shared line\nsome words of document {i} stand here and there, of it and to it\n  SHARED line  \nlast", "en", "src1", 80) for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "One, two!"), (3, None), (4, "..."), (2, "One, two!"), (10, "lazy dog and runs"), (None, "jumps over")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 112)] + [(None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "http://A.Example.org/es/x", "<a href='//evil.example.net/a'>"), (2, None, None), (3, "no scheme", ""), (4, "http://evil.example.net", "<a href=\"http://A.example.ORG/x\">"), (5, "http://x.com/de/1", ""), (6, "http://x.com/de/2", ""), (7, "http://x.com/de/3", ""), (8, "http://x.com/de/4", ""), (9, "http://x.com/it/5", None), (10, "http://sub.x.com?q=://y", ""), (11, "http://org/", ""), (11, "http://org/", ""), (12, "a://b\nc/d#e", "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def odd(spark, odd_dir):
    """The odd documents with a null id, and with columns named like the operators' own outputs and helpers."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(None, "some words without an id", None), (None, None, None)], docs.schema))
    names = ["ids", "decoded", "score", "predicted", "lang_pred", "n_lines", "n_dropped", "keep", "kept", "spans", "n_bytes", "n_words", "label", "bands", "hits", "w"]
    return docs.withColumns({n: F.lit("mine") for n in names})


@pytest.fixture(scope="session")
def odd_same(spark, odd_dir):
    """Asserts that a query and its SQL agree on the odd tables."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT DISTINCT * FROM read_parquet('{odd_dir}/{t}.parquet/*.parquet')")

    def check(query, statement: str) -> None:
        from tests.conftest import plain

        want = con.execute(statement)
        names = [d[0] for d in want.description]
        got = query(spark, odd_dir).distinct()
        assert sorted(got.columns) == sorted(names)
        mine = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got.collect())
        theirs = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in want.fetchall())
        assert mine == theirs

    return check
