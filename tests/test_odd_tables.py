"""Registered queries against their SQL on tables with odd rows."""

import duckdb

import __spark_entry__
from test_queries import normal


def differs(spark, folder, name, **tables):
    """Writes the tables (rows, schema) and returns the rows of a query and of its SQL."""
    connection = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = __spark_entry__.queries()[name](spark, str(folder))
    result = connection.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    return normal(found.columns, found.collect()), normal(columns, result.fetchall())


def test_documents_of_blanks_stay_in_the_backlog(spark, tmp_path):
    texts = ["done", "", "  ", "done", " \n ", None, "done", "one", "a|b", "done", "\t", "two\nlines", "done", "|", ""]
    documents = [*enumerate(texts), (7, None), (None, "no id"), (-1, ""), (-3, "")]
    found, expected = differs(spark, tmp_path, "t4_chunk_backlog", documents=(documents, "doc_id long, text string"))
    assert found == expected
    assert {(1,), (2,), (4,), (7,), (-1,), (14,)} <= set(found)


def test_every_turn_with_a_text_gets_an_embedding(spark, tmp_path):
    """The words w0 and w88 meet in one place of the vector with unlike signs."""
    texts = ["w0 w88", "w88 w0 w0 w88", "", "  ", None, "\n", "\t \n", "　", "​", "one two"]
    turns = [*((k, 1, text) for k, text in enumerate(texts)), (None, 3, "no id"), (3, None, "no turn"), (4, -1, "before"), (4, -2, "before"), (5, 0, "done"), (5, 2, None), (6, 1001, "late"), (7, 1000, "late")]
    found, expected = differs(spark, tmp_path, "t5_embedding_backfill", conversations=(turns, "conv_id long, turn long, text string"))
    assert found == expected
    assert len(found) == 12
